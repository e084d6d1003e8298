import hashlib
import random

from tessera.llm import repeats

from .helpers import AWKWARD, by_id, docs, words


def brute(texts, n=13):
    first = {}
    for i, t in texts:
        if i is None:
            continue
        w = words(t)
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, t in texts:
        w = words(t)
        gone = set()
        for k in range(len(w) - n + 1):
            if i is not None and first[tuple(w[k : k + n])] < i:
                gone.update(range(k, k + n))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def check(spark, texts, **sizes):
    got = repeats.cut_repeats(docs(spark, texts), **sizes).collect()
    want = brute(texts)
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.n_removed, r.kept) == want[r.doc_id], r.doc_id
        assert sum(s.length for s in r.spans) == r.n_removed
        assert words(r.rest) == words(r.kept)


def test_planted_passages(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.choice([12, 13, 14, 20, 60]))] for _ in range(12)]
    texts = []
    for i in range(120):
        w = []
        for _ in range(rng.randrange(4)):
            w += [f"u{rng.randrange(2000)}" for _ in range(rng.randrange(25))]
            p = rng.choice(passages)
            a = rng.randrange(3)
            w += p[a : len(p) - rng.randrange(3)]
        texts.append((rng.randrange(10_000) * 200 + i, " ".join(w)))
    check(spark, texts)
    check(spark, texts, chunk=1000, shard=500)


def test_periodic_and_equal_texts(spark):
    check(spark, [(3, "a b " * 40), (1, "a b " * 20), (2, "b a " * 20), (5, "c " * 13), (4, "c " * 12), (9, "x y z " * 30), (8, "x y z " * 30)])


def test_awkward_rows(spark):
    check(spark, AWKWARD)


def test_batches_of_one_text_give_the_same(spark):
    texts = [(i, " ".join(f"q{(j * 7 + i // 4) % 50}" for j in range(60))) for i in range(40)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    try:
        check(spark, texts)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_an_id_with_two_texts_is_one_document(spark):
    rng = random.Random(11)
    passages = [" ".join(f"p{rng.randrange(40)}" for _ in range(30)) for _ in range(4)]
    texts = [(i // 2, f"u{i} {passages[i % 4]} v{i} {passages[rng.randrange(4)]}") for i in range(30)]
    got = sorted(tuple(r) for r in repeats.cut_repeats(docs(spark, texts)).select("doc_id", "kept").collect())
    first = {}
    for i, t in texts:
        for k in range(len(words(t)) - 12):
            key = tuple(words(t)[k : k + 13])
            first[key] = min(first.get(key, i), i)
    want = []
    for i, t in texts:
        w = words(t)
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(13)}
        want.append((i, " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert got == sorted(want)


def test_ids_of_other_types(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    texts = {"b": f"one {passage} two", "a": f"{passage} three", "c": passage, None: passage}
    rows = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id string, text string, kept string")
    got = {r.doc_id: r for r in repeats.cut_repeats(rows, keep=["doc_id", "kept"], prefix="__r_").collect()}
    assert {i: r["__r_kept"] for i, r in got.items()} == {"a": f"{passage} three", "b": "one two", "c": "", None: passage}
    assert {r.kept for r in got.values()} == {"x"}
    small = spark.createDataFrame([(2, passage), (1, passage)], "doc_id smallint, text string")
    assert {r.doc_id: r.n_removed for r in repeats.cut_repeats(small).collect()} == {1: 0, 2: 20}


def test_query_columns(spark, tmp_path):
    from tessera.llm.queries import op4_repeats

    docs(spark, AWKWARD).write.parquet(f"{tmp_path}/documents.parquet")
    got = by_id(op4_repeats(spark, str(tmp_path)))
    want = brute(AWKWARD)
    assert {i: r.kept_sha256 for i, r in got.items()} == {i: hashlib.sha256(w[2].encode()).hexdigest() for i, w in want.items() if i is not None}


def test_empty(spark):
    assert repeats.cut_repeats(docs(spark, [])).count() == 0
