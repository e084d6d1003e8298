import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from tessera.llm import mixing
from tessera.llm.common import Scratch

from .helpers import AWKWARD, docs

RESULT = "source_key lang_key topic n_tokens probability selected source_off lang_off topic_off".split()


def corpus(spark, n=1500):
    texts = {}
    langs = {}
    for i in range(n):
        texts[i] = " ".join(f"subject{(i * 7 + j * (i % 5)) % 90}" for j in range(5 + i % 40))
        langs[i] = ("de", "fr", "en", "en")[i % 4]
    return docs(spark, texts, langs)


def plain(cells, p):
    """Raking with dictionaries: {(source, lang, topic): tokens} to probabilities, for targets that can be met."""
    total = sum(cells.values())
    wanted = []
    for k in range(3):
        there = defaultdict(float)
        for c, n in cells.items():
            there[c[k]] += n
        there = {v: n for v, n in there.items() if n}
        full = {}
        while True:
            free = {v: (n / total) ** p.power for v, n in there.items() if v not in full}
            scale = (p.keep * total - sum(full.values())) / (sum(free.values()) or 1)
            over = {v: there[v] for v, x in free.items() if x * scale >= there[v]}
            if not over:
                break
            full |= over
        wanted.append(full | {v: x * scale for v, x in free.items()})
    probability = dict.fromkeys(cells, p.keep)
    for _ in range(400):
        for k in range(3):
            have = defaultdict(float)
            for c, n in cells.items():
                have[c[k]] += n * probability[c]
            probability = {c: min(1.0, x * (wanted[k][c[k]] / have[c[k]] if have[c[k]] else 1.0)) for c, x in probability.items()}
    return probability, wanted


@pytest.mark.parametrize("p", [mixing.Mix(), mixing.Mix(power=0.6, keep=0.5), mixing.Mix(tolerance=1e-5)])
def test_against_plain_raking(spark, p):
    got = mixing.mix(corpus(spark, 600), p=p).toPandas()
    cells = {k: int(v) for k, v in got.groupby(["source_key", "lang_key", "topic"]).n_tokens.sum().items()}
    want, wanted = plain(cells, p)
    assert got.drop_duplicates(["source_key", "lang_key", "topic"]).shape[0] == len(cells) > 20
    got["wanted"] = got.n_tokens * got.probability
    for k, dim in enumerate(("source_key", "lang_key", "topic")):
        have = got.groupby(dim).wanted.sum()
        off = got.groupby(dim)[f"{dim.removesuffix('_key')}_off"].first()
        for v in have.index:
            assert have[v] == pytest.approx(wanted[k][v], rel=2 * p.tolerance)
            assert off[v] == pytest.approx(have[v] / wanted[k][v] - 1, abs=1e-6)
    for r in got.itertuples():
        assert r.probability == pytest.approx(want[r.source_key, r.lang_key, r.topic], rel=0.05)
    assert got.probability.between(0, 1).all()


def hot_cells(seed=3):
    """A source with more than a third of all tokens that alone holds one language, and small ones."""
    rng = random.Random(seed)
    cells = [("hot", "xx", t, 5000 + 100 * t) for t in range(8)]
    cells += [(f"s{i}", g, t, rng.randrange(1, 400)) for i in range(30) for g in ("aa", "bb") for t in range(8)]
    return pd.DataFrame(cells, columns=["source", "lang", "topic", "tokens"])


def test_targets_that_cannot_be_met_are_shared_and_told(spark):
    p, cells = mixing.Mix(power=0.3), hot_cells()
    got = mixing.rake_here(cells, p)
    off = [got[f"{d}_off"].abs().max() for d in mixing.DIMS]
    for k, d in enumerate(mixing.DIMS):
        have = (got.tokens * got.probability).groupby(got[d]).sum()
        there = got.groupby(d).tokens.sum()
        target = mixing.water(there.to_numpy(float), (there / there.sum()).to_numpy() ** p.power, p.keep * there.sum())
        assert got.groupby(d)[f"{d}_off"].first().tolist() == pytest.approx((have / target - 1).tolist(), abs=1e-9)
    assert off[0] > 10 * p.tolerance and off[1] > 10 * p.tolerance
    only_in_turn = mixing.rake_here(cells, mixing.Mix(power=0.3, patience=10**6, rounds=300))
    assert max(off) < max(only_in_turn[f"{d}_off"].abs().max() for d in mixing.DIMS)


@pytest.mark.parametrize("power", [0.9, 0.3])
def test_cells_raked_here_and_there_alike(spark, power):
    p, cells = mixing.Mix(power=power, rounds=4, patience=2), hot_cells().query("topic < 2 and source < 's2'").reset_index(drop=True)
    here = mixing.rake_here(cells, p)
    df = spark.createDataFrame(cells, "source string, lang string, topic int, tokens long")
    there = mixing.rake_there(df, float(cells.tokens.sum()), p, Scratch(spark, "test")).toPandas().sort_values(list(mixing.DIMS))
    here = here.sort_values(list(mixing.DIMS))
    for c in ("probability", *(f"{d}_off" for d in mixing.DIMS)):
        assert here[c].tolist() == pytest.approx(there[c].tolist(), abs=1e-9)


def test_production_settings_on_the_fixture(spark):
    p = mixing.Mix()
    got = mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()
    assert len(got) == 1000 and got.topic.nunique() > 4
    for d in mixing.DIMS:
        assert got[f"{d}_off"].abs().max() <= p.tolerance
    assert got[got.selected].n_tokens.sum() == pytest.approx(p.keep * got.n_tokens.sum(), rel=0.1)


def test_targets_never_exceed_what_there_is(spark):
    cells = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 1)], "source string, tokens long")
    got = {r.source: r.target for r in mixing.targets(cells, "source", 1011.0, mixing.Mix(power=0.1, keep=0.9)).collect()}
    assert got["b"] == 10 and got["c"] == 1 and sum(got.values()) == pytest.approx(0.9 * 1011, rel=1e-6)
    there = np.array([1000.0, 10, 1])
    assert mixing.water(there, (there / 1011) ** 0.1, 0.9 * 1011).tolist() == pytest.approx([got[c] for c in "abc"])


def test_same_sample_again_and_repeated_rows(spark):
    d = corpus(spark, 300)
    a, b = ({(r.doc_id, r.selected) for r in mixing.mix(x).collect()} for x in (d, d.repartition(7)))
    assert a == b
    twice = mixing.mix(d.union(d)).toPandas()
    assert (twice.groupby("doc_id").selected.nunique() == 1).all()


def test_awkward_rows(spark):
    rows = mixing.mix(docs(spark, AWKWARD, {0: None, 1: None}), keep=["doc_id", "source", "score"]).collect()
    assert len(rows) == len(AWKWARD)
    assert {r.lang_key for r in rows} == {"", "en"}
    assert mixing.mix(docs(spark, [])).count() == 0
    assert mixing.mix(docs(spark, [(1, None)])).count() == 1


def test_extra_columns_with_names_of_ours(spark):
    d = docs(spark, [(1, "subject words here"), (2, None)])
    for n in [*RESULT, "__own_topic", "tokens", "of_source"]:
        d = d.selectExpr("*", f"'own' AS {n}")
    got = mixing.mix(d, keep=d.columns, prefix="__mix_")
    assert got.columns == [*d.columns, *(f"__mix_{n}" for n in RESULT)]
    assert {tuple(r[n] for n in RESULT) for r in got.collect()} == {("own",) * len(RESULT)}


def test_topics_tell_subjects_apart(spark):
    """Documents of one subject, in whatever language, share a topic with few others."""
    rng, subjects = random.Random(5), [[f"{g}matter{s}x{i}" for i in range(40)] for g in ("de", "en") for s in range(4)]
    texts = {i: " ".join(rng.choice(subjects[i % 8]) for _ in range(30)) for i in range(400)}
    got = mixing.mix(docs(spark, texts, {i: ("de", "en")[i % 8 // 4] for i in texts})).toPandas()
    got["subject"] = got.doc_id % 8
    most = got.groupby("subject").topic.agg(lambda t: t.value_counts().iloc[0] / len(t))
    assert most.min() > 0.8
    assert got.groupby("lang_key").topic.nunique().min() >= 3
