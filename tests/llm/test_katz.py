import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from tessera.llm import katz

from .helpers import AWKWARD, ascii_lower, docs, words

END, BEGIN = object(), object()


class Plain:
    """The same model with dictionaries and a recursive probability."""

    def __init__(self, texts, order=2):
        self.order = order
        self.count = [None] + [Counter() for _ in range(order)]
        for t in texts:
            w = self.padded(t)
            for n in range(1, order + 1):
                self.count[n].update(tuple(w[i - n + 1 : i + 1]) for i in range(order - 1, len(w)))
        uni = self.count[1]
        self.n, self.v = sum(uni.values()), len(uni)
        self.discount = [None] + [katz.Discount(dict(Counter(c for c in self.count[n].values() if c <= 6))) for n in range(1, order + 1)]
        kept = sum(self.kept(1, c) for c in uni.values())
        self.total = self.n if kept < self.n * (1 - 1e-12) else self.n + 1
        self.unseen_types = max(sum(c == 1 for c in uni.values()), 1)
        self.unseen = (1 - kept / self.total if self.n else 1.0) / self.unseen_types
        self.follow = defaultdict(dict)
        for n in range(2, order + 1):
            for gram, c in self.count[n].items():
                self.follow[gram[:-1]][gram[-1]] = c

    def padded(self, t):
        return [BEGIN] * (self.order - 1) + words(ascii_lower(t or "")) + [END]

    def kept(self, n, c):
        return c * self.discount[n].ratio.get(c, 1.0)

    def p(self, h, w):
        if not h:
            c = self.count[1][(w,)]
            return self.kept(1, c) / self.total if c else self.unseen
        seen, n = self.follow.get(h), len(h) + 1
        if not seen:
            return self.p(h[1:], w)
        c = sum(seen.values())
        kept = sum(self.kept(n, x) for x in seen.values())
        whole = c if kept < c * (1 - 1e-12) else c + 1
        if w in seen:
            return self.kept(n, seen[w]) / whole
        return (1 - kept / whole) / (1 - sum(self.p(h[1:], x) for x in seen)) * self.p(h[1:], w)

    def score(self, t):
        w, k = self.padded(t), self.order - 1
        return sum(math.log10(self.p(tuple(w[i - k : i]), w[i])) for i in range(k, len(w)))

    def base(self, t):
        w = self.padded(t)[self.order - 1 :]
        return sum(math.log10((self.count[1][(x,)] + 1) / (self.n + self.v + 1)) for x in w), len(w), sum((x,) in self.count[1] for x in w)


def corpus(n=250):
    rng = random.Random(8)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3000)]
    return [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(40)))) for i in range(n)]


def check(spark, texts, p=None):
    p = p or katz.Settings()
    plain = Plain([t for i, t in texts if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2], p.order)
    rows = katz.score(docs(spark, texts), p=p).collect()
    assert len(rows) == len(texts)
    of = {i: t for i, t in texts}
    for r in rows:
        base, n, known = plain.base(of[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, plain.n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(plain.score(of[r.doc_id]), rel=1e-9)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
    return plain


@pytest.mark.parametrize("p", [katz.Settings(), katz.Settings(order=3), katz.Settings(order=3, chunk=100, shard=200), katz.Settings(order=1, chunk=50)])
def test_against_recursion_and_normalised(spark, p):
    plain = check(spark, corpus(120), p)
    for h in [*list(plain.follow)[:15], *list(plain.follow)[-10:], ("never",)]:
        assert sum(plain.p(h, w) for (w,) in plain.count[1]) + plain.unseen_types * plain.p(h, "unseen") == pytest.approx(1, abs=1e-9)


@pytest.mark.parametrize("order", [2, 3])
def test_stored_model_scores_other_texts(spark, order):
    texts, others = corpus(80), [(1000 + i, t + " quite new words") for i, t in corpus(100)[80:]]
    flagged = docs(spark, texts).selectExpr("doc_id", "doc_id % 3 = 0 AS held_out", "text")
    _, model = katz.apply(flagged, katz.Settings(order=order, chunk=100, shard=150))
    plain = Plain([t for i, t in texts if i % 3], order)
    rows, _ = katz.apply(docs(spark, others).selectExpr("doc_id", "false AS held_out", "text"), model=model)
    got = {r.doc_id: r for r in rows.collect()}
    assert len(got) == len(others)
    for i, t in others:
        assert got[i].score == pytest.approx(plain.score(t), rel=1e-9) and got[i].base_score == pytest.approx(plain.base(t)[0], rel=1e-9)


def test_tables_are_partitioned(spark):
    _, model = katz.apply(docs(spark, corpus(60)).selectExpr("doc_id", "false AS held_out", "text"), katz.Settings(chunk=100, shard=100))
    assert "level=2" in "".join(model.grams.where("level = 2").inputFiles())
    assert model.grams.groupBy("level", "shard").count().where("count > 1").count() == 0
    assert model.grams.where("level = 2").count() > 8


def test_copies_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        check(spark, [(i, "the same words again and again" if i % 2 else f"text number {i}") for i in range(40)])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_awkward_rows(spark):
    check(spark, AWKWARD)


def test_empty(spark):
    assert katz.score(docs(spark, [])).count() == 0
