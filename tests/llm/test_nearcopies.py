import random

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tessera.llm import nearcopies, simhash

from .helpers import AWKWARD, ascii_lower, docs, words
from .test_simhash import components


def shingles(text):
    w = words(ascii_lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def brute(texts):
    sets = {i: shingles(t) for i, t in texts if i is not None}
    ids = sorted(sets)
    return components([(a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])], ids)


def families(seed, n=12, size=15):
    """Families whose members are one change away from some earlier member, so that many are joined by chains only."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        family = [[f"w{rng.randrange(500)}" for _ in range(120)]]
        while len(family) < size:
            w = list(rng.choice(family))
            for _ in range(rng.randrange(1, 4)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
            family.append(w)
        out += family
    rng.shuffle(out)
    return {i: " ".join(w) for i, w in enumerate(out)}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    texts = families(seed)
    got = {r.doc_id: r.component_id for r in nearcopies.near_copies(docs(spark, texts)).collect()}
    assert got == brute(texts.items())


def star(n, seed=4):
    """Copies of one text, each with one word changed: near the text, but not near one another."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(52)]
    out = {n // 2: " ".join(base)}
    for i in (i for i in range(n) if i != n // 2):
        w = list(base)
        w[rng.randrange(5, 47)] = f"x{i}"
        out[i] = " ".join(w)
    return out


def test_a_large_star_makes_few_pairs(spark, monkeypatch):
    """The pairs compared are in proportion to the members."""
    n, seen, plain = 300, [], nearcopies.verified

    def counting(pairs, known, p):
        seen.append(pairs.count())
        return plain(pairs, known, p)

    monkeypatch.setattr(nearcopies, "verified", counting)
    texts = star(n)
    got = {r.doc_id: r.component_id for r in nearcopies.near_copies(docs(spark, texts)).collect()}
    assert got == brute(texts.items()) == dict.fromkeys(range(n), 0)
    assert sum(seen) < 12 * n


def gradient(n, seed=6):
    """Copies of one text with few to many words changed, dropped or added: some near it, some near others only, some near none."""
    rng = random.Random(seed)
    base, out = [f"w{rng.randrange(5000)}" for _ in range(90)], []
    while len(out) < n:
        w = list(rng.choice(out) if out and rng.random() < 0.3 else base)
        for _ in range(rng.choice([1, 2, 3, 4, 6, 9])):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[f"x{rng.randrange(9000)}"], [], [w[at], f"y{rng.randrange(9000)}"]])
        out.append(w)
    return {i: " ".join(w) for i, w in enumerate(out)}


@pytest.mark.parametrize("p", [nearcopies.Near(), nearcopies.Near(similarity=0.7, bands=60)])
def test_a_large_family_against_all_pairs(spark, monkeypatch, p):
    """No link is lost, and what is compared is in proportion to the members."""
    n, seen, plain = 150, [], nearcopies.verified

    def counting(pairs, known, p):
        seen.append(pairs.count())
        return plain(pairs, known, p)

    monkeypatch.setattr(nearcopies, "verified", counting)
    texts = gradient(n)
    got = {r.doc_id: r.component_id for r in nearcopies.near_copies(docs(spark, texts), p=p).collect()}
    sets = {i: shingles(t) for i, t in texts.items()}
    want = components([(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= p.similarity * len(sets[a] | sets[b])], sorted(sets))
    assert got == want and 1 < len(set(want.values())) < n
    if p == nearcopies.Near():
        assert sum(seen) < 40 * n


def test_stage_merges_near_copies_of_the_fixture(spark):
    folder = "/root/testdata/sf0.01"
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in documents.collect()])
    got = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, documents, folder).collect()}
    assert got == {i for i, c in want.items() if i == c}


def test_awkward_rows(spark):
    got = nearcopies.one_per_group(docs(spark, AWKWARD))
    assert got.columns == docs(spark, []).columns
    assert sorted(r.doc_id for r in got.collect() if r.doc_id is not None) == [0, 3, 4, 5, 7, 8]
    assert nearcopies.one_per_group(docs(spark, [])).count() == 0


def test_simhash_finds_what_is_few_bits_apart(spark):
    """By fingerprints of five-word shingles alone: the one band of 400 minhashes finds nothing but equal sets."""
    rng = random.Random(9)
    texts = {}
    for i in range(0, 120, 2):
        w = [f"w{rng.randrange(5000)}" for _ in range(150)]
        texts[i], texts[i + 1] = " ".join(w), " ".join([*w[: -rng.randrange(1, 20)], "end"])
    sets = {i: shingles(t) for i, t in texts.items()}
    fps = {i: simhash.majority(np.fromiter((xxhash.xxh64_intdigest(" ".join(s), 42) for s in x), np.uint64, len(x))) for i, x in sets.items()}
    p = nearcopies.Near(bands=1, rows=400)
    close = [(a, b) for a in texts for b in texts if a < b and (fps[a] ^ fps[b]).bit_count() <= p.distance and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    got = {r.doc_id: r.component_id for r in nearcopies.near_copies(docs(spark, texts), p=p).collect()}
    assert len(close) > 30
    assert got == components(close, sorted(texts))
