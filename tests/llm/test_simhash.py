import random

import pytest
import xxhash

from tessera.llm import simhash
from tessera.llm.components import connected_components

from .helpers import AWKWARD, ascii_lower, docs, words


def fingerprint(text):
    w = words(ascii_lower(text or ""))
    parts = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64)) if parts else 0


def components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(texts):
    fps = {i: fingerprint(t) for i, t in texts if i is not None}
    ids = sorted(fps)
    return fps, components([(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 2], ids)


def near_texts(n, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(300)}" for _ in range(120)]
    out = {}
    for i in range(n):
        w = list(base) if i % 3 else [f"v{rng.randrange(300)}" for _ in range(60)]
        if i % 3:
            w[rng.randrange(len(w))] = f"x{rng.randrange(40)}"
        out[i] = " ".join(w)
    return out


@pytest.mark.parametrize("pair_group", [1, 8])
def test_against_all_pairs(spark, pair_group):
    texts = near_texts(150, 3)
    fps, comp = brute(texts.items())
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, texts), pair_group=pair_group).collect()}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == fps
    assert {i: r.component_id for i, r in got.items()} == comp


def test_awkward_rows(spark):
    fps, comp = brute(AWKWARD)
    rows = simhash.near_duplicates(docs(spark, AWKWARD)).collect()
    assert len(rows) == len(AWKWARD)
    for r in rows:
        if r.doc_id is not None:
            assert (int(r.fingerprint, 16), r.component_id) == (fps[r.doc_id], comp[r.doc_id])
    assert next(r for r in rows if r.doc_id is None).component_id == 8


def test_links_within_two_bits_are_all_found(spark):
    rng = random.Random(1)
    fps = set()
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(25):
            fps.add(f)
            f ^= 1 << rng.randrange(64)
            f ^= 1 << rng.randrange(64)
    reps = spark.createDataFrame([(simhash.signed(f), i) for i, f in enumerate(sorted(fps))], "fp long, rep long")
    ids = {i: f for i, f in enumerate(sorted(fps))}
    want = components([(a, b) for a in ids for b in ids if a < b and (ids[a] ^ ids[b]).bit_count() <= 2], ids)
    for pair_group in (1, 4, 1000):
        got = connected_components(spark, simhash.links(reps, pair_group=pair_group))
        found = {i: i for i in ids} | {r.node: r.component for r in got.collect()}
        assert found == want


def test_long_chain_and_hub(spark):
    pairs = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5001)]
    got = connected_components(spark, spark.createDataFrame([*pairs, (7, 7), (None, 3)], "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == {n: c for n, c in components(pairs, {x for p in pairs for x in p}).items()}


def test_empty(spark):
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    assert simhash.one_per_group(docs(spark, [])).count() == 0


def test_one_per_group(spark):
    got = simhash.one_per_group(docs(spark, AWKWARD))
    assert got.columns == docs(spark, []).columns
    assert sorted(r.doc_id for r in got.collect() if r.doc_id is not None) == [0, 3, 4, 5, 7, 8]


@pytest.mark.parametrize(("distance", "blocks"), [(2, 4), (5, 8), (6, 9)])
def test_all_pairs_within_any_distance(spark, distance, blocks):
    rng = random.Random(distance)
    fps = []
    for _ in range(20):
        f = rng.getrandbits(64)
        for _ in range(6):
            g = f
            for b in rng.sample(range(64), rng.randrange(distance + 3)):
                g ^= 1 << b
            fps.append(g)
    reps = spark.createDataFrame([(i, simhash.signed(f)) for i, f in enumerate(fps)], "node long, fp long")
    want = {(a, b) for b in range(len(fps)) for a in range(b) if (fps[a] ^ fps[b]).bit_count() <= distance}
    members = simhash.sharing(reps, distance, blocks)
    assert {(r.a, r.b) for r in simhash.within(members, distance, 1000).collect()} == want
    few = {(r.a, r.b) for r in simhash.within(members, distance, 1).collect()}
    assert few and few <= want
