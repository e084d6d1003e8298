import base64
import math
import random
import string
from collections import Counter

import zstandard

from tessera.llm import quality

from .helpers import AWKWARD, docs, words


def brute(text):
    t, w = text or "", words(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    gone = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(gone)


def test_base_counts(spark):
    rng = random.Random(2)
    texts = AWKWARD + [(100 + i, "".join(rng.choice("ab c\n#é|\t") for _ in range(rng.randrange(300)))) for i in range(60)]
    got = quality.compression_bands(docs(spark, texts), keep=["doc_id", "text"]).collect()
    assert len(got) == len(texts)
    for r in got:
        base = brute(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (base[0] < 10 or 100 * base[4] > 20 * base[0])
        assert not (r.base_failed and r.kept)


def test_bands(spark):
    rng = random.Random(4)
    syllables = [a + b for a in "bcdfghlmnprst" for b in ("a", "e", "i", "on", "er")]
    prose = " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(1500))
    noise = " ".join("".join(rng.choice(string.ascii_letters + string.digits + "+/") for _ in range(60)) for _ in range(60))
    template = " ".join(f"item {i % 7} costs {i % 5} and {chr(97 + i % 26)}{i} is sold" for i in range(900))
    got = {r.doc_id: r for r in quality.compression_bands(docs(spark, {1: prose, 2: noise, 3: template, 4: prose[:300], 5: prose[:80]}), keep=["doc_id"]).collect()}
    assert got[1].kept and got[4].kept and got[5].kept
    assert not got[2].kept and got[2].reason == "incompressible"
    assert not got[3].kept and got[3].reason in ("repetitive", "base")


def test_good_documents_stay(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = quality.compression_bands(spark.read.parquet(f"{folder}/documents.parquet"), keep=["doc_id"]).where("NOT base_failed").collect()
    good = [r.kept for r in got if labels.get(r.doc_id) == 1]
    assert sum(good) == len(good) > 200


def test_limits_are_monotone():
    b = quality.Bands()
    most = [b.of(2**k)[1] for k in range(5, 24)]
    assert most == sorted(most, reverse=True)


def test_held_out_fold_is_told_apart(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("crc32(cast(cast(doc_id AS string) AS binary)) % 2 = 1")
    got = quality.compression_bands(spark.read.parquet(f"{folder}/documents.parquet"), keep=["doc_id"]).where("NOT base_failed").join(labels, "doc_id").collect()
    junk, good = ([r.kept for r in got if r.quality == q] for q in (0, 1))
    assert len(junk) > 100 and sum(junk) < 0.3 * len(junk)
    assert len(good) > 1000 and sum(good) > 0.995 * len(good)


def test_bad_regions_of_long_texts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("quality = 1"), "doc_id").where("lang = 'en'").orderBy("doc_id").limit(60).collect()
    prose = "\n".join(r.text for r in rows).encode().decode("ascii", "ignore")
    noise = base64.b64encode(random.Random(3).randbytes(60_000)).decode()
    good = max((r.text for r in rows), key=len)
    assert len(good) > 4096 and len(prose) > 40_000
    texts = [prose[:4096] + noise[:4095], prose[:40_000] + noise[:20_000], prose[:40_000] + noise[:8192], good]
    zip_ = zstandard.ZstdCompressor(level=quality.Bands().level)
    assert [quality.judge(t.encode(), quality.Bands(), zip_)[3] for t in texts] == ["chunks"] * 3 + [None]


def plain_verdict(text, bands):
    """The verdict worked out apart: limits by straight lines between the given points, every chunk in turn."""
    data = text.encode()
    ratio = lambda x: len(zstandard.ZstdCompressor(level=bands.level).compress(x)) / len(x)

    def limit(n, which):
        x, points = math.log2(n), bands.limits
        if x <= points[0][0]:
            return points[0][which]
        for low, high in zip(points, points[1:], strict=False):
            if x <= high[0]:
                return low[which] + (high[which] - low[which]) * (x - low[0]) / (high[0] - low[0])
        return points[-1][which]

    chunks, at = [], 0
    while at + bands.chunk <= len(data):
        chunks.append(data[at : at + bands.chunk])
        at += bands.chunk
    if chunks and at < len(data):
        chunks.append(data[-bands.chunk :])
    bad = sum(not bands.chunk_least <= ratio(c) <= bands.chunk_most for c in chunks)
    good = limit(len(data), 1) <= ratio(data) <= limit(len(data), 2)
    return good and not (bad >= 2 or bad > len(chunks) / 20), len(chunks), bad


def test_verdicts_against_a_plain_version(spark):
    rng, bands = random.Random(7), quality.Bands()
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 0").orderBy("doc_id").collect()
    texts = {r.doc_id: r.text for r in rows[:300]}
    noise = base64.b64encode(rng.randbytes(9000)).decode()
    texts |= {10_000 + i: rng.choice(rows).text[: rng.randrange(1, 9000)] + noise[: rng.randrange(6000)] for i in range(150)}
    got = {r.doc_id: r for r in quality.compression_bands(docs(spark, texts), keep=["doc_id"]).collect()}
    verdicts = {i: plain_verdict(t, bands) for i, t in texts.items()}
    for i, (good, chunks, bad) in verdicts.items():
        assert (got[i].kept, got[i].n_chunks, got[i].n_bad_chunks) == (good and not got[i].base_failed, chunks, bad), i
    assert 50 < sum(not v[0] for v in verdicts.values()) < 400
