import random
import zlib

import numpy as np
import pytest

from tessera.llm import toxicity

from .helpers import AWKWARD, docs

SMALL = toxicity.Settings(buckets=1 << 14, epochs=2, sample=800)


def corpus(n, seed):
    rng = random.Random(seed)
    texts, labels = [], []
    for _ in range(n):
        w = ["".join(rng.choice(["ba", "ko", "ri", "tu", "sen", "mol"]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(20, 80))]
        bad = rng.random() < 0.2
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), "zlagh" + rng.choice(["ba", "ko", "ri", "tu", "sen"]))
        texts.append(" ".join(w))
        labels.append(int(bad))
    return texts, labels


@pytest.fixture(scope="module")
def model():
    texts, labels = corpus(500, 1)
    return toxicity.train(texts, labels, ["en" if i % 2 else "de" for i in range(500)], SMALL)


def test_held_out_accuracy_by_prefix(model):
    texts, labels = corpus(400, 2)
    score = toxicity.Scorer(model).scores(texts)
    assert ((score >= 0.5) == np.array(labels)).mean() > 0.97
    assert set(model.thresholds) == {"", "en", "de"}


def test_score_is_of_the_whole_text(model):
    filler = "ba ko ri " * 40_000
    clean, late = toxicity.Scorer(model).scores([filler, filler + "zlaghba x zlaghri y zlaghsen"])
    assert clean < 0.5 < late


def test_batching_does_not_matter(model):
    texts, _ = corpus(30, 4)
    alone = [float(toxicity.Scorer(model).scores([t])[0]) for t in texts]
    assert np.allclose(toxicity.Scorer(model).scores(texts), alone, atol=1e-6)


def test_awkward_rows(spark, model):
    rows = toxicity.score(docs(spark, AWKWARD, {3: None}), model).collect()
    assert len(rows) == len(AWKWARD)
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert toxicity.score(docs(spark, []), model).count() == 0


def test_sample_leaves_held_out_rows(spark):
    d = docs(spark, {i: f"text {i}" for i in range(100)})
    labels = spark.createDataFrame([(i, i % 2 if i % 7 else None, "x") for i in range(100)] + [(3, 1, "x"), (None, 1, "x")], "doc_id long, toxic int, text string")
    got = toxicity.sample(d, labels, toxicity.Settings())
    ids = {int(t.split()[1]) for t, _, _ in got}
    assert ids == {i for i in range(100) if i % 7 and zlib.crc32(str(i).encode()) % 5}
    assert len(toxicity.sample(d, labels, toxicity.Settings(sample=10))) == 10


def test_too_few_labels():
    m = toxicity.train(["a b", "c d"], [0, 0], [None, None], SMALL)
    assert 0 < toxicity.Scorer(m).scores(["x"])[0] < 0.5
    assert toxicity.train([], [], [], SMALL).thresholds == {}


def plain_logit(model, text):
    """The network by loops: mean-scaled bucket embeddings, each filter at each place, the peak, rectified, weighted."""
    s, found = model.s, []
    for w in text.lower().split() or [""]:
        buckets = toxicity.parts(w, s) if w else []
        found.append(sum((model.emb[b] for b in buckets), np.zeros(s.size)) / np.sqrt(max(len(buckets), 1)))
    logit, unit = model.shift, 0
    for width in s.widths:
        for f in range(s.filters):
            responses = []
            for at in range(len(found)):
                total = model.bias[width][f]
                for j in range(width):
                    if at + j < len(found):
                        total += float(found[at + j] @ model.conv[width][j][:, f])
                responses.append(total)
            logit += max(max(responses), 0) * model.out[unit]
            unit += 1
    return logit


def test_forward_pass_against_plain_convolution():
    rng = np.random.default_rng(3)
    s = toxicity.Settings(buckets=512, step=7)
    model = toxicity.Model(s, rng.normal(size=(s.buckets + 1, s.size)), {w: rng.normal(size=(w, s.size, s.filters)) for w in s.widths}, {w: rng.normal(size=s.filters) for w in s.widths}, rng.normal(size=len(s.widths) * s.filters), 0.3)
    model.emb[s.buckets] = 0
    texts = ["", "one", "two words", "Some, longer text! With (signs) and twenty or more words in it so that it is cut into several segments of seven words each.", "--- !!", "same " * 40]
    got = toxicity.Scorer(model).logits(texts)
    assert got.tolist() == pytest.approx([plain_logit(model, t) for t in texts], abs=1e-3)
