"""Toxicity by a convolutional text classifier, trained in numpy.

A word's embedding is the scaled sum of hashed embeddings of the word, its prefixes and its ending. Filters of widths 1 to 3 run over the words of the whole text, are max-pooled and rectified, and a
linear layer gives the logit. The first embedding dimension starts at smoothed log odds of each hash bucket.

Training uses a bounded sample of labelled rows on the driver. Two halves each score the other; these
out-of-fold logits fit the calibration (so that 0.5 is the even point) and a threshold for each language.
Scoring is one Arrow map over the documents; the model, of a size fixed by its parameters, goes with it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc32_mod, map_arrow

EDGE = re.compile(r"^[\W_]+|[\W_]+$")
PREFIXES = (3, 4, 5, 6)


@dataclass(frozen=True)
class Settings:
    """``sample``: most labelled rows to learn from; ``sample_bytes``: longest text among them."""

    sample: int = 4000
    sample_bytes: int = 65_536
    buckets: int = 1 << 18
    parts: int = 6
    size: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 4
    prior: float = 8.0
    least_docs: int = 3
    epochs: int = 3
    batch: int = 64
    rate: float = 0.05
    decay: float = 1e-4
    seed: int = 5
    least_toxic: int = 20
    cache: int = 400_000
    step: int = 50_000


def parts(word: str, s: Settings) -> list[int]:
    """Hash buckets of a word without its outer signs: itself, its first 3 to 6 letters, its last 4."""
    w = word if word.isalpha() else EDGE.sub("", word)
    if not w:
        return []
    grams = ["=" + w, *(w[:k] for k in PREFIXES if len(w) >= k)]
    if len(w) > 4:
        grams.append("~" + w[-4:])
    return [xxhash.xxh32_intdigest(g) % s.buckets for g in grams]


def words_of(text: str) -> list[str]:
    return text.lower().split()


@dataclass
class Model:
    """Embeddings (last row: none), filters by width and offset, output layer, calibration and thresholds."""

    s: Settings
    emb: np.ndarray
    conv: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    out: np.ndarray
    shift: float
    scale: float = 1.0
    offset: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def stacked(self) -> np.ndarray:
        """All filters at all offsets as one matrix (size, sum of width * filters)."""
        return np.concatenate([self.conv[w][j] for w in self.s.widths for j in range(w)], axis=1)


def vectors(model: Model, found: np.ndarray) -> np.ndarray:
    """Word vectors of rows of bucket numbers (``buckets`` where there is none)."""
    n = (found < model.s.buckets).sum(1, keepdims=True)
    return model.emb[found].sum(1) / np.sqrt(np.maximum(n, 1))


def bucket_rows(words, s: Settings) -> np.ndarray:
    out = np.full((len(words), s.parts), s.buckets, np.int32)
    for i, w in enumerate(words):
        p = parts(w, s)
        out[i, : len(p)] = p
    return out


def pooled(model: Model, rows: np.ndarray, begin: np.ndarray, real: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each width the filter responses and their peak in each segment.

    ``rows``: stacked products of the words of all segments, each segment followed by padding rows; ``begin``:
    where segments begin; ``real``: not padding.
    """
    s, at, out = model.s, 0, []
    for w in s.widths:
        total = rows[:, at : at + s.filters] + model.bias[w].astype(rows.dtype)
        for j in range(1, w):
            total[:-j] += rows[j:, at + j * s.filters : at + (j + 1) * s.filters]
        at += w * s.filters
        total[~real] = -np.inf
        out.append((total, np.maximum.reduceat(total, begin, axis=0)))
    return out


def laid_out(segments: list[np.ndarray], pad: int, none: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments one after the other, each followed by ``pad`` times ``none``; where they begin; which places are real."""
    n = np.array([len(x) for x in segments])
    begin = np.cumsum(n + pad) - (n + pad)
    flat, real = np.full(int((n + pad).sum()), none, np.int64), np.zeros(int((n + pad).sum()), bool)
    for b, x in zip(begin.tolist(), segments, strict=True):
        flat[b : b + len(x)] = x
        real[b : b + len(x)] = True
    return flat, begin, real


class Scorer:
    """Scores whole texts with a cache of the filters' products for each word."""

    def __init__(self, model: Model):
        self.m, self.mat = model, model.stacked().astype(np.float32)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.rows, self.used = np.zeros((1024, self.mat.shape[1]), np.float32), 1

    def place(self, words: list[str]) -> np.ndarray:
        try:
            return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        except KeyError:
            pass
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if self.used + len(new) > self.m.s.cache:
            self.clear()
            new = [w for w in dict.fromkeys(words) if w]
        made = (vectors(self.m, bucket_rows(new, self.m.s)) @ self.mat).astype(np.float32)
        need = self.used + len(new)
        if need > len(self.rows):
            self.rows = np.concatenate([self.rows[: self.used], np.zeros((2 * need - self.used, self.rows.shape[1]), np.float32)])
        self.rows[self.used : need] = made
        self.known.update(zip(new, range(self.used, need), strict=True))
        self.used = need
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def peaks(self, segments: list[list[str]]) -> np.ndarray:
        flat = self.place([w for x in segments for w in x])
        cuts = np.cumsum([len(x) for x in segments])[:-1]
        at, begin, real = laid_out(np.split(flat, cuts), max(self.m.s.widths) - 1, 0)
        return np.concatenate([p for _, p in pooled(self.m, self.rows[at], begin, real)], axis=1)

    def logits(self, texts: list[str]) -> np.ndarray:
        """Texts longer than a step are pooled in overlapping segments; pooling takes the peak over all."""
        s, best = self.m.s, np.full((len(texts), len(self.m.out)), -np.inf)
        segments, owner, held = [], [], 0

        def flush() -> None:
            np.maximum.at(best, owner, self.peaks(segments))

        for i, t in enumerate(texts):
            words = words_of(t) or [""]
            for k in range(0, len(words), s.step):
                segments.append(words[k : k + s.step + max(s.widths) - 1])
                owner.append(i)
                held += len(segments[-1])
                if held >= s.step:
                    flush()
                    segments, owner, held = [], [], 0
        if segments:
            flush()
        return np.maximum(best, 0) @ self.m.out + self.m.shift

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.m.scale * self.logits(texts) + self.m.offset, -30, 30)))


def fit(texts: list[str], y: np.ndarray, s: Settings) -> Model:
    """Train on texts with labels 0 and 1."""
    rng = np.random.default_rng(s.seed)
    docs = [words_of(t) or [""] for t in texts]
    vocab = {"": 0}
    ids = [np.fromiter((vocab.setdefault(w, len(vocab)) for w in d), np.int64, len(d)) for d in docs]
    table = bucket_rows(list(vocab), s)
    seen = np.zeros((2, s.buckets + 1))
    for d, label in zip(ids, y, strict=True):
        seen[int(label), np.unique(table[np.unique(d)])] += 1
    rate = (y.sum() + 0.5) / (len(y) + 1)
    odds = np.log((seen[1] + s.prior * rate) / (seen[0] + s.prior * (1 - rate))) - np.log(rate / (1 - rate))
    odds[seen.sum(0) < s.least_docs] = 0
    emb = rng.normal(0, 0.02, (s.buckets + 1, s.size))
    emb[:, 0] = odds
    emb[-1] = 0
    conv = {w: rng.normal(0, 0.05, (w, s.size, s.filters)) for w in s.widths}
    for w in s.widths:
        conv[w][:, 0, 0] = 1.0 / w
    m = Model(s, emb, conv, {w: np.zeros(s.filters) for w in s.widths}, rng.normal(0, 0.05, len(s.widths) * s.filters), -3.0)
    m.out[:: s.filters] = 0.6
    pad, eps = max(s.widths) - 1, 1e-8
    power = {"out": np.zeros_like(m.out), "shift": 0.0, "emb": np.zeros(len(emb)), **{("c", w): np.zeros_like(conv[w]) for w in s.widths}, **{("b", w): np.zeros(s.filters) for w in s.widths}}
    weight = np.sqrt(np.where(y == 1, 0.5 / max(rate, 1e-3), 0.5 / max(1 - rate, 1e-3)))
    for _ in range(s.epochs):
        order = rng.permutation(len(ids))
        for i in range(0, len(order), s.batch):
            some = order[i : i + s.batch]
            at, begin, real = laid_out([ids[k] for k in some], pad, len(vocab))
            used, mine = np.unique(at, return_inverse=True)
            words = used[:-1]
            vec = np.concatenate([vectors(m, table[words]), np.zeros((1, s.size))])
            found = pooled(m, (vec @ m.stacked())[mine], begin, real)
            high = np.concatenate([p for _, p in found], axis=1)
            h = np.maximum(high, 0)
            g = weight[some] * (1 / (1 + np.exp(-np.clip(h @ m.out + m.shift, -30, 30))) - y[some]) / len(some)
            g_out, g_shift, g_vec = h.T @ g, float(g.sum()), np.zeros_like(vec)
            back = (g[:, None] * m.out * (high > 0)).reshape(len(some), len(s.widths), s.filters)
            number = np.arange(len(mine))[:, None]
            lengths = np.diff(np.r_[begin, len(mine)])
            grads = [("out", g_out + s.decay * m.out, m.out)]
            for n, (w, (total, peak)) in enumerate(zip(s.widths, found, strict=True)):
                b = back[:, n]
                first = np.minimum.reduceat(np.where(total == np.repeat(peak, lengths, axis=0), number, len(mine) - 1), begin, axis=0)
                g_c = np.zeros_like(conv[w])
                for j in range(w):
                    word = mine[np.minimum(first + j, len(mine) - 1)]
                    for f in range(s.filters):
                        g_c[j][:, f] = vec[word[:, f]].T @ b[:, f]
                        np.add.at(g_vec, word[:, f], b[:, f, None] * conv[w][j][:, f])
                grads += [(("c", w), g_c + s.decay * conv[w], conv[w]), (("b", w), b.sum(0), m.bias[w])]
            touched = np.flatnonzero(np.abs(g_vec[:-1]).sum(1))
            rows = table[words[touched]]
            n_parts = np.sqrt(np.maximum((rows < s.buckets).sum(1), 1))
            buckets, which = np.unique(rows.ravel(), return_inverse=True)
            g_emb = np.zeros((len(buckets), s.size))
            np.add.at(g_emb, which, np.repeat(g_vec[touched] / n_parts[:, None], s.parts, axis=0))
            power["emb"][buckets] += (g_emb**2).mean(1)
            emb[buckets] -= s.rate * g_emb / np.sqrt(power["emb"][buckets] + eps)[:, None]
            emb[-1] = 0
            for key, grad, value in grads:
                power[key] += grad**2
                value -= s.rate * grad / np.sqrt(power[key] + eps)
            power["shift"] += g_shift**2
            m.shift -= s.rate * g_shift / np.sqrt(power["shift"] + eps)
    m.emb = m.emb.astype(np.float32)
    return m


def calibrate(logits: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and offset of a logistic curve through logits, by Newton steps with a weak prior."""
    z = (logits - logits.mean()) / (logits.std() + 1e-9)
    x, beta = np.c_[z, np.ones(len(z))], np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + np.diag([0.05, 1e-3])
        beta -= np.linalg.solve(h, x.T @ (p - y) + np.array([0.05, 1e-3]) * beta)
    scale = max(beta[0], 1e-6) / (logits.std() + 1e-9)
    return float(scale), float(beta[1] - scale * logits.mean())


def best_threshold(score: np.ndarray, y: np.ndarray) -> float:
    """Midway between neighbours at the highest F1; ties to the one nearest 0.5."""
    order = np.argsort(-score, kind="stable")
    s, hit = score[order], np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(s) + 1) + y.sum())
    cut = (s + np.r_[s[1:], 0.0]) / 2
    good = np.flatnonzero((f1 >= f1.max() - 1e-12) & (s > np.r_[s[1:], -1.0]))
    return float(cut[good[np.argmin(np.abs(cut[good] - 0.5))]]) if len(good) else 0.5


def train(texts: list[str], labels, langs: list[str | None], s: Settings | None = None) -> Model:
    """A calibrated model. With fewer than two rows of either label, a model that scores the label's rate."""
    s, y = s or Settings(), np.asarray(labels, np.float64)
    if len(y) == 0 or min(y.sum(), len(y) - y.sum()) < 2:
        m = Model(s, np.zeros((s.buckets + 1, s.size), np.float32), {w: np.zeros((w, s.size, s.filters)) for w in s.widths}, {w: np.zeros(s.filters) for w in s.widths}, np.zeros(len(s.widths) * s.filters), 0.0)
        rate = (y.sum() + 0.1) / (len(y) + 1)
        m.offset = float(np.log(rate / (1 - rate)))
        return m
    half = np.zeros(len(y), int)
    for label in (0, 1):
        at = np.flatnonzero(y == label)
        half[at] = np.arange(len(at)) % 2
    logits = np.zeros(len(y))
    for h in (0, 1):
        inside, outside = np.flatnonzero(half != h), np.flatnonzero(half == h)
        scorer = Scorer(fit([texts[i] for i in inside], y[inside], s))
        logits[outside] = scorer.logits([texts[i] for i in outside])
    m = fit(texts, y, s)
    m.scale, m.offset = calibrate(logits, y)
    score = 1 / (1 + np.exp(-np.clip(m.scale * logits + m.offset, -30, 30)))
    m.thresholds[""] = best_threshold(score, y)
    for lang in sorted({x for x in langs if x}):
        mine = np.array([x == lang for x in langs])
        if y[mine].sum() >= s.least_toxic:
            m.thresholds[lang] = best_threshold(score[mine], y[mine])
    return m


def sample(docs: DataFrame, labels: DataFrame, s: Settings, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic", fold: int = 5) -> list:
    """At most ``sample`` labelled training rows, picked by a hash of the id: (text, label, lang)."""
    known = labels.select(F.col(doc_id).alias("__id"), F.col(label).alias("__label")).where("__id IS NOT NULL AND __label IN (0, 1)")
    known = known.where(crc32_mod("__id", fold) != 0).groupBy("__id").agg(F.max("__label").alias("__label"))
    picked = known.orderBy(F.xxhash64("__id"), "__id").limit(s.sample)
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("t"), F.col(lang).alias("l")).where(F.octet_length("t") <= s.sample_bytes)
    # `picked` has at most `sample` rows of two numbers, whatever the input
    rows = rows.join(F.broadcast(picked), "__id").groupBy("__id").agg(F.min(F.struct("t", "__label", "l")).alias("r"))
    return [(r.t, r["__label"], r.l) for r in rows.orderBy("__id").select("r.*").collect()]


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", fold: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted, threshold, flagged) of each row.

    ``predicted``: score at least 0.5. ``flagged``: score at least the language's own threshold (the overall
    one for null and rare languages). The score uses the text alone. Null or empty text: the score of a text
    without words. Repeated rows score alike. Empty table: no rows. Very long texts are read whole.
    """
    part = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    part = part.select("doc_id", "text", "lang", (crc32_mod("doc_id", fold) == 0).alias("held_out"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scorers: dict[int, Scorer] = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scorer = scorers.get(0) or scorers.setdefault(0, Scorer(shared.value))
        found = scorer.scores([t or "" for t in batch.column(1).to_pylist()])
        limits = scorer.m.thresholds
        limit = np.array([limits.get(x or "", limits.get("", 0.5)) for x in batch.column(2).to_pylist()], np.float64)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(found), pa.array((found >= 0.5).astype(np.int32)), pa.array(limit), pa.array(found >= limit)], names=["doc_id", "held_out", "score", "predicted", "threshold", "flagged"])

    made = T.StructType.fromDDL("held_out boolean, score double, predicted int, threshold double, flagged boolean")
    return map_arrow(part, run, T.StructType([part.schema["doc_id"], *made.fields]))
