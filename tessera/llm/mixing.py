"""Mixing sources to target weights by iterative proportional fitting (raking).

Documents are summed to cells (source, language, topic). Each marginal has a target: its share of tokens
raised to ``power`` and normalised, times ``keep`` of all tokens, but never above what there is (the rest
goes to the other values). Raking scales the cells' keep probabilities to each marginal in turn, bounded
by 1, until every marginal is within ``tolerance`` of its target. A document is then sampled with its cell's
probability by a hash of its id, so a rerun or a lost task gives the same sample.

Marginals that depend on one another may have targets that no probabilities up to 1 meet. Raking sees that its
largest deviation no longer falls; from there on all marginals are scaled at once, each by a part, so that none
wins by being last. How far each marginal of a document's cell is from its target stands in the result.

Topics are learnt from the texts: spherical k-means over all documents, on hashed counts of their distinct longer
words, less the mean of the document's language, as else languages would be the topics.

Sums are combined map-side, so a source with a third of all rows is no hot group. Cells are raked on the driver
where they are at most ``driver_cells``, and by aggregations and joins of the cells beyond; the rules are the same.
Cells are joined to documents by an equi-join that Spark broadcasts only under its own size threshold.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, apart, map_arrow, texts_as_bytes

DIMS = ("source", "lang", "topic")


@dataclass(frozen=True)
class Mix:
    power: float = 0.8
    keep: float = 0.8
    #: topics, hash buckets of a document's words, shortest word that counts (bytes), rounds of k-means
    topics: int = 8
    buckets: int = 128
    topic_word: int = 6
    topic_rounds: int = 4
    #: largest relative deviation from a target; rounds after which raking gives up; rounds without gain that tell of targets that cannot be met
    tolerance: float = 1e-3
    rounds: int = 500
    patience: int = 10
    driver_cells: int = 200_000
    seed: int = 7


def features(words: list[bytes], p: Mix) -> np.ndarray:
    """Numbers of distinct long words in each hash bucket, as square roots, of length one; texts without any: zeros."""
    long_words = {w.lower() for w in words if len(w) >= p.topic_word}
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, long_words, repeat(p.seed)), np.uint64, len(long_words))
    x = np.sqrt(np.bincount((hashes % np.uint64(p.buckets)).astype(np.int64), minlength=p.buckets))
    return (x / max(float(np.sqrt((x * x).sum())), 1e-9)).astype(np.float32)


@dataclass
class Topics:
    """Centres of the topics and the mean features of each language, which are held by a hash of its name."""

    centres: np.ndarray
    means: dict[str, np.ndarray]

    def less_mean(self, x: np.ndarray, langs: list[str]) -> np.ndarray:
        none = np.zeros(x.shape[1])
        return x - np.array([self.means.get(held(g), none) for g in langs]).reshape(x.shape)

    def of(self, x: np.ndarray, langs: list[str]) -> np.ndarray:
        """The nearest topic of each row of features, the least of equals."""
        return (self.less_mean(x, langs) @ self.centres.T).argmax(1) if len(x) else np.zeros(0, np.int64)


#: Hash values of languages: a bound on the vectors that come to the driver. Languages that share one share a mean.
LANGUAGES = 4096


def held(lang: str) -> str:
    return str(xxhash.xxh64_intdigest(lang) % LANGUAGES)


def described(docs: DataFrame, p: Mix) -> DataFrame:
    """(source, lang, tokens, features) of ``docs`` (source, lang, text), from whole texts."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens, found = [], []
        for t in texts_as_bytes(batch.column(2)):
            words = t.split()
            tokens.append(len(words))
            found.append(features(words, p).astype(np.float16).tobytes())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens, pa.int64()), pa.array(found, pa.binary())], names=["source", "lang", "tokens", "features"])

    return map_arrow(docs, run, "source string, lang string, tokens long, features binary")


def matrix(column: pa.Array, p: Mix) -> np.ndarray:
    """Features as they are stored, so that learning and labelling see the same numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(-1, p.buckets).astype(np.float64)


def summed(rows: DataFrame, f, key: str, p: Mix) -> dict[str, tuple[np.ndarray, int]]:
    """Vector sums and counts by the key that ``f`` gives each row of a batch. A task adds up all its rows first."""

    def run(batches):
        total: dict[str, list] = {}
        for batch in batches:
            x, keys = f(batch)
            keys = np.array(keys, dtype=object)
            for k in pd.unique(keys):
                here = x[keys == k]
                s = total.setdefault(k, [np.zeros(p.buckets), 0])
                s[0] += here.sum(0)
                s[1] += len(here)
        names, sums, counts = list(total), [s[0].tolist() for s in total.values()], [s[1] for s in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array([str(k) for k in names], pa.string()), pa.array(sums, pa.list_(pa.float64())), pa.array(counts, pa.int64())], names=[key, "x", "n"])

    parts = rows.mapInArrow(run, f"{key} string, x array<double>, n long").select(key, F.posexplode("x").alias("i", "v"), "n")
    whole = parts.groupBy(key, "i").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    out: dict[str, tuple[np.ndarray, int]] = {}
    for r in whole.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("x"), F.max("n").alias("n")).collect():
        out[r[key]] = (np.array([v.v for v in r.x]), r.n)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(-1, keepdims=True)), 1e-9)


def learn(rows: DataFrame, p: Mix) -> Topics:
    """Topics of all ``rows`` (lang, features); what comes to the driver is a vector for each language and topic.

    Centres start as fixed random directions.
    """
    rows = rows.select("lang", "features")
    means = {k: np.round(x / max(n, 1), 6) for k, (x, n) in summed(rows, lambda b: (matrix(b.column(1), p), [held(g) for g in b.column(0).to_pylist()]), "of", p).items()}
    model = Topics(unit(np.random.default_rng(p.seed).normal(size=(p.topics, p.buckets))), means)
    for _ in range(p.topic_rounds):

        def place(batch: pa.RecordBatch, model=model):
            x, langs = matrix(batch.column(1), p), batch.column(0).to_pylist()
            return model.less_mean(x, langs), model.of(x, langs)

        found = summed(rows, place, "topic", p)
        # rounded, as the order of sums is not the same in every run
        centres = np.round([found[str(k)][0] if str(k) in found else c for k, c in enumerate(model.centres)], 6)
        model = Topics(np.where((np.abs(centres).sum(1) > 1e-9)[:, None], unit(centres), model.centres), means)
    return model


def labelled(rows: DataFrame, topics: Topics, p: Mix) -> DataFrame:
    """(source, lang, topic, tokens) of described rows."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = topics.of(matrix(batch.column(3), p), batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int32()), batch.column(2)], names=["source", "lang", "topic", "tokens"])

    return map_arrow(rows, run, "source string, lang string, topic int, tokens long")


def annotated(docs: DataFrame, text: str, lang: str, topics: Topics, p: Mix, prefix: str) -> DataFrame:
    """``docs`` with topic and tokens under names that begin with ``prefix``, from whole texts."""
    columns = docs.columns
    at, by = columns.index(text), columns.index(lang)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens, found = [], []
        for t in texts_as_bytes(batch.column(at)):
            words = t.split()
            tokens.append(len(words))
            found.append(features(words, p).astype(np.float16))
        x = np.array(found, np.float64).reshape(-1, p.buckets)
        made = [pa.array(topics.of(x, batch.column(by).to_pylist()), pa.int32()), pa.array(tokens, pa.int64())]
        return pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*columns, f"{prefix}topic", f"{prefix}tokens"])

    return map_arrow(docs, run, T.StructType([*docs.schema.fields, T.StructField(f"{prefix}topic", T.IntegerType()), T.StructField(f"{prefix}tokens", T.LongType())]))


# Targets and raking: on the driver with pandas, and beyond driver_cells with DataFrames


def water(there: np.ndarray, wanted: np.ndarray, total: float) -> np.ndarray:
    """``wanted`` scaled to add up to ``total``, where no value is above what is there."""
    full = np.zeros(len(there), bool)
    while True:
        scale = max(total - there[full].sum(), 0) / max(wanted[~full].sum(), 1e-300)
        over = ~full & (wanted * scale >= there)
        if not over.any():
            return np.where(full, there, wanted * scale)
        full |= over


def targets(cells: DataFrame, dim: str, total: float, p: Mix) -> DataFrame:
    """(dim, target): tokens wanted for each value, at most what there is."""
    marginal = cells.groupBy(dim).agg(F.sum("tokens").alias("there")).where("there > 0").withColumn("want", F.pow(F.col("there") / F.lit(total), F.lit(p.power)))
    scale = 0.0
    while True:
        # values that are full stay full, so the scale grows to a fixed point
        full = F.col("want") * F.lit(scale) >= F.col("there")
        used, free = marginal.agg(F.sum(F.when(full, F.col("there")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("want")))).first()
        if not free or (new := (p.keep * total - used) / free) <= scale * (1 + 1e-12):
            break
        scale = new
    return marginal.select(dim, F.least(F.col("want") * F.lit(scale), F.col("there").cast("double")).alias("target"))


class Stop:
    """When to stop: within tolerance, after all rounds, or when sharing what cannot be met gains no more."""

    def __init__(self, p: Mix):
        self.p, self.n, self.best, self.since, self.shared = p, 0, float("inf"), 0, False

    def __call__(self, off: float) -> bool:
        self.n += 1
        if off <= self.p.tolerance or self.n >= self.p.rounds:
            return True
        if off < 0.99 * self.best:
            self.best, self.since = off, 0
            return False
        self.since += 1
        if self.since < self.p.patience:
            return False
        if self.shared:
            return True
        self.shared, self.best, self.since = True, float("inf"), 0
        return False


def rake_here(cells: pd.DataFrame, p: Mix) -> pd.DataFrame:
    """``cells`` (source, lang, topic, tokens) with probability and, for each dimension, how far its marginal is off."""
    tokens = cells["tokens"].to_numpy(float)
    total, probability = tokens.sum(), np.full(len(cells), p.keep)
    places, wanted = [], []
    for d in DIMS:
        place, _ = pd.factorize(cells[d])
        there = np.bincount(place, tokens)
        places.append(place)
        wanted.append(water(there, np.where(there > 0, (there / total) ** p.power, 0), p.keep * total))

    def ratios(k: int) -> np.ndarray:
        have = np.bincount(places[k], tokens * probability, len(wanted[k]))
        return np.divide(wanted[k], have, out=np.ones(len(have)), where=have > 0)

    stop = Stop(p)
    while not stop(max(float(np.abs(1 / r - 1).max()) for r in map(ratios, range(len(DIMS))))):
        if stop.shared:
            both = np.prod([ratios(k)[places[k]] for k in range(len(DIMS))], axis=0) ** (1 / len(DIMS))
            probability = np.minimum(1.0, probability * both)
        else:
            for k in range(len(DIMS)):
                probability = np.minimum(1.0, probability * ratios(k)[places[k]])
    out = cells.assign(probability=probability)
    for k, d in enumerate(DIMS):
        out[f"{d}_off"] = (1 / ratios(k) - 1)[places[k]]
    return out


def rake_there(cells: DataFrame, total: float, p: Mix, scratch: Scratch) -> DataFrame:
    """The same by aggregations and joins."""
    wanted = {d: scratch.write(targets(cells, d, total, p)) for d in DIMS}

    def rated(df: DataFrame, dims) -> DataFrame:
        for d in dims:
            have = df.groupBy(d).agg(F.sum(F.col("tokens") * F.col("probability")).alias("have"))
            ratio = have.join(wanted[d], d).select(d, F.when(F.col("have") > 0, F.col("target") / F.col("have")).otherwise(1.0).alias(f"r_{d}"))
            df = df.join(ratio, d, "left").fillna(1.0, [f"r_{d}"])
        return df

    now, stop = cells.withColumn("probability", F.lit(p.keep)), Stop(p)
    every = [f"r_{d}" for d in DIMS]
    while True:
        now, before = scratch.write(rated(now, DIMS)), now
        if hasattr(before, "_scratch_path"):
            scratch.drop(before)
        if stop(now.agg(F.max(F.greatest(*(F.abs(1 / F.col(r) - 1) for r in every)))).first()[0]):
            break
        if stop.shared:
            both = F.pow(F.col(every[0]) * F.col(every[1]) * F.col(every[2]), F.lit(1 / len(DIMS)))
            step = now.withColumn("probability", F.least(F.lit(1.0), F.col("probability") * both)).drop(*every)
        else:
            step = now.withColumn("probability", F.least(F.lit(1.0), F.col("probability") * F.col(every[0]))).drop(*every)
            for d in DIMS[1:]:
                step = rated(step, [d]).withColumn("probability", F.least(F.lit(1.0), F.col("probability") * F.col(f"r_{d}"))).drop(f"r_{d}")
        step = scratch.write(step)
        scratch.drop(now)
        now = step
    return now.select(*DIMS, "tokens", "probability", *((1 / F.col(f"r_{d}") - 1).alias(f"{d}_off") for d in DIMS))


CELL = "source string, lang string, topic int, tokens long, probability double, source_off double, lang_off double, topic_off double"


def rake(docs: DataFrame, p: Mix, scratch: Scratch) -> DataFrame:
    """Cells with their probability and their marginals' deviations. ``docs``: source, lang, topic, tokens."""
    cells = scratch.write(docs.groupBy(*DIMS).agg(F.sum("tokens").alias("tokens")))
    total, n = cells.agg(F.sum("tokens"), F.count("*")).first()
    if not total:
        return cells.select(*DIMS, "tokens", F.lit(p.keep).alias("probability"), *(F.lit(0.0).alias(f"{d}_off") for d in DIMS))
    if n > p.driver_cells:
        return rake_there(cells, float(total), p, scratch)
    # in a fixed order, so that sums and with them the sample are the same again
    raked = rake_here(cells.toPandas().sort_values(list(DIMS), ignore_index=True), p)
    return scratch.write(cells.sparkSession.createDataFrame(raked, CELL))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", p: Mix | None = None, keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """``keep`` columns (default: the id) and, under names that begin with ``prefix``: source_key, lang_key, topic, n_tokens,
    probability, selected, and source_off, lang_off, topic_off, the relative deviation from the target of the
    expected tokens of the row's source, language and topic.

    Null source or language: a value of its own, the empty text. Null text: as empty, no tokens; such rows
    are sampled with their cell's probability. Repeated rows share one decision (it is by id; null ids are
    one id). Very long texts are read whole and count as what they hold. Ties between topics go to the first. Empty
    table: no rows. Extra columns are carried only if in ``keep``; a ``prefix`` sets the results apart from them.
    """
    p, keep = p or Mix(), keep or [doc_id]
    scratch = Scratch(docs.sparkSession, "mixing")
    columns = list(dict.fromkeys([*keep, doc_id, source, lang, text]))
    x = apart(columns)
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = scratch.write(described(docs.select(key(source).alias("source"), key(lang).alias("lang"), F.col(text).alias("text")), p))
    topics = learn(rows, p)
    cells = rake(labelled(rows, topics, p), p, scratch)
    full = docs.select(*columns).withColumn(f"{x}source", key(source)).withColumn(f"{x}lang", key(lang))
    full = annotated(full, text, f"{x}lang", topics, p, x)
    names = ["source", "lang", "topic", "probability", *(f"{d}_off" for d in DIMS)]
    cells = cells.select(*(F.col(c).alias(f"{x}of_{c}") for c in names))
    same = (F.col(f"{x}source") == F.col(f"{x}of_source")) & (F.col(f"{x}lang") == F.col(f"{x}of_lang")) & (F.col(f"{x}topic") == F.col(f"{x}of_topic"))
    draw = F.pmod(F.xxhash64(F.lit(p.seed), F.col(doc_id)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    made = {"source_key": F.col(f"{x}source"), "lang_key": F.col(f"{x}lang"), "topic": F.col(f"{x}topic"), "n_tokens": F.col(f"{x}tokens"), "probability": F.col(f"{x}of_probability"), "selected": draw < F.col(f"{x}of_probability")}
    made |= {f"{d}_off": F.col(f"{x}of_{d}_off") for d in DIMS}
    return full.join(cells, same).select(*keep, *(c.alias(prefix + n) for n, c in made.items()))
