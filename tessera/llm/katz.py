"""Katz backoff language model of words, trained on the corpus and stored in partitioned tables.

P(w | h) is the Good-Turing discounted share of (h, w) if it was seen, else the backoff weight of h times
P(w | h without its first word); at the end of the recursion P(w) is discounted likewise, and what it leaves is
shared by as many unseen words as words were seen once. Backoff weights make every history's probabilities sum
to one. A text is its words, A-Z lower-cased, and one end; begin marks stand before the first word. The order
(longest n-gram) is a parameter. Words and n-grams are kept as 64-bit hashes.

Texts are read once and held as chunks of about ``chunk`` tokens: the chunk's distinct words and its tokens as
places among them. All that follows are questions of chunks to shards and the answers:

1. For each level n a chunk asks every shard (a range of hashes) for its distinct n-grams, and tells how often its
   training texts hold them. A question is one row: sorted hashes and counts, as zstandard byte planes.
2. A shard adds the counts up, keeps them as a row of the n-gram table, and answers each chunk with the counts in
   the order of its question. Of the chunks that share an n-gram, one is told to own it.
3. Owners add up, for each history, the discounted counts and lower probabilities of what follows it; shards
   of histories keep those sums and answer with backoff weights.
4. Chunks evaluate the recursion for each token and add up each text.

What a shard holds of an n-gram is one entry for each chunk, however often texts have it, and hashes are even, so
frequent words make no hot shard. Shards are as many as keep ``shard`` tokens to each; chunks and shards are bounded.

Tables, in the shared folder as Parquet partitioned by ``part`` and ``level``, a row for each shard:
  n-grams (level, shard, keys, x: counts), histories (level, shard, keys, x: counts, y: types of each small count that
  follow, z: sums of lower probabilities).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Scratch, crc32_mod, map_arrow, texts_as_bytes
from .shards import by_shard, dealt, expand, expand_keys, first_chunk, shard_bits, squeeze, squeeze_keys

#: Hashes set aside for the end of a text and for its begin mark.
END, BEGIN = 0, 1
#: Counts above this are not discounted.
MOST = 5
#: Chunks of one task where they meet their answers.
CHUNKS = 2
M1, M2, M3 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9


@dataclass(frozen=True)
class Settings:
    """``order``: words of the longest n-gram. ``chunk``, ``shard``: tokens of one chunk, and for each shard."""

    order: int = 2
    chunk: int = 1 << 20
    shard: int = 1 << 21


def joined(history, word):
    """The key of the n-gram of a history and one more word."""
    with np.errstate(over="ignore"):
        x = history * np.uint64(M1) + word * np.uint64(M2) + np.uint64(M3)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(M3)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(M1)
        return x ^ (x >> np.uint64(32))


@dataclass
class Discount:
    """Good-Turing ratios of counts 1 to MOST, from the numbers of types with each count."""

    types: dict[int, int]
    ratio: dict[int, float] = field(default_factory=dict)

    def __post_init__(self):
        n = lambda r: self.types.get(r, 0)
        beyond = (MOST + 1) * n(MOST + 1) / n(1) if n(1) else 1.0
        for r in range(1, MOST + 1):
            d = ((r + 1) * n(r + 1) / (r * n(r)) - beyond) / (1 - beyond) if n(r) and beyond < 1 else 1.0
            self.ratio[r] = d if 0 < d < 1 else 1.0

    def of(self, c: np.ndarray) -> np.ndarray:
        """The discounted counts."""
        ratios = np.array([1.0, *(self.ratio[r] for r in range(1, MOST + 1)), 1.0])
        return c * ratios[np.minimum(c, MOST + 1)]


@dataclass
class Katz:
    """The model: its tables, and by level its discounts; totals of the words."""

    settings: Settings
    bits: int
    grams: DataFrame
    discounts: list[Discount]
    tokens: int
    vocabulary: int
    total: float
    unseen: float
    histories: list[DataFrame] = field(default_factory=list)

    def numbers(self) -> Numbers:
        return Numbers(self.discounts, self.tokens, self.vocabulary, self.total, self.unseen)


@dataclass
class Numbers:
    """What a task needs of the model besides answers."""

    discounts: list[Discount]
    tokens: int
    vocabulary: int
    total: float
    unseen: float


# Chunks


def chunked(docs: DataFrame, p: Settings) -> DataFrame:
    """Chunks of ``docs`` (id, held, text): chunk, ids, held, sizes (tokens of each text), words (hashes), at (token's word)."""

    def run(batches):
        chunk, ids, held, texts, size = first_chunk(), [], [], [], 0

        def flush():
            tokens = np.concatenate(texts)
            words, at = np.unique(tokens, return_inverse=True)
            sizes = np.array([len(t) for t in texts], np.int64)
            columns = [pa.array([chunk]), pa.array([ids], pa.list_(kind)), pa.array([held], pa.list_(pa.bool_())), *(pa.array([x], pa.binary()) for x in (squeeze(sizes), squeeze_keys(words), squeeze(at.astype(np.uint32))))]
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "ids", "held", "sizes", "words", "at"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for i, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_as_bytes(batch.column(2)), strict=True):
                words = text.lower().split()
                tokens = np.zeros(len(words) + 1, np.uint64)
                tokens[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
                ids.append(i)
                held.append(h)
                texts.append(tokens)
                size += len(tokens)
                if size >= p.chunk:
                    yield flush()
                    chunk, ids, held, texts, size = chunk + 1, [], [], [], 0
        if texts:
            yield flush()

    kind_of_id = docs.schema[0].dataType.simpleString()
    return docs.mapInArrow(run, f"chunk long, ids array<{kind_of_id}>, held array<boolean>, sizes binary, words binary, at binary")


class Chunk:
    """The tokens of a chunk with the n-grams that end at each."""

    def __init__(self, row: dict, order: int):
        self.row = row
        self.sizes = expand(row["sizes"], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        words, at = expand_keys(row["words"]), expand(row["at"], np.uint32).astype(np.int64)
        tokens = words[at]
        #: by level: distinct keys, each token's place among them; and the same of histories
        self.keys, self.place = [None, words], [None, at]
        self.history_keys, self.history_place = [None, None], [None, None]
        keys, marks = tokens, np.array([BEGIN], np.uint64)
        for _ in range(2, order + 1):
            history = np.r_[marks, keys[:-1]]
            history[self.first] = marks[0]
            keys = joined(history, tokens)
            for x, distinct, place in ((keys, self.keys, self.place), (history, self.history_keys, self.history_place)):
                d, i = np.unique(x, return_inverse=True)
                distinct.append(d)
                place.append(i)
            marks = joined(marks, np.array([BEGIN], np.uint64))
        self.counts: dict[int, np.ndarray] = {}
        self.own: dict[int, np.ndarray] = {}
        self.whole: dict[int, np.ndarray] = {}
        self.backoff: dict[int, np.ndarray] = {}
        for a in sorted(row.get("answers") or [], key=lambda a: a["shard"]):
            n = a["level"]
            if n > 0:
                c = expand(a["x"], np.int64)
                self.put(self.counts, n, c)
                self.put(self.own, n, np.unpackbits(np.frombuffer(a["y"], np.uint8), count=len(c)).astype(bool))
            else:
                self.put(self.whole, -n, np.log10(expand(a["x"], np.int64)))
                self.put(self.backoff, -n, expand(a["y"], np.float64))
        for of in (self.counts, self.own, self.whole, self.backoff):
            for n in of:
                of[n] = np.concatenate(of[n])

    def history_questions(self, n: int, bits: int, c: np.ndarray, types: np.ndarray, p: np.ndarray) -> list[dict]:
        """Questions of the histories of level ``n``, under the level ``-n``: sums to add, and whose backoff weight some token needs."""
        keys = self.history_keys[n]
        need = np.zeros(len(keys), np.uint8)
        need[self.history_place[n][self.counts[n][self.place[n]] == 0]] = 1
        row = {"level": -n, "chunk": self.row["chunk"]}
        return [row | {"shard": s, "keys": squeeze_keys(keys[i]), "x": squeeze(c[i]), "y": squeeze(types[:, i].ravel()), "z": squeeze(p[i]), "need": squeeze(need[i])} for s, i in by_shard(keys, bits)]

    @staticmethod
    def put(of: dict, n: int, x: np.ndarray) -> None:
        of.setdefault(n, []).append(x)

    def log_p(self, n: int, at: np.ndarray, m: Numbers) -> np.ndarray:
        """log10 P of the tokens at these places, given the n - 1 words before each."""
        c = self.counts[n][self.place[n][at]]
        seen = c > 0
        with np.errstate(divide="ignore"):
            kept = np.log10(m.discounts[n].of(c))
        if n == 1:
            return np.where(seen, kept - math.log10(m.total), m.unseen)
        h = self.history_place[n][at]
        return np.where(seen, kept - self.whole[n][h], self.backoff[n][h] + self.log_p(n - 1, at, m))


def each_chunk(chunks: DataFrame, order: int, f, schema) -> DataFrame:
    """``f`` of each Chunk: a list of rows of ``schema``, as dictionaries."""

    def run(batch: pa.RecordBatch):
        for i in range(batch.num_rows):
            rows = f(Chunk(batch.slice(i, 1).to_pylist()[0], order))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, kind)

    kind = to_arrow_schema(T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)
    return map_arrow(chunks, run, schema)


# Questions and answers

QUESTION = "level int, shard int, chunk long, keys binary, x binary, y binary, z binary, need binary"
ANSWER = "part string, level int, shard int, chunk long, keys binary, x binary, y binary, z binary, types array<long>"
ANSWER_ARROW = pa.schema([("part", pa.string()), ("level", pa.int32()), ("shard", pa.int32()), ("chunk", pa.int64()), *((k, pa.binary()) for k in ("keys", "x", "y", "z")), ("types", pa.list_(pa.int64()))])


def merged(table: pa.Table) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """A shard's questions together: lengths, each entry's key number, distinct keys, and which entries come first."""
    keys = [expand_keys(k) for k in table["keys"].to_pylist()]
    distinct, first, place = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    owns = np.zeros(len(place), bool)
    owns[first] = True
    return [len(k) for k in keys], place, distinct, owns


def added(table: pa.Table, name: str, kind, place: np.ndarray, n: int) -> np.ndarray:
    """Sums by key number of a column of the questions."""
    total = np.zeros(n, kind)
    np.add.at(total, place, np.concatenate([expand(v, kind) for v in table[name].to_pylist()]))
    return total


def added_types(table: pa.Table, place: np.ndarray, n: int) -> np.ndarray:
    """Sums by key number of numbers of types: a row for each count up to MOST."""
    parts = [expand(v, np.int32).reshape(MOST, -1) for v in table["y"].to_pylist()]
    total = np.zeros((MOST, n), np.int32)
    for r, x in enumerate(np.concatenate(parts, axis=1)):
        np.add.at(total[r], place, x)
    return total


def answered(table: pa.Table, level: int, shard: int, sizes: list, rows: list[dict], x, y) -> pa.Table:
    """The rows of a shard: those of its table, and an answer to each chunk that asked."""
    at = 0
    for chunk, n in zip(table["chunk"].to_pylist(), sizes, strict=True):
        if chunk >= 0:
            part = slice(at, at + n)
            rows.append({"part": "answers", "level": level, "shard": shard, "chunk": chunk, "x": x(part), "y": y(part)})
        at += n
    return pa.Table.from_pylist(rows, ANSWER_ARROW)


def count_shard(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    level, shard = (k.as_py() for k in key)
    sizes, place, distinct, owns = merged(table)
    c = added(table, "x", np.int64, place, len(distinct))
    seen = c > 0
    types = np.bincount(np.minimum(c[seen], MOST + 2), minlength=MOST + 3)[1 : MOST + 2].tolist()
    row = {"part": "table", "level": level, "shard": shard, "chunk": -1, "keys": squeeze_keys(distinct[seen]), "x": squeeze(c[seen]), "types": [*types, int(c.sum()), int(seen.sum())]}
    return answered(table, level, shard, sizes, [row], lambda s: squeeze(c[place[s]]), lambda s: np.packbits(owns[s]).tobytes())


def history_shards(m: Numbers):
    """How a shard of histories answers: with c, or c + 1 where nothing is discounted, and backoff weights where needed."""

    def shard_of(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        level, shard = (k.as_py() for k in key)
        sizes, place, distinct, _ = merged(table)
        c, types, p = added(table, "x", np.int64, place, len(distinct)), added_types(table, place, len(distinct)), added(table, "z", np.float64, place, len(distinct))
        less = sum(r * (1 - m.discounts[-level].ratio[r]) * types[r - 1] for r in range(1, MOST + 1))
        seen = c > 0
        whole = np.where(seen, c + (less <= c * 1e-12), 1)
        backoff = np.log10((1 - (c - less) / whole) / (1 - p), where=seen, out=np.zeros(len(c)))
        need = np.concatenate([expand(v, np.uint8) if v else np.zeros(n, np.uint8) for v, n in zip(table["need"].to_pylist(), sizes, strict=True)]) > 0
        row = {"part": "table", "level": level, "shard": shard, "chunk": -1, "keys": squeeze_keys(distinct[seen]), "x": squeeze(c[seen]), "y": squeeze(types[:, seen].ravel()), "z": squeeze(p[seen])}
        return answered(table, level, shard, sizes, [row], lambda s: squeeze(whole[place[s]]), lambda s: squeeze(np.where(need[s], backoff[place[s]], 0.0)))

    return shard_of


def ask(questions: DataFrame, f, scratch: Scratch, levels: int, bits: int) -> DataFrame:
    """The shards' tables and answers to the questions, written partitioned by part and level."""
    groups: GroupedData = dealt(questions, levels << bits, "level", "shard").groupBy("level", "shard")
    return scratch.write(groups.applyInArrow(f, ANSWER), partition_by=["part", "level"])


def known(rows: DataFrame) -> DataFrame:
    """The table rows among a result of ask()."""
    return rows.where("part = 'table'").select("level", "shard", "keys", "x", "y", "z")


def told(tables: DataFrame) -> DataFrame:
    """Table rows as questions of no chunk, which need no answer."""
    return tables.selectExpr("level", "shard", "-1L AS chunk", "keys", "x", "y", "z", "CAST(NULL AS BINARY) AS need")


def informed(chunks: DataFrame, answers: list[DataFrame], tasks: float) -> DataFrame:
    """Chunks with the answers they got."""
    rows = None
    for a in answers:
        part = a.where("part = 'answers'").select("chunk", F.struct("level", "shard", "x", "y").alias("a"))
        rows = part if rows is None else rows.union(part)
    of = rows.groupBy(F.col("chunk").alias("of")).agg(F.collect_list("a").alias("answers"))
    return dealt(chunks, tasks, "chunk").join(of, F.col("chunk") == F.col("of"), "left").drop("of")


def count_questions(chunks: DataFrame, order: int, bits: int) -> DataFrame:
    def f(chunk: Chunk) -> list[dict]:
        rows = []
        train = np.repeat(~np.array(chunk.row["held"], bool), chunk.sizes)
        for n in range(1, order + 1):
            keys = chunk.keys[n]
            c = np.bincount(chunk.place[n][train], minlength=len(keys)).astype(np.int64)
            rows += [{"level": n, "shard": s, "chunk": chunk.row["chunk"], "keys": squeeze_keys(keys[i]), "x": squeeze(c[i])} for s, i in by_shard(keys, bits)]
        return rows

    return each_chunk(chunks, order, f, QUESTION)


def history_questions(chunks: DataFrame, n: int, order: int, bits: int, m: Numbers) -> DataFrame:
    """Sums over what follows each history of level ``n``; answers come under the level ``-n``."""

    def f(chunk: Chunk) -> list[dict]:
        _, first = np.unique(chunk.place[n], return_index=True)
        use = first[chunk.own[n] & (chunk.counts[n] > 0)]
        keys, at = chunk.history_keys[n], chunk.history_place[n][use]
        c = chunk.counts[n][chunk.place[n][use]]
        total, types, p = np.zeros(len(keys), np.int64), np.zeros((MOST, len(keys)), np.int32), np.zeros(len(keys))
        np.add.at(total, at, c)
        np.add.at(p, at, 10.0 ** chunk.log_p(n - 1, use, m))
        few = c <= MOST
        np.add.at(types, (c[few] - 1, at[few]), 1)
        return chunk.history_questions(n, bits, total, types, p)

    return each_chunk(chunks, order, f, QUESTION)


def fitted(counts: DataFrame, p: Settings, bits: int) -> Katz:
    """Discounts and totals of the counted n-grams; one row for each level comes to the driver."""
    sums = known_types(counts)
    discounts = [Discount({})] + [Discount({r: sums[n][r - 1] for r in range(1, MOST + 2)}) if n in sums else Discount({}) for n in range(1, p.order + 1)]
    *types, tokens, vocabulary = sums.get(1, [0] * (MOST + 3))
    beyond = tokens - sum(r * k for r, k in enumerate(types[:MOST], 1))
    held = beyond + sum(r * k * discounts[1].ratio[r] for r, k in enumerate(types[:MOST], 1))
    total = float(tokens if held < tokens * (1 - 1e-12) else tokens + 1)
    unseen = math.log10((1 - held / total if tokens else 1.0) / max(types[0], 1))
    return Katz(p, bits, known(counts), discounts, tokens, vocabulary, total, unseen)


def known_types(counts: DataFrame) -> dict[int, list[int]]:
    at = [F.sum(F.col("types")[i]).alias(f"t{i}") for i in range(MOST + 3)]
    return {r[0]: list(r[1:]) for r in counts.where("part = 'table'").groupBy("level").agg(*at).collect()}


def apply(docs: DataFrame, p: Settings | None = None, model: Katz | None = None) -> tuple[DataFrame, Katz]:
    """Scores of ``docs`` (doc_id, held_out, text) and the model.

    Without ``model``, one is trained on the rows that are not held out; with it, nothing is learnt.
    The scores: doc_id, held_out, n_tokens, n_known, base_score, score.
    """
    p = model.settings if model else p or Settings()
    scratch = Scratch(docs.sparkSession, "katz")
    if model:
        docs = docs.withColumn("held_out", F.lit(True))
    chunks = scratch.write(chunked(docs.select("doc_id", "held_out", "text"), p))
    n_chunks = chunks.count()
    bits, tasks = model.bits if model else shard_bits(n_chunks * p.chunk, p.shard), n_chunks / CHUNKS
    questions = count_questions(chunks, p.order, bits)
    counts = ask(questions.unionByName(told(model.grams)) if model else questions, count_shard, scratch, p.order, bits)
    trained = model or fitted(counts, p, bits)
    numbers, answers = trained.numbers(), [counts]
    for n in range(2, p.order + 1):
        questions = history_questions(informed(chunks, answers, tasks), n, p.order, bits, numbers) if not model else history_keys(informed(chunks, answers, tasks), n, p.order, bits)
        found = ask(questions.unionByName(told(model.histories[n - 2])) if model else questions, history_shards(numbers), scratch, 1, bits)
        if not model:
            trained.histories.append(known(found))
        answers.append(found)
    return scored(informed(chunks, answers, tasks), p.order, numbers, docs.schema["doc_id"]), trained


def history_keys(chunks: DataFrame, n: int, order: int, bits: int) -> DataFrame:
    """Questions for histories that add nothing to their sums."""

    def f(chunk: Chunk) -> list[dict]:
        size = len(chunk.history_keys[n])
        return chunk.history_questions(n, bits, np.zeros(size, np.int64), np.zeros((MOST, size), np.int32), np.zeros(size))

    return each_chunk(chunks, order, f, QUESTION)


def scored(chunks: DataFrame, order: int, m: Numbers, id_field: T.StructField) -> DataFrame:
    made = T.StructType.fromDDL("held_out boolean, n_tokens long, n_known long, base_score double, score double")

    def f(chunk: Chunk) -> list[dict]:
        c = chunk.counts[1][chunk.place[1]]
        log_p = chunk.log_p(order, np.arange(len(c)), m)
        base = np.log10(c + 1.0)
        sums = [np.add.reduceat(x, chunk.first).tolist() for x in ((c > 0).astype(np.int64), base, log_p)]
        less = math.log10(m.tokens + m.vocabulary + 1)
        rows = zip(chunk.row["ids"], chunk.row["held"], chunk.sizes.tolist(), *sums, strict=True)
        return [{"doc_id": i, "held_out": h, "n_tokens": n, "n_known": k, "base_score": b - n * less, "score": s} for i, h, n, k, b, s in rows]

    return each_chunk(chunks, order, f, T.StructType([T.StructField("doc_id", id_field.dataType), *made.fields]))


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fold: int = 7, held: int = 2, p: Settings | None = None) -> DataFrame:
    """Train on the rows whose crc32(id) mod ``fold`` is not ``held`` and score all rows.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigram) and score, both
    log10. Null text: as empty, one end token. Repeated rows count as often as they stand and score alike.
    No training rows: every token is unseen. Extra columns are dropped. Empty table: no rows. Texts are read
    whole; a chunk holds at least one text, so a very long text makes a chunk of its own.
    """
    part = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("held_out", crc32_mod("doc_id", fold) == held)
    rows, model = apply(part, p)
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
