"""Substring deduplication by seed and extend, exact at word level.

A window is ``WINDOW`` consecutive words. Winnowing picks one anchor (a ``GRAM``-word run, least hash) in
each window by its words alone, so equal windows in different documents pick equal anchors. The windows of
one document that pick the same anchor form a stretch; the stretch is the anchor extended both ways.

Documents are read into chunks (shards.py); every step is a question of chunks to shards of hashes:

1. Seeds: a chunk tells its distinct (anchor, hash of the stretch's words) with the least document of each. The
   answer says whether another chunk has a smaller document; then the stretch is a repeat as a whole.
2. Extension: the answer also says whether the anchor occurs in several different stretches; then matches end inside
   a stretch. The first document of each such stretch (and no copy of it) asks for its single windows by a
   128-bit hash, again with the least document of each.
3. Matched windows of a document are merged into maximal repeats, which are cut.

A passage in a third of all documents is one entry for each chunk. The tables shuffled are the questions (about 17
bytes for a fifth of all words, and for the windows asked), and twice the chunks (texts as zstandard).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, map_arrow
from .shards import by_shard, dealt, expand, expand_keys, first_chunk, shard_bits, squeeze, squeeze_keys

WINDOW, GRAM = 13, 4
SPAN = WINDOW - GRAM + 1
M1, M2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Bytes of text in a chunk, bytes of text and windows for each shard.
CHUNK, SHARD, SHARD_WINDOWS = 4 << 20, 32 << 20, 1 << 21
#: Chunks of one task where they meet their answers.
CHUNKS = 2


class Powers:
    """Powers of an odd multiplier and of its inverse modulo 2**64, grown as longer texts come."""

    def __init__(self, m: int):
        self.m, self.inv = m, pow(m, -1, 1 << 64)
        self.grow(1 << 12)

    def grow(self, n: int) -> None:
        def powers(x: int) -> np.ndarray:
            out = np.full(n, x, np.uint64)
            out[0] = 1
            return np.cumprod(out, dtype=np.uint64)

        self.up, self.down = powers(self.m), powers(self.inv)

    def prefix(self, words: np.ndarray) -> np.ndarray:
        if len(words) + 1 > len(self.up):
            self.grow(2 * len(words) + 2)
        out = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * self.up[: len(words)], out=out[1:])
        return out

    def hash(self, prefix: np.ndarray, start: np.ndarray, length) -> np.ndarray:
        """Hash of words[start : start + length], the same wherever they stand."""
        return mix((prefix[start + length] - prefix[start]) * self.down[start])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


P1, P2 = Powers(M1), Powers(M2)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def stretches(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, stretch hash, first window and number of windows of each stretch of a text with at least WINDOW words."""
    prefix = P1.prefix(words)
    grams = P1.hash(prefix, np.arange(len(words) - GRAM + 1), GRAM)
    picked = np.lib.stride_tricks.sliding_window_view(grams, SPAN).argmin(1) + np.arange(len(words) - WINDOW + 1)
    first = np.flatnonzero(np.r_[True, picked[1:] != picked[:-1]])
    count = np.diff(np.r_[first, len(picked)])
    anchor = picked[first]
    whole = P1.hash(prefix, first, count + WINDOW - 1) ^ mix((count * 64 + anchor - first).astype(np.uint64))
    return grams[anchor], whole, first, count


def windows(words: np.ndarray, stretch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes and the start of each window of the packed stretches."""
    first, count = stretch >> 4, stretch & 15
    start = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return P1.hash(P1.prefix(words), start, WINDOW), P2.hash(P2.prefix(mix(words)), start, WINDOW), start


# Chunks


def chunked(rows: DataFrame, size: int) -> DataFrame:
    """Chunks of ``rows`` (row struct, id long, text): chunk, rows, ids, sizes (bytes, -1: null), texts."""
    kind = rows.schema["row"].dataType

    def run(batches):
        chunk, parts, ids, texts, held = first_chunk(), [], [], [], 0

        def flush():
            values = pa.concat_arrays(parts)
            sizes = np.array([-1 if t is None else len(t) for t in texts], np.int64)
            payload = zstandard.ZstdCompressor(level=3).compress(b"".join(t or b"" for t in texts))
            held_rows = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            columns = [pa.array([chunk]), held_rows, pa.array([ids], pa.list_(pa.int64())), pa.array([squeeze(sizes)], pa.binary()), pa.array([payload], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "rows", "ids", "sizes", "texts"])

        for batch in batches:
            begin = 0
            for i, (doc, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True)):
                ids.append(doc)
                texts.append(text)
                held += len(text or b"")
                if held >= size or len(ids) >= 1 << 16:
                    parts.append(batch.column(0).slice(begin, i + 1 - begin))
                    yield flush()
                    chunk, parts, ids, texts, held, begin = chunk + 1, [], [], [], 0, i + 1
            if begin < batch.num_rows:
                parts.append(batch.column(0).slice(begin))
        if ids:
            yield flush()

    made = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("rows", T.ArrayType(kind)), *T.StructType.fromDDL("ids array<long>, sizes binary, texts binary").fields])
    return rows.mapInArrow(run, made)


def texts_of(sizes: bytes, payload: bytes) -> list[bytes]:
    """The texts of a chunk; null as empty."""
    data, out, at = zstandard.ZstdDecompressor().decompress(payload), [], 0
    for n in np.maximum(expand(sizes, np.int64), 0).tolist():
        out.append(data[at : at + n])
        at += n
    return out


class Entries:
    """Keys (x, y) of a chunk's places: ``row`` numbers the chunk's rows, ``at`` is a packed run of windows."""

    def __init__(self, parts: list[tuple], ids: np.ndarray):
        none = np.zeros(0, np.uint64)
        x, y, self.row, self.at = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (none, none, none.astype(np.int64), none.astype(np.int64))
        order = np.lexsort((y, x))
        x, y, self.row, self.at = x[order], y[order], self.row[order], self.at[order]
        first = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(x) else np.zeros(0, np.int64)
        self.group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(x)]))
        self.x, self.y, self.doc = x[first], y[first], ids[self.row]
        self.least = np.minimum.reduceat(self.doc, first) if len(first) else self.doc

    def questions(self, chunk: int, bits: int) -> list[dict]:
        return [{"shard": s, "chunk": chunk, "x": squeeze_keys(self.x[i]), "y": squeeze(self.y[i]), "least": squeeze(self.least[i])} for s, i in by_shard(self.x, bits)]

    def answered(self, answers: list[dict] | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """For each entry: whether a smaller document has its key, and whether its key's x occurs with other y."""
        flags = np.zeros(len(self.x), np.uint8)
        if answers:
            of = {a["shard"]: a["flags"] for a in answers}
            for s, i in by_shard(self.x, bits):
                if s in of:
                    flags[i] = expand(of[s], np.uint8)
        flags = flags[self.group]
        return (flags & 1 > 0) | (self.doc > self.least[self.group]), flags & 2 > 0


QUESTION = "shard int, chunk long, x binary, y binary, least binary"
QUESTION_ARROW = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("x", pa.binary()), ("y", pa.binary()), ("least", pa.binary())])
ANSWER_ARROW = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("flags", pa.binary())])


def answer(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Flags for each question of a shard: 1, a smaller document has the key; 2, its x occurs with other y. All zero: no answer."""
    x = [expand_keys(k) for k in table["x"].to_pylist()]
    sizes = [len(k) for k in x]
    x = np.concatenate(x)
    y, least = (np.concatenate([expand(v, kind) for v in table[name].to_pylist()]) for name, kind in (("y", np.uint64), ("least", np.int64)))
    order = np.lexsort((y, x))
    x, y, doc = x[order], y[order], least[order]
    first = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
    group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(x)]))
    anchor = x[first]
    same = np.r_[False, anchor[1:] == anchor[:-1], False]
    several = same[1:] | same[:-1]
    flags = np.empty(len(x), np.uint8)
    flags[order] = (doc > np.minimum.reduceat(doc, first)[group]) + 2 * several[group].astype(np.uint8)
    rows, at = [], 0
    for chunk, n in zip(table["chunk"].to_pylist(), sizes, strict=True):
        if flags[at : at + n].any():
            rows.append({"shard": key[0].as_py(), "chunk": chunk, "flags": squeeze(flags[at : at + n])})
        at += n
    return pa.Table.from_pylist(rows, ANSWER_ARROW)


def asked(chunks: DataFrame, f) -> DataFrame:
    """Questions ``f`` gives for each chunk row."""

    def run(batch: pa.RecordBatch):
        for row in batch.to_pylist():
            questions = f(row)
            if questions:
                yield pa.RecordBatch.from_pylist(questions, QUESTION_ARROW)

    return map_arrow(chunks, run, QUESTION)


def informed(chunks: DataFrame, questions: DataFrame, bits: int, n_chunks: int) -> DataFrame:
    """Chunks with the answers to their questions."""
    answers = dealt(questions, 1 << bits, "shard").groupBy("shard").applyInArrow(answer, "shard int, chunk long, flags binary")
    of = answers.groupBy(F.col("chunk").alias("of")).agg(F.collect_list(F.struct("shard", "flags")).alias("answers"))
    return dealt(chunks, n_chunks / CHUNKS, "chunk").join(of, F.col("chunk") == F.col("of"), "left").drop("of")


def ids_of(row: dict) -> np.ndarray:
    return np.array([-1 if i is None else i for i in row["ids"]], np.int64)


def stretch_entries(row: dict) -> Entries:
    def each():
        for r, (doc, text) in enumerate(zip(row["ids"], texts_of(row["sizes"], row["texts"]), strict=True)):
            if doc is not None and len(words := text.split()) >= WINDOW:
                x, y, first, count = stretches(word_hashes(words))
                yield x, y, np.full(len(x), r, np.int64), first << 4 | count

    return Entries(list(each()), ids_of(row))


def window_entries(row: dict) -> Entries:
    """The single windows of the stretches that ask for them."""
    rows, runs, texts = expand(row["open_rows"], np.int64), expand(row["open_runs"], np.int64), texts_of(row["sizes"], row["texts"])

    def each():
        edge = np.flatnonzero(np.diff(rows, prepend=-1, append=-1))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            x, y, start = windows(word_hashes(texts[rows[a]].split()), np.unique(runs[a:b]))
            yield x, y, np.full(len(x), rows[a], np.int64), start << 4 | 1

    return Entries(list(each()) if len(rows) else [], ids_of(row))


def stretched(chunks: DataFrame, bits: int) -> DataFrame:
    """Chunks with the runs found to be repeats, and those to be asked for window by window (n_open windows)."""

    def run(batch: pa.RecordBatch):
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            row = one.select([c for c in one.schema.names if c != "rows"]).to_pylist()[0]
            e = stretch_entries(row)
            repeat, several = e.answered(row["answers"], bits)
            open_ = several & ~repeat
            made = []
            for use in (repeat, open_):
                order = np.argsort(e.row[use], kind="stable")
                made += [squeeze(e.row[use][order]), squeeze(e.at[use][order])]
            columns = [pa.array([m], pa.binary()) for m in made] + [pa.array([int((e.at[open_] & 15).sum())], pa.int64())]
            yield pa.RecordBatch.from_arrays([*one.columns[:-1], *columns], names=[*one.schema.names[:-1], *names])

    made = T.StructType.fromDDL("found_rows binary, found_runs binary, open_rows binary, open_runs binary, n_open long")
    names = made.names
    return map_arrow(chunks, run, T.StructType([*chunks.schema.fields[:-1], *made.fields]))


RESULT = "n_words long, n_removed long, kept string, rest string, spans array<struct<start: long, length: long>>"


def cut_chunks(chunks: DataFrame, bits: int, prefix: str) -> DataFrame:
    """One row for each row of the chunks: its columns and the results."""
    kind = chunks.schema["rows"].dataType.elementType
    fields = [T.StructField(prefix + f.name, f.dataType) for f in T.StructType.fromDDL(RESULT).fields]

    def run(batch: pa.RecordBatch):
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            held = one.column(one.schema.names.index("rows")).flatten()
            row = one.select([c for c in one.schema.names if c != "rows"]).to_pylist()[0]
            e = window_entries(row)
            repeat, _ = e.answered(row["answers"], bits)
            of: dict[int, list] = {}
            for r, at in zip(np.r_[expand(row["found_rows"], np.int64), e.row[repeat]].tolist(), np.r_[expand(row["found_runs"], np.int64), e.at[repeat]].tolist(), strict=True):
                of.setdefault(r, []).append(at)
            cols = [list(c) for c in zip(*(cut(t, of.get(r, [])) for r, t in enumerate(texts_of(row["sizes"], row["texts"]))), strict=True)]
            types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))]
            made = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
            made[2:4] = [c.cast(pa.string()) for c in made[2:4]]
            yield pa.RecordBatch.from_arrays([*held.flatten(), *made], names=[*kind.names, *(f.name for f in fields)])

    return map_arrow(chunks, run, T.StructType([*kind.fields, *fields]))


def ranked(docs: DataFrame, doc_id: str) -> tuple[DataFrame, Column]:
    """``docs`` with a long that orders as the id does: the id itself if it is integral, else its place among the sorted distinct ids."""
    if isinstance(docs.schema[doc_id].dataType, T.IntegralType):
        return docs, F.col(doc_id).cast("long")
    scratch = Scratch(docs.sparkSession, "ranks")
    ids = scratch.write(docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("__named")).distinct().orderBy("__named").withColumn("__place", F.monotonically_increasing_id()))
    # places grow with the sorted partitions and within them; they need not be without gaps
    return docs.join(ids, F.col(doc_id) == F.col("__named"), "left").drop("__named"), F.col("__place")


def cut_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, prefix: str = "", chunk: int = CHUNK, shard: int = SHARD) -> DataFrame:
    """Cut from each document the words in windows that also start in a document with a smaller id.

    Returns ``keep`` columns (default: the id; never the text), and under names that begin with ``prefix``: n_words,
    n_removed, kept (the words left, joined by one space), rest (the text with the repeats cut out, else unchanged)
    and spans (start word and length of each maximal repeat). One row for each row of ``docs``. Windows are judged
    on the input.

    Ids may be of any type that has an order. Null text: no words, kept and rest empty. Rows with a null id are
    neither cut nor a reason to cut. Rows with the same id, whether their texts are equal or not, are one document:
    each is cut by what smaller ids hold, and not by the others. Extra columns are carried only if in ``keep``; a
    ``prefix`` sets the results apart from columns of the same name. Empty table: no rows. Very long texts are
    read whole; a chunk holds at least one text.
    """
    keep = keep or [doc_id]
    carried = [F.col(c) for c in keep if c != text] or [F.lit(0).alias("_")]
    scratch = Scratch(docs.sparkSession, "repeats")
    part, order = ranked(docs.select(*dict.fromkeys([*keep, doc_id, text])), doc_id)
    chunks = scratch.write(chunked(part.select(F.struct(*carried).alias("row"), order.alias("id"), F.col(text).alias("text")), chunk))
    n_chunks = chunks.count()
    bits = shard_bits(n_chunks * chunk, shard)

    asking = asked(chunks.drop("rows"), lambda row: stretch_entries(row).questions(row["chunk"], bits))
    state = scratch.write(stretched(informed(chunks, asking, bits, n_chunks), bits))
    scratch.drop(chunks)
    more = shard_bits(state.agg(F.sum("n_open")).first()[0] or 0, SHARD_WINDOWS)
    asking = asked(state.drop("rows", "found_rows", "found_runs").where("n_open > 0"), lambda row: window_entries(row).questions(row["chunk"], more))
    return cut_chunks(informed(state, asking, more, n_chunks), more, prefix)


def cut(text: bytes, ats: list[int]) -> tuple[int, int, bytes, bytes, list[dict]]:
    words = text.split()
    if not ats:
        return len(words), 0, b" ".join(words), text, []
    at = np.array(ats, np.int64)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, at >> 4, 1)
    np.add.at(change, np.minimum((at >> 4) + (at & 15) + WINDOW - 1, len(words)), -1)
    gone = np.cumsum(change)[:-1] > 0
    edge = np.flatnonzero(np.diff(np.r_[False, gone, False]))
    spans = [{"start": i, "length": j - i} for i, j in edge.reshape(-1, 2).tolist()]
    starts = np.zeros(len(words), np.int64)
    where = 0
    for i, w in enumerate(words):
        where = text.index(w, where)
        starts[i] = where
        where += len(w)
    left, begin = [], 0
    for s in [*spans, {"start": len(words), "length": 0}]:
        if s["start"] > begin:
            last = s["start"] - 1
            left.append(text[starts[begin] : starts[last] + len(words[last])])
        begin = s["start"] + s["length"]
    return len(words), int(gone.sum()), b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g), b"\n".join(left), spans
