"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint has 64 bits, cut into ``blocks`` equal parts. Two fingerprints that differ in at most
``distance`` bits agree on at least ``blocks - distance`` whole blocks, so they share a key made of
some choice of that many blocks. Equal fingerprints are merged first; distinct ones are joined on keys
and verified by Hamming distance.

Groups that share a key can be large (a family of near copies). A group of at most ``pair_group``
fingerprints is compared pairwise. In a larger one, each member emits the fingerprints one bit away
outside the shared blocks: two members within two bits meet at one of these, where at most
``1 + free bits`` members can be, and each is linked to the least. That finds the same components with a number
of rows in proportion to the members, for groups of any size.

``sharing`` and ``within`` take any distance, for callers that verify links on the texts (``nearcopies``).
"""

from __future__ import annotations

from itertools import combinations, pairwise, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, map_arrow, texts_as_bytes
from .components import connected_components

SEED = 42
STEP = 1 << 16


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of a UTF-8 text: A-Z lower-cased, word shingles with repeats, majority of XXH64 bits."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        parts = [line]
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size + 1) - 1
        parts = [line[i:j] for i, j in zip((ends - size)[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), "<u8", len(parts)))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes (unsigned 64-bit, little-endian)."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), STEP):
        ones += np.unpackbits(hashes[i : i + STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp) for each row; ``fp`` is the fingerprint as a signed long."""
    part = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.fromiter((fingerprint(t, shingle) for t in texts_as_bytes(batch.column(1))), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return map_arrow(part, run, T.StructType([part.schema["doc_id"], T.StructField("fp", T.LongType())]))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_masks(distance: int, blocks: int) -> list[int]:
    """Masks of each choice of ``blocks - distance`` blocks: fingerprints up to ``distance`` bits apart agree under one of them."""
    parts = [(1 << j) - (1 << i) for i, j in pairwise(64 * i // blocks for i in range(blocks + 1))]
    return [sum(chosen) for chosen in combinations(parts, blocks - distance)]


def sharing(reps: DataFrame, distance: int, blocks: int) -> DataFrame:
    """(g, size, node, fp) of the fingerprints of ``reps`` (node, fp) that agree with another under a mask; ``g`` is their group."""
    keys = F.explode(F.array(*(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(signed(m)))) for i, m in enumerate(block_masks(distance, blocks)))))
    members = reps.select("node", "fp", keys.alias("g"))
    return members.join(members.groupBy("g").agg(F.count("*").alias("size")).where("size > 1"), "g").select("g", "size", "node", "fp")


def within(members: DataFrame, distance: int, pair_group: int = 8) -> DataFrame:
    """Distinct pairs (a, b) of ``sharing`` that differ in at most ``distance`` bits.

    In groups of up to ``pair_group`` all of them, in larger ones those with the member of the least fingerprint.
    """
    near = F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= distance
    small = members.where(F.col("size") <= pair_group)
    x, y = small.select("g", F.col("node").alias("a"), F.col("fp").alias("fa")), small.select("g", F.col("node").alias("b"), F.col("fp").alias("fb"))
    pairs = x.join(y, "g").where("a < b").where(near).select("a", "b")
    large = members.where(F.col("size") > pair_group)
    hubs = large.groupBy("g").agg(F.min(F.struct("fp", "node")).alias("hub")).select("g", F.col("hub.node").alias("b"), F.col("hub.fp").alias("fb"))
    star = large.select("g", F.col("node").alias("a"), F.col("fp").alias("fa")).join(hubs, "g").where("a <> b").where(near)
    return pairs.union(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def links(reps: DataFrame, distance: int = 2, blocks: int = 4, pair_group: int = 8) -> DataFrame:
    """Links (a, b) between distinct fingerprints of ``reps`` (fp, rep) that span the same components as all links."""
    if distance != 2:
        raise ValueError("links() is built for a distance of two bits")
    masks = block_masks(distance, blocks)
    keys = F.explode(F.array(*(F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(masks))))
    members = reps.select("fp", "rep", keys.alias("k")).select("fp", "rep", "k.choice", "k.key")
    groups = members.groupBy("choice", "key").agg(F.count("*").alias("size")).where("size > 1")
    members = members.join(groups, ["choice", "key"])

    small = members.where(F.col("size") <= pair_group)
    x, y = small.select("choice", "key", F.col("fp").alias("fa"), F.col("rep").alias("a")), small.select("choice", "key", F.col("fp").alias("fb"), F.col("rep").alias("b"))
    near = x.join(y, ["choice", "key"]).where("fa < fb").where(F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= distance).select("a", "b")

    large = members.where(F.col("size") > pair_group).groupBy("fp", "rep").agg(F.collect_list("choice").alias("choices"))
    flips = F.array(*(F.array(F.lit(0).cast("long"), *(F.lit(signed(1 << i)) for i in range(64) if not m >> i & 1)) for m in masks))
    around = large.select("fp", "rep", F.explode("choices").alias("choice")).select("fp", "rep", "choice", F.explode(F.element_at(flips, F.col("choice") + 1)).alias("flip"))
    meet = around.groupBy("choice", F.col("fp").bitwiseXOR(F.col("flip")).alias("at")).agg(F.collect_set(F.struct("rep", "fp")).alias("who")).where(F.size("who") > 1)
    star = meet.select(F.array_min("who").alias("hub"), F.explode("who").alias("x")).where("x.rep <> hub.rep")
    star = star.where(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("hub.fp"))) <= distance).select(F.col("x.rep").alias("a"), F.col("hub.rep").alias("b"))
    return near.union(star)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, blocks: int = 4, pair_group: int = 8) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``.

    ``fingerprint``: 16 lower-case hex digits. ``component_id``: the least id among all documents
    reachable over links of at most two differing bits, itself included. Null or empty text: fingerprint
    zero, linked like any other. Rows with a null id keep their row; they get the least id of their
    component, null if it has none, and do not join components through other fingerprints. Repeated rows
    each give a row. Empty table: no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    fps = scratch.write(fingerprints(docs, doc_id, text, shingle))
    reps = scratch.write(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    parts = connected_components(spark, links(reps.where("rep IS NOT NULL"), blocks=blocks, pair_group=pair_group))
    of = reps.join(parts, reps["rep"] == parts["node"], "left").select(F.col("fp").alias("of_fp"), F.coalesce("component", "rep").alias("component_id"))
    out = fps.join(of, F.col("fp") == F.col("of_fp"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """The rows of ``docs`` whose id is the least of its near-duplicate component; all columns kept.

    Of repeated rows with that id one stays. Rows with a null id stay.
    """
    found = near_duplicates(docs, doc_id, text, shingle)
    stay = found.where("doc_id = component_id").select(F.col("doc_id").alias("__stay")).distinct()
    named = docs.where(F.col(doc_id).isNotNull()).join(stay, F.col(doc_id) == F.col("__stay"), "left_semi").dropDuplicates([doc_id])
    return named.unionByName(docs.where(F.col(doc_id).isNull()))
