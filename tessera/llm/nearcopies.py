"""Near copies by SimHash and exact shingle similarity.

Two texts are near copies if the Jaccard similarity of their sets of word shingles is at least ``similarity``.
Texts with equal sets are merged first. Each set has a SimHash fingerprint; those that agree on ``blocks - distance``
of its ``blocks`` blocks and differ in at most ``distance`` bits are candidates. At similarity 0.8 fingerprints differ
in some 10 of 64 bits, and blocks for that would be a few bits wide. So what lies further apart, or is left out
in a large group of blocks, has candidates by minhash: ``bands`` bands of ``rows`` each, of which a pair of
similarity s shares one with probability 1 - (1 - s^rows)^bands, which is 0.99993 at 0.8 with the defaults. Every
candidate link of either kind is verified on the whole sets; none is taken on its sketch.

Groups that share a band can be large, and are not expanded into pairs. Each member is compared with its group's
hub, the member that shares its bands with most others, and components are formed. Let a be a member outside its hub
h's component, i = |a & h|, t = s / (1 + s), so that a pair needs |a & b| >= t (|a| + |b|), and i < t (|a| + |h|).
  If t (|a| + |b|) > i, the two must share that many shingles more than i that h lacks.
  Else |b| <= i / t - |a| < |h|, and they must share one that h lacks, or lack one that h has: if not,
  |a & b| = i + |b & h| - |h| < t |a| - (1 - t) |h| + |b| < t (|a| + |b|).
So members are put under the shingles in which they differ from the hub. These groups have hubs again; only what
is in different components then is joined, on shingles that are rare enough among a's: of those that h lacks, as
many of the most frequent may be left out as must be shared, less one. Copies with changes of their own have few such
shingles in common, so the pairs compared are in proportion to the members.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, texts_as_bytes
from .components import connected_components
from .simhash import majority, sharing, within

STEP = 1 << 10


@dataclass(frozen=True)
class Near:
    shingle: int = 5
    similarity: float = 0.8
    #: of fingerprints: bits that may differ, and blocks
    distance: int = 5
    blocks: int = 8
    bands: int = 24
    rows: int = 5
    seed: int = 42

    def factors(self) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        return rng.integers(0, 1 << 64, self.bands * self.rows, np.uint64) | np.uint64(1)


def shingles(text: bytes, p: Near) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a UTF-8 text, A-Z lower-cased; a shorter text is one shingle."""
    words = text.lower().split()
    line = b" ".join(words)
    if len(words) <= p.shingle:
        parts = [line]
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size + 1) - 1
        parts = [line[i:j] for i, j in zip((ends - size)[: 1 - p.shingle].tolist(), ends[p.shingle - 1 :].tolist(), strict=True)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(p.seed)), np.uint64, len(parts)))


def set_key(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), 1)


def band_keys(found: np.ndarray, factors: np.ndarray, p: Near) -> list[int]:
    """A key for each band: the hash of its least products."""
    least = np.full(len(factors), np.iinfo(np.uint64).max)
    for i in range(0, len(found), STEP):
        least = np.minimum(least, (factors[:, None] * found[None, i : i + STEP]).min(1))
    return [xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(least.reshape(p.bands, p.rows))]


def sketches(docs: DataFrame, p: Near) -> DataFrame:
    """(doc_id, node, fp, bands) of each row; ``node`` stands for the set of shingles, ``fp`` is its fingerprint."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        factors, nodes, fps, keys = p.factors(), [], [], []
        for t in texts_as_bytes(batch.column(1)):
            found = shingles(t, p)
            nodes.append(set_key(found))
            fps.append(majority(found))
            keys.extend(band_keys(found, factors, p))
        bands = pa.ListArray.from_arrays(np.arange(0, len(keys) + 1, p.bands, dtype=np.int32), pa.array(np.array(keys, np.uint64).view(np.int64)))
        made = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, fps))
        return pa.RecordBatch.from_arrays([batch.column(0), *made, bands], names=["doc_id", "node", "fp", "bands"])

    return map_arrow(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, node long, fp long, bands array<long>")


def sets(docs: DataFrame, p: Near) -> DataFrame:
    """(node, found): the sets themselves."""

    def run(batch: pa.RecordBatch):
        for t in texts_as_bytes(batch.column(1)):
            found = shingles(t, p)
            key = pa.array(np.array([set_key(found)], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([key, pa.array([found.view(np.int64)], pa.list_(pa.int64()))], names=["node", "found"])

    return map_arrow(docs, run, "node long, found array<long>").dropDuplicates(["node"])


def verified(pairs: DataFrame, known: DataFrame, p: Near) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    x, y = known.select(F.col("node").alias("a"), F.col("found").alias("fa")), known.select(F.col("node").alias("b"), F.col("found").alias("fb"))
    both = pairs.join(x, "a").join(y, "b").withColumn("same", F.size(F.array_intersect("fa", "fb")))
    return both.where(F.col("same") >= p.similarity * (F.size("fa") + F.size("fb") - F.col("same")) - 1e-9).select("a", "b")


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", p: Near | None = None) -> DataFrame:
    """(doc_id, component_id) of each distinct id and set of shingles; ``component_id``: the least id reachable over near copies.

    Null or empty text: one shingle, the empty one. Rows with a null id are left out. Empty table: no rows.
    """
    p, spark = p or Near(), docs.sparkSession
    scratch = Scratch(spark, "nearcopies")
    part = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = scratch.write(sketches(part, p))
    reps = scratch.write(rows.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    close = scratch.write(within(scratch.write(sharing(reps.select("node", "fp"), p.distance, p.blocks)), p.distance))
    keyed = reps.select("node", F.posexplode("bands").alias("band", "key")).select(F.xxhash64("band", "key").alias("g"), "node")
    groups = scratch.write(keyed.join(keyed.groupBy("g").count().where("count > 1").select("g"), "g"))
    nodes = groups.select("node").union(close.select("a")).union(close.select("b")).distinct()
    wanted = reps.join(nodes, "node", "left_semi").select(F.col("rep").alias("doc_id")).distinct()
    known = scratch.write(sets(part.join(wanted, "doc_id", "left_semi"), p))
    members = scratch.write(with_hubs(groups))
    pairs = close.union(members.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))).distinct()
    links = scratch.write(verified(pairs, known, p))
    of = scratch.write(connected_components(spark, links))
    apart = scratch.write(differences(members, of, known))
    if not apart.isEmpty():
        again = with_hubs(apart.select("g", "node").distinct())
        links = scratch.write(links.union(verified(again.select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), known, p)))
        of = scratch.write(connected_components(spark, links))
        links = links.union(scratch.write(verified(still_open(apart, of, p), known, p)))
        of = connected_components(spark, links)
    found = reps.join(of, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("part"))
    least = found.groupBy("part").agg(F.min("rep").alias("component_id"))
    return rows.select("doc_id", "node").distinct().join(found.select("node", "part"), "node").join(least, "part").select("doc_id", "component_id")


def with_hubs(groups: DataFrame) -> DataFrame:
    """(g, node, hub) of all members but the hubs; ``groups``: g, node."""
    sized = groups.join(groups.groupBy("g").agg(F.count("*").alias("size")), "g")
    central = sized.groupBy("node").agg(F.sum("size").alias("shared"))
    hubs = groups.join(central, "node").groupBy("g").agg(F.max(F.struct("shared", "node")).alias("h")).select("g", F.col("h.node").alias("hub"))
    return groups.join(hubs, "g").where("node <> hub")


def differences(members: DataFrame, of: DataFrame, known: DataFrame) -> DataFrame:
    """What members of hubs with members outside their component differ in from the hub, as far as others differ alike.

    Rows: g (hub, shingle, and whether it is lacked), node, lacked, outside, size, same (shingles in common with the
    hub), extra (number that the hub lacks), rank (of this one among them, the rarest first).
    """
    pairs = members.select("hub", "node").distinct()
    placed = pairs.join(of, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
    placed = placed.join(of.select(F.col("node").alias("hub"), F.col("component").alias("hub_component")), "hub", "left")
    placed = placed.withColumn("outside", F.col("part") != F.coalesce("hub_component", "hub")).select("hub", "node", "part", "outside")
    busy = placed.groupBy("hub").agg(F.max("outside").alias("o"), F.min("part").alias("x"), F.max("part").alias("y")).where("o AND x <> y").select("hub")
    both = placed.join(busy, "hub").join(known, "node").join(known.select(F.col("node").alias("hub"), F.col("found").alias("of_hub")), "hub")
    both = both.select("hub", "node", "part", "outside", F.size("found").alias("size"), F.array_except("found", "of_hub").alias("more"), F.array_except("of_hub", "found").alias("less"))
    both = both.withColumn("extra", F.size("more")).withColumn("same", F.col("size") - F.col("extra"))
    tagged = lambda c, lacked: F.transform(c, lambda e: F.struct(F.xxhash64("hub", F.lit(lacked), e).alias("g"), F.lit(lacked).alias("lacked")))
    each = both.select("hub", "node", "part", "outside", "size", "same", "extra", F.explode(F.concat(tagged("more", False), tagged("less", True))).alias("d")).select("*", "d.g", "d.lacked").drop("d")
    shared = each.groupBy("g").agg(F.max("outside").alias("o"), F.min("part").alias("x"), F.max("part").alias("y"), F.count("*").alias("holders"))
    each = each.join(shared, "g")
    rank = F.row_number().over(Window.partitionBy("hub", "node").orderBy("lacked", "holders", "g"))
    return each.withColumn("rank", rank).where("o AND x <> y").select("g", "node", "lacked", "outside", "size", "same", "extra", "rank")


def still_open(apart: DataFrame, of: DataFrame, p: Near) -> DataFrame:
    """Distinct pairs (a, b) of different components that may be similar, by what they differ in from a hub alike."""
    t = p.similarity / (1 + p.similarity)
    rows = apart.join(of, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
    alive = rows.groupBy("g").agg(F.max("outside").alias("o"), F.min("part").alias("x"), F.max("part").alias("y"), F.min("size").alias("least")).where("o AND x <> y").select("g", "least")
    rows = rows.join(alive, "g")
    needed = lambda a, other: F.ceil(F.lit(t - 1e-12) * (F.col(f"{a}size") + other)) - F.col(f"{a}same")
    rare = lambda a, other: F.col(f"{a}rank") <= F.col(f"{a}extra") - F.greatest(needed(a, other), F.lit(1)) + 1
    # what can match the shortest of a group is all that can match any of it
    low = rows.where("outside").where(F.when(F.col("lacked"), needed("", F.col("least")) <= 0).otherwise(rare("", F.col("least"))))
    x = low.select("g", "lacked", *(F.col(c).alias(f"a_{c}") for c in ("node", "part", "size", "same", "extra", "rank")))
    y = rows.select("g", *(F.col(c).alias(f"b_{c}") for c in ("node", "part", "size")))
    alike = F.least("a_size", "b_size") >= F.lit(p.similarity - 1e-12) * F.greatest("a_size", "b_size")
    may = F.when(F.col("lacked"), needed("a_", F.col("b_size")) <= 0).otherwise(rare("a_", F.col("b_size")))
    return x.join(y, "g").where((F.col("a_part") != F.col("b_part")) & alike & may).select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()


def one_per_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", p: Near | None = None) -> DataFrame:
    """The rows of ``docs`` whose id is the least of its near copies; all columns kept.

    Of repeated rows with that id one stays. Rows with a null id stay.
    """
    stay = near_copies(docs, doc_id, text, p).where("doc_id = component_id").select(F.col("doc_id").alias("__stay")).distinct()
    named = docs.where(F.col(doc_id).isNotNull()).join(stay, F.col(doc_id) == F.col("__stay"), "left_semi").dropDuplicates([doc_id])
    return named.unionByName(docs.where(F.col(doc_id).isNull()))
