"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm on islands.

1. Documents become token ids plus an end id; only longer ones than a sequence are cut, the first piece
   taking the remainder. A full piece is a sequence by itself.
2. The other pieces are dealt evenly to groups of bounded size. Each group is a bin-packing problem; its
   chromosome is the list of bins. Crossover injects whole well-filled bins of one parent into the other,
   removes the bins that hold a duplicate of an injected piece, and best-fits the pieces thus displaced; before
   that, displaced pieces take the place of shorter ones where this fills a bin better, so that shorter pieces are
   left to fit. Mutation opens some bins, the emptiest likeliest, in the same way.
3. A large group evolves around its elite: exactly full bins are inherited whole by every child, but for some drawn
   anew each epoch, so that births cost by what is not full yet.
4. Every group evolves on several islands, dealt to a fixed number of tasks; between epochs each island's elite
   moves to the next island of its group, where it is crossed with that island's own. The best island's bins are the
   group's result. A group whose elite meets the lower bound needs no further epoch and is passed on as it is.

Only lengths are shuffled; a row holds one island of one group.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, map_arrow
from .tokens import encoder


@dataclass(frozen=True)
class Packing:
    size: int = 1024
    end: int = 2
    #: pieces of a group and, at most, of the part of it that births work on; pieces that an epoch's births may handle
    group: int = 8192
    core: int = 1500
    work: int = 45_000
    islands: int = 2
    epochs: int = 2
    population: int = 8
    births: int = 300
    seed: int = 11
    #: tasks that islands are dealt to, at most
    tasks: int = 20_000


def pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", p: Packing | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each piece of each row. Null text: as empty, so only the end id."""
    p = p or Packing()
    part = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batch: pa.RecordBatch):
        ids, end = encoder(tokenizer), p.end.to_bytes(4, "little")
        rows, at = [[] for _ in range(4)], []
        for row, data in enumerate(ids.many(batch.column(1))):
            data += end
            total, start = len(data) // 4, 0
            while start < total:
                length = (total - start) % p.size or p.size
                part = data[4 * start : 4 * (start + length)]
                at.append(row)
                for c, v in zip(rows, (start and -(-start // p.size), start, length, zlib.crc32(part)), strict=True):
                    c.append(v)
                start += length
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(rows[0], pa.int32()), *(pa.array(c, pa.int64()) for c in rows[1:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    made = T.StructType.fromDDL("piece int, start long, length long, ids_crc32 long")
    return map_arrow(part, run, T.StructType([part.schema["doc_id"], *made.fields]))


class Bins:
    """Open bins by room, for best fit."""

    def __init__(self, size: int):
        self.by_room: list[list[int]] = [[] for _ in range(size + 1)]
        self.rooms: list[int] = []

    def add(self, b: int, room: int) -> None:
        if room:
            if not self.by_room[room]:
                insort(self.rooms, room)
            self.by_room[room].append(b)

    def fit(self, length: int) -> tuple[int, int] | None:
        """Take out the fullest bin with room for ``length``."""
        i = bisect_left(self.rooms, length)
        if i == len(self.rooms):
            return None
        room = self.rooms[i]
        b = self.by_room[room].pop()
        if not self.by_room[room]:
            del self.rooms[i]
        return b, room


def best_fit(lengths: list[int], order, bins: list[list[int]], room: list[int], size: int) -> None:
    """Put the items of ``order`` into ``bins`` (lists of items), opening new ones as needed."""
    open_ = Bins(size)
    for b, r in enumerate(room):
        open_.add(b, r)
    for i in order:
        got = open_.fit(lengths[i])
        if got is None:
            b, r = len(bins), size
            bins.append([])
            room.append(size)
        else:
            b, r = got
        bins[b].append(i)
        room[b] = r - lengths[i]
        open_.add(b, room[b])


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """Martello and Toth's bound over all thresholds."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=size + 1)
    upto, total = np.cumsum(count), np.cumsum(count * np.arange(size + 1))
    best = -(-int(total[-1]) // size)
    half = size // 2
    for k in range(half + 1):
        big = int(upto[size] - upto[size - k])
        mid = int(upto[size - k] - upto[half])
        low = int(total[half] - (total[k - 1] if k else 0))
        free = mid * size - int(total[size - k] - total[half])
        best = max(best, big + mid + max(0, -(-(low - free) // size)))
    return best


def fitness(room: list[int], size: int) -> float:
    """Mean squared fill: prefers few and unevenly filled bins."""
    fill = 1 - np.array(room) / size
    return float((fill * fill).sum() / max(len(fill), 1))


def exchange(lengths: list[int], loose: list[int], bins: list[list[int]], room: list[int]) -> list[int]:
    """Put one or two loose items in the place of one or two shorter ones of each bin with room, where that fills it most; returns the loose items then."""
    loose = sorted(loose, key=lengths.__getitem__)
    keys = [lengths[i] for i in loose]
    for b, r in enumerate(room):
        if not r or not keys:
            continue
        items = bins[b]
        outs = [((x,), lengths[i]) for x, i in enumerate(items)]
        outs += [((x, y), lengths[items[x]] + lengths[items[y]]) for x in range(len(items)) for y in range(x)]
        gain, out, came = 0, (), ()
        for places, size in outs:
            most = size + gain
            k = bisect_right(keys, size + r) - 1
            if k >= 0 and keys[k] > most:
                most, out, came = keys[k], places, (k,)
            low, high = 0, k
            while low < high and most < size + r:
                both = keys[low] + keys[high]
                if both > size + r:
                    high -= 1
                else:
                    if both > most:
                        most, out, came = both, places, (low, high)
                    low += 1
            gain = most - size
            if gain == r:
                break
        if not gain:
            continue
        room[b] -= gain
        new, gone = [loose[k] for k in came], [items[x] for x in out]
        for k in sorted(came, reverse=True):
            del loose[k], keys[k]
        for x in sorted(out, reverse=True):
            del items[x]
        items += new
        for i in gone:
            k = bisect_left(keys, lengths[i])
            keys.insert(k, lengths[i])
            loose.insert(k, i)
    return loose


def settle(lengths: list[int], loose: list[int], bins: list[list[int]], room: list[int], size: int) -> None:
    """Place displaced items: exchanges first, then best fit, the longest first."""
    best_fit(lengths, exchange(lengths, loose, bins, room)[::-1], bins, room, size)


def cross(lengths: list[int], one: tuple, two: tuple, rng: np.random.Generator, p: Packing) -> tuple[list[list[int]], list[int]]:
    """Bins of ``one`` injected into ``two``: the fullest are likeliest to be taken."""
    bins1, room1 = one
    rank = np.argsort(np.array(room1) + rng.random(len(room1)) * p.size * 0.05, kind="stable")
    chosen = rank[: max(1, int(len(rank) * rng.uniform(0.1, 0.5)))].tolist()
    held = bytearray(len(lengths))
    bins, room = [], []
    for b in chosen:
        bins.append(list(bins1[b]))
        room.append(room1[b])
        for i in bins1[b]:
            held[i] = 1
    loose: list[int] = []
    for b, items in enumerate(two[0]):
        if any(held[i] for i in items):
            loose += [i for i in items if not held[i]]
        else:
            bins.append(list(items))
            room.append(two[1][b])
    settle(lengths, loose, bins, room, p.size)
    return bins, room


def mutate(lengths: list[int], one: tuple, rng: np.random.Generator, p: Packing, share: float = 0.05) -> tuple[list[list[int]], list[int]]:
    """Open up to ``share`` of the bins, the emptiest likeliest, and some others, and settle their items."""
    n = len(one[0])
    rank = np.argsort(rng.random(n) * p.size * 0.02 - np.array(one[1]), kind="stable")
    k = max(2, int(n * share * rng.random()))
    gone = {*rank[:k].tolist(), *rng.integers(0, n, max(1, k // 2)).tolist()}
    bins, room, loose = [], [], []
    for b, items in enumerate(one[0]):
        if b in gone:
            loose += items
        else:
            bins.append(list(items))
            room.append(one[1][b])
    settle(lengths, loose, bins, room, p.size)
    return bins, room


def of_labels(lengths: list[int], labels, size: int) -> tuple[list[list[int]], list[int]]:
    bins: list[list[int]] = [[] for _ in range(max(labels, default=-1) + 1)]
    room = [size] * len(bins)
    for i, b in enumerate(labels):
        bins[b].append(i)
        room[b] -= lengths[i]
    return bins, room


def to_labels(bins: list[list[int]], n: int) -> list[int]:
    labels = [0] * n
    for b, items in enumerate(bins):
        for i in items:
            labels[i] = b
    return labels


def rated(x: tuple, size: int) -> tuple[int, float]:
    """Bins, then how evenly they are filled: less is better."""
    return len(x[0]), -round(fitness(x[1], size), 12)


def decreasing(lengths: list[int], size: int, rng: np.random.Generator | None = None) -> tuple[list[list[int]], list[int]]:
    """Best fit of all items, the longest first; with ``rng``, about in that order."""
    by = np.array(lengths, float) * (1 + (rng.normal(0, 0.05, len(lengths)) if rng else 0))
    bins, room = [], []
    best_fit(lengths, np.argsort(-by, kind="stable").tolist(), bins, room, size)
    return bins, room


def generations(lengths: list[int], people: list[tuple], bound: int, births: int, rng: np.random.Generator, p: Packing) -> tuple:
    """The best of a population after so many births. A child as good as one that lives is no gain and dies, so that the population does not become one."""
    people = people + [decreasing(lengths, p.size, rng) for _ in range(p.population - len(people))]
    ranked = sorted(((rated(x, p.size), n, x) for n, x in enumerate(people)), key=lambda r: r[:2])
    for n in range(births):
        if ranked[0][0][0] <= bound:
            break
        i, j = rng.choice(len(ranked), 2, replace=False).tolist()
        child = cross(lengths, ranked[i][2], ranked[j][2], rng, p)
        if rng.random() < 0.7:
            child = mutate(lengths, child, rng, p)
        rate = rated(child, p.size)
        if all(rate != r[0] for r in ranked):
            ranked = sorted([*ranked, (rate, len(people) + n, child)], key=lambda r: r[:2])[: p.population]
    return ranked[0][2]


def evolve(lengths: list[int], elites: list, seed: int, p: Packing) -> tuple[list[int], bool]:
    """An epoch on one island: the elite's bin of each item, and whether it meets the lower bound."""
    rng, bound = np.random.default_rng(seed), lower_bound(np.array(lengths, np.int64), p.size)
    people = [of_labels(lengths, e, p.size) for e in elites] or [decreasing(lengths, p.size)]
    if len(people) > 1 and min(len(x[0]) for x in people) > bound:
        people.append(cross(lengths, people[1], people[0], rng, p))
    people.sort(key=lambda x: rated(x, p.size))
    bins, room = people[0]
    if len(bins) > bound:
        if len(lengths) <= p.core:
            bins, room = generations(lengths, people, bound, min(p.births, p.work // max(len(lengths), 1)), rng, p)
        else:
            # the part to work on: bins with room, the fullest last, and then full ones as they are drawn
            order = np.lexsort((rng.random(len(bins)), -np.array(room))).tolist()
            held, part = 0, []
            for b in order:
                if held + len(bins[b]) > p.core:
                    break
                held += len(bins[b])
                part.append(b)
            items = [i for b in part for i in bins[b]]
            place = {i: n for n, i in enumerate(items)}
            sub = [lengths[i] for i in items]
            start = [[place[i] for i in bins[b]] for b in part], [room[b] for b in part]
            less = max(lower_bound(np.array(sub, np.int64), p.size), bound - len(bins) + len(part))
            new, left = generations(sub, [start], less, min(p.births, p.work // max(len(items), 1)), rng, p)
            rest = set(range(len(bins))) - set(part)
            bins, room = [bins[b] for b in rest] + [[items[n] for n in b] for b in new], [room[b] for b in rest] + left
    return to_labels(bins, len(lengths)), len(bins) <= bound


def pack(rows: DataFrame, p: Packing | None = None) -> DataFrame:
    """Adds sequence_id and offset to ``rows``, which need a column length of 1 to ``size``.

    Rows are told apart by their place in a written table, so ids may be null and rows repeated; rows of equal
    length are alike, and which goes where is by that place. Very long texts come as many full pieces, each a sequence
    by itself. Empty table: no rows. Other columns are kept, whatever their names, but sequence_id and offset, which
    are made anew.
    """
    p, spark = p or Packing(), rows.sparkSession
    scratch = Scratch(spark, "packing")
    named = [c for c in rows.columns if c.lower() not in ("sequence_id", "offset")]
    held = F.struct(*(F.col(f"`{c}`") for c in named)).alias("held")
    numbered = scratch.write(rows.select(held, F.col("length").cast("long").alias("length"), F.monotonically_increasing_id().alias("__row")))
    open_ = numbered.where(F.col("length") < p.size)
    groups = max(1, -(-open_.count() // p.group))
    # dealt by a hash of the row's number, which is even whatever the ids are
    group = F.pmod(F.xxhash64("__row"), F.lit(groups)).cast("int")
    problems = open_.select(group.alias("g"), "__row", "length").groupBy("g").agg(F.sort_array(F.collect_list(F.struct("__row", "length"))).alias("x"))
    problems = problems.select("g", F.col("x.__row").alias("rows"), F.col("x.length").alias("lengths"))
    islands = problems.select("g", F.explode(F.sequence(F.lit(0), F.lit(p.islands - 1))).alias("island"), "lengths").withColumn("elites", F.lit(None).cast("array<array<int>>")).withColumn("done", F.lit(False))
    schema = islands.schema

    def epoch(n: int):
        def run(frames):
            for f in frames:
                out = []
                for g, island, lengths, elites, done in f.itertuples(index=False):
                    lengths = [int(x) for x in lengths]
                    if not done:
                        elites = [list(map(int, e)) for e in elites] if elites is not None else []
                        labels, done = evolve(lengths, elites, p.seed + 1000 * n + 31 * int(g) + int(island), p)
                        elites = [labels]
                    else:
                        elites = [list(map(int, elites[0]))]
                    out.append((g, island, lengths, elites, done))
                yield pd.DataFrame(out, columns=["g", "island", "lengths", "elites", "done"])

        return run

    for n in range(p.epochs):
        if n:
            last = islands.select("g", F.pmod(F.col("island") + 1, F.lit(p.islands)).alias("island"), F.col("elites").alias("came"), F.col("done").alias("solved"))
            islands = islands.join(last, ["g", "island"]).select("g", "island", "lengths", F.when(F.col("solved"), F.col("came")).when(F.col("done"), F.col("elites")).otherwise(F.concat("elites", "came")).alias("elites"), (F.col("done") | F.col("solved")).alias("done"))
        # a given number of tasks, which adaptive execution leaves as it is
        islands = scratch.write(islands.repartition(min(groups * p.islands, p.tasks), F.col("g"), F.col("island")).mapInPandas(epoch(n), schema))
    best = islands.select("g", F.struct(F.array_max(F.element_at("elites", 1)).alias("bins"), "island", F.element_at("elites", 1).alias("labels")).alias("e"))
    best = best.groupBy("g").agg(F.min("e").alias("e"))
    placed = problems.join(best, "g").select("g", F.explode(F.arrays_zip("rows", "e.labels", "lengths")).alias("z"))
    placed = placed.select(F.col("z.rows").alias("__row"), (F.col("z.labels").cast("long") * groups + F.col("g")).alias("bin"), F.col("z.lengths").alias("len"))
    # a bin holds at most `size` pieces
    places = placed.groupBy("bin").agg(F.sort_array(F.collect_list(F.struct("__row", "len"))).alias("x"))
    upto = F.expr("transform(x, (r, i) -> struct(r.__row AS __at, aggregate(slice(x, 1, i), 0L, (a, b) -> a + b.len) AS offset))")
    places = places.select(F.col("bin"), F.explode(upto).alias("y")).select("bin", "y.__at", "y.offset")
    full = numbered.where(F.col("length") >= p.size).withColumn("sequence_id", -F.col("__row") - 1).withColumn("offset", F.lit(0).cast("long"))
    rest = open_.join(places, F.col("__row") == F.col("__at")).withColumnRenamed("bin", "sequence_id")
    columns = [*(F.col("held").getField(c).alias(c) for c in named), "sequence_id", "offset"]
    return full.select(columns).union(rest.select(columns))
