"""Questions of chunks to shards and the answers, as packed columns.

A chunk is a run of documents of bounded size that one row holds. A shard is a range of hashes. A question is one
row for a chunk and a shard: the chunk's distinct hashes in that range, sorted, with a few columns of numbers. A
shard merges all its questions and answers each chunk in the order of its question. Whatever a third of all
documents share is one entry for each chunk, and hashes are even, so no shard is hot and no key needs salting.

There are at most chunks x shards questions. Where a chunk has fewer hashes than there are shards, a question holds
a hash or two and the plan is as dear as one row for each hash, never dearer by more than a row's frame.
"""

from __future__ import annotations

import math
from itertools import pairwise

import numpy as np
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame


def squeeze(x: np.ndarray) -> bytes:
    """A column of numbers as zstandard of its byte planes."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def expand(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def squeeze_keys(keys: np.ndarray) -> bytes:
    """Sorted keys by their differences."""
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def expand_keys(data: bytes) -> np.ndarray:
    return np.cumsum(expand(data, np.uint64), dtype=np.uint64)


def by_shard(keys: np.ndarray, bits: int) -> list[tuple[int, slice]]:
    """The parts of sorted keys that belong to each of 2 ** ``bits`` shards."""
    shard = ((keys >> np.uint64(1)) >> np.uint64(63 - bits)).astype(np.int64)
    edge = np.flatnonzero(np.diff(shard, prepend=-1, append=1 << 62))
    return [(int(shard[a]), slice(a, b)) for a, b in pairwise(edge.tolist())]


def shard_bits(size: float, shard: int) -> int:
    """2 ** bits is as many shards as keep ``shard`` of the whole ``size`` to each."""
    return max(0, math.ceil(math.log2(max(size, 1) / shard)))


#: Tasks that questions and chunks are dealt to, at most.
TASKS = 20_000


def dealt(rows: DataFrame, size: float, *keys: str) -> DataFrame:
    """``rows`` dealt by the keys to about ``size`` tasks: as the input grows, tasks grow in number and not in size."""
    return rows.repartition(int(min(max(size, 1), TASKS)), *keys)


def first_chunk() -> int:
    """The number of the first chunk of this task; a written chunk comes from one attempt, so numbers hold once written."""
    return TaskContext.get().partitionId() << 33
