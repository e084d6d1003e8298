"""Quality rules by compression bands.

Text that zstandard shrinks far more than prose of its length is repetitive or templated; text that it
hardly shrinks is noise (keys, encoded data). Short texts shrink less than long ones, so the limits
depend on length: they are given at powers of two and interpolated in between. The whole document is
judged first, then its fixed-size chunks, which finds a bad region inside a long good text. The last chunk
is the final ``chunk`` bytes, overlapping the one before, so that every byte of a text of a chunk or more is judged.

Plan: one Arrow map over the documents, no shuffle; a task holds one batch.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import apart, map_arrow, texts_as_bytes


@dataclass(frozen=True)
class Bands:
    """Limits on compressed size / size. ``limits``: (log2 of bytes, least, most), interpolated linearly.

    More than ``most_bad`` bad chunks, or more than the share ``bad_chunks`` of them, reject a text.
    ``least`` lies 0.005 to 0.02 under the 0.1 % quantile, at that length, of the ratios of a training fold of
    documents labelled as good (crc32 of the id even, 64 to 16,384 bytes; beyond, carried on with a wider
    margin). ``most`` lies above the highest ratio of ordinary prose in several languages, with a margin.
    """

    level: int = 3
    chunk: int = 4096
    chunk_least: float = 0.435
    chunk_most: float = 0.70
    bad_chunks: float = 0.05
    most_bad: int = 1
    limits: tuple[tuple[float, float, float], ...] = (
        (5, 0.80, 2.00),
        (6, 0.78, 1.80),
        (7, 0.70, 1.35),
        (8, 0.632, 1.10),
        (8.5, 0.596, 1.025),
        (9, 0.565, 0.95),
        (9.5, 0.519, 0.90),
        (10, 0.495, 0.85),
        (10.5, 0.480, 0.805),
        (11, 0.468, 0.76),
        (11.5, 0.451, 0.73),
        (12, 0.442, 0.70),
        (12.5, 0.430, 0.69),
        (13, 0.421, 0.68),
        (13.5, 0.414, 0.67),
        (14, 0.407, 0.66),
        (15, 0.385, 0.65),
        (16, 0.370, 0.65),
        (20, 0.30, 0.65),
    )

    def of(self, n_bytes: int) -> tuple[float, float]:
        x = math.log2(max(n_bytes, 1))
        at, least, most = zip(*self.limits, strict=True)
        return float(np.interp(x, at, least)), float(np.interp(x, at, most))


WHITE = re.compile(rb"[\x20\x09-\x0d]+")
SYMBOLS = b"#*$%&|<>"
WINDOW = 5


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a UTF-8 text.

    Words are runs of anything but ASCII white space (what ``bytes.split`` cuts at).
    """
    words = text.split()
    n = len(words)
    packed = np.frombuffer(b"".join(words), np.uint8)
    chars = len(packed) - int(((packed & 0xC0) == 0x80).sum())
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if n >= WINDOW:
        windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
        if len(seen := Counter(windows)) < len(windows):
            covered = bytearray(n)
            for i, w in enumerate(windows):
                if seen[w] > 1:
                    covered[i : i + WINDOW] = b"\x01" * WINDOW
            repeated = covered.count(1)
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def judge(text: bytes, bands: Bands, zip_: zstandard.ZstdCompressor) -> tuple[float, int, int, str | None]:
    """Whole-document ratio, chunks (the tail's included), bad chunks, and why the text is rejected (None: it is not).

    An empty text has ratio 1 and is not rejected here.
    """
    if not text:
        return 1.0, 0, 0, None
    ratio = len(zip_.compress(text)) / len(text)
    least, most = bands.of(len(text))
    starts = list(range(0, len(text) - bands.chunk + 1, bands.chunk))
    if starts and len(text) % bands.chunk:
        starts.append(len(text) - bands.chunk)
    chunks, bad = len(starts), 0
    for i in starts:
        r = len(zip_.compress(text[i : i + bands.chunk])) / bands.chunk
        bad += not bands.chunk_least <= r <= bands.chunk_most
    why = "repetitive" if ratio < least else "incompressible" if ratio > most else "chunks" if bad > min(bands.most_bad, bands.bad_chunks * chunks) else None
    return ratio, chunks, bad, why


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long, reason string"


def compression_bands(docs: DataFrame, text: str = "text", keep: list[str] | None = None, bands: Bands | None = None, prefix: str = "") -> DataFrame:
    """Measures and a verdict for each row of ``docs``; one row out for each row in.

    ``keep``: columns carried along; all others are dropped. The results' names begin with ``prefix``, which sets
    them apart from kept columns of the same name.
    Null text: as empty (no words, so ``base_failed``). Repeated rows: each is judged alike. A ratio that equals
    a limit is within it. Empty table: no rows. Very long texts are read whole.
    """
    keep, bands = keep or [], bands or Bands()
    part = docs.select(*keep, docs[text].alias(f"{apart(docs.columns)}text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        zip_, cols = zstandard.ZstdCompressor(level=bands.level), [[] for _ in range(11)]
        for t in texts_as_bytes(batch.column(batch.num_columns - 1)):
            base = base_counts(t)
            failed = base[0] < 10 or 100 * base[4] > 20 * base[0]
            ratio, chunks, bad, why = judge(t, bands, zip_)
            for c, v in zip(cols, (*base, failed, not failed and why is None, ratio, chunks, bad, "base" if failed else why), strict=True):
                c.append(v)
        types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[*keep, *names])

    made = [T.StructField(prefix + f.name, f.dataType) for f in T.StructType.fromDDL(SCHEMA).fields]
    names = [f.name for f in made]
    return map_arrow(part, run, T.StructType([*part.schema.fields[:-1], *made]))
