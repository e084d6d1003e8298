"""GIF media columns: a writer, a full reader (LZW, palettes, disposal, transparency) and timed frames.

Reading follows the public GIF89a layout: logical screen, palettes, graphic control blocks, interlace,
LZW code streams of 2 to 12 bits with clear and end codes, and composition of frames on the screen.

Plan: Arrow maps only; a task holds one batch.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, texts_as_bytes

MAX_CODES = 4096
GREY = bytes(v for i in range(256) for v in (i, i, i))


class GifError(ValueError):
    """The bytes are not a GIF that can be read."""


def schedule(bits: int) -> np.ndarray:
    """Bit widths of the codes that follow a clear code, up to a full table; 12 from there on.

    The code after a clear adds no table entry, each later one adds one.
    """
    known = np.maximum(np.arange(MAX_CODES), 1) - 1 + (1 << bits) + 2
    return np.minimum(np.maximum(np.floor(np.log2(np.minimum(known, MAX_CODES))).astype(np.int64) + 1, bits + 1), 12)


SCHEDULES = {bits: schedule(bits) for bits in range(1, 12)}


def pack_codes(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes of 2 to 12 bits one after the other, least bit first."""
    ends = np.cumsum(widths)
    start = ends - widths
    value, byte, size = codes << (start & 7), start >> 3, int(-(-ends[-1] // 8))
    out = sum(np.bincount(byte + i, value >> 8 * i & 255, size + 2) for i in range(3))
    return out[:size].astype(np.uint8).tobytes()


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """LZW code stream of samples below ``1 << bits``, without the sub-block framing."""
    clear, end = 1 << bits, (1 << bits) + 1
    room = MAX_CODES - end - 1
    codes: list[int] = [clear]
    runs: list[int] = []
    put, begin = codes.append, 1
    seen: dict[int, int] = {}
    find, after, code = seen.get, end + 1, -1
    samples = iter(data)
    for code in samples:
        break
    for byte in samples:
        key = code << 8 | byte
        got = find(key)
        if got is None:
            put(code)
            if after < MAX_CODES:
                seen[key] = after
                after += 1
            else:
                put(clear)
                runs.append(len(codes) - begin)
                begin, after = len(codes), end + 1
                seen.clear()
            code = byte
        else:
            code = got
    if code >= 0:
        put(code)
    put(end)
    runs.append(len(codes) - begin)
    steps = SCHEDULES[bits]
    widths = np.concatenate([[bits + 1], *(steps[:n] for n in runs)])
    assert max(runs) <= room + 2
    return pack_codes(np.array(codes, np.int64), widths)


def lzw_codes(stream: bytes, bits: int, most: int):
    """The codes between clear codes, as arrays. Widths depend only on how many codes followed the last clear code."""
    clear, end, steps = 1 << bits, (1 << bits) + 1, SCHEDULES[bits]
    raw, n_bits = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64), 8 * len(stream)
    bit, run, held = 0, [], 0
    while True:
        widths = steps if not held else np.full(MAX_CODES, 12)
        ends = bit + np.cumsum(widths)
        n = int(np.searchsorted(ends, n_bits, "right"))
        start = ends[:n] - widths[:n]
        byte = start >> 3
        codes = (raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (start & 7) & ((1 << widths[:n]) - 1)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(stops[0]) if len(stops) else n
        run.append(codes[:stop])
        held += stop
        over = not n or stop == n < MAX_CODES or stop < n and codes[stop] == end or held > most
        if stop < n or over:
            yield np.concatenate(run)
            run, held = [], 0
        if over:
            return
        bit = int(ends[min(stop, n - 1)])


def lzw_decode(stream: bytes, bits: int, most: int) -> bytes:
    """Samples of an LZW code stream; stops at the end code, at the end of the data, or after ``most`` samples.

    Table entry ``end + 1 + j`` is the string of the j-th code after a clear code and the sample after it, and
    those stand one after the other in the output. So such a code copies from the output of code j, one sample
    more than that code gave. Lengths and sources are chains into earlier output, followed by doubling.
    """
    if not 1 <= bits <= 11:
        raise GifError(f"LZW code size {bits}")
    clear, first = 1 << bits, (1 << bits) + 2
    out, made = [], 0
    for codes in lzw_codes(stream, bits, most):
        if not len(codes):
            continue
        order = np.arange(len(codes))
        plain = codes < clear
        source = np.where(plain, order, codes - first)
        if (source[~plain] >= order[~plain]).any():
            raise GifError("code beyond the table")
        steps, to = np.where(plain, 0, 1), source
        while True:
            more = steps[to]
            if not more.any():
                break
            steps, to = steps + more, to[to]
        size = steps + 1
        place = np.cumsum(size) - size
        each = np.repeat(order, size)
        at = np.arange(len(each)) - place[each] + place[source[each]]
        while True:
            further = at[at]
            if (further == at).all():
                break
            at = further
        literal = np.zeros(len(each), np.uint8)
        literal[place[plain]] = codes[plain]
        out.append(literal[at].tobytes())
        made += len(each)
        if made >= most:
            break
    return b"".join(out)[:most]


def sub_blocks(data: bytes) -> bytes:
    return b"".join(bytes([min(255, len(data) - i)]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def write_gif(samples: bytes, width: int, rows: int, delay: int = 10) -> bytes:
    """Lossless GIF of 8-bit samples, ``width`` to a row, at most ``rows`` rows to a frame; grey palette, so grey = sample."""
    if not samples or len(samples) % width:
        raise ValueError("samples must fill whole rows")
    height = min(rows, len(samples) // width)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), GREY]
    if len(samples) > width * rows:
        out.append(b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0")
    for i in range(0, len(samples), width * rows):
        part = samples[i : i + width * rows]
        out += [struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, delay, 0, 0), struct.pack("<BHHHHB", 0x2C, 0, 0, width, len(part) // width, 0), b"\x08", sub_blocks(lzw_encode(part))]
    return b"".join([*out, b";"])


@dataclass
class Frame:
    """One timed frame: its own samples, where they stand, and the screen after composition (RGBA)."""

    delay: int
    disposal: int
    left: int
    top: int
    samples: np.ndarray
    screen: np.ndarray

    def histogram(self, levels: int = 4) -> np.ndarray:
        """Pixels of the visible screen by colour, ``levels`` steps to a channel."""
        step = (np.arange(256) * levels // 256).astype(np.int32)
        r, g, b = (step[self.screen[..., i]] for i in range(3))
        return np.bincount(((r * levels + g) * levels + b)[self.screen[..., 3] > 0], minlength=levels**3)


def palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 2 << (flags & 7)
    if at + 3 * n > len(data):
        raise GifError("cut short in a palette")
    return np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n


def read_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        if at >= len(data):
            raise GifError("cut short in a data block")
        n = data[at]
        if not n:
            return b"".join(parts), at + 1
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n


def frames(data: bytes):
    """Frames of a GIF, composed one after the other."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise GifError("no GIF header")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, shared = 13, None
    if flags & 0x80:
        shared, at = palette(data, at, flags)
    screen = np.zeros((height, width, 4), np.uint8)
    delay, disposal, clear_index = 0, 0, None
    while at < len(data) and data[at] != 0x3B:
        kind = data[at]
        if kind == 0x21 and at + 1 < len(data):
            label = data[at + 1]
            body, at = read_blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, struct.unpack_from("<H", body, 1)[0]
                clear_index = body[3] if body[0] & 1 else None
            continue
        if kind != 0x2C or at + 10 > len(data):
            raise GifError(f"unknown block {kind:#x}")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
        at, colours = at + 10, shared
        if flags & 0x80:
            colours, at = palette(data, at, flags)
        if colours is None or at >= len(data):
            raise GifError("no palette")
        bits = data[at]
        stream, at = read_blocks(data, at + 1)
        flat = np.frombuffer(lzw_decode(stream, bits, w * h), np.uint8)
        if len(flat) < w * h:
            raise GifError("too few samples")
        samples = flat.reshape(h, w)
        if flags & 0x40:
            plain = np.empty_like(samples)
            plain[np.r_[0:h:8, 4:h:8, 2:h:4, 1:h:2]] = samples
            samples = plain
        before = screen.copy() if disposal == 3 else None
        part = samples[: max(0, height - top), : max(0, width - left)]
        if part.size:
            area = screen[top : top + part.shape[0], left : left + part.shape[1]]
            shown = slice(None) if clear_index is None else part != clear_index
            if part[shown].size and int(part[shown].max()) >= len(colours):
                raise GifError("sample beyond the palette")
            area[shown] = np.c_[colours, np.full(len(colours), 255, np.uint8)][part[shown]]
        yield Frame(delay, disposal, left, top, samples, screen.copy())
        if disposal == 2:
            screen[top : top + h, left : left + w] = 0
        elif before is not None:
            screen = before
        delay, disposal, clear_index = 0, 0, None


def store(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 192, rows: int = 64) -> DataFrame:
    """(doc_id, n_bytes, media): each text as a GIF, padded with spaces to whole rows (at least one).

    Null text: as empty. Repeated rows: each stored alike. Empty table: no rows. A text of any length is
    stored whole, in as many frames as it takes.
    """
    part = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batch: pa.RecordBatch):
        for i in range(0, batch.num_rows, 256):
            some = batch.slice(i, 256)
            texts = texts_as_bytes(some.column(1))
            media = [write_gif(t + b" " * (max(width, -(-len(t) // width) * width) - len(t)), width, rows) for t in texts]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return map_arrow(part, run, T.StructType([part.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]))


def decode_frames(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """One row for each frame: key, frame, delay_ms, disposal, width, height, pixels (RGBA of the composed screen), histogram, error.

    A null or unreadable GIF gives one row with the frames read before the fault followed by ``error``.
    """
    part = media.select(F.col(key).alias("key"), F.col(column).alias("media"))

    def run(batch: pa.RecordBatch):
        for k, m in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            rows: list[tuple] = []
            try:
                for i, f in enumerate(frames(m or b"")):
                    rows.append((i, 10 * f.delay, f.disposal, f.screen.shape[1], f.screen.shape[0], f.screen.tobytes(), f.histogram().tolist(), None))
            except GifError as e:
                rows.append((len(rows), None, None, None, None, None, None, str(e)))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            types = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(rows), batch.column(0).type), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[key, "frame", "delay_ms", "disposal", "width", "height", "pixels", "histogram", "error"])

    made = T.StructType.fromDDL("frame int, delay_ms int, disposal int, width int, height int, pixels binary, histogram array<long>, error string")
    return map_arrow(part, run, T.StructType([T.StructField(key, part.schema["key"].dataType), *made.fields]))


def payload(data: bytes) -> tuple[bytes, int, int, np.ndarray]:
    """Samples read back from the frames' own area of the composed screen, frames, total delay (ms) and summed histogram."""
    parts, delay, total = [], 0, np.zeros(64, np.int64)
    for f in frames(data):
        h, w = f.samples.shape
        parts.append(f.screen[f.top : f.top + h, f.left : f.left + w, 0].tobytes())
        delay += 10 * f.delay
        total += f.histogram()
    return b"".join(parts), len(parts), delay, total


def digests(media: DataFrame) -> DataFrame:
    """Read stored texts back: payload and media digests and a feature of the frames.

    ``feature``: frames, milliseconds, and the grey levels of the colour histogram (4 steps). A null or unreadable GIF
    has null digests and the fault as ``error``. Equal GIFs, equal values; repeated rows give a row each. Media of
    any length are read whole. Extra columns are dropped. Empty table: no rows.
    """
    part = media.select("doc_id", "n_bytes", "media")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = [[] for _ in range(7)]
        for m in batch.column(2).to_pylist():
            try:
                data, n, delay, seen = payload(m or b"")
            except GifError as e:
                for c, v in zip(cols, (None, None, None, None, None, None, str(e)), strict=True):
                    c.append(v)
                continue
            feature = f"frames={n};ms={delay};grey={','.join(str(x) for x in seen[[0, 21, 42, 63]])}"
            for c, v in zip(cols, (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature, None), strict=True):
                c.append(v)
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]
        return pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", "n_bytes", *names])

    made = T.StructType.fromDDL("payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")
    return map_arrow(part, run, T.StructType([*part.schema.fields[:2], *made.fields]))
