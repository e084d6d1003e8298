import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from tessera.llm import gif

from .helpers import AWKWARD, docs


def image(samples, w, h, left=0, top=0, local=None, interlace=False, bits=8):
    flags = (0x40 if interlace else 0) | (0x80 | (len(local) // 3).bit_length() - 2 if local else 0)
    return struct.pack("<BHHHHB", 0x2C, left, top, w, h, flags) + (local or b"") + bytes([bits]) + gif.sub_blocks(gif.lzw_encode(bytes(samples), bits))


def control(disposal, delay=5, clear=None):
    return struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (clear is not None), delay, clear or 0, 0)


def movie(*blocks, w=2, h=2):
    return b"GIF89a" + struct.pack("<HHBBB", w, h, 0xF7, 0, 0) + gif.GREY + b"".join(blocks) + b";"


def grey(frame):
    return frame.screen[..., 0].tolist(), frame.screen[..., 3].tolist()


def test_lzw_round_trips():
    rng = random.Random(1)
    for bits in range(2, 9):
        for n in (0, 1, 2, 3, 255, 4096, 30_000):
            for kinds in (1, 2, 1 << bits):
                data = bytes(rng.randrange(min(kinds, 1 << bits)) for _ in range(n))
                assert gif.lzw_decode(gif.lzw_encode(data, bits), bits, n) == data


def test_lzw_table_that_stays_full():
    """A stream without further clear codes keeps 12-bit codes."""
    data = bytes(random.Random(2).randrange(256) for _ in range(6000))
    codes, seen, after, code = [256], {}, 258, data[0]
    for b in data[1:]:
        if (code, b) in seen:
            code = seen[code, b]
        else:
            codes.append(code)
            if after < 4096:
                seen[code, b] = after
                after += 1
            code = b
    codes += [code, 257]
    widths = np.concatenate([[9], gif.SCHEDULES[8], np.full(len(codes), 12)])[: len(codes)]
    assert gif.lzw_decode(gif.pack_codes(np.array(codes), widths), 8, len(data)) == data


@pytest.mark.parametrize("bad", [b"", b"GIF89a", b"notagif, not at all", movie(image([1, 2, 3], 2, 2)), movie(b"\x2c"), movie(b"\x99"), movie(image([1, 2, 3, 4], 2, 2))[:-12]])
def test_faults(bad):
    with pytest.raises(gif.GifError):
        list(gif.frames(bad))


def test_code_beyond_the_table():
    with pytest.raises(gif.GifError):
        gif.lzw_decode(gif.pack_codes(np.array([256, 65, 300]), np.array([9, 9, 9])), 8, 10)


def test_disposal_and_transparency():
    first = image([10, 20, 30, 40], 2, 2)
    for disposal, expected in ((1, [[99, 20], [30, 40]]), (2, [[99, 0], [0, 0]]), (3, [[99, 0], [0, 0]])):
        frames = list(gif.frames(movie(control(disposal), first, control(0, clear=7), image([99, 7, 7, 7], 2, 2))))
        assert grey(frames[0])[0] == [[10, 20], [30, 40]]
        assert grey(frames[1])[0] == expected
        assert frames[0].delay == 5 and frames[0].disposal == disposal


def test_offset_local_palette_and_interlace():
    red = bytes([0, 0, 0, 200, 0, 0, 0, 200, 0, 0, 0, 200])
    frame = next(gif.frames(movie(image([1, 2], 2, 1, left=1, top=1, local=red, bits=2), w=3, h=3)))
    assert frame.screen[1, 1:].tolist() == [[200, 0, 0, 255], [0, 200, 0, 255]]
    assert frame.screen[..., 3].sum() == 2 * 255
    rows = [0, 8, 4, 2, 6, 1, 3, 5, 7]
    frame = next(gif.frames(movie(image(rows, 1, 9, interlace=True), w=1, h=9)))
    assert frame.screen[:, 0, 0].tolist() == list(range(9))
    assert frame.histogram().sum() == 9


def test_query_on_awkward_rows(spark):
    texts = [*AWKWARD, (50, "frame " * 10_000)]
    got = gif.digests(gif.store(docs(spark, texts))).collect()
    assert len(got) == len(texts)
    for r, (i, t) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id, r.n_bytes)), sorted(texts, key=lambda x: (x[0] is None, x[0], len(x[1] or ""))), strict=True):
        raw = (t or "").encode()
        pad = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (r.doc_id, r.n_bytes, r.payload_bytes) == (i, len(raw), len(pad))
        assert r.payload_sha256 == hashlib.sha256(pad).hexdigest() and r.tail_crc32 == zlib.crc32(pad[-16:])
    assert gif.store(docs(spark, [])).count() == 0


def test_frames_table(spark):
    media = spark.createDataFrame([(1, movie(control(1, 7), image([1, 2, 3, 4], 2, 2), image([9, 9, 9, 9], 2, 2))), (2, b"broken"), (3, None)], "doc_id long, media binary")
    rows = sorted(gif.decode_frames(media).collect(), key=lambda r: (r.doc_id, r.frame))
    assert [(r.doc_id, r.frame, r.delay_ms, r.error is None) for r in rows] == [(1, 0, 70, True), (1, 1, 0, True), (2, 0, None, False), (3, 0, None, False)]
    assert sum(rows[0].histogram) == 4 and len(rows[0].pixels) == 16


def plain_read(data):
    """Another reader, bit by bit, for GIFs of whole frames and global grey palettes: samples and delays of the frames."""
    at, out, delay = 13 + 3 * (2 << (data[10] & 7)), [], 0
    while data[at] != 0x3B:
        if data[at] == 0x21:
            if data[at + 1] == 0xF9:
                delay = data[at + 4] | data[at + 5] << 8
            at += 2
            while data[at]:
                at += 1 + data[at]
            at += 1
            continue
        assert data[at] == 0x2C and not data[at + 9] & 0xC0
        least, at, packed = data[at + 10], at + 11, b""
        while data[at]:
            packed += data[at + 1 : at + 1 + data[at]]
            at += 1 + data[at]
        at += 1
        bits = "".join(f"{b:08b}"[::-1] for b in packed)
        clear, end = 1 << least, (1 << least) + 1
        width, place, table, last, samples = least + 1, 0, [], None, b""
        while True:
            code = int(bits[place : place + width][::-1], 2)
            place += width
            if code == end:
                break
            if code == clear:
                table, width, last = [bytes([i]) for i in range(clear)] + [b"", b""], least + 1, None
                continue
            entry = table[code] if code < len(table) else last + last[:1]
            if last is not None and len(table) < 4096:
                table.append(last + entry[:1])
            samples += entry
            last = entry
            if len(table) == 1 << width and width < 12:
                width += 1
        out.append((samples, delay))
    return out


def test_media_and_features_by_another_reader(spark):
    texts = [(1, "plain text, " * 40), (2, ""), (3, "É日👍 " * 3000), (4, "z" * 30_000)]
    stored = gif.store(docs(spark, texts))
    media = {r.doc_id: bytes(r.media) for r in stored.collect()}
    for r in gif.digests(stored).collect():
        frames = plain_read(media[r.doc_id])
        data = b"".join(s for s, _ in frames)
        raw = dict(texts)[r.doc_id].encode()
        assert data == raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert r.media_sha256 == hashlib.sha256(media[r.doc_id]).hexdigest() and r.media_bytes == len(media[r.doc_id])
        screen, shown = b"", b""
        for samples, _ in frames:
            screen = samples + screen[len(samples) :]
            shown += screen
        grey = ",".join(str(sum(k <= b < k + 64 for b in shown)) for k in (0, 64, 128, 192))
        assert r.feature == f"frames={len(frames)};ms={sum(10 * d for _, d in frames)};grey={grey}"


def test_digests_of_null_and_broken_media(spark):
    rows = spark.createDataFrame([(1, 5, None), (2, 5, b"broken"), (None, None, b"")], "doc_id long, n_bytes long, media binary")
    got = gif.digests(rows).collect()
    assert len(got) == 3 and all(r.error and r.payload_sha256 is None and r.feature is None for r in got)
