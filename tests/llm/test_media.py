import hashlib
import struct
import zlib

import numpy as np
import pytest

from recordloom.llm import media


def padded(text):
    raw = (text or "").encode()
    return raw + b" " * (-len(raw) % 192 if raw else 192)


def test_documents(spark, odd, none):
    stored = media.media_column(odd)
    assert [f.dataType.simpleString() for f in stored.schema if f.name == "media"] == ["binary"]
    rows = media.media_features(stored).collect()
    texts = [r.text for r in odd.collect()]
    assert len(rows) == len(texts)
    for r, t in zip(rows, texts, strict=True):
        p = padded(t)
        assert r.n_bytes == len((t or "").encode()) and r.payload_bytes == len(p)
        assert r.payload_sha256 == hashlib.sha256(p).hexdigest() and r.tail_crc32 == zlib.crc32(p[-16:])
        assert r.width == 1536 and r.height == 8 * len(p) // 192 and r.n_images == 1
    assert rows[0].feature == rows[1].feature and rows[0].media_sha256 == rows[4].media_sha256
    assert media.media_features(media.media_column(none)).count() == 0


def test_all_byte_values_and_long_payloads():
    rng = np.random.default_rng(1)
    for rows in (1, 2, 9, 300):
        p = rng.integers(0, 256, rows * 192).astype(np.uint8)
        (image,) = media.encode_images(p, [rows])
        (thumb,) = media.thumbnails(media.read_media(image))
        assert thumb.shape == (rows, 192) and thumb.tobytes() == p.tobytes()


def test_payload_over_one_image(monkeypatch, spark):
    monkeypatch.setattr(media, "MAX_ROWS", 3)
    p = np.frombuffer(padded("x" * 2000), np.uint8)
    parts = [3, 3, 3, 2]
    value = b"".join(media.encode_images(p, parts))
    images = media.read_media(value)
    assert len(images) == 4
    assert b"".join(t.tobytes() for t in media.thumbnails(images)) == p.tobytes()


def test_broken_media(spark):
    good = media.encode_images(np.full(192, 65, np.uint8), [1])[0]
    cases = [(1, None), (2, b""), (3, b"nonsense"), (4, good[:-10]), (5, good), (6, good.replace(b"\xff\xc0", b"\xff\xc2"))]
    rows = {r.id: r for r in media.media_features(spark.createDataFrame(cases, "id int, media binary")).collect()}
    assert rows[5].payload_sha256 == hashlib.sha256(b"A" * 192).hexdigest()
    for i in (1, 2, 3, 4, 6):
        assert rows[i].width is None and rows[i].feature is None
    assert rows[3].media_bytes == 8 and rows[1].media_bytes is None


def colour_jpeg(rng, width, height, restart):
    """A baseline file with three components, 4:2:0, AC coefficients and flat-length code tables; and its luminance DC values."""
    bits, levels = [], {}
    across, down = -(-width // 16), -(-height // 16)
    put = lambda v, n: bits.append((v, n))
    ac = [0x00, 0xF0, *(r << 4 | s for r in range(16) for s in range(1, 9))]
    code = {s: i for i, s in enumerate(ac)}
    out, before, n = b"", [0, 0, 0], 0

    def number(v):
        size = abs(v).bit_length()
        return size, v if v >= 0 else v + (1 << size) - 1

    def flush():
        text = "".join(format(v, f"0{n}b") for v, n in bits if n)
        text += "1" * (-len(text) % 8)
        raw = int(text, 2).to_bytes(len(text) // 8, "big") if text else b""
        bits.clear()
        return raw.replace(b"\xff", b"\xff\x00")

    for m in range(across * down):
        if restart and m and m % restart == 0:
            out += flush() + bytes([0xFF, 0xD0 + n % 8])
            before, n = [0, 0, 0], n + 1
        for c, blocks in ((0, 4), (1, 1), (2, 1)):
            for b in range(blocks):
                dc = int(rng.integers(-60, 60))
                size, extra = number(dc - before[c])
                before[c] = dc
                put(size, 4)
                put(extra, size)
                if c == 0:
                    levels[(m // across) * 2 + b // 2, (m % across) * 2 + b % 2] = dc
                k = 1
                while k < 64 and rng.random() < 0.7:
                    run = int(rng.integers(0, 20))
                    if k + run > 63:
                        break
                    while run > 15:
                        put(code[0xF0], 8)
                        run, k = run - 16, k + 16
                    v = int(rng.integers(1, 200)) * int(rng.choice([-1, 1]))
                    s, e = number(v)
                    put(code[run << 4 | s], 8)
                    put(e, s)
                    k += run + 1
                if k < 64:
                    put(code[0], 8)
    out += flush()
    seg = lambda m, body: struct.pack(">BBH", 0xFF, m, len(body) + 2) + body
    head = b"\xff\xd8" + seg(0xFE, b"a comment") + seg(0xDB, bytes([0, 16, *[3] * 63]))
    head += seg(0xC0, struct.pack(">BHHB", 8, height, width, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    head += seg(0xC4, bytes([0x00, *[0, 0, 0, 12], *[0] * 12, *range(12)])) + seg(0xC4, bytes([0x10, *[0] * 7, len(ac), *[0] * 8, *ac]))
    head += seg(0xDD, struct.pack(">H", restart)) if restart else b""
    head += seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
    grid = np.array([[levels[y, x] for x in range(across * 2)] for y in range(down * 2)])
    grid = grid[: -(-height // 8), : -(-width // 8)]
    return head + out + b"\xff\xd9", np.clip((grid * 16 + 4) // 8 + 128, 0, 255)


@pytest.mark.parametrize("restart", [0, 1, 3])
def test_reads_other_baseline_files(restart):
    rng = np.random.default_rng(restart)
    for width, height in ((16, 16), (33, 50), (100, 20)):
        data, want = colour_jpeg(rng, width, height, restart)
        images = media.read_media(data)
        assert (images[0][1]["width"], images[0][1]["height"]) == (width, height)
        (thumb,) = media.thumbnails(images)
        assert thumb.tolist() == want.tolist()
