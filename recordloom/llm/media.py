"""Media columns: payloads as baseline JPEG, read back as DC-only luminance thumbnails.

Writer: one payload byte is the grey value of a flat 8x8 block. With a DC step of 8 the block's only
coefficient is value - 128, so nothing is lost. 192 blocks make a row and one restart interval; a
payload over 8191 rows goes into further images, one after another in the same column value.

Reader: parses markers, removes stuffing, splits the scan at its restart markers, and Huffman-decodes
all intervals of all images of a batch in step in numpy. AC coefficients are skipped over, so it takes
other baseline files too (several components, sampling factors, no restart markers).

Defined cases: a null text counts as empty and an empty payload is one unit of 192 blanks; equal
texts give equal rows; a null or broken media value gives null dimensions and features, and the rest
of the batch is unharmed; extra columns are passed on unless they clash with the operator's own.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from recordloom.llm.common import pieces, text_bytes

UNIT = 192
MAX_ROWS = 8191

# The example luminance DC code lengths of the JPEG standard, as counts of codes of 1 to 16 bits.
DC_COUNTS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = tuple(range(12))
#: The writer's only AC symbol is the end of the block.
AC_COUNTS = (1, *[0] * 15)
AC_SYMBOLS = (0,)
ZIGZAG_FIRST = 0


def huffman_codes(counts, symbols) -> list[tuple[int, int, int]]:
    """(symbol, code, length) in the order of canonical codes."""
    out, code, at = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((symbols[at], code, length))
            code, at = code + 1, at + 1
        code <<= 1
    return out


@lru_cache(64)
def _lookup(counts: tuple, symbols: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Code length and symbol for each 16 bits that may come next; length 0: no code."""
    length, symbol = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.uint64)
    for s, code, n in huffman_codes(counts, symbols):
        a = code << (16 - n)
        length[a : a + (1 << (16 - n))] = n
        symbol[a : a + (1 << (16 - n))] = s
    return length, symbol


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(rows: int) -> bytes:
    return b"".join(
        (
            b"\xff\xd8",
            _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"),
            _segment(0xDB, bytes([0, 8, *[1] * 63])),
            _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, UNIT * 8, 1) + bytes([1, 0x11, 0])),
            _segment(0xC4, bytes([0x00, *DC_COUNTS, *DC_SYMBOLS])),
            _segment(0xC4, bytes([0x10, *AC_COUNTS, *AC_SYMBOLS])),
            _segment(0xDD, struct.pack(">H", UNIT)),
            _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
        )
    )


def encode_images(payload: np.ndarray, rows: list[int]) -> list[bytes]:
    """JPEG files of images with the given numbers of rows; payload has UNIT bytes for each row, one after another."""
    codes = {s: (c, n) for s, c, n in huffman_codes(DC_COUNTS, DC_SYMBOLS)}
    code = np.array([codes[i][0] for i in range(12)], np.int64)
    code_bits = np.array([codes[i][1] for i in range(12)], np.int64)
    levels = payload.astype(np.int16).reshape(-1, UNIT) - 128
    diff = np.diff(levels, axis=1, prepend=np.int16(0)).astype(np.int64)
    size = np.array([int(i).bit_length() for i in range(512)], np.int64)[np.abs(diff)]
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff)
    bits = code_bits[size] + size + 1  # the last one ends the block: code 0
    value = ((code[size] << size) | extra) << 1
    total = bits.sum(axis=1)
    row_bytes = (total + 7) // 8
    row_start = np.cumsum(row_bytes) - row_bytes
    pos = (row_start * 8)[:, None] + np.cumsum(bits, axis=1) - bits
    pad = row_bytes * 8 - total
    pos = np.concatenate([pos.ravel(), row_start * 8 + total])
    bits = np.concatenate([bits.ravel(), pad])
    value = np.concatenate([value.ravel(), (1 << pad) - 1]).astype(np.uint64)
    value <<= (64 - (pos & 31) - np.maximum(bits, 1)).astype(np.uint64)
    word, n = pos >> 5, int(row_bytes.sum() + 3) // 4 + 2
    words = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), n) + np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    data = words.astype(np.uint64).astype(">u4").view(np.uint8)[: int(row_bytes.sum())]
    stuffed = data == 0xFF
    row_of = np.repeat(np.arange(len(row_bytes)), row_bytes)
    to = np.arange(len(data)) + np.cumsum(stuffed) - stuffed + 2 * row_of
    row_out = np.add.reduceat(1 + stuffed.astype(np.int64), row_start) + 2
    out = np.zeros(int(row_out.sum()), np.uint8)
    out[to] = data
    row_end = np.cumsum(row_out)
    image_rows = np.array(rows)
    image_end = np.cumsum(image_rows)
    in_image = np.arange(len(row_out)) - np.repeat(image_end - image_rows, image_rows)
    marker = 0xD0 + in_image % 8
    marker[image_end - 1] = 0xD9
    out[row_end - 2], out[row_end - 1] = 0xFF, marker
    edge = [0, *row_end[image_end - 1].tolist()]
    view = out.tobytes()
    return [_header(r) + view[a:b] for r, a, b in zip(rows, edge, edge[1:], strict=False)]


class Broken(ValueError):
    """The bytes are no baseline JPEG that this reader knows."""


def parse(data: bytes, at: int = 0) -> tuple[dict, int]:
    """Frame, tables and scan of the image at data[at:], and where it ends. Only the scan with the first component is kept."""
    if data[at : at + 2] != b"\xff\xd8":
        raise Broken("no start of image")
    at += 2
    quant, huff, frame, restart, found = {}, {}, None, 0, None
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            if data[at : at + 2] != b"\xff\xd9":
                raise Broken("a marker is missing")
        marker = data[at + 1]
        if marker == 0xD9:
            if found is None:
                raise Broken("no scan")
            return found, at + 2
        if marker == 0xFF:
            at += 1
            continue
        n = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + n]
        if len(body) != n - 2:
            raise Broken("a segment is cut short")
        at += 2 + n
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = struct.unpack_from(">H", body, 1)[0] if wide else body[1]
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                counts = tuple(body[1:17])
                huff[body[0]] = (counts, tuple(body[17 : 17 + sum(counts)]))
                body = body[17 + sum(counts) :]
        elif marker in (0xC0, 0xC1):
            depth, height, width, parts = struct.unpack_from(">BHHB", body)
            if depth != 8 or not width or not height or len(body) != 6 + 3 * parts:
                raise Broken("frame")
            frame = (width, height, tuple((body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * parts, 3)))
        elif 0xC2 <= marker <= 0xCF and marker != 0xCC and marker != 0xC8:
            raise Broken("not baseline")
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            if frame is None:
                raise Broken("a scan before its frame")
            own = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            end = at
            while True:  # the scan ends at the first marker that is neither stuffing nor a restart
                end = data.find(b"\xff", end)
                if end < 0 or end + 1 >= len(data):
                    raise Broken("the scan has no end")
                if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                    end += 2
                else:
                    break
            if found is None and frame[2][0][0] in own:
                width, height, parts = frame
                parts = [p for p in parts if p[0] in own]
                try:
                    tables = tuple((h, v, huff[own[i] >> 4], huff[16 + (own[i] & 15)]) for i, h, v, _ in parts)
                    step = quant[parts[0][3]]
                except KeyError as e:
                    raise Broken(f"table {e} is missing") from e
                most = max(p[1] for p in frame[2]), max(p[2] for p in frame[2])
                if len(parts) == 1:  # blocks one after another, whatever the sampling factors
                    h, v = parts[0][1], parts[0][2]
                    tables = ((1, 1, *tables[0][2:]),)
                    across, down = -(-(-(-width * h // most[0])) // 8), -(-(-(-height * v // most[1])) // 8)
                else:
                    across, down = -(-width // (8 * most[0])), -(-height // (8 * most[1]))
                found = {"width": width, "height": height, "tables": tables, "step": step, "restart": restart, "across": across, "down": down, "scan": (at, end), "luma": (-(-(-(-width * frame[2][0][1] // most[0])) // 8), -(-(-(-height * frame[2][0][2] // most[1])) // 8))}
            at = end


def _decode_lanes(data: np.ndarray, start: np.ndarray, mcus: np.ndarray, tables: tuple) -> np.ndarray:
    """DC values of the first component's blocks, one row a lane. Lanes are sorted by falling mcus; data has 16 spare bytes."""
    u = np.uint64
    window = np.zeros(len(data) - 8, u)
    for j in range(8):
        window = (window << u(8)) | data[j : len(data) - 8 + j]
    per = tables[0][0] * tables[0][1]
    most = int(mcus[0])
    out = np.zeros((most * per, len(start)), np.int32)
    pos = start.astype(np.int64) * 8
    limit = (len(data) - 9) * 8
    before = [np.zeros(len(start), np.int64) for _ in tables]
    alive = np.searchsorted(-mcus, -np.arange(most), side="left")  # lanes that have an MCU with this number
    looked = [(_lookup(*dc), _lookup(*ac)) for _, _, dc, ac in tables]
    for m in range(most):
        n = int(alive[m])
        p = pos[:n]
        for c, (h, v, _, _) in enumerate(tables):
            (dc_len, dc_size), (ac_len, ac_symbol) = looked[c]
            for b in range(h * v):
                np.minimum(p, limit, out=p)
                w = window[p >> 3] << (p & 7).astype(u)
                at = (w >> u(48)).astype(np.int64)
                length, size = dc_len[at], dc_size[at]
                extra = ((w << length) >> u(1)) >> (u(63) - size)
                extra, size_i = extra.astype(np.int64), size.astype(np.int64)
                low = (1 << size_i) >> 1
                before[c][:n] += np.where(extra < low, extra - (1 << size_i) + 1, extra)
                if c == 0:
                    out[m * per + b, :n] = before[0][:n]
                length += size
                p += length.astype(np.int64)
                bad = dc_len[at] == 0
                left, k = None, None
                while True:  # pass over the AC coefficients
                    q = p if left is None else p[left]
                    w = window[np.minimum(q, limit) >> 3] << (q & 7).astype(u)
                    at = (w >> u(48)).astype(np.int64)
                    symbol = ac_symbol[at].astype(np.int64)
                    step = ac_len[at].astype(np.int64)
                    bad_now = step == 0
                    step += symbol & 15
                    if left is None:
                        p += step
                        more = symbol != 0
                        bad |= bad_now
                        if not more.any():
                            break
                        left = np.flatnonzero(more)
                        k = np.ones(len(left), np.int64) + (symbol[left] >> 4) + 1
                    else:
                        p[left] += step
                        bad[left[bad_now]] = True
                        keep = (symbol != 0) & ~bad_now
                        k = k[keep] + (symbol[keep] >> 4) + 1
                        left = left[keep]
                    keep = k <= 63
                    left, k = left[keep], k[keep]
                    if not len(left):
                        break
                if bad.any():
                    p[bad] = limit
    return out.T


def thumbnails(images: list[tuple[bytes, dict]]) -> list[np.ndarray]:
    """Each image's luminance as one grey value for each 8x8 block, from the DC coefficients alone."""
    out: list = [None] * len(images)
    alike = defaultdict(list)
    for i, (_, x) in enumerate(images):
        alike[x["tables"]].append(i)
    for tables, members in alike.items():
        scans = [np.frombuffer(images[i][0], np.uint8)[slice(*images[i][1]["scan"])] for i in members]
        sizes = np.array([len(s) for s in scans])
        data = np.concatenate([*scans, np.zeros(2, np.uint8)])
        first = np.cumsum(sizes) - sizes
        ff = np.flatnonzero(data[:-1] == 0xFF)
        after = data[ff + 1]
        marks = ff[(after >= 0xD0) & (after <= 0xD7)]
        gone = np.zeros(len(data), bool)
        gone[ff[after == 0] + 1] = True
        gone[marks] = gone[marks + 1] = True
        place = np.cumsum(~gone) - ~gone
        lane = np.sort(np.concatenate([first, marks + 2]))
        lanes_of = np.diff(np.searchsorted(lane, np.append(first, len(data)), side="left"))
        start = place[lane]
        data = np.concatenate([data[~gone], np.full(16, 0xFF, np.uint8)])
        mcus, lane_ok = [], True
        for i, n in zip(members, lanes_of.tolist(), strict=True):
            x = images[i][1]
            total, each = x["across"] * x["down"], x["restart"] or x["across"] * x["down"]
            want = -(-total // each)
            lane_ok &= want == n
            mcus += [each] * (want - 1) + [total - each * (want - 1)]
        if not lane_ok:
            if len(members) == 1:
                continue  # intervals are missing: no thumbnail
            for i in members:
                out[i] = thumbnails([images[i]])[0]
            continue
        mcus = np.array(mcus)
        order = np.argsort(-mcus, kind="stable")
        decoded = np.empty((len(mcus), int(mcus.max()) * tables[0][0] * tables[0][1]), np.int32)
        decoded[order] = _decode_lanes(data, start[order], mcus[order], tables)
        at = 0
        h, v = tables[0][:2]
        for i, n in zip(members, lanes_of.tolist(), strict=True):
            x = images[i][1]
            own = decoded[at : at + n]
            flat = np.concatenate([own[:-1].ravel(), own[-1, : mcus[at + n - 1] * h * v]])
            at += n
            grid = flat.reshape(x["down"], x["across"], v, h).transpose(0, 2, 1, 3).reshape(x["down"] * v, x["across"] * h)
            grid = grid[: x["luma"][1], : x["luma"][0]]
            out[i] = np.clip((grid * x["step"] + 4) // 8 + 128, 0, 255).astype(np.uint8)
    return out


def _means(grid: np.ndarray, n: int, axis: int) -> np.ndarray:
    size = grid.shape[axis]
    a = np.arange(n) * size // n
    b = np.maximum(a + 1, (np.arange(n) + 1) * size // n)
    total = np.concatenate([np.zeros_like(grid.take([0], axis)), grid.cumsum(axis)], axis)
    return (total.take(b, axis) - total.take(a, axis)) / (b - a).reshape((-1, 1) if axis == 0 else (1, -1))


def hashes(thumb: np.ndarray) -> tuple[str, str]:
    """Average hash and difference hash of a thumbnail: 64 bits each, in hex."""
    rows = _means(thumb.astype(np.float64), 8, 0)
    eight, nine = _means(rows, 8, 1), _means(rows, 9, 1)
    return np.packbits(eight >= eight.mean()).tobytes().hex(), np.packbits(nine[:, 1:] > nine[:, :-1]).tobytes().hex()


def media_column(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Replaces the text by its JPEG: adds n_bytes (of the text) and media (binary)."""
    keep = [c for c in df.columns if c not in (text, media, "n_bytes")]
    schema = T.StructType([f for f in df.schema if f.name in keep] + [T.StructField("n_bytes", T.LongType()), T.StructField(media, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text):
                offsets, data = text_bytes(piece.column(piece.schema.get_field_index(text)))
                sizes = np.diff(offsets)
                rows = np.maximum(1, -(-sizes // UNIT))
                payload = np.full(int(rows.sum()) * UNIT, 32, np.uint8)
                to = (np.cumsum(rows) - rows) * UNIT
                for a, b, n in zip(offsets.tolist(), to.tolist(), sizes.tolist(), strict=False):
                    payload[b : b + n] = data[a : a + n]
                parts = [(i, min(MAX_ROWS, r - a)) for i, r in enumerate(rows.tolist()) for a in range(0, r, MAX_ROWS)]
                made = [[] for _ in range(len(sizes))]
                for (i, _), image in zip(parts, encode_images(payload, [r for _, r in parts]), strict=True):
                    made[i].append(image)
                columns = {c: piece.column(piece.schema.get_field_index(c)) for c in keep}
                yield pa.RecordBatch.from_pydict(columns | {"n_bytes": pa.array(sizes, pa.int64()), media: pa.array([b"".join(x) for x in made], pa.binary())})

    return df.select(*keep, text).mapInArrow(run, schema)


def read_media(value: bytes | None) -> list[tuple[bytes, dict]] | None:
    """The images of one column value; None if it is null, empty or broken."""
    out, at = [], 0
    try:
        while value and at < len(value):
            found, at = parse(value, at)
            out.append((value, found))
    except (Broken, struct.error, IndexError):
        return None
    return out or None


def media_features(df: DataFrame, media: str = "media") -> DataFrame:
    """From stored images: width, height (of the first), n_images, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    own = {"width": T.IntegerType(), "height": T.IntegerType(), "n_images": T.IntegerType(), "payload_bytes": T.LongType(), "payload_sha256": T.StringType(), "tail_crc32": T.LongType(), "media_bytes": T.LongType(), "media_sha256": T.StringType(), "feature": T.StringType()}
    keep = [c for c in df.columns if c not in own and c != media]
    schema = T.StructType([f for f in df.schema if f.name in keep] + [T.StructField(n, t) for n, t in own.items()])

    def features(value: bytes | None, images: list | None, thumbs: list | None) -> tuple:
        if value is None:
            return (None,) * 9
        base = (len(value), hashlib.sha256(value).hexdigest())
        if not images or any(t is None for t in thumbs):
            return (None,) * 6 + base + (None,)
        payload = b"".join(t.tobytes() for t in thumbs)
        feature = "+".join(f"{x['width']}x{x['height']}:a{a}:d{d}" for (_, x), (a, d) in zip(images, map(hashes, thumbs), strict=True))
        first = images[0][1]
        return (first["width"], first["height"], len(images), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), *base, feature)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(media)).to_pylist()
            at = 0
            while at < len(values):
                to, held = at, 0
                while to < len(values) and (to == at or held < 2 << 20):
                    held += len(values[to] or b"")
                    to += 1
                images = [read_media(v) for v in values[at:to]]
                thumbs = iter(thumbnails([x for own_images in images for x in own_images or ()]))
                rows = [features(v, x, [next(thumbs) for _ in x or ()]) for v, x in zip(values[at:to], images, strict=True)]
                piece = batch.slice(at, to - at)
                columns = {c: piece.column(piece.schema.get_field_index(c)) for c in keep}
                kinds = [pa.int32()] * 3 + [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_pydict(columns | {n: pa.array(c, k) for n, k, c in zip(own, kinds, zip(*rows, strict=True), strict=True)})
                at = to

    return df.select(*keep, media).mapInArrow(run, schema)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents as JPEG, read back from the stored bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = media_features(media_column(docs))
    first = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return made.select(*first, *[c for c in made.columns if c not in first])
