"""Media columns: Netpbm and BMP images as numpy arrays, resized by area, written as NPY tiles with difference hashes.

Native code isn't asked for here: decoding is byte work, done per row in numpy on Arrow batches, without a shuffle.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import ship, table

#: Most pixels that a header may claim, against forged sizes.
MOST_PIXELS = 1 << 31


class MediaError(ValueError):
    """The bytes are no image of the kinds that are read here."""


# --- Netpbm ---------------------------------------------------------------------------------------------------------


def encode_pgm(a: np.ndarray) -> bytes:
    """8-bit grey samples (h, w) as binary PGM."""
    return b"P5\n%d %d\n255\n" % (a.shape[1], a.shape[0]) + np.ascontiguousarray(a, np.uint8).tobytes()


def encode_ppm(a: np.ndarray) -> bytes:
    return b"P6\n%d %d\n255\n" % (a.shape[1], a.shape[0]) + np.ascontiguousarray(a, np.uint8).tobytes()


def _header(b: bytes, n: int) -> tuple[list[int], int]:
    """The n numbers after the magic, comments skipped, and where the samples start."""
    out: list[int] = []
    i = 2
    while len(out) < n:
        while i < len(b) and (b[i : i + 1].isspace() or b[i] == 35):
            if b[i] == 35:
                i = b.find(b"\n", i)
                if i < 0:
                    raise MediaError("header ends in a comment")
            i += 1
        j = i
        while j < len(b) and 48 <= b[j] <= 57:
            j += 1
        if j == i or j - i > 9:
            raise MediaError("number expected in the header")
        out.append(int(b[i:j]))
        i = j
    return out, i + 1


def decode_netpbm(b: bytes) -> np.ndarray:
    """P1 to P6; (h, w) for bitmaps and grey, (h, w, 3) for colour. Bitmaps become 0 (black) and 255."""
    kind = b[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise MediaError("no Netpbm magic")
    bitmap, planes = kind in (b"P1", b"P4"), 3 if kind in (b"P3", b"P6") else 1
    numbers, at = _header(b, 2 if bitmap else 3)
    w, h, top = [*numbers, 1][:3]
    if not 0 < w * h * planes <= MOST_PIXELS or not 0 < top < 65536:
        raise MediaError("bad size or maximum")
    if kind == b"P4":
        row = (w + 7) // 8
        raw = np.frombuffer(b, np.uint8, -1, at)
        if len(raw) < row * h:
            raise MediaError("too few samples")
        return (1 - np.unpackbits(raw[: row * h].reshape(h, row), axis=1)[:, :w]) * np.uint8(255)
    if kind in (b"P5", b"P6"):
        n, wide = w * h * planes, top > 255
        if len(b) - at < n * (1 + wide):
            raise MediaError("too few samples")
        a = np.frombuffer(b, ">u2" if wide else np.uint8, n, at)
    else:
        body = re.sub(rb"#[^\r\n]*", b"", b[at - 1 :])
        found = list(body.translate(None, b" \t\r\n\v\f")) if bitmap else body.split()
        if len(found) < w * h * planes:
            raise MediaError("too few samples")
        found = found[: w * h * planes]
        if not bitmap and not all(x.isdigit() and len(x) < 10 for x in found):
            raise MediaError("a sample is no number")
        a = np.array(found, dtype=np.int64)
        a = a - 48 if bitmap else a
    if len(a) and not 0 <= int(a.min()) <= int(a.max()) <= top:
        raise MediaError("a sample is above the maximum")
    if bitmap:
        a = (1 - a) * 255
    elif top != 255:
        a = (a.astype(np.int64) * 255 + top // 2) // top
    return a.astype(np.uint8).reshape((h, w, 3) if planes == 3 else (h, w))


# --- BMP ------------------------------------------------------------------------------------------------------------


def encode_bmp(a: np.ndarray) -> bytes:
    """(h, w) as 8 bits with a grey palette, (h, w, 3) as 24 bits; bottom row first, rows padded to 4 bytes."""
    h, w = a.shape[:2]
    grey = a.ndim == 2
    line = w * (1 if grey else 3)
    rows = np.zeros((h, (line + 3) // 4 * 4), np.uint8)
    rows[:, :line] = (a if grey else a[:, :, ::-1].reshape(h, line))[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4) * np.array([1, 1, 1, 0], np.uint8) if grey else np.zeros((0, 4), np.uint8)
    at = 54 + palette.size
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", at + rows.size, 0, 0, at, 40, w, h, 1, 8 if grey else 24, 0, rows.size, 2835, 2835, len(palette), 0)
    return head + palette.tobytes() + rows.tobytes()


def decode_bmp(b: bytes) -> np.ndarray:
    """Uncompressed 1, 4, 8, 24 and 32 bits; grey (h, w) when the palette is grey, else (h, w, 3)."""
    if len(b) < 54 or b[:2] != b"BM":
        raise MediaError("no BMP magic")
    at, size, w, h, _, bits, packed = struct.unpack_from("<I I i i H H I", b, 10)
    flip, h = h > 0, abs(h)
    if packed not in (0, 3) or bits not in (1, 4, 8, 24, 32) or not 0 < w * h <= MOST_PIXELS:
        raise MediaError("BMP kind is not read")
    line = (w * bits + 31) // 32 * 4
    if len(b) < at + line * h:
        raise MediaError("too few samples")
    rows = np.frombuffer(b, np.uint8, line * h, at).reshape(h, line)
    rows = rows[::-1] if flip else rows
    if bits >= 24:
        return rows[:, : w * bits // 8].reshape(h, w, bits // 8)[:, :, 2::-1].copy()
    colours = struct.unpack_from("<I", b, 46)[0] or 1 << bits
    palette = np.zeros((256, 3), np.uint8)
    own = np.frombuffer(b, np.uint8, min(colours, 256) * 4, 14 + size).reshape(-1, 4)
    palette[: len(own)] = own[:, 2::-1]
    bit = np.unpackbits(rows, axis=1).reshape(h, -1, bits) if bits < 8 else None
    index = rows[:, :w] if bit is None else (bit @ (1 << np.arange(bits)[::-1]))[:, :w]
    a = palette[index]
    return a[:, :, 0].copy() if (own[:, 0] == own[:, 1]).all() and (own[:, 1] == own[:, 2]).all() else a


def decode(b: bytes) -> np.ndarray:
    return decode_bmp(b) if b[:2] == b"BM" else decode_netpbm(b)


# --- pixels ---------------------------------------------------------------------------------------------------------


def integral_rows(a: np.ndarray, rows: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """Rows of the integral image of (h, w, planes) samples, with a zero column in front: sums over all samples above each of
    `rows` (ascending, 0 to h). Runs down the image in bands of about `most` samples, so a tall image needs no more memory."""
    out = np.zeros((len(rows), a.shape[1] + 1, a.shape[2]))
    band, so_far = max(1, most // max(1, a.shape[1] * a.shape[2])), np.zeros(a.shape[1:])
    for top in range(0, a.shape[0], band):
        part = a[top : top + band]
        own = np.flatnonzero((rows > top) & (rows <= top + len(part)))
        total = np.cumsum(part, 0, dtype=np.float64)
        out[own, 1:] = so_far + total[rows[own] - top - 1]
        so_far = so_far + total[-1]
    return np.cumsum(out, 1)


def resize_area(a: np.ndarray, h: int, w: int) -> np.ndarray:
    """Mean over the area that each target pixel covers, from an integral image with linear interpolation at edges.

    Exact for any ratio: the integral image is piecewise linear between samples. Returns float64.
    """
    a = a[:, :, None] if a.ndim == 2 else a
    rows, cols = a.shape[:2]

    def at(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i = np.minimum(x.astype(np.int64), n - 1)
        return i, i + 1, x - i

    i, j, f = at(np.linspace(0, rows, h + 1), rows)
    need = np.unique(np.concatenate([i, j]))
    total, f = integral_rows(a, need), f[:, None, None]
    total = total[np.searchsorted(need, i)] * (1 - f) + total[np.searchsorted(need, j)] * f
    i, j, f = at(np.linspace(0, cols, w + 1), cols)
    f = f[None, :, None]
    t = total[:, i] * (1 - f) + total[:, j] * f
    out = (t[1:, 1:] - t[:-1, 1:] - t[1:, :-1] + t[:-1, :-1]) / (rows / h * cols / w)
    return out[:, :, 0] if out.shape[2] == 1 else out


def grey(a: np.ndarray) -> np.ndarray:
    return a if a.ndim == 2 else a @ np.array([0.299, 0.587, 0.114])


def dhash(a: np.ndarray) -> str:
    """64 bits, 16 hex digits: whether each of 8 x 9 area means is below its right neighbour."""
    small = np.round(resize_area(grey(a), 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def tile(a: np.ndarray, side: int = 16) -> bytes:
    """Area-resized to side x side, rounded to 8 bits, as an NPY file (version 1.0)."""
    out = io.BytesIO()
    small = np.clip(np.rint(resize_area(a, side, side)), 0, 255).astype(np.uint8)
    np.lib.format.write_array(out, np.ascontiguousarray(small), version=(1, 0), allow_pickle=False)
    return out.getvalue()


# --- columns --------------------------------------------------------------------------------------------------------


def pad(b: bytes, unit: int = 64) -> bytes:
    return b + bytes(max(unit, -(-len(b) // unit) * unit) - len(b))


def store(docs: DataFrame, key: str = "doc_id", text: str = "text", kind: str = "pgm", width: int = 64) -> DataFrame:
    """(key, n_bytes, media): each text's UTF-8 bytes, zero-padded to rows of `width` samples, as a grey image.

    Null and empty texts become one row of zeros. Other columns are left out, so clashing names cannot matter.
    """
    encode = {"pgm": encode_pgm, "bmp": encode_bmp}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [x.as_buffer() if x.is_valid else b"" for x in b.column(1)]
            media = [encode(np.frombuffer(pad(bytes(x), width), np.uint8).reshape(-1, width)) for x in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], ["key", "n_bytes", "media"])

    kind_of_key = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {kind_of_key}, n_bytes long, media binary").withColumnRenamed("key", key)


def features(media: DataFrame, key: str = "doc_id", column: str = "media", side: int = 16) -> DataFrame:
    """Decodes an image column: (key, width, height, payload, tile, dhash, error), payload being the samples as read.

    Broken, null or foreign bytes give nulls and a message in `error`; they never end the job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in b.column(1):
                try:
                    if not x.is_valid:
                        raise MediaError("null")
                    a = decode(x.as_py())
                    rows.append((a.shape[1], a.shape[0], a.tobytes(), tile(a, side), dhash(a), None))
                except (MediaError, ArithmeticError, LookupError, MemoryError, ValueError, struct.error) as e:
                    rows.append((None, None, None, None, None, str(e)))
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["key", "width", "height", "payload", "tile", "dhash", "error"])

    kind_of_key = media.schema[key].dataType.simpleString()
    return media.select(media[key].alias("key"), media[column].alias("media")).mapInArrow(run, f"key {kind_of_key}, width int, height int, payload binary, tile binary, dhash string, error string").withColumnRenamed("key", key)


def media_digest(docs: DataFrame, kind: str = "pgm") -> DataFrame:
    """Stores each text as an image, reads the stored bytes back and describes both; one row per row of docs.

    The stored column goes on through the same read-back as `features`; digests are of what was read, not of the source.
    """
    stored = store(docs, kind=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for x in b.column(2):
                m = x.as_py()
                a = decode(m)
                payload = a.tobytes()
                npy = tile(a)
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), f"{dhash(a)}:{hashlib.sha256(npy).hexdigest()[:16]}"))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return stored.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents stored as an image and read back, as media_digest; feature: difference hash and tile digest."""
    ship(spark)
    return media_digest(table(spark, sf_dir, "documents"))
