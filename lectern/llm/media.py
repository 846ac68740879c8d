"""Media columns: Netpbm and BMP images in binary columns.

Images decode to numpy arrays, are area-resized through integral images, and yield
NPY tiles and difference hashes. ``text_media`` stores any text losslessly as an
8-bit grey image 64 samples wide in a binary column of a written table, and reads that
back.

Null text counts as empty and gives one row of zero samples; null, undecodable and empty
images (no rows or columns) give null tiles and hashes. Rows are independent, repeated ones
alike; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import map_batches, materialise

WIDTH, TILE = 64, 16
HEADER = re.compile(rb"(P[1-6])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:(?:\s|#[^\n]*\n)+(\d+))?")


def encode_pgm(image: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % image.shape[::-1] + image.astype(np.uint8).tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """An uncompressed 8-bit grey or 24-bit colour bitmap, bottom row first."""
    colour = image.ndim == 3
    height, width = image.shape[:2]
    rows = np.ascontiguousarray(image[::-1, :, ::-1] if colour else image[::-1], dtype=np.uint8).reshape(height, -1)
    rows = np.pad(rows, ((0, 0), (0, -rows.shape[1] % 4)))
    palette = b"" if colour else b"".join(bytes((i, i, i, 0)) for i in range(256))
    at = 54 + len(palette)
    head = struct.pack("<2sIHHI", b"BM", at + rows.size, 0, 0, at)
    return head + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24 if colour else 8, 0, rows.size, 2835, 2835, 0 if colour else 256, 0) + palette + rows.tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6: plain and raw bitmaps, grey maps and pixmaps; samples above 8 bits are big-endian."""
    if data[:2] in (b"P1", b"P4"):
        m = re.match(rb"(P[14])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s", data)
        kind, width, height, top = m[1], int(m[2]), int(m[3]), 1
        end = m.end()
    else:
        m = HEADER.match(data)
        kind, width, height, top = m[1], int(m[2]), int(m[3]), int(m[4])
        end = m.end() + 1
    if not 1 <= top <= 65535:
        raise ValueError("no such range of samples")
    depth = 3 if kind in (b"P3", b"P6") else 1
    count = width * height * depth
    if kind == b"P4":
        bits = np.unpackbits(np.frombuffer(data, np.uint8, height * ((width + 7) // 8), end).reshape(height, -1), axis=1)[:, :width]
        return (1 - bits) * 255
    if kind == b"P1":
        bits = np.array([c - 48 for c in data[end:] if c in b"01"][:count], dtype=np.uint8)
        return ((1 - bits) * 255).reshape(height, width)
    if kind in (b"P2", b"P3"):
        found = np.array(data[end:].split()[:count], dtype=np.int64)
    else:
        found = np.frombuffer(data, ">u2" if top > 255 else np.uint8, count, end)
    if top != 255:
        found = found.astype(np.int64) * 255 // top
    return found.astype(np.uint8).reshape((height, width, 3) if depth == 3 else (height, width))


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed bitmaps of 8 (with palette), 24 or 32 bits, either row order."""
    at, size, width, height = struct.unpack_from("<I", data, 10)[0], *struct.unpack_from("<Iii", data, 14)
    bits, packing = struct.unpack_from("<HI", data, 28)
    if packing not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError("unsupported bitmap")
    line = (width * bits + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, line * abs(height), at).reshape(abs(height), line)
    rows = rows[::-1] if height > 0 else rows
    if bits == 8:
        used = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.frombuffer(data, np.uint8, 4 * used, 14 + size).reshape(-1, 4)[:, 2::-1]
        index = rows[:, :width]
        return index if (palette == np.arange(used)[:, None]).all() else palette[index]
    return rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image.astype(np.float64) @ (0.299, 0.587, 0.114)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over the (fractional) source areas of the target samples, from an integral image."""
    h, w = image.shape
    sums = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(image, axis=0, dtype=np.float64), axis=1, out=sums[1:, 1:])

    def at(table: np.ndarray, edges: np.ndarray, axis: int) -> np.ndarray:
        low = np.minimum(edges.astype(np.intp), table.shape[axis] - 2)
        part = edges - low
        part = part[:, None] if axis == 0 else part
        return np.take(table, low, axis) * (1 - part) + np.take(table, low + 1, axis) * part

    box = at(at(sums, np.linspace(0, h, height + 1), 0), np.linspace(0, w, width + 1), 1)
    return np.diff(np.diff(box, axis=0), axis=1) * (height * width / (h * w))


def difference_hash(image: np.ndarray) -> str:
    """64 bits: whether each of 8 x 8 samples is darker than its right neighbour, as 16 hexadecimal digits."""
    small = np.round(area_resize(grey(image), 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy_tile(image: np.ndarray, side: int = TILE) -> bytes:
    """A side x side tile as the bytes of an NPY file."""
    out = io.BytesIO()
    np.save(out, np.clip(np.round(area_resize(grey(image), side, side)), 0, 255).astype(np.uint8))
    return out.getvalue()


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8")
    return len(raw), raw + bytes(WIDTH if not raw else -len(raw) % WIDTH)


def _store(batch) -> dict:
    pairs = [padded(t) for t in batch.column(1).to_pylist()]
    return {"doc_id": batch.column(0), "n_bytes": [n for n, _ in pairs], "media": [encode_pgm(np.frombuffer(p, np.uint8).reshape(-1, WIDTH)) for _, p in pairs]}


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text of docs(doc_id, text) as a grey image."""
    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _store, "doc_id long, n_bytes long, media binary")


#: What broken or empty images raise on the way.
UNDECODABLE = (ArithmeticError, AttributeError, IndexError, TypeError, ValueError, struct.error)


def _features(side: int, batch) -> dict:
    out: dict = {"tile": [], "dhash": []}
    for data in batch.column(1).to_pylist():
        try:
            image = decode(data)
            tile, dhash = npy_tile(image, side), difference_hash(image)
        except UNDECODABLE:
            tile = dhash = None
        out["tile"].append(tile)
        out["dhash"].append(dhash)
    return {"id": batch.column(0)} | out


def media_features(media: DataFrame, side: int = TILE) -> DataFrame:
    """id, tile (NPY bytes), dhash for each row of media(id, media); null where an image can't be decoded."""
    return map_batches(media.select(F.col("id").cast("long"), F.col("media").cast("binary")), partial(_features, side), "id long, tile binary, dhash string")


def _digest(batch) -> dict:
    names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    out: dict = {k: [] for k in names}
    for data in batch.column(2).to_pylist():
        image = decode(data)
        payload = image.tobytes()
        found = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest())
        for k, v in zip(names, (*found, f"{difference_hash(image)}:{zlib.crc32(npy_tile(image)):08x}"), strict=True):
            out[k].append(v)
    return {"doc_id": batch.column(0), "n_bytes": batch.column(1)} | out


def text_media(docs: DataFrame) -> DataFrame:
    """Each text stored in a written table, read back and described; feature is the difference hash and the crc32 of the NPY tile. No shuffle."""
    ddl = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_batches(materialise(store_texts(docs), "media"), _digest, ddl)
