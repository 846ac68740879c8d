import hashlib
import io
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import media

GREY = np.array([[0, 50, 100], [150, 200, 255]], dtype=np.uint8)
COLOUR = np.arange(18, dtype=np.uint8).reshape(2, 3, 3) * 14


def bmp(bits, rows, palette=b"", height=2, width=3):
    at = 54 + len(palette)
    body = b"".join(r + bytes(-len(r) % 4) for r in rows)
    return struct.pack("<2sIHHI", b"BM", at + len(body), 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, bits, 0, len(body), 0, 0, len(palette) // 4, 0) + palette + body


def cases():
    reverse = [bytes(c for p in row for c in p[::-1]) for row in COLOUR]
    wide = [bytes(c for p in row for c in (*p[::-1], 9)) for row in COLOUR]
    colours = [(10, 20, 30), (40, 50, 60), (70, 80, 90)]
    palette = b"".join(bytes((b, g, r, 0)) for r, g, b in colours)
    index = [bytes((0, 1, 2)), bytes((2, 1, 0))]
    return {
        "plain bits": (b"P1 # c\n3 2\n1 0 1\n011\n", np.array([[0, 255, 0], [255, 0, 0]])),
        "bits": (b"P4\n3 2\n" + bytes((0b10100000, 0b01100000)), np.array([[0, 255, 0], [255, 0, 0]])),
        "plain grey": (b"P2\n# c\n3 2 255\n0 50 100\n150 200 255\n", GREY),
        "plain grey to ten": (b"P2 3 2 10 0 1 2 5 9 10", np.array([[0, 25, 51], [127, 229, 255]])),
        "grey": (b"P5\n3 2\n255\n" + GREY.tobytes(), GREY),
        "grey of 16 bits": (b"P5 3 2 65535\n" + (GREY.astype(">u2") * 257).tobytes(), GREY),
        "plain colour": (b"P3 3 2 255 " + b" ".join(b"%d" % c for c in COLOUR.ravel()), COLOUR),
        "colour": (b"P6 3 2 255\n" + COLOUR.tobytes(), COLOUR),
        "bitmap of 24 bits": (bmp(24, reverse[::-1]), COLOUR),
        "bitmap of 32 bits": (bmp(32, wide[::-1]), COLOUR),
        "bitmap from the top": (bmp(24, reverse, height=-2), COLOUR),
        "bitmap with a palette": (bmp(8, index[::-1], palette), np.array([[colours[i] for i in row] for row in index])),
    }


@pytest.mark.parametrize("name", cases())
def test_formats_decode(name):
    data, image = cases()[name]
    assert np.array_equal(media.decode(data), image)


def area_plainly(image, height, width):
    """Means over source areas, sample by sample."""
    h, w = image.shape
    out = np.zeros((height, width))
    for y in range(height):
        for x in range(width):
            total = 0.0
            for i in range(h):
                for j in range(w):
                    a = max(0, min((y + 1) * h / height, i + 1) - max(y * h / height, i))
                    b = max(0, min((x + 1) * w / width, j + 1) - max(x * w / width, j))
                    total += image[i, j] * a * b
            out[y, x] = total / (h / height * w / width)
    return out


def features_plainly(image, side=media.TILE):
    plain = image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])
    small = np.round(area_plainly(plain, 8, 9), 6)
    bits = "".join("1" if small[y, x + 1] > small[y, x] else "0" for y in range(8) for x in range(8))
    return np.clip(np.round(area_plainly(plain, side, side)), 0, 255).astype(np.uint8), f"{int(bits, 2):016x}"


def test_features_of_images(spark):
    found = cases()
    broken = [None, b"", b"P5 0 0 255\n", b"P5 3 2 255\n\x00", b"P5 3 2 0\n" + bytes(6), b"P6", b"BM", b"BM" + bytes(60), b"P2 2 2 255 1 2 3", b"P5 99999999 99999999 255\n1", b"P1 3 3 1 0", b"P9 1 1 1", b"GIF89a"]
    rows = [(i, d) for i, (d, _) in enumerate(found.values())] + [(100 + i, d) for i, d in enumerate(broken)] + [(0, found["plain bits"][0])]
    df = spark.createDataFrame(rows, "id long, media binary").withColumn("tile", F.lit(1))
    out = media.media_features(df).collect()
    assert len(out) == len(rows) and media.media_features(df.limit(0)).collect() == []
    by = {r.id: r for r in out}
    assert all(by[100 + i].tile is None and by[100 + i].dhash is None for i in range(len(broken)))
    for i, (_, image) in enumerate(found.values()):
        tile, dhash = features_plainly(image.astype(float))
        got = np.load(io.BytesIO(by[i].tile))
        assert got.shape == (16, 16) and np.abs(got.astype(int) - tile).max() <= 1 and by[i].dhash == dhash


def test_texts_equal_a_plain_computation(spark, docs_of):
    texts = [None, "", "é" * 33, "x" * 64, "a line\n" * 300, "\x00\x01", "x" * 64]
    docs = docs_of(texts).withColumn("feature", F.lit("x")).withColumn("media", F.lit(1))
    rows = {r.doc_id: r for r in media.text_media(docs).collect()}
    assert len(rows) == len(texts) and media.text_media(docs.limit(0)).collect() == []
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)
        stored = b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
        image = np.frombuffer(payload, np.uint8).reshape(-1, 64).astype(float)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        dhash, tile = r.feature.split(":")
        assert dhash == features_plainly(image)[1] and len(tile) == 8
    assert tuple(rows[3])[1:] == tuple(rows[6])[1:]
