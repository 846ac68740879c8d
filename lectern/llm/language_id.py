"""Language identification by nearest centroid.

Texts become TF-IDF vectors of hashed character n-grams, normalised to length one; the
vectors of each language are clustered into a few centroids; a text gets the language
of the nearest centroid by cosine. A text farther from it than nearly all training
texts of that centroid is marked as rejected.

Document frequencies are counted over all training rows; the centroids are fitted on a
bounded sample of each language's rows, so that rare languages are learned too. Only the
text enters a prediction. Null texts and texts without a letter get ``und`` and score 0;
so does everything if there is no training row. Rows are independent, repeated ones count
once in the sample; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import bounded_sample, id_crc, map_batches

DIM, GRAMS, CENTROIDS = 2048, (1, 2, 3), 4
#: About this many training rows of each language fit its centroids; share of them within the rejection distance.
TRAINING_ROWS, WITHIN = 1000, 0.995
STEP = np.uint32(0x9E3779B1)


def gram_counts(text: str | None) -> np.ndarray:
    """Counts of the text's hashed n-grams (lower case, letters and single breaks only); all zero without a letter."""
    code = np.frombuffer(letters(text).encode("utf-32-le"), dtype=np.uint32)
    if not len(code):
        return np.zeros(DIM, dtype=np.int64)
    total, h = np.zeros(DIM, dtype=np.int64), np.zeros(len(code), dtype=np.uint32)
    for n in range(1, max(GRAMS) + 1):
        if len(code) < n:
            break
        h = (h[: len(code) - n + 1] * STEP + code[n - 1 :]) * STEP
        h ^= h >> np.uint32(15)
        if n in GRAMS:
            total += np.bincount(h & np.uint32(DIM - 1), minlength=DIM)
    return total


class _Letters(dict):
    """For str.translate: letters stay, anything else becomes a break."""

    def __missing__(self, code: int) -> int:
        self[code] = found = code if chr(code).isalpha() else 32
        return found


LETTERS = _Letters()


def letters(text: str | None) -> str:
    words = text.lower().translate(LETTERS).split() if text else ()
    return f" {' '.join(words)} " if words else ""


def tfidf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    size = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(size > 0, size, 1)


def clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from spread starting points; deterministic."""
    chosen = [x.mean(axis=0)]
    while len(chosen) < min(k, len(x)):
        chosen.append(x[np.argmin(np.max(x @ np.array(chosen).T, axis=1))])
    centres = np.array(chosen)
    for _ in range(rounds):
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        own = np.argmax(x @ centres.T, axis=1)
        centres = np.array([x[own == i].mean(axis=0) if (own == i).any() else c for i, c in enumerate(centres)])
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)


class Model:
    """langs[i] and least[i] (the lowest accepted cosine) belong to row i of centres."""

    def __init__(self, idf: np.ndarray, langs: list[str], centres: np.ndarray, least: np.ndarray):
        self.idf, self.langs, self.centres, self.least = idf.astype(np.float32), langs, centres.astype(np.float32), least

    def predict(self, texts: list) -> tuple[list[str], list[float], list[bool]]:
        out: tuple[list, list, list] = ([], [], [])
        for at in range(0, len(texts), 512):
            counts = np.stack([gram_counts(t) for t in texts[at : at + 512]])
            some = counts.any(axis=1)
            if not self.langs:
                near, cos = np.zeros(len(counts), dtype=int), np.zeros(len(counts))
            else:
                every = tfidf(counts, self.idf) @ self.centres.T
                near, cos = every.argmax(axis=1), every.max(axis=1)
            for s, i, c in zip(some, near, cos, strict=True):
                known = bool(s) and bool(self.langs)
                out[0].append(self.langs[i] if known else "und")
                out[1].append(min(1.0, max(0.0, float(c))) if known else 0.0)
                out[2].append(not known or bool(c < self.least[i]))
        return out


def held_out() -> Column:
    return id_crc() % 5 == 0


def _frequencies(batches):
    import pyarrow as pa

    df = np.zeros(DIM, dtype=np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            df += gram_counts(text) > 0
    at = np.flatnonzero(df)
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["gram", "n"])


def _vectors(batch) -> dict:
    return {"lang": batch.column(0), "counts": [gram_counts(t).astype(np.int32).tobytes() for t in batch.column(1).to_pylist()]}


def train(docs: DataFrame, rows: int = TRAINING_ROWS, centroids: int = CENTROIDS) -> Model:
    """Learns from the rows of docs(doc_id, text, lang) that have a lang and aren't held out."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"))
    counted = known.select("text").mapInArrow(_frequencies, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()  # at most DIM rows
    total = docs.filter(F.col("lang").isNotNull() & ~held_out()).select("doc_id").count()
    df = np.zeros(DIM)
    for r in counted:
        df[r.gram] = r.n
    idf = np.log((1 + total) / (1 + df)) + 1
    found = map_batches(bounded_sample(known, rows, ["lang", "text"], stratum="lang").select("lang", "text"), _vectors, "lang string, counts binary")
    by: dict[str, list] = {}
    for r in found.toLocalIterator():  # about ``rows`` for each language
        x = tfidf(np.frombuffer(r.counts, dtype=np.int32), idf).astype(np.float32)
        if x.any():
            by.setdefault(r.lang, []).append(x)
    langs, centres, least = [], [], []
    for lang in sorted(by):
        x = np.stack(sorted(by[lang], key=lambda v: v.tobytes()))
        c = clusters(x, centroids)
        cos, own = (x @ c.T).max(axis=1), (x @ c.T).argmax(axis=1)
        for i in range(len(c)):
            langs.append(lang)
            centres.append(c[i])
            least.append(float(np.quantile(cos[own == i], 1 - WITHIN)) if (own == i).any() else 1.0)
    return Model(idf, langs, np.array(centres).reshape(-1, DIM), np.array(least))


def _predict(model: Model, batch) -> dict:
    lang, score, rejected = model.predict(batch.column(1).to_pylist())
    return {"doc_id": batch.column(0), "lang_pred": lang, "score": score, "rejected": rejected}


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (cosine, at least 0), rejected for each row of docs(doc_id, text). No shuffle."""
    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), partial(_predict, model), "doc_id long, lang_pred string, score double, rejected boolean")
