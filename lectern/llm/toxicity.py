"""Toxicity classifier with counterfactual regularisation.

A logistic model over the words of a text and the first four and five letters of
each, present or absent. Sentences of the labelled texts are rewritten: an identity term
gives way to another of its group, and to a word that names no group; where a text mentions none, a term is put into one of
its sentences, and then swapped. The penalty is the mean squared change of the score
between a sentence and its rewritten form, so that a mention by itself cannot move it.

Only the text enters a score. Null and empty texts get the score of no words. Texts
are read whole; rows are independent, repeated ones alike; other columns are ignored.
Without any labelled row, every score is 0. Labels that are null or neither 0 nor 1 don't
count; an id with several labels is toxic if one of them is 1. An empty table gives an
empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import bounded_sample, discard, fresh, id_crc, map_batches, materialise

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]*[^\W\d_][^.!?\n]*[.!?]*")
DIM = 1 << 20
#: About this many labelled rows fit the model (see bounded_sample); features kept; cache of words for each worker.
TRAINING_ROWS, FEATURES, CACHED_WORDS = 8000, 4096, 100_000
#: At most so many rewritten sentences of a labelled text enter the penalty.
PAIRS_PER_TEXT = 4
#: The word that names no group.
NEUTRAL = "people"
#: Our own short list; a caller passes another as ``groups``.
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys", "transgender"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual", "queer"),
    ("black", "white", "asian", "latino", "indigenous"),
    ("immigrants", "refugees", "foreigners", "citizens", "natives"),
    ("disabled", "blind", "deaf", "elderly", "young"),
)


def features(word: str) -> tuple[int, ...]:
    """Hashed features of a lower-case word."""
    names = [f"w{word}", f"4{word[:4]}", f"5{word[:5]}"]
    return tuple({zlib.crc32(x.encode()) % DIM for x in names[: 1 + (len(word) >= 4) + (len(word) >= 5)]})


def words(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def text_features(text: str | None) -> set[int]:
    found: set[int] = set()
    for w in words(text):
        found.update(features(w))
    return found


class Model:
    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias, self.seen = weights, bias, {}

    def logit(self, text: str | None) -> float:
        seen, found = self.seen, set()
        for w in words(text):
            hit = seen.get(w)
            if hit is None:
                hit = tuple(f for f in features(w) if f in self.weights)
                if len(seen) < CACHED_WORDS:
                    seen[w] = hit
            if hit:
                found.update(hit)
        return self.bias + sum(self.weights[f] for f in sorted(found))

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.logit(text)))))

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "seen": {}}


@lru_cache(maxsize=4)
def _terms(groups: tuple) -> tuple[re.Pattern, dict]:
    group_of = {t: g for g in groups for t in g}
    return re.compile(r"\b(?:" + "|".join(sorted(map(re.escape, group_of), key=len, reverse=True)) + r")\b"), group_of


def counterfactuals(text: str | None, groups=IDENTITY_GROUPS, most: int = PAIRS_PER_TEXT) -> list[tuple[str, str]]:
    """Lower-case sentences of text, each with a rewritten form. Deterministic.

    In a sentence that mentions a term, another of its group takes its place (one pair)
    and so does NEUTRAL (another). Without any mention, a term is put into one sentence
    (one pair), and swapped there (another).
    """
    low = (text or "").lower()
    sentences = SENTENCE.findall(low)
    if not sentences or not any(groups):
        return []
    pattern, group_of = _terms(tuple(map(tuple, groups)))
    draw = zlib.crc32(low.encode())
    if pattern.search(low):
        out = []
        for s in sentences:
            for term in sorted(set(pattern.findall(s))):
                others = [t for t in group_of[term] if t != term]
                for other in (*others[(draw + len(out)) % max(1, len(others)) :][:1], NEUTRAL):
                    out.append((s, re.sub(rf"\b{re.escape(term)}\b", other, s)))
        step = max(1, -(-len(out) // most))
        return out[:: step]
    sentence, group = sentences[draw % len(sentences)].split(), groups[draw // 7 % len(groups)]
    a, b = group[draw // 64 % len(group)], group[(draw // 64 + 1) % len(group)]
    at = draw // 4096 % (len(sentence) + 1)
    plain, one, other = (" ".join(sentence[:at] + x + sentence[at:]) for x in ([], ["the", a], ["the", b]))
    return [(plain, one), (one, other)][:most]


def swaps(found: set[int], groups=IDENTITY_GROUPS) -> list[tuple[set[int], set[int]]]:
    """For texts known by their features alone: the features before and after an identity term gives way to another."""
    out = []
    for group in groups:
        of = {t: set(features(t)) for t in group}
        here = [t for t in group if of[t] <= found]
        out += [(found, found - of[a] | of[b]) for a in here for b in group if b not in here]
    return out


def evidence(n0, n1, t0, t1, m):
    """How surely a feature in n0 of t0 and n1 of t1 texts tells the classes apart (z of its log odds); m: numpy or Spark functions."""
    odds = m.log((n1 + 0.5) / (t1 - n1 + 0.5)) - m.log((n0 + 0.5) / (t0 - n0 + 0.5))
    return m.abs(odds) / m.sqrt(1 / (n0 + 0.5) + 1 / (n1 + 0.5) + 1 / (t0 - n0 + 0.5) + 1 / (t1 - n1 + 0.5))


#: Features below this evidence, or in one text alone, aren't kept.
LEAST_EVIDENCE = 2.0


class Ragged:
    """Rows of places (numbers below width), as flat arrays."""

    def __init__(self, rows: list[np.ndarray]):
        self.n = len(rows)
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), [len(r) for r in rows])
        self.col = np.concatenate([np.zeros(0, np.int32), *rows]).astype(np.int32)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], minlength=self.n)

    def back(self, error: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.col, error[self.row], minlength=width)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _descend(y: np.ndarray, texts: Ragged, before: Ragged, after: Ragged, width: int, strength: float, ridge: float, steps: int) -> tuple[np.ndarray, float]:
    """Full-batch descent (Adam) on log loss, ridge and the squared change of scores. Deterministic."""
    w, b = np.zeros(width), math.log(y.sum() / (len(y) - y.sum()))
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for t in range(1, steps + 1):
        error = (_sigmoid(b + texts.dot(w)) - y) / len(y)
        g, gb = texts.back(error, width) + 2 * ridge * w, error.sum()
        if before.n and strength:
            p, q = _sigmoid(b + before.dot(w)), _sigmoid(b + after.dot(w))
            change = 2 * strength / before.n * (p - q)
            ep, eq = change * p * (1 - p), -change * q * (1 - q)
            g, gb = g + before.back(ep, width) + after.back(eq, width), gb + ep.sum() + eq.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        b -= 0.05 * (mb / (1 - 0.9**t)) / (math.sqrt(vb / (1 - 0.999**t)) + 1e-9)
    return w, float(b)


def constant(positive: int, rows: int) -> Model | None:
    """The model for labels of one kind, or none."""
    return Model({}, 40.0 if positive else -40.0) if positive in (0, rows) else None


#: Weight of the penalty against the log loss; of the squared weights; steps of the descent.
STRENGTH, RIDGE, STEPS = 64.0, 2e-4, 300


def _identity(groups) -> set[int]:
    return {f for g in groups for t in g for f in features(t)}


def fit(rows: list[tuple[int, list[int]]], groups=IDENTITY_GROUPS, strength: float = STRENGTH, ridge: float = RIDGE, steps: int = STEPS, pairs=None) -> Model:
    """For rows that fit into memory: (label, features); pairs of feature sets that should score alike (default: swaps of the rows)."""
    rows = [(int(y), set(f)) for y, f in rows if y is not None]
    if (one := constant(sum(y for y, _ in rows), len(rows))) is not None:
        return one
    pairs = [p for _, f in rows for p in swaps(f, groups)] if pairs is None else pairs
    counts = np.zeros((2, DIM))
    for y, f in rows:
        counts[y, list(f)] += 1
    totals = [sum(y == k for y, _ in rows) for k in (0, 1)]
    z = np.where(counts.sum(axis=0) < 2, 0, evidence(counts[0], counts[1], *totals, np))
    best = [int(i) for i in np.argsort(-z, kind="stable")[:FEATURES] if z[i] > LEAST_EVIDENCE]
    kept = sorted({*best, *_identity(groups)})
    place = {f: i for i, f in enumerate(kept)}
    packed = lambda sets: Ragged([np.array(sorted(place[f] for f in s if f in place), dtype=np.int32) for s in sets])
    y = np.array([r[0] for r in rows], dtype=float)
    w, b = _descend(y, packed([f for _, f in rows]), packed([p for p, _ in pairs]), packed([q for _, q in pairs]), len(kept), strength, ridge, steps)
    return Model({f: float(x) for f, x in zip(kept, w, strict=True) if x}, b)


def held_out() -> Column:
    return id_crc() % 4 == 2


def _pack(found: set[int]) -> bytes:
    return np.array(sorted(found), dtype=np.int32).tobytes()


def _features(groups, batch) -> dict:
    texts = batch.column(1).to_pylist()
    pairs = [counterfactuals(t, groups) for t in texts]
    return {
        "toxic": batch.column(0),
        "found": [_pack(text_features(t)) for t in texts],
        "before": [[_pack(text_features(a)) for a, _ in p] for p in pairs],
        "after": [[_pack(text_features(b)) for _, b in p] for p in pairs],
    }


def _count(batch) -> dict:
    """Texts of each class that have a feature, for the features of a batch."""
    found = [np.frombuffer(x, np.int32) for x in batch.column(1).to_pylist()]
    label = np.repeat(np.asarray(batch.column(0)), [len(x) for x in found])
    feature, at = np.unique(np.concatenate(found), return_inverse=True)
    n = [np.bincount(at[label == k], minlength=len(feature)) for k in (0, 1)]
    return {"feature": feature, "n0": n[0], "n1": n[1]}


def _places(kept: bytes, batch) -> dict:
    """Features to places among the kept ones; the others are left out."""
    known = np.frombuffer(kept, np.int32)

    def place(raw: bytes) -> bytes:
        found = np.frombuffer(raw, np.int32)
        at = np.minimum(np.searchsorted(known, found), len(known) - 1)
        return at[known[at] == found].astype(np.int32).tobytes()

    found, before, after = (batch.column(i).to_pylist() for i in (1, 2, 3))
    return {"toxic": batch.column(0), "found": [place(x) for x in found], "before": [[place(x) for x in p] for p in before], "after": [[place(x) for x in p] for p in after]}


PACKED = "toxic int, found binary, before array<binary>, after array<binary>"


def _ragged(column: pa.ChunkedArray) -> Ragged:
    return Ragged([np.frombuffer(x.as_buffer(), np.int32) for x in column])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, groups=IDENTITY_GROUPS, strength: float = STRENGTH, ridge: float = RIDGE, steps: int = STEPS) -> Model:
    """Fits on a bounded sample of the labelled rows that are not held out.

    Features are counted by class in the cluster; the driver gets the kept ones, and
    the places of these in each sampled row, as packed numbers.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = bounded_sample(known, rows, ["doc_id"])
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")  # about ``rows`` ids
    found = materialise(found, "labelled")
    some = bounded_sample(found, 2 * rows, ["doc_id", "text"])  # an id may have many rows
    packed = materialise(map_batches(some.select("toxic", "text"), partial(_features, groups), PACKED), "packed")
    discard(found)
    total = {r.toxic: r.n for r in packed.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    t0, t1 = total.get(0, 0), total.get(1, 0)
    if (one := constant(t1, t0 + t1)) is not None:
        return one
    counted = map_batches(packed.select("toxic", "found"), _count, "feature int, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    z = evidence(F.col("n0"), F.col("n1"), F.lit(t0), F.lit(t1), F)
    best = counted.filter(F.col("n0") + F.col("n1") > 1).select("feature", z.alias("z")).filter(F.col("z") > LEAST_EVIDENCE)
    best = best.orderBy(F.desc("z"), "feature").limit(FEATURES)
    kept = np.array(sorted({*(r.feature for r in best.collect()), *_identity(groups)}), dtype=np.int32)
    table = map_batches(packed, partial(_places, kept.tobytes()), PACKED).toArrow()  # a few hundred bytes for each row
    table = table.take(sorted(range(table.num_rows), key=lambda i: (table["found"][i].as_py(), table["toxic"][i].as_py())))  # sums in one order
    pairs = [_ragged(pa.chunked_array([table[c].combine_chunks().flatten()])) for c in ("before", "after")]
    w, b = _descend(table["toxic"].to_numpy().astype(float), _ragged(table["found"]), *pairs, len(kept), strength, ridge, steps)
    discard(packed)
    return Model({int(f): float(x) for f, x in zip(kept, w, strict=True) if x}, b)


def _score(model: Model, batch) -> dict:
    return {"doc_id": batch.column(0), "score": [model.score(t) for t in batch.column(1).to_pylist()]}


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for each row of docs(doc_id, text). No shuffle."""
    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), partial(_score, model), "doc_id long, score double")


def _flag(model: Model, place: int, limit: float, name: str, batch) -> dict:
    columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
    return columns | {name: [model.score(t) >= limit for t in batch.column(place).to_pylist()]}


def keep_clean(docs: DataFrame, model: Model, limit: float = 0.3) -> DataFrame:
    """The rows of docs that score below limit, all their columns unchanged."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    name = fresh(docs.columns, "toxic")
    flagged = map_batches(docs, partial(_flag, model, docs.columns.index("text"), limit, name), f"{ddl}, `{name}` boolean")
    return flagged.filter(~F.col(name)).drop(name)
