"""Secret scan: fixed patterns, and two character Markov models compared by log-likelihood ratio.

One model is trained on random strings, one on ordinary identifiers: names built from the
words of all documents, and labelled identifiers in the usual styles of programs. A long
token is a secret when the first explains its character transitions much better.

Null text counts as empty and has no spans. Texts are scanned whole. Rows are
independent: repeated rows and ids give repeated results, an empty table an empty
one, and other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache, partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import map_batches

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{16}")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
WORD = re.compile(r"[A-Za-z]{3,}")

SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
N = len(SYMBOLS) + 1  # the last symbol stands for the start and for anything else
CODE = np.full(128, N - 1, dtype=np.intp)
CODE[[ord(c) for c in SYMBOLS]] = range(len(SYMBOLS))

#: A token counts as random from this log-likelihood ratio on, in total and for each transition.
LEAST_TOTAL, LEAST_MEAN = 14.0, 0.55
RANDOM_STRINGS = 6000


def _codes(text: str) -> np.ndarray:
    return CODE[np.minimum(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32), 127)]


def transitions(token: str) -> tuple[np.ndarray, np.ndarray]:
    code = _codes(token)
    return np.concatenate(([N - 1], code[:-1])), code


def random_strings(count: int = RANDOM_STRINGS, seed: int = 7) -> list[str]:
    """Labelled samples of the random class, drawn by rule from the usual alphabets of keys."""
    draw = random.Random(seed)
    alphabets = ("0123456789abcdef", "0123456789ABCDEF", SYMBOLS[:62], SYMBOLS[:64], SYMBOLS[26:62], SYMBOLS[:62] + "_-")
    return ["".join(draw.choices(alphabets[i % len(alphabets)], k=draw.randint(16, 48))) for i in range(count)]


#: Our own words of program names, for the labelled samples of ordinary identifiers.
TERMS = """
access account action active adapter address agent alias alert archive array asset async attribute audio author backend backup balance base batch binary block body
bool bridge broker buffer build bundle button byte cache callback cancel category change channel char check child class clean client clone close cluster code collection
color column command commit common compile component config connect console constant container content context control convert cookie core count create cursor custom
daemon data database date debug decode default delete deploy detail device dialog digest direct directory disk dispatch display document domain download driver drop
dynamic edge edit element email empty enable encode engine entity entry enum error event exception execute export expression extension external factory failure feature
field file filter final find flag float folder footer form format frame function gateway general generate global graph grid group handle handler hash header height
help hidden history host html http icon image implementation import index info init inner input insert instance integer interface internal invalid item iterator java
join json kernel keyboard label language layout length level library limit line link list listener load local location lock logger login loop machine main manager map
mapper matrix memory menu merge message metadata method metric model module monitor mouse name native navigation network node notification null number object offset open
operation option order output owner package page panel parameter parent parse parser partition password path pattern payload pending permission plugin point policy pool
port post prefix preview primary print private process product profile project property protocol provider proxy public query queue random range read record reference
region register release remote remove render replace report repository request reset resource response result retry return role root route router row rule runtime sample
scale schedule schema scope screen script scroll search section security select sequence serial server service session setting shared signal single size snapshot socket
source spec stack stage standard start state static status storage store stream string struct style submit support switch symbol sync system table target task template
test text thread time title token tool topic total trace transaction transfer transform trigger type unique unit update upload user utility valid value variable vector
verify version view virtual visible wait watch web widget width window wizard worker workflow wrapper write xml yaml zone
""".split()
ACRONYMS = "API CSS CSV DNS FTP GPU HTML HTTP ID IO IP JDBC JSON JWT LDAP OS PDF REST RPC SDK SQL SSH SSL TCP TLS UDP UI URI URL UTF8 UUID XML YAML".split()
IDENTIFIERS = 6000


def ordinary_identifiers(count: int = IDENTIFIERS, seed: int = 11, terms: list[str] | None = None) -> list[str]:
    """Labelled samples of the ordinary class: names in the usual styles, by rule from TERMS and ACRONYMS."""
    draw, terms = random.Random(seed), terms or TERMS
    styles = (
        lambda w: w[0] + "".join(x.capitalize() for x in w[1:]), lambda w: "".join(x.capitalize() for x in w), lambda w: "_".join(w), lambda w: "_".join(w).upper(), lambda w: "-".join(w), lambda w: "/".join(w),
        lambda w: draw.choice(ACRONYMS) + "".join(x.capitalize() for x in w), lambda w: w[0] + draw.choice(ACRONYMS) + "".join(x.capitalize() for x in w[1:]), lambda w: "_".join([draw.choice(ACRONYMS), *w]),
        lambda w: "_".join(w) + str(draw.randrange(100)), lambda w: "-".join(w) + f"-v{draw.randrange(10)}", lambda w: f"{w[0].capitalize()}/{w[0]}-{w[1]}_{draw.randrange(1000)}",
        lambda w: f"{2000 + draw.randrange(30)}-{1 + draw.randrange(12):02d}-{1 + draw.randrange(28):02d}-{w[0]}", lambda w: "__" + "_".join(w) + "__", lambda w: "=".join(w[:2]) + "/" + draw.choice(ACRONYMS), lambda w: "".join(w),
    )
    return [styles[i % len(styles)]([draw.choice(terms) for _ in range(draw.randint(2, 5))]) for i in range(count)]


NAMES = (
    lambda a, b, c, i: a, lambda a, b, c, i: f"{a}_{b}_{c}", lambda a, b, c, i: a.lower() + b.capitalize() + c.capitalize(), lambda a, b, c, i: f"{a}-{b}{c}",
    lambda a, b, c, i: f"{a}/{b}/{c}", lambda a, b, c, i: f"{b.upper()}_{a.upper()}", lambda a, b, c, i: f"{c}{i % 100}", lambda a, b, c, i: a + b + c,
)


def corpus_names(text: str | None) -> list[str]:
    """Samples of the ordinary class: words of a text outside of fixed patterns, and names built from neighbouring words."""
    text = text or ""
    for r in (ASSIGN, ACCESS):
        for a, b in [m.span() for m in r.finditer(text)] if r is ASSIGN or "AKIA" in text else ():
            text = text[:a] + " " * (b - a) + text[b:]
    words = WORD.findall(text)
    return [NAMES[i // 3 % 8](*words[i : i + 3], i) for i in range(0, len(words) - 2, 3)]


ORDINARY, RANDOM, LABELLED = 0, 1, 2


def _names(batch) -> dict:
    out = [name for text in batch.column(0).to_pylist() for name in corpus_names(text)]
    return {"token": out, "random": [ORDINARY] * len(out)}


def transition_counts(tokens: list[str], at_once: int = 10_000) -> np.ndarray:
    counts = np.zeros(N * N, dtype=np.int64)
    for i in range(0, len(tokens), at_once):
        part = tokens[i : i + at_once]
        code = _codes("".join(part))
        before = np.concatenate(([N - 1], code[:-1]))
        before[np.cumsum([0, *map(len, part[:-1])])] = N - 1
        counts += np.bincount(before * N + code, minlength=N * N)
    return counts.reshape(N, N)


def _sparse(counts: dict[int, np.ndarray]) -> dict:
    rows = [(k, *map(int, x), int(c[x])) for k, c in counts.items() for x in zip(*np.nonzero(c), strict=True)]
    return dict(zip(("random", "a", "b", "n"), map(list, zip(*rows, strict=True)), strict=True)) if rows else {k: [] for k in ("random", "a", "b", "n")}


def _count(batch) -> dict:
    rows = [(token, label) for token, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if token and label is not None]
    by = {k: [token for token, label in rows if label == k] for k in (ORDINARY, RANDOM, LABELLED)}
    return _sparse({k: transition_counts(tokens) for k, tokens in by.items() if tokens})


def _count_names(batch) -> dict:
    counts = np.zeros((N, N), dtype=np.int64)
    for text in batch.column(0).to_pylist():
        if names := corpus_names(text):
            counts += transition_counts(names)
    return _sparse({ORDINARY: counts})


COUNTED = "random int, a int, b int, n long"


def labelled() -> dict[int, list[str]]:
    return {RANDOM: random_strings(), LABELLED: ordinary_identifiers()}


def training_samples(docs: DataFrame) -> DataFrame:
    """(token, random): names from all docs(text) as 0, generated strings as 1, generated identifiers as 2 (ordinary too)."""
    plain = map_batches(docs.select("text"), _names, "token string, random int")
    return plain.unionByName(docs.sparkSession.createDataFrame([(x, k) for k, tokens in labelled().items() for x in tokens], "token string, random int"))


def _ratios_of(parts: DataFrame, more: dict[int, np.ndarray]) -> np.ndarray:
    counts = np.full((3, N, N), 0.05)
    for k, c in more.items():
        counts[k] += c
    for r in parts.groupBy("random", "a", "b").agg(F.sum("n").alias("n")).collect():  # at most 3 * N * N rows
        counts[r.random, r.a, r.b] += r.n
    p = counts / counts.sum(axis=2, keepdims=True)
    # ordinary names come from the corpus and from the labelled identifiers, one as likely as the other
    ordinary = (p[ORDINARY] + p[LABELLED]) / 2 if (counts[LABELLED] > 0.05).any() else p[ORDINARY]
    return np.log(p[RANDOM]) - np.log(ordinary)


def train(samples: DataFrame) -> np.ndarray:
    """Log-likelihood ratios (random against ordinary) of all transitions, from labelled samples(token, random)."""
    return _ratios_of(map_batches(samples.select("token", "random"), _count, COUNTED), {})


def train_on(docs: DataFrame) -> np.ndarray:
    """train(training_samples(docs)), counted where the texts are read."""
    return _ratios_of(map_batches(docs.select("text"), _count_names, COUNTED), {k: transition_counts(tokens) for k, tokens in labelled().items()})


def log_ratio(token: str, ratios: np.ndarray) -> float:
    return float(ratios[transitions(token)].sum())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, ordered."""
    found, low = [], text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if LONG_HEX.search(text):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 16]
    return sorted(found)


def all_spans(text: str, ratios: np.ndarray) -> tuple[list, list]:
    """The base spans, and those with the tokens added that the models call random and no base span touches."""
    base = base_spans(text)
    added = []
    for m in TOKEN.finditer(text):
        a, b = m.span()
        if any(s < b and a < e for s, _, e in base):
            continue
        total = log_ratio(m[0], ratios)
        if total >= LEAST_TOTAL and total >= LEAST_MEAN * (b - a):
            added.append((a, 3, b))
    return base, sorted(base + added) if added else base


def joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


@lru_cache(maxsize=4)
def _ratios(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.float64).reshape(N, N)


def _scan(raw: bytes, batch) -> dict:
    ratios = _ratios(raw)
    out: dict = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
    for text in batch.column(1).to_pylist():
        base, every = all_spans(text or "", ratios)
        for i, k in enumerate(("n_assign", "n_access", "n_hex")):
            out[k].append(sum(x[1] == i for x in base))
        out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
        out["spans"].append(joined(every))
    return {"doc_id": batch.column(0)} | out


def scan(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of docs(doc_id, text). No shuffle."""
    return map_batches(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), partial(_scan, ratios.tobytes()),
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string",
    )


def redact_text(text: str, ratios: np.ndarray, mark: str) -> str:
    out, at = [], 0
    for a, _, b in all_spans(text, ratios)[1]:
        if b > at:
            if a >= at:
                out += [text[at:a], mark]
            at = b
    return "".join([*out, text[at:]])


def _redact(raw: bytes, mark: str, place: int, batch) -> dict:
    ratios = _ratios(raw)
    texts = [None if x is None else redact_text(x, ratios, mark) for x in batch.column(place).to_pylist()]
    columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
    columns["text"] = texts
    if "n_chars" in columns:
        columns["n_chars"] = [n if t is None else len(t) for n, t in zip(columns["n_chars"].to_pylist(), texts, strict=True)]
    return columns


def redact(docs: DataFrame, ratios: np.ndarray, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span replaced by mark, and n_chars (if there) brought up to date; null texts stay null."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_batches(docs, partial(_redact, ratios.tobytes(), mark, docs.columns.index("text")), ddl)
