"""Near-duplicate documents: MinHash, banding, verification, star components.

1. Each text becomes its set of hashed five-word shingles (64 bits); 120 universal
   hashes give the signature, cut into 24 bands of 5 (30 of 4 for a similarity of 0.80).
   Documents with equal sets (equal size and two 64-bit sums of hashes; not confirmed
   further) are one class, represented by their least id.
2. Representatives that share a band are candidates, but pairs are not spelled out.
   First each document is compared once, with the least of the ids that its bands hold.
3. Documents of bands that then still hold more than one component are grouped, and each
   is compared with its group's pivot. Two documents of a group can only be linked if
   their differences from the pivot overlap (see _overlapping, which is exact): pairs that
   share one of their rarest differences are compared. So the pairs grow with the links
   and near misses, not with the square of a group, and no candidate link is lost.
4. A pair is first judged by its signatures (far below the limit: dropped), then
   confirmed on the full sets.
5. Components come from alternating large-star and small-star steps.

The similarity asked for sets the bands, the least of equal places and the exact bounds.
At a similarity of exactly 0.85 (0.80) the bands miss a pair with a probability of 8e-7
(1e-7), if 0.85 (0.80) is what is asked for; the signatures rule it out with one of 5e-8.
Null, empty and blank texts have no shingles and are linked with nothing; texts with
fewer than five words are one shingle. Repeated rows each get a result row; rows that
share an id share its component. Empty tables give empty results. Other columns are
ignored.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import Scratch, discard, map_batches, materialise

SHINGLE, HASHES = 5, 120
#: Share of 100 that the intersection must have of the union: of the report, and of filtering stages.
SIMILARITY, STAGE_SIMILARITY = 85, 80
#: Probability with which the bands may miss a pair at exactly the similarity asked for.
BAND_MISS = 1e-6
#: Probability with which too few equal signature places may rule such a pair out.
SIGNATURE_MISS = 1e-7
#: Sides below this many ids (8 bytes each) may be broadcast.
BROADCAST_IDS = 1_000_000
#: The same for classes (32 bytes each). Beyond these, joins are by key, and the adaptive planner splits hot ones.
BROADCAST_CLASSES = 250_000

_random = np.random.Generator(np.random.PCG64(20240229))
BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = _random.integers(1, 1 << 63, 1, dtype=np.uint64)[0] * np.uint64(2) + np.uint64(1)
PLACES = _random.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MULTIPLY = _random.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _random.integers(0, 1 << 63, HASHES, dtype=np.uint64)
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    global _POWER, _INVERSE
    if len(_POWER) < n:
        size = max(n, 2 * len(_POWER))
        inverse = U(pow(int(BASE), -1, 1 << 64))
        _POWER = np.cumprod(np.concatenate(([U(1)], np.full(size - 1, BASE))))
        _INVERSE = np.cumprod(np.concatenate(([U(1)], np.full(size - 1, inverse))))
    return _POWER[:n], _INVERSE[:n]


_POWER = _INVERSE = np.ones(1, dtype=np.uint64)


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words between ASCII white space, A-Z lowered."""
    raw = np.frombuffer((text or "").encode("utf-8").lower(), dtype=np.uint8)  # bytes.lower() touches A-Z alone
    gap = np.concatenate(([True], SPACE[raw], [True]))
    starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    out = []
    # long texts in pieces of whole words, so that the tables of powers stay small
    cuts = [0, *np.searchsorted(starts, np.arange(1 << 16, len(raw), 1 << 16)), len(starts)]
    for a, b in zip(cuts, cuts[1:]):  # noqa: B905
        if a < b:
            low, high = starts[a], ends[b - 1]
            up, down = _powers(high - low)
            sums = np.concatenate(([U(0)], np.cumsum(BYTE[raw[low:high]] * up)))
            s, e = starts[a:b] - low, ends[a:b] - low
            out.append(mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)))
    return np.concatenate(out)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles."""
    words = word_hashes(text)
    if not len(words):
        return words
    if len(words) < SHINGLE:
        return mixed((words * PLACES[: len(words)]).sum(dtype=np.uint64, keepdims=True) + U(len(words)))
    total = np.zeros(len(words) - SHINGLE + 1, dtype=np.uint64)
    for i, place in enumerate(PLACES):
        total += words[i : i + len(total)] * place
    return np.unique(mixed(total))


def signature(found: np.ndarray) -> np.ndarray:
    """HASHES minima of universal hashes, upper halves."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(found), 512):
        part = np.multiply.outer(MULTIPLY, found[i : i + 512])
        part += ADD[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return (least >> U(32)).astype(np.uint32)


def band_rows(similarity: int) -> int:
    """The most rows (5 at most) that a band may have."""
    p = similarity / 100
    return next(r for r in (5, 4, 3, 2, 1) if r == 1 or (1 - p**r) ** (HASHES // r) <= BAND_MISS)


def least_equal(similarity: int) -> int:
    """The equal signature places that a pair at exactly the similarity has, but for SIGNATURE_MISS."""
    p, below = similarity / 100, 0.0
    for k in range(HASHES + 1):
        below += math.comb(HASHES, k) * p**k * (1 - p) ** (HASHES - k)
        if below > SIGNATURE_MISS:
            return k
    return HASHES


def band_keys(sig: np.ndarray, per_band: int) -> np.ndarray:
    rows = sig.reshape(-1, per_band).astype(np.uint64)
    return mixed((rows * PLACES[:per_band]).sum(axis=1, dtype=np.uint64) + mixed(np.arange(1, len(rows) + 1, dtype=np.uint64))).view(np.int64)


def _sketch(per_band: int, batch) -> dict:
    out: dict = {"n": [], "h1": [], "h2": [], "sig": [], "bands": []}
    for text in batch.column(1).to_pylist():
        found = shingles(text)
        out["n"].append(len(found))
        out["h1"].append(int(found.sum(dtype=np.uint64).view(np.int64)))
        out["h2"].append(int(mixed(found ^ U(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))
        sig = signature(found) if len(found) else None
        out["sig"].append(None if sig is None else sig.tobytes())
        out["bands"].append(None if sig is None else band_keys(sig, per_band).tolist())
    return {"doc_id": batch.column(0)} | out


def sketch(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n (set size), h1, h2 (hashes of the set), sig, bands for each row of docs(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_batches(docs, partial(_sketch, band_rows(similarity)), "doc_id long, n long, h1 long, h2 long, sig binary, bands array<long>")


def _sets(batch) -> dict:
    return {"doc_id": batch.column(0), "found": [shingles(t).tobytes() for t in batch.column(1).to_pylist()]}


def _equal_places(a: bytes, b: bytes) -> int:
    return int((np.frombuffer(a, np.uint32) == np.frombuffer(b, np.uint32)).sum())


def _alike(least: int, batch) -> dict:
    """Drops the pairs whose signatures rule them out."""
    a, b, x, y = (batch.column(i).to_pylist() for i in range(4))
    fine = [i for i in range(len(a)) if _equal_places(x[i], y[i]) >= least]
    return {"a": [a[i] for i in fine], "b": [b[i] for i in fine]}


def linked(x: np.ndarray, y: np.ndarray, similarity: int = SIMILARITY) -> bool:
    """x, y: sorted distinct."""
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= similarity * (len(both) - common)


def _confirm(similarity: int, batch) -> dict:
    a, b, x, y = (batch.column(i) for i in range(4))
    fine = [i for i in range(len(a)) if linked(np.frombuffer(x[i].as_py(), np.uint64), np.frombuffer(y[i].as_py(), np.uint64), similarity)]
    a, b = a.to_pylist(), b.to_pylist()
    return {"a": [a[i] for i in fine], "b": [b[i] for i in fine]}


def _with(pairs: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """pairs(a, b) with the values(doc_id, name) of both as x and y.

    The value of b, which is in few pairs as a rule, is joined first and travels with the
    pair; that of a, a hub of many pairs, is read once by each task that holds some.
    """
    x = values.select(F.col("doc_id").alias("a"), F.col(name).alias("x"))
    y = values.select(F.col("doc_id").alias("b"), F.col(name).alias("y"))
    return pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y")


def components(links: DataFrame, label: str = "edges") -> DataFrame:
    """doc_id, component (the least id reachable) for every id in links(a, b), by alternating star steps; written."""
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), label)
    while True:
        # large star: neighbours above a node go to the least of its neighbourhood
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its neighbours below it go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        after = materialise(small, label)
        change = after.withColumn("side", F.lit(1)).unionByName(edges.withColumn("side", F.lit(-1))).groupBy("u", "v").agg(F.sum("side").alias("n")).filter("n <> 0")
        settled = change.isEmpty()
        discard(edges)
        edges = after
        if settled:
            break
    nodes = edges.select(F.col("u").alias("doc_id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("doc_id"), F.col("v").alias("component")).distinct())
    out = materialise(nodes, "components")
    discard(edges)
    return out


def restrict(df: DataFrame, ids: DataFrame, how: str = "left_semi", count: int | None = None) -> DataFrame:
    """df joined with ids(doc_id), which is broadcast if its checked size allows."""
    count = ids.count() if count is None else count
    return df.join(F.broadcast(ids) if count <= BROADCAST_IDS else ids, "doc_id", how)


def _stars(members: DataFrame) -> DataFrame:
    """One pair (a, b) for each document b: a is the least of the least ids of its bands."""
    least = members.groupBy("key").agg(F.min("doc_id").alias("a"))
    return members.join(least, "key").filter("a < doc_id").groupBy("doc_id").agg(F.min("a").alias("a")).select("a", F.col("doc_id").alias("b"))


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """members(key, doc_id) with their component, of the bands that hold more than one."""
    known = members.join(labels, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    spread = known.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 < c1").select("key")
    return known.join(spread, "key", "left_semi")


def _rows(batch) -> dict:
    """grp, m, found(binary) to one row for each element."""
    found = [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
    size = [len(x) for x in found]
    return {"grp": np.repeat(np.asarray(batch.column(0)), size), "m": np.repeat(np.asarray(batch.column(1)), size), "x": np.concatenate(found)}


def _centrality(batch) -> dict:
    """doc_id, grp and how much closer to the group's core than the empty set a document is; columns: doc_id, grp, found, core."""
    score = []
    for x, core in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
        found = np.frombuffer(x, np.int64)
        score.append(2 * int(np.isin(found, np.array(core or (), dtype=np.int64)).sum()) - len(found))
    return {"doc_id": batch.column(0), "grp": batch.column(1), "score": score}


def _differences(similarity: int, batch) -> dict:
    """The elements in which a set and its group's pivot differ; columns: doc_id, grp, n, component, found, pivot, core (the pivot's set)."""
    size, core, found = batch.column(2).to_pylist(), batch.column(6).to_pylist(), batch.column(4).to_pylist()
    diff, linked_ = [], []
    for n, x, y in zip(size, found, core, strict=True):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        diff.append(np.setxor1d(x, y, assume_unique=True))
        linked_.append((100 + similarity) * len(diff[-1]) <= (100 - similarity) * (n + len(y)))
    names = ("doc_id", "grp", "n", "component", None, "pivot")
    return {k: batch.column(i) for i, k in enumerate(names) if k} | {"d": [len(x) for x in diff], "linked": linked_, "found": [x.tobytes() for x in diff]}


def _elements(batch) -> dict:
    """doc_id, grp, found(binary) to one row for each element."""
    found = [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
    size = [len(x) for x in found]
    return {"doc_id": np.repeat(np.asarray(batch.column(0)), size), "grp": np.repeat(np.asarray(batch.column(1)), size), "x": np.concatenate(found)}


def _confirmed(pairs: DataFrame, first: DataFrame, docs: DataFrame, similarity: int, keep: Scratch) -> DataFrame:
    """The pairs(a, b) that are linked: judged by signatures, then on full sets."""
    near = keep(map_batches(_with(pairs, first, "sig"), partial(_alike, least_equal(similarity)), "a long, b long"), "near")
    ids = keep(near.select(F.col("a").alias("doc_id")).unionByName(near.select(F.col("b").alias("doc_id"))).distinct(), "ids")
    sets = map_batches(restrict(docs, ids).dropDuplicates(["doc_id"]), _sets, "doc_id long, found binary")
    return keep(map_batches(_with(near, keep(sets, "sets"), "found"), partial(_confirm, similarity), "a long, b long"), "links")


def _pivoted(open_: DataFrame, docs: DataFrame, similarity: int, keep: Scratch) -> DataFrame:
    """doc_id, grp, n, component, pivot, d, linked, found (the difference from the pivot's set) for each document in open bands.

    A group holds all documents that open bands hold together; its pivot is the document
    closest to its core, the shingles that most of its documents have.
    """
    hubs = open_.groupBy("key").agg(F.min("doc_id").alias("a"))
    groups = keep.own(components(open_.join(hubs, "key").select("a", F.col("doc_id").alias("b")).distinct(), "groups"))
    # a group's size travels with its members, so that their shingles need not meet by group to be counted
    groups = groups.withColumnRenamed("component", "grp").join(groups.groupBy(F.col("component").alias("grp")).agg(F.count("*").alias("m")), "grp")
    ids = keep(open_.select("doc_id", "component").distinct().join(groups, "doc_id"), "ids")
    sets = map_batches(restrict(docs, ids.select("doc_id")).dropDuplicates(["doc_id"]), _sets, "doc_id long, found binary").join(ids, "doc_id")
    sets = keep(sets.select("doc_id", "grp", "m", (F.octet_length("found") / 8).cast("long").alias("n"), "component", "found"), "sets")
    counts = map_batches(sets.select("grp", "m", "found"), _rows, "grp long, m long, x long").groupBy("grp", "x").agg(F.count("*").alias("c"), F.max("m").alias("m"))
    core = counts.filter("c > 1 AND 2 * c > m").groupBy("grp").agg(F.collect_list("x").alias("core"))  # at most twice a set's mean size
    scored = map_batches(sets.select("doc_id", "grp", "found").join(keep(core, "core"), "grp", "left"), _centrality, "doc_id long, grp long, score long")
    pivots = scored.groupBy("grp").agg(F.max(F.struct("score", (-F.col("doc_id")).alias("id"))).alias("best")).select("grp", (-F.col("best.id")).alias("pivot"))
    pivots = keep(pivots.join(sets.select(F.col("doc_id").alias("pivot"), F.col("found").alias("core")), "pivot").select("grp", "pivot", "core"), "pivots")
    apart = map_batches(sets.join(pivots, "grp").select("doc_id", "grp", "n", "component", "found", "pivot", "core"), partial(_differences, similarity), "doc_id long, grp long, n long, component long, pivot long, d long, linked boolean, found binary")
    return keep(apart, "apart")


def _overlapping(apart: DataFrame, similarity: int, keep: Scratch) -> DataFrame:
    """Pairs (a, b) of a group that may be linked and aren't known to be in one component.

    Two sets are linked if they differ in at most ``far(n, n')`` elements. They differ in
    d + d' - 2 * (common elements of their differences from the pivot), so they need
    ``need`` of these in common. If need <= 0, both are linked to the pivot (d + d' <= far
    implies d <= far(n, pivot) and d' likewise). Otherwise, with the elements of each
    difference put in one order, rarest first, the two share an element at a place up to
    d - need and d' - need. Elements that one document alone has come first and are in
    no overlap; u counts them.
    """
    rows = map_batches(apart.select("doc_id", "grp", "found"), _elements, "doc_id long, grp long, x long")
    counts = rows.groupBy("grp", "x").agg(F.count("*").alias("c")).filter("c > 1")
    shared = rows.join(keep(counts, "counts"), ["grp", "x"])
    one = Window.partitionBy("grp", "doc_id")
    shared = shared.select("grp", "x", "doc_id", F.row_number().over(one.orderBy("c", "x")).alias("place"), F.count("*").over(one).alias("v"))
    known = apart.select("doc_id", "n", "d", "linked", "component")
    shared = shared.join(known, "doc_id").withColumn("place", F.col("d") - F.col("v") + F.col("place") - 1)

    def far(n):
        return F.floor((100 - similarity) * n / (100 + similarity))

    # the farthest place that any partner can ask for: it has at most 100 n / similarity elements, and d' >= d - far
    most = far(F.col("n") + F.floor(100 * F.col("n") / similarity))
    shared = keep(shared.filter(2 * F.col("place") <= F.col("d") - F.greatest(F.lit(0), F.col("d") - most) + most), "shared")
    p, q = (shared.select("grp", "x", *[F.col(c).alias(s + c) for c in ("doc_id", "place", "v", "n", "d", "linked", "component")]) for s in "pq")
    p = p.filter("NOT plinked")  # as a rule few: most documents of a large group are linked to its pivot
    need = F.ceil((F.col("pd") + F.col("qd") - far(F.col("pn") + F.col("qn"))) / 2)
    fine = (F.col("qlinked") | (F.col("pdoc_id") < F.col("qdoc_id"))) & (F.col("pcomponent") != F.col("qcomponent"))
    fine &= (need > 0) & (need <= F.least("pv", "qv")) & (F.col("pplace") <= F.col("pd") - need) & (F.col("qplace") <= F.col("qd") - need)
    return keep(p.join(q, ["grp", "x"]).filter(fine).select(F.least("pdoc_id", "qdoc_id").alias("a"), F.greatest("pdoc_id", "qdoc_id").alias("b")).distinct(), "pairs")


def link_components(docs: DataFrame, found: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, component for representatives with links; found: sketch(docs, similarity), written."""
    keep = Scratch()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    classes = found.filter("n > 0 AND doc_id IS NOT NULL").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("doc_id"))
    first = keep(found.select("doc_id", "sig", "bands").join(classes.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id", "sig"]), "first")
    keys = first.select("doc_id", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("key")
    members = keep(keys.join(shared, "key").select("key", "doc_id").distinct(), "members")
    links = _confirmed(keep(_stars(members), "pairs"), first, docs, similarity, keep)
    labels = components(links)
    open_ = keep(_open(members, labels), "open")
    if not open_.isEmpty():
        apart = _pivoted(open_, docs, similarity, keep)
        to_pivot = apart.filter("linked AND doc_id <> pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b"))
        more = _confirmed(_overlapping(apart, similarity, keep), first, docs, similarity, keep)
        discard(labels)
        labels = components(links.unionByName(to_pivot).unionByName(more))
    keep.clear()
    return labels


def _report(docs: DataFrame, similarity: int, keep: Scratch) -> DataFrame:
    """near_duplicates(), reading tables that keep holds."""
    found = keep(sketch(docs, similarity), "sketch")
    labels = keep.own(link_components(docs, found, similarity))
    rows = found.select("doc_id", "n", "h1", "h2")
    classes = rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    classes = classes.join(labels.select(F.col("doc_id").alias("least"), "component"), "least", "left")
    # a class of one without a link needs no row: its component is itself
    classes = keep(classes.filter("rows > 1 OR component IS NOT NULL").select("n", "h1", "h2", F.coalesce("component", "least").alias("component")), "classes")
    classes = F.broadcast(classes) if classes.count() <= BROADCAST_CLASSES else classes
    out = rows.join(classes, ["n", "h1", "h2"], "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs(doc_id, text)."""
    return _report(docs, similarity, Scratch())


def keep_one(docs: DataFrame, similarity: int = STAGE_SIMILARITY) -> DataFrame:
    """docs without the rows that are not the least id of their component; columns unchanged."""
    keep = Scratch()
    gone = materialise(_report(docs, similarity, keep).filter(~F.col("kept")).select("doc_id").distinct(), "gone")
    keep.clear()
    return restrict(docs, gone, "left_anti")
