"""Exact top-k by inner product through M-trees searched best first.

Inner product becomes a Euclidean distance by one more coordinate: stored vectors x
get sqrt(M^2 - |x|^2), queries 0, so that d(q, x)^2 = |q|^2 + M^2 - 2 q.x. Vectors go to
the nearest of some pivots, and cells to shards of bounded size; each shard is an M-tree
whose nodes are pages: arrays of entries with their distance to the parent's routing
object and, for inner entries, a covering radius. The search keeps a queue of pages by
their lower bound; within a page, entries that |d(q, parent) - d(entry, parent)| - radius
already rules out are skipped before any distance to them is computed. Distances only
steer; scores are exact, and bounds have slack for rounding.

Queries first search the shard whose root is nearest. Its k-th best score then rules out
shards by their roots' covering radii, and starts the search in the others. Queries come in
blocks; a block meets a shard in a task of its own, and the shards' best are merged. Where
vectors have no clusters, as random ones in many dimensions, few shards are ruled out, and
the work grows with queries times vectors, as an exact search then must.

Equal vectors share one entry with their k + 1 least ids; of those that one batch holds, no
more are ever sent. Vectors that are null, hold null or non-finite components, or are empty
take no part (components may have any size that a float has); a query meets candidates of its own length. Scores beyond the range of a long
are given as its ends. Ties go to the smaller id. Rows that repeat an id count as one if the
vectors are equal. Rows without an id take no part. Other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import heapq
import pickle
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import Scratch, bounded_sample, materialise

PAGE, FANOUT, SHARD_ROWS, QUERY_BLOCK = 256, 16, 16384, 512
#: Pivots of a dimension; bytes of the sample from which they are chosen; bytes of roots up to which shards are ruled out by them.
PIVOTS, PIVOT_BYTES, ROOT_BYTES = 1024, 16 << 20, 64 << 20
LONG = (1 << 63) - 1


def quantised(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id, dim, v: floor(scale * x) of each component x, as doubles, of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    # doubles from 2**52 on are whole numbers, which a long may not hold
    whole = lambda c: F.when(F.abs(c) < 2.0**52, F.floor(c).cast("double")).otherwise(c)
    return vectors.filter(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.size(x).alias("dim"), F.transform(x, lambda c: whole(c * scale)).alias("v"))


def scores(vectors: np.ndarray, query: np.ndarray) -> list[int]:
    """Exact inner products of whole numbers."""
    most = float(np.abs(vectors).max(initial=0)) * float(np.abs(query).max(initial=0)) * len(query)
    if most < 2.0**53:
        return (vectors @ query).astype(np.int64).tolist()
    q = [int(x) for x in query]
    return [sum(int(x) * y for x, y in zip(row, q, strict=True)) for row in vectors]


def _distances(point: np.ndarray, others: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((others - point) ** 2).sum(axis=1), 0))


def _split(points: np.ndarray, index: np.ndarray, size: int) -> list[np.ndarray]:
    """Groups of at most size by repeated splitting between two far points (balanced, so depth is bounded)."""
    out, todo = [], [index]
    while todo:
        part = todo.pop()
        if len(part) <= size:
            out.append(part)
            continue
        a = points[part[np.argmax(_distances(points[part[0]], points[part]))]]
        da = _distances(a, points[part])
        b = points[part[np.argmax(da)]]
        order = np.argsort(da - _distances(b, points[part]), kind="stable")
        half = len(part) // 2
        todo += [part[order[:half]], part[order[half:]]]
    return out


def build(ids: list[list[int]], vectors: np.ndarray) -> dict:
    """A bulk-loaded M-tree. ids[i]: the ids that have vector i."""
    norm2 = (vectors.astype(np.float64) ** 2).sum(axis=1)
    top2 = float(norm2.max())
    points = np.column_stack([vectors.astype(np.float64), np.sqrt(np.maximum(top2 - norm2, 0))])
    pages: list[dict] = []

    def page(members: np.ndarray, centres: np.ndarray, radii: np.ndarray, children) -> tuple[np.ndarray, float, int]:
        centre = centres[np.argmin(_distances(centres.mean(axis=0), centres))]
        to_parent = _distances(centre, centres)
        pages.append({"points": centres, "to_parent": to_parent, "radius": radii, "children": children, "rows": members})
        return centre, float((to_parent + radii).max()), len(pages) - 1

    level = [page(g, points[g], np.zeros(len(g)), None) for g in _split(points, np.arange(len(points)), PAGE)]
    while len(level) > 1:
        centres = np.array([c for c, _, _ in level])
        level = [page(None, centres[g], np.array([level[i][1] for i in g]), [level[i][2] for i in g]) for g in _split(centres, np.arange(len(level)), FANOUT)]
    return {"pages": pages, "root": level[0], "ids": ids, "vectors": vectors, "top2": top2}


def reach_of(base: float, score: float) -> float:
    """The distance that belongs to a score."""
    return max(0.0, base - 2 * score) ** 0.5


def slack_of(base: float) -> float:
    return 1e-6 * (1 + base**0.5)


def search(tree: dict, query_id: int | None, query: np.ndarray, k: int, least: int | None = None) -> tuple[list[tuple[int, int]], int]:
    """The k best (score, vec_id) without query_id, none below the score ``least``; and the number of distances computed."""
    point = np.append(query, 0.0)
    base = float(query @ query) + tree["top2"]
    slack = slack_of(base)
    best: list[tuple[int, int]] = []  # heap of (score, -id): the worst first
    floor = -float("inf") if least is None else least
    reach, computed = float("inf") if least is None else reach_of(base, least), 1  # reach: the distance of the k-th best
    centre, radius, root = tree["root"]
    d = float(_distances(point, centre[None])[0])
    queue = [(max(0.0, d - radius), root, d)]
    pages, ids, vectors = tree["pages"], tree["ids"], tree["vectors"]
    while queue:
        bound, number, to_parent = heapq.heappop(queue)
        if bound > reach + slack:
            break
        p = pages[number]
        near = np.flatnonzero(np.abs(to_parent - p["to_parent"]) - p["radius"] <= reach + slack)
        if not len(near):
            continue
        computed += len(near)
        if p["children"] is None:
            rows = p["rows"][near]
            found = scores(vectors[rows], query)
            enough = max(floor, best[0][0]) if len(best) == k else floor
            for i in [i for i, score in enumerate(found) if score >= enough]:
                for vec_id in ids[rows[i]]:
                    if vec_id != query_id:
                        if len(best) < k:
                            heapq.heappush(best, (found[i], -vec_id))
                        elif (found[i], -vec_id) > best[0]:
                            heapq.heapreplace(best, (found[i], -vec_id))
                        else:
                            break
            if len(best) == k:
                reach = min(reach, reach_of(base, best[0][0]))
        else:
            far = _distances(point, p["points"][near])
            for i, d in zip(near.tolist(), far.tolist(), strict=True):
                if (low := max(0.0, d - p["radius"][i])) <= reach + slack:
                    heapq.heappush(queue, (low, p["children"][i], d))
    return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1])), computed


def _distinct(ids, vectors, k: int) -> tuple[list[list[int]], np.ndarray]:
    """The distinct vectors, each with its k + 1 least ids."""
    whole = np.stack(vectors)
    order = np.argsort(np.asarray(ids), kind="stable")
    rows, inverse = np.unique(whole[order], axis=0, return_inverse=True)
    of: list[list[int]] = [[] for _ in rows]
    for i, r in zip(np.asarray(ids)[order].tolist(), inverse.ravel().tolist(), strict=True):
        if len(of[r]) <= k and (not of[r] or of[r][-1] != i):
            of[r].append(i)
    return of, rows


def spread(sample: np.ndarray, count: int) -> np.ndarray:
    """Up to count vectors of a sample, each as far as can be from those before it."""
    chosen, far = [0], _distances(sample[0], sample)
    while len(chosen) < min(count, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _distances(sample[chosen[-1]], sample))
    return sample[chosen]


def _deal(pivots: dict[int, np.ndarray], k: int, batches):
    """Vectors with their nearest pivot; of equal ones in a batch, the k + 1 least ids."""
    for pdf in batches:
        for dim, part in pdf.groupby("dim"):
            of, rows = _distinct(part["vec_id"], part["v"], k)
            centres = pivots.get(int(dim), np.zeros((1, int(dim))))
            cell = np.concatenate([np.argmin((centres**2).sum(axis=1) - 2 * rows[i : i + 1024] @ centres.T, axis=1) for i in range(0, len(rows), 1024)])
            ids = [(i, r) for r, found in enumerate(of) for i in found]
            yield pd.DataFrame({"dim": int(dim), "cell": [int(cell[r]) for _, r in ids], "vec_id": [i for i, _ in ids], "v": [rows[r] for _, r in ids]})


def _tree(k: int, key, pdf: pd.DataFrame) -> pd.DataFrame:
    tree = build(*_distinct(pdf["vec_id"], pdf["v"], k))
    centre, radius, _ = tree["root"]
    return pd.DataFrame({"dim": [key[0]], "cell": [key[1]], "part": [key[2]], "tree": [pickle.dumps(tree)], "centre": [centre], "radius": [radius], "top2": [tree["top2"]]})


class Roots:
    """Where the shards are, by dimension: what a query must know to pass over them."""

    def __init__(self, rows, blind: bool = False):
        """blind: rows have no centres; then no shard is passed over."""
        self.by: dict[int, tuple] = {}
        for dim in {r.dim for r in rows}:
            own = sorted((r for r in rows if r.dim == dim), key=lambda r: (r.cell, r.part))
            geometry = () if blind else (np.array([r.centre for r in own]), np.array([r.radius for r in own]), np.array([r.top2 for r in own]))
            self.by[dim] = ([(r.cell, r.part) for r in own], *geometry)

    def bounds(self, query: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
        """(shards, least distances to them, base of each)."""
        shards, *geometry = self.by[len(query)]
        if not geometry:
            return shards, np.zeros(len(shards)), np.full(len(shards), np.inf)
        centres, radii, top2 = geometry
        return shards, np.maximum(_distances(np.append(query, 0.0), centres) - radii, 0), query @ query + top2

    def home(self, query: np.ndarray) -> tuple[int, int]:
        """The shard that may hold the best score."""
        shards, low, base = self.bounds(query)
        return shards[int(np.argmax(base - low**2))]

    def others(self, query: np.ndarray, least: int | None) -> list[tuple[int, int]]:
        """All other shards that may hold a score of at least ``least``."""
        shards, low, base = self.bounds(query)
        home = self.home(query)
        if least is None:
            return [s for s in shards if s != home]
        return [s for s, d, b in zip(shards, low, base, strict=True) if s != home and (b == np.inf or d <= reach_of(b, least) + slack_of(b))]


def _visits(roots: Roots, first: bool, batches):
    """A row for each shard that a query (vec_id, v, least) is to search."""
    for pdf in batches:
        rows = []
        for i, v, least in zip(pdf["vec_id"], pdf["v"], pdf["least"], strict=True):
            least = None if pd.isna(least) else int(least)
            rows += [(len(v), *s, i, v, least) for s in ([roots.home(v)] if first else roots.others(v, least))]
        out = pd.DataFrame(rows, columns=["dim", "cell", "part", "vec_id", "v", "least"])
        yield out.astype({"least": "Int64"})


def _block(key, pdf: pd.DataFrame) -> pd.DataFrame:
    queries = (pdf["vec_id"].to_numpy(np.int64), np.stack(pdf["v"]), [None if pd.isna(x) else int(x) for x in pdf["least"]])
    return pd.DataFrame({"dim": [key[0]], "cell": [key[1]], "part": [key[2]], "queries": [pickle.dumps(queries)]})


def _search(k: int, batches):
    for pdf in batches:
        for tree, queries in zip(pdf["tree"], pdf["queries"], strict=True):
            tree = pickle.loads(tree)
            found = [(int(q), max(-LONG - 1, min(LONG, s)), i) for q, v, least in zip(*pickle.loads(queries), strict=True) for s, i in search(tree, int(q), v, k, least)[0]]
            yield pd.DataFrame(found, columns=["query_id", "score", "vec_id"], dtype=np.int64)


VISIT = "dim int, cell int, part int, vec_id long, v array<double>, least long"


def _found(asked: DataFrame, trees: DataFrame, visits, k: int) -> DataFrame:
    """query_id, score, vec_id: the best of the shards that visits names for each query of asked(vec_id, v, least)."""
    rows = asked.select("vec_id", "v", "least").mapInPandas(visits, VISIT)
    shard = ["dim", "cell", "part"]
    # blocks by a hash: a shard that many queries visit is searched by many tasks
    some = rows.groupBy(*shard).agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / QUERY_BLOCK)).drop("n")
    rows = rows.join(some, shard).withColumn("block", F.pmod(F.xxhash64(F.lit(1), F.col("vec_id")), F.col("blocks")).cast("int"))
    blocks = rows.groupBy(*shard, "block").applyInPandas(_block, "dim int, cell int, part int, queries binary")
    return blocks.join(trees.select(*shard, "tree"), shard).select("tree", "queries").mapInPandas(partial(_search, k), "query_id long, score long, vec_id long")


def top_k(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of vectors(vec_id, embedding) for each row where is_query holds."""
    keep = Scratch()
    known = keep(quantised(vectors), "vectors")
    sizes = {r.dim: r.n for r in known.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row for each length of vectors
    pivots = {}
    for dim, n in sizes.items():
        wanted = min(PIVOTS, -(-n // SHARD_ROWS))
        if wanted > 1:
            rows = min(4 * wanted + 64, max(1, PIVOT_BYTES // (8 * dim)))
            sample = bounded_sample(known.filter(F.col("dim") == dim), rows, ["vec_id"]).select("vec_id", "v").collect()
            if sample:
                pivots[dim] = spread(np.array([r.v for r in sorted(sample, key=lambda r: r.vec_id)]), wanted)
    dealt = keep(known.mapInPandas(partial(_deal, pivots, k), "dim int, cell int, vec_id long, v array<double>"), "dealt")
    cells = dealt.groupBy("dim", "cell").agg(F.ceil(F.count("*") / SHARD_ROWS).alias("parts"))
    parted = dealt.join(F.broadcast(cells), ["dim", "cell"])  # at most PIVOTS rows for each length
    parted = parted.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    trees = keep(parted.groupBy("dim", "cell", "part").applyInPandas(partial(_tree, k), "dim int, cell int, part int, tree binary, centre array<double>, radius double, top2 double"), "trees")
    blind = (trees.agg(F.sum(8 * F.col("dim") + 64)).first()[0] or 0) > ROOT_BYTES
    roots = Roots(trees.select("dim", "cell", "part", *([] if blind else ["centre", "radius", "top2"])).collect(), blind)
    asked = known.filter(is_query).select("vec_id", "v").dropDuplicates(["vec_id", "v"]).withColumn("least", F.lit(None).cast("long"))
    first = keep(_found(asked, trees, partial(_visits, roots, True), k).distinct(), "best")
    least = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("score")).select(F.col("query_id").alias("vec_id"), F.when(F.col("n") == k, F.col("score")).alias("least"))
    again = asked.drop("least").join(least, "vec_id", "left")
    second = _found(again, trees, partial(_visits, roots, False), k)
    best = materialise(first.unionByName(second).distinct(), "best")
    keep.clear()
    ordered = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k)  # at most k rows from each shard
    out = best.groupBy("query_id").agg(ordered.alias("top")).select("query_id", F.posexplode("top"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.vec_id").alias("vec_id"), (-F.col("col.s")).alias("score"))
