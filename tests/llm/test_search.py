import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import metric_search
from lectern.llm.common import table

LONG = (1 << 63) - 1


def plainly(vectors, step, k=5):
    """All scores in whole numbers of any size, sorted."""
    fine = {}
    for i, v in vectors:
        if i is not None and v and all(x is not None and np.isfinite(np.float32(x)) for x in v):
            fine.setdefault((i, tuple(int(np.floor(float(np.float32(x)) * 256)) for x in v)), None)
    out = set()
    for q, a in fine:
        if q % step == 0:
            found = {(max(-LONG - 1, min(LONG, sum(x * y for x, y in zip(a, b)))), -i) for i, b in fine if i != q and len(a) == len(b)}  # noqa: B905
            out |= {(q, n + 1, -i, s) for n, (s, i) in enumerate(sorted(found, reverse=True)[:k])}
    return out


def found(df, step=50, k=5):
    return {(r.query_id, r["rank"], r.vec_id, r.score) for r in metric_search.top_k(df, f"vec_id % {step} = 0", k).collect()}


def frame(spark, vectors):
    return spark.createDataFrame(vectors, "vec_id long, embedding array<float>")


@pytest.mark.parametrize(("rows", "roots"), [(40, 64 << 20), (40, 0), (16384, 64 << 20)])
def test_search_over_many_shards_equals_brute_force(spark, monkeypatch, rows, roots):
    monkeypatch.setattr(metric_search, "SHARD_ROWS", rows)
    monkeypatch.setattr(metric_search, "ROOT_BYTES", roots)
    monkeypatch.setattr(metric_search, "PAGE", 8)
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(6, 5))
    points = [(i, (centres[i % 6] + 0.1 * draw.normal(size=5)).astype(np.float32).tolist()) for i in range(300)]
    points += [(1000 + i, [0.5, 0.5, 0.0, 0.0, 1.0]) for i in range(60)]  # equal ones: ties
    points += [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0]), (2050, [float("nan")] * 5), (2100, []), (2150, [1.0, 2.0]), (2200, [3.0, 1.0]), (None, [1.0] * 5)]
    points += points[:20]
    assert found(frame(spark, points).repartition(4).withColumn("dim", F.lit("x")).withColumn("v", F.lit(1))) == plainly(points, 50)


def test_components_of_any_size(spark):
    vectors = [(0, [3e18, -1.0]), (50, [1e-3, -1e-3]), (1, [3e38, 3e38]), (2, [-3e38, 1.0]), (3, [0.5, 0.25]), (4, [1e6, 1e6]), (100, [2.5e15, 1.0])]
    assert found(frame(spark, vectors)) == plainly(vectors, 50)


def test_fewer_candidates_than_asked_for(spark):
    vectors = [(0, [1.0]), (50, [2.0]), (7, [-1.0])]
    assert found(frame(spark, vectors)) == plainly(vectors, 50) and len(plainly(vectors, 50)) == 4
    assert found(frame(spark, vectors[:1])) == set() == found(frame(spark, vectors).limit(0))


def test_more_equal_vectors_than_asked_for(spark):
    vectors = [(i, [1.0, 1.0]) for i in range(200)] + [(200 + i, [0.1 * i, 0.0]) for i in range(20)]
    assert found(frame(spark, vectors).repartition(6)) == plainly(vectors, 50)


def test_pages_are_passed_over():
    draw = random.Random(1)
    points = np.array([[round(c + draw.random()) for _ in range(4)] for c in range(0, 40_000, 10)], dtype=float)
    tree = metric_search.build([[i] for i in range(len(points))], points)
    best, computed = metric_search.search(tree, None, points[-1], 3)
    assert computed < len(points) / 4
    want = sorted(((int(p @ points[-1]), -i) for i, p in enumerate(points)), reverse=True)[:3]
    assert [(s, -i) for s, i in best] == want
    again, fewer = metric_search.search(tree, None, points[-1], 3, best[-1][0])
    assert again == best and fewer <= computed


def test_the_given_vectors(spark):
    sf = "/root/testdata/sf0.001"
    df = table(spark, sf, "embeddings")
    vectors = [(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()]
    assert found(df) == plainly(vectors, 50)
