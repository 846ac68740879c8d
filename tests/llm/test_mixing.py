import collections
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from lectern.llm import mixing, queries

SIZES = {"big": 4000, "middle": 1000, "small": 200, "least": 50}


def corpus(spark):
    rows, at = [], 0
    for source, n in SIZES.items():
        rows += [(at + i, "t" * 4000, source) for i in range(n)]
        at += n
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def read_shares(df):
    tokens = {r.source: r.n for r in df.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    return tokens, {k: v / sum(tokens.values()) for k, v in tokens.items()}


def entropy(shares):
    return -sum(p * math.log(p) for p in shares if p)


def exponent_plainly(fine):
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if fine(mid) else (mid, hi)
    return hi


def weights(a):
    powers = {k: n**a for k, n in SIZES.items()}
    return {k: x / sum(powers.values()) for k, x in powers.items()}


def test_weights_meet_the_target_entropy(spark):
    target = 0.8
    a = exponent_plainly(lambda a: entropy(weights(a).values()) <= target * math.log(4))
    tokens, shares = read_shares(mixing.mixing_report(corpus(spark), max_repeats=None, target_entropy=target))
    assert entropy(shares.values()) == pytest.approx(target * math.log(4), abs=0.01)
    assert all(shares[k] == pytest.approx(weights(a)[k], abs=0.01) for k in SIZES)
    assert tokens["big"] == SIZES["big"] * 1000  # nothing is dropped without a budget


def test_weights_meet_the_repetition_limit(spark):
    a = exponent_plainly(lambda a: (4000 / 50) ** (1 - a) <= 3)
    tokens, shares = read_shares(mixing.mixing_report(corpus(spark), max_repeats=3.0))
    assert tokens["least"] / (50 * 1000) == pytest.approx(3, abs=0.1) and tokens["big"] == 4_000_000
    assert all(shares[k] == pytest.approx(weights(a)[k], abs=0.01) for k in SIZES)


def test_a_budget_cuts_sources_above_their_weight(spark):
    report = mixing.mixing_report(corpus(spark), max_repeats=2.0, budget=0.5)
    tokens, shares = read_shares(report)
    total = sum(SIZES.values()) * 1000
    assert sum(tokens.values()) == pytest.approx(0.5 * total, rel=0.05)
    a = exponent_plainly(lambda a: 0.5 * weights(a)["least"] * sum(SIZES.values()) / 50 <= 2)
    assert all(shares[k] == pytest.approx(weights(a)[k], abs=0.03) for k in SIZES)
    most = collections.Counter((r.source, r.doc_id) for r in report.collect())
    assert max(most.values()) <= 2 and len([1 for s, _ in most if s == "big"]) < 4000


def test_epochs_are_permutations_of_blocks(spark):
    rows = mixing.mixing_report(corpus(spark), max_repeats=3.0).filter("source = 'least'").collect()
    first, second = ({r.block: r.block_rank for r in rows if r.epoch == e} for e in (0, 1))
    assert sorted(first.values()) == list(range(len(first))) and set(first) == set(second) and first != second
    assert len({(r.doc_id, r.epoch) for r in rows}) == len(rows)


def odd_rows():
    rows = [(i, "t" * (i % 50), f"s{i % 3}") for i in range(400)] + [(None, "x" * 40, "s1")] * 30 + [(7, "t" * 7, "s1")] * 5
    return rows + [(500 + i, None, "empty") for i in range(50)] + [(600 + i, "", "none") for i in range(20)] + [(700, "z" * 9, None), (None, None, None)]


def test_odd_rows_equal_the_sql(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    with duckdb.connect() as db:
        db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
        db.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
        want = collections.Counter(db.execute(f"SELECT doc_id, source, tokens, epoch, block, block_rank FROM ({queries.MIXING_SQL})").fetchall())
    got = collections.Counter(tuple(r) for r in mixing.mixing_report(df).select("doc_id", "source", "tokens", "epoch", "block", "block_rank").collect())
    assert got == want


@pytest.mark.parametrize("limit", [0, mixing.BROADCAST_ROWS])
def test_columns_keep_their_names(spark, monkeypatch, limit):
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", limit)
    df = spark.createDataFrame(odd_rows(), "doc_id long, text string, source string")
    odd = df.select("*", *[F.lit(n).alias(x) for n, x in enumerate(("__key", "__block", "__BLOCKS", "__epoch", "__rank", "tokens", "key", "total"))])
    out = mixing.mix(odd)
    assert out.columns == odd.columns and out.select("doc_id", "text", "source").exceptAll(mixing.mix(df)).isEmpty() and out.count() == mixing.mix(df).count() >= df.count()
    assert out.filter("__key <> 0 OR __block <> 1 OR __epoch <> 3").isEmpty()
    assert mixing.mix(odd.limit(0)).collect() == []


def test_no_python_runs(spark):
    for parameters in ({}, {"target_entropy": 0.9}, {"budget": 0.7}):
        plan = mixing.mixing_report(corpus(spark), **parameters)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
