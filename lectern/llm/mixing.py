"""Mixing sources to target weights, in DataFrame operations only.

With source token shares p, the weights are p**a / sum(p**a). The exponent a is bisected:
from 1 (as the sources are) towards 0 (all alike) as far as the repetition limit allows,
or until the weights have the target entropy. The weights are realised in blocks: a
source's documents are dealt into blocks by a hash of their id; every epoch takes the
blocks in a permutation of its own, whole epochs in full and the last one up to the
source's token budget.

By default the total budget is the least at which no source falls below one whole epoch:
nothing is dropped, sources below their weight are repeated. With ``budget`` (a share of
all tokens) sources above theirs are cut.

Tokens are estimated as a quarter of the UTF-8 bytes, rounded up. Null sources are a
source of their own; sources without any token are kept once. Null ids go to one block.
Rows that repeat an id are mixed alike. Columns of docs keep their names, whatever these
are. An empty table gives an empty result.

The exponent is found in one row that holds the distinct token totals of the sources and
how many sources have each; there are at most sqrt(2 * tokens) of these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import fresh, materialise

#: Tokens of a block: at least LEAST_BLOCK, and so many that all sources have at most BLOCKS between them
#: besides FINE for each source.
LEAST_BLOCK, BLOCKS, FINE = 16384, 100_000, 64
#: Tables of at most so many rows (under 100 bytes each) are broadcast, larger ones joined by key.
BROADCAST_ROWS = 400_000
STEPS = 50


def token_estimate(text: str = "text") -> Column:
    return F.ceil(F.coalesce(F.octet_length(F.col(text)), F.lit(0)) / 4).cast("long")


def source_key(source: str = "source") -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))


def power_sum(shares: Column, a: Column) -> Column:
    """shares: (p, n), a share and the number of sources that have it, in order of p."""
    return F.aggregate(shares, F.lit(0.0), lambda z, x: z + x["n"] * F.pow(x["p"], a))


def entropy(shares: Column, a: Column) -> Column:
    """Of the weights p**a / sum(p**a), in nats."""
    z = power_sum(shares, a)
    return F.log(z) - a * F.aggregate(shares, F.lit(0.0), lambda s, x: s + x["n"] * F.pow(x["p"], a) * F.log(x["p"])) / z


def repetition(shares: Column, a: Column, budget: float | None) -> Column:
    """How often the most repeated source is read."""
    least, most = shares[0]["p"], F.element_at(shares, -1)["p"]
    return F.pow(most / least, F.lit(1.0) - a) if budget is None else F.lit(budget) * F.pow(least, a - 1) / power_sum(shares, a)


def bisected(fine) -> Column:
    """The least a from 0 to 1 for which fine(a) holds (true from some a on), to 9 places."""
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def step(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        holds = fine(mid)
        return F.struct(F.when(holds, s["lo"]).otherwise(mid).alias("lo"), F.when(holds, mid).otherwise(s["hi"]).alias("hi"))

    return F.round(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)["hi"], 9)


def exponent(shares: Column, max_repeats: float | None, target_entropy: float | None, budget: float | None) -> Column:
    """target_entropy is a share of the highest (the logarithm of the number of sources)."""
    found = []
    if max_repeats is not None:
        found.append(bisected(lambda a: repetition(shares, a, budget) <= max_repeats))
    if target_entropy is not None:
        sources = F.aggregate(shares, F.lit(0).cast("long"), lambda n, x: n + x["n"])
        found.append(bisected(lambda a: entropy(shares, a) <= target_entropy * F.log(sources)))
    return F.greatest(*found) if len(found) > 1 else found[0] if found else F.lit(1.0)


def source_weights(totals: DataFrame, max_repeats: float | None = 2.0, target_entropy: float | None = None, budget: float | None = None) -> DataFrame:
    """key, total, weight, epochs (how often the source is read), blocks of totals(key, total); sources without tokens have no row."""
    some = totals.filter("total > 0")
    every = some.groupBy("total").agg(F.count("*").alias("n")).agg(F.sort_array(F.collect_list(F.struct("total", "n"))).alias("t"), F.sum(F.col("total") * F.col("n")).alias("tokens"))
    every = every.withColumn("p", F.transform("t", lambda x: F.struct((x["total"] / F.col("tokens")).alias("p"), x["n"].alias("n"))))
    every = every.withColumn("a", exponent(F.col("p"), max_repeats, target_entropy, budget))
    every = every.withColumn("z", power_sum(F.col("p"), F.col("a")))
    every = every.withColumn("lowest", F.pow(F.element_at("p", -1)["p"], F.col("a") - 1))  # a is at most 1: the largest share is read least
    every = every.select(F.explode(F.transform("t", lambda x: x["total"])).alias("total"), "tokens", "a", "z", "lowest")
    share = F.col("total") / F.col("tokens")
    scale = F.pow(share, F.col("a") - 1)
    out = every.select(
        "total", (F.pow(share, F.col("a")) / F.col("z")).alias("weight"),
        (scale / F.col("lowest") if budget is None else F.lit(budget) * scale / F.col("z")).alias("epochs"),
        F.greatest(F.ceil(F.col("total") / F.greatest(F.lit(LEAST_BLOCK), F.ceil(F.col("tokens") / BLOCKS))), F.lit(FINE)).cast("long").alias("blocks"),
    )
    return some.join(out, "total").select("key", "total", "weight", "epochs", "blocks")


def block_of(doc_id: str, blocks: Column) -> Column:
    digest = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), blocks)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if it has at most so many rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def schedule(docs: DataFrame, weights: DataFrame, sources: int) -> DataFrame:
    """key, block, epoch, block_rank: what is read of each source, from docs(doc_id, key, tokens)."""
    dealt = docs.join(small(weights.select("key", "blocks"), sources), "key").withColumn("block", block_of("doc_id", F.col("blocks")))
    sums = dealt.groupBy("key", "block").agg(F.sum("tokens").alias("tokens")).join(small(weights.select("key", "total", "epochs"), sources), "key")
    epochs = sums.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil("epochs") - 1, F.lit(0)).cast("int"))))
    order = [F.md5(F.concat_ws(":", "key", "block", "epoch")), F.col("block")]
    one = Window.partitionBy("key", "epoch").orderBy(*order)
    epochs = epochs.withColumn("block_rank", F.row_number().over(one).cast("long") - 1)
    epochs = epochs.withColumn("read", F.sum("tokens").over(one.rowsBetween(Window.unboundedPreceding, 0)))
    left = (F.col("epochs") - F.col("epoch")) * F.col("total")
    return epochs.filter((F.col("epoch") + 1 <= F.col("epochs")) | (F.col("read") <= left)).select("key", "block", "epoch", "block_rank")


def plan(docs: DataFrame, **parameters) -> tuple[DataFrame, DataFrame, int, int]:
    """(weights, schedule, their numbers of rows), both written; docs: doc_id, text, source."""
    known = docs.select("doc_id", source_key().alias("key"), token_estimate().alias("tokens"))
    weights = materialise(source_weights(known.groupBy("key").agg(F.sum("tokens").alias("total")), **parameters), "weights")
    sources = weights.count()
    order = materialise(schedule(known, weights, sources), "schedule")
    return weights, order, sources, order.count()


def mixed(docs: DataFrame, max_repeats: float | None = 2.0, target_entropy: float | None = None, budget: float | None = None) -> tuple[DataFrame, list[str]]:
    """The rows of docs as often as they are read, with three columns more, and their names: epoch, block and block_rank."""
    weights, order, sources, rows = plan(docs, max_repeats=max_repeats, target_entropy=target_entropy, budget=budget)
    key, blocks, block, epoch, rank = (fresh(docs.columns, f"__{x}") for x in ("key", "blocks", "block", "epoch", "rank"))
    weights = weights.select(F.col("key").alias(key), F.col("blocks").alias(blocks))
    order = order.select(F.col("key").alias(key), F.col("block").alias(block), F.col("epoch").alias(epoch), F.col("block_rank").alias(rank))
    out = docs.withColumn(key, source_key()).join(small(weights, sources), key, "left")
    # sources without tokens have no block: theirs are no block's numbers, spread over many keys
    out = out.withColumn(block, F.coalesce(block_of("doc_id", F.col(blocks)), F.lit(-1).cast("long") - F.pmod(F.xxhash64("doc_id"), F.lit(4096))))
    out = out.join(small(order, rows), [key, block], "left")
    return out.filter(F.col(epoch).isNotNull() | F.col(blocks).isNull()).drop(key, blocks), [epoch, block, rank]


def mixing_report(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, source, tokens, epoch, block, block_rank: one row for each time that a row of docs is read."""
    out, (epoch, block, rank) = mixed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source")), **parameters)
    return out.select(
        "doc_id", "source", token_estimate().alias("tokens"), F.coalesce(epoch, F.lit(0)).cast("long").alias("epoch"),
        F.greatest(F.col(block), F.lit(0)).cast("long").alias("block"), F.coalesce(rank, F.lit(0)).cast("long").alias("block_rank"),
    )


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """docs with rows repeated (or cut, given a budget) to the target weights; columns unchanged."""
    return mixed(docs, **parameters)[0].select(*docs.columns)
