"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lectern.functions.batches import pieces
from lectern.sources.folders import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lectern_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what materialise() wrote; df must not be read afterwards."""
    spark, path = df.sparkSession, getattr(df, "_lectern_path", None)
    if path:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Writes intermediate tables as materialise() does, and deletes them together once none is read any more."""

    def __init__(self):
        self.held: list[DataFrame] = []

    def __call__(self, df: DataFrame, label: str) -> DataFrame:
        return self.own(materialise(df, label))

    def own(self, df: DataFrame) -> DataFrame:
        self.held.append(df)
        return df

    def clear(self) -> None:
        for df in self.held:
            discard(df)
        self.held = []


def release() -> None:
    """Gives memory that a finished task has freed back to the system: the worker lives on for other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class BatchMap:
    """Picklable mapInArrow function: a dict of columns for each piece of a record batch."""

    def __init__(self, fn: Callable, schema: T.StructType):
        self.fn, self.schema = fn, schema

    def __call__(self, batches):
        target = to_arrow_schema(self.schema)
        for batch in batches:
            for piece in pieces(batch):
                yield pa.RecordBatch.from_pydict(self.fn(piece), schema=target)
        release()


def map_batches(df: DataFrame, fn: Callable, ddl: str) -> DataFrame:
    """df through fn (record batch -> dict of lists); fn must be picklable."""
    schema = T.StructType.fromDDL(ddl)
    return df.mapInArrow(BatchMap(fn, schema), schema)


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of an id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def fresh(names: list[str], base: str) -> str:
    """base, lengthened until it clashes with none of names (Spark ignores case)."""
    taken = {n.lower() for n in names}
    while base.lower() in taken:
        base += "_"
    return base


def bounded_sample(df: DataFrame, rows: int, by: list[str], stratum: str | None = None) -> DataFrame:
    """About ``rows`` distinct rows of df (for each value of stratum), all of them if there are no more.

    Rows that are equal in the columns ``by`` (without null structs) count once, however
    often they come; which are taken depends on a hash of these columns alone, so that a
    rerun, another partitioning or other copies of a row change nothing. The number is
    that of a binomial draw around ``rows``, after a distinct count that is right to
    about 2 %: beyond 1.5 times ``rows`` for rows >= 1000 it is out of practical reach.
    Only for fitting models: what is computed from it must not drop rows of a result.
    """
    mark, buckets = F.xxhash64(F.lit("sample"), *[F.col(c) for c in by]), 1 << 30
    place = F.pmod(F.xxhash64(F.lit("place"), mark), F.lit(buckets))
    if stratum is None:
        total = df.select(F.approx_count_distinct(mark, 0.02)).first()[0]
        if total > rows:
            df = df.filter(place < int(buckets * rows / total))
    else:  # a number for each stratum: as many as the model that is fitted will hold
        totals = df.groupBy(stratum).agg(F.approx_count_distinct(mark, 0.02).alias("n")).filter(F.col("n") > rows).collect()
        if totals:
            cuts = F.map_from_arrays(F.array(*[F.lit(r[0]) for r in totals]), F.array(*[F.lit(int(buckets * rows / r.n)) for r in totals]))
            df = df.filter(place < F.coalesce(F.try_element_at(cuts, F.col(stratum)), F.lit(buckets)))
    name = fresh(df.columns, "mark")
    return df.withColumn(name, mark).dropDuplicates([name]).drop(name)
