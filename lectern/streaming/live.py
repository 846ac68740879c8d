"""Structured Streaming forms: feedback ingest, throttled progress, playback lookups.

Streams write files in a folder that the caller names; nothing is gathered in the driver.
Watermarks are an extension: they bound the state that a stream keeps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.sources import files

#: The share of a page that its tokens alone can complete.
MOST_OF_A_PAGE = 0.95


def feedback(raw: DataFrame, dialect: str = "web") -> DataFrame:
    """Accepted records of a stream of JSON lines; stateless, so append mode will do."""
    return files.accepted(files.parse_feedback(raw, dialect), dialect)


def append_to(stream: DataFrame, path: str, checkpoint: str, form: str = "parquet", once: bool = False) -> StreamingQuery:
    """Starts writing a stream to files below path; checkpoint is a folder that survives the driver's machine."""
    writer = stream.writeStream.format(form).outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def progress(tokens: DataFrame, every: str = "250 milliseconds", late: str = "1 minute") -> DataFrame:
    """Tokens per page and window of tokens(ts, page). Rows later than ``late`` go (an extension: the watermark bounds the state)."""
    counted = tokens.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "page").agg(F.count("*").alias("tokens"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return counted.select(F.col("w.start").alias("start"), "page", "tokens", "first", "last")


def running(windows: DataFrame) -> DataFrame:
    """start, page, tokens (so far) and tokens a second (since the page's first token, up to the window's last) of what progress() wrote."""
    order = Window.partitionBy("page").orderBy("start")
    micros = F.unix_micros("last") - F.min(F.unix_micros("first")).over(Window.partitionBy("page"))
    d = windows.withColumn("tokens", F.sum("tokens").over(order))
    return d.select("start", "page", "tokens", F.try_divide(F.col("tokens") * 1_000_000, micros).alias("tokens_per_second"))


def downloads(reports: DataFrame) -> DataFrame:
    """loaded, total: the latest report of each file, summed. reports: ts, file, loaded, total."""
    last = reports.groupBy("file").agg(F.max_by("loaded", "ts").alias("loaded"), F.max_by("total", "ts").alias("total"))
    return last.agg(F.sum("loaded").alias("loaded"), F.sum("total").alias("total"))


def fraction(done: Column, total: Column, tokens: Column, expected: Column) -> Column:
    """The share of a job that is done: whole pages, and of the one in work at most MOST_OF_A_PAGE by its tokens."""
    page = F.least(F.lit(MOST_OF_A_PAGE), F.coalesce(F.try_divide(tokens, expected), F.lit(0.0)))
    return F.coalesce(F.try_divide(done + page, total), F.lit(0.0))


def remaining(elapsed: str, done: str, total: str) -> Column:
    """Seconds left at the pace so far; null before anything is done."""
    return F.try_divide(F.col(elapsed) * (F.col(total) - F.col(done)), F.col(done))


def playback(ticks: DataFrame, words: DataFrame, late: str = "1 minute") -> DataFrame:
    """Stream-static lookup: the word playing at each tick of ticks(doc_id, ts, time_ms). words: doc_id, pos, start_ms, next_ms.

    Time is cut into stretches of STRETCH milliseconds, and a word stands in each that it
    touches (the last word of a document, which has no end, in all of its ticks' by a join of its own).
    """
    w = words.withColumn("stretch", F.explode(F.sequence(stretch("start_ms"), stretch("next_ms", -1)))).filter("next_ms > start_ms")
    d = ticks.withWatermark("ts", late)
    inner = d.withColumn("stretch", stretch("time_ms")).join(w, ["doc_id", "stretch"]).filter("time_ms >= start_ms AND time_ms < next_ms")
    final = d.join(words.filter("next_ms IS NULL"), "doc_id").filter("time_ms >= start_ms")
    return inner.select("doc_id", "ts", "time_ms", "pos").unionByName(final.select("doc_id", "ts", "time_ms", "pos"))


STRETCH = 10_000


def stretch(c: str, shift: int = 0) -> Column:
    return F.floor((F.col(c) + shift) / STRETCH).cast("long")


def changes(played: DataFrame) -> DataFrame:
    """The ticks of what playback() wrote at which the word is another than before."""
    before = F.lag("pos").over(Window.partitionBy("doc_id").orderBy("ts", "time_ms"))
    return played.withColumn("_b", before).filter(F.col("_b").isNull() | (F.col("_b") != F.col("pos"))).drop("_b")


def demultiplex(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(audio, word boundaries) of a stream of chunks(kind, ...)."""
    return chunks.filter("kind = 'audio'"), chunks.filter("kind = 'boundary'")
