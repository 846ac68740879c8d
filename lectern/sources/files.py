"""Readers and writers of jobs, markup files, captions, sync maps, texts and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.ordered import trimmed
from lectern.operators.timing import vtt_time

# Accepted categories, those that need no comment, and the limits of text fields.
CATEGORIES_WEB = ["missed-latex", "pronunciation", "voice-quality", "other", "thumbs-up", "thumbs-down"]
CATEGORIES_DESKTOP = ["missed-latex", "pronunciation", "other"]
NO_COMMENT_NEEDED = ["thumbs-up", "thumbs-down"]
LIMITS = {"comment": 5000, "word": 200, "segment_text": 2000, "file_name": 200, "user_agent": 400}
EXPORT_ROWS, BAD_PAGES, JOB_HOURS, TITLE_LENGTH, PASSAGE_LENGTH = 1000, 100, 24, 60, 600
#: What is read of a record; anything else in it is left out. Numbers come as text, as any JSON value may stand there.
FEEDBACK = (
    "category string, comment string, context struct<word:string,segment_text:string,time_ms:bigint,page:bigint>, "
    "file_name string, segment_count string, lint struct<unknown_commands:string,total_commands:string,bad_pages:array<string>>, user_agent string"
)


def register_jobs(spark: SparkSession, path: str) -> DataFrame:
    """job_id, path, length, modificationTime, content of the PDF files below path; contents are read only where they are selected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.filter(F.lower("path").endswith(".pdf")).select(job_id(F.col("path"), F.col("modificationTime")).alias("job_id"), "path", "length", "modificationTime", "content")


def job_id(*parts: Column) -> Column:
    """12 hexadecimal digits, the same whenever a task is run again."""
    return F.substring(F.sha2(F.concat_ws("\n", *[p.cast("string") for p in parts]), 256), 1, 12)


def with_fallback(primary: Column, fallback: Column) -> Column:
    """The primary extraction, or the fallback where it is null or blank."""
    return F.when(trimmed(F.coalesce(primary, F.lit(""))) != "", primary).otherwise(fallback)


def read_markup(spark: SparkSession, path: str) -> DataFrame:
    """path, mmd of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("mmd"))


def read_vocabulary(spark: SparkSession, *paths: str) -> DataFrame:
    """name: the lines of lists of commands, one to a line."""
    return spark.read.text(list(paths)).select(F.col("value").alias("name"))


def job_files(asked: DataFrame, files: DataFrame) -> DataFrame:
    """asked(job_id, name) with path and status of files(job_id, name, path): 200, or 404 with a null path."""
    found = asked.join(files.select("job_id", "name", "path"), ["job_id", "name"], "left")
    return found.withColumn("status", F.when(F.col("path").isNull(), 404).otherwise(200))


def base_name(c: Column) -> Column:
    return F.regexp_replace(c, r"\.[^.]+\z", "")


def write_texts(texts: DataFrame, path: str, by: str = "name") -> None:
    """texts(name, text) as text files below path, each name a folder of its own (``name=...``); names come without extension."""
    texts.select(base_name(F.col(by)).alias(by), "text").write.mode("overwrite").partitionBy(by).option("lineSep", "\n").text(path)


#: What each step of the markup pipeline makes of a document, in order, and the ending of its files.
STAGE_FILES = {"preprocessed": "mmd", "spoken": "md", "rendered": "html", "segments": "json", "final": "txt"}


def write_stages(stages: DataFrame, path: str) -> None:
    """stages(doc_id, preprocessed, spoken, rendered, segments, final) below path: a folder for each step, ``1-preprocessed`` to ``5-final``."""
    for n, (name, ending) in enumerate(STAGE_FILES.items(), 1):
        write_texts(stages.select(F.concat(F.col("doc_id").cast("string"), F.lit(f".{ending}")).alias("name"), F.col(name).alias("text")), f"{path}/{n}-{name}")


def convertible(jobs: DataFrame) -> DataFrame:
    """jobs(input, output) with the reason why one can't be converted, else null: a PDF goes to a .tex file."""
    reason = F.when(~F.lower("input").endswith(".pdf"), "input").when(~F.lower("output").endswith(".tex"), "output")
    return jobs.withColumn("reason", reason)


def join_pages(pages: DataFrame) -> DataFrame:
    """doc_id, mmd: pages joined by blank lines."""
    kept = F.array_sort(F.collect_list(F.struct("page_no", "mmd")))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(kept, lambda x: x["mmd"]), "\n\n").alias("mmd"))


def resolve_fonts(glyphs: DataFrame, fonts: DataFrame) -> DataFrame:
    """font, ps_name of the fonts in use; the id itself where no name is known."""
    return glyphs.select("font").distinct().join(fonts, "font", "left").select("font", F.coalesce("ps_name", "font").alias("ps_name"))


def segments_json(segments: DataFrame) -> DataFrame:
    """doc_id, json: a document's segments in order."""
    kept = F.array_sort(F.collect_list(F.struct("index", "text", "source_text", "segment_type")))
    fields = F.transform(kept, lambda x: F.struct(x["text"].alias("text"), x["source_text"].alias("source_text"), x["segment_type"].alias("segment_type"), x["index"].alias("index")))
    return segments.groupBy("doc_id").agg(F.to_json(fields).alias("json"))


def web_vtt(events: DataFrame) -> DataFrame:
    """doc_id, vtt of events(doc_id, pos, offset_ticks, duration_ticks, text). A document's cues are held by one task."""
    start, end = vtt_time(F.col("offset_ticks")), vtt_time(F.col("offset_ticks") + F.col("duration_ticks"))
    kept = F.array_sort(F.collect_list(F.struct("pos", start.alias("a"), end.alias("b"), "text")))
    cues = F.transform(kept, lambda x, i: F.concat((i + 1).cast("string"), F.lit("\n"), x["a"], F.lit(" --> "), x["b"], F.lit("\n"), x["text"], F.lit("\n")))
    return events.groupBy("doc_id").agg(F.concat(F.lit("WEBVTT\n\n"), F.array_join(cues, "\n"), F.lit("\n")).alias("vtt"))


def sync_map(words: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, json: words in order and segment spans by index."""
    w = words.select("doc_id", F.struct("pos", F.col("start_ms").alias("start_time_ms"), F.col("end_ms").alias("end_time_ms"), "text", "segment_index").alias("w"))
    w = w.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list("w")), lambda x: x.dropFields("pos")).alias("words"))
    s = spans.select("doc_id", F.struct("segment_index", F.col("start_ms").alias("start_time_ms"), F.col("end_ms").alias("end_time_ms")).alias("s"))
    s = s.groupBy("doc_id").agg(F.array_sort(F.collect_list("s")).alias("segments"))
    return w.join(s, "doc_id").select("doc_id", F.to_json(F.struct("words", "segments")).alias("json"))


def limited(c: Column, most: int) -> Column:
    return F.substring(F.coalesce(c, F.lit("")), 1, most)


def parse_feedback(raw: DataFrame, dialect: str = "web") -> DataFrame:
    """raw(value: JSON) with record and reason; reason is null where the record is accepted."""
    d = raw.withColumn("record", F.from_json("value", FEEDBACK))
    category, comment = F.col("record.category"), trimmed(F.coalesce("record.comment", F.lit("")))
    known = CATEGORIES_WEB if dialect == "web" else CATEGORIES_DESKTOP
    blank = (comment == "") & (~category.isin(NO_COMMENT_NEEDED) if dialect == "web" else F.lit(True))
    # from_json turns a cut-off record into one without fields, so whether it is JSON at all is asked apart
    broken = F.try_parse_json(F.col("value")).isNull() | F.col("record").isNull() | ~trimmed(F.col("value")).startswith("{")
    reason = F.when(broken, "json").when(category.isNull() | ~category.isin(known), "category").when(blank, "comment")
    return d.withColumn("reason", reason)


def finite(c: Column) -> Column:
    """The number that a text is, blank or missing ones being 0; null if it is none, or not finite."""
    value = F.when(trimmed(F.coalesce(c, F.lit(""))) == "", F.lit(0.0)).otherwise(trimmed(c).try_cast("double"))
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value).cast("long")


def number(c: Column) -> Column:
    return F.coalesce(finite(c), F.lit(0).cast("long"))


def accepted(parsed: DataFrame, dialect: str = "web") -> DataFrame:
    """The stored form of accepted records: cut to their limits, with timestamp (received, if there) and what the dialect keeps.

    parsed may have the columns received (timestamp), job_id (desktop) and ip_country (web).
    """
    r, have = "record.", parsed.columns
    received = F.to_utc_timestamp(F.col("received") if "received" in have else F.current_timestamp(), F.current_timezone())
    comment = F.substring(trimmed(F.coalesce(F.col(r + "comment"), F.lit(""))), 1, LIMITS["comment"]).alias("comment")
    common = [F.col(r + "category").alias("category"), comment]
    if dialect == "desktop":
        stamp = F.date_format(received, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
        return parsed.filter("reason IS NULL").select(
            stamp.alias("timestamp"), (F.col("job_id") if "job_id" in have else F.lit(None).cast("string")).alias("job_id"), *common,
            *[limited(F.col(f"{r}context.{c}"), LIMITS[c]).alias(c) for c in ("word", "segment_text")], F.col(r + "context.time_ms").alias("time_ms"), F.col(r + "context.page").alias("page"),
        )
    pages = F.slice(F.coalesce(F.col(r + "lint.bad_pages"), F.array().cast("array<string>")), 1, BAD_PAGES)
    fine = F.filter(F.transform(pages, finite), lambda x: x.isNotNull())
    lint = F.struct(number(F.col(r + "lint.unknown_commands")).alias("unknown_commands"), number(F.col(r + "lint.total_commands")).alias("total_commands"), fine.alias("bad_pages"))
    return parsed.filter("reason IS NULL").select(
        F.date_format(received, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"), *common, limited(F.col(r + "file_name"), LIMITS["file_name"]).alias("file_name"),
        number(F.col(r + "segment_count")).alias("segment_count"), F.when(F.col(r + "lint").isNotNull(), lint).alias("lint"),
        limited(F.col(r + "user_agent"), LIMITS["user_agent"]).alias("user_agent"), (F.coalesce("ip_country", F.lit("")) if "ip_country" in have else F.lit("")).alias("ip_country"),
    )


def append_feedback(records: DataFrame, path: str) -> None:
    """Stored records as JSON lines behind those that path has."""
    records.write.mode("append").option("ignoreNullFields", "false").json(path)


def feedback_key(timestamp: Column, unique: Column) -> Column:
    """``ts:<timestamp>:`` and 6 digits of base 36, the same whenever a task is run again; timestamp is the stored form."""
    digits = F.lower(F.lpad(F.conv(F.pmod(F.xxhash64(timestamp, unique), F.lit(36**6)).cast("string"), 10, 36), 6, "0"))
    return F.concat(F.lit("ts:"), timestamp, F.lit(":"), digits)


def export(stored: DataFrame) -> DataFrame:
    """value: the records of the first EXPORT_ROWS keys of stored(key, value), in order, without null ones. The limit is the feature."""
    return stored.orderBy("key").limit(EXPORT_ROWS).filter("value IS NOT NULL").select("key", "value")


def json_lines(exported: DataFrame) -> DataFrame:
    """body: what export() gave as one text, a line each. At most EXPORT_ROWS records."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("key", "value"))), lambda x: x["value"])
    return exported.agg(F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("body"))


def _encoded(c: Column, dialect: str) -> Column:
    """Percent-encoding; the web dialect leaves ! ' ( ) * and writes spaces as %20, the desktop dialect as +."""
    out = F.url_encode(c)
    if dialect == "desktop":
        return out
    for code, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


# The desktop dialect's names of the categories.
CATEGORY_TITLES = {"missed-latex": "Missed LaTeX command", "pronunciation": "Incorrect pronunciation", "other": "Beta feedback"}


def issue_url(repository: str, category: Column, comment: Column, file_name: Column, segment_count: Column, lint: Column, user_agent: Column) -> Column:
    """A new issue with title and body filled in, in the web dialect's layout."""
    body = F.concat(
        F.lit("**Category:** "), category, F.lit("\n**File:** "), F.when(F.coalesce(file_name, F.lit("")) != "", file_name).otherwise("(unknown)"), F.lit("\n\n"), comment, F.lit("\n\n---\n_segments: "),
        F.coalesce(segment_count, F.lit(0)).cast("string"), F.coalesce(lint, F.lit("")), F.lit(" · "), F.coalesce(user_agent, F.lit("")), F.lit("_"),
    )
    title = F.concat(F.lit("[beta] "), category, F.lit(": "), F.substring(comment, 1, TITLE_LENGTH))
    return F.concat(F.lit(f"{repository}/issues/new?labels=beta-feedback&title="), _encoded(title, "web"), F.lit("&body="), _encoded(body, "web"))


def lint_note(unknown: Column, total: Column, bad_pages: Column) -> Column:
    """What an issue says of a document's lint."""
    pages = F.when(F.size(bad_pages) > 0, F.concat(F.lit(" (pages "), F.array_join(bad_pages.cast("array<string>"), ", "), F.lit(")"))).otherwise("")
    return F.concat(F.lit(" · lint: "), unknown.cast("string"), F.lit("/"), total.cast("string"), F.lit(" unknown"), pages)


def issue_url_desktop(repository: str, category: Column, comment: Column, word: Column, page: Column, time_ms: Column, segment_text: Column) -> Column:
    """A new issue in the desktop dialect's layout, with the place that was being read (the application goes unnamed)."""
    name = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in CATEGORY_TITLES.items() for x in kv]), category), category)
    comment = trimmed(F.coalesce(comment, F.lit("")))
    seconds = F.floor(time_ms / 1000)
    lines = F.concat_ws(
        "\n", F.concat(F.lit("**Category:** "), name), F.lit(""), F.lit("**What happened / what should it have said?**"), F.when(comment != "", comment).otherwise("_describe here_"), F.lit(""), F.lit("---"),
        F.lit("**Context (auto-captured by the reader)**"), F.when(word != "", F.concat(F.lit("- Word being read: `"), word, F.lit("`"))), F.when(page > 0, F.concat(F.lit("- Page: "), page.cast("string"))),
        F.when(time_ms.isNotNull(), F.concat(F.lit("- Playback time: "), F.floor(seconds / 60).cast("string"), F.lit(":"), F.lpad((seconds % 60).cast("string"), 2, "0"))),
        F.when(segment_text != "", F.concat(F.lit("- Passage:\n\n> "), F.substring(segment_text, 1, PASSAGE_LENGTH))),
    )
    title = F.concat(F.lit("["), name, F.lit("] "), F.when(comment != "", F.substring(comment, 1, TITLE_LENGTH)).otherwise("Beta feedback"))
    labels = F.when(category == "other", F.lit("beta-feedback")).otherwise(F.concat(F.lit("beta-feedback,"), category))
    return F.concat(F.lit(f"{repository}/issues/new?title="), _encoded(title, "desktop"), F.lit("&body="), _encoded(lines, "desktop"), F.lit("&labels="), _encoded(labels, "desktop"))


def recent(jobs: DataFrame, now: Column, hours: int = JOB_HOURS) -> DataFrame:
    """Jobs younger than some hours; the others are due for deletion."""
    return jobs.filter(F.col("modified") >= now - F.make_interval(hours=F.lit(hours)))


def due(jobs: DataFrame, now: Column, hours: int = JOB_HOURS) -> DataFrame:
    """The jobs whose files are to be deleted."""
    return jobs.filter(F.col("modified") < now - F.make_interval(hours=F.lit(hours)))


def admitted(codes: DataFrame, allowed: DataFrame) -> DataFrame:
    """codes(code) whose SHA-256, trimmed and in upper case, is in allowed(digest)."""
    return codes.withColumn("digest", F.sha2(F.upper(F.trim("code")), 256)).join(allowed.select("digest"), "digest", "left_semi").drop("digest")
