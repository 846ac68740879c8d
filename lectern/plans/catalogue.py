"""All queries of the library with their SQL counterparts.

The driver's tables hold no notation, citations, notes or timings, so most queries derive
their input from them, alike on both sides. The SQL states rules and expected forms on its
own (see statements), not from the engine's tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import rewrite
from lectern.operators import layout, markup, ordered, timing
from lectern.plans import statements
from lectern.sources import files
from lectern.sources.folders import shared_folder
from lectern.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chosen(number: str, values: list[str], n: str | None = None, k: str | None = None) -> Column:
    """The value for the remainder of a column, @n and @k replaced by those of others."""
    c = F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(number) % len(values) + 1).cast("int"))
    for mark, column in (("@n", n), ("@k", k)):
        c = F.replace(c, F.lit(mark), F.col(column).cast("string")) if column else c
    return c


# ---- ordered windows ----

LINES_SQL = "SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"


def sql_trim(column: str) -> str:
    return f"regexp_replace({column}, '^{statements.SPACE}+|{statements.SPACE}+$', '', 'g')"



@query(f"""
WITH l AS (SELECT *, {sql_trim('line')} AS b FROM ({LINES_SQL})),
p AS (SELECT *, lag(b) OVER (PARTITION BY doc_id ORDER BY pos) AS q FROM l)
SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY pos)) AS digest, count(*) AS kept FROM p WHERE b = '' OR q IS NULL OR b <> q GROUP BY doc_id
""")
def line_dedupe(spark, sf_dir):
    kept = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", ordered.kept_lines(F.col("text")).alias("l"))
    return kept.select("doc_id", F.md5(F.array_join("l", "\n")).alias("digest"), F.size("l").cast("long").alias("kept"))


KEY_SQL = "trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"


@query(rf"""
WITH s AS (
  SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS sentence FROM (
    SELECT doc_id, string_split(regexp_replace(text, '([.!?]){statements.SPACE}+', '\1' || chr(1), 'g'), chr(1)) AS l FROM documents)
), k AS (SELECT *, {KEY_SQL.format('sentence')} AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY pos) AS i, CASE WHEN k = '' THEN 0 ELSE len(string_split(k, ' ')) END AS w FROM k),
f AS (SELECT *, lag(k) OVER (PARTITION BY doc_id, k = '' ORDER BY pos) AS q FROM r WHERE n < 3 OR k = '' OR w < 4 OR i = 1),
kept AS (SELECT doc_id, count(*) AS kept, sum(length(sentence))::BIGINT AS chars FROM f WHERE n < 3 OR k = '' OR q IS NULL OR k <> q GROUP BY doc_id)
SELECT doc_id, n AS total, kept, chars FROM kept JOIN (SELECT DISTINCT doc_id, n FROM k) USING (doc_id)
""")
def sentence_dedupe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    d = docs.select("doc_id", F.size(F.split("text", f"(?<=[.!?])[{rewrite.SPACE}]+")).cast("long").alias("total"), ordered.sentences_column(F.col("text")).alias("s"))
    return d.select("doc_id", "total", F.size("s").cast("long").alias("kept"), F.aggregate("s", F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("chars"))


PREPARED = r"concat('x \\[a\\] y' || chr(10) || chr(10), text, chr(10) || '\\begin{table}p' || chr(10) || 'q\\end{table}z\\begin{table*}r\\end{table*}' || chr(10) || 'end' || chr(10) || ' end ')"


@query(rf"""
WITH d AS (SELECT doc_id, {PREPARED.replace(chr(92) * 2, chr(92))} AS t FROM documents),
e AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(\\\[.*?\\\])', chr(10) || chr(10) || '\1' || chr(10) || chr(10), 'g'), '(?s)\\begin\{{table\}}.*?\\end\{{table\}}', '', 'g') AS t FROM d),
l AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(t, chr(10)) AS l FROM e)),
b AS (SELECT *, {sql_trim('line')} AS b FROM l), p AS (SELECT *, lag(b) OVER (PARTITION BY doc_id ORDER BY pos) AS q FROM b)
SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY pos)) AS digest FROM p WHERE b = '' OR q IS NULL OR b <> q GROUP BY doc_id
""")
def preprocessed_markup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{PREPARED} AS t")
    return docs.select("doc_id", F.md5(markup.preprocessed(F.col("t"))).alias("digest"))


def conversation_segments(spark, sf_dir) -> DataFrame:
    """Conversations as segments: every fourth turn a heading, some of them sections with a meaning."""
    c = table(spark, sf_dir, "conversations").dropDuplicates(["conv_id", "turn"])
    title = F.when(F.col("conv_id") % 3 == 0, "References").when(F.col("conv_id") % 3 == 1, "Abstract").otherwise(F.concat(F.lit("Part "), F.col("turn").cast("string")))
    heading = F.col("turn") % 4 == 0
    text = F.when(heading & (F.col("turn") > 0), title).otherwise(F.coalesce("text", F.lit("")))
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("index"), text.alias("text"), text.alias("source_text"), F.when(heading, "heading").otherwise("paragraph").alias("segment_type"))


SEGMENTS_SQL = """c AS (SELECT conv_id AS doc_id, turn AS index, turn % 4 = 0 AS heading,
  CASE WHEN turn % 4 = 0 AND turn > 0 THEN CASE conv_id % 3 WHEN 0 THEN 'References' WHEN 1 THEN 'Abstract' ELSE 'Part ' || turn END ELSE coalesce(text, '') END AS text
  FROM (SELECT DISTINCT ON (conv_id, turn) * FROM conversations))"""


@query(f"""
WITH {SEGMENTS_SQL}, k AS (SELECT *, {KEY_SQL.format('text')} AS k FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY index) AS i, CASE WHEN k = '' THEN 0 ELSE len(string_split(k, ' ')) END AS w FROM k),
f AS (SELECT *, lag(k) OVER (PARTITION BY doc_id ORDER BY index) AS q FROM r WHERE i <= CASE WHEN w >= 10 THEN 1 WHEN w >= 4 THEN 2 ELSE 2147483647 END)
SELECT doc_id, index::INTEGER AS index, text FROM f WHERE k = '' OR q IS NULL OR k <> q
""")
def segment_dedupe(spark, sf_dir):
    return ordered.drop_repeated_segments(conversation_segments(spark, sf_dir)).select("doc_id", "index", "text")


@query(f"""
WITH {SEGMENTS_SQL}, t AS (SELECT *, min(CASE WHEN heading THEN index END) OVER (PARTITION BY doc_id) AS t FROM c),
e AS (SELECT *, min(CASE WHEN heading AND index > t AND regexp_matches(lower(text), 'abstract|introduction') THEN index END) OVER (PARTITION BY doc_id) AS e FROM t)
SELECT doc_id, index::INTEGER AS index, text FROM e
WHERE NOT coalesce(index > t AND index < e AND length({sql_trim('text')}) < 300 AND regexp_matches(text, '(?i),|[0-9]|@|university|institute|department|lab'), false)
""")
def author_lines(spark, sf_dir):
    return ordered.drop_author_lines(conversation_segments(spark, sf_dir)).select("doc_id", "index", "text")


@query(f"""
WITH {SEGMENTS_SQL}, s AS (
  SELECT *, last_value(CASE WHEN heading THEN regexp_matches(text, '(?i)^\\s*(?:references|bibliography)\\b') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY index ROWS UNBOUNDED PRECEDING) AS s FROM c)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY index) - 1)::INTEGER AS index, text FROM s WHERE NOT coalesce(s, false)
""".replace("\\\\", "\\"))
def bibliography(spark, sf_dir):
    return ordered.reindex(ordered.drop_bibliography(conversation_segments(spark, sf_dir))).select("doc_id", "index", "text")


@query(f"WITH {SEGMENTS_SQL} SELECT doc_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY index)) AS digest FROM c GROUP BY doc_id")
def plain_text(spark, sf_dir):
    return ordered.plain_text(conversation_segments(spark, sf_dir)).select("doc_id", F.md5("text").alias("digest"))


#: Every line of a document as a paragraph, with a clause that the metadata filters know.
NOTES = [
    "Keywords: @", "Key words and phrases; @", "@ Key words: one, two", "Index terms—@", "CCS Concepts: @", "2020 Mathematics Subject Classification. @", "MSC (2020): @", "msc tests @",
    "This work has been generously supported by @", "The first author's work is financed by @", "Gratefully supported by @", "Funded in part by @", "Funding: @", "E-mail addresses: @", "Date: @",
    "@ mathematics subject classification: 11 keywords. 2", "@ index terms - x", "@ Keywords. This project was funded by all", "Dated @", "the keywords: @", "@", "@ ccs concepts: y",
]
LINE_NOTES_SQL = f"""l AS ({LINES_SQL}), s AS (
  SELECT doc_id, pos, replace({statements.case_sql('(doc_id + pos)', NOTES)}, '@', {sql_trim('line')}) AS t FROM l WHERE {sql_trim('line')} <> ''
), p AS (SELECT doc_id, pos, {sql_trim('t')} AS text, 'see ' || {sql_trim('t')} AS source_text FROM s)"""
IS_METADATA = (
    "^key ?words?( and phrases)?~*[.:;—–-]", "^index terms~*[.:;—–-]", "^ccs concepts~*[.:;—–-]", r"^([0-9]{4}~+)?mathematics subject classifications?\b", r"^msc( ?\(?[0-9]{4}\)?)?~*[.:;]",
    r"^this (work|research|study|project|material) (is|are|was|were|has been|have been)\b.{0,40}\b(supported|funded|financed)\b",
    r"^the (first |second |third |corresponding )?authors?(''s work)? (is|are|was|were|has been|have been)\b.{0,40}\b(supported|funded|financed)\b",
    r"^(partially |gratefully )?(supported|funded) (in part )?by\b", "^funding~*[.:;]", "^e-?mail address(es)?~*[.:;]", "^date~*[.:]",
)
TAIL = "~(?:key~?words?(?: and phrases)?~*[.:;]|(?:[0-9]{4}~+)?mathematics subject classifications?~*[.:;]|index terms~*[—–.:;-]|ccs concepts~*[.:;])"


def metadata_sql(source: str, key: str) -> str:
    """source: a table p(key, text, source_text); the paragraphs that stay, cut."""
    def known(c):
        return f"(length({c}) < 600 AND (" + " OR ".join(f"regexp_matches({c}, '(?i){x.replace('~', statements.SPACE)}')" for x in IS_METADATA) + "))"

    def cut(c):
        return sql_trim(f"regexp_extract({c}, '(?is)^(.+?){tail}', 1)")

    tail = TAIL.replace("~", statements.SPACE)
    def has(c):
        return f"regexp_matches({c}, '(?is)^.+?{tail}')"

    return f"""k AS (SELECT *, {has('text')} AS cut, {has('source_text')} AS source_cut FROM {source} WHERE NOT {known('text')}),
c AS (SELECT {key}, CASE WHEN cut THEN {cut('text')} ELSE text END AS text, CASE WHEN cut AND source_cut THEN {cut('source_text')} ELSE source_text END AS source_text FROM k),
r AS (SELECT * FROM c WHERE text <> '' AND NOT {known('text')})"""


@query(f"WITH {LINE_NOTES_SQL}, {metadata_sql('p', 'doc_id, pos')} SELECT doc_id, pos::INTEGER AS index, text, source_text FROM r")
def metadata(spark, sf_dir):
    lines = ordered.explode_lines(table(spark, sf_dir, "documents")).withColumn("line", ordered.trimmed(F.col("line"))).filter("line <> ''")
    t = ordered.trimmed(F.replace(chosen("n", NOTES), F.lit("@"), F.col("line")))
    s = lines.withColumn("n", F.col("doc_id") + F.col("pos")).select("doc_id", F.col("pos").alias("index"), t.alias("text"), F.concat(F.lit("see "), t).alias("source_text"), F.lit("paragraph").alias("segment_type"))
    return ordered.drop_metadata(s).select("doc_id", "index", "text", "source_text")


METADATA_WHOLE = "CASE item_id % 5 WHEN 0 THEN 'Keywords: ' || text WHEN 1 THEN text || ' Key words: one, two' WHEN 2 THEN 'This work was supported by ' || text ELSE text END"


@query(f"WITH p AS (SELECT item_id AS doc_id, {METADATA_WHOLE} AS text, {METADATA_WHOLE} AS source_text FROM benchmark), {metadata_sql('p', 'doc_id')} SELECT doc_id, text FROM r")
def metadata_whole(spark, sf_dir):
    """The metadata filters over whole passages."""
    b = table(spark, sf_dir, "benchmark").selectExpr("item_id AS doc_id", f"{METADATA_WHOLE} AS text")
    s = b.select("doc_id", F.lit(0).alias("index"), "text", F.col("text").alias("source_text"), F.lit("paragraph").alias("segment_type"))
    return ordered.drop_metadata(s).select("doc_id", "text")


# ---- rewriting ----

def clause_sql(key: str) -> str:
    return statements.case_sql(key, [c for c, _ in statements.CLAUSES])


def claused(spark, sf_dir, name: str, key: str) -> DataFrame:
    t = F.concat(F.coalesce("text", F.lit("")), chosen(key, [c for c, _ in statements.CLAUSES]))
    return table(spark, sf_dir, name).select(key, t.alias("t"))


@query(f"SELECT doc_id, md5(s) AS digest, length(s) AS chars FROM (SELECT doc_id, {statements.prose_sql('t')} AS s FROM (SELECT doc_id, coalesce(text, '') || {clause_sql('doc_id')} AS t FROM documents))")
def prose_rules(spark, sf_dir):
    d = claused(spark, sf_dir, "documents", "doc_id").select("doc_id", rewrite.prose(F.col("t")).alias("s"))
    return d.select("doc_id", F.md5("s").alias("digest"), F.length("s").cast("long").alias("chars"))


@query(f"SELECT item_id, {statements.prose_sql('t')} AS spoken FROM (SELECT item_id, coalesce(text, '') || {clause_sql('item_id')} AS t FROM benchmark)")
def prose_rules_whole(spark, sf_dir):
    """The prose rules over whole passages."""
    return claused(spark, sf_dir, "benchmark", "item_id").select("item_id", rewrite.prose(F.col("t")).alias("spoken"))


@query(f"SELECT p_partkey, 'Part' || {statements.case_sql('p_partkey', [e for _, e in statements.CLAUSES_DESKTOP])} AS spoken FROM part")
def prose_rules_desktop(spark, sf_dir):
    t = F.concat(F.lit("Part"), chosen("p_partkey", [c for c, _ in statements.CLAUSES_DESKTOP]))
    return table(spark, sf_dir, "part").select("p_partkey", rewrite.prose(t, "desktop").alias("spoken"))


def _spoken_sql(pairs) -> str:
    return f"SELECT p_partkey, {statements.choice('p_partkey', statements.filled([e for _, e in pairs], 'p_size', 'p_partkey'))} AS spoken FROM part"


def _notation(spark, sf_dir, pairs) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", chosen("p_partkey", [x for x, _ in pairs], "p_size", "p_partkey").alias("t"))


@query(_spoken_sql(statements.NOTATION))
def math_rules(spark, sf_dir):
    return _notation(spark, sf_dir, statements.NOTATION).select("p_partkey", rewrite.math_column(F.col("t")).alias("spoken"))


@query(_spoken_sql(statements.NOTATION_DESKTOP))
def math_rules_desktop(spark, sf_dir):
    return _notation(spark, sf_dir, statements.NOTATION_DESKTOP).select("p_partkey", rewrite.math_column(F.col("t"), "desktop").alias("spoken"))


@query(_spoken_sql(statements.SPANS))
def math_spans(spark, sf_dir):
    return _notation(spark, sf_dir, statements.SPANS).select("p_partkey", rewrite.spans_column(F.col("t")).alias("spoken"))


# ---- timing ----

TIMED = "SELECT user_id AS doc_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) AS pos, event_type AS text FROM events"
EVENTS_SQL = f"e AS (SELECT *, pos * 3500123 AS offset_ticks, 1234567 AS duration_ticks FROM ({TIMED}))"
PARTS_SQL = "g AS (SELECT DISTINCT user_id AS doc_id, unnest([0, 1, 2, 3]) AS index FROM events), s AS (SELECT doc_id, index, ((doc_id + index) % 4)::BIGINT AS words FROM g)"


def word_events(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    pos = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long")
    return e.select(F.col("user_id").alias("doc_id"), pos.alias("pos"), F.col("event_type").alias("text")).withColumn("offset_ticks", F.col("pos") * 3500123).withColumn("duration_ticks", F.lit(1234567))


def word_counts(spark, sf_dir) -> DataFrame:
    g = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id")).distinct().withColumn("index", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return g.withColumn("words", ((F.col("doc_id") + F.col("index")) % 4).cast("long"))


SYNC_SQL = f"""{EVENTS_SQL}, {PARTS_SQL}, b AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY doc_id ORDER BY index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM s),
w AS (SELECT e.doc_id, pos, offset_ticks // 10000 AS start_ms, (offset_ticks + duration_ticks) // 10000 AS end_ms, text, coalesce(index, 0)::INTEGER AS segment_index
  FROM e LEFT JOIN b ON e.doc_id = b.doc_id AND pos >= a AND pos < a + words)"""


def synced(spark, sf_dir) -> DataFrame:
    return timing.sync_words(word_events(spark, sf_dir), word_counts(spark, sf_dir))


@query(f"WITH {SYNC_SQL} SELECT * FROM w")
def sync_words(spark, sf_dir):
    return synced(spark, sf_dir)


@query(f"WITH {SYNC_SQL} SELECT doc_id, segment_index, arg_min(start_ms, pos) AS start_ms, arg_max(end_ms, pos) AS end_ms FROM w GROUP BY doc_id, segment_index")
def segment_spans(spark, sf_dir):
    return timing.segment_spans(synced(spark, sf_dir))


@query(f"WITH {EVENTS_SQL}, k AS (SELECT doc_id, pos AS tick, pos * 417 - 5 AS time_ms FROM e) SELECT k.doc_id, tick, time_ms, coalesce(e.pos, -1) AS pos FROM k ASOF LEFT JOIN (SELECT doc_id, pos, offset_ticks // 10000 AS t FROM e) e ON k.doc_id = e.doc_id AND k.time_ms >= e.t")
def active_word(spark, sf_dir):
    e = word_events(spark, sf_dir)
    ticks = e.select("doc_id", F.col("pos").alias("tick"), (F.col("pos") * 417 - 5).alias("time_ms"))
    return timing.active_at(ticks, e.select("doc_id", timing.to_ms(F.col("offset_ticks")).alias("start_ms"), "pos"), "pos")


VTT_SQL = "printf('%02d:%02d:%02d.%03d', {0} // 36000000000, {0} // 600000000 % 60, {0} // 10000000 % 60, {0} // 10000 % 1000)"


@query(f"WITH {EVENTS_SQL} SELECT doc_id, md5('WEBVTT' || chr(10) || chr(10) || string_agg((pos + 1) || chr(10) || {VTT_SQL.format('offset_ticks')} || ' --> ' || {VTT_SQL.format('(offset_ticks + duration_ticks)')} || chr(10) || text || chr(10), chr(10) ORDER BY pos) || chr(10)) AS digest FROM e GROUP BY doc_id")
def captions(spark, sf_dir):
    return files.web_vtt(word_events(spark, sf_dir)).select("doc_id", F.md5("vtt").alias("digest"))


WORD_JSON = """'{"start_time_ms":' || start_ms || ',"end_time_ms":' || end_ms || ',"text":"' || text || '","segment_index":' || segment_index || '}'"""
SPAN_JSON = """'{"segment_index":' || segment_index || ',"start_time_ms":' || start_ms || ',"end_time_ms":' || end_ms || '}'"""


@query(f"""WITH {SYNC_SQL}, p AS (SELECT doc_id, segment_index, arg_min(start_ms, pos) AS start_ms, arg_max(end_ms, pos) AS end_ms FROM w GROUP BY doc_id, segment_index),
wj AS (SELECT doc_id, string_agg({WORD_JSON}, ',' ORDER BY pos) AS words FROM w GROUP BY doc_id), sj AS (SELECT doc_id, string_agg({SPAN_JSON}, ',' ORDER BY segment_index) AS segments FROM p GROUP BY doc_id)
SELECT doc_id, '{{"words":[' || words || '],"segments":[' || segments || ']}}' AS json FROM wj JOIN sj USING (doc_id)""")
def sync_map(spark, sf_dir):
    w = synced(spark, sf_dir)
    return files.sync_map(w, timing.segment_spans(w))


@query(f"""WITH {SYNC_SQL}, p AS (SELECT doc_id, segment_index, arg_min(start_ms, pos) AS start_ms FROM w GROUP BY doc_id, segment_index), k AS (SELECT doc_id, pos AS tick, pos * 311 - 2 AS time_ms FROM e)
SELECT k.doc_id, tick, time_ms, coalesce(p.segment_index, -1) AS segment_index FROM k ASOF LEFT JOIN (SELECT doc_id, max(segment_index) AS segment_index, start_ms FROM p GROUP BY ALL) p ON k.doc_id = p.doc_id AND k.time_ms >= p.start_ms""")
def active_segment(spark, sf_dir):
    e = word_events(spark, sf_dir)
    ticks = e.select("doc_id", F.col("pos").alias("tick"), (F.col("pos") * 311 - 2).alias("time_ms"))
    return timing.active_at(ticks, timing.segment_spans(synced(spark, sf_dir)), "segment_index")


@query(f"""WITH {SYNC_SQL}, p AS (SELECT doc_id, segment_index, min(start_ms) AS start_ms FROM (SELECT doc_id, segment_index, arg_min(start_ms, pos) AS start_ms FROM w GROUP BY ALL) GROUP BY ALL), asked AS (SELECT DISTINCT doc_id, unnest([0, 1, 2, 3, 9])::INTEGER AS segment_index FROM w)
SELECT doc_id, segment_index, coalesce(start_ms, 0) AS start_ms FROM asked LEFT JOIN p USING (doc_id, segment_index)""")
def segment_start(spark, sf_dir):
    w = synced(spark, sf_dir)
    asked = w.select("doc_id").distinct().withColumn("segment_index", F.explode(F.array(*[F.lit(i) for i in (0, 1, 2, 3, 9)])))
    return timing.segment_starts(asked, timing.segment_spans(w))


@query(f"""WITH {SYNC_SQL}, q AS (SELECT doc_id, pos FROM w WHERE pos % 3 = 0 UNION ALL SELECT DISTINCT doc_id, -1 FROM w),
st AS (SELECT doc_id, index, 'segment ' || index AS segment_text FROM g)
SELECT q.doc_id, q.pos, w.text AS word, CASE WHEN w.pos IS NOT NULL THEN segment_text END AS segment_text, start_ms AS time_ms, CASE WHEN q.pos % 2 = 0 THEN q.pos // 100 END AS page
FROM q LEFT JOIN w USING (doc_id, pos) LEFT JOIN st ON st.doc_id = w.doc_id AND st.index = w.segment_index""")
def reading_context(spark, sf_dir):
    w = synced(spark, sf_dir)
    asked = w.filter("pos % 3 = 0").select("doc_id", "pos").unionByName(w.select("doc_id").distinct().withColumn("pos", F.lit(-1).cast("long")))
    segments = word_counts(spark, sf_dir).select("doc_id", "index", F.concat(F.lit("segment "), F.col("index").cast("string")).alias("source_text"))
    aligned = w.filter("pos % 2 = 0").select("doc_id", "pos", F.call_function("div", "pos", F.lit(100)).alias("page"))
    return timing.reading_context(asked, w, segments, aligned)


@query("""WITH p AS (SELECT s_nationkey AS doc_id, s_suppkey AS page, sum(100 + s_suppkey % 7) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS bottom, 100 + s_suppkey % 7 AS height FROM supplier),
m AS (SELECT DISTINCT doc_id, unnest(range(0, 500, 37)) AS time FROM p)
SELECT m.doc_id, m.time, p.page FROM m LEFT JOIN p ON m.doc_id = p.doc_id AND m.time >= bottom - height AND m.time < bottom""")
def scroll_page(spark, sf_dir):
    height = 100 + F.col("s_suppkey") % 7
    p = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("doc_id"), F.col("s_suppkey").alias("page"), height.alias("height"))
    p = p.withColumn("top", F.sum("height").over(Window.partitionBy("doc_id").orderBy("page")) - F.col("height"))
    m = p.select("doc_id").distinct().withColumn("time", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(499).cast("long"), F.lit(37).cast("long"))))
    return timing.page_at(m, p)


@query("""WITH r AS (SELECT p_partkey % 40 AS doc_id, p_partkey % 3 AS page, p_partkey AS item_no, string_split(p_name, ' ') AS l, length(p_name) AS n, 10.0 + p_size AS x, 700.0 - p_partkey % 600 AS y, 6.0 * length(p_name) AS width, (p_size % 5)::DOUBLE AS size FROM part),
u AS (SELECT *, unnest(range(len(l))) AS i, unnest(l) AS word FROM r), o AS (SELECT *, coalesce(sum(length(word) + 1) OVER (PARTITION BY item_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM u)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY page, item_no, i) - 1)::INTEGER AS pos, page, round((x + start * 6.0) / 600, 9)::DOUBLE AS x, round((800 - y - size) / 800, 9)::DOUBLE AS y, round(length(word) * 6.0 / 600, 9)::DOUBLE AS w, round(size / 800, 9)::DOUBLE AS h, word AS str FROM o WHERE size > 0""")
def word_boxes(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    runs = table(spark, sf_dir, "part").select(
        (k % 40).alias("doc_id"), (k % 3).alias("page"), k.alias("item_no"), F.col("p_name").alias("str"), (10.0 + size).alias("x"), (700.0 - k % 600).alias("y"), (6.0 * F.length("p_name")).alias("width"), (size % 5).cast("double").alias("size")
    )
    pages = runs.select("doc_id", "page").distinct().select("*", F.lit(600.0).alias("page_width"), F.lit(800.0).alias("page_height"))
    d = timing.word_boxes(runs, pages)
    return d.select("doc_id", "pos", "page", *[F.round(c, 9).alias(c) for c in "xywh"], "str")


@query("""WITH b AS (SELECT p_partkey AS pos, p_partkey % 100 / 100.0 AS x, p_partkey % 37 / 37.0 AS y, p_size / 500.0 AS w, (p_partkey % 3) / 100.0 AS h FROM part)
SELECT pos, round(x * 600 - 2, 6)::DOUBLE AS left, round(y * 800 - 2, 6)::DOUBLE AS top, round(w * 600 + 4, 6)::DOUBLE AS width, round(h * 800 + 4, 6)::DOUBLE AS height,
CASE WHEN y * 800 - 2 < 200 + 0.15 * 300 OR y * 800 - 2 > 200 + 0.7 * 300 THEN round(y * 800 - 2 - 0.35 * 300, 6)::DOUBLE END AS scroll FROM b WHERE h > 0""")
def word_display(spark, sf_dir):
    k = F.col("p_partkey")
    b = table(spark, sf_dir, "part").select(F.lit(0).alias("doc_id"), k.alias("pos"), F.lit(1).alias("page"), (k % 100 / 100.0).alias("x"), (k % 37 / 37.0).alias("y"), (F.col("p_size") / 500.0).alias("w"), (k % 3 / 100.0).alias("h"))
    d = timing.scaled(timing.real_boxes(b), 600, 800)
    d = d.withColumn("scroll", timing.scroll_to(F.col("top"), F.lit(200.0), F.lit(300.0)))
    return d.select("pos", *[F.round(c, 6).alias(c) for c in ("left", "top", "width", "height", "scroll")])


@query("""WITH v AS (SELECT n_nationkey AS pos, n_name || CASE WHEN n_nationkey % 6 = 0 THEN ' Natural' ELSE '' END AS name, CASE n_nationkey % 3 WHEN 0 THEN 'en-GB' WHEN 1 THEN 'EN' ELSE 'de' END AS lang, n_nationkey % 4 > 1 AS local FROM nation),
o AS (SELECT *, row_number() OVER (ORDER BY local DESC, pos) - 1 AS place FROM v WHERE lower(lang) LIKE 'en%')
SELECT place::INTEGER AS place, name, lang, local, place = coalesce((SELECT min(place) FROM o WHERE local AND name LIKE '%Natural'), 0) AS chosen FROM o""")
def voices(spark, sf_dir):
    k = F.col("n_nationkey")
    v = table(spark, sf_dir, "nation").select(
        k.alias("pos"), F.concat("n_name", F.when(k % 6 == 0, " Natural").otherwise("")).alias("name"), F.when(k % 3 == 0, "en-GB").when(k % 3 == 1, "EN").otherwise("de").alias("lang"), (k % 4 > 1).alias("local")
    )
    return timing.rank_voices(v)


@query(f"WITH {SEGMENTS_SQL}, w AS (SELECT doc_id, index, regexp_extract_all(text, '\\S+') AS l FROM c) SELECT doc_id, string_agg(c.text, '. ' ORDER BY index) AS text, sum(len(l))::BIGINT AS words FROM c JOIN w USING (doc_id, index) GROUP BY doc_id".replace("\\\\", "\\"))
def full_text(spark, sf_dir):
    return timing.full_text(conversation_segments(spark, sf_dir))


@query(f"WITH {SEGMENTS_SQL}, w AS (SELECT doc_id, index, unnest(range(len(l))) AS i, unnest(l) AS word FROM (SELECT doc_id, index, regexp_extract_all(text, '\\S+') AS l FROM c)) SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY index, i) - 1)::INTEGER AS pos, index::INTEGER AS segment_index, word FROM w".replace("\\\\", "\\"))
def spoken_words(spark, sf_dir):
    return timing.spoken_words(conversation_segments(spark, sf_dir))


BOXES_SQL = "b AS (SELECT 0 AS doc_id, p_partkey AS pos, p_partkey % 50 AS page, p_partkey * 37 % 1000 AS x, p_partkey * 91 % 1000 AS y, p_size AS w, 10 AS h FROM part), q AS (SELECT s_suppkey AS point_id, 0 AS doc_id, s_suppkey % 50 AS page, s_suppkey * 53 % 1000 AS px, s_suppkey * 29 % 1000 AS py FROM supplier)"


def _nearest(spark, sf_dir, metric):
    boxes = table(spark, sf_dir, "part").selectExpr("0 AS doc_id", "p_partkey AS pos", "p_partkey % 50 AS page", "p_partkey * 37 % 1000 AS x", "p_partkey * 91 % 1000 AS y", "p_size AS w", "10 AS h")
    points = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS point_id", "0 AS doc_id", "s_suppkey % 50 AS page", "s_suppkey * 53 % 1000 AS px", "s_suppkey * 29 % 1000 AS py")
    return timing.nearest_box(points, timing.real_boxes(boxes), metric).select("point_id", "box_pos")


@query(f"WITH {BOXES_SQL} SELECT point_id, arg_min(pos, [(x + w / 2.0 - px) ** 2 + (y + h / 2.0 - py) ** 2, pos]) AS box_pos FROM q LEFT JOIN b USING (doc_id, page) GROUP BY point_id")
def nearest_word(spark, sf_dir):
    return _nearest(spark, sf_dir, "web")


@query(f"WITH {BOXES_SQL} SELECT point_id, arg_min(pos, [4 * abs(y + h / 2.0 - py) + abs(x + w / 2.0 - px), pos]) AS box_pos FROM q LEFT JOIN b USING (doc_id, page) GROUP BY point_id")
def nearest_word_desktop(spark, sf_dir):
    return _nearest(spark, sf_dir, "desktop")


@query(f"WITH {SEGMENTS_SQL} SELECT doc_id, index::INTEGER AS index, greatest(index - 1, 0)::INTEGER AS previous, least(index + 1, count(*) OVER (PARTITION BY doc_id) - 1) AS next FROM c")
def neighbours(spark, sf_dir):
    s = conversation_segments(spark, sf_dir)
    return timing.neighbours(s.select("doc_id", "index"), s.groupBy("doc_id").count())


@query(f"WITH {EVENTS_SQL}, w AS (SELECT doc_id, pos, pos * 7 AS a, pos * 7 + 5 AS b FROM e) SELECT e.doc_id, e.pos AS tick, w.pos FROM e LEFT JOIN w ON e.doc_id = w.doc_id AND e.pos * 3 >= a AND e.pos * 3 < b")
def word_at_char(spark, sf_dir):
    e = word_events(spark, sf_dir)
    words = e.select("doc_id", "pos", (F.col("pos") * 7).alias("start"), (F.col("pos") * 7 + 5).alias("end"))
    return timing.word_at_char(e.select("doc_id", F.col("pos").alias("tick"), (F.col("pos") * 3).alias("char_at")), words).select("doc_id", "tick", "pos")


@query()
def speech_chunks(spark, sf_dir):
    return timing.explode_chunks(conversation_segments(spark, sf_dir))


@query()
def word_alignment(spark, sf_dir):
    """Conversation words against the same words with some printed otherwise."""
    words = timing.spoken_words(conversation_segments(spark, sf_dir))
    boxes = words.filter("pos % 7 <> 3").select("doc_id", "pos", F.when(F.col("pos") % 5 == 0, F.upper("word")).otherwise(F.col("word")).alias("str"))
    return timing.align_words(words.select("doc_id", "pos", F.col("word").alias("text")), boxes)


# ---- markup, lint, layout ----


@query()
def html_segments(spark, sf_dir):
    return markup.explode_segments(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "html"))


def marked(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("# Title\n\n"), F.col("text"), F.lit("\n\n## References\n\nx")).alias("mmd"))


@query()
def markup_segments(spark, sf_dir):
    return markup.process_markup(marked(spark, sf_dir))


@query()
def markup_segments_desktop(spark, sf_dir):
    return markup.process_markup(marked(spark, sf_dir), "desktop")


@query()
def stage_dump(spark, sf_dir):
    """What each step makes of a document, as digests."""
    d = markup.stages(marked(spark, sf_dir))
    return d.select("doc_id", *[F.md5(c).alias(c) for c in ("preprocessed", "spoken", "rendered", "segments", "final")])


@query()
def footnotes(spark, sf_dir):
    s = conversation_segments(spark, sf_dir)
    note = F.col("index") % 4 == 3
    text = F.when(note, F.concat(F.lit("Footnote 1: "), F.col("text"))).when(F.col("index") % 4 == 1, F.concat(F.lit("See this.1 "), F.col("text"))).otherwise(F.col("text"))
    return markup.relocate_footnotes(s.withColumn("text", text))


LINT_TEXT = r"""'\alpha + \foo' || p_size % 7 || ' \frac{1}{2} ' || CASE WHEN p_partkey % 3 = 0 THEN '\bar \baz \qux \alpha' ELSE 'plain' END"""
VOCABULARY = ["alpha", "frac", "bar"]


def lint_pages(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    text = LINT_TEXT.replace("\\", "\\\\")
    pages = table(spark, sf_dir, "part").selectExpr("p_partkey % 20 AS doc_id", "p_partkey AS page_no", f"{text} AS mmd")
    return pages, spark.createDataFrame([(x,) for x in VOCABULARY], "name string")


LINT_SQL = rf"""p AS (SELECT p_partkey % 20 AS doc_id, p_partkey AS page_no, {LINT_TEXT} AS mmd FROM part), h AS (SELECT doc_id, page_no, unnest(regexp_extract_all(mmd, '\\([A-Za-z]{{2,}})', 1)) AS command FROM p),
c AS (SELECT doc_id, page_no, count(*) AS total, count(*) FILTER (command NOT IN ('alpha', 'frac', 'bar')) AS unknown FROM h GROUP BY 1, 2)"""


@query(f"WITH {LINT_SQL} SELECT doc_id, page_no, total, unknown, unknown / total AS bad_ratio, unknown >= 3 OR (total >= 10 AND unknown / total > 0.05) AS bad FROM c")
def lint(spark, sf_dir):
    return markup.lint(*lint_pages(spark, sf_dir))


@query(f"WITH {LINT_SQL} SELECT doc_id, sum(unknown)::BIGINT AS unknown, sum(total)::BIGINT AS total, count(*) FILTER (unknown >= 3 OR (total >= 10 AND unknown / total > 0.05)) AS n_bad FROM c GROUP BY doc_id")
def lint_documents(spark, sf_dir):
    return markup.lint_documents(markup.lint(*lint_pages(spark, sf_dir))).select("doc_id", "unknown", "total", F.size("bad_pages").cast("long").alias("n_bad"))


@query(rf"""WITH p AS (SELECT p_partkey % 20 AS doc_id, p_partkey AS page_no, {LINT_TEXT} AS mmd FROM part),
h AS (SELECT doc_id, page_no, mmd, unnest(regexp_extract_all(mmd, '\\([A-Za-z]{{2,}})', 1)) AS command FROM p)
SELECT page_no, command, strpos(mmd, '\' || command) - 1 AS at, substr(mmd, greatest(strpos(mmd, '\' || command) - 40, 1), strpos(mmd, '\' || command) + length(command) + 41 - greatest(strpos(mmd, '\' || command) - 40, 1)) AS context FROM h WHERE command NOT IN ('alpha', 'frac', 'bar')""")
def unknown_commands(spark, sf_dir):
    return markup.unknown_commands(*lint_pages(spark, sf_dir)).select("page_no", "command", F.col("at").cast("long").alias("at"), "context")


@query(rf"""WITH p AS (SELECT p_partkey % 20 AS doc_id, p_partkey AS page_no, {LINT_TEXT} AS mmd FROM part), h AS (SELECT page_no, mmd, unnest(regexp_extract_all(mmd, '\\([A-Za-z]{{2,}})', 1)) AS command FROM p),
f AS (SELECT page_no, count(*) AS total, count(*) FILTER (command NOT IN ('alpha', 'frac', 'bar')) AS unknown,
  string_agg('@' || (strpos(mmd, '\' || command) - 1) || '  \' || command || chr(10) || '    …' || substr(mmd, greatest(strpos(mmd, '\' || command) - 40, 1), strpos(mmd, '\' || command) + length(command) + 41 - greatest(strpos(mmd, '\' || command) - 40, 1)) || '…' || chr(10), '' ORDER BY strpos(mmd, '\' || command)) FILTER (command NOT IN ('alpha', 'frac', 'bar')) AS lines FROM h GROUP BY page_no)
SELECT page_no, coalesce(lines, '') || chr(10) || unknown || ' unknown of ' || total || ' control sequences (' || printf('%.1f', 100.0 * unknown / total) || '% bad)' AS report, unknown > 0 AS failed FROM f""")
def lint_report(spark, sf_dir):
    return markup.lint_report(*lint_pages(spark, sf_dir)).select("page_no", "report", "failed")


@query("SELECT DISTINCT trim(name) AS name FROM (SELECT p_brand AS name FROM part UNION ALL SELECT ' ' || p_type || ' ' FROM part) WHERE trim(name) <> ''")
def vocabulary(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return markup.vocabulary_of(part.select(F.col("p_brand").alias("name")), part.select(F.concat(F.lit(" "), "p_type", F.lit(" ")).alias("name")))


def glyphs(spark, sf_dir) -> DataFrame:
    """Words of the documents laid out as lines of eight on pages of forty lines."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", r"\s+")).alias("n", "str"))
    n, size = F.col("n"), F.lit(10.0)
    line, word = F.floor(n / 8) % 40, n % 8
    place = F.array(size, F.lit(0.0), F.lit(0.0), size, 50 + word * 60.0, 700 - line * 12.0)
    return words.select("doc_id", (F.floor(n / 320) + 1).cast("int").alias("page_no"), n.alias("item_no"), "str", place.alias("transform"), (F.length("str") * 5.0).alias("width"), F.lit("f1").alias("font"))


@query()
def page_layout(spark, sf_dir):
    return layout.extract_pages(glyphs(spark, sf_dir))


@query()
def layout_documents(spark, sf_dir):
    """The pages of a document laid out and joined."""
    return files.join_pages(layout.extract_pages(glyphs(spark, sf_dir)))


@query("SELECT p_partkey AS page_no, CASE WHEN p_size % 7 > 0 AND p_size / 50.0 >= 0.6 THEN 'text layer' ELSE 'recognition' END AS route FROM part")
def page_route(spark, sf_dir):
    pages = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_no"), (F.col("p_size") % 7 > 0).alias("has_text"), (F.col("p_size") / 50.0).alias("confidence"))
    served, rest = layout.route(pages)
    return served.select("page_no", F.lit("text layer").alias("route")).unionByName(rest.select("page_no", F.lit("recognition").alias("route")))


@query("""SELECT p_partkey, greatest(0.0, 1 - least(0.7, 4.0 * (p_size % 5) / greatest(p_size * 3, 1)) - least(0.4, 30.0 * (p_size % 2) / greatest(p_size * 3, 1)) - least(0.3, 4.0 * (p_size % 3) / greatest(p_size * 3 + p_size % 3, 1)))::DOUBLE AS confidence FROM part""")
def page_confidence(spark, sf_dir):
    s = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", layout.confidence(s % 5, s % 2, s % 3, s * 3).alias("confidence"))


@query("SELECT DISTINCT event_type AS font, CASE WHEN event_type LIKE 'c%' THEN upper(event_type) ELSE event_type END AS ps_name FROM events")
def font_names(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("font"))
    return files.resolve_fonts(e, e.filter("font LIKE 'c%'").distinct().withColumn("ps_name", F.upper("font")))


# ---- jobs and files ----


@query("SELECT conv_id AS doc_id, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS mmd FROM (SELECT DISTINCT ON (conv_id, turn) * FROM conversations) GROUP BY conv_id")
def joined_pages(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").dropDuplicates(["conv_id", "turn"])
    return files.join_pages(c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), F.coalesce("text", F.lit("")).alias("mmd")))


@query("SELECT doc_id, md5(CASE WHEN doc_id % 3 = 2 AND trim(coalesce(text, '')) <> '' THEN text ELSE 'fallback of ' || doc_id END) AS digest FROM documents")
def fallback_text(spark, sf_dir):
    primary = F.when(F.col("doc_id") % 3 == 0, F.lit(None)).when(F.col("doc_id") % 3 == 1, " \n").otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(files.with_fallback(primary, F.concat(F.lit("fallback of "), F.col("doc_id").cast("string")))).alias("digest"))


@query("SELECT 'job' || c_custkey AS job_id, 'subs.vtt' AS name, CASE WHEN c_custkey % 4 > 0 THEN '/jobs/' || c_custkey END AS path, CASE WHEN c_custkey % 4 > 0 THEN 200 ELSE 404 END AS status FROM customer")
def job_lookup(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("job"), F.col("c_custkey").cast("string")).alias("job_id"), F.lit("subs.vtt").alias("name"), "c_custkey")
    held = c.filter("c_custkey % 4 > 0").select("job_id", "name", F.concat(F.lit("/jobs/"), F.col("c_custkey").cast("string")).alias("path"))
    return files.job_files(c.select("job_id", "name"), held)


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'input' WHEN p_partkey % 5 = 0 THEN 'output' END AS reason FROM part")
def conversion_requests(spark, sf_dir):
    k = F.col("p_partkey")
    jobs = table(spark, sf_dir, "part").select(k, F.concat(F.lit("a"), F.when(k % 3 == 0, ".txt").otherwise(".PDF")).alias("input"), F.concat(F.lit("b"), F.when(k % 5 == 0, ".md").otherwise(".tex")).alias("output"))
    return files.convertible(jobs).select("p_partkey", "reason")


@query("SELECT 'passage' || item_id AS name, md5(text || chr(10)) AS digest FROM benchmark")
def text_files(spark, sf_dir):
    """Texts written to files and read back whole."""
    folder = shared_folder(spark, "texts")
    files.write_texts(table(spark, sf_dir, "benchmark").select(F.concat(F.lit("passage"), F.col("item_id").cast("string"), F.lit(".mmd")).alias("name"), "text"), folder)
    found = files.read_markup(spark, f"{folder}/*")
    return found.select(F.regexp_extract("path", "name=([^/]+)/", 1).alias("name"), F.md5("mmd").alias("digest"))


@query("SELECT '' AS name, true AS registered WHERE false")
def pdf_jobs(spark, sf_dir):
    """The PDF files below the tables' folder: there are none."""
    return files.register_jobs(spark, sf_dir).select(F.col("job_id").alias("name"), (F.length("path") > 0).alias("registered"))


@query(f"WITH {SEGMENTS_SQL} SELECT doc_id, index::INTEGER AS index, md5(text) AS digest, CASE WHEN heading THEN 'heading' ELSE 'paragraph' END AS segment_type FROM c")
def segments_json(spark, sf_dir):
    """Segments as JSON, read back."""
    found = files.segments_json(conversation_segments(spark, sf_dir))
    rows = F.from_json("json", "array<struct<text:string,source_text:string,segment_type:string,index:int>>")
    return found.select("doc_id", F.explode(rows).alias("s")).select("doc_id", "s.index", F.md5("s.text").alias("digest"), "s.segment_type")


# ---- feedback ----

#: One record in eleven is cut off; the categories are those of both dialects and one that neither knows.
RECORD = """'{"category":"' || CASE event_id % 8 WHEN 0 THEN 'missed-latex' WHEN 1 THEN 'thumbs-up' WHEN 2 THEN 'nonsense' WHEN 3 THEN 'other' WHEN 4 THEN 'pronunciation' WHEN 5 THEN 'voice-quality' WHEN 6 THEN 'thumbs-down' ELSE 'bug' END
|| '","comment":"' || CASE WHEN event_id % 3 = 0 THEN ' ' ELSE '  ' || event_type || ' ' END || '","file_name":"' || repeat('f', CAST(event_id % 300 AS INT)) || '.pdf","segment_count":' || CASE WHEN event_id % 4 = 0 THEN '"x"' ELSE CAST(event_id AS STRING) END
|| ',"lint":' || CASE WHEN event_id % 5 = 0 THEN 'null' ELSE '{"unknown_commands":' || CAST(event_id % 9 AS STRING) || ',"total_commands":"' || CAST(event_id % 99 AS STRING) || '","bad_pages":[1,"2","y",' || CAST(event_id % 7 AS STRING) || ']}' END
|| ',"context":{"word":"' || event_type || '","segment_text":"s' || CAST(event_id AS STRING) || '","time_ms":' || CAST(event_id * 10 AS STRING) || ',"page":' || CASE WHEN event_id % 6 = 0 THEN 'null' ELSE CAST(event_id % 6 AS STRING) END || '},"user_agent":"agent"'
|| CASE WHEN event_id % 11 = 0 THEN '"' ELSE '}' END"""
WEB_CATEGORIES = "('missed-latex', 'pronunciation', 'voice-quality', 'other', 'thumbs-up', 'thumbs-down')"
READ_SQL = f"""r AS (SELECT event_id, ts, {RECORD} AS value FROM events), v AS (SELECT *, json_valid(value) AS fine, CASE WHEN json_valid(value) THEN value END AS j FROM r),
p AS (SELECT *, j->>'category' AS category, trim(coalesce(j->>'comment', '')) AS comment FROM v),
q AS (SELECT *, CASE WHEN NOT fine THEN 'json' WHEN category NOT IN {WEB_CATEGORIES} THEN 'category' WHEN comment = '' AND category NOT IN ('thumbs-up', 'thumbs-down') THEN 'comment' END AS reason FROM p),
d AS (SELECT *, CASE WHEN NOT fine THEN 'json' WHEN category NOT IN ('missed-latex', 'pronunciation', 'other') THEN 'category' WHEN comment = '' THEN 'comment' END AS reason_desktop FROM q)"""


#: The instant whose clock in UTC the table's time is.
RECEIVED = "from_utc_timestamp(CAST(ts AS TIMESTAMP), current_timezone()) AS received"


def records(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id", RECEIVED, f"{RECORD} AS value")


@query(f"WITH {READ_SQL} SELECT event_id, reason, reason_desktop FROM d")
def feedback_reasons(spark, sf_dir):
    web = files.parse_feedback(records(spark, sf_dir)).drop("record")
    return files.parse_feedback(web.withColumnRenamed("reason", "web"), "desktop").select("event_id", F.col("web").alias("reason"), F.col("reason").alias("reason_desktop"))


STORED_SQL = f"""WITH {READ_SQL} SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS timestamp, category, comment, substr(j->>'file_name', 1, 200) AS file_name, coalesce(try_cast(j->>'segment_count' AS BIGINT), 0) AS segment_count,
CASE WHEN j->>'lint' IS NOT NULL THEN event_id % 9 END AS unknown_commands, CASE WHEN j->>'lint' IS NOT NULL THEN event_id % 99 END AS total_commands, CASE WHEN j->>'lint' IS NOT NULL THEN '1,2,' || event_id % 7 END AS bad_pages, 'agent' AS user_agent
FROM d WHERE reason IS NULL"""


def _flat(stored: DataFrame) -> DataFrame:
    lint = [F.col("lint.unknown_commands").alias("unknown_commands"), F.col("lint.total_commands").alias("total_commands"), F.array_join(F.col("lint.bad_pages").cast("array<string>"), ",").alias("bad_pages")]
    return stored.select("timestamp", "category", "comment", "file_name", "segment_count", *lint, "user_agent")


@query(STORED_SQL)
def feedback_accepted(spark, sf_dir):
    return _flat(files.accepted(files.parse_feedback(records(spark, sf_dir))))


@query(f"""WITH {READ_SQL} SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS timestamp, 'job' || event_id % 5 AS job_id, category, comment, j->'context'->>'word' AS word, j->'context'->>'segment_text' AS segment_text,
(j->'context'->>'time_ms')::BIGINT AS time_ms, (j->'context'->>'page')::BIGINT AS page FROM d WHERE reason_desktop IS NULL""")
def feedback_accepted_desktop(spark, sf_dir):
    d = records(spark, sf_dir).withColumn("job_id", F.concat(F.lit("job"), (F.col("event_id") % 5).cast("string")))
    return files.accepted(files.parse_feedback(d, "desktop"), "desktop")


@query(f"SELECT *, 2 * count(*) AS copies FROM ({STORED_SQL}) GROUP BY ALL")
def feedback_log(spark, sf_dir):
    """Accepted records appended twice to one log of JSON lines, and read back."""
    folder = shared_folder(spark, "feedback")
    stored = files.accepted(files.parse_feedback(records(spark, sf_dir)))
    for _ in range(2):
        files.append_feedback(stored, folder)
    back = _flat(spark.read.schema(stored.schema).json(folder))
    return back.groupBy(*back.columns).agg(F.count("*").alias("copies"))


@query("SELECT 'ts:' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') || ':' AS key, event_id, '{\"event_id\":' || event_id || '}' AS value FROM (SELECT * FROM events ORDER BY ts, event_id LIMIT 1000) WHERE event_id % 10 > 0")
def feedback_export(spark, sf_dir):
    """The first keys by time, without empty records; the key's random digits are taken off again to compare."""
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    e = table(spark, sf_dir, "events").select("event_id", files.feedback_key(stamp, F.col("event_id")).alias("key"), F.when(F.col("event_id") % 10 > 0, F.to_json(F.struct("event_id"))).alias("value"))
    return files.export(e).select(F.regexp_replace("key", "[0-9a-z]{6}$", "").alias("key"), F.get_json_object("value", "$.event_id").cast("long").alias("event_id"), "value")


URL_SQL = "replace(replace(replace(url_encode({}), '%2A', '*'), '%28', '('), '%29', ')')"


@query(f"""WITH u AS (SELECT event_id, '[beta] other: ' || substr(event_type || ' & more', 1, 60) AS title,
'**Category:** other' || chr(10) || '**File:** (unknown)' || chr(10) || chr(10) || event_type || ' & more' || chr(10) || chr(10) || '---' || chr(10) || '_segments: ' || event_id || ' · lint: 1/2 unknown (pages 3, 4) · agent_' AS body FROM events)
SELECT event_id, 'https://example.org/issues/new?labels=beta-feedback&title=' || {URL_SQL.format('title')} || '&body=' || {URL_SQL.format('body')} AS url FROM u""")
def issue_urls(spark, sf_dir):
    note = files.lint_note(F.lit(1), F.lit(2), F.array(F.lit(3), F.lit(4)))
    url = files.issue_url("https://example.org", F.lit("other"), F.concat("event_type", F.lit(" & more")), F.lit(""), F.col("event_id"), note, F.lit("agent"))
    return table(spark, sf_dir, "events").select("event_id", url.alias("url"))


@query("SELECT event_id, ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOURS AS kept FROM events")
def retention(spark, sf_dir):
    """Jobs to keep and jobs to delete, as of the latest one (one row, broadcast)."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("modified"))
    e = e.crossJoin(F.broadcast(e.agg(F.max("modified").alias("now"))))
    kept, gone = files.recent(e, F.col("now")), files.due(e, F.col("now"))
    return kept.select("event_id", F.lit(True).alias("kept")).unionByName(gone.select("event_id", F.lit(False).alias("kept")))


@query("SELECT code FROM (SELECT ' ' || lower(c_mktsegment) || c_custkey || ' ' AS code, c_custkey FROM customer) WHERE c_custkey % 10 = 0")
def access_codes(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    allowed = c.filter("c_custkey % 10 = 0").select(F.sha2(F.upper(F.concat("c_mktsegment", F.col("c_custkey").cast("string"))), 256).alias("digest"))
    return files.admitted(c.select(F.concat(F.lit(" "), F.lower("c_mktsegment"), F.col("c_custkey").cast("string"), F.lit(" ")).alias("code")), allowed)


# ---- streams ----


def _drained(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """Runs a bounded stream to its end and returns what it wrote to files."""
    folder = shared_folder(spark, "stream")
    live.append_to(stream, folder, f"{folder}-checkpoint", once=True).awaitTermination()
    return spark.read.schema(stream.schema).parquet(folder)


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")


@query(STORED_SQL)
def feedback_stream(spark, sf_dir):
    raw = _event_stream(spark, sf_dir).selectExpr("event_id", RECEIVED, f"{RECORD} AS value")
    return _flat(_drained(live.feedback(raw), spark))


#: A window is written once the watermark has passed its end; the stream's last windows stay open and are not compared.
WINDOWS_SQL = """SELECT time_bucket(INTERVAL 250 MILLISECONDS, ts) AS start, user_id % 5 AS page, count(*) AS tokens, min(ts) AS first, max(ts) AS last FROM events
WHERE ts < time_bucket(INTERVAL 250 MILLISECONDS, (SELECT max(ts) FROM events)) GROUP BY ALL"""


def _progress(spark, sf_dir) -> DataFrame:
    # event time must be an instant; the table's times have no zone, nor has the result
    tokens = _event_stream(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 5).alias("page"))
    return _drained(live.progress(tokens, late="0 seconds"), spark)


@query(f"SELECT start, page, tokens FROM ({WINDOWS_SQL})")
def progress_stream(spark, sf_dir):
    return _progress(spark, sf_dir).select(F.col("start").cast("timestamp_ntz").alias("start"), "page", "tokens")


@query(f"""SELECT start, page, sum(tokens) OVER (PARTITION BY page ORDER BY start)::BIGINT AS tokens,
CASE WHEN last > min(first) OVER p THEN sum(tokens) OVER (PARTITION BY page ORDER BY start) * 1000000 / (epoch_us(last) - epoch_us(min(first) OVER p)) END AS tokens_per_second FROM ({WINDOWS_SQL}) WINDOW p AS (PARTITION BY page)""")
def running_progress(spark, sf_dir):
    return live.running(_progress(spark, sf_dir)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT user_id, event_id FROM events WHERE event_type <> 'click'")
def boundary_stream(spark, sf_dir):
    """A stream taken apart by kind: the word boundaries of it."""
    chunks = _event_stream(spark, sf_dir).select("user_id", "event_id", F.when(F.col("event_type") == "click", "audio").otherwise("boundary").alias("kind"))
    _, boundaries = live.demultiplex(chunks)
    return _drained(boundaries.select("user_id", "event_id"), spark)


@query("WITH l AS (SELECT user_id, arg_max(event_id, ts) AS loaded FROM (SELECT user_id, ts, max(event_id) AS event_id FROM events GROUP BY ALL) GROUP BY user_id) SELECT sum(loaded)::BIGINT AS loaded, sum(2 * loaded)::BIGINT AS total FROM l")
def download_progress(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id", "ts").agg(F.max("event_id").alias("loaded"))
    return live.downloads(e.select("ts", F.col("user_id").alias("file"), "loaded", (2 * F.col("loaded")).alias("total")))


@query("SELECT p_partkey, CASE WHEN p_size % 5 > 0 THEN 30.0 * (5 - p_size % 5) / (p_size % 5) END AS seconds, ((p_size % 5) + least(0.95, p_partkey % 3000 / 1024.0)) / 6 AS fraction FROM part")
def time_left(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.lit(30.0).alias("elapsed"), (F.col("p_size") % 5).alias("done"), F.lit(5).alias("total"), (F.col("p_partkey") % 3000).alias("tokens"))
    return p.select("p_partkey", live.remaining("elapsed", "done", "total").alias("seconds"), live.fraction(F.col("done"), F.lit(6), F.col("tokens"), F.lit(1024.0)).alias("fraction"))


PLAYED_SQL = """WITH w AS (SELECT doc_id, pos, pos * 4000 + 100 AS a, lead(pos * 4000 + 100) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM (SELECT DISTINCT user_id AS doc_id, unnest(range(20)) AS pos FROM events)),
t AS (SELECT user_id AS doc_id, ts, event_id, event_id * 37 % 100000 AS time_ms FROM events), p AS (SELECT t.doc_id, ts, time_ms, pos FROM t JOIN w ON t.doc_id = w.doc_id AND time_ms >= a AND (b IS NULL OR time_ms < b))"""


@query(f"{PLAYED_SQL}, c AS (SELECT *, lag(pos) OVER (PARTITION BY doc_id ORDER BY ts, time_ms) AS q FROM p) SELECT doc_id, ts, time_ms, pos FROM c WHERE q IS NULL OR q <> pos")
def playback_stream(spark, sf_dir):
    """The words at a stream of ticks, where they change."""
    docs = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id")).distinct()
    words = docs.withColumn("pos", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long")))).withColumn("start_ms", F.col("pos") * 4000 + 100)
    words = words.withColumn("next_ms", F.lead("start_ms").over(Window.partitionBy("doc_id").orderBy("pos")))
    ticks = _event_stream(spark, sf_dir).select(F.col("user_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") * 37 % 100000).alias("time_ms"))
    played = _drained(live.playback(ticks, words), spark)
    return live.changes(played).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_dedupe(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: re.sub(r"\n\s*", "\n", v.strip()) for k, v in SQL.items()}
