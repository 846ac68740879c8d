"""Order-sensitive filters: repeated lines, sentences and segments, front matter, bibliographies.

Segments are rows (doc_id, index, text, source_text, segment_type) with index the reading
order. Every filter partitions by document, so one document is the unit that a task holds.
Lines and sentences of a text are filtered within its row, without a shuffle.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.rewrite import SPACE, compiled, java

HEADING = "heading"
#: The characters of SPACE one by one.
BLANKS = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def trimmed(c: Column) -> Column:
    """Without white space at the ends, line ends included (trim() takes spaces only)."""
    return F.btrim(c, F.lit(BLANKS))


def collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"[{SPACE}]+", " "))


def isolate_display(c: Column) -> Column:
    """Blank lines around each one-line display formula."""
    return F.regexp_replace(c, java(r"(\\\[.*?\\\])"), "\n\n$1\n\n")


def drop_tables(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\begin\{table\}.*?\\end\{table\}", "")


def kept_lines(c: Column) -> Column:
    """The lines of a text without those equal, trimmed, to the one before; blank lines stay."""
    lines = F.transform(F.split(c, "\n", -1), lambda x: F.struct(x.alias("line"), trimmed(x).alias("bare")))
    # transform() with two arrays would need the array twice in the plan: it is bound by a one-element array
    bound = F.transform(F.array(lines), lambda a: F.filter(a, lambda x, i: (x["bare"] == "") | (i == 0) | (x["bare"] != F.get(a, i - 1)["bare"])))[0]
    return F.transform(bound, lambda x: x["line"])


def explode_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line"))


def drop_repeated_lines(lines: DataFrame) -> DataFrame:
    """lines(doc_id, pos, line) without lines equal, trimmed, to the one before; blank lines stay."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    bare = trimmed(F.col("line"))
    return lines.withColumn("_b", bare).withColumn("_p", F.lag("_b").over(order)).filter((F.col("_b") == "") | F.col("_p").isNull() | (F.col("_b") != F.col("_p"))).drop("_b", "_p")


def rejoin(rows: DataFrame, value: str, order: str, between: str, name: str = "text") -> DataFrame:
    """doc_id and the values of each document, joined in order."""
    kept = F.array_sort(F.collect_list(F.struct(order, value)))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(kept, lambda x: x[value]), between).alias(name))


def explode_sentences(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, pos, sentence: cut after . ! or ? and white space."""
    return docs.select("doc_id", F.posexplode(F.split(F.col(text), f"(?<=[.!?])[{SPACE}]+")).alias("pos", "sentence"))


def sentence_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9 ]", " "), " +", " "))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda x: x != ""))


def drop_repeated_sentences(sentences: DataFrame, block: list[str] | None = None) -> DataFrame:
    """sentences(doc_id, pos, sentence) that come as rows: what kept_sentences() drops goes.

    First the repeats of long keys go, then those equal to the key kept before; empty keys stay and are passed over.
    """
    block = block or ["doc_id"]
    one = Window.partitionBy(*block)
    d = sentences.withColumn("_n", F.count("*").over(one)).withColumn("_k", sentence_key(F.col("sentence")))
    d = d.withColumn("_i", F.row_number().over(Window.partitionBy(*block, "_k").orderBy("pos")))
    d = d.filter((F.col("_n") < 3) | (F.col("_k") == "") | (word_count(F.col("_k")) < 4) | (F.col("_i") == 1))
    d = d.withColumn("_p", F.last(F.when(F.col("_k") != "", F.col("_k")), ignorenulls=True).over(one.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)))
    return d.filter((F.col("_n") < 3) | (F.col("_k") == "") | F.col("_p").isNull() | (F.col("_k") != F.col("_p"))).drop("_n", "_k", "_i", "_p")


def kept_sentences(text: str) -> list[str]:
    """The sentences of a block without its repeats; under three, all of them.

    A sentence goes if its key equals the last kept one, or has four words and was seen. Empty keys stay and are passed over.
    """
    units = compiled(r"(?<=[.!?])\s+").split(text)
    if len(units) < 3:
        return units
    kept, seen, last = [], set(), None
    for unit in units:
        key = " ".join(compiled(r"[^a-z0-9 ]+").sub(" ", unit.lower()).split())
        if key and (key == last or (key in seen and key.count(" ") >= 3)):
            continue
        if key:
            seen.add(key)
            last = key
        kept.append(unit)
    return kept


def crop_repeats(text: str) -> str:
    """The text of a block, white space collapsed, without its repeated sentences; under three sentences it stays."""
    units = kept_sentences(text)
    return text if len(units) < 3 and len(compiled(r"(?<=[.!?])\s+").split(text)) < 3 else " ".join(units)


def sentences_column(c: Column) -> Column:
    """kept_sentences as a vectorised function; nulls stay null."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def kept(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else kept_sentences(x))

    return kept(c)


def drop_repeated_segments(segments: DataFrame) -> DataFrame:
    """Ten words or more: once in a document; four to nine: twice; any but those without words: not next to its like."""
    words = word_count(F.col("_k"))
    d = segments.repartition("doc_id").withColumn("_k", sentence_key(F.col("text")))  # one shuffle for this and all later windows
    d = d.withColumn("_i", F.row_number().over(Window.partitionBy("doc_id", "_k").orderBy("index")))
    d = d.filter(F.col("_i") <= F.when(words >= 10, 1).when(words >= 4, 2).otherwise(2**31 - 1))
    d = d.withColumn("_p", F.lag("_k").over(Window.partitionBy("doc_id").orderBy("index")))
    return d.filter((F.col("_k") == "") | F.col("_p").isNull() | (F.col("_k") != F.col("_p"))).drop("_k", "_i", "_p")


def reindex(segments: DataFrame) -> DataFrame:
    """index 0, 1, 2... in each document."""
    return segments.withColumn("index", F.row_number().over(Window.partitionBy("doc_id").orderBy("index")) - 1)


def drop_author_lines(segments: DataFrame) -> DataFrame:
    """Between the title (first heading) and the abstract or introduction: short segments that look like names or addresses go."""
    heading = F.col("segment_type") == HEADING
    one = Window.partitionBy("doc_id")
    d = segments.withColumn("_t", F.min(F.when(heading, F.col("index"))).over(one))
    start = heading & (F.col("index") > F.col("_t")) & F.lower("text").rlike("abstract|introduction")
    d = d.withColumn("_e", F.min(F.when(start, F.col("index"))).over(one))
    between = (F.col("index") > F.col("_t")) & (F.col("index") < F.col("_e"))
    author = (F.length(trimmed(F.col("text"))) < 300) & F.col("text").rlike("(?i),|[0-9]|@|university|institute|department|lab")
    return d.filter(~F.coalesce(between & author, F.lit(False))).drop("_t", "_e")


# Paragraphs that start like this are metadata; a clause that cuts a paragraph's tail.
METADATA = [
    r"^key\s?words?( and phrases)?\s*[.:;—–-]",
    r"^index terms\s*[.:;—–-]",
    r"^ccs concepts\s*[.:;—–-]",
    r"^(\d{4}\s+)?mathematics subject classifications?\b",
    r"^msc( ?\(?\d{4}\)?)?\s*[.:;]",
    r"^(this (work|research|study|project|material)|the (first |second |third |corresponding )?authors?('s work)?) (is|are|was|were|has been|have been)\b.{0,40}\b(supported|funded|financed)\b",
    r"^(partially |gratefully )?(supported|funded) (in part )?by\b",
    r"^funding\s*[.:;]",
    r"^e-?mail address(es)?\s*[.:;]",
    r"^date\s*[.:]",
]
METADATA_TAIL = r"\s(?:key\s?words?(?: and phrases)?\s*[.:;]|(?:\d{4}\s+)?mathematics subject classifications?\s*[.:;]|index terms\s*[—–.:;-]|ccs concepts\s*[.:;])"
LONGEST_METADATA = 600


def any_case(pattern: str) -> str:
    return "(?i)" + java(pattern)


def is_metadata(c: Column) -> Column:
    return (F.length(c) < LONGEST_METADATA) & c.rlike(any_case("|".join(f"(?:{p})" for p in METADATA)))


def tail_at(c: Column) -> Column:
    """Where a metadata clause starts, from 1; up to 1 if there is none or it is the beginning."""
    return F.regexp_instr(c, F.lit(any_case(METADATA_TAIL)))


def cut_before(c: Column, at: Column) -> Column:
    return trimmed(F.substring(c, F.lit(1), at - 1))


def drop_metadata(segments: DataFrame) -> DataFrame:
    """Metadata paragraphs go, metadata tails are cut: source_text at its own place, and only where text is cut."""
    paragraph = F.col("segment_type") == "paragraph"
    d = segments.filter(~(paragraph & is_metadata(F.col("text"))))
    text, source = tail_at(F.col("text")), tail_at(F.col("source_text"))
    d = d.withColumns({
        "text": F.when(paragraph & (text > 1), cut_before(F.col("text"), text)).otherwise(F.col("text")),
        "source_text": F.when(paragraph & (text > 1) & (source > 1), cut_before(F.col("source_text"), source)).otherwise(F.col("source_text")),
    })
    return d.filter(~(paragraph & (is_metadata(F.col("text")) | (F.col("text") == ""))))


def drop_bibliography(segments: DataFrame) -> DataFrame:
    """From a heading "References" or "Bibliography" to the next heading."""
    heading = F.col("segment_type") == HEADING
    order = Window.partitionBy("doc_id").orderBy("index").rowsBetween(Window.unboundedPreceding, 0)
    skipped = F.last(F.when(heading, trimmed(F.col("text")).rlike(any_case(r"^(references|bibliography)\b"))), ignorenulls=True).over(order)
    return segments.withColumn("_s", skipped).filter(~F.coalesce("_s", F.lit(False))).drop("_s")


def plain_text(segments: DataFrame) -> DataFrame:
    """doc_id, text: segments joined by blank lines."""
    return rejoin(segments, "text", "index", "\n\n")
