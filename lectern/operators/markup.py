"""Markup to segments: block parsing, footnotes, command lint."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.batches import map_rows
from lectern.functions.markdown import to_html
from lectern.functions.rewrite import collapse, compiled, prose_text, speak_math, speak_spans
from lectern.operators import ordered

BLOCKS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "section"}
DROPPED = {"img", "table"}
VOID = {"img", "br", "meta", "hr", "input", "link", "wbr", "area", "base", "col", "embed", "source", "track"}
#: Tags that end an open paragraph, or an open item.
ENDS_P = BLOCKS - {"li"} | {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "header", "hr", "main", "nav", "ol", "pre", "table", "ul"}
NOTATION = {"eq", "eqn"}
RUNNING_HEAD = 120
SEGMENT = "text string, source_text string, segment_type string"


class _Block:
    """A block element: its pieces of text are those from first to last of the document's."""

    def __init__(self, tag: str, first: int):
        self.tag, self.first, self.last = tag, first, None
        self.elements = self.emphasis = self.texts = self.blanks = 0


class _Blocks(HTMLParser):
    """Blocks in document order; a block within a block is part of both."""

    def __init__(self, speak: bool = False):
        super().__init__(convert_charrefs=True)
        self.found: list[_Block] = []
        self.open: list[tuple[str, _Block | None]] = []
        self.pieces: list[str] = []
        self.dropped, self.speak = 0, speak

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED:
            self.dropped += tag not in VOID
            return
        if self.dropped:
            return
        if self.open and ((self.open[-1][0] == "p" and tag in ENDS_P) or self.open[-1][0] == tag == "li"):
            self.handle_endtag(self.open[-1][0])
        if self.open and (parent := self.open[-1][1]) is not None:
            parent.elements += 1
            parent.emphasis += tag == "em"
        if tag not in VOID:
            block = _Block(tag, len(self.pieces)) if tag in BLOCKS else None
            if block is not None:
                self.found.append(block)
            self.open.append((tag, block))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in DROPPED:
            self.dropped = max(0, self.dropped - (tag not in VOID))
        elif not self.dropped and any(t == tag for t, _ in self.open):
            while True:
                t, block = self.open.pop()
                if block is not None:
                    block.last = len(self.pieces)
                if t == tag:
                    break

    def handle_comment(self, data):
        if not self.dropped and self.open and self.open[-1][1] is not None:
            self.open[-1][1].elements += 1

    def handle_data(self, data):
        if self.dropped or not data:
            return
        if self.speak and self.open and self.open[-1][0] in NOTATION:
            data = speak_math(data, "desktop")
        self.pieces.append(data)
        if self.open and (block := self.open[-1][1]) is not None:
            blank = not data.strip()
            block.texts += not blank
            block.blanks += blank


def _parsed(html: str, dialect: str) -> Iterator[tuple[str, str, bool]]:
    """(tag, raw text, whether its only child is emphasis) of every block, in order.

    The web dialect takes all text and passes over blank siblings; the desktop dialect joins trimmed pieces by spaces.
    """
    parser = _Blocks(dialect == "desktop")
    parser.feed(html)
    parser.close()
    for b in parser.found:
        pieces = parser.pieces[b.first : b.last]
        raw = "".join(pieces) if dialect == "web" else " ".join(p for p in map(str.strip, pieces) if p)
        alone = b.elements == b.emphasis == 1 and not b.texts and (dialect == "web" or not b.blanks)
        yield b.tag, raw, alone


def blocks(html: str, dialect: str = "web") -> list[tuple[str, str, bool]]:
    return list(_parsed(html, dialect))


def segments_of(html: str, dialect: str = "web") -> list[tuple[int, str, str, str]]:
    """(place, text, source_text, segment_type) of a page's blocks.

    Running heads and unspeakable blocks go, looping sentences too (web); text is rewritten for speech.
    """
    out, web = [], dialect == "web"
    for i, (tag, raw, alone) in enumerate(_parsed(html, dialect)):
        if tag == "p" and alone and len(raw.strip(ordered.BLANKS)) <= RUNNING_HEAD:
            continue
        source = ordered.crop_repeats(collapse(raw)) if web else raw
        text = collapse(prose_text(source, dialect), dialect)
        if source and text and (not web or re.search("[a-zA-Z0-9]", text)):
            out.append((i, text, source, "heading" if tag.startswith("h") else "paragraph"))
    return out


def spoken_html(mmd: str, dialect: str = "web") -> str:
    """Cleaned markup as HTML; notation is spoken before (web), or where the renderer finds it (desktop)."""
    return to_html(speak_spans(mmd) if dialect == "web" else mmd, dialect)


def explode_segments(docs: DataFrame, html: str = "html", markdown: bool = False, dialect: str = "web") -> DataFrame:
    """doc_id, index, text, source_text, segment_type of docs(doc_id, html): one pass in Python for each document."""

    def parse(doc_id, text):
        text = text or ""
        return [(doc_id, *s) for s in segments_of(spoken_html(text, dialect) if markdown else text, dialect)]

    return map_rows(docs.select(F.col("doc_id").cast("long"), html), parse, [("doc_id", pa.int64(), "long"), ("index", pa.int32(), "int"), *((c, pa.string(), "string") for c in ("text", "source_text", "segment_type"))])


def clean_segments(segments: DataFrame, dialect: str = "web") -> DataFrame:
    """The filters in their order, then a new index."""
    d = ordered.drop_repeated_segments(segments) if dialect == "web" else segments
    d = ordered.drop_metadata(ordered.drop_author_lines(d))
    return ordered.reindex(ordered.drop_bibliography(relocate_footnotes(d)))


def preprocessed(c: Column) -> Column:
    """Display formulas on lines of their own, no table environments, no repeated lines."""
    return F.array_join(ordered.kept_lines(ordered.drop_tables(ordered.isolate_display(c))), "\n")


def process_markup(docs: DataFrame, dialect: str = "web") -> DataFrame:
    """docs(doc_id, mmd) to clean segments."""
    return clean_segments(explode_segments(docs.select("doc_id", preprocessed(F.col("mmd")).alias("mmd")), "mmd", True, dialect), dialect)


def stages(docs: DataFrame) -> DataFrame:
    """doc_id and what each step makes of docs(doc_id, mmd): preprocessed, spoken, rendered, segments (JSON), final."""

    def early(doc_id, text):
        spoken = speak_spans(text)
        return [(doc_id, text, spoken, to_html(spoken))]

    first = docs.select(F.col("doc_id").cast("long").alias("doc_id"), preprocessed(F.coalesce("mmd", F.lit(""))).alias("preprocessed"))
    first = map_rows(first, early, [("doc_id", pa.int64(), "long"), *((c, pa.string(), "string") for c in ("preprocessed", "spoken", "rendered"))])
    rows = F.array_sort(F.collect_list(F.struct("index", "text", "source_text", "segment_type")))
    last = process_markup(docs).groupBy("doc_id").agg(rows.alias("s"))
    last = last.select("doc_id", F.to_json(F.transform("s", lambda x: F.struct(x["text"].alias("text"), x["source_text"].alias("source_text"), x["segment_type"].alias("segment_type"), x["index"].alias("index")))).alias("segments"), F.array_join(F.transform("s", lambda x: x["text"]), "\n\n").alias("final"))
    return first.join(last, "doc_id", "left").na.fill({"segments": "[]", "final": ""})


# What opens a footnote; how the text refers to one by number.
FOOTNOTE = r"^(?:footnote\s*(\d{1,3}|[*†‡§¶])?\s*[.:]\s+|([†‡§¶])\s*[.:]?\s*)"
MENTION, GLUED = r"\bfootnote\s+{}\b", r"(?<![0-9])[a-zA-Z.,)\]”\"']{}(?=[\s.,;:!?)\]]|$)"


def footnote(text: str) -> tuple[str, str] | None:
    """(marker, body) if the text is a footnote; the marker may be empty."""
    m = compiled(f"(?i){FOOTNOTE}").match(text)
    return (m[1] or m[2] or "", text[m.end() :].strip(ordered.BLANKS)) if m else None


def has_reference(text: str, marker: str) -> bool:
    if marker in ("", "*"):
        return False
    if not re.fullmatch("[0-9]+", marker):
        return marker in text
    glued = GLUED.format(marker).replace("|$)", "|\\Z)")
    return marker in text and bool(compiled("(?i)" + MENTION.format(marker)).search(text) or compiled(glued).search(text))


def relocated(rows: list[tuple]) -> list[tuple]:
    """(text, source_text, type) in order, footnotes moved behind the segment that refers to them.

    Notes go back to front, at places taken before any insertion, as the reading order is defined.
    """
    notes, rest = [], []
    for text, source, kind in rows:
        found = footnote(text) if kind == "paragraph" else None
        if found is None:
            rest.append((text, source, kind))
        elif found[1]:
            notes.append((len(rest), *found, source))
    for place, marker, body, source in reversed(notes):
        cited = next((i for i in range(place - 1, -1, -1) if has_reference(rest[i][0], marker)), None)
        if cited is not None:
            at = cited + 1
        else:
            at = next((i for i in range(place, len(rest)) if rest[i][2] == "heading"), len(rest))
        label = f" {marker}" if marker not in ("", "*") else ""
        rest.insert(at, (f"Footnote{label}: {body} End of footnote.", source, "footnote"))
    return rest


def relocate_footnotes(segments: DataFrame) -> DataFrame:
    """Exact relocation, with a new index. Documents without a footnote don't leave the JVM; the input is read once."""

    @F.pandas_udf(f"array<struct<{SEGMENT.replace(' string', ':string')}>>")
    def moved(s: pd.Series) -> pd.Series:
        return s.map(lambda rows: None if rows is None else [dict(zip(("text", "source_text", "segment_type"), r, strict=True)) for r in relocated([(x["text"], x["source_text"], x["segment_type"]) for x in rows])])

    noted = (F.col("segment_type") == "paragraph") & F.col("text").rlike(ordered.any_case(FOOTNOTE))
    row = F.struct("index", "text", "source_text", "segment_type")
    whole = segments.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.max(noted).alias("noted"))
    plain = F.transform("rows", lambda x: F.struct(x["text"].alias("text"), x["source_text"].alias("source_text"), x["segment_type"].alias("segment_type")))
    whole = whole.select("doc_id", plain.alias("rows"), moved(F.when(F.col("noted"), plain)).alias("moved"))
    return whole.select("doc_id", F.posexplode(F.coalesce("moved", "rows")).alias("index", "s")).select("doc_id", "index", "s.*")


def commands(pages: DataFrame, text: str = "mmd") -> DataFrame:
    """doc_id, page_no, hit, command, at (from 0): every backslash and two letters or more."""
    parts = F.split(F.col(text), r"\\(?=[A-Za-z]{2})", -1)
    d = pages.select("doc_id", "page_no", F.col(text).alias("_t"), F.posexplode(parts).alias("hit", "_p"), parts.alias("_all")).filter("hit > 0")
    before = F.aggregate(F.slice("_all", 1, F.col("hit")), F.lit(0), lambda s, x: s + F.length(x) + 1)
    return d.select("doc_id", "page_no", "hit", F.regexp_extract("_p", "^([A-Za-z]+)", 1).alias("command"), (before - 1).alias("at"), "_t")


def unknown_commands(pages: DataFrame, vocabulary: DataFrame, text: str = "mmd", around: int = 40) -> DataFrame:
    """The commands outside vocabulary(name), with their surroundings."""
    known = vocabulary.select(F.col("name").alias("command")).distinct()
    d = commands(pages, text).join(known, "command", "left_anti")
    start = F.greatest(F.col("at") - around, F.lit(0))
    context = F.substring(F.col("_t"), start + 1, F.col("at") + F.length("command") + 1 + around - start)
    return d.select("doc_id", "page_no", "hit", "command", "at", context.alias("context"))


def lint(pages: DataFrame, vocabulary: DataFrame, text: str = "mmd") -> DataFrame:
    """doc_id, page_no, total, unknown, bad_ratio, bad of every page."""
    known = vocabulary.select(F.col("name").alias("command"), F.lit(1).alias("_k")).distinct()
    hits = commands(pages, text).select("doc_id", "page_no", "command").join(known, "command", "left")
    counted = hits.groupBy("doc_id", "page_no").agg(F.count("*").alias("total"), F.count_if(F.col("_k").isNull()).alias("unknown"))
    d = pages.select("doc_id", "page_no").join(counted, ["doc_id", "page_no"], "left").na.fill(0, ["total", "unknown"])
    d = d.withColumn("bad_ratio", F.coalesce(F.try_divide(F.col("unknown"), F.col("total")), F.lit(0.0)))
    return d.withColumn("bad", (F.col("unknown") >= 3) | ((F.col("total") >= 10) & (F.col("bad_ratio") > 0.05)))


def lint_report(pages: DataFrame, vocabulary: DataFrame, text: str = "mmd") -> DataFrame:
    """doc_id, page_no, report (text), json, failed: every page's unknown commands, as a report of lines and as JSON."""
    hit = F.struct("hit", F.concat(F.lit("\\"), "command").alias("command"), F.col("at").alias("index"), "context")
    found = unknown_commands(pages, vocabulary, text).groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(hit)).alias("unknown"))
    total = lint(pages, vocabulary, text).select("doc_id", "page_no", "total", "bad_ratio").join(found, ["doc_id", "page_no"], "left")
    line = lambda x: F.concat(F.lit("@"), x["index"].cast("string"), F.lit("  "), x["command"], F.lit("\n    …"), F.replace(x["context"], F.lit("\n"), F.lit(" ")), F.lit("…\n"))
    count = F.size(F.coalesce("unknown", F.array().cast(found.schema["unknown"].dataType)))
    summary = F.format_string("\n%d unknown of %d control sequences (%.1f%% bad)", count, F.col("total"), F.col("bad_ratio") * 100)
    unknown = F.transform(F.coalesce("unknown", F.array().cast(found.schema["unknown"].dataType)), lambda x: F.struct(x["command"].alias("command"), x["index"].alias("index"), x["context"].alias("context")))
    as_json = F.to_json(F.struct(F.col("total").alias("totalCommands"), unknown.alias("unknown")))
    report = F.concat(F.coalesce(F.array_join(F.transform("unknown", line), ""), F.lit("")), summary)
    return total.select("doc_id", "page_no", report.alias("report"), as_json.alias("json"), (count > 0).alias("failed"))


def lint_documents(pages: DataFrame) -> DataFrame:
    """lint() rolled up: unknown, total and the list of bad pages of each document."""
    bad = F.array_sort(F.collect_list(F.when(F.col("bad"), F.col("page_no"))))
    return pages.groupBy("doc_id").agg(F.sum("unknown").alias("unknown"), F.sum("total").alias("total"), bad.alias("bad_pages"))


def vocabulary_of(*lists: DataFrame) -> DataFrame:
    """name: the distinct non-blank trimmed names of all lists, sorted."""
    union = lists[0].select("name")
    for more in lists[1:]:
        union = union.unionByName(more.select("name"))
    name = ordered.trimmed(F.col("name"))
    return union.select(name.alias("name")).filter("name <> ''").distinct().orderBy("name")

