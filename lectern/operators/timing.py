"""Word timings: counts, spans, as-of and nearest lookups, chunks, alignment.

Lookups by time are done as a merge of the two sides in one window per document (a union
and the last value seen), so no range join multiplies rows.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.batches import map_rows
from lectern.functions.rewrite import compiled

TICKS = 10_000  # 100 ns in a millisecond


def whole(c: Column, unit: int) -> Column:
    """c divided by unit, rounded down, in whole numbers throughout."""
    return F.call_function("div", c - F.pmod(c, F.lit(unit)), F.lit(unit)).cast("long")


def to_ms(ticks: Column) -> Column:
    return whole(ticks, TICKS)


def vtt_time(ticks: Column) -> Column:
    """HH:MM:SS.mmm"""
    ms = to_ms(ticks)
    return F.format_string("%02d:%02d:%02d.%03d", whole(ms, 3_600_000), whole(ms, 60_000) % 60, whole(ms, 1000) % 60, ms % 1000)


def full_text(segments: DataFrame) -> DataFrame:
    """doc_id, text, words: texts joined by ". " and the number of words."""
    words = F.size(F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    kept = F.array_sort(F.collect_list(F.struct("index", "text")))
    return segments.withColumn("_w", words).groupBy("doc_id").agg(F.array_join(F.transform(kept, lambda x: x["text"]), ". ").alias("text"), F.sum("_w").cast("long").alias("words"))


def assign_segments(events: DataFrame, segments: DataFrame) -> DataFrame:
    """events(doc_id, pos, ...) with segment_index: the segment that owns word number pos; beyond the last, 0.

    segments: doc_id, index, words (its number of words).
    """
    order = Window.partitionBy("doc_id").orderBy("index")
    first = F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = segments.withColumn("_at", F.coalesce(first, F.lit(0)).cast("long")).filter("words > 0")
    total = Window.partitionBy("doc_id")
    starts = starts.withColumn("_total", F.max(F.col("_at") + F.col("words")).over(total).cast("long"))
    keyed = starts.select("doc_id", F.col("_at").alias("_t"), F.col("index").alias("segment_index"), "_total")
    out = as_of(events.withColumn("_t", F.col("pos").cast("long")), keyed, "_t", ["segment_index", "_total"])
    inside = F.col("pos") < F.col("_total")
    return out.withColumn("segment_index", F.when(inside, F.col("segment_index")).otherwise(F.lit(0)).cast("int")).drop("_t", "_total")


def as_of(left: DataFrame, right: DataFrame, time: str, values: list[str], key: str = "doc_id") -> DataFrame:
    """left with the values of the latest row of right at or before its time (null if there is none)."""
    columns = left.columns
    a = left.select(key, time, F.lit(1).alias("_side"), F.struct(*columns).alias("_row"), *[F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values])
    b = right.select(key, time, F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), *values)
    packed = a.unionByName(b).withColumn("_v", F.when(F.col("_side") == 0, F.struct(*values)))
    order = Window.partitionBy(key).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = packed.withColumn("_v", F.last("_v", ignorenulls=True).over(order)).filter("_side = 1")
    return found.select("_row.*", *[F.col(f"_v.{v}").alias(v) for v in values])


def active_at(ticks: DataFrame, spans: DataFrame, value: str) -> DataFrame:
    """ticks(doc_id, time_ms) with the active value of spans(doc_id, start_ms, value), else -1."""
    out = as_of(ticks, spans.select("doc_id", F.col("start_ms").alias("time_ms"), value), "time_ms", [value])
    return out.withColumn(value, F.coalesce(value, F.lit(-1)))


def segment_spans(words: DataFrame) -> DataFrame:
    """doc_id, segment_index, start_ms, end_ms: of the first word and of the last in order."""
    return words.groupBy("doc_id", "segment_index").agg(F.min_by("start_ms", "pos").alias("start_ms"), F.max_by("end_ms", "pos").alias("end_ms"))


def sync_words(events: DataFrame, segments: DataFrame) -> DataFrame:
    """doc_id, pos, start_ms, end_ms, text, segment_index of events(doc_id, pos, offset_ticks, duration_ticks, text)."""
    timed = events.withColumn("start_ms", to_ms(F.col("offset_ticks"))).withColumn("end_ms", to_ms(F.col("offset_ticks") + F.col("duration_ticks")))
    return assign_segments(timed, segments).select("doc_id", "pos", "start_ms", "end_ms", "text", "segment_index")


def nearest_box(points: DataFrame, boxes: DataFrame, metric: str = "web") -> DataFrame:
    """points(point_id, doc_id, page, px, py) with box_pos: the nearest box centre on the page, the first of equals.

    boxes: doc_id, pos, page, x, y, w, h. The boxes of a page bound the rows a point meets.
    """
    dx = F.col("x") + F.col("w") / 2 - F.col("px")
    dy = F.col("y") + F.col("h") / 2 - F.col("py")
    far = dx * dx + dy * dy if metric == "web" else 4 * F.abs(dy) + F.abs(dx)
    joined = points.join(boxes, ["doc_id", "page"]).withColumn("_d", F.struct(far.alias("d"), "pos"))
    best = joined.groupBy("point_id").agg(F.min("_d").alias("_d")).select("point_id", F.col("_d.pos").alias("box_pos"))
    return points.join(best, "point_id", "left")


def neighbours(positions: DataFrame, counts: DataFrame) -> DataFrame:
    """previous and next segment of (doc_id, index), kept within 0 and count - 1."""
    d = positions.join(counts, "doc_id")
    return d.select("doc_id", "index", F.greatest(F.col("index") - 1, F.lit(0)).alias("previous"), F.least(F.col("index") + 1, F.col("count") - 1).alias("next"))


def spoken_words(segments: DataFrame) -> DataFrame:
    """doc_id, pos, segment_index, word: the white-space tokens of all segments in order."""
    d = segments.select("doc_id", "index", F.posexplode(F.regexp_extract_all("text", F.lit(r"(\S+)"), 1)).alias("_i", "word"))
    order = Window.partitionBy("doc_id").orderBy("index", "_i")
    return d.select("doc_id", (F.row_number().over(order) - 1).alias("pos"), F.col("index").alias("segment_index"), "word")


def word_boxes(runs: DataFrame, pages: DataFrame, fractions: bool = True) -> DataFrame:
    """doc_id, pos, page, x, y, w, h, str: a box for each word of runs(doc_id, page, item_no, str, x, y, width, size), from the page's top left.

    x, y are a run's start on its baseline, y upwards; pages: doc_id, page, page_width,
    page_height. Boxes are fractions of the page, or in its units. Characters of a run count
    as equally wide, as there is no font to measure them by; words without area go. Rows of
    one document are numbered in one task.
    """
    parts = F.split("str", r"(?<=\s)(?=\S)|(?<=\S)(?=\s)")
    d = runs.join(pages, ["doc_id", "page"]).select("*", F.length("str").alias("_n"), parts.alias("_all"), F.posexplode(parts).alias("_i", "_word")).filter(F.col("_word").rlike(r"\S"))
    start = F.aggregate(F.slice("_all", 1, F.col("_i")), F.lit(0), lambda s, x: s + F.length(x))
    each = F.col("width") / F.col("_n")
    wide, high = (F.col("page_width"), F.col("page_height")) if fractions else (F.lit(1.0), F.lit(1.0))
    d = d.select(
        "doc_id", "page", "item_no", "_i", ((F.col("x") + start * each) / wide).alias("x"), ((F.col("page_height") - F.col("y") - F.col("size")) / high).alias("y"),
        (F.length("_word") * each / wide).alias("w"), (F.col("size") / high).alias("h"), F.col("_word").alias("str"),
    )
    order = Window.partitionBy("doc_id").orderBy("page", "item_no", "_i")
    return real_boxes(d).withColumn("pos", F.row_number().over(order) - 1).select("doc_id", "pos", "page", "x", "y", "w", "h", "str")


def real_boxes(boxes: DataFrame) -> DataFrame:
    return boxes.filter("w > 0 AND h > 0")


def scaled(boxes: DataFrame, width: float, height: float, pad: float = 2.0) -> DataFrame:
    """Page fractions to display units with some padding."""
    return boxes.select(
        "doc_id", "pos", "page", (F.col("x") * width - pad).alias("left"), (F.col("y") * height - pad).alias("top"),
        (F.col("w") * width + 2 * pad).alias("width"), (F.col("h") * height + 2 * pad).alias("height"),
    )


#: Where on the screen a word may be before the view moves, and where it is moved to, as shares of the view's height.
BAND_TOP, BAND_END, BAND_GOAL = 0.15, 0.70, 0.35


def scroll_to(top: Column, view_top: Column, view_height: Column) -> Column:
    """The new top of a view that has a word at top, or null where it needn't move."""
    outside = (top < view_top + BAND_TOP * view_height) | (top > view_top + BAND_END * view_height)
    return F.when(outside, top - BAND_GOAL * view_height)


def segment_starts(asked: DataFrame, spans: DataFrame) -> DataFrame:
    """asked(doc_id, segment_index) with start_ms: the segment's start, 0 if it has none."""
    first = spans.groupBy("doc_id", "segment_index").agg(F.min("start_ms").alias("start_ms"))
    return asked.join(first, ["doc_id", "segment_index"], "left").withColumn("start_ms", F.coalesce("start_ms", F.lit(0).cast("long")))


def reading_context(asked: DataFrame, words: DataFrame, segments: DataFrame, aligned: DataFrame) -> DataFrame:
    """asked(doc_id, pos) with word, segment_text, time_ms, page of the active word; nulls where there is none (pos -1)."""
    w = words.select("doc_id", "pos", F.col("text").alias("word"), F.col("start_ms").alias("time_ms"), "segment_index")
    s = segments.select("doc_id", F.col("index").alias("segment_index"), F.col("source_text").alias("segment_text"))
    d = asked.join(w, ["doc_id", "pos"], "left").join(s, ["doc_id", "segment_index"], "left").join(aligned.select("doc_id", "pos", "page"), ["doc_id", "pos"], "left")
    return d.select("doc_id", "pos", "word", "segment_text", "time_ms", "page")


# Names of natural-sounding voices.
NATURAL = "natural|enhanced|premium|samantha|aria|jenny"


def rank_voices(voices: DataFrame) -> DataFrame:
    """place, name, lang, local, chosen of voices(pos, name, lang, local): English ones if there are any, local ones first.

    Chosen is the first natural-sounding local voice, else the first. A list of voices is short: it is ordered in one task.
    """
    english = F.coalesce(F.lower("lang").startswith("en"), F.lit(False))
    every = Window.partitionBy(F.lit(0))
    d = voices.withColumn("_e", english).withColumn("_any", F.max("_e").over(every)).filter(F.col("_e") | ~F.col("_any"))
    natural = F.col("local") & F.lower("name").rlike(NATURAL)
    order = every.orderBy(F.desc("local"), "pos")
    d = d.withColumn("place", F.row_number().over(order) - 1).withColumn("_best", F.min(F.when(natural, F.col("place"))).over(every))
    return d.select("place", "name", "lang", "local", (F.col("place") == F.coalesce("_best", F.lit(0))).alias("chosen"))


def page_at(middles: DataFrame, pages: DataFrame) -> DataFrame:
    """The page that holds a scroll position: middles(doc_id, time) against pages(doc_id, top, height, page)."""
    found = as_of(middles, pages.select("doc_id", F.col("top").alias("time"), "page", (F.col("top") + F.col("height")).alias("end")), "time", ["page", "end"])
    return found.withColumn("page", F.when(F.col("time") < F.col("end"), F.col("page"))).drop("end")


def pieces(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence: a run without . ! ?, then some of these, then white space or the end.

    A run whose stops have no white space after them is in no sentence; the text is one piece if it has none.
    """
    out, at = [], 0
    while at < len(text):
        m = re.compile(r"([^.!?]*)([.!?]*)").match(text, at)
        end, blank = m.end(), compiled(r"\s*").match(text, m.end()).end()
        if m[1] and (end == len(text) or (m[2] and blank > end)):
            out.append((at, blank))
            end = blank
        at = end
    return out or ([(0, len(text))] if text else [])


def speech_chunks(text: str, most: int = 220) -> list[tuple[str, int]]:
    """(chunk, offset): sentences, longer ones cut at the last space within the limit, else hard."""
    out = []
    for at, end in pieces(text):
        while end - at > most:
            space = text.rfind(" ", at + 1, at + most + 1)
            cut = space if space > at else at + most
            out.append((text[at:cut], at))
            at = cut
        out.append((text[at:end], at))
    return out


def explode_chunks(segments: DataFrame, most: int = 220) -> DataFrame:
    """doc_id, index, chunk_no, chunk, start."""

    def cut(doc_id, index, text):
        return [(doc_id, index, n, chunk, start) for n, (chunk, start) in enumerate(speech_chunks(text or "", most))]

    rows = segments.select(F.col("doc_id").cast("long"), F.col("index").cast("int"), "text")
    return map_rows(rows, cut, [("doc_id", pa.int64(), "long"), ("index", pa.int32(), "int"), ("chunk_no", pa.int32(), "int"), ("chunk", pa.string(), "string"), ("start", pa.int32(), "int")])


def word_at_char(lookups: DataFrame, words: DataFrame) -> DataFrame:
    """lookups(doc_id, char_at) with pos: the word of words(doc_id, start, end, pos) that holds the character, else null."""
    found = as_of(lookups, words.select("doc_id", F.col("start").alias("char_at"), "pos", "end"), "char_at", ["pos", "end"])
    return found.withColumn("pos", F.when(F.col("char_at") < F.col("end"), F.col("pos"))).drop("end")


# Symbols by the names that they are matched by; the windows of the search.
SYMBOLS = {
    "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon",
    "ϵ": "epsilon", "ζ": "zeta", "η": "eta", "θ": "theta", "ϑ": "theta",
    "ι": "iota", "κ": "kappa", "λ": "lambda", "μ": "mu", "ν": "nu",
    "ξ": "xi", "π": "pi", "ρ": "rho", "σ": "sigma", "τ": "tau",
    "υ": "upsilon", "φ": "phi", "ϕ": "phi", "χ": "chi", "ψ": "psi",
    "ω": "omega",
    "Γ": "gamma", "Δ": "delta", "Θ": "theta", "Λ": "lambda", "Ξ": "xi",
    "Π": "pi", "Σ": "sigma", "Φ": "phi", "Ψ": "psi", "Ω": "omega",
    "∇": "nabla", "∂": "partial", "∑": "sum", "∏": "product",
    "∫": "integral", "∞": "infinity", "√": "sqrt", "≈": "approximately",
    "≤": "lessthanorequal", "≥": "greaterthanorequal", "≠": "notequal",
    "±": "plusorminus", "×": "times", "·": "dot", "∈": "in",
    "→": "to", "↦": "mapsto", "⊂": "subset", "⊆": "subset",
    "∀": "forall", "∃": "thereexists", "ℓ": "ell", "°": "degrees",
}
WINDOW, SHORT_WINDOW, LOST_WINDOW, LOST_AFTER = 40, 4, 200, 6


def normalised(word: str) -> str:
    """Lower case, symbols by name, marks stripped, ASCII letters and digits only."""
    named = "".join(SYMBOLS.get(c, c) for c in word.lower())
    return re.sub("[^a-z0-9]", "", unicodedata.normalize("NFKD", named))


def alike(a: str, b: str) -> bool:
    return a == b or (len(a) >= 4 and len(b) >= 4 and (a.startswith(b) or b.startswith(a)))


def align(spoken: list[str], printed: list[str]) -> list[int | None]:
    """The place in printed of each spoken word, walking forward only.

    A word meets a printed one, or one that a hyphen has split in two; words without letters or digits are passed over.
    """
    shown = [(i, n) for i, w in enumerate(printed) if (n := normalised(w))]
    whole_of: dict[int, str] = {}

    def joined(j: int) -> str:
        """The word that place j of shown starts with a hyphen at its end, or nothing."""
        if j not in whole_of:
            first = printed[shown[j][0]]
            split = j + 1 < len(shown) and first.endswith("-")
            whole_of[j] = normalised(first[:-1] + printed[shown[j + 1][0]]) if split else ""
        return whole_of[j]

    out: list[int | None] = []
    at, misses = 0, 0
    for token in spoken:
        want = normalised(token.split()[0]) if token.split() else ""
        if not want:
            out.append(None)
            continue
        reach = LOST_WINDOW if misses >= LOST_AFTER and len(want) >= 5 else SHORT_WINDOW if len(want) < 3 else WINDOW
        for j in range(at, min(at + reach, len(shown))):
            used = 1 if alike(want, shown[j][1]) else 2 if joined(j) and alike(want, joined(j)) else 0
            if used:
                out.append(shown[j][0])
                at, misses = j + used, 0
                break
        else:
            out.append(None)
            misses += 1
    return out


def align_words(spoken: DataFrame, boxes: DataFrame) -> DataFrame:
    """doc_id, spoken_pos, box_pos of spoken(doc_id, pos, text) and boxes(doc_id, pos, str), document by document."""

    def one(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:  # an empty side comes without columns
            return pd.DataFrame({"doc_id": [], "spoken_pos": [], "box_pos": []})
        left = left.sort_values("pos")
        right = right.sort_values("place") if len(right) else pd.DataFrame({"place": [], "str": []})
        places = right["place"].tolist()
        found = align(left["text"].tolist(), right["str"].tolist())
        return pd.DataFrame({"doc_id": key[0], "spoken_pos": left["pos"].to_numpy(), "box_pos": pd.array([None if i is None else places[i] for i in found], dtype="Int32")})

    # both sides may come from one table; columns of the same origin would be taken for one another
    shown = boxes.select(F.col("doc_id").alias("doc"), F.col("pos").alias("place"), F.col("str").alias("str"))
    pair = spoken.select("doc_id", "pos", "text").groupBy("doc_id").cogroup(shown.groupBy("doc"))
    return pair.applyInPandas(one, "doc_id long, spoken_pos int, box_pos int")
