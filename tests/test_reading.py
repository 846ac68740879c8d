import random
import re

from pyspark.sql import functions as F

from lectern.operators import markup, ordered, timing


def test_chunks_are_those_of_the_plain_pattern():
    plain = re.compile(r"[^.!?]+[.!?]+(?:\s+|\Z)|[^.!?]+\Z")
    draw = random.Random(1)
    for _ in range(3000):
        text = "".join(draw.choices("ab .!?\n3", k=draw.randrange(1, 14)))
        assert timing.pieces(text) == ([m.span() for m in plain.finditer(text)] or [(0, len(text))])
    assert [c for c, _ in timing.speech_chunks("It is 3.14 now. Next.")] == ["14 now. ", "Next."]  # what a stop within a number cuts off isn't read
    long = "w" * 100 + " " + "v" * 150 + " end."
    assert timing.speech_chunks(long) == [("w" * 100, 0), (" " + "v" * 150 + " end.", 100)]


def align_plainly(spoken, printed):
    """The walk with the pairs it may take written out."""
    out, at, misses = [], 0, 0
    shown = [i for i, w in enumerate(printed) if timing.normalised(w)]
    for token in spoken:
        want = timing.normalised(token)
        if not want:
            out.append(None)
            continue
        reach = 200 if misses >= 6 and len(want) >= 5 else 4 if len(want) < 3 else 40
        pairs = []
        for k in range(at, min(at + reach, len(shown))):
            pairs.append((k, 1, timing.normalised(printed[shown[k]])))
            if k + 1 < len(shown) and printed[shown[k]].endswith("-"):
                pairs.append((k, 2, timing.normalised(printed[shown[k]][:-1] + printed[shown[k + 1]])))
        hit = next(((k, n) for k, n, w in pairs if w and (w == want or (min(len(w), len(want)) >= 4 and (w.startswith(want) or want.startswith(w))))), None)
        out.append(None if hit is None else shown[hit[0]])
        at, misses = (at, misses + 1) if hit is None else (sum(hit), 0)
    return out


def test_alignment_equals_the_walk_written_out():
    draw = random.Random(2)
    vocabulary = ["the", "a", "alpha", "α", "alphabet", "alpha-", "bet", "theorem", "theo-", "rem", "…", "naïve", "naive", "≤", "x", "of", "graph", "graphs", "∑", "end."]
    for _ in range(400):
        spoken, printed = draw.choices(vocabulary, k=draw.randrange(30)), draw.choices(vocabulary, k=draw.randrange(300))
        assert timing.align(spoken, printed) == align_plainly(spoken, printed)
    assert timing.align(["alphabet"], ["alpha-", "bet"]) == [0] and timing.normalised("ξ≤∑Ünïcode") == "xilessthanorequalsumunicode"


def test_footnotes_are_found_in_all_their_forms():
    found = {t: markup.footnote(t) for t in ("Footnote: x", "footnote †: x", "Footnote 1. x", "† y", "§: z", "Footnote *: w", "Footnote 12:", "1 x", "Footnotes: x")}
    assert list(found.values()) == [("", "x"), ("†", "x"), ("1", "x"), ("†", "y"), ("§", "z"), ("*", "w"), None, None, None]
    cases = [("shown.3 x", "3", True), ("is 3.5", "5", False), ("x12", "1", False), ("see Footnote 4", "4", True), ("(a)2, b", "2", True), ("word7", "7", True), ("2", "2", False), ("x† y", "†", True), ("x* y", "*", False)]
    assert [markup.has_reference(t, m) for t, m, _ in cases] == [w for *_, w in cases]


def test_footnotes_move(spark):
    rows = ["See it.1 And on.", "Then this† too.", "Footnote 1: first.", "† second.", "Footnote 9: lost.", "Footnote: bare.", "§", "HEAD", "after"]
    data = [(d, i, t, t, "heading" if t == "HEAD" else "paragraph") for d in (1, 2) for i, t in enumerate(rows) if d == 1 or not t.startswith(("Footnote", "†", "§"))]
    out = markup.relocate_footnotes(spark.createDataFrame(data, "doc_id long, index int, text string, source_text string, segment_type string")).orderBy("doc_id", "index").collect()
    # notes without a reference wait for the end of their section, the last first
    assert [r.text for r in out if r.doc_id == 1] == [
        "See it.1 And on.", "Footnote 1: first. End of footnote.", "Then this† too.", "Footnote †: second. End of footnote.",
        "Footnote: bare. End of footnote.", "Footnote 9: lost. End of footnote.", "HEAD", "after",
    ]
    assert [(r["index"], r.text) for r in out if r.doc_id == 2] == list(enumerate(["See it.1 And on.", "Then this† too.", "HEAD", "after"]))


def test_metadata_paragraphs_and_tails(spark):
    texts = {
        "Keywords: a, b": None, "Key words and phrases. x": None, "keyword—x": None, "Index terms - y": None, "CCS Concepts: z": None, "2020 Mathematics Subject Classification 11A": None, "MSC (2020): 11": None,
        "This work has been partly supported by all": None, "The second author's work is financed by x": None, "Gratefully funded by x": None, "Funding. x": None, "E-mail address: a": None, "Date: May": None,
        "A real text. Key words: a": "A real text.", "Dated long ago": "Dated long ago", "msc tests": "msc tests", "The authors supported it": "The authors supported it", "Key words: " + "x" * 600: "Key words: " + "x" * 600,
        "This project was funded by x. Keywords: b": None,
    }
    data = [(i, 0, t, f"see {t}", "paragraph") for i, t in enumerate(texts)] + [(99, 0, "Keywords: a", "Keywords: a", "heading")]
    out = {r.doc_id: r for r in ordered.drop_metadata(spark.createDataFrame(data, "doc_id long, index int, text string, source_text string, segment_type string")).collect()}
    assert {i: out[i].text if i in out else None for i in range(len(texts))} == dict(enumerate(texts.values())) and 99 in out
    assert out[13].source_text == "see A real text."


def test_sentences_without_words_do_not_part_repeats(spark):
    assert ordered.kept_sentences("Yes. ?! Yes. Done.") == ["Yes.", "?!", "Done."]
    docs = spark.createDataFrame([(1, "Yes. ?! Yes. Done."), (2, "a. b. a.")], "doc_id long, text string")
    rows = ordered.drop_repeated_sentences(ordered.explode_sentences(docs)).orderBy("doc_id", "pos").collect()
    assert [r.sentence for r in rows] == ["Yes.", "?!", "Done.", "a.", "b.", "a."]
    assert [r.s for r in docs.select(ordered.sentences_column(F.col("text")).alias("s")).collect()] == [["Yes.", "?!", "Done."], ["a.", "b.", "a."]]


def test_segments_without_words_stay(spark):
    long = "one two three four five six seven eight nine ten"
    texts = ["Hi", "hi!", "—", "…", "Hi", long, "x", long, "a b c d", "y", "a b c d", "z", "a b c d"]
    df = spark.createDataFrame([(1, i, t, t, "paragraph") for i, t in enumerate(texts)], "doc_id long, index int, text string, source_text string, segment_type string")
    assert [r.text for r in ordered.drop_repeated_segments(df).orderBy("index").collect()] == ["Hi", "—", "…", "Hi", long, "x", "a b c d", "y", "a b c d", "z"]


def test_lines_and_tables(spark):
    rows = [(1, "a\n a \nb\n\n\na"), (2, ""), (3, None), (4, "x\\begin{table}1\n2\\end{table}y\\begin{table*}k\\end{table*}"), (5, "t \\[a\\] \\[b\nc\\]")]
    out = {r.doc_id: r.m for r in spark.createDataFrame(rows, "doc_id long, t string").select("doc_id", markup.preprocessed(F.col("t")).alias("m")).collect()}
    assert out == {1: "a\nb\n\n\na", 2: "", 3: None, 4: "xy\\begin{table*}k\\end{table*}", 5: "t \n\n\\[a\\]\n\n \\[b\nc\\]"}


def test_blocks_of_html():
    html = "<section><p>a<p>b <!-- c --></section><p> <em>Head</em> </p><ul><li>x<li>y<p>z</p></ul><p><em>e</em><img src=1></p><h2>T<br>U</h2><table><tr><td><p>no</p></td></tr></table>"
    assert markup.blocks(html) == [("section", "ab ", False), ("p", "a", False), ("p", "b ", False), ("p", " Head ", True), ("li", "x", False), ("li", "yz", False), ("p", "z", False), ("p", "e", True), ("h2", "TU", False)]
    assert [t for t, *_ in markup.blocks("<p> <em>Head</em> </p>", "desktop")] == ["p"] and not markup.blocks("<p> <em>Head</em> </p>", "desktop")[0][2]
    assert [s[1] for s in markup.segments_of(html)] == ["ab", "a", "b", "x", "yz", "z", "TU"]
    assert markup.segments_of("<p>(</p><p>Fig. 2</p>") == [(1, "Figure 2", "Fig. 2", "paragraph")]
    assert [s[1] for s in markup.segments_of("<p>(</p><p>a<b>b</b></p>", "desktop")] == ["(", "a b"]


def test_plans_read_once(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, mmd string")
    plan = markup.process_markup(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange ") <= 2


def test_no_digit_of_a_tick_is_lost(spark):
    big = 9_007_199_254_740_993 * 10_000 // 10
    df = spark.createDataFrame([(big,), (-1,), (9999,), (36_000_000_000 * 27 + 10_000_000 * 61 + 1_230_000,)], "t long").select(timing.to_ms(F.col("t")).alias("ms"), timing.vtt_time(F.col("t")).alias("v"))
    rows = df.collect()
    assert [r.ms for r in rows] == [big // 10_000, -1, 0, 27 * 3_600_000 + 61_123] and rows[3].v == "27:01:01.123"


def test_voices(spark):
    def chosen(rows):
        out = timing.rank_voices(spark.createDataFrame(rows, "pos int, name string, lang string, local boolean")).orderBy("place").collect()
        return [r.name for r in out], [r.name for r in out if r.chosen]

    assert chosen([(0, "Far", "en-US", False), (1, "Near", "en", True), (2, "Aria", "EN", True), (3, "Otto", "de", True)]) == (["Near", "Aria", "Far"], ["Aria"])
    assert chosen([(0, "Otto", "de", False), (1, "Anna", None, True)]) == (["Anna", "Otto"], ["Anna"])
    assert chosen([(0, "Far Natural", "en", False)]) == (["Far Natural"], ["Far Natural"])


def test_lookups_of_a_reader(spark):
    words = spark.createDataFrame([(1, 0, 10, "a", 0), (1, 1, 20, "b", 2)], "doc_id long, pos long, start_ms long, text string, segment_index int")
    segments = spark.createDataFrame([(1, 0, "first"), (1, 1, "second")], "doc_id long, index int, source_text string")
    aligned = spark.createDataFrame([(1, 0, 7)], "doc_id long, pos long, page int")
    asked = spark.createDataFrame([(1, 0), (1, 1), (1, -1)], "doc_id long, pos long")
    out = {r.pos: tuple(r)[2:] for r in timing.reading_context(asked, words, segments, aligned).collect()}
    assert out == {0: ("a", "first", 10, 7), 1: ("b", None, 20, None), -1: (None, None, None, None)}
    spans = spark.createDataFrame([(1, 0, 5)], "doc_id long, segment_index int, start_ms long")
    starts = timing.segment_starts(spark.createDataFrame([(1, 0), (1, 8)], "doc_id long, segment_index int"), spans)
    assert {(r.segment_index, r.start_ms) for r in starts.collect()} == {(0, 5), (8, 0)}


def test_a_single_note_goes_where_a_sort_key_says():
    """With one note, the order is that of keys: behind its citation, else before the next heading, else last."""
    draw = random.Random(9)
    for _ in range(600):
        n = draw.randrange(1, 9)
        kinds = [draw.choice(("paragraph", "paragraph", "heading")) for _ in range(n)]
        texts = [draw.choice(("Some text.", "It is so.2 Yes.", "See footnote 2 there", "A mark\u2020 here", "Plain 2 text")) for _ in range(n)]
        at, marker = draw.randrange(n + 1), draw.choice(("2", "\u2020", "", "*"))
        note = {"2": "Footnote 2: body", "\u2020": "\u2020 body", "": "Footnote: body", "*": "Footnote *: body"}[marker]
        rows = [(t, t, k) for t, k in zip(texts, kinds, strict=True)]
        cites = {"2": ("It is so.2 Yes.", "See footnote 2 there"), "\u2020": ("A mark\u2020 here",)}.get(marker, ())
        cited = [i for i in range(at) if texts[i] in cites]
        later = [i for i in range(at, n) if kinds[i] == "heading"]
        key = cited[-1] + 0.5 if cited else later[0] - 0.5 if later else n
        label = f" {marker}" if marker in ("2", "\u2020") else ""
        want = sorted([(i, r) for i, r in enumerate(rows)] + [(key, (f"Footnote{label}: body End of footnote.", note, "footnote"))], key=lambda x: x[0])
        assert markup.relocated([*rows[:at], (note, note, "paragraph"), *rows[at:]]) == [r for _, r in want]


PAPER = """# On Small Things

Ann Author, Some University

ann@example.org

## Abstract

We show a small thing. Keywords: small, things

Keywords: small, things

_Running Head_

## 1. Introduction

Let $x^2 \\leq y$ hold, as in Fig. 1 [3, 4]. It was known.1 More follows.
More follows.
More follows.

Footnote 1: by others.

- first *point*
- second

| a | b |
|---|---|
| 1 | 2 |

\\begin{table}
dropped
\\end{table}

(

The same long sentence is written here twice over again.

The same long sentence is written here twice over again.

## References

[1] A. Author, 1999.

## Appendix

The end.
"""


def test_a_whole_paper(spark):
    rows = markup.process_markup(spark.createDataFrame([(1, PAPER)], "doc_id long, mmd string")).orderBy("index").collect()
    assert [(r["index"], r.segment_type, r.text) for r in rows] == list(
        zip(
            range(99),
            ["heading", "heading", "paragraph", "heading", "paragraph", "footnote", "paragraph", "paragraph", "paragraph", "heading", "paragraph"],
            [
                "On Small Things", "Abstract", "We show a small thing.", "1. Introduction", "Let x squared less than or equal to y hold, as in Figure 1. It was known.1 More follows. More follows.",
                "Footnote 1: by others. End of footnote.", "first point", "second", "The same long sentence is written here twice over again.", "Appendix", "The end.",
            ],
        )
    )
    desktop = [r.text for r in markup.process_markup(spark.createDataFrame([(1, PAPER)], "doc_id long, mmd string"), "desktop").orderBy("index").collect()]
    assert "(" in desktop and sum("same long sentence" in t for t in desktop) == 2 and any("$x^2" in t for t in desktop)


def test_boxes_of_words(spark):
    runs = spark.createDataFrame([(1, 2, 0, "  ab c ", 10.0, 90.0, 70.0, 10.0), (1, 1, 0, "xyz", 0.0, 50.0, 30.0, 5.0), (1, 2, 1, " ", 0.0, 0.0, 9.0, 9.0), (1, 2, 2, "flat", 0.0, 0.0, 9.0, 0.0)], "doc_id long, page int, item_no int, str string, x double, y double, width double, size double")
    pages = spark.createDataFrame([(1, 1, 100.0, 200.0), (1, 2, 100.0, 200.0)], "doc_id long, page int, page_width double, page_height double")
    units = [tuple(r)[1:] for r in timing.word_boxes(runs, pages, fractions=False).orderBy("pos").collect()]
    assert units == [(0, 1, 0.0, 145.0, 30.0, 5.0, "xyz"), (1, 2, 30.0, 100.0, 20.0, 10.0, "ab"), (2, 2, 60.0, 100.0, 10.0, 10.0, "c")]
    shares = [tuple(r)[3:7] for r in timing.word_boxes(runs, pages).orderBy("pos").collect()]
    assert shares == [(0.0, 0.725, 0.3, 0.025), (0.3, 0.5, 0.2, 0.05), (0.6, 0.5, 0.1, 0.05)]
