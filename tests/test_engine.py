import duckdb
from pyspark.sql import functions as F

from lectern.functions import rewrite
from lectern.operators import markup, ordered, timing
from lectern.plans import catalogue


def test_prose_rules_apply_in_order(spark):
    texts = ["see Fig. 3, e.g. [1, 2] here", "as shown (Smith, 2020) vs. x", "at https://x.org/a now", "*plain*", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", rewrite.prose(F.col("t")).alias("s")).collect()
    spoken = {r.i: r.s for r in rows}
    assert spoken[0] == "see Figure 3, for example here"
    assert spoken[1] == "as shown versus x"
    assert spoken[2] == "at now"
    assert (spoken[3], spoken[4], spoken[5]) == ("plain", "", None)


def test_prose_plan_stays_linear(spark):
    plan = spark.range(1).select(rewrite.prose(F.col("id").cast("string")).alias("s"))._jdf.queryExecution().analyzed().toString()
    assert 0 < plan.count("regexp_replace") <= 2 * len(rewrite.PROSE)


def test_speak_math():
    assert rewrite.speak_math(r"\frac{1}{\sqrt{x}}") == "1 over square root of x"
    assert rewrite.speak_math("x^2 + y") == "x squared plus y"
    assert rewrite.speak_spans("let $x^2$ be") == "let  x squared  be"
    assert rewrite.speak_math("") == ""


def test_repeated_lines_go_and_blank_ones_stay(spark):
    docs = spark.createDataFrame([(1, "a\n a \nb\n\n\na"), (2, "")], "doc_id long, text string")
    kept = ordered.rejoin(ordered.drop_repeated_lines(ordered.explode_lines(docs)), "line", "pos", "\n")
    assert {r.doc_id: r.text for r in kept.collect()} == {1: "a\nb\n\n\na", 2: ""}


def test_repeated_sentences(spark):
    docs = spark.createDataFrame([(1, "One two three four. Other thing. One two three four! End."), (2, "A. A.")], "doc_id long, text string")
    kept = ordered.drop_repeated_sentences(ordered.explode_sentences(docs)).orderBy("doc_id", "pos").collect()
    assert [r.sentence for r in kept if r.doc_id == 1] == ["One two three four.", "Other thing.", "End."]
    assert len([r for r in kept if r.doc_id == 2]) == 2


def test_active_word(spark):
    spans = spark.createDataFrame([(1, 10, 0), (1, 20, 1)], "doc_id long, start_ms long, pos int")
    ticks = spark.createDataFrame([(1, 5), (1, 10), (1, 19), (1, 25), (2, 5)], "doc_id long, time_ms long")
    found = {(r.doc_id, r.time_ms): r.pos for r in timing.active_at(ticks, spans, "pos").collect()}
    assert found == {(1, 5): -1, (1, 10): 0, (1, 19): 0, (1, 25): 1, (2, 5): -1}


def test_words_align_forward_and_documents_may_lack_a_side(spark):
    spoken = spark.createDataFrame([(1, 0, "The"), (1, 1, "alpha"), (1, 2, "missing"), (1, 3, "end"), (2, 0, "alone")], "doc_id long, pos int, text string")
    boxes = spark.createDataFrame([(1, 0, "the"), (1, 1, "α"), (1, 2, "end."), (3, 0, "unread")], "doc_id long, pos int, str string")
    found = {(r.doc_id, r.spoken_pos): r.box_pos for r in timing.align_words(spoken, boxes).collect()}
    assert found == {(1, 0): 0, (1, 1): 1, (1, 2): None, (1, 3): 2, (2, 0): None}


def test_words_of_one_table_align(spark):
    words = spark.createDataFrame([(1, 0, "one"), (1, 1, "two")], "doc_id long, pos int, text string")
    found = timing.align_words(words, words.filter("pos = 1").withColumnRenamed("text", "str")).collect()
    assert {(r.spoken_pos, r.box_pos) for r in found} == {(0, None), (1, 1)}


def test_speech_chunks_cover_the_text():
    text = "A first sentence. " + "word " * 100 + "end. " + "x" * 500
    chunks = timing.speech_chunks(text)
    assert all(len(c) <= 220 and text[s : s + len(c)] == c for c, s in chunks)
    assert timing.speech_chunks("") == []


def test_blocks_and_footnotes():
    assert [(t, r) for t, r, _ in markup.blocks("<h1>T</h1><table><tr><td>x</td></tr></table><p>a <em>b</em></p>")] == [("h1", "T"), ("p", "a b")]
    moved = markup.relocated([("See this.1 And on.", "s", "paragraph"), ("Next.", "n", "paragraph"), ("Footnote 1: a note.", "f", "paragraph")])
    assert [k for _, _, k in moved] == ["paragraph", "footnote", "paragraph"]
    assert moved[1][0] == "Footnote 1: a note. End of footnote."


def test_looping_sentences_of_a_block_go(spark):
    loop = "One two three four.\nOther thing. One two  three four! ... Other thing. End."
    docs = spark.createDataFrame([(1, f"# Title\n\n{loop}\n\nHi. Hi."), (2, "One two three four. One two three four.")], "doc_id long, mmd string")
    web = {(r.doc_id, r["index"]): (r.text, r.source_text) for r in markup.process_markup(docs).collect()}
    once = "One two three four. Other thing. ... End."
    assert web == {(1, 0): ("Title", "Title"), (1, 1): (once, once), (1, 2): ("Hi. Hi.",) * 2, (2, 0): ("One two three four. One two three four.",) * 2}
    desktop = [r.source_text for r in markup.process_markup(docs, "desktop").orderBy("doc_id", "index").collect()]
    assert desktop[1] == loop


def test_derived_queries_run_on_whole_texts(spark):
    sf = "/root/testdata/sf0.01"
    notes = [r for r in catalogue.QUERIES["footnotes"](spark, sf).filter("segment_type = 'footnote'").collect()]
    assert any(len(r.source_text) > 60 for r in notes)
    assert all(r.text == f"Footnote 1: {r.source_text.strip()} End of footnote." for r in notes)
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{sf}/benchmark.parquet'")
        for name in ("prose_rules_whole", "metadata_whole"):
            found = sorted(map(tuple, catalogue.QUERIES[name](spark, sf).collect()))
            assert found == sorted(db.execute(catalogue.SQL[name]).fetchall())
            assert max(len(t) for _, t in found) > 350


def test_lint(spark):
    pages = spark.createDataFrame([(1, 1, r"\alpha \foo \foo \bar"), (1, 2, "none")], "doc_id long, page_no int, mmd string")
    names = spark.createDataFrame([("alpha",), ("bar",)], "name string")
    found = {r.page_no: (r.total, r.unknown, r.bad) for r in markup.lint(pages, names).collect()}
    assert found == {1: (4, 2, False), 2: (0, 0, False)}
    assert [(r.command, r.at) for r in markup.unknown_commands(pages, names).orderBy("at").collect()] == [("foo", 7), ("foo", 12)]


def test_entry_and_oracles_agree_on_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
