import json

import pytest
from pyspark.sql import functions as F

from lectern.operators import markup
from lectern.sources import files
from lectern.sources.folders import shared_folder
from lectern.streaming import live


def raw(spark, *values):
    return spark.createDataFrame([(i, v if isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)], "i int, value string")


@pytest.mark.parametrize("category", ["missed-latex", "pronunciation", "voice-quality", "other", "thumbs-up", "thumbs-down"])
def test_every_category_of_the_web_dialect(spark, category):
    rows = {r.i: r.reason for r in files.parse_feedback(raw(spark, {"category": category, "comment": "x"}, {"category": category, "comment": " \n"}, {"category": category})).collect()}
    free = category.startswith("thumbs")
    assert rows == {0: None, 1: None if free else "comment", 2: None if free else "comment"}
    desktop = {r.i: r.reason for r in files.parse_feedback(raw(spark, {"category": category, "comment": "x"}), "desktop").collect()}
    assert desktop == {0: None if category in ("missed-latex", "pronunciation", "other") else "category"}


def test_what_is_no_record(spark):
    rows = files.parse_feedback(raw(spark, '{"category":"other"', "[]", "", "null", {"comment": "x"}, {"category": "bug", "comment": "x"}, {"category": 5, "comment": "x"})).collect()
    assert [r.reason for r in sorted(rows, key=lambda r: r.i)] == ["json", "json", "json", "json", "category", "category", "category"]


def test_records_are_cut_and_numbers_read(spark):
    lint = {"unknown_commands": "7", "total_commands": "x", "bad_pages": [3, "4", "y", None, "1e999"] + list(range(200))}
    full = {"category": "other", "comment": "  " + "c" * 6000, "file_name": "f" * 300, "segment_count": "12", "lint": lint, "user_agent": "u" * 500}
    rows = {r.category + str(r.segment_count): r for r in files.accepted(files.parse_feedback(raw(spark, full, {"category": "thumbs-up", "segment_count": None, "lint": None}))).collect()}
    one, bare = rows["other12"], rows["thumbs-up0"]
    assert (len(one.comment), len(one.file_name), len(one.user_agent)) == (5000, 200, 400)
    assert (one.lint.unknown_commands, one.lint.total_commands, one.lint.bad_pages[:4], len(one.lint.bad_pages)) == (7, 0, [3, 4, 0, 0], 98)
    assert (bare.comment, bare.file_name, bare.lint, bare.ip_country) == ("", "", None, "")


def test_the_place_that_was_read_is_kept(spark):
    context = {"word": "w" * 300, "segment_text": "s" * 3000, "time_ms": 1234, "page": None}
    d = raw(spark, {"category": "pronunciation", "comment": " x ", "context": context}, {"category": "other", "comment": "y"}).withColumn("job_id", F.lit("j1"))
    a, b = files.accepted(files.parse_feedback(d, "desktop"), "desktop").orderBy("comment").collect()
    assert (a.job_id, a.comment, len(a.word), len(a.segment_text), a.time_ms, a.page) == ("j1", "x", 200, 2000, 1234, None)
    assert (b.word, b.segment_text, b.time_ms, b.page) == ("", "", None, None)


def test_the_log_grows_and_is_exported(spark):
    folder = shared_folder(spark, "log")
    stored = files.accepted(files.parse_feedback(raw(spark, {"category": "other", "comment": "a"}, {"category": "thumbs-down"})))
    files.append_feedback(stored, folder)
    files.append_feedback(stored, folder)
    assert spark.read.json(folder).count() == 4
    keyed = spark.createDataFrame([(f"ts:2020-01-01T00:00:00.{i:03d}Z:abc", f'{{"n":{i}}}' if i % 7 else None) for i in range(999)] + [("ts:2021", '{"n":-1}'), ("ts:2022", '{"n":-2}')], "key string, value string")
    lines = files.json_lines(files.export(keyed)).first().body
    found = [json.loads(x)["n"] for x in lines.splitlines()]
    assert lines.endswith("}\n") and found == [i for i in range(999) if i % 7] + [-1]


def test_keys_are_stable(spark):
    df = spark.range(50).select(files.feedback_key(F.lit("2020-01-01T00:00:00.123Z"), F.col("id")).alias("k"))
    keys = [r.k for r in df.collect()]
    assert keys == [r.k for r in df.collect()] and len(set(keys)) == 50
    assert all(k.startswith("ts:2020-01-01T00:00:00.123Z:") and len(k.rsplit(":", 1)[1]) == 6 and k.rsplit(":", 1)[1].isalnum() for k in keys)


def test_issue_urls(spark):
    from urllib.parse import parse_qs, urlsplit

    one = spark.range(1).select(
        files.issue_url("https://example.org/r", F.lit("other"), F.lit("a & b's (c) é~" + "x" * 80), F.lit(None), F.lit(3), files.lint_note(F.lit(1), F.lit(9), F.array(F.lit(2))), F.lit("UA")).alias("web"),
        files.issue_url_desktop("https://example.org/r", F.lit("pronunciation"), F.lit(" hm "), F.lit("word"), F.lit(4), F.lit(75_300), F.lit("s" * 700)).alias("desktop"),
    ).first()
    web, desktop = (parse_qs(urlsplit(u).query) for u in one)
    comment = "a & b's (c) é~" + "x" * 80
    assert web["labels"] == ["beta-feedback"] and web["title"] == [f"[beta] other: {comment[:60]}"] and "'" in one.web and "(c)" in one.web and "%20" in one.web and "+" not in one.web
    assert web["body"] == [f"**Category:** other\n**File:** (unknown)\n\n{comment}\n\n---\n_segments: 3 · lint: 1/9 unknown (pages 2) · UA_"]
    assert desktop["title"] == ["[Incorrect pronunciation] hm"] and desktop["labels"] == ["beta-feedback,pronunciation"]
    assert "- Playback time: 1:15\n- Passage:\n\n> " + "s" * 600 in desktop["body"][0] and "- Page: 4" in desktop["body"][0]


def test_jobs(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"%PDF")
    (tmp_path / "b.txt").write_text("x")
    jobs = files.register_jobs(spark, str(tmp_path))
    ids = [r.job_id for r in jobs.collect()]
    assert len(ids) == 1 and len(ids[0]) == 12 and int(ids[0], 16) >= 0 and ids == [r.job_id for r in jobs.collect()]
    held = spark.createDataFrame([("j", "subs.vtt", "/x")], "job_id string, name string, path string")
    asked = spark.createDataFrame([("j", "subs.vtt"), ("j", "audio.mp3"), ("k", "subs.vtt")], "job_id string, name string")
    assert {(r.job_id, r.name, r.path, r.status) for r in files.job_files(asked, held).collect()} == {("j", "subs.vtt", "/x", 200), ("j", "audio.mp3", None, 404), ("k", "subs.vtt", None, 404)}
    pairs = spark.createDataFrame([("a.Pdf", "b.tex"), ("a.doc", "b.tex"), ("a.pdf", "b.md")], "input string, output string")
    assert [r.reason for r in files.convertible(pairs).collect()] == [None, "input", "output"]
    some = spark.createDataFrame([("x", None), (" \n", "y"), ("a", "b"), (None, None)], "p string, f string").select(files.with_fallback(F.col("p"), F.col("f")).alias("t"))
    assert [r.t for r in some.collect()] == ["x", "y", "a", None]


def test_texts_are_written_and_read_back(spark):
    folder = shared_folder(spark, "texts")
    files.write_texts(spark.createDataFrame([("a.b.mmd", "one\n\ntwo é"), ("c", "")], "name string, text string"), folder)
    found = {r.path.split("name=")[1].split("/")[0]: r.mmd for r in files.read_markup(spark, f"{folder}/*").collect()}
    assert found == {"a.b": "one\n\ntwo é\n", "c": "\n"}
    lists = shared_folder(spark, "names")
    spark.createDataFrame([(" alpha ",), ("",), ("beta",), ("alpha",)], "value string").write.text(lists)
    assert [r.name for r in markup.vocabulary_of(files.read_vocabulary(spark, lists)).collect()] == ["alpha", "beta"]


def test_captions_and_sync_map(spark):
    events = spark.createDataFrame([(1, 1, 10_000, 5_000, "b"), (1, 0, 0, 9_999, "a")], "doc_id long, pos long, offset_ticks long, duration_ticks long, text string")
    assert files.web_vtt(events).first().vtt == "WEBVTT\n\n1\n00:00:00.000 --> 00:00:00.000\na\n\n2\n00:00:00.001 --> 00:00:00.001\nb\n\n"
    words = spark.createDataFrame([(1, 1, 5, 9, "b", 0), (1, 0, 0, 4, "a", 0)], "doc_id long, pos long, start_ms long, end_ms long, text string, segment_index int")
    spans = spark.createDataFrame([(1, 0, 0, 9)], "doc_id long, segment_index int, start_ms long, end_ms long")
    assert json.loads(files.sync_map(words, spans).first().json) == {
        "words": [{"start_time_ms": 0, "end_time_ms": 4, "text": "a", "segment_index": 0}, {"start_time_ms": 5, "end_time_ms": 9, "text": "b", "segment_index": 0}],
        "segments": [{"segment_index": 0, "start_time_ms": 0, "end_time_ms": 9}],
    }


def test_the_lint_report(spark):
    pages = spark.createDataFrame([(1, 1, "x\n\\foo \\alpha"), (1, 2, "none")], "doc_id long, page_no int, mmd string")
    one, two = markup.lint_report(pages, spark.createDataFrame([("alpha",)], "name string")).orderBy("page_no").collect()
    assert one.report == "@2  \\foo\n    …x \\foo \\alpha…\n\n1 unknown of 2 control sequences (50.0% bad)" and one.failed and not two.failed
    assert json.loads(one.json) == {"totalCommands": 2, "unknown": [{"command": "\\foo", "index": 2, "context": "x\n\\foo \\alpha"}]} and json.loads(two.json) == {"totalCommands": 0, "unknown": []}


def test_stages(spark):
    docs = spark.createDataFrame([(1, "# T\n\na $x^2$ b\nb\nb"), (2, None)], "doc_id long, mmd string")
    out = {r.doc_id: r for r in markup.stages(docs).collect()}
    assert out[1].preprocessed == "# T\n\na $x^2$ b\nb" and out[1].spoken == "# T\n\na  x squared  b\nb" and out[1].rendered == "<h1>T</h1>\n<p>a  x squared  b\nb</p>" and out[1].final == "T\n\na x squared b b"
    folder = shared_folder(spark, "stages")
    files.write_stages(markup.stages(docs), folder)
    for n, name in enumerate(("preprocessed", "spoken", "rendered", "segments", "final"), 1):
        found = {r.path.split("name=")[1].split("/")[0]: r.mmd for r in files.read_markup(spark, f"{folder}/{n}-{name}/*").collect()}
        assert found == {"1": out[1][name] + "\n", "2": out[2][name] + "\n"}
    assert [s["segment_type"] for s in json.loads(out[1].segments)] == ["heading", "paragraph"] and json.loads(out[2].segments) == []


def test_progress_and_playback(spark):
    windows = spark.createDataFrame([(1, 0, 2, 0, 100_000), (2, 0, 3, 250_000, 1_000_000)], "start int, page int, tokens long, a long, b long")
    rows = live.running(windows.select("start", "page", "tokens", F.timestamp_micros("a").alias("first"), F.timestamp_micros("b").alias("last"))).orderBy("start").collect()
    assert [(r.tokens, r.tokens_per_second) for r in rows] == [(2, 20.0), (5, 5.0)]
    some = spark.range(1).select(live.fraction(F.lit(1), F.lit(4), F.lit(5000), F.lit(1024)).alias("a"), live.fraction(F.lit(1), F.lit(4), F.lit(256), F.lit(1024)).alias("b"), live.fraction(F.lit(0), F.lit(0), F.lit(1), F.lit(0)).alias("c")).first()
    assert tuple(some) == (1.95 / 4, 1.25 / 4, 0.0)
    words = spark.createDataFrame([(1, 0, 100, 25_000), (1, 1, 25_000, 25_000), (1, 2, 25_000, None)], "doc_id long, pos long, start_ms long, next_ms long")
    ticks = spark.createDataFrame([(1, i, t) for i, t in enumerate((50, 100, 9_999, 10_000, 24_999, 25_000, 99_000))], "doc_id long, ts long, time_ms long").withColumn("ts", F.timestamp_seconds("ts"))
    played = live.playback(ticks, words)
    assert sorted((r.time_ms, r.pos) for r in played.collect()) == [(100, 0), (9_999, 0), (10_000, 0), (24_999, 0), (25_000, 2), (99_000, 2)]
    assert sorted((r.time_ms, r.pos) for r in live.changes(played).collect()) == [(100, 0), (25_000, 2)]
