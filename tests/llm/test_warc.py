import glob
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from lectern.llm import warc
from lectern.llm.common import table
from lectern.sources.folders import shared_folder


def expected(rows):
    """page_id to (bytes, digest, type, refers_to), plainly."""
    raw = {i: (h or "").encode() for i, _, h in rows}
    last = {}
    for i, data in raw.items():
        if len(data) >= 1000:
            last[data] = max(i, last.get(data, i))
    return {i: (len(d), hashlib.sha1(d).hexdigest(), "revisit" if last.get(d, i) != i else "response", last[d] if last.get(d, i) != i else None) for i, d in raw.items()}


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def made_up():
    common, other = "é<p>\n" * 300, "\U0001f600\r\n\r\nWARC/1.1\r\n" * 90
    rows = [(i, f"http://x/{i} y", common) for i in range(40)] + [(i, None, other) for i in range(100, 110)]
    return rows + [(i, "ftp://z", "short") for i in range(200, 260)] + [(300, "", None), (301, "http://a", ""), (302, "http://a", "x" * 999), (303, "http://a", "x" * 999), (304, "u", "x" * 1000)]


def result(df):
    return {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()}


@pytest.mark.parametrize("broadcast", [0, warc.BROADCAST_DIGESTS])
def test_round_trip_equals_the_plain_rule(spark, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", broadcast)
    rows = made_up()
    pages = pages_of(spark, rows).withColumn("kept", F.lit(1)).withColumn("digest", F.lit("x")).repartition(5)
    assert result(warc.archive_round_trip(pages)) == expected(rows)


def test_archives_are_bounded_and_well_formed(spark):
    rows, path = made_up(), shared_folder(spark, "test-warc")
    warc.write_archives(pages_of(spark, rows).repartition(3), path, limit=20_000)
    files = glob.glob(f"{path}/*/*.gz")
    assert len(files) > 3
    ids, refers, seen = {}, [], []
    for name in files:
        data = gzip.open(name).read()
        records = list(warc.read_warc(gzip.open(name)))
        assert [h["WARC-Type"] for h, _ in records].count("warcinfo") == 1 and len(data) < 20_000 + 2000
        for headers, block in records:
            assert int(headers["Content-Length"]) == len(block) and headers["WARC-Block-Digest"] == warc.sha1_base32(block)
            assert headers["WARC-Record-ID"].startswith("<urn:uuid:") and headers["WARC-Date"].endswith("Z")
            if headers["WARC-Type"] != "warcinfo":
                seen.append(int(headers["X-Record-Number"]))
                ids[headers["WARC-Record-ID"]] = (headers["WARC-Target-URI"], headers["WARC-Date"], headers["WARC-Type"])
            if headers["WARC-Type"] == "revisit":
                refers.append((headers["WARC-Refers-To"], headers["WARC-Refers-To-Target-URI"], headers["WARC-Refers-To-Date"]))
                assert headers["WARC-Profile"].endswith("identical-payload-digest") and b"<p>" not in block
    assert sorted(seen) == sorted(i for i, *_ in rows) and len(refers) == 48
    assert all(ids[i] == (uri, date, "response") for i, uri, date in refers)


def test_repeated_ids_and_nothing(spark):
    rows = [(1, "a", "y" * 2000), (1, "a", "y" * 2000), (2, "b", "y" * 2000), (None, "c", "y" * 2000), (None, "c", None)]
    out = sorted(((r.page_id or 0), r.record_type, r.refers_to) for r in warc.archive_round_trip(pages_of(spark, rows)).collect())
    assert out == [(0, "response", None), (0, "response", None), (1, "revisit", 2), (1, "revisit", 2), (2, "response", None)]
    assert warc.archive_round_trip(pages_of(spark, rows).limit(0)).collect() == []


def test_the_given_pages(spark):
    pages = table(spark, "/root/testdata/sf0.001", "pages")
    assert result(warc.archive_round_trip(pages)) == expected([(r.page_id, r.url, r.html) for r in pages.collect()])
