"""Legacy web archives to WARC.

An ARC file starts with a version block (``filedesc://``), whose second line names the
version and so the fields of the header line in front of every record; the last field
is the declared length of the record. The converter reads these lines and lengths and
synthesises what WARC asks for: record ids (name-based, so that a rerun gives the same),
dates, types, content types and digests.

Archives are written by Spark's text writer, one record and its end as a "line", so any
file system that Spark reaches will do; they are gzip files of bounded size, each with a
warcinfo record, and read back as streams. Among records with equal payloads of at least
LEAST_REVISIT bytes, the one with the largest id is the response and the others are
revisits of it. Which are equal is found from digests; payloads are never shuffled by them.

Null html counts as an empty payload (a response). Ids are expected to be unique: of
rows with one id and equal payloads, all are written alike. Empty tables give empty
archives and an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.batches import PIECE_BYTES, pieces
from lectern.llm.common import materialise
from lectern.sources.folders import shared_folder

#: Payload bytes from which on equal records are revisits; bytes of an archive before compression, unless one record has more.
LEAST_REVISIT, ARCHIVE_BYTES = 1000, 32 << 20
#: Up to so many digests (about 150 bytes each) are broadcast; beyond, ids and digests are joined, and payloads by unique id.
BROADCAST_DIGESTS = 200_000
READ_ROWS = 2000
#: The header fields of the two versions of the ARC format.
ARC_FIELDS = {
    "1": ("url", "ip", "date", "type", "length"),
    "2": ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "filename", "length"),
}
HTTP_END = re.compile(rb"\r?\n\r?\n")
ID_HEADER = re.compile(rb"(?im)^X-Record-Number: (-?\d+)\r?$")


def arc_record(version: str, fields: dict[str, str], body: bytes) -> bytes:
    values = {k: "-" for k in ARC_FIELDS[version]} | fields | {"length": str(len(body))}
    return " ".join(values[k] for k in ARC_FIELDS[version]).encode("utf-8") + b"\n" + body + b"\n"


def arc_file(version: str, name: str, date: str, records: list[tuple[dict, bytes]]) -> bytes:
    """A version block and the records."""
    names = {"1": "URL IP-address Archive-date Content-type Archive-length", "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
    block = f"{version} 0 lectern\n{names[version]}\n".encode()
    # the version block's own header has the fields of version 1 in both versions but for the length's place
    head = arc_record(version, {"url": f"filedesc://{name}", "ip": "0.0.0.0", "date": date, "type": "text/plain", "status": "200", "offset": "0", "filename": name}, block)
    return head + b"".join(arc_record(version, f, b) for f, b in records)


def read_arc(data: bytes):
    """Yields (fields, body) of every record, the version block first; tolerates blank lines between records."""
    at, fields = 0, None
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.index(b"\n", at)
        values = data[at:end].decode("utf-8").split(" ")
        length = int(values[-1])
        body = data[end + 1 : end + 1 + length]
        if len(body) < length:
            raise ValueError("the archive ends within a record")
        if fields is None:
            fields = ARC_FIELDS[body.split(b" ", 1)[0].decode()]
        if len(values) > len(fields):  # a space within the URL
            values = [" ".join(values[: len(values) - len(fields) + 1]), *values[len(values) - len(fields) + 1 :]]
        yield dict(zip(fields, values, strict=False)), body
        at = end + 1 + length


def warc_date(stamp: str) -> str:
    """14 digits (fewer: padded with the earliest) to an ISO date."""
    s = (re.sub(r"\D", "", stamp) + "00000101000000"[len(re.sub(r"\D", "", stamp)) :])[:14]
    return f"{s[:4]}-{s[4:6]}-{s[6:8]}T{s[8:10]}:{s[10:12]}:{s[12:14]}Z"


def sha1_base32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(parts))}>"


def convert(fields: dict[str, str], body: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(WARC headers without lengths, HTTP head, payload) of an ARC record."""
    url, kind = fields["url"], fields.get("type", "-")
    common = {"WARC-Target-URI": url, "WARC-Date": warc_date(fields["date"]), "WARC-IP-Address": fields.get("ip", "-")}
    if url.startswith("filedesc:"):
        return common | {"WARC-Type": "warcinfo", "Content-Type": "application/warc-fields", "WARC-Filename": url[11:]}, b"", body
    if url.startswith(("http:", "https:")) and body[:5] == b"HTTP/":
        end = HTTP_END.search(body)
        head, payload = (body[: end.end()], body[end.end() :]) if end else (body, b"")
        return common | {"WARC-Type": "response", "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": sha1_base32(payload)}, head, payload
    return common | {"WARC-Type": "resource", "Content-Type": kind if "/" in kind else "application/octet-stream"}, b"", body


def warc_record(headers: dict[str, str], block: bytes) -> bytes:
    """A whole record, with its block digest, its length, and the two ends of line after it."""
    full = headers | {"WARC-Block-Digest": sha1_base32(block), "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in full.items() if v != "-").encode("utf-8") + b"\r\n" + block + b"\r\n\r\n"


def read_warc(stream: io.BufferedIOBase):
    """Yields (headers, block) by declared lengths."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.partition(b":")
            headers[name.decode().strip()] = value.decode("utf-8").strip()
        yield headers, stream.read(int(headers["Content-Length"]))


def target(url: str | None) -> str:
    """A URL as it stands in a header line."""
    bare = re.sub(r"\s", "%20", url or "")
    return bare if bare.startswith(("http:", "https:")) else f"http://unknown.invalid/{bare}"


def legacy_date(page: int | None) -> str:
    return f"2010{1 + (page or 0) % 12:02d}15120000"


def converted(ids: list, urls: list, htmls: list):
    """(place, page_id, url, date, HTTP head, payload) of pages, by way of a legacy archive in memory (both versions in turn)."""
    for version in ("1", "2"):
        places = [i for i, page in enumerate(ids) if (page or 0) % 2 == int(version) - 1]
        records = []
        for i in places:
            number = b"" if ids[i] is None else b"X-Record-Number: %d\r\n" % ids[i]
            head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + number + b"\r\n"
            fields = {"url": target(urls[i]), "ip": "0.0.0.0", "date": legacy_date(ids[i]), "type": "text/html", "status": "200"}
            records.append((fields, head + (htmls[i] or "").encode("utf-8")))
        found = read_arc(arc_file(version, f"legacy-{version}.arc", "20100101000000", records))
        next(found)  # the version block
        for i, (fields, body) in zip(places, found, strict=True):
            headers, head, payload = convert(fields, body)
            number = ID_HEADER.search(head)
            yield i, int(number[1]) if number else None, headers["WARC-Target-URI"], headers["WARC-Date"], head, payload


def page_record(page: int | None, url: str, date: str, head: bytes, payload: bytes, kept: int | None, kept_url: str | None) -> bytes:
    """A response, or a revisit of the page ``kept``; the latter holds no payload."""
    headers = {
        "WARC-Type": "response", "WARC-Record-ID": record_id(url, date, str(page)), "WARC-Target-URI": url, "WARC-Date": date,
        "WARC-Payload-Digest": sha1_base32(payload), "Content-Type": "application/http; msgtype=response",
        "X-Payload-Length": str(len(payload)), "X-Record-Number": "-" if page is None else str(page),
    }
    if kept is None:
        return warc_record(headers, head + payload)
    first, first_date = target(kept_url), warc_date(legacy_date(kept))
    headers |= {
        "WARC-Type": "revisit", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(first, first_date, str(kept)),
        "WARC-Refers-To-Target-URI": first, "WARC-Refers-To-Date": first_date, "X-Refers-To-Number": str(kept),
    }
    return warc_record(headers, head)


def info_record(name: str) -> bytes:
    fields = b"software: lectern\r\nformat: WARC File Format 1.1\r\n"
    return warc_record({"WARC-Type": "warcinfo", "WARC-Record-ID": record_id(name), "WARC-Date": "2010-01-01T00:00:00Z", "WARC-Filename": name, "Content-Type": "application/warc-fields"}, fields)


def _archives(limit: int, batches):
    """Records as text with the number of their archive: the next one starts when it would grow beyond limit bytes."""
    context = TaskContext.get()
    number, size, rows, held = (context.partitionId() if context else 0) << 32, limit, [], 0

    def out():
        return pa.RecordBatch.from_pydict({"archive": [n for n, _ in rows], "value": [v for _, v in rows]}, schema=pa.schema([("archive", pa.int64()), ("value", pa.string())]))

    for batch in (piece for batch in batches for piece in pieces(batch)):
        ids, urls, htmls, kept, kept_urls = (c.to_pylist() for c in batch.columns)
        for i, *parts in converted(ids, urls, htmls):
            record = page_record(*parts, kept[i], kept_urls[i])
            if size + len(record) > limit:
                number, size = number + 1, 0
                rows.append((number, info_record(f"lectern-{number}.warc.gz")[:-1].decode("utf-8")))
            size, held = size + len(record), held + len(record)
            rows.append((number, record[:-1].decode("utf-8")))  # the writer adds the last end of line
            if held > PIECE_BYTES:
                yield out()
                rows, held = [], 0
    if rows:
        yield out()


def with_originals(pages: DataFrame) -> DataFrame:
    """page_id, url, html, kept, kept_url: for a revisit, the id and address of the page it repeats."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    digest, size = F.sha1(F.coalesce("html", F.lit(""))), F.octet_length(F.coalesce("html", F.lit("")))
    long = pages.filter(size >= LEAST_REVISIT).select("page_id", "url", digest.alias("digest"))
    alike = long.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    alike = materialise(alike.select("digest", F.col("first.page_id").alias("kept"), F.col("first.url").alias("kept_url")), "alike")
    if alike.count() <= BROADCAST_DIGESTS:
        named = alike.withColumnRenamed("digest", "same")
        found = pages.join(F.broadcast(named), (F.when(size >= LEAST_REVISIT, digest) == F.col("same")) & (F.col("page_id") != F.col("kept")), "left").drop("same")
    else:
        found = pages.join(long.join(alike, "digest").filter("page_id <> kept").select("page_id", "kept", "kept_url").distinct(), "page_id", "left")
    return found.select("page_id", "url", "html", "kept", "kept_url")


def write_archives(pages: DataFrame, path: str, limit: int = ARCHIVE_BYTES) -> None:
    """WARC files below path, a folder for each, of pages(page_id, url, html); revisits hold no payload."""
    records = with_originals(pages).mapInArrow(partial(_archives, limit), "archive long, value string")
    records.write.partitionBy("archive").option("compression", "gzip").option("lineSep", "\n").text(path)


def _read(batches):
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    schema = pa.schema(list(zip(names, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)))
    rows: list[tuple] = []

    def out():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    for batch in batches:
        for data in batch.column(0):
            for headers, block in read_warc(gzip.GzipFile(fileobj=io.BytesIO(data.as_buffer()))):
                kind = headers["WARC-Type"]
                if kind == "warcinfo":
                    continue
                length, digest = int(headers["X-Payload-Length"]), base64.b32decode(headers["WARC-Payload-Digest"][5:]).hex()
                if kind == "response":
                    payload = block[HTTP_END.search(block).end() :]
                    if (length, digest) != (len(payload), hashlib.sha1(payload).hexdigest()):
                        raise ValueError(f"{headers['WARC-Record-ID']}: the payload doesn't match its digest")
                number, refers = headers.get("X-Record-Number"), headers.get("X-Refers-To-Number")
                rows.append((None if number is None else int(number), length, digest, kind, None if refers is None else int(refers)))
                if len(rows) >= READ_ROWS:
                    yield out()
                    rows = []
    if rows:
        yield out()


def read_archives(spark, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page's record; payloads are checked against their digests."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    path = shared_folder(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)
