"""WARC archives: writing with segments and revisits, reading with reassembly.

Writing: every page is an HTTP response in chunked framing.  Of pages with
equal payloads of at least ``MIN_REVISIT`` bytes the smallest page_id is a
response and the others are revisit records (identical-payload-digest) without
a body.  A block longer than ``segment`` bytes is cut: the first piece stays in
the response, the rest goes to continuation records that name the first
record (WARC-Segment-Origin-ID), are numbered and, the last, give the total.
Cuts fall between characters, so a record is text and Spark's own writer makes
the files; a file holds at most ``RECORDS`` records, so it has a size bound.

Reading: records are parsed by their Content-Length.  Those in one piece are
decoded at once; the others are grouped by origin, ordered by number, checked
(numbers 1..n, total length) and joined.  The chunks are decoded and the
payload's digest is compared with the record's.  After a damaged record
reading resumes at the next line that begins with ``WARC/``, so the other
records of the file stay; a group that lacks a segment, the first one too, is
one incomplete row under its origin's name.

Edge cases: null html is an empty payload; a null url is written as an empty
target; a null page_id is written as absent and read as null, such a row is a
revisit if a page with an id has its payload; rows with the smallest page_id
of a group are all responses if that id is repeated; an incomplete or damaged
record is returned with a null payload and complete = false; an empty table
gives no records; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from defectlens.llm.common import in_arrow, staged
from defectlens.session import scratch_path

MIN_REVISIT = 100
SEGMENT = 32_768
CHUNK = 8_192
RECORDS = 1000
#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
END = "\r\n\r\n"
RECORD_SCHEMA = ("record_id string, page_id bigint, record_type string, refers_to bigint, digest string, "
                 "length bigint, payload binary, complete boolean")
PART_SCHEMA = RECORD_SCHEMA.replace("payload binary, complete boolean", "origin string, number int, total bigint, block binary")


def cuts(data: bytes, size: int) -> list[bytes]:
    """Pieces of about ``size`` bytes that end between characters."""
    out, a = [], 0
    while a < len(data):
        z = min(a + size, len(data))
        while z < len(data) and data[z] & 0xC0 == 0x80:
            z += 1
        out.append(data[a:z])
        a = z
    return out


def framed(body: bytes) -> bytes:
    """Chunked transfer framing."""
    return b"".join(b"%x\r\n%s\r\n" % (len(c), c) for c in cuts(body, CHUNK)) + b"0\r\n\r\n"


def unframed(data: bytes) -> bytes | None:
    """The body of a chunked message; None if the framing is damaged."""
    out, at = [], 0
    while True:
        line = data.find(b"\r\n", at)
        if line < 0:
            return None
        try:
            size = int(data[at:line].split(b";")[0], 16)
        except ValueError:
            return None
        at = line + 2
        if size == 0:
            return b"".join(out)
        if data[at + size:at + size + 2] != b"\r\n":
            return None
        out.append(data[at:at + size])
        at += size + 2


def _record(fields: list[tuple[str, str | None]], block: bytes) -> str:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))] if v is not None)
    return f"{VERSION}\r\n{head}\r\n" + block.decode()


def _target(url: str | None) -> str:
    return "".join(c if c.isprintable() else f"%{ord(c) & 0xFF:02X}" for c in url or "")


def records_of(page_id, url, body: bytes, first_id, first_url, unique: str, segment: int) -> list[str]:
    """The WARC records of one page, without the blank lines after them."""
    digest = hashlib.sha256(body).hexdigest()
    name = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{digest}|{unique}')}>"
    common = [("WARC-Record-ID", name), ("WARC-Date", DATE), ("WARC-Target-URI", _target(url)),
              ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Page-ID", None if page_id is None else str(page_id)),
              ("X-Payload-Length", str(len(body))), ("Content-Type", "application/http;msgtype=response")]
    status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if first_id is not None:
        return [_record([("WARC-Type", "revisit"), ("WARC-Profile", PROFILE), ("WARC-Refers-To-Target-URI", _target(first_url)),
                         ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page", str(first_id)), *common], status + b"\r\n")]
    block = status + b"Transfer-Encoding: chunked\r\n\r\n" + framed(body)
    pieces = cuts(block, segment)
    if len(pieces) == 1:
        return [_record([("WARC-Type", "response"), *common], block)]
    out = [_record([("WARC-Type", "response"), *common, ("WARC-Segment-Number", "1")], pieces[0])]
    for k, piece in enumerate(pieces[1:], 2):
        own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}|{k}')}>"
        out.append(_record([("WARC-Type", "continuation"), ("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", _target(url)),
                            ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(k)),
                            ("WARC-Segment-Total-Length", str(len(block)) if k == len(pieces) else None)], piece))
    return out


def with_firsts(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """``pages`` with first_id and first_url where an equal payload has a smaller page_id."""
    page = F.col("page_id").cast("long").alias("page_id")
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    known = pages.select(page, "url", body.alias("html"))
    digest = F.unhex(F.sha2(F.encode("html", "UTF-8"), 256))
    firsts = (known.filter((F.octet_length("html") >= min_bytes) & F.col("page_id").isNotNull())
              .select(digest.alias("digest"), F.struct("page_id", "url").alias("f"))
              .groupBy("digest").agg(F.min("f").alias("f"), F.count("*").alias("n")))
    if not known.filter("page_id IS NULL").select("page_id").take(1):
        firsts = firsts.filter("n > 1")  # a payload that occurs once matters only to pages without an id
    firsts = firsts.select("digest", F.col("f.page_id").alias("first_id"), F.col("f.url").alias("first_url"))
    firsts = staged(firsts, "warc-firsts")
    later = F.col("page_id").isNull() | (F.col("page_id") > F.col("first_id"))
    return (known.withColumn("digest", digest).join(firsts, "digest", "left").drop("digest")
            .withColumn("first_id", F.when(later, F.col("first_id"))))


def write_warc(pages: DataFrame, path: str, segment: int = SEGMENT, min_bytes: int = MIN_REVISIT) -> None:
    """Archive files below ``path``; every record ends with a blank line."""

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, i = TaskContext.get().partitionId(), 0
        for b in batches:
            out: list[str] = []
            for r in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "first_id", "first_url"))):
                out += records_of(r[0], r[1], r[2].encode(), r[3], r[4], f"{part}-{i}", segment)
                i += 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    (in_arrow(with_firsts(pages, min_bytes), render, "value string")
     .write.option("lineSep", END).option("maxRecordsPerFile", RECORDS).text(path))


def _fields(head: bytes) -> dict[str, str]:
    """Header fields, names in lower case."""
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.decode("utf-8", "replace").partition(":")
        fields[k.strip().lower()] = v.strip()
    return fields


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Header fields (names in lower case) and block of each record.

    A record is whole if its block of Content-Length bytes is followed by the
    blank lines and then by the next record or the end of the file.  Otherwise
    its block is None and reading resumes at the next line that begins with
    ``WARC/``; bytes that belong to no record come as one record without fields.
    """
    at = 0
    while at < len(data):
        following = data.find(b"\nWARC/", at)
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0 or 0 <= following < end:  # no record, or a header cut short
            stop = following + 1 if following >= 0 else len(data)
            yield _fields(data[at:stop]) if data.startswith(b"WARC/", at) else {}, None
            at = stop
            continue
        fields = _fields(data[at:end])
        size = _number(fields.get("content-length"))
        stop = -1 if size is None else end + 4 + size
        after = stop + len(END)
        if end + 4 <= stop and data.startswith(END.encode(), stop) and (after == len(data) or data.startswith(b"WARC/", after)):
            yield fields, data[end + 4:stop]
            at = after
        else:
            yield fields, None
            following = data.find(b"\nWARC/", end)
            at = following + 1 if following >= 0 else len(data)


def _payload(block: bytes | None) -> bytes | None:
    """The decoded body of an HTTP response."""
    if block is None:
        return None
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return None
    return unframed(body) if b"transfer-encoding: chunked" in head.lower() else body


def _number(text: str | None) -> int | None:
    """A whole number of 64 bits; None for anything else."""
    return int(text) if text is not None and re.fullmatch("-?[0-9]{1,18}", text) else None


def _segment_number(text: str | None) -> int | None:
    n = _number(text)
    return n if n is not None and 0 < n < 1 << 31 else None


def read_warc(spark, path: str) -> DataFrame:
    """Every response and revisit of the archives, payloads reassembled and decoded."""
    files = spark.read.format("binaryFile").load(path).select("content")
    part_type = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                           ("digest", pa.string()), ("length", pa.int64()), ("origin", pa.string()), ("number", pa.int32()),
                           ("total", pa.int64()), ("block", pa.binary())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                rows = []
                for f, block in parse_records(content.as_buffer().to_pybytes()):
                    rows.append({
                        "record_id": f.get("warc-record-id"), "page_id": _number(f.get("x-page-id")), "record_type": f.get("warc-type"),
                        "refers_to": _number(f.get("x-refers-to-page")), "digest": f.get("warc-payload-digest", "").removeprefix("sha256:"),
                        "length": _number(f.get("x-payload-length")), "origin": f.get("warc-segment-origin-id"),
                        "number": _segment_number(f.get("warc-segment-number")), "total": _number(f.get("warc-segment-total-length")), "block": block})
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_pylist(rows, part_type)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, part_type)

    parts = in_arrow(files, parse, PART_SCHEMA)
    columns = ["record_id", "page_id", "record_type", "refers_to", "digest", "length"]
    key = F.coalesce("origin", "record_id")
    whole = parts.filter(F.col("number").isNull() | key.isNull()).select(*columns, "block")
    # one group is one page, which was one row before
    piece = F.struct("number", "total", "block", *columns)
    group = (parts.filter(F.col("number").isNotNull() & key.isNotNull()).groupBy(key.alias("key"))
             .agg(F.array_sort(F.collect_list(piece)).alias("s")))
    total = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(F.octet_length(x["block"]), F.lit(0)))
    first, last = F.get("s", F.lit(0)), F.element_at("s", -1)
    numbered = F.forall(F.transform("s", lambda x, i: x["number"] == i + 1), lambda x: x)
    sound = numbered & F.forall("s", lambda x: x["block"].isNotNull()) & (last["total"] == total) & (first["record_id"] == F.col("key"))
    joined = F.aggregate("s", F.lit(b""), lambda a, x: F.concat(a, F.coalesce(x["block"], F.lit(b""))))
    # a group without its first segment keeps the origin's name; what only the first segment tells is null
    rejoined = group.select(F.col("key").alias("record_id"), *[first[c].alias(c) for c in columns[1:]], F.when(sound, joined).alias("block"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            payloads, good = [], []
            for kind, digest, block in zip(*(b.column(c).to_pylist() for c in ("record_type", "digest", "block"))):
                body = _payload(block) if kind == "response" else None
                ok = kind == "revisit" and block is not None or body is not None and hashlib.sha256(body).hexdigest() == digest
                payloads.append(body if ok else None)
                good.append(ok)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], pa.array(payloads, pa.binary()), pa.array(good, pa.bool_())],
                                             [*columns, "payload", "complete"])

    return in_arrow(whole.unionByName(rejoined), decode, RECORD_SCHEMA)


def warc_report(pages: DataFrame) -> DataFrame:
    """Write the pages, read the archives back, and describe every page; raises if a page is damaged or lost."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_warc(pages, path)
    r = read_warc(spark, path)
    sound = F.when(F.col("complete"), F.col("record_type")).otherwise(F.raise_error(F.concat(F.lit("damaged record "), "record_id")))
    body = F.when(F.col("record_type") == "response", F.octet_length("payload").cast("long")).otherwise(F.col("length"))
    digest = F.when(F.col("record_type") == "response", F.sha2("payload", 256)).otherwise(F.col("digest"))
    out = staged(r.select("page_id", body.alias("payload_bytes"), digest.alias("payload_digest"), sound.alias("record_type"), "refers_to"),
                 "warc-report")
    n, wanted = out.count(), pages.count()
    if n != wanted:
        raise ValueError(f"{n} records of {wanted} pages read back")
    return out


ORACLE = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS h FROM pages
), f AS (
  SELECT h, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY h
)
SELECT page_id, n::BIGINT AS payload_bytes, p.h AS payload_digest,
  CASE WHEN page_id IS NULL AND first IS NOT NULL OR page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS NULL AND first IS NOT NULL OR page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.h = f.h
"""
