"""WARC archives without repeated payloads: write with revisit records, read back.

Headers (page_id, url, digest, length) alone are shuffled by payload digest and joined to
the digest's first row, found by a partial aggregate (min page_id). Revisit records are
made of headers only. Payloads go through one aggregate that keeps one of each digest, in
every task before its shuffle too, so a payload that a third of all pages share crosses
the network once a task; the headers of responses then join the payload of their digest.
Spark can split the rows of a hot digest in either join.

Each record is a gzip member of its own, in files written by Spark's own committed writer: a
record is one row, and the row delimiter is an empty gzip member, which unpacks to
nothing. The reader takes each file whole (unpacked they stay below
``FILE_BYTES`` or hold one record) and cuts it by Content-Length, so payloads may hold anything.

Null html is the empty payload. A payload below ``min_revisit_bytes`` is always a
response. The response of a digest is the row with the smallest page_id; null ids
come last. Rows that repeat that page_id with the same payload are responses too.
An empty table gives empty archives and an empty result. Other columns of the input are
ignored, whatever their names. A very long payload is one record.
"""

from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from morphspark.llm import common

FILE_BYTES = 32 << 20
CRLF = "\r\n"
#: A gzip member without content, as a string of its bytes.
EMPTY = "\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
#: Level of the gzip members.
LEVEL = 1
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
#: The profile of revisit records with an identical payload, as the WARC 1.1 standard names it.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, record_id string, warc_date string, payload binary"


def base32_of_hex(digest):
    """Upper-case base32 of a 40-digit hexadecimal column: each 5 hex digits are 4 base32 digits."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    parts = []
    for k in range(8):
        n = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        parts += [F.substring(letters, F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def record_id(digest, page_id):
    """A urn that is the same whenever the job is run again."""
    h = F.md5(F.concat_ws("/", digest, F.coalesce(page_id.cast("string"), F.lit("null"))))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), F.lit(">"))


def resolve(pages: DataFrame, min_revisit_bytes: int = 0) -> tuple[DataFrame, DataFrame]:
    """(headers, payloads): a row a page with sha1, payload_bytes, payload_digest, first_id and revisit; one payload a sha1."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\r\n]", "").alias("url"),
                        F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    firsts = common.apart(rows.groupBy("sha1").agg(F.min("page_id").alias("first_id")), "sha1")
    revisit = (F.col("payload_bytes") >= min_revisit_bytes) & F.coalesce(F.col("page_id") != F.col("first_id"), F.col("first_id").isNotNull())
    headers = rows.join(firsts, "sha1").select("*", base32_of_hex(F.col("sha1")).alias("payload_digest"), revisit.alias("revisit"))
    payloads = pages.select(F.sha1(payload).alias("sha1"), payload.alias("payload")).groupBy("sha1").agg(F.any_value("payload").alias("payload"))
    return headers, payloads


def write(pages: DataFrame, path: str, min_revisit_bytes: int = 0, date: str | None = None) -> None:
    """Write the pages' records as WARC 1.1 files below ``path``."""
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    most = pages.agg(F.max(F.octet_length(F.col("html").cast("binary")))).first()[0] or 0
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    http = F.concat(F.lit(HTTP), F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF))
    length = F.length(http) + F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("payload_bytes"))
    digest = F.col("payload_digest")
    head = F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", record_id(digest, F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(F.col("page_id").isNotNull(), line("WARC-Page-Id", F.col("page_id").cast("string"))).otherwise(F.lit("")),
        F.when(F.col("revisit"), F.concat(
            line("WARC-Profile", F.lit(PROFILE)),
            line("WARC-Refers-To", record_id(digest, F.col("first_id"))),
            line("WARC-Refers-To-Page-Id", F.col("first_id").cast("string")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit(CRLF), http)
    headers, payloads = resolve(pages, min_revisit_bytes)
    headers = headers.select("sha1", "revisit", F.encode(head, "UTF-8").alias("head"))
    revisits = headers.where("revisit").select("head", F.lit(None).cast("binary").alias("payload"))
    responses = headers.where("not revisit").join(common.apart(payloads, "sha1") if min_revisit_bytes else payloads, "sha1").select("head", "payload")
    packed = responses.union(revisits).mapInArrow(common.freed(_members), "member binary")
    some, conf, key = max(1, FILE_BYTES // (most + 2048)), pages.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, str(min(some, 1000, int(before) if int(before) > 0 else 1000)))  # a batch stays below FILE_BYTES, or holds one record
    try:
        (packed.select(F.col("member").cast("string").alias("value")).write  # bytes stay as they are
         .option("lineSep", EMPTY).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", some).text(path))
    finally:
        conf.set(key, before)


def _members(batches):
    """Each record (head, payload) as a gzip member."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part, out = batch.slice(lo, 256), []
            for head, payload in zip(part.column(0), part.column(1)):
                c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                out.append(b"".join([c.compress(head.as_buffer()), c.compress(payload.as_buffer() if payload.is_valid else b""), c.compress(b"\r\n\r\n"), c.flush()]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])


def plain(data: bytes) -> bytes:
    """The records of a file, unpacked if it is gzipped."""
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def parse(data: bytes):
    """Records of a WARC file as dicts; a payload that does not fit its digest is an error."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in data[at:end].decode("utf-8").split(CRLF)[1:])
        size = int(head["Content-Length"])
        block = data[end + 4:end + 4 + size]
        at = end + 4 + size + 4
        http, _, payload = block.partition(b"\r\n\r\n")
        declared = int(http.rsplit(b"Content-Length: ", 1)[1])
        digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
        if kind == "response" and (len(payload) != declared or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
            raise ValueError(f"damaged record {head['WARC-Record-ID']}")
        number = lambda name: int(head[name]) if name in head else None  # noqa: B023, E731
        yield {"page_id": number("WARC-Page-Id"), "url": head["WARC-Target-URI"], "payload_bytes": declared, "payload_digest": digest, "record_type": kind, "refers_to": number("WARC-Refers-To-Page-Id"), "record_id": head["WARC-Record-ID"], "warc_date": head["WARC-Date"], "payload": payload if kind == "response" else None}


def read(spark, path: str, with_payload: bool = True) -> DataFrame:
    """Records of all archives below path (payload is null for revisits)."""
    schema = T._parse_datatype_string(SCHEMA)
    arrow = pa.schema([(f.name, {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.dataType.simpleString()]) for f in schema if with_payload or f.name != "payload"])

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for row in parse(plain(content.as_py())):
                    size += len(row["payload"] or b"") if with_payload else 0
                    rows.append(row)
                    if size > common.CHUNK_BYTES or len(rows) >= 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    out = T.StructType([f for f in schema if with_payload or f.name != "payload"])
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(common.freed(run), out)


def archive(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write the archives to the shared folder and read their headers back."""
    path = common.shared_dir(pages.sparkSession, "warc")
    write(pages, path, min_revisit_bytes)
    return read(pages.sparkSession, path, with_payload=False).drop("record_id", "warc_date")
