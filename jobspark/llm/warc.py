"""WARC archives: written through Spark, read back record by record.

One gzip member holds one record. Tasks make the members; Spark's text writer lays them end
to end, with an empty gzip member as line separator, so files are committed as any other
Spark output (a lost executor leaves none) and stay valid multi-member gzip on any storage.
The reader gets whole files of bounded size from Spark's binary reader and goes through each
in order: zlib is fed in slices and one record at a time is held, framed by its
``Content-Length``, and its digests are computed anew.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common

LEAST_PAYLOAD = 100  # smaller payloads are always stored
RECORDS_PER_FILE = 2000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP = 16 + zlib.MAX_WBITS
LEVEL = 6
SLICE = 1 << 16


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
    return packer.compress(data) + packer.flush()


SEPARATOR = member(b"").decode("latin-1")


class Record(NamedTuple):
    record_id: str
    record_type: str
    uri: str | None
    refers_to: str | None
    payload: bytes | None  # None: of a revisit, which stores none
    payload_bytes: int
    payload_digest: str
    verified: bool


def record(page_id: int | None, url: str | None, payload: bytes, digest: str,
           refers_to: int | None) -> bytes:
    """One record. A revisit has the HTTP head of its page but not the body."""
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            b"Content-Length: %d\r\n\r\n" % len(payload))
    block = http if refers_to is not None else http + payload
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", DATE),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]")))
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    head += [
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block))),
    ]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return text.encode() + block + b"\r\n\r\n"


def members(archive: bytes) -> Iterator[bytes]:
    """The unpacked members that are not empty, one after the other."""
    view, at, parts = memoryview(archive), 0, []
    unpacker = zlib.decompressobj(GZIP)
    fresh = True
    while at < len(view):
        some = view[at:at + SLICE]
        parts.append(unpacker.decompress(some))
        at += len(some) - len(unpacker.unused_data)
        fresh = False
        if unpacker.eof:
            whole, parts = b"".join(parts), []
            if whole:
                yield whole
            unpacker, fresh = zlib.decompressobj(GZIP), True
    if not fresh:
        raise ValueError("the archive ends inside a member")


def parse(data: bytes) -> Record:
    """A record from its unpacked member. Raises ``ValueError`` on wrong framing."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("the record is not as long as its Content-Length says")
    block = rest[:size]
    http, _, body = block.partition(b"\r\n\r\n")
    told = fields["warc-payload-digest"].partition(":")[2]
    verified = fields["warc-block-digest"] == f"sha256:{hashlib.sha256(block).hexdigest()}"
    kind = fields["warc-type"]
    length = re.search(rb"(?im)^Content-Length:\s*(\d+)", http)
    n_bytes = int(length[1]) if length else len(body)
    if kind == "response":
        verified &= hashlib.sha256(body).hexdigest() == told and n_bytes == len(body)
    return Record(fields["warc-record-id"][1:-1], kind, fields.get("warc-target-uri"),
                  fields.get("warc-refers-to", "")[1:-1] or None,
                  body if kind == "response" else None, n_bytes, told, verified)


def mark(pages: DataFrame) -> DataFrame:
    """``(page_id, url, html, digest, refers_to)``: the smallest page id with an equal
    payload of at least 100 bytes, where that is another one.

    Only digests that occur more than once are joined back. Their table is written first,
    so that its true size decides whether Spark broadcasts it.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), body.alias("html"),
                        F.unhex(F.sha2(F.encode(body, "utf-8"), 256)).alias("digest"))
    large = rows.filter(F.octet_length("html") >= LEAST_PAYLOAD)
    again = large.groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    path = common.shared_dir(pages.sparkSession, "repeated")
    again.write.parquet(path)
    repeated = pages.sparkSession.read.schema(again.schema).parquet(path)
    return rows.join(repeated, "digest", "left").select(
        "page_id", "url", "html", F.lower(F.hex("digest")).alias("digest"),
        F.when(F.col("first") != F.coalesce("page_id", F.lit(-1)), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """One record per row of ``pages`` (page_id, url, html), in gzip files below ``path``.

    NULL html is an empty payload, a NULL url leaves its field out, a NULL page id refers to
    the response if there is one. Rows with the smallest page id of a payload are all
    responses, also if that id is repeated. Other columns are ignored. An empty table writes
    an empty folder.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page_id, url, digest, refers_to = (
                batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            html = batch.column(2).cast(pa.binary())
            made = [member(record(p, u, html[i].as_py(), d, r))
                    for i, (p, u, d, r) in enumerate(zip(page_id, url, digest, refers_to))]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["member"])

    marked = mark(pages.select("page_id", "url", "html"))
    marked.mapInArrow(run, "member binary").select(F.col("member").cast("string").alias("value")).write.option(
        "lineSep", SEPARATOR).option("encoding", "ISO-8859-1").option(
        "maxRecordsPerFile", records_per_file).text(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record: record_id, record_type, uri, refers_to, payload (NULL for a
    revisit, or if ``payloads`` is False), payload_bytes, payload_digest, verified."""
    names = list(Record._fields)
    kinds = [pa.string()] * 4 + [pa.binary(), pa.int64(), pa.string(), pa.bool_()]

    def table(rows: list[Record]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0):
                rows: list[Record] = []
                size = 0
                for data in members(archive.as_buffer().to_pybytes()):
                    one = parse(data)
                    rows.append(one if payloads else one._replace(payload=None))
                    size += len(data) if payloads else 500
                    if size > 1 << 23:
                        yield table(rows)
                        rows, size = [], 0
                yield table(rows)

    # "path" keeps the folder's own listing; empty files hold no record.
    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("content")
    return files.mapInArrow(
        run, "record_id string, record_type string, uri string, refers_to string, "
             "payload binary, payload_bytes bigint, payload_digest string, verified boolean")


def page_number(field: str) -> Column:
    """The page id in ``urn:page:…``; NULL for a page that had none."""
    return F.expr(f"try_cast(substring({field}, 10) as bigint)")


def archive(pages: DataFrame, path: str) -> DataFrame:
    """Writes the pages below ``path`` and reads them back: one row per page."""
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path, payloads=False).select(
        page_number("record_id").alias("page_id"), "payload_bytes", "payload_digest",
        "record_type", page_number("refers_to").alias("refers_to"), "verified")
