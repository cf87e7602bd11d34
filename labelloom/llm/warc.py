"""WARC archives: write captures as records, read records back, assemble transactions.

Writing makes a request, a response or revisit, and a metadata record per page; request and metadata name
the main record in WARC-Concurrent-To. Files are WARC/1.1 records one after another, compressed as a
whole by Spark's text writer (a record is a row, the line separator the end of a record). Reading takes
whole files of any origin (plain, or gzip with one or many members), finds records by Content-Length,
never by their looks, and holds one file at a time.

Assembly joins request, response and metadata records through the concurrent-to identifiers and gives one
nested row per capture. Satellites are reduced to one per kind and main record before the join (the
smallest record id), with their number beside it, so that an identifier named by millions of records
stays one row; ``leftovers`` returns the others and those whose main record isn't there.

Defined cases: null html is an empty payload; null page ids are written as ``-`` and read back as null, and are
never the response of others unless all are null; equal rows stay as many captures; a null url is left
out; CR and LF in a url are percent-encoded; an empty table writes no record and reads as an empty table.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.session import ensure_checkpoint_dir, materialise

#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"
END = "\r\n\r\n"

LEAST_BYTES = 100
DATE = "2000-01-01T00:00:00Z"
RECORDS_PER_FILE = 60_000
RECORD = (
    "record_id string, warc_type string, target_uri string, concurrent_to string, refers_to string, block string, "
    "payload_bytes long, payload_digest string, payload binary, header_bytes long, header_digest string"
)


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{CRLF}{name}: "), v)).otherwise("") for name, v in headers]
    size = F.octet_length(block).cast("string")
    return F.concat(F.lit(VERSION), *lines, F.lit(f"{CRLF}Content-Length: "), size, F.lit(END), block)


def with_revisits(pages: DataFrame, *, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, bytes, first): ``first`` is the page whose response holds the same payload."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    groups = rows.filter(F.col("bytes") >= least_bytes).groupBy("digest", "bytes")
    shared = materialise(groups.agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    joined = rows.join(shared, ["digest", "bytes"], "left")
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.withColumn("first", F.when(other, F.col("first")))


def write_archives(pages: DataFrame, path: str | None = None, *, least_bytes: int = LEAST_BYTES, date: str = DATE) -> str:
    """Writes three records per page and returns the folder (a new one in the shared folder unless given)."""
    path = path or f"{ensure_checkpoint_dir(pages.sparkSession).rstrip('/')}/labelloom-warc-{uuid.uuid4().hex}"
    rows = with_revisits(pages, least_bytes=least_bytes)
    shown = F.coalesce(F.col("page_id").cast("string"), F.lit("-"))
    main = _urn(F.lit("main"), shown, F.col("digest"))
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    stamp, revisit = F.lit(date), F.col("first").isNotNull()
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=UTF-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(END)
    )
    response = _record(
        [
            ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            ("WARC-Record-ID", main),
            ("WARC-Date", stamp),
            ("WARC-Target-URI", uri),
            ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
            ("WARC-Profile", F.when(revisit, PROFILE)),
            ("WARC-Refers-To", F.when(revisit, _urn(F.lit("main"), F.col("first").cast("string"), F.col("digest")))),
            ("Content-Type", F.lit("application/http;msgtype=response")),
        ],
        F.concat(http, F.when(revisit, "").otherwise(F.col("payload"))),
    )
    satellite = [("WARC-Date", stamp), ("WARC-Target-URI", uri), ("WARC-Concurrent-To", main)]
    request = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", _urn(F.lit("request"), shown, F.col("digest"))), *satellite,
         ("Content-Type", F.lit("application/http;msgtype=request"))],
        F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(f" HTTP/1.1{END}")),
    )
    metadata = _record(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _urn(F.lit("metadata"), shown, F.col("digest"))), *satellite,
         ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("page-id: "), shown, F.lit(CRLF)),
    )
    records = rows.select(F.explode(F.array(request, response, metadata)).alias("value"))
    records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)
    return path


def inflated(content: bytes, piece: int = 1 << 20) -> Iterator[bytes]:
    """The plain bytes of a file: as they are, or of all its gzip members."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    view, at, data, member = memoryview(content), 0, b"", zlib.decompressobj(31)
    while data or at < len(view):
        if not data:
            data = bytes(view[at : at + piece])
            at += len(data)
        out = member.decompress(data)
        data = b""
        if out:
            yield out
        if member.eof:
            data, member = member.unused_data, zlib.decompressobj(31)


def parsed(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of a stream; what isn't a record ends it with an error."""
    held, done = bytearray(), False

    def fill(n: int) -> bool:
        nonlocal done
        while len(held) < n and not done:
            chunk = next(chunks, None)
            done = chunk is None
            held.extend(chunk or b"")
        return len(held) >= n

    while True:
        while fill(2) and held[:2] == b"\r\n":
            del held[:2]
        if not fill(1):
            return
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not fill(len(held) + 1):
                raise ValueError("a record's header has no end")
        lines = bytes(held[:end]).decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers["content-length"])
        del held[: end + 4]
        if not fill(size):
            raise ValueError("a record's block is cut short")
        yield headers, bytes(held[:size])
        del held[:size]


def _row(headers: dict[str, str], block: bytes, keep_payload: bool) -> tuple:
    kind, payload, size, text = headers.get("warc-type"), None, None, None
    if kind in ("response", "revisit"):
        head, _, payload = block.partition(b"\r\n\r\n")
        fields = dict(x.lower().partition(b":")[::2] for x in head.split(b"\r\n")[1:])
        size = int(fields[b"content-length"]) if b"content-length" in fields else None
        if kind == "revisit":
            payload = None
    else:
        text = block.decode("utf-8", "replace")
    return (
        headers.get("warc-record-id"), kind, headers.get("warc-target-uri"), headers.get("warc-concurrent-to"), headers.get("warc-refers-to"), text,
        None if payload is None else len(payload), None if payload is None else hashlib.sha256(payload).hexdigest(), payload if keep_payload else None,
        size, (headers.get("warc-payload-digest") or "").removeprefix("sha256:") or None,
    )


def read_archives(spark: SparkSession, path: str, *, payloads: bool = True, batch_bytes: int = 4 << 20) -> DataFrame:
    """One row per record (see RECORD); digests and sizes are those of the payload that was read."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for headers, block in parsed(inflated(content.as_py())):
                    rows.append(_row(headers, block, payloads))
                    size += 500 + (len(block) if payloads else 0)
                    if size >= batch_bytes:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(records, RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: record_id, warc_type, response, request, metadata (structs), n_requests, n_metadata."""
    mains = records.filter(F.col("warc_type").isin("response", "revisit"))
    body = ["target_uri", "refers_to", "payload_bytes", "payload_digest", "payload", "header_bytes", "header_digest"]
    out = mains.select("record_id", "warc_type", F.struct(*body).alias("response"))
    for kind, count in (("request", "n_requests"), ("metadata", "n_metadata")):
        rows = records.filter((F.col("warc_type") == kind) & F.col("concurrent_to").isNotNull())
        one = rows.groupBy(F.col("concurrent_to").alias("record_id")).agg(
            F.min(F.struct("record_id", "target_uri", "block")).alias(kind), F.count(F.lit(1)).alias(count)
        )
        out = out.join(one, "record_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_requests", "n_metadata")})


def leftovers(records: DataFrame) -> DataFrame:
    """Requests and metadata records that no capture shows: orphans, and all but the smallest id of their kind."""
    satellites = records.filter(F.col("warc_type").isin("request", "metadata"))
    mains = records.filter(F.col("warc_type").isin("response", "revisit")).select(F.col("record_id").alias("concurrent_to")).distinct()
    shown = satellites.join(mains, "concurrent_to", "left_semi").groupBy("warc_type", "concurrent_to").agg(F.min("record_id").alias("record_id"))
    return satellites.join(shown.select("record_id", "warc_type"), ["record_id", "warc_type"], "left_anti")


def captures(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), revisits resolved to the response they name."""
    rows = assemble(records).select(
        "record_id", "warc_type", F.col("response.refers_to").alias("target"),
        F.try_to_number(F.regexp_extract("metadata.block", r"(?m)^page-id: (-?\d+)\r?$", 1), F.lit("S9999999999999999999")).cast("long").alias("page_id"),
        F.col("response.payload_bytes").alias("b"), F.col("response.payload_digest").alias("d"),
        F.col("response.header_bytes").alias("hb"), F.col("response.header_digest").alias("hd"),
    )
    rows = materialise(rows)
    responses = rows.filter("warc_type = 'response'").groupBy(F.col("record_id").alias("target"))
    responses = responses.agg(F.min("page_id").alias("refers_to"), F.min("b").alias("tb"), F.min("d").alias("td"))
    return rows.join(responses, "target", "left").select(
        "page_id",
        F.coalesce("b", "tb", "hb").alias("payload_bytes"),
        F.coalesce("d", "td", "hd").alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        "refers_to",
    )


#: What ``pages`` gives after writing and reading back, in DuckDB.
ORACLE = f"""
with p as (select page_id, coalesce(html, '') as html from pages),
q as (select page_id, strlen(html)::BIGINT as b, sha256(html) as d, min(page_id) over (partition by html) as f from p)
select page_id, b as payload_bytes, d as payload_digest, case when b >= {LEAST_BYTES} and f <> page_id then 'revisit' else 'response' end as record_type,
       case when b >= {LEAST_BYTES} and f <> page_id then f end as refers_to
from q
"""
