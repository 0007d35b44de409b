"""WARC archives: records cut into segments, written and put together again.

A record whose block exceeds the segment size is written as a first record and
``continuation`` records that name its id as their origin, numbered, the last
one with the total length. The block is an HTTP response in chunked transfer
framing. Reading groups continuation records by origin, orders them by number,
checks the total length and decodes the framing.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import staged
from riskloom.session import work_path

#: Bytes of a block that one record holds, of one transfer chunk, and records of one file.
SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4_096
FILE_RECORDS = 1_500
#: Records end in an empty line; Spark's text writer puts it behind each row.
RECORD_END = "\r\n\r\n"
RECORD_FIELDS = ("record_id string, record_type string, page_id string, uri string, refers_to_id string, digest string, "
                 "segment int, origin string, total long, block binary")
_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def frame_chunks(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """``payload`` in chunked transfer framing."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unframe_chunks(body: bytes) -> bytes | None:
    """The payload of chunked transfer framing; None if the framing is broken or cut."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            size = int(body[at:end].partition(b";")[0].strip(), 16)
        except ValueError:
            return None
        at = end + 2
        if size == 0:
            return b"".join(out)
        if size < 0 or body[at + size : at + size + 2] != b"\r\n":
            return None
        out.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes | None:
    """The entity of an HTTP response, its transfer framing removed."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        return None
    if re.search(rb"\r\ntransfer-encoding:\s*chunked\s*(\r\n|$)", head.lower()):
        return unframe_chunks(body)
    return body


def _record(kind: str, record_id: str, fields: dict, block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    lines += [f"{k}: {v}" for k, v in fields.items() if v is not None]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def records_of(kind: str, record_id: str, fields: dict, block: bytes, segment_bytes: int) -> Iterator[bytes]:
    """One record, or its segments."""
    if len(block) <= segment_bytes:
        yield _record(kind, record_id, fields, block)
        return
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    yield _record(kind, record_id, fields | {"WARC-Segment-Number": 1}, parts[0])
    for number, part in enumerate(parts[1:], 2):
        own = {"WARC-Segment-Origin-ID": f"<{record_id}>", "WARC-Segment-Number": number,
               "WARC-Segment-Total-Length": len(block) if number == len(parts) else None}
        yield _record("continuation", f"{record_id}:{number}", own, part)


def _field(value: str | None) -> str | None:
    """A header value on one line."""
    return None if value is None else re.sub(r"[\x00-\x1f\x7f]+", " ", value).strip()


def roles(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """``pages(page_id, url, html)`` with payload, digest and the page that holds an equal payload.

    ``first_id`` is the smallest page_id of the pages with this payload; pages
    with another id revisit it. Payloads below ``min_revisit_bytes`` are never
    revisited.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload")))
    firsts = rows.filter(F.octet_length("payload") >= min_revisit_bytes).groupBy("sha").agg(
        F.min("page_id").alias("first_id"))
    return rows.join(firsts, "sha", "left")


def write_archive(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, min_revisit_bytes: int = 0) -> None:
    """Write a record per row of ``pages`` as gzipped WARC files of at most ``FILE_RECORDS`` records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for page_id, url, payload, first in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "first_id"))):
                page_id, url, payload, first = page_id.as_py(), _field(url.as_py()), payload.as_py(), first.as_py()
                digest = payload_digest(payload)
                fields = {"WARC-Target-URI": url, "WARC-Page-ID": page_id, "WARC-Payload-Digest": f"sha1:{digest}"}
                if first is None or page_id == first:
                    fields |= {"Content-Type": "application/http;msgtype=response"}
                    records = records_of("response", f"urn:page:{page_id}:{digest}", fields, _HEAD + frame_chunks(payload), segment_bytes)
                else:
                    fields |= {"WARC-Refers-To": f"<urn:page:{first}:{digest}>",
                               "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
                    records = records_of("revisit", f"urn:page:{page_id}:{digest}:revisit", fields, b"", segment_bytes)
                for record in records:
                    out.append(record)
                    size += len(record)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, type=pa.binary())], names=["value"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, type=pa.binary())], names=["value"])

    rows = roles(pages, min_revisit_bytes).select("page_id", "url", "payload", "first_id")
    records = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    (records.write.option("lineSep", RECORD_END).option("compression", "gzip")
     .option("maxRecordsPerFile", FILE_RECORDS).text(path))


def plain(content: bytes) -> bytes:
    """``content`` without gzip, which may have a member per record or one for all."""
    out = []
    while content[:2] == b"\x1f\x8b":
        stream = zlib.decompressobj(31)
        out.append(stream.decompress(content))
        content = stream.unused_data
    return b"".join(out) if out else content


def parse_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields, with lower-case names, and block of each whole record."""
    at = 0
    while (at := content.find(b"WARC/1.", at)) >= 0:
        end = content.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = content[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        size = fields.get("content-length", "")
        if not size.isdigit() or end + 4 + int(size) > len(content):
            return
        at = end + 4 + int(size)
        yield fields, content[end + 4 : at]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the WARC files under ``path``, segments apart; see ``RECORD_FIELDS``."""

    def number(value: str | None) -> int | None:
        return int(value) if value and re.fullmatch(r"-?\d+", value) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for f, block in parse_records(plain(content.as_py())):
                    get = f.get
                    strip = lambda v: v.strip("<>") if v else None
                    rows.append((strip(get("warc-record-id")), get("warc-type"), get("warc-page-id"), get("warc-target-uri"),
                                 strip(get("warc-refers-to")), (get("warc-payload-digest") or "").removeprefix("sha1:") or None,
                                 number(get("warc-segment-number")), strip(get("warc-segment-origin-id")),
                                 number(get("warc-segment-total-length")), block))
                    size += len(block)
                    if size > 4 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                yield _batch(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, RECORD_FIELDS)


_SCHEMA = pa.schema([
    ("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.string()), ("uri", pa.string()),
    ("refers_to_id", pa.string()), ("digest", pa.string()), ("segment", pa.int32()), ("origin", pa.string()),
    ("total", pa.int64()), ("block", pa.binary())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_SCHEMA)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)


def join_segments(numbers: list[int], blocks: list[bytes], total: int | None) -> bytes | None:
    """The block of segments in any order, repeats allowed; None if one is missing or the length is wrong."""
    parts = dict(zip(numbers, blocks))
    whole = b"".join(parts[n] for n in sorted(parts))
    return whole if sorted(parts) == list(range(1, len(parts) + 1)) and total == len(whole) else None


_OUT = "record_id string, record_type string, page_id string, uri string, refers_to_id string, digest string, segments int, payload binary"


def _decoded(rows: DataFrame) -> DataFrame:
    """Rows of whole ``response`` and ``revisit`` blocks with their payload."""

    @F.pandas_udf("binary")
    def payload(blocks: pd.Series) -> pd.Series:
        return blocks.map(lambda b: None if b is None else http_payload(b))

    is_response = F.col("record_type") == "response"
    page_id = F.col("page_id").try_cast("long")
    return rows.withColumns({"payload": F.when(is_response, payload("block")), "page_id": page_id}).drop("block")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per response and revisit record of the WARC files under ``path``, segments put together.

    ``payload`` is the decoded entity of a response; it is null if a segment is
    missing, the total length is wrong or the framing is broken, and for a
    revisit. Segments that occur twice are read once. Records cut off at the
    end of a file are left out.
    """
    records = read_records(spark, path)
    carry = ["record_id", "record_type", "page_id", "uri", "refers_to_id", "digest"]
    whole = records.filter(F.col("segment").isNull() & F.col("record_type").isin("response", "revisit"))
    whole = whole.select(*carry, F.lit(1).alias("segments"), "block")
    cut = records.filter(F.col("segment").isNotNull()).withColumn("origin", F.coalesce("origin", "record_id"))

    def reassemble(group: pd.DataFrame) -> pd.DataFrame:
        totals = group["total"].dropna()
        block = join_segments(group["segment"].tolist(), group["block"].tolist(), int(totals.iloc[0]) if len(totals) else None)
        firsts = group[group["segment"] == 1]
        out = firsts[carry].copy()
        out["segments"], out["block"] = int(group["segment"].max()), [block] * len(firsts)
        return out

    schema = _OUT.replace("payload binary", "block binary")
    joined = cut.groupBy("origin").applyInPandas(reassemble, schema)
    return _decoded(whole.unionByName(joined))


def _base32(hex_digests: pd.Series) -> pd.Series:
    return hex_digests.map(lambda d: None if d is None else base64.b32encode(bytes.fromhex(d)).decode())


def archive_report(pages: DataFrame, path: str | None = None, segment_bytes: int = SEGMENT_BYTES, min_revisit_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to an archive, read it back, and describe each page's record.

    ``(page_id, payload_bytes, payload_digest, record_type, refers_to)``, with
    size and digest of the payload as read; a revisit takes both from the
    response it refers to.

    A null html is an empty payload. Rows that repeat the smallest page_id of
    their payload are responses each. Null ids are never smallest unless the
    payload has no other page, and are then responses. An empty table gives an
    empty archive.
    """
    spark = pages.sparkSession
    path = path or work_path(spark, "warc")
    write_archive(pages, path, segment_bytes, min_revisit_bytes)
    rows = read_archive(spark, path).select(
        "record_id", "record_type", "page_id", "refers_to_id", "segments",
        F.octet_length("payload").cast("long").alias("size"), F.pandas_udf(_base32, "string")(F.sha1("payload")).alias("sha"))
    rows = staged(rows, "records")
    holders = rows.filter("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_id")).agg(
        F.max("size").alias("r_size"), F.max("sha").alias("r_sha"), F.max("page_id").alias("refers_to"))
    # Only revisits meet their response: responses refer to nothing and stay out of the join.
    revisits = rows.filter("record_type = 'revisit'").join(holders, "refers_to_id", "left").select(
        "page_id", F.col("r_size").alias("payload_bytes"), F.col("r_sha").alias("payload_digest"), "record_type", "refers_to", "segments")
    responses = rows.filter("record_type = 'response'").select(
        "page_id", F.col("size").alias("payload_bytes"), F.col("sha").alias("payload_digest"), "record_type",
        F.lit(None).cast("long").alias("refers_to"), "segments")
    return responses.unionAll(revisits)
