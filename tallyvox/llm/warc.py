"""WARC archives: write captures, read them back, join the records of each capture.

Each page gives a request, a response or revisit, and a metadata record; of pages with equal payloads only the one with
the largest page_id is a response. Spark's text writer makes the files, one string of about FILE_BYTES of captures
each, so that a reader holds at most that and one page. Captures are assembled from records by their concurrent-to
identifiers.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_folder, small

CRLF = "\r\n"
END_OF_RECORD = CRLF * 2
#: Bytes of captures after which a file ends.
FILE_BYTES = 8 << 20
#: A payload that more than one in so many of the repeated pages have is hot; there are fewer such payloads than this, so they are broadcast.
HOT_SHARE = 1000
RECORDS = "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, date string, payload_bytes long, payload_digest string, payload binary, fields map<string,string>"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def capture_id(page_id: int | None, digest: str, single: bool) -> str:
    """The identifier of a page's response or revisit; that of a response that others revisit follows from page and payload, others are drawn."""
    return f"urn:tallyvox:page:{'' if page_id is None else page_id}:{digest}" + ("" if single else f":{uuid.uuid4().hex}")


def _record(kind: str, rid: str, block: str, **headers: str | None) -> str:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", "WARC-Date: 2024-01-01T00:00:00Z"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in headers.items() if v is not None]
    return CRLF.join([*lines, f"Content-Length: {len(block.encode())}", "", block])


def capture_text(page_id: int | None, url: str | None, html: str | None, original: int | None, holders: int) -> str:
    """The records of one capture, without the end of the last. holders pages have the payload and the page_id original; 0: the payload is not repeated."""
    uri = quote(url or "about:blank", safe=":/?#[]@!$&'()*+,;=%~")
    payload = html or ""
    raw = payload.encode()
    try:
        parts = urlsplit(uri)
        path, host = (parts.path or "/") + (f"?{parts.query}" if parts.query else ""), parts.netloc
    except ValueError:
        path, host = "/", ""
    revisit, digest = holders > 0 and original != page_id, digest32(raw)
    own = capture_id(page_id, digest, holders == 1 and not revisit)
    rid, sha = f"<{own}>", f"sha1:{digest}"
    head = CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(raw)}", "", ""])
    http = {"Content_Type": "application/http; msgtype=response", "WARC_Target_URI": uri, "WARC_Payload_Digest": sha}
    if revisit:
        main = _record("revisit", rid, head, **http, WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", WARC_Refers_To=f"<{capture_id(original, digest, True)}>")
    else:
        main = _record("response", rid, head + payload, **http)
    request = _record("request", f"<{own}:request>", f"GET {path} HTTP/1.1{CRLF}Host: {host}{CRLF}{CRLF}", Content_Type="application/http; msgtype=request", WARC_Target_URI=uri, WARC_Concurrent_To=rid)
    fields = f"page_id: {'' if page_id is None else page_id}{CRLF}payload_bytes: {len(raw)}{CRLF}"
    metadata = _record("metadata", f"<{own}:metadata>", fields, Content_Type="application/warc-fields", WARC_Target_URI=uri, WARC_Concurrent_To=rid)
    return END_OF_RECORD.join([request, main, metadata])


def _with_originals(rows: DataFrame, least_revisit_bytes: int) -> DataFrame:
    """rows (page_id, url, html, sha, size) with the largest page_id of their payload (original) and how many rows have both (holders; 0 where the payload is not repeated).

    Payloads that are hot, as empty pages may be, meet their rows by broadcast; the others have few rows each.
    """
    by_page = rows.where(F.col("size") >= least_revisit_bytes).groupBy("sha", "size", "page_id").agg(F.count("*").alias("n"))
    repeated = by_page.groupBy("sha", "size").agg(F.max(F.struct("page_id", "n")).alias("top"), F.sum("n").alias("copies")).where("copies > 1")
    repeated = cut(repeated.select("sha", "size", F.col("top.page_id").alias("original"), F.col("top.n").alias("holders"), "copies"))
    total = repeated.agg(F.sum("copies")).first()[0] or 0
    hot = F.col("copies") * HOT_SHARE > total
    known = rows.join(F.broadcast(repeated.where(hot).select("sha", "size", F.col("original").alias("o"), F.col("holders").alias("h"))), ["sha", "size"], "left")
    # A row that has met its payload gets a key that none of the others has, so hot rows do not meet again.
    key = F.when(F.col("h").isNull(), F.concat_ws(":", "sha", "size")).otherwise(F.concat_ws(":", F.lit("hot"), F.xxhash64("page_id", "url")))
    rest = repeated.where(~hot).select(F.concat_ws(":", "sha", "size").alias("key"), "original", "holders")
    return known.withColumn("key", key).join(rest, "key", "left").select("page_id", "url", "html", F.when(F.col("h").isNull(), F.col("original")).otherwise(F.col("o")).alias("original"), F.coalesce("h", "holders", F.lit(0)).alias("holders"))


def write_archives(pages: DataFrame, folder: str, least_revisit_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Write pages (page_id, url, html; other columns are ignored) as gzip-compressed WARC files into folder, one capture for each row.

    A null html is an empty payload, a null url about:blank; a null page_id stays unknown and is smaller than any other.
    page_id may repeat. Of rows with equal payloads of at least least_revisit_bytes bytes, those with the largest
    page_id are written in full, the others revisit them; usually that is one row, and its record identifier is what
    the revisits refer to. Where several rows have both that page_id and that payload, each is written in full, and the
    revisits refer to the page and payload that all of them have.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns({"sha": F.sha1("html"), "size": F.octet_length("html")})
    joined = _with_originals(rows, least_revisit_bytes)

    def text_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in small(batches, 200):
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "original", "holders")), strict=True):
                held.append(capture_text(*row))
                size += len(held[-1])
                if size >= file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([END_OF_RECORD.join(held)], pa.string())], ["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([END_OF_RECORD.join(held)], pa.string())], ["value"])

    joined.mapInArrow(text_of, "value string").write.option("lineSep", END_OF_RECORD).option("compression", "gzip").option("maxRecordsPerFile", 1).text(folder)


_HEADER = re.compile(rb"([^\r\n:]+):[ \t]*([^\r\n]*)\r\n")


def parse(raw: bytes) -> Iterator[dict]:
    """The records of a file, in order. Raises ValueError where one is damaged or a digest does not fit its payload."""
    at = 0
    while at < len(raw):
        end = raw.find(b"\r\n\r\n", at)
        if end < 0 or not raw.startswith(b"WARC/1.", at):
            raise ValueError(f"no record at byte {at}")
        headers = {k.decode().lower(): v.decode() for k, v in _HEADER.findall(raw, at, end + 2)}
        size = int(headers["content-length"])
        block = raw[end + 4 : end + 4 + size]
        if len(block) < size or raw[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut off")
        at = end + 8 + size
        kind = headers["warc-type"]
        row = dict.fromkeys(("payload_bytes", "payload", "fields"))
        row |= {"record_id": headers["warc-record-id"], "record_type": kind, "concurrent_to": headers.get("warc-concurrent-to"), "refers_to": headers.get("warc-refers-to"), "target_uri": headers.get("warc-target-uri"), "date": headers.get("warc-date")}
        row["payload_digest"] = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
        if kind == "response":
            row["payload"] = block[block.find(b"\r\n\r\n") + 4 :]
            row["payload_bytes"] = len(row["payload"])
            if row["payload_digest"] not in (None, digest32(row["payload"])):
                raise ValueError(f"the payload of {row['record_id']} does not fit its digest")
        elif kind == "metadata":
            row["fields"] = {k.decode(): v.decode() for k, v in _HEADER.findall(block)}
        yield row


def read_records(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives in folder; without payloads, only their lengths and digests move on."""
    kinds = [("record_id", pa.string()), ("record_type", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("fields", pa.map_(pa.string(), pa.string()))]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                held = []
                for row in parse(gzip.decompress(content.as_buffer())):
                    if not with_payload:
                        row["payload"] = None
                    row["fields"] = list(row["fields"].items()) if row["fields"] is not None else None
                    held.append(row)
                    if len(held) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], t) for k, t in kinds], [k for k, _ in kinds])
                        held = []
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], t) for k, t in kinds], [k for k, _ in kinds])

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content").mapInArrow(read, RECORDS)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit, and the requests and metadata records that are concurrent to it.

    Records that belong to no response or revisit give no row.
    """
    main = F.col("record_type").isin("response", "revisit")
    key = F.when(main, F.col("record_id")).otherwise(F.col("concurrent_to"))
    response = F.struct("record_type", "target_uri", "date", "refers_to", "payload_bytes", "payload_digest", "payload")
    side = F.struct("record_id", "target_uri", "date", "fields")
    of = lambda kind: F.collect_list(F.when(F.col("record_type") == kind, side))
    joined = records.withColumn("capture_id", key).where("capture_id IS NOT NULL").groupBy("capture_id").agg(F.first(F.when(main, response), ignorenulls=True).alias("response"), of("request").alias("requests"), of("metadata").alias("metadata"))
    return joined.where("response IS NOT NULL")


def archive_round_trip(pages: DataFrame, with_payload: bool = False, least_revisit_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write pages as archives into the shared folder, read them back and give a row per page, as write_archives defines them; none for an empty table."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder, least_revisit_bytes, file_bytes)
    fields = F.col("metadata")[0]["fields"]
    page_of = lambda rid: F.regexp_extract(rid, ":page:(-?[0-9]+):", 1).try_cast("long")
    return captures(read_records(spark, folder, with_payload)).select(
        fields["page_id"].try_cast("long").alias("page_id"),
        F.coalesce("response.payload_bytes", fields["payload_bytes"].cast("long")).alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        F.when(F.col("response.refers_to").isNotNull(), page_of(F.col("response.refers_to"))).alias("refers_to"),
        *[F.col("response.payload").alias("payload")] * with_payload,
    )
