"""WARC: writing archives, reading them back, and assembling transactions.

Every capture is written as a request, a response (or revisit) and a metadata record; request and metadata name
their response in WARC-Concurrent-To. Archives are plain gzipped WARC/1.1 files made by Spark's own text writer, so
any store that Spark writes will do, and a lost task is written again as a whole. Reading takes gzipped or plain
files, with one or many gzip members. Assembly joins the records of a capture through the concurrent-to identifier
and gives one nested row a capture.

Revisits: of captures with equal payloads of at least MIN_REVISIT bytes, the one with the smallest page id (of equal
ids, the smallest row hash) is the response, the others refer to it. A null id never becomes the response where
another has an id; where all ids are null, all are responses. Null payloads are empty. Rows that are equal in every
column share their record identifiers and come back as often as they were written.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_REVISIT = 100
SALTS = 32
"""The rows of one payload are dealt to so many keys."""
CAPTURES_A_FILE, FILE_BYTES = 2000, 1 << 28
"""An archive holds so many captures, fewer where that many of the largest would make more bytes, and one at least."""
HEAD_BYTES = 1 << 24
"""The most that a line of a record's head may have."""
DATE = "2024-01-01T00:00:00Z"
CRLF, GAP = "\r\n", "\r\n\r\n"


def _record(kind: str, record_id, block, **fields) -> F.Column:
    """One record's text; fields that are null are left out."""
    parts = [F.lit(f"WARC/1.1{CRLF}WARC-Type: {kind}{CRLF}WARC-Record-ID: "), record_id, F.lit(f"{CRLF}WARC-Date: {DATE}{CRLF}")]
    for name, value in fields.items():
        name = "-".join(x if x in ("URI", "WARC") else x.capitalize() for x in name.split("_")).replace("Warc", "WARC")
        parts.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")))
    return F.concat(*parts, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(GAP), block)


def plan_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload, digest, n, uid and first (null, or id and uid of the response that this row revisits)."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("n", F.octet_length("payload").cast("long"))
    rows = rows.withColumn("uid", F.lower(F.hex(F.xxhash64("page_id", "url", "digest"))))
    small = rows.filter(f"n >= {min_bytes}").groupBy("digest").agg(
        F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "uid"))).alias("first"), F.count("*").alias("c")
    )
    small = small.filter("c > 1 and first is not null").select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    keyed = rows.withColumn("salt", F.expr(f"cast(pmod(xxhash64(page_id, url), {SALTS}) as int)"))
    joined = keyed.join(small, ["digest", "salt"], "left")
    own = F.col("first").eqNullSafe(F.struct("page_id", "uid"))
    return joined.withColumn("first", F.when(~own, F.col("first"))).drop("salt")


def write_archives(pages: DataFrame, path: str) -> None:
    """Gzipped archives in the folder path, bounded by CAPTURES_A_FILE and FILE_BYTES."""
    sizes = F.octet_length(F.coalesce("html", F.lit(""))) + 3 * F.octet_length(F.coalesce("url", F.lit("")))
    largest = pages.agg(F.max(sizes)).first()[0] or 0
    captures = max(1, min(CAPTURES_A_FILE, FILE_BYTES // (largest + 2000)))
    rows = plan_revisits(pages)
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    target = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ")
    urn = lambda kind, p, u: F.concat(F.lit(f"<urn:x-{kind}:"), p, F.lit(":"), u, F.lit(">"))
    capture = urn("capture", page, F.col("uid"))
    revisit = F.col("first").isNotNull()
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(GAP))
    digest = F.concat(F.lit("sha256:"), F.col("digest"))
    request = _record(
        "request", urn("request", page, F.col("uid")), F.concat(F.lit("GET "), target, F.lit(f" HTTP/1.1{GAP}")), WARC_target_URI=target,
        WARC_concurrent_to=capture
    )
    response = _record(
        "response", capture, F.concat(head, F.col("payload")), WARC_target_URI=target, WARC_payload_digest=digest,
        content_type=F.lit("application/http; msgtype=response")
    )
    again = _record(
        "revisit", capture, head, WARC_target_URI=target, WARC_payload_digest=digest, WARC_refers_to=urn(
            "capture", F.col("first.page_id").cast("string"), F.col("first.uid")
        ),
        WARC_profile=F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
    )
    metadata = _record(
        "metadata", urn("metadata", page, F.col("uid")), F.concat(F.lit("page-id: "), page, F.lit(CRLF)), WARC_concurrent_to=capture,
        content_type=F.lit("application/warc-fields")
    )
    value = F.concat(request, F.lit(GAP), F.when(revisit, again).otherwise(response), F.lit(GAP), metadata)
    rows.select(value.alias("value")).write.option("lineSep", GAP).option("compression", "gzip").option("maxRecordsPerFile", captures).text(path)


def parse(data: bytes) -> Iterator[dict]:
    """The records of an archive, one in memory at a time. What is no record is skipped up to the next one's first line."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data), 1 << 20)
    line = stream.readline(HEAD_BYTES)
    while line:
        if b"WARC/1." not in line:
            line = stream.readline(HEAD_BYTES)
            continue
        head = {}
        while (line := stream.readline(HEAD_BYTES)) not in (b"", b"\r\n", b"\n") and b"WARC/1." not in line:
            name, _, value = line.partition(b":")
            head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
        if line in (b"\r\n", b"\n") and head.get("content-length", "").isdigit() and "warc-type" in head:
            yield head | {"block": stream.read(int(head["content-length"]))}
            line = stream.readline(HEAD_BYTES)


RECORDS = (
    "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, date string, "
    "payload_digest string, payload_bytes long, digest_ok boolean, fields string, payload binary"
)


def _parse_batches(keep_payload: bool):
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = {"payload_bytes": pa.int64(), "digest_ok": pa.bool_(), "payload": pa.binary()}

    def rows(data: bytes) -> Iterator[tuple]:
        for r in parse(data):
            kind, block, digest, n, ok, fields, payload = r["warc-type"], r["block"], None, None, None, None, None
            if kind in ("response", "revisit"):
                head, _, payload = block.partition(b"\r\n\r\n")
                digest = r.get("warc-payload-digest", "").rpartition(":")[2] or None
                if kind == "response":
                    own, n = hashlib.sha256(payload).hexdigest(), len(payload)
                    digest, ok = own, digest in (None, own)
                elif m := re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", head):
                    n = int(m[1])
            elif kind == "metadata":
                fields = block.decode("utf-8", "replace")
            yield r.get("warc-record-id"), kind, r.get("warc-concurrent-to"), r.get("warc-refers-to"), r.get("warc-target-uri"), r.get("warc-date"), digest, n, ok, fields, payload if keep_payload else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for data in batch.column(0):
                for row in rows(data.as_py()):
                    held.append(row)
                    if len(held) >= 2000:
                        yield flush(held)
                        held = []
        if held:
            yield flush(held)

    def flush(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, zip(*held), strict=True)], names=names)

    return run


def read_archives(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """One row a record of the archives in the folder path."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return common.map_batches(files, _parse_batches(keep_payload), RECORDS)


def assemble(records: DataFrame, keep_payload: bool = True) -> DataFrame:
    """One nested row a capture: request, response (type response or revisit) and metadata; copies is how often it was read.

    Requests and metadata without a response are captures with a null response.
    """
    root = F.when(F.col("record_type").isin("response", "revisit"), F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id"))
    is_response = F.col("record_type").isin("response", "revisit")
    payload = ["payload"] if keep_payload else []
    return records.groupBy(root.alias("capture_id")).agg(
        F.max(F.when(F.col("record_type") == "request", F.struct("record_id", "target_uri", "date"))).alias("request"),
        F.max(F.when(
            is_response, F.struct("record_type", "target_uri", "date", "payload_digest", "payload_bytes", "digest_ok", "refers_to", *payload)
        )).alias("response"),
        F.max(F.when(F.col("record_type") == "metadata", F.struct("record_id", "fields"))).alias("metadata"),
        F.count(F.when(is_response, 1)).alias("copies"),
    )


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{common.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(common.table(spark, sf_dir, "pages"), path)
    captures = common.materialize(assemble(read_archives(spark, path, keep_payload=False), keep_payload=False))
    common.delete(spark, path)
    rows = captures.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select(
        F.expr(
            r"try_cast(nullif(regexp_extract(metadata.fields, 'page-id: (-?\\d*)', 1), '') as bigint)"
        ).alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.record_type").alias("record_type"),
        F.expr(r"try_cast(nullif(regexp_extract(response.refers_to, '^<urn:x-capture:(-?\\d*):', 1), '') as bigint)").alias("refers_to"),
    )


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     f AS (SELECT page_id, strlen(h) AS n, sha256(h) AS d, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM f
"""
