"""WARC archives with revisit resolution.

Headers (id, URL, digest, size) are shuffled by payload digest. Of the records with equal payloads of at least
``min_bytes`` the one with the largest id stays a response; the others become revisit records that refer to it and
carry no payload. Archives are written by Spark's own writer, one gzip file per task and size step, so they are
committed atomically on any shared store; every header is made afresh.

Reading parses each archive by Content-Length, hashes every payload, compares it with the header, and joins
revisits to the responses they refer to for the size and digest of the full payload; a response that very many
revisits refer to meets them in several tasks.

Every record has an id of its own: a response that others refer to is named by page, URL and digest, every other
record also by its row.

Defined cases: null html is an empty payload; a null id or URL gives a record without that header; line breaks
in a URL are escaped; of rows that are equal in id, URL and payload one is the response, the others revisit it under
ids of their own; payloads are written whole, however long; other columns of the pages are left out; an empty table gives
archives without records and no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from volpanel.llm.tables import spread_join, stage
from volpanel.session import scratch_path

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES = 32_000_000
RECORD_SCHEMA = (
    "record_id string, record_type string, page_id bigint, refers_to_record string, target_uri string, "
    "payload_bytes bigint, payload_digest string"
)


def _record_id(page_id: Column, url: Column, digest: Column, row: Column | None = None) -> Column:
    """A name-based urn:uuid of what identifies a record; with ``row`` equal pages have different ones."""
    parts = [F.coalesce(page_id.cast("string"), F.lit("-")), F.coalesce(url, F.lit("-")), digest]
    seed = F.md5(F.concat_ws("|", *parts, *([] if row is None else [row.cast("string")])))
    return F.regexp_replace(seed, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")


def resolve_revisits(pages: DataFrame, page_id: str, url: str, html: str, min_bytes: int) -> DataFrame:
    """Every record with its payload, type, and for revisits the id and URL of the response."""
    payload = F.coalesce(F.col(html), F.lit(""))
    records = pages.select(
        F.col(page_id).cast("bigint").alias("page_id"),
        F.col(url).alias("url"),
        payload.alias("payload"),
        F.sha1(payload).alias("digest"),
        F.octet_length(payload).cast("bigint").alias("bytes"),
        F.monotonically_increasing_id().alias("row"),
    )
    headers = records.where(F.col("bytes") >= min_bytes).groupBy("digest", "page_id", "url").agg(
        F.count(F.lit(1)).alias("rows")
    )
    shared = stage(
        headers.groupBy("digest")
        .agg(F.sum("rows").alias("n"), F.max(F.struct("page_id", "url", "rows")).alias("top"))
        .where("n > 1")
        .select(
            F.col("digest").alias("shared_digest"),
            F.col("top.page_id").alias("response_id"),
            F.col("top.url").alias("response_url"),
            F.col("top.rows").alias("response_rows"),
        ),
        "warc-shared",
    )
    joined = records.join(
        shared, (records["digest"] == shared["shared_digest"]) & (records["bytes"] >= min_bytes), "left"
    )
    top = F.col("page_id").eqNullSafe(F.col("response_id")) & F.col("url").eqNullSafe(F.col("response_url"))
    if not shared.where("response_rows > 1").isEmpty():
        # Only equal rows of a response are numbered together, every other row by itself.
        alone = F.when(F.coalesce(top, F.lit(False)), F.lit(-1)).otherwise(F.col("row"))
        same = Window.partitionBy("digest", "page_id", "url", alone).orderBy("row")
        joined = joined.withColumn("copy", F.row_number().over(same))
        top = top & (F.col("copy") == 1)
    shares = F.col("shared_digest").isNotNull()
    return joined.withColumns({"revisit": shares & ~top, "referred": shares & top})


def record_text(records: DataFrame) -> Column:
    """The whole record without its closing line breaks, which the writer adds as separator."""
    escaped = lambda c: F.regexp_replace(F.regexp_replace(c, "\r", "%0D"), "\n", "%0A")

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("bytes").cast("string"),
        F.lit(END),
        F.col("payload"),
    )
    block = F.when(F.col("revisit"), F.lit("")).otherwise(http)
    only = lambda c: F.when(F.col("revisit"), c)
    named = F.col("page_id"), F.col("url"), F.col("digest")
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.when(F.col("referred"), _record_id(*named)).otherwise(_record_id(*named, F.col("row")))),
        line("WARC-Date", F.lit("2000-01-01T00:00:00Z")),
        line("WARC-Target-URI", escaped(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Profile", only(F.lit(PROFILE))),
        line("WARC-Refers-To", only(_record_id(F.col("response_id"), F.col("response_url"), F.col("digest")))),
        line("WARC-Refers-To-Target-URI", only(escaped(F.col("response_url")))),
        line("X-Page-Id", F.col("page_id").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )


def write_archives(
    pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 1000
) -> None:
    """Write deduplicated archives of all pages below ``path``."""
    records = resolve_revisits(pages, page_id, url, html, min_bytes)
    mean = pages.select(F.avg(F.octet_length(html))).first()[0] or 0
    per_file = max(1, int(FILE_BYTES / (mean + 600)))
    (
        records.select(record_text(records).alias("value"))
        .write.option("lineSep", END)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", per_file)
        .text(path)
    )


def _records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of one archive."""
    data = zlib.decompress(content, wbits=31) if content[:2] == b"\x1f\x8b" else content
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        begin = stop + 4
        end = begin + int(headers["Content-Length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is not closed")
        yield headers, data[begin:end]
        at = end + 4


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [
            ("record_id", pa.string()),
            ("record_type", pa.string()),
            ("page_id", pa.int64()),
            ("refers_to_record", pa.string()),
            ("target_uri", pa.string()),
            ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()),
        ]
    )
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for headers, block in _records(content.as_py()):
                kind = headers["WARC-Type"]
                size = digest = None
                if kind != "revisit":
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                    if headers["WARC-Payload-Digest"] != f"sha1:{digest}":
                        raise ValueError(f"payload of {headers['WARC-Record-ID']} is damaged")
                page = headers.get("X-Page-Id")
                rows.append(
                    {
                        "record_id": headers["WARC-Record-ID"],
                        "record_type": kind,
                        "page_id": None if page is None else int(page),
                        "refers_to_record": headers.get("WARC-Refers-To"),
                        "target_uri": headers.get("WARC-Target-URI"),
                        "payload_bytes": size,
                        "payload_digest": digest,
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, target_uri, payload size and digest, record_type, refers_to (an id)."""
    files = spark.read.format("binaryFile").load(path).select("content")
    records = stage(files.mapInArrow(_parsed, RECORD_SCHEMA), "warc-records")
    revisits = records.where("record_type = 'revisit'")
    asked = revisits.groupBy(F.col("refers_to_record").alias("record_id")).agg(F.count(F.lit(1)).alias("revisits"))
    responses = (
        records.where("record_type = 'response'")
        .join(asked, "record_id")
        .select("record_id", "page_id", "payload_bytes", "payload_digest", "revisits")
    )
    resolved = spread_join(revisits, F.col("refers_to_record"), "record_id", responses, "record_id", "revisits")
    own = records.where("record_type <> 'revisit'").select(
        "page_id", "target_uri", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("bigint").alias("refers_to")
    )
    return own.unionByName(
        resolved.select(
            "page_id",
            "target_uri",
            F.col("found.payload_bytes").alias("payload_bytes"),
            F.col("found.payload_digest").alias("payload_digest"),
            "record_type",
            F.col("found.page_id").alias("refers_to"),
        )
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write archives of ``pages`` to the shared folder and read them back."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)
