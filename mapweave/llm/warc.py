"""WARC archives with revisit records.

Pages get headers (digest and length of their payload, the html in UTF-8). Headers, not payloads, are shuffled by digest: among pages with
equal payloads of at least `min_bytes` bytes the one with the largest id is the response, and the others join it as revisits. Each
page then becomes a record with fresh headers and an HTTP header, a revisit without payload, and the records are written as plain WARC/1.1
files to the shared folder by Spark's own writer, whose commit protocol survives lost tasks. Reading goes file by file, so files are
bounded by bytes: pages are written by tiers of size, with `file_records` records at most and 64 MB, or a single page, in a file.

Record ids are unique. The response of a group of equal payloads has an id made of the payload's digest, so that revisits can name it
before it is written; other ids are made of the digest and the row's number in the job.

Results: a null payload is empty. Of rows with one id and equal payloads one is the response and the others revisit it. Null ids come
last in the choice of the response; if all are null, one of them is the response and the revisits refer to null. Other columns
than id, url and payload are not archived. Empty tables make empty archives.
"""

import base64
import hashlib
import re
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.llm.common import shared_dir, stored

END = "\r\n\r\n"
#: Groups of equal payloads that are sent to all executors at most (about 40 bytes each); beyond, the join is left to a shuffle.
BROADCAST_GROUPS = 200_000
#: Tiers of pages: payloads of at most so many bytes, and records in a file; the last tier has one record a file.
TIERS = [(1 << 16, 1000), (1 << 22, 16), (None, 1)]
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
READ = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def base32_sha1(payload):
    """The SHA-1 of a binary column in upper-case base32: 32 characters from 40 hex digits, 4 from each 5."""
    digest = F.sha1(payload)
    out = []
    for i in range(8):
        v = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(_BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def resolve(pages: DataFrame, page_id: str, url: str, payload: str, min_bytes: int) -> DataFrame:
    """page_id, url, html (binary), bytes, digest, row (a number told apart from all others), refers_row, refers_to, refers_url."""
    html = F.coalesce(F.col(payload).cast("string").cast("binary"), F.lit(b""))
    raw = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), html.alias("html"))
    headers = raw.select("page_id", "url", F.length("html").cast("long").alias("bytes"), F.sha1("html").alias("sha"))
    order = F.struct(F.col("page_id").isNotNull(), "page_id")
    groups = stored(headers.where(F.col("bytes") >= min_bytes).groupBy(F.col("sha").alias("g_sha"), F.col("bytes").alias("g_bytes")).agg(F.count("*").alias("g_n"), F.max_by("page_id", order).alias("g_id"), F.max_by("url", order).alias("g_url"), F.count_if(F.col("page_id").isNull()).alias("g_null")).where("g_n > 1"))
    side = F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups
    return raw.select("*", F.length("html").cast("long").alias("bytes"), F.sha1("html").alias("sha")).join(side, (F.col("sha") == F.col("g_sha")) & (F.col("bytes") == F.col("g_bytes")), "left")


def records(resolved: DataFrame, date: str) -> DataFrame:
    """One column, value: each record without its closing line ends."""
    name = lambda *parts: F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.concat_ws("/", *parts).cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))
    line = lambda key, v: F.when(v.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{key}: "), v, F.lit("\r\n")))
    clean = lambda u: F.regexp_replace(u, "[\\r\\n]", "")
    revisit = F.col("revisit")
    group = name(F.lit("group"), "g_sha", F.col("g_bytes").cast("string"))
    own = F.when(F.col("g_sha").isNotNull() & ~revisit, group).otherwise(name(F.lit("row"), "sha", F.monotonically_increasing_id().cast("string")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\n"),
        line("WARC-Record-ID", own), F.lit(f"WARC-Date: {date}\r\n"), line("WARC-Target-URI", clean(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("html")))), line("X-Page-ID", F.col("page_id").cast("string")), line("X-Payload-Length", F.col("bytes").cast("string")),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"), line("WARC-Refers-To", group), line("WARC-Refers-To-Target-URI", clean(F.col("g_url"))), line("X-Refers-To-Page-ID", F.col("g_id").cast("string")))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), block.cast("string"), F.lit(END), http,
    )
    return resolved.select(F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("html").cast("string"))).alias("value"))


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, file_records: int = 500, date: str | None = None) -> None:
    """Write the pages as deduplicated archives below `path`. date: of the records, the job's start by default."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    found = resolve(pages, page_id, url, payload, min_bytes)
    # rows that share the chosen id: all but one of them revisit, too
    same = (F.col("g_sha").isNotNull()) & F.col("page_id").eqNullSafe(F.col("g_id"))
    doubles = stored(found.where(same).groupBy("g_sha", "g_bytes", F.col("page_id").alias("d_id")).agg(F.count("*").alias("d_n")).where("d_n > 1"))
    if doubles.limit(1).count():
        kept = stored(found.withColumn("nth", F.monotonically_increasing_id()))
        first = kept.where(same).groupBy(F.col("g_sha").alias("f_sha"), F.col("g_bytes").alias("f_bytes")).agg(F.min("nth").alias("f_nth"))
        found = kept.join(first, (F.col("g_sha") == F.col("f_sha")) & (F.col("g_bytes") == F.col("f_bytes")), "left").withColumn("revisit", F.col("g_sha").isNotNull() & (F.col("nth") != F.col("f_nth")))
    else:
        found = found.withColumn("revisit", F.col("g_sha").isNotNull() & ~same)
    most, low = pages.agg(F.max(F.octet_length(F.col(payload).cast("string")))).first()[0] or 0, -1
    for high, count in TIERS:
        if low < most or low < 0:
            tier = found.where((F.col("bytes") > low) & (F.lit(True) if high is None else F.col("bytes") <= high))
            records(tier, date).write.mode("append").option("lineSep", END).option("maxRecordsPerFile", min(file_records, count)).text(path)
        low = high


_FIELD = re.compile(rb"^([A-Za-z-]+): ?(.*?)\r$", re.M)


def parse(data: memoryview):
    """(headers, block) of each record of an archive."""
    at, raw = 0, data.tobytes()
    while at < len(raw):
        stop = raw.index(b"\r\n\r\n", at)
        fields = {k.lower().decode(): v.decode() for k, v in _FIELD.findall(raw[at : stop + 2])}
        begin = stop + 4
        n = int(fields["content-length"])
        if not raw.startswith(b"WARC/1.1\r\n", at) or raw[begin + n : begin + n + 4] != b"\r\n\r\n":
            raise ValueError("not a WARC record")
        yield fields, raw[begin : begin + n]
        at = begin + n + 4


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records below `path`. Revisits have no payload of their own; their length and digest are those of the full payload."""

    def run(batches):
        for batch in batches:
            for (content,) in zip(batch.column(0)):
                rows = []
                for f, block in parse(memoryview(content.as_buffer())):
                    body = block[block.index(b"\r\n\r\n") + 4 :]
                    number = lambda k: int(f[k]) if k in f else None  # noqa: B023, E731
                    digest = f["warc-payload-digest"].removeprefix("sha1:")
                    if f["warc-type"] == "response" and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                        raise ValueError("a payload differs from its digest")
                    rows.append((number("x-page-id"), f.get("warc-target-uri"), f["warc-type"], number("x-payload-length"), digest, number("x-refers-to-page-id"), (body if payloads else None)))
                cols = list(zip(*rows)) if rows else [[]] * 7
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, READ)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """The records of fresh archives of `pages`, read back from the shared folder."""
    spark, path = pages.sparkSession, shared_dir(pages.sparkSession)
    write(pages, path, **options)
    return read(spark, path, payloads=False)
