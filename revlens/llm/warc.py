"""WARC archives as a chunked record table.

Write: a page's payload is cut into chunk rows (record key, chunk number, data) that
carry the digest of all payload so far; an oversized payload becomes a first record and
continuation records (WARC segmentation), so no later step holds a whole record. Read:
segments come back as rows; a record's digest is carried on from chunk to chunk over
rows sorted by chunk number. Archives are written and read by Spark's text source, with
the first two header lines of every record (they hold an id made for this archive) as
the record separator, so any file system that Spark knows will do.

Of pages with equal payloads of at least ``min_revisit_bytes`` bytes the one with the
smallest page_id is a response and the others revisit it.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from base64 import b32encode

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.session import checkpoint_dir

CHUNK_CHARS = 1 << 16
CRLF = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(col: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 160 bits are 32 digits of 5 bits, so each 5
    hexadecimal digits are 4 digits."""
    digits = []
    for i in range(0, 40, 5):
        v = F.conv(F.substring(F.sha1(col), i + 1, 5), 16, 10).cast("int")
        digits += [F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*digits)


def separator(archive: str) -> str:
    return f"WARC/1.1{CRLF}WARC-Warcinfo-ID: <urn:uuid:{archive}>{CRLF}"


def _header(*fields: tuple[str, Column | str]) -> Column:
    """Header lines; a null value leaves its line out."""
    lines = []
    for name, value in fields:
        value = F.lit(value) if isinstance(value, str) else value.cast("string")
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")))
    return F.concat(*lines)


def chunk_table(pages: DataFrame, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """pages(key, ..., payload string) -> one row per chunk: the other columns, chunk
    (from 1), chunks, data, running_digest (base32 SHA-1 of the payload up to and with
    this chunk). An empty payload is one empty chunk. Chunks end between characters."""
    kept = [c for c in pages.columns if c != "payload"]
    last = F.greatest(F.lit(0), F.floor((F.char_length("payload") - 1) / chunk_chars)).cast("int")
    rows = (pages.withColumn("__last", last)
            .withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__last"))))
            .select(*kept, (F.col("__i") + 1).alias("chunk"), (F.col("__last") + 1).alias("chunks"),
                    F.substring("payload", F.col("__i") * chunk_chars + 1, F.lit(chunk_chars)).alias("data")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = hashlib.sha1()
        for b in batches:
            digests = []
            for number, data in zip(b["chunk"].to_pylist(), b["data"].to_pylist()):
                if number == 1:   # the chunks of a page follow each other
                    state = hashlib.sha1()
                state.update(data.encode("utf-8", "replace"))
                digests.append(b32encode(state.digest()).decode())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(digests, pa.string())], [*b.schema.names, "running_digest"])

    from pyspark.sql.types import StringType, StructType
    return rows.mapInArrow(run, StructType([*rows.schema.fields]).add("running_digest", StringType()))


def write_archive(pages: DataFrame, path: str, chunk_chars: int = CHUNK_CHARS, min_revisit_bytes: int = 0,
                  archive: str | None = None, date: str = "2000-01-01T00:00:00Z") -> str:
    """Writes pages(page_id, url, html) as gzip-compressed WARC files under ``path``; returns the
    archive id that ``read_archive`` takes.

    Null html is an empty payload. Null page_id: always a response, and no page revisits
    it. Rows that repeat page_id and payload are all responses (none has a smaller id).
    A null url leaves the target line out; line breaks in urls become spaces. Other
    columns are not read.
    """
    spark = pages.sparkSession
    archive = archive or str(uuid.uuid4())
    sep = separator(archive)
    payload = F.coalesce(F.col("html"), F.lit(""))
    known = pages.select("page_id", F.regexp_replace("url", "[\r\n]", " ").alias("url"), payload.alias("payload"),
                         F.sha2(payload, 256).alias("sha"), F.octet_length(payload).cast("long").alias("bytes"))
    if known.where(F.contains("payload", F.lit(sep))).limit(1).count():
        return write_archive(pages, path, chunk_chars, min_revisit_bytes, None, date)
    firsts = (known.where(f"page_id IS NOT NULL AND bytes >= {int(min_revisit_bytes)}")
              .groupBy("sha").agg(F.min("page_id").alias("first")))

    def record_id(page: str) -> Column:
        h = F.md5(F.concat_ws("|", F.coalesce(F.col(page).cast("string"), F.lit("")), "sha"))
        return F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")

    # Responses: their payload moves once, by (sha, page_id); copies stay behind.
    own = known.join(firsts.withColumnRenamed("first", "page_id"), ["sha", "page_id"], "left_semi")
    alone = known.where(f"page_id IS NULL OR bytes < {int(min_revisit_bytes)}").select(*own.columns)
    responses = own.unionByName(alone).select(
        "page_id", "url", "bytes", record_id("page_id").alias("record"), F.monotonically_increasing_id().alias("copy"),
        base32_sha1(F.col("payload")).alias("digest"), "payload")
    chunks = chunk_table(responses, chunk_chars)
    begin = F.col("chunk") == 1
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    block = F.when(begin, F.concat(http, "data")).otherwise(F.col("data"))
    many = F.col("chunks") > 1
    head = _header(
        ("WARC-Type", F.when(begin, "response").otherwise("continuation")),
        ("WARC-Record-ID", F.when(begin, F.col("record")).otherwise(F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")))),
        ("WARC-Date", date), ("WARC-Target-URI", F.col("url")),
        ("Content-Type", F.when(begin, "application/http; msgtype=response")),
        ("WARC-Payload-Digest", F.when(begin, F.concat(F.lit("sha1:"), "digest"))),
        ("WARC-Segment-Number", F.when(many, F.col("chunk"))),
        ("WARC-Segment-Origin-ID", F.when(~begin, F.col("record"))),
        ("WARC-Segment-Total-Length", F.when(many & (F.col("chunk") == F.col("chunks")), F.col("bytes") + F.octet_length(http))),
        ("X-Running-Digest", F.concat(F.lit("sha1:"), "running_digest")),
        ("X-Page-Id", F.col("page_id")), ("X-Payload-Length", F.col("bytes")), ("X-Copy", F.col("copy")),
        ("Content-Length", F.octet_length(block)))
    response_text = chunks.select(F.concat(F.lit(sep), head, F.lit(CRLF), block, F.lit(CRLF)).alias("value"))

    copies = (known.where("page_id IS NOT NULL").select("page_id", "url", "sha", "bytes", base32_sha1(F.col("payload")).alias("digest"))
              .join(firsts, "sha").where("page_id > first"))
    head = _header(
        ("WARC-Type", "revisit"), ("WARC-Record-ID", record_id("page_id")), ("WARC-Date", date), ("WARC-Target-URI", F.col("url")),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ("WARC-Refers-To", record_id("first")), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        ("X-Page-Id", F.col("page_id")), ("X-Payload-Length", F.col("bytes")), ("X-Refers-To-Page", F.col("first")),
        ("Content-Length", "0"))
    revisit_text = copies.select(F.concat(F.lit(sep), head, F.lit(CRLF + CRLF)).alias("value"))
    info = spark.range(0, 1, 1, 1).select(F.lit(
        f"{sep}WARC-Type: warcinfo{CRLF}WARC-Record-ID: <urn:uuid:{archive}>{CRLF}WARC-Date: {date}{CRLF}Content-Length: 0{CRLF}{CRLF}{CRLF}")
        .alias("value"))
    (response_text.unionByName(revisit_text).unionByName(info)
     .write.option("lineSep", CRLF).option("compression", "gzip").text(path))
    return archive


def read_segments(spark: SparkSession, path: str, archive: str) -> DataFrame:
    """Rows of an archive that ``write_archive`` made: header fields and the payload part (data)."""
    raw = spark.read.option("lineSep", separator(archive)).text(path).where("value <> ''")
    cut = raw.withColumn("head", F.substring_index("value", CRLF + CRLF, 1))

    def field(name: str) -> Column:
        v = F.regexp_extract("head", f"(?m)^{name}: ([^\r\n]*)", 1)
        return F.when(v != "", v)
    rows = cut.select(
        field("WARC-Type").alias("type"), field("X-Page-Id").cast("long").alias("page_id"),
        F.coalesce(field("WARC-Segment-Origin-ID"), field("WARC-Record-ID")).alias("record"), field("X-Copy").cast("long").alias("copy"),
        field("WARC-Segment-Number").cast("int").alias("segment"), field("X-Payload-Length").cast("long").alias("bytes"),
        F.substring(field("WARC-Payload-Digest"), F.lit(6), F.lit(32)).alias("digest"),
        F.substring(field("X-Running-Digest"), F.lit(6), F.lit(32)).alias("running_digest"),
        field("X-Refers-To-Page").cast("long").alias("refers_to"), field("Content-Length").cast("long").alias("length"),
        # header, empty line, block, two line ends
        F.substring("value", F.char_length("head") + 5, F.char_length("value") - F.char_length("head") - 8).alias("block"))
    ends = F.locate(CRLF + CRLF, F.col("block"))
    data = F.when(F.col("type") == "response", F.substring("block", ends + 4, F.char_length("block"))).otherwise(F.col("block"))
    return rows.where("type <> 'warcinfo'").withColumn("whole", F.octet_length("block") == F.col("length")).withColumn("data", data).drop("block")


def read_archive(spark: SparkSession, path: str, archive: str) -> DataFrame:
    """Records of an archive: page_id, payload_bytes, payload_digest, record_type, refers_to,
    valid (lengths and every digest agree with what was read).

    Records in one segment are finished row by row; only segmented ones are shuffled, by
    record, and stream through in chunk order with the digest carried along.
    """
    rows = read_segments(spark, path, archive)
    digest = base32_sha1(F.col("data"))
    single = rows.where("type = 'response' AND segment IS NULL").select(
        "page_id", F.octet_length("data").cast("long").alias("payload_bytes"), digest.alias("payload_digest"),
        F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"),
        (F.col("whole") & (digest == F.col("digest")) & (digest == F.col("running_digest"))).alias("valid"))
    revisit = rows.where("type = 'revisit'").select(
        "page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.lit("revisit").alias("record_type"), "refers_to", F.col("whole").alias("valid"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, page, state, size, step, ok, total, final = None, None, None, 0, 0, True, None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "page_id": pa.array([page], pa.int64()), "payload_bytes": pa.array([size], pa.int64()),
                "payload_digest": pa.array([b32encode(state.digest()).decode()], pa.string()),
                "record_type": pa.array(["response"]), "refers_to": pa.array([None], pa.int64()),
                "valid": pa.array([bool(ok and size == total and b32encode(state.digest()).decode() == final)], pa.bool_())})
        for b in batches:
            for r in b.to_pylist():
                if (r["record"], r["copy"]) != key:
                    if key is not None:
                        yield done()
                    key, page, state, size, step, ok = (r["record"], r["copy"]), r["page_id"], hashlib.sha1(), 0, 0, True
                    total, final = r["bytes"], r["digest"]
                data = r["data"].encode("utf-8")
                state.update(data)
                size, step = size + len(data), step + 1
                ok = ok and r["whole"] and r["segment"] == step and b32encode(state.digest()).decode() == r["running_digest"]
        if key is not None:
            yield done()

    segmented = (rows.where("segment IS NOT NULL").repartition("record", "copy")
                 .sortWithinPartitions("record", "copy", "segment")
                 .mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, valid boolean"))
    return single.unionByName(revisit).unionByName(segmented)


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex[:12]}"
    archive = write_archive(pages, path)
    return read_archive(spark, path, archive).drop("valid")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT page_id, t, sha1(t) AS x, min(page_id) OVER (PARTITION BY t) AS least FROM p),
d AS (SELECT page_id, t, least, (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST((CAST('0x' || substr(x, g * 5 + 1, 5) AS INTEGER) >> s) & 31 AS INTEGER) + 1, 1), '' ORDER BY g, s DESC)
      FROM (SELECT unnest(range(0, 8)) AS g) a, (SELECT unnest([15, 10, 5, 0]) AS s) b) AS digest FROM h)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id > least THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > least THEN least END AS refers_to
FROM d
"""
