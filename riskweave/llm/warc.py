"""WARC archives through a chunked record table.

A payload longer than ``chunk`` becomes rows (record, chunk number), each a WARC
record of its own: the first segment, then ``continuation`` records, as the format
has it for oversized payloads.  So no step holds a whole large record, neither
when writing nor when reading.  Spark's text writer, with the blank line that ends
a WARC record as its line separator, writes the archives through the usual commit
of tasks and to any store, without a shuffle: each task writes what it has read.  An
archive holds at most ``max_records`` chunks, so its size is bounded too (typically
16 MB); archives are read one at a time.

Reading gives a record table again.  Digests of segmented payloads are carried from
chunk to chunk over rows sorted by record and chunk number.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskweave.llm.common import as_batch, staged
from riskweave.session import work_folder

END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n\r\n"
CHUNK = 1 << 16
MAX_RECORDS = 4096
_FIELD = re.compile(rb"^([A-Za-z-]+):[ \t]*(.*?)\r?$", re.M)


def base32(hex_digits: Column) -> Column:
    """Bare upper-case base32 of 40 hex digits: four groups of 40 bits, eight letters each."""
    letters = []
    for group in range(4):
        bits = F.conv(F.substring(hex_digits, 10 * group + 1, 10), 16, 10).cast("long")
        letters += [F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.shiftright(bits, 35 - 5 * k).bitwiseAND(31).cast("int") + 1, F.lit(1)) for k in range(8)]
    return F.concat(*letters)


def record_id(page_id: Column, segment: Column) -> Column:
    h = F.md5(F.concat_ws("/", F.lit("page"), page_id.cast("string"), segment.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def one_line(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "\r", "%0D"), "\n", "%0A")


def records(pages: DataFrame, *, min_revisit_bytes: int = 0) -> DataFrame:
    """Per row: page_id, url, html, payload_bytes, payload_digest, record_type, refers_to.

    Of rows with equal payloads of at least ``min_revisit_bytes``, the one with the
    largest page_id is the response, the others revisit it; smaller ones are all
    responses.  A NULL html is an empty payload.  Of rows that repeat the largest
    page_id with the same payload all are responses.  A NULL page_id sorts below all
    numbers.  A revisit carries no html on.  The table of repeated payloads is written
    first, so that Spark knows its size when it chooses the join: while it is small, no
    payload is shuffled.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")).select(
        "*", F.octet_length("html").cast("long").alias("payload_bytes"), F.sha1(F.encode("html", "UTF-8")).alias("_sha1"))
    # sums on the map side leave a row per payload and task, however many copies there are
    first = staged(rows.where(F.col("payload_bytes") >= min_revisit_bytes).groupBy("_sha1", "payload_bytes")
             .agg(F.max("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n"), "payloads")
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return rows.join(first, ["_sha1", "payload_bytes"], "left").select(
        "page_id", "url", F.when(~revisit, F.col("html")).alias("html"), "payload_bytes", base32(F.col("_sha1")).alias("payload_digest"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("_first")).alias("refers_to"))


def chunked(made: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The record table: a row per record and chunk of ``chunk`` characters, with the WARC text of each in ``value``."""
    size = F.length("html")
    starts = F.when(F.col("html").isNull() | (size <= chunk), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), size - 1, F.lit(chunk)))
    rows = made.select("*", F.size(starts).alias("_segments"), F.posexplode(starts).alias("_at", "_start"))
    part = F.when(F.col("_segments") == 1, F.coalesce("html", F.lit(""))).otherwise(F.substring(F.col("html"), F.col("_start") + 1, F.lit(chunk)))
    block = F.when(F.col("_at") == 0, F.concat(F.lit(HTTP), part)).otherwise(part)
    first = F.col("_at") == 0
    fields = [
        ("WARC-Type", F.when(first, F.col("record_type")).otherwise("continuation")),
        ("WARC-Record-ID", record_id(F.col("page_id"), F.col("_at"))),
        ("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        ("WARC-Target-URI", one_line(F.col("url"))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        ("WARC-Profile", F.when(F.col("refers_to").isNotNull(), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        ("WARC-Refers-To", F.when(F.col("refers_to").isNotNull(), record_id(F.col("refers_to"), F.lit(0)))),
        ("WARC-Segment-Number", F.when(F.col("_segments") > 1, (F.col("_at") + 1).cast("string"))),
        ("WARC-Segment-Origin-ID", F.when(~first, record_id(F.col("page_id"), F.lit(0)))),
        ("WARC-Segment-Total-Length", F.when((F.col("_segments") > 1) & (F.col("_at") == F.col("_segments") - 1),
                                             (F.col("payload_bytes") + len(HTTP)).cast("string"))),
        ("X-Page-ID", F.col("page_id").cast("string")),
        ("X-Refers-To-Page", F.col("refers_to").cast("string")),
        ("Content-Type", F.when(first, F.lit("application/http; msgtype=response"))),
    ]
    header = F.concat(*[F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")) for name, value in fields])
    return rows.select("page_id", F.col("_at").alias("chunk"), F.concat(
        F.lit("WARC/1.1\r\n"), header, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END), block).alias("value"))


def write(made: DataFrame, path: str, *, chunk: int = CHUNK, max_records: int = MAX_RECORDS) -> None:
    """Archives below ``path``, of at most ``max_records`` chunks each."""
    chunked(made, chunk).select("value").write.option("lineSep", END).option("maxRecordsPerFile", max_records).text(path)


# --- reading ------------------------------------------------------------------

READ = "page_id long, record_type string, refers_to long, segment int, header_digest string, payload_bytes long, payload_digest string, part binary"


def parsed(content: bytes):
    """The records of an archive: header fields and the block, as views; bytes are not copied."""
    view, at = memoryview(content), 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        fields = {k.decode().lower(): v.decode() for k, v in _FIELD.findall(content, at, end + 2)}
        size = int(fields["content-length"])
        yield fields, view[end + 4:end + 4 + size]
        at = end + 4 + size + 4


def segments(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the archives.  ``part`` holds bytes of segmented payloads only; other digests are made here."""
    schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("segment", pa.int32()),
                        ("header_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("part", pa.binary())])
    number = lambda x: None if x is None else int(x)

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for fields, block in parsed(content.as_py()):
                    kind, segment = fields["warc-type"], number(fields.get("warc-segment-number"))
                    payload = block if kind == "continuation" else block[bytes(block[:4096]).index(b"\r\n\r\n") + 4:]
                    whole = segment is None and kind == "response"
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if whole else None
                    rows.append((number(fields.get("x-page-id")), kind, number(fields.get("x-refers-to-page")), segment,
                                 fields["warc-payload-digest"].removeprefix("sha1:"), len(payload) if kind != "revisit" else None,
                                 digest, None if segment is None else bytes(payload)))
                    held += len(payload) if segment else 100
                    if held > 4_000_000:
                        yield as_batch(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield as_batch(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, READ)


def joined(parts: DataFrame) -> DataFrame:
    """Segmented payloads: (page_id, refers_to, header_digest, payload_bytes, payload_digest).

    Rows come sorted by record and segment; a digest is carried from one to the next,
    so memory holds one segment at a time.
    """
    schema = pa.schema([("page_id", pa.int64()), ("header_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])

    def run(batches):
        now, state, size = None, None, 0
        done = lambda: [(now[0], now[1], size, base64.b32encode(state.digest()).decode())] if now else []
        for batch in batches:
            rows = []
            for page, header, segment, part in zip(*(c.to_pylist() for c in batch.columns)):
                if segment == 1:
                    rows += done()
                    now, state, size = (page, header), hashlib.sha1(), 0
                state.update(part)
                size += len(part)
            if rows:
                yield as_batch(rows, schema)
        if now:
            yield as_batch(done(), schema)

    rows = parts.select("page_id", "header_digest", "segment", "part").repartition("page_id", "header_digest")
    return rows.sortWithinPartitions("page_id", "header_digest", "segment").mapInArrow(run, "page_id long, header_digest string, payload_bytes long, payload_digest string")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per response and revisit: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Digests and sizes are of the payloads as read; a revisit has those of the record
    it refers to.
    """
    rows = segments(spark, path)
    whole = rows.where("segment IS NULL AND record_type = 'response'").select("page_id", "header_digest", "payload_bytes", "payload_digest")
    responses = whole.union(joined(rows.where("segment IS NOT NULL")))
    named = responses.groupBy(F.col("page_id").alias("refers_to"), "header_digest").agg(
        F.max("payload_bytes").alias("payload_bytes"), F.max("payload_digest").alias("payload_digest"))
    revisits = rows.where("record_type = 'revisit'").select("page_id", "refers_to", "header_digest").join(named, ["refers_to", "header_digest"], "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return (responses.withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast("long")}).select(columns)
            .union(revisits.withColumn("record_type", F.lit("revisit")).select(columns)))


def round_trip(spark: SparkSession, pages: DataFrame, *, min_revisit_bytes: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Writes archives for all pages to the shared folder and reads them back."""
    path = work_folder(spark, "warc")
    write(records(pages, min_revisit_bytes=min_revisit_bytes), path, chunk=chunk)
    return read(spark, path)
