"""A content-addressed archive of web records.

An archive is two tables below one path: ``payloads`` holds every distinct payload once, under its SHA-256, and ``records``
holds the exact header bytes of every record with the digest they refer to.  Original records (header, blank line, payload)
come back by joining the two; every payload is hashed again when it is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm._common import new_path

CRLF = "\r\n"
#: Payloads below this size are stored by digest too, but never make a record a revisit.
SMALL = 100
#: Copies of a hot payload that its records are dealt to when an archive is read.
SALTS = 64


def record_id(page_id: Column) -> Column:
    """A stable urn:uuid for a page id."""
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit("null"))))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def record_header(rows: DataFrame) -> Column:
    """The header text of a record with columns page_id, url, digest, payload_bytes, record_type, refers_to and captured."""
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("page_id"))),
        F.concat(F.lit("WARC-Date: "), F.date_format(F.col("captured"), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.concat(F.lit("X-Page-ID: "), F.col("page_id").cast("string")),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", "")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.lower(F.hex("digest"))),
        F.when(F.col("record_type") == "revisit", F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(F.col("record_type") == "revisit", F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("refers_to")))),
        F.when(F.col("record_type") == "revisit", F.concat(F.lit("X-Refers-To-Page: "), F.col("refers_to").cast("string"))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.col("payload_bytes").cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF))


def write_archive(pages: DataFrame, path: str, small: int = SMALL, captured: str = "1970-01-01T00:00:00Z") -> None:
    """Write one record per row of ``pages(page_id, url, html)`` to the archive at ``path``.

    Of records with equal payloads of at least ``small`` bytes the one with the smallest page id is the response and the
    others revisit it; smaller ones are all responses.  Tables without capture times get ``captured`` in every record, so
    that the same pages make the same archive.  Defined cases: a null payload is empty; a null url gives no target
    line; rows that repeat the smallest page id are all responses; null page ids never name a response that has another id.
    """
    digests = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    digests = digests.withColumn("payload", F.encode("payload", "UTF-8")).withColumn("digest", F.unhex(F.sha2("payload", 256)))
    # Each payload once: partial aggregation leaves one copy of a payload for each task, however often it occurs.
    digests.select("digest", "payload").dropDuplicates(["digest"]).write.parquet(f"{path}/payloads")
    narrow = digests.select("page_id", "url", "digest", F.octet_length("payload").cast("bigint").alias("payload_bytes"))
    narrow.write.parquet(f"{path}/intake")
    spark = pages.sparkSession
    narrow = spark.read.parquet(f"{path}/intake")
    groups = narrow.groupBy("digest").agg(F.min("page_id").alias("keeper"), F.count("*").alias("n"))
    # Digests that fill a large share of all rows are few; they are joined by broadcast, so no key of the other join is hot.
    bound = F.greatest(F.lit(1000.0), F.lit(narrow.count() * 0.001))
    hot = narrow.join(F.broadcast(groups.filter(F.col("n") > bound)), "digest", "left")
    found = hot.filter("n is not null")
    rest = hot.filter("n is null").drop("keeper", "n").join(groups.filter(F.col("n") <= bound), "digest")
    joined = found.unionByName(rest)
    again = (F.col("payload_bytes") >= small) & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    typed = joined.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("keeper")))
    typed = typed.withColumn("captured", F.to_timestamp(F.lit(captured.removesuffix("Z")), "yyyy-MM-dd'T'HH:mm:ss"))
    typed.select("digest", record_header(typed).alias("header")).write.parquet(f"{path}/records")


def header_field(name: str) -> Column:
    """The value of a header line, null where there is none."""
    value = F.regexp_extract(F.col("header"), rf"(?m)^{name}: ([^\r]*)\r?$", 1)
    return F.when(value != "", value)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Original records: header, payload, and what the header says.  ``verified`` is false where a payload's hash differs."""
    payloads = spark.read.parquet(f"{path}/payloads")
    records = spark.read.parquet(f"{path}/records")
    # Payloads of a large share of all records are few: their records are salted over copies of them, so none is a hot key.
    limit = F.greatest(F.lit(1000.0), F.lit(records.count() * 0.001))
    hot = records.groupBy("digest").agg(F.count("*").alias("n")).filter(F.col("n") > limit).select("digest", F.lit(True).alias("hot"))
    marked = records.join(F.broadcast(hot), "digest", "left")
    copies = payloads.join(F.broadcast(hot), "digest").select("digest", "payload", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = marked.filter("hot").withColumn("salt", F.pmod(F.xxhash64("header"), F.lit(SALTS)).cast("int")).join(copies, ["digest", "salt"], "left")
    plain = marked.filter("hot is null").join(payloads, "digest", "left")
    records = salted.select("digest", "header", "payload").union(plain.select("digest", "header", "payload"))
    payload_hex = F.sha2("payload", 256)
    return records.select(
        header_field("X-Page-ID").cast("bigint").alias("page_id"),
        header_field("WARC-Target-URI").alias("url"),
        header_field("WARC-Type").alias("record_type"),
        header_field("X-Refers-To-Page").cast("bigint").alias("refers_to"),
        payload_hex.alias("payload_digest"),
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        "header",
        "payload",
        (F.concat(F.lit("sha256:"), payload_hex).eqNullSafe(header_field("WARC-Payload-Digest")) & (F.octet_length("payload") == header_field("Content-Length").cast("bigint"))).alias("verified"),
    )


def archive_round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` to an archive in the shared folder and return its records, read back; a damaged payload is an error."""
    spark = pages.sparkSession
    path = path or new_path(spark, "archive")
    write_archive(pages, path)
    found = read_archive(spark, path)
    return found.withColumn("payload_digest", F.when(F.col("verified"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a payload differs from its digest"))))


def export_warc(spark: SparkSession, path: str, target: str) -> None:
    """Write an archive's records as plain WARC files (one record after the other, payloads included) below ``target``."""
    text = F.concat("header", F.decode(F.col("payload"), "UTF-8"))
    read_archive(spark, path).select(text.alias("value")).write.option("lineSep", CRLF + CRLF).text(target)


def parse_records(chunks: Iterator[bytes]) -> Iterator[tuple[str, bytes]]:
    """(header, payload) of each record of a WARC file that comes in chunks; Content-Length decides where a payload ends.

    One record is held at a time.  A file that ends within a record is an error.
    """
    data, ended = bytearray(), False

    def upto(size: int) -> bool:
        nonlocal ended
        while len(data) < size and not ended:
            chunk = next(chunks, b"")
            ended = not chunk
            data.extend(chunk)
        return len(data) >= size

    while True:
        while upto(2) and data[:2] == b"\r\n":
            del data[:2]
        if not data:
            return
        end, seen = -1, 0
        while end < 0:
            end = data.find(b"\r\n\r\n", max(0, seen - 3))
            seen = len(data)
            if end < 0 and not upto(seen + 1):
                raise ValueError("a WARC file ends within a header")
        header = bytes(data[: end + 4]).decode()
        size = next((int(x.split(":", 1)[1]) for x in header.split(CRLF) if x.lower().startswith("content-length:")), None)
        if size is None:
            raise ValueError("a WARC record has no Content-Length")
        if not upto(end + 4 + size):
            raise ValueError("a WARC file ends within a payload")
        yield header, bytes(data[end + 4 : end + 4 + size])
        del data[: end + 4 + size]


def parse_warc(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(header, payload) of each record of a WARC file in memory."""
    return parse_records(iter([data]))


def import_warc(spark: SparkSession, source: str) -> DataFrame:
    """(header, payload) of every record of the WARC files below ``source``, a task for some files.

    Spark hands a file over whole, so files are bounded by its 2 GB for a value; records are yielded in batches of a few MB.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple[str, bytes]]) -> pa.RecordBatch:
            return pa.record_batch({"header": pa.array([h for h, _ in rows], pa.string()), "payload": pa.array([p for _, p in rows], pa.binary())})

        for batch in batches:
            for content in batch.column("content"):
                view, rows, size = memoryview(content.as_buffer()), [], 0
                for row in parse_records(bytes(view[i : i + (1 << 20)]) for i in range(0, len(view), 1 << 20)):
                    rows.append(row)
                    size += len(row[1])
                    if size > 4 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                yield batch_of(rows)

    return spark.read.format("binaryFile").load(source).select("content").mapInArrow(run, "header string, payload binary")
