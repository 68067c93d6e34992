"""A content-addressed WARC archive.

write_archive() keeps two tables: `payloads`, each distinct payload's bytes once under their SHA-256, and `records`, the
exact header block of each record. A payload is verified on the way in, by comparing the bytes under a digest (two
payloads under one digest stop the write), and on the way out, by digesting the stored bytes again. read_archive() parses
the header blocks and joins them with the payloads; its `record` column is the record as it stands in a WARC file, and
warc_records() parses such bytes.

Of records with equal payloads of at least `least` bytes the one with the smallest page_id is a response, the others
revisit it; smaller payloads are responses always.

Edge cases: null html is an empty payload; a null url has no WARC-Target-URI line, line breaks and other control characters
in a url are percent-coded; a null page_id comes after all others and is written as an empty id; of rows that repeat a
page_id and payload one is the response and the others revisit it; an empty table makes an empty archive; other columns
are ignored, whatever their names. Groups of equal payloads combine on the map side, and only ids and digests are joined.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import registered, shared_dir, written

#: Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST = 100


def _line(name: str, value) -> object:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise(F.lit(""))


def _id(column, row) -> object:
    """A record's id: the page's, and the row's number, which tells rows that repeat a page_id apart."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(column.cast("string"), F.lit("")), F.lit(":"), row.cast("string"), F.lit(">"))


def write_archive(pages: DataFrame, path: str, *, least: int = LEAST, date: str = "2000-01-01T00:00:00Z") -> None:
    """pages: page_id, url, html. Writes the two tables under path."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    whole = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.unhex(F.sha2("payload", 256)))
    stored = whole.groupBy("digest").agg(F.min("payload").alias("payload"), F.max("payload").alias("other"), F.count(F.lit(1)).alias("uses"))
    clash = F.raise_error(F.lit("two payloads have one SHA-256")).cast("binary")
    stored.select("digest", F.when(F.col("payload") == F.col("other"), F.col("payload")).otherwise(clash).alias("payload"), "uses").write.parquet(f"{path}/payloads")
    rows = written(whole.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", "digest", F.octet_length("payload").cast("long").alias("bytes")), "records")
    order = F.struct(F.col("page_id").isNull().alias("last"), F.col("page_id").alias("id"), F.col("row").alias("row"))
    firsts = rows.filter(F.col("bytes") >= least).groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = firsts.filter("n > 1").select("digest", F.col("first.id").alias("first_id"), F.col("first.row").alias("first_row"))
    joined = rows.join(firsts, "digest", "left")
    again = F.col("first_row").isNotNull() & (F.col("first_row") != F.col("row"))
    url = F.col("url")
    for code in (*range(32), 127):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    header = F.concat(
        F.lit(f"{VERSION}\r\n"),
        _line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", _id(F.col("page_id"), F.col("row"))),
        _line("WARC-Target-URI", url),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.lower(F.hex("digest")))),
        _line("WARC-Profile", F.when(again, F.lit(PROFILE))),
        _line("WARC-Refers-To", F.when(again, _id(F.col("first_id"), F.col("first_row")))),
        _line("Content-Type", F.lit("text/html;charset=utf-8")),
        _line("Content-Length", F.when(again, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit("\r\n"),
    )
    joined.select(header.cast("binary").alias("header")).write.parquet(f"{path}/records")


def _field(name: str) -> object:
    """A header field's value, null if there is no such line."""
    text = F.col("header").cast("string")
    return F.when(text.contains(f"\r\n{name}: "), F.regexp_extract(text, f"\r\n{name}: ([^\r\n]*)\r\n", 1))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Returns page_id, url, record_type, refers_to, payload_digest, payload_bytes, verified, header, payload, record, one row per record."""
    stored = spark.read.schema("digest binary, payload binary, uses long").parquet(f"{path}/payloads")
    payloads = stored.select(
        F.lower(F.hex("digest")).alias("payload_digest"),
        "payload",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        (F.sha2("payload", 256) == F.lower(F.hex("digest"))).alias("verified"),
    )
    number = lambda name: F.nullif(F.regexp_extract(_field(name), "<urn:page:(-?[0-9]*):[0-9]+>", 1), F.lit("")).cast("long")
    records = spark.read.schema("header binary").parquet(f"{path}/records").select(
        number("WARC-Record-ID").alias("page_id"),
        _field("WARC-Target-URI").alias("url"),
        _field("WARC-Type").alias("record_type"),
        number("WARC-Refers-To").alias("refers_to"),
        F.regexp_extract(_field("WARC-Payload-Digest"), "sha256:([0-9a-f]+)", 1).alias("payload_digest"),
        "header",
    )
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return records.join(payloads, "payload_digest", "left").withColumn("record", F.concat("header", block, F.lit(b"\r\n\r\n")))


def warc_records(data: bytes):
    """Parses the bytes of a WARC file: yields (fields, header block, block) of each record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}
        stop = end + int(fields["content-length"])
        if stop + 4 > len(data) or data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut short")
        yield fields, data[at:end], data[end:stop]
        at = stop + 4


def read_warc_files(spark: SparkSession, path: str) -> DataFrame:
    """Reads WARC files through Spark's binary reader: file, place, record_type, url, header, payload."""

    def parse(batches):
        import pandas as pd

        for batch in batches:
            rows = [
                (file, i, f.get("warc-type"), f.get("warc-target-uri"), header, block)
                for file, data in zip(batch["path"], batch["content"], strict=True)
                for i, (f, header, block) in enumerate(warc_records(bytes(data)))
            ]
            yield pd.DataFrame(rows, columns=["file", "place", "record_type", "url", "header", "payload"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, "file string, place int, record_type string, url string, header binary, payload binary")


def op4_warc(spark, sf_dir: str) -> DataFrame:
    path = registered(f"{shared_dir(spark).rstrip('/')}/quillstone/archive-{uuid.uuid4().hex}")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    back = read_archive(spark, path)
    digest = F.when(F.col("verified"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a stored payload does not have its digest")).cast("string"))
    return back.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")
