"""WARC archive with content-addressed payloads.

``write_archive`` keeps two tables: ``payloads`` has each distinct payload once, under its SHA-256, and ``headers`` has
the exact WARC and HTTP header bytes of every record with the digest that its payload is found under. ``read_archive``
joins the two on the digest and rebuilds each record byte by byte; a payload whose bytes no longer give its digest
fails the read.

Nulls and ties: a null payload is empty. CR and LF in an address are written as %0D and %0A, as no header line can hold
them; every other character stays as it is. A null key is written as an empty target and counts as the largest key when
the response of a group of equal payloads is chosen, unless the whole group has none. Rows that repeat both key and
payload are one group member each and share the record type. Empty tables give empty archives. Other columns of the
input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.storage import shared_dir, written

CRLF = "\r\n"
#: Groups of equal payloads up to which they are broadcast (at about 150 bytes each); beyond, a join is shuffled.
BROADCAST_GROUPS = 200_000
#: Payloads below this many bytes are never written as revisits.
REVISIT_BYTES = 100
#: The profile of revisits that WARC 1.1 names, and the date that all records carry.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def _headers(revisit_bytes: int) -> list[Column]:
    """record_type, refers_to, and the exact header bytes: WARC header, empty line, HTTP header, empty line."""
    revisit = (F.col("payload_bytes") >= revisit_bytes) & ~F.col("_key").eqNullSafe(F.col("_first"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}"),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.col("payload_bytes").cast("string")),
        F.lit(CRLF),
    )
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    uri = F.coalesce(F.replace(F.replace(F.col("_uri"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit(""))
    record_type = F.when(revisit, "revisit").otherwise("response")
    warc = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", record_type),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("_key").cast("string"), F.lit("")), F.lit(">"))),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", uri),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(_line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("_first").cast("string"), F.lit(">"))), _line("WARC-Profile", F.lit(REVISIT_PROFILE)))).otherwise(""),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", block.cast("string")),
        F.lit(CRLF),
    )
    return [
        record_type.alias("record_type"),
        F.when(revisit, F.col("_first")).alias("refers_to"),
        F.encode(F.concat(warc, http), "UTF-8").alias("header"),
    ]


def write_archive(df: DataFrame, path: str, key: str, uri: str, payload: str, revisit_bytes: int = REVISIT_BYTES) -> None:
    """Writes ``path/payloads`` (digest, payload_bytes, payload) and ``path/headers`` (key, digest, header)."""
    body = F.coalesce(F.encode(df[payload].cast("string"), "UTF-8"), F.lit(b""))
    rows = df.select(df[key].alias("_key"), df[uri].cast("string").alias("_uri"), body.alias("payload"))
    keyed = rows.select("*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    # digests and keys alone are shuffled to choose who holds a payload; map-side sums keep hot payloads small
    groups = keyed.groupBy("digest").agg(F.min("_key").alias("_first"), F.count(F.lit(1)).alias("_copies"))
    first = written(groups, "warc-groups")
    repeated = first.where("_copies > 1").select(F.col("digest").alias("_d"), "_first")
    holds = (F.col("digest") == F.col("_d")) & F.col("_key").eqNullSafe(F.col("_first"))
    if repeated.count() <= BROADCAST_GROUPS:
        # payloads that occur once, nearly all of them, are stored where they are read, without a shuffle
        once = keyed.join(F.broadcast(repeated), F.col("digest") == F.col("_d"), "left_anti")
        held = keyed.join(F.broadcast(repeated), holds).dropDuplicates(["digest", "_key"])
        stored = once.select("digest", "payload_bytes", "payload").unionAll(held.select("digest", "payload_bytes", "payload"))
    else:
        # (digest, key) spreads the copies of a payload over tasks; the holder alone matches
        holders = first.select(F.col("digest").alias("_d"), "_first")
        stored = keyed.join(holders, holds).dropDuplicates(["digest", "_key"]).select("digest", "payload_bytes", "payload")
    stored.write.parquet(f"{path}/payloads")
    first = first.select("digest", "_first")
    light = keyed.select("_key", "_uri", "digest", "payload_bytes").join(first, "digest")
    light.select(F.col("_key").alias("key"), "digest", *_headers(revisit_bytes)).select("key", "digest", "header").write.parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record of an archive: key, digest, header, payload (checked against its digest) and record.

    ``record`` is the whole WARC record; a revisit's block ends after the HTTP header, its payload is that of the
    record it refers to.
    """
    bodies = spark.read.parquet(f"{path}/payloads")
    checked = bodies.select(
        "digest",
        F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload"))
        .otherwise(F.raise_error(F.concat(F.lit("payload does not give its digest "), F.col("digest"))).cast("binary"))
        .alias("payload"),
    )
    heads = spark.read.parquet(f"{path}/headers")
    own = F.when(header_field(F.col("header"), "WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return heads.join(checked, "digest").select(
        "key", "digest", "header", "payload", F.concat(F.col("header"), own, F.lit((CRLF * 2).encode())).alias("record")
    )


def header_field(header: Column, name: str) -> Column:
    """The value of a WARC header line, '' where there is none. Lines end with CR and LF and with nothing else."""
    return F.regexp_extract(F.decode(header, "UTF-8"), rf"\r\n{name}: ([^\r\n]*)\r\n", 1)


def export_warc(spark: SparkSession, path: str, target: str) -> None:
    """The archive as gzipped .warc text files: records end with an empty line pair, which is the writer's separator."""
    records = read_archive(spark, path).select(F.expr("cast(substring(record, 1, octet_length(record) - 4) as string)").alias("value"))
    records.write.option("lineSep", CRLF * 2).option("compression", "gzip").text(target)


def archive_records(df: DataFrame, key: str, uri: str, payload: str) -> DataFrame:
    """Writes ``df`` as an archive in the shared folder, reads it back and returns what the records say."""
    spark = df.sparkSession
    path = shared_dir(spark, "warc")
    write_archive(df, path, key, uri, payload)
    back = read_archive(spark, path)
    refers = F.regexp_extract(header_field(F.col("header"), "WARC-Refers-To"), r"^<urn:page:(.*)>$", 1)
    kind = header_field(F.col("header"), "WARC-Type")
    # a response's payload is read out of its record: what follows both headers, up to the empty lines at the end
    inside = F.expr("substring(record, octet_length(header) + 1, octet_length(record) - octet_length(header) - 4)")
    payload = F.when(kind == "response", inside).otherwise(F.col("payload"))
    block = header_field(F.col("header"), "Content-Length").cast("long")
    whole = F.octet_length("record") == F.expr("octet_length(split_part(decode(header, 'UTF-8'), '\\r\\n\\r\\n', 1))") + 4 + block + 4
    rows = back.select(F.col("key").alias(key), payload.alias("payload"), kind.alias("record_type"), F.when(refers != "", refers).cast("long").alias("refers_to"), whole.alias("_whole"), F.octet_length("record").cast("long").alias("record_bytes"))
    length = F.octet_length("payload").cast("long")
    return rows.select(
        key,
        F.when(F.col("_whole"), length).otherwise(F.raise_error(F.lit("a record is not as long as its header says")).cast("long")).alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
        "record_type",
        "refers_to",
        "record_bytes",
    )
