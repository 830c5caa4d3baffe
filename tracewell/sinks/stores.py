"""Stores by content or key: bytes under their digest, vectors under their document, results under an idempotency key."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.contract import Contract
from tracewell.sinks.tables import _exists


class Conflict(ValueError):
    """A key is taken by something else."""


def put_bytes(df: DataFrame, content: str, path: str) -> DataFrame:
    """Adds the distinct contents of a column to a byte store and returns the digest of each row's content.

    Nothing is overwritten: a digest that is there already is not written again. Files lie in folders by the digest's
    first two digits. Null contents are left out. Map-side aggregation keeps one copy of a hot content for each task."""
    spark = df.sparkSession
    rows = df.where(F.col(content).isNotNull()).select(F.col(content).cast("binary").alias("content"))
    keyed = rows.select(F.sha2("content", 256).alias("sha256"), "content").dropDuplicates(["sha256"])
    if _exists(spark, path):
        keyed = keyed.join(spark.read.parquet(path).select("sha256"), "sha256", "left_anti")
    keyed.select("sha256", F.octet_length("content").cast("long").alias("size_bytes"), "content", F.left("sha256", F.lit(2)).alias("part")).write.mode("append").partitionBy("part").parquet(path)
    return df.select("*", F.sha2(F.col(content).cast("binary"), 256).alias("sha256"))


def get_bytes(spark: SparkSession, path: str) -> DataFrame:
    """sha256, size_bytes and content of what a byte store holds; every read recomputes digest and size and fails on a
    content that changed."""
    rows = spark.read.option("basePath", path).parquet(path)
    sound = (F.sha2("content", 256) == F.col("sha256")) & (F.octet_length("content") == F.col("size_bytes"))
    checked = F.when(sound, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("stored bytes changed: "), F.col("sha256"))).cast("binary"))
    return rows.select("sha256", "size_bytes", checked.alias("content"))


def upsert(rows: DataFrame, path: str, key: str) -> None:
    """Replaces rows of equal key and adds the rest, of equal keys among ``rows`` any one. A new version is written
    beside the old one and named in ``current`` only when it is whole."""
    spark = rows.sparkSession
    fresh = rows.dropDuplicates([key])
    if _exists(spark, f"{path}/current"):
        old = read_version(spark, path)
        fresh = fresh.unionByName(old.join(rows.select(key), key, "left_anti"))
    version = uuid.uuid4().hex
    fresh.write.parquet(f"{path}/{version}")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{path}/current")


def read_version(spark: SparkSession, path: str) -> DataFrame:
    version = spark.read.schema("version string").json(f"{path}/current").first()[0]
    return spark.read.parquet(f"{path}/{version}")


def upsert_vectors(documents: DataFrame, path: str) -> None:
    """Documents (document_id, text, vector, evidence_id, task_id, source_hash, field_name, location) into a vector table."""
    upsert(documents.select("document_id", "text", "vector", "evidence_id", "task_id", "source_hash", "field_name", "location"), path, "document_id")


def fingerprint_rows(df: DataFrame) -> DataFrame:
    """One row: how many rows a table has and two order-free sums over their hashes."""
    h = [F.xxhash64(*df.columns, F.lit(salt)) for salt in (1, 2)]
    return df.agg(F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(x.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string").alias(f"h{i}") for i, x in enumerate(h)])


def checkpoint(df: DataFrame, path: str, key: str) -> DataFrame:
    """A result kept under an idempotency key (64 hexadecimal digits), read back.

    Saving the same rows again replays what is there; other rows under the same key are a conflict."""
    if len(key) != 64 or set(key) - set("0123456789abcdef"):
        raise ValueError("a checkpoint's key is a SHA-256 in lower case")
    spark = df.sparkSession
    place = f"{path}/{key}"
    if not _exists(spark, f"{place}/_SUCCESS"):
        df.write.mode("overwrite").parquet(place)
        return spark.read.schema(df.schema).parquet(place)
    kept = spark.read.schema(df.schema).parquet(place)
    if fingerprint_rows(kept).first() != fingerprint_rows(df).first():
        raise Conflict(f"another result is kept under {key}")
    return kept


def load_registry(path: str, key: str, columns: str, max_bytes: int = 4 << 20) -> list[dict]:
    """The entries of a registry file: JSON with ``key`` (a list of objects), registry_version and content_hash.

    The file must be small, an object with these members alone, its entries must have the columns named (comma-separated)
    and content_hash must be the SHA-256 of the canonical JSON of the other members. Read beside the driver, as rules are."""
    with open(path, "rb") as f:
        raw = f.read(max_bytes + 1)
    if len(raw) > max_bytes:
        raise ValueError("registry_too_large")
    try:
        found = json.loads(raw)
    except ValueError as e:
        raise ValueError("registry_invalid_json") from e
    wanted = [c.strip() for c in columns.split(",")]
    if not isinstance(found, dict) or set(found) != {key, "registry_version", "content_hash"} or not isinstance(found[key], list) or any(not isinstance(x, dict) or not set(wanted) <= set(x) for x in found[key]):
        raise ValueError("registry_invalid_schema")
    canonical = json.dumps({k: found[k] for k in (key, "registry_version")}, sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False)
    if hashlib.sha256(canonical.encode()).hexdigest() != found["content_hash"]:
        raise ValueError("registry_hash_mismatch")
    return found[key]


def data_dictionary(spark: SparkSession, contract: Contract) -> DataFrame:
    """One row for each field of a contract, in its order: position, name, data_type, requirement, target_unit, aliases."""
    rows = [(i, f.name, f.data_type, "required" if f.required else "optional", f.unit, list(f.aliases)) for i, f in enumerate(contract.fields)]
    return spark.createDataFrame(rows, "position int, name string, data_type string, requirement string, target_unit string, aliases array<string>")


def dictionary_json(contract: Contract) -> bytes:
    """The data dictionary as canonical JSON, with the hash of its fields."""
    fields = [{"name": f.name, "data_type": f.data_type, "requirement": "required" if f.required else "optional", "target_unit": f.unit, "aliases": list(f.aliases)} for f in contract.fields]
    inner = json.dumps(fields, sort_keys=True, separators=(",", ":"), ensure_ascii=True)
    return (json.dumps({"fields": fields, "contract_hash": hashlib.sha256(inner.encode()).hexdigest()}, indent=2, sort_keys=True, ensure_ascii=True) + "\n").encode()


def report_rows(scores: DataFrame, issues: DataFrame) -> DataFrame:
    """The quality report as JSON lines: one with the verdict and counts, then one for each issue, ordered by id. scores:
    a row of status, score, gates and blocking_failures; issues: gate, severity, issue_id. Issues stay rows, as there may
    be one for each record."""
    counts = issues.agg(F.count(F.lit(1)).alias("issue_count"))
    head = scores.join(F.broadcast(counts)).select(F.lit(0).alias("part"), F.lit("").alias("id"), F.to_json(F.struct("blocking_failures", "gates", "issue_count", "score", "status")).alias("value"))
    body = issues.select(F.lit(1).alias("part"), F.col("issue_id").alias("id"), F.to_json(F.struct("gate", "issue_id", "severity")).alias("value"))
    return head.unionByName(body)


def write_report(scores: DataFrame, issues: DataFrame, path: str) -> None:
    report_rows(scores, issues).orderBy("part", "id").select("value").write.text(path)


def package(spark: SparkSession, path: str, target: str, max_bytes: int = 64 << 20) -> list[tuple[str, int, str]]:
    """A ZIP of the files below a path, for delivery: sorted names, fixed times, a manifest with sizes and digests inside,
    and each member read back and compared. Made beside the driver, so only up to ``max_bytes``."""
    import io
    import zipfile

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    total = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    if total > max_bytes:
        raise ValueError("package_too_large")
    root = path.rstrip("/")
    members = sorted((r.path.split(root + "/", 1)[-1], bytes(r.content)) for r in files.select("path", "content").collect())
    manifest = [(n, len(c), hashlib.sha256(c).hexdigest()) for n, c in members]
    lines = "".join(json.dumps({"bytes": b, "name": n, "sha256": s}, sort_keys=True, separators=(",", ":")) + "\n" for n, b, s in manifest)
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in [("manifest.jsonl", lines.encode()), *members]:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), content, zipfile.ZIP_DEFLATED)
    with zipfile.ZipFile(io.BytesIO(buffer.getvalue())) as z:
        if any(hashlib.sha256(z.read(n)).hexdigest() != s for n, _, s in manifest):
            raise ValueError("package_differs")
    with open(target, "wb") as f:
        f.write(buffer.getvalue())
    return manifest
