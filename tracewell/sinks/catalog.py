"""A catalog of several tables that change together: write, audit, publish.

A commit writes the new rows of every table into folders that no reader knows, checks them, and then publishes them all at
once: one record, whose name is the next version, is moved to its place by a rename that fails where a record of that name
is. Readers take the newest record, so they see all of a commit or none; a writer that finds its version taken begins
again from the newer state. What a crash leaves behind is never seen and ``recover`` deletes it. Rows are added by key and
never changed: a key that is there already is ignored.

Through the driver go records alone, whose size grows with the number of commits. Nulls and edge cases: a null key fails
the audit; of rows that share a key the least by all columns is taken; empty tables commit nothing but their record.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.sinks.stores import Conflict


class AuditFailed(ValueError):
    """Staged rows break a rule; nothing was published."""


@dataclass(frozen=True)
class Table:
    """A table's key, the columns that must not be null, and a parent (column, table) that its rows must have."""

    key: str
    schema: str
    required: tuple[str, ...] = ()
    parent: tuple[str, str] | None = None


#: The tables of an acquisition: what was stored, how it came, what failed, and what was made of it.
ACQUISITION = {
    "artifacts": Table("byte_sha256", "byte_sha256 string, size_bytes long, media_type string, artifact_kind string, storage_uri string", ("size_bytes", "media_type")),
    "acquisitions": Table("event_id", "event_id string, locator_hash string, byte_sha256 string, source_url string, source_title string, status string", ("locator_hash", "byte_sha256"), ("byte_sha256", "artifacts")),
    "failures": Table("event_id", "event_id string, locator_hash string, source_url string, source_title string, error_code string, retryable boolean", ("error_code", "retryable")),
    "reflections": Table("proof_hash", "proof_hash string, iteration int, input_query string, gaps string, decision string, next_query string, useful_artifact_count int", ("decision",)),
    "qualifications": Table("qualification_id", "qualification_id string, reflection_proof_hash string, byte_sha256 string, confidence double, accepted boolean, rationale string", ("accepted",), ("reflection_proof_hash", "reflections")),
}


@dataclass
class Catalog:
    spark: SparkSession
    path: str
    tables: dict[str, Table] = field(default_factory=lambda: dict(ACQUISITION))

    def __post_init__(self) -> None:
        jvm = self.spark._jvm
        self._place = jvm.org.apache.hadoop.fs.Path
        self._files = self._place(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    # records ---------------------------------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        """Published versions, oldest first."""
        folder = self._place(f"{self.path}/commits")
        if not self._files.exists(folder):
            return []
        return sorted(int(s.getPath().getName()) for s in self._files.listStatus(folder) if s.getPath().getName().isdigit())

    def record(self, version: int | None = None) -> dict:
        """The record of a version, the newest if none is named; before the first commit an empty one."""
        if version is None:
            known = self.versions()
            if not known:
                return {"version": 0, "folders": {}, "rows": {}}
            version = known[-1]
        stream = self._files.open(self._place(f"{self.path}/commits/{version:012d}"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _publish(self, record: dict) -> None:
        """Moves a finished record to its place; Conflict if a record is there."""
        draft = self._place(f"{self.path}/drafts/{record['txn']}")
        stream = self._files.create(draft, True)
        stream.write(bytearray(json.dumps(record, sort_keys=True).encode()))
        stream.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        self._files.mkdirs(self._place(f"{self.path}/commits"))
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = gateway.new_array(kind, 1)
        options[0] = kind.NONE
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(draft, self._place(f"{self.path}/commits/{record['version']:012d}"), options)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {record['version']} is taken") from e
            raise

    # rows ------------------------------------------------------------------------------------------------------------

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a version."""
        return self._of(name, self.record(version))

    def _of(self, name: str, record: dict) -> DataFrame:
        folders, schema = record["folders"].get(name, []), self.tables[name].schema
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def _stage(self, name: str, rows: DataFrame, record: dict, txn: str) -> tuple[str, int]:
        """Writes the rows whose key the version lacks."""
        own = self.tables[name]
        columns = [f.split(" ")[0] for f in own.schema.split(", ")]
        typed = self.spark.createDataFrame([], own.schema).unionByName(rows.select(*columns))
        least = typed.groupBy(own.key).agg(F.min(F.struct(*columns)).alias("_r")).select("_r.*")
        fresh = least.join(self._of(name, record).select(own.key), own.key, "left_anti")
        folder = f"data/{name}/{txn}"
        fresh.select(*columns).write.parquet(f"{self.path}/{folder}")
        return folder, self.spark.read.schema(own.schema).parquet(f"{self.path}/{folder}").count()

    def _audit(self, record: dict, staged: dict[str, str]) -> None:
        after = {n: DataFrame.unionByName(self._of(n, record), self.spark.read.schema(self.tables[n].schema).parquet(f"{self.path}/{staged[n]}")) if n in staged else self._of(n, record) for n in self.tables}
        for name, folder in staged.items():
            own = self.tables[name]
            rows = self.spark.read.schema(own.schema).parquet(f"{self.path}/{folder}")
            missing = F.lit(False)
            for c in (own.key, *own.required):
                missing = missing | F.col(c).isNull()
            if not rows.where(missing).isEmpty():
                raise AuditFailed(f"{name}: a required value is missing")
            if own.parent:
                column, parent = own.parent
                known = after[parent].select(F.col(self.tables[parent].key).alias(column))
                if not rows.where(F.col(column).isNotNull()).join(known, column, "left_anti").isEmpty():
                    raise AuditFailed(f"{name}: a row of {parent} is missing")

    def commit(self, rows: dict[str, DataFrame], tries: int = 5) -> int:
        """Adds the rows of some tables in one step and returns the version. A version that another writer takes meanwhile
        is tried again, on top of what that writer published; after ``tries`` times the conflict is raised."""
        for attempt in range(tries):
            record, txn = self.record(), uuid.uuid4().hex
            staged, counts = {}, {}
            try:
                for name, df in rows.items():
                    staged[name], counts[name] = self._stage(name, df, record, txn)
                self._audit(record, staged)
            except AuditFailed:
                self._delete(staged.values())
                raise
            new = {
                "version": record["version"] + 1,
                "txn": txn,
                "folders": {n: [*record["folders"].get(n, []), *([staged[n]] if counts.get(n) else [])] for n in self.tables},
                "rows": {n: record["rows"].get(n, 0) + counts.get(n, 0) for n in self.tables},
            }
            try:
                self._publish(new)
            except Conflict:
                self._delete([*staged.values(), f"drafts/{txn}"])
                if attempt + 1 == tries:
                    raise
                continue
            self._delete(f for n, f in staged.items() if not counts[n])
            return new["version"]
        raise Conflict("no try was made")

    def _delete(self, folders) -> None:
        for f in folders:
            self._files.delete(self._place(f"{self.path}/{f}"), True)

    def recover(self) -> list[str]:
        """Deletes what commits that never were published left, and returns it. No writer may be at work meanwhile."""
        kept = {f for v in self.versions() for own in self.record(v)["folders"].values() for f in own}
        gone = []
        for name in self.tables:
            folder = self._place(f"{self.path}/data/{name}")
            if self._files.exists(folder):
                gone += [f"data/{name}/{s.getPath().getName()}" for s in self._files.listStatus(folder) if f"data/{name}/{s.getPath().getName()}" not in kept]
        drafts = self._place(f"{self.path}/drafts")
        if self._files.exists(drafts):
            gone += [f"drafts/{s.getPath().getName()}" for s in self._files.listStatus(drafts) if not s.getPath().getName().startswith(".")]
        self._delete(gone)
        return sorted(gone)

    def summary(self, version: int | None = None) -> DataFrame:
        """One row: how many rows each table has and how many bytes are stored; counted, not taken from the record."""
        record = self.record(version)
        out = self._of("artifacts", record).agg(F.count(F.lit(1)).alias("artifacts"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("stored_bytes"))
        for name in self.tables:
            if name != "artifacts":
                out = out.crossJoin(self._of(name, record).agg(F.count(F.lit(1)).alias(name)))  # one row on either side
        return out.withColumn("version", F.lit(record["version"]).cast("long"))
