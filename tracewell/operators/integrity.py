"""Sealed tables: rows in key ranges under a Merkle tree, so that a change is found without comparing all rows.

A leaf is a range of keys between cuts that the first table chooses by quantiles and later versions of it share. Its digest
covers the number of its rows and order-free sums over their SHA-256 digests; a node's digest covers those of its
children in order, up to the root, which the manifest names. Verifying recomputes every digest from the rows and fails
closed. Comparing two seals walks down from the roots, level by level, and reads the rows of differing leaves alone.

There are at most ``LEAVES`` leaves however large a table is, so trees and lists of leaves are bounded; a leaf's rows may
lie in any number of files, so a key that very many rows have is no single task. Nulls and edge cases: null keys lie in
the first leaf; rows may share a key and repeat; null differs from an empty text; an empty table has a root too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAVES, FANOUT = 4096, 16


class IntegrityError(ValueError):
    """A sealed table is not what its digests say."""


def row_digest(df: DataFrame) -> Column:
    """SHA-256 over all columns by name; each value has its length before it, null has none."""
    parts = []
    for c in sorted(df.columns):
        value = df[c].cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


def _leaf_digests(rows: DataFrame) -> DataFrame:
    """leaf, rows and digest; rows: leaf and row_sha256."""
    word = lambda i: F.conv(F.substring("row_sha256", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")
    sums = [F.sum(word(i)).cast("string").alias(f"s{i}") for i in range(4)]
    summed = rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("rows"), *sums)
    return summed.select("leaf", "rows", F.sha2(F.concat_ws(",", F.col("rows").cast("string"), *(f"s{i}" for i in range(4))), 256).alias("digest"))


def tree(leaves: DataFrame) -> DataFrame:
    """level, node, rows and digest of all nodes; leaves (leaf, rows, digest) are level 0, the last level is the root."""
    spark = leaves.sparkSession
    level = leaves.select(F.lit(0).alias("level"), F.col("leaf").alias("node"), "rows", "digest")
    out, depth, width = level, 0, LEAVES
    while width > 1:
        width, depth = -(-width // FANOUT), depth + 1
        children = F.array_sort(F.collect_list(F.struct("node", "digest")))  # at most FANOUT of them
        level = level.groupBy((F.col("node") / FANOUT).cast("int").alias("up")).agg(F.sum("rows").alias("rows"), children.alias("c"))
        named = F.transform("c", lambda x: F.concat(x["node"].cast("string"), F.lit("="), x["digest"]))
        level = level.select(F.lit(depth).alias("level"), F.col("up").alias("node"), "rows", F.sha2(F.array_join(named, ","), 256).alias("digest"))
        out = out.unionByName(level)
    if leaves.isEmpty():
        return spark.createDataFrame([(depth, 0, 0, "0" * 64)], "level int, node int, rows long, digest string")
    return out


def _leaf(key: Column, cuts: list) -> Column:
    """Number of the range that a key lies in."""
    return F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c < key)) if cuts else F.lit(0)


def seal(df: DataFrame, key: str, path: str, like: str | None = None, leaves: int = 256) -> str:
    """Writes a table with its tree and returns the root's digest. like: the seal whose cuts are shared."""
    spark = df.sparkSession
    if leaves > LEAVES:
        raise ValueError(f"at most {LEAVES} leaves")
    if like is not None:
        cuts = [r[0] for r in spark.read.parquet(f"{like}/cuts").orderBy("cut").collect()]  # fewer than LEAVES
    else:
        found = df.agg(F.percentile_approx(key, [i / leaves for i in range(1, leaves)], 10 * leaves)).first()[0] if leaves > 1 else None
        cuts = sorted(set(found or []))
    spark.createDataFrame([(c,) for c in cuts], f"cut {dict(df.dtypes)[key]}").write.parquet(f"{path}/cuts")
    cut = F.lit(0) if not cuts else F.coalesce(F.when(F.col(key).isNull(), 0), _leaf(F.col(key), cuts))
    rows = df.withColumn("row_sha256", row_digest(df)).withColumn("leaf", cut)
    rows.hint("rebalance", "leaf").write.partitionBy("leaf").parquet(f"{path}/rows")
    stored = _rows(spark, path, df.schema)
    nodes = tree(_leaf_digests(stored))
    nodes.write.parquet(f"{path}/tree")
    root = _nodes(spark, path).orderBy(F.desc("level")).first()
    spark.createDataFrame([(key, root.digest, root.rows)], "key string, root string, rows long").write.json(f"{path}/manifest")
    return root.digest


def _rows(spark: SparkSession, path: str, schema=None) -> DataFrame:
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema] if schema is not None else None
    reader = spark.read.schema(", ".join([*names, "row_sha256 string", "leaf int"])) if names else spark.read
    return reader.parquet(f"{path}/rows")


def _nodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("level int, node int, rows long, digest string").parquet(f"{path}/tree")


def _manifest(spark: SparkSession, path: str):
    return spark.read.schema("key string, root string, rows long").json(f"{path}/manifest").first()


def broken(spark: SparkSession, path: str, schema) -> DataFrame:
    """level, node and what is wrong: rows whose digest is not theirs (row), leaves and nodes whose digest is not that of what
    lies below (digest), and nodes that only one side has (missing, unknown)."""
    rows = _rows(spark, path, schema)
    own = rows.select(*schema.names)
    fresh = rows.withColumn("_own", row_digest(own))
    wrong = fresh.where("_own <> row_sha256 or row_sha256 is null").groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
    told = _nodes(spark, path).select("level", "node", F.col("digest").alias("told"), F.col("rows").alias("told_rows"))
    found = tree(_leaf_digests(fresh.select("leaf", F.col("_own").alias("row_sha256"))))
    both = told.join(found, ["level", "node"], "full")
    same = F.col("told").eqNullSafe(F.col("digest")) & F.col("told_rows").eqNullSafe(F.col("rows"))
    problem = F.when(F.col("told").isNull(), "unknown").when(F.col("digest").isNull(), "missing").otherwise("digest")
    return both.where(~same).select("level", "node", problem.alias("problem")).unionByName(wrong.select(F.lit(0).alias("level"), F.col("leaf").alias("node"), F.lit("row").alias("problem")))


def verify(spark: SparkSession, path: str, schema) -> str:
    """The root's digest of a seal whose every row and node is as its digests say; IntegrityError otherwise."""
    bad = broken(spark, path, schema).orderBy("level", "node", "problem").limit(5).collect()
    if bad:
        raise IntegrityError("; ".join(f"level {r.level} node {r.node}: {r.problem}" for r in bad))
    told, root = _manifest(spark, path), _nodes(spark, path).orderBy(F.desc("level")).first()
    if told is None or (told.root, told.rows) != (root.digest, root.rows):
        raise IntegrityError("the manifest names another root")
    return root.digest


def changed_leaves(spark: SparkSession, a: str, b: str) -> list[int]:
    """Leaves that differ between two seals with the same cuts, by descent from the roots."""
    top = _nodes(spark, a).agg(F.max("level")).first()[0]
    nodes = [_nodes(spark, p).select("level", "node", F.col("digest").alias(d)) for p, d in ((a, "_a"), (b, "_b"))]
    both = nodes[0].join(nodes[1], ["level", "node"], "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).select("level", "node")
    left = both.where(F.col("level") == top).select("node")
    for level in range(top - 1, -1, -1):
        below = both.where(F.col("level") == level)
        left = below.join(left.select(F.col("node").alias("_up")), (F.col("node") / FANOUT).cast("int") == F.col("_up"), "left_semi").select("node")
    return sorted(r.node for r in left.collect())  # at most LEAVES


def changes(spark: SparkSession, a: str, b: str, schema) -> DataFrame:
    """key and change (added, removed, changed) of the rows in which two seals differ; rows of equal leaves are not read.
    A key that several rows have is changed if any of them is."""
    key = _manifest(spark, a).key
    leaves = changed_leaves(spark, a, b)
    side = lambda p, n: _rows(spark, p, schema).where(F.col("leaf").isin(leaves) if leaves else F.lit(False)).select(F.col(key), "row_sha256", F.lit(n).alias("_side"))
    rows = side(a, 1).unionByName(side(b, -1))
    counted = rows.groupBy(key, "row_sha256").agg(F.sum("_side").alias("_d"), F.count_if(F.col("_side") == 1).alias("_a"), F.count_if(F.col("_side") == -1).alias("_b"))
    by_key = counted.groupBy(key).agg(F.max(F.col("_d") != 0).alias("_differs"), F.sum("_a").alias("_a"), F.sum("_b").alias("_b")).where("_differs")
    return by_key.select(key, F.when(F.col("_a") == 0, "added").when(F.col("_b") == 0, "removed").otherwise("changed").alias("change"))
