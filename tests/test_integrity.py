"""Sealed tables: planted changes are found, only differing leaves are read, and broken seals are refused."""

import glob
import shutil

import pytest
from pyspark.sql import functions as F

from tracewell.operators import integrity as G

SCHEMA = "k long, v string, w double"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def base():
    return [(i, f"v{i}", i / 7) for i in range(0, 3000, 2)] + [(None, "n", None), (None, "n", None), (10, "again", 1.0)] + [(500, "hot", 0.5)] * 300


def brute(a, b):
    out = {}
    for k in {r[0] for r in a} | {r[0] for r in b}:
        x, y = (sorted(map(repr, (r for r in rows if r[0] == k))) for rows in (a, b))
        if x != y:
            out[k] = "added" if not x else "removed" if not y else "changed"
    return out


def test_planted_changes(spark, tmp_path):
    a = base()
    b = [r for r in a if r[0] != 44] + [(45, "new", 1.0), (500, "hot", 0.5), (None, None, None)]
    b[b.index((100, "v100", 100 / 7))] = (100, "", 100 / 7)
    first, second = str(tmp_path / "a"), str(tmp_path / "b")
    df, other = table(spark, a), table(spark, b)
    assert G.seal(df, "k", first, leaves=64) != G.seal(other, "k", second, like=first)
    assert {r.k: r.change for r in G.changes(spark, first, second, df.schema).collect()} == brute(a, b)
    leaves = G.changed_leaves(spark, first, second)
    assert 0 < len(leaves) <= 5
    plan = G.changes(spark, first, second, df.schema)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "leaf" in plan
    # rows of equal leaves are not read: without them the answer is the same
    for folder in (first, second):
        for leaf in glob.glob(f"{folder}/rows/leaf=*"):
            if int(leaf.rpartition("=")[2]) not in leaves:
                shutil.rmtree(leaf)
    assert {r.k: r.change for r in G.changes(spark, first, second, df.schema).collect()} == brute(a, b)


def test_order_does_not_matter_and_equal_tables_have_one_root(spark, tmp_path):
    rows, first, second = base(), str(tmp_path / "a"), str(tmp_path / "b")
    root = G.seal(table(spark, rows), "k", first, leaves=16)
    assert G.seal(table(spark, rows[::-1]).repartition(7), "k", second, like=first) == root == G.verify(spark, second, table(spark, rows).schema)
    assert G.changed_leaves(spark, first, second) == [] and G.changes(spark, first, second, table(spark, rows).schema).count() == 0


@pytest.mark.parametrize("harm", ["row", "lost", "tree", "manifest"])
def test_broken_seals_are_refused(spark, tmp_path, harm):
    path = str(tmp_path / "a")
    df = table(spark, base())
    G.seal(df, "k", path, leaves=16)
    assert G.verify(spark, path, df.schema)
    if harm == "row":
        leaf = sorted(glob.glob(f"{path}/rows/leaf=*"))[3]
        rows = spark.read.parquet(leaf).withColumn("v", F.when(F.col("k") == F.lit(spark.read.parquet(leaf).first().k), "x").otherwise(F.col("v"))).toPandas()
        shutil.rmtree(leaf)
        spark.createDataFrame(rows, "k long, v string, w double, row_sha256 string").write.parquet(leaf)
    elif harm == "lost":
        shutil.rmtree(sorted(glob.glob(f"{path}/rows/leaf=*"))[2])
    elif harm == "tree":
        nodes = spark.read.parquet(f"{path}/tree").toPandas()
        nodes.loc[nodes.level == 1, "digest"] = "0" * 64
        shutil.rmtree(f"{path}/tree")
        spark.createDataFrame(nodes, "level int, node int, rows long, digest string").write.parquet(f"{path}/tree")
    else:
        shutil.rmtree(f"{path}/manifest")
        spark.createDataFrame([("k", "0" * 64, 1)], "key string, root string, rows long").write.json(f"{path}/manifest")
    with pytest.raises(G.IntegrityError):
        G.verify(spark, path, df.schema)


def test_empty_tables(spark, tmp_path):
    df = table(spark, base())
    paths = [str(tmp_path / n) for n in "abc"]
    root = G.seal(df.limit(0), "k", paths[0])
    assert G.seal(df.limit(0), "k", paths[1], like=paths[0]) == root and G.changes(spark, paths[0], paths[1], df.schema).count() == 0
    G.seal(df.where("k = 10"), "k", paths[2], like=paths[0])
    assert [(r.k, r.change) for r in G.changes(spark, paths[0], paths[2], df.schema).collect()] == [(10, "added")]
