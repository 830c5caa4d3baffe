"""Differences of snapshots against brute force, and against SQL on the driver's tables."""

import hashlib
import os
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tracewell.llm import snapdiff

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, side string, level int"
COLUMNS = ["text", "lang", "source"]


def sha(row):
    return hashlib.sha256("\n".join("~" if v is None else v for v in row).encode()).hexdigest()


def brute(old, new):
    """By the contract, for keys that occur once in each snapshot."""
    a, b = ({k: tuple(v) for k, *v in rows} for rows in (old, new))
    out = []
    for k in a.keys() & b.keys():
        changed = ",".join(c for c, x, y in zip(COLUMNS, a[k], b[k]) if x != y)
        out.append((k, k, "update" if changed else "same", changed, sha(b[k])))
    lone = defaultdict(lambda: ([], []))
    for k in a.keys() - b.keys():
        lone[a[k]][0].append(k)
    for k in b.keys() - a.keys():
        lone[b[k]][1].append(k)
    rank = lambda k: (k is not None, k)
    for content, (gone, come) in lone.items():
        gone.sort(key=rank), come.sort(key=rank)
        for i in range(max(len(gone), len(come))):
            if i < len(gone) and i < len(come):
                out.append((come[i], gone[i], "rekey", "", sha(content)))
            elif i < len(come):
                out.append((come[i], None, "insert", "", sha(content)))
            else:
                out.append((gone[i], gone[i], "delete", "", None))
    return Counter(out)


def run(spark, old, new, parts=5):
    frame = lambda rows: spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA).repartition(parts)
    return Counter(map(tuple, snapdiff.diff(frame(old), frame(new), "doc_id", COLUMNS).collect()))


def rows(keys, seed=0):
    return [(k, f"text {zlib.crc32(f'{seed} {k}'.encode()) % 40}", ["en", "de", None][(k or 0) % 3], "a\nb") for k in keys]


def test_mixed_changes_nulls_and_groups_of_copies(spark):
    old = rows([*range(-50, 400), None]) + [(1000 + i, "copy", "en", None) for i in range(120)] + [(5000, None, None, None), (5001, "", None, None), (5002, "a", "b\nc", "d"), (5003, "~", None, "~")]
    new = [(k if k is None or k % 5 else -1000 - k, t + "+" * (k is not None and k % 7 == 0), g, s) for k, t, g, s in old[:451] if k is None or k % 11]
    new += [(3000 - i, "copy", "en", None) for i in range(150)] + [(6000, None, None, None), (6001, "", None, None), (6002, "a\nb", "c", "d"), (6003, None, "~", None)]
    got = run(spark, old, new)
    assert got == brute(old, new)
    assert {op for _, _, op, _, _ in got} == {"same", "update", "rekey", "insert", "delete"}


@pytest.mark.parametrize("old, new", [([], []), (rows(range(9)), []), ([], rows(range(9))), (rows([None]), rows([None], 1))])
def test_empty_snapshots_and_null_keys(spark, old, new):
    assert run(spark, old, new) == brute(old, new)


def test_repeated_keys_pair_one_to_one(spark):
    old = [(7, "same", "en", "s")] * 500 + [(7, "one", "en", "s"), (None, "n", None, None), (None, "n", None, None), (8, "x", "en", "s")]
    new = [(7, "same", "en", "s")] * 500 + [(7, "two", "en", "s"), (None, "n", None, None), (9, "x", "en", "s")]
    got = run(spark, old, new)
    assert Counter((o, k) for (k, _, o, _, _), n in got.items() for _ in range(n)) == {("same", 7): 500, ("update", 7): 1, ("same", None): 1, ("delete", None): 1, ("rekey", 9): 1}


def test_equal_subtrees_are_skipped(spark):
    old = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    new = old.where("doc_id <> 777").withColumn("text", F.when(F.col("doc_id") == 12_345, "new").otherwise(F.col("text")))
    both = snapdiff.digests(old, "doc_id", ["text"], 0).unionByName(snapdiff.digests(new, "doc_id", ["text"], 1)).withColumn("level", snapdiff._level(F.col("key")))
    marked = snapdiff.flagged(snapdiff.numbered(both, ["side", "key"], ["content"], snapdiff.LEVELS))
    scanned = {(r.side, r.key) for r in marked.where("not skip").collect()}
    assert {(0, 777), (0, 12_345), (1, 12_345)} <= scanned and len(scanned) < 20 * snapdiff.FANOUT
    got = {r.op: r.n for r in snapdiff.diff(old, new, "doc_id", ["text"]).groupBy("op").agg(F.count("*").alias("n")).collect()}
    assert got == {"same": 19_998, "update": 1, "delete": 1}


def test_leaf_with_equal_sums_but_other_rows_is_found_by_the_check(spark, monkeypatch):
    monkeypatch.setattr(snapdiff, "_sums", lambda: [F.count(F.lit(1)).alias("n"), F.bit_xor(F.lit(0)).alias("x0"), F.bit_xor(F.lit(0)).alias("x1")])
    old, new = rows(range(200)), rows(range(200), 1)
    assert run(spark, old, new) == brute(old, new)


def test_numbers_and_boundaries_over_partitions(spark):
    keys = sorted([k * 3 for k in range(700)] + [50] * 400)
    df = spark.createDataFrame([(s, k, b"c") for s in (0, 1) for k in keys], "side int, key long, content binary").withColumn("level", snapdiff._level(F.col("key")))
    got = snapdiff.numbered(df.repartition(7), ["side", "key"], ["content"], 3).collect()
    level = {r.key: r.level for r in got}
    for s in (0, 1):
        own = sorted((r.key, r.number, r.s1, r.s2, r.s3) for r in got if r.side == s)
        assert [k for k, *_ in own] == keys
        seen, starts = Counter(), [None] * 3
        for k, n, *held in own:
            seen[k] += 1
            starts = [k if level[k] > i else starts[i] for i in range(3)]
            assert n == seen[k] and held == starts


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_query_equals_sql_and_brute_force(spark):
    duckdb = pytest.importorskip("duckdb")
    from tracewell.llm.queries import ORACLES, QUERIES

    got = Counter((r.key, r.old_key, r.op, r.changed, r.row_sha256) for r in QUERIES["op13_merkle_snapshot_diff"](spark, SF).collect())
    old = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    new = []
    for k, t, g, s in old:
        kind = zlib.crc32(str(k).encode()) % 10
        if kind:
            new.append((-1 - k if kind in (3, 4) else k, (t or "") + "+" if kind == 1 else t, s if kind == 2 else g, g if kind == 2 else None if kind == 4 else s))
        if kind == 5:
            new.append((-1 - k, t, g, s))
    assert got == brute(old, new)
    con = duckdb.connect()
    path = f"{SF}/documents.parquet"
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*'}')")
    frame = con.execute(ORACLES["op13_merkle_snapshot_diff"]).fetchall()
    assert Counter(frame) == got
