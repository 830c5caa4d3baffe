"""Hard negatives by one-dimensional distance keys.

Vectors of integers get one more coordinate, so that all have the length M of the longest, and anchors get a zero there:
then |q - x|^2 = |q|^2 + M^2 - 2 q.x, and the largest inner products are the smallest distances. Every row is stored with
its nearest of some pivots and its distance to that, sorted by (pivot, distance). At most PIVOTS * SLICES key intervals
cover the store; the triangle inequality bounds the distances, and so the scores, that an interval can hold for an anchor.

An anchor asks for bands of scores: its positives are the best of all scores, and negatives are the best within an annulus
that a positive's score sets. It visits intervals in order of their bound, at first FIRST of them, then GROWTH times as
many, and only those that could still change its result; when none could, the result is certified. An interval's
rows are dealt into blocks of a bounded number of rows, and anchors meet blocks by a join on the block; one matrix
product gives the scores of a block's rows for all anchors that visit it.

Only pivots, bounds of key intervals and totals go through the driver; all are bounded by the parameters. The pivots are a
sample (of PIVOTS rows), but every row is stored and the search is exact.

Nulls and edge cases: rows with a null id, label or vector, or a null, infinite or NaN component take no part. A vector
shorter than others counts as filled up with zeros. An anchor is never its own positive or negative, nor is another row
with its id; anchors that repeat in id, label and vector are one. Rows that repeat an id are candidates each for
themselves, ties by the smaller id. Anchors without positives give no rows, and an empty table gives an empty one.
Components must be so small that squared lengths stay below 2**59; larger ones raise ValueError. Other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.storage import discard, written

PIVOTS, SLICES = 16, 16
#: Intervals that an anchor visits in the first round, and how many times as many in each further round.
FIRST, GROWTH = 8, 8
#: Rows of a block, and anchors that one task holds beside it.
BLOCK_ROWS, ANCHORS = 16_384, 8_192
#: Scores that one matrix product makes at a time.
PRODUCT = 1 << 20
LOWEST, HIGHEST = -(1 << 62), 1 << 62


def quantised(df: DataFrame, key: str, vector: str, label: str, scale: int = 256) -> DataFrame:
    """(id, label, vec, norm): floor(scale * x) of each component of the rows that take part, and the squared length."""
    x = F.col("vec")
    rows = df.select(df[key].cast("long").alias("id"), df[label].alias("label"), df[vector].cast("array<double>").alias("vec"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & x.isNotNull())
    rows = rows.where(F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    rows = rows.withColumn("vec", F.transform("vec", lambda c: F.floor(F.lit(float(scale)) * c)))
    return rows.withColumn("norm", F.aggregate(F.transform("vec", lambda c: c.cast("double") * c), F.lit(0.0), lambda a, c: a + c))


def matrix(lists: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """[rows, dims] integers; shorter lists are filled up with zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    if (size == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(size), dims), np.int64)
    out[np.arange(dims) < size[:, None]] = flat
    return out


class Space:
    """What all tasks know: the number of coordinates, the largest squared length and the pivots."""

    def __init__(self, dims: int, most: int, pivots: np.ndarray):
        self.dims, self.most, self.pivots = dims, most, pivots
        # below 2**53 every sum of products is exact in doubles too
        self.kind = np.float64 if most < 1 << 53 else np.int64

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.most - (x.astype(np.float64) ** 2).sum(axis=1), 0))

    def distances(self, x: np.ndarray, lifted: np.ndarray) -> np.ndarray:
        """[rows, pivots] distances to the pivots; lifted: the rows' added coordinate."""
        inner = x.astype(np.float64) @ self.pivots.T.astype(np.float64) + np.outer(lifted, self.lift(self.pivots))
        length = (x.astype(np.float64) ** 2).sum(axis=1) + lifted**2
        return np.sqrt(np.maximum(length[:, None] + self.most - 2 * inner, 0))

    def bounds(self, q: np.ndarray, pivot: np.ndarray, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[anchors, intervals] least and largest score that an interval (its pivot, least and largest distance) can hold."""
        d = self.distances(q, np.zeros(len(q)))[:, pivot]
        base = (q.astype(np.float64) ** 2).sum(axis=1)[:, None] + self.most
        slack = 1 + 1e-6 * base
        closest = np.maximum(np.maximum(d - far, near - d), 0)
        return (base - (d + far) ** 2) / 2 - slack, (base - closest**2) / 2 + slack

    def scores(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        return q.astype(self.kind) @ x.astype(self.kind).T


class Store:
    """The sorted rows (interval, id, label, vec, dist) and the list of key intervals."""

    def __init__(self, rows: DataFrame):
        """rows: from ``quantised``."""
        spark = rows.sparkSession
        top = rows.agg(F.max("norm"), F.max(F.size("vec")), F.count(F.lit(1))).first()
        self.count = top[2]
        if (top[0] or 0) >= 1 << 59:
            raise ValueError("vectors are too long for 64-bit scores")
        dims, most = top[1] or 0, int(top[0] or 0)
        sample = rows.select("vec").distinct().orderBy(F.xxhash64("vec"), "vec").limit(PIVOTS).collect()
        pivots = np.zeros((max(1, len(sample)), dims), np.int64)
        for i, r in enumerate(sample):
            pivots[i, : len(r.vec)] = r.vec
        self.space = space = Space(dims, most, pivots)

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column("vec"), dims)
                d = space.distances(x, space.lift(x))
                at = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32()), pa.array(d[np.arange(len(at)), at], pa.float64())], names=[*batch.schema.names, "pivot", "dist"])

        schema = T.StructType([*rows.drop("norm").schema, T.StructField("pivot", T.IntegerType()), T.StructField("dist", T.DoubleType())])
        keyed = written(rows.drop("norm").mapInArrow(near, schema), "keyed")
        cuts = keyed.groupBy("pivot").agg(F.percentile_approx("dist", [i / SLICES for i in range(1, SLICES)], 1000).alias("cuts"))
        slot = F.col("pivot") * SLICES + F.size(F.filter("cuts", lambda c: c < F.col("dist")))
        placed = keyed.join(F.broadcast(cuts), "pivot").select(slot.alias("interval"), "dist", "id", "label", "vec", F.monotonically_increasing_id().alias("_salt"))
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        placed = placed.repartitionByRange(parts, "interval", "dist", "_salt").sortWithinPartitions("interval", "dist").drop("_salt")
        self.rows = written(placed, "store")
        discard(keyed)
        found = self.rows.groupBy("interval").agg(F.min("dist"), F.max("dist"), F.count(F.lit(1))).orderBy("interval").collect()
        block = min(BLOCK_ROWS, max(256, self.count // (2 * parts)))
        self.number = np.array([r[0] for r in found], np.int64)
        self.near, self.far = (np.array([r[i] for r in found], np.float64) for i in (1, 2))
        self.chunks = spark.createDataFrame([(r[0], -(-r[3] // block)) for r in found], "interval int, chunks int")

    def search(self, asked: DataFrame, count: int, k: int, same: bool) -> DataFrame:
        """(a, band, rank, id, score): the first k rows of each band of each anchor. asked: (a, own, label, vec, caps,
        floors), the anchor's number, id, label, vector, and the bands' largest and least scores; count: how many anchors.
        same: rows of the anchor's label, else of the others."""
        found, low, high = None, 0, FIRST
        while low < len(self.number):
            visits = written(self._visits(asked, low, high), "visits")
            if not visits.isEmpty():
                new = self._meet(visits, count, k, same)
                both = new if found is None else new.unionByName(found)
                order = Window.partitionBy("a", "band").orderBy(F.desc("score"), "id")
                ranked = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
                before, found = found, written(ranked.select("a", "band", "id", "score", "rank"), "found")
                if before is not None:
                    discard(before)
                # an anchor's k-th score so far is the least that it still asks for
                kth = found.where(F.col("rank") == k).groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("band", "score"))).alias("kth"))
                raised = F.transform("floors", lambda f, i: F.greatest(f, F.coalesce(F.element_at("kth", i), f)))
                asked = asked.drop("kth").join(kth, "a", "left").withColumn("floors", F.when(F.col("kth").isNull(), F.col("floors")).otherwise(raised)).drop("kth")
                asked, old = written(asked, "asked"), asked
                found = found.drop("rank")
            discard(visits)
            low, high = high, high * GROWTH
        if found is None:
            found = self.rows.sparkSession.createDataFrame([], "a long, band int, id long, score long")
        return found.withColumn("rank", F.row_number().over(Window.partitionBy("a", "band").orderBy(F.desc("score"), "id")))

    def _visits(self, asked: DataFrame, low: int, high: int) -> DataFrame:
        """Each anchor with the intervals, among those from the low-th to the high-th in order of their bound, that could
        still change its result."""
        space, number, near, far = self.space, self.number, self.near, self.far
        pivot = number // SLICES

        def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                least, most = space.bounds(matrix(batch.column("vec"), space.dims), pivot, near, far)
                lists = []
                for i, (caps, floors) in enumerate(zip(batch.column("caps").to_pylist(), batch.column("floors").to_pylist(), strict=True)):
                    order = np.lexsort((least[i], -np.minimum(most[i], max(caps, default=0))))[low:high]
                    wanted = np.zeros(len(order), bool)
                    for cap, floor in zip(caps, floors, strict=True):
                        wanted |= (most[i][order] >= floor) & (least[i][order] <= cap)
                    lists.append(number[order[wanted]])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int32()))], names=[*batch.schema.names, "intervals"])

        schema = T.StructType([*asked.schema, T.StructField("intervals", T.ArrayType(T.IntegerType()))])
        return asked.mapInArrow(plan, schema).where(F.size("intervals") > 0)

    def _meet(self, visits: DataFrame, count: int, k: int, same: bool) -> DataFrame:
        """(a, band, id, score): of each block and anchor that visits it, the first k rows of each band."""
        space, parts = self.space, -(-count // ANCHORS)
        seen = [r[0] for r in visits.select(F.explode("intervals")).distinct().collect()]
        chunks = F.broadcast(self.chunks)
        rows = self.rows.where(F.col("interval").isin(seen)).join(chunks, "interval")
        rows = rows.select("interval", F.pmod(F.xxhash64("id", "vec"), F.col("chunks")).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "id", "label", "vec")
        come = visits.withColumn("interval", F.explode("intervals")).drop("intervals").join(chunks, "interval")
        come = come.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks").withColumn("part", F.pmod(F.xxhash64("a"), F.lit(parts)).cast("int"))
        group = ["interval", "chunk", "part"]

        def block(x: pa.Table, q: pa.Table) -> pa.Table:
            out = []
            if x.num_rows and q.num_rows:
                x = x.sort_by("id")
                ids, labels, vectors = x["id"].to_numpy(), x["label"].to_numpy(), matrix(x["vec"], space.dims)
                anchors, own, asked = q["a"].to_numpy(), q["own"].to_numpy(), q["label"].to_numpy()
                queries, caps, floors = matrix(q["vec"], space.dims), q["caps"].to_pylist(), q["floors"].to_pylist()
                bands = max(map(len, caps))
                cap, floor = np.full((len(caps), bands), LOWEST, np.int64), np.full((len(caps), bands), HIGHEST, np.int64)
                for i, (c, f) in enumerate(zip(caps, floors, strict=True)):
                    cap[i, : len(c)], floor[i, : len(f)] = c, f
                step = max(1, PRODUCT // len(ids))
                for s in range(0, len(anchors), step):
                    part = slice(s, s + step)
                    scores = space.scores(queries[part], vectors).astype(np.int64)
                    out_of = (labels == asked[part, None]) != same
                    scores[out_of | (ids == own[part, None])] = LOWEST
                    # rows stand by id, so a stable sort keeps ties by id
                    order = np.argsort(-scores, axis=1, kind="stable")
                    ranked = np.take_along_axis(scores, order, axis=1)
                    for band in range(bands):
                        first = (ranked > cap[part, band, None]).sum(axis=1)
                        at = first[:, None] + np.arange(min(k, len(ids)))
                        inside = at < len(ids)
                        at = np.minimum(at, len(ids) - 1)
                        got = np.take_along_axis(ranked, at, axis=1)
                        inside &= (got >= floor[part, band, None]) & (got > LOWEST)
                        i, j = np.nonzero(inside)
                        out.append((anchors[part][i], np.full(len(i), band), ids[order[i, at[i, j]]], got[i, j]))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
            return pa.table({"a": pa.array(columns[0], pa.int64()), "band": pa.array(columns[1], pa.int32()), "id": pa.array(columns[2], pa.int64()), "score": pa.array(columns[3], pa.int64())})

        return rows.groupBy(*group).cogroup(come.groupBy(*group)).applyInArrow(block, "a long, band int, id long, score long")


def mine(df: DataFrame, key: str, vector: str, label: str, anchor: Column, positives: int = 5, negatives: int = 10, low: tuple[int, int] = (3, 10), high: tuple[int, int] = (9, 10)) -> DataFrame:
    """Hard negatives of the rows for which ``anchor`` (a condition on ``id``) holds: anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score. Negatives have another label and a score from low to high (fractions) of
    the positive's."""
    rows = quantised(df, key, vector, label)
    store = Store(rows)
    anchors = rows.where(anchor).drop("norm").dropDuplicates(["id", "label", "vec"])
    bound = lambda v: F.array(F.lit(v).cast("long"))
    anchors = anchors.select(F.monotonically_increasing_id().alias("a"), F.col("id").alias("own"), "label", "vec", bound(HIGHEST).alias("caps"), bound(LOWEST + 1).alias("floors"))
    anchors = written(anchors, "anchors")
    count = max(1, anchors.count())
    best = store.search(anchors, count, positives, True).select("a", F.col("rank").alias("nth"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    # a negative score has no band: its lower end lies above its upper end
    best = written(best.where("positive_score >= 0").withColumn("band", F.row_number().over(Window.partitionBy("a").orderBy("nth")) - 1), "positives")
    score = F.col("positive_score")
    cap, floor = F.expr(f"({high[0]} * positive_score) div {high[1]}"), F.expr(f"({low[0]} * positive_score + {low[1] - 1}) div {low[1]}")
    bands = best.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("band", cap.alias("cap"), floor.alias("floor")))).alias("bands"))
    asked = anchors.drop("caps", "floors").join(bands, "a").select("a", "own", "label", "vec", F.col("bands.cap").alias("caps"), F.col("bands.floor").alias("floors"))
    asked = written(asked, "bands")
    found = store.search(asked, count, negatives, False)
    out = found.join(best, ["a", "band"]).join(anchors.select("a", F.col("own").alias("anchor_id")), "a")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), score, F.col("score").alias("negative_score"))
