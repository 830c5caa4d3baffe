"""Hard negatives against brute force, and against SQL on the driver's tables."""

import math
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import hardneg

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int, id string, score int, vec string"


def brute(rows, every=100, positives=5, negatives=10):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], c) for i, v, c in rows if i is not None and v is not None and c is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = Counter()
    for i, v, c in {(i, tuple(v), c) for i, v, c in kept if i % every == 0}:
        scored = sorted((-dot(v, w), j, d) for j, w, d in kept if j != i)
        for s, j, _ in [x for x in scored if x[2] == c][:positives]:
            fit = [(-t, k) for t, k, d in scored if d != c and 30 * -s <= 100 * -t <= 90 * -s][:negatives]
            out.update((i, j, n, k, -s, t) for n, (t, k) in enumerate(fit, 1))
    return out


def run(spark, rows, parts=5):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(parts)
    return Counter(tuple(r) for r in hardneg.mine(df, "vec_id", "embedding", "label", F.col("id") % 100 == 0).collect())


def vectors(n, dims, seed, spread):
    """Points around a few centres, each a label of its own half of the time."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(8, dims))
    at = r.integers(0, 8, n)
    x = centres[at] + spread * r.normal(size=(n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(i, [float(np.float32(c)) for c in v], int(c if h else l)) for i, (v, c, h, l) in enumerate(zip(x, at, r.integers(0, 2, n), r.integers(0, 4, n)))]


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_equals_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(hardneg, "BLOCK_ROWS", 40)
    monkeypatch.setattr(hardneg, "ANCHORS", 5)
    monkeypatch.setattr(hardneg, "FIRST", 2)
    rows = vectors(1200, 6, 3, spread)
    assert run(spark, rows) == brute(rows) != Counter()


def test_nulls_ties_repeats_and_odd_lengths(spark):
    rows = vectors(300, 4, 5, 0.3)
    rows += [(1000 + i, [1.0, 0.0, 0.0, 0.0], i % 3) for i in range(150)]  # one vector, many times
    rows += [(2000, None, 1), (2100, [1.0, None, 0.0, 0.0], 1), (2200, [float("nan")] * 4, 1), (2300, [float("inf"), 0.0, 0.0, 0.0], 1), (2400, [1.0, 0.0, 0.0, 0.0], None), (None, [1.0, 0.0, 0.0, 0.0], 1)]
    rows += [(2500, [1.0], 1), (2600, [], 1), (2700, [0.0] * 4, 2), (2800, [-1.0, -1.0, 0.0, 0.0], 9)]
    assert run(spark, rows) == brute(rows) != Counter()
    best = next(r for r in brute(rows) if r[0] == 200 and r[2] == 1)
    again = [*rows, rows[100], rows[100], rows[best[1]], rows[best[3]]]  # an anchor, a positive and a negative
    assert run(spark, again) == brute(again)
    assert run(spark, []) == run(spark, [(0, [1.0], 1)]) == Counter()


def test_long_vectors_are_exact(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.integers(-90_000, 90_000, 5)], i % 2) for i in range(250)]  # squared lengths above 2**53
    assert run(spark, rows) == brute(rows) != Counter()
    with pytest.raises(ValueError):
        run(spark, [(0, [1e9], 1), (1, [1e9], 1)])


def test_bounds_hold_and_far_intervals_are_left_out(spark):
    rows = vectors(3000, 6, 11, 0.02)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    own = hardneg.quantised(df, "vec_id", "embedding", "label")
    store = hardneg.Store(own)
    held = store.rows.collect()
    q = np.array([r.vec for r in held[:40]], np.int64)
    least, most = store.space.bounds(q, store.number // hardneg.SLICES, store.near, store.far)
    place = {n: i for i, n in enumerate(store.number.tolist())}
    at = np.array([place[r.interval] for r in held])
    scores = q @ np.array([r.vec for r in held], np.int64).T
    assert (scores >= least[:, at]).all() and (scores <= most[:, at]).all()
    tenth = np.sort(scores, axis=1)[:, -10]
    assert (most < tenth[:, None]).mean() > 0.5  # most intervals cannot hold one of the ten best


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_query_equals_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from tracewell.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    path = f"{SF}/embeddings.parquet"
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*'}')")
    want = con.execute(ORACLES["op11_distance_key_negatives"]).fetchall()
    got = [tuple(r) for r in QUERIES["op11_distance_key_negatives"](spark, SF).collect()]
    assert sorted(got) == sorted(want) and got
