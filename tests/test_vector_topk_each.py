"""Searches of many query vectors against brute force."""

import math
import random

from tracewell.operators import retrieval as R
from tracewell.plans import catalog


def brute(rows, queries, k):
    given = [(i, v) for i, v in rows if v and any(v)]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    return {(q, i) for q, w in given if q in queries for i in [i for _, i in sorted((-round(cos(v, w), 9), i) for i, v in given)][:k]}


def test_every_query_vector_is_searched(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(1, 301)]  # no vec_id 0
    rows += [(i + 400, rows[i][1]) for i in range(0, 60)] + [(500, None), (550, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = {i for i, _ in rows if i % 50 == 0}
    got = R.nearest_each(df, "vec_id", "embedding", df.where("vec_id % 50 = 0"), rows=32).collect()
    assert {(r.query_id, r.vec_id) for r in got} == brute(rows, queries, 10) and len(got) == 10 * len(queries - {500, 550})
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = catalog.QUERIES["vector_topk_each"](spark, str(tmp_path)).collect()
    assert {(r.query_id, r.vec_id) for r in got} == brute(rows, queries, 10)
