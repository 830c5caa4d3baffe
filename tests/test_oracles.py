"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import glob
import os

import pandas as pd
import pytest

duckdb = pytest.importorskip("duckdb")
from tracewell.plans import catalog  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return con


def plain(v):
    if v is None or v is pd.NA or v != v:
        return ""
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, bool):
        return str(v)
    try:
        return f"{float(v):.6g}"
    except (TypeError, ValueError):
        return str(v)


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False))


@pytest.mark.skipif(not glob.glob(f"{SF}/*"), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, db, name):
    ours = catalog.QUERIES[name](spark, SF).toPandas()
    theirs = db.execute(catalog.ORACLES[name]).df()
    assert rows_of(ours) == rows_of(theirs)
