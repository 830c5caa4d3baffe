"""Components of all part-supplier edges against union-find."""

import os

import pytest

from tracewell.plans import catalog

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@tables
def test_components_of_all_part_supplier_edges(spark):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_partkey", "l_suppkey").distinct().collect():
        a, b = sorted((find(f"part:{r.l_partkey}"), find(f"supplier:{r.l_suppkey}")))
        root[b] = a
    got = {r.id: r.component for r in catalog.QUERIES["components"](spark, SF).collect()}
    assert got == {x: find(x) for x in root}
