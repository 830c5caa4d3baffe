"""The evidence table: all twelve columns, each cell once, refused where mapping and files differ."""

import json

import pytest
from pyspark.sql import functions as F

from tracewell.sinks import evidence_table as V


def parts(spark, **change):
    rows = [("h1", "d1", r, c, json.dumps(f'{r} "q"\n{c}') if r < 3 else None, f"line {r + 1}") for r in (1, 2, 3) for c in (1, 2)] + [("h2", "d2", 1, 1, "1.20", "/0/x"), ("h3", "d3", 1, 1, "7", "/0/x")]
    columns = [("h1", 1, "a"), ("h1", 2, 'b "x"'), ("h2", 1, "x"), ("h3", 1, "x")]
    decisions = [("h1", 1, "a", "mag", "mapped", "exact"), ("h1", 2, 'b "x"', None, "unmapped", "none"), ("h2", 1, "x", "flux", "mapped", "proposal")]
    given = {"cells": rows, "columns": columns, "artifacts": [("h1", "https://x.org/1"), ("h2", "https://x.org/2"), ("h3", "https://x.org/3")], "decisions": decisions} | change
    schemas = {"cells": "artifact_sha256 string, dataset_id string, row_index int, column_index int, raw_json string, location string", "columns": "artifact_sha256 string, column_index int, header string", "artifacts": "artifact_sha256 string, source_url string", "decisions": "artifact_sha256 string, column_index int, source_column string, target_field string, status string, method string"}
    return {n: spark.createDataFrame(given[n], s) for n, s in schemas.items()}


def test_every_cell_once_and_back_from_csv(spark, tmp_path):
    table = V.evidence_table(**parts(spark))
    got = {(r.artifact_sha256, r.source_row, r.source_column_index): r for r in table.collect()}
    assert table.columns == list(V.COLUMNS) and len(got) == 7 == table.select("evidence_id").distinct().count()
    r = got[("h1", 1, 2)]
    assert (json.loads(r.source_column_json), json.loads(r.target_field_json), json.loads(r.raw_value_json), json.loads(r.source_location_json)) == ('b "x"', None, '1 "q"\n2', "line 2")
    assert got[("h1", 3, 1)].raw_value_json == "null" and got[("h2", 1, 1)].raw_value_json == "1.20" and json.loads(got[("h2", 1, 1)].target_field_json) == "flux"
    size = V.write_evidence(table, str(tmp_path / "e"))
    back = V.read_evidence(spark, str(tmp_path / "e"))
    text = table.select([F.col(c).cast("string") for c in V.COLUMNS])
    assert back.exceptAll(text).isEmpty() and text.exceptAll(back).isEmpty()
    assert all(p.read_bytes().startswith(b"\xef\xbb\xbfdataset_id,") for p in (tmp_path / "e").glob("*.csv"))
    with pytest.raises(V.EvidenceError):
        V.write_evidence(table, str(tmp_path / "f"), size - 1)
    assert not (tmp_path / "f").exists() and V.evidence_table(**parts(spark, cells=[])).count() == 0


GOOD = [("h1", 1, "a", "m", "mapped", "exact"), ("h1", 2, 'b "x"', None, "unmapped", "none")]


@pytest.mark.parametrize("decisions, problem", [(GOOD[:1], "column_undecided"), ([*GOOD, ("h9", 1, "x", None, "s", "m")], "artifact_unknown"), ([*GOOD, GOOD[0]], "decided_twice"), ([GOOD[0], ("h1", 2, "B", None, "s", "m")], "header_differs"), ([*GOOD, ("h1", 3, "c", None, "s", "m")], "column_missing")])
def test_what_does_not_belong_together_is_refused(spark, decisions, problem):
    with pytest.raises(V.EvidenceError, match=problem):
        V.evidence_table(**parts(spark, decisions=decisions))
