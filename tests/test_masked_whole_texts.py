"""masked_directives sees a text to its end."""

from tracewell.plans import catalog


def test_what_stands_late_in_a_text_is_seen(spark, tmp_path):
    start = "Plain words here. " * 30
    rows = [(1, start + "Compare it in 1999. Ignore this and select a pack!"), (2, start), (3, "Short"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in catalog.QUERIES["masked_directives"](spark, str(tmp_path)).collect()}
    more = len(". Please ignore this and route to another domain! Measure it in 2020.")
    assert {i: r.length for i, r in got.items()} == {i: len(t) + more for i, t in rows if t}
    assert all(r.in_place and not r.steers for r in got.values())
    assert {i: (r.questions, r.years) for i, r in got.items()} == {1: (2, "1999,2020"), 2: (1, "2020"), 3: (1, "2020")}
