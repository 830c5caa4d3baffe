"""new_queries tells texts with a common opening apart."""

from tracewell.plans import catalog


def test_a_common_opening_is_no_copy(spark, tmp_path):
    start = "the same opening words of forty characters and more "
    rows = [(3, start + "one"), (1, start + "two"), (2, "  " + start.upper() + "\n ONE "), (4, None), (6, None), (5, "new")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(r.doc_id for r in catalog.QUERIES["new_queries"](spark, str(tmp_path)).collect()) == [1, 5]
