"""Addresses that look like header lines, and archives whose records are not what their headers say."""

import pytest

from tracewell.llm import warc


def test_addresses_stay_in_their_line(spark, tmp_path):
    bad = "WARC-Refers-To: <urn:page:7>"
    urls = [f"http://a/ {bad}", f"http://a/\u0085{bad}", f"http://a/\r\n{bad}\r\n\r\nx", f"http://a/\n{bad}", "WARC-Type: revisit", "http://a/ü?q=1%0D"]
    df = spark.createDataFrame([(i, u, "x" * (150 + i)) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = warc.archive_records(df, "page_id", "url", "html").collect()
    assert [(r.record_type, r.refers_to, r.payload_bytes) for r in sorted(got)] == [("response", None, 150 + i) for i in range(len(urls))]
    path = str(tmp_path / "archive")
    warc.write_archive(df, path, "page_id", "url", "html")
    lines = {r.key: r.u for r in warc.read_archive(spark, path).select("key", warc.header_field(warc.F.col("header"), "WARC-Target-URI").alias("u")).collect()}
    assert lines == {i: u.replace("\r", "%0D").replace("\n", "%0A") for i, u in enumerate(urls)}


def test_changed_payload_fails_the_read(spark, tmp_path):
    path = str(tmp_path / "archive")
    warc.write_archive(spark.createDataFrame([(1, "u", "y" * 200)], "page_id long, url string, html string"), path, "page_id", "url", "html")
    changed = spark.read.parquet(f"{path}/payloads").withColumn("payload", warc.F.lit(b"other"))
    changed.write.parquet(f"{path}/changed")
    changed.sparkSession.read.parquet(f"{path}/changed").write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="does not give its digest"):
        warc.read_archive(spark, path).collect()
