"""Streams against their batch versions, jobs, rounds, previews, Office files and links."""

import datetime
import io
import zipfile

from pyspark.sql import functions as F

from tracewell.sources import files as S
from tracewell.streaming import events as V

START = datetime.datetime(2024, 1, 1)


def test_breaker_on_a_stream_equals_the_batch(spark, tmp_path):
    rows = [(h, START + datetime.timedelta(seconds=7 * i + len(h)), (i * 7 + len(h)) % 5 > 2) for h in ("a", "bb", "ccc") for i in range(60)]
    df = spark.createDataFrame(rows, "host string, ts timestamp, ok boolean")
    for i in range(3):  # three files, in time order, one to a batch
        a, b = START + datetime.timedelta(seconds=150 * i), START + datetime.timedelta(seconds=150 * (i + 1))
        df.where((F.col("ts") >= F.lit(a)) & (F.col("ts") < F.lit(b))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    V.to_table(V.breaker_stream(stream, "host", "ok", "ts", 2, 20), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(240)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = sorted((r.host, r.ts, r.state) for r in V.breaker(df, "host", "ok", "ts", 2, 20).collect())
    assert got == want and {s for _, _, s in got} == {"closed", "open", "half_open"}


def test_job_transitions(spark):
    rows = [("a", 1, "queued"), ("a", 2, "running"), ("a", 3, "succeeded"), ("a", 4, "running"), ("b", 1, "running"), ("b", 2, "queued"), ("b", 3, "failed"), ("c", 1, None)]
    got = {r.job: (r.state, r.refused) for r in V.job_states(spark.createDataFrame(rows, "job string, n int, state string"), "job", "n", "state").collect()}
    assert got == {"a": ("succeeded", 1), "b": ("queued", 2), "c": (None, 1)}


def test_round_progress(spark, tmp_path):
    schema = "round int, coverage double, new_sources int"
    for i, (c, n) in enumerate([(0.2, 3), (0.5, 2), (0.505, 1), (0.51, 0)]):
        spark.createDataFrame([(i, c, n)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    V.round_progress(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(240)
    got = spark.read.parquet(str(tmp_path / "out" / "progress")).orderBy("round").collect()
    assert [round(r.gain, 3) for r in got] == [0.2, 0.3, 0.005, 0.005] and [r.stagnant for r in got] == [False, False, False, True]


def zipped(**members):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/"), text)
    return buffer.getvalue()


STRINGS = '<sst xmlns="http://x"><si><t>Alpha</t></si><si><t>Beta  two</t></si></sst>'


def test_previews(spark):
    sheet = zipped(**{"xl__sharedStrings.xml": STRINGS})
    assert S.content_preview(sheet, S.SHEET) == "Alpha | Beta two"
    assert S.content_preview(zipped(**{"xl__sharedStrings.xml": "<!DOCTYPE x>" + STRINGS}), S.SHEET).startswith("no textual preview")
    archive = zipped(**{"a.csv": "x,y\n1,2", "b.bin": "0", "c.txt": "three", "d.json": "{}"})
    assert S.content_preview(archive, "application/zip") == "archive members: a.csv | b.bin | c.txt | d.json; embedded records: sample a.csv: x,y 1,2 || sample c.txt: three"
    assert S.content_preview(b"\xff", "text/plain") == "no textual preview; media=text/plain; bytes=1"
    assert len(S.content_preview(b"word " * 5000, "Text/Plain")) == 2048
    df = spark.createDataFrame([("p", b"hi  there", "text/csv"), ("q", None, None)], "path string, content binary, media string")
    assert {r.path: r.preview for r in S.with_previews(df).collect()} == {"p": "hi there", "q": "no textual preview; media=; bytes=0"}


def test_classification(spark):
    book = zipped(**{"[Content_Types].xml": "", "xl__workbook.xml": ""})
    both = zipped(**{"[Content_Types].xml": "", "xl__workbook.xml": "", "word__document.xml": ""})
    assert S.office_kind(book) == "xlsx" and S.office_kind(both) is None and S.office_kind(b"PK\x03\x04junk") is None
    rows = [("book", book, S.SHEET), ("zip", both, "application/zip"), ("wrong", b"%PDF-1.7 x", "text/csv; charset=x"), ("csv", b"a,b\n1,2\n", "text/csv"), ("none", None, None), ("odd", b"\xff\xfe", "")]
    got = {r.path: (r.media, r.family, r.confidence) for r in S.classify(spark.createDataFrame(rows, "path string, content binary, declared string")).collect()}
    assert got["book"] == (S.SHEET, "xlsx", 0.99) and got["zip"] == ("application/zip", "zip", 0.99)
    assert got["wrong"] == ("application/pdf", "pdf", 0.69) and got["csv"] == ("text/csv", "csv", 0.8) and got["none"][0] == "text/plain"


def test_links(spark):
    html = '<A HREF="/d/a.CSV">1</a><a href="https://x.org/b.zip?q">2</a><a download href="https://y.org/c">3</a><a href="https://y.org/d" data-download="1">4</a><a href="https://x.org/b.zip?q">5</a><a href="b.csv">6</a><a>7</a>'
    df = spark.createDataFrame([(html, "https://s.org/page"), (None, None)], "h string, u string")
    pick = lambda **o: df.select(S.attachment_links(F.col("h"), F.col("u"), **o).alias("l")).first().l
    assert pick() == ["https://s.org/d/a.CSV", "https://x.org/b.zip?q", "https://y.org/c"]
    assert pick(hosts=["S.org"]) == ["https://s.org/d/a.CSV"] and len(pick(most=2)) == 2
    assert df.select(S.attachment_links(F.col("h")).alias("l")).collect()[1].l == []
