from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.functions import values as V


def one(spark, make, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("v"))).collect()]


def test_titles(spark):
    assert one(spark, T.title_key, " The  ＡＢＣ: of—Straße ", None) == ["the abc of strasse", None]
    assert one(spark, T.normalize_title, " a \n b ") == ["a b"]


def test_dois(spark):
    given = ["doi: 10.1234/AbC", "https://doi.org/10.1234%2FX", "http://dx.doi.org/10.12345/y z", "10.12/x", "https://example.org/10.1234/x", None]
    assert one(spark, T.normalize_doi, *given) == ["10.1234/abc", "10.1234/x", None, None, None, None]


def test_urls(spark):
    given = ["HTTPS://Example.ORG:443?utm_source=a&b=2&A=1#x", "http://example.org/", "https://user@example.org/", "https://example.org:8080/", "https://example.org/p?x"]
    assert one(spark, T.normalize_url, *given) == ["https://example.org/?A=1&b=2", None, None, None, "https://example.org/p?x="]


def test_formats_and_licenses(spark):
    assert one(spark, T.file_format, ".FIT", "text/csv; charset=x", "odd") == ["fits", "csv", "odd"]
    assert one(spark, T.license_label, "mit license", "https://creativecommons.org/licenses/by-sa/4.0/", "House") == ["MIT", "CC-BY-SA-4.0", "House"]


def test_kinds(spark):
    given = ["", "  ", "TRUE", "-12", "1.50", "1e5", ".", "x1"]
    assert one(spark, V.kind, *given) == ["empty", "empty", "boolean_candidate", "integer_candidate", "decimal_candidate", "decimal_candidate", "text", "text"]


def test_decimals(spark):
    assert one(spark, lambda c: V.shift_decimal(c, "2400000.5"), "2459000.6", "2459000", "2459000.125", "1e3") == ["59000.1", "58999.5", "58999.625", None]
    assert one(spark, V.decimal_places, "1.20", "5", "x") == [2, 0, None]
    assert one(spark, V.decimal_text, "1.20E3", "nan", "x", "0.10") == ["1200", None, None, "0.10"]


def test_csv_lexemes_and_json(spark):
    assert one(spark, T.csv_lexeme, '"a ""b"""', "plain", '""') == ['a "b"', "plain", ""]
    assert one(spark, V.canonical_json, '{"b": 1, "a": "é"}', "{", "[NaN]") == ['{"a":"\\u00e9","b":1}', None, None]


def test_dates(spark):
    assert [str(x) for x in one(spark, V.iso_date, "2020-02-29", "2021-02-29")] == ["2020-02-29", "None"]
    assert one(spark, V.utc, "2020-01-01T00:00:00") == [None]


def test_axes(spark):
    got = spark.range(1).select(V.axis(F.lit(30.0), 10, 59000, 50, 59004).alias("a"), V.axis(F.lit(1.0), 0, 1, 2, 100, True).alias("b"), V.spread(F.lit(0.0), F.lit(0.5), first_pixel=0, first_value=0, second_pixel=1, second_value=2).alias("c")).first()
    assert (got.a, round(got.b, 9), got.c) == (59002, 10, 1)
