"""Addresses, DOIs, formats and names by their rules on texts of every script, against following the rules by hand."""

import re
import unicodedata
from urllib.parse import parse_qsl, unquote, urlencode, urlsplit, urlunsplit

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_functions import one
from tracewell.functions import text as T
from tracewell.operators import evidence as E
from tracewell.operators import planning as P

URLS = ["https://", "HTTPS://", "http://", " https://", "ｈttps://", "//"]
HOSTS = ["münchen.de", "Example.ORG", "a..b", "ａ.org", "example.org.", "u@x.org", "u:p@x.org", "[::1]", "x" * 64 + ".org", "日本.jp", "a_b.org", "-x.org", "ß.de", ""]
PORTS = ["", "", ":443", ":", ":8080", ":x"]
PATHS = ["", "/", "/p q", "/%20/é", "/a;b", "/a\tb"]
QUERIES = ["", "?", "?b=2&A=1", "?a=1&a=0&A=3", "?b=%20", "?utm_source=x&q=é", "?x", "?=v", "?a=b=c", "?REF=1&r=+", "?a=1;b=2", "?ä=ö&z", "?a-b=1&a=2"]
ENDS = ["", "#x", "#", " "]


def want_url(value):
    try:
        at = urlsplit(unicodedata.normalize("NFKC", value).strip())
        if at.scheme.casefold() != "https" or at.hostname is None or at.username is not None or at.password is not None:
            return None
        host = at.hostname.rstrip(".").casefold()
        if not host or at.port not in (None, 443):
            return None
        host = host.encode("idna").decode()
    except ValueError:
        return None
    query = [(k, v) for k, v in parse_qsl(at.query, keep_blank_values=True) if k.casefold() not in T.TRACKING and not k.casefold().startswith("utm_")]
    query = sorted(query, key=lambda q: (q[0].casefold(), q[0], q[1]))
    return urlunsplit(("https", f"[{host}]" if ":" in host else host, at.path or "/", urlencode(query), ""))


def test_addresses(spark):
    r = np.random.default_rng(1)
    pick = lambda of: of[r.integers(0, len(of))]
    given = ["".join(map(pick, (URLS[:2] if i % 3 else URLS, HOSTS, PORTS, PATHS, QUERIES, ENDS))) for i in range(3000)] + [None, "", "https://münchen.de/?b=%20&B=1", "https://x.org/\n"]
    got = one(spark, T.normalize_url, *given)
    assert [(g, a, b) for g, a, b in zip(given, got, [None if g is None else want_url(g) for g in given]) if a != b] == []
    assert "https://xn--mnchen-3ya.de/?B=1&b=+" in got


def test_dois_of_every_form(spark):
    r = np.random.default_rng(2)
    parts = [["", "doi:", "DOI : ", "ｄｏｉ:", "https://doi.org/", "https://doi.org:443/", "http://DX.doi.org.//", "https://u@doi.org/", "https://x.org/", "//doi.org/", "ftp://doi.org/", " "], ["10.1234/", "10.12/", "１０.1234/", "10.1234%2F", "10.1234567890/"], ["AbC", "ß", "a b", "x?y=1", "x#z", "é%20", "(1)<2>", "", "K"], ["", " ", "\n"]]

    def want(value):
        text = re.sub(r"^doi\s*:\s*", "", unicodedata.normalize("NFKC", value).strip(), flags=re.I)
        at = urlsplit(text)
        if at.scheme or at.netloc:
            if at.scheme.casefold() not in ("http", "https") or at.hostname is None or at.hostname.casefold().rstrip(".") not in ("doi.org", "dx.doi.org") or at.username is not None:
                return None
            text = unquote(at.path).lstrip("/")
        text = text.strip().casefold()
        return text if re.fullmatch(r"10\.\d{4,9}/\S+", text) else None

    given = ["".join(p[r.integers(0, len(p))] for p in parts) for _ in range(1500)]
    got = one(spark, T.normalize_doi, *given)
    assert [(g, a, want(g)) for g, a in zip(given, got) if a != want(g)] == [] and sum(x is not None for x in got) > 100


def test_names_fold_every_script(spark):
    assert one(spark, T.file_format, "ＣＳＶ", ".Ｆits", "text/ＣSV ; x", None) == ["csv", "fits", "csv", None]
    assert one(spark, T.license_label, "ＭＩＴ　License", "https://CreativeCommons.org/licenses/BY/4.0", "//creativecommons.org/licenses/by-nc/4.0/", "CC ＢＹ 4.0/") == ["MIT", "CC-BY-4.0", "//creativecommons.org/licenses/by-nc/4.0/", "CC-BY-4.0"]
    columns = spark.createDataFrame([("a", 0, "STRASSE"), ("a", 1, "Ｍａｇ (AB)")], "artifact_id string, column_index int, header string")
    targets = spark.createDataFrame([("straße",), ("mag ab",)], "target_field string")
    assert {(r.column_index, r.target_field) for r in E.map_columns(columns, targets).collect()} == {(0, "straße"), (1, "mag ab")}
    planned = spark.createDataFrame([("Große  DATEN",), ("neu",)], "q string")
    assert [r.q for r in P.new_queries(planned, spark.createDataFrame([("GROSSE daten",)], "q string"), "q").collect()] == ["neu"]


@pytest.mark.parametrize("make, want", [(T.nfkc, lambda v: unicodedata.normalize("NFKC", v)), (T.case_folded, lambda v: unicodedata.normalize("NFKC", v).casefold())])
def test_folding(spark, make, want):
    given = ["Plain ASCII", "ﬁ", "İ", "ẞ", "Å", "", "Ⅷ²", "é", "K\x00"]
    assert one(spark, make, *given, None) == [*map(want, given), None]
    assert spark.range(1).select(make(F.lit("A\n")).alias("x")).first().x == want("A\n")
