"""Title keys of whole texts of all rows against brute force."""

import os
import unicodedata

import pytest

from tracewell.plans import catalog

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def brute_title(text):
    if text is None:
        return None
    low = unicodedata.normalize("NFKC", text).casefold()
    return " ".join("".join(" " if unicodedata.category(c)[0] == "P" else c for c in low).split())


def test_title_keys_of_whole_texts(spark, tmp_path):
    texts = [None, "", "Straße — ÉTÉ «ça»", "ﬁne\u00a0Ⅳ… ¿Qué?", "A-b_c", "word, " * 100 + "END über ẞ!"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.k for r in catalog.QUERIES["title_keys"](spark, str(tmp_path)).collect()}
    assert got == {i: brute_title(t) for i, t in enumerate(texts)}


@tables
def test_title_keys_of_all_documents(spark):
    got = {r.doc_id: r.k for r in catalog.QUERIES["title_keys"](spark, SF).collect()}
    assert got == {r.doc_id: brute_title(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
