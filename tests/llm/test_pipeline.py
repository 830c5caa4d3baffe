"""The corpus pipeline against a brute-force version, and its queries' registration."""

import os
import re

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.test_text_operators import brute_contamination, brute_near

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = set(entry.queries())
    assert "pipeline" in names
    assert all(len([n for n in names if n.startswith(f"op{i}_")]) == 1 for i in range(1, 11))
    assert set(entry.oracle_sql()) <= names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "secret_scan", "bpe"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_pipeline_equals_brute_force(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = [(i, t) for i, t in docs if t is not None and any(c.isalpha() for c in t)]
    near = brute_near([t for _, t in kept], 5, 80)
    kept = [d for d, (_, _, first) in zip(kept, near, strict=True) if first]
    hits = brute_contamination([t for _, t in kept], items)
    kept = [d for d, (n, hit, _) in zip(kept, hits, strict=True) if not (hit and 20 * hit >= n)]
    # the only secrets in these tables are assigned digests of 40 hexadecimal digits
    kept = [(i, re.sub(r'(?i)(token = ")[0-9a-f]{40}(")', r"\1[SECRET]\2", t)) for i, t in kept]
    library = tokenizers.Tokenizer.from_file(path)
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in kept}
    got = {r.doc_id: list(r.token_ids) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want


def test_stages_on_nulls_and_nothing(spark, tmp_path):
    spark.createDataFrame([(1, "some benchmark text")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, None, None, None, None), (2, "", "en", None, None), (3, "the cat sat on the mat", "en", "s", 22), (4, "the cat sat on the mat", None, "s", 22), (5, "123", "en", "s", 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for given, left in ((rows, [3]), ([], [])):
        docs = spark.createDataFrame(given, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert [r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()] == left
