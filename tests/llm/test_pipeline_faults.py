"""The pipeline's stages on rows that share an id or have none, and on tables without labels or with clashing columns."""

import hashlib

import corpus_pipeline as P

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [" ".join(f"{c}{i}" for i in range(40)) for c in ("ab", "cd", "ef")]


def rows_of(df):
    return sorted((repr(r.doc_id), r.text) for r in df.collect())


def test_tables_without_labels_keep_their_texts(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the cat", None, "s", 7), (2, "é", None, "s", 1), (3, "12 !", None, "s", 4), (4, None, None, "s", 0), (None, "日本", None, "s", 2)], SCHEMA)
    assert rows_of(P.language(spark, docs, str(tmp_path))) == [("1", "the cat"), ("2", "é"), ("None", "日本")]


def test_repeated_and_null_ids_lose_their_copies(spark, tmp_path):
    a, b, c = WORDS
    rows = [(7, a), (7, a), (7, a), (3, a + " more"), (None, b), (None, b), (9, b + " more"), (5, c), (5, "something else altogether"), (None, "alone")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA).withColumn("_row", P.F.lit("clash"))
    got = P.deduplicate(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert rows_of(got) == sorted([("3", a + " more"), ("9", b + " more"), ("5", c), ("5", "something else altogether"), ("None", "alone")])


def test_contaminated_rows_go_whatever_their_id(spark, tmp_path):
    item = " ".join(f"w{i}" for i in range(20))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, "x " + item), (None, "clean text"), (1, item), (1, "clean text"), (2, None), (3, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).withColumn("_sha", P.F.lit("clash"))
    got = P.clean_of_benchmark(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert sorted((repr(r.doc_id), repr(r.text)) for r in got.collect()) == sorted((repr(i), repr(t)) for i, t in [(None, "clean text"), (1, "clean text"), (2, None), (3, "")])


def test_masking_leaves_the_rest_of_repeated_rows(spark, tmp_path):
    key = hashlib.sha1(b"a").hexdigest()
    text = f'a token = "{key}" and here follows a sentence that must stay whole.'
    docs = spark.createDataFrame([(1, text, "en", "s", 0), (1, text, "en", "s", 0), (None, text, "en", "s", 0)], SCHEMA)
    clean = text.replace(key, "[SECRET]")
    assert [(r.text, r.n_chars) for r in P.mask_secrets(spark, docs, str(tmp_path)).collect()] == [(clean, len(clean))] * 3
