"""Rows that share a key or have none, in redaction and near-duplicate detection."""

import hashlib

from tracewell.llm import minhash, secrets


def test_redact_with_repeated_and_null_keys(spark):
    a, b = hashlib.sha1(b"a").hexdigest(), hashlib.sha1(b"b").hexdigest()
    one, two = f'x token = "{a}" and then clean words follow here', f'some longer opening, token = "{b}" and clean words'
    rows = [(1, one), (1, one), (1, two), (None, one), (None, two), (2, "clean words only"), (1, "clean words only"), (2, None), (None, None)]
    want = [(k, t and t.replace(a, secrets.MASK).replace(b, secrets.MASK)) for k, t in rows]
    got = secrets.redact(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_links_of_every_text_of_a_key(spark):
    texts = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcdef"]
    near = lambda t: t + " more"
    rows = [(5, texts[0]), (5, texts[1]), (5, texts[2]), (7, near(texts[0])), (8, near(texts[1])), (9, near(texts[2])), (3, near(near(texts[2])))]
    rows += [(20, texts[3]), (21, texts[4]), (21, ""), (None, texts[3]), (None, texts[0]), (30, texts[5]), (30, texts[5]), (40, None)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    lowest = {5: 3, 7: 3, 8: 3, 9: 3, 3: 3, 20: 20, 21: 21, 30: 30, 40: 40, None: None}
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == sorted((str(k), str(lowest[k])) for k, _ in rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)
    assert sorted(r.n_shingles for r in got if r.doc_id == 21) == [0, 56]
