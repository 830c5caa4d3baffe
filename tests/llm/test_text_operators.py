"""Operators on texts against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import arrowkit, bpe, decontaminate, fmindex, langid, minhash, secrets, sharding, substring, syncmers, warc

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RNG = np.random.default_rng(5)
WORDS = ["".join(chr(97 + c) for c in RNG.integers(0, 26, RNG.integers(1, 7))) for _ in range(300)]


def sentence(n, seed, words=WORDS):
    r = np.random.default_rng(seed)
    return " ".join(words[i] for i in r.integers(0, len(words), n))


LONG = sentence(4000, 1)
PASSAGE = sentence(60, 2)
TEXTS = [
    None,
    "",
    "   ",
    "one",
    "Two words",
    sentence(200, 3),
    sentence(200, 3),
    sentence(180, 4) + " " + PASSAGE,
    PASSAGE + "\n" + sentence(150, 5),
    "x " * 90,
    LONG,
    LONG.replace(WORDS[3], "changed"),
    "é " * 3 + "日本語 テキスト, 12 <|endoftext|> it's",
    sentence(34, 6),
    sentence(35, 7),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "src", -1, "clash") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, key string").repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def vocabulary(name):
    return pytest.importorskip("public_tokenizers").path(name)


# --- shared words -----------------------------------------------------------------------------------------------------


def test_words_are_those_of_the_pattern():
    import pyarrow as pa

    texts = ["", "A b1_c", "x", "É-é  z", "end ", "next"]
    data, offsets = arrowkit.buffers(pa.array([*texts, None]))
    for table, lower, pattern in ((arrowkit.ALNUM, True, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (arrowkit.NONSPACE, False, r"[^\x20\x09-\x0D]+")):
        w = arrowkit.split_words(data, offsets, table, lower)
        got = [[w.text(i).decode() for i in range(w.first[d], w.first[d + 1])] for d in range(len(texts))]
        assert got == [re.findall(pattern, t.translate(LOWER) if lower else t) for t in texts]
        by_hash = {h: w.text(i) for i, h in enumerate(w.hashes.tolist())}
        assert len(by_hash) == len({w.text(i) for i in range(len(w.doc))})


# --- 1 ------------------------------------------------------------------------------------------------------------------


def test_warc(spark, tmp_path):
    body = "<p>" + "x" * 200
    rows = [(3, "u", body), (1, "u", body), (2, "http://a\r\nX: y", body), (4, "u", "small"), (5, "u", "small"), (6, None, None), (7, "u", ""), (8, "u", body + "é"), (1, "u", body), (None, "u", body)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = warc.archive_records(df, "page_id", "url", "html").collect()
    assert len(got) == len(rows)
    for r in got:
        mine = {(t or "").encode() for p, _, t in rows if p == r.page_id}
        assert r.payload_digest in {hashlib.sha256(m).hexdigest() for m in mine} and r.payload_bytes in {len(m) for m in mine}
        revisit = r.payload_bytes == len(body) and r.page_id != 1
        assert (r.record_type, r.refers_to) == (("revisit", 1) if revisit else ("response", None))
    path = str(tmp_path / "archive")
    warc.write_archive(df, path, "page_id", "url", "html")
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    record = warc.read_archive(spark, path).where("key = 8").first().record
    head, rest = bytes(record).split(b"\r\n\r\n", 1)
    block = int(re.search(rb"Content-Length: (\d+)", head)[1])
    assert rest[block:] == b"\r\n\r\n" and rest[:block].split(b"\r\n\r\n", 1)[1] == (body + "é").encode()
    warc.export_warc(spark, path, str(tmp_path / "files"))
    assert warc.archive_records(df.limit(0), "page_id", "url", "html").count() == 0


def test_warc_path_for_many_repeated_payloads(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", -1)
    df = spark.createDataFrame([(i, "u", "y" * (100 + i % 3)) for i in range(9)], "page_id long, url string, html string")
    got = {r.page_id: r.refers_to for r in warc.archive_records(df, "page_id", "url", "html").collect()}
    assert got == {i: (i % 3 if i > 2 else None) for i in range(9)}


# --- 2 ------------------------------------------------------------------------------------------------------------------


def test_syncmers_match_their_definition(spark, docs):
    rows = syncmers.with_anchors(docs.select("doc_id", "text"), "text", "a", positions="at").select("doc_id", "a", "at").collect()
    for r in rows:
        words = [w for w in re.split(syncmers.BETWEEN, TEXTS[r.doc_id] or "") if w]
        if len(words) < syncmers.K:
            assert len(r.a) == (1 if TEXTS[r.doc_id] else 0)
            continue
        assert len(r.a) == len(r.at) and r.at == sorted(r.at)
    hashes = {r.w: r.h for r in spark.createDataFrame([(w,) for w in {w for w in re.split(syncmers.BETWEEN, LONG) if w}], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    words = [hashes[w] for w in re.split(syncmers.BETWEEN, LONG) if w]
    pairs = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(words, words[1:]))], "i int, a long, b long").select("i", F.xxhash64("a", "b").alias("g")).orderBy("i").collect()
    g = [p.g for p in pairs]
    inner = syncmers.K - syncmers.S + 1
    want = [i for i in range(len(words) - syncmers.K + 1) if min(g[i : i + inner]) in (g[i], g[i + inner - 1])]
    assert next(r.at for r in rows if r.doc_id == TEXTS.index(LONG)) == want


def test_fingerprints(docs, none, monkeypatch):
    monkeypatch.setattr(syncmers, "GROUP", 4)
    got = {r.doc_id: r for r in syncmers.fingerprints(docs, "doc_id", "text").collect()}
    assert len(got) == len(TEXTS)
    n = len(TEXTS)
    for i in range(n):
        own, other = TEXTS[i] or "", TEXTS[(i - 1) % n] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + other[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[5].fingerprint == got[6].fingerprint and got[6].near_next == 1.0
    assert syncmers.fingerprints(none, "doc_id", "text").count() == 0


# --- 3 ------------------------------------------------------------------------------------------------------------------


def test_suffix_array_and_search():
    r = np.random.default_rng(0)
    for n in (1, 5, 60, 400):
        text = np.append(r.integers(0, 4, n), 0)
        index = fmindex.FMIndex(text, 3)
        for length in (1, 2, 5, 17):
            phrases = r.integers(1, 4, (20, length))
            low, high = index.search(phrases)
            for p, a, b in zip(phrases, low, high, strict=True):
                want = [i for i in range(len(text) - length + 1) if (text[i : i + length] == p).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def brute_contamination(texts, items):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = {}
    for name, text in items:
        w = find(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add(name)
    out = []
    for t in texts:
        w, hit, names = find(t), set(), set()
        for i in range(len(w)):
            for size in {len(k) for k in windows}:
                if tuple(w[i : i + size]) in windows and i + size <= len(w):
                    hit |= set(range(i, i + size))
                    names |= windows[tuple(w[i : i + size])]
        out.append((len(w), len(hit), sorted(x for x in names if x is not None)))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_contamination(spark, docs, none, block_bytes):
    items = [("7", PASSAGE), ("10", " ".join(PASSAGE.split()[20:40]).upper()), ("2", "Two, words"), ("3", None), ("4", "--"), (None, "one"), ("7", sentence(20, 3))]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    got = decontaminate.find_contamination(docs, "doc_id", "text", benchmark, "item_id", "text", block_bytes=block_bytes).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, r.items) for r in got] == brute_contamination(TEXTS, items)
    spans = got[7].spans
    assert [TEXTS[7].encode()[s.first_byte : s.past_byte].decode() for s in spans] == [PASSAGE]
    assert decontaminate.find_contamination(none, "doc_id", "text", benchmark, "item_id", "text").count() == 0
    assert decontaminate.find_contamination(docs, "doc_id", "text", benchmark.limit(0), "item_id", "text").where("n_hit > 0").count() == 0


# --- 4 ------------------------------------------------------------------------------------------------------------------


def test_bpe_equals_the_library(docs, none):
    path = vocabulary("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in bpe.round_trip(docs, "doc_id", "text", path).collect()}
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want = (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode()))
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want
    coded = bpe.decode(bpe.encode(docs, "text", path), "token_ids", path, "back")
    assert all((r.text or "") == r.back for r in coded.collect())
    assert bpe.round_trip(none, "doc_id", "text", path).count() == 0


def test_segment_tree_takes_leftmost_lowest_rank():
    ranks = bpe.PairRanks(np.array([[2, 2], [1, 2], [2, 1], [4, 2]]), np.array([3, 4, 5, 6]))
    words = np.array([[2, 2, 2, 2], [1, 2, 1, 2], [2, 2, 2, -1], [1, 2, 2, 2]])
    assert bpe.merge_words(words, ranks).tolist() == [[3, -1, 3, -1], [4, -1, 4, -1], [3, -1, 2, -1], [1, 3, -1, 2]]


# --- 5 ------------------------------------------------------------------------------------------------------------------


def brute_repeats(texts, window=35):
    words = [(t or "").encode().split() for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return out


@pytest.mark.parametrize("hot", [substring.HOT, 0])
def test_repeats(docs, none, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT", hot)
    got = substring.remove_repeats(docs, "doc_id", "text").orderBy("doc_id").collect()
    assert [(r.n_words, r.n_removed, r.kept) for r in got] == brute_repeats(TEXTS)
    assert substring.remove_repeats(none, "doc_id", "text").count() == 0


def test_repeats_of_repeated_and_null_keys(spark):
    texts = [LONG, LONG, sentence(50, 9), sentence(50, 9), PASSAGE]
    df = spark.createDataFrame(list(zip([1, 1, None, None, 1], texts, strict=True)), "doc_id long, text string")
    got = sorted((r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(df, "doc_id", "text").collect())
    assert got == sorted(brute_repeats(texts))


def test_suffix_automaton_counts():
    r = np.random.default_rng(3)
    for _ in range(30):
        parts = [(r.integers(0, 2, r.integers(3, 25)).tolist(), int(r.integers(1, 3))) for _ in range(4)]
        automaton = substring.SuffixAutomaton()
        for p, n in parts:
            automaton.add(p, n)
        automaton.finish()
        count = Counter()
        for p, n in parts:
            for i in range(len(p) - 2):
                count[tuple(p[i : i + 3])] += n
        for p, _ in parts:
            assert automaton.repeated(p, 3) == sum(1 << i for i in range(len(p) - 2) if count[tuple(p[i : i + 3])] > 1)


# --- 6 ------------------------------------------------------------------------------------------------------------------


def test_language(spark):
    letters = {"en": "the and of with ing", "de": "der und ich ein ung", "fr": "le les des que eau", "es": "el los que del ción"}
    rows = [(i, sentence(60, i, letters[c].split()), c) for i, c in enumerate([*letters] * 40)] + [(900, None, "en"), (901, "123 !!", "en"), (902, "", None), (903, "der und ein", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in langid.identify(df, "doc_id", "text", "lang").collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "de"]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(i, c) for i, _, c in rows[:160] if got[i].held_out]
    assert sum(got[i].lang_pred == c for i, c in held) / len(held) > 0.95
    nothing = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(nothing, "doc_id", "text", "lang").collect()} == {"und"}


# --- 7 ------------------------------------------------------------------------------------------------------------------


def brute_near(texts, size, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * union:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(len(s), find(i), find(i) == i) for i, s in enumerate(sets)]


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, none, size):
    texts = [*TEXTS]
    for k in range(30):  # a crowd around the threshold, more than a small bucket holds
        w = sentence(120, 50).split()
        for p in np.random.default_rng(k).choice(120, k % 13, replace=False):
            w[p] = f"new{k}{p}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("id", F.lit("clash"))
    got = minhash.near_duplicates(df, "doc_id", "text", size).orderBy("doc_id").collect()
    assert [(r.n_shingles, r.component_id, r.kept) for r in got] == brute_near(texts, size, 80)
    assert minhash.near_duplicates(none, "doc_id", "text", size).count() == 0


def test_circulant_signatures_estimate_jaccard():
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 52, 1000).astype(np.uint64)
    b = np.concatenate([a[:800], r.integers(0, 1 << 52, 200).astype(np.uint64)])
    s = minhash.circulant(np.concatenate([minhash.scatter(a), minhash.scatter(b)]), np.array([0, 1000]), 400)
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.1


# --- 8 ------------------------------------------------------------------------------------------------------------------


def brute_jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * sharding.MULTIPLIER + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash(spark):
    keys = [0, 1, -1, 7, 10**12, -(1 << 63), (1 << 63) - 1, *range(100, 400)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = {r.k: (r.a, r.b, r.c) for r in df.select("k", sharding.jump_hash(F.col("k"), 40).alias("a"), sharding.jump_hash(F.col("k"), 41).alias("b"), sharding.jump_hash(F.col("k"), 1).alias("c")).collect()}
    assert got == {k: (brute_jump(k, 40), brute_jump(k, 41), 0) for k in keys}
    assert all(b == a or b == 40 for a, b, _ in got.values())


def test_assign(spark, docs, none, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_CHUNK", 1)
    more = docs.unionAll(docs.where("doc_id = 5")).unionAll(docs.where("doc_id = 0").withColumn("doc_id", F.lit(None).cast("long")))
    got = sharding.assign(more, "doc_id", "text", 3).collect()
    slots = {s: sorted(r.slot for r in got if r.shard == s) for s in {r.shard for r in got}}
    assert all(v == list(range(len(v))) for v in slots.values()) and len(got) == len(TEXTS) + 2
    for r in got:
        body = ("" if r.doc_id is None else TEXTS[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law) == (len(body) + 16, zlib.crc32(body), "key")
        assert r.shard == brute_jump(-1 if r.doc_id is None else r.doc_id, 3)
    assert sharding.assign(none, "doc_id", "text", 3).count() == 0


# --- 9 ------------------------------------------------------------------------------------------------------------------


def test_secrets(spark, none):
    hexes = hashlib.sha1(b"k").hexdigest()
    texts = [
        None, "", "plain words only", f'a token = "{hexes}" b', f"commit {hexes} fixed it", f'é token = "{hexes}" and password: "{hashlib.md5(b"x").hexdigest()}"',
        "https://www.example.org/path/to/article12345/index.html", "internationalizationconfigurationmanager", sentence(3000, 8) + f' secret = "{hexes}"',
    ]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, start string")
    model = secrets.train(secrets.labelled_findings(spark))
    got = secrets.scan(df, "doc_id", "text", model).collect()
    assert sorted((r.doc_id, texts[r.doc_id][r.start : r.start + r.length] == r.candidate) for r in got) == [(3, True), (5, True), (5, True), (8, True)]
    clean = {r.doc_id: r.text for r in secrets.redact(df, "doc_id", "text", model).collect()}
    assert clean[3] == 'a token = "[SECRET]" b' and clean[5].count("[SECRET]") == 2 and hexes not in clean[8]
    assert all(clean[i] == texts[i] for i in (0, 1, 2, 4, 6, 7))
    assert secrets.scan(none, "doc_id", "text", model).count() == 0


def test_forest_on_held_out_findings(spark):
    findings = secrets.labelled_findings(spark, 6000)
    held = F.pmod(F.xxhash64("candidate", "before"), F.lit(4)) == 0
    judged = secrets.train(findings.where(~held)).transform(secrets.with_features(findings.where(held)))
    assert judged.where("prediction = label").count() / judged.count() > 0.97
