"""Near-duplicate detection by circulant MinHash, banding and exact Jaccard verification.

Two permutations of the 32-bit integers are used for all coordinates of a signature: the first scatters the shingles,
the second, shifted circularly by k, orders them for coordinate k (C-MinHash). Bands of ``ROWS`` coordinates are keys;
documents that share a key are candidates, and a link holds only if the full shingle sets say so.

No pairs of a bucket are enumerated. Documents with equal sets are one class from the start. In each bucket the members
are compared with its smallest; then, as long as a bucket holds several components, members of different components
are (see ``_second_look``).

Nulls and edge cases: a null text or one without words has the empty set, is linked with nothing and is kept. A text
with fewer words than a shingle has its whole sequence as its one shingle. Keys must be integers; rows that repeat a
key are one document if their texts agree, and share the key's component in any case. A null key is its own document
and is left out of the links. Other columns are ignored. An empty table works.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.arrowkit import NONSPACE, U64, buffers, chunks, mix64, split_words
from tracewell.llm.components import components
from tracewell.llm.storage import written

#: At similarity 0.8 a pair shares none of 40 bands of 5 with a chance of 1.2e-7.
BANDS, ROWS = 40, 5
#: Members of a bucket up to which all of different components are compared; larger buckets meet over rare shingles.
FEW = 8
#: Ids up to which they are broadcast to pick out their texts (16 bytes each).
BROADCAST_IDS = 1_000_000
U32 = np.uint32


def shingles(words_hash: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document, as 52-bit hashes in order, and where each document's begin."""
    docs = len(first) - 1
    count = np.diff(first)
    runs = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    begin = np.cumsum(runs) - runs
    doc = np.repeat(np.arange(docs), runs)
    start = first[:-1][doc] + np.arange(len(doc)) - begin[doc]
    value = np.zeros(len(start), U64)
    for i in range(size):
        inside = i < count[doc]  # only a text with fewer words than a shingle runs out of them
        at = np.minimum(start + i, max(0, len(words_hash) - 1))
        value = mix64(value * U64(0xD6E8FEB86659FD93) + np.where(inside, words_hash[at], U64(i + 1)))
    tagged = (doc.astype(U64) << U64(52)) | (value >> U64(12))
    tagged.sort()
    if len(tagged):
        tagged = tagged[np.concatenate([[True], tagged[1:] != tagged[:-1]])]
    owner = (tagged >> U64(52)).astype(np.int64)
    return tagged & U64((1 << 52) - 1), np.searchsorted(owner, np.arange(docs + 1))


def scatter(values: np.ndarray) -> np.ndarray:
    """The first permutation, after folding to 32 bits."""
    return (mix64(values) >> U64(32)).astype(U32)


def circulant(points: np.ndarray, first: np.ndarray, coordinates: int) -> np.ndarray:
    """[documents, coordinates]: the least value that the second permutation, shifted by k, gives to a document's points.

    Documents without points must be left out."""
    out = np.empty((len(first), coordinates), U32)
    x, y = np.empty_like(points), np.empty_like(points)
    for k in range(coordinates):
        np.add(points, U32((k * 0x9E3779B1) & 0xFFFFFFFF), out=x)  # multiples of an odd number run through all shifts
        np.right_shift(x, U32(16), out=y)
        np.bitwise_xor(x, y, out=x)
        np.multiply(x, U32(0x7FEB352D), out=x)
        np.right_shift(x, U32(15), out=y)
        np.bitwise_xor(x, y, out=x)
        np.multiply(x, U32(0x846CA68B), out=x)
        np.right_shift(x, U32(16), out=y)
        np.bitwise_xor(x, y, out=x)
        out[:, k] = np.minimum.reduceat(x, first)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """[documents, bands] 64-bit keys."""
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=U64) * U64(0x9E3779B97F4A7C15), (len(signature), bands)).copy()
    for r in range(rows):
        key = mix64(key * U64(0xD6E8FEB86659FD93) + signature[:, r : bands * rows : rows].astype(U64))
    return key


def sketch(df: DataFrame, key: str, text: str, size: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id, n (shingles), h1 and h2 (a 128-bit hash of the set) and bands (empty for the empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for at, last, part, own in chunks(data, offsets):
                for s in range(at, last, 4096):  # a document's number has 12 bits
                    e = min(s + 4096, last)
                    lo, hi = own[s - at], own[e - at]
                    words = split_words(part[lo:hi], own[s - at : e - at + 1] - lo, NONSPACE, lower=True)
                    values, first = shingles(words.hashes, words.first, size)
                    n = np.diff(first)
                    some = np.flatnonzero(n)
                    h1, h2 = np.zeros(e - s, U64), np.zeros(e - s, U64)
                    keys = np.zeros((0, bands), U64)
                    if len(some):
                        begin = first[:-1][some]
                        h1[some] = np.add.reduceat(mix64(values), begin)
                        h2[some] = np.add.reduceat(mix64(values ^ U64(0xA5A5A5A5A5A5A5A5)), begin)
                        keys = band_keys(circulant(scatter(values), begin, bands * rows), bands, rows)
                    ends = np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(ends, keys.view(np.int64).ravel())
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s), pa.array(n), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), lists], names=["id", "n", "h1", "h2", "bands"])

    return df.select(df[key].cast("long").alias("id"), df[text].cast("string").alias("text")).mapInArrow(run, "id long, n long, h1 long, h2 long, bands array<long>")


def similar_pairs(pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The (a, b) whose shingle sets have 100 * intersection >= percent * union. pairs: a, b, text_a, text_b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, left_at = buffers(batch.column(2))
            right, right_at = buffers(batch.column(3))
            begin = 0
            while begin < batch.num_rows:
                room = np.maximum(left_at[begin:] - left_at[begin], right_at[begin:] - right_at[begin])
                end = min(max(begin + 1, begin + int(np.searchsorted(room, 1 << 19, side="right")) - 1), batch.num_rows, begin + 4096)
                tagged, counts = [], []
                for data, at in ((left, left_at), (right, right_at)):
                    own = at[begin : end + 1]
                    words = split_words(data[own[0] : own[-1]], own - own[0], NONSPACE, lower=True)
                    values, first = shingles(words.hashes, words.first, size)
                    counts.append(np.diff(first))
                    tagged.append((np.repeat(np.arange(end - begin).astype(U64), counts[-1]) << U64(52)) | values)
                both = np.intersect1d(*tagged, assume_unique=True)
                inter = np.bincount((both >> U64(52)).astype(np.int64), minlength=end - begin)
                union = counts[0] + counts[1] - inter
                keep = pa.array((100 * inter >= percent * union) & (union > 0))
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(begin, end - begin).filter(keep) for i in (0, 1)], names=["a", "b"])
                begin = end

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Candidate pairs with their texts, checked. A hot ``a`` is a skewed join key, which adaptive execution splits."""
    with_b = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    with_both = with_b.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    return written(similar_pairs(with_both, size, percent), "links")


def _shared_buckets(classes: DataFrame) -> DataFrame:
    """key, id, n and lead (the smallest member) of the buckets that several classes share."""
    buckets = classes.select("id", "n", F.explode("bands").alias("key"))
    leaders = buckets.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("_high")).where("lead < _high").select("key", "lead")
    return buckets.join(leaders, "key")


def _fits(percent: int):
    """Can two sets be similar? m is how many shingles a set may share with others at most, n how many it has."""
    inter = F.least("m", "m2")
    return 100 * inter >= percent * (F.col("n") + F.col("n2") - inter)


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows (key, id, n, m, component) of keys with several components, with the key's members and its largest
    component."""
    parts = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("members"))
    kinds = parts.groupBy("key").agg(F.sum("members").alias("members"), F.max(F.struct("members", "component")).alias("big")).where("members > big.members")
    return rows.join(kinds.select("key", "members", F.col("big.component").alias("big")), "key")


def _across(mixed: DataFrame, percent: int) -> DataFrame:
    """Members outside a key's largest component with all members of other components, where the sets fit."""
    out = mixed.where("component <> big").select("key", F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("m").alias("m2"), F.col("component").alias("component2"))
    pairs = mixed.join(out, "key").where((F.col("component") != F.col("component2")) & _fits(percent))
    return pairs.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"))


def _prefixes(ids: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """key, id, n, m, component: the rarest shingles of each document, as many as it can lack and yet be similar and
    one more, so that two similar documents have one of these in common; m counts the shingles from this one on. Two
    documents share none before the first that they share, so at its key m bounds what they share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for at, last, part, own in chunks(data, offsets):
                for s in range(at, last, 4096):
                    e = min(s + 4096, last)
                    lo, hi = own[s - at], own[e - at]
                    words = split_words(part[lo:hi], own[s - at : e - at + 1] - lo, NONSPACE, lower=True)
                    values, first = shingles(words.hashes, words.first, size)
                    lists = pa.ListArray.from_arrays(first.astype(np.int32), values.view(np.int64))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s), lists], names=["id", "keys"])

    sets = texts.join(ids.select("id"), "id").select("id", "text").mapInArrow(run, "id long, keys array<long>")
    grams = written(sets, "grams").select("id", F.explode("keys").alias("key"))
    rarity = grams.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = grams.join(rarity, "key").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("all"))
    # shingles of one document only come first in order and bring nobody together: they shorten what is left to look at
    left = F.size("all") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1
    cut = shared.join(ids, "id").where(left > 0)
    cut = cut.select("id", "n", "component", F.size("all").alias("_all"), F.posexplode(F.slice("all", F.lit(1), left.cast("int"))).alias("at", "g"))
    return cut.select("g.key", "id", "n", (F.col("_all") - F.col("at")).cast("long").alias("m"), "component")


def _second_look(shared: DataFrame, label: DataFrame, tried: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs of different components that share a bucket and were not compared yet.

    In a bucket of few members all such pairs are compared. Members of a larger one, as a passage in otherwise
    different documents or a group around the threshold makes, meet over their rarest shingles, which finds every
    similar pair among them; a pair that can't be similar by where the shared one stands in both orders is left out.
    """
    rows = shared.join(label, "id", "left").select("key", "id", "n", F.col("n").alias("m"), F.coalesce("component", "id").alias("component"))
    mixed = written(_mixed(rows), "mixed")
    pairs = _across(mixed.where(F.col("members") <= FEW), percent)
    ids = written(mixed.where(F.col("members") > FEW).select("id", "n", "component").distinct(), "crowded")
    if not ids.isEmpty():
        pairs = pairs.unionAll(_across(_mixed(_prefixes(ids, texts, size, percent)), percent))
    return pairs.distinct().join(tried, ["a", "b"], "left_anti")


def _only(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of some ids; broadcast while the ids are few, so that only these texts are ever shuffled."""
    small = ids.count() <= BROADCAST_IDS
    return texts.join(F.broadcast(ids) if small else ids, "id", "left_semi")


def near_duplicates(df: DataFrame, key: str, text: str, size: int = 5, percent: int = 80) -> DataFrame:
    """Per row: key, n_shingles, component_id (the smallest key that links lead to) and kept (is it this one?)."""
    rows = df.select(df[key].cast("long").alias("id"), df[text].cast("string").alias("text"))
    names = None
    if _repeats(rows):  # a number for each row, so that a link is always checked against the text it was made from
        numbered = written(rows.withColumn("row", F.when(F.col("id").isNotNull(), F.monotonically_increasing_id())), "rows")
        rows, names = numbered.select(F.col("row").alias("id"), "text"), numbered.where("row is not null").select("row", F.col("id").alias("name"))
    sketches = written(sketch(rows, "id", "text", size), "sketches")
    real = sketches.where("n > 0 and id is not null")
    classes = real.groupBy("h1", "h2", "n").agg(F.min("id").alias("id"), F.first("bands").alias("bands"))
    shared = written(_shared_buckets(classes), "buckets")
    texts = written(_only(rows, shared.select("id").distinct()), "texts")
    tried = shared.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    sizes = classes.select("id", "n")
    tried = tried.join(sizes.select(F.col("id").alias("a"), F.col("n").alias("n2")), "a").join(sizes.select(F.col("id").alias("b"), "n"), "b")
    tried = written(tried.where(100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")).select("a", "b"), "candidates")
    links = _verified(tried, texts, size, percent)
    own = real.select("id", "h1", "h2", "n").join(classes.select("h1", "h2", "n", F.col("id").alias("class")), ["h1", "h2", "n"])
    copies = written(own.where("id <> class").select(F.col("class").alias("a"), F.col("id").alias("b")), "copies")
    if names is not None:  # rows with one key are one document
        first = names.groupBy("name").agg(F.min("row").alias("a"))
        copies = written(copies.unionAll(names.join(first, "name").where("row <> a").select("a", F.col("row").alias("b"))), "copies")
    while True:
        label = components(links.unionAll(copies))
        again = written(_second_look(shared.drop("lead"), label, tried, texts, size, percent), "candidates")
        if again.isEmpty():
            break
        more = _verified(again, texts, size, percent)
        tried = tried.unionAll(again)
        if more.isEmpty():
            break
        links = links.unionAll(more)
    out = sketches.select("id", "n").join(label, "id", "left")
    if names is not None:  # back from numbers to keys
        known = names.join(label.withColumnRenamed("id", "row"), "row", "left").withColumn("component", F.coalesce("component", "row"))
        known = known.join(known.groupBy("component").agg(F.min("name").alias("lowest")), "component").select(F.col("row").alias("id"), "name", "lowest")
        out = sketches.select("id", "n").join(known, "id", "left").select(F.col("name").alias("id"), "n", F.col("lowest").alias("component"))
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def _repeats(rows: DataFrame) -> bool:
    """Does any key stand in several rows?"""
    return not rows.where("id is not null").groupBy("id").count().where("count > 1").isEmpty()
