"""Document fingerprints from closed syncmers, in SQL expressions alone.

A text's words are hashed. A run of ``K`` words is kept if, among the hashes of its inner runs of ``S`` words, the least
is the first or the last. Whether a run is kept depends on its own words only, so the same passage gives the same
anchors in any text, and about 2 in K - S + 1 runs are anchors. The anchors' hashes in text order are the fingerprint.

Nulls and edge cases: a null text counts as empty and has no anchors. A text with fewer than K words, or none of
whose runs is kept, has one anchor, the hash of all its words, or of the text itself if it has no words. Texts are
read whole. Two texts without anchors are alike (1), one without and one with are not (0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, S = 7, 2
#: Documents of one neighbourhood, and groups of neighbours at most: what is broadcast has a row for each group.
GROUP, GROUPS = 256, 200_000
#: Quantiles of the keys that ranges are cut between.
SEGMENTS = 100
#: Everything in ASCII that is neither letter nor digit parts words.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def with_anchors(df: DataFrame, text: str, to: str, k: int = K, s: int = S, positions: str | None = None) -> DataFrame:
    """``df`` with the hashes of the anchors of ``text`` in text order (array<int>), and, if a name is given, the
    number of the word that each begins at. Working columns start with an underscore."""
    inner = k - s + 1
    words = F.filter(F.split(F.coalesce(df[text], F.lit("")), BETWEEN, -1), lambda w: w != "")
    df = df.withColumn("_h", F.transform(words, lambda w: F.xxhash64(w)))
    upto = lambda n: F.when(F.size("_h") >= k, F.sequence(F.lit(0), F.size("_h") - n)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_g", F.transform(upto(s), lambda i: F.xxhash64(*[F.get("_h", i + j) for j in range(s)])))

    def kept(i: Column) -> Column:
        first, last = F.get("_g", i), F.get("_g", i + (inner - 1))
        return F.least(first, last) <= F.least(*[F.get("_g", i + j) for j in range(1, inner - 1)])

    df = df.withColumn("_at", F.filter(upto(k), kept))
    hashes = F.transform("_at", lambda i: F.hash(*[F.get("_h", i + j) for j in range(k)]))
    alone = F.when(F.size("_h") > 0, F.array(F.hash("_h"))).when(F.length(text) > 0, F.array(F.hash(F.col(text)))).otherwise(F.array().cast("array<int>"))
    some = F.size("_at") > 0
    df = df.withColumn(to, F.when(some, hashes).otherwise(alone))
    if positions:
        df = df.withColumn(positions, F.when(some, F.col("_at")).otherwise(F.transform(to, lambda _: F.lit(0))))
    return df.drop("_h", "_g", "_at")


def fingerprint(anchors: Column) -> Column:
    """Eight hexadecimal digits for each anchor, in text order."""
    return F.concat_ws("", F.transform(anchors, lambda a: F.lpad(F.lower(F.hex(a.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of anchors."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)).cast("double"))


def with_next(df: DataFrame, key: str, text: str, carried: tuple[str, ...] = (), prepare=lambda rows: rows) -> DataFrame:
    """Rows with the text of the row after them in descending order of the key; after the last comes the first.

    Rows are dealt out by ranges of the key, one shuffle for the text, and each range is given a copy of the row that
    follows it. Which one that is, is found on a table of one row for each range, GROUPS at most; this table is broadcast.
    Ranges are cut between SEGMENTS quantiles of the keys, and evenly within each, so that a few far keys or a gap do not
    gather the others in one range. ``prepare`` adds columns once rows are dealt; ``carried`` names those whose next value
    is wanted too. Null keys come last; rows with equal keys are put in order by a hash of the text. Keys are integers.
    """
    rows = df.select(df[key].cast("long").alias(key), F.coalesce(df[text].cast("string"), F.lit("")).alias(text))
    shares = F.array(*[F.lit(i / SEGMENTS) for i in range(1, SEGMENTS)])
    found = rows.agg(F.count(F.lit(1)), F.min(key), F.max(key), F.percentile_approx(key, shares, 10 * SEGMENTS)).first()
    ranges = max(1, min(-(-found[0] // (GROUP * SEGMENTS)), GROUPS // SEGMENTS))  # of each segment
    edges = F.array(*[F.lit(e) for e in sorted({float(e) for e in (found[1], *found[3], found[2])})]) if found[1] is not None else F.array(F.lit(0.0))
    # doubles: whatever they round, a larger key is in no earlier range
    value = F.col(key).cast("double")
    segment = F.size(F.filter(edges, lambda e: e <= value))
    low = F.get(edges, segment - 1)
    span = F.greatest(F.coalesce(F.get(edges, segment), low) - low, F.lit(1.0))
    within = F.least(F.floor((value - low) / span * ranges), F.lit(ranges - 1))
    group = F.when(value.isNull(), F.lit(-1).cast("long")).otherwise((segment * ranges + within).cast("long"))
    place = F.struct(F.coalesce(F.col(key), F.lit(-(1 << 63))).alias("k"), F.xxhash64(text).alias("t"))
    rows = rows.select("*", group.alias("_group"), place.alias("_place"))
    heads = rows.groupBy("_group").agg(F.max("_place").alias("_head"))
    order = Window.orderBy(F.col("_group").desc())
    around = heads.select("_head", F.lag("_group").over(order).alias("_to"), F.min("_group").over(Window.partitionBy()).alias("_last"))
    halo = F.broadcast(around.select("_head", F.coalesce("_to", "_last").alias("_to")))
    copies = rows.join(halo, F.col("_place") == F.col("_head")).select(key, text, F.col("_to").alias("_group"), "_place", F.lit(True).alias("_copy"))
    dealt = prepare(rows.withColumn("_copy", F.lit(False)).unionByName(copies).repartition("_group"))
    within = Window.partitionBy("_group").orderBy("_copy", F.col("_place").desc())
    ahead = [F.lead(c).over(within).alias(f"next_{c}") for c in (text, *carried)]
    return dealt.select("*", *ahead).where(~F.col("_copy")).drop("_group", "_place", "_copy")


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last half (code points, rounded down) replaced by as much of the following text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.left(text, F.length(text) - half), F.left(following, half))


def fingerprints(df: DataFrame, key: str, text: str) -> DataFrame:
    """Per row: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next."""
    rows = with_next(df, key, text, ("_own",), lambda r: with_anchors(r, text, "_own"))
    rows = rows.select(key, F.length(text).cast("long").alias("n_chars"), "_own", F.col("next__own").alias("_next"), edited(F.col(text), F.col(f"next_{text}")).alias("_edited"))
    rows = with_anchors(rows, "_edited", "_other")
    return rows.select(
        key,
        "n_chars",
        F.sha2("_edited", 256).alias("edited_sha256"),
        fingerprint(F.col("_own")).alias("fingerprint"),
        fingerprint(F.col("_other")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_other")).alias("near_edited"),
        likeness(F.col("_own"), F.col("_next")).alias("near_next"),
    )
