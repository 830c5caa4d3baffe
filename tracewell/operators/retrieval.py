"""Evidence graph, BM25 with one-hop expansion, hashed text vectors, permissions, memory."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import tokenize
from tracewell.session import written

#: The usual Okapi parameters.
K1, B, EPSILON = 1.5, 0.75, 0.25
SPARSE_WEIGHT, GRAPH_WEIGHT = 0.8, 0.2
VECTOR_SIZE = 384


def allowed(df: DataFrame, tags: str, caller: list[str]) -> DataFrame:
    """Documents all of whose permission tags the caller has."""
    return df.where(F.size(F.array_except(F.coalesce(F.col(tags), F.array().cast("array<string>")), F.array(*[F.lit(t) for t in caller]).cast("array<string>"))) == 0)


def bm25(df: DataFrame, key: str, text: str, query: list[str]) -> DataFrame:
    """key and score (raw Okapi BM25, 0 and below dropped, divided by the largest) of documents for query tokens.

    Two passes over the texts, each without a shuffle of them: document frequencies of all terms (the floor of negative
    inverse frequencies is a mean over the vocabulary) and lengths, pre-aggregated on the map side; then each document's
    length and counts of the query's terms, written, from which the scores are. What the driver gets is one row each time.
    """
    tokens = tokenize(F.coalesce(df[text], F.lit("")))
    terms = list(dict.fromkeys(query))
    # each document's terms once, and the empty term once for its length
    each = df.select(tokens.alias("_tokens")).select(F.explode(F.array_append(F.array_distinct("_tokens"), F.lit(""))).alias("t"), F.size("_tokens").alias("len"))
    vocabulary = written(each.groupBy("t").agg(F.count(F.lit(1)).alias("df"), F.sum("len").alias("len")), "vocabulary")
    total = vocabulary.where("t = ''").first()
    n = total["df"] if total else 0
    idf = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    sums = vocabulary.where("t <> ''").agg((EPSILON * F.avg(idf)).alias("floor"), *[F.max(F.when(F.col("t") == q, idf)).alias(f"i{i}") for i, q in enumerate(terms)]).first()

    # an array of one element binds the tokens to a name: they are found once, however often the counts look at them
    holds = [lambda t, q=q: F.size(F.filter(t, lambda v: v == q)) for q in terms]
    counts = F.transform(F.array(tokens), lambda t: F.struct(F.size(t).alias("n"), F.array(*[f(t) for f in holds]).alias("tf")))
    found = written(df.select(df[key].alias(key), F.get(counts, F.lit(0)).alias("_c")), "term-counts")
    average = max((total["len"] if total else 0) / max(n, 1), 1e-9)
    score = F.lit(0.0)
    for i, q in enumerate(terms):
        weight = sums[f"i{i}"]
        if weight is not None:
            tf = F.get("_c.tf", F.lit(i))
            weight = query.count(q) * (sums["floor"] if weight < 0 else weight)
            score = score + F.lit(weight) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_c.n") / average))
    scored = found.select(key, score.alias("_score")).where("_score > 0")
    top = scored.agg(F.max("_score")).first()[0]
    return scored.select(key, (F.col("_score") / F.lit(top if top is not None else 1.0)).alias("score"))


def repeated_margins(blocks: DataFrame, document: str, page: str, text: str, share: float = 0.8, margin: float = 0.15) -> DataFrame:
    """document, kind (header, footer), text_sha256 and pages of the texts that stand in the top or bottom margin of at
    least ``share`` of a document's pages, and of two. blocks: document, page, text, top and bottom (0 to 1). Documents of
    one page have none; blank texts count for nothing. Nothing is removed."""
    pages = blocks.groupBy(document).agg(F.count_distinct(page).alias("_all")).where("_all >= 2")
    places = F.array_compact(F.array(F.when(F.col("top") <= margin, "header"), F.when(F.col("bottom") >= 1 - margin, "footer")))
    held = blocks.where(F.trim(text) != "").select(document, page, F.sha2(text, 256).alias("text_sha256"), F.explode(places).alias("kind"))
    seen = held.groupBy(document, "kind", "text_sha256").agg(F.count_distinct(page).alias("pages"))
    return seen.join(pages, document).where(F.col("pages") >= F.greatest(F.lit(2), F.ceil(F.lit(share) * F.col("_all")))).select(document, "kind", "text_sha256", "pages")


def one_hop(edges: DataFrame, seeds: DataFrame, node: str = "node") -> DataFrame:
    """Seeds and their neighbours over undirected edges (source, target)."""
    both = edges.select("source", "target").unionAll(edges.select(F.col("target").alias("source"), F.col("source").alias("target")))
    near = both.join(seeds.select(F.col(node).alias("source")), "source", "left_semi").select(F.col("target").alias(node))
    return seeds.select(node).union(near).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """How many edges touch each node."""
    return edges.select(F.explode(F.array("source", "target")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def retrieve(documents: DataFrame, key: str, text: str, query: list[str], edges: DataFrame, k: int = 20) -> DataFrame:
    """The k best documents by .8 text and .2 graph: a document that matches, or is next to one that does, scores 1 on the graph."""
    sparse = bm25(documents, key, text, query)
    near = one_hop(edges, sparse.select(F.col(key).alias("node")))
    both = sparse.join(near.withColumnRenamed("node", key).withColumn("_g", F.lit(1.0)), key, "full_outer")
    total = SPARSE_WEIGHT * F.coalesce("score", F.lit(0.0)) + GRAPH_WEIGHT * F.coalesce("_g", F.lit(0.0))
    return both.select(key, total.alias("score")).where("score > 0").orderBy(F.desc("score"), key).limit(k)


#: Bytes of text whose words one task counts.
PART_BYTES = 4 << 20


def _parts(rows: DataFrame) -> int:
    """How many parts the texts make: as many as Spark would deal out by itself, or more."""
    size = rows.agg(F.sum(F.octet_length("_text").cast("long"))).first()[0] or 0
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))


def hashed_terms(df: DataFrame, key: str, text: str, size: int = VECTOR_SIZE) -> DataFrame:
    """key, dimension and value of L2-normalized hashed vectors: a word of two letters or more adds 1 or -1 to the
    dimension that its SHA-256 names."""
    words = F.regexp_extract_all(F.lower(F.coalesce("_text", F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    # dealt out by key once; all that follows groups by the key and something else, where the rows are. The parts grow in
    # number with the texts, not in size, so a task's memory does not grow
    rows = df.select(df[key].alias(key), df[text].alias("_text"))
    dealt = rows.repartition(_parts(rows), key)
    each = dealt.select(key, F.explode(words).alias("_w")).groupBy(key, "_w").agg(F.count(F.lit(1)).alias("_n"))
    digest = F.sha2("_w", 256)
    low = lambda a, n: F.conv(F.substring(digest, a, n), 16, 10).cast("decimal(20,0)")
    sign = F.when(F.conv(F.substring(digest, 17, 2), 16, 10).cast("int") % 2 == 1, -1).otherwise(1)
    summed = each.select(key, (low(1, 16) % size).cast("int").alias("dimension"), (sign * F.col("_n")).alias("_v")).groupBy(key, "dimension").agg(F.sum("_v").alias("_v")).where("_v <> 0")
    norm = F.sqrt(F.sum((F.col("_v") * F.col("_v")).cast("double")).over(Window.partitionBy(key)))
    return summed.select(key, "dimension", (F.col("_v") / norm).alias("value"))


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return dot / (norm(a) * norm(b))


def nearest(vectors: DataFrame, key: str, vector: str, query: list[float], k: int = 10) -> DataFrame:
    """The k vectors most like one query vector: a scan with a bounded heap for each task."""
    point = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(key, cosine(F.col(vector), point).alias("score")).orderBy(F.desc("score"), key).limit(k)


def _blocks(vectors: DataFrame, key: str, vector: str, name: str, rows: int) -> DataFrame:
    """The vectors dealt out by key into blocks of about ``rows``; rows without a vector are left out."""
    some = vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    parts = max(1, -(-some.count() // rows))
    return some.groupBy(F.pmod(F.xxhash64("id"), F.lit(parts)).alias(f"{name}_block")).agg(F.collect_list("id").alias(f"{name}_ids"), F.collect_list("v").alias(f"{name}_vectors"))


def nearest_each(vectors: DataFrame, key: str, vector: str, queries: DataFrame, k: int = 10, rows: int = 2048) -> DataFrame:
    """query_id, key and score of the k vectors most like each query vector; equal scores in the order of keys.

    Blocks of queries meet blocks of vectors; of each pair of blocks only k rows a query go on. A vector of length 0 or
    of another size is like nothing."""

    def run(batches):
        for batch in batches:
            for q_ids, q_vectors, ids, all_vectors in zip(batch.q_ids, batch.q_vectors, batch.r_ids, batch.r_vectors, strict=True):
                by_size = {}
                for i, v in zip(ids, all_vectors, strict=True):
                    by_size.setdefault(len(v), ([], []))
                    by_size[len(v)][0].append(i)
                    by_size[len(v)][1].append(v)
                sized = {}
                for n, (own, given) in by_size.items():
                    a = np.array(given, float).reshape(len(own), n)
                    sized[n] = np.array(own), a, np.sqrt((a * a).sum(axis=1))
                out = []
                for q, v in zip(q_ids, q_vectors, strict=True):
                    v = np.array(v, float)
                    length = np.sqrt((v * v).sum())
                    if len(v) not in sized or not length > 0:
                        continue
                    own, a, lengths = sized[len(v)]
                    fit = lengths > 0
                    score = (a[fit] * v).sum(axis=1) / (lengths[fit] * length)  # sums row by row: equal rows score alike
                    best = np.lexsort((own[fit], -score))[:k]
                    out.append(pd.DataFrame({"query_id": q, key: own[fit][best], "score": score[best]}))
                if out:
                    yield pd.concat(out)

    pairs = _blocks(queries, key, vector, "q", rows // 8).crossJoin(_blocks(vectors, key, vector, "r", rows)).select("q_ids", "q_vectors", "r_ids", "r_vectors")
    found = pairs.repartition(max(1, pairs.sparkSession.sparkContext.defaultParallelism)).mapInPandas(run, f"query_id long, `{key}` long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return found.withColumn("_n", rank).where(F.col("_n") <= k).drop("_n")


def evidence_text(df: DataFrame, fields: list[str]) -> Column:
    """The text that stands for a record in an index: name and value of each field that has one."""
    return F.concat_ws("; ", *[F.when(F.col(f).isNotNull(), F.concat(F.lit(f"{f}: "), F.col(f).cast("string"))) for f in fields])


def admit(records: DataFrame, passed: Column, gold: Column) -> DataFrame:
    """Memory entries: approved if the gate passed and a Gold value exists, else quarantined."""
    return records.withColumn("state", F.when(passed & gold, "approved").otherwise("quarantined"))


def revoke(memory: DataFrame, ids: DataFrame, key: str = "memory_id") -> DataFrame:
    """Adds a revoked successor version for each approved entry named; nothing is changed in place."""
    gone = memory.where("state = 'approved'").join(ids.select(key), key, "left_semi")
    return memory.unionByName(gone.withColumn("state", F.lit("revoked")).withColumn("version", F.col("version") + 1))
