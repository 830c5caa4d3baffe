"""The corpus pipeline: language ID, near-duplicate removal, benchmark decontamination, secret masking, BPE encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. All but the last return the
columns of ``documents``; the last returns each document's ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import bpe, decontaminate, langid, minhash, secrets
from tracewell.llm.queries import read, vocabulary
from tracewell.llm.storage import discard, small_batches, written

#: Ids or hashes of documents up to which they are broadcast (100 bytes each at most); beyond, the join is shuffled.
BROADCAST_IDS = 1_000_000

#: A support vector machine, a MinHash sketch and a forest are not SQL; tests compare with brute force.
ORACLE_SQL = None


def _keyed(df: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    """The rows whose ``key`` is (left_semi) or is not (left_anti) among ``keys``, a table of some of its values."""
    keys = written(keys, "keys")
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys, key, how)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language, those without text or letters; a missing label becomes the predicted one.

    Where no document has a label there is nothing to predict with: all with letters stay as they are."""
    small_batches(spark)
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))), "text", "lang", "doc_id")
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    predicted = _fresh("_pred", docs)
    told = langid.with_language(docs, "text", model, predicted).where(F.col(predicted) != langid.UNKNOWN)
    return told.withColumn("lang", F.coalesce("lang", predicted)).select(docs.columns)


def _fresh(name: str, df: DataFrame) -> str:
    """A name that no column of ``df`` has."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that with the smallest id.

    Where ids repeat or are null, rows are documents: each has a number of its own, null ids come last, and of equal ids
    any one row stays."""
    small_batches(spark)
    ids = docs.groupBy("doc_id").count()
    if ids.where("doc_id is null or count > 1").isEmpty():
        found = minhash.near_duplicates(docs, "doc_id", "text")
        return _keyed(docs, found.where("not kept").select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    row = _fresh("_row", docs)
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = minhash.near_duplicates(numbered.select(F.col(row).alias("_row"), "text"), "_row", "text").select(F.col("_row").alias(row), "component_id")
    groups = found.join(numbered.select(row, "doc_id"), row).groupBy("component_id")
    first = groups.agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row))[row].alias(row)).select(row)
    return _keyed(numbered, first, row, "left_semi").select(docs.columns)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that benchmark passages fill to a twentieth or more.

    The verdict depends on the text alone and is brought back by the text's hash, whatever ids rows have; a null text is
    clean."""
    small_batches(spark)
    sha = _fresh("_sha", docs)
    keyed = docs.withColumn(sha, F.sha2("text", 256))
    found = decontaminate.find_contamination(keyed, sha, "text", read(spark, sf_dir, "benchmark"), "item_id", "text")
    return _keyed(keyed, found.where(decontaminate.contaminated()).select(sha).distinct(), sha, "left_anti").select(docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document; confirmed secrets in its text are masked, and n_chars follows."""
    small_batches(spark)
    masked = secrets.redact(docs, "doc_id", "text")
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, checked to decode to its text."""
    small_batches(spark)
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), "text", vocabulary("byte_bpe_50k.json"), "token_ids", check=True)
    return coded.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [
    ("language_id", language),
    ("near_dedup", deduplicate),
    ("decontaminate", clean_of_benchmark),
    ("secret_scan", mask_secrets),
    ("bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what one keeps is written and read again by the next."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
