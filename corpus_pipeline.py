"""Training-corpus pipeline: five stages over the documents table, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and decides about the rows its predecessor kept. The first four keep the columns of
documents; the last returns the encoded corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, common, decontam, queries, secrets, simhash, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.7 or more go. The model learns from the labelled documents of the tables, as op1 does."""
    common.bounded_batches(spark)
    return toxicity.keep_clean(docs, queries.toxicity_model(spark, sf_dir))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard similarity of 0.8 or more, verified) one row stays.

    That is the row with the smallest doc_id; null doc_ids come last. Each row is judged by its own text, not by its doc_id.
    """
    return simhash.one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold four fifths or more of a benchmark item's shingles go, each row by its own text whatever its doc_id."""
    found = decontam.contaminated(common.keyed(docs), common.read(spark, sf_dir, "benchmark"), key=("_k0", "_k1"))
    leaks = common.store(found.select(F.col("_k0").alias("k0"), F.col("_k1").alias("k1")).distinct(), "leaks")
    return common.without(docs, leaks)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by [SECRET] and n_chars counted anew; every document stays."""
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, ids, n_tokens and the SHA-256 of the decoded text of each document."""
    return bpe.encode(docs, queries.TOKENIZER, keep=("source", "lang"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("secret scans", mask_secrets),
    ("bpe encoding", encode),
]

#: SQL can express neither the random field nor vantage-point trees nor merges; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.store(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
