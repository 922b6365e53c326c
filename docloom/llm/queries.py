"""The queries over this subpackage's operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, chat, decontam, fingerprints, htmltext, langid, negatives, secrets, shards, simhash, toxicity, warc
from .common import read

#: Vocabulary of op10 and of the pipeline's last stage.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def remainder(n: int):
    """crc32 of doc_id as text, modulo n; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Trained on labelled documents whose remainder by 3 is not 1."""
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic").where(remainder(3) != 1)
    return toxicity.fit(read(spark, sf_dir, "documents"), labels)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(read(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    held_out = F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out")
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("spans")
    return scored.select("doc_id", held_out, "score", "predicted", spans)


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(F.coalesce(remainder(4) != 2, F.lit(False))))
    held_out = F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out")
    return langid.predict(docs, model).select("doc_id", held_out, "lang_pred", "score")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(read(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_edits(read(spark, sf_dir, "documents"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(read(spark, sf_dir, "pages"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(read(spark, sf_dir, "documents"), 40)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read(spark, sf_dir, "documents"), TOKENIZER, digests=True)


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.examples(chat.with_probe(read(spark, sf_dir, "conversations"))))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = negatives.quantised(read(spark, sf_dir, "embeddings"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


_ALL = (
    op1_toxicity, op2_langid, op3_decontamination, op4_warc, op5_secrets, op6_fingerprints, op7_html, op8_sharding, op9_simhash, op10_bpe,
    op11_chat, op12_negatives, op13_audit,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE: dict[str, str] = {
    "op3_decontamination": decontam.SQL, "op11_chat": chat.SQL, "op12_negatives": negatives.SQL, "op13_audit": audit.SQL,
}
