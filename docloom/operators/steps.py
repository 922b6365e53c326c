"""The registered steps of workflows over documents (doc_id, text, file_type, head): paragraphs as elements, distinct ones as chunks."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import vectors as V
from docloom.sources import parsers as P

from .workflow import step

#: The workflows that come with the library.
FILE = os.path.join(os.path.dirname(__file__), "workflows.json")
#: Characters from which a chunk gets a vector, and a summary; components of a vector, characters of a title and a summary.
LEAST, LONG, DIM, TITLE, SUMMARY = 20, 600, 8, 64, 100


@step("detect_format")
def detect_format(df: DataFrame) -> DataFrame:
    """format_ok: do the first bytes fit the extension?"""
    return df.withColumn("format_ok", P.format_ok("file_type", "head"))


@step("parse")
def parse(df: DataFrame) -> DataFrame:
    """A row per paragraph: element, elem_idx."""
    return df.join(P.paragraphs(df.select("doc_id", "text")).withColumnRenamed("text", "element"), "doc_id")


@step("outline")
def outline(df: DataFrame) -> DataFrame:
    """title: the beginning of the first element."""
    return df.withColumn("title", F.when(F.col("elem_idx") == 0, F.substring("element", 1, TITLE)))


@step("chunk")
def chunk(df: DataFrame) -> DataFrame:
    """Of elements that begin alike in one document the first."""
    alike = F.substring(F.lower(F.replace("element", F.lit(" "), F.lit(""))), 1, 200)
    return df.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", alike).orderBy("elem_idx"))).where("_n = 1").drop("_n")


@step("enrich")
def enrich(df: DataFrame) -> DataFrame:
    """summary of long chunks."""
    return df.withColumn("summary", F.when(F.char_length("element") >= LONG, F.substring("element", 1, SUMMARY)))


@step("embed")
def embed(df: DataFrame) -> DataFrame:
    """vector of all but the shortest chunks."""
    return df.withColumn("vector", F.when(F.char_length("element") >= LEAST, V.char_bucket_embedding("element", DIM)))


@step("write")
def write(df: DataFrame) -> DataFrame:
    """What the stores take: chunks with text (`staging.staged_write` puts them there)."""
    return df.where(F.col("element").isNotNull())


@step("verify")
def verify(df: DataFrame) -> DataFrame:
    """flaw: a chunk that should have a vector and has none, or one that is not of unit length."""
    if "vector" not in df.columns:
        return df
    length = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    return df.withColumn("flaw", (F.char_length("element") >= LEAST) & F.coalesce(F.abs(length - 1) > 1e-6, F.lit(True)))


@step("finalize")
def finalize(df: DataFrame) -> DataFrame:
    """A row per document: format_ok, n_chunks, n_vectors, n_flaws, title."""
    vectors = F.count("vector") if "vector" in df.columns else F.lit(0).cast("long")
    flaws = F.count_if("flaw") if "flaw" in df.columns else F.lit(0).cast("long")
    return df.groupBy("doc_id", "format_ok").agg(F.count("*").alias("n_chunks"), vectors.alias("n_vectors"), flaws.alias("n_flaws"), F.max("title").alias("title"))
