"""Upserts, deletes and checks between stores as rewrites of whole tables: joins and windows, no table format needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key by an order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def upsert(target: DataFrame, source: DataFrame, keys: list[str], update: list[str], sticky: tuple[str, str] | None = None,
        skip_null: bool = False) -> DataFrame:
    """target with source's rows inserted or, on equal keys, the columns in `update` replaced.

    sticky = (column, value): a target row that has the value keeps it. skip_null: null new values leave the old ones. One full
    outer join on the keys; source must hold a key once.
    """
    t, s = target.alias("t"), source.alias("s")
    on = [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys]
    here, there = F.col(f"t.{keys[0]}").isNotNull(), F.col(f"s.{keys[0]}").isNotNull()
    out = []
    for c in target.columns:
        old, new = F.col(f"t.{c}"), F.col(f"s.{c}") if c in source.columns else F.lit(None)
        if c in keys:
            v = F.coalesce(old, new)
        elif c in update:
            v = F.when(there & F.lit(True), F.coalesce(new, old) if skip_null else new).otherwise(old)
            if sticky and c == sticky[0]:
                v = F.when(here & (old == sticky[1]), old).otherwise(v)
        else:
            v = F.when(here, old).otherwise(new)
        out.append(v.cast(target.schema[c].dataType).alias(c))
    return t.join(s, on, "full").select(*out)


def replace_by(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """target with all rows of source's keys replaced by source's rows."""
    return target.join(source.select(key).distinct(), key, "left_anti").select(target.columns).unionByName(source.select(target.columns))


def delete_by(target: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return target.join(keys.select(key).distinct(), key, "left_anti").select(target.columns)


def missing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of left whose key right lacks."""
    return left.join(right.select(key).distinct(), key, "left_anti")


def consistency(docs: DataFrame, all_chunks: DataFrame, indexed: DataFrame, embedded: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Per document chunks, chunks without full text and children without vector; inconsistent beyond the tolerance.

    all_chunks: (doc_id, chunk_id, is_parent); indexed, embedded: (chunk_id).
    """
    i = indexed.select("chunk_id").distinct().withColumn("in_index", F.lit(1))
    v = embedded.select("chunk_id").distinct().withColumn("in_vectors", F.lit(1))
    joined = docs.select("doc_id").join(all_chunks, "doc_id").join(i, "chunk_id", "left").join(v, "chunk_id", "left")
    out = joined.groupBy("doc_id").agg(
        F.count("*").alias("n_chunks"),
        F.count_if(F.col("in_index").isNull()).alias("missing_text"),
        F.count_if(F.col("in_vectors").isNull() & ~F.col("is_parent")).alias("missing_vectors"),
        F.count_if(~F.col("is_parent")).alias("n_children"),
    )
    bad = (F.col("missing_text") > 0) | (F.col("missing_vectors") > tolerance * F.col("n_children"))
    return out.withColumn("inconsistent", bad)
