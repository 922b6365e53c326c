"""Staged writes of a batch of documents: metadata must succeed, full text, vectors and graph are written as far as they can.

Each store is a table with a commit log of its own, and each write of a batch into a store is one commit. What a batch has behind it
is read from the stores, so a run that broke off anywhere is simply started again: nothing is written twice and nothing is lost.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import tables
from .commits import Log

#: Stores in the order of writing; without the first a document fails, without another it is partial.
STAGES = ("meta", "fulltext", "vectors", "graph")


def _written(log: Log, schema: StructType, batch: str) -> tuple[DataFrame, int]:
    """doc_ids that commits of a batch put into a store, and how many commits these are."""
    own = [f for f, b in log.live(log.entries()).get("rows", {}).items() if b.rpartition("#")[0] == batch]
    return log.read("rows", schema, own).select("doc_id").distinct(), len(own)


def staged_write(items: DataFrame, valid: dict[str, Column], done: DataFrame | None, path: str, batch: str = "batch") -> DataFrame:
    """Write items (doc_id, ...) into one store per stage below path; (doc_id, a flag per stage, issues, status).

    valid: whether a stage can take an item; one bad item fails the whole document for that stage. Documents that an earlier run of
    the same batch has put into a store are not written there again, so a retry goes on where a run broke off and may follow after
    items were mended. done: (doc_id, flags) of stages to take as written besides. Nothing is written for documents whose metadata
    fail. Batches are written by one run at a time; different batches may run side by side.
    """
    spark = items.sparkSession
    logs = {s: Log(spark, f"{path}/{s}") for s in STAGES}
    state = items.groupBy("doc_id").agg(*[F.bool_and(F.coalesce(valid.get(s, F.lit(True)), F.lit(False))).alias(f"_ok_{s}") for s in STAGES])
    if done is not None:
        state = state.join(done.select("doc_id", *[F.col(s).alias(f"_was_{s}") for s in STAGES]), "doc_id", "left")
    commits = {}
    for s in STAGES:
        held, commits[s] = _written(logs[s], items.schema, batch)
        there = F.coalesce(f"_was_{s}", F.lit(False)) if done is not None else F.lit(False)
        state = state.join(held.withColumn(f"_in_{s}", F.lit(True)), "doc_id", "left").withColumn(f"_in_{s}", F.coalesce(f"_in_{s}", F.lit(False)) | there)
    first = F.col("_in_meta") | F.col("_ok_meta")
    now = {s: F.col(f"_in_{s}") | (first & F.col(f"_ok_{s}")) for s in STAGES}
    state = tables.store(state.select("doc_id", *[now[s].alias(s) for s in STAGES], *[(now[s] & ~F.col(f"_in_{s}")).alias(f"_new_{s}") for s in STAGES]), "stages")
    counts = state.agg(*[F.count_if(f"_new_{s}").alias(s) for s in STAGES]).first()
    for s in STAGES:
        if counts[s]:
            fresh = state.where(f"_new_{s}").select("doc_id")
            folder = logs[s].write("rows", items.join(tables.small(fresh), "doc_id", "left_semi"))
            logs[s].publish(f"{batch}#{commits[s] + 1}", {"rows": [folder]})
    issues = F.filter(F.array(*[F.when(~F.col(s), F.lit(f"{s}_write_failed")) for s in STAGES]), lambda x: x.isNotNull())
    status = F.when(~F.col("meta"), "failed").when(F.size("issues") > 0, "partial").otherwise("done")
    return state.select("doc_id", *STAGES, issues.alias("issues")).withColumn("status", status)


def existing(spark, path: str, key: str = "chunk_id") -> DataFrame:
    """(key, stage) of all items in the stores below path."""
    logs = {s: Log(spark, f"{path}/{s}") for s in STAGES}
    live = {s: list(log.live(log.entries()).get("rows", ())) for s, log in logs.items()}
    one = next((f"{logs[s].path}/rows/{f[0]}" for s, f in live.items() if f), None)
    kind = spark.read.parquet(one).schema if one else f"{key} string"
    return reduce(DataFrame.unionByName, [logs[s].read("rows", kind, live[s]).select(key, F.lit(s).alias("stage")) for s in STAGES])
