"""What several corpus operators share: samples, keys of texts, stored tables, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.tables import delete, drop, new_path, shared_dir, store  # noqa: F401


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of at most so many rows, so that a Python task holds a bounded part of its partition."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def give_back() -> None:
    """Return freed memory to the system: workers are kept between stages, and each would hold the most it ever needed."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # not every libc can
        ctypes.CDLL(None).malloc_trim(0)


def sample(df: DataFrame, columns: list[str], most: int) -> DataFrame:
    """At most so many rows of df, picked by a hash of the columns: the same rows whatever the partitions.

    A hash remainder leaves a few times as many first, so that no task and no sort holds more than its part of these.
    """
    parts = max(1, df.count() // (4 * most))
    return df.where(F.pmod(F.xxhash64(*columns), F.lit(parts)) == 0).orderBy(F.hash(*columns), *columns).limit(most)


#: Rows of a few numbers each up to which a counted table is broadcast.
BROADCAST_ROWS = 500_000


def small(table: DataFrame) -> DataFrame:
    """The table, to be broadcast if a count of it (give a stored one) is at most BROADCAST_ROWS."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def text_key() -> tuple[Column, Column]:
    """Two hashes of the column text, together its key; null counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def keyed(docs: DataFrame) -> DataFrame:
    """docs with the text's key in _k0 and _k1."""
    k0, k1 = text_key()
    return docs.withColumn("_k0", k0).withColumn("_k1", k1)


def without(docs: DataFrame, gone: DataFrame, ids: tuple[str, ...] = ()) -> DataFrame:
    """docs without the rows whose text's key (k0, k1), and what else `ids` names, a stored table lists; texts stay in place if the
    table is small."""
    gone = small(gone.select(*(F.col(c).alias(f"_g_{c}") for c in ("k0", "k1", *ids))))
    same = (F.col("_k0") == F.col("_g_k0")) & (F.col("_k1") == F.col("_g_k1"))
    for c in ids:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return keyed(docs).join(gone, same, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root the smallest node reachable.

    Alternating large-star and small-star rounds; each is two aggregations with map-side minima and joins that Spark
    can split where a node has very many links. Each round is stored, so lineage stays short. A node without links has no row;
    null ends and loops are dropped.
    """
    links = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    links = store(links, "links")
    mark = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while mark[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        found = store(small.unionByName(floor.select("u", F.col("m").alias("v"))).distinct(), "links")
        drop(links)
        links, before = found, mark
        mark = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == tuple(before):
            break
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
