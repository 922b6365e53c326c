"""Entity presence: which names of a dictionary a text holds, in one pass over the text, and which names occur together."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tables

#: Names of a dictionary part: what one task's automaton holds.
PART = 200_000


def present(docs: DataFrame, names: DataFrame, part: int = 0) -> DataFrame:
    """(doc_id, names): the distinct names that occur in each text, in order; texts without any have no row.

    docs: (doc_id, text), names: (name). A dictionary of more than PART names is cut into parts by a hash, and each part is an
    automaton (Aho-Corasick) that finds all its names in one pass over a text, however many they are. Null and empty names and null
    texts are ignored; rows that share a doc_id are one; an empty dictionary or table gives no rows.
    """
    held = tables.store(names.select("name").where("name <> ''").distinct(), "names")
    parts = max(1, -(-held.count() // (part or PART)))
    found = None
    for k in range(parts):
        own = [r[0] for r in held.where(F.pmod(F.xxhash64("name"), F.lit(parts)) == k).orderBy("name").collect()]  # about PART names
        if own:
            rows = _scan(docs, own)
            found = rows if found is None else found.unionByName(rows)
    if found is None:
        return docs.where("false").select(F.col("doc_id").cast("long").alias("doc_id"), F.array().cast("array<string>").alias("names"))
    return found.groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"))


def _scan(docs: DataFrame, names: list[str]) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(names)

    def run(batches):
        automaton = ahocorasick.Automaton()
        for n in sent.value:
            automaton.add_word(n, n)
        automaton.make_automaton()
        for b in batches:
            ids, found = [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                hits = {n for _, n in automaton.iter(text)} if text else None
                if hits:
                    ids.append(doc_id)
                    found.append(list(hits))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.list_(pa.string()))], ["doc_id", "names"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, names array<string>")


def together(found: DataFrame, most: int = 50) -> DataFrame:
    """(a, b, n): in how many texts two names a < b occur together. found: rows of `present`.

    Pairs are made of the `most` names of a text that occur in the fewest texts (ties by name): a limit of the feature, as names that
    are everywhere say nothing about each other.
    """
    each = found.select("doc_id", F.explode("names").alias("name"))
    df = each.groupBy("name").agg(F.count("*").alias("df"))
    rare = Window.partitionBy("doc_id").orderBy("df", "name")
    kept = each.join(tables.small(df), "name").withColumn("_n", F.row_number().over(rare)).where(F.col("_n") <= most)
    lists = kept.groupBy("doc_id").agg(F.array_sort(F.collect_list("name")).alias("l"))
    pairs = F.flatten(F.transform("l", lambda a, i: F.transform(F.slice("l", i + 2, F.size("l")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return lists.select(F.explode(pairs).alias("p")).groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("n"))
