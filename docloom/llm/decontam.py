"""Benchmark decontamination by size-partitioned MinHash containment search.

Benchmark items are short and documents long, so their Jaccard similarity says nothing; containment does. Items are partitioned by
their number of shingles (powers of two), and each partition has parameters of its own. Its sketch size is what its longest item needs:
an item of n shingles is found in a document that holds at least c of them (c the least whole number of shingles at the threshold),
and such a document holds at least one of any n - c + 1 of its shingles. Each item keeps that many of its smallest hashes (those
that many items share come last). Its ceiling is the largest hash that any of its items keeps; long items keep their low hashes
only, so their ceiling is low. Its least size is the fewest shingles a document must have to hold one of its items. A document's
sketch holds its shingle hashes below the ceiling of some partition that its size admits, and meets the items of such partitions only;
an item and a document whose sketches meet are a candidate. No contained item can be missed. Candidates are verified by exact
shingle containment. With one partition for all sizes short items keep as many hashes as long ones need: more postings, a ceiling
near the whole range, more candidates (`partition_figures`). All of it is DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WIDTH = 5
THRESHOLD = 0.8
#: Bytes of item sketches, and of item shingles, up to which they are broadcast; beyond it they are shuffled.
BROADCAST_BYTES = 32 << 20
#: Items that share a shingle from which it is kept only if too few others are there.
SHARED = 8
#: Bytes that a hash of a sketch and a hash of an item take in a broadcast table, with what surrounds them.
SKETCH_HASH_BYTES, ITEM_HASH_BYTES = 96, 8


def shingles(text: str) -> Column:
    """Hashes of WIDTH-word shingles with repeats; a text of fewer words is one shingle, a text without words none."""
    return F.expr(
        f"transform(array(transform(filter(split(lower(coalesce({text}, '')), '[^\\\\p{{L}}\\\\p{{N}}]+'), w -> w != ''), w -> xxhash64(w))), h -> "
        f"case when size(h) = 0 then cast(array() as array<bigint>) "
        f"when size(h) < {WIDTH} then array(xxhash64(h)) "
        f"else transform(sequence(0, size(h) - {WIDTH}), i -> xxhash64({', '.join(f'h[i + {k}]' for k in range(WIDTH))})) end)[0]"
    )


def least_shared(n: int, threshold: float = THRESHOLD) -> int:
    """Shingles that a document must share with an item of n."""
    return math.ceil(threshold * n - 1e-9)


def sketch_size(n: int, threshold: float = THRESHOLD) -> int:
    """Hashes that an item of n shingles must keep for no document at the threshold to escape."""
    return n - least_shared(n, threshold) + 1


def item_sketches(items: DataFrame, threshold: float = THRESHOLD, partitioned: bool = True) -> DataFrame:
    """(no, item_id, n, size_class, hashes, sketch) per distinct item with a shingle: no is a hash of the item, hashes its distinct
    shingles, size_class its partition (the power of two that n has reached; 0 for all if not partitioned), sketch as many of its
    smallest hashes as the partition's longest item needs, those that many items share last."""
    rows = items.select("item_id", F.array_sort(F.array_distinct(shingles("text"))).alias("hashes")).where("size(hashes) > 0")
    rows = rows.select(F.xxhash64(F.to_json(F.struct("item_id")), "hashes").alias("no"), "item_id", "hashes").dropDuplicates(["no"])
    each = rows.select("no", F.explode("hashes").alias("h"))
    shared = each.groupBy("h").agg((F.count("*") > SHARED).alias("in_many"))
    order = each.join(shared, "h").groupBy("no").agg(F.sort_array(F.collect_list(F.struct("in_many", "h"))).alias("order"))
    size_class = F.floor(F.log2("n")).cast("int") if partitioned else F.lit(0)
    rows = rows.join(order, "no").withColumn("n", F.size("hashes")).withColumn("size_class", size_class)
    longest = rows.groupBy("size_class").agg(F.max("n").alias("_m")).withColumn("_keep", F.expr(f"_m - cast(ceil({threshold} * _m - 1e-9) as int) + 1"))
    rows = rows.join(F.broadcast(longest), "size_class")  # a row per partition
    return rows.select("no", "item_id", "n", "size_class", "hashes", F.expr("slice(order.h, 1, _keep)").alias("sketch"))


def partitions(sketches: DataFrame, threshold: float = THRESHOLD) -> list[tuple[int, int, int]]:
    """(size_class, least document size, ceiling) of each size partition."""
    rows = sketches.groupBy("size_class").agg(F.min("n"), F.max(F.array_max("sketch"))).collect()  # 32 rows at most
    return [(k, least_shared(n, threshold), top) for k, n, top in sorted(tuple(r) for r in rows)]


def document_sketches(docs: DataFrame, parts: list[tuple[int, int, int]], key: tuple[str, ...]) -> DataFrame:
    """The key, _s (distinct shingles) and _h (the sketch, null for documents too short for every item): the hashes below the highest
    ceiling of the partitions that the document's size admits."""
    rows = docs.select(*key, F.array_distinct(shingles("text")).alias("_s"))
    steps = [(least, max(top for _, other, top in parts if other <= least)) for _, least, _ in sorted(parts, key=lambda p: -p[1])]
    ceiling = "case " + " ".join(f"when size(_s) >= {least} then {_long(top)}" for least, top in steps) + " end"
    return rows.withColumn("_h", F.expr(f"transform(array({ceiling}), t -> filter(_s, h -> h <= t))[0]"))


def _long(n: int) -> str:
    return f"{n}L" if n > -(1 << 63) else f"({n + 1}L - 1L)"


def partition_figures(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, partitioned: bool = True) -> dict:
    """What the partitions do: hashes that items keep, ceilings as shares of the hash range by partition, the share of the documents'
    shingles that is in sketches, and the candidates that meet."""
    sketches = common.store(item_sketches(items, threshold, partitioned), "item-sketches")
    parts = partitions(sketches, threshold)
    rows = common.store(document_sketches(docs.withColumn("_k", F.monotonically_increasing_id()), parts, ("_k",)), "doc-sketches")
    held, kept = rows.agg(F.sum(F.size("_s")), F.sum(F.when(F.col("_h").isNotNull(), F.size("_h")))).first()
    postings = sketches.select(F.explode("sketch").alias("_x"), "no", "n")
    met = rows.select("_k", F.size("_s").alias("_m"), F.explode("_h").alias("_x")).join(postings, "_x")
    met = met.where(F.col("_m") >= F.ceil(F.col("n") * threshold - 1e-9)).select("_k", "no").distinct()
    return {"postings": postings.count(), "ceilings": {k: round((top + (1 << 63)) / (1 << 64), 3) for k, _, top in parts},
            "sketched": round((kept or 0) / max(1, held or 0), 3), "candidates": met.count()}


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(doc_id, item_id, shared, size, containment): items of which a document holds at least `threshold` of the distinct shingles.

    docs: (doc_id, text), items: (item_id, text). Null and empty texts have no shingles and match nothing; an item of fewer than
    WIDTH words matches only a document of just these words. Rows that share a doc_id are looked at each for itself and reported
    once, with the largest containment; null ids are reported as null. Repeated item rows count once. Other columns are ignored;
    `key` names other columns to report instead of doc_id. Documents are read once where the items' sketches and shingles are
    small enough to broadcast (BROADCAST_BYTES, counted first), and shuffled by hash where they are not.
    """
    sketches = common.store(item_sketches(items, threshold), "item-sketches")
    parts = partitions(sketches, threshold)
    kept, held = sketches.agg(F.sum(F.size("sketch")), F.sum("n")).first()
    postings = sketches.select(F.explode("sketch").alias("_x"), F.struct("no", "n").alias("i")).groupBy("_x").agg(F.collect_list("i").alias("_items"))
    small = (kept or 0) * SKETCH_HASH_BYTES + (held or 0) * ITEM_HASH_BYTES <= BROADCAST_BYTES
    hint = F.broadcast if small else (lambda df: df)
    rows = document_sketches(docs, parts, key) if parts else docs.where("false").select(*key, F.array().cast("array<long>").alias("_s"),
            F.array().cast("array<long>").alias("_h"))
    whole = sketches.select(F.col("no").alias("_no"), "item_id", F.col("n").alias("_n"), "hashes")
    enough = "size(_s) >= ceil({t} * i.n - 1e-9)".format(t=threshold)
    if small:
        # the outer form: a filter on what is exploded would compute the shingles twice; null meets nothing
        hits = rows.select(*key, "_s", F.explode_outer("_h").alias("_x")).join(hint(postings), "_x")
        hits = hits.select(*key, "_s", F.explode(F.expr(f"filter(_items, i -> {enough})")).alias("_i")).select(*key, "_s", F.col("_i.no").alias("_no"))
    else:  # hashes alone meet the sketches; shingles join the candidates by a hash of the document
        rows = rows.withColumn("_r", F.xxhash64("_s"))
        met = rows.select("_r", F.size("_s").alias("_m"), F.explode_outer("_h").alias("_x")).join(postings, "_x")
        met = met.select("_r", F.explode(F.expr(f"filter(_items, i -> {enough.replace('size(_s)', '_m')})")).alias("_i")).select("_r",
                F.col("_i.no").alias("_no")).distinct()
        hits = rows.drop("_h").join(met, "_r").select(*key, "_s", "_no")
    found = hits.join(hint(whole), "_no").select(*key, "item_id", F.size(F.array_intersect("_s", "hashes")).alias("shared"), F.col("_n").alias("size"))
    found = found.where(F.col("shared") >= F.ceil(F.col("size") * threshold - 1e-9))
    best = found.groupBy(*key, "item_id").agg(F.max(F.struct(F.col("shared") / F.col("size"), "shared", "size")).alias("b"))
    return best.select(*key, "item_id", F.col("b.shared").alias("shared"), F.col("b.size").alias("size"),
            (F.col("b.shared") / F.col("b.size")).alias("containment"))


#: DuckDB text of op3's result: shingles as text, counted.
SQL = """with w as (select 0 as kind, rowid as r, doc_id as id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as w
      from (select row_number() over () as rowid, doc_id, text from documents)
    union all select 1, rowid, item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')
      from (select row_number() over () as rowid, item_id, text from benchmark)),
  s as (select kind, r, id, unnest(list_distinct(case when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end)) as s
      from w where len(w) > 0),
  n as (select r, count(*) as n from s where kind = 1 group by r),
  f as (select d.r, d.id as doc_id, i.id as item_id, i.r as item, count(*) as shared from s d join s i on d.s = i.s and d.kind = 0 and i.kind = 1 group by all),
  best as (select doc_id, item_id, max(struct_pack(c := shared / n, shared := shared, size := n)) as b from f join n on n.r = f.item where shared >= 0.8 * n - 1e-9 group by all)
  select doc_id, item_id, cast(b.shared as int) as shared, cast(b.size as int) as size, b.shared / b.size as containment from best"""
