"""Filter interaction audit by Walsh-Hadamard transform.

Each document has a mask of the filters that it fails. Per part and label, 32 sums are taken in one pass: for each subset s of the
five filters the documents are added with the sign (-1)^|mask & s|. The transform is its own inverse up to a factor of 32, so the
sums give the number of documents of each mask exactly, and everything else follows from these 32 cells: what a filter removes at
any place of any order, what it fails without removing, what it alone fails, and its Shapley value. In a random order a document
that fails k filters is removed by each of them equally often, so each takes 120 / k of the 120 orders. Only DataFrame functions.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: The filters by letter; bit n of a mask is the n-th letter's.
FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
#: Labels under which sums are taken: all documents, those of good quality, the toxic ones.
LABELS = ("all", "good", "toxic")

_WORDS = r"[^\x20\x09-\x0D]+"


def own_failures(text: Column) -> Column:
    """Mask of the filters A to D that a text fails: they look at the text alone."""
    words = F.regexp_extract_all(text, F.lit(_WORDS), F.lit(0))
    n = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("all"), F.size(F.array_distinct(w)).alias("distinct")))[0]  # words are taken once
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    bits = F.transform(F.array(n), lambda n: F.when(n["all"] < 50, 1).otherwise(0) + F.when(100 * n["distinct"] < 65 * n["all"], 2).otherwise(0))[0]
    return bits + F.when(100 * capitals > 5 * F.char_length(text), 4).otherwise(0) + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n_all, n_good, n_toxic): documents by the filters they fail, in partial counts that still have to be added.

    Filter E looks at all texts: of equal texts those with the smallest doc_id pass. Equal texts agree on the other filters, so they
    are counted per text, part and label before anything meets by text: a group of copies is a few counts, however large it is.
    """
    text = F.coalesce("text", F.lit(""))
    k0, k1 = common.text_key()
    told = labels.groupBy("doc_id").agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
            F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), k0.alias("k0"), k1.alias("k1"),
            own_failures(text).alias("own"))
    rows = rows.groupBy("doc_id", "k0", "k1", "own", "part").agg(F.count("*").alias("n"))  # rows may repeat, and ids be null
    spread = F.coalesce("doc_id", F.xxhash64("k0", "part"))  # null ids meet no label, and not each other either
    told = told.where("doc_id is not null").select(F.col("doc_id").alias("_id"), "good", "toxic")
    each = rows.withColumn("_j", spread).join(told, (F.col("_j") == F.col("_id")) & F.col("doc_id").isNotNull(), "left")
    each = each.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    kind = ["k0", "k1", "own", "part", "good", "toxic"]
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    groups = each.groupBy(*kind).agg(F.sum("n").alias("n"), first.alias("first"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("unnamed"))
    least = F.min("first.doc_id").over(Window.partitionBy("k0", "k1"))
    passing = F.col("unnamed") + F.when(F.col("first.doc_id") == F.col("_least"), F.col("first.n")).otherwise(0)
    groups = groups.withColumn("_least", least).withColumn("_pass", passing)
    cells = F.array(F.struct(F.col("own").alias("mask"), F.col("_pass").alias("n")),
            F.struct((F.col("own") + 16).alias("mask"), (F.col("n") - F.col("_pass")).alias("n")))
    out = groups.select("part", "good", "toxic", F.explode(cells).alias("c")).where("c.n > 0")
    return out.select("part", F.col("c.mask").alias("mask"), F.col("c.n").alias("n_all"), F.when(F.col("good"), F.col("c.n")).otherwise(0).alias("n_good"),
            F.when(F.col("toxic"), F.col("c.n")).otherwise(0).alias("n_toxic"))


def parity_sums(counts: DataFrame) -> DataFrame:
    """(part, label, sums): per part and label the 32 sums of counts, signed by the parity of mask & s, s from 0 to 31."""
    long = counts.select("part", "mask", F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"n_{x}").alias("n")) for x in LABELS])).alias("l"))
    long = long.select("part", "mask", F.col("l.label").alias("label"), F.col("l.n").alias("n"))
    sign = lambda s: 1 - 2 * (F.bit_count(F.col("mask").bitwiseAND(F.lit(s))) % 2)
    sums = long.groupBy("part", "label").agg(*(F.sum(sign(s) * F.col("n")).alias(f"s{s}") for s in range(MASKS)))
    return sums.select("part", "label", F.array(*(f"s{s}" for s in range(MASKS))).alias("sums"))


def invert(sums: Column) -> Column:
    """The 32 counts by mask from the 32 signed sums: the same transform again, divided by 32 (exactly)."""
    sign = lambda s, m: 1 - 2 * (F.bit_count(s.bitwiseAND(m)) % 2)
    at = lambda m: F.aggregate(F.transform(sums, lambda x, s: x * sign(s, m)), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(F.sequence(F.lit(0), F.lit(MASKS - 1)), lambda m: (at(m) / MASKS).cast("long"))


def _total(cells: Column, which) -> Column:
    """Sum over the cells of which `which(mask)` is true, or counted that often if it is a number."""
    return F.aggregate(F.transform(cells, lambda n, m: n * which(m)), F.lit(0).cast("long"), lambda a, x: a + x)


def orders(cells: DataFrame) -> DataFrame:
    """cells (part, all, good, toxic: arrays of 32 counts by mask) -> a row per part, order and step."""
    each = cells.select("*", F.explode(F.array(*map(F.lit, map("".join, permutations(FILTERS))))).alias("filter_order"))
    each = each.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    before = F.substring("filter_order", F.lit(1), F.col("step") - 1)
    bit = F.pow(F.lit(2), F.instr(F.lit(FILTERS), letter) - 1).cast("int")
    gone = sum((F.when(F.contains(before, F.lit(c)), 1 << k).otherwise(0) for k, c in enumerate(FILTERS)), F.lit(0))
    each = each.withColumns({"bit": bit, "gone": gone.cast("int")})
    has = lambda m: m.bitwiseAND(F.col("bit")) != 0
    lost = lambda m: m.bitwiseAND(F.col("gone")) != 0
    one = lambda c: F.when(c, 1).otherwise(0)
    removed = lambda m: one(has(m) & ~lost(m))
    share = lambda m: F.when(has(m), (F.lit(factorial(len(FILTERS))) / F.bit_count(m)).cast("int")).otherwise(0)
    return each.select(
        "part", "filter_order", "step",
        _total(F.col("all"), lambda m: one(~has(m) & ~lost(m))).alias("kept"),
        _total(F.col("all"), removed).alias("removed"),
        _total(F.col("all"), lambda m: one(has(m) & lost(m))).alias("redundant"),
        _total(F.col("all"), lambda m: one(m == F.col("bit"))).alias("unique_fails"),
        _total(F.col("good"), removed).alias("good_lost"),
        _total(F.col("toxic"), removed).alias("toxic_lost"),
        _total(F.col("all"), share).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): one row per part, order of
    the five filters and step.

    docs: (doc_id, text, source), labels: (doc_id, quality, toxic). A null text is empty; a null source is the empty string. Rows with
    equal doc_id are documents each, and of equal texts all rows with the smallest doc_id pass filter E; a null doc_id is neither
    smaller nor larger than another, so its rows pass E and have no labels. Repeated labels count as 1 if one of them does. An
    empty table gives no rows; other columns are ignored. The texts' rows meet the labels by doc_id and each other by text as
    counts; the cells are 32 numbers per part and label.
    """
    sums = parity_sums(masks(docs, labels))
    cells = sums.groupBy("part").agg(*(F.max(F.when(F.col("label") == x, invert(F.col("sums")))).alias(x) for x in LABELS))
    return orders(cells)


#: DuckDB text of op13's result: every order walked over every mask.
SQL = r"""with t as (select doc_id, coalesce(source, '') as part, coalesce("text", '') as body from documents),
  w as (select *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') as words, min(doc_id) over (partition by body) as least from t),
  l as (select doc_id, coalesce(bool_or(quality = 1), false) as good, coalesce(bool_or(toxic = 1), false) as toxic from labels group by doc_id),
  m as (select part, (case when len(words) < 50 then 1 else 0 end) + (case when 100 * len(list_distinct(words)) < 65 * len(words) then 2 else 0 end)
      + (case when 100 * len(regexp_extract_all(body, '[A-Z]')) > 5 * length(body) then 4 else 0 end)
      + (case when regexp_matches(body, '[#$%&*|]') then 8 else 0 end) + (case when w.doc_id > least then 16 else 0 end) as mask,
      coalesce(good, false) as good, coalesce(toxic, false) as toxic from w left join l on l.doc_id = w.doc_id),
  n as (select part, mask, count(*) as n, count(*) filter (good) as g, count(*) filter (toxic) as x from m group by 1, 2),
  f as (select unnest(['A', 'B', 'C', 'D', 'E']) as f, unnest([1, 2, 4, 8, 16]) as b),
  o as (select a.f || b.f || c.f || d.f || e.f as filter_order, [a.b, b.b, c.b, d.b, e.b] as bits from f a, f b, f c, f d, f e
    where a.b + b.b + c.b + d.b + e.b = 31 and (a.b | b.b | c.b | d.b | e.b) = 31),
  s as (select filter_order, step, bits[step] as bit, coalesce(list_sum(bits[1:step - 1]), 0)::int as gone from o, (select unnest([1, 2, 3, 4, 5]) as step)),
  r as (select part, filter_order, step, bit, sum(case when mask & (gone | bit) = 0 then n else 0 end) as kept,
      sum(case when mask & bit <> 0 and mask & gone = 0 then n else 0 end) as removed, sum(case when mask & bit <> 0 and mask & gone <> 0 then n else 0 end) as redundant,
      sum(case when mask = bit then n else 0 end) as unique_fails, sum(case when mask & bit <> 0 and mask & gone = 0 then g else 0 end) as good_lost,
      sum(case when mask & bit <> 0 and mask & gone = 0 then x else 0 end) as toxic_lost from n, s group by 1, 2, 3, 4)
  select part, filter_order, cast(step as int) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
    cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
    cast(sum(removed) over (partition by part, bit) as bigint) as shapley from r"""
