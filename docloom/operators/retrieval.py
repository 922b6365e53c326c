"""Retrieval over batches of questions: BM25, exact keywords, vectors, graph paths, fusion, deduplication, reranking, packing."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions import vectors as V

from . import entities, tables

#: BM25 constants of the usual full-text engines; rank constant of reciprocal-rank fusion.
K1, B, RRF_K = 1.2, 0.75, 60
#: Exact search: query vectors of a block, items of a slice at most, queries multiplied at once, pairs computed again at once.
QUERY_BLOCK, SLICE, ROWS, PAIRS = 16_384, 50_000, 64, 50_000
#: Documents per result asked for whose rarest terms give a floor under the scores.
LEAD = 4


def top_k(rows: DataFrame, by: list[str], k: int, *order: Column, rank: str = "rank") -> DataFrame:
    """First k rows per group with their rank; Spark cuts groups before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def terms(c) -> Column:
    """Words of letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(T._col(c)), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def best_by_terms(hits: DataFrame, asked: DataFrame, k: int, doc: str = "doc_id") -> DataFrame:
    """(qid, doc, score, rank): top k by the sum of weight x impact over the terms that a question and a document share.

    hits: (doc, field, term, impact from 0 to 1), stored; asked: (qid, field, term, weight >= 0, df), df the term's documents. Frequent
    terms of little weight never join all their documents: a question's rarest terms give a floor under its k-th score, terms
    that cannot reach the floor together only add to documents that the others bring near it. The result is exact.
    """
    by = ["field", "term"]
    asked = tables.store(asked, "asked")
    rarest = Window.partitionBy("qid").orderBy("df", *by).rowsBetween(Window.unboundedPreceding, -1)
    lead = asked.where("df > 0").withColumn("_before", F.coalesce(F.sum("df").over(rarest), F.lit(0))).where(F.col("_before") < LEAD * k)
    part = hits.join(tables.small(lead), by).groupBy("qid", doc).agg(F.sum(F.col("weight") * F.col("impact")).alias("s"))
    floor = top_k(part, ["qid"], k, F.col("s").desc(), F.col(doc)).where(F.col("rank") == k).select("qid", F.col("s").alias("_floor"))
    least = Window.partitionBy("qid").orderBy("weight", *by).rowsBetween(Window.unboundedPreceding, 0)
    terms_ = asked.join(tables.small(floor), "qid", "left").withColumn("_reach", F.sum("weight").over(least))
    light = F.coalesce(F.col("_reach") < F.col("_floor") - 1e-6, F.lit(False))
    terms_ = tables.store(terms_.withColumn("_light", light).withColumn("_rest",
            F.max(F.when(light, F.col("_reach")).otherwise(0.0)).over(Window.partitionBy("qid"))), "terms")
    heavy = terms_.where("not _light").select("qid", *by, "weight", "_rest", "_floor")
    near = hits.join(tables.small(heavy), by).groupBy("qid", doc).agg(F.sum(F.col("weight") * F.col("impact")).alias("s"),
            F.first("_rest").alias("_rest"), F.first("_floor").alias("_floor"))
    near = tables.store(near.where("_floor is null or s + _rest >= _floor - 1e-6").select("qid", doc, "s"), "near")
    more = hits.join(tables.small(near.select("qid", doc)), doc).join(tables.small(terms_.where("_light").select("qid", *by, "weight")), ["qid", *by])
    both = near.unionByName(more.select("qid", doc, (F.col("weight") * F.col("impact")).alias("s")))
    out = both.groupBy("qid", doc).agg(F.sum("s").alias("score"))
    return top_k(out, ["qid"], k, F.round("score", 8).desc(), F.col(doc))


def bm25(docs: DataFrame, questions: DataFrame, k: int, doc: str = "doc_id", fields: dict[str, float] | None = None) -> DataFrame:
    """(qid, doc, score, rank): Lucene's BM25 with exact lengths over all of docs, summed over fields with their boosts.

    questions: (qid, term, boost) distinct terms; fields: text columns (by default `text` alone). Each field has its own lengths and
    frequencies. Only postings of asked terms are kept after the scan, so nothing of the rest is shuffled.
    """
    fields = fields or {"text": 1.0}
    each = docs.select(F.col(doc), F.posexplode(F.array(*[terms(name) for name in fields])).alias("field", "_t")).where("size(_t) > 0")
    # every text also has the empty term, which carries its length: one pass gives postings and statistics
    each = each.select(doc, "field", F.size("_t").alias("dl"), F.explode(F.array_append("_t", F.lit(""))).alias("term"))
    asked = questions.select("term").union(questions.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
    hits = each.join(tables.small(asked), "term", "left_semi").groupBy(doc, "field", "term", "dl").agg(F.count("*").alias("tf"))
    hits = tables.store(hits, "postings")
    told = {r[0]: (r[1], r[2]) for r in hits.where("term = ''").groupBy("field").agg(F.count("*"), F.avg("dl")).collect()}  # a row per field
    count = [told.get(n, (0, 1.0))[0] for n in range(len(fields))]
    mean = [told.get(n, (0, 1.0))[1] for n in range(len(fields))]
    hits = hits.where("term <> ''")
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("field") + 1)
    norm = F.col("tf") + K1 * (1 - B + B * F.col("dl") / pick(mean))
    df = hits.groupBy("field", "term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (pick(count) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = questions.join(df, "term").select("qid", "field", "term", (F.col("boost") * pick(fields.values()) * idf).alias("weight"), "df")
    return best_by_terms(hits.select(doc, "field", "term", (F.col("tf") / norm).alias("impact")), weighted, k, doc)


def with_synonyms(main: DataFrame, others: list[DataFrame], k: int, doc: str = "doc_id", lower: float = 0.85) -> DataFrame:
    """The hits of a search and those of its synonym searches, their scores lowered: the best score of each document counts."""
    rows = reduce(DataFrame.unionByName, [main.select("qid", doc, "score"), *(o.select("qid", doc, (F.col("score") * lower).alias("score")) for o in others)])
    best = rows.groupBy("qid", doc).agg(F.max("score").alias("score"))
    return top_k(best, ["qid"], k, F.round("score", 8).desc(), F.col(doc))


WORD, NAME = "[A-Za-z][A-Za-z0-9\\-_]+", "[A-Z][a-z]+"


def exact_terms(questions: DataFrame, text: str = "question", keywords: int = 10, entities: int = 5) -> DataFrame:
    """(qid, term): the first distinct words of a question and its first distinct capitalised words."""
    first = lambda p, n: F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(p), F.lit(0))), 1, n)
    return questions.select("qid", F.explode(F.array_union(first(WORD, keywords), first(NAME, entities))).alias("term"))


def keyword_search(docs: DataFrame, asked: DataFrame, k: int, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(qid, doc, score, rank): 1.5 for each asked term among a document's keywords, without regard to case, 2 if its text is the term.

    asked: (qid, term) as written.
    """
    lowered = asked.select("qid", F.lower("term").alias("term")).distinct()
    words = docs.select(doc, F.explode(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower))).alias("term"))
    words = words.join(tables.small(lowered.select("term").distinct()), "term", "left_semi").select(doc, F.lit(0).alias("field"), "term")
    equal = docs.select(doc, F.lit(1).alias("field"), F.col(text).alias("term")).join(tables.small(asked.select("term").distinct()), "term",
            "left_semi").select(doc, "field", "term")
    hits = tables.store(words.unionByName(equal).withColumn("impact", F.lit(1.0)), "keywords")
    df = hits.groupBy("field", "term").agg(F.count("*").alias("df"))
    terms_ = lowered.select("qid", F.lit(0).alias("field"), "term", F.lit(1.5).alias("weight"))
    terms_ = terms_.unionByName(asked.distinct().select("qid", F.lit(1).alias("field"), "term", F.lit(2.0).alias("weight")))
    return best_by_terms(hits, terms_.join(df, ["field", "term"]), k, doc)


def question_terms(questions: DataFrame, text: str = "question") -> DataFrame:
    return questions.select("qid", F.explode(F.array_distinct(terms(text))).alias("term")).withColumn("boost", F.lit(1.0))


def _rows(column, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of an Arrow list column, filled with zeros to one width, and their lengths; -1 for a null vector or one that holds nulls."""
    lists = column.combine_chunks()
    n = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
    flat, row = lists.flatten(), np.repeat(np.arange(len(n)), n)
    width = max(int(n.max(initial=0)), width or 0)
    out = np.zeros((len(n), width))
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = np.asarray(flat.cast("float64").fill_null(0.0))
    n[np.asarray(lists.is_null())] = -1
    n[row[np.asarray(flat.is_null())]] = -1
    return out, n


def _summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, added component by component as `vectors.dot` adds them: the same doubles."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def _tile(k: int, cosine: bool, by: str, item: str):
    """Of a tile of queries and items the first k pairs of each query, and those that may tie with its k-th after rounding."""

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        rows, cols, scores, none = [], [], [], []
        if a.num_rows and b.num_rows:
            x, nx = _rows(b["embedding"])
            q, nq = _rows(a["q"], x.shape[1])
            x = np.pad(x, ((0, 0), (0, q.shape[1] - x.shape[1])))
            ids = np.asarray(b[item].combine_chunks())
            lx, lq = np.sqrt(_summed(x, x)), np.sqrt(_summed(q, q))
            for at in range(0, len(q), ROWS):
                part, size = q[at : at + ROWS], lq[at : at + ROWS, None] * lx
                near, bad = part @ x.T, (nq[at : at + ROWS, None] < 0) | (nx < 0)
                void = bad | (nq[at : at + ROWS, None] != nx)  # no score: null
                if cosine:  # 0 where a norm is 0 or null
                    some = ~bad & ((size > 0) | np.isnan(size))
                    near, void = np.where(some, near / size, 0.0), void & some
                near[np.isnan(near)] = np.inf  # Spark sorts NaN above all numbers
                near[void] = -np.inf
                # products added in another order differ by less than this, rounding joins what differs by a millionth
                slack = 1.1e-6 + (0.0 if cosine else 1e-12 * size.max(1, initial=0))
                least = np.partition(near, -k, axis=1)[:, -k] if len(x) > k else np.full(len(part), -np.inf)
                i, j = np.nonzero(near >= np.where(np.isfinite(least) & np.isfinite(slack), least - slack, -np.inf)[:, None])
                s = np.concatenate([_summed(part[i[c : c + PAIRS]], x[j[c : c + PAIRS]]) for c in range(0, len(i), PAIRS)])
                if cosine:
                    s = np.where(some[i, j], s / size[i, j], 0.0)
                void = void[i, j]
                v = np.clip(s * 1e6 + 0.5, -1.7e308, 1.7e308)
                edge = 1e-6 + 1e-15 * np.abs(v)  # halves are rounded by Spark, so a value close to one counts both ways
                low, high = np.floor(v - edge), np.floor(v + edge)
                for ends in (low, high):
                    ends[np.isnan(s)], ends[void] = np.inf, -np.inf
                order = np.lexsort((ids[j], -low, i))
                start = np.searchsorted(i[order], np.arange(len(part) + 1))
                last = order[np.minimum(start[:-1] + k, start[1:]) - 1]  # the k-th pair of each query
                keep = (high > low[last][i]) | ((high == low[last][i]) & (ids[j] <= ids[j[last]][i]))
                rows.append(at + i[keep]), cols.append(j[keep]), scores.append(s[keep]), none.append(void[keep])
        one = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return pa.table({by: a[by].take(pa.array(one(rows, np.int64))), item: b[item].take(pa.array(one(cols, np.int64))),
                "score": pa.array(one(scores, float), pa.float64(), mask=one(none, bool))})

    return best


def vector_search(items: DataFrame, queries: DataFrame, k: int, similarity=V.dot, item: str = "vec_id", by: str = "qid", block: int = QUERY_BLOCK) -> DataFrame:
    """Exact top k by similarity (`vectors.dot` or `vectors.cosine`): queries (qid, q) in blocks that fit a broadcast meet slices of items
    (item, embedding).

    A task multiplies a block and a slice as matrices and computes what comes near a query's k-th score again in the order of the column
    expression. A query sends k pairs per slice; there are as many slices as keep the cores busy, more only where these would be longer
    than SLICE. Blocks go by a hash of qid, so that the vectors of one question stay together.
    """
    cosine = {V.dot: False, V.cosine: True}[similarity]
    blocks = max(1, -(-queries.count() // block))
    slices = max(2 * items.sparkSession.sparkContext.defaultParallelism, -(-items.count() // SLICE))
    deal = lambda n, *columns: F.pmod(F.xxhash64(*columns), F.lit(n))
    packed = items.select(item, "embedding", deal(slices, item, "embedding").alias("_s")).repartition(2 * slices, "_s")
    packed = packed.groupBy("_s").agg(F.collect_list(F.struct(item, "embedding")).alias("_items")).select("_items")
    types = {f.name: f.dataType.simpleString() for f in [*queries.select(by).schema.fields, *items.select(item).schema.fields]}
    best, out = _tile(k, cosine, by, item), None

    def run(batches):
        for b in batches:
            for x, q in zip(b.column("_items"), b.column("_asked")):
                with np.errstate(all="ignore"):  # vectors may hold infinities and NaN
                    found = best(pa.Table.from_struct_array(q.values), pa.Table.from_struct_array(x.values))
                yield from found.to_batches()

    for n in range(blocks):
        part = queries.where(deal(blocks, by) == n) if blocks > 1 else queries
        asked = part.agg(F.collect_list(F.struct(by, "q")).alias("_asked"))
        pairs = packed.join(F.broadcast(asked), F.lit(True)).mapInArrow(run, f"{by} {types[by]}, {item} {types[item]}, score double")
        top = top_k(pairs, [by], k, F.round("score", 6).desc(), F.col(item))
        out = top if out is None else out.unionByName(top)
    return out


def holders(docs: DataFrame, items: DataFrame, doc: str = "doc_id", width: int = 4) -> DataFrame:
    """(doc, qid): documents whose text holds an item's text word for word; docs: (doc, text), items: (qid, item).

    Inside its first and last word an item's words stand whole in every text that holds it, so a run of them finds candidates, which
    are then compared. Items without so long a run are few words; all of these are found in one pass over a text (`entities.present`).
    Empty items are in no text.
    """
    runs = F.expr(
        f"transform(array(transform(split({{}}, ' '), w -> xxhash64(w))), h -> if(size(h) < {width}, cast(array() as array<bigint>), "
        f"transform(sequence(0, size(h) - {width}), i -> xxhash64({', '.join(f'h[i + {k}]' for k in range(width))}))))[0]".format("_s")
    )
    inner = items.withColumn("_s", F.expr("array_join(slice(split(item, ' '), 2, greatest(size(split(item, ' ')) - 2, 0)), ' ')"))
    marked = inner.withColumn("_h", runs).select("qid", "item", F.when(F.size("_h") > 0, F.col("_h")[0]).alias("_h"))
    seen = docs.withColumn("_s", F.col("text")).select(doc, "text", F.explode(F.array_distinct(runs)).alias("_h"))
    found = seen.join(tables.small(marked.where("_h is not null")), "_h").where(F.contains("text", "item")).select(doc, "qid")
    short = tables.store(marked.where("_h is null and item <> ''").select("qid", "item"), "short-items")
    held = entities.present(docs.select(F.col(doc).alias("doc_id"), "text"), short.select(F.col("item").alias("name")))
    rest = held.select(F.col("doc_id").alias(doc), F.explode("names").alias("item")).join(tables.small(short), "item")
    return found.unionByName(rest.select(doc, "qid"))


def rrf(candidates: DataFrame, weights: dict[str, float] | None = None, key: str = "chunk_id") -> DataFrame:
    """(qid, key, score, routes): weighted reciprocal-rank fusion of (qid, route, key, rank [, quality, ephemeral])."""
    w = F.lit(1.0)
    for route, v in (weights or {}).items():
        w = F.when(F.col("route") == route, F.lit(v)).otherwise(w)
    boost = F.when(F.max("ephemeral"), 1.2).otherwise(1.0) if "ephemeral" in candidates.columns else F.lit(1.0)
    q = F.max("quality") if "quality" in candidates.columns else F.lit(1.0)
    quality = F.greatest(F.lit(0.2), F.least(F.lit(1.0), F.when(F.coalesce(q, F.lit(0.0)) == 0, 1.0).otherwise(q)))
    total = F.sum(w / (RRF_K + F.col("rank")))
    return candidates.groupBy("qid", key).agg((total * boost * quality).alias("score"), F.array_join(F.array_sort(F.collect_set("route")), ",").alias("routes"))


def text_dedup(rows: DataFrame, by: list[str], text: str, *order: Column) -> DataFrame:
    """Of rows with equal beginnings the first by an order."""
    w = Window.partitionBy(*by, T.fingerprint(text)).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def greedy_dedup(rows: DataFrame, by: str, key: str, vector: str, threshold: float = 0.92, first: int = 60) -> DataFrame:
    """(by, key): per group, in order of `rank`, rows whose cosine to each kept row is below the threshold; rows after the first 60 stay.

    Only the first rows of a group are brought together; the fold runs in the JVM over these.
    """
    n = F.row_number().over(Window.partitionBy(by).orderBy("rank", key))
    rows = tables.store(rows.select(by, key, "rank", F.col(vector).alias("v"), n.alias("_n")), "ranked")
    entry = F.struct(F.col("rank"), F.col(key).alias("key"), "v")
    lists = rows.where(F.col("_n") <= first).groupBy(by).agg(F.array_sort(F.collect_list(entry)).alias("all"))
    kept = F.aggregate(
        "all",
        F.expr("slice(all, 1, 0)"),
        lambda held, x: F.when(F.exists(held, lambda h: V.cosine(h["v"], x["v"]) >= threshold), held).otherwise(F.concat(held, F.array(x))),
    )
    head = lists.select(by, F.explode(kept).alias("x")).select(by, F.col("x.key").alias(key), F.col("x.rank").alias("rank"))
    return head.unionByName(rows.where(F.col("_n") > first).select(by, key, "rank"))


def rerank(rows: DataFrame, score: Column, k: int = 6, threshold: float = 0.3, least: int = 3, key: str = "doc_id") -> DataFrame:
    """Top k by a score per question; those under the threshold go if at least three stay above it."""
    s = rows.withColumn("rerank_score", score)
    per = Window.partitionBy("qid")
    s = s.withColumn("_good", F.count_if(F.col("rerank_score") >= threshold).over(per))
    s = s.where((F.col("_good") < least) | (F.col("rerank_score") >= threshold)).drop("_good")
    return top_k(s, ["qid"], k, F.col("rerank_score").desc(), F.col(key), rank="final_rank")


def overlap_score(question, text) -> Column:
    """Default of the reranker port: share of the question's distinct words that the text has."""
    q, t = F.array_distinct(terms(question)), terms(text)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, t)) / F.size(q)).otherwise(F.lit(0.0))


def pack_context(rows: DataFrame, by: str, block: str, order: str, budget: int = 4000, per_block: int = 1500) -> DataFrame:
    """(by, order, block): blocks in order, each cut to what is left of the token budget, until nothing is left."""
    lists = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(block).alias("b")))).alias("all"))
    count = lambda s: f"(char_length(regexp_replace({s}, '[^\\\\u4e00-\\\\u9fff]', '')) + cast(floor((char_length({s}) - char_length(regexp_replace({s}, '[^\\\\u4e00-\\\\u9fff]', ''))) / 3.5) as int) + 1)"
    left = f"least({per_block}, {budget} - s.used)"
    cut = f"if({count('x.b')} <= {left}, x.b, substring(x.b, 1, greatest(64, cast(floor(char_length(x.b) * ({left} / {count('x.b')})) as int))))"
    step = f"if({left} <= 0, s, transform(array({cut}), c -> named_struct('used', s.used + {count('c')}, 'out', concat(s.out, array(named_struct('o', x.o, 'b', c)))))[0])"
    fold = f"aggregate(all, named_struct('used', 0, 'out', slice(all, 1, 0)), (s, x) -> {step}, s -> s.out)"
    return lists.select(by, F.explode(F.expr(fold)).alias("x")).select(by, F.col("x.o").alias(order), F.col("x.b").alias(block))


def graph_paths(edges: DataFrame, starts: DataFrame, hops: int, limit: int | None = None) -> DataFrame:
    """(start, node, path, length): undirected paths of up to `hops` edges without a repeated edge; edges: (src, dst, rel).

    With a limit, the first paths of each start by length, then step by step by relation and node. A start that has its paths goes no
    further; until then all its paths are fewer than the limit, so they are all prefixes of the next step. Of a node's edges only the
    first ones, as many as the limit and a path's own edges, can be taken by any prefix: hubs are cut to these before they are joined.
    """
    e = edges.withColumn("edge", F.xxhash64("src", "dst", "rel"))
    both = e.select(F.col("src").alias("a"), F.col("dst").alias("b"), "rel",
            "edge").unionByName(e.select(F.col("dst").alias("a"), F.col("src").alias("b"), "rel", "edge"))
    if limit is not None:
        both = tables.store(top_k(both, ["a"], limit + hops, F.col("rel"), F.col("b"), F.col("edge")).drop("rank"), "edges")
    at = starts.select(F.col("start"), F.col("start").alias("node"), F.col("start").cast("string").alias("path"), F.array().cast("array<bigint>").alias("used"))
    at = at.withColumns({"_steps": F.array().cast("array<struct<rel:string,node:bigint>>"), "_found": F.lit(0)})
    out = None
    for n in range(1, hops + 1):
        step = at.join(both, at["node"] == both["a"]).where(~F.array_contains("used", F.col("edge")))
        to = F.struct(F.col("rel").cast("string").alias("rel"), F.col("b").cast("long").alias("node"))
        at = step.select("start", F.col("b").alias("node"), F.concat_ws("—", "path", F.concat_ws("→", "rel", F.col("b").cast("string"))).alias("path"),
                F.array_append("used", F.col("edge")).alias("used"), F.array_append("_steps", to).alias("_steps"), "_found")
        if limit is not None:
            at = top_k(at, ["start"], limit, F.col("_steps"), F.col("used")).where(F.col("rank") <= limit - F.col("_found")).drop("rank")
            at = tables.store(at, "paths")
        found = at.select("start", "node", "path", F.lit(n).alias("length"))
        out = found if out is None else out.unionByName(found)
        if limit is not None and n < hops:
            so_far = F.count("*").over(Window.partitionBy("start")).cast("int")  # at most `limit` rows
            at = at.withColumn("_found", F.col("_found") + so_far).where(F.col("_found") < limit)
    return out


def visible(docs: DataFrame, tenant: str, collections: tuple[str, ...] | None, roles: tuple[str, ...]) -> DataFrame:
    """Documents of a tenant, in any of the collections (None: all), that are public or share a role."""
    own = F.split("roles_csv", ",")
    shown = (F.col("roles_csv") == "") | F.arrays_overlap(own, F.array(*map(F.lit, roles)).cast("array<string>"))
    where = (F.col("tenant_id") == tenant) & shown
    return docs.where(where if collections is None else where & F.col("collection").isin(*collections))


def vector_filter(tenant: Column, roles: Column) -> Column:
    """A vector store's filter expression; roles keep letters, digits, `_` and `-` only."""
    clean = F.filter(F.transform(roles, lambda r: F.regexp_replace(r, "[^A-Za-z0-9_-]", "")), lambda r: r != "")
    listed = F.concat(F.lit('"'), F.array_join(clean, '", "'), F.lit('"'))
    any_role = F.when(F.size(clean) > 0, F.concat(F.lit(" and array_contains_any(allowed_roles, ["), listed, F.lit("])"))).otherwise("")
    return F.concat(F.lit('tenant_id == "'), tenant, F.lit('"'), any_role)


def exposition(rows: DataFrame, name: str, label: str, value: str, buckets: tuple) -> DataFrame:
    """Lines of a cumulative histogram per label value, as collectors of metrics read them."""
    g = rows.groupBy(label).agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(buckets)], F.count("*").alias("n"))
    mark = lambda b: F.concat(F.lit(f'{name}_bucket{{{label}="'), F.col(label), F.lit(f'",le="{b}"}} '))
    lines = [F.concat(mark(b), F.col(f"b{i}").cast("string")) for i, b in enumerate(buckets)]
    lines.append(F.concat(F.lit(f'{name}_count{{{label}="'), F.col(label), F.lit('"} '), F.col("n").cast("string")))
    return g.select(F.explode(F.array(*lines)).alias("line"))
