"""Queries over retrieval: the routes, fusion, deduplication, reranking, evaluation, and the flagship answer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions import vectors as V
from docloom.operators import entities, tables
from docloom.operators import retrieval as R
from docloom.operators import textindex as X
from docloom.operators import vectorindex as VX

from .base import query

#: Fields of the keyword search with their boosts; the summary is that of `enrich_default`, the first 100 characters.
FIELDS = {"summary": 1.5, "text": 1.0}
_WORDS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"


def _bm25_sql(questions="(select qid, question, 1.0 as b from fx_questions)", docs="documents", name="bm", order="doc_id"):
    """Common table expressions that end in `name` (qid, doc_id, score, rank): BM25 summed over both fields."""
    n = name
    return f"""{n}tok as (select 0 as f, 1.5 as fb, doc_id, unnest({_WORDS.format('substr(text, 1, 100)')}) as term from {docs}
        union all select 1, 1.0, doc_id, unnest({_WORDS.format('text')}) from {docs}),
      {n}dl as (select f, doc_id, count(*) as dl from {n}tok group by 1, 2), {n}st as (select f, count(*) as n, avg(dl) as avgdl from {n}dl group by 1),
      {n}q as (select qid, term, max(b) as b from (select qid, b, unnest({_WORDS.format('question')}) as term from {questions}) group by 1, 2),
      {n}tf as (select f, fb, doc_id, term, count(*) as tf from {n}tok where term in (select term from {n}q) group by 1, 2, 3, 4),
      {n}df as (select f, term, count(*) as df from {n}tf group by 1, 2),
      {n}sc as (select qid, doc_id, sum(b * fb * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score
        from {n}q join {n}tf using (term) join {n}df using (f, term) join {n}dl using (f, doc_id) join {n}st using (f) group by 1, 2),
      {n} as (select qid, doc_id, score, row_number() over (partition by qid order by round(score, 8) desc, {order}) as rank from {n}sc)"""


_BM = _bm25_sql()


def _searchable(docs):
    return docs.select("doc_id", "text", F.substring("text", 1, 100).alias("summary"))


def _fields():
    """Fields of the stored index: those of BM25, a document's keywords, and its text where that is one word."""
    words = lambda: F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(R.WORD), F.lit(0)), F.lower))
    whole = lambda: F.when(F.col("text").rlike(f"^(?:{R.WORD})$"), F.array("text")).otherwise(F.array().cast("array<string>"))
    return [*(X.Field(lambda n=n: R.terms(n)) for n in FIELDS), X.Field(words, flat=True), X.Field(whole, flat=True)]


def _index(t):
    """The stored index of the documents table, built once for its present files and shared by all text routes."""
    return X.of_table(f"{t.dir}/documents.parquet", _searchable(t.documents), _fields())


def _asked(terms, weights: dict[int, float]):
    """Terms (qid, term, boost) asked in several fields with their weights."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(w).alias("w")) for f, w in weights.items()])).alias("x")
    return terms.select("qid", "term", "boost", each).select("qid", F.col("x.field").alias("field"), "term", (F.col("boost") * F.col("x.w")).alias("boost"))


def _bm25(t, k, questions=None, docs=None, terms=None):
    """BM25 over the stored index; over `docs` alone where these are given, with their own statistics."""
    terms = R.question_terms(t.fx_questions if questions is None else questions) if terms is None else terms
    if docs is not None:
        return R.bm25(_searchable(docs), terms, k, fields=FIELDS)
    return _index(t).search(_asked(terms, dict(enumerate(FIELDS.values()))), k)


@query(f"with {_BM} select qid, doc_id, round(score, 4) as score, cast(rank as int) as rank from bm where rank <= 20")
def bm25_topk(t):
    return _bm25(t, 20).select("qid", "doc_id", F.round("score", 4).alias("score"), "rank")


@query(f"""with tok as (select 0 as field, doc_id, unnest({_WORDS.format('substr(text, 1, 100)')}) as term from documents
      union all select 1, doc_id, unnest({_WORDS.format('text')}) from documents
      union all select 2, doc_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9\\-_]+'), lambda x: lower(x)))) from documents
      union all select 3, doc_id, text from documents where regexp_full_match(text, '[A-Za-z][A-Za-z0-9\\-_]+'))
    select field, count(distinct doc_id) as n, count(*) as length, count(distinct term) as terms from tok group by field""")  # fmt: skip
def text_index_stats(t):
    """The stored full-text index of the documents: per field its documents, their length together, and its terms."""
    index = _index(t)
    totals, terms = index.statistics()
    return totals.join(terms.groupBy("field").agg(F.count("*").alias("terms")), "field")


@query(f"""with {_bm25_sql(docs='(select * from documents where doc_id % 7 <> 0)')}
    select qid, doc_id, round(score, 4) as score, cast(rank as int) as rank from bm where rank <= 10""")
def text_index_updates(t):
    """BM25 over an index that took its documents in two batches, a third of the second twice, lost every seventh and was merged."""
    index = X.Index(t.spark, tables.new_path(t.spark, "text-index"), _fields()[: len(FIELDS)])
    docs = _searchable(t.documents)
    index.upsert("even", docs.where("doc_id % 2 = 0"))
    index.upsert("odd", docs.where("doc_id % 2 = 1"))
    index.upsert("again", docs.where("doc_id % 6 = 1"))
    index.delete("out", docs.where("doc_id % 7 = 0"))
    index.merge("merge")
    top = index.search(_asked(R.question_terms(t.fx_questions), dict(enumerate(FIELDS.values()))), 10)
    return top.select("qid", "doc_id", F.round("score", 4).alias("score"), "rank")


_SYNONYMS = "select qid, 'that the' as question, 1.0 as b from fx_questions where qid % 2 = 0"


@query(f"""with {_BM}, {_bm25_sql(f'({_SYNONYMS})', name='sy')},
    m as (select qid, doc_id, max(score) as score from (select qid, doc_id, score from bm where rank <= 10
      union all select qid, doc_id, 0.85 * score from sy where rank <= 10) group by 1, 2)
    select qid, doc_id, cast(rank as int) as rank
    from (select qid, doc_id, row_number() over (partition by qid order by round(score, 8) desc, doc_id) as rank from m) where rank <= 10""")  # fmt: skip
def bm25_synonyms(t):
    """A group of synonyms is searched on its own, its scores lowered; each document counts with its best score."""
    other = t.fx_questions.where("qid % 2 = 0").select("qid", F.lit("that the").alias("question"))
    return R.with_synonyms(_bm25(t, 10), [_bm25(t, 10, other)], 10).select("qid", "doc_id", "rank")


_BOOSTED = f"(select qid, question, 1.0 as b from fx_questions union all select qid, question, 0.4 from ({_SYNONYMS}))"


@query(f"with {_bm25_sql(_BOOSTED)} select qid, doc_id, cast(rank as int) as rank from bm where rank <= 10")
def bm25_synonym_boost(t):
    """Synonyms inside the question's own search, with a boost of 0.4; a term that is asked itself keeps its own."""
    other = t.fx_questions.where("qid % 2 = 0").select("qid", F.explode(F.array(F.lit("that"), F.lit("the"))).alias("term"), F.lit(0.4).alias("boost"))
    terms = R.question_terms(t.fx_questions).unionByName(other).groupBy("qid", "term").agg(F.max("boost").alias("boost"))
    return _bm25(t, 10, terms=terms).select("qid", "doc_id", "rank")


@query(f"""with {_bm25_sql(docs='(select * from documents where doc_id % 10 = 3)')} select qid, doc_id, cast(rank as int) as rank from bm where rank
        <= 8""")
def ephemeral_route(t):
    """BM25 over a session's own documents only; a session without documents gives no rows."""
    session = t.documents.where("doc_id % 10 = 3").select("doc_id")
    return _bm25(t, 8, docs=t.documents.join(session, "doc_id", "left_semi")).select("qid", "doc_id", "rank")


def _first_sql(pattern, n):
    """First n distinct matches of each question, in order."""
    return f"""select qid, t from (select qid, t, row_number() over (partition by qid order by min(p)) as rn
        from (select qid, unnest(regexp_extract_all(question, '{pattern}')) as t, generate_subscripts(regexp_extract_all(question, '{pattern}'), 1) as p from fx_questions)
        group by 1, 2) where rn <= {n}"""


_KW = f"""kt as (select distinct qid, t from ({_first_sql('[A-Za-z][A-Za-z0-9\\-_]+', 10)} union all {_first_sql('[A-Z][a-z]+', 5)})),
    kd as (select distinct doc_id, lower(t) as term from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9\\-_]+')) as t from documents)),
    ks as (select qid, doc_id, sum(w) as score from (select qid, doc_id, 1.5 as w from (select distinct qid, lower(t) as term from kt) join kd using (term)
      union all select qid, doc_id, 2.0 from kt join documents on text = t) group by 1, 2),
    kw as (select qid, doc_id, score, row_number() over (partition by qid order by score desc, doc_id) as rank from ks)"""


def _keywords(t, k):
    """The keyword route over the stored index: 1.5 for a keyword without regard to case, 2 for a text that is the term."""
    asked = tables.store(R.exact_terms(t.fx_questions), "exact-terms")
    words = asked.select("qid", F.lower("term").alias("term")).distinct().select("qid", F.lit(len(FIELDS)).alias("field"), "term", F.lit(1.5).alias("boost"))
    whole = asked.distinct().select("qid", F.lit(len(FIELDS) + 1).alias("field"), "term", F.lit(2.0).alias("boost"))
    return _index(t).search(words.unionByName(whole), k)


@query(f"with {_KW} select qid, doc_id, cast(score as double) as score, cast(rank as int) as rank from kw where rank <= 8")
def kw_exact_topk(t):
    """Documents by the question's words and names that they have as keywords (1.5 each) or consist of (2)."""
    return _keywords(t, 8).select("qid", "doc_id", "score", "rank")


_DOT = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: cast(x[1] as double) * x[2]))"
_VEC = f"v as (select a.vec_id as qid, b.vec_id, {_DOT} as score from embeddings a, embeddings b where a.vec_id % 20 = 0), vr as (select *, row_number() over (partition by qid order by round(score, 6) desc, vec_id) as rank from v)"


def _vectors(t, k, similarity=V.dot, which="vec_id % 20 = 0"):
    q = t.embeddings.where(which).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    return R.vector_search(t.embeddings.select("vec_id", "embedding"), q, k, similarity)


@query(f"with {_VEC} select qid, vec_id, round(score, 4) as score, cast(rank as int) as rank from vr where rank <= 10")
def vector_topk(t):
    return _vectors(t, 10).select("qid", "vec_id", F.round("score", 4).alias("score"), "rank")


_VECTORS: dict[tuple, tuple] = {}


def _vector_index(t):
    """The embeddings in a stored vector index, put in by two batches, with a third of the second taken out and put back, and the cells
    that its measured recall asks for. Built once for the table's present files."""
    path = f"{t.dir}/embeddings.parquet"
    key = (t.spark.sparkContext.applicationId, path, tables.files_of(t.spark, path))
    if key in _VECTORS and _VECTORS[key][0].log.entries():
        return _VECTORS[key]
    index = VX.Index(t.spark, tables.new_path(t.spark, "vector-index"))
    items = t.embeddings.select(F.col("vec_id").alias("item"), "embedding")
    index.fit(items)
    index.upsert("even", items.where("item % 2 = 0"))
    index.upsert("odd", items.where("item % 2 = 1"))
    index.delete("out", items.where("item % 6 = 1"))
    index.upsert("back", items.where("item % 6 = 1"))
    _VECTORS[key] = index, index.tune(10)[0]
    return _VECTORS[key]


@query()
def vector_index_topk(t):
    """The vector route over the stored index, in as many cells as its measured recall asks for; no SQL: it may miss one in twenty."""
    index, probe = _vector_index(t)
    q = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    return index.search(q, 10, probe).select("qid", F.col("item").alias("vec_id"), F.round("score", 4).alias("score"), "rank")


@query("select vec_id as qid, 10 as asked, true as found_itself, true as enough from embeddings where vec_id % 20 = 0")
def vector_index_recall(t):
    """Each question's ten hits in the stored index against the exact ten: it finds itself (or ten equal ones, which then come first by id), and all
    together nine tenths are found."""
    index, probe = _vector_index(t)
    q = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    found = tables.store(index.search(q, 10, probe).select("qid", F.col("item").alias("vec_id"), F.round("score", 6).alias("score")), "found")
    exact = tables.store(_vectors(t, 10, V.cosine).select("qid", "vec_id"), "exact")
    enough = VX.recall(found, exact, "vec_id") >= 0.9
    itself = F.max(F.col("vec_id") == F.col("qid")) | ((F.count("*") == 10) & (F.min("score") >= 1))
    own = found.groupBy("qid").agg(F.count("*").cast("int").alias("asked"), itself.alias("found_itself"))
    return own.withColumn("enough", F.lit(enough))


@query(f"with {_VEC} select qid, vec_id, cast(rank as int) as rank from vr where rank <= 5")
def cosine_topk(t):
    return _vectors(t, 5, V.cosine).select("qid", "vec_id", "rank")


@query(f"""with {_VEC}, m as (select qid % 100 as qid, vec_id, max(score) as score from v group by 1, 2)
    select qid, vec_id, cast(rank as int) as rank from (select *, row_number() over (partition by qid order by round(score, 6) desc, vec_id) as rank
        from m) where rank <= 10""")  # fmt: skip
def vector_multi_query(t):
    """Several query vectors per question: the best score of each item counts."""
    best = _vectors(t, 10).select((F.col("qid") % 100).alias("qid"), "vec_id", "score")  # what is not among a vector's own best is not among all
    s = best.groupBy("qid", "vec_id").agg(F.max("score").alias("score"))
    return R.top_k(s, ["qid"], 10, F.round("score", 6).desc(), F.col("vec_id")).select("qid", "vec_id", "rank")


@query("""select user_id, event_id, cast(rn as int) as rank from (select user_id, event_id, row_number() over (partition by user_id, event_type
        order by value desc, event_id) as rn from events)""")
def route_rank(t):
    w = Window.partitionBy("user_id", "event_type").orderBy(F.col("value").desc(), "event_id")
    return t.events.select("user_id", "event_id", F.row_number().over(w).alias("rank"))


@query("""select event_type, event_id, cast(rn as int) as rank from (select event_type, event_id, row_number() over (partition by event_type order
        by value desc, event_id) as rn from events) where rn <= 20""")
def route_topk(t):
    return R.top_k(t.events, ["event_type"], 20, F.col("value").desc(), F.col("event_id")).select("event_type", "event_id", "rank")


_RRF = f"""{_BM}, {_KW}, cand as (select qid, 'bm25' as route, 0.7 as w, doc_id, rank from bm where rank <= 20
      union all select qid, 'kw_exact', 0.5, doc_id, rank from kw where rank <= 20),
    f as (select qid, doc_id, sum(w / (60 + rank)) * (case when doc_id % 7 = 0 then 1.2 else 1 end)
        * greatest(0.2, least(1.0, case when doc_id % 11 = 0 then 1.0 else (doc_id % 11) / 10.0 end)) as score, string_agg(distinct route, ',' order by route) as routes
      from cand group by qid, doc_id)"""


def _routed(t):
    """Candidates of both text routes; some documents are a session's own, some of low quality."""
    bm = _bm25(t, 20).select("qid", "doc_id", "rank", F.lit("bm25").alias("route"))
    cand = bm.unionByName(_keywords(t, 20).select("qid", "doc_id", "rank", F.lit("kw_exact").alias("route")))
    return cand.withColumns({"ephemeral": F.col("doc_id") % 7 == 0, "quality": (F.col("doc_id") % 11) / 10.0})


def _fused(t):
    return R.rrf(_routed(t), {"bm25": 0.7, "kw_exact": 0.5}, "doc_id")


@query(f"with {_RRF} select qid, doc_id, round(score, 9) as score, routes from f")
def rrf_merge(t):
    return _fused(t).select("qid", "doc_id", F.round("score", 9).alias("score"), "routes")


@query("""select doc_id from (select doc_id, row_number() over (partition by substr(replace(lower(trim(text)), ' ', ''), 1, 120) order by n_chars
        desc, doc_id) as rn from documents) where rn = 1""")
def text_dedup(t):
    return R.text_dedup(t.documents, [], "text", F.col("n_chars").desc(), F.col("doc_id")).select("doc_id")


_COS = "list_cosine_similarity(cast(x as double[]), cast(v as double[]))"


@query(f"""with recursive {_VEC}, c as (select qid, vr.vec_id, rank, cast(embedding as double[]) as v from vr join embeddings e on e.vec_id =
        vr.vec_id where rank <= 80),
    g as (select qid, 0 as pos, cast([] as double[][]) as held, cast(null as bigint) as vec_id, cast(null as boolean) as keeps from (select distinct
        qid from c)
      union all select g.qid, pos + 1, case when ok then list_append(held, v) else held end, c.vec_id, pos >= 60 or ok
      from g join c on c.qid = g.qid and c.rank = g.pos + 1, lateral (select len(list_filter(held, lambda x: {_COS} >= 0.6)) = 0 as ok))
    select qid, vec_id from g where keeps""")  # fmt: skip
def semantic_dedup(t):
    """Greedy: a vector goes if it is close to one kept before it."""
    top = _vectors(t, 80).join(t.embeddings.select("vec_id", "embedding"), "vec_id")
    return R.greedy_dedup(top, "qid", "vec_id", "embedding", 0.6).select("qid", "vec_id")


_OVERLAP = f"""len(list_intersect(list_distinct({_WORDS.format('question')}), {_WORDS.format('text')})) / len(list_distinct({_WORDS.format('question')}))"""
_FINAL = """g as (select *, count_if(sc >= 0.3) over (partition by qid) as good from s),
    r as (select *, row_number() over (partition by qid order by sc desc, doc_id) as rn from g where good < 3 or sc >= 0.3)"""


@query(f"""with {_BM}, s as (select bm.qid, bm.doc_id, {_OVERLAP} as sc from bm join fx_questions q using (qid) join documents d using (doc_id) where
        rank <= 12), {_FINAL}
    select qid, doc_id, cast(rn as int) as final_rank from r where rn <= 6""")  # fmt: skip
def rerank_final(t):
    top = tables.store(_bm25(t, 12).select("qid", "doc_id"), "hits")
    rows = t.documents.select("doc_id", "text").join(tables.small(top), "doc_id").join(tables.small(t.fx_questions), "qid")
    return R.rerank(rows, R.overlap_score("question", "text")).select("qid", "doc_id", "final_rank")


@query(f"with {_BM} select qid, max(score) as best, coalesce(max(score), 0) < 40 as second_round from bm where rank <= 20 group by qid")
def self_eval_flag(t):
    """Questions whose best hit is too weak get a second round."""
    return _bm25(t, 20).groupBy("qid").agg(F.max("score").alias("best")).withColumn("second_round", F.coalesce("best", F.lit(0.0)) < 40)


_AGAIN = "(select qid, substr(question, 1, 60) as question, 1.0 as b from fx_questions where qid in (select qid from weak))"


@query(f"""with {_RRF}, weak as (select qid from bm where rank <= 20 group by qid having max(score) < 60), {_bm25_sql(_AGAIN, name='re')},
    al as (select * from cand union all select qid, 'bm25_rewrite', 1.0, doc_id, rank from re where rank <= 40),
    f2 as (select qid, doc_id, sum(w / (60 + rank)) * (case when doc_id % 7 = 0 then 1.2 else 1 end)
        * greatest(0.2, least(1.0, case when doc_id % 11 = 0 then 1.0 else (doc_id % 11) / 10.0 end)) as score, string_agg(distinct route, ',' order
        by route) as routes
      from al group by qid, doc_id)
    select qid, doc_id, round(score, 9) as score, routes from f2""")  # fmt: skip
def second_round(t):
    """Questions whose best hit is weak are asked again, rewritten (here: their first 60 characters) and with twice as many hits.

    The new list joins the others as a route of its own with weight 1 and all are fused anew.
    """
    first = tables.store(_bm25(t, 20), "hits")
    weak = tables.store(first.groupBy("qid").agg(F.max("score").alias("best")).where("best < 60").select("qid"), "weak")
    again = t.fx_questions.join(tables.small(weak), "qid", "left_semi").select("qid", F.substring("question", 1, 60).alias("question"))
    lists = {"bm25": first, "kw_exact": _keywords(t, 20), "bm25_rewrite": _bm25(t, 40, again)}
    cand = reduce(DataFrame.unionByName, [x.select("qid", "doc_id", "rank", F.lit(n).alias("route")) for n, x in lists.items()])
    cand = cand.withColumns({"ephemeral": F.col("doc_id") % 7 == 0, "quality": (F.col("doc_id") % 11) / 10.0})
    return R.rrf(cand, {"bm25": 0.7, "kw_exact": 0.5}, "doc_id").select("qid", "doc_id", F.round("score", 9).alias("score"), "routes")


@query("select vec_id from (select vec_id, (vec_id % 10) / 10.0 as quality from embeddings) where quality >= 0.2")
def quality_floor(t):
    """Fused rows of too low a quality go."""
    return t.embeddings.select("vec_id", (F.col("vec_id") % 10 / 10.0).alias("quality")).where("quality >= 0.2").select("vec_id")


@query(f"""with p as (select a.vec_id as mention, b.vec_id as entity, {_DOT} / sqrt(list_sum(list_transform(a.embedding, lambda x: cast(x as double)
        * x)) * list_sum(list_transform(b.embedding, lambda x: cast(x as double) * x))) as s
      from embeddings a, embeddings b where a.vec_id % 20 = 0 and b.vec_id <> a.vec_id), r as (select *, row_number() over (partition by mention order
        by round(s, 6) desc, entity) as rn from p)
    select mention, case when round(s, 6) >= 0.88 then entity end as entity from r where rn = 1""")  # fmt: skip
def entity_vector_link(t):
    """Each mention with the entity whose vector is nearest, if its cosine is 0.88 or more."""
    best = R.vector_search(
        t.embeddings.select("vec_id", "embedding"), t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"),
                F.col("embedding").alias("q")), 2, V.cosine
    )
    best = R.top_k(best.where("vec_id <> qid").drop("rank"), ["qid"], 1, F.round("score", 6).desc(), F.col("vec_id"))
    return best.select(F.col("qid").alias("mention"), F.when(F.round("score", 6) >= 0.88, F.col("vec_id")).alias("entity"))


@query("""with e as (select src as a, dst as b, concat(src, '-', dst) as id from fx_edges union all select dst, src, concat(src, '-', dst) from
        fx_edges), s as (select distinct src as start from fx_edges where src % 20 = 0),
    h1 as (select start, b as node, id as u1 from s join e on a = start), h2 as (select start, e.b as node from h1 join e on e.a = h1.node where e.id
        <> h1.u1)
    select start, node, length, count(*) as paths from (select start, node, 1 as length from h1 union all select start, node, 2 from h2) group by 1,
        2, 3""")  # fmt: skip
def graph_hops(t):
    e = t.fx_edges
    paths = R.graph_paths(e, e.where("src % 20 = 0").select(F.col("src").alias("start")).distinct(), 2)
    return paths.groupBy("start", "node", "length").agg(F.count("*").alias("paths"))


@query("""with e as (select src as a, dst as b, rel, concat(src, '-', dst) as id from fx_edges union all select dst, src, rel, concat(src, '-', dst) from
        fx_edges), s as (select distinct src as start from fx_edges where src % 4 = 0),
    h1 as (select start, b as node, rel, id as u1 from s join e on a = start),
    h2 as (select start, h1.rel as r1, h1.node as n1, e.rel as r2, e.b as node from h1 join e on e.a = h1.node where e.id <> h1.u1),
    p as (select start, 1 as length, rel as r1, node as n1, '' as r2, 0 as n2, node, concat(start, '—', rel, '→', node) as path from h1
      union all select start, 2, r1, n1, r2, node, node, concat(start, '—', r1, '→', n1, '—', r2, '→', node) from h2)
    select start, node, path, length from (select *, row_number() over (partition by start order by length, r1, n1, r2, n2) as rn from p) where rn <=
        50""")  # fmt: skip
def graph_paths(t):
    """The first fifty paths of up to two edges of each entity, shortest first."""
    e = t.fx_edges
    return R.graph_paths(e, e.where("src % 4 = 0").select(F.col("src").alias("start")).distinct(), 2, 50)


_NAMES = """select c_name as name from customer union select p_name from part union select unnest(regexp_extract_all(text, '[A-Za-z]{6,}')) from
    benchmark"""


@query(f"""with n as ({_NAMES}) select doc_id, count(*) as n, md5(string_agg(name, '|' order by name)) as names from documents, n where contains(text,
        name) group by doc_id""")
def entity_presence(t):
    """Names of customers and parts and longer words of the questions that occur in each document, found in one pass over its text."""
    words = t.benchmark.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{6,}"), F.lit(0))).alias("name"))
    names = t.customer.select(F.col("c_name").alias("name")).union(t.part.select("p_name")).union(words)
    found = entities.present(t.documents, names)
    return found.select("doc_id", F.size("names").cast("long").alias("n"), F.md5(F.array_join("names", "|").cast("binary")).alias("names"))


@query("""with terms as (select distinct upper(substr(n_name, 1, 2)) as term from nation), h as (select doc_id, term from documents, terms where
        contains(upper(text), term))
    select a.term as a, b.term as b, count(*) as n from h a join h b on a.doc_id = b.doc_id and a.term < b.term group by 1, 2""")  # fmt: skip
def cooccurrence(t):
    """Pairs of dictionary entities in one chunk; the dictionary is an array of fixed size, so chunks meet it without a join."""
    terms = t.nation.select(F.upper(F.substring("n_name", 1, 2)).alias("term")).distinct().agg(F.array_sort(F.collect_set("term")).alias("terms"))
    h = t.documents.select("doc_id", F.upper("text").alias("x")).crossJoin(F.broadcast(terms))
    h = h.select(F.filter("terms", lambda w: F.col("x").contains(w)).alias("has")).where("size(has) > 1")
    pairs = h.select(F.explode(F.flatten(F.transform("has", lambda a,
            i: F.transform(F.slice(F.col("has"), i + 2, F.size("has")), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p"))
    return pairs.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("n"))


@query("""with c as (select *, doc_id - doc_id % 10 as parent_id from documents) select c.doc_id, case when p.text is not null and p.text <> c.text
        then p.doc_id end as parent, length(coalesce(case when p.text <> c.text then p.text end, c.text)) as n from c left join documents p on
        p.doc_id = c.parent_id where c.doc_id % 10 <> 0""")
def parent_backfill(t):
    """Hits with the text of their parent where it differs."""
    hits = t.documents.where("doc_id % 10 <> 0").select("doc_id", "text", (F.col("doc_id") - F.col("doc_id") % 10).alias("parent_id"))
    p = t.documents.select(F.col("doc_id").alias("parent_id"), F.col("text").alias("ptext"))
    differs = F.coalesce(F.col("ptext") != F.col("text"), F.lit(False))
    return hits.join(p, "parent_id", "left").select("doc_id", F.when(differs, F.col("parent_id")).alias("parent"),
            F.char_length(F.when(differs, F.col("ptext")).otherwise(F.col("text"))).cast("long").alias("n"))


_TOKENS = "(length(regexp_replace({0}, '[^\u4e00-\u9fff]', '', 'g')) + cast(floor((length({0}) - length(regexp_replace({0}, '[^\u4e00-\u9fff]', '', 'g'))) / 3.5) as int) + 1)"


@query(f"""with recursive {_BM}, b as (select qid, rank, concat('[', rank, '] ', text) as block from bm join documents using (doc_id) where rank <=
        6),
    p as (select distinct qid, cast(0 as bigint) as rank, 0 as used, '' as block from b
      union all select p.qid, b.rank, used + {_TOKENS.format('c')}, c
      from p join b on b.qid = p.qid and b.rank = p.rank + 1, lateral (select least(1500, 4000 - used) as room, {_TOKENS.format('b.block')} as n),
        lateral (select case when n <= room then b.block else substr(b.block, 1, greatest(64, cast(floor(length(b.block) * (room / n)) as int))) end
        as c) where room > 0)
    select qid, cast(rank as int) as rank, block from p where rank > 0""")  # fmt: skip
def context_pack(t):
    top = tables.store(_bm25(t, 6), "hits")
    rows = t.documents.select("doc_id", "text").join(tables.small(top), "doc_id")
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("text"))
    return R.pack_context(rows.select("qid", "rank", block.alias("block")), "qid", "block", "rank")


@query(f"""with {_BM}, truth as (select item_id as qid, doc_id from benchmark b join documents d on contains(d.text, b.text)), g as (select t.qid,
        max(case when bm.doc_id is not null then 1 else 0 end) as hit from (select distinct qid, doc_id from truth) t
    left join (select qid, doc_id from bm where rank <= 20) bm on bm.qid = t.qid and bm.doc_id = t.doc_id group by t.qid) select count(*) as n,
        avg(hit) as recall from g""")  # fmt: skip
def recall_at_k(t):
    """Share of questions with a source document among the first 20, over those that have one."""
    items = t.benchmark.select(F.col("item_id").alias("qid"), F.col("text").alias("item"))
    truth = R.holders(t.documents.select("doc_id", "text"), items).select("qid", "doc_id").distinct()
    hits = _bm25(t, 20).select("qid", "doc_id", F.lit(1).alias("h"))
    g = truth.join(hits, ["qid", "doc_id"], "left").groupBy("qid").agg(F.max(F.coalesce("h", F.lit(0))).alias("hit"))
    return g.agg(F.count("*").alias("n"), F.avg("hit").alias("recall"))


@query("""select event_type, avg(value) as mean, list_sort(list(value))[cast(floor(0.95 * (count(*) - 1)) as int) + 1] as p95 from events group by
        event_type""")
def latency_report(t):
    """Mean and the value at place floor(0.95 (n - 1)) in order, by an exact percentile without a list per group."""
    w = Window.partitionBy("event_type")
    x = t.events.withColumn("n", F.count("*").over(w)).withColumn("rn", F.row_number().over(w.orderBy("value")))
    return x.groupBy("event_type").agg(F.avg("value").alias("mean"),
            F.max(F.when(F.col("rn") == F.floor(0.95 * (F.col("n") - 1)) + 1, F.col("value"))).alias("p95"))


@query("""select event_type, le, n from (select event_type, count_if(value <= 1) as le_1, count_if(value <= 5) as le_5, count_if(value <= 20) as
        le_20, count_if(value <= 100) as le_100 from events group by event_type) unpivot (n for le in (le_1, le_5, le_20, le_100))""")
def latency_histogram(t):
    g = t.events.groupBy("event_type").agg(*[F.count_if(F.col("value") <= b).alias(f"le_{b}") for b in (1, 5, 20, 100)])
    return g.unpivot("event_type", [f"le_{b}" for b in (1, 5, 20, 100)], "le", "n")


@query("""with c as (select doc_id, ord(unnest(regexp_extract_all(text, '.', 0, 's'))) % 8 as b from documents where doc_id % 10 <> 0),
    n as (select doc_id, b, count(*) as n from c group by 1, 2), s as (select doc_id, sqrt(sum(n * n)) as l from n group by 1),
    d as (select doc_id, unnest(case when doc_id % 10 = 0 then [null] else [0, 1, 2, 3, 4, 5, 6, 7] end) as b from documents)
    select doc_id, cast(b as int) as bucket, case when b is not null then coalesce(n / l, case when l is null and b = 0 then 1.0 else 0.0 end) end as v
    from d left join n using (doc_id, b) left join s using (doc_id)""")  # fmt: skip
def embed_children(t):
    """Children with each component of their vector; parents get none and keep one row."""
    child = F.col("doc_id") % 10 != 0
    c = t.documents.where(child).select("doc_id", F.posexplode(V.char_bucket_embedding("text", 8)).alias("bucket", "v"))
    none = F.lit(None)
    return c.unionByName(t.documents.where(~child).select("doc_id", none.cast("int").alias("bucket"), none.cast("double").alias("v")))


def answer(t):
    """Questions over the document base: BM25 and exact keywords fused, near-equal texts dropped, six reranked texts each."""
    fused = tables.store(R.top_k(_fused(t), ["qid"], 12, F.col("score").desc(), F.col("doc_id")).drop("rank"), "fused")
    rows = t.documents.select("doc_id", "text").join(tables.small(fused), "doc_id").join(tables.small(t.fx_questions), "qid")
    # what the next steps need of a text goes on, the text itself does not
    rows = rows.select("qid", "question", "doc_id", "score", "routes", R.overlap_score("question", "text").alias("overlap"), T.fingerprint("text").alias("begins"),
            F.substring("text", 1, 200).alias("snippet"))
    rows = R.text_dedup(rows, ["qid"], "begins", F.col("score").desc(), F.col("doc_id"))
    best = R.rerank(rows, F.col("overlap"))
    shown = (F.round("score", 8).alias("score"), F.round("rerank_score", 6).alias("rerank_score"), "routes", "snippet")
    return best.select("qid", "question", "final_rank", "doc_id", *shown)


@query(f"""with {_RRF}, c as (select * from (select *, row_number() over (partition by qid order by score desc, doc_id) as fr from f) where fr <=
        12),
    d as (select c.qid, question, c.doc_id, c.score, routes, text,
        row_number() over (partition by c.qid, substr(replace(lower(trim(text)), ' ', ''), 1, 120) order by c.score desc, c.doc_id) as dup
      from c join fx_questions q using (qid) join documents using (doc_id)),
    s as (select *, {_OVERLAP} as sc from d where dup = 1), {_FINAL}
    select qid, question, cast(rn as int) as final_rank, doc_id, round(score, 8) as score, round(sc, 6) as rerank_score, routes, substr(text, 1, 200)
        as snippet from r where rn <= 6""")  # fmt: skip
def answer_batch(t):
    return answer(t)
