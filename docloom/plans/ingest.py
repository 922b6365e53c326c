"""Queries over ingest: workflows, staged writes, chunk emission, enrichment payloads, requeueing, monitoring, memory."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import retrieval as R
from docloom.operators import staging, steps, tables, workflow
from docloom.sources import parsers as P
from docloom.sources import settings

from .base import query
from .search import _DOT


_PARAGRAPHS = "list_filter(list_transform(string_split_regex(text, '\n\\s*\n'), lambda x: trim(x)), lambda x: x <> '')"


@query(f"""with e as (select doc_id, unnest({_PARAGRAPHS}) as e, generate_subscripts({_PARAGRAPHS}, 1) as i from documents),
    c as (select *, row_number() over (partition by doc_id, substr(lower(replace(e, ' ', '')), 1, 200) order by i) as n from e)
    select doc_id, doc_id % 4 <> 3 as format_ok, count(*) as n_chunks, count_if(length(e) >= 20) as n_vectors, max(case when i = 1 then substr(e, 1,
        64) end) as title
    from c where n = 1 group by doc_id""")  # fmt: skip
def workflow_run(t):
    """Documents through the workflow of their file, its steps registered in the library; files named .pdf do not begin like one, and
    a step that only improves them fails."""
    docs = t.fx_documents.select("doc_id", "text", "file_type", F.encode(F.substring("text", 1, 8), "UTF-8").alias("head"))
    failing = {"enrich": lambda df: df.select("no such column")}
    done, warnings = workflow.run(docs, "txt", workflow.STEPS | failing, workflow.load(steps.FILE))
    if len(warnings) != 1:
        raise RuntimeError(f"one warning expected: {warnings}")
    return done.select("doc_id", "format_ok", "n_chunks", "n_vectors", "title")


@query("""select chunk_id, doc_id, seq, kind, page_start, page_end, roles, token_count, text from (
    with l as (select doc_id, unnest(range(0, len(string_split(text, '\n')))) as i, unnest(string_split(text, '\n')) as s, case doc_id % 3 when 0 then
        '' when 1 then 'admin' else 'admin,engineer' end as roles from documents),
      g as (select doc_id, roles, i // 5 as g, trim(string_agg(s, '\n' order by i), E' \t\n\r\f\v') as text, cast(min(1 + i // 12) as int) as
        page_start, cast(max(1 + i // 12) as int) as page_end from l group by all),
      k as (select *, case when g % 7 = 3 then 'table' else 'text' end as kind from g where text <> ''),
      d as (select *, row_number() over (partition by doc_id, case when kind = 'table' then g else -1 end, substr(replace(lower(text), ' ', ''), 1,
        200) order by g) as n from k),
      q as (select *, cast(row_number() over (partition by doc_id order by g) - 1 as int) as seq from d where n = 1)
    select substr(sha256(concat('default:', doc_id, ':', seq, ':', substr(sha256(text), 1, 8))), 1, 32) as chunk_id, doc_id, seq, kind, page_start,
        page_end, roles,
      cast(floor(length(text) / 3.5) as int) + 1 as token_count, text from q)""")  # fmt: skip
def chunk_emit(t):
    """Chunks of section runs with pages, kind and roles: texts repeated in a document go, tables always stay; numbered in order.

    Lines are elements, five to a section, twelve to a page; every seventh section is a table.
    """
    d = t.fx_documents
    lines = d.select("doc_id", F.col("roles_csv").alias("roles"), F.posexplode(F.split("text", "\n")).alias("i", "s"))
    g = lines.groupBy("doc_id", "roles", F.floor(F.col("i") / 5).alias("g")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]), "\n").alias("text"),
        F.min(1 + F.floor(F.col("i") / 12)).cast("int").alias("page_start"), F.max(1 + F.floor(F.col("i") / 12)).cast("int").alias("page_end"),
    )
    g = g.withColumn("text", F.regexp_replace("text", "^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$", "")).where("text <> ''")
    g = g.withColumn("kind", F.when(F.col("g") % 7 == 3, "table").otherwise("text"))
    same = F.substring(F.replace(F.lower("text"), F.lit(" "), F.lit("")), 1, 200)
    w = Window.partitionBy("doc_id", F.when(F.col("kind") == "table", F.col("g")).otherwise(-1), same).orderBy("g")
    g = g.withColumn("n", F.row_number().over(w)).where("n = 1")
    g = g.withColumn("seq", (F.row_number().over(Window.partitionBy("doc_id").orderBy("g")) - 1).cast("int"))
    return g.select(
        T.chunk_id(F.lit("default"), "doc_id", "seq", "text").alias("chunk_id"), "doc_id", "seq", "kind", "page_start", "page_end", "roles",
                T.token_count("text").alias("token_count"), "text"
    )


@query("""select doc_id, doc_id % 9 <> 0 as meta, doc_id % 9 <> 0 and length(text) < 3000 as fulltext, doc_id % 9 <> 0 and doc_id % 4 <> 1 as
        vectors, doc_id % 9 <> 0 as graph,
      case when doc_id % 9 = 0 then 'failed' when length(text) >= 3000 or doc_id % 4 = 1 then 'partial' else 'done' end as status,
      cast(doc_id % 9 <> 0 as int) + cast(doc_id % 9 <> 0 and length(text) < 3000 as int) as written
    from documents where length(text) > 0""")  # fmt: skip
def staged_write(t):
    """Chunks written store by store: a bad one fails its document in that store; a run started again without what the first one
    returned writes nothing again."""
    items = t.documents.where("length(text) > 0").select("doc_id", F.col("doc_id").alias("chunk_id"), F.char_length("text").alias("n"))
    path = tables.new_path(t.spark, "staged")
    valid = {"meta": F.col("doc_id") % 9 != 0, "fulltext": F.col("n") < 3000, "vectors": F.col("doc_id") % 4 != 1}
    staging.staged_write(items, valid, None, path, "all")
    again = staging.staged_write(items, valid, None, path, "all")
    held = staging.existing(t.spark, path).where("stage in ('meta', 'fulltext')").groupBy(F.col("chunk_id").alias("doc_id")).agg(F.count("*").alias("k"))
    return again.join(held, "doc_id", "left").select("doc_id", *staging.STAGES, "status", F.coalesce("k", F.lit(0)).cast("int").alias("written"))


@query("""select doc_id, string_agg(s, '\n' order by i) as text, ((2000 * sum(length(s) % 10) + count(*)) // (2 * count(*))) / 10000.0 as confidence from
    (select doc_id, unnest(range(0, len(string_split(text, '\n')))) as i, unnest(string_split(text, '\n')) as s from documents) where trim(s) <> ''
        group by doc_id""")  # fmt: skip
def ocr_fallback(t):
    """Recognised lines of a page as one element with their mean confidence."""
    lines = t.documents.select("doc_id", F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "").alias("lines")).where("size(lines) > 0")
    text, confidence = T.ocr_text("lines", F.transform("lines", lambda x: F.char_length(x) % 10 / 10.0))
    return lines.select("doc_id", text.alias("text"), confidence.alias("confidence"))


@query("select item_id as qid, text as question, [cast(item_id as varchar), 'x'] as relevant from benchmark")
def evaluation_cases(t):
    """Cases written as files of JSON arrays, some hundred to a file, and read back by the library's reader."""
    path = tables.new_path(t.spark, "cases")
    files = max(1, t.benchmark.count() // 200)
    case = F.struct(F.concat_ws("\t", "item_id", "text").alias("question"), F.array(F.col("item_id").cast("string"), F.lit("x")).alias("relevant"))
    cases = t.benchmark.groupBy(F.pmod(F.xxhash64("item_id"), F.lit(files)).alias("file")).agg(F.to_json(F.collect_list(case)).alias("value"))
    cases.write.partitionBy("file").text(path)
    q = F.split("question", "\t", 2)
    return settings.evaluation_cases(t.spark, path).select(q[0].cast("long").alias("qid"), q[1].alias("question"), "relevant")


@query("""select c_custkey, concat('seg=', c_mktsegment, ' name=', c_name, ' port=8080 none=') as line from customer""")
def config_interpolate(t):
    """Settings with variables: known ones, a default, an unknown one."""
    env = F.create_map(F.lit("SEG"), F.col("c_mktsegment"), F.lit("NAME"), F.col("c_name"))
    line = settings.interpolated(F.lit("seg=${SEG} name=${NAME:-nobody} port=${PORT:-8080} none=${NONE}"), env)
    return t.customer.select("c_custkey", line.alias("line"))


@query("select event_id, '******' as api_token, event_type as kind from events")
def config_redact(t):
    m = settings.redacted_map(F.create_map(F.lit("Api_Token"), F.col("props"), F.lit("kind"), F.col("event_type")))
    return t.events.select("event_id", m["Api_Token"].alias("api_token"), m["kind"].alias("kind"))


@query("""select doc_id, array_to_string(list_slice(list_filter(ws, lambda w, i: list_position(ws, w) = i), 1, 5), ',') as keywords from
    (select doc_id, list_filter(list_transform(string_split(text, ' '), lambda w: substr(trim(w), 1, 32)), lambda w: w <> '' and not list_contains(stop, lower(w))) as ws
      from documents, (select string_split('""" + " ".join(dict.fromkeys(T.STOP_WORDS)).replace("'", "''") + """', ' ') as stop))""")  # fmt: skip
def clean_keywords(t):
    return t.documents.select("doc_id", F.array_join(T.clean_keywords(F.split("text", " ")), ",").alias("keywords"))


@query("select event_id, cast(json_extract_string(props, '$.k') as int) as k, event_type as kind from events")
def first_json(t):
    """The first object that parses and has the key: after one that does not parse and one without it, before another."""
    said = F.concat(F.lit("so } {bad {x}} then {\"other\": 1} "),
            F.to_json(F.struct(F.get_json_object("props", "$.k").alias("keywords"), F.struct("event_type").alias("summary"))), F.lit(" or {\"keywords\": 5}"))
    got = T.first_json(said, ("summary", "keywords"))
    return t.events.select("event_id", F.get_json_object(got, "$.keywords").cast("int").alias("k"),
            F.get_json_object(got, "$.summary.event_type").alias("kind"))


@query("select c_custkey, 2 as n_rows, trim(c_name) as name, c_mktsegment as segment from customer")
def preview_table(t):
    text = F.concat(F.lit("before\n| name | segment |\n|---|:-:|\n| "), "c_name", F.lit(" | "), "c_mktsegment", F.lit(" |\nafter"))
    rows = t.customer.select("c_custkey", T.table_lines(text).alias("r"))
    return rows.select("c_custkey", F.size("r").alias("n_rows"), F.col("r")[1][0].alias("name"), F.col("r")[1][1].alias("segment"))


@query("select event_id, 0.0 as first, round(value, 6) as second, 0.5 as third, greatest(0, least(2, value / 10)) as temperature from events")
def rerank_payload(t):
    """Scores of three candidates from answers in either of two shapes; a place out of range is ignored."""
    results = F.concat(F.lit('{"results":[{"index":2,"score":0.5},{"index":9,"relevance_score":1},{"index":1,"relevance_score":'),
            F.col("value").cast("string"), F.lit("}]}"))
    data = F.concat(F.lit('{"data":[{"document_index":1,"score":'), F.col("value").cast("string"), F.lit('},{"document_index":2,"score":0.5}]}'))
    s = T.rerank_scores(F.when(F.col("event_id") % 2 == 0, results).otherwise(data), 3)
    e = t.events.select("event_id", "value", s.alias("s"))
    return e.select("event_id", F.col("s")[0].alias("first"), F.round(F.col("s")[1], 6).alias("second"), F.col("s")[2].alias("third"),
            T.temperature(F.col("value") / 10).alias("temperature"))


@query("""select task_id, case when status in ('failed', 'partial') then 'pending' else status end as status, status in ('failed', 'partial') as
        requeued, cast(task_id % 4 as int) as retry_count from fx_tasks""")
def manual_requeue(t):
    """Failed and partial tasks go back to the queue, their count of retries untouched; others are refused."""
    again = F.col("status").isin("failed", "partial")
    return t.fx_tasks.select("task_id", F.when(again, "pending").otherwise(F.col("status")).alias("status"), again.alias("requeued"),
            (F.col("task_id") % 4).cast("int").alias("retry_count"))


@query("""with s as (select status, count(*) as n from fx_tasks group by status), on_ as (select unnest(['vector', 'bm25', 'kw_exact', 'graph']) as
        route), live as (select distinct unnest(['vector', 'bm25']) as route)
    select 'task' as kind, status as name, n from s union all select 'lost_route', route, 1 from on_ where route not in (select route from live)""")  # fmt: skip
def monitor_snapshot(t):
    """Tasks by status, and routes that are switched on but not live."""
    tasks = t.fx_tasks.groupBy(F.col("status").alias("name")).agg(F.count("*").alias("n")).select(F.lit("task").alias("kind"), "name", "n")
    routes = lambda *r: t.spark.createDataFrame([(x,) for x in r], "name string")
    lost = routes("vector", "bm25", "kw_exact", "graph").join(routes("vector", "bm25"), "name", "left_anti")
    return tasks.unionByName(lost.select(F.lit("lost_route").alias("kind"), "name", F.lit(1).cast("long").alias("n")))


@query("""select c_custkey, concat_ws('；', case when c_custkey % 2 = 0 then concat('专业背景：', c_mktsegment) end, case when c_custkey % 3 = 0 then
        '偏好回答格式：表格' end, case when n is not null then concat('常用产品：', p) end) as profile
    from customer left join (select o_custkey, count(*) as n, string_agg(o_orderpriority, '、' order by o_orderkey) as p from
      (select *, row_number() over (partition by o_custkey order by o_orderkey) as rn from orders) where rn <= 10 group by 1) on o_custkey = c_custkey""")  # fmt: skip
def memory_profile(t):
    """The profile text of a user: background, format, at most ten products; missing parts are left out."""
    o = R.top_k(t.orders, ["o_custkey"], 10, F.col("o_orderkey"), rank="rn")
    p = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("l"))
    products = F.array_join(F.transform("l", lambda x: x["o_orderpriority"]), "、")
    k = F.col("c_custkey")
    parts = (F.when(k % 2 == 0, F.concat(F.lit("专业背景："), "c_mktsegment")), F.when(k % 3 == 0, F.lit("偏好回答格式：表格")),
            F.when(F.col("l").isNotNull(), F.concat(F.lit("常用产品："), products)))
    return t.customer.join(p, "c_custkey", "left").select("c_custkey", F.concat_ws("；", *parts).alias("profile"))


@query(f"""with recursive c as (select vec_id // 40 as doc_id, vec_id, cast(embedding as double[]) as v, row_number() over (partition by vec_id // 40
        order by (vec_id * 7) % 10 desc, vec_id) as rank from embeddings),
    g as (select doc_id, 0 as pos, cast([] as double[][]) as held, cast(null as bigint) as vec_id, cast(null as boolean) as keeps from (select
        distinct doc_id from c)
      union all select g.doc_id, pos + 1, case when ok then list_append(held, v) else held end, c.vec_id, ok
      from g join c on c.doc_id = g.doc_id and c.rank = g.pos + 1, lateral (select len(list_filter(held, lambda x: list_cosine_similarity(x, v) >=
        0.5)) = 0 as ok))
    select doc_id, vec_id from g where keeps""")  # fmt: skip
def indoc_dedup(t):
    """Of chunks of one document that are nearly alike the one of higher quality stays (here: forty vectors to a document)."""
    e = t.embeddings.select(F.floor(F.col("vec_id") / 40).alias("doc_id"), "vec_id", "embedding", (F.col("vec_id") * 7 % 10).alias("q"))
    ranked = e.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("q").desc(), "vec_id")))
    return R.greedy_dedup(ranked, "doc_id", "vec_id", "embedding", 0.5).select("doc_id", "vec_id")


@query("""select p_partkey, case when p_size % 3 = 0 then 2 else 1 end as n_rows, case when p_size % 3 = 0 then 'new' else 'old' end as source from
        part""")
def region_enhance(t):
    """A table read again replaces the first reading only if it has more rows."""
    new = F.when(F.col("p_size") % 3 == 0, F.expr("array(array('new', 'a'), array('new', 'b'))")).when(F.col("p_size") % 3 == 1,
            F.expr("array(array('new', 'a'))")).otherwise(F.expr("cast(array() as array<array<string>>)"))
    r = t.part.select("p_partkey", T.richer(F.expr("array(array('old', 'x'))"), new).alias("r"))
    return r.select("p_partkey", F.size("r").alias("n_rows"), F.col("r")[0][0].alias("source"))


@query(f"""with w as (select a.label, a.vec_id, {_DOT} as s, row_number() over (partition by a.label order by a.vec_id desc) as rn from embeddings a
        join embeddings b on a.vec_id = b.vec_id)
    select label, vec_id, round(s, 4) as norm from w where rn = 1""")  # fmt: skip
def archive_vector(t):
    """An idle session leaves the vector of its last summary in the user's profile."""
    from docloom.functions import vectors as V

    last = R.top_k(t.embeddings, ["label"], 1, F.col("vec_id").desc())
    return last.select("label", "vec_id", F.round(V.dot("embedding", "embedding"), 4).alias("norm"))


@query("""with v as (select doc_id, source, concat(lang, '_', doc_id % 40, '.txt') as filename, md5(text) as m from documents where doc_id % 20 not
        in (0, 2, 3))
    select a.doc_id, coalesce(max(case when b.m <> a.m then 1 end), 0) = 1 as superseded
    from v a left join v b on a.source = b.source and a.filename = b.filename and b.doc_id > a.doc_id group by a.doc_id""")  # fmt: skip
def supersede(t):
    """Finished documents of which a later version (same collection and file name, other content) is there."""
    d = t.fx_documents.where(F.col("status").isin("done", "partial")).withColumn("filename",
            F.concat("lang", F.lit("_"), (F.col("doc_id") % 40).cast("string"), F.lit(".txt")))
    # from the last one back: a frame that grows row by row, where one that shrinks is computed anew for each row
    w = Window.partitionBy("tenant_id", "collection", "filename").orderBy(F.col("doc_id").desc()).rowsBetween(Window.unboundedPreceding, -1)
    other = (F.min("file_md5").over(w) != F.col("file_md5")) | (F.max("file_md5").over(w) != F.col("file_md5"))
    return d.select("doc_id", F.coalesce(other, F.lit(False)).alias("superseded"))


@query("select c_custkey, c_name, c_mktsegment, trim(cast(c_acctbal as varchar)) as balance from customer")
def read_csv_sheet(t):
    """A table written as CSV files and read back by the reader, all cells as strings."""
    path = tables.new_path(t.spark, "csv")
    rows = t.customer.select(F.col("c_custkey").cast("string"), "c_name", "c_mktsegment",
            F.concat(F.lit("  "), F.col("c_acctbal").cast("string"), F.lit(" ")).alias("b"))
    rows.write.option("header", "false").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
    back = P.read_csv_sheet(t.spark, path)
    return back.select(F.col("c0").cast("long").alias("c_custkey"), F.col("c1").alias("c_name"), F.col("c2").alias("c_mktsegment"),
            F.col("c3").alias("balance"))
