"""Queries over metadata: listing, permissions, versions, batches, feedback, consistency, upserts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.operators import stores as S
from docloom.operators import tables
from docloom.operators.retrieval import top_k

from .base import query

LIVE = ("done", "partial")
#: The user of the examples, and the moment that counts as now.
USER_ROLES = ("engineer",)
NOW = "2024-01-30 00:00:00"


def roles(c="roles_csv"):
    return F.filter(F.split(F.col(c), ","), lambda r: r != "")


def may_read(doc_roles, user_roles, empty_roles_see_all: bool = False):
    """Documents without roles are public; others need a role in common. Users without roles see public ones, or all by the flag."""
    if not user_roles:
        return F.lit(True) if empty_roles_see_all else F.size(doc_roles) == 0
    return (F.size(doc_roles) == 0) | F.arrays_overlap(doc_roles, F.array(*map(F.lit, user_roles)))


def md5_aliases(docs, chosen):
    """Documents chosen, and those with the same content of the same tenant."""
    keys = chosen.select("tenant_id", "file_md5").distinct()
    return docs.join(keys, ["tenant_id", "file_md5"], "left_semi")


def prefilter(docs, chunks, collections, file_types, since, until, user_roles, section=None):
    """Chunk ids that the metadata conditions leave: live documents and their aliases, readable by the user, in a section."""
    chosen = docs.where(F.col("status").isin(*LIVE) & F.col("collection").isin(*collections) & F.col("file_type").isin(*file_types))
    chosen = chosen.where(F.col("created_on").between(F.lit(since).cast("date"), F.lit(until).cast("date")) & may_read(roles(), user_roles))
    ids = md5_aliases(docs.where(F.col("status").isin(*LIVE) & may_read(roles(), user_roles)), chosen).select("doc_id")
    out = chunks.join(ids, "doc_id", "left_semi")
    return out.where(F.col("section").startswith(section)) if section else out


_ROLE_SQL = "(roles_csv = '' or list_contains(string_split(roles_csv, ','), 'engineer'))"


@query(f"""with chosen as (select * from fx_documents where status in ('done','partial') and collection in ('src0','src1','src2') and file_type in
        ('txt','md','html')
      and created_on between date '2024-02-01' and date '2024-10-31' and {_ROLE_SQL}),
    ids as (select d.doc_id from fx_documents d where status in ('done','partial') and {_ROLE_SQL} and exists (select 1 from chosen c where
        c.tenant_id = d.tenant_id and c.file_md5 = d.file_md5))
    select chunk_id, doc_id from fx_chunks where doc_id in (select doc_id from ids) and section like 'e%'""")  # fmt: skip
def prefilter_whitelist(t):
    return prefilter(t.fx_documents, t.fx_chunks, ("src0", "src1", "src2"), ("txt", "md", "html"), "2024-02-01", "2024-10-31", USER_ROLES,
            "e").select("chunk_id", "doc_id")


@query(f"select doc_id, roles_csv from fx_documents where {_ROLE_SQL}")
def role_filter(t):
    return t.fx_documents.where(may_read(roles(), USER_ROLES)).select("doc_id", "roles_csv")


@query("select chunk_id from fx_chunks where section like 'e%'")
def section_prefix(t):
    return t.fx_chunks.where(F.col("section").startswith("e")).select("chunk_id")


@query("select distinct collection from fx_documents where status in ('done','partial') and collection <> '__ephemeral__'")
def list_collections(t):
    return t.fx_documents.where(F.col("status").isin(*LIVE) & (F.col("collection") != "__ephemeral__")).select("collection").distinct()


_PERMISSIONS = [("admin", "*"), ("engineer", "src1"), ("engineer", "src2"), ("viewer", "src2"), ("viewer", "src3"), ("guest", "default")]
_PERMISSIONS_SQL = "(values " + ",".join(f"('{a}','{b}')" for a, b in _PERMISSIONS) + ") p(role, collection)"


def permitted(users, permissions, known):
    """(user_id, collection): union over roles; a wildcard gives every known collection, a user without known role `default`."""
    got = users.select("user_id", F.explode("roles").alias("role")).join(tables.small(permissions), "role")
    wild = got.groupBy("user_id").agg(F.bool_or(F.col("collection") == "*").alias("all"))
    named = got.join(wild, "user_id").where("not `all`").select("user_id", "collection")
    all_of_them = known.agg(F.collect_set("collection").alias("_c"))  # one row, as long as the list of collections
    every = wild.where("`all`").select("user_id").crossJoin(F.broadcast(all_of_them)).select("user_id", F.explode("_c").alias("collection"))
    none = users.select("user_id").join(wild.select("user_id"), "user_id", "left_anti").select("user_id", F.lit("default").alias("collection"))
    return named.unionByName(every).unionByName(none).distinct()


@query(f"""with u as (select distinct user_id, case user_id % 4 when 0 then 'admin' when 1 then 'engineer' when 2 then 'viewer,engineer' else
        'stranger' end as roles_csv from events),
    g as (select user_id, p.collection from u, {_PERMISSIONS_SQL} where list_contains(string_split(roles_csv, ','), p.role)),
    w as (select user_id, bool_or(collection = '*') as a from g group by user_id), k as (select distinct source as collection from documents)
    select user_id, collection from g join w using (user_id) where not a union select user_id, k.collection from w, k where a
    union select user_id, 'default' from u where user_id not in (select user_id from g)""")  # fmt: skip
def rbac_collections(t):
    m = F.col("user_id") % 4
    csv = F.when(m == 0, "admin").when(m == 1, "engineer").when(m == 2, "viewer,engineer").otherwise("stranger")
    users = t.events.select("user_id").distinct().select("user_id", F.split(csv, ",").alias("roles"))
    permissions = t.spark.createDataFrame(_PERMISSIONS, "role string, collection string")
    return permitted(users, permissions, t.documents.select(F.col("source").alias("collection")).distinct())


@query("""with x as (select qid, case qid % 3 when 0 then ['src1','src2'] when 1 then ['src9'] else [] end as asked, ['src1','src3'] as allowed from
        fx_questions),
    y as (select qid, asked, allowed, list_sort(list_intersect(asked, allowed)) as common from x)
    select qid, array_to_string(case when len(common) = 0 then allowed else common end, ',') as collections from y""")  # fmt: skip
def merge_filters(t):
    asked = F.when(F.col("qid") % 3 == 0, F.array(F.lit("src1"), F.lit("src2"))).when(F.col("qid") % 3 == 1,
            F.array(F.lit("src9"))).otherwise(F.array().cast("array<string>"))
    allowed = F.array(F.lit("src1"), F.lit("src3"))
    both = F.array_sort(F.array_intersect(asked, allowed))
    return t.fx_questions.select("qid", F.array_join(F.when(F.size(both) == 0, allowed).otherwise(both), ",").alias("collections"))


@query("""select doc_id, filename, status, created_on from fx_documents where tenant_id = 'default' and status = 'done' order by created_on desc,
        doc_id limit 25 offset 50""")
def list_documents_page(t):
    d = t.fx_documents.where("tenant_id = 'default' and status = 'done'")
    return d.orderBy(F.col("created_on").desc(), "doc_id").offset(50).limit(25).select("doc_id", "filename", "status", "created_on")


@query("""select doc_id, filename, coalesce(created_on, date '1970-01-01') as shown_on from fx_documents where status not in
        ('deleted','superseded') and contains(lower(filename), 'doc_1')
    order by shown_on desc, doc_id limit 20""")  # fmt: skip
def docs_tab(t):
    d = t.fx_documents.where(~F.col("status").isin("deleted", "superseded") & F.lower("filename").contains("doc_1"))
    d = d.select("doc_id", "filename", F.coalesce("created_on", F.lit("1970-01-01").cast("date")).alias("shown_on"))
    return d.orderBy(F.col("shown_on").desc(), "doc_id").limit(20)


@query(f"select task_id, status from fx_tasks where status in ('parsing','retrying') and created_at > timestamp '{NOW}' - interval 24 hour")
def incomplete_tasks(t):
    return t.fx_tasks.where(F.col("status").isin("parsing",
            "retrying") & (F.col("created_at") > F.expr(f"timestamp_ntz '{NOW}' - interval 24 hours"))).select("task_id", "status")


@query(f"select feedback_id, chunk_ref from fx_feedback where feedback = 'down' and ts >= timestamp '{NOW}' - interval 7 day")
def negative_feedback(t):
    return t.fx_feedback.where((F.col("feedback") == "down") & (F.col("ts") >= F.expr(f"timestamp_ntz '{NOW}' - interval 7 days"))).select("feedback_id", "chunk_ref")


@query("select file_md5, arg_max(doc_id, (created_on, doc_id)) as doc_id from fx_documents where status = 'done' group by file_md5")
def find_by_md5(t):
    return t.fx_documents.where("status = 'done'").groupBy("file_md5").agg(F.max_by("doc_id", F.struct("created_on", "doc_id")).alias("doc_id"))


@query("""with up as (select doc_id + 1000000 as new_id, md5(text) as file_md5, source as collection, case doc_id % 3 when 0 then '' when 1 then
        'admin' else 'engineer,admin' end as r,
      case doc_id % 3 when 0 then 'auto' when 1 then 'ask' else 'force' end as mode, case when doc_id % 5 = 0 then 'v2' else 'v1' end as fp from
        documents),
    old as (select file_md5, arg_max(doc_id, doc_id) as old_id, arg_max(collection, doc_id) as oc, arg_max(roles_csv, doc_id) as orr from fx_documents
        where status in ('done','partial') group by file_md5)
    select new_id, old_id, case when old_id is null then 'ingest' when mode = 'force' then 'ingest' when up.collection = oc and
        array_to_string(list_sort(string_split(r, ',')), ',') = array_to_string(list_sort(string_split(orr, ',')), ',') and fp = 'v1'
      then case when mode = 'ask' then 'ask' else 'skip' end when mode = 'ask' then 'ask' else 'alias' end as decision from up left join old using
        (file_md5)""")  # fmt: skip
def dedup_decision(t):
    """What to do with uploads whose content is known: same place, roles and engine fingerprint mean skip (or ask), others an alias."""
    d = t.documents
    m = F.col("doc_id") % 3
    up = d.select(
        (F.col("doc_id") + 1000000).alias("new_id"), F.md5(F.col("text").cast("binary")).alias("file_md5"), F.col("source").alias("collection"),
        F.when(m == 0, "").when(m == 1, "admin").otherwise("engineer,admin").alias("r"),
                F.when(m == 0, "auto").when(m == 1, "ask").otherwise("force").alias("mode"),
        F.when(F.col("doc_id") % 5 == 0, "v2").otherwise("v1").alias("fp"),
    )
    live = t.fx_documents.where(F.col("status").isin(*LIVE))
    old = live.groupBy("file_md5").agg(F.max("doc_id").alias("old_id"), F.max_by("collection", "doc_id").alias("oc"),
            F.max_by("roles_csv", "doc_id").alias("orr"))
    norm = lambda c: F.array_sort(F.split(c, ","))
    same = (F.col("collection") == F.col("oc")) & (norm("r") == norm("orr")) & (F.col("fp") == "v1")
    decision = (
        F.when(F.col("old_id").isNull() | (F.col("mode") == "force"), "ingest").when(same,
                F.when(F.col("mode") == "ask", "ask").otherwise("skip")).when(F.col("mode") == "ask", "ask").otherwise("alias")
    )
    return up.join(old, "file_md5", "left").select("new_id", "old_id", decision.alias("decision"))


@query("""select doc_id, cur is null or stored is not distinct from cur or n = 0 or (stored is null and not loc) as write_ok from
    (select doc_id, case when doc_id % 11 = 0 then null else 'm1' end as cur, case doc_id % 3 when 0 then null when 1 then 'm1' else 'm2' end as
        stored, doc_id % 4 as n, doc_id % 2 = 0 as loc from documents)""")  # fmt: skip
def space_verdict(t):
    """May vectors be written: unknown current space, same space, empty collection, or an untagged one under a real model."""
    m = F.col("doc_id") % 3
    x = t.documents.select(
        "doc_id", F.when(F.col("doc_id") % 11 != 0, "m1").alias("cur"), F.when(m == 1, "m1").when(m == 2, "m2").alias("stored"),
                (F.col("doc_id") % 4).alias("n"), (F.col("doc_id") % 2 == 0).alias("loc")
    )
    ok = F.col("cur").isNull() | F.col("stored").eqNullSafe(F.col("cur")) | (F.col("n") == 0) | (F.col("stored").isNull() & ~F.col("loc"))
    return x.select("doc_id", ok.alias("write_ok"))


@query("""with c as (select * from fx_documents where collection = 'src1' and status = 'done') select doc_id, filename from fx_documents d
    where exists (select 1 from c where c.file_md5 = d.file_md5 and c.tenant_id = d.tenant_id)""")  # fmt: skip
def md5_alias_expand(t):
    d = t.fx_documents
    return md5_aliases(d, d.where("collection = 'src1' and status = 'done'")).select("doc_id", "filename")


@query("""select doc_id, task_id, status from (select *, row_number() over (partition by doc_id order by coalesce(completed_at, created_at) desc,
        task_id) as rn from fx_tasks) where rn = 1""")
def last_task_by_doc(t):
    return S.latest_per_key(t.fx_tasks, ["doc_id"], F.coalesce("completed_at", "created_at").desc(), F.col("task_id")).select("doc_id", "task_id", "status")


@query("select chunk_id, c.doc_id, page_num from fx_chunks c join (select distinct chunk_ref from fx_feedback) f on c.doc_id = f.chunk_ref")
def chunks_by_ids(t):
    ids = t.fx_feedback.select(F.col("chunk_ref").cast("long").alias("doc_id")).distinct()
    return t.fx_chunks.join(ids, "doc_id").select("chunk_id", "doc_id", "page_num")


@query("""with a as (select doc_id, arg_max(status, (created_at, task_id)) as live from fx_tasks where status in ('parsing','retrying') group by
        doc_id)
    select d.doc_id, coalesce(a.live, d.status) as shown from fx_documents d left join a using (doc_id)""")  # fmt: skip
def live_status(t):
    a = t.fx_tasks.where(F.col("status").isin("parsing", "retrying")).groupBy("doc_id").agg(F.max_by("status", F.struct("created_at", "task_id")).alias("live"))
    return t.fx_documents.join(a, "doc_id", "left").select("doc_id", F.coalesce("live", "status").alias("shown"))


_HAS = "with c as (select chunk_id, doc_id, doc_id % 4 = 0 as is_parent from fx_chunks), i as (select chunk_id from fx_chunks where doc_id % 13 <> 0), v as (select chunk_id from fx_chunks where doc_id % 4 <> 0 and doc_id % 17 <> 0)"


def _stores(t):
    c = t.fx_chunks.select("chunk_id", "doc_id", (F.col("doc_id") % 4 == 0).alias("is_parent"))
    return c, c.where("doc_id % 13 <> 0"), c.where("doc_id % 4 <> 0 and doc_id % 17 <> 0")


@query(f"""{_HAS} select doc_id, count(*) as n_chunks, count_if(i.chunk_id is null) as missing_text, count_if(v.chunk_id is null and not is_parent)
        as missing_vectors, count_if(not is_parent) as n_children,
    count_if(i.chunk_id is null) > 0 or count_if(v.chunk_id is null and not is_parent) > 0.1 * count_if(not is_parent) as inconsistent
    from c left join i using (chunk_id) left join v using (chunk_id) group by doc_id""")  # fmt: skip
def consistency_check(t):
    c, i, v = _stores(t)
    return S.consistency(t.fx_documents, c, i, v)


@query(f"{_HAS} select chunk_id, doc_id from c where not is_parent and chunk_id not in (select chunk_id from v)")
def verify_missing(t):
    c, _, v = _stores(t)
    return S.missing(c.where("not is_parent"), v, "chunk_id").select("chunk_id", "doc_id")


@query(f"""{_HAS} select c.chunk_id, c.doc_id, case when x.doc_id is null then 'plain' else 'enriched' end as source from c left join (select doc_id
        from labels where quality = 1) x using (doc_id) where c.chunk_id not in (select chunk_id from i)""")
def consistency_repair(t):
    """Rows to write again from metadata, with the enrichment that is still known."""
    c, i, _ = _stores(t)
    known = t.labels.where("quality = 1").select("doc_id", F.lit("enriched").alias("e")).distinct()
    return S.missing(c, i, "chunk_id").join(known, "doc_id", "left").select("chunk_id", "doc_id", F.coalesce("e", F.lit("plain")).alias("source"))


@query("""select d.doc_id, coalesce(try_cast(json_extract_string(concat('{"source_doc_id": "', case when doc_id % 6 = 0 then cast(doc_id + 1 as
        varchar) else '' end, '"}'), '$.source_doc_id') as bigint), doc_id) as physical_id from fx_documents d""")
def resolve_physical(t):
    """The document that holds an alias's chunks, named in its report."""
    report = F.concat(F.lit('{"source_doc_id": "'), F.when(F.col("doc_id") % 6 == 0, (F.col("doc_id") + 1).cast("string")).otherwise(""), F.lit('"}'))
    source = F.expr("try_cast(get_json_object(report, '$.source_doc_id') as bigint)")
    return t.fx_documents.withColumn("report", report).select("doc_id", F.coalesce(source, "doc_id").alias("physical_id"))


@query("""with n as (select n_name as name, arg_min(r_name, n_regionkey) as canonical from nation join region on n_regionkey = r_regionkey group by
        n_name)
    select distinct upper(string_split(p_name, ' ')[1]) as mention, n.canonical from part left join n on n.name = upper(string_split(p_name, ' ')[1])""")  # fmt: skip
def entity_link(t):
    names = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("n_name").alias("mention")).agg(F.min_by("r_name",
            "n_regionkey").alias("canonical"))
    return t.part.select(F.upper(F.split("p_name", " ")[0]).alias("mention")).distinct().join(tables.small(names), "mention", "left")


@query("""select chunk_ref, count(*) as hits from fx_feedback f join fx_chunks c on c.doc_id = f.chunk_ref where feedback = 'down' group by
        chunk_ref""")
def feedback_hits(t):
    hits = t.fx_feedback.where("feedback = 'down'").groupBy("chunk_ref").agg(F.count("*").alias("hits"))
    return hits.join(t.fx_chunks.select(F.col("doc_id").alias("chunk_ref")).distinct(), "chunk_ref", "left_semi")


@query("""with h as (select chunk_ref, count(*) as hits from fx_feedback where feedback = 'down' group by chunk_ref order by hits desc, chunk_ref
        limit 200)
    select doc_id, hits, greatest(0.05, least(1.0, 0.5 - least(0.1, 0.05 * hits))) as quality from fx_chunks join h on doc_id = chunk_ref where hits
        >= 2""")  # fmt: skip
def feedback_adjust(t):
    hits = t.fx_feedback.where("feedback = 'down'").groupBy("chunk_ref").agg(F.count("*").alias("hits")).orderBy(F.col("hits").desc(), "chunk_ref").limit(200)
    q = F.greatest(F.lit(0.05), F.least(F.lit(1.0), 0.5 - F.least(F.lit(0.1), 0.05 * F.col("hits"))))
    return t.fx_chunks.join(F.broadcast(hits.where("hits >= 2")), F.col("doc_id") == F.col("chunk_ref")).select("doc_id", "hits", q.alias("quality"))


@query("""select collection, count(distinct d.doc_id) as n_docs, count(c.chunk_id) as n_chunks from fx_documents d left join (select chunk_id,
        doc_id from fx_chunks) c using (doc_id) where status in ('done','partial') group by collection""")
def collection_stats(t):
    d = t.fx_documents.where(F.col("status").isin(*LIVE)).select("doc_id", "collection")
    per = t.fx_chunks.groupBy("doc_id").agg(F.count("*").alias("n"))
    return d.join(per, "doc_id", "left").groupBy("collection").agg(F.countDistinct("doc_id").alias("n_docs"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_chunks"))


@query("select file_type as chunk_type, count(*) as n from fx_documents group by 1")
def chunks_by_type(t):
    return t.fx_documents.groupBy(F.col("file_type").alias("chunk_type")).agg(F.count("*").alias("n"))


@query("""select batch_id, total, done, failed, pending, case when total > 0 and done = total then 'done' when failed > 0 and pending = 0 then
        'partial_failed' when pending > 0 then 'running' else 'unchanged' end as status from
    (select batch_id, count(*) as total, count_if(status in ('done','partial')) as done, count_if(status = 'failed') as failed, count_if(status in
        ('parsing','retrying')) as pending from fx_tasks group by batch_id)""")  # fmt: skip
def batch_rollup(t):
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    b = t.fx_tasks.groupBy("batch_id").agg(F.count("*").alias("total"), n(*LIVE).alias("done"), n("failed").alias("failed"),
            n("parsing", "retrying").alias("pending"))
    status = F.when((F.col("total") > 0) & (F.col("done") == F.col("total")), "done").when((F.col("failed") > 0) & (F.col("pending") == 0),
            "partial_failed").when(F.col("pending") > 0, "running").otherwise("unchanged")
    return b.withColumn("status", status)


@query("""select count_if(status not in ('deleted','superseded')) as total, count_if(status in ('done','partial')) as done, count_if(status =
        'failed') as failed, count_if(status = 'deleted') as trash from fx_documents""")
def stats_cards(t):
    n = lambda c: F.count_if(c)
    s = F.col("status")
    return t.fx_documents.agg(n(~s.isin("deleted", "superseded")).alias("total"), n(s.isin(*LIVE)).alias("done"), n(s == "failed").alias("failed"),
            n(s == "deleted").alias("trash"))


@query("""select doc_id, case when n_issues > 0 then 'partial' else 'done' end as status from (select d.doc_id, count(l.doc_id) as n_issues from
        documents d left join (select doc_id from labels where quality = 0) l using (doc_id) group by d.doc_id)""")
def final_status(t):
    """partial if any write of the document failed."""
    issues = t.labels.where("quality = 0").groupBy("doc_id").agg(F.collect_list(F.lit("index_write_failed")).alias("issues"))
    bad = F.exists(F.coalesce("issues", F.array().cast("array<string>")), lambda x: x.endswith("_write_failed"))
    return t.documents.join(issues, "doc_id", "left").select("doc_id", F.when(bad, "partial").otherwise("done").alias("status"))


@query("""select collection, count_if(tok < 20 or q < 0.3) as low, count_if(not (tok < 20 or q < 0.3) and tok >= 100 and q >= 0.6) as high,
        count_if(not (tok < 20 or q < 0.3) and not (tok >= 100 and q >= 0.6)) as medium from
    (select source as collection, cast(floor(length(text) / 3.5) as int) + 1 as tok, (doc_id % 10) / 10.0 as q from documents) group by collection""")  # fmt: skip
def quality_buckets(t):
    from docloom.functions.text import token_count

    x = t.documents.select(F.col("source").alias("collection"), token_count("text").alias("tok"), (F.col("doc_id") % 10 / 10.0).alias("q"))
    low, high = (F.col("tok") < 20) | (F.col("q") < 0.3), (F.col("tok") >= 100) & (F.col("q") >= 0.6)
    return x.groupBy("collection").agg(F.count_if(low).alias("low"), F.count_if(~low & high).alias("high"), F.count_if(~low & ~high).alias("medium"))


@query("""select source, cast(avg(case when doc_id % 3 = 0 then 1 else 0 end) as double) as ratio, avg(case when doc_id % 3 = 0 then 1 else 0 end) <
        0.5 as too_low from documents group by source""")
def enrich_ratio(t):
    r = F.avg(F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0))
    return t.documents.groupBy("source").agg(r.alias("ratio")).withColumn("too_low", F.col("ratio") < 0.5)


# -- upserts and deletions -------------------------------------------------------------------------------------------


@query("""with s as (select doc_id, 'done' as status, 'newcoll' as collection from fx_documents where doc_id % 3 = 0 union all select doc_id +
        5000000, 'done', 'newcoll' from fx_documents where doc_id % 50 = 0)
    select coalesce(t.doc_id, s.doc_id) as doc_id, case when t.status = 'deleted' then 'deleted' when s.doc_id is not null then s.status else t.status
        end as status,
    case when s.doc_id is not null then s.collection else t.collection end as collection from fx_documents t full join s on t.doc_id = s.doc_id""")  # fmt: skip
def upsert_documents(t):
    d = t.fx_documents.select("doc_id", "status", "collection")
    s = d.where("doc_id % 3 = 0").select("doc_id").unionByName(d.where("doc_id % 50 = 0").select((F.col("doc_id") + 5000000).alias("doc_id")))
    return S.upsert(d, s.withColumns({"status": F.lit("done"), "collection": F.lit("newcoll")}), ["doc_id"], ["status", "collection"],
            sticky=("status", "deleted"))


@query("""with s as (select chunk_id, doc_id, 99 as page_num, cast(null as varchar) as text from fx_chunks where doc_id % 4 = 0)
    select t.chunk_id, t.doc_id, case when s.chunk_id is not null then s.page_num else t.page_num end as page_num, length(coalesce(s.text, t.text)) as
        n from fx_chunks t left join s using (chunk_id)""")  # fmt: skip
def upsert_chunks(t):
    """A null text leaves the old one. Repeated chunk ids of the source count once, the highest page first."""
    c = t.fx_chunks.select("chunk_id", "doc_id", "page_num", "text")
    s = c.where("doc_id % 4 = 0").withColumns({"page_num": F.lit(99), "text": F.lit(None).cast("string")})
    s = S.latest_per_key(s, ["chunk_id"], F.col("page_num").desc())
    return S.upsert(c, s, ["chunk_id"], ["page_num", "text"], skip_null=True).select("chunk_id", "doc_id", "page_num",
            F.char_length("text").cast("long").alias("n"))


@query("""select l_orderkey, l_linenumber, l_quantity from lineitem where l_orderkey % 5 <> 0 or l_orderkey not in (select o_orderkey from orders)
        union all select o_orderkey, 1, 0.0 from orders where o_orderkey % 5 = 0""")
def replace_by_doc(t):
    new = t.orders.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(0.0).alias("l_quantity"))
    return S.replace_by(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), new, "l_orderkey")


@query("select chunk_ref, arg_max(feedback, (ts, feedback_id)) as feedback, max(ts) as ts from fx_feedback group by chunk_ref")
def upsert_feedback(t):
    return S.latest_per_key(t.fx_feedback, ["chunk_ref"], F.col("ts").desc(), F.col("feedback_id").desc()).select("chunk_ref", "feedback", "ts")


@query("""select chunk_id, doc_id, collection, substr(text, 1, 4000) as text, '' as section_path, coalesce(nullif(roles_csv, ''), '') as roles from
        fx_chunks join (select doc_id, roles_csv from fx_documents) using (doc_id)""")
def vector_rows(t):
    """Rows of the vector table: text cut to 4000 characters, missing values as empty strings."""
    d = t.fx_documents.select("doc_id", F.array_join(roles(), ",").alias("roles"))
    return t.fx_chunks.join(d, "doc_id").select("chunk_id", "doc_id", "collection", F.substring("text", 1, 4000).alias("text"),
            F.lit("").alias("section_path"), "roles")


@query("""select distinct user_id as src, cast(json_extract_string(props, '$.k') as bigint) as dst, regexp_replace(upper(concat(event_type,
        '-rel 1')), '[^A-Z0-9_]', '', 'g') as rel from events where event_type <> 'view'""")
def graph_edges(t):
    rel = F.regexp_replace(F.upper(F.concat("event_type", F.lit("-rel 1"))), "[^A-Z0-9_]", "")
    return t.events.where("event_type <> 'view'").select(F.col("user_id").alias("src"), F.get_json_object("props", "$.k").cast("long").alias("dst"),
            rel.alias("rel")).distinct()


@query("""select doc_id, case when doc_id % 2 = 1 then 'meta' when doc_id % 3 = 1 then 'fulltext' when doc_id % 5 = 1 then 'vectors' when doc_id % 7
        = 1 then 'graph' else 'complete' end as next_stage from documents""")
def checkpoint_next(t):
    """The first store that a document's checkpoint lacks, in the order of writing."""
    done = F.struct(*[(F.col("doc_id") % m != 1).alias(n) for n, m in (("meta", 2), ("fulltext", 3), ("vectors", 5), ("graph", 7))])
    stage = F.when(~F.col("c.meta"), "meta").when(~F.col("c.fulltext"), "fulltext").when(~F.col("c.vectors"), "vectors").when(~F.col("c.graph"),
            "graph").otherwise("complete")
    return t.documents.select("doc_id", done.alias("c")).select("doc_id", stage.alias("next_stage"))


@query("""select c.chunk_id, c.doc_id from fx_chunks c where c.doc_id in (select doc_id from documents where doc_id % 2 = 0) and c.chunk_id not in
        (select chunk_id from fx_chunks where doc_id % 6 = 0)""")
def stale_chunks(t):
    """Stored chunks of documents just written that the writing did not produce."""
    c = t.fx_chunks
    written = t.documents.where("doc_id % 2 = 0").select("doc_id")
    return S.missing(c.join(written, "doc_id", "left_semi"), c.where("doc_id % 6 = 0"), "chunk_id").select("chunk_id", "doc_id")


@query("select chunk_id, doc_id from fx_chunks where doc_id not in (select doc_id from fx_documents where status = 'deleted')")
def delete_by_doc(t):
    return S.delete_by(t.fx_chunks.select("chunk_id", "doc_id"), t.fx_documents.where("status = 'deleted'"), "doc_id")


@query("""select doc_id, case when doc_id % 9 = 0 then 'deleted' else status end as status, case when doc_id % 9 = 0 and status <> 'deleted' then
        status end as prev_status from fx_documents""")
def soft_delete(t):
    hit = F.col("doc_id") % 9 == 0
    prev = F.when(hit & (F.col("status") != "deleted"), F.col("status"))
    return t.fx_documents.select("doc_id", F.when(hit, "deleted").otherwise(F.col("status")).alias("status"), prev.alias("prev_status"))


@query("""select doc_id, case when status <> 'deleted' then status when doc_id % 3 = 0 then 'partial' when file_size > 0 then 'done' else 'failed'
        end as status from fx_documents""")
def restore_docs(t):
    """Deleted documents get back the status they had, or one by whether they have content."""
    prev = F.when(F.col("doc_id") % 3 == 0, "partial")
    back = F.coalesce(prev, F.when(F.col("file_size") > 0, "done").otherwise("failed"))
    return t.fx_documents.select("doc_id", F.when(F.col("status") == "deleted", back).otherwise(F.col("status")).alias("status"))


@query("""select doc_id, exists (select 1 from fx_documents o where o.file_md5 = d.file_md5 and o.doc_id <> d.doc_id and o.status <> 'deleted') as
        keep_object from fx_documents d where status = 'deleted'""")
def purge_shared(t):
    """Documents in the trash, and whether another document still needs the stored object."""
    d = t.fx_documents
    needed = d.where("status <> 'deleted'").select("file_md5", F.lit(True).alias("k")).distinct()
    return d.where("status = 'deleted'").join(needed, "file_md5", "left").select("doc_id", F.coalesce("k", F.lit(False)).alias("keep_object"))


@query("""select coalesce(n.doc_id, o.doc_id) as doc_id, coalesce(o.version, 0) + case when n.doc_id is null then 0 else 1 end as version from
        (select doc_id, cast(1 + doc_id % 3 as int) as version from documents) o full join (select doc_id from documents where doc_id % 4 = 0) n using
        (doc_id)""")
def reingest_version(t):
    old = t.documents.select("doc_id", (1 + F.col("doc_id") % 3).cast("int").alias("version"))
    new = t.documents.where("doc_id % 4 = 0").select("doc_id", F.lit(1).alias("n"))
    return old.join(new, "doc_id", "full").select("doc_id", (F.coalesce("version", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("version"))


@query("""with staged as (select distinct md5(text) as file_md5 from documents where doc_id % 5 = 0), choice as (select distinct md5(text) as
        file_md5, 'reingest' as d from documents where doc_id % 15 = 0)
    select file_md5, coalesce(d, 'skip') as decision from staged left join choice using (file_md5)""")  # fmt: skip
def dedup_confirm(t):
    h = F.md5(F.col("text").cast("binary")).alias("file_md5")
    staged = t.documents.where("doc_id % 5 = 0").select(h).distinct()
    choice = t.documents.where("doc_id % 15 = 0").select(h, F.lit("reingest").alias("d")).distinct()
    return staged.join(choice, "file_md5", "left").select("file_md5", F.coalesce("d", F.lit("skip")).alias("decision"))


@query("""select doc_id, session, rn <= 5 and file_size <= 20000 as accepted from (select doc_id, file_size, doc_id % 40 as session, row_number()
        over (partition by doc_id % 40 order by created_on, doc_id) as rn from fx_documents)""")
def ephemeral_limits(t):
    """Of a session's files the first five are taken, none above the size limit."""
    d = t.fx_documents.withColumn("session", F.col("doc_id") % 40)
    w = Window.partitionBy("session").orderBy("created_on", "doc_id")
    return d.select("doc_id", "session", ((F.row_number().over(w) <= 5) & (F.col("file_size") <= 20000)).alias("accepted"))


@query("""select conv_id, right(concat(max(text) filter (where turn = 0), '\n[feedback] ', max(case when role = 'user' then text end)), 1200) as
        summary from conversations group by conv_id""")
def feedback_note(t):
    """A note appended to a summary of which the last 1200 characters stay."""
    first = F.max(F.when(F.col("turn") == 0, F.col("text")))
    note = F.max(F.when(F.col("role") == "user", F.col("text")))
    return t.conversations.groupBy("conv_id").agg(F.expr("1").alias("_"),
            F.concat(F.coalesce(first, F.lit("")), F.lit("\n[feedback] "), F.coalesce(note, F.lit(""))).alias("s")).select("conv_id",
                    F.right("s", F.lit(1200)).alias("summary"))


@query("""with w as (select chunk_id, doc_id, page_num, row_number() over (order by seq is null, seq, page_num, chunk_id) as pos from fx_chunks
        where collection = 'src3' order by pos limit 20 offset 10) select * from w""")
def chunk_page(t):
    c = t.fx_chunks.where("collection = 'src3'").orderBy(F.col("seq").isNull(), "seq", "page_num", "chunk_id").offset(10).limit(20)
    pos = F.row_number().over(Window.orderBy(F.col("seq").isNull(), "seq", "page_num", "chunk_id")) + 10  # over one page of 20 rows
    return c.select("chunk_id", "doc_id", "page_num", pos.alias("pos"))


@query("""select doc_id, chunk_id, cast(row_number() over (partition by section order by seq is null, seq, page_num, chunk_id) as int) as pos from
        fx_chunks""")
def chunk_order(t):
    w = Window.partitionBy("section").orderBy(F.col("seq").isNull(), "seq", "page_num", "chunk_id")
    return t.fx_chunks.select("doc_id", "chunk_id", F.row_number().over(w).alias("pos"))


@query("""select chunk_id, collection from (select chunk_id, collection, is_parent, any_parent, row_number() over (partition by collection order by
        page_num, chunk_id) as rn from
    (select chunk_id, collection, page_num, doc_id % 40 = 0 as is_parent, bool_or(doc_id % 40 = 0) over (partition by collection) as any_parent from
        fx_chunks) where is_parent or not any_parent) where rn <= 500""")  # fmt: skip
def doc_preview(t):
    """Parents where there are any, else all chunks; 500 at most."""
    c = t.fx_chunks.withColumn("is_parent", F.col("doc_id") % 40 == 0)
    c = c.withColumn("any_parent", F.bool_or("is_parent").over(Window.partitionBy("collection"))).where("is_parent or not any_parent")
    return top_k(c, ["collection"], 500, F.col("page_num"), F.col("chunk_id")).select("chunk_id", "collection")


@query("""select chunk_id, doc_id from (select chunk_id, doc_id, collection, row_number() over (partition by collection order by md5(chunk_id),
        chunk_id) as rn from fx_chunks) where rn <= 6""")
def verify_sample(t):
    """Six chunks per collection to verify, picked by hash."""
    return top_k(t.fx_chunks, ["collection"], 6, F.md5(F.col("chunk_id").cast("binary")), F.col("chunk_id")).select("chunk_id", "doc_id")


@query("""select task_id, round(case status when 'parsing' then least(1.0, 0.05 + 0.25 * (task_id % 10) / 10.0) when 'done' then 1.0 when 'partial'
        then 1.0 when 'failed' then 1.0 else 0.0 end, 6) as progress from fx_tasks""")
def task_progress(t):
    s = F.col("status")
    p = F.when(s == "parsing", F.least(F.lit(1.0), 0.05 + 0.25 * (F.col("task_id") % 10) / 10.0)).when(s.isin("done", "partial", "failed",
            "superseded", "deleted"), 1.0)
    p = p.when(s == "chunking", 0.35).when(s == "embedding", 0.6).when(s == "writing", 0.85).otherwise(0.0)
    return t.fx_tasks.select("task_id", F.round(p, 6).alias("progress"))


@query("""select doc_id, concat('检索块质量：高质 ', doc_id % 7, ' / 中质 ', doc_id % 5, ' / 低质 ', doc_id % 3, case when doc_id % 4 = 0 then '；写入失败库 1' else
        '' end) as summary from documents""")
def quality_summary(t):
    d = F.col("doc_id")
    text = F.concat(F.lit("检索块质量：高质 "), d % 7, F.lit(" / 中质 "), d % 5, F.lit(" / 低质 "), d % 3, F.when(d % 4 == 0, "；写入失败库 1").otherwise(""))
    return t.documents.select("doc_id", text.alias("summary"))


@query("select event_id, strftime(ts + interval 8 hour, '%Y-%m-%d %H:%M') as shown from events")
def fmt_local(t):
    """UTC times shown in local time."""
    local = F.from_utc_timestamp(F.to_timestamp(F.col("ts").cast("string")), "Asia/Shanghai")
    return t.events.select("event_id", F.date_format(local, "yyyy-MM-dd HH:mm").alias("shown"))


@query("select event_id, case when event_id % 3 = 0 then null else cast(ts as date) end as d from events")
def iso_dates(t):
    """ISO dates; what is none is ignored."""
    raw = F.when(F.col("event_id") % 3 == 0, "not a date").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return t.events.withColumn("raw", raw).select("event_id", F.expr("try_to_timestamp(raw, 'yyyy-MM-dd')").cast("date").alias("d"))


@query("select source, concat('v1|local|', lang, '|', 64, '|text') as tag, lang as model from (select distinct source, lang from documents)")
def space_tag(t):
    d = t.documents.select("source", "lang").distinct().select("source",
            F.concat_ws("|", F.lit("v1"), F.lit("local"), "lang", F.lit("64"), F.lit("text")).alias("tag"))
    return d.select("source", "tag", F.split("tag", "\\|")[2].alias("model"))
