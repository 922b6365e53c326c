"""Queries over the service around the document base: filters, routes, ports, queues, metrics, objects."""

from __future__ import annotations

import time

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions import ports
from docloom.functions import text as T
from docloom.operators import retrieval as R
from docloom.operators import routes, tables
from docloom.sources import objects
from docloom.streaming import jobs, queue

from .base import query
from .metadata import NOW


@query("""select chunk_id from fx_chunks join fx_documents d using (doc_id) where d.tenant_id = 'default' and d.collection in ('web', 'books',
        'src1', 'src2')
      and (d.roles_csv = '' or list_has_any(string_split(d.roles_csv, ','), ['engineer'])) and doc_id in (select user_id from events)""")  # fmt: skip
def fulltext_filter(t):
    """What a search may see: tenant, collections, roles, and the ids that the metadata filter left."""
    seen = R.visible(t.fx_documents, "default", ("web", "books", "src1", "src2"), ("engineer",)).select("doc_id")
    ids = t.events.select(F.col("user_id").alias("doc_id")).distinct()
    return t.fx_chunks.join(seen, "doc_id", "left_semi").join(ids, "doc_id", "left_semi").select("chunk_id")


@query("""select doc_id, 'tenant_id == "default" and array_contains_any(allowed_roles, ["' || string_agg(r, '", "' order by i) || '"])' as
        expression from
    (select doc_id, unnest(range(0, 2)) as i, unnest([concat('role', doc_id % 5), concat('x', lang)]) as r from documents) group by doc_id""")  # fmt: skip
def vector_filter(t):
    """The filter expression of a vector store: characters that could end a string are taken out of roles."""
    roles = F.array(F.concat(F.lit('ro"le'), (F.col("doc_id") % 5).cast("string")), F.concat(F.lit("x];"), "lang"))
    return t.documents.select("doc_id", R.vector_filter(F.lit("default"), roles).alias("expression"))


@query("""select event_type as route, event_id, cast(rn as int) as rank from (select *, row_number() over (partition by event_type order by value
        desc, event_id) as rn from events) where rn <= 3 and event_type in ('view', 'click')""")
def route_isolation(t):
    """Routes side by side as jobs of their own: one that cannot be planned, one that fails in a task and one that sleeps past its limit
    are left out; the others answer."""

    def of(kind):
        rows = t.events.where(F.col("event_type") == kind).select(F.col("event_type").alias("route"), "event_id", "value")
        return R.top_k(rows, ["route"], 3, F.col("value").desc(), F.col("event_id")).select("route", "event_id", "rank")

    def broken():
        return of("view").withColumn("route", F.when(F.col("event_id") >= 0, F.raise_error(F.lit("lost"))).otherwise(F.col("route")))

    @F.pandas_udf("string")
    def slowly(routes: pd.Series) -> pd.Series:
        time.sleep(60)
        return routes

    plans = {"view": lambda: of("view"), "graph": lambda: t.events.select("no such column"), "broken": broken,
            "slow": lambda: of("view").withColumn("route", slowly("route")), "click": lambda: of("click")}
    found, failed = routes.gather(t.spark, plans, {"view": 600, "click": 600, "broken": 600, "slow": 1})
    if set(failed) != {"graph", "broken", "slow"}:
        raise RuntimeError(f"routes absent: {failed}")
    return found


@query("""select doc_id, list_transform(range(0, 8), lambda k: cast(len(list_filter(h, lambda x: x = k)) as double)) as v from (select doc_id,
    list_transform(string_split(text, ' '), lambda w: coalesce(list_sum(list_transform(case when w = '' then [] else regexp_extract_all(w, '.', 0,
        's') end, lambda c: ord(c))), 0) % 8) as h from documents)""")  # fmt: skip
def embed_port(t):
    """Texts through the embedding port with its default model."""
    return t.documents.select("doc_id", ports.embedder(ports.word_buckets)("text").alias("v"))


@query(f"""select task_id, cast((rn - 1) % 4 as int) as worker, cast((rn - 1) // 4 as bigint) as turn from (select task_id, row_number() over (order
        by created_at, task_id) as rn
    from fx_tasks where status in ('parsing', 'retrying') and created_at >= timestamp '{NOW}' - interval 72 hour)""")  # fmt: skip
def queue_claim(t):
    """Unfinished tasks of the last days dealt to four workers in order of age."""
    live = t.fx_tasks.where(F.col("status").isin("parsing", "retrying") & (F.col("created_at") >= F.expr(f"timestamp_ntz '{NOW}' - interval 72 hours")))
    n = F.row_number().over(Window.orderBy("created_at", "task_id")) - 1
    return live.select("task_id", n.alias("n")).select("task_id", (F.col("n") % 4).cast("int").alias("worker"), F.floor(F.col("n") / 4).alias("turn"))


@query()
def queue_states(t):
    """The queue as a stream: events as moves of one task per user; leases that run out, back-offs and stale tasks come from timers.

    No SQL: a state machine with timers. Tests hold it against a second by second simulation.
    """
    kinds = {"signup": "submit", "click": "submit", "view": "claim", "error": "error", "purchase": "done"}
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), F.col("event_type"))
    events = jobs.stream(t.spark, f"{t.dir}/events.parquet").select(F.col("user_id").alias("task_id"), "event_id", "ts", kind.alias("kind"))
    out, checkpoint = tables.new_path(t.spark, "moves"), tables.new_path(t.spark, "moves-checkpoint")
    jobs.run_once(queue.states(events), checkpoint, lambda rows, n: rows.write.mode("overwrite").parquet(f"{out}/{n}"))
    return t.spark.read.schema(queue.MOVES).parquet(f"{out}/*")


@query(f"""select job, last_run + to_seconds(every) as due, last_run + to_seconds(every) <= timestamp '{NOW}' as is_due from (values ('archive', 900,
        'view'), ('feedback', 900, 'click'), ('consistency', 3600, 'purchase'), ('expiry', 600, 'error')) j(job, every, kind)
    join (select event_type as kind, max(ts) as last_run from events group by 1) using (kind)""")  # fmt: skip
def jobs_due(t):
    """Periodic jobs with the time they are due again."""
    jobs = t.spark.createDataFrame([("archive", 900, "view"), ("feedback", 900, "click"), ("consistency", 3600, "purchase"),
            ("expiry", 600, "error")], "job string, every int, kind string")
    last = t.events.groupBy(F.col("event_type").alias("kind")).agg(F.max("ts").alias("last_run"))
    due = F.expr("last_run + make_dt_interval(0, 0, 0, every)")
    return jobs.join(last, "kind").select("job", due.alias("due"), (due <= F.expr(f"timestamp_ntz '{NOW}'")).alias("is_due"))


@query("""select concat('docloom_step_seconds_bucket{step="', event_type, '",le="', le, '"} ', count_if(value <= le)) as line from events, (select
        unnest([1, 5, 20, 100]) as le) group by event_type, le
    union all select concat('docloom_step_seconds_count{step="', event_type, '"} ', count(*)) from events group by event_type""")  # fmt: skip
def metrics_text(t):
    """Histograms in the text format that collectors of metrics read."""
    return R.exposition(t.events.select(F.col("event_type").alias("step"), "value"), "docloom_step_seconds", "step", "value", (1, 5, 20, 100))


@query("""with w as (select doc_id, unnest(string_split(text, ' ')) as w, generate_subscripts(string_split(text, ' '), 1) as i from documents),
    f as (select doc_id, w, min(i) as i from w group by 1, 2) select doc_id, string_agg(w, ' ' order by i) as words from f group by doc_id""")
def ordered_distinct(t):
    """Words of a text, each once, in order of first use."""
    return t.documents.select("doc_id", F.array_join(F.array_distinct(F.split("text", " ")), " ").alias("words"))


@query("""select vec_id, list_aggregate(list_transform(embedding, lambda x: round(cast(x as double) * 10 * (vec_id % 4))), 'stddev_pop') < 3 as
        blank from embeddings""")
def blank_image(t):
    """Is a picture one flat tone? Here vectors stand for the grey values of pixels."""
    pixels = F.transform("embedding", lambda x: F.round(x.cast("double") * 10 * (F.col("vec_id") % 4)))
    return t.embeddings.select("vec_id", T.flat(pixels).alias("blank"))


@query("""select doc_id, not (doc_id % 5 in (1, 2, 3)) as ok from documents""")
def object_keys(t):
    """Keys that stay below the store's root."""
    m = F.col("doc_id") % 5
    key = F.when(m == 1, F.lit("/etc/x")).when(m == 2, F.lit("a/../../x")).when(m == 3, F.lit(".")).when(m == 4,
            F.lit("a/..b/c.txt")).otherwise(F.concat("source", F.lit("/"), "lang"))
    return t.documents.select("doc_id", objects.key_ok(key).alias("ok"))
