"""Queries over sessions and memory: history, topics, feedback, archives, limits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions import vectors as V
from docloom.operators.retrieval import top_k
from docloom.streaming import jobs

from .base import query
from .metadata import NOW


@query("""select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn desc, role, text) as rn from
        conversations) where rn <= 4""")
def short_term_memory(t):
    """The last four messages of each session."""
    return top_k(t.conversations, ["conv_id"], 4, F.col("turn").desc(), F.col("role"), F.col("text"), rank="rn").select("conv_id", "turn", "role")


@query("""select conv_id, turn, prev as question from (select *, lag(case when role = 'user' then text end) over (partition by conv_id order by
        turn, role, text) as prev from conversations) where role = 'assistant'""")
def feedback_context(t):
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    c = t.conversations.withColumn("question", F.lag(F.when(F.col("role") == "user", F.col("text"))).over(w))
    return c.where("role = 'assistant'").select("conv_id", "turn", "question")


_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda x: cast(x[1] as double) * x[2]))"


@query(f"""select vec_id, coalesce({_DOT.format('prev', 'embedding')} < 0.45, false) as shifted from (select vec_id, embedding, lag(embedding) over
        (partition by label order by vec_id) as prev from embeddings)""")
def topic_shift(t):
    """Has the topic changed from the question before?"""
    w = Window.partitionBy("label").orderBy("vec_id")
    e = t.embeddings.withColumn("prev", F.lag("embedding").over(w))
    return e.select("vec_id", F.coalesce(V.dot("prev", "embedding") < 0.45, F.lit(False)).alias("shifted"))


@query(f"""select q, vec_id from (select a.vec_id as q, b.vec_id, row_number() over (partition by a.vec_id order by
        round({_DOT.format('a.embedding', 'b.embedding')}, 6) desc, b.vec_id) as rn from embeddings a join embeddings b on a.label = b.label and
        b.vec_id < a.vec_id
    where a.vec_id % 20 = 0 and {_DOT.format('a.embedding', 'b.embedding')} >= 0.45) where rn <= 2""")  # fmt: skip
def related_history(t):
    """The two earlier summaries of the same user nearest to a question."""
    q = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), "label", F.col("embedding").alias("v"))
    pairs = t.embeddings.join(q, "label").where("vec_id < q").select("q", "vec_id", V.dot("v", "embedding").alias("s")).where("s >= 0.45")
    return top_k(pairs, ["q"], 2, F.round("s", 6).desc(), F.col("vec_id")).select("q", "vec_id")


@query("""select conv_id, string_agg(topic, ',' order by turn) as chain from (select conv_id, turn, substr(text, 1, 1) as topic, row_number() over
        (partition by conv_id order by turn desc) as rn from (select conv_id, turn, min(text) as text from conversations group by 1, 2)) where rn <=
        10 group by conv_id""")
def topic_chain(t):
    c = t.conversations.groupBy("conv_id", "turn").agg(F.substring(F.min("text"), 1, 1).alias("topic"))
    last = top_k(c, ["conv_id"], 10, F.col("turn").desc())
    return last.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "topic"))), lambda x: x["topic"]),
            ",").alias("chain"))


@query(f"""select user_id, max(ts) as last_seen from events group by user_id having max(ts) >= timestamp '{NOW}' - interval 7 day order by last_seen
        desc, user_id limit 50""")
def sessions_list(t):
    s = t.events.groupBy("user_id").agg(F.max("ts").alias("last_seen")).where(f"last_seen >= timestamp_ntz '{NOW}' - interval 7 days")
    return s.orderBy(F.col("last_seen").desc(), "user_id").limit(50)


@query("""with x as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 120 minute then 0 else
        1 end as b from events),
    y as (select user_id, ts, sum(b) over (partition by user_id order by ts rows between unbounded preceding and current row) as s from x) select
        user_id, min(ts) as first_ts, count(*) as n from y group by user_id, s""")  # fmt: skip
def session_archive(t):
    """Sessions that end after two idle hours."""
    e = t.events.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return jobs.sessions(e, "120 minutes").select("user_id", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"), "n")


@query(f"""select event_id, ts < timestamp '{NOW}' - interval 48 hour as session_over, ts < timestamp '{NOW}' - interval 2 hour as ephemeral_over
        from events""")
def ttl_expired(t):
    old = lambda h: F.col("ts") < F.expr(f"timestamp_ntz '{NOW}' - interval {h} hours")
    return t.events.select("event_id", old(48).alias("session_over"), old(2).alias("ephemeral_over"))


@query("""select task_id, n, case least(n - 1, 2) when 0 then 60 when 1 then 300 else 900 end as wait from (select event_id as task_id, cast(1 +
        event_id % 5 as int) as n from events where event_type = 'error')""")
def retry_backoff(t):
    e = t.events.where("event_type = 'error'").select(F.col("event_id").alias("task_id"), (1 + F.col("event_id") % 5).cast("int").alias("n"))
    return e.withColumn("wait", F.element_at(F.array(F.lit(60), F.lit(300), F.lit(900)), F.least(F.col("n"), F.lit(3))))


@query("select doc_id, arg_max(status, (created_at, task_id)) as status from fx_tasks group by doc_id")
def latest_progress(t):
    return jobs.latest_status(t.fx_tasks.select("doc_id", "status", "created_at", "task_id"))


@query("""select conv_id, right(string_agg(text, ' ' order by turn, role, text), 1200) as summary from conversations group by conv_id""")
def working_summary(t):
    """A rolling summary keeps the last 1200 characters."""
    c = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return c.select("conv_id", F.right(F.array_join(F.transform("m", lambda x: x["text"]), " "), F.lit(1200)).alias("summary"))


@query("""with recursive o as (select user_id, event_id, ts, row_number() over (partition by user_id order by ts, event_id) as rn from events),
    g as (select user_id, 0 as pos, cast([] as timestamp[]) as held, cast(null as bigint) as event_id, cast(null as boolean) as accepted from (select
        distinct user_id from o)
      union all select g.user_id, pos + 1, case when ok then list_append(live, ts) else live end, o.event_id, ok
      from g join o on o.user_id = g.user_id and o.rn = g.pos + 1, lateral (select list_filter(held, lambda x: x > ts - interval 6 hour) as live),
        lateral (select len(live) < 3 as ok))
    select user_id, event_id, accepted from g where pos > 0""")  # fmt: skip
def rate_limit(t):
    """Accepted and refused requests under a sliding window that counts accepted ones only."""
    return jobs.rate_limit(t.events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts")), limit=3, seconds=6 * 3600)


@query("select time_bucket(interval 1 day, ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def tumbling_events(t):
    e = t.events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    return jobs.tumbling(e, "1 day").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""select s as start, event_type, count(*) as n from (select event_type, unnest([time_bucket(interval 12 hour, ts), time_bucket(interval 12
        hour, ts) - interval 12 hour]) as s from events) group by 1, 2""")
def sliding_events(t):
    e = t.events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    return jobs.sliding(e, "1 day", "12 hours").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""with x as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 6 hour then 0 else 1
        end as b from events),
    y as (select user_id, ts, sum(b) over (partition by user_id order by ts rows between unbounded preceding and current row) as s from x) select
        user_id, min(ts) as first_ts, count(*) as n from y group by user_id, s""")  # fmt: skip
def session_events(t):
    e = t.events.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return jobs.sessions(e, "6 hours").select("user_id", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"), "n")


# -- rules that only the design documents name ------------------------------------------------------------------------


@query("""select doc_id, round(greatest(0.1, least(1.0, 3.0 * len(regexp_extract_all(text, '[A-Za-z]+')) / length(text))), 6) as density from
        documents""")
def density_variant(t):
    n = F.size(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)))
    return t.documents.select("doc_id", F.round(F.greatest(F.lit(0.1), F.least(F.lit(1.0), 3.0 * n / F.char_length("text"))), 6).alias("density"))


@query("select doc_id, regexp_matches(text, '[。.!?！？]$') as complete from documents")
def sentence_complete(t):
    return t.documents.select("doc_id", F.col("text").rlike("[。.!?！？]\\z").alias("complete"))


@query("""select doc_id, cast(count(*) as bigint) as pages, count_if(length(trim(s)) < 50) as blank from (select doc_id, unnest(string_split(text,
        '\n')) as s from documents) group by doc_id""")
def blank_pages(t):
    p = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("s"))
    return p.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if(F.char_length(F.trim("s")) < 50).alias("blank"))


@query("""select doc_id, case when q < 0.3 then 'reject' when q < 0.6 then 'warn' else 'accept' end as action from (select doc_id, (doc_id % 10) /
        10.0 as q from documents)""")
def quality_action(t):
    q = F.col("doc_id") % 10 / 10.0
    return t.documents.select("doc_id", F.when(q < 0.3, "reject").when(q < 0.6, "warn").otherwise("accept").alias("action"))


@query("""select doc_id, g, string_agg(s, ' ' order by i) as text from (select doc_id, i, s, sum(case when length(s) < 20 and i > 1 then 0 else 1
        end) over (partition by doc_id order by i) as g from
    (select doc_id, unnest(range(1, 1 + len(string_split(text, '\n')))) as i, unnest(string_split(text, '\n')) as s from documents)) group by doc_id,
        g""")  # fmt: skip
def merge_short_chunks(t):
    """Chunks that are too short join the one before."""
    w = Window.partitionBy("doc_id").orderBy("i")
    p = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "s"))
    fresh = F.when((F.char_length("s") < 20) & (F.col("i") > 0), 0).otherwise(1)
    p = p.withColumn("b", fresh).withColumn("g", F.sum("b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return p.groupBy("doc_id", "g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]), " ").alias("text"))


@query("select doc_id, cast(unnest(range(0, greatest(1, len(string_split(text, ' ')) - 50), 462)) as int) as start from documents")
def fixed_window_chunks(t):
    """Windows of 512 words that overlap by 50."""
    n = F.size(F.split("text", " "))
    return t.documents.select("doc_id", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), n - 50) - 1, F.lit(462))).alias("start"))


@query("""select qid, coalesce(explicit, implicit) as since from (select qid, case when qid % 3 = 0 then date '2024-05-01' end as explicit, case
        when qid % 2 = 0 then date '2023-01-01' end as implicit from fx_questions)""")
def implicit_metadata(t):
    """Explicit conditions win, implicit ones (here: last year) fill gaps."""
    now = F.lit("2024-01-30").cast("date")
    explicit = F.when(F.col("qid") % 3 == 0, F.lit("2024-05-01").cast("date"))
    said = F.when(F.col("qid") % 2 == 0, "what happened last year").otherwise("what happened")
    implicit = F.when(said.rlike("(?i)last year|去年"), F.trunc(F.add_months(now, -12), "year"))
    return t.fx_questions.select("qid", F.coalesce(explicit, implicit).alias("since"))


@query("""select avg(len(list_intersect(ret, rel)) / len(rel)) as recall from (select [qid, qid + 1, qid + 2] as ret, [qid + 1, qid + 5] as rel from
        fx_questions)""")
def recall_by_ids(t):
    q = F.col("qid")
    ret, rel = F.array(q, q + 1, q + 2), F.array(q + 1, q + 5)
    return t.fx_questions.agg(F.avg(F.size(F.array_intersect(ret, rel)) / F.size(rel)).alias("recall"))
