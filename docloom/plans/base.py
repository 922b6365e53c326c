"""Registry of queries, and views shaped like a document base over the raw tables, for Spark and for DuckDB."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: DuckDB text of the derived views.
VIEWS = {
    "fx_documents": """select doc_id, 'default' as tenant_id, source as collection, concat('doc_', doc_id, '.', ft) as filename, ft as file_type, n_chars as file_size,
        md5(text) as file_md5, case when doc_id % 20 = 0 then 'failed' when doc_id % 20 = 1 then 'partial' when doc_id % 20 = 2 then 'deleted' when doc_id % 20 = 3 then 'superseded' else 'done' end as status,
        case doc_id % 3 when 0 then '' when 1 then 'admin' else 'admin,engineer' end as roles_csv, date '2024-01-01' + cast(doc_id % 365 as int) as created_on, text, lang
        from (select *, case doc_id % 4 when 0 then 'txt' when 1 then 'md' when 2 then 'html' else 'pdf' end as ft from documents)""",
    "fx_chunks": """select substr(sha256(concat('default:', doc_id, ':0:', substr(sha256(text), 1, 8))), 1, 32) as chunk_id, doc_id, lang as section, cast(0 as int) as seq, text,
        cast(1 + doc_id % 9 as int) as page_num, source as collection from documents""",
    "fx_tasks": """select event_id as task_id, user_id as doc_id, event_id % 50 as batch_id, case event_type when 'signup' then 'done' when 'purchase' then 'partial' when 'error' then 'failed' when 'view' then 'parsing' else 'retrying' end as status,
        ts as created_at, case when event_type in ('signup', 'purchase', 'error') then ts end as completed_at from events""",
    "fx_feedback": """select event_id as feedback_id, cast(json_extract_string(props, '$.k') as int) % 500 as chunk_ref, case event_type when 'error' then 'down' else 'up' end as feedback, ts
        from events where event_type in ('error', 'click')""",
    "fx_questions": "select item_id as qid, substr(text, 1, 200) as question from benchmark",
    "fx_edges": """select distinct least(user_id, k) as src, greatest(user_id, k) as dst, upper(event_type) as rel from (select user_id, event_type, cast(json_extract_string(props, '$.k') as bigint) as k from events)
        where user_id <> k and event_type = 'purchase'""",
}


def duck(sql: str) -> str:
    """sql with the views that it names put before it."""
    named = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    head = ", ".join(f"{v} as ({VIEWS[v]})" for v in named)
    sql = sql.strip()
    if not named:
        return sql
    recursive = sql.lower().startswith("with recursive")
    if re.match(r"with\s", sql, re.I):
        sql = re.sub(r"(?i)^with(\s+recursive)?\s+", "", sql)
        return f"with {'recursive ' if recursive else ''}{head}, {sql}"
    return f"with {head} {sql}"


def query(sql: str | None = None, name: str | None = None):
    """Register a function of (Tables) under its name, with the DuckDB text of the same result."""

    def put(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[key] = duck(sql)
        return f

    return put


class Tables:
    """The tables of a folder and the derived views, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name.startswith("fx_"):
            return getattr(self, "view_" + name[3:])()
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over tables and views named in braces."""
        return self.spark.sql(text, **{n: getattr(self, n) for n in set(re.findall(r"\{(\w+)\}", text))})

    def view_documents(self) -> DataFrame:
        d = self.documents
        kind = F.element_at(F.array(*map(F.lit, ("txt", "md", "html", "pdf"))), (F.col("doc_id") % 4 + 1).cast("int"))
        m = F.col("doc_id") % 20
        status = F.when(m == 0, "failed").when(m == 1, "partial").when(m == 2, "deleted").when(m == 3, "superseded").otherwise("done")
        roles = F.element_at(F.array(*map(F.lit, ("", "admin", "admin,engineer"))), (F.col("doc_id") % 3 + 1).cast("int"))
        return d.select(
            "doc_id", F.lit("default").alias("tenant_id"), F.col("source").alias("collection"),
                    F.concat(F.lit("doc_"), "doc_id", F.lit("."), kind).alias("filename"),
            kind.alias("file_type"), F.col("n_chars").alias("file_size"), F.md5(F.col("text").cast("binary")).alias("file_md5"),
                    status.alias("status"), roles.alias("roles_csv"),
            F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).alias("created_on"), "text", "lang",
        )

    def view_chunks(self) -> DataFrame:
        return self.documents.select(
            T.chunk_id(F.lit("default"), "doc_id", F.lit(0), "text").alias("chunk_id"), "doc_id", F.col("lang").alias("section"), F.lit(0).alias("seq"), "text",
            (1 + F.col("doc_id") % 9).cast("int").alias("page_num"), F.col("source").alias("collection"),
        )

    def view_tasks(self) -> DataFrame:
        t = F.col("event_type")
        status = F.when(t == "signup", "done").when(t == "purchase", "partial").when(t == "error", "failed").when(t == "view", "parsing").otherwise("retrying")
        return self.events.select(
            F.col("event_id").alias("task_id"), F.col("user_id").alias("doc_id"), (F.col("event_id") % 50).alias("batch_id"), status.alias("status"),
                    F.col("ts").alias("created_at"),
            F.when(t.isin("signup", "purchase", "error"), F.col("ts")).alias("completed_at"),
        )

    def view_feedback(self) -> DataFrame:
        e = self.events.where(F.col("event_type").isin("error", "click"))
        k = F.get_json_object("props", "$.k").cast("int") % 500
        return e.select(F.col("event_id").alias("feedback_id"), k.alias("chunk_ref"),
                F.when(F.col("event_type") == "error", "down").otherwise("up").alias("feedback"), "ts")

    def view_questions(self) -> DataFrame:
        return self.benchmark.select(F.col("item_id").alias("qid"), F.substring("text", 1, 200).alias("question"))

    def view_edges(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("long")
        e = self.events.where("event_type = 'purchase'").select("user_id", k.alias("k"), F.upper("event_type").alias("rel")).where("user_id <> k")
        return e.select(F.least("user_id", "k").alias("src"), F.greatest("user_id", "k").alias("dst"), "rel").distinct()
