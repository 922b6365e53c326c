"""Queries of the structured route: guarded SQL over business tables, masking, Markdown rows."""

from __future__ import annotations


from docloom.functions import text as T
from docloom.operators import sqlguard

from .base import query

TABLES = ("customer", "orders", "nation", "lineitem")
_STATEMENTS = [
    (1, "select c_name from customer", "ok"), (2, "select 1 from customer, secrets", "table: secrets"), (3, "drop table customer", "rejected"),
            (4, "select * from customer union select * from customer", "rejected"),
    (5, "select * from (select * from `orders`) o join nation n on true", "ok"), (6, "select 'drop table x' as t from orders", "ok"),
            (7, "select * from customer where c_custkey in (select id from hidden)", "table: hidden"),
    (8, "with x as (select * from orders) select * from x", "ok"), (9, "insert into orders select * from orders", "rejected"),
            (10, "selec nonsense", "rejected"),
    (11, "select * from secrets, (with secrets as (select 1) select * from secrets) y", "table: secrets"),
            (12, "select java_method('java.lang.System', 'exit', 1) from orders", "function: java_method"),
    (13, "select * from orders where o_orderkey in (select reflect('java.lang.System', 'nanoTime') from orders)", "function: reflect"),
    (14, "with a as (select * from b), b as (select 1) select * from a", "table: b"),
            (15, "select sum(o_totalprice) from orders where exists (select 1 from customer where c_custkey = o_custkey)", "ok"),
    (16, "select sum(o_totalprice) over w from orders window w as (order by (select max(p) from secrets))", "table: secrets"),
    (17, "select sum(o_totalprice) over w from orders window w as (partition by (select max(p) from secrets) order by o_orderkey)", "table: secrets"),
    (18, "select sum(o_totalprice) over w from orders window w as (order by java_method('java.lang.System', 'getProperty', 'user.home'))",
            "function: java_method"),
    (19, "select current_user, o_orderkey from orders", "function: current_user"), (20, "select session_user from orders", "function: session_user"),
    (21, "select rank() over w from orders window w as (partition by o_custkey order by o_totalprice), v as (order by o_orderkey)", "ok"),
    (22, "select identifier('java_' || 'method')('java.lang.System', 'nanoTime') from orders", "rejected"),
    (23, "select * from identifier('sec' || 'rets')", "rejected"),
    (24, "select * from orders tablesample (10 percent)", "rejected"),
]


@query("select * from (values " + ",".join(f"({i},'{v}')" for i, _, v in _STATEMENTS) + ") t(id, verdict)")
def nl2sql_guard(t):
    out = []
    for i, sql, _ in _STATEMENTS:
        try:
            sqlguard.check(t.spark, sql, set(TABLES))
            out.append((i, "ok"))
        except sqlguard.Rejected as e:
            out.append((i, e.args[0] if e.args[0].startswith(("table", "function")) else "rejected"))
    return t.spark.createDataFrame(out, "id int, verdict string")


_JOIN = "select c_mktsegment, n_name, count(*) as n_orders, round(sum(o_totalprice), 2) as total from customer join nation on c_nationkey = n_nationkey join orders on o_custkey = c_custkey group by c_mktsegment, n_name"
_ROLLUP = "select o_orderstatus, o_orderpriority, count(*) as n from orders group by rollup (o_orderstatus, o_orderpriority)"
_WINDOW = "select l_orderkey, l_linenumber, l_quantity, rank() over (partition by l_orderkey order by l_quantity desc) as r, dense_rank() over (partition by l_orderkey order by l_quantity desc) as d from lineitem"


def _run(t, sql, most=None):
    return sqlguard.run(t.spark, sql, {n: getattr(t, n) for n in TABLES}, ("c_name",), most)


@query(_JOIN)
def nl2sql_join(t):
    return _run(t, _JOIN)


@query(_ROLLUP)
def nl2sql_rollup(t):
    return _run(t, _ROLLUP)


@query(_WINDOW)
def nl2sql_window(t):
    return _run(t, _WINDOW)


@query("""select c_custkey, concat('| ', c_custkey, ' | ', concat(substr(c_name, 1, 3), '***', right(c_name, 2)), ' | ', replace(c_mktsegment, '|',
        '\\|'), ' |') as row from customer""")
def rows_to_markdown(t):
    return _run(t, "select c_custkey, c_name, c_mktsegment from customer").select("c_custkey",
            T.markdown_row("c_custkey", "c_name", "c_mktsegment").alias("row"))


