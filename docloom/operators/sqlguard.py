"""A guard for generated SQL: the parsed logical plan may only read allowed tables and call allowed functions."""

from __future__ import annotations

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T

#: Plan nodes that a read-only query may consist of.
ALLOWED = {
    "Project", "Filter", "Join", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "SubqueryAlias", "UnresolvedRelation",
            "UnresolvedSubqueryColumnAliases",
    "WithWindowDefinition", "UnresolvedHaving", "UnresolvedWith", "OneRowRelation", "LateralJoin", "Tail", "Pivot", "Window", "GroupingSets",
            "UnresolvedInlineTable", "Limit", "CTERelationDef",
}
#: Functions that a query may call: pure ones, without access to files, classes, secrets or the session.
FUNCTIONS = frozenset(
    # aggregates and windows
    "any any_value approx_count_distinct approx_percentile avg bool_and bool_or collect_list collect_set corr count count_if covar_pop covar_samp cume_dist dense_rank every first first_value "
    "grouping grouping_id kurtosis lag last last_value lead listagg max max_by mean median min min_by mode nth_value ntile percentile percent_rank rank regr_slope row_number skewness some std "
    "stddev stddev_pop stddev_samp string_agg sum var_pop var_samp variance "
    # numbers
    "% * + - / abs acos asin atan atan2 bround cbrt ceil ceiling cos degrees div exp floor greatest least ln log log10 log2 mod negative pmod pow power radians round sign signum sin sqrt tan try_add try_divide "
    # conditions
    "! < <= <=> <> = == > >= and between case coalesce if ifnull in isnan isnotnull isnull not nullif nvl nvl2 or when "
    # strings
    "| || ascii btrim char char_length concat concat_ws contains endswith format_number ilike initcap instr lcase left length like locate lower lpad ltrim md5 overlay position regexp regexp_count "
    "regexp_extract regexp_extract_all regexp_like regexp_replace repeat replace reverse right rlike rpad rtrim sha2 split split_part startswith substr substring substring_index translate trim ucase upper "
    # dates
    "add_months current_date current_timestamp date date_add date_diff date_format date_part date_sub date_trunc datediff day dayofmonth dayofweek dayofyear extract from_unixtime hour last_day "
    "make_date minute month months_between next_day now quarter second timestamp to_date to_timestamp trunc unix_timestamp weekofyear year "
    # types and collections
    "array array_contains array_distinct array_join array_max array_min bigint boolean cast cardinality decimal double element_at explode filter float int named_struct size smallint sort_array string struct "
    "tinyint transform".split()
)
#: Names that stand for the session where no column has them.
SESSION = frozenset({"current_user", "session_user", "user", "current_catalog", "current_database", "current_schema"})


class Rejected(ValueError):
    """The statement is not a plain query over allowed tables and functions; args[0] says why."""


class _Walk:
    """A walk over everything that a parsed plan holds: its nodes' fields, not only what they list as children or expressions."""

    def __init__(self, spark: SparkSession, allowed: set[str]):
        kind = spark.sparkContext._jvm.java.lang.Class.forName
        catalyst = "org.apache.spark.sql.catalyst"
        self.plan, self.expression = kind(f"{catalyst}.plans.logical.LogicalPlan"), kind(f"{catalyst}.expressions.Expression")
        self.iterable, self.product = kind("scala.collection.Iterable"), kind("scala.Product")
        self.allowed, self.names = allowed, set()

    @staticmethod
    def each(things):
        it = things.iterator()
        while it.hasNext():
            yield it.next()

    def field(self, x, own: frozenset) -> None:
        """A field of any node: plans and expressions are looked at, collections, options and pairs opened, the rest are plain values."""
        if not hasattr(x, "getClass"):
            return
        if self.plan.isInstance(x):
            self.node(x, own)
        elif self.expression.isInstance(x):
            self.term(x, own)
        elif self.iterable.isInstance(x):
            for y in self.each(x):
                self.field(y, own)
        elif self.product.isInstance(x):
            self.fields(x, own)

    def fields(self, x, own: frozenset) -> None:
        it = x.productIterator()
        while it.hasNext():
            self.field(it.next(), own)

    def node(self, x, own: frozenset) -> None:
        kind = x.getClass().getSimpleName().rstrip("$")
        if kind not in ALLOWED:
            raise Rejected(f"not allowed: {kind}")
        if kind == "UnresolvedWith":
            for name in self.each(x.cteRelations()):
                self.field(name._2(), own)  # sees the names before it, not itself
                own = own | {name._1().lower()}
            self.node(x.child(), own)
            return
        if kind == "UnresolvedRelation":
            name = ".".join(self.each(x.multipartIdentifier())).lower()
            if name not in own:
                if name not in self.allowed:
                    raise Rejected(f"table: {name}")
                self.names.add(name)
            return
        self.fields(x, own)

    def term(self, x, own: frozenset) -> None:
        kind = x.getClass().getSimpleName()
        if "UnresolvedIdentifier" in kind:  # a name that is only known when the statement runs
            raise Rejected(f"not allowed: {kind}")
        if kind == "UnresolvedFunction":
            called = ".".join(self.each(x.nameParts())).lower()
            if called not in FUNCTIONS:
                raise Rejected(f"function: {called}")
        if kind == "UnresolvedAttribute":
            name = ".".join(self.each(x.nameParts())).lower()
            if name in SESSION:
                raise Rejected(f"function: {name}")
        self.fields(x, own)


def check(spark: SparkSession, sql: str, tables: set[str]) -> set[str]:
    """Names of the tables a statement reads; Rejected if it is no query, unites queries, reads others than `tables`, calls a function
    outside FUNCTIONS or names the session. A name of a WITH clause stands for its query only inside that clause's statement."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException as e:
        raise Rejected("syntax") from e
    walk = _Walk(spark, {t.lower() for t in tables})
    walk.node(plan, frozenset())
    return walk.names


def run(spark: SparkSession, sql: str, tables: dict[str, DataFrame], sensitive: tuple[str, ...] = (), max_rows: int | None = 200) -> DataFrame:
    """At most max_rows rows (None: all) of a guarded query over the given tables; columns named in `sensitive` are masked before the query.

    Masking comes before the query, so that an alias or an expression does not lay a value open. The tables are views only while
    the query is analyzed; views of the same names come back after it. A name that turns out to be a variable of the session is
    Rejected.
    """
    check(spark, sql, set(tables))
    hidden = {s.lower() for s in sensitive}
    before = {v.name.lower(): spark.table(v.name) for v in spark.catalog.listTables() if v.isTemporary and v.name.lower() in {n.lower() for n in tables}}
    try:
        for name, df in tables.items():
            df.select(*[T.mask(c).alias(c) if c.lower() in hidden else F.col(c) for c in df.columns]).createOrReplaceTempView(name)
        out = spark.sql(sql)
    finally:
        for name in tables:
            spark.catalog.dropTempView(name)
        for name, df in before.items():
            df.createOrReplaceTempView(name)
    if "variablereference" in out._jdf.queryExecution().analyzed().toJSON().lower():
        raise Rejected("variable")
    return out if max_rows is None else out.limit(max_rows)
