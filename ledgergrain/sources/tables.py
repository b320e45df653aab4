"""Named tables: lookup, samples, previews and read-only queries."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgergrain import fixed_values as fixed

NAME = re.compile(r"^[A-Za-z_]\w*$")


def checked_name(name: str) -> str:
    if not NAME.match(name):
        raise ValueError(f"not a table name: {name!r}")
    return name


def scan_table(spark: SparkSession, name: str) -> DataFrame:
    """A registered table or view by name."""
    return spark.table(f"`{checked_name(name)}`")


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(checked_name(name))


def register(tables: dict[str, DataFrame]) -> None:
    """Make sources visible to SQL as temporary views."""
    for name, df in tables.items():
        df.createOrReplaceTempView(checked_name(name))


def sample_rows(df: DataFrame, key: str | list[str], rows: int = 2) -> DataFrame:
    """The first rows by key."""
    keys = [key] if isinstance(key, str) else key
    return df.orderBy(*keys).limit(rows)


@dataclass(frozen=True)
class Preview:
    rows: DataFrame
    total: DataFrame


def preview_limit(limit: int | None) -> int:
    return max(1, min(fixed.PREVIEW_DEFAULT if limit is None else int(limit), fixed.PREVIEW_MAX))


def preview(df: DataFrame, limit: int | None = None, order: list[str] | None = None) -> Preview:
    """The first rows (at most 200) and the total row count of a table."""
    ordered = df.orderBy(*order) if order else df
    return Preview(ordered.limit(preview_limit(limit)), df.agg(F.count(F.lit(1)).alias("row_count")))


def preview_table(df: DataFrame, limit: int | None, order: list[str]) -> DataFrame:
    """A preview with the total on every row."""
    shown = preview(df, limit, order)
    return shown.rows.withColumn("total_rows", shown.total.scalar())


class NotAllowed(ValueError):
    """A query reads or calls something that isn't on its list."""


#: What a guarded query may call. Functions that reach the JVM, files, the session or the clock of a run are not here.
FUNCTIONS = frozenset(
    """
    any any_value approx_count_distinct avg bool_and bool_or corr count count_if covar_pop covar_samp every first first_value
    last last_value max max_by mean median min min_by mode percentile percentile_approx some std stddev stddev_pop
    stddev_samp sum var_pop var_samp variance grouping grouping_id collect_list collect_set array_agg string_agg listagg
    cume_dist dense_rank lag lead nth_value ntile percent_rank rank row_number
    abs ceil ceiling exp floor greatest least ln log log10 log2 mod negative pmod pow power round bround sign signum sqrt
    try_add try_subtract try_multiply try_divide div
    coalesce if ifnull iff isnan isnull isnotnull nanvl nullif nullifzero nvl nvl2 when zeroifnull decode
    ascii char_length character_length chr concat concat_ws contains endswith initcap instr lcase left length locate lower lpad
    ltrim octet_length overlay position regexp_count regexp_extract regexp_extract_all regexp_like regexp_replace repeat
    replace reverse right rpad rtrim split split_part startswith substr substring translate trim btrim ucase upper
    like ilike rlike
    add_months date date_add date_diff date_format date_from_unix_date date_part date_sub date_trunc datediff datepart day
    dayofmonth dayofweek dayofyear extract hour last_day make_date minute month months_between quarter second to_date
    to_timestamp trunc try_to_timestamp weekday weekofyear year
    array array_contains array_distinct array_join array_size cardinality element_at explode explode_outer posexplode
    posexplode_outer map map_keys map_values named_struct struct sequence size slice sort_array
    bigint binary boolean cast decimal double float int smallint string timestamp tinyint try_cast hash md5 sha2 xxhash64
    range
    """.split()
)
#: Nodes of a parsed text that only read, filter, join, group, order or number.
_NODES = frozenset(
    """
    Aggregate Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset
    OneRowRelation Pivot
    Project Sort SubqueryAlias Union UnresolvedHaving UnresolvedHint UnresolvedInlineTable UnresolvedRelation
    UnresolvedSubqueryColumnAliases UnresolvedTableValuedFunction UnresolvedWith Unpivot WithWindowDefinition
    """.split()
)
_SUBQUERIES = ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery")
#: Calls into user code that a function of the session may hide behind an allowed name.
_CALLS = ("CallMethodViaReflection", "ScalaUDF", "PythonUDF", "PythonUDAF", "ScalaAggregator", "ScalaUDAF", "PythonUDTF")


def _each(seq):
    return (seq.apply(i) for i in range(seq.size()))


def _kind(node) -> str:
    return node.getClass().getSimpleName()


class _Guard:
    """Walks a parsed text, which has named and run nothing yet. ``used`` gets the allowed tables that it reads."""

    def __init__(self, allowed: set[str]):
        self.allowed, self.used = allowed, set()

    def called(self, parts) -> None:
        name = ".".join(_each(parts)).lower()
        if name not in FUNCTIONS:
            raise NotAllowed(f"not an allowed function: {name}")

    def relation(self, parts, ctes: frozenset[str]) -> None:
        parts = list(_each(parts))
        name = ".".join(parts).lower()
        if len(parts) > 1 or name not in self.allowed | ctes:
            raise NotAllowed(f"TABLE_OR_VIEW_NOT_FOUND: not an allowed table: {name}")
        if name not in ctes:
            self.used.add(name)

    def plan(self, node, ctes: frozenset[str] = frozenset()) -> None:
        kind = _kind(node)
        if kind not in _NODES:
            raise NotAllowed(f"not an allowed statement: {kind}")
        if kind == "UnresolvedWith":  # each CTE sees those before it, and itself if it is recursive
            for cte in _each(node.cteRelations()):
                own = cte._1().lower()
                self.plan(cte._2(), ctes | {own} if node.allowRecursion() else ctes)
                ctes |= {own}
        elif kind == "UnresolvedRelation":
            self.relation(node.multipartIdentifier(), ctes)
        elif kind == "UnresolvedTableValuedFunction":
            self.called(node.name())
        elif kind == "WithWindowDefinition":
            for window in _each(node.windowDefinitions().values().toSeq()):
                self.expression(window, ctes)
        for expression in _each(node.expressions()):
            self.expression(expression, ctes)
        for child in _each(node.children()):
            self.plan(child, ctes)

    def expression(self, node, ctes: frozenset[str]) -> None:
        kind = _kind(node)
        if kind in ("UnresolvedFunction", "UnresolvedGenerator"):
            self.called(node.nameParts() if kind == "UnresolvedFunction" else node.name().nameParts())
        elif kind == "UnresolvedAttribute" and "_metadata" in (p.lower() for p in _each(node.nameParts())):
            raise NotAllowed("columns of files are not allowed")
        elif "UnresolvedIdentifier" in kind:
            raise NotAllowed("names must be written out")
        elif kind in _SUBQUERIES:
            self.plan(node.plan(), ctes)
        elif "Subquery" in kind and kind != "InSubquery":
            raise NotAllowed(f"not an allowed subquery: {kind}")
        for child in _each(node.children()):
            self.expression(child, ctes)


#: Leaves that read nothing.
_OWN_LEAVES = ("OneRowRelation", "LocalRelation", "ResolvedInlineTable", "Range", "CTERelationRef", "UnionLoopRef")


def _check_analyzed(df: DataFrame, used: dict[str, DataFrame]) -> None:
    """The second wall: after names are resolved, leaves are those of the allowed tables and nothing calls user code."""
    own = [t._jdf.queryExecution().analyzed() for t in used.values()]
    known = [leaf for plan in own for leaf in _each(plan.collectLeaves())]

    def look(expression) -> None:
        kind = _kind(expression)
        if kind in _CALLS:
            raise NotAllowed("functions of the session are not allowed")
        if kind in _SUBQUERIES:
            walk(expression.plan())
        for child in _each(expression.children()):
            look(child)

    def walk(plan) -> None:
        if any(plan.sameResult(o) for o in own):  # what an allowed table does in its own plan is its maker's affair
            return
        children = list(_each(plan.children()))
        if not children and _kind(plan) not in _OWN_LEAVES and not any(plan.sameResult(k) for k in known):
            raise NotAllowed(f"not an allowed table: {_kind(plan)}")
        for expression in _each(plan.expressions()):
            look(expression)
        for child in [*children, *_each(plan.innerChildren())] if _kind(plan) == "WithCTE" else children:
            walk(child)

    walk(df._jdf.queryExecution().analyzed())


def guarded_sql(spark: SparkSession, query: str, allowed: dict[str, DataFrame]) -> DataFrame:
    """One read-only query over the allowed tables, by their plain names.

    The text is parsed and walked before a name of it is resolved: statements other than queries, tables that aren't
    allowed (views, databases and paths among them) and functions that aren't on the list are refused. CTEs
    are known by their scope, and may take the name of an allowed table. The text then becomes a subquery behind
    one CTE per table that it reads, so that columns which an allowed frame has dropped can't be reached; and in the
    analysed plan every leaf must be one of an allowed table.
    """
    guard = _Guard({checked_name(n).lower() for n in allowed})
    text = query.strip().rstrip(";")
    guard.plan(spark._jsparkSession.sessionState().sqlParser().parsePlan(text))
    used = {n: df for n, df in allowed.items() if n.lower() in guard.used}
    heads = ", ".join(f"`{n}` AS (SELECT * FROM {{{n}}})" for n in used)
    body = f"SELECT * FROM ({text}\n)"
    if used:  # braces of the text itself are no placeholders
        df = spark.sql(f"WITH {heads} " + body.replace("{", "{{").replace("}", "}}"), **used)
    else:
        df = spark.sql(body)
    _check_analyzed(df, used)
    return df
