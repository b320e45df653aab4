"""The registered queries: every operator over whole tables, as ``name -> (spark, folder) -> DataFrame``.

Arrays leave as comma-joined text, evidence as plain columns and money as double, so that results can
be compared with SQL.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgergrain import fixed_values as fixed
from ledgergrain.functions.columns import money, month_key
from ledgergrain.functions.time_phrases import in_date_phrase
from ledgergrain.operators import datatests as dt
from ledgergrain.operators import joins, metrics, profile, profile_state, quality, rule_tables, text_rules
from ledgergrain.operators import relationships as rel
from ledgergrain.operators import run_events as ev
from ledgergrain.operators.metrics import MetricRequest
from ledgergrain.plans import build, lineage, rebuild, sql_models, staged
from ledgergrain.plans import models as m
from ledgergrain.session import application_folder, run_folder
from ledgergrain.sources import adapters, contracts, drift, sinks, tables
from ledgergrain.specs import ColumnCheck, DataTest, Relationship, RuleOption, SourceContract, TextRule
from ledgergrain.streaming import events as stream

QUERIES: dict = {}


def query(name: str):
    def add(function):
        QUERIES[name] = function
        return function

    return add


def _money(df: DataFrame) -> DataFrame:
    """Decimal columns as double."""
    return df.select(*[F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes])


def _joined(column: str) -> Column:
    return F.array_join(column, ",").alias(column)


def _long(key: str) -> Column:
    return F.col("evidence")[key].cast("bigint").alias(key)


def _double(key: str) -> Column:
    return F.col("evidence")[key].cast("double").alias(key)


src = adapters.source_tables


# --- sources and sinks -------------------------------------------------------------------------------


@query("scan_table")
def _(spark: SparkSession, d: str) -> DataFrame:
    tables.register({"lg_invoices": adapters.stripe_invoices(spark, d)})
    return _money(tables.scan_table(spark, "lg_invoices"))


@query("table_exists")
def _(spark, d):
    tables.register({f"lg_{n}": df for n, df in src(spark, d).items()})
    return profile.table_presence(spark, [*[f"lg_{n}" for n in adapters.SOURCE_NAMES], "lg_missing"])


@query("sample_rows")
def _(spark, d):
    return _money(tables.sample_rows(adapters.stripe_payments(spark, d), ["payment_id", "successful_amount",
                                                                         "payment_month", "refund_amount"]))


@query("preview_table")
def _(spark, d):
    return _money(tables.preview_table(adapters.stripe_invoices(spark, d), None, ["invoice_id"]))


def _monthly(spark, d, product: str) -> DataFrame:
    spec = fixed.MONTHLY_MARTS[product]
    return build.compose(src(spark, d), build.product_models(product))[spec.name]


@query("sink_mart_table")
def _(spark, d):
    path = f"{run_folder(spark, 'mart')}/monthly"
    rows = sinks.write_table(_monthly(spark, d, "billed_revenue"), path)
    return spark.read.parquet(path).withColumn("written_rows", F.lit(rows).cast("bigint"))


@query("sink_csv")
def _(spark, d):
    path = f"{run_folder(spark, 'csv')}/monthly"
    mart = _monthly(spark, d, "collected_revenue")
    rows = sinks.write_csv(mart, path)
    back = spark.read.option("header", True).schema(mart.schema).csv(path)
    return back.withColumn("written_rows", F.lit(rows).cast("bigint"))


def _marts(spark, d) -> dict[str, DataFrame]:
    return {
        fixed.MONTHLY_MARTS[p].name: _monthly(spark, d, p) for p in ("billed_revenue", "collected_revenue")
    }


@query("sink_all_marts")
def _(spark, d):
    folder = run_folder(spark, "marts")
    return sinks.write_all_csv(spark, _marts(spark, d), folder, "run")


@query("list_marts")
def _(spark, d):
    return sinks.list_marts(_marts(spark, d))


@query("source_contract_load")
def _(spark, d):
    folder = run_folder(spark, "contracts")
    contracts.write_contracts(spark, fixed.CONTRACTS, folder)
    loaded = contracts.read_contracts(spark, folder)
    return profile.union_all([contracts.contract_coverage(df, loaded[n]) for n, df in src(spark, d).items()])


@query("rebuild_if_schema_drift")
def _(spark, d):
    live = src(spark, d)
    live["stripe_invoices"] = adapters.stripe_invoices(spark, d, with_dates=True)
    live["dim_plans"] = live["dim_plans"].where(F.length("plan_id") == 0)
    del live["dim_customers"]
    return drift.schema_drift(live, fixed.CONTRACTS)


# --- profiling ---------------------------------------------------------------------------------------


@query("profile_row_count")
def _(spark, d):
    return profile.row_counts(src(spark, d))


@query("profile_columns")
def _(spark, d):
    return profile.union_all(
        [profile.column_profile(df, fixed.CONTRACTS[n]) for n, df in src(spark, d).items()]
    ).drop("position")


@query("profile_null_rates")
def _(spark, d):
    return profile.union_all([profile.null_rates(df, n) for n, df in src(spark, d).items()])


@query("profile_distinct_values")
def _(spark, d):
    plans = SourceContract(
        "fact_subscriptions",
        tuple(
            replace(c, valid_values=("BUILDING",)) if c.name == "plan_id" else c
            for c in fixed.FACT_SUBSCRIPTIONS.columns
        ),
    )
    return profile.distinct_values(adapters.fact_subscriptions(spark, d), plans).unionByName(
        profile.distinct_values(adapters.dim_customers(spark, d), fixed.DIM_CUSTOMERS)
    )


@query("profile_state")
def _(spark, d):
    """Orders that arrive in two deliveries: exact figures, and whether the merged sketches keep their bounds."""
    base, columns = run_folder(spark, "profile"), ("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    orders = adapters.parquet(spark, d, "orders").select(*columns)
    for late in (False, True):
        orders.where((F.col("o_orderkey") % 3 == 0) == late).write.parquet(f"{base}/in/{int(late)}")
        profile_state.update(spark, f"{base}/in", f"{base}/state")
    found = profile_state.merged(spark, f"{base}/in", f"{base}/state")
    exact = orders.agg(*[F.count_distinct(c).alias(c) for c in columns])
    cells = ", ".join(f"struct('{c}' as column, {c} as n)" for c in columns)
    median = found.where("column = 'o_totalprice'").select(F.col("quantiles")[0]).scalar()
    below = orders.agg(F.count_if(F.col("o_totalprice") <= median) / F.count(F.lit(1))).scalar()
    return found.join(exact.selectExpr(f"inline(array({cells}))"), "column").select(
        "column", "row_count", "null_count", "low", "high", "low_number", "high_number",
        (F.abs(F.col("distinct_estimate") - F.col("n")) <= 0.06 * F.col("n")).alias("distinct_within"),
        F.when(F.col("column") == "o_totalprice", F.abs(below - 0.5) <= 0.03).alias("median_within"),
    )


@query("profile_month_range")
def _(spark, d):
    return profile.month_ranges(src(spark, d), fixed.CONTRACTS)


@query("profile_multi_source")
def _(spark, d):
    return _all_findings(spark, d).select("source", "id", "type", "severity", "column", _joined("affects"))


@query("missing_and_extra_columns")
def _(spark, d):
    invoices = adapters.stripe_invoices(spark, d, with_dates=True).drop("discount_amount")
    return profile.column_differences(invoices, fixed.STRIPE_INVOICES)


def _nodes(spark, d) -> DataFrame:
    return profile.graph_nodes(src(spark, d), fixed.CATALOG, fixed.METRICS, fixed.DIMENSIONS, fixed.DATA_PRODUCTS)


@query("schema_graph_nodes")
def _(spark, d):
    return _nodes(spark, d).select(
        "source", "role", "entity", "grain", "primary_key", _joined("metrics"), _joined("dimensions"),
        _joined("products"), "row_count",
    )


DANGLING = Relationship("invoices_to_disputes", "stripe_invoices", "stripe_disputes", "invoice_id", "invoice_id")


@query("schema_graph_edges")
def _(spark, d):
    return profile.graph_edges(_nodes(spark, d), (*fixed.RELATIONSHIPS, DANGLING))


@query("schema_graph_summary")
def _(spark, d):
    nodes = _nodes(spark, d)
    edges = profile.graph_edges(nodes, fixed.RELATIONSHIPS)
    return profile.graph_summary(nodes, edges, len(fixed.METRICS), len(fixed.DIMENSIONS), len(fixed.DATA_PRODUCTS))


# --- contract quality checks -------------------------------------------------------------------------


def _all_findings(spark, d) -> DataFrame:
    return quality.combined_findings(src(spark, d), fixed.CONTRACTS)


def _of_type(found: DataFrame, kind: str, *evidence: Column) -> DataFrame:
    return found.where(F.col("type") == kind).select("id", "severity", "column", *evidence)


@query("dq_empty_table")
def _(spark, d):
    invoices = adapters.stripe_invoices(spark, d)
    empty = invoices.where(F.col("invoice_amount") < 0)
    found = quality.shared_aggregate_findings(empty, fixed.STRIPE_INVOICES).withColumn("table", F.lit("negative"))
    full = quality.shared_aggregate_findings(invoices, fixed.STRIPE_INVOICES).withColumn("table", F.lit("all"))
    return found.unionByName(full.where(F.col("type") == "empty_table")).select(
        "table", "id", "severity", _long("total_rows")
    )


def _drifted(spark, d) -> DataFrame:
    return adapters.stripe_invoices(spark, d, with_dates=True).drop("discount_amount")


@query("dq_missing_column")
def _(spark, d):
    found = quality.shared_aggregate_findings(_drifted(spark, d), fixed.STRIPE_INVOICES)
    return _of_type(found, "missing_required_column", F.col("evidence")["expected_type"].alias("expected_type"),
                    _joined("affects"))


@query("dq_type_mismatch")
def _(spark, d):
    found = profile.union_all(
        [
            quality.shared_aggregate_findings(df, fixed.CONTRACTS[n]).withColumn("source", F.lit(n))
            for n, df in src(spark, d).items()
        ]
    )
    return found.where(F.col("type") == "type_mismatch").select(
        "source", "id", "severity", "column",
        F.col("evidence")["expected_type"].alias("expected_type"),
        F.col("evidence")["actual_type"].alias("actual_type"),
    )


@query("dq_extra_columns")
def _(spark, d):
    found = quality.shared_aggregate_findings(_drifted(spark, d), fixed.STRIPE_INVOICES)
    return _of_type(found, "extra_columns", F.col("evidence")["extra_columns"].alias("extra_columns"))


@query("dq_required_nulls")
def _(spark, d):
    strict = replace(
        fixed.STRIPE_INVOICES,
        columns=tuple(replace(c, nullable=False) for c in fixed.STRIPE_INVOICES.columns),
    )
    found = quality.shared_aggregate_findings(adapters.stripe_invoices(spark, d), strict)
    return _of_type(found, "required_column_nulls", _long("null_count"), _long("total_rows"), _double("null_rate"),
                    _joined("affects"))


@query("dq_duplicate_key")
def _(spark, d):
    frames = []
    for name, df in src(spark, d).items():
        for found in quality.duplicate_findings(df, fixed.CONTRACTS[name]):
            frames.append(found.withColumn("source", F.lit(name)))
    return profile.union_all(frames).select(
        "source", "id", "type", "severity", _long("duplicate_values"), _long("duplicate_key_count"),
        F.col("evidence")["examples"].alias("examples"), _long("total_rows"),
    )


@query("dq_duplicate_key_rows")
def _(spark, d):
    return quality.duplicate_keys(adapters.stripe_payments(spark, d), "payment_id")


@query("dq_invalid_values")
def _(spark, d):
    customers = adapters.dim_customers(spark, d)
    plans = replace(
        fixed.FACT_SUBSCRIPTIONS,
        columns=tuple(
            replace(c, valid_values=("BUILDING", "AUTOMOBILE", "MACHINERY", "HOUSEHOLD", "FURNITURE"))
            if c.name == "plan_id" else c
            for c in fixed.FACT_SUBSCRIPTIONS.columns
        ),
    )
    found = profile.union_all(
        quality.valid_value_findings(customers, fixed.DIM_CUSTOMERS)
        + quality.valid_value_findings(adapters.fact_subscriptions(spark, d), plans)
    )
    return found.select(
        "id", "type", "severity", "column", _long("invalid_value_count"), _long("invalid_count"),
        F.col("evidence")["observed_values"].alias("observed_values"),
    )


@query("dq_invalid_value_rows")
def _(spark, d):
    return quality.invalid_values(adapters.fact_subscriptions(spark, d), "plan_id", ("BUILDING", None, "MACHINERY"))


CHECKED_INVOICES = replace(
    fixed.STRIPE_INVOICES,
    columns=(
        *fixed.STRIPE_INVOICES.columns[:3],
        replace(
            fixed.STRIPE_INVOICES.columns[3],
            checks=(
                ColumnCheck("min_value", value=50000),
                ColumnCheck("max_column_value", column="discount_amount"),
            ),
        ),
        replace(
            fixed.STRIPE_INVOICES.columns[4],
            checks=(
                ColumnCheck("min_value", value=0, inclusive=False, severity="optional_review"),
                ColumnCheck("required_when", column="invoice_month", equals="1996-01"),
            ),
        ),
    ),
)


@query("dq_min_value")
def _(spark, d):
    found = quality.shared_aggregate_findings(adapters.stripe_invoices(spark, d), CHECKED_INVOICES)
    return _of_type(found, "numeric_constraint", _long("affected_rows"), _long("total_rows"), F.col("message"))


@query("dq_max_column_value")
def _(spark, d):
    found = quality.shared_aggregate_findings(adapters.stripe_invoices(spark, d), CHECKED_INVOICES)
    return _of_type(found, "cross_column_constraint", _long("affected_rows"), _long("total_rows"))


@query("dq_required_when")
def _(spark, d):
    found = quality.shared_aggregate_findings(adapters.stripe_invoices(spark, d), CHECKED_INVOICES)
    return _of_type(found, "conditional_required_value", _long("affected_rows"), _long("total_rows"))


@query("dq_null_rate_decision")
def _(spark, d):
    found = quality.shared_aggregate_findings(adapters.stripe_invoices(spark, d), fixed.STRIPE_INVOICES)
    return _of_type(found, "business_rule_needed", _long("null_count"), _long("total_rows"), _double("null_rate"),
                    _double("decision_threshold"))


@query("dq_positive_adjustment")
def _(spark, d):
    found = quality.shared_aggregate_findings(adapters.stripe_payments(spark, d), fixed.STRIPE_PAYMENTS)
    return _of_type(found, "business_rule_needed", _long("affected_rows"), _long("total_rows"), _joined("affects"))


@query("dq_default_affects")
def _(spark, d):
    rates = profile.union_all([profile.null_rates(df, n) for n, df in src(spark, d).items()])
    return rates.select(
        "source", "column", "total_rows", F.array_join(quality.affects_of(F.col("column")), ",").alias("affects")
    )


@query("dq_report")
def _(spark, d):
    return quality.report(_all_findings(spark, d))


@query("finding_counts")
def _(spark, d):
    return quality.counts(_all_findings(spark, d))


@query("top_findings")
def _(spark, d):
    top = quality.top_findings(_all_findings(spark, d))
    keys = F.array_join(F.array_sort(F.map_keys("evidence")), ",").alias("evidence_keys")
    return top.select("priority", "source", "id", "type", "severity", keys)


# --- relationships and joins -------------------------------------------------------------------------


@query("rel_missing_key")
def _(spark, d):
    invoices = adapters.stripe_invoices(spark, d).withColumnRenamed("invoice_id", "renamed")
    payments = adapters.stripe_payments(spark, d)
    edge = fixed.RELATIONSHIPS[3]
    state = rel.summary(invoices, payments, edge).select("relationship_id", "status", "left_rows", "right_rows")
    found = rel.findings(invoices, payments, edge).select(
        F.col("id").alias("finding_id"), "severity", F.col("message")
    )
    return state.join(found, F.col("finding_id") == F.concat(F.col("relationship_id"), F.lit("__missing_join_key")))


def _summaries(spark, d) -> DataFrame:
    return rel.summaries(src(spark, d), fixed.RELATIONSHIPS)


@query("rel_duplicate_keys")
def _(spark, d):
    return _summaries(spark, d).select("relationship_id", "left_duplicate_key_count", "right_duplicate_key_count")


def _with_gaps(spark, d) -> dict[str, DataFrame]:
    """Payments whose key is null or points nowhere for some return flags and lines, from whole tables."""
    live = src(spark, d)
    raw = adapters.parquet(spark, d, "lineitem")
    live["stripe_payments"] = raw.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("payment_id"),
        F.when(F.col("l_returnflag") == "N", F.col("l_orderkey"))
        .when(F.col("l_linestatus") == "F", -F.col("l_orderkey") - 1)
        .alias("invoice_id"),
        month_key("l_shipdate").alias("payment_month"),
        money("l_extendedprice").alias("successful_amount"),
        money(F.lit(0)).alias("refund_amount"),
    )
    return live


@query("rel_null_keys")
def _(spark, d):
    gaps = _with_gaps(spark, d)
    found = rel.findings(gaps["stripe_invoices"], gaps["stripe_payments"], fixed.RELATIONSHIPS[3])
    return _of_type(found, "unmatched_right_records", _long("unmatched_right_count"), _double("unmatched_right_rate"),
                    _long("right_null_count"), _double("right_null_rate"), F.col("message"))


@query("rel_unmatched_left")
def _(spark, d):
    live = src(spark, d)
    return _money(rel.orphans(live["stripe_invoices"], ("invoice_id",), live["stripe_payments"], ("invoice_id",)))


@query("rel_unmatched_right")
def _(spark, d):
    gaps = _with_gaps(spark, d)
    lost = rel.orphans(gaps["stripe_payments"], ("invoice_id",), gaps["stripe_invoices"], ("invoice_id",))
    return _money(lost.drop("refund_amount"))


@query("rel_severity")
def _(spark, d):
    gaps = _with_gaps(spark, d)
    return rel.all_findings(gaps, fixed.RELATIONSHIPS).select("relationship_id", "id", "type", "severity")


@query("rel_status")
def _(spark, d):
    gaps = _with_gaps(spark, d)
    gaps["dim_plans"] = gaps["dim_plans"].withColumnRenamed("plan_id", "renamed")
    return rel.summaries(gaps, fixed.RELATIONSHIPS).select("relationship_id", "status")


@query("payment_coverage")
def _(spark, d):
    live = src(spark, d)
    return rel.payment_coverage(live["stripe_invoices"], live["stripe_payments"])


@query("rel_validate_all")
def _(spark, d):
    return _summaries(spark, d)


@query("rel_composite_key")
def _(spark, d):
    lines = adapters.parquet(spark, d, "lineitem")
    returned = lines.where(F.col("l_returnflag") == "R")
    edge = Relationship("lines_to_returns", "lines", "returns", ("l_partkey", "l_suppkey"), ("l_partkey", "l_suppkey"))
    return rel.summary(lines, returned, edge).drop("partial_count", "overpaid_count", "fully_paid_count")


@query("join_inner_equi")
def _(spark, d):
    live = src(spark, d)
    return _money(
        live["fact_subscriptions"].join(live["dim_customers"], "customer_id").select(
            "subscription_id", "customer_id", "customer_name", "customer_segment", "mrr_amount"
        )
    )


@query("join_left_preagg")
def _(spark, d):
    live = src(spark, d)
    return _money(joins.invoices_with_payments(live["stripe_invoices"], live["stripe_payments"]))


@query("join_chain_4")
def _(spark, d):
    return _money(joins.chain_totals(src(spark, d), "customer_segment", "plan_name"))


@query("fanout_guard")
def _(spark, d):
    live = src(spark, d)
    invoices, payments = live["stripe_invoices"], live["stripe_payments"]
    safe = joins.fanout_guard(invoices, joins.invoices_with_payments(invoices, payments), "invoice_amount")
    raw = invoices.join(payments.select(F.col("invoice_id").alias("p")), F.col("invoice_id") == F.col("p"), "left")
    unsafe = joins.fanout_guard(invoices, raw, "invoice_amount")
    return safe.withColumn("join", F.lit("preaggregated")).unionByName(unsafe.withColumn("join", F.lit("raw")))


# --- metrics -----------------------------------------------------------------------------------------


def _metric(spark, d, metric: str, *dimensions: str, **options) -> DataFrame:
    dated = bool(options.get("date_column"))
    return metrics.run(src(spark, d, with_dates=dated), MetricRequest(metric, dimensions=dimensions, **options))


for _name in ("mrr", "gross_mrr", "net_mrr"):
    QUERIES[f"metric_{_name}"] = lambda spark, d, n=_name: _metric(spark, d, n, "customer_segment", pattern="group_by")
for _name in ("billed_revenue", "invoice_count", "discount_amount", "outstanding_amount", "collection_rate"):
    QUERIES[f"metric_{_name}"] = lambda spark, d, n=_name: _metric(
        spark, d, n, "invoice_month", "customer_segment", pattern="group_by"
    )
for _name in ("collected_revenue", "refund_amount"):
    QUERIES[f"metric_{_name}"] = lambda spark, d, n=_name: _metric(
        spark, d, n, "payment_month", "customer_segment", pattern="group_by"
    )
for _name in ("customer", "customer_name", "customer_segment", "plan", "plan_name", "invoice_month"):
    QUERIES[f"dim_{_name}"] = lambda spark, d, n=_name: _metric(spark, d, "billed_revenue", n, pattern="group_by")


@query("dim_payment_month")
def _(spark, d):
    return _metric(spark, d, "collected_revenue", "payment_month", pattern="group_by")


@query("metric_group_by")
def _(spark, d):
    return _metric(spark, d, "collected_revenue", "customer_segment", "plan_name", pattern="group_by")


@query("metric_top_k")
def _(spark, d):
    return _metric(spark, d, "mrr", "customer", "customer_segment", pattern="top_k", default_filters=False)


@query("metric_total")
def _(spark, d):
    hit = _metric(spark, d, "billed_revenue", month="1997-05")
    miss = _metric(spark, d, "billed_revenue", month="2026-05")
    return hit.withColumn("month", F.lit("1997-05")).unionByName(miss.withColumn("month", F.lit("2026-05")))


@query("metric_count")
def _(spark, d):
    return _metric(spark, d, "invoice_count", pattern="count", phrase="last_quarter")


@query("time_phrases_month_key")
def _(spark, d):
    names = ("last_month", "this_month", "this_quarter", "last_quarter", "all_time")
    return profile.union_all(
        [_metric(spark, d, "billed_revenue", phrase=n).withColumn("phrase", F.lit(n)) for n in names]
    )


@query("time_phrases_date")
def _(spark, d):
    names = ("last_month", "this_month", "last_30_days", "this_quarter", "last_quarter")
    return profile.union_all(
        [
            _metric(spark, d, "collected_revenue", phrase=n, date_column="payment_date").withColumn("phrase", F.lit(n))
            for n in names
        ]
    )


@query("rolling_days_rows")
def _(spark, d):
    orders = adapters.parquet(spark, d, "orders")
    return in_date_phrase(orders, "o_orderdate", fixed.TIME_PHRASES["last_30_days"]).select(
        "o_orderkey", "o_orderdate", "o_totalprice"
    )


@query("month_filter")
def _(spark, d):
    invoices = adapters.stripe_invoices(spark, d, with_dates=True)
    return _money(metrics.month_filter(invoices, "invoice_month", "1997-05", "invoice_date"))


@query("direct_sql")
def _(spark, d):
    text = """
        WITH paying AS (SELECT * FROM fact_subscriptions WHERE mrr_amount > 0)
        SELECT c.customer_segment, p.plan_name, CAST(SUM(s.mrr_amount) AS DOUBLE) AS total_mrr
        FROM paying s
        JOIN dim_customers c ON c.customer_id = s.customer_id
        JOIN dim_plans p ON p.plan_id = s.plan_id
        GROUP BY c.customer_segment, p.plan_name
    """
    return tables.guarded_sql(spark, text, src(spark, d))


@query("min_max_amount")
def _(spark, d):
    return metrics.amount_range(adapters.stripe_payments(spark, d))


@query("monthly_stats")
def _(spark, d):
    return metrics.monthly_stats(adapters.stripe_invoices(spark, d))


@query("collected_by_month")
def _(spark, d):
    return _metric(spark, d, "collected_revenue", "payment_month", pattern="group_by",
                   default_filters=False).orderBy("payment_month")


@query("refund_by_month")
def _(spark, d):
    return _metric(spark, d, "refund_amount", "payment_month", pattern="group_by",
                   default_filters=False).orderBy("payment_month")


@query("discount_by_month")
def _(spark, d):
    return _metric(spark, d, "discount_amount", "invoice_month", pattern="group_by",
                   default_filters=False).orderBy("invoice_month")


@query("net_mrr_by_segment")
def _(spark, d):
    return metrics.net_mrr_by_segment(src(spark, d))


@query("ambiguous_metric_group")
def _(spark, d):
    return metrics.ambiguous_groups(src(spark, d))


# --- models ------------------------------------------------------------------------------------------


@query("stg_generic")
def _(spark, d):
    spec = fixed.MONTHLY_MARTS["collected_revenue"]
    return _money(m.project(adapters.stripe_payments(spark, d), spec.staging_columns, fixed.STRIPE_PAYMENTS))


@query("mart_monthly_metric")
def _(spark, d):
    spec = replace(fixed.MONTHLY_MARTS["billed_revenue"], value_column="discount_amount",
                   output_metric="discounts", coalesce_value=False)
    return m.monthly_metric(adapters.stripe_invoices(spark, d), spec)


@query("mart_billing__monthly_invoice_revenue")
def _(spark, d):
    return _monthly(spark, d, "billed_revenue")


@query("mart_payments__monthly_collected_revenue")
def _(spark, d):
    return _monthly(spark, d, "collected_revenue")


def _product(spark, d, product: str, model: str, variant: str = "gross_and_net") -> DataFrame:
    return staged.product(spark, src(spark, d), product, application_folder(spark, "staged"), variant)[model]


@query("stg_clean")
def _(spark, d):
    return _money(m.clean(adapters.stripe_payments(spark, d), fixed.STRIPE_PAYMENTS))


@query("int_subscription__mrr_adjustments")
def _(spark, d):
    return _money(_product(spark, d, "subscription_revenue_360", "int_subscription__mrr_adjustments"))


def revenue_mart(spark, d, variant: str = "gross_and_net") -> DataFrame:
    return _product(spark, d, "subscription_revenue_360", "mart_subscription__revenue_360_monthly", variant)


QUERIES["mart_subscription__revenue_360_monthly"] = revenue_mart
for _variant in m.REVENUE_COLUMNS:
    QUERIES[f"revenue_360_{_variant}"] = lambda spark, d, v=_variant: revenue_mart(spark, d, v)

for _mart, _of in (
    ("mart_billing__invoice_reconciliation", "stripe_billing_reconciliation"),
    ("collection_gap_monthly", "stripe_billing_reconciliation"),
    ("mart_billing__collection_health_monthly", "subscription_collection_health"),
    ("mart_billing__monthly_reconciliation", "subscription_collection_health"),
):
    QUERIES[_mart] = lambda spark, d, p=_of, n=_mart: _product(spark, d, p, n)


@query("mart_subscription__monthly_mrr")
def _(spark, d):
    return _product(spark, d, "fact_subscriptions", "mart_subscription__monthly_mrr")


@query("dim_customers_clean")
def _(spark, d):
    return _product(spark, d, "dim_customers", "dim_customers_clean")


@query("dim_plans_clean")
def _(spark, d):
    return _product(spark, d, "dim_plans", "dim_plans_clean")


@query("mart_payments__collections")
def _(spark, d):
    return _money(_product(spark, d, "stripe_payments", "mart_payments__collections"))


def _model_texts(spark, d) -> DataFrame:
    """One text piece per order line: the order's model reads a part model twice and a supplier table."""
    lines = adapters.parquet(spark, d, "lineitem")
    return lines.selectExpr(
        "concat('mart_order_', l_orderkey) as model",
        "l_linenumber as part",
        """concat("select * from {{ ref('int_part_", l_partkey, "') }} p join {{ source('demo', ", '"supplier_',
            l_suppkey, '") }} s using (k) ', "join ref( 'stg_line_", l_linenumber,
            "' ) l on true where exists (select 1 from {{ ref('int_part_", l_partkey, "') }})") as text""",
    )


@query("model_lineage")
def _(spark, d):
    return lineage.lineage(_model_texts(spark, d))


def model_graph(spark, d) -> tuple[DataFrame, DataFrame]:
    """Model edges derived from keys: order → customer → nation, line → order and part, part → brand."""
    orders, lines = adapters.parquet(spark, d, "orders"), adapters.parquet(spark, d, "lineitem")
    customer, part = adapters.parquet(spark, d, "customer"), adapters.parquet(spark, d, "part")

    def edge(df, child: str, child_key: str, parent: str, parent_key: str) -> DataFrame:
        return df.select(
            F.concat(F.lit(child), F.col(child_key)).alias("model"),
            F.concat(F.lit(parent), F.col(parent_key)).alias("parent"),
        )

    edges = profile.union_all(
        [
            edge(customer, "int_customer_", "c_custkey", "stg_nation_", "c_nationkey"),
            edge(orders, "int_order_", "o_orderkey", "int_customer_", "o_custkey"),
            edge(part, "int_part_", "p_partkey", "stg_brand_", "p_brand"),
            edge(lines, "mart_supplier_", "l_suppkey", "int_order_", "l_orderkey"),
            edge(lines, "mart_supplier_", "l_suppkey", "int_part_", "l_partkey"),
        ]
    )
    models = edges.select(F.explode(F.array("model", "parent")).alias("model")).distinct()
    return edges, models


@query("model_levels")
def _(spark, d):
    edges, models = model_graph(spark, d)
    levels = lineage.model_levels(edges, models)
    return levels.select("model", F.col("level").cast("bigint").alias("level"),
                         lineage.model_tier().cast("bigint").alias("tier"))


PRODUCTS = {
    "subscription_revenue_360": ("mart_subscription__revenue_360_monthly",),
    "stripe_billing_reconciliation": ("mart_billing__invoice_reconciliation", "collection_gap_monthly"),
    "subscription_collection_health": (
        "mart_billing__collection_health_monthly", "mart_billing__monthly_reconciliation",
    ),
}


def _figures(df: DataFrame, product: str, model: str) -> DataFrame:
    """A mart as one row per key and figure."""
    keys = [c for c, t in df.dtypes if t not in ("double", "bigint") or c == "invoice_id"]
    figures = [c for c in df.columns if c not in keys]
    pairs = F.array(*[F.struct(F.lit(c).alias("figure"), F.col(c).cast("double").alias("value")) for c in figures])
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in keys])
    return df.select(F.lit(product).alias("product"), F.lit(model).alias("model"), key.alias("key"),
                     F.explode(pairs).alias("p")).select("product", "model", "key", "p.*")


@query("build_all_models")
def _(spark, d):
    """All products; they share the stored staging, so each source is cleaned once."""
    parts = []
    for product, marts in PRODUCTS.items():
        folder = run_folder(spark, "build")
        tables = src(spark, d)
        specs = staged.specs_of(spark, tables, product, application_folder(spark, "staged"))
        status = build.build_all(spark, tables, specs, folder)
        parts.append(
            status.select(
                F.lit(product).alias("product"), "model", F.coalesce("error", "status").alias("key"),
                F.lit("row_count").alias("figure"), F.col("row_count").cast("double").alias("value"),
            )
        )
        done = {r.model for r in status.where("status = 'completed'").collect()}
        parts += [_figures(spark.read.parquet(f"{folder}/{mart}"), product, mart) for mart in marts if mart in done]
    return profile.union_all(parts)


@query("rebuild_changed")
def _(spark, d):
    """Three builds of a product in one folder: with a broken source, with the source mended, and with fewer payments."""
    folder, specs, parts = run_folder(spark, "rebuild"), build.product_models("subscription_collection_health"), []
    tables = src(spark, d)
    payments = tables["stripe_payments"]
    for number, given in enumerate((payments.drop("refund_amount"), payments, payments.where("successful_amount > 1000"))):
        status = rebuild.rebuild(spark, {**tables, "stripe_payments": given}, specs, folder)
        parts.append(status.select(F.lit(number + 1).alias("build"), "model", "status", "reason", "row_count"))
    return profile.union_all(parts)


#: Models as SQL texts, in no order.
SQL_TEXTS = {
    "mart_billing__reconciliation_by_text": """
        SELECT i.invoice_id, CAST(invoice_amount AS DOUBLE) AS billed_amount,
          CAST(coalesce(collected, 0) AS DOUBLE) AS collected_amount, CAST(coalesce(refund, 0) AS DOUBLE) AS refund_amount,
          CAST(invoice_amount - coalesce(collected, 0) AS DOUBLE) AS reconciliation_difference
        FROM {{ ref('stg_text__invoices') }} i LEFT JOIN {{ ref("int_text__paid") }} p ON p.invoice_id = i.invoice_id""",
    "int_text__paid": """
        SELECT invoice_id, sum(successful_amount) AS collected, sum(refund_amount) AS refund
        FROM {{ ref('stg_text__payments') }} GROUP BY invoice_id""",
    "stg_text__payments": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY payment_id
          ORDER BY invoice_id, payment_month, successful_amount, refund_amount) AS place
          FROM {{ source('demo', 'stripe_payments') }}) WHERE place = 1""",
    "stg_text__invoices": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY invoice_id
          ORDER BY subscription_id, invoice_month, invoice_amount, discount_amount) AS place
          FROM {{ source('demo', 'stripe_invoices') }}) WHERE place = 1""",
}


@query("sql_text_models")
def _(spark, d):
    folder = run_folder(spark, "texts")
    texts = spark.createDataFrame(list(SQL_TEXTS.items()), "model string, text string")
    status = sql_models.build_texts(spark, texts, src(spark, d), folder)
    if failed := [r.error for r in status.collect() if r.error]:
        raise RuntimeError(failed[0])
    return spark.read.parquet(f"{folder}/mart_billing__reconciliation_by_text")


# --- data tests --------------------------------------------------------------------------------------


@query("test_not_null")
def _(spark, d):
    test = DataTest("t", "not_null", "stripe_invoices", ("discount_amount",))
    return dt.failing_rows(src(spark, d), test).select("invoice_id", "invoice_month")


@query("test_unique")
def _(spark, d):
    return dt.failing_rows(src(spark, d), DataTest("t", "unique", "stripe_payments", ("payment_id",)))


@query("test_accepted_values")
def _(spark, d):
    test = DataTest("t", "accepted_values", "fact_subscriptions", ("plan_id",), ("BUILDING", "MACHINERY"))
    return dt.failing_rows(src(spark, d), test).select("subscription_id", "plan_id")


@query("test_relationship")
def _(spark, d):
    test = DataTest("t", "relationship", "stripe_payments", ("invoice_id",), parent="stripe_invoices",
                    parent_columns=("invoice_id",))
    return dt.failing_rows(_with_gaps(spark, d), test).select("payment_id", "invoice_id", "payment_month")


OVERPAID = DataTest(
    "no_overpaid_invoices", "custom", "mart_billing__invoice_reconciliation",
    sql="SELECT invoice_id, reconciliation_difference FROM mart_billing__invoice_reconciliation "
        "WHERE reconciliation_difference < 0",
)


@query("test_custom_sql")
def _(spark, d):
    mart = _product(spark, d, "stripe_billing_reconciliation", OVERPAID.model)
    return dt.failing_rows({OVERPAID.model: mart}, OVERPAID)


@query("test_metrics_not_null")
def _(spark, d):
    live = src(spark, d)
    joined = live["stripe_invoices"].join(
        joins.payments_by_invoice(live["stripe_payments"]), "invoice_id", "left"
    ).select("invoice_id", "discount_amount", "collected_amount")
    test = dt.metrics_not_null("raw", ("discount_amount", "collected_amount"))
    return _money(dt.failing_rows({"raw": joined}, test))


@query("test_month_key")
def _(spark, d):
    orders = adapters.parquet(spark, d, "orders")
    rows = orders.select(
        "o_orderkey",
        F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_orderdate").cast("date").cast("string"))
        .when(F.col("o_orderpriority") != "1-URGENT", month_key("o_orderdate"))
        .alias("order_month"),
    )
    return dt.failing_rows({"rows": rows}, DataTest("t", "month_key", "rows", ("order_month",)))


@query("test_summary")
def _(spark, d):
    live = src(spark, d)
    live[OVERPAID.model] = _product(spark, d, "stripe_billing_reconciliation", OVERPAID.model)
    live["mart_subscription__revenue_360_monthly"] = revenue_mart(spark, d)
    tests = [t for n, c in fixed.CONTRACTS.items() for t in dt.contract_tests(n, c)]
    tests += dt.relationship_tests(fixed.RELATIONSHIPS)
    tests += [OVERPAID, dt.metrics_not_null("mart_subscription__revenue_360_monthly",
                                            ("gross_mrr", "discount_amount", "refund_amount", "net_mrr"))]
    return dt.summary(live, tests)


# --- text rules --------------------------------------------------------------------------------------


@query("text_normalize")
def _(spark, d):
    docs = adapters.parquet(spark, d, "documents")
    return docs.select("doc_id", text_rules.normalize(F.col("text")).alias("normalized"))


PROSE_RULES = (
    TextRule(
        "linked_prose", "q_linked_prose",
        all_any={"joining": ("and", "und", "et"), "endings": ("tion", "ung", "ment")},
        none_any={"secrets": ("password", "api key")},
        missing_explicit_choice=True,
        options=(RuleOption("by_mail", "By e-mail", ("mail to", "license")), RuleOption("by_phone", "By phone", ("tel",))),
    ),
    TextRule(
        "any_prose", "q_any_prose",
        any_any={"english": ("the ", " of "), "german": (" der ", "nicht"), "french": (" le ", "que")},
    ),
    TextRule("never", "q_never", all_any={"x": ("the",)}, enabled=False),
)


@query("rule_table_match")
def _(spark, d):
    docs = adapters.parquet(spark, d, "documents").select("doc_id", "text")
    return rule_tables.matches(docs, *rule_tables.as_tables(spark, PROSE_RULES), "doc_id").select("doc_id", "rule_id")


@query("rule_match")
def _(spark, d):
    docs = adapters.parquet(spark, d, "documents").withColumn("_t", text_rules.normalize(F.col("text")))
    return docs.select("doc_id", *[text_rules.rule_matches(F.col("_t"), r).alias(r.id) for r in PROSE_RULES])


@query("explicit_choice")
def _(spark, d):
    docs = adapters.parquet(spark, d, "documents")
    text = text_rules.normalize(F.col("text"))
    return docs.select("doc_id", text_rules.explicit_choice(text, PROSE_RULES[0]).alias("explicit"))


def _requests(spark, d) -> DataFrame:
    """One business request per order, worded from its columns."""
    o = adapters.parquet(spark, d, "orders")

    def pick(of: str, divisor: int, *words: str) -> Column:
        slot = (F.floor(F.col(of) / divisor) % len(words)).cast("int")
        return F.element_at(F.array(*[F.lit(w) for w in words]), slot + 1)

    return o.select(
        F.col("o_orderkey").alias("request_id"),
        F.col("o_custkey").alias("user_id"),
        F.concat_ws(
            " ",
            pick("o_orderkey", 1, "Please CREATE a", "Help me build", "Show", "draft the"),
            pick("o_orderkey", 4, "data-product", "data product", "pipeline!", "report", "models"),
            pick("o_custkey", 1, "for monthly revenue", "of refunds, not sure how", "by segment", "for discounts (unclear)"),
            pick("o_custkey", 4, "from Stripe", "from invoice data", "of payment rows", "by MRR", "with gross only"),
            F.lower("o_orderpriority"),
        ).alias("text"),
    )


def _answered(spark, d) -> DataFrame:
    """Orders that are finished count as answered: the first question for F, the second for P."""
    o = adapters.parquet(spark, d, "orders")
    return o.where(F.col("o_orderstatus").isin("F", "P")).select(
        F.col("o_orderkey").alias("request_id"),
        F.when(F.col("o_orderstatus") == "F", "q_revenue_definition")
        .otherwise("q_refund_discount_handling")
        .alias("question_id"),
    )


@query("first_rule_wins")
def _(spark, d):
    found = text_rules.first_rule(_requests(spark, d), fixed.CLARIFICATION_RULES, answered=_answered(spark, d))
    return found.select("request_id", "rule_id")


@query("first_rule_wins_prose")
def _(spark, d):
    talk = adapters.parquet(spark, d, "conversations").where(F.col("role") == "user")
    return text_rules.first_rule(talk, PROSE_RULES, key="conv_id").select("conv_id", "turn", "rule_id")


def _answers(spark, d) -> DataFrame:
    """One answer per order line, worded from its columns."""
    line = adapters.parquet(spark, d, "lineitem")
    size = F.col("l_quantity").cast("int")
    custom = (
        F.when(size % 7 == 0, "")
        .when(size % 7 == 1, "Use billed revenue from the invoices.")
        .when(size % 7 == 2, "gross and net, please")
        .when(size % 7 == 3, F.concat(F.lit("Treat returns as zero and  IGNORE part "), F.col("l_partkey").cast("string")))
        .when(size % 7 == 4, "no idea")
        .when(size % 7 == 5, "subtract discounts and refunds from gross mrr")
        .otherwise(F.concat(F.lit("Net "), F.col("l_returnflag"), F.lit(" MRR after "), F.lower("l_linestatus")))
    )
    part = F.col("l_partkey") % 5
    return line.select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("position"), F.col("l_partkey"),
        F.when(F.col("l_suppkey") % 3 == 0, "q_revenue_definition")
        .when(F.col("l_suppkey") % 3 == 1, "q_refund_discount_handling")
        .otherwise("q_other")
        .alias("question_id"),
        F.when(part == 0, "gross_only").when(part == 1, "net_mrr").when(part == 2, "").alias("selected_option_id"),
        custom.alias("custom_answer"),
    )


@query("answer_option_overlap")
def _(spark, d):
    answers = _answers(spark, d)
    text = text_rules.answer_text(F.col("custom_answer"))
    options = fixed.ADJUSTMENT_RULE.options
    scored = (
        answers.withColumn("_tokens", text_rules.tokens(text))
        .withColumn("_hits", text_rules.option_hits(F.col("_tokens"), options))
        .withColumns(text_rules.option_scores(F.col("_hits"), F.col("_tokens"), options, "s_"))
    )
    return scored.select(
        "run_id", "position", "l_partkey", *[F.round(f"s_{o.id}", 6).alias(o.id) for o in options],
        text_rules.best_option(options, "s_").alias("best_option"),
    )


@query("custom_rule_heuristic")
def _(spark, d):
    talk = adapters.parquet(spark, d, "conversations")
    return talk.select(
        "conv_id", "turn", text_rules.looks_like_rule(text_rules.answer_text(F.col("text"))).alias("is_rule")
    )


@query("answer_class")
def _(spark, d):
    return text_rules.classify_answers(_answers(spark, d), fixed.CLARIFICATION_RULES).select(
        "run_id", "position", "l_partkey", "question_id", "answer_type", "option_id"
    )


@query("latest_answer_per_question")
def _(spark, d):
    talk = adapters.parquet(spark, d, "conversations")
    return text_rules.latest_answers(talk, ["conv_id", "role"], ["turn"])


ALLOWED = ("the", "of", "and", "nicht", "der", "que", "le", "in")


@query("allowed_item_filter")
def _(spark, d):
    docs = adapters.parquet(spark, d, "documents")
    words = F.split(text_rules.normalize(F.col("text")), " ")
    return docs.select("doc_id", F.array_join(text_rules.allowed_items(words, ALLOWED), ",").alias("kept"))


@query("resolved_rules")
def _(spark, d):
    line = adapters.parquet(spark, d, "lineitem")
    answers = line.select(
        F.col("l_orderkey").alias("run_id"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("at"),
        F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber"), F.col("l_extendedprice"),
        F.concat(F.lit("q_Return--"), F.col("l_returnflag"), F.lit("!")).alias("question_id"),
    )
    return text_rules.resolved_rules(answers, "run_id", "at").drop("at")


@query("resolved_rules_forms")
def _(spark, d):
    """Keys that read like numbered forms of others: the line's flag, with none, one or two numbers behind."""
    number = F.pmod("l_partkey", F.lit(3))
    ending = F.when(number == 0, "").when(number == 1, "_2").otherwise("-2-2")
    answers = adapters.parquet(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min(F.struct("l_partkey", "l_returnflag")).alias("r")
    ).select("l_orderkey", "l_linenumber", "r.*")
    answers = answers.withColumn("question_id", F.concat(F.lit("q_Flag "), "l_returnflag", ending))
    return text_rules.resolved_rules(answers, "l_orderkey", "l_linenumber").select(
        "l_orderkey", "l_linenumber", "rule_key"
    )


# --- run events --------------------------------------------------------------------------------------


@query("event_seq")
def _(spark, d):
    return ev.with_sequence(adapters.run_events(spark, d)).select("run_id", "seq", "event_id", "type")


@query("events_after")
def _(spark, d):
    return ev.events_after(ev.with_sequence(adapters.run_events(spark, d)), 40).select("run_id", "seq", "event_id")


@query("events_resume")
def _(spark, d):
    sequenced = ev.with_sequence(adapters.run_events(spark, d))
    seen = sequenced.where(F.col("type") == "done").select("run_id", "seq")
    return ev.resume(sequenced, seen).select("run_id", "seq", "event_id")


@query("event_count")
def _(spark, d):
    return ev.event_counts(adapters.run_events(spark, d))


@query("agent_status")
def _(spark, d):
    return ev.agent_status(adapters.run_events(spark, d))


@query("agent_tree")
def _(spark, d):
    """Agents by the number of their tool call; agent n was started by agent (n - 1) div 3."""
    parent = F.when(F.col("tool_call_id") > 0, F.floor((F.col("tool_call_id") - 1) / 3))
    events = adapters.run_events(spark, d).withColumn("agent_id", F.concat(F.lit("agent_"), "tool_call_id"))
    return ev.agent_tree(events.withColumn("parent_id", F.concat(F.lit("agent_"), parent)))


@query("run_status")
def _(spark, d):
    return ev.run_status(adapters.run_events(spark, d))


@query("run_status_failed_terminal")
def _(spark, d):
    return ev.run_status(adapters.run_events(spark, d), failed_is_terminal=True)


@query("tool_pairs")
def _(spark, d):
    return ev.tool_pairs(adapters.run_events(spark, d))


@query("recent_activity")
def _(spark, d):
    return ev.recent_activity(adapters.run_events(spark, d))


@query("error_list")
def _(spark, d):
    return ev.error_list(adapters.run_events(spark, d))


def _log_lines(spark, d) -> DataFrame:
    """Step log lines worded from the events: tag, then JSON; and a line that is no step after each."""
    e = adapters.parquet(spark, d, "events")
    status = F.when(F.col("event_type") == "error", "failed").otherwise("completed")
    body = F.to_json(
        F.struct(
            F.col("user_id").alias("run_id"), F.col("event_type").alias("step_id"), F.lit("end").alias("event"),
            status.alias("status"), F.floor(F.col("value") * 10).alias("duration_ms"),
        )
    )
    return e.select(F.explode(F.array(F.concat(F.lit("[FLOW] "), body), F.lit("plain text"))).alias("line"))


@query("step_durations")
def _(spark, d):
    return ev.step_durations(ev.parse_log(_log_lines(spark, d)))


@query("log_compaction")
def _(spark, d):
    docs = adapters.parquet(spark, d, "documents").select("doc_id", "text")
    return ev.compact_text(docs, "text")


#: Events arrive in three deliveries, dealt by id, so their times interleave: the slots of each, and those sent twice in
#: it. Slots of an earlier delivery come again.
DELIVERIES = (((0, 1, 2, 3), (2,)), ((4, 0), ()), ((5, 3), ()))


def _deliver(spark, d, base: str, stop: int) -> None:
    """One delivery as the files of one folder, written in one job."""
    slots, twice = DELIVERIES[stop]
    slot = F.pmod("event_id", F.lit(6))
    events = adapters.parquet(spark, d, "events").select(*stream.EVENT_SCHEMA.names).where(slot.isin(*slots))
    copies = F.when(slot.isin(*twice), 2).otherwise(1) if twice else F.lit(1)
    copied = events.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), copies))).drop("_copy")
    copied.write.parquet(f"{base}/in/{stop}")


def _land(spark, base: str, land) -> tuple[DataFrame, stream.Landing]:
    """Go on from the checkpoint with what has been delivered since."""
    events = stream.run_event_stream(spark, f"{base}/in", pattern="*.parquet")
    return land(events, f"{base}/table", f"{base}/state"), stream.Landing(spark, events.schema, f"{base}/table")


def _landed(spark, d, name: str, land) -> tuple[DataFrame, stream.Landing, str]:
    """Land all deliveries, stopping after each."""
    base = run_folder(spark, name)
    for stop in range(len(DELIVERIES)):
        _deliver(spark, d, base, stop)
        landed, landing = _land(spark, base, land)
    return landed, landing, base


@query("stream_ingest")
def _(spark, d):
    landed, _, _ = _landed(spark, d, "ingest", stream.append_table)
    return landed.groupBy("run_id", "type").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("event_id").alias("ids"), F.max("ts").alias("last_ts")
    )


@query("stream_dedup")
def _(spark, d):
    landed, _, _ = _landed(spark, d, "dedup", stream.append_unique)
    return landed.groupBy("run_id", "type").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("event_id").alias("ids")
    )


def _live(spark, d, name: str, state, keys: list[str]) -> DataFrame:
    _, landing, base = _landed(spark, d, name, stream.append_unique)
    return stream.live_table(state(stream.landed_stream(landing)), keys, f"{base}/live", f"{base}/live_state")


@query("stream_agent_status")
def _(spark, d):
    return _live(spark, d, "status", stream.live_agent_status, ["run_id", "agent_id"])


@query("stream_tool_pairs")
def _(spark, d):
    return _live(spark, d, "tools", stream.live_tool_pairs, ["run_id", "agent_id", "tool_call_id"])


#: A call is closed after so long without an event; events may come so much later than newer ones.
CALL_BOUNDS = ("2 days", "5 days")


@query("stream_tool_closed")
def _(spark, d):
    """Calls that are closed, by deliveries of ten days; every seventh event of a delivery's last two days is late."""
    base = run_folder(spark, "closed")
    events = adapters.parquet(spark, d, "events").select(*stream.EVENT_SCHEMA.names)
    part = F.least(F.lit(2), F.floor((F.dayofmonth("ts") - 1) / 10))
    late = (F.pmod("event_id", F.lit(7)) == 0) & ((F.dayofmonth("ts") - 1) % 10 >= 8) & (part < 2)
    stop = F.when(late, part + 1).otherwise(part)
    for number in range(3):
        events.where(stop == number).write.parquet(f"{base}/in/{number}")
        feed = stream.run_event_stream(spark, f"{base}/in", pattern="*.parquet")
        closed = stream.append_closed(stream.closing_tool_pairs(feed, *CALL_BOUNDS), f"{base}/closed", f"{base}/state")
    return closed


@query("stream_resume")
def _(spark, d):
    """A reader with three stops: all of the first delivery, then the even runs of the second, then what is left."""
    base = run_folder(spark, "resume")
    nothing = spark.createDataFrame([], "run_id long, seq long")
    for stop in range(len(DELIVERIES)):
        _deliver(spark, d, base, stop)
        _, landing = _land(spark, base, stream.append_unique)
        had = stream.positions_of(spark.read.parquet(f"{base}/read")) if stop else nothing
        # The first batch has been read to the end, the second one hasn't.
        new = stream.events_from(landing.events(after=-1 if stop == 0 else 0), had)
        if stop == 1:
            new = new.where(F.col("run_id") % 2 == 0)
        new.withColumn("stop", F.lit(stop + 1)).write.mode("append").parquet(f"{base}/read")
    return spark.read.parquet(f"{base}/read").select("stop", "run_id", "seq", "event_id", "type")
