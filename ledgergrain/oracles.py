"""SQL equivalents of the registered queries, over the raw tables."""

from __future__ import annotations

from ledgergrain import fixed_values as fixed

ORACLES: dict[str, str] = {}

VIEWS = """WITH RECURSIVE
dim_customers AS (SELECT n_nationkey AS customer_id, n_name AS customer_name, CASE r_name WHEN 'AFRICA' THEN 'enterprise'
  WHEN 'AMERICA' THEN 'mid_market' WHEN 'ASIA' THEN 'startup' WHEN 'EUROPE' THEN 'self_serve' ELSE r_name END AS customer_segment
  FROM nation JOIN region ON n_regionkey = r_regionkey),
dim_plans AS (SELECT DISTINCT c_mktsegment AS plan_id, lower(c_mktsegment) AS plan_name FROM customer),
fact_subscriptions AS (SELECT c_custkey AS subscription_id, c_nationkey AS customer_id, c_mktsegment AS plan_id,
  CAST(c_acctbal AS DECIMAL(18,2)) AS mrr_amount FROM customer),
stripe_invoices AS (SELECT o_orderkey AS invoice_id, o_custkey AS subscription_id,
  strftime(o_orderdate, '%Y-%m') AS invoice_month, CAST(o_totalprice AS DECIMAL(18,2)) AS invoice_amount,
  CASE WHEN o_orderpriority = '1-URGENT' THEN NULL
       WHEN o_orderpriority = '2-HIGH' THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.05 AS DECIMAL(3,2)) AS DECIMAL(18,2))
       ELSE CAST(0 AS DECIMAL(18,2)) END AS discount_amount,
  o_orderdate AS invoice_date FROM orders),
stripe_payments AS (SELECT l_orderkey || '-' || l_linenumber AS payment_id, l_orderkey AS invoice_id,
  strftime(l_shipdate, '%Y-%m') AS payment_month, CAST(l_extendedprice AS DECIMAL(18,2)) AS successful_amount,
  CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END AS refund_amount,
  l_shipdate AS payment_date FROM lineitem),
paid AS (SELECT invoice_id, SUM(successful_amount) AS collected_amount, SUM(refund_amount) AS refund_amount,
  COUNT(*) AS payment_count FROM stripe_payments GROUP BY invoice_id),
inv AS (SELECT i.invoice_id, i.subscription_id, i.invoice_month, i.invoice_amount, i.discount_amount,
  COALESCE(p.collected_amount, 0) AS collected_amount, COALESCE(p.refund_amount, 0) AS refund_amount,
  COALESCE(p.payment_count, 0) AS payment_count FROM stripe_invoices i LEFT JOIN paid p ON p.invoice_id = i.invoice_id),
gaps AS (SELECT l_orderkey || '-' || l_linenumber AS payment_id,
  CASE WHEN l_returnflag = 'N' THEN l_orderkey WHEN l_linestatus = 'F' THEN -l_orderkey - 1 END AS invoice_id,
  strftime(l_shipdate, '%Y-%m') AS payment_month, CAST(l_extendedprice AS DECIMAL(18,2)) AS successful_amount FROM lineitem),
ev AS (SELECT event_id, user_id AS run_id, ts, value,
  CASE WHEN event_type = 'signup' THEN 'session_started' WHEN event_type = 'view' THEN 'tool_started'
       WHEN event_type = 'click' THEN 'tool_completed'
       WHEN event_type = 'purchase' AND k % 3 = 0 THEN 'done' WHEN event_type = 'purchase' AND k % 3 = 1 THEN 'ask_user'
       WHEN event_type = 'purchase' THEN 'artifact_created' ELSE event_type END AS type,
  'agent_' || (k % 4) AS agent_id, k AS tool_call_id
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)),
seqd AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS seq FROM ev)
"""


def add(name: str, sql: str, more: str = "") -> None:
    ORACLES[name] = VIEWS + (", " + more + "\n" if more else "") + sql


SOURCES = ("dim_customers", "dim_plans", "fact_subscriptions", "stripe_invoices", "stripe_payments")
COLUMNS = {
    "dim_customers": ("customer_id", "customer_name", "customer_segment"),
    "dim_plans": ("plan_id", "plan_name"),
    "fact_subscriptions": ("subscription_id", "customer_id", "plan_id", "mrr_amount"),
    "stripe_invoices": ("invoice_id", "subscription_id", "invoice_month", "invoice_amount", "discount_amount"),
    "stripe_payments": ("payment_id", "invoice_id", "payment_month", "successful_amount", "refund_amount"),
}
RAW_TYPES = {
    "dim_customers": ("int", "string", "string"),
    "dim_plans": ("string", "string"),
    "fact_subscriptions": ("bigint", "int", "string", "decimal(18,2)"),
    "stripe_invoices": ("bigint", "bigint", "string", "decimal(18,2)", "decimal(18,2)"),
    "stripe_payments": ("string", "bigint", "string", "decimal(18,2)", "decimal(18,2)"),
}
BUCKETS = {"int": "integer", "bigint": "integer", "string": "text", "decimal(18,2)": "real"}


def cells(template) -> str:
    """One SELECT per contract column."""
    return " UNION ALL ".join(
        template(s, c, RAW_TYPES[s][i]) for s in SOURCES for i, c in enumerate(COLUMNS[s])
    )


INVOICE_ROW = (
    "invoice_id, subscription_id, invoice_month, CAST(invoice_amount AS DOUBLE) AS invoice_amount, "
    "CAST(discount_amount AS DOUBLE) AS discount_amount"
)
PAYMENT_ROW = (
    "payment_id, invoice_id, payment_month, CAST(successful_amount AS DOUBLE) AS successful_amount, "
    "CAST(refund_amount AS DOUBLE) AS refund_amount"
)

# Sources and sinks.
add("scan_table", f"SELECT {INVOICE_ROW} FROM stripe_invoices")
add("table_exists", " UNION ALL ".join(
    [f"SELECT 'lg_{s}' AS table_name, TRUE AS present, COUNT(*) AS row_count FROM {s}" for s in SOURCES]
    + ["SELECT 'lg_missing', FALSE, CAST(NULL AS BIGINT)"]))
add("sample_rows", f"SELECT {PAYMENT_ROW} FROM stripe_payments "
    "ORDER BY payment_id, successful_amount, payment_month, refund_amount LIMIT 2")
add("preview_table", f"SELECT {INVOICE_ROW}, (SELECT COUNT(*) FROM stripe_invoices) AS total_rows "
    "FROM stripe_invoices ORDER BY invoice_id LIMIT 50")
BILLED = "SELECT invoice_month, CAST(SUM(COALESCE(invoice_amount, 0)) AS DOUBLE) AS billed_revenue FROM stripe_invoices GROUP BY 1"
COLLECTED = "SELECT payment_month, CAST(SUM(COALESCE(successful_amount, 0)) AS DOUBLE) AS collected_revenue FROM stripe_payments GROUP BY 1"
add("sink_mart_table", "SELECT *, (SELECT COUNT(*) FROM b) AS written_rows FROM b", f"b AS ({BILLED})")
add("sink_csv", "SELECT *, (SELECT COUNT(*) FROM c) AS written_rows FROM c", f"c AS ({COLLECTED})")
add("sink_all_marts",
    "SELECT 'mart_billing__monthly_invoice_revenue' AS table_name, COUNT(*) AS row_count FROM b "
    "UNION ALL SELECT 'mart_payments__monthly_collected_revenue', COUNT(*) FROM c", f"b AS ({BILLED}), c AS ({COLLECTED})")
add("list_marts",
    "SELECT 'mart_billing__monthly_invoice_revenue' AS table_name, COUNT(*) AS row_count, 'invoice_month,billed_revenue' AS columns FROM b "
    "UNION ALL SELECT 'mart_payments__monthly_collected_revenue', COUNT(*), 'payment_month,collected_revenue' FROM c",
    f"b AS ({BILLED}), c AS ({COLLECTED})")


def _declared(s: str, c: str):
    return fixed.CONTRACTS[s].column(c)


add("source_contract_load", cells(
    lambda s, c, t: f"SELECT '{s}' AS source, '{c}' AS \"column\", '{_declared(s, c).type}' AS type, "
    f"{_declared(s, c).nullable} AS nullable, {_declared(s, c).primary_key} AS primary_key, "
    f"COUNT(*) - COUNT({c}) AS null_count, COUNT(*) AS total_rows FROM {s}"))
add("rebuild_if_schema_drift",
    "SELECT 'dim_customers' AS source, 'missing_table' AS state, TRUE AS rebuild_needed, CAST(NULL AS BIGINT) AS row_count "
    "UNION ALL SELECT 'dim_plans', CASE WHEN COUNT(*) = 0 THEN 'empty_table' ELSE 'ok' END, COUNT(*) = 0, COUNT(*) FROM dim_plans WHERE length(plan_id) = 0 "
    "UNION ALL SELECT 'stripe_invoices', 'changed_columns', TRUE, COUNT(*) FROM stripe_invoices "
    "UNION ALL SELECT 'fact_subscriptions', CASE WHEN COUNT(*) = 0 THEN 'empty_table' ELSE 'ok' END, COUNT(*) = 0, COUNT(*) FROM fact_subscriptions "
    "UNION ALL SELECT 'stripe_payments', CASE WHEN COUNT(*) = 0 THEN 'empty_table' ELSE 'ok' END, COUNT(*) = 0, COUNT(*) FROM stripe_payments")

# Profiling.
add("profile_row_count", " UNION ALL ".join(f"SELECT '{s}' AS source, COUNT(*) AS row_count FROM {s}" for s in SOURCES))
add("profile_columns", cells(
    lambda s, c, t: f"SELECT '{s}' AS source, '{c}' AS \"column\", '{t}' AS raw_type, '{BUCKETS[t]}' AS normalized_type, "
    f"{not _declared(s, c).nullable} AS not_null, {_declared(s, c).primary_key} AS primary_key, COUNT({c}) AS filled_rows FROM {s}"))
NULL_RATES = cells(
    lambda s, c, t: f"SELECT '{s}' AS source, '{c}' AS \"column\", COUNT(*) - COUNT({c}) AS null_count, COUNT(*) AS total_rows, "
    f"round(CAST(COUNT(*) - COUNT({c}) AS DOUBLE) / COUNT(*), 4) AS null_rate FROM {s}")
add("profile_null_rates", NULL_RATES)
add("profile_distinct_values",
    "SELECT 'fact_subscriptions' AS source, 'plan_id' AS \"column\", plan_id AS value, COUNT(*) AS row_count FROM fact_subscriptions GROUP BY plan_id "
    "UNION ALL SELECT 'dim_customers', 'customer_segment', customer_segment, COUNT(*) FROM dim_customers GROUP BY customer_segment")


def _state(column: str, text: bool) -> str:
    """Exact figures of a column; the sketches are within their bounds."""
    low, high = f"MIN({column})", f"MAX({column})"
    bounds = f"{low} AS low, {high} AS high, NULL::DOUBLE AS low_number, NULL::DOUBLE AS high_number" if text else (
        f"NULL::VARCHAR AS low, NULL::VARCHAR AS high, {low}::DOUBLE AS low_number, {high}::DOUBLE AS high_number")
    median = "TRUE" if column == "o_totalprice" else "NULL::BOOLEAN"
    return (f"SELECT '{column}' AS column, COUNT(*) AS row_count, COUNT(*) - COUNT({column}) AS null_count, {bounds}, "
            f"TRUE AS distinct_within, {median} AS median_within FROM orders")


add("profile_state", " UNION ALL ".join(
    _state(c, c == "o_orderpriority") for c in ("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")))
add("profile_month_range",
    "SELECT 'stripe_invoices' AS source, 'invoice_month' AS \"column\", MIN(invoice_month) AS first_month, MAX(invoice_month) AS last_month, "
    "COUNT(DISTINCT invoice_month) AS months, COUNT(*) AS row_count FROM stripe_invoices "
    "UNION ALL SELECT 'stripe_payments', 'payment_month', MIN(payment_month), MAX(payment_month), COUNT(DISTINCT payment_month), COUNT(*) FROM stripe_payments")


def _type_mismatches():
    for s in SOURCES:
        for c, t in zip(COLUMNS[s], RAW_TYPES[s], strict=True):
            if BUCKETS[t] != _declared(s, c).type:
                yield s, c, _declared(s, c).type, BUCKETS[t]


KEYS = {s: COLUMNS[s][0] for s in SOURCES}
MET = "metric_logic,sql_model,data_tests"
RULE = "metric_logic,sql_model,documentation"


def _finding(s, id, kind, severity, column, holds, affects, keys) -> str:
    col = f"'{column}'" if column else "CAST(NULL AS VARCHAR)"
    return (
        f"SELECT '{s}' AS source, '{s}__{id}' AS id, '{kind}' AS type, '{severity}' AS severity, {col} AS \"column\", "
        f"'{affects}' AS affects, '{keys}' AS keys WHERE {holds}"
    )


def _all_findings() -> str:
    rows = [
        _finding(s, f"issue_type_mismatch_{c}", "type_mismatch", "optional_review", c,
                 f"(SELECT COUNT(*) FROM {s}) > 0", "sql_model,data_tests", "")
        for s, c, _, _ in _type_mismatches()
    ]
    for s in SOURCES:
        k = KEYS[s]
        dup = f"EXISTS (SELECT {k} FROM {s} WHERE {k} IS NOT NULL GROUP BY {k} HAVING COUNT(*) > 1)"
        rows.append(_finding(s, f"issue_{k}_duplicates", "duplicate_key", "must_answer", k, dup, MET, "duplicate_key_count"))
        rows.append(_finding(s, f"finding_{k}_unique", "uniqueness", "info", k, f"NOT {dup}", "documentation", ""))
        for c in COLUMNS[s]:
            if not _declared(s, c).nullable:
                rows.append(_finding(s, f"issue_{c}_required_nulls", "required_column_nulls", "must_answer", c,
                                     f"(SELECT COUNT(*) - COUNT({c}) FROM {s}) > 0", "data_tests", "null_count,null_rate"))
    rows.append(_finding("dim_customers", "issue_customer_segment_invalid_values", "invalid_values", "must_answer",
                         "customer_segment",
                         "EXISTS (SELECT 1 FROM dim_customers WHERE customer_segment NOT IN ('enterprise','mid_market','startup','self_serve'))",
                         "sql_model,data_tests,documentation", "invalid_count,invalid_value_count"))
    rows.append(_finding("stripe_invoices", "issue_discount_amount_null_rate", "business_rule_needed", "must_answer",
                         "discount_amount",
                         "(SELECT CAST(COUNT(*) - COUNT(discount_amount) AS DOUBLE) / COUNT(*) FROM stripe_invoices) >= 0.10",
                         RULE, "null_count,null_rate"))
    rows.append(_finding("stripe_payments", "issue_refund_handling_needed", "business_rule_needed", "must_answer",
                         "refund_amount", "(SELECT COUNT(*) FROM stripe_payments WHERE COALESCE(refund_amount, 0) > 0) > 0",
                         RULE, ""))
    return "found AS (" + " UNION ALL ".join(rows) + ")"


FOUND = _all_findings()
add("profile_multi_source", 'SELECT source, id, type, severity, "column", affects FROM found', FOUND)
add("missing_and_extra_columns",
    "SELECT 'stripe_invoices' AS source, 'missing' AS difference, 'discount_amount' AS \"column\", COUNT(*) AS row_count FROM orders "
    "UNION ALL SELECT 'stripe_invoices', 'extra', 'invoice_date', COUNT(*) FROM orders")


def _nodes() -> str:
    rows = []
    for c in fixed.CATALOG:
        metrics = ",".join(m.name for m in fixed.METRICS.values() if m.base_source == c.name)
        dimensions = ",".join(x.name for x in fixed.DIMENSIONS.values() if x.source == c.name)
        products = ",".join(p for p, used in fixed.DATA_PRODUCTS.items() if c.name in used)
        rows.append(
            f"SELECT '{c.name}' AS source, '{c.role}' AS role, '{c.entity}' AS entity, '{c.grain}' AS grain, "
            f"'{c.primary_key}' AS primary_key, '{metrics}' AS metrics, '{dimensions}' AS dimensions, "
            f"'{products}' AS products, COUNT(*) AS row_count FROM {c.name}"
        )
    return " UNION ALL ".join(rows)


add("schema_graph_nodes", _nodes())
add("schema_graph_edges", " UNION ALL ".join(
    [
        f"SELECT '{r.id}' AS id, '{r.left_source}' AS from_source, '{r.right_source}' AS to_source, '{r.left_key}' AS from_column, "
        f"'{r.right_key}' AS to_column, 'one_to_many' AS relationship_type, (SELECT COUNT(*) FROM {r.left_source}) AS from_rows, "
        f"(SELECT COUNT(*) FROM {r.right_source}) AS to_rows, FALSE AS warning"
        for r in fixed.RELATIONSHIPS
    ]
    + ["SELECT 'invoices_to_disputes', 'stripe_invoices', 'stripe_disputes', 'invoice_id', 'invoice_id', 'one_to_many', "
       "(SELECT COUNT(*) FROM stripe_invoices), CAST(NULL AS BIGINT), TRUE"]))
add("schema_graph_summary",
    "SELECT role, string_agg(source, ',' ORDER BY source) AS sources, COUNT(*) AS source_count, CAST(SUM(row_count) AS BIGINT) AS row_count, "
    "CAST(5 AS BIGINT) AS table_count, CAST(4 AS BIGINT) AS relationship_count, CAST(10 AS BIGINT) AS metric_count, "
    "CAST(7 AS BIGINT) AS dimension_count, CAST(3 AS BIGINT) AS product_count FROM nodes GROUP BY role", f"nodes AS ({_nodes()})")

# Contract quality checks.
add("dq_empty_table",
    "SELECT 'negative' AS \"table\", 'issue_empty_table' AS id, 'must_answer' AS severity, CAST(0 AS BIGINT) AS total_rows "
    "WHERE NOT EXISTS (SELECT 1 FROM stripe_invoices WHERE invoice_amount < 0) "
    "UNION ALL SELECT 'all', 'issue_empty_table', 'must_answer', CAST(0 AS BIGINT) WHERE NOT EXISTS (SELECT 1 FROM stripe_invoices)")
add("dq_missing_column",
    "SELECT 'issue_missing_column_discount_amount' AS id, 'must_answer' AS severity, 'discount_amount' AS \"column\", "
    "'real' AS expected_type, 'sql_model,data_tests,documentation' AS affects WHERE EXISTS (SELECT 1 FROM orders)")
add("dq_type_mismatch", " UNION ALL ".join(
    f"SELECT '{s}' AS source, 'issue_type_mismatch_{c}' AS id, 'optional_review' AS severity, '{c}' AS \"column\", "
    f"'{e}' AS expected_type, '{a}' AS actual_type WHERE EXISTS (SELECT 1 FROM {s})" for s, c, e, a in _type_mismatches()))
add("dq_extra_columns",
    "SELECT 'finding_extra_columns' AS id, 'info' AS severity, CAST(NULL AS VARCHAR) AS \"column\", 'invoice_date' AS extra_columns "
    "WHERE EXISTS (SELECT 1 FROM orders)")
add("dq_required_nulls",
    "SELECT 'issue_' || c || '_required_nulls' AS id, 'must_answer' AS severity, c AS \"column\", n AS null_count, t AS total_rows, "
    f"round(CAST(n AS DOUBLE) / t, 4) AS null_rate, CASE WHEN c LIKE '%amount' THEN '{MET}' WHEN c LIKE '%_id' THEN 'sql_model,data_tests' "
    "ELSE 'data_tests,documentation' END AS affects FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS c, COUNT(*) - COUNT({c}) AS n, COUNT(*) AS t FROM stripe_invoices"
                         for c in COLUMNS["stripe_invoices"]) + ") WHERE n > 0")


def _duplicates(s: str) -> str:
    k = KEYS[s]
    return (
        f"SELECT '{s}' AS source, CASE WHEN n > 0 THEN 'issue_{k}_duplicates' ELSE 'finding_{k}_unique' END AS id, "
        f"CASE WHEN n > 0 THEN 'duplicate_key' ELSE 'uniqueness' END AS type, CASE WHEN n > 0 THEN 'must_answer' ELSE 'info' END AS severity, "
        f"n AS duplicate_values, CASE WHEN n > 0 THEN n END AS duplicate_key_count, examples, total_rows FROM ("
        f"SELECT (SELECT COUNT(*) FROM {s}) AS total_rows, (SELECT COUNT(*) FROM d_{s}) AS n, "
        f"(SELECT string_agg(v || '=' || c, ',' ORDER BY c DESC, v) FROM (SELECT * FROM d_{s} ORDER BY c DESC, v LIMIT 10)) AS examples)"
    )


add("dq_duplicate_key", " UNION ALL ".join(_duplicates(s) for s in SOURCES), ", ".join(
    f"d_{s} AS (SELECT {KEYS[s]} AS v, COUNT(*) AS c FROM {s} WHERE {KEYS[s]} IS NOT NULL GROUP BY 1 HAVING COUNT(*) > 1)"
    for s in SOURCES))
add("dq_duplicate_key_rows",
    "SELECT payment_id AS value, COUNT(*) AS duplicate_count FROM stripe_payments GROUP BY 1 HAVING COUNT(*) > 1")


def _invalid(s: str, c: str, valid: str) -> str:
    return (
        f"SELECT CASE WHEN bad > 0 THEN 'issue_{c}_invalid_values' ELSE 'finding_{c}_accepted_values' END AS id, "
        "CASE WHEN bad > 0 THEN 'invalid_values' ELSE 'accepted_values' END AS type, "
        f"CASE WHEN bad > 0 THEN 'must_answer' ELSE 'info' END AS severity, '{c}' AS \"column\", "
        "CASE WHEN bad > 0 THEN kinds END AS invalid_value_count, CASE WHEN bad > 0 THEN bad END AS invalid_count, "
        "CASE WHEN bad = 0 THEN seen END AS observed_values FROM ("
        f"SELECT COUNT(*) FILTER ({c} NOT IN ({valid})) AS bad, COUNT(DISTINCT {c}) FILTER ({c} NOT IN ({valid})) AS kinds, "
        f"string_agg(DISTINCT {c}, ',' ORDER BY {c}) AS seen FROM {s})"
    )


add("dq_invalid_values",
    _invalid("dim_customers", "customer_segment", "'enterprise','mid_market','startup','self_serve'") + " UNION ALL "
    + _invalid("fact_subscriptions", "plan_id", "'BUILDING','AUTOMOBILE','MACHINERY','HOUSEHOLD','FURNITURE'"))
add("dq_invalid_value_rows",
    "SELECT plan_id AS value, COUNT(*) AS row_count FROM fact_subscriptions WHERE plan_id NOT IN ('BUILDING','MACHINERY') GROUP BY 1")
add("dq_min_value",
    "SELECT 'issue_invoice_amount_below_min_value' AS id, 'must_answer' AS severity, 'invoice_amount' AS \"column\", n AS affected_rows, t AS total_rows, "
    "'Rows that are empty or break invoice_amount >= 50000: ' || n || '.' AS message FROM ("
    "SELECT COUNT(*) FILTER (invoice_amount IS NULL OR invoice_amount < 50000) AS n, COUNT(*) AS t FROM stripe_invoices) WHERE n > 0 "
    "UNION ALL SELECT 'issue_discount_amount_below_min_value', 'optional_review', 'discount_amount', n, t, "
    "'Rows that are empty or break discount_amount > 0: ' || n || '.' FROM ("
    "SELECT COUNT(*) FILTER (discount_amount IS NULL OR discount_amount <= 0) AS n, COUNT(*) AS t FROM stripe_invoices) WHERE n > 0")
add("dq_max_column_value",
    "SELECT 'issue_invoice_amount_greater_than_discount_amount' AS id, 'optional_review' AS severity, 'invoice_amount' AS \"column\", "
    "n AS affected_rows, t AS total_rows FROM (SELECT COUNT(*) FILTER (invoice_amount > discount_amount) AS n, COUNT(*) AS t FROM stripe_invoices) WHERE n > 0")
add("dq_required_when",
    "SELECT 'issue_discount_amount_missing_when_invoice_month_1996-01' AS id, 'must_answer' AS severity, 'discount_amount' AS \"column\", "
    "n AS affected_rows, t AS total_rows FROM (SELECT COUNT(*) FILTER (invoice_month = '1996-01' AND discount_amount IS NULL) AS n, COUNT(*) AS t "
    "FROM stripe_invoices) WHERE n > 0")
add("dq_null_rate_decision",
    "SELECT 'issue_discount_amount_null_rate' AS id, 'must_answer' AS severity, 'discount_amount' AS \"column\", n AS null_count, t AS total_rows, "
    "round(CAST(n AS DOUBLE) / t, 4) AS null_rate, CAST(0.1 AS DOUBLE) AS decision_threshold FROM ("
    "SELECT COUNT(*) - COUNT(discount_amount) AS n, COUNT(*) AS t FROM stripe_invoices) WHERE CAST(n AS DOUBLE) / t >= 0.1")
add("dq_positive_adjustment",
    "SELECT 'issue_refund_handling_needed' AS id, 'must_answer' AS severity, 'refund_amount' AS \"column\", n AS affected_rows, t AS total_rows, "
    f"'{RULE}' AS affects FROM (SELECT COUNT(*) FILTER (COALESCE(refund_amount, 0) > 0) AS n, COUNT(*) AS t FROM stripe_payments) WHERE n > 0")
add("dq_default_affects",
    f"SELECT source, \"column\", total_rows, CASE WHEN \"column\" LIKE '%amount' THEN '{MET}' WHEN \"column\" LIKE '%_id' "
    "THEN 'sql_model,data_tests' ELSE 'data_tests,documentation' END AS affects FROM nr", f"nr AS ({NULL_RATES})")
add("dq_report", "SELECT severity, COUNT(*) AS finding_count, string_agg(id, ',' ORDER BY id) AS finding_ids FROM found GROUP BY severity", FOUND)
add("finding_counts", "SELECT severity, type, COUNT(*) AS finding_count FROM found GROUP BY GROUPING SETS ((severity), (type), ())", FOUND)
add("top_findings",
    "SELECT priority, source, id, type, severity, keys AS evidence_keys FROM (SELECT *, CASE severity WHEN 'must_answer' THEN 0 "
    "WHEN 'optional_review' THEN 3 ELSE 4 END AS priority FROM found) ORDER BY priority, source, id LIMIT 12", FOUND)

# Relationships and joins.
add("rel_missing_key",
    "SELECT 'invoices_to_payments_by_invoice_id' AS relationship_id, 'failed' AS status, (SELECT COUNT(*) FROM orders) AS left_rows, "
    "(SELECT COUNT(*) FROM lineitem) AS right_rows, 'invoices_to_payments_by_invoice_id__missing_join_key' AS finding_id, "
    "'must_answer' AS severity, 'Without key column: left True, right False.' AS message")


def _edge(r, right: str | None = None, left: str | None = None) -> str:
    l, rr, k = left or r.left_source, right or r.right_source, r.left_key
    coverage = "CAST(NULL AS BIGINT) AS partial_count, CAST(NULL AS BIGINT) AS overpaid_count, CAST(NULL AS BIGINT) AS fully_paid_count"
    if r.id.startswith("invoices"):
        p = f"(SELECT invoice_id, SUM(successful_amount) AS s FROM {rr} WHERE invoice_id IS NOT NULL GROUP BY 1)"
        join = f"FROM stripe_invoices i JOIN {p} p ON p.invoice_id = i.invoice_id WHERE i.invoice_amount > 0"
        coverage = (
            f"(SELECT COUNT(*) {join} AND s > 0 AND s < i.invoice_amount) AS partial_count, "
            f"(SELECT COUNT(*) {join} AND s > i.invoice_amount) AS overpaid_count, "
            f"(SELECT COUNT(*) {join} AND s = i.invoice_amount) AS fully_paid_count"
        )
    return (
        f"SELECT '{r.id}' AS relationship_id, CAST({r.max_unmatched_left_rate} AS DOUBLE) AS max_l, CAST({r.max_unmatched_right_rate} AS DOUBLE) AS max_r, "
        f"(SELECT COUNT(*) FROM {l}) AS left_rows, (SELECT COUNT(*) FROM {rr}) AS right_rows, "
        f"(SELECT COUNT(*) FROM (SELECT {k} FROM {l} WHERE {k} IS NOT NULL GROUP BY 1 HAVING COUNT(*) > 1)) AS left_duplicate_key_count, "
        f"(SELECT COUNT(*) FROM (SELECT {k} FROM {rr} WHERE {k} IS NOT NULL GROUP BY 1 HAVING COUNT(*) > 1)) AS right_duplicate_key_count, "
        f"(SELECT COUNT(*) FROM {rr} WHERE {k} IS NULL) AS right_null_key_count, "
        f"(SELECT COUNT(*) FROM {l} l WHERE l.{k} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {rr} r WHERE r.{k} = l.{k})) AS unmatched_left_count, "
        f"(SELECT COUNT(*) FROM {rr} r WHERE r.{k} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {l} l WHERE l.{k} = r.{k})) AS unmatched_right_count, "
        f"{coverage}"
    )


EDGES = "edges AS (" + " UNION ALL ".join(_edge(r) for r in fixed.RELATIONSHIPS) + ")"
GAP_EDGES = "edges AS (" + " UNION ALL ".join(
    _edge(r, right="gaps" if r.right_source == "stripe_payments" else None) for r in fixed.RELATIONSHIPS) + ")"
ANY = ("left_duplicate_key_count > 0 OR unmatched_left_count > 0 OR unmatched_right_count > 0 OR right_null_key_count > 0 "
       "OR COALESCE(partial_count, 0) > 0 OR COALESCE(overpaid_count, 0) > 0")
add("rel_duplicate_keys", "SELECT relationship_id, left_duplicate_key_count, right_duplicate_key_count FROM edges", EDGES)
add("rel_null_keys",
    "SELECT 'issue_unmatched_payments' AS id, CASE WHEN CAST(unmatched_right_count AS DOUBLE) / right_rows > max_r THEN 'must_answer' ELSE 'optional_review' END AS severity, "
    "CAST(NULL AS VARCHAR) AS \"column\", unmatched_right_count, round(CAST(unmatched_right_count AS DOUBLE) / right_rows, 4) AS unmatched_right_rate, "
    "right_null_key_count AS right_null_count, round(CAST(right_null_key_count AS DOUBLE) / right_rows, 4) AS right_null_rate, "
    "unmatched_right_count || ' rows of stripe_payments point to no row of stripe_invoices, and ' || right_null_key_count || ' have no key.' AS message "
    "FROM edges WHERE relationship_id LIKE 'invoices%'", GAP_EDGES)
add("rel_unmatched_left",
    f"SELECT {INVOICE_ROW} FROM stripe_invoices i WHERE NOT EXISTS (SELECT 1 FROM stripe_payments p WHERE p.invoice_id = i.invoice_id)")
add("rel_unmatched_right",
    "SELECT payment_id, invoice_id, payment_month, CAST(successful_amount AS DOUBLE) AS successful_amount FROM gaps g "
    "WHERE invoice_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM stripe_invoices i WHERE i.invoice_id = g.invoice_id)")
add("rel_severity", "SELECT relationship_id, id, type, severity FROM ("
    "SELECT relationship_id, relationship_id || '__left_key_duplicates' AS id, 'left_key_duplicates' AS type, 'must_answer' AS severity FROM edges WHERE left_duplicate_key_count > 0 "
    "UNION ALL SELECT relationship_id, CASE relationship_id WHEN 'customers_to_subscriptions' THEN 'issue_dim_customers_without_fact_subscriptions' "
    "WHEN 'plans_to_subscriptions' THEN 'issue_dim_plans_without_fact_subscriptions' WHEN 'subscriptions_to_invoices' THEN 'issue_fact_subscriptions_without_stripe_invoices' "
    "ELSE 'issue_unmatched_invoices' END, 'unmatched_left_records', CASE WHEN CAST(unmatched_left_count AS DOUBLE) / left_rows > max_l THEN 'must_answer' ELSE 'optional_review' END "
    "FROM edges WHERE unmatched_left_count > 0 "
    "UNION ALL SELECT relationship_id, CASE relationship_id WHEN 'customers_to_subscriptions' THEN 'issue_fact_subscriptions_without_dim_customers' "
    "WHEN 'plans_to_subscriptions' THEN 'issue_fact_subscriptions_without_dim_plans' WHEN 'subscriptions_to_invoices' THEN 'issue_stripe_invoices_without_fact_subscriptions' "
    "ELSE 'issue_unmatched_payments' END, 'unmatched_right_records', CASE WHEN CAST(unmatched_right_count AS DOUBLE) / right_rows > max_r THEN 'must_answer' ELSE 'optional_review' END "
    "FROM edges WHERE unmatched_right_count > 0 OR right_null_key_count > 0 "
    "UNION ALL SELECT relationship_id, 'issue_partial_or_overpaid_invoices', 'payment_coverage_anomaly', 'must_answer' FROM edges WHERE partial_count > 0 OR overpaid_count > 0)", GAP_EDGES)
add("rel_status",
    f"SELECT relationship_id, CASE WHEN relationship_id = 'plans_to_subscriptions' THEN 'failed' WHEN {ANY} THEN 'warning' ELSE 'passed' END AS status FROM edges", GAP_EDGES)
add("payment_coverage", "SELECT partial_count, overpaid_count, fully_paid_count FROM edges WHERE relationship_id LIKE 'invoices%'", EDGES)
add("rel_validate_all",
    f"SELECT relationship_id, CASE WHEN {ANY} THEN 'warning' ELSE 'passed' END AS status, left_rows, right_rows, left_duplicate_key_count, "
    "right_duplicate_key_count, right_null_key_count, unmatched_left_count, round(CAST(unmatched_left_count AS DOUBLE) / left_rows, 4) AS unmatched_left_rate, "
    "unmatched_right_count, round(CAST(unmatched_right_count AS DOUBLE) / right_rows, 4) AS unmatched_right_rate, partial_count, overpaid_count, fully_paid_count FROM edges", EDGES)
add("rel_composite_key",
    "SELECT 'lines_to_returns' AS relationship_id, CASE WHEN ul > 0 OR ur > 0 THEN 'warning' ELSE 'passed' END AS status, lr AS left_rows, rr AS right_rows, "
    "ld AS left_duplicate_key_count, rd AS right_duplicate_key_count, CAST(0 AS BIGINT) AS right_null_key_count, ul AS unmatched_left_count, "
    "round(CAST(ul AS DOUBLE) / lr, 4) AS unmatched_left_rate, ur AS unmatched_right_count, round(CAST(ur AS DOUBLE) / rr, 4) AS unmatched_right_rate FROM ("
    "SELECT CAST(SUM(l) AS BIGINT) AS lr, CAST(SUM(r) AS BIGINT) AS rr, COUNT(*) FILTER (l > 1) AS ld, COUNT(*) FILTER (r > 1) AS rd, "
    "CAST(SUM(CASE WHEN r = 0 THEN l ELSE 0 END) AS BIGINT) AS ul, CAST(SUM(CASE WHEN l = 0 THEN r ELSE 0 END) AS BIGINT) AS ur FROM ("
    "SELECT l_partkey, l_suppkey, COUNT(*) AS l, COUNT(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1, 2))")
add("join_inner_equi",
    "SELECT subscription_id, s.customer_id, customer_name, customer_segment, CAST(mrr_amount AS DOUBLE) AS mrr_amount FROM fact_subscriptions s "
    "JOIN dim_customers c ON c.customer_id = s.customer_id")
add("join_left_preagg",
    f"SELECT {INVOICE_ROW}, CAST(collected_amount AS DOUBLE) AS collected_amount, CAST(refund_amount AS DOUBLE) AS refund_amount, payment_count FROM inv")
CHAIN = ("stripe_payments p JOIN stripe_invoices i ON i.invoice_id = p.invoice_id JOIN fact_subscriptions s ON s.subscription_id = i.subscription_id "
         "JOIN dim_customers c ON c.customer_id = s.customer_id JOIN dim_plans pl ON pl.plan_id = s.plan_id")
add("join_chain_4",
    f"SELECT customer_segment, plan_name, COUNT(*) AS payments, CAST(SUM(successful_amount) AS DOUBLE) AS collected FROM {CHAIN} GROUP BY 1, 2")
add("fanout_guard",
    "SELECT n AS rows_before, n AS rows_after, CAST(t AS DOUBLE) AS total_before, CAST(t AS DOUBLE) AS total_after, TRUE AS preserved, 'preaggregated' AS \"join\" FROM b "
    "UNION ALL SELECT b.n, r.n, CAST(b.t AS DOUBLE), CAST(r.t AS DOUBLE), b.n = r.n AND b.t = r.t, 'raw' FROM b, "
    "(SELECT COUNT(*) AS n, SUM(invoice_amount) AS t FROM stripe_invoices i LEFT JOIN stripe_payments p ON p.invoice_id = i.invoice_id) r",
    "b AS (SELECT COUNT(*) AS n, SUM(invoice_amount) AS t FROM stripe_invoices)")

# Metrics.
SUBS = "fact_subscriptions s JOIN dim_customers c ON c.customer_id = s.customer_id"
INV = "inv i JOIN fact_subscriptions s ON s.subscription_id = i.subscription_id JOIN dim_customers c ON c.customer_id = s.customer_id"
add("metric_mrr", f"SELECT customer_segment, CAST(SUM(mrr_amount) AS DOUBLE) AS mrr FROM {SUBS} WHERE mrr_amount > 0 GROUP BY 1")
add("metric_gross_mrr", f"SELECT customer_segment, CAST(SUM(mrr_amount) AS DOUBLE) AS gross_mrr FROM {SUBS} WHERE mrr_amount > 0 GROUP BY 1")
ADJ = "adj AS (SELECT subscription_id, SUM(COALESCE(discount_amount, 0)) AS d, SUM(refund_amount) AS r FROM inv GROUP BY 1)"
add("metric_net_mrr",
    f"SELECT customer_segment, CAST(SUM(mrr_amount) - SUM(COALESCE(d, 0)) - SUM(COALESCE(r, 0)) AS DOUBLE) AS net_mrr FROM {SUBS} "
    "LEFT JOIN adj ON adj.subscription_id = s.subscription_id GROUP BY 1", ADJ)
BY = "invoice_month, customer_segment"
add("metric_billed_revenue", f"SELECT {BY}, CAST(SUM(invoice_amount) AS DOUBLE) AS billed_revenue FROM {INV} WHERE invoice_amount > 0 GROUP BY 1, 2")
add("metric_invoice_count", f"SELECT {BY}, COUNT(DISTINCT invoice_id) AS invoice_count FROM {INV} GROUP BY 1, 2")
add("metric_discount_amount", f"SELECT {BY}, CAST(SUM(COALESCE(discount_amount, 0)) AS DOUBLE) AS discount_amount FROM {INV} GROUP BY 1, 2")
add("metric_outstanding_amount", f"SELECT {BY}, CAST(SUM(invoice_amount) - SUM(collected_amount) AS DOUBLE) AS outstanding_amount FROM {INV} GROUP BY 1, 2")
add("metric_collection_rate",
    f"SELECT {BY}, CAST(SUM(collected_amount) AS DOUBLE) / NULLIF(CAST(SUM(invoice_amount) AS DOUBLE), 0) AS collection_rate FROM {INV} GROUP BY 1, 2")
add("metric_collected_revenue", f"SELECT payment_month, customer_segment, CAST(SUM(successful_amount) AS DOUBLE) AS collected_revenue FROM {CHAIN} WHERE successful_amount > 0 GROUP BY 1, 2")
add("metric_refund_amount", f"SELECT payment_month, customer_segment, CAST(SUM(refund_amount) AS DOUBLE) AS refund_amount FROM {CHAIN} WHERE refund_amount >= 0 GROUP BY 1, 2")
for _dim, _columns in (("customer", "c.customer_id, customer_name"), ("customer_name", "customer_name"), ("customer_segment", "customer_segment"),
                       ("plan", "pl.plan_id, plan_name"), ("plan_name", "plan_name"), ("invoice_month", "invoice_month")):
    add(f"dim_{_dim}", f"SELECT {_columns}, CAST(SUM(invoice_amount) AS DOUBLE) AS billed_revenue FROM {INV} JOIN dim_plans pl ON pl.plan_id = s.plan_id "
        f"WHERE invoice_amount > 0 GROUP BY {_columns}")
add("dim_payment_month", "SELECT payment_month, CAST(SUM(successful_amount) AS DOUBLE) AS collected_revenue FROM stripe_payments WHERE successful_amount > 0 GROUP BY 1")
add("metric_group_by", f"SELECT customer_segment, plan_name, CAST(SUM(successful_amount) AS DOUBLE) AS collected_revenue FROM {CHAIN} WHERE successful_amount > 0 GROUP BY 1, 2")
add("metric_top_k", f"SELECT c.customer_id, customer_name, customer_segment, CAST(SUM(mrr_amount) AS DOUBLE) AS mrr FROM {SUBS} GROUP BY 1, 2, 3 ORDER BY mrr DESC, 1, 2, 3 LIMIT 1")
add("metric_total", "SELECT CAST(SUM(invoice_amount) AS DOUBLE) AS billed_revenue, '1997-05' AS month FROM stripe_invoices WHERE invoice_month = '1997-05' "
    "UNION ALL SELECT CAST(SUM(invoice_amount) AS DOUBLE), '2026-05' FROM stripe_invoices WHERE invoice_month = '2026-05'")
ANCHOR = "anchor AS (SELECT CAST(MAX(invoice_month) || '-01' AS DATE) AS a, date_trunc('quarter', CAST(MAX(invoice_month) || '-01' AS DATE)) AS q FROM stripe_invoices)"
add("metric_count", "SELECT COUNT(DISTINCT invoice_id) AS invoice_count FROM stripe_invoices, anchor WHERE invoice_month >= strftime(q - INTERVAL 3 MONTH, '%Y-%m') "
    "AND invoice_month < strftime(q, '%Y-%m')", ANCHOR)


def _range(phrase: str, start: str, end: str) -> str:
    return (f"SELECT CAST(SUM(invoice_amount) AS DOUBLE) AS billed_revenue, '{phrase}' AS phrase FROM stripe_invoices, anchor WHERE invoice_amount > 0 "
            f"AND invoice_month >= strftime({start}, '%Y-%m') AND invoice_month < strftime({end}, '%Y-%m')")


add("time_phrases_month_key", " UNION ALL ".join([
    _range("last_month", "a - INTERVAL 1 MONTH", "a"), _range("this_month", "a", "a + INTERVAL 1 MONTH"),
    _range("this_quarter", "q", "q + INTERVAL 3 MONTH"), _range("last_quarter", "q - INTERVAL 3 MONTH", "q"),
    "SELECT CAST(SUM(invoice_amount) AS DOUBLE), 'all_time' FROM stripe_invoices WHERE invoice_amount > 0"]), ANCHOR)
PAY_ANCHOR = ("anchor AS (SELECT CAST(MAX(payment_date) AS DATE) AS a, date_trunc('month', MAX(payment_date)) AS m, date_trunc('quarter', MAX(payment_date)) AS q "
              "FROM stripe_payments WHERE successful_amount > 0)")


def _pay_range(phrase: str, start: str, end: str) -> str:
    return (f"SELECT CAST(SUM(successful_amount) AS DOUBLE) AS collected_revenue, '{phrase}' AS phrase FROM stripe_payments, anchor WHERE successful_amount > 0 "
            f"AND payment_date >= {start} AND payment_date < {end}")


add("time_phrases_date", " UNION ALL ".join([
    _pay_range("last_month", "m - INTERVAL 1 MONTH", "m"), _pay_range("this_month", "m", "m + INTERVAL 1 MONTH"),
    _pay_range("last_30_days", "a + 1 - INTERVAL 30 DAY", "a + 1"),
    _pay_range("this_quarter", "q", "q + INTERVAL 3 MONTH"), _pay_range("last_quarter", "q - INTERVAL 3 MONTH", "q")]), PAY_ANCHOR)
add("rolling_days_rows", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders, (SELECT CAST(MAX(o_orderdate) AS DATE) AS a FROM orders) "
    "WHERE o_orderdate >= a + 1 - INTERVAL 30 DAY AND o_orderdate < a + 1")
add("month_filter", f"SELECT {INVOICE_ROW}, invoice_date FROM stripe_invoices WHERE invoice_month = '1997-05'")
add("direct_sql", f"SELECT customer_segment, plan_name, CAST(SUM(mrr_amount) AS DOUBLE) AS total_mrr FROM {SUBS} JOIN dim_plans p ON p.plan_id = s.plan_id WHERE mrr_amount > 0 GROUP BY 1, 2")
add("min_max_amount", "SELECT CAST(MIN(successful_amount) AS DOUBLE) AS min_successful_amount, CAST(MAX(successful_amount) AS DOUBLE) AS max_successful_amount FROM stripe_payments")
add("monthly_stats", "SELECT invoice_month, CAST(MIN(invoice_amount) AS DOUBLE) AS min_amount, CAST(MAX(invoice_amount) AS DOUBLE) AS max_amount, "
    "CAST(SUM(invoice_amount) AS DOUBLE) / COUNT(invoice_amount) AS avg_amount FROM stripe_invoices GROUP BY 1")
add("collected_by_month", "SELECT payment_month, CAST(SUM(successful_amount) AS DOUBLE) AS collected_revenue FROM stripe_payments GROUP BY 1 ORDER BY 1")
add("refund_by_month", "SELECT payment_month, CAST(SUM(COALESCE(refund_amount, 0)) AS DOUBLE) AS refund_amount FROM stripe_payments GROUP BY 1 ORDER BY 1")
add("discount_by_month", "SELECT invoice_month, CAST(SUM(COALESCE(discount_amount, 0)) AS DOUBLE) AS discount_amount FROM stripe_invoices GROUP BY 1 ORDER BY 1")
add("net_mrr_by_segment",
    "SELECT customer_segment, CAST(SUM(mrr_amount) AS DOUBLE) AS gross_mrr, CAST(SUM(COALESCE(d, 0)) AS DOUBLE) AS discount_amount, "
    "CAST(SUM(COALESCE(r, 0)) AS DOUBLE) AS refund_amount, CAST(SUM(mrr_amount) - SUM(COALESCE(d, 0)) - SUM(COALESCE(r, 0)) AS DOUBLE) AS net_mrr "
    f"FROM {SUBS} LEFT JOIN adj ON adj.subscription_id = s.subscription_id GROUP BY 1 ORDER BY net_mrr DESC, 1", ADJ)
add("ambiguous_metric_group",
    "SELECT 'revenue' AS ambiguity_group, metric, value, CAST(5 AS BIGINT) AS choices FROM ("
    "SELECT 'mrr' AS metric, CAST(SUM(mrr_amount) AS DOUBLE) AS value FROM fact_subscriptions WHERE mrr_amount > 0 "
    "UNION ALL SELECT 'gross_mrr', CAST(SUM(mrr_amount) AS DOUBLE) FROM fact_subscriptions WHERE mrr_amount > 0 "
    "UNION ALL SELECT 'billed_revenue', CAST(SUM(invoice_amount) AS DOUBLE) FROM stripe_invoices WHERE invoice_amount > 0 "
    "UNION ALL SELECT 'collected_revenue', CAST(SUM(successful_amount) AS DOUBLE) FROM stripe_payments WHERE successful_amount > 0 "
    "UNION ALL SELECT 'net_mrr', CAST(SUM(mrr_amount) - SUM(COALESCE(d, 0)) - SUM(COALESCE(r, 0)) AS DOUBLE) FROM fact_subscriptions s LEFT JOIN adj ON adj.subscription_id = s.subscription_id)", ADJ)

# Models.
add("stg_generic", f"SELECT {PAYMENT_ROW} FROM stripe_payments")
add("mart_monthly_metric", "SELECT invoice_month, CAST(SUM(discount_amount) AS DOUBLE) AS discounts FROM stripe_invoices GROUP BY 1 ORDER BY 1")
add("mart_billing__monthly_invoice_revenue", BILLED)
add("mart_payments__monthly_collected_revenue", COLLECTED)
CLEAN_PAYMENTS = (f"SELECT {PAYMENT_ROW} FROM (SELECT *, row_number() OVER (PARTITION BY payment_id ORDER BY invoice_id, payment_month, successful_amount, refund_amount) AS rn "
                  "FROM stripe_payments) WHERE rn = 1")
add("stg_clean", CLEAN_PAYMENTS)
add("mart_payments__collections", CLEAN_PAYMENTS)
# Marts read cleaned sources: one row per key, the first by the other columns, and only listed segments.
CLEAN = (
    "s_c AS (SELECT * FROM dim_customers WHERE customer_segment IN ('enterprise', 'mid_market', 'startup', 'self_serve')), "
    "s_i AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY invoice_id ORDER BY subscription_id, invoice_month, invoice_amount, discount_amount NULLS FIRST) AS rn FROM stripe_invoices) WHERE rn = 1), "
    "s_p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY payment_id ORDER BY invoice_id, payment_month, successful_amount, refund_amount) AS rn FROM stripe_payments) WHERE rn = 1), "
    "s_paid AS (SELECT invoice_id, SUM(successful_amount) AS collected_amount, SUM(refund_amount) AS refund_amount FROM s_p GROUP BY 1), "
    "s_inv AS (SELECT i.*, COALESCE(p.collected_amount, 0) AS collected_amount, COALESCE(p.refund_amount, 0) AS refund_amount FROM s_i i LEFT JOIN s_paid p USING (invoice_id)), "
    "s_all AS (SELECT s_inv.*, customer_segment FROM s_inv LEFT JOIN fact_subscriptions s USING (subscription_id) LEFT JOIN s_c USING (customer_id)), "
    "s_adj AS (SELECT subscription_id, invoice_month, SUM(COALESCE(discount_amount, 0)) AS d, SUM(refund_amount) AS r FROM s_inv GROUP BY 1, 2), "
    "s_rev AS (SELECT invoice_month, customer_segment, SUM(COALESCE(mrr_amount, 0)) AS g, SUM(d) AS d, SUM(r) AS r FROM s_adj "
    "LEFT JOIN fact_subscriptions s USING (subscription_id) LEFT JOIN s_c USING (customer_id) GROUP BY 1, 2)"
)
add("int_subscription__mrr_adjustments",
    "SELECT subscription_id, invoice_month, CAST(d AS DOUBLE) AS discount_amount, CAST(r AS DOUBLE) AS refund_amount FROM s_adj", CLEAN)
_PARTS = {"gross_mrr": "CAST(g AS DOUBLE) AS gross_mrr", "discount_amount": "CAST(d AS DOUBLE) AS discount_amount",
          "refund_amount": "CAST(r AS DOUBLE) AS refund_amount", "net_mrr": "CAST(g - d - r AS DOUBLE) AS net_mrr"}
MARTS = {"mart_subscription__revenue_360_monthly": f"SELECT {BY}, {', '.join(_PARTS.values())} FROM s_rev"}
for _name, _use in (("gross_and_net", tuple(_PARTS)), ("gross_only", ("gross_mrr", "discount_amount", "refund_amount")),
                    ("net_only", ("net_mrr", "discount_amount", "refund_amount"))):
    add(f"revenue_360_{_name}", f"SELECT {BY}, {', '.join(_PARTS[u] for u in _use)} FROM s_rev", CLEAN)
MARTS["mart_billing__invoice_reconciliation"] = (
    "SELECT invoice_id, CAST(invoice_amount AS DOUBLE) AS billed_amount, CAST(collected_amount AS DOUBLE) AS collected_amount, CAST(refund_amount AS DOUBLE) AS refund_amount, "
    "CAST(invoice_amount - collected_amount AS DOUBLE) AS reconciliation_difference FROM s_inv")
MARTS["mart_billing__collection_health_monthly"] = (
    f"SELECT {BY}, CAST(SUM(invoice_amount) AS DOUBLE) AS billed_amount, CAST(SUM(collected_amount) AS DOUBLE) AS collected_amount, CAST(SUM(refund_amount) AS DOUBLE) AS refund_amount, "
    "CAST(SUM(invoice_amount) - SUM(collected_amount) AS DOUBLE) AS outstanding_amount FROM s_all GROUP BY 1, 2")
MARTS["collection_gap_monthly"] = (
    "SELECT invoice_month, CAST(SUM(invoice_amount) AS DOUBLE) AS billed_revenue, CAST(SUM(collected_amount) AS DOUBLE) AS collected_revenue, "
    "CAST(SUM(invoice_amount) - SUM(collected_amount) AS DOUBLE) AS collection_gap FROM s_inv GROUP BY 1")
MARTS["mart_billing__monthly_reconciliation"] = (
    f"SELECT {BY}, CAST(SUM(invoice_amount) AS DOUBLE) AS billed_amount, CAST(SUM(collected_amount) AS DOUBLE) AS collected_payment_amount, "
    "CAST(SUM(invoice_amount) - SUM(collected_amount) AS DOUBLE) AS reconciliation_difference, COUNT(*) AS invoice_count FROM s_all GROUP BY 1, 2")
for _name, _sql in MARTS.items():
    add(_name, _sql, CLEAN)
add("sql_text_models", MARTS["mart_billing__invoice_reconciliation"], CLEAN)
add("mart_subscription__monthly_mrr", "SELECT customer_id, plan_id, CAST(SUM(mrr_amount) AS DOUBLE) AS mrr FROM fact_subscriptions GROUP BY 1, 2")
add("dim_customers_clean", "SELECT customer_id, trim(customer_name) AS customer_name, trim(customer_segment) AS customer_segment FROM dim_customers "
    "WHERE customer_segment IN ('enterprise', 'mid_market', 'startup', 'self_serve')")
add("dim_plans_clean", "SELECT trim(plan_id) AS plan_id, trim(plan_name) AS plan_name FROM dim_plans")
add("model_lineage",
    "SELECT model, kind, parent, CAST(seen // 10 AS INTEGER) AS part, CAST(seen % 10 AS INTEGER) AS position, parent NOT LIKE 'stg%' AS in_braces FROM (SELECT model, kind, parent, MIN(part * 10 + pos) AS seen FROM ("
    "SELECT 'mart_order_' || l_orderkey AS model, 'ref' AS kind, 'int_part_' || l_partkey AS parent, l_linenumber AS part, 0 AS pos FROM lineitem "
    "UNION ALL SELECT 'mart_order_' || l_orderkey, 'ref', 'stg_line_' || l_linenumber, l_linenumber, 2 FROM lineitem "
    "UNION ALL SELECT 'mart_order_' || l_orderkey, 'source', 'demo.supplier_' || l_suppkey, l_linenumber, 1 FROM lineitem) GROUP BY 1, 2, 3)")
add("model_levels",
    "SELECT model, CAST(MAX(level) AS BIGINT) AS level, CAST(CASE WHEN model LIKE 'stg%' THEN 0 WHEN model LIKE 'int%' THEN 1 WHEN model LIKE 'mart%' THEN 2 ELSE 3 END AS BIGINT) AS tier "
    "FROM walk GROUP BY model",
    "edges AS (SELECT DISTINCT * FROM (SELECT 'int_customer_' || c_custkey AS model, 'stg_nation_' || c_nationkey AS parent FROM customer "
    "UNION ALL SELECT 'int_order_' || o_orderkey, 'int_customer_' || o_custkey FROM orders UNION ALL SELECT 'int_part_' || p_partkey, 'stg_brand_' || p_brand FROM part "
    "UNION ALL SELECT 'mart_supplier_' || l_suppkey, 'int_order_' || l_orderkey FROM lineitem UNION ALL SELECT 'mart_supplier_' || l_suppkey, 'int_part_' || l_partkey FROM lineitem)), "
    "walk AS (SELECT model, 0 AS level FROM (SELECT model FROM edges UNION SELECT parent FROM edges) n WHERE model NOT IN (SELECT model FROM edges) "
    "UNION SELECT e.model, w.level + 1 FROM edges e JOIN walk w ON w.model = e.parent)")


def _built() -> str:
    """Status rows of every model and the figures of every mart, product by product."""
    layers = {
        "subscription_revenue_360": (
            ("stg_demo__customers", "stg_demo__subscriptions", "stg_stripe__invoices", "stg_stripe__payments",
             "int_subscription__mrr_adjustments"), ("mart_subscription__revenue_360_monthly",), ("stg_demo__plans",)),
        "stripe_billing_reconciliation": (
            ("stg_stripe__invoices", "stg_stripe__payments"),
            ("mart_billing__invoice_reconciliation", "collection_gap_monthly"), ()),
        "subscription_collection_health": (
            ("stg_demo__customers", "stg_demo__subscriptions", "stg_stripe__invoices", "stg_stripe__payments"),
            ("mart_billing__collection_health_monthly", "mart_billing__monthly_reconciliation"), ()),
    }
    rows = []
    for product, (composed, marts, unused) in layers.items():
        for n in composed:
            rows.append(f"SELECT '{product}' AS product, '{n}' AS model, 'composed' AS key, 'row_count' AS figure, CAST(NULL AS DOUBLE) AS value")
        for n in unused:
            rows.append(f"SELECT '{product}', '{n}', 'completed', 'row_count', CAST(COUNT(*) AS DOUBLE) FROM dim_plans")
        for n in marts:
            rows.append(f"SELECT '{product}', '{n}', 'completed', 'row_count', CAST(COUNT(*) AS DOUBLE) FROM ({MARTS[n]})")
            key = {"mart_billing__invoice_reconciliation": "CAST(invoice_id AS VARCHAR)", "collection_gap_monthly": "invoice_month"}.get(
                n, "invoice_month || '|' || COALESCE(customer_segment, '-')")
            figures = [x.split()[-1] for x in MARTS[n].split(" FROM ")[0].split(", ") if " AS " in x]
            for f in figures:
                rows.append(f"SELECT '{product}', '{n}', {key}, '{f}', CAST({f} AS DOUBLE) FROM ({MARTS[n]})")
    return " UNION ALL ".join(rows)


add("build_all_models", _built(), CLEAN)



def _rebuilt() -> str:
    """Status rows of three builds: payments lack a column, are mended, are fewer."""
    count = {"stg_demo__customers": "s_c", "stg_demo__subscriptions": "fact_subscriptions", "stg_stripe__invoices": "s_i"}
    marts = ("mart_billing__collection_health_monthly", "mart_billing__monthly_reconciliation")
    pay, rows = "stg_stripe__payments", []

    def row(build, model, status, reason, table=None):
        n = f"(SELECT COUNT(*) FROM {table})" if table else "CAST(NULL AS BIGINT)"
        rows.append(f"SELECT CAST({build} AS INTEGER) AS build, '{model}' AS model, '{status}' AS status, '{reason}' AS reason, {n} AS row_count")

    for build in (1, 2, 3):
        for model, table in count.items():
            row(build, model, "built" if build == 1 else "kept", "new" if build == 1 else "unchanged", table)
    row(1, pay, "failed", "new")
    row(2, pay, "built", "failed before", "s_p")
    row(3, pay, "built", "changed: stripe_payments", "(SELECT DISTINCT payment_id FROM stripe_payments WHERE successful_amount > 1000)")
    for mart in marts:
        row(1, mart, "skipped", f"failed input: {pay}")
        row(2, mart, "built", "skipped before", f"({MARTS[mart]})")
        row(3, mart, "built", f"changed: {pay}", f"({MARTS[mart]})")
    return " UNION ALL ".join(rows)


add("rebuild_changed", _rebuilt(), CLEAN)

# Data tests.
add("test_not_null", "SELECT invoice_id, invoice_month FROM stripe_invoices WHERE discount_amount IS NULL")
add("test_unique", "SELECT payment_id AS value, COUNT(*) AS copies FROM stripe_payments GROUP BY 1 HAVING COUNT(*) > 1")
add("test_accepted_values", "SELECT subscription_id, plan_id FROM fact_subscriptions WHERE plan_id NOT IN ('BUILDING', 'MACHINERY')")
add("test_relationship", "SELECT payment_id, invoice_id, payment_month FROM gaps g WHERE invoice_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM stripe_invoices i WHERE i.invoice_id = g.invoice_id)")
add("test_custom_sql", "SELECT invoice_id, CAST(invoice_amount - collected_amount AS DOUBLE) AS reconciliation_difference FROM s_inv WHERE invoice_amount - collected_amount < 0", CLEAN)
add("test_metrics_not_null",
    "SELECT i.invoice_id, CAST(discount_amount AS DOUBLE) AS discount_amount, CAST(p.collected_amount AS DOUBLE) AS collected_amount FROM stripe_invoices i "
    "LEFT JOIN paid p ON p.invoice_id = i.invoice_id WHERE discount_amount IS NULL OR p.collected_amount IS NULL")
add("test_month_key",
    "SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN strftime(o_orderdate, '%Y-%m-%d') END AS order_month FROM orders WHERE o_orderpriority IN ('5-LOW', '1-URGENT')")


def _tests() -> str:
    rows = []

    def row(name, model, failing):
        rows.append(f"SELECT '{name}' AS test_name, '{model}' AS model, ({failing}) AS failing_rows")

    for s in SOURCES:
        for c in COLUMNS[s]:
            spec = _declared(s, c)
            if spec.primary_key:
                row(f"unique__{s}__{c}", s, f"SELECT COUNT(*) FROM (SELECT {c} FROM {s} WHERE {c} IS NOT NULL GROUP BY 1 HAVING COUNT(*) > 1)")
            if not spec.nullable:
                row(f"not_null__{s}__{c}", s, f"SELECT COUNT(*) FROM {s} WHERE {c} IS NULL")
            if spec.valid_values:
                row(f"accepted_values__{s}__{c}", s, f"SELECT COUNT(*) FROM {s} WHERE {c} NOT IN ('enterprise','mid_market','startup','self_serve')")
            if spec.logical_type == "month":
                row(f"month_key__{s}__{c}", s, f"SELECT COUNT(*) FROM {s} WHERE {c} IS NULL OR NOT regexp_matches({c}, '^[0-9]{{4}}-(0[1-9]|1[0-2])$')")
    for r in fixed.RELATIONSHIPS:
        row(f"relationship__{r.id}", r.right_source,
            f"SELECT COUNT(*) FROM {r.right_source} x WHERE x.{r.right_key} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {r.left_source} y WHERE y.{r.left_key} = x.{r.right_key})")
        row(f"not_null__{r.id}", r.right_source, f"SELECT COUNT(*) FROM {r.right_source} WHERE {r.right_key} IS NULL")
    row("no_overpaid_invoices", "mart_billing__invoice_reconciliation", "SELECT COUNT(*) FROM s_inv WHERE collected_amount > invoice_amount")
    row("metrics_not_null__mart_subscription__revenue_360_monthly", "mart_subscription__revenue_360_monthly", "SELECT COUNT(*) FROM s_rev WHERE g IS NULL OR d IS NULL OR r IS NULL")
    return "SELECT *, failing_rows = 0 AS passed FROM (" + " UNION ALL ".join(rows) + ")"


add("test_summary", _tests(), CLEAN)

# Text rules.
NORM = r"trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9_\s/-]+', ' ', 'g'), '\s+', ' ', 'g'))"
DOCS = f"docs AS (SELECT doc_id, {NORM} AS t FROM documents)"
add("text_normalize", "SELECT doc_id, t AS normalized FROM docs", DOCS)


def has(column: str, *terms: str) -> str:
    return "(" + " OR ".join(f"contains({column}, '{t}')" for t in terms) + ")"


EXPLICIT = has("t", "mail to", "license", "by_mail", "by e-mail", "tel", "by_phone", "by phone")
LINKED = f"({has('t', 'and', 'und', 'et')} AND {has('t', 'tion', 'ung', 'ment')} AND NOT {has('t', 'password', 'api key')} AND NOT {EXPLICIT})"
ANYP = has("t", "the", "of", "der", "nicht", "le", "que")
add("rule_match", f"SELECT doc_id, {LINKED} AS linked_prose, {ANYP} AS any_prose, {has('t', 'the')} AS never FROM docs", DOCS)
add("rule_table_match", f"SELECT doc_id, 'linked_prose' AS rule_id FROM docs WHERE {LINKED} UNION ALL SELECT doc_id, 'any_prose' FROM docs WHERE {ANYP}", DOCS)
add("explicit_choice", f"SELECT doc_id, {EXPLICIT} AS explicit FROM docs", DOCS)
add("first_rule_wins_prose", f"SELECT conv_id, turn, CASE WHEN {LINKED} THEN 'linked_prose' WHEN {ANYP} THEN 'any_prose' END AS rule_id FROM "
    f"(SELECT conv_id, turn, {NORM} AS t FROM conversations WHERE role = 'user')")
A = has("t", *fixed.ACTION_TERMS) + " AND " + has("t", *fixed.ARTIFACT_TERMS)


def _rule(rule, groups) -> str:
    choice = [w.lower() for o in rule.options for w in (*o.aliases, o.id, o.label)]
    return f"({A} AND " + " AND ".join(has("t", *rule.all_any[g]) for g in groups) + f" AND NOT {has('t', *choice)})"


add("first_rule_wins",
    f"SELECT request_id, CASE WHEN o_orderstatus <> 'F' AND {_rule(fixed.REVENUE_RULE, ('business_terms', 'domain_terms'))} THEN 'revenue_definition_for_pipeline' "
    f"WHEN o_orderstatus <> 'P' AND {_rule(fixed.ADJUSTMENT_RULE, ('adjustment_terms', 'uncertainty_terms'))} THEN 'refund_discount_handling_for_revenue_product' END AS rule_id FROM ("
    f"SELECT request_id, o_orderstatus, {NORM} AS t FROM requests)",
    "requests AS (SELECT o_orderkey AS request_id, o_orderstatus, concat_ws(' ', ['Please CREATE a','Help me build','Show','draft the'][CAST(o_orderkey % 4 AS INTEGER) + 1], "
    "['data-product','data product','pipeline!','report','models'][CAST((o_orderkey // 4) % 5 AS INTEGER) + 1], "
    "['for monthly revenue','of refunds, not sure how','by segment','for discounts (unclear)'][CAST(o_custkey % 4 AS INTEGER) + 1], "
    "['from Stripe','from invoice data','of payment rows','by MRR','with gross only'][CAST((o_custkey // 4) % 5 AS INTEGER) + 1], lower(o_orderpriority)) AS text FROM orders)")
ANSWERS = (
    "answers AS (SELECT l_orderkey AS run_id, l_linenumber AS position, l_partkey, CASE WHEN l_suppkey % 3 = 0 THEN 'q_revenue_definition' WHEN l_suppkey % 3 = 1 THEN 'q_refund_discount_handling' ELSE 'q_other' END AS question_id, "
    "CASE WHEN l_partkey % 5 = 0 THEN 'gross_only' WHEN l_partkey % 5 = 1 THEN 'net_mrr' WHEN l_partkey % 5 = 2 THEN '' END AS sel, "
    "CASE CAST(l_quantity AS INTEGER) % 7 WHEN 0 THEN '' WHEN 1 THEN 'Use billed revenue from the invoices.' WHEN 2 THEN 'gross and net, please' "
    "WHEN 3 THEN 'Treat returns as zero and  IGNORE part ' || l_partkey WHEN 4 THEN 'no idea' WHEN 5 THEN 'subtract discounts and refunds from gross mrr' "
    "ELSE 'Net ' || l_returnflag || ' MRR after ' || lower(l_linestatus) END AS custom FROM lineitem), "
    r"plain AS (SELECT *, trim(regexp_replace(lower(custom), '\s+', ' ', 'g')) AS p FROM answers), "
    "tok AS (SELECT *, list_distinct(list_filter(regexp_extract_all(p, '[a-z0-9_]+'), lambda w: length(w) > 1 AND w NOT IN ("
    + ",".join(f"'{w}'" for w in fixed.STOPWORDS) + "))) AS words FROM plain)"
)


def _score(option) -> str:
    text = " ".join((option.id, option.label, option.resolved_rule, option.implementation)).lower().replace("'", "''")
    return (f"CAST(len(list_filter(words, lambda w: list_contains(regexp_extract_all('{text}', '[a-z0-9_]+'), w))) AS DOUBLE) / NULLIF(len(words), 0)")


def _best(rule) -> str:
    scores = [_score(o) for o in rule.options]
    top = f"greatest({', '.join(scores)})"
    cases = " ".join(f"WHEN {s} = {top} THEN '{o.id}'" for s, o in zip(scores, rule.options, strict=True))
    return f"CASE WHEN {top} >= 0.45 THEN CASE {cases} END END"


add("answer_option_overlap", "SELECT run_id, position, l_partkey, "
    + ", ".join(f"round({_score(o)}, 6) AS {o.id}" for o in fixed.ADJUSTMENT_RULE.options) + f", {_best(fixed.ADJUSTMENT_RULE)} AS best_option FROM tok", ANSWERS)


def looks(column: str) -> str:
    return f"(len(list_filter(string_split({column}, ' '), lambda w: length(w) > 0)) >= 3 AND {has(column, *fixed.RULE_VERBS)})"


add("custom_rule_heuristic", f"SELECT conv_id, turn, {looks('p')} AS is_rule FROM (SELECT conv_id, turn, "
    r"trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS p FROM conversations)")
_ids = {r.question_id: ",".join(f"'{o.id}'" for o in r.options) for r in fixed.CLARIFICATION_RULES}
add("answer_class",
    "SELECT run_id, position, l_partkey, question_id, answer_type, CASE answer_type WHEN 'predefined_option' THEN sel WHEN 'custom_mapped_to_option' THEN mapped END AS option_id FROM ("
    "SELECT *, CASE WHEN question_id = 'q_other' THEN 'invalid' WHEN COALESCE(sel, '') <> '' THEN CASE WHEN known THEN 'predefined_option' ELSE 'invalid' END "
    f"WHEN p = '' THEN 'invalid' WHEN mapped IS NOT NULL THEN 'custom_mapped_to_option' WHEN {looks('p')} THEN 'custom' ELSE 'invalid' END AS answer_type FROM ("
    f"SELECT *, CASE question_id WHEN 'q_revenue_definition' THEN {_best(fixed.REVENUE_RULE)} WHEN 'q_refund_discount_handling' THEN {_best(fixed.ADJUSTMENT_RULE)} END AS mapped, "
    f"CASE question_id WHEN 'q_revenue_definition' THEN sel IN ({_ids['q_revenue_definition']}) ELSE sel IN ({_ids['q_refund_discount_handling']}) END AS known FROM tok))", ANSWERS)
add("latest_answer_per_question", "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1")
ALLOWED = "'the','of','and','nicht','der','que','le','in'"
add("allowed_item_filter",
    "SELECT d.doc_id, COALESCE(k.kept, '') AS kept FROM docs d LEFT JOIN (SELECT doc_id, string_agg(w, ',' ORDER BY first_at) AS kept FROM ("
    "SELECT doc_id, w, MIN(i) AS first_at FROM (SELECT doc_id, unnest(string_split(t, ' ')) AS w, generate_subscripts(string_split(t, ' '), 1) AS i FROM docs) "
    f"WHERE w IN ({ALLOWED}) GROUP BY 1, 2) GROUP BY 1) k ON k.doc_id = d.doc_id", DOCS)
add("resolved_rules",
    "SELECT l_orderkey AS run_id, l_partkey, l_suppkey, l_linenumber, l_extendedprice, 'q_Return--' || l_returnflag || '!' AS question_id, "
    "CASE WHEN n = 1 THEN 'return_' || lower(l_returnflag) ELSE 'return_' || lower(l_returnflag) || '_' || n END AS rule_key FROM ("
    "SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem)")

# Run events.
add("event_seq", "SELECT run_id, seq, event_id, type FROM seqd")
add("events_after", "SELECT run_id, seq, event_id FROM seqd WHERE seq > 40")
add("events_resume", "SELECT s.run_id, s.seq, s.event_id FROM seqd s LEFT JOIN (SELECT run_id, MAX(seq) AS m FROM seqd WHERE type = 'done' GROUP BY 1) d ON d.run_id = s.run_id WHERE s.seq > COALESCE(d.m, 0)")
add("event_count", "SELECT run_id, COUNT(*) AS event_count FROM ev GROUP BY 1")
_case = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.AGENT_STATUS.items()) + " END"
_run_case = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.RUN_STATUS.items()) + " END"
AGENT = ("SELECT run_id, agent_id, COALESCE(MAX(st) FILTER (rk = 1 AND st IS NOT NULL), 'queued') AS status, COUNT(*) AS event_count FROM ("
         "SELECT *, row_number() OVER (PARTITION BY run_id, agent_id, st IS NULL ORDER BY ts DESC, event_id DESC) AS rk FROM ("
         f"SELECT *, {_case} AS st FROM ev)) GROUP BY 1, 2")
add("agent_status", AGENT)
add("stream_agent_status", AGENT)
add("agent_tree",
    "SELECT n.run_id, n.agent_id, n.parent_id, depth, n.status, n.event_count, n.placeholder, tree_agents, tree_events, tree_status "
    "FROM nodes n JOIN (SELECT run_id, agent_id, MAX(d) AS depth FROM up GROUP BY 1, 2) USING (run_id, agent_id) JOIN ("
    "SELECT u.run_id, u.top, COUNT(*) AS tree_agents, CAST(SUM(m.event_count) AS BIGINT) AS tree_events, CASE WHEN bool_or(m.status = 'failed') THEN 'failed' "
    "WHEN bool_or(m.status = 'waiting_for_user') THEN 'waiting_for_user' WHEN bool_or(m.status IN ('running', 'queued')) THEN 'running' ELSE 'completed' END AS tree_status "
    "FROM up u JOIN nodes m ON m.run_id = u.run_id AND m.agent_id = u.agent_id GROUP BY 1, 2) t ON t.run_id = n.run_id AND t.top = n.agent_id",
    f"said AS (SELECT *, 'agent_' || tool_call_id AS a, CASE WHEN tool_call_id > 0 THEN 'agent_' || ((tool_call_id - 1) // 3) END AS par, {_case} AS st FROM ev), "
    "spoken AS (SELECT run_id, a AS agent_id, par AS parent_id, COALESCE(arg_max(st, {'t': ts, 'e': event_id}) FILTER (st IS NOT NULL), 'queued') AS status, COUNT(*) AS event_count, FALSE AS placeholder "
    "FROM said GROUP BY 1, 2, 3), "
    "nodes AS (SELECT * FROM spoken UNION ALL SELECT DISTINCT run_id, parent_id, NULL::VARCHAR, 'running', 0, TRUE FROM spoken s WHERE parent_id IS NOT NULL "
    "AND NOT EXISTS (SELECT 1 FROM spoken o WHERE o.run_id = s.run_id AND o.agent_id = s.parent_id)), "
    "up AS (SELECT run_id, agent_id, agent_id AS top, parent_id AS next, 0 AS d FROM nodes "
    "UNION ALL SELECT up.run_id, up.agent_id, n.agent_id, n.parent_id, d + 1 FROM up JOIN nodes n ON n.run_id = up.run_id AND n.agent_id = up.next)")
RUN = ("SELECT run_id, COALESCE(MAX(st) FILTER (rk = 1 AND st IS NOT NULL), 'idle') AS last, bool_or(COALESCE(st = 'failed', FALSE)) AS failed FROM ("
       "SELECT *, row_number() OVER (PARTITION BY run_id, st IS NULL ORDER BY ts DESC, event_id DESC) AS rk FROM ("
       f"SELECT *, {_run_case} AS st FROM ev)) GROUP BY 1")
add("run_status", f"SELECT run_id, last AS status FROM ({RUN})")
add("run_status_failed_terminal", f"SELECT run_id, CASE WHEN failed THEN 'failed' ELSE last END AS status FROM ({RUN})")
TOOLS = ("SELECT run_id, agent_id, tool_call_id, s + o AS entries, done AS completed_entries, s + o - done AS running_entries, o = 1 AS completed_without_start, first_started, last_completed FROM ("
         "SELECT run_id, agent_id, tool_call_id, COUNT(*) FILTER (type = 'tool_started') AS s, CAST(COUNT(*) FILTER (type = 'tool_completed') > 0 AS BIGINT) AS done, "
         "CAST(arg_min(type, seq) = 'tool_completed' AS BIGINT) AS o, MIN(ts) FILTER (type = 'tool_started') AS first_started, MAX(ts) FILTER (type = 'tool_completed') AS last_completed "
         "FROM seqd WHERE type IN ('tool_started', 'tool_completed') GROUP BY 1, 2, 3)")
add("tool_pairs", TOOLS)
add("stream_tool_pairs", TOOLS)
add("recent_activity",
    "SELECT run_id, event_id, ts, CASE type WHEN 'session_started' THEN 'Run begins' WHEN 'tool_started' THEN agent_id || ' calls tool ' || tool_call_id "
    "WHEN 'tool_completed' THEN agent_id || ' is done with tool ' || tool_call_id WHEN 'ask_user' THEN 'A question is open' "
    "WHEN 'artifact_created' THEN agent_id || ' made artifact ' || tool_call_id WHEN 'error' THEN agent_id || ' hit an error' WHEN 'done' THEN 'Run ends' END AS activity FROM ("
    "SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, event_id DESC) AS rk FROM ev) WHERE rk <= 8")
add("error_list", "SELECT run_id, event_id, 'code ' || tool_call_id AS message, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS position FROM ev WHERE type = 'error'")
add("step_durations",
    "SELECT step_id, status, COUNT(*) AS runs, CAST(SUM(ms) AS DOUBLE) / COUNT(*) AS avg_ms, MAX(ms) AS max_ms, quantile_disc(ms, 0.5) AS p50_ms, quantile_disc(ms, 0.95) AS p95_ms FROM ("
    "SELECT event_type AS step_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status, CAST(floor(value * 10) AS BIGINT) AS ms FROM events) GROUP BY 1, 2")
add("log_compaction",
    "SELECT doc_id, length(text) AS char_count, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS estimated_tokens, length(text) > 2500 AS truncated, "
    "CASE WHEN length(text) > 2500 THEN substring(text, 1, 2500) || '... [truncated]' ELSE text END AS preview FROM documents")
add("stream_ingest", "SELECT run_id, type, CAST(SUM(CASE WHEN event_id % 6 IN (0, 2, 3) THEN 2 ELSE 1 END) AS BIGINT) AS events, COUNT(*) AS ids, MAX(ts) AS last_ts FROM ev GROUP BY 1, 2")
# Delivered in three parts by id; numbers follow the delivery, then the time. The second stop reads even runs only.
add("stream_resume",
    "SELECT CAST(CASE WHEN part = 2 AND run_id % 2 <> 0 THEN 3 ELSE part END AS INTEGER) AS stop, run_id, "
    "row_number() OVER (PARTITION BY run_id ORDER BY part, ts, event_id) AS seq, event_id, type FROM ("
    "SELECT *, CASE event_id % 6 WHEN 4 THEN 2 WHEN 5 THEN 3 ELSE 1 END AS part FROM ev)")
add("stream_tool_closed",
    "SELECT run_id, agent_id, tool_call_id, s + o AS entries, done AS completed_entries, s + o - done AS running_entries, o = 1 AS completed_without_start, first_started, last_completed, opened FROM ("
    "SELECT run_id, agent_id, tool_call_id, MIN(ts) AS opened, MAX(ts) AS closed, COUNT(*) FILTER (type = 'tool_started') AS s, CAST(COUNT(*) FILTER (type = 'tool_completed') > 0 AS BIGINT) AS done, "
    "CAST(arg_min(type, seq) = 'tool_completed' AS BIGINT) AS o, MIN(ts) FILTER (type = 'tool_started') AS first_started, MAX(ts) FILTER (type = 'tool_completed') AS last_completed FROM ("
    "SELECT *, SUM(fresh) OVER (PARTITION BY run_id, agent_id, tool_call_id ORDER BY ts, seq) AS visit FROM ("
    "SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY run_id, agent_id, tool_call_id ORDER BY ts, seq) + INTERVAL 2 DAY THEN 0 ELSE 1 END AS fresh "
    "FROM seqd WHERE type IN ('tool_started', 'tool_completed'))) GROUP BY run_id, agent_id, tool_call_id, visit) "
    "WHERE closed + INTERVAL 2 DAY <= (SELECT MAX(ts) FROM ev WHERE type IN ('tool_started', 'tool_completed')) - INTERVAL 5 DAY")
add("stream_dedup", "SELECT run_id, type, COUNT(*) AS events, COUNT(*) AS ids FROM ev GROUP BY 1, 2")

# The first free name, answer by answer.
add("resolved_rules_forms",
    "SELECT l_orderkey, l_linenumber, used[len(used)] AS rule_key FROM walk",
    "ask AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS pos, "
    "'flag_' || lower(r.f) || CASE r.p % 3 WHEN 0 THEN '' WHEN 1 THEN '_2' ELSE '_2_2' END AS k FROM ("
    "SELECT l_orderkey, l_linenumber, MIN({'p': l_partkey, 'f': l_returnflag}) AS r FROM lineitem GROUP BY 1, 2)), "
    "walk AS (SELECT l_orderkey, l_linenumber, pos, [k] AS used FROM ask WHERE pos = 1 "
    "UNION ALL SELECT ask.l_orderkey, ask.l_linenumber, ask.pos, list_append(used, list_filter(list_prepend(k, list_transform(range(2, 99), "
    "lambda i: k || '_' || i)), lambda n: NOT list_contains(used, n))[1]) FROM walk JOIN ask ON ask.l_orderkey = walk.l_orderkey AND ask.pos = walk.pos + 1)")
