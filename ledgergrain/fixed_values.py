"""Fixed values.

Everything in this file is data that has to read exactly like this for results to be right:
table and column names, thresholds, allowed values, metric formulas, rule terms, option texts,
stop words and verbs. There is no logic here.
"""

from __future__ import annotations

from ledgergrain.specs import (
    CatalogSource,
    ColumnSpec,
    Dimension,
    Metric,
    MonthlyMetricMart,
    Relationship,
    RuleOption,
    SourceContract,
    TextRule,
    TimePhrase,
)

# Source contracts.
SEGMENTS = ("enterprise", "mid_market", "startup", "self_serve")

DIM_CUSTOMERS = SourceContract(
    name="dim_customers",
    grain=("customer_id",),
    final_mart="dim_customers_clean",
    columns=(
        ColumnSpec("customer_id", "text", nullable=False, primary_key=True),
        ColumnSpec("customer_name", "text", nullable=False),
        ColumnSpec("customer_segment", "text", nullable=False, valid_values=SEGMENTS),
    ),
)
DIM_PLANS = SourceContract(
    name="dim_plans",
    grain=("plan_id",),
    final_mart="dim_plans_clean",
    columns=(
        ColumnSpec("plan_id", "text", nullable=False, primary_key=True),
        ColumnSpec("plan_name", "text", nullable=False),
    ),
)
FACT_SUBSCRIPTIONS = SourceContract(
    name="fact_subscriptions",
    grain=("subscription_id",),
    final_mart="mart_subscription__monthly_mrr",
    columns=(
        ColumnSpec("subscription_id", "text", nullable=False, primary_key=True),
        ColumnSpec("customer_id", "text", nullable=False),
        ColumnSpec("plan_id", "text", nullable=False),
        ColumnSpec("mrr_amount", "real", nullable=False),
    ),
)
STRIPE_INVOICES = SourceContract(
    name="stripe_invoices",
    grain=("invoice_id",),
    final_mart="mart_billing__monthly_invoice_revenue",
    columns=(
        ColumnSpec("invoice_id", "text", nullable=False, primary_key=True),
        ColumnSpec("subscription_id", "text", nullable=False),
        ColumnSpec("invoice_month", "text", nullable=False, logical_type="month"),
        ColumnSpec("invoice_amount", "real", nullable=False),
        ColumnSpec(
            "discount_amount",
            "real",
            nullable=True,
            null_rate_decision=0.10,
            decision_reason="An unknown discount makes every net amount uncertain.",
        ),
    ),
)
STRIPE_PAYMENTS = SourceContract(
    name="stripe_payments",
    grain=("payment_id",),
    final_mart="mart_payments__collections",
    positive_column="refund_amount",
    positive_severity="must_answer",
    positive_affects=("metric_logic", "sql_model", "documentation"),
    columns=(
        ColumnSpec("payment_id", "text", nullable=False, primary_key=True),
        ColumnSpec("invoice_id", "text", nullable=False),
        ColumnSpec("payment_month", "text", nullable=False, logical_type="month"),
        ColumnSpec("successful_amount", "real", nullable=False),
        ColumnSpec("refund_amount", "real", nullable=False),
    ),
)
CONTRACTS = {
    c.name: c for c in (DIM_CUSTOMERS, DIM_PLANS, FACT_SUBSCRIPTIONS, STRIPE_INVOICES, STRIPE_PAYMENTS)
}

# Catalog of sources.
CATALOG = (
    CatalogSource("dim_customers", "dimension", "customer", "one row per customer", "customer_id"),
    CatalogSource("dim_plans", "dimension", "plan", "one row per subscription plan", "plan_id"),
    CatalogSource("fact_subscriptions", "fact", "subscription", "one row per subscription", "subscription_id"),
    CatalogSource("stripe_invoices", "fact", "invoice", "one row per invoice", "invoice_id"),
    CatalogSource("stripe_payments", "fact", "payment", "one row per successful payment", "payment_id"),
)

# Relationships with thresholds and finding ids.
RELATIONSHIPS = (
    Relationship(
        "customers_to_subscriptions", "dim_customers", "fact_subscriptions", "customer_id", "customer_id",
        left_key_unique=True, right_key_nullable_allowed=False,
        max_unmatched_left_rate=0.50, max_unmatched_right_rate=0.02,
    ),
    Relationship(
        "plans_to_subscriptions", "dim_plans", "fact_subscriptions", "plan_id", "plan_id",
        left_key_unique=True, right_key_nullable_allowed=False,
        max_unmatched_left_rate=0.80, max_unmatched_right_rate=0.02,
    ),
    Relationship(
        "subscriptions_to_invoices", "fact_subscriptions", "stripe_invoices", "subscription_id", "subscription_id",
        left_key_unique=True, right_key_nullable_allowed=False,
        max_unmatched_left_rate=0.40, max_unmatched_right_rate=0.02,
    ),
    Relationship(
        "invoices_to_payments_by_invoice_id", "stripe_invoices", "stripe_payments", "invoice_id", "invoice_id",
        left_key_unique=True, right_key_nullable_allowed=False,
        max_unmatched_left_rate=0.50, max_unmatched_right_rate=0.30,
        left_issue_id="issue_unmatched_invoices", right_issue_id="issue_unmatched_payments",
    ),
)

# Data products and their sources.
DATA_PRODUCTS = {
    "stripe_billing_reconciliation": ("stripe_invoices", "stripe_payments"),
    "subscription_collection_health": (
        "dim_customers", "fact_subscriptions", "stripe_invoices", "stripe_payments",
    ),
    "subscription_revenue_360": (
        "dim_customers", "dim_plans", "fact_subscriptions", "stripe_invoices", "stripe_payments",
    ),
}

# Metrics. Sums are additive over base rows; ``needs`` names the pre-aggregated join.
METRICS = {
    m.name: m
    for m in (
        Metric("mrr", "fact_subscriptions", (("mrr", "mrr_amount"),), "mrr",
               filters=("mrr_amount > 0",), ambiguity_group="revenue"),
        Metric("gross_mrr", "fact_subscriptions", (("gross_mrr", "mrr_amount"),), "gross_mrr",
               filters=("mrr_amount > 0",), ambiguity_group="revenue"),
        Metric("billed_revenue", "stripe_invoices", (("billed_revenue", "invoice_amount"),), "billed_revenue",
               filters=("invoice_amount > 0",), date_column="invoice_month", ambiguity_group="revenue"),
        Metric("collected_revenue", "stripe_payments", (("collected_revenue", "successful_amount"),),
               "collected_revenue", filters=("successful_amount > 0",), date_column="payment_month",
               ambiguity_group="revenue"),
        Metric("invoice_count", "stripe_invoices", distinct="invoice_id",
               filters=("invoice_id is not null",), date_column="invoice_month"),
        Metric("discount_amount", "stripe_invoices", (("discount_amount", "coalesce(discount_amount, 0)"),),
               "discount_amount", filters=("invoice_id is not null",), date_column="invoice_month"),
        Metric("refund_amount", "stripe_payments", (("refund_amount", "coalesce(refund_amount, 0)"),),
               "refund_amount", filters=("refund_amount >= 0",), date_column="payment_month"),
        Metric("net_mrr", "fact_subscriptions",
               (("gross", "mrr_amount"), ("discount", "coalesce(discount_amount, 0)"),
                ("refund", "coalesce(refund_amount, 0)")),
               "gross - discount - refund", ambiguity_group="revenue", needs="subscription_adjustments"),
        Metric("outstanding_amount", "stripe_invoices",
               (("billed", "invoice_amount"), ("paid", "coalesce(collected_amount, 0)")),
               "billed - paid", date_column="invoice_month", needs="invoice_payments"),
        Metric("collection_rate", "stripe_invoices",
               (("billed", "invoice_amount"), ("paid", "coalesce(collected_amount, 0)")),
               "try_divide(cast(paid as double), cast(billed as double))", date_column="invoice_month",
               needs="invoice_payments"),
    )
}

# Dimensions.
DIMENSIONS = {
    d.name: d
    for d in (
        Dimension("customer", "dim_customers", "customer_id", ("customer_id", "customer_name")),
        Dimension("customer_name", "dim_customers", "customer_id", ("customer_name",)),
        Dimension("customer_segment", "dim_customers", "customer_id", ("customer_segment",)),
        Dimension("plan", "dim_plans", "plan_id", ("plan_id", "plan_name")),
        Dimension("plan_name", "dim_plans", "plan_id", ("plan_name",)),
        Dimension("invoice_month", "stripe_invoices", "invoice_id", ("invoice_month",)),
        Dimension("payment_month", "stripe_payments", "payment_id", ("payment_month",)),
    )
}

# Time phrases.
TIME_PHRASES = {
    p.name: p
    for p in (
        TimePhrase("last_month", "previous_calendar_month"),
        TimePhrase("this_month", "current_calendar_month"),
        TimePhrase("last_30_days", "rolling_days", 30),
        TimePhrase("all_time", "all_time"),
        TimePhrase("this_quarter", "current_quarter"),
        TimePhrase("last_quarter", "previous_quarter"),
    )
}

# Monthly metric marts chosen by a clarification answer.
MONTHLY_MARTS = {
    "billed_revenue": MonthlyMetricMart(
        "mart_billing__monthly_invoice_revenue", "stripe_invoices", "stg_stripe__invoices",
        ("invoice_id", "subscription_id", "invoice_month", "invoice_amount", "discount_amount"),
        "invoice_month", "invoice_amount", "billed_revenue",
    ),
    "collected_revenue": MonthlyMetricMart(
        "mart_payments__monthly_collected_revenue", "stripe_payments", "stg_stripe__payments",
        ("payment_id", "invoice_id", "payment_month", "successful_amount", "refund_amount"),
        "payment_month", "successful_amount", "collected_revenue",
    ),
}

# Clarification rules with terms and option texts.
ACTION_TERMS = ("create", "build", "generate", "prepare", "make", "draft", "help create", "help me create")
ARTIFACT_TERMS = (
    "pipeline", "data product", "dataset", "mart", "model", "models", "dbt", "dashboard dataset",
)
REVENUE_RULE = TextRule(
    id="revenue_definition_for_pipeline",
    question_id="q_revenue_definition",
    all_any={
        "action_terms": ACTION_TERMS,
        "artifact_terms": ARTIFACT_TERMS,
        "business_terms": ("revenue", "mrr", "monthly recurring revenue"),
        "domain_terms": (
            "stripe", "invoice", "invoices", "payment", "payments", "subscription", "subscriptions",
        ),
    },
    missing_explicit_choice=True,
    options=(
        RuleOption(
            "billed_revenue", "Billed revenue from invoices",
            ("billed revenue", "invoice revenue", "invoiced revenue", "invoice amount", "invoices", "invoice based"),
            "Monthly revenue means billed revenue from invoices.",
            "Use invoice_amount aggregated by invoice_month.",
        ),
        RuleOption(
            "collected_revenue", "Collected revenue from payments",
            ("collected revenue", "payment revenue", "cash collected", "successful payments", "payments",
             "payment based"),
            "Monthly revenue means collected revenue from payments.",
            "Use successful_amount aggregated by payment_month.",
        ),
        RuleOption(
            "gross_mrr", "Gross MRR from subscriptions",
            ("gross mrr", "mrr", "monthly recurring revenue", "subscription revenue", "subscriptions"),
            "Monthly revenue means gross MRR from subscription records.",
            "Use mrr_amount as gross_mrr.",
        ),
        RuleOption(
            "net_mrr", "Net revenue after discounts and refunds",
            ("net mrr", "adjusted mrr", "net revenue", "after discounts", "after refunds", "discounts and refunds"),
            "Monthly revenue means net revenue after discounts and refunds.",
            "Combine MRR, discounts, and refunds into a net revenue metric.",
        ),
    ),
)
ADJUSTMENT_RULE = TextRule(
    id="refund_discount_handling_for_revenue_product",
    question_id="q_refund_discount_handling",
    all_any={
        "action_terms": ACTION_TERMS,
        "artifact_terms": ARTIFACT_TERMS,
        "adjustment_terms": ("refund", "refunds", "discount", "discounts"),
        "uncertainty_terms": ("unclear", "not sure", "unsure", "should be handled", "how to handle", "how should"),
    },
    missing_explicit_choice=True,
    options=(
        RuleOption(
            "gross_only", "Report gross MRR only and show adjustments separately",
            ("gross only", "show adjustments separately", "separate adjustments"),
            "Keep gross MRR unchanged and expose discounts/refunds as separate supporting columns.",
            "Build gross_mrr plus discount_amount and refund_amount without netting.",
        ),
        RuleOption(
            "net_only", "Report net MRR after discounts and refunds",
            ("net only", "net mrr", "subtract adjustments", "after discounts and refunds"),
            "Net MRR equals gross MRR minus discount and refund adjustments.",
            "Derive net_mrr = gross_mrr - discount_amount - refund_amount.",
        ),
        RuleOption(
            "gross_and_net", "Report both gross MRR and net MRR with adjustment breakdown",
            ("gross and net", "both gross and net", "adjustment breakdown", "show both"),
            "Report gross_mrr, discount_amount, refund_amount, and net_mrr together.",
            "Build gross and net MRR at invoice_month/customer_segment grain.",
        ),
    ),
)
CLARIFICATION_RULES = (REVENUE_RULE, ADJUSTMENT_RULE)

# Words ignored when an answer is compared with an option.
STOPWORDS = (
    "a", "an", "the", "to", "as", "is", "are", "be", "by", "for", "from", "with", "and", "or", "of", "in",
    "on", "it", "this", "that", "should",
)

# Words that mark a free answer as a handling rule.
RULE_VERBS = (
    "treat", "use", "set", "replace", "exclude", "include", "filter", "flag", "convert", "group",
    "deduplicate", "subtract", "ignore", "map", "keep", "remove", "drop", "calculate", "aggregate",
    "separate", "validate",
)

# Columns with their own list of affected artifacts.
AMOUNT_COLUMNS = (
    "amount", "successful_amount", "discount_amount", "refund_amount", "invoice_amount", "mrr_amount",
)
KEY_COLUMNS = ("payment_id", "customer_id", "subscription_id", "invoice_id", "plan_id")

# Order of severities, and evidence keys kept in a compact finding.
SEVERITY_ORDER = ("must_answer", "error", "warning", "optional_review", "info")
COMPACT_EVIDENCE_KEYS = ("relationship_id", "left_source", "right_source", "source", "column")
COMPACT_FINDING_LIMIT = 12
COMPACT_MESSAGE_CHARS = 500

# Status set by an event type, for an agent and for a run.
AGENT_STATUS = {
    "session_started": "running",
    "agent_started": "running",
    "sub_agent_started": "running",
    "ask_user_answered": "running",
    "ask_user": "waiting_for_user",
    "sub_agent_completed": "completed",
    "agent_completed": "completed",
    "agent_failed": "failed",
    "error": "failed",
}
RUN_STATUS = {
    "session_started": "running",
    "ask_user_answered": "running",
    "ask_user": "waiting_for_user",
    "agent_failed": "failed",
    "error": "failed",
    "done": "completed",
}
RECENT_ACTIVITY_LIMIT = 8

# Preview and log limits.
PREVIEW_DEFAULT = 50
PREVIEW_MAX = 200
LOG_MAX_CHARS = 2500
LOG_TRUNCATION_MARK = "... [truncated]"
