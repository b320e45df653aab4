"""Staging, intermediate and mart models as DataFrames that compose lazily."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgergrain.functions.columns import as_double, or_zero
from ledgergrain.functions.sequence import first_per_group
from ledgergrain.operators.joins import invoices_with_payments
from ledgergrain.specs import MonthlyMetricMart, SourceContract


def project(df: DataFrame, columns: tuple[str, ...], contract: SourceContract | None = None) -> DataFrame:
    """Generic staging: the configured columns, which the contract must know."""
    if contract is not None:
        unknown = [c for c in columns if contract.column(c) is None]
        if unknown:
            raise ValueError(f"not in the contract of {contract.name}: {unknown}")
    return df.select(*columns)


def clean(df: DataFrame, contract: SourceContract) -> DataFrame:
    """Trimmed text, month keys cut to ``yyyy-MM``, rows that break the contract dropped, one row per key.

    Among copies of a key the first by all other columns stays, so the choice is repeatable. A row whose key
    has a null, where the contract allows it, is a copy of none.
    """
    kinds = dict(df.dtypes)
    columns = []
    for c in contract.columns:
        if kinds.get(c.name) == "string":
            trimmed = F.trim(c.name)
            columns.append((F.substring(trimmed, 1, 7) if c.logical_type == "month" else trimmed).alias(c.name))
        else:
            columns.append(F.col(c.name))
    rows, valid = df.select(*columns), F.lit(True)
    for c in contract.columns:
        if not c.nullable:
            valid = valid & F.col(c.name).isNotNull()
        if c.valid_values:
            valid = valid & (F.col(c.name).isNull() | F.col(c.name).isin(*[v for v in c.valid_values if v]))
    keys = list(contract.primary_keys)
    if not any(contract.column(k).nullable for k in keys):
        return _first_valid(rows, valid, contract)
    filled = F.lit(True)
    for k in keys:
        filled = filled & F.col(k).isNotNull()
    return _first_valid(rows.where(filled), valid, contract).unionByName(rows.where(valid & ~filled))


def _first_valid(rows: DataFrame, valid: Column, contract: SourceContract) -> DataFrame:
    """The first valid row per key. Valid rows come first and the others go after the cut: a filter before it would be
    pushed below the columns that it reads, and what computes them would run once more for it.

    A first column that may not be null says which rows are invalid, being null there; else one more column does.
    """
    keys, others = list(contract.primary_keys), [c for c in contract.columns if not c.primary_key]
    mark = others[0].name if others and not others[0].nullable else "_valid"
    marked = rows.withColumn(mark, F.when(valid, F.lit(True) if mark == "_valid" else F.col(mark)))
    order = [F.col(c.name) for c in others if c.name != mark]
    kept = first_per_group(marked, keys, [F.col(mark).asc_nulls_last(), *order]).where(F.col(mark).isNotNull())
    return kept.select(*rows.columns)


def monthly_metric(staged: DataFrame, spec: MonthlyMetricMart) -> DataFrame:
    """One sum per month, in month order."""
    value = or_zero(spec.value_column) if spec.coalesce_value else F.col(spec.value_column)
    return (
        staged.groupBy(spec.month_column)
        .agg(as_double(F.sum(value)).alias(spec.output_metric))
        .orderBy(spec.month_column)
    )


def mrr_adjustments(invoices: DataFrame, payments: DataFrame) -> DataFrame:
    """Discounts and refunds by subscription and invoice month."""
    return (
        invoices_with_payments(invoices, payments)
        .where(F.col("invoice_month").isNotNull())
        .groupBy("subscription_id", "invoice_month")
        .agg(
            F.sum(or_zero("discount_amount")).alias("discount_amount"),
            F.sum("refund_amount").alias("refund_amount"),
        )
    )


REVENUE_COLUMNS = {
    "gross_only": ("gross_mrr", "discount_amount", "refund_amount"),
    "net_only": ("net_mrr", "discount_amount", "refund_amount"),
    "gross_and_net": ("gross_mrr", "discount_amount", "refund_amount", "net_mrr"),
}


def revenue_360(
    adjustments: DataFrame, subscriptions: DataFrame, customers: DataFrame, mode: str = "gross_and_net"
) -> DataFrame:
    """Month and segment: gross MRR once per invoiced subscription-month, adjustments and net MRR.

    What belongs to no known subscription or customer stays, under a null segment.
    """
    by_customer = (
        adjustments.join(subscriptions.select("subscription_id", "customer_id", "mrr_amount"), "subscription_id", "left")
        .groupBy("customer_id", "invoice_month")
        .agg(
            F.sum(or_zero("mrr_amount")).alias("g"),
            F.sum("discount_amount").alias("d"),
            F.sum("refund_amount").alias("r"),
        )
    )
    sums = (
        by_customer.join(customers.select("customer_id", "customer_segment"), "customer_id", "left")
        .groupBy("invoice_month", "customer_segment")
        .agg(F.sum("g").alias("g"), F.sum("d").alias("d"), F.sum("r").alias("r"))
    )
    named = sums.select(
        "invoice_month",
        "customer_segment",
        as_double("g").alias("gross_mrr"),
        as_double("d").alias("discount_amount"),
        as_double("r").alias("refund_amount"),
        as_double(F.col("g") - F.col("d") - F.col("r")).alias("net_mrr"),
    )
    return named.select("invoice_month", "customer_segment", *REVENUE_COLUMNS[mode])


def invoice_reconciliation(invoices: DataFrame, payments: DataFrame) -> DataFrame:
    """Per invoice: billed, collected, refund and the difference."""
    paid = invoices_with_payments(invoices, payments)
    return paid.select(
        "invoice_id",
        as_double("invoice_amount").alias("billed_amount"),
        as_double("collected_amount").alias("collected_amount"),
        as_double("refund_amount").alias("refund_amount"),
        as_double(F.col("invoice_amount") - F.col("collected_amount")).alias("reconciliation_difference"),
    )


def _by_month_and_segment(invoices, payments, subscriptions, customers) -> DataFrame:
    """Exact sums by month and segment, grouped before each join; orphans come under a null segment."""
    measures = ("billed", "collected", "refund", "invoices")

    def summed(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])

    paid = invoices_with_payments(invoices, payments).select(
        "subscription_id",
        "invoice_month",
        or_zero("invoice_amount").alias("billed"),
        F.col("collected_amount").alias("collected"),
        F.col("refund_amount").alias("refund"),
        F.lit(1).cast("bigint").alias("invoices"),
    )
    by_subscription = summed(paid, "subscription_id", "invoice_month")
    by_customer = summed(
        by_subscription.join(subscriptions.select("subscription_id", "customer_id"), "subscription_id", "left"),
        "customer_id",
        "invoice_month",
    )
    return summed(
        by_customer.join(customers.select("customer_id", "customer_segment"), "customer_id", "left"),
        "invoice_month",
        "customer_segment",
    )


def collection_health(invoices, payments, subscriptions, customers) -> DataFrame:
    """Month and segment: billed, collected, refunded and outstanding amount."""
    sums = _by_month_and_segment(invoices, payments, subscriptions, customers)
    return sums.select(
        "invoice_month",
        "customer_segment",
        as_double("billed").alias("billed_amount"),
        as_double("collected").alias("collected_amount"),
        as_double("refund").alias("refund_amount"),
        as_double(F.col("billed") - F.col("collected")).alias("outstanding_amount"),
    )


def collection_gap(invoices: DataFrame, payments: DataFrame) -> DataFrame:
    """Month: billed, collected and the gap."""
    sums = (
        invoices_with_payments(invoices, payments)
        .groupBy("invoice_month")
        .agg(F.sum(or_zero("invoice_amount")).alias("b"), F.sum("collected_amount").alias("c"))
    )
    return sums.select(
        "invoice_month",
        as_double("b").alias("billed_revenue"),
        as_double("c").alias("collected_revenue"),
        as_double(F.col("b") - F.col("c")).alias("collection_gap"),
    )


def monthly_reconciliation(invoices, payments, subscriptions, customers) -> DataFrame:
    """Month and segment: billed, collected, difference and number of invoices."""
    sums = _by_month_and_segment(invoices, payments, subscriptions, customers)
    return sums.select(
        "invoice_month",
        "customer_segment",
        as_double("billed").alias("billed_amount"),
        as_double("collected").alias("collected_payment_amount"),
        as_double(F.col("billed") - F.col("collected")).alias("reconciliation_difference"),
        F.col("invoices").cast("bigint").alias("invoice_count"),
    )


def monthly_mrr(subscriptions: DataFrame) -> DataFrame:
    """MRR by customer and plan; its source has no month."""
    return subscriptions.groupBy("customer_id", "plan_id").agg(as_double(F.sum("mrr_amount")).alias("mrr"))


