"""Joins that keep money exact: sums go below the join, so neither fan-out nor a hot key can hurt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def payments_by_invoice(payments: DataFrame) -> DataFrame:
    """Collected amount, refund and payment count per invoice."""
    return (
        payments.where(F.col("invoice_id").isNotNull())
        .groupBy("invoice_id")
        .agg(
            F.sum(F.coalesce("successful_amount", F.lit(0))).alias("collected_amount"),
            F.sum(F.coalesce("refund_amount", F.lit(0))).alias("refund_amount"),
            F.count(F.lit(1)).alias("payment_count"),
        )
    )


def invoices_with_payments(invoices: DataFrame, payments: DataFrame) -> DataFrame:
    """Every invoice once, with its summed payments; unpaid invoices get 0. Payments may come summed by invoice."""
    paid = payments if "collected_amount" in payments.columns else payments_by_invoice(payments)
    return invoices.join(paid, "invoice_id", "left").select(
        *invoices.columns,
        F.coalesce("collected_amount", F.lit(0)).alias("collected_amount"),
        F.coalesce("refund_amount", F.lit(0)).alias("refund_amount"),
        F.coalesce("payment_count", F.lit(0)).alias("payment_count"),
    )


def payment_chain(tables: dict[str, DataFrame]) -> DataFrame:
    """Payments with their invoice, subscription, customer and plan (inner equi joins).

    No side is forced to broadcast: Spark picks it from the measured size, and splits skewed keys.
    """
    customers = tables["dim_customers"]
    return (
        tables["stripe_payments"]
        .join(tables["stripe_invoices"], "invoice_id")
        .join(tables["fact_subscriptions"], "subscription_id")
        .join(customers, "customer_id")
        .join(tables["dim_plans"], "plan_id")
    )


def chain_totals(tables: dict[str, DataFrame], *by: str) -> DataFrame:
    """Number and collected amount of all payments along the chain, by columns of customers and plans.

    Payments are summed per invoice, then per subscription, then per customer and plan, each before the next join.
    """

    def summed(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.sum("payments").alias("payments"), F.sum("collected").alias("collected"))

    by_invoice = tables["stripe_payments"].groupBy("invoice_id").agg(
        F.count(F.lit(1)).alias("payments"), F.sum("successful_amount").alias("collected")
    )
    invoices = tables["stripe_invoices"].select("invoice_id", "subscription_id")
    subscriptions = tables["fact_subscriptions"].select("subscription_id", "customer_id", "plan_id")
    by_subscription = summed(by_invoice.join(invoices, "invoice_id"), "subscription_id")
    by_end = summed(by_subscription.join(subscriptions, "subscription_id"), "customer_id", "plan_id")
    return summed(by_end.join(tables["dim_customers"], "customer_id").join(tables["dim_plans"], "plan_id"), *by)


def fanout_guard(before: DataFrame, after: DataFrame, measure: str) -> DataFrame:
    """Rows and sum of a measure before and after a join; ``preserved`` is false when the join multiplied."""
    figures = [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(measure), F.lit(0)).alias("total")]
    old = before.agg(*figures).select(F.struct("rows", "total")).scalar()
    joined = after.agg(*figures).withColumn("_old", old)
    same = (F.col("rows") == F.col("_old")["rows"]) & (F.col("total") == F.col("_old")["total"])
    return joined.select(
        F.col("_old")["rows"].alias("rows_before"),
        F.col("rows").alias("rows_after"),
        F.col("_old")["total"].cast("double").alias("total_before"),
        F.col("total").cast("double").alias("total_after"),
        same.alias("preserved"),
    )
