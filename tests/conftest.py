from __future__ import annotations

import sys
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from ledgergrain.session import local_session  # noqa: E402

MONEY = "decimal(18,2)"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


def cash(*values):
    return [None if v is None else Decimal(str(v)) for v in values]


# Own rows with a tie in MRR (k1, k4), a null discount, an unpaid invoice (i4), an unused plan (gold),
# refunds, a double payment (i2), an overpaid (i5) and a partly paid (i6) invoice.
CUSTOMERS = [
    ("k1", "North Mill", "enterprise"),
    ("k2", "Blue Harbor", "mid_market"),
    ("k3", "Tiny Owl", "startup"),
    ("k4", "Iron Lake", "enterprise"),
    ("k5", "Lone Desk", "self_serve"),
]
PLANS = [("base", "Base"), ("team", "Team"), ("corp", "Corp"), ("gold", "Gold")]
SUBSCRIPTIONS = [
    ("s1", "k1", "corp", *cash(700)),
    ("s2", "k2", "team", *cash(210)),
    ("s3", "k3", "base", *cash(30)),
    ("s4", "k4", "corp", *cash(700)),
    ("s5", "k5", "base", *cash(30)),
    ("s6", "k2", "team", *cash(90)),
]
INVOICES = [
    ("i1", "s1", "2025-01", *cash(700, 0)),
    ("i2", "s2", "2025-01", *cash(210, 10)),
    ("i3", "s3", "2025-01", *cash(30, None)),
    ("i4", "s5", "2025-01", *cash(30, 0)),
    ("i5", "s4", "2025-02", *cash(700, 70)),
    ("i6", "s1", "2025-02", *cash(700, None)),
    ("i7", "s2", "2025-02", *cash(210, 5)),
]
PAYMENTS = [
    ("p1", "i1", "2025-01", *cash(700, 0)),
    ("p2", "i2", "2025-01", *cash(110, 0)),
    ("p3", "i2", "2025-02", *cash(100, 20)),
    ("p4", "i3", "2025-02", *cash(30, 30)),
    ("p5", "i5", "2025-02", *cash(710, 0)),
    ("p6", "i6", "2025-02", *cash(400, 0)),
    ("p7", "i7", "2025-03", *cash(210, 0)),
]


def make(spark, **rows):
    schemas = {
        "dim_customers": "customer_id string, customer_name string, customer_segment string",
        "dim_plans": "plan_id string, plan_name string",
        "fact_subscriptions": f"subscription_id string, customer_id string, plan_id string, mrr_amount {MONEY}",
        "stripe_invoices": "invoice_id string, subscription_id string, invoice_month string, "
        f"invoice_amount {MONEY}, discount_amount {MONEY}",
        "stripe_payments": "payment_id string, invoice_id string, payment_month string, "
        f"successful_amount {MONEY}, refund_amount {MONEY}",
    }
    default = {
        "dim_customers": CUSTOMERS,
        "dim_plans": PLANS,
        "fact_subscriptions": SUBSCRIPTIONS,
        "stripe_invoices": INVOICES,
        "stripe_payments": PAYMENTS,
    }
    return {n: spark.createDataFrame(rows.get(n, default[n]), schemas[n]) for n in schemas}


@pytest.fixture(scope="session")
def tables(spark):
    return make(spark)


def as_set(df, *columns):
    return {tuple(r) for r in (df.select(*columns) if columns else df).collect()}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
