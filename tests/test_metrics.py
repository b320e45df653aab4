from __future__ import annotations

from collections import defaultdict
from decimal import Decimal

import pytest
from conftest import CUSTOMERS, INVOICES, PAYMENTS, SUBSCRIPTIONS, as_set, cash, make, plan_of

from ledgergrain import fixed_values as fixed
from ledgergrain.functions.time_phrases import in_date_phrase
from ledgergrain.operators import metrics
from ledgergrain.operators.metrics import MetricRequest, run

SEGMENT = {c: s for c, _, s in CUSTOMERS}
CUSTOMER = {s: c for s, c, _, _ in SUBSCRIPTIONS}
SUBSCRIPTION = {i: s for i, s, *_ in INVOICES}
PLAN = {s: p for s, _, p, _ in SUBSCRIPTIONS}


def by(df, *keys):
    return {tuple(r[k] for k in keys): r[-1] for r in df.collect()}


def total(rows):
    sums = defaultdict(Decimal)
    for key, value in rows:
        sums[key] += value
    return {k: float(v) for k, v in sums.items()}


def test_payment_metric_reaches_segment_and_plan(tables):
    expected = total(
        ((SEGMENT[CUSTOMER[SUBSCRIPTION[i]]], PLAN[SUBSCRIPTION[i]].title()), a) for _, i, _, a, _ in PAYMENTS
    )
    request = MetricRequest("collected_revenue", "group_by", ("customer_segment", "plan_name"))
    assert by(run(tables, request), "customer_segment", "plan_name") == expected


def test_metric_keeps_base_month_and_climbs(tables):
    expected = total(((m, SEGMENT[CUSTOMER[s]]), a) for _, s, m, a, _ in INVOICES)
    request = MetricRequest("billed_revenue", "group_by", ("invoice_month", "customer_segment"))
    assert by(run(tables, request), "invoice_month", "customer_segment") == expected
    pay = MetricRequest("collected_revenue", "group_by", ("payment_month", "invoice_month"))
    months = {i: m for i, _, m, *_ in INVOICES}
    assert by(run(tables, pay), "payment_month", "invoice_month") == total(
        ((p, months[i]), a) for _, i, p, a, _ in PAYMENTS
    )


def test_group_before_join(tables):
    plan = plan_of(run(tables, MetricRequest("collected_revenue", "group_by", ("customer_segment",))))
    assert plan.count("partial_sum") >= 3 and "Cartesian" not in plan


def test_customer_dimension_keeps_key_and_name(tables):
    rows = by(run(tables, MetricRequest("mrr", "group_by", ("customer",))), "customer_id", "customer_name")
    assert rows[("k2", "Blue Harbor")] == 300.0 and len(rows) == 5


def test_top_k_breaks_ties_by_key(tables):
    top = run(tables, MetricRequest("mrr", "top_k", ("customer",))).collect()
    assert [(r.customer_id, r.mrr) for r in top] == [("k1", 700.0)]
    two = run(tables, MetricRequest("mrr", "top_k", ("customer",), limit=2)).collect()
    assert [r.customer_id for r in two] == ["k1", "k4"]


def test_totals_and_empty_month(tables):
    assert run(tables, MetricRequest("billed_revenue", month="2025-02")).first()[0] == 1610.0
    assert run(tables, MetricRequest("billed_revenue", month="2030-01")).first()[0] is None
    assert run(tables, MetricRequest("invoice_count", "count")).first()[0] == 7


def test_derived_metrics(tables):
    assert run(tables, MetricRequest("outstanding_amount")).first()[0] == 2580.0 - 2260.0
    assert run(tables, MetricRequest("collection_rate")).first()[0] == pytest.approx(2260 / 2580)
    assert run(tables, MetricRequest("net_mrr")).first()[0] == 1760.0 - 85.0 - 50.0
    assert run(tables, MetricRequest("discount_amount")).first()[0] == 85.0


def test_refund_filter_drops_null_and_mrr_filter_drops_zero(spark):
    t = make(
        spark,
        stripe_payments=[*PAYMENTS, ("px", "i1", "2025-01", *cash(5, None)), ("py", "i1", "2025-01", *cash(5, -7))],
        fact_subscriptions=[*SUBSCRIPTIONS, ("s7", "k1", "corp", *cash(-100))],
    )
    assert run(t, MetricRequest("refund_amount")).first()[0] == 50.0
    assert run(t, MetricRequest("refund_amount", default_filters=False)).first()[0] == 43.0
    assert run(t, MetricRequest("mrr")).first()[0] == 1760.0
    assert run(t, MetricRequest("mrr", default_filters=False)).first()[0] == 1660.0


def test_empty_bill_gives_null_rate(spark):
    t = make(spark, stripe_invoices=[("i1", "s1", "2025-01", *cash(0, 0))])
    assert run(t, MetricRequest("collection_rate")).first()[0] is None


def test_time_phrases_on_month_keys(tables):
    def billed(phrase):
        return run(tables, MetricRequest("billed_revenue", phrase=phrase)).first()[0]

    assert billed("this_month") == 1610.0 and billed("last_month") == 970.0
    assert billed("this_quarter") == 2580.0 and billed("last_quarter") is None and billed("all_time") == 2580.0
    with pytest.raises(ValueError, match="month keys"):
        billed("last_30_days")
    with pytest.raises(ValueError, match="no date column"):
        run(tables, MetricRequest("mrr", phrase="this_month"))


def test_date_phrases_are_half_open(spark):
    days = ["2025-02-28", "2025-02-27", "2025-01-30", "2025-01-29", "2024-12-31", "2024-10-01", "2024-09-30"]
    df = spark.createDataFrame([(d,) for d in days], "d string").selectExpr("cast(d as date) as d")

    def kept(phrase):
        return sorted(str(r.d) for r in in_date_phrase(df, "d", fixed.TIME_PHRASES[phrase]).collect())

    assert kept("last_30_days") == ["2025-01-30", "2025-02-27", "2025-02-28"]
    assert kept("this_month") == ["2025-02-27", "2025-02-28"]
    assert kept("last_month") == ["2025-01-29", "2025-01-30"]
    assert kept("last_quarter") == ["2024-10-01", "2024-12-31"]
    assert len(kept("all_time")) == 7


def test_unreachable_dimension_and_unknown_pattern(tables):
    with pytest.raises(ValueError, match="cannot be split"):
        run(tables, MetricRequest("mrr", "group_by", ("invoice_month",)))
    with pytest.raises(ValueError, match="unknown pattern"):
        run(tables, MetricRequest("mrr", "guess"))


def test_net_mrr_by_segment(tables):
    rows = {r.customer_segment: tuple(r)[1:] for r in metrics.net_mrr_by_segment(tables).collect()}
    assert rows == {
        "enterprise": (1400.0, 70.0, 0.0, 1330.0),
        "mid_market": (300.0, 15.0, 20.0, 265.0),
        "self_serve": (30.0, 0.0, 0.0, 30.0),
        "startup": (30.0, 0.0, 30.0, 0.0),
    }


def test_ambiguous_readings(tables):
    rows = {r.metric: r.value for r in metrics.ambiguous_groups(tables).collect()}
    assert rows == {"mrr": 1760.0, "gross_mrr": 1760.0, "net_mrr": 1625.0, "billed_revenue": 2580.0,
                    "collected_revenue": 2260.0}


def test_month_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.sql("select 1 as id, '2025-01' as m, date'2025-01-31' as d union all select 2, '2025-02', date'2025-02-01'"
              ).write.parquet(path)
    df = metrics.month_filter(spark.read.parquet(path), "m", "2025-02", "d")
    assert as_set(df, "id") == {(2,)}
    assert "GreaterThanOrEqual(d," in plan_of(df)


def test_amounts(tables):
    assert tuple(metrics.amount_range(tables["stripe_payments"]).first()) == (30.0, 710.0)
    stats = {r.invoice_month: tuple(r)[1:] for r in metrics.monthly_stats(tables["stripe_invoices"]).collect()}
    assert stats["2025-01"] == (30.0, 700.0, 242.5)
