from __future__ import annotations

from collections import Counter

from conftest import PAYMENTS, as_set, cash, make, plan_of

from ledgergrain import fixed_values as fixed
from ledgergrain.operators import joins
from ledgergrain.operators import relationships as rel
from ledgergrain.specs import Relationship

PAY = fixed.RELATIONSHIPS[3]


def test_summaries_of_the_small_tables(tables):
    rows = {r.relationship_id: r for r in rel.summaries(tables, fixed.RELATIONSHIPS).collect()}
    assert {k: r.status for k, r in rows.items()} == {
        "customers_to_subscriptions": "passed",
        "plans_to_subscriptions": "warning",
        "subscriptions_to_invoices": "warning",
        "invoices_to_payments_by_invoice_id": "warning",
    }
    assert rows["plans_to_subscriptions"].unmatched_left_rate == 0.25
    pay = rows["invoices_to_payments_by_invoice_id"]
    assert (pay.unmatched_left_count, pay.unmatched_left_rate, pay.right_duplicate_key_count) == (1, 0.1429, 1)
    assert (pay.partial_count, pay.overpaid_count, pay.fully_paid_count) == (1, 1, 4)


def broken(spark):
    rows = [
        *PAYMENTS, ("p8", None, "2025-03", *cash(5, 0)), ("p9", "gone", "2025-03", *cash(5, 0)),
        ("pa", "gone", "2025-03", *cash(5, 0)),
    ]
    return make(spark, stripe_payments=rows)


def test_null_and_orphan_keys_are_told_apart(spark):
    t = broken(spark)
    row = rel.summary(t["stripe_invoices"], t["stripe_payments"], PAY).first()
    assert (row.right_null_key_count, row.unmatched_right_count, row.unmatched_right_rate) == (1, 2, 0.2)
    found = {r.type: r for r in rel.findings(t["stripe_invoices"], t["stripe_payments"], PAY).collect()}
    right = found["unmatched_right_records"]
    assert right.severity == "optional_review" and right.id == "issue_unmatched_payments"
    assert right.evidence["right_null_rate"] == "0.1000"
    assert found["payment_coverage_anomaly"].evidence["partial_count"] == "1"
    lost = rel.orphans(t["stripe_payments"], ("invoice_id",), t["stripe_invoices"], ("invoice_id",))
    assert as_set(lost, "payment_id") == {("p9",), ("pa",)}
    assert "LeftAnti" in plan_of(lost)


def test_only_nulls_still_raise_and_threshold_is_strict(spark):
    t = make(spark, stripe_payments=[*PAYMENTS, ("p8", None, "2025-03", *cash(5, 0))])
    found = {r.type: r for r in rel.findings(t["stripe_invoices"], t["stripe_payments"], PAY).collect()}
    assert found["unmatched_right_records"].evidence["unmatched_right_count"] == "0"
    b = broken(spark)
    for limit, severity in ((0.2, "optional_review"), (0.19, "must_answer")):
        edge = Relationship("e", "stripe_invoices", "stripe_payments", "invoice_id", "invoice_id",
                            max_unmatched_right_rate=limit)
        rows = rel.findings(b["stripe_invoices"], b["stripe_payments"], edge).where("type = 'unmatched_right_records'")
        assert [r.severity for r in rows.collect()] == [severity]


def test_left_duplicates_need_the_unique_flag(spark):
    t = make(spark, dim_plans=[("base", "A"), ("base", "B"), ("team", "T"), ("corp", "C")])
    plans = fixed.RELATIONSHIPS[1]
    found = rel.findings(t["dim_plans"], t["fact_subscriptions"], plans).collect()
    assert [r.id for r in found] == ["plans_to_subscriptions__left_key_duplicates"]
    loose = Relationship("x", "dim_plans", "fact_subscriptions", "plan_id", "plan_id")
    assert rel.findings(t["dim_plans"], t["fact_subscriptions"], loose).count() == 0


def test_missing_key_fails(tables):
    left = tables["stripe_invoices"].withColumnRenamed("invoice_id", "id")
    row = rel.summary(left, tables["stripe_payments"], PAY).first()
    assert (row.status, row.left_rows, row.right_rows, row.unmatched_left_count) == ("failed", 7, 7, None)
    found = rel.findings(left, tables["stripe_payments"], PAY).collect()
    assert [f.type for f in found] == ["missing_join_key"]


def test_composite_keys(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, None)], "k int, c string")
    right = spark.createDataFrame([(1, "a"), (3, "a"), (None, "b")], "k int, c string")
    edge = Relationship("c", "l", "r", ("k", "c"), ("k", "c"))
    row = rel.summary(left, right, edge).first()
    assert (row.left_rows, row.right_rows, row.left_duplicate_key_count) == (4, 3, 1)
    assert (row.unmatched_left_count, row.unmatched_right_count, row.right_null_key_count) == (2, 1, 1)
    assert rel.summary(left, right, edge, composite=False).first().status == "not_validated"


def test_key_figures_need_no_join(tables):
    plan = plan_of(rel.key_figures(tables["stripe_invoices"], tables["stripe_payments"], PAY))
    assert "Join" not in plan and "Cartesian" not in plan


def test_coverage_counts_copies_of_an_invoice_like_a_raw_join(spark):
    invoices = [("i1", "s1", "2025-01", *cash(100, 0)), ("i1", "s1", "2025-01", *cash(100, 0)),
                ("i1", "s1", "2025-01", *cash(60, 0)), ("i2", "s1", "2025-01", *cash(0, 0))]
    t = make(spark, stripe_invoices=invoices, stripe_payments=[("p", "i1", "2025-01", *cash(50, 0))])
    assert tuple(rel.payment_coverage(t["stripe_invoices"], t["stripe_payments"]).first()) == (1, 0, 1)


def test_preaggregated_join_keeps_totals(tables):
    invoices, payments = tables["stripe_invoices"], tables["stripe_payments"]
    joined = joins.invoices_with_payments(invoices, payments)
    guard = joins.fanout_guard(invoices, joined, "invoice_amount").first()
    assert guard.preserved and guard.rows_after == 7
    raw = joins.fanout_guard(invoices, invoices.join(payments, "invoice_id", "left"), "invoice_amount").first()
    assert not raw.preserved and raw.rows_after == 8
    paid = Counter()
    for _, i, _, amount, _ in PAYMENTS:
        paid[i] += amount
    assert {r.invoice_id: r.collected_amount for r in joined.collect()} == {f"i{n}": paid[f"i{n}"] for n in range(1, 8)}


def test_chain_joins_every_payment_once(tables):
    assert joins.payment_chain(tables).count() == len(PAYMENTS)


def test_hot_key_is_counted_exactly(spark):
    hot = spark.range(90_000).selectExpr("if(id % 3 = 0, -1, id) as k")
    other = spark.range(100).selectExpr("id as k")
    edge = Relationship("h", "l", "r", "k", "k")
    row = rel.summary(other, hot, edge).first()
    matched = sum(1 for i in range(100) if i % 3)
    assert row.unmatched_right_count == 90_000 - matched
    assert row.unmatched_left_count == 100 - matched and row.right_duplicate_key_count == 1
