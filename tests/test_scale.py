"""Plans and results that must hold when nothing is small and keys are skewed."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest
from conftest import as_set, make, plan_of

from ledgergrain import fixed_values as fixed
from ledgergrain.operators import datatests as dt
from ledgergrain.operators import joins, metrics, quality
from ledgergrain.operators import relationships as rel
from ledgergrain.operators.metrics import MetricRequest
from ledgergrain.plans import models as m

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1KB",
}


@pytest.fixture
def nothing_broadcast(spark):
    old = {k: spark.conf.get(k) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all payments on one invoice, a third of all invoices on one subscription."""
    t = make(spark)
    n = 6000
    t["fact_subscriptions"] = spark.range(50).selectExpr(
        "concat('s', id) subscription_id", "concat('k', id % 5 + 1) customer_id",
        "element_at(array('base', 'team', 'corp'), int(id % 3) + 1) plan_id", "cast(id as decimal(18,2)) mrr_amount",
    )
    t["stripe_invoices"] = spark.range(n).selectExpr(
        "concat('i', id) invoice_id", "concat('s', if(id % 3 = 0, 7, id % 60)) subscription_id",
        "concat('2025-0', id % 9 + 1) invoice_month", "cast(id % 100 as decimal(18,2)) invoice_amount",
        "if(id % 4 = 0, null, cast(1 as decimal(18,2))) discount_amount",
    )
    t["stripe_payments"] = spark.range(n).selectExpr(
        "concat('p', id) payment_id", "concat('i', if(id % 3 = 0, 5, id)) invoice_id",
        "concat('2025-0', id % 9 + 1) payment_month", "cast(id % 10 as decimal(18,2)) successful_amount",
        "cast(id % 2 as decimal(18,2)) refund_amount",
    )
    return t


def results(t):
    i, p = t["stripe_invoices"], t["stripe_payments"]
    s, c = t["fact_subscriptions"], t["dim_customers"]
    return [
        as_set(m.revenue_360(m.mrr_adjustments(i, p), s, c)),
        as_set(m.collection_health(i, p, s, c)),
        as_set(metrics.run(t, MetricRequest("collected_revenue", "group_by", ("customer_segment", "plan")))),
        as_set(metrics.run(t, MetricRequest("invoice_count", "group_by", ("customer",)))),
        as_set(rel.summaries(t, fixed.RELATIONSHIPS)),
        as_set(rel.orphans(i, ("subscription_id",), s, ("subscription_id",))),
        as_set(quality.duplicate_keys(p, "invoice_id")),
    ]


def test_same_results_without_broadcast_and_with_split_partitions(nothing_broadcast, skewed):
    split = results(skewed)
    assert "SortMergeJoin" in plan_of(m.invoice_reconciliation(skewed["stripe_invoices"], skewed["stripe_payments"]))
    for k in SETTINGS:
        nothing_broadcast.conf.unset(k)
    assert results(skewed) == split


def test_sums_equal_a_plain_join(skewed):
    t = skewed
    plain = (
        t["stripe_payments"].join(t["stripe_invoices"], "invoice_id", "left")
        .join(t["fact_subscriptions"], "subscription_id", "left")
        .join(t["dim_customers"], "customer_id", "left").where("successful_amount > 0")
        .groupBy("customer_segment").agg({"successful_amount": "sum"})
    )
    rolled = metrics.run(t, MetricRequest("collected_revenue", "group_by", ("customer_segment",)))
    assert {(k, float(v)) for k, v in as_set(plain)} == as_set(rolled)


def test_no_plan_multiplies_rows(skewed):
    t = skewed
    i, p = t["stripe_invoices"], t["stripe_payments"]
    for df in (
        m.revenue_360(m.mrr_adjustments(i, p), t["fact_subscriptions"], t["dim_customers"]),
        metrics.run(t, MetricRequest("net_mrr", "group_by", ("customer_segment", "plan"))),
        rel.summaries(t, fixed.RELATIONSHIPS),
        quality.combined_findings(t, fixed.CONTRACTS),
    ):
        plan = plan_of(df)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan


def test_columns_and_filters_reach_the_files(spark, tables, tmp_path):
    path = str(tmp_path / "i")
    tables["stripe_invoices"].write.parquet(path)
    t = dict(tables, stripe_invoices=spark.read.parquet(path))
    df = metrics.run(t, MetricRequest("billed_revenue", month="2025-01"))
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "EqualTo(invoice_month,2025-01)" in plan
    assert "ReadSchema: struct<invoice_month:string,invoice_amount:decimal(18,2)>" in plan


CHECKPOINT = """
import sys
sys.path.insert(0, sys.argv[1])
from ledgergrain.session import checkpointed, local_session, run_folder, shared_folder
spark = local_session(1, "c", **{"spark.checkpoint.dir": sys.argv[2]})
assert shared_folder(spark).endswith(sys.argv[2]), shared_folder(spark)
assert checkpointed(spark.range(3)).count() == 3 and sys.argv[2] in run_folder(spark, "x")
assert sys.argv[2] in spark.sparkContext.getCheckpointDir()
"""


def test_the_session_names_the_shared_folder(tmp_path):
    repo = str(Path(__file__).resolve().parents[1])
    done = subprocess.run(
        [sys.executable, "-c", CHECKPOINT, repo, str(tmp_path / "shared")], capture_output=True, text=True, timeout=240
    )
    assert done.returncode == 0, done.stderr[-2000:]
    assert any((tmp_path / "shared").iterdir())


def test_a_summary_counts_each_relationship_once(skewed):
    """Row tests share a pass per table, and a relationship also answers whether its parent's key is unique."""
    t = {n: skewed[n] for n in ("fact_subscriptions", "stripe_invoices")}
    edge = next(r for r in fixed.RELATIONSHIPS if r.right_source == "stripe_invoices")
    tests = [x for n in t for x in dt.contract_tests(n, fixed.CONTRACTS[n])] + dt.relationship_tests((edge,))
    plan = plan_of(dt.summary(t, tests))
    # Two passes of row tests, two sides of the relationship, and the invoices' own key.
    assert plan.count("Range (") == 5
    assert {r.test_name: r.failing_rows for r in dt.summary(t, tests).collect() if "unique" in r.test_name} == {
        "unique__fact_subscriptions__subscription_id": 0, "unique__stripe_invoices__invoice_id": 0,
    }


def test_totals_are_summed_below_the_joins(skewed):
    totals = joins.chain_totals(skewed, "customer_segment", "plan_name")
    plain = joins.payment_chain(skewed).groupBy("customer_segment", "plan_name").count()
    assert as_set(totals, "customer_segment", "plan_name", "payments") == as_set(plain)
    lines = plan_of(totals).splitlines()
    deepest = max(i for i, x in enumerate(lines) if "Join" in x)
    assert sum("HashAggregate" in x for x in lines[deepest:]) >= 2
