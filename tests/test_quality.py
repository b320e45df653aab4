from __future__ import annotations

import bisect
import random
from dataclasses import replace
from pathlib import Path

import pyarrow.parquet as pq
from conftest import INVOICES, PAYMENTS, as_set, cash, make, plan_of

from ledgergrain import fixed_values as fixed
from ledgergrain.operators import profile, profile_state, quality
from ledgergrain.specs import ColumnCheck, ColumnSpec, SourceContract

INV = fixed.STRIPE_INVOICES


def ids(df):
    return {r.id for r in df.select("id").collect()}


def one(df, id):
    rows = [r for r in df.collect() if r.id == id]
    assert len(rows) == 1, [r.id for r in rows]
    return rows[0]


def test_clean_tables_have_only_expected_findings(tables):
    assert ids(quality.findings(tables["dim_customers"], fixed.DIM_CUSTOMERS)) == {
        "finding_customer_id_unique", "finding_customer_segment_accepted_values",
    }
    assert ids(quality.findings(tables["dim_plans"], fixed.DIM_PLANS)) == {"finding_plan_id_unique"}
    found = quality.findings(tables["stripe_invoices"], INV)
    assert ids(found) == {"finding_invoice_id_unique", "issue_discount_amount_null_rate"}
    rate = one(found, "issue_discount_amount_null_rate")
    assert rate.evidence["null_count"] == "2" and rate.evidence["null_rate"] == "0.2857"
    assert rate.message == "No discount_amount in 28.6% of rows." and rate.severity == "must_answer"
    refund = one(quality.findings(tables["stripe_payments"], fixed.STRIPE_PAYMENTS), "issue_refund_handling_needed")
    assert refund.message == "Payments with a positive refund_amount: 2."


def test_empty_table_is_the_only_finding(spark):
    empty = make(spark, stripe_invoices=[])["stripe_invoices"]
    strict = replace(INV, columns=(*INV.columns, ColumnSpec("absent", "text", False)))
    rows = quality.findings(empty, strict).collect()
    assert [(r.id, r.severity, r.column) for r in rows] == [("issue_empty_table", "must_answer", None)]


def test_schema_findings(tables):
    df = tables["stripe_invoices"].drop("discount_amount").withColumnRenamed("invoice_amount", "amount")
    df = df.selectExpr("*", "1 as invoice_amount", "current_timestamp() as stamp")
    found = quality.shared_aggregate_findings(df, INV)
    assert one(found, "issue_missing_column_discount_amount").evidence["expected_type"] == "real"
    mismatch = one(found, "issue_type_mismatch_invoice_amount")
    assert mismatch.severity == "optional_review" and mismatch.evidence["actual_type"] == "integer"
    assert one(found, "finding_extra_columns").evidence["extra_columns"] == "amount,stamp"


def test_required_nulls_and_threshold_is_inclusive(spark):
    rows = [*INVOICES[:9], ("i8", None, "2025-02", *cash(1, 0)), ("i9", "s1", None, *cash(1, 0))]
    df = make(spark, stripe_invoices=rows)["stripe_invoices"]
    found = quality.shared_aggregate_findings(df, INV)
    missing = one(found, "issue_subscription_id_required_nulls")
    assert missing.evidence["null_count"] == "1" and missing.affects == ["sql_model", "data_tests"]
    assert one(found, "issue_invoice_month_required_nulls").affects == ["data_tests", "documentation"]
    at = replace(INV, columns=(*INV.columns[:4], replace(INV.columns[4], null_rate_decision=2 / 9)))
    above = replace(INV, columns=(*INV.columns[:4], replace(INV.columns[4], null_rate_decision=0.23)))
    assert "issue_discount_amount_null_rate" in ids(quality.shared_aggregate_findings(df, at))
    assert "issue_discount_amount_null_rate" not in ids(quality.shared_aggregate_findings(df, above))


def test_duplicate_counts_are_exact(spark):
    keys = [f"p{i % 12:02d}" for i in range(30)] + [None, None, "single"]
    rows = [(k, "i1", "2025-01", *cash(1, 0)) for k in keys]
    df = make(spark, stripe_payments=rows)["stripe_payments"]
    found = one(quality.duplicate_findings(df, fixed.STRIPE_PAYMENTS)[0], "issue_payment_id_duplicates")
    assert found.evidence["duplicate_values"] == "12"
    assert found.evidence["duplicate_key_count"] == "12"
    assert found.evidence["total_rows"] == "33"
    assert found.evidence["examples"].split(",")[:2] == ["p00=3", "p01=3"]
    assert len(as_set(quality.duplicate_keys(df, "payment_id"))) == 12


def test_invalid_values_ignore_null(spark):
    rows = [("a", "A", "enterprise"), ("b", "B", "other"), ("c", "C", "other"), ("d", "D", None), ("e", "E", "x")]
    df = make(spark, dim_customers=rows)["dim_customers"]
    found = one(quality.valid_value_findings(df, fixed.DIM_CUSTOMERS)[0], "issue_customer_segment_invalid_values")
    assert found.evidence["invalid_count"] == "3" and found.evidence["invalid_value_count"] == "2"
    listed = quality.invalid_values(df, "customer_segment", (*fixed.SEGMENTS, None))
    assert as_set(listed) == {("other", 2), ("x", 1)}


def test_declared_checks_treat_null_as_specified(spark):
    schema = "a int, b int, kind string"
    df = spark.createDataFrame([(1, 5, "x"), (7, 5, "x"), (None, 5, "x"), (5, None, "y"), (None, 1, "it's")], schema)
    contract = SourceContract(
        "t",
        (
            ColumnSpec(
                "a", "integer", True,
                checks=(
                    ColumnCheck("min_value", value=5),
                    ColumnCheck("max_column_value", column="b"),
                    ColumnCheck("max_column_value", column="absent"),
                    ColumnCheck("required_when", column="kind", equals="it's"),
                    ColumnCheck("required_when", column="kind", equals="y"),
                    ColumnCheck("unheard_of"),
                ),
            ),
            ColumnSpec("b", "integer", True, checks=(ColumnCheck("min_value", value=5, inclusive=False),)),
            ColumnSpec("kind", "text", True),
        ),
    )
    found = quality.shared_aggregate_findings(df, contract)
    assert one(found, "issue_a_below_min_value").evidence["affected_rows"] == "3"  # 1 and two nulls
    assert one(found, "issue_b_below_min_value").evidence["affected_rows"] == "5"  # 5 is not > 5
    assert one(found, "issue_a_greater_than_b").evidence["affected_rows"] == "1"
    when = one(found, "issue_a_missing_when_kind_it's")
    assert when.evidence["affected_rows"] == "1" and when.evidence["condition_value"] == "it's"
    assert "issue_a_missing_when_kind_y" not in ids(found)


def test_all_counts_of_a_table_share_one_scan(tables):
    plan = plan_of(quality.shared_aggregate_findings(tables["stripe_invoices"], INV))
    assert plan.count("Scan") + plan.count("LocalTableScan") <= 2 and plan.count("Exchange") <= 1


def test_report_counts_and_top(tables):
    found = quality.combined_findings(tables, fixed.CONTRACTS)
    assert "stripe_invoices__issue_discount_amount_null_rate" in ids(found)
    sections = {r.severity: r.finding_count for r in quality.report(found).collect()}
    assert sections == {"must_answer": 2, "info": 6}
    totals = {(r.severity, r.type): r.finding_count for r in quality.counts(found).collect()}
    assert totals[(None, None)] == 8 and totals[("must_answer", None)] == 2 and totals[(None, "uniqueness")] == 5
    top = quality.top_findings(found, 3).collect()
    assert [r.priority for r in top] == [0, 0, 4]
    assert set(top[0].evidence) == {"null_count", "null_rate"}


def test_profiles(tables):
    counts = {r.source: r.row_count for r in profile.row_counts(tables).collect()}
    assert counts["stripe_payments"] == len(PAYMENTS)
    rates = {r.column: (r.null_count, r.null_rate) for r in profile.null_rates(tables["stripe_invoices"], "x").collect()}
    assert rates["discount_amount"] == (2, 0.2857) and rates["invoice_id"] == (0, 0.0)
    months = as_set(profile.month_ranges(tables, fixed.CONTRACTS), "column", "first_month", "last_month", "months")
    assert months == {("invoice_month", "2025-01", "2025-02", 2), ("payment_month", "2025-01", "2025-03", 3)}
    values = as_set(profile.distinct_values(tables["dim_customers"], fixed.DIM_CUSTOMERS), "value", "row_count")
    assert values == {("enterprise", 2), ("mid_market", 1), ("startup", 1), ("self_serve", 1)}
    approx = as_set(profile.approx_distinct(tables["dim_plans"], "p"), "column", "approx_distinct")
    assert approx == {("plan_id", 4), ("plan_name", 4)}
    assert profile.column_differences(tables["dim_plans"], fixed.DIM_PLANS).count() == 0


def test_profile_state_reads_new_files_only(spark, tmp_path, monkeypatch):
    rng, source, state, read = random.Random(7), f"{tmp_path}/in", f"{tmp_path}/state", []
    plain = profile_state.profiled
    monkeypatch.setattr(profile_state, "profiled", lambda df: read.append(len(df.inputFiles())) or plain(df))
    rows = [(i, rng.gauss(0, 1), None if i % 4 == 0 else f"name{rng.randrange(3000)}", i % 7 == 0) for i in range(20_000)]
    schema = "id long, x double, name string, flag boolean"
    for part in range(4):
        df = spark.createDataFrame(rows[part * 5000 : (part + 1) * 5000], schema)
        df.coalesce(1).write.mode("append").parquet(source)
        assert len(profile_state.update(spark, source, state)) == 1
    assert read == [1] * 4 and profile_state.update(spark, source, state) == []
    found = {r.column: r for r in profile_state.merged(spark, source, state, (0.25, 0.5)).collect()}
    names = {r[2] for r in rows} - {None}
    assert (found["name"].row_count, found["name"].null_count, found["name"].files) == (20_000, 5000, 4)
    assert (found["name"].low, found["name"].high) == (min(names), max(names)) and found["name"].quantiles is None
    assert (found["id"].low_number, found["id"].high_number, found["flag"].distinct_estimate) == (0.0, 19_999.0, 2)
    assert abs(found["id"].distinct_estimate - 20_000) < 1200 and abs(found["name"].distinct_estimate - len(names)) < 180
    values = sorted(r[1] for r in rows)
    for share, value in zip((0.25, 0.5), found["x"].quantiles):
        assert abs(bisect.bisect(values, value) / 20_000 - share) < 0.02
    # A file that changes is read again, and its old figures no longer count.
    path = next(iter(spark.read.parquet(source).inputFiles())).removeprefix("file://")
    pq.write_table(pq.read_table(path).slice(0, 10), path)
    Path(path).parent.joinpath("." + Path(path).name + ".crc").unlink(missing_ok=True)
    assert len(profile_state.update(spark, source, state)) == 1
    assert {r.row_count for r in profile_state.merged(spark, source, state).collect()} == {15_010}
