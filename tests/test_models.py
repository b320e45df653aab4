from __future__ import annotations

import json
import random
from dataclasses import replace
from pathlib import Path

import pytest
from conftest import INVOICES, PAYMENTS, as_set, cash, make, plan_of

from ledgergrain import fixed_values as fixed
from ledgergrain.functions import closure as closing
from ledgergrain.operators import datatests as dt
from ledgergrain.operators.metrics import MetricRequest, run
from ledgergrain.plans import build, lineage, rebuild, sql_models, staged
from ledgergrain.plans import models as m
from ledgergrain.sources import contracts, drift, sinks
from ledgergrain.sources import tables as named
from ledgergrain.specs import ColumnSpec, DataTest, SourceContract


def test_monthly_marts(tables):
    for product, expected in (
        ("billed_revenue", [("2025-01", 970.0), ("2025-02", 1610.0)]),
        ("collected_revenue", [("2025-01", 810.0), ("2025-02", 1240.0), ("2025-03", 210.0)]),
    ):
        name = fixed.MONTHLY_MARTS[product].name
        mart = build.compose(tables, build.product_models(product))[name]
        assert [tuple(r) for r in mart.collect()] == expected


def test_coalesce_is_a_choice(spark):
    t = make(spark, stripe_invoices=[("i1", "s1", "2025-01", *cash(5, None))])["stripe_invoices"]
    spec = replace(fixed.MONTHLY_MARTS["billed_revenue"], value_column="discount_amount", output_metric="d")
    assert m.monthly_metric(t, spec).first().d == 0.0
    assert m.monthly_metric(t, replace(spec, coalesce_value=False)).first().d is None


def test_projection_checks_the_contract(tables):
    with pytest.raises(ValueError, match="not in the contract"):
        m.project(tables["stripe_invoices"], ("invoice_id", "secret"), fixed.STRIPE_INVOICES)


def test_clean_trims_deduplicates_and_drops_violations(spark):
    rows = [
        (" i1 ", "s1", "2025-01-31", *cash(5, None)), ("i1", "s1", "2025-01", *cash(4, 0)),
        ("i1", "s1", "2025-01", *cash(4, 0)), (None, "s1", "2025-01", *cash(4, 0)), ("i2", None, "2025-01", *cash(4, 0)),
    ]
    t = make(spark, stripe_invoices=rows, dim_customers=[("a", "A", "bad"), ("b", "B", " startup ")])
    cleaned = m.clean(t["stripe_invoices"], fixed.STRIPE_INVOICES)
    assert [(r.invoice_id, r.invoice_month, float(r.invoice_amount)) for r in cleaned.collect()] == [("i1", "2025-01", 4)]
    assert "WindowGroupLimit" in plan_of(cleaned)
    assert as_set(m.clean(t["dim_customers"], fixed.DIM_CUSTOMERS)) == {("b", "B", "startup")}


REVENUE = {
    ("2025-01", "enterprise"): (700.0, 0.0, 0.0, 700.0),
    ("2025-01", "mid_market"): (210.0, 10.0, 20.0, 180.0),
    ("2025-01", "startup"): (30.0, 0.0, 30.0, 0.0),
    ("2025-01", "self_serve"): (30.0, 0.0, 0.0, 30.0),
    ("2025-02", "enterprise"): (1400.0, 70.0, 0.0, 1330.0),
    ("2025-02", "mid_market"): (210.0, 5.0, 0.0, 205.0),
}


def test_revenue_mart_and_variants(tables):
    def mart(variant):
        models = build.compose(tables, build.product_models("subscription_revenue_360", variant))
        return models["mart_subscription__revenue_360_monthly"]

    both = mart("gross_and_net")
    assert {(r[0], r[1]): tuple(r)[2:] for r in both.collect()} == REVENUE
    assert both.columns == ["invoice_month", "customer_segment", "gross_mrr", "discount_amount", "refund_amount",
                            "net_mrr"]
    assert "gross_mrr" not in mart("net_only").columns and "net_mrr" not in mart("gross_only").columns


def test_mrr_counts_once_per_invoiced_month(spark):
    rows = [*INVOICES, ("i8", "s1", "2025-01", *cash(1, 2))]
    t = make(spark, stripe_invoices=rows)
    a = m.mrr_adjustments(t["stripe_invoices"], t["stripe_payments"])
    mart = m.revenue_360(a, t["fact_subscriptions"], t["dim_customers"])
    row = mart.where("invoice_month = '2025-01' and customer_segment = 'enterprise'").first()
    assert (row.gross_mrr, row.discount_amount) == (700.0, 2.0)


def test_other_marts(tables):
    i, p = tables["stripe_invoices"], tables["stripe_payments"]
    s, c = tables["fact_subscriptions"], tables["dim_customers"]
    reconciled = {r.invoice_id: r.reconciliation_difference for r in m.invoice_reconciliation(i, p).collect()}
    assert reconciled == {"i1": 0, "i2": 0, "i3": 0, "i4": 30.0, "i5": -10.0, "i6": 300.0, "i7": 0}
    gap = {r.invoice_month: r.collection_gap for r in m.collection_gap(i, p).collect()}
    assert gap == {"2025-01": 30.0, "2025-02": 290.0}
    health = {(r[0], r[1]): r.outstanding_amount for r in m.collection_health(i, p, s, c).collect()}
    assert health[("2025-02", "enterprise")] == 290.0
    monthly = {(r[0], r[1]): r.invoice_count for r in m.monthly_reconciliation(i, p, s, c).collect()}
    assert monthly[("2025-01", "mid_market")] == 1 and monthly[("2025-02", "enterprise")] == 2
    assert as_set(m.monthly_mrr(s)) >= {("k2", "team", 300.0), ("k1", "corp", 700.0)}


def test_build_writes_marts_only_and_reports(spark, tables, tmp_path):
    specs = build.product_models("subscription_collection_health")
    status = build.build_all(spark, tables, specs, str(tmp_path), partition_by={specs[-1].name: ["invoice_month"]})
    rows = status.orderBy("position").collect()
    assert [r.status for r in rows] == ["composed"] * 4 + ["completed"] * 2
    assert [r.row_count for r in rows[-2:]] == [6, 6]
    assert (tmp_path / specs[-1].name / "invoice_month=2025-01").is_dir()


def test_build_stops_at_the_first_failure(spark, tables, tmp_path):
    specs = build.product_models("stripe_billing_reconciliation")
    broken = dict(tables, stripe_payments=tables["stripe_payments"].drop("refund_amount"))
    rows = build.build_all(spark, broken, specs, str(tmp_path), every_layer=True).orderBy("position").collect()
    assert [r.status for r in rows] == ["completed", "failed", "skipped", "skipped"]
    assert rows[0].row_count == 7 and "refund_amount" in rows[1].error


def test_run_order_and_cycles():
    a = build.ModelSpec("mart_a", ("int_b",), None)
    b = build.ModelSpec("int_b", ("stg_c", "outside"), None)
    c, d = build.ModelSpec("stg_c", (), None), build.ModelSpec("stg_a", (), None)
    assert [s.name for s in build.run_order([a, b, c, d])] == ["stg_a", "stg_c", "int_b", "mart_a"]
    with pytest.raises(lineage.CircularModels):
        build.run_order([a, build.ModelSpec("int_b", ("mart_a",), None)])


def test_every_product_composes(tables):
    for product in (*fixed.DATA_PRODUCTS, *fixed.MONTHLY_MARTS, *fixed.CONTRACTS):
        if product == "stripe_invoices":
            continue
        frames = build.compose(tables, build.product_models(product))
        assert all(f.columns for f in frames.values())


def test_levels_and_cycle(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("d", "gone"), ("d", "c")], "model string, parent string")
    models = spark.createDataFrame([(x,) for x in "abcde"], "model string")
    assert as_set(lineage.model_levels(edges, models)) == {("a", 0), ("b", 1), ("c", 2), ("d", 3), ("e", 0)}
    loop = edges.union(spark.createDataFrame([("b", "c")], "model string, parent string"))
    with pytest.raises(lineage.CircularModels):
        lineage.model_levels(loop, models)
    stuck = lineage.model_levels(loop, models, check_cycles=False)
    assert as_set(stuck) == {("a", 0), ("e", 0), ("b", None), ("c", None), ("d", None)}


def test_levels_of_a_deep_chain_and_of_diamonds(spark, monkeypatch):
    """Rounds follow the digits of the depth, not the depth."""
    rounds = []
    plain = closing.checkpointed
    monkeypatch.setattr(closing, "checkpointed", lambda df: rounds.append(1) or plain(df))
    chain = spark.range(1, 2000).selectExpr("concat('m', id) as model", "concat('m', id - 1) as parent")
    models = spark.range(2000).selectExpr("concat('m', id) as model")
    levels = lineage.model_levels(chain, models)
    assert levels.where("model != concat('m', level)").count() == 0 and levels.count() == 2000
    assert len(rounds) == 23  # the edges, then levels and ways of eleven rounds
    edges = [(f"{i}{side}", f"{i - 1}{other}") for i in range(1, 40) for side in "ab" for other in "ab"]
    edges += [(f"{i}a", "0b") for i in range(1, 40)]
    nodes = spark.createDataFrame([(f"{i}{s}",) for i in range(40) for s in "ab"], "model string")
    levels = lineage.model_levels(spark.createDataFrame(edges, "model string, parent string"), nodes)
    assert all(r.level == int(r.model[:-1]) for r in levels.collect())


def test_closure_with_cycles_has_shortest_ways(spark):
    rng, edges = random.Random(3), set()
    for g in (1, None):
        edges |= {(g, rng.randrange(30), rng.randrange(30)) for _ in range(45)}
    df = spark.createDataFrame([*edges, (1, None, 2)], "g int, c int, p int")
    found = closing.closure(df, "c", "p", ["g"], longest=False)
    want = set()
    for g in (1, None):
        for start in range(30):
            seen, now, step = {}, {start}, 0
            while now:
                step += 1
                now = {p for gg, c, p in edges if gg == g and c in now} - set(seen)
                seen |= dict.fromkeys(now, step)
            want |= {(g, start, end, n) for end, n in seen.items()}
    assert as_set(found.pairs, "g", "child", "ancestor", "distance") == want and found.cyclic


def test_rebuild(spark, tables, tmp_path):
    texts = {
        "stg_a": "select plan_id, plan_name from {{ source('s', 'dim_plans') }}",
        "stg_b": "select subscription_id, plan_id from {{ source('s', 'fact_subscriptions') }}",
        "mart_c": "select a.plan_id, count(b.plan_id) n from {{ ref('stg_a') }} a left join {{ ref('stg_b') }} b "
                  "on a.plan_id = b.plan_id group by a.plan_id",
        "mart_d": "select count(*) n from {{ ref('stg_b') }}",
    }

    def build_now(**changed):
        rows = spark.createDataFrame(list({**texts, **changed.pop("texts", {})}.items()), "model string, text string")
        status = rebuild.rebuild(spark, {**tables, **changed}, sql_models.specs(rows), f"{tmp_path}/built")
        return {r.model: (r.status, r.reason) for r in status.collect()}

    kept = ("kept", "unchanged")
    assert set(build_now().values()) == {("built", "new")}
    assert set(build_now().values()) == {kept}
    assert build_now(texts={"stg_a": texts["stg_a"] + " where plan_id <> 'gold'"}) == {
        "stg_a": ("built", "definition changed"), "stg_b": kept, "mart_c": ("built", "changed: stg_a"), "mart_d": kept}
    assert rebuild.current(spark, f"{tmp_path}/built", "mart_c").count() == 3
    broken = {"stg_b": "select nothing_here from {{ source('s', 'fact_subscriptions') }}"}
    assert build_now(texts=broken) == {
        "stg_a": kept, "stg_b": ("failed", "definition changed"),
        "mart_c": ("skipped", "failed input: stg_b"), "mart_d": ("skipped", "failed input: stg_b")}
    assert rebuild.current(spark, f"{tmp_path}/built", "mart_c").count() == 3  # the last good one
    refused = {"mart_d": "select java_method('java.lang.System', 'exit', '1') from {{ ref('stg_b') }}"}
    assert build_now(texts=refused)["mart_d"][0] == "failed"
    assert build_now() == dict.fromkeys(texts, kept)  # all of it had been built as it is now
    fewer = tables["fact_subscriptions"].where("plan_id = 'base'")
    assert build_now(fact_subscriptions=fewer) == {
        "stg_a": kept, "stg_b": ("built", "changed: fact_subscriptions"),
        "mart_c": ("built", "changed: stg_b"), "mart_d": ("built", "changed: stg_b")}
    one = spark.createDataFrame([("x", 1)], "a string, b int")
    two = spark.createDataFrame([("y", 1), ("x", 1)], "a string, b int")
    assert rebuild.source_fingerprint(one) != rebuild.source_fingerprint(two)
    assert rebuild.source_fingerprint(two) == rebuild.source_fingerprint(two.repartition(3))
    two.write.parquet(f"{tmp_path}/t")
    first = rebuild.source_fingerprint(spark.read.parquet(f"{tmp_path}/t"))
    assert first == rebuild.source_fingerprint(spark.read.parquet(f"{tmp_path}/t"))
    assert first != rebuild.source_fingerprint(spark.read.parquet(f"{tmp_path}/t").where("b > 0"))
    one.write.mode("append").parquet(f"{tmp_path}/t")
    assert first != rebuild.source_fingerprint(spark.read.parquet(f"{tmp_path}/t"))


def test_models_that_nobody_reads_never_meet_themselves(spark, monkeypatch):
    """Wide rounds of leaves are set aside, so the doubling gets the inner edges; levels equal a plain recursion."""
    rng = random.Random(5)
    edges = [(f"mart{i}", f"int{rng.randrange(40)}") for i in range(400)] + [(f"mart{i}", "gone") for i in range(9)]
    edges += [(f"int{i}", f"int{rng.randrange(i)}") for i in range(1, 40)] + [("int3", "mart_read"), ("mart_read", "x")]
    names = {n for e in edges for n in e} - {"gone"}
    nodes = spark.createDataFrame([(n,) for n in names], "model string")
    seen = []
    monkeypatch.setattr(lineage, "longest_ways", lambda e, *rest: seen.append(e.count()) or closing.longest_ways(e, *rest))

    def expected(name):
        return max((1 + expected(p) for m, p in edges if m == name and p in names), default=0)

    got = as_set(lineage.model_levels(spark.createDataFrame(edges, "model string, parent string"), nodes))
    assert got == {(n, expected(n)) for n in names} and max(seen) < 50
    loop = spark.createDataFrame([*edges, ("int0", "int39"), ("int39", "int0")], "model string, parent string")
    stuck = dict(as_set(lineage.model_levels(loop, nodes, check_cycles=False)))
    assert stuck["int0"] is None and stuck["x"] == 0 and stuck["mart_read"] == 1
    assert all(stuck[m] is None for m, p in edges if p.startswith("int"))


def test_cleaning_computes_each_column_once_and_keeps_the_first_valid_row(spark):
    rows = [
        ("p1", "i1", None, 1.0, 0.0), ("p1", "i2", "2025-02-03", 2.0, 0.0), ("p1", "i3", "2025-01", 3.0, 0.0),
        ("p2", "i1", None, 1.0, 0.0), (None, "i1", "2025-01", 1.0, 0.0), (" p3 ", "i4", "2025-01", 4.0, 1.0),
    ]
    names = "payment_id", "invoice_id", "payment_month", "successful_amount", "refund_amount"
    given = spark.createDataFrame(rows, "a string, b string, c string, d double, e double")
    df = given.selectExpr(
        "a as payment_id", "b as invoice_id", "c as payment_month", "cast(d as decimal(12,2)) as successful_amount",
        "cast(e as decimal(13,2)) as refund_amount",
    )
    cleaned = m.clean(df, fixed.STRIPE_PAYMENTS)
    plan = plan_of(cleaned)
    assert plan.count("as decimal(12,2))") == plan.count("as decimal(13,2))") == 1
    assert as_set(cleaned, *names[:4]) == {("p1", "i2", "2025-02", *cash("2.00")), ("p3", "i4", "2025-01", *cash("4.00"))}
    first, *columns = fixed.STRIPE_PAYMENTS.columns
    loose = replace(fixed.STRIPE_PAYMENTS, columns=(first, replace(columns[0], nullable=True), *columns[1:]))
    assert as_set(m.clean(df, loose)) == as_set(cleaned)


def test_staged_once_and_joined_without_a_shuffle_of_keys(spark, tables, tmp_path):
    """Marts of stored staging equal those of live staging; invoices and paid sums meet in their buckets."""
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/in/{name}")

    def sources():
        return {n: spark.read.parquet(f"{tmp_path}/in/{n}") for n in tables}

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for product in ("subscription_revenue_360", "stripe_billing_reconciliation", "subscription_collection_health"):
            live = build.compose(sources(), build.product_models(product))
            once = staged.product(spark, sources(), product, f"{tmp_path}/staged")
            for mart in (s for s in live if s.startswith(("mart_", "collection_"))):
                assert as_set(once[mart]) == as_set(live[mart])
                plan = plan_of(once[mart])
                assert "hashpartitioning(invoice_id" not in plan and "SortMergeJoin" in plan
                assert "hashpartitioning(invoice_id" in plan_of(live[mart])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

    def names():
        return {t.name for t in spark.catalog.listTables() if t.name.startswith("stg_") or t.name.startswith("int_")}

    before = names()
    staged.product(spark, sources(), "subscription_revenue_360", f"{tmp_path}/staged")
    assert names() == before
    tables["stripe_payments"].limit(1).write.mode("append").parquet(f"{tmp_path}/in/stripe_payments")
    staged.product(spark, sources(), "subscription_revenue_360", f"{tmp_path}/staged")
    assert len(names() - before) == 2  # payments and their sums
    for name in names():
        spark.sql(f"DROP TABLE {name}")


def test_buckets_are_stored_denser_and_split_tables_are_not(spark, tables, tmp_path):
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/in/{name}")
    given = {n: spark.read.parquet(f"{tmp_path}/in/{n}") for n in tables}
    frames = staged.stage(spark, given, {build.INVOICES, build.PAYMENTS, staged.PAID}, f"{tmp_path}/staged")
    dense = {name: all(".zstd." in f for f in df.inputFiles()) for name, df in frames.items()}
    assert dense == {build.INVOICES: True, build.PAYMENTS: False, staged.PAID: True}
    for table in spark.catalog.listTables():
        if table.name.startswith(("stg_", "int_")):
            spark.sql(f"DROP TABLE {table.name}")


def test_products_built_together_clean_each_source_once(spark, tables, tmp_path, monkeypatch):
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/in/{name}")
    given = {n: spark.read.parquet(f"{tmp_path}/in/{n}") for n in tables}
    cleaned, plain = [], m.clean
    monkeypatch.setattr(m, "clean", lambda df, contract: cleaned.append(contract.name) or plain(df, contract))
    for product in ("subscription_revenue_360", "stripe_billing_reconciliation", "subscription_collection_health"):
        specs = staged.specs_of(spark, given, product, f"{tmp_path}/staged")
        status = build.build_all(spark, given, specs, f"{tmp_path}/{product}")
        count = len(cleaned)
        live = build.compose(tables, build.product_models(product))
        del cleaned[count:]
        assert as_set(status, "model", "status") == {
            (s.name, "composed" if any(s.name in o.parents for o in specs) else "completed") for s in specs
        }
        for mart in (r.model for r in status.where("status = 'completed'").collect()):
            assert as_set(spark.read.parquet(f"{tmp_path}/{product}/{mart}")) == as_set(live[mart])
    assert sorted(cleaned) == sorted(build.STAGING.values())
    broken = {**given, "stripe_payments": given["stripe_payments"].drop("refund_amount")}
    specs = staged.specs_of(spark, broken, "stripe_billing_reconciliation", f"{tmp_path}/staged")
    failed = build.build_all(spark, broken, specs, f"{tmp_path}/broken").where("status = 'failed'").first()
    assert failed.model == "stg_stripe__payments" and "refund_amount" in failed.error
    for table in spark.catalog.listTables():
        if table.name.startswith(("stg_", "int_")):
            spark.sql(f"DROP TABLE {table.name}")


def test_lineage_reads_calls_once_in_order(spark):
    text = (
        "select * from bare ref('z') join {{ ref( 'a' ) }} join {{REF(\"b\")}} join {{ ref('a') }} "
        "join {{ source('s', 't ') }} where xref('no') or my.ref('no') or source(\"u\",'v')"
    )
    rows = lineage.lineage(spark.createDataFrame([("m", text), ("n", "select 1")], "model string, text string"))
    refs = rows.where("kind = 'ref'").orderBy((~rows.in_braces), "position").collect()
    assert [r.parent for r in refs] == ["a", "b", "z"]
    assert as_set(rows.where("kind = 'source'"), "parent", "in_braces") == {("s.t", True), ("u.v", False)}


def test_data_tests_can_fail(spark, tables):
    t = dict(tables)
    t["stripe_payments"] = make(
        spark, stripe_payments=[*PAYMENTS, ("p1", "gone", "2025-1", *cash(1, 0)), (None, None, None, *cash(1, None))]
    )["stripe_payments"]
    tests = dt.contract_tests("stripe_payments", fixed.STRIPE_PAYMENTS) + dt.relationship_tests(fixed.RELATIONSHIPS[3:])
    tests += dt.contract_tests("dim_customers", fixed.DIM_CUSTOMERS)
    tests.append(DataTest("big", "custom", "stripe_payments",
                          sql="select * from stripe_payments where successful_amount > 705"))
    tests.append(dt.metrics_not_null("stripe_payments", ("successful_amount", "refund_amount")))
    failing = {r.test_name: r.failing_rows for r in dt.summary(t, tests).collect()}
    assert {k: v for k, v in failing.items() if v} == {
        "unique__stripe_payments__payment_id": 1,
        "not_null__stripe_payments__payment_id": 1,
        "not_null__stripe_payments__invoice_id": 1,
        "not_null__stripe_payments__payment_month": 1,
        "not_null__stripe_payments__refund_amount": 1,
        "month_key__stripe_payments__payment_month": 2,
        "relationship__invoices_to_payments_by_invoice_id": 1,
        "not_null__invoices_to_payments_by_invoice_id": 1,
        "big": 1,
        "metrics_not_null__stripe_payments": 1,
    }
    assert failing["accepted_values__dim_customers__customer_segment"] == 0
    assert not dt.passes(t, tests[0]) and dt.passes(tables, tests[0])


def test_sinks_count_while_writing(spark, tables, tmp_path):
    assert sinks.write_table(tables["stripe_invoices"], str(tmp_path / "p")) == 7
    assert spark.read.parquet(str(tmp_path / "p")).count() == 7
    rows = sinks.write_all_csv(spark, {"b": tables["dim_plans"], "a": tables["dim_customers"]}, str(tmp_path / "c"), "r")
    assert [tuple(r) for r in rows.collect()] == [("a", 5), ("b", 4)]
    status = next((tmp_path / "c" / "_status").glob("*.json")).read_text()
    assert json.loads(json.loads(status)["tables"]) == {"a": 5, "b": 4}
    back = spark.read.option("header", True).csv(str(tmp_path / "c" / "b"))
    assert as_set(back) == as_set(tables["dim_plans"])
    listed = sinks.list_marts({"z": tables["dim_plans"], "a": tables["dim_customers"]}).collect()
    assert [(r.table_name, r.row_count) for r in listed] == [("a", 5), ("z", 4)]


def test_named_tables(spark, tables):
    named.register({"small_plans": tables["dim_plans"]})
    assert named.table_exists(spark, "small_plans") and not named.table_exists(spark, "other_plans")
    assert named.scan_table(spark, "small_plans").count() == 4
    with pytest.raises(ValueError):
        named.scan_table(spark, "x; drop table y")
    assert [named.preview_limit(n) for n in (None, 0, -5, 10, 999)] == [50, 1, 1, 10, 200]
    shown = named.preview(tables["dim_plans"], 2, ["plan_id"])
    assert [r.plan_id for r in shown.rows.collect()] == ["base", "corp"] and shown.total.first()[0] == 4


def test_guarded_sql(spark, tables, tmp_path):
    named.register({"small_plans": tables["dim_plans"], "secret": tables["dim_customers"]})
    ask = lambda sql: named.guarded_sql(spark, sql, tables)
    assert ask("select count(*) n from stripe_invoices i join fact_subscriptions using (subscription_id);").first().n == 7
    cte = "with a as (select * from dim_plans) select plan_id, '{x} secret' t from a order by plan_id -- end"
    assert ask(cte).first().asDict() == {"plan_id": "base", "t": "{x} secret"}
    shadow = "with dim_plans as (select 1 as one) select * from dim_plans"
    assert ask(shadow).columns == ["one"]
    assert ask("select 1 as x").first().x == 1
    tables["dim_plans"].write.parquet(f"{tmp_path}/plans")
    tables["dim_plans"].write.csv(f"{tmp_path}/text")
    refused = [
        "select * from secret", "select * from dim_plans where plan_id in (select customer_id from SECRET)",
        f"select * from parquet.`{tmp_path}/plans`", f"select plan_id from dim_plans union select _c0 from csv.`{tmp_path}/text`",
        "select * from default.dim_plans", "select * from global_temp.small",
    ]
    for sql in refused:
        with pytest.raises(named.NotAllowed):
            ask(sql)
    for sql in ("drop view small_plans", "insert into small_plans select * from dim_plans", "select 1) -- ",
                "select 1; drop view small_plans", "create table t as select 1"):
        with pytest.raises(Exception, match="PARSE|not an allowed"):
            ask(sql)
    with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND"):
        ask("select * from nowhere_at_all")
    hidden = tables["fact_subscriptions"].drop("mrr_amount")
    tables["fact_subscriptions"].write.parquet(f"{tmp_path}/subs")
    stored = spark.read.parquet(f"{tmp_path}/subs")
    narrow = {"subs": stored.drop("mrr_amount"), "dim_plans": tables["dim_plans"]}
    spark.udf.register("abs_of", lambda x: x)
    named.register({"wide_subs": stored})
    exploits = [
        "select java_method('java.lang.System', 'getProperty', 'user.home')", "select reflect('java.lang.System', 'exit', '1')",
        f"select s.plan_id, h.mrr_amount from subs s join parquet.`{tmp_path}/subs` h using (subscription_id)",
        "select mrr_amount from wide_subs", "select * from (with wide_subs as (select 1 a) select a from wide_subs) join wide_subs",
        "select _metadata.file_path from subs", "select abs_of(1)", "select transform(plan_id) using 'cat' from subs",
        "select input_file_name() from subs", "select try_reflect('java.lang.System', 'getenv', 'PATH')",
        "select * from identifier('wide' || '_subs')", "select plan_id from subs where exists (select 1 from wide_subs)",
        "select sum(1) over w from subs window w as (order by java_method('java.lang.System', 'getProperty', 'user.home'))",
        "select (select max(mrr_amount) from wide_subs) m", "select * from subs, lateral (select * from wide_subs) x",
        "show tables", "set x = 1", "describe wide_subs", "explain select 1", "select current_user()", "select uuid()",
        f"select read_files('{tmp_path}')", "select spark_catalog.default.abs_of(1)", "select raise_error('x')",
    ]
    for sql in exploits:
        with pytest.raises(named.NotAllowed):
            named.guarded_sql(spark, sql, narrow)
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN"):
        named.guarded_sql(spark, "select mrr_amount from subs", narrow)
    assert hidden.columns == narrow["subs"].columns
    fine = [
        "with a as (select plan_id, count(*) n from subs group by plan_id having count(*) > 0), b as (select max(n) m from a) "
        "select a.plan_id, rank() over w r from a join b on a.n <= b.m window w as (partition by a.n order by a.plan_id)",
        "select plan_id from dim_plans except select plan_id from subs", "select * from values (1, 'a') t(x, y)",
        "select p.plan_id, x from dim_plans p lateral view explode(split(plan_name, 'a')) as x",
        "select s1.plan_id from subs s1 join subs s2 using (plan_id) where s1.plan_id in (select plan_id from dim_plans) limit 3",
        "select id from range(3)", "select cast(sum(case when plan_id = 'base' then 1 else 0 end) as decimal(18,2)) c from subs",
    ]
    for sql in fine:
        assert named.guarded_sql(spark, sql, narrow).count() > 0
    spark.catalog.dropTempView("wide_subs")
    custom = DataTest("t", "custom", "dim_plans", sql="drop view small_plans")
    with pytest.raises(Exception, match="PARSE|not an allowed"):
        dt.failing_rows(tables, custom)
    assert named.table_exists(spark, "small_plans")
    for name in ("small_plans", "secret"):
        spark.catalog.dropTempView(name)


def test_unique_over_two_columns(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 2), (None, 5), (None, 5)], "a int, b int")
    test = DataTest("u", "unique", "m", ("a", "b"))
    assert as_set(dt.failing_rows({"m": df}, test)) == {("2,2", 2)}
    assert as_set(dt.summary({"m": df}, [test]), "failing_rows") == {(1,)}


def test_orphan_money_stays_under_a_null_segment(spark, tables):
    half = {**tables, "fact_subscriptions": tables["fact_subscriptions"].where("subscription_id in ('s1', 's2')")}
    i, p, s, c = (half[n] for n in ("stripe_invoices", "stripe_payments", "fact_subscriptions", "dim_customers"))
    total = m.collection_gap(i, p).selectExpr("sum(billed_revenue)", "sum(collected_revenue)").first()
    health = m.collection_health(i, p, s, c)
    assert health.selectExpr("sum(billed_amount)", "sum(collected_amount)").first() == total
    assert health.where("customer_segment is null").count() > 0
    revenue = m.revenue_360(m.mrr_adjustments(i, p), s, c)
    assert revenue.agg({"refund_amount": "sum"}).first()[0] == p.agg({"refund_amount": "sum"}).first()[0]
    whole = run(half, MetricRequest("billed_revenue", "aggregate")).first()[0]
    split = run(half, MetricRequest("billed_revenue", "group_by", ("customer_segment",)))
    assert split.agg({"billed_revenue": "sum"}).first()[0] == whole


def test_rows_without_key_are_no_copies(spark):
    contract = SourceContract(
        name="t", grain=("k",), final_mart="x",
        columns=(ColumnSpec("k", "text", nullable=True, primary_key=True), ColumnSpec("v", "integer", nullable=True)),
    )
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("a", 4)], "k string, v int")
    assert sorted(as_set(m.clean(df, contract), "v")) == [(1,), (2,), (3,)]


CONTRACT = {
    "source": {"name": "stripe_payments"},
    "business_context": {"final_mart": "m", "grain": ["payment_id"]},
    "columns": {
        "payment_id": {"type": "text", "primary_key": True, "nullable": False},
        "amount": {
            "type": "real", "nullable": True, "checks": [{"type": "min_value", "value": 0, "inclusive": False}],
            "business_rules": {"require_decision_when_null_rate_ge": 0.5, "decision_reason": "why"},
        },
        "kind": {"type": "text", "nullable": True, "valid_values": ["a", "b"]},
    },
    "business_rules": {"refund_handling": {"required_when_positive_column_present": "amount", "severity": "info"}},
}


def test_contract_files(tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(CONTRACT))
    (tmp_path / "other.json").write_text(json.dumps({"relationships": []}))
    (tmp_path / "notes.txt").write_text("not a contract")
    found = contracts.load_contracts(tmp_path)
    contract = found["stripe_payments"]
    assert list(found) == ["stripe_payments"] and contract.primary_keys == ("payment_id",)
    assert contract.column("amount").checks[0].inclusive is False
    assert contract.column("amount").null_rate_decision == 0.5 and contract.positive_severity == "info"
    assert contracts.struct_type(contract)["amount"].dataType.simpleString() == "decimal(18,2)"
    for drop in ("type", "nullable"):
        bad = json.loads(json.dumps(CONTRACT))
        del bad["columns"]["kind"][drop]
        with pytest.raises(ValueError, match=drop):
            contracts.from_mapping(bad)
    for key in ("source", "columns"):
        with pytest.raises(ValueError):
            contracts.from_mapping({k: v for k, v in CONTRACT.items() if k != key})


def test_yaml_contract(tmp_path):
    yaml = pytest.importorskip("yaml")
    path = Path(tmp_path) / "c.yml"
    path.write_text(yaml.safe_dump(CONTRACT, sort_keys=False))
    assert contracts.load_contract(path) == contracts.from_mapping(CONTRACT)


def test_drift(spark, tables):
    assert not drift.needs_rebuild(tables, fixed.CONTRACTS)
    changed = dict(tables, dim_plans=make(spark, dim_plans=[])["dim_plans"],
                   stripe_invoices=tables["stripe_invoices"].drop("discount_amount"))
    del changed["dim_customers"]
    states = {r.source: r.state for r in drift.schema_drift(changed, fixed.CONTRACTS).collect()}
    assert states == {"dim_customers": "missing_table", "dim_plans": "empty_table", "fact_subscriptions": "ok",
                      "stripe_invoices": "changed_columns", "stripe_payments": "ok"}
    assert drift.needs_rebuild(changed, fixed.CONTRACTS)


def test_contracts_come_back_from_files(spark, tmp_path):
    contracts.write_contracts(spark, fixed.CONTRACTS, str(tmp_path))
    assert contracts.read_contracts(spark, str(tmp_path)) == dict(sorted(fixed.CONTRACTS.items()))


def test_models_from_texts(spark, tables, tmp_path):
    texts = {
        "mart_b": "select a.n + 1 as n from {{ ref('stg_a') }} a",
        "stg_a": "select count(*) as n from {{ source('demo', 'dim_plans') }}",
    }
    rows = spark.createDataFrame(list(texts.items()), "model string, text string")
    status = sql_models.build_texts(spark, rows, tables, str(tmp_path)).orderBy("position").collect()
    assert [(r.model, r.status) for r in status] == [("stg_a", "composed"), ("mart_b", "completed")]
    assert spark.read.parquet(f"{tmp_path}/mart_b").first().n == 5
    bad = spark.createDataFrame([("stg_a", "drop view {{ ref('dim_plans') }}")], "model string, text string")
    assert sql_models.build_texts(spark, bad, tables, str(tmp_path)).first().status == "failed"
    assert sql_models.plain_sql("x.ref('a') preref('b') ref( 'c' )").split() == ["x.ref('a')", "preref('b')", "c"]
