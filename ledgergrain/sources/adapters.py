"""Views that give the five contract tables to a folder of order-entry Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SOURCE_NAMES = ("dim_customers", "dim_plans", "fact_subscriptions", "stripe_invoices", "stripe_payments")


def parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _month(column: str) -> str:
    return f"substring(cast(cast({column} as date) as string), 1, 7)"


def _money(column: str) -> str:
    return f"cast({column} as decimal(18,2))"


#: Segments of the regions; one keeps its own name, which no contract lists, so that value checks find something.
SEGMENTS = {"AFRICA": "enterprise", "AMERICA": "mid_market", "ASIA": "startup", "EUROPE": "self_serve"}


def dim_customers(spark: SparkSession, folder: str) -> DataFrame:
    nation, region = parquet(spark, folder, "nation"), parquet(spark, folder, "region")
    segment = "case r_name " + " ".join(f"when '{r}' then '{x}'" for r, x in SEGMENTS.items()) + " else r_name end"
    return nation.join(region, nation.n_regionkey == region.r_regionkey).selectExpr(
        "n_nationkey as customer_id", "n_name as customer_name", f"{segment} as customer_segment"
    )


def dim_plans(spark: SparkSession, folder: str) -> DataFrame:
    plans = parquet(spark, folder, "customer").selectExpr("c_mktsegment as plan_id").distinct()
    return plans.selectExpr("plan_id", "lower(plan_id) as plan_name")


def fact_subscriptions(spark: SparkSession, folder: str) -> DataFrame:
    return parquet(spark, folder, "customer").selectExpr(
        "c_custkey as subscription_id", "c_nationkey as customer_id", "c_mktsegment as plan_id",
        f"{_money('c_acctbal')} as mrr_amount",
    )


def stripe_invoices(spark: SparkSession, folder: str, with_dates: bool = False) -> DataFrame:
    amount = _money("o_totalprice")
    discount = (
        "case o_orderpriority when '1-URGENT' then null "
        f"when '2-HIGH' then {_money(f'{amount} * 0.05')} else {_money('0')} end"
    )
    return parquet(spark, folder, "orders").selectExpr(
        "o_orderkey as invoice_id", "o_custkey as subscription_id", f"{_month('o_orderdate')} as invoice_month",
        f"{amount} as invoice_amount", f"{discount} as discount_amount",
        *(["o_orderdate as invoice_date"] if with_dates else []),
    )


def stripe_payments(spark: SparkSession, folder: str, with_dates: bool = False) -> DataFrame:
    amount = _money("l_extendedprice")
    return parquet(spark, folder, "lineitem").selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber) as payment_id", "l_orderkey as invoice_id",
        f"{_month('l_shipdate')} as payment_month", f"{amount} as successful_amount",
        f"if(l_returnflag = 'R', {amount}, {_money('0')}) as refund_amount",
        *(["l_shipdate as payment_date"] if with_dates else []),
    )


def source_tables(spark: SparkSession, folder: str, with_dates: bool = False) -> dict[str, DataFrame]:
    """All five contract tables, lazily."""
    return {
        "dim_customers": dim_customers(spark, folder),
        "dim_plans": dim_plans(spark, folder),
        "fact_subscriptions": fact_subscriptions(spark, folder),
        "stripe_invoices": stripe_invoices(spark, folder, with_dates),
        "stripe_payments": stripe_payments(spark, folder, with_dates),
    }


def run_events(spark: SparkSession, folder: str) -> DataFrame:
    """The event table as run events; runs are users, tools are the ``k`` property."""
    return shape_run_events(parquet(spark, folder, "events"))


def shape_run_events(events: DataFrame) -> DataFrame:
    kind = """case event_type
        when 'signup' then 'session_started' when 'view' then 'tool_started' when 'click' then 'tool_completed'
        when 'purchase' then case k % 3 when 0 then 'done' when 1 then 'ask_user' else 'artifact_created' end
        else event_type end"""
    return events.selectExpr("*", "from_json(props, 'k BIGINT').k as k").selectExpr(
        "event_id", "user_id as run_id", "ts", f"{kind} as type", "concat('agent_', k % 4) as agent_id",
        "k as tool_call_id", "value",
    )
