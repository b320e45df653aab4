"""Data products: which models they have, and running them in order."""

from __future__ import annotations

import time
from dataclasses import dataclass
from graphlib import CycleError, TopologicalSorter

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from ledgergrain import fixed_values as fixed
from ledgergrain.plans import models as m
from ledgergrain.plans.lineage import CircularModels
from ledgergrain.sources.sinks import write_table
from ledgergrain.sources.tables import NotAllowed


@dataclass(frozen=True)
class ModelSpec:
    """A named model, the models and sources it reads, and the function that builds it from them.

    ``version`` stands for the definition where a model is built again only if that has changed; SQL models have
    their text there.
    """

    name: str
    parents: tuple[str, ...]
    build: object
    version: str = ""


def staging(name: str, source: str) -> ModelSpec:
    return ModelSpec(name, (source,), lambda df: m.clean(df, fixed.CONTRACTS[source]))


STAGING = {
    "stg_demo__customers": "dim_customers",
    "stg_demo__plans": "dim_plans",
    "stg_demo__subscriptions": "fact_subscriptions",
    "stg_stripe__invoices": "stripe_invoices",
    "stg_stripe__payments": "stripe_payments",
}
CUSTOMERS, PLANS, SUBSCRIPTIONS, INVOICES, PAYMENTS = STAGING


def product_models(product: str, variant: str = "gross_and_net") -> list[ModelSpec]:
    """The models of a data product or of a single-source package."""
    if product in fixed.MONTHLY_MARTS:
        spec = fixed.MONTHLY_MARTS[product]
        contract = fixed.CONTRACTS[spec.source]
        return [
            ModelSpec(spec.staging_model, (spec.source,), lambda df: m.project(df, spec.staging_columns, contract)),
            ModelSpec(spec.name, (spec.staging_model,), lambda df: m.monthly_metric(df, spec)),
        ]
    base = {name: staging(name, source) for name, source in STAGING.items()}
    if product == "subscription_revenue_360":
        return [
            *base.values(),
            ModelSpec("int_subscription__mrr_adjustments", (INVOICES, PAYMENTS), m.mrr_adjustments),
            ModelSpec(
                "mart_subscription__revenue_360_monthly",
                ("int_subscription__mrr_adjustments", SUBSCRIPTIONS, CUSTOMERS),
                lambda a, s, c: m.revenue_360(a, s, c, variant),
            ),
        ]
    if product == "stripe_billing_reconciliation":
        return [
            base[INVOICES],
            base[PAYMENTS],
            ModelSpec("mart_billing__invoice_reconciliation", (INVOICES, PAYMENTS), m.invoice_reconciliation),
            ModelSpec("collection_gap_monthly", (INVOICES, PAYMENTS), m.collection_gap),
        ]
    if product == "subscription_collection_health":
        return [
            base[CUSTOMERS], base[SUBSCRIPTIONS], base[INVOICES], base[PAYMENTS],
            ModelSpec(
                "mart_billing__collection_health_monthly",
                (INVOICES, PAYMENTS, SUBSCRIPTIONS, CUSTOMERS),
                m.collection_health,
            ),
            ModelSpec(
                "mart_billing__monthly_reconciliation",
                (INVOICES, PAYMENTS, SUBSCRIPTIONS, CUSTOMERS),
                m.monthly_reconciliation,
            ),
        ]
    if product == "fact_subscriptions":
        return [
            base[SUBSCRIPTIONS],
            ModelSpec("mart_subscription__monthly_mrr", (SUBSCRIPTIONS,), m.monthly_mrr),
        ]
    plain = {"dim_customers": CUSTOMERS, "dim_plans": PLANS, "stripe_payments": PAYMENTS}
    if product in plain:
        stage = plain[product]
        return [base[stage], ModelSpec(fixed.CONTRACTS[product].final_mart, (stage,), lambda df: df)]
    raise ValueError(f"unknown data product: {product}")


def run_order(specs: list[ModelSpec]) -> list[ModelSpec]:
    """Models after their parents; among ready ones staging, intermediate, mart, then by name."""
    by_name = {s.name: s for s in specs}

    def tier(name: str) -> tuple[int, str]:
        prefixes = ("stg_", "int_", "mart_")
        return next((i for i, p in enumerate(prefixes) if name.startswith(p)), len(prefixes)), name

    sorter = TopologicalSorter({s.name: [p for p in s.parents if p in by_name] for s in specs})
    try:
        sorter.prepare()
    except CycleError as error:
        raise CircularModels(f"circular model dependency: {error.args[1]}") from error
    order = []
    while sorter.is_active():
        ready = sorted(sorter.get_ready(), key=tier)
        order += [by_name[n] for n in ready]
        sorter.done(*ready)
    return order


def compose(tables: dict[str, DataFrame], specs: list[ModelSpec]) -> dict[str, DataFrame]:
    """All models as lazy DataFrames; nothing runs."""
    frames = dict(tables)
    for spec in run_order(specs):
        frames[spec.name] = spec.build(*[frames[p] for p in spec.parents])
    return {spec.name: frames[spec.name] for spec in specs}


STATUS_SCHEMA = "position int, model string, status string, row_count long, duration_ms long, error string"


def build_all(
    spark: SparkSession,
    tables: dict[str, DataFrame],
    specs: list[ModelSpec],
    folder: str,
    every_layer: bool = False,
    partition_by: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Write the marts of a product in dependency order and return one status row per model.

    Staging and intermediate models are folded into the marts' plans unless ``every_layer`` is set; their
    status is then ``composed``. After the first failure the rest is ``skipped``. Written models are
    read back by their children, so a lost executor costs at most the model in progress.
    """
    parents = {p for s in specs for p in s.parents}
    frames, status, failed = dict(tables), [], False
    for position, spec in enumerate(run_order(specs)):
        started = time.monotonic()
        if failed:
            status.append((position, spec.name, "skipped", None, None, None))
            continue
        try:
            frames[spec.name] = spec.build(*[frames[p] for p in spec.parents])
            if every_layer or spec.name not in parents:
                path = f"{folder}/{spec.name}"
                rows = write_table(frames[spec.name], path, (partition_by or {}).get(spec.name))
                frames[spec.name] = spark.read.schema(frames[spec.name].schema).parquet(path)
                state = "completed"
            else:
                rows, state = None, "composed"
            status.append((position, spec.name, state, rows, int((time.monotonic() - started) * 1000), None))
        except (PySparkException, NotAllowed) as error:  # what Spark or the guard rejects; the status reports it
            failed = True
            status.append((position, spec.name, "failed", None, None, str(error)))
    return spark.createDataFrame(status, STATUS_SCHEMA)
