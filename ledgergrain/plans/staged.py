"""Staging models stored once and bucketed by their own key, so that marts join them without a shuffle.

A table's name carries the fingerprint of its definition and of its source's files (as ``rebuild`` has it), so a source
that has changed is staged anew and one that hasn't is read as it is. Buckets are dealt by keys that are unique after
staging (an invoice, a subscription), never by a foreign key, so no bucket is hot; payments, whose invoices may be,
are summed by invoice first, with partial sums before the shuffle, and the sums are bucketed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from ledgergrain import fixed_values as fixed
from ledgergrain.operators.joins import payments_by_invoice
from ledgergrain.plans import build
from ledgergrain.plans import models as m
from ledgergrain.plans.rebuild import definition, fingerprint, source_fingerprint
from ledgergrain.sources.sinks import save_as_table

#: Of bucketed tables, whose tasks are buckets. Others are split by bytes, so denser files would put more rows in a task.
CODEC = "zstd"
#: Payments summed by invoice.
PAID = "int_stripe__paid"
BUCKETED = {build.SUBSCRIPTIONS: "subscription_id", build.INVOICES: "invoice_id", PAID: "invoice_id"}


def stored(
    spark: SparkSession, name: str, own: str, make: Callable[[], DataFrame], folder: str, buckets: int | None = None
) -> DataFrame:
    """The table of this fingerprint below a folder, written now if it isn't there."""
    table = f"{name}__{fingerprint(own, folder)}"
    if not spark.catalog.tableExists(table):
        key = BUCKETED.get(name)
        count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        save_as_table(make(), table, (count, key) if key else None, f"{folder}/{table}", CODEC if key else None)
    return spark.table(table)


def stage(
    spark: SparkSession, tables: dict[str, DataFrame], names: Iterable[str], folder: str, buckets: int | None = None
) -> dict[str, DataFrame]:
    """Stored staging models by name; where ``PAID`` is among the names, payments come summed by invoice."""
    names, frames, prints = set(names), {}, {}
    for name, source in build.STAGING.items():
        if name in names or (name == build.PAYMENTS and PAID in names):
            spec = build.staging(name, source)
            prints[name] = fingerprint(definition(spec), source_fingerprint(tables[source]))
            frames[name] = stored(
                spark, name, prints[name], lambda s=source: m.clean(tables[s], fixed.CONTRACTS[s]), folder, buckets
            )
    if PAID in names:
        own = fingerprint("payments_by_invoice", prints[build.PAYMENTS])
        frames[PAID] = stored(spark, PAID, own, lambda: payments_by_invoice(frames[build.PAYMENTS]), folder, buckets)
    return frames


def specs_of(
    spark: SparkSession, tables: dict[str, DataFrame], name: str, folder: str, variant: str = "gross_and_net"
) -> list[build.ModelSpec]:
    """The models of a product for ``build_all``, with staging that is stored once and read from then on.

    It is stored when its turn comes, so that a source that can't be staged is a failed model.
    """
    specs = build.product_models(name, variant)
    joined = {build.INVOICES, build.PAYMENTS} <= {s.name for s in specs}

    def kept(model: str) -> build.ModelSpec:
        table = PAID if joined and model == build.PAYMENTS else model
        return build.ModelSpec(
            model, (build.STAGING[model],), lambda _: stage(spark, tables, {table}, folder)[table]
        )

    return [kept(s.name) if s.name in build.STAGING else s for s in specs]


def product(
    spark: SparkSession, tables: dict[str, DataFrame], name: str, folder: str, variant: str = "gross_and_net"
) -> dict[str, DataFrame]:
    """The models of a product behind its stored staging; those that join invoices read payments as sums."""
    specs = build.product_models(name, variant)
    needed = {s.name for s in specs if s.name in build.STAGING}
    joined = {build.INVOICES, build.PAYMENTS} <= needed
    frames = stage(spark, tables, needed | ({PAID} if joined else set()), folder)
    given = {**frames, build.PAYMENTS: frames[PAID]} if joined else frames
    return {**frames, **build.compose(given, [s for s in specs if s.name not in build.STAGING])}
