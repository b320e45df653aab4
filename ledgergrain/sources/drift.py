"""Schema drift: which sources would need a rebuild, and why. Inputs are never rewritten."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgergrain.operators.profile import union_all
from ledgergrain.specs import SourceContract


def schema_drift(tables: dict[str, DataFrame], contracts: dict[str, SourceContract]) -> DataFrame:
    """One row per required source: missing table, changed columns, no rows, or ``ok``."""
    frames = []
    anchor = next(iter(tables.values()))
    for name, contract in contracts.items():
        if name not in tables:
            frames.append(_row(anchor.agg(F.lit(None).cast("bigint").alias("row_count")), name, F.lit("missing_table")))
            continue
        df = tables[name]
        same = {c.name for c in contract.columns} == set(df.columns)
        counted = df.agg(F.count(F.lit(1)).alias("row_count"))
        state = F.when(F.col("row_count") == 0, "empty_table").otherwise("ok") if same else F.lit("changed_columns")
        frames.append(_row(counted, name, state))
    return union_all(frames)


def _row(counted: DataFrame, name: str, state) -> DataFrame:
    return counted.select(
        F.lit(name).alias("source"), state.alias("state"), (state != "ok").alias("rebuild_needed"), "row_count"
    )


def needs_rebuild(tables: dict[str, DataFrame], contracts: dict[str, SourceContract]) -> bool:
    """Gate form: stops at the first reason, and only looks for one row per table."""
    for name, contract in contracts.items():
        if name not in tables or {c.name for c in contract.columns} != set(tables[name].columns):
            return True
        if tables[name].isEmpty():
            return True
    return False
