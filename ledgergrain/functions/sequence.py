"""Positions inside groups, also when one group holds a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgergrain.session import checkpointed


#: A group may be larger than one task should sort if its first column has more rows than this.
LARGE = 1 << 17


def grouped_sequence(
    df: DataFrame, group: Sequence[str], order: Sequence[Column | str], name: str, large: int = LARGE
) -> DataFrame:
    """Add the 1-based position of each row in its group; ``order`` must be unique in a group.

    Groups are dealt whole, in one shuffle. Those whose first column has a value with more than ``large`` rows, found by
    a count of that column alone, are cut into pieces instead; with 0 all are, and nothing is counted.
    """
    if not large:
        return _in_pieces(df, group, order, name)
    value = df.select(F.col(group[0]).alias("_value"))
    hot = checkpointed(value.groupBy("_value").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > large))
    position = F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("bigint").alias(name)
    if hot.isEmpty():
        return df.select("*", position)
    is_hot = F.col(group[0]).eqNullSafe(F.col("_value"))
    cut = _in_pieces(df.join(hot, is_hot, "left_semi"), group, order, name)
    return df.join(hot, is_hot, "left_anti").select("*", position).unionByName(cut)


def _in_pieces(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], name: str) -> DataFrame:
    """Positions also when one group holds a large part of all rows.

    Rows are range-sorted on (group, order), which cuts a large group into partitions of even size. Each piece is
    numbered on its own and shifted by the rows of the group's pieces before it. There is one shift per partition
    and group in it, so the table of shifts has as many rows as groups, plus one per partition.
    """
    placed = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    # Range bounds are sampled, so the placement is stored before it is used twice.
    placed = checkpointed(placed.withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_piece", F.shiftright("_at", 33))
    pieces = placed.groupBy(*group, "_piece").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    shifts = pieces.select(
        *[F.col(g).alias(f"_g_{g}") for g in group],
        F.col("_piece").alias("_p"),
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
    )
    joined = placed.join(shifts, _same(group, "_g_") & (F.col("_piece") == F.col("_p")))
    return joined.select(*df.columns, (F.col("_at") + F.col("_shift")).cast("bigint").alias(name))


def _same(group: Sequence[str], prefix: str) -> Column:
    condition = F.lit(True)
    for g in group:
        condition = condition & F.col(g).eqNullSafe(F.col(f"{prefix}{g}"))
    return condition


def first_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], rows: int = 1) -> DataFrame:
    """The first rows of each group. Spark keeps only that many rows per group before it shuffles."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= rows).drop("_rank")
