"""All ancestors in a graph, by doubling: as many rounds as the longest path has binary digits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgergrain.session import checkpointed


@dataclass(frozen=True)
class Closure:
    """``pairs``: group, ``child``, ``ancestor``, ``distance``; ``cyclic``: does anything reach itself?"""

    pairs: DataFrame
    cyclic: bool


def closure(edges: DataFrame, child: str, parent: str, group: Sequence[str] = (), longest: bool = True) -> Closure:
    """Every node with every ancestor and the longest (or shortest) distance between them.

    A longest path of k + 1 to 2k steps is one of k steps and a rest of at most k, both longest themselves. So a round
    joins the pairs at distance k to the pairs so far and doubles k. Rows of a round are the new pairs, by way of each
    middle, and the distances merge before the shuffle. Each round is stored. Longest distances end at the first cycle
    (``cyclic``; pairs are unfinished then); shortest ones are complete with cycles as well. Rows with a null end are
    left out; null groups are a group.
    """
    group, best = list(group), F.max if longest else F.min
    keys = [*group, "child", "ancestor"]
    steps = edges.select(*group, F.col(child).alias("child"), F.col(parent).alias("ancestor"))
    steps = steps.where(F.col("child").isNotNull() & F.col("ancestor").isNotNull()).distinct()
    pairs, reach = checkpointed(steps.withColumn("distance", F.lit(1))), 1
    while True:
        far, loops = pairs.agg(F.max("distance"), F.count_if(F.col("child") == F.col("ancestor"))).first()
        if far is None or far < reach or (longest and loops):
            return Closure(pairs, bool(loops))
        first = pairs.where(F.col("distance") == reach).select(
            *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("child").alias("_from"),
            F.col("ancestor").alias("_middle"),
        )
        meets = F.col("_middle") == F.col("child")
        for i, g in enumerate(group):
            meets = meets & F.col(f"_g{i}").eqNullSafe(F.col(g))
        further = first.join(pairs, meets).select(
            *group, F.col("_from").alias("child"), "ancestor", (F.col("distance") + reach).alias("distance")
        )
        pairs = checkpointed(pairs.unionByName(further).groupBy(*keys).agg(best("distance").alias("distance")))
        reach *= 2


def longest_ways(edges: DataFrame, child: str, parent: str, nodes: int) -> tuple[DataFrame, DataFrame | None]:
    """``child`` and ``level``, the most steps that lead up from it, of every node with a parent; and what is left over.

    ``ways`` of a round are the pairs that k steps join. Who has one gets k more than the highest of their other ends
    has within k steps; then the pairs are joined to themselves and k doubles, until none is left. Pairs that are left
    when k reaches the number of nodes go round a cycle; they are returned, else None.
    """
    steps = edges.select(F.col(child).alias("child"), F.col(parent).alias("ancestor")).distinct()
    ways, reach = checkpointed(steps), 1
    levels = ways.select("child").distinct().withColumn("level", F.lit(1))
    while not ways.isEmpty():
        if reach > nodes:
            return levels, ways
        within = levels.select(F.col("child").alias("ancestor"), F.col("level").alias("_rest"))
        higher = ways.join(within, "ancestor", "left").groupBy("child").agg(
            (F.coalesce(F.max("_rest"), F.lit(0)) + reach).alias("_higher")
        )
        levels = levels.join(higher, "child", "left")
        levels = checkpointed(levels.select("child", F.coalesce("_higher", "level").cast("int").alias("level")))
        middle = ways.select(F.col("child").alias("_from"), F.col("ancestor").alias("_middle"))
        on = middle.join(ways, F.col("_middle") == F.col("child"))
        ways = checkpointed(on.select(F.col("_from").alias("child"), "ancestor").distinct())
        reach *= 2
    return levels, None
