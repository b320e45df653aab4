"""The graph between models: edges read from model texts, and levels along the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgergrain.functions.closure import closure, longest_ways
from ledgergrain.session import checkpointed

# Calls by which a model text names another model or a source table, with or without braces.
_QUOTED = r"""(?:'[^'"]+'|"[^'"]+")"""
CALL = (
    r"(?i)(?:\{\{\s*)?(?:ref(?<![\w.]ref)\s*\(\s*" + _QUOTED + r"\s*\)"
    r"|source(?<![\w.]source)\s*\(\s*" + _QUOTED + r"\s*,\s*" + _QUOTED + r"\s*\))(?:\s*\}\})?"
)


def lineage(texts: DataFrame, model: str = "model", text: str = "text") -> DataFrame:
    """Unique edges of every model: ``model, kind, parent`` and where each was first seen.

    Calls in braces come before bare ones. A model may come in many text pieces, ordered by an optional
    integer ``part`` column. First-seen order is one number, so the edges combine before the shuffle.
    """
    part = F.col("part").cast("bigint") if "part" in texts.columns else F.lit(0).cast("bigint")
    calls = texts.select(
        F.col(model).alias("model"), part.alias("part"), F.posexplode(F.regexp_extract_all(text, F.lit(CALL), 0))
    )
    # Pieces between quotes: the call's head, a name, and for sources a comma and a second name.
    pieces = calls.selectExpr(
        "model", "part", "pos", "startswith(col, '{{') and endswith(col, '}}') as braced",
        """split(replace(col, '"', "'"), "'") as piece""",
    )
    edges = pieces.selectExpr(
        "model",
        "if(size(piece) > 3, 'source', 'ref') as kind",
        "if(size(piece) > 3, concat_ws('.', trim(piece[1]), trim(piece[3])), trim(piece[1])) as parent",
        "shiftleft(if(braced, 0L, 1L), 62) + shiftleft(part, 31) + pos as _seen",
    )
    low = F.lit((1 << 31) - 1)
    return edges.groupBy("model", "kind", "parent").agg(F.min("_seen").alias("_seen")).select(
        "model", "kind", "parent",
        F.shiftright("_seen", 31).bitwiseAND(low).cast("int").alias("part"),
        F.col("_seen").bitwiseAND(low).cast("int").alias("position"),
        (F.shiftright("_seen", 62) == 0).alias("in_braces"),
    )


class CircularModels(ValueError):
    """The model graph has a cycle."""


def model_levels(edges: DataFrame, models: DataFrame, check_cycles: bool = True) -> DataFrame:
    """Level of every model: 0 without known parents, else 1 + the highest parent level.

    ``models`` has ``model``; ``edges`` has ``model, parent``. A level is the longest way up, found in rounds that double
    the reach: a graph of 2,000 levels takes eleven. Models that nobody reads are set aside first, as long as that
    halves the edges, and take their level from their parents at the end. Edges to unknown parents do not count. Models
    on or behind a cycle raise, or get a null level with ``check_cycles=False``.
    """
    nodes = checkpointed(models.select("model").distinct())
    core, shells = _shelled(edges.select("model", "parent"))
    found = _levels(core, nodes, check_cycles)
    for shell in reversed(shells):
        above = found.select(F.col("model").alias("parent"), "level", "_lost")
        own = shell.join(above, "parent").groupBy("model").agg(
            (F.max("level") + 1).alias("_level"), F.bool_or("_lost").alias("_behind")
        )
        joined = found.join(own, "model", "left")
        # A model of a shell has no level from another round.
        found = checkpointed(
            joined.select(
                "model", F.coalesce("_level", "level").alias("level"), F.coalesce("_behind", "_lost").alias("_lost")
            )
        )
    return found.select("model", F.when(~F.col("_lost"), F.col("level")).cast("int").alias("level"))


def _shelled(edges: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The edges left when those of models that are nobody's parent have gone, and those, by rounds.

    All edges of a model go in one round. The last round is the first that leaves more than half, so all rounds together
    read at most twice the edges.
    """
    shells = []
    while True:
        read = edges.select(F.col("parent").alias("model")).distinct().withColumn("_read", F.lit(True))
        split = checkpointed(edges.join(read, "model", "left"))
        every, inner = split.agg(F.count(F.lit(1)), F.count("_read")).first()
        shells.append(split.where("_read IS NULL").drop("_read"))
        edges = split.where("_read").drop("_read")
        if not inner or inner * 2 > every:
            return edges, shells


def _levels(edges: DataFrame, nodes: DataFrame, check_cycles: bool) -> DataFrame:
    """Every node with its ``level`` along the edges, 0 without any, and ``_lost`` where a cycle leaves none."""
    known = edges.join(nodes.select(F.col("model").alias("parent")), "parent", "left_semi")
    count, lost = nodes.count(), nodes.limit(0)
    levels, rounds = longest_ways(known, "model", "parent", count)
    if rounds is not None:
        if check_cycles:
            raise CircularModels(f"circular model dependency at {rounds.agg(F.min('child')).first()[0]}")
        short = closure(known, "model", "parent", longest=False).pairs
        looped = short.where("child = ancestor").select(F.col("child").alias("model")).distinct()
        behind = short.join(looped.withColumnRenamed("model", "ancestor"), "ancestor", "left_semi")
        lost = checkpointed(behind.select(F.col("child").alias("model")).distinct())
        levels, _ = longest_ways(known.join(lost, "model", "left_anti"), "model", "parent", count)
    levels = levels.withColumnRenamed("child", "model")
    found = nodes.join(levels, "model", "left").join(lost.withColumn("_lost", F.lit(True)), "model", "left")
    return found.select("model", F.coalesce("level", F.lit(0)).alias("level"), F.col("_lost").isNotNull().alias("_lost"))


def model_tier(model: str = "model"):
    """0 staging, 1 intermediate, 2 mart, 3 other; models of a level run in tier and name order."""
    c = F.col(model)
    return (
        F.when(c.startswith("stg_"), 0).when(c.startswith("int_"), 1).when(c.startswith("mart_"), 2).otherwise(3)
    )
