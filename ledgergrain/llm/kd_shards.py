"""Shards of near equal bytes by a k-d tree over document metadata.

``shards`` splits all rows recursively at the weighted median of the widest metadata dimension until every leaf is one
shard of the target bytes. Weights are UTF-8 bytes plus one. Points of the tree are groups of equal texts, so copies
share a shard; a group heavier than ``GRAIN`` of a shard's bytes is dealt by id into points below that weight, as one
group may hold a third of all rows. Dimensions are scaled to 16 bits and widths compared as parts of the whole range.

Medians are found by histograms that Spark sums and narrows: each round keeps one bucket per node, and only that
bucket's figures come to the driver. Cuts fall between points, so shards differ by a few ``GRAIN`` at most, unless rows
alike in id and text weigh more than that.

Texts count by their bytes, whatever their length; they are hashed whole in the JVM and never leave it. Null texts weigh
one byte and count as empty; null dimensions count as the lowest value; null ids are ids like others.
Extra columns are ignored, and only the named result columns return. An empty table gives an empty table. ``slot``
numbers the rows of a shard from 0 without gaps, in the order of a hash of id and text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgergrain.session import run_folder

GRAIN = 0.01
DIM_BITS, TIE_BITS, STEP_BITS = 16, 40, 14


@dataclass
class Node:
    """A part of the tree: how many shards it makes, and its cut once it is known."""

    first: int
    count: int
    dim: int = 0
    cut: int | None = None
    left: Node | None = None
    right: Node | None = None


def _key(dim: int) -> Column:
    """Position along a dimension: its value, then a hash that spreads equal values."""
    return F.shiftleft(F.col(f"d{dim}"), TIE_BITS) + F.col("tie")


def _leaf(node: Node) -> Column:
    """The number of a point's node, as far as the tree is known."""
    if node.left is None or node.right is None:
        return F.lit(node.first)
    return F.when(_key(node.dim) < node.cut, _leaf(node.left)).otherwise(_leaf(node.right))


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = run_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _cut(points: DataFrame, open_nodes: dict[int, Node], where: Column, weights: dict[int, int], slack: float) -> None:
    """Set the weighted median of every open node by narrowing histograms, all nodes in each pass."""
    total_bits = DIM_BITS + TIE_BITS
    low = {n: 0 for n in open_nodes}
    under = {n: 0 for n in open_nodes}
    goal = {n: weights[n] * (x.count // 2) / x.count for n, x in open_nodes.items()}
    wanted = set(open_nodes)
    shift = total_bits
    while wanted:
        width, shift = shift, max(0, shift - STEP_BITS)
        base = F.lit(None).cast("long")
        key = F.lit(None).cast("long")
        aim = F.lit(None).cast("double")
        for n in wanted:
            hit = where == n
            key = F.when(hit, _key(open_nodes[n].dim)).otherwise(key)
            base = F.when(hit, F.lit(low[n])).otherwise(base)
            aim = F.when(F.col("node") == n, F.lit(float(goal[n] - under[n]))).otherwise(aim)
        inside = points.select(where.alias("node"), (key - base).alias("at"), "w").where(
            F.col("at").between(0, (1 << width) - 1)
        )
        sums = inside.groupBy("node", F.shiftright("at", shift).alias("bucket")).agg(F.sum("w").alias("w"))
        run = Window.partitionBy("node").orderBy("bucket")
        found = (
            sums.withColumn("upto", F.sum("w").over(run))
            .where(F.col("upto") >= aim)
            .groupBy("node")
            .agg(F.min_by(F.struct("bucket", "w", "upto"), "bucket").alias("x"))
            .collect()
        )
        for n, x in ((r.node, r.x) for r in found):
            before = under[n] + x.upto - x.w
            start = low[n] + (x.bucket << shift)
            if shift == 0 or x.w <= slack:
                after = before + x.w
                near_start = goal[n] - before < after - goal[n]
                open_nodes[n].cut = start if near_start else start + (1 << shift)
                wanted.discard(n)
            else:
                low[n], under[n] = start, before
        for n in wanted - {r.node for r in found}:
            open_nodes[n].cut = low[n]
            wanted.discard(n)


def tree(points: DataFrame, n_shards: int, dims: int) -> Node:
    """The k-d tree over points with weight ``w``, dimensions ``d0``.. and ``tie``."""
    root = Node(0, n_shards)
    level = {0: root}
    whole: dict[int, int] = {}
    while level := {n: x for n, x in level.items() if x.count > 1}:
        where = _leaf(root)
        figures = [f(f"d{i}").alias(f"{f.__name__}{i}") for i in range(dims) for f in (F.min, F.max)]
        rows = points.groupBy(where.alias("node")).agg(F.sum("w").alias("w"), *figures).collect()
        stats = {r.node: r for r in rows}
        if not whole:
            whole = {i: max(1, stats[0][f"max{i}"] - stats[0][f"min{i}"]) if stats else 1 for i in range(dims)}
        for n, x in level.items():
            if n in stats:
                width = [(stats[n][f"max{i}"] - stats[n][f"min{i}"]) / whole[i] for i in range(dims)]
                x.dim = width.index(max(width))
        slack = (sum(r.w for r in rows) / n_shards) * GRAIN / 4
        held = {n: x for n, x in level.items() if n in stats}
        _cut(points, held, where, {n: r.w for n, r in stats.items()}, slack)
        deeper = {}
        for x in level.values():
            x.cut = x.cut or 0
            half = x.count // 2
            x.left, x.right = Node(x.first, half), Node(x.first + half, x.count - half)
            deeper |= {x.left.first: x.left, x.right.first: x.right}
        level = deeper
    return root


def shards(
    docs: DataFrame,
    n_shards: int = 8,
    doc_id: str = "doc_id",
    text: str = "text",
    dimensions: tuple[str, ...] = ("lang", "source"),
) -> DataFrame:
    """One row per input row: id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``."""
    spark = docs.sparkSession
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    size = F.octet_length(content).cast("long") + 1
    scale = (1 << DIM_BITS) - 1
    log_size = F.least(F.lit(scale), (F.log2(size.cast("double")) * 2048).cast("long"))
    named = [
        F.when(F.col(f"`{d}`").isNull(), 0).otherwise(F.pmod(F.xxhash64(F.col(f"`{d}`")), F.lit(scale)) + 1)
        for d in dimensions
    ]
    dims = [log_size, *named]
    items = _stored(
        docs.select(
            F.col(f"`{doc_id}`").alias("id"),
            size.alias("size"),
            F.crc32(content.cast("binary")).alias("crc"),
            F.xxhash64(content).alias("group"),
            *[x.cast("long").alias(f"d{i}") for i, x in enumerate(dims)],
        ),
        "kd-items",
    )
    total = items.agg(F.sum("size")).first()[0] or 0
    limit = max(1, int(total / n_shards * GRAIN))
    # Groups above the limit: fewer than n_shards / GRAIN, as each weighs more than that part of the whole.
    heavy = (
        items.groupBy("group").agg(F.sum("size").alias("gw")).where(F.col("gw") > limit)
        .select("group", F.ceil(F.col("gw") * 2 / limit).alias("parts"))
    )
    salted = items.join(F.broadcast(heavy), "group", "left").select(
        *items.columns,
        F.coalesce(F.pmod(F.xxhash64("id", F.lit("salt")), F.col("parts")), F.lit(0)).alias("salt"),
    )
    points = _stored(
        salted.groupBy("group", "salt").agg(
            F.sum("size").alias("w"), *[F.min(f"d{i}").alias(f"d{i}") for i in range(len(dims))]
        ).withColumn("tie", F.pmod(F.xxhash64("group", "salt"), F.lit(1 << TIE_BITS))),
        "kd-points",
    )
    leaf = _leaf(tree(points, n_shards, len(dims)))
    placed = salted.join(points.select("group", "salt", leaf.alias("shard")), ["group", "salt"])
    # Slots: number within hash buckets, then add the rows of the shard's earlier buckets.
    buckets = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = F.pmod(F.xxhash64("id", "group"), F.lit(buckets)).alias("bucket")
    placed = _stored(placed.select("id", "size", "crc", "group", "shard", spread), "kd-placed")
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    place = Window.partitionBy("shard", "bucket").orderBy("id", "group", "size")
    numbered = placed.withColumn("place", F.row_number().over(place)).join(starts, ["shard", "bucket"])
    return numbered.select(
        F.col("id").alias(doc_id),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("start") + F.col("place") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
