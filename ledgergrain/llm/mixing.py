"""Mixing sources to target weights by hierarchical budgeting.

A tree of levels (here domain, language, source) holds the tokens of every leaf. ``allotted`` gives the root's budget
to its children by weight; no node gets more than its leaves hold times ``max_epochs``. What a node can't take goes to
its siblings by weight, and only what no sibling can take returns to the parent's siblings. Shares are whole tokens;
remainders go to the largest fractions first, then by name.

A leaf's allotment is whole epochs plus a prefix of one more epoch. An epoch orders the leaf's rows by a hash of seed,
epoch, id and text; the prefix takes rows from the start as long as their tokens fit. The place where a prefix ends is
found from token sums of 4096 hash ranges per leaf and one running sum within the range where it ends, so a leaf that
holds a third of all rows is never in one task. Rows are then chosen by comparing their hash with that place, without
a shuffle.

Texts count by their words, whatever their length; none is cut. Null or missing level values count as "" and null texts hold no tokens: rows without tokens come with every whole
epoch of their leaf and with a prefix by their place in it. Rows alike in id and text have one place: they come in
together or not at all. Columns that clash with the level names are replaced when levels are given as expressions.
An empty table gives an empty table. The table of leaves is metadata and is planned on the driver; more than
``MAX_LEAVES`` leaves are an error.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgergrain.llm.components import stored
from ledgergrain.llm.repeats import fresh

MAX_LEAVES = 1_000_000
RANGE_BITS = 12
WORDS = r"[^\x20\x09-\x0D]+"

Path = tuple[str, ...]


def _shares(amount: int, weights: Mapping[str, float], room: Mapping[str, int]) -> dict[str, int]:
    """Whole shares of ``amount`` by weight, none above its room; what one can't take goes to the others."""
    got = dict.fromkeys(weights, 0)
    open_names = {n for n in weights if weights[n] > 0 and room[n] > 0}
    left = min(amount, sum(room[n] for n in open_names))
    while left > 0:
        total = sum(weights[n] for n in open_names)
        exact = {n: left * weights[n] / total for n in open_names}
        full = [n for n in open_names if got[n] + exact[n] >= room[n]]
        if full:
            for n in full:
                left -= room[n] - got[n]
                got[n] = room[n]
            open_names -= set(full)
            continue
        part = {n: int(exact[n]) for n in open_names}
        rest = left - sum(part.values())
        for n in sorted(open_names, key=lambda n: (part[n] - exact[n], n)):
            more = min(room[n] - got[n], part[n] + (1 if rest > 0 else 0))
            rest -= more - part[n]
            got[n] += more
            left -= more
    return got


def allotted(leaves: Mapping[Path, int], weights: Mapping[Path, float], budget: int, max_epochs: int) -> dict[Path, int]:
    """Tokens for each leaf; ``weights`` holds the weight of a node by its path, 1 where none is given."""
    room: dict[Path, int] = {}
    children: dict[Path, set[str]] = {}
    for path, tokens in leaves.items():
        for depth in range(len(path) + 1):
            room[path[:depth]] = room.get(path[:depth], 0) + tokens * max_epochs
            if depth:
                children.setdefault(path[: depth - 1], set()).add(path[depth - 1])
    given, level = {(): min(budget, room.get((), 0))}, [()]
    while level:
        below = []
        for node in level:
            names = sorted(children.get(node, ()))
            if names:
                paths = {n: (*node, n) for n in names}
                shares = _shares(
                    given[node], {n: weights.get(p, 1.0) for n, p in paths.items()}, {n: room[p] for n, p in paths.items()}
                )
                given |= {paths[n]: s for n, s in shares.items()}
                below += paths.values()
        level = below
    return {path: given.get(path, 0) for path in leaves}


def _place(face: Column, seed: int, epoch: Column) -> Column:
    """Where a row stands in an epoch: a hash below 2**63."""
    return F.shiftrightunsigned(F.xxhash64(face, F.lit(seed), epoch.cast("long")), 1)


def mixed(
    docs: DataFrame,
    levels: Mapping[str, Column],
    weights: Mapping[Path, float],
    budget_share: float,
    max_epochs: int = 3,
    seed: int = 17,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The chosen rows, repeated by epoch, with the level columns, ``epoch`` and ``n_words``.

    The budget is ``budget_share`` of all words.
    """
    spark = docs.sparkSession
    names = list(levels)
    value = {n: F.coalesce(c.cast("string"), F.lit("")) for n, c in levels.items()}
    face = F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))
    words = F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORDS)), F.lit(0)).cast("long")
    items = stored(docs.select(*[value[n].alias(n) for n in names], face.alias("face"), words.alias("n")), "mix-items")

    table = items.groupBy(*names).agg(F.sum("n").alias("n")).limit(MAX_LEAVES + 1).collect()
    if len(table) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves")
    leaves = {tuple(r[n] for n in names): r.n for r in table}
    shares = allotted(leaves, weights, int(budget_share * sum(leaves.values())), max_epochs)
    rows = [(*p, *(divmod(shares[p], leaves[p]) if leaves[p] else (0, 0))) for p in leaves]
    schema = ", ".join(f"`{n}` string" for n in names) + ", full long, goal long"
    plan = spark.createDataFrame(rows, schema)

    placed = items.join(plan, names).withColumn("u", _place(F.col("face"), seed, F.col("full")))
    placed = placed.where("goal > 0").withColumn("range", F.shiftright("u", 63 - RANGE_BITS))
    upto = Window.partitionBy(*names).orderBy("range")
    ends = (
        placed.groupBy(*names, "range").agg(F.sum("n").alias("w"), F.first("goal").alias("goal"))
        .withColumn("upto", F.sum("w").over(upto)).where(F.col("upto") > F.col("goal"))
        .groupBy(*names).agg(F.min_by(F.struct("range", (F.col("upto") - F.col("w")).alias("before")), "range").alias("x"))
        .select(*names, "x.range", "x.before")
    )
    inside = Window.partitionBy(*names, "range").orderBy("u").rangeBetween(Window.unboundedPreceding, 0)
    cuts = (
        placed.join(ends, [*names, "range"])
        .withColumn("run", F.col("before") + F.sum("n").over(inside))
        .groupBy(*names)
        .agg(
            F.max(F.when(F.col("run") <= F.col("goal"), F.col("u"))).alias("u"),
            F.min(F.shiftleft(F.col("range"), 63 - RANGE_BITS) - 1).alias("low"),
        )
    )
    cut = F.coalesce("u", "low").alias("cut")
    plan = stored(plan.join(cuts, names, "left").select(*names, "full", "goal", cut), "mix-plan")

    extra = {n: fresh(docs, f"{n}_of_mix") for n in names}
    helper = {n: fresh(docs, n) for n in ("mix_full", "mix_goal", "mix_cut", "mix_place")}
    plan = plan.select(
        *[F.col(n).alias(extra[n]) for n in names],
        *[F.col(a).alias(helper[f"mix_{a}"]) for a in ("full", "goal", "cut")],
    )
    full, goal, end = (F.col(helper[f"mix_{a}"]) for a in ("full", "goal", "cut"))
    kept = [c for c in docs.columns if c not in {*names, "epoch", "n_words"}]
    return (
        docs.select(*[F.col(f"`{c}`") for c in kept], *[value[n].alias(extra[n]) for n in names], words.alias("n_words"),
                    face.alias(helper["mix_place"]))
        .join(plan, list(extra.values()))
        .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), full)))
        .where((F.col("epoch") < full) | ((goal > 0) & (_place(F.col(helper["mix_place"]), seed, F.col("epoch")) <= end)))
        .select(*[F.col(f"`{c}`") for c in kept], *[F.col(extra[n]).alias(n) for n in names], "epoch", "n_words")
    )
