"""Merkle manifest of a dataset, its blocks of nodes in van Emde Boas layout.

``build(docs, ..)`` hashes one tree per group (the leaves in their order, sixteen to a node) and one tree over the groups;
``proved(manifest)`` gives each leaf its siblings' digest and the root that a claimed leaf leads to.

A tree is cut into aligned subtrees of ``LEVELS`` levels, blocks of 4,096 leaves. A block is one binary value: its
nodes, split at half height, first the top part, then the bottom parts from left to right, each split again. A node's
address follows from its level and number alone (``address``); only the last part of a level can be partly filled, so no
gaps are stored. Blocks are built over leaves, then over the roots of blocks, until each tree is one block: three rounds
carry 16**9 leaves. The same arithmetic finds the siblings on the way back, from the last blocks to the first, so each
block learns its path once and hands it to the blocks below. Spark groups rows by (tree, block): a group has 4,096
rows at most, whatever share of the rows a tree holds. Each round is written to the shared folder.

Digests are hexadecimal in columns and raw in blocks. H(a, b, ..) is SHA-256 of the inputs one after the other, digests
as lowercase hexadecimal text. A node with one child is hashed too. Null groups are a group, the first one. Nulls in
fields are ``-``; a null order value comes first; equal order values follow the leaf digest, so repeated rows get
neighbouring places and equal leaves. Texts of any length are hashed whole, in the JVM. Columns of the input that the
manifest adds too (``leaf`` and so on) are not carried. An empty table gives an empty manifest, without a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgergrain.functions.sequence import grouped_sequence
from ledgergrain.llm import textops
from ledgergrain.llm.components import stored

FAN = 16
#: Levels of nodes in a block, leaves included.
LEVELS = 4
SPAN = FAN ** (LEVELS - 1)
#: Columns that the manifest adds.
ADDED = ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def encoded(field: Column) -> Column:
    """A field as ``byte count:value``, or ``-`` for null."""
    value = field.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def digest(*parts: Column) -> Column:
    """H of some parts."""
    return F.sha2(F.concat(*parts), 256)


def height(n: int) -> int:
    """Levels of a tree of n leaves, the leaves included."""
    levels = 1
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def address(levels: int, n: int, depth: int, number: np.ndarray) -> np.ndarray:
    """Places of the nodes ``number`` at ``depth`` (0: the root) in a tree of ``levels`` levels over n leaves.

    Half of the levels, rounded down, form the top part; every node below it heads a bottom part.
    """
    number = np.asarray(number, np.int64)
    if levels == 1:
        return np.zeros(len(number), np.int64)
    top = levels // 2
    below = levels - top
    at = [-(-n // FAN ** (levels - 1 - d)) for d in range(levels)]  # nodes by level
    if depth < top:
        return address(top, at[top - 1], depth, number)
    part = number // FAN ** (depth - top)
    within = number - part * FAN ** (depth - top)
    full = FAN ** (below - 1)
    out = sum(at[:top]) + part * ((FAN**below - 1) // (FAN - 1))
    last = part == at[top] - 1
    out[~last] += address(below, full, depth - top, within[~last])
    out[last] += address(below, n - (at[top] - 1) * full, depth - top, within[last])
    return out


def _size(levels: int, n: int) -> int:
    return sum(-(-n // FAN**d) for d in range(levels))


def _hash(digests: Sequence[bytes]) -> bytes:
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def built(leaves: Sequence[bytes], levels: int) -> bytes:
    """The nodes of a block over these leaves, in layout order."""
    n = len(leaves)
    out = np.empty((_size(levels, n), 32), np.uint8)
    row = list(leaves)
    for depth in range(levels - 1, -1, -1):
        if depth < levels - 1:
            row = [_hash(row[i : i + FAN]) for i in range(0, len(row), FAN)]
        out[address(levels, n, depth, np.arange(len(row)))] = np.frombuffer(b"".join(row), np.uint8).reshape(-1, 32)
    return out.tobytes()


Siblings = list[tuple[str, str]]


class Block:
    """A stored block that finds siblings; ``up`` is the path from its root to the root of all."""

    def __init__(self, levels: int, n: int, nodes: bytes, up: bytes):
        held = np.frombuffer(nodes, np.uint8).reshape(-1, 32)
        self.rows = []
        for depth in range(levels - 1, 0, -1):
            place = address(levels, n, depth, np.arange(-(-n // FAN ** (levels - 1 - depth))))
            flat = held[place].tobytes().hex()
            self.rows.append([flat[i : i + 64] for i in range(0, len(flat), 64)])
        self.up = list(_levels_of(up))

    def siblings(self, leaf: int) -> Siblings:
        """Left and right siblings as hexadecimal text, level by level up to the root of all."""
        out = []
        for row in self.rows:
            low = leaf // FAN * FAN
            out.append(("".join(row[low:leaf]), "".join(row[leaf + 1 : low + FAN])))
            leaf //= FAN
        return out + self.up


def packed(path: Siblings) -> bytes:
    """Per level how many stand left and right, then they."""
    return b"".join(bytes([len(a) // 64, len(b) // 64]) + bytes.fromhex(a + b) for a, b in path)


def _levels_of(path: bytes):
    at = 0
    while at < len(path):
        left, both = path[at], path[at] + path[at + 1]
        held = path[at + 2 : at + 2 + 32 * both].hex()
        at += 2 + 32 * both
        yield held[: 64 * left], held[64 * left :]


def proof(path: Siblings) -> str:
    """H of all siblings of a path."""
    return hashlib.sha256("".join(a + b for a, b in path).encode()).hexdigest()


def folded(leaf: str, path: Siblings) -> str:
    """The root that a leaf and its siblings lead to."""
    for left, right in path:
        leaf = hashlib.sha256(f"{left}{leaf}{right}".encode()).hexdigest()
    return leaf


@dataclass(frozen=True)
class Forest:
    """Trees by key: ``rounds`` are the tables of blocks, from leaves upwards; ``roots`` has one row per tree."""

    rounds: list[DataFrame]
    roots: DataFrame


_BLOCK = "tree long, block long, levels int, n int, nodes binary, root binary, done boolean"


def _block(table: pa.Table) -> pa.Table:
    """One group of (tree, block): its rows in order become a block."""
    table = table.sort_by("place")
    digests = table.column("digest").to_pylist()
    tree, block, left = (table.column(c)[0].as_py() for c in ("tree", "block", "leaves"))
    done = left <= SPAN
    levels = height(left) if done else LEVELS
    nodes = built(digests, levels)
    row = [tree, block, levels, len(digests), nodes, nodes[:32], done]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.bool_()]
    names = ["tree", "block", "levels", "n", "nodes", "root", "done"]
    return pa.table([pa.array([v], t) for v, t in zip(row, types)], names=names)


def forest(leaves: DataFrame) -> Forest:
    """Trees over ``tree``, ``place`` (from 0), ``digest`` (binary) and ``leaves`` (how many the tree has)."""
    rounds, rows = [], leaves.select("tree", "place", "digest", "leaves")
    while True:
        rows = rows.withColumn("block", F.floor(F.col("place") / SPAN))
        blocks = stored(rows.groupBy("tree", "block").applyInArrow(textops.giving_back(_block, 1), _BLOCK), "merkle")
        rounds.append(blocks)
        above = blocks.where(~F.col("done"))
        if above.isEmpty():
            break
        counts = above.groupBy("tree").agg(F.count(F.lit(1)).alias("leaves"))
        rows = above.select("tree", F.col("block").alias("place"), F.col("root").alias("digest")).join(counts, "tree")
    roots = rounds[0].where("done").select("tree", "root")
    for blocks in rounds[1:]:
        roots = roots.union(blocks.where("done").select("tree", "root"))
    return Forest(rounds, roots)


def _block_of(table: pa.Table) -> Block:
    return Block(*(table.column(c)[0].as_py() for c in ("levels", "n", "nodes", "up")))


def _paths(own: pa.Table, block: pa.Table) -> pa.Table:
    """``tree`` and ``place`` of a block's rows with their siblings up to the root of all."""
    places = own.column("place").to_pylist() if block.num_rows else []
    held = _block_of(block) if places else None
    paths = [packed(held.siblings(at % SPAN)) for at in places]
    own = own.slice(0, len(places))
    return pa.table({"tree": own.column("tree"), "place": own.column("place"), "path": pa.array(paths, pa.binary())})


_PATH = "tree long, place long, path binary"


def _joined(rows: DataFrame, blocks: DataFrame, function, schema) -> DataFrame:
    """Rows meet the block that they are leaves of; ``blocks`` has ``up``, the block's own path."""
    rows = rows.withColumn("block", F.floor(F.col("place") / SPAN))
    both = rows.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block"))
    return both.applyInArrow(textops.giving_back(function, 2), schema)


def _with_up(trees: Forest, outer: DataFrame | None) -> DataFrame:
    """The blocks over leaves with their paths to the root of all; ``outer`` has the path of each tree's root."""
    up = None
    for blocks in reversed(trees.rounds):
        last = blocks.where("done")
        if outer is None:
            tops = last.withColumn("up", F.lit(b""))
        else:
            tops = last.join(outer.select("tree", F.col("path").alias("up")), "tree")
        if up is not None:
            roots = blocks.where(~F.col("done")).select("tree", F.col("block").alias("place"))
            found = _joined(roots, up, _paths, _PATH)
            paths = found.select("tree", F.col("place").alias("block"), F.col("path").alias("up"))
            tops = tops.unionByName(blocks.where(~F.col("done")).join(paths, ["tree", "block"]))
        up = stored(tops, "merkle-paths")
    return up


@dataclass(frozen=True)
class Manifest:
    """``leaves`` has a row's carried columns (as c0, c1, ..), its tree and place, leaf and claim; ``groups`` subroots."""

    leaves: DataFrame
    groups: DataFrame
    trees: Forest
    top: Forest
    carry: tuple[str, ...]


def build(
    docs: DataFrame,
    fields: Sequence[str],
    group: str,
    order: str,
    carry: Sequence[str] = (),
    claim: Column | None = None,
) -> Manifest:
    """The manifest of a table: leaves are digests of ``fields``, trees are the values of ``group``.

    ``claim`` is the digest that a row is said to have now, for ``proved``; by default its leaf.
    """
    leaf = digest(*[encoded(F.col(f"`{f}`")) for f in fields])
    rows = docs.select(
        F.col(f"`{group}`").alias("g"), F.col(f"`{order}`").alias("o"), leaf.alias("leaf"),
        (leaf if claim is None else claim).alias("claim"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)],
    )
    placed = grouped_sequence(rows, ["g"], [F.col("o").asc_nulls_first(), F.col("leaf")], "place", large=0)
    placed = placed.withColumn("place", F.col("place") - 1).drop("o")
    counts = placed.groupBy(F.col("g").alias("name")).agg(F.count(F.lit(1)).alias("leaves"))
    # Groups are numbered by the bytes of their names: that is how Spark sorts strings.
    counts = grouped_sequence(counts.withColumn("all", F.lit(0)), ["all"], [F.col("name").asc_nulls_first()], "tree", large=0)
    named = stored(counts.select("name", "leaves", (F.col("tree") - 1).alias("tree")), "merkle-groups")
    leaves = placed.join(named, placed["g"].eqNullSafe(named["name"])).drop("g", "name")
    trees = forest(leaves.select("tree", "place", F.unhex("leaf").alias("digest"), "leaves"))
    every = F.lit(named.count()).cast("long").alias("leaves")
    subroots = trees.roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), "root", every)
    top = forest(subroots.withColumnRenamed("root", "digest"))
    groups = trees.roots.select("tree", F.lower(F.hex("root")).alias("subroot"))
    return Manifest(leaves.drop("leaves"), stored(groups, "merkle-subroots"), trees, top, tuple(carry))


def proved(manifest: Manifest) -> DataFrame:
    """The carried columns with ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` and ``verified``.

    ``folded_root`` is folded from the claim with the manifest's siblings; it equals the root only if the claim is the
    leaf's digest.
    """
    subroots = manifest.groups.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"))
    outer = _joined(subroots, _with_up(manifest.top, None), _paths, _PATH)
    blocks = _with_up(manifest.trees, outer.select(F.col("place").alias("tree"), "path"))
    names = [c for c in manifest.leaves.columns if c not in ("place", "claim")]
    shape = T.StructType(
        [*manifest.leaves.select(names).schema.fields]
        + [T.StructField(n, T.StringType()) for n in ("proof_sha256", "folded_root")]
    )

    def fold(own: pa.Table, block: pa.Table) -> pa.Table:
        places = own.column("place").to_pylist() if block.num_rows else []
        held = _block_of(block) if places else None
        own, new = own.slice(0, len(places)), ([], [])
        for at, claim in zip(places, own.column("claim").to_pylist()):
            path = held.siblings(at % SPAN)
            new[0].append(proof(path))
            new[1].append(folded(claim, path))
        columns = {n: own.column(n) for n in names}
        columns |= {n: pa.array(v, pa.string()) for n, v in zip(("proof_sha256", "folded_root"), new)}
        return pa.table(columns)

    out = _joined(manifest.leaves, blocks, fold, shape).join(manifest.groups, "tree")
    out = out.withColumn("root", manifest.top.roots.select(F.lower(F.hex("root"))).scalar())
    kept = [F.col(f"c{i}").alias(c) for i, c in enumerate(manifest.carry) if c not in ADDED]
    return out.select(*kept, *ADDED[:-1], (F.col("folded_root") == F.col("root")).alias("verified"))
