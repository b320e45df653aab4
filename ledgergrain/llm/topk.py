"""Exact top-k search by columnar branch and bound.

Vectors become integers ``floor(256 * x)`` and lie in packed blocks, one dimension after the other. A query block
meets every candidate block; inner products are summed some dimensions at a time. After each step a pair goes on only
if its sum so far plus the bound of the rest (the product of the two remaining norms) reaches the query's k-th best
score so far; the survivors are compacted, so later dimensions touch ever fewer pairs. The search is exact.

Candidates are dealt into chunks and queries into groups, both bounded in cells; each pair of a chunk and a group is one
task. So tasks grow with the vectors, a candidate is shuffled once for a million cells of queries and a query once for
four million cells of candidates. A first pass lets each group meet one chunk; the k-th best score found there is the
query's floor in the second pass, which prunes from its first pair on. A ranked window merges k rows per query and
chunk.

Vectors that are null, empty or hold null or non-finite components, and rows without id, take no part. Vectors of
different lengths don't meet. Equal scores rank by smaller id. A row never finds rows of its own id; repeated ids
are candidates of their own for other queries and queries of their own only once. Fewer candidates than k give fewer
rows; an empty table gives none. Other columns are ignored. Sums must fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgergrain.llm import repeats
from ledgergrain.llm.components import stored

#: Cells of a chunk of candidates and of a group of queries.
CHUNK_CELLS, GROUP_CELLS = 1 << 22, 1 << 20
#: A chunk isn't cut below so many rows for the sake of more tasks.
LEAST_ROWS = 2048
STRIP = 1024
DIMS_AT_ONCE = 16


def whole_numbers(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``id``, ``cells`` (integers) and ``dims`` of the rows that take part."""
    x = F.col(f"`{embedding}`")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.col(f"`{vec_id}`").isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.coalesce(finite, F.lit(False))
    cells = F.transform(x, lambda v: F.floor(v.cast("double") * 256))
    return vectors.where(usable).select(F.col(f"`{vec_id}`").cast("long").alias("id"), cells.alias("cells")).withColumn(
        "dims", F.size("cells")
    )


def _packed(ids: np.ndarray, rows: np.ndarray) -> tuple[bytes, bytes]:
    """Ids and the vertical layout of a block."""
    small = rows.size == 0 or np.abs(rows).max() < 1 << 31
    return ids.astype("<i8").tobytes(), np.ascontiguousarray(rows.T).astype("<i4" if small else "<i8").tobytes()


def _unpacked(ids: bytes, cells: bytes, dims: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, "<i8")
    kind = "<i4" if len(cells) == 4 * dims * len(ids) else "<i8"
    return ids, np.frombuffer(cells, kind).reshape(dims, len(ids)).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of like ``dims`` and ``part`` of a batch, packed together."""
    for batch in batches:
        ids, dims, part, floor = (np.asarray(batch.column(c)) for c in ("id", "dims", "part", "floor"))
        values, starts = np.asarray(batch.column("cells").flatten()), np.r_[0, np.cumsum(dims)]
        order = np.lexsort((part, dims))
        heads = np.flatnonzero(np.r_[True, (np.diff(dims[order]) != 0) | (np.diff(part[order]) != 0)][: len(order)])
        for low, high in zip(heads, [*heads[1:], len(order)]):
            rows = order[low:high]
            d = int(dims[rows[0]])
            a, b = _packed(ids[rows], values[starts[rows][:, None] + np.arange(d)])
            columns = [[d], [int(part[rows[0]])], [a], [b], [floor[rows].astype("<f8").tobytes()]]
            kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["dims", "part", "ids", "cells", "floors"]
            )


_BLOCK = "dims int, part long, ids binary, cells binary, floors binary"


def _whole(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, cells by dimension and floors of all blocks of a group."""
    rows = table.select(["dims", "ids", "cells", "floors"]).to_pylist()
    parts = [_unpacked(r["ids"], r["cells"], r["dims"]) for r in rows]
    floors = np.concatenate([np.frombuffer(r["floors"], "<f8") for r in rows])
    return np.concatenate([p[0] for p in parts]), np.hstack([p[1] for p in parts]), floors


def best(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, floor: np.ndarray | None = None):
    """Query numbers, candidate ids and scores of the k best candidates per query; cells by dimension.

    Candidates below a query's ``floor`` may be left out.
    """
    dims = len(q)
    top = max(int(np.abs(q).max(initial=0)), int(np.abs(c).max(initial=0)))
    kind = np.float64 if top * top * dims < 1 << 52 else np.int64
    q, c = q.astype(kind), c.astype(kind)
    cuts = list(range(0, dims, DIMS_AT_ONCE)) + [dims]
    rest = [(np.sqrt((q[a:].astype(float) ** 2).sum(0)), np.sqrt((c[a:].astype(float) ** 2).sum(0))) for a in cuts]
    held_q, held_id, held_s = (np.empty(0, np.int64) for _ in range(3))
    floor = np.full(len(q_ids), -np.inf) if floor is None else floor.copy()
    for at in range(0, len(c_ids), STRIP):
        strip = slice(at, at + STRIP)
        own, ids = c[:, strip], c_ids[strip]
        sums = q[: cuts[1]].T @ own[: cuts[1]]
        alive = sums + rest[1][0][:, None] * rest[1][1][None, strip] * (1 + 1e-9) + 1e-3 >= floor[:, None]
        alive &= q_ids[:, None] != ids[None, :]
        rows, cols = np.nonzero(alive)
        done = sums[rows, cols]
        for i in range(1, len(cuts) - 1):
            part = slice(cuts[i], cuts[i + 1])
            if 4 * len(rows) > sums.size:
                done = done + (q[part].T @ own[part])[rows, cols]
            else:
                done = done + np.einsum("dp,dp->p", q[part][:, rows], own[part][:, cols])
            bound = done + rest[i + 1][0][rows] * rest[i + 1][1][strip][cols] * (1 + 1e-9) + 1e-3
            on = bound >= floor[rows]
            rows, cols, done = rows[on], cols[on], done[on]
        held_q = np.r_[held_q, rows]
        held_id = np.r_[held_id, ids[cols]]
        held_s = np.r_[held_s, done.astype(np.int64)]
        order = np.lexsort((held_id, -held_s, held_q))
        held_q, held_id, held_s = held_q[order], held_id[order], held_s[order]
        first = np.searchsorted(held_q, held_q)
        keep = np.arange(len(held_q)) - first < k
        held_q, held_id, held_s = held_q[keep], held_id[keep], held_s[keep]
        last = np.arange(len(held_q)) - np.searchsorted(held_q, held_q) == k - 1
        floor[held_q[last]] = np.maximum(floor[held_q[last]], held_s[last])
    return held_q, held_id, held_s


def _scored(k: int):
    def score(chunk: pa.Table, group: pa.Table) -> pa.Table:
        names, found = ("query_id", "vec_id", "score", "dims"), []
        if chunk.num_rows and group.num_rows:
            c_ids, c, _ = _whole(chunk)
            q_ids, q, floors = _whole(group)
            for at in range(0, len(q_ids), STRIP):
                part = slice(at, at + STRIP)
                rows, ids, scores = best(q_ids[part], q[:, part], c_ids, c, k, floors[part])
                found.append((q_ids[part][rows], ids, scores, np.full(len(ids), len(q))))
        none = np.empty(0, np.int64)
        return pa.table([pa.array(np.concatenate([none, *x]), pa.int64()) for x in list(zip(*found)) or [()] * 4], names=names)

    return score


def _met(chunks: DataFrame, groups: DataFrame, tasks: int, k: int) -> DataFrame:
    """The best of every chunk and group that have ``chunk``, ``group`` and ``dims`` in common."""
    keys = ["chunk", "group", "dims"]
    left, right = (df.repartition(tasks, *keys).groupBy(*keys) for df in (chunks, groups))
    return left.cogroup(right).applyInArrow(_scored(k), "query_id long, vec_id long, score long, dims long")


def search(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id",
           embedding: str = "embedding") -> DataFrame:
    """The ``k`` best candidates of every row for which ``is_query`` holds: query_id, rank, vec_id, score."""
    candidates = whole_numbers(vectors, vec_id, embedding)
    asked = whole_numbers(vectors.where(is_query), vec_id, embedding)
    rows, cells = candidates.agg(F.count(F.lit(1)), F.sum("dims")).first()
    q_cells = asked.agg(F.sum("dims")).first()[0] or 0
    spread = min(repeats.partitions(vectors), -(-rows // LEAST_ROWS))
    n_chunks, n_groups = max(1, -(-(cells or 0) // CHUNK_CELLS), spread), max(1, -(-q_cells // GROUP_CELLS))

    def dealt(df: DataFrame, n: int, floor: Column) -> DataFrame:
        part = F.pmod(F.xxhash64("id"), F.lit(n))
        return df.select("id", "cells", "dims", part.alias("part"), floor.alias("floor")).mapInArrow(_blocks, _BLOCK)

    def every(name: str, n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(name)

    none = F.lit(float("-inf"))
    once = asked.groupBy("id", "dims").agg(F.min("cells").alias("cells"))  # one query per id, if need be the least
    blocks = dealt(candidates, n_chunks, none).withColumnRenamed("part", "chunk")
    # First each group meets one chunk.
    first = dealt(once, n_groups, none).withColumnRenamed("part", "group").withColumn("chunk", F.col("group") % n_chunks)
    group = F.explode(F.sequence(F.col("chunk"), F.lit(n_groups - 1).cast("long"), F.lit(n_chunks).cast("long")))
    some = blocks.where(F.col("chunk") < n_groups).withColumn("group", group)
    seen = _met(some, first, min(n_groups, n_chunks * n_groups), k)
    floors = seen.groupBy(F.col("query_id").alias("id"), F.col("dims").cast("int").alias("dims")).agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score")).cast("double").alias("_floor")
    )
    floored = once.join(stored(floors, "floors"), ["id", "dims"], "left")
    queries = dealt(floored, n_groups, F.coalesce("_floor", none)).withColumnRenamed("part", "group")
    found = _met(
        blocks.select("*", every("group", n_groups)), queries.select("*", every("chunk", n_chunks)), n_chunks * n_groups, k
    )
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(place))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
