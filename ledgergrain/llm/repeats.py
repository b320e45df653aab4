"""Which 64-bit keys occur more than once in a corpus, counted by Spark with about six bytes of shuffle per key.

Texts are dealt once into blocks of about ``block_bytes`` by a hash of id and text. Each block sends its distinct
keys as sorted arrays, cut by key prefix; every prefix group merges the arrays of all blocks and answers with one bit
per key that another block has too. A key arrives once per block, so a passage that a third of all texts share is no
larger than any other key; groups hold ``group_keys`` keys on average, as the number of prefixes grows with the
corpus. The answers meet their block again through a cogroup on the block number.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgergrain.llm import textops

BLOCK_BYTES = 4 << 20
GROUP_KEYS = 1 << 20


@dataclass(frozen=True)
class Blocks:
    frame: DataFrame
    column: str
    bits: int

    @property
    def names(self) -> list[str]:
        return [c for c in self.frame.columns if c != self.column]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't use, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def blocked(docs: DataFrame, text: str, *, keys_per_byte: float, block_bytes: int = BLOCK_BYTES,
            group_keys: int = GROUP_KEYS) -> Blocks:
    """Deal the rows into blocks by a hash of all plain columns."""
    size, rows = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`"))), F.count(F.lit(1))).first()
    size = (size or 0) + 64 * rows
    blocks = max(1, -(-size // block_bytes))
    bits = max(6, int(size * keys_per_byte / group_keys).bit_length())
    column = fresh(docs, "block")
    plain = [F.col(f"`{f.name}`") for f in docs.schema if f.dataType.simpleString() in ("string", "bigint", "int")]
    frame = docs.withColumn(column, F.pmod(F.xxhash64(*plain), F.lit(blocks)))
    return Blocks(frame.repartition(max(partitions(docs), blocks // 4), column), column, bits)


def _pack(keys: np.ndarray) -> bytes:
    """Sorted keys byte plane by byte plane: the first planes hardly vary and compress well; last zero planes go."""
    planes = np.ascontiguousarray(keys.astype(">u8").view(np.uint8).reshape(-1, 8).T)
    held = np.flatnonzero(planes.any(axis=1))
    return len(keys).to_bytes(4, "little") + planes[: held[-1] + 1 if len(held) else 0].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    planes = np.zeros((8, n), np.uint8)
    held = np.frombuffer(data, np.uint8, offset=4).reshape(-1, n)
    planes[: len(held)] = held
    return np.ascontiguousarray(planes.T).view(">u8").ravel().astype(np.uint64)


def _bounds(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefixes that occur in sorted keys, and where each begins (with the end)."""
    prefix = (keys >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]]) if len(keys) else np.empty(0, np.int64)
    return prefix[first], np.r_[first, len(keys)]


def _sent(bits: int, column: str, level: int, keys_of: Callable[[pa.Table, pa.Table], np.ndarray]):
    def send(table: pa.Table, earlier: pa.Table) -> pa.Table:
        keys = np.unique(keys_of(table, earlier))
        prefixes, edges = _bounds(keys, bits)
        block = table.column(column)[0].as_py() if table.num_rows else 0
        own = pa.table(
            {
                "prefix": pa.array(prefixes, pa.int64()),
                "block": pa.array(np.full(len(prefixes), block), pa.int64()),
                "level": pa.array(np.full(len(prefixes), level), pa.int64()),
                "keys": pa.array([_pack(keys[a:b]) for a, b in zip(edges, edges[1:])], pa.binary()),
            }
        )
        if not earlier.num_rows:
            return own
        passed = [earlier.column("prefix"), pa.array([block] * earlier.num_rows, pa.int64()), *earlier.columns[2:]]
        return pa.concat_tables([own, pa.table(passed, names=own.schema.names).cast(own.schema)])

    return send


def _spread(blocks: np.ndarray) -> np.ndarray:
    """Class of a number of blocks: 0 for one, then a step for every doubling, up to 15."""
    return np.minimum(15, np.ceil(np.log2(np.maximum(blocks, 1)))).astype(np.uint8)


def _answer(level: int, counted: bool):
    def answer(table: pa.Table) -> pa.Table:
        prefix = table.column("prefix")[0].as_py() if table.num_rows else 0
        blocks, levels, flags, rows, owners = [], [], [], [], []
        for block, at, keys in zip(*(table.column(c).to_pylist() for c in ("block", "level", "keys"))):
            if at == level:
                rows.append(_unpack(keys))
                owners.append(block)
            else:  # answers of earlier levels go on to their block
                blocks.append(block)
                levels.append(at)
                flags.append(keys)
        together = np.sort(np.concatenate(rows)) if rows else np.empty(0, np.uint64)
        again, count = np.unique(together[1:][together[1:] == together[:-1]], return_counts=True)
        for block, keys in zip(owners, rows) if len(again) else ():
            place = np.minimum(np.searchsorted(again, keys), len(again) - 1)
            hit = again[place] == keys
            if hit.any():
                blocks.append(block)
                levels.append(level)
                if counted:
                    steps = np.zeros(len(keys) + len(keys) % 2, np.uint8)
                    steps[: len(keys)][hit] = _spread(count[place[hit]] + 1)
                    flags.append((steps[::2] << 4 | steps[1::2]).tobytes())
                else:
                    flags.append(np.packbits(hit).tobytes())
        return pa.table(
            {
                "block": pa.array(blocks, pa.int64()),
                "prefix": pa.array([prefix] * len(blocks), pa.int64()),
                "level": pa.array(levels, pa.int64()),
                "flags": pa.array(flags, pa.binary()),
            }
        )

    return answer


def shared(
    blocks: Blocks, keys_of: Callable, before: DataFrame | None = None, level: int = 0, counted: bool = False
) -> DataFrame:
    """Per block, prefix and level, one bit per distinct key of the block: whether another block has it.

    ``counted`` gives four bits: the class of the number of blocks that have it.
    ``keys_of(rows, earlier)`` gives a block's keys; ``earlier`` holds the answers of the levels before this one,
    which are returned again with the new ones.
    """
    own, sent = blocks.column, "prefix long, block long, level long, keys binary"
    if before is None:
        none = pa.schema([("block", pa.int64()), ("prefix", pa.int64()), ("level", pa.int64()), ("flags", pa.binary())])
        send = _sent(blocks.bits, own, level, keys_of)
        alone = textops.giving_back(lambda table: send(table, none.empty_table()), 1)
        rows = blocks.frame.groupBy(own).applyInArrow(alone, sent)
    else:
        rows = _joined(blocks, before).applyInArrow(_renamed(_sent(blocks.bits, own, level, keys_of)), sent)
    return rows.groupBy("prefix").applyInArrow(
        textops.giving_back(_answer(level, counted), 1), "block long, prefix long, level long, flags binary"
    )


def _joined(blocks: Blocks, answers: DataFrame):
    own = blocks.column
    ordered = answers.select(F.col("block").alias(own), F.col("prefix"), F.col("level"), F.col("flags"))
    return blocks.frame.groupBy(own).cogroup(ordered.groupBy(own))


def _renamed(function):
    names = ["block", "prefix", "level", "flags"]
    return textops.giving_back(lambda table, answers: function(table, answers.rename_columns(names)), 2)


def repeated(keys: np.ndarray, answers: pa.Table, bits: int, level: int = 0) -> np.ndarray:
    """For each key of a block (repeats included): does it occur twice in the corpus, here or elsewhere?"""
    distinct, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    twice = counts > 1
    prefixes, edges = _bounds(distinct, bits)
    place = dict(zip(prefixes.tolist(), range(len(prefixes))))
    for prefix, at, flags in zip(*(answers.column(c).to_pylist() for c in ("prefix", "level", "flags"))):
        if at == level:
            low, high = edges[place[prefix]], edges[place[prefix] + 1]
            twice[low:high] |= np.unpackbits(np.frombuffer(flags, np.uint8), count=high - low).astype(bool)
    return twice[inverse]


def spread(keys: np.ndarray, answers: pa.Table, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For each key of a block: does it occur twice in the corpus, and the class of the number of its blocks."""
    distinct, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    steps = np.zeros(len(distinct), np.uint8)
    prefixes, edges = _bounds(distinct, bits)
    place = dict(zip(prefixes.tolist(), range(len(prefixes))))
    for prefix, flags in zip(answers.column("prefix").to_pylist(), answers.column("flags").to_pylist()):
        low, high = edges[place[prefix]], edges[place[prefix] + 1]
        pairs = np.frombuffer(flags, np.uint8)
        steps[low:high] = np.stack([pairs >> 4, pairs & 15], axis=1).ravel()[: high - low]
    return ((counts > 1) | (steps > 0))[inverse], steps[inverse]


def applied(blocks: Blocks, answers: DataFrame, function: Callable[[pa.Table, pa.Table], pa.Table], schema) -> DataFrame:
    """Give each block's rows and its answers to ``function``; blocks without answers get an empty table."""
    return _joined(blocks, answers).applyInArrow(_renamed(function), schema)
