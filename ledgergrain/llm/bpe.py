"""Byte-level BPE encoding and decoding with length-bucketed padded numpy matrices.

``encode`` splits every whole text by a pattern and encodes each match by merge ranks; ``decode`` turns ids back into
bytes; ``round_trip`` does both in one worker, which then holds one set of vocabulary tables. Distinct pieces that a worker hasn't met lately go through ``Encoder.merge``: pieces of like length share a
padded matrix, every row merges its leftmost pair of lowest rank each round, the row's other cells close up, and
finished rows leave the matrix. Pair ranks come from an open-addressed hash table that is probed for all rows at once;
only the two pairs beside a merge are looked up again. A piece of over ``MATRIX_BYTES`` bytes is merged by a heap, which
gives the same ids in less than quadratic time.

The rank file is a parameter: the driver reads it and broadcasts its bytes (a vocabulary, so of fixed size).
Null and empty texts have no tokens (``token_ids`` is empty, never null). Repeated rows are encoded alike. All other
columns pass; ``n_tokens`` and ``token_ids`` replace columns of these names. An empty table gives an empty table.
Ids are stored as little-endian unsigned 32-bit integers in one binary value per row.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgergrain.llm import textops

MATRIX_BYTES = 512
CACHED_PIECES = 150_000
#: Cells of a matrix; the work arrays of a merge are about ten times as large.
MATRIX_CELLS = 1 << 18
SLICE_BYTES = 1 << 20
NONE = np.int32(2**31 - 1)
_EMPTY = np.uint64(2**64 - 1)
_PAD = 2**31 - 1
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_WIDTHS = np.array([2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64, 96, 128, 192, 256, 384, MATRIX_BYTES])


class PairTable:
    """Hash table from pairs of ids to the id of their merge, with linear probing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, _EMPTY)
        self.values = np.full(1 << bits, NONE)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] == _EMPTY
            self.keys[slot[free]] = keys[free]
            own = self.keys[slot] == keys
            self.values[slot[own]] = values[own]
            keys, values, slot = keys[~own], values[~own], (slot[~own] + 1) & self.last

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _FACTOR) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged id of each pair, NONE where there is none."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        flat = keys.ravel()
        out = np.full(len(flat), NONE)
        rows, slot = np.arange(len(flat)), self._slot(flat)
        while len(rows):
            held, asked = self.keys[slot], flat[rows]
            hit = held == asked
            out[rows[hit]] = self.values[slot[hit]]
            on = ~hit & (held != _EMPTY)
            rows, slot = rows[on], (slot[on] + 1) & self.last
        return out.reshape(keys.shape)


def token_ranks(rank_file: bytes) -> dict[bytes, int]:
    pairs = (line.split() for line in rank_file.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


class Encoder:
    def __init__(self, rank_file: bytes, pattern: str):
        self.ranks = token_ranks(rank_file)
        self.split = regex.compile(pattern).findall
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        merges = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    merges[a << 32 | b] = rank
        keys = np.fromiter(merges, np.uint64, len(merges))
        self.pairs = PairTable(keys, np.fromiter(merges.values(), np.int32, len(merges)))
        self.merges = merges
        self.cache: dict[str, bytes] = {}

    def pieces(self, texts: Iterable[str]) -> list[list[str]]:
        """The pieces of each text; those not met lately are encoded together into the cache."""
        cut = [self.split(t) for t in texts]
        new = set().union(*cut).difference(self.cache) if cut else set()
        if new and len(self.cache) + len(new) > CACHED_PIECES:
            self.cache.clear()
            new = set().union(*cut)
        self._learn(list(new))
        return cut

    def _learn(self, pieces: list[str]) -> None:
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            raw = p.encode()
            if (rank := self.ranks.get(raw)) is not None:
                self.cache[p] = rank.to_bytes(4, "little")
            elif len(raw) > MATRIX_BYTES:
                self.cache[p] = np.array(self.long(raw), "<u4").tobytes()
            else:
                buckets.setdefault(int(_WIDTHS[np.searchsorted(_WIDTHS, len(raw))]), []).append((p, raw))
        for width, members in buckets.items():
            step = max(1, MATRIX_CELLS // width)
            for at in range(0, len(members), step):
                part = members[at : at + step]
                self.cache.update(zip((p for p, _ in part), self.merge([raw for _, raw in part], width)))

    def merge(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids of pieces of at most ``width`` bytes, merged row by row in one padded matrix."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = np.full((len(pieces), width), _PAD, np.int32)
        ids[np.arange(width) < sizes[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = self.pairs.find(ids[:, :-1], ids[:, 1:])
        rows, out = np.arange(len(pieces)), [b""] * len(pieces)
        while len(rows):
            if ranks.shape[1]:
                place = ranks.argmin(axis=1)
                best = ranks[np.arange(len(rows)), place]
            else:
                place, best = np.zeros(len(rows), np.int64), np.full(len(rows), NONE)
            over = best == NONE
            if over.any():
                self._emit(ids[over], sizes[over], rows[over], out)
                ids, ranks, sizes, rows, place, best = (x[~over] for x in (ids, ranks, sizes, rows, place, best))
                if not len(rows):
                    break
            n, w = ids.shape
            row = np.arange(n)
            ids[row, place] = best
            stay = np.ones((n, w), bool)
            stay[row, place + 1] = False
            ids = ids[stay].reshape(n, w - 1)
            stay = np.ones((n, w - 1), bool)
            stay[row, place] = False
            ranks = ranks[stay].reshape(n, w - 2)
            sizes = sizes - 1
            if w > 2:
                for shift in (0, -1):
                    at = place + shift
                    ok = (at >= 0) & (at < w - 2)
                    r, a = row[ok], at[ok]
                    ranks[r, a] = self.pairs.find(ids[r, a], ids[r, a + 1])
        return out

    @staticmethod
    def _emit(ids: np.ndarray, sizes: np.ndarray, rows: np.ndarray, out: list[bytes]) -> None:
        data = ids[np.arange(ids.shape[1]) < sizes[:, None]].astype("<u4").tobytes()
        ends = np.cumsum(sizes * 4)
        for row, start, end in zip(rows.tolist(), (ends - sizes * 4).tolist(), ends.tolist()):
            out[row] = data[start:end]

    def long(self, piece: bytes) -> list[int]:
        """Ids of one long piece: a heap of pairs by rank and place over a linked list."""
        ids: list[int | None] = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        get = self.merges.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = rank, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (r := get(ids[left] << 32 | ids[right])) is not None:
                    heapq.heappush(heap, (r, left, ids[left], ids[right]))
        return [x for x in ids if x is not None]

    def ids(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text."""
        cut = self.pieces(texts)
        return [b"".join(map(self.cache.__getitem__, c)) for c in cut]


class Decoder:
    """The bytes of every id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.words = {rank: token for token, rank in ranks.items()}

    def decoded(self, ids: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _sized(batch: pa.RecordBatch, lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
    offsets = np.r_[0, np.cumsum(lengths)]
    for low, high in textops.slices(offsets, SLICE_BYTES):
        yield batch.slice(low, high - low)


def _bytes_of(column: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)


def _coded(docs: DataFrame, rank_path: str, pattern: str, text: str, to: str | None) -> DataFrame:
    new = [T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.BinaryType())]
    new += [T.StructField(to, T.BinaryType())] if to else []
    docs = docs.drop(*(f.name for f in new))
    with open(rank_path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoder(ranks.value, pattern)
        back = Decoder(own.ranks) if to else None
        for whole in batches:
            for batch in _sized(whole, _bytes_of(whole.column(text))):
                ids = own.ids(t or "" for t in batch.column(text).to_pylist())
                columns = [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())]
                if back:
                    columns.append(pa.array(map(back.decoded, ids), pa.binary()))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, *columns], names=[*batch.schema.names, *(f.name for f in new)]
                )
        del own, back
        textops.give_back()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *new]))


def encode(docs: DataFrame, rank_path: str, pattern: str, text: str = "text") -> DataFrame:
    """All rows with ``n_tokens`` and ``token_ids``."""
    return _coded(docs, rank_path, pattern, text, None)


def round_trip(docs: DataFrame, rank_path: str, pattern: str, text: str = "text", to: str = "decoded") -> DataFrame:
    """All rows with ``n_tokens``, ``token_ids`` and, in column ``to``, the bytes that the ids stand for."""
    return _coded(docs, rank_path, pattern, text, to)


def decode(tokens: DataFrame, rank_path: str, ids: str = "token_ids", to: str = "decoded") -> DataFrame:
    """All rows with the bytes that the ids stand for in column ``to``; null ids give null."""
    tokens = tokens.drop(to)
    with open(rank_path, "rb") as f:
        ranks = tokens.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Decoder(token_ranks(ranks.value))
        for whole in batches:
            for batch in _sized(whole, _bytes_of(whole.column(ids))):
                out = [None if i is None else own.decoded(i) for i in batch.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, to]
                )

    return tokens.mapInArrow(run, T.StructType([*tokens.schema.fields, T.StructField(to, T.BinaryType())]))
