"""Vectorised text primitives for Arrow tasks: words, rolling hashes and kept bytes of many texts at once.

All texts of a batch lie in one byte array with offsets, as Arrow stores them. A null text counts as empty.
Rabin-Karp hashes are polynomials modulo 2**64 with odd bases. They are read off running sums of
``value * base**-position``, so one pass gives the hash of every window or word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xC2B2AE3D27D4EB4F
#: Work arrays of a slice stay in the processor's cache.
SLICE_BYTES = 256 << 10

_WORD = np.ones(256, bool)
_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def give_back() -> None:
    """Let the tables of powers go and return freed memory to the system.

    Workers stay between tasks and share the executor's memory with the JVM and with the workers of other stages.
    """
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only glibc has it
        pass


def giving_back(function, tables: int):
    """The function of one or two tables, with memory returned after each call."""

    def of_one(table: pa.Table) -> pa.Table:
        try:
            return function(table)
        finally:
            give_back()

    def of_two(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return function(left, right)
        finally:
            give_back()

    return of_one if tables == 1 else of_two


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        have = tuple(_power_row(b, size) for b in (base, pow(base, -1, 1 << 64)))
        if size <= 4 * SLICE_BYTES:
            _POWERS[base] = have
    return have[0][:n], have[1][:n]


def _power_row(base: int, n: int) -> np.ndarray:
    row = np.ones(n, np.uint64)
    done = 1
    while done < n:
        step = np.uint64(pow(base, done, 1 << 64))
        row[done : 2 * done] = row[:done] * step
        done *= 2
    return row


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, pa.scalar("", column.type))
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def texts(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """An Arrow string column over bytes and offsets."""
    if offsets[-1] < 1 << 31:
        return pa.StringArray.from_buffers(
            len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))
        )
    return pa.LargeStringArray.from_buffers(
        len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))
    )


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``size`` bytes; a longer text is a run of its own."""
    n, low = len(offsets) - 1, 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + size, "right")) - 1)
        yield low, min(high, n)
        low = min(high, n)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes stay."""
    return _LOWER[data]


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None):
    """Start, end and text number of every maximal run of word bytes; runs never cross texts."""
    inside = _WORD[data] if inside is None else inside
    n = len(data)
    if n == 0:
        none = np.empty(0, np.int64)
        return none, none, none
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    heads = offsets[:-1]
    before[heads[heads < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    tails = offsets[1:] - 1
    after[tails[tails >= 0]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def running(values: np.ndarray, base: int) -> np.ndarray:
    """Running sums of value * base**-position, with a leading zero."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values))[1], out=out[1:])
    return out


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes from each start to its end."""
    if len(starts) == 0:
        return np.empty(0, np.uint64)
    sums = running(data.astype(np.uint64) + np.uint64(1), BYTE_BASE)
    raw = (sums[ends] - sums[starts]) * powers(BYTE_BASE, len(data) + 1)[0][starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(WORD_BASE))


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbouring values, by running minima from both sides of fixed cuts."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    cut = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(cut, axis=1).ravel()
    behind = np.minimum.accumulate(cut[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def window_hashes(values: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of all windows of ``width`` neighbouring values that have one owner."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    starts = np.flatnonzero(owner[:n] == owner[width - 1 :])
    sums = running(values, WORD_BASE)
    return starts, mix((sums[starts + width] - sums[starts]) * powers(WORD_BASE, n)[0][starts])


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """True for each of n places that a window of ``width`` from one of the distinct starts covers."""
    steps = np.zeros(n + 1, np.int32)
    steps[starts] += 1
    steps[starts + width] -= 1
    return np.cumsum(steps[:-1]) > 0


def marked(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """True for the bytes of the given disjoint runs."""
    steps = np.zeros(n + 1, np.int8)
    steps[starts] += 1
    steps[ends] -= 1
    return np.cumsum(steps[:-1], dtype=np.int8) > 0


def joined(data, offsets, starts, ends, owner, keep) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the kept words of each text, joined by one blank."""
    starts, ends, owner = starts[keep], ends[keep], owner[keep]
    mask = marked(starts, ends, len(data))
    later = np.zeros(len(starts), bool)
    later[1:] = owner[1:] == owner[:-1]
    blanks = starts[later] - 1
    out = data.copy()
    out[blanks] = 0x20
    mask[blanks] = True
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return out[mask], sums[offsets]
