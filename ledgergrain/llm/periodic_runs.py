"""Periodic run detection by block convolution: exact number-theoretic transforms at dyadic scales.

A run is a stretch of words with smallest period q and a length of at least ``max(6, 4 * q)`` that no neighbouring
word extends with that period. ``find(docs)`` gives all runs of every whole text, and the text without their repeats:
a word goes if any run has it after the run's first q words.

For periods in [L, 2L), L a power of two, texts are cut into blocks of L words. A run of such a period holds two
neighbouring blocks, at least, that occur again q words later. For each block the sum of squared differences to every
place of the window behind it comes from one transform, exactly: words are numbered within the block (others are 0), so
a sum is below the product of the primes, and it is 0 only where all words are equal. Distances with a zero are seeds:
neighbouring blocks of one distance join, and less than a block on either side is compared word by word. Blocks with a
word that doesn't recur in its part of the window can't match and need no transform, nor do blocks inside a run of a
smaller period. Blocks over ``LIMIT`` words are cut; their windows are passed piece by piece, so work arrays stay small.

Words are ``[^\\x20\\x09-\\x0D]+``, compared by their bytes. Null, empty and blank texts have no runs and an empty
``collapsed``. Texts are never cut, whatever their length; one text is worked on in one task, in memory of some hundred
bytes a word. Repeated rows are treated alike. Runs are listed by start, then period. All other columns pass; ``n_words``,
``runs`` and ``collapsed`` replace columns of these names. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgergrain.llm import textops

#: Primes with a root of unity of every order that is needed, and a generator of each.
PRIMES = ((2013265921, 31), (469762049, 3))
#: Largest block; the cube of it is below the product of the primes.
LIMIT = 1 << 19
#: Cells of a work matrix.
CELLS = 1 << 18
#: Bytes of text that are worked on at once; a longer text is worked on alone.
SLICE_BYTES = 1 << 20
LEAST, TIMES = 6, 4


@lru_cache(maxsize=64)
def _roots(size: int, prime: int, generator: int, inverse: bool) -> list[np.ndarray]:
    """Powers of the roots of order 2, 4, .. size."""
    out, half = [], 1
    while half < size:
        root = pow(generator, (prime - 1) // (2 * half), prime)
        root = pow(root, -1, prime) if inverse else root
        row = np.ones(half, np.uint64)
        done = 1
        while done < half:
            row[done : 2 * done] = row[:done] * np.uint64(pow(root, done, prime)) % np.uint64(prime)
            done *= 2
        out.append(row)
        half *= 2
    return out


def _forward(rows: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """Transform of each row; its places come in bit-reversed order."""
    n, size, p = len(rows), rows.shape[1], np.uint64(prime)
    for roots in reversed(_roots(size, prime, generator, False)):
        pair = rows.reshape(n, -1, 2, len(roots))
        left, right = pair[:, :, 0], pair[:, :, 1]
        rows = np.stack([(left + right) % p, (left + p - right) * roots % p], axis=2).reshape(n, size)
    return rows


def _backward(rows: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """The rows that have these transforms."""
    n, size, p = len(rows), rows.shape[1], np.uint64(prime)
    for roots in _roots(size, prime, generator, True):
        pair = rows.reshape(n, -1, 2, len(roots))
        left, right = pair[:, :, 0], pair[:, :, 1] * roots % p
        rows = np.stack([(left + right) % p, (left + p - right) % p], axis=2).reshape(n, size)
    return rows * np.uint64(pow(size, -1, prime)) % p


def zero_differences(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Where each block (values from 1 up to its width, or 0) equals a window of twice its width, by place.

    Entry s of a row: is the sum over j of (block[j] - window[j + s])**2 zero, for s below the width? The sum is at most
    the cube of the width, and it is known modulo primes whose product is larger.
    """
    n, width = blocks.shape
    size = 2 * width
    sums = np.zeros((n, size + 1), np.int64)
    np.cumsum(windows * windows, axis=1, out=sums[:, 1:])
    squares = (blocks * blocks).sum(axis=1)[:, None] + sums[:, width:size] - sums[:, :width]
    turned = np.zeros((n, size), np.uint64)
    turned[:, (-np.arange(width)) % size] = blocks
    zero = np.ones((n, width), bool)
    bound = 1
    for prime, generator in PRIMES:
        if bound > width**3:
            break
        bound *= prime
        p = np.uint64(prime)
        spectrum = _forward(turned, prime, generator) * _forward(windows.astype(np.uint64), prime, generator) % p
        products = _backward(spectrum, prime, generator)[:, :width]
        zero &= squares.astype(np.uint64) % p == products * np.uint64(2) % p
    return zero


class Words:
    """The words of some texts as numbers, with the next place of each."""

    def __init__(self, ids: np.ndarray, edges: np.ndarray):
        self.ids, self.edges, self.n = ids.astype(np.int64), edges, len(ids)
        order = np.argsort(self.ids, kind="stable")
        self.keys = self.ids[order] * (self.n + 1) + order

    def recurs(self, at: np.ndarray, distance: int) -> np.ndarray:
        """Does the word at each place come again at ``distance`` or more, below twice that?"""
        base = self.ids[at] * (self.n + 1)
        place = np.searchsorted(self.keys, base + at + distance)
        found = self.keys[np.minimum(place, self.n - 1)]
        return (place < self.n) & (found >= base + at + distance) & (found < base + at + 2 * distance)


class Runs:
    """Runs of the scales so far, to ask whether a stretch lies inside one."""

    def __init__(self):
        self.start = self.end = self.period = np.empty(0, np.int64)
        self.most = self.end

    def add(self, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> None:
        start, end = np.r_[self.start, start], np.r_[self.end, end]
        order = np.argsort(start, kind="stable")
        self.start, self.end, self.period = start[order], end[order], np.r_[self.period, period][order]
        self.most = np.maximum.accumulate(self.end)

    def hold(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if not len(self.start):
            return np.zeros(len(start), bool)
        at = np.searchsorted(self.start, start, "right") - 1
        return (at >= 0) & (self.most[at] >= end)


def _blocks(words: Words, scale: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the blocks that have room for a shift of ``scale``, and the ends of their texts."""
    first, end = words.edges[:-1], words.edges[1:]
    n = end - first
    count = np.where(n >= max(LEAST, TIMES * scale), np.maximum((n - width - scale) // width + 1, 0), 0)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(first, count) + width * place, np.repeat(end, count)


def _hopeful(words: Words, starts: np.ndarray, scale: int, width: int) -> np.ndarray:
    """True for blocks whose every word recurs in its window; few words settle most blocks."""
    left = np.arange(len(starts))
    asked = dict.fromkeys(width * k // 8 for k in (0, 4, 7, 2, 6, 1, 3, 5))
    for offset in asked:
        left = left[words.recurs(starts[left] + offset, scale)]
    step = max(1, CELLS // width)
    inside = np.arange(width)
    full = [np.empty(0, np.int64)]
    for low in range(0, len(left), step) if len(asked) < width else ():
        part = left[low : low + step]
        full.append(part[words.recurs((starts[part, None] + inside).ravel(), scale).reshape(-1, width).all(axis=1)])
    ok = np.zeros(len(starts), bool)
    ok[np.concatenate(full) if len(asked) < width else left] = True
    return ok


def _seeds(words: Words, starts: np.ndarray, ends: np.ndarray, scale: int, width: int):
    """Block starts and the distances in [scale, 2 * scale) at which the blocks occur again."""
    at, distance = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    step = max(1, CELLS // (2 * width))
    span = int(words.ids.max()) + 1 if words.n else 1
    for low in range(0, len(starts), step):
        s, e = starts[low : low + step, None], ends[low : low + step, None]
        row = np.arange(len(s))[:, None] * span
        own = row + words.ids[s + np.arange(width)]
        known = np.unique(own)
        first = np.searchsorted(known, row)
        blocks = np.searchsorted(known, own) - first + 1
        for shift in range(scale, 2 * scale, width):
            place = s + shift + np.arange(2 * width)
            keys = row + words.ids[np.minimum(place, words.n - 1)]
            rank = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            windows = np.where((known[rank] == keys) & (place < e), rank - first + 1, 0)
            hit, offset = np.nonzero(zero_differences(blocks, windows))
            at.append(s[hit, 0])
            distance.append(shift + offset)
    return np.concatenate(at), np.concatenate(distance)


def _further(words: Words, place: np.ndarray, step: int, q: np.ndarray, bound: np.ndarray, width: int) -> np.ndarray:
    """How many words from each place on (below ``width``) equal those q words later, going by ``step`` to a bound."""
    out = np.zeros(len(place), np.int64)
    if width < 2:
        return out
    offset = np.arange(width - 1)
    rows = max(1, CELLS // width)
    for low in range(0, len(place), rows):
        part = slice(low, low + rows)
        at = place[part, None] + step * offset
        inside = (at >= bound[part, None]) if step < 0 else (at + q[part, None] < bound[part, None])
        at = np.clip(at, 0, words.n - 1)
        same = inside & (words.ids[at] == words.ids[np.minimum(at + q[part, None], words.n - 1)])
        out[part] = np.where(same.all(axis=1), width - 1, np.argmin(same, axis=1))
    return out


def runs_of(ids: np.ndarray, edges: np.ndarray, limit: int = LIMIT) -> Runs:
    """All runs of the texts whose words are ``ids[edges[i]:edges[i + 1]]``, with places counted over all texts."""
    words, found = Words(ids, edges), Runs()
    longest = int(np.diff(edges).max()) if len(edges) > 1 else 0
    scale = 1
    while max(LEAST, TIMES * scale) <= longest:
        width = min(scale, limit)
        starts, ends = _blocks(words, scale, width)
        ok = _hopeful(words, starts, scale, width)
        near = np.zeros(len(starts), bool)
        pair = ok[1:] & ok[:-1] & (starts[1:] == starts[:-1] + width)
        near[1:] |= pair
        near[:-1] |= pair
        ok &= near
        ok[ok] = ~found.hold(starts[ok], np.minimum(starts[ok] + width + 2 * scale - 1, ends[ok]))
        at, q = _seeds(words, starts[ok], ends[ok], scale, width)
        order = np.lexsort((at, q))
        at, q = at[order], q[order]
        head = np.ones(len(at), bool)
        head[1:] = (q[1:] != q[:-1]) | (at[1:] != at[:-1] + width)
        first = at[head]
        last = at[np.r_[head[1:], True][: len(at)]] + width
        q = q[head]
        need = np.maximum(LEAST, TIMES * q)
        keep = (last - first + 2 * (width - 1) + q >= need) & ~found.hold(first, last + q)
        first, last, q, need = first[keep], last[keep], q[keep], need[keep]
        text = np.searchsorted(edges, first, "right") - 1
        first = first - _further(words, first - 1, -1, q, edges[text], width)
        last = last + _further(words, last, 1, q, edges[text + 1], width) + q
        keep = (last - first >= need) & ~found.hold(first, last)
        if keep.any():
            rows = np.unique(np.stack([first[keep], last[keep], q[keep]], axis=1), axis=0)
            found.add(rows[:, 0], rows[:, 1], rows[:, 2])
        scale *= 2
    return found


def _numbered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal words get equal numbers."""
    offsets = np.r_[0, np.cumsum(ends - starts)]
    held = np.ascontiguousarray(data[textops.marked(starts, ends, len(data))]) if len(data) else data
    column = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(held)]
    )
    return np.asarray(column.dictionary_encode().indices).astype(np.int64)


_RUN = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])


def _worked(column: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Per text: words, runs and the collapsed text."""
    data, offsets = textops.flat(column)
    starts, ends, owner = textops.spans(data, offsets)
    edges = np.searchsorted(owner, np.arange(len(offsets)))
    found = runs_of(_numbered(data, starts, ends), edges)
    order = np.lexsort((found.period, found.start))
    start, end, period = found.start[order], found.end[order], found.period[order]
    steps = np.zeros(len(starts) + 1, np.int64)
    np.add.at(steps, start + period, 1)
    np.add.at(steps, end, -1)
    text = np.searchsorted(edges, start, "right") - 1
    columns = [pa.array(x, pa.int64()) for x in (start - edges[text], end - start, period)]
    per_text = np.searchsorted(start, edges)
    runs = pa.ListArray.from_arrays(
        pa.array(per_text, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_RUN))
    )
    kept = textops.joined(data, offsets, starts, ends, owner, np.cumsum(steps[:-1]) == 0)
    return pa.array(np.diff(edges), pa.int64()), runs, textops.texts(*kept).cast(pa.string())


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows with ``n_words``, ``runs`` (start, length and period of each) and ``collapsed``."""
    run = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
    new = [
        T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(run)),
        T.StructField("collapsed", T.StringType()),
    ]
    docs = docs.drop(*(f.name for f in new))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = textops.flat(whole.column(text))[1]
            for low, high in textops.slices(sizes, SLICE_BYTES):
                batch = whole.slice(low, high - low)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, *_worked(batch.column(text))], names=[*batch.schema.names, *(f.name for f in new)]
                )
        textops.give_back()

    return docs.mapInArrow(work, T.StructType([*docs.schema.fields, *new]))
