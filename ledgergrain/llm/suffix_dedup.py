"""Dedup of byte strings by bucket-pointer refinement of suffixes, in counted rounds of doubled length.

``remove_repeats(docs)`` removes every byte that a string of ``width`` bytes covers which also starts anywhere else,
in the same or another text.

* Suffixes begin in buckets of their first ``gram`` bytes. A round refines them to twice the length: the new bucket of a
  place is named by the pair of the old buckets there and one length later. Pairs of pairs reuse what is named before,
  so a worker names the buckets of any length from its grams; Spark counts which buckets hold one suffix only
  (``repeats``). Such a suffix is settled, and strings that depend on it take no further part.
* Names are 64-bit values of the bytes, the same wherever the bytes stand, in place of ranks that a sort of all suffixes
  would give: the cut needs to know which buckets have several suffixes, not their order.
* A round below ``width`` asks about one place per string, that with the least gram of those it can use: equal
  strings have it at the same offset. So the rounds of 100 and 200 bytes send one or two suffixes in a hundred,
  and the last round sends the strings of 400 bytes that both have left open.

Null and empty texts are empty byte strings. Repeated rows are repeats of each other. Texts of any length are read whole,
each in one task, with some thirty bytes of work memory a byte. Other columns pass unchanged; ``n_bytes``, ``n_removed``,
``n_spans`` and ``kept`` (binary, as a cut may split a character) replace columns of these names. An empty table gives
an empty table. Names collide with probability 2**-64 per pair of strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgergrain.llm import repeats, textops

WIDTH = 400
GRAM = 100
COUNTS = ("n_bytes", "n_removed", "n_spans")
_STEP = np.uint64(0xD6E8FEB86659FD93)


def lengths(width: int, gram: int) -> list[int]:
    """The lengths of the rounds: doubled from ``gram`` on, then ``width``."""
    out = [gram]
    while 2 * out[-1] < width:
        out.append(2 * out[-1])
    return [*out, width] if width > gram else [width]


class Suffixes:
    """A slice of texts: names of all grams, and the starts of the strings of ``width`` bytes that are open."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, width: int, gram: int):
        self.data, self.offsets, self.width, self.gram = data, offsets, width, gram
        long = np.maximum(np.diff(offsets) - width + 1, 0)
        starts = np.repeat(offsets[:-1] - np.cumsum(long) + long, long) + np.arange(long.sum())
        self.starts, self.ids = starts.astype(np.int32), np.empty(0, np.uint64)
        if len(starts):
            sums = textops.running(data.astype(np.uint64) + np.uint64(1), textops.BYTE_BASE)
            n = len(data) - gram + 1
            self.ids = textops.mix((sums[gram:] - sums[:n]) * textops.powers(textops.BYTE_BASE, n)[0])

    def places(self, length: int) -> tuple[np.ndarray, np.ndarray | None]:
        """The places of a round, and which of them each open string asks about (none: its own, in order)."""
        if length == self.width or not len(self.starts):
            return self.starts, None
        n = len(self.ids)
        low = np.uint64((1 << int(n).bit_length()) - 1)
        least = textops.least((self.ids & ~low) | np.arange(n, dtype=np.uint64), self.width - length + 1)
        at = (least[self.starts] & low).astype(np.int32)
        change = np.r_[True, at[1:] != at[:-1]]
        return at[change], np.cumsum(change, dtype=np.int32) - 1

    def names(self, at: np.ndarray, length: int) -> np.ndarray:
        """Names of the buckets of a length: of grams, then of pairs of those of half the length or more."""
        if length == self.gram:
            return self.ids[at]
        half = self.gram
        while 2 * half < length:
            half *= 2
        return textops.mix(self.names(at, half) * _STEP + self.names(at + (length - half), half))


def _suffixes(column, width: int, gram: int) -> Iterator[Suffixes]:
    data, offsets = textops.flat(column)
    for low, high in textops.slices(offsets):
        cut = offsets[low : high + 1]
        yield Suffixes(data[cut[0] : cut[-1]], cut - cut[0], width, gram)


def _all(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.empty(0, np.uint64), *parts])


def _open(table: pa.Table, answers: pa.Table, text: str, width: int, gram: int, bits: int, rounds: int):
    """The slices with the strings that the first rounds have left open, and their names of the next round."""
    parts, steps = list(_suffixes(table.column(text), width, gram)), lengths(width, gram)
    for level in range(rounds + 1):
        places = [s.places(steps[level]) for s in parts]
        names = [s.names(at, steps[level]) for s, (at, _) in zip(parts, places)]
        if level == rounds:
            return parts, names
        twice, done = repeats.repeated(_all(names), answers, bits, level), 0
        for s, (at, asked) in zip(parts, places):
            own = twice[done : done + len(at)]
            done += len(at)
            s.starts = s.starts[own if asked is None else own[asked]]


def _names(text: str, width: int, gram: int, bits: int, rounds: int):
    return lambda table, answers: _all(_open(table, answers, text, width, gram, bits, rounds)[1])


def _removed(text: str, width: int, gram: int, bits: int, names: list[str]):
    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        rounds = len(lengths(width, gram)) - 1
        parts, last = _open(table, answers, text, width, gram, bits, rounds)
        twice, done = repeats.repeated(_all(last), answers, bits, rounds), 0
        kept, counts = [], {n: [np.empty(0, np.int64)] for n in COUNTS}
        for s in parts:
            hit = s.starts[twice[done : done + len(s.starts)]]
            done += len(s.starts)
            s.ids = None
            gone = textops.covered(hit, width, len(s.data))
            owner = textops.spans(s.data, s.offsets, gone)[2]
            sums = np.r_[0, np.cumsum(~gone)]
            kept.append(textops.texts(s.data[~gone], sums[s.offsets]).cast(pa.large_binary()).cast(pa.binary()))
            counts["n_bytes"].append(np.diff(s.offsets))
            counts["n_removed"].append(np.diff(s.offsets) - np.diff(sums[s.offsets]))
            counts["n_spans"].append(np.bincount(owner, minlength=len(s.offsets) - 1))
        columns = {n: table.column(n) for n in names}
        columns |= {n: pa.array(np.concatenate(v), pa.int64()) for n, v in counts.items()}
        return pa.table(columns | {"kept": pa.chunked_array(kept, pa.binary())})

    return remove


def remove_repeats(
    docs: DataFrame, text: str = "text", width: int = WIDTH, gram: int = GRAM, **sizes: int
) -> DataFrame:
    """The rows with the bytes that are left as ``kept``, and their byte counts; ``gram`` is at most ``width``.

    ``sizes`` are those of ``repeats.blocked``.
    """
    docs = docs.drop(*COUNTS, "kept")
    blocks = repeats.blocked(docs, text, keys_per_byte=0.5, **sizes)
    answers = None
    for level in range(len(lengths(width, gram))):
        answers = repeats.shared(blocks, _names(text, width, gram, blocks.bits, level), answers, level=level)
    fields = [T.StructField(f.name, f.dataType) for f in docs.schema]
    fields += [T.StructField(n, T.LongType()) for n in COUNTS] + [T.StructField("kept", T.BinaryType())]
    return repeats.applied(
        blocks, answers, _removed(text, width, gram, blocks.bits, blocks.names), T.StructType(fields)
    )
