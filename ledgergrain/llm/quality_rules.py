"""Quality rules: a short-circuit cascade ordered by rejections per cost, as measured on a sample.

``text_figures`` gives figures of every whole text (words are ``[^\\x20\\x09-\\x0D]+``). ``Cascade.fit`` runs every
rule on a sample in Spark tasks, measures its cost and its rejections, and orders the rules greedily: next comes the
rule with the most rejections per second among the rows that the earlier ones let pass. Each rule then sees only the
rows that are still alive. A verdict is "no rule rejects", so it doesn't depend on the order.

Texts of any length are read whole, in one task each; figures take some ten bytes of work memory a byte of text. Null and empty texts have no words and fail the base rule. Ties and repeated rows get the same verdict. An empty
table gives an empty table; fitting on one keeps the order given.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgergrain.llm import textops

SAMPLE_ROWS = 2000
REPEAT_WIDTH = 8
MIN_WORDS = 20
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Symbols that the base figure counts; fixed values.
SYMBOLS = "#*$%&|<>"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True
_CONTINUED = (np.arange(256) & 0xC0) == 0x80


class Texts:
    """The texts of a batch with the figures that rules share, each computed when first asked for."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1
        self._known: dict[str, np.ndarray] = {}

    def __getattr__(self, name: str):
        if name.startswith("_") or not hasattr(type(self), f"_{name}"):
            raise AttributeError(name)
        if name not in self._known:
            self._known[name] = getattr(self, f"_{name}")()
        return self._known[name]

    def only(self, rows: np.ndarray) -> Texts:
        """The texts of some rows, with what is known of them so far."""
        lengths = np.diff(self.offsets)
        alive = np.zeros(self.n, bool)
        alive[rows] = True
        cut = Texts(self.data[np.repeat(alive, lengths)], np.r_[0, np.cumsum(lengths[rows])])
        cut._known = {k: v[rows] for k, v in self._known.items() if k in FIGURES}
        return cut

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text the mask has."""
        sums = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return np.diff(sums[self.offsets])

    def _words(self):
        return textops.spans(self.data, self.offsets)

    def _hashes(self):
        return textops.run_hashes(self.data, *self.words[:2])

    def _n_words(self):
        return np.bincount(self.words[2], minlength=self.n)

    def _word_chars(self):
        return self.per_text(textops._WORD[self.data] & ~_CONTINUED[self.data])

    def _n_symbols(self):
        return self.per_text(_SYMBOL[self.data])

    def _n_upper(self):
        return self.per_text((self.data >= 65) & (self.data <= 90))

    def _n_lower(self):
        return self.per_text((self.data >= 97) & (self.data <= 122))

    def _n_exclaim(self):
        return self.per_text(self.data == 33)

    def _n_dup_lines(self):
        starts, ends, owner = textops.spans(self.data, self.offsets, self.data != 10)
        first = np.searchsorted(self.words[0], starts)
        heads = np.r_[self.words[0], len(self.data)]
        has_word = heads[first] < ends
        starts, ends, owner = starts[has_word], ends[has_word], owner[has_word]
        key = textops.mix(textops.run_hashes(self.data, starts, ends) ^ textops.mix(owner.astype(np.uint64)))
        _, once = np.unique(key, return_index=True)
        later = np.ones(len(key), bool)
        later[once] = False
        return np.bincount(owner[later], minlength=self.n)

    def _n_repeat_words(self):
        owner = self.words[2]
        at, hashes = textops.window_hashes(self.hashes, owner, REPEAT_WIDTH)
        key = textops.mix(hashes ^ textops.mix(owner[at].astype(np.uint64)))
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        inside = textops.covered(at[counts[inverse] > 1], REPEAT_WIDTH, len(owner))
        return np.bincount(owner[inside], minlength=self.n)

    def _n_same_as_last(self):
        """Words equal to the word before them."""
        owner, h = self.words[2], self.hashes
        same = (owner[1:] == owner[:-1]) & (h[1:] == h[:-1])
        return np.bincount(owner[1:][same], minlength=self.n)

    def _base_failed(self):
        return (self.n_words < MIN_WORDS) | (100 * self.n_repeat_words > 30 * self.n_words)


FIGURES = {*BASE, "n_upper", "n_lower", "n_exclaim", "n_same_as_last", "base_failed"}


@dataclass(frozen=True)
class Rule:
    """Rejects the rows for which ``test`` is true; limits are whole percentages."""

    name: str
    test: Callable[[Texts], np.ndarray]


RULES = (
    Rule("base", lambda t: t.base_failed),
    Rule("symbols", lambda t: 100 * t.n_symbols > 15 * t.n_words),
    Rule("shouting", lambda t: 100 * t.n_upper > 60 * (t.n_upper + t.n_lower)),
    Rule("exclamations", lambda t: 100 * t.n_exclaim > 50 * t.n_words),
    Rule("stutter", lambda t: 100 * t.n_same_as_last > 20 * t.n_words),
    Rule("long words", lambda t: t.word_chars > 15 * t.n_words),
)


def _ordered(rules: tuple[Rule, ...], cost: dict[int, float], masks: dict[int, int]) -> tuple[Rule, ...]:
    """Greedy order by rejections per second. ``masks`` counts texts by the rules (bits) that reject them."""
    left, order, gone = list(range(len(rules))), [], 0
    while left:

        def rate(i: int) -> tuple[float, float]:
            fresh = sum(n for mask, n in masks.items() if mask >> i & 1 and not mask & gone)
            return fresh / max(cost[i], 1e-9), -cost[i]

        best = max(left, key=rate)
        left.remove(best)
        order.append(rules[best])
        gone |= 1 << best
    return tuple(order)


def _timed(rules: tuple[Rule, ...]):
    """Per task: seconds of each rule on texts without earlier figures, and texts by the rules that reject them."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seconds, masks = np.zeros(len(rules)), {}
        for batch in batches:
            for part in _parts(batch.column(0)):
                mask = np.zeros(part.n, np.int64)
                for i, rule in enumerate(rules):
                    started = time.perf_counter()
                    rejects = rule.test(Texts(part.data, part.offsets))
                    seconds[i] += time.perf_counter() - started
                    mask |= rejects.astype(np.int64) << i
                for key, n in zip(*np.unique(mask, return_counts=True)):
                    masks[int(key)] = masks.get(int(key), 0) + int(n)
        rows = [(-1 - i, s) for i, s in enumerate(seconds)] + [(k, float(n)) for k, n in masks.items()]
        if masks:
            keys, values = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(values, pa.float64())], names=["k", "v"])

    return measure


@dataclass(frozen=True)
class Cascade:
    rules: tuple[Rule, ...] = RULES

    @staticmethod
    def fit(docs: DataFrame, text: str = "text", rules=RULES, sample_rows: int = SAMPLE_ROWS) -> Cascade:
        """Order the rules (62 at most) on a seeded sample of about ``sample_rows`` whole texts of any length.

        Rules are timed in tasks; what comes to the driver is a number per rule and one per set of rules that reject
        the same texts.
        """
        share = min(1.0, sample_rows / max(docs.count(), 1))
        sample = docs.select(F.col(f"`{text}`").alias("t")).sample(share, seed=7)
        rows = sample.mapInArrow(_timed(tuple(rules)), "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
        if not rows:
            return Cascade(tuple(rules))
        cost = {-1 - r.k: r.v for r in rows if r.k < 0}
        return Cascade(_ordered(tuple(rules), cost, {r.k: int(r.v) for r in rows if r.k >= 0}))

    def kept(self, texts: Texts) -> np.ndarray:
        """True for rows that no rule rejects; each rule sees the rows that are left."""
        alive, left = np.arange(texts.n), texts
        for rule in self.rules:
            if len(alive) == 0:
                break
            ok = ~rule.test(left)
            if not ok.all():
                alive, left = alive[ok], left.only(np.flatnonzero(ok))
        out = np.zeros(texts.n, bool)
        out[alive] = True
        return out


def _parts(column) -> Iterator[Texts]:
    data, offsets = textops.flat(column)
    for low, high in textops.slices(offsets):
        cut = offsets[low : high + 1]
        yield Texts(data[cut[0] : cut[-1]], cut - cut[0])


def judged(docs: DataFrame, cascade: Cascade, text: str = "text") -> DataFrame:
    """All rows with the base figures, ``base_failed`` and ``kept``; columns of these names are replaced."""
    docs = docs.drop(*BASE, "base_failed", "kept")
    fields = [T.StructField(n, T.LongType()) for n in BASE]
    fields += [T.StructField(n, T.BooleanType()) for n in ("base_failed", "kept")]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = list(_parts(batch.column(text)))
            new = [[np.asarray(getattr(p, n)) for p in parts] for n in (*BASE, "base_failed")]
            new.append([cascade.kept(p) for p in parts])
            types = [pa.int64()] * len(BASE) + [pa.bool_()] * 2
            columns = [pa.array(np.concatenate([np.empty(0, t.to_pandas_dtype()), *v]), t) for v, t in zip(new, types)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *columns], names=[*batch.schema.names, *(f.name for f in fields)]
            )

    return docs.mapInArrow(judge, T.StructType([*docs.schema.fields, *fields]))


def filtered(docs: DataFrame, cascade: Cascade, text: str = "text") -> DataFrame:
    """Only the rows that every rule lets pass, with the columns they came with."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [cascade.kept(p) for p in _parts(batch.column(text))]
            yield batch.filter(pa.array(np.concatenate([np.empty(0, bool), *ok]), pa.bool_()))
        textops.give_back()

    return docs.mapInArrow(keep, docs.schema)
