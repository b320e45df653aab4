"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every whole text. Spark counts the vote patterns over all
rows (three to the number of labellers at most), and expectation-maximisation estimates from the counts how often each
labeller votes what on good and on bad texts, without any true label. The posterior of a text's pattern is its soft
label, and a hashed linear scorer learns these on at most ``SAMPLE_ROWS`` whole texts. The scorer sees word shapes, not the
labellers' figures, so it also judges texts on which the labellers are silent or disagree.

Texts of any length are judged whole. Ties don't arise: a text is kept or not by its own score. Null and empty texts get
the votes and features of a text without words. Repeated rows are judged alike. Other columns
pass; ``score`` and ``kept`` replace columns of these names. An empty table gives an empty table; a model fitted on one
scores everything 0.5.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgergrain.llm import textops
from ledgergrain.llm.quality_rules import Texts

SAMPLE_ROWS = 6000
HASH_BITS = 12
ROUNDS = 200
#: Words added to the length when shares are taken, so that few words say little.
DAMPING = 10
#: Texts of a few words stay near the middle; only clear faults go.
CUTOFF = 0.3
GOOD, SILENT, BAD = 2, 1, 0


@dataclass(frozen=True)
class Labeller:
    """Votes bad where ``bad`` holds, else good where ``good`` holds."""

    name: str
    bad: Callable[[Texts], np.ndarray]
    good: Callable[[Texts], np.ndarray]

    def votes(self, texts: Texts) -> np.ndarray:
        return np.where(self.bad(texts), BAD, np.where(self.good(texts), GOOD, SILENT))


def _never(texts: Texts) -> np.ndarray:
    return np.zeros(texts.n, bool)


def _n_letters(texts: Texts) -> np.ndarray:
    return texts.n_upper + texts.n_lower + texts.per_text(texts.data >= 0xC0)


def _n_lone(texts: Texts) -> np.ndarray:
    """Words of one byte that is no letter or digit."""
    starts, ends, owner = texts.words
    lone = (ends - starts == 1) & (_KIND[texts.data[starts]] > 3)
    return np.bincount(owner[lone], minlength=texts.n)


def _kinds() -> np.ndarray:
    """Class of a byte: letters and digits by kind, bytes of longer characters as lower case, other bytes alone."""
    kind = np.arange(256)
    kind[97:123] = kind[128:] = 1
    kind[65:91] = 2
    kind[48:58] = 3
    return kind


_KIND = _kinds()

#: Most labellers know one fault and are silent else; faults overlap in pairs, so that the votes confirm each other.
LABELLERS = (
    Labeller("symbols", lambda t: 100 * t.n_symbols > 20 * t.n_words, _never),
    Labeller("few letters", lambda t: 100 * _n_letters(t) < 78 * t.word_chars, _never),
    Labeller("lone symbols", lambda t: 100 * _n_lone(t) > 10 * t.n_words, _never),
    Labeller("capitals", lambda t: 2 * t.n_upper > t.n_upper + t.n_lower, _never),
    Labeller("exclamations", lambda t: 100 * t.n_exclaim > 40 * t.n_words, _never),
    Labeller("stutter", lambda t: 100 * t.n_same_as_last > 15 * t.n_words, _never),
    Labeller("repeats", lambda t: 100 * t.n_repeat_words > 40 * t.n_words, _never),
    Labeller("word length", lambda t: (t.word_chars > 9 * t.n_words) | (t.word_chars < 2 * t.n_words),
             lambda t: (t.word_chars > 4 * t.n_words) & (t.word_chars < 7 * t.n_words)),
    Labeller("length", lambda t: t.n_words == 0, lambda t: t.n_words >= 50),
)


def patterns(texts: Texts, labellers=LABELLERS) -> np.ndarray:
    """All votes of each text as one number in base three."""
    out = np.zeros(texts.n, np.int64)
    for x in labellers:
        out = 3 * out + x.votes(texts)
    return out


def _digits(codes: np.ndarray, n: int) -> np.ndarray:
    return codes[:, None] // 3 ** np.arange(n - 1, -1, -1) % 3


def posteriors(codes: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """Chance of "good" per pattern, by expectation-maximisation from a vote in which bad counts twice."""
    votes, counts = _digits(codes, n), counts.astype(float)
    good = 1 / (1 + np.exp(-1.0 * ((votes == GOOD).sum(1) - 2 * (votes == BAD).sum(1) + 1)))
    for _ in range(ROUNDS):
        prior = (counts @ good + 1) / (counts.sum() + 2)
        up, down = np.zeros((n, 3)), np.zeros((n, 3))
        for v in range(3):
            hit = (votes == v) * counts[:, None]
            up[:, v], down[:, v] = good @ hit + 1, (1 - good) @ hit + 1
        # A labeller is right more often than not: bad texts get no fewer bad votes than good ones do.
        up, down = up / up.sum(1, keepdims=True), down / down.sum(1, keepdims=True)
        worse = np.maximum(down[:, BAD], up[:, BAD])
        down[:, BAD] = worse
        down /= down.sum(1, keepdims=True)
        at = np.arange(n)
        odds = np.log(prior / (1 - prior)) + (np.log(up[at, votes]) - np.log(down[at, votes])).sum(1)
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - good).max(initial=0) < 1e-9:
            break
        good = new
    return good


def features(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hashed feature and value: shares of word shapes, word lengths and repeated neighbours."""
    starts, ends, owner = texts.words
    first, second = _KIND[texts.data[starts]], _KIND[texts.data[np.minimum(starts + 1, ends - 1)]]
    last = _KIND[texts.data[ends - 1]]
    size = np.minimum(ends - starts, 15)
    same = np.zeros(len(starts), np.int64)
    same[1:] = (owner[1:] == owner[:-1]) & (texts.hashes[1:] == texts.hashes[:-1])
    shape = (first * 256 + second) * 256 + last
    share = 1.0 / (texts.n_words + DAMPING)[owner]
    empty = np.flatnonzero(texts.n_words == 0)
    who = np.r_[owner, owner, owner, empty]
    what = np.r_[shape, (1 << 25) + size, (1 << 26) + same, np.full(len(empty), 1 << 27)]
    value = np.r_[share, share, share, np.ones(len(empty))]
    return who, (textops.mix(what.astype(np.uint64)) >> np.uint64(64 - HASH_BITS)).astype(np.int64), value


def sparse(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of each text, and its hashed features with their summed values."""
    who, what, value = features(texts)
    keys, at = np.unique((who << HASH_BITS) + what, return_inverse=True)
    sums = np.bincount(at, value, minlength=len(keys)).astype(np.float32)
    return np.searchsorted(keys, np.arange(texts.n + 1) << HASH_BITS), (keys & (1 << HASH_BITS) - 1).astype(np.int32), sums


@dataclass(frozen=True)
class Scorer:
    weights: np.ndarray
    bias: float

    def scores(self, texts: Texts) -> np.ndarray:
        who, what, value = features(texts)
        return 1 / (1 + np.exp(-np.clip(np.bincount(who, self.weights[what] * value, minlength=texts.n) + self.bias, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 5, passes: int = 30) -> Scorer:
    """Logistic regression on soft labels, by gradient steps scaled per feature."""
    if not len(x):
        return Scorer(np.zeros(1 << HASH_BITS), 0.0)
    w, b = np.zeros(x.shape[1]), 0.0
    square, square_b = np.full(x.shape[1], 1e-8), 1e-8
    order = np.random.default_rng(seed)
    for _ in range(passes):
        for rows in np.array_split(order.permutation(len(x)), max(1, len(x) // 64)):
            p = 1 / (1 + np.exp(-np.clip(x[rows] @ w + b, -30, 30)))
            g = (p - y[rows]) / len(rows)
            step, step_b = x[rows].T @ g + 1e-5 * w, g.sum()
            square, square_b = square + step**2, square_b + step_b**2
            w = w - 0.5 * step / np.sqrt(square)
            b -= 0.1 * step_b / np.sqrt(square_b)
    return Scorer(w, float(b))


def _texts(column) -> Iterator[Texts]:
    data, offsets = textops.flat(column)
    for low, high in textops.slices(offsets):
        cut = offsets[low : high + 1]
        yield Texts(data[cut[0] : cut[-1]], cut - cut[0])


def fit(docs: DataFrame, text: str = "text", labellers=LABELLERS, sample_rows: int = SAMPLE_ROWS) -> Scorer:
    """Count the votes of all rows, estimate the labellers, and train on a seeded sample of bounded size."""
    body = docs.select(F.col(f"`{text}`").alias("t"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, counts = np.unique(
                np.concatenate([np.empty(0, np.int64), *(patterns(x, labellers) for x in _texts(batch.column("t")))]),
                return_counts=True,
            )
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts.astype(np.int64))], names=["code", "n"])

    # At most 3 ** len(labellers) rows.
    rows = body.mapInArrow(vote, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").collect()
    codes, counts = np.array([r.code for r in rows], np.int64), np.array([r.n for r in rows], np.int64)
    good = dict(zip(codes.tolist(), posteriors(codes, counts, len(labellers)).tolist()))
    share = min(1.0, 1.2 * sample_rows / max(int(counts.sum()), 1))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _texts(batch.column("t")):
                offsets, what, value = sparse(part)
                offsets = pa.array(offsets, pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (what, value)]
                yield pa.RecordBatch.from_arrays([pa.array(patterns(part, labellers)), *lists], names=["code", "what", "value"])

    # Whole texts stay in the tasks; the driver gets 2 ** HASH_BITS features of a row at most.
    sample = body.sample(share, seed=11).mapInArrow(sampled, "code long, what array<int>, value array<float>")
    rows = sample.limit(sample_rows).collect()
    x, y = np.zeros((len(rows), 1 << HASH_BITS), np.float32), np.array([good.get(r.code, 0.5) for r in rows])
    for i, r in enumerate(rows):
        x[i, r.what] = r.value
    return train(x, y)


def scored(docs: DataFrame, scorer: Scorer, text: str = "text") -> DataFrame:
    """All rows with ``score`` (chance of good quality) and ``kept`` (CUTOFF or more)."""
    docs = docs.drop("score", "kept")
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.concatenate([np.empty(0), *(shared.value.scores(x) for x in _texts(batch.column(text)))])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(values, pa.float64()), pa.array(values >= CUTOFF, pa.bool_())],
                names=[*batch.schema.names, "score", "kept"],
            )

    new = [T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, *new]))
