"""Toxicity by a subsequence string kernel, Nystroem landmarks and a linear support vector machine.

The kernel of two words counts their common subsequences of four characters within a span of six, each gap
discounted, so an insult still resembles itself with letters inserted, dropped at the end or run together. Words are
runs of letters, lower-cased; symbols within a word and the gaps of spaced-out letters ("i.d.i.o.t") are closed up.

``fit`` trains on at most ``PER_CLASS`` labelled ids of each class. Their texts are read whole, in Spark tasks:

1. landmarks: the words of toxic texts with the highest log odds, and the most frequent words of clean ones;
2. every sentence is mapped by its strongest kernel value to each landmark and the inverse root of the landmarks'
   kernel matrix;
3. a support vector machine learns from labelled sentences: all those of clean texts, and of each toxic text those
   that score highest so far, in rounds;
4. a logistic curve over a text's toxic words turns their number and strength into a score from 0 to 1.

Landmark values are linear in a word's subsequences, so the machine collapses to one weight per subsequence (by a
hash of CODE_BITS bits) and a worker scores whole texts with array operations alone.

Texts of any length are scored whole. Null and empty texts score like texts without words. Repeated rows score alike.
Ties among words, landmarks and sentences go by text, then id, so a fit repeats. Only id and text are read, and only the
named result columns return, so no name clashes. Labels that are null are left out;
with one class only, every score is the share of that class. Empty tables give empty results.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgergrain.llm import textops
from ledgergrain.session import checkpointed

PER_CLASS = 3000
#: Sentences are read in runs of so many characters; a task keeps the values of so many words.
GROUP_CHARS, KNOWN_WORDS = 1 << 18, 50_000
#: Tasks of the training rows: by their bytes, within limits.
LEAST_PARTS, MOST_PARTS, PART_BYTES = 12, 1024, 4 << 20
TOXIC_LANDMARKS, CLEAN_LANDMARKS = 64, 24
ALIKE = 0.65
DECAY = 0.5
MIN_ODDS = 4
#: Three limits of a toxic word: clean texts have so many above each on average.
CLEAN_HITS = (0.02, 0.1, 0.4)
ROUNDS = 4
CUTOFF = 0.7
LENGTH, SPAN = 4, 6
#: Offsets of the characters of a subsequence after its first, and what its gaps cost.
SHAPES = [(c, DECAY ** (c[-1] - LENGTH + 1)) for c in combinations(range(1, SPAN), LENGTH - 1)]
EDGE = 63
CODE_BITS = 21

_LETTER = np.array([chr(c).isalpha() for c in range(0x10000)])
_INNER = np.zeros(0x10000, bool)
_INNER[[ord(c) for c in "*-_~^'`|$#@+="]] = True
_CODE = np.zeros(0x10000, np.uint8)
_CODE[:] = 27 + (np.arange(0x10000, dtype=np.uint64) * np.uint64(2654435761) >> np.uint64(7)) % np.uint64(36)
_CODE[97:123] = np.arange(1, 27)
_CODE[~_LETTER] = EDGE


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of lower-cased texts behind an edge each, with separators inside words taken out; and offsets."""
    low = [" " + t.lower() for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le"), np.uint32)
    points = np.where(points < 0x10000, points, 32)
    offsets = np.r_[0, np.cumsum([len(t) for t in low])].astype(np.int64)
    for pick in (_symbols, _spaced):
        gone = pick(points)
        if gone.any():
            sums = np.r_[0, np.cumsum(~gone)]
            points, offsets = points[~gone], sums[offsets]
    return points, offsets


def _symbols(points: np.ndarray) -> np.ndarray:
    """Symbols between two letters."""
    letter = _LETTER[points]
    out = np.zeros(len(points), bool)
    if len(points) > 2:
        out[1:-1] = _INNER[points[1:-1]] & letter[:-2] & letter[2:]
    return out


def _spaced(points: np.ndarray) -> np.ndarray:
    """Single characters between letters that stand alone, three or more in a row."""
    letter = _LETTER[points]
    n = len(points)
    alone = np.zeros(n, bool)
    if n > 2:
        alone[1:-1] = letter[1:-1] & ~letter[:-2] & ~letter[2:]
        alone[-1] = letter[-1] and not letter[-2]
    out = np.zeros(n, bool)
    if n > 4:
        three = alone[:-4] & alone[2:-2] & alone[4:]
        at = np.flatnonzero(three)
        out[at + 1] = True
        out[at + 3] = True
    return out


def words_of(points: np.ndarray, offsets: np.ndarray):
    """Start and end of every word and the number of its text."""
    letter = _LETTER[points]
    edges = np.flatnonzero(np.diff(np.r_[False, letter, False].astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def subsequences(points: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """For each shape: place in the stream, code and weight of the subsequences; a word's first place is its edge."""
    codes = _CODE[points].astype(np.uint32)
    last = np.zeros(len(points), np.int64)
    size = ends - starts + 1
    at = np.repeat(starts - 1 - (np.cumsum(size) - size), size) + np.arange(size.sum())
    last[at] = np.repeat(ends, size)
    room = last[at] - at
    for offsets, weight in SHAPES:
        ok = at[room > offsets[-1]]
        code = codes[ok]
        for i in offsets:
            code = code << np.uint32(6) | codes[ok + i]
        yield ok, code * np.uint32(2654435761) >> np.uint32(32 - CODE_BITS), weight


def _own_kernel(length: np.ndarray) -> np.ndarray:
    """A word's kernel with itself when its subsequences differ, by its length."""
    total = np.zeros(len(length))
    for offsets, weight in SHAPES:
        total += weight**2 * np.maximum(length + 1 - offsets[-1], 0)
    return np.sqrt(np.maximum(total, 1e-9))


def _features(words: list[str]):
    """Number of the word, code and weight of all its subsequences."""
    points, offsets = characters(words)
    starts, ends, owner = words_of(points, offsets)
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.uint32), np.empty(0), np.zeros(len(words), np.int64)
    who, codes, weights = [], [], []
    for at, code, weight in subsequences(points, starts, ends):
        who.append(np.searchsorted(offsets, at, "right") - 1)
        codes.append(code)
        weights.append(np.full(len(code), weight))
    return np.concatenate(who), np.concatenate(codes), np.concatenate(weights), np.bincount(
        owner, ends - starts, minlength=len(words)
    )


class Landmarks:
    """Kernel values of words to the landmark words, both scaled to unit length."""

    def __init__(self, words: list[str]):
        self.words = words
        who, codes, weights, size = _features(words)
        self.row = np.zeros(1 << CODE_BITS, np.int32)
        known = np.unique(codes)
        self.row[known] = np.arange(1, len(known) + 1)
        self.table = np.zeros((len(known) + 1, len(words)))
        np.add.at(self.table, (self.row[codes], who), weights)
        self.table /= np.sqrt((self.table**2).sum(0)) + 1e-12
        self.matrix = self.table.T @ self.table

    def values(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.words)), np.float32)
        for low in range(0, len(words), 20_000):
            who, codes, weights, size = _features(words[low : low + 20_000])
            row = self.row[codes]
            on = row > 0
            order = np.argsort(who[on], kind="stable")
            who, row, weights = who[on][order], row[on][order], weights[on][order]
            if len(who):
                head = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
                sums = np.add.reduceat(self.table[row] * weights[:, None], head)
                out[low + who[head]] = sums / _own_kernel(size[who[head]])[:, None]
        return out


@dataclass(frozen=True)
class Model:
    """One weight per subsequence, the machine's bias, the limits of a toxic word, and the logistic curve."""

    weights: np.ndarray
    bias: float
    limits: tuple[float, ...]
    curve: np.ndarray

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The machine's value of every word, and the number of its text."""
        points, offsets = characters(texts)
        starts, ends, owner = words_of(points, offsets)
        if not len(starts):
            return np.empty(0), owner
        sums = np.zeros(len(points) + 1)
        for at, code, weight in subsequences(points, starts, ends):
            sums[at] += self.weights[code] * weight
        value = np.add.reduceat(sums, np.c_[starts - 1, ends].ravel())[::2]
        return value / _own_kernel(ends - starts) + self.bias, owner

    def figures(self, texts: list[str]) -> np.ndarray:
        """Per text: one, the number of words, and by limit the number and density of toxic words."""
        value, owner = self.words(texts)
        n = len(texts)
        count = np.bincount(owner, minlength=n)
        out = [np.ones(n), np.log1p(count)]
        for limit in self.limits:
            hits = np.bincount(owner[value > limit], minlength=n)
            out += [np.log1p(hits), np.minimum(hits, 2), np.log1p(100 * hits / (1 + count))]
        return np.stack(out, axis=1)

    def scores(self, texts: list[str]) -> np.ndarray:
        return _logistic(self.figures(texts) @ self.curve) if len(texts) else np.empty(0)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = _logistic(x @ w)
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + 0.3 * np.eye(len(w)), x.T @ (y - p) - 0.3 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _apart(words: list[str]) -> list[str]:
    """The first words of which no two are alike, TOXIC_LANDMARKS at most."""
    if not words:
        return []
    alike, chosen = Landmarks(words).matrix, []
    for i in range(len(words)):
        if len(chosen) < TOXIC_LANDMARKS and (not chosen or alike[i, chosen].max() < ALIKE):
            chosen.append(i)
    return [words[i] for i in chosen]


def _groups(text: str) -> Iterator[list[str]]:
    """The sentences of a text, in runs of about GROUP_CHARS characters."""
    group, size = [], 0
    for sentence in re.split(r"[.!?\n]+", text):
        # A second blank before each: spaced-out letters don't run from one sentence into the next.
        group.append(" " + sentence)
        size += len(sentence) + 1
        if size >= GROUP_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def _sentences(group: list[str]) -> tuple[list[str], np.ndarray]:
    """All words of some sentences, and the places where a sentence begins; sentences without words are left out."""
    points, offsets = characters(group)
    starts, ends, owner = words_of(points, offsets)
    joined = points.astype(np.uint32).tobytes()
    words = [joined[4 * a : 4 * b].decode("utf-32-le") for a, b in zip(starts.tolist(), ends.tolist())]
    return words, np.flatnonzero(np.diff(owner, prepend=-1))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per word the number of clean and of toxic texts of a batch that hold it."""
    for batch in batches:
        seen = (Counter(), Counter())
        for text, y in zip(batch.column("t"), batch.column("y").to_pylist()):
            met: set[str] = set()
            for group in _groups(text.as_py()):
                met.update(_sentences(group)[0])
            seen[y].update(met)
        words = list(dict.fromkeys([*seen[0], *seen[1]]))
        counts = [pa.array([of[w] for w in words], pa.int64()) for of in seen]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *counts], names=["word", "clean", "toxic"])


def _landmark_values(land: Landmarks):
    """Arrow function: per run of sentences their strongest values to each landmark, as float32 in row order."""

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, known = {}, np.empty((0, len(land.words)), np.float32)
        for batch in batches:
            for owner, y, text in zip(*(batch.column(c) for c in ("owner", "y", "t"))):
                for part, group in enumerate(_groups(text.as_py())):
                    words, heads = _sentences(group)
                    if not words:
                        continue
                    if len(number) > KNOWN_WORDS:
                        number, known = {}, known[:0]
                    new = [w for w in dict.fromkeys(words) if w not in number]
                    number.update(zip(new, range(len(number), len(number) + len(new))))
                    known = np.concatenate([known, land.values(new)]) if new else known
                    at = np.fromiter((number[w] for w in words), np.int64, len(words))
                    z = np.maximum.reduceat(known[at], heads)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([owner.as_py()], pa.int64()), pa.array([part], pa.int64()),
                         pa.array([y.as_py()], pa.int32()), pa.array([z.tobytes()], pa.binary())],
                        names=["owner", "part", "y", "z"],
                    )

    return values


def _each(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, int, np.ndarray]]:
    for batch in batches:
        for owner, part, z in zip(*(batch.column(c) for c in ("owner", "part", "z"))):
            yield owner.as_py(), part.as_py(), np.frombuffer(z.as_buffer(), np.float32).reshape(-1, width)


def _two_best(sentences: DataFrame, score, width: int) -> np.ndarray:
    """Values of the two sentences of each toxic text that score highest; of equal ones the first."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for owner, part, z in _each(batches, width):
            own = score(z)
            at = np.argsort(-own, kind="stable")[:2]
            yield pa.RecordBatch.from_arrays(
                [pa.array([owner] * len(at), pa.int64()), pa.array([part] * len(at), pa.int64()),
                 pa.array(at.astype(np.int64)), pa.array(own[at].astype(float)), pa.array([z[i].tobytes() for i in at])],
                names=["owner", "part", "place", "score", "z"],
            )

    rows = sentences.where("y = 1").mapInArrow(best, "owner long, part long, place long, score double, z binary").collect()
    taken: Counter = Counter()
    out = []
    for r in sorted(rows, key=lambda r: (r.owner, -r.score, r.part, r.place)):
        taken[r.owner] += 1
        if taken[r.owner] <= 2:
            out.append(np.frombuffer(r.z, np.float32))
    return np.stack(out) if out else np.empty((0, width), np.float32)


def _active_sums(sentences: DataFrame, half: np.ndarray, w: np.ndarray):
    """Of the clean sentences within the margin: sums of products, sums, number, and a mark of which they are."""
    width = len(half)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, line, n, mark = np.zeros((width + 1, width + 1)), np.zeros(width + 1), 0, 0
        for _, _, z in _each(batches, width):
            x = np.c_[z @ half, np.ones(len(z))]
            active = -(x @ w) < 1
            mark = zlib.crc32(active.tobytes(), mark)
            x = x[active]
            products, line, n = products + x.T @ x, line + x.sum(0), n + len(x)
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([products.tobytes()]),
             pa.array([line.tobytes()]), pa.array([n], pa.int64()), pa.array([mark], pa.int64())],
            names=["task", "products", "line", "n", "mark"],
        )

    rows = sentences.where("y = 0").mapInArrow(sums, "task long, products binary, line binary, n long, mark long").collect()
    rows.sort(key=lambda r: r.task)
    products, line = np.zeros((width + 1, width + 1)), np.zeros(width + 1)
    for r in rows:
        products += np.frombuffer(r.products).reshape(width + 1, -1)
        line += np.frombuffer(r.line)
    return products, line, sum(r.n for r in rows), [(r.task, r.mark) for r in rows]


def _fit_machine(toxic: np.ndarray, sentences: DataFrame, half: np.ndarray, start, ridge: float = 1e-4) -> np.ndarray:
    """Newton steps on the squared hinge loss, both classes with equal weight; the last weight is the bias.

    Clean sentences stay in Spark, which sums them in each step; ``start`` holds their sums for weights of zero.
    """
    x = np.c_[toxic @ half, np.ones(len(toxic))]
    cost, clean_cost = 0.5 / max(1, len(x)), 0.5 / max(1, start[2])
    w, before = np.zeros(x.shape[1]), None
    for step in range(40):
        active = x @ w < 1
        products, line, _, mark = _active_sums(sentences, half, w) if step else start
        if before is not None and before[0] == mark and (before[1] == active).all():
            break
        before = mark, active
        part = x[active] * cost
        w = np.linalg.solve(
            part.T @ x[active] + clean_cost * products + ridge * np.eye(len(w)), part.sum(0) - clean_cost * line
        )
    return w


def _limits(words: DataFrame, land: Landmarks, per_landmark: np.ndarray, bias: float, n_clean: int) -> tuple[float, ...]:
    """Values of words that clean texts exceed CLEAN_HITS times each. A task sends its highest words only."""
    most = CLEAN_HITS[-1] * n_clean

    def highest(value: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank = np.argsort(-value, kind="stable")
        rank = rank[: int(np.searchsorted(np.cumsum(count[rank]), most)) + 1]
        use = (count[rank] > 0) | (np.arange(len(rank)) == len(rank) - 1)
        return value[rank][use], count[rank][use]

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, count = np.empty(0), np.empty(0, np.int64)
        for batch in batches:
            own = land.values(batch.column("word").to_pylist()) @ per_landmark + bias
            value, count = highest(np.r_[value, own], np.r_[count, batch.column("clean").to_numpy()])
        yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(count)], names=["value", "n"])

    rows = words.select("word", "clean").mapInArrow(top, "value double, n long").collect()
    value, count = np.array([r.value for r in rows]), np.array([r.n for r in rows])
    rank = np.argsort(-value, kind="stable")
    passed = np.cumsum(count[rank]) / n_clean
    return tuple(float(value[rank[min(int(np.searchsorted(passed, s)), len(rank) - 1)]]) for s in CLEAN_HITS)


def train(texts: DataFrame, n: tuple[int, int]) -> Model:
    """Fit on stored rows of ``owner``, ``t`` and ``y``, of which ``n`` are clean and toxic.

    Whole texts are read in tasks. The driver gets the landmarks, sums of sentences, the two best sentences of toxic
    texts, the words near the limits and the figures of each text.
    """
    prior = n[1] / sum(n) if sum(n) else 0.0
    flat = Model(np.zeros(1 << CODE_BITS, np.float32), 0.0, (), np.array([math.log((prior + 1e-3) / (1 - prior + 1e-3)), 0.0]))
    if not all(n):
        return flat
    words = texts.select("t", "y").mapInArrow(_word_counts, "word string, clean long, toxic long")
    words = checkpointed(words.groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    c, long_enough = F.col("toxic"), words.where(F.length("word") > 2)
    odds = c * F.log((c + 0.5) / F.lit(n[1]) * F.lit(n[0]) / (F.col("clean") + 0.5))
    toxic_words = long_enough.where((c > 0) & (odds > c * math.log(MIN_ODDS))).orderBy(odds.desc(), "word")
    marks = _apart([r.word for r in toxic_words.select("word").limit(16 * TOXIC_LANDMARKS).collect()])
    toxic_marks = len(marks)
    clean_words = long_enough.where("clean > 0").orderBy(F.col("clean").desc(), "word")
    marks += [r.word for r in clean_words.select("word").limit(CLEAN_LANDMARKS).collect()]
    if not marks:
        return flat
    land = Landmarks(list(dict.fromkeys(marks)))
    width = len(land.words)
    sentences = checkpointed(
        texts.mapInArrow(_landmark_values(land), "owner long, part long, y int, z binary")
    )
    root, vectors = np.linalg.eigh(land.matrix)
    half = (vectors / np.sqrt(np.maximum(root, 1e-2))) @ vectors.T
    w, start = np.zeros(width + 1), _active_sums(sentences, half, np.zeros(width + 1))
    for turn in range(ROUNDS):
        at = half @ w[:-1]
        best = _two_best(sentences, (lambda z, at=at: z @ at) if turn else (lambda z: z[:, :toxic_marks].max(1, initial=0)), width)
        w = _fit_machine(best, sentences, half, start)
    per_landmark, bias = half @ w[:-1], float(w[-1])
    weights = np.zeros(1 << CODE_BITS, np.float32)
    known = land.row > 0
    weights[known] = (land.table @ per_landmark)[land.row[known]]
    model = Model(weights, bias, _limits(words, land, per_landmark, bias, n[0]), flat.curve)
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in textops.slices(textops.flat(batch.column("t"))[1]):
                own = shared.value.figures(batch.column("t").slice(low, high - low).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(low, high - low) for c in ("owner", "y")] + [pa.array(list(own))],
                    names=["owner", "y", "x"],
                )

    rows = sorted(texts.mapInArrow(figures, "owner long, y int, x array<double>").collect())
    return replace(model, curve=_fit_curve(np.array([r.x for r in rows]), np.array([float(r.y) for r in rows])))


def held_out(doc_id: Column) -> Column:
    """Rows that never train: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
        per_class: int = PER_CLASS) -> Model:
    """Train on about ``per_class`` whole texts of each class at most, from rows that aren't held out.

    Rows that share an id are texts of their own; where they make it over four times as many rows, a sample of these trains.
    """
    known = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y"))
    known = known.where(F.col("y").isin(0, 1) & ~held_out(F.col("id")) & F.col("id").isNotNull())
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = F.pmod(F.xxhash64("id", F.lit("train")), F.lit(1_000_000))
    some = [
        known.where((F.col("y") == y) & (place < int(min(1.0, 1.5 * per_class / n) * 1_000_000))).limit(per_class)
        for y, n in sorted(counts.items())
    ]
    if not some:
        return train(docs, (0, 0))
    picked = checkpointed(some[0].unionAll(some[-1]) if len(some) > 1 else some[0])
    body = F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t")
    # At most 2 * per_class rows of ids are broadcast.
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), body).join(F.broadcast(picked), "id")
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("t")).alias("size")).first()
    share = min(1.0, 4 * per_class / max(found.n, 1))
    rows = rows.sample(share, seed=7) if share < 1 else rows
    parts = int(min(MOST_PARTS, max(LEAST_PARTS, (found.size or 0) * share // PART_BYTES)))
    rows = rows.repartition(parts).select(F.monotonically_increasing_id().alias("owner"), "t", "y")
    rows = checkpointed(rows)
    n = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    return train(rows, (n.get(0, 0), n.get(1, 0)))


def scored(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, ``held_out``, ``score``, ``predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), held_out(F.col(f"`{doc_id}`")).alias("held_out"),
                       F.col(f"`{text}`").alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            values = [np.empty(0)]
            texts = batch.column("text")
            for low, high in textops.slices(textops.flat(texts)[1]):
                values.append(own.scores([t or "" for t in texts.slice(low, high - low).to_pylist()]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held_out"), pa.array(np.concatenate(values), pa.float64())],
                names=["id", "held_out", "score"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    return rows.mapInArrow(score, f"id {kind}, held_out boolean, score double").select(
        F.col("id").alias(doc_id), "held_out", "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted")
    )
