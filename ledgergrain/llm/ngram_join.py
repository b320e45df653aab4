"""N-gram Jaccard join with prefix trees: which texts share at least 80 % of their word 5-grams, as components.

A text's set holds the distinct runs of ``width`` words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased); a text with fewer
words has its whole sequence as the one member; one without words has none and links with nothing. Two texts link
when ``100 * |A and B| >= threshold * |A or B|``. The join is exact:

1. Every n-gram of the corpus is counted (``repeats``); the global order puts n-grams of few blocks first, by doubling
   classes, and then goes by hash. Partners share at least ``threshold`` per cent of a set, so
   a text with fewer n-grams that occur elsewhere has no partner and leaves. Equal sets become one class.
2. Classes that agree in a min-hash meet in groups; each group stores its globally ordered sets in a prefix tree.
   A set walks the tree once: overlaps of a shared path are counted once, and a subtree is left as soon as the overlap
   so far and the lengths that remain can't reach the limit. Sets that are in one component already aren't compared,
   nor those whose rows of bits bound the overlap below the limit.
   This finds nearly all links, in groups of bounded size.
3. What may be missing: if two classes link, they share one of their first ``m - need + 1`` shared n-grams in the
   global order (the prefix filter). An n-gram whose classes all lie in one component is settled. The classes of every
   other one meet in prefix trees again, by pairs of pieces of bounded size, so no link is lost. N-grams that have
   just the same classes are asked once. Those of many near copies that don't link have nearly the same ones: they are
   asked together by their least class, where that makes fewer pairs.

No group emits all its pairs: classes already connected are skipped, and links leave a group as a spanning forest.
Texts of any length are read whole, each in one task, with some fifty bytes of work memory a byte. Null and empty texts
have no words. Rows that share an id count as one document. Rows without id get no component and take no
part as partners. Repeated rows are copies of each other. Other columns are ignored. An empty table gives none.
n-grams and sets are compared by hashes of 60 and 128 bits.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgergrain.llm import repeats, textops
from ledgergrain.llm.components import components, stored

WIDTH = 5
THRESHOLD = 80
PIECE = 256
#: Most places of a set's row of bits, a power of two of 64 at least. A row has 32 to 64 times as many as the longest set
#: of its group has members, if no more than these.
BITS = 1 << 16
SEEDS = (0x1B873593A5A5A5A5, 0x2545F4914F6CDD1D)
#: Bits of an n-gram's hash that are counted over the corpus. Two n-grams that agree in them count as one that occurs
#: twice, which only keeps a text in the running; links are decided on 60 bits.
COUNTED = np.uint64(0xFFFFFFFFFFFF0000)


def _sets(column, width: int):
    """Owner and n-gram hash of all set members, ordered by owner and hash."""
    data, offsets = textops.flat(column)
    owners, members = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for low, high in textops.slices(offsets):
        cut = offsets[low : high + 1]
        part, cut = textops.lower(data[cut[0] : cut[-1]]), cut - cut[0]
        starts, ends, owner = textops.spans(part, cut)
        words = textops.run_hashes(part, starts, ends)
        at, grams = textops.window_hashes(words, owner, width)
        count = np.bincount(owner, minlength=high - low)
        short = np.flatnonzero((count > 0) & (count < width))
        first = (np.cumsum(count) - count)[short]
        sums = textops.running(words, textops.WORD_BASE)
        whole = (sums[first + count[short]] - sums[first]) * textops.powers(textops.WORD_BASE, len(words) + 1)[0][first]
        who = np.r_[owner[at], short]
        what = np.r_[grams, textops.mix(textops.mix(whole) + count[short].astype(np.uint64))]
        order = np.lexsort((what, who))
        who, what = who[order], what[order]
        new = np.ones(len(who), bool)
        new[1:] = (who[1:] != who[:-1]) | (what[1:] != what[:-1])
        owners.append(who[new] + low)
        members.append(what[new])
    return np.concatenate(owners), np.concatenate(members)


def _keys(text: str, width: int):
    return lambda table, _: _sets(table.column(text), width)[1] & COUNTED


_ROWS = "id long, n long, live boolean, f1 long, f2 long, tokens binary, " + ", ".join(
    f"k{i} long" for i in range(len(SEEDS))
)


def _profile(doc_id: str, text: str, width: int, threshold: int, bits: int):
    """Per text: set size, and for possible partners the set's fingerprint, shared members and min-hashes."""

    def profile(table: pa.Table, answers: pa.Table) -> pa.Table:
        rows = table.num_rows
        owner, grams = _sets(table.column(text), width)
        twice, steps = repeats.spread(grams & COUNTED, answers, bits)
        n = np.bincount(owner, minlength=rows)
        named = np.asarray(table.column(doc_id).is_valid())
        shared = np.bincount(owner[twice], minlength=rows)
        live = (n > 0) & (100 * shared >= threshold * n) & named
        heads = np.flatnonzero(live)
        keep = live[owner]
        o, g, steps = owner[keep], grams[keep], steps[keep].astype(np.uint64)
        marks = np.zeros((2 + len(SEEDS), rows), np.uint64)
        tokens: list[bytes | None] = [None] * rows
        if len(heads):
            cut = np.searchsorted(o, heads)
            marks[0, heads] = np.add.reduceat(textops.mix(g ^ np.uint64(SEEDS[0])), cut)
            marks[1, heads] = np.bitwise_xor.reduceat(textops.mix(g + np.uint64(SEEDS[1])), cut)
            often = twice[keep]
            o, g = o[often], steps[often] << np.uint64(60) | g[often] >> np.uint64(4)
            order = np.lexsort((g, o))  # rare n-grams come first
            o, g = o[order], g[order]
            cut = np.searchsorted(o, heads)
            for i, seed in enumerate(SEEDS):
                marks[2 + i, heads] = np.minimum.reduceat(textops.mix(g ^ np.uint64(seed)), cut)
            met = set()
            for row, a, b in zip(heads.tolist(), cut.tolist(), [*cut[1:].tolist(), len(g)]):
                if (face := (int(n[row]), int(marks[0, row]), int(marks[1, row]))) not in met:
                    met.add(face)
                    tokens[row] = g[a:b].astype(">u8").tobytes()
        columns = {"id": table.column(doc_id).cast(pa.int64()), "n": pa.array(n, pa.int64()), "live": pa.array(live)}
        for i, name in enumerate(["f1", "f2"]):
            columns[name] = pa.array(marks[i].view(np.int64), pa.int64())
        columns["tokens"] = pa.array(tokens, pa.binary())
        for i in range(len(SEEDS)):
            columns[f"k{i}"] = pa.array(marks[2 + i].view(np.int64), pa.int64())
        return pa.table(columns)

    return profile


class Tree:
    """A prefix tree over ordered sets: the sets in the order of their sequences, with the lengths of shared paths."""

    def __init__(self, tokens: list[bytes], sizes: np.ndarray, labels: np.ndarray, threshold: int):
        self.order = sorted(range(len(tokens)), key=tokens.__getitem__)
        self.sets = [np.frombuffer(tokens[i], ">u8").astype(np.uint64) for i in self.order]
        self.sizes, self.labels = sizes[self.order], labels[self.order]
        self.threshold = threshold
        self.longest = max(map(len, self.sets), default=0)
        self.path = np.zeros(len(self.sets), np.int64)
        for i in range(1, len(self.sets)):
            a, b = self.sets[i - 1], self.sets[i]
            k = min(len(a), len(b))
            off = np.flatnonzero(a[:k] != b[:k])
            self.path[i] = off[0] if len(off) else k
        self._map()

    def _map(self) -> None:
        """A row of bits per set, with a place for each member by the last bits of its hash."""
        width = min(BITS, max(64, 32 << self.longest.bit_length()))
        self.bits = np.zeros((len(self.sets), width // 64), np.uint64)
        self.folded = np.zeros(len(self.sets), np.int64)
        for i, own in enumerate(self.sets):
            row = np.zeros(width, bool)
            row[own & np.uint64(width - 1)] = True
            self.bits[i] = np.packbits(row).view(np.uint64)
            self.folded[i] = len(own) - np.count_nonzero(row)

    def _most(self, i: int, others: np.ndarray) -> np.ndarray:
        """Bounds of the overlaps: common bits, and members that share a bit with one of the same set."""
        both = np.bitwise_count(self.bits[others] & self.bits[i]).sum(axis=1, dtype=np.int64)
        return both + np.minimum(self.folded[others], self.folded[i])

    def links(self, side: np.ndarray | None = None) -> list[tuple[int, int]]:
        """A spanning forest of the links between components; with sides, only between different ones."""
        found = []
        for i in range(len(self.sets)):
            n = self.sizes[i]
            others = self.labels[i + 1 :] != self.labels[i]
            others &= (100 * self.sizes[i + 1 :] >= self.threshold * n) & (100 * n >= self.threshold * self.sizes[i + 1 :])
            if side is not None:
                others &= side[self.order[i + 1 :]] != side[self.order[i]]
            others = np.flatnonzero(others) + i + 1
            if len(others):
                most = self._most(i, others)
                others = others[100 * most >= self.threshold * (n + self.sizes[others] - most)]
            if len(others):
                found += self._walk(i, others)
        return [(self.order[i], self.order[j]) for i, j in found]

    def _walk(self, i: int, others: np.ndarray) -> list[tuple[int, int]]:
        own, n, t = self.sets[i], int(self.sizes[i]), self.threshold
        smallest = -(-t * n // 100)
        least = -(-t * (n + smallest) // (100 + t))  # overlap that the shortest partner needs
        found, at, dead = [], i, None
        overlap, passed = np.arange(len(own) + 1), np.arange(len(own) + 1)
        for j in others.tolist():
            if self.labels[j] == self.labels[i]:
                continue
            depth = int(self.path[at + 1 : j + 1].min())
            if dead is not None and depth >= dead:
                continue
            rest = self.sets[j][depth:]
            place = np.searchsorted(own, rest)
            hit = own[np.minimum(place, len(own) - 1)] == rest
            overlap = np.r_[overlap[: depth + 1], overlap[depth] + np.cumsum(hit)]
            passed = np.r_[passed[: depth + 1], place + hit]
            bound = overlap + np.minimum(self.longest - np.arange(len(overlap)), len(own) - passed)
            low = np.flatnonzero(bound < least)
            dead = int(low[0]) if len(low) else None
            at = j
            both = int(overlap[-1])
            if 100 * both >= t * (n + int(self.sizes[j]) - both):
                found.append((i, j))
                self.labels[self.labels == self.labels[j]] = self.labels[i]
        return found


def _links(threshold: int):
    def link(table: pa.Table) -> pa.Table:
        ids, sizes, labels = (np.asarray(table.column(c)) for c in ("cls", "n", "comp"))
        side = np.asarray(table.column("side"))
        tree = Tree(table.column("tokens").to_pylist(), sizes, labels.copy(), threshold)
        pairs = tree.links(side if table.column("apart")[0].as_py() else None)
        a, b = np.array([x for x, _ in pairs], np.int64), np.array([y for _, y in pairs], np.int64)
        return pa.table({"a": pa.array(ids[a], pa.int64()), "b": pa.array(ids[b], pa.int64())})

    return link


def _first(threshold: int):
    """The n-grams of a class of which every partner shares one."""

    def first(batches):
        for batch in batches:
            ids, sizes = batch.column("cls").to_pylist(), batch.column("n").to_pylist()
            keys, counts = [np.empty(0, np.int64)], []
            for n, tokens in zip(sizes, batch.column("tokens").to_pylist()):
                own = np.frombuffer(tokens, ">u8").astype(np.uint64).view(np.int64)
                part = own[: len(own) - -(-threshold * n // 100) + 1]
                keys.append(part)
                counts.append(len(part))
            columns = [np.concatenate(keys), *(np.repeat(np.array(x, np.int64), counts) for x in (ids, sizes))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["key", "cls", "n"])

    return first


def _meetings(first: DataFrame) -> DataFrame:
    """Where the classes of contested n-grams meet: ``cls`` and ``comp`` with a group (``key``, ``band``, ``x``, ``y``).

    ``first`` has ``key``, ``band``, ``cls`` and ``comp``. Any two classes of different components that share a key and
    band meet in a group, on different sides if its pieces ``x`` and ``y`` are different ones.
    """
    face = F.xxhash64("cls")
    # N-grams with the same classes ask the same question: one of them is enough.
    open_keys = (
        first.groupBy("key", "band").agg(
            F.count(F.lit(1)).alias("c"), F.min("comp").alias("low"), F.max("comp").alias("high"),
            F.min(face).alias("star"), F.bit_xor(face).alias("x"), F.sum(F.shiftright(face, 16)).alias("s"),
        )
        .where("low < high").groupBy("c", "star", "x", "s").agg(F.min(F.struct("key", "band")).alias("k"))
        .select("k.key", "k.band", "c", "star")
    )
    asked = stored(first.join(open_keys, ["key", "band"]).select("cls", "comp", "key", "band", "c", "star"), "contested")
    # N-grams with nearly the same classes mostly have the same least class by hash. They ask together, unless their
    # classes have more pairs together than n-gram by n-gram.
    together = asked.groupBy("star", "cls", "comp").agg(F.sum("c").alias("met"))
    gain = together.groupBy("star").agg(F.count(F.lit(1)).alias("held"), F.sum("met").alias("met")).where("held * held <= met")
    gain = stored(gain.select("star", F.col("held").alias("c")), "together")
    groups = together.join(gain, "star").select("cls", "comp", F.col("star").alias("key"), F.lit(-1).cast("long").alias("band"), "c")
    single = asked.join(gain, "star", "left_anti").select("cls", "comp", "key", "band", "c")
    pieces = F.ceil(F.col("c") / PIECE)
    dealt = groups.union(single).withColumn("side", F.pmod(face, pieces)).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1))
    )
    return dealt.select(
        "cls", "comp", "side", "key", "band", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y")
    )


def joined(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, threshold: int = THRESHOLD,
    **sizes: int,
) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_shingles`` and ``component_id``, the smallest id reachable by links.

    ``sizes`` are those of ``repeats.blocked``.
    """
    docs = docs.select(F.col(f"`{doc_id}`").alias(doc_id), F.col(f"`{text}`").alias(text))
    blocks = repeats.blocked(docs, text, keys_per_byte=0.2, **sizes)
    answers = repeats.shared(blocks, _keys(text, width), counted=True)
    rows = stored(repeats.applied(blocks, answers, _profile(doc_id, text, width, threshold, blocks.bits), _ROWS), "sets")
    classes = stored(
        rows.where("live").groupBy("n", "f1", "f2").agg(
            F.min("id").alias("cls"),
            *[F.first(c, ignorenulls=True).alias(c) for c in ("tokens", *(f"k{i}" for i in range(len(SEEDS))))],
        ),
        "classes",
    )
    sets = classes.select("cls", "n", "tokens")

    # Groups by min-hash, in pieces; the first class of a group joins every piece.
    keys = classes.select("cls", F.explode(F.array_distinct(F.array(*[f"k{i}" for i in range(len(SEEDS))]))).alias("key"))
    groups = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("cls").alias("hub")).where("c > 1")
    pieces = F.ceil(F.col("c") / PIECE)
    own = F.array(F.pmod(F.xxhash64("cls"), pieces))
    every = F.sequence(F.lit(0).cast("long"), pieces - 1)
    members = keys.join(groups, "key").select(
        "cls", "key", F.explode(F.when(F.col("cls") == F.col("hub"), every).otherwise(own)).alias("piece")
    )
    meeting = members.join(sets, "cls").select(
        "*", F.col("cls").alias("comp"), F.lit(0).cast("long").alias("side"), F.lit(False).alias("apart")
    )
    near = stored(meeting.groupBy("key", "piece").applyInArrow(_links(threshold), "a long, b long"), "near")
    known = components(near)

    # Prefix filter: n-grams whose classes lie in several components.
    # Partners' sizes lie within the threshold, so they are in one band of sizes or in two neighbouring ones.
    band = F.floor(F.log("n") * (0.999999 / math.log(max(100 / threshold, 1.01))))
    first = (
        sets.mapInArrow(_first(threshold), "key long, cls long, n long")
        .join(known.withColumnRenamed("node", "cls"), "cls", "left")
        .select("key", "cls", F.coalesce("component", "cls").alias("comp"), F.explode(F.array(band, band + 1)).alias("band"))
    )
    first = stored(first, "prefixes")
    pairs = _meetings(first)
    rest = pairs.join(sets, "cls").withColumn("apart", F.col("x") != F.col("y"))
    more = rest.groupBy("key", "band", "x", "y").applyInArrow(_links(threshold), "a long, b long")
    final = components(near.union(more))

    named = classes.select("n", "f1", "f2", "cls").join(final.withColumnRenamed("node", "cls"), "cls", "left")
    linked = rows.where("live").join(named, ["n", "f1", "f2"], "left")
    shown = [F.col("id").alias(doc_id), F.col("n").alias("n_shingles")]
    alone = rows.where(~F.col("live")).select(*shown, F.col("id").alias("component_id"))
    return linked.select(*shown, F.coalesce("component", "cls").alias("component_id")).union(alone)
