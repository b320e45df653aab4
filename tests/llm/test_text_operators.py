"""Every operator against a brute-force version, over nulls, empty and long texts, ties, copies and empty tables."""

from __future__ import annotations

import base64
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from ledgergrain.llm import (  # noqa: E402
    bpe,
    kd_shards,
    mixing,
    ngram_join,
    quality_rules,
    substring_dedup,
    suffix_dedup,
    topk,
    toxicity,
    weak_quality,
)

from text_fixtures import docs, frame, lone_docs, no_docs, prose  # noqa: E402, F401

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def table(df):
    return [r.asDict() for r in df.collect()]


def figures(text):
    w = WORDS(text or "")
    wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count, inside = Counter(wins), set()
    for i, x in enumerate(wins):
        if count[x] > 1:
            inside.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if WORDS(x)]
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(inside)


def test_quality_rules(docs, no_docs, lone_docs):
    cascade = quality_rules.Cascade.fit(docs)
    assert {r.name for r in cascade.rules} == {r.name for r in quality_rules.RULES}
    rows = table(quality_rules.judged(docs, cascade))
    for r in rows:
        want = figures(r["text"])
        assert tuple(r[c] for c in quality_rules.BASE) == want, r["doc_id"]
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["kept"] and r["base_failed"])
    # Ordered by rejections per cost among what is left: b rejects most per second, then a, as c rejects nothing new.
    named = tuple(quality_rules.Rule(n, None) for n in "abc")
    order = quality_rules._ordered(named, {0: 1.0, 1: 1.0, 2: 0.9}, {0b110: 50, 0b010: 10, 0b001: 40, 0: 900})
    assert [r.name for r in order] == ["b", "a", "c"]
    backwards = quality_rules.Cascade(tuple(reversed(quality_rules.RULES)))
    kept = {r["doc_id"] for r in rows if r["kept"]}
    assert {r.doc_id for r in quality_rules.filtered(docs, backwards).collect()} == kept and len(kept) > 20
    assert quality_rules.filtered(docs, cascade).columns == docs.columns
    assert quality_rules.Cascade.fit(no_docs).rules == quality_rules.RULES
    assert quality_rules.judged(no_docs, cascade).count() == 0
    assert not any(r.kept for r in quality_rules.judged(lone_docs, cascade).collect())


def repeated_words(texts, width):
    count = Counter(tuple(w[i : i + width]) for w in texts for i in range(len(w) - width + 1))
    for w in texts:
        gone = set()
        for i in range(len(w) - width + 1):
            if count[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        yield w, gone


#: Some fifty blocks and prefixes for the fixture's texts, in place of one.
MANY_BLOCKS = {"block_bytes": 3 << 10, "group_keys": 1 << 9}


@pytest.mark.parametrize("width,sizes", [(35, {}), (3, {}), (35, MANY_BLOCKS), (3, MANY_BLOCKS)])
def test_substring_dedup(docs, no_docs, lone_docs, width, sizes):
    for df in (docs, lone_docs, no_docs):
        rows = table(df)
        want = Counter()
        for r, (w, gone) in zip(rows, repeated_words([WORDS(r["text"] or "") for r in rows], width)):
            want[(r["doc_id"], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))] += 1
        out = substring_dedup.remove_repeats(df, width=width, **sizes)
        assert out.columns == [*df.columns, "n_words", "n_removed"]
        assert Counter(out.select("doc_id", "n_words", "n_removed", "text").collect()) == want
    assert sum(k[2] for k in want) == 0


@pytest.mark.parametrize("width,gram,sizes", [
    (400, 100, {}), (30, 10, {}), (25, 10, {}), (12, 12, {}), (400, 100, MANY_BLOCKS), (90, 10, MANY_BLOCKS),
])
def test_suffix_dedup(docs, no_docs, lone_docs, width, gram, sizes):
    for df in (docs, lone_docs, no_docs) if width == 30 else (docs,):
        rows = table(df)
        texts = [(r["text"] or "").encode() for r in rows]
        count = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
        want = Counter()
        for r, t in zip(rows, texts):
            gone = np.zeros(len(t) + 1, bool)
            for i in range(len(t) - width + 1):
                if count[t[i : i + width]] > 1:
                    gone[i : i + width] = True
            kept = bytes(b for b, x in zip(t, gone) if not x)
            runs = int((np.diff(np.r_[False, gone].astype(int)) == 1).sum())
            want[(r["doc_id"], len(t), int(gone.sum()), runs, kept)] += 1
        out = suffix_dedup.remove_repeats(df, width=width, gram=gram, **sizes)
        got = Counter((*r[:4], bytes(r[4])) for r in out.select("doc_id", *suffix_dedup.COUNTS, "kept").collect())
        assert got == want


def shingles(text):
    w = WORDS(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def linked(rows, threshold=80):
    sets, root = [(r["doc_id"], shingles(r["text"])) for r in rows], {r["doc_id"]: r["doc_id"] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= threshold * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {(a, len(x), find(a)) for a, x in sets}


@pytest.mark.parametrize("threshold,piece", [(80, 256), (50, 2), (100, 256)])
def test_ngram_join(spark, docs, no_docs, lone_docs, threshold, piece, monkeypatch):
    monkeypatch.setattr(ngram_join, "PIECE", piece)
    rng = random.Random(9)
    base = prose(rng, 120).split(" ")
    chain = []
    for _ in range(25):  # neighbours are alike, the ends are not
        base = list(base)
        for _ in range(3):
            base[rng.randrange(len(base))] = prose(rng, 1)
        chain.append(" ".join(base))
    df = docs.unionByName(frame(spark, chain, 1000))
    sizes = MANY_BLOCKS if threshold == 50 else {}
    got = {tuple(r) for r in ngram_join.joined(df, threshold=threshold, **sizes).collect()}
    assert got == linked(table(df), threshold)
    if threshold == 80:
        assert ngram_join.joined(no_docs).count() == 0
        rows = ngram_join.joined(lone_docs).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in rows) == Counter(
            {(None, 0, None): 2, (None, 1, None): 2, (7, 1, 7): 2}
        )


@pytest.mark.parametrize("piece", [256, 7])
def test_ngram_join_asks_nearly_equal_classes_together(spark, piece, monkeypatch):
    monkeypatch.setattr(ngram_join, "PIECE", piece)
    rng = random.Random(3)
    keys = {k: [c for c in range(40) if rng.random() < 0.95] for k in range(60)}  # a family of copies that don't link
    keys |= {100 + k: rng.sample(range(40, 60), 3) for k in range(20)}
    keys |= {200: [*range(60, 70)], 201: [60, *range(80, 90)], 202: [60, *range(70, 80)], 300: [95, 96]}
    comp = {c: c for own in keys.values() for c in own} | {96: 95}
    rows = [(k, k % 2, c, comp[c]) for k, own in keys.items() for c in own]
    first = spark.createDataFrame(rows, "key long, band long, cls long, comp long")
    groups = defaultdict(lambda: defaultdict(list))
    for r in ngram_join._meetings(first).collect():
        groups[r.key, r.band, r.x, r.y][r.side].append(r.cls)
    met = Counter()
    for (_, _, x, y), sides in groups.items():
        left, right = sides[x], sides[y]
        pairs = [(a, b) for a in left for b in right if x != y or a < b]
        met.update(tuple(sorted(p)) for p in pairs)
    asked = {(a, b) for own in keys.values() for a in own for b in own if a < b and comp[a] != comp[b]}
    assert asked <= set(met)
    family = sum(n for (a, b), n in met.items() if b < 40)
    assert family < 8 * 40 * 39 / 2  # n-gram by n-gram it is some 54 times as many pairs
    assert met.total() <= sum(len(own) ** 2 for own in keys.values())


@pytest.mark.parametrize("bits", [1 << 16, 128])
def test_ngram_join_bits_spare_walks(bits, monkeypatch):
    monkeypatch.setattr(ngram_join, "BITS", bits)
    rng, walked = random.Random(4), []
    sets = []
    for _ in range(60):  # copies of a base of which few link
        gone, more = rng.sample(range(100), rng.randrange(5, 25)), rng.randrange(5)
        sets.append(sorted({*range(100)} - {*gone} | {1000 + x for x in rng.sample(range(30), more)}))
    walk = ngram_join.Tree._walk
    monkeypatch.setattr(ngram_join.Tree, "_walk", lambda t, i, others: walked.extend(others) or walk(t, i, others))
    tokens = [np.array(x, ">u8").tobytes() for x in sets]
    tree = ngram_join.Tree(tokens, np.array([len(x) for x in sets]), np.arange(len(sets)), 80)
    root = {i: i for i in range(len(sets))}
    for a, b in tree.links():
        root = {k: min(root[a], root[b]) if v in (root[a], root[b]) else v for k, v in root.items()}
    want = {i: i for i in range(len(sets))}
    alike = 0
    for b, y in enumerate(sets):
        for a, x in enumerate(sets[:b]):
            both = len({*x} & {*y})
            if 100 * both >= 80 * (len(x) + len(y) - both):
                alike += 1
                want = {k: min(want[a], want[b]) if v in (want[a], want[b]) else v for k, v in want.items()}
    assert root == want
    if bits > 128:
        assert len(walked) <= alike < 60 * 59 / 4


def test_ngram_join_family_that_hardly_links(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PIECE", 5)
    rng, texts = random.Random(6), []
    base = prose(rng, 150).split(" ")
    for i in range(45):
        own = list(base)
        for place in rng.sample(range(len(base)), rng.choice([1, 2, 3, 5, 6, 7, 8])):
            own[place] = f"w{i}x{place}" if rng.random() < 0.5 else rng.choice(base)
        texts.append(" ".join(own))
    df = frame(spark, texts)
    got = {tuple(r) for r in ngram_join.joined(df).collect()}
    assert got == linked(table(df))
    assert 5 < len({c for _, _, c in got}) < 45


def test_kd_shards(spark, docs, no_docs, lone_docs):
    many = frame(spark, [f"text number {i} " * (i % 7 + 1) for i in range(3000)] + ["a hot text"] * 1500)
    for df in (many, docs, lone_docs):
        rows = kd_shards.shards(df).collect()
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
            (r["doc_id"], len(t) + 1, zlib.crc32(t))
            for r in table(df)
            for t in [(r["text"] or "").encode()]
        )
        slots, size = defaultdict(list), Counter()
        for r in rows:
            slots[r.shard].append(r.slot)
            size[r.shard] += r.size
            assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 8
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        if df is many:
            assert max(size.values()) < 1.03 * min(size.values()) and len(size) == 8
    assert kd_shards.shards(no_docs).count() == 0


def test_kd_shards_by_three(spark):
    df = frame(spark, [f"row {i}" for i in range(1000)])
    size = Counter()
    for r in kd_shards.shards(df, n_shards=3).collect():
        size[r.shard] += r.size
    assert len(size) == 3 and max(size.values()) < 1.05 * min(size.values())


@pytest.mark.parametrize("cells", [None, 300])
def test_topk(spark, cells, monkeypatch):
    if cells:  # dozens of chunks and groups
        for name in ("CHUNK_CELLS", "GROUP_CELLS", "LEAST_ROWS"):
            monkeypatch.setattr(topk, name, cells if name == "CHUNK_CELLS" else 100)
    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(0, 0.2, 40).astype("float32").tolist()) for i in range(400)]
    vectors += [(400 + i, vectors[i][1]) for i in range(30)]  # ties
    vectors += [(500, None), (501, [1.0, None]), (502, [float("nan")] * 40), (503, [float("inf")] * 40), (504, [])]
    vectors += [(505, [0.5, 0.25]), (550, [1.0, -1.0]), (None, [1.0] * 40), (600, [3e4] * 40), (50, vectors[50][1])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x"))
    got = [tuple(r) for r in topk.search(df.repartition(4), F.col("vec_id") % 50 == 0).collect()]
    good = [(i, np.floor(np.array(v, float) * 256)) for i, v in vectors if i is not None and v and None not in v]
    good = [(i, v) for i, v in good if np.isfinite(v).all()]
    want = []
    for q in sorted({i for i, _ in good if i % 50 == 0}):
        own = next(v for i, v in good if i == q)
        scores = sorted((-int(own @ v), i) for i, v in good if i != q and len(v) == len(own))
        want += [(q, k, i, -s) for k, (s, i) in enumerate(scores[:5], 1)]
    assert sorted(got) == sorted(want)
    assert topk.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_byte_bpe(docs, no_docs, lone_docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    for df in (docs, lone_docs, no_docs):
        ids = bpe.encode(df, RANKS, PATTERN)
        assert ids.columns == [*df.columns, "n_tokens", "token_ids"]
        for r in bpe.decode(ids, RANKS).collect():
            want = own.encode_ordinary(r.text or "")
            assert np.frombuffer(r.token_ids, "<u4").tolist() == want and r.n_tokens == len(want)
            assert bytes(r.decoded) == (r.text or "").encode()


def test_long_pieces_merge_alike():
    encoder = bpe.Encoder(open(RANKS, "rb").read(), PATTERN)
    for piece in (b"thetionererinhe" * 9, b"abcabdabe" * 30, "éßñ日本".encode() * 20):
        matrix = np.frombuffer(encoder.merge([piece], 512)[0], "<u4").tolist()
        assert matrix == encoder.long(piece)


def test_shares_go_to_siblings_before_ancestors():
    leaves = {("a", "x"): 10, ("a", "y"): 200, ("b", "x"): 100, ("b", "y"): 100}
    got = mixing.allotted(leaves, {}, 200, 1)
    assert got == {("a", "x"): 10, ("a", "y"): 90, ("b", "x"): 50, ("b", "y"): 50}
    got = mixing.allotted({**leaves, ("a", "y"): 40}, {}, 200, 1)
    assert got == {("a", "x"): 10, ("a", "y"): 40, ("b", "x"): 75, ("b", "y"): 75}
    got = mixing.allotted(leaves, {("a",): 3.0, ("b",): 1.0}, 100, 1)
    assert sum(got.values()) == 100 and got["a", "x"] == 10 and got["a", "y"] == 65
    assert sum(mixing.allotted(leaves, {}, 10**6, 2).values()) == 2 * 410
    assert mixing.allotted({}, {}, 5, 1) == {}


def test_mixing(docs, no_docs, lone_docs):
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    weights, epochs = {("en",): 8.0, ("de",): 1.0}, 3
    for df in (docs, lone_docs):
        share = 0.7
        rows = table(df.withColumn("f", F.xxhash64("doc_id", "text")))
        leaf, words = (lambda r: (r["lang"] or "", r["source"] or "")), Counter()
        for r in rows:
            words[leaf(r)] += len(WORDS(r["text"] or ""))
        goal = mixing.allotted(dict(words), weights, int(share * sum(words.values())), epochs)
        want = Counter()
        for path, tokens in words.items():
            full, rest = divmod(goal[path], tokens) if tokens else (0, 0)
            own = [r for r in rows if leaf(r) == path]
            for r in own:
                want.update((r["doc_id"], r["text"], e) for e in range(full))
            if rest:
                place = df.sparkSession.createDataFrame([(r["f"],) for r in own], "f long")
                at = {x.f: x.u for x in place.select("f", mixing._place(F.col("f"), 17, F.lit(full)).alias("u")).collect()}
                run = Counter()
                for r in own:
                    run[at[r["f"]]] += len(WORDS(r["text"] or ""))
                ends = dict(zip(sorted(run), np.cumsum([run[u] for u in sorted(run)])))
                want.update((r["doc_id"], r["text"], full) for r in own if ends[at[r["f"]]] <= rest)
        out = mixing.mixed(df, levels, weights, share, epochs)
        assert Counter((r.doc_id, r.text, r.epoch) for r in out.collect()) == want
        assert out.agg(F.sum("n_words")).first()[0] <= share * sum(words.values())
    assert mixing.mixed(no_docs, levels, weights, 0.5).count() == 0


def test_toxicity(spark, docs, no_docs, lone_docs):
    rng = random.Random(5)
    texts, toxic = [], []
    for i in range(240):
        words = prose(rng, 60).split(" ")
        if i % 3 == 0:
            for w in rng.sample(["stupid", "moron", "worthless", "clownish"], 3):
                words[rng.randrange(60)] = w
        texts.append(" ".join(words))
        toxic.append(int(i % 3 == 0))
    df = frame(spark, texts)
    labels = spark.createDataFrame(
        [*[(i + 1, t) for i, t in enumerate(toxic)], (None, 1), (5000, None)], "doc_id long, toxic int"
    )
    model = toxicity.fit(df, labels)
    rows = {r.doc_id: r for r in toxicity.scored(df, model).collect()}
    held = [r for r in rows.values() if r.held_out]
    assert len(held) > 50 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in held)
    assert np.mean([r.predicted == toxic[r.doc_id - 1] for r in held]) > 0.95
    base = prose(rng, 40)
    clean, spaced, starred, longer = model.scores(
        [base, f"{base} m.o.r.o.n {base[:40]} s t u p i d", f"{base} mo*ron stu-pid", f"{base} moronic stuppid"]
    )
    assert clean < 0.3 and min(spaced, starred, longer) > 0.5
    for other in (docs, lone_docs):
        got = toxicity.scored(other, model).collect()
        assert len(got) == other.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.scored(no_docs, model).count() == 0
    none = toxicity.fit(df, labels.limit(0))
    assert {round(r.score, 6) for r in toxicity.scored(df, none).collect()} == {round(1e-3 / 1.002, 6)}


def test_toxicity_learns_from_the_end_of_long_texts(spark):
    rng = random.Random(6)
    vocabulary = prose(rng, 200).split(" ")
    texts, toxic = [], []
    for i in range(90):
        words = [f"{rng.choice(vocabulary)}{'.' * (k % 15 == 14)}" for k in range(6000)]
        assert len(" ".join(words[:5900])) > 20_000
        if i % 3 == 0:
            for w in rng.sample(["stupid", "moron", "worthless", "clownish"], 3):
                words[rng.randrange(5900, 6000)] = w
        texts.append(" ".join(words))
        toxic.append(int(i % 3 == 0))
    df = frame(spark, texts)
    labels = spark.createDataFrame([(i + 1, t) for i, t in enumerate(toxic)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    value = {w: model.words([w])[0].max() for w in ("stupid", "moron", "worthless", "clownish", *vocabulary)}
    assert min(value[w] for w in ("stupid", "moron", "worthless", "clownish")) > 0.5
    assert np.mean([value[w] < 0 for w in vocabulary]) > 0.9


def test_weak_quality(spark, docs, no_docs, lone_docs):
    rng = random.Random(8)
    good = [prose(rng, rng.randint(30, 120)) for _ in range(200)]
    bad = [prose(rng, 60).upper().replace(" ", "!! ") for _ in range(15)]
    bad += [prose(rng, 60).replace(" ", "### ") for _ in range(15)] + [f"{prose(rng, 1)} " * 90 for _ in range(15)]
    df = frame(spark, good + bad)
    scorer = weak_quality.fit(df)
    rows = {r.doc_id: r.kept for r in weak_quality.scored(df, scorer).collect()}
    assert np.mean([rows[i + 1] for i in range(200)]) > 0.99 and np.mean([rows[i + 201] for i in range(45)]) < 0.05
    assert weak_quality.scored(docs, scorer).columns == [*(c for c in docs.columns if c not in ("score", "kept")), "score", "kept"]
    assert weak_quality.scored(lone_docs, scorer).count() == lone_docs.count()
    assert {r.score for r in weak_quality.scored(df.limit(3), weak_quality.fit(no_docs)).collect()} == {0.5}
    assert weak_quality.scored(no_docs, scorer).count() == 0


def test_weak_quality_learns_from_long_texts(spark):
    rng = random.Random(9)
    good = [prose(rng, 5000) for _ in range(24)]
    bad = [prose(rng, 4500).upper().replace(" ", "!! ") for _ in range(4)]
    bad += [prose(rng, 4500).replace(" ", "### ") for _ in range(4)]
    assert min(len(t) for t in good + bad) > 20_000
    df = frame(spark, good + bad)
    rows = {r.doc_id: r for r in weak_quality.scored(df, weak_quality.fit(df)).collect()}
    assert all(rows[i].kept == (i <= 24) for i in rows) and len({r.score for r in rows.values()}) > 8


def test_expectation_maximisation_trusts_the_better_labeller():
    rng = np.random.default_rng(2)
    truth = rng.random(20_000) < 0.7
    votes = np.stack([np.where(rng.random(20_000) < a, truth, ~truth) * 2 for a in (0.95, 0.8, 0.6)], axis=1)
    codes, counts = np.unique(votes @ [9, 3, 1], return_counts=True)
    good = dict(zip(codes.tolist(), weak_quality.posteriors(codes, counts, 3)))
    assert good[18] > 0.5 > good[8]
