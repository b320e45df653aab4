"""Periodic runs, benchmark decontamination and the Merkle manifest against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from ledgergrain.llm import (  # noqa: E402
    decontaminate,
    merkle,
    periodic_runs,
    queries,
    substring_dedup,
    suffix_dedup,
)

from text_fixtures import docs, frame, lone_docs, no_docs, prose  # noqa: E402, F401

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def table(df):
    return [r.asDict() for r in df.collect()]


# --- periodic runs ------------------------------------------------------------------------------------


def plain_runs(w) -> set[tuple[int, int, int]]:
    """Stretches that keep a period as far as they go; the least period of a stretch counts."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        start = 0
        for i in range(len(w) - q + 1):
            if i == len(w) - q or w[i] != w[i + q]:
                if i + q - start >= max(6, 4 * q):
                    found.setdefault((start, i + q), q)
                start = i + 1
    return {(a, b - a, q) for (a, b), q in found.items()}


def collapsed(w) -> str:
    gone = {i for a, n, q in plain_runs(w) for i in range(a + q, a + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


cycle = st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(0, 60))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(cycle, max_size=4), min_size=1, max_size=4), st.sampled_from([periodic_runs.LIMIT, 4, 2, 1]))
def test_runs_of_words(parts, limit):
    texts = [[x for word, n in p for x in (word * 60)[:n]] for p in parts]
    edges = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    found = periodic_runs.runs_of(np.array([x for t in texts for x in t], np.int64), edges, limit)
    want = {(a + e, a + e + n, q) for t, e in zip(texts, edges.tolist()) for a, n, q in plain_runs(t)}
    rows = list(zip(found.start.tolist(), found.end.tolist(), found.period.tolist()))
    assert set(rows) == want and len(rows) == len(want)


@pytest.mark.parametrize("width", [1, 2, 8, 64, 2048])
def test_differences_are_exact(width):
    """A sum of squares that is a multiple of a prime is not zero; blocks over 1,024 words take both primes."""
    rng = np.random.default_rng(width)
    blocks = rng.integers(1, width + 1, (4, width))
    windows = rng.integers(0, width + 1, (4, 2 * width))
    windows[0, width // 2 : width // 2 + width] = blocks[0]
    windows[1, :width] = blocks[1]
    want = np.array([[(b == w[s : s + width]).all() for s in range(width)] for b, w in zip(blocks, windows)])
    assert (periodic_runs.zero_differences(blocks, windows) == want).all() and want.any()


def test_long_periods_and_long_texts():
    rng = np.random.default_rng(5)
    unit = rng.integers(0, 900, 3000)
    words = np.r_[rng.integers(0, 900, 77), np.tile(unit, 5), unit[:41], 901, np.zeros(50_000, np.int64), 902]
    for limit in (periodic_runs.LIMIT, 512):
        found = periodic_runs.runs_of(words, np.array([0, len(words)]), limit)
        rows = set(zip(found.start.tolist(), found.end.tolist(), found.period.tolist()))
        assert rows == {(77, 77 + 15_041, 3000), (15_119, 65_119, 1)}


def test_find(spark, docs, no_docs, lone_docs):
    rng = random.Random(2)
    loops = [" ".join(["a b c"] * 4), "a " * 5, "a " * 6, f"x {'p q ' * 7}p y", f"{'s t u ' * 9} {'v ' * 30}"]
    loops += ["\n".join(prose(rng, 7) for _ in range(1)) + " " + " ".join([prose(rng, 40)] * 6)]
    for given in (docs, lone_docs, frame(spark, loops, 900)):
        found = periodic_runs.find(given)
        assert found.columns == [*given.columns, "n_words", "runs", "collapsed"]
        rows = table(found)
        assert len(rows) == given.count()
        for r in rows:
            w = WORDS(r["text"] or "")
            assert [tuple(x) for x in r["runs"]] == sorted(plain_runs(w), key=lambda x: (x[0], x[2]))
            assert r["n_words"] == len(w) and r["collapsed"] == collapsed(w)
    assert any(r["runs"] for r in rows)
    assert periodic_runs.find(no_docs).count() == 0


def test_op11_contract(spark, tmp_path):
    rng = random.Random(8)
    given = [(i, prose(rng, rng.randint(0, 150))) for i in range(-40, 260)]
    given += [(None, "z " * 9), (3, None), (3, ""), (10, "a " * 40), (10, "a " * 40)]
    spark.createDataFrame(given, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, text in given:
        w = WORDS(text or "")
        n, h = len(w), zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        runs = sorted(plain_runs(w), key=lambda x: (x[0], x[2]))
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        text = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
        want.append((i, len(runs), *first, sha(text), sha(collapsed(w))))
    found = [tuple(r) for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert sum(r[1] > 0 for r in want) > 10


def test_one_very_long_text(spark):
    """Two megabytes in one text, with a passage that comes twice and a loop, through all that read texts in tasks."""
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    words = ["".join(w) for w in letters[rng.integers(0, 26, (220_000, 8))]]
    passage = words[:100]
    text = " ".join([*words[:150_000], *passage, *words[150_000:], *["loop", "again"] * 30])
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    cut = {r.doc_id: r for r in substring_dedup.remove_repeats(df).collect()}
    assert (cut[1].n_words, cut[1].n_removed) == (220_160, 200 + 60) and cut[2].text == ""
    gone = {r.doc_id: r for r in suffix_dedup.remove_repeats(df).drop("kept", "text").collect()}
    # The passage and the blank behind it, at both places; the one before is at one only.
    assert gone[1].n_bytes == len(text) and gone[1].n_removed - 2 * len(" ".join(passage)) in range(6)
    runs = {r.doc_id: r.runs for r in periodic_runs.find(df).drop("text", "collapsed").collect()}
    assert [tuple(x) for x in runs[1]] == [(220_100, 60, 2)] and runs[2] == []


# --- decontamination ----------------------------------------------------------------------------------


def hits(text, items, width=10):
    w = TERMS((text or "").translate(LOWER))
    covered, found = set(), set()
    for item, said in items:
        t = TERMS((said or "").translate(LOWER))
        n = min(width, len(t))
        for s in range(len(t) - n + 1) if t else ():
            for i in range(len(w) - n + 1):
                if w[i : i + n] == t[s : s + n]:
                    covered.update(range(i, i + n))
                    found.add("" if item is None else str(item))
    return len(w), len(covered), len(found), sha(",".join(sorted(found))), bool(covered)


def leaks(rng):
    """Items and texts with whole, partial, overlapping and case-changed passages, common words and near misses."""
    items = [(i, prose(rng, rng.randint(10, 40))) for i in range(12)]
    common = "the of and to the of and to the of"
    items += [(20, "x y"), (21, ""), (22, None), (23, common + " end"), (None, prose(rng, 15)), (3, prose(rng, 12))]
    items += [(24, items[2][1]), (25, "one"), (100, items[2][1].upper() + "!")]
    texts = [prose(rng, 60) for _ in range(10)] + [None, "", "one", "X, Y.", "of the", "the of and to " * 80]
    for _, said in items:
        if said:
            w = said.split(" ")
            texts += [f"{prose(rng, 9)} {said} {prose(rng, 5)}", " ".join(w[2:13]), " ".join(w[1:10]), f"{said} {said}"]
            texts += [" ".join(w[:5] + ["changed"] + w[5:]), said.upper().replace(" ", ",\n ")]
    return items, texts


def test_decontamination(spark, no_docs, lone_docs):
    rng = random.Random(4)
    items, texts = leaks(rng)
    bench = spark.createDataFrame(items, "item_id long, text string")
    given = frame(spark, texts).withColumn("k1", F.lit(5)).withColumn("pos", F.lit(6)).withColumn("n_hit", F.lit(7))
    found = decontaminate.find(given, bench)
    assert set(given.columns) - {"n_hit"} <= set(found.columns)
    rows = table(found)
    assert len(rows) == len(texts) and all(r["k1"] == 5 and r["pos"] == 6 for r in rows)
    for r in rows:
        assert tuple(r[c] for c in decontaminate.RESULT) == hits(r["text"], items), r["text"]
    for one in lone_docs, no_docs:
        rows = table(decontaminate.find(one, bench))
        assert len(rows) == one.count()
        assert all(tuple(r[c] for c in decontaminate.RESULT) == hits(r["text"], items) for r in rows)
    assert decontaminate.find(lone_docs, bench.where("false")).where("n_hit > 0").count() == 0


@pytest.mark.parametrize("ranks", [1, 2, 10])
def test_every_rank_gives_the_same_phrases(spark, ranks):
    items, texts = leaks(random.Random(9))
    bench = spark.createDataFrame(items, "item_id long, text string")
    said, _ = decontaminate.windows(bench, "item_id", "text", 6)
    keyed = decontaminate.keyed(frame(spark, texts), "doc_id", "text")
    found = decontaminate.phrases(keyed, said, ranks).groupBy("k1", "k2").count().join(keyed, ["k1", "k2"])
    windows = {tuple(r.said) for r in said.collect()}
    for r in found.collect():
        w = TERMS(r.text.translate(LOWER))
        assert r["count"] == sum(tuple(w[i : i + n]) in windows for n in range(1, 7) for i in range(len(w) - n + 1))
    assert found.count() == sum(hits(t, items, 6)[4] for t in texts)


def test_proximity(spark):
    rng = random.Random(6)
    asked = [(1, "a b c"), (2, "d a"), (3, "A a"), (4, "zzz a"), (5, ""), (6, "e f g a")]
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 60))) for _ in range(40)] + [None]
    span = 5
    want = set()
    for i, text in enumerate(texts, 1):
        w = TERMS(text or "")
        for q, said in asked:
            terms = set(TERMS(said.translate(LOWER)))
            want |= {(i, q, s) for s in range(len(w)) if terms and w[s] in terms and terms <= set(w[s : s + span])}
    found = decontaminate.near(frame(spark, texts), spark.createDataFrame(asked, "query_id int, text string"), span)
    assert {tuple(r) for r in found.collect()} == want and len(want) > 50


def test_decontamination_plan_has_no_python(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    df = decontaminate.find(frame(spark, ["one two three four"]), bench)
    assert "Python" not in (plan := df._jdf.queryExecution().executedPlan().toString()) and "Arrow" not in plan


# --- manifest -----------------------------------------------------------------------------------------


def tree(digests):
    levels = [list(digests)]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, i):
    out = []
    for row in levels[:-1]:
        low = i // 16 * 16
        out.append((row[low:i], row[i + 1 : low + 16]))
        i //= 16
    return out


def coded(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def manifest(rows):
    """``rows``: doc_id, source, lang, n_chars, text."""
    leaf = {r: sha("".join(map(coded, r))) for r in rows}
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    order = {s: sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf[r])) for s in names}
    trees = {s: tree([leaf[r] for r in order[s]]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for s in names:
        up = siblings(top, names.index(s))
        for i, r in enumerate(order[s]):
            path = siblings(trees[s], i) + up
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            fold = sha("".join(map(coded, (*r[:4], r[4].translate(LOWER) if hit else r[4]))))
            for left, right in path:
                fold = sha("".join([*left, fold, *right]))
            proof = sha("".join(x for a, b in path for x in a + b))
            root = top[-1][0]
            out.append((r[0], leaf[r], trees[s][-1][0], root, proof, fold, fold == root))
    return out


def check_manifest(spark, rows, folder):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    found = [tuple(r) for r in queries.op13_merkle_manifest(spark, str(folder)).collect()]
    assert sorted(found, key=repr) == sorted(manifest(rows), key=repr)
    return found


def test_manifest(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, rng.choice(["s1", "s10", "s2", "É", None, ""]), "en", 5, f"Text {i} É") for i in range(-30, 300)]
    rows += [(None, "s1", None, None, None), (None, "s1", None, None, "A"), (4, "s1", "x", 1, "A"), (4, "s1", "x", 1, "A")]
    rows += [(1, f"only{i}", "en", None, "Q" * i) for i in range(40)] + [(5, None, None, 1, "")]
    found = check_manifest(spark, rows, tmp_path)
    assert {r[6] for r in found} == {True, False}


def test_manifest_over_several_blocks(spark, tmp_path):
    rows = [(i, "hot", "en", i % 7, f"Row {i}") for i in range(4096 + 257)] + [(i, "b", "en", 1, "X") for i in range(4097)]
    check_manifest(spark, [*rows, *[(i, "c", None, 2, "y") for i in range(4096)]], tmp_path)


def test_manifest_of_one_row_and_of_none(spark, tmp_path):
    ((_, leaf, subroot, root, proof, _, _),) = check_manifest(spark, [(9, "s", "en", 1, "x")], tmp_path / "one")
    assert leaf == subroot == root and proof == sha("")
    assert check_manifest(spark, [], tmp_path / "none") == []


@pytest.mark.parametrize("n", [1, 2, 16, 17, 255, 256, 257, 4095, 4096])
def test_layout(n):
    """Every node has an address of its own, without gaps; top parts come first; lookups give back what was built."""
    levels = merkle.height(n)
    counts = [-(-n // 16 ** (levels - 1 - d)) for d in range(levels)]
    places = [merkle.address(levels, n, d, np.arange(c)) for d, c in enumerate(counts)]
    assert sorted(np.concatenate(places).tolist()) == list(range(sum(counts)))
    if levels == 4:
        assert set(places[0].tolist()) | set(places[1].tolist()) == set(range(1 + counts[1]))
        assert places[3][:16].tolist() == list(range(places[2][0] + 1, places[2][0] + 17))
    leaves = [hashlib.sha256(bytes([i % 256, i >> 8])).digest() for i in range(n)]
    whole = tree([x.hex() for x in leaves])
    block = merkle.Block(levels, n, merkle.built(leaves, levels), b"")
    for i in {0, n // 2, n - 1}:
        path = block.siblings(i)
        assert path == [("".join(a), "".join(b)) for a, b in siblings(whole, i)]
        assert merkle.folded(leaves[i].hex(), path) == whole[-1][0]
        assert list(merkle._levels_of(merkle.packed(path))) == path


def test_manifest_carries_columns_of_any_name(spark, docs, lone_docs, no_docs):
    for given in (docs, lone_docs, no_docs):
        df = given.withColumn("tree", F.lit(1)).withColumn("place", F.lit(2)).withColumn("leaf", F.lit(3))
        names = ["doc_id", "block", "tree", "place", "leaf", "marks"]
        built = merkle.proved(merkle.build(df, ["doc_id", "text"], "source", "doc_id", names))
        assert built.columns == ["doc_id", "block", "tree", "place", "marks", *merkle.ADDED]
        assert built.count() == given.count() and built.where("NOT verified OR tree != 1").count() == 0
