"""The pipeline against its stages by brute force, and its promises to the next stage."""

from __future__ import annotations

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from ledgergrain.llm import mixing, queries  # noqa: E402
from test_text_operators import WORDS, figures, linked, repeated_words, table  # noqa: E402
from text_fixtures import docs, lone_docs, no_docs  # noqa: E402, F401


@pytest.fixture(scope="module")
def folder(docs, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages(spark, folder):
    from pyspark.sql import functions as F

    given = spark.read.parquet(f"{folder}/documents.parquet")
    first = corpus_pipeline.keep_quality(spark, given, folder)
    kept = {r["doc_id"] for r in table(first)}
    for r in table(given):
        words, _, symbols, _, again = figures(r["text"])
        if words < 20 or 100 * again > 30 * words or 100 * symbols > 15 * words:
            assert r["doc_id"] not in kept
    second = corpus_pipeline.drop_near_copies(spark, first, folder)
    assert sorted(r["doc_id"] for r in table(second)) == sorted({c for _, _, c in linked(table(first))})
    third = corpus_pipeline.cut_repeats(spark, second, folder)
    rows = table(second)
    want = {
        (r["doc_id"], " ".join(x for i, x in enumerate(w) if i not in gone))
        for r, (w, gone) in zip(rows, repeated_words([WORDS(r["text"] or "") for r in rows], 35))
    }
    assert {(r["doc_id"], r["text"]) for r in table(third)} == want
    assert all(r["n_chars"] == len(r["text"]) for r in table(third))
    fourth = corpus_pipeline.mix_sources(spark, third, folder)
    total = sum(len(WORDS(r["text"])) for r in table(third))
    assert sum(len(WORDS(r["text"])) for r in table(fourth)) <= queries.MIX_SHARE * total
    for df in (first, second, third, fourth):
        assert df.columns == given.columns and df.schema.simpleString() == given.schema.simpleString()
    fifth = table(corpus_pipeline.encode(spark, fourth, folder))
    text = {r["doc_id"]: r["text"] for r in table(third)}
    digest = {r.doc_id: r.d for r in third.select("doc_id", F.sha2("text", 256).alias("d")).collect()}
    assert len(fifth) == fourth.count() and all(r["decoded_sha256"] == digest[r["doc_id"]] for r in fifth)
    assert all(len(r["token_ids"]) == 4 * r["n_tokens"] and (r["n_tokens"] > 0 or not text[r["doc_id"]]) for r in fifth)
    assert len(corpus_pipeline.STAGES) == 5 and mixing.MAX_LEAVES


def test_run_equals_the_stages_one_by_one(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    one = sorted(map(repr, docs.drop("token_ids").collect()))
    assert sorted(map(repr, corpus_pipeline.run(spark, folder).drop("token_ids").collect())) == one


def test_lone_and_missing_rows(spark, lone_docs, no_docs, tmp_path):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    for i, df in enumerate((lone_docs, no_docs)):
        df.select(names).write.parquet(f"{tmp_path}/{i}/documents.parquet")
        assert corpus_pipeline.run(spark, f"{tmp_path}/{i}").count() == 0
        near = corpus_pipeline.drop_near_copies(spark, df.select(names), "")
        assert near.count() == (4 if i == 0 else 0)


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    base, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"x{i}" for i in range(60))
    rows = [(1, other), (1, base), (3, base + " end"), (None, other + " end"), (2, "w1"), (2, "w1"), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert sorted((r.text or "").split(" ")[0] for r in left.collect()) == ["", "w0", "w1", "x0"]
    far = docs.withColumn("doc_id", docs.doc_id + (2**63 - 9))
    assert corpus_pipeline.drop_near_copies(spark, far, "").count() == 4
