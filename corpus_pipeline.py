"""A corpus pipeline of the text operators: stages over ``documents``, each stored before the next one reads it.

Every stage but the last returns the columns of ``documents``. The rows of each stage are the whole input of the next.
Null and empty texts have no words, so the quality rules reject them; called alone, the later stages keep them as empty
texts. Texts are never cut by length. Equal texts are copies, whatever their ids; ties go to the smaller key. An empty
table passes every stage as an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgergrain.llm import bpe, components, ngram_join, quality_rules, queries, repeats, substring_dedup
from ledgergrain.session import run_folder


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that every quality rule lets pass."""
    return quality_rules.filtered(docs, quality_rules.Cascade.fit(docs))


def _with_keys(docs: DataFrame, key: str) -> DataFrame:
    """The rows with a key of their own: the id where it is alone, else a number beyond all ids.

    Only rows without id or with a shared one are stored with their numbers, so that a lost executor changes none.
    """
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_rows"))
    low, high = ids.agg(F.min("doc_id"), F.max("doc_id")).first()
    number = F.monotonically_increasing_id()
    beyond = F.lit(low or 0) - 1 - number if (high or 0) > 1 << 62 else F.lit(high or 0) + 1 + number
    # Stored, so Spark knows its size and need not shuffle the texts to find that few ids are shared.
    twice = components.stored(ids.where("_rows > 1 AND doc_id IS NOT NULL").select("doc_id"), "shared-ids")
    odd = docs.join(twice, "doc_id", "left_semi").select(docs.columns).unionByName(docs.where("doc_id IS NULL"))
    alone = docs.where("doc_id IS NOT NULL").join(twice, "doc_id", "left_anti").select(docs.columns)
    return alone.withColumn(key, F.col("doc_id")).unionByName(components.stored(odd.withColumn(key, beyond), "odd"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document, that with the smallest id where ids are unique.

    Rows that share an id, or have none, are documents of their own. Texts without words have no copies and stay.
    """
    key = repeats.fresh(docs, "row")
    keyed = _with_keys(docs, key)
    groups = ngram_join.joined(keyed, key)
    first = groups.where(F.col(key) == F.col("component_id")).select(key)
    return keyed.join(first, key, "left_semi").select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in repeated windows go; ``n_chars`` follows the text."""
    cut = substring_dedup.remove_repeats(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    return cut.select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document may come in several epochs."""
    return queries.mix(docs).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, with the number of tokens and the digest of the text decoded from them."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    decoded = F.sha2(F.col("decoded"), 256).alias("decoded_sha256")
    coded = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), path, pattern)
    return coded.select("doc_id", "lang", "source", "n_tokens", "token_ids", decoded)


STAGES = [
    ("quality_rules", keep_quality),
    ("ngram_join", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: Hash order and byte-pair merges have no SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage is written to the shared folder and read again."""
    folder = run_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
