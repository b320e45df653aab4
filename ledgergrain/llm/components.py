"""Connected components of a link table by alternating large-star and small-star rounds, stored after each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgergrain.session import run_folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: cuts the lineage, and lost executors cost nothing."""
    path = run_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _stars(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = large.where(F.col("a") != F.col("b")).distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a").where(F.col("b") != F.col("m"))
    small = small.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
    return small.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node) of every node in ``links`` (columns ``a``, ``b``: longs)."""
    links = links.where(F.col("a") != F.col("b"))
    links = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")

    def state(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = state(links)
    while True:
        links = stored(_stars(links), "links")
        before, now = now, state(links)
        if now == before:
            break
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
