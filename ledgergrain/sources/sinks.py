"""Writing marts as Parquet or CSV, listing them and counting rows while they are written."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgergrain.operators.profile import union_all


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> int:
    """Replace a Parquet table and return its row count, counted in the same pass."""
    seen = Observation("written")
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return int(seen.get["rows"])


def save_as_table(
    df: DataFrame, name: str, bucket_by: tuple[int, str] | None = None, path: str | None = None, codec: str | None = None
) -> int:
    """Replace a catalog table; bucketing on a join key lets later joins on it skip the shuffle.

    Rows are dealt by the key first, so each bucket is one file. With a ``path`` the table lies there. ``codec`` is that
    of Parquet, else the session's.
    """
    seen = Observation("saved")
    dealt = df.repartition(*bucket_by) if bucket_by else df
    writer = dealt.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").format("parquet")
    writer = writer.option("path", path) if path else writer
    writer = writer.option("compression", codec) if codec else writer
    (writer.bucketBy(*bucket_by).sortBy(bucket_by[1]) if bucket_by else writer).saveAsTable(name)
    return int(seen.get["rows"])


def write_csv(df: DataFrame, path: str) -> int:
    """Replace a folder of CSV files with header; the number of files follows the partitions."""
    seen = Observation("csv")
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").option("header", True).csv(path)
    return int(seen.get["rows"])


def write_all_csv(spark: SparkSession, marts: dict[str, DataFrame], folder: str, run_id: str) -> DataFrame:
    """Every mart as CSV, and a one-row JSON status next to them."""
    written = [(name, write_csv(df, f"{folder}/{name}")) for name, df in sorted(marts.items())]
    rows = spark.createDataFrame(written, "table_name string, row_count long")
    status = [(run_id, "completed", json.dumps(dict(written)))]
    spark.createDataFrame(status, "run_id string, status string, tables string").coalesce(1).write.mode(
        "overwrite"
    ).json(f"{folder}/_status")
    return rows


def list_marts(marts: dict[str, DataFrame]) -> DataFrame:
    """Name, row count and columns of every mart, by name."""
    return union_all(
        [
            df.agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(name).alias("table_name"), "row_count", F.lit(",".join(df.columns)).alias("columns")
            )
            for name, df in sorted(marts.items())
        ]
    ).orderBy("table_name")
