"""Profiles that grow with their source: one state row per file and column, merged on reading.

``update`` reads only files that the state doesn't have yet (by path, size and time) and appends their rows; ``merged``
combines the rows of the files that are there now. Counts, nulls and bounds are exact. Distinct values and quantiles
come from sketches that merge like sums: HyperLogLog (about 1.6 % standard error) and KLL (quantiles by rank, within
about 1.7 % of the rows). A sketch takes a few kilobytes, whatever the file's size.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgergrain.functions.columns import sql_name, sql_value

FILE = ("path", "length", "modified")
STATE = (
    "path string, length long, modified timestamp, `column` string, rows long, nulls long, low string, high string, "
    "low_number double, high_number double, distinct_sketch binary, rank_sketch binary"
)


def listed(spark: SparkSession, source: str) -> DataFrame:
    """Path, size and time of the Parquet files below a source; their content isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    return files.load(source).select("path", "length", F.col("modificationTime").alias("modified"))


def state(spark: SparkSession, folder: str) -> DataFrame:
    try:
        return spark.read.schema(STATE).parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STATE)


def _figures(field: T.StructField) -> list[Column]:
    value, name = F.col(f"`{field.name}`"), field.name
    numeric = isinstance(field.dataType, T.NumericType)
    exact = isinstance(field.dataType, (T.IntegerType, T.LongType, T.StringType))
    number = value.cast("double") if numeric else F.lit(None).cast("double")
    return [
        F.count_if(value.isNull()).alias(f"nulls.{name}"),
        F.min(value).cast("string").alias(f"low.{name}"),
        F.max(value).cast("string").alias(f"high.{name}"),
        F.min(number).alias(f"low_number.{name}"),
        F.max(number).alias(f"high_number.{name}"),
        F.hll_sketch_agg(value if exact else value.cast("string")).alias(f"distinct_sketch.{name}"),
        F.kll_sketch_agg_double(number).alias(f"rank_sketch.{name}") if numeric
        else F.lit(None).cast("binary").alias(f"rank_sketch.{name}"),
    ]


def profiled(files: DataFrame) -> DataFrame:
    """State rows of the files that a frame reads: one aggregate by file, then a row per column."""
    fields = [f for f in files.schema.fields if isinstance(f.dataType, T.AtomicType)]
    sums = [c for f in fields for c in _figures(f)]
    by_file = files.groupBy(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("length"),
        F.col("_metadata.file_modification_time").alias("modified"),
    ).agg(F.count(F.lit(1)).alias("rows"), *sums)
    names = ("nulls", "low", "high", "low_number", "high_number", "distinct_sketch", "rank_sketch")
    cells = (
        "struct(" + ", ".join([f"{sql_value(f.name)} as column", "rows"] + [f"{sql_name(f'{n}.{f.name}')} as {n}" for n in names]) + ")"
        for f in fields
    )
    return by_file.selectExpr(*FILE, f"inline(array({', '.join(cells)}))")


def update(spark: SparkSession, source: str, folder: str) -> list[str]:
    """Add the files of a source that the state below ``folder`` lacks, and return their paths.

    The list of new files comes to the driver, as the lists of a scan do. A file that has changed counts as new, and its
    old rows no longer match what is there.
    """
    new = listed(spark, source).join(state(spark, folder).select(*FILE).distinct(), list(FILE), "left_anti")
    paths = sorted(r.path for r in new.select("path").collect())
    if paths:
        profiled(spark.read.parquet(*paths)).write.mode("append").parquet(folder)
    return paths


def merged(spark: SparkSession, source: str, folder: str, quantiles: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """The profile of a source from its files' states: per column rows, nulls, bounds, distinct values and quantiles."""
    # A file that was added twice, by two writers, counts once.
    rows = state(spark, folder).join(listed(spark, source), list(FILE), "left_semi").dropDuplicates([*FILE, "column"])
    by = rows.groupBy("column").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("rows").alias("row_count"),
        F.sum("nulls").alias("null_count"),
        F.when(F.max("low_number").isNull(), F.min("low")).alias("low"),
        F.when(F.max("low_number").isNull(), F.max("high")).alias("high"),
        F.min("low_number").alias("low_number"),
        F.max("high_number").alias("high_number"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("distinct_estimate"),
        F.kll_merge_agg_double("rank_sketch").alias("_ranks"),
    )
    asked = F.array(*[F.lit(float(q)) for q in quantiles])
    some = F.kll_sketch_get_n_double("_ranks") > 0
    return by.withColumn("quantiles", F.when(some, F.kll_sketch_get_quantile_double("_ranks", asked))).drop("_ranks")
