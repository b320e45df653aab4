"""Source profiling: counts, columns, null rates, value ranges and the schema graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgergrain.functions.columns import sql_name, sql_rate, sql_value
from ledgergrain.specs import CatalogSource, Dimension, Metric, Relationship, SourceContract


def type_bucket(data_type: T.DataType) -> str:
    """The four storage buckets: integer, real, text, blob; other types keep their own name."""
    if isinstance(data_type, T.IntegralType):
        return "integer"
    if isinstance(data_type, (T.FractionalType, T.DecimalType)):
        return "real"
    if isinstance(data_type, T.StringType):
        return "text"
    if isinstance(data_type, T.BinaryType):
        return "blob"
    return "unknown" if isinstance(data_type, T.NullType) else data_type.simpleString()


def contract_type(declared: str) -> str:
    """The bucket of a declared type; names outside the three groups stay as they are."""
    value = declared.strip().lower()
    groups = {
        "text": ("string", "varchar", "text"),
        "real": ("float", "double", "decimal", "numeric", "real"),
        "integer": ("int", "integer", "bigint"),
    }
    return next((bucket for bucket, names in groups.items() if value in names), value)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per source with its row count."""
    return union_all(
        [
            df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("source"), "row_count")
            for name, df in tables.items()
        ]
    )


def null_rates(df: DataFrame, source: str) -> DataFrame:
    """Null count and rate per column, from one aggregate over the table."""
    totals = df.agg(
        F.count(F.lit(1)).alias("_total"), *[F.count_if(F.col(c).isNull()).alias(f"_n_{c}") for c in df.columns]
    )
    cells = ", ".join(f"struct({sql_value(c)} as column, {sql_name(f'_n_{c}')} as null_count)" for c in df.columns)
    return totals.selectExpr("_total", f"inline(array({cells}))").selectExpr(
        f"{sql_value(source)} as source", "column", "null_count", "_total as total_rows",
        f"{sql_rate('null_count', '_total')} as null_rate",
    )


def column_profile(df: DataFrame, contract: SourceContract) -> DataFrame:
    """Name, raw type, bucket, declared flags and filled rows for every live column."""
    declared = {c.name: c for c in contract.columns}
    counts = df.agg(*[F.count(F.col(c)).alias(f"_n_{c}") for c in df.columns])

    def entry(position: int, field: T.StructField) -> str:
        spec = declared.get(field.name)
        values = {
            "position": str(position),
            "column": sql_value(field.name),
            "raw_type": sql_value(field.dataType.simpleString()),
            "normalized_type": sql_value(type_bucket(field.dataType)),
            "not_null": sql_value(bool(spec and not spec.nullable)),
            "primary_key": sql_value(bool(spec and spec.primary_key)),
            "filled_rows": sql_name(f"_n_{field.name}"),
        }
        return "struct(" + ", ".join(f"{v} as {n}" for n, v in values.items()) + ")"

    entries = ", ".join(entry(i, f) for i, f in enumerate(df.schema.fields))
    return counts.selectExpr(f"inline(array({entries}))").selectExpr(f"{sql_value(contract.name)} as source", "*")


def distinct_values(df: DataFrame, contract: SourceContract) -> DataFrame:
    """Every observed non-null value of the enumerated columns with its row count, one row per value."""
    frames = [
        df.where(F.col(c.name).isNotNull())
        .groupBy(F.col(c.name).cast("string").alias("value"))
        .agg(F.count(F.lit(1)).alias("row_count"))
        .select(F.lit(contract.name).alias("source"), F.lit(c.name).alias("column"), "value", "row_count")
        for c in contract.columns
        if c.valid_values and c.name in df.columns
    ]
    return union_all(frames)


def approx_distinct(df: DataFrame, source: str) -> DataFrame:
    """Approximate distinct count of every column in one pass, for wide tables."""
    counts = df.agg(*[F.approx_count_distinct(c).alias(c) for c in df.columns])
    return counts.select(
        F.lit(source).alias("source"),
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("approx_distinct")) for c in df.columns])
        ).alias("r"),
    ).select("source", "r.*")


def month_ranges(tables: dict[str, DataFrame], contracts: dict[str, SourceContract]) -> DataFrame:
    """First month, last month and number of months of every month-key column."""
    frames = []
    for name, df in tables.items():
        for c in contracts[name].columns:
            if c.logical_type != "month" or c.name not in df.columns:
                continue
            frames.append(
                df.groupBy(F.col(c.name).alias("m"))
                .agg(F.count(F.lit(1)).alias("n"))
                .agg(
                    F.min("m").alias("first_month"),
                    F.max("m").alias("last_month"),
                    F.count("m").alias("months"),
                    F.sum("n").alias("row_count"),
                )
                .select(F.lit(name).alias("source"), F.lit(c.name).alias("column"), "first_month", "last_month",
                        "months", "row_count")
            )
    return union_all(frames)


def column_differences(df: DataFrame, contract: SourceContract) -> DataFrame:
    """Contract-only and table-only columns, next to the live row count."""
    declared = [c.name for c in contract.columns]
    missing = [c for c in declared if c not in df.columns]
    extra = [c for c in df.columns if c not in declared]
    counted = df.agg(F.count(F.lit(1)).alias("row_count"))
    entries = [("missing", c) for c in missing] + [("extra", c) for c in extra]
    if not entries:
        return counted.where(F.lit(False)).select(
            F.lit(contract.name).alias("source"), F.lit("").alias("difference"), F.lit("").alias("column"), "row_count"
        )
    rows = F.explode(
        F.array(*[F.struct(F.lit(kind).alias("difference"), F.lit(c).alias("column")) for kind, c in entries])
    )
    return counted.select("row_count", rows.alias("r")).select(
        F.lit(contract.name).alias("source"), "r.difference", "r.column", "row_count"
    )


def _names(items: list[str]) -> Column:
    return F.array(*[F.lit(i) for i in items]).cast("array<string>")


def graph_nodes(
    tables: dict[str, DataFrame],
    catalog: tuple[CatalogSource, ...],
    metrics: dict[str, Metric],
    dimensions: dict[str, Dimension],
    products: dict[str, tuple[str, ...]],
) -> DataFrame:
    """One node per catalog source: role, grain, key, live row count and who uses it."""
    frames = []
    for source in catalog:
        attributes = [
            F.lit(source.name).alias("source"),
            F.lit(source.role).alias("role"),
            F.lit(source.entity).alias("entity"),
            F.lit(source.grain).alias("grain"),
            F.lit(source.primary_key).alias("primary_key"),
            _names([m.name for m in metrics.values() if m.base_source == source.name]).alias("metrics"),
            _names([d.name for d in dimensions.values() if d.source == source.name]).alias("dimensions"),
            _names([p for p, used in products.items() if source.name in used]).alias("products"),
        ]
        if source.name in tables:
            counted = tables[source.name].agg(F.count(F.lit(1)).alias("row_count"))
        else:
            anchor = next(iter(tables.values()))
            counted = anchor.agg(F.lit(None).cast("bigint").alias("row_count"))
        frames.append(counted.select(*attributes, "row_count"))
    return union_all(frames)


def graph_edges(nodes: DataFrame, relationships: tuple[Relationship, ...]) -> DataFrame:
    """Relationships with the live row counts of both ends; ``warning`` marks a missing end."""
    spark = nodes.sparkSession
    edges = spark.createDataFrame(
        [
            (r.id, r.left_source, r.right_source, ",".join(r.left_keys), ",".join(r.right_keys), r.relationship_type)
            for r in relationships
        ],
        "id string, from_source string, to_source string, from_column string, to_column string, "
        "relationship_type string",
    )
    left = nodes.select(F.col("source").alias("from_source"), F.col("row_count").alias("from_rows"))
    right = nodes.select(F.col("source").alias("to_source"), F.col("row_count").alias("to_rows"))
    joined = edges.join(left.withColumn("_l", F.lit(True)), "from_source", "left").join(
        right.withColumn("_r", F.lit(True)), "to_source", "left"
    )
    return joined.select(
        "id", "from_source", "to_source", "from_column", "to_column", "relationship_type", "from_rows", "to_rows",
        (F.col("_l").isNull() | F.col("_r").isNull()).alias("warning"),
    )


def graph_summary(nodes: DataFrame, edges: DataFrame, metrics: int, dimensions: int, products: int) -> DataFrame:
    """Per role its sources and rows, and the size of the whole graph on every row."""
    roles = nodes.groupBy("role").agg(
        F.array_join(F.array_sort(F.collect_list("source")), ",").alias("sources"),
        F.count(F.lit(1)).alias("source_count"),
        F.sum("row_count").alias("row_count"),
    )
    table_count = nodes.agg(F.count(F.lit(1))).scalar()
    edge_count = edges.where(~F.col("warning")).agg(F.count(F.lit(1))).scalar()
    return roles.select(
        "role", "sources", "source_count", "row_count",
        table_count.alias("table_count"),
        edge_count.alias("relationship_count"),
        F.lit(metrics).cast("bigint").alias("metric_count"),
        F.lit(dimensions).cast("bigint").alias("dimension_count"),
        F.lit(products).cast("bigint").alias("product_count"),
    )


def table_presence(spark: SparkSession, names: list[str]) -> DataFrame:
    """Whether each name is a table or view of the session, and how many rows it has."""
    frames = []
    for name in names:
        if spark.catalog.tableExists(name):
            counted = spark.table(name).agg(F.count(F.lit(1)).alias("row_count"))
            frames.append(counted.select(F.lit(name).alias("table_name"), F.lit(True).alias("present"), "row_count"))
        else:
            frames.append(
                spark.range(1).select(
                    F.lit(name).alias("table_name"), F.lit(False).alias("present"),
                    F.lit(None).cast("bigint").alias("row_count"),
                )
            )
    return union_all(frames)
