"""Data tests on models. A test lists its failing rows; a summary has one row per test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgergrain.functions.columns import is_month_key
from ledgergrain.operators.profile import union_all
from ledgergrain.operators.quality import key_counts
from ledgergrain.operators.relationships import key_rows, orphans
from ledgergrain.sources.tables import guarded_sql
from ledgergrain.specs import DataTest, Relationship, SourceContract

ROW_KINDS = ("not_null", "accepted_values", "month_key", "metrics_not_null")


def failing_condition(test: DataTest) -> Column:
    """True for a row that breaks a row-level test."""
    columns = [F.col(c) for c in test.columns]
    condition = F.lit(False)
    for c in columns:
        if test.kind in ("not_null", "metrics_not_null"):
            condition = condition | c.isNull()
        elif test.kind == "accepted_values":
            condition = condition | F.coalesce(~c.isin(*[v for v in test.values if v is not None]), F.lit(False))
        elif test.kind == "month_key":
            condition = condition | c.isNull() | ~is_month_key(c)
        else:
            raise ValueError(f"not a row-level test: {test.kind}")
    return condition


def failing_rows(models: dict[str, DataFrame], test: DataTest) -> DataFrame:
    """All rows that break a test; for ``unique`` the duplicated values with their counts."""
    df = models[test.model]
    if test.kind in ROW_KINDS:
        return df.where(failing_condition(test))
    if test.kind == "unique":
        return duplicated(df, test.columns)
    if test.kind == "relationship":
        return orphans(df, test.columns, models[test.parent], test.parent_columns)
    if test.kind == "custom":
        return custom_rows(df.sparkSession, models, test)
    raise ValueError(f"unknown test kind: {test.kind}")


def duplicated(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Values that all columns together hold more than once, as ``value`` (joined by a comma) and ``copies``."""
    if len(columns) == 1:
        return key_counts(df, columns[0]).where(F.col("filled") > 1).select("value", F.col("rows").alias("copies"))
    filled = df.dropna(subset=list(columns))
    counts = filled.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return counts.select(F.concat_ws(",", *[F.col(c).cast("string") for c in columns]).alias("value"), "copies")


def custom_rows(spark: SparkSession, models: dict[str, DataFrame], test: DataTest) -> DataFrame:
    """Rows of a custom query over the models, by their names. It passes when there are none."""
    return guarded_sql(spark, test.sql, models)


def passes(models: dict[str, DataFrame], test: DataTest) -> bool:
    return failing_rows(models, test).isEmpty()


def _entries(row: DataFrame, tests: list[DataTest]) -> DataFrame:
    """One row with columns ``_t0``, ``_t1``, ... as one row per test."""
    entries = [
        F.struct(F.lit(t.name).alias("test_name"), F.lit(t.model).alias("model"), F.col(f"_t{i}").alias("failing_rows"))
        for i, t in enumerate(tests)
    ]
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def summary(models: dict[str, DataFrame], tests: list[DataTest]) -> DataFrame:
    """Name, model, failing rows and result per test.

    All row-level tests of a model share one pass. A relationship is counted by key once, which also answers the
    uniqueness of the parent's key.
    """
    frames = []
    for model in dict.fromkeys(t.model for t in tests):
        row_tests = [t for t in tests if t.model == model and t.kind in ROW_KINDS]
        if row_tests:
            sums = [F.count_if(failing_condition(t)).alias(f"_t{i}") for i, t in enumerate(row_tests)]
            frames.append(_entries(models[model].agg(*sums), row_tests))
    left = [t for t in tests if t.kind not in ROW_KINDS]
    for test in [t for t in left if t.kind == "relationship"]:
        parent = next(
            (t for t in left if t.kind == "unique" and (t.model, t.columns) == (test.parent, test.parent_columns)), None
        )
        edge = Relationship(test.name, test.parent, test.model, test.parent_columns, test.columns)
        keys = key_rows(models[test.parent], models[test.model], edge)
        sums = [F.coalesce(F.sum(F.when(~F.col("is_null") & (F.col("l") == 0), F.col("r"))), F.lit(0)).alias("_t0")]
        answered = [test]
        if parent is not None:
            sums.append(F.count_if(~F.col("is_null") & (F.col("l") > 1)).alias("_t1"))
            answered.append(parent)
        frames.append(_entries(keys.agg(*sums), answered))
        left = [t for t in left if t not in answered]
    for test in left:
        failing = failing_rows(models, test).agg(F.count(F.lit(1)).alias("_t0"))
        frames.append(_entries(failing, [test]))
    return union_all(frames).withColumn("passed", F.col("failing_rows") == 0)


def contract_tests(model: str, contract: SourceContract) -> list[DataTest]:
    """Key columns unique, required columns filled, enumerated columns in their list, month keys well formed."""
    tests = []
    for c in contract.columns:
        if c.primary_key:
            tests.append(DataTest(f"unique__{model}__{c.name}", "unique", model, (c.name,)))
        if not c.nullable:
            tests.append(DataTest(f"not_null__{model}__{c.name}", "not_null", model, (c.name,)))
        if c.valid_values:
            tests.append(
                DataTest(f"accepted_values__{model}__{c.name}", "accepted_values", model, (c.name,), c.valid_values)
            )
        if c.logical_type == "month":
            tests.append(DataTest(f"month_key__{model}__{c.name}", "month_key", model, (c.name,)))
    return tests


def relationship_tests(relationships: tuple[Relationship, ...]) -> list[DataTest]:
    """No orphan foreign keys; and no null ones where the relationship forbids them."""
    tests = []
    for r in relationships:
        tests.append(
            DataTest(f"relationship__{r.id}", "relationship", r.right_source, r.right_keys, parent=r.left_source,
                     parent_columns=r.left_keys)
        )
        if not r.right_key_nullable_allowed:
            tests.append(DataTest(f"not_null__{r.id}", "not_null", r.right_source, r.right_keys))
    return tests


def metrics_not_null(model: str, metrics: tuple[str, ...]) -> DataTest:
    return DataTest(f"metrics_not_null__{model}", "metrics_not_null", model, metrics)
