"""Join-quality checks between two sources.

Both sides are reduced to one row per key in a single grouped pass (partial counts first, so a hot key
never meets in one task), and every figure is a sum over those key rows: no join is needed for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgergrain.functions.columns import sql_rate, sql_rate_text, sql_share, sql_value
from ledgergrain.operators.profile import union_all
from ledgergrain.operators.quality import Candidate, emit, said
from ledgergrain.specs import Relationship


def _any_null(columns: list[Column]) -> Column:
    condition = F.lit(False)
    for c in columns:
        condition = condition | c.isNull()
    return condition


def key_rows(left: DataFrame, right: DataFrame, rel: Relationship) -> DataFrame:
    """One row per key value with its row count on each side; null keys are marked."""
    names = [f"k{i}" for i in range(len(rel.left_keys))]
    sides = [
        df.select(
            *[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)],
            F.lit(is_left).cast("bigint").alias("l"),
            F.lit(1 - is_left).cast("bigint").alias("r"),
        )
        for df, keys, is_left in ((left, rel.left_keys, 1), (right, rel.right_keys, 0))
    ]
    counted = sides[0].unionByName(sides[1]).groupBy(*names).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    return counted.withColumn("is_null", _any_null([F.col(n) for n in names]))


def key_figures(left: DataFrame, right: DataFrame, rel: Relationship) -> DataFrame:
    """All counts of a relationship as one row."""
    figures = {
        "left_rows": "coalesce(sum(l), 0)",
        "right_rows": "coalesce(sum(r), 0)",
        "left_duplicate_key_count": "count_if(not is_null and l > 1)",
        "right_duplicate_key_count": "count_if(not is_null and r > 1)",
        "right_null_key_count": "coalesce(sum(if(is_null, r, 0)), 0)",
        "unmatched_left_count": "coalesce(sum(if(not is_null and r = 0, l, 0)), 0)",
        "unmatched_right_count": "coalesce(sum(if(not is_null and l = 0, r, 0)), 0)",
    }
    return key_rows(left, right, rel).agg(*[F.expr(e).alias(n) for n, e in figures.items()])


def orphans(rows: DataFrame, keys: tuple[str, ...], other: DataFrame, other_keys: tuple[str, ...]) -> DataFrame:
    """Rows with a filled key that the other side lacks (anti join against its distinct keys)."""
    present = other.select(*[F.col(k).alias(f"_o{i}") for i, k in enumerate(other_keys)]).distinct()
    condition = F.lit(True)
    for i, k in enumerate(keys):
        condition = condition & (F.col(k) == F.col(f"_o{i}"))
    return rows.where(~_any_null([F.col(k) for k in keys])).join(present, condition, "left_anti")


def payment_coverage(
    invoices: DataFrame,
    payments: DataFrame,
    key: str = "invoice_id",
    amount: str = "invoice_amount",
    paid: str = "successful_amount",
) -> DataFrame:
    """Invoices with a positive amount that are partly, over or fully paid, as one row.

    Payments are summed per key before the join; equal (key, amount) invoices are one invoice.
    """
    paid_by_key = (
        payments.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_key"))
        .agg(F.sum(paid).alias("_paid"), F.count(F.lit(1)).alias("_payments"))
    )
    billed = (
        invoices.where(F.col(amount) > 0)
        .groupBy(F.col(key), F.col(amount).alias("_amount"))
        .agg(F.count(F.lit(1)).alias("_copies"))
    )
    joined = billed.join(paid_by_key, F.col(key) == F.col("_key"), "left").select(
        "_amount",
        F.coalesce(F.col("_paid") * F.col("_copies"), F.lit(0)).alias("_paid"),
        F.coalesce("_payments", F.lit(0)).alias("_payments"),
    )
    has = F.col("_payments") > 0
    return joined.agg(
        F.count_if(has & (F.col("_paid") > 0) & (F.col("_paid") < F.col("_amount"))).alias("partial_count"),
        F.count_if(has & (F.col("_paid") > F.col("_amount"))).alias("overpaid_count"),
        F.count_if(has & (F.col("_paid") == F.col("_amount"))).alias("fully_paid_count"),
    )


def _missing_keys(left: DataFrame, right: DataFrame, rel: Relationship) -> tuple[bool, bool]:
    return (
        any(k not in left.columns for k in rel.left_keys),
        any(k not in right.columns for k in rel.right_keys),
    )


def _covers_payments(rel: Relationship) -> bool:
    ends = (rel.left_source, rel.right_source, rel.left_keys, rel.right_keys)
    return ends == ("stripe_invoices", "stripe_payments", ("invoice_id",), ("invoice_id",))


COVERAGE = ("partial_count", "overpaid_count", "fully_paid_count")


def _figures(left: DataFrame, right: DataFrame, rel: Relationship) -> DataFrame:
    row = key_figures(left, right, rel)
    if not _covers_payments(rel):
        return row.selectExpr("*", *[f"cast(null as bigint) as {n}" for n in COVERAGE])
    coverage = payment_coverage(left, right).select(F.struct(*COVERAGE)).scalar()
    return row.withColumn("_coverage", coverage).selectExpr(*row.columns, "_coverage.*")


def _candidates(rel: Relationship) -> list[Candidate]:
    l, r = rel.left_source, rel.right_source
    l_key, r_key = ",".join(rel.left_keys), ",".join(rel.right_keys)
    ends = {
        "relationship_id": sql_value(rel.id), "left_source": sql_value(l), "right_source": sql_value(r),
        "left_key": sql_value(l_key), "right_key": sql_value(r_key),
    }

    def by_rate(ordinal, id, type, part, whole, limit, holds, message, evidence) -> list[Candidate]:
        over = f"{sql_share(part, whole)} > {float(limit)!r}D"
        return [
            Candidate(ordinal, id, type, severity, None, f"({holds}) and {chosen}", message, evidence,
                      ("join_logic", "metric_logic", "documentation"))
            for severity, chosen in (("must_answer", over), ("optional_review", f"not {over}"))
        ]

    found = []
    if rel.left_key_unique:
        found.append(
            Candidate(
                1, f"{rel.id}__left_key_duplicates", "left_key_duplicates", "must_answer", None,
                "left_duplicate_key_count > 0",
                said("left_duplicate_key_count", sql_value(f" keys of {l}.{l_key} occur more than once.")),
                {"duplicate_key_count": "left_duplicate_key_count"}, ("join_logic", "sql_model", "data_tests"),
            )
        )
    found += by_rate(
        2, rel.left_issue_id or f"issue_{l}_without_{r}", "unmatched_left_records", "unmatched_left_count",
        "left_rows", rel.max_unmatched_left_rate, "unmatched_left_count > 0",
        said("unmatched_left_count", sql_value(f" rows of {l} have none in {r}.")),
        {**ends, "unmatched_left_count": "unmatched_left_count",
         "unmatched_left_rate": sql_rate_text("unmatched_left_count", "left_rows")},
    )
    found += by_rate(
        3, rel.right_issue_id or f"issue_{r}_without_{l}", "unmatched_right_records", "unmatched_right_count",
        "right_rows", rel.max_unmatched_right_rate, "unmatched_right_count > 0 or right_null_key_count > 0",
        said("unmatched_right_count", sql_value(f" rows of {r} point to no row of {l}, and "),
             "right_null_key_count", "' have no key.'"),
        {**ends, "unmatched_right_count": "unmatched_right_count",
         "unmatched_right_rate": sql_rate_text("unmatched_right_count", "right_rows"),
         "right_null_count": "right_null_key_count",
         "right_null_rate": sql_rate_text("right_null_key_count", "right_rows")},
    )
    if _covers_payments(rel):
        found.append(
            Candidate(
                4, "issue_partial_or_overpaid_invoices", "payment_coverage_anomaly", "must_answer", None,
                "partial_count > 0 or overpaid_count > 0",
                said("partial_count", "' invoices are paid in part, and '", "overpaid_count",
                     "' are paid above their amount.'"),
                {n: n for n in COVERAGE}, ("metric_logic", "sql_model", "documentation"),
            )
        )
    return found


def _missing_key(rel: Relationship, left_missing: bool, right_missing: bool) -> Candidate:
    return Candidate(
        0, f"{rel.id}__missing_join_key", "missing_join_key", "must_answer", None, "true",
        sql_value(
            f"Without key column: left {left_missing}, right {right_missing}."
        ),
        {"left_source": sql_value(rel.left_source), "left_key": sql_value(",".join(rel.left_keys)),
         "right_source": sql_value(rel.right_source), "right_key": sql_value(",".join(rel.right_keys))},
        ("join_logic", "sql_model", "data_tests"),
    )


def findings(left: DataFrame, right: DataFrame, rel: Relationship) -> DataFrame:
    """Findings of one relationship. A missing key column is the only finding then."""
    missing = _missing_keys(left, right, rel)
    if any(missing):
        return emit(left.agg(F.count(F.lit(1)).alias("left_rows")), [_missing_key(rel, *missing)])
    return emit(_figures(left, right, rel), _candidates(rel))


SUMMARY_COLUMNS = (
    "left_rows", "right_rows", "left_duplicate_key_count", "right_duplicate_key_count", "right_null_key_count",
    "unmatched_left_count", "unmatched_left_rate", "unmatched_right_count", "unmatched_right_rate", *COVERAGE,
)


def summary(left: DataFrame, right: DataFrame, rel: Relationship, composite: bool = True) -> DataFrame:
    """One row per relationship: figures, rates and status.

    ``composite=False`` keeps list-valued keys at ``not_validated``; by default they are checked
    like single keys, where a key with any null part counts as null.
    """
    if len(rel.left_keys) > 1 and not composite:
        row = left.agg(F.lit("not_validated").alias("status"))
        return _summary_row(row, rel, dict.fromkeys(SUMMARY_COLUMNS, "null"))
    if any(_missing_keys(left, right, rel)):
        row = left.agg(F.count(F.lit(1)).alias("left_rows")).select(
            "left_rows", right.agg(F.count(F.lit(1))).scalar().alias("right_rows"), F.lit("failed").alias("status")
        )
        return _summary_row(row, rel, dict.fromkeys(SUMMARY_COLUMNS[2:], "null"))
    any_finding = " or ".join(f"coalesce({c.holds}, false)" for c in _candidates(rel))
    row = _figures(left, right, rel).selectExpr("*", f"if({any_finding}, 'warning', 'passed') as status")
    rates = {f"unmatched_{s}_rate": sql_rate(f"unmatched_{s}_count", f"{s}_rows") for s in ("left", "right")}
    return _summary_row(row, rel, rates)


def _summary_row(row: DataFrame, rel: Relationship, computed: dict[str, str]) -> DataFrame:
    values = [
        f"cast({computed.get(n, n)} as {'double' if n.endswith('_rate') else 'bigint'}) as {n}"
        for n in SUMMARY_COLUMNS
    ]
    return row.selectExpr(f"{sql_value(rel.id)} as relationship_id", "status", *values)


def for_sources(relationships: tuple[Relationship, ...], sources: set[str] | list[str]) -> list[Relationship]:
    """Relationships whose two ends are both selected."""
    selected = set(sources)
    return [r for r in relationships if r.left_source in selected and r.right_source in selected]


def summaries(tables: dict[str, DataFrame], relationships: tuple[Relationship, ...]) -> DataFrame:
    chosen = for_sources(relationships, set(tables))
    return union_all([summary(tables[r.left_source], tables[r.right_source], r) for r in chosen])


def all_findings(tables: dict[str, DataFrame], relationships: tuple[Relationship, ...]) -> DataFrame:
    chosen = for_sources(relationships, set(tables))
    return union_all(
        [
            findings(tables[r.left_source], tables[r.right_source], r).withColumn("relationship_id", F.lit(r.id))
            for r in chosen
        ]
    )
