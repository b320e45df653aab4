"""Contract quality checks as a findings table.

All count-type checks of a table share one aggregate. Only key uniqueness and enumerated values need a
shuffle of their own: one grouped count per column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgergrain import fixed_values as fixed
from ledgergrain.functions.columns import sql_name, sql_rate_text, sql_share, sql_strings, sql_value
from ledgergrain.operators.profile import contract_type, type_bucket, union_all
from ledgergrain.specs import ColumnCheck, ColumnSpec, SourceContract

EXAMPLES = 10


def default_affects(column: str) -> tuple[str, ...]:
    """Artifacts that a problem in a column touches."""
    if column in fixed.AMOUNT_COLUMNS:
        return ("metric_logic", "sql_model", "data_tests")
    if column in fixed.KEY_COLUMNS:
        return ("sql_model", "data_tests")
    return ("data_tests", "documentation")


def affects_of(column: Column) -> Column:
    """``default_affects`` as a column expression."""
    return (
        F.when(column.isin(*fixed.AMOUNT_COLUMNS), _strings(("metric_logic", "sql_model", "data_tests")))
        .when(column.isin(*fixed.KEY_COLUMNS), _strings(("sql_model", "data_tests")))
        .otherwise(_strings(("data_tests", "documentation")))
    )


def _strings(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


@dataclass
class Candidate:
    """One possible finding over a one-row frame: when it holds, and what it says, as SQL expressions."""

    ordinal: int
    id: str
    type: str
    severity: str
    column: str | None
    holds: str
    message: str
    evidence: dict[str, str]
    affects: tuple[str, ...]

    def as_struct(self) -> str:
        evidence = ", ".join(f"{sql_value(k)}, cast({v} as string)" for k, v in self.evidence.items())
        fields = {
            "ordinal": str(self.ordinal),
            "id": sql_value(self.id),
            "type": sql_value(self.type),
            "severity": sql_value(self.severity),
            "column": sql_value(self.column),
            "message": self.message,
            "evidence": f"map({evidence})",
            "affects": sql_strings(self.affects),
        }
        packed = ", ".join(f"'{name}', {value}" for name, value in fields.items())
        return f"if({self.holds}, named_struct({packed}), null)"


def emit(row: DataFrame, candidates: list[Candidate]) -> DataFrame:
    """The candidates that hold, one row each. One SQL expression keeps the plan quick to build."""
    return row.selectExpr(f"inline(array_compact(array({', '.join(c.as_struct() for c in candidates)})))")


def said(*parts: str) -> str:
    """A message from SQL parts."""
    return f"concat({', '.join(parts)})"


def _percent(part: str, whole: str) -> str:
    return f"format_number({sql_share(part, whole)} * 100, 1), '%'"


class _TableChecks:
    """Collects the sums of one table and the candidates that read them."""

    def __init__(self, df: DataFrame, contract: SourceContract):
        self.df, self.contract = df, contract
        self.sums: dict[str, str] = {"_total": "count(1)"}
        self.candidates: list[Candidate] = []

    def counted(self, condition: str) -> str:
        name = f"_c{len(self.sums)}"
        self.sums[name] = f"count_if({condition})"
        return name

    def nulls(self, column: str) -> str:
        name = f"_null_{column}"
        self.sums.setdefault(sql_name(name), f"count_if({sql_name(column)} is null)")
        return sql_name(name)

    def add(self, ordinal, id, type, severity, column, holds, message, evidence, affects) -> None:
        filled = f"({holds}) and _total > 0"
        self.candidates.append(
            Candidate(ordinal, id, type, severity, column, filled, message, evidence, tuple(affects))
        )

    def live(self) -> list[ColumnSpec]:
        return [c for c in self.contract.columns if c.name in self.df.columns]

    def empty_table(self) -> None:
        self.candidates.append(
            Candidate(
                0, "issue_empty_table", "empty_table", "must_answer", None, "_total = 0",
                sql_value(f"The table {self.contract.name} is empty."), {"total_rows": "_total"}, ("pipeline_generation",),
            )
        )

    def schema(self) -> None:
        for i, spec in enumerate(self.contract.columns):
            if spec.name not in self.df.columns:
                self.add(
                    100 + i, f"issue_missing_column_{spec.name}", "missing_required_column", "must_answer", spec.name,
                    "true", sql_value(f"The contract lists {spec.name}, which the table lacks."),
                    {"expected_column": sql_value(spec.name), "expected_type": sql_value(spec.type)},
                    ("sql_model", "data_tests", "documentation"),
                )
                continue
            expected, actual = contract_type(spec.type), type_bucket(self.df.schema[spec.name].dataType)
            if expected and actual != "unknown" and expected != actual:
                self.add(
                    100 + i, f"issue_type_mismatch_{spec.name}", "type_mismatch", "optional_review", spec.name,
                    "true", sql_value(f"{spec.name} is stored as {actual} where the contract says {expected}."),
                    {"expected_type": sql_value(expected), "actual_type": sql_value(actual)},
                    ("sql_model", "data_tests"),
                )
        declared = {c.name for c in self.contract.columns}
        extra = [c for c in self.df.columns if c not in declared]
        if extra:
            self.add(
                199, "finding_extra_columns", "extra_columns", "info", None, "true",
                sql_value(f"Columns outside the contract: {', '.join(extra)}."),
                {"extra_columns": sql_value(",".join(extra))}, ("documentation",),
            )

    def required_nulls(self) -> None:
        for i, spec in enumerate(self.live()):
            if spec.nullable:
                continue
            nulls = self.nulls(spec.name)
            self.add(
                200 + i, f"issue_{spec.name}_required_nulls", "required_column_nulls", "must_answer", spec.name,
                f"{nulls} > 0",
                said(sql_value(f"The contract fills {spec.name}, yet it is empty in "), _percent(nulls, "_total"), "' of rows.'"),
                {"null_count": nulls, "total_rows": "_total", "null_rate": sql_rate_text(nulls, "_total"),
                 "contract_nullable": "'false'"},
                default_affects(spec.name),
            )

    def declared_checks(self) -> None:
        build = {
            "min_value": self._min_value,
            "max_column_value": self._max_column_value,
            "required_when": self._required_when,
        }
        ordinal = 500
        for spec in self.live():
            for check in spec.checks:
                if check.type in build:
                    build[check.type](ordinal, spec.name, check)
                    ordinal += 1

    def _min_value(self, ordinal: int, column: str, check: ColumnCheck) -> None:
        name = sql_name(column)
        bad = self.counted(f"{name} is null or {name} {'<' if check.inclusive else '<='} {sql_value(check.value)}")
        rule = f"{column} {'>=' if check.inclusive else '>'} {check.value}"
        self.add(
            ordinal, f"issue_{column}_below_min_value", "numeric_constraint", check.severity or "must_answer", column,
            f"{bad} > 0",
            said(sql_value(f"Rows that are empty or break {rule}: "), bad, "'.'"),
            {"affected_rows": bad, "total_rows": "_total", "min_value": sql_value(check.value),
             "inclusive": sql_value(check.inclusive)},
            check.affects or default_affects(column),
        )

    def _max_column_value(self, ordinal: int, column: str, check: ColumnCheck) -> None:
        if check.column not in self.df.columns:
            return
        bad = self.counted(f"{sql_name(column)} > {sql_name(check.column)}")
        self.add(
            ordinal, f"issue_{column}_greater_than_{check.column}", "cross_column_constraint",
            check.severity or "optional_review", column, f"{bad} > 0",
            said(sql_value(f"Rows with {column} above {check.column}: "), bad, "'.'"),
            {"affected_rows": bad, "total_rows": "_total", "compare_column": sql_value(check.column)},
            check.affects or ("data_tests", "documentation"),
        )

    def _required_when(self, ordinal: int, column: str, check: ColumnCheck) -> None:
        if check.column not in self.df.columns:
            return
        bad = self.counted(
            f"{sql_name(check.column)} = {sql_value(check.equals)} and {sql_name(column)} is null"
        )
        self.add(
            ordinal, f"issue_{column}_missing_when_{check.column}_{check.equals}", "conditional_required_value",
            check.severity or "must_answer", column, f"{bad} > 0",
            said(sql_value(f"Rows with {check.column} = {check.equals} and no {column}: "), bad, "'.'"),
            {"affected_rows": bad, "total_rows": "_total", "condition_column": sql_value(check.column),
             "condition_value": sql_value(check.equals), "required_column": sql_value(column)},
            check.affects or default_affects(column),
        )

    def decisions(self) -> None:
        for i, spec in enumerate(self.live()):
            if spec.null_rate_decision is None:
                continue
            nulls = self.nulls(spec.name)
            self.add(
                700 + i, f"issue_{spec.name}_null_rate", "business_rule_needed", "must_answer", spec.name,
                f"{sql_share(nulls, '_total')} >= {float(spec.null_rate_decision)!r}D",
                said(sql_value(f"No {spec.name} in "), _percent(nulls, "_total"), "' of rows.'"),
                {"null_count": nulls, "total_rows": "_total", "null_rate": sql_rate_text(nulls, "_total"),
                 "decision_threshold": sql_value(str(spec.null_rate_decision)),
                 "decision_reason": sql_value(spec.decision_reason)},
                ("metric_logic", "sql_model", "documentation"),
            )
        positive = self.contract.positive_column
        if positive and positive in self.df.columns:
            rows = self.counted(f"coalesce({sql_name(positive)}, 0) > 0")
            self.add(
                799, "issue_refund_handling_needed", "business_rule_needed", self.contract.positive_severity, positive,
                f"{rows} > 0", said(sql_value(f"Payments with a positive {positive}: "), rows, "'.'"),
                {"positive_column": sql_value(positive), "affected_rows": rows, "total_rows": "_total"},
                self.contract.positive_affects,
            )

    def findings(self) -> DataFrame:
        return emit(self.df.agg(*[F.expr(e).alias(n.strip("`")) for n, e in self.sums.items()]), self.candidates)


def shared_aggregate_findings(df: DataFrame, contract: SourceContract) -> DataFrame:
    """Empty table, schema, required nulls, declared checks and decision triggers: one scan."""
    table = _TableChecks(df, contract)
    table.empty_table()
    table.schema()
    table.required_nulls()
    table.declared_checks()
    table.decisions()
    return table.findings()


def key_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per key, with ``filled`` = 0 for the null key. Partial counts keep a hot key small."""
    return df.groupBy(F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("rows"), F.count(column).alias("filled")
    )


def duplicate_keys(df: DataFrame, column: str) -> DataFrame:
    """Every duplicated non-null key with its row count."""
    return key_counts(df, column).where(F.col("filled") > 1).select("value", F.col("rows").alias("duplicate_count"))


def duplicate_findings(df: DataFrame, contract: SourceContract) -> list[DataFrame]:
    """Per primary key column: a duplicate finding with its ten largest keys, or a uniqueness note."""
    frames = []
    for i, column in enumerate(c for c in contract.primary_keys if c in df.columns):
        counts = key_counts(df, column)
        # Both branches read the same grouped counts, so Spark reuses the exchange.
        top = (
            counts.where("filled > 1")
            .orderBy(F.col("rows").desc(), F.col("value"))
            .limit(EXAMPLES)
            .agg(F.expr("array_sort(collect_list(struct(-rows as n, cast(value as string) as v)))"))
            .scalar()
        )
        row = counts.agg(
            F.expr("coalesce(sum(rows), 0)").alias("_total"), F.expr("count_if(filled > 1)").alias("_duplicates")
        ).withColumn("_top", top)
        frames.append(
            emit(
                row,
                [
                    Candidate(
                        300 + i, f"issue_{column}_duplicates", "duplicate_key", "must_answer", column,
                        "_duplicates > 0", sql_value(f"Some keys in {column} occur more than once."),
                        {"duplicate_values": "_duplicates", "duplicate_key_count": "_duplicates",
                         "examples": "array_join(transform(_top, e -> concat(e.v, '=', -e.n)), ',')",
                         "total_rows": "_total"},
                        ("metric_logic", "sql_model", "data_tests"),
                    ),
                    Candidate(
                        300 + i, f"finding_{column}_unique", "uniqueness", "info", column,
                        "_total > 0 and _duplicates = 0", sql_value(f"Every key in {column} occurs once."),
                        {"duplicate_values": "0", "total_rows": "_total"}, ("documentation",),
                    ),
                ],
            )
        )
    return frames


def invalid_values(df: DataFrame, column: str, valid: tuple) -> DataFrame:
    """Every non-null value outside the list with its row count, largest first in any report."""
    allowed = [v for v in valid if v is not None]
    return (
        df.where(F.col(column).isNotNull() & ~F.col(column).isin(*allowed))
        .groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("row_count"))
    )


def valid_value_findings(df: DataFrame, contract: SourceContract) -> list[DataFrame]:
    """Per enumerated column: a finding about values outside the list, or a note of the observed ones."""
    frames = []
    specs = [c for c in contract.columns if c.valid_values and c.name in df.columns]
    for i, spec in enumerate(specs):
        name = spec.name
        allowed = ", ".join(sql_value(v) for v in spec.valid_values if v is not None)
        outside, inside = f"filled > 0 and value not in ({allowed})", f"filled > 0 and value in ({allowed})"
        row = key_counts(df, name).agg(
            F.expr("coalesce(sum(rows), 0)").alias("_total"),
            F.expr(f"coalesce(sum(if({outside}, rows, 0)), 0)").alias("_invalid"),
            F.expr(f"count_if({outside})").alias("_invalid_values"),
            F.expr(f"array_sort(collect_set(if({inside}, cast(value as string), null)))").alias("_observed"),
        )
        expected = sql_value(",".join(str(v) for v in spec.valid_values))
        frames.append(
            emit(
                row,
                [
                    Candidate(
                        400 + i, f"issue_{name}_invalid_values", "invalid_values", "must_answer", name,
                        "_invalid > 0", sql_value(f"{name} holds values that the contract does not list."),
                        {"expected_values": expected, "invalid_value_count": "_invalid_values",
                         "invalid_count": "_invalid", "total_rows": "_total"},
                        ("sql_model", "data_tests", "documentation"),
                    ),
                    Candidate(
                        400 + i, f"finding_{name}_accepted_values", "accepted_values", "info", name,
                        "_total > 0 and _invalid = 0",
                        sql_value(f"The contract lists all values of {name}."),
                        {"expected_values": expected, "observed_values": "array_join(_observed, ',')"},
                        ("documentation",),
                    ),
                ],
            )
        )
    return frames


def findings(df: DataFrame, contract: SourceContract) -> DataFrame:
    """All findings of one source; ``ordinal`` is the order of evaluation."""
    return union_all(
        [
            shared_aggregate_findings(df, contract),
            *duplicate_findings(df, contract),
            *valid_value_findings(df, contract),
        ]
    )


def combined_findings(tables: dict[str, DataFrame], contracts: dict[str, SourceContract]) -> DataFrame:
    """Findings of many sources, with ``source`` and ids prefixed by it."""
    return union_all(
        [
            findings(df, contracts[name])
            .withColumn("source", F.lit(name))
            .withColumn("id", F.concat(F.lit(f"{name}__"), F.col("id")))
            for name, df in tables.items()
        ]
    )


def report(found: DataFrame) -> DataFrame:
    """The must_answer, optional_review and info sections; at most one entry per contract check."""
    return (
        found.where(F.col("severity").isin("must_answer", "optional_review", "info"))
        .groupBy("severity")
        .agg(
            F.count(F.lit(1)).alias("finding_count"),
            F.array_join(F.array_sort(F.collect_list("id")), ",").alias("finding_ids"),
        )
    )


def counts(found: DataFrame) -> DataFrame:
    """Totals by severity, by type and overall."""
    return (
        found.groupingSets([["severity"], ["type"], []], "severity", "type")
        .agg(F.count(F.lit(1)).alias("finding_count"))
        .select("severity", "type", "finding_count")
    )


def severity_rank(column: Column) -> Column:
    rank = F.lit(len(fixed.SEVERITY_ORDER))
    for i, severity in reversed(list(enumerate(fixed.SEVERITY_ORDER))):
        rank = F.when(column == severity, i).otherwise(rank)
    return rank


def compact_evidence(evidence: Column) -> Column:
    """Keep counts, rates and the keys that name a place."""
    return F.map_filter(
        evidence,
        lambda k, v: k.endswith("count") | k.endswith("rate") | k.isin(*fixed.COMPACT_EVIDENCE_KEYS),
    )


def top_findings(found: DataFrame, limit: int = fixed.COMPACT_FINDING_LIMIT) -> DataFrame:
    """The most urgent findings in compact form."""
    return (
        found.withColumn("priority", severity_rank(F.col("severity")))
        .orderBy("priority", "source", "id")
        .limit(limit)
        .select(
            "priority", "source", "id", "type", "severity",
            F.substring("message", 1, fixed.COMPACT_MESSAGE_CHARS).alias("message"),
            "affects",
            compact_evidence(F.col("evidence")).alias("evidence"),
        )
    )
