"""Frozen descriptions of contracts, relationships, metrics, rules and tests."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ColumnCheck:
    """A declared check: ``min_value``, ``max_column_value`` or ``required_when``."""

    type: str
    value: float | None = None
    inclusive: bool = True
    column: str | None = None
    equals: object = None
    severity: str | None = None
    affects: tuple[str, ...] | None = None


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: str
    nullable: bool
    primary_key: bool = False
    valid_values: tuple = ()
    checks: tuple[ColumnCheck, ...] = ()
    null_rate_decision: float | None = None
    decision_reason: str | None = None
    logical_type: str | None = None


@dataclass(frozen=True)
class SourceContract:
    name: str
    columns: tuple[ColumnSpec, ...]
    grain: tuple[str, ...] = ()
    final_mart: str | None = None
    positive_column: str | None = None
    positive_severity: str = "must_answer"
    positive_affects: tuple[str, ...] = ("metric_logic", "sql_model", "documentation")

    def column(self, name: str) -> ColumnSpec | None:
        return next((c for c in self.columns if c.name == name), None)

    @property
    def primary_keys(self) -> tuple[str, ...]:
        return tuple(c.name for c in self.columns if c.primary_key)


@dataclass(frozen=True)
class CatalogSource:
    name: str
    role: str
    entity: str
    grain: str
    primary_key: str


@dataclass(frozen=True)
class Relationship:
    """A key edge from the one side (left) to the many side (right)."""

    id: str
    left_source: str
    right_source: str
    left_key: str | tuple[str, ...]
    right_key: str | tuple[str, ...]
    left_key_unique: bool = False
    right_key_nullable_allowed: bool = True
    max_unmatched_left_rate: float = 1.0
    max_unmatched_right_rate: float = 1.0
    left_issue_id: str | None = None
    right_issue_id: str | None = None
    relationship_type: str = "one_to_many"

    @property
    def left_keys(self) -> tuple[str, ...]:
        return (self.left_key,) if isinstance(self.left_key, str) else tuple(self.left_key)

    @property
    def right_keys(self) -> tuple[str, ...]:
        return (self.right_key,) if isinstance(self.right_key, str) else tuple(self.right_key)


@dataclass(frozen=True)
class Metric:
    """A metric is a set of additive sums over base rows and a final expression over those sums.

    ``distinct`` names the column of a count-distinct metric instead.
    """

    name: str
    base_source: str
    sums: tuple[tuple[str, str], ...] = ()
    final: str | None = None
    distinct: str | None = None
    filters: tuple[str, ...] = ()
    date_column: str | None = None
    ambiguity_group: str | None = None
    needs: str | None = None


@dataclass(frozen=True)
class Dimension:
    name: str
    source: str
    key: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class TimePhrase:
    name: str
    type: str
    days: int | None = None


@dataclass(frozen=True)
class RuleOption:
    id: str
    label: str
    aliases: tuple[str, ...] = ()
    resolved_rule: str = ""
    implementation: str = ""


@dataclass(frozen=True)
class TextRule:
    """A clarification rule: every ``all_any`` group must have a hit, and so on."""

    id: str
    question_id: str
    all_any: dict[str, tuple[str, ...]] = field(default_factory=dict)
    any_any: dict[str, tuple[str, ...]] = field(default_factory=dict)
    none_any: dict[str, tuple[str, ...]] = field(default_factory=dict)
    missing_explicit_choice: bool = False
    options: tuple[RuleOption, ...] = ()
    enabled: bool = True


@dataclass(frozen=True)
class MonthlyMetricMart:
    """One staging projection and one monthly sum on top of it."""

    name: str
    source: str
    staging_model: str
    staging_columns: tuple[str, ...]
    month_column: str
    value_column: str
    output_metric: str
    coalesce_value: bool = True


@dataclass(frozen=True)
class DataTest:
    """``kind``: not_null, unique, accepted_values, relationship, month_key, metrics_not_null, custom."""

    name: str
    kind: str
    model: str
    columns: tuple[str, ...] = ()
    values: tuple = ()
    parent: str | None = None
    parent_columns: tuple[str, ...] = ()
    sql: str | None = None
