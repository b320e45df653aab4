"""Named metrics by dimension, time and pattern.

A metric is summed at its base table and rolled up one key at a time on the way to the dimension
(payment → invoice → subscription → customer or plan). Each step groups before it joins, so every
shuffle carries partial sums and a hot key arrives as one row per task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgergrain import fixed_values as fixed
from ledgergrain.functions.time_phrases import in_date_phrase, in_month_phrase
from ledgergrain.operators.joins import invoices_with_payments
from ledgergrain.operators.profile import union_all
from ledgergrain.specs import Dimension, Metric, Relationship, TimePhrase


@dataclass(frozen=True)
class MetricRequest:
    """``pattern``: aggregate, group_by, top_k or count."""

    metric: str
    pattern: str = "aggregate"
    dimensions: tuple[str, ...] = ()
    phrase: str = "all_time"
    month: str | None = None
    limit: int = 1
    default_filters: bool = True
    date_column: str | None = None


@dataclass(frozen=True)
class SemanticLayer:
    metrics: dict[str, Metric] = field(default_factory=lambda: fixed.METRICS)
    dimensions: dict[str, Dimension] = field(default_factory=lambda: fixed.DIMENSIONS)
    phrases: dict[str, TimePhrase] = field(default_factory=lambda: fixed.TIME_PHRASES)
    relationships: tuple[Relationship, ...] = fixed.RELATIONSHIPS


def subscription_adjustments(tables: dict[str, DataFrame]) -> DataFrame:
    """Discounts and refunds per subscription; refunds are summed per invoice before they meet discounts."""
    paid = invoices_with_payments(tables["stripe_invoices"], tables["stripe_payments"])
    return paid.groupBy("subscription_id").agg(
        F.sum(F.coalesce("discount_amount", F.lit(0))).alias("discount_amount"),
        F.sum("refund_amount").alias("refund_amount"),
    )


def base_rows(tables: dict[str, DataFrame], metric: Metric) -> DataFrame:
    """The base table of a metric, with the pre-aggregated columns it needs."""
    if metric.needs == "invoice_payments":
        invoices = tables["stripe_invoices"]
        return invoices_with_payments(invoices, tables["stripe_payments"])
    if metric.needs == "subscription_adjustments":
        return tables["fact_subscriptions"].join(subscription_adjustments(tables), "subscription_id", "left")
    return tables[metric.base_source]


def _parents(source: str, relationships: tuple[Relationship, ...]) -> list[Relationship]:
    return [r for r in relationships if r.right_source == source]


def _leads_to(source: str, wanted: set[str], relationships: tuple[Relationship, ...]) -> set[str]:
    """Wanted sources at or above a source."""
    found = {source} & wanted
    for edge in _parents(source, relationships):
        found |= _leads_to(edge.left_source, wanted, relationships)
    return found


class _RollUp:
    """Carries additive columns from a base table up to the dimensions, one key at a time."""

    def __init__(self, tables, relationships, dimensions: list[Dimension], measures: list[str], distinct: str | None):
        self.tables, self.relationships = tables, relationships
        self.measures, self.distinct = measures, distinct
        self.wanted: dict[str, list[str]] = {}
        for d in dimensions:
            columns = self.wanted.setdefault(d.source, [])
            columns += [c for c in d.columns if c not in columns]

    def edges(self, source: str) -> list[Relationship]:
        """Edges to the parents through which a wanted dimension is reached."""
        above = set(self.wanted)
        return [
            e for e in _parents(source, self.relationships) if _leads_to(e.left_source, above, self.relationships)
        ]

    @staticmethod
    def _keys(edge: Relationship) -> list[str]:
        return [f"_{edge.id}_{i}" for i in range(len(edge.right_keys))]

    def carried(self, source: str) -> list[Column]:
        """Dimension columns of a source, and its keys to the next ones."""
        columns = [F.col(c) for c in self.wanted.get(source, [])]
        for edge in self.edges(source):
            columns += [F.col(k).alias(n) for k, n in zip(edge.right_keys, self._keys(edge), strict=True)]
        return columns

    def lift(self, rows: DataFrame, source: str) -> DataFrame:
        kept, pending = list(self.wanted.get(source, [])), self.edges(source)
        while pending:
            edge, *rest = pending
            others = [n for e in rest for n in self._keys(e)]
            folded = self._fold(rows, [*kept, *self._keys(edge), *others])
            ends = [f"_end_{i}" for i in range(len(edge.left_keys))]
            parent = self.tables[edge.left_source].select(
                *[F.col(k).alias(e) for k, e in zip(edge.left_keys, ends, strict=True)],
                *self.carried(edge.left_source),
            )
            on = [F.col(k) == F.col(e) for k, e in zip(self._keys(edge), ends, strict=True)]
            # Rows without a parent stay, under null dimensions.
            rows = folded.join(parent, on, "left").drop(*self._keys(edge), *ends)
            kept += self.wanted.get(edge.left_source, [])
            pending = rest + self.edges(edge.left_source)
        return rows

    def _fold(self, rows: DataFrame, by: list[str]) -> DataFrame:
        if self.distinct:
            return rows.select(*by, "_distinct").distinct()
        return rows.groupBy(*by).agg(*[F.sum(m).alias(m) for m in self.measures])


def _time_filtered(rows: DataFrame, metric: Metric, request: MetricRequest, layer: SemanticLayer) -> DataFrame:
    if request.month is not None:
        if metric.date_column is None:
            raise ValueError(f"{metric.name} has no month column")
        rows = rows.where(F.col(metric.date_column) == request.month)
    phrase = layer.phrases[request.phrase]
    if phrase.type == "all_time":
        return rows
    if request.date_column:
        return in_date_phrase(rows, request.date_column, phrase)
    if metric.date_column is None:
        raise ValueError(f"{metric.name} has no date column for {phrase.name}")
    return in_month_phrase(rows, metric.date_column, phrase)


def metric_frame(tables: dict[str, DataFrame], request: MetricRequest, layer: SemanticLayer | None = None) -> DataFrame:
    """The metric by the requested dimensions, unordered."""
    layer = layer or SemanticLayer()
    metric = layer.metrics[request.metric]
    dimensions = [layer.dimensions[d] for d in request.dimensions]
    rows = base_rows(tables, metric)
    if request.default_filters:
        for condition in metric.filters:
            rows = rows.where(condition)
    rows = _time_filtered(rows, metric, request, layer)

    wanted = {d.source for d in dimensions}
    reachable = _leads_to(metric.base_source, wanted, layer.relationships)
    if wanted - reachable:
        raise ValueError(f"{metric.name} cannot be split by {sorted(wanted - reachable)}")

    measures = [name for name, _ in metric.sums]
    roll = _RollUp(tables, layer.relationships, dimensions, measures, metric.distinct)
    values = [F.expr(expression).alias(f"_m_{name}") for name, expression in metric.sums]
    if metric.distinct:
        values = [F.col(metric.distinct).alias("_distinct")]
    roll.measures = [f"_m_{name}" for name in measures]
    rows = rows.select(*roll.carried(metric.base_source), *values)
    by = list(dict.fromkeys(c for d in dimensions for c in d.columns))
    grouped = roll.lift(rows, metric.base_source).groupBy(*by)
    if metric.distinct:
        return grouped.agg(F.count_distinct("_distinct").alias(metric.name))
    sums = grouped.agg(*[F.sum(f"_m_{name}").alias(f"_s_{name}") for name in measures])
    named = sums.select(*by, *[F.col(f"_s_{name}").alias(name) for name in measures])
    return named.select(*by, F.expr(metric.final).cast("double").alias(metric.name))


def run(tables: dict[str, DataFrame], request: MetricRequest, layer: SemanticLayer | None = None) -> DataFrame:
    """Answer a request by its pattern. Top-k breaks ties by the dimension columns, so it is repeatable."""
    frame = metric_frame(tables, request, layer)
    if request.pattern == "top_k":
        keys = [c for c in frame.columns if c != request.metric]
        return frame.orderBy(F.col(request.metric).desc_nulls_last(), *keys).limit(request.limit)
    if request.pattern in ("aggregate", "group_by", "count"):
        return frame
    raise ValueError(f"unknown pattern: {request.pattern}")


def ambiguous_groups(tables: dict[str, DataFrame], layer: SemanticLayer | None = None) -> DataFrame:
    """Every reading of an ambiguous term with its all-time value, so that a user can choose."""
    layer = layer or SemanticLayer()
    groups: dict[str, list[Metric]] = {}
    for metric in layer.metrics.values():
        if metric.ambiguity_group:
            groups.setdefault(metric.ambiguity_group, []).append(metric)
    frames = [
        metric_frame(tables, MetricRequest(m.name), layer).select(
            F.lit(group).alias("ambiguity_group"), F.lit(m.name).alias("metric"),
            F.col(m.name).cast("double").alias("value"), F.lit(len(members)).cast("bigint").alias("choices"),
        )
        for group, members in groups.items()
        if len(members) > 1
        for m in members
    ]
    return union_all(frames)


def month_filter(df: DataFrame, month_column: str, month: str, date_column: str | None = None) -> DataFrame:
    """Rows of one month key. With the date column the range also reaches the file scan."""
    kept = df.where(F.col(month_column) == month)
    if date_column is None:
        return kept
    start = F.to_date(F.lit(f"{month}-01"))
    kind = df.schema[date_column].dataType
    return kept.where(
        (F.col(date_column) >= start.cast(kind)) & (F.col(date_column) < F.add_months(start, 1).cast(kind))
    )


def amount_range(payments: DataFrame) -> DataFrame:
    return payments.agg(
        F.min("successful_amount").cast("double").alias("min_successful_amount"),
        F.max("successful_amount").cast("double").alias("max_successful_amount"),
    )


def monthly_stats(invoices: DataFrame) -> DataFrame:
    """Smallest, largest and mean invoice per month."""
    return invoices.groupBy("invoice_month").agg(
        F.min("invoice_amount").cast("double").alias("min_amount"),
        F.max("invoice_amount").cast("double").alias("max_amount"),
        (F.sum("invoice_amount").cast("double") / F.count("invoice_amount")).alias("avg_amount"),
    )


def net_mrr_by_segment(tables: dict[str, DataFrame]) -> DataFrame:
    """Gross, discount, refund and net MRR per segment, each subscription's MRR once."""
    subscriptions = tables["fact_subscriptions"].join(subscription_adjustments(tables), "subscription_id", "left")
    by_customer = subscriptions.groupBy("customer_id").agg(
        F.sum("mrr_amount").alias("gross"),
        F.sum(F.coalesce("discount_amount", F.lit(0))).alias("discount"),
        F.sum(F.coalesce("refund_amount", F.lit(0))).alias("refund"),
    )
    joined = by_customer.join(tables["dim_customers"], "customer_id")
    sums = joined.groupBy("customer_segment").agg(
        F.sum("gross").alias("g"), F.sum("discount").alias("d"), F.sum("refund").alias("r")
    )
    return sums.select(
        "customer_segment",
        F.col("g").cast("double").alias("gross_mrr"),
        F.col("d").cast("double").alias("discount_amount"),
        F.col("r").cast("double").alias("refund_amount"),
        (F.col("g") - F.col("d") - F.col("r")).cast("double").alias("net_mrr"),
    ).orderBy(F.col("net_mrr").desc(), "customer_segment")
