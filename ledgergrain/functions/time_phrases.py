"""Time phrases anchored at the newest date in the data, as half-open ranges [start, end)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgergrain.functions.columns import MONTH_PATTERN
from ledgergrain.specs import TimePhrase


def phrase_bounds(phrase: TimePhrase, anchor: Column) -> tuple[Column, Column] | None:
    """Start and end date of a phrase for an anchor date; ``None`` means no restriction."""
    month = F.trunc(anchor, "MM")
    quarter = F.trunc(anchor, "QUARTER")
    if phrase.type == "all_time":
        return None
    if phrase.type == "current_calendar_month":
        return month, F.add_months(month, 1)
    if phrase.type == "previous_calendar_month":
        return F.add_months(month, -1), month
    if phrase.type == "current_quarter":
        return quarter, F.add_months(quarter, 3)
    if phrase.type == "previous_quarter":
        return F.add_months(quarter, -3), quarter
    if phrase.type == "rolling_days":
        end = F.date_add(anchor, 1)
        return F.date_sub(end, phrase.days), end
    raise ValueError(f"unknown time phrase type: {phrase.type}")


def newest(df: DataFrame, column: str) -> Column:
    """The newest value as a scalar subquery: Spark runs it first and pushes the result into the scan."""
    return df.agg(F.max(column)).scalar()


def in_date_phrase(df: DataFrame, column: str, phrase: TimePhrase) -> DataFrame:
    """Rows of a date or timestamp column that fall into the phrase."""
    bounds = phrase_bounds(phrase, newest(df, column).cast("date"))
    if bounds is None:
        return df
    start, end = (b.cast(df.schema[column].dataType) for b in bounds)
    return df.where((F.col(column) >= start) & (F.col(column) < end))


def in_month_phrase(df: DataFrame, column: str, phrase: TimePhrase) -> DataFrame:
    """Rows of a ``yyyy-MM`` text column that fall into the phrase, compared as text."""
    if phrase.type == "rolling_days":
        raise ValueError(f"{phrase.name} needs a date column; {column} holds month keys")
    valid = df.where(F.col(column).rlike(MONTH_PATTERN))
    anchor = F.to_date(F.concat(newest(valid, column), F.lit("-01")))
    bounds = phrase_bounds(phrase, anchor)
    if bounds is None:
        return df
    start, end = (F.substring(b.cast("string"), 1, 7) for b in bounds)
    return df.where((F.col(column) >= start) & (F.col(column) < end))
