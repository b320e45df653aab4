"""Small column expressions: money, rates, month keys, finding structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
MONTH_PATTERN = "^[0-9]{4}-(0[1-9]|1[0-2])$"


def money(column: Column | str) -> Column:
    """Exact money: sums and equality do not depend on row order."""
    return (F.col(column) if isinstance(column, str) else column).cast(MONEY)


def as_double(column: Column | str) -> Column:
    """Money leaves the engine as a double, after all arithmetic is done."""
    return (F.col(column) if isinstance(column, str) else column).cast("double")


def or_zero(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0))


def sql_value(value: object) -> str:
    """A configured value as a SQL literal."""
    if value is None:
        return "cast(null as string)"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return repr(value)
    escaped = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def sql_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def sql_strings(values) -> str:
    return f"cast(array({', '.join(sql_value(v) for v in values)}) as array<string>)"


def sql_share(part: str, whole: str) -> str:
    """Unrounded share for threshold comparison; an empty whole gives 0."""
    return f"coalesce(try_divide(cast({part} as double), cast({whole} as double)), 0D)"


def sql_rate(part: str, whole: str) -> str:
    """Share rounded to 4 places."""
    return f"round({sql_share(part, whole)}, 4)"


def sql_rate_text(part: str, whole: str) -> str:
    """A rate as text with 4 places, never in scientific notation."""
    return f"cast({sql_rate(part, whole)} as decimal(10,4))"


def month_key(column: Column | str) -> Column:
    """``yyyy-MM`` text of a date or timestamp; only for building month keys from dates."""
    c = F.col(column) if isinstance(column, str) else column
    return F.substring(c.cast("date").cast("string"), 1, 7)


def is_month_key(column: Column | str) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return c.cast("string").rlike(MONTH_PATTERN)
