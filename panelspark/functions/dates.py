"""Session dates: text keys, period ends and calendar offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.functions.semantics import dtype


def as_date(df: DataFrame, field: str) -> Column:
    """A date from a date, timestamp or ``YYYYMMDD`` column; null when malformed."""
    kind, column = dtype(df, field), F.col(field)
    if isinstance(kind, T.DateType):
        return column
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return column.cast("date")
    text = F.trim(column.cast("string"))
    return F.when(text.rlike(r"^\d{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date"))


def compact(day: Column) -> Column:
    """A date as ``YYYYMMDD`` text."""
    return F.date_format(day, "yyyyMMdd")


def period_end(day: Column, frequency: str) -> Column:
    """Last calendar day of the week (Sunday), month, quarter or year of ``day``."""
    if frequency == "week":
        return F.date_add(F.date_trunc("week", day).cast("date"), 6)
    if frequency == "month":
        return F.last_day(day)
    if frequency == "quarter":
        return F.last_day(F.add_months(F.date_trunc("quarter", day).cast("date"), 2))
    if frequency == "year":
        return F.make_date(F.year(day), F.lit(12), F.lit(31))
    raise ValueError(f"unknown frequency: {frequency}")


def date_offset(day: Column, amount: int, unit: str) -> Column:
    """Calendar offset; month and year steps clamp to the end of the month."""
    if unit == "day":
        return F.date_add(day, amount)
    if unit == "week":
        return F.date_add(day, 7 * amount)
    if unit in ("month", "year"):
        months = amount * (12 if unit == "year" else 1)
        moved = F.add_months(day, months)
        return moved
    raise ValueError(f"unknown offset unit: {unit}")
