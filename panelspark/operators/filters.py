"""Row filters."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.functions.semantics import (
    COMPARISONS,
    dtype,
    is_number,
    keep,
    member,
    missing,
    number,
)
from panelspark.operators.quantiles import exact_quantiles


def filter_rows(df: DataFrame, field: str, comparison: str, value: object) -> DataFrame:
    """Compare a column with a literal; numbers when the literal is one."""
    return df.where(keep(df, field, comparison, value))


having = filter_rows


def filter_set(
    df: DataFrame, field: str, values: Sequence[object], *, negate: bool = False
) -> DataFrame:
    inside = member(df, field, values)
    return df.where(~F.coalesce(inside, F.lit(False)) if negate else inside)


def filter_range(
    df: DataFrame, field: str, lower: float, upper: float, *, negate: bool = False
) -> DataFrame:
    """Inclusive range; the negated form keeps missing values."""
    if lower > upper:
        raise ValueError("range bounds are reversed")
    if not negate:
        return df.where(keep(df, field, "ge", lower) & keep(df, field, "le", upper))
    return df.where(~F.coalesce(number(df, field).between(lower, upper), F.lit(False)))


def filter_null(df: DataFrame, field: str, *, negate: bool = False) -> DataFrame:
    absent = missing(df, field)
    return df.where(~absent if negate else absent)


def drop_missing(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    condition: Column = F.lit(True)
    for field in fields:
        condition = condition & ~missing(df, field)
    return df.where(condition)


def quantile_filter(
    df: DataFrame,
    field: str,
    comparison: str,
    q: float,
    *,
    approximate: bool = False,
    block_rows: int | None = None,
) -> DataFrame:
    """Compare a column with its own quantile.

    The threshold is a scalar subquery: computed once, then a plain filter.
    ``approximate`` trades exactness for a bounded sketch.
    """
    if not 0 <= q <= 1:
        raise ValueError("quantile must be between 0 and 1")
    value = number(df, field)
    if approximate:
        threshold = df.agg(F.percentile_approx(value, q, 10_000).alias("__t"))
    else:
        threshold = exact_quantiles(df, [], value, {"__t": q}, block_rows=block_rows)
    test = COMPARISONS[comparison](value, threshold.scalar())
    return df.where(F.coalesce(test, F.lit(True)) if comparison == "ne" else test)


def read_filters(
    df: DataFrame, conditions: Sequence[tuple[str, str, object]]
) -> DataFrame:
    """AND of source-side conditions ``(field, operator, value)``.

    Unlike the step filters, text ``ne`` and ``not_contains`` drop missing values, and
    membership compares the column as text.
    """
    for field, comparison, value in conditions:
        dated = isinstance(dtype(df, field), T.DateType)
        if dated and isinstance(value, str) and comparison in COMPARISONS:
            day = dt.date.fromisoformat(value)  # YYYYMMDD or YYYY-MM-DD
            df = df.where(COMPARISONS[comparison](F.col(field), F.lit(day)))
        elif comparison in ("in", "not_in"):
            inside = F.col(field).cast("string").isin([str(v) for v in value])
            df = df.where(
                inside if comparison == "in" else ~F.coalesce(inside, F.lit(False))
            )
        elif is_number(value):
            df = df.where(keep(df, field, comparison, value))
        else:
            text = F.col(field).cast("string")
            if comparison in ("contains", "not_contains"):
                found = F.contains(text, F.lit(value))
                df = df.where(found if comparison == "contains" else ~found)
            else:
                df = df.where(COMPARISONS[comparison](text, F.lit(value)))
    return df


def conditional_counts(
    df: DataFrame, counts: Mapping[str, tuple[str, str, float]]
) -> DataFrame:
    """One row with a count per label of ``(field, comparison, value)``.

    A column without a single number counts its non-null rows instead.
    """
    columns = []
    for label, (field, comparison, value) in counts.items():
        x = number(df, field)
        hits = F.count_if(F.coalesce(COMPARISONS[comparison](x, F.lit(float(value))), F.lit(False)))
        present = F.count_if(~missing(df, field))
        columns.append(F.when(F.count(x) > 0, hits).otherwise(present).alias(label))
    return df.agg(*columns)


# The shape of a listed security code. Six digits and an exchange
# suffix; two prefixes belong to shares quoted in foreign currency.
VALID_CODE = r"^(?!900\d{3}\.SH$)(?!200\d{3}\.SZ$)\d{6}\.(SH|SZ|BJ)$"


def valid_entity_code(code: Column) -> Column:
    return F.coalesce(code.rlike(VALID_CODE), F.lit(False))
