"""Number coercion and predicate null rules, written once and reused everywhere.

* A value that is absent, unparsable or NaN is *missing* (null). Infinity stays.
* Comparisons with a missing value are false, except ``ne``, which is true.
* ``not_contains`` and every negated filter keep missing values.

Predicates come in two forms. ``keep`` is for ``where``: null already means "drop"
there, so it stays a bare comparison that Spark can push into the Parquet scan.
``flag`` is for a projected boolean column, which is never null.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text that is a number: decimal digits with an exponent, or infinity. A cast alone would
#: also take type suffixes ("1d") and hexadecimal floats.
NUMBER_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?[iI][nN][fF]([iI][nN][iI][tT][yY])?$"

COMPARISONS = {
    "gt": operator.gt,
    "ge": operator.ge,
    "eq": operator.eq,
    "ne": operator.ne,
    "le": operator.le,
    "lt": operator.lt,
}


def dtype(df: DataFrame, field: str) -> T.DataType:
    """Type of one column; a missing column fails here, before any job runs."""
    if field not in df.columns:
        raise ValueError(f"field is missing: {field}")
    return df.schema[field].dataType


def is_number(value: object) -> bool:
    return isinstance(value, (int, float))


def number(df: DataFrame, field: str) -> Column:
    """The column as a double, with everything that is not a number set to null."""
    kind, column = dtype(df, field), F.col(field)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        value = column.cast("double")
        return F.when(~F.isnan(value), value)
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return column.cast("double")
    text = F.trim(column.cast("string"))
    return F.when(text.rlike(NUMBER_TEXT), text.try_cast("double"))


def missing(df: DataFrame, field: str) -> Column:
    """True for null, and for NaN in a floating-point column."""
    column = F.col(field)
    if isinstance(dtype(df, field), (T.FloatType, T.DoubleType)):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def _comparable(df: DataFrame, field: str, value: object) -> Column:
    """Left side of a comparison: bare where Spark can push it down."""
    kind = dtype(df, field)
    if is_number(value):
        return F.col(field) if isinstance(kind, T.NumericType) else number(df, field)
    return F.col(field) if isinstance(kind, (T.StringType, T.DateType)) else F.col(field).cast("string")


def _literal(df: DataFrame, field: str, value: object) -> Column:
    """A literal of the column's own type where that loses nothing."""
    kind = dtype(df, field)
    if isinstance(value, bool):
        value = int(value)
    if isinstance(kind, T.IntegralType) and is_number(value) and float(value).is_integer():
        return F.lit(int(value))
    if isinstance(kind, T.DateType) and isinstance(value, str):
        return F.to_date(F.lit(value), "yyyyMMdd")
    return F.lit(float(value)) if is_number(value) else F.lit(value)


def keep(df: DataFrame, field: str, comparison: str, value: object) -> Column:
    """Predicate for ``where``: rows with a missing value follow the table above."""
    if comparison in ("contains", "not_contains"):
        found = F.contains(F.col(field).cast("string"), F.lit(str(value)))
        return found if comparison == "contains" else F.col(field).isNull() | ~found
    if isinstance(value, str) and isinstance(dtype(df, field), T.NumericType):
        # A number never equals text, and has no place in its order.
        return F.lit(comparison == "ne")
    left, right = _comparable(df, field, value), _literal(df, field, value)
    test = COMPARISONS[comparison](left, right)
    floating = isinstance(dtype(df, field), (T.FloatType, T.DoubleType))
    if comparison == "ne":
        return left.isNull() | test
    if comparison in ("gt", "ge") and floating:
        return test & ~F.isnan(left)  # Spark orders NaN above every number
    return test


def flag(df: DataFrame, field: str, comparison: str, value: object) -> Column:
    """The same predicate as a boolean column that is never null."""
    return F.coalesce(keep(df, field, comparison, value), F.lit(False))


def member(df: DataFrame, field: str, values: Sequence[object]) -> Column:
    """Set membership: numbers among numbers, text among text, with no cast between them.

    A list of numbers alone reads a text column as numbers.
    """
    kind = dtype(df, field)
    numbers = [v for v in values if is_number(v) and not isinstance(v, bool)]
    if isinstance(kind, T.NumericType):
        listed = numbers
    elif numbers and len(numbers) == len(values):
        return number(df, field).isin([float(v) for v in numbers])
    elif isinstance(kind, T.StringType):
        listed = [v for v in values if isinstance(v, str)]
    else:
        listed = list(values)
    return F.col(field).isin(listed) if listed else F.lit(False)


def ordering(df: DataFrame, field: str) -> Column:
    """A sort key in which NaN counts as missing."""
    if isinstance(dtype(df, field), (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(field), F.col(field))
    return F.col(field)


def key_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    take: Sequence[str] = (),
    hint: Callable[[DataFrame], DataFrame] = lambda table: table,
    null_keys: bool = True,
) -> DataFrame:
    """Equi-join keeping ``left`` columns and the ``take`` columns of the right side.

    With ``null_keys`` a null key matches a null key. Spark turns ``<=>`` into
    ordinary equi-join keys (a default value plus a null flag), so hash and sort-merge
    joins and adaptive skew splitting stay available, but a partitioning of the bare
    columns is not reused. Callers whose keys are never null pass False and save that
    shuffle. Right keys get names of their own, so a frame can be joined with an
    aggregate of itself.
    """
    table = hint(right.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *take))
    condition = F.lit(True)
    for key in keys:
        mine, other = F.col(key), F.col(f"__k_{key}")
        condition = condition & (mine.eqNullSafe(other) if null_keys else mine == other)
    joined = left.join(table, condition, how)
    if how in ("left_semi", "left_anti"):
        return joined
    return joined.select(*left.columns, *take)


def require(frame: DataFrame, ok: Column, message: str) -> DataFrame:
    """Fail the job, lazily, on the first row for which ``ok`` is not true."""
    return frame.where(
        F.when(F.coalesce(ok, F.lit(False)), True).otherwise(
            F.raise_error(F.lit(message)).cast("boolean")
        )
    )


def divide(top: Column, bottom: Column) -> Column:
    """Division that yields a signed infinity over zero and null for 0/0."""
    return F.when(bottom != 0, F.try_divide(top, bottom)).when(
        (bottom == 0) & (top != 0), F.signum(top) * F.lit(float("inf"))
    )
