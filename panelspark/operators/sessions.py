"""Session numbers: the rank of each distinct order value in the whole frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.functions.semantics import dtype
from panelspark.operators.layout import lay_out

# A DATE column has at most 3,652,059 values (years 1-9999), which bounds every
# calendar table: it can be sorted in one task and broadcast.
DATE_VALUES = 3_652_059


def session_numbers(df: DataFrame, order_by: str, number: str) -> DataFrame:
    """``(order_by, number)`` with one row per distinct value, numbered from 1."""
    values = df.select(order_by).where(F.col(order_by).isNotNull()).distinct()
    bound = DATE_VALUES if isinstance(dtype(df, order_by), T.DateType) else None
    return lay_out(values, [], [F.col(order_by).asc()], max_group_rows=bound).numbered(number)


def with_session_number(
    df: DataFrame, order_by: str, number: str, sessions: DataFrame | None = None
) -> DataFrame:
    """Attach the session number. ``sessions`` replaces the frame's own calendar."""
    calendar = sessions if sessions is not None else df
    numbers = session_numbers(calendar.select(order_by), order_by, number)
    if isinstance(dtype(df, order_by), T.DateType):
        numbers = F.broadcast(numbers)
    return df.join(numbers, order_by, "left").select(*df.columns, number)
