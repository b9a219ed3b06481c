"""As-of join: the nearest earlier, later or closest row of another table per group.

Both tables are stacked and ordered by time inside each group, and the latest right row
is carried forward. That is one shuffle and a linear pass, with no range condition; a
group too large for one task is cut into blocks by the layout.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.functions.semantics import dtype, number, require
from panelspark.operators.layout import lay_out


def ordinal(df: DataFrame, field: str) -> Column:
    """A time key as a double: days for dates, seconds for timestamps, else raw."""
    kind = dtype(df, field)
    if isinstance(kind, T.DateType):
        return F.unix_date(field).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(field).cast("timestamp")) / F.lit(1e6)
    return number(df, field)


def _carried(
    left: DataFrame,
    right: DataFrame,
    group_by: Sequence[str],
    tie_break: Sequence[str],
    direction: str,
    output: str,
    max_group_rows: int | None,
    block_rows: int | None,
) -> DataFrame:
    """Left rows plus ``output``: the struct of the last right row at or before them."""
    empty = F.lit(None).cast(right.schema["__right"].dataType)
    ties = [F.lit(None).cast(right.schema[c].dataType).alias(c) for c in tie_break]
    rows = left.select(
        *[F.col(g) for g in group_by],
        "__t",
        F.lit(1).alias("__side"),
        *ties,
        empty.alias("__right"),
        F.struct(*left.columns).alias("__left"),
    ).unionByName(
        right.select(
            *group_by,
            "__t",
            F.lit(0).alias("__side"),
            *tie_break,
            "__right",
            F.lit(None).cast(left.schema).alias("__left"),
        )
    )
    forward = direction == "forward"
    order = [
        F.col("__t").desc() if forward else F.col("__t").asc(),
        F.col("__side"),
        # Of duplicate right times, backward takes the last and forward the first.
        *[F.col(c).desc() if forward else F.col(c).asc() for c in tie_break],
    ]
    layout = lay_out(
        rows, group_by, order, max_group_rows=max_group_rows, block_rows=block_rows
    )
    return (
        layout.last_seen(F.col("__right"), output)
        .where(F.col("__side") == 1)
        .select("__left.*", output)
    )


def asof_join(
    df: DataFrame,
    right: DataFrame,
    group_by: Sequence[str],
    order_by: str,
    right_order_by: str,
    fields: Mapping[str, str],
    *,
    tolerance: float,
    direction: str = "backward",
    right_tie_break: Sequence[str] = (),
    max_group_rows: int | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Copy ``{right field: output}`` from the matching right row, if within tolerance.

    The tolerance is inclusive and in key units: days for dates, seconds for
    timestamps, raw for numbers. An exact match counts. ``nearest`` prefers the earlier
    row on equal distance.
    """
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError(f"unknown direction: {direction}")
    if tolerance < 0:
        raise ValueError("tolerance must not be negative")
    for output in fields.values():
        if output in df.columns:
            raise ValueError(f"output field already exists: {output}")
    message = "as-of keys must be numbers, dates or timestamps"
    left = df.withColumn("__t", ordinal(df, order_by))
    left = require(left, F.col("__t").isNotNull(), message)
    ties = [f"__tie{i}" for i in range(len(right_tie_break))]
    time = ordinal(right, right_order_by)
    source = require(right, time.isNotNull(), message).select(
        *group_by,
        time.alias("__t"),
        *[F.col(c).alias(t) for c, t in zip(right_tie_break, ties)],
        F.struct(time.alias("t"), *[F.col(f).alias(o) for f, o in fields.items()]).alias(
            "__right"
        ),
    )
    wanted = ["backward", "forward"] if direction == "nearest" else [direction]
    found = left
    for way in wanted:
        found = _carried(
            found, source, group_by, ties, way, f"__{way}", max_group_rows, block_rows
        )

    def within(way: str) -> Column:
        hit = F.col(f"__{way}")
        return F.when(F.abs(F.col("__t") - hit["t"]) <= F.lit(float(tolerance)), hit)

    if direction == "nearest":
        back, ahead = within("backward"), within("forward")
        closer = F.col("__t") - back["t"] <= ahead["t"] - F.col("__t")
        match = F.when(back.isNull() | ~F.coalesce(closer, F.lit(True)), ahead).otherwise(back)
    else:
        match = within(direction)
    return found.withColumn("__match", match).select(
        *df.columns, *[F.col("__match")[o].alias(o) for o in fields.values()]
    )
