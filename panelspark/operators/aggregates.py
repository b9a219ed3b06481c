"""Grouped and global aggregation, resampling, and one row per group."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.dates import as_date, compact, period_end
from panelspark.functions.semantics import key_join, missing, number, ordering, require
from panelspark.operators.layout import fits_one_task
from panelspark.operators.quantiles import exact_quantiles

NUMERIC = {
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "std": F.stddev_samp,
}


@dataclass(frozen=True)
class Agg:
    """``output = function(field)``; ``q`` belongs to the quantile function."""

    output: str
    field: str
    function: str
    q: float | None = None

    @property
    def level(self) -> float | None:
        if self.function == "median":
            return 0.5
        if self.function != "quantile":
            return None
        if self.q is None or not 0 <= self.q <= 1:
            raise ValueError("quantile needs q between 0 and 1")
        return float(self.q)


def _column(df: DataFrame, agg: Agg, order_by: Sequence[str]) -> Column:
    present = F.when(~missing(df, agg.field), F.col(agg.field))
    if agg.function == "count":
        return F.count(present)
    if agg.function == "count_distinct":
        return F.count_distinct(present)
    if agg.function == "sum":
        return F.coalesce(F.sum(number(df, agg.field)), F.lit(0.0))
    if agg.function in NUMERIC:
        return NUMERIC[agg.function](number(df, agg.field))
    if agg.function in ("first", "last"):
        if not order_by:
            raise ValueError(f"{agg.function} needs order_by: rows have no order of their own")
        key = F.struct(*order_by) if len(order_by) > 1 else F.col(order_by[0])
        pick = F.min_by if agg.function == "first" else F.max_by
        return pick(F.col(agg.field), F.when(present.isNotNull(), key))
    raise ValueError(f"unknown aggregate: {agg.function}")


def aggregate(
    df: DataFrame,
    group_by: Sequence[str],
    aggs: Sequence[Agg],
    *,
    order_by: Sequence[str] = (),
    max_group_rows: int | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Group and aggregate; null keys form a group of their own.

    ``order_by`` says what "first" and "last" mean. Everything except the exact
    quantiles combines before the shuffle. Quantiles of a group too large for one task
    are computed across tasks and joined on.
    """
    keys = list(group_by)
    ranked = [a for a in aggs if a.level is not None]
    whole = not ranked or (block_rows is None and fits_one_task(df, keys, max_group_rows))
    if whole:
        # One buffer of values per field serves all of its levels.
        levels = {f: sorted({a.level for a in ranked if a.field == f}) for f in dict.fromkeys(a.field for a in ranked)}
        buffers = {f: f"__levels_{i}" for i, f in enumerate(levels)}
        found = df.groupBy(*keys).agg(
            *[_column(df, a, order_by).alias(a.output) for a in aggs if a.level is None],
            *[
                F.percentile(number(df, f), F.array(*map(F.lit, levels[f]))).alias(name)
                for f, name in buffers.items()
            ],
        )
        return found.select(
            *keys,
            *[
                a.output
                if a.level is None
                else F.get(buffers[a.field], F.lit(levels[a.field].index(a.level))).alias(a.output)
                for a in aggs
            ],
        )
    plain = [a for a in aggs if a.level is None]
    result = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__rows"),
        *[_column(df, a, order_by).alias(a.output) for a in plain],
    )
    for field in dict.fromkeys(a.field for a in ranked):
        levels = {a.output: a.level for a in ranked if a.field == field}
        part = exact_quantiles(
            df,
            keys,
            number(df, field),
            levels,
            max_group_rows=max_group_rows,
            block_rows=block_rows,
        )
        if keys:
            result = key_join(result, part, keys, "left", list(levels))
        else:
            result = result.withColumns({n: part.select(n).scalar() for n in levels})
    return result.select(*keys, *[a.output for a in aggs])


def summarize(df: DataFrame, aggs: Sequence[Agg], **options) -> DataFrame:
    """The same functions over all rows: exactly one row, also for empty input."""
    return aggregate(df, [], aggs, **options)


def weighted_mean(
    df: DataFrame, output: str, field: str, weight: str, group_by: Sequence[str]
) -> DataFrame:
    """Σwx/Σw over rows that have both; a bad weight fails the job."""
    x, w = number(df, field), number(df, weight)
    fail = F.raise_error(F.lit("a weight is below zero")).cast("double")
    valid = F.when(x.isNotNull(), F.when(w < 0, fail).otherwise(w))
    sums = df.groupBy(*group_by).agg(
        F.sum(x * valid).alias("__top"), F.sum(valid).alias("__bottom")
    )
    checked = require(
        sums, F.col("__bottom") > 0, "the weights of a group add up to nothing"
    )
    return checked.select(
        *group_by, F.try_divide(F.col("__top"), F.col("__bottom")).alias(output)
    )


def resample(
    df: DataFrame,
    group_by: Sequence[str],
    order_by: str,
    frequency: str,
    aggs: Sequence[Agg],
    *,
    tie_break: Sequence[str] = (),
    **options,
) -> DataFrame:
    """Aggregate to calendar periods, labelled by their last day as ``YYYYMMDD``."""
    day = as_date(df, order_by)
    dated = require(df, day.isNotNull(), "resample needs valid dates").withColumn(
        "__period", period_end(day, frequency)
    )
    result = aggregate(
        dated, [*group_by, "__period"], aggs, order_by=[order_by, *tie_break], **options
    )
    return result.select(
        *group_by,
        compact(F.col("__period")).alias(order_by),
        *[a.output for a in aggs],
    )


def _one_per_group(df: DataFrame, group_by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per group. Spark keeps one row per group and task before the shuffle."""
    window = Window.partitionBy(*group_by).orderBy(*order)
    return (
        df.withColumn("__rn", F.row_number().over(window)).where(F.col("__rn") == 1).drop("__rn")
    )


def distinct_by(
    df: DataFrame, fields: Sequence[str], order_by: Sequence[str], *, keep: str = "first"
) -> DataFrame:
    """One row per value of ``fields``: the first or last in ``order_by``."""
    order = [
        F.col(c).asc_nulls_last() if keep == "first" else F.col(c).desc_nulls_first()
        for c in order_by
    ]
    return _one_per_group(df, fields, order)


def latest_by_group(
    df: DataFrame,
    group_by: Sequence[str],
    order_by: str,
    *,
    direction: str = "asc",
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """One row per group by an order key.

    Ascending keeps the last row with missing keys sorted last, so a missing key wins.
    Descending keeps the first, so a missing key loses.
    """
    key = ordering(df, order_by)
    if direction == "asc":
        order = [key.desc_nulls_first(), *[F.col(c).desc_nulls_first() for c in tie_break]]
    else:
        order = [key.desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in tie_break]]
    return _one_per_group(df, group_by, order)
