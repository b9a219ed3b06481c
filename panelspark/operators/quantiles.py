"""Exact quantiles with linear interpolation, whole or narrowed down across tasks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.semantics import key_join
from panelspark.operators.layout import fits_one_task, lay_out

BUCKETS = 4096


def exact_quantiles(
    df: DataFrame,
    group_by: Sequence[str],
    value: Column,
    outputs: Mapping[str, float],
    *,
    max_group_rows: int | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """One row per group with the requested quantiles of the non-missing values.

    ``percentile`` holds every distinct value of a group in one buffer. Groups beyond
    one task's budget go through ``_narrowed`` instead. A group without a value has nulls.
    """
    keys = list(group_by)
    values = df.select(*keys, value.alias("__q"))
    if block_rows is None and fits_one_task(values, keys, max_group_rows):
        return values.groupBy(*keys).agg(
            *[F.percentile("__q", q).alias(name) for name, q in outputs.items()]
        )
    found = _narrowed(values.where(F.col("__q").isNotNull()), keys, outputs, block_rows)
    return key_join(values.select(*keys).distinct(), found, keys, "left", list(outputs)) if keys else found


def _squeezed(value: Column, scale: Column) -> Column:
    """A non-decreasing map that keeps a few outliers from emptying the buckets."""
    return F.signum(value) * F.log1p(F.abs(value) / scale)


def value_bucket(value: Column, low: Column, high: Column, scale: Column) -> Column:
    """One of ``BUCKETS`` buckets between the bounds, in the values' order. Equal or infinite
    bounds give a single bucket. Any choice gives exact quantiles; a bad one costs time."""
    place = F.width_bucket(
        _squeezed(value, scale), _squeezed(low, scale), _squeezed(high, scale), F.lit(BUCKETS)
    )
    return F.coalesce(F.least(place, F.lit(BUCKETS)), F.lit(0))


def mean_size(value: str) -> Column:
    """The scale of values for ``value_bucket``: their mean distance from zero."""
    absolute = F.avg(F.abs(value))
    return F.when(absolute > 0, absolute).otherwise(1.0)


def _positions(n: Column, outputs: Mapping[str, float]) -> list[tuple[str, Column]]:
    return [(name, (n - 1) * F.lit(float(q))) for name, q in outputs.items()]


def wanted_positions(counts: DataFrame, keys: list[str], outputs: Mapping[str, float]) -> DataFrame:
    """``keys, __b, __c, __at, __before, __n``: the wanted places of each group (from 0) and the
    bucket that holds each, from counts ``__c`` per bucket ``__b``."""
    # At most BUCKETS + 1 rows per group.
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    edges = [edge(p).cast("long") for _, p in _positions(F.col("__n"), outputs) for edge in (F.floor, F.ceil)]
    inside = (F.col("__at") >= F.col("__before")) & (F.col("__at") < F.col("__before") + F.col("__c"))
    return (
        counts.withColumn("__before", F.coalesce(F.sum("__c").over(earlier), F.lit(0)))
        .withColumn("__n", F.sum("__c").over(group))
        .withColumn("__at", F.explode(F.array_distinct(F.array(*edges))))
        .where(inside)
        .select(*keys, "__b", "__c", "__at", "__before", "__n")
    )


def picked_quantiles(
    near: DataFrame,
    targets: DataFrame,
    keys: list[str],
    outputs: Mapping[str, float],
    *,
    max_bucket_rows: int | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """One row per group with its quantiles, from the values ``__q`` of the wanted buckets, each
    once with its count ``__c``. ``max_bucket_rows`` is the largest of the targets' counts."""
    ordered = lay_out(
        near, [*keys, "__b"], [F.col("__q").asc()], max_group_rows=max_bucket_rows, block_rows=block_rows
    )
    found = key_join(
        ordered.running({"__upto": F.col("__c")}),
        targets.drop("__c"),
        [*keys, "__b"],
        "inner",
        ["__at", "__before", "__n"],
    ).where(
        (F.col("__at") < F.col("__before") + F.col("__upto"))
        & (F.col("__at") >= F.col("__before") + F.col("__upto") - F.col("__c"))
    )

    def at(position: Column) -> Column:
        return F.max(F.when(F.col("__at") == position.cast("long"), F.col("__q")))

    n = F.col("__n")
    picked = found.groupBy(*keys).agg(
        F.max("__n").alias("__n"),
        *[at(F.floor(p)).alias(f"__lo_{name}") for name, p in _positions(n, outputs)],
        *[at(F.ceil(p)).alias(f"__hi_{name}") for name, p in _positions(n, outputs)],
    )

    def between(name: str, position: Column) -> Column:
        low, high = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        step = F.when(high == low, F.lit(0.0)).otherwise((high - low) * (position - F.floor(position)))
        return (low + step).alias(name)

    return picked.select(*keys, *[between(name, p) for name, p in _positions(n, outputs)])


def _narrowed(
    present: DataFrame, keys: list[str], outputs: Mapping[str, float], block_rows: int | None
) -> DataFrame:
    """Quantiles by position, without sorting more than the buckets that hold them.

    Counts per (group, bucket) combine before the shuffle and tell which buckets hold
    the wanted positions. Only the values of those buckets are counted and ordered.
    """
    bounds = present.groupBy(*keys).agg(
        F.min("__q").alias("__min"), F.max("__q").alias("__max"), mean_size("__q").alias("__scale")
    )
    bucket = value_bucket(F.col("__q"), F.col("__min"), F.col("__max"), F.col("__scale"))
    placed = _with_bounds(present, bounds, keys, ["__min", "__max", "__scale"]).select(
        *keys, "__q", bucket.alias("__b")
    )
    counts = placed.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__c"))
    targets = wanted_positions(counts, keys, outputs)
    buckets = targets.select(*keys, "__b").distinct()
    near = key_join(placed, buckets, [*keys, "__b"], "left_semi")
    near = near.groupBy(*keys, "__b", "__q").agg(F.count(F.lit(1)).alias("__c"))
    return picked_quantiles(near, targets, keys, outputs, block_rows=block_rows)


def _with_bounds(
    df: DataFrame, bounds: DataFrame, keys: list[str], columns: list[str]
) -> DataFrame:
    """Attach per-group values: a join, or scalar subqueries for the only group."""
    if keys:
        return key_join(df, bounds, keys, "left", columns)
    return df.withColumns({c: bounds.select(c).scalar() for c in columns})
