"""Ranks, group statistics, normalisation, sort and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.semantics import key_join, number, ordering
from panelspark.operators.layout import fits_one_task, lay_out
from panelspark.operators.quantiles import exact_quantiles
from panelspark.operators.windows import ordered

_X = "__x"


def _attach(df: DataFrame, table: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Left join of per-key values. The table has one row per key, so a hot key on the
    big side only needs Spark's adaptive skew split, or a broadcast if the table is small."""
    return key_join(df, table, keys, "left", columns)


def rank(
    df: DataFrame,
    output: str,
    field: str,
    *,
    group_by: Sequence[str] = (),
    method: str = "min",
    direction: str = "asc",
    tie_break: Sequence[str] = (),
    max_group_rows: int | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Rank of a numeric column: min, max, average, first or dense; missing unranked.

    Beyond one task the rank is worked out on the distinct values: count rows per
    (group, value) before the shuffle, add up the counts along the value order, join
    the result back on (group, value).
    """
    if method not in ("min", "max", "average", "first", "dense"):
        raise ValueError(f"unknown rank method: {method}")
    keys, x = list(group_by), number(df, field)

    def by(column: Column) -> Column:
        return column.asc() if direction == "asc" else column.desc()

    source = df.withColumn(_X, x)
    if block_rows is None and fits_one_task(df, keys, max_group_rows):
        # Missing values form their own partition, so they never take a rank.
        part = Window.partitionBy(*keys, F.col(_X).isNull())
        order = part.orderBy(by(F.col(_X)), *[F.col(c) for c in tie_break])
        value_order = part.orderBy(by(F.col(_X)))
        # Peers of the current row, in the same window: no second shuffle.
        ties = F.count(F.lit(1)).over(
            value_order.rangeBetween(Window.currentRow, Window.currentRow)
        )
        low = F.rank().over(value_order)
        ranked = {
            "min": lambda: low,
            "max": lambda: low + ties - 1,
            "average": lambda: low + (ties - 1) / 2,
            "first": lambda: F.row_number().over(order),
            "dense": lambda: F.dense_rank().over(value_order),
        }[method]()
        return source.withColumn(
            output, F.when(F.col(_X).isNotNull(), ranked.cast("double"))
        ).drop(_X)
    if method == "first":
        order = [by(F.col(_X)), *[F.col(c) for c in tie_break]]
        filled = lay_out(
            source.withColumn("__null", F.col(_X).isNull()),
            [*keys, "__null"],
            order,
            block_rows=block_rows,
        ).numbered(output)
        return filled.withColumn(
            output, F.when(F.col(_X).isNotNull(), F.col(output).cast("double"))
        ).drop(_X, "__null")
    counts = (
        source.where(F.col(_X).isNotNull())
        .groupBy(*keys, _X)
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    placed = lay_out(counts, keys, [by(F.col(_X))], block_rows=block_rows).running(
        {"__upto": F.col("__n"), "__dense": F.lit(1)}
    )
    value = {
        "min": F.col("__upto") - F.col("__n") + 1,
        "max": F.col("__upto"),
        "average": F.col("__upto") - (F.col("__n") - 1) / 2,
        "dense": F.col("__dense"),
    }[method]
    table = placed.select(*keys, _X, value.cast("double").alias(output))
    return _attach(source, table, [*keys, _X], [output]).drop(_X)


def row_number(
    df: DataFrame,
    output: str,
    group_by: Sequence[str],
    order_by: str,
    *,
    direction: str = "asc",
    tie_break: Sequence[str] = (),
    **layout_options,
) -> DataFrame:
    """Position of each row in its group, missing order keys last."""
    return ordered(
        df, group_by, order_by, tie_break, direction=direction, **layout_options
    ).numbered(output)


_STATISTICS = {
    "count": F.count,
    "sum": lambda x: F.coalesce(F.sum(x), F.lit(0.0)),
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "std": F.stddev_samp,
}


def group_transform(
    df: DataFrame,
    output: str,
    field: str,
    function: str,
    group_by: Sequence[str],
    *,
    max_group_rows: int | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Every row gets its group's statistic; the row count does not change.

    Aggregating and joining back lets the statistic combine before the shuffle, where
    a window over the group would hold the whole group in one task.
    """
    x = number(df, field)
    if function == "median":
        table = exact_quantiles(
            df, group_by, x, {"__s": 0.5}, max_group_rows=max_group_rows, block_rows=block_rows
        )
    elif function in _STATISTICS:
        table = df.groupBy(*group_by).agg(_STATISTICS[function](x).alias("__s"))
    else:
        raise ValueError(f"unknown group statistic: {function}")
    return _attach(df, table, group_by, ["__s"]).withColumnRenamed("__s", output)


def normalize(
    df: DataFrame,
    output: str,
    field: str,
    method: str,
    *,
    group_by: Sequence[str] = (),
    max_group_rows: int | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """``zscore``, ``minmax`` or ``percentile``, per group or over the whole frame."""
    keys, x = list(group_by), number(df, field)
    if method == "percentile":
        ranked = rank(
            df,
            "__rank",
            field,
            group_by=keys,
            method="average",
            max_group_rows=max_group_rows,
            block_rows=block_rows,
        )
        stats = df.groupBy(*keys).agg(F.count(x).alias("__n"))
        if keys:
            sized = _attach(ranked, stats, keys, ["__n"])
        else:
            sized = ranked.withColumn("__n", stats.scalar())
        return sized.withColumn(
            output, F.try_divide(F.col("__rank"), F.col("__n"))
        ).drop("__rank", "__n")
    if method == "zscore":
        center, scale = F.avg(x), F.stddev_samp(x)
    elif method == "minmax":
        center, scale = F.min(x), F.max(x) - F.min(x)
    else:
        raise ValueError(f"unknown normalisation: {method}")
    stats = df.groupBy(*keys).agg(center.alias("__c"), scale.alias("__s"))
    if keys:
        sized = _attach(df, stats, keys, ["__c", "__s"])
    else:
        sized = df.withColumns(
            {"__c": stats.select("__c").scalar(), "__s": stats.select("__s").scalar()}
        )
    # Division by a zero spread is missing, as is any result without a spread.
    return sized.withColumn(output, F.try_divide(x - F.col("__c"), F.col("__s"))).drop(
        "__c", "__s"
    )


def sort_rows(
    df: DataFrame, field: str, *, direction: str = "asc", tie_break: Sequence[str] = ()
) -> DataFrame:
    """Global sort, missing last in both directions."""
    key = ordering(df, field)
    first = key.asc_nulls_last() if direction == "asc" else key.desc_nulls_last()
    return df.orderBy(first, *[F.col(c).asc_nulls_last() for c in tie_break])


def limit_rows(df: DataFrame, count: int) -> DataFrame:
    """First rows of a sorted frame; Spark keeps ``count`` rows per task."""
    if count < 1:
        raise ValueError("limit must be positive")
    return df.limit(count)


def top_k_by_group(
    df: DataFrame,
    field: str,
    group_by: Sequence[str],
    count: int,
    *,
    direction: str = "desc",
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """First ``count`` rows per group. Spark cuts every group to ``count`` rows per
    task before the shuffle, so a hot group does not travel whole."""
    if count < 1:
        raise ValueError("count must be positive")
    key = ordering(df, field)
    first = key.asc_nulls_last() if direction == "asc" else key.desc_nulls_last()
    window = Window.partitionBy(*group_by).orderBy(
        first, *[F.col(c).asc_nulls_last() for c in tie_break]
    )
    return (
        df.withColumn("__rn", F.row_number().over(window))
        .where(F.col("__rn") <= count)
        .drop("__rn")
    )
