"""Audited table transforms: period returns and top-ten holder concentration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.semantics import key_join, number, require
from panelspark.sources.reads import parse_day

SHARE_LOOKBACK_DAYS = 40
#: Length of a list of largest holders, and what is said of lists that are none.
HOLDERS = 10
MALFORMED, OUTSIDE = "malformed_holder_list", "total_outside_range"

# Names under which pooled accounts appear in holder lists.
OMNIBUS = r"(?i)香港中央结算|HKSCC|Hong Kong Securities Clearing"


def period_return(
    df: DataFrame,
    entity: str,
    day: str,
    close: str,
    *,
    carry: Sequence[str] = (),
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """Return between each entity's first and last day with a close, in percent.

    Entities with a single day or a start that is not positive are left out. ``carry``
    columns take their value from the last row. Everything combines before the shuffle.
    """
    priced = df.withColumn("__close", number(df, close)).where(F.col("__close").isNotNull())
    key = F.struct(day, *tie_break) if tie_break else F.col(day)
    ends = priced.groupBy(entity).agg(
        F.min(day).alias("start_date"),
        F.max(day).alias("end_date"),
        F.min_by("__close", key).alias("start_close"),
        F.max_by("__close", key).alias("end_close"),
        *[F.max_by(c, key).alias(c) for c in carry],
    )
    kept = ends.where((F.col("start_date") < F.col("end_date")) & (F.col("start_close") > 0))
    change = (F.col("end_close") / F.col("start_close") - 1) * 100
    return kept.select(
        entity,
        "start_date",
        "end_date",
        "start_close",
        "end_close",
        F.round(change, 4).alias("period_return_pct"),
        *carry,
    )


def boundary_rows(
    df: DataFrame, day: str, start: str, end: str, sessions: DataFrame
) -> DataFrame:
    """Rows of only the first and last session of a range that have any.

    The two days are scalar subqueries over the day column alone, so a table partitioned
    by day reads two partitions for the result.
    """
    first, last = F.lit(parse_day(start)), F.lit(parse_day(end))
    days = df.select(F.col(day).alias("session")).where(F.col("session").between(first, last))
    seen = key_join(days.distinct(), sessions, ["session"], "left_semi", null_keys=False)

    # One subquery for both, so the distinct days are found once.
    edges = seen.agg(F.array(F.min("session"), F.max("session")).alias("edges")).scalar()
    return df.where(F.array_contains(edges, F.col(day)))


def period_return_boundary(
    df: DataFrame, entity: str, day: str, close: str, start: str, end: str, sessions: DataFrame
) -> DataFrame:
    return period_return(boundary_rows(df, day, start, end, sessions), entity, day, close)


def share_snapshot(
    periods: DataFrame, shares: DataFrame, entity: str, period: str, day: str, sessions: DataFrame
) -> DataFrame:
    """Share counts of each (entity, period) from one market day.

    The day is the latest session with any share row in the 40 calendar days up to the
    period's end. Periods and days are calendar-sized tables.
    """
    ends = periods.select(period).distinct()
    window = F.sequence(F.date_sub(F.col(period), SHARE_LOOKBACK_DAYS), F.col(period))
    probes = ends.select(period, F.explode(window).alias("session")).join(sessions, "session")
    present = shares.select(F.col(day).alias("session")).distinct()
    chosen = probes.join(present, "session").groupBy(period).agg(F.max("session").alias(day))

    def positive(field: str) -> Column:
        value = number(shares, field)
        return F.when(value > 0, value * 10_000)

    counts = shares.select(
        entity, day, F.coalesce(positive("free_share"), positive("float_share")).alias("__shares")
    )
    # One row per period: a calendar-sized table.
    near_end = key_join(counts, chosen, [day], "inner", [period], F.broadcast, null_keys=False)
    return near_end.groupBy(entity, period).agg(F.max("__shares").alias("__shares"))


def concentration(
    df: DataFrame,
    entity: str,
    period: str,
    announced: str,
    holder: str,
    ratio: str,
    *,
    amount: str | None = None,
    shares: DataFrame | None = None,
    latest_only: bool = False,
    strict: bool = False,
) -> DataFrame:
    """Share of the float held by the ten largest holders, per entity and period.

    Each period uses its latest announcement. A missing ratio leaves the total missing and
    reports what is known, unless all amounts and a share count (``shares``: entity, period,
    ``__shares``) are there, in which case ratios follow from the amounts.

    A list that does not have exactly ten rows with ten distinct holders, or a total outside
    0-100 %, is a row of its own with that ``calculation_status``, its counts, and no ratios;
    with ``strict`` it fails the job. Groups of any size are counted before they are shuffled.
    """
    scope = [entity] if latest_only else [entity, period]
    keys = [entity, period, announced]
    stamp = F.struct(period, announced)
    newest = df.groupBy(*scope).agg(F.max(stamp).alias("__newest"))
    rows = key_join(df, newest, scope, "inner", ["__newest"])
    rows = rows.where(stamp.eqNullSafe(F.col("__newest"))).drop("__newest").dropDuplicates()
    rows = rows.withColumn("__r", number(rows, ratio)).withColumn(
        "__a", number(rows, amount) if amount else F.lit(None).cast("double")
    )
    pooled = F.coalesce(F.col(holder).rlike(OMNIBUS), F.lit(False))

    def zero(column: Column) -> Column:
        return F.coalesce(F.sum(column), F.lit(0.0))

    # First per holder, so that a long list combines before it meets in one place.
    by_holder = rows.groupBy(*keys, holder).agg(
        F.count(F.lit(1)).alias("__rows"),
        F.count("__r").alias("__known"),
        F.sum("__r").alias("__r"),
        F.count("__a").alias("__amounts"),
        F.sum("__a").alias("__a"),
    )
    grouped = by_holder.groupBy(*keys).agg(
        F.sum("__rows").alias("__rows"),
        F.count(holder).alias("holder_count"),
        F.sum("__known").alias("__known"),
        zero(F.col("__r")).alias("__ratio"),
        F.sum("__amounts").alias("__amounts"),
        F.sum("__a").alias("__amount"),
        zero(F.when(pooled, F.col("__r"))).alias("__pooled_r"),
        zero(F.when(pooled, F.col("__a"))).alias("__pooled_a"),
    )
    # A proper list has ten names at most; each task cuts longer ones before the shuffle.
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(holder))
    gaps = rows.where("__r IS NULL").select(*keys, holder).withColumn("__at", first).where(F.col("__at") <= HOLDERS)
    gaps = gaps.groupBy(*keys).agg(F.sort_array(F.collect_list(holder)).alias("__gaps"))
    grouped = key_join(grouped, gaps, keys, "left", ["__gaps"])
    if shares is not None:
        grouped = key_join(grouped, shares, [entity, period], "left", ["__shares"], null_keys=False)
    else:
        grouped = grouped.withColumn("__shares", F.lit(None).cast("double"))
    by_amount = (F.col("__amounts") == F.col("__rows")) & (F.col("__shares") > 0)
    by_amount = F.coalesce(by_amount, F.lit(False))
    scaled = F.least(F.col("__amount") / F.col("__shares") * 100, F.lit(100.0))
    known = by_amount | (F.col("__known") == F.col("__rows"))
    total = F.when(by_amount, scaled).otherwise(F.col("__ratio"))
    pooled_total = F.when(by_amount, F.col("__pooled_a") / F.col("__shares") * 100).otherwise(
        F.col("__pooled_r")
    )
    ten = (F.col("__rows") == HOLDERS) & (F.col("holder_count") == HOLDERS)
    inside = ~known | total.between(0, 100)
    status = (
        F.when(~ten, MALFORMED)
        .when(~inside, OUTSIDE)
        .when(known, "complete")
        .otherwise("partial_missing_ratio")
    )
    if strict:
        grouped = require(grouped, ten, "concentration needs exactly ten distinct holders per period")
        grouped = require(grouped, inside, "concentration is outside 0-100%")
    complete, partial = (F.col("calculation_status") == s for s in ("complete", "partial_missing_ratio"))
    nobody = F.array().cast("array<string>")
    return grouped.withColumn("calculation_status", status).select(
        *keys,
        F.when(complete, F.round(total, 4)).alias("cr10_float_registered"),
        F.when(complete, F.round(100 - total, 4)).alias("non_top10_float_ratio"),
        F.when(partial, F.round("__ratio", 4)).alias("known_top_holder_float_ratio"),
        F.when(partial, F.round(100 - F.col("__ratio"), 4)).alias(
            "uncovered_float_ratio_upper_bound"
        ),
        F.when(complete, F.round(pooled_total, 4)).alias("omnibus_float_ratio"),
        "holder_count",
        F.when(by_amount, F.col("__rows")).otherwise(F.col("__known")).alias("ratio_holder_count"),
        F.when(by_amount | ~(complete | partial), nobody)
        .otherwise(F.coalesce("__gaps", nobody))
        .alias("missing_ratio_holders"),
        "calculation_status",
    )
