"""Trading calendars. A calendar is a DataFrame with one DATE column ``session``.

Calendars hold at most one row per day, so their windows and broadcasts stay small
however large the panel is.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.dates import as_date
from panelspark.functions.semantics import number, require
from panelspark.sources.reads import in_days, parse_day

# Fixed value: local time at which a day's data is complete.
PUBLICATION_TIME = dt.time(17, 10)


def trading_sessions(
    df: DataFrame, day: str, *, is_open: str | None = None, start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Distinct open days of a calendar table, optionally within a range."""
    if is_open:
        df = df.where(number(df, is_open) == 1)
    sessions = df.select(as_date(df, day).alias("session")).where(F.col("session").isNotNull())
    if start and end:
        sessions = sessions.where(in_days(sessions, "session", start, end))
    return sessions.distinct()


def weekday_sessions(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Every Monday to Friday of a range, for use without a calendar table."""
    days = F.sequence(F.lit(parse_day(start)), F.lit(parse_day(end)))
    return (
        spark.range(1)
        .select(F.explode(days).alias("session"))
        .where(~F.dayofweek("session").isin(1, 7))
    )


def calendar_violations(df: DataFrame, day: str, start: str, end: str) -> DataFrame:
    """``(value, reason)`` for malformed, out-of-range and duplicate dates."""
    text = F.col(day).cast("string")
    parsed = as_date(df.select(text.alias(day)), day)
    first, last = F.lit(parse_day(start)), F.lit(parse_day(end))
    reason = (
        F.when(F.col("parsed").isNull(), "malformed")
        .when(~F.col("parsed").between(first, last), "out_of_range")
        .when(F.col("n") > 1, "duplicate")
    )
    return (
        df.select(text.alias(day))
        .withColumn("parsed", parsed)
        .groupBy(F.col(day).alias("value"), "parsed")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("reason", reason)
        .where(F.col("reason").isNotNull())
        .select("value", "reason", "n")
    )


def strict_sessions(df: DataFrame, day: str, start: str, end: str) -> DataFrame:
    """Sessions of a calendar table; any violation fails the job."""
    bad = calendar_violations(df, day, start, end).agg(F.count(F.lit(1))).scalar()
    sessions = trading_sessions(df, day)
    return require(sessions, bad == 0, "invalid trading calendar")


def completed_day(now: dt.datetime) -> dt.date:
    """The last day whose data is complete at local time ``now``."""
    return now.date() - dt.timedelta(days=0 if now.time() >= PUBLICATION_TIME else 1)


def latest_session(sessions: DataFrame, now: dt.datetime) -> DataFrame:
    """One row with the last session that is complete at ``now``."""
    return sessions.where(F.col("session") <= F.lit(completed_day(now))).agg(
        F.max("session").alias("session")
    )


def clamp_as_of(
    df: DataFrame, field: str, output: str, sessions: DataFrame, now: dt.datetime
) -> DataFrame:
    """Move requested dates after the latest completed session back to it."""
    latest = latest_session(sessions, now).scalar()
    return df.withColumn(output, F.least(as_date(df, field), latest))
