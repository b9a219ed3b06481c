"""Partition reads: equality, date ranges, and reads driven by another table.

A date range becomes a plain comparison on the stored column, so Parquet row groups and
date partitions are skipped; a key-driven read becomes a semi-join.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.functions.semantics import dtype, key_join


def parse_day(text: str) -> dt.date:
    return dt.datetime.strptime(text, "%Y%m%d").date()


def in_days(df: DataFrame, field: str, start: str, end: str) -> Column:
    """Inclusive day range on a date, timestamp or ``YYYYMMDD`` column."""
    first, last = parse_day(start), parse_day(end)
    if first > last:
        raise ValueError("the range starts after it ends")
    kind, column = dtype(df, field), F.col(field)
    if isinstance(kind, T.DateType):
        return column.between(F.lit(first), F.lit(last))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        after = last + dt.timedelta(days=1)
        low, high = F.lit(first).cast(kind), F.lit(after).cast(kind)
        return (column >= low) & (column < high)
    return column.between(start, end)


def snapshot(df: DataFrame, equals: Mapping[str, object], fields: Sequence[str]) -> DataFrame:
    """Rows that match every parameter, with only the requested fields."""
    for field, value in equals.items():
        df = df.where(F.col(field) == F.lit(value))
    return df.select(*fields)


def read_sessions(
    df: DataFrame, day: str, start: str, end: str, sessions: DataFrame, fields: Sequence[str]
) -> DataFrame:
    """All rows of the open sessions in a range; fails if a session has no row.

    ``sessions`` is a calendar with one DATE column ``session``: at most one row per
    calendar day of the range, small enough to broadcast. Other types get no hint.
    """
    ranged = df.where(in_days(df, day, start, end)).withColumn(
        "__session", F.col(day).cast("date")
    )
    wanted = sessions.where(in_days(sessions, "session", start, end)).select(
        F.col("session").alias("__session")
    )
    observed = ranged.select("__session").distinct()
    absent = wanted.join(observed, "__session", "left_anti").agg(F.count(F.lit(1))).scalar()
    fail = F.raise_error(F.lit("a session in the range has no rows")).cast("boolean")
    if isinstance(dtype(sessions, "session"), T.DateType):
        wanted = F.broadcast(wanted)
    return (
        ranged.join(wanted, "__session", "left_semi")
        .where(F.when(absent > 0, fail).otherwise(True))
        .select(*fields)
    )


def read_disclosures(
    df: DataFrame, day: str, start: str, end: str, fields: Sequence[str]
) -> DataFrame:
    """Disclosures dated in a range."""
    return df.where(in_days(df, day, start, end)).select(*fields)


def read_candidates(df: DataFrame, key: str, source: DataFrame, source_key: str) -> DataFrame:
    """Rows whose key occurs in a column of another result."""
    keys = source.select(F.col(source_key).alias(key)).where(F.col(key).isNotNull()).distinct()
    return key_join(df, keys, [key], "left_semi", null_keys=False)


def read_universe(
    df: DataFrame, universe: DataFrame, key: str, fields: Sequence[str]
) -> DataFrame:
    """Rows of the universe's members; ``universe_coverage`` counts who has none."""
    return read_candidates(df, key, universe, key).select(*fields)


def universe_coverage(df: DataFrame, universe: DataFrame, key: str) -> DataFrame:
    """One row: universe size, members with data, members without."""
    members = universe.select(key).where(F.col(key).isNotNull()).distinct()
    found = df.select(key).distinct().withColumn("__found", F.lit(1))
    return key_join(members, found, [key], "left", ["__found"], null_keys=False).agg(
        F.count(F.lit(1)).alias("universe_count"),
        F.count("__found").alias("successful_count"),
        (F.count(F.lit(1)) - F.count("__found")).alias("missing_count"),
    )
