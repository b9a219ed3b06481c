"""Queries on hand-made tables with zeros, negative values and long keys, against their SQL."""

import datetime as dt

import duckdb
import pytest

import __spark_entry__ as entry
from tests.oracle import difference

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


def matches(spark, folder, name):
    with duckdb.connect() as duck:
        for table in folder.glob("*.parquet"):
            duck.execute(f"CREATE VIEW {table.stem} AS FROM '{table}/*.parquet'")
        return difference(duck, entry.oracle_sql()[name], entry.queries()[name](spark, str(folder))) is None


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Users with one event a day, from the 8th on: kind and value."""
    folder = tmp_path_factory.mktemp("events")
    days = {
        1: [("error", 5.0), ("error", 0.0), ("view", 1.0), ("view", 2.0), ("view", 3.0)],
        2: [("error", 5.0), ("error", 2.0), ("view", 0.0), ("view", 2.0), ("view", 1.0)],
        3: [("purchase", 0.0), ("purchase", 2.0), ("purchase", 0.0), ("purchase", -2.0), ("purchase", 0.0)],
        4: [("purchase", 3.0), ("purchase", 0.0), ("purchase", 0.0), ("purchase", 4.0), ("purchase", 1.0)],
    }
    rows = [
        (user * 100 + i, dt.datetime(2024, 1, 8 + i, 12), user, *event)
        for user, found in days.items()
        for i, event in enumerate(found)
    ]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", ["an_event_outcome", "an_streak_outcome"])
def test_outcome_after_a_close_of_zero(spark, events, name):
    assert matches(spark, events, name)


@pytest.mark.parametrize("name", ["pct_change"])
def test_change_from_zero(spark, events, name):
    assert matches(spark, events, name)


def test_codes_of_all_numbers(spark, tmp_path):
    """Numbers whose codes look like shares quoted in foreign currency, or are cut."""
    kinds = "AUTOMOBILE", "BUILDING", "MACHINERY", "FURNITURE"
    rows = [
        (number, f"name {number}", 1, float(balance), kind)
        for number in (7, 200_001, 900_001, 1_000_007)
        for kind, balance in zip(kinds, (-1, 10, 5000, 1))
    ]
    schema = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/customer.parquet")
    assert matches(spark, tmp_path, "universe_all_status")


def test_single_day_change_from_zero(spark, events):
    assert matches(spark, events, "an_rank_single_day")
