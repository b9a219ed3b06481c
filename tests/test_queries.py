"""Registered queries against their SQL twins on the smallest tables.

The rule-search queries run for tens of seconds each and share the code that
``test_search.py`` covers; ``python -m tests.oracle`` runs them all.
"""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.oracle import connect, difference

FOLDER = "/root/testdata/sf0.001"
HEAVY = ("search_", "discovery_", "validat", "rule_", "lift_", "robust_", "backtest", "kish", "hac_", "entity_cluster", "wilson", "outcome_b")
SQL = entry.oracle_sql()

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_oracle_belongs_to_a_query():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", [n for n in SQL if not n.startswith(HEAVY)])
def test_query_matches_sql(spark, duck, name):
    assert difference(duck, SQL[name], entry.queries()[name](spark, FOLDER)) is None


def test_rule_evidence_matches_sql(spark, duck):
    assert difference(duck, SQL["backtest_rule"], entry.queries()["backtest_rule"](spark, FOLDER)) is None


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 10
