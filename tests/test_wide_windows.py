"""Long windows move their rows a fixed, small number of times."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.operators import layout as L
from panelspark.operators import windows as W


@pytest.mark.parametrize("function", ["sum", "max", "std"])
def test_long_windows_move_rows_seldom(spark, function):
    rows = spark.range(60).selectExpr("id % 2 AS g", "id AS o", "CAST(id % 7 AS DOUBLE) AS v")
    got = W.rolling(rows, function, "y", "v", ["g"], "o", 70, min_periods=2, block_rows=10)
    plan = got._jdf.queryExecution().executedPlan().toString()
    # Numbering, the starts of partitions, and the runs.
    assert plan.count("Exchange hashpartitioning") <= 4


def test_infinity_stays_in_its_windows(spark):
    rows = spark.range(300).selectExpr("1 AS g", "id AS o", "IF(id = 5, double('inf'), double(1)) AS v")
    got = W.rolling(rows, "mean", "y", "v", ["g"], "o", 70)
    assert {r["o"] for r in got.where("y = double('inf')").collect()} == set(range(69, 75))
    assert {r["y"] for r in got.where("o >= 75").collect()} == {1.0}


@pytest.mark.parametrize("few", [0, 1000])
def test_split_rows_are_numbered_where_they_are_sorted(spark, monkeypatch, few):
    monkeypatch.setattr(L, "FEW_PIECES", few)
    rows = spark.range(200).selectExpr("IF(id % 3 = 0, NULL, id % 3) AS g", "200 - id DIV 2 AS o", "id AS t")
    got = L.lay_out(rows, ["g"], [F.col("o"), F.col("t")], block_rows=10).numbered("p")
    if few:
        # Nothing but the few starts of partitions is dealt out again.
        assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 1
    window = Window.partitionBy("g").orderBy("o", "t")
    want = rows.withColumn("p", F.row_number().over(window))
    assert sorted(got.collect(), key=lambda r: r["t"]) == sorted(want.collect(), key=lambda r: r["t"])
