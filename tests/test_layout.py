"""The split layout against the plain one on a group that holds most rows."""

import random

import numpy as np
import pytest

from panelspark.operators import layout as L
from panelspark.operators import windows as W
from panelspark.operators.asof import asof_join
from panelspark.operators.quantiles import exact_quantiles
from panelspark.operators.ranking import rank
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def skewed(spark):
    """2,000 rows: one hot group, many copies of one row, a null group, small groups."""
    i = F.col("id")
    return spark.range(2000).select(
        F.when(i < 1400, "hot").when(i < 1500, None).otherwise(F.concat(F.lit("g"), i % 40)).alias("g"),
        F.when(i < 600, 7).otherwise(i * 37 % 1009).alias("o"),
        F.when(i < 600, 600).otherwise(i).alias("t"),
        F.when(i % 11 == 0, None).otherwise((i * 7919 % 503).cast("double")).alias("v"),
    ).withColumn("v", F.when(F.col("t") == 600, 1.5).otherwise(F.col("v"))).cache()


def same(a, b):
    assert a.columns == b.columns
    assert a.count() == b.count()
    assert a.exceptAll(b).count() == 0


def test_positions_are_a_permutation_per_group(skewed):
    got = L.lay_out(skewed, ["g"], [F.col("o"), F.col("t")], block_rows=97).numbered("p")
    wrong = got.groupBy("g").agg(F.min("p").alias("a"), F.max("p").alias("b"), F.count("*").alias("n"), F.count_distinct("p").alias("d"))
    assert wrong.where("a <> 1 or b <> n or d <> n").count() == 0
    # No block holds more than its rows, so no task does either.
    blocks = L.lay_out(skewed, ["g"], [F.col("o"), F.col("t")], block_rows=97).frame
    assert blocks.groupBy("g", L.BLOCK).count().agg(F.max("count")).first()[0] <= 97


def test_rolling_and_shift_across_blocks(skewed):
    for window in (30,):
        run = lambda b: W.rolling(skewed, "sum", "y", "v", ["g"], "o", window, min_periods=1, tie_break=["t"], block_rows=b)
        same(run(None), run(61))
    for periods in (3, -5):
        run = lambda b: W.shifted(skewed, "shift", "y", "v", ["g"], "o", periods, tie_break=["t"], block_rows=b)
        same(run(None), run(61))
    for periods in (60, -60, 500, 61):
        run = lambda b: W.shifted(skewed, "diff", "y", "v", ["g"], "o", periods, tie_break=["t"], block_rows=b)
        same(run(None), run(61))


def numpy_rolling(function, x, y, window, least):
    """One value per row, straight from each window's rows."""
    out = []
    for i in range(len(x)):
        rows = slice(max(0, i - window + 1), i + 1)
        a = x[rows]
        use = ~np.isnan(a) & (~np.isnan(y[rows]) if function in ("correlation", "covariance") else True)
        a, b = a[use], y[rows][use]
        if len(a) < least:
            out.append(None)
        elif function == "correlation":
            flat = len(a) < 2 or a.min() == a.max() or b.min() == b.max()
            out.append(None if flat else np.corrcoef(a, b)[0, 1])
        elif function == "covariance":
            out.append(np.cov(a, b)[0, 1] if len(a) > 1 else None)
        elif function == "std":
            out.append(a.std(ddof=1) if len(a) > 1 else None)
        else:
            out.append({"mean": np.mean, "sum": np.sum, "min": np.min, "max": np.max, "quantile": lambda v: np.quantile(v, 0.3)}[function](a))
    return out


@pytest.mark.parametrize("function", W.ROLLING)
def test_long_windows_on_both_plans(spark, skewed, function):
    """Windows longer than a block, than a group, and in between, against NumPy."""
    frame = skewed.withColumn("w", F.when(F.col("t") < 900, F.col("v") + F.col("o") % 5 + 1e6).otherwise(3.25))
    rows = [r.asDict() for r in frame.collect()]
    groups = {}
    for r in sorted(rows, key=lambda r: (r["o"], r["t"])):
        groups.setdefault(r["g"], []).append(r)
    pair = function in ("correlation", "covariance")
    options = {"right_field": "w"} if pair else {"q": 0.3} if function == "quantile" else {}
    field = "v" if pair else "w" if function in ("std", "mean") else "v"
    for window, block, least in ((65, None, 1), (200, 61, 20), (200, None, 20), (1000, 97, 2)):
        got = W.rolling(
            frame, function, "y", field, ["g"], "o", window, min_periods=least, tie_break=["t"], block_rows=block, **options
        )
        assert got.columns == [*frame.columns, "y"]
        found = {}
        for r in got.collect():
            found.setdefault((r.g, r.o, r.t), []).append(r.y)
        want = {}
        for g, some in groups.items():
            x, y = (np.array([np.nan if r[c] is None else r[c] for r in some]) for c in (field, "w"))
            for r, value in zip(some, numpy_rolling(function, x, y, window, least)):
                want.setdefault((g, r["o"], r["t"]), []).append(value)
        assert found.keys() == want.keys()
        for key, values in want.items():
            # Copies of one row have one order or another; their values are the same set.
            order = lambda v: (v is None, v)
            for a, b in zip(sorted(found[key], key=order), sorted(values, key=order), strict=True):
                assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-9, abs=1e-7)), (key, a, b)


def test_long_windows_ask_for_consecutive_sessions(spark):
    rows = [(e, d, float(d * e)) for e in (1, 2) for d in range(300) if e == 1 or d != 150]
    df = spark.createDataFrame(rows, "e int, d int, v double").withColumn("d", F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")))
    for block in (None, 30):
        got = W.rolling(df, "sum", "y", "v", ["e"], "d", 100, require_consecutive=True, block_rows=block)
        n = {r.e: r.n for r in got.where("y IS NOT NULL").groupBy("e").agg(F.count("*").alias("n")).collect()}
        assert n == {1: 201, 2: 101}


def test_window_lists_stay_in_order():
    rng = random.Random(1)
    held, values = W._Ordered(), []
    for step in range(6000):
        if step > 3000 or rng.random() < 0.3 and values:
            held.remove(values.pop(rng.randrange(len(values)))) if values else None
        else:
            values.append(rng.choice([rng.random(), 0.5, 0.25]))
            held.add(values[-1])
        if step % 97 == 0 and values:
            assert held.quantile(0.4) == pytest.approx(float(np.quantile(values, 0.4)))


def test_running_totals_across_blocks(skewed):
    run = lambda b: W.cumulative_sum(skewed, "y", "v", ["g"], "o", tie_break=["t"], block_rows=b)
    same(run(None), run(61))


def test_rank_and_quantiles_across_blocks(skewed):
    for keys, methods in (([], ("average",)), (["g"], ("min", "dense"))):
        for method in methods:
            run = lambda b: rank(skewed, "y", "v", group_by=keys, method=method, block_rows=b)
            same(run(None), run(61))
        levels = {"a": 0.0, "b": 0.31, "c": 0.5, "d": 1.0}
        run = lambda b: exact_quantiles(skewed, keys, F.col("v"), levels, block_rows=b).select(
            *keys, *[F.round(n, 9).alias(n) for n in levels]
        )
        same(run(None), run(61))


def test_asof_across_blocks(skewed):
    history = skewed.where("o % 3 = 0").groupBy("g", F.col("o").alias("at")).agg(F.max("t").alias("n"))
    for direction in ("backward", "nearest"):
        run = lambda b: asof_join(
            skewed, history, ["g"], "o", "at", {"n": "n"}, tolerance=40, direction=direction, block_rows=b
        )
        same(run(None), run(61))


def test_layout_choice(skewed, monkeypatch):
    assert L.fits_one_task(skewed, ["g"], 1000)
    assert L.fits_one_task(skewed, ["g"], 1400)
    monkeypatch.setattr(L, "ONE_TASK_ROWS", 1400)
    assert L.fits_one_task(skewed, ["g"])
    monkeypatch.setattr(L, "ONE_TASK_ROWS", 1399)
    assert not L.fits_one_task(skewed, ["g"])
    assert L.group_sizes(skewed, []) == (2000, 2000)
    assert L.group_sizes(skewed, ["g"]) == (1400, 2000)


def test_a_well_compressed_hot_group_is_split(spark, monkeypatch, tmp_path):
    """One group whose file is tiny still goes the split way, with equal rows, nulls included."""
    rows = spark.range(5000).selectExpr("if(id < 4900, 'hot', if(id < 4950, 'rest', 'none')) AS g", "if(id < 4950, id % 7.0, null) AS x")
    rows.coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plain = sorted(map(tuple, exact_quantiles(df, ["g"], F.col("x"), {"q": 0.3}).collect()))
    monkeypatch.setattr(L, "ONE_TASK_ROWS", 1000)
    assert not L.fits_one_task(df, ["g"])
    assert L.lay_out(df, ["g"], [F.col("x")]).split
    split = sorted(map(tuple, exact_quantiles(df, ["g"], F.col("x"), {"q": 0.3}).collect()))
    assert plain == split and ("none", None) in plain
