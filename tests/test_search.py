import datetime as dt

import numpy as np
import pandas as pd
import pytest

from panelspark.plans import rules as R
from panelspark.plans import search as S
from pyspark.sql import functions as F


def window(first, days=60, entities=15, seed=1, signal=0.05):
    rng = np.random.default_rng(seed)
    rows = []
    for d in range(days):
        for e in range(entities):
            value, quality, noise = rng.normal(), int(rng.integers(0, 2)), rng.normal()
            hot = value >= 0.5 and quality == 1
            ret = (signal if hot else -0.01) + rng.normal() * 0.02
            rows.append((e, first + dt.timedelta(days=d), ret, value, quality, noise))
    return pd.DataFrame(
        rows, columns=["entity", "session", "forward_return", "pe", "positive_days_3", "pb"]
    )


GATES = S.Gates(samples=30, days=10, entities=5, coverage=0.9)
FACTORS = ["pe", "positive_days_3", "pb"]


@pytest.fixture(scope="module")
def frames(spark):
    train = spark.createDataFrame(window(dt.date(2024, 1, 1))).coalesce(2)
    val = spark.createDataFrame(window(dt.date(2024, 6, 1), seed=2)).coalesce(2)
    return train, val


def test_planted_signal_is_found_and_confirmed(frames):
    train, val = frames
    board = S.search_rules(train, val, FACTORS, GATES, lag=2).orderBy("place").collect()
    assert 1 <= len(board) <= 10
    assert [r.place for r in board] == list(range(1, len(board) + 1))
    best = board[0]
    assert "pe >=" in best.formula and "positive_days_3 >= 1" in best.formula
    assert best.source == "mixed" and best.validation_reason == "passed"
    assert best.p_value <= best.q_value <= 0.1
    lows = [r.train_lift_confidence_lower for r in board]
    assert lows == sorted(lows, reverse=True)


def test_request_order_does_not_matter(frames):
    train, val = frames
    one = S.search_training(train, FACTORS, GATES, lag=2)
    two = S.search_training(train, FACTORS[::-1], GATES, lag=2)
    assert one.evaluated == two.evaluated
    key = lambda found: [(r.place, r.formula) for r in found.shortlist.orderBy("place").collect()]
    assert key(one) == key(two)


def test_pair_tags_equal_formula_evaluation(frames):
    train, _ = frames
    pool = [
        S.Condition("pe", ">=", 0.2, "quantile"),
        S.Condition("pe", "<=", 1.0, "quantile"),
        S.Condition("pe", "<=", -0.5, "quantile"),
        S.Condition("pb", "<=", 0.3, "quantile"),
    ]
    clean = R.clean_panel(train, FACTORS, 0.0)
    pairs, count = S.search_pairs(clean, pool, 100, 2, 0.0)
    # Same direction on one factor and an empty interval are not pairs.
    assert count == 4
    got = {r.formula: r for r in pairs.collect()}
    want = R.evaluate_rules(train, list(got), lag=2).collect()
    for row in want:
        for name in ("sample_count", "win_rate", "lift_standard_error", "median_return", "x1"):
            assert getattr(got[row.formula], name) == pytest.approx(getattr(row, name), rel=1e-9)


def test_discrete_and_continuous_thresholds(spark, frames):
    clean = R.clean_panel(frames[0], FACTORS, 0.0)
    rows = S.search_thresholds(clean, FACTORS).collect()
    by = {}
    for r in rows:
        by.setdefault((r.factor, r.source), []).append(r.threshold)
    assert sorted(by[("positive_days_3", "observed_value")]) == [0.0, 1.0]
    want = np.quantile([r.pe for r in frames[0].collect()], S.QUANTILES)
    assert sorted(by[("pe", "quantile")]) == pytest.approx(list(want))


def test_benjamini_yekutieli(spark):
    p = [0.001, 0.02, 0.02, 0.5, 1.0]
    df = spark.createDataFrame([(x,) for x in p], "p double")
    got = sorted(r.q for r in S.with_q_value(df, "p", "q").collect())
    m, harmonic = len(p), sum(1 / k for k in range(1, len(p) + 1))
    raw = [x * m * harmonic / (i + 1) for i, x in enumerate(p)]
    want = [min(1.0, min(raw[i:])) for i in range(m)]
    assert got == pytest.approx(sorted(want))


def test_pool_covers_factors_before_thresholds(spark):
    rows = [
        (0, "a", ">=", 0.9), (1, "a", ">=", 0.8), (2, "a", ">=", 0.7), (3, "a", "<=", 0.1),
        (4, "b", "<=", 0.5),
    ]
    df = spark.createDataFrame(rows, "rule long, factor string, operator string, lift_confidence_lower double")
    df = df.withColumns({"return_p05": F.lit(0.0), "median_return": F.lit(0.0)})
    got = [r.rule for r in S.pairing_pool(df).collect()]
    assert got == [0, 4, 3, 1]


@pytest.mark.parametrize(
    "change",
    [
        {"val_start": "20230630"},
        {"factors": ()},
        {"factors": ("pe", "pe")},
        {"factors": ("nope",)},
        {"horizon": 61},
        {"minimum_days": 50},
        {"train_start": "2024-01-01"},
    ],
)
def test_study_arguments_are_checked(change):
    good = dict(
        train_start="20230101", train_end="20230630", val_start="20240102", val_end="20240601",
        factors=("pe",),
    )
    S.Study(**good)
    with pytest.raises(ValueError):
        S.Study(**{**good, **change})
