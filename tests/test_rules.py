import numpy as np
import pandas as pd
import pytest

from panelspark.functions.statistics import student_t_tail
from panelspark.plans import rules as R
from pyspark.sql import functions as F
from tests.reference_stats import evidence


def panel_frame(seed=3, entities=12, days=40):
    rng = np.random.default_rng(seed)
    rows = []
    for e in range(entities):
        for d in range(days):
            if rng.random() < 0.15:
                continue
            a, b = rng.normal(), rng.normal()
            ret = 0.02 * a + rng.normal() * 0.03
            rows.append(
                (
                    e,
                    pd.Timestamp("2024-01-01") + pd.Timedelta(days=d),
                    None if rng.random() < 0.05 else ret,
                    None if rng.random() < 0.1 else a,
                    None if rng.random() < 0.1 else b,
                )
            )
    df = pd.DataFrame(rows, columns=["entity", "session", "forward_return", "fa", "fb"])
    df["session"] = df.session.dt.date
    return df.astype({"forward_return": float, "fa": float, "fb": float})


FORMULAS = {
    "fa >= 0.5": (lambda d: d.fa >= 0.5, ["fa"]),
    "fb <= -0.2": (lambda d: d.fb <= -0.2, ["fb"]),
    "(fa >= 0.2) and (fb <= 0.4)": (lambda d: (d.fa >= 0.2) & (d.fb <= 0.4), ["fa", "fb"]),
}


@pytest.mark.parametrize("lag", [0, 4, 60])
def test_evidence_matches_numpy(spark, lag):
    df = panel_frame()
    panel = spark.createDataFrame(df).coalesce(2)
    got = {
        r.formula: r.asDict()
        for r in R.evaluate_rules(panel, list(FORMULAS), target_return=0.005, lag=lag).collect()
    }
    assert set(got) == set(FORMULAS)
    for text, (mask, factors) in FORMULAS.items():
        base = df[factors].notna().all(axis=1)
        want = evidence(df, mask(df), base, 0.005, lag)
        for name, value in want.items():
            assert got[text][name] == pytest.approx(value, rel=1e-9, abs=1e-12), (text, name)


def test_many_rules_equal_one_rule(spark):
    panel = spark.createDataFrame(panel_frame(seed=9))
    many = {r.formula: r for r in R.evaluate_rules(panel, list(FORMULAS), lag=3).drop("rule").collect()}
    for text in FORMULAS:
        (one,) = R.evaluate_rules(panel, [text], lag=3).drop("rule").collect()
        for name, value in one.asDict().items():
            if isinstance(value, float):
                assert many[text][name] == pytest.approx(value, rel=1e-9), name
            else:
                assert many[text][name] == value, name


def test_exact_event_statistics(spark):
    rows = [(i, f"2026-01-0{5 + i}", float(i + 1), r) for i, r in enumerate([0.1, -0.2, 0.3, 0.1])]
    panel = spark.createDataFrame(rows, "entity long, session string, factor double, forward_return double")
    panel = panel.withColumn("session", F.to_date("session"))
    (r,) = R.evaluate_rules(panel, ["factor >= 2"]).collect()
    assert (r.sample_count, r.security_count, r.positive_count) == (3, 3, 2)
    assert r.win_rate == pytest.approx(2 / 3)
    assert r.return_p05 == pytest.approx(-0.17)
    assert r.rule_support_rate == pytest.approx(0.75)


def test_rule_without_rows_has_defaults(spark):
    panel = spark.createDataFrame(panel_frame())
    (r,) = R.evaluate_rules(panel, ["fa >= 1000"]).collect()
    assert r.sample_count == 0 and r.matched_sample_count == 0
    assert (r.confidence_lower, r.confidence_upper) == (0.0, 1.0)
    assert (r.lift_confidence_lower, r.lift_confidence_upper) == (-1.0, 1.0)
    assert r.baseline_win_rate > 0 and r.win_rate_lift == 0.0


@pytest.mark.parametrize("text", ["forward_return > 0", "future_session > '2024-01-01'", "nope > 1"])
def test_rule_fields_are_checked(spark, text):
    panel = spark.createDataFrame(panel_frame())
    with pytest.raises(ValueError):
        R.evaluate_rules(panel, [text])


def test_event_examples_are_the_newest(spark):
    df = panel_frame()
    got = R.event_examples(spark.createDataFrame(df), ["fa >= 0.5"]).orderBy("position").collect()
    want = df[(df.fa >= 0.5) & df.forward_return.notna()].sort_values(
        ["session", "entity"], ascending=[False, True]
    ).head(5)
    assert [(r.session, r.entity) for r in got] == list(zip(want.session, want.entity))
    assert all(set(r.factor_values) == {"fa"} for r in got)


def test_student_t_tail_known_values(spark):
    cases = [
        (1.0, 1, 0.25),
        (1.0, 2, 0.2113248654051871),
        (2.0, 4, 0.05805826175840778),
        (2.0, 5, 0.05096973941492916),
        (1.5, 30, 0.07203296456432534),
        (2.5, 101, 0.007014660676265438),
        (1.2, 22, 0.12145140125974657),
        (0.0, 10, 0.5),
        (3.0, 3, 0.028834442811218552),
    ]
    df = spark.createDataFrame(cases, "t double, nu int, want double")
    for row in df.select("want", student_t_tail(F.col("t"), F.col("nu")).alias("got")).collect():
        assert row.got == pytest.approx(row.want, abs=2e-8)


def test_evidence_takes_few_jobs(spark):
    """Every shuffle is a job, whose broadcasts and plans fill the driver's heap."""
    panel = spark.createDataFrame(panel_frame()).coalesce(2)
    context = spark.sparkContext
    context.setJobGroup("evidence", "")
    try:
        assert R.evaluate_rules(panel, list(FORMULAS), lag=4).count() == len(FORMULAS)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    jobs = len(context.statusTracker().getJobIdsForGroup("evidence"))
    assert jobs <= 42, jobs
