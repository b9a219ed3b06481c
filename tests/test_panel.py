"""Guards and labels of the event-study panel; sources and quality jobs."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from panelspark.operators.aggregates import Agg
from panelspark.plans import panel as E
from panelspark.plans import quality as Q
from panelspark.plans import transforms as X
from panelspark.sources import calendar as K
from panelspark.sources import master as M
from panelspark.sources import reads
from pyspark.sql import functions as F

DAY = dt.date(2024, 1, 1)
PRICE = "entity string, session date, close double"


def day(i):
    return DAY + dt.timedelta(days=i)


@pytest.fixture(scope="module")
def inputs(spark):
    codes = ["600000.SH", "000001.SZ", "900901.SH"]
    rows = [(c, day(d), 10.0 + d + k) for k, c in enumerate(codes) for d in range(12) if not (k == 1 and d == 5)]
    prices = spark.createDataFrame(rows, PRICE).coalesce(1)
    factors = prices.select("entity", "session", F.lit(2.0).alias("adj_factor"))
    values = prices.select("entity", "session", F.lit(0.0).alias("close"), F.lit(7.0).alias("pe"))
    sessions = prices.select("session").distinct()
    return prices, factors, values, sessions


def test_assembly_keeps_valid_codes_and_price_columns(inputs):
    rows = E.assemble(*inputs[:3]).collect()
    assert {r.entity for r in rows} == {"600000.SH", "000001.SZ"} and len(rows) == 23
    assert all(r.close > 0 and r.pe == 7.0 and r.adjusted_close == 2 * r.close for r in rows)


@pytest.mark.parametrize(
    "message, change",
    [
        ("duplicate price", lambda p, f: (p.union(p), f)),
        ("duplicate adjustment", lambda p, f: (p, f.union(f))),
        ("missing adjustment", lambda p, f: (p, f.where("session > '2024-01-01'"))),
        ("invalid close", lambda p, f: (p.withColumn("close", F.lit(0.0)), f)),
        ("invalid close", lambda p, f: (p, f.withColumn("adj_factor", F.lit(float("inf"))))),
    ],
)
def test_assembly_fails_on_bad_input(inputs, message, change):
    with pytest.raises(Exception, match=message):
        E.assemble(*change(*inputs[:2])).collect()


def test_label_needs_the_exact_session(inputs):
    panel = E.with_rank(E.assemble(*inputs[:2]), E.numbered_calendar(inputs[3]))
    got = E.forward_label(panel, E.numbered_calendar(inputs[3]), 2).collect()
    rows = {(r.entity, (r.session - DAY).days): r for r in got}
    assert rows["600000.SH", 3].forward_return == pytest.approx(15 / 13 - 1)
    assert rows["000001.SZ", 3].forward_return is None  # no row on day 5
    assert rows["000001.SZ", 3].future_session == day(5)
    assert rows["600000.SH", 10].future_session is None and len(got) == 23


def test_window_limits(inputs):
    sessions = inputs[3]
    got = E.research_window(sessions, "20240104", "20240106", horizon=2, lookback=2).orderBy("session").collect()
    assert [(r.session, r.is_signal) for r in got] == [(day(i), 3 <= i <= 5) for i in range(1, 8)]
    with pytest.raises(Exception, match="beyond the calendar"):
        E.research_window(sessions, "20240104", "20240111", horizon=4, lookback=0).collect()
    with pytest.raises(Exception, match="no trading session"):
        E.research_window(sessions, "20240201", "20240203", horizon=1).collect()


def test_features_match_pandas(spark):
    rng = np.random.default_rng(5)
    price = np.exp(np.cumsum(rng.normal(0, 0.02, 40)))
    pdf = pd.DataFrame({"entity": 1, "session_rank": range(40), "adjusted_close": price, "vol": rng.random(40)})
    pdf = pdf[pdf.session_rank != 25]
    pdf["session"] = [day(int(i)) for i in pdf.session_rank]
    got = E.add_features(spark.createDataFrame(pdf)).orderBy("session_rank").toPandas()
    s = pdf.adjusted_close.reset_index(drop=True)
    step = s.pct_change()
    ok = lambda w: (pdf.session_rank.reset_index(drop=True).diff(w) == w)
    want = {
        "return_10d_pct": ((s / s.shift(10) - 1) * 100).where(ok(10)),
        "volatility_5d_pct": (step.rolling(5).std(ddof=0) * 100).where(ok(5)),
        "distance_from_20d_ma_pct": ((s / s.rolling(20).mean() - 1) * 100).where(ok(19)),
        "distance_from_5d_peak_pct": ((s / s.rolling(6).max() - 1) * 100).where(ok(5)),
        "downside_deviation_10d_pct": (step.clip(upper=0).pow(2).rolling(10).mean().pow(0.5) * 100).where(ok(10)),
        "positive_days_3": (step > 0).astype(float).rolling(3).sum().where(ok(3)),
        "max_drawdown_5d_pct": s.rolling(6).apply(lambda x: ((x / np.maximum.accumulate(x)) - 1).min() * 100).where(ok(5)),
        "volume_to_5d_avg_ratio": (
            lambda v: (v / v.rolling(5).mean()).where(ok(4))
        )(pdf.vol.reset_index(drop=True)),
    }
    for name, series in want.items():
        np.testing.assert_allclose(got[name].astype(float), series, rtol=1e-9, atol=1e-12, err_msg=name)
    assert got["turnover_5d_avg_pct"].isna().all()
    assert len(E.DERIVED_FACTORS) == 34 and len(E.FACTORS) == 54


def test_calendar_rules(spark):
    assert K.completed_day(dt.datetime(2024, 1, 5, 17, 9)) == dt.date(2024, 1, 4)
    assert K.completed_day(dt.datetime(2024, 1, 5, 17, 10)) == dt.date(2024, 1, 5)
    assert K.weekday_sessions(spark, "20240105", "20240109").count() == 3
    good = spark.createDataFrame([("20240105",), ("20240108",)], "cal_date string")
    assert K.strict_sessions(good, "cal_date", "20240101", "20240131").count() == 2
    bad = spark.createDataFrame([("20240105",), ("20240105",), ("x",), ("20250101",)], "cal_date string")
    assert {r.reason for r in K.calendar_violations(bad, "cal_date", "20240101", "20240131").collect()} == {
        "duplicate", "malformed", "out_of_range",
    }
    with pytest.raises(Exception, match="invalid trading calendar"):
        K.strict_sessions(bad, "cal_date", "20240101", "20240131").collect()


def test_range_reads(spark):
    rows = [(day(i), i) for i in (0, 1, 3)]
    df = spark.createDataFrame(rows, "d date, v int")
    sessions = spark.createDataFrame([(day(i),) for i in (0, 1)], "session date")
    assert reads.read_sessions(df, "d", "20240101", "20240103", sessions, ["v"]).count() == 2
    more = sessions.union(spark.createDataFrame([(day(2),)], "session date"))
    with pytest.raises(Exception, match="no rows"):
        reads.read_sessions(df, "d", "20240101", "20240103", more, ["v"]).collect()
    assert reads.read_disclosures(df, "d", "20240101", "20260101", ["v"]).count() == 3


def test_catalog_page_beyond_the_end(spark):
    rows = [(f"{i:06d}.SH", f"n{i}", " ", "SH") for i in range(5)]
    master = spark.createDataFrame(rows, "code string, name string, industry string, exchange string")
    page = M.catalog_page(master, page=2, page_size=3).collect()
    assert [r.code for r in page] == ["000003.SH", "000004.SH"] and page[0].total_pages == 2
    assert page[0].industry is None
    with pytest.raises(Exception, match="last page"):
        M.catalog_page(master, page=3, page_size=3).collect()


def test_period_return_rules(spark):
    rows = [("a", day(0), 2.0), ("a", day(1), None), ("a", day(2), 3.0), ("b", day(0), 1.0), ("c", day(0), 0.0), ("c", day(1), 5.0)]
    (r,) = X.period_return(spark.createDataFrame(rows, PRICE), "entity", "session", "close").collect()
    assert (r.entity, r.period_return_pct, r.start_date, r.end_date) == ("a", 50.0, day(0), day(2))


def test_concentration_needs_ten_holders(spark):
    rows = [("a", day(0), day(9), f"h{i}", 5.0) for i in range(9)]
    df = spark.createDataFrame(rows, "entity string, end_date date, ann_date date, holder string, ratio double")
    run = lambda d: X.concentration(d, "entity", "end_date", "ann_date", "holder", "ratio")
    with pytest.raises(Exception, match="ten distinct holders"):
        X.concentration(df, "entity", "end_date", "ann_date", "holder", "ratio", strict=True).collect()
    ten = df.union(df.limit(1).withColumn("holder", F.lit("HKSCC Nominees")))
    (r,) = run(ten).collect()
    assert (r.cr10_float_registered, r.omnibus_float_ratio, r.calculation_status) == (50.0, 5.0, "complete")
    (p,) = run(ten.withColumn("ratio", F.when(F.col("holder") != "h3", F.col("ratio")))).collect()
    assert (p.cr10_float_registered, p.known_top_holder_float_ratio, p.missing_ratio_holders) == (None, 45.0, ["h3"])
    assert p.uncovered_float_ratio_upper_bound == 55.0


@pytest.mark.parametrize("rows", [[], [None], [5.0], [1.0, 2.0], [3.0, 3.0, 3.0, 7.0, None], [0.1 * i for i in range(101)], [1.0, 1.0, 2.0, 2.0, 9.5]])
def test_summaries_are_checked_from_parts(spark, rows, monkeypatch):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, v double")
    aggs = [Agg(f, "v", f) for f in ("count", "count_distinct", "sum", "mean", "median", "min", "max", "std")]
    aggs += [Agg(f"q{q}", "v", "quantile", q / 100) for q in (0, 5, 33, 90, 100)]
    assert all(r.ok for r in Q.check_summary(df, aggs).collect())
    # A wrong summary is seen, whichever value it has.
    if len(rows) > 4:
        right = Q.summarize
        for wrong in (F.col("median") + 1e-3, F.col("median") - 1e-3):
            monkeypatch.setattr(Q, "summarize", lambda *a, wrong=wrong, **k: right(*a, **k).withColumn("median", wrong))
            assert [r.output for r in Q.check_summary(df, aggs).collect() if not r.ok] == ["median"]


def test_malformed_lists_are_rows_of_their_own(spark):
    """Short, long, repeating and overfull lists beside a proper one; none stops the job."""
    rows = [("ok", day(0), day(9), f"h{i}", 5.0) for i in range(10)]
    rows += [("short", day(0), day(9), f"h{i}", 5.0) for i in range(9)]
    rows += [("long", day(0), day(9), f"h{i}", None) for i in range(300)]
    rows += [("twice", day(0), day(9), f"h{min(i, 8)}", 5.0 + i) for i in range(10)]
    rows += [("over", day(0), day(9), f"h{i}", 50.0) for i in range(10)]
    rows += [("nameless", day(0), day(9), None if i else "h", 5.0 + i) for i in range(10)]
    # An older list of the same period, and an exact copy of a row, do not count.
    rows += [("ok", day(0), day(8), f"x{i}", 9.0) for i in range(4)] + [("ok", day(0), day(9), "h1", 5.0)]
    df = spark.createDataFrame(rows, "entity string, end_date date, ann_date date, holder string, ratio double")
    found = X.concentration(df, "entity", "end_date", "ann_date", "holder", "ratio")
    got = {r.entity: r for r in found.collect()}
    status = {e: (r.calculation_status, r.holder_count, r.cr10_float_registered) for e, r in got.items()}
    assert status == {
        "ok": ("complete", 10, 50.0),
        "short": (X.MALFORMED, 9, None),
        "long": (X.MALFORMED, 300, None),
        "twice": (X.MALFORMED, 9, None),
        "over": (X.OUTSIDE, 10, None),
        "nameless": (X.MALFORMED, 1, None),
    }
    assert all(r.missing_ratio_holders == [] and r.known_top_holder_float_ratio is None for r in got.values())
    with pytest.raises(Exception, match="outside 0-100"):
        X.concentration(df.where("entity = 'over'"), "entity", "end_date", "ann_date", "holder", "ratio", strict=True).collect()


def test_quality_reports(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 3.0, 2), ("b", None, 3), ("c", 2.0, 4)], "e string, v double, p int")
    (r,) = Q.check_ranking(df, "v", position="p", limit=3, entity="e").collect()
    assert (r.rows_over_limit, r.duplicate_entities, r.missing_values, r.out_of_order) == (1, 1, 1, 1)
    (c,) = Q.check_partition(df, "v", 2, ["lt", "eq", "gt"]).collect()
    assert (c.categories, c.valid_samples, c.ok) == (3, 3, True)
    with pytest.raises(ValueError):
        Q.check_partition(df, "v", 2, ["lt", "gt"])
    flat = df.select("v").withColumns({"a": F.lit(1.0), "b": F.lit(1.0)}).withColumn("v", F.lit(0.0))
    assert Q.check_degenerate(flat, "v", "a", "b").first().degenerate
    ok = Q.check_summary(df, [Agg("n", "v", "count"), Agg("m", "v", "median"), Agg("s", "v", "std")])
    assert all(r.ok for r in ok.collect())
    full, part = df.select("e"), df.where("e <> 'c'").select("e")
    report = Q.check_completeness(full, part, ["e"])
    assert report.first().status == "partial"
    assert Q.worst_status([report, Q.check_completeness(part, full, ["e"])]).first().status == "partial"
    assert Q.check_completeness(df.where("p > 9"), full, ["e"]).first().status == "unknown"
