"""Null, NaN and tie rules on literal rows."""

import datetime as dt
import math

import numpy as np

import pytest

from panelspark.operators import columns as C
from panelspark.operators import filters as P
from panelspark.operators import joins as J
from panelspark.operators import ranking as R
from panelspark.operators import sets as S
from panelspark.operators import windows as W
from panelspark.operators.aggregates import (
    Agg,
    aggregate,
    distinct_by,
    latest_by_group,
    resample,
    summarize,
    weighted_mean,
)
from panelspark.operators.asof import asof_join
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def values(spark):
    rows = [(1, 5.0, "5"), (2, None, None), (3, NAN, "x"), (4, -1.0, " 7.5 "), (5, INF, "NaN")]
    return spark.createDataFrame(rows, "id int, v double, s string").coalesce(1)


def ids(df):
    return sorted(r["id"] for r in df.collect())


def column(df, name="y", key="id"):
    return [r[name] for r in df.orderBy(key).collect()]


@pytest.mark.parametrize(
    "comparison, expected",
    [("gt", [1, 5]), ("ge", [1, 5]), ("eq", []), ("ne", [1, 2, 3, 4, 5]), ("le", [4]), ("lt", [4])],
)
def test_numeric_filter_treats_nan_as_missing(values, comparison, expected):
    assert ids(P.filter_rows(values, "v", comparison, 0)) == expected


def test_text_column_against_number(values):
    assert ids(P.filter_rows(values, "s", "ge", 5)) == [1, 4]
    assert ids(P.filter_rows(values, "s", "ne", 5)) == [2, 3, 4, 5]
    assert ids(P.filter_rows(values, "s", "eq", "x")) == [3]


def test_contains_and_its_two_negations(values):
    assert ids(P.filter_rows(values, "s", "contains", "5")) == [1, 4]
    assert ids(P.filter_rows(values, "s", "not_contains", "5")) == [2, 3, 5]
    assert ids(P.read_filters(values, [("s", "not_contains", "5")])) == [3, 5]
    assert ids(P.read_filters(values, [("s", "ne", "x")])) == [1, 4, 5]


def test_negated_filters_keep_missing(values):
    assert ids(P.filter_set(values, "v", [5])) == [1]
    assert ids(P.filter_set(values, "v", [5], negate=True)) == [2, 3, 4, 5]
    assert ids(P.filter_range(values, "v", -2, 5)) == [1, 4]
    assert ids(P.filter_range(values, "v", -2, 5, negate=True)) == [2, 3, 5]
    assert ids(P.filter_null(values, "v")) == [2, 3]
    assert ids(P.drop_missing(values, ["v", "s"])) == [1, 4, 5]
    assert ids(P.read_filters(values, [("s", "not_in", ["5"])])) == [2, 3, 4, 5]


def test_quantile_filter_whole_and_split(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 3, 4, 10])], "id int, v double")
    assert ids(P.quantile_filter(df, "v", "ge", 0.6)) == [3, 4]
    assert ids(P.quantile_filter(df, "v", "ge", 0.6, block_rows=2)) == [3, 4]


def test_conditional_counts_on_text(values):
    (row,) = P.conditional_counts(
        values.withColumn("t", F.lit("a")), {"up": ("v", "gt", 0), "named": ("t", "gt", 0)}
    ).collect()
    assert (row.up, row.named) == (2, 5)


def test_codes(spark):
    codes = ["600000.SH", "900901.SH", "000001.SZ", "200002.SZ", "430047.BJ", "00001.SZ", "600000.HK", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "id int, c string")
    assert ids(df.where(P.valid_entity_code(F.col("c")))) == [0, 2, 4]


def test_derive(values):
    assert column(C.derive(values, "y", "v", "constant_minus", value=1)) == [-4, None, None, 2, -INF]
    assert column(C.derive(values, "y", "s", "add", value=1)) == [6, None, None, 8.5, None]
    for bad in ({"value": 0}, {}, {"value": 1, "right_field": "v"}):
        with pytest.raises(ValueError):
            C.derive(values, "y", "v", "divide", **bad)
    zero = values.withColumn("z", F.col("id") - 2)
    with pytest.raises(Exception, match="divisor is zero"):
        C.derive(zero, "y", "v", "divide", right_field="z").collect()


def test_column_tools(values):
    assert column(C.clip(values, "y", "v", lower=0, upper=3)) == [3, None, None, 0, 3]
    assert column(C.fill_constant(values, "y", "v", 9.0)) == [5, 9, 9, -1, INF]
    assert column(C.conditional_value(values, "y", "v", "gt", 0, "a", "b")) == ["a", "b", "b", "b", "a"]
    assert column(C.compare_scalar(values, "y", "v", "ne", 5)) == [False, True, True, True, True]
    both = values.withColumn("w", F.lit(0.0))
    assert column(C.compare_fields(both, "y", "v", "gt", "w")) == [True, False, False, False, True]
    assert column(C.coalesce_fields(both, "y", ["v", "w"])) == [5, 0, 0, -1, INF]
    assert C.tag_format(both.withColumnRenamed("w", "w_pct"), "w_pct").schema["w_pct"].metadata == {
        "value_format": "percent"
    }
    with pytest.raises(ValueError):
        C.rename_fields(values, {"v": "s"})
    with pytest.raises(ValueError):
        P.filter_rows(values, "missing", "gt", 1)


GROUPS = [("a", 1, 1.0), ("a", 2, None), ("a", 3, 3.0), ("b", 1, None), (None, 1, 4.0), (None, 2, 4.0)]


@pytest.fixture(scope="module")
def groups(spark):
    return spark.createDataFrame(GROUPS, "g string, o int, v double").coalesce(1)


EVERY = [
    Agg("n", "v", "count"), Agg("d", "v", "count_distinct"), Agg("s", "v", "sum"),
    Agg("m", "v", "mean"), Agg("md", "v", "median"), Agg("sd", "v", "std"),
    Agg("q", "v", "quantile", 0.25), Agg("f", "v", "first"), Agg("l", "v", "last"),
]


@pytest.mark.parametrize("block", [None, 2])
def test_aggregate_rules(groups, block):
    got = {r.g: r for r in aggregate(groups, ["g"], EVERY, order_by=["o"], block_rows=block).collect()}
    a, b, none = got["a"], got["b"], got[None]
    assert (a.n, a.d, a.s, a.m, a.md, a.q, a.f, a.l) == (2, 2, 4.0, 2.0, 2.0, 1.5, 1.0, 3.0)
    assert a.sd == pytest.approx(math.sqrt(2))
    assert (b.n, b.d, b.s, b.m, b.md, b.sd, b.f) == (0, 0, 0.0, None, None, None, None)
    assert (none.n, none.d, none.s, none.sd) == (2, 1, 8.0, 0.0)


@pytest.mark.parametrize("block", [None, 2])
def test_summarize_is_one_row(groups, block):
    (r,) = summarize(groups, EVERY, order_by=["o", "v"], block_rows=block).collect()
    assert (r.n, r.s, r.md) == (4, 12.0, 3.5)
    (empty,) = summarize(groups.where("o > 9"), EVERY[:5]).collect()
    assert (empty.n, empty.s, empty.md) == (0, 0.0, None)


def test_weighted_mean(spark):
    rows = [("a", 1.0, 1.0), ("a", 3.0, 3.0), ("a", None, 9.0), ("b", 2.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, x double, w double")
    got = {r.g: r.y for r in weighted_mean(df, "y", "x", "w", ["g"]).collect()}
    assert got == {"a": 2.5, "b": 2.0}
    for weight, message in ((-1.0, "below zero"), (0.0, "add up to nothing")):
        with pytest.raises(Exception, match=message):
            weighted_mean(df.withColumn("w", F.lit(weight)), "y", "x", "w", ["g"]).collect()


@pytest.mark.parametrize(
    "frequency, ends",
    [
        ("week", {"20240107", "20240204", "20240331"}),
        ("month", {"20240131", "20240331"}),
        ("quarter", {"20240331"}),
        ("year", {"20241231"}),
    ],
)
def test_resample_period_ends(spark, frequency, ends):
    rows = [("a", d, 1.0) for d in ("20240102", "20240107", "20240131", "20240331")]
    df = spark.createDataFrame(rows, "g string, d string, v double")
    got = resample(df, ["g"], "d", frequency, [Agg("n", "v", "count")]).collect()
    assert {r.d for r in got} == ends and sum(r.n for r in got) == 4
    with pytest.raises(Exception, match="valid dates"):
        resample(df.withColumn("d", F.lit("2024-1-1")), ["g"], "d", "week", [Agg("n", "v", "count")]).collect()


def test_one_row_per_group(groups):
    asc = {r.g: r.o for r in latest_by_group(groups, ["g"], "v", tie_break=["o"]).collect()}
    assert asc == {"a": 2, "b": 1, None: 2}  # a missing key wins; ties take the last row
    desc = {r.g: r.o for r in latest_by_group(groups, ["g"], "v", direction="desc", tie_break=["o"]).collect()}
    assert desc == {"a": 3, "b": 1, None: 1}
    assert {r.g: r.o for r in distinct_by(groups, ["g"], ["o"]).collect()} == {"a": 1, "b": 1, None: 1}
    assert {r.g: r.o for r in distinct_by(groups, ["g"], ["o"], keep="last").collect()} == {"a": 3, "b": 1, None: 2}


RANKED = [(1, 3.0), (2, 1.0), (3, 1.0), (4, None), (5, 2.0)]


@pytest.mark.parametrize("block", [None, 2])
@pytest.mark.parametrize(
    "method, expected",
    [
        ("min", [4, 1, 1, None, 3]), ("max", [4, 2, 2, None, 3]), ("average", [4, 1.5, 1.5, None, 3]),
        ("first", [4, 1, 2, None, 3]), ("dense", [3, 1, 1, None, 2]),
    ],
)
def test_rank_methods(spark, method, expected, block):
    df = spark.createDataFrame(RANKED, "id int, v double").coalesce(1)
    got = R.rank(df, "y", "v", method=method, tie_break=["id"], block_rows=block)
    assert column(got) == expected


@pytest.mark.parametrize("block", [None, 2])
def test_normalize(spark, block):
    df = spark.createDataFrame(RANKED, "id int, v double").coalesce(1)
    assert column(R.normalize(df, "y", "v", "minmax")) == [1.0, 0.0, 0.0, None, 0.5]
    assert column(R.normalize(df, "y", "v", "percentile", block_rows=block)) == [1.0, 0.375, 0.375, None, 0.75]
    flat = df.withColumn("v", F.lit(2.0))
    for method in ("zscore", "minmax"):
        assert column(R.normalize(flat, "y", "v", method)) == [None] * 5


def test_group_transform_keeps_rows_and_null_groups(groups):
    got = R.group_transform(groups, "y", "v", "sum", ["g"]).collect()
    assert sorted((str(r.g), r.y) for r in got) == [
        ("None", 8.0), ("None", 8.0), ("a", 4.0), ("a", 4.0), ("a", 4.0), ("b", 0.0),
    ]


def test_sort_limit_top_k(spark):
    df = spark.createDataFrame(RANKED + [(6, NAN)], "id int, v double")
    order = lambda d: [r.id for r in R.sort_rows(df, "v", direction=d, tie_break=["id"]).collect()]
    assert order("asc") == [2, 3, 5, 1, 4, 6] and order("desc") == [1, 5, 2, 3, 4, 6]
    assert [r.id for r in R.limit_rows(R.sort_rows(df, "v", tie_break=["id"]), 2).collect()] == [2, 3]
    with pytest.raises(ValueError):
        R.limit_rows(df, 0)
    top = R.top_k_by_group(df.withColumn("g", F.lit(1)), "v", ["g"], 2, tie_break=["id"])
    assert ids(top) == [1, 5]


def test_null_keys_match_in_joins_and_sets(spark):
    left = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id int, k string")
    right = spark.createDataFrame([("a", 10), ("a", 10), (None, 20)], "k string, v int")
    assert ids(J.semi_join(left, right, ["k"])) == [1, 2]
    assert ids(J.anti_join(left, right, ["k"])) == [3]
    assert column(J.match_source(left, right, ["k"], "y")) == [True, True, False]
    keys = lambda df: sorted(str(r.k) for r in df.collect())
    assert keys(S.intersect_keys(left, right, ["k"])) == ["None", "a"]
    assert keys(S.except_keys(left, right, ["k"])) == ["b"]
    with pytest.raises(ValueError):
        S.union_all(left, right)
    assert J.inner_join(left, right, ["k"], {"v": "w"}, cardinality="many_to_many").count() == 3


def test_cardinality_is_enforced_when_the_job_runs(spark):
    left = spark.createDataFrame([(1, "a"), (2, "a")], "id int, k string")
    right = spark.createDataFrame([("a", 10), ("z", 1), ("z", 2)], "k string, v int")
    lazy = J.join_fields(left, right, ["k"], {"v": "w"})
    with pytest.raises(Exception, match="duplicate keys on the right"):
        lazy.collect()
    one = right.where("k = 'a'")
    assert column(J.join_fields(left, one, ["k"], {"v": "w"}), "w") == [10, 10]
    with pytest.raises(Exception, match="duplicate keys on the left"):
        J.join_fields(left, one, ["k"], {"v": "w"}, cardinality="one_to_one").collect()
    with pytest.raises(ValueError):
        J.join_fields(left, one, ["k"], {"v": "id"})


SERIES = [("a", 1, 2.0, 1.0), ("a", 2, None, 2.0), ("a", 4, 4.0, 3.0), ("a", 5, 8.0, 3.0), ("b", 3, 0.0, 5.0), ("b", 4, 6.0, 5.0)]


@pytest.fixture(scope="module")
def series(spark):
    return spark.createDataFrame(SERIES, "g string, o int, v double, w double").coalesce(1)


def by_row(df):
    return [r.y for r in df.orderBy("g", "o").collect()]


@pytest.mark.parametrize("block", [None, 3])
def test_rolling_rules(series, block):
    roll = lambda f, **k: by_row(W.rolling(series, f, "y", "v", ["g"], "o", 2, block_rows=block, **k))
    assert roll("sum") == [None, None, None, 12.0, None, 6.0]
    assert roll("mean", min_periods=1) == [2.0, 2.0, 4.0, 6.0, 0.0, 3.0]
    assert roll("std", min_periods=1)[0] is None
    assert roll("quantile", q=0.25)[3] == 5.0
    # Session 3 exists for b only, so a's step from 2 to 4 is not consecutive.
    assert roll("max", min_periods=1, require_consecutive=True) == [None, 2.0, None, 8.0, None, 6.0]
    assert roll("covariance", right_field="w")[5] == 0.0
    assert roll("correlation", right_field="w")[5] is None  # a constant window


@pytest.mark.parametrize("block", [None, 3])
def test_shift_family(series, block):
    shift = lambda f, p=1, **k: by_row(W.shifted(series, f, "y", "v", ["g"], "o", p, block_rows=block, **k))
    assert shift("shift") == [None, 2.0, None, 4.0, None, 0.0]
    assert shift("shift", -1) == [None, 4.0, 8.0, None, 6.0, None]
    assert shift("diff", 2) == [None, None, 2.0, None, None, None]
    assert shift("pct_change") == [None, None, None, 1.0, None, INF]
    assert shift("diff", require_consecutive=True) == [None, None, None, 4.0, None, 6.0]
    with pytest.raises(ValueError):
        W.shifted(series, "diff", "y", "v", ["g"], "o", 0)


@pytest.mark.parametrize("block", [None, 2])
def test_cumulative(series, block):
    assert by_row(W.cumulative_sum(series, "y", "v", ["g"], "o", block_rows=block)) == [2, None, 6, 14, 0, 6]
    assert by_row(W.expanding_mean(series, "y", "v", ["g"], "o", min_periods=2, block_rows=block)) == [
        None, None, 3.0, pytest.approx(14 / 3), None, 3.0,
    ]


def test_offsets_snap_forward_and_stay_in_the_entity(spark):
    days = ["20240131", "20240201", "20240229", "20240305"]
    rows = [("a", d, float(i)) for i, d in enumerate(days)] + [("b", "20240131", 9.0)]
    df = spark.createDataFrame(rows, "g string, d string, v double")

    def run(offset, unit):
        got = W.match_at_offset(df, "y", "at", "v", ["g"], "d", offset, unit).orderBy("g", "d")
        return [(r.y, r["at"]) for r in got.collect()]

    none = (None, None)
    assert run(1, "trading_session") == [(1.0, days[1]), (2.0, days[2]), (3.0, days[3]), none, none]
    # One month after 31 January is 29 February; after 1 February it snaps to 5 March.
    assert run(1, "month") == [(2.0, days[2]), (3.0, days[3]), none, none, none]
    assert run(1, "week") == [(2.0, days[2]), (2.0, days[2]), none, none, none]


@pytest.mark.parametrize("block", [None, 2])
def test_asof_directions(spark, block):
    left = spark.createDataFrame([("a", 10.0), ("a", 15.0), ("a", 40.0), ("b", 10.0)], "g string, t double")
    right = spark.createDataFrame(
        [("a", 10.0, 1, "x"), ("a", 10.0, 2, "y"), ("a", 20.0, 3, "z"), ("a", 12.0, 4, "w")],
        "g string, at double, n int, label string",
    )

    def run(direction, tolerance=5):
        got = asof_join(
            left, right, ["g"], "t", "at", {"label": "label"}, tolerance=tolerance,
            direction=direction, right_tie_break=["n"], block_rows=block,
        )
        return [r.label for r in got.orderBy("g", "t").collect()]

    assert run("backward") == ["y", "w", None, None]  # last of the duplicate times
    assert run("forward") == ["x", "z", None, None]  # first of the duplicate times
    assert run("nearest") == ["y", "w", None, None]
    assert run("nearest", 25) == ["y", "w", "z", None]
    assert run("backward", 2) == ["y", None, None, None]


def test_asof_nearest_tie_takes_the_earlier_row(spark):
    left = spark.createDataFrame([(1, 15.0)], "g int, t double")
    right = spark.createDataFrame([(1, 10.0, "x"), (1, 20.0, "z")], "g int, at double, label string")
    (r,) = asof_join(left, right, ["g"], "t", "at", {"label": "l"}, tolerance=5, direction="nearest").collect()
    assert r.l == "x"
    with pytest.raises(Exception, match="as-of keys"):
        asof_join(left.withColumn("t", F.lit("q")), right, ["g"], "t", "at", {"label": "l"}, tolerance=5).collect()


def test_asof_dates_use_days(spark):
    left = spark.createDataFrame([(1, dt.date(2024, 3, 1))], "g int, t date")
    right = spark.createDataFrame([(1, dt.date(2024, 2, 28), "x")], "g int, at date, label string")
    run = lambda days: asof_join(left, right, ["g"], "t", "at", {"label": "l"}, tolerance=days).first().l
    assert run(2) == "x" and run(1) is None


def exchanges(df):
    """Exchanges by hash in the plan that ran, subqueries included."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return plan.count("Exchange hashpartitioning")


def test_checked_joins_shuffle_each_side_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = spark.range(1000).select((F.col("id") % 97).alias("k"), F.col("id").alias("x"))
        right = spark.range(97).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
        for null_keys in (True, False):
            run = lambda a, c: J.join_fields(a, right, ["k"], {"v": "w"}, cardinality=c, null_keys=null_keys)
            assert exchanges(run(left, "many_to_one")) == 2
            assert exchanges(run(left.where("x < 97"), "one_to_one")) == 2
            with pytest.raises(Exception, match="duplicate keys on the left"):
                run(left, "one_to_one").collect()
            # A repeat fails though no row asks for it.
            twice = right.union(right.where("k = 5"))
            with pytest.raises(Exception, match="duplicate keys on the right"):
                J.inner_join(left.where("k = 7"), twice, ["k"], {"v": "w"}, null_keys=null_keys).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_checked_joins_match_nulls_and_cast_keys(spark):
    left = spark.createDataFrame([(1, None), (2, "a"), (3, "b")], "id int, k string")
    right = spark.createDataFrame([(None, 10), ("a", 20)], "k string, v int")
    got = {r.id: r.w for r in J.join_fields(left, right, ["k"], {"v": "w"}).collect()}
    assert got == {1: 10, 2: 20, 3: None}
    got = {r.id: r.w for r in J.join_fields(left, right, ["k"], {"v": "w"}, null_keys=False).collect()}
    assert got == {1: None, 2: 20, 3: None}
    longs = right.select(F.when(F.col("k") == "a", 2).cast("long").alias("id"), "v")
    got = {r.id: r.w for r in J.join_fields(left.drop("k"), longs, ["id"], {"v": "w"}).collect()}
    assert got == {1: None, 2: 20, 3: None}


def test_all_levels_of_a_field_share_one_buffer(spark):
    df = spark.range(101).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"))
    aggs = [Agg("a", "v", "median"), Agg("n", "v", "count"), Agg("b", "v", "quantile", 0.1), Agg("c", "v", "quantile", 0.9)]
    out = aggregate(df, ["g"], aggs, max_group_rows=101)
    assert out.columns == ["g", "a", "n", "b", "c"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("percentile(") == 1
    want = {g: np.quantile(np.arange(g, 101, 3), [0.5, 0.1, 0.9]) for g in range(3)}
    for r in out.collect():
        assert [r.a, r.b, r.c] == pytest.approx(list(want[r.g])) and r.n == len(range(r.g, 101, 3))


def test_offsets_meet_in_one_shuffle(spark):
    days = spark.createDataFrame([(f"2024-01-{d:02d}",) for d in range(1, 11)], "s string").select(F.to_date("s").alias("session"))
    df = days.crossJoin(spark.createDataFrame([("a",), (None,)], "g string")).select("g", F.col("session").alias("d"), F.dayofmonth("session").cast("double").alias("v"))
    df = df.where("g IS NOT NULL OR v <> 4")
    got = W.match_at_offset(df, "y", "at", "v", ["g"], "d", 2, "trading_session", sessions=days)
    # One is that of the calendar.
    assert exchanges(got) == 2
    rows = {(r.g, int(r.v)): (r.y, r["at"]) for r in got.collect()}
    assert rows["a", 3] == (5.0, "20240105") and rows["a", 9] == (None, None)
    assert rows[None, 2] == (None, None) and rows[None, 3] == (5.0, "20240105")
    assert len(rows) == got.count() == 19
    strict = W.match_at_offset(df, "y", "at", "v", ["g"], "d", 2, "trading_session", sessions=days, null_keys=False)
    assert {r.y for r in strict.where("g IS NULL").collect()} == {None}
    with pytest.raises(Exception, match="tie_break"):
        W.match_at_offset(df.union(df.limit(1)), "y", "at", "v", ["g"], "d", 2, "day", sessions=days).collect()
