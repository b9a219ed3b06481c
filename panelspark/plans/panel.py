"""Event-study panel: assembly, forward labels and point-in-time features.

The panel is keyed by (entity, session), which assembly enforces, so a window over one
entity sees at most one row per session of the calendar. Labels and all features share
one window order: one shuffle by entity, one sort, no self-join.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.functions.semantics import dtype, key_join, number
from panelspark.operators.filters import valid_entity_code
from panelspark.operators.joins import checked_unique, duplicate_keys
from panelspark.sources.reads import parse_day

ENTITY, SESSION, RANK = "entity", "session", "session_rank"
KEYS = [ENTITY, SESSION]

# The price columns of a session, and the factors a rule may use.
PRICE_FIELDS = ("open", "high", "low", "close", "pre_close", "pct_chg", "vol", "amount")
BASE_FACTORS = [
    "amount",
    "circ_mv",
    "close",
    "dv_ratio",
    "dv_ttm",
    "float_share",
    "free_share",
    "open",
    "pb",
    "pct_chg",
    "pe",
    "pe_ttm",
    "ps",
    "ps_ttm",
    "total_mv",
    "total_share",
    "turnover_rate",
    "turnover_rate_f",
    "vol",
    "volume_ratio",
]
CALENDAR_FACTOR, CALENDAR_FLOOR_DAYS = 3, 31
LOOKBACK_SESSIONS = 20


def numbered_calendar(sessions: DataFrame) -> DataFrame:
    """``(session, session_rank)`` from 0. A calendar is small enough for one task."""
    return sessions.select(
        SESSION, (F.row_number().over(Window.orderBy(SESSION)) - 1).alias(RANK)
    )


def broadcast_calendar(calendar: DataFrame) -> DataFrame:
    """The calendar with a broadcast hint if its sessions are dates: only those are bounded."""
    return F.broadcast(calendar) if isinstance(dtype(calendar, SESSION), T.DateType) else calendar


def _listed(df: DataFrame) -> DataFrame:
    if isinstance(dtype(df, ENTITY), T.StringType):
        return df.where(valid_entity_code(F.col(ENTITY)))
    return df


def assemble(
    prices: DataFrame, adjustments: DataFrame, valuations: DataFrame | None = None
) -> DataFrame:
    """Prices with their adjustment factor and, where present, valuation fields.

    Price and adjustment columns win over valuation columns of the same name. The job
    fails on a repeated key in any input, a price without an adjustment factor, or a
    close or factor that is not a positive finite number.
    """
    prices, adjustments = _listed(prices), _listed(adjustments)
    # Each check uses the exchange and sort of the join that follows it.
    prices = checked_unique(prices, KEYS, "duplicate price rows")
    adjustments = checked_unique(adjustments, KEYS, "duplicate adjustment rows")
    panel = key_join(prices, adjustments, KEYS, "left", ["adj_factor"], null_keys=False)
    # Checked in the value itself: a later filter on the factor could otherwise turn the
    # outer join into an inner one and hide the gap.
    absent = F.raise_error(F.lit("missing adjustment factor"))
    kind = dtype(adjustments, "adj_factor")
    panel = panel.withColumn("adj_factor", F.coalesce("adj_factor", absent.cast(kind)))
    if valuations is not None:
        valuations = _listed(valuations)
        extra = [c for c in valuations.columns if c not in panel.columns]
        valuations = checked_unique(valuations, KEYS, "duplicate valuation rows")
        panel = key_join(panel, valuations, KEYS, "left", extra, null_keys=False)
    close, factor = number(panel, "close"), number(panel, "adj_factor")
    limit = F.lit(float("inf"))
    valid = (close > 0) & (close < limit) & (factor > 0) & (factor < limit)
    invalid = F.raise_error(F.lit("invalid close or adjustment factor")).cast("double")
    return panel.withColumn(
        "adjusted_close", F.when(F.coalesce(valid, F.lit(False)), close * factor).otherwise(invalid)
    )


def panel_checks(prices: DataFrame, adjustments: DataFrame, sessions: DataFrame) -> DataFrame:
    """The same conditions as a report ``(problem, session, n)``, without failing."""
    prices, adjustments = _listed(prices), _listed(adjustments)
    observed = prices.select(SESSION).distinct()
    empty = sessions.join(observed, SESSION, "left_anti").select(
        F.lit("empty_session").alias("problem"), SESSION, F.lit(1).cast("long").alias("n")
    )

    def repeated(df: DataFrame, name: str) -> DataFrame:
        return duplicate_keys(df, KEYS).groupBy(SESSION).agg(F.sum("n").alias("n")).select(
            F.lit(name).alias("problem"), SESSION, "n"
        )

    adjusted = adjustments.select(*KEYS).distinct()
    unadjusted = key_join(prices, adjusted, KEYS, "left_anti", null_keys=False)
    value = number(prices, "close")
    bad_close = prices.where(~F.coalesce((value > 0) & (value < float("inf")), F.lit(False)))
    factor = number(adjustments, "adj_factor")
    bad_factor = adjustments.where(
        ~F.coalesce((factor > 0) & (factor < float("inf")), F.lit(False))
    )

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(SESSION).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("problem"), SESSION, "n"
        )

    report = empty
    for part in (
        repeated(prices, "duplicate_price"),
        repeated(adjustments, "duplicate_adjustment"),
        counted(unadjusted, "missing_adjustment"),
        counted(bad_close, "invalid_close"),
        counted(bad_factor, "invalid_adjustment"),
    ):
        report = report.unionByName(part)
    return report


def research_window(
    sessions: DataFrame,
    start: str,
    end: str,
    *,
    horizon: int,
    lookback: int = LOOKBACK_SESSIONS,
    session_days: int = CALENDAR_FACTOR,
) -> DataFrame:
    """The sessions a study reads: ``(session, session_rank, is_signal)``.

    Signal sessions lie in the window; ``lookback`` sessions precede and ``horizon``
    follow them. The calendar is first cut to a generous range of days: ``session_days`` for
    each of those sessions (a panel of weeks or months needs more than one of days). The job
    fails if the window has no session or the horizon leaves the calendar.
    """
    first, last = parse_day(start), parse_day(end)
    back = max(CALENDAR_FLOOR_DAYS, session_days * lookback)
    ahead = max(CALENDAR_FLOOR_DAYS, session_days * horizon)
    near = sessions.where(
        F.col(SESSION).between(
            F.date_sub(F.lit(first), back), F.date_add(F.lit(last), ahead)
        )
    )
    signal = F.col(SESSION).between(F.lit(first), F.lit(last))
    everything = Window.partitionBy()
    ranked = numbered_calendar(near).withColumn("is_signal", signal)
    def stop(message: str) -> Column:
        return F.raise_error(F.lit(message)).cast("int")

    # The checks sit in the values the filter needs, so no rewrite can drop them.
    end_rank = F.max(RANK).over(everything)
    first_rank = F.min(F.when(F.col("is_signal"), F.col(RANK))).over(everything)
    last_rank = F.max(F.when(F.col("is_signal"), F.col(RANK))).over(everything)
    edges = ranked.withColumns(
        {"__first": first_rank, "__last": last_rank, "__end": end_rank}
    ).select(
        SESSION,
        RANK,
        "is_signal",
        F.coalesce("__first", stop("the window has no trading session")).alias("__first"),
        F.when(F.col("__last") + horizon <= F.col("__end"), F.col("__last"))
        .when(F.col("__last").isNotNull(), stop("the forward window extends beyond the calendar"))
        .alias("__last"),
    )
    return edges.where(
        F.col(RANK).between(F.col("__first") - lookback, F.col("__last") + horizon)
    ).select(SESSION, RANK, "is_signal")


def _by_entity():
    return Window.partitionBy(ENTITY).orderBy(RANK)


def with_rank(panel: DataFrame, calendar: DataFrame) -> DataFrame:
    """Attach session numbers; the calendar is one row per day, so it is broadcast."""
    extra = [c for c in calendar.columns if c != SESSION and c not in panel.columns]
    table = broadcast_calendar(calendar.select(SESSION, *extra))
    return panel.join(table, SESSION).select(*panel.columns, *extra)


def forward_label(panel: DataFrame, calendar: DataFrame, horizon: int) -> DataFrame:
    """Add ``future_session`` and ``forward_return`` over ``horizon`` calendar sessions.

    ``panel`` carries ``session_rank``. The future price is the entity's row at exactly
    that rank, read with a range frame; without one the return is missing and the row
    stays.
    """
    ahead = F.lead(SESSION, horizon).over(Window.orderBy(RANK))
    future = calendar.select(SESSION, RANK).withColumn("future_session", ahead)
    dated = panel.join(
        broadcast_calendar(future.select(SESSION, "future_session")), SESSION, "left"
    ).select(*panel.columns, "future_session")
    there = _by_entity().rangeBetween(horizon, horizon)
    price = F.max("adjusted_close").over(there)
    return dated.withColumn("forward_return", price / F.col("adjusted_close") - 1)


def _activity(prefix: str, source: str) -> dict[str, tuple[str, int | None]]:
    return {
        f"{prefix}_to_5d_avg_ratio": (source, 5),
        f"{prefix}_to_20d_avg_ratio": (source, 20),
        f"{prefix}_5d_to_20d_avg_ratio": (source, None),
    }


_ACTIVITY = {
    **_activity("volume", "vol"),
    **_activity("amount", "amount"),
    **_activity("turnover", "turnover_rate"),
}
# The lookback in sessions each derived factor needs.
LOOKBACKS: dict[str, int] = {
    **{f: 0 for f in ("intraday_range_pct", "open_gap_pct", "intraday_return_pct", "close_location_pct")},
    **{f"return_{w}d_pct": w for w in (5, 10, 20)},
    **{f"volatility_{w}d_pct": w for w in (5, 10, 20)},
    **{f"distance_from_{w}d_peak_pct": w for w in (5, 10, 20)},
    **{f"distance_from_{w}d_ma_pct": w - 1 for w in (5, 10, 20)},
    **{f"downside_deviation_{w}d_pct": w for w in (5, 10, 20)},
    **{f"positive_days_{w}": w for w in (3, 5, 10)},
    "max_drawdown_5d_pct": 5,
    **{f: (window or 20) - 1 for f, (_, window) in _ACTIVITY.items()},
    **{f"turnover_{w}d_avg_pct": w - 1 for w in (5, 20)},
}
DERIVED_FACTORS = sorted(LOOKBACKS)
FACTORS = sorted({*BASE_FACTORS, *DERIVED_FACTORS})


def lookback_for(factors: Sequence[str]) -> int:
    return max((LOOKBACKS.get(f, 0) for f in factors), default=0)


def _consecutive(sessions: int) -> Column:
    """The row ``sessions`` back exists and no session between was skipped."""
    return F.col(f"__run{sessions}")


def _over_last(rows: int, statistic: Column) -> Column:
    return statistic.over(_by_entity().rowsBetween(-(rows - 1), 0))


def _percent(ratio: Column) -> Column:
    return (ratio - 1) * 100


def _window_size(name: str) -> int:
    """The number in a factor's name, e.g. 20 in ``return_20d_pct``."""
    return int(re.search(r"_(\d+)", name).group(1))


def _average(source: str, rows: int) -> Column:
    return F.col(f"__avg_{source}_{rows}")


def _feature(name: str, have: Mapping[str, Column]) -> Column:
    """One factor, given the shared columns ``__step``, ``__run*`` and ``__avg_*``."""
    adjusted, step = F.col("adjusted_close"), F.col("__step")
    if name == "intraday_range_pct":
        before = have["pre_close"]
        return F.when(before > 0, (have["high"] - have["low"]) / before * 100)
    if name == "open_gap_pct":
        before, opened = have["pre_close"], have["open"]
        return F.when((before > 0) & (opened > 0), _percent(opened / before))
    if name == "intraday_return_pct":
        return F.when(have["open"] > 0, _percent(have["close"] / have["open"]))
    if name == "close_location_pct":
        span = have["high"] - have["low"]
        return F.when(have["high"] > have["low"], (have["close"] - have["low"]) / span * 100)
    if name in _ACTIVITY:
        source, window = _ACTIVITY[name]
        base = _average(source, window or 20)
        top = have[source] if window else _average(source, 5)
        return F.when(base > 0, top / base)
    w = _window_size(name)
    if name.startswith("turnover_"):
        return _average("turnover_rate", w)
    if name.startswith("return_"):
        earlier = F.lag("adjusted_close", w).over(_by_entity())
        return F.when(_consecutive(w), _percent(adjusted / earlier))
    if name.startswith("volatility_"):
        return F.when(_consecutive(w), _over_last(w, F.stddev_pop(step)) * 100)
    if name.startswith("downside_"):
        squared = F.pow(F.least(step, F.lit(0.0)), 2)
        return F.when(_consecutive(w), F.sqrt(_over_last(w, F.avg(squared))) * 100)
    if name.startswith("positive_days_"):
        ups = F.sum(F.when(step > 0, 1.0).otherwise(0.0))
        return F.when(_consecutive(w), _over_last(w, ups))
    if name == "max_drawdown_5d_pct":
        path = [F.lag("adjusted_close", k).over(_by_entity()) for k in range(5, 0, -1)]
        path.append(adjusted)
        peaks = [path[0]]
        for price in path[1:]:
            peaks.append(F.greatest(peaks[-1], price))
        worst = F.least(*[price / peak for price, peak in zip(path, peaks)])
        return F.when(_consecutive(5), _percent(worst))
    if name.endswith("peak_pct"):
        peak = _over_last(w + 1, F.max("adjusted_close"))
        return F.when(_consecutive(w), _percent(adjusted / peak))
    if name.endswith("ma_pct"):
        mean = _over_last(w, F.avg("adjusted_close"))
        return F.when(_consecutive(w - 1), _percent(adjusted / mean))
    raise ValueError(f"unknown factor: {name}")


def _averages_for(factors: Sequence[str]) -> set[tuple[str, int]]:
    """The activity averages some factors are built from."""
    needed = set()
    for name in factors:
        if name in _ACTIVITY:
            source, window = _ACTIVITY[name]
            needed |= {(source, window)} if window else {(source, 5), (source, 20)}
        elif name.startswith("turnover_"):
            needed.add(("turnover_rate", _window_size(name)))
    return needed


def add_features(panel: DataFrame, factors: Sequence[str] | None = None) -> DataFrame:
    """Add derived factors. ``panel`` has ``adjusted_close`` and ``session_rank``.

    Only sessions up to the current one are used, and a feature is missing if its
    window skips a session. Inputs the panel lacks count as missing. Columns several
    factors share are windows of their own, so Spark computes each once; all windows
    have the same order and cost one shuffle and one sort.
    """
    wanted = DERIVED_FACTORS if factors is None else [f for f in factors if f in LOOKBACKS]
    inputs = {*PRICE_FIELDS, "turnover_rate"}
    have = {
        f: number(panel, f) if f in panel.columns else F.lit(None).cast("double") for f in inputs
    }
    order = _by_entity()
    averages = sorted(_averages_for(wanted))
    spans = {LOOKBACKS[f] for f in wanted} | {rows - 1 for _, rows in averages}
    shared = {"__step": F.col("adjusted_close") / F.lag("adjusted_close", 1).over(order) - 1}
    for span in sorted(spans - {0}):
        shared[f"__run{span}"] = F.col(RANK) - F.lag(RANK, span).over(order) == span
    for source, rows in averages:
        x = have[source]
        shared[f"__avg_{source}_{rows}"] = F.when(
            (F.col(RANK) - F.lag(RANK, rows - 1).over(order) == rows - 1)
            & (_over_last(rows, F.count(x)) == rows),
            _over_last(rows, F.avg(x)),
        )
    return (
        panel.withColumns(shared)
        .withColumns({f: _feature(f, have) for f in wanted})
        .drop(*shared)
    )


def purge_overlap(train: DataFrame, validation_start: str) -> DataFrame:
    """Drop training rows whose outcome date reaches the validation window."""
    return train.where(F.col("future_session") < F.lit(parse_day(validation_start)))


def finite(df: DataFrame, field: str) -> Column:
    """The number, or null where it is missing or infinite."""
    value = number(df, field)
    return F.when(F.abs(value) < float("inf"), value)


def factor_coverage(panel: DataFrame, factors: Sequence[str]) -> DataFrame:
    """``(factor, coverage)``: the share of rows with a finite value."""
    shares = panel.agg(
        *[
            F.coalesce(
                F.avg(finite(panel, f).isNotNull().cast("double"))
                if f in panel.columns
                else F.lit(0.0),
                F.lit(0.0),
            ).alias(f)
            for f in factors
        ]
    )
    return shares.unpivot([], list(factors), "factor", "coverage")


def research_dataset(
    panel: DataFrame,
    sessions: DataFrame,
    start: str,
    end: str,
    *,
    horizon: int,
    factors: Sequence[str] | None = None,
    session_days: int = CALENDAR_FACTOR,
) -> DataFrame:
    """Signal rows of a window with factors, ``future_session`` and ``forward_return``.

    ``panel`` comes from ``assemble``. Only the sessions the factors look back on and
    the horizon reaches are read.
    """
    lookback = LOOKBACK_SESSIONS if factors is None else lookback_for(factors)
    calendar = research_window(
        sessions, start, end, horizon=horizon, lookback=lookback, session_days=session_days
    )
    ranked = with_rank(panel, calendar)
    labelled = forward_label(ranked, calendar, horizon)
    featured = add_features(labelled, factors).where(F.col("is_signal"))
    if factors is None:
        return featured.drop("is_signal")
    present = [f for f in dict.fromkeys(factors) if f in featured.columns]
    return featured.select(*KEYS, "future_session", "forward_return", *present)
