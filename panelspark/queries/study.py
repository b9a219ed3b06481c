"""Event-study panel queries: assembly, labels, windows and every feature."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.plans import panel as E
from panelspark.queries.base import register
from panelspark.queries.panels import NATION_WEEK, nation_week
from panelspark.session import stored

HORIZON = 4


def weekly(t):
    """The weekly table, written once: the study reads it several times."""
    return stored(nation_week(t))


def sessions_of(rows):
    """The calendar: distinct sessions of the weekly table."""
    return rows.select("session").distinct()


def assembled(rows):
    """The weekly table as the three inputs of a panel: prices, factors, valuations."""
    # The table is unique per (entity, session): one row per week in a window.
    before = F.lag("close").over(Window.partitionBy("entity").orderBy("session"))
    prices = rows.withColumn("pre_close", before).select(
        "entity", "session", "open", "high", "low", "close", "pre_close", "vol", "amount"
    )
    return E.assemble(
        prices,
        rows.select("entity", "session", "adj_factor"),
        rows.select("entity", "session", "turnover_rate", "close"),
    )


def ranked(t):
    rows = weekly(t)
    return E.with_rank(assembled(rows), E.numbered_calendar(sessions_of(rows)))


def labelled(t):
    rows = weekly(t)
    calendar = E.numbered_calendar(sessions_of(rows))
    return E.forward_label(E.with_rank(assembled(rows), calendar), calendar, HORIZON)


def panel_sql(table: str, unit: str) -> str:
    """CTEs of a panel over the weeks or months of the lines."""
    return f"""cal AS (SELECT session, row_number() OVER (ORDER BY session) - 1 AS n
  FROM (SELECT DISTINCT CAST(date_trunc('{unit}', l_shipdate) AS DATE) AS session FROM lineitem)),
panel AS (SELECT w.*, lag(close) OVER (PARTITION BY entity ORDER BY session) AS pre_close,
  close * adj_factor AS adj, n FROM {table} w JOIN cal USING (session)),
steps AS (SELECT *, adj / lag(adj) OVER (PARTITION BY entity ORDER BY n) - 1 AS step FROM panel)"""


PANEL = panel_sql("nation_week", "week")
CTES = (NATION_WEEK, PANEL)

register(
    "panel_assemble",
    "entity:i session:d close:f pre_close:f adj_factor:f adjusted_close:f turnover_rate:f",
    lambda t: assembled(weekly(t)),
    """SELECT entity, session, close, pre_close, adj_factor, adj AS adjusted_close, turnover_rate
       FROM panel""",
    CTES,
)
register(
    "adjusted_close",
    "entity:i session:d adjusted_close:f",
    lambda t: assembled(weekly(t)),
    "SELECT entity, session, adj AS adjusted_close FROM panel",
    CTES,
)


def _broken(t):
    """Inputs with natural defects: lines as prices repeat keys, heavy lines lack factors."""
    line = t.lineitem.select(
        F.col("l_suppkey").alias("entity"),
        F.col("l_shipdate").cast("date").alias("session"),
        F.when(F.col("l_discount") == 0, F.lit(0.0)).otherwise(F.col("l_extendedprice")).alias("close"),
        F.col("l_quantity").alias("quantity"),
        (1 + F.col("l_tax")).alias("adj_factor"),
    )
    factors = line.where(F.col("quantity") <= 40).groupBy("entity", "session").agg(
        F.max("adj_factor").alias("adj_factor")
    )
    days = t.orders.select(F.col("o_orderdate").cast("date").alias("session")).distinct()
    return E.panel_checks(line, factors, days)


register(
    "panel_checks",
    "problem:s session:d n:i",
    _broken,
    """SELECT * FROM (
      SELECT 'empty_session' AS problem, session, 1 AS n FROM
        (SELECT DISTINCT CAST(o_orderdate AS DATE) AS session FROM orders)
        WHERE session NOT IN (SELECT session FROM line)
      UNION ALL SELECT 'duplicate_price', session, sum(c) FROM (SELECT entity, session, count(*) AS c
        FROM line GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY session
      UNION ALL SELECT 'missing_adjustment', l.session, count(*) FROM line l
        LEFT JOIN (SELECT DISTINCT entity, session FROM line WHERE q <= 40) f
        ON f.entity = l.entity AND f.session = l.session WHERE f.entity IS NULL GROUP BY l.session
      UNION ALL SELECT 'invalid_close', session, count(*) FROM line WHERE d = 0 GROUP BY session)""",
    (
        """line AS (SELECT l_suppkey AS entity, CAST(l_shipdate AS DATE) AS session,
          l_discount AS d, l_quantity AS q FROM lineitem)""",
    ),
)
register(
    "forward_return",
    "entity:i session:d future_session:d forward_return:f",
    labelled,
    """SELECT p.entity, p.session, c.session AS future_session, f.adj / p.adj - 1 AS forward_return
       FROM panel p LEFT JOIN cal c ON c.n = p.n + 4
       LEFT JOIN panel f ON f.entity = p.entity AND f.n = p.n + 4""",
    CTES,
)
register(
    "research_window",
    "session:d is_signal:b",
    lambda t: E.research_window(sessions_of(nation_week(t)), "19960401", "19981231", horizon=4, lookback=3),
    """SELECT session, n BETWEEN a AND b AS is_signal FROM cal, (
       SELECT min(n) AS a, max(n) AS b FROM cal
       WHERE session BETWEEN DATE '1996-04-01' AND DATE '1998-12-31')
       WHERE n BETWEEN a - 3 AND b + 4""",
    (PANEL.split("panel AS")[0].rstrip().rstrip(","),),
)
register(
    "purge_overlap",
    "entity:i session:d future_session:d",
    lambda t: E.purge_overlap(labelled(t), "19980101"),
    """SELECT p.entity, p.session, c.session AS future_session FROM panel p
       JOIN cal c ON c.n = p.n + 4 WHERE c.session < DATE '1998-01-01'""",
    CTES,
)
register(
    "factor_coverage",
    "factor:s coverage:f",
    lambda t: E.factor_coverage(
        E.add_features(ranked(t), ["return_5d_pct", "return_20d_pct"]),
        ["pre_close", "return_5d_pct", "return_20d_pct", "pe"],
    ),
    """SELECT 'pre_close' AS factor, avg(CAST(pre_close IS NOT NULL AS INT)) AS coverage FROM panel
       UNION ALL SELECT 'return_5d_pct', avg(CAST(r5 AS INT)) FROM flags
       UNION ALL SELECT 'return_20d_pct', avg(CAST(r20 AS INT)) FROM flags
       UNION ALL SELECT 'pe', 0.0""",
    (
        *CTES,
        """flags AS (SELECT coalesce(n - lag(n, 5) OVER w = 5, FALSE) AS r5,
          coalesce(n - lag(n, 20) OVER w = 20, FALSE) AS r20
          FROM panel WINDOW w AS (PARTITION BY entity ORDER BY n))""",
    ),
)


def _w(sessions: int) -> str:
    return f"(PARTITION BY entity ORDER BY n ROWS BETWEEN {sessions} PRECEDING AND CURRENT ROW)"


def _run(sessions: int) -> str:
    return f"n - lag(n, {sessions}) OVER (PARTITION BY entity ORDER BY n) = {sessions}"


def _lag(k: int) -> str:
    return f"lag(adj, {k}) OVER (PARTITION BY entity ORDER BY n)" if k else "adj"


def _drawdown() -> str:
    prices = [_lag(k) for k in range(5, -1, -1)]
    ratios = [f"{p} / greatest({', '.join(prices[: i + 1])})" for i, p in enumerate(prices)]
    return f"(least({', '.join(ratios)}) - 1) * 100"


def _mean(source: str, w: int) -> str:
    return (
        f"CASE WHEN {_run(w - 1)} AND count({source}) OVER {_w(w - 1)} = {w} "
        f"THEN avg({source}) OVER {_w(w - 1)} END"
    )


_FEATURES: dict[str, dict[str, str]] = {
    "feat_intraday": {
        "intraday_range_pct": "CASE WHEN pre_close > 0 THEN (high - low) / pre_close * 100 END",
        "open_gap_pct": "CASE WHEN pre_close > 0 AND open > 0 THEN (open / pre_close - 1) * 100 END",
        "intraday_return_pct": "CASE WHEN open > 0 THEN (close / open - 1) * 100 END",
        "close_location_pct": "CASE WHEN high > low THEN (close - low) / (high - low) * 100 END",
    },
    "feat_return": {
        f"return_{w}d_pct": f"CASE WHEN {_run(w)} THEN (adj / {_lag(w)} - 1) * 100 END"
        for w in (5, 10, 20)
    },
    "feat_volatility": {
        f"volatility_{w}d_pct": f"CASE WHEN {_run(w)} THEN stddev_pop(step) OVER {_w(w - 1)} * 100 END"
        for w in (5, 10, 20)
    },
    "feat_drawdown": {"max_drawdown_5d_pct": f"CASE WHEN {_run(5)} THEN {_drawdown()} END"},
    "feat_peak_distance": {
        f"distance_from_{w}d_peak_pct": f"CASE WHEN {_run(w)} THEN (adj / max(adj) OVER {_w(w)} - 1) * 100 END"
        for w in (5, 10, 20)
    },
    "feat_ma_distance": {
        f"distance_from_{w}d_ma_pct": f"CASE WHEN {_run(w - 1)} THEN (adj / avg(adj) OVER {_w(w - 1)} - 1) * 100 END"
        for w in (5, 10, 20)
    },
    "feat_positive_days": {
        f"positive_days_{w}": f"CASE WHEN {_run(w)} THEN sum(CASE WHEN step > 0 THEN 1 ELSE 0 END) OVER {_w(w - 1)} END"
        for w in (3, 5, 10)
    },
    "feat_downside": {
        f"downside_deviation_{w}d_pct": f"CASE WHEN {_run(w)} THEN sqrt(avg(CASE WHEN step IS NOT NULL THEN least(step, 0) * least(step, 0) END) OVER {_w(w - 1)}) * 100 END"
        for w in (5, 10, 20)
    },
    "feat_activity_ratio": {
        f"{prefix}_to_{w}d_avg_ratio": f"{source} / nullif({_mean(source, w)}, 0)"
        for prefix, source in (("volume", "vol"), ("amount", "amount"), ("turnover", "turnover_rate"))
        for w in (5, 20)
    },
    "feat_activity_trend": {
        f"{prefix}_5d_to_20d_avg_ratio": f"{_mean(source, 5)} / nullif({_mean(source, 20)}, 0)"
        for prefix, source in (("volume", "vol"), ("amount", "amount"), ("turnover", "turnover_rate"))
    },
    "feat_turnover_avg": {
        f"turnover_{w}d_avg_pct": _mean("turnover_rate", w) for w in (5, 20)
    },
}
for _name, _columns in _FEATURES.items():
    register(
        _name,
        "entity:i session:d " + " ".join(f"{c}:f" for c in _columns),
        lambda t, names=list(_columns): E.add_features(ranked(t), names),
        "SELECT entity, session, "
        + ", ".join(f"{sql} AS {column}" for column, sql in _columns.items())
        + " FROM steps",
        CTES,
    )


def _all_features(t):
    names = E.DERIVED_FACTORS
    panel = E.add_features(ranked(t), names)
    return panel.select("entity", "session", *names)


register(
    "feat_all",
    "entity:i session:d " + " ".join(f"{c}:f" for c in E.DERIVED_FACTORS),
    _all_features,
    "SELECT entity, session, "
    + ", ".join(f"{sql} AS {c}" for group in _FEATURES.values() for c, sql in group.items())
    + " FROM steps",
    CTES,
)
