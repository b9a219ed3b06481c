"""The ready-made analyses on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators.aggregates import Agg, aggregate
from panelspark.operators.windows import shifted
from panelspark.plans import analyses as A
from panelspark.queries.base import register
from panelspark.queries.panels import (
    DISCLOSURES,
    ERROR_DAYS,
    MASTER,
    NATION_WEEK,
    SESSION_BOUND,
    SUPPLIER_MONTH,
    USER_DAY,
    cents,
    disclosures,
    error_days,
    nation_week,
    security_master,
    supplier_month,
    user_day,
)

UD = (USER_DAY,)
BOUND = {"max_group_rows": SESSION_BOUND}


def names(t):
    """Customer names per entity."""
    return security_master(t).select("entity", "name", "industry")


def valuations(t):
    """One row per sold part: price as pe, size as pb, discount as yield, sales as value."""
    sold = t.lineitem.groupBy("l_partkey").agg(
        (F.sum(cents("l_discount")) / F.count(F.lit(1))).alias("dv"),
        (F.sum(cents("l_extendedprice")) / 100).alias("mv"),
    )
    return sold.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_partkey").alias("entity"),
        F.col("p_retailprice").alias("pe"),
        F.col("p_size").alias("pb"),
        "dv",
        "mv",
    )


VALUATIONS = """valuations AS (SELECT p_partkey AS entity, p_retailprice AS pe, p_size AS pb, dv, mv
  FROM (SELECT l_partkey,
      CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*) AS dv,
      CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS mv
    FROM lineitem GROUP BY 1) JOIN part ON l_partkey = p_partkey)"""


def part_names(t):
    return t.part.select(
        F.col("p_partkey").alias("entity"), F.col("p_name").alias("name"),
        F.col("p_brand").alias("industry"),
    )


def flows(t):
    """Order flow per supplier and ship day by line size and return flag."""
    amount, flag = cents("l_extendedprice"), F.col("l_returnflag")
    large = F.col("l_quantity") >= 30

    def total(condition):
        return F.coalesce(F.sum(F.when(condition, amount)), F.lit(0)) / 100

    return t.lineitem.groupBy(
        F.col("l_suppkey").alias("entity"), F.col("l_shipdate").cast("date").alias("session")
    ).agg(
        total((flag == "N") & large).alias("buy_lg"),
        total((flag == "A") & large).alias("buy_elg"),
        total((flag == "R") & large).alias("sell_lg"),
        total((flag == "N") & ~large).alias("buy_sm"),
        total((flag == "R") & ~large).alias("sell_sm"),
    )


def _flow_sql(name: str, condition: str) -> str:
    cents_sql = "CAST(round(l_extendedprice * 100) AS BIGINT)"
    return (
        f"CAST(coalesce(sum({cents_sql}) FILTER (WHERE {condition}), 0) AS DOUBLE) / 100 AS {name}"
    )


FLOWS = (
    "flows AS (SELECT l_suppkey AS entity, CAST(l_shipdate AS DATE) AS session, "
    + ", ".join(
        _flow_sql(n, c)
        for n, c in {
            "buy_lg": "l_returnflag = 'N' AND l_quantity >= 30",
            "buy_elg": "l_returnflag = 'A' AND l_quantity >= 30",
            "sell_lg": "l_returnflag = 'R' AND l_quantity >= 30",
            "buy_sm": "l_returnflag = 'N' AND l_quantity < 30",
            "sell_sm": "l_returnflag = 'R' AND l_quantity < 30",
        }.items()
    )
    + " FROM lineitem GROUP BY 1, 2)"
)


def changes(t):
    """User-days with the change of the last value against the day before."""
    return shifted(user_day(t), "diff", "change", "errors", ["entity"], "session", **BOUND)


CHANGES = """changes AS (SELECT *, errors - lag(errors) OVER (PARTITION BY entity ORDER BY session)
  AS change FROM user_day)"""

_RETURNS = """returns AS (SELECT entity, min(session) AS start_date, max(session) AS end_date,
  arg_min(close, session) AS start_close, arg_max(close, session) AS end_close,
  round((arg_max(close, session) / arg_min(close, session) - 1) * 100, 4) AS period_return_pct
  FROM {0} GROUP BY 1 HAVING min(session) < max(session) AND arg_min(close, session) > 0)"""

register(
    "an_field_analysis",
    "o_orderpriority:s orders:i mean_total:f",
    lambda t: A.field_analysis(
        t.orders,
        [("o_totalprice", "ge", 100_000), ("o_orderstatus", "ne", "P")],
        ["o_orderpriority"],
        [Agg("orders", "o_orderkey", "count"), Agg("mean_total", "o_totalprice", "mean")],
        "mean_total",
        count=3,
    ),
    """SELECT o_orderpriority, count(o_orderkey) AS orders, avg(o_totalprice) AS mean_total
       FROM orders WHERE o_totalprice >= 100000 AND o_orderstatus <> 'P'
       GROUP BY 1 ORDER BY mean_total DESC, 1 LIMIT 3""",
)
register(
    "an_rank_metric",
    "entity:i session:d amount:f",
    lambda t: A.rank_metric(
        user_day(t).where(F.col("session") == F.lit("2024-01-15").cast("date")),
        "amount",
        "entity",
        universe=names(t).where(F.col("industry") == "BUILDING"),
    ),
    """SELECT entity, session, amount FROM user_day WHERE session = DATE '2024-01-15'
       AND entity IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
       ORDER BY amount DESC, entity LIMIT 10""",
    UD,
)
register(
    "an_rank_period_return",
    "entity:i start_date:d end_date:d start_close:f end_close:f period_return_pct:f",
    lambda t: A.rank_period_return(user_day(t), "entity", "session", "close"),
    "SELECT * FROM returns ORDER BY period_return_pct DESC, entity LIMIT 10",
    (USER_DAY, _RETURNS.format("user_day")),
)

register(
    "an_rank_single_day",
    "entity:i session:d change:f",
    lambda t: A.rank_period_return(
        user_day(t).select("entity", "session", "close", ((F.try_divide("last", "open") - 1) * 100).alias("change")),
        "entity",
        "session",
        "close",
        window=("20240110", "20240110"),
        change="change",
    ),
    """SELECT entity, session, (last / open - 1) * 100 AS change FROM user_day
       WHERE session = DATE '2024-01-10' AND open <> 0 ORDER BY 3 DESC, entity LIMIT 10""",
    (USER_DAY,),
)

_RUNS = """runs AS (SELECT u.entity, u.session, u.close, n,
  EXISTS (SELECT 1 FROM error_days e WHERE e.entity = u.entity AND e.session = u.session) AS hit
  FROM user_day u JOIN (SELECT session, row_number() OVER (ORDER BY session) AS n
    FROM (SELECT DISTINCT session FROM user_day)) USING (session)),
done AS (SELECT * FROM (SELECT *, n - lag(n, 1) OVER (PARTITION BY entity ORDER BY session) AS gap,
  lag(hit, 1) OVER (PARTITION BY entity ORDER BY session) AS before FROM runs)
  WHERE gap = 1 AND hit AND before),
outcome AS (SELECT d.entity, r.close / d.close - 1 AS ret FROM done d
  JOIN runs r ON r.entity = d.entity AND r.n = d.n + 3)"""
_RUN_CTES = (USER_DAY, ERROR_DAYS, _RUNS)
register(
    "an_event_outcome",
    "event_count:i positive_event_ratio:f negative_event_ratio:f",
    lambda t: A.event_outcome(
        user_day(t), error_days(t), "entity", "session", "close", length=2, offset=3, **BOUND
    ),
    """SELECT count(ret) AS event_count, avg(CAST(ret > 0 AS INT)) AS positive_event_ratio,
       avg(CAST(ret < 0 AS INT)) AS negative_event_ratio FROM outcome""",
    _RUN_CTES,
)
register(
    "an_streak_list",
    "entity:i session:d streak_count:i",
    lambda t: A.streak_list(user_day(t), error_days(t), "entity", "session", 2, **BOUND),
    "SELECT entity, session, 2 AS streak_count FROM done",
    _RUN_CTES,
)
register(
    "an_streak_outcome",
    "event_count:i positive_event_count:i positive_event_ratio:f negative_event_count:i "
    "negative_event_ratio:f average_return_pct:f minimum_return_pct:f maximum_return_pct:f",
    lambda t: A.streak_outcome(
        user_day(t), error_days(t), "entity", "session", "close", length=2, offset=3, **BOUND
    ),
    """SELECT count(ret) AS event_count, count(*) FILTER (WHERE ret > 0) AS positive_event_count,
       avg(CAST(ret > 0 AS INT)) AS positive_event_ratio,
       count(*) FILTER (WHERE ret < 0) AS negative_event_count,
       avg(CAST(ret < 0 AS INT)) AS negative_event_ratio, avg(ret * 100) AS average_return_pct,
       min(ret * 100) AS minimum_return_pct, max(ret * 100) AS maximum_return_pct FROM outcome""",
    _RUN_CTES,
)
register(
    "an_breadth",
    "up_count:i down_count:i flat_count:i",
    lambda t: A.breadth(changes(t), "change"),
    """SELECT count(*) FILTER (WHERE change > 0) AS up_count,
       count(*) FILTER (WHERE change < 0) AS down_count,
       count(*) FILTER (WHERE change = 0) AS flat_count FROM changes""",
    (USER_DAY, CHANGES),
)
register(
    "an_unchanged",
    "unchanged_count:i",
    lambda t: A.unchanged_count(changes(t), "change", "entity"),
    "SELECT count(*) AS unchanged_count FROM changes WHERE change = 0",
    (USER_DAY, CHANGES),
)


def blocks(t):
    """Lines of 45 units or more as block trades."""
    return t.lineitem.where(F.col("l_quantity") >= 45).select(
        F.col("l_suppkey").alias("entity"),
        "l_orderkey",
        "l_linenumber",
        F.col("l_shipdate").cast("date").alias("session"),
        F.col("l_extendedprice").alias("amount"),
    )


register(
    "an_block_trade",
    "entity:i total_amount:f",
    lambda t: A.total_ranking(blocks(t), "entity", "amount", "total_amount"),
    """SELECT l_suppkey AS entity, sum(l_extendedprice) AS total_amount FROM lineitem
       WHERE l_quantity >= 45 GROUP BY 1 ORDER BY total_amount DESC, 1 LIMIT 10""",
)
register(
    "an_block_trade_detail",
    "entity:i session:d amount:f l_orderkey:i l_linenumber:i",
    lambda t: A.detail_rows(
        blocks(t),
        [("amount", "ge", 90_000)],
        ["entity", "session", "amount", "l_orderkey", "l_linenumber"],
        ["session", "entity", "l_orderkey", "l_linenumber"],
    ),
    """SELECT l_suppkey AS entity, CAST(l_shipdate AS DATE) AS session, l_extendedprice AS amount,
       l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 45 AND l_extendedprice >= 90000""",
)
register(
    "an_large_orders",
    "entity:i session:d large_buy_amount:f",
    lambda t: A.large_orders(flows(t), "buy_lg", "buy_elg", ["entity", "session"]),
    """SELECT entity, session, buy_lg + buy_elg AS large_buy_amount FROM flows
       ORDER BY 3 DESC, 1, 2 LIMIT 10""",
    (FLOWS,),
)
register(
    "an_moneyflow_compare",
    "entity:i large_order_net_amount:f small_order_net_amount:f trading_day_count:i",
    lambda t: A.money_flow_compare(flows(t), "entity", "session"),
    """SELECT entity, sum(buy_lg - sell_lg) AS large_order_net_amount,
       sum(buy_sm - sell_sm) AS small_order_net_amount, count(session) AS trading_day_count
       FROM flows GROUP BY 1""",
    (FLOWS,),
)
_FLOW_OUT = "entity:i session:d buy_lg:f sell_lg:f buy_sm:f sell_sm:f"
register(
    "an_moneyflow_snapshot",
    _FLOW_OUT,
    lambda t: A.detail_rows(
        flows(t), [("session", "eq", "1997-03-03")],
        ["entity", "session", "buy_lg", "sell_lg", "buy_sm", "sell_sm"], ["entity"],
    ),
    "SELECT * FROM flows WHERE session = DATE '1997-03-03' ORDER BY entity",
    (FLOWS,),
)
register(
    "an_moneyflow_components",
    _FLOW_OUT + " net_lg_amount:f net_sm_amount:f",
    lambda t: A.money_flow_nets(flows(t)),
    "SELECT *, buy_lg - sell_lg AS net_lg_amount, buy_sm - sell_sm AS net_sm_amount FROM flows",
    (FLOWS,),
)
register(
    "an_value_screen",
    "entity:i pe:f pb:f dv:f",
    lambda t: A.value_screen(valuations(t), "pe", "pb", "dv", entity="entity"),
    """SELECT entity, pe, pb, dv FROM (SELECT * FROM valuations WHERE pe > 0 AND pb > 0 AND
         pe <= (SELECT quantile_cont(pe, 0.3) FROM valuations WHERE pe > 0 AND pb > 0)) v
       WHERE pb <= (SELECT quantile_cont(pb, 0.3) FROM valuations WHERE pe > 0 AND pb > 0 AND
         pe <= (SELECT quantile_cont(pe, 0.3) FROM valuations WHERE pe > 0 AND pb > 0))
       ORDER BY dv DESC, entity LIMIT 10""",
    (VALUATIONS,),
)
register(
    "an_threshold_screen",
    "entity:i name:s pe:f pb:f",
    lambda t: A.composite_screen(
        valuations(t), [("pe", "lt", 950), ("pb", "lt", 10)], "pe", "entity", master=part_names(t)
    ),
    """SELECT entity, p_name AS name, pe, pb FROM valuations JOIN part ON entity = p_partkey
       WHERE pe < 950 AND pb < 10""",
    (VALUATIONS,),
)
register(
    "an_composite_screen",
    "entity:i name:s pe:f pb:f dv:f mv:f",
    lambda t: A.composite_screen(
        valuations(t),
        [("pe", "lt", 1000), ("pb", "ge", 5), ("dv", "gt", 4.5), ("mv", "gt", 100_000)],
        "dv",
        "entity",
        master=part_names(t),
        direction="desc",
        count=15,
    ),
    """SELECT entity, p_name AS name, pe, pb, dv, mv FROM valuations JOIN part ON entity = p_partkey
       WHERE pe < 1000 AND pb >= 5 AND dv > 4.5 AND mv > 100000
       ORDER BY dv DESC, entity LIMIT 15""",
    (VALUATIONS,),
)
register(
    "an_cap_pb",
    "entity:i mv:f pb:f",
    lambda t: A.composite_screen(
        valuations(t).dropna(subset=["pb"]), [("mv", "ge", 1_000_000)], "pb", "entity", count=10
    ),
    """SELECT entity, mv, pb FROM valuations WHERE mv >= 1000000 ORDER BY pb, entity LIMIT 10""",
    (VALUATIONS,),
)
register(
    "an_yield_rank",
    "entity:i dv:f",
    lambda t: A.rank_metric(valuations(t), "dv", "entity", filters=[("dv", "gt", 0)]),
    "SELECT entity, dv FROM valuations WHERE dv > 0 ORDER BY dv DESC, entity LIMIT 10",
    (VALUATIONS,),
)
register(
    "an_dividend_rank",
    "entity:i name:s amount:f ann_date:d",
    lambda t: A.dividend_ranking(
        disclosures(t), names(t), "entity", "amount", "ann_date", tie_break=["id"]
    ),
    """SELECT entity, name, amount, ann_date FROM (SELECT d.*, c_name AS name, row_number() OVER (
         PARTITION BY d.entity ORDER BY amount DESC, id) AS rn
         FROM disclosures d JOIN customer ON entity = c_custkey WHERE amount > 0)
       WHERE rn = 1 ORDER BY amount DESC, entity LIMIT 10""",
    (DISCLOSURES,),
)
register(
    "an_dividend_entity",
    "entity:i ann_date:d amount:f id:i",
    lambda t: A.detail_rows(
        disclosures(t),
        [("ann_date", "ge", "1997-01-01"), ("ann_date", "le", "1997-12-31")],
        ["entity", "ann_date", "amount", "id"],
        ["entity", "ann_date", "id"],
    ),
    """SELECT entity, ann_date, amount, id FROM disclosures
       WHERE ann_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'""",
    (DISCLOSURES,),
)
register(
    "an_industry_value",
    "entity:i name:s pe:f amount:f",
    lambda t: A.industry_value(
        names(t).where(F.col("industry") == "MACHINERY"),
        security_master(t).select("entity", F.col("balance").alias("pe")),
        disclosures(t),
        "entity",
        day="ann_date",
        cash="amount",
        pe="pe",
        count=20,
        tie_break=["id"],
    ),
    """SELECT entity, c_name AS name, c_acctbal AS pe, amount FROM (SELECT * FROM disclosures
         QUALIFY row_number() OVER (PARTITION BY entity ORDER BY ann_date DESC, id) = 1)
       JOIN customer ON entity = c_custkey WHERE c_mktsegment = 'MACHINERY'
       ORDER BY pe, entity LIMIT 20""",
    (DISCLOSURES,),
)
_BALANCE = "(SELECT s_suppkey AS entity, s_acctbal AS balance FROM supplier)"
_SM = (SUPPLIER_MONTH, _RETURNS.format("supplier_month"))


def balances(t):
    return t.supplier.select(
        F.col("s_suppkey").alias("entity"), F.col("s_acctbal").alias("balance")
    )


register(
    "an_cohort_return",
    "entity:i balance:f period_return_pct:f",
    lambda t: A.cohort_return(
        balances(t), supplier_month(t), "entity", "session", "close", "balance"
    ),
    f"""SELECT c.entity, balance, period_return_pct FROM
        (SELECT * FROM {_BALANCE} ORDER BY balance, entity LIMIT 20) c
        LEFT JOIN returns USING (entity)""",
    _SM,
)
register(
    "an_cohort_return_reversed",
    "entity:i balance:f period_return_pct:f",
    lambda t: A.cohort_return(
        balances(t), supplier_month(t), "entity", "session", "close", "balance",
        by_return=True, direction="desc",
    ),
    f"""SELECT r.entity, balance, period_return_pct FROM
        (SELECT * FROM returns ORDER BY period_return_pct DESC, entity LIMIT 20) r
        LEFT JOIN {_BALANCE} USING (entity)""",
    _SM,
)
register(
    "an_volume_turnover",
    "entity:i session:d vol:f turnover_rate:f",
    lambda t: A.volume_turnover(
        nation_week(t).select("entity", "session", "vol"),
        nation_week(t).select("entity", "session", "turnover_rate"),
        ["entity", "session"],
    ),
    """SELECT entity, session, vol, turnover_rate FROM nation_week
       ORDER BY vol DESC, entity, session LIMIT 20""",
    (NATION_WEEK,),
)
register(
    "an_margin_leader",
    "s_suppkey:i s_acctbal:f",
    lambda t: A.top_rows(t.supplier, "s_acctbal", 1, tie_break=["s_suppkey"]),
    "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 1",
)


def holder_numbers(t):
    """Orders per customer and quarter as the disclosed number of holders."""
    return aggregate(
        disclosures(t),
        ["entity", "end_date"],
        [Agg("holder_num", "id", "count"), Agg("announced", "ann_date", "last")],
        order_by=["ann_date"],
    )


register(
    "an_holder_concentration",
    "entity:i name:s end_date:d holder_change_pct:f",
    lambda t: A.holder_concentration(
        holder_numbers(t), names(t), "entity", "end_date", "announced", "holder_num", **BOUND
    ),
    """SELECT entity, c_name AS name, end_date, pct AS holder_change_pct FROM (
         SELECT *, (n / lag(n) OVER (PARTITION BY entity ORDER BY end_date) - 1) * 100 AS pct FROM (
           SELECT entity, end_date, count(id) AS n, max(ann_date) AS announced
           FROM disclosures GROUP BY 1, 2)
         QUALIFY row_number() OVER (PARTITION BY entity ORDER BY announced DESC, end_date DESC) = 1)
       JOIN customer ON entity = c_custkey WHERE pct IS NOT NULL ORDER BY pct, entity LIMIT 10""",
    (DISCLOSURES,),
)
register(
    "an_holder_trades",
    "purchases:i reductions:i",
    lambda t: A.direction_counts(t.lineitem, "l_returnflag", {"purchases": "N", "reductions": "R"}),
    """SELECT count(*) FILTER (WHERE l_returnflag = 'N') AS purchases,
       count(*) FILTER (WHERE l_returnflag = 'R') AS reductions FROM lineitem""",
)
register(
    "an_event_count_return",
    "entity:i event_count:i start_date:d end_date:d period_return_pct:f",
    lambda t: A.event_count_return(error_days(t), user_day(t), "entity", "session", "close"),
    """SELECT e.entity, event_count, start_date, end_date, period_return_pct FROM (
         SELECT entity, count(session) AS event_count FROM error_days GROUP BY 1
         ORDER BY 2 DESC, 1 LIMIT 10) e LEFT JOIN returns USING (entity)""",
    (USER_DAY, ERROR_DAYS, _RETURNS.format("user_day")),
)


def _statement(t, status, name):
    rows = disclosures(t).where(F.col("status") == status)
    rows = rows.withColumnRenamed("amount", name)
    return [rows.where(F.year("end_date") == y) for y in (1996, 1997)]


_LATEST_SQL = """SELECT * FROM disclosures WHERE status = '{0}' AND year(end_date) IN (1996, 1997)
  QUALIFY row_number() OVER (PARTITION BY entity, end_date ORDER BY ann_date DESC, id DESC) = 1"""
register(
    "an_statement_compare",
    "entity:i end_date:d roe:f cash:f",
    lambda t: A.statement_compare(
        _statement(t, "F", "roe"), _statement(t, "O", "cash"), ["entity", "end_date"], "ann_date",
        {"cash": "cash"}, tie_break=["id"],
    ),
    f"""SELECT entity, end_date, a.amount AS roe, b.amount AS cash
        FROM ({_LATEST_SQL.format('F')}) a JOIN ({_LATEST_SQL.format('O')}) b
        USING (entity, end_date)""",
    (DISCLOSURES,),
)
register(
    "an_latest_guidance",
    "entity:i id:i ann_date:d amount:f",
    lambda t: A.top_rows(disclosures(t).dropna(subset=["amount"]), "ann_date", 1, tie_break=["id"]),
    "SELECT entity, id, ann_date, amount FROM disclosures ORDER BY ann_date DESC, id LIMIT 1",
    (DISCLOSURES,),
)
register(
    "an_suspension",
    "entity:i suspension_day_count:i",
    lambda t: A.top_rows(
        aggregate(error_days(t), ["entity"], [Agg("suspension_day_count", "session", "count")]),
        "suspension_day_count",
        1,
        tie_break=["entity"],
    ),
    """SELECT entity, count(session) AS suspension_day_count FROM error_days
       GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""",
    (ERROR_DAYS,),
)
register(
    "an_repurchase_list",
    "entity:i ann_date:d type:s amount:f id:i",
    lambda t: A.detail_rows(
        disclosures(t),
        [("type", "contains", "URGENT")],
        ["entity", "ann_date", "type", "amount", "id"],
        ["ann_date", "id"],
    ),
    """SELECT entity, ann_date, type, amount, id FROM disclosures
       WHERE contains(type, 'URGENT')""",
    (DISCLOSURES,),
)
register(
    "an_repurchase_companies",
    "entity:i name:s ann_date:d",
    lambda t: A.company_list(
        disclosures(t).where(F.col("status") == "F"), names(t), "entity", "ann_date",
        tie_break=["id"],
    ),
    """SELECT entity, c_name AS name, max(ann_date) AS ann_date FROM disclosures
       JOIN customer ON entity = c_custkey WHERE status = 'F' GROUP BY 1, 2""",
    (DISCLOSURES,),
)
register(
    "an_repurchase_rank",
    "entity:i announced_upper_amount:f",
    lambda t: A.total_ranking(
        disclosures(t), "entity", "amount", "announced_upper_amount", function="max"
    ),
    """SELECT entity, max(amount) AS announced_upper_amount FROM disclosures
       GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    (DISCLOSURES,),
)
register(
    "an_extrema",
    "highest:f lowest:f",
    lambda t: A.extrema(nation_week(t), "close"),
    "SELECT max(close) AS highest, min(close) AS lowest FROM nation_week",
    (NATION_WEEK,),
)
register(
    "an_unlock_count",
    "entity_count:i",
    lambda t: A.distinct_in_range(disclosures(t), "entity", "ann_date", "19970101", "19970331"),
    """SELECT count(DISTINCT entity) AS entity_count FROM disclosures
       WHERE ann_date BETWEEN DATE '1997-01-01' AND DATE '1997-03-31'""",
    (DISCLOSURES,),
)


def segments(t):
    return (
        t.lineitem.groupBy("l_partkey")
        .agg(F.sum(cents("l_extendedprice")).alias("c"))
        .join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("p_type")
        .agg((F.sum("c") / 100).alias("sales"))
    )


register(
    "an_top_segment",
    "p_type:s sales:f",
    lambda t: A.top_rows(segments(t), "sales", 1, tie_break=["p_type"]),
    """SELECT p_type, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS sales
       FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""",
)
register(
    "an_event_list",
    "event_id:i user_id:i event_type:s value:f",
    lambda t: A.detail_rows(
        t.events,
        [("event_type", "in", ["error", "signup"]), ("value", "ge", 100)],
        ["event_id", "user_id", "event_type", "value"],
        ["event_id"],
    ),
    """SELECT event_id, user_id, event_type, value FROM events
       WHERE event_type IN ('error', 'signup') AND value >= 100""",
)
register(
    "an_event_type_counts",
    "session:d event_type:s events:i",
    lambda t: aggregate(
        t.events.withColumn("session", F.col("ts").cast("date")),
        ["session", "event_type"],
        [Agg("events", "event_id", "count")],
    ),
    """SELECT CAST(ts AS DATE) AS session, event_type, count(event_id) AS events
       FROM events GROUP BY 1, 2""",
)
register(
    "an_event_trend",
    "session:d event_count:i",
    lambda t: A.event_trend(error_days(t), "session", "entity"),
    "SELECT session, count(*) AS event_count FROM error_days GROUP BY 1",
    (ERROR_DAYS,),
)
register(
    "an_event_best_day",
    "session:d event_count:i",
    lambda t: A.top_rows(
        A.event_trend(error_days(t), "session", "entity"), "event_count", 1, tie_break=["session"]
    ),
    """SELECT session, count(*) AS event_count FROM error_days GROUP BY 1
       ORDER BY 2 DESC, 1 LIMIT 1""",
    (ERROR_DAYS,),
)
register(
    "an_disclosure_list",
    "id:i entity:i ann_date:d amount:f",
    lambda t: A.disclosure_list(
        disclosures(t), "ann_date", "19970101", "19971231",
        ["id", "entity", "ann_date", "amount"], count=100, tie_break=["id"],
    ),
    """SELECT id, entity, ann_date, amount FROM disclosures
       WHERE ann_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'
       ORDER BY ann_date DESC, id LIMIT 100""",
    (DISCLOSURES,),
)
