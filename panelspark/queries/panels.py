"""Entity-by-session panels built from the tables, in Spark and in SQL.

Rows are unique per (entity, session), so a group by entity holds at most one row per
session. ``SESSION_BOUND`` states that for the layouts: sessions are DATE values, and
two thousand years of days stay below one task's budget.

Money columns have two decimals, so they are summed as whole cents: the sums are exact
and do not depend on the order in which tasks finish.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.queries.base import Tables

SESSION_BOUND = 2000 * 366


def cents(column: str | Column) -> Column:
    """A two-decimal amount as a whole number of cents."""
    value = F.col(column) if isinstance(column, str) else column
    return F.round(value * 100).cast("long")


def user_day(t: Tables) -> DataFrame:
    """One row per user and day of ``events``."""
    stamp = F.struct("ts", "event_id")
    kind, value = F.col("event_type"), cents("value")
    bought = kind == "purchase"
    return t.events.groupBy(
        F.col("user_id").alias("entity"), F.col("ts").cast("date").alias("session")
    ).agg(
        (F.sum(value) / F.count(F.lit(1)) / 100).alias("close"),
        F.count(F.lit(1)).alias("vol"),
        (F.sum(value) / 100).alias("amount"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.min_by("value", stamp).alias("open"),
        F.max_by("value", stamp).alias("last"),
        F.try_divide(F.sum(F.when(bought, value)), F.count_if(bought) * 100).alias("buy"),
        F.count_if(kind == "error").alias("errors"),
    )


USER_DAY = """user_day AS (
  SELECT user_id AS entity, CAST(ts AS DATE) AS session,
    CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS close,
    count(*) AS vol, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100 AS amount,
    max(value) AS high, min(value) AS low,
    arg_min(value, {'a': ts, 'b': event_id}) AS open,
    arg_max(value, {'a': ts, 'b': event_id}) AS last,
    CAST(sum(CAST(round(value * 100) AS BIGINT)) FILTER (WHERE event_type = 'purchase') AS DOUBLE)
      / (count(*) FILTER (WHERE event_type = 'purchase') * 100) AS buy,
    count(*) FILTER (WHERE event_type = 'error') AS errors
  FROM events GROUP BY 1, 2)"""


def nation_week(t: Tables) -> DataFrame:
    """One row per supplier nation and ship week of ``lineitem``."""
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    lines = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return lines.groupBy(
        F.col("s_nationkey").alias("entity"),
        F.date_trunc("week", "l_shipdate").cast("date").alias("session"),
    ).agg(
        (F.sum(cents("l_extendedprice")) / F.sum("l_quantity") / 100).alias("close"),
        F.sum("l_quantity").alias("vol"),
        (F.sum(cents("l_extendedprice")) / 100).alias("amount"),
        (1 + F.sum(cents("l_tax")) / F.count(F.lit(1)) / 100).alias("adj_factor"),
        F.max(unit).alias("high"),
        F.min(unit).alias("low"),
        F.round(F.avg(unit), 6).alias("open"),
        (F.sum(cents("l_discount")) / F.count(F.lit(1))).alias("turnover_rate"),
    )


NATION_WEEK = """nation_week AS (
  SELECT s_nationkey AS entity, CAST(date_trunc('week', l_shipdate) AS DATE) AS session,
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / sum(l_quantity) / 100 AS close,
    sum(l_quantity) AS vol,
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS amount,
    1 + CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS adj_factor,
    max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
    round(avg(l_extendedprice / l_quantity), 6) AS open,
    CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*) AS turnover_rate
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""


def supplier_month(t: Tables) -> DataFrame:
    """One row per supplier and ship month of ``lineitem``."""
    return t.lineitem.groupBy(
        F.col("l_suppkey").alias("entity"),
        F.date_trunc("month", "l_shipdate").cast("date").alias("session"),
    ).agg(
        (F.sum(cents("l_extendedprice")) / F.sum("l_quantity") / 100).alias("close"),
        F.sum("l_quantity").alias("vol"),
        (F.sum(cents("l_extendedprice")) / 100).alias("amount"),
    )


SUPPLIER_MONTH = """supplier_month AS (
  SELECT l_suppkey AS entity, CAST(date_trunc('month', l_shipdate) AS DATE) AS session,
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / sum(l_quantity) / 100 AS close,
    sum(l_quantity) AS vol,
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS amount
  FROM lineitem GROUP BY 1, 2)"""


def supplier_panel(t: Tables) -> DataFrame:
    """One row per supplier and ship month of ``lineitem``, with prices as ``nation_week`` has.

    Its entities grow with the tables.
    """
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return t.lineitem.groupBy(
        F.col("l_suppkey").alias("entity"),
        F.date_trunc("month", "l_shipdate").cast("date").alias("session"),
    ).agg(
        (F.sum(cents("l_extendedprice")) / F.sum("l_quantity") / 100).alias("close"),
        F.sum("l_quantity").alias("vol"),
        (F.sum(cents("l_extendedprice")) / 100).alias("amount"),
        (1 + F.sum(cents("l_tax")) / F.count(F.lit(1)) / 100).alias("adj_factor"),
        F.max(unit).alias("high"),
        F.min(unit).alias("low"),
        F.round(F.avg(unit), 6).alias("open"),
        (F.sum(cents("l_discount")) / F.count(F.lit(1))).alias("turnover_rate"),
    )


SUPPLIER_PANEL = """supplier_panel AS (
  SELECT l_suppkey AS entity, CAST(date_trunc('month', l_shipdate) AS DATE) AS session,
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / sum(l_quantity) / 100 AS close,
    sum(l_quantity) AS vol,
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS amount,
    1 + CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS adj_factor,
    max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
    round(avg(l_extendedprice / l_quantity), 6) AS open,
    CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*) AS turnover_rate
  FROM lineitem GROUP BY 1, 2)"""


def security_master(t: Tables) -> DataFrame:
    """Customers as listed securities: code, name, industry, exchange, status."""
    exchange = (
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", "SH")
        .when(F.col("c_mktsegment") == "BUILDING", "SZ")
        .when(F.col("c_mktsegment") == "MACHINERY", "BJ")
        .otherwise("HK")
    )
    status = F.when(F.col("c_acctbal") < 0, "D").when(F.col("c_acctbal") < 1000, "P").otherwise("L")
    number = F.col("c_custkey").cast("string")
    return t.customer.select(
        F.concat_ws(".", F.lpad(number, 6, "0"), exchange).alias("code"),
        F.col("c_custkey").alias("entity"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("industry"),
        exchange.alias("exchange"),
        status.alias("list_status"),
        F.col("c_nationkey").alias("area"),
        F.col("c_acctbal").alias("balance"),
    )


MASTER = """master AS (
  SELECT lpad(CAST(c_custkey AS VARCHAR), 6, '0') || '.' ||
      CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'SH' WHEN 'BUILDING' THEN 'SZ'
        WHEN 'MACHINERY' THEN 'BJ' ELSE 'HK' END AS code,
    c_custkey AS entity, c_name AS name, c_mktsegment AS industry,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'SH' WHEN 'BUILDING' THEN 'SZ'
      WHEN 'MACHINERY' THEN 'BJ' ELSE 'HK' END AS exchange,
    CASE WHEN c_acctbal < 0 THEN 'D' WHEN c_acctbal < 1000 THEN 'P' ELSE 'L' END AS list_status,
    c_nationkey AS area, c_acctbal AS balance
  FROM customer)"""


def disclosures(t: Tables) -> DataFrame:
    """Orders as disclosures: announcement day, quarter end reported on, amount."""
    day = F.col("o_orderdate").cast("date")
    return t.orders.select(
        F.col("o_custkey").alias("entity"),
        F.col("o_orderkey").alias("id"),
        day.alias("ann_date"),
        F.last_day(F.add_months(F.date_trunc("quarter", day).cast("date"), 2)).alias("end_date"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("type"),
    )


DISCLOSURES = """disclosures AS (
  SELECT o_custkey AS entity, o_orderkey AS id, CAST(o_orderdate AS DATE) AS ann_date,
    last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) AS end_date,
    o_totalprice AS amount, o_orderstatus AS status, o_orderpriority AS type
  FROM orders)"""


def error_days(t: Tables) -> DataFrame:
    """Membership of the "error" event: (entity, session), with duplicates."""
    return t.events.where(F.col("event_type") == "error").select(
        F.col("user_id").alias("entity"), F.col("ts").cast("date").alias("session")
    )


ERROR_DAYS = """error_days AS (
  SELECT user_id AS entity, CAST(ts AS DATE) AS session FROM events
  WHERE event_type = 'error')"""


def holders(t: Tables) -> DataFrame:
    """The ten biggest parts of each supplier-year as its ten biggest holders.

    ``hold_ratio`` is the part's percentage of the supplier-year's quantity. A supplier-year
    with fewer parts is a list that is too short.
    """
    yearly = t.lineitem.groupBy(
        F.col("l_suppkey").alias("entity"),
        F.year("l_shipdate").alias("year"),
        F.col("l_partkey").alias("holder"),
    ).agg(F.sum("l_quantity").alias("hold_amount"))
    # The totals of a supplier-year are an aggregate joined back, so no supplier is
    # held whole in one task; the top ten are cut per task before the shuffle.
    totals = yearly.groupBy(F.col("entity").alias("te"), F.col("year").alias("ty")).agg(
        F.sum("hold_amount").alias("total")
    )
    w = Window.partitionBy("entity", "year").orderBy(F.col("hold_amount").desc(), "holder")
    top = (
        yearly.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= 10).drop("rn")
    )
    return (
        top.join(totals, (F.col("entity") == F.col("te")) & (F.col("year") == F.col("ty")))
        .join(t.part, F.col("holder") == F.col("p_partkey"))
        .select(
            "entity",
            F.make_date("year", F.lit(12), F.lit(31)).alias("end_date"),
            F.make_date(F.col("year") + 1, F.lit(3), F.lit(31)).alias("ann_date"),
            F.concat_ws(" ", F.col("p_name"), F.col("holder").cast("string")).alias("holder_name"),
            F.col("hold_amount"),
            # Parts of one brand report no ratio, which leaves a natural gap.
            F.when(
                F.col("p_brand") != "Brand#1",
                F.col("hold_amount") / F.col("total") * 100,
            ).alias("hold_ratio"),
            F.col("total").alias("free_share"),
        )
    )


HOLDERS = """yearly AS (
  SELECT l_suppkey AS entity, year(l_shipdate) AS year, l_partkey AS holder,
    sum(l_quantity) AS hold_amount FROM lineitem GROUP BY 1, 2, 3),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY entity, year ORDER BY hold_amount DESC, holder) AS rn,
    sum(hold_amount) OVER (PARTITION BY entity, year) AS total FROM yearly),
holders AS (
  SELECT entity, make_date(year, 12, 31) AS end_date, make_date(year + 1, 3, 31) AS ann_date,
    p_name || ' ' || CAST(holder AS VARCHAR) AS holder_name, hold_amount,
    CASE WHEN p_brand <> 'Brand#1' THEN hold_amount / total * 100 END AS hold_ratio,
    total AS free_share
  FROM ranked JOIN part ON holder = p_partkey WHERE rn <= 10)"""
