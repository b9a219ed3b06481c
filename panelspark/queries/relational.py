"""Projections, filters, joins, aggregates, ranks and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import columns as C
from panelspark.operators import filters as P
from panelspark.operators import joins as J
from panelspark.operators import ranking as R
from panelspark.operators import sets as S
from panelspark.operators.aggregates import (
    Agg,
    aggregate,
    distinct_by,
    latest_by_group,
    resample,
    summarize,
    weighted_mean,
)
from panelspark.queries.base import register
from panelspark.queries.panels import (
    DISCLOSURES,
    ERROR_DAYS,
    MASTER,
    SESSION_BOUND,
    USER_DAY,
    disclosures,
    error_days,
    security_master,
    user_day,
)

KEY = "entity:i session:d "
UD = (USER_DAY,)

# --- projections -----------------------------------------------------------------

register(
    "select_fields",
    "o_orderkey:i o_totalprice:f",
    lambda t: C.select_fields(t.orders, ["o_orderkey", "o_totalprice"]),
    "SELECT o_orderkey, o_totalprice FROM orders",
)
register(
    "rename_fields",
    "order_id:i total:f o_orderstatus:s",
    lambda t: C.rename_fields(
        t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus"),
        {"o_orderkey": "order_id", "o_totalprice": "total"},
    ),
    "SELECT o_orderkey AS order_id, o_totalprice AS total, o_orderstatus FROM orders",
)

_DERIVED = {
    "add": ("buy", "close", None, "buy + close"),
    "subtract": ("buy", "close", None, "buy - close"),
    "multiply": ("buy", None, 3.0, "buy * 3"),
    "divide": ("buy", "vol", None, "buy / vol"),
    "constant_minus": ("buy", None, 100.0, "100 - buy"),
}
for _name, (_field, _right, _value, _sql) in _DERIVED.items():
    register(
        f"derive_{_name}",
        KEY + "y:f",
        lambda t, n=_name, f=_field, r=_right, v=_value: C.derive(
            user_day(t), "y", f, n, right_field=r, value=v
        ),
        f"SELECT entity, session, {_sql} AS y FROM user_day",
        UD,
    )
register(
    "compare_fields",
    KEY + "ge:b ne:b",
    lambda t: C.compare_fields(
        C.compare_fields(user_day(t), "ge", "buy", "ge", "close"), "ne", "buy", "ne", "close"
    ),
    """SELECT entity, session, coalesce(buy >= close, FALSE) AS ge,
       coalesce(buy <> close, TRUE) AS ne FROM user_day""",
    UD,
)
register(
    "compare_scalar",
    KEY + "high_buy:b not_ten:b",
    lambda t: C.compare_scalar(
        C.compare_scalar(user_day(t), "high_buy", "buy", "gt", 50), "not_ten", "buy", "ne", 10
    ),
    """SELECT entity, session, coalesce(buy > 50, FALSE) AS high_buy,
       coalesce(buy <> 10, TRUE) AS not_ten FROM user_day""",
    UD,
)
register(
    "coalesce",
    KEY + "y:f",
    lambda t: C.coalesce_fields(user_day(t), "y", ["buy", "close"]),
    "SELECT entity, session, coalesce(buy, close) AS y FROM user_day",
    UD,
)
register(
    "fill_constant",
    KEY + "y:f",
    lambda t: C.fill_constant(user_day(t), "y", "buy", -1.0),
    "SELECT entity, session, coalesce(buy, -1.0) AS y FROM user_day",
    UD,
)
register(
    "clip",
    KEY + "y:f",
    lambda t: C.clip(user_day(t), "y", "buy", lower=20, upper=60),
    """SELECT entity, session, CASE WHEN buy IS NOT NULL THEN
       least(greatest(buy, 20.0), 60.0) END AS y FROM user_day""",
    UD,
)
register(
    "conditional_value",
    KEY + "y:s",
    lambda t: C.conditional_value(user_day(t), "y", "buy", "ge", 40, "strong", "weak"),
    """SELECT entity, session, CASE WHEN buy >= 40 THEN 'strong' ELSE 'weak' END AS y
       FROM user_day""",
    UD,
)
register(
    "numeric_coerce",
    "o_orderkey:i y:f",
    lambda t: C.coerce_number(
        t.orders.select(
            "o_orderkey",
            F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority"))
            .when(F.col("o_orderstatus") == "F", F.lit("NaN"))
            .otherwise(F.col("o_totalprice").cast("string"))
            .alias("raw"),
        ),
        "y",
        "raw",
    ),
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN o_totalprice END AS y
       FROM orders""",
)
register(
    "format_tag",
    "entity:i return_pct:f",
    lambda t: C.tag_format(
        t.orders.select(F.col("o_custkey").alias("entity"), F.col("o_totalprice").alias("return_pct")),
        "return_pct",
    ),
    "SELECT o_custkey AS entity, o_totalprice AS return_pct FROM orders",
)

# --- filters ---------------------------------------------------------------------

register(
    "filter_eq",
    KEY + "vol:i",
    lambda t: P.filter_rows(user_day(t), "vol", "eq", 2),
    "SELECT entity, session, vol FROM user_day WHERE vol = 2",
    UD,
)
_COMPARE = {"gt": ">", "ge": ">=", "le": "<=", "lt": "<"}
for _name, _op in _COMPARE.items():
    register(
        f"filter_{_name}",
        KEY + "buy:f",
        lambda t, n=_name: P.filter_rows(user_day(t), "buy", n, 45.5),
        f"SELECT entity, session, buy FROM user_day WHERE buy {_op} 45.5",
        UD,
    )
register(
    "filter_ne",
    KEY + "buy:f",
    lambda t: P.filter_rows(user_day(t), "buy", "ne", 45.5),
    "SELECT entity, session, buy FROM user_day WHERE buy <> 45.5 OR buy IS NULL",
    UD,
)
register(
    "filter_contains",
    "p_partkey:i p_name:s",
    lambda t: P.filter_rows(t.part, "p_name", "contains", "ring"),
    "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ring')",
)
register(
    "filter_not_contains",
    "p_partkey:i p_name:s",
    lambda t: P.filter_rows(t.part, "p_name", "not_contains", "ring"),
    "SELECT p_partkey, p_name FROM part WHERE NOT contains(p_name, 'ring') OR p_name IS NULL",
)
_VOLS = [1, 2, 5]
register(
    "filter_set",
    KEY + "vol:i",
    lambda t: P.filter_set(user_day(t), "vol", _VOLS),
    "SELECT entity, session, vol FROM user_day WHERE vol IN (1, 2, 5)",
    UD,
)
register(
    "filter_set_mixed",
    "p_partkey:i p_size:i",
    lambda t: P.filter_set(t.part, "p_size", [5, "7", "x", 9.0]),
    "SELECT p_partkey, p_size FROM part WHERE p_size IN (5, 9)",
)
for _name in ("eq", "ne"):
    register(
        f"filter_{_name}_text_on_number",
        "p_partkey:i p_size:i",
        lambda t, n=_name: P.filter_rows(t.part, "p_size", n, "5"),
        f"SELECT p_partkey, p_size FROM part WHERE {_name == 'ne'}",
    )
_NUMERALS = ("1d", "0x1p3", " 2.5 ", "-1e3", ".5", "2f", "7.", "+inf", "1_000", "")
register(
    "number_from_text",
    "p_partkey:i y:f",
    lambda t: C.derive(
        t.part.select(
            "p_partkey",
            F.get(F.array(*map(F.lit, _NUMERALS)), (F.col("p_partkey") % len(_NUMERALS)).cast("int")).alias("s"),
        ),
        "y",
        "s",
        "add",
        value=0,
    ),
    """SELECT p_partkey, CASE p_partkey % 10 WHEN 2 THEN 2.5 WHEN 3 THEN -1000 WHEN 4 THEN 0.5
       WHEN 6 THEN 7 WHEN 7 THEN CAST('inf' AS DOUBLE) END AS y FROM part""",
)
register(
    "filter_set_negated",
    KEY + "vol:i",
    lambda t: P.filter_set(user_day(t), "vol", _VOLS, negate=True),
    "SELECT entity, session, vol FROM user_day WHERE vol NOT IN (1, 2, 5) OR vol IS NULL",
    UD,
)
register(
    "filter_range",
    KEY + "buy:f",
    lambda t: P.filter_range(user_day(t), "buy", 20, 60),
    "SELECT entity, session, buy FROM user_day WHERE buy BETWEEN 20 AND 60",
    UD,
)
register(
    "filter_range_negated",
    KEY + "buy:f",
    lambda t: P.filter_range(user_day(t), "buy", 20, 60, negate=True),
    "SELECT entity, session, buy FROM user_day WHERE NOT coalesce(buy BETWEEN 20 AND 60, FALSE)",
    UD,
)
register(
    "filter_null",
    KEY + "vol:i",
    lambda t: P.filter_null(user_day(t), "buy"),
    "SELECT entity, session, vol FROM user_day WHERE buy IS NULL",
    UD,
)
register(
    "filter_not_null",
    KEY + "vol:i",
    lambda t: P.filter_null(user_day(t), "buy", negate=True),
    "SELECT entity, session, vol FROM user_day WHERE buy IS NOT NULL",
    UD,
)
register(
    "drop_missing",
    KEY + "buy:f",
    lambda t: P.drop_missing(user_day(t), ["buy", "close"]),
    "SELECT entity, session, buy FROM user_day WHERE buy IS NOT NULL AND close IS NOT NULL",
    UD,
)
register(
    "having",
    "o_custkey:i orders:i total:f",
    lambda t: P.having(
        aggregate(
            t.orders,
            ["o_custkey"],
            [Agg("orders", "o_orderkey", "count"), Agg("total", "o_totalprice", "sum")],
        ),
        "orders",
        "ge",
        12,
    ),
    """SELECT o_custkey, count(o_orderkey) AS orders, sum(o_totalprice) AS total
       FROM orders GROUP BY 1 HAVING count(o_orderkey) >= 12""",
)
register(
    "quantile_filter",
    "o_orderkey:i o_totalprice:f",
    lambda t: P.quantile_filter(t.orders, "o_totalprice", "ge", 0.9),
    """SELECT o_orderkey, o_totalprice FROM orders
       WHERE o_totalprice >= (SELECT quantile_cont(o_totalprice, 0.9) FROM orders)""",
)
register(
    "read_filter_numeric",
    "l_orderkey:i l_linenumber:i l_quantity:f",
    lambda t: P.read_filters(
        t.lineitem, [("l_quantity", "ge", 30), ("l_discount", "lt", 0.05), ("l_linenumber", "ne", 3)]
    ),
    """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
       WHERE l_quantity >= 30 AND l_discount < 0.05 AND l_linenumber <> 3""",
)
register(
    "read_filter_string",
    "o_orderkey:i o_orderpriority:s o_orderstatus:s",
    lambda t: P.read_filters(
        t.orders,
        [
            ("o_orderpriority", "ge", "2"),
            ("o_orderpriority", "not_contains", "LOW"),
            ("o_orderstatus", "ne", "F"),
        ],
    ),
    """SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders
       WHERE o_orderpriority >= '2' AND NOT contains(o_orderpriority, 'LOW')
         AND o_orderstatus <> 'F'""",
)
register(
    "read_filter_in",
    "c_custkey:i c_mktsegment:s",
    lambda t: P.read_filters(t.customer, [("c_mktsegment", "in", ["BUILDING", "MACHINERY"])]),
    """SELECT c_custkey, c_mktsegment FROM customer
       WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')""",
)
register(
    "read_filter_not_in",
    "c_custkey:i c_nationkey:i",
    lambda t: P.read_filters(t.customer, [("c_nationkey", "not_in", ["1", "2", "3"])]),
    "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey NOT IN (1, 2, 3)",
)
register(
    "conditional_count",
    "up:i down:i named:i",
    lambda t: P.conditional_counts(
        user_day(t).withColumn("label", F.lit("x")),
        {"up": ("buy", "gt", 50), "down": ("buy", "le", 50), "named": ("label", "gt", 0)},
    ),
    """SELECT count(*) FILTER (WHERE buy > 50) AS up, count(*) FILTER (WHERE buy <= 50) AS down,
       count(*) AS named FROM user_day""",
    UD,
)
register(
    "valid_entity_code",
    "code:s valid:b",
    lambda t: security_master(t).select(
        "code", P.valid_entity_code(F.col("code")).alias("valid")
    ),
    """SELECT code, regexp_full_match(code, '[0-9]{6}\\.(SH|SZ|BJ)')
         AND NOT (code LIKE '900%.SH' OR code LIKE '200%.SZ') AS valid FROM master""",
    (MASTER,),
)

# --- joins -----------------------------------------------------------------------

for _name, _op in (("match_source", J.match_source), ("exists_in_source", J.exists_in_source)):
    register(
        _name,
        KEY + "hit:b",
        lambda t, op=_op: op(user_day(t), error_days(t), ["entity", "session"], "hit"),
        """SELECT entity, session, EXISTS (SELECT 1 FROM error_days e
           WHERE e.entity = u.entity AND e.session = u.session) AS hit FROM user_day u""",
        (USER_DAY, ERROR_DAYS),
    )
register(
    "semi_join",
    KEY + "close:f",
    lambda t: J.semi_join(user_day(t), error_days(t), ["entity", "session"]),
    """SELECT entity, session, close FROM user_day u WHERE EXISTS (SELECT 1 FROM error_days e
       WHERE e.entity = u.entity AND e.session = u.session)""",
    (USER_DAY, ERROR_DAYS),
)
register(
    "anti_join",
    KEY + "close:f",
    lambda t: J.anti_join(user_day(t), error_days(t), ["entity", "session"]),
    """SELECT entity, session, close FROM user_day u WHERE NOT EXISTS (SELECT 1 FROM error_days e
       WHERE e.entity = u.entity AND e.session = u.session)""",
    (USER_DAY, ERROR_DAYS),
)


def _error_values(t):
    return t.events.where(F.col("event_type") == "error").groupBy(
        F.col("user_id").alias("entity"), F.col("ts").cast("date").alias("session")
    ).agg(F.round(F.avg("value"), 6).alias("value"))


_ERROR_VALUES = """error_values AS (SELECT user_id AS entity, CAST(ts AS DATE) AS session,
  round(avg(value), 6) AS value FROM events WHERE event_type = 'error' GROUP BY 1, 2)"""
register(
    "inner_join_1_1",
    KEY + "close:f error_value:f",
    lambda t: J.inner_join(
        user_day(t),
        _error_values(t),
        ["entity", "session"],
        {"value": "error_value"},
        cardinality="one_to_one",
    ),
    """SELECT entity, session, close, value AS error_value
       FROM user_day JOIN error_values USING (entity, session)""",
    (USER_DAY, _ERROR_VALUES),
)
register(
    "inner_join_n_1",
    "o_orderkey:i o_custkey:i segment:s",
    lambda t: J.inner_join(
        t.orders,
        t.customer.withColumnRenamed("c_custkey", "o_custkey"),
        ["o_custkey"],
        {"c_mktsegment": "segment"},
        cardinality="many_to_one",
        null_keys=False,
    ),
    """SELECT o_orderkey, o_custkey, c_mktsegment AS segment
       FROM orders JOIN customer ON o_custkey = c_custkey""",
)
register(
    "inner_join_n_n",
    "l_orderkey:i l_linenumber:i priority:s",
    lambda t: J.inner_join(
        t.lineitem,
        t.orders.withColumnRenamed("o_orderkey", "l_orderkey"),
        ["l_orderkey"],
        {"o_orderpriority": "priority"},
        cardinality="many_to_many",
        null_keys=False,
    ),
    """SELECT l_orderkey, l_linenumber, o_orderpriority AS priority
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
register(
    "join_fields",
    KEY + "close:f error_value:f",
    lambda t: J.join_fields(
        user_day(t), _error_values(t), ["entity", "session"], {"value": "error_value"}
    ),
    """SELECT entity, session, close, value AS error_value
       FROM user_day LEFT JOIN error_values USING (entity, session)""",
    (USER_DAY, _ERROR_VALUES),
)
register(
    "cardinality_check",
    "entity:i session:d n:i",
    lambda t: J.duplicate_keys(error_days(t), ["entity", "session"]),
    "SELECT entity, session, count(*) AS n FROM error_days GROUP BY 1, 2 HAVING count(*) > 1",
    (ERROR_DAYS,),
)

# --- aggregates ------------------------------------------------------------------

_ALL = [
    Agg("n", "buy", "count"),
    Agg("days", "session", "count_distinct"),
    Agg("total", "buy", "sum"),
    Agg("mean", "buy", "mean"),
    Agg("mid", "buy", "median"),
    Agg("low", "buy", "min"),
    Agg("high", "buy", "max"),
    Agg("spread", "buy", "std"),
    Agg("q25", "buy", "quantile", 0.25),
    Agg("first_buy", "buy", "first"),
    Agg("last_buy", "buy", "last"),
]
_ALL_SQL = """count(buy) AS n, count(DISTINCT session) AS days, coalesce(sum(buy), 0) AS total,
  avg(buy) AS mean, median(buy) AS mid, min(buy) AS low, max(buy) AS high,
  stddev_samp(buy) AS spread, quantile_cont(buy, 0.25) AS q25,
  arg_min(buy, {key}) FILTER (WHERE buy IS NOT NULL) AS first_buy,
  arg_max(buy, {key}) FILTER (WHERE buy IS NOT NULL) AS last_buy"""
_ALL_OUT = (
    "n:i days:i total:f mean:f mid:f low:f high:f spread:f q25:f first_buy:f last_buy:f"
)
register(
    "aggregate",
    "entity:i " + _ALL_OUT,
    lambda t: aggregate(
        user_day(t), ["entity"], _ALL, order_by=["session"], max_group_rows=SESSION_BOUND
    ),
    f"SELECT entity, {_ALL_SQL.format(key='session')} FROM user_day GROUP BY 1",
    UD,
)
register(
    "summarize",
    _ALL_OUT,
    lambda t: summarize(user_day(t), _ALL, order_by=["session", "entity"]),
    "SELECT " + _ALL_SQL.format(key="{'a': session, 'b': entity}") + " FROM user_day",
    UD,
)
_BY_SEGMENT = {
    "count": ("o_totalprice", None, "count(o_totalprice)", "i"),
    "count_distinct": ("o_custkey", None, "count(DISTINCT o_custkey)", "i"),
    "sum": ("o_totalprice", None, "sum(o_totalprice)", "f"),
    "mean": ("o_totalprice", None, "avg(o_totalprice)", "f"),
    "median": ("o_totalprice", None, "median(o_totalprice)", "f"),
    "min": ("o_totalprice", None, "min(o_totalprice)", "f"),
    "max": ("o_totalprice", None, "max(o_totalprice)", "f"),
    "std": ("o_totalprice", None, "stddev_samp(o_totalprice)", "f"),
    "quantile": ("o_totalprice", 0.3, "quantile_cont(o_totalprice, 0.3)", "f"),
    "first": ("o_totalprice", None, "arg_min(o_totalprice, o_orderkey)", "f"),
    "last": ("o_totalprice", None, "arg_max(o_totalprice, o_orderkey)", "f"),
}
for _name, (_field, _q, _sql, _kind) in _BY_SEGMENT.items():
    register(
        f"agg_{_name}",
        f"o_orderpriority:s y:{_kind}",
        lambda t, n=_name, f=_field, q=_q: aggregate(
            t.orders, ["o_orderpriority"], [Agg("y", f, n, q)], order_by=["o_orderkey"]
        ),
        f"SELECT o_orderpriority, {_sql} AS y FROM orders GROUP BY 1",
    )
register(
    "weighted_mean",
    "session:d y:f",
    lambda t: weighted_mean(user_day(t), "y", "close", "vol", ["session"]),
    "SELECT session, sum(close * vol) / sum(vol) AS y FROM user_day GROUP BY 1",
    UD,
)
_PERIODS = {
    "week": "CAST(date_trunc('week', session) AS DATE) + 6",
    "month": "last_day(session)",
    "quarter": "last_day(CAST(date_trunc('quarter', session) AS DATE) + INTERVAL 2 MONTH)",
    "year": "make_date(year(session), 12, 31)",
}
for _name, _sql in _PERIODS.items():
    register(
        f"resample_{_name}",
        "status:s ann_date:s n:i total:f last_amount:f",
        lambda t, n=_name: resample(
            disclosures(t),
            ["status"],
            "ann_date",
            n,
            [
                Agg("n", "amount", "count"),
                Agg("total", "amount", "sum"),
                Agg("last_amount", "amount", "last"),
            ],
            tie_break=["id"],
        ),
        f"""SELECT status, strftime({_sql.replace('session', 'ann_date')}, '%Y%m%d') AS ann_date,
            count(amount) AS n, sum(amount) AS total,
            arg_max(amount, {{'a': ann_date, 'b': id}}) AS last_amount
            FROM disclosures GROUP BY 1, 2""",
        (DISCLOSURES,),
    )
for _keep, _dir in (("first", "ASC"), ("last", "DESC")):
    register(
        f"distinct_{_keep}",
        "status:s type:s id:i ann_date:d",
        lambda t, k=_keep: distinct_by(
            disclosures(t), ["status", "type"], ["ann_date", "id"], keep=k
        ),
        f"""SELECT status, type, id, ann_date FROM disclosures QUALIFY row_number() OVER (
            PARTITION BY status, type ORDER BY ann_date {_dir}, id {_dir}) = 1""",
        (DISCLOSURES,),
    )
register(
    "latest_by_group",
    "entity:i end_date:d id:i ann_date:d",
    lambda t: latest_by_group(
        disclosures(t), ["entity", "end_date"], "ann_date", tie_break=["id"]
    ),
    """SELECT entity, end_date, id, ann_date FROM disclosures QUALIFY row_number() OVER (
       PARTITION BY entity, end_date ORDER BY ann_date DESC NULLS FIRST, id DESC) = 1""",
    (DISCLOSURES,),
)

# --- ranks and group statistics --------------------------------------------------

_RANKS = {
    "rank_min": ("min", "rank() OVER w"),
    "rank_max": ("max", "rank() OVER w + count(*) OVER tie - 1"),
    "rank_average": ("average", "rank() OVER w + (count(*) OVER tie - 1) / 2.0"),
    "rank_first": ("first", "row_number() OVER (PARTITION BY session, buy IS NULL ORDER BY buy, entity)"),
    "dense_rank": ("dense", "dense_rank() OVER w"),
}
for _name, (_method, _sql) in _RANKS.items():
    register(
        _name,
        KEY + "y:f",
        lambda t, m=_method: R.rank(
            user_day(t), "y", "buy", group_by=["session"], method=m, tie_break=["entity"]
        ),
        f"""SELECT entity, session, CASE WHEN buy IS NOT NULL THEN {_sql} END AS y FROM user_day
            WINDOW w AS (PARTITION BY session, buy IS NULL ORDER BY buy),
                   tie AS (PARTITION BY session, buy)""",
        UD,
    )
register(
    "rank_ungrouped",
    "o_orderkey:i y:f",
    lambda t: R.rank(t.orders, "y", "o_totalprice", direction="desc", method="average"),
    """SELECT o_orderkey, rank() OVER (ORDER BY o_totalprice DESC)
       + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS y FROM orders""",
)
register(
    "row_number",
    KEY + "y:i",
    lambda t: R.row_number(
        user_day(t), "y", ["entity"], "session", direction="desc", max_group_rows=SESSION_BOUND
    ),
    """SELECT entity, session, row_number() OVER (PARTITION BY entity ORDER BY session DESC) AS y
       FROM user_day""",
    UD,
)
_STATS = {
    "count": "count(buy)",
    "sum": "coalesce(sum(buy) {w}, 0)",
    "mean": "avg(buy)",
    "median": "median(buy)",
    "min": "min(buy)",
    "max": "max(buy)",
    "std": "stddev_samp(buy)",
}
_W = "OVER (PARTITION BY session)"
for _name, _sql in _STATS.items():
    register(
        f"group_transform_{_name}",
        KEY + "y:f",
        lambda t, n=_name: R.group_transform(user_day(t), "y", "buy", n, ["session"]),
        f"SELECT entity, session, {_sql.format(w=_W) if '{w}' in _sql else _sql + ' ' + _W} AS y "
        "FROM user_day",
        UD,
    )
register(
    "normalize_zscore",
    KEY + "y:f whole:f",
    lambda t: R.normalize(
        R.normalize(user_day(t), "y", "buy", "zscore", group_by=["session"]), "whole", "buy", "zscore"
    ),
    """SELECT entity, session,
       (buy - avg(buy) OVER w) / nullif(stddev_samp(buy) OVER w, 0) AS y,
       (buy - avg(buy) OVER ()) / nullif(stddev_samp(buy) OVER (), 0) AS whole
       FROM user_day WINDOW w AS (PARTITION BY session)""",
    UD,
)
register(
    "normalize_minmax",
    KEY + "y:f whole:f",
    lambda t: R.normalize(
        R.normalize(user_day(t), "y", "buy", "minmax", group_by=["session"]), "whole", "buy", "minmax"
    ),
    """SELECT entity, session,
       (buy - min(buy) OVER w) / nullif(max(buy) OVER w - min(buy) OVER w, 0) AS y,
       (buy - min(buy) OVER ()) / nullif(max(buy) OVER () - min(buy) OVER (), 0) AS whole
       FROM user_day WINDOW w AS (PARTITION BY session)""",
    UD,
)
register(
    "normalize_percentile",
    KEY + "y:f whole:f",
    lambda t: R.normalize(
        R.normalize(user_day(t), "y", "buy", "percentile", group_by=["session"]),
        "whole",
        "buy",
        "percentile",
    ),
    """SELECT entity, session,
       CASE WHEN buy IS NOT NULL THEN (rank() OVER (PARTITION BY session, buy IS NULL ORDER BY buy)
         + (count(*) OVER (PARTITION BY session, buy) - 1) / 2.0)
         / count(buy) OVER (PARTITION BY session) END AS y,
       CASE WHEN buy IS NOT NULL THEN (rank() OVER (PARTITION BY buy IS NULL ORDER BY buy)
         + (count(*) OVER (PARTITION BY buy) - 1) / 2.0) / count(buy) OVER () END AS whole
       FROM user_day""",
    UD,
)

# --- sort, limit, top-k ----------------------------------------------------------

for _dir in ("asc", "desc"):
    register(
        f"sort_{_dir}",
        KEY + "buy:f",
        lambda t, d=_dir: R.sort_rows(
            user_day(t), "buy", direction=d, tie_break=["entity", "session"]
        ),
        f"SELECT entity, session, buy FROM user_day ORDER BY buy {_dir} NULLS LAST, entity, session",
        UD,
    )
register(
    "limit",
    KEY + "buy:f",
    lambda t: R.limit_rows(
        R.sort_rows(user_day(t), "buy", direction="desc", tie_break=["entity", "session"]), 25
    ),
    """SELECT entity, session, buy FROM user_day
       ORDER BY buy DESC NULLS LAST, entity, session LIMIT 25""",
    UD,
)
register(
    "top_k_by_group",
    KEY + "buy:f",
    lambda t: R.top_k_by_group(user_day(t), "buy", ["session"], 3, tie_break=["entity"]),
    """SELECT entity, session, buy FROM user_day QUALIFY row_number() OVER (
       PARTITION BY session ORDER BY buy DESC NULLS LAST, entity) <= 3""",
    UD,
)

# --- sets ------------------------------------------------------------------------

register(
    "union_all",
    "nation:i balance:f",
    lambda t: S.union_all(
        t.customer.select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance")),
        t.supplier.select(F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation")),
    ),
    """SELECT c_nationkey AS nation, c_acctbal AS balance FROM customer
       UNION ALL SELECT s_nationkey, s_acctbal FROM supplier""",
)
for _name, _op, _sql in (
    ("intersect_keys", S.intersect_keys, "INTERSECT"),
    ("except_keys", S.except_keys, "EXCEPT"),
):
    register(
        _name,
        "entity:i session:d",
        lambda t, op=_op: op(user_day(t), error_days(t), ["entity", "session"]),
        f"SELECT entity, session FROM user_day {_sql} SELECT entity, session FROM error_days",
        (USER_DAY, ERROR_DAYS),
    )
