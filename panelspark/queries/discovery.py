"""Rule evidence and rule search on the suppliers' monthly panel, which grows with the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.plans import panel as E
from panelspark.plans import rules as R
from panelspark.plans import search as S
from panelspark.queries.base import register
from panelspark.queries.panels import SUPPLIER_PANEL, supplier_panel
from panelspark.queries.study import _FEATURES, assembled, panel_sql, sessions_of
from panelspark.session import stored

HORIZON, LAG, TARGET = 4, 3, 0.0
MONTH_DAYS = 45
TRAIN = ("19951101", "19980630")
VALIDATION = ("19980701", "20010131")
FACTORS = [
    "amount_to_5d_avg_ratio",
    "close_location_pct",
    "distance_from_5d_ma_pct",
    "downside_deviation_5d_pct",
    "max_drawdown_5d_pct",
    "open_gap_pct",
    "positive_days_3",
    "positive_days_5",
    "return_10d_pct",
    "return_5d_pct",
    "volatility_5d_pct",
    "volume_to_5d_avg_ratio",
]
PANEL = panel_sql("supplier_panel", "month")
GATES = S.Gates(samples=30, days=20, entities=5, coverage=0.8)
RULES = {
    "return_5d_pct <= 0": ["return_5d_pct"],
    "volume_to_5d_avg_ratio >= 1.1": ["volume_to_5d_avg_ratio"],
    "(return_5d_pct <= 0) and (positive_days_5 >= 2)": ["positive_days_5", "return_5d_pct"],
}


def monthly(t):
    """The panel's table, written once: the study reads it several times."""
    return stored(supplier_panel(t))


def dataset(t, window=TRAIN):
    """Signal months of a window with factors and the four-month forward return."""
    rows = monthly(t)
    return E.research_dataset(
        assembled(rows),
        sessions_of(rows),
        *window,
        horizon=HORIZON,
        factors=FACTORS,
        session_days=MONTH_DAYS,
    )


def evidence(t):
    return R.evaluate_rules(
        stored(dataset(t)),
        list(RULES),
        target_return=TARGET,
        lag=LAG,
    )


# --- the same evidence in SQL ----------------------------------------------------


def _day(text: str) -> str:
    return f"DATE '{text[:4]}-{text[4:6]}-{text[6:]}'"


def _research_sql(
    window: tuple[str, str], p: str = "", purge: str | None = None
) -> tuple[str, ...]:
    """CTEs up to ``{p}research``; ``purge`` drops outcomes from that day on."""
    start, end = (_day(d) for d in window)
    kept = f"JOIN cal c ON c.n = f.n + {HORIZON} AND c.session < {_day(purge)}" if purge else ""
    lookback = E.lookback_for(FACTORS)
    expressions = {c: sql for group in _FEATURES.values() for c, sql in group.items()}
    chosen = ", ".join(f"{expressions[f]} AS {f}" for f in FACTORS)
    return (
        f"""{p}edges AS (SELECT min(n) - {lookback} AS a, max(n) + {HORIZON} AS b FROM cal
          WHERE session BETWEEN {start} AND {end})""",
        f"""{p}cut AS (SELECT p.* FROM panel p, {p}edges WHERE n BETWEEN a AND b
          AND session BETWEEN {start} - {max(31, MONTH_DAYS * lookback)}
            AND {end} + {max(31, MONTH_DAYS * HORIZON)})""",
        f"""{p}cut_steps AS (SELECT *, adj / lag(adj) OVER (PARTITION BY entity ORDER BY n) - 1 AS step
          FROM {p}cut)""",
        f"""{p}featured AS (SELECT *, {chosen} FROM {p}cut_steps)""",
        f"""{p}research AS (SELECT f.entity, f.session, f.n, g.adj / f.adj - 1 AS ret,
          CASE WHEN g.adj / f.adj - 1 > {TARGET} THEN 1 WHEN g.adj IS NOT NULL THEN 0 END AS hit,
          {', '.join('f.' + c for c in FACTORS)}
          FROM {p}featured f LEFT JOIN {p}cut g ON g.entity = f.entity AND g.n = f.n + {HORIZON}
          {kept} WHERE f.session BETWEEN {start} AND {end})""",
    )


RESEARCH = (SUPPLIER_PANEL, PANEL, *_research_sql(TRAIN))
_OBS = " UNION ALL ".join(
    f"""SELECT '{text}' AS formula, entity, n AS day, ret, hit,
        coalesce({text}, FALSE) AS sel FROM research
        WHERE {' AND '.join(f + ' IS NOT NULL' for f in factors)}"""
    for text, factors in RULES.items()
)
_Z = "1.959963984540054"


def _hac_sql(source: str, tot: str, clusters: str) -> str:
    """Error from ``(formula, day, x)`` with Bartlett weights up to LAG sessions."""
    return f"""SELECT a.formula, CASE WHEN max({clusters}) > 1 THEN
      sqrt(greatest(0, max({clusters}) / nullif(max({clusters}) - 1.0, 0) *
      (sum(CASE WHEN a.day = b.day THEN a.x * b.x ELSE 0 END)
       + 2 * sum(CASE WHEN b.day < a.day THEN (1 - (a.day - b.day) / {LAG + 1}.0) * a.x * b.x
                 ELSE 0 END)))) ELSE 0 END AS e
      FROM {source} a JOIN {source} b ON a.formula = b.formula
        AND b.day BETWEEN a.day - {LAG} AND a.day
      JOIN {tot} t ON t.formula = a.formula GROUP BY 1"""


def _wilson_sql(p: str, n: str, sign: str) -> str:
    clip = "greatest(0, {0})" if sign == "-" else "least(1, {0})"
    body = (
        f"({p} + {_Z}*{_Z}/(2*{n}) {sign} {_Z}*sqrt({p}*(1-{p})/{n} + {_Z}*{_Z}/(4*{n}*{n})))"
        f" / (1 + {_Z}*{_Z}/{n})"
    )
    return clip.format(body)


def _cluster_sql(source: str) -> str:
    return f"""SELECT formula, sum(c) * sum(c) / sum(c * c) AS k, max(c) / sum(c) AS m,
      CASE WHEN count(*) > 1 THEN sqrt(count(*) / nullif(count(*) - 1.0, 0) * sum(x * x))
      ELSE 0 END AS err FROM {source} GROUP BY 1"""


def _side_sql(p: str, side: str, condition: str) -> tuple[str, ...]:
    """CTEs for one side (selected ``s`` or baseline ``b``): errors and interval."""
    q = p + side
    cells = ", ".join((f"sum(o.hit - t.p{side}) / max(t.n{side}) AS x", "count(*) AS c"))
    source = f"FROM {p}obs o JOIN {p}tot t USING (formula) WHERE ret IS NOT NULL AND {condition}"
    margin = f"{_Z} * greatest(h.e, e.err)"
    return (
        f"{q}day AS (SELECT o.formula, o.day, {cells} {source} GROUP BY 1, 2)",
        f"{q}ent AS (SELECT o.formula, o.entity, {cells} {source} GROUP BY 1, 2)",
        f"{q}hac AS ({_hac_sql(q + 'day', p + 'tot', 't.d' + side)})",
        f"{q}days AS ({_cluster_sql(q + 'day')})",
        f"{q}ents AS ({_cluster_sql(q + 'ent')})",
        f"""{q}int AS (SELECT t.formula, d.k AS kd, e.k AS ke, d.m AS md, e.m AS me,
          CASE WHEN t.d{side} > 1 THEN greatest(h.e, e.err) ELSE 0 END AS error,
          CASE WHEN t.d{side} > 1 THEN least(greatest(0, p{side} - {margin}),
            {_wilson_sql('p' + side, 'd.k', '-')}, {_wilson_sql('p' + side, 'e.k', '-')})
          ELSE 0 END AS lo,
          CASE WHEN t.d{side} > 1 THEN greatest(least(1, p{side} + {margin}),
            {_wilson_sql('p' + side, 'd.k', '+')}, {_wilson_sql('p' + side, 'e.k', '+')})
          ELSE 1 END AS hi
          FROM {p}tot t JOIN {q}hac h USING (formula) JOIN {q}days d USING (formula)
          JOIN {q}ents e USING (formula))""",
    )


def _evidence_sql(obs: str, p: str = "") -> tuple[str, ...]:
    """CTEs from ``{p}obs`` (formula, entity, day, ret, hit, sel) to ``{p}ev``."""
    return (
        f"{p}obs AS ({obs})",
        f"""{p}tot AS (SELECT formula, count(*) AS eligible, count(*) FILTER (WHERE sel) AS matched,
      count(ret) AS nb, count(ret) FILTER (WHERE sel) AS ns,
      sum(hit) AS hb, sum(hit) FILTER (WHERE sel) AS hs,
      avg(hit) AS pb, avg(hit) FILTER (WHERE sel) AS ps,
      count(DISTINCT CASE WHEN ret IS NOT NULL THEN day END) AS db,
      count(DISTINCT CASE WHEN ret IS NOT NULL AND sel THEN day END) AS ds,
      count(DISTINCT CASE WHEN ret IS NOT NULL AND sel THEN entity END) AS es,
      avg(ret) FILTER (WHERE sel) AS mean_return, median(ret) FILTER (WHERE sel) AS median_return,
      quantile_cont(ret, 0.05) FILTER (WHERE sel) AS return_p05,
      stddev_pop(ret) FILTER (WHERE sel) AS return_std,
      bit_xor(hash(entity, day)) FILTER (WHERE sel) AS cohort FROM {p}obs GROUP BY 1)""",
        *_side_sql(p, "s", "sel"),
        *_side_sql(p, "b", "TRUE"),
        f"""{p}lx AS (SELECT o.formula, o.day, o.entity, 1 AS c,
      CASE WHEN o.sel THEN (o.hit - t.ps) / t.ns ELSE 0 END - (o.hit - t.pb) / t.nb AS x
      FROM {p}obs o JOIN {p}tot t USING (formula) WHERE ret IS NOT NULL)""",
        f"{p}lday AS (SELECT formula, day, sum(x) AS x FROM {p}lx GROUP BY 1, 2)",
        f"{p}lhac AS ({_hac_sql(p + 'lday', p + 'tot', 't.db')})",
        f"""{p}lent AS ({_cluster_sql(
            f'(SELECT formula, entity, sum(x) AS x, sum(c) AS c FROM {p}lx GROUP BY 1, 2)')})""",
        f"""{p}ev AS (SELECT t.*, s.error AS se, s.kd, s.ke, s.md, s.me,
      least(s.lo, t.hs / t.matched) AS lo, greatest(s.hi, (t.hs + t.matched - t.ns) / t.matched) AS hi,
      least(b.lo, t.hb / t.eligible) AS blo,
      greatest(b.hi, (t.hb + t.eligible - t.nb) / t.eligible) AS bhi,
      t.hs / t.matched AS out_lo, (t.hs + t.matched - t.ns) / t.matched AS out_hi,
      greatest(h.e, l.err) AS lse
      FROM {p}tot t JOIN {p}sint s USING (formula) JOIN {p}bint b USING (formula)
      JOIN {p}lhac h USING (formula) JOIN {p}lent l USING (formula))""",
    )


EVIDENCE = (*RESEARCH, *_evidence_sql(_OBS))

# Output column -> its SQL over ``ev``.
_SQL = {
    "sample_count": "ns",
    "matched_sample_count": "matched",
    "eligible_sample_count": "eligible",
    "rule_support_rate": "matched / eligible",
    "missing_outcome_count": "matched - ns",
    "outcome_coverage_rate": "ns / matched",
    "positive_count": "hs",
    "win_rate": "ps",
    "mean_return": "mean_return",
    "median_return": "median_return",
    "return_p05": "return_p05",
    "return_std": "return_std",
    "baseline_win_rate": "pb",
    "baseline_sample_count": "nb",
    "baseline_outcome_coverage_rate": "nb / eligible",
    "win_rate_lift": "ps - pb",
    "outcome_robust_lift_lower": "hs / matched - (hb + (eligible - nb) - (matched - ns)) / eligible",
    "outcome_robust_lift_upper": "(hs + matched - ns) / matched - (hb + matched - ns) / eligible",
    "lift_confidence_lower": f"greatest(-1, least(ps - pb - {_Z} * lse, lo - bhi))",
    "lift_confidence_upper": f"least(1, greatest(ps - pb + {_Z} * lse, hi - blo))",
    "confidence_lower": "lo",
    "confidence_upper": "hi",
    "trading_day_count": "ds",
    "effective_trading_day_count": "kd",
    "security_count": "es",
    "effective_security_count": "ke",
    "max_security_event_share": "me",
    "max_signal_date_event_share": "md",
    "cluster_standard_error": "se",
    "lift_standard_error": "lse",
}
_COUNTS = {c for c in _SQL if c.endswith("_count") and not c.startswith("effective")}


def _evidence_query(name: str, columns: list[str]) -> None:
    out = " ".join(f"{c}:{'i' if c in _COUNTS else 'f'}" for c in columns)
    register(
        name,
        "formula:s " + out,
        evidence,
        "SELECT formula, " + ", ".join(f"{_SQL[c]} AS {c}" for c in columns) + " FROM ev",
        EVIDENCE,
    )


_evidence_query(
    "rule_support",
    "matched_sample_count eligible_sample_count rule_support_rate missing_outcome_count "
    "outcome_coverage_rate baseline_outcome_coverage_rate".split(),
)
_evidence_query(
    "rule_returns",
    "sample_count positive_count win_rate mean_return median_return return_p05 return_std "
    "baseline_win_rate baseline_sample_count win_rate_lift".split(),
)
_evidence_query(
    "rule_concentration",
    "trading_day_count security_count max_security_event_share max_signal_date_event_share".split(),
)
_evidence_query(
    "kish_effective_count", ["effective_trading_day_count", "effective_security_count"]
)
_evidence_query("rule_interval", ["confidence_lower", "confidence_upper", "cluster_standard_error"])
_evidence_query("lift_standard_error", ["win_rate_lift", "lift_standard_error"])
_evidence_query("lift_interval", ["lift_confidence_lower", "lift_confidence_upper"])
_evidence_query("robust_lift_bounds", ["outcome_robust_lift_lower", "outcome_robust_lift_upper"])
_evidence_query("backtest_rule", list(_SQL))


def _cells(t):
    """Counts per (rule, session), and sums over entities per rule, of the training window."""
    panel = stored(dataset(t))
    rules = [R.make_rule(text, panel.columns) for text in RULES]
    clean = R.clean_panel(panel, FACTORS, TARGET)
    boxes = R.rule_boxes(list(enumerate(rules)), [])
    calendar = E.numbered_calendar(clean.select("session").distinct())
    days = stored(R.sums_by_session(clean, boxes).join(E.broadcast_calendar(calendar), "session"))
    entities = stored(R.sums_over_entities(clean, boxes, {}))
    names = t.spark.createDataFrame(list(enumerate(RULES)), "tag long, formula string")
    return days, entities, F.lit(calendar.count()), names


def _error_parts(t):
    days, entities, sessions, names = _cells(t)
    totals = R.rule_totals(days, entities)
    small = totals.select("tag", "rate", F.col("n").alias("total"))
    residual = (F.col("hits") - F.col("rate") * F.col("n")) / F.col("total")
    dated = days.join(small, "tag").select("tag", "session_rank", residual.alias("x"))
    wide = totals.join(R.hac_long_run(dated, LAG, sessions), "tag").withColumn(
        "ent_run", R.entity_squares(F.col("rate"), F.col("n").cast("double"))
    )
    low, high = R.wilson_bounds(F.col("rate"), F.col("n").cast("double"))
    return wide.join(names, "tag").select(
        "formula",
        R.cluster_error(F.col("long_run"), F.col("days")).alias("date_error"),
        R.cluster_error(F.col("ent_run"), F.col("entities")).alias("entity_error"),
        low.alias("wilson_low"),
        high.alias("wilson_high"),
        (F.col("hits") / F.col("matched")).alias("outcome_low"),
        ((F.col("hits") + F.col("matched") - F.col("n")) / F.col("matched")).alias("outcome_high"),
    )


register(
    "hac_standard_error",
    "formula:s date_error:f",
    _error_parts,
    "SELECT formula, e AS date_error FROM shac",
    EVIDENCE,
)
register(
    "entity_cluster_se",
    "formula:s entity_error:f",
    _error_parts,
    "SELECT formula, err AS entity_error FROM sents",
    EVIDENCE,
)
register(
    "wilson_interval",
    "formula:s wilson_low:f wilson_high:f",
    _error_parts,
    f"""SELECT formula, {_wilson_sql('ps', 'ns', '-')} AS wilson_low,
        {_wilson_sql('ps', 'ns', '+')} AS wilson_high FROM tot""",
    EVIDENCE,
)
register(
    "outcome_bounds",
    "formula:s outcome_low:f outcome_high:f",
    _error_parts,
    "SELECT formula, out_lo AS outcome_low, out_hi AS outcome_high FROM ev",
    EVIDENCE,
)
register(
    "rule_select",
    "entity:i session:d return_5d_pct:f positive_days_5:f",
    lambda t: R.rule_select(dataset(t), list(RULES)[2]),
    f"""SELECT entity, session, return_5d_pct, positive_days_5 FROM research
        WHERE {list(RULES)[2]}""",
    RESEARCH,
)
register(
    "research_dataset",
    "entity:i session:d forward_return:f " + " ".join(f"{f}:f" for f in FACTORS),
    dataset,
    f"SELECT entity, session, ret AS forward_return, {', '.join(FACTORS)} FROM research",
    RESEARCH,
)
register(
    "event_examples",
    "formula:s position:i entity:i session:d forward_return:f value:f",
    lambda t: R.event_examples(dataset(t), list(RULES)).withColumn(
        "value", F.col("factor_values")["return_5d_pct"]
    ),
    " UNION ALL ".join(
        f"""SELECT '{text}' AS formula, row_number() OVER (ORDER BY session DESC, entity) AS position,
        entity, session, ret AS forward_return,
        {'return_5d_pct' if 'return_5d_pct' in factors else 'CAST(NULL AS DOUBLE)'} AS value
        FROM research WHERE {text} AND ret IS NOT NULL QUALIFY position <= {R.EXAMPLES}"""
        for text, factors in RULES.items()
    ),
    RESEARCH,
)

# --- search ----------------------------------------------------------------------
# The same search in SQL: conditions from the thresholds, evidence of single conditions,
# the pairing pool, evidence of pairs, ranking, and the shortlist on the second window.


def training(t):
    """The training window without outcomes that reach the validation window."""
    return E.purge_overlap(dataset(t), VALIDATION[0])


def _long_sql(p: str) -> str:
    parts = [
        f"SELECT '{f}' AS factor, entity, n, ret, hit, {f} AS v FROM {p}research" for f in FACTORS
    ]
    return " UNION ALL ".join(parts)


_MEETS = "CASE {op} WHEN '<=' THEN {v} <= {thr} ELSE {v} >= {thr} END"


def _meets(alias: str, value: str) -> str:
    return _MEETS.format(op=f"{alias}.operator", v=value, thr=f"{alias}.thr")


_TRAINING = (
    SUPPLIER_PANEL,
    PANEL,
    *_research_sql(TRAIN, purge=VALIDATION[0]),
    f"long AS ({_long_sql('')})",
    "kinds AS (SELECT factor, count(DISTINCT v) AS k FROM long GROUP BY 1)",
    """cuts AS (SELECT DISTINCT factor, v AS threshold, 'observed_value' AS source
      FROM long JOIN kinds USING (factor) WHERE k BETWEEN 2 AND 10 AND v IS NOT NULL
      UNION ALL SELECT factor, unnest(quantile_cont(v, [0.1, 0.25, 0.5, 0.75, 0.9])), 'quantile'
      FROM long JOIN kinds USING (factor) WHERE k > 10 GROUP BY factor)""",
    """raw AS (SELECT factor, operator, source, CAST(printf('%.10g', threshold) AS DOUBLE) AS thr,
      factor || ' ' || operator || ' ' || printf('%.10g', threshold) AS formula
      FROM cuts, (VALUES ('<='), ('>=')) o(operator))""",
)
_ENOUGH = f"""ns >= {GATES.samples} AND ds >= {GATES.days} AND kd >= {GATES.days}
  AND es >= {GATES.entities} AND ke >= {GATES.entities}"""
_COVERED = f"ns / matched >= {GATES.coverage} AND nb / eligible >= {GATES.coverage}"
_LOWER = f"greatest(-1, least(ps - pb - {_Z} * lse, lo - bhi))"
_ORDER = f"{_LOWER} DESC, return_p05 DESC, median_return DESC, id"
_SINGLES = (
    *_TRAINING,
    *_evidence_sql(
        f"""SELECT formula, entity, n AS day, ret, hit, {_meets('r', 'l.v')} AS sel
        FROM long l JOIN raw r USING (factor) WHERE v IS NOT NULL"""
    ),
    """tried AS (SELECT *, row_number() OVER (ORDER BY factor, operator, thr) AS id FROM (
      SELECT r.factor, r.operator, r.thr, r.source, e.* FROM ev e JOIN raw r USING (formula)
      WHERE matched > 0 AND matched < eligible
      QUALIFY row_number() OVER (PARTITION BY r.factor, r.operator, matched ORDER BY thr) = 1))""",
)
_POOL = (
    *_SINGLES,
    f"""pool AS (SELECT *, row_number() OVER (ORDER BY wave, {_ORDER}) AS place FROM (
      SELECT *, CASE WHEN row_number() OVER (PARTITION BY factor ORDER BY {_ORDER}) = 1 THEN 1
        WHEN row_number() OVER (PARTITION BY factor, operator ORDER BY {_ORDER}) = 1 THEN 2
        WHEN row_number() OVER (PARTITION BY factor, operator ORDER BY {_ORDER}) <= 2 THEN 3
        END AS wave FROM tried WHERE {_ENOUGH}) WHERE wave IS NOT NULL
      QUALIFY place <= {S.POOL_LIMIT})""",
)
_PAIRS = (
    *_POOL,
    """pairs AS (SELECT '(' || a.formula || ') and (' || b.formula || ')' AS formula,
      100000 + a.place * 1000 + b.place AS id, a.factor AS f1, b.factor AS f2,
      a.operator AS o1, b.operator AS o2, a.thr AS t1, b.thr AS t2,
      CASE WHEN a.source = b.source THEN a.source ELSE 'mixed' END AS source
      FROM pool a JOIN pool b ON a.place < b.place AND (a.factor <> b.factor OR
        (a.operator <> b.operator AND
         CASE WHEN a.operator = '>=' THEN a.thr <= b.thr ELSE b.thr <= a.thr END)))""",
    *_evidence_sql(
        f"""SELECT formula, l.entity, l.n AS day, l.ret, l.hit,
        ({_MEETS.format(op='o1', v='l.v', thr='t1')}) AND ({_MEETS.format(op='o2', v='m.v', thr='t2')}) AS sel
        FROM pairs JOIN long l ON l.factor = f1 AND l.v IS NOT NULL
        JOIN long m ON m.factor = f2 AND m.v IS NOT NULL AND m.entity = l.entity AND m.n = l.n""",
        "p",
    ),
)
_RANKED = (
    *_PAIRS,
    f"""strong AS (SELECT * FROM (
      SELECT id, source, factor AS f1, operator AS o1, thr AS t1, NULL AS f2, NULL AS o2,
        NULL AS t2, e.* FROM tried JOIN ev e USING (formula)
      UNION ALL
      SELECT id, source, f1, o1, t1, f2, o2, t2, e.* FROM pairs JOIN pev e USING (formula))
      WHERE {_ENOUGH} AND {_COVERED} AND ps - pb > 0 AND {_SQL['outcome_robust_lift_lower']} > 0
      QUALIFY row_number() OVER (PARTITION BY matched, cohort ORDER BY {_ORDER}) = 1)""",
    f"""short AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS place FROM strong
      QUALIFY place <= {S.SHORTLIST})""",
)
_JUDGED = (
    *_RANKED,
    *_research_sql(VALIDATION, "v"),
    f"vlong AS ({_long_sql('v')})",
    *_evidence_sql(
        f"""SELECT formula, l.entity, l.n AS day, l.ret, l.hit,
        ({_MEETS.format(op='o1', v='l.v', thr='t1')}) AND coalesce(
          ({_MEETS.format(op='o2', v='m.v', thr='t2')}), TRUE) AS sel
        FROM short JOIN vlong l ON l.factor = f1 AND l.v IS NOT NULL
        JOIN vlong m ON m.factor = coalesce(f2, f1) AND m.v IS NOT NULL
          AND m.entity = l.entity AND m.n = l.n""",
        "w",
    ),
    f"""tested AS (SELECT s.place, s.formula, s.source, s.ps - s.pb AS train_win_rate_lift,
      s.matched / s.eligible AS train_support, w.ps - w.pb AS win_rate_lift,
      w.matched / w.eligible AS support, w.lse, w.kd,
      floor(w.kd) - 1 AS nu, (w.ps - w.pb) / nullif(w.lse, 0) AS t,
      w.ns, w.ds, w.es, w.ke, w.ns / w.matched AS cover, w.nb / w.eligible AS base_cover,
      {_SQL['outcome_robust_lift_lower'].replace('hs', 'w.hs').replace('matched', 'w.matched')
        .replace('hb', 'w.hb').replace('eligible', 'w.eligible').replace('nb)', 'w.nb)')
        .replace('- ns', '- w.ns')} AS robust
      FROM short s JOIN wev w USING (formula))""",
    # Upper tail by Simpson's rule on the Student-t density.
    f"""tails AS (SELECT formula, 0.5 - exp(lgamma((nu + 1) / 2.0) - lgamma(nu / 2.0))
        / sqrt(nu * pi()) * sum(CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END
          * pow(1 + pow(t * k / 4000, 2) / nu, -(nu + 1) / 2.0)) * t / 12000 AS tail
      FROM tested, range(0, 4001) r(k) WHERE t > 0 GROUP BY formula, nu, t)""",
    f"""judged AS (SELECT x.*, abs(train_win_rate_lift - win_rate_lift) AS generalization_gap,
      CASE WHEN ns >= {GATES.samples} AND ds >= {GATES.days} AND kd >= {GATES.days}
        AND es >= {GATES.entities} AND ke >= {GATES.entities} AND cover >= {GATES.coverage}
        AND base_cover >= {GATES.coverage} AND win_rate_lift > 0 AND lse > 0
        THEN greatest(tail, 0) ELSE 1 END AS p_value
      FROM tested x LEFT JOIN tails USING (formula))""",
    """valued AS (SELECT *, least(1, min(p_value * m * h / r) OVER (ORDER BY p_value
        RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q_value FROM (
      SELECT *, count(*) OVER () AS m,
        (SELECT sum(1.0 / k) FROM range(1, 1 + (SELECT count(*) FROM judged)) g(k)) AS h,
        count(*) OVER (ORDER BY p_value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r
      FROM judged))""",
    f"""verdict AS (SELECT *, CASE
      WHEN cover < {GATES.coverage} THEN 'insufficient_validation_coverage'
      WHEN base_cover < {GATES.coverage} THEN 'insufficient_validation_baseline_coverage'
      WHEN ns < {GATES.samples} THEN 'insufficient_validation_samples'
      WHEN ds < {GATES.days} THEN 'insufficient_validation_days'
      WHEN kd < {GATES.days} THEN 'insufficient_validation_effective_days'
      WHEN es < {GATES.entities} THEN 'insufficient_validation_securities'
      WHEN ke < {GATES.entities} THEN 'insufficient_validation_effective_securities'
      WHEN win_rate_lift <= 0 THEN 'validation_lift_not_positive'
      WHEN robust <= 0 THEN 'validation_outcome_attrition_not_robust'
      WHEN kd < {S.MIN_SIGNIFICANCE_DAYS} THEN 'insufficient_significance_days'
      WHEN q_value > {S.MAX_Q_VALUE} THEN 'fdr_not_passed' ELSE 'passed' END AS validation_reason
      FROM valued WHERE place <= {S.LEADERBOARD})""",
)

register(
    "search_thresholds",
    "factor:s threshold:f source:s",
    lambda t: S.search_thresholds(R.clean_panel(stored(training(t)), FACTORS, TARGET), FACTORS),
    "SELECT * FROM cuts",
    _TRAINING,
)


def _training(t):
    """Cleaned training rows and the evidence of every condition worth trying."""
    clean = stored(R.clean_panel(training(t), sorted(FACTORS), TARGET))
    conditions = S.raw_conditions(S.search_thresholds(clean, FACTORS))
    raw = S.single_evidence(clean, conditions, LAG, TARGET, GATES.enough())
    return clean, conditions, stored(S.distinct_conditions(raw, conditions), few=True)


register(
    "search_conditions",
    "formula:s factor:s operator:s matched:i",
    lambda t: _training(t)[2].withColumnRenamed("matched_sample_count", "matched"),
    "SELECT formula, factor, operator, matched FROM tried",
    _SINGLES,
)
register(
    "search_singles",
    "formula:s sample_count:i win_rate:f win_rate_lift:f lift_confidence_lower:f",
    lambda t: _training(t)[2].where(GATES.enough() & GATES.covered()),
    f"""SELECT formula, ns AS sample_count, ps AS win_rate, ps - pb AS win_rate_lift,
        {_LOWER} AS lift_confidence_lower FROM tried WHERE {_ENOUGH} AND {_COVERED}""",
    _SINGLES,
)
register(
    "search_pairing_pool",
    "wave:i formula:s",
    lambda t: S.pairing_pool(_training(t)[2].where(GATES.enough())),
    "SELECT wave, formula FROM pool",
    _POOL,
)


def _pairs(t):
    clean, conditions, tried = _training(t)
    pool = [
        conditions[r["rule"]]
        for r in S.pairing_pool(tried.where(GATES.enough())).select("rule").collect()
    ]
    return S.search_pairs(clean, pool, len(conditions), LAG, TARGET)[0]


register(
    "search_pairs",
    "formula:s source:s sample_count:i win_rate_lift:f lift_confidence_lower:f",
    _pairs,
    f"""SELECT formula, source, coalesce(ns, 0) AS sample_count,
        coalesce(ps - pb, 0) AS win_rate_lift,
        CASE WHEN ns > 0 THEN {_LOWER} ELSE -1 END AS lift_confidence_lower
        FROM pairs LEFT JOIN pev USING (formula)""",
    _PAIRS,
)


def _found(t):
    return S.search_training(training(t), FACTORS, GATES, lag=LAG, target=TARGET)


register(
    "search_dedupe",
    "formula:s matched_sample_count:i win_rate_lift:f",
    lambda t: S.training_rank(_found(t).candidates),
    "SELECT formula, matched AS matched_sample_count, ps - pb AS win_rate_lift FROM strong",
    _RANKED,
)
register(
    "search_rank",
    "formula:s lift_confidence_lower:f return_p05:f median_return:f",
    lambda t: S.training_rank(_found(t).candidates).orderBy(*S.rank_keys()),
    f"""SELECT formula, {_LOWER} AS lift_confidence_lower, return_p05, median_return
        FROM strong ORDER BY {_ORDER}""",
    _RANKED,
)
register(
    "search_shortlist",
    "place:i formula:s source:s win_rate_lift:f",
    lambda t: _found(t).shortlist,
    "SELECT place, formula, source, ps - pb AS win_rate_lift FROM short",
    _RANKED,
)


def _board(t):
    rows = monthly(t)
    board, _ = S.discovery_study(
        assembled(rows),
        sessions_of(rows),
        S.Study(
            *TRAIN,
            *VALIDATION,
            tuple(FACTORS),
            horizon=HORIZON,
            minimum_entities=GATES.entities,
            minimum_coverage_pct=GATES.coverage * 100,
            session_days=MONTH_DAYS,
        ),
    )
    return board


_BOARD = "place:i formula:s train_win_rate_lift:f win_rate_lift:f "
_HEAD = "SELECT place, formula, train_win_rate_lift, win_rate_lift, "
register(
    "validate_rules",
    _BOARD + "generalization_gap:f support_rate_gap:f support_retention_ratio:f validation_score:f",
    _board,
    _HEAD
    + f"""generalization_gap, abs(train_support - support) AS support_rate_gap,
    support / train_support AS support_retention_ratio,
    win_rate_lift - {S.Z_95_ONE_SIDED} * lse - generalization_gap AS validation_score FROM verdict""",
    _JUDGED,
)
register("rule_p_value", _BOARD + "p_value:f", _board, _HEAD + "p_value FROM verdict", _JUDGED)
register(
    "validation_reason",
    _BOARD + "q_value:f validation_reason:s validation_passed:b",
    _board,
    _HEAD
    + """q_value, validation_reason, validation_reason = 'passed' AS validation_passed
    FROM verdict""",
    _JUDGED,
)
register(
    "discovery_study",
    _BOARD + "p_value:f q_value:f validation_reason:s source:s",
    _board,
    _HEAD + "p_value, q_value, validation_reason, source FROM verdict",
    _JUDGED,
)


def _family(t):
    """One p-value per nation: its share of customers in debt."""
    return t.customer.groupBy("c_nationkey").agg(
        F.avg((F.col("c_acctbal") < 0).cast("double")).alias("p")
    )


register(
    "by_q_value",
    "c_nationkey:i p:f q:f",
    lambda t: S.with_q_value(_family(t), "p", "q"),
    """SELECT c_nationkey, p, least(1, min(raw) OVER (ORDER BY p
         RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM (
       SELECT c_nationkey, p, p * count(*) OVER () * (SELECT sum(1.0 / k) FROM range(1,
           1 + (SELECT count(DISTINCT c_nationkey) FROM customer)) r(k))
         / count(*) OVER (ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS raw
       FROM (SELECT c_nationkey, avg(CASE WHEN c_acctbal < 0 THEN 1.0 ELSE 0.0 END) AS p
             FROM customer GROUP BY 1))""",
)
