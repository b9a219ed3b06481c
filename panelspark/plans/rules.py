"""Evidence for many threshold rules in one pass over the panel.

Rules are boxes of thresholds. Panel rows are counted once per pair of factors, cell between
thresholds, and session (or range of returns), combining before the shuffle; running
sums over the cells give the sufficient statistics of every rule and of every baseline
(``plans/cells.py``). Of entities only sums of products over all of them are needed, which tasks
add up while they read the rows of one entity after the other. Rates, concentration, cluster-robust errors, intervals and return
quantiles follow from those tables. A rule that is no box is a cell of its own.

A rule's baseline is every row on which all of its factors are known. The HAC sum uses two range
windows instead of one join per lag. Quantiles of returns look again only at the rows whose
return lies in a range that holds a wanted position of some rule.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.statistics import (
    Z_95_TWO_SIDED,
    cluster_variance,
    kish_count,
    wilson_bounds,
)
from panelspark.operators.quantiles import (
    mean_size,
    picked_quantiles,
    value_bucket,
    wanted_positions,
)
from panelspark.plans.cells import PRODUCTS, Boxes, Side
from panelspark.plans.panel import (
    ENTITY,
    RANK,
    SESSION,
    broadcast_calendar,
    finite,
    numbered_calendar,
)
from panelspark.session import stored

OUTCOMES = ("forward_return", "future_adjusted_close", "future_trade_date", "future_session")
EXAMPLES = 5
QUANTILES = {"return_p05": 0.05, "median_return": 0.5}
# A rule as the search writes it: one or two of these, joined by "and".
_CONDITION = re.compile(
    r"\s*\(?\s*([A-Za-z_]\w*)\s*(<=|>=)\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)\s*\)?\s*"
)


@dataclass(frozen=True)
class Rule:
    """A boolean expression over factors, with the factors it refers to. ``conditions`` are its
    ``(factor, operator, threshold)`` if it is one or two of them."""

    text: str
    factors: tuple[str, ...]
    conditions: tuple[tuple[str, str, float], ...] = ()


def make_rule(text: str, columns: Sequence[str]) -> Rule:
    """Check the names in a rule: known factors only, never an outcome."""
    names = set(re.findall(r"\b[A-Za-z_]\w*\b", text))
    leaked = sorted(names & set(OUTCOMES))
    if leaked:
        raise ValueError("a rule cannot refer to outcome fields: " + ", ".join(leaked))
    factors = tuple(sorted(names & (set(columns) - {SESSION, ENTITY, RANK})))
    unknown = sorted(names - set(factors) - {"and", "or", "not", "AND", "OR", "NOT"})
    if unknown:
        raise ValueError("a rule refers to unknown fields: " + ", ".join(unknown))
    parts = [_CONDITION.fullmatch(part) for part in re.split(r"(?i)\band\b", text)]
    simple = len(parts) <= 2 and all(parts)
    return Rule(
        text, factors, tuple((m[1], m[2], float(m[3])) for m in parts) if simple else ()
    )


def clean_panel(panel: DataFrame, factors: Sequence[str], target_return: float) -> DataFrame:
    """Keys, outcome and finite factors; an absent factor is missing everywhere."""
    if "forward_return" not in panel.columns:
        raise ValueError("the research dataset has no forward_return")
    columns = [
        (finite(panel, f) if f in panel.columns else F.lit(None).cast("double")).alias(f)
        for f in dict.fromkeys(factors)
    ]
    outcome = finite(panel, "forward_return")
    return panel.select(
        ENTITY,
        SESSION,
        outcome.alias("ret"),
        F.when(outcome > target_return, 1).when(outcome.isNotNull(), 0).alias("hit"),
        *columns,
    )


def rule_select(panel: DataFrame, text: str) -> DataFrame:
    """The rows a rule selects."""
    rule = make_rule(text, panel.columns)
    known = panel.withColumns({f: finite(panel, f) for f in rule.factors})
    return known.where(F.expr(rule.text))


def rule_boxes(rules: Sequence[tuple[int, Rule]], sets: Sequence[Sequence[str]]) -> Boxes:
    """Boxes of tagged rules, and of the baselines of factor sets: set ``i`` has tag ``-(i + 1)``."""
    factors = {f for _, rule in rules for f in rule.factors} | {f for s in sets for f in s}
    values = {f: F.col(f) for f in sorted(factors)}
    for tag, rule in rules:
        if not rule.conditions:
            values[f"rule:{tag}"] = F.when(F.expr(rule.text), 1.0)
    for i, names in enumerate(sets):
        if not 1 <= len(names) <= 2:
            known = functools.reduce(Column.__and__, [F.col(f).isNotNull() for f in names], F.lit(True))
            values[f"known:{i}"] = F.when(known, 1.0)
    boxes = Boxes(values)
    for tag, rule in rules:
        # One order of two factors, so that a pair of them is one grid.
        sides = [Side(*condition) for condition in sorted(rule.conditions)]
        boxes.add(tag, *(sides or [Side(f"rule:{tag}")]))
    for i, names in enumerate(sets):
        sides = [Side(f) for f in sorted(names)] if 1 <= len(names) <= 2 else [Side(f"known:{i}")]
        boxes.add(-(i + 1), *sides)
    return boxes


def sums_by_session(clean: DataFrame, boxes: Boxes) -> DataFrame:
    """Counts, return sums and a fingerprint of the selected rows per (tag, session).

    The fingerprint is the XOR of two independent 64-bit hashes of the row keys: equal
    sets give equal values in any order, and 128 bits keep different sets apart.
    """
    stats = [
        F.count(F.lit(1)).alias("matched"),
        F.count("ret").alias("n"),
        F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"),
        F.sum("ret").alias("s1"),
        F.sum(F.col("ret") * F.col("ret")).alias("s2"),
        F.bit_xor("x1").alias("x1"),
        F.bit_xor("x2").alias("x2"),
    ]
    # A row is hashed once, not once per grid.
    hashed = clean.withColumns(
        {"x1": F.xxhash64(ENTITY, SESSION), "x2": F.xxhash64(F.lit("second"), SESSION, ENTITY)}
    )
    cells = boxes.cells(hashed, SESSION, ["ret", "hit", "x1", "x2"], stats)
    return boxes.sums(cells, SESSION, ["matched", "n", "hits", "s1", "s2"], ["x1", "x2"])


def sums_over_entities(clean: DataFrame, boxes: Boxes, bases: Mapping[int, int]) -> DataFrame:
    """Per tag, its entities with observed rows, the most rows of one, and sums over entities of
    products of observed rows and hits, its own and its baseline's (``Boxes.products``)."""
    found = boxes.products(clean.where(F.col("ret").isNotNull()), ENTITY, "hit", bases)
    return found.withColumnsRenamed({"keys": "entities", "most": "ent_max"})


def entity_squares(rate: Column, total: Column, prefix: str = "") -> Column:
    """Sum over entities of squared residuals: Σ((h - p·n)/N)² from the sums of products."""
    nn, nh, hh = (F.col(prefix + c) for c in ("nn", "nh", "hh"))
    return F.try_divide(hh - 2 * rate * nh + rate * rate * nn, total * total)


def return_quantiles(
    clean: DataFrame, boxes: Boxes, chosen: DataFrame, bounds: Sequence[float | None]
) -> DataFrame:
    """``tag`` and the ``QUANTILES`` of its returns, for the tags in ``chosen``. ``bounds`` are
    the least and greatest return and their mean size.

    Rows are counted per cell and range of returns. A tag's counts tell which ranges hold its
    wanted positions; only rows in such a range are looked at again, once per distinct value.
    """
    present = clean.where(F.col("ret").isNotNull())
    bounds = [F.lit(v).cast("double") for v in bounds]
    ranged = present.withColumn("__b", value_bucket(F.col("ret"), *bounds))
    count = F.count(F.lit(1)).alias("__c")
    counts = boxes.sums(boxes.cells(ranged, "__b", [], [count]), "__b", ["__c"])
    counts = counts.join(F.broadcast(chosen), "tag", "left_semi")
    # At most two places a quantile and tag.
    targets = stored(wanted_positions(counts, ["tag"], QUANTILES), few=True)
    near = ranged.join(F.broadcast(targets.select("__b").distinct()), "__b", "left_semi")
    values = boxes.placed(near, ["__b", "ret"]).groupBy("grid", "c1", "c2", "__b", "ret").agg(count)
    held = boxes.met(values, targets.select("tag", "__b").distinct())
    held = held.groupBy("tag", "__b", F.col("ret").alias("__q")).agg(F.sum("__c").alias("__c"))
    most = targets.agg(F.max("__c")).first()[0] or 0
    return picked_quantiles(held, F.broadcast(targets), ["tag"], QUANTILES, max_bucket_rows=int(most))


def _session_totals() -> list[Column]:
    """Aggregates over the sessions of a tag."""
    n = F.col("n").cast("double")
    seen = F.col("n") > 0
    return [
        F.sum("matched").alias("matched"),
        F.sum("n").alias("n"),
        F.sum("hits").alias("hits"),
        F.sum("s1").alias("s1"),
        F.sum("s2").alias("s2"),
        F.count_if(seen).alias("days"),
        F.sum(n * n).alias("day_sq"),
        F.max("n").alias("day_max"),
        F.bit_xor("x1").alias("x1"),
        F.bit_xor("x2").alias("x2"),
    ]


def rule_totals(by_session: DataFrame, over_entities: DataFrame) -> DataFrame:
    """One row per tag from the sums by session and those over entities."""
    return _joined_totals(by_session.groupBy("tag").agg(*_session_totals()), over_entities)


def _joined_totals(sessions: DataFrame, over_entities: DataFrame) -> DataFrame:
    rate = F.try_divide(F.col("hits"), F.col("n"))
    return sessions.join(over_entities, "tag", "left").withColumn("rate", rate)


def hac_long_run(
    influence: DataFrame, lag: int, sessions: Column, more: Sequence[Column] = ()
) -> DataFrame:
    """Bartlett-weighted long-run sum per ``tag`` from ``(tag, session_rank, x)``, and ``more``
    aggregates of its rows.

    Sessions without a row have zero influence and drop out of every product. The
    weighted sum over earlier sessions, Σ (1-(d-j)/(L+1))·x_j, is linear in j, so two
    range sums replace L lagged products. A tag has one row per session at most.
    """
    used = F.least(F.lit(max(0, lag)), sessions - 1)
    squares = F.sum(F.col("x") * F.col("x"))
    if lag <= 0:
        return influence.groupBy("tag").agg(squares.alias("long_run"), *more)
    back = Window.partitionBy("tag").orderBy(RANK).rangeBetween(-lag, -1)
    # With fewer sessions than lags the window already holds every earlier session.
    rank, width = F.col(RANK).cast("double"), used + 1
    level = F.sum("x").over(back)
    tilt = F.sum(F.col("x") * F.col(RANK)).over(back)
    earlier = (1 - rank / width) * level + tilt / width
    crossed = influence.withColumn("cross", F.coalesce(F.col("x") * earlier, F.lit(0.0)))
    return crossed.groupBy("tag").agg((squares + 2 * F.sum("cross")).alias("long_run"), *more)


def cluster_error(long_run: Column, clusters: Column) -> Column:
    return F.sqrt(cluster_variance(long_run, clusters))


def _rate_errors(
    by_session: DataFrame, over_entities: DataFrame, lag: int, sessions: Column
) -> DataFrame:
    """``rule_totals``, and per tag date-HAC and entity-cluster error of the hit rate, and its
    interval. Sessions of a tag meet once, for its rate, its residuals and its totals."""
    whole = {f"__{c}": F.sum(c).over(Window.partitionBy("tag")) for c in ("n", "hits")}
    rate = F.try_divide(F.col("__hits"), F.col("__n"))
    residual = (F.col("hits") - rate * F.col("n")) / F.col("__n")
    dated = by_session.withColumns(whole).withColumn("x", residual)
    wide = _joined_totals(hac_long_run(dated, lag, sessions, _session_totals()), over_entities)
    ent_long_run = entity_squares(F.col("rate"), F.col("n").cast("double"))
    error = F.greatest(
        cluster_error(F.col("long_run"), F.col("days")),
        cluster_error(F.coalesce(ent_long_run, F.lit(0.0)), F.col("entities")),
    )
    margin = Z_95_TWO_SIDED * F.col("error")
    day_low, day_high = wilson_bounds(F.col("rate"), F.col("eff_days"))
    ent_low, ent_high = wilson_bounds(F.col("rate"), F.col("eff_entities"))
    several = F.col("days") > 1
    total = F.col("n").cast("double")
    return (
        wide.withColumn("eff_days", kish_count(total, F.col("day_sq")))
        .withColumn("eff_entities", kish_count(total, F.col("nn")))
        .withColumn("error", F.when(several, error).otherwise(F.lit(0.0)))
        .withColumn(
            "low",
            F.when(
                several,
                F.least(F.greatest(F.col("rate") - margin, F.lit(0.0)), day_low, ent_low),
            ).otherwise(F.lit(0.0)),
        )
        .withColumn(
            "high",
            F.when(
                several,
                F.greatest(F.least(F.col("rate") + margin, F.lit(1.0)), day_high, ent_high),
            ).otherwise(F.lit(1.0)),
        )
        .drop("long_run")
    )


def _lift_errors(
    rules: DataFrame, by_session: DataFrame, totals: DataFrame, lag: int, sessions: Column
) -> DataFrame:
    """``(rule, lift_error)``: error of the rule's rate minus its baseline's rate.

    A selected row also belongs to the baseline, so the influence of a cluster is the
    difference a - b of the two residual sums.
    """
    picked = totals.select(
        F.col("tag").alias("rule"), F.col("rate").alias("p"), F.col("n").alias("total"), *PRODUCTS
    )
    base = totals.select(
        F.col("tag").alias("base"),
        F.col("rate").alias("pb"),
        F.col("n").alias("base_total"),
        F.col("days").alias("base_days"),
        F.col("entities").alias("base_entities"),
        *[F.col(c).alias(f"base_{c}") for c in ("nn", "nh", "hh")],
    )
    pairs = rules.select("rule", "base").join(picked, "rule").join(base, "base")
    own = F.coalesce((F.col("hits") - F.col("p") * F.col("n")) / F.col("total"), F.lit(0.0))
    other = (F.col("bhits") - F.col("pb") * F.col("bn")) / F.col("base_total")

    # Sessions: every baseline session of every rule (rules x calendar rows).
    selected = by_session.where(F.col("tag") >= 0).select(F.col("tag").alias("rule"), RANK, "hits", "n")
    whole = by_session.where((F.col("tag") < 0) & (F.col("n") > 0)).select(
        F.col("tag").alias("base"), RANK, F.col("hits").alias("bhits"), F.col("n").alias("bn")
    )
    dated = (
        F.broadcast(pairs.select("rule", "base", "p", "total", "pb", "base_total"))
        .join(whole, "base")
        .join(selected, ["rule", RANK], "left")
        .select(F.col("rule").alias("tag"), RANK, (own - other).alias("x"))
    )
    # A row per rule meets those of the rules, which are in one task.
    date_part = hac_long_run(dated, lag, sessions).withColumnRenamed("tag", "rule").repartition(1)
    # Entities: Σ(a-b)² = Σa² - 2Σab + Σb², from sums of products over the entities.
    p, pb, total, base_total = (F.col(c).cast("double") for c in ("p", "pb", "total", "base_total"))
    crossed = F.col("h_bh") - pb * F.col("h_bn") - p * F.col("n_bh") + p * pb * F.col("n_bn")
    mixed = entity_squares(p, total) - 2 * F.try_divide(crossed, total * base_total)
    base_sq = entity_squares(pb, base_total, "base_")
    wide = pairs.join(date_part, "rule").withColumn("ent_run", base_sq + F.coalesce(mixed, F.lit(0.0)))
    error = F.greatest(
        cluster_error(F.col("long_run"), F.col("base_days")),
        cluster_error(F.col("ent_run"), F.col("base_entities")),
    )
    usable = (F.col("total") > 0) & (F.col("base_days") > 1)
    return wide.select("rule", F.when(usable, error).otherwise(F.lit(0.0)).alias("lift_error"))


def _bounds(positive: Column, matched: Column, observed: Column) -> tuple[Column, Column]:
    """Hit rate if every unobserved outcome fails, and if every one succeeds."""
    low = F.coalesce(F.try_divide(positive, matched), F.lit(0.0))
    high = F.coalesce(F.try_divide(positive + matched - observed, matched), F.lit(1.0))
    return low, high


def rule_evidence(
    clean: DataFrame,
    rules: Sequence[tuple[int, Rule]],
    *,
    lag: int,
    target_return: float,
    gate: Column | None = None,
) -> DataFrame:
    """One evidence row per tagged rule.

    With ``gate``, a condition on the evidence, the quantiles of returns are worked out for the
    rules that meet it; those of other rules with observations are null.
    """
    sets = list(dict.fromkeys(rule.factors for _, rule in rules))
    boxes = rule_boxes(rules, sets)
    rows = [(tag, -(sets.index(rule.factors) + 1), rule.text) for tag, rule in rules]
    bases = {tag: base for tag, base, _ in rows}
    table = clean.sparkSession.createDataFrame(rows, "rule long, base long, formula string").coalesce(1)
    days = clean.groupBy(SESSION).agg(
        F.min("ret").alias("low"), F.max("ret").alias("high"), mean_size("ret").alias("size")
    )
    # Any scale serves: it only shapes the ranges of returns.
    sessions, *bounds = days.agg(F.count(F.lit(1)), F.min("low"), F.max("high"), F.avg("size")).first()
    evidence = stored(
        _evidence(clean, boxes, table, bases, F.lit(sessions), lag=lag, target_return=target_return),
        few=True,
    )
    chosen = evidence.where("sample_count > 0")
    if gate is not None:
        chosen = chosen.where(gate)
    spread = return_quantiles(clean, boxes, chosen.select(F.col("rule").alias("tag")), bounds)
    found = {name: F.when(F.col("sample_count") > 0, F.col(name)).otherwise(0.0) for name in QUANTILES}
    joined = evidence.join(F.broadcast(spread.withColumnRenamed("tag", "rule")), "rule", "left")
    shown = [c for c in evidence.columns]
    # Right after the mean, as the reports list them.
    at = shown.index("mean_return") + 1
    shown[at:at] = ["median_return", "return_p05"]
    return joined.withColumns(found).select(*shown)


def _evidence(
    clean: DataFrame,
    boxes: Boxes,
    rules: DataFrame,
    bases: Mapping[int, int],
    sessions: Column,
    *,
    lag: int,
    target_return: float,
) -> DataFrame:
    """Evidence without the quantiles. ``rules`` has ``rule`` (the tag), ``base`` (the tag of its
    factor set, in ``bases`` too), ``formula``."""
    calendar = broadcast_calendar(numbered_calendar(clean.select(SESSION).distinct()))
    # The sums by session are read several times, so they are written once.
    by_session = stored(sums_by_session(clean, boxes).join(calendar, SESSION).drop(SESSION))
    over_entities = sums_over_entities(clean, boxes, bases)
    totals = stored(_rate_errors(by_session, over_entities, lag, sessions), few=True)
    lift = _lift_errors(rules, by_session, totals, lag, sessions)
    own = totals.withColumnRenamed("tag", "rule")
    base = totals.select(
        F.col("tag").alias("base"),
        F.col("matched").alias("b_matched"),
        F.col("n").alias("b_n"),
        F.col("hits").alias("b_hits"),
        F.col("rate").alias("b_rate"),
        F.col("low").alias("b_low"),
        F.col("high").alias("b_high"),
    )
    wide = (
        rules.join(own, "rule", "left")
        .join(base, "base", "left")
        .join(lift, "rule", "left")
    )
    zero = {
        c: 0
        for c in ("matched n hits days entities b_matched b_n b_hits").split()
    }
    wide = wide.fillna(zero)
    n, matched = F.col("n"), F.col("matched")
    some = n > 0
    rate, b_rate = F.coalesce("rate", F.lit(0.0)), F.coalesce("b_rate", F.lit(0.0))
    lift_value = rate - b_rate
    mean = F.try_divide(F.col("s1"), n)
    variance = F.greatest(F.col("s2") / n - mean * mean, F.lit(0.0))
    low_o, high_o = _bounds(F.col("hits"), matched, n)
    b_low_o, b_high_o = _bounds(F.col("b_hits"), F.col("b_matched"), F.col("b_n"))
    low, high = F.least("low", low_o), F.greatest("high", high_o)
    b_low, b_high = F.least("b_low", b_low_o), F.greatest("b_high", b_high_o)
    margin = Z_95_TWO_SIDED * F.col("lift_error")
    lost = matched - n
    other_lost = F.col("b_matched") - F.col("b_n") - lost
    # A rule's rows are rows of its baseline, so neither side can lose less than nothing.
    beyond = F.raise_error(F.lit("a rule lacks more outcomes than its baseline")).cast("long")
    lost = F.when((lost < 0) | (other_lost < 0), beyond).otherwise(lost)
    robust_low = F.try_divide(F.col("hits"), matched) - F.try_divide(
        F.col("b_hits") + other_lost, F.col("b_matched")
    )
    robust_high = F.try_divide(F.col("hits") + lost, matched) - F.try_divide(
        F.col("b_hits") + lost, F.col("b_matched")
    )

    def when(value: Column, otherwise: float) -> Column:
        """The value for a rule with observations, else the documented default."""
        return F.when(some, value).otherwise(F.lit(otherwise))

    def ratio(top: Column, bottom: Column) -> Column:
        return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))

    return wide.select(
        "rule",
        "formula",
        n.alias("sample_count"),
        matched.alias("matched_sample_count"),
        F.col("b_matched").alias("eligible_sample_count"),
        ratio(matched, F.col("b_matched")).alias("rule_support_rate"),
        lost.alias("missing_outcome_count"),
        ratio(n, matched).alias("outcome_coverage_rate"),
        F.col("hits").alias("positive_count"),
        rate.alias("win_rate"),
        when(mean, 0.0).alias("mean_return"),
        when(F.sqrt(variance), 0.0).alias("return_std"),
        b_rate.alias("baseline_win_rate"),
        F.col("b_n").alias("baseline_sample_count"),
        ratio(F.col("b_n"), F.col("b_matched")).alias("baseline_outcome_coverage_rate"),
        when(lift_value, 0.0).alias("win_rate_lift"),
        when(robust_low, -1.0).alias("outcome_robust_lift_lower"),
        when(robust_high, 1.0).alias("outcome_robust_lift_upper"),
        when(
            F.greatest(F.least(lift_value - margin, low - b_high), F.lit(-1.0)), -1.0
        ).alias("lift_confidence_lower"),
        when(
            F.least(F.greatest(lift_value + margin, high - b_low), F.lit(1.0)), 1.0
        ).alias("lift_confidence_upper"),
        when(low, 0.0).alias("confidence_lower"),
        when(high, 1.0).alias("confidence_upper"),
        F.lit(float(target_return)).alias("target_return"),
        F.col("days").alias("trading_day_count"),
        when(F.col("eff_days"), 0.0).alias("effective_trading_day_count"),
        F.col("entities").alias("security_count"),
        when(F.col("eff_entities"), 0.0).alias("effective_security_count"),
        ratio(F.col("ent_max"), n).alias("max_security_event_share"),
        ratio(F.col("day_max"), n).alias("max_signal_date_event_share"),
        when(F.col("error"), 0.0).alias("cluster_standard_error"),
        when(F.col("lift_error"), 0.0).alias("lift_standard_error"),
        F.lit(lag).alias("dependence_lag_days"),
        "x1",
        "x2",
    )


def evaluate_rules(
    panel: DataFrame,
    formulas: Sequence[str],
    *,
    target_return: float = 0.0,
    lag: int = 0,
) -> DataFrame:
    """Evidence for each formula: one row per rule, in no particular order.

    ``panel`` has ``entity``, ``session``, ``forward_return`` and factors, and is
    scanned a fixed number of times whatever the number of rules.
    """
    rules = [make_rule(text, panel.columns) for text in formulas]
    clean = clean_panel(panel, sorted({f for r in rules for f in r.factors}), target_return)
    return rule_evidence(clean, list(enumerate(rules)), lag=lag, target_return=target_return)


def event_examples(
    panel: DataFrame, formulas: Sequence[str], *, count: int = EXAMPLES
) -> DataFrame:
    """The most recent selected rows of each rule with the values of its factors.

    Rows are cut to ``count`` per rule in every task before the shuffle.
    """
    rules = [make_rule(text, panel.columns) for text in formulas]
    factors = sorted({f for r in rules for f in r.factors})
    known = panel.withColumns({f: finite(panel, f) for f in factors}).where(
        finite(panel, "forward_return").isNotNull()
    )
    tags = F.array(
        *[
            F.when(
                F.expr(r.text),
                F.struct(
                    F.lit(i).alias("rule"),
                    F.lit(r.text).alias("formula"),
                    F.map_filter(
                        F.create_map(*[c for f in r.factors for c in (F.lit(f), F.col(f))]),
                        lambda _, v: v.isNotNull(),
                    ).alias("factor_values"),
                ),
            )
            for i, r in enumerate(rules)
        ]
    )
    future = ["future_session"] if "future_session" in panel.columns else []
    rows = known.select(
        F.explode(F.array_compact(tags)).alias("r"), SESSION, ENTITY, *future, "forward_return"
    ).select("r.*", SESSION, ENTITY, *future, "forward_return")
    newest = Window.partitionBy("rule").orderBy(F.desc(SESSION), ENTITY)
    return rows.withColumn("position", F.row_number().over(newest)).where(
        F.col("position") <= count
    )
