"""Search for one- and two-condition threshold rules with hold-out validation.

Row-level work is Spark jobs over the panel: thresholds, cells, evidence. What comes
back to the driver is bounded by the factor list, not by the data: at most 54 factors x
10 thresholds x 2 directions, and a pairing pool of twice the number of factors.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.statistics import Z_95_ONE_SIDED, student_t_tail
from panelspark.operators.quantiles import exact_quantiles
from panelspark.plans import rules as R
from panelspark.plans.panel import (
    CALENDAR_FACTOR,
    FACTORS,
    SESSION,
    factor_coverage,
    purge_overlap,
    research_dataset,
)
from panelspark.session import stored
from panelspark.sources.reads import parse_day

# Fixed values of the search policy.
QUANTILES = (0.10, 0.25, 0.50, 0.75, 0.90)
MAX_DISCRETE = 10
POOL_LIMIT = 2 * len(FACTORS)
PER_DIRECTION = 2
SHORTLIST = 50
MAX_Q_VALUE = 0.10
MIN_SIGNIFICANCE_DAYS = 20
LEADERBOARD = 10


@dataclass(frozen=True)
class Gates:
    """Evidence a rule needs in a window."""

    samples: int = 30
    days: int = 20
    entities: int = 10
    coverage: float = 0.95

    def enough(self) -> Column:
        return (
            (F.col("sample_count") >= self.samples)
            & (F.col("trading_day_count") >= self.days)
            & (F.col("effective_trading_day_count") >= self.days)
            & (F.col("security_count") >= self.entities)
            & (F.col("effective_security_count") >= self.entities)
        )

    def covered(self) -> Column:
        return (F.col("outcome_coverage_rate") >= self.coverage) & (
            F.col("baseline_outcome_coverage_rate") >= self.coverage
        )


@dataclass(frozen=True)
class Study:
    """Arguments of a rule-discovery study."""

    train_start: str
    train_end: str
    val_start: str
    val_end: str
    factors: tuple[str, ...]
    horizon: int = 20
    target_return_pct: float = 0.0
    minimum_samples: int = 30
    minimum_days: int = 20
    minimum_entities: int = 10
    minimum_coverage_pct: float = 95.0
    max_conditions: int = 2
    session_days: int = CALENDAR_FACTOR

    def __post_init__(self) -> None:
        dates = [parse_day(d) for d in (self.train_start, self.train_end, self.val_start, self.val_end)]
        if dates[0] > dates[1] or dates[2] > dates[3] or dates[2] <= dates[1]:
            raise ValueError("the windows must be ordered and must not overlap")
        limits = {
            "horizon": (self.horizon, 1, 60),
            "target_return_pct": (self.target_return_pct, -100, 1000),
            "minimum_samples": (self.minimum_samples, 5, 10_000),
            "minimum_days": (self.minimum_days, 2, 1000),
            "minimum_entities": (self.minimum_entities, 2, 1000),
            "minimum_coverage_pct": (self.minimum_coverage_pct, 50, 100),
            "max_conditions": (self.max_conditions, 1, 2),
        }
        for name, (value, low, high) in limits.items():
            if not low <= value <= high:
                raise ValueError(f"{name} must be between {low} and {high}")
        if max(self.minimum_days, self.minimum_entities) > self.minimum_samples:
            raise ValueError("minimum days and entities cannot exceed minimum samples")
        if not self.factors or len(set(self.factors)) != len(self.factors):
            raise ValueError("factors must be given once each")
        unknown = sorted(set(self.factors) - set(FACTORS))
        if unknown:
            raise ValueError("unsupported factors: " + ", ".join(unknown))

    @property
    def gates(self) -> Gates:
        return Gates(
            self.minimum_samples,
            self.minimum_days,
            self.minimum_entities,
            self.minimum_coverage_pct / 100,
        )


@dataclass(frozen=True)
class Condition:
    factor: str
    operator: str
    threshold: float
    source: str

    @property
    def text(self) -> str:
        return f"{self.factor} {self.operator} {self.threshold:.10g}"

    @property
    def rule(self) -> R.Rule:
        return R.Rule(self.text, (self.factor,), ((self.factor, self.operator, self.threshold),))


def search_thresholds(clean: DataFrame, factors: Sequence[str]) -> DataFrame:
    """``(factor, threshold, source)``: every value of a discrete factor, else quantiles.

    A first pass sketches distinct counts. A factor with at most ten values cannot
    sketch above 50, so only factors below that are counted exactly, on sets that
    collapse before the shuffle.
    """
    names = sorted(factors)
    sketch = clean.agg(*[F.approx_count_distinct(f).alias(f) for f in names]).first()
    maybe = [f for f in names if 0 < sketch[f] <= 50]
    spark = clean.sparkSession
    exact: dict[str, list[float]] = {}
    if maybe:
        long = clean.select(*maybe).unpivot([], maybe, "factor", "value").where("value IS NOT NULL")
        for row in long.distinct().collect():  # a few dozen values per factor
            exact.setdefault(row["factor"], []).append(row["value"])
    discrete = {f: sorted(v) for f, v in exact.items() if len(v) <= MAX_DISCRETE}
    rows = [
        (f, v, "observed_value") for f, values in discrete.items() if len(values) > 1 for v in values
    ]
    table = spark.createDataFrame(rows, "factor string, threshold double, source string")
    rest = [f for f in names if f not in discrete and sketch[f] > 0]
    if rest:
        long = clean.select(*rest).unpivot([], rest, "factor", "value")
        levels = {f"q{i}": q for i, q in enumerate(QUANTILES)}
        wide = exact_quantiles(long, ["factor"], F.col("value"), levels)
        found = wide.unpivot(["factor"], list(levels), "level", "threshold")
        table = table.unionByName(
            found.select("factor", "threshold", F.lit("quantile").alias("source"))
        )
    return table


def raw_conditions(thresholds: DataFrame) -> list[Condition]:
    """Both directions of every threshold, in a canonical order.

    The threshold is the ten-digit text it is written with, so a formula selects the
    same rows wherever it is evaluated.
    """
    rows = sorted((r["factor"], r["threshold"], r["source"]) for r in thresholds.collect())
    return [
        Condition(factor, operator, float(f"{value:.10g}"), source)
        for name in dict.fromkeys(r[0] for r in rows)
        for operator in ("<=", ">=")
        for factor, value, source in rows
        if factor == name
    ]


def single_evidence(
    clean: DataFrame,
    conditions: Sequence[Condition],
    lag: int,
    target: float,
    gate: Column | None = None,
) -> DataFrame:
    """Evidence of single conditions; ``rule`` is the index of the condition."""
    rules = [(i, c.rule) for i, c in enumerate(conditions)]
    return R.rule_evidence(clean, rules, lag=lag, target_return=target, gate=gate)


def distinct_conditions(evidence: DataFrame, conditions: Sequence[Condition]) -> DataFrame:
    """Drop conditions that select nothing or every known row, and repeats in a factor."""
    names = evidence.sparkSession.createDataFrame(
        [(i, c.factor, c.operator, c.source) for i, c in enumerate(conditions)],
        "rule long, factor string, operator string, source string",
    ).coalesce(1)
    useful = evidence.join(names, "rule").where(
        (F.col("matched_sample_count") > 0)
        & (F.col("matched_sample_count") < F.col("eligible_sample_count"))
    )
    same = Window.partitionBy("factor", "matched_sample_count", "x1", "x2").orderBy("rule")
    return useful.withColumn("__rn", F.row_number().over(same)).where("__rn = 1").drop("__rn")


def rank_keys() -> list[Column]:
    """Conservative lift, then downside tail, then median; the rule id breaks ties."""
    return [
        F.desc("lift_confidence_lower"),
        F.desc("return_p05"),
        F.desc("median_return"),
        F.asc("rule"),
    ]


def pairing_pool(singles: DataFrame) -> DataFrame:
    """The conditions to combine, ``place`` giving their order.

    First the best condition of every factor, then the best in each other direction,
    then the second best per direction, each in rank order, up to the pool limit.
    """
    by_factor = Window.partitionBy("factor").orderBy(*rank_keys())
    by_direction = Window.partitionBy("factor", "operator").orderBy(*rank_keys())
    wave = (
        F.when(F.row_number().over(by_factor) == 1, 1)
        .when(F.row_number().over(by_direction) == 1, 2)
        .when(F.row_number().over(by_direction) <= PER_DIRECTION, 3)
    )
    chosen = singles.withColumn("wave", wave).where(F.col("wave").isNotNull())
    return chosen.orderBy("wave", *rank_keys()).limit(POOL_LIMIT).select("wave", "rule", *[
        c for c in singles.columns if c != "rule"
    ])


def compatible(a: Condition, b: Condition) -> bool:
    """Different factors, or an interval of one factor that is not empty."""
    if a.factor != b.factor:
        return True
    if a.operator == b.operator:
        return False
    low, high = (a, b) if a.operator == ">=" else (b, a)
    return low.threshold <= high.threshold


def pair_rule(a: Condition, b: Condition) -> R.Rule:
    factors = tuple(sorted({a.factor, b.factor}))
    return R.Rule(f"({a.text}) and ({b.text})", factors, a.rule.conditions + b.rule.conditions)


def search_pairs(
    clean: DataFrame,
    pool: Sequence[Condition],
    first_tag: int,
    lag: int,
    target: float,
    gate: Column | None = None,
) -> tuple[DataFrame, int]:
    """Evidence of every compatible pair, and how many pairs there are. The tag of a pair is
    ``first_tag + a * len(pool) + b`` with ``a < b``."""
    pairs = [
        (first_tag + i * len(pool) + j, a, b)
        for (i, a), (j, b) in combinations(enumerate(pool), 2)
        if compatible(a, b)
    ]
    sources = [(tag, a.source if a.source == b.source else "mixed") for tag, a, b in pairs]
    table = clean.sparkSession.createDataFrame(sources, "rule long, source string").coalesce(1)
    rules = [(tag, pair_rule(a, b)) for tag, a, b in pairs]
    evidence = R.rule_evidence(clean, rules, lag=lag, target_return=target, gate=gate)
    return evidence.join(table, "rule"), len(pairs)


def training_rank(candidates: DataFrame) -> DataFrame:
    """Rules with a positive lift that no missing outcome could undo, one per cohort.

    Rules that select the same training rows have the same count and fingerprint; the
    best-ranked one stays.
    """
    strong = candidates.where(
        (F.col("win_rate_lift") > 0) & (F.col("outcome_robust_lift_lower") > 0)
    )
    cohort = Window.partitionBy("matched_sample_count", "x1", "x2").orderBy(*rank_keys())
    return strong.withColumn("__rn", F.row_number().over(cohort)).where("__rn = 1").drop("__rn")


def shortlist(ranked: DataFrame, top_n: int) -> DataFrame:
    """The frozen head of the training ranking, with its position ``place`` from 1."""
    head = ranked.orderBy(*rank_keys()).limit(max(top_n, SHORTLIST))
    return head.withColumn("place", F.row_number().over(Window.orderBy(*rank_keys())))


def rule_p_value(gates: Gates) -> Column:
    """One-sided Student-t tail of the validation lift; 1 without enough evidence."""
    score = F.try_divide(F.col("win_rate_lift"), F.col("lift_standard_error"))
    degrees = F.floor("effective_trading_day_count").cast("int") - 1
    usable = (
        gates.enough()
        & gates.covered()
        & (F.col("effective_trading_day_count") >= MIN_SIGNIFICANCE_DAYS)
        & (F.col("win_rate_lift") > 0)
        & (F.col("lift_standard_error") > 0)
    )
    return F.when(usable, student_t_tail(score, degrees)).otherwise(F.lit(1.0))


def with_q_value(df: DataFrame, p: str, output: str) -> DataFrame:
    """Benjamini-Yekutieli q-values over the whole frame, a shortlist of tested rules."""
    family = F.count(F.lit(1)).over(Window.partitionBy())
    penalty = F.aggregate(
        F.sequence(F.lit(1), F.col("__family").cast("int")),
        F.lit(0.0),
        lambda total, k: total + 1 / k,
    )
    ascending = Window.orderBy(p)
    # Tied p-values share the largest rank, which gives them the smallest raw value.
    rank = F.count(F.lit(1)).over(ascending.rangeBetween(Window.unboundedPreceding, 0))
    raw = F.col(p) * F.col("__family") * penalty / rank
    onward = ascending.rangeBetween(0, Window.unboundedFollowing)
    return (
        df.withColumn("__family", family)
        .withColumn("__raw", raw)
        .withColumn(output, F.least(F.min("__raw").over(onward), F.lit(1.0)))
        .drop("__raw", "__family")
    )


def validation_reason(gates: Gates) -> Column:
    """The first gate a rule fails; training columns carry the prefix ``train_``."""
    # The names of the outcomes, in the order in which they are looked at.
    thin = F.col("outcome_coverage_rate") < gates.coverage
    thin_base = F.col("baseline_outcome_coverage_rate") < gates.coverage
    checks = [
        (F.col("train_win_rate_lift") <= 0, "training_lift_not_positive"),
        (F.col("train_outcome_robust_lift_lower") <= 0, "training_outcome_attrition_not_robust"),
        ((F.col("matched_sample_count") > 0) & thin, "insufficient_validation_coverage"),
        (
            (F.col("eligible_sample_count") > 0) & thin_base,
            "insufficient_validation_baseline_coverage",
        ),
        (F.col("sample_count") < gates.samples, "insufficient_validation_samples"),
        (F.col("trading_day_count") < gates.days, "insufficient_validation_days"),
        (
            F.col("effective_trading_day_count") < gates.days,
            "insufficient_validation_effective_days",
        ),
        (F.col("security_count") < gates.entities, "insufficient_validation_securities"),
        (
            F.col("effective_security_count") < gates.entities,
            "insufficient_validation_effective_securities",
        ),
        (thin, "insufficient_validation_coverage"),
        (thin_base, "insufficient_validation_baseline_coverage"),
        (F.col("win_rate_lift") <= 0, "validation_lift_not_positive"),
        (F.col("outcome_robust_lift_lower") <= 0, "validation_outcome_attrition_not_robust"),
        (
            F.col("effective_trading_day_count") < MIN_SIGNIFICANCE_DAYS,
            "insufficient_significance_days",
        ),
        (F.col("q_value") > MAX_Q_VALUE, "fdr_not_passed"),
    ]
    reason = F.when(checks[0][0], checks[0][1])
    for failed, name in checks[1:]:
        reason = reason.when(failed, name)
    return reason.otherwise("passed")


KEPT = (
    "win_rate win_rate_lift lift_standard_error outcome_robust_lift_lower "
    "lift_confidence_lower rule_support_rate sample_count return_p05 median_return"
).split()


def validate(
    chosen: DataFrame, validation: DataFrame, gates: Gates, *, lag: int, target: float
) -> DataFrame:
    """Validation evidence, scores, p- and q-values and the verdict of a shortlist.

    The training order is never changed.
    """
    picked = chosen.orderBy("place").collect()  # at most the shortlist size
    if not picked:
        raise ValueError(
            "no rule has a robust positive training lift with enough samples, days, "
            "entities and outcome coverage"
        )
    words = {w for r in picked for w in re.findall(r"[A-Za-z_]\w*", r["formula"])}
    names = sorted(words - {"and"})
    # A factor may be absent from the whole validation window; the rule then fails its
    # gates instead of stopping the study.
    padded = validation.withColumns(
        {n: F.lit(None).cast("double") for n in names if n not in validation.columns}
    )
    tested = R.evaluate_rules(
        padded, [r["formula"] for r in picked], target_return=target, lag=lag
    )
    train = chosen.select(
        "formula", "place", "source", *[F.col(c).alias(f"train_{c}") for c in KEPT]
    )
    gap = F.abs(F.col("train_win_rate_lift") - F.col("win_rate_lift"))
    joined = (
        train.join(tested, "formula")
        .withColumn("generalization_gap", gap)
        .withColumn(
            "support_rate_gap",
            F.abs(F.col("train_rule_support_rate") - F.col("rule_support_rate")),
        )
        .withColumn(
            "support_retention_ratio",
            F.coalesce(
                F.try_divide(F.col("rule_support_rate"), F.col("train_rule_support_rate")),
                F.lit(0.0),
            ),
        )
        .withColumn(
            "validation_score",
            F.col("win_rate_lift") - Z_95_ONE_SIDED * F.col("lift_standard_error") - gap,
        )
        .withColumn("p_value", rule_p_value(gates))
    )
    judged = with_q_value(stored(joined, few=True), "p_value", "q_value").withColumn(
        "validation_reason", validation_reason(gates)
    )
    return judged.withColumn(
        "validation_passed", F.col("validation_reason") == "passed"
    ).drop("x1", "x2", "rule")


@dataclass(frozen=True)
class Found:
    """Tables of one search: single rules, all candidates, shortlist; pairs tried."""

    singles: DataFrame
    candidates: DataFrame
    shortlist: DataFrame
    evaluated: int


def search_training(
    train: DataFrame,
    factors: Sequence[str],
    gates: Gates,
    *,
    max_conditions: int = 2,
    top_n: int = LEADERBOARD,
    lag: int = 0,
    target: float = 0.0,
) -> Found:
    """Everything that looks only at the training window."""
    clean = stored(R.clean_panel(train, sorted(factors), target))
    conditions = raw_conditions(search_thresholds(clean, factors))
    if not conditions:
        raise ValueError("no factor has two distinct values in the training window")
    # Ranks need the quantiles of returns, and only of rules with enough evidence.
    raw = single_evidence(clean, conditions, lag, target, gates.enough())
    tried = stored(distinct_conditions(raw, conditions), few=True)
    evaluated = tried.count()
    # Coverage does not gate the pairing pool: a weak single may still combine well.
    pairable = tried.where(gates.enough())
    singles = pairable.where(gates.covered())
    shape = [c for c in tried.columns if c not in ("factor", "operator")]
    candidates = singles.select(*shape)
    if max_conditions >= 2:
        pool = [conditions[r["rule"]] for r in pairing_pool(pairable).select("rule").collect()]
        if len(pool) > 1:
            passed = gates.enough() & gates.covered()
            pairs, count = search_pairs(clean, pool, len(conditions), lag, target, passed)
            evaluated += count
            kept = pairs.where(passed)
            candidates = candidates.unionByName(kept.select(*shape))
    candidates = stored(candidates, few=True)
    chosen = shortlist(training_rank(candidates), top_n)
    return Found(singles, candidates, chosen, evaluated)


def search_rules(
    train: DataFrame,
    validation: DataFrame,
    factors: Sequence[str],
    gates: Gates,
    *,
    max_conditions: int = 2,
    top_n: int = LEADERBOARD,
    lag: int = 0,
    target: float = 0.0,
) -> DataFrame:
    """The leaderboard: the first ``top_n`` rules of the frozen training order with
    their validation verdicts."""
    found = search_training(
        train, factors, gates, max_conditions=max_conditions, top_n=top_n, lag=lag, target=target
    )
    judged = validate(found.shortlist, validation, gates, lag=lag, target=target)
    return judged.where(F.col("place") <= top_n)


def discovery_study(
    panel: DataFrame, sessions: DataFrame, study: Study, *, top_n: int = LEADERBOARD
) -> tuple[DataFrame, DataFrame]:
    """Build both windows, purge the overlap, search and validate.

    ``panel`` comes from ``assemble``. Returns the leaderboard and the factor coverage
    of both windows.
    """
    factors = list(study.factors)
    windows = {
        "train": (study.train_start, study.train_end),
        "validation": (study.val_start, study.val_end),
    }
    data = {
        name: research_dataset(
            panel,
            sessions,
            start,
            end,
            horizon=study.horizon,
            factors=factors,
            session_days=study.session_days,
        )
        for name, (start, end) in windows.items()
    }
    train = stored(purge_overlap(data["train"], study.val_start))
    validation = stored(data["validation"])
    board = search_rules(
        train,
        validation,
        factors,
        study.gates,
        max_conditions=study.max_conditions,
        top_n=top_n,
        lag=study.horizon - 1,
        target=study.target_return_pct / 100,
    )
    coverage = (
        factor_coverage(train, factors)
        .withColumn("window", F.lit("train"))
        .unionByName(
            factor_coverage(validation, factors).withColumn("window", F.lit("validation"))
        )
    )
    return board, coverage
