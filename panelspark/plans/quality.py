"""Data-quality jobs. Each returns a small report of what it checked or found."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.semantics import COMPARISONS, flag, keep, key_join, missing, number
from panelspark.operators.aggregates import Agg, summarize
from panelspark.operators.joins import duplicate_keys
from panelspark.operators.layout import lay_out

RELATIVE, ABSOLUTE = 1e-9, 1e-12
COMPLETE_PARTITIONS = ({"lt", "eq", "gt"}, {"le", "gt"}, {"lt", "ge"})


def _stack(df: DataFrame, rows: Sequence[Sequence[Column]], names: Sequence[str]) -> DataFrame:
    """Turn a one-row frame into a report, one row per tuple of expressions."""
    structs = [F.struct(*[c.alias(n) for c, n in zip(row, names)]) for row in rows]
    return df.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


#: Parts of the rows whose aggregates are merged, so that nothing is worked out as in a summary.
PARTS = 64
_MERGED = {"sum": F.sum, "min": F.min, "max": F.max}


def _parts(agg: Agg, x: Column, here: Column, claimed: Column) -> dict[str, tuple[str, Column]]:
    """What an aggregate needs of each part of the rows, and how that merges."""
    n, total = ("sum", F.count(x)), ("sum", F.sum(x))
    if agg.level is not None:
        below, above = F.when(x < claimed, x), F.when(x > claimed, x)
        return {
            "n": n,
            "below": ("sum", F.count(below)),
            "at": ("sum", F.count_if(x == claimed)),
            "under": ("max", F.max(below)),
            "over": ("min", F.min(above)),
        }
    squares = {"within": ("sum", F.var_pop(x) * F.count(x)), "between": ("sum", F.sum(x) * F.avg(x))}
    return {
        "count": {"rows": ("sum", F.count_if(here))},
        "sum": {"s": total},
        "mean": {"s": total, "n": n},
        "std": {"s": total, "n": n, **squares},
        "min": {"turned": ("max", F.max(-x))},
        "max": {"turned": ("min", F.min(-x))},
    }[agg.function]


def _expected(agg: Agg, part: Callable[[str], Column], claimed: Column) -> Column:
    """The aggregate from its merged parts."""
    if agg.function == "count":
        return F.coalesce(part("rows"), F.lit(0)).cast("double")
    if agg.function == "sum":
        return F.coalesce(part("s"), F.lit(0.0))
    if agg.function == "mean":
        return F.try_divide(part("s"), part("n"))
    if agg.function in ("min", "max"):
        return -part("turned")
    if agg.function == "std":
        # Spread within the parts plus spread between their means.
        spread = part("within") + part("between") - part("s") * part("s") / part("n")
        return F.when(part("n") > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / (part("n") - 1)))
    # A claimed quantile is right if the wanted positions lie among the values equal to it, or
    # if it lies where it should between the values beside it.
    position = (part("n") - 1) * F.lit(agg.level)
    low, high = F.floor(position), F.ceil(position)
    first, last = part("below"), part("below") + part("at") - 1

    def between(a: Column, b: Column) -> Column:
        return a + (b - a) * (position - low)

    return (
        F.when((first <= low) & (high <= last), claimed)
        .when((part("at") == 0) & (first == low + 1), between(part("under"), part("over")))
        .when((part("at") > 0) & (low == last), between(claimed, part("over")))
        .when((part("at") > 0) & (high == first), between(part("under"), claimed))
    )


def _apart(df: DataFrame, agg: Agg, order_by: Sequence[str]) -> Column:
    """What does not merge from parts: distinct values, and first and last rows."""
    present = df.where(~missing(df, agg.field))
    if agg.function == "count_distinct":
        return present.groupBy(agg.field).count().agg(F.count(F.lit(1))).scalar().cast("double")
    direction = F.asc if agg.function == "first" else F.desc
    edge = present.orderBy(*[direction(c) for c in order_by]).limit(1)
    return edge.select(number(edge, agg.field)).scalar()


def check_summary(
    df: DataFrame, aggs: Sequence[Agg], *, order_by: Sequence[str] = ()
) -> DataFrame:
    """Every summary value against an independent calculation of it.

    One pass over the rows serves all aggregates that merge: sums and counts per part, spread
    within and between parts, and for quantiles the counts below and at the claimed value.
    """
    summary = summarize(df, aggs, order_by=order_by)
    merged = {i: a for i, a in enumerate(aggs) if a.function not in ("count_distinct", "first", "last")}
    claims = {i: f"__q{i}" for i, a in merged.items() if a.level is not None}
    rows = df.withColumns({c: summary.select(aggs[i].output).scalar().cast("double") for i, c in claims.items()})
    rows = rows.withColumn("__part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)))
    needed = {
        f"__p{i}_{name}": part
        for i, a in merged.items()
        for name, part in _parts(a, number(df, a.field), ~missing(df, a.field), F.col(claims.get(i, "__part"))).items()
    }
    parts = rows.groupBy("__part").agg(*[column.alias(n) for n, (_, column) in needed.items()])
    wide = summary
    if needed:
        whole = F.struct(*[_MERGED[how](n).alias(n) for n, (how, _) in needed.items()])
        wide = summary.withColumn("__whole", parts.agg(whole.alias("whole")).scalar())
    report = []
    for i, agg in enumerate(aggs):
        actual = F.col(agg.output).cast("double")
        if i in merged:
            expected = _expected(agg, lambda name, i=i: F.col(f"__whole.__p{i}_{name}"), actual)
        else:
            expected = _apart(df, agg, order_by)
        close = F.abs(actual - expected) <= F.greatest(
            F.lit(RELATIVE) * F.greatest(F.abs(actual), F.abs(expected)), F.lit(ABSOLUTE)
        )
        ok = (actual.isNull() & expected.isNull()) | F.coalesce(close, F.lit(False))
        report.append((F.lit(agg.output), actual, expected, ok))
    return _stack(wide, report, ["output", "actual", "expected", "ok"])


def check_indicator(
    df: DataFrame, indicators: Mapping[str, tuple[str, str, object]]
) -> DataFrame:
    """Rows whose stored flag differs from its definition, per flag."""
    counts = df.agg(
        *[
            F.count_if(
                F.coalesce(F.col(output).cast("boolean"), F.lit(False))
                != flag(df, field, comparison, value)
            ).alias(output)
            for output, (field, comparison, value) in indicators.items()
        ]
    )
    return _stack(counts, [(F.lit(o), F.col(o)) for o in indicators], ["output", "mismatches"])


def check_partition(
    df: DataFrame, field: str, value: float, comparisons: Sequence[str]
) -> DataFrame:
    """Do the counts of a complete set of comparisons add up to the non-null count?"""
    if set(comparisons) not in COMPLETE_PARTITIONS:
        raise ValueError("the comparisons do not cover every value exactly once")
    x = number(df, field)
    total = reduce(
        lambda a, b: a + b,
        [F.count_if(F.coalesce(COMPARISONS[c](x, F.lit(float(value))), F.lit(False))) for c in comparisons],
    )
    return df.agg(total.alias("categories"), F.count(x).alias("valid_samples")).withColumn(
        "ok", F.col("categories") == F.col("valid_samples")
    )


def check_filter(df: DataFrame, field: str, comparison: str, value: object) -> DataFrame:
    """Rows that no longer satisfy a filter applied earlier."""
    holds = F.coalesce(keep(df, field, comparison, value), F.lit(False))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~holds).alias("violations"))


def check_ranking(
    df: DataFrame,
    field: str,
    *,
    position: str,
    limit: int,
    direction: str = "desc",
    entity: str | None = None,
    session: str | None = None,
) -> DataFrame:
    """Invariants of a ranking: one row with a count of violations of each kind.

    Order is checked on all rows, however many there are beyond ``limit``.
    """
    x = number(df, field)
    infinite = F.abs(x) == float("inf")
    report = df.agg(
        F.greatest(F.count(F.lit(1)) - limit, F.lit(0)).alias("rows_over_limit"),
        (
            F.count(entity) - F.count_distinct(F.col(entity)) if entity else F.lit(0).cast("long")
        ).alias("duplicate_entities"),
        (
            F.greatest(F.count_distinct(F.col(session)) - 1, F.lit(0))
            if session
            else F.lit(0).cast("long")
        ).alias("extra_sessions"),
        F.count_if(x.isNull()).alias("missing_values"),
        F.count_if(F.coalesce(infinite, F.lit(False))).alias("infinite_values"),
    )
    rows = lay_out(df.select(x.alias("x"), position), [], [F.col(position)])
    beside = rows.framed(lambda window: {"__before": F.lag("x").over(window)}, back=1)
    wrong = F.col("x") > F.col("__before") if direction == "desc" else F.col("x") < F.col("__before")
    disorder = beside.select(F.coalesce(wrong, F.lit(False)).alias("w")).agg(F.count_if("w"))
    return report.withColumn("out_of_order", disorder.scalar())


def check_degenerate(df: DataFrame, value: str, start: str, end: str) -> DataFrame:
    """Flag a ranking whose values are all equal because start and end are the same."""
    x = number(df, value)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(x).alias("distinct_values"),
        F.count_if(~F.col(start).eqNullSafe(F.col(end))).alias("moved"),
    ).withColumn(
        "degenerate",
        (F.col("rows") >= 2) & (F.col("distinct_values") == 1) & (F.col("moved") == 0),
    )


def check_completeness(
    expected: DataFrame, observed: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """One row: are all expected partitions present? complete, partial or unknown."""
    seen = observed.select(*keys).distinct().withColumn("__seen", F.lit(1))
    joined = key_join(expected.select(*keys).distinct(), seen, keys, "left", ["__seen"])
    return _completeness(
        joined.agg(F.count(F.lit(1)).alias("expected"), F.count("__seen").alias("present"))
    )


def check_panel_completeness(
    entities: DataFrame, sessions: DataFrame, observed: DataFrame, entity: str, session: str
) -> DataFrame:
    """The same for every entity on every session, by counts: the pairs that are expected are
    never made."""
    entities, sessions = entities.select(entity).distinct(), sessions.select(session).distinct()
    expected = entities.agg(F.count(F.lit(1)).alias("n")).select(
        F.col("n").alias("__entities")
    ).withColumn("__sessions", sessions.agg(F.count(F.lit(1))).scalar())
    seen = key_join(observed.select(entity, session).distinct(), entities, [entity], "left_semi")
    present = key_join(seen, sessions, [session], "left_semi").agg(F.count(F.lit(1))).scalar()
    return _completeness(
        expected.select(
            (F.col("__entities") * F.col("__sessions")).alias("expected"), present.alias("present")
        )
    )


def _completeness(counted: DataFrame) -> DataFrame:
    return counted.withColumn("missing", F.col("expected") - F.col("present")).withColumn(
        "status",
        F.when(F.col("expected") == 0, "unknown")
        .when(F.col("missing") == 0, "complete")
        .otherwise("partial"),
    )


def worst_status(reports: Sequence[DataFrame]) -> DataFrame:
    """Combine reports: partial if any is, complete only if all are, else unknown."""
    stacked = reduce(lambda a, b: a.unionByName(b), [r.select("status") for r in reports])
    return stacked.agg(
        F.when(F.count_if(F.col("status") == "partial") > 0, "partial")
        .when(F.count_if(F.col("status") != "complete") == 0, "complete")
        .otherwise("unknown")
        .alias("status")
    )


def check_saturation(df: DataFrame, keys: Sequence[str], cap: int) -> DataFrame:
    """Row count per partition, flagging those that reach the source's row cap."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("saturated", F.col("rows") >= cap)
    )


def check_unique_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return duplicate_keys(df, keys)
