"""Interval and tail formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Standard normal quantiles.
Z_95_TWO_SIDED = 1.959963984540054
Z_95_ONE_SIDED = 1.6448536269514722


def kish_count(total: Column, squares: Column) -> Column:
    """Effective number of clusters, (Σn)²/Σn²; zero without observations."""
    return F.coalesce(F.try_divide(total * total, squares), F.lit(0.0))


def wilson_bounds(rate: Column, observations: Column) -> tuple[Column, Column]:
    """95% score interval of a rate for a possibly fractional number of observations."""
    z2 = Z_95_TWO_SIDED**2
    n = F.when(observations > 0, observations)
    centre = (rate + z2 / (2 * n)) / (1 + z2 / n)
    # Rounding may push a rate of 0 or 1 a hair outside; the variance is not negative.
    variance = F.greatest(rate * (1 - rate), F.lit(0.0)) / n + z2 / (4 * n * n)
    half = Z_95_TWO_SIDED * F.sqrt(variance) / (1 + z2 / n)
    low = F.coalesce(F.greatest(centre - half, F.lit(0.0)), F.lit(0.0))
    high = F.coalesce(F.least(centre + half, F.lit(1.0)), F.lit(1.0))
    return low, high


def cluster_variance(squares: Column, clusters: Column) -> Column:
    """Σx² with the finite-cluster factor G/(G-1); zero for fewer than two clusters."""
    factor = F.try_divide(clusters, clusters - 1)
    return F.when(clusters > 1, F.greatest(factor * squares, F.lit(0.0))).otherwise(F.lit(0.0))


def student_t_tail(t: Column, degrees: Column) -> Column:
    """Upper tail of Student's t for whole degrees of freedom.

    Uses the finite series in cos²θ with θ = atan(t/√ν) (Abramowitz and Stegun 26.7.3-4)
    as a fold over its ν/2 terms.
    """
    nu = degrees.cast("int")
    theta = F.atan(t / F.sqrt(nu.cast("double")))
    sine, cosine = F.sin(theta), F.cos(theta)
    odd = nu % 2 == 1
    # Term k multiplies the previous one by cos²θ·(2k-1)/(2k) for even ν and by
    # cos²θ·(2k)/(2k+1) for odd ν.
    terms = F.floor((nu - F.when(odd, 3).otherwise(2)) / 2).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(state: Column, k: Column) -> Column:
        ratio = F.when(odd, 2 * k / (2 * k + 1)).otherwise((2 * k - 1) / (2 * k))
        term = state["term"] * cosine * cosine * ratio
        return F.struct(term.alias("term"), (state["total"] + term).alias("total"))

    steps = F.when(terms >= 1, F.sequence(F.lit(1), terms)).otherwise(
        F.array().cast("array<int>")
    )
    series = F.aggregate(steps, start, step)["total"]
    within = F.when(nu == 1, 2 / F.lit(3.141592653589793) * theta).when(
        odd, 2 / F.lit(3.141592653589793) * (theta + sine * cosine * series)
    ).otherwise(sine * series)
    tail = F.greatest(F.least((1 - within) / 2, F.lit(1.0)), F.lit(0.0))
    return F.when((t <= 0) | (nu < 1), F.lit(0.5)).otherwise(tail)
