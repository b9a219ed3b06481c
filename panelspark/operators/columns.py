"""Projections and derived columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.semantics import (
    COMPARISONS,
    dtype,
    flag,
    number,
)


def select_fields(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    return df.select(*fields)


def rename_fields(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename columns; two columns may not end up with one name."""
    for field in names:
        dtype(df, field)
    result = [names.get(c, c) for c in df.columns]
    if len(set(result)) != len(result):
        raise ValueError("renamed fields collide")
    return df.withColumnsRenamed(dict(names))


def derive(
    df: DataFrame,
    output: str,
    field: str,
    arithmetic: str,
    *,
    right_field: str | None = None,
    value: float | None = None,
) -> DataFrame:
    """Arithmetic of a column with another column or a constant.

    A zero divisor anywhere fails the job; a missing operand gives a missing result.
    """
    if (right_field is None) == (value is None):
        raise ValueError("derive needs exactly one of right_field and value")
    if arithmetic == "constant_minus" and value is None:
        raise ValueError("constant_minus takes a constant")
    left = number(df, field)
    right = number(df, right_field) if right_field else F.lit(float(value))
    if arithmetic == "divide":
        if value == 0:
            raise ValueError("the constant divisor is zero")
        fail = F.raise_error(F.lit("a divisor is zero")).cast("double")
        guarded = F.when(right == 0, fail).otherwise(right)
        # The divisor is checked even where the dividend is missing.
        quotient = F.when(guarded.isNotNull(), left / guarded)
        return df.withColumn(output, quotient)
    results = {
        "add": lambda: left + right,
        "subtract": lambda: left - right,
        "multiply": lambda: left * right,
        "constant_minus": lambda: right - left,
    }
    if arithmetic not in results:
        raise ValueError(f"unknown arithmetic: {arithmetic}")
    return df.withColumn(output, results[arithmetic]())


def compare_fields(
    df: DataFrame, output: str, field: str, comparison: str, right_field: str
) -> DataFrame:
    """Numeric comparison of two columns; a missing side gives false (``ne``: true)."""
    test = COMPARISONS[comparison](number(df, field), number(df, right_field))
    return df.withColumn(output, F.coalesce(test, F.lit(comparison == "ne")))


def compare_scalar(
    df: DataFrame, output: str, field: str, comparison: str, value: object
) -> DataFrame:
    return df.withColumn(output, flag(df, field, comparison, value))


def coalesce_fields(df: DataFrame, output: str, fields: Sequence[str]) -> DataFrame:
    """First value that is not missing."""
    present = [
        F.when(~F.isnan(f), F.col(f)) if dtype(df, f).typeName() in ("double", "float") else F.col(f)
        for f in fields
    ]
    return df.withColumn(output, F.coalesce(*present))


def fill_constant(df: DataFrame, output: str, field: str, value: object) -> DataFrame:
    column = F.col(field)
    if dtype(df, field).typeName() in ("double", "float"):
        column = F.when(~F.isnan(column), column)
    return df.withColumn(output, F.coalesce(column, F.lit(value)))


def clip(
    df: DataFrame,
    output: str,
    field: str,
    *,
    lower: float | None = None,
    upper: float | None = None,
) -> DataFrame:
    """Bound a column; a missing value stays missing."""
    if lower is not None and upper is not None and lower > upper:
        raise ValueError("clip bounds are reversed")
    source = number(df, field)
    bounded = source
    if lower is not None:
        bounded = F.greatest(bounded, F.lit(float(lower)))
    if upper is not None:
        bounded = F.least(bounded, F.lit(float(upper)))
    return df.withColumn(output, F.when(source.isNotNull(), bounded))


def conditional_value(
    df: DataFrame,
    output: str,
    field: str,
    comparison: str,
    value: object,
    true_value: object,
    false_value: object,
) -> DataFrame:
    return df.withColumn(
        output,
        F.when(flag(df, field, comparison, value), F.lit(true_value)).otherwise(
            F.lit(false_value)
        ),
    )


def coerce_number(df: DataFrame, output: str, field: str) -> DataFrame:
    return df.withColumn(output, number(df, field))


def tag_format(df: DataFrame, field: str) -> DataFrame:
    """Record how to read a column (percent, ratio, plain) in its metadata."""
    style = "percent" if field.endswith("_pct") else "ratio" if field.endswith("_ratio") else "plain"
    return df.withColumn(field, F.col(field).alias(field, metadata={"value_format": style}))


__all__ = [
    "clip",
    "coalesce_fields",
    "coerce_number",
    "compare_fields",
    "compare_scalar",
    "conditional_value",
    "derive",
    "fill_constant",
    "rename_fields",
    "select_fields",
    "tag_format",
]
