"""Membership and lookup joins with checked cardinality.

A null key matches a null key unless ``null_keys=False`` says there are none.
No side is broadcast by hint: Spark broadcasts by measured size, and otherwise splits
skewed partitions of the sort-merge join at run time.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.functions.semantics import dtype, key_join

LEFT_REPEATS = "duplicate keys on the left of a one_to_one join"
CARDINALITIES = ("one_to_one", "many_to_one", "many_to_many")


def _distinct_keys(right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct key tuples: duplicates of a hot key disappear before the shuffle."""
    for key in keys:
        dtype(right, key)
    return right.select(*keys).distinct()


def match_source(
    df: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    output: str,
    *,
    null_keys: bool = True,
) -> DataFrame:
    """Add a boolean: does the key tuple occur in ``right``?"""
    if output in df.columns:
        raise ValueError(f"output field already exists: {output}")
    members = _distinct_keys(right, keys).withColumn("__hit", F.lit(True))
    return (
        key_join(df, members, keys, "left", ["__hit"], null_keys=null_keys)
        .withColumn(output, F.coalesce("__hit", F.lit(False)))
        .drop("__hit")
    )


exists_in_source = match_source


def semi_join(
    df: DataFrame, right: DataFrame, keys: Sequence[str], *, null_keys: bool = True
) -> DataFrame:
    return key_join(df, _distinct_keys(right, keys), keys, "left_semi", null_keys=null_keys)


def anti_join(
    df: DataFrame, right: DataFrame, keys: Sequence[str], *, null_keys: bool = True
) -> DataFrame:
    return key_join(df, _distinct_keys(right, keys), keys, "left_anti", null_keys=null_keys)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key tuples that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def checked_unique(df: DataFrame, keys: Sequence[str], message: str) -> DataFrame:
    """``df``, failing when the job runs if it repeats a key tuple.

    The check numbers the rows of a key where a join on the keys needs them anyway: it costs
    that join's exchange and sort, and nothing besides. A repeated key fails at its second row.
    """
    numbered = Window.partitionBy(*keys).orderBy(*keys)
    fail = F.raise_error(F.lit(message)).cast("boolean")
    nth = df.withColumn("__nth", F.row_number().over(numbered))
    return nth.where(F.when(F.col("__nth") > 1, fail).otherwise(True)).drop("__nth")


def _right_columns(
    df: DataFrame, right: DataFrame, keys: Sequence[str], fields: Mapping[str, str]
) -> DataFrame:
    for key in keys:
        dtype(df, key)
        dtype(right, key)
    for field, output in fields.items():
        dtype(right, field)
        if output in df.columns:
            raise ValueError(f"output field already exists: {output}")
    return right.select(*keys, *[F.col(f).alias(o) for f, o in fields.items()])


def _joined(
    df: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    fields: Mapping[str, str],
    cardinality: str,
    how: str,
    null_keys: bool,
) -> DataFrame:
    if cardinality not in CARDINALITIES:
        raise ValueError(f"unknown cardinality: {cardinality}")
    lookup = _right_columns(df, right, keys, fields)
    outputs = list(fields.values())
    if cardinality == "many_to_many":
        return key_join(df, lookup, keys, how, outputs, null_keys=null_keys)
    repeated = f"duplicate keys on the right of a {cardinality} join"
    left = df
    if [dtype(df, k) for k in keys] != [dtype(right, k) for k in keys]:
        # Keys of two types meet in a common one, which costs the exchange of that join.
        if cardinality == "one_to_one":
            left = checked_unique(left, keys, LEFT_REPEATS)
        lookup = checked_unique(lookup, keys, repeated)
        return key_join(left, lookup, keys, how, outputs, null_keys=null_keys)
    # Keys as one struct are equal if their fields are, nulls included, and unlike ``<=>`` an
    # equality of columns lets the join reuse the exchange of the checks. Nor does Spark carry
    # filters on the left's keys over to the right, where they would hide a repeated key.
    kind = T.StructType([T.StructField(k, dtype(df, k)) for k in keys])
    key = F.struct(*keys).cast(kind)
    left = df.withColumn("__key", key)
    if cardinality == "one_to_one":
        left = checked_unique(left, ["__key"], LEFT_REPEATS)
    lookup = lookup.select(key.alias("__right_key"), *outputs)
    lookup = checked_unique(lookup, ["__right_key"], repeated)
    same = F.col("__key") == F.col("__right_key")
    if not null_keys:
        for name in keys:
            same = same & F.col(f"__key.{name}").isNotNull()
    return left.join(lookup, same, how).select(*df.columns, *outputs)


def inner_join(
    df: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    fields: Mapping[str, str],
    *,
    cardinality: str = "many_to_one",
    null_keys: bool = True,
) -> DataFrame:
    """Inner equi-join that copies ``{right field: output}`` and checks cardinality."""
    return _joined(df, right, keys, fields, cardinality, "inner", null_keys)


def join_fields(
    df: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    fields: Mapping[str, str],
    *,
    cardinality: str = "many_to_one",
    null_keys: bool = True,
) -> DataFrame:
    """Left lookup join; a field the frame already has under the same name is skipped."""
    wanted = {f: o for f, o in fields.items() if not (f == o and o in df.columns)}
    return _joined(df, right, keys, wanted, cardinality, "left", null_keys)
