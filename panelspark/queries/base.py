"""Registry of queries: a Spark plan, an output contract and an equivalent SQL text."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """The Parquet tables of one folder as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    columns: tuple[tuple[str, str], ...]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def _six_places(value: Column) -> Column:
    """Round to six places. The boundary sits just off one half, where exact decimal
    ties would otherwise fall either way with the last bit of a float sum."""
    rounded = F.floor(value * 1e6 + 0.5001) / 1e6
    return F.when(F.abs(value) < 1e12, rounded).otherwise(value)


def _shown(name: str, kind: str) -> Column:
    """One output column in the form both engines can produce exactly."""
    column = F.col(name)
    return {
        "f": lambda: _six_places(column.cast("double")),
        "i": lambda: column.cast("long"),
        "b": lambda: column.cast("int"),
        "d": lambda: F.date_format(column, "yyyyMMdd"),
        "s": lambda: column.cast("string"),
    }[kind]().alias(name)


_SQL_SHOWN = {
    "f": "CASE WHEN abs({0}) < 1e12 THEN floor(CAST({0} AS DOUBLE) * 1e6 + 0.5001) / 1e6 "
    "ELSE CAST({0} AS DOUBLE) END AS {0}",
    "i": "CAST({0} AS BIGINT) AS {0}",
    "b": "CAST({0} AS INTEGER) AS {0}",
    "d": "strftime({0}, '%Y%m%d') AS {0}",
    "s": "CAST({0} AS VARCHAR) AS {0}",
}


def register(
    name: str,
    out: str,
    build: Callable[[Tables], DataFrame],
    sql: str | None = None,
    ctes: Sequence[str] = (),
) -> None:
    """Add a query. ``out`` lists ``column:kind`` with kinds f i b d s."""
    if name in REGISTRY:
        raise ValueError(f"query registered twice: {name}")
    columns = tuple(tuple(item.split(":")) for item in out.split())
    text = None
    if sql is not None:
        parts = [*ctes, f"result AS ({sql})"]
        shown = ", ".join(_SQL_SHOWN[kind].format(column) for column, kind in columns)
        text = f"WITH {', '.join(parts)} SELECT {shown} FROM result"
    REGISTRY[name] = Query(name, build, columns, text)


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    query = REGISTRY[name]
    return query.build(Tables(spark, folder)).select(
        *[_shown(column, kind) for column, kind in query.columns]
    )
