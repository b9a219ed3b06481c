"""CSV output that spreadsheet programs open as UTF-8."""

from __future__ import annotations

from pyspark.sql import DataFrame

BYTE_ORDER_MARK = "﻿"


def write_csv(df: DataFrame, path: str) -> None:
    """Write one CSV file per task, each with a byte-order mark and a header."""
    first = df.columns[0]
    df.withColumnRenamed(first, BYTE_ORDER_MARK + first).write.mode("overwrite").csv(
        path, header=True, encoding="UTF-8"
    )


def read_csv(spark, path: str, schema: str) -> DataFrame:
    """Read such files back; the header's mark does not matter under a given schema."""
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=True)
