"""Rows that every operator has to take: nulls, empty and long texts, repeats, odd columns."""

from __future__ import annotations

from pathlib import Path

import duckdb

FOLDER = "/root/testdata/sf0.001"
there = Path(FOLDER).exists()

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, " \t\n", "en", "s", 3),
    (4, "word " * 30_000, "en", "s", 150_000),
    (5, "x" * 20_000, None, "s", 20_000),
    (6, "the same text of some words", "en", "s", 27),
    (6, "the same text of some words", "en", "s", 27),
    (None, "a text without an id", "en", None, None),
    (7, "Größe, ÉTÉ и Ω; 中文 🎉 don't", "de", "s", 1),
    (8, "!!! 123 ...", "fr", "s", 11),
]


def odd(spark):
    """The odd documents with columns whose names operators use themselves."""
    frame = spark.createDataFrame(ODD, DOCUMENTS)
    extra = {"start": "1", "end": "'x'", "fp": "2", "ids": "'y'", "score": "0.5", "key": "3", "spans": "4", "held_out": "true"}
    return frame.selectExpr("*", *(f"{value} AS `{name}`" for name, value in extra.items()))


def empty(spark, schema: str = DOCUMENTS):
    return spark.createDataFrame([], schema)


def rows_of(table: str, columns: str = "*") -> list[tuple]:
    return duckdb.sql(f"SELECT {columns} FROM '{FOLDER}/{table}.parquet'").fetchall()
