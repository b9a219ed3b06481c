"""Security lists: universes, enrichment and the searchable catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.semantics import key_join, require
from panelspark.operators.aggregates import distinct_by
from panelspark.operators.filters import valid_entity_code

# Exchange suffixes of an index constituent.
VALID_SUFFIX = r"\.(SH|SZ|BJ)$"


def constituent_universe(
    members: DataFrame, code: str, name: str, order_by: Sequence[str]
) -> DataFrame:
    """Index members as ``(code, name)``: valid suffixes, last row per code, sorted."""
    valid = members.where(F.col(code).rlike(VALID_SUFFIX))
    return (
        distinct_by(valid, [code], order_by, keep="last")
        .select(F.col(code).alias("code"), F.col(name).alias("name"))
        .orderBy("code")
    )


def all_status_universe(code: str, *masters: DataFrame, valid: Column | None = None) -> DataFrame:
    """Distinct valid codes of the listed, delisted and paused lists. ``valid`` is a condition
    for codes that are not built like those of listed securities."""
    codes = masters[0].select(code)
    for master in masters[1:]:
        codes = codes.unionByName(master.select(code))
    return codes.where(valid_entity_code(F.col(code)) if valid is None else valid).distinct()


def enrich_master(
    df: DataFrame,
    master: DataFrame,
    key: str,
    order_by: Sequence[str],
    fields: Sequence[str] = ("name", "industry"),
) -> DataFrame:
    """Add descriptive fields right after the key, from the first master row per key.

    Columns the frame already has are kept.
    """
    wanted = [f for f in fields if f in master.columns and f not in df.columns]
    first = distinct_by(master, [key], order_by)
    joined = key_join(df, first, [key], "left", wanted, null_keys=False)
    at = df.columns.index(key) + 1
    return joined.select(*df.columns[:at], *wanted, *df.columns[at:])


def _text(field: str) -> Column:
    trimmed = F.trim(F.col(field).cast("string"))
    return F.when(trimmed != "", trimmed)


def catalog(master: DataFrame) -> DataFrame:
    """Normalised list: trimmed text, blank as missing, key fields required."""
    clean = master.select(*[_text(f).alias(f) for f in ("code", "name", "industry", "exchange")])
    return require(
        clean,
        F.col("code").isNotNull() & F.col("name").isNotNull() & F.col("exchange").isNotNull(),
        "the security list has an empty required field",
    )


def catalog_page(
    master: DataFrame,
    *,
    page: int,
    page_size: int,
    search: str = "",
    exchange: str = "",
    industry: str = "",
) -> DataFrame:
    """One page of the filtered list by code, with ``total`` and ``total_pages``.

    The sort stops at the page's last row in every task.
    """
    if page < 1 or page_size < 1:
        raise ValueError("page and page_size start at 1")
    rows = catalog(master)
    wanted = search.strip().lower()
    if wanted:
        found = F.lit(False)
        for field in ("code", "name", "industry"):
            found = found | F.contains(F.lower(F.coalesce(field, F.lit(""))), F.lit(wanted))
        rows = rows.where(found)
    if exchange.strip():
        rows = rows.where(F.col("exchange") == exchange.strip().upper())
    if industry.strip():
        rows = rows.where(F.col("industry") == industry.strip())
    total = rows.agg(F.count(F.lit(1))).scalar()
    start = (page - 1) * page_size
    rows = require(rows, (total > start) | F.lit(page == 1), "page exceeds the last page")
    return rows.orderBy("code").offset(start).limit(page_size).select(
        "*",
        total.alias("total"),
        F.greatest(F.lit(1), F.ceil(total / page_size)).cast("long").alias("total_pages"),
    )


def catalog_industries(master: DataFrame) -> DataFrame:
    """Distinct industries of the whole list, sorted."""
    return catalog(master).select("industry").where("industry IS NOT NULL").distinct().orderBy(
        "industry"
    )
