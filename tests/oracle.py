"""Compare queries with their SQL twins on DuckDB: ``python -m tests.oracle [sf] [names...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, list):
        return tuple(_plain(v) for v in value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(plain, key=lambda r: tuple((v is None, str(type(v)), v) if v is not None else (True, "", 0) for v in r))


def kinds(types) -> list[str]:
    names = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string"}
    return [names.get(str(t), str(t)) for t in types]


def difference(con, sql: str, df) -> str | None:
    """A description of the first mismatch, or None."""
    got = [tuple(r) for r in df.collect()]
    rel = con.sql(sql)
    want = rel.fetchall()
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {df.columns} != {rel.columns}"
    spark_types = dict(df.dtypes)
    duck_types = dict(zip(rel.columns, kinds(rel.types)))
    if spark_types != duck_types:
        return f"types {spark_types} != {duck_types}"
    a, b = _sorted(df.columns, got), _sorted(rel.columns, want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        return f"{len(wrong)} of {len(a)} rows differ on {sorted(df.columns)}, e.g. {wrong[0]}"
    return None


def main() -> None:
    import __spark_entry__ as entry
    from panelspark.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracles = entry.oracle_sql()
    wanted = sys.argv[2:]
    bad = 0
    for name, build in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            if name in oracles:
                problem = difference(con, oracles[name], build(spark, folder))
                rows = ""
            else:
                problem, rows = None, f" rows-only {len(build(spark, folder).collect())}"
        except Exception as exc:  # report and go on with the other queries
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.2f}s{rows if not problem else ''} {problem or ''}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
