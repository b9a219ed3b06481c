"""Source divergence: exact values against plain whole-number arithmetic."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from panelspark.llm import divergence
from tests.llm.helpers import FOLDER, empty, odd, rows_of, there

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "text string, lang string, source string"


def plain(rows):
    groups, spread = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = TERM.findall((text or "").translate(LOWER))
        groups[lang or "", source or ""].update(terms)
        spread[lang or ""].update(set(terms))
    out = []
    for lang in spread:
        kept = [t for t, n in spread[lang].items() if n >= 3]
        counts = {s: {t: c[t] for t in kept} for (la, s), c in groups.items() if la == lang}
        whole = {t: sum(c[t] for c in counts.values()) for t in kept}

        def share(counted):
            total = sum(counted.values())
            return {t: 1 + 10**9 * (counted[t] + 1) // (total + len(kept)) for t in kept}

        q, p = share(whole), {s: share(c) for s, c in counts.items()}
        for s in p:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode(), o) for o in p if o != s]
            best = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", best)):
                for rank, (value, _, item) in enumerate(sorted(found), 1):
                    if part == "pair" or rank <= 200:
                        out.append((lang, s, part, item, -value, rank))
    return sorted(out)


def got(frame):
    assert frame.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert dict(frame.dtypes)["value"] == "bigint" and dict(frame.dtypes)["rank"] == "int"
    return sorted(map(tuple, frame.collect()))


@pytest.mark.skipif(not there, reason="needs the test tables")
def test_documents(spark, monkeypatch):
    rows = rows_of("documents", "text, lang, source")
    want = plain(rows)
    frame = spark.createDataFrame(rows, SCHEMA)
    assert got(divergence.audit(frame)) == want
    # Many shards, small tables in them, and many flushes give the same.
    for name, value in (("SHARD_ROWS", 500), ("CELLS", 64), ("HELD_ROWS", 1000), ("TEXT_BYTES", 5000)):
        monkeypatch.setattr(divergence, name, value)
    assert got(divergence.audit(frame.repartition(5))) == want


def test_odd_rows(spark):
    frame = odd(spark).withColumn("rank", F.lit(1)).withColumn("value", F.lit("v"))
    rows = [tuple(r) for r in frame.select("text", "lang", "source").collect()] * 3
    more = [("a b", "en", "t"), ("a", None, "u"), ("", "xx", "y"), (None, "xx", "z"), ("Ä ä É", "en", None)] * 3
    rows += more
    assert got(divergence.audit(spark.createDataFrame(rows, SCHEMA))) == plain(rows)
    assert got(divergence.audit(frame)) == plain([tuple(r) for r in frame.select("text", "lang", "source").collect()])


def test_empty(spark):
    assert got(divergence.audit(empty(spark))) == []


def test_ties_and_cut(spark):
    # 300 terms of one source alone, all alike, and a bare group beside it.
    text = " ".join("t" + chr(97 + i // 26) + chr(97 + i % 26) for i in range(300))
    rows = [(text, "en", "a")] * 3 + [("other words here", "en", "b")] * 3 + [("", "en", "c")]
    found = got(divergence.audit(spark.createDataFrame(rows, SCHEMA)))
    assert found == plain(rows)
    assert sum(r[2] == "term" and r[1] == "a" for r in found) == 200


def test_sql(spark):
    rows = [("One two two", "en", "a"), ("one two", "en", "b"), ("two ONE é", "en", None), (None, None, "b")] * 2
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    assert sorted(con.sql(divergence.ORACLE).fetchall()) == plain(rows)


def test_shares_are_exact_for_large_counts():
    import numpy as np

    counts, total = [0, 5, 9 * 10**12], 9 * 10**13
    got = divergence.shares(np.array(counts), np.array(total), 7)
    assert got.tolist() == [1 + 10**9 * (c + 1) // (total + 7) for c in counts]
