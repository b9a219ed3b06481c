"""Scores against a plain reading of the definition, document by document."""

import math
import zlib
from collections import Counter

import pytest

from panelspark.llm import lm
from tests.llm.helpers import DOCUMENTS, FOLDER, ODD, empty, odd, rows_of


def words_of(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + [" "]


def brute(rows, share=lm.SHARE):
    held = {i: zlib.crc32(str("" if key is None else key).encode()) % 10 == 0 for i, (key, _) in enumerate(rows)}
    texts = [words_of(text) for _, text in rows]
    single, double = Counter(), Counter()
    for i, words in enumerate(texts):
        if not held[i]:
            single.update(words)
    n, v = sum(single.values()), len(single)
    frequent = {w for w, c in single.items() if c >= max(lm.PAIR_COUNT, share * n)}
    for i, words in enumerate(texts):
        if not held[i]:
            double.update(p for p in zip(words, words[1:]) if set(p) <= frequent)
    arcs = {p: c for p, c in double.items() if c >= lm.PAIR_COUNT}
    mass = Counter()
    for (h, _), c in arcs.items():
        mass[h] += c - lm.DISCOUNT
    out = []
    for i, words in enumerate(texts):
        base = score = 0.0
        state = None
        for w in words:
            p = (single[w] + lm.ADD) / (n + lm.ADD * (v + 1))
            base += math.log10(p)
            if state is not None:
                rest = 1 - mass[state] / single[state]
                p = rest * p + (arcs[state, w] - lm.DISCOUNT) / single[state] if (state, w) in arcs else rest * p
            score += math.log10(p)
            state = w if w in frequent else None
        out.append((rows[i][0], held[i], len(words), sum(single[w] > 0 for w in words), n, base, score))
    return out


def same(got, want):
    order = lambda r: (r[0] is None, r[0] or 0, r[2])
    got, want = sorted(map(tuple, got), key=order), sorted(want, key=order)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


def test_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = lm.scored(docs).collect()
    same(got, brute(rows_of("documents", "doc_id, text")))
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_small_blocks_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_DOCS", 7)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    same(lm.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect(), brute(rows))


def test_odd_rows(spark):
    rows = [r[:2] for r in ODD]
    same(lm.scored(odd(spark)).collect(), brute(rows))
    assert lm.scored(empty(spark)).count() == 0
    only_held = [(k, "some text") for k in range(200) if zlib.crc32(str(k).encode()) % 10 == 0]
    got = lm.scored(spark.createDataFrame([(k, t, None, None, None) for k, t in only_held], DOCUMENTS)).collect()
    assert all(r["base_score"] == 0 and r["score"] == 0 and r["n_known"] == 0 for r in got)


def test_pairs_of_rare_words_are_arcs(spark):
    learnt = [k for k in range(60) if zlib.crc32(str(k).encode()) % 10]
    rows = [(k, "the word " * 2000) for k in learnt[:20]]
    rows += [(learnt[20], "quimby zorblatt"), (learnt[21], "quimby zorblatt"), (learnt[22], "quimby word")]
    got = lm.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # Two in eighty thousand tokens: an arc all the same.
    same(got, brute(rows, share=0))
    assert all(r["score"] > r["base_score"] + 2 for r in got if r["doc_id"] in learnt[20:22])


def test_the_last_stage_holds_no_words(spark):
    """The words' shuffles are read, and can go, before the blocks meet what they need."""
    docs = spark.createDataFrame([(i, "a b c") for i in range(20)], "doc_id long, text string")
    plan = lm.scored(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
