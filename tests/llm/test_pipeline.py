"""The pipeline's stages against plain readings of their rules."""

import re

import numpy as np

import corpus_pipeline
from tests.llm.helpers import FOLDER, empty, odd, rows_of
from tests.llm.test_bpe import expected
from tests.llm.test_pii import base
from tests.llm.test_simhash import expected as near


def test_stages_have_the_shape_asked_for(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "personal_data", "packing"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).schema.simpleString() == docs.schema.simpleString()


def test_run_matches_a_plain_reading(spark):
    rows = {key: text for key, text in rows_of("documents", "doc_id, text") if text and re.search(r"[^\W\d_]", text)}
    kept = [key for key, _, root in near(list(rows.items())) if key == root]
    out = {}
    for r in corpus_pipeline.run(spark, FOLDER).collect():
        out.setdefault(r["doc_id"], []).append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
    assert set(out) == set(kept)
    for key in kept:
        ids = [i for _, part in sorted(out[key]) for i in part]
        assert ids[-1] == 1
        if not base(rows[key]):
            assert ids[:-1] == expected(rows[key])
        else:
            assert ids[:-1] != expected(rows[key])


def test_decisions_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    masked = stages["personal_data"](spark, docs, FOLDER)
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    after = {r["doc_id"]: r["text"] for r in masked.collect()}
    assert set(before) == set(after)
    assert any(base(text) for text in before.values())
    for key, text in before.items():
        assert not base(after[key])
        assert bool(base(text)) == (after[key] != text)


def test_odd_rows(spark):
    for frame, keys in ((odd(spark), {None, 4, 5, 6, 7}), (empty(spark), set())):
        docs = frame
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, FOLDER)
            if out.columns == frame.columns:
                docs = out
        assert docs.columns == frame.columns
        assert {r["doc_id"] for r in out.collect()} == keys


def test_columns_named_as_helpers_are(spark):
    """Whatever a table calls its other columns, a stage hands them on as they were."""
    names = ("__text", "__lang", "__score", "__base", "__key", "__of", "__terms", "__spans", "__TEXT_", "id", "t", "o", "root")
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 60")
    extra = frame.selectExpr("*", *(f"concat('{n}', doc_id) AS `{n}`" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, extra, FOLDER)
        assert out.columns == extra.columns
        plain = {(r["doc_id"], r["text"], r["lang"]) for r in stage(spark, frame, FOLDER).collect()}
        got = out.collect()
        assert {(r["doc_id"], r["text"], r["lang"]) for r in got} == plain and got
        assert all(r[n] == f"{n}{r['doc_id']}" for r in got for n in names), name
    assert corpus_pipeline.STAGES[-1][1](spark, extra, FOLDER).count() > 0
