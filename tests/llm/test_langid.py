"""Languages: held-out accuracy, and what prediction may read."""

import math
import random
import zlib
from collections import Counter

import numpy as np

from panelspark.llm import langid
from tests.llm.helpers import FOLDER, ODD, empty, odd


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in langid.report(docs).collect()}
    held = [r for r in docs.select("doc_id", "lang").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert {key for key, r in got.items() if r["held_out"]} == {r["doc_id"] for r in held}
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_only_the_text_counts(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    # The held-out documents with other languages and sources: nothing changes.
    other = docs.withColumn("lang", langid.F.when(langid.held_out(), "xx").otherwise(langid.F.col("lang"))).withColumn("source", langid.F.lit("s"))
    first, second = ({tuple(r) for r in langid.report(d).collect()} for d in (docs, other))
    assert first == second


def test_the_sample_is_bounded_and_the_same_for_any_partitioning(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    first = sorted(map(tuple, langid.sample(docs, 20).collect()))
    second = sorted(map(tuple, langid.sample(docs.repartition(7), 20).collect()))
    assert first == second
    assert {lang: sum(r[0] == lang for r in first) for lang, _ in first} == {"en": 20, "de": 20, "fr": 20, "es": 20}


def test_odd_rows(spark):
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.report(odd(spark).drop("score")).collect()}
    assert got[1] == got[2] == got[3] == got[8] == ("und", 0.0)
    assert got[4][0] in ("en", "de") and got[None][0] in ("en", "de")
    assert langid.report(empty(spark)).count() == 0
    # Nothing to learn from, and a single language.
    rows = [(1, "some text"), (2, "1234")]
    none = spark.createDataFrame([(k, t, None, None, None) for k, t in rows], odd(spark).select("doc_id", "text", "lang", "source", "n_chars").schema)
    assert {r["lang_pred"] for r in langid.report(none).collect()} == {"und"}
    one = none.withColumn("lang", langid.F.lit("xx"))
    assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.report(one).collect()} == {1: ("xx", 1.0), 2: ("und", 0.0)}


def test_identified_drops_unknown_and_keeps_columns(spark):
    frame = odd(spark)
    kept = langid.identified(frame)
    assert kept.columns == frame.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 4, 5, 6, 6, 7]
    assert kept.where("lang IS NULL").count() == 0


def test_machines_separate_three_classes_in_two_families():
    choose = random.Random(0)
    syllables = {"en": "th er on", "de": "sch ung ie", "fr": "eau que ou"}
    samples = {
        lang: np.array([langid.vector(" ".join("".join(choose.choices(s.split(), k=2)) for _ in range(30))) for _ in range(40)])
        for lang, s in syllables.items()
    }
    model = langid.Model(samples)
    assert model.families.names == ["germanic", "romance"]
    assert model.languages["germanic"].names == ["de", "en"]
    assert model.predict("schung ieung schie")[0] == "de"
    assert model.predict("quequeeau ououeau")[0] == "fr"
    assert model.predict("therer onthon erther")[0] == "en"


def test_long_texts_count_like_their_parts():
    text = "ab cd " * 400_000
    assert np.allclose(langid.vector(text), langid.vector("ab cd " * 4000), atol=1e-3)


def plain(model, text):
    """Features counted one by one, then votes machine by machine."""
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    data = [b if b >= 128 or chr(b).isalpha() else 32 for b in text.lower().encode()]
    data += [32] * (3 - len(data))
    counts, mask = Counter(), 0xFFFFFFFF
    for a, b, c in zip(data, data[1:], data[2:]):
        if a == b == 32 or b == c == 32:
            continue
        two = (b * 40503 + c) * 2654435761 & mask
        three = two + a * 2246822519 + 374761393 & mask
        three ^= three >> 15
        counts[(three * 2654435761 & mask) >> 20] += 1
        counts[two >> 20] += 1
    norm = math.sqrt(sum(counts.values())) or 1.0

    def vote(level):
        votes, closest = Counter(), dict.fromkeys(level.names, 1.0)
        for (a, b), w in zip(level.pairs, level.weights.tolist()):
            margin = w[-1] + sum(w[i] * math.sqrt(n) / norm for i, n in counts.items())
            chance = 1 / (1 + math.exp(-max(-50, min(50, 3 * margin))))
            a, b = level.names[a], level.names[b]
            votes[a if chance >= 0.5 else b] += 1
            closest[a], closest[b] = min(closest[a], chance), min(closest[b], 1 - chance)
        best = min(level.names, key=lambda x: (-votes[x], -closest[x], x))
        return best, closest[best] if level.pairs else 1.0

    family, sure = vote(model.families)
    language, within = vote(model.languages[family])
    return language, sure * within


def test_predictions_against_a_plain_reading(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").unionByName(odd(spark), allowMissingColumns=True).select("doc_id", "text", "lang")
    model = langid.train(docs)
    assert langid.DIMENSIONS == 4096 and len(model.languages) >= 2
    for row in langid.predict(docs, model).collect():
        language, score = plain(model, row["text"])
        assert row["lang_pred"] == language, row["doc_id"]
        assert abs(row["score"] - score) < 1e-4
