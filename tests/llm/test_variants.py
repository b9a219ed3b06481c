"""Spelling variants: every near pair, forms and roots against plain deletion neighbourhoods."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from panelspark.llm import variants
from tests.llm.helpers import DOCUMENTS, empty, odd, rows_of, there

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def near_pairs(words):
    """Pairs one edit apart: by a letter left out of one, or of both at the same place."""
    known, pairs = set(words), set()
    holes = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[i, w[:i] + w[i + 1 :]].add(w)
            shorter = w[:i] + w[i + 1 :]
            if shorter in known:
                pairs |= {(w, shorter), (shorter, w)}
    for group in holes.values():
        pairs |= {(a, b) for a in group for b in group if a != b}
    return pairs


def plain(rows):
    counts = Counter()
    for key, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    mates = defaultdict(list)
    for a, b in near_pairs(list(n)):
        mates[a].append(b)
    form = {}
    for w, others in mates.items():
        best = min(others, key=lambda o: (-n[o], o))
        if n[best] >= 10 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(mates[w]), n[form[w]] if w in form else None))
    return sorted(out)


def got(frame):
    assert frame.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, frame.collect()))


@pytest.mark.skipif(not there, reason="needs the test tables")
def test_documents(spark):
    rows = rows_of("documents", "doc_id, text")
    want = plain(rows)
    assert any(r[1] for r in want)
    assert got(variants.variants(spark.createDataFrame(rows, "doc_id long, text string"))) == want


def made_up(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(7, 11))) for _ in range(400)]
    words += ["A" * 30, "a" * 31, "a" * 29, "aaaaaab", "aaaaaaa", "baaaaaa", "aaaabaaa"]
    texts = []
    for word in words:
        texts += [word] * rng.choice([2, 3, 25, 400])
    rng.shuffle(texts)
    return [(i, " ".join(texts[i::40])) for i in range(40)]


@pytest.mark.parametrize("most", [variants.BLOCK_WORDS, 3, 20])
def test_split_blocks(spark, most):
    rows = made_up(most)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(variants.variants(frame, most)) == plain(rows)


def test_chain_of_forms(spark):
    texts = ["letterabc"] * 5 + ["letterab"] * 60 + ["lettera"] * 700 + ["lettera letterq"] * 3
    rows = [(i, t) for i, t in enumerate(texts)]
    found = got(variants.variants(spark.createDataFrame(rows, "doc_id long, text string")))
    assert found == plain(rows)
    assert any(r[0] == "letterabc" and r[2] == "lettera" for r in found)


def test_ties_take_the_first_in_code_point_order(spark):
    rows = [(1, " ".join(["zzzzzza"] * 40 + ["zzzzzzé"] * 40 + ["zzzzzzm"] * 2))]
    found = {r[0]: r for r in got(variants.variants(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert sorted(found.values()) == plain(rows)


def test_odd_rows(spark):
    frame = odd(spark).selectExpr("*", "1 AS word", "'x' AS n", "2 AS run", "3 AS h", "4 AS id", "5 AS core")
    rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
    assert got(variants.variants(frame)) == plain(rows)


def test_empty(spark):
    assert got(variants.variants(empty(spark, DOCUMENTS))) == []
