"""Fingerprints and their components against all pairs."""

import random

import numpy as np
import pytest
import xxhash

from panelspark.llm import simhash
from tests.llm.helpers import FOLDER, ODD, empty, odd, rows_of


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def roots(prints, bits=3):
    """The place of the first member of each fingerprint's component, over all pairs."""
    label = list(range(len(prints)))
    values = np.array(prints, np.uint64)
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= bits):
            a, b = label[i], label[j]
            if a != b:
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def expected(rows):
    prints = [fingerprint(text) for _, text in rows]
    label = roots(prints)
    least = {}
    for (key, _), root in zip(rows, label):
        if key is not None:
            least[root] = min(key, least.get(root, key))
    return sorted(
        ((key, f"{p:016x}", least.get(root)) for (key, _), p, root in zip(rows, prints, label)), key=str
    )


def clouds(seed, centres=6, size=70):
    """Clusters whose members differ in a few bits."""
    choose = random.Random(seed)
    out = set()
    for _ in range(centres):
        centre = choose.getrandbits(64)
        marginal = choose.sample(range(64), 9)
        for _ in range(size):
            out.add(centre ^ sum(1 << b for b in choose.sample(marginal, choose.randint(0, 6))))
    return sorted(out)


def test_trie_finds_all_components():
    for seed in range(5):
        prints = clouds(seed)
        members = np.array(prints, np.uint64)
        a, b = simhash.trie_links(members, np.zeros(len(members), np.int64))
        label = list(range(len(prints)))
        for i, j in zip(a.tolist(), b.tolist()):
            x, y = label[i], label[j]
            label = [min(x, y) if z in (x, y) else z for z in label]
        assert label == roots(prints)
        assert len(a) <= len(members) - len(set(label))


@pytest.mark.parametrize("group", [16, 2048])
def test_groups_of_any_size_give_the_same_components(spark, monkeypatch, group):
    monkeypatch.setattr(simhash, "GROUP", group)
    prints = clouds(11)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(s,) for s in signed], "fp long")
    got = {r["fp"]: r["root"] for r in simhash.components(simhash.links(frame)).collect()}
    want = {}
    label = roots(prints)
    for root in set(label):
        members = [s for s, x in zip(signed, label) if x == root]
        want |= {m: min(members) for m in members if m != min(members)}
    assert got == want


def test_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert sorted(map(tuple, simhash.report(docs).collect()), key=str) == expected(rows_of("documents", "doc_id, text"))


def test_odd_rows(spark):
    assert sorted(map(tuple, simhash.report(odd(spark)).collect()), key=str) == expected([r[:2] for r in ODD])
    assert simhash.report(empty(spark)).count() == 0


def test_one_of_each_keeps_columns_and_one_row(spark):
    frame = odd(spark)
    kept = simhash.one_of_each(frame)
    assert kept.columns == frame.columns
    # 1, 2 and 3 are all blank; 6 comes twice.
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 4, 5, 6, 7, 8]
    assert simhash.one_of_each(empty(spark)).count() == 0
