"""Packed windows: every id once, no window too full, little padding."""

import itertools
import random
import zlib
from collections import defaultdict

import numpy as np

from panelspark.llm import bpe, packing
from tests.llm.helpers import FOLDER, ODD, empty, odd
from tests.llm.test_bpe import expected

PATH = bpe.word_bpe_path()


def test_differencing_is_near_the_best_split():
    choose = random.Random(3)
    for _ in range(60):
        lengths = [choose.randint(1, 60) for _ in range(7)]
        k = choose.randint(1, 3)
        groups = packing.difference(lengths, k)
        assert sorted(i for _, items in groups for i in items) == list(range(7))
        assert all(total == sum(lengths[i] for i in items) for total, items in groups)
        best = min(
            max(sum(n for n, g in zip(lengths, where) if g == group) for group in range(k))
            for where in itertools.product(range(k), repeat=7)
        )
        assert max(total for total, _ in groups) <= best * 4 / 3


def test_window_count_rises_until_all_fit():
    assert packing.windows([], 10) == []
    assert sorted(map(sorted, packing.windows([6, 6, 6], 10))) == [[0], [1], [2]]
    choose = random.Random(4)
    lengths = [choose.randint(1, 512) for _ in range(700)]
    found = packing.windows(lengths, 2048)
    assert all(sum(lengths[i] for i in w) <= 2048 for w in found)
    assert len(found) <= -(-sum(lengths) // 2048) + 1


def check(rows, texts):
    """Rows of ``pack`` hold each document's ids once, in windows without gaps."""
    docs, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] > 0
        docs[r["doc_id"]].append((r["start"], ids, r["doc_tokens"]))
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in windows.values():
        here = 0
        for offset, length in sorted(pieces):
            assert offset == here
            here += length
        assert here <= 2048
    for key, wanted in texts.items():
        ids = [i for _, part, _ in sorted(docs.pop(key)) for i in part]
        assert ids == wanted
    assert not docs
    return sum(r["length"] for r in rows) / (2048 * len(windows))


def test_documents(spark):
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r["doc_id"]: [*expected(r["text"]), 1] for r in frame.collect()}
    assert check(packing.pack(frame, PATH).collect(), texts) > 0.97
    got = packing.pieces(frame, PATH).collect()
    for r in got:
        ids = np.array(texts[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert r["ids_crc32"] == zlib.crc32(ids.tobytes())


def test_odd_rows(spark):
    once = {r[0]: [*expected(r[1]), 1] for r in ODD}
    rows = packing.pack(odd(spark).dropDuplicates(["doc_id"]), PATH).collect()
    check(rows, once)
    assert sum(r["length"] for r in packing.pack(odd(spark), PATH).collect()) == sum(len(expected(r[1])) + 1 for r in ODD)
    assert packing.pack(empty(spark), PATH).count() == 0
