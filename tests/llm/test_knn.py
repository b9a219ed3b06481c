"""Top-k search against every pair."""

import math
import random

import numpy as np
import pytest

from panelspark.llm import knn
from tests.llm.helpers import empty

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=10):
    kept = {}
    for key, vector, _ in rows:
        if key is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole = [math.floor(1024 * float(np.float32(x))) for x in vector]
        kept[key] = min(kept.get(key, whole), whole)
    out = []
    for q, vector in kept.items():
        if q % 100 == 0:
            scores = [
                (-sum(a * b for a, b in zip(vector, other)), key)
                for key, other in kept.items()
                if key != q and len(other) == len(vector)
            ]
            out += [(q, rank, key, -s) for rank, (s, key) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def table(seed=0, rows=900):
    choose = random.Random(seed)
    centres = [[choose.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    out = []
    for key in range(rows):
        centre = choose.choice(centres)
        vector = [c + choose.gauss(0, 0.2) for c in centre]
        if key % 3 == 0:
            vector = [1.0, 0.5, 0.0, -0.25, 0.0, 2.0]  # a third of all rows are copies
        out.append((key, vector, 0))
    out += [(5, [9.0] * 6, 0), (7, None, 0), (None, [1.0] * 6, 0), (901, [math.nan] * 6, 0), (902, [math.inf] * 6, 0)]
    out += [(903, [None, 1.0, 1.0, 1.0, 1.0, 1.0], 0), (1000, [0.5, 0.25], 0), (1001, [1.0, 1.0], 0), (1100, [], 0), (1101, [], 0)]
    choose.shuffle(out)
    return out


@pytest.mark.parametrize(("shard", "block", "leaf"), [(8192, 4096, 128), (150, 3, 16)])
def test_shards_and_blocks(spark, monkeypatch, shard, block, leaf):
    monkeypatch.setattr(knn.Tree.__init__, "__defaults__", (leaf,))
    rows = table()
    got = knn.top(spark.createDataFrame(rows, SCHEMA).repartition(3), shard_rows=shard, block_rows=block)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_many_partitions(spark):
    """Rows and queries of a tile meet even if no partitions are merged."""
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "13"}
    before = {name: spark.conf.get(name) for name in held}
    rows = table(rows=400)
    try:
        for name, value in held.items():
            spark.conf.set(name, value)
        got = [knn.top(spark.createDataFrame(rows, SCHEMA), shard_rows=s, block_rows=3).collect() for s in (8192, 150)]
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    for found in got:
        assert sorted(map(tuple, found)) == brute(rows)


def test_tree_prunes_and_is_exact():
    numbers = np.random.default_rng(0)
    points = numbers.integers(-2000, 2000, (3000, 4)).astype(float)
    tree = knn.Tree(np.arange(3000), points, leaf=16)
    seen = []
    tree.points = _Counting(points, seen)
    for q in range(0, 300, 100):
        query = points[q]
        found = tree.search(q, query, tree.bounds(query[None])[0], 10, -np.inf)
        scores = points @ query
        want = sorted(((-scores[i], i) for i in range(3000) if i != q))[:10]
        assert sorted((-s, -i) for s, i in found) == want
    assert sum(seen) < 3000  # of 3 x 3000


class _Counting:
    def __init__(self, points, seen):
        self.points, self.seen = points, seen

    def __getitem__(self, rows):
        self.seen.append(len(rows))
        return self.points[rows]


def test_small_tables(spark):
    assert knn.top(empty(spark, SCHEMA)).count() == 0
    rows = [(0, [1.0, 2.0], 0), (1, [3.0, 4.0], 0)]
    frame = spark.createDataFrame([*rows, *rows], SCHEMA).selectExpr("*", "1 AS rank", "2 AS score", "3 AS shard")
    assert [tuple(r) for r in knn.top(frame).collect()] == [(0, 1, 1, 1024 * 1024 * 11)]


def test_too_large_values_are_an_error(spark):
    frame = spark.createDataFrame([(0, [1e15, 1.0], 0), (1, [1e15, 1.0], 0)], SCHEMA)
    with pytest.raises(Exception, match="too large"):
        knn.top(frame).collect()
