"""Exact top-k search by inner product with a KD-tree in each shard.

Rows go to shards by the hash of their id, and queries to blocks, so a tile (a shard and a
block) has bounded size and tiles are independent tasks. A shard's tree splits at medians and
keeps tight boxes; the largest inner product a box can give a query bounds all its rows.
Nodes are visited best first, until no bound can beat the k-th score. The k-th score is
propagated: each block first searches one shard, and takes what it found along as the bound
to beat in all others. Equal scores are kept while the smaller id could still win.

Rules: a vector takes no part if it or its id is null, or a component is null or not finite.
Components become floor(1024 x). Of rows with the same id the smallest vector counts, once.
Vectors only meet vectors of the same length. Scores are exact 64-bit integers; vectors so
large that they would not be are an error. Ties go to the smaller id.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.session import stored

SCALE = 1024
TOP = 10
#: Rows of a shard and of a query block, on average.
SHARD_ROWS = 8192
BLOCK_ROWS = 4096
LEAF_ROWS = 128
#: Every so-manieth id is a query.
QUERY_STEP = 100
#: Queries whose bounds are computed at once.
_AT_ONCE = 256

FOUND = "query_id long, vec_id long, score long"


def prepared(embeddings: DataFrame) -> DataFrame:
    """``vec_id, dim, v``: integer vectors, one row per id."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return (
        embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound)
        .select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
        .groupBy("vec_id")
        .agg(F.min("v").alias("v"))
        .select("vec_id", F.size("v").alias("dim"), "v")
    )


class Tree:
    """A KD-tree over integer vectors held as exact doubles."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF_ROWS):
        order = np.argsort(ids, kind="stable")
        ids, points = ids[order], points[order]
        rows = np.arange(len(ids))
        self.children: list[tuple[int, int] | None] = []
        low, high, least, self.rows = [], [], [], []
        open_ = [(rows, -1, 0)]
        while open_:
            rows, parent, side = open_.pop()
            number = len(self.children)
            if parent >= 0:
                pair = list(self.children[parent])
                pair[side] = number
                self.children[parent] = tuple(pair)
            box = points[rows]
            low.append(box.min(axis=0))
            high.append(box.max(axis=0))
            least.append(int(ids[rows[0]]))
            spread = high[-1] - low[-1]
            if len(rows) <= leaf or not spread.size or not spread.max():
                self.children.append(None)
                self.rows.append(rows)
                continue
            axis = int(spread.argmax())
            half = len(rows) // 2
            cut = np.argpartition(box[:, axis], half)
            self.children.append((-1, -1))
            self.rows.append(None)
            # Rows stay in the order of their ids inside a node.
            open_.append((np.sort(rows[cut[:half]]), number, 0))
            open_.append((np.sort(rows[cut[half:]]), number, 1))
        self.low, self.high, self.least = np.array(low), np.array(high), least
        self.ids, self.points = ids, points

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product each node's box can give each query."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query_id: int, query: np.ndarray, bounds: np.ndarray, k: int, floor: float) -> list[tuple[float, int]]:
        """The best ``(score, -id)`` of rows other than the query's own that reach ``floor``."""
        best: list[tuple[float, int]] = []  # the worst of the best first
        open_ = [(-bounds[0], 0)]
        while open_:
            bound, node = heapq.heappop(open_)
            bound = -bound
            if bound < floor or len(best) == k and (bound, -self.least[node]) < best[0]:
                # What follows may tie and have a smaller id, unless its bound is lower.
                if bound < floor or bound < best[0][0]:
                    break
                continue
            pair = self.children[node]
            if pair is not None:
                for child in pair:
                    heapq.heappush(open_, (-bounds[child], child))
                continue
            rows = self.rows[node]
            scores = self.points[rows] @ query
            least = max(floor, best[0][0]) if len(best) == k else floor
            able = np.flatnonzero(scores >= least)
            if len(able) > 2 * k:
                # Ids ascend inside a leaf, so a stable order by score is the order wanted.
                able = able[np.argsort(-scores[able], kind="stable")[: k + 1]]
            for score, number in zip(scores[able].tolist(), self.ids[rows[able]].tolist()):
                if number == query_id:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (score, -number))
                elif (score, -number) > best[0]:
                    heapq.heapreplace(best, (score, -number))
        return best


def _matrix(table: pa.Table) -> np.ndarray:
    column = table.column("v").combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _searched(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """All queries of a block against a shard."""
    out: list[tuple[int, int, int]] = []
    if left.num_rows and right.num_rows:
        points, queries = _matrix(left), _matrix(right)
        # Python's integers, so that the check itself cannot overflow.
        largest = [max(abs(int(m.min())), abs(int(m.max()))) if m.size else 0 for m in (points, queries)]
        if largest[0] * largest[1] * max(1, points.shape[1]) >= 1 << 53:
            raise ValueError("vectors too large for exact scores")
        tree = Tree(left.column("vec_id").to_numpy(), points.astype(np.float64))
        queries = queries.astype(np.float64)
        ids, floors = right.column("vec_id").to_pylist(), right.column("floor").to_pylist()
        for start in range(0, len(ids), _AT_ONCE):
            some = slice(start, start + _AT_ONCE)
            for query_id, query, bounds, floor in zip(ids[some], queries[some], tree.bounds(queries[some]), floors[some]):
                found = tree.search(query_id, query, bounds, k, -np.inf if floor is None else floor)
                out += [(query_id, -number, int(score)) for score, number in found]
    columns = zip(*out) if out else ((), (), ())
    return pa.table([pa.array(list(c), pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])


def top(
    embeddings: DataFrame,
    k: int = TOP,
    query_step: int = QUERY_STEP,
    shard_rows: int = SHARD_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` best rows. Queries are the rows
    whose id is divisible by ``query_step``."""
    vectors = stored(prepared(embeddings))
    is_query = F.col("vec_id") % query_step == 0
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q")).first()
    shards, blocks = max(1, -(-size["n"] // shard_rows)), max(1, -(-size["q"] // block_rows))
    tile = ["dim", "shard", "block"]

    # Both sides of a tile have the same types: an int and a long of equal value hash apart.
    every_block = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    every_shard = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    placed = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)))
    queries = vectors.where(is_query).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)))
    home = F.pmod(F.col("block"), F.lit(shards))

    def search(rows: DataFrame, wanted: DataFrame) -> DataFrame:
        return (
            rows.groupBy(*tile)
            .cogroup(wanted.toDF(*wanted.columns).groupBy(*tile))
            .applyInArrow(lambda left, right: _searched(left, right, k), FOUND)
        )

    # First each block's own shard, then all others with the bound that it gave.
    own_rows = placed.withColumn("block", every_block).where(home == F.col("shard"))
    first = stored(
        search(own_rows, queries.withColumn("shard", home).withColumn("floor", F.lit(None).cast("long")))
    )
    reached = first.groupBy("query_id").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n"))
    reached = reached.select(F.col("query_id").alias("vec_id"), F.when(F.col("n") >= k, F.col("floor")).alias("floor"))
    other_rows = placed.withColumn("block", every_block).where(home != F.col("shard"))
    others = (
        queries.join(reached, "vec_id", "left")
        .withColumn("shard", every_shard)
        .where(home != F.col("shard"))
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        first.unionByName(search(other_rows, others))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


#: The same rows by comparing every query with every row.
ORACLE = """
WITH v AS (
  SELECT vec_id, min([floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding]) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
  GROUP BY vec_id
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
    vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
