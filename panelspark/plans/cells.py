"""Threshold cells: counts of many threshold rules without a row per rule.

A rule is a box: one or two axes, each cut by ``<=`` or ``>=`` at one of the axis's thresholds.
An axis replaces a value by two places, ``up`` (the first ``<=`` threshold that it meets) and
``down`` (the first ``>=`` threshold from above that it meets), so values with the same places
meet the same conditions. Rows are counted once per *grid* (a pair of axes) and cell, combining
before the shuffle. A rule's value is then the sum of the cells at or before its places: running
sums along the first axis, then along the second, give it for all thresholds of a grid at once.

The threshold after the last ``>=`` one is minus infinity. The box that uses it on both axes holds
every row on which both are known, which is a rule's baseline. So baselines, and rules on one
factor (whose second axis is constant), need nothing of their own.

What is summed may be any mergeable aggregate: counts, sums, and XOR fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Directions; the names of a condition's operators.
UP, DOWN = "<=", ">="
#: Places of an axis are packed into one number by this many bits each.
PLACE_BITS = 15
#: The axis with nothing to choose, and the formula axes' thresholds.
CONSTANT = ""
_PLACES = (1 << PLACE_BITS) - 1
#: Rows times boxes that a task looks at in one step.
_STEP = 1 << 23
#: Sums over keys of products of a box's rows ``n`` and hits ``h`` with its own or its base's.
PRODUCTS = ("nn", "nh", "hh", "n_bn", "n_bh", "h_bn", "h_bh")


@dataclass
class Axis:
    """A numeric column expression (null where it is not known) and its thresholds."""

    value: Column
    up: set[float] = field(default_factory=set)
    down: set[float] = field(default_factory=set)

    def thresholds(self, direction: str) -> list[float]:
        """In the order in which a growing set of rows meets them."""
        return sorted(self.up) if direction == UP else sorted(self.down, reverse=True)

    def size(self, direction: str) -> int:
        """Number of places; ``>=`` has one more, for minus infinity."""
        return len(self.up) if direction == UP else len(self.down) + 1

    def code(self) -> Column:
        """Both places of a value in one number; null if the value is."""

        def missed(thresholds: list[float], more) -> Column:
            return sum((more(F.lit(t)).cast("int") for t in thresholds), F.lit(0))

        up = missed(self.thresholds(UP), lambda t: t < self.value)
        down = missed(self.thresholds(DOWN), lambda t: t > self.value)
        return F.when(self.value.isNotNull(), F.shiftleft(up, PLACE_BITS) + down)


@dataclass(frozen=True)
class Side:
    """One side of a box: an axis, a direction and a threshold (None: minus infinity)."""

    axis: str
    direction: str = DOWN
    threshold: float | None = None


WHOLE = Side(CONSTANT)


class Boxes:
    """Tagged boxes over named axes, grouped into grids."""

    def __init__(self, values: Mapping[str, Column]):
        self.axes = {CONSTANT: Axis(F.lit(0.0)), **{name: Axis(v) for name, v in values.items()}}
        self._boxes: list[tuple[int, Side, Side]] = []

    def add(self, tag: int, first: Side, second: Side = WHOLE) -> None:
        for side in (first, second):
            axis = self.axes[side.axis]
            if side.threshold is not None:
                (axis.up if side.direction == UP else axis.down).add(float(side.threshold))
                if max(len(axis.up), len(axis.down)) >= _PLACES:
                    raise ValueError(f"more than {_PLACES - 1} thresholds on one factor")
        self._boxes.append((tag, first, second))

    def _grids(self) -> dict[tuple[str, str], int]:
        pairs = dict.fromkeys((a.axis, b.axis) for _, a, b in self._boxes)
        return {pair: number for number, pair in enumerate(pairs)}

    def placed(self, rows: DataFrame, columns: Sequence[str]) -> DataFrame:
        """``grid, c1, c2`` and the columns: a row for every grid whose axes are known. The
        places of each axis are worked out once per row."""
        names = list(self.axes)
        grids = F.array(
            *(
                F.struct(F.lit(n).alias("grid"), F.lit(names.index(a)).alias("a"), F.lit(names.index(b)).alias("b"))
                for (a, b), n in self._grids().items()
            )
        )
        codes = F.array(*(axis.code() for axis in self.axes.values()))
        return (
            rows.select(*columns, codes.alias("__codes"))
            .select(*columns, "__codes", F.explode(grids).alias("__g"))
            .select(
                F.col("__g.grid").alias("grid"),
                F.get("__codes", F.col("__g.a")).alias("c1"),
                F.get("__codes", F.col("__g.b")).alias("c2"),
                *columns,
            )
            .where("c1 IS NOT NULL AND c2 IS NOT NULL")
        )

    def _place(self, side: Side) -> int:
        axis = self.axes[side.axis]
        if side.threshold is None:
            return axis.size(DOWN) - 1
        return axis.thresholds(side.direction).index(float(side.threshold))

    def corners(self, spark: SparkSession) -> DataFrame:
        """``grid, up1, up2, j1, j2, tag``: where each box is read off."""
        grids = self._grids()
        rows = [
            (grids[a.axis, b.axis], a.direction == UP, b.direction == UP, self._place(a), self._place(b), tag)
            for tag, a, b in self._boxes
        ]
        return spark.createDataFrame(rows, "grid int, up1 boolean, up2 boolean, j1 int, j2 int, tag long")

    def families(self, spark: SparkSession) -> DataFrame:
        """``grid, up1, up2, size1, size2``: pairs of directions in use, and their places."""
        grids = self._grids()
        rows = dict.fromkeys(
            (
                grids[a.axis, b.axis],
                a.direction == UP,
                b.direction == UP,
                self.axes[a.axis].size(a.direction),
                self.axes[b.axis].size(b.direction),
            )
            for _, a, b in self._boxes
        )
        return spark.createDataFrame(list(rows), "grid int, up1 boolean, up2 boolean, size1 int, size2 int")

    def sums(self, cells: DataFrame, key: str, added: Sequence[str], mixed: Sequence[str] = ()) -> DataFrame:
        """``tag, key`` and the summed (``added``) or XORed (``mixed``) columns of every box that
        has rows under the key. ``cells`` has ``grid, c1, c2, key`` and the columns."""
        spark = cells.sparkSession
        family = ["grid", "up1", "up2"]
        totals = {**{c: F.sum(c) for c in added}, **{c: F.bit_xor(c) for c in mixed}}

        def place(up: str, code: str) -> Column:
            return F.when(F.col(up), F.shiftright(code, PLACE_BITS)).otherwise(F.col(code).bitwiseAND(F.lit(_PLACES)))

        # One row per grid and pair of directions: at most four times the pairs of factors.
        directed = (
            cells.join(F.broadcast(self.families(spark)), "grid")
            .withColumns({"j1": place("up1", "c1"), "j2": place("up2", "c2")})
            .where("j1 < size1 AND j2 < size2")
        )
        # One exchange serves the sums of equal places and both running sums.
        directed = (
            directed.repartition(*family, key)
            .groupBy(*family, "size1", "size2", "j1", "j2", key)
            .agg(*(total.alias(c) for c, total in totals.items()))
        )
        run = _running(directed, [*family, key, "j2"], "j1", "size1", totals)
        run = _running(run, [*family, key, "j1"], "j2", "size2", totals)
        # A row per box: the running sums, whose number grows with the keys, stay where they are.
        return run.join(F.broadcast(self.corners(spark)), [*family, "j1", "j2"]).select("tag", key, *totals)

    def cells(self, rows: DataFrame, key: str, needed: Sequence[str], stats: Sequence[Column]) -> DataFrame:
        """Aggregates per grid, cell and key of the rows."""
        placed = self.placed(rows, [c for c in dict.fromkeys([key, *needed])])
        return placed.groupBy("grid", "c1", "c2", key).agg(*stats)

    def products(self, rows: DataFrame, key: str, hit: str, bases: Mapping[int, int]) -> DataFrame:
        """``tag, keys, most`` and ``PRODUCTS`` of every box with rows: the number of keys under
        which it has some, the largest number of rows under a key, and the sums over all keys of
        products of its rows ``n`` and hits ``h`` with its own, and with those of the box whose
        tag is its base (``bases``; its own if it has none).

        Rows of a key meet in one task, which reads them one after the other and holds a number
        per box; no row is made per key and box.
        """
        axes = list(self.axes)
        sides = list(dict.fromkeys(s for _, *both in self._boxes for s in both))
        chosen = [(axes.index(s.axis), s.direction == UP, self._place(s)) for s in sides]
        first, second = (np.array([sides.index(box[i]) for box in self._boxes]) for i in (1, 2))
        tags = [tag for tag, *_ in self._boxes]
        at = {tag: i for i, tag in enumerate(tags)}
        base = np.array([at[bases.get(tag, tag)] for tag in tags])
        names = ("tag", "keys", "most", *PRODUCTS)
        step, bits, low = max(1, _STEP // max(1, len(tags))), PLACE_BITS, _PLACES
        codes = F.array(*(axis.code() for axis in self.axes.values()))
        sorted_rows = (
            rows.select(key, F.col(key).isNull().alias("__none"), F.col(hit).cast("int").alias("__hit"), codes.alias("__codes"))
            .repartition(key)
            .sortWithinPartitions(key)
        )

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((len(names) - 1, len(tags)), np.int64)
            last, held = None, None  # the key that was read last, and its rows and hits so far

            def add(n: np.ndarray, h: np.ndarray) -> None:
                bn, bh = n[base], h[base]
                sums[0] += (n > 0).sum(axis=1)
                sums[1] = np.maximum(sums[1], n.max(axis=1, initial=0))
                for i, (a, b) in enumerate(((n, n), (n, h), (h, h), (n, bn), (n, bh), (h, bn), (h, bh)), 2):
                    sums[i] += (a * b).sum(axis=1)

            for whole in batches:
                for start in range(0, whole.num_rows, step):
                    batch = whole.slice(start, step)
                    keys, none = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
                    differs = pc.fill_null(pc.not_equal(keys[1:], keys[:-1]), False).to_numpy(zero_copy_only=False)
                    starts = np.r_[0, 1 + np.flatnonzero(differs | (none[1:] != none[:-1]))]
                    code = pc.fill_null(batch.column(3).flatten(), -1).to_numpy().reshape(batch.num_rows, -1).T
                    known, up, down = code >= 0, code >> bits, code & low
                    inside = np.array([known[a] & ((up if rising else down)[a] <= j) for a, rising, j in chosen])
                    held_by = inside[first] & inside[second]
                    hits = held_by & (batch.column(2).to_numpy() > 0)
                    n, h = (
                        np.add.reduceat(x.view(np.uint8), starts, axis=1, dtype=np.int32).astype(np.int64)
                        for x in (held_by, hits)
                    )
                    if held is not None:
                        if last == (keys[0].as_py(), bool(none[0])):
                            n[:, 0] += held[0]
                            h[:, 0] += held[1]
                        else:
                            add(held[0][:, None], held[1][:, None])
                    add(n[:, :-1], h[:, :-1])
                    last, held = (keys[-1].as_py(), bool(none[-1])), (n[:, -1].copy(), h[:, -1].copy())
            if held is not None:
                add(held[0][:, None], held[1][:, None])
            columns = [np.array(tags, np.int64), *sums]
            yield pa.RecordBatch.from_arrays([pa.array(c[sums[0] > 0]) for c in columns], names=list(names))

        parts = sorted_rows.mapInArrow(run, ", ".join(f"{name} long" for name in names))
        added = [F.sum(c).alias(c) for c in ("keys", *PRODUCTS)]
        return parts.groupBy("tag").agg(F.max("most").alias("most"), *added)

    def met(self, cells: DataFrame, wanted: DataFrame) -> DataFrame:
        """Cells joined with the rows of ``wanted`` (``tag`` and any keys that both have; a few
        for each box) whose boxes hold them."""
        corners = self.corners(cells.sparkSession)
        keys = ["grid", *(c for c in wanted.columns if c in cells.columns and c != "tag")]

        def inside(up: str, code: str, j: str) -> Column:
            place = F.when(F.col(up), F.shiftright(code, PLACE_BITS)).otherwise(
                F.col(code).bitwiseAND(F.lit(_PLACES))
            )
            return place <= F.col(j)

        tagged = wanted.join(F.broadcast(corners), "tag")
        held = cells.join(F.broadcast(tagged), keys).where(inside("up1", "c1", "j1") & inside("up2", "c2", "j2"))
        return held.drop("grid", "up1", "up2", "j1", "j2", "c1", "c2")


def _running(df: DataFrame, group: list[str], place: str, size: str, totals: Mapping[str, Column]) -> DataFrame:
    """Running totals along ``place``, with a row for every place from the first one on."""
    order = Window.partitionBy(*group).orderBy(place)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    summed = df.withColumns(
        {
            **{c: total.over(upto) for c, total in totals.items()},
            "__next": F.coalesce(F.lead(place).over(order), F.col(size)),
        }
    )
    return summed.withColumn(place, F.explode(F.sequence(F.col(place), F.col("__next") - 1))).drop("__next")
