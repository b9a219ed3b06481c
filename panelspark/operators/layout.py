"""Order rows inside groups without putting a large group in one task.

``Window.partitionBy(group).orderBy(...)`` sends each group to a single task. That is
the right plan when groups are known to be small: a panel keyed by (entity, session)
has at most one row per session, and sessions are calendar days. It is the wrong plan
when one group may hold a third of the table. ``lay_out`` picks between

* **plain** - one window per group, when the caller proves a bound on group size, or when
  one map-side-combined count shows that the largest group fits one task;
* **split** - range-partition on (group, order), store, and give every row its
  exact position in its group as "rows of the group in earlier partitions" plus "row
  number inside this partition". Positions cut a group into blocks of ``block_rows``.
  Row frames read a copied edge of the neighbouring block; running totals add a
  per-block carry. Every task handles one partition or one block.

Both plans give the same rows, which the tests check by forcing the second one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelspark.functions.semantics import key_join
from panelspark.session import stored

POSITION, BLOCK = "__position", "__block"
_CHUNK, _SALT, _HOME, _START = "__chunk", "__salt", "__home", "__start"
_STRETCH, _PLACE, _FIRST = "__stretch", "__place", "__first_place"

ONE_TASK_ROWS = 4_000_000
BLOCK_ROWS = 1_000_000
#: Pieces of groups by partition whose places are broadcast; with more, rows are numbered by a window.
FEW_PIECES = 20_000


def _moments(column: Column, over: WindowSpec | None) -> Column:
    """Number, means, and sums of squares and products about the means of ``x`` and ``y``."""
    x, y = column["x"], column["y"]
    total = (lambda c: c) if over is None else (lambda c: c.over(over))
    n = total(F.count(x)).cast("double")
    about = {"qx": F.var_pop(x), "qy": F.var_pop(y), "xy": F.covar_pop(x, y)}
    return F.struct(
        n.alias("n"),
        total(F.avg(x)).alias("x"),
        total(F.avg(y)).alias("y"),
        *[(total(c) * n).alias(name) for name, c in about.items()],
    )


def _both_moments(a: Column, b: Column) -> Column:
    """Moments of two sets of rows; sums about different means add up with their distance."""
    n = a["n"] + b["n"]
    weight = a["n"] * b["n"] / n
    x, y = b["x"] - a["x"], b["y"] - a["y"]
    merged = F.struct(
        n.alias("n"),
        (a["x"] + x * b["n"] / n).alias("x"),
        (a["y"] + y * b["n"] / n).alias("y"),
        (a["qx"] + b["qx"] + x * x * weight).alias("qx"),
        (a["qy"] + b["qy"] + y * y * weight).alias("qy"),
        (a["xy"] + b["xy"] + x * y * weight).alias("xy"),
    )
    return F.when(F.coalesce(a["n"], F.lit(0)) == 0, b).when(F.coalesce(b["n"], F.lit(0)) == 0, a).otherwise(merged)


def _total(kind: str, column: Column, over: WindowSpec | None = None) -> Column:
    """An aggregate of a column, or of a struct of ``x`` and ``y`` for moments."""
    if kind == "moments":
        return _moments(column, over)
    value = {"sum": F.sum, "min": F.min, "max": F.max}[kind](column)
    return value if over is None else value.over(over)


def _merged(kind: str, a: Column, b: Column) -> Column:
    """Two aggregates of neighbouring rows as one; null is an aggregate of nothing."""
    if kind == "moments":
        return _both_moments(a, b)
    return {"sum": F.coalesce(a + b, a, b), "min": F.least(a, b), "max": F.greatest(a, b)}[kind]


def group_sizes(df: DataFrame, group_by: Sequence[str]) -> tuple[int, int]:
    """Rows in the largest group and in all: one scan, counted before the shuffle."""
    if not group_by:
        total = df.count()
        return total, total
    sizes = df.groupBy(*group_by).agg(F.count(F.lit(1)).alias("n"))
    largest, total = sizes.agg(F.max("n"), F.sum("n")).first()
    return int(largest or 0), int(total or 0)


def proven_small(max_group_rows: int | None) -> bool:
    """Whether the caller's bound shows, without a job, that every group fits one task.

    Catalyst's size in bytes is no such bound: it is that of compressed files.
    """
    return max_group_rows is not None and max_group_rows <= ONE_TASK_ROWS


def fits_one_task(
    df: DataFrame, group_by: Sequence[str], max_group_rows: int | None = None
) -> bool:
    """The same, measuring the largest group where no bound settles it."""
    return proven_small(max_group_rows) or group_sizes(df, group_by)[0] <= ONE_TASK_ROWS


@dataclass(frozen=True)
class Layout:
    """A frame whose rows have an order inside each group."""

    frame: DataFrame
    group_by: tuple[str, ...]
    order: tuple[Column, ...]
    block_rows: int | None = None
    _inner: tuple[str, ...] = field(default=(POSITION, BLOCK))

    @property
    def split(self) -> bool:
        return self.block_rows is not None

    @property
    def plain(self) -> DataFrame:
        """The frame without the layout's own columns."""
        return self.frame.drop(*self._inner, _HOME)

    def numbered(self, output: str) -> DataFrame:
        """Add the 1-based position of each row in its group."""
        if self.split:
            return self.frame.withColumn(output, F.col(POSITION)).drop(*self._inner)
        window = Window.partitionBy(*self.group_by).orderBy(*self.order)
        return self.frame.withColumn(output, F.row_number().over(window).cast("long"))

    def framed(
        self, build: Callable[[WindowSpec], dict[str, Column]], *, back: int = 0, ahead: int = 0
    ) -> DataFrame:
        """Add window columns that look at most ``back`` / ``ahead`` rows away.

        ``build`` receives the ordered window and returns the columns to add.
        """
        if not self.split:
            return self.frame.withColumns(
                build(Window.partitionBy(*self.group_by).orderBy(*self.order))
            )
        if max(back, ahead) >= self.block_rows:
            raise ValueError("a longer window needs sliding() or fetched()")
        within = (F.col(POSITION) - 1) % self.block_rows
        homes = F.array_compact(
            F.array(
                F.col(BLOCK),
                F.when(within >= self.block_rows - back, F.col(BLOCK) + 1),
                F.when((within < ahead) & (F.col(BLOCK) > 0), F.col(BLOCK) - 1),
            )
        )
        window = Window.partitionBy(*self.group_by, _HOME).orderBy(POSITION)
        return (
            self.frame.withColumn(_HOME, F.explode(homes))
            .withColumns(build(window))
            .where(F.col(_HOME) == F.col(BLOCK))
            .drop(_HOME, *self._inner)
        )

    def fetched(self, values: dict[str, Column], periods: int) -> Layout:
        """Add the values that lie ``periods`` rows before (negative: after) each row."""
        order = (lambda column: F.lag(column, periods)) if periods > 0 else (lambda column: F.lead(column, -periods))
        if not self.split:
            window = Window.partitionBy(*self.group_by).orderBy(*self.order)
            return replace(self, frame=self.frame.withColumns({n: order(v).over(window) for n, v in values.items()}))
        there = self.frame.select(
            *self.group_by,
            (F.col(POSITION) + periods).alias(POSITION),
            *[v.alias(n) for n, v in values.items()],
        )
        kept = self.frame.drop(*values)
        return replace(self, frame=key_join(kept, there, [*self.group_by, POSITION], "left", list(values)))

    def sliding(self, length: int, states: Mapping[str, tuple[str, Column]]) -> Layout:
        """Add aggregates over the last ``length`` rows: a kind (``sum``, ``min``, ``max`` or
        ``moments``) and a column for each name."""
        # Rows that are equal in the order must not change places between the steps below.
        layout = self if self.split else replace(
            self, frame=self.numbered(POSITION), order=(F.col(POSITION).asc(),)
        )
        piece = [*self.group_by, _STRETCH, *([BLOCK] if self.split else [])]
        stretch = F.floor((F.col(POSITION) - 1) / length).cast("long")
        frame = layout.frame.withColumns(
            {_STRETCH: stretch, **{f"__v_{n}": column for n, (_, column) in states.items()}}
        )
        start = Window.partitionBy(*piece).orderBy(POSITION).rowsBetween(Window.unboundedPreceding, 0)
        end = Window.partitionBy(*piece).orderBy(F.desc(POSITION)).rowsBetween(Window.unboundedPreceding, -1)
        summed = frame.withColumns(
            {
                f"__{side}_{n}": _total(kind, F.col(f"__v_{n}"), rows)
                for n, (kind, _) in states.items()
                for side, rows in (("in", start), ("out", end))
            }
        )
        kinds = {n: kind for n, (kind, _) in states.items()}
        if self.split:
            summed = self._between_pieces(frame, summed, piece, kinds)
        summed = summed.drop(_STRETCH, *[f"__v_{n}" for n in states])
        outs = {f"__out_{n}": F.col(f"__out_{n}") for n in states}
        moved = replace(layout, frame=summed).fetched(outs, length).frame
        merged = moved.withColumns(
            {n: _merged(kind, F.col(f"__out_{n}"), F.col(f"__in_{n}")) for n, kind in kinds.items()}
        ).drop(*outs, *[f"__in_{n}" for n in states])
        return replace(self, frame=merged if self.split else merged.drop(POSITION))

    def _between_pieces(
        self, frame: DataFrame, summed: DataFrame, piece: list[str], kinds: Mapping[str, str]
    ) -> DataFrame:
        """Add what the other blocks of a stretch hold: those before for sums from its start,
        those after for sums to its end. One small row per piece."""
        stretch = Window.partitionBy(*self.group_by, _STRETCH).orderBy(BLOCK)
        others = {
            "in": stretch.rowsBetween(Window.unboundedPreceding, -1),
            "out": stretch.rowsBetween(1, Window.unboundedFollowing),
        }

        def carried(name: str, kind: str, rows: WindowSpec) -> Column:
            if kind != "moments":
                return _total(kind, F.col(f"__v_{name}"), rows)
            # As many as a stretch has blocks.
            nothing = F.struct(*[F.lit(0.0).alias(f) for f in ("n", "x", "y", "qx", "qy", "xy")])
            return F.aggregate(F.collect_list(f"__v_{name}").over(rows), nothing, _both_moments)

        totals = frame.groupBy(*piece).agg(
            *[_total(kind, F.col(f"__v_{n}")).alias(f"__v_{n}") for n, kind in kinds.items()]
        )
        names = {f"__c_{side}_{n}": (n, kind, side) for n, kind in kinds.items() for side in others}
        carry = totals.withColumns({c: carried(n, kind, others[side]) for c, (n, kind, side) in names.items()})
        joined = key_join(summed, carry, piece, "left", list(names))

        def whole(name: str, kind: str, side: str) -> Column:
            here, there = F.col(f"__{side}_{name}"), F.col(f"__c_{side}_{name}")
            return _merged(kind, there, here) if side == "in" else _merged(kind, here, there)

        return joined.withColumns({f"__{side}_{n}": whole(n, kind, side) for n, kind, side in names.values()}).drop(*names)

    def chained(self, length: int, number: str) -> tuple[DataFrame, Column]:
        """The frame in runs that a task can read row after row: ``number`` counts a run's rows
        from 1, and the returned condition tells rows from copies of up to ``length - 1`` rows
        before a run, which it needs to begin."""
        if not self.split:
            return self.numbered(number), F.lit(True)
        size = max(self.block_rows, length)
        run, inside = F.floor((F.col(POSITION) - 1) / size), (F.col(POSITION) - 1) % size
        homes = F.array_compact(F.array(run, F.when(inside > size - length, run + 1)))
        copied = self.frame.withColumn(_HOME, F.explode(homes))
        window = Window.partitionBy(*self.group_by, _HOME).orderBy(POSITION)
        return copied.withColumn(number, F.row_number().over(window).cast("long")), F.col(_HOME) == run

    def running(self, totals: dict[str, Column]) -> DataFrame:
        """Add running sums over the group up to and including the current row.

        ``totals`` maps output names to the numeric column to add up. A sum over no
        value is null.
        """
        names = list(totals)
        source = self.frame.withColumns({f"__x_{n}": c for n, c in totals.items()})
        helpers = [f"__x_{n}" for n in names]
        if not self.split:
            window = (
                Window.partitionBy(*self.group_by)
                .orderBy(*self.order)
                .rowsBetween(Window.unboundedPreceding, 0)
            )
            return source.withColumns(
                {n: F.sum(f"__x_{n}").over(window) for n in names}
            ).drop(*helpers)
        inside = (
            Window.partitionBy(*self.group_by, BLOCK)
            .orderBy(POSITION)
            .rowsBetween(Window.unboundedPreceding, 0)
        )
        carry = self._carry(
            source.groupBy(*self.group_by, BLOCK).agg(
                *[F.sum(f"__x_{n}").alias(f"__c_{n}") for n in names]
            ),
            {f"__c_{n}": lambda w, n=n: F.sum(f"__c_{n}").over(w) for n in names},
        )
        summed = source.withColumns({n: F.sum(f"__x_{n}").over(inside) for n in names})
        joined = self._with_carry(summed, carry)
        return joined.withColumns(
            {
                n: F.coalesce(F.col(f"__c_{n}") + F.col(n), F.col(f"__c_{n}"), F.col(n))
                for n in names
            }
        ).drop(*helpers, *[f"__c_{n}" for n in names], *self._inner)

    def last_seen(self, value: Column, output: str) -> DataFrame:
        """Add the latest non-null ``value`` at or before the current row."""
        source = self.frame.withColumn("__v", value)
        if not self.split:
            window = (
                Window.partitionBy(*self.group_by)
                .orderBy(*self.order)
                .rowsBetween(Window.unboundedPreceding, 0)
            )
            return source.withColumn(
                output, F.last("__v", ignorenulls=True).over(window)
            ).drop("__v")
        inside = (
            Window.partitionBy(*self.group_by, BLOCK)
            .orderBy(POSITION)
            .rowsBetween(Window.unboundedPreceding, 0)
        )
        carry = self._carry(
            source.where(F.col("__v").isNotNull())
            .groupBy(*self.group_by, BLOCK)
            .agg(F.max_by("__v", POSITION).alias("__c")),
            {"__c": lambda w: F.last("__c", ignorenulls=True).over(w)},
            blocks=source.select(*self.group_by, BLOCK).distinct(),
        )
        seen = source.withColumn(output, F.last("__v", ignorenulls=True).over(inside))
        return (
            self._with_carry(seen, carry)
            .withColumn(output, F.coalesce(output, "__c"))
            .drop("__v", "__c", *self._inner)
        )

    def _carry(
        self,
        per_block: DataFrame,
        combine: dict[str, Callable[[WindowSpec], Column]],
        blocks: DataFrame | None = None,
    ) -> DataFrame:
        """Fold each group's earlier blocks; one small row per block of each group."""
        if blocks is not None:
            per_block = key_join(blocks, per_block, [*self.group_by, BLOCK], "left", list(combine))
        earlier = (
            Window.partitionBy(*self.group_by)
            .orderBy(BLOCK)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        return (
            per_block.withColumns({name: make(earlier) for name, make in combine.items()})
            .where(F.col(BLOCK) > 0)
            .select(*self.group_by, BLOCK, *combine)
        )

    def _with_carry(self, frame: DataFrame, carry: DataFrame) -> DataFrame:
        keys = [*self.group_by, BLOCK]
        return key_join(frame, carry, keys, "left", [c for c in carry.columns if c not in keys])


def lay_out(
    df: DataFrame,
    group_by: Sequence[str],
    order: Sequence[Column],
    *,
    max_group_rows: int | None = None,
    block_rows: int | None = None,
) -> Layout:
    """Choose a layout; ``block_rows`` forces the split one (tests use a tiny value).

    ``max_group_rows`` is a bound the caller can prove, such as the number of sessions.
    """
    keys, order = tuple(group_by), tuple(order)
    total = None
    if block_rows is None:
        if proven_small(max_group_rows):
            return Layout(df, keys, order)
        largest, total = group_sizes(df, keys)
        if largest <= ONE_TASK_ROWS:
            return Layout(df, keys, order)
        block_rows = BLOCK_ROWS
    partitions = max(2, math.ceil((df.count() if total is None else total) / block_rows))
    # The salt spreads rows that are equal on every ordering column, copies included.
    by = [*[F.col(k) for k in keys], *order, F.col(_SALT)]
    # Rows are numbered in the task that sorted them: the lower 33 bits count a partition's rows.
    ranged = stored(
        df.withColumn(_SALT, F.rand(seed=7))
        .repartitionByRange(partitions, *by)
        .sortWithinPartitions(*by)
        .withColumn(_CHUNK, F.spark_partition_id())
        .withColumn(_PLACE, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    earlier = (
        Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    )
    pieces = stored(
        ranged.groupBy(*keys, _CHUNK).agg(F.count(F.lit(1)).alias("n"), F.min(_PLACE).alias(_FIRST))
    )
    starts = pieces.withColumn(_START, F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    if pieces.count() <= FEW_PIECES:
        placed = key_join(ranged, starts, [*keys, _CHUNK], "left", [_START, _FIRST], F.broadcast)
        inside = F.col(_PLACE) - F.col(_FIRST) + 1
    else:
        # Only a group that continues across a partition edge has rows before this partition, so
        # what is broadcast has fewer rows than there are partitions.
        starts = starts.where(F.col(_START) > 0).drop(_FIRST)
        piece = Window.partitionBy(*keys, _CHUNK).orderBy(_PLACE)
        numbered = ranged.withColumn(POSITION, F.row_number().over(piece).cast("long"))
        placed = key_join(numbered, starts, [*keys, _CHUNK], "left", [_START], F.broadcast)
        inside = F.col(POSITION)
    frame = placed.withColumn(POSITION, inside + F.coalesce(_START, F.lit(0))).withColumn(
        BLOCK, F.floor((F.col(POSITION) - 1) / block_rows).cast("long")
    )
    return Layout(frame.select(*df.columns, POSITION, BLOCK), keys, order, block_rows)
