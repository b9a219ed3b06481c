"""Rolling, cumulative and shifted columns per group.

``order_by`` orders the rows of a group; ``tie_break`` columns make that order total.
``max_group_rows`` is a bound the caller can prove - a panel keyed by (entity, session)
has at most one row per session. Without it the layout is chosen by size.
"""

from __future__ import annotations

import bisect
import functools
import math
from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.functions.dates import as_date, compact, date_offset
from panelspark.functions.semantics import divide, dtype, key_join, number, ordering
from panelspark.operators.layout import Layout, lay_out
from panelspark.operators.sessions import with_session_number

_RANK = "__session"
#: Windows up to this many rows are added up anew for each row, in one pass; longer ones slide.
SHORT_WINDOW = 64
#: Statistics of the last rows of a group.
ROLLING = ("mean", "sum", "min", "max", "std", "quantile", "correlation", "covariance")


def ordered(
    df: DataFrame,
    group_by: Sequence[str],
    order_by: str,
    tie_break: Sequence[str] = (),
    *,
    direction: str = "asc",
    max_group_rows: int | None = None,
    block_rows: int | None = None,
) -> Layout:
    """Layout by one order key (missing last) and its tie-breaks."""
    key = ordering(df, order_by)
    first = key.asc_nulls_last() if direction == "asc" else key.desc_nulls_last()
    return lay_out(
        df,
        group_by,
        [first, *[F.col(c).asc_nulls_last() for c in tie_break]],
        max_group_rows=max_group_rows,
        block_rows=block_rows,
    )


def _short_value(
    function: str, x: Column, y: Column | None, q: float | None, frame: WindowSpec
) -> tuple[Column, Column]:
    """The windowed value and the windowed count of usable observations."""
    if function in ("correlation", "covariance"):
        both = x.isNotNull() & y.isNotNull()
        px, py = F.when(both, x), F.when(both, y)
        value = F.covar_samp(px, py).over(frame)
        if function == "correlation":
            spread = F.stddev_samp(px).over(frame) * F.stddev_samp(py).over(frame)
            value = F.try_divide(value, spread)
        return value, F.count(px).over(frame)
    simple = {
        "mean": F.avg,
        "sum": F.sum,
        "min": F.min,
        "max": F.max,
        "std": F.stddev_samp,
    }
    if function == "quantile":
        value = F.percentile(x, float(q)).over(frame)
    else:
        value = simple[function](x).over(frame)
    return value, F.count(x).over(frame)


def _slid(values: np.ndarray, window: int, op: np.ufunc, empty: float) -> np.ndarray:
    """``op`` over the last ``window`` values at each place: the rest of one stretch of that
    length and the beginning of the next, so an infinity stays in the windows that hold it."""
    n = len(values)
    stretches = np.full(-(-n // window) * window, empty)
    stretches[:n] = values
    stretches = stretches.reshape(-1, window)
    begun = op.accumulate(stretches, axis=1).ravel()[:n]
    rest = np.full(stretches.shape, empty)
    rest[:, :-1] = op.accumulate(stretches[:, :0:-1], axis=1)[:, ::-1]
    before = np.full(n, empty)
    before[window:] = rest.ravel()[: max(0, n - window)]
    return op(before, begun)


def _added(x: np.ndarray, y: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Moments of the first values of each row (a stretch), value after value: number, means, and
    sums of squares and products about the means. Stretches are added up side by side."""
    stretches, window = x.shape
    out = np.zeros((6, window, stretches))
    n, mx, my, qx, qy, xy = np.zeros((6, stretches))
    for place in range(window):
        k = known[:, place].astype(float)
        n = n + k
        share = k / np.maximum(n, 1)
        dx, dy = x[:, place] - mx, y[:, place] - my
        mx, my = mx + dx * share, my + dy * share
        rest = (y[:, place] - my) * k
        qx, qy, xy = qx + dx * (x[:, place] - mx) * k, qy + dy * rest, xy + dx * rest
        out[:, place] = n, mx, my, qx, qy, xy
    return out.transpose(0, 2, 1)


def _moments(x: np.ndarray, y: np.ndarray, known: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Over each window, the sums of squares of ``x`` and ``y`` and of their products, about the
    means: of the rest of one stretch and of the beginning of the next."""
    rows = len(x)

    def stretches(values: np.ndarray) -> np.ndarray:
        out = np.zeros(-(-rows // window) * window, values.dtype)
        out[:rows] = values
        return out.reshape(-1, window)

    x, y, known = stretches(np.where(known, x, 0.0)), stretches(np.where(known, y, 0.0)), stretches(known)
    begun = _added(x, y, known).reshape(6, -1)[:, :rows]
    rest = np.zeros((6, *x.shape))
    rest[:, :, :-1] = _added(x[:, :0:-1], y[:, :0:-1], known[:, :0:-1])[:, :, ::-1]
    before = np.zeros((6, rows))
    before[:, window:] = rest.reshape(6, -1)[:, : max(0, rows - window)]
    na, nb = before[0], begun[0]
    weight = na * nb / np.maximum(na + nb, 1)
    gap_x, gap_y = begun[1] - before[1], begun[2] - before[2]
    return tuple(
        before[i] + begun[i] + np.where(weight > 0, gap * weight, 0.0)
        for i, gap in ((3, gap_x * gap_x), (4, gap_y * gap_y), (5, gap_x * gap_y))
    )


def _long_statistic(function: str, x: np.ndarray, y: np.ndarray, known: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The statistic (NaN for none) and the number of known values over each window of a run."""
    window = min(window, len(x))
    with np.errstate(all="ignore"):
        n = _slid(known.astype(float), window, np.add, 0.0)

        def extreme(values: np.ndarray, op: np.ufunc, empty: float) -> np.ndarray:
            return _slid(np.where(known, values, empty), window, op, empty)

        if function in ("mean", "sum"):
            total = _slid(np.where(known, x, 0.0), window, np.add, 0.0)
            value = total / n if function == "mean" else total
        elif function in ("min", "max"):
            value = extreme(x, *((np.minimum, np.inf) if function == "min" else (np.maximum, -np.inf)))
        else:
            qx, qy, xy = _moments(x, y, known, window)

            def deviation(values: np.ndarray, q: np.ndarray) -> np.ndarray:
                # Equal values have no spread, whatever the last digits of their mean.
                flat = extreme(values, np.minimum, np.inf) == extreme(values, np.maximum, -np.inf)
                return np.where(flat, 0.0, np.sqrt(np.maximum(q, 0.0) / (n - 1)))

            if function == "std":
                value = deviation(x, qx)
            else:
                value = xy / (n - 1)
                if function == "correlation":
                    spread = deviation(x, qx) * deviation(y, qy)
                    value = np.where(spread != 0, value / spread, np.nan)
            value = np.where(n > 1, value, np.nan)
        return np.where(n > 0, value, np.nan), n.astype(np.int64)


def _long_value(
    layout: Layout, function: str, x: Column, y: Column | None, window: int
) -> tuple[DataFrame, Column, Column]:
    """The same for a long window: tasks read runs of rows in order, each once, and hold one."""
    frame, own = layout.chained(window, "__row")
    other = x if y is None else y
    frame = frame.withColumns({"__x": x.cast("double"), "__y": other.cast("double"), "__own": own})
    schema = T.StructType([*frame.schema.fields, T.StructField("__q", T.DoubleType()), T.StructField("__n", T.LongType())])
    number = frame.columns.index("__row")

    def worked(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = pa.Table.from_batches(held)
        a, b = (run.column(c).to_numpy().astype(np.float64) for c in ("__x", "__y"))
        known = np.asarray(run.column("__x").is_valid()) & np.asarray(run.column("__y").is_valid())
        value, n = _long_statistic(function, a, b, known, window)
        empty = np.isnan(value) & (n == 0) if function in ("mean", "sum", "min", "max") else np.isnan(value)
        run = run.append_column("__q", pa.array(value, pa.float64(), mask=empty)).append_column("__n", pa.array(n, pa.int64()))
        yield from run.to_batches(max_chunksize=10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            starts = np.flatnonzero(batch.column(number).to_numpy() == 1).tolist()
            for low, high in zip([0, *starts], [*starts, batch.num_rows]):
                if low in starts and held:
                    yield from worked(held)
                    held = []
                if high > low:
                    held.append(batch.slice(low, high - low))
        if held:
            yield from worked(held)

    return frame.mapInArrow(run, schema).where("__own"), F.col("__q"), F.col("__n")


class _Ordered:
    """The values of a window in order, in short lists: one in, one out, and any position."""

    def __init__(self) -> None:
        self.lists: list[list[float]] = []
        self.tops: list[float] = []
        self.size = 0

    def add(self, value: float) -> None:
        self.size += 1
        if not self.lists:
            self.lists, self.tops = [[value]], [value]
            return
        at = min(bisect.bisect_left(self.tops, value), len(self.lists) - 1)
        some = self.lists[at]
        bisect.insort(some, value)
        if len(some) > 2 * _LIST:
            self.lists[at : at + 1] = some[:_LIST], some[_LIST:]
            self.tops[at : at + 1] = some[_LIST - 1], some[-1]
        else:
            self.tops[at] = some[-1]

    def remove(self, value: float) -> None:
        self.size -= 1
        at = bisect.bisect_left(self.tops, value)
        some = self.lists[at]
        del some[bisect.bisect_left(some, value)]
        if some:
            self.tops[at] = some[-1]
        else:
            del self.lists[at], self.tops[at]

    def at(self, position: int) -> float:
        for some in self.lists:
            if position < len(some):
                return some[position]
            position -= len(some)
        raise IndexError(position)

    def quantile(self, q: float) -> float:
        place = (self.size - 1) * q
        low = math.floor(place)
        a = self.at(low)
        return a if place == low else a + (self.at(low + 1) - a) * (place - low)


#: Values in one short list of a window, about.
_LIST = 512


def _long_quantile(layout: Layout, x: Column, q: float, window: int) -> tuple[DataFrame, Column, Column]:
    """The quantile of the last ``window`` rows' values, and their number: tasks read rows in
    order and hold one window, whose values enter and leave one by one."""
    frame, own = layout.chained(window, "__row")
    frame = frame.withColumns({"__x": x.cast("double"), "__own": own})
    schema = T.StructType([*frame.schema.fields, T.StructField("__q", T.DoubleType()), T.StructField("__n", T.LongType())])
    place, number = frame.columns.index("__x"), frame.columns.index("__row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: deque[float | None] = deque()
        values = _Ordered()
        for batch in batches:
            found, counts = [], []
            for value, row in zip(batch.column(place).to_pylist(), batch.column(number).to_pylist()):
                if row == 1:
                    held, values = deque(), _Ordered()
                held.append(value)
                if value is not None:
                    values.add(value)
                if len(held) > window and (gone := held.popleft()) is not None:
                    values.remove(gone)
                found.append(values.quantile(q) if values.size else None)
                counts.append(values.size)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.float64()), pa.array(counts, pa.int64())],
                names=[*batch.schema.names, "__q", "__n"],
            )

    return frame.mapInArrow(run, schema).where("__own"), F.col("__q"), F.col("__n")


def rolling(
    df: DataFrame,
    function: str,
    output: str,
    field: str,
    group_by: Sequence[str],
    order_by: str,
    window: int,
    *,
    min_periods: int | None = None,
    right_field: str | None = None,
    q: float | None = None,
    require_consecutive: bool = False,
    sessions: DataFrame | None = None,
    tie_break: Sequence[str] = (),
    max_group_rows: int | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """A statistic over the last ``window`` rows of the group.

    The result is missing until ``min_periods`` (default: the whole window) values are
    present. ``require_consecutive`` also blanks a window whose rows skip a session
    that exists elsewhere in the frame.
    """
    if function not in ROLLING:
        raise ValueError(f"unknown rolling function: {function}")
    if window < 2:
        raise ValueError("a window has two rows at least")
    if min_periods is not None and not 1 <= min_periods <= window:
        raise ValueError("min_periods must be between 1 and window")
    if (function in ("correlation", "covariance")) != (right_field is not None):
        raise ValueError("correlation and covariance take two fields, the rest one")
    if right_field == field:
        raise ValueError("the two fields must differ")
    if (function == "quantile") != (q is not None):
        raise ValueError("q belongs to the quantile function")
    columns = df.columns
    source = with_session_number(df, order_by, _RANK, sessions) if require_consecutive else df
    x = number(df, field)
    y = number(df, right_field) if right_field else None
    layout = ordered(
        source, group_by, order_by, tie_break, max_group_rows=max_group_rows, block_rows=block_rows
    )

    kept = [c for c in columns if c != output]
    if window <= SHORT_WINDOW and (not layout.split or window <= layout.block_rows):

        def build(base: WindowSpec) -> dict[str, Column]:
            value, present = _short_value(function, x, y, q, base.rowsBetween(-(window - 1), 0))
            enough = present >= (min_periods or window)
            if require_consecutive:
                first = F.lag(_RANK, window - 1).over(base)
                enough = enough & (F.col(_RANK) - first == window - 1)
            return {output: F.when(enough, value)}

        return layout.framed(build, back=window - 1).select(*kept, output)
    if require_consecutive:
        layout = layout.fetched({"__first": F.col(_RANK)}, window - 1)
    if function == "quantile":
        frame, value, present = _long_quantile(layout, x, float(q), window)
    else:
        frame, value, present = _long_value(layout, function, x, y, window)
    enough = present >= (min_periods or window)
    if require_consecutive:
        enough = enough & (F.col(_RANK) - F.col("__first") == window - 1)
    return frame.select(*kept, F.when(enough, value).alias(output))


def shifted(
    df: DataFrame,
    function: str,
    output: str,
    field: str,
    group_by: Sequence[str],
    order_by: str,
    periods: int = 1,
    *,
    require_consecutive: bool = False,
    sessions: DataFrame | None = None,
    tie_break: Sequence[str] = (),
    max_group_rows: int | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """``shift``, ``diff`` or ``pct_change`` against the row ``periods`` earlier.

    Negative periods look ahead. With ``require_consecutive`` both rows must lie
    exactly that many sessions apart.
    """
    if function not in ("shift", "diff", "pct_change"):
        raise ValueError(f"unknown shift function: {function}")
    if periods == 0:
        raise ValueError("periods must not be 0")
    columns = df.columns
    source = with_session_number(df, order_by, _RANK, sessions) if require_consecutive else df
    x = F.col(field) if function == "shift" else number(df, field)
    layout = ordered(
        source, group_by, order_by, tie_break, max_group_rows=max_group_rows, block_rows=block_rows
    )

    def shown(there: Column, rank: Column | None) -> Column:
        if function == "shift":
            value = there
        else:
            value = x - there if function == "diff" else divide(x, there) - 1
        return value if rank is None else F.when(F.col(_RANK) - rank == periods, value)

    def build(base: WindowSpec) -> dict[str, Column]:
        def other(column: Column) -> Column:
            moved = F.lag(column, periods) if periods > 0 else F.lead(column, -periods)
            return moved.over(base)

        return {output: shown(other(x), other(F.col(_RANK)) if require_consecutive else None)}

    kept = [c for c in columns if c != output]
    if layout.split and abs(periods) >= layout.block_rows:
        other = {"__other": x, **({"__rank": F.col(_RANK)} if require_consecutive else {})}
        frame = layout.fetched(other, periods).frame
        value = shown(F.col("__other"), F.col("__rank") if require_consecutive else None)
        return frame.select(*kept, value.alias(output))
    framed = layout.framed(build, back=max(periods, 0), ahead=max(-periods, 0))
    return framed.select(*kept, output)


def cumulative_sum(
    df: DataFrame,
    output: str,
    field: str,
    group_by: Sequence[str],
    order_by: str,
    *,
    tie_break: Sequence[str] = (),
    **layout_options,
) -> DataFrame:
    """Running total; a missing value stays missing and the total goes on."""
    x = number(df, field)
    summed = ordered(df, group_by, order_by, tie_break, **layout_options).running({"__sum": x})
    return summed.withColumn(output, F.when(x.isNotNull(), F.col("__sum"))).drop("__sum")


def expanding_mean(
    df: DataFrame,
    output: str,
    field: str,
    group_by: Sequence[str],
    order_by: str,
    *,
    min_periods: int = 1,
    tie_break: Sequence[str] = (),
    **layout_options,
) -> DataFrame:
    """Mean of all values so far, once ``min_periods`` of them are present."""
    x = number(df, field)
    summed = ordered(df, group_by, order_by, tie_break, **layout_options).running(
        {"__sum": x, "__n": F.when(x.isNotNull(), 1).otherwise(0)}
    )
    mean = F.when(F.col("__n") >= min_periods, F.try_divide(F.col("__sum"), F.col("__n")))
    return summed.withColumn(output, mean).drop("__sum", "__n")


def _target_sessions(days: DataFrame, amount: int, unit: str) -> DataFrame:
    """``(__day, __target)``: where an offset from each session lands.

    ``days`` is a calendar table (at most DATE_VALUES rows), so one task may sort it.
    A calendar offset snaps forward to the next session.
    """
    by_day = Window.orderBy("__day")
    if unit == "trading_session":
        return days.withColumn("__target", F.lead("__day", amount).over(by_day))
    wanted = days.withColumn("__at", date_offset(F.col("__day"), amount, unit))
    marks = wanted.select(
        "__at", F.col("__day"), F.lit(None).cast("date").alias("__session_day")
    ).unionByName(
        days.select(
            F.col("__day").alias("__at"),
            F.lit(None).cast("date").alias("__day"),
            F.col("__day").alias("__session_day"),
        )
    )
    onward = Window.orderBy("__at").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    return (
        marks.withColumn("__target", F.min("__session_day").over(onward))
        .where(F.col("__day").isNotNull())
        .select("__day", "__target")
    )


def match_at_offset(
    df: DataFrame,
    output: str,
    matched_date: str,
    field: str,
    group_by: Sequence[str],
    order_by: str,
    offset: int,
    unit: str,
    *,
    tie_break: Sequence[str] = (),
    null_keys: bool = True,
    sessions: DataFrame | None = None,
) -> DataFrame:
    """The same group's value at a later session, and the date it was found on.

    Sessions are those of the DATE column ``session`` of ``sessions``, or else the distinct
    dates of the whole frame, which costs one more pass over it. If the group has no row on the
    target session both outputs are missing. Several rows of a group on one session need
    a ``tie_break``, whose last row counts; without one they fail the job.
    """
    if offset < 1:
        raise ValueError("offset must be positive")
    dated = df.withColumn("__day", as_date(df, order_by))
    if sessions is None:
        days = dated.select("__day")
    elif isinstance(dtype(sessions, "session"), T.DateType):
        days = sessions.select(F.col("session").alias("__day"))
    else:
        # Only dates bound what is broadcast.
        raise ValueError("a calendar's sessions are dates")
    days = days.where(F.col("__day").isNotNull()).distinct()
    targets = F.broadcast(_target_sessions(days, offset, unit))
    placed = dated.join(targets, "__day", "left")
    rest = [c for c in df.columns if c not in (output, matched_date)]
    if not tie_break:
        return _met_in_one_shuffle(placed, df, output, matched_date, field, group_by, null_keys, rest)
    lookup = (
        dated.where(F.col("__day").isNotNull())
        .groupBy(*group_by, F.col("__day").alias("__target"))
        .agg(F.max_by(field, F.struct(*tie_break)).alias(output))
        .withColumn(matched_date, compact(F.col("__target")))
    )
    keys = [*group_by, "__target"]
    found = key_join(
        placed.select(*rest, "__target"), lookup, keys, "left", [output, matched_date], null_keys=null_keys
    )
    return found.drop("__target")


def _met_in_one_shuffle(
    placed: DataFrame,
    df: DataFrame,
    output: str,
    matched_date: str,
    field: str,
    group_by: Sequence[str],
    null_keys: bool,
    rest: list[str],
) -> DataFrame:
    """Every row as a question for its target session and as the answer for its own day, met by
    (group, session). A group has one row a day, so a meeting has one answer, and as many
    questions as days lead to the session."""
    asked = F.struct(F.col("__target").alias("__at"), F.lit(True).alias("__asks"))
    answer = F.struct(F.col("__day").alias("__at"), F.lit(False).alias("__asks"))
    both = placed.withColumn("__role", F.explode(F.array(asked, answer)))
    both = both.where(F.col("__role.__asks") | F.col("__role.__at").isNotNull())
    both = both.select(*df.columns, "__role.*")
    # Questions without a session stand apart, lest they all meet under null.
    lost, met = both.where("__at IS NULL"), both.where("__at IS NOT NULL")
    meeting = Window.partitionBy(*group_by, "__at")
    several = F.raise_error(F.lit("several rows on one session need a tie_break")).cast("boolean")
    answers = F.sum(F.when(F.col("__asks"), 0).otherwise(1)).over(meeting)
    value = F.max(F.when(~F.col("__asks"), F.struct(F.col(field).alias("v")))).over(meeting)
    matched = (F.col("__answers") == 1) if null_keys else functools.reduce(
        Column.__and__, [F.col(k).isNotNull() for k in group_by], F.col("__answers") == 1
    )
    met = met.withColumns({"__answers": answers, "__value": value})
    # Checked in the rows that are kept and in those that are not.
    met = met.where(F.when(F.col("__answers") > 1, several).otherwise(F.col("__asks")))
    met = met.select(
        *rest,
        F.when(matched, F.col("__value.v")).alias(output),
        F.when(matched, compact(F.col("__at"))).alias(matched_date),
    )
    kind = df.schema[field].dataType
    nothing = [F.lit(None).cast(kind).alias(output), F.lit(None).cast("string").alias(matched_date)]
    return met.unionByName(lost.select(*rest, *nothing))
