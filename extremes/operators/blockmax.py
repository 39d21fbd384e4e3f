"""Rolling means over many durations and their block maxima."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import least_valid, window_rows


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the next one with underscores that ``df`` has no column of."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def rolling(series: DataFrame, keys: list[str], time: str, value: str, durations: Iterable[float], step: float = 1.0, how: str = "mean", least: int | None = None) -> DataFrame:
    """``series`` with a column ``m_<rows>`` for each duration: the trailing mean or sum, null with too few valid values.

    Needs one row for each time step (see ``regular_axis``). All windows share one shuffle and sort. Sums over 1, 2, 4, ... rows
    are each made of two halves, and a window of those that its length is made of. Nothing is ever subtracted, so a fill
    value, an infinity or NaN counts in the windows that hold it and in no other.
    """
    by_time = Window.partitionBy(*keys).orderBy(time)
    sizes = {d: window_rows(d, step) for d in dict.fromkeys(durations)}
    n_valid = free_name(series, "_n")
    levels = [free_name(series, f"_s{k}_") for k in range(max(sizes.values()).bit_length())]
    before = lambda c, rows: F.coalesce(F.lag(c, rows).over(by_time), F.lit(0.0)) if rows else F.col(c)
    base = series.withColumns({
        levels[0]: F.coalesce(F.col(value).cast("double"), F.lit(0.0)),
        n_valid: F.count(value).over(by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    })
    for k in range(1, len(levels)):
        base = base.withColumn(levels[k], F.col(levels[k - 1]) + before(levels[k - 1], 1 << (k - 1)))
    out = {}
    for rows in sizes.values():
        total, done = None, 0
        for k in range(rows.bit_length()):
            if rows >> k & 1:
                part = before(levels[k], done)
                total, done = part if total is None else total + part, done + (1 << k)
        n = F.col(n_valid) - F.coalesce(F.lag(n_valid, rows).over(by_time), F.lit(0))  # whole numbers
        amount = F.try_divide(total, n) if how == "mean" else total
        out[f"m_{rows}"] = F.when(n >= (least_valid(rows) if least is None else least), amount)
    return base.withColumns(out).drop(*levels, n_valid)


def rolling_in_parts(series: DataFrame, keys: list[str], time: str, value: str, durations: Iterable[float], position: str, part_rows: int | None = None, step: float = 1.0) -> DataFrame:
    """``rolling`` of long series in parts of ``part_rows`` rows, each a task of its own, instead of one task a series.

    ``position`` is the row's place in its series, from 0 (see ``regular_axis``). Each part is handed the rows of the one
    before that its first windows reach back to. A part is eight times the longest window by default, and never shorter than it.
    """
    durations = list(durations)
    longest = max(window_rows(d, step) for d in durations)
    size = max(part_rows or 8 * longest, longest)
    part, own = free_name(series, "_part"), free_name(series, "_own")
    at = F.floor(F.col(position) / size)
    handed = F.when(F.pmod(F.col(position), F.lit(size)) > size - longest, F.array(at, at + 1)).otherwise(F.array(at))
    dealt = series.withColumn(part, F.explode(handed)).withColumn(own, F.col(part) == at)
    return rolling(dealt, [*keys, part], time, value, durations, step).where(own).drop(part, own)


def rolling_frames(series: DataFrame, keys: list[str], time: str, value: str, durations: Iterable[float], step: float = 1.0) -> DataFrame:
    """The definition of ``rolling`` by row frames; for tests."""
    out = {}
    for d in durations:
        rows = window_rows(d, step)
        w = Window.partitionBy(*keys).orderBy(time).rowsBetween(-(rows - 1), 0)
        out[f"m_{rows}"] = F.when(F.count(value).over(w) >= least_valid(rows), F.avg(value).over(w))
    return series.withColumns(out)


def block_maxima(
    series: DataFrame, keys: list[str], time: str, value: str, block: str, durations: Iterable[float], step: float = 1.0, across_blocks: bool = False,
    position: str | None = None, part_rows: int | None = None,
) -> DataFrame:
    """``(keys, duration, block, annual_max)``: the largest rolling mean that ends in each block.

    Windows start anew with each block, or run through block ends with ``across_blocks``; given the ``position`` of rows, series are then
    cut into parts (see ``rolling_in_parts``). A block without a valid window has a null maximum.
    """
    durations = list(dict.fromkeys(durations))
    if across_blocks and position:
        rolled = rolling_in_parts(series, keys, time, value, durations, position, part_rows, step)
    else:
        rolled = rolling(series, [*keys] if across_blocks else [*keys, block], time, value, durations, step)
    wide = rolled.groupBy(*keys, block).agg(*[F.max(f"m_{window_rows(d, step)}").alias(f"x_{i}") for i, d in enumerate(durations)])
    pairs = ", ".join(f"{d}, x_{i}" for i, d in enumerate(durations))
    return wide.selectExpr(*keys, f"stack({len(durations)}, {pairs}) AS (duration, annual_max)", f"{block} AS block").select(*keys, "duration", "block", "annual_max")


def positions_of_maxima(series: DataFrame, keys: list[str], time: str, value: str, block: str, durations: Iterable[float], step: float = 1.0) -> DataFrame:
    """``(keys, block, duration, position, at)``: where in its block each first maximum ends, from 0."""
    durations = list(dict.fromkeys(durations))
    rolled = rolling(series, [*keys, block], time, value, durations, step)
    pos = free_name(rolled, "_pos")
    placed = rolled.withColumn(pos, F.row_number().over(Window.partitionBy(*keys, block).orderBy(time)) - 1)
    best = lambda m: F.max_by(F.when(F.col(m).isNotNull(), F.struct(F.col(pos).alias("position"), F.col(time).alias("at"))), F.when(F.col(m).isNotNull(), F.struct(F.col(m).alias("m"), (-F.col(pos)).alias("p"))))
    wide = placed.groupBy(*keys, block).agg(*[best(f"m_{window_rows(d, step)}").alias(f"x_{i}") for i, d in enumerate(durations)])
    pairs = ", ".join(f"{d}, x_{i}" for i, d in enumerate(durations))
    return wide.selectExpr(*keys, block, f"stack({len(durations)}, {pairs}) AS (duration, x)").selectExpr(*keys, block, "duration", "x.position AS position", "x.at AS at")


def regular_axis(series: DataFrame, keys: list[str], time: str, axis: str = "union", step: str = "1 hour", position: str | None = None) -> DataFrame:
    """One row for each key and time, values null where there was none; ``position`` names a column for the time's place on the axis.

    ``union``: the times that any key has. ``regular``: every step from the first to the last time of all keys. The axis
    is one array, of the length of the record's time axis, that every key explodes. ``series`` is read three times, for
    its axis, its keys and its values: give it a stored table (``stages.stage``), not a long plan.
    """
    held = free_name(series, "_axis")
    times = F.sort_array(F.collect_set(time)) if axis == "union" else F.expr(f"sequence(min({time}), max({time}), INTERVAL {step})")
    axes = F.broadcast(series.agg(times.alias(held)))  # one row
    at = free_name(series, "_at") if position is None else position
    dense = series.select(*keys).distinct().join(axes).select(*keys, F.posexplode(held).alias(at, time))
    out = dense.join(series, [*keys, time], "left")
    return out.drop(at) if position is None else out
