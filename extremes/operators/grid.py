"""Grids: longitudes, extracts, nearest cells, pooling, gap filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blockmax import free_name


def positive_longitude(lon: Column) -> Column:
    return F.when(lon < 0, lon + 360).otherwise(lon)


def trim_first_row(df: DataFrame, first_lat: float | None = None) -> DataFrame:
    """Without the first latitude of a north-to-south grid; by default the largest."""
    if first_lat is None:
        first_lat = df.agg(F.max("latitude")).first()[0]
    return df.where(F.col("latitude") != F.lit(first_lat))


def extract(df: DataFrame, lat: tuple[float, float], lon: tuple[float, float]) -> DataFrame:
    """Cells of a box, ends included, given in either direction."""
    return df.where(F.col("latitude").between(min(lat), max(lat)) & F.col("longitude").between(min(lon), max(lon)))


def snap(x: Column, first: float, step: float, n: int) -> Column:
    """Nearest value of the regular axis first, first + step, ...; half-way goes to the larger coordinate."""
    k = (x - first) / step
    i = F.floor(k + 0.5) if step > 0 else F.ceil(k - 0.5)
    return F.lit(first) + F.greatest(F.lit(0), F.least(F.lit(n - 1), i)) * F.lit(step)


def snapped(points: DataFrame, lat: tuple[float, float, int], lon: tuple[float, float, int]) -> DataFrame:
    """``nearest_cells`` for regular axes (first, step, n), by arithmetic."""
    return points.select(*[c for c in points.columns if c not in ("latitude", "longitude")], snap(F.col("latitude"), *lat).alias("cell_lat"), snap(F.col("longitude"), *lon).alias("cell_lon"))


def _nearest(axis: Column, x: Column) -> Column:
    """The element of the ascending ``axis`` nearest to ``x``, ties to the larger one: found by halving, in log2(axis) steps."""
    bits = F.ceil(F.log2(F.size(axis) + F.lit(1))).cast("int")
    # how many elements are <= x: from the highest power of two down, a step is taken if the element it leads to still is
    step = lambda k: F.pow(F.lit(2.0), k).cast("int")
    count = F.aggregate(
        F.sequence(bits - 1, F.lit(0), F.lit(-1)), F.lit(0),
        lambda done, k: F.when((done + step(k) <= F.size(axis)) & (F.get(axis, done + step(k) - 1) <= x), done + step(k)).otherwise(done),
    )
    below, above = F.get(axis, count - 1), F.get(axis, count)
    return F.when(below.isNull() | (above - x <= x - below), above).otherwise(below)


def nearest_cells(cells: DataFrame, points: DataFrame) -> DataFrame:
    """``points`` with ``cell_lat, cell_lon``: nearest on each axis alone, ties to the larger coordinate, no wrap-around.

    Works on irregular axes: an axis' distinct values are one sorted array, of its length, which each point searches by
    halving; on regular axes ``snapped`` needs no array. Points without coordinates have no cell, and none has in an empty grid.
    """
    lats, lons = free_name(points, "_lats"), free_name(points, "_lons")
    axes = cells.agg(*[F.sort_array(F.collect_set(c)).alias(out) for c, out in (("latitude", lats), ("longitude", lons))])  # one row
    out = points.crossJoin(F.broadcast(axes))
    known = F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & (F.size(lats) > 0)
    near = lambda axis, x: F.when(known, _nearest(F.col(axis), F.col(x)))
    return out.select(*[c for c in points.columns if c not in ("latitude", "longitude")], near(lats, "latitude").alias("cell_lat"), near(lons, "longitude").alias("cell_lon"))


def pool(ams: DataFrame, first: tuple[float, float], old: float, new: float, first_block: int, n_blocks: int) -> DataFrame:
    """Neighbouring fine cells as one coarse cell whose series holds all their blocks, numbered from 0, neighbour by neighbour."""
    step = round(new / old)
    if abs(step * old - new) > 1e-9 * new:
        raise ValueError("the new resolution must be a multiple of the old one")
    i = F.round((F.col("latitude") - first[0]) / old).cast("int")
    j = F.round((F.col("longitude") - first[1]) / old).cast("int")
    centre = (new - old) / 2
    part = (F.pmod(i, F.lit(step)) * step + F.pmod(j, F.lit(step))) * n_blocks + (F.col("block") - first_block)
    latitude, longitude = (F.lit(f + centre) + F.floor(k / step) * new for f, k in zip(first, (i, j), strict=True))
    return ams.withColumns({"block": part.cast("int"), "latitude": latitude, "longitude": longitude})


def fill_gaps(main: DataFrame, update: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``main`` with missing values (and rows) taken from ``update``. ``sources.stages.update_record`` does so on a stored record, in the update's blocks only."""
    update_value = free_name(main, "_update")
    other = update.select(*keys, F.col(value).alias(update_value))
    return main.select(*keys, value).join(other, keys, "full_outer").select(*keys, F.coalesce(value, update_value).alias(value))
