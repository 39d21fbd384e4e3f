"""Intensities for return periods, with intervals, and queries on fitted parameters."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import gev
from .grid import nearest_cells

#: Variance coefficients of the published shape -0.114 (fixed values).
C_VALUES = (1.1412, 0.8216, 1.2546)


def with_return_periods(df: DataFrame, periods: Iterable[float]) -> DataFrame:
    """Every row once for each return period ``T``; no shuffle."""
    return df.withColumn("T", F.explode(F.array(*[F.lit(float(t)) for t in periods])))


def intensities(params: DataFrame, n_obs: int | None, periods: Iterable[float], ci: Iterable[str] = ("estimate",), c=C_VALUES, correct: bool = False) -> DataFrame:
    """``params(..., location, scale, shape)`` (estimates) -> rows with ``T``, ``ci``, ``intensity``.

    The half-width is t(ci, n - 2) * sqrt(variance / n), although the variance is one of the quantile already; with
    ``correct`` it is t * sqrt(variance). 'estimate' and '0.500' give the quantile itself. Without ``n_obs`` it is the
    least n_obs of ``params``; with less than 3 blocks limits are null.
    """
    if n_obs is None:
        n_obs = params.agg(F.min("n_obs")).first()[0] or 0
    df = with_return_periods(params, periods)
    p = [F.col(x) for x in ("location", "scale", "shape")]
    df = df.withColumn("_i", gev.no_nan(gev.quantile(F.col("T"), *p))).withColumn("_v", gev.quantile_variance(F.col("T"), p[1], p[2], F.lit(float(max(n_obs, 1))), c))
    half = F.sqrt("_v") if correct else F.sqrt(F.col("_v") / F.lit(float(max(n_obs, 1))))
    rows = [F.struct(F.lit(x).alias("ci"), F.lit(0.0 if x in ("estimate", "0.500") else gev.t_quantile(float(x), n_obs - 2) if n_obs > 2 else None).cast("double").alias("t")) for x in ci]
    df = df.withColumn("_c", F.explode(F.array(*rows))).withColumn("ci", F.col("_c.ci"))
    value = F.when(F.col("_c.t") == 0.0, F.col("_i")).otherwise(F.col("_i") + F.col("_c.t") * half)
    return df.withColumn("intensity", gev.no_nan(value)).drop("_i", "_v", "_c")


def at_points(params: DataFrame, points: DataFrame, periods: Iterable[float]) -> DataFrame:
    """Table of intensities at the cells nearest to ``points(name, latitude, longitude)``."""
    cells = nearest_cells(params.select("latitude", "longitude").distinct(), points)
    joined = params.join(cells, [params.latitude == cells.cell_lat, params.longitude == cells.cell_lon]).drop("cell_lat", "cell_lon")
    return intensities(joined, 3, periods)


def field(params: DataFrame, duration: int, period: float) -> DataFrame:
    """The quantile of one duration and return period at every location."""
    return intensities(params.where(F.col("duration") == duration), 3, [period])


def sizing(params: DataFrame, locations: DataFrame, keys: list[str], duration: int, limits=("0.025", "0.975")) -> DataFrame:
    """Fitted, scaled and scaling values with their limits at chosen locations, one duration."""
    kept = params.where((F.col("duration") == duration) & F.col("ci").isin("estimate", *limits))
    return kept.join(locations, keys, "left_semi")


def sizing_at(params: DataFrame, points: DataFrame, duration: int, limits=("0.025", "0.975")) -> DataFrame:
    """``sizing`` at the cells nearest to ``points(name, latitude, longitude)``."""
    cells = nearest_cells(params.select("latitude", "longitude").distinct(), points)
    kept = params.where((F.col("duration") == duration) & F.col("ci").isin("estimate", *limits))
    return kept.join(cells, (F.col("latitude") == F.col("cell_lat")) & (F.col("longitude") == F.col("cell_lon"))).drop("cell_lat", "cell_lon")


def limits_at_points(params: DataFrame, points: DataFrame, periods: Iterable[float], durations: tuple[int, int] = (1, 48), limits=("0.025", "0.975")) -> DataFrame:
    """Intensities at the nearest cells over a range of durations, estimate and limits as columns.

    ``params(latitude, longitude, duration, n_obs, location, scale, shape)`` -> ``(name, duration, T, estimate, low, high)``.
    """
    cells = nearest_cells(params.select("latitude", "longitude").distinct(), points)
    kept = params.where(F.col("duration").between(*durations)).join(cells, (F.col("latitude") == F.col("cell_lat")) & (F.col("longitude") == F.col("cell_lon")))
    rows = intensities(kept.select("name", "duration", "n_obs", "location", "scale", "shape"), None, periods, ("estimate", *limits))
    pick = lambda c: F.max(F.when(F.col("ci") == c, F.col("intensity")))
    return rows.groupBy("name", "duration", "T").agg(pick("estimate").alias("estimate"), pick(limits[0]).alias("low"), pick(limits[1]).alias("high"))
