"""Comparison of sources: gauges with grid cells, errors and robust regressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import stage
from .grid import nearest_cells, positive_longitude
from .quantiles import intensities
from .report import quantile_table
from .selection import exact_quantiles


def site_list(points: DataFrame, name: str, only: list[str] | None = None) -> DataFrame:
    """Distinct named sites, longitudes from 0 to 360."""
    out = points.select(F.col(name).alias("name"), "latitude", positive_longitude(F.col("longitude")).alias("longitude")).distinct()
    return out.where(F.col("name").isin(*only)) if only is not None else out


def grid_at_sites(grid: DataFrame, sites: DataFrame) -> DataFrame:
    """Rows of the cells nearest to ``sites(name, latitude, longitude)``, by site."""
    cells = nearest_cells(grid.select("latitude", "longitude").distinct(), sites).where("cell_lat IS NOT NULL")
    joined = grid.join(cells, (F.col("latitude") == F.col("cell_lat")) & (F.col("longitude") == F.col("cell_lon")))
    return joined.drop("latitude", "longitude", "cell_lat", "cell_lon")


def combine_sources(sites: DataFrame, grids: dict[str, DataFrame], points: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """All sources at the sites: ``(source, name, columns)``. Grids by nearest cell, points by name."""
    parts = [grid_at_sites(g, sites).select(F.lit(s).alias("source"), "name", *columns) for s, g in grids.items()]
    parts += [p.join(sites.select("name"), "name").select(F.lit(s).alias("source"), "name", *columns) for s, p in points.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pair_with_reference(df: DataFrame, reference: str, keys: list[str], value: str = "intensity") -> DataFrame:
    """``(source, keys, ref, est)`` of every other source."""
    ref = df.where(F.col("source") == reference).select(*keys, F.col(value).alias("ref"))
    return df.where(F.col("source") != reference).select("source", *keys, F.col(value).alias("est")).join(ref, keys)


def errors(pairs: DataFrame, by: list[str], approximate: bool = False) -> DataFrame:
    """MAE, MAPE, and the median and outer percentage errors of ``est`` against ``ref``.

    Quantiles are exact, by counts over ranges (``selection``, which stages the pairs); ``approximate`` takes one pass. Rows of null groups stay.
    """
    levels, names = (0.025, 0.5, 0.975), ("pe_low", "mdpe", "pe_high")
    d = F.col("est") - F.col("ref")
    own = pairs.select(*by, d.alias("d"), F.try_divide(d, F.col("ref")).alias("pe"))
    means = [F.avg(F.abs("d")).alias("mae"), F.avg(F.abs("pe")).alias("mape")]
    if approximate:
        out = own.groupBy(*by).agg(*means, F.percentile_approx("pe", F.array(*map(F.lit, levels)), F.lit(100_000)).alias("values"))
    else:
        own = stage(own, "pairs")
        q = exact_quantiles(own, by, "pe", levels, again=True).select(*[F.col(b).alias(f"of_{b}") for b in by], "values")
        same = [F.col(b).eqNullSafe(F.col(f"of_{b}")) for b in by]
        out = own.groupBy(*by).agg(*means).join(q, same)
    return out.select(*by, "mae", "mape", *[F.col("values")[i].alias(n) for i, n in enumerate(names)])


def robust_lines(pairs: DataFrame, by: list[str], x: str = "ref", y: str = "est", intercept: bool = False) -> DataFrame:
    """``(by, slope, intercept, n)``: least squares re-fitted without points over two robust deviations, until it settles.

    A group is the stations of one case and is fitted in one step; ``intercept=False`` fits through the origin. Null
    pairs are left out; a group without variance has a null slope.
    """
    kinds = dict(pairs.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in by) + ", slope double, intercept double, n long"

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[[x, y]].dropna().to_numpy(float)
        a, b = irls(own[:, 0], own[:, 1], intercept)
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in by), a, b, len(own)]], columns=[*by, "slope", "intercept", "n"])

    out = pairs.select(*by, x, y).groupBy(*by).applyInPandas(solve, schema)
    return out.withColumn("slope", F.when(~F.isnan("slope"), F.col("slope"))).withColumn("intercept", F.when(~F.isnan("intercept"), F.col("intercept")))


def irls(x: np.ndarray, y: np.ndarray, intercept: bool, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept with the trimmed-mean norm: weight 1 up to two deviations, else 0."""
    design = np.stack([x, np.ones_like(x)], 1) if intercept else x[:, None]
    w, last = np.ones(len(x)), np.inf
    beta = np.full(design.shape[1], np.nan)
    for _ in range(rounds):
        own = w > 0
        if own.sum() < design.shape[1] or np.linalg.matrix_rank(design[own]) < design.shape[1]:
            break
        beta = np.linalg.lstsq(design[own], y[own], rcond=None)[0]
        r = y - design @ beta
        s = np.median(np.abs(r)) / 0.6745
        if s <= 1e-12:
            break
        z = np.abs(r / s)
        w = (z <= 2).astype(float)
        loss = np.where(z <= 2, z**2 / 2, 2.0).sum()
        if abs(loss - last) <= 1e-8:
            break
        last = loss
    return float(beta[0]), float(beta[1]) if intercept else 0.0


def adequate(df: DataFrame, threshold: float = 0.2) -> DataFrame:
    return df.where(F.col("mape") <= threshold)


def report(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Errors, the slope through the origin (areal reduction, ``arf``) and the regression line, by source and case.

    Both lines are fitted in one step for each case; a case holds one row for each station.
    """
    kinds = dict(pairs.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in by) + ", arf double, slope double, intercept double"

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[["ref", "est"]].dropna().to_numpy(float)
        values = [irls(own[:, 0], own[:, 1], False)[0], *irls(own[:, 0], own[:, 1], True)]
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in by), *values]], columns=[*by, "arf", "slope", "intercept"])

    lines = pairs.select(*by, "ref", "est").groupBy(*by).applyInPandas(solve, schema)
    lines = lines.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("arf", "slope", "intercept")})
    return errors(pairs, by).join(lines, by)


def station_report_pairs(gauges: DataFrame, grids: dict[str, DataFrame], periods=(2, 10, 50, 100, 500, 1000), keys: tuple[str, ...] = ("station", "duration")) -> DataFrame:
    """Intensities of gauges and of their nearest cells: ``(source, station, duration, T, ref, est)``.

    ``gauges(station, latitude, longitude, duration, location, scale, shape)``, ``grids`` by source with latitude and
    longitude from 0 to 360 instead of the station. Gauges without coordinates are left out, negative longitudes
    turned.
    """
    held = gauges.where("latitude IS NOT NULL AND longitude IS NOT NULL")
    sites = held.select(F.col("station").alias("name"), "latitude", positive_longitude(F.col("longitude")).alias("longitude")).distinct()
    params = ["location", "scale", "shape"]
    parts = [held.select(F.lit("gauge").alias("source"), *keys, *params)]
    parts += [grid_at_sites(g, sites).select(F.lit(s).alias("source"), F.col("name").alias("station"), *keys[1:], *params) for s, g in grids.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return pair_with_reference(intensities(every, 3, periods), "gauge", [*keys, "T"])


def station_report(gauges: DataFrame, grids: dict[str, DataFrame], periods=(2, 10, 50, 100, 500, 1000)) -> DataFrame:
    """Gauges against grids, from coordinates to errors, areal reduction and lines: a row for each source, duration and period."""
    return report(station_report_pairs(gauges, grids, periods), ["source", "duration", "T"])


def relative_difference_quantiles(params: DataFrame, by: list[str], q: list[float], approximate: bool = False) -> DataFrame:
    """Quantiles of (scaled - fitted) / fitted: ``(by, q, value)``; exact unless ``approximate``."""
    rel = F.try_divide(F.col("gev_scaled") - F.col("gev"), F.col("gev"))
    return quantile_table(params.select(*by, rel.alias("rel")), by, "rel", q, approximate)


def mean_percentage_error(scaled: DataFrame, fitted: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Mean, least and largest of (scaled - fitted) / fitted intensities over locations, and over how many."""
    pair = scaled.select(*keys, *by, F.col("intensity").alias("s")).join(fitted.select(*keys, *by, F.col("intensity").alias("f")), [*keys, *by])
    error = F.try_divide(F.col("s") - F.col("f"), F.col("f"))
    return pair.groupBy(*by).agg(F.avg(error).alias("mpe"), F.min(error).alias("least"), F.max(error).alias("largest"), F.count("s").alias("n"))


def error_extent(errors_by_case: DataFrame) -> DataFrame:
    """The least and the largest mean percentage error of all cases."""
    return errors_by_case.agg(F.min("mpe").alias("least"), F.max("mpe").alias("largest"))


def station_pairs_panel(pairs: DataFrame, stations: DataFrame, keys: list[str], columns: list[str], grid: DataFrame | None = None, places: DataFrame | None = None) -> DataFrame:
    """Rows of both stations of each 'A--B' pair and their mean, by source 'first', 'last' and 'mean'.

    With ``grid(latitude, longitude, keys, columns)`` and ``places(station, latitude, longitude)`` also 'grid', the cell
    nearest to the pair's last station.
    """
    split = pairs.select("pair", F.posexplode(F.split("pair", "--")).alias("k", "station"))
    each = stations.join(split, "station").withColumn("source", F.when(F.col("k") == 0, "first").otherwise("last"))
    mean = each.groupBy("pair", *keys).agg(*[F.avg(c).alias(c) for c in columns]).withColumn("source", F.lit("mean"))
    out = each.select("pair", "source", *keys, *columns).unionByName(mean.select("pair", "source", *keys, *columns))
    if grid is None:
        return out
    sites = split.where("k > 0").join(places, "station").select(F.col("pair").alias("name"), "latitude", positive_longitude(F.col("longitude")).alias("longitude"))
    cell = grid_at_sites(grid, sites).select(F.col("name").alias("pair"), F.lit("grid").alias("source"), *keys, *columns)
    return out.unionByName(cell)


def with_line(panel: DataFrame, keys: list[str], value: str, duration: str = "duration") -> DataFrame:
    """``panel`` with ``line``: 10^intercept * duration^slope of the line of log10(value) on log10(duration) of each series."""
    y = F.when(F.col(value) > 0, F.log10(F.when(F.col(value) > 0, F.col(value))))
    x = F.when(y.isNotNull(), F.log10(F.col(duration).cast("double")))
    slope = F.try_divide(F.covar_pop(y, x), F.var_pop(x))
    lines = panel.groupBy(*keys).agg(slope.alias("_slope"), (F.avg(y) - slope * F.avg(x)).alias("_intercept"))
    both = panel.join(lines, keys)
    return both.withColumn("line", F.pow(F.lit(10.0), "_intercept") * F.pow(F.col(duration).cast("double"), F.col("_slope"))).drop("_slope", "_intercept")


def overlay(series: dict[str, DataFrame], time: str, value: str) -> DataFrame:
    """Series of several sources under each other."""
    parts = [df.select(F.lit(s).alias("source"), time, value) for s, df in series.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def station_overlay(records: DataFrame, sites: DataFrame, grid: DataFrame, time: str, value: str) -> DataFrame:
    """``(name, source, time, value)`` of stations and of their nearest cells under each other; ``records(name, time, value)``."""
    cells = grid_at_sites(grid, sites).select("name", F.lit("grid").alias("source"), time, value)
    own = records.join(sites.select("name"), "name", "left_semi").select("name", F.lit("station").alias("source"), time, value)
    return own.unionByName(cells)


def side_by_side(df: DataFrame, keys: list[str], sources: list[str], value: str = "intensity") -> DataFrame:
    """A column for each source."""
    return df.groupBy(*keys).pivot("source", sources).agg(F.first(value))
