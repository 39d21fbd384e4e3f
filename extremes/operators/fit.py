"""GEV fits by probability-weighted moments, scaling with duration, and goodness of fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import gev
from .ranks import average_rank, pearson

PARAMS = ("location", "scale", "shape")


def moments(ranked: DataFrame, keys: list[str], value: str = "annual_max", orders: int = 3) -> DataFrame:
    """``(keys, n_obs, b0, b1, b2)``: b_r = sum(ecdf^r * x) / n."""
    b = [F.try_divide(F.sum(F.col(value) * (F.pow("ecdf", F.lit(r)) if r else 1)), F.max("n_obs")).alias(f"b{r}") for r in range(orders)]
    return ranked.groupBy(*keys).agg(F.max("n_obs").alias("n_obs"), *b)


def fit_moments(b: DataFrame, shape: float | None = None) -> DataFrame:
    """Location, scale and shape from moments; ``shape`` None fits it too."""
    l2 = 2 * F.col("b1") - F.col("b0")
    given = float(shape) if shape is not None else None
    out = b.withColumn("shape", F.lit(given) if given is not None else gev.shape_of(F.col("b0"), F.col("b1"), F.col("b2")))
    out = out.withColumn("scale", gev.no_nan(gev.scale_of(l2, F.col("shape") if given is None else given)))
    return out.withColumn("location", gev.no_nan(gev.location_of(F.col("b0"), F.col("scale"), F.col("shape") if given is None else given)))


def fit_gev(ranked: DataFrame, keys: list[str], value: str = "annual_max", shape: float | None = None) -> DataFrame:
    """``(keys, n_obs, location, scale, shape)``: one aggregation and column arithmetic."""
    return fit_moments(moments(ranked, keys, value), shape).select(*keys, "n_obs", *PARAMS)


def long_params(fits: DataFrame, keys: list[str]) -> DataFrame:
    return fits.selectExpr(*keys, "stack(3, 'location', location, 'scale', scale, 'shape', shape) AS (ev_param, gev)")


def scaling(params: DataFrame, keys: list[str], value: str = "gev", n_durations: int | None = None) -> DataFrame:
    """Lines of log10(value) on log10(duration): ``(keys, ev_param, slope, intercept, rsquared, spearman)``.

    Null unless all durations have a positive value; r squared and rho are null without variance.
    """
    by = [*keys, "ev_param"]
    logs = params.withColumn("_x", F.log10(F.col("duration").cast("double"))).withColumn("_y", F.when(F.col(value) > 0, F.log10(F.when(F.col(value) > 0, F.col(value)))))
    ranked = logs.withColumn("_rx", average_rank("_x", by)).withColumn("_ry", average_rank("_y", by))
    full = F.count("_y") == (F.count("_x") if n_durations is None else F.lit(n_durations))
    x, y = F.col("_x"), F.col("_y")
    r = pearson(x, y)
    agg = ranked.groupBy(*by).agg(
        full.alias("_full"), F.try_divide(F.covar_pop(y, x), F.var_pop(x)).alias("slope"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"),
        (r * r).alias("rsquared"), pearson(F.col("_rx"), F.col("_ry")).alias("spearman"),
    )
    keep = lambda c: F.when(F.col("_full"), c)
    return agg.select(
        *by, keep(F.col("slope")).alias("slope"), keep(F.col("_my") - F.col("slope") * F.col("_mx")).alias("intercept"),
        keep(F.col("rsquared")).alias("rsquared"), keep(F.col("spearman")).alias("spearman"),
    )


def with_scaled(params: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """``params`` with ``gev_scaled``: the line's value at the duration; a shape stays as it was fitted."""
    joined = params.join(lines.select(*keys, "ev_param", "slope", "intercept"), [*keys, "ev_param"], "left")
    line = gev.scaled(F.col("intercept"), F.col("slope"), F.col("duration").cast("double"))
    return joined.withColumn("gev_scaled", F.when(F.col("ev_param") == "shape", F.col("gev")).otherwise(line)).drop("slope", "intercept")


def gof_points(ranked: DataFrame, fits: DataFrame, keys: list[str], value: str = "annual_max") -> DataFrame:
    """Each observation with its fitted cdf, Cunnane position, return period and fitted quantile."""
    df = ranked.join(fits.select(*keys, *PARAMS), keys)
    p = [F.col(c) for c in PARAMS]
    df = df.withColumn("cdf", gev.no_nan(gev.cdf(F.col(value), *p))).withColumn("pp_cunnane", gev.plotting_position("cunnane", F.col("rank"), F.col("n_obs")))
    df = df.withColumn("T_cunnane", gev.return_period(F.col("pp_cunnane")))
    return df.withColumn("quantile_estimate", gev.no_nan(gev.quantile(F.col("T_cunnane"), *p)))


def goodness_of_fit(points: DataFrame, keys: list[str], value: str = "annual_max", nan_policy: str = "propagate") -> DataFrame:
    """``(keys, KS_D, filliben_stat)``. D compares rank / n only; with ``propagate`` a block without a value makes the correlation null."""
    r = pearson(F.col(value), F.col("quantile_estimate"), F.count(F.lit(1)) if nan_policy == "propagate" else None)
    return points.groupBy(*keys).agg(F.max(F.abs(F.col("ecdf") - F.col("cdf"))).alias("KS_D"), r.alias("filliben_stat"))


def critical_values(gof_input: DataFrame, shape: float, d_crit: DataFrame | None = None) -> DataFrame:
    """Two rows ``(significance_level, filliben_crit[, Dcrit])`` for the largest n_obs of the data."""
    n = gof_input.agg(F.max("n_obs").alias("n"))
    at5, at10 = gev.filliben_critical(shape, F.col("n"))
    out = n.select(F.explode(F.array(F.struct(F.lit(0.05).alias("significance_level"), at5.alias("filliben_crit")), F.struct(F.lit(0.1).alias("significance_level"), at10.alias("filliben_crit")))).alias("c")).select("c.*")
    return out if d_crit is None else out.join(F.broadcast(d_crit), "significance_level", "left")
