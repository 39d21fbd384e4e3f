"""Published tables and site tables from fitted parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _wide(df: DataFrame, keys: list[str], cases: dict[str, tuple[str, str, str]]) -> DataFrame:
    """Columns ``{new: (value, ev_param, ci)}`` by conditional aggregation."""
    return df.groupBy(*keys).agg(*[F.max(F.when((F.col("ev_param") == p) & (F.col("ci") == ci), F.col(v))).alias(new) for new, (v, p, ci) in cases.items()])


def params_by_duration(params: DataFrame, keys: list[str], gof: DataFrame | None = None, crit: DataFrame | None = None) -> DataFrame:
    """Location and scale estimates by duration, with goodness of fit and, a column for each level, critical values."""
    out = _wide(params, [*keys, "duration"], {"location": ("gev", "location", "estimate"), "scale": ("gev", "scale", "estimate")})
    out = out if gof is None else out.join(gof, [*keys, "duration"], "left").withColumnRenamed("KS_D", "D")
    if crit is None:
        return out
    at = lambda c, level: F.max(F.when(F.col("significance_level") == level, F.col(c))).alias(f"{c}_{round(100 * level):02d}")
    one = crit.agg(*[at(c, level) for c in crit.columns if c != "significance_level" for level in (0.05, 0.1)])  # one row
    return out.join(F.broadcast(one))


def params_by_duration_ci(params: DataFrame, keys: list[str]) -> DataFrame:
    """Interval limits keyed by a numeric ``ci``."""
    limits = params.where("ci <> 'estimate'").withColumn("level", F.col("ci").cast("double"))
    return limits.groupBy(*keys, "duration", F.col("level").alias("ci")).agg(*[F.max(F.when(F.col("ev_param") == p, F.col("gev"))).alias(f"{p}_ci") for p in ("location", "scale")])


def scaling_table(lines: DataFrame, keys: list[str]) -> DataFrame:
    """``a, alpha`` of location and ``b, beta`` of scale: 10^intercept and slope, with r squared."""
    pick = lambda p, c: F.max(F.when(F.col("ev_param") == p, F.col(c)))
    out = lines.groupBy(*keys).agg(*[pick(p, c).alias(n) for p, c, n in (
        ("location", "intercept", "_a"), ("location", "slope", "alpha"), ("location", "rsquared", "location_r2"),
        ("scale", "intercept", "_b"), ("scale", "slope", "beta"), ("scale", "rsquared", "scale_r2"),
    )])
    ten = lambda c: F.pow(F.lit(10.0), F.col(c))
    return out.select(*keys, ten("_a").alias("a"), "alpha", "location_r2", ten("_b").alias("b"), "beta", "scale_r2")


def scaling_table_ci(lines: DataFrame, keys: list[str], linear: bool = False) -> DataFrame:
    """Interval limits of intercepts and slopes; intercepts stay logarithms unless ``linear``."""
    limits = lines.where("ci <> 'estimate'").withColumn("level", F.col("ci").cast("double"))
    one = F.pow(F.lit(10.0), F.col("intercept")) if linear else F.col("intercept")
    pick = lambda p, c: F.max(F.when(F.col("ev_param") == p, c))
    return limits.groupBy(*keys, F.col("level").alias("ci")).agg(
        pick("location", one).alias("a_ci"), pick("location", F.col("slope")).alias("alpha_ci"), pick("scale", one).alias("b_ci"), pick("scale", F.col("slope")).alias("beta_ci")
    )


def scaling_ratio(table: DataFrame) -> DataFrame:
    return table.withColumn("alpha_beta_ratio", F.try_divide("alpha", "beta"))


def slope_ratio(lines_all: DataFrame, lines_some: DataFrame, keys: list[str]) -> DataFrame:
    """Slopes fitted on two sets of durations, and their ratio."""
    by = [*keys, "ev_param"]
    pair = lines_all.select(*by, F.col("slope").alias("slope_all")).join(lines_some.select(*by, F.col("slope").alias("slope_some")), by)
    return pair.withColumn("ratio", F.try_divide("slope_all", "slope_some"))


def site_table(params: DataFrame, site: str, sources: list[str], limits: tuple[str, str] = ("0.025", "0.975")) -> DataFrame:
    """A row for each site and duration, columns ``<source>_<param>[_lr]_{est,ci_l,ci_h}``; ``_lr`` are scaled values."""
    aggs = []
    for s in sources:
        for p in ("location", "scale"):
            for v, mark in (("gev", ""), ("gev_scaled", "_lr")):
                for ci, end in zip(("estimate", *limits), ("est", "ci_l", "ci_h"), strict=True):
                    aggs.append(F.max(F.when((F.col("source") == s) & (F.col("ev_param") == p) & (F.col("ci") == ci), F.col(v))).alias(f"{s}_{p}{mark}_{end}"))
    return params.groupBy(site, "duration").agg(*aggs)


def probability_table(wide: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Wide probabilities to rows ``(keys, kind, p, T)``."""
    pairs = ", ".join(f"'{c}', {c}" for c in columns)
    return wide.selectExpr(*keys, f"stack({len(columns)}, {pairs}) AS (kind, p)").withColumn("T", F.try_divide(F.lit(1.0), 1 - F.col("p")))


def theoretical_curve(fits: DataFrame, last: int = 9999) -> DataFrame:
    """Fitted quantiles for T = 2 ... last."""
    from ..functions import gev

    df = fits.withColumn("T", F.explode(F.sequence(F.lit(2), F.lit(last)))).withColumn("T", F.col("T").cast("double"))
    return df.withColumn("quantile", gev.no_nan(gev.quantile(F.col("T"), F.col("location"), F.col("scale"), F.col("shape"))))
