"""Summary tables: missing fits, quantiles of statistics, densities, paired tests."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import gev
from .ranks import global_average_rank
from .selection import exact_quantiles


def count_missing(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count_if(F.col(value).isNull()).alias("n_missing"), F.count(F.lit(1)).alias("n"))


def quantile_table(df: DataFrame, by: list[str], value: str, q: list[float], approximate: bool = False) -> DataFrame:
    """``(by, q, value)``: exact by counts over ranges (``selection``); ``approximate`` takes one pass."""
    if approximate:
        out = (df.groupBy(*by) if by else df).agg(F.percentile_approx(value, F.array(*map(F.lit, q)), F.lit(100_000)).alias("values"))
    else:
        out = exact_quantiles(df, by, value, q)
    pairs = ", ".join(f"CAST({x} AS DOUBLE), values[{i}]" for i, x in enumerate(q))
    return out.selectExpr(*by, f"stack({len(q)}, {pairs}) AS (q, value)")


def share_below_critical(gof: DataFrame, crit: DataFrame, stat: str = "filliben_stat", column: str = "filliben_crit", level: float = 0.05) -> DataFrame:
    """Share of series whose statistic is under the critical value."""
    one = crit.where(F.col("significance_level") == level).select(column)
    return gof.crossJoin(F.broadcast(one)).agg(F.try_divide(F.count_if(F.col(stat) < F.col(column)), F.count(stat)).alias("share_below"))


def mean_statistics(gof: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return gof.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns])


def density(df: DataFrame, x: str, y: str, bins: int = 20, least: int = 100, shared_extent: bool = True, approximate: bool = False) -> DataFrame:
    """Counts on a grid over the 1-99 % extent of ``x`` (on both axes when shared); cells with ``least`` points.

    The extent is exact, by counts over ranges (``selection``); ``approximate`` takes one pass for it.
    """
    q = (0.01, 0.99)
    extent = lambda c, out: df.agg(F.percentile_approx(c, F.array(*map(F.lit, q)), F.lit(100_000)).alias(out)) if approximate else exact_quantiles(df, [], c, q).withColumnRenamed("values", out)
    ext = extent(x, "ex")
    ext = ext.withColumn("ey", F.col("ex")) if shared_extent else ext.crossJoin(extent(y, "ey"))  # one row each
    at = lambda c, e: F.floor((F.col(c) - F.col(e)[0]) / F.nullif(F.col(e)[1] - F.col(e)[0], F.lit(0.0)) * bins)
    edge = lambda c, e: F.when(F.col(c).between(F.col(e)[0], F.col(e)[1]), F.least(at(c, e), F.lit(bins - 1)))
    placed = df.crossJoin(F.broadcast(ext)).select(edge(x, "ex").alias("bx"), edge(y, "ey").alias("by"))
    return placed.where("bx IS NOT NULL AND by IS NOT NULL").groupBy("bx", "by").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def maximum_over_time(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max(value).alias("maximum"))


def count_significant(df: DataFrame, by: list[str], p: str, alpha: float = 0.05) -> DataFrame:
    """How many p-values are over alpha."""
    return df.groupBy(*by).agg(F.count_if(F.col(p) > alpha).alias("n_over"), F.count(p).alias("n"))


#: Pairs up to which the signed ranks' p-value is counted out, if neither ties nor zeros are among them.
EXACT_PAIRS = 50


def signed_rank_tail(n: int, least: int) -> float:
    """Two-sided chance that the smaller rank sum of ``n`` untied pairs is ``least`` or less, by counting sets of ranks by their sum."""
    ways = [1] + [0] * (n * (n + 1) // 2)
    for rank in range(1, n + 1):
        for total in range(len(ways) - 1, rank - 1, -1):
            ways[total] += ways[total - rank]
    return min(1.0, 2 * sum(ways[: least + 1]) / 2**n)


def paired_tests(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row ``(n, t, t_p, w_plus, w_minus, z, w_p)``: paired t test and Wilcoxon's signed ranks (zeros ranked, without sign).

    Pairs with a missing value are left out. Ranks come from counts by value, not from a window over all rows. p-values
    are two-sided: Student's t with n - 1 degrees; for the ranks the exact distribution of up to EXACT_PAIRS pairs
    without ties and zeros, else the normal tail of z. Null where they are not defined. Two jobs run when it is called.
    """
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select((F.col(x) - F.col(y)).alias("d"))
    s = d.agg(F.count("d").alias("n"), F.avg("d").alias("m"), F.stddev_samp("d").alias("s")).first()
    schema = "n long, t double, t_p double, w_plus double, w_minus double, z double, w_p double"
    n = s["n"]
    if not n:
        return df.sparkSession.createDataFrame([(0, None, None, None, None, None, None)], schema)
    t = s["m"] / (s["s"] / math.sqrt(n)) if s["s"] else None
    ranks = global_average_rank(d.select(F.abs("d").alias("a")), "a")
    signs = d.groupBy(F.abs("d").alias("a")).agg(F.count_if(F.col("d") > 0).alias("up"), F.count_if(F.col("d") < 0).alias("down"))
    w = ranks.join(signs, "a").agg(
        F.sum(F.col("rank") * F.col("up")).alias("plus"), F.sum(F.col("rank") * F.col("down")).alias("minus"),
        F.sum(F.when(F.col("a") == 0, F.col("n"))).alias("zeros"), F.sum(F.when(F.col("a") > 0, F.pow("n", F.lit(3)) - F.col("n"))).alias("ties"),
    ).first()
    z0 = w["zeros"] or 0
    mean = (n * (n + 1) - z0 * (z0 + 1)) / 4
    var = (n * (n + 1) * (2 * n + 1) - z0 * (z0 + 1) * (2 * z0 + 1)) / 24 - (w["ties"] or 0) / 48
    z = (w["plus"] - mean) / math.sqrt(var) if var > 0 else None
    t_p = None if t is None else gev.t_tail(t, n - 1)
    if z is None:
        w_p = None
    elif n <= EXACT_PAIRS and not z0 and not w["ties"]:
        w_p = signed_rank_tail(n, int(min(w["plus"], w["minus"])))
    else:
        w_p = math.erfc(abs(z) / math.sqrt(2))
    return df.sparkSession.createDataFrame([(n, t, t_p, float(w["plus"]), float(w["minus"]), z, w_p)], schema)
