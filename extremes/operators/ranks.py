"""Ranks with averaged ties, plotting positions and rank correlation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stage

#: A correlation of ranks deals its rows into parts of so many, up to a number of parts that a shuffle writes without sorting, and what one pair or value has into so many shares.
PART_ROWS = 500_000
MOST_PARTS = 200
SALTS = 32


def average_rank(value: str, keys: list[str]) -> Column:
    """Ascending rank within ``keys``, ties averaged, null for null."""
    first = F.rank().over(Window.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last()))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return F.when(F.col(value).isNotNull(), first + (ties - 1) / 2)


def rank_and_ecdf(ams: DataFrame, keys: list[str], value: str = "annual_max") -> DataFrame:
    """``ams`` with rank, n_obs (valid values of the series) and ecdf = rank / n_obs."""
    n = F.count(value).over(Window.partitionBy(*keys))
    out = ams.withColumn("rank", average_rank(value, keys)).withColumn("n_obs", n)
    return out.withColumn("ecdf", F.try_divide(F.col("rank"), F.col("n_obs")))


def pearson(x: Column, y: Column, least: Column | int | None = None) -> Column:
    """Correlation of a group; null without variance in both, or with fewer than ``least`` pairs."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    r = F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b)))
    return r if least is None else F.when(F.count(F.when(both, 1)) >= least, r)


def centred_ranks(counts: DataFrame, value: str, sums: list[str], parts: int) -> DataFrame:
    """``counts(_g, value, sums)`` added up by value, with ``_rank``: the average rank, by ``_n`` of ``sums``, less the group's mean rank.

    Values are dealt into ``parts`` ranges over all groups; what a group has in earlier ranges is the offset of its next, so no task holds a group.
    """
    dealt = counts.repartitionByRange(parts, "_g", value).groupBy("_g", value).agg(*[F.sum(c).alias(c) for c in sums])
    placed = stage(dealt.withColumn("_part", F.spark_partition_id()), "ranges")
    totals = placed.groupBy("_g", "_part").agg(F.sum("_n").alias("_t"))  # at most a row for each group and one for each range
    before = (F.sum("_t").over(Window.partitionBy("_g").orderBy("_part")) - F.col("_t")).alias("_before")
    offsets = totals.select("_g", "_part", before, F.sum("_t").over(Window.partitionBy("_g")).alias("_all"))
    run = F.sum("_n").over(Window.partitionBy("_g", "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = placed.repartitionByRange(parts, "_part").withColumn("_run", run).join(offsets, ["_g", "_part"])
    rank = F.col("_before") + F.col("_run") - (F.col("_n") - 1) / 2 - (F.col("_all") + 1) / 2
    return ranked.withColumn("_rank", rank).drop("_part", "_run", "_before", "_all")


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """``(keys, rho)``: Pearson's r of average ranks, over rows where both are known; groups of any size.

    The ranks of x are joined to the counts of pairs and added up by y, whose ranks then weigh those sums. Rows are dealt out before
    they are counted, a frequent pair or y to several tasks. Jobs run when it is called; ``df`` is read twice.
    """
    group = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(group.alias("_g"), F.col(x).alias("_x"), F.col(y).alias("_y"))
    parts = min(MOST_PARTS, max(1, math.ceil(both.count() / PART_ROWS)))
    pair = ["_g", "_x", "_y", "_salt"]
    pairs = stage(both.withColumn("_salt", F.spark_partition_id() % SALTS).repartition(parts, *pair).groupBy(*pair).agg(F.count(F.lit(1)).alias("_n")).drop("_salt"), "pairs")
    xs = stage(centred_ranks(pairs.groupBy("_g", "_x").agg(F.sum("_n").alias("_n")), "_x", ["_n"], parts), "ranks")
    held = pairs.join(xs.select("_g", "_x", "_rank"), ["_g", "_x"]).withColumn("_salt", F.pmod(F.hash("_x"), F.lit(SALTS)))
    by_y = held.repartition(parts, "_g", "_y", "_salt").groupBy("_g", "_y", "_salt").agg(F.sum("_n").alias("_n"), F.sum(F.col("_n") * F.col("_rank")).alias("_of_x"))
    ys = centred_ranks(by_y, "_y", ["_n", "_of_x"], parts)
    squares = F.sum(F.col("_n") * F.col("_rank") * F.col("_rank"))
    sums = ys.groupBy("_g").agg(F.sum(F.col("_rank") * F.col("_of_x")).alias("_xy"), squares.alias("_yy")).join(xs.groupBy("_g").agg(squares.alias("_xx")), "_g")
    return sums.select(*[F.col(f"_g.`{k}`").alias(k) for k in keys], F.try_divide("_xy", F.sqrt(F.col("_xx") * F.col("_yy"))).alias("rho"))


def global_average_rank(df: DataFrame, value: str, ranges: int = 64) -> DataFrame:
    """``(value, n, rank)`` of all distinct values of a table, without a window over all rows.

    Counts by value, dealt into ranges by quantiles; each range's total gives the offset of the next.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    cuts = sorted(set(counts.agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)])).first()[0] or []))
    at = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < F.col(value).cast("double"))) if cuts else F.lit(0)
    placed = counts.withColumn("_range", at)
    totals = placed.groupBy("_range").agg(F.sum("n").alias("_t")).selectExpr("_range", "sum(_t) OVER (ORDER BY _range) - _t AS _before")  # at most ``ranges`` rows
    run = F.sum("n").over(Window.partitionBy("_range").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = placed.withColumn("_run", run).join(F.broadcast(totals), "_range")
    return ranked.select(value, "n", (F.col("_before") + F.col("_run") - (F.col("n") - 1) / 2).alias("rank"))
