"""Robust regression lines of cases of any size: weighted sums and medians by counts, round by round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import stage
from .selection import exact_quantiles

ROUNDS = 50


def robust_lines_at_size(pairs: DataFrame, by: list[str], x: str = "ref", y: str = "est", intercept: bool = False, rounds: int = ROUNDS) -> DataFrame:
    """``(by, slope, intercept, n)``: what ``compare.robust_lines`` gives, with no case in one task.

    A round fits all open cases by sums over their points of weight 1, takes the scale from the exact median residual (``selection``) and
    weighs anew: points up to two scales have weight 1, others none. Each is a pass over the staged points, which are not shuffled. A case is closed once its loss stays, its scale is
    nothing, or its points do not vary. Some ten jobs a round, and the rounds of the slowest case. Null pairs are left out; a group may be null; a group without variance has a null slope.
    """
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    points = stage(pairs.select(group.alias("_g"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")), "points")
    none = F.lit(None).cast("double")
    valid = F.col("_x").isNotNull() & F.col("_y").isNotNull() & ~F.isnan("_x") & ~F.isnan("_y")
    state = stage(points.groupBy("_g").agg(F.count_if(valid).alias("n")).select("_g", "n", none.alias("a"), none.alias("c"), none.alias("s"), none.alias("loss"), F.lit(True).alias("open")), "lines")
    points = points.where(valid)
    residual = F.abs(F.col("_y") - F.col("a") * F.col("_x") - F.col("c"))
    for _ in range(rounds):
        held = points.join(state.where("open"), "_g").where(F.col("s").isNull() | (residual <= 2 * F.col("s")))
        if intercept:
            slope = F.when(F.var_pop("_x") > 1e-30 * F.avg(F.col("_x") * F.col("_x")), F.try_divide(F.covar_pop("_x", "_y"), F.var_pop("_x")))
            fitted = held.groupBy("_g").agg(slope.alias("a"), F.avg("_x").alias("mx"), F.avg("_y").alias("my")).select("_g", "a", (F.col("my") - F.col("a") * F.col("mx")).alias("c"))
        else:
            fitted = held.groupBy("_g").agg(F.try_divide(F.sum(F.col("_x") * F.col("_y")), F.sum(F.col("_x") * F.col("_x"))).alias("a"), F.lit(0.0).alias("c"))
        fitted = stage(fitted.where("a IS NOT NULL"), "fitted")
        off = points.join(fitted, "_g").select("_g", residual.alias("r"))
        scale = exact_quantiles(off, ["_g"], "r", [0.5], again=True).select("_g", (F.col("values")[0] / 0.6745).alias("s"))
        fitted = stage(fitted.join(scale, "_g"), "scales")  # its size is known then, so points are not shuffled to meet it
        z = F.try_divide(residual, F.col("s"))
        loss = points.join(fitted.where("s > 1e-12"), "_g").groupBy("_g").agg(F.sum(F.when(z <= 2, z * z / 2).otherwise(2.0)).alias("loss"))
        new = fitted.join(loss, "_g", "left").select("_g", *[F.col(v).alias(f"new_{v}") for v in ("a", "c", "s", "loss")])
        stays = F.col("new_loss").isNull() | F.coalesce(F.abs(F.col("new_loss") - F.col("loss")) <= 1e-8, F.lit(False))
        # an open case without a new fit keeps its last line
        moved = F.col("open") & F.col("new_a").isNotNull()
        both = state.join(new, "_g", "left")
        take = lambda v: F.when(moved, F.col(f"new_{v}")).otherwise(F.col(v)).alias(v)
        state = stage(both.select("_g", "n", take("a"), take("c"), take("s"), take("loss"), (moved & ~stays).alias("open")), "lines")
        if state.where("open").isEmpty():
            break
    line = F.when(F.col("a").isNotNull(), F.col("c")) if intercept else F.lit(0.0)
    return state.select(*[F.col(f"_g.`{b}`").alias(b) for b in by], F.col("a").alias("slope"), line.alias("intercept"), "n")
