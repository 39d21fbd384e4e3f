"""Exact quantiles of tables of any size, by counts over ranges instead of gathered values."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stage

#: Ranges that a round cuts a range into, and the distinct values that a range may hold to be counted out value by value.
PARTS = 64
FEW = 50_000
#: Accuracy of the approximate quantiles of large groups, and how far from a level its range reaches: twice their error.
ACCURACY = 10_000
NEAR = 2 / ACCURACY


def _range_of(v: Column, cuts: Column) -> Column:
    """Where ``v`` lies among sorted ``cuts``: 2k in the open range before cut k, 2k + 1 on the cut itself."""
    return 2 * F.size(F.filter(cuts, lambda c: c < v)) + F.when(F.array_contains(cuts, v), 1).otherwise(0)


def _placed(counts: DataFrame, order: str) -> DataFrame:
    """``counts`` by span with ``_first``, the place of its first value in the group, and those of the span's wanted places that it holds."""
    run = Window.partitionBy("_g", "_before").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.withColumn("_first", F.col("_before") + F.sum("_c").over(run) - F.col("_c"))
    return placed.withColumn("_want", F.filter("_want", lambda w: (w >= F.col("_first")) & (w < F.col("_first") + F.col("_c")))).where(F.size("_want") > 0)


def _brackets(every: DataFrame, large: DataFrame, levels: list[float]) -> DataFrame:
    """``(_of, _n, _k, _low, _high)``: a range around each level of a large group, null where open, from approximate quantiles."""
    ends = [min(max(x + d, 0.0), 1.0) for x in levels for d in (-NEAR, NEAR)]
    cuts = every.join(F.broadcast(large), "_of").groupBy("_of", "_n").agg(F.percentile_approx(F.when(~F.isnan("_v"), F.col("_v")), F.array(*map(F.lit, ends)), F.lit(ACCURACY)).alias("_e"))
    end = lambda i: (F.col("_e")[i] if 0 < ends[i] < 1 else F.lit(None).cast("double"))
    pairs = F.array(*[F.struct(end(2 * i).alias("_low"), end(2 * i + 1).alias("_high")) for i in range(len(levels))])
    return stage(cuts.select("_of", "_n", F.posexplode(pairs).alias("_k", "_b")).select("_of", "_n", "_k", "_b.*"), "value-brackets")


def exact_quantiles(df: DataFrame, by: list[str], value: str, levels: Iterable[float], parts: int = PARTS, few: int = FEW, again: bool = False) -> DataFrame:
    """``(by, values)``: an array of the quantiles of ``value`` at ``levels``, interpolated as ``percentile`` does.

    Groups of more than ``few`` values are counted in narrow ranges around approximate quantiles, and below them, so only values near the
    wanted places are shuffled; where a range misses its places, the whole group is counted. Ranges that hold more than ``few``
    distinct values are cut, by approximate quantiles of those, and counted over, until their values can be counted out. So no task holds all values of a
    group; the rounds, a job each, are as many as the logarithm of the distinct values to the base of ``parts``. Null values are left out, NaN counts as the
    largest, a group without values has a null array, and groups may be null. The values are staged in the shared folder, unless ``df`` is
    cheap to read ``again``.
    """
    levels = list(levels)
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    every = df.select(group.alias("_of"), F.col(value).cast("double").alias("_v"))
    every = every if again else stage(every, "values")
    sizes = stage(every.groupBy("_of").agg(F.count("_v").alias("_n")), "value-sizes")
    large = sizes.where(F.col("_n") > few)  # at most a group for ``few`` values
    at = [F.lit(float(x)) * (F.col("_n") - 1) for x in levels]
    ends = [F.array(F.floor(a), F.ceil(a)) for a in at]
    none = F.lit(None).cast("double")
    known = every.where("_v IS NOT NULL")
    tally = lambda values: values.groupBy("_g", "_v").agg(F.count(F.lit(1)).alias("_c"))
    whole = lambda groups: groups.select(F.struct("_of", F.lit(-1).alias("_k")).alias("_g"), F.lit(0).cast("long").alias("_before"), F.array_distinct(F.flatten(F.array(*ends))).alias("_want"))
    wanted = whole(sizes.where((F.col("_n") > 0) & (F.col("_n") <= few)))
    if large.isEmpty():
        counts = stage(tally(known.select(F.struct("_of", F.lit(-1).alias("_k")).alias("_g"), "_v")), "value-counts")
    else:
        ranges = _brackets(every, large, levels)
        inside = known.join(F.broadcast(ranges), "_of", "left").where("_high IS NULL OR _v <= _high")
        near = F.when(F.col("_low").isNull() | (F.col("_v") >= F.col("_low")), F.col("_v"))  # null: below the range
        counts = stage(tally(inside.select(F.struct("_of", F.coalesce("_k", F.lit(-1)).alias("_k")).alias("_g"), near.alias("_v"))), "value-counts")
        held = counts.groupBy("_g").agg(*[F.coalesce(F.sum(F.when(c, F.col("_c"))), F.lit(0)).alias(n) for n, c in (("_before", F.col("_v").isNull()), ("_there", F.col("_v").isNotNull()))])
        own = ranges.select(F.struct("_of", "_k").alias("_g"), "_of", "_n", F.array_distinct(F.get(F.array(*ends), "_k")).alias("_want")).join(held, "_g", "left")
        hits = F.coalesce((F.array_min("_want") >= F.col("_before")) & (F.array_max("_want") < F.col("_before") + F.col("_there")), F.lit(False))
        own = stage(own.withColumn("_hit", hits), "value-hits")
        wanted = wanted.unionByName(own.where("_hit").select("_g", "_before", "_want"))
        missed = own.where("NOT _hit").select("_of", "_n").distinct()
        if not missed.isEmpty():
            left = known.join(F.broadcast(missed), "_of").select(F.struct("_of", F.lit(-1).alias("_k")).alias("_g"), "_v")
            counts, wanted = counts.unionByName(stage(tally(left), "value-counts")), wanted.unionByName(whole(missed))
    # spans: open ranges of a group's values, the number of values before each, and the places wanted in it
    spans = wanted.select("_g", none.alias("_low"), none.alias("_high"), "_before", "_want")
    picked = []
    while True:
        inside = counts.where("_v IS NOT NULL").join(spans, "_g").where("(_low IS NULL OR _v > _low) AND (_high IS NULL OR _v < _high)")
        most = inside.groupBy("_g", "_before").count().agg(F.max("count")).first()[0] or 0
        if most <= few:
            picked.append(_placed(inside, "_v").select("_g", F.explode("_want").alias("_place"), "_v"))
            break
        fractions = F.array(*[F.lit(i / parts) for i in range(1, parts)])
        cuts = inside.groupBy("_g", "_before").agg(F.array_sort(F.array_distinct(F.percentile_approx("_v", fractions))).alias("_cuts"))
        ranged = inside.join(cuts, ["_g", "_before"]).withColumn("_i", _range_of(F.col("_v"), F.col("_cuts")))
        totals = ranged.groupBy("_g", "_low", "_high", "_before", "_want", "_cuts", "_i").agg(F.sum("_c").alias("_c"))
        hit = stage(_placed(totals, "_i").withColumn("_k", F.floor(F.col("_i") / 2).cast("int")), "value-ranges")
        cut = lambda k: F.get("_cuts", k)  # noqa: E731  null beyond either end
        picked.append(hit.where("_i % 2 = 1").select("_g", F.explode("_want").alias("_place"), cut(F.col("_k")).alias("_v")))
        spans = hit.where("_i % 2 = 0").select("_g", F.coalesce(cut(F.col("_k") - 1), "_low").alias("_low"), F.coalesce(cut(F.col("_k")), "_high").alias("_high"), F.col("_first").alias("_before"), "_want")
    found = picked[0]
    for more in picked[1:]:
        found = found.unionByName(more)
    found = found.select("_g._of", "_place", "_v").distinct()  # ranges of near levels may share a place
    known = found.groupBy("_of").agg(F.map_from_entries(F.collect_list(F.struct("_place", "_v"))).alias("_at"))
    place = lambda p: F.try_element_at("_at", p)
    between = [F.when(F.floor(a) == F.ceil(a), place(F.floor(a))).otherwise((F.ceil(a) - a) * place(F.floor(a)) + (a - F.floor(a)) * place(F.ceil(a))) for a in at]
    out = sizes.join(known, "_of", "left").select("_of", F.when(F.col("_n") > 0, F.array(*between)).alias("values"))
    return out.select(*[F.col(f"_of.`{b}`").alias(b) for b in by], "values")
