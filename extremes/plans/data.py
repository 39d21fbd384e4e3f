"""The analyses' inputs, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SUBDAILY
from ..operators.blockmax import block_maxima, regular_axis
from ..operators.ranks import rank_and_ecdf
from ..shared import stage

DURATIONS = SUBDAILY
SHAPE = -0.114
BY = ["loc", "duration"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly sums of event values by type, on a regular axis, with their place on it; the block is the day."""
    raw = stage(table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("loc"), F.date_trunc("hour", "ts").alias("hour")).agg(F.sum("value").alias("v")), "hourly")
    return regular_axis(raw, ["loc"], "hour", position="pos").withColumn("block", F.date_format("hour", "yyyyMMdd").cast("int"))


def maxima(spark: SparkSession, sf_dir: str, durations=DURATIONS, across: bool = False) -> DataFrame:
    return block_maxima(hourly(spark, sf_dir), ["loc"], "hour", "v", "block", durations, across_blocks=across, position="pos", part_rows=max(durations))


def ranked(spark: SparkSession, sf_dir: str, durations=DURATIONS) -> DataFrame:
    return rank_and_ecdf(maxima(spark, sf_dir, durations), BY)


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as stations on a 5 x 5 grid of nations, moved a little; some longitudes are negative, some missing."""
    s = table(spark, sf_dir, "supplier")
    lat = 10.0 * F.floor(F.col("s_nationkey") / 5) + (F.col("s_suppkey") % 7) - 3
    lon = 10.0 * (F.col("s_nationkey") % 5) + (F.col("s_suppkey") % 5) - 2
    return s.select(F.col("s_suppkey").alias("station"), F.col("s_name").alias("name"), lat.alias("latitude"), F.when(F.col("s_suppkey") % 11 != 0, lon).alias("longitude"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").alias("cell"), (10.0 * F.floor(F.col("n_nationkey") / 5)).alias("latitude"), (10.0 * (F.col("n_nationkey") % 5)).alias("longitude"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as raw station records, with repeats of a station's day."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("station"), F.col("l_shipdate").alias("time"), F.col("l_quantity").alias("prcp_amt"),
        F.when(F.col("l_linenumber") < 7, 1).alias("version_num"), F.when(F.col("l_returnflag") != "A", 1).otherwise(2).alias("ob_hour_count"),
        "l_orderkey", "l_linenumber",
    )


# The same in SQL.


def sql_hourly() -> str:
    return """hourly0 AS (SELECT event_type AS loc, date_trunc('hour', ts) AS hour, sum(value) AS v FROM events GROUP BY 1, 2),
hourly AS (SELECT l.loc, t.hour, h.v, CAST(strftime(t.hour, '%Y%m%d') AS INTEGER) AS block
  FROM (SELECT DISTINCT loc FROM hourly0) l CROSS JOIN (SELECT DISTINCT hour FROM hourly0) t LEFT JOIN hourly0 h ON h.loc = l.loc AND h.hour = t.hour)"""


def sql_maxima(durations=DURATIONS, across: bool = False) -> str:
    part = "loc" if across else "loc, block"
    one = lambda d: f"""SELECT loc, {d} AS duration, block, max(m) AS annual_max FROM (SELECT loc, block, CASE WHEN count(v) OVER w >= {max(int(0.9 * d), 1)} THEN avg(v) OVER w END AS m
  FROM hourly WINDOW w AS (PARTITION BY {part} ORDER BY hour ROWS BETWEEN {d - 1} PRECEDING AND CURRENT ROW)) GROUP BY loc, block"""  # noqa: E731
    return f"{sql_hourly()},\nams AS ({' UNION ALL '.join(one(d) for d in durations)})"


def sql_ranked(durations=DURATIONS) -> str:
    return f"""{sql_maxima(durations)},
ranked AS (SELECT *, rk / n_obs AS ecdf FROM (SELECT loc, duration, block, annual_max,
  CASE WHEN annual_max IS NOT NULL THEN rank() OVER (PARTITION BY loc, duration ORDER BY annual_max NULLS LAST) + (count(*) OVER (PARTITION BY loc, duration, annual_max) - 1) / 2.0 END AS rk,
  count(annual_max) OVER (PARTITION BY loc, duration) AS n_obs FROM ams))"""


def sql_resampled(n_sample: int, seed: int, levels: list[str]) -> str:
    """Rows (loc, duration, ci, ev_param, gev, gev_scaled, slope, intercept, rsquared, spearman) over resamples by joins."""
    k = f"CAST({SHAPE} AS DOUBLE)"
    at = lambda c: "CASE ci WHEN 'estimate' THEN max(CASE WHEN sample < 0 THEN {0} END) {1} END AS {0}".format(c, " ".join(f"WHEN '{x}' THEN quantile_cont(CASE WHEN sample >= 0 THEN {c} END, {x})" for x in levels))
    labels = ", ".join(f"('{x}')" for x in ["estimate", *levels])
    return f"""valid AS (SELECT *, row_number() OVER (PARTITION BY loc, duration ORDER BY block) - 1 AS idx, count(*) OVER (PARTITION BY loc, duration) AS n FROM ams WHERE annual_max IS NOT NULL),
draws AS (SELECT n, s AS sample, CAST('0x' || substr(md5(concat('{seed}-', n, '-', s, '-', k)), 1, 8) AS BIGINT) % n AS idx FROM (SELECT DISTINCT n FROM valid), range(0, {n_sample}) a(s), LATERAL (SELECT unnest(range(0, n)) AS k)),
drawn AS (SELECT loc, duration, sample, annual_max AS x, n FROM valid JOIN draws USING (n, idx) UNION ALL SELECT loc, duration, -1, annual_max, n FROM valid),
rs AS (SELECT *, (rank() OVER (PARTITION BY loc, duration, sample ORDER BY x) + (count(*) OVER (PARTITION BY loc, duration, sample, x) - 1) / 2.0) / n AS f FROM drawn),
bs AS (SELECT loc, duration, sample, sum(x) / max(n) AS b0, 2 * sum(f * x) / max(n) - sum(x) / max(n) AS l2 FROM rs GROUP BY 1, 2, 3),
ss AS (SELECT *, l2 * {k} / (gamma(1 + {k}) * (1 - pow(2.0, -{k}))) AS scale FROM bs), ps AS (SELECT *, b0 - scale * (1 - gamma(1 + {k})) / {k} AS location FROM ss),
lp AS (SELECT loc, duration, sample, 'location' AS ev_param, location AS gev FROM ps UNION ALL SELECT loc, duration, sample, 'scale', scale FROM ps UNION ALL SELECT loc, duration, sample, 'shape', {k} FROM ps),
lg AS (SELECT *, log10(duration) AS x, CASE WHEN gev > 0 THEN log10(CASE WHEN gev > 0 THEN gev END) END AS y FROM lp),
lr AS (SELECT *, rank() OVER (PARTITION BY loc, ev_param, sample ORDER BY duration) AS rx, rank() OVER (PARTITION BY loc, ev_param, sample ORDER BY y) + (count(*) OVER (PARTITION BY loc, ev_param, sample, y) - 1) / 2.0 AS ry FROM lg),
ln AS (SELECT loc, ev_param, sample, CASE WHEN count(y) = count(x) THEN regr_slope(y, x) END AS slope, CASE WHEN count(y) = count(x) THEN regr_intercept(y, x) END AS intercept,
  CASE WHEN count(y) = count(x) AND var_pop(y) > 0 THEN regr_r2(y, x) END AS rsquared, CASE WHEN count(y) = count(x) AND var_pop(ry) > 0 THEN corr(rx, ry) END AS spearman FROM lr GROUP BY 1, 2, 3),
fl AS (SELECT lp.*, CASE WHEN ev_param = 'shape' THEN gev ELSE pow(10, intercept + slope * log10(duration)) END AS gev_scaled, slope, intercept, rsquared, spearman FROM lp JOIN ln USING (loc, ev_param, sample)),
boot AS (SELECT loc, duration, ci, ev_param, {', '.join(at(c) for c in ('gev', 'gev_scaled', 'slope', 'intercept', 'rsquared', 'spearman'))} FROM fl, (VALUES {labels}) v(ci) GROUP BY loc, duration, ci, ev_param)"""


def sql_fit(durations=DURATIONS, shape: float | None = SHAPE) -> str:
    k = "7.859 * c + 2.9554 * c * c" if shape is None else f"CAST({shape} AS DOUBLE)"
    if shape == 0:
        scale, loc = "l2 / 0.6931", "b0 - 0.5772156649015329 * scale"
    else:
        scale, loc = "l2 * shape / (gamma(1 + shape) * (1 - pow(2.0, -shape)))", "b0 - scale * (1 - gamma(1 + shape)) / shape"
    return f"""{sql_ranked(durations)},
moments AS (SELECT loc, duration, max(n_obs) AS n_obs, sum(annual_max) / max(n_obs) AS b0, sum(ecdf * annual_max) / max(n_obs) AS b1, sum(ecdf * ecdf * annual_max) / max(n_obs) AS b2 FROM ranked GROUP BY 1, 2),
fit0 AS (SELECT *, 2 * b1 - b0 AS l2, (2 * b1 - b0) / (3 * b2 - b0) - 0.63093 AS c FROM moments), fit1 AS (SELECT *, {k} AS shape FROM fit0),
fit2 AS (SELECT *, {scale} AS scale FROM fit1), fit AS (SELECT loc, duration, n_obs, {loc} AS location, scale, shape FROM fit2)"""
