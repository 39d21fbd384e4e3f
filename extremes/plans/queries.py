"""One query for each operator of the library over the given tables, with its SQL where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ALL_DURATIONS, FitConfig, label, quantile_levels
from ..functions import gev
from ..operators import blockmax, bootstrap, compare, fit, grid, products, quantiles, ranks, report, stations
from ..shared import stage
from . import data
from .data import BY, DURATIONS, SHAPE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


CONFIG = FitConfig()


def _resampled(spark, sf_dir):
    """Fits over all sub-daily durations with the intervals of the settings."""
    return bootstrap.fit_with_intervals(data.maxima(spark, sf_dir), ["loc"], CONFIG.n_sample, CONFIG.widths, CONFIG.seed, SHAPE)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _fit(spark, sf_dir, shape=SHAPE, durations=DURATIONS):
    return fit.fit_gev(data.ranked(spark, sf_dir, durations), BY, shape=shape)


_GEV_Q = "location + scale * (1 - pow(-ln(1 - 1 / T), shape)) / shape"


@query(f"WITH {data.sql_fit()} SELECT loc, duration, n_obs, round(location, 6) AS location, round(scale, 6) AS scale, shape, CAST(100 AS DOUBLE) AS T, round({_GEV_Q.replace('T)', '100.0)')}, 6) AS intensity FROM fit")
def flagship_intensity(spark, sf_dir):
    """Rolling maxima, ranks, fit with a given shape, and the value of a return period of 100 blocks."""
    return rounded(quantiles.intensities(_fit(spark, sf_dir), 30, [100]).drop("ci"))


@query(f"WITH {data.sql_maxima()} SELECT loc, duration, block, round(annual_max, 6) AS annual_max FROM ams")
def block_maxima(spark, sf_dir):
    return rounded(data.maxima(spark, sf_dir))


@query(f"WITH {data.sql_maxima(ALL_DURATIONS, across=True)} SELECT loc, duration, block, round(annual_max, 8) AS annual_max FROM ams")
def block_maxima_across(spark, sf_dir):
    """All 19 durations, windows running through the ends of blocks."""
    return rounded(data.maxima(spark, sf_dir, ALL_DURATIONS, across=True), 8)


@query(f"""WITH {data.sql_hourly()}, m AS (SELECT loc, block, hour, row_number() OVER (PARTITION BY loc, block ORDER BY hour) - 1 AS pos,
  CASE WHEN count(v) OVER w >= 2 THEN avg(v) OVER w END AS x FROM hourly WINDOW w AS (PARTITION BY loc, block ORDER BY hour ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
k AS (SELECT *, row_number() OVER (PARTITION BY loc, block ORDER BY round(x, 9) DESC NULLS LAST, pos) AS k FROM m)
SELECT loc, block, 3 AS duration, CASE WHEN x IS NOT NULL THEN CAST(pos AS INTEGER) END AS position, CASE WHEN x IS NOT NULL THEN hour END AS at FROM k WHERE k = 1""")
def positions_of_maxima(spark, sf_dir):
    return blockmax.positions_of_maxima(data.hourly(spark, sf_dir), ["loc"], "hour", "v", "block", [3])


_POSITIONS = {"weibull": "rk / (n_obs + 1)", "cunnane": "(rk - 0.4) / (n_obs + 0.2)", "gringorten": "(rk - 0.44) / (n_obs + 0.12)", "landwehr": "(rk - 0.35) / n_obs", "goda": "(rk - 0.45) / n_obs"}


@query(f"WITH {data.sql_ranked()} SELECT loc, duration, block, rk AS rank, n_obs, round(ecdf, 6) AS ecdf, " + ", ".join(f"round({x}, 6) AS {k}" for k, x in _POSITIONS.items()) + " FROM ranked")
def ranks_and_positions(spark, sf_dir):
    df = data.ranked(spark, sf_dir)
    return rounded(df.select("loc", "duration", "block", "rank", "n_obs", "ecdf", *[gev.plotting_position(k, F.col("rank"), F.col("n_obs")).alias(k) for k in _POSITIONS]))


@query(f"WITH {data.sql_fit(shape=None)} SELECT loc, duration, round(location, 5) AS location, round(scale, 5) AS scale, round(shape, 5) AS shape, round(shape * sqrt(n_obs / 0.5633), 5) AS z FROM fit")
def gev_free_shape(spark, sf_dir):
    df = _fit(spark, sf_dir, None)
    return rounded(df.select("loc", "duration", "location", "scale", "shape", gev.z_test(F.col("shape"), F.col("n_obs")).alias("z")), 5)


@query(f"WITH {data.sql_fit(shape=0)} SELECT loc, duration, round(location, 6) AS location, round(scale, 6) AS scale, round(location - scale * ln(-ln(1 - 1 / 50.0)), 6) AS q50 FROM fit")
def gumbel_fit(spark, sf_dir):
    df = _fit(spark, sf_dir, 0.0)
    return rounded(df.select("loc", "duration", "location", "scale", gev.quantile(F.lit(50.0), F.col("location"), F.col("scale"), F.col("shape")).alias("q50")))


_LONG = "SELECT loc, duration, 'location' AS ev_param, location AS gev FROM fit UNION ALL SELECT loc, duration, 'scale', scale FROM fit UNION ALL SELECT loc, duration, 'shape', shape FROM fit"
_LINES = f"""params AS ({_LONG}), logs AS (SELECT *, log10(duration) AS x, CASE WHEN gev > 0 THEN log10(CASE WHEN gev > 0 THEN gev END) END AS y FROM params),
lr AS (SELECT *, rank() OVER (PARTITION BY loc, ev_param ORDER BY duration) AS rx, CASE WHEN y IS NOT NULL THEN rank() OVER (PARTITION BY loc, ev_param ORDER BY y NULLS LAST) END AS ry FROM logs),
lines AS (SELECT loc, ev_param, CASE WHEN count(y) = count(x) THEN regr_slope(y, x) END AS slope, CASE WHEN count(y) = count(x) THEN regr_intercept(y, x) END AS intercept,
  CASE WHEN count(y) = count(x) AND var_pop(y) > 0 THEN regr_r2(y, x) END AS rsquared, CASE WHEN count(y) = count(x) THEN corr(rx, ry) END AS spearman FROM lr GROUP BY 1, 2)"""


def _lines(spark, sf_dir, durations=DURATIONS):
    params = stage(fit.long_params(_fit(spark, sf_dir, durations=durations), BY), "params")
    return params, fit.scaling(params, ["loc"])


@query(f"WITH {data.sql_fit()}, {_LINES} SELECT loc, ev_param, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(rsquared, 6) AS rsquared, round(spearman, 6) AS spearman FROM lines")
def scaling_lines(spark, sf_dir):
    return rounded(_lines(spark, sf_dir)[1])


@query(f"""WITH {data.sql_fit()}, {_LINES} SELECT p.loc, p.duration, p.ev_param, round(p.gev, 6) AS gev,
  round(CASE WHEN p.ev_param = 'shape' THEN p.gev ELSE pow(10, l.intercept + l.slope * log10(p.duration)) END, 6) AS gev_scaled FROM params p LEFT JOIN lines l USING (loc, ev_param)""")
def scaled_parameters(spark, sf_dir):
    params, lines = _lines(spark, sf_dir)
    return rounded(fit.with_scaled(params, lines, ["loc"]).select("loc", "duration", "ev_param", "gev", "gev_scaled"))


_POINTS = """points AS (SELECT *, CASE WHEN 1 - shape * (annual_max - location) / scale >= 0 THEN exp(-pow(greatest(1 - shape * (annual_max - location) / scale, 0), 1 / shape)) END AS cdf,
  location + scale * (1 - pow(-ln((rk - 0.4) / (n_obs + 0.2)), shape)) / shape AS qe FROM ranked JOIN (SELECT loc, duration, location, scale, shape FROM fit) USING (loc, duration)),
gof AS (SELECT loc, duration, max(abs(ecdf - cdf)) AS KS_D, CASE WHEN count(annual_max) = count(*) THEN corr(annual_max, qe) END AS filliben_stat FROM points GROUP BY 1, 2)"""


def _gof(spark, sf_dir):
    ranked = stage(data.ranked(spark, sf_dir), "ranked")  # read for the fits and for the points
    points = fit.gof_points(ranked, fit.fit_gev(ranked, BY, shape=SHAPE), BY)
    return points, fit.goodness_of_fit(points, BY)


@query(f"WITH {data.sql_fit()}, {_POINTS} SELECT loc, duration, round(KS_D, 6) AS KS_D, round(filliben_stat, 6) AS filliben_stat FROM gof")
def goodness_of_fit(spark, sf_dir):
    return rounded(_gof(spark, sf_dir)[1])


@query(f"WITH {data.sql_fit()}, {_POINTS} SELECT loc, duration, block, round(cdf, 6) AS cdf, round((rk - 0.4) / (n_obs + 0.2), 6) AS pp_cunnane, round(1 / (1 - (rk - 0.4) / (n_obs + 0.2)), 6) AS T_cunnane, round(qe, 6) AS quantile_estimate FROM points")
def gof_points(spark, sf_dir):
    return rounded(_gof(spark, sf_dir)[0].select(*BY, "block", "cdf", "pp_cunnane", "T_cunnane", "quantile_estimate"))


_CRIT = f"""crit AS (SELECT 0.05::DOUBLE AS significance_level, 1 - exp(-(1.527 - 0.7656 * k + 2.228 * k * k - 3.824 * k * k * k) * pow(n, 0.1986 + 0.3858 * k - 0.5985 * k * k)) AS filliben_crit FROM (SELECT {SHAPE}::DOUBLE AS k, max(n_obs) AS n FROM fit)
  UNION ALL SELECT 0.1, 1 - exp(-(1.695 - 0.5205 * k + 1.229 * k * k - 2.809 * k * k * k) * pow(n, 0.1912 + 0.2838 * k - 0.3765 * k * k)) FROM (SELECT {SHAPE}::DOUBLE AS k, max(n_obs) AS n FROM fit))"""


@query(f"WITH {data.sql_fit()}, {_CRIT} SELECT significance_level, round(filliben_crit, 6) AS filliben_crit FROM crit")
def filliben_critical(spark, sf_dir):
    return rounded(fit.critical_values(_fit(spark, sf_dir), SHAPE))


@query(f"WITH {data.sql_fit()}, {_POINTS}, {_CRIT} SELECT round(count(*) FILTER (WHERE filliben_stat < filliben_crit) / count(filliben_stat), 6) AS share_below FROM gof CROSS JOIN (SELECT filliben_crit FROM crit WHERE significance_level = 0.05)")
def share_below_critical(spark, sf_dir):
    return rounded(report.share_below_critical(_gof(spark, sf_dir)[1], fit.critical_values(_fit(spark, sf_dir), SHAPE)))


def _md5(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"


@query(f"""WITH {data.sql_fit()}, ns AS (SELECT DISTINCT CAST(n_obs AS INTEGER) AS n FROM fit),
u AS (SELECT n, s AS sample, k, ({_md5("concat('d1-', n, '-', s, '-', k)")} + 0.5) / 4294967296.0 AS u FROM ns, range(0, 10000) a(s), LATERAL (SELECT unnest(range(1, n + 1)) AS k)),
x AS (SELECT *, (1 - pow(-ln(u), {SHAPE})) / {SHAPE} AS x FROM u), r AS (SELECT *, (rank() OVER (PARTITION BY n, sample ORDER BY x) + (count(*) OVER (PARTITION BY n, sample, x) - 1) / 2.0) / n AS f FROM x),
b AS (SELECT n, sample, sum(x) / n AS b0, 2 * sum(f * x) / n - sum(x) / n AS l2 FROM r GROUP BY n, sample), p AS (SELECT *, l2 * {SHAPE} / (gamma(1 + {SHAPE}) * (1 - pow(2.0, -({SHAPE})))) AS scale FROM b),
d AS (SELECT n, sample, max(abs(f - exp(-pow(1 - ({SHAPE}) * (x - (b0 - scale * (1 - gamma(1 + {SHAPE})) / {SHAPE})) / scale, 1 / {SHAPE})))) AS d FROM r JOIN p USING (n, sample) WHERE 1 - ({SHAPE}) * (x - (b0 - scale * (1 - gamma(1 + {SHAPE})) / {SHAPE})) / scale >= 0 GROUP BY n, sample)
SELECT n, 0.05::DOUBLE AS significance_level, round(quantile_cont(d, 0.95), 6) AS Dcrit FROM d GROUP BY n UNION ALL SELECT n, 0.1, round(quantile_cont(d, 0.9), 6) FROM d GROUP BY n""")
def critical_d(spark, sf_dir):
    """Simulated limits of D for the record lengths of the data."""
    return rounded(bootstrap.critical_d(spark, _fit(spark, sf_dir).select(F.col("n_obs").alias("n")), SHAPE))


_SAMPLES = f"""valid AS (SELECT *, row_number() OVER (PARTITION BY loc, duration ORDER BY block) - 1 AS idx, count(*) OVER (PARTITION BY loc, duration) AS n FROM ams WHERE annual_max IS NOT NULL),
draws AS (SELECT n, s AS sample, k, {_md5("concat('1-', n, '-', s, '-', k)")} % n AS idx FROM (SELECT DISTINCT n FROM valid), range(0, {CONFIG.n_sample}) a(s), LATERAL (SELECT unnest(range(0, n)) AS k)),
drawn AS (SELECT loc, duration, sample, annual_max AS x, n FROM valid JOIN draws USING (n, idx)),
rs AS (SELECT *, (rank() OVER (PARTITION BY loc, duration, sample ORDER BY x) + (count(*) OVER (PARTITION BY loc, duration, sample, x) - 1) / 2.0) / n AS f FROM drawn),
bs AS (SELECT loc, duration, sample, sum(x) / max(n) AS b0, 2 * sum(f * x) / max(n) - sum(x) / max(n) AS l2 FROM rs GROUP BY 1, 2, 3),
ss AS (SELECT *, l2 * {SHAPE} / (gamma(1 + {SHAPE}) * (1 - pow(2.0, -({SHAPE})))) AS scale FROM bs), ps AS (SELECT *, b0 - scale * (1 - gamma(1 + {SHAPE})) / {SHAPE} AS location FROM ss)"""


_LEVELS = [label(x) for x in quantile_levels(CONFIG.widths)]
_BOOT = f"WITH {data.sql_maxima()}, {data.sql_resampled(CONFIG.n_sample, CONFIG.seed, _LEVELS)}"
_six = lambda *c: ", ".join(f"round({x}, 6) AS {x}" for x in c)


@query(f"{_BOOT} SELECT loc, duration, ci, round(max(CASE WHEN ev_param = 'location' THEN gev END), 6) AS location, round(max(CASE WHEN ev_param = 'scale' THEN gev END), 6) AS scale FROM boot GROUP BY 1, 2, 3")
def bootstrap_intervals(spark, sf_dir):
    """Intervals of location and scale over the resamples of the settings."""
    rows = _resampled(spark, sf_dir)
    pick = lambda p: F.max(F.when(F.col("ev_param") == p, F.col("gev"))).alias(p)
    return rounded(rows.groupBy(*BY, "ci").agg(pick("location"), pick("scale")))


@query(f"""WITH {data.sql_maxima()}, {_SAMPLES} SELECT loc, duration, CAST(sample AS INTEGER) AS sample, round(location, 6) AS location, round(scale, 6) AS scale FROM ps""")
def bootstrap_samples(spark, sf_dir):
    """All resampled fits, by joins."""
    df = bootstrap.fit_samples_sql(data.maxima(spark, sf_dir), ["loc"], CONFIG.n_sample, CONFIG.seed, SHAPE)
    return rounded(df.where("sample >= 0").select(*BY, "sample", "location", "scale"))


@query(f"{_BOOT} SELECT DISTINCT loc, ci, ev_param, {_six('slope', 'intercept', 'rsquared', 'spearman')} FROM boot")
def bootstrap_scaling(spark, sf_dir):
    """Scaling lines with intervals over resamples."""
    return rounded(_resampled(spark, sf_dir).select("loc", "ci", "ev_param", "slope", "intercept", "rsquared", "spearman")).distinct()


_RAW = """rec AS (SELECT l_suppkey AS station, l_shipdate AS time, l_quantity AS amt, CASE WHEN l_linenumber < 7 THEN 1 END AS version_num, CASE WHEN l_returnflag <> 'A' THEN 1 ELSE 2 END AS ob_hour_count, l_orderkey, l_linenumber FROM lineitem),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station, time ORDER BY l_orderkey, l_linenumber, amt, version_num NULLS FIRST, ob_hour_count) AS k FROM rec) WHERE k = 1)"""


def _first(spark, sf_dir):
    return stations.first_records(data.records(spark, sf_dir), ["station", "time"], ["l_orderkey", "l_linenumber", "prcp_amt", "version_num", "ob_hour_count"])


@query(f"""WITH {_RAW}, day AS (SELECT *, sum(amt) OVER w AS s, count(amt) OVER w AS n FROM first WINDOW w AS (PARTITION BY station ORDER BY time ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
f AS (SELECT station, time, amt, coalesce(version_num <> 1, true) OR coalesce(ob_hour_count <> 1, true) AS qc0, coalesce(amt >= 40.0 * 1.2, false) AS qc1, coalesce(CASE WHEN n >= 21 THEN s END >= 600 * 1.2, false) AS qc3 FROM day)
SELECT station, time, qc0, qc1, qc3, CASE WHEN NOT qc0 AND NOT qc1 AND NOT qc3 THEN amt END AS prcp_amt FROM f""")
def station_quality(spark, sf_dir):
    """First record of each station and day, quality flags, masked amounts."""
    return stations.with_quality(_first(spark, sf_dir), ["station"], "time", daily_limit=600, hourly_limit=40).select("station", "time", "qc0", "qc1", "qc3", "prcp_amt")


@query(f"""WITH {data.sql_hourly()}, d AS (SELECT *, CASE WHEN count(v) OVER w >= 21 THEN sum(v) OVER w END AS s FROM hourly WINDOW w AS (PARTITION BY loc ORDER BY hour ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
m AS (SELECT loc, month(hour) AS mo, avg(s) / 12 AS mean FROM d GROUP BY 1, 2) SELECT d.loc, d.hour, round(d.v, 6) AS v, coalesce(d.v >= 2 * m.mean * 12, false) AS qc4 FROM d JOIN m ON m.loc = d.loc AND m.mo = month(d.hour) WHERE hour(d.hour) = 9""")
def qc4(spark, sf_dir):
    return rounded(stations.qc4(data.hourly(spark, sf_dir), ["loc"], "hour", "v").select("loc", "hour", "v", "qc4"))


@query("""WITH r AS (SELECT l_suppkey AS station, CAST(year(l_shipdate) AS INTEGER) AS year, l_quantity AS amt, l_orderkey, l_linenumber FROM lineitem), c AS (SELECT station, year, count(amt) >= 85 AS full_year FROM r GROUP BY 1, 2),
k AS (SELECT station FROM c GROUP BY 1 HAVING count(*) FILTER (WHERE full_year) >= floor((SELECT count(DISTINCT year) FROM c) * 0.5))
SELECT station, year, count(*) AS n_rows, count(CASE WHEN full_year THEN amt END) AS n_kept, coalesce(sum(CASE WHEN full_year THEN amt END), -1) AS total FROM r JOIN c USING (station, year) WHERE station IN (SELECT station FROM k) GROUP BY 1, 2""")
def complete_years(spark, sf_dir):
    """Stations with enough full years; other years keep their rows without amounts."""
    df = data.records(spark, sf_dir).withColumn("year", F.year("time"))
    kept = stations.select_complete(df, "station", "year", "prcp_amt", 85, 0.5)
    return kept.groupBy("station", "year").agg(F.count("*").alias("n_rows"), F.count("prcp_amt").alias("n_kept"), F.coalesce(F.sum("prcp_amt"), F.lit(-1.0)).alias("total"))


_STATIONS = """stations AS (SELECT s_suppkey AS station, s_name AS name, 10.0::DOUBLE * floor(s_nationkey / 5.0) + (s_suppkey % 7) - 3 AS latitude,
  CASE WHEN s_suppkey % 11 <> 0 THEN 10.0::DOUBLE * (s_nationkey % 5) + (s_suppkey % 5) - 2 END AS longitude FROM supplier)"""
_CELLS = "cells AS (SELECT n_nationkey AS cell, 10.0::DOUBLE * floor(n_nationkey / 5.0) AS latitude, 10.0::DOUBLE * (n_nationkey % 5) AS longitude FROM nation)"
_NEAREST = f"""{_STATIONS}, {_CELLS}, pts AS (SELECT station, latitude AS lat, CASE WHEN longitude < 0 THEN longitude + 360 ELSE longitude END AS lon FROM stations WHERE latitude IS NOT NULL AND longitude IS NOT NULL),
near AS (SELECT station, (SELECT arg_min(latitude, abs(latitude - lat) - latitude * 1e-9) FROM cells) AS cell_lat, (SELECT arg_min(longitude, abs(longitude - lon) - longitude * 1e-9) FROM cells) AS cell_lon FROM pts)"""


def _near(spark, sf_dir):
    pts = stations.located(data.stations(spark, sf_dir)).withColumn("longitude", grid.positive_longitude(F.col("longitude")))
    return grid.nearest_cells(data.cells(spark, sf_dir), pts.select("station", "latitude", "longitude"))


@query(f"WITH {_NEAREST} SELECT * FROM near")
def nearest_cells(spark, sf_dir):
    return _near(spark, sf_dir)


@query(f"""WITH {_STATIONS}, obs AS (SELECT l_suppkey + (CASE WHEN l_linenumber = 7 THEN 1000000 ELSE 0 END) AS station, l_quantity FROM lineitem)
SELECT o.station, coalesce(s.name, '') AS name, s.latitude, s.longitude, count(*) AS n, sum(o.l_quantity) AS amount FROM obs o LEFT JOIN stations s USING (station) GROUP BY 1, 2, 3, 4""")
def station_metadata(spark, sf_dir):
    """Metadata onto observations; unknown stations have no name."""
    obs = data.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") + F.when(F.col("l_linenumber") == 7, 1000000).otherwise(0)).alias("station"), "l_quantity")
    return stations.with_metadata(obs, data.stations(spark, sf_dir)).groupBy("station", "name", "latitude", "longitude").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("amount"))


@query(f"WITH {_STATIONS} SELECT station, name, 'POINT (' || longitude || ' ' || latitude || ')' AS geometry FROM stations WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND name <> '' AND station NOT IN (3, 5)")
def station_points(spark, sf_dir):
    return stations.drop_stations(stations.station_points(data.stations(spark, sf_dir)), [3, 5]).select("station", "name", "geometry")


@query("""WITH m AS (SELECT l_shipdate AS day, CASE WHEN sum(l_quantity) % 5 <> 0 THEN sum(l_quantity) END AS v FROM lineitem GROUP BY 1), u AS (SELECT o_orderdate AS day, CAST(count(*) AS DOUBLE) AS v FROM orders GROUP BY 1)
SELECT day, coalesce(m.v, u.v) AS v FROM m FULL JOIN u USING (day)""")
def fill_gaps(spark, sf_dir):
    """Missing sums of a main record from an update."""
    total = F.sum("l_quantity")
    main = data.table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").alias("day")).agg(F.when(total % 5 != 0, total).alias("v"))
    update = data.table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").alias("day")).agg(F.count("*").cast("double").alias("v"))
    return grid.fill_gaps(main, update, ["day"], "v")


_GRID_AMS = """g AS (SELECT 10.0::DOUBLE * floor(s_nationkey / 5.0) AS latitude, 10.0::DOUBLE * (s_nationkey % 5) AS longitude, CAST(year(l_shipdate) AS INTEGER) AS block, max(l_quantity + l_extendedprice / 1e4) AS annual_max
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3)"""


def _grid_ams(spark, sf_dir):
    s = data.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (10.0 * F.floor(F.col("s_nationkey") / 5)).alias("latitude"), (10.0 * (F.col("s_nationkey") % 5)).alias("longitude"))
    df = data.table(spark, sf_dir, "lineitem").join(s, "l_suppkey").withColumn("block", F.year("l_shipdate"))
    return df.groupBy("latitude", "longitude", "block").agg(F.max(F.col("l_quantity") + F.col("l_extendedprice") / 1e4).alias("annual_max"))


@query(f"""WITH {_GRID_AMS} SELECT 5.0 + floor(i / 2.0) * 20.0 AS latitude, 5.0 + floor(j / 2.0) * 20.0 AS longitude, CAST((i % 2 * 2 + j % 2) * 7 + block - 1995 AS INTEGER) AS block, round(annual_max, 6) AS annual_max
FROM (SELECT *, CAST(round(latitude / 10) AS INTEGER) AS i, CAST(round(longitude / 10) AS INTEGER) AS j FROM g)""")
def pooled_cells(spark, sf_dir):
    df = grid.pool(_grid_ams(spark, sf_dir), (0.0, 0.0), 10.0, 20.0, 1995, 7)
    return rounded(df.select("latitude", "longitude", "block", "annual_max"))


@query(f"WITH {_GRID_AMS} SELECT latitude, longitude, block, round(annual_max, 6) AS annual_max FROM g WHERE latitude <> (SELECT max(latitude) FROM g) AND latitude BETWEEN 0 AND 30 AND longitude BETWEEN 10 AND 30")
def grid_extract(spark, sf_dir):
    return rounded(grid.extract(grid.trim_first_row(_grid_ams(spark, sf_dir)), (30, 0), (10, 30)).select("latitude", "longitude", "block", "annual_max"))


@query(f"WITH {_GRID_AMS} SELECT latitude, longitude, round(max(annual_max), 6) AS maximum FROM g GROUP BY 1, 2")
def maximum_over_time(spark, sf_dir):
    return rounded(report.maximum_over_time(_grid_ams(spark, sf_dir), ["latitude", "longitude"], "annual_max"))


@query("SELECT l_suppkey AS station, count(*) AS n, sum(l_quantity) AS amount FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-03-01' AND l_shipdate < TIMESTAMP '1998-01-01' GROUP BY 1")
def in_period(spark, sf_dir):
    df = stations.in_period(data.records(spark, sf_dir), "time", "1996-03", "1997")
    return df.groupBy("station").agg(F.count("*").alias("n"), F.sum("prcp_amt").alias("amount"))


@query(f"""WITH {data.sql_fit()}, {_POINTS}, {_CRIT} SELECT f.loc, f.duration, round(f.location, 6) AS location, round(f.scale, 6) AS scale, round(g.KS_D, 6) AS D, round(g.filliben_stat, 6) AS filliben_stat,
(SELECT round(filliben_crit, 6) FROM crit WHERE significance_level = 0.05) AS filliben_crit_05, (SELECT round(filliben_crit, 6) FROM crit WHERE significance_level = 0.1) AS filliben_crit_10 FROM fit f LEFT JOIN gof g USING (loc, duration)""")
def product_by_duration(spark, sf_dir):
    params = fit.long_params(_fit(spark, sf_dir), BY).withColumn("ci", F.lit("estimate"))
    return rounded(products.params_by_duration(params, ["loc"], _gof(spark, sf_dir)[1], fit.critical_values(_fit(spark, sf_dir), SHAPE)))


_TABLE = "tab AS (SELECT loc, pow(10, max(intercept) FILTER (WHERE ev_param = 'location')) AS a, max(slope) FILTER (WHERE ev_param = 'location') AS alpha, max(rsquared) FILTER (WHERE ev_param = 'location') AS location_r2, pow(10, max(intercept) FILTER (WHERE ev_param = 'scale')) AS b, max(slope) FILTER (WHERE ev_param = 'scale') AS beta, max(rsquared) FILTER (WHERE ev_param = 'scale') AS scale_r2 FROM lines GROUP BY 1)"


@query(f"WITH {data.sql_fit()}, {_LINES}, {_TABLE} SELECT loc, round(a, 6) AS a, round(alpha, 6) AS alpha, round(location_r2, 6) AS location_r2, round(b, 6) AS b, round(beta, 6) AS beta, round(scale_r2, 6) AS scale_r2, round(alpha / beta, 4) AS alpha_beta_ratio FROM tab")
def product_scaling(spark, sf_dir):
    df = products.scaling_ratio(products.scaling_table(_lines(spark, sf_dir)[1], ["loc"]))
    return rounded(df.withColumn("alpha_beta_ratio", F.round("alpha_beta_ratio", 4)))


_side = lambda c, p: f"max(CASE WHEN ev_param = '{p}' THEN {c} END)"


@query(f"""{_BOOT}, one AS (SELECT loc, duration, ci, {_side('gev', 'location')} AS location_ci, {_side('gev', 'scale')} AS scale_ci, {_side('intercept', 'location')} AS a_ci, {_side('slope', 'location')} AS alpha_ci, {_side('intercept', 'scale')} AS b_ci,
{_side('slope', 'scale')} AS beta_ci FROM boot WHERE ci <> 'estimate' GROUP BY 1, 2, 3) SELECT loc, duration, CAST(ci AS DOUBLE) AS ci, {_six('location_ci', 'scale_ci', 'a_ci', 'alpha_ci', 'b_ci', 'beta_ci')} FROM one""")
def product_intervals(spark, sf_dir):
    """Interval limits of the published tables."""
    rows = _resampled(spark, sf_dir)
    return rounded(products.params_by_duration_ci(rows, ["loc"]).join(products.scaling_table_ci(rows, ["loc"]), ["loc", "ci"]))


@query(f"""WITH {data.sql_fit()}, {_LINES}, longer AS (SELECT loc, ev_param, CASE WHEN count(y) = count(x) THEN regr_slope(y, x) END AS slope FROM logs WHERE duration >= 3 GROUP BY 1, 2)
SELECT loc, ev_param, round(l.slope, 6) AS slope_all, round(s.slope, 6) AS slope_some, round(l.slope / s.slope, 4) AS ratio FROM lines l JOIN longer s USING (loc, ev_param)""")
def slope_ratio(spark, sf_dir):
    """Slopes over all durations and over the longer ones."""
    params, lines = _lines(spark, sf_dir)
    some = fit.scaling(params.where("duration >= 3"), ["loc"])
    df = products.slope_ratio(lines, some, ["loc"])
    return rounded(df.withColumn("ratio", F.round("ratio", 4)))


_T3 = ", ".join(f"({n}, {gev.t_quantile(0.025, n - 2)!r}::DOUBLE, {gev.t_quantile(0.975, n - 2)!r}::DOUBLE)" for n in range(3, 400))
_INT = f"""least AS (SELECT min(n_obs) AS n FROM fit), tq AS (SELECT t.lo, t.hi, least.n FROM least LEFT JOIN (VALUES {_T3}) t(n, lo, hi) ON t.n = least.n),
ints AS (SELECT loc, duration, T, location + scale * (1 - pow(-ln(1 - 1 / T), shape)) / shape AS i, scale * scale * (1.1412 + 0.8216 * y + 1.2546 * y * y) / greatest(tq.n, 1) AS var, lo, hi, greatest(tq.n, 1) AS n FROM
  (SELECT *, (1 - pow(-ln(1 - 1 / T), shape)) / shape AS y FROM fit, (VALUES (2.0::DOUBLE), (10), (100)) t(T)), tq)"""


@query(f"""WITH {data.sql_fit()}, {_INT} SELECT loc, duration, T, 'estimate' AS ci, round(i, 6) AS intensity FROM ints
UNION ALL SELECT loc, duration, T, '0.025', round(i + lo * sqrt(var / n), 6) FROM ints UNION ALL SELECT loc, duration, T, '0.975', round(i + hi * sqrt(var / n), 6) FROM ints""")
def intensity_intervals(spark, sf_dir):
    """Limits by the least record length of the fits."""
    df = quantiles.intensities(_fit(spark, sf_dir), None, [2, 10, 100], ("estimate", "0.025", "0.975"))
    return rounded(df.select("loc", "duration", "T", "ci", "intensity"))


def _sources(spark, sf_dir):
    """Fitted and scaled intensities as two sources beside the Gumbel fit as the reference."""
    moments = stage(fit.moments(data.ranked(spark, sf_dir), BY), "moments")  # read for each source
    fitted = fit.fit_moments(moments, SHAPE)
    params = fit.long_params(fitted, BY)
    scaled = fit.with_scaled(params, fit.scaling(params, ["loc"]), ["loc"]).groupBy(*BY).agg(*[F.max(F.when(F.col("ev_param") == p, F.col("gev_scaled"))).alias(p) for p in fit.PARAMS])
    parts = {"fitted": fitted, "scaled": scaled, "reference": fit.fit_moments(moments, 0.0)}
    out = None
    for name, df in parts.items():
        one = quantiles.intensities(df.select(*BY, *fit.PARAMS), 30, [10, 50]).select(F.lit(name).alias("source"), *BY, "T", "intensity")
        out = one if out is None else out.unionByName(one)
    return out


_CELL_FIT = f"""{_GRID_AMS}, gr AS (SELECT *, (rank() OVER w + (count(*) OVER (PARTITION BY latitude, longitude, annual_max) - 1) / 2.0) / count(*) OVER (PARTITION BY latitude, longitude) AS f FROM g WINDOW w AS (PARTITION BY latitude, longitude ORDER BY annual_max)),
gb AS (SELECT latitude, longitude, avg(annual_max) AS b0, 2 * avg(f * annual_max) - avg(annual_max) AS l2 FROM gr GROUP BY 1, 2), gs AS (SELECT *, l2 * {SHAPE} / (gamma(1 + {SHAPE}) * (1 - pow(2.0, -({SHAPE})))) AS scale FROM gb),
gf AS (SELECT latitude, longitude, b0 - scale * (1 - gamma(1 + {SHAPE})) / {SHAPE} AS location, scale, {SHAPE}::DOUBLE AS shape FROM gs)"""


def _cell_fit(spark, sf_dir):
    keys = ["latitude", "longitude"]
    return stage(fit.fit_gev(ranks.rank_and_ecdf(_grid_ams(spark, sf_dir), keys), keys, shape=SHAPE).drop("n_obs"), "cells")


_SOURCES = f"""{data.sql_fit()}, {_LINES}, gum AS (SELECT loc, duration, b0 - 0.5772156649015329 * (l2 / 0.6931) AS location, l2 / 0.6931 AS scale FROM fit0),
sc AS (SELECT loc, duration, max(g) FILTER (WHERE ev_param = 'location') AS location, max(g) FILTER (WHERE ev_param = 'scale') AS scale, max(gev) FILTER (WHERE ev_param = 'shape') AS shape FROM
  (SELECT p.*, pow(10, l.intercept + l.slope * log10(p.duration)) AS g FROM params p LEFT JOIN lines l USING (loc, ev_param)) GROUP BY 1, 2), ts AS (SELECT unnest([10.0::DOUBLE, 50]) AS T),
src AS (SELECT 'fitted' AS source, loc, duration, T, {_GEV_Q} AS intensity FROM fit, ts UNION ALL SELECT 'scaled', loc, duration, T, {_GEV_Q} FROM sc, ts
  UNION ALL SELECT 'reference', loc, duration, T, location - scale * ln(-ln(1 - 1 / T)) FROM gum, ts),
prs AS (SELECT s.source, loc, duration, T, s.intensity AS est, r.intensity AS ref FROM src s JOIN (SELECT * FROM src WHERE source = 'reference') r USING (loc, duration, T) WHERE s.source <> 'reference')"""


def _pairs(spark, sf_dir):
    return compare.pair_with_reference(_sources(spark, sf_dir), "reference", [*BY, "T"])


@query(f"""WITH {_SOURCES} SELECT source, duration, T, round(avg(abs(est - ref)), 6) AS mae, round(avg(abs((est - ref) / ref)), 6) AS mape, round(quantile_cont((est - ref) / ref, 0.025), 6) AS pe_low,
round(quantile_cont((est - ref) / ref, 0.5), 6) AS mdpe, round(quantile_cont((est - ref) / ref, 0.975), 6) AS pe_high FROM prs GROUP BY 1, 2, 3""")
def source_errors(spark, sf_dir):
    return rounded(compare.errors(_pairs(spark, sf_dir), ["source", "duration", "T"]))


@query(f"WITH {_SOURCES} SELECT source, duration, T, round(avg(abs((est - ref) / ref)), 6) AS mape FROM prs GROUP BY 1, 2, 3 HAVING avg(abs((est - ref) / ref)) <= 0.2")
def adequate_sources(spark, sf_dir):
    return rounded(compare.adequate(compare.errors(_pairs(spark, sf_dir), ["source", "duration", "T"])).select("source", "duration", "T", "mape"))


_GAUGES = f"""{_CELL_FIT}, {_NEAREST}, ga AS (SELECT l_suppkey AS station, year(l_shipdate) AS block, max(l_quantity + l_extendedprice / 1e4) AS x FROM lineitem GROUP BY 1, 2),
gr2 AS (SELECT *, (rank() OVER (PARTITION BY station ORDER BY x) + (count(*) OVER (PARTITION BY station, x) - 1) / 2.0) / count(*) OVER (PARTITION BY station) AS f FROM ga),
gb2 AS (SELECT station, avg(x) AS b0, 2 * avg(f * x) - avg(x) AS l2 FROM gr2 GROUP BY 1), gs2 AS (SELECT *, l2 * {SHAPE} / (gamma(1 + {SHAPE}) * (1 - pow(2.0, -({SHAPE})))) AS scale FROM gb2),
gg AS (SELECT station, b0 - scale * (1 - gamma(1 + {SHAPE})) / {SHAPE} AS location, scale, {SHAPE}::DOUBLE AS shape FROM gs2), t6 AS (SELECT unnest([2.0::DOUBLE, 10, 50, 100, 500, 1000]) AS T),
prs AS (SELECT 'grid' AS source, near.station, 24 AS duration, T, r.q AS ref, e.q AS est FROM near
  JOIN (SELECT station, T, {_GEV_Q} AS q FROM gg, t6) r USING (station) JOIN (SELECT latitude, longitude, T, {_GEV_Q} AS q FROM gf, t6) e USING (T) WHERE e.latitude = cell_lat AND e.longitude = cell_lon)"""


def _gauges(spark, sf_dir):
    """Suppliers as gauges with coordinates and fits of their yearly maxima."""
    value = F.max(F.col("l_quantity") + F.col("l_extendedprice") / 1e4).alias("annual_max")
    ams = data.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("station"), F.year("l_shipdate").alias("block")).agg(value)
    fits = fit.fit_gev(ranks.rank_and_ecdf(ams, ["station"]), ["station"], shape=SHAPE)
    placed = fits.join(data.stations(spark, sf_dir).select("station", "latitude", "longitude"), "station")
    return stage(placed.withColumn("duration", F.lit(24)), "gauges")


def _against_cells(spark, sf_dir):
    return _gauges(spark, sf_dir), {"grid": _cell_fit(spark, sf_dir).withColumn("duration", F.lit(24))}


@query(f"""WITH {_GAUGES} SELECT source, duration, T, round(avg(abs(est - ref)), 6) AS mae, round(avg(abs((est - ref) / ref)), 6) AS mape, round(quantile_cont((est - ref) / ref, 0.025), 6) AS pe_low,
round(quantile_cont((est - ref) / ref, 0.5), 6) AS mdpe, round(quantile_cont((est - ref) / ref, 0.975), 6) AS pe_high FROM prs GROUP BY 1, 2, 3""")
def gauge_errors(spark, sf_dir):
    """The errors of ``comparison_report``."""
    return rounded(compare.errors(compare.station_report_pairs(*_against_cells(spark, sf_dir)), ["source", "duration", "T"]))


@query()
def comparison_report(spark, sf_dir):
    """Gauges against their nearest cells: errors, areal reduction and robust lines for six return periods; held against a direct computation in the tests."""
    return compare.station_report(*_against_cells(spark, sf_dir))


@query(f"""WITH {_GAUGES}, lq AS (SELECT least_n.n, t.lo, t.hi FROM (SELECT min(c) AS n FROM (SELECT count(annual_max) AS c FROM g GROUP BY latitude, longitude)) least_n LEFT JOIN (VALUES {_T3}) t(n, lo, hi) ON t.n = least_n.n),
gy AS (SELECT name, T, {_GEV_Q} AS i, scale, (1 - pow(-ln(1 - 1 / T), shape)) / shape AS y FROM near JOIN stations USING (station) JOIN gf ON gf.latitude = cell_lat AND gf.longitude = cell_lon, (VALUES (5.0::DOUBLE), (50)) t(T)),
gv AS (SELECT *, sqrt(scale * scale * (1.1412 + 0.8216 * y + 1.2546 * y * y) / n / n) AS h FROM gy, lq)
SELECT name, 24 AS duration, T, round(i, 6) AS estimate, round(i + lo * h, 6) AS low, round(i + hi * h, 6) AS high FROM gv""")
def limits_at_points(spark, sf_dir):
    """Intensities with limits as columns at all sites."""
    keys = ["latitude", "longitude"]
    params = fit.fit_gev(ranks.rank_and_ecdf(_grid_ams(spark, sf_dir), keys), keys, shape=SHAPE).withColumn("duration", F.lit(24))
    sites = compare.site_list(stations.located(data.stations(spark, sf_dir)), "name")
    return rounded(quantiles.limits_at_points(params, sites, [5, 50]))


@query(f"WITH {_SOURCES} SELECT loc, duration, T, round(max(intensity) FILTER (WHERE source = 'fitted'), 6) AS fitted, round(max(intensity) FILTER (WHERE source = 'scaled'), 6) AS scaled FROM src WHERE duration IN (1, 6, 24) GROUP BY 1, 2, 3")
def sources_side_by_side(spark, sf_dir):
    df = _sources(spark, sf_dir).where(F.col("duration").isin(1, 6, 24))
    return rounded(compare.side_by_side(df, [*BY, "T"], ["fitted", "scaled"]))


_MPE = f"""{_SOURCES}, e AS (SELECT s.duration, s.T, avg((s.intensity - f.intensity) / f.intensity) AS mpe, min((s.intensity - f.intensity) / f.intensity) AS least, max((s.intensity - f.intensity) / f.intensity) AS largest, count(*) AS n
FROM src s JOIN src f ON s.loc = f.loc AND s.duration = f.duration AND s.T = f.T WHERE s.source = 'scaled' AND f.source = 'fitted' GROUP BY 1, 2)"""


@query(f"WITH {_MPE} SELECT duration, T, round(mpe, 6) AS mpe, round(least, 6) AS least, round(largest, 6) AS largest, n FROM e")
def scaling_error(spark, sf_dir):
    s = _sources(spark, sf_dir)
    return rounded(compare.mean_percentage_error(s.where("source = 'scaled'"), s.where("source = 'fitted'"), ["loc"], ["duration", "T"]))


@query(f"WITH {_MPE} SELECT round(min(mpe), 6) AS least, round(max(mpe), 6) AS largest FROM e")
def scaling_error_extent(spark, sf_dir):
    s = _sources(spark, sf_dir)
    return rounded(compare.error_extent(compare.mean_percentage_error(s.where("source = 'scaled'"), s.where("source = 'fitted'"), ["loc"], ["duration", "T"])))


@query(f"""WITH {data.sql_fit()}, {_LINES}, r AS (SELECT p.ev_param, p.duration, (pow(10, l.intercept + l.slope * log10(p.duration)) - p.gev) / p.gev AS d FROM params p JOIN lines l USING (loc, ev_param) WHERE ev_param <> 'shape')
SELECT ev_param, duration, 0.05::DOUBLE AS q, round(quantile_cont(d, 0.05), 6) AS value FROM r GROUP BY 1, 2 UNION ALL SELECT ev_param, duration, 0.5, round(quantile_cont(d, 0.5), 6) FROM r GROUP BY 1, 2""")
def relative_differences(spark, sf_dir):
    params, lines = _lines(spark, sf_dir)
    both = fit.with_scaled(params, lines, ["loc"]).where("ev_param <> 'shape'")
    return rounded(compare.relative_difference_quantiles(both, ["ev_param", "duration"], [0.05, 0.5]))


@query(f"WITH {data.sql_fit()}, {_LINES} SELECT ev_param, count(*) FILTER (WHERE slope IS NULL) AS n_missing, count(*) AS n FROM lines GROUP BY 1")
def missing_lines(spark, sf_dir):
    return report.count_missing(_lines(spark, sf_dir)[1], ["ev_param"], "slope")


@query(f"WITH {data.sql_fit()}, {_LINES} SELECT ev_param, q, round(CASE q WHEN 0.01 THEN quantile_cont(rsquared, 0.01) ELSE quantile_cont(rsquared, 0.05) END, 6) AS value FROM lines, (VALUES (0.01::DOUBLE), (0.05)) t(q) GROUP BY 1, 2")
def rsquared_quantiles(spark, sf_dir):
    return rounded(report.quantile_table(_lines(spark, sf_dir)[1], ["ev_param"], "rsquared", [0.01, 0.05]))


@query(f"WITH {data.sql_fit()}, {_POINTS} SELECT stat, q, round(CASE q WHEN 0.5 THEN quantile_cont(v, 0.5) ELSE quantile_cont(v, 0.95) END, 6) AS value FROM (SELECT 'KS_D' AS stat, KS_D AS v FROM gof UNION ALL SELECT 'filliben_stat', filliben_stat FROM gof), (VALUES (0.5::DOUBLE), (0.95)) t(q) GROUP BY 1, 2")
def gof_quantiles(spark, sf_dir):
    """Quantiles of both statistics over all locations and durations."""
    both = _gof(spark, sf_dir)[1].selectExpr("stack(2, 'KS_D', KS_D, 'filliben_stat', filliben_stat) AS (stat, v)")
    return rounded(report.quantile_table(both, ["stat"], "v", [0.5, 0.95]))


@query(f"WITH {data.sql_fit()}, {_POINTS} SELECT loc, round(avg(KS_D), 6) AS KS_D, round(avg(filliben_stat), 6) AS filliben_stat FROM gof GROUP BY 1")
def mean_gof(spark, sf_dir):
    return rounded(report.mean_statistics(_gof(spark, sf_dir)[1], ["loc"], ["KS_D", "filliben_stat"]))


@query("""WITH e AS (SELECT quantile_cont(l_quantity, 0.01) AS x0, quantile_cont(l_quantity, 0.99) AS x1 FROM lineitem), p AS (SELECT l_quantity AS x, l_discount * 500 AS y, x0, x1 FROM lineitem, e)
SELECT CAST(bx AS BIGINT) AS bx, CAST("by" AS BIGINT) AS "by", count(*) AS n FROM (SELECT least(floor((x - x0) / (x1 - x0) * 20), 19) AS bx, least(floor((y - x0) / (x1 - x0) * 20), 19) AS "by" FROM p WHERE x BETWEEN x0 AND x1 AND y BETWEEN x0 AND x1) GROUP BY 1, 2 HAVING count(*) >= 20""")
def density(spark, sf_dir):
    df = data.table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_discount") * 500).alias("y"))
    return report.density(df, "x", "y", least=20)


@query("SELECT l_returnflag, count(*) FILTER (WHERE l_discount > 0.05) AS n_over, count(l_discount) AS n FROM lineitem GROUP BY 1")
def count_over_alpha(spark, sf_dir):
    return report.count_significant(data.table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_discount")


@query("""WITH d AS (SELECT round(l_discount - l_tax, 9) AS r FROM lineitem), s AS (SELECT count(*) AS n, avg(r) AS m, stddev_samp(r) AS s FROM d),
k AS (SELECT r, rank() OVER (ORDER BY abs(r)) + (count(*) OVER (PARTITION BY abs(r)) - 1) / 2.0 AS k FROM d), c AS (SELECT abs(r) AS a, CAST(count(*) AS DOUBLE) AS c FROM d GROUP BY 1),
w AS (SELECT (SELECT sum(k) FROM k WHERE r > 0) AS p, (SELECT sum(k) FROM k WHERE r < 0) AS q, (SELECT coalesce(sum(c), 0) FROM c WHERE a = 0) AS z0, (SELECT sum(c * c * c - c) FROM c WHERE a > 0) AS ties, CAST(s.n AS DOUBLE) AS n, m, s FROM s)
SELECT CAST(n AS BIGINT) AS n, round(m / (s / sqrt(n)), 5) AS t, p AS w_plus, q AS w_minus,
round((p - (n * (n + 1) - z0 * (z0 + 1)) / 4) / sqrt((n * (n + 1) * (2 * n + 1) - z0 * (z0 + 1) * (2 * z0 + 1)) / 24 - ties / 48), 5) AS z FROM w""")
def paired_tests(spark, sf_dir):
    """Discount against tax: paired t and signed ranks; the p-values are in ``paired_test_of_maxima``."""
    df = data.table(spark, sf_dir, "lineitem").select(F.round(F.col("l_discount") - F.col("l_tax"), 9).alias("x"), F.lit(0.0).alias("y"))
    return report.paired_tests(df, "x", "y").select("n", F.round("t", 5).alias("t"), "w_plus", "w_minus", F.round("z", 5).alias("z"))


@query()
def paired_test_of_maxima(spark, sf_dir):
    """Slopes of location and scale of all locations (alpha and beta), with p-values; held against published tables in the tests."""
    tab = products.scaling_table(_lines(spark, sf_dir)[1], ["loc"])
    return report.paired_tests(tab, "alpha", "beta")


@query("SELECT l_discount AS value, count(*) AS n, (SELECT count(*) FROM lineitem b WHERE b.l_discount < a.l_discount) + (count(*) + 1) / 2.0 AS rank FROM lineitem a GROUP BY l_discount")
def global_ranks(spark, sf_dir):
    """Ranks over a whole table without a window over it."""
    df = data.table(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("value"))
    return ranks.global_average_rank(df, "value")


@query("""WITH r AS (SELECT l_returnflag AS flag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS x,
rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS y FROM (SELECT * FROM lineitem)) SELECT flag, round(corr(x, y), 6) AS rho FROM r GROUP BY 1""")
def rank_correlation(spark, sf_dir):
    df = data.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_quantity", "l_extendedprice")
    return rounded(ranks.spearman(df, ["flag"], "l_quantity", "l_extendedprice"))


@query(f"""WITH {_NEAREST}, g AS (SELECT n_nationkey AS cell, CAST(n_regionkey AS DOUBLE) AS level FROM nation), names AS (SELECT station, name FROM stations)
SELECT 'grid' AS source, nm.name, g.level FROM near JOIN names nm USING (station) JOIN cells c ON c.latitude = cell_lat AND c.longitude = cell_lon JOIN g ON g.cell = c.cell
UNION ALL SELECT 'point', p.s_name, round(p.s_acctbal, 6) FROM supplier p WHERE p.s_suppkey % 11 <> 0""")
def combined_sources(spark, sf_dir):
    """A grid source by nearest cell and a point source by name, at all sites."""
    sites = compare.site_list(stations.located(data.stations(spark, sf_dir)), "name")
    level = data.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("cell"), F.col("n_regionkey").cast("double").alias("level"))
    cells = data.cells(spark, sf_dir).join(level, "cell")
    points = data.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.round("s_acctbal", 6).alias("level"))
    return compare.combine_sources(sites, {"grid": cells}, {"point": points}, ["level"])


@query(f"""WITH {_STATIONS}, {_CELLS}, s AS (SELECT l_suppkey AS station, CAST(l_linenumber AS INTEGER) AS duration, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2), p AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b, a.s_suppkey || '--' || b.s_suppkey AS pair FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1),
e AS (SELECT pair, 'first' AS source, duration, v FROM p JOIN s ON s.station = a UNION ALL SELECT pair, 'last', duration, v FROM p JOIN s ON s.station = b),
gl AS (SELECT c.latitude, c.longitude, CAST(l_linenumber AS INTEGER) AS duration, avg(l_quantity) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN cells c ON c.cell = s_nationkey GROUP BY 1, 2, 3),
pts AS (SELECT pair, latitude AS lat, CASE WHEN longitude < 0 THEN longitude + 360 ELSE longitude END AS lon FROM p JOIN stations ON station = b WHERE longitude IS NOT NULL),
near AS (SELECT pair, (SELECT arg_min(latitude, abs(latitude - lat) - latitude * 1e-9) FROM gl) AS cell_lat, (SELECT arg_min(longitude, abs(longitude - lon) - longitude * 1e-9) FROM gl) AS cell_lon FROM pts),
panel AS (SELECT * FROM e UNION ALL SELECT pair, 'mean', duration, avg(v) FROM e GROUP BY 1, 3 UNION ALL SELECT pair, 'grid', duration, v FROM near JOIN gl ON latitude = cell_lat AND longitude = cell_lon),
ln AS (SELECT pair, source, regr_slope(log10(v), log10(duration)) AS m, regr_intercept(log10(v), log10(duration)) AS c FROM panel GROUP BY 1, 2)
SELECT pair, source, duration, round(v, 6) AS v, round(pow(10, c) * pow(duration, m), 6) AS line FROM panel JOIN ln USING (pair, source)""")
def pair_panel(spark, sf_dir):
    """Every station with the next one: both, their mean and the cell nearest to the last, with the fitted line of each series."""
    line = F.col("l_linenumber").cast("int").alias("duration")
    items = data.table(spark, sf_dir, "lineitem")
    df = items.groupBy(F.col("l_suppkey").cast("string").alias("station"), line).agg(F.avg("l_quantity").alias("v"))
    ids = data.stations(spark, sf_dir)
    follow = ids.select((F.col("station") - 1).alias("station"))
    pairs = ids.join(follow, "station", "left_semi").select(F.concat_ws("--", F.col("station").cast("string"), (F.col("station") + 1).cast("string")).alias("pair"))
    at_cell = data.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("cell")).join(data.cells(spark, sf_dir), "cell")
    level = items.join(at_cell, "l_suppkey").groupBy("latitude", "longitude", line).agg(F.avg("l_quantity").alias("v"))
    panel = compare.station_pairs_panel(pairs, df, ["duration"], ["v"], level, ids.select(F.col("station").cast("string").alias("station"), "latitude", "longitude"))
    return rounded(compare.with_line(panel, ["pair", "source"], "v"))


@query("""SELECT 'items' AS source, l_shipdate AS time, sum(l_quantity) AS v FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-12-01' AND l_shipdate < TIMESTAMP '1997-02-01' GROUP BY 2
UNION ALL SELECT 'orders', o_orderdate, CAST(count(*) AS DOUBLE) FROM orders WHERE o_orderdate >= TIMESTAMP '1996-12-01' AND o_orderdate < TIMESTAMP '1997-02-01' GROUP BY 2""")
def overlay(spark, sf_dir):
    """Two series of a period under each other."""
    a = data.table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").alias("time")).agg(F.sum("l_quantity").alias("v"))
    b = data.table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").alias("time")).agg(F.count("*").cast("double").alias("v"))
    return stations.in_period(compare.overlay({"items": a, "orders": b}, "time", "v"), "time", "1996-12", "1997-01")


@query(f"WITH {_CELL_FIT} SELECT latitude, longitude, T, round({_GEV_Q}, 6) AS intensity FROM gf, (VALUES (20.0::DOUBLE)) t(T)")
def intensity_field(spark, sf_dir):
    """The quantile of one return period in every cell."""
    return rounded(quantiles.field(_cell_fit(spark, sf_dir).withColumn("duration", F.lit(24)), 24, 20).select("latitude", "longitude", "T", "intensity"))


@query(f"WITH {_CELL_FIT}, {_NEAREST} SELECT s.name, T, round({_GEV_Q}, 6) AS intensity FROM near JOIN stations s USING (station) JOIN gf ON gf.latitude = cell_lat AND gf.longitude = cell_lon, (VALUES (5.0::DOUBLE), (50)) t(T)")
def point_intensities(spark, sf_dir):
    """Intensities of several return periods at all sites."""
    sites = compare.site_list(stations.located(data.stations(spark, sf_dir)), "name")
    return rounded(quantiles.at_points(_cell_fit(spark, sf_dir), sites, [5, 50]).select("name", "T", "intensity"))


@query(f"WITH {data.sql_ranked()} SELECT loc, duration, block, kind, round(CASE kind WHEN 'weibull' THEN rk / (n_obs + 1) ELSE (rk - 0.4) / (n_obs + 0.2) END, 6) AS p, round(1 / (1 - CASE kind WHEN 'weibull' THEN rk / (n_obs + 1) ELSE (rk - 0.4) / (n_obs + 0.2) END), 6) AS T FROM ranked, (VALUES ('weibull'), ('cunnane')) t(kind)")
def probability_table(spark, sf_dir):
    wide = data.ranked(spark, sf_dir).select(*BY, "block", *[gev.plotting_position(k, F.col("rank"), F.col("n_obs")).alias(k) for k in ("weibull", "cunnane")])
    return rounded(products.probability_table(wide, [*BY, "block"], ["weibull", "cunnane"]))


@query(f"WITH {data.sql_fit()} SELECT loc, duration, CAST(t AS DOUBLE) AS T, round(location + scale * (1 - pow(-ln(1 - 1.0::DOUBLE / t), shape)) / shape, 6) AS quantile FROM fit, range(2, 10000) r(t)")
def theoretical_curve(spark, sf_dir):
    return rounded(products.theoretical_curve(_fit(spark, sf_dir)).select(*BY, "T", "quantile"))


_SITE = ", ".join(f"round(max(CASE WHEN ev_param = '{p}' AND ci = '{ci}' THEN {v} END), 6) AS hourly_{p}{mark}_{end}" for p in ("location", "scale") for v, mark in (("gev", ""), ("gev_scaled", "_lr")) for ci, end in (("estimate", "est"), ("0.025", "ci_l"), ("0.975", "ci_h")))


@query(f"{_BOOT} SELECT loc, duration, {_SITE} FROM boot GROUP BY 1, 2")
def site_table(spark, sf_dir):
    """Wide table of sites with intervals and scaled values."""
    rows = _resampled(spark, sf_dir).withColumn("source", F.lit("hourly"))
    return rounded(products.site_table(rows, "loc", ["hourly"]))


@query(f"{_BOOT} SELECT loc, duration, ci, ev_param, {_six('gev', 'gev_scaled', 'slope', 'intercept', 'rsquared', 'spearman')} FROM boot WHERE duration = 24")
def sizing_values(spark, sf_dir):
    """Values with limits at the locations of one duration."""
    rows = _resampled(spark, sf_dir)
    return rounded(quantiles.sizing(rows, data.hourly(spark, sf_dir).select("loc").distinct(), ["loc"], 24, _LEVELS))


@query(f"""WITH {_GRID_AMS}, {_NEAREST}, ams AS (SELECT latitude || '/' || longitude AS loc, 24 AS duration, block, annual_max FROM g), {data.sql_resampled(CONFIG.n_sample, CONFIG.seed, ["0.025", "0.975"])}
SELECT s.name, ci, ev_param, round(gev, 6) AS gev FROM near JOIN stations s USING (station) JOIN boot ON loc = cell_lat || '/' || cell_lon""")
def sizing_at_points(spark, sf_dir):
    """Fitted values with limits at the cells nearest to all sites."""
    ams = _grid_ams(spark, sf_dir).withColumn("duration", F.lit(24))
    rows = bootstrap.fit_with_intervals(ams, ["latitude", "longitude"], CONFIG.n_sample, (0.95,), CONFIG.seed, SHAPE).where("ci <> '0.500'")
    sites = compare.site_list(stations.located(data.stations(spark, sf_dir)), "name")
    return rounded(quantiles.sizing_at(rows, sites, 24).select("name", "ci", "ev_param", "gev"))


@query(f"""WITH {_NEAREST}, own AS (SELECT l_suppkey AS station, l_shipdate AS time, sum(l_quantity) AS v FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-12-01' AND l_shipdate < TIMESTAMP '1997-01-01' GROUP BY 1, 2),
cell_sums AS (SELECT c.latitude, c.longitude, l_shipdate AS time, sum(l_quantity) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN cells c ON c.cell = s_nationkey WHERE l_shipdate >= TIMESTAMP '1996-12-01' AND l_shipdate < TIMESTAMP '1997-01-01' GROUP BY 1, 2, 3)
SELECT s.name, 'station' AS source, time, v FROM own JOIN stations s USING (station) WHERE s.longitude IS NOT NULL
UNION ALL SELECT s.name, 'grid', c.time, c.v FROM near JOIN stations s USING (station) JOIN cell_sums c ON c.latitude = cell_lat AND c.longitude = cell_lon""")
def station_overlay(spark, sf_dir):
    """Series of every station and of its nearest cell over one month."""
    items = stations.in_period(data.table(spark, sf_dir, "lineitem"), "l_shipdate", "1996-12", "1996-12").withColumnRenamed("l_shipdate", "time")
    supplier = data.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("cell"))
    every = items.join(supplier, "l_suppkey")
    level = every.join(data.cells(spark, sf_dir), "cell").groupBy("latitude", "longitude", "time").agg(F.sum("l_quantity").alias("v"))
    sites = compare.site_list(stations.located(data.stations(spark, sf_dir)), "name")
    return compare.station_overlay(every.groupBy("name", "time").agg(F.sum("l_quantity").alias("v")), sites, level, "time", "v")
