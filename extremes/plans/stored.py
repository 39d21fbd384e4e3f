"""Queries that go through stored tables and files: each writes what it derives from the given tables into the shared folder and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import gev
from ..operators import blockmax, products, quantiles, stations
from ..operators.robust import robust_lines_at_size
from ..shared import stage_path
from ..sources import records, stages
from . import data
from .data import BY, DURATIONS, SHAPE
from .queries import _LINES, _TABLE, _fit, _lines, query, rounded

_MAXIMA = f"WITH {data.sql_maxima()} SELECT loc, duration, block, round(annual_max, 6) AS annual_max FROM ams"


@query(_MAXIMA)
def bucketed_maxima(spark, sf_dir):
    """Block maxima from a record that is stored in buckets of locations: no shuffle behind the scan."""
    name = f"hourly_{uuid.uuid4().hex}"
    stored = stages.write_bucketed(data.hourly(spark, sf_dir), name, ["loc"], "hour", 8, stage_path(spark, name))
    return rounded(blockmax.block_maxima(stored, ["loc"], "hour", "v", "block", DURATIONS))


@query(_MAXIMA)
def updated_maxima(spark, sf_dir):
    """Block maxima of a record that grows: all but the last block at first, then the last one alone, into one stored table."""
    hourly = data.hourly(spark, sf_dir).select("loc", "hour", "v", F.col("block").alias("day"))
    last = hourly.agg(F.max("day")).first()[0] or 0
    source, target = stage_path(spark, "record"), stage_path(spark, "maxima")
    for part in (F.col("day") < last, F.col("day") >= last):
        hourly.where(part).write.mode("append").partitionBy("day").parquet(source)
        stages.update_maxima(spark, source, target, ["loc"], "hour", "v", "day", DURATIONS)
    return rounded(records.read_maxima(spark, target, 0, last).select("loc", "duration", "block", "annual_max"))


_DAYS = """m AS (SELECT l_shipdate AS day, CAST(year(l_shipdate) AS INTEGER) AS year, CASE WHEN sum(l_quantity) % 5 <> 0 THEN sum(l_quantity) END AS v FROM lineitem GROUP BY 1, 2),
u AS (SELECT o_orderdate AS day, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(count(*) AS DOUBLE) AS v FROM orders WHERE year(o_orderdate) IN (1996, 1997) GROUP BY 1, 2)"""


def _updated(spark, sf_dir) -> tuple[dict, DataFrame]:
    """A stored daily record with gaps, filled from an update that holds two years; the counts of the merge and the record."""
    total = F.sum("l_quantity")
    main = data.table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").alias("day"), F.year("l_shipdate").alias("year")).agg(F.when(total % 5 != 0, total).alias("v"))
    update = data.table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").alias("day"), F.year("o_orderdate").alias("year")).agg(F.count("*").cast("double").alias("v"))
    path = stage_path(spark, "daily")
    stages.write_blocks(main, path, "year")
    return stages.update_record(spark, path, update.where(F.col("year").isin(1996, 1997)), ["day"], "v", "year"), spark.read.parquet(path)


@query(f"WITH {_DAYS} SELECT day, coalesce(m.year, u.year) AS year, coalesce(m.v, u.v) AS v FROM m FULL JOIN u USING (day)")
def updated_record(spark, sf_dir):
    """The record after the update; years that the update does not hold keep their files."""
    return _updated(spark, sf_dir)[1].select("day", "year", "v")


@query(f"""WITH {_DAYS}, b AS (SELECT m.v AS was, coalesce(m.v, u.v) AS v FROM (SELECT * FROM m WHERE year IN (SELECT year FROM u)) m FULL JOIN u USING (day))
SELECT count(*) AS rows, count(*) FILTER (WHERE v IS NULL) AS gaps, count(*) FILTER (WHERE was IS NULL AND v IS NOT NULL) AS filled FROM b""")
def update_counts(spark, sf_dir):
    """What the update filled and left open, counted in the pass that writes."""
    counts = _updated(spark, sf_dir)[0]
    return spark.createDataFrame([(counts["rows"], counts["gaps"], counts["filled"])], "rows long, gaps long, filled long")


def _station_files(spark, sf_dir) -> str:
    """Line items as lines of station files: blanks, NaN, short lines and text for amounts among them."""
    item = data.table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity")
    amount = F.when(q == 1, "NaN").when(q == 2, " ").when(q == 3, "much").otherwise(q.cast("string"))
    head = [F.date_format("l_shipdate", "yyyy-MM-dd HH:mm"), F.col("l_orderkey").cast("string"), F.lit("RAIN"), F.lit("1"), F.lit("1"), F.lit("X"), F.col("l_suppkey").cast("string"), F.lit("5")]
    line = F.when(F.col("l_linenumber") == 7, F.concat_ws(",", *head[:5])).otherwise(F.concat_ws(",", *head, amount, F.lit("60"), F.lit(""), F.lit(""), F.lit("a"), F.lit("b"), F.lit("c")))
    path = stage_path(spark, "station-files")
    item.select(line.alias("value")).write.text(path)
    return path


_BAD = "(l_linenumber = 7 OR l_quantity = 3)"


@query(f"SELECT l_suppkey AS src_id, count(*) AS n, count(CASE WHEN l_quantity > 2 THEN 1 END) AS n_amounts, coalesce(sum(CASE WHEN l_quantity > 2 THEN l_quantity END), -1) AS amount FROM lineitem WHERE NOT {_BAD} GROUP BY 1")
def station_files(spark, sf_dir):
    """Stations read from text files: blanks and NaN are missing, malformed lines stay out."""
    df = stations.useful(records.read_stations(spark, _station_files(spark, sf_dir)))
    return df.groupBy("src_id").agg(F.count("*").alias("n"), F.count("prcp_amt").alias("n_amounts"), F.coalesce(F.sum("prcp_amt"), F.lit(-1.0)).alias("amount"))


@query(f"SELECT l_linenumber = 7 AS short, count(*) AS n FROM lineitem WHERE {_BAD} GROUP BY 1")
def malformed_lines(spark, sf_dir):
    """The lines that ``station_files`` leaves out, by their fault."""
    df = records.malformed_lines(spark, _station_files(spark, sf_dir))
    return df.groupBy((F.size(F.split("malformed", ",")) < 15).alias("short")).agg(F.count("*").alias("n"))


@query("""SELECT s_suppkey AS station, s_name AS name, round(s_acctbal, 2) AS latitude, CASE WHEN s_suppkey % 11 <> 0 THEN CAST(s_nationkey AS DOUBLE) END AS longitude FROM supplier""")
def station_list(spark, sf_dir):
    """Metadata from a headed text file with further columns."""
    s = data.table(spark, sf_dir, "supplier")
    path = stage_path(spark, "station-list")
    s.select(
        F.col("s_suppkey").alias("SRC_ID"), F.col("s_name").alias("SRC_NAME"), F.round("s_acctbal", 2).alias("HIGH_PRCN_LAT"),
        F.when(F.col("s_suppkey") % 11 != 0, F.col("s_nationkey").cast("double")).alias("HIGH_PRCN_LON"), F.lit("more").alias("FURTHER"),
    ).write.csv(path, sep="|", header=True)
    return records.read_station_list(spark, path)


@query("""SELECT 10.0::DOUBLE * floor(s_nationkey / 5.0) AS latitude, 10.0::DOUBLE * (s_nationkey % 5) AS longitude, CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS n, round(sum(l_quantity), 4) AS total
FROM (SELECT l_suppkey, l_shipdate, l_quantity FROM lineitem WHERE year(l_shipdate) BETWEEN 1994 AND 1996) JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3""")
def grid_store(spark, sf_dir):
    """Monthly parts in metres, one with a further column, merged into a grid in millimetres, stored by year, and years of it read."""
    s = data.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("cell"))
    cells = data.cells(spark, sf_dir)
    df = data.table(spark, sf_dir, "lineitem").join(s, "l_suppkey").join(cells, "cell").select("latitude", "longitude", F.col("l_shipdate").alias("time"), (F.col("l_quantity") / 1000).alias("tp"))
    odd = F.month("time") % 2 == 1
    merged = records.merge_monthly([df.where(odd), df.where(~odd).withColumn("originating_centre", F.lit("x"))])
    path = stage_path(spark, "grid")
    records.write_grid(merged, path)
    grid = records.read_grid(spark, path, 1994, 1996)
    return grid.groupBy("latitude", "longitude", "year").agg(F.count("*").alias("n"), F.round(F.sum("precipitation"), 4).alias("total"))


@query(f"WITH {data.sql_fit()}, {_LINES}, {_TABLE} SELECT loc, CAST(round(a, 3) AS FLOAT) AS a, CAST(round(alpha, 3) AS FLOAT) AS alpha, CAST(round(b, 3) AS FLOAT) AS b, CAST(round(beta, 3) AS FLOAT) AS beta, 'location at one hour' AS about_a FROM tab")
def published_table(spark, sf_dir):
    """The scaling table, described, stored as floats and read back with its descriptions."""
    table = rounded(products.scaling_table(_lines(spark, sf_dir)[1], ["loc"]).select("loc", "a", "alpha", "b", "beta"), 3)
    path = stage_path(spark, "product")
    records.write_product(records.describe(table, {"a": {"comment": "location at one hour"}, "absent": {}}), path)
    stored = spark.read.parquet(path)
    return stored.withColumn("about_a", F.lit(stored.schema["a"].metadata.get("comment")))


_ROUNDS = 5
_FIRST = "SELECT g, regr_slope(y, x) AS a, regr_intercept(y, x) AS c FROM p GROUP BY 1"
_AGAIN = "SELECT p.g, regr_slope(y, x) AS a, regr_intercept(y, x) AS c FROM p JOIN s{0} USING (g) WHERE open AND abs(y - a * x - c) <= 2 * s GROUP BY 1"
_ROUND = """b{1} AS ({2}), r{1} AS (SELECT p.g, a, c, abs(y - a * x - c) AS r FROM p JOIN b{1} USING (g)), m{1} AS (SELECT g, quantile_cont(r, 0.5) / 0.6745 AS s FROM r{1} GROUP BY 1),
l{1} AS (SELECT g, any_value(a) AS a, any_value(c) AS c, any_value(s) AS s, sum(CASE WHEN r / s <= 2 THEN r / s * (r / s) / 2 ELSE 2 END) AS loss FROM r{1} JOIN m{1} USING (g) GROUP BY 1),
s{1} AS (SELECT g, l.a, l.c, l.s, l.loss, l.s > 1e-12 AND {3} AS open FROM l{1} l {4})"""
_ROBUST = "p AS (SELECT l_returnflag AS g, l_quantity AS x, l_extendedprice AS y FROM lineitem), " + ", ".join(
    _ROUND.format(k - 1, k, _AGAIN.format(k - 1) if k else _FIRST, f"abs(l.loss - s{k - 1}.loss) > 1e-8" if k else "true", f"JOIN s{k - 1} USING (g) UNION ALL SELECT * FROM s{k - 1} WHERE NOT open" if k else "") for k in range(_ROUNDS)
)


@query(f"WITH {_ROBUST} SELECT g AS flag, round(a, 4) AS slope, round(c, 4) AS intercept, (SELECT count(*) FROM p WHERE p.g = s.g) AS n FROM s{_ROUNDS - 1} s")
def robust_lines(spark, sf_dir):
    """Price on quantity over all line items of a flag: robust lines of cases that no task holds, five rounds of them."""
    df = data.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_quantity", "l_extendedprice")
    return rounded(robust_lines_at_size(df, ["flag"], "l_quantity", "l_extendedprice", intercept=True, rounds=_ROUNDS), 4)


# The coefficients of the quantile variance from gamma functions, and their cubic approximations.
_COEFFICIENTS = f"""k AS (SELECT {SHAPE}::DOUBLE AS k), g AS (SELECT k, gamma(1 + k) AS g1, gamma(1 + 2 * k) AS g2, 1 - pow(2.0, -k) AS h FROM k),
tail AS (SELECT sum(gamma(2 * k + m) * pow(-0.5, m) / ((k + m) * gamma(m + 1))) AS t FROM k, range(1, 30) r(m)),
v AS (SELECT *, 1 - 1 / h + 1 / (h * g1) AS l0, 2 / h - 2 / (h * g1) AS l1, -k / (h * g1) AS s0, 2 * k / (h * g1) AS s1, (g2 - g1 * g1) / (k * k) AS v00,
  pow(2.0, -2 * k) * (g2 * (1 + 2 * k * k / g2 * t) - g1 * g1) / (k * k) AS v11, (pow(2.0, -2 * k) * g2 + (1 - pow(2.0, 1 - k)) * g1 * g1) / (2 * k * k) AS v01 FROM g, tail),
c AS (SELECT l0 * l0 * v00 + l1 * l1 * v11 + 2 * l0 * l1 * v01 AS c1, 2 * (l0 * s0 * v00 + l1 * s1 * v11 + (l0 * s1 + l1 * s0) * v01) AS c2, s0 * s0 * v00 + s1 * s1 * v11 + 2 * s0 * s1 * v01 AS c3,
  1.1128 - 0.2384 * k + 0.0908 * k * k + 0.1084 * k * k * k AS q1, 0.4580 - 3.0561 * k + 1.1104 * k * k - 0.4071 * k * k * k AS q2, 0.8046 - 2.8890 * k + 8.7874 * k * k - 10.375 * k * k * k AS q3 FROM v)"""


@query(f"""WITH {data.sql_fit()}, {_COEFFICIENTS}, y AS (SELECT loc, duration, T, scale, n_obs, (1 - pow(-ln(1 - 1 / T), shape)) / shape AS y FROM fit, (VALUES (10.0::DOUBLE), (100)) t(T))
SELECT loc, duration, T, round(scale * scale * (c1 + c2 * y + c3 * y * y) / n_obs, 6) AS variance, round(scale * scale * (q1 + q2 * y + q3 * y * y) / n_obs, 6) AS variance_cubic FROM y, c""")
def quantile_variances(spark, sf_dir):
    """Sampling variances of quantiles by the analytic coefficients and by their cubic approximations."""
    df = quantiles.with_return_periods(_fit(spark, sf_dir), [10, 100])
    of = lambda c: gev.quantile_variance(F.col("T"), F.col("scale"), F.col("shape"), F.col("n_obs"), c)
    return rounded(df.select(*BY, "T", of(gev.fill_c(SHAPE)).alias("variance"), of(gev.fill_c_cubic(SHAPE)).alias("variance_cubic")))
