"""Hand-worked values, definitions against fast forms, edge cases and recovery."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from extremes.config import ALL_DURATIONS, label, least_valid, quantile_levels, window_rows
from extremes.functions import gev
from extremes.operators import blockmax, bootstrap, compare, fit, grid, products, quantiles, ranks, report, stations
from extremes.sources import records


@pytest.fixture(scope="module")
def five(spark):
    df = spark.createDataFrame([("a", 24, i, float(x)) for i, x in enumerate((1, 2, 4, 8, 16))], "loc string, duration int, block int, annual_max double")
    return ranks.rank_and_ecdf(df, ["loc", "duration"])


def test_settings():
    assert [least_valid(w) for w in (1, 2, 3, 24, 360)] == [1, 1, 2, 21, 324]
    assert [label(x) for x in quantile_levels((0.9, 0.95, 0.99))] == ["0.005", "0.025", "0.050", "0.500", "0.950", "0.975", "0.995"]
    assert len(ALL_DURATIONS) == 19 and window_rows(6, 0.5) == 12


def test_average_rank(spark):
    df = spark.createDataFrame([(1, x) for x in (1.0, 2.0, 2.0, 3.0, None)], "k int, x double")
    got = df.withColumn("r", ranks.average_rank("x", ["k"])).orderBy(F.col("x").asc_nulls_last()).toPandas()["r"].tolist()
    assert got[:4] == [1, 2.5, 2.5, 4] and math.isnan(got[4])


def test_moments_and_fits(five):
    by = ["loc", "duration"]
    b = fit.moments(five, by).first()
    assert [b.b0, b.b1, b.b2] == pytest.approx([6.2, 5.16, 4.584])
    for shape, want in ((-0.114, (2.4803225913, 5.2881128171, -0.114)), (0.0, (2.7688522011, 5.9443081806, 0)), (None, (1.8043683397, 1.8513262644, -0.6494510770))):
        r = fit.fit_gev(five, by, shape=shape).first()
        assert (r.location, r.scale, r.shape) == pytest.approx(want, rel=1e-9)
    points = fit.gof_points(five, fit.fit_gev(five, by, shape=-0.114), by)
    rows = points.orderBy("block").collect()
    assert [r.cdf for r in rows] == pytest.approx([0.2647167918, 0.3343382109, 0.4706249580, 0.6886745516, 0.8993551311])
    assert [r.pp_cunnane for r in rows] == pytest.approx([0.1153846154, 0.3076923077, 0.5, 0.6923076923, 0.8846153846])
    g = fit.goodness_of_fit(points, by).first()
    assert (g.KS_D, g.filliben_stat) == pytest.approx((0.1293750420, 0.9844295752))


def test_critical_values(spark):
    n = spark.createDataFrame([(40,)], "n_obs int")
    assert [r.filliben_crit for r in fit.critical_values(n, -0.114).orderBy("significance_level").collect()] == pytest.approx([0.9412387522, 0.9563350317])
    for shape in (0.3, -0.25):
        with pytest.raises(ValueError):
            gev.filliben_critical(shape, F.lit(40))


def test_quantile_and_variance(spark):
    one = lambda k: spark.range(1).select(gev.quantile(F.lit(100.0), F.lit(10.0), F.lit(2.0), F.lit(k))).first()[0]
    assert one(-0.114) == pytest.approx(22.0960283881) and one(0.0) == pytest.approx(19.2002984536)
    assert gev.fill_c(-0.114) == pytest.approx((1.1412032624, 0.8215589097, 1.2546346349))
    assert gev.fill_c_cubic(-0.114) == pytest.approx((1.1409970374, 0.8214292950, 1.2635180694))
    assert gev.t_quantile(0.975, 38) == pytest.approx(2.0243941640) and gev.t_quantile(0.05, 1) == pytest.approx(-6.3137515147)


@settings(max_examples=10, deadline=None)
@given(st.floats(-0.3, 0.3), st.floats(2, 1000))
def test_cdf_of_quantile(spark, k, t):
    args = (F.lit(3.0), F.lit(1.5), F.lit(k if abs(k) > 1e-3 else 0.0))
    assert spark.range(1).select(gev.cdf(gev.quantile(F.lit(t), *args), *args)).first()[0] == pytest.approx(1 - 1 / t, abs=1e-8)


def _series(spark):
    rng = np.random.default_rng(1)
    rows = [("a" if i % 2 else "b", 1 + i // 80, i // 2, None if rng.random() < 0.15 else float(rng.integers(0, 9))) for i in range(240)]
    return spark.createDataFrame(rows, "loc string, block int, time int, v double")


def test_rolling_is_the_frame_definition(spark):
    s = _series(spark)
    a, b = (f(s, ["loc"], "time", "v", [1, 3, 24]).orderBy("loc", "time").toPandas() for f in (blockmax.rolling, blockmax.rolling_frames))
    for c in ("m_1", "m_3", "m_24"):
        assert a[c].isna().equals(b[c].isna()) and np.allclose(a[c].fillna(0), b[c].fillna(0))
    plan = blockmax.block_maxima(s, ["loc"], "time", "v", "block", [1, 3, 24], across_blocks=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_blocks_restart_or_run_through(spark):
    s = spark.createDataFrame([("a", 1, 0, 9.0), ("a", 1, 1, 9.0), ("a", 2, 2, 0.0), ("a", 2, 3, None)], "loc string, block int, time int, v double")
    args = (s, ["loc"], "time", "v", "block", [2])
    alone = {r.block: r.annual_max for r in blockmax.block_maxima(*args).collect()}
    through = {r.block: r.annual_max for r in blockmax.block_maxima(*args, across_blocks=True).collect()}
    assert alone == {1: 9.0, 2: 0.0} and through == {1: 9.0, 2: 4.5}
    first = blockmax.positions_of_maxima(*args).where("block = 1").first()
    assert (first.position, first.at) == (0, 0)


def test_bootstrap_routes_agree(spark):
    rng = np.random.default_rng(2)
    rows = [("a", d, i, float(np.round(x, 1))) for d in (1, 6) for i, x in enumerate(rng.gumbel(5 + d, 2, 12))]
    ams = spark.createDataFrame(rows, "loc string, duration int, block int, annual_max double")
    for shape in (-0.114, None):
        sql = bootstrap.fit_samples_sql(ams, ["loc"], 30, 7, shape).where("sample >= 0").toPandas()
        want = sql.groupby("duration")["scale"].quantile(0.025)
        got = bootstrap.fit_with_intervals(ams, ["loc"], 30, (0.95,), 7, shape).where("ev_param = 'scale' AND ci = '0.025'").toPandas().set_index("duration")["gev"]
        assert got.loc[want.index].to_numpy() == pytest.approx(want.to_numpy(), abs=1e-6)


def test_parameters_are_recovered(spark):
    rng = np.random.default_rng(3)
    k, x = -0.1, None
    u = rng.random(20000)
    x = 10 + 2 * (1 - (-np.log(u)) ** k) / k
    df = spark.createDataFrame([("a", float(v)) for v in x], "loc string, annual_max double")
    r = fit.fit_gev(ranks.rank_and_ecdf(df, ["loc"]), ["loc"]).first()
    assert (r.location, r.scale, r.shape) == pytest.approx((10, 2, -0.1), abs=0.06)


def test_scaling_needs_all_durations(spark):
    rows = [("a", d, "scale", 5 * d**-0.6) for d in (1, 3, 24)] + [("b", 1, "scale", 1.0), ("b", 3, "scale", -1.0), ("c", 1, "scale", 2.0), ("c", 3, "scale", 2.0)]
    df = spark.createDataFrame(rows, "loc string, duration int, ev_param string, gev double")
    got = {r.loc: r for r in fit.scaling(df, ["loc"]).collect()}
    assert (got["a"].slope, 10 ** got["a"].intercept, got["a"].rsquared, got["a"].spearman) == pytest.approx((-0.6, 5, 1, -1))
    assert got["b"].slope is None and got["c"].rsquared is None and got["c"].slope == pytest.approx(0)


def test_grid(spark):
    pts = spark.createDataFrame([("p", 5.0, 359.0), ("q", 14.0, 2.0), ("r", None, 1.0)], "name string, latitude double, longitude double")
    cells = spark.createDataFrame([(float(a), float(b)) for a in (0, 10, 30) for b in (0, 10)], "latitude double, longitude double")
    got = {r.name: (r.cell_lat, r.cell_lon) for r in grid.nearest_cells(cells, pts).collect()}
    assert got == {"p": (10.0, 10.0), "q": (10.0, 0.0), "r": (None, None)}
    lon = spark.createDataFrame([(-99.13,), (0.0,), (32.6,)], "x double").select(grid.positive_longitude(F.col("x"))).toPandas().iloc[:, 0]
    assert lon.tolist() == pytest.approx([260.87, 0, 32.6])
    ams = spark.createDataFrame([(0.25 * i, 0.25 * j, 2000, 1.0) for i in range(4) for j in range(4)], "latitude double, longitude double, block int, annual_max double")
    pooled = grid.pool(ams, (0.0, 0.0), 0.25, 1.0, 2000, 1).collect()
    assert {(r.latitude, r.longitude) for r in pooled} == {(0.375, 0.375)} and sorted(r.block for r in pooled) == list(range(16))
    a = spark.createDataFrame([(1, 1.0), (2, None)], "t int, v double")
    b = spark.createDataFrame([(2, 5.0), (3, 6.0), (1, 9.0)], "t int, v double")
    assert {r.t: r.v for r in grid.fill_gaps(a, b, ["t"], "v").collect()} == {1: 1.0, 2: 5.0, 3: 6.0}


def test_stations(spark):
    rows = [("s", y, i, 1.0 if i < n else None) for y, n in ((1, 10), (2, 9), (3, 10)) for i in range(10)] + [("t", 1, 0, 1.0)]
    df = spark.createDataFrame(rows, "station string, year int, i int, v double")
    kept = stations.select_complete(df, "station", "year", "v", 10, 0.7)
    assert {(r.station, r.year, r.n) for r in kept.groupBy("station", "year").agg(F.count("v").alias("n")).collect()} == {("s", 1, 10), ("s", 2, 0), ("s", 3, 10)}
    flags = spark.createDataFrame([(1, 1, 1.0), (None, 1, 1.0), (1, 2, 1.0), (1, 1, 200.0)], "version_num int, ob_hour_count int, prcp_amt double").select(stations.qc0(), stations.qc1()).collect()
    assert [tuple(r) for r in flags] == [(False, False), (True, False), (True, False), (False, True)]


def test_station_files(spark, tmp_path):
    line = lambda t, amt: f"{t},1,RAIN,1,1,X,7,1,{amt},60, , ,a,b, "
    (tmp_path / "obs_1990.txt").write_text(line("1990-01-01 01:00", "0.2") + "\n" + line("1990-01-01 02:00", " ") + "\n")
    (tmp_path / "obs_1991.txt").write_text(line("1990-01-01 01:00", "9") + "\n")
    df = records.read_stations(spark, str(tmp_path))
    first = stations.first_records(df, ["src_id", "end_time"], ["file"])
    assert sorted((r.end_time.hour, r.prcp_amt) for r in first.collect()) == [(1, 0.2), (2, None)]
    assert records.read_stations(spark, str(tmp_path), (1991, 1991)).count() == 1
    (tmp_path / "list.txt").write_text("SRC_ID|SRC_NAME|COUNTY|HIGH_PRCN_LAT|HIGH_PRCN_LON\n7|A|x|1.0|2.0\n7|B|y|3.0|2.0\n8|C|z||\n")
    listed = records.read_station_list(spark, str(tmp_path / "list.txt")).orderBy("station").collect()
    assert [tuple(r) for r in listed] == [(7, "A", 1.0, 2.0), (8, "C", None, None)]
    kept = stations.useful(df)
    assert set(kept.columns) == {*stations.KEEP, "end_time", "file"} and kept.count() == 3
    clash = stations.first_records(df.withColumn("_k", F.lit("own")), ["src_id", "end_time"], ["file"])
    assert {r["_k"] for r in clash.collect()} == {"own"}


def test_grid_store(spark, tmp_path):
    df = spark.sql("SELECT 0.0D AS latitude, 1.0D AS longitude, timestamp'2001-01-01' AS time, 0.002D AS tp, 'x' AS originating_centre UNION ALL SELECT 0.0, 1.0, timestamp'2002-01-01', double('NaN'), 'x'")
    records.write_grid(records.merge_monthly([df]), str(tmp_path / "g"))
    got = records.read_grid(spark, str(tmp_path / "g"), 2001, 2002).orderBy("year").collect()
    assert [r.precipitation for r in got] == [2.0, None] and records.read_grid(spark, str(tmp_path / "g"), 2002, 2002).count() == 1
    named = records.describe(got and df, {"tp": {"units": "m"}, "absent": {}})
    assert named.schema["tp"].metadata == {"units": "m"}


def test_robust_lines():
    x = np.arange(1.0, 21)
    y = 0.8 * x + np.where(np.arange(20) % 2, 0.1, -0.1)
    y[3] = 90
    assert compare.irls(x, y, False)[0] == pytest.approx(0.8, abs=0.01)
    slope, offset = compare.irls(x, y + 5, True)
    assert (slope, offset) == pytest.approx((0.8, 5), abs=0.1)
    assert math.isnan(compare.irls(np.zeros(3), np.ones(3), False)[0])


def test_report_holds_direct_errors(spark):
    df = spark.createDataFrame([("s", 1, float(i), i * 1.1) for i in range(1, 12)], "source string, duration int, ref double, est double")
    r = compare.report(df, ["source", "duration"]).first()
    assert (r.mae, r.mape, r.arf) == pytest.approx((0.6, 0.1, 1.1))


def test_intervals_and_paired_tests(spark):
    p = spark.createDataFrame([(10.0, 2.0, -0.114)], "location double, scale double, shape double")
    rows = {r.ci: r.intensity for r in quantiles.intensities(p, 40, [100], ("estimate", "0.025", "0.500")).collect()}
    y = (1 - (-math.log(1 - 0.01)) ** -0.114) / -0.114
    half = math.sqrt(4 * (1.1412 + 0.8216 * y + 1.2546 * y * y) / 40 / 40)
    assert rows["0.500"] == rows["estimate"] and rows["estimate"] - rows["0.025"] == pytest.approx(2.0243941640 * half)
    df = spark.createDataFrame([(1.0, 0.0), (2.0, 0.0), (0.0, 0.0), (0.0, 1.0), (None, 1.0)], "x double, y double")
    r = report.paired_tests(df, "x", "y").first()
    assert (r["n"], r["w_plus"], r["w_minus"]) == (4, 2.5 + 4, 2.5)
    # Published table values: 2.776 and 4.604 are the 5 % and 1 % points with 4 degrees, 12.706 the 5 % point with 1
    assert [gev.t_tail(t, n) for t, n in ((2.776445, 4), (4.604095, 4), (12.706205, 1), (0.0, 3))] == pytest.approx([0.05, 0.01, 0.05, 1.0], abs=1e-6)
    five = spark.createDataFrame([(float(x), 0.0) for x in (1, 2, 3, 4, 5)], "x double, y double")
    r = report.paired_tests(five, "x", "y").first()
    assert r["t"] == pytest.approx(3 / (2.5**0.5 / 5**0.5)) and r["t_p"] == pytest.approx(gev.t_tail(r["t"], 4)) and 0.01 < r["t_p"] < 0.05
    assert r["z"] == pytest.approx(7.5 / 13.75**0.5) and r["w_p"] == 2 / 32  # all ranks on one side: two of 32 ways
    none = report.paired_tests(five.where("false"), "x", "y").first()
    assert none["n"] == 0 and none["t"] is None


def test_report_from_coordinates(spark):
    """Gauges at odd places against cells, by hand: nearest per axis, negative longitudes turned, six periods."""
    rng = np.random.default_rng(5)
    cells = [(float(a), float(b), 24, 10.0 + a + b / 100, 2.0, -0.114) for a in (0, 10) for b in (0, 350)]
    gauges = [(i, 4.0 if i % 2 else 6.0, -12.0 if i % 3 else 3.0, 24, 12.0 + i / 10, 2.0 + rng.random(), -0.114) for i in range(20)] + [(99, None, 1.0, 24, 1.0, 1.0, -0.114)]
    kinds = "duration int, location double, scale double, shape double"
    g = spark.createDataFrame(gauges, "station int, latitude double, longitude double, " + kinds)
    c = spark.createDataFrame(cells, "latitude double, longitude double, " + kinds)
    q = lambda loc, scale, t: loc + scale * (1 - (-math.log(1 - 1 / t)) ** -0.114) / -0.114
    for r in compare.station_report(g, {"grid": c}).collect():
        ref = np.array([q(x[4], x[5], r["T"]) for x in gauges[:-1]])
        est = np.array([q(10.0 + (0 if x[1] < 5 else 10) + (350 if x[2] < 0 else 0) / 100, 2.0, r["T"]) for x in gauges[:-1]])
        assert (r.mae, r.mape, r.mdpe) == pytest.approx((abs(est - ref).mean(), abs((est - ref) / ref).mean(), np.median((est - ref) / ref)))
        assert r.arf == pytest.approx(compare.irls(ref, est, False)[0]) and (r.slope, r.intercept) == pytest.approx(compare.irls(ref, est, True))
    assert compare.station_report(g, {"grid": c}).count() == 6


def test_stages_are_stored_and_read(spark, tmp_path):
    """Maxima by block, read for some blocks, fitted, published as floats with descriptions."""
    rows = [("a", 24, 1990 + i, float(x)) for i, x in enumerate((1, 2, 4, 8, 16, 3))] + [("a", 24, 2000, None)]
    ams = spark.createDataFrame(rows, "loc string, duration int, block int, annual_max double")
    stored = records.write_stage(ams, str(tmp_path / "ams"), ["block"])
    assert stored.count() == 7 and records.write_stage(ams.where("block < 1995"), str(tmp_path / "again")).count() == 5
    some = records.read_maxima(spark, str(tmp_path / "ams"), 1990, 1994)
    assert "PartitionFilters: [isnotnull(block" in some._jdf.queryExecution().executedPlan().toString()
    fits = fit.fit_gev(ranks.rank_and_ecdf(some, ["loc", "duration"]), ["loc", "duration"], shape=-0.114)
    records.write_product(records.describe(fits, {"scale": {"units": "mm/h"}}), str(tmp_path / "product"))
    out = spark.read.parquet(str(tmp_path / "product"))
    assert dict(out.dtypes)["scale"] == "float" and out.first().scale == pytest.approx(5.2881128171) and out.schema["scale"].metadata == {"units": "mm/h"}


def test_regular_axis(spark):
    s = spark.createDataFrame([("a", 1, 1.0), ("b", 3, 2.0), ("b", 4, None)], "loc string, t int, v double").withColumn("time", F.make_timestamp(F.lit(2000), F.lit(1), F.lit(1), "t", F.lit(0), F.lit(0.0))).drop("t")
    for axis, hours in (("union", [1, 3, 4]), ("regular", [1, 2, 3, 4])):
        got = blockmax.regular_axis(s, ["loc"], "time", axis)
        assert sorted((r.loc, r.time.hour) for r in got.collect()) == [(k, h) for k in "ab" for h in hours]
        assert {(r.loc, r.time.hour): r.v for r in got.where("v IS NOT NULL").collect()} == {("a", 1): 1.0, ("b", 3): 2.0}
    assert blockmax.regular_axis(s.where("false"), ["loc"], "time").count() == 0
    named = s.withColumnsRenamed({"loc": "_s", "v": "_n"})
    assert set(blockmax.rolling(named, ["_s"], "time", "_n", [1]).columns) == {"_s", "_n", "time", "m_1"}


def test_snapped_is_the_nearest_cell(spark):
    cells = spark.createDataFrame([(50.0 - 10 * i, 10.0 * j) for i in range(4) for j in range(5)], "latitude double, longitude double")
    pts = spark.createDataFrame([(f"p{i}", 60.0 - 1.25 * i, 1.25 * i - 5) for i in range(50)], "name string, latitude double, longitude double")
    by_search = {tuple(r) for r in grid.nearest_cells(cells, pts).collect()}
    assert {tuple(r) for r in grid.snapped(pts, (50.0, -10.0, 4), (0.0, 10.0, 5)).collect()} == by_search


def test_limits_follow_the_least_record(spark):
    p = spark.createDataFrame([(1, 30, 10.0, 2.0, -0.114), (2, 12, 10.0, 2.0, -0.114)], "k int, n_obs int, location double, scale double, shape double")
    one = quantiles.intensities(p, None, [100], ("0.975",)).first().intensity
    assert one == quantiles.intensities(p, 12, [100], ("0.975",)).first().intensity > quantiles.intensities(p, 30, [100], ("0.975",)).first().intensity
    assert quantiles.intensities(p.withColumn("n_obs", F.lit(2)), None, [100], ("0.975",)).first().intensity is None


def test_products(spark):
    rows = [("a", ci, p, 1.0 + i, 2.0 + i) for i, ci in enumerate(("estimate", "0.025")) for p in ("location", "scale")]
    lines = spark.createDataFrame(rows, "loc string, ci string, ev_param string, intercept double, slope double").withColumn("rsquared", F.lit(1.0))
    table = products.scaling_table(lines.where("ci = 'estimate'"), ["loc"]).first()
    assert (table.a, table.alpha) == (10.0, 2.0)
    limit = products.scaling_table_ci(lines, ["loc"]).first()
    assert (limit.ci, limit.a_ci, limit.beta_ci) == (0.025, 2.0, 3.0)
    assert products.scaling_table_ci(lines, ["loc"], linear=True).first().a_ci == 100.0


def test_interval_queries_use_the_settings(spark):
    from extremes.config import SUBDAILY, FitConfig
    from extremes.plans import data, queries

    sf, conf = "/root/testdata/sf0.01", FitConfig()
    levels = quantile_levels(conf.widths)
    got = queries.product_intervals(spark, sf).toPandas()
    assert set(got.ci) == set(levels) and set(got.duration) == set(SUBDAILY)
    assert set(queries.bootstrap_scaling(spark, sf).toPandas().ci) == {"estimate", *map(label, levels)} == set(queries.sizing_values(spark, sf).toPandas().ci)
    assert set(queries.site_table(spark, sf).toPandas().duration) == set(SUBDAILY)
    one = data.maxima(spark, sf, (2,)).where("loc = 'click'")
    drawn = bootstrap.fit_samples_sql(one, ["loc"], conf.n_sample, conf.seed, conf.shape).where("sample >= 0").toPandas()
    assert len(drawn) == 1000
    want = drawn["location"].quantile(levels)
    own = got[(got["loc"] == "click") & (got.duration == 2)].set_index("ci")["location_ci"]
    assert own.loc[levels].to_numpy() == pytest.approx(want.to_numpy(), abs=1e-6)


def test_entry_imports_without_training_operators(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
