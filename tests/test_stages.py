"""Rolling sums that recover, series in parts, stored and updated tables, selection, search by halving, readers."""

import glob
import itertools
import math
import os
import re
from types import SimpleNamespace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from extremes.config import ALL_DURATIONS
from extremes.operators import blockmax, bootstrap, compare, grid, ranks, report, robust, selection
from extremes.operators.robust import robust_lines_at_size
from extremes.operators.selection import exact_quantiles
from extremes.plans import data, queries
from extremes.sources import records, stages

INF, NAN = float("inf"), float("nan")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def same(a, b):
    return (a is None) == (b is None) and (a is None or (math.isnan(a) and math.isnan(b)) or a == pytest.approx(b, rel=1e-12))


def series_of(spark, values, key="a"):
    return spark.createDataFrame([(key, i, v, i // 24, i) for i, v in enumerate(values)], "loc string, t long, v double, block long, pos long")


ODD = st.lists(st.one_of(st.none(), st.sampled_from([1.0, 0.5, 1e20, -1e20, INF, -INF, NAN, 3.0])), min_size=1, max_size=90)


@settings(max_examples=12, deadline=None)
@given(ODD)
def test_rolling_sums_recover(spark, values):
    """Fill values, NaN, infinities and gaps count where they are and nowhere else; as the definition by frames."""
    df, sizes = series_of(spark, values), [1, 2, 3, 7, 12, 24, 40]
    fast = {r.t: r for r in blockmax.rolling(df, ["loc"], "t", "v", sizes).collect()}
    for r in blockmax.rolling_frames(df, ["loc"], "t", "v", sizes).collect():
        for w in sizes:
            assert same(r[f"m_{w}"], fast[r.t][f"m_{w}"]), (r.t, w)


def test_a_fill_value_is_gone_after_its_windows(spark):
    got = [r.m_3 for r in blockmax.rolling(series_of(spark, [1.0, 1e20, 1.0, 1.0, 1.0, NAN, 1.0, 1.0, 1.0]), ["loc"], "t", "v", [3]).orderBy("t").collect()]
    assert got[4] == 1.0 and got[8] == 1.0 and got[3] > 1e19 and math.isnan(got[7])


@pytest.mark.parametrize("part_rows", [None, 40, 41, 100, 7])
def test_parts_of_a_series_give_its_maxima(spark, part_rows):
    """Windows reach over the ends of parts as over those of blocks; parts are tasks of their own."""
    rng = np.random.default_rng(4)
    values = [None if x < 0.1 else float(x) for x in rng.random(500)]
    df = series_of(spark, values).unionByName(series_of(spark, values[::-1], "b"))
    want = blockmax.block_maxima(df, ["loc"], "t", "v", "block", [1, 3, 40], across_blocks=True)
    got = blockmax.block_maxima(df, ["loc"], "t", "v", "block", [1, 3, 40], across_blocks=True, position="pos", part_rows=part_rows)
    rows = lambda x: sorted((r.loc, r.duration, r.block, None if r.annual_max is None else round(r.annual_max, 10)) for r in x.collect())
    assert rows(got) == rows(want)
    assert re.search(r"hashpartitioning\(loc#\d+, _part#", plan(got))


def test_one_shuffle_and_one_sort_for_all_windows(spark):
    text = plan(blockmax.rolling(series_of(spark, [1.0]), ["loc"], "t", "v", ALL_DURATIONS))
    assert text.count("Exchange hashpartitioning") == 1 and text.count("Sort [") == 1


def test_bucketed_records_need_no_shuffle(spark, tmp_path):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(f"s{i % 9}", i // 9, i // 90, float(rng.random())) for i in range(900)], "loc string, t long, block long, v double")
    name = f"record_{os.getpid()}"
    stored = stages.write_bucketed(df, name, ["loc"], "t", 4, str(tmp_path / "r"))
    maxima = lambda x: blockmax.block_maxima(x, ["loc"], "t", "v", "block", [1, 3], across_blocks=True)
    text = plan(maxima(stored))
    assert "Exchange" not in text and "Bucketed: true" in text
    rows = lambda x: sorted(map(tuple, x.collect()))
    assert rows(maxima(stored)) == rows(maxima(df))
    spark.sql(f"DROP TABLE {name}")
    again = stages.attach_bucketed(spark, name + "_b", str(tmp_path / "r"), ["loc"], "t", 4)
    assert "Exchange" not in plan(maxima(again)) and rows(maxima(again)) == rows(maxima(df))
    spark.sql(f"DROP TABLE {name}_b")


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/block=*/*.parquet")}


@pytest.mark.parametrize("across", [False, True])
def test_one_more_block_is_computed_alone(spark, tmp_path, across):
    rng = np.random.default_rng(6)
    df = series_of(spark, [float(x) for x in rng.random(240)]).withColumnRenamed("block", "year")
    source, target, whole = (str(tmp_path / x) for x in ("source", "target", "whole"))
    args = (["loc"], "t", "v", "year", [1, 5, 24])
    df.where("year < 9").write.partitionBy("year").parquet(source)
    assert stages.update_maxima(spark, source, target, *args, across_blocks=across) == list(range(9))
    before = files(target)
    df.where("year = 9").write.mode("append").partitionBy("year").parquet(source)
    assert stages.update_maxima(spark, source, target, *args, across_blocks=across) == [9]
    after = files(target)
    assert before.items() < after.items() and all("block=9" in f for f in set(after) - set(before))
    assert stages.update_maxima(spark, source, target, *args, across_blocks=across) == []
    stages.update_maxima(spark, source, whole, *args, across_blocks=across)
    rows = lambda p: sorted(map(tuple, spark.read.parquet(p).select("loc", "duration", "block", "annual_max").collect()))
    assert rows(target) == rows(whole) and len(rows(whole)) == 30
    assert stages.update_maxima(spark, source, target, *args, across_blocks=across, again=[3]) == [3]
    assert rows(target) == rows(whole)


def test_updates_read_and_write_their_blocks_alone(spark, tmp_path):
    path = str(tmp_path / "main")
    main = spark.createDataFrame([(y, t, None if t % 3 == 0 else float(t), "kept") for y in range(5) for t in range(10)], "block int, t int, v double, note string")
    main.write.partitionBy("block").parquet(path)
    before = files(path)
    update = spark.createDataFrame([(2, 0, 50.0), (2, 1, 51.0), (2, 3, None), (2, 99, 59.0), (4, 9, 60.0), (4, 9, 60.0)], "block int, t int, v double")
    want = sorted((tuple(r) for r in grid.fill_gaps(main, update.dropDuplicates(), ["block", "t"], "v").collect()), key=str)
    assert stages.update_record(spark, path, update, ["t"], "v", "block") == {"rows": 21, "gaps": 3 + 3, "filled": 3}
    after = files(path)
    assert {f for f in before if f in after} == {f for f in before if "block=2" not in f and "block=4" not in f}
    got = spark.read.parquet(path)
    assert sorted((tuple(r) for r in got.select("block", "t", "v").collect()), key=str) == want
    assert {r.note for r in got.where("t < 99").collect()} == {"kept"} and got.where("t = 99").first().note is None
    assert stages.update_record(spark, path, update.where("false"), ["t"], "v", "block") == {"rows": 0, "gaps": 0, "filled": 0}


@pytest.mark.parametrize("parts, few", [(64, 50_000), (4, 5), (2, 1), (16, 20)])
def test_selection_is_percentile(spark, parts, few):
    """Ties, nulls, NaN, infinities, one value, no value, null groups; in one round and in many."""
    rng = np.random.default_rng(parts)
    rows = [("a", float(x)) for x in rng.normal(size=400)] + [("ties", float(x)) for x in rng.integers(0, 6, 300)] + [("wide", float(10.0**x)) for x in rng.uniform(-300, 300, 200)]
    rows += [("one", 2.0), ("none", None), (None, 1.0), (None, 4.0), ("odd", NAN), ("odd", INF), ("odd", -INF), ("odd", 0.0), ("a", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    levels = [0.0, 0.01, 0.25, 0.5, 0.975, 1.0]
    want = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("x", F.array(*map(F.lit, levels))).alias("q")).collect()}
    got = {r.g: r["values"] for r in exact_quantiles(df, ["g"], "x", levels, parts, few).collect()}
    assert set(got) == set(want)
    for g, q in want.items():
        assert (q is None and got[g] is None) or all(same(x, y) for x, y in zip(got[g], q, strict=True)), (g, got[g], q)
    every = df.where("g <> 'odd'")
    assert exact_quantiles(every, [], "x", levels, parts, few).first()["values"] == pytest.approx(every.agg(F.percentile("x", F.array(*map(F.lit, levels)))).first()[0])


@pytest.mark.parametrize("near", [None, 0.0, -0.05])
def test_selection_counts_large_groups_near_their_places(spark, monkeypatch, near):
    """Few of a large group's values are counted; ranges that miss their places (``near``) give way to the whole group."""
    df = spark.range(40_000).select((F.col("id") % 2).alias("g"), F.rand(3).alias("x")).unionByName(spark.range(90).select(F.lit(7).cast("long").alias("g"), F.rand(4).alias("x")))
    tables, stage = [], selection.stage
    monkeypatch.setattr(selection, "stage", lambda t, name: tables.append((name, out := stage(t, name))) or out)
    if near is not None:
        monkeypatch.setattr(selection, "NEAR", near)
    levels = [0.0, 0.3, 0.3001, 0.5, 1.0]
    want = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("x", F.array(*map(F.lit, levels))).alias("q")).collect()}
    assert {r.g: r["values"] for r in exact_quantiles(df, ["g"], "x", levels, few=1000).collect()} == {g: pytest.approx(q, abs=1e-15) for g, q in want.items()}
    counted = sum(t.count() for name, t in tables if name == "value-counts")
    assert counted < 1000 if near is None else counted > 20_000


def test_selection_of_nothing(spark):
    df = spark.createDataFrame([], "g string, x double")
    assert exact_quantiles(df, ["g"], "x", [0.5]).count() == 0


def test_no_plan_of_the_quantiles_gathers_all_values(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("g"), F.rand(1).alias("x"))
    text = plan(exact_quantiles(df, ["g"], "x", [0.5])) + plan(report.quantile_table(df, ["g"], "x", [0.1, 0.9]))
    assert " percentile(" not in text and "_percentile(" not in text and "SinglePartition" not in text


def test_rank_correlation_deals_a_group_over_ranges(spark, monkeypatch):
    """Ties, a frequent value, nulls, NaN, null groups, no variance; no range holds a large part of the values."""
    rng = np.random.default_rng(10)
    x, y = rng.integers(0, 90, 900), rng.normal(size=900)
    rows = [("a", float(i), float(i + 40 * j)) for i, j in zip(x, y)] + [("b", float(j), 0.0 if i < 60 else float(j * i)) for i, j in zip(x, y)]
    rows += [(None, 1.0, 5.0), (None, 2.0, 5.0), (None, 2.0, -1.0), ("flat", 3.0, 1.0), ("flat", 3.0, 2.0), ("one", 1.0, 1.0), ("none", None, 1.0), ("a", None, 7.0), ("b", 7.0, None), ("odd", NAN, 2.0), ("odd", INF, 1.0), ("odd", -0.0, 1.0), ("odd", 0.0, 3.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    tables, stage = [], ranks.stage
    monkeypatch.setattr(ranks, "PART_ROWS", 100)
    monkeypatch.setattr(ranks, "stage", lambda t, name: tables.append((name, out := stage(t, name))) or out)
    got = {r.g: r.rho for r in ranks.spearman(df, ["g"], "x", "y").collect()}
    both = df.where("x IS NOT NULL AND y IS NOT NULL").withColumn("rx", ranks.average_rank("x", ["g"])).withColumn("ry", ranks.average_rank("y", ["g"]))
    want = {r.g: r.rho for r in both.groupBy("g").agg(ranks.pearson(F.col("rx"), F.col("ry")).alias("rho")).collect()}
    assert set(got) == set(want) == {"a", "b", None, "flat", "one", "odd"} and got["flat"] is None and got["one"] is None
    assert all(got[g] == pytest.approx(r, abs=1e-12) for g, r in want.items() if r is not None)
    assert ranks.spearman(df.where("g = 'a'"), [], "x", "y").first().rho == pytest.approx(want["a"], abs=1e-12)
    assert ranks.spearman(df.where("false"), ["g"], "x", "y").count() == 0
    ranges = next(t for name, t in reversed(tables) if name == "ranges" and t.count() > 500)
    assert ranges.groupBy("_part").count().agg(F.max("count")).first()[0] < 400


def test_search_by_halving_is_the_search_of_all(spark):
    rng = np.random.default_rng(8)
    for n in (1, 2, 3, 7, 8, 9, 64, 100):
        lats, lons = (np.unique(rng.choice(np.arange(-300, 300), n)) / 4 for _ in range(2))
        cells = spark.createDataFrame([(float(a), float(b)) for a, b in itertools.zip_longest(lats, lons, fillvalue=float(lats[0]))], "latitude double, longitude double")
        lons = sorted({r.longitude for r in cells.collect()})
        points = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.choice(np.arange(-800, 800), (60, 2)) / 8)]
        df = spark.createDataFrame([*points, (-1, None, 2.0)], "name int, latitude double, longitude double").withColumn("_lats", F.lit(1))
        got = {r.name: r for r in grid.nearest_cells(cells, df).collect()}
        near = lambda axis, x: min(axis, key=lambda a: (abs(a - x), -a))
        assert all((got[i].cell_lat, got[i].cell_lon) == (near(lats, x), near(lons, y)) for i, x, y in points)
        assert got[-1].cell_lat is None and got[-1]._lats == 1
    none = grid.nearest_cells(cells.where("false"), df)
    assert none.count() == 61 and none.where("cell_lat IS NOT NULL").count() == 0


@pytest.mark.parametrize("intercept", [False, True])
def test_robust_lines_at_size_are_those_of_one_task(spark, intercept):
    """Cases with outliers, of one point, without variance, without points, on a line exactly."""
    rng = np.random.default_rng(9)
    rows = [(g, float(x), float(2 * x + 1 + rng.normal() + (40 if rng.random() < 0.2 else 0))) for g in "ab" for x in rng.random(60) * 9]
    rows += [("one", 1.0, 2.0), ("flat", 3.0, 1.0), ("flat", 3.0, 2.0), ("flat", 3.0, 9.0), ("null", None, 1.0), (None, 1.0, 1.0), (None, 2.0, 3.0), (None, 3.0, 2.0), *[("exact", float(x), 2.0 * x) for x in range(1, 6)]]
    df = spark.createDataFrame(rows, "g string, ref double, est double")
    got = {r.g: r for r in robust_lines_at_size(df, ["g"], intercept=intercept).collect()}
    want = {r.g: r for r in compare.robust_lines(df, ["g"], intercept=intercept).collect()}
    assert set(got) == set(want)
    for g, r in want.items():
        assert got[g].n == r.n and same(got[g].slope, r.slope) or got[g].slope == pytest.approx(r.slope, rel=1e-9), g
        assert r.slope is None or got[g].intercept == pytest.approx(r.intercept, abs=1e-9), g


def test_robust_lines_at_size_shuffle_few_points(spark, monkeypatch):
    """A round counts only residuals near the median, and the loss meets scales of known size: no points are shuffled to it."""
    df = spark.range(120_000).select(F.lit("a").alias("g"), (F.rand(5) * 9).alias("ref"), F.randn(6).alias("est"))
    counted, lines, keep = [], [], selection.stage
    monkeypatch.setattr(selection, "stage", lambda t, name: (out := keep(t, name), counted.append(out) if name == "value-counts" else None)[0])
    monkeypatch.setattr(robust, "stage", lambda t, name: (lines.append(plan(t)) if name == "lines" else None, keep(t, name))[1])
    got, want = (f(df, ["g"], intercept=True).first() for f in (lambda *a, **k: robust_lines_at_size(*a, rounds=2, **k), compare.robust_lines))
    assert got.n == want.n == 120_000 and len(counted) == 2 and all(t.count() < 1000 for t in counted)
    assert got.slope == pytest.approx(want.slope, abs=0.02)
    assert len(lines) == 3 and all(re.search(r"(?s)BroadcastHashJoin.*points-", text) for text in lines[1:])


def test_draws_are_made_once_and_within_their_bound(spark):
    lengths = {3: 5, 40: 9, 1: 1, 7: 1}
    got = bootstrap.shared_draws(spark, lengths, 90, 2)
    assert set(got) == set(lengths) and all((got[n] == bootstrap.draws_of(2, n, 90)).all() for n in lengths)
    some = bootstrap.shared_draws(spark, lengths, 90, 2, 4 * 90 * 44)
    assert set(some) == {40, 3, 1} and bootstrap.shared_draws(spark, {}, 90, 2) == {}
    draws = bootstrap.Draws(SimpleNamespace(value=some), 2, 90, 4 * 90 * 20)
    assert (draws(7) == got[7]).all() and (draws(40) == got[40]).all() and set(draws.own) == {7}
    assert (draws(13) == bootstrap.draws_of(2, 13, 90)).all() and set(draws.own) == {7, 13}
    assert draws(7) is draws.own[7] and draws(8).shape == (90, 8) and set(draws.own) == {7, 8}  # the one last used stays


@pytest.mark.parametrize("name, reads", [("block_maxima", 1), ("goodness_of_fit", 1), ("source_errors", 1), ("bootstrap_intervals", 1)])
def test_queries_read_their_table_once(spark, monkeypatch, name, reads):
    """The table goes into a stage, which the rest of the query reads."""
    asked, table = [], data.table
    monkeypatch.setattr(data, "table", lambda spark, sf, name: asked.append(name) or table(spark, sf, name))
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert asked.count("events") == reads and "events.parquet" not in plan(df)


def test_the_report_reads_its_tables_a_few_times(spark, monkeypatch):
    asked, table = [], data.table
    monkeypatch.setattr(data, "table", lambda spark, sf, name: asked.append(name) or table(spark, sf, name))
    df = queries.QUERIES["comparison_report"](spark, "/root/testdata/sf0.001")
    assert asked.count("lineitem") == 2 and "lineitem.parquet" not in plan(df)


@pytest.mark.parametrize("n", range(1, 11))
def test_signed_ranks_are_enumerated(n):
    sums = [sum(r for r, s in zip(range(1, n + 1), signs) if s) for signs in itertools.product((0, 1), repeat=n)]
    top = n * (n + 1) // 2
    for w in range(top // 2 + 1):
        assert report.signed_rank_tail(n, w) == pytest.approx(min(1.0, 2 * sum(s <= w for s in sums) / 2**n))


def test_paired_tests_take_the_exact_tail(spark):
    df = spark.createDataFrame([(float(x), 0.0) for x in (1, 2, 3, 4, -5)], "x double, y double")
    assert report.paired_tests(df, "x", "y").first().w_p == pytest.approx(report.signed_rank_tail(5, 5)) == pytest.approx(26 / 32 - 0.0, abs=0.2)
    tied = spark.createDataFrame([(float(x), 0.0) for x in (1, 1, 3, 4, -5)], "x double, y double")
    r = report.paired_tests(tied, "x", "y").first()
    assert r.w_p == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)))


def test_malformed_station_lines_are_counted(spark, tmp_path):
    good = "2001-01-01 0{},7,RAIN,1,1,X,9,5,{},60,,,a,b,c"
    lines = [good.format("0:00", "0.5"), good.format("1:00", "NaN"), good.format("2:00", " "), "2001-01-01 03:00,7,RAIN,1,1", good.format("4:00", "much"), good.format("5:00", "2.5") + ",more"]
    (tmp_path / "midas_rainhrly_200101-200112.txt").write_text("\n".join(lines) + "\n")
    rows = sorted(records.read_stations(spark, str(tmp_path), (2001, 2001)).collect(), key=lambda r: r.end_time)
    assert [r.prcp_amt for r in rows] == [0.5, None, None] and rows[0].src_id == 9 and rows[0].file.startswith("midas")
    bad = records.malformed_lines(spark, str(tmp_path)).collect()
    assert {r.malformed for r in bad} == {lines[3], lines[4], lines[5]} and records.malformed_lines(spark, str(tmp_path), (2002, 2003)).count() == 0


def test_monthly_records_turn_nan_into_null(spark):
    df = spark.createDataFrame([(0.001, 1), (NAN, 2)], "tp double, k int").withColumn("time", F.lit("2001-02-03").cast("timestamp"))
    assert [r.precipitation for r in records.merge_monthly([df]).orderBy("k").collect()] == [pytest.approx(1.0), None]
