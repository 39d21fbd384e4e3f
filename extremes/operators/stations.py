"""Station records: first records, metadata, quality flags, selection of stations and years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blockmax import free_name, rolling

HOURLY_LIMIT, DAILY_LIMIT, MARGIN = 92.0, 279.0, 1.2
KEEP = ("id", "ob_hour_count", "prcp_amt", "prcp_dur", "rec_st_ind", "src_id", "version_num")


def useful(df: DataFrame) -> DataFrame:
    """The columns of raw station records that later steps use, and the name of the row's file where there is one."""
    return df.select(*[c for c in df.columns if c in KEEP or c in ("end_time", "file")])


def first_records(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key, by ``order``."""
    k = free_name(df, "_k")
    return df.withColumn(k, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(k) == 1).drop(k)


def with_metadata(obs: DataFrame, stations: DataFrame, key: str = "station") -> DataFrame:
    """Name and coordinates by station; an unknown station has the name '' and no coordinates.    """
    return obs.join(stations, key, "left").withColumn("name", F.coalesce("name", F.lit("")))


def located(df: DataFrame) -> DataFrame:
    return df.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & ~F.isnan("latitude") & ~F.isnan("longitude"))


def in_period(df: DataFrame, time: str, first: str, last: str) -> DataFrame:
    """Times within inclusive partial dates: '1980-12' holds the whole month, '1980' the year."""
    def start(x: str) -> Column:
        return F.to_timestamp(F.lit(x + "-01-01"[3 * (x.count("-")):]))

    unit = {0: "1 YEAR", 1: "1 MONTH", 2: "1 DAY"}[last.count("-")]
    return df.where((F.col(time) >= start(first)) & (F.col(time) < start(last) + F.expr(f"INTERVAL {unit}")))


def qc0() -> Column:
    """Not an hourly value of the first version; missing marks count as flagged."""
    return F.coalesce(F.col("version_num") != 1, F.lit(True)) | F.coalesce(F.col("ob_hour_count") != 1, F.lit(True))


def qc1(value: str = "prcp_amt", hourly_limit: float = HOURLY_LIMIT) -> Column:
    return F.coalesce(F.col(value) >= hourly_limit * MARGIN, F.lit(False))


def with_quality(df: DataFrame, keys: list[str], time: str, value: str = "prcp_amt", daily_limit: float = DAILY_LIMIT, hourly_limit: float = HOURLY_LIMIT) -> DataFrame:
    """``df`` with flags qc0, qc1, qc3 (24-row sum, on unmasked values) and the value masked to null where one is set; rows stay."""
    day = free_name(df, "_day")
    summed = rolling(df, keys, time, value, [24], how="sum", least=21).withColumnRenamed("m_24", day)
    flags = summed.withColumns({"qc0": qc0(), "qc1": qc1(value, hourly_limit), "qc3": F.coalesce(F.col(day) >= daily_limit * MARGIN, F.lit(False))})
    return flags.withColumn(value, F.when(~F.col("qc0") & ~F.col("qc1") & ~F.col("qc3"), F.col(value))).drop(day)


def qc4(df: DataFrame, keys: list[str], time: str, value: str = "prcp_amt") -> DataFrame:
    """Rows at 09:00 with ``qc4``: at least twice the station's mean 24 h sum of that calendar month."""
    month, normal = free_name(df, "_month"), free_name(df, "_mean")
    summed = rolling(df, keys, time, value, [24], how="sum", least=21).withColumn(month, F.month(time))
    mean = summed.groupBy(*keys, month).agg(F.avg("m_24").alias(normal))
    nine = summed.where((F.hour(time) == 9) & (F.minute(time) == 0)).join(mean, [*keys, month], "left")
    return nine.withColumn("qc4", F.coalesce(F.col(value) >= 2 * F.col(normal), F.lit(False))).drop("m_24", month, normal)


def select_complete(df: DataFrame, station: str, year: str, value: str, least: int = int(365 * 24 * 0.9), share: float = 0.9) -> DataFrame:
    """Stations with enough full years; the values of their other years are masked, rows stay.

    A year is full with ``least`` values; a station needs ``int(share * years of the selection)`` full years.
    """
    counts = df.groupBy(station, year).agg((F.count(value) >= least).alias("full_year"))
    years = counts.select(year).distinct().agg(F.count("*").alias("n_years"))
    kept = counts.groupBy(station).agg(F.count_if(F.col("full_year")).alias("n_full")).crossJoin(F.broadcast(years)).where(F.col("n_full") >= F.floor(F.col("n_years") * share)).select(station)
    flags = counts.join(kept, station, "left_semi")
    return df.join(flags, [station, year]).withColumn(value, F.when(F.col("full_year"), F.col(value))).drop("full_year")


def drop_stations(df: DataFrame, names: list, key: str = "station") -> DataFrame:
    return df.where(~F.col(key).isin(*names)) if names else df


def station_points(stations: DataFrame) -> DataFrame:
    """Named stations with coordinates, as WKT points."""
    kept = located(stations).where(F.col("name").isNotNull() & (F.col("name") != ""))
    return kept.withColumn("geometry", F.format_string("POINT (%s %s)", F.col("longitude").cast("string"), F.col("latitude").cast("string")))
