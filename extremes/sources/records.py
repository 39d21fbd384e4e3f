"""Readers and writers of grids, station files and stage tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.gev import no_nan

STATION_SCHEMA = (
    "end_time timestamp, id bigint, id_type string, ob_hour_count int, version_num int, met_domain_name string, src_id bigint, rec_st_ind int, "
    "prcp_amt double, prcp_dur double, prcp_amt_q string, prcp_dur_q string, meto_stmp_time string, midas_stmp_etime string, prcp_amt_j string"
)


def nan_to_null(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.withColumns({c: no_nan(F.col(c)) for c in columns})


def read_grid(spark: SparkSession, path: str, start: int, end: int, value: str = "precipitation") -> DataFrame:
    """Hourly grid of the years from start to end; the year partitions are pruned."""
    df = spark.read.parquet(path).where(F.col("year").between(start, end))
    return nan_to_null(df.withColumn(value, F.col(value).cast("double")), [value])


def merge_monthly(parts: list[DataFrame], value: str = "tp", out: str = "precipitation") -> DataFrame:
    """Monthly records in metres as one record in millimetres, with its year; NaN becomes null."""
    df = parts[0].drop("originating_centre")
    for p in parts[1:]:
        df = df.unionByName(p.drop("originating_centre"), allowMissingColumns=True)
    return df.withColumn(out, no_nan(F.col(value).cast("double")) * 1000).drop(value).withColumn("year", F.year("time"))


def write_grid(df: DataFrame, path: str, keys: tuple[str, ...] = ("latitude", "longitude")) -> None:
    """By year, rows of a location together and in the order of time, so that the maxima need one shuffle at most."""
    df.repartition("year", *keys).sortWithinPartitions("year", *keys, "time").write.mode("overwrite").partitionBy("year").parquet(path)


def _station_lines(spark: SparkSession, paths: str | list[str], years: tuple[int, int] | None) -> DataFrame:
    """All lines of station files, with the whole line in ``malformed`` where it has other fields than the schema."""
    options = {"nullValue": " ", "timestampFormat": "yyyy-MM-dd HH:mm", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "malformed"}
    lines = spark.read.text(paths).where("value <> ''").select("value", F.col("_metadata.file_name").alias("file"))
    df = lines.select(F.from_csv("value", f"{STATION_SCHEMA}, malformed string", options).alias("r"), "file").select("r.*", "file")
    return df if years is None else df.where(F.regexp_extract("file", r"(\d{4})", 1).cast("int").between(*years))


def read_stations(spark: SparkSession, paths: str | list[str], years: tuple[int, int] | None = None) -> DataFrame:
    """Station text files without header; a blank is a missing value, and so is NaN. ``file`` is the name of the row's file.

    Lines that are short or long, or have text where a number or time belongs, are left out: see ``malformed_lines``.
    """
    df = _station_lines(spark, paths, years).where("malformed IS NULL").drop("malformed")
    return nan_to_null(df, [c for c, t in df.dtypes if t == "double"])


def malformed_lines(spark: SparkSession, paths: str | list[str], years: tuple[int, int] | None = None) -> DataFrame:
    """``(file, malformed)``: the lines that ``read_stations`` leaves out."""
    return _station_lines(spark, paths, years).where("malformed IS NOT NULL").select("file", "malformed")


def read_station_list(spark: SparkSession, path: str) -> DataFrame:
    """Id, name and coordinates of the first row of each station; further columns of the headed file are not read."""
    df = spark.read.csv(path, sep="|", header=True)
    df = df.select(F.col("SRC_ID").cast("bigint").alias("SRC_ID"), "SRC_NAME", *[F.col(c).cast("double").alias(c) for c in ("HIGH_PRCN_LAT", "HIGH_PRCN_LON")])
    df = df.withColumn("_row", F.monotonically_increasing_id())
    first = df.groupBy("SRC_ID").agg(F.min_by(F.struct("SRC_NAME", "HIGH_PRCN_LAT", "HIGH_PRCN_LON"), "_row").alias("m"))
    return first.selectExpr("SRC_ID AS station", "m.SRC_NAME AS name", "m.HIGH_PRCN_LAT AS latitude", "m.HIGH_PRCN_LON AS longitude")


def write_stage(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Overwrite a stage table and read it back."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.parquet(path)


def read_maxima(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """Block maxima of some blocks, stored by block."""
    return spark.read.parquet(path).where(F.col("block").between(start, end))


def write_product(df: DataFrame, path: str) -> None:
    """A published table: doubles are stored as floats; descriptions stay."""
    df.select(*[F.col(c).cast("float").alias(c, metadata=df.schema[c].metadata) if t == "double" else F.col(c) for c, t in df.dtypes]).write.mode("overwrite").parquet(path)


def describe(df: DataFrame, about: dict[str, dict]) -> DataFrame:
    """Attach descriptions and units to columns; names that are not there are skipped."""
    for c, meta in about.items():
        if c in df.columns:
            df = df.withMetadata(c, meta)
    return df
