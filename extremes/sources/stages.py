"""Stored tables: bucketed by location, or partitioned by block and updated block by block."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.blockmax import block_maxima, free_name


def write_bucketed(df: DataFrame, table: str, keys: list[str], time: str, buckets: int, path: str | None = None) -> DataFrame:
    """Store a record as a table bucketed by location and sorted by time, and read it back.

    Windows and aggregates by location then need no shuffle. ``path`` puts the files somewhere else than the warehouse.
    """
    writer = df.repartition(buckets, *keys).write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys, time)
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return df.sparkSession.table(table)


def attach_bucketed(spark: SparkSession, table: str, path: str, keys: list[str], time: str, buckets: int) -> DataFrame:
    """A stored bucketed record under a table name of this session; ``buckets`` and ``keys`` are those it was written with."""
    columns = ", ".join(f"`{c}` {t}" for c, t in spark.read.parquet(path).dtypes)
    by, order = ", ".join(f"`{k}`" for k in keys), ", ".join(f"`{k}`" for k in (*keys, time))
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({order}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(table)


def exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop_path)


def stored_blocks(spark: SparkSession, path: str, block: str) -> list:
    """The blocks that a table has partitions of, from its folders; empty if there is no table."""
    if not exists(spark, path):
        return []
    return sorted(r[0] for r in spark.read.parquet(path).select(block).distinct().collect())


def write_blocks(df: DataFrame, path: str, block: str) -> None:
    """Replace the partitions of the blocks that ``df`` holds; all others keep their files."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(block).parquet(path)


def update_maxima(
    spark: SparkSession, source: str, target: str, keys: list[str], time: str, value: str, block: str, durations: Iterable[float], step: float = 1.0,
    across_blocks: bool = False, again: Iterable = (),
) -> list:
    """Block maxima of the blocks of ``source`` that ``target`` has none of yet; returns those blocks.

    Both are tables partitioned by block. Only partitions of new blocks are read, with the one before each for windows
    that run ``across_blocks``, which must not be longer than a block. ``again`` names blocks to compute anew, as after a correction of the source; with
    ``across_blocks`` name the one after it too.
    """
    there = stored_blocks(spark, source, block)
    done = set(stored_blocks(spark, target, "block")) - set(again)
    new = [b for b in there if b not in done]
    if not new:
        return []
    read = set(new) | ({there[i - 1] for i, b in enumerate(there) if i and b in set(new)} if across_blocks else set())
    series = spark.read.parquet(source).where(F.col(block).isin(*sorted(read)))
    found = block_maxima(series, keys, time, value, block, durations, step, across_blocks)
    write_blocks(found.where(F.col("block").isin(*new)), target, "block")
    return new


def update_record(spark: SparkSession, path: str, update: DataFrame, keys: list[str], value: str, block: str) -> dict[str, int]:
    """Fill the gaps of a stored record, partitioned by block, from ``update``; returns the counts of the merge.

    Missing values and missing rows are taken from the update, values that are there stay. Only partitions of blocks that
    the update holds are read and written. ``rows`` and ``gaps`` are the merged rows of those blocks and how many of them are
    still without a value, ``filled`` how many took the update's. ``keys`` must tell rows apart and include neither the block nor the value; other
    columns of the record stay, and are null in rows that only the update has.
    """
    blocks = [r[0] for r in update.select(block).distinct().collect()]  # as many as partitions
    nothing = {"rows": 0, "gaps": 0, "filled": 0}
    if not blocks:
        return nothing
    main = spark.read.parquet(path)
    other, was = free_name(main, "_update"), free_name(main, "_was")
    new = update.select(*keys, block, F.col(value).alias(other)).dropDuplicates([*keys, block])
    both = main.where(F.col(block).isin(*blocks)).withColumn(was, F.col(value)).join(new, [*keys, block], "full_outer")
    both = both.withColumn(value, F.coalesce(was, other))
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("rows"), F.count_if(F.col(value).isNull()).alias("gaps"), F.count_if(F.col(was).isNull() & F.col(value).isNotNull()).alias("filled")]
    write_blocks(both.observe(seen, *counts).select(*main.columns), path, block)
    return {**nothing, **seen.get}
