"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

MAX_ROUNDS = 60
#: Parts over which a node's edges are dealt, so that the edges of a hot node do not meet in one task.
SALTS = 64


def _least(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``edges(a, b, salt)`` -> the least b of every a, by (a) and by (a, salt); a node has SALTS rows at most in the latter."""
    parts = edges.groupBy("a", "salt").agg(F.min("b").alias("least"))
    low = parts.groupBy("a").agg(F.min("least").alias("low"))
    return low, parts.select("a", "salt").join(low, "a")


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """Re-hang neighbours of every node on the smallest of them (and the node itself)."""
    salt = F.pmod(F.xxhash64("b"), F.lit(SALTS)).alias("salt")
    if larger:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).select("a", "b", salt)
        hung = both.where("b > a").join(_least(both)[1], ["a", "salt"]).select(F.col("b").alias("x"), F.least("a", "low").alias("y"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).select("a", "b", salt)
        low, salted = _least(down)
        hung = (
            down.join(salted, ["a", "salt"]).where("b <> low").select(F.col("b").alias("x"), F.col("low").alias("y"))
            .unionByName(low.select(F.col("a").alias("x"), F.col("low").alias("y")))
        )
    return hung.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether ``edges(a > b)``, distinct, are stars already: every a has one edge, and no b is an a. One partial aggregate."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    nodes = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return not nodes.where("ups > 1 OR (ups = 1 AND least = 0)").agg(F.count("*").alias("n")).first()["n"]


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(node, component)``, component the smallest node id that can be reached.

    Only nodes with an edge to another node are returned. Rows with a null end and loops are ignored; repeated rows
    change nothing; an empty table gives an empty one. Every round re-hangs edges by joins on (node, salt) with a
    partial minimum, so the edges of a node with very many neighbours are dealt over SALTS parts; the number of rounds grows with the
    logarithm of the longest chain, and edges that are stars already take none. Each step's edges are written to the shared
    folder.
    """
    current = materialize(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    for _ in range(MAX_ROUNDS):
        if _settled(current):
            break
        hung = materialize(_stars(current, True), "edges")  # keeps plans small
        current = materialize(_stars(hung, False), "edges")
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
