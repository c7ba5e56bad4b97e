"""Connected groups of a pair table, for resolution: alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxloom.session import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every node's (larger, or other) neighbours are linked to its smallest neighbour or itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.where("v < u")
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = near.join(least, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    return joined.select(F.col("v").alias("a"), "m").unionByName(least.select(F.col("u").alias("a"), "m")).where("a <> m").select(F.col("a").alias("u"), F.col("m").alias("v")).distinct()


def group_pairs(spark: SparkSession, pairs: DataFrame) -> DataFrame:
    """node, component (its smallest node) of the nodes of pairs (u, v). Self-pairs and nulls link nothing."""
    scratch = Scratch(spark)
    held, path = scratch.keep(pairs.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        kept, at = scratch.keep(_star(_star(held, True), False))
        scratch.drop(path)
        held, path = kept, at
        now = held.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = held.select(F.col("v").alias("u"), "v")
    return held.unionByName(roots).select(F.col("u").alias("node"), F.col("v").alias("component")).distinct()
