"""Consolidating pairwise links into groups (problem 7).

Minimum labels are propagated across edges and accelerated by pointer jumping. A round: every node
takes the smallest of itself and its neighbours as its label; labels are followed to their ends by
pointer jumping; the edges are rewritten between the ends, and those inside one group are dropped.
So a path loses at least half its length in a round, and edges die out as groups are found. Every
round is written in the shared folder and read back. It ends when no edge, thus no change, is left.

Skew: minima and distinct edges are aggregated before each shuffle, and the lookups are sort-merge
joins that adaptive execution splits where one node holds a large share of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxloom.session import Scratch


def _lookup(rows: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """``rows`` with ``key`` replaced by its label in table (node, label), if it has one."""
    named = table.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
    return rows.join(named, F.col(key) == F.col("_n"), "left").withColumn(key, F.coalesce("_l", key)).drop("_n", "_l")


def _jump(scratch: Scratch, parents: DataFrame, path: str) -> tuple[DataFrame, str]:
    """Pointer jumping: every node's label becomes the end of its chain of labels."""
    while True:
        moved = _lookup(parents.withColumn("was", F.col("label")), "label", parents)
        held, at = scratch.keep(moved)
        changed = held.where("label <> was").limit(1).count()
        scratch.drop(path)
        parents, path = held.drop("was"), at
        if not changed:
            return parents, path


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """node, component of every node of edges (a, b): component is the smallest node of its group.

    Repeated and turned edges count once; edges with a null end and edges of a node with itself link
    nothing. An empty table gives an empty result.
    """
    scratch = Scratch(spark)
    real = edges.where("a is not null and b is not null and a <> b")
    once = real.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    held, at = scratch.keep(once.distinct())
    labels: DataFrame | None = None
    labels_at = ""
    while not held.isEmpty():
        either = held.unionByName(held.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents, parents_at = scratch.keep(either.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).withColumn("label", F.least("node", "label")))
        roots, roots_at = _jump(scratch, parents, parents_at)
        rewritten = _lookup(_lookup(held, "a", roots), "b", roots).where("a <> b")
        next_held, next_at = scratch.keep(rewritten.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        if labels is None:
            labels, labels_at = roots, roots_at
        else:
            moved, moved_at = scratch.keep(_lookup(labels, "label", roots))
            scratch.drop(labels_at, roots_at)
            labels, labels_at = moved, moved_at
        scratch.drop(at)
        held, at = next_held, next_at
    if labels is None:
        return held.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels.select("node", F.col("label").alias("component"))
