"""Append-only versioned entities: ids, current versions, history, change-detecting upsert.

Identity tables are not stored: an entity is its version 1, its current version the highest one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rxloom.functions.text import entity_id
from rxloom.session import Scratch


def current_versions(versions: DataFrame, entity: str) -> DataFrame:
    """The highest version of each entity; of equal numbers the highest id. One aggregation."""
    row = F.struct(*versions.columns)
    return versions.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.max_by(row, F.struct("version_number", "id")).alias("v")).select("v.*")


def history_of(versions: DataFrame, entity: str, value: str) -> DataFrame:
    return versions.where(F.col(entity) == value).orderBy("version_number", "id")


def active_only(current: DataFrame) -> DataFrame:
    return current.where("status = 'active'")


def dense_numbers(df: DataFrame, order: list[str], column: str, start: int = 0) -> DataFrame:
    """Adds 1, 2, ... after start in this order, without gathering the rows in one task.

    Rows are range-partitioned; a partition's numbers begin after the counts of those before it. The
    partitions are written first: cut again for the counts, which need fewer columns, adaptive
    execution would put them together in another way."""
    cut, _ = Scratch(df.sparkSession).keep(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    counts = {r[0]: r[1] for r in cut.groupBy("_p").count().collect()}  # one row a partition
    before, total = [], start
    for p in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(p, 0)
    offset = F.element_at(F.array(*map(F.lit, before or [start])), F.col("_p") + 1)
    return cut.withColumn(column, F.row_number().over(Window.partitionBy("_p").orderBy(*order)) + offset).drop("_p")


def create_entities(names: DataFrame, order: list[str], prefix: str, last: int = 0) -> DataFrame:
    """New entities of names: ids after the last given number, version 1, active."""
    numbered = dense_numbers(names, order, "_n", last)
    return numbered.select(entity_id(prefix, F.col("_n")).alias("entity_id"), F.lit(1).alias("version_number"), *names.columns, F.lit("active").alias("status"))


def add_versions(versions: DataFrame, entity: str, changes: DataFrame) -> DataFrame:
    """Rows of changes (entity, ...) with the number after the entity's highest; unknown entities
    give no row (see unknown_entities)."""
    top = versions.groupBy(entity).agg(F.max("version_number").alias("_top"))
    nth = F.row_number().over(Window.partitionBy(entity).orderBy(*[c for c in changes.columns if c != entity]))
    return changes.join(top, entity).withColumn("version_number", F.col("_top") + nth).drop("_top")


def unknown_entities(versions: DataFrame, entity: str, changes: DataFrame) -> DataFrame:
    return changes.join(versions.select(entity).distinct(), entity, "left_anti")


def sorted_multiset(*columns: str) -> Column:
    """All rows of a group as one sorted array; equal as multisets if equal as arrays."""
    return F.sort_array(F.collect_list(F.struct(*columns)))


def upsert_outcomes(incoming: DataFrame, existing: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """key, outcome: created, updated or unchanged, nulls being equal."""
    was = existing.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_{c}") for c in compared))
    same = F.lit(True)
    for c in compared:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    outcome = F.when(F.col("_k").isNull(), "created").when(same, "unchanged").otherwise("updated")
    return incoming.join(was, incoming[key] == F.col("_k"), "left").select(key, outcome.alias("outcome"))


def first_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in this order: an aggregation, not a window."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_f")).select(*keys, "_f.*")


def repoint_links(links: DataFrame, redirects: DataFrame, owner: str, target: str) -> DataFrame:
    """Links of losers go to their winners; a link that is already there stays as it is.

    redirects (loser, winner) is joined whole; of several links to one winner the winner's own comes
    first, then the lowest loser's."""
    moved = links.join(redirects.select(F.col("loser").alias("_l"), F.col("winner").alias("_w")), F.col(target) == F.col("_l"), "left")
    rest = [c for c in links.columns if c not in (owner, target)]
    marked = moved.select(owner, F.coalesce("_w", target).alias(target), *rest, F.col("_w").isNotNull().alias("_moved"), F.col(target).alias("_from"))
    return first_by_key(marked, [owner, target], ["_moved", "_from", *rest]).drop("_moved", "_from")
