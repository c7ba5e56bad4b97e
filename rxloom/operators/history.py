"""History of changing attributes (problem 4): periods in which an entity kept one state.

Each attribute has its own change log with its own intervals. The logs are combined by splitting at
the union of their boundaries and coalescing neighbours with an equal state. All windows run over
(entity, time bucket): an entity with more than ``hot_rows`` versions is cut into buckets of time,
and the little that crosses a bucket's edge is carried over in one row per bucket. So no task holds
a whole hot entity. Where there is none (counted first) all windows share one partitioning by entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 200_000


def effective_versions(
    versions: DataFrame, runs: DataFrame, entity: str, attributes: list[str]
) -> DataFrame:
    """entity_id, at, version_number, state: the versions that take effect.

    Of rows with the same entity and version_number the one whose run has the latest ingested_at
    holds (then the highest id; an unknown run counts as earliest). Of versions with equal
    created_at the highest version_number holds. Rows without entity, number or time take no effect.
    """
    arrived = F.broadcast(runs.groupBy(F.col("id").alias("_run")).agg(F.max("ingested_at").alias("_in")))
    rows = versions.select(
        F.col(entity).cast("string").alias("entity_id"),
        "version_number",
        F.col("created_at").alias("at"),
        F.struct(*(F.col(a).cast("string").alias(a) for a in attributes)).alias("state"),
        F.col("source_id").alias("_run"),
        F.col("id").alias("_id"),
    ).where("entity_id is not null and version_number is not null")
    last = F.struct("_in", "_id", "at", "state")  # nulls are least
    held = (
        rows.join(arrived, "_run", "left")
        .groupBy("entity_id", "version_number")
        .agg(F.max_by(F.struct("at", "state"), last).alias("v"))
        .where("v.at is not null")
    )
    return (
        held.groupBy("entity_id", F.col("v.at").alias("at"))
        .agg(F.max("version_number").alias("version_number"), F.max_by("v.state", "version_number").alias("state"))
    )


def time_buckets(df: DataFrame, key: str, at: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds ``bucket``, 0 but for a key of more than hot_rows rows, where it is a span of time, and ``hot``.

    The table of hot keys has at most rows / hot_rows entries, each with its own cuts, and as many
    cuts in all; it is the only thing broadcast here.
    """
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    counts = df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows)
    if counts.isEmpty():
        return df.withColumn("hot", F.lit(False)).withColumn("bucket", F.lit(0))
    ranked = df.join(F.broadcast(counts), key).select(key, micros.alias("_t"), "_n")
    share = F.lit(float(hot_rows)) / F.col("_n")
    # cuts: approximate quantiles of a fixed fine grid, thinned to one for each hot_rows rows
    grid = ranked.groupBy(key).agg(
        F.max("_n").alias("_n"), F.percentile_approx("_t", [i / 1000 for i in range(1, 1000)], 20_000).alias("_q")
    )
    step = F.greatest(F.lit(1), F.floor(1000 * share)).cast("int")
    cuts = grid.select(key, F.array_distinct(F.filter("_q", lambda x, i: (i + 1) % step == 0)).alias("_cuts"))
    return (
        df.join(F.broadcast(cuts), key, "left")
        .withColumn("hot", F.col("_cuts").isNotNull())
        .withColumn("bucket", F.when(F.col("hot"), F.size(F.filter("_cuts", lambda c: c <= micros))).otherwise(0))
        .drop("_cuts")
    )


def _carried(df: DataFrame, value: Column, back: bool) -> DataFrame:
    """entity_id, bucket, edge: of the nearest earlier (back) or later bucket of the same entity its
    last or first ``value``. Only entities with several buckets have such rows, so it is small."""
    own = df.where("hot").groupBy("entity_id", "bucket").agg(
        (F.max_by if back else F.min_by)(value, F.col("at")).alias("edge")
    )
    order = Window.partitionBy("entity_id").orderBy("bucket")
    moved = (F.lag if back else F.lead)(F.struct("edge")).over(order)
    return own.select("entity_id", "bucket", moved.alias("edge")).where("edge is not null").select(
        "entity_id", "bucket", F.col("edge.edge").alias("edge")
    )


def change_log(effective: DataFrame, attributes: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Events of single attributes: entity_id, bucket, hot, at, version_number, attribute, value.

    An event stands wherever an attribute's value differs from the one before (nulls are equal).
    """
    cut = time_buckets(effective, "entity_id", "at", hot_rows)
    own = Window.partitionBy("entity_id", "bucket").orderBy("at")
    before = cut.join(F.broadcast(_carried(cut, F.col("state"), True)), ["entity_id", "bucket"], "left")
    before = before.withColumn("was", F.coalesce(F.lag(F.struct(F.col("state").alias("edge"))).over(own), F.when(F.col("edge").isNotNull(), F.struct("edge"))))
    events = F.filter(
        F.array(
            *(
                F.when(
                    F.col("was").isNull() | ~F.col(f"was.edge.{a}").eqNullSafe(F.col(f"state.{a}")),
                    F.struct(F.lit(a).alias("attribute"), F.col(f"state.{a}").alias("value")),
                )
                for a in attributes
            )
        ),
        lambda e: e.isNotNull(),
    )
    return before.select("entity_id", "bucket", "hot", "at", "version_number", F.explode(events).alias("e")).select(
        "entity_id", "bucket", "hot", "at", "version_number", "e.attribute", "e.value"
    )


def attribute_intervals(effective: DataFrame, attributes: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """entity_id, attribute, value, valid_from, valid_to (null: still valid) of each attribute alone."""
    log = change_log(effective, attributes, hot_rows)
    own = Window.partitionBy("entity_id", "attribute", "bucket").orderBy("at")
    firsts = log.where("hot").groupBy("entity_id", "attribute", "bucket").agg(F.min("at").alias("first"))
    later = F.lead("first").over(Window.partitionBy("entity_id", "attribute").orderBy("bucket"))
    edges = firsts.select("entity_id", "attribute", "bucket", later.alias("next"))
    return log.join(F.broadcast(edges), ["entity_id", "attribute", "bucket"], "left").select(
        "entity_id", "attribute", "value", F.col("at").alias("valid_from"),
        F.coalesce(F.lead("at").over(own), F.col("next")).alias("valid_to"),
    )


def periods(effective: DataFrame, attributes: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """entity_id, version_number, valid_from, valid_to, state of each longest period of one state.

    The attributes' logs are split at the union of their boundaries: at each boundary every
    attribute has the value of its own interval there. Equal neighbours are coalesced.
    """
    log = change_log(effective, attributes, hot_rows)
    at_boundary = log.groupBy("entity_id", "bucket", "hot", "at").agg(
        F.max("version_number").alias("version_number"),
        *(F.max(F.when(F.col("attribute") == a, F.struct(F.col("value").alias("v")))).alias(f"c_{a}") for a in attributes),
    )
    own = Window.partitionBy("entity_id", "bucket").orderBy("at")
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    # the last value of each attribute before a bucket, found in the bucket summaries
    summary = at_boundary.where("hot").groupBy("entity_id", "bucket").agg(
        *(F.max_by(f"c_{a}", F.when(F.col(f"c_{a}").isNotNull(), F.col("at"))).alias(f"c_{a}") for a in attributes)
    )
    over = Window.partitionBy("entity_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    entering = summary.select("entity_id", "bucket", *(F.last(f"c_{a}", True).over(over).alias(f"b_{a}") for a in attributes))
    held = at_boundary.join(F.broadcast(entering), ["entity_id", "bucket"], "left").select(
        "entity_id", "bucket", "hot", "at", "version_number",
        F.struct(*(F.coalesce(F.last(f"c_{a}", True).over(upto), F.col(f"b_{a}")).getField("v").alias(a) for a in attributes)).alias("state"),
    )
    prior = held.join(F.broadcast(_carried(held, F.col("state"), True)), ["entity_id", "bucket"], "left").withColumn(
        "was", F.coalesce(F.lag(F.struct(F.col("state").alias("edge"))).over(own), F.when(F.col("edge").isNotNull(), F.struct("edge")))
    ).drop("edge")
    opened = prior.where(F.col("was").isNull() | ~F.col("was.edge").eqNullSafe(F.col("state"))).drop("was")
    closed = opened.join(F.broadcast(_carried(opened, F.col("at"), False)), ["entity_id", "bucket"], "left")
    return closed.select(
        "entity_id", "version_number", F.col("at").alias("valid_from"),
        F.coalesce(F.lead("at").over(own), F.col("edge")).alias("valid_to"), "state",
    )
