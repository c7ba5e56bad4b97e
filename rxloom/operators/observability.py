"""Health and trend of ingestion runs and of entity resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """Null where there is nothing to divide by."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def success_rate(logs: DataFrame, now: Column, days: int) -> Column:
    """Completed runs among all of the last days; running and partial ones count below the line."""
    recent = F.col("started_at") >= now - F.expr(f"interval {days} days")
    return ratio(F.sum(F.when(recent & (F.col("status") == "completed"), 1).otherwise(0)), F.sum(F.when(recent, 1).otherwise(0)))


def source_health(logs: DataFrame, dead: DataFrame, now: Column) -> DataFrame:
    """One row a source: rates of 7 and 30 days, the last run, and dead letters against records of 30 days.

    A source without logs has no row; a source without records has null rates."""
    recent = F.col("started_at") >= now - F.expr("interval 30 days")
    runs = logs.groupBy("source").agg(
        success_rate(logs, now, 7).alias("success_rate_7d"), success_rate(logs, now, 30).alias("success_rate_30d"),
        F.max_by("run_id", F.struct("started_at", "run_id")).alias("last_run_id"), F.max_by("status", F.struct("started_at", "run_id")).alias("last_status"),
        F.coalesce(F.sum(F.when(recent, F.col("records_fetched"))), F.lit(0)).alias("fetched_30d"),
    )
    letters = dead.where(F.col("created_at") >= now - F.expr("interval 30 days")).groupBy("source").agg(F.count("*").alias("n"))
    return runs.join(letters, "source", "left").select(
        *runs.columns, F.coalesce("n", F.lit(0)).alias("dead_letters_30d"), ratio(F.coalesce("n", F.lit(0)), F.col("fetched_30d")).alias("dead_letter_rate")
    )


def daily_trend(logs: DataFrame, dead: DataFrame, reviews: DataFrame, since: Column) -> DataFrame:
    """One row a source and day that has runs, in order of days: records, failure rate, dead letters, reviews of all sources.

    since is an instant, so the first day may be partial; days without runs have no row."""
    runs = logs.where(F.col("started_at") >= since).groupBy("source", F.to_date("started_at").alias("day")).agg(
        F.sum("records_fetched").alias("fetched"), F.sum("records_rejected").alias("rejected")
    )
    letters = dead.where(F.col("created_at") >= since).groupBy("source", F.to_date("created_at").alias("day")).agg(F.count("*").alias("dead"))
    asked = reviews.where(F.col("created_at") >= since).groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("asked"))
    return runs.join(letters, ["source", "day"], "left").join(asked, "day", "left").select(
        "source", F.date_format("day", "yyyy-MM-dd").alias("day"), "fetched", ratio(F.col("rejected"), F.col("fetched")).alias("failure_rate"),
        F.coalesce("dead", F.lit(0)).alias("dead_letters"), F.coalesce("asked", F.lit(0)).alias("reviews_created"),
    ).orderBy("day", "source")


def review_backlog(reviews: DataFrame, now: Column) -> DataFrame:
    is_ = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, 1)), F.lit(0)).alias(f"{s}_count")
    oldest = F.min(F.when(F.col("status") == "pending", F.col("created_at")))
    hours = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(oldest.cast("timestamp"))) / 3.6e9
    return reviews.agg(is_("pending"), is_("approved"), is_("rejected"), F.round(hours, 4).alias("oldest_pending_hours"))


def run_counters(outcomes: DataFrame) -> DataFrame:
    """records_fetched, _validated, _created, _updated, _unchanged, _rejected of (run_id, outcome), in one aggregation."""
    count = lambda o: F.sum(F.when(F.col("outcome") == o, 1).otherwise(0)).alias(f"records_{o}")
    return outcomes.groupBy("run_id").agg(F.count("*").alias("records_fetched"), F.sum(F.when(F.col("outcome") == "rejected", 0).otherwise(1)).alias("records_validated"), *map(count, ("created", "updated", "unchanged", "rejected")))


def resumable_run(logs: DataFrame) -> DataFrame:
    """The latest running or partial run of each source and endpoint (of its checkpoint)."""
    endpoint = F.get_json_object("checkpoint_state", "$.endpoint")
    held = logs.where(F.col("status").isin("running", "partial")).withColumn("endpoint", endpoint).where("endpoint is not null")
    latest = F.struct("started_at", "run_id")
    return held.groupBy("source", "endpoint").agg(
        F.max_by("run_id", latest).alias("run_id"), F.max_by(F.get_json_object("checkpoint_state", "$.records_processed").cast("long"), latest).alias("records_processed")
    )


def resume_by_position(records: DataFrame, ordinal: str, processed: int) -> DataFrame:
    return records.where(F.col(ordinal) >= processed)


def resume_by_name(packages: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return packages.join(done.select(key).distinct(), key, "left_anti")
