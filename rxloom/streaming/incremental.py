"""Incremental loads with Structured Streaming: files as they arrive, parsed, checked and appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxloom.plans.ingest import dead_letters, label_reasons, parse_label_records, transform_labels


def load_labels(spark: SparkSession, folder: str, target: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None):
    """Reads text files with one JSON record a line, and appends candidates and dead letters.

    Each batch is written under its number, overwriting what a failed attempt left, so a restart gives
    no repeated rows. Returns the started query; it ends when all files present are read."""

    def save(batch: DataFrame, number: int) -> None:
        parsed = parse_label_records(batch.withColumnRenamed("value", "raw").withColumn("kept", F.col("raw"))).withColumn(
            "reason", F.coalesce("parse_error", label_reasons(F.col("brand_name"), F.col("generic_name"), F.col("substance_names")))
        )
        good = transform_labels(parsed.where("reason = ''"))
        good.write.mode("overwrite").parquet(f"{target}/candidates/batch={number}")
        dead_letters(parsed, "validation", "reason", "record_key", F.col("kept")).write.mode("overwrite").parquet(f"{target}/dead_letters/batch={number}")
        if on_batch:
            on_batch(good, number)

    lines = spark.readStream.text(folder)
    return lines.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events a window and type, with late rows taken until the watermark passes."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
