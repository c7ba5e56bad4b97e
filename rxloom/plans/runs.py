"""Runs of loads over a store in a folder: batches, checkpoints, resuming, dead letters and their reprocessing.

Tables are folders of parquet files, one subfolder for each batch of a run; a batch only adds its own.
Its last file is its row of the log: rows of a batch without one don't count, so a batch that broke off
is as if it hadn't been, and is written anew when the run is resumed. The log has a row for each state of
a run, the latest of which holds. One run writes at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rxloom.operators.observability import resumable_run, resume_by_name, resume_by_position
from rxloom.plans.load import PARTS, load_documents, load_labels
from rxloom.schema import TABLES
from rxloom.session import Scratch, at_once, empty, exists

BATCH = 100_000
_SCHEMAS = {t: TABLES[t].replace("decimal(38,18)", "double") for t in PARTS} | {
    "sources": TABLES["sources"],
    "reviews": "id long, entity_type string, candidate_a_id string, candidate_b_id string, confidence_score double, status string, created_at timestamp",
    "dead_letters": "id long, source string, run_id string, stage string, record_identifier string, raw_payload string, error_message string, created_at timestamp",
    "reprocessed": "id long, reprocessed_at timestamp",
    "packages": "run_id string, package_name string",
}
_COUNTERS = ["fetched", "validated", "created", "updated", "unchanged", "rejected"]
_LOG = "source string, run_id string, status string, checkpoint_state string, " + ", ".join(f"records_{c} long" for c in _COUNTERS) + ", started_at timestamp, completed_at timestamp, batch int"


class RunStore:
    """The tables in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, table: str, schema: str) -> DataFrame:
        if not exists(self.spark, f"{self.path}/{table}"):
            return empty(self.spark, schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{table}")

    def log(self) -> DataFrame:
        """One row a run, as it stands."""
        states = self._folder("log", _LOG + ", _run string, _part string")
        latest = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("batch"), F.desc("_part")))
        return states.drop("_run").withColumn("_n", latest).where("_n = 1").drop("_n", "_part")

    def _done(self) -> DataFrame:
        return self.log().select(F.col("run_id").alias("_run"), F.col("batch").alias("_last"))

    def table(self, name: str, done: DataFrame | None = None) -> DataFrame:
        """The rows of all batches that were completed; ``done`` says which where it is at hand."""
        if not exists(self.spark, f"{self.path}/{name}"):
            return empty(self.spark, _SCHEMAS[name])
        rows = self._folder(name, _SCHEMAS[name] + ", _run string, _batch int")
        return rows.join(self._done() if done is None else done, "_run").where("_batch <= _last").drop("_run", "_batch", "_last")

    def tables(self) -> dict[str, DataFrame]:
        """The tables of a load. What is done is written once: each plan would find it out again for each table."""
        done, _ = Scratch(self.spark).keep(self._done())
        return {t: self.table(t, done) for t in PARTS}

    def _write(self, table: str, rows: DataFrame, run: str, batch: int) -> None:
        rows.select(*(x.split()[0] for x in _SCHEMAS[table].split(", "))).write.mode("overwrite").parquet(f"{self.path}/{table}/_run={run}/_batch={batch}")

    def _state(self, source: str, endpoint: str, run: str, status: str, processed: int, counts: dict, started, now: Column, batch: int) -> None:
        row = (source, run, status, json.dumps({"endpoint": endpoint, "records_processed": processed}), *(counts[c] for c in _COUNTERS), started, None, batch)
        df = self.spark.createDataFrame([row], _LOG)
        if status == "completed":
            df = df.withColumn("completed_at", now)
        part = {"running": "0", "partial": "1", "completed": "2"}[status]
        df.write.mode("overwrite").parquet(f"{self.path}/log/_run={run}/_part={batch:08d}-{part}")

    def ingest(self, kind: str, records: DataFrame, now: Column, endpoint: str | None = None, run_id: str | None = None, batch_size: int = BATCH) -> str:
        """Loads all records of a stream in batches and returns the run's id.

        kind 'labels': records (ordinal, raw), 'documents': (ordinal, xml, EXTRACTED). ordinal is the
        position in the whole stream, from 0, and is the same each time. If a run of the same source and
        endpoint is running or partial it is resumed, unless a run_id is given: labels go on after the
        checkpoint's position, documents skip packages that are done. An error ends the run as partial.
        """
        source = {"labels": "openfda", "documents": "dailymed"}[kind]
        endpoint = endpoint or {"labels": "drug/label", "documents": "spl"}[kind]
        open_ = None if run_id else resumable_run(self.log().where(F.col("source") == source)).where(F.col("endpoint") == endpoint).first()
        if open_:
            run_id = open_["run_id"]
            log = self.log().where(F.col("run_id") == run_id).first()
            counts, batch, started = {c: log[f"records_{c}"] for c in _COUNTERS}, log["batch"], log["started_at"]
            processed = json.loads(log["checkpoint_state"])["records_processed"]
            source_id = self.table("sources").where(F.col("ingestion_run_id") == run_id).first()["id"]
        else:
            run_id = run_id or uuid.uuid4().hex
            counts, batch, processed = dict.fromkeys(_COUNTERS, 0), 0, 0
            started = self.spark.range(1).select(now.cast("timestamp").alias("t")).first()[0]
            source_id = 1 + (self.table("sources").agg(F.max("id")).first()[0] or 0)
            row = self.spark.range(1).select(F.lit(source_id).alias("id"), F.lit(source).alias("source_system"), F.lit(endpoint).alias("endpoint_or_document_type"), F.lit(run_id).alias("ingestion_run_id"), F.lit(None).cast("string").alias("raw_payload_ref"), now.alias("ingested_at"), now.alias("created_at"))
            self._write("sources", row, run_id, 0)
        self._state(source, endpoint, run_id, "running", processed, counts, started, now, batch)
        try:
            if kind == "documents":
                done = self.table("packages").where(F.col("run_id") == run_id)
                records = resume_by_name(records, done, "package_name")
            else:
                records = resume_by_position(records, "ordinal", processed)
            ends = records.agg(F.min("ordinal"), F.max("ordinal")).first()
            first = ends[0]
            while first is not None and first <= ends[1]:
                part = records.where((F.col("ordinal") >= first) & (F.col("ordinal") < first + batch_size))
                batch += 1
                self._batch(kind, source, run_id, part, counts, source_id, now, batch)
                first += batch_size
                processed = first if kind == "labels" else counts["fetched"]
                self._state(source, endpoint, run_id, "running", min(processed, ends[1] + 1) if kind == "labels" else processed, counts, started, now, batch)
        except Exception:
            done_so_far = self.log().where(F.col("run_id") == run_id).first()
            at = json.loads(done_so_far["checkpoint_state"])["records_processed"]
            self._state(source, endpoint, run_id, "partial", at, {c: done_so_far[f"records_{c}"] for c in _COUNTERS}, started, now, done_so_far["batch"])
            raise
        self._state(source, endpoint, run_id, "completed", min(processed, ends[1] + 1) if kind == "labels" and ends[1] is not None else processed, counts, started, now, batch)
        return run_id

    def _batch(self, kind: str, source: str, run: str, part: DataFrame, counts: dict, source_id: int, now: Column, batch: int) -> None:
        load = load_labels if kind == "labels" else load_documents
        rows = load(self.spark, part, self.tables(), source_id, now)
        letters = rows["dead_letters"].select(F.xxhash64(F.lit(run), "stage", "record_identifier", "raw_payload", "error_message").alias("id"), F.lit(source).alias("source"), F.lit(run).alias("run_id"), "stage", "record_identifier", "raw_payload", "error_message", now.alias("created_at"))
        tables = {t: rows[t] for t in (*PARTS, "reviews")} | {"dead_letters": letters}
        if kind == "documents":
            tables["packages"] = part.select(F.lit(run).alias("run_id"), "package_name")
        at_once(*(lambda t=t, df=df: self._write(t, df, run, batch) for t, df in tables.items()))
        fetched = part.count()
        outcomes = {r[0]: r[1] for r in rows["outcomes"].groupBy("outcome").count().collect()}
        stages = {r[0]: r[1] for r in rows["dead_letters"].groupBy("stage").count().collect()}
        counts["fetched"] += fetched
        counts["validated"] += sum(outcomes.values()) + stages.get("save", 0)
        counts["rejected"] += sum(stages.values())
        for o in ("created", "updated", "unchanged"):
            counts[o] += outcomes.get(o, 0)

    def open_letters(self, source: str) -> DataFrame:
        """Dead letters that weren't tried again yet."""
        return self.table("dead_letters").where(F.col("source") == source).join(self.table("reprocessed"), "id", "left_anti")

    def reprocess_labels(self, now: Column, batch_size: int = BATCH) -> str:
        """Runs the open dead letters of labels through the same pipeline, under an endpoint of their own.

        Each is marked as tried, also if it fails again, which gives a new dead letter."""
        from rxloom.operators.store import dense_numbers

        held, _ = Scratch(self.spark).keep(self.open_letters("openfda").select("id", F.col("raw_payload").alias("raw")))
        records, _ = Scratch(self.spark).keep(dense_numbers(held, ["id"], "ordinal", -1))
        return self._again("labels", records, now, batch_size)

    def reprocess_documents(self, now: Column, batch_size: int = BATCH) -> str:
        from rxloom.functions.text import decode_payload
        from rxloom.operators.store import dense_numbers
        from rxloom.sources.spl import extract_packages

        held, _ = Scratch(self.spark).keep(self.open_letters("dailymed").select("id", decode_payload(F.col("raw_payload")).alias("p")).select("id", "p.package_name", "p.xml"))
        numbered, _ = Scratch(self.spark).keep(dense_numbers(held, ["id"], "ordinal", -1))
        return self._again("documents", numbered.join(extract_packages(numbered), "package_name"), now, batch_size)

    def _again(self, kind: str, records: DataFrame, now: Column, batch_size: int) -> str:
        endpoint = {"labels": "drug/label:reprocess", "documents": "spl:reprocess"}[kind]
        run = self.ingest(kind, records, now, endpoint, batch_size=batch_size)
        tried = records.select("id", now.cast("timestamp").alias("reprocessed_at")).distinct()
        last = self.log().where(F.col("run_id") == run).first()["batch"]
        self._write("reprocessed", tried, run, last)
        return run

    def status_summary(self) -> DataFrame:
        """status, runs: how many runs ended how."""
        return self.log().groupBy("status").agg(F.count("*").alias("runs")).orderBy("status")
