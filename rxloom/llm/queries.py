"""Queries of the problems on text and entities at corpus scale, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxloom.llm import components, linkage, mixing, names, neardup, residue, tokens
from rxloom.session import Scratch, read_table


def p3_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.match_products(spark, read_table(spark, sf_dir, "label_records"), read_table(spark, sf_dir, "spl_documents"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_confidence(spark, sf_dir).where("confidence >= 0.5").select("record_id", "document_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(spark, read_table(spark, sf_dir, "label_warnings"))
    return found.select(F.col("id").alias("warning_id"), "group_id").distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of ids of one organisation; groups of copies need every pair here, as the cases are pairs."""
    one, _ = Scratch(spark).keep(names.same_organisation(spark, read_table(spark, sf_dir, "manufacturer_versions")))
    pairs = one.alias("x").join(one.alias("y"), "organisation").where("x.manufacturer_id < y.manufacturer_id")
    return pairs.select(F.col("x.manufacturer_id").alias("manufacturer_id_a"), F.col("y.manufacturer_id").alias("manufacturer_id_b"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = lambda c: F.nullif(F.upper(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), F.lit(""))
    reviews = read_table(spark, sf_dir, "entity_resolution_reviews").where("status is null or status <> 'rejected'")
    edges = reviews.select(clean("candidate_a_id").alias("a"), clean("candidate_b_id").alias("b"))
    return components.connected_components(spark, edges).select(F.col("node").alias("entity_id"), F.col("component").alias("group_id"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(spark, read_table(spark, sf_dir, "documents"))


def p8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.decode(spark, p8_ids(spark, sf_dir))


def p9_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(p9_copies(spark, sf_dir), read_table(spark, sf_dir, "mix_targets"))


def p9_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source: whether no document is used too often, and whether the share is within a thousandth of its target."""
    targets = read_table(spark, sf_dir, "mix_targets").select("source", "max_repeats").distinct()
    held = p9_shares(spark, sf_dir).join(targets, "source")
    return held.select("source", (F.col("most_repeats") <= F.col("max_repeats")).alias("within_repeats"), (F.abs(F.col("actual_share") - F.col("target_share")) < 0.001).alias("at_target"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.find_residue(read_table(spark, sf_dir, "documents")).select("doc_id").distinct()


QUERIES = {f.__name__: f for f in (p3_found, p3_confidence, p5_found, p6_found, p7_found, p8_ids, p8_roundtrip, p9_copies, p9_shares, p9_bounds, p10_found)}

_P7 = r"""
with recursive e as (
  select a, b from (select upper(regexp_replace(candidate_a_id, '^\s+|\s+$', '', 'g')) as a, upper(regexp_replace(candidate_b_id, '^\s+|\s+$', '', 'g')) as b
    from entity_resolution_reviews where status is distinct from 'rejected') where a <> '' and b <> ''),
either as (select a, b from e where a <> b union select b, a from e where a <> b),
reach as (select a, b from either union select r.a, x.b from reach r join either x on r.b = x.a)
select a as entity_id, least(a, min(b)) as group_id from reach group by a"""

ORACLE = {"p7_found": _P7, "p9_bounds": "select distinct source, true as within_repeats, true as at_target from mix_targets", "p8_roundtrip": "select doc_id, coalesce(text, '') as text from documents"}
