"""Loads: candidates of either source to entities, outcomes and the rows to append; decisions on reviews.

Nothing is overwritten: every table gets new rows, and a load that fails before they are written leaves
the store as it was. Loaded again, the same records are 'unchanged'. One load at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rxloom.functions.text import encode_payload, normalize_name
from rxloom.operators.resolve import redirects, resolve
from rxloom.operators.store import current_versions, dense_numbers, repoint_links
from rxloom.plans.ingest import CANDIDATE, label_reasons, parse_label_records, save_reasons, spl_reasons, transform_labels, transform_spl
from rxloom.schema import PREFIXES, TABLES
from rxloom.session import Scratch, at_once

PARTS = ["ingredient_versions", "manufacturer_versions", "product_versions", "product_ingredients", "warnings", "references", "aliases"]
LETTERS = "stage string, record_identifier string, raw_payload string, error_message string"


def empty_store(spark: SparkSession) -> dict[str, DataFrame]:
    return {t: spark.createDataFrame([], TABLES[t].replace("decimal(38,18)", "double")) for t in PARTS}


def _last(df: DataFrame, column: str) -> int:
    return df.agg(F.max(F.regexp_extract(column, r"-(\d+)$", 1).cast("long"))).first()[0] or 0


def _known(store: dict, kind: str) -> DataFrame:
    """entity_id, name, identifier of current active names, aliases and identifiers."""
    none = F.lit(None).cast("string")
    now = current_versions(store[f"{kind}_versions"], f"{kind}_id").where("status = 'active'").select(F.col(f"{kind}_id").alias("entity_id"), "name", none.alias("identifier"))
    aliases = store["aliases"].where(F.col("entity_type") == kind).select("entity_id", F.col("alias_text").alias("name"), none.alias("identifier"))
    refs = store["references"].where((F.col("entity_type") == kind) & F.col("reference_type").isin("unii", "duns")).select("entity_id", none.alias("name"), F.col("reference_value").alias("identifier"))
    return now.unionByName(aliases).unionByName(refs)


def _entities(spark: SparkSession, store: dict, kind: str, asked: DataFrame, stamp: list[Column]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The resolved rows of asked (ordinal, name, identifier), and the rows that resolution adds."""
    scratch = Scratch(spark)
    found, _ = scratch.keep(resolve(spark, asked, _known(store, kind), PREFIXES[kind], _last(store[f"{kind}_versions"], f"{kind}_id")))
    named, _ = scratch.keep(found.join(asked.select("ordinal", "name", "identifier"), "ordinal"))  # four tables are made of it
    made = named.where("outcome in ('created', 'review')")
    versions = made.select(F.xxhash64("entity_id", F.lit(1)).alias("id"), F.col("entity_id").alias(f"{kind}_id"), F.lit(1).alias("version_number"), "name", normalize_name(F.col("name")).alias("normalized_name"), F.lit("active").alias("status"), *stamp)
    told = named.where("identifier is not null and identifier <> '' and outcome in ('created', 'review', 'auto_merge')")
    refs = told.groupBy("entity_id", "identifier").agg(F.count("*")).select(F.xxhash64("entity_id", "identifier").alias("id"), F.lit(kind).alias("entity_type"), "entity_id", F.lit("unii" if kind == "ingredient" else "duns").alias("reference_type"), F.col("identifier").alias("reference_value"), *stamp)
    aliases = named.where("outcome = 'auto_merge'").select(F.xxhash64("entity_id", "name").alias("id"), F.lit(kind).alias("entity_type"), "entity_id", F.col("name").alias("alias_text"), normalize_name(F.col("name")).alias("normalized_alias_text"), F.col("score").alias("confidence"), *stamp)
    reviews = named.where("outcome = 'review'").select(F.xxhash64("matched_id", "entity_id").alias("id"), F.lit(kind).alias("entity_type"), F.col("matched_id").alias("candidate_a_id"), F.col("entity_id").alias("candidate_b_id"), F.col("score").alias("confidence_score"), F.lit("pending").alias("status"), stamp[1])
    return found.select("ordinal", "entity_id"), {f"{kind}_versions": versions, "references": refs, "aliases": aliases, "reviews": reviews}


def _letters(rows: DataFrame, stage: str, reason: str) -> DataFrame:
    return rows.where(F.col(reason).isNotNull() & (F.col(reason) != "")).select(F.lit(stage).alias("stage"), F.col("identifier").alias("record_identifier"), F.col("payload").alias("raw_payload"), F.col(reason).alias("error_message"))


def label_candidates(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates (CANDIDATE) of records (ordinal, raw), and dead letters of those that can't be read or lack something."""
    parsed = parse_label_records(records.select("ordinal", "raw", F.col("raw").alias("payload")))
    judged = parsed.withColumn("identifier", F.col("record_key")).withColumn("reason", F.when(F.col("parse_error").isNull(), label_reasons(F.col("brand_name"), F.col("generic_name"), F.col("substance_names"))))
    good = transform_labels(judged.where("parse_error is null and reason = ''"), "ordinal", "payload")
    return good, _letters(judged, "parse", "parse_error").unionByName(_letters(judged, "validation", "reason"))


def spl_candidates(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same of extracted documents (ordinal, xml and sources.spl.EXTRACTED); one that can't be read is named by its package."""
    judged = documents.withColumn("payload", encode_payload(F.col("package_name"), F.col("xml"))).withColumn("identifier", F.coalesce("metadata.set_id", "package_name")).withColumn(
        "reason", F.when(F.col("parse_error").isNull(), spl_reasons(F.col("metadata.product_name"), F.col("ingredients"), F.col("manufacturer.name")))
    )
    good = transform_spl(judged.where("parse_error is null and reason = ''"), "ordinal", "payload")
    return good, _letters(judged, "validation", "parse_error").unionByName(_letters(judged, "validation", "reason"))


def save_candidates(spark: SparkSession, candidates: DataFrame, store: dict[str, DataFrame], source_id: int, now: Column, forms: bool) -> dict[str, DataFrame]:
    """Rows to append for candidates (CANDIDATE), with 'outcomes' (ordinal, record_key, outcome) and 'dead_letters'.

    A product is found by its set id and is unchanged if its name, type, maker, ingredients with roles and
    warnings are, and its form too where ``forms`` says that the source has one; nulls are equal. Records
    of one key are saved in turn, each against the one before it. A record with a text that is too long
    for its column becomes a dead letter and adds nothing.
    """
    scratch = Scratch(spark)
    stamp = [F.lit(source_id).alias("source_id"), now.alias("created_at")]
    judged, _ = scratch.keep(candidates.select(*CANDIDATE).withColumn("identifier", F.col("record_key")).withColumn("reason", save_reasons()))
    rows = judged.where("reason = ''")
    listed = rows.select("record_key", F.col("ordinal").alias("record"), F.explode("ingredients").alias("i")).select("record_key", "record", "i.pos", "i.name", "i.unii", "i.role")
    links, _ = scratch.keep(dense_numbers(scratch.keep(listed)[0], ["record", "pos"], "ordinal"))
    named = rows.select("ordinal", F.col("manufacturer_name").alias("name"), F.col("manufacturer_duns").alias("identifier"))
    (ingredients, added), (makers, more) = at_once(
        lambda: _entities(spark, store, "ingredient", links.select("ordinal", "name", F.col("unii").alias("identifier")), stamp), lambda: _entities(spark, store, "manufacturer", named, stamp)
    )
    roles, _ = scratch.keep(links.join(ingredients, "ordinal").groupBy("record", "entity_id").agg(F.min_by("role", "pos").alias("role")))  # the first role holds
    sets = roles.groupBy(F.col("record").alias("ordinal")).agg(F.sort_array(F.collect_list(F.struct("entity_id", "role"))).alias("ings"))
    compared = ["name", "product_type", *(["dosage_form"] if forms else []), "manufacturer_id", "ings", "warns"]
    none = F.array().cast("array<struct<entity_id:string,role:string>>")
    incoming = rows.join(makers.withColumnRenamed("entity_id", "manufacturer_id"), "ordinal", "left").join(sets, "ordinal", "left").select(
        "ordinal", "record_key", "name", "product_type", "dosage_form", "manufacturer_id", F.coalesce("ings", none).alias("ings"), F.sort_array("warnings").alias("warns")
    ).withColumn("state", F.struct(*compared))
    refs = store["references"].where("entity_type = 'product' and reference_type = 'spl_set_id'").groupBy(F.col("reference_value").alias("record_key")).agg(F.min("entity_id").alias("product_id"))
    current = current_versions(store["product_versions"], "product_id")
    own = store["product_ingredients"].select(F.col("product_version_id").alias("id"), F.col("ingredient_id").alias("entity_id"), "role").distinct().groupBy("id").agg(F.sort_array(F.collect_list(F.struct("entity_id", "role"))).alias("ings"))
    said = store["warnings"].groupBy("product_id", "version_number").agg(F.sort_array(F.collect_list(F.struct("category", "text"))).alias("warns"))
    was = refs.join(current, "product_id").join(own, "id", "left").join(said, ["product_id", "version_number"], "left").withColumn("ings", F.coalesce("ings", none)).withColumn("warns", F.coalesce("warns", F.array().cast("array<struct<category:string,text:string>>")))
    stored = was.select("record_key", "product_id", F.col("version_number").alias("v"), F.struct(*compared).alias("stored"))
    turn = Window.partitionBy("record_key").orderBy("ordinal")
    before = F.lag(F.struct("state")).over(turn)
    compared_to = incoming.join(stored, "record_key", "left").withColumn("before", before).select(
        "*", F.when(F.col("before").isNull() & F.col("product_id").isNull(), "created").when(F.coalesce("before.state", "stored").eqNullSafe(F.col("state")), "unchanged").otherwise("updated").alias("outcome")
    )
    saved, _ = scratch.keep(compared_to.withColumn("version_number", (F.coalesce("v", F.lit(0)) + F.sum(F.when(F.col("outcome") == "unchanged", 0).otherwise(1)).over(turn)).cast("int")).drop("before", "stored", "state"))
    fresh = dense_numbers(saved.where("outcome = 'created'").select("record_key", F.col("ordinal").alias("first")), ["first"], "n", _last(store["product_versions"], "product_id")).select("record_key", F.format_string("PRD-%06d", "n").alias("new_id"))
    changed = saved.where("outcome <> 'unchanged'").join(fresh, "record_key", "left").withColumn("product_id", F.coalesce("product_id", "new_id")).withColumn("id", F.xxhash64("product_id", "version_number"))
    numbered, _ = scratch.keep(changed)
    return added | {
        "manufacturer_versions": more["manufacturer_versions"],
        "aliases": added["aliases"].unionByName(more["aliases"]),
        "reviews": added["reviews"].unionByName(more["reviews"]),
        "product_versions": numbered.select("id", "product_id", "version_number", "name", "product_type", "dosage_form", "manufacturer_id", F.lit("active").alias("status"), *stamp),
        "product_ingredients": numbered.select(F.col("id").alias("product_version_id"), F.inline("ings")).select("product_version_id", F.col("entity_id").alias("ingredient_id"), "role", F.lit(None).cast("double").alias("quantity"), F.lit(None).cast("string").alias("unit")),
        "warnings": numbered.select("product_id", "version_number", F.posexplode("warns").alias("pos", "w")).select(F.xxhash64("product_id", "version_number", "pos").alias("id"), "product_id", "w.category", "w.text", F.lit("active").alias("status"), "version_number", *stamp),
        "references": added["references"].unionByName(more["references"]).unionByName(numbered.where("outcome = 'created'").select(F.xxhash64("product_id", "record_key").alias("id"), F.lit("product").alias("entity_type"), F.col("product_id").alias("entity_id"), F.lit("spl_set_id").alias("reference_type"), F.col("record_key").alias("reference_value"), *stamp)),
        "outcomes": saved.select("ordinal", "record_key", "outcome"),
        "dead_letters": _letters(judged, "save", "reason"),
    }


def load_labels(spark: SparkSession, records: DataFrame, store: dict[str, DataFrame], source_id: int, now: Column) -> dict[str, DataFrame]:
    """Rows to append of a load of JSON records (ordinal, raw), with 'outcomes' and all 'dead_letters'."""
    good, letters = label_candidates(records)
    rows = save_candidates(spark, good, store, source_id, now, forms=False)
    return rows | {"dead_letters": letters.unionByName(rows["dead_letters"])}


def load_documents(spark: SparkSession, documents: DataFrame, store: dict[str, DataFrame], source_id: int, now: Column) -> dict[str, DataFrame]:
    """The same of extracted documents (ordinal, xml, EXTRACTED): makers also by DUNS, ingredients with roles, forms compared."""
    good, letters = spl_candidates(documents)
    rows = save_candidates(spark, good, store, source_id, now, forms=True)
    return rows | {"dead_letters": letters.unionByName(rows["dead_letters"])}


def appended(store: dict[str, DataFrame], rows: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The store after a load: only the new rows are written, the rest is read where it is."""
    given = [t for t in store if t in rows]
    kept = at_once(*(lambda t=t: Scratch(rows[t].sparkSession).keep(rows[t])[0] for t in given))
    return store | {t: store[t].unionByName(new) for t, new in zip(given, kept)}


def decide_reviews(spark: SparkSession, store: dict[str, DataFrame], reviews: DataFrame, decisions: DataFrame, source_id: int, now: Column) -> tuple[dict[str, DataFrame], DataFrame]:
    """The store and the reviews after decisions (id, decision, reviewed_by): 'approved' or 'rejected'.

    A review that isn't pending, or isn't there, raises ValueError. Approved ones take effect in order of
    their ids: candidate_b_id is merged into candidate_a_id, which always survives. The loser gets a
    superseded version and its name becomes an alias with the review's score; references, aliases,
    ingredient links and makers of products go to the survivor. Rejected ones change nothing else.
    """
    asked = decisions.join(reviews.drop("reviewed_by", "reviewed_at"), "id", "left")
    wrong = asked.where("status is null or status <> 'pending' or decision not in ('approved', 'rejected')").count()
    if wrong:
        raise ValueError(f"{wrong} of the reviews aren't pending")
    approved, _ = Scratch(spark).keep(asked.where("decision = 'approved'"))
    after = dict(store)
    for kind in ("ingredient", "manufacturer"):
        own = approved.where(F.col("entity_type") == kind)
        if not own.isEmpty():
            after = merge_entities(spark, after, kind, own, source_id, now)
    told = decisions.select("id", "decision", F.col("reviewed_by").alias("_by"))
    kept = reviews.columns
    decided = reviews.withColumn("reviewed_by", F.col("reviewed_by") if "reviewed_by" in kept else F.lit(None).cast("string")).withColumn("reviewed_at", F.col("reviewed_at") if "reviewed_at" in kept else F.lit(None).cast("timestamp"))
    marked = decided.join(told, "id", "left").withColumn("status", F.coalesce("decision", "status")).withColumn("reviewed_by", F.coalesce("_by", "reviewed_by")).withColumn("reviewed_at", F.when(F.col("decision").isNotNull(), now).otherwise(F.col("reviewed_at"))).drop("decision", "_by")
    return after, marked


def merge_entities(spark: SparkSession, store: dict[str, DataFrame], kind: str, approved: DataFrame, source_id: int, now: Column) -> dict[str, DataFrame]:
    """The store after approved reviews (id, candidate_a_id, candidate_b_id, confidence_score) of a kind, in order of id."""
    stamp = [F.lit(source_id).alias("source_id"), now.alias("created_at")]
    versions, entity = store[f"{kind}_versions"], f"{kind}_id"
    redirect, _ = Scratch(spark).keep(redirects(spark, approved))
    nth = F.row_number().over(Window.partitionBy("loser").orderBy("review"))
    merges = approved.select(F.col("id").alias("review"), F.col("candidate_b_id").alias("loser"), F.col("candidate_a_id").alias("into"), F.col("confidence_score").cast("double").alias("confidence")).withColumn("nth", nth)
    losers = current_versions(versions, entity).join(merges, F.col(entity) == F.col("loser"))
    ended = losers.select(F.xxhash64(entity, F.col("version_number") + F.col("nth")).alias("id"), entity, (F.col("version_number") + F.col("nth")).alias("version_number"), "name", "normalized_name", F.lit("superseded").alias("status"), *stamp)
    aimed = redirect.select(F.col("loser").alias("_l"), F.col("winner").alias("_w"))
    moved = lambda df, c, only: df.join(aimed, (F.col(c) == F.col("_l")) & only, "left").withColumn(c, F.coalesce("_w", c)).select(df.columns)
    everywhere, typed = F.lit(True), F.col("entity_type") == kind
    names = losers.select(F.xxhash64("into", "name", "review").alias("id"), F.lit(kind).alias("entity_type"), F.col("into").alias("entity_id"), F.col("name").alias("alias_text"), normalize_name(F.col("name")).alias("normalized_alias_text"), "confidence", F.lit(None).cast("int").alias("source_id"), stamp[1])
    after = store | {f"{kind}_versions": versions.unionByName(ended), "references": moved(store["references"], "entity_id", everywhere), "aliases": moved(store["aliases"].unionByName(names), "entity_id", typed)}
    if kind == "ingredient":
        return after | {"product_ingredients": repoint_links(store["product_ingredients"], redirect, "product_version_id", "ingredient_id")}
    return after | {"product_versions": moved(store["product_versions"], "manufacturer_id", everywhere)}
