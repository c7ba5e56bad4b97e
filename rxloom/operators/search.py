"""Ranked search over ingredients, products, warnings and recalls, and evidence retrieval.

Each search is one plan: match and rank, top k, then the joins that fill in what belongs to the k
hits; the k rows are the broadcast side, so no table is shuffled for them. Matching reads postings made
when a table is written (``write_postings``), sorted by lexeme, so that a query reads only its lexemes'.

By default: warnings of superseded product versions and recalls of any status are found, and an alias
finds an entity of any status; strict=True keeps to current and active ones. Equal ranks are
ordered by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rxloom.functions import fts
from rxloom.functions.text import dedup_key, join_capped, label_url, truncate
from rxloom.operators.store import current_versions

OVER_FETCH = 5
TYPES = ["ingredient", "product", "warning", "recall"]


#: The searched tables: their key and their text.
SEARCHED = {"ingredient_versions": ("id", "name"), "product_versions": ("id", "name"), "warnings": ("id", "text"), "recalls": ("id", "reason"), "aliases": ("id", "alias_text")}


def write_postings(store: dict, path: str) -> None:
    """One folder of postings for each searched table, in ranges of lexemes."""
    for t, (key, text) in SEARCHED.items():
        if t in store:
            fts.postings(store[t], key, text).repartitionByRange("lexeme").sortWithinPartitions("lexeme").write.mode("overwrite").parquet(f"{path}/{t}")


def with_postings(spark: SparkSession, store: dict, path: str) -> dict:
    """The store with the written postings of its tables, as '<table>_postings'."""
    return store | {f"{t}_postings": spark.read.parquet(f"{path}/{t}") for t in SEARCHED if t in store}


def provenance(df: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds source: system, endpoint, and when it was read, as text."""
    said = F.struct("source_system", "endpoint_or_document_type", F.date_format("ingested_at", "yyyy-MM-dd'T'HH:mm:ss").alias("ingested_at"))
    return df.join(sources.select(F.col("id").alias("source_id"), said.alias("source")), "source_id").drop("source_id")


def _query(text: str, any_word: bool) -> tuple:
    """(terms, match, rank) of a query text."""
    groups = fts.any_groups(text)
    terms = list(dict.fromkeys(t for g in groups for t in g))
    if any_word and groups:
        return terms, (lambda v: fts.matches_any(v, groups)), (lambda v: fts.rank_any(v, terms))
    terms = fts.all_terms(text)
    return terms, (lambda v: fts.matches_all(v, terms)), (lambda v: fts.rank_all(v, terms))


def _ranked(store: dict, table: str, query: str, any_word: bool) -> DataFrame:
    """id, rank of the rows of a table that match."""
    terms, match, rank = _query(query, any_word)
    vector = F.col("search_vector")
    return fts.vectors_from(store[f"{table}_postings"], terms).where(match(vector)).select("id", rank(vector).alias("rank"))


def _hits(ranked: DataFrame, df: DataFrame, limit: int, key: str) -> DataFrame:
    """The first `limit` matching rows of df; matches are found before anything else is read."""
    return df.join(ranked, "id").orderBy(F.desc("rank"), key).limit(limit)


def current_links(product_versions: DataFrame, product_ingredients: DataFrame) -> DataFrame:
    """product_id, ingredient_id, role of products' current versions."""
    now = current_versions(product_versions, "product_id").select("product_id", F.col("id").alias("product_version_id"))
    return product_ingredients.select("product_version_id", "ingredient_id", "role").distinct().join(now, "product_version_id").select("product_id", "ingredient_id", "role")


def search_ingredients(store: dict, query: str, limit: int = 20, any_word: bool = False, strict: bool = False) -> DataFrame:
    """id, name, rank, product_ids, source. The best rank of name and aliases; the limit comes before
    entities without a current version are dropped. Without store['aliases'] only names are searched."""
    now = current_versions(store["ingredient_versions"], "ingredient_id")
    found = now.where("status = 'active'").join(_ranked(store, "ingredient_versions", query, any_word), "id").select("ingredient_id", "rank")
    if "aliases" in store:
        own = store["aliases"].where("entity_type = 'ingredient'").join(_ranked(store, "aliases", query, any_word), "id").select(F.col("entity_id").alias("ingredient_id"), "rank")
        found = found.unionByName(own.join(now.where("status = 'active'").select("ingredient_id"), "ingredient_id", "left_semi") if strict else own)
    best = found.groupBy("ingredient_id").agg(F.max("rank").alias("rank")).orderBy(F.desc("rank"), "ingredient_id").limit(limit)
    named = now.join(F.broadcast(best), "ingredient_id").select("ingredient_id", "name", "rank", "source_id")
    links = current_links(store["product_versions"], store["product_ingredients"]).join(F.broadcast(best.select("ingredient_id")), "ingredient_id")
    products = links.groupBy("ingredient_id").agg(F.sort_array(F.collect_set("product_id")).alias("product_ids"))
    whole = named.join(products, "ingredient_id", "left").withColumn("product_ids", F.coalesce("product_ids", F.array().cast("array<string>")))
    return provenance(whole, store["sources"]).withColumnRenamed("ingredient_id", "id")


def nest_products(store: dict, hits: DataFrame, bounded: bool = True) -> DataFrame:
    """Adds manufacturer, ingredients, warnings, recalls, external_url to hits (product_id, id,
    version_number, manufacturer_id, source_id ...). A bounded number of hits is broadcast."""
    few = F.broadcast(hits) if bounded else hits
    makers = current_versions(store["manufacturer_versions"], "manufacturer_id").select("manufacturer_id", F.struct(F.col("manufacturer_id").alias("id"), "name").alias("manufacturer"))
    names = current_versions(store["ingredient_versions"], "ingredient_id").select("ingredient_id", F.col("name").alias("_name"))
    links = store["product_ingredients"].select("product_version_id", "ingredient_id", "role").distinct().join(few.select(F.col("id").alias("product_version_id"), "product_id"), "product_version_id")
    ingredients = links.join(names, "ingredient_id").groupBy("product_id").agg(F.sort_array(F.collect_list(F.struct(F.col("ingredient_id").alias("id"), F.col("_name").alias("name"), "role"))).alias("ingredients"))
    said = store["warnings"].where("status = 'active'").join(few.select("product_id", "version_number"), ["product_id", "version_number"]).dropDuplicates(["id"])
    warnings = said.groupBy("product_id").agg(F.sort_array(F.collect_list(F.struct("category", "text"))).alias("warnings"))
    whole = hits.join(makers, "manufacturer_id", "left").join(ingredients, "product_id", "left").join(warnings, "product_id", "left")
    if "recalls" in store:
        recalled = store["recalls"].join(few.select("product_id"), "product_id").groupBy("product_id").agg(F.sort_array(F.collect_list(F.struct("id", "reason", "classification", "status"))).alias("recalls"))
        whole = whole.join(recalled, "product_id", "left")
    whole = whole.join(product_urls(store, few.select("product_id")), "product_id", "left")
    return provenance(whole, store["sources"])


def product_urls(store: dict, products: DataFrame) -> DataFrame:
    if "references" not in store:
        return products.distinct().withColumn("external_url", F.lit(None).cast("string"))
    refs = store["references"].where("entity_type = 'product' and reference_type = 'spl_set_id'")
    return refs.join(products.distinct(), refs.entity_id == products.product_id).groupBy("product_id").agg(label_url(F.min("reference_value")).alias("external_url"))


def search_products(store: dict, query: str, limit: int = 20, any_word: bool = False) -> DataFrame:
    now = current_versions(store["product_versions"], "product_id").where("status = 'active'")
    return nest_products(store, _hits(_ranked(store, "product_versions", query, any_word), now, limit, "product_id"))


def search_warnings(store: dict, query: str, limit: int = 20, any_word: bool = False, strict: bool = False) -> DataFrame:
    """id, category, text, rank, product, source, external_url; a product without a name is '?'."""
    now = current_versions(store["product_versions"], "product_id").select("product_id", "name", F.col("version_number").alias("_v"))
    said = store["warnings"].where("status = 'active'").select("id", "product_id", "category", "text", "version_number", "source_id")
    if strict:
        said = said.join(now, "product_id").where("version_number = _v").drop("name", "_v")
    matching = said.join(_ranked(store, "warnings", query, any_word), "id").dropDuplicates(["id"])
    hits = matching.orderBy(F.desc("rank"), "id").limit(limit)
    whole = hits.join(now.join(F.broadcast(hits.select("product_id").distinct()), "product_id"), "product_id", "left").join(product_urls(store, hits.select("product_id")), "product_id", "left")
    product = F.struct(F.col("product_id").alias("id"), F.coalesce("name", F.lit("?")).alias("name"))
    return provenance(whole.select("id", "category", "text", "rank", product.alias("product"), "external_url", "source_id"), store["sources"])


def search_recalls(store: dict, query: str, limit: int = 20, any_word: bool = False, strict: bool = False) -> DataFrame:
    """id, reason, classification, status, rank, product, manufacturer, source, external_url."""
    held = store["recalls"].where("status = 'ongoing'") if strict else store["recalls"]
    hits = _hits(_ranked(store, "recalls", query, any_word), held, limit, "id")
    products = current_versions(store["product_versions"], "product_id").select("product_id", F.struct(F.col("product_id").alias("id"), "name").alias("product"))
    makers = current_versions(store["manufacturer_versions"], "manufacturer_id").select("manufacturer_id", F.struct(F.col("manufacturer_id").alias("id"), "name").alias("manufacturer"))
    whole = hits.join(products, "product_id", "left").join(makers, "manufacturer_id", "left").join(product_urls(store, hits.select("product_id").where("product_id is not null")), "product_id", "left")
    url = F.when(F.col("product").isNotNull(), F.col("external_url"))
    return provenance(whole.select("id", "reason", "classification", "status", "rank", "product", "manufacturer", url.alias("external_url"), "source_id"), store["sources"])


def alias_confidence(store: dict, query: str, any_word: bool = False) -> DataFrame:
    held = store["aliases"].where("entity_type = 'ingredient'").join(_ranked(store, "aliases", query, any_word), "id")
    return held.groupBy(F.col("entity_id").alias("id")).agg(F.max("confidence").alias("entity_resolution_confidence"))


# -- evidence -----------------------------------------------------------------------------------------


def product_content(name: Column, ingredients: Column, warnings: Column, recalls: Column) -> Column:
    """Name, ingredients (8 at most named), two warnings and two recalls of 220 characters; 900 in all."""
    few = lambda items, part: F.transform(F.slice(items, 1, 2), part)
    said = F.concat_ws(
        " | ", name,
        F.when(F.size(ingredients) > 0, F.concat(F.lit("Ingredients: "), join_capped(F.transform(ingredients, lambda i: i["name"])))),
        F.when(F.size(warnings) > 0, F.concat(F.lit("Warnings: "), F.array_join(few(warnings, lambda w: truncate(F.concat(w["category"], F.lit(": "), w["text"]), 220)), "; "))),
        F.when(F.size(recalls) > 0, F.concat(F.lit("Recalls: "), F.array_join(few(recalls, lambda r: truncate(r["reason"], 220)), "; "))),
    )
    return truncate(said, 900)


def warning_content(product: Column, category: Column, text: Column) -> Column:
    return F.concat_ws(" | ", product, F.concat(category, F.lit(": "), truncate(text, 900)))


def recall_content(reason: Column, classification: Column, status: Column, product: Column) -> Column:
    return F.concat_ws(" | ", truncate(reason, 900), classification, status, product)


def merge_evidence(found: dict[str, DataFrame], limit: int) -> DataFrame:
    """One numbered list of hits (entity_id, content, rank ...) of several types: highest rank first,
    equal ranks by type and id, repeated contents once, the first `limit`. Inputs are top-k lists."""
    whole = None
    for n, t in enumerate(TYPES):
        if t in found:
            one = found[t].select(F.lit(t).alias("entity_type"), F.lit(n).alias("_t"), F.col("entity_id").cast("string").alias("entity_id"), "content", F.col("rank").cast("double").alias("rank"))
            whole = one if whole is None else whole.unionByName(one)
    keyed = whole.withColumn("_k", dedup_key(F.col("entity_type"), F.col("content")))
    first = keyed.withColumn("_r", F.row_number().over(Window.partitionBy("_k").orderBy(F.desc("rank"), "_t", "entity_id"))).where("_r = 1")
    top = first.orderBy(F.desc("rank"), "_t", "entity_id").limit(limit)
    number = F.row_number().over(Window.orderBy(F.desc("rank"), "_t", "entity_id"))  # `limit` rows
    return top.select(number.alias("number"), "entity_type", "entity_id", "content", F.col("rank").alias("retrieval_confidence"))


def gather(store: dict, query: str, limit: int, any_word: bool) -> dict[str, DataFrame]:
    most = limit * OVER_FETCH
    none = F.array().cast("array<struct<id:bigint,reason:string,classification:string,status:string>>")
    found = {
        "ingredient": search_ingredients(store, query, most, any_word).select(F.col("id").alias("entity_id"), F.col("name").alias("content"), "rank"),
        "product": search_products(store, query, most, any_word).select(F.col("product_id").alias("entity_id"), product_content(F.col("name"), F.col("ingredients"), F.col("warnings"), F.col("recalls") if "recalls" in store else none).alias("content"), "rank"),
        "warning": search_warnings(store, query, most, any_word).select(F.col("id").alias("entity_id"), warning_content(F.col("product.name"), F.col("category"), F.col("text")).alias("content"), "rank"),
    }
    if "recalls" in store:
        found["recall"] = search_recalls(store, query, most, any_word).select(F.col("id").alias("entity_id"), recall_content(F.col("reason"), F.col("classification"), F.col("status"), F.col("product.name")).alias("content"), "rank")
    return found


def retrieve(store: dict, query: str, limit: int = 10) -> DataFrame:
    """Evidence for a query: all its words must match; only if nothing does, any may."""
    merged = merge_evidence(gather(store, query, limit, False), limit)
    if merged.isEmpty():
        merged = merge_evidence(gather(store, query, limit, True), limit)
    if "aliases" not in store:
        return merged.withColumn("entity_resolution_confidence", F.lit(None).cast("double"))
    sure = alias_confidence(store, query).withColumnRenamed("id", "entity_id").withColumn("entity_type", F.lit("ingredient"))
    return merged.join(F.broadcast(sure), ["entity_type", "entity_id"], "left").orderBy("number")
