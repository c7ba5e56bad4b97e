"""Records to canonical candidates: parse, validate, transform, dead letters, schema inference."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rxloom.schema import LIMITS

LABEL_RECORD = (
    "set_id string, id string, version string, effective_time string, active_ingredient array<string>, inactive_ingredient array<string>, warnings array<string>, boxed_warning array<string>, "
    "openfda struct<brand_name:array<string>,generic_name:array<string>,manufacturer_name:array<string>,substance_name:array<string>,unii:array<string>,product_type:array<string>,route:array<string>>"
)
_NO_TEXTS = "array<string>"


def parse_label_records(raw: DataFrame, column: str = "raw") -> DataFrame:
    """The fields of JSON label records, beside the input's columns but `column`; parse_error where a
    record has neither set_id nor id or is no JSON object (a dead letter, not the end of a run)."""
    r = F.from_json(F.col(column), LABEL_RECORD)
    first = lambda f: F.try_element_at(F.col(f"_r.openfda.{f}"), F.lit(1)).alias(f)
    many = lambda c: F.coalesce(F.col(c), F.array().cast(_NO_TEXTS))
    key = F.coalesce(F.nullif("_r.set_id", F.lit("")), F.nullif("_r.id", F.lit("")))
    rest = [c for c in raw.columns if c != column and not c.startswith("_r")]
    return raw.withColumn("_r", r).select(
        *(F.col(c) for c in rest), key.alias("record_key"), F.col("_r.version").alias("version"), F.col("_r.effective_time").alias("effective_time"),
        *map(first, ("brand_name", "generic_name", "manufacturer_name", "product_type")),
        *(many(f"_r.openfda.{f}").alias(f"{f}s") for f in ("substance_name", "unii", "route")), many("_r.warnings").alias("warnings"), many("_r.boxed_warning").alias("boxed_warnings"),
        F.when(key.isNull(), "record has neither set_id nor id").alias("parse_error"),
    )


def ingredient_links(names: Column, uniis: Column) -> Column:
    """struct(pos, name, unii) of each name with the unii at its place; a missing one is null."""
    return F.transform(names, lambda n, i: F.struct(i.alias("pos"), n.alias("name"), F.nullif(F.get(uniis, i), F.lit("")).alias("unii")))


#: Columns of a canonical candidate of either source; ingredients are array<struct<pos,name,unii,role>>.
CANDIDATE = ["ordinal", "record_key", "name", "product_type", "dosage_form", "manufacturer_name", "manufacturer_duns", "ingredients", "warnings", "payload"]


def transform_labels(parsed: DataFrame, *beside: str) -> DataFrame:
    """Candidates of parsed JSON records; their ingredients are active, their form and DUNS unknown."""
    name = F.coalesce(F.nullif("brand_name", F.lit("")), F.nullif("generic_name", F.lit("")))
    said = lambda c, kind: F.transform(c, lambda t: F.struct(F.lit(kind).alias("category"), t.alias("text")))
    active = F.transform(ingredient_links(F.col("substance_names"), F.col("uniis")), lambda i: F.struct(i["pos"].alias("pos"), i["name"].alias("name"), i["unii"].alias("unii"), F.lit("active").alias("role")))
    none = F.lit(None).cast("string")
    return parsed.select(
        *beside, "record_key", name.alias("name"), "product_type", none.alias("dosage_form"), "manufacturer_name", none.alias("manufacturer_duns"), active.alias("ingredients"),
        F.concat(said(F.col("boxed_warnings"), "boxed_warning"), said(F.col("warnings"), "precaution")).alias("warnings"),
    )


def transform_spl(extracted: DataFrame, *beside: str) -> DataFrame:
    """Candidates of extracted documents; quantities, administration text, version and time are left out."""
    links = F.transform("ingredients", lambda i, n: F.struct(n.alias("pos"), i["name"].alias("name"), F.nullif(i["unii"], F.lit("")).alias("unii"), i["role"].alias("role")))
    return extracted.select(
        *beside, F.col("metadata.set_id").alias("record_key"), F.col("metadata.product_name").alias("name"), F.col("metadata.product_type").alias("product_type"), F.col("dosage.dosage_form").alias("dosage_form"),
        F.col("manufacturer.name").alias("manufacturer_name"), F.nullif("manufacturer.duns_number", F.lit("")).alias("manufacturer_duns"), links.alias("ingredients"),
        F.coalesce("warnings", F.array().cast("array<struct<category:string,text:string>>")).alias("warnings"),
    )


def reasons(*rules: tuple[Column, str]) -> Column:
    """The texts of the rules that don't hold, joined by '; '; empty if all do."""
    return F.concat_ws("; ", *(F.when(~F.coalesce(ok, F.lit(False)), F.lit(said)) for ok, said in rules))


def label_reasons(brand: Column, generic: Column, substances: Column) -> Column:
    named = (F.coalesce(brand, F.lit("")) != "") | (F.coalesce(generic, F.lit("")) != "")
    return reasons((named, "no brand or generic name"), (F.size(substances) > 0, "no substance name"))


def spl_reasons(product: Column, ingredients: Column, manufacturer: Column) -> Column:
    return reasons((F.coalesce(product, F.lit("")) != "", "no product name"), (F.size(ingredients) > 0, "no ingredients"), (F.coalesce(manufacturer, F.lit("")) != "", "no manufacturer"))


def save_reasons() -> Column:
    """Why a candidate can't be saved: the columns whose limits it exceeds; empty if none."""
    fits = lambda c, most: F.coalesce(F.length(c), F.lit(0)) <= most
    all_fit = lambda part, most: ~F.exists("ingredients", lambda i: F.coalesce(F.length(i[part]) > most, F.lit(False)))
    rules = [(fits(F.col(c), LIMITS[c]), f"{c} longer than {LIMITS[c]}") for c in ("name", "product_type", "dosage_form")]
    rules += [(fits(F.col("manufacturer_name"), LIMITS["name"]), f"manufacturer_name longer than {LIMITS['name']}"), (all_fit("name", LIMITS["name"]), f"ingredient name longer than {LIMITS['name']}")]
    rules += [(fits(F.col(c), LIMITS["reference_value"]), f"{c} longer than {LIMITS['reference_value']}") for c in ("record_key", "manufacturer_duns")]
    return reasons(*rules, (all_fit("unii", LIMITS["reference_value"]), f"unii longer than {LIMITS['reference_value']}"))


def dead_letters(rows: DataFrame, stage: str, reason: str, identifier: str, payload: Column) -> DataFrame:
    """The rows with a reason, as dead letters."""
    return rows.where((F.col(reason).isNotNull()) & (F.col(reason) != "")).select(F.lit(stage).alias("stage"), F.col(identifier).cast("string").alias("record_identifier"), payload.alias("raw_payload"), F.col(reason).alias("error_message"))


def manifest_partitions(manifest: DataFrame, category: str = "drug", endpoint: str = "label") -> DataFrame:
    """file, display_name, size_mb, records of a bulk manifest (one JSON document)."""
    return manifest.select(F.explode(f"results.{category}.{endpoint}.partitions").alias("p")).select("p.file", "p.display_name", F.col("p.size_mb").cast("double").alias("size_mb"), F.col("p.records").cast("int").alias("records"))


#: Folders by the beginnings of file names.
BUCKETS = [("drug-label", "openfda/drug/label"), ("drug-enforcement", "openfda/drug/enforcement"), ("drug-ndc", "openfda/drug/ndc"), ("dm_spl_release_human_rx", "dailymed/full_release/human_rx"),
           ("dm_spl_release_human_otc", "dailymed/full_release/human_otc"), ("dm_spl_release_animal", "dailymed/full_release/animal"), ("dm_spl_release_homeopathic", "dailymed/full_release/homeopathic")]


def archive_urls(text: Column) -> Column:
    """The distinct addresses of ZIP files in a text, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"https://\S+?\.zip"), F.lit(0)))


def bucket_of(url: Column) -> Column:
    file = F.element_at(F.split(url, "/"), -1)
    chosen = F.lit("other")
    for start, folder in reversed(BUCKETS):
        chosen = F.when(file.startswith(start), folder).otherwise(chosen)
    return chosen


def _type_paths(value, path: str, out: set) -> None:
    below = [(value, path)]
    while below:
        v, p = below.pop()
        kind = "null" if v is None else "boolean" if isinstance(v, bool) else "integer" if isinstance(v, int) else "number" if isinstance(v, float) else {str: "string", list: "array", dict: "object"}[type(v)]
        out.add((p, kind))
        if isinstance(v, dict):
            below += [(x, f"{p}.{k}") for k, x in v.items()]
        elif isinstance(v, list):
            below += [(x, f"{p}[]") for x in v]


def _paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from rxloom.operators.nested import parse_record

    found: set = set()
    for batch in batches:
        for raw in batch.iloc[:, 0]:
            record = parse_record(raw)
            if record is not None:
                _type_paths(record, "$", found)
    yield pd.DataFrame(sorted(found), columns=["path", "type"])


def infer_schema(records: DataFrame, column: str = "raw") -> DataFrame:
    """path, types: the set of JSON types seen at each path; conflicting ones stay side by side.

    Each partition gives its distinct (path, type) pairs, so only those are shuffled."""
    pairs = records.select(column).mapInPandas(_paths, "path string, type string").distinct()
    return pairs.groupBy("path").agg(F.array_join(F.sort_array(F.collect_set("type")), ",").alias("types"))
