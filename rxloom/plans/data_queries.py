"""Queries of the core data problems (nested records, units, history)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxloom.operators import history, nested, units
from rxloom.session import Scratch, read_table

PRODUCT_STATE = ["name", "product_type", "dosage_form", "manufacturer_id", "status"]
INGREDIENT_STATE = ["name", "status"]


def _node_tables(spark: SparkSession, sf_dir: str) -> str:
    """Where the four tables of nodes are: one pass over the records, written by tag."""
    at = f"{Scratch(spark).root}/nodes"
    nested.write_node_tables(nested.emit_nodes(read_table(spark, sf_dir, "label_records")), at)
    return at


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.node_tables(spark, _node_tables(spark, sf_dir))


def p1_package_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages with their product's code: two of the tables joined again."""
    at = _node_tables(spark, sf_dir)
    packages = nested.node_table(spark, at, "package")
    products = nested.node_table(spark, at, "product").select("record_id", F.col("node_path").alias("product_path"), F.col("code").alias("product_ndc"), "dosage_form")
    return packages.withColumn("product_path", F.substring_index("node_path", "/", 1)).join(products, ["record_id", "product_path"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    stated = units.spl_strengths(read_table(spark, sf_dir, "spl_documents")).unionByName(
        units.product_strengths(read_table(spark, sf_dir, "product_ingredients"))
    )
    return units.to_common_units(spark, stated, ["table_name", "row_key"]).distinct()


def _effective(spark: SparkSession, sf_dir: str, kind: str) -> tuple[DataFrame, list[str]]:
    state = PRODUCT_STATE if kind == "product" else INGREDIENT_STATE
    versions, runs = read_table(spark, sf_dir, f"{kind}_versions"), read_table(spark, sf_dir, "source_runs")
    kept, _ = Scratch(spark).keep(history.effective_versions(versions, runs, f"{kind}_id", state))
    return kept, state


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias(c)
    found = None
    for kind in ("product", "ingredient"):
        one = history.periods(*_effective(spark, sf_dir, kind)).select(F.lit(kind).alias("entity_kind"), "entity_id", "version_number", said("valid_from"), said("valid_to"))
        found = one if found is None else found.unionByName(one)
    return found


def p4_attribute_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias(c)
    return history.attribute_intervals(*_effective(spark, sf_dir, "product")).select("entity_id", "attribute", F.coalesce("value", F.lit("")).alias("value"), said("valid_from"), said("valid_to"))


QUERIES = {f.__name__: f for f in (p1_found, p1_package_tree, p2_found, p4_found, p4_attribute_intervals)}

_HELD = """
{k}_held as (
  select * from (
    select v.{k}_id as entity_id, v.version_number, v.created_at, {attrs},
      row_number() over (partition by v.{k}_id, v.version_number order by coalesce(r.ingested_at, timestamp '1900-01-01') desc, v.id desc) as rn
    from {k}_versions v left join (select id, max(ingested_at) as ingested_at from source_runs group by id) r on r.id = v.source_id
    where v.{k}_id is not null and v.version_number is not null)
  where rn = 1 and created_at is not null),
{k}_eff as (
  select * from (select *, row_number() over (partition by entity_id, created_at order by version_number desc) as rn2 from {k}_held) where rn2 = 1)"""


def _held(kind: str) -> str:
    return _HELD.format(k=kind, attrs=", ".join(PRODUCT_STATE if kind == "product" else INGREDIENT_STATE))


def _periods(kind: str) -> str:
    row = f"row({', '.join(PRODUCT_STATE if kind == 'product' else INGREDIENT_STATE)})"
    return f"""
select '{kind}' as entity_kind, entity_id, version_number, strftime(created_at, '%Y-%m-%d %H:%M:%S') as valid_from,
  coalesce(strftime(lead(created_at) over (partition by entity_id order by created_at), '%Y-%m-%d %H:%M:%S'), '') as valid_to
from (select *, {row} as now, lag({row}) over (partition by entity_id order by created_at) as was, row_number() over (partition by entity_id order by created_at) as nth from {kind}_eff)
where nth = 1 or now is distinct from was"""


def _intervals(attribute: str) -> str:
    return f"""
select entity_id, '{attribute}' as attribute, coalesce({attribute}, '') as value, strftime(created_at, '%Y-%m-%d %H:%M:%S') as valid_from,
  coalesce(strftime(lead(created_at) over (partition by entity_id order by created_at), '%Y-%m-%d %H:%M:%S'), '') as valid_to
from (select *, lag({attribute}) over (partition by entity_id order by created_at) as was, row_number() over (partition by entity_id order by created_at) as nth from product_eff)
where nth = 1 or {attribute} is distinct from was"""


# Of raw texts the records as JSON, also those that are JSON encoded as a JSON string; then each list level by level.
_RECORDS = """
with recursive r0 as (select distinct record_id, raw from label_records where raw is not null and record_id is not null),
r1 as (select record_id, case when json_valid(raw) then raw::json end as j from r0),
r2 as (select record_id, case when json_type(j) = 'VARCHAR' then case when json_valid(j->>'$') then (j->>'$')::json end else j end as j from r1),
r as (select record_id, j from r2 where json_type(j) = 'OBJECT'),
"""


def _list(c: str) -> str:
    """The entries of an array; a single value is an array of one, null none."""
    return f"case when ({c}) is null or json_type({c}) = 'NULL' then [] when json_type({c}) = 'ARRAY' then ({c})::json[] else [{c}] end"


def _entries(source: str, keys: str, held: str) -> str:
    """keys, i (position from 0) and x of the entries of a list in source."""
    return f"select {keys}, i - 1 as i, held[i] as x from (select {keys}, held, unnest(range(1, len(held) + 1)) as i from (select {keys}, {_list(held)} as held from {source}))"


_OBJECT = "json_type(x) = 'OBJECT' and len(json_keys(x)) > 0"
_TEXT = lambda path: f"coalesce(x->>'{path}', '')"
_P1_NODES = f"""{_RECORDS}
sub as (select record_id, i - 1 as i, names[i] as x, uniis[i] as u from (select record_id, names, uniis, unnest(range(1, len(names) + 1)) as i from (
  select record_id, {_list("j->'$.openfda.substance_name'")} as names, {_list("j->'$.openfda.unii'")} as uniis from r where json_type(j->'$.openfda') = 'OBJECT'))),
prod as (select * from ({_entries('r', 'record_id', "j->'$.products'")}) where {_OBJECT}),
ing as (select record_id, p, i, x from ({_entries("(select record_id, i as p, x as px from prod)", 'record_id, p', "px->'$.active_ingredients'")}) where {_OBJECT}),
pack as (
  select record_id, p::varchar || '/' || i as path, p::varchar as parent, x from ({_entries("(select record_id, i as p, x as px from prod)", 'record_id, p', "px->'$.packaging'")}) where {_OBJECT}
  union all
  select record_id, path || '/' || i as path, path as parent, x from ({_entries("(select record_id, path, x as px from pack)", 'record_id, path', "px->'$.contains'")}) where {_OBJECT}),
nodes as (
  select record_id, 'substance' as node_kind, i::varchar as node_path, '' as parent_path, coalesce(u->>'$', '') as code, null::varchar as product_path, x from sub where json_type(x) <> 'NULL' and (x->>'$') <> ''
  union all select record_id, 'product', i::varchar, '', {_TEXT('$.product_ndc')}, i::varchar, x from prod
  union all select record_id, 'ingredient', p || '/' || i, p::varchar, {_TEXT('$.unii')}, p::varchar, x from ing
  union all select record_id, 'package', path, parent, {_TEXT('$.package_ndc')}, split_part(path, '/', 1), x from pack)"""

ORACLE = {
    "p1_found": f"{_P1_NODES} select record_id, node_kind, node_path, parent_path, code from nodes",
    "p1_package_tree": f"""{_P1_NODES} select a.record_id, a.product_path, a.node_path, a.parent_path, a.code, a.x->>'$.description' as description, a.x->>'$.marketing_start' as marketing_start, b.code as product_ndc, b.x->>'$.dosage_form' as dosage_form
from nodes a join nodes b on b.record_id = a.record_id and b.node_kind = 'product' and b.node_path = a.product_path where a.node_kind = 'package'""",
    "p4_found": f"with {_held('product')}, {_held('ingredient')} {_periods('product')} union all {_periods('ingredient')}",
    "p4_attribute_intervals": f"with {_held('product')} " + " union all ".join(map(_intervals, PRODUCT_STATE)),
}
