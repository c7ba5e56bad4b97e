"""Queries of the integration and search operators on the given tables, with equal SQL.

The tables play these parts: source_runs the runs and their logs (records of a run are the product
versions that name it), blank label_warnings the dead letters, older ingredient names the aliases,
documents of the source recall_notice the recalls. "Now" is a fixed instant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rxloom.functions import fts, text
from rxloom.operators import evidence, observability, resolve, search, store
from rxloom.plans import ingest
from rxloom.session import Scratch, exists, read_table

NOW = "timestamp '2024-06-01 00:00:00'"
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_SPACE = r"[\s\x0B\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _norm(c: str) -> str:
    bare = rf"lower(regexp_replace({c}, '^{_SPACE}+|{_SPACE}+$', '', 'g'))"
    return rf"regexp_replace(translate({bare}, '‐‑‒–—', '-----'), '{_SPACE}+', ' ', 'g')"


def _grams(c: str) -> str:
    words = rf"list_filter(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
    return f"list_distinct(flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"


def _jaccard(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"coalesce({both}::double / nullif(len({a}) + len({b}) - {both}, 0), 0.0)"


def _now(kind: str, columns: str) -> str:
    """The current versions of a kind of entity."""
    return f"(select {columns} from (select *, row_number() over (partition by {kind}_id order by version_number desc, id desc) as rn from (select distinct * from {kind}_versions)) where rn = 1)"


def _versions(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return read_table(spark, sf_dir, f"{kind}_versions").distinct()


# -- names ------------------------------------------------------------------------------------------


@query(f"select id, {_norm('name')} as normalized from (select distinct id, name from manufacturer_versions)")
def norm_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "manufacturer_versions").select("id", "name").distinct()
    return rows.select("id", text.normalize_name(F.col("name")).alias("normalized"))


@query(f"""
with v as (select distinct ingredient_id, version_number, id, name from ingredient_versions where name is not null),
p as (select a.id as id_a, b.id as id_b, {_grams('a.name')} as ga, {_grams('b.name')} as gb from v a join v b on a.ingredient_id = b.ingredient_id and b.version_number = a.version_number + 1),
s as (select id_a, id_b, {_jaccard('ga', 'gb')} as score from p)
select id_a, id_b, round(score, 6) as score, case when score >= 0.92 then 'auto_merge' when score >= 0.75 then 'review' else 'no_match' end as tier from s""")
def trigram_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read_table(spark, sf_dir, "ingredient_versions").select("ingredient_id", "version_number", "id", "name").where("name is not null").distinct()
    a, b = v.alias("a"), v.alias("b")
    pairs = a.join(b, (F.col("a.ingredient_id") == F.col("b.ingredient_id")) & (F.col("b.version_number") == F.col("a.version_number") + 1))
    scored = pairs.select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), text.similarity(F.col("a.name"), F.col("b.name")).alias("score"))
    return scored.select("id_a", "id_b", F.round("score", 6).alias("score"), text.tier(F.col("score")).alias("tier"))


_NAMES = f"select distinct {_norm('name')} as name from ingredient_versions where name is not null"


@query(f"""
with n as ({_NAMES}), g as (select name, {_grams('name')} as g from n), p as (select a.name as a, b.name as b, a.g as ga, b.g as gb from g a join g b on a.name < b.name)
select a, b, round({_jaccard('ga', 'gb')}, 6) as score from p where {_jaccard('ga', 'gb')} >= 0.75""")
def trigram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = read_table(spark, sf_dir, "ingredient_versions").where("name is not null").select(text.normalize_name(F.col("name")).alias("name"))
    return resolve.similarity_join(names).select("a", "b", F.round("score", 6).alias("score"))


@query(f"""
with old as (select distinct ingredient_id as entity_id, {_norm('name')} as known from ingredient_versions where version_number = 1 and {_norm('name')} <> ''),
new as (select distinct {_norm('name')} as name from ingredient_versions where version_number > 1 and {_norm('name')} <> ''),
p as (select name, entity_id, case when name = known then 1 else 0 end as exact, {_jaccard(_grams('name'), _grams('known'))} as score from new join old on true),
m as (select * from (select *, row_number() over (partition by name order by exact desc, score desc, entity_id) as rn from p where exact = 1 or score >= 0.75) where rn = 1)
select n.name, m.entity_id, round(case when m.exact = 1 then 1.0 else m.score end, 6) as score,
  case when m.name is null then 'no_match' when m.exact = 1 then 'exact' when m.score >= 0.92 then 'auto_merge' else 'review' end as decision
from new n left join m on m.name = n.name""")
def exact_then_fuzzy_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read_table(spark, sf_dir, "ingredient_versions")
    return resolve.best_matches(v.where("version_number > 1"), v.where("version_number = 1").select(F.col("ingredient_id").alias("entity_id"), "name"))


# -- versioned store -----------------------------------------------------------------------------------


@query(f"select product_id, id, version_number, name, status from {_now('product', '*')}")
def current_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.current_versions(_versions(spark, sf_dir, "product"), "product_id").select("product_id", "id", "version_number", "name", "status")


@query(f"select product_id, name from {_now('product', '*')} where status = 'active'")
def soft_delete_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.active_only(store.current_versions(_versions(spark, sf_dir, "product"), "product_id")).select("product_id", "name")


@query("select id, version_number, name, status from (select distinct * from product_versions) where product_id = (select min(product_id) from product_versions)")
def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _versions(spark, sf_dir, "product")
    first = v.agg(F.min("product_id")).first()[0]
    return store.history_of(v, "product_id", first).select("id", "version_number", "name", "status")


_ALTERED = """
with v as (select distinct * from product_versions),
top as (select product_id, max(version_number) as top from v group by product_id),
ing as (select product_version_id, list_sort(list(distinct ingredient_id || ':' || role)) as ings from product_ingredients group by product_version_id),
warn as (select product_id, version_number, string_agg(md5(concat_ws('|', category, text)), ',' order by md5(concat_ws('|', category, text))) as warns from (select distinct id, product_id, version_number, category, text from label_warnings) group by all),
cand as (select v.*, i.ings, w.warns, t.top, row_number() over (partition by v.product_id, v.version_number order by v.id desc) as rn from v join top t on t.product_id = v.product_id left join ing i on i.product_version_id = v.id left join warn w on w.product_id = v.product_id and w.version_number = v.version_number),
"""


@query(_ALTERED + """
inc as (select * from cand where version_number = top and rn = 1), old as (select * from (select *, row_number() over (partition by product_id order by version_number desc) as nth from cand where version_number < top and rn = 1) where nth = 1)
select i.product_id, case when o.product_id is null then 'created'
  when o.name is not distinct from i.name and o.product_type is not distinct from i.product_type and o.manufacturer_id is not distinct from i.manufacturer_id and o.ings is not distinct from i.ings and o.warns is not distinct from i.warns then 'unchanged' else 'updated' end as outcome
from inc i left join old o on o.product_id = i.product_id""")
def upsert_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest version of each product as if it came in, against the version before it."""
    v = _versions(spark, sf_dir, "product")
    links = read_table(spark, sf_dir, "product_ingredients").groupBy(F.col("product_version_id").alias("id")).agg(F.sort_array(F.collect_set(F.concat("ingredient_id", F.lit(":"), "role"))).alias("ings"))
    said = read_table(spark, sf_dir, "label_warnings").select("id", "product_id", "version_number", "category", "text").distinct()
    warns = said.groupBy("product_id", "version_number").agg(F.array_join(F.sort_array(F.collect_list(F.md5(F.concat_ws("|", "category", "text")))), ",").alias("warns"))
    one = store.first_by_key(v.withColumn("_o", -F.col("id")), ["product_id", "version_number"], ["_o"]).join(links, "id", "left").join(warns, ["product_id", "version_number"], "left")
    incoming = store.current_versions(one, "product_id")
    before = one.join(incoming.select("product_id", F.col("version_number").alias("_top")), "product_id").where("version_number < _top").drop("_top")
    return store.upsert_outcomes(incoming, store.current_versions(before, "product_id"), "product_id", ["name", "product_type", "manufacturer_id", "ings", "warns"])


@query("""select product_version_id, ingredient_id, role, unit from (select *, row_number() over (partition by product_version_id, ingredient_id order by role nulls first, quantity nulls first, unit nulls first) as rn from product_ingredients) where rn = 1""")
def first_role_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "product_ingredients").withColumn("_role", F.col("role"))
    return store.first_by_key(rows, ["product_version_id", "ingredient_id"], ["_role", "quantity", "unit"]).select("product_version_id", "ingredient_id", "role", "unit")


@query(f"""
with redirect as (select id as loser, min(id) over (partition by name) as winner from (select ingredient_id as id, {_norm('name')} as name from {_now('ingredient', '*')}) where name is not null),
l as (select p.product_version_id, p.ingredient_id as target, p.role from product_ingredients p),
m as (select l.product_version_id, coalesce(r.winner, l.target) as ingredient_id, l.role, r.winner is not null as moved, l.target as t from l left join (select * from redirect where loser <> winner) r on r.loser = l.target)
select product_version_id, ingredient_id, role from (select *, row_number() over (partition by product_version_id, ingredient_id order by moved, t, role nulls first) as rn from m) where rn = 1""")
def repoint_no_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingredients of one name are merged into the lowest id; links follow without repeating."""
    now = store.current_versions(_versions(spark, sf_dir, "ingredient"), "ingredient_id").select("ingredient_id", text.normalize_name(F.col("name")).alias("n")).where("n is not null")
    lowest = now.groupBy("n").agg(F.min("ingredient_id").alias("winner"))
    redirect = now.join(lowest, "n").where("ingredient_id <> winner").select(F.col("ingredient_id").alias("loser"), "winner")
    return store.repoint_links(read_table(spark, sf_dir, "product_ingredients").select("product_version_id", "ingredient_id", "role"), redirect, "product_version_id", "ingredient_id")


@query("select 'ING-' || lpad((row_number() over (order by name))::varchar, 6, '0') as entity_id, 1 as version_number, name, 'active' as status from (select distinct name from ingredient_versions where name is not null)")
def new_entity_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = read_table(spark, sf_dir, "ingredient_versions").select("name").where("name is not null").distinct()
    kept, _ = Scratch(spark).keep(names)
    return store.create_entities(kept, ["name"], "ING")


@query("""with top as (select product_id, max(version_number) as top from product_versions group by product_id)
select t.product_id, t.top + row_number() over (partition by t.product_id order by c.name) as version_number, c.name from top t
join (select distinct product_id, name from product_versions where status = 'retracted') c on c.product_id = t.product_id""")
def next_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read_table(spark, sf_dir, "product_versions")
    return store.add_versions(v, "product_id", v.where("status = 'retracted'").select("product_id", "name").distinct()).select("product_id", F.col("version_number").cast("long").alias("version_number"), "name")


# -- joins ------------------------------------------------------------------------------------------------


_INDEXES: dict = {}


def _store(spark: SparkSession, sf_dir: str, searched: bool = False) -> dict:
    """The tables; with ``searched`` also their postings, which an application writes once for each folder."""
    held = {f"{k}_versions": _versions(spark, sf_dir, k) for k in ("ingredient", "manufacturer", "product")}
    held["warnings"] = read_table(spark, sf_dir, "label_warnings")
    held["product_ingredients"] = read_table(spark, sf_dir, "product_ingredients")
    held["sources"] = F.broadcast(read_table(spark, sf_dir, "source_runs"))
    notices = read_table(spark, sf_dir, "documents").where("source = 'recall_notice' and text is not null")
    none = F.lit(None).cast("string")
    held["recalls"] = notices.select(F.col("doc_id").alias("id"), F.format_string("PRD-%09d", F.col("doc_id")).alias("product_id"), none.alias("manufacturer_id"), F.col("text").alias("reason"), F.lit("class_ii").alias("classification"),
                                     F.when(F.col("doc_id") % 3 == 0, "terminated").otherwise("ongoing").alias("status"), (F.col("doc_id") % 600 + 1).cast("int").alias("source_id"))
    held["aliases"] = held["ingredient_versions"].where("version_number = 1").select("id", F.lit("ingredient").alias("entity_type"), F.col("ingredient_id").alias("entity_id"), F.col("name").alias("alias_text"), F.lit(0.9).alias("confidence"))
    if searched:
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in _INDEXES or not exists(spark, _INDEXES[key]):
            at = f"{Scratch(spark).root}/postings"
            search.write_postings(held, at)
            _INDEXES[key] = at
        held = search.with_postings(spark, held, _INDEXES[key])
    return held


@query(f"""
with p as {_now('product', 'product_id, id, version_number, name, manufacturer_id, source_id')}, m as {_now('manufacturer', 'manufacturer_id, name')}, i as {_now('ingredient', 'ingredient_id, name')},
links as (select distinct product_version_id, ingredient_id, role from product_ingredients),
ings as (select p.product_id, string_agg(concat_ws(':', i.ingredient_id, i.name, l.role), '; ' order by i.ingredient_id, i.name nulls first, l.role nulls first) as ingredients from p join links l on l.product_version_id = p.id join i on i.ingredient_id = l.ingredient_id group by p.product_id),
said as (select p.product_id, md5(concat_ws('|', w.category, w.text)) as h from p join (select distinct id, product_id, version_number, category, text from label_warnings where status = 'active') w on w.product_id = p.product_id and w.version_number = p.version_number),
warn as (select product_id, string_agg(h, ',' order by h) as warnings from said group by product_id),
rec as (select p.product_id, string_agg(d.doc_id::varchar, ',' order by d.doc_id) as recalls from p join documents d on p.product_id = 'PRD-' || lpad(d.doc_id::varchar, 9, '0') where d.source = 'recall_notice' and d.text is not null group by p.product_id)
select p.product_id, p.name, m.name as manufacturer, coalesce(ings.ingredients, '') as ingredients, coalesce(warn.warnings, '') as warnings, coalesce(rec.recalls, '') as recalls, r.source_system, r.endpoint_or_document_type
from p join source_runs r on r.id = p.source_id left join m on m.manufacturer_id = p.manufacturer_id left join ings on ings.product_id = p.product_id left join warn on warn.product_id = p.product_id left join rec on rec.product_id = p.product_id""")
def product_hit_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All products with their current associations, flattened to texts."""
    s = _store(spark, sf_dir)
    hits = store.current_versions(s["product_versions"], "product_id").select("product_id", "id", "version_number", "name", "manufacturer_id", "source_id")
    whole = search.nest_products(s, hits, bounded=False)
    joined = lambda items, part, sep: F.coalesce(F.array_join(F.transform(items, part), sep), F.lit(""))
    return whole.select(
        "product_id", "name", F.col("manufacturer.name").alias("manufacturer"), joined("ingredients", lambda i: F.concat_ws(":", i["id"], i["name"], i["role"]), "; ").alias("ingredients"),
        F.coalesce(F.array_join(F.sort_array(F.transform("warnings", lambda w: F.md5(F.concat_ws("|", w["category"], w["text"])))), ","), F.lit("")).alias("warnings"),
        joined("recalls", lambda r: r["id"].cast("string"), ",").alias("recalls"), "source.source_system", "source.endpoint_or_document_type",
    )


@query("""select w.id, r.source_system, r.endpoint_or_document_type, strftime(r.ingested_at, '%Y-%m-%dT%H:%M:%S') as ingested_at from (select distinct * from label_warnings) w join source_runs r on r.id = w.source_id""")
def provenance_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = read_table(spark, sf_dir, "label_warnings").distinct().select("id", "source_id")
    return search.provenance(w, F.broadcast(read_table(spark, sf_dir, "source_runs"))).select("id", "source.*")


@query(f"""select w.id, coalesce(p.name, '?') as product from (select distinct id, product_id from label_warnings) w left join {_now('product', 'product_id, name')} p on p.product_id = w.product_id""")
def left_optional_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = store.current_versions(_versions(spark, sf_dir, "product"), "product_id").select("product_id", "name")
    return read_table(spark, sf_dir, "label_warnings").select("id", "product_id").distinct().join(p, "product_id", "left").select("id", F.coalesce("name", F.lit("?")).alias("product"))


@query(f"""with p as {_now('product', 'product_id, id')} select l.ingredient_id, string_agg(distinct p.product_id, ',' order by p.product_id) as product_ids from p join product_ingredients l on l.product_version_id = p.id group by l.ingredient_id""")
def products_of_ingredient(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = search.current_links(_versions(spark, sf_dir, "product"), read_table(spark, sf_dir, "product_ingredients"))
    return links.groupBy("ingredient_id").agg(F.array_join(F.sort_array(F.collect_set("product_id")), ",").alias("product_ids"))


# -- runs --------------------------------------------------------------------------------------------------


_LOGS = rf"""
logs as (select r.source_system as source, r.ingestion_run_id as run_id, r.ingested_at as started_at, case when r.id % 7 = 0 then 'partial' when r.id % 11 = 0 then 'running' else 'completed' end as status,
  coalesce(c.n, 0) as records_fetched, coalesce(c.rejected, 0) as records_rejected, r.id from source_runs r
  left join (select source_id, count(*) as n, sum(case when status = 'retracted' then 1 else 0 end) as rejected from product_versions group by source_id) c on c.source_id = r.id),
dead as (select r.source_system as source, w.created_at from label_warnings w join source_runs r on r.id = w.source_id where w.text is null or regexp_matches(w.text, '^{_SPACE}*$'))"""


def _logs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    runs = read_table(spark, sf_dir, "source_runs")
    counts = read_table(spark, sf_dir, "product_versions").groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("status") == "retracted", 1).otherwise(0)).alias("rejected"))
    logs = runs.join(counts, "id", "left").select(
        F.col("source_system").alias("source"), F.col("ingestion_run_id").alias("run_id"), F.col("ingested_at").alias("started_at"), "id",
        F.when(F.col("id") % 7 == 0, "partial").when(F.col("id") % 11 == 0, "running").otherwise("completed").alias("status"),
        F.coalesce("n", F.lit(0)).alias("records_fetched"), F.coalesce("rejected", F.lit(0)).alias("records_rejected"),
        F.to_json(F.struct(F.col("endpoint_or_document_type").alias("endpoint"), (F.col("id") * 10).alias("records_processed"))).alias("checkpoint_state"),
    )
    blank = read_table(spark, sf_dir, "label_warnings").where(F.col("text").isNull() | F.col("text").rlike(r"(?U)^\s*$")).select(F.col("source_id").alias("id"), "created_at")
    return logs, blank.join(F.broadcast(runs.select("id", F.col("source_system").alias("source"))), "id").select("source", "created_at")


@query(f"""with {_LOGS}
select source, sum(case when status = 'completed' and started_at >= {NOW} - interval 7 day then 1 else 0 end)::double / nullif(sum(case when started_at >= {NOW} - interval 7 day then 1 else 0 end), 0) as success_rate_7d,
  sum(case when status = 'completed' and started_at >= {NOW} - interval 30 day then 1 else 0 end)::double / nullif(sum(case when started_at >= {NOW} - interval 30 day then 1 else 0 end), 0) as success_rate_30d,
  arg_max(run_id, (started_at, run_id)) as last_run_id, arg_max(status, (started_at, run_id)) as last_status, coalesce(sum(case when started_at >= {NOW} - interval 30 day then records_fetched end), 0)::bigint as fetched_30d,
  any_value(coalesce(dd.n, 0))::bigint as dead_letters_30d, any_value(coalesce(dd.n, 0))::double / nullif(coalesce(sum(case when started_at >= {NOW} - interval 30 day then records_fetched end), 0), 0) as dead_letter_rate
from logs left join (select source as s, count(*) as n from dead where created_at >= {NOW} - interval 30 day group by source) dd on dd.s = logs.source group by source""")
def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observability.source_health(*_logs(spark, sf_dir), F.expr(NOW.replace("timestamp", "timestamp_ntz")))


@query(f"""with {_LOGS}, l as (select source, started_at::date as day, sum(records_fetched)::bigint as fetched, sum(records_rejected)::bigint as rejected from logs where started_at >= {NOW} - interval 365 day group by all),
d as (select source, created_at::date as day, count(*) as dead from dead where created_at >= {NOW} - interval 365 day group by all),
v as (select created_at::date as day, count(*) as asked from entity_resolution_reviews where created_at >= {NOW} - interval 365 day group by all)
select l.source, strftime(l.day, '%Y-%m-%d') as day, l.fetched, l.rejected::double / nullif(l.fetched, 0) as failure_rate, coalesce(d.dead, 0) as dead_letters, coalesce(v.asked, 0) as reviews_created
from l left join d on d.source = l.source and d.day = l.day left join v on v.day = l.day""")
def daily_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    since = F.expr(NOW.replace("timestamp", "timestamp_ntz") + " - interval 365 days")
    return observability.daily_trend(*_logs(spark, sf_dir), read_table(spark, sf_dir, "entity_resolution_reviews"), since)


@query(f"""select coalesce(sum(case when status = 'pending' then 1 end), 0)::bigint as pending_count, coalesce(sum(case when status = 'approved' then 1 end), 0)::bigint as approved_count, coalesce(sum(case when status = 'rejected' then 1 end), 0)::bigint as rejected_count,
  round((epoch_us({NOW}) - epoch_us(min(case when status = 'pending' then created_at end))) / 3.6e9, 4) as oldest_pending_hours from entity_resolution_reviews""")
def review_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observability.review_backlog(read_table(spark, sf_dir, "entity_resolution_reviews"), F.expr(NOW.replace("timestamp", "timestamp_ntz")))


_OUTCOME = "case when status = 'retracted' then 'rejected' when version_number = 1 then 'created' when status = 'superseded' then 'unchanged' else 'updated' end"


@query(f"""with o as (select source_id as run_id, {_OUTCOME} as outcome from product_versions)
select run_id, count(*) as records_fetched, sum(case when outcome = 'rejected' then 0 else 1 end)::bigint as records_validated, {', '.join(f"sum(case when outcome = '{o}' then 1 else 0 end)::bigint as records_{o}" for o in ('created', 'updated', 'unchanged', 'rejected'))} from o group by run_id""")
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observability.run_counters(read_table(spark, sf_dir, "product_versions").select(F.col("source_id").alias("run_id"), F.expr(_OUTCOME).alias("outcome")))


@query(f"""with {_LOGS} select source, endpoint, arg_max(run_id, (started_at, run_id)) as run_id, arg_max(id * 10, (started_at, run_id))::bigint as records_processed
from (select l.*, r.endpoint_or_document_type as endpoint from logs l join source_runs r on r.id = l.id) where status in ('running', 'partial') group by source, endpoint""")
def resumable_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observability.resumable_run(_logs(spark, sf_dir)[0])


@query("select event_id, user_id from events where event_id >= 5000")
def resume_skip_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observability.resume_by_position(read_table(spark, sf_dir, "events"), "event_id", 5000).select("event_id", "user_id")


@query("select distinct document_id, package_name from spl_documents where package_name not in (select package_name from spl_documents where package_name is not null and version_number > 5)")
def resume_skip_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "spl_documents")
    return observability.resume_by_name(d.select("document_id", "package_name").where("package_name is not null").distinct(), d.where("version_number > 5"), "package_name").select("document_id", "package_name")


# -- records -----------------------------------------------------------------------------------------------


@query("""select distinct record_id, concat_ws('; ', case when coalesce(brand_name, '') = '' and coalesce(generic_name, '') = '' then 'no brand or generic name' end, case when coalesce(len(substance_name), 0) = 0 then 'no substance name' end) as reasons from label_records""")
def validate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read_table(spark, sf_dir, "label_records").select("record_id", ingest.label_reasons(F.col("brand_name"), F.col("generic_name"), F.col("substance_name")).alias("reasons"))
    return r.distinct()


@query("""select distinct 'validation' as stage, record_id::varchar as record_identifier, raw as raw_payload, concat_ws('; ', case when coalesce(brand_name, '') = '' and coalesce(generic_name, '') = '' then 'no brand or generic name' end,
  case when coalesce(len(substance_name), 0) = 0 then 'no substance name' end) as error_message from label_records where (coalesce(brand_name, '') = '' and coalesce(generic_name, '') = '') or coalesce(len(substance_name), 0) = 0""")
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "label_records").withColumn("reason", ingest.label_reasons(F.col("brand_name"), F.col("generic_name"), F.col("substance_name")))
    return ingest.dead_letters(d, "validation", "reason", "record_id", F.col("raw")).distinct()


@query("""select distinct record_id, n.pos - 1 as pos, n.name as name, nullif(unii[n.pos], '') as unii from (select record_id, unii, unnest(list_transform(range(1, len(substance_name) + 1), lambda i: {'pos': i, 'name': substance_name[i]})) as n from label_records)""")
def ingredient_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read_table(spark, sf_dir, "label_records")
    links = r.select("record_id", F.explode(ingest.ingredient_links(F.col("substance_name"), F.col("unii"))).alias("l"))
    return links.select("record_id", F.col("l.pos").cast("long").alias("pos"), "l.name", "l.unii").distinct()


@query("select event_id, (props->>'$.k')::bigint as k from events")
def json_parse_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query()
def label_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels parsed and mapped to candidates; nested lists as JSON texts."""
    parsed = ingest.parse_label_records(read_table(spark, sf_dir, "label_records").select("record_id", "raw"))
    return ingest.transform_labels(parsed.where("parse_error is null")).select("record_key", "name", "product_type", "manufacturer_name", F.to_json("ingredients").alias("ingredients"), F.to_json("warnings").alias("warnings")).distinct()


@query()
def schema_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.infer_schema(read_table(spark, sf_dir, "label_records"))


@query()
def resolution_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The substances of all labels, in order of record and position, resolved from nothing."""
    links, _ = Scratch(spark).keep(ingredient_links(spark, sf_dir))
    numbered, _ = Scratch(spark).keep(store.dense_numbers(links, ["record_id", "pos"], "ordinal").select("ordinal", "name", F.col("unii").alias("identifier")))
    return resolve.resolve(spark, numbered)


@query(rf"""
with recursive m as (select distinct id as k, upper(trim(candidate_b_id)) as loser, upper(trim(candidate_a_id)) as winner from entity_resolution_reviews where status = 'approved' and entity_type = 'ingredient'),
e as (select * from m where loser is not null and winner is not null and loser <> winner),
nx as (select e.k, min(n.k) as following from e join e n on n.loser = e.winner and n.k > e.k group by e.k),
walk as (select e.loser, e.k from e join (select loser, min(k) as k from e group by loser) f on f.k = e.k union all select w.loser, nx.following from walk w join nx on nx.k = w.k),
ends as (select loser, max(k) as k from walk group by loser)
select f.loser, e.winner from ends f join e on e.k = f.k where f.loser <> e.winner""")
def review_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved ingredient reviews applied in order of id: where each merged id goes."""
    asked = read_table(spark, sf_dir, "entity_resolution_reviews").where("status = 'approved' and entity_type = 'ingredient'")
    clean = lambda c: F.upper(F.trim(c)).alias(c)
    return resolve.redirects(spark, asked.select("id", clean("candidate_a_id"), clean("candidate_b_id")).distinct())


# -- search ---------------------------------------------------------------------------------------------


#: For SQL, which has no stemmer: the words that have each lexeme of the queries below, as whole-word patterns.
_FORMS = {
    "exceed": "exceed(s|ed|ing|ingly|ance|ances)?", "tablet": "tablets?", "patient": "patient(s|ly)?", "sever": "sever(e|ed|ing|ely|ity|ities|s)?", "injuri": "injur(y|ies|ious|iously)", "stomach": "stomachs?",
    "voluntarili": "voluntarily", "recal": "recall(s|ed|ing)?", "torn": "torns?", "seal": "seal(s|ed|ing)?", "sodium": "sodiums?", "acet": "acetate(s|d)?|acetic",
}


def _lexemes(table: str, key: str, text: str, terms: list[str], where: str = "true") -> str:
    """CTE o: key, t, p of the words of a table that have one of the terms."""
    picked = " ".join(f"when regexp_full_match(w, '{_FORMS[t]}') then '{t}'" for t in terms)
    return f"""v as (select distinct {key} as id, {text} as text from {table} where {text} is not null and {where}), l as (select id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') as ws from v),
o as (select id, t, p from (select id, p, case {picked} end as t from (select id, ws[p] as w, p from (select id, ws, unnest(range(1, len(ws) + 1)) as p from l))) where t is not null)"""


_AND_RANK = """m as (select id from o group by id having count(distinct t) = {n}),
c as (select a.id, 0.1 * sqrt(case when abs(a.p - b.p) > 100 then 1e-30 else 1 / (1.005 + 0.05 * exp(abs(a.p - b.p) / 1.5 - 2)) end) as c from o a join o b on a.id = b.id and a.t < b.t join m on m.id = a.id),
ranked as (select id, 1 - exp(sum(ln(1 - c))) as rank from c group by id)"""
_OR_RANK = "ranked as (select id, sum(0.1 / (j * j)) / 1.64493406685 / {n} as rank from (select id, row_number() over (partition by id, t order by p) as j from o) group by id)"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").where("text is not null").select("doc_id", fts.to_vector(F.col("text")).alias("v"))


@query(f"with {_lexemes('documents', 'doc_id', 'text', ['exceed', 'tablet', 'patient'])} select id as doc_id from o group by id having count(distinct t) = 3")
def fts_match_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words but the stop words; plurals and other forms match."""
    return _vectors(spark, sf_dir).where(fts.matches_all(F.col("v"), fts.all_terms("the patients should not exceed tablets"))).select("doc_id")


@query(f"with {_lexemes('documents', 'doc_id', 'text', ['exceed', 'tablet', 'patient'])}, {_OR_RANK.format(n=3)} select id as doc_id, round(rank, 6) as rank from ranked")
def fts_rank_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = fts.any_groups("patients exceeding a tablet")
    terms = [t for g in groups for t in g]
    return _vectors(spark, sf_dir).where(fts.matches_any(F.col("v"), groups)).select("doc_id", F.round(fts.rank_any(F.col("v"), terms), 6).alias("rank"))


@query(f"with {_lexemes('documents', 'doc_id', 'text', ['exceed', 'tablet', 'patient'])}, {_AND_RANK.format(n=3)} select id as doc_id, round(rank, 6) as rank from ranked")
def fts_rank_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = fts.all_terms("a patient exceeded the tablets")
    return _vectors(spark, sf_dir).where(fts.matches_all(F.col("v"), terms)).select("doc_id", F.round(fts.rank_all(F.col("v"), terms), 6).alias("rank"))


_SOURCE = "r.source_system, r.endpoint_or_document_type, strftime(r.ingested_at, '%Y-%m-%dT%H:%M:%S') as ingested_at"


@query(f"""with {_lexemes('ingredient_versions', 'id', 'name', ['sodium', 'acet'])}, {_OR_RANK.format(n=2)}, now as {_now('ingredient', '*')},
hit as (select n.ingredient_id, k.rank from now n join ranked k on k.id = n.id where n.status = 'active' union all select distinct a.ingredient_id, k.rank from ingredient_versions a join ranked k on k.id = a.id where a.version_number = 1),
best as (select ingredient_id, max(rank) as rank from hit group by ingredient_id order by rank desc, ingredient_id limit 20),
links as (select l.ingredient_id, string_agg(distinct p.product_id, ',' order by p.product_id) as ids from {_now('product', 'product_id, id')} p join product_ingredients l on l.product_version_id = p.id group by l.ingredient_id)
select b.ingredient_id as id, n.name, round(b.rank, 6) as rank, coalesce(links.ids, '') as product_ids, {_SOURCE} from best b join now n on n.ingredient_id = b.ingredient_id join source_runs r on r.id = n.source_id left join links on links.ingredient_id = b.ingredient_id""")
def search_ingredients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_ingredients(_store(spark, sf_dir, True), "sodium acetate", any_word=True).select("id", "name", F.round("rank", 6).alias("rank"), F.array_join("product_ids", ",").alias("product_ids"), "source.*")


@query()
def search_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search_products(_store(spark, sf_dir, True), "forte duo night", any_word=True)
    return found.select("product_id", "name", F.round("rank", 6).alias("rank"), F.to_json("manufacturer").alias("manufacturer"), F.to_json("ingredients").alias("ingredients"), F.to_json("warnings").alias("warnings"), "source.*")


@query(f"""with {_lexemes('label_warnings', 'id', 'text', ['sever', 'injuri', 'stomach'], "status = 'active'")}, {_AND_RANK.format(n=3)},
hit as (select w.id, w.category, w.text, w.product_id, w.source_id, k.rank from (select distinct id, category, text, product_id, source_id from label_warnings where status = 'active') w join ranked k on k.id = w.id order by k.rank desc, w.id limit 20)
select h.id, h.category, h.text, round(h.rank, 6) as rank, coalesce(p.name, '?') as product, {_SOURCE} from hit h join source_runs r on r.id = h.source_id left join {_now('product', 'product_id, name')} p on p.product_id = h.product_id""")
def search_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search_warnings(_store(spark, sf_dir, True), "severe injuries of the stomach")
    return found.select("id", "category", "text", F.round("rank", 6).alias("rank"), F.col("product.name").alias("product"), "source.*")


@query(f"""with {_lexemes('documents', 'doc_id', 'text', ['voluntarili', 'recal', 'torn', 'seal'], "source = 'recall_notice'")}, {_AND_RANK.format(n=4)},
hit as (select d.doc_id as id, d.text as reason, case when d.doc_id % 3 = 0 then 'terminated' else 'ongoing' end as status, k.rank, d.doc_id % 600 + 1 as source_id from documents d join ranked k on k.id = d.doc_id order by k.rank desc, d.doc_id limit 20)
select h.id, h.reason, h.status, round(h.rank, 6) as rank, {_SOURCE} from hit h join source_runs r on r.id = h.source_id""")
def search_recalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search_recalls(_store(spark, sf_dir, True), "voluntarily recalling torn seal")
    return found.select("id", "reason", "status", F.round("rank", 6).alias("rank"), "source.*")


@query()
def retrieve_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.retrieve(_store(spark, sf_dir, True), "severe stomach injury").select("number", "entity_type", "entity_id", "content", F.round("retrieval_confidence", 6).alias("confidence"))


_KEY = rf"'doc:' || substring(regexp_replace(regexp_replace(lower(text), '{_SPACE}+', ' ', 'g'), '^ | $', '', 'g'), 1, 160)"


@query(f"select doc_id from (select doc_id, row_number() over (partition by {_KEY} order by doc_id) as rn from documents where text is not null) where rn = 1")
def dedup_prefix160(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = read_table(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.dedup_key(F.lit("doc"), F.col("text")).alias("k"))
    return keyed.groupBy("k").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query(rf"select doc_id, case when length(text) <= 220 then text else regexp_replace(substring(text, 1, 219), '{_SPACE}+$', '') || '…' end as content from documents where text is not null")
def evidence_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.truncate(F.col("text"), 220).alias("content"))


@query("select record_id, array_to_string(substance_name[1:8], ', ') || case when len(substance_name) > 8 then ', and ' || (len(substance_name) - 8) || ' more' else '' end as names from (select distinct record_id, substance_name from label_records where substance_name is not null)")
def capped_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "label_records").where("substance_name is not null").select("record_id", "substance_name").distinct()
    return rows.select("record_id", text.join_capped(F.col("substance_name")).alias("names"))


@query(r"""with t as (select doc_id, text || case when doc_id % 3 = 0 then ' [1]' when doc_id % 3 = 1 then ' [1, 9]' else '' end as t from documents where text is not null),
l as (select doc_id, t, list_filter(regexp_split_to_array(t, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{0085}\x{2028}\x{2029}]'), lambda x: regexp_replace(x, '[\s\x0B\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', '', 'g') <> '') as lines,
  list_transform(flatten(list_transform(regexp_extract_all(t, '\[(\d+(?:, ?\d+)*)\]', 1), lambda m: regexp_split_to_array(m, ', ?'))), lambda n: coalesce(try_cast(n as bigint), -1)) as ns from t)
select doc_id, case when len(lines) = 0 then 'empty answer' when len(list_filter(lines, lambda x: not regexp_matches(x, '\[(\d+(?:, ?\d+)*)\]'))) > 0 then 'uncited line' when len(list_filter(ns, lambda n: n < 1 or n > 5)) > 0 then 'citation out of range' else '' end as reason,
  array_to_string(list_sort(list_distinct(list_filter(ns, lambda n: n between 1 and 5))), ',') as cited from l""")
def citation_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.when(F.col("doc_id") % 3 == 0, " [1]").when(F.col("doc_id") % 3 == 1, " [1, 9]").otherwise("")
    rows = read_table(spark, sf_dir, "documents").where("text is not null").select("doc_id", evidence.verify_citations(F.concat("text", mark), F.lit(5)).alias("c"))
    return rows.select("doc_id", "c.reason", F.array_join(F.transform("c.cited", lambda n: n.cast("string")), ",").alias("cited"))


@query()
def rich_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(text.rich_lines(F.col("text"))).alias("pos", "line"))


@query("""select distinct document_id, package_name, '<document><setId root="' || set_id || '"/><title>' || coalesce(product_name, '') || '</title></document>' as body from spl_documents where package_name is not null and set_id is not null""")
def payload_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit('<document><setId root="'), "set_id", F.lit('"/><title>'), F.coalesce("product_name", F.lit("")), F.lit("</title></document>"))
    d = read_table(spark, sf_dir, "spl_documents").where("package_name is not null and set_id is not null").select("document_id", "package_name", body.alias("xml")).distinct()
    coded = d.select("document_id", text.encode_payload(F.col("package_name"), F.encode("xml", "UTF-8")).alias("payload"))
    return coded.select("document_id", text.decode_payload(F.col("payload")).alias("p")).select("document_id", "p.package_name", F.decode("p.xml", "UTF-8").alias("body"))
