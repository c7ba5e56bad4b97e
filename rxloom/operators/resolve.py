"""Entity resolution: identifier, then exact name or alias, then trigram similarity in three tiers.

The rule is sequential: a candidate sees the entities made by those before it. It is run in parallel by
linking candidates (and existing names) that could influence each other (same identifier, same
normalized name, similarity of at least the review threshold), and replaying the rule in order
inside each connected group. A similarity below that threshold always gives a new entity, so
groups can't influence one another. Names are compared only as distinct normalized names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rxloom.functions.text import AUTO_MERGE, REVIEW, normalize_name, similarity_of, trigrams
from rxloom.operators.graph import group_pairs
from rxloom.operators.store import dense_numbers
from rxloom.session import Scratch

#: Trigrams above which a name has single trigrams as keys, not pairs of them.
LONG = 256


def _packed(grams: Column) -> Column:
    """Trigrams as numbers that are equal where they are: three code points of 21 bits each."""
    at = lambda g, i: F.ascii(F.substring(g, F.lit(i), F.lit(1))).cast("long")
    return F.transform(grams, lambda g: F.shiftleft(at(g, 1), 42) + F.shiftleft(at(g, 2), 21) + at(g, 3))


def _keys(grams: DataFrame, threshold: float) -> DataFrame:
    """key, id, n, indexed of names (id, t), which are the trigrams t of each: pairs over the threshold share a key that is indexed in the smaller.

    Names of x >= y trigrams share ``least`` of x or ``sure`` of y at least, by these counts. So the first two that they
    share, rarest first, are among the first x - least + 2 and y - sure + 2. Where they may share but one, and
    for long names, which would have too many pairs, single trigrams are keys, with one less."""
    df = grams.groupBy("t").agg(F.count("*").alias("df"))
    ranked = grams.join(df, "t").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("r")).select("id", F.size("r").alias("n"), F.transform("r", lambda x: x["t"]).alias("r"))
    least, sure = (F.ceil(F.lit(share) * F.col("n") - 1e-9).cast("int") for share in (threshold, 2 * threshold / (1 + threshold)))
    held, _ = Scratch(grams.sparkSession).keep(ranked.select("id", "n", least.alias("least"), (F.col("n") - sure + 2).alias("first"), F.slice("r", F.lit(1), F.col("n") - least + 2).alias("r")))
    none = F.array().cast("array<struct<key:long,at:int>>")
    two = F.flatten(F.transform("r", lambda b, j: F.transform(F.slice("r", F.lit(1), j), lambda a: F.struct(F.xxhash64(a, b).alias("key"), j.alias("at")))))
    one = F.transform(F.slice("r", F.lit(1), F.col("n") - F.col("least") + 1), lambda a, j: F.struct(F.xxhash64(a).alias("key"), (j + 1).alias("at")))
    listed = F.concat(F.when(F.col("n") <= LONG, two).otherwise(none), F.when((F.col("least") < 2) | (F.col("n") >= threshold * LONG), one).otherwise(none))
    return held.select("id", "n", "first", F.explode(listed).alias("k")).select("k.key", "id", "n", (F.col("k.at") < F.col("first")).alias("indexed"))


def similarity_join(names: DataFrame, threshold: float = REVIEW) -> DataFrame:
    """a, b, score of distinct names (name), a < b, with at least that trigram similarity.

    Exact, by prefix filter over pairs of rare trigrams (_keys); names of sizes that the threshold allows are
    compared once for each two of them, by numbers in place of trigrams."""
    distinct = names.select("name").where("name is not null").distinct().withColumn("id", F.monotonically_increasing_id())
    held, _ = Scratch(names.sparkSession).keep(distinct.withColumn("g", _packed(trigrams(F.col("name")))).where("size(g) > 0"))
    keys = _keys(held.select("id", F.explode("g").alias("t")), threshold)
    x, y = keys.drop("indexed"), keys.where("indexed").select("key", F.col("id").alias("other"), F.col("n").alias("m"))
    fits = ((F.col("m") < F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("other") < F.col("id")))) & (F.col("m") >= threshold * F.col("n") - 1e-9)
    pairs = x.join(y, "key").where(fits).select("id", "other").distinct()
    one = lambda i, c: held.select(F.col("id").alias(i), F.col("name").alias(c), F.col("g").alias(f"g{c}"))
    scored = pairs.join(one("id", "a"), "id").join(one("other", "b"), "other").withColumn("score", similarity_of(F.col("ga"), F.col("gb"))).where(F.col("score") >= threshold)
    return scored.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score")


def best_matches(candidates: DataFrame, existing: DataFrame, threshold: float = REVIEW) -> DataFrame:
    """One round against existing (entity_id, name): name, entity_id, score, decision of each distinct
    candidate name; of equal scores the lowest entity_id. Names without a match have null."""
    new = candidates.select(normalize_name(F.col("name")).alias("name")).where("name <> ''").distinct()
    old = existing.select("entity_id", normalize_name(F.col("name")).alias("known")).where("known <> ''").distinct()
    pairs = similarity_join(new.unionByName(old.select(F.col("known").alias("name"))), threshold)
    either = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    exact = new.join(old, F.col("name") == F.col("known")).select("name", "entity_id", F.lit(1.0).alias("score"), F.lit(1).alias("exact"))
    fuzzy = new.join(either, F.col("name") == F.col("a")).join(old, F.col("b") == F.col("known")).select("name", "entity_id", "score", F.lit(0).alias("exact"))
    best = exact.unionByName(fuzzy).groupBy("name").agg(F.min_by(F.struct("entity_id", "score", "exact"), F.struct(-F.col("exact"), -F.col("score"), "entity_id")).alias("m"))
    decision = F.when(F.col("m").isNull(), "no_match").when(F.col("m.exact") == 1, "exact").when(F.col("m.score") >= AUTO_MERGE, "auto_merge").otherwise("review")
    return new.join(best, "name", "left").select("name", "m.entity_id", F.round("m.score", 6).alias("score"), decision.alias("decision"))


_FOLDED = "ordinal long, entity string, outcome string, matched string, score double"


def fold(rows: list[tuple], existing: list[tuple], scores: dict) -> list[tuple]:
    """The sequential rule. rows: (ordinal, name, normalized, identifier) in order; existing:
    (entity, normalized name or None, identifier or None); scores: {(a, b): similarity}, a < b.

    Gives (ordinal, entity, outcome, matched entity, score); a new entity is called 'new:<ordinal>'."""
    by_id, by_name, names = {}, {}, {}

    def order(entity):
        return (entity.startswith("new:"), int(entity[4:]) if entity.startswith("new:") else 0, entity)

    def put(entity, name, identifier):
        if identifier:
            by_id.setdefault(identifier, entity)
        if name is not None:
            by_name[name] = min(by_name.get(name, entity), entity, key=order)
            names.setdefault(name, set()).add(entity)

    for entity, name, identifier in existing:
        put(entity, name, identifier)
    near: dict = {}
    for (a, b), s in scores.items():
        near.setdefault(a, []).append((b, s))
        near.setdefault(b, []).append((a, s))
    out = []
    for ordinal, _, name, identifier in rows:
        if identifier and identifier in by_id:
            out.append((ordinal, by_id[identifier], "identifier", None, None))
            continue
        if name in by_name:
            out.append((ordinal, by_name[name], "exact", None, None))
            continue
        found = [(-s, order(e), e) for other, s in near.get(name, []) for e in names.get(other, ())]
        score, _, match = min(found, default=(0.0, None, None))
        score = -score
        if match is not None and score >= AUTO_MERGE:
            put(match, name, identifier)
            out.append((ordinal, match, "auto_merge", match, score))
            continue
        entity = f"new:{ordinal}"
        put(entity, name, identifier)
        out.append((ordinal, entity, "review" if match is not None and score >= REVIEW else "created", match if score >= REVIEW else None, score if match is not None and score >= REVIEW else None))
    return out


def _folded(rows: list[tuple]) -> list[tuple]:
    """fold of one group's rows (kind, ordinal, entity, name_, identifier, other, score), candidates in order."""
    return fold(
        [(o, n, n, i) for kind, o, _, n, i, _, _ in rows if kind == "candidate"],
        [(e, n, i) for kind, _, e, n, i, _, _ in rows if kind == "existing"],
        {(a, b): s for kind, _, _, a, _, b, s in rows if kind == "pair"},
    )


def _fold_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by component are folded group by group; one group at a time is held."""
    schema = pa.schema([("ordinal", pa.int64()), ("entity", pa.string()), ("outcome", pa.string()), ("matched", pa.string()), ("score", pa.float64())])
    listed = lambda found: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)
    held, at = [], None
    for batch in batches:
        found = []
        for component, *row in zip(*batch.to_pydict().values()):
            if component != at:
                found += _folded(held)
                held, at = [], component
            held.append(tuple(row))
        if found:
            yield listed(found)
    found = _folded(held)
    if found:
        yield listed(found)


def resolve(spark: SparkSession, candidates: DataFrame, existing: DataFrame | None = None, prefix: str = "ING", last: int = 0) -> DataFrame:
    """ordinal, entity_id, outcome, matched_id, score of candidates (ordinal, name, identifier).

    existing: (entity_id, name, identifier) of the current active names, aliases and identifiers. New
    entities are numbered after ``last`` in order of their ordinals. Blank and null names resolve to
    nothing and are left out; a repeated ordinal counts once."""
    scratch = Scratch(spark)
    new = candidates.select(F.col("ordinal").cast("long").alias("ordinal"), normalize_name(F.col("name")).alias("name_"), F.nullif("identifier", F.lit("")).alias("identifier")).where("ordinal is not null and name_ <> ''").dropDuplicates(["ordinal"])
    new, _ = scratch.keep(new)
    none = F.lit(None).cast("string")
    if existing is None:
        existing = spark.createDataFrame([], "entity_id string, name string, identifier string")
    old, _ = scratch.keep(existing.select(F.col("entity_id").alias("entity"), normalize_name(F.col("name")).alias("name_"), F.nullif("identifier", F.lit("")).alias("identifier")).distinct())
    scored, _ = scratch.keep(similarity_join(new.select(F.col("name_").alias("name")).unionByName(old.select(F.col("name_").alias("name")))))
    # nodes are texts: n:<name>, i:<identifier>, e:<entity>; a candidate links its name and identifier
    n, i, e = F.concat(F.lit("n:"), "name_"), F.concat(F.lit("i:"), "identifier"), F.concat(F.lit("e:"), "entity")
    pairs = (
        new.select(n.alias("u"), i.alias("v"))
        .unionByName(old.select(e.alias("u"), n.alias("v"))).unionByName(old.select(e.alias("u"), i.alias("v")))
        .unionByName(scored.select(F.concat(F.lit("n:"), "a").alias("u"), F.concat(F.lit("n:"), "b").alias("v")))
    )
    groups, _ = scratch.keep(group_pairs(spark, pairs))
    place = lambda df, node: df.withColumn("_n", node).join(groups.withColumnRenamed("node", "_n"), "_n", "left").withColumn("component", F.coalesce("component", "_n")).drop("_n")
    null = lambda t: F.lit(None).cast(t)
    alike = (
        place(new, n).select("component", F.lit("candidate").alias("kind"), "ordinal", none.alias("entity"), "name_", "identifier", none.alias("other"), null("double").alias("score"))
        .unionByName(place(old, e).select("component", F.lit("existing").alias("kind"), null("long").alias("ordinal"), "entity", "name_", "identifier", none.alias("other"), null("double").alias("score")))
        .unionByName(place(scored, F.concat(F.lit("n:"), "a")).select("component", F.lit("pair").alias("kind"), null("long").alias("ordinal"), none.alias("entity"), F.col("a").alias("name_"), none.alias("identifier"), F.col("b").alias("other"), "score"))
    )
    # thousands of small groups: a call of Python for each would take longer than all else
    sorted_ = alike.repartition("component").sortWithinPartitions("component", "ordinal", "entity", "name_", "identifier", "other")
    folded, _ = scratch.keep(sorted_.mapInArrow(_fold_batches, _FOLDED))
    made = dense_numbers(folded.where("entity = concat('new:', ordinal)").select("ordinal"), ["ordinal"], "_k", last)
    ids = made.select(F.concat(F.lit("new:"), "ordinal").alias("_new"), F.format_string(f"{prefix}-%06d", "_k").alias("_id"))
    named = folded.join(ids, F.col("entity") == F.col("_new"), "left").withColumn("entity_id", F.coalesce("_id", "entity")).drop("_new", "_id")
    return named.join(ids, F.col("matched") == F.col("_new"), "left").select("ordinal", "entity_id", "outcome", F.coalesce("_id", "matched").alias("matched_id"), "score")


def redirects(spark: SparkSession, approved: DataFrame) -> DataFrame:
    """loser, winner of approved reviews (id, candidate_a_id, candidate_b_id), which take effect in order of id.

    candidate_a_id survives each merge; if it is merged away later, what was its goes along. A merge's
    successor is the first later one whose loser is its survivor; successors are followed to their ends by
    pointer jumping. Reviews with a null candidate, and of an entity with itself, merge nothing.
    """
    scratch = Scratch(spark)
    real = approved.where("candidate_a_id is not null and candidate_b_id is not null and candidate_a_id <> candidate_b_id")
    merges, _ = scratch.keep(real.select(F.col("id").alias("at"), F.col("candidate_b_id").alias("loser"), F.col("candidate_a_id").alias("winner")))
    later = merges.select(F.col("at").alias("then"), F.col("loser").alias("winner"))
    after = merges.join(later, "winner").where("then > at").groupBy("at").agg(F.min("then").alias("next"))
    held, path = scratch.keep(merges.join(after, "at", "left").select("at", F.coalesce("next", "at").alias("next")))
    while True:
        step = held.select(F.col("at").alias("next"), F.col("next").alias("far"))
        kept, ahead = scratch.keep(held.join(step, "next").select("at", F.col("far").alias("next"), (F.col("far") != F.col("next")).alias("moved")))
        scratch.drop(path)
        held, path = kept.drop("moved"), ahead
        if kept.where("moved").isEmpty():
            break
    first = merges.groupBy("loser").agg(F.min("at").alias("at"))
    ends = held.join(merges.select(F.col("at").alias("next"), "winner"), "next").select("at", "winner")
    return first.join(ends, "at").where("loser <> winner").select("loser", "winner")
