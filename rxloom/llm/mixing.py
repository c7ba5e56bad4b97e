"""Mixing sources to target shares of the tokens (problem 9).

Entropy balancing. Each document d of source s gets a rate r = cap * sigmoid(logit(base / cap) + m * z):
base is the rate at which the source would have its target share of the documents, z the document's
tokens against the source's mean, cap how often a document may be used, and m the source's multiplier.
These are the rates nearest to base in (bounded) relative entropy under the constraint that the
source's tokens are its share of the total. The convex dual is solved by Newton steps inside a
bracket; a step is one aggregation over the counts of documents by (source, tokens), and only one row
a source comes to the driver. Rates become whole copies by cumulative rounding in order of length,
so that a source's tokens are missed by less than one document; then single copies are added or taken
away, each of the longest document that still fits into what is missed.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rxloom.llm.tokens import TOKENIZER, count_tokens
from rxloom.session import Scratch

STEPS = 60
EXACT = 1e-9
CORRECTIONS = 8
SPREAD = 64


def feasible_total(sums: dict, targets: dict) -> float:
    """The largest total of which every source can give its share."""
    return min((cap * sums.get(s, (0, 0))[1] / share for s, (share, cap) in targets.items() if share > 0), default=0.0)


def solve(spark: SparkSession, cells: DataFrame, targets: dict, total: float | None = None) -> tuple[dict, dict]:
    """source -> (base, multiplier, mean tokens, cap) and source -> (documents, tokens) of cells (source, tokens, n).

    A source that can't give its share even at its cap is used to the cap.
    """
    sums = {r[0]: (r[1], r[2]) for r in cells.groupBy("source").agg(F.sum("n"), F.sum(F.col("n") * F.col("tokens"))).collect()}
    total = feasible_total(sums, targets) if total is None else total
    state = {}
    documents = sum(n for s, (n, _) in sums.items() if s in targets)
    mean_all = sum(t for s, (_, t) in sums.items() if s in targets) / max(1, documents)
    for s, (share, cap) in targets.items():
        n, t = sums.get(s, (0, 0))
        if not n or not t or share <= 0 or total <= 0:
            continue
        wanted = min(share * total, cap * t)
        full = wanted >= cap * t * (1 - EXACT)
        base = min(share * total / mean_all / n, cap * (1 - 1e-3))
        state[s] = {"want": wanted, "mean": t / n, "cap": float(cap), "base": max(base, 1e-9), "m": 0.0, "lo": -math.inf, "hi": math.inf, "full": full}
    for _ in range(STEPS):
        open_ = {s: v for s, v in state.items() if not v["full"] and not v.get("done")}
        if not open_:
            break
        now = spark.createDataFrame([(s, v["cap"], math.log(v["base"] / (v["cap"] - v["base"])), v["m"], v["mean"]) for s, v in open_.items()], "source string, cap double, b double, m double, mean double")
        z = F.col("tokens") / F.col("mean")
        p = 1 / (1 + F.exp(-(F.col("b") + F.col("m") * z)))
        got = cells.join(F.broadcast(now), "source").groupBy("source").agg(
            F.sum(F.col("n") * F.col("cap") * p * F.col("tokens")).alias("g"), F.sum(F.col("n") * F.col("cap") * p * (1 - p) * z * F.col("tokens")).alias("h")
        )
        for s, g, h in got.collect():
            v = state[s]
            off = g - v["want"]
            if abs(off) <= EXACT * v["want"]:
                v["done"] = True
                continue
            v["hi" if off > 0 else "lo"] = v["m"]
            step = v["m"] - off / h if h > 0 else math.nan
            if not (v["lo"] < step < v["hi"]):
                low, high = v["lo"], v["hi"]
                step = (low + high) / 2 if math.isfinite(low) and math.isfinite(high) else (v["m"] * 2 - math.copysign(1, off) if off else v["m"])
            v["m"] = step
    unsettled = sorted(s for s, v in state.items() if not v["full"] and not v.get("done"))
    if unsettled:
        raise ArithmeticError(f"no rates after {STEPS} steps for {', '.join(unsettled)}")
    return state, sums


def corrected(spark: SparkSession, cells: DataFrame, wanted: dict) -> DataFrame:
    """cells (source, tokens, n, cap, k) with k changed by single copies, until no document fits into what a
    source misses. A step looks at sums and one length a source, and at most CORRECTIONS are made."""
    changes: dict = {}
    for _ in range(CORRECTIONS):
        moved = spark.createDataFrame([(s, t, d) for (s, t), d in changes.items()], "source string, tokens long, d long")
        now = cells.join(F.broadcast(moved), ["source", "tokens"], "left").withColumn("k", F.col("k") + F.coalesce("d", F.lit(0))).drop("d")
        aims = F.broadcast(spark.createDataFrame([(s, float(w)) for s, w in wanted.items()], "source string, want double"))
        missed = now.groupBy("source").agg(F.sum(F.col("k") * F.col("tokens")).alias("got")).join(aims, "source").select("source", (F.col("want") - F.col("got")).alias("off"))
        fits = now.join(F.broadcast(missed), "source").where(
            ((F.col("off") > 0) & (F.col("tokens") <= 2 * F.col("off")) & (F.col("k") < F.col("n") * F.col("cap"))) | ((F.col("off") < 0) & (F.col("tokens") <= -2 * F.col("off")) & (F.col("k") > 0))
        )
        best = fits.groupBy("source").agg(F.min_by(F.struct("tokens", F.signum("off").cast("long").alias("d")), F.abs(F.abs("off") - F.col("tokens"))).alias("b"), F.min(F.abs(F.abs("off") - F.col("tokens"))).alias("left"), F.max(F.abs("off")).alias("was"))
        chosen = best.where("left < was").select("source", "b.tokens", "b.d").collect()  # one row a source
        if not chosen:
            return now
        for r in chosen:
            changes[r["source"], r["tokens"]] = changes.get((r["source"], r["tokens"]), 0) + r["d"]
    moved = spark.createDataFrame([(s, t, d) for (s, t), d in changes.items()], "source string, tokens long, d long")
    return cells.join(F.broadcast(moved), ["source", "tokens"], "left").withColumn("k", F.col("k") + F.coalesce("d", F.lit(0))).drop("d")


def mix(spark: SparkSession, docs: DataFrame, targets: DataFrame, total: float | None = None, path: str = TOKENIZER) -> DataFrame:
    """doc_id, source, tokens, copies of every document of a source in targets (source, target_share, max_repeats).

    Documents without a text, or an empty one, have no tokens and are used 0 times; so are those of a
    source with a share of 0. Sources not in targets, and null, are left out. targets has one row a
    source and is the caller's configuration, so it is read on the driver.
    """
    scratch = Scratch(spark)
    wanted = {r[0]: (float(r[1]), int(r[2])) for r in targets.select("source", "target_share", "max_repeats").where("source is not null").distinct().collect()}
    sources = F.broadcast(targets.select("source").where("source is not null").distinct())
    own = docs.select("doc_id", "text", "source").where("doc_id is not null").join(sources, "source")
    placed = own.groupBy("doc_id").agg(F.min("source").alias("source"))
    counted, _ = scratch.keep(count_tokens(spark, own.select("doc_id", "text"), path).join(placed, "doc_id"))
    cells, _ = scratch.keep(counted.where("tokens > 0").groupBy("source", "tokens").agg(F.count("*").alias("n")))
    state, _ = solve(spark, cells, wanted, total)
    rates = spark.createDataFrame(
        [(s, v["cap"], 0.0 if v["full"] else math.log(v["base"] / (v["cap"] - v["base"])), v["m"], v["mean"], v["full"]) for s, v in state.items()],
        "source string, cap double, b double, m double, mean double, full boolean",
    )
    rate = F.when(F.col("full"), F.col("cap")).otherwise(F.col("cap") / (1 + F.exp(-(F.col("b") + F.col("m") * F.col("tokens") / F.col("mean")))))
    upto = Window.partitionBy("source").orderBy("tokens").rowsBetween(Window.unboundedPreceding, 0)
    held = cells.join(F.broadcast(rates), "source").withColumn("mass", F.col("n") * rate).withColumn("upto", F.sum("mass").over(upto))
    whole = lambda c: F.floor(c + 0.5 + 1e-7)
    rounded, _ = scratch.keep(held.select("source", "tokens", "n", "cap", F.least(whole(F.col("upto")) - whole(F.col("upto") - F.col("mass")), (F.col("n") * F.col("cap")).cast("long")).alias("k")))
    shared = corrected(spark, rounded, {s: v["want"] for s, v in state.items()})
    # which of a cell's documents get one copy more: the first by hash, ranked in SPREAD parts of a cell
    spread = counted.where("tokens > 0").withColumn("h", F.xxhash64("doc_id")).withColumn("part", F.pmod("h", F.lit(SPREAD)))
    parts = spread.groupBy("source", "tokens", "part").agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy("source", "tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.select("source", "tokens", "part", F.coalesce(before, F.lit(0)).alias("before")).join(shared, ["source", "tokens"])
    ranked = spread.withColumn("r", F.row_number().over(Window.partitionBy("source", "tokens", "part").orderBy("h", "doc_id")) - 1)
    used = ranked.join(offsets, ["source", "tokens", "part"], "left").select(
        "doc_id", "source", "tokens",
        F.coalesce(F.floor(F.col("k") / F.col("n")) + F.when(F.col("before") + F.col("r") < F.col("k") % F.col("n"), 1).otherwise(0), F.lit(0)).cast("long").alias("copies"),
    )
    return used.unionByName(counted.where("tokens = 0").select("doc_id", "source", "tokens", F.lit(0).cast("long").alias("copies")))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, actual_share, documents, copies, tokens, most_repeats of a mix."""
    sums = mixed.groupBy("source").agg(
        F.sum(F.when(F.col("copies") > 0, 1).otherwise(0)).alias("documents"), F.sum("copies").alias("copies"),
        F.sum(F.col("copies") * F.col("tokens")).alias("tokens"), F.max("copies").alias("most_repeats"),
    )
    none = F.lit(0).cast("long")
    joined = targets.select("source", "target_share").where("source is not null").distinct().join(F.broadcast(sums), "source", "left")
    total = F.sum("tokens").over(Window.partitionBy(F.lit(0)))  # one row a source
    return joined.select(
        "source", "target_share", F.coalesce(F.col("tokens") / total, F.lit(0.0)).alias("actual_share"),
        *(F.coalesce(c, none).alias(c) for c in ("documents", "copies", "tokens", "most_repeats")),
    )
