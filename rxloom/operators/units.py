"""Quantities in common units (problem 2).

A multi-pattern automaton (Aho-Corasick) finds every unit alias in a text, the longest match wins,
and the neighbouring numbers and the position before or after a separator (field context) tell what
it measures. The result names units only; amounts come from a join with the broadcast table of
conversion factors, in the JVM.
"""

from __future__ import annotations

import bisect
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Unit, dimension and factor to the common unit (ug, iu, ml, g for a denominator, each).
FACTORS = [
    ("kg", "mass", 1e9),
    ("g", "mass", 1e6),
    ("mg", "mass", 1e3),
    ("ug", "mass", 1.0),
    ("ng", "mass", 1e-3),
    ("pg", "mass", 1e-6),
    ("iu", "iu", 1.0),
    ("kiu", "iu", 1e3),
    ("miu", "iu", 1e6),
    ("l", "volume", 1e3),
    ("dl", "volume", 1e2),
    ("cl", "volume", 1e1),
    ("ml", "volume", 1.0),
    ("ul", "volume", 1e-3),
    ("each", "piece", 1.0),
]

#: The spellings of each unit, in lower case.
ALIASES = {
    "kg": ["kg", "kgs", "kg.", "kilogram", "kilograms", "kilo"],
    "g": ["g", "g.", "gm", "gms", "gm.", "gram", "grams", "gramme", "grammes"],
    "mg": ["mg", "mgs", "mg.", "milligram", "milligrams", "milligramme", "milligrammes", "10*-3.g"],
    "ug": ["ug", "ugs", "ug.", "mcg", "mcgs", "mcg.", "µg", "μg", "mikrogramm", "microgram", "micrograms", "microgramme", "microgrammes", "10*-6.g"],
    "ng": ["ng", "ngs", "ng.", "nanogram", "nanograms", "10*-3.ug"],
    "pg": ["pg", "picogram", "picograms"],
    "iu": ["iu", "i.u.", "i.u", "[iu]", "ui", "int. units", "int units", "int. unit", "intl units", "international unit", "international units", "i. u."],
    "kiu": ["kiu", "k[iu]", "10*3.[iu]", "10*3[iu]", "thousand iu", "thousand [iu]", "thousand international units", "thousand i.u.", "k iu"],
    "miu": ["m[iu]", "10*6.[iu]", "10*6[iu]", "million iu", "million [iu]", "million international units", "million i.u.", "mill. iu", "million units", "mega iu"],
    "mg ": ["10*3.ug", "10*3.mcg", "10*3ug"],
    "g ": ["10*3.mg", "10*6.ug"],
    "kg ": ["10*3.g"],
    "ul": ["ul", "µl", "μl", "mcl", "microliter", "microliters", "microlitre", "microlitres", "cmm", "mm3"],
    "ml": ["ml", "mls", "ml.", "cc", "c.c.", "ccm", "cm3", "milliliter", "milliliters", "millilitre", "millilitres"],
    "cl": ["cl", "centiliter", "centilitre"],
    "dl": ["dl", "deciliter", "deciliters", "decilitre", "decilitres"],
    "l": ["l", "l.", "liter", "liters", "litre", "litres"],
    "each": [
        "each", "ea", "ea.", "tablet", "tablets", "tab", "tab.", "tabs", "capsule", "capsules", "cap", "cap.", "caps", "dose", "doses", "patch", "patches", "unit",
        "units", "piece", "pieces", "pc", "pcs", "lozenge", "lozenges", "suppository", "suppositories", "supp", "vial", "vials", "ampule", "ampoule",
        "sachet", "sachets", "packet", "packets", "caplet", "caplets", "softgel", "softgels", "actuation", "actuations", "spray", "sprays", "puff", "puffs",
        "kit", "kits", "pill", "pills", "gummy", "gummies", "film", "films", "strip", "strips", "syringe", "applicator", "implant", "wafer", "pellet", "blister", "troche",
    ],
    "%": ["%", "percent", "per cent", "pct"],
    "w/v": ["w/v", "(w/v)", "m/v", "wt/vol", "weight/volume"],
    "w/w": ["w/w", "(w/w)", "m/m", "wt/wt", "weight/weight"],
    "other": [
        "[hp_x]", "[hp_c]", "[hp_q]", "[hp_m]", "[ph]", "ph", "meq", "mmol", "umol", "µmol", "mol", "mci", "uci", "ci", "mbq", "kbq", "gbq", "bq", "drop", "drops", "[drp]",
        "[usp'u]", "usp units", "usp unit", "[arb'u]", "cfu", "[cfu]", "[pfu]", "pfu", "kcal", "cal", "ppm", "mosm", "osm", "meq.", "q.s.", "qs", "trace", "n/a",
        "[bau]", "[au]", "[amb'a'1'u]", "[lf]", "cm2", "cm", "h", "hr", "hour", "hours", "day", "v/v", "m2", "min", "sq cm", "million cells", "cells", "million", "thousand",
        "miu/l", "mlu", "spoonful", "teaspoon", "tsp", "oz", "lb", "gr", "grain", "grains", "%v/v",
    ],
}

_NUMBER = re.compile(r"(?<![\w.,])[-+]?(?:\d[\d,]*(?:\.\d+)?|\.\d+)(?:e[-+]?\d+)?(?![\d])", re.I)
_CLEAN = re.compile(r"\s+")


@lru_cache(1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for unit, names in ALIASES.items():
        for name in names:
            found.add_word(name, (len(name), unit.strip()))
    for name, unit in ((" per ", "/"), (" in ", "/"), ("/", "/"), (" p. ", "/")):
        found.add_word(name, (len(name), unit))
    found.make_automaton()
    return found


def read_number(text: str) -> float | None:
    """A comma before exactly three digits groups thousands, any other comma is a decimal comma."""
    text = re.sub(r",(?=\d{3}(?!\d))", "", text).replace(",", ".")
    try:
        return float(text)
    except ValueError:
        return None


def _tokens(text: str) -> list[tuple[str, object]]:
    """Numbers ('#', value), separators ('/', None) and units ('u', name) from left to right.

    Of overlapping unit matches the longest wins, of equally long ones the first. A match that
    touches a letter (or, on its right, a digit) is part of another word and doesn't count.
    """
    hits = []
    for end, (n, unit) in _automaton().iter(text):
        start = end + 1 - n
        if unit != "/":
            left, right = text[start - 1 : start], text[end + 1 : end + 2]
            if text[start].isalpha() and left.isalpha() or text[end].isalpha() and (right.isalnum()):
                continue
            if text[start].isdigit() and (left.isdigit() or left in (".", ",") and left):
                continue
        hits.append((start, n, unit))
    taken: list[tuple[int, int, str]] = []  # in order; what overlaps a place can only be beside it

    def free(start: int, end: int) -> bool:
        k = bisect.bisect_left(taken, (start, 0, ""))
        return (k == len(taken) or end <= taken[k][0]) and (k == 0 or sum(taken[k - 1][:2]) <= start)

    for start, n, unit in sorted(hits, key=lambda h: (-h[1] if h[2] != "/" else 0, h[0])):
        if free(start, start + n):
            bisect.insort(taken, (start, n, unit))
    out = [(s, "/" if u == "/" else "u", u) for s, _, u in taken]
    out += [(m.start(), "#", read_number(m.group())) for m in _NUMBER.finditer(text) if free(m.start(), m.end())]
    return [(kind, value) for _, kind, value in sorted(out, key=lambda t: t[0])]


def parse_strength(text: str | None, denominator: bool = False) -> tuple | None:
    """(value or None, unit or None, per value or None, per unit or None) named in a text.

    Unit texts, strength texts and bare units have one grammar: [number] unit [separator [number]
    unit]. None where the text names nothing; unit 'other' where it names a unit of another kind.
    """
    if text is None:
        return None
    text = " " + _CLEAN.sub(" ", text).strip().lower() + " "
    toks = _tokens(text)
    value = unit = per = per_unit = None
    side = 1 if denominator else 0
    for i, (kind, x) in enumerate(toks):
        following = toks[i + 1] if i + 1 < len(toks) else ("", None)
        if kind == "/":
            if unit is not None or value is not None or denominator:
                side = 1
        elif kind == "#":
            if side == 0 and unit is None and following[0] == "u":
                value = x
            elif side == 0 and unit is None and value is None:
                value = x
            elif side == 1 and per is None and per_unit is None:
                per = x
        elif x in ("%", "w/v", "w/w"):
            if x == "%" and unit is None:
                unit = "%"
            elif unit == "%":
                unit = f"% {x}"
        elif side == 0 and unit is None:
            unit = x
        elif per_unit is None:
            per_unit = x
    if unit is None and value is None and per is None and per_unit is None:
        return None
    return value, unit, per, per_unit


@lru_cache(100_000)
def _parsed(text: str, denominator: bool) -> tuple | None:
    return parse_strength(text, denominator)


def _parse_udf(denominator: bool):
    def parse(texts: pd.Series) -> pd.DataFrame:
        rows = [_parsed(t, denominator) if isinstance(t, str) else None for t in texts]
        rows = [(None, None, None, None) if r is None else r for r in rows]
        out = pd.DataFrame(rows, columns=["value", "unit", "per", "per_unit"])
        return out.astype({"value": "float64", "per": "float64", "unit": "object", "per_unit": "object"})

    return F.pandas_udf(parse, "value double, unit string, per double, per_unit string")


def conversion_factors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FACTORS, "unit string, dimension string, factor double")


def to_common_units(spark: SparkSession, stated: DataFrame, keys: list[str]) -> DataFrame:
    """keys, amount, amount_unit, per_unit of rows (keys, num, num_text, den, den_text, free_text).

    num and den are the numbers in fields of their own; num_text and den_text their units' texts,
    free_text a strength in words. A field's own unit holds before the text's. A number in a unit's
    text multiplies the field's number, or is the number if the field is null. Rows without a value
    or unit, with a zero denominator, or measured otherwise (equivalents, moles, activity, drops,
    dilutions, pH) are left out. Nulls, blanks and texts of any length are allowed.
    """
    num, den, free = _parse_udf(False), _parse_udf(True), _parse_udf(False)
    blank = lambda c: F.when(F.trim(c) != "", F.col(c))
    read = stated.select(
        *keys, F.col("num").cast("double").alias("num"), F.col("den").cast("double").alias("den"),
        num(blank("num_text")).alias("n"), den(blank("den_text")).alias("d"), free(blank("free_text")).alias("t"),
        F.trim("den_text").alias("den_text"), F.trim("num_text").alias("num_text"),
    )
    own = F.col("n.unit").isNotNull() | F.coalesce(F.col("num_text") != "", F.lit(False))
    unit = F.when(own, F.col("n.unit")).otherwise(F.col("t.unit"))
    # a number in the text multiplies the field's, unless the field repeats what the text says whole
    value = (
        F.when(own, F.when(F.col("num").isNull(), F.coalesce("n.value", "t.value")).otherwise(F.col("num") * F.coalesce("n.value", F.lit(1.0))))
        .when(F.col("num").isNull(), F.col("t.value"))
        .otherwise(F.col("num"))
    )
    named = F.coalesce(F.col("den_text") != "", F.lit(False)) & ~F.coalesce(F.col("den_text").rlike(r"^[\d.,]+$"), F.lit(False))
    per_unit = F.when(named, F.coalesce("d.per_unit", F.lit("other"))).when(own & F.col("n.per_unit").isNotNull(), F.col("n.per_unit")).otherwise(
        F.when(own & F.col("num").isNotNull(), F.lit(None)).otherwise(F.col("t.per_unit"))
    )
    per = F.coalesce("den", F.lit(1.0)) * F.coalesce("d.per", F.lit(1.0)) * F.coalesce(
        F.when(own, F.col("n.per")).when(F.col("num").isNull(), F.col("t.per")).otherwise(F.col("t.per")), F.lit(1.0)
    )
    percent = unit.startswith("%")
    said = read.select(
        *keys, value.alias("value"),
        F.when(percent, F.lit("g")).otherwise(unit).alias("unit"),
        F.when(percent, F.lit(100.0)).otherwise(per).alias("per"),
        F.when(unit == "% w/v", F.lit("ml")).when(unit == "% w/w", F.lit("g")).when(percent, F.lit("other")).otherwise(F.coalesce(per_unit, F.lit("each"))).alias("per_name"),
    )
    factors = conversion_factors(spark)
    a = F.broadcast(factors.where("dimension in ('mass', 'iu')").toDF("unit", "dim", "f"))
    b = F.broadcast(factors.where("dimension in ('mass', 'volume', 'piece')").toDF("per_name", "per_dim", "per_f"))
    # grams count as micrograms in FACTORS; a denominator of mass is wanted in grams
    scale = F.when(F.col("per_dim") == "mass", F.col("per_f") / 1e6).otherwise(F.col("per_f"))
    return (
        said.where("value is not null and per <> 0")
        .join(a, "unit")
        .join(b, "per_name")
        .select(
            *keys,
            F.round(F.col("value") * F.col("f") / (F.col("per") * scale)).cast("long").alias("amount"),
            F.when(F.col("dim") == "mass", "ug").otherwise("iu").alias("amount_unit"),
            F.when(F.col("per_dim") == "mass", "g").when(F.col("per_dim") == "volume", "ml").otherwise("each").alias("per_unit"),
        )
    )


def spl_strengths(documents: DataFrame) -> DataFrame:
    """(table_name, row_key, num, num_text, den, den_text, free_text) of every ingredient."""
    one = documents.select("document_id", F.posexplode("ingredients").alias("pos", "i")).where("document_id is not null and i is not null")
    return one.select(
        F.lit("spl_documents").alias("table_name"), F.concat_ws("/", "document_id", "pos").alias("row_key"),
        F.col("i.quantity_numerator").alias("num"), F.col("i.quantity_numerator_unit").alias("num_text"),
        F.col("i.quantity_denominator").alias("den"), F.col("i.quantity_denominator_unit").alias("den_text"),
        F.col("i.strength_text").alias("free_text"),
    )


def product_strengths(ingredients: DataFrame) -> DataFrame:
    rows = ingredients.where("product_version_id is not null and ingredient_id is not null")
    none = F.lit(None)
    return rows.select(
        F.lit("product_ingredients").alias("table_name"), F.concat_ws("/", "product_version_id", "ingredient_id").alias("row_key"),
        F.col("quantity").cast("double").alias("num"), F.col("unit").alias("num_text"),
        none.cast("double").alias("den"), none.cast("string").alias("den_text"), none.cast("string").alias("free_text"),
    )
