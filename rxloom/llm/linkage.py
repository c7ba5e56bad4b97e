"""Matching entities of two sources without a shared key (problem 3).

Candidates share a pair of partial attributes (a word of the maker with an ingredient or the name's
first word, the name's word with an ingredient) or a whole brand name. Each candidate is compared
attribute by attribute; the comparisons' levels make its pattern. What a pattern is worth is estimated
from the data: expectation maximisation over the counts of patterns separates pairs of one product,
siblings (like one product, but for one attribute) and unrelated pairs. It gives the share of each kind and
how often each level of an attribute occurs in it. The only prior knowledge is that attributes of one
product seldom contradict each other (CONFLICT).

Loopy belief propagation with one-to-one factors then lets candidates of one record compete: messages
go along the candidate pairs by grouped sums until they no longer change, and each pair's marginal
probability is its confidence. A factor excludes that one record is two products: candidates of a
record compete if they are variants that contradict each other (another strength, form, line extension
or branch); several deliveries of one product don't compete, and every pair of them is a case. Messages
are summed by variant before they meet, so no record's candidates are paired with each other. Records
with equal attributes are compared once.

Every candidate is compared in Arrow batches of Python, as names, strengths and ingredients need more
than equality; messages and candidates are plain joins and aggregations.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import warnings
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rxloom.llm.names import _TAIL, BRANCHES, TRADE
from rxloom.operators.nested import parse_record
from rxloom.operators.units import FACTORS, parse_strength
from rxloom.session import Scratch

#: Dosage forms by their words, line extensions, and words that don't tell substances apart.
FORMS = {
    "tablet": ["tablet", "tablets", "tab", "tabs", "caplet", "caplets"], "capsule": ["capsule", "capsules", "cap", "caps", "softgel", "softgels"], "cream": ["cream", "creme"], "ointment": ["ointment", "oint"],
    "suspension": ["suspension", "susp"], "solution": ["solution", "soln"], "injection": ["injection", "inj", "injectable"], "gel": ["gel"], "lotion": ["lotion"], "patch": ["patch", "patches"], "spray": ["spray"], "powder": ["powder"],
    "drops": ["drops"], "syrup": ["syrup"], "lozenge": ["lozenge", "lozenges"], "suppository": ["suppository", "suppositories"],
}
_FORM_OF = {w: f for f, ws in FORMS.items() for w in ws}
EXTENSIONS = frozenset("xr er sr cr ir dr la xl cd odt duo night day forte plus max ultra extra pm am jr junior pediatric kids hct dm mini lite advance advanced rapid fast long sensitive strong 2 3 ii iii".split())
_NOISE = frozenset("rx otc brand oral topical film coated for and the of with in usp nf".split())
_SALTS = frozenset(
    "acetate acet citrate citr hydrochloride hcl hydrochlor maleate maleat potassium k sodium na sulfate sulphate sulf phosphate tartrate mesylate fumarate succinate nitrate bromide chloride calcium magnesium salt usp nf "
    "unspecified form anhydrous monohydrate dihydrate hydrate base acid ep bp micronized".split()
)
_STRENGTH = re.compile(r"(?<![\w])\d[\d,.]*\s*(?:mg|mcg|ug|µg|μg|g|gm|kg|ng|iu|i\.u\.|\[iu\]|k\[iu\]|million iu|international units|units|meq|mmol|%)(?:\s*(?:/|per)\s*(?:\d[\d.]*\s*)?(?:ml|g|l|dl|kg|mg|tablet|capsule|dose|each|ea|1|cc|gram))?(?![\w])", re.I)
_UNIT = {u: (d, f) for u, d, f in FACTORS}

STEPS, SETTLED, KEEP = 200, 1e-3, -6.0

#: The levels of each attribute's comparison, with a first guess of their shares among pairs of one product
#: and among unrelated ones; "none" (unknown on a side) speaks neither for nor against, "diff" is a contradiction.
LEVELS = {
    "branch": {"same": (0.998, 0.9), "diff": (0.002, 0.1)},
    "maker": {"same": (0.6, 0.3), "close": (0.2, 0.1), "near": (0.1, 0.05), "cut": (0.098, 0.05), "diff": (0.002, 0.5)},
    "name": {"same": (0.5, 0.1), "near": (0.2, 0.1), "generic": (0.268, 0.1), "mixed": (0.03, 0.1), "diff": (0.002, 0.6)},
    "form": {"same": (0.998, 0.5), "diff": (0.002, 0.5)},
    "ingredients": {"same": (0.9, 0.4), "coded": (0.068, 0.05), "partly": (0.03, 0.05), "diff": (0.002, 0.5)},
    "strength": {"same": (0.998, 0.3), "diff": (0.002, 0.7)},
}
#: Share of contradictions in an attribute among pairs of one product; pairs by which first guesses are held.
CONFLICT, GUESSED = 0.002, 20.0


@lru_cache(200_000)
def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, changes and swaps of neighbours; most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, two[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return min(one[-1], most + 1)


def alike(a: str, b: str) -> bool:
    """Few edits for their length, or an abbreviation of four letters or more."""
    if a == b:
        return True
    n = max(len(a), len(b))
    return edits(a, b, 2 if n >= 7 else 1) <= (2 if n >= 7 else 1) or (min(len(a), len(b)) >= 4 and (a.startswith(b) or b.startswith(a)) and n - min(len(a), len(b)) <= 9)


@lru_cache(50_000)
def maker(name: str | None) -> tuple[tuple[str, ...], str]:
    """(sorted words of the core, branches) of a maker's name."""
    if not name or not name.strip():
        return (), ""
    s = re.sub(_TAIL, "", " ".join(name.lower().split()))
    s = re.sub(r"[.'’`´]", "", re.sub(r"\[[^\]]*\]|\([^)]*\)", " ", s))
    s = " ".join(re.findall(r"[^\W_]+", s)).replace("animal health", "animalhealth").replace("hospital supply", "hospitalsupply")
    words = s.split()
    return tuple(sorted(w.translate(str.maketrans("01345", "oieas")) for w in words if w not in TRADE and w not in BRANCHES)), " ".join(sorted({w for w in words if w in BRANCHES}))


@lru_cache(50_000)
def base(name: str | None) -> str:
    """The word of a substance's name that isn't its salt or grade."""
    words = [w.translate(str.maketrans("01345", "oieas")) for w in re.findall(r"[^\W_]+", (name or "").lower())]
    return max((w for w in words if w not in _SALTS), key=len, default="")


def product_name(name: str | None) -> tuple[list[str], list[str], str, list]:
    """(words, line extensions, form, strengths) of a product's name."""
    if not name:
        return [], [], "", []
    said = [s for m in _STRENGTH.finditer(name) if (s := amount(m.group()))]
    words = re.findall(r"[^\W_]+", _STRENGTH.sub(" ", name).lower())
    form = next((_FORM_OF[w] for w in reversed(words) if w in _FORM_OF), "")
    more = sorted(w for w in words if w in EXTENSIONS)
    kept = [w.translate(str.maketrans("01345", "oieas")) for w in words if w not in _FORM_OF and w not in EXTENSIONS and w not in _NOISE]
    kept = kept[:1] + [w for w in kept[1:] if not (3 <= len(w) <= 4 and edits(w, "otc", 1) <= 1) and not (len(w) >= 4 and any(edits(w, f, 1) <= 1 for f in _FORM_OF if len(f) >= 5))]
    return kept, more, form, said


def amount(text: str | None, num=None, den=None, den_text: str | None = None) -> str:
    """A strength in common units as a text (micrograms or units a millilitre, gram or piece); '' if none."""
    r = parse_strength(text)
    if r is None:
        return ""
    value, unit, per, per_unit = r
    value = value if num is None else num * (1.0 if value is None else value)
    d = parse_strength(den_text, True) if den_text else None
    if d is not None and d[3]:
        per_unit = d[3]
    per = (1.0 if per is None else per) * (1.0 if den is None else den) * (1.0 if d is None or d[2] is None or d[3] is None else d[2])
    if unit in ("% w/v", "% w/w"):
        unit, per, per_unit = "g", 100.0, "ml" if unit == "% w/v" else "g"
    if value is None or unit not in _UNIT or not per:
        return ""
    (kind, f), (dim, g) = _UNIT[unit], _UNIT.get(per_unit or "each", ("other", 1.0))
    if kind not in ("mass", "iu") or dim == "other":
        return ""
    return f"{float(f'{value * f / (per * (g / 1e6 if dim == 'mass' else g)):.4g}'):g} {kind} {dim}"


def form_of(text: str | None) -> str:
    return next((_FORM_OF[w] for w in reversed(re.findall(r"[a-z]+", (text or "").lower())) if w in _FORM_OF and w != "solution"), "") or ("solution" if "solution" in (text or "").lower() else "")


def label_features(row: dict) -> dict:
    raw = parse_record(row["raw"]) or {}
    many = lambda v: v if isinstance(v, list) else [] if v is None else [v]
    fda = raw.get("openfda") if isinstance(raw.get("openfda"), dict) else {}
    first = lambda k: next((x for x in many(fda.get(k)) if isinstance(x, str) and x.strip()), None)
    products = [p for p in many(raw.get("products")) if isinstance(p, dict)]
    active = [a for p in products for a in many(p.get("active_ingredients")) if isinstance(a, dict)]
    listed = [x for x in (row["substance_name"] if row["substance_name"] is not None else []) if x] or [x for x in many(fda.get("substance_name")) if x] or [a["substance_name"] for a in active if a.get("substance_name")]
    if not listed:
        generic = re.sub(r",\s*(?:usp|nf|unspecified form|ep|bp)\b", "", (row["generic_name"] or ""), flags=re.I)
        listed = [g for g in re.split(r",\s+", generic) if g.strip()]
    strengths = {(base(a.get("substance_name")), s) for a in active if (s := amount(a.get("strength"))) and base(a.get("substance_name"))}
    uniis = {u for u in (row["unii"] if row["unii"] is not None else []) if u} | {u for u in many(fda.get("unii")) if isinstance(u, str) and u} | {a["unii"] for a in active if a.get("unii")}
    words, more, form, said = product_name(row["brand_name"] or first("brand_name"))
    forms = {f for p in products if (f := form_of(p.get("dosage_form")))}
    return _features(row["manufacturer_name"] or first("manufacturer_name"), words, more, forms or ({form} if form else set()), {base(x) for x in listed} - {""}, uniis, strengths, said)


def spl_features(row: dict) -> dict:
    active = [i for i in (row["ingredients"] if row["ingredients"] is not None else []) if i is not None and i["role"] != "inactive"]
    strengths, uniis, bases = set(), set(), set()
    for i in active:
        b = base(i["name"])
        bases.add(b)
        if i["unii"]:
            uniis.add(i["unii"])
        num, unit = i["quantity_numerator"], (i["quantity_numerator_unit"] or "").strip()
        num = None if num is None or num != num else num
        den = None if i["quantity_denominator"] is None or i["quantity_denominator"] != i["quantity_denominator"] else i["quantity_denominator"]
        s = amount(unit or i["strength_text"], num, den, i["quantity_denominator_unit"])
        if s and b:
            strengths.add((b, s))
    words, more, form, said = product_name(row["product_name"])
    own = form_of(row["dosage_form"]) or form
    return _features(row["manufacturer_name"], words, more, {own} if own else set(), bases - {""}, uniis, strengths, said)


def _features(named, words, more, forms, bases, uniis, strengths, said) -> dict:
    core, branch = maker(named)
    amounts = sorted({s for _, s in strengths} | set(said))
    generic = bool(words) and all(any(alike(w, b) for b in bases) or w in _SALTS for w in words)
    return {"maker": list(core), "branch": branch, "words": words, "more": more, "forms": sorted(forms), "bases": sorted(bases), "uniis": sorted(uniis), "strengths": sorted(map(list, strengths)), "said": sorted(set(said)), "amounts": amounts, "generic": generic}


def keys_of(f: dict) -> list[str]:
    """Pairs of partial attributes, and whole brand names, of which two records of one product share at least one."""
    whole = set(f["bases"]) | set(f["uniis"])
    parts = {b[:5] for b in f["bases"]} | set(f["uniis"])  # the ends of substances' names are much alike
    words = [w for house in (f["maker"], f.get("house") or []) for w in house]
    makers = {e for w in words for e in (w[:6], w[-4:])}
    first = {e for w in f["words"][:1] for e in ((w[:5],) if f["generic"] else (w[:5], w[-5:]))}
    brand = set() if f["generic"] else first
    keys = {f"m|{m}|{p}" for m in makers for p in parts} | {f"w|{w[:4]}|{p}" for w in words for p in whole} | {f"b|{b}|{p}" for b in brand for p in parts} | {f"x|{m}|{b}" for m in makers for b in first}
    return sorted(keys | ({"n|" + "".join(f["words"] + f["more"])} if brand else set()))


def _makers(a: list, b: list) -> str:
    if not a or not b:
        return "none"
    if a == b:
        return "same"
    x, y = "".join(a), "".join(b)
    if len(a) == 2 and len(b) == 2:
        crossed = min((edits(a[0], b[0], 2) + edits(a[1], b[1], 2)), (edits(a[0], b[1], 2) + edits(a[1], b[0], 2)))
        if crossed <= 4 and max(min(edits(p, q, 2) for q in b) for p in a) <= 2:
            return "close" if crossed <= 2 else "near"
        for p, q in ((0, 0), (0, 1), (1, 0), (1, 1)):
            m, n = a[1 - p], b[1 - q]
            if edits(a[p], b[q], 1) <= 1 and min(len(m), len(n)) >= 3 and (m.startswith(n) or n.startswith(m)):
                return "cut"
        return "diff"
    turned = "".join(reversed(b)) if len(b) == 2 else y
    around = "".join(reversed(a)) if len(a) == 2 else x
    return "close" if min(edits(x, y, 2), edits(x, turned, 2), edits(around, y, 2)) <= 2 else "diff"


def _maker(a: dict, b: dict) -> str:
    """Also by the commonest spelling under the document's DUNS."""
    said = [_makers(a["maker"], b["maker"])] + ([_makers(a["maker"], b["house"])] if b.get("house") else [])
    return min(said, key=["same", "close", "near", "cut", "diff", "none"].index)


def _ingredients(a: dict, b: dict) -> str:
    """Whether the active ingredients are the same, by name or by code."""
    n, m = len(a["bases"]), len(b["bases"])
    if not n or not m:
        return "none"
    if n != m:
        return "diff"
    codes_a, codes_b = a.get("codes", {}), b.get("codes", {})
    same = lambda x, y: alike(x, y) or (codes_a.get(x) is not None and codes_a.get(x) == codes_b.get(y))
    left = [x for x in a["bases"] if not any(same(x, y) for y in b["bases"])]
    right = [y for y in b["bases"] if not any(same(x, y) for x in a["bases"])]
    if not left and not right:
        return "same"
    if n >= 2 and len(left) == len(right) == 1:
        return "partly"
    # names that nothing is known of: the records' codes must account for them
    return "coded" if len(set(a["uniis"]) & set(b["uniis"])) >= n else "diff"


def _strength(a: dict, b: dict) -> str:
    """Strengths of the same ingredient must not differ."""
    agree = 0
    for x, s in a["strengths"]:
        theirs = {t for y, t in b["strengths"] if x == y or alike(x, y)}
        mine = {t for y, t in a["strengths"] if y == x}
        if theirs:
            if not (mine & theirs):
                return "diff"
            agree += 1
    for one, other in ((a, b), (b, a)):
        whole = {t for _, t in other["strengths"]}
        if one["said"] and whole and len(other["strengths"]) >= len(other["bases"]) and not set(one["said"]) & whole:
            return "diff"
    if a["said"] and b["said"]:
        if not set(a["said"]) & set(b["said"]) and not (len(a["bases"]) > 1):
            return "diff"
        agree += bool(set(a["said"]) & set(b["said"]))
    return "same" if agree or set(a["amounts"]) & set(b["amounts"]) else "none"


def _name(a: dict, b: dict) -> str:
    if not a["words"] or not b["words"]:
        return "none"
    if a["more"] == b["more"] and (a["generic"] or b["generic"]) and edits("".join(a["words"]), "".join(b["words"]), 2) <= 2:
        return "near"
    if a["generic"] and b["generic"]:
        return "generic" if a["more"] == b["more"] else "diff"
    if a["generic"] != b["generic"]:
        return "mixed"
    if a["more"] != b["more"]:
        x, y = ("".join(f["words"] + f["more"]) for f in (a, b))
        if x == y:
            return "same"
        # an extension with a slip of the pen is left among the words
        return "near" if min(len(x), len(y)) >= 8 and max(len(a["words"]), len(b["words"])) > 1 and edits(x, y, 1) <= 1 else "diff"
    x, y = "".join(a["words"]), "".join(b["words"])
    if x == y:
        return "same"
    return "near" if edits(x, y, 2) <= 2 and min(len(x), len(y)) >= 5 else "diff"


def pattern(a: dict, b: dict) -> str:
    """The levels of all attributes, in the order of LEVELS."""
    branch = "none" if not a["maker"] or not b["maker"] else "same" if a["branch"] == b["branch"] else "diff"
    form = "none" if not a["forms"] or not b["forms"] else "same" if set(a["forms"]) & set(b["forms"]) else "diff"
    return "|".join((branch, _maker(a, b), _name(a, b), form, _ingredients(a, b), _strength(a, b)))


def estimate(counts: dict[str, int], steps: int = 500) -> dict[str, float]:
    """The log-odds of each pattern: expectation maximisation over the counts of patterns.

    Kinds of pairs: "one" product; siblings, for each attribute those that contradict each other in it
    (or would, were it known) and are like one product in the rest; "other". Attributes are taken as
    independent within a kind. The number of patterns is bounded by the levels (at most 4860), so this
    runs on the driver.
    """
    told = {p: dict(zip(LEVELS, p.split("|"))) for p in counts}
    total = float(sum(counts.values()))
    guessed = dict.fromkeys(LEVELS, 0.3 / len(LEVELS)) | {"one": 0.3, "other": 0.4}
    share = guessed
    alike_, apart = ({k: {level: guess[side] for level, guess in levels.items()} for k, levels in LEVELS.items()} for side in (0, 1))
    odds: dict[str, float] = {}
    for _ in range(steps):
        belief, last, odds = {}, odds, {}
        for p, levels in told.items():
            fits = {k: 1.0 if level == "none" else alike_[k][level] for k, level in levels.items()}
            whole = math.prod(fits.values())
            weight = {k: share[k] * whole / fits[k] if levels[k] in ("diff", "none") else 0.0 for k in LEVELS}
            weight |= {"one": share["one"] * whole, "other": share["other"] * math.prod(1.0 if level == "none" else apart[k][level] for k, level in levels.items())}
            against = sum(v for kind, v in weight.items() if kind != "one")
            odds[p] = math.log(weight["one"] / against)
            belief[p] = {kind: v / (weight["one"] + against) for kind, v in weight.items()}
        if last and max(abs(odds[p] - last[p]) for p in odds) < 1e-4:
            break
        share = {kind: (sum(n * belief[p][kind] for p, n in counts.items()) + GUESSED * guessed[kind]) / (total + GUESSED) for kind in guessed}
        for k, levels in LEVELS.items():
            near, far = ({level: GUESSED * guess[side] for level, guess in levels.items()} for side in (0, 1))
            for p, n in counts.items():
                level = told[p][k]
                if level != "none":
                    far[level] += n * belief[p]["other"]
                    near[level] += n * (1 - belief[p]["other"] - belief[p][k])
            agreed = sum(v for level, v in near.items() if level != "diff")
            alike_[k] = {level: CONFLICT if level == "diff" else (1 - CONFLICT) * v / agreed for level, v in near.items()}
            apart[k] = {level: v / sum(far.values()) for level, v in far.items()}
    return odds


_PREPARED = "id long, features string, keys array<long>, amounts array<string>, forms array<string>, more string, branch string"


def _featured(kind: str):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [(label_features if kind == "label" else spl_features)(r) for r in batch.to_dict("records")]
            yield pd.DataFrame({"id": batch["id"], "features": [json.dumps(f, sort_keys=True) for f in made], "bases": [f["bases"] for f in made], "maker": [" ".join(f["maker"]) or None for f in made], "duns": batch["duns"]})

    return work


def _substances(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(base(n), u) for n, u in zip(batch["name"], batch["unii"]) if n and u and base(n)]
        yield pd.DataFrame(rows, columns=["base", "code"])


def substance_codes(labels: DataFrame, documents: DataFrame) -> DataFrame:
    """base, code: the code that goes with a substance's name most often (then the smallest)."""
    one = documents.select(F.explode("ingredients").alias("i")).select("i.name", "i.unii")
    two = labels.where(F.size("substance_name") == F.size("unii")).select(F.explode(F.arrays_zip("substance_name", "unii")).alias("i")).select(F.col("i.substance_name").alias("name"), F.col("i.unii").alias("unii"))
    told = one.unionByName(two).where("name is not null and unii is not null").mapInPandas(_substances, "base string, code string")
    return told.groupBy("base", "code").agg(F.count("*").alias("n")).groupBy("base").agg(F.min_by("code", F.struct(-F.col("n"), "code")).alias("code"))


def _prepared(scratch: Scratch, records: DataFrame, kind: str, codes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, rep) of all records, and _PREPARED of one record for each set of attributes.

    A record's house is the commonest maker's name among the records with its DUNS (then the least)."""
    made, _ = scratch.keep(records.mapInPandas(_featured(kind), "id long, features string, bases array<string>, maker string, duns string"))
    named = made.where("duns is not null and maker is not null").groupBy("duns", "maker").agg(F.count("*").alias("n"))
    house = named.groupBy("duns").agg(F.min_by("maker", F.struct(-F.col("n"), "maker")).alias("house"))
    housed, _ = scratch.keep(made.join(house, "duns", "left").select("id", "features", "bases", "house", F.xxhash64("features", "house").alias("h")))
    reps, _ = scratch.keep(housed.groupBy("h").agg(F.min("id").alias("rep")))
    members, _ = scratch.keep(housed.select("id", "h").join(reps, "h").select("id", "rep"))
    first = housed.join(members.where("id = rep").select("id"), "id")
    told = first.select("id", F.explode("bases").alias("base")).join(codes, "base").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("base", "code"))).alias("codes"))
    whole = first.join(told, "id", "left").select("id", "features", "house", F.to_json("codes").alias("codes"))
    kept, _ = scratch.keep(whole.mapInPandas(_keyed, _PREPARED))
    return members, kept


def _keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        made = [json.loads(f) | {"codes": json.loads(c) if c else {}, "house": h.split() if h else []} for f, c, h in zip(batch["features"], batch["codes"], batch["house"])]
        keys = [[int.from_bytes(hashlib.blake2b(k.encode(), digest_size=8).digest(), "little", signed=True) for k in keys_of(f)] for f in made]
        yield pd.DataFrame({
            "id": batch["id"], "features": [json.dumps(f) for f in made], "keys": keys, "amounts": [f["amounts"] for f in made], "forms": [f["forms"] for f in made],
            "more": [" ".join(f["more"]) if f["words"] else None for f in made], "branch": [f["branch"] if f["maker"] else None for f in made],
        })


def _compared(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """a, b, pattern of the records named by pairs (a, b)."""
    one = pairs.join(left.select(F.col("id").alias("a"), F.col("features").alias("fa")), "a").join(right.select(F.col("id").alias("b"), F.col("features").alias("fb")), "b")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = lru_cache(20_000)(json.loads)
        for batch in batches:
            batch["pattern"] = [pattern(read(x), read(y)) for x, y in zip(batch["fa"], batch["fb"])]
            yield batch[["a", "b", "pattern"]]

    return one.select("a", "b", "fa", "fb").mapInPandas(compare, "a long, b long, pattern string")


_VARIANT = ["amounts", "forms", "more", "branch"]


def _variants(prepared: DataFrame) -> DataFrame:
    """id, v and _VARIANT: records that could be one product as far as these go have the same v, or compatible ones."""
    return prepared.select("id", F.xxhash64(*_VARIANT).alias("v"), *_VARIANT)


def _contradict(x: str, y: str) -> Column:
    of = lambda c: (F.col(f"{x}.{c}"), F.col(f"{y}.{c}"))
    apart = lambda c: (F.size(of(c)[0]) > 0) & (F.size(of(c)[1]) > 0) & ~F.arrays_overlap(*of(c))
    return apart("amounts") | apart("forms") | F.coalesce(of("more")[0] != of("more")[1], F.lit(False)) | F.coalesce(of("branch")[0] != of("branch")[1], F.lit(False))


def rivals(pairs: DataFrame, record: str, variant: str, variants: DataFrame) -> DataFrame:
    """record, x, y (both ways): variants among a record's candidates that contradict each other.

    A record's candidates are first reduced to their distinct variants, however many they are."""
    held = pairs.select(record, F.col(variant).alias("v")).distinct()
    known = variants.select("v", *_VARIANT).dropDuplicates(["v"])
    met = held.alias("p").join(held.alias("q"), record).where("p.v < q.v").select(record, F.col("p.v").alias("x"), F.col("q.v").alias("y"))
    ask = met.select("x", "y").distinct().join(known.select(F.col("v").alias("x"), F.struct(*_VARIANT).alias("one")), "x").join(known.select(F.col("v").alias("y"), F.struct(*_VARIANT).alias("two")), "y")
    apart = met.join(ask.where(_contradict("one", "two")).select("x", "y"), ["x", "y"])
    return apart.select(record, "x", "y").unionByName(apart.select(record, F.col("y").alias("x"), F.col("x").alias("y")))


def propagate(spark: SparkSession, pairs: DataFrame, rivals_a: DataFrame, rivals_b: DataFrame, steps: int = STEPS, settled: float = SETTLED) -> DataFrame:
    """a, b, confidence of pairs (a, b, va, vb, w): marginals under the factors of a's and b's rivals.

    va and vb are the variants of a and b, rivals_a (a, x, y) those among a's candidates that exclude each
    other. Message of a about (a, b): odds / (1 + the sum of the messages to a of b's rivals); the same
    from b. A pair without rivals has its own odds as marginal. Written at each step, damped by half after
    two and more the longer it takes; it ends when no message changes by more than the share `settled`.
    If that isn't so after `steps`, a warning says by how much they still change.
    """
    scratch = Scratch(spark)
    odds = F.exp(F.least(F.greatest(F.col("w"), F.lit(-20.0)), F.lit(20.0)))
    whole, _ = scratch.keep(pairs.select("a", "b", "va", "vb", odds.alias("t")))
    ra, _ = scratch.keep(rivals_a.select("a", F.col("x").alias("vb"), F.col("y").alias("o")))
    rb, _ = scratch.keep(rivals_b.select("b", F.col("x").alias("va"), F.col("y").alias("o")))
    # only pairs with a rival take part in the messages
    touched, _ = scratch.keep(whole.join(ra.select("a", "vb").distinct(), ["a", "vb"], "left_semi").select("a", "b").unionByName(whole.join(rb.select("b", "va").distinct(), ["b", "va"], "left_semi").select("a", "b")).distinct())
    held, path = scratch.keep(whole.join(touched, ["a", "b"], "left_semi").withColumn("ma", F.col("t")).withColumn("mb", F.col("t")))
    confidence = (F.col("ma") * F.col("mb") / F.col("t")) / (1 + F.col("ma") * F.col("mb") / F.col("t"))
    if not held.isEmpty():
        for n in range(steps):
            old = 0.0 if n < 2 else 0.5 if n < 40 else 0.8
            mix = lambda c, s: (F.col(c) * old + F.col("t") / (1 + F.coalesce(s, F.lit(0.0))) * (1 - old)).alias(c)  # noqa: B023, E731
            to_a = ra.join(held.groupBy("a", F.col("vb").alias("o")).agg(F.sum("mb").alias("m")), ["a", "o"]).groupBy("a", "vb").agg(F.sum("m").alias("sa"))
            to_b = rb.join(held.groupBy("b", F.col("va").alias("o")).agg(F.sum("ma").alias("m")), ["b", "o"]).groupBy("b", "va").agg(F.sum("m").alias("sb"))
            moved = held.join(to_a, ["a", "vb"], "left").join(to_b, ["b", "va"], "left").select(
                "a", "b", "va", "vb", "t", mix("ma", F.col("sa")), mix("mb", F.col("sb")), F.col("ma").alias("wa"), F.col("mb").alias("wb")
            )
            apart = F.greatest(F.abs(F.log(F.col("ma") / F.col("wa"))), F.abs(F.log(F.col("mb") / F.col("wb"))))
            seen = Observation()  # taken while the round is written
            ahead, at = scratch.keep(moved.observe(seen, F.max(apart).alias("change")).drop("wa", "wb"))
            change = seen.get["change"]
            scratch.drop(path)
            held, path = ahead, at
            if change is None or change < settled:
                break
        else:
            warnings.warn(f"after {steps} rounds messages still change by a share of {change:.3g}", stacklevel=2)
    alone = whole.join(touched, ["a", "b"], "left_anti").select("a", "b", (F.col("t") / (1 + F.col("t"))).alias("confidence"))
    return held.select("a", "b", confidence.alias("confidence")).unionByName(alone)


def match_products(spark: SparkSession, labels: DataFrame, documents: DataFrame) -> DataFrame:
    """record_id, document_id, confidence of all candidates.

    A row given twice counts once. Nulls, blanks and unreadable raw texts leave attributes unknown, which
    speak neither for nor against a pair. Without candidates the result is empty.
    """
    scratch = Scratch(spark)
    digits = F.nullif(F.regexp_replace("manufacturer_duns", r"\D", ""), F.lit(""))
    left = labels.select(F.col("record_id").alias("id"), "brand_name", "generic_name", "manufacturer_name", "substance_name", "unii", "raw", F.lit(None).cast("string").alias("duns")).where("id is not null").dropDuplicates(["id"])
    right = documents.select(F.col("document_id").alias("id"), "product_name", "dosage_form", "manufacturer_name", "ingredients", digits.alias("duns")).where("id is not null").dropDuplicates(["id"])
    codes, _ = scratch.keep(substance_codes(labels, documents))
    members_a, fa = _prepared(scratch, left, "label", codes)
    members_b, fb = _prepared(scratch, right, "spl", codes)
    key = lambda df, c: df.select(F.col("id").alias(c), F.explode("keys").alias("k"))
    met, _ = scratch.keep(key(fa, "a").join(key(fb, "b"), "k").select("a", "b").distinct())
    compared, _ = scratch.keep(_compared(met, fa, fb))
    odds = estimate({r[0]: r[1] for r in compared.groupBy("pattern").count().collect()})  # one row a pattern
    worth = F.broadcast(spark.createDataFrame(list(odds.items()), "pattern string, w double"))
    va, vb = _variants(fa), _variants(fb)
    likely = compared.join(worth, "pattern").where(F.col("w") > KEEP)
    pairs, _ = scratch.keep(likely.join(va.select(F.col("id").alias("a"), F.col("v").alias("va")), "a").join(vb.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b").select("a", "b", "va", "vb", "w"))
    sure = propagate(spark, pairs, rivals(pairs, "a", "vb", vb), rivals(pairs, "b", "va", va))
    whole = sure.join(members_a.select(F.col("rep").alias("a"), F.col("id").alias("record_id")), "a").join(members_b.select(F.col("rep").alias("b"), F.col("id").alias("document_id")), "b")
    return whole.select("record_id", "document_id", "confidence")
