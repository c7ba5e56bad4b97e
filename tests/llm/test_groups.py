"""Components, near-duplicates, names and linkage against brute force and hand-made cases."""

import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("rxloom.llm.queries")
from rxloom.llm import components, linkage, names, neardup  # noqa: E402


def brute_groups(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {n: find(n) for n in list(parent)}


SHAPES = {
    "path": [(i, i + 1) for i in range(60)], "star": [(99, i) for i in range(40)], "hub first": [(0, i) for i in range(40)], "ring": [(i, (i + 7) % 30) for i in range(30)],
    "repeats": [(1, 2), (2, 1), (1, 2), (3, 3), (None, 4), (5, None)], "zigzag": [(i if i % 2 else 100 - i, i + 1 if (i + 1) % 2 else 100 - (i + 1)) for i in range(40)], "empty": [], "only loops": [(1, 1), (None, None)],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_components(spark, shape):
    edges = SHAPES[shape]
    got = components.connected_components(spark, spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == brute_groups(edges)


def test_random_components_of_texts(spark):
    r = random.Random(3)
    edges = [(f"N{r.randrange(300)}", f"N{r.randrange(300)}") for _ in range(170)]
    got = components.connected_components(spark, spark.createDataFrame(edges, "a string, b string"))
    assert {x.node: x.component for x in got.collect()} == brute_groups(edges)


# -- near-duplicates ----------------------------------------------------------------------------------


def brute_duplicates(rows):
    sets = {}
    for i, t in rows:
        w = frozenset(re.findall(r"[^\W_]+", (t or "").lower()))
        if w and i is not None:
            sets.setdefault(w, set()).add(i)
    ks = list(sets)
    edges = [(min(sets[a]), min(sets[b])) for x, a in enumerate(ks) for b in ks[:x] if len(a & b) >= 0.8 * len(a | b) - 1e-9]
    groups = brute_groups(edges)
    out = set()
    for k in ks:
        g = groups.get(min(sets[k]), min(sets[k]))
        members = {i for q in ks if groups.get(min(sets[q]), min(sets[q])) == g for i in sets[q]}
        if len(members) > 1:
            out |= {(i, min(members)) for i in sets[k]}
    return out


def edited(r, words):
    out = list(words)
    for _ in range(r.randrange(0, 4)):
        k, at = r.randrange(3), r.randrange(len(out))
        if k == 0:
            out[at] = f"new{r.randrange(10**6)}"
        elif k == 1:
            out.insert(at, f"more{r.randrange(10**6)}")
        else:
            out.append(out.pop(at))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_near_duplicates(spark, seed):
    r = random.Random(seed)
    rows = [(None, "x y z"), (900, None), (901, ""), (902, " \n"), (903, "— … —"), (904, "One"), (905, "one ONE"), (906, "word " * 50_000), (907, "word")]
    for g in range(25):
        words = [f"w{r.randrange(4000)}" for _ in range(r.randrange(8, 60))]
        for _ in range(r.choice([1, 1, 2, 5, 12])):
            words = edited(r, words) if r.random() < 0.8 else words
            rows.append((len(rows), " ".join(words) if r.random() < 0.7 else ", ".join(words).upper()))
    rows += rows[:30]
    df = spark.createDataFrame([(i, t, "clash", 5) for i, t in rows], "id long, text string, fp string, sid long")
    got = neardup.near_duplicates(spark, df)
    assert {(x.id, x.group_id) for x in got.collect()} == brute_duplicates(rows)
    spread = neardup.near_duplicates(spark, df.repartition(7), parts=3, part_bytes=512)  # every part in many tasks
    assert {(x.id, x.group_id) for x in spread.collect()} == brute_duplicates(rows)


def test_second_pass_finds_links_a_star_misses(spark):
    """One large bucket in which many members are no neighbours of its first."""
    base = [f"b{i}" for i in range(40)]
    rows = [(k, " ".join(base[: 40 - k] + [f"c{i}" for i in range(k)])) for k in range(0, 40, 2)]
    df = spark.createDataFrame(rows, "id long, text string")
    got = neardup.near_duplicates(spark, df, bands=24, rows=2)
    spread = neardup.near_duplicates(spark, df.repartition(5), bands=24, rows=2, parts=2, part_bytes=64)
    assert {(x.id, x.group_id) for x in spread.collect()} == brute_duplicates(rows)
    assert {(x.id, x.group_id) for x in got.collect()} == brute_duplicates(rows)


def test_no_texts(spark):
    assert neardup.near_duplicates(spark, spark.createDataFrame([], "id long, text string")).count() == 0
    assert neardup.near_duplicates(spark, spark.createDataFrame([(1, "a b"), (2, None)], "id long, text string")).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    pi = neardup._pi(neardup.UNIVERSE, 512)
    for share in (0.2, 0.5, 0.8, 0.95):
        found = []
        for _ in range(40):
            both, rest = int(200 * share), (200 - int(200 * share)) // 2
            pool = rng.integers(1, 2**62, 200, dtype=np.uint64)
            two = [np.r_[pool[:both], pool[both : both + rest]], np.r_[pool[:both], pool[both + rest : both + 2 * rest]]]
            sig = neardup.signatures([neardup.slots_of(h, neardup.UNIVERSE) for h in two], pi, 512)
            found.append((sig[0] == sig[1]).mean())
        assert abs(np.mean(found) - share) < 0.02


# -- names -------------------------------------------------------------------------------------------


def organisations(spark, rows):
    got = names.same_organisation(spark, spark.createDataFrame([(i, n, "x") for i, n in rows], "manufacturer_id string, name string, node string"))
    out = {}
    for x in got.collect():
        out.setdefault(x.organisation, set()).add(x.manufacturer_id)
    return sorted(map(sorted, out.values()))


def test_variant_spellings(spark):
    rows = [
        ("M01", "Dedemix Romebe Therapeutics S.A."), ("M02", "DedemixRomebe Therap., SA"), ("M03", "ROMEBE DEDEMIX THPX"), ("M04", "Ddemix Romeeb (USA)"), ("M05", "The Dedemix Romebe, f/k/a Sileka"),
        ("M06", "Dedemix Romebe Dental Therapeutics S.A."), ("M07", "Dedemix Romebe Canada S.A."), ("M08", "Dedemix Fakuter Therapeutics S.A."), ("M09", "Demada Nag. Biosciences Co"), ("M10", "Demada Naganor Biosciences Co."),
        ("M11", None), ("M12", "  "), ("M13", "Laboratories Inc."), ("M01", "Dedemix\xa0Romebe Bio Sciences [labeler]"), ("M01", "Dedemix Romebe Therapeutics S.A."), (None, "Dedemix Romebe"), ("M14", "x" * 20_000),
    ]
    assert organisations(spark, rows) == [["M01", "M02", "M03", "M04", "M05"], ["M06"], ["M07"], ["M08"], ["M09", "M10"], ["M14"]]


def test_no_names(spark):
    assert organisations(spark, []) == [] and organisations(spark, [("M1", None)]) == []


def test_cosines_equal_brute_force(spark):
    r = random.Random(1)
    words = ["".join(r.choice("bdfgk") + r.choice("aeiou") for _ in range(3)) for _ in range(40)]
    cores = [(i, "", sorted(r.sample(words, 2))) for i in range(60)] + [(60 + i, "", ["".join(r.sample(words, 2))]) for i in range(8)] + [(70, "", ["bo"]), (71, "", ["b"])]
    grams = lambda w: [f"^{w}$"[i : i + 3] for i in range(len(w))]
    parts = {w for _, _, c in cores for w in c}
    df = {}
    for w in parts:
        for g in set(grams(w)):
            df[g] = df.get(g, 0) + 1
    weight = {g: np.sqrt(np.log(1 + len(parts) / max(n, names.SELDOM))) for g, n in df.items()}
    scaled = lambda v: {k: x / np.sqrt(sum(y * y for y in v.values())) for k, x in v.items()}
    part = lambda w: scaled({g: weight[g] for g in grams(w)})

    def vector(c):
        one = part(c[0])
        if len(c) == 2:
            pairs = [((a, b), x * y) for a, x in one.items() for b, y in part(c[1]).items()]
        else:
            order = list(dict.fromkeys(grams(c[0])))
            at = {g: grams(c[0]).index(g) for g in order}
            gap = 4 if len(order) >= 8 else 1 if len(order) > 1 else 0
            pairs = [((a, b), one[a] * one[b]) for a in order for b in order if at[b] >= at[a] + gap]
        v = {}
        for k, x in pairs:
            v[tuple(sorted(k))] = v.get(tuple(sorted(k)), 0) + x
        return v if len(c) == 2 else scaled(v)

    vectors = {i: vector(c) for i, _, c in cores}
    want = {(a, b): min(1.0, sum(x * vectors[b].get(k, 0) for k, x in vectors[a].items())) for a in vectors for b in vectors if a < b}
    got = names.cosine_join(spark.createDataFrame(cores, "node long, block string, core array<string>"), 0.1)
    found = {(x.a, x.b): round(x.cosine, 6) for x in got.collect()}
    assert found == {k: round(v, 6) for k, v in want.items() if v >= 0.1} and any(a < 60 <= b for a, b in found)


def test_long_names(spark):
    """Parts of more than GRAMS trigrams, and names of more than a hundred words, are compared too."""
    r = random.Random(5)
    word = lambda n: "".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(n))
    long, other, many = word(40), word(40), [word(3) for _ in range(150)]
    rows = [
        ("A1", f"{long} Sutegam Inc."), ("A2", f"Sutegam {long[:33]}x{long[34:]}"), ("B1", f"{other} Sutegam"), ("C1", " ".join(many)), ("C2", " ".join(many[:-1] + [many[-1] + "q"])),
        ("D1", " ".join(word(3) for _ in range(150))), ("E1", "3M Company"), ("E2", "3M Co."), ("F1", "Fisar"), ("F2", "Fisarr Ltd"),
    ]
    assert organisations(spark, rows) == [["A1", "A2"], ["B1"], ["C1", "C2"], ["D1"], ["E1", "E2"], ["F1", "F2"]]


def test_long_parts_are_compared_whole(spark):
    """Two long parts differ only in their second halves: every trigram counts, none stands for others."""
    r = random.Random(11)
    word = lambda n: "".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(n))
    head = word(60)
    cores = [(1, "", [head + word(60), "zz"]), (2, "", [head + word(60), "zz"])]
    grams = [{f"^{c[0]}$"[i : i + 3] for i in range(len(c[0]))} for _, _, c in cores]
    weight = lambda _: np.sqrt(np.log(1 + 3 / names.SELDOM))
    want = sum(weight(g) ** 2 for g in grams[0] & grams[1]) / np.prod([np.sqrt(sum(weight(g) ** 2 for g in v)) for v in grams])
    got = names.cosine_join(spark.createDataFrame(cores, "node long, block string, core array<string>"), 0.1).collect()
    assert [(x.a, x.b, round(x.cosine, 6)) for x in got] == [(1, 2, round(want, 6))]


def test_cosines_in_slices(spark):
    """Slices and chunks of any size give the same cosines, and only those over the threshold are written."""
    r = random.Random(3)
    words = ["".join(r.choice("bdfgk") + r.choice("aeiou") for _ in range(3)) for _ in range(30)]
    cores = spark.createDataFrame([(i, "", sorted(r.sample(words, 2))) for i in range(80)], "node long, block string, core array<string>")
    pairs = lambda df: sorted((x.a, x.b, round(x.cosine, 9)) for x in df.collect())
    whole = pairs(names.cosine_join(cores, 0.1))
    assert pairs(names.cosine_join(cores, 0.1, slice_rows=500, products=50)) == whole and len(whole) > 50


def test_average_linkage():
    near = {(1, 2): 0.9, (2, 3): 0.8, (1, 3): 0.7, (3, 4): 0.6, (4, 5): 0.9}
    assert names.average_linkage(dict.fromkeys([1, 2, 3, 4, 5], 1), near, 0.55) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
    assert names.average_linkage({}, {}, 0.5) == {}
    # the mean is over records: a spelling of many records holds its variants together
    star = {(1, 2): 0.6, (1, 3): 0.6, (2, 3): 0.1}
    assert names.average_linkage({1: 9, 2: 1, 3: 1}, star, 0.5) == {1: 1, 2: 1, 3: 1}
    assert names.average_linkage({1: 1, 2: 1, 3: 1}, star, 0.5) == {1: 1, 2: 2, 3: 1}


def test_linkage_of_large_groups(spark):
    r = random.Random(3)
    ids = [r.randrange(-(2**63), 2**63) for _ in range(3_000)]
    chain = {(min(p), max(p)): r.choice([0.3, 0.5, 0.7, 0.9]) for p in zip(ids[:2_600], ids[1:2_600])}
    crowd = {}
    while len(crowd) < 700:
        a, b = r.sample(ids[2_600:2_700], 2)
        crowd[(min(a, b), max(a, b))] = r.choice([0.3, 0.5, 0.7, 0.9])
    near, records = chain | crowd, {i: r.choice([1, 1, 2, 5]) for i in ids}
    links = spark.createDataFrame([(*p, s) for p, s in near.items()], "a long, b long, likeness double")
    cores = spark.createDataFrame(list(records.items()), "node long, records long")
    want = {i: i for i in ids} | names.average_linkage({n: records[n] for p in near for n in p}, near, names.CLUSTER)
    assert len({want[i] for i in ids[:2_600]}) > 300
    assert {x.node: x.cluster for x in names.cluster_cores(spark, cores, links).collect()} == want
    weighed = spark.createDataFrame([(*p, s, records[p[0]], records[p[1]]) for p, s in near.items()], "a long, b long, likeness double, na long, nb long")
    assert {x.node: x.cluster for x in names.distributed_linkage(spark, weighed, names.CLUSTER).collect()} == {n: want[n] for p in near for n in p}


# -- linkage --------------------------------------------------------------------------------------------


def label(i, brand, maker, substances, uniis, strength, form="TABLET", **more):
    raw = {"products": [{"dosage_form": form, "active_ingredients": [{"substance_name": s, "strength": strength} for s in substances]}]}
    return (i, brand, ", ".join(substances), maker, substances, uniis, more.get("raw", json.dumps(raw)))


def doc(i, name, maker, substances, unii, num, unit, form="TABLET", duns=None):
    return (i, name, form, maker, duns, [(s, "active", unii, num, unit, 1.0, "1", None) for s in substances])


LABELS = "record_id long, brand_name string, generic_name string, manufacturer_name string, substance_name array<string>, unii array<string>, raw string"
DOCS = "document_id long, product_name string, dosage_form string, manufacturer_name string, manufacturer_duns string, ingredients array<struct<name:string,role:string,unii:string,quantity_numerator:double,quantity_numerator_unit:string,quantity_denominator:double,quantity_denominator_unit:string,strength_text:string>>"


def found(spark, labels, docs):
    got = linkage.match_products(spark, spark.createDataFrame(labels, LABELS), spark.createDataFrame(docs, DOCS))
    return {(x.record_id, x.document_id): x.confidence for x in got.collect()}


def test_products_are_matched(spark):
    labels = [
        label(1, "Fudakupakix Tablets", "Demada Naganor Biosciences Co.", ["SISURANOAMIDE HCL"], ["6EAHJ4RB3K"], "0.75 g"),
        label(2, "Fudakupakix Forte", "Demada Naganor Biosciences Co.", ["SISURANOAMIDE HCL"], ["6EAHJ4RB3K"], "0.75 g"),
        label(3, "Fudakupakix 5 mg", "The Demada Naganor Bio Sciences", ["sisuranoamide hydrochloride"], [None], None),
        label(4, "Fudakupakix", "Demada Naganor Dental Co.", ["SISURANOAMIDE"], [], "750 mg"), label(5, None, None, [], None, None, raw="{cut"), (None, None, None, None, None, None, None),
    ]
    docs = [
        doc(11, "FUDAKUPAKIX Tablet 750 mg", "Naganor Demada", ["Sisuranoamide hydrochlor."], "6EAHJ4RB3K", 750.0, "mg"), doc(12, "Fudakupakix tablets", "Demada Nagaonr Biosci.", ["SISURANOAMIDE"], None, 5000.0, "mcg"),
        doc(13, None, None, [], None, None, None), (14, None, None, None, None, None), (None, "x", "y", "z", None, None),
    ]
    got = found(spark, labels + labels[:2], docs + docs[:1])
    assert {p for p, c in got.items() if c >= 0.5} == {(1, 11), (3, 12)}
    assert found(spark, [], []) == {} and found(spark, labels[:1], []) == {}


def test_rivals_share_and_copies_do_not(spark):
    """Two documents of different strengths compete for a label that names none; copies don't."""
    maker, kind = "Demada Naganor Co.", ["SISURANOAMIDE"]
    unknown = [label(1, "Fudakupakix Tablets", maker, kind, ["U1"], None)]
    five, ten = doc(11, "Fudakupakix 5 mg", maker, kind, "U1", 5.0, "mg"), doc(12, "Fudakupakix 10 mg", maker, kind, "U1", 10.0, "mg")
    both = found(spark, unknown, [five, ten])
    assert set(both) == {(1, 11), (1, 12)} and all(c <= 0.5 for c in both.values())
    again = doc(13, "FUDAKUPAKIX tablets", maker, kind, "U1", 0.005, "g")
    assert {p for p, c in found(spark, unknown, [five, again]).items() if c >= 0.5} == {(1, 11), (1, 13)}


def test_a_maker_is_known_by_its_duns(spark):
    """A distorted maker's name counts as the commonest one under the document's DUNS."""
    labels = [label(1, "Fudakupakix", "Demada Naganor Co.", ["SISURANOAMIDE"], ["U1"], "750 mg")]
    odd = lambda duns: doc(13, "Fudakupakix", "Dmd Ngnr Intl", ["SISURANOAMIDE"], "U1", 750.0, "mg", duns=duns)
    others = [doc(20 + n, f"Other{n}", "Demada Naganor Co.", ["KODOSINE"], "U2", 1.0, "mg", duns="12-345-6789") for n in range(3)]
    assert found(spark, labels, [odd("123456789"), *others])[(1, 13)] >= 0.5
    assert found(spark, labels, [odd(None), *others]).get((1, 13), 0.0) < 0.5


def test_weights_are_estimated():
    """Siblings that differ in strength are told from one product, though they are alike in all else."""
    counts = {"same|same|same|same|same|same": 500, "same|close|near|same|same|same": 300, "same|same|same|same|same|diff": 300, "same|same|same|same|same|none": 90, "same|diff|diff|diff|diff|diff": 900, "same|diff|generic|same|diff|none": 200}
    odds = linkage.estimate(counts)
    assert {p for p, w in odds.items() if w >= 0} == {p for p in counts if "diff" not in p}
    assert 0 < odds["same|same|same|same|same|none"] < odds["same|same|same|same|same|same"] - 3
    assert linkage.estimate({}) == {}


def test_candidates_are_not_paired_by_record(spark):
    """A record with many candidates of few variants gives few rivals."""
    pairs = spark.createDataFrame([(1, b, 0, b % 3) for b in range(3000)], "a long, b long, va long, vb long")
    variants = spark.createDataFrame([(b, b % 3, [str(b % 3)], [], None, None) for b in range(3000)], "id long, v long, amounts array<string>, forms array<string>, more string, branch string")
    assert linkage.rivals(pairs, "a", "vb", variants).count() == 6


def test_marginals_of_a_tree_are_exact(spark):
    """On a path of rivals belief propagation gives the marginals of all allowed choices."""
    odds = {(1, 1): 3.0, (1, 2): 2.0, (2, 2): 4.0, (2, 3): 0.5}
    pairs = spark.createDataFrame([(a, b, a, b, float(np.log(t))) for (a, b), t in odds.items()], "a long, b long, va long, vb long, w double")
    rivals_a = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (2, 2, 3), (2, 3, 2)], "a long, x long, y long")
    rivals_b = spark.createDataFrame([(2, 1, 2), (2, 2, 1)], "b long, x long, y long")
    got = {(r.a, r.b): r.confidence for r in linkage.propagate(spark, pairs, rivals_a, rivals_b, settled=1e-9).collect()}
    total, sums, keys = 0.0, dict.fromkeys(odds, 0.0), list(odds)
    for chosen in range(16):
        on = [k for i, k in enumerate(keys) if chosen >> i & 1]
        if len({a for a, _ in on}) == len(on) == len({b for _, b in on}):
            weight = float(np.prod([odds[k] for k in on]))
            total += weight
            for k in on:
                sums[k] += weight
    assert all(abs(got[k] - sums[k] / total) < 1e-4 for k in odds)
