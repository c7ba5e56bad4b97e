"""Nested records, units and history against brute force and hand-made cases."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rxloom.operators import history, nested, units


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# -- nested ---------------------------------------------------------------------------------------


def emitted(spark, *raws):
    df = spark.createDataFrame([(i + 1, r) for i, r in enumerate(raws)], "record_id long, raw string")
    return rows(nested.emit_nodes(df, payload=False).select("record_id", "node_kind", "node_path", "parent_path", "code"))


def test_nodes_of_one_record(spark):
    raw = json.dumps({
        "openfda": {"substance_name": ["A", None, "", "B"], "unii": ["U1", None, "U3"]},
        "products": [None, {"product_ndc": "N", "active_ingredients": {"substance_name": "A", "unii": None}, "packaging": [{"package_ndc": "P", "contains": [None, {"package_ndc": "Q", "contains": {"description": "x"}}]}]}],
    })
    assert emitted(spark, raw) == rows(spark.createDataFrame([
        (1, "substance", "0", "", "U1"), (1, "substance", "3", "", ""), (1, "product", "1", "", "N"), (1, "ingredient", "1/0", "1", ""),
        (1, "package", "1/0", "1", "P"), (1, "package", "1/0/1", "1/0", "Q"), (1, "package", "1/0/1/0", "1/0/1", ""),
    ], "a long, b string, c string, d string, e string"))


@pytest.mark.parametrize("raw", [None, "", "  ", "[]", "null", "3", '{"openfda": ', "<html/>", '"no object"', "{}", '{"products": "text", "openfda": 7}'])
def test_nothing_to_emit(spark, raw):
    assert emitted(spark, raw) == []


def test_encoded_and_repeated_records(spark):
    one = {"openfda": {"substance_name": "X", "unii": "U"}}
    assert emitted(spark, json.dumps(json.dumps(json.dumps(one)))) == [(1, "substance", "0", "", "U")]
    df = spark.createDataFrame([(5, json.dumps(one), "a"), (5, json.dumps(one), "a"), (None, json.dumps(one), "b")], "record_id long, raw string, node_kind string")
    assert nested.emit_nodes(df).count() == 1


def test_very_deep_records(spark):
    deep = '{"package_ndc":"P","contains":[' * 30_000 + "]}" * 30_000
    found = nested.parse_record('{"products":[{"packaging":[' + deep + "]}]}")
    assert sum(1 for n in nested.visit(found)) == 30_001


@pytest.mark.parametrize("seed", range(200))
def test_iterative_parser_equals_json(seed):
    r = random.Random(seed)

    def value(depth):
        made = [
            lambda: None, lambda: True, lambda: r.randrange(-9, 99), lambda: r.random() * 1e5, lambda: "".join(r.choice('ab"\\\n é{[') for _ in range(4)),
            lambda: {}, lambda: [value(depth + 1) for _ in range(r.randrange(4))], lambda: {str(i): value(depth + 1) for i in range(r.randrange(4))},
        ]
        return made[r.randrange(8 if depth < 5 else 5)]()

    text = json.dumps(value(0), indent=r.choice([None, 1]), ensure_ascii=r.random() < 0.5)
    assert nested._parse_deep(text) == json.loads(text)
    cut = text[: r.randrange(len(text) + 1)] + r.choice(["", ",", "}", "]", " x", '"'])
    try:
        want = json.loads(cut)
    except ValueError:
        with pytest.raises(ValueError):
            nested._parse_deep(cut)
    else:
        assert nested._parse_deep(cut) == want


def test_tables_keep_parents_and_schemas(spark, tmp_path):
    raw = json.dumps({"products": [{"product_ndc": "N", "dosage_form": "GEL", "packaging": [{"package_ndc": "P", "description": "1 in 1"}]}]})
    df = spark.createDataFrame([(1, raw)], "record_id long, raw string")
    nested.write_node_tables(nested.emit_nodes(df), str(tmp_path / "t"))
    packages = nested.node_table(spark, str(tmp_path / "t"), "package")
    assert packages.columns == ["record_id", "node_path", "parent_path", "code", "description", "marketing_start"]
    assert rows(packages) == [(1, "0/0", "0", "P", "1 in 1", None)]
    assert rows(nested.node_table(spark, str(tmp_path / "t"), "product")) == [(1, "0", "", "N", "GEL")]


# -- units -------------------------------------------------------------------------------------------

CASES = [  # num, num_text, den, den_text, free_text, expected
    (5, "mg", 1, "mL", None, (5000, "ug", "ml")), (5, "mg", 1, "1", None, (5000, "ug", "each")), (5, " MG ", None, None, None, (5000, "ug", "each")), (1, "k[iU]", 10, "mL", None, (100, "iu", "ml")),
    (4000, None, 10, None, "mg / mL", (400000, "ug", "ml")), (10000, None, 1, None, "[iU] per L", (10, "iu", "ml")), (None, None, None, None, "8% w/v", (80000, "ug", "ml")), (None, None, None, None, "75 percent w/w", (750000, "ug", "g")),
    (None, None, None, None, "12,500 micrograms per g", (12500, "ug", "g")), (None, None, None, None, "approx. 0,01million IU per 100 g", (100, "iu", "g")), (None, None, None, None, "equivalent to 12.5mg in 1 TABLET", (12500, "ug", "each")),
    (None, "10 mg/2 tablets", None, None, None, (5000, "ug", "each")), (3, "10*3.ug", None, None, None, (3000, "ug", "each")), (2, "100 mg / 5 mL", None, None, None, (40000, "ug", "ml")), (None, "20 10*3.ug / 10 ml", None, None, None, (2000, "ug", "ml")),
    (2.5, "% w/v", None, None, None, (25000, "ug", "ml")), (50, "ug", 100, "uL", None, (500, "ug", "ml")), (1, "mg", 1, "kg", None, (1, "ug", "g")), (3, "mg/1", None, None, None, (3000, "ug", "each")),
    (3, "drops", None, None, None, None), (None, "q.s.", None, None, None, None), (5, "mg", 0, "mL", None, None), (None, "mg", None, None, None, None), (5, "meq", 1, "L", None, None), (5, None, None, None, None, None),
    (5, "", None, None, "", None), (3, "[hp_X]", 1, "mL", None, None), (5, "mg", 1, "h", None, None), (None, None, None, None, "trace amounts", None), (None, None, None, None, "as needed to pH 7", None),
]


def test_units(spark):
    df = spark.createDataFrame([(i, None if c[0] is None else float(c[0]), c[1], None if c[2] is None else float(c[2]), c[3], c[4]) for i, c in enumerate(CASES)], "k int, num double, num_text string, den double, den_text string, free_text string")
    got = {r[0]: tuple(r)[1:] for r in units.to_common_units(spark, df, ["k"]).collect()}
    assert {i: got.get(i) for i in range(len(CASES))} == {i: c[5] for i, c in enumerate(CASES)}
    assert units.to_common_units(spark, df.limit(0), ["k"]).count() == 0


@pytest.mark.parametrize("text, value", [("1,000", 1000.0), ("1,5", 1.5), ("12,345,678", 12345678.0), ("0,0001", 0.0001), ("7.25", 7.25)])
def test_commas(text, value):
    assert units.read_number(text) == value


def test_long_texts_are_read_whole():
    assert units.parse_strength("x " * 200_000 + "5 mg / mL") == (5.0, "mg", None, "ml")


# -- history -------------------------------------------------------------------------------------------


def brute(versions, runs, attrs):
    held = {}
    for v in versions:
        if v["e"] is None or v["n"] is None:
            continue
        k = (v["e"], v["n"])
        rank = (runs.get(v["src"]) is not None, runs.get(v["src"]) or datetime.min, v["id"])
        if k not in held or rank > held[k][0]:
            held[k] = (rank, v)
    at = {}
    for _, v in held.values():
        if v["at"] is not None and ((v["e"], v["at"]) not in at or at[v["e"], v["at"]]["n"] < v["n"]):
            at[v["e"], v["at"]] = v
    out = []
    for e in {k[0] for k in at}:
        line = [at[k] for k in sorted(k for k in at if k[0] == e)]
        opened = [v for i, v in enumerate(line) if i == 0 or [v[a] for a in attrs] != [line[i - 1][a] for a in attrs]]
        out += [(e, v["n"], v["at"], opened[i + 1]["at"] if i + 1 < len(opened) else None) for i, v in enumerate(opened)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed, hot", [(0, 10**6), (1, 3), (2, 7), (3, 1)])
def test_history_equals_brute_force_also_in_buckets(spark, seed, hot):
    r = random.Random(seed)
    start = datetime(2024, 1, 1)
    runs = {i: start + timedelta(hours=r.randrange(99)) for i in range(20)}
    versions = [
        {"id": i, "e": r.choice(["a", "a", "a", "b", "c", None]), "n": r.choice([*range(40), None]), "x": r.choice("pq") if r.random() < 0.8 else None, "y": r.choice("mn"), "src": r.choice([*range(20), 99, None]),
         "at": start + timedelta(hours=r.randrange(60)) if r.random() < 0.95 else None} for i in range(150)
    ]
    df = spark.createDataFrame([(v["id"], v["e"], v["n"], v["x"], v["y"], v["src"], v["at"], "clash") for v in versions], "id long, e string, version_number int, x string, y string, source_id int, created_at timestamp_ntz, bucket string")
    run = spark.createDataFrame(list(runs.items()), "id int, ingested_at timestamp_ntz")
    eff = history.effective_versions(df.unionByName(df), run, "e", ["x", "y"])
    got = rows(history.periods(eff, ["x", "y"], hot).select("entity_id", "version_number", "valid_from", "valid_to"))
    assert got == brute(versions, runs, ["x", "y"])
    spans = history.attribute_intervals(eff, ["x", "y"], hot).where("attribute = 'x'").select("entity_id", "valid_from", "valid_to")
    assert rows(spans) == sorted(((e, a, b) for e, _, a, b in brute(versions, runs, ["x"])), key=repr)


def test_empty_history(spark):
    df = spark.createDataFrame([], "id long, e string, version_number int, x string, source_id int, created_at timestamp_ntz")
    run = spark.createDataFrame([], "id int, ingested_at timestamp_ntz")
    assert history.periods(history.effective_versions(df, run, "e", ["x"]), ["x"]).count() == 0
