"""The integration and search operators: published figures, sequences and a simulation."""

import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from rxloom.functions import fts, text
from rxloom.operators import evidence, resolve, search, store
from rxloom.plans import ingest
from rxloom.sources import archives, pages, retry, spl


def one(spark, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))


@pytest.mark.parametrize("a, b, score", [("beta carotene", "beta-carotene", 1.0), ("ascorbic acid", "ascorbic acid, usp", 0.7647), ("vitamin b12", "vitamin b6", 0.6429), ("vitamin c", "ascorbic acid", 0.0), ("", "", 0.0)])
def test_similarity(spark, a, b, score):
    assert round(one(spark, a=a, b=b).select(text.similarity(F.col("a"), F.col("b"))).first()[0], 4) == score


def test_normalized_names(spark):
    names = ["  VITAMIN   C  ", "Beta‑Carotene—X", "\tA  b\n", "", None]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(text.normalize_name(F.col("n"))).collect()]
    assert got == ["vitamin c", "beta-carotene-x", "a b", "", None]


def test_truncate_and_lists(spark):
    df = one(spark, t="abcd efgh", s="abc").withColumn("l", F.array(*map(F.lit, "abcdefghij")))
    assert tuple(df.select(text.truncate(F.col("t"), 6), text.truncate(F.col("s"), 3), text.join_capped(F.col("l"), 8)).first()) == ("abcd…", "abc", "a, b, c, d, e, f, g, h, and 2 more")


@pytest.mark.parametrize("word, want", [("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("hoping", "hope"), ("relational", "relat"), ("conditional", "condit"),
                                        ("generalization", "general"), ("happy", "happi"), ("dying", "die"), ("inning", "inning"), ("controlling", "control"), ("injuries", "injuri"), ("stomach", "stomach"), ("vitamins", "vitamin"), ("tablets", "tablet"), ("rate", "rate"), ("cease", "ceas")])
def test_stems(word, want):
    assert fts.stem(word) == want


def test_ranks(spark):
    df = spark.createDataFrame([("severe stomach injury",), ("the stomach",), (None,), ("",)], "t string").withColumn("v", fts.to_vector(F.col("t")))
    any_ = [r[0] for r in df.select(F.round(fts.rank_any(F.col("v"), ["stomach"]), 7)).collect()]
    assert any_[:2] == [0.0607927, 0.0607927]
    both = df.where(fts.matches_all(F.col("v"), ["sever", "stomach"])).select(F.round(fts.rank_all(F.col("v"), ["sever", "stomach"]), 7)).collect()
    assert [r[0] for r in both] == [0.0991032]
    assert df.where(fts.matches_all(F.col("v"), fts.all_terms("the of"))).count() == 0
    texts = ["The tablets, tablets and (Tablet) of Été_X9", None, "", "of the", "a" * 5000 + " b1", "stomach " * 3000]
    held = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").repartition(1).withColumn("v", fts.to_vector(F.col("t"))).collect()
    want = {i: {} for i, t in enumerate(texts) if t is not None}
    for i in want:
        for lexeme, at in fts.tokens(texts[i]):
            want[i].setdefault(lexeme, []).append(at)
    assert {r.i: r.v for r in held} == want | {1: None}


@pytest.mark.parametrize("said, n, want", [("a [1]", 2, (True, [1], "")), ("a [1]\nb [2]", 2, (True, [1, 2], "")), ("a [1, 2]", 2, (True, [1, 2], "")), ("a", 2, (False, [], "uncited line")), ("a [1]\nb", 2, (False, [1], "uncited line")), ("a [5]", 2, (False, [], "citation out of range")),
                                           ("a [0]", 2, (False, [], "citation out of range")), ("a [1]", 0, (False, [], "citation out of range")), ("", 2, (False, [], "empty answer")), ("  \n ", 2, (False, [], "empty answer")), ("a [1]\n\nb [2]", 2, (True, [1, 2], ""))])
def test_citations(spark, said, n, want):
    got = one(spark, t=said).select(evidence.verify_citations(F.col("t"), F.lit(n)).alias("c")).select("c.*").first()
    assert (got[0], list(got[1]), got[2]) == want
    valid, cited, reason = evidence.verify_text(said, n)
    assert (valid, sorted(cited), reason) == want


def test_registry_and_answers():
    r = evidence.EvidenceRegistry()
    row = lambda t, i: {"entity_type": t, "entity_id": i, "content": f"{t} {i}"}
    assert r.add([row("product", "A"), row("warning", "B")]) == [1, 2]
    assert r.add([row("product", "A"), row("recall", "C"), row("recall", "A")]) == [1, 3, 4]
    turns = iter([{"query": "x"}, {"text": "It is so [1]."}])
    got = evidence.ask("?", lambda q: [row("product", "A")], lambda m, result: next(turns))
    assert not got["insufficient_evidence"] and [x["entity_id"] for x in got["references"]] == ["A"]
    assert evidence.ask("?", lambda q: [], lambda m, result: {"text": "No source."})["insufficient_evidence"]
    assert evidence.ask("?", lambda q: [], lambda m, result: {"query": " "})["insufficient_evidence"]


# -- resolution ----------------------------------------------------------------------------------------


def similarity(a, b):
    g = lambda s: {f"  {w} "[i : i + 3] for w in "".join(c if c.isalnum() else " " for c in s.lower()).split() for i in range(len(w) + 1)}
    x, y = g(a), g(b)
    return len(x & y) / len(x | y) if x | y else 0.0


def sequential(rows, existing):
    names = {n for _, _, n, _ in rows} | {n for _, n, _ in existing if n}
    scores = {(a, b): s for a in names for b in names if a < b and (s := similarity(a, b)) >= 0.75}
    return resolve.fold(rows, existing, scores)


@pytest.mark.parametrize("seed", range(6))
def test_resolution_in_parallel_equals_the_sequence(spark, seed):
    r = random.Random(seed)
    words = ["ascorbic acid", "ascorbic acid usp", "ascorbic acids", "beta carotene", "beta-carotene", "vitamin b12", "vitamin b6", "vitamin b", "sodium chloride", "sodium chlorides", "zinc"]
    rows = [(i, r.choice(words) + r.choice(["", " x", "e"]), r.choice([None, None, None, "U1", "U2", "U3"])) for i in range(60)]
    existing = [("ING-000001", "ascorbic acid", None), ("ING-000002", None, "U3"), ("ING-000001", None, "U9")]
    want = {o: (e, k) for o, e, k, _, _ in sequential([(o, n, n, u) for o, n, u in rows], existing)}
    new = {o: i for i, o in enumerate(sorted(o for o, (e, _) in want.items() if e == f"new:{o}"))}
    want = {o: (f"ING-{new[int(e[4:])] + 3:06d}" if e.startswith("new:") else e, k) for o, (e, k) in want.items()}
    got = resolve.resolve(spark, spark.createDataFrame(rows, "ordinal long, name string, identifier string"), spark.createDataFrame(existing, "entity_id string, name string, identifier string"), last=2)
    assert {x.ordinal: (x.entity_id, x.outcome) for x in got.collect()} == want


def test_resolution_tiers(spark):
    said = ["Beta Carotene", "Beta-Carotene", "Ascorbic Acid", "Ascorbic Acid, USP", "Vitamin B12", "Vitamin B6", " ", None]
    df = spark.createDataFrame([(i, n, None) for i, n in enumerate(said)], "ordinal long, name string, identifier string")
    got = {x.ordinal: (x.entity_id, x.outcome) for x in resolve.resolve(spark, df).collect()}
    assert got == {0: ("ING-000001", "created"), 1: ("ING-000001", "auto_merge"), 2: ("ING-000002", "created"), 3: ("ING-000003", "review"), 4: ("ING-000004", "created"), 5: ("ING-000005", "created")}


def spelled(n, seed=0):
    """Made-up names: few trigrams, each in many of them."""
    r = random.Random(seed)
    return sorted({" ".join("".join(r.choice("bdgkmnst") + r.choice("aeiou") for _ in range(r.choice([3, 3, 4]))) for _ in range(2)) + r.choice(["", " pharma", " pharma inc", " labs"]) for _ in range(n)})


@pytest.mark.parametrize("threshold, long", [(0.75, 256), (0.75, 16), (0.3, 256), (0.5, 12), (1.0, 256)])
def test_similarity_join_equals_brute_force(spark, monkeypatch, threshold, long):
    """Also where few trigrams are shared, and where some names or all are too long for pairs of trigrams."""
    monkeypatch.setattr(resolve, "LONG", long, raising=False)
    base = spelled(60)
    names = base + [n + "s" for n in base[::2]] + [n[1:] for n in base[::3]] + ["a", "b", "a b", "b a", "a b c", "ab", "ba", "\U0001f48a pill", "\U0001f48b pill", "é", "é e", "-", "", None, base[0]]
    got = {(x.a, x.b): round(x.score, 9) for x in resolve.similarity_join(spark.createDataFrame([(n,) for n in names], "name string"), threshold).collect()}
    held = sorted({n for n in names if n})
    want = {(a, b): round(s, 9) for i, a in enumerate(held) for b in held[i + 1 :] if (s := similarity(a, b)) >= threshold}
    assert want and got == want


def test_similarity_join_compares_few_names(spark, monkeypatch):
    """Names that share many trigrams, but not enough of the rare ones together, aren't compared."""
    names = spelled(3000)
    monkeypatch.setattr(resolve, "similarity_of", lambda a, b: F.lit(1.0))
    compared = resolve.similarity_join(spark.createDataFrame([(n,) for n in names], "name string")).count()
    assert compared < 10 * len(names)


def test_ordinals_beyond_the_exact_doubles(spark):
    """Groups with pairs and existing names, which have no ordinal, keep each ordinal to its last digit."""
    rows = [(2**60 + i, n, u) for i, (n, u) in enumerate([("zinc oxide", None), ("zinc oxides", None), ("zinc oxide", "U1"), ("vitamin", "U1")])]
    existing = spark.createDataFrame([("ING-000001", "zinc oxide", None)], "entity_id string, name string, identifier string")
    got = {x.ordinal: x.entity_id for x in resolve.resolve(spark, spark.createDataFrame(rows, "ordinal long, name string, identifier string"), existing, last=1).collect()}
    assert got == {2**60: "ING-000001", 2**60 + 1: "ING-000002", 2**60 + 2: "ING-000001", 2**60 + 3: "ING-000003"}


def test_redirects_and_links(spark):
    asked = spark.createDataFrame([(1, "B", "C"), (2, "A", "B"), (3, "X", "Y"), (4, "Z9", "Z1"), (5, "P", "Q"), (6, "Q", "P"), (7, None, "N"), (8, "S", "S")], "id long, candidate_a_id string, candidate_b_id string")
    moved = resolve.redirects(spark, asked)
    assert {tuple(x) for x in moved.select("loser", "winner").collect()} == {("B", "A"), ("C", "A"), ("Y", "X"), ("Z1", "Z9"), ("P", "Q")}
    chain = spark.createDataFrame([(n, f"E{n + 1}", f"E{n}") for n in range(40)], "id long, candidate_a_id string, candidate_b_id string")
    assert {x.winner for x in resolve.redirects(spark, chain).collect()} == {"E40"}
    # a merge goes on only with later ones
    assert {tuple(x) for x in resolve.redirects(spark, asked.where("id <= 2").withColumn("id", -F.col("id"))).select("loser", "winner").collect()} == {("B", "A"), ("C", "B")}
    links = spark.createDataFrame([(1, "A", "active"), (1, "C", "inactive"), (2, "C", "inactive"), (2, "B", "active"), (3, "Z", None)], "p long, i string, role string")
    got = store.repoint_links(links, moved, "p", "i")
    assert sorted(map(tuple, got.collect())) == [(1, "A", "active"), (2, "A", "active"), (3, "Z", None)]


# -- store -----------------------------------------------------------------------------------------------


def test_numbers_ids_and_outcomes(spark):
    df = spark.createDataFrame([(f"n{i:03d}",) for i in range(100)], "name string")
    got = store.create_entities(df.repartition(7), ["name"], "ING", 5)
    assert {(r.name, r.entity_id) for r in got.collect()} == {(f"n{i:03d}", f"ING-{i + 6:06d}") for i in range(100)}
    was = spark.createDataFrame([("a", 1, None), ("b", None, [1])], "k string, x int, l array<int>")
    now = spark.createDataFrame([("a", 1, None), ("b", None, [2]), ("c", 1, None)], "k string, x int, l array<int>")
    assert dict(map(tuple, store.upsert_outcomes(now, was, "k", ["x", "l"]).collect())) == {"a": "unchanged", "b": "updated", "c": "created"}


# -- sources -----------------------------------------------------------------------------------------------

SPL = """<document xmlns="urn:hl7-org:v3"><code displayName="HUMAN OTC DRUG LABEL"/><effectiveTime value="20260722"/><setId root="S-1"/><versionNumber value="8"/>
<author><assignedEntity><representedOrganization><id root="1.3.6.1.4.1.519.1" extension="123"/><name>Acme</name></representedOrganization></assignedEntity></author>
<component><section><code code="48780-1"/><subject><manufacturedProduct><manufacturedProduct><name> Gel X </name><formCode displayName="GEL"/>
<ingredient classCode="ACTIB"><quantity><numerator value="2" unit="mg"/><denominator value="1" unit="mL"/></quantity><ingredientSubstance><code code="U1" codeSystem="2.16.840.1.113883.4.9"/><name>ZINC</name><activeMoiety><activeMoiety><name>no</name></activeMoiety></activeMoiety></ingredientSubstance></ingredient>
<ingredient classCode="IACT"><ingredientSubstance><name>WATER</name></ingredientSubstance></ingredient><ingredient classCode="OTHER"/></manufacturedProduct></manufacturedProduct></subject></section></component>
<component><section><code code="34070-3"/><text>Do <b>not</b> use.</text><component><section><text>nested</text></section></component></section></component></document>"""


def test_spl(spark):
    deep = SPL.replace("</document>", "<a>" * 300 + "</a>" * 300 + "</document>")
    given = [("ok", SPL), ("deep", deep), ("cut", SPL[:-20]), ("none", SPL.replace("setId", "other")), ("number", SPL.replace('value="2"', 'value="two"')), ("null", None)]
    df = spark.createDataFrame([(n, x.encode() if x else None) for n, x in given], "package_name string, xml binary")
    got = {r.package_name: r for r in spl.extract_packages(df).collect()}
    ok = got["ok"].asDict(True)
    assert ok["metadata"] == {"set_id": "S-1", "effective_time": "20260722", "version_number": "8", "product_name": "Gel X", "product_type": "HUMAN OTC DRUG LABEL"}
    assert [(i["name"], i["role"], i["unii"], i["quantity_numerator"]) for i in ok["ingredients"]] == [("ZINC", "active", "U1", 2.0), ("WATER", "inactive", None, None)]
    assert ok["manufacturer"] == {"name": "Acme", "duns_number": "123"} and ok["dosage"]["dosage_form"] == "GEL"
    assert ok["warnings"] == [{"category": "contraindication", "text": "Do not use."}]
    assert got["deep"].parse_error is None and all(got[n].parse_error for n in ("cut", "none", "number", "null"))


def test_archives(spark, tmp_path):
    archives.register(spark)
    records = [{"id": str(i), "t": "x" * 3000} for i in range(1000)]
    with zipfile.ZipFile(tmp_path / "a.json.zip", "w") as z:
        z.writestr("a.json", json.dumps({"meta": {"results": 1}, "results": records}))
    got = spark.read.format("label_json_zip").option("path", str(tmp_path / "*.json.zip")).load()
    assert got.count() == 1000 and json.loads(got.where("position = 999").first().raw) == records[999]

    def package(name, body):
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w") as z:
            z.writestr("p.jpg", "x")
            if name:
                z.writestr(name, body)
        return b.getvalue()

    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        z.writestr("read.me", "x")
        for n, p in (("1.zip", package("l.xml", SPL)), ("2.ZIP", package("l.XML", SPL)), ("3.zip", package(None, "")), ("4.zip", package("l.xml", "<other/>"))):
            z.writestr(n, p)
    got = spark.read.format("spl_zip").option("path", str(tmp_path / "r.zip")).option("packages", "2").load()
    assert sorted(r.package_name for r in got.collect()) == ["1.zip", "2.ZIP"]


def test_retry_and_pages():
    waits, calls = [], []

    def fails(*errors):
        left = list(errors)

        def call():
            calls.append(1)
            if left:
                raise left.pop(0)
            return "ok"

        return call

    assert retry.with_retry(fails(OSError(), retry.FetchError(503)), jitter=0, sleep=waits.append) == "ok" and waits == [1.0, 2.0]
    waits.clear()
    assert retry.with_retry(fails(retry.FetchError(429, 7.0)), sleep=waits.append) == "ok" and waits == [7.0]
    with pytest.raises(retry.FetchError):
        retry.with_retry(fails(retry.FetchError(404)), sleep=waits.append)
    with pytest.raises(retry.RetryExhausted) as e:
        retry.with_retry(fails(*[OSError()] * 9), attempts=3, sleep=waits.append)
    assert e.value.attempts == 3
    data = list(range(25))
    assert [s for s, _ in pages.iter_pages(lambda s, n: data[s : s + n], 10)] == [0, 10, 20]
    assert [s for s, _ in pages.iter_pages(lambda s, n: data[:20][s : s + n], 10)] == [0, 10]


def test_label_records(spark):
    raws = ['{"set_id": "S", "openfda": {"brand_name": ["B"], "generic_name": ["G"], "substance_name": ["X", "Y"], "unii": ["U"]}, "warnings": ["w"], "boxed_warning": ["b"]}', '{"id": "I", "set_id": ""}', "{}", "no", None]
    got = ingest.parse_label_records(spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "n int, raw string")).orderBy("n").collect()
    assert [r.record_key for r in got] == ["S", "I", None, None, None] and [r.parse_error is None for r in got] == [True, True, False, False, False]
    row = ingest.transform_labels(ingest.parse_label_records(spark.createDataFrame([(raws[0],)], "raw string"))).first().asDict(True)
    assert row["name"] == "B" and [(i["name"], i["unii"]) for i in row["ingredients"]] == [("X", "U"), ("Y", None)] and [w["category"] for w in row["warnings"]] == ["boxed_warning", "precaution"]
    types = {r.path: r.types for r in ingest.infer_schema(spark.createDataFrame([('{"a": 1, "b": [1, "x"]}',), ('{"a": null}',)], "raw string")).collect()}
    assert types == {"$": "object", "$.a": "integer,null", "$.b": "array", "$.b[]": "integer,string"}


def test_addresses(spark):
    got = one(spark, t="see https://x.org/drug-label-0001.json.zip and https://x.org/a/dm_spl_release_human_rx_part1.zip https://x.org/drug-label-0001.json.zip").select(F.explode(ingest.archive_urls(F.col("t"))).alias("u")).select("u", ingest.bucket_of(F.col("u"))).collect()
    assert [r[1] for r in got] == ["openfda/drug/label", "dailymed/full_release/human_rx"]


def test_streaming(spark, tmp_path):
    from rxloom.streaming.incremental import load_labels

    (tmp_path / "in").mkdir()
    load = lambda: load_labels(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    (tmp_path / "in/1.json").write_text('{"set_id": "S", "openfda": {"brand_name": ["B"], "substance_name": ["X"]}}\n{"set_id": "T"}\n')
    load()
    (tmp_path / "in/2.json").write_text('{"set_id": "U", "openfda": {"brand_name": ["B"], "substance_name": ["X"]}}\n')
    load()
    load()
    assert sorted(r.record_key for r in spark.read.parquet(str(tmp_path / "out/candidates")).collect()) == ["S", "U"]
    assert [r.record_identifier for r in spark.read.parquet(str(tmp_path / "out/dead_letters")).collect()] == ["T"]


def test_search_store(spark, tmp_path):
    stamp = "timestamp_ntz'2024-01-01 00:00:00'"
    mk = lambda rows, schema: spark.createDataFrame(rows, schema)
    s = {
        "sources": mk([(1, "sys", "ep")], "id int, source_system string, endpoint_or_document_type string").withColumn("ingested_at", F.expr(stamp)),
        "ingredient_versions": mk([(1, "ING-1", 1, "Ascorbic Acid", "active", 1)], "id long, ingredient_id string, version_number int, name string, status string, source_id int"),
        "manufacturer_versions": mk([(1, "MFR-1", 1, "Acme", "active", 1)], "id long, manufacturer_id string, version_number int, name string, status string, source_id int"),
        "product_versions": mk([(1, "PRD-1", 1, "Old", "MFR-1", "active", 1), (2, "PRD-1", 2, "Vitamin C Tablets", "MFR-1", "active", 1)], "id long, product_id string, version_number int, name string, manufacturer_id string, status string, source_id int"),
        "product_ingredients": mk([(2, "ING-1", "active")], "product_version_id long, ingredient_id string, role string"),
        "warnings": mk([(1, "PRD-1", "precaution", "old injuries", "active", 1, 1), (2, "PRD-1", "precaution", "stomach injury", "active", 2, 1)], "id long, product_id string, category string, text string, status string, version_number int, source_id int"),
        "aliases": mk([(5, "ingredient", "ING-1", "Vitamin C", 0.93)], "id long, entity_type string, entity_id string, alias_text string, confidence double"),
        "references": mk([("product", "PRD-1", "spl_set_id", "1111")], "entity_type string, entity_id string, reference_type string, reference_value string"),
        "recalls": mk([(9, "PRD-1", None, "glass injuries", "class_ii", "terminated", 1)], "id long, product_id string, manufacturer_id string, reason string, classification string, status string, source_id int"),
    }
    s["warnings"] = s["warnings"].union(s["warnings"])  # delivered twice
    search.write_postings(s, f"{tmp_path}/postings")
    s = search.with_postings(spark, s, f"{tmp_path}/postings")
    hit = search.search_ingredients(s, "vitamin c").first()
    assert (hit.id, hit.name, hit.product_ids) == ("ING-1", "Ascorbic Acid", ["PRD-1"])
    hit = search.search_products(s, "vitamin").first()
    assert hit.external_url.endswith("1111") and hit.manufacturer.name == "Acme" and [w.text for w in hit.warnings] == ["stomach injury"] and hit.ingredients[0].name == "Ascorbic Acid"
    assert {r.id for r in search.search_warnings(s, "injury").collect()} == {1, 2} and {r.id for r in search.search_warnings(s, "injury", strict=True).collect()} == {2}
    assert search.search_recalls(s, "injuries").count() == 1 and search.search_recalls(s, "injuries", strict=True).count() == 0
    assert search.search_products(s, "nothing").count() == 0
    got = search.retrieve(s, "injury vitamin").collect()  # no entity has both, so any word will do
    assert [r.number for r in got] == list(range(1, len(got) + 1)) and {r.entity_type for r in got} == {"ingredient", "product", "warning", "recall"}
    assert search.retrieve(s, "vitamin c").where("entity_type = 'ingredient'").first().entity_resolution_confidence == 0.93


def test_dense_numbers_of_wide_rows(spark):
    """Partitions are cut once, however adaptive execution puts those of a narrower plan together."""
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.shuffle.partitions": "16"}
    was = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = spark.range(20_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 512).alias("wide"))
        got = store.dense_numbers(rows, ["k"], "n", 5)
        assert got.where("n <> k + 6").count() == 0 and got.count() == got.select("wide", "n").distinct().count() == 20_000
    finally:
        for k, v in was.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
