"""Loads of both sources, runs with checkpoints, dead letters, and decisions on reviews."""

import json

import pytest
from pyspark.sql import functions as F

from rxloom.plans import load, runs
from rxloom.sources.spl import extract_packages


def now():
    return F.expr("timestamp'2024-01-01 00:00:00'")


def record(key, brand, substances, uniis, maker="Acme Inc.", warnings=("w",)):
    return json.dumps({"set_id": key, "openfda": {"brand_name": [brand] if brand else [], "substance_name": substances, "unii": uniis, "manufacturer_name": [maker]}, "warnings": list(warnings)})


def labels(spark, *raws):
    return spark.createDataFrame(list(enumerate(raws)), "ordinal long, raw string")


def run(spark, store, *raws):
    rows = load.load_labels(spark, labels(spark, *raws), store, 1, now())
    return load.appended(store, rows), {r.ordinal: r.outcome for r in rows["outcomes"].collect()}, rows


def letters(rows):
    return sorted((r.stage, r.error_message) for r in rows.collect())


def test_loads(spark):
    a, b = record("S1", "Gel", ["Beta Carotene", "Zinc"], ["U1"]), record("S2", "Cream", ["Beta-Carotene"], [None])
    store, outcomes, rows = run(spark, load.empty_store(spark), a, b, record("S3", None, ["X"], []), "no json", None, record("S4", "y" * 300, ["X"], []), record("S5", "Ok", ["X"], [], maker="m" * 500), record("S6", "Ok", ["z" * 400], []))
    assert outcomes == {0: "created", 1: "created"}
    assert letters(rows["dead_letters"]) == [
        ("parse", "record has neither set_id nor id"), ("parse", "record has neither set_id nor id"), ("save", "ingredient name longer than 256"), ("save", "manufacturer_name longer than 256"),
        ("save", "name longer than 256"), ("validation", "no brand or generic name"),
    ]
    assert {r.name for r in store["ingredient_versions"].collect()} == {"Beta Carotene", "Zinc"} and store["aliases"].count() == 1 and store["product_ingredients"].count() == 3
    assert {r.name for r in store["manufacturer_versions"].collect()} == {"Acme Inc."}
    store, outcomes, _ = run(spark, store, a, b)
    assert outcomes == {0: "unchanged", 1: "unchanged"} and store["product_versions"].count() == 2
    store, outcomes, _ = run(spark, store, record("S1", "Gel", ["Zinc", "beta carotene"], [None, "U1"], warnings=("w", "w")), b)
    assert outcomes == {0: "updated", 1: "unchanged"}
    assert sorted((r.product_id, r.version_number) for r in store["product_versions"].collect()) == [("PRD-000001", 1), ("PRD-000001", 2), ("PRD-000002", 1)]


def test_records_of_one_key_are_saved_in_turn(spark):
    one, two = record("S1", "Gel", ["Zinc"], []), record("S1", "Gel Forte", ["Zinc"], [])
    store, outcomes, _ = run(spark, load.empty_store(spark), one, one, two, one)
    assert outcomes == {0: "created", 1: "unchanged", 2: "updated", 3: "updated"}
    assert sorted((r.version_number, r.name) for r in store["product_versions"].collect()) == [(1, "Gel"), (2, "Gel Forte"), (3, "Gel")]


def test_more_than_a_thousand_ingredients(spark):
    big = record("S1", "Kit", [f"{chr(97 + n % 26) * 3}{n * 7919}" for n in range(1500)], [f"U{n}" for n in range(1500)])
    store, outcomes, _ = run(spark, load.empty_store(spark), big, record("S2", "Gel", ["Zinc"], ["UZ"]))
    assert outcomes == {0: "created", 1: "created"}
    counts = {r.product_version_id: r["count"] for r in store["product_ingredients"].groupBy("product_version_id").count().collect()}
    assert sorted(counts.values()) == [1, 1500]


SPL = """<document xmlns="urn:hl7-org:v3"><code displayName="HUMAN OTC DRUG LABEL"/><setId root="{key}"/><versionNumber value="1"/>
<author><assignedEntity><representedOrganization><id root="1.3.6.1.4.1.519.1" extension="{duns}"/><name>{maker}</name></representedOrganization></assignedEntity></author>
<component><structuredBody><component><section><code code="48780-1"/><subject><manufacturedProduct><manufacturedProduct><name>{name}</name><formCode displayName="{form}"/>
{ingredients}</manufacturedProduct></manufacturedProduct></subject></section></component></structuredBody></component></document>"""


def package(key, name="Gel", maker="Acme Inc.", duns="123456789", form="GEL", parts=(("ACTIB", "Zinc", "U1"),)):
    one = '<ingredient classCode="{}"><ingredientSubstance><code code="{}" codeSystem="2.16.840.1.113883.4.9"/><name>{}</name></ingredientSubstance></ingredient>'
    return SPL.format(key=key, name=name, maker=maker, duns=duns, form=form, ingredients="".join(one.format(r, u, n) for r, n, u in parts)).encode()


def documents(spark, *packages):
    held = spark.createDataFrame([(i, n, bytearray(x)) for i, (n, x) in enumerate(packages)], "ordinal long, package_name string, xml binary")
    return held.join(extract_packages(held), "package_name")


def test_documents_and_labels_share_products(spark):
    """One product from both sources; makers by DUNS, the first role of a repeated ingredient, forms compared."""
    twice = (("ACTIB", "Zinc", "U1"), ("IACT", "Zinc", "U1"), ("IACT", "Water", "U2"))
    rows = load.load_documents(spark, documents(spark, ("a.zip", package("S1", parts=twice)), ("b.zip", package("S2", maker="ACME Incorporated, The")), ("c.zip", b"<cut"), ("d.zip", package("S3", name=""))), load.empty_store(spark), 1, now())
    assert {r.record_key: r.outcome for r in rows["outcomes"].collect()} == {"S1": "created", "S2": "created"}
    assert [(r.stage, r.record_identifier) for r in rows["dead_letters"].orderBy("record_identifier").collect()] == [("validation", "S3"), ("validation", "c.zip")]
    assert json.loads(rows["dead_letters"].where("record_identifier = 'c.zip'").first().raw_payload)["package_name"] == "c.zip"
    store = load.appended(load.empty_store(spark), rows)
    assert [r.name for r in store["manufacturer_versions"].collect()] == ["Acme Inc."]  # the DUNS is the same
    roles = store["product_ingredients"].join(store["product_versions"].where("product_id = 'PRD-000001'").select(F.col("id").alias("product_version_id")), "product_version_id")
    assert sorted(r.role for r in roles.collect()) == ["active", "inactive"]
    again = load.load_documents(spark, documents(spark, ("a.zip", package("S1", parts=twice)), ("b.zip", package("S2", form="CREAM"))), store, 2, now())
    assert {r.record_key: r.outcome for r in again["outcomes"].collect()} == {"S1": "unchanged", "S2": "updated"}
    store = load.appended(store, again)
    _, outcomes, rows = run(spark, store, record("S2", "Gel", ["zinc"], ["U1"], warnings=()))
    assert outcomes == {0: "updated"} and rows["product_versions"].first().product_id == "PRD-000002" and rows["ingredient_versions"].count() == 0


def test_runs_are_resumed_after_a_crash(spark, tmp_path, monkeypatch):
    stream = labels(spark, *(record(f"S{n}", f"Gel {n}", ["Zinc"], ["U1"]) for n in range(5)), record("S5", None, ["Zinc"], []))
    held = runs.RunStore(spark, str(tmp_path))
    real, calls = runs.load_labels, []

    def breaks(*args):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("lost")
        return real(*args)

    monkeypatch.setattr(runs, "load_labels", breaks)
    with pytest.raises(OSError):
        held.ingest("labels", stream, now(), batch_size=2)
    first = held.log().first()
    assert (first.status, first.records_fetched, json.loads(first.checkpoint_state)["records_processed"]) == ("partial", 2, 2)
    assert held.table("product_versions").count() == 2
    monkeypatch.setattr(runs, "load_labels", real)
    again = held.ingest("labels", stream, now(), batch_size=2)
    assert again == first.run_id
    done = held.log().first()
    assert (done.status, done.records_fetched, done.records_validated, done.records_created, done.records_rejected) == ("completed", 6, 5, 5, 1) and done.completed_at is not None
    assert held.table("sources").count() == 1 and held.table("product_versions").count() == 5
    assert [(r.stage, r.record_identifier) for r in held.open_letters("openfda").collect()] == [("validation", "S5")]
    tried = held.reprocess_labels(now())  # not mended, so it fails again, as a new letter
    assert tried != again and held.table("dead_letters").count() == 2 and [r.run_id for r in held.open_letters("openfda").collect()] == [tried]
    assert {r.status: r.runs for r in held.status_summary().collect()} == {"completed": 2}


def test_documents_skip_packages_that_are_done(spark, tmp_path, monkeypatch):
    held = runs.RunStore(spark, str(tmp_path))
    stream = documents(spark, ("a.zip", package("S1")), ("b.zip", package("S2")), ("c.zip", b"<cut"))
    real, calls = runs.load_documents, []

    def breaks(*args):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("lost")
        return real(*args)

    monkeypatch.setattr(runs, "load_documents", breaks)
    with pytest.raises(OSError):
        held.ingest("documents", stream, now(), batch_size=1)
    monkeypatch.setattr(runs, "load_documents", real)
    held.ingest("documents", stream, now(), batch_size=5)
    done = held.log().first()
    assert (done.status, done.records_fetched, done.records_created, done.records_rejected) == ("completed", 3, 2, 1)
    held.reprocess_documents(now())
    assert held.table("dead_letters").count() == 2 and held.open_letters("dailymed").count() == 1


def test_plans_of_an_empty_store_are_empty(spark, tmp_path):
    """Tables that no batch has written yet are known to have no rows, and a load's tables don't work out the log again."""
    held = runs.RunStore(spark, str(tmp_path))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert all(plan(df).startswith("LocalRelation <empty>") for df in held.tables().values())
    held.ingest("labels", labels(spark, record("S1", "Gel", ["Zinc"], ["U1"])), now())
    after = held.tables()["product_versions"]
    assert after.count() == held.table("product_versions").count() == 1 and after.dtypes == held.table("product_versions").dtypes
    assert "Window" not in plan(after)


def queued(spark):
    """A store where 'Ascorbic Acid, USP' waits for review against 'Ascorbic Acid'."""
    store, _, rows = run(spark, load.empty_store(spark), record("S1", "C", ["Ascorbic Acid"], ["U1"]), record("S2", "C2", ["Ascorbic Acid, USP"], ["U2"]), record("S3", "C3", ["Ascorbic Acid, USP", "Ascorbic Acid"], ["U2", "U1"]))
    return store, Scratch_keep(spark, rows["reviews"])


def Scratch_keep(spark, df):
    from rxloom.session import Scratch

    return Scratch(spark).keep(df)[0]


def test_approved_reviews_merge(spark):
    store, reviews = queued(spark)
    r = reviews.first()
    assert (r.candidate_a_id, r.candidate_b_id, r.status) == ("ING-000001", "ING-000002", "pending")
    decisions = spark.createDataFrame([(r.id, "approved", "qa")], "id long, decision string, reviewed_by string")
    after, decided = load.decide_reviews(spark, store, reviews, decisions, 9, now())
    d = decided.first()
    assert (d.status, d.reviewed_by) == ("approved", "qa") and d.reviewed_at is not None
    alias = after["aliases"].where("entity_id = 'ING-000001'").first()
    assert (alias.alias_text, alias.normalized_alias_text) == ("Ascorbic Acid, USP", "ascorbic acid, usp") and abs(alias.confidence - r.confidence_score) < 1e-9
    assert {(x.ingredient_id, x.status) for x in after["ingredient_versions"].where("version_number = 2").collect()} == {("ING-000002", "superseded")}
    assert {x.reference_value: x.entity_id for x in after["references"].where("entity_type = 'ingredient'").collect()} == {"U1": "ING-000001", "U2": "ING-000001"}
    links = [(x.product_version_id, x.ingredient_id) for x in after["product_ingredients"].collect()]
    assert len(links) == len(set(links)) == 3 and {i for _, i in links} == {"ING-000001"}
    with pytest.raises(ValueError):
        load.decide_reviews(spark, after, decided, decisions, 9, now())
    _, _, rows = run(spark, after, record("S9", "C9", ["Ascorbic Acid, USP"], []))  # the same name isn't asked about again
    assert rows["reviews"].count() == 0 and rows["ingredient_versions"].count() == 0


def test_rejected_reviews_change_nothing_else(spark):
    store, reviews = queued(spark)
    decisions = reviews.select("id", F.lit("rejected").alias("decision"), F.lit("qa").alias("reviewed_by"))
    after, decided = load.decide_reviews(spark, store, reviews, decisions, 9, now())
    assert decided.first().status == "rejected" and all(after[t].count() == store[t].count() for t in store)


def test_makers_of_products_follow_a_merge(spark):
    store, _, _ = run(spark, load.empty_store(spark), record("S1", "A", ["Zinc"], [], maker="Demada Naganor"), record("S2", "B", ["Zinc"], [], maker="Sutegam Labs"))
    reviews = spark.createDataFrame([(1, "manufacturer", "MFR-000002", "MFR-000001", 0.8, "pending")], "id long, entity_type string, candidate_a_id string, candidate_b_id string, confidence_score double, status string")
    after, _ = load.decide_reviews(spark, store, reviews, spark.createDataFrame([(1, "approved", "qa")], "id long, decision string, reviewed_by string"), 9, now())
    assert {x.manufacturer_id for x in after["product_versions"].collect()} == {"MFR-000002"}
