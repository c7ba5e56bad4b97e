"""Queries of reading, extracting and loading label documents, on files and stores that they write themselves."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxloom.operators.store import dense_numbers
from rxloom.plans.runs import RunStore
from rxloom.session import Scratch, read_table
from rxloom.sources import archives, spl

NOW = "timestamp'2024-06-01 00:00:00'"


def document_xml(row: dict) -> bytes:
    """A structured label with the parts of one row of spl_documents."""
    at = lambda v: quoteattr("" if v is None else str(v))
    number = lambda v: "" if v is None or v != v else f" value={at(repr(float(v)))}"
    unit = lambda v: "" if v is None else f" unit={at(v)}"
    parts = []
    for i in row["ingredients"] if row["ingredients"] is not None else []:
        if i is None:
            continue
        code = "" if i["unii"] is None else f'<code code={at(i["unii"])} codeSystem="{spl.UNII_SYSTEM}"/>'
        name = "" if i["name"] is None else f'<name>{escape(i["name"])}</name>'
        quantity = f'<numerator{number(i["quantity_numerator"])}{unit(i["quantity_numerator_unit"])}/><denominator{number(i["quantity_denominator"])}{unit(i["quantity_denominator_unit"])}/>'
        parts.append(f'<ingredient classCode="{"IACT" if i["role"] == "inactive" else "ACTIB"}"><quantity>{quantity}</quantity><ingredientSubstance>{code}{name}</ingredientSubstance></ingredient>')
    duns = "" if row["manufacturer_duns"] is None else f'<id root="{spl.DUNS_ROOT}" extension={at(row["manufacturer_duns"])}/>'
    maker = "" if row["manufacturer_name"] is None else f'<name>{escape(row["manufacturer_name"])}</name>'
    form = "" if row["dosage_form"] is None else f'<formCode displayName={at(row["dosage_form"])}/>'
    name = "" if row["product_name"] is None else f'<name>{escape(row["product_name"])}</name>'
    product = f'<manufacturedProduct><manufacturedProduct>{name}{form}{"".join(parts)}</manufacturedProduct></manufacturedProduct>'
    return (
        f'<?xml version="1.0" encoding="UTF-8"?><document xmlns="urn:hl7-org:v3"><code displayName={at(row["product_type"])}/><effectiveTime value={at(row["effective_time"])}/><setId root={at(row["set_id"])}/><versionNumber value={at(row["version_number"])}/>'
        f"<author><assignedEntity><representedOrganization>{duns}{maker}</representedOrganization></assignedEntity></author>"
        f'<component><structuredBody><component><section><code code="{spl.PRODUCT_SECTION}"/><subject>{product}</subject></section></component></structuredBody></component></document>'
    ).encode()


def write_releases(documents: DataFrame, folder: str) -> int:
    """One release for each partition: a ZIP of packages, each a ZIP of one document. Gives the number of packages."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        path, n = f"{folder}/release-{TaskContext.get().partitionId():05d}.zip", 0
        with zipfile.ZipFile(path + ".part", "w") as release:
            for batch in batches:
                for row in batch.to_dict("records"):
                    package = io.BytesIO()
                    with zipfile.ZipFile(package, "w") as z:
                        z.writestr("label.xml", document_xml(row))
                        z.writestr("picture.jpg", b"-")
                    release.writestr(f"{row['document_id']}.zip", package.getvalue())
                    n += 1
        os.replace(path + ".part", path)
        yield pd.DataFrame({"n": [n]})

    return documents.mapInPandas(write, "n long").agg(F.sum("n")).first()[0] or 0


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, written as releases in the shared folder, read by the source and extracted: (document_id, xml, EXTRACTED)."""
    folder = Scratch(spark).root.removeprefix("file://") + "/releases"
    os.makedirs(folder, exist_ok=True)
    write_releases(read_table(spark, sf_dir, "spl_documents").where("document_id is not null").dropDuplicates(["document_id"]), folder)
    archives.register(spark)
    packages, _ = Scratch(spark).keep(spark.read.format("spl_zip").option("path", f"{folder}/*.zip").load())
    whole, _ = Scratch(spark).keep(packages.join(spl.extract_packages(packages), "package_name"))
    return whole.withColumn("document_id", F.regexp_extract("package_name", r"(\d+)\.zip$", 1).cast("long"))


def spl_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _extracted(spark, sf_dir)
    said = F.transform("ingredients", lambda i: F.concat_ws(":", i["name"], i["role"], i["unii"], i["quantity_numerator_unit"], i["quantity_denominator_unit"]))
    return held.select(
        "document_id", "metadata.set_id", "metadata.version_number", "metadata.product_name", "manufacturer.name", "manufacturer.duns_number", "dosage.dosage_form", F.array_join(said, "; ").alias("ingredients"),
        F.coalesce(F.aggregate("ingredients", F.lit(0.0), lambda s, i: s + F.coalesce(i["quantity_numerator"], F.lit(0.0))), F.lit(0.0)).cast("decimal(30,6)").cast("string").alias("numerators"),
    ).withColumnsRenamed({"name": "manufacturer", "duns_number": "duns"})


def spl_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run over the documents: the log's counters."""
    held = _extracted(spark, sf_dir)
    numbered, _ = Scratch(spark).keep(dense_numbers(held, ["document_id"], "ordinal", -1).drop("document_id"))
    store = RunStore(spark, f"{Scratch(spark).root}/store")
    most = numbered.count()
    store.ingest("documents", numbered, F.expr(NOW), run_id="run-1", batch_size=max(1, most))
    return store.log().select("source", "run_id", "status", "records_fetched", "records_validated", "records_created", "records_updated", "records_unchanged", "records_rejected")


_BARE = r"""nullif(regexp_replace({c}, '^[\s\x0B\x{{001C}}-\x{{001F}}\x{{0085}}\x{{00A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+|[\s\x0B\x{{001C}}-\x{{001F}}\x{{0085}}\x{{00A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+$', '', 'g'), '')"""
_bare = lambda c: _BARE.format(c=c)
_ONCE = "(select * from (select *, row_number() over (partition by document_id) as rn from spl_documents where document_id is not null) where rn = 1)"
_ROLE = "case when i.role = 'inactive' then 'inactive' else 'active' end"

QUERIES = {f.__name__: f for f in (spl_extract, spl_run)}
ORACLE = {
    "spl_extract": f"""select document_id, set_id, version_number::varchar as version_number, {_bare('product_name')} as product_name, {_bare('manufacturer_name')} as manufacturer, manufacturer_duns as duns, dosage_form,
  array_to_string(list_transform(coalesce(ingredients, []), lambda i: concat_ws(':', {_bare('i.name')}, {_ROLE}, i.unii, i.quantity_numerator_unit, i.quantity_denominator_unit)), '; ') as ingredients,
  (list_sum(list_transform(list_concat(coalesce(ingredients, []), [null]), lambda i: case when i is null or i.quantity_numerator is null or isnan(i.quantity_numerator) then 0.0 else i.quantity_numerator end))::decimal(30,6))::varchar as numerators
from {_ONCE}""",
    "spl_run": f"""with d as (select {_bare('product_name')} is not null and len(coalesce(ingredients, [])) > 0 and {_bare('manufacturer_name')} is not null as ok from {_ONCE})
select 'dailymed' as source, 'run-1' as run_id, 'completed' as status, count(*) as records_fetched, count(*) filter (ok) as records_validated, count(*) filter (ok) as records_created, 0::bigint as records_updated, 0::bigint as records_unchanged, count(*) filter (not ok) as records_rejected from d""",
}
