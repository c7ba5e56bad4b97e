"""Structured label documents: each is parsed once, all parts are read from the one tree."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

NS = {"h": "urn:hl7-org:v3"}
#: Code systems, section codes and class codes of the label standard.
UNII_SYSTEM, DUNS_ROOT = "2.16.840.1.113883.4.9", "1.3.6.1.4.1.519.1"
PRODUCT_SECTION, DOSAGE_SECTION = "48780-1", "34068-7"
WARNING_SECTIONS = {"34066-1": "boxed_warning", "34070-3": "contraindication", "34071-1": "precaution", "42232-9": "precaution", "43685-7": "precaution"}
ROLES = {"ACTIB": "active", "ACTIM": "active", "ACTIR": "active", "IACT": "inactive"}

EXTRACTED = (
    "package_name string, metadata struct<set_id:string,effective_time:string,version_number:string,product_name:string,product_type:string>, "
    "ingredients array<struct<name:string,role:string,unii:string,quantity_numerator:double,quantity_numerator_unit:string,quantity_denominator:double,quantity_denominator_unit:string>>, "
    "manufacturer struct<name:string,duns_number:string>, dosage struct<dosage_form:string,administration_text:string>, warnings array<struct<category:string,text:string>>, parse_error string"
)


def _attr(node, path: str, name: str) -> str | None:
    found = node.find(path, NS) if node is not None else None
    return found.get(name) if found is not None else None


def _text(node) -> str | None:
    said = "".join(node.itertext()).strip() if node is not None else ""
    return said or None


def _sections(root, code: str) -> list:
    return [s for s in root.iter(f"{{{NS['h']}}}section") if _attr(s, "h:code", "code") == code]


def _number(value: str | None) -> float | None:
    return None if value is None else float(value)


def extract(xml: bytes) -> dict:
    """All parts of one document; ValueError if it can't be read, has no setId or a wrong number."""
    try:
        root = ET.fromstring(xml)
    except ET.ParseError as e:
        raise ValueError(f"malformed XML: {e}") from e
    set_id = _attr(root, "h:setId", "root")
    if not set_id:
        raise ValueError("no setId")
    listed = _sections(root, PRODUCT_SECTION)
    name = next((n for s in listed for n in s.iterfind(".//h:manufacturedProduct/h:manufacturedProduct/h:name", NS)), None)
    ingredients, seen = [], set()
    for s in listed:
        for i in s.iter(f"{{{NS['h']}}}ingredient"):
            role = ROLES.get(i.get("classCode", ""))
            if role is None or id(i) in seen:
                continue
            seen.add(id(i))
            substance = i.find("h:ingredientSubstance", NS)
            code = substance.find("h:code", NS) if substance is not None else None
            q = {k: i.find(f"h:quantity/h:{k}", NS) for k in ("numerator", "denominator")}
            ingredients.append({
                "name": _text(substance.find("h:name", NS)) if substance is not None else None, "role": role,
                "unii": code.get("code") if code is not None and code.get("codeSystem") == UNII_SYSTEM else None,
                **{f"quantity_{k}": _number(n.get("value")) if n is not None else None for k, n in q.items()},
                **{f"quantity_{k}_unit": n.get("unit") if n is not None else None for k, n in q.items()},
            })
    maker = root.find("h:author/h:assignedEntity/h:representedOrganization", NS)
    duns = next((i.get("extension") for i in maker.findall("h:id", NS) if i.get("root") == DUNS_ROOT), None) if maker is not None else None
    form = next((f for s in listed for f in s.iter(f"{{{NS['h']}}}formCode")), None)
    given = next(iter(_sections(root, DOSAGE_SECTION)), None)
    warnings = []
    for code, category in WARNING_SECTIONS.items():
        for s in _sections(root, code):
            own = s.find("h:text", NS)
            said = " ".join(t.strip() for t in own.itertext() if t.strip()) if own is not None else ""
            if said:
                warnings.append({"category": category, "text": said})
    return {
        "metadata": {"set_id": set_id, "effective_time": _attr(root, "h:effectiveTime", "value"), "version_number": _attr(root, "h:versionNumber", "value"),
                     "product_name": _text(name), "product_type": _attr(root, "h:code", "displayName")},
        "ingredients": ingredients,
        "manufacturer": {"name": _text(maker.find("h:name", NS)), "duns_number": duns} if maker is not None else None,
        "dosage": {"dosage_form": form.get("displayName") if form is not None else None,
                   "administration_text": " ".join(t.strip() for t in given.find("h:text", NS).itertext() if t.strip()) or None if given is not None and given.find("h:text", NS) is not None else None},
        "warnings": warnings, "parse_error": None,
    }


def _extract_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for name, xml in zip(batch["package_name"], batch["xml"]):
            try:
                if xml is None:
                    raise ValueError("no document")
                rows.append({"package_name": name} | extract(bytes(xml)))
            except (ValueError, RecursionError) as e:
                rows.append({"package_name": name, "metadata": None, "ingredients": None, "manufacturer": None, "dosage": None, "warnings": None, "parse_error": str(e) or type(e).__name__})
        yield pd.DataFrame(rows)


def extract_packages(packages: DataFrame) -> DataFrame:
    """EXTRACTED of packages (package_name, xml); a document that can't be read has parse_error only."""
    return packages.select("package_name", "xml").mapInPandas(_extract_batches, EXTRACTED)
