"""Canonical tables, vocabularies and length limits."""

from __future__ import annotations

#: The vocabularies of the canonical model.
VOCABULARIES = {
    "entity_type": ["ingredient", "manufacturer", "product"],
    "record_status": ["active", "retracted", "superseded", "withdrawn"],
    "reference_type": ["cas", "unii", "ndc", "spl_set_id", "openfda_id", "fda_labeler_code", "duns"],
    "warning_category": ["boxed_warning", "contraindication", "precaution"],
    "recall_classification": ["class_i", "class_ii", "class_iii", "unclassified"],
    "recall_status": ["ongoing", "completed", "terminated"],
    "ingredient_role": ["active", "inactive"],
    "run_status": ["pending", "running", "partial", "completed", "failed"],
    "review_status": ["pending", "approved", "rejected"],
    "dead_letter_stage": ["fetch", "parse", "validation", "transform", "save"],
}

#: Prefixes of entity ids and longest texts of checked columns.
PREFIXES = {"ingredient": "ING", "manufacturer": "MFR", "product": "PRD"}
LIMITS = {"name": 256, "product_type": 128, "dosage_form": 128, "unit": 32, "reference_value": 256}

_STAMP = "source_id int, created_at timestamp"
TABLES = {
    "sources": "id int, source_system string, endpoint_or_document_type string, ingestion_run_id string, raw_payload_ref string, ingested_at timestamp, created_at timestamp",
    "ingredient_versions": f"id long, ingredient_id string, version_number int, name string, normalized_name string, status string, {_STAMP}",
    "manufacturer_versions": f"id long, manufacturer_id string, version_number int, name string, normalized_name string, status string, {_STAMP}",
    "product_versions": f"id long, product_id string, version_number int, name string, product_type string, dosage_form string, manufacturer_id string, status string, {_STAMP}",
    "product_ingredients": "product_version_id long, ingredient_id string, role string, quantity decimal(38,18), unit string",
    "warnings": f"id long, product_id string, category string, text string, status string, version_number int, {_STAMP}",
    "recalls": f"id long, product_id string, manufacturer_id string, reason string, classification string, status string, initiated_at timestamp, terminated_at timestamp, {_STAMP}",
    "aliases": f"id long, entity_type string, entity_id string, alias_text string, normalized_alias_text string, confidence double, {_STAMP}",
    "references": f"id long, entity_type string, entity_id string, reference_type string, reference_value string, {_STAMP}",
    "ingestion_logs": "id long, source string, run_id string, status string, checkpoint_state string, records_fetched int, records_validated int, records_created int, records_updated int, records_unchanged int, records_rejected int, started_at timestamp, completed_at timestamp, created_at timestamp",
    "ingestion_dead_letters": "id long, source string, run_id string, stage string, record_identifier string, raw_payload string, error_message string, reprocessed_at timestamp, created_at timestamp",
    "entity_resolution_reviews": "id long, entity_type string, candidate_a_id string, candidate_b_id string, confidence_score double, status string, reviewed_by string, reviewed_at timestamp, created_at timestamp",
}
