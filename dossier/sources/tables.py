"""Reading and appending the entity tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Columns of each stored table. Reading with a schema needs no inference pass.
SCHEMAS = {
    "applications": "application_id LONG, status STRING, submitted_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ, created_by STRING, name STRING, reviewer_comments STRING",
    "documents": "document_id LONG, application_id LONG, document_type STRING, copy_number INT, original_filename STRING, uploaded_at TIMESTAMP_NTZ, processing_status STRING",
    "ocr_results": "ocr_result_id LONG, document_id LONG, raw_ocr_text STRING, processing_method STRING, overall_confidence DOUBLE, page_count INT, character_count LONG",
    "extracted_fields": "ocr_result_id LONG, document_id LONG, application_id LONG, document_type STRING, field_name STRING, extracted_value STRING, normalized_value STRING, confidence_score DOUBLE, confidence_source STRING, confidence_reason STRING, verification_status STRING, human_corrected_value STRING, human_verified BOOLEAN",
    "visual_detection_results": "document_id LONG, application_id LONG, detection_type STRING, is_present BOOLEAN, confidence DOUBLE",
    "validation_results": "application_id LONG, document_id LONG, rule_id STRING, rule_name STRING, rule_category STRING, severity STRING, status STRING, message STRING, validated_at TIMESTAMP_NTZ",
    "validation_history": "id LONG, application_id LONG, event_type STRING, actor_name STRING, actor_role STRING, reason STRING, missing_document_types ARRAY<STRING>, created_at TIMESTAMP_NTZ",
    "human_reviews": "id LONG, application_id LONG, reviewer_name STRING, reviewed_at TIMESTAMP_NTZ, decision STRING, comments STRING, rejection_reason STRING",
    "manual_checklists": "application_id LONG, item_name STRING, is_checked BOOLEAN, reviewer STRING, checked_at TIMESTAMP_NTZ",
    "feedback_dataset": "id LONG, application_id LONG, document_id LONG, ocr_result_id LONG, field_name STRING, ocr_value STRING, normalized_value STRING, human_value STRING, confidence_score DOUBLE, confidence_source STRING, correction_reason STRING, reviewer STRING, decision STRING, origin STRING, recorded_at TIMESTAMP_NTZ",
    "queue_jobs": "job_id LONG, application_id LONG, document_id LONG, job_type STRING, status STRING, attempts INT, max_attempts INT, last_error STRING, created_at TIMESTAMP_NTZ, started_at TIMESTAMP_NTZ, claimed_at TIMESTAMP_NTZ, completed_at TIMESTAMP_NTZ, retry_at TIMESTAMP_NTZ",
    "audit_logs": "id LONG, application_id LONG, username STRING, action STRING, severity STRING, performed_at TIMESTAMP_NTZ",
}


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One entity table as stored under ``root``; filters and columns reach the scan."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}")


def stream_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The same table as a stream of newly added files."""
    return spark.readStream.schema(SCHEMAS[name]).parquet(f"{root}/{name}")
