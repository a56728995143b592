"""The stages behind text extraction, one after the other, for all applications at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.operators import checks, confidence, normalize, reports
from dossier.operators.rules import engine
from dossier.session import stored


def run_stages(
    apps: DataFrame, documents: DataFrame, texts: DataFrame, detections: DataFrame, as_of: str
) -> DataFrame:
    """Analysis, confidence, normalization and rules; then the new status of each application.

    ``texts``: document_id, application_id, stored_type, text and overall_confidence. Every
    stage is written and the next one starts from its table, so a lost executor costs one
    stage. An application with results moves to PENDING_REVIEW from PROCESSING only, so a run
    that is repeated leaves a status alone that a human has decided since.
    """
    analysis = stored(checks.analyze_documents(texts, as_of))
    fields = analysis.select(
        "application_id",
        "document_id",
        "document_type",
        F.explode("extracted_fields").alias("field_name", "value"),
    )
    verdicts = analysis.select("document_id", F.explode("validation_results").alias("v")).select(
        "document_id", F.col("v.field").alias("field_name"), F.col("v.status").alias("validation_status")
    )
    ocr = texts.select(
        "document_id", F.col("document_id").alias("ocr_result_id"), "overall_confidence"
    )
    scored = stored(confidence.score_fields(fields, ocr, verdicts))
    nobody = scored.limit(0).select(
        "ocr_result_id",
        "field_name",
        "extracted_value",
        "confidence_score",
        "confidence_source",
        "confidence_reason",
        F.lit("").alias("verification_status"),
        F.lit(False).alias("human_verified"),
    )
    flagged = stored(confidence.flag_fields(confidence.keep_human_state(scored, nobody)))
    ready = flagged.withColumn("human_corrected_value", F.lit(None).cast("string")).withColumn(
        "normalized_value", F.lit(None).cast("string")
    )
    normal = normalize.normalize_fields(ready).select(
        "document_id", "field_name", F.col("stored_value").alias("normalized_value")
    )
    final = stored(ready.drop("normalized_value").join(normal, ["document_id", "field_name"]))
    run = apps.join(documents.select("application_id").distinct(), "application_id", "left_semi")
    marks = detections.select("document_id", "detection_type", "is_present")
    results = engine.evaluate_rules(run, documents, final, marks, as_of)
    status = reports.overall_rule_status(results)
    moved = F.col("status") == "PROCESSING"
    return run.join(status, "application_id").select(
        "application_id",
        F.when(moved, "PENDING_REVIEW").otherwise(F.col("status")).alias("status"),
        "validation_status",
    )
