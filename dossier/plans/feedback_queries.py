"""Correction statistics, curated dataset and snapshot queries."""

from pyspark.sql import functions as F

from dossier.operators import feedback as FB
from dossier.operators.relational import with_document_type
from dossier.plans.catalog import query
from dossier.sources import exports

_ISO = "strftime(recorded_at, '%Y-%m-%dT%H:%M:%S') || '+00:00'"
_REASON = """CASE WHEN application_id IS NULL THEN 'missing_application_id' WHEN trim(coalesce(field_name, '')) = '' THEN 'missing_field_name'
 WHEN trim(coalesce(ocr_value, '')) = '' THEN 'missing_original_ocr_value' WHEN trim(coalesce(human_value, '')) = '' THEN 'missing_human_corrected_value'
 WHEN confidence_score IS NULL OR confidence_score < 0 OR confidence_score > 1 THEN 'invalid_confidence_score'
 WHEN decision NOT IN ('APPROVE', 'CORRECT', 'REJECT', 'CORRECTED') THEN 'invalid_decision' END"""
_DEDUPED = """ded AS (SELECT * FROM e_feedback QUALIFY row_number() OVER
 (PARTITION BY application_id, document_id, field_name, ocr_value, human_value, recorded_at ORDER BY id) = 1)"""
_CURATED = f"""{_DEDUPED}, cur AS (SELECT id, f.application_id, coalesce(d.document_type, 'UNKNOWN') AS document_type, field_name, ocr_value AS original_ocr_value,
 normalized_value, human_value AS human_corrected_value, confidence_score, confidence_source, correction_reason, decision, origin, {_ISO} AS recorded_at,
 coalesce(nullif(reviewer, ''), 'UNKNOWN') AS reviewer
 FROM (SELECT *, {_REASON} AS reason FROM ded) f LEFT JOIN (SELECT document_id, document_type FROM e_documents) d ON d.document_id = f.document_id WHERE reason IS NULL)"""


def _curated(t):
    return FB.curate(t.feedback, t.entity("documents"))


@query(
    "feedback_totals",
    """SELECT count(*) AS total_entries, count(*) FILTER (WHERE coalesce(human_value, '') <> coalesce(ocr_value, '')) AS total_corrected_fields,
 round(avg(confidence_score), 9) AS average_confidence FROM e_feedback""",
)
def feedback_totals(t):
    return FB.feedback_totals(t.feedback).withColumn(
        "average_confidence", F.round("average_confidence", 9)
    )


@query(
    "top_corrected_fields",
    "SELECT field_name, count(*) AS corrections FROM e_feedback GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
)
def top_corrected_fields(t):
    return FB.top_corrected_fields(t.feedback, 5)


@query(
    "corrections_by_reviewer",
    "SELECT coalesce(nullif(reviewer, ''), 'UNKNOWN') AS label, count(*) AS corrections FROM e_feedback GROUP BY 1",
)
def corrections_by_reviewer(t):
    return FB.corrections_by(t.feedback, "reviewer")


@query(
    "corrections_by_decision",
    "SELECT coalesce(nullif(decision, ''), 'UNKNOWN') AS label, count(*) AS corrections FROM e_feedback GROUP BY 1",
)
def corrections_by_decision(t):
    return FB.corrections_by(t.feedback, "decision")


@query(
    "corrections_by_document_type",
    """SELECT coalesce(d.document_type, 'UNKNOWN') AS label, count(*) AS corrections FROM e_feedback f
LEFT JOIN (SELECT document_id, document_type FROM e_documents) d ON d.document_id = f.document_id GROUP BY 1""",
)
def corrections_by_document_type(t):
    rows = with_document_type(t.feedback.select("document_id"), t.entity("documents"))
    return FB.corrections_by(rows, "document_type")


@query(
    "daily_corrections",
    "SELECT CAST(recorded_at AS DATE) AS day, count(*) AS corrections FROM e_feedback GROUP BY 1",
)
def daily_corrections(t):
    return FB.daily_corrections(t.feedback)


@query("deduped_feedback", f"WITH {_DEDUPED} SELECT * FROM ded")
def deduped_feedback(t):
    return FB.dedupe_feedback(t.feedback)


@query("curated_dataset", f"WITH {_CURATED} SELECT * FROM cur")
def curated_dataset(t):
    return _curated(t)


@query(
    "curation_exclusions",
    f"""WITH {_DEDUPED} SELECT {_REASON} AS reason, count(*) AS entries FROM ded GROUP BY 1 HAVING reason IS NOT NULL
UNION ALL SELECT 'duplicate', (SELECT count(*) FROM e_feedback) - (SELECT count(*) FROM ded)""",
)
def curation_exclusions(t):
    return FB.exclusions(t.feedback)


_BUCKET = """CASE WHEN confidence_score < 0.2 THEN '0.00-0.20' WHEN confidence_score < 0.4 THEN '0.20-0.40' WHEN confidence_score < 0.6 THEN '0.40-0.60'
 WHEN confidence_score < 0.8 THEN '0.60-0.80' ELSE '0.80-1.00' END"""


@query(
    "learning_statistics",
    f"""WITH {_CURATED}, x AS (SELECT 'document_type' AS dimension, document_type AS label, confidence_score AS c FROM cur
 UNION ALL SELECT 'field_name', field_name, confidence_score FROM cur UNION ALL SELECT 'decision', coalesce(nullif(decision, ''), 'UNKNOWN'), confidence_score FROM cur
 UNION ALL SELECT 'reviewer', reviewer, confidence_score FROM cur UNION ALL SELECT 'confidence', {_BUCKET}, confidence_score FROM cur)
SELECT dimension, label, count(*) AS records, round(avg(c), 9) AS average_confidence FROM x GROUP BY 1, 2""",
)
def learning_statistics(t):
    return FB.learning_statistics(_curated(t)).withColumn(
        "average_confidence", F.round("average_confidence", 9)
    )


@query(
    "dataset_completeness",
    f"""WITH {_CURATED}, s AS (SELECT count(*) AS n, count(*) FILTER (WHERE document_type <> 'UNKNOWN') AS a, count(*) FILTER (WHERE normalized_value <> '') AS b,
 count(*) FILTER (WHERE confidence_source <> '') AS c, count(*) FILTER (WHERE correction_reason <> '') AS d, count(*) FILTER (WHERE decision <> '') AS e,
 count(*) FILTER (WHERE origin <> '') AS f, count(*) FILTER (WHERE reviewer <> 'UNKNOWN') AS g FROM cur)
SELECT unnest(['document_type', 'normalized_value', 'confidence_source', 'correction_reason', 'decision', 'origin', 'reviewer']) AS field,
 unnest([round(a::DOUBLE / n, 4), round(b::DOUBLE / n, 4), round(c::DOUBLE / n, 4), round(d::DOUBLE / n, 4), round(e::DOUBLE / n, 4), round(f::DOUBLE / n, 4), round(g::DOUBLE / n, 4)]) AS share FROM s""",
)
def dataset_completeness(t):
    return FB.dataset_completeness(_curated(t))


_HASH = "sha256(concat_ws(chr(31), " + ", ".join(
    f"coalesce(CAST({c} AS VARCHAR), '\\N')" for c in FB.vocab.LEARNING_COLUMNS
) + "))"


@query(
    "learning_version",
    f"""WITH {_CURATED}, h AS (SELECT {_HASH} AS h FROM cur),
s AS (SELECT count(*) AS n, sum(('0x' || substr(h, 1, 15))::HUGEINT) AS s0, sum(('0x' || substr(h, 16, 15))::HUGEINT) AS s1,
 sum(('0x' || substr(h, 31, 15))::HUGEINT) AS s2, sum(('0x' || substr(h, 46, 15))::HUGEINT) AS s3 FROM h)
SELECT n AS record_count, sha256(concat_ws(':', n::VARCHAR, s0::VARCHAR, s1::VARCHAR, s2::VARCHAR, s3::VARCHAR)) AS dataset_hash,
 'cl-1.0.0-' || substr(sha256(concat_ws(':', n::VARCHAR, s0::VARCHAR, s1::VARCHAR, s2::VARCHAR, s3::VARCHAR)), 1, 12) AS dataset_version FROM s""",
)
def learning_version(t):
    return FB.learning_version(_curated(t))


@query(
    "feedback_export",
    f"""SELECT id, application_id, document_id, ocr_result_id, field_name, ocr_value AS original_ocr_value, normalized_value, human_value AS human_corrected_value,
 confidence_score, confidence_source, correction_reason, reviewer, decision, origin, {_ISO} AS recorded_at FROM e_feedback""",
)
def feedback_export(t):
    return FB.feedback_export_rows(t.feedback)


@query(
    "learning_export",
    f"""WITH {_CURATED} SELECT application_id, document_type, field_name, original_ocr_value, normalized_value, human_corrected_value, confidence_score,
 confidence_source, correction_reason, decision, origin, recorded_at FROM cur""",
)
def learning_export(t):
    return FB.learning_export_rows(_curated(t))


@query(
    "replaced_results",
    """WITH n AS (SELECT application_id, rule_id, rule_category, 'RERUN' AS status FROM e_results WHERE application_id % 3 = 0 AND rule_category IN ('date', 'format'))
SELECT application_id, rule_id, rule_category, status FROM e_results r WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.application_id = r.application_id AND n.rule_category = r.rule_category)
UNION ALL SELECT * FROM n""",
)
def replaced_results(t):
    old = t.results.select("application_id", "rule_id", "rule_category", "status")
    new = old.filter("application_id % 3 = 0 AND rule_category IN ('date', 'format')").withColumn(
        "status", F.lit("RERUN")
    )
    return exports.replaced_results(old, new)


@query(
    "field_upsert",
    # Both sides come from one row each, so known, new and refreshed rows need no join.
    """SELECT ocr_result_id, field_name, CASE WHEN ocr_result_id % 4 = 0 THEN upper(extracted_value) ELSE extracted_value END AS extracted_value,
 CASE WHEN ocr_result_id % 4 = 0 THEN 0.5 ELSE confidence_score END AS confidence_score,
 CASE WHEN ocr_result_id % 3 <> 0 THEN human_corrected_value ELSE 'machine' END AS human_corrected_value
FROM e_fields WHERE ocr_result_id % 3 <> 0 OR ocr_result_id % 4 = 0""",
)
def field_upsert(t):
    base = t.fields.filter("ocr_result_id % 3 <> 0").select(
        "ocr_result_id", "field_name", "extracted_value", "confidence_score", "human_corrected_value"
    )
    updates = t.fields.filter("ocr_result_id % 4 = 0").select(
        "ocr_result_id",
        "field_name",
        F.upper("extracted_value").alias("extracted_value"),
        F.lit(0.5).alias("confidence_score"),
        F.lit("machine").alias("human_corrected_value"),
    )
    return exports.upsert(
        base, updates, ["ocr_result_id", "field_name"], keep=["human_corrected_value"]
    )
