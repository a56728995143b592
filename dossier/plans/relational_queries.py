"""List, search, lookup and set queries."""

from pyspark.sql import functions as F

from dossier import vocab
from dossier.operators import relational as R
from dossier.plans.catalog import query
from dossier.sources.bindings import ENTITIES, _values  # noqa: F401

_APPS = "application_id, status, submitted_at, updated_at, created_by, name, reviewer_comments"


@query(
    "list_applications",
    f"SELECT {_APPS} FROM e_applications WHERE status = 'SUBMITTED' ORDER BY submitted_at DESC, application_id DESC LIMIT 50 OFFSET 20",
)
def list_applications(t):
    return R.list_applications(t.applications, "SUBMITTED", 20, 50)


@query(
    "search_applications",
    f"""SELECT {_APPS} FROM e_applications WHERE name ILIKE '%CHANT 1_%' OR created_by ILIKE '%CHANT 1_%'
ORDER BY submitted_at DESC, application_id DESC LIMIT 40 OFFSET 10""",
)
def search_applications(t):
    return R.search_applications(t.applications, "CHANT 1_", None, 10, 40)


@query(
    "search_applications_by_number",
    f"SELECT {_APPS} FROM e_applications WHERE (name ILIKE '%17%' OR created_by ILIKE '%17%' OR application_id = 17) AND status = 'PROCESSING'",
)
def search_applications_by_number(t):
    return R.matching_applications(t.applications, "17", "PROCESSING")


@query(
    "search_applications_total",
    "SELECT count(*) AS total FROM e_applications WHERE name ILIKE '%CHANT 1_%' OR created_by ILIKE '%CHANT 1_%'",
)
def search_applications_total(t):
    return R.total(R.matching_applications(t.applications, "CHANT 1_"))


@query(
    "filter_feedback",
    """SELECT f.id, f.application_id, f.document_id, f.field_name, f.decision, f.recorded_at FROM e_feedback f JOIN e_documents d USING (document_id)
WHERE d.document_type = 'ACCOUNT_MAINTENANCE_CERTIFICATE' AND f.decision = 'CORRECT' AND f.confidence_score >= 0.3
AND f.recorded_at >= TIMESTAMP '1996-01-01' AND f.recorded_at <= TIMESTAMP '2000-12-31'""",
)
def filter_feedback(t):
    rows = R.filter_feedback(
        t.feedback,
        t.entity("documents"),
        document_type=vocab.CERTIFICATE,
        decision="CORRECT",
        min_confidence=0.3,
        date_from="1996-01-01",
        date_to="2000-12-31",
    )
    return rows.select("id", "application_id", "document_id", "field_name", "decision", "recorded_at")


@query(
    "search_audit",
    """SELECT id, application_id, username, action, severity, performed_at FROM e_audit
WHERE application_id IS NOT NULL AND username ILIKE '%rev_1%' AND severity = 'WARNING' AND (username ILIKE '%click%' OR action ILIKE '%click%')
AND performed_at >= TIMESTAMP '2024-01-03' AND performed_at < TIMESTAMP '2024-01-25'""",
)
def search_audit(t):
    return R.search_audit(
        t.audit,
        actor="rev_1",
        severity="WARNING",
        text="click",
        date_from="2024-01-03",
        date_to="2024-01-25",
        include_orphaned=False,
    )


@query(
    "audit_page",
    "SELECT id, performed_at FROM e_audit WHERE action = 'audit.view' ORDER BY performed_at DESC, id DESC LIMIT 25 OFFSET 50",
)
def audit_page(t):
    rows = R.search_audit(t.audit, action="audit.view").select("id", "performed_at")
    return R.page(rows, [F.col("performed_at").desc(), F.col("id").desc()], 50, 25)


@query(
    "rule_category_rows",
    "SELECT application_id, document_id, rule_id, status FROM e_results WHERE rule_category <> 'experimental'",
)
def rule_category_rows(t):
    return R.rule_results(t.results).select("application_id", "document_id", "rule_id", "status")


@query(
    "verified_fields",
    """SELECT document_id, field_name, verification_status FROM e_fields
WHERE verification_status IS NULL OR verification_status NOT IN ('PENDING_REVIEW', 'CANNOT_VERIFY')""",
)
def verified_fields(t):
    return R.verified_only(t.fields).select("document_id", "field_name", "verification_status")


@query(
    "stale_values_suppressed",
    """SELECT document_id, field_name, CASE WHEN verification_status IN ('PENDING_REVIEW', 'CANNOT_VERIFY') THEN NULL ELSE normalized_value END AS normalized_value FROM e_fields""",
)
def stale_values_suppressed(t):
    return R.suppress_stale(t.fields).select("document_id", "field_name", "normalized_value")


@query(
    "status_transitions",
    """SELECT application_id, status AS previous_status,
 CASE WHEN application_id % 3 <> 0 AND status IN ('SUBMITTED', 'NEEDS_DOCUMENTS') THEN 'PROCESSING' ELSE status END AS status,
 application_id % 3 <> 0 AND status IN ('SUBMITTED', 'NEEDS_DOCUMENTS') AS moved FROM e_applications""",
)
def status_transitions(t):
    requests = t.applications.filter("application_id % 3 <> 0").select(
        "application_id",
        F.lit("PROCESSING").alias("new_status"),
        F.array(F.lit("SUBMITTED"), F.lit("NEEDS_DOCUMENTS")).alias("allowed"),
    )
    return R.transition_if(t.applications, requests)


@query(
    "reviewer_comments",
    f"""SELECT application_id, status, CASE WHEN trim(coalesce(reviewer_comments, '')) <> '' THEN trim(reviewer_comments)
 WHEN status IN ('APPROVED', 'CORRECTED') THEN '{vocab.COMMENT_APPROVED}' WHEN status = 'REJECTED' THEN '{vocab.COMMENT_REJECTED}'
 WHEN status = 'NEEDS_DOCUMENTS' THEN '{vocab.COMMENT_NEEDS_DOCUMENTS}' ELSE '{vocab.COMMENT_DEFAULT}' END AS comment FROM e_applications""",
)
def reviewer_comments(t):
    return R.resolve_comment(t.applications)


@query(
    "document_job_messages",
    """SELECT job_id, application_id, CASE status WHEN 'RETRY_WAITING' THEN 'QUEUED' ELSE status END AS status,
 CASE status WHEN 'QUEUED' THEN 'Waiting to start' WHEN 'RETRY_WAITING' THEN 'Waiting to retry' WHEN 'PROCESSING' THEN 'Processing'
  WHEN 'COMPLETED' THEN 'Processed successfully' ELSE 'Needs attention' END AS message,
 coalesce(completed_at, started_at, created_at) AS updated_at FROM e_jobs WHERE job_type = 'DOCUMENT_OCR'""",
)
def document_job_messages(t):
    return R.document_job_messages(t.jobs)


@query(
    "text_preview",
    """SELECT d.document_id, d.application_id, CASE WHEN o.document_id IS NULL THEN 'NOT_PROCESSED' WHEN o.processing_method = 'PADDLE_OCR' THEN 'OCR_PROCESSED'
 ELSE 'TEXT_EXTRACTED' END AS ocr_status, o.overall_confidence AS ocr_confidence, left(o.raw_ocr_text, 1000) AS ocr_text_preview
FROM e_documents d LEFT JOIN e_ocr o USING (document_id)""",
)
def text_preview(t):
    return R.text_preview(t.entity("documents"), t.ocr)


@query(
    "fields_with_documents",
    """SELECT o.document_id, f.ocr_result_id, f.field_name, f.extracted_value, f.confidence_score, d.application_id, d.document_type
FROM e_fields f JOIN e_ocr o ON f.ocr_result_id = o.ocr_result_id JOIN e_documents d ON d.document_id = o.document_id""",
)
def fields_with_documents(t):
    return R.fields_with_documents(t.fields, t.ocr, t.entity("documents"))


@query(
    "analysis_with_documents",
    """SELECT document_id, x.verification_status, x.confidence_score, d.application_id, d.document_type FROM e_analysis x JOIN e_documents d USING (document_id)""",
)
def analysis_with_documents(t):
    return R.analysis_with_documents(t.analysis, t.entity("documents"))


@query(
    "detections_with_documents",
    """SELECT document_id, x.detection_type, x.is_present, x.confidence, d.application_id, d.document_type FROM e_detections x JOIN e_documents d USING (document_id)""",
)
def detections_with_documents(t):
    return R.detections_with_documents(t.detections, t.entity("documents"))


@query(
    "feedback_document_types",
    """SELECT f.id, f.document_id, coalesce(d.document_type, 'UNKNOWN') AS document_type FROM e_feedback f LEFT JOIN e_documents d USING (document_id)""",
)
def feedback_document_types(t):
    rows = t.feedback.select("id", "document_id")
    return R.with_document_type(rows, t.entity("documents"))


@query(
    "field_source_context",
    """SELECT f.ocr_result_id, f.field_name, coalesce(o.document_id, 0) AS document_id, coalesce(d.original_filename, 'unknown') AS file_name
FROM e_fields f LEFT JOIN e_ocr o ON f.ocr_result_id = o.ocr_result_id LEFT JOIN e_documents d ON d.document_id = o.document_id AND d.suppkey % 10 <> 0""",
)
def field_source_context(t):
    known = t.entity("documents").filter("suppkey % 10 <> 0")
    return R.field_source_context(t.fields, t.ocr, known)


@query(
    "documents_without_job",
    """SELECT document_id, application_id FROM e_documents d WHERE processing_status = 'UPLOADED' AND NOT EXISTS (SELECT 1 FROM e_doc_jobs j WHERE j.document_id = d.document_id)""",
)
def documents_without_job(t):
    return R.documents_without_job(t.entity("documents"), t.doc_jobs)


@query(
    "documents_with_job",
    """SELECT document_id, application_id FROM e_documents d WHERE processing_status = 'UPLOADED' AND EXISTS (SELECT 1 FROM e_doc_jobs j WHERE j.document_id = d.document_id)""",
)
def documents_with_job(t):
    return R.documents_with_job(t.entity("documents"), t.doc_jobs)


_ITEMS = _values((i,) for i in vocab.CHECKLIST_ITEMS)


@query(
    "checklist_state",
    f"""SELECT a.application_id, i.item_name, coalesce(c.is_checked, false) AS is_checked, c.reviewer, c.checked_at
FROM e_applications a CROSS JOIN (VALUES {_ITEMS}) AS i(item_name)
LEFT JOIN e_checklists c ON c.application_id = a.application_id AND c.item_name = i.item_name""",
)
def checklist_state(t):
    return R.checklist_state(t.applications, t.checklists)


@query(
    "match_corrections",
    """WITH c AS (SELECT document_id AS correction_id, application_id, CASE WHEN partkey % 3 = 0 THEN NULL ELSE document_id END AS document_id,
 CASE partkey % 4 WHEN 0 THEN 'iban' WHEN 1 THEN 'account_holder' ELSE 'bank_name' END AS field_name FROM e_documents WHERE suppkey % 4 = 1),
f AS (SELECT application_id, document_id, field_name, coalesce(nullif(human_corrected_value, ''), extracted_value) AS v FROM e_fields),
l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY application_id, field_name ORDER BY document_id DESC) = 1)
SELECT c.correction_id, c.application_id, c.document_id, c.field_name, f.document_id AS matched_document_id, f.v AS current_value FROM c
 LEFT JOIN f ON f.document_id = c.document_id AND f.field_name = c.field_name AND f.application_id = c.application_id WHERE c.document_id IS NOT NULL
UNION ALL SELECT c.correction_id, c.application_id, c.document_id, c.field_name, l.document_id, l.v FROM c
 LEFT JOIN l ON l.application_id = c.application_id AND l.field_name = c.field_name WHERE c.document_id IS NULL""",
)
def match_corrections(t):
    corrections = t.entity("documents").filter("suppkey % 4 = 1").selectExpr(
        "document_id AS correction_id",
        "application_id",
        "CASE WHEN partkey % 3 = 0 THEN NULL ELSE document_id END AS document_id",
        "CASE partkey % 4 WHEN 0 THEN 'iban' WHEN 1 THEN 'account_holder' ELSE 'bank_name' END AS field_name",
    )
    return R.match_corrections(corrections, t.fields)


_RULES = _values(vocab.rule_catalogue())


@query(
    "rules_x_applications",
    f"SELECT application_id, rule_id, rule_name, rule_category FROM e_applications CROSS JOIN (VALUES {_RULES}) AS r(rule_id, rule_name, rule_category)",
)
def rules_x_applications(t):
    return R.rules_x_applications(t.applications)


@query(
    "salary_month_in_period",
    """WITH v AS (SELECT application_id, document_id, field_name, trim(normalized_value) AS v FROM e_fields WHERE trim(coalesce(normalized_value, '')) <> '')
SELECT m.application_id, m.document_id, m.v AS salary_month,
 bool_and(m.v BETWEEN substr(split_part(p.v, ' - ', 1), 1, 7) AND substr(split_part(p.v, ' - ', 2), 1, 7)) AS within
FROM v m JOIN v p ON p.application_id = m.application_id AND p.field_name = 'statement_period' AND contains(p.v, ' - ')
WHERE m.field_name = 'salary_month' GROUP BY 1, 2, 3""",
)
def salary_month_in_period(t):
    return R.salary_month_in_period(t.fields)


@query(
    "documents_in_order",
    "SELECT application_id, document_id, document_type, uploaded_at FROM e_documents ORDER BY 1, 3, 4 DESC, 2 DESC",
)
def documents_in_order(t):
    return R.documents_in_order(t.entity("documents"))


_REQUIRED = _values((r,) for r in vocab.REQUIRED_TYPES)


@query(
    "type_differences",
    f"""SELECT a.application_id,
 coalesce((SELECT list(r.x ORDER BY r.x) FROM (VALUES {_REQUIRED}) AS r(x) WHERE NOT EXISTS (SELECT 1 FROM e_documents d WHERE d.application_id = a.application_id AND d.document_type = r.x)), []) AS missing_types,
 coalesce((SELECT list(DISTINCT d.document_type ORDER BY d.document_type) FROM e_documents d WHERE d.application_id = a.application_id
  AND d.document_type NOT IN (SELECT x FROM (VALUES {_REQUIRED}) AS r(x)) AND d.document_type NOT IN ('OTHER_SUPPORTING_DOCUMENT', 'BULK_UPLOAD')), []) AS unexpected_types
FROM e_applications a""",
)
def type_differences(t):
    return R.type_differences(t.applications, t.entity("documents"))


_PARTS = _values((r[0], p) for r in vocab.CROSS_RULES + vocab.UNREGISTERED_CROSS_RULES for p in r[3])


@query(
    "participants_missing",
    f"""SELECT a.application_id, p.rule_id, coalesce(list(p.x ORDER BY p.x) FILTER (WHERE d.document_type IS NULL), []) AS missing_participants
FROM e_applications a CROSS JOIN (VALUES {_PARTS}) AS p(rule_id, x)
LEFT JOIN (SELECT DISTINCT application_id, document_type FROM e_documents) d ON d.application_id = a.application_id AND d.document_type = p.x GROUP BY 1, 2""",
)
def participants_missing(t):
    return R.participants_missing(t.applications, t.entity("documents"))
