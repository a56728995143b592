"""Review submission and whole-flow queries."""

from pyspark.sql import functions as F

from dossier import vocab
from dossier.operators import relational, reports, review
from dossier.operators.stages import run_stages
from dossier.plans.catalog import AS_OF, query
from dossier.plans.text_queries import _stored_or_none
from dossier.sources.bindings import _values

_ITEMS = _values(enumerate(vocab.CHECKLIST_ITEMS))
_SUBMITTED = f"""rv AS (SELECT o_orderkey AS review_id, o_orderkey AS application_id, CASE o_custkey % 3 WHEN 0 THEN 'APPROVE' WHEN 1 THEN 'CORRECT' ELSE 'REJECT' END AS decision,
 CASE o_custkey % 4 WHEN 0 THEN 'bad scan' WHEN 1 THEN ' ' END AS rejection_reason FROM orders),
ck AS (SELECT o.o_orderkey AS review_id, CASE WHEN o.o_orderkey % 17 = 0 AND i.no = 3 THEN 'Other item' WHEN o.o_orderkey % 19 = 0 AND i.no = 3 THEN 'Validation report reviewed' ELSE i.nm END AS item_name, NOT (o.o_orderkey % 5 = 0 AND i.no = 2) AS is_checked
 FROM orders o CROSS JOIN (VALUES {_ITEMS}) AS i(no, nm)),
co AS (SELECT o_orderkey AS review_id, o_orderkey AS application_id, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS document_id, CASE WHEN o_orderkey % 13 = 0 THEN 'iban' ELSE f END AS field_name, 'fixed ' || f AS corrected_value
 FROM orders CROSS JOIN (VALUES (0, 'iban'), (1, 'branch')) AS x(n, f) WHERE o_custkey % 5 > n)"""
_CHECKED = f"""{_SUBMITTED}, u AS (SELECT review_id, min(item_name) AS x FROM ck WHERE item_name = 'Other item' GROUP BY 1), rp AS (SELECT review_id, min(item_name) AS x FROM (SELECT review_id, item_name FROM ck GROUP BY 1, 2 HAVING count(*) > 1) z GROUP BY 1),
ms AS (SELECT r.review_id, string_agg(i.nm, ', ' ORDER BY i.nm) AS x FROM rv r CROSS JOIN (VALUES {_ITEMS}) AS i(no, nm) WHERE NOT EXISTS (SELECT 1 FROM ck WHERE ck.review_id = r.review_id AND ck.item_name = i.nm AND ck.is_checked) GROUP BY 1),
cn AS (SELECT review_id, count(*) AS n FROM co GROUP BY 1), tw AS (SELECT DISTINCT review_id FROM co GROUP BY review_id, document_id, field_name HAVING count(*) > 1),
chk AS (SELECT rv.review_id, rv.application_id, rv.decision, CASE WHEN u.x IS NOT NULL THEN 'Unknown checklist item: ''' || u.x || '''' WHEN rp.x IS NOT NULL THEN 'Checklist item listed more than once: ''' || rp.x || ''''
 WHEN decision = 'APPROVE' AND trim(coalesce(rejection_reason, '')) <> '' THEN 'An approval cannot carry a rejection reason' WHEN decision = 'APPROVE' AND cn.n > 0 THEN 'An approval cannot carry corrections'
 WHEN decision = 'APPROVE' AND ms.x IS NOT NULL THEN 'Checklist items not completed: ' || ms.x WHEN decision = 'CORRECT' AND trim(coalesce(rejection_reason, '')) <> '' THEN 'A correction cannot carry a rejection reason'
 WHEN decision = 'CORRECT' AND cn.n IS NULL THEN 'A correction needs at least one corrected field' WHEN decision = 'CORRECT' AND tw.review_id IS NOT NULL THEN 'A field can only be corrected once per review'
 WHEN decision = 'REJECT' AND cn.n > 0 THEN 'A rejection cannot carry corrections' WHEN decision = 'REJECT' AND trim(coalesce(rejection_reason, '')) = '' THEN 'A rejection needs a reason' END AS error, coalesce(cn.n, 0) AS corrections
 FROM rv LEFT JOIN u USING (review_id) LEFT JOIN rp USING (review_id) LEFT JOIN ms USING (review_id) LEFT JOIN cn USING (review_id) LEFT JOIN tw USING (review_id))"""
_STATUS = "CASE decision WHEN 'APPROVE' THEN 'APPROVED' WHEN 'CORRECT' THEN 'CORRECTED' ELSE 'REJECTED' END"


def _submitted(t):
    orders = t.source("orders")
    reviews = orders.selectExpr(
        "o_orderkey AS review_id",
        "o_orderkey AS application_id",
        "CASE o_custkey % 3 WHEN 0 THEN 'APPROVE' WHEN 1 THEN 'CORRECT' ELSE 'REJECT' END AS decision",
        "CASE o_custkey % 4 WHEN 0 THEN 'bad scan' WHEN 1 THEN ' ' END AS rejection_reason",
    )
    items = F.array(*[F.lit(i) for i in vocab.CHECKLIST_ITEMS])
    key, no = F.col("o_orderkey"), F.col("no")
    checklist = orders.select("o_orderkey", F.posexplode(items).alias("no", "nm")).select(
        key.alias("review_id"),
        F.when((key % 17 == 0) & (no == 3), "Other item")
        .when((key % 19 == 0) & (no == 3), "Validation report reviewed")
        .otherwise(F.col("nm"))
        .alias("item_name"),
        (~((key % 5 == 0) & (no == 2))).alias("is_checked"),
    )
    names = F.array(F.lit("iban"), F.lit("branch"))
    corrections = (
        orders.select("o_orderkey", "o_custkey", F.posexplode(names).alias("n", "f"))
        .filter("o_custkey % 5 > n")
        .selectExpr(
            "o_orderkey AS review_id",
            "o_orderkey AS application_id",
            "CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS document_id",
            "CASE WHEN o_orderkey % 13 = 0 THEN 'iban' ELSE f END AS field_name",
            "'fixed ' || f AS corrected_value",
        )
    )
    return reviews, checklist, corrections


@query(
    "check_reviews",
    f"WITH {_CHECKED} SELECT review_id, application_id, decision, error, error IS NULL AS accepted, CASE WHEN error IS NULL THEN {_STATUS} END AS new_status, corrections FROM chk",
)
def check_reviews(t):
    return review.check_reviews(*_submitted(t))


@query(
    "apply_reviews",
    f"""WITH {_CHECKED} SELECT a.application_id, a.status AS previous_status, CASE WHEN d.application_id IS NULL THEN {_STATUS} ELSE a.status END AS status,
 CASE WHEN d.application_id IS NULL THEN chk.review_id END AS review_id, d.application_id IS NULL AS applied
FROM chk JOIN e_applications a USING (application_id) LEFT JOIN (SELECT DISTINCT application_id FROM e_reviews) d USING (application_id) WHERE chk.error IS NULL""",
)
def apply_reviews(t):
    return review.apply_reviews(t.applications, check_reviews(t), t.reviews)


@query(
    "apply_corrections",
    f"""WITH {_SUBMITTED}, f AS (SELECT application_id, document_id, field_name, coalesce(nullif(human_corrected_value, ''), extracted_value) AS v FROM e_fields),
l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY application_id, field_name ORDER BY document_id DESC) = 1),
m AS (SELECT co.*, f.document_id AS matched_document_id, f.v AS original_value FROM co LEFT JOIN f ON f.application_id = co.application_id AND f.document_id = co.document_id AND f.field_name = co.field_name WHERE co.document_id IS NOT NULL
 UNION ALL SELECT co.*, l.document_id, l.v FROM co LEFT JOIN l ON l.application_id = co.application_id AND l.field_name = co.field_name WHERE co.document_id IS NULL)
SELECT *, matched_document_id IS NOT NULL AND original_value IS DISTINCT FROM corrected_value AS changed FROM m""",
)
def apply_corrections(t):
    return review.apply_corrections(_submitted(t)[2], t.fields)


@query("review_history", "SELECT * FROM e_reviews ORDER BY application_id, reviewed_at DESC, id DESC")
def review_history(t):
    return review.review_history(t.reviews)


@query(
    "review_dataset",
    f"""SELECT application_id, 'application' AS section, 'status' AS item, status AS value FROM e_applications
UNION ALL SELECT d.application_id, 'document', CAST(d.document_id AS VARCHAR), CASE WHEN o.document_id IS NULL THEN 'NOT_PROCESSED' WHEN o.processing_method = 'PADDLE_OCR' THEN 'OCR_PROCESSED' ELSE 'TEXT_EXTRACTED' END FROM e_documents d LEFT JOIN e_ocr o USING (document_id)
UNION ALL SELECT application_id, 'field', document_id || ':' || field_name, coalesce(human_corrected_value, normalized_value, extracted_value) FROM e_fields
UNION ALL SELECT application_id, 'detection', document_id || ':' || detection_type, CAST(is_present AS VARCHAR) FROM e_detections
UNION ALL SELECT a.application_id, 'checklist', i.nm, CAST(coalesce(c.is_checked, false) AS VARCHAR) FROM e_applications a CROSS JOIN (VALUES {_ITEMS}) AS i(no, nm) LEFT JOIN e_checklists c ON c.application_id = a.application_id AND c.item_name = i.nm
UNION ALL SELECT application_id, 'last_review', 'decision', arg_max(decision, struct_pack(a := reviewed_at, b := id)) FROM e_reviews GROUP BY 1""",
)
def review_dataset(t):
    rows = reports.report_document_rows(t.entity("documents"), t.ocr, t.analysis, t.checks)
    state = relational.checklist_state(t.applications, t.checklists)
    return review.review_dataset(t.applications, rows, t.fields, t.detections, state, t.reviews)


@query("analysis_stages")
def analysis_stages(t):
    """Texts to statuses over all texts; see :func:`run_stages`."""
    texts = _stored_or_none(t)
    documents = texts.select(
        "document_id",
        "application_id",
        F.coalesce("stored_type", F.lit(vocab.SUPPORTING)).alias("document_type"),
        F.lit(AS_OF).cast("timestamp_ntz").alias("uploaded_at"),
    )
    return run_stages(t.applications, documents, texts, t.detections, AS_OF)
