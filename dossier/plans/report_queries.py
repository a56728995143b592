"""Report queries."""

from pyspark.sql import functions as F

from dossier import vocab
from dossier.operators import completeness as C
from dossier.operators import reports as R
from dossier.plans.catalog import query
from dossier.plans.document_queries import _COMPLETE
from dossier.sources.bindings import _values

_RULES = "res AS (SELECT * FROM e_results WHERE rule_category <> 'experimental')"
_COUNTS = """count({0}) AS total, count({0}) FILTER (WHERE r.status = 'PASS') AS passed, count({0}) FILTER (WHERE r.status = 'FAIL') AS failed,
 count({0}) FILTER (WHERE r.status = 'WARNING') AS warnings, count({0}) FILTER (WHERE r.status = 'PENDING_MANUAL_REVIEW') AS pending_review""".format("r.rule_id")
_CATS = _values((c,) for c in vocab.RULE_CATEGORIES)
_GROUPS = _values((g,) for g in vocab.REPORT_GROUPS)
_GROUP_OF = """CASE WHEN rule_category IN ('document_completeness', 'field_presence') THEN 'Document Validation' WHEN rule_category = 'format' THEN 'Format Validation'
 WHEN rule_category = 'cross_document' THEN 'Cross Document Validation' WHEN rule_category = 'date' THEN 'Date Validation' WHEN rule_id LIKE 'VIS_SIGNATURE%' THEN 'Signature Validation'
 WHEN rule_id LIKE 'VIS_STAMP%' THEN 'Stamp Validation' WHEN rule_category = 'policy' THEN 'Business Policy Validation' WHEN rule_category = 'quality' THEN 'Quality Validation' ELSE rule_category END"""


@query(
    "rule_summary",
    f"""WITH {_RULES} SELECT a.application_id, c.x AS rule_category, {_COUNTS} FROM (SELECT DISTINCT application_id FROM res) a CROSS JOIN (VALUES {_CATS}) AS c(x)
LEFT JOIN res r ON r.application_id = a.application_id AND r.rule_category = c.x GROUP BY 1, 2""",
)
def rule_summary(t):
    return R.rule_summary(t.results)


@query("rule_totals", f"WITH {_RULES} SELECT r.application_id, {_COUNTS} FROM res r GROUP BY 1")
def rule_totals(t):
    return R.rule_totals(t.results)


@query(
    "overall_rule_status",
    f"""WITH {_RULES} SELECT application_id, CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_or(status = 'PENDING_MANUAL_REVIEW') THEN 'PENDING_MANUAL_REVIEW'
 WHEN bool_or(status = 'WARNING') THEN 'WARNING' ELSE 'PASS' END AS validation_status FROM res GROUP BY 1""",
)
def overall_rule_status(t):
    return R.overall_rule_status(t.results)


@query(
    "report_rule_groups",
    f"""WITH {_RULES}, lab AS (SELECT *, {_GROUP_OF} AS g FROM res) SELECT a.application_id, c.x AS report_group, {_COUNTS} FROM (SELECT DISTINCT application_id FROM res) a
CROSS JOIN (VALUES {_GROUPS}) AS c(x) LEFT JOIN lab r ON r.application_id = a.application_id AND r.g = c.x GROUP BY 1, 2""",
)
def report_rule_groups(t):
    return R.report_rule_groups(t.results)


# Half-up on the decimal value, as Spark rounds: a binary tie such as 0.53875 goes up.
_EXTRACTION = """ex AS (SELECT application_id, count(*) AS total_fields, count(*) FILTER (WHERE verification_status = 'AUTO_VERIFIED') AS auto_verified,
 count(*) FILTER (WHERE verification_status = 'CORRECTED' OR coalesce(human_corrected_value, '') <> '') AS human_corrected, count(*) FILTER (WHERE verification_status = 'PENDING_REVIEW') AS pending_review,
 count(*) FILTER (WHERE verification_status = 'CANNOT_VERIFY') AS cannot_verify, CAST(round(CAST(avg(confidence_score) AS DECIMAL(20, 12)), 4) AS DOUBLE) AS overall_confidence FROM e_fields GROUP BY 1)"""


@query("extraction_summary", f"WITH {_EXTRACTION} SELECT * FROM ex")
def extraction_summary(t):
    return R.extraction_summary(t.fields)


@query(
    "field_progress",
    f"""WITH {_EXTRACTION} SELECT application_id, total_fields AS total, auto_verified AS verified, pending_review AS needs_review,
 CAST(floor(auto_verified::DOUBLE / total_fields * 100 + 0.5) AS INT) AS progress FROM ex""",
)
def field_progress(t):
    return R.field_progress(R.extraction_summary(t.fields))


_VISUAL = """vs AS (SELECT application_id, count(DISTINCT document_id) AS documents_checked, count(*) FILTER (WHERE detection_type = 'SIGNATURE' AND is_present) AS signature_detected,
 count(*) FILTER (WHERE detection_type = 'SIGNATURE' AND NOT is_present) AS signature_missing, count(*) FILTER (WHERE detection_type = 'STAMP' AND is_present) AS stamp_detected,
 count(*) FILTER (WHERE detection_type = 'STAMP' AND NOT is_present) AS stamp_missing, CAST(round(CAST(avg(confidence) AS DECIMAL(20, 12)), 4) AS DOUBLE) AS average_confidence FROM e_detections GROUP BY 1)"""


@query("visual_summary", f"WITH {_VISUAL} SELECT * FROM vs")
def visual_summary(t):
    return R.visual_summary(t.detections)


@query(
    "report_document_rows",
    """WITH c AS (SELECT document_id, bool_or(status = 'FAIL') AS f FROM e_checks GROUP BY 1)
SELECT d.document_id, d.application_id, d.document_type, d.processing_status, CASE WHEN o.document_id IS NULL THEN 'NOT_PROCESSED' WHEN o.processing_method = 'PADDLE_OCR' THEN 'OCR_PROCESSED' ELSE 'TEXT_EXTRACTED' END AS ocr_status,
 o.overall_confidence AS ocr_confidence, CASE WHEN c.f IS NULL THEN 'NOT_VALIDATED' WHEN c.f THEN 'FAILED' ELSE 'PASS' END AS technical_validation_status,
 coalesce(x.verification_status, 'NOT_ANALYZED') AS analysis_status
FROM e_documents d LEFT JOIN e_ocr o USING (document_id) LEFT JOIN c USING (document_id) LEFT JOIN e_analysis x USING (document_id)""",
)
def report_document_rows(t):
    return R.report_document_rows(t.entity("documents"), t.ocr, t.analysis, t.checks)


_OVERALL = f"""{_RULES}, rf AS (SELECT application_id, bool_or(status = 'FAIL') AS f, bool_or(status = 'PENDING_MANUAL_REVIEW') AS p FROM res GROUP BY 1),
cf AS (SELECT application_id, bool_or(status = 'FAIL') AS f, bool_or(status = 'FAIL' AND contains(message, 'Blur score')) AS blur FROM e_checks GROUP BY 1),
ov AS (SELECT a.application_id, a.status, rf.f IS NULL OR rf.p AS pending, coalesce(cf.blur, false) AS blur, CASE WHEN a.status = 'REJECTED' THEN 'REJECTED' WHEN coalesce(rf.f, false) OR coalesce(cf.f, false) THEN 'FAILED'
 WHEN rf.f IS NULL OR rf.p THEN 'MANUAL_REVIEW_REQUIRED' ELSE 'APPROVED' END AS overall_status FROM e_applications a LEFT JOIN rf USING (application_id) LEFT JOIN cf USING (application_id))"""


@query("report_overall_status", f"WITH {_OVERALL} SELECT application_id, status, overall_status FROM ov")
def report_overall_status(t):
    return R.report_overall_status(t.applications, t.results, t.checks)


_DOC_MAP = _values((r.rule_id, r.document_type) for r in vocab.DOCUMENT_RULES)
_VIS_MAP = _values((r.rule_id, r.document_type, r.detection_type) for r in vocab.VISUAL_RULES)


def _listed(code, before, after, source):
    return f"SELECT application_id, '{code}' AS code, '{before}' || string_agg(DISTINCT x, ', ' ORDER BY x) || '{after}' AS message FROM {source} GROUP BY 1"


def _flagged(code, source):
    text = dict(vocab.RECOMMENDATIONS)[code]
    return f"SELECT DISTINCT application_id, '{code}', '{text}' FROM {source}"


def _failed(rule_id):
    return f"res WHERE status = 'FAIL' AND rule_id = '{rule_id}'"


_ADVICE = f"""{_OVERALL}, dm(rule_id, x) AS (VALUES {_DOC_MAP}), vm(rule_id, x, k) AS (VALUES {_VIS_MAP}),
fd AS (SELECT r.application_id, dm.x, contains(r.message, 'is present more than once') AS dup FROM res r JOIN dm USING (rule_id) WHERE r.status = 'FAIL'),
fv AS (SELECT r.application_id, vm.x, vm.k FROM res r JOIN vm USING (rule_id) WHERE r.status = 'FAIL'),
adv AS ({_listed("MISSING_REQUIRED_DOCUMENT", "Ensure all required documents are uploaded: ", ".", "fd WHERE NOT dup")}
 UNION ALL {_listed("DUPLICATE_REQUIRED_DOCUMENT", "Multiple copies were uploaded for: ", ". Confirm which copy is correct.", "fd WHERE dup")}
 UNION ALL {_listed("MISSING_SIGNATURE", "Review missing signatures on: ", ".", "fv WHERE k = 'SIGNATURE'")} UNION ALL {_listed("MISSING_STAMP", "Review missing stamps on: ", ".", "fv WHERE k = 'STAMP'")}
 UNION ALL {_flagged("IBAN_INCONSISTENCY", _failed("CROSS_IBAN_MATCH"))} UNION ALL {_flagged("HOLDER_INCONSISTENCY", _failed("CROSS_ACCOUNT_HOLDER_MATCH"))}
 UNION ALL {_flagged("ACCOUNT_NUMBER_INCONSISTENCY", _failed("CROSS_ACCOUNT_NUMBER_MATCH"))} UNION ALL {_flagged("PERIOD_INCONSISTENCY", _failed("CROSS_PERIOD_MATCH"))}
 UNION ALL {_flagged("BALANCE_RECONCILIATION", _failed("POL_BALANCE_RECONCILIATION"))} UNION ALL {_flagged("VERIFY_BLURRED_DOCUMENTS", "ov WHERE blur")}
 UNION ALL {_flagged("CORRECT_LOW_CONFIDENCE", "e_fields WHERE confidence_score < 0.5 OR verification_status IN ('PENDING_REVIEW', 'CANNOT_VERIFY')")}
 UNION ALL {_flagged("REVIEW_DATES", "res WHERE status = 'FAIL' AND rule_category = 'date'")} UNION ALL {_flagged("COMPLETE_PENDING_REVIEW", "ov WHERE pending")}),
advice AS (SELECT * FROM adv UNION ALL SELECT application_id, 'NO_ACTION_REQUIRED', 'No corrective action required.' FROM ov WHERE overall_status = 'APPROVED' AND application_id NOT IN (SELECT application_id FROM adv))"""
_ORDER = "CASE code " + " ".join(f"WHEN '{c}' THEN {i}" for i, (c, _) in enumerate(vocab.RECOMMENDATIONS, 1)) + " END"


@query("recommendations", f"WITH {_ADVICE} SELECT application_id, {_ORDER} AS position, code, message FROM advice")
def recommendations(t):
    return R.recommendations(t.applications, t.results, t.checks, t.fields)


_SUMMARY = f"""{_ADVICE}, {_EXTRACTION}, {_VISUAL}, sm AS (SELECT a.application_id, a.status AS application_status, a.overall_status,
 coalesce((SELECT count(*) FROM e_documents d WHERE d.application_id = a.application_id), 0) AS document_count,
 coalesce(k.total, 0) AS rule_total, coalesce(k.passed, 0) AS rule_passed, coalesce(k.failed, 0) AS rule_failed, coalesce(k.warnings, 0) AS rule_warnings, coalesce(k.pending_review, 0) AS rule_pending_review,
 coalesce(ex.total_fields, 0) AS field_count, coalesce((SELECT count(*) FROM advice v WHERE v.application_id = a.application_id), 0) AS recommendation_count, ex.overall_confidence
 FROM ov a LEFT JOIN (SELECT r.application_id, {_COUNTS} FROM res r GROUP BY 1) k USING (application_id) LEFT JOIN ex USING (application_id))"""


@query("validation_summary", f"WITH {_SUMMARY} SELECT * FROM sm")
def validation_summary(t):
    return R.validation_summary(
        t.applications, t.entity("documents"), t.results, t.checks, t.table("fields")
    )


@query(
    "validation_report",
    f"""WITH {_SUMMARY}, lab AS (SELECT *, {_GROUP_OF} AS g FROM res),
gr AS (SELECT a.application_id, c.x AS report_group, {_COUNTS} FROM (SELECT DISTINCT application_id FROM res) a CROSS JOIN (VALUES {_GROUPS}) AS c(x)
 LEFT JOIN lab r ON r.application_id = a.application_id AND r.g = c.x GROUP BY 1, 2),
gl AS (SELECT application_id, CAST(to_json(list(struct_pack(report_group := report_group, total := total, passed := passed, failed := failed, warnings := warnings, pending_review := pending_review) ORDER BY report_group)) AS VARCHAR) AS rule_groups FROM gr GROUP BY 1),
al AS (SELECT application_id, CAST(to_json(list(struct_pack(position := position, code := code, message := message) ORDER BY position)) AS VARCHAR) AS advice FROM (SELECT application_id, {_ORDER} AS position, code, message FROM advice) z GROUP BY 1)
SELECT sm.*, gl.rule_groups, al.advice, vs.* EXCLUDE (application_id) FROM sm LEFT JOIN gl USING (application_id) LEFT JOIN al USING (application_id) LEFT JOIN vs ON vs.application_id = sm.application_id""",
)
def validation_report(t):
    """The report of every application; its lists are shown as JSON."""
    report = R.validation_report(
        t.applications, t.entity("documents"), t.results, t.checks, t.table("fields"), t.detections
    )
    lists = {n: F.to_json(n) for n in ("rule_groups", "advice")}
    return report.withColumns(lists).select(*[c for c in report.columns if c != "visual"], "visual.*")


_TECH = [c[0] for c in vocab.TECHNICAL_CHECKS]
_TECH_ROWS = _values((i, *c) for i, c in enumerate(vocab.TECHNICAL_CHECKS))


@query(
    "technical_verdict",
    f"""WITH tc(no, rule_id, nm, adv) AS (VALUES {_TECH_ROWS}), x AS (SELECT c.*, tc.no, tc.nm, tc.adv FROM e_checks c LEFT JOIN tc USING (rule_id)),
g AS (SELECT application_id, document_id, CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_or(status = 'WARNING') THEN 'WARNING' ELSE 'PASS' END AS validation_status,
 coalesce(bool_and(status = 'PASS') FILTER (WHERE rule_id IN ('TECH_FILE_EXISTS', 'TECH_FILE_READABLE', 'TECH_FILE_NOT_EMPTY')), false) AS file_accessible,
 coalesce(bool_and(status = 'PASS') FILTER (WHERE rule_id = 'TECH_FILE_TYPE'), false) AS file_type_valid,
 bool_and(status = 'PASS') FILTER (WHERE rule_id IN ('TECH_PDF_OPEN', 'TECH_PDF_PASSWORD', 'TECH_PDF_PAGES', 'TECH_PDF_DIMENSIONS')) AS pdf_valid,
 bool_and(status = 'PASS') FILTER (WHERE rule_id IN ('TECH_IMAGE_LOAD', 'TECH_IMAGE_RESOLUTION')) AS image_valid,
 CASE WHEN bool_or(rule_id = 'TECH_ROTATION' AND status = 'WARNING') THEN 'ROTATED' ELSE 'NOT_ROTATED' END AS rotation_status,
 CASE WHEN bool_or(rule_id <> 'TECH_READABILITY' AND status = 'FAIL') THEN 'UNREADABLE' WHEN bool_or(rule_id <> 'TECH_READABILITY' AND status = 'WARNING') THEN 'PARTIALLY_READABLE' ELSE 'READABLE' END AS readability_status,
 coalesce(list(nm ORDER BY no) FILTER (WHERE status = 'FAIL' AND no IS NOT NULL), []) AS failed_checks, coalesce(list(nm ORDER BY no) FILTER (WHERE status = 'WARNING' AND no IS NOT NULL), []) AS warnings,
 list(adv ORDER BY status, no) FILTER (WHERE status IN ('FAIL', 'WARNING') AND no IS NOT NULL) AS a FROM x GROUP BY 1, 2)
SELECT * EXCLUDE (a), coalesce(a, ['Document is technically suitable for processing']) AS recommendations FROM g""",
)
def technical_verdict(t):
    return R.technical_verdict(t.checks)


# Reader views.

_TARGETS = _values(vocab.RULE_TARGET_TYPE.items())
_LABELS = _values(vocab.TYPE_LABELS.items())
_PARTS = _values(
    (r[0], i, p)
    for r in vocab.CROSS_RULES + vocab.UNREGISTERED_CROSS_RULES
    for i, p in enumerate(r[3])
)
_CLASSIFIED = f"""{_COMPLETE}, tg(rule_id, tt) AS (VALUES {_TARGETS}), lb(tt, label) AS (VALUES {_LABELS}), pt(rule_id, i, tt) AS (VALUES {_PARTS}),
ms AS (SELECT application_id, unnest(missing_documents) AS tt FROM c2),
pm AS (SELECT r.document_id, r.rule_id, list(coalesce(lb.label, 'Authority Letter') ORDER BY pt.i) AS gone FROM e_results r JOIN pt USING (rule_id) JOIN ms ON ms.application_id = r.application_id AND ms.tt = pt.tt LEFT JOIN lb ON lb.tt = pt.tt GROUP BY 1, 2),
k AS (SELECT r.*, tg.tt IS NOT NULL AND ms.tt IS NOT NULL AS tgone, coalesce(lb.label, 'Authority Letter') AS tlabel, pm.gone FROM e_results r LEFT JOIN tg USING (rule_id)
 LEFT JOIN ms ON ms.application_id = r.application_id AND ms.tt = tg.tt LEFT JOIN lb ON lb.tt = tg.tt LEFT JOIN pm ON pm.document_id = r.document_id AND pm.rule_id = r.rule_id),
kr AS (SELECT *, CASE WHEN status <> 'FAIL' THEN NULL WHEN rule_id LIKE 'DOC\\_%' ESCAPE '\\' THEN CASE WHEN tgone THEN tlabel || ' is missing' END
 WHEN rule_id LIKE 'FLD\\_%' ESCAPE '\\' THEN CASE WHEN tgone THEN tlabel || ' is missing' END WHEN rule_id LIKE 'VIS\\_%' ESCAPE '\\' AND tgone THEN tlabel || ' is missing'
 WHEN gone IS NOT NULL THEN 'Required document' || CASE WHEN len(gone) > 1 THEN 's' ELSE '' END || ' missing: ' || array_to_string(gone, ', ')
 WHEN rule_id = 'CROSS_ONE_LINK_ACCOUNT_MATCH' AND related_count = 0 THEN 'Required documents are missing'
 WHEN related_count = 0 AND (contains(lower(message), 'is missing') OR contains(lower(message), 'cannot verify') OR contains(lower(message), 'cannot compare')) THEN
  '{vocab.NOT_YET_AVAILABLE}' END AS not_verifiable_reason FROM k),
ks AS (SELECT *, CASE WHEN status = 'PASS' THEN 'PASSED' WHEN status = 'WARNING' THEN 'WARNING' WHEN status = 'FAIL' AND not_verifiable_reason IS NOT NULL THEN 'NOT_VERIFIABLE' WHEN status = 'FAIL' THEN 'FAILED' ELSE 'PENDING' END AS semantic_status FROM kr)"""
_CLASSIFIED = _CLASSIFIED.replace("\\\\", "\\")


def _completeness(t):
    return C.completeness(t.applications, t.entity("documents"))


def _classified(t):
    rows = t.results.withColumn("has_related_documents", F.col("related_count") > 0)
    return R.classify_failures(rows, _completeness(t))


@query(
    "classify_failures",
    f"WITH {_CLASSIFIED} SELECT application_id, document_id, rule_id, status, not_verifiable_reason, semantic_status FROM ks",
)
def classify_failures(t):
    return _classified(t).select(
        "application_id", "document_id", "rule_id", "status", "not_verifiable_reason", "semantic_status"
    )


_SEMANTIC = """count(*) AS total_checks, count(*) FILTER (WHERE semantic_status = 'PASSED') AS passed, count(*) FILTER (WHERE semantic_status = 'FAILED') AS actual_failures,
 count(*) FILTER (WHERE semantic_status = 'WARNING') AS warnings, count(*) FILTER (WHERE semantic_status = 'PENDING') AS pending, count(*) FILTER (WHERE semantic_status = 'NOT_VERIFIABLE') AS not_verifiable"""


@query("semantic_summary", f"WITH {_CLASSIFIED} SELECT application_id, {_SEMANTIC} FROM ks GROUP BY 1")
def semantic_summary(t):
    return R.semantic_summary(_classified(t))


@query(
    "semantic_groups",
    f"WITH {_CLASSIFIED} SELECT application_id, rule_category, {_SEMANTIC} FROM ks GROUP BY 1, 2",
)
def semantic_groups(t):
    return R.semantic_summary(_classified(t), "rule_category")


@query(
    "attention_items",
    f"""WITH {_CLASSIFIED}, n AS (SELECT c2.application_id, len(c2.missing_documents) AS m, len(c2.duplicate_documents) AS d, count(*) FILTER (WHERE semantic_status = 'FAILED') AS f,
 count(*) FILTER (WHERE ks.status = 'PENDING_MANUAL_REVIEW') AS p, count(*) FILTER (WHERE ks.status = 'PENDING_MANUAL_REVIEW' AND rule_id LIKE 'VIS_SIGNATURE_%') AS ps,
 count(*) FILTER (WHERE ks.status = 'PENDING_MANUAL_REVIEW' AND rule_id LIKE 'VIS_STAMP_%') AS pt FROM c2 LEFT JOIN ks USING (application_id) GROUP BY 1, 2, 3)
SELECT application_id, 'failure' AS item_type, f AS item_count, CASE f WHEN 1 THEN 'Actual Validation Failure' ELSE 'Actual Validation Failures' END AS label, 0 AS signature_checks, 0 AS stamp_checks, 0 AS other_checks FROM n WHERE f > 0
UNION ALL SELECT application_id, 'missingDoc', m, CASE m WHEN 1 THEN 'Required Document Missing' ELSE 'Required Documents Missing' END, 0, 0, 0 FROM n WHERE m > 0
UNION ALL SELECT application_id, 'duplicate', d, CASE d WHEN 1 THEN 'Duplicate Document' ELSE 'Duplicate Documents' END, 0, 0, 0 FROM n WHERE d > 0
UNION ALL SELECT application_id, 'pending', p, CASE p WHEN 1 THEN 'Check Pending' ELSE 'Checks Pending' END, ps, pt, p - ps - pt FROM n WHERE p > 0""",
)
def attention_items(t):
    return R.attention_items(_classified(t), _completeness(t))


_REQ = _values((r, vocab.type_label(r), vocab.TYPE_COPIES[r]) for r in vocab.REQUIRED_TYPES)


@query(
    "document_groups",
    f"""SELECT a.application_id, r.x AS document_type, r.label, CASE WHEN count(d.document_id) = 0 THEN 'missing' WHEN count(d.document_id) > r.n THEN 'duplicate' ELSE 'present' END AS status,
 r.n AS required_copies, count(d.document_id) AS copy_count FROM e_applications a CROSS JOIN (VALUES {_REQ}) AS r(x, label, n) LEFT JOIN e_documents d ON d.application_id = a.application_id AND d.document_type = r.x GROUP BY a.application_id, r.x, r.label, r.n""",
)
def document_groups(t):
    return R.document_groups(C.required_vs_received(t.applications, t.entity("documents")))


@query(
    "visual_counts",
    f"""WITH {_CLASSIFIED}, {_VISUAL}, v AS (SELECT application_id, count(*) FILTER (WHERE status = 'PENDING_MANUAL_REVIEW' AND rule_id LIKE 'VIS_SIG%') AS sp, count(*) FILTER (WHERE status = 'FAIL' AND tgone AND rule_id LIKE 'VIS_SIG%') AS sn,
 count(*) FILTER (WHERE status = 'PENDING_MANUAL_REVIEW' AND rule_id LIKE 'VIS_STA%') AS tp, count(*) FILTER (WHERE status = 'FAIL' AND tgone AND rule_id LIKE 'VIS_STA%') AS tn FROM ks GROUP BY 1)
SELECT vs.application_id, signature_detected AS signature_present, signature_missing, stamp_detected AS stamp_present, stamp_missing, coalesce(sp, 0) AS signature_pending, coalesce(sn, 0) AS signature_not_verifiable,
 coalesce(tp, 0) AS stamp_pending, coalesce(tn, 0) AS stamp_not_verifiable FROM vs LEFT JOIN v USING (application_id)""",
)
def visual_counts(t):
    return R.visual_counts(R.visual_summary(t.detections), _classified(t), _completeness(t))
