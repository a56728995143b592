"""Lifecycle queries on applications, events, jobs and reviews."""

from dossier.operators import lifecycle as L
from dossier.plans.catalog import AS_OF, query
from dossier.sources.bindings import history

#: Waiting spans restated with a plain window, shared by several checks below.
_SPANS = """spans AS (
 SELECT application_id, id, created_at AS span_start,
  CASE WHEN nt = 'DOCUMENTS_RECEIVED' THEN nc END AS span_end,
  CASE WHEN nt = 'DOCUMENTS_RECEIVED' THEN greatest(0, datesub('second', created_at, nc)) END AS duration_seconds,
  coalesce(nt, '') <> 'DOCUMENTS_RECEIVED' AS is_open,
  CASE WHEN nt IS NULL THEN 'Still waiting for the applicant to upload documents'
   WHEN nt = 'DOCUMENTS_REQUESTED' THEN 'Request unanswered; superseded by a later request' END AS detail
 FROM (SELECT *, lead(event_type) OVER w AS nt, lead(created_at) OVER w AS nc FROM e_history
  WHERE event_type IN ('DOCUMENTS_REQUESTED', 'DOCUMENTS_RECEIVED')
  WINDOW w AS (PARTITION BY application_id ORDER BY created_at, id)) x
 WHERE event_type = 'DOCUMENTS_REQUESTED')"""

_BREAKDOWN = f"""{_SPANS},
w AS (SELECT application_id, sum(duration_seconds) AS s, bool_or(is_open) AS o FROM spans GROUP BY 1),
p AS (SELECT application_id, sum(CASE WHEN completed_at IS NOT NULL AND coalesce(claimed_at, started_at) IS NOT NULL
   THEN greatest(0, datesub('second', coalesce(claimed_at, started_at), completed_at)) END) AS s,
  arg_min(job_type, job_id) FILTER (WHERE coalesce(claimed_at, started_at) IS NOT NULL AND completed_at IS NULL) AS open_type,
  count(*) FILTER (WHERE coalesce(claimed_at, started_at) IS NOT NULL) AS spans,
  arg_max(completed_at, job_id) FILTER (WHERE job_type = 'APPLICATION_PIPELINE' AND completed_at IS NOT NULL) AS pe
  FROM e_jobs GROUP BY 1),
r AS (SELECT application_id, max(reviewed_at) AS lr FROM e_reviews GROUP BY 1),
h AS (SELECT application_id, count(*) FILTER (WHERE event_type = 'DOCUMENTS_RECEIVED') AS nr,
  count(*) FILTER (WHERE event_type = 'DOCUMENTS_REQUESTED') AS nq,
  max(created_at) FILTER (WHERE event_type = 'OPERATOR_REJECTED') AS rej FROM e_history GROUP BY 1),
b AS (SELECT a.application_id, a.status, coalesce(r.lr, h.rej) AS decided_at,
 CAST(nullif(coalesce(w.s, 0), 0) AS BIGINT) AS waiting_seconds,
 CAST(nullif(coalesce(p.s, 0), 0) AS BIGINT) AS processing_seconds,
 CASE WHEN p.pe IS NOT NULL AND r.lr IS NOT NULL AND a.status <> 'PENDING_REVIEW'
  THEN nullif(greatest(0, datesub('second', p.pe, r.lr)), 0) END AS review_seconds,
 CASE WHEN coalesce(r.lr, h.rej) IS NOT NULL THEN greatest(0, datesub('second', a.submitted_at, coalesce(r.lr, h.rej))) END AS turnaround_seconds,
 CASE WHEN coalesce(r.lr, h.rej) IS NULL THEN greatest(0, datesub('second', a.submitted_at, TIMESTAMP '{AS_OF}')) END AS turnaround_so_far_seconds,
 coalesce(h.nr, 0) AS resubmissions, coalesce(h.nq, 0) AS missing_document_cycles,
 CASE a.status WHEN 'PROCESSING_FAILED' THEN 'Processing Failed' WHEN 'NEEDS_DOCUMENTS' THEN 'Awaiting Documents'
  WHEN 'PROCESSING' THEN 'Processing' WHEN 'PENDING_REVIEW' THEN 'Under Review' WHEN 'SUBMITTED' THEN 'Pending'
  WHEN 'APPROVED' THEN 'Approved' WHEN 'REJECTED' THEN 'Rejected' WHEN 'CORRECTED' THEN 'Corrected' END AS current_state,
 CASE a.status WHEN 'PROCESSING_FAILED' THEN 'Pipeline processing failed'
  WHEN 'NEEDS_DOCUMENTS' THEN CASE WHEN w.o THEN 'Waiting for the applicant to upload documents' ELSE 'Missing required documents' END
  WHEN 'PROCESSING' THEN CASE WHEN p.open_type IS NOT NULL THEN 'Processing: ' || p.open_type || ' • ongoing' ELSE 'Document processing in progress' END
  WHEN 'PENDING_REVIEW' THEN CASE WHEN p.pe IS NOT NULL THEN 'Waiting for reviewer • ongoing'
    WHEN coalesce(p.spans, 0) > 0 THEN 'Pipeline completed • review pending' ELSE 'Awaiting review' END
  WHEN 'SUBMITTED' THEN 'Processing has not started yet' ELSE 'Application decided' END AS current_evidence
 FROM e_applications a LEFT JOIN w USING (application_id) LEFT JOIN p USING (application_id)
 LEFT JOIN r USING (application_id) LEFT JOIN h USING (application_id))"""


@query("waiting_spans", f"WITH {_SPANS} SELECT * FROM spans")
def waiting_spans(t):
    return L.waiting_spans(history(t))


@query(
    "processing_spans",
    """SELECT application_id, job_id, 'Processing: ' || job_type AS label,
 coalesce(claimed_at, started_at) AS span_start, completed_at AS span_end,
 greatest(0, datesub('second', coalesce(claimed_at, started_at), completed_at)) AS duration_seconds,
 completed_at IS NULL AS is_open, nullif(last_error, '') AS detail
FROM (SELECT * FROM e_jobs WHERE coalesce(claimed_at, started_at) IS NOT NULL) j
WHERE completed_at IS NOT NULL
UNION ALL SELECT application_id, job_id, 'Processing: ' || job_type, coalesce(claimed_at, started_at), NULL, NULL,
 true, nullif(last_error, '') FROM e_jobs WHERE coalesce(claimed_at, started_at) IS NOT NULL AND completed_at IS NULL""",
)
def processing_spans(t):
    return L.processing_spans(t.jobs)


@query(
    "review_spans",
    """SELECT a.application_id, p.pe AS span_start,
 CASE WHEN r.application_id IS NOT NULL AND a.status <> 'PENDING_REVIEW' THEN r.reviewed_at END AS span_end,
 CASE WHEN r.application_id IS NOT NULL AND a.status <> 'PENDING_REVIEW' THEN greatest(0, datesub('second', p.pe, r.reviewed_at)) END AS duration_seconds,
 NOT (r.application_id IS NOT NULL AND a.status <> 'PENDING_REVIEW') AS is_open,
 CASE WHEN r.application_id IS NOT NULL AND a.status <> 'PENDING_REVIEW' THEN 'Decision: ' || r.decision ELSE 'Review not yet decided' END AS detail
FROM e_applications a
JOIN (SELECT application_id, completed_at AS pe FROM e_jobs WHERE job_type = 'APPLICATION_PIPELINE' AND completed_at IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY application_id ORDER BY job_id DESC) = 1) p USING (application_id)
LEFT JOIN (SELECT * FROM e_reviews QUALIFY row_number() OVER (PARTITION BY application_id ORDER BY reviewed_at DESC, id DESC) = 1) r USING (application_id)""",
)
def review_spans(t):
    return L.review_spans(t.applications, t.jobs, t.reviews)


@query(
    "decision_times",
    f"""WITH r AS (SELECT application_id, max(reviewed_at) AS m FROM e_reviews GROUP BY 1),
h AS (SELECT application_id, max(created_at) AS m FROM e_history WHERE event_type = 'OPERATOR_REJECTED' GROUP BY 1),
d AS (SELECT a.application_id, a.submitted_at, coalesce(r.m, h.m) AS decided_at FROM e_applications a
 LEFT JOIN r USING (application_id) LEFT JOIN h USING (application_id))
SELECT application_id, decided_at,
 CASE WHEN decided_at IS NOT NULL THEN greatest(0, datesub('second', submitted_at, decided_at)) END AS turnaround_seconds,
 CASE WHEN decided_at IS NULL THEN greatest(0, datesub('second', submitted_at, TIMESTAMP '{AS_OF}')) END AS turnaround_so_far_seconds FROM d""",
)
def decision_times(t):
    return L.decided_at(t.applications, t.reviews, history(t), AS_OF)


@query("performance_breakdown", f"WITH {_BREAKDOWN} SELECT * FROM b")
def performance_breakdown(t):
    return L.performance_breakdown(t.applications, history(t), t.jobs, t.reviews, AS_OF)


@query(
    "performance_overview",
    f"""WITH {_BREAKDOWN} SELECT count(*) AS total_applications,
 count(*) FILTER (WHERE status IN ('APPROVED', 'REJECTED', 'CORRECTED')) AS decided_applications,
 round(avg(waiting_seconds), 1) AS avg_waiting_seconds, round(avg(processing_seconds), 1) AS avg_processing_seconds,
 round(avg(review_seconds), 1) AS avg_review_seconds, round(avg(turnaround_seconds), 1) AS avg_turnaround_seconds,
 CAST(sum(resubmissions) AS BIGINT) AS total_resubmissions,
 CAST(sum(missing_document_cycles) AS BIGINT) AS total_missing_document_cycles FROM b""",
)
def performance_overview(t):
    return L.performance_overview(performance_breakdown(t))


@query(
    "status_counts",
    """SELECT status, count(*) AS applications, (SELECT count(*) FROM e_applications) AS total_applications,
 (SELECT count(*) FROM e_applications WHERE status IN ('APPROVED', 'REJECTED', 'CORRECTED')) AS decided_applications
FROM e_applications GROUP BY status""",
)
def status_counts(t):
    return L.status_counts(t.applications)


@query(
    "missing_cycles",
    """SELECT application_id, count(*) FILTER (WHERE event_type = 'DOCUMENTS_RECEIVED') AS resubmissions,
 count(*) FILTER (WHERE event_type = 'DOCUMENTS_REQUESTED') AS missing_document_cycles FROM e_history GROUP BY 1""",
)
def missing_cycles(t):
    return L.missing_cycles(history(t))


@query(
    "apps_with_children",
    """SELECT a.application_id, a.status,
 (SELECT count(*) FROM e_history h WHERE h.application_id = a.application_id) AS history_rows,
 (SELECT count(*) FROM e_reviews r WHERE r.application_id = a.application_id) AS review_rows,
 (SELECT count(*) FROM e_jobs j WHERE j.application_id = a.application_id) AS job_rows,
 (SELECT max(created_at) FROM e_history h WHERE h.application_id = a.application_id) AS last_history_at,
 (SELECT max(reviewed_at) FROM e_reviews r WHERE r.application_id = a.application_id) AS last_review_at,
 (SELECT max(created_at) FROM e_jobs j WHERE j.application_id = a.application_id) AS last_job_at FROM e_applications a""",
)
def apps_with_children(t):
    return L.apps_with_children(t.applications, history(t), t.reviews, t.jobs)


@query(
    "latest_history",
    """SELECT id, application_id, event_type, actor_name, actor_role, reason, missing_text, created_at FROM e_history
QUALIFY row_number() OVER (PARTITION BY application_id ORDER BY created_at DESC, id DESC) = 1""",
)
def latest_history(t):
    return L.latest_history(t.history)


@query(
    "last_activity",
    """WITH ev AS (SELECT application_id, event_type, created_at AS tm, 3 AS p, id AS k FROM e_history
 UNION ALL SELECT application_id, CASE decision WHEN 'CORRECT' THEN 'REVIEW_CORRECTED' WHEN 'REJECT' THEN 'REVIEW_REJECTED' ELSE 'REVIEW_APPROVED' END, reviewed_at, 2, id FROM e_reviews
 UNION ALL SELECT application_id, 'DOCUMENTS_RECEIVED', uploaded_at, 1, document_id FROM e_documents),
l AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY application_id ORDER BY tm DESC, p DESC, k DESC) = 1)
SELECT a.application_id, a.status, l.event_type AS last_event_type, l.tm AS last_event_at
FROM e_applications a LEFT JOIN l USING (application_id)""",
)
def last_activity(t):
    return L.last_activity(t.applications, history(t), t.reviews, t.entity("documents"))


@query(
    "timeline",
    """SELECT application_id, submitted_at AS happened_at, 0 AS source_no, application_id AS row_id, 'APPLICATION_CREATED' AS kind,
 'Application created' AS label, created_by AS actor_name, NULL AS actor_role, NULL AS detail, NULL AS document_type, NULL AS filename FROM e_applications
UNION ALL SELECT application_id, created_at, 1, id, event_type,
 CASE event_type WHEN 'DOCUMENTS_REQUESTED' THEN 'Missing documents requested from applicant' WHEN 'DOCUMENTS_RECEIVED' THEN 'Documents received'
  WHEN 'OPERATOR_SUBMITTED' THEN 'Application submitted by operator' WHEN 'OPERATOR_REJECTED' THEN 'Application rejected by operator'
  WHEN 'SUBMITTED_FOR_PROCESSING' THEN 'Submitted for processing' ELSE 'Processing failed' END, actor_name, actor_role,
 CASE WHEN event_type = 'DOCUMENTS_REQUESTED' THEN
   CASE WHEN missing_text IS NOT NULL AND coalesce(reason, '') <> '' THEN 'Requested: ' || replace(missing_text, ',', ', ') || ' — ' || reason
    WHEN missing_text IS NOT NULL THEN 'Requested: ' || replace(missing_text, ',', ', ') ELSE nullif(reason, '') END
  ELSE nullif(reason, '') END, NULL, NULL FROM e_history
UNION ALL SELECT application_id, uploaded_at, 2, document_id, 'DOCUMENT_UPLOADED', 'Document uploaded', NULL, NULL, NULL, document_type, original_filename FROM e_documents
UNION ALL SELECT application_id, completed_at, 3, job_id, 'PROCESSING_COMPLETED', CASE status WHEN 'FAILED' THEN 'Processing failed' ELSE 'Processing completed' END,
 NULL, NULL, CASE WHEN status = 'FAILED' THEN last_error END, NULL, NULL FROM e_jobs WHERE job_type = 'APPLICATION_PIPELINE' AND completed_at IS NOT NULL
UNION ALL SELECT application_id, reviewed_at, 4, id, 'REVIEW_DECISION', CASE decision WHEN 'APPROVE' THEN 'Application approved' WHEN 'CORRECT' THEN 'Application corrected' ELSE 'Application rejected by reviewer' END,
 reviewer_name, NULL, coalesce(nullif(comments, ''), rejection_reason), NULL, NULL FROM e_reviews""",
)
def timeline(t):
    return L.timeline(t.applications, history(t), t.entity("documents"), t.jobs, t.reviews)
