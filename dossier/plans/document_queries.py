"""Completeness, copies and queue queries."""

from pyspark.sql import functions as F

from dossier import vocab
from dossier.operators import completeness as C
from dossier.operators import lifecycle as L
from dossier.operators import queueing as Q
from dossier.operators import relational as R
from dossier.plans.catalog import AS_OF, query
from dossier.sources.bindings import _values

_REQUIRED = _values((r,) for r in vocab.REQUIRED_TYPES)
_COMPLETE = f"""req(x) AS (VALUES {_REQUIRED}), opt(x) AS (VALUES ('OTHER_SUPPORTING_DOCUMENT')),
cnt AS (SELECT application_id, document_type, count(*) AS n FROM e_documents GROUP BY 1, 2),
comp AS (SELECT a.application_id,
 coalesce((SELECT list(x ORDER BY x) FROM req WHERE x NOT IN (SELECT document_type FROM cnt WHERE cnt.application_id = a.application_id)), []) AS missing_documents,
 coalesce((SELECT list(document_type ORDER BY document_type) FROM cnt WHERE cnt.application_id = a.application_id AND n > 1 AND (document_type IN (SELECT x FROM req) OR document_type IN (SELECT x FROM opt))), []) AS duplicate_documents,
 coalesce((SELECT list(document_type ORDER BY document_type) FROM cnt WHERE cnt.application_id = a.application_id AND document_type NOT IN (SELECT x FROM req) AND document_type NOT IN (SELECT x FROM opt) AND document_type <> 'BULK_UPLOAD'), []) AS unexpected_documents,
 (SELECT count(*) FROM cnt WHERE cnt.application_id = a.application_id AND document_type IN (SELECT x FROM req)) AS received_required,
 (SELECT count(*) FROM e_documents d WHERE d.application_id = a.application_id AND processing_status = 'UPLOADED') AS uploaded_documents
 FROM e_applications a),
c2 AS (SELECT *, 8 AS required_count, round(100.0 * received_required / 8, 2)::DOUBLE AS completion_percentage,
 CASE WHEN len(unexpected_documents) > 0 THEN 'INVALID_DOCUMENT_SET' WHEN len(duplicate_documents) > 0 THEN 'DUPLICATE_DOCUMENTS'
  WHEN len(missing_documents) > 0 THEN 'INCOMPLETE' ELSE 'COMPLETE' END AS completeness_status FROM comp)"""


@query("completeness", f"WITH {_COMPLETE} SELECT * FROM c2")
def completeness(t):
    return C.completeness(t.applications, t.entity("documents"))


@query(
    "required_vs_received",
    f"""SELECT a.application_id, r.x AS document_type, count(d.document_id) AS copy_count, count(d.document_id) > 0 AS is_present
FROM e_applications a CROSS JOIN (VALUES {_REQUIRED}) AS r(x) LEFT JOIN e_documents d ON d.application_id = a.application_id AND d.document_type = r.x GROUP BY 1, 2""",
)
def required_vs_received(t):
    return C.required_vs_received(t.applications, t.entity("documents"))


_CATS = _values(
    (name, label, copies, kind)
    for name, label, copies, types in vocab.UPLOAD_CATEGORIES
    for kind in types
)


@query(
    "upload_progress",
    f"""WITH cat(category, label, required, kind) AS (VALUES {_CATS}),
p AS (SELECT a.application_id, category, any_value(label) AS label, any_value(required) AS required, count(d.document_id) AS present
 FROM e_applications a CROSS JOIN cat LEFT JOIN e_documents d ON d.application_id = a.application_id AND d.document_type = cat.kind GROUP BY 1, 2)
SELECT application_id, category, label, required, present, CASE WHEN present >= required THEN 'complete' WHEN present > 0 THEN 'incomplete' ELSE 'missing' END AS status,
 CAST(round(least(sum(present) OVER (PARTITION BY application_id), 13) / 13.0 * 100) AS INT) AS percent FROM p""",
)
def upload_progress(t):
    return C.upload_progress(t.applications, t.entity("documents"))


def _stored(t):
    return t.entity("documents").filter("suppkey % 3 = 0").select(
        "*", F.col("linenumber").alias("copy_number")
    )


_NUMBERED = """old AS (SELECT *, linenumber AS copy_number FROM e_documents WHERE suppkey % 3 = 0),
m AS (SELECT application_id, document_type, max(copy_number) AS m FROM old GROUP BY 1, 2),
new AS (SELECT n.document_id, n.application_id, n.document_type, coalesce(m.m, 0) + row_number() OVER
  (PARTITION BY n.application_id, n.document_type ORDER BY n.uploaded_at, n.document_id) AS copy_number
 FROM e_documents n LEFT JOIN m USING (application_id, document_type) WHERE n.suppkey % 3 <> 0)"""


@query("assign_copy_numbers", f"WITH {_NUMBERED} SELECT * FROM new")
def assign_copy_numbers(t):
    incoming = t.entity("documents").filter("suppkey % 3 <> 0")
    return C.assign_copy_numbers(incoming, _stored(t)).select(
        "document_id", "application_id", "document_type", "copy_number"
    )


@query(
    "copy_overflow",
    f"""WITH {_NUMBERED}, every AS (SELECT application_id, document_type, copy_number FROM new UNION ALL SELECT application_id, document_type, copy_number FROM old)
SELECT application_id, document_type, max(copy_number) AS highest_copy, count(*) AS copies,
 CASE WHEN document_type IN ('ONE_LINK_LETTER', 'TRIPARTITE_AGREEMENT') THEN 3 ELSE 1 END AS allowed_copies,
 max(copy_number) > CASE WHEN document_type IN ('ONE_LINK_LETTER', 'TRIPARTITE_AGREEMENT') THEN 3 ELSE 1 END AS over_limit FROM every GROUP BY 1, 2""",
)
def copy_overflow(t):
    cols = ["application_id", "document_type", "copy_number"]
    return C.copy_overflow(assign_copy_numbers(t).select(cols).unionByName(_stored(t).select(cols)))


_PROGRESS = """p AS (SELECT application_id, count(*) AS total_documents, count(*) FILTER (WHERE status IN ('QUEUED', 'RETRY_WAITING')) AS queued,
 count(*) FILTER (WHERE status = 'PROCESSING') AS processing, count(*) FILTER (WHERE status = 'COMPLETED') AS completed,
 count(*) FILTER (WHERE status = 'FAILED') AS failed,
 round(100.0 * count(*) FILTER (WHERE status = 'COMPLETED') / count(*), 1)::DOUBLE AS progress_percentage
 FROM e_doc_jobs WHERE job_type = 'DOCUMENT_OCR' GROUP BY 1)"""


@query("queue_progress", f"WITH {_PROGRESS} SELECT * FROM p")
def queue_progress(t):
    return Q.queue_progress(t.doc_jobs)


@query(
    "processing_totals",
    f"""WITH {_PROGRESS} SELECT sum(total_documents)::BIGINT AS total_documents, sum(completed)::BIGINT AS completed, sum(failed)::BIGINT AS failed,
 sum(queued + processing)::BIGINT AS in_flight, count(*) FILTER (WHERE processing > 0) AS busy_applications,
 greatest(sum(total_documents) - sum(completed), 0)::BIGINT AS remaining FROM p""",
)
def processing_totals(t):
    return Q.processing_totals(Q.queue_progress(t.doc_jobs))


@query(
    "queue_stats",
    f"""SELECT count(*) FILTER (WHERE status = 'QUEUED') AS total_queued, count(*) FILTER (WHERE status = 'PROCESSING') AS total_processing,
 count(*) FILTER (WHERE status = 'FAILED') AS total_failed,
 epoch_us(TIMESTAMP '{AS_OF}') / 1000000.0 - epoch_us(min(created_at) FILTER (WHERE status = 'QUEUED')) / 1000000.0 AS oldest_queued_age_seconds FROM e_jobs""",
)
def queue_stats(t):
    return Q.queue_stats(t.jobs, AS_OF)


@query(
    "ready_for_analysis",
    """WITH j AS (SELECT application_id, bool_and(status IN ('COMPLETED', 'FAILED')) AS e, bool_or(status = 'COMPLETED') AS c FROM e_doc_jobs WHERE job_type = 'DOCUMENT_OCR' GROUP BY 1),
o AS (SELECT application_id, a.status, CASE WHEN NOT e THEN 'WAIT' WHEN a.status NOT IN ('PROCESSING', 'SUBMITTED') THEN 'DEFER' WHEN NOT c THEN 'FAIL' ELSE 'START' END AS outcome
 FROM e_applications a JOIN j USING (application_id))
SELECT *, CASE WHEN outcome = 'FAIL' AND status = 'PROCESSING' THEN 'PROCESSING_FAILED' ELSE status END AS new_status FROM o""",
)
def ready_for_analysis(t):
    return Q.ready_for_analysis(t.doc_jobs, t.applications)


_MID = "2024-01-20 12:00:00"


@query(
    "claim_order",
    f"""SELECT job_id, application_id, status, created_at, retry_at,
 row_number() OVER (ORDER BY CASE status WHEN 'RETRY_WAITING' THEN 0 ELSE 1 END, created_at, job_id) AS claim_position
FROM e_jobs WHERE status = 'QUEUED' OR (status = 'RETRY_WAITING' AND (retry_at IS NULL OR retry_at <= TIMESTAMP '{_MID}'))""",
)
def claim_order(t):
    return Q.claim_order(t.jobs, _MID)


@query(
    "retry_schedule",
    f"""SELECT job_id, attempts + 1 AS attempts, CASE WHEN attempts + 1 >= max_attempts THEN 'FAILED' ELSE 'RETRY_WAITING' END AS status,
 CASE WHEN attempts + 1 < max_attempts THEN TIMESTAMP '{AS_OF}' + to_seconds(CAST(30 * 2 ** attempts AS BIGINT)) END AS retry_at,
 CASE WHEN attempts + 1 >= max_attempts THEN TIMESTAMP '{AS_OF}' END AS completed_at FROM e_jobs WHERE status = 'PROCESSING'""",
)
def retry_schedule(t):
    return Q.retry_schedule(t.jobs, AS_OF)


@query(
    "stale_jobs",
    f"""SELECT job_id, application_id, CASE WHEN attempts >= max_attempts THEN 'FAILED' ELSE 'QUEUED' END AS status,
 'Recovered stale PROCESSING job (worker crash)' AS last_error, CASE WHEN attempts >= max_attempts THEN TIMESTAMP '{_MID}' END AS completed_at
FROM e_jobs WHERE status = 'PROCESSING' AND started_at IS NOT NULL AND started_at < TIMESTAMP '{_MID}' - INTERVAL 900 SECOND""",
)
def stale_jobs(t):
    return Q.stale_jobs(t.jobs, _MID)


@query(
    "operator_queue",
    f"""WITH {_COMPLETE}, h AS (SELECT application_id, event_type FROM e_history QUALIFY row_number() OVER (PARTITION BY application_id ORDER BY created_at DESC, id DESC) = 1),
q AS (SELECT a.application_id, a.name, a.status, a.updated_at, a.created_by, c2.missing_documents, c2.received_required AS received_document_count,
 c2.required_count AS required_document_count, h.event_type AS last_event_type,
 a.status IN ('NEEDS_DOCUMENTS', 'PROCESSING_FAILED') OR len(c2.missing_documents) > 0 AS needs_attention,
 CASE a.status WHEN 'SUBMITTED' THEN 0 WHEN 'NEEDS_DOCUMENTS' THEN 0 WHEN 'PROCESSING_FAILED' THEN 0 WHEN 'PENDING_REVIEW' THEN 1 WHEN 'PROCESSING' THEN 2
  WHEN 'APPROVED' THEN 3 WHEN 'CORRECTED' THEN 3 WHEN 'REJECTED' THEN 4 ELSE 5 END AS queue_rank
 FROM e_applications a LEFT JOIN c2 USING (application_id) LEFT JOIN h USING (application_id))
SELECT *, row_number() OVER (ORDER BY queue_rank, NOT needs_attention, updated_at, application_id) AS queue_position FROM q""",
)
def operator_queue(t):
    done = C.completeness(t.applications, t.entity("documents"))
    return Q.operator_queue(t.applications, done, L.latest_history(t.history))


@query(
    "operator_action_verdicts",
    f"""WITH {_COMPLETE}, act AS (SELECT o_orderkey AS action_id, CASE WHEN o_orderkey % 40 = 0 THEN -1 ELSE o_orderkey END AS application_id,
 CASE o_custkey % 3 WHEN 0 THEN 'REQUEST' WHEN 1 THEN 'REJECT' ELSE 'SUBMIT' END AS action,
 CASE o_custkey % 5 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE 'reason' END AS reason, o_custkey % 4 AS n_types FROM orders),
v AS (SELECT act.*, a.status, CASE WHEN action = 'REJECT' AND trim(coalesce(reason, '')) = '' THEN 'MISSING_REASON' WHEN a.status IS NULL THEN 'APPLICATION_NOT_FOUND'
  WHEN action = 'REQUEST' AND n_types = 0 THEN 'APPLICATION_COMPLETE'
  WHEN action IN ('REQUEST', 'SUBMIT') AND a.status NOT IN ('SUBMITTED', 'NEEDS_DOCUMENTS') THEN 'INVALID_TRANSITION'
  WHEN action = 'REJECT' AND a.status NOT IN ('SUBMITTED', 'NEEDS_DOCUMENTS', 'PROCESSING_FAILED') THEN 'INVALID_TRANSITION'
  WHEN action = 'SUBMIT' AND c2.completeness_status <> 'COMPLETE' AND a.application_id % 16 <> 4 THEN 'INCOMPLETE_APPLICATION' END AS error, c2.uploaded_documents
 FROM act LEFT JOIN e_applications a USING (application_id) LEFT JOIN c2 USING (application_id))
SELECT action_id, application_id, action, error IS NULL AS accepted, error,
 CASE WHEN error IS NOT NULL THEN status WHEN action = 'REQUEST' THEN 'NEEDS_DOCUMENTS' WHEN action = 'REJECT' THEN 'REJECTED'
  WHEN uploaded_documents > 0 OR status = 'NEEDS_DOCUMENTS' THEN 'PROCESSING' ELSE status END AS new_status,
 CASE WHEN error IS NULL THEN CASE action WHEN 'REQUEST' THEN 'DOCUMENTS_REQUESTED' WHEN 'REJECT' THEN 'OPERATOR_REJECTED' ELSE 'SUBMITTED_FOR_PROCESSING' END END AS event_type FROM v""",
)
def operator_action_verdicts(t):
    done = C.completeness(t.applications, t.entity("documents")).withColumn(
        # Few random packs are complete; some are taken as complete to reach that branch.
        "completeness_status",
        F.when(F.col("application_id") % 16 == 4, "COMPLETE").otherwise(F.col("completeness_status")),
    )
    actions = t.source("orders").selectExpr(
        "o_orderkey AS action_id",
        "CASE WHEN o_orderkey % 40 = 0 THEN -1 ELSE o_orderkey END AS application_id",
        "CASE o_custkey % 3 WHEN 0 THEN 'REQUEST' WHEN 1 THEN 'REJECT' ELSE 'SUBMIT' END AS action",
        "CASE o_custkey % 5 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE 'reason' END AS reason",
        "array_repeat('CNIC_FRONT', cast(o_custkey % 4 AS int)) AS missing_types",
    )
    return R.operator_action_verdicts(actions, t.applications, done)
