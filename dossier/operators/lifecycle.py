"""Lifecycle spans, breakdowns, activity and timelines over append-only events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier import vocab
from dossier.functions.lit import lookup
from dossier.functions.timing import duration_seconds, moment
from dossier.operators.ordered import hour_chunk, latest_per_key, with_next

REQUESTED = "DOCUMENTS_REQUESTED"
RECEIVED = "DOCUMENTS_RECEIVED"
SUPERSEDED = "Request unanswered; superseded by a later request"
STILL_WAITING = "Still waiting for the applicant to upload documents"


def waiting_spans(history: DataFrame) -> DataFrame:
    """One row per document request: answered by the very next event, superseded by a
    later request, or still open. Receipts without an open request are ignored."""
    two = history.filter(F.col("event_type").isin(REQUESTED, RECEIVED)).select(
        "application_id", "id", "event_type", "created_at"
    )
    paired = with_next(
        two,
        ["application_id"],
        ["created_at", "id"],
        hour_chunk("created_at"),
        ["event_type", "created_at"],
    ).filter(F.col("event_type") == REQUESTED)
    answered = F.coalesce(F.col("next_event_type") == RECEIVED, F.lit(False))
    end = F.when(answered, F.col("next_created_at"))
    return paired.select(
        "application_id",
        "id",
        F.col("created_at").alias("span_start"),
        end.alias("span_end"),
        duration_seconds(F.col("created_at"), end).alias("duration_seconds"),
        (~answered).alias("is_open"),
        F.when(F.col("next_event_type") == REQUESTED, F.lit(SUPERSEDED))
        .when(F.col("next_event_type").isNull(), F.lit(STILL_WAITING))
        .alias("detail"),
    )


def processing_spans(jobs: DataFrame) -> DataFrame:
    """One row per job that ever started, from claim (else start) to completion."""
    start = F.coalesce("claimed_at", "started_at")
    return jobs.filter(start.isNotNull()).select(
        "application_id",
        "job_id",
        F.concat(F.lit("Processing: "), "job_type").alias("label"),
        start.alias("span_start"),
        F.col("completed_at").alias("span_end"),
        duration_seconds(start, F.col("completed_at")).alias("duration_seconds"),
        F.col("completed_at").isNull().alias("is_open"),
        F.nullif(F.col("last_error"), F.lit("")).alias("detail"),
    )


def _review_facts(reviews: DataFrame) -> DataFrame:
    newest = F.struct("reviewed_at", "id")
    return reviews.groupBy("application_id").agg(
        F.max("reviewed_at").alias("last_reviewed_at"),
        F.max_by("decision", newest).alias("last_decision"),
    )


def _analysis_end() -> Column:
    done = (F.col("job_type") == "APPLICATION_PIPELINE") & F.col("completed_at").isNotNull()
    return F.max_by(F.when(done, F.col("completed_at")), F.when(done, F.col("job_id")))


def review_spans(apps: DataFrame, jobs: DataFrame, reviews: DataFrame) -> DataFrame:
    """From the last completed analysis job to the newest review; open while undecided."""
    ends = (
        jobs.groupBy("application_id")
        .agg(_analysis_end().alias("span_start"))
        .filter(F.col("span_start").isNotNull())
    )
    joined = (
        apps.select("application_id", "status")
        .join(ends, "application_id")
        .join(_review_facts(reviews), "application_id", "left")
    )
    closed = F.col("last_reviewed_at").isNotNull() & (F.col("status") != "PENDING_REVIEW")
    end = F.when(closed, F.col("last_reviewed_at"))
    return joined.select(
        "application_id",
        "span_start",
        end.alias("span_end"),
        duration_seconds(F.col("span_start"), end).alias("duration_seconds"),
        (~closed).alias("is_open"),
        F.when(closed, F.concat(F.lit("Decision: "), "last_decision"))
        .otherwise("Review not yet decided")
        .alias("detail"),
    )


def decided_at(
    apps: DataFrame, reviews: DataFrame, history: DataFrame, as_of: str
) -> DataFrame:
    """Decision time (review first, else operator rejection) and turnaround."""
    rejected = history.filter(F.col("event_type") == "OPERATOR_REJECTED")
    rejections = rejected.groupBy("application_id").agg(F.max("created_at").alias("rejected_at"))
    decided = F.coalesce("last_reviewed_at", "rejected_at")
    submitted = F.col("submitted_at")
    return (
        apps.select("application_id", "submitted_at")
        .join(_review_facts(reviews), "application_id", "left")
        .join(rejections, "application_id", "left")
        .select(
            "application_id",
            decided.alias("decided_at"),
            duration_seconds(submitted, decided).alias("turnaround_seconds"),
            F.when(decided.isNull(), duration_seconds(submitted, moment(as_of))).alias(
                "turnaround_so_far_seconds"
            ),
        )
    )


def missing_cycles(history: DataFrame) -> DataFrame:
    """Requests (cycles) and receipts (resubmissions) per application."""
    return history.groupBy("application_id").agg(
        F.count_if(F.col("event_type") == RECEIVED).alias("resubmissions"),
        F.count_if(F.col("event_type") == REQUESTED).alias("missing_document_cycles"),
    )


def apps_with_children(
    apps: DataFrame, history: DataFrame, reviews: DataFrame, jobs: DataFrame
) -> DataFrame:
    """Applications with the number and last time of each kind of child row."""
    h = history.groupBy("application_id").agg(
        F.count(F.lit(1)).alias("n_h"), F.max("created_at").alias("last_history_at")
    )
    r = reviews.groupBy("application_id").agg(
        F.count(F.lit(1)).alias("n_r"), F.max("reviewed_at").alias("last_review_at")
    )
    j = jobs.groupBy("application_id").agg(
        F.count(F.lit(1)).alias("n_j"), F.max("created_at").alias("last_job_at")
    )
    joined = apps
    for part in (h, r, j):
        joined = joined.join(part, "application_id", "left")
    return joined.select(
        "application_id",
        "status",
        F.coalesce("n_h", F.lit(0)).alias("history_rows"),
        F.coalesce("n_r", F.lit(0)).alias("review_rows"),
        F.coalesce("n_j", F.lit(0)).alias("job_rows"),
        "last_history_at",
        "last_review_at",
        "last_job_at",
    )


def performance_breakdown(
    apps: DataFrame, history: DataFrame, jobs: DataFrame, reviews: DataFrame, as_of: str
) -> DataFrame:
    """Waiting, processing and review seconds, turnaround and current state per application."""
    waiting = (
        waiting_spans(history)
        .groupBy("application_id")
        .agg(
            F.sum("duration_seconds").alias("w_seconds"),
            F.bool_or("is_open").alias("w_open"),
        )
    )
    start = F.coalesce("claimed_at", "started_at")
    running = start.isNotNull() & F.col("completed_at").isNull()
    per_job = jobs.groupBy("application_id").agg(
        F.sum(duration_seconds(start, F.col("completed_at"))).alias("p_seconds"),
        F.min_by(F.when(running, F.col("job_type")), F.when(running, F.col("job_id"))).alias(
            "open_job_type"
        ),
        F.count_if(start.isNotNull()).alias("p_spans"),
        _analysis_end().alias("analysis_end"),
    )
    events = history.groupBy("application_id").agg(
        F.count_if(F.col("event_type") == RECEIVED).alias("n_received"),
        F.count_if(F.col("event_type") == REQUESTED).alias("n_requested"),
        F.max(F.when(F.col("event_type") == "OPERATOR_REJECTED", F.col("created_at"))).alias(
            "rejected_at"
        ),
    )
    joined = (
        apps.join(waiting, "application_id", "left")
        .join(per_job, "application_id", "left")
        .join(_review_facts(reviews), "application_id", "left")
        .join(events, "application_id", "left")
    )
    status = F.col("status")
    decided = F.coalesce("last_reviewed_at", "rejected_at")
    reviewed = (
        F.col("analysis_end").isNotNull()
        & F.col("last_reviewed_at").isNotNull()
        & (status != "PENDING_REVIEW")
    )
    review_open = F.col("analysis_end").isNotNull() & ~(
        F.col("last_reviewed_at").isNotNull() & (status != "PENDING_REVIEW")
    )
    nothing = F.lit(0).cast("long")
    state = (
        F.when(status == "PROCESSING_FAILED", "Processing Failed")
        .when(status == "NEEDS_DOCUMENTS", "Awaiting Documents")
        .when(status == "PROCESSING", "Processing")
        .when(status == "PENDING_REVIEW", "Under Review")
        .when(status == "SUBMITTED", "Pending")
        .when(status.isin(*vocab.DECIDED_STATUSES), F.initcap(status))
    )
    has_spans = F.coalesce("p_spans", F.lit(0)) > 0
    evidence = (
        F.when(status == "PROCESSING_FAILED", "Pipeline processing failed")
        .when(
            status == "NEEDS_DOCUMENTS",
            F.when(
                F.coalesce("w_open", F.lit(False)), "Waiting for the applicant to upload documents"
            ).otherwise("Missing required documents"),
        )
        .when(
            status == "PROCESSING",
            F.when(
                F.col("open_job_type").isNotNull(),
                F.concat(F.lit("Processing: "), "open_job_type", F.lit(" • ongoing")),
            ).otherwise("Document processing in progress"),
        )
        .when(
            status == "PENDING_REVIEW",
            F.when(review_open, "Waiting for reviewer • ongoing")
            .when(has_spans, "Pipeline completed • review pending")
            .otherwise("Awaiting review"),
        )
        .when(status == "SUBMITTED", "Processing has not started yet")
        .when(status.isin(*vocab.DECIDED_STATUSES), "Application decided")
    )
    return joined.select(
        "application_id",
        "status",
        decided.alias("decided_at"),
        F.nullif(F.coalesce("w_seconds", nothing), nothing).alias("waiting_seconds"),
        F.nullif(F.coalesce("p_seconds", nothing), nothing).alias("processing_seconds"),
        F.nullif(
            F.coalesce(
                F.when(reviewed, duration_seconds(F.col("analysis_end"), F.col("last_reviewed_at"))),
                nothing,
            ),
            nothing,
        ).alias("review_seconds"),
        duration_seconds(F.col("submitted_at"), decided).alias("turnaround_seconds"),
        F.when(decided.isNull(), duration_seconds(F.col("submitted_at"), moment(as_of))).alias(
            "turnaround_so_far_seconds"
        ),
        F.coalesce("n_received", F.lit(0)).alias("resubmissions"),
        F.coalesce("n_requested", F.lit(0)).alias("missing_document_cycles"),
        state.alias("current_state"),
        evidence.alias("current_evidence"),
    )


def status_counts(apps: DataFrame) -> DataFrame:
    """Applications per status, with the table total and the decided total on each row."""
    per = apps.groupBy("status").agg(F.count(F.lit(1)).alias("applications"))
    totals = per.agg(
        F.sum("applications").alias("total_applications"),
        F.coalesce(
            F.sum(F.when(F.col("status").isin(*vocab.DECIDED_STATUSES), F.col("applications"))),
            F.lit(0),
        ).alias("decided_applications"),
    )
    return per.crossJoin(F.broadcast(totals))


def performance_overview(breakdown: DataFrame) -> DataFrame:
    """One row of means (one decimal, nulls left out) and sums over all applications."""

    def mean(name: str) -> Column:
        return F.round(F.avg(name), 1)

    return breakdown.agg(
        F.count(F.lit(1)).alias("total_applications"),
        F.count_if(F.col("status").isin(*vocab.DECIDED_STATUSES)).alias("decided_applications"),
        mean("waiting_seconds").alias("avg_waiting_seconds"),
        mean("processing_seconds").alias("avg_processing_seconds"),
        mean("review_seconds").alias("avg_review_seconds"),
        mean("turnaround_seconds").alias("avg_turnaround_seconds"),
        F.sum("resubmissions").alias("total_resubmissions"),
        F.sum("missing_document_cycles").alias("total_missing_document_cycles"),
    )


def latest_history(history: DataFrame) -> DataFrame:
    """Newest event of each application; later id wins on equal times."""
    return latest_per_key(history, ["application_id"], ["created_at", "id"])


def last_activity(
    apps: DataFrame, history: DataFrame, reviews: DataFrame, documents: DataFrame
) -> DataFrame:
    """Newest of event, review and upload; on equal times event, then review, then upload."""
    sources = (
        history.select(
            "application_id",
            "event_type",
            F.col("created_at").alias("at"),
            F.lit(3).alias("priority"),
            F.col("id").alias("row_id"),
        ),
        reviews.select(
            "application_id",
            lookup(F.col("decision"), vocab.REVIEW_EVENTS, F.lit("REVIEW_APPROVED")).alias(
                "event_type"
            ),
            F.col("reviewed_at").alias("at"),
            F.lit(2).alias("priority"),
            F.col("id").alias("row_id"),
        ),
        documents.select(
            "application_id",
            F.lit(RECEIVED).alias("event_type"),
            F.col("uploaded_at").alias("at"),
            F.lit(1).alias("priority"),
            F.col("document_id").alias("row_id"),
        ),
    )
    events = sources[0].unionByName(sources[1]).unionByName(sources[2])
    newest = events.groupBy("application_id").agg(
        F.max_by("event_type", F.struct("at", "priority", "row_id")).alias("last_event_type"),
        F.max("at").alias("last_event_at"),
    )
    return apps.select("application_id", "status").join(newest, "application_id", "left")


def timeline(
    apps: DataFrame,
    history: DataFrame,
    documents: DataFrame,
    jobs: DataFrame,
    reviews: DataFrame,
) -> DataFrame:
    """All five event sources as one ordered event list per application.

    ``source_no`` and ``row_id`` make the order of events at the same time stable.
    """

    def shaped(df: DataFrame, no: int, **cols: Column) -> DataFrame:
        empty = F.lit(None).cast("string")
        names = ("kind", "label", "actor_name", "actor_role", "detail", "document_type", "filename")
        return df.select(
            "application_id",
            cols["at"].alias("happened_at"),
            F.lit(no).alias("source_no"),
            cols["row_id"].cast("long").alias("row_id"),
            *[cols.get(n, empty).alias(n) for n in names],
        )

    kinds = {k: v[0] for k, v in vocab.HISTORY_KINDS.items()}
    labels = {k: v[1] for k, v in vocab.HISTORY_KINDS.items()}
    reason = F.nullif(F.col("reason"), F.lit(""))
    requested_text = F.when(
        F.size("missing_document_types") > 0,
        F.concat(F.lit("Requested: "), F.array_join("missing_document_types", ", ")),
    )
    request_detail = F.nullif(F.concat_ws(" — ", requested_text, reason), F.lit(""))
    created = shaped(
        apps,
        0,
        at=F.col("submitted_at"),
        row_id=F.col("application_id"),
        kind=F.lit("APPLICATION_CREATED"),
        label=F.lit("Application created"),
        actor_name=F.col("created_by"),
    )
    workflow = shaped(
        history,
        1,
        at=F.col("created_at"),
        row_id=F.col("id"),
        kind=lookup(F.col("event_type"), kinds, F.lit("WORKFLOW")),
        label=lookup(F.col("event_type"), labels, F.lit("Workflow update")),
        actor_name=F.col("actor_name"),
        actor_role=F.col("actor_role"),
        detail=F.when(F.col("event_type") == REQUESTED, request_detail).otherwise(reason),
    )
    uploads = shaped(
        documents,
        2,
        at=F.col("uploaded_at"),
        row_id=F.col("document_id"),
        kind=F.lit("DOCUMENT_UPLOADED"),
        label=F.lit("Document uploaded"),
        document_type=F.col("document_type"),
        filename=F.col("original_filename"),
    )
    failed = F.col("status") == "FAILED"
    finished = shaped(
        jobs.filter(
            (F.col("job_type") == "APPLICATION_PIPELINE") & F.col("completed_at").isNotNull()
        ),
        3,
        at=F.col("completed_at"),
        row_id=F.col("job_id"),
        kind=F.lit("PROCESSING_COMPLETED"),
        label=F.when(failed, "Processing failed").otherwise("Processing completed"),
        detail=F.when(failed, F.col("last_error")),
    )
    decisions = shaped(
        reviews,
        4,
        at=F.col("reviewed_at"),
        row_id=F.col("id"),
        kind=F.lit("REVIEW_DECISION"),
        label=lookup(F.col("decision"), vocab.REVIEW_LABELS, F.lit("Review decision")),
        actor_name=F.col("reviewer_name"),
        detail=F.coalesce(F.nullif(F.col("comments"), F.lit("")), F.col("rejection_reason")),
    )
    events = created
    for part in (workflow, uploads, finished, decisions):
        events = events.unionByName(part)
    return events.orderBy("application_id", "happened_at", "source_no", "row_id")
