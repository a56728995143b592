"""Queue state: progress, backlog, readiness, claim order, retries and stale jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier import vocab
from dossier.functions.lit import lookup
from dossier.functions.timing import moment
from dossier.operators.ordered import evenly_numbered

DOCUMENT_JOB = "DOCUMENT_OCR"


def queue_progress(jobs: DataFrame) -> DataFrame:
    """Document jobs per application by reader-facing state, with percentage done."""
    status = F.col("status")
    counts = (
        jobs.filter(F.col("job_type") == DOCUMENT_JOB)
        .groupBy("application_id")
        .agg(
            F.count(F.lit(1)).alias("total_documents"),
            F.count_if(status.isin("QUEUED", "RETRY_WAITING")).alias("queued"),
            F.count_if(status == "PROCESSING").alias("processing"),
            F.count_if(status == "COMPLETED").alias("completed"),
            F.count_if(status == "FAILED").alias("failed"),
        )
    )
    share = F.col("completed") / F.col("total_documents") * 100
    return counts.withColumn(
        "progress_percentage",
        F.when(F.col("total_documents") > 0, F.round(share, 1)).otherwise(0.0),
    )


def processing_totals(progress: DataFrame) -> DataFrame:
    """One row of totals over every application's progress."""
    sums = progress.agg(
        F.sum("total_documents").alias("total_documents"),
        F.sum("completed").alias("completed"),
        F.sum("failed").alias("failed"),
        F.sum(F.col("queued") + F.col("processing")).alias("in_flight"),
        F.count_if(F.col("processing") > 0).alias("busy_applications"),
    )
    return sums.withColumn(
        "remaining", F.greatest(F.col("total_documents") - F.col("completed"), F.lit(0))
    )


def queue_stats(jobs: DataFrame, as_of: str) -> DataFrame:
    """Backlog of all jobs and age in seconds of the oldest queued one."""
    status = F.col("status")
    oldest = F.min(F.when(status == "QUEUED", F.col("created_at")))
    return jobs.agg(
        F.count_if(status == "QUEUED").alias("total_queued"),
        F.count_if(status == "PROCESSING").alias("total_processing"),
        F.count_if(status == "FAILED").alias("total_failed"),
        (F.timestamp_diff("MICROSECOND", oldest, moment(as_of)) / 1000000).alias(
            "oldest_queued_age_seconds"
        ),
    )


def ready_for_analysis(jobs: DataFrame, apps: DataFrame) -> DataFrame:
    """What the finished document jobs of each application allow.

    START when every document job ended and one succeeded, FAIL when none did, WAIT
    while jobs run, DEFER when the application is in another status.
    """
    status = F.col("status")
    per_app = (
        jobs.filter(F.col("job_type") == DOCUMENT_JOB)
        .groupBy("application_id")
        .agg(
            F.bool_and(status.isin("COMPLETED", "FAILED")).alias("all_ended"),
            F.bool_or(status == "COMPLETED").alias("any_completed"),
        )
    )
    outcome = (
        F.when(~F.col("all_ended"), "WAIT")
        .when(~status.isin("PROCESSING", "SUBMITTED"), "DEFER")
        .when(~F.col("any_completed"), "FAIL")
        .otherwise("START")
    )
    return (
        apps.select("application_id", "status")
        .join(per_app, "application_id")
        .select(
            "application_id",
            "status",
            outcome.alias("outcome"),
            F.when((outcome == "FAIL") & (status == "PROCESSING"), "PROCESSING_FAILED")
            .otherwise(status)
            .alias("new_status"),
        )
    )


def claim_order(jobs: DataFrame, as_of: str) -> DataFrame:
    """Position of every job that may be claimed now: due retries, then oldest first."""
    due = F.col("retry_at").isNull() | (F.col("retry_at") <= moment(as_of))
    waiting = F.col("status") == "RETRY_WAITING"
    open_jobs = jobs.filter((F.col("status") == "QUEUED") | (waiting & due)).select(
        "job_id", "application_id", "status", "created_at", "retry_at"
    )
    rank = F.when(waiting, 0).otherwise(1)
    order = [rank, F.col("created_at"), F.col("job_id")]
    return evenly_numbered(open_jobs, [], order, "claim_position")


def retry_schedule(
    jobs: DataFrame, as_of: str, backoff_seconds: int = vocab.RETRY_BACKOFF_SECONDS
) -> DataFrame:
    """State after one more failed attempt of each running job."""
    attempts = F.col("attempts") + 1
    spent = attempts >= F.col("max_attempts")
    now = moment(as_of)
    delay = F.lit(backoff_seconds) * F.pow(F.lit(2), F.col("attempts"))
    return jobs.filter(F.col("status") == "PROCESSING").select(
        "job_id",
        attempts.alias("attempts"),
        F.when(spent, "FAILED").otherwise("RETRY_WAITING").alias("status"),
        F.when(~spent, F.timestamp_add("SECOND", delay.cast("int"), now)).alias("retry_at"),
        F.when(spent, now).alias("completed_at"),
    )


def stale_jobs(
    jobs: DataFrame, as_of: str, timeout_seconds: int = vocab.STALE_AFTER_SECONDS
) -> DataFrame:
    """Running jobs whose last sign of life is too old, and what becomes of them."""
    limit = F.timestamp_add("SECOND", F.lit(-timeout_seconds), moment(as_of))
    spent = F.col("attempts") >= F.col("max_attempts")
    return jobs.filter((F.col("status") == "PROCESSING") & (F.col("started_at") < limit)).select(
        "job_id",
        "application_id",
        F.when(spent, "FAILED").otherwise("QUEUED").alias("status"),
        F.lit("Recovered stale PROCESSING job (worker crash)").alias("last_error"),
        F.when(spent, moment(as_of)).alias("completed_at"),
    )


def operator_queue(apps: DataFrame, completeness: DataFrame, latest: DataFrame) -> DataFrame:
    """Work list: status rank, attention first, then longest untouched first."""
    joined = (
        apps.select("application_id", "name", "status", "updated_at", "created_by")
        .join(
            completeness.select(
                "application_id",
                "missing_documents",
                F.col("received_required").alias("received_document_count"),
                F.col("required_count").alias("required_document_count"),
            ),
            "application_id",
            "left",
        )
        .join(
            latest.select("application_id", F.col("event_type").alias("last_event_type")),
            "application_id",
            "left",
        )
    )
    attention = F.col("status").isin("NEEDS_DOCUMENTS", "PROCESSING_FAILED") | (
        F.coalesce(F.size("missing_documents"), F.lit(0)) > 0
    )
    ranked = joined.withColumn("needs_attention", attention).withColumn(
        "queue_rank",
        lookup(F.col("status"), vocab.QUEUE_RANK, F.lit(vocab.QUEUE_RANK_OTHER)),
    )
    calm = F.when(F.col("needs_attention"), 0).otherwise(1)
    order = [F.col("queue_rank"), calm, F.col("updated_at"), F.col("application_id")]
    return evenly_numbered(ranked, [], order, "queue_position")
