"""Event-driven forms of the lifecycle, queue and completeness jobs."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from dossier import vocab
from dossier.functions.timing import duration_seconds
from dossier.operators.completeness import completeness_of, type_counts
from dossier.operators.queueing import DOCUMENT_JOB
from dossier.sources.versioned import VersionedTable

_EVENTS = ("DOCUMENTS_REQUESTED", "DOCUMENTS_RECEIVED")


def stream_waiting_spans(history: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Answered and superseded waiting spans, in time order however the events arrive.

    An event waits in the state of its application until the watermark has passed it, so one
    that is late by less than ``lateness`` still takes its place; older ones are dropped. What
    arrives is put into the buffer frame by frame, and what the watermark has passed leaves it
    when the next events come or, by a timer, without any. The state is the open request and
    the events of the last ``lateness``.
    """

    def advance(
        key: tuple, batches: Iterator[pd.DataFrame], state: Any
    ) -> Iterator[pd.DataFrame]:
        opened, *held = state.get if state.exists else (None, [], [], [])
        buffer = list(zip(*held))
        for events in batches:
            times = events["created_at"].to_numpy("datetime64[us]").astype("int64")
            buffer += zip(times.tolist(), events["id"].tolist(), (events["event_type"] == _EVENTS[0]).tolist())
        buffer.sort()
        passed = state.getCurrentWatermarkMs()
        due = bisect_right(buffer, passed * 1000, key=lambda event: event[0])
        spans = []
        for at, _, requested in buffer[:due]:
            if requested and opened is not None:
                spans.append((key[0], opened, None, True))
            elif not requested and opened is not None:
                spans.append((key[0], opened, at, False))
            opened = at if requested else None
        rest = buffer[due:]
        if opened is None and not rest:
            state.remove()
        else:
            state.update((opened, *([e[i] for e in rest] for i in range(3))))
            if rest:
                state.setTimeoutTimestamp(max(passed + 1, rest[0][0] // 1000))
        yield pd.DataFrame(
            {
                "application_id": pd.Series([r[0] for r in spans], dtype="Int64"),
                "start": pd.Series([r[1] for r in spans], dtype="Int64"),
                "end": pd.Series([r[2] for r in spans], dtype="Int64"),
                "superseded": pd.Series([r[3] for r in spans], dtype="bool"),
            }
        )

    wanted = history.filter(F.col("event_type").isin(*_EVENTS)).select(
        "application_id", "id", "event_type", F.col("created_at").cast("timestamp").alias("created_at")
    )
    spans = (
        wanted.withWatermark("created_at", lateness)
        .groupBy("application_id")
        .applyInPandasWithState(
            advance,
            "application_id long, start long, end long, superseded boolean",
            "opened long, times array<long>, ids array<long>, requested array<boolean>",
            "append",
            "EventTimeTimeout",
        )
    )
    start, end = (F.timestamp_micros(c) for c in ("start", "end"))
    return spans.select(
        "application_id",
        start.alias("span_start"),
        end.alias("span_end"),
        "superseded",
        duration_seconds(start, end).alias("duration_seconds"),
    )


def stream_daily_corrections(feedback: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Corrections per UTC day, given out once the day is past the watermark."""
    return (
        feedback.withColumn("recorded_at", F.col("recorded_at").cast("timestamp"))
        .withWatermark("recorded_at", lateness)
        .groupBy(F.window("recorded_at", "1 day"))
        .agg(F.count(F.lit(1)).alias("corrections"))
        .select(F.to_date("window.start").alias("day"), "corrections")
    )


def stream_queue_backlog(jobs: DataFrame) -> DataFrame:
    """Jobs per status, for update or complete mode; state is one row per status."""
    return jobs.groupBy("status").agg(
        F.count(F.lit(1)).alias("jobs"), F.min("created_at").alias("oldest_created_at")
    )


#: Updates that lie beside the base of the completeness table before they are merged.
_MERGE_EVERY = 16


def stream_completeness(documents: DataFrame, apps: DataFrame, out_path: str) -> DataStreamWriter:
    """Keep a table of the completeness of every application that documents arrive for.

    The counts per application and type are the state of a streaming aggregate, so a batch
    reads its own documents only. The rows of the applications it touched go to the versioned
    table at ``out_path`` as an update under the number of the batch, which makes a replayed
    batch a no-op; every ``_MERGE_EVERY`` updates they are merged into the base.
    """

    def refresh(batch: DataFrame, epoch: int) -> None:
        counts = batch.join(apps.select("application_id"), "application_id")
        fresh = completeness_of(counts)
        table = completeness_table(batch.sparkSession, out_path)
        if table.number < 0:
            table.create(fresh.limit(0), ["application_id"])
        table.upsert(fresh, token=epoch)
        if len(table.state["updates"]) >= _MERGE_EVERY:
            table.compact()

    return type_counts(documents).writeStream.outputMode("update").foreachBatch(refresh)


def completeness_table(spark: SparkSession, path: str) -> VersionedTable:
    """The table that :func:`stream_completeness` keeps, at its newest version."""
    return VersionedTable(spark, path, ["application_id"])


def stream_once_per_document(documents: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Each document at most once within the lateness, ready to be queued."""
    return (
        documents.withColumn("uploaded_at", F.col("uploaded_at").cast("timestamp"))
        .withWatermark("uploaded_at", lateness)
        .dropDuplicatesWithinWatermark(["document_id"])
        .select("document_id", "application_id", "uploaded_at")
    )


#: Groups that applications are dealt over for one call of Python each; a checkpoint keeps it.
_START_BUCKETS = 16384


def stream_start_analysis_once(jobs: DataFrame, apps: DataFrame) -> DataFrame:
    """One row per application, when all its document jobs known by then have ended, one of
    them completed, and the application may be analysed.

    ``jobs``: job_id, application_id, job_type, status and seq, which rises with each state of
    a job. Applications are dealt over ``_START_BUCKETS`` buckets, as a call of Python costs as
    much as hundreds of rows. The state of a bucket holds the last states of the jobs of its
    applications and, of those that have started, nothing but the id.
    """

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        begun, *known = state.get if state.exists else ([], [], [], [], [])
        started = set(begun)
        latest: dict[int, dict] = {}
        for app, job, seq, status in zip(*known):
            latest.setdefault(app, {})[job] = (seq, status)
        ready = set()
        for rows in batches:
            columns = (rows[c].tolist() for c in ("application_id", "job_id", "numbered", "seq", "status", "allowed"))
            for app, job, numbered, seq, status, allowed in zip(*columns):
                if app in started:
                    continue
                jobs = latest.setdefault(app, {})
                job = job if numbered else None  # rows without an id are one job
                if job not in jobs or seq > jobs[job][0]:
                    jobs[job] = (seq, status)
                if allowed:
                    ready.add(app)
        starts = []
        for app in ready:
            now = {status for _, status in latest[app].values()}
            if "COMPLETED" in now and now <= {"COMPLETED", "FAILED"}:
                starts.append(app)
                del latest[app]
        waiting = [(app, job, *held) for app, jobs in latest.items() for job, held in jobs.items()]
        state.update(
            (
                [*begun, *starts],
                [app for app, _, _, _ in waiting],
                [job for _, job, _, _ in waiting],
                [seq for _, _, seq, _ in waiting],
                [status for _, _, _, status in waiting],
            )
        )
        yield pd.DataFrame({"application_id": pd.Series(starts, dtype="int64")})

    can_start = apps.select("application_id", F.col("status").isin("PROCESSING", "SUBMITTED").alias("allowed"))
    wanted = jobs.filter(F.col("job_type") == DOCUMENT_JOB).select("application_id", "job_id", "seq", "status")
    return (
        wanted.join(can_start, "application_id")
        .select(
            "application_id",
            F.coalesce("job_id", F.lit(0)).alias("job_id"),
            F.col("job_id").isNotNull().alias("numbered"),
            "seq",
            "status",
            F.coalesce("allowed", F.lit(False)).alias("allowed"),
            F.pmod(F.xxhash64("application_id"), F.lit(_START_BUCKETS)).alias("bucket"),
        )
        .groupBy("bucket")
        .applyInPandasWithState(
            decide,
            "application_id long",
            "started array<long>, applications array<long>, jobs array<long>, seqs array<long>, statuses array<string>",
            "append",
            "NoTimeout",
        )
    )


def stream_inactive_jobs(
    heartbeats: DataFrame, timeout_seconds: int = vocab.STALE_AFTER_SECONDS
) -> DataFrame:
    """Activity sessions of each job that ended without completion: the job went silent.

    ``heartbeats``: job_id, at, completed (true on the last sign of a finished job).
    """
    gap = f"{timeout_seconds} seconds"
    return (
        heartbeats.withColumn("at", F.col("at").cast("timestamp"))
        .withWatermark("at", gap)
        .groupBy("job_id", F.session_window("at", gap))
        .agg(F.max("at").alias("last_sign_at"), F.bool_or("completed").alias("completed"))
        .filter(~F.col("completed"))
        .select("job_id", "last_sign_at", F.col("session_window.end").alias("stale_at"))
    )
