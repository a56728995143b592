"""Streams replayed over the given tables: the table is written in steps of consecutive
times, read as a stream step by step, and the result compared with its batch form."""


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.plans.catalog import query
from dossier.plans.lifecycle_queries import _SPANS
from dossier.session import new_path
from dossier.sources.bindings import Tables
from dossier.streaming import streams as ST

_PARTS = 4


def _replay(t: Tables, rows: DataFrame, ts: str, name: str):
    """``rows`` as a stream of :data:`_PARTS` consecutive steps, each of one file per core."""
    root = f"{new_path(t.spark)}-replay-{name}"
    files = t.spark.sparkContext.defaultParallelism
    source, sink = f"{root}/in", f"{root}/out"
    bounds = rows.selectExpr(
        f"percentile_approx({ts}, array({', '.join(str(i / _PARTS) for i in range(1, _PARTS))})) AS b"
    ).first()[0]
    step = F.lit(0)
    for b in bounds:
        step = step + F.when(F.col(ts) > F.lit(b), 1).otherwise(0)
    parted = rows.withColumn("_step", step)
    for i in range(_PARTS):
        step_rows = parted.filter(F.col("_step") == i).drop("_step").repartition(files)
        step_rows.write.mode("append").parquet(source)
    stream = (
        t.spark.readStream.schema(rows.schema)
        .option("maxFilesPerTrigger", str(files))
        .parquet(source)
    )
    return stream, sink, root


def _run(stream: DataFrame, sink: str, root: str) -> DataFrame:
    job = (
        stream.writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    job.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(sink)


@query(
    "stream_waiting_spans",
    f"""WITH {_SPANS} SELECT application_id, span_start, span_end, detail IS NOT NULL AS superseded, duration_seconds FROM spans
WHERE detail IS NULL OR detail LIKE 'Request unanswered%'""",
)
def stream_waiting_spans(t):
    """Events arrive shuffled by up to 50 minutes, which the lateness of an hour allows."""
    late = F.make_dt_interval(F.lit(0), F.lit(0), F.pmod(F.xxhash64("id"), F.lit(50)).cast("int"))
    rows = t.history.select("application_id", "id", "event_type", "created_at", (F.col("created_at") + late).alias("seen_at"))
    # An event far ahead moves the watermark past all others, so that none is held back.
    ahead = rows.agg(F.max("created_at").alias("last")).select(
        F.lit(-1).cast("long").alias("application_id"),
        F.lit(-1).cast("long").alias("id"),
        F.lit("DOCUMENTS_RECEIVED").alias("event_type"),
        *[F.expr("last + INTERVAL '30' DAY").alias(c) for c in ("created_at", "seen_at")],
    )
    stream, sink, root = _replay(t, rows.unionByName(ahead), "seen_at", "spans")
    done = _run(ST.stream_waiting_spans(stream), sink, root)
    return done.withColumn("span_start", F.col("span_start").cast("timestamp_ntz")).withColumn(
        "span_end", F.col("span_end").cast("timestamp_ntz")
    )


@query(
    "stream_daily_corrections",
    """SELECT CAST(recorded_at AS DATE) AS day, count(*) AS corrections FROM e_feedback
WHERE CAST(recorded_at AS DATE) + 1 <= (SELECT max(recorded_at) FROM e_feedback) - INTERVAL 1 DAY GROUP BY 1""",
)
def stream_daily_corrections(t):
    stream, sink, root = _replay(t, t.feedback.select("id", "recorded_at"), "recorded_at", "daily")
    return _run(ST.stream_daily_corrections(stream), sink, root)


@query(
    "stream_queue_backlog",
    "SELECT status, count(*) AS jobs, min(created_at) AS oldest_created_at FROM e_jobs GROUP BY 1",
)
def stream_queue_backlog(t):
    rows = t.jobs.select("job_id", "status", "created_at")
    stream, _, root = _replay(t, rows, "created_at", "backlog")
    name = "dossier_backlog"
    job = (
        ST.stream_queue_backlog(stream)
        .writeStream.format("memory")
        .queryName(name)
        .outputMode("complete")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    job.awaitTermination()
    return t.spark.table(name)


@query(
    "stream_completeness",
    """SELECT application_id, count(DISTINCT document_type) FILTER (WHERE document_type NOT IN ('OTHER_SUPPORTING_DOCUMENT', 'SCHEDULE_OF_CHARGES', 'BULK_UPLOAD')) AS received_required,
 CAST(count(*) FILTER (WHERE processing_status = 'UPLOADED') AS BIGINT) AS uploaded_documents FROM e_documents GROUP BY 1""",
)
def stream_completeness(t):
    rows = t.entity("documents").select(
        "document_id", "application_id", "document_type", "processing_status", "uploaded_at"
    )
    stream, sink, root = _replay(t, rows, "uploaded_at", "complete")
    writer = ST.stream_completeness(stream, t.applications, sink)
    job = writer.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    job.awaitTermination()
    newest = ST.completeness_table(t.spark, sink).read()
    return newest.select("application_id", "received_required", "uploaded_documents")


@query(
    "stream_start_analysis_once",
    """SELECT application_id FROM e_applications a JOIN (SELECT application_id, bool_and(status IN ('COMPLETED', 'FAILED')) AS ended, bool_or(status = 'COMPLETED') AS done
 FROM e_doc_jobs WHERE job_type = 'DOCUMENT_OCR' GROUP BY 1) j USING (application_id) WHERE ended AND done AND a.status IN ('PROCESSING', 'SUBMITTED')""",
)
def stream_start_analysis_once(t):
    """Every job is queued at first; then its last state arrives, for some jobs twice."""
    jobs = t.doc_jobs.select("job_id", "application_id", "job_type", "status", "created_at")
    queued = jobs.withColumn("status", F.lit("QUEUED")).withColumn("seq", F.lit(0).cast("long"))
    queued = queued.withColumn("created_at", F.lit("1900-01-01").cast("timestamp_ntz"))
    ended = jobs.withColumn("seq", F.lit(1).cast("long"))
    again = ended.filter("job_id % 3 = 0").withColumn("created_at", F.expr("created_at + INTERVAL '40' DAY"))
    rows = queued.unionByName(ended).unionByName(again)
    stream, sink, root = _replay(t, rows, "created_at", "start")
    return _run(ST.stream_start_analysis_once(stream, t.applications), sink, root)


@query("stream_once_per_document", "SELECT document_id, application_id, uploaded_at FROM e_documents")
def stream_once_per_document(t):
    rows = t.entity("documents").select("document_id", "application_id", "uploaded_at")
    twice = rows.unionByName(rows.filter("document_id % 5 = 0"))
    stream, sink, root = _replay(t, twice, "uploaded_at", "once")
    done = _run(ST.stream_once_per_document(stream), sink, root)
    return done.withColumn("uploaded_at", F.col("uploaded_at").cast("timestamp_ntz"))


@query(
    "stream_inactive_jobs",
    """WITH h AS (SELECT user_id AS job_id, ts, event_type = 'purchase' AS done, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(cut) OVER (PARTITION BY job_id ORDER BY ts) AS k FROM h), g AS (SELECT job_id, k, max(ts) AS last_sign_at, bool_or(done) AS done FROM s GROUP BY 1, 2)
SELECT job_id, last_sign_at, last_sign_at + INTERVAL 12 HOUR AS stale_at FROM g WHERE NOT done AND last_sign_at + INTERVAL 12 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 12 HOUR""",
)
def stream_inactive_jobs(t):
    rows = t.source("events").selectExpr(
        "user_id AS job_id", "ts AS at", "event_type = 'purchase' AS completed"
    )
    stream, sink, root = _replay(t, rows, "at", "inactive")
    done = _run(ST.stream_inactive_jobs(stream, 12 * 3600), sink, root)
    return done.select(
        "job_id",
        F.col("last_sign_at").cast("timestamp_ntz").alias("last_sign_at"),
        F.col("stale_at").cast("timestamp_ntz").alias("stale_at"),
    )
