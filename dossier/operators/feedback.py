"""Correction statistics and the curated correction dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier import vocab
from dossier.functions.lit import blank
from dossier.operators.ordered import latest_per_key
from dossier.operators.relational import with_document_type

DUPLICATE_KEY = (
    "application_id",
    "document_id",
    "field_name",
    "ocr_value",
    "human_value",
    "recorded_at",
)


def labelled(col: Column) -> Column:
    """Text with UNKNOWN for null or empty."""
    return F.coalesce(F.nullif(col, F.lit("")), F.lit(vocab.UNKNOWN))


def iso_utc(ts: Column) -> Column:
    """ISO text with a UTC offset; fractional seconds only when there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(
        whole,
        F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)),
        F.lit("+00:00"),
    )


def feedback_totals(feedback: DataFrame) -> DataFrame:
    changed = F.coalesce("human_value", F.lit("")) != F.coalesce("ocr_value", F.lit(""))
    return feedback.agg(
        F.count(F.lit(1)).alias("total_entries"),
        F.count_if(changed).alias("total_corrected_fields"),
        F.avg("confidence_score").alias("average_confidence"),
    )


def top_corrected_fields(feedback: DataFrame, n: int = vocab.TOP_FIELDS) -> DataFrame:
    return (
        feedback.groupBy("field_name")
        .agg(F.count(F.lit(1)).alias("corrections"))
        .orderBy(F.desc("corrections"), F.asc("field_name"))
        .limit(n)
    )


def corrections_by(feedback: DataFrame, dimension: str) -> DataFrame:
    """Entries per reviewer, decision or document type (join the type in first)."""
    return feedback.groupBy(labelled(F.col(dimension)).alias("label")).agg(
        F.count(F.lit(1)).alias("corrections")
    )


def daily_corrections(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy(F.to_date("recorded_at").alias("day")).agg(
        F.count(F.lit(1)).alias("corrections")
    )


def dedupe_feedback(feedback: DataFrame) -> DataFrame:
    """Lowest id of each group of equal entries; nulls in the key count as equal."""
    return latest_per_key(feedback, DUPLICATE_KEY, ["id"], first=True)


def exclusion_reason() -> Column:
    """First quality rule an entry breaks, null when it may be used."""
    score = F.col("confidence_score")
    return (
        F.when(F.col("application_id").isNull(), "missing_application_id")
        .when(blank(F.col("field_name")), "missing_field_name")
        .when(blank(F.col("ocr_value")), "missing_original_ocr_value")
        .when(blank(F.col("human_value")), "missing_human_corrected_value")
        .when(~F.coalesce(score.between(0.0, 1.0), F.lit(False)), "invalid_confidence_score")
        .when(
            F.col("decision").isNotNull() & ~F.col("decision").isin(*vocab.KNOWN_DECISIONS),
            "invalid_decision",
        )
    )


def curate(feedback: DataFrame, documents: DataFrame) -> DataFrame:
    """Usable correction records. Duplicates go before validity is judged, so a bad first
    copy hides a good second one."""
    usable = dedupe_feedback(feedback).filter(exclusion_reason().isNull())
    return with_document_type(usable, documents).select(
        "id",
        "application_id",
        "document_type",
        "field_name",
        F.col("ocr_value").alias("original_ocr_value"),
        "normalized_value",
        F.col("human_value").alias("human_corrected_value"),
        "confidence_score",
        "confidence_source",
        "correction_reason",
        "decision",
        "origin",
        iso_utc(F.col("recorded_at")).alias("recorded_at"),
        labelled(F.col("reviewer")).alias("reviewer"),
    )


def exclusions(feedback: DataFrame) -> DataFrame:
    """Entries left out per reason, with duplicates as a reason of their own."""
    kept = feedback.groupBy(*DUPLICATE_KEY).agg(
        F.count(F.lit(1)).alias("_copies"),
        F.min_by(F.struct("confidence_score", "decision"), F.col("id")).alias("_first"),
    )
    judged = kept.select(*DUPLICATE_KEY, "_copies", "_first.*").select(
        F.explode(
            F.array(
                F.struct(exclusion_reason().alias("reason"), F.lit(1).cast("long").alias("n")),
                F.struct(F.lit("duplicate").alias("reason"), (F.col("_copies") - 1).alias("n")),
            )
        ).alias("x")
    )
    return (
        judged.filter(F.col("x.reason").isNotNull() & (F.col("x.n") > 0))
        .groupBy(F.col("x.reason").alias("reason"))
        .agg(F.sum("x.n").alias("entries"))
    )


def confidence_bucket(score: Column) -> Column:
    bucket = None
    for label, upper in vocab.CONFIDENCE_BUCKETS:
        arm = score < upper
        bucket = F.when(arm, label) if bucket is None else bucket.when(arm, label)
    return bucket.otherwise(vocab.CONFIDENCE_BUCKETS[-1][0])


def learning_statistics(curated: DataFrame) -> DataFrame:
    """Record counts per (dimension, label) over five dimensions, in one aggregation."""
    cells = [
        ("document_type", F.col("document_type")),
        ("field_name", F.col("field_name")),
        ("decision", labelled(F.col("decision"))),
        ("reviewer", F.col("reviewer")),
        ("confidence", confidence_bucket(F.col("confidence_score"))),
    ]
    pairs = [F.struct(F.lit(d).alias("dimension"), c.alias("label")) for d, c in cells]
    return (
        curated.select(F.explode(F.array(*pairs)).alias("c"), "confidence_score")
        .groupBy("c.dimension", "c.label")
        .agg(
            F.count(F.lit(1)).alias("records"),
            F.avg("confidence_score").alias("average_confidence"),
        )
    )


def dataset_completeness(curated: DataFrame) -> DataFrame:
    """Share (four decimals) of records that carry each optional field."""

    def present(name: str) -> Column:
        col = F.col(name)
        if name in ("document_type", "reviewer"):
            return col != vocab.UNKNOWN
        return col.isNotNull() & (col != "")

    shares = curated.agg(
        *[
            F.coalesce(
                F.round(F.avg(F.coalesce(present(n), F.lit(False)).cast("int")), 4), F.lit(0.0)
            ).alias(n)
            for n in vocab.COMPLETENESS_FIELDS
        ]
    )
    return shares.unpivot([], list(vocab.COMPLETENESS_FIELDS), "field", "share")


def record_hash() -> Column:
    """Content hash of one learning record; null and empty text differ."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in vocab.LEARNING_COLUMNS]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def learning_version(curated: DataFrame) -> DataFrame:
    """Record count, content hash and version id of the dataset.

    Row hashes are added up piecewise, so the dataset hash is the same for any row
    order or partitioning and no row leaves its executor.
    """
    hashed = curated.select(record_hash().alias("h"))
    pieces = [
        F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).alias(f"s{i}")
        for i in range(4)
    ]
    sums = hashed.agg(F.count(F.lit(1)).alias("record_count"), *pieces)
    text = F.concat_ws(
        ":",
        F.col("record_count").cast("string"),
        *[F.coalesce(F.col(f"s{i}").cast("string"), F.lit("0")) for i in range(4)],
    )
    return sums.select("record_count", F.sha2(text, 256).alias("dataset_hash")).select(
        "record_count",
        "dataset_hash",
        F.concat(
            F.lit(f"cl-{vocab.LEARNING_VERSION}-"), F.substring("dataset_hash", 1, 12)
        ).alias("dataset_version"),
    )


def feedback_export_rows(feedback: DataFrame) -> DataFrame:
    """The fifteen export columns in their fixed order."""
    renamed = feedback.select(
        "*",
        F.col("ocr_value").alias("original_ocr_value"),
        F.col("human_value").alias("human_corrected_value"),
    ).withColumn("recorded_at", iso_utc(F.col("recorded_at")))
    return renamed.select(*vocab.FEEDBACK_COLUMNS)


def learning_export_rows(curated: DataFrame) -> DataFrame:
    """The twelve dataset columns, ordered by corrected value and then id."""
    return curated.orderBy("human_corrected_value", "id").select(*vocab.LEARNING_COLUMNS)
