"""Human review submissions: checks, effects, history and the review screen's data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier import vocab
from dossier.functions.lit import blank, lookup, sorted_present
from dossier.operators.relational import match_corrections


def check_reviews(reviews: DataFrame, checklist: DataFrame, corrections: DataFrame) -> DataFrame:
    """Verdict on each submitted review; the first rule it breaks is named.

    ``reviews``: review_id, application_id, decision, rejection_reason.
    ``checklist``: review_id, item_name, is_checked. ``corrections``: review_id,
    document_id, field_name.
    """
    known = F.col("item_name").isin(*vocab.CHECKLIST_ITEMS)
    # Items are counted per name first, so one review's rows are never gathered.
    per_item = checklist.groupBy("review_id", "item_name").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or("is_checked").alias("checked")
    )
    items = per_item.groupBy("review_id").agg(
        F.min(F.when(~known, F.col("item_name"))).alias("unknown_item"),
        F.min(F.when(known & (F.col("n") > 1), F.col("item_name"))).alias("repeated_item"),
        *[
            F.bool_or((F.col("item_name") == name) & F.col("checked")).alias(f"c_{i}")
            for i, name in enumerate(vocab.CHECKLIST_ITEMS)
        ],
    )
    per_field = corrections.groupBy("review_id", "document_id", "field_name").agg(
        F.count(F.lit(1)).alias("n")
    )
    fixes = per_field.groupBy("review_id").agg(
        F.sum("n").alias("n_corrections"), F.bool_or(F.col("n") > 1).alias("twice")
    )
    joined = reviews.join(items, "review_id", "left").join(fixes, "review_id", "left")
    missing = sorted_present(
        (name, ~F.coalesce(F.col(f"c_{i}"), F.lit(False)))
        for i, name in enumerate(vocab.CHECKLIST_ITEMS)
    )
    decision = F.col("decision")
    reason = ~blank(F.col("rejection_reason"))
    n = F.coalesce("n_corrections", F.lit(0))
    error = (
        F.when(
            F.col("unknown_item").isNotNull(),
            F.concat(F.lit("Unknown checklist item: '"), "unknown_item", F.lit("'")),
        )
        .when(
            F.col("repeated_item").isNotNull(),
            F.concat(
                F.lit("Checklist item listed more than once: '"), "repeated_item", F.lit("'")
            ),
        )
        .when((decision == "APPROVE") & reason, "An approval cannot carry a rejection reason")
        .when((decision == "APPROVE") & (n > 0), "An approval cannot carry corrections")
        .when(
            (decision == "APPROVE") & (F.size(missing) > 0),
            F.concat(F.lit("Checklist items not completed: "), F.array_join(missing, ", ")),
        )
        .when((decision == "CORRECT") & reason, "A correction cannot carry a rejection reason")
        .when((decision == "CORRECT") & (n == 0), "A correction needs at least one corrected field")
        .when(
            (decision == "CORRECT") & F.coalesce("twice", F.lit(False)),
            "A field can only be corrected once per review",
        )
        .when((decision == "REJECT") & (n > 0), "A rejection cannot carry corrections")
        .when((decision == "REJECT") & ~reason, "A rejection needs a reason")
    )
    return joined.select(
        "review_id",
        "application_id",
        "decision",
        error.alias("error"),
        error.isNull().alias("accepted"),
        F.when(error.isNull(), lookup(decision, vocab.DECISION_STATUS)).alias("new_status"),
        n.alias("corrections"),
    )


def apply_corrections(corrections: DataFrame, fields: DataFrame) -> DataFrame:
    """Accepted corrections with the value they replace; ``changed`` marks the ones that
    alter a field and so become feedback."""
    matched = match_corrections(corrections, fields)
    return matched.withColumnRenamed("current_value", "original_value").withColumn(
        "changed",
        F.col("matched_document_id").isNotNull()
        & ~F.col("corrected_value").eqNullSafe(F.col("original_value")),
    )


def apply_reviews(apps: DataFrame, checked: DataFrame, earlier: DataFrame) -> DataFrame:
    """Status of each reviewed application; an application is reviewed only once."""
    done = earlier.select("application_id").distinct().withColumn("_done", F.lit(True))
    # Of several submissions for an application the first accepted one counts.
    first = (
        checked.filter("accepted")
        .groupBy("application_id")
        .agg(F.min_by("new_status", "review_id").alias("_new"), F.min("review_id").alias("review_id"))
    )
    joined = apps.select("application_id", "status").join(first, "application_id")
    joined = joined.join(done, "application_id", "left")
    fresh = F.col("_done").isNull()
    return joined.select(
        "application_id",
        F.col("status").alias("previous_status"),
        F.when(fresh, F.col("_new")).otherwise(F.col("status")).alias("status"),
        F.when(fresh, F.col("review_id")).alias("review_id"),
        fresh.alias("applied"),
    )


def review_history(reviews: DataFrame) -> DataFrame:
    """Reviews per application, newest first."""
    return reviews.orderBy("application_id", F.desc("reviewed_at"), F.desc("id"))


def review_dataset(
    apps: DataFrame,
    document_rows: DataFrame,
    fields: DataFrame,
    detections: DataFrame,
    checklist: DataFrame,
    reviews: DataFrame,
) -> DataFrame:
    """Everything a reviewer sees, as rows of (application, section, item, value).

    Sections are rows and not nested lists, so a pack of any size stays splittable.
    """

    def section(df: DataFrame, name: str, item, value) -> DataFrame:
        return df.select(
            "application_id",
            F.lit(name).alias("section"),
            item.cast("string").alias("item"),
            value.cast("string").alias("value"),
        )

    last = reviews.groupBy("application_id").agg(
        F.max_by("decision", F.struct("reviewed_at", "id")).alias("decision")
    )
    parts = [
        section(apps, "application", F.lit("status"), F.col("status")),
        section(document_rows, "document", F.col("document_id"), F.col("ocr_status")),
        section(
            fields,
            "field",
            F.concat_ws(":", F.col("document_id").cast("string"), "field_name"),
            F.coalesce("human_corrected_value", "normalized_value", "extracted_value"),
        ),
        section(
            detections,
            "detection",
            F.concat_ws(":", F.col("document_id").cast("string"), "detection_type"),
            F.col("is_present"),
        ),
        section(checklist, "checklist", F.col("item_name"), F.col("is_checked")),
        section(last, "last_review", F.lit("decision"), F.col("decision")),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows
