"""Document sets per application: completeness, copies and upload progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier import vocab
from dossier.functions.lit import lookup, sorted_present
from dossier.operators.ordered import evenly_numbered

_CONFIGURED = (*vocab.REQUIRED_TYPES, *vocab.OPTIONAL_TYPES, *vocab.PLACEHOLDER_TYPES)


def _count(t: str) -> Column:
    return F.coalesce(F.col(f"n_{t}"), F.lit(0))


def type_counts(documents: DataFrame) -> DataFrame:
    """Per-type counts of every application that has documents, of a table or of a stream."""
    kind = F.col("document_type")
    watched = (*vocab.REQUIRED_TYPES, *vocab.OPTIONAL_TYPES)
    return documents.groupBy("application_id").agg(
        *[F.count_if(kind == t).alias(f"n_{t}") for t in watched],
        F.array_sort(F.collect_set(F.when(~kind.isin(*_CONFIGURED), kind))).alias("unexpected"),
        F.count_if(F.col("processing_status") == "UPLOADED").alias("uploaded"),
        F.count(F.lit(1)).alias("n_documents"),
    )


def document_counts(apps: DataFrame, documents: DataFrame) -> DataFrame:
    """One wide row of per-type counts per application, in a single pass over documents."""
    return apps.select("application_id").join(type_counts(documents), "application_id", "left")


def completeness(apps: DataFrame, documents: DataFrame) -> DataFrame:
    """Missing, duplicate and unexpected types, percentage and status per application."""
    return completeness_of(document_counts(apps, documents))


def completeness_of(counts: DataFrame) -> DataFrame:
    """The same from rows of :func:`document_counts`."""
    required = vocab.REQUIRED_TYPES
    missing = sorted_present((t, _count(t) == 0) for t in required)
    duplicate = sorted_present(
        (t, _count(t) > 1) for t in (*required, *vocab.OPTIONAL_TYPES)
    )
    present = sum((F.when(_count(t) > 0, 1).otherwise(0) for t in required), F.lit(0))
    shaped = counts.select(
        "application_id",
        missing.alias("missing_documents"),
        duplicate.alias("duplicate_documents"),
        F.coalesce("unexpected", F.array().cast("array<string>")).alias("unexpected_documents"),
        present.alias("received_required"),
        F.lit(len(required)).alias("required_count"),
        F.round(F.lit(100.0) * present / len(required), 2).alias("completion_percentage"),
        F.coalesce("uploaded", F.lit(0)).alias("uploaded_documents"),
    )
    return shaped.withColumn(
        "completeness_status",
        F.when(F.size("unexpected_documents") > 0, "INVALID_DOCUMENT_SET")
        .when(F.size("duplicate_documents") > 0, "DUPLICATE_DOCUMENTS")
        .when(F.size("missing_documents") > 0, "INCOMPLETE")
        .otherwise("COMPLETE"),
    )


def required_vs_received(apps: DataFrame, documents: DataFrame) -> DataFrame:
    """Every application with every required type and how many copies it holds."""
    rows = [
        F.struct(F.lit(t).alias("document_type"), _count(t).alias("copy_count"))
        for t in vocab.REQUIRED_TYPES
    ]
    return (
        document_counts(apps, documents)
        .select("application_id", F.explode(F.array(*rows)).alias("r"))
        .select(
            "application_id",
            "r.document_type",
            "r.copy_count",
            (F.col("r.copy_count") > 0).alias("is_present"),
        )
    )


def upload_progress(apps: DataFrame, documents: DataFrame) -> DataFrame:
    """Each upload category against its required copies, with the overall percentage."""
    kind = F.col("document_type")
    per_app = documents.groupBy("application_id").agg(
        *[
            F.count_if(kind.isin(*types)).alias(f"c_{name}")
            for name, _, _, types in vocab.UPLOAD_CATEGORIES
        ]
    )
    held = {
        name: F.coalesce(F.col(f"c_{name}"), F.lit(0)) for name, *_ in vocab.UPLOAD_CATEGORIES
    }
    needed = sum(copies for _, _, copies, _ in vocab.UPLOAD_CATEGORIES)
    uploaded = sum(held.values(), F.lit(0))
    rows = [
        F.struct(
            F.lit(name).alias("category"),
            F.lit(label).alias("label"),
            F.lit(copies).alias("required"),
            held[name].alias("present"),
            F.when(held[name] >= copies, "complete")
            .when(held[name] > 0, "incomplete")
            .otherwise("missing")
            .alias("status"),
        )
        for name, label, copies, _ in vocab.UPLOAD_CATEGORIES
    ]
    return (
        apps.select("application_id")
        .join(per_app, "application_id", "left")
        .select(
            "application_id",
            F.round(F.least(uploaded, F.lit(needed)) / needed * 100).cast("int").alias("percent"),
            F.explode(F.array(*rows)).alias("r"),
        )
        .select("application_id", "percent", "r.*")
    )


def copy_overflow(documents: DataFrame) -> DataFrame:
    """Highest copy number per application and type, flagged above the allowed copies."""
    allowed = lookup(F.col("document_type"), vocab.MAX_COPIES, F.lit(1))
    return (
        documents.groupBy("application_id", "document_type")
        .agg(F.max("copy_number").alias("highest_copy"), F.count(F.lit(1)).alias("copies"))
        .withColumn("allowed_copies", allowed)
        .withColumn("over_limit", F.col("highest_copy") > F.col("allowed_copies"))
    )


def assign_copy_numbers(new_documents: DataFrame, documents: DataFrame) -> DataFrame:
    """Next free copy numbers per (application, type) in arrival order.

    ``new_documents`` needs ``uploaded_at`` and ``document_id`` for the order.
    """
    keys = ["application_id", "document_type"]
    highest = documents.groupBy(*keys).agg(F.max("copy_number").alias("_highest"))
    order = [F.col("uploaded_at"), F.col("document_id")]
    counted = evenly_numbered(new_documents, keys, order, "_nth")
    return (
        counted.join(highest, keys, "left")
        .withColumn(
            "copy_number", (F.coalesce("_highest", F.lit(0)) + F.col("_nth")).cast("long")
        )
        .drop("_highest", "_nth")
    )
