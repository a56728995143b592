"""List, search and lookup jobs over the entity tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier import vocab
from dossier.functions.lit import blank, lookup, sorted_present, strip
from dossier.operators.ordered import latest_per_key


def page(df: DataFrame, order: Sequence[Column], offset: int = 0, limit: int = 50) -> DataFrame:
    """One page of an ordered list; ``order`` must end in a unique column."""
    return df.orderBy(*order).offset(offset).limit(limit)


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def newest_first() -> list[Column]:
    return [F.col("submitted_at").desc(), F.col("application_id").desc()]


def list_applications(
    apps: DataFrame, status: str | None = None, offset: int = 0, limit: int = 50
) -> DataFrame:
    rows = apps if status is None else apps.filter(F.col("status") == status)
    return page(rows, newest_first(), offset, limit)


def matching_applications(
    apps: DataFrame, text: str | None = None, status: str | None = None
) -> DataFrame:
    """Substring match on name or submitter without regard to case; a query of digits also
    matches the id. ``%`` and ``_`` in the query keep their LIKE meaning."""
    rows = apps if status is None else apps.filter(F.col("status") == status)
    if not text:
        return rows
    hit = F.col("name").ilike(f"%{text}%") | F.col("created_by").ilike(f"%{text}%")
    if text.isdigit():
        hit = hit | (F.col("application_id") == int(text))
    return rows.filter(hit)


def search_applications(
    apps: DataFrame,
    text: str | None = None,
    status: str | None = None,
    offset: int = 0,
    limit: int = 50,
) -> DataFrame:
    return page(matching_applications(apps, text, status), newest_first(), offset, limit)


class InvalidFilter(ValueError):
    """A filter that can never match is rejected before any job runs."""


def filter_feedback(
    feedback: DataFrame,
    documents: DataFrame | None = None,
    *,
    application_id: int | None = None,
    reviewer: str | None = None,
    document_type: str | None = None,
    field_name: str | None = None,
    decision: str | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
    min_confidence: float | None = None,
) -> DataFrame:
    """All given filters together; the date range includes both ends, and a document type
    keeps only rows that have a document."""
    if date_from is not None and date_to is not None and date_from > date_to:
        raise InvalidFilter("date_from must not be after date_to")
    if decision is not None and decision not in vocab.KNOWN_DECISIONS:
        raise InvalidFilter(f"unknown decision {decision!r}")
    rows = feedback
    equal = {
        "application_id": application_id,
        "reviewer": reviewer,
        "field_name": field_name,
        "decision": decision,
    }
    for name, value in equal.items():
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    if date_from is not None:
        rows = rows.filter(F.col("recorded_at") >= F.lit(date_from).cast("timestamp_ntz"))
    if date_to is not None:
        rows = rows.filter(F.col("recorded_at") <= F.lit(date_to).cast("timestamp_ntz"))
    if min_confidence is not None:
        rows = rows.filter(F.col("confidence_score") >= min_confidence)
    if document_type is not None:
        wanted = documents.filter(F.col("document_type") == document_type).select("document_id")
        rows = rows.join(wanted, "document_id", "left_semi")
    return rows


def search_audit(
    audit: DataFrame,
    *,
    application_id: int | None = None,
    actor: str | None = None,
    action: str | None = None,
    severity: str | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
    text: str | None = None,
    include_orphaned: bool = True,
) -> DataFrame:
    """Audit rows with start-inclusive, end-exclusive dates; page with :func:`page`."""
    rows = audit
    if application_id is not None:
        rows = rows.filter(F.col("application_id") == application_id)
    if not include_orphaned:
        rows = rows.filter(F.col("application_id").isNotNull())
    if actor:
        rows = rows.filter(F.col("username").ilike(f"%{actor}%"))
    if action:
        rows = rows.filter(F.col("action") == action)
    if severity:
        rows = rows.filter(F.col("severity") == severity)
    if date_from is not None:
        rows = rows.filter(F.col("performed_at") >= F.lit(date_from).cast("timestamp_ntz"))
    if date_to is not None:
        rows = rows.filter(F.col("performed_at") < F.lit(date_to).cast("timestamp_ntz"))
    if text:
        rows = rows.filter(
            F.col("username").ilike(f"%{text}%") | F.col("action").ilike(f"%{text}%")
        )
    return rows


def rule_results(results: DataFrame, category: str | None = None) -> DataFrame:
    """Rows of the rule categories only, so technical checks are left out."""
    wanted = [category] if category else list(vocab.RULE_CATEGORIES)
    return results.filter(F.col("rule_category").isin(*wanted))


def verified_only(fields: DataFrame) -> DataFrame:
    """Fields that may be normalized; no status yet counts as eligible."""
    status = F.coalesce("verification_status", F.lit(""))
    return fields.filter(~status.isin(*vocab.UNVERIFIED_STATUSES))


def suppress_stale(fields: DataFrame) -> DataFrame:
    """Drop the stored value of a field that fell back to an unverified status."""
    stale = F.col("verification_status").isin(*vocab.UNVERIFIED_STATUSES)
    return fields.withColumn(
        "normalized_value",
        F.when(~F.coalesce(stale, F.lit(False)), F.col("normalized_value")),
    )


def transition_if(apps: DataFrame, requests: DataFrame) -> DataFrame:
    """Move status only where the current one is among ``allowed``.

    ``requests`` has (application_id, new_status, allowed array), one row per application.
    """
    moved = F.coalesce(F.array_contains("allowed", F.col("status")), F.lit(False))
    return apps.join(requests, "application_id", "left").select(
        "application_id",
        F.col("status").alias("previous_status"),
        F.when(moved, F.col("new_status")).otherwise(F.col("status")).alias("status"),
        moved.alias("moved"),
    )


def operator_action_verdicts(
    actions: DataFrame, apps: DataFrame, completeness: DataFrame
) -> DataFrame:
    """Judge request / reject / submit actions against status and completeness.

    ``actions``: action_id, application_id, action, reason, missing_types (array).
    ``completeness``: application_id, completeness_status, uploaded_documents.
    """
    joined = (
        actions.join(apps.select("application_id", "status"), "application_id", "left")
        .join(
            completeness.select("application_id", "completeness_status", "uploaded_documents"),
            "application_id",
            "left",
        )
    )
    action = F.col("action")
    status = F.col("status")
    no_types = F.coalesce(F.size("missing_types"), F.lit(0)) <= 0
    error = (
        F.when((action == "REJECT") & blank(F.col("reason")), "MISSING_REASON")
        .when(status.isNull(), "APPLICATION_NOT_FOUND")
        .when((action == "REQUEST") & no_types, "APPLICATION_COMPLETE")
        .when((action == "REQUEST") & ~status.isin(*vocab.REQUEST_FROM), "INVALID_TRANSITION")
        .when((action == "REJECT") & ~status.isin(*vocab.REJECT_FROM), "INVALID_TRANSITION")
        .when((action == "SUBMIT") & ~status.isin(*vocab.SUBMIT_FROM), "INVALID_TRANSITION")
        .when(
            (action == "SUBMIT")
            & (F.coalesce("completeness_status", F.lit("INCOMPLETE")) != "COMPLETE"),
            "INCOMPLETE_APPLICATION",
        )
    )
    judged = joined.withColumn("error", error)
    accepted = F.col("error").isNull()
    starts = (F.coalesce("uploaded_documents", F.lit(0)) > 0) | (status == "NEEDS_DOCUMENTS")
    return judged.select(
        "action_id",
        "application_id",
        "action",
        accepted.alias("accepted"),
        "error",
        F.when(~accepted, status)
        .when(action == "REQUEST", "NEEDS_DOCUMENTS")
        .when(action == "REJECT", "REJECTED")
        .when(starts, "PROCESSING")
        .otherwise(status)
        .alias("new_status"),
        F.when(
            accepted,
            F.when(action == "REQUEST", "DOCUMENTS_REQUESTED")
            .when(action == "REJECT", "OPERATOR_REJECTED")
            .otherwise("SUBMITTED_FOR_PROCESSING"),
        ).alias("event_type"),
    )


def resolve_comment(apps: DataFrame) -> DataFrame:
    """Saved reviewer comment, else the standard text of the status."""
    saved = F.nullif(strip(F.coalesce("reviewer_comments", F.lit(""))), F.lit(""))
    standard = lookup(F.col("status"), vocab.COMMENT_BY_STATUS, F.lit(vocab.COMMENT_DEFAULT))
    return apps.select("application_id", "status", F.coalesce(saved, standard).alias("comment"))


def document_job_messages(jobs: DataFrame) -> DataFrame:
    """Reader-facing status and message of each document job."""
    status = {k: v[0] for k, v in vocab.JOB_MESSAGES.items()}
    message = {k: v[1] for k, v in vocab.JOB_MESSAGES.items()}
    return jobs.filter(F.col("job_type") == "DOCUMENT_OCR").select(
        "job_id",
        "application_id",
        lookup(F.col("status"), status).alias("status"),
        lookup(F.col("status"), message).alias("message"),
        F.coalesce("completed_at", "started_at", "created_at").alias("updated_at"),
    )


def ocr_status(method: Column) -> Column:
    return (
        F.when(method.isNull(), "NOT_PROCESSED")
        .when(method == "PADDLE_OCR", "OCR_PROCESSED")
        .otherwise("TEXT_EXTRACTED")
    )


def text_preview(documents: DataFrame, ocr: DataFrame, n: int = vocab.PREVIEW_LENGTH) -> DataFrame:
    """Text status and leading characters of each document's text."""
    return documents.select("document_id", "application_id").join(ocr, "document_id", "left").select(
        "document_id",
        "application_id",
        ocr_status(F.col("processing_method")).alias("ocr_status"),
        F.col("overall_confidence").alias("ocr_confidence"),
        F.substring("raw_ocr_text", 1, n).alias("ocr_text_preview"),
    )


# ------------------------------------------------------------------ joins


def fields_with_documents(fields: DataFrame, ocr: DataFrame, documents: DataFrame) -> DataFrame:
    """Fields over their text row to their document, in (document, field) order.

    Text rows meet their documents first, so the many fields are joined once, with the text rows
    hashed. There the fields of a text row become one list, so that the order is made of text
    rows; every document lies in one range, where its fields are rows again and sorted.
    """
    sources = ocr.select("ocr_result_id", "document_id").join(
        documents.select("document_id", "application_id", "document_type"), "document_id"
    )
    held = ("field_name", "extracted_value", "confidence_score")
    of_source = ["document_id", "ocr_result_id", "application_id", "document_type"]
    listed = (
        fields.select("ocr_result_id", *held)
        .join(sources.hint("shuffle_hash"), "ocr_result_id")
        .groupBy(*of_source)
        .agg(F.collect_list(F.struct(*held)).alias("_held"))
        .select(*of_source, *[F.col(f"_held.{c}").alias(c) for c in held])
    )
    return (
        listed.repartitionByRange("document_id")
        .select(*of_source, F.inline(F.arrays_zip(*held)))
        .select("document_id", "ocr_result_id", *held, "application_id", "document_type")
        .sortWithinPartitions("document_id", "field_name")
    )


def analysis_with_documents(analysis: DataFrame, documents: DataFrame) -> DataFrame:
    return analysis.select("document_id", "verification_status", "confidence_score").join(
        documents.select("document_id", "application_id", "document_type"), "document_id"
    )


def detections_with_documents(detections: DataFrame, documents: DataFrame) -> DataFrame:
    return detections.select("document_id", "detection_type", "is_present", "confidence").join(
        documents.select("document_id", "application_id", "document_type"), "document_id"
    )


def with_document_type(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Add ``document_type``; UNKNOWN where the document is absent."""
    types = documents.select("document_id", F.col("document_type").alias("_type"))
    return (
        rows.join(types, "document_id", "left")
        .withColumn("document_type", F.coalesce("_type", F.lit(vocab.UNKNOWN)))
        .drop("_type")
    )


def field_source_context(
    fields: DataFrame, ocr: DataFrame, documents: DataFrame, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Source document of each field: 0 / 'unknown' where it cannot be found. ``keep`` names
    further columns of ``fields`` that are carried along."""
    sources = ocr.select("ocr_result_id", F.col("document_id").alias("_doc")).join(
        documents.select(F.col("document_id").alias("_doc"), "original_filename"), "_doc", "left"
    )
    # A text row has many fields: its source is hashed, and they need not be sorted.
    return fields.select("ocr_result_id", "field_name", *keep).join(
        sources.hint("shuffle_hash"), "ocr_result_id", "left"
    ).select(
        "ocr_result_id",
        "field_name",
        *keep,
        F.coalesce("_doc", F.lit(0)).alias("document_id"),
        F.coalesce("original_filename", F.lit("unknown")).alias("file_name"),
    )


def documents_without_job(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """Uploaded documents that have no queue row yet."""
    waiting = documents.filter(F.col("processing_status") == "UPLOADED")
    return waiting.select("document_id", "application_id").join(
        jobs.select("document_id"), "document_id", "left_anti"
    )


def documents_with_job(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    waiting = documents.filter(F.col("processing_status") == "UPLOADED")
    return waiting.select("document_id", "application_id").join(
        jobs.select("document_id"), "document_id", "left_semi"
    )


def checklist_state(apps: DataFrame, checklists: DataFrame) -> DataFrame:
    """Every checklist item of every application; absent items are unchecked."""
    items = F.explode(F.array(*[F.lit(i) for i in vocab.CHECKLIST_ITEMS]))
    return (
        apps.select("application_id", items.alias("item_name"))
        .join(checklists, ["application_id", "item_name"], "left")
        .select(
            "application_id",
            "item_name",
            F.coalesce("is_checked", F.lit(False)).alias("is_checked"),
            "reviewer",
            "checked_at",
        )
    )


def match_corrections(corrections: DataFrame, fields: DataFrame) -> DataFrame:
    """Field row of each correction: by document and name, or by name alone, where the
    last field row of the application wins. Unmatched corrections stay with nulls.

    Only fields of an application and name that some correction has are looked at; they are
    dealt out by these two once, and both ways of matching find them there.
    """
    value = F.coalesce(F.nullif(F.col("human_corrected_value"), F.lit("")), F.col("extracted_value"))
    pair = ["application_id", "field_name"]
    known = _of_few_names(fields, corrections).select(
        *pair, F.col("document_id").alias("matched_document_id"), value.alias("current_value")
    )
    known = known.join(corrections.select(*pair), pair, "left_semi")
    by_document = corrections.filter(F.col("document_id").isNotNull()).join(
        known.withColumn("document_id", F.col("matched_document_id")),
        ["application_id", "document_id", "field_name"],
        "left",
    )
    last = latest_per_key(known, pair, ["matched_document_id"])
    by_name = corrections.filter(F.col("document_id").isNull()).join(last, pair, "left")
    columns = [*corrections.columns, "matched_document_id", "current_value"]
    return by_document.select(columns).unionByName(by_name.select(columns))


def _of_few_names(fields: DataFrame, corrections: DataFrame, most: int = 1000) -> DataFrame:
    """Fields under a name that is corrected; all of them where more than ``most`` names are."""
    names = [r[0] for r in corrections.select("field_name").distinct().limit(most + 1).collect()]
    if len(names) > most:
        return fields
    return fields.filter(F.col("field_name").isin(*[n for n in names if n is not None]))


def rules_x_applications(apps: DataFrame) -> DataFrame:
    """One row per application and registered rule."""
    rules = [
        F.struct(F.lit(i).alias("rule_id"), F.lit(n).alias("rule_name"), F.lit(c).alias("rule_category"))
        for i, n, c in vocab.rule_catalogue()
    ]
    return apps.select("application_id", F.explode(F.array(*rules)).alias("r")).select(
        "application_id", "r.*"
    )


def salary_month_in_period(fields: DataFrame) -> DataFrame:
    """Whether each salary month lies inside every statement period of its application.

    A month is inside all periods when it is not before the latest start and not after
    the earliest end, so one aggregate per application replaces month-period pairs.
    """
    value = strip(F.coalesce("normalized_value", F.lit("")))
    rows = fields.select("application_id", "document_id", "field_name", value.alias("v"))
    bounds = (
        rows.filter((F.col("field_name") == "statement_period") & F.col("v").contains(" - "))
        .groupBy("application_id")
        .agg(
            F.max(F.substring(F.substring_index("v", " - ", 1), 1, 7)).alias("latest_start"),
            F.min(F.substring(F.regexp_extract("v", r"^.*? - (.*)$", 1), 1, 7)).alias("earliest_end"),
        )
    )
    months = rows.filter((F.col("field_name") == "salary_month") & (F.col("v") != ""))
    return months.join(bounds, "application_id").select(
        "application_id",
        "document_id",
        F.col("v").alias("salary_month"),
        ((F.col("latest_start") <= F.col("v")) & (F.col("v") <= F.col("earliest_end"))).alias("within"),
    )


def documents_in_order(documents: DataFrame) -> DataFrame:
    """By type, newest upload first, then highest id."""
    return documents.select(
        "application_id", "document_id", "document_type", "uploaded_at"
    ).orderBy("application_id", "document_type", F.desc("uploaded_at"), F.desc("document_id"))


# ------------------------------------------------------------------ sets


def type_flags(documents: DataFrame, types: Sequence[str]) -> DataFrame:
    """Count of each listed document type per application, one column per type."""
    return documents.groupBy("application_id").agg(
        *[F.count_if(F.col("document_type") == t).alias(f"n_{t}") for t in types]
    )


def type_differences(apps: DataFrame, documents: DataFrame) -> DataFrame:
    """Required types not uploaded, and uploaded types nobody configured."""
    configured = (*vocab.REQUIRED_TYPES, *vocab.OPTIONAL_TYPES, *vocab.PLACEHOLDER_TYPES)
    kind = F.col("document_type")
    per_app = documents.groupBy("application_id").agg(
        *[F.count_if(kind == t).alias(f"n_{t}") for t in vocab.REQUIRED_TYPES],
        F.array_sort(F.collect_set(F.when(~kind.isin(*configured), kind))).alias("unexpected"),
    )
    return apps.select("application_id").join(per_app, "application_id", "left").select(
        "application_id",
        sorted_present(
            (t, F.coalesce(F.col(f"n_{t}"), F.lit(0)) == 0) for t in vocab.REQUIRED_TYPES
        ).alias("missing_types"),
        F.coalesce("unexpected", F.array().cast("array<string>")).alias("unexpected_types"),
    )


def participants_missing(apps: DataFrame, documents: DataFrame) -> DataFrame:
    """Participant types of each cross-document rule an application does not hold."""
    rules = vocab.CROSS_RULES + vocab.UNREGISTERED_CROSS_RULES
    types = sorted({t for r in rules for t in r[3]})
    flags = type_flags(documents, types)
    joined = apps.select("application_id").join(flags, "application_id", "left")
    rows = [
        F.struct(
            F.lit(r[0]).alias("rule_id"),
            sorted_present(
                (t, F.coalesce(F.col(f"n_{t}"), F.lit(0)) == 0) for t in r[3]
            ).alias("missing_participants"),
        )
        for r in rules
    ]
    return joined.select("application_id", F.explode(F.array(*rows)).alias("r")).select(
        "application_id", "r.*"
    )
