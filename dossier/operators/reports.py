"""Report summaries per application, as aggregates of bounded width."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier import vocab
from dossier.functions.lit import lookup, sorted_present
from dossier.operators.relational import ocr_status, rule_results

_STATUS_COUNTS = (
    ("passed", "PASS"),
    ("failed", "FAIL"),
    ("warnings", "WARNING"),
    ("pending_review", "PENDING_MANUAL_REVIEW"),
)


def _tallies(test: Column, prefix: str) -> list[Column]:
    """Total and per-status counts of the rows that meet ``test``."""
    status = F.col("status")
    return [F.count_if(test).alias(f"{prefix}_total")] + [
        F.count_if(test & (status == value)).alias(f"{prefix}_{name}")
        for name, value in _STATUS_COUNTS
    ]


def _unfold(wide: DataFrame, label: str, names: dict[str, str], keep: list[str]) -> DataFrame:
    """One row per group from the wide counts made by :func:`_tallies`."""
    cells = [
        F.struct(
            F.lit(shown).alias(label),
            *[F.col(f"{p}_{n}").alias(n) for n in ("total", *[x for x, _ in _STATUS_COUNTS])],
        )
        for p, shown in names.items()
    ]
    return wide.select(*keep, F.explode(F.array(*cells)).alias("r")).select(*keep, "r.*")


def rule_summary(results: DataFrame) -> DataFrame:
    """Counts per application and category; all eight categories appear."""
    names = {f"c{i}": c for i, c in enumerate(vocab.RULE_CATEGORIES)}
    aggs = [a for p, c in names.items() for a in _tallies(F.col("rule_category") == c, p)]
    wide = rule_results(results).groupBy("application_id").agg(*aggs)
    return _unfold(wide, "rule_category", names, ["application_id"])


def rule_totals(results: DataFrame) -> DataFrame:
    """Counts over all rules of an application."""
    counts = [
        F.count_if(F.col("status") == value).alias(name) for name, value in _STATUS_COUNTS
    ]
    return rule_results(results).groupBy("application_id").agg(
        F.count(F.lit(1)).alias("total"), *counts
    )


def overall_rule_status(results: DataFrame) -> DataFrame:
    """Strictest status among the rule rows of each application."""
    order = {s: i for i, s in enumerate(vocab.RULE_STATUS_PRECEDENCE)}
    back = {i: s for s, i in order.items()}
    ranked = rule_results(results).groupBy("application_id").agg(
        F.min(lookup(F.col("status"), order)).alias("r")
    )
    return ranked.select("application_id", lookup(F.col("r"), back).alias("validation_status"))


def group_label(category: Column, rule_id: Column) -> Column:
    """Display group of a rule row; an unknown category keeps its own name."""
    known = lookup(category, vocab.REPORT_GROUP_OF_CATEGORY, category)
    return (
        F.when((category == "visual") & rule_id.startswith("VIS_SIGNATURE_"), "Signature Validation")
        .when((category == "visual") & rule_id.startswith("VIS_STAMP_"), "Stamp Validation")
        .otherwise(known)
    )


def report_rule_groups(results: DataFrame) -> DataFrame:
    """Counts per application and display group, in eight fixed groups."""
    labelled = rule_results(results).withColumn(
        "_group", group_label(F.col("rule_category"), F.col("rule_id"))
    )
    names = {f"g{i}": g for i, g in enumerate(vocab.REPORT_GROUPS)}
    aggs = [a for p, g in names.items() for a in _tallies(F.col("_group") == g, p)]
    wide = labelled.groupBy("application_id").agg(*aggs)
    return _unfold(wide, "report_group", names, ["application_id"])


def extraction_summary(fields: DataFrame) -> DataFrame:
    status = F.col("verification_status")
    corrected = F.coalesce(status == "CORRECTED", F.lit(False)) | (
        F.coalesce("human_corrected_value", F.lit("")) != ""
    )
    return fields.groupBy("application_id").agg(
        F.count(F.lit(1)).alias("total_fields"),
        F.count_if(status == "AUTO_VERIFIED").alias("auto_verified"),
        F.count_if(corrected).alias("human_corrected"),
        F.count_if(status == "PENDING_REVIEW").alias("pending_review"),
        F.count_if(status == "CANNOT_VERIFY").alias("cannot_verify"),
        F.round(F.avg("confidence_score"), 4).alias("overall_confidence"),
    )


def field_progress(extraction: DataFrame) -> DataFrame:
    """Verified share of the fields in whole percent."""
    share = F.floor(F.col("auto_verified") / F.col("total_fields") * 100 + 0.5)
    return extraction.select(
        "application_id",
        F.col("total_fields").alias("total"),
        F.col("auto_verified").alias("verified"),
        F.col("pending_review").alias("needs_review"),
        F.when(F.col("total_fields") > 0, share).otherwise(0).cast("int").alias("progress"),
    )


def visual_summary(detections: DataFrame) -> DataFrame:
    kind, present = F.col("detection_type"), F.col("is_present")
    return detections.groupBy("application_id").agg(
        F.count_distinct("document_id").alias("documents_checked"),
        F.count_if((kind == "SIGNATURE") & present).alias("signature_detected"),
        F.count_if((kind == "SIGNATURE") & ~present).alias("signature_missing"),
        F.count_if((kind == "STAMP") & present).alias("stamp_detected"),
        F.count_if((kind == "STAMP") & ~present).alias("stamp_missing"),
        F.round(F.avg("confidence"), 4).alias("average_confidence"),
    )


def report_document_rows(
    documents: DataFrame, ocr: DataFrame, analysis: DataFrame, checks: DataFrame
) -> DataFrame:
    """Each document with its text, technical and analysis state."""
    technical = checks.groupBy("document_id").agg(
        F.bool_or(F.col("status") == "FAIL").alias("_failed")
    )
    return (
        documents.select("document_id", "application_id", "document_type", "processing_status")
        .join(ocr.select("document_id", "processing_method", "overall_confidence"), "document_id", "left")
        .join(technical, "document_id", "left")
        .join(
            analysis.select("document_id", F.col("verification_status").alias("_analysis")),
            "document_id",
            "left",
        )
        .select(
            "document_id",
            "application_id",
            "document_type",
            "processing_status",
            ocr_status(F.col("processing_method")).alias("ocr_status"),
            F.col("overall_confidence").alias("ocr_confidence"),
            F.when(F.col("_failed").isNull(), "NOT_VALIDATED")
            .when(F.col("_failed"), "FAILED")
            .otherwise("PASS")
            .alias("technical_validation_status"),
            F.coalesce("_analysis", F.lit("NOT_ANALYZED")).alias("analysis_status"),
        )
    )


def _rule_flag_aggs() -> list[Column]:
    """Failures, pending rows and the facts the advice depends on, of rule rows."""
    failed = F.col("status") == "FAIL"
    rule = F.col("rule_id")
    again = F.coalesce(F.col("message").contains(vocab.DUPLICATE_MARKER), F.lit(False))
    aggs = [
        F.bool_or(failed).alias("rule_failed"),
        F.bool_or(F.col("status") == "PENDING_MANUAL_REVIEW").alias("rule_pending"),
        F.bool_or(failed & (F.col("rule_category") == "date")).alias("date_failed"),
    ]
    for r in vocab.DOCUMENT_RULES:
        hit = failed & (rule == r.rule_id)
        aggs.append(F.bool_or(hit & ~again).alias(f"missing_{r.document_type}"))
        aggs.append(F.bool_or(hit & again).alias(f"duplicate_{r.document_type}"))
    for v in vocab.VISUAL_RULES:
        aggs.append(F.bool_or(failed & (rule == v.rule_id)).alias(v.rule_id))
    for rule_id in (
        "CROSS_IBAN_MATCH",
        "CROSS_ACCOUNT_HOLDER_MATCH",
        "CROSS_ACCOUNT_NUMBER_MATCH",
        "CROSS_PERIOD_MATCH",
        "POL_BALANCE_RECONCILIATION",
    ):
        aggs.append(F.bool_or(failed & (rule == rule_id)).alias(rule_id))
    return aggs


def _check_flags(checks: DataFrame) -> DataFrame:
    failed = F.col("status") == "FAIL"
    return checks.groupBy("application_id").agg(
        F.bool_or(failed).alias("check_failed"),
        F.bool_or(failed & F.col("message").contains(vocab.BLUR_MARKER)).alias("blurred"),
    )


def _rule_flags(results: DataFrame, checks: DataFrame) -> DataFrame:
    """Per application: failures, pending rows and the facts the advice depends on."""
    per_rule = rule_results(results).groupBy("application_id").agg(*_rule_flag_aggs())
    return per_rule.join(_check_flags(checks), "application_id", "full")


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _overall() -> Column:
    failure = _flag("rule_failed") | _flag("check_failed")
    return (
        F.when(F.col("status") == "REJECTED", "REJECTED")
        .when(failure, "FAILED")
        .when(_pending(), "MANUAL_REVIEW_REQUIRED")
        .otherwise("APPROVED")
    )


def _pending() -> Column:
    """No rule rows at all counts as pending."""
    return F.col("rule_failed").isNull() | _flag("rule_pending")


def report_overall_status(apps: DataFrame, results: DataFrame, checks: DataFrame) -> DataFrame:
    joined = apps.select("application_id", "status").join(
        _rule_flags(results, checks), "application_id", "left"
    )
    return joined.select("application_id", "status", _overall().alias("overall_status"))


def _low_confidence() -> Column:
    """Whether any field row is doubtful, as an aggregate."""
    doubtful = (F.col("confidence_score") < vocab.CONFIDENCE_FLOOR) | F.col(
        "verification_status"
    ).isin(*vocab.UNVERIFIED_STATUSES)
    return F.bool_or(F.coalesce(doubtful, F.lit(False))).alias("low_confidence")


def recommendations(
    apps: DataFrame, results: DataFrame, checks: DataFrame, fields: DataFrame
) -> DataFrame:
    """Coded advice per application, in report order (``position``)."""
    joined = (
        apps.select("application_id", "status")
        .join(_rule_flags(results, checks), "application_id", "left")
        .join(fields.groupBy("application_id").agg(_low_confidence()), "application_id", "left")
    )
    return joined.select("application_id", F.explode(_advice()).alias("r")).select(
        "application_id", "r.*"
    )


def _advice() -> Column:
    """Array of (position, code, message) from the flags of one application."""
    missing = sorted_present(
        (r.document_type, _flag(f"missing_{r.document_type}")) for r in vocab.DOCUMENT_RULES
    )
    duplicate = sorted_present(
        (r.document_type, _flag(f"duplicate_{r.document_type}")) for r in vocab.DOCUMENT_RULES
    )
    unsigned = sorted_present(
        (r.document_type, _flag(r.rule_id))
        for r in vocab.VISUAL_RULES
        if r.detection_type == "SIGNATURE"
    )
    unstamped = sorted_present(
        (r.document_type, _flag(r.rule_id))
        for r in vocab.VISUAL_RULES
        if r.detection_type == "STAMP"
    )
    lists = {
        "MISSING_REQUIRED_DOCUMENT": missing,
        "DUPLICATE_REQUIRED_DOCUMENT": duplicate,
        "MISSING_SIGNATURE": unsigned,
        "MISSING_STAMP": unstamped,
    }
    flags = {
        "IBAN_INCONSISTENCY": _flag("CROSS_IBAN_MATCH"),
        "HOLDER_INCONSISTENCY": _flag("CROSS_ACCOUNT_HOLDER_MATCH"),
        "ACCOUNT_NUMBER_INCONSISTENCY": _flag("CROSS_ACCOUNT_NUMBER_MATCH"),
        "PERIOD_INCONSISTENCY": _flag("CROSS_PERIOD_MATCH"),
        "BALANCE_RECONCILIATION": _flag("POL_BALANCE_RECONCILIATION"),
        "VERIFY_BLURRED_DOCUMENTS": _flag("blurred"),
        "CORRECT_LOW_CONFIDENCE": _flag("low_confidence"),
        "REVIEW_DATES": _flag("date_failed"),
        "COMPLETE_PENDING_REVIEW": _pending(),
    }
    cells = []
    raised = F.lit(False)
    for i, (code, text) in enumerate(vocab.RECOMMENDATIONS):
        message: Column = F.lit(text)
        if code in lists:
            test = F.size(lists[code]) > 0
            before, after = text.split("{details}")
            message = F.concat(F.lit(before), F.array_join(lists[code], ", "), F.lit(after))
        elif code in flags:
            test = flags[code]
        else:
            test = ~raised & (_overall() == "APPROVED")
        raised = raised | test
        cells.append(
            F.when(
                test,
                F.struct(
                    F.lit(i + 1).alias("position"), F.lit(code).alias("code"), message.alias("message")
                ),
            )
        )
    return F.array_compact(F.array(*cells))


_GROUP_PREFIXES = {f"g{i}": g for i, g in enumerate(vocab.REPORT_GROUPS)}


def _report_facts(
    apps: DataFrame, documents: DataFrame, results: DataFrame, checks: DataFrame, fields: DataFrame
) -> DataFrame:
    """All that a report needs of an application in one row; every table is aggregated once."""
    labelled = rule_results(results).withColumn(
        "_group", group_label(F.col("rule_category"), F.col("rule_id"))
    )
    groups = [a for p, g in _GROUP_PREFIXES.items() for a in _tallies(F.col("_group") == g, p)]
    rules = labelled.groupBy("application_id").agg(
        *[a for a, n in zip(_tallies(F.lit(True), "rule"), ("total", *[n for n, _ in _STATUS_COUNTS])) if n != "failed"],
        F.count_if(F.col("status") == "FAIL").alias("rules_failed"),
        *groups,
        *_rule_flag_aggs(),
    )
    extraction = fields.groupBy("application_id").agg(
        F.count(F.lit(1)).alias("field_count"),
        F.round(F.avg("confidence_score"), 4).alias("overall_confidence"),
        _low_confidence(),
    )
    docs = documents.groupBy("application_id").agg(F.count(F.lit(1)).alias("document_count"))
    joined = apps.select("application_id", "status")
    for part in (rules, _check_flags(checks), extraction, docs):
        joined = joined.join(part, "application_id", "left")
    return joined.withColumn("advice", _advice())


def _headline() -> list[Column]:
    def count(name: str, shown: str | None = None) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).alias(shown or name)

    return [
        F.col("application_id"),
        F.col("status").alias("application_status"),
        _overall().alias("overall_status"),
        count("document_count"),
        *[count(f"rule_{n}") for n in ("total", "passed")],
        # "rule_failed" is a flag of the rows as well, so the count has a name of its own.
        count("rules_failed", "rule_failed"),
        *[count(f"rule_{n}") for n in ("warnings", "pending_review")],
        count("field_count"),
        F.size("advice").cast("long").alias("recommendation_count"),
        F.col("overall_confidence"),
    ]


def validation_summary(
    apps: DataFrame,
    documents: DataFrame,
    results: DataFrame,
    checks: DataFrame,
    fields: DataFrame,
) -> DataFrame:
    """One headline row per application."""
    return _report_facts(apps, documents, results, checks, fields).select(*_headline())


def validation_report(
    apps: DataFrame,
    documents: DataFrame,
    results: DataFrame,
    checks: DataFrame,
    fields: DataFrame,
    detections: DataFrame,
) -> DataFrame:
    """Headline with the eight rule groups and the advice nested in one row.

    Documents stay in :func:`report_document_rows`, because their number has no bound.
    """
    facts = _report_facts(apps, documents, results, checks, fields)
    names = ("total", *[n for n, _ in _STATUS_COUNTS])
    groups = [
        F.struct(F.lit(shown).alias("report_group"), *[F.col(f"{p}_{n}").alias(n) for n in names])
        for p, shown in sorted(_GROUP_PREFIXES.items(), key=lambda x: x[1])
    ]
    seen = visual_summary(detections)
    visual = seen.select(
        "application_id",
        F.struct(*[c for c in seen.columns if c != "application_id"]).alias("visual"),
    )
    return facts.select(
        *_headline(),
        F.when(F.col("rule_total").isNotNull(), F.array(*groups)).alias("rule_groups"),
        F.when(F.size("advice") > 0, F.col("advice")).alias("advice"),
    ).join(visual, "application_id", "left")


def technical_verdict(checks: DataFrame) -> DataFrame:
    """Technical outcome of each document from its check rows."""
    rule, status = F.col("rule_id"), F.col("status")
    ids = [c[0] for c in vocab.TECHNICAL_CHECKS]
    base = rule != vocab.READABILITY_CHECK
    aggs = [
        F.bool_or(status == "FAIL").alias("any_fail"),
        F.bool_or(status == "WARNING").alias("any_warning"),
        F.bool_or(base & (status == "FAIL")).alias("base_fail"),
        F.bool_or(base & (status == "WARNING")).alias("base_warning"),
    ]
    for name, members in vocab.TECHNICAL_GROUPS.items():
        aggs.append(F.bool_and(F.when(rule.isin(*members), status == "PASS")).alias(name))
    for i in ids:
        aggs.append(F.bool_or((rule == i) & (status == "FAIL")).alias(f"f_{i}"))
        aggs.append(F.bool_or((rule == i) & (status == "WARNING")).alias(f"w_{i}"))
    wide = checks.groupBy("application_id", "document_id").agg(*aggs)

    def listed(prefix: str, position: int) -> Column:
        return F.array_compact(
            F.array(*[F.when(_flag(f"{prefix}_{c[0]}"), F.lit(c[position])) for c in vocab.TECHNICAL_CHECKS])
        )

    advice = F.array_distinct(F.concat(listed("f", 2), listed("w", 2)))
    return wide.select(
        "application_id",
        "document_id",
        F.when(F.col("any_fail"), "FAIL")
        .when(F.col("any_warning"), "WARNING")
        .otherwise("PASS")
        .alias("validation_status"),
        _flag("file_accessible").alias("file_accessible"),
        _flag("file_type_valid").alias("file_type_valid"),
        "pdf_valid",
        "image_valid",
        F.when(_flag("w_TECH_ROTATION"), "ROTATED").otherwise("NOT_ROTATED").alias("rotation_status"),
        F.when(_flag("base_fail"), "UNREADABLE")
        .when(_flag("base_warning"), "PARTIALLY_READABLE")
        .otherwise("READABLE")
        .alias("readability_status"),
        listed("f", 1).alias("failed_checks"),
        listed("w", 1).alias("warnings"),
        F.when(F.size(advice) > 0, advice)
        .otherwise(F.array(F.lit(vocab.TECHNICALLY_FINE)))
        .alias("recommendations"),
    )


# ------------------------------------------------------------------ reader views


def classify_failures(results: DataFrame, completeness: DataFrame) -> DataFrame:
    """Rule rows with a reader status: a failure that only follows from a missing document
    is NOT_VERIFIABLE, with the reason.

    ``results`` needs ``has_related_documents``; ``completeness`` ``missing_documents``.
    """
    joined = results.join(
        completeness.select("application_id", "missing_documents"), "application_id", "left"
    )
    missing = F.coalesce("missing_documents", F.array().cast("array<string>"))
    rule, status = F.col("rule_id"), F.col("status")
    target = lookup(rule, vocab.RULE_TARGET_TYPE)
    target_gone = F.coalesce(F.array_contains(missing, target), F.lit(False))
    label = lookup(target, vocab.TYPE_LABELS, F.lit(vocab.DEFAULT_TYPE_LABEL))
    target_reason = F.concat(label, F.lit(" is missing"))
    cross_rules = vocab.CROSS_RULES + vocab.UNREGISTERED_CROSS_RULES
    gone_labels = F.array().cast("array<string>")
    known_cross = F.lit(False)
    for rule_id, _, _, types in cross_rules:
        here = F.array_compact(
            F.array(
                *[
                    F.when(F.array_contains(missing, F.lit(t)), F.lit(vocab.type_label(t)))
                    for t in types
                ]
            )
        )
        gone_labels = F.when(rule == rule_id, here).otherwise(gone_labels)
        known_cross = known_cross | (rule == rule_id)
    is_doc = rule.startswith("DOC_") & rule.endswith("_PRESENT")
    is_field = rule.startswith("FLD_") & rule.endswith("_PRESENT")
    is_visual = rule.startswith("VIS_SIGNATURE_") | rule.startswith("VIS_STAMP_")
    is_cross = rule.startswith("CROSS_")
    unrelated = ~F.coalesce("has_related_documents", F.lit(False))
    text = F.lower(F.coalesce("message", F.lit("")))
    says_missing = (
        text.contains("is missing") | text.contains("cannot verify") | text.contains("cannot compare")
    )
    plural = F.when(F.size(gone_labels) > 1, "s").otherwise("")
    reason = (
        F.when(status != "FAIL", F.lit(None).cast("string"))
        .when((is_doc | is_visual | is_field) & target_gone, target_reason)
        .when(
            is_cross & (F.size(gone_labels) > 0),
            F.concat(
                F.lit("Required document"),
                plural,
                F.lit(" missing: "),
                F.array_join(gone_labels, ", "),
            ),
        )
        .when(is_cross & ~known_cross & unrelated, "Required documents are missing")
        .when(~is_doc & ~is_field & unrelated & says_missing, vocab.NOT_YET_AVAILABLE)
    )
    return (
        joined.withColumn("not_verifiable_reason", reason)
        .drop("missing_documents")
        .withColumn(
            "semantic_status",
            F.when(status == "PASS", "PASSED")
            .when(status == "WARNING", "WARNING")
            .when((status == "FAIL") & F.col("not_verifiable_reason").isNotNull(), "NOT_VERIFIABLE")
            .when(status == "FAIL", "FAILED")
            .otherwise("PENDING"),
        )
    )


def semantic_summary(classified: DataFrame, *by: str) -> DataFrame:
    """Reader counts per application (and further columns); the parts add up to the total."""
    state = F.col("semantic_status")
    return classified.groupBy("application_id", *by).agg(
        F.count(F.lit(1)).alias("total_checks"),
        F.count_if(state == "PASSED").alias("passed"),
        F.count_if(state == "FAILED").alias("actual_failures"),
        F.count_if(state == "WARNING").alias("warnings"),
        F.count_if(state == "PENDING").alias("pending"),
        F.count_if(state == "NOT_VERIFIABLE").alias("not_verifiable"),
    )


def attention_items(classified: DataFrame, completeness: DataFrame) -> DataFrame:
    """What needs attention: failures, missing and duplicate documents, pending checks."""
    state, rule = F.col("semantic_status"), F.col("rule_id")
    pending = F.col("status") == "PENDING_MANUAL_REVIEW"
    signature, stamp = rule.startswith("VIS_SIGNATURE_"), rule.startswith("VIS_STAMP_")
    counts = classified.groupBy("application_id").agg(
        F.count_if(state == "FAILED").alias("n_failure"),
        F.count_if(pending).alias("n_pending"),
        F.count_if(pending & signature).alias("n_signature"),
        F.count_if(pending & stamp).alias("n_stamp"),
    )
    joined = completeness.select(
        "application_id",
        F.size("missing_documents").alias("n_missing"),
        F.size("duplicate_documents").alias("n_duplicate"),
    ).join(counts, "application_id", "full")

    def n(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).cast("long")

    def item(kind: str, count: Column, one: str, many: str, *parts: Column) -> Column:
        signatures, stamps, others = parts or (F.lit(0).cast("long"),) * 3
        return F.when(
            count > 0,
            F.struct(
                F.lit(kind).alias("item_type"),
                count.alias("item_count"),
                F.when(count == 1, one).otherwise(many).alias("label"),
                signatures.alias("signature_checks"),
                stamps.alias("stamp_checks"),
                others.alias("other_checks"),
            ),
        )

    others = n("n_pending") - n("n_signature") - n("n_stamp")
    items = F.array_compact(
        F.array(
            item("failure", n("n_failure"), "Actual Validation Failure", "Actual Validation Failures"),
            item("missingDoc", n("n_missing"), "Required Document Missing", "Required Documents Missing"),
            item("duplicate", n("n_duplicate"), "Duplicate Document", "Duplicate Documents"),
            item(
                "pending",
                n("n_pending"),
                "Check Pending",
                "Checks Pending",
                n("n_signature"),
                n("n_stamp"),
                others,
            ),
        )
    )
    return joined.select("application_id", F.explode(items).alias("i")).select(
        "application_id", "i.*"
    )


def document_groups(received: DataFrame) -> DataFrame:
    """Required types as present, duplicate (more copies than required) or missing.

    ``received`` is :func:`dossier.operators.completeness.required_vs_received`.
    """
    kind = F.col("document_type")
    copies = lookup(kind, vocab.TYPE_COPIES, F.lit(vocab.DEFAULT_TYPE_COPIES))
    return received.select(
        "application_id",
        "document_type",
        lookup(kind, vocab.TYPE_LABELS, F.lit(vocab.DEFAULT_TYPE_LABEL)).alias("label"),
        F.when(~F.col("is_present"), "missing")
        .when(F.col("copy_count") > copies, "duplicate")
        .otherwise("present")
        .alias("status"),
        copies.alias("required_copies"),
        "copy_count",
    )


def visual_counts(visual: DataFrame, classified: DataFrame, completeness: DataFrame) -> DataFrame:
    """Signature and stamp outcomes with pending and not verifiable checks."""
    rule, status = F.col("rule_id"), F.col("status")
    targets = {r.rule_id: r.document_type for r in vocab.VISUAL_RULES}
    rows = classified.filter(rule.startswith("VIS_SIGNATURE_") | rule.startswith("VIS_STAMP_")).join(
        completeness.select("application_id", "missing_documents"), "application_id", "left"
    )
    gone = F.coalesce(
        F.array_contains("missing_documents", lookup(rule, targets)), F.lit(False)
    )
    stamp = rule.startswith("VIS_STAMP_")
    held = status == "PENDING_MANUAL_REVIEW"
    counts = rows.groupBy("application_id").agg(
        F.count_if(held & ~stamp).alias("signature_pending"),
        F.count_if((status == "FAIL") & gone & ~stamp).alias("signature_not_verifiable"),
        F.count_if(held & stamp).alias("stamp_pending"),
        F.count_if((status == "FAIL") & gone & stamp).alias("stamp_not_verifiable"),
    )
    names = (
        "signature_pending",
        "signature_not_verifiable",
        "stamp_pending",
        "stamp_not_verifiable",
    )
    return visual.join(counts, "application_id", "left").select(
        "application_id",
        F.col("signature_detected").alias("signature_present"),
        "signature_missing",
        F.col("stamp_detected").alias("stamp_present"),
        "stamp_missing",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in names],
    )
