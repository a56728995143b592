"""Bulk files: classify pages, cut them into documents, note doubtful pages."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier import vocab
from dossier.functions.lit import lookup
from dossier.operators.completeness import assign_copy_numbers, completeness
from dossier.session import stored
from dossier.operators.ordered import range_chunk, with_previous_where, with_running_sum

_PUNCTUATION = r"[!-/:-@\[-`{-~ ]*"


def _any(phrases: Iterable[str]) -> str:
    """Alternation of literal phrases, earlier ones first."""
    return "|".join(re.escape(p).replace("\\'", "'") for p in phrases)


def lines_of(text: Column) -> Column:
    """Upper-case, non-empty lines of a page text with evenly spaced heights."""
    kept = F.filter(
        F.transform(F.split(text, "\n"), lambda x: F.upper(F.trim(x))), lambda x: x != ""
    )
    return F.transform(
        kept, lambda x, i: F.struct((i * 10.0).alias("y"), x.alias("text"))
    )


def classify_pages(pages: DataFrame) -> DataFrame:
    """Type, strength and matched phrase of every page, from its own row alone.

    ``pages``: file_id, page_no, page_height, lines (array of y, text in reading order,
    upper case). The first header line with a title decides: patterns are anchored at
    line starts and list their phrases in matching order, so one search gives that line.
    """
    in_header = F.filter(
        F.col("lines"),
        lambda x: ~((F.col("page_height") > 0) & (x["y"] >= F.col("page_height") * vocab.HEADER_ZONE)),
    )
    header = F.array_join(F.transform(in_header, lambda x: x["text"]), "\n")
    body = F.array_join(F.transform(F.col("lines"), lambda x: x["text"]), "\n")
    texts = pages.select("file_id", "page_no", header.alias("_header"), body.alias("_body")).select(
        "*", F.upper(F.replace("_body", F.lit("\n"), F.lit(" "))).alias("_full")
    )
    titles = [p for _, phrases in vocab.TITLE_PHRASES for p in phrases]
    type_of = {p: t for t, phrases in reversed(vocab.TITLE_PHRASES) for p in phrases}
    first_line = (
        rf"(?m)^(?:.*(?:{_any(vocab.CHECKLIST_MARKERS)}).*"
        rf"|(?:{_any(vocab.ID_CARD_PHRASES)})|(?:{_any(titles)}))"
    )
    full_page = rf"(?m)^(?:{_any(p for _, ps in vocab.FULL_PAGE_PHRASES for p in ps)})"
    full_type = {p: t for t, ps in vocab.FULL_PAGE_PHRASES for p in ps}
    found = texts.withColumn("_hit", F.regexp_extract("_header", first_line, 0)).withColumn(
        "_whole", F.regexp_extract("_body", full_page, 0)
    )
    hit, whole, full = F.col("_hit"), F.col("_whole"), F.col("_full")
    checklist = hit.rlike(_any(vocab.CHECKLIST_MARKERS))
    id_card = hit.isin(*vocab.ID_CARD_PHRASES)
    side = F.when(full.rlike(_any(vocab.ID_CARD_BACK_WORDS)), vocab.CNIC_BACK).otherwise(
        vocab.CNIC_FRONT
    )
    letterhead = F.col("_header").rlike(rf"(?m)^{_PUNCTUATION}{_any([vocab.LETTERHEAD_PREFIX])}")
    subject = F.col("_header").rlike(rf"(?m)^{_PUNCTUATION}{_any([vocab.SUBJECT_PREFIX])}")
    both_balances = full.contains(vocab.BALANCE_LABELS[0]) & full.contains(vocab.BALANCE_LABELS[1])
    onboarding = full.contains(vocab.SUBJECT_PREFIX) & full.rlike(_any(vocab.SUBJECT_KEYWORDS))
    compact = F.regexp_replace(full, r"\s+", "").contains(vocab.ONE_LINK_LABEL)
    strong_arms = [
        (id_card, side, F.lit(None).cast("string")),
        (hit != "", lookup(hit, type_of), hit),
        (letterhead & subject, F.lit(vocab.FORMAL_REQUEST), F.lit(None).cast("string")),
        (whole != "", lookup(whole, full_type), whole),
        (both_balances, F.lit(vocab.CERTIFICATE), F.lit(None).cast("string")),
        (onboarding, F.lit(vocab.FORMAL_REQUEST), F.lit(None).cast("string")),
        (full.contains(vocab.AUTHORITY_STATEMENT), F.lit(vocab.AUTHORITY), F.lit(None).cast("string")),
        (compact, F.lit(vocab.ONE_LINK), F.lit(None).cast("string")),
    ]
    nothing = F.lit(None).cast("string")
    kind = F.when(checklist, nothing)
    phrase = F.when(checklist, nothing)
    strong = F.when(checklist, False)
    for test, value, matched in strong_arms:
        kind, phrase, strong = kind.when(test, value), phrase.when(test, matched), strong.when(test, True)
    weak = None
    for t, phrases in vocab.TITLE_PHRASES:
        loose = [p for p in phrases if p not in vocab.NOT_WEAK_PHRASES]
        arm = full.rlike(_any(loose))
        weak = F.when(arm, t) if weak is None else weak.when(arm, t)
    for t, phrases in vocab.FULL_PAGE_PHRASES:
        weak = weak.when(full.rlike(_any(phrases)), t)
    weak = weak.when(full.rlike(_any(vocab.ID_CARD_PHRASES)), side)
    return found.select(
        "file_id",
        "page_no",
        kind.otherwise(weak).alias("detected_type"),
        strong.otherwise(False).alias("strong"),
        phrase.alias("phrase"),
    )


def segment_pages(classified: DataFrame) -> DataFrame:
    """Pages with the document they belong to.

    A strong page opens a document unless it repeats the continuation phrase of the last
    strong page; other pages join the open document; weak pages before any strong one
    form a document of their own.
    """
    keys, order, chunk = ["file_id"], ["page_no"], range_chunk("page_no")
    rows = with_previous_where(
        classified, keys, order, chunk, F.col("strong"), F.col("phrase"), "_last"
    )
    repeats = (
        F.col("phrase").isin(*vocab.CONTINUATION_PHRASES)
        & F.col("_last").isNotNull()
        & F.col("_last.value").eqNullSafe(F.col("phrase"))
    )
    opens = F.col("strong") & ~F.coalesce(repeats, F.lit(False))
    rows = rows.withColumn("_opens", opens)
    return with_running_sum(
        rows, keys, order, chunk, F.col("_opens").cast("int"), "island"
    ).drop("_last", "_opens")


def split_documents(segmented: DataFrame) -> DataFrame:
    """One row per document of each file: type, index from 0, first and last page."""
    islands = segmented.groupBy("file_id", "island").agg(
        F.min_by("detected_type", "page_no").alias("_type"),
        F.min("page_no").alias("first_page"),
        F.max("page_no").alias("last_page"),
        F.count(F.lit(1)).alias("pages"),
    )
    lowest = islands.groupBy("file_id").agg(F.min("island").alias("_base"))
    return islands.join(lowest, "file_id").select(
        "file_id",
        (F.col("island") - F.col("_base")).cast("int").alias("document_index"),
        F.coalesce("_type", F.lit(vocab.SUPPORTING)).alias("document_type"),
        "first_page",
        "last_page",
        "pages",
        "island",
    )


def absorption_warnings(segmented: DataFrame) -> DataFrame:
    """Weak pages whose own type differs from the document that took them in, one row and
    note per page (page numbers count from 0, notes from 1)."""
    documents = split_documents(segmented).select(
        "file_id", "island", "document_index", "document_type", "first_page"
    )
    doubtful = segmented.filter(~F.col("strong") & F.col("detected_type").isNotNull())
    return (
        doubtful.join(documents, ["file_id", "island"])
        .filter(
            (F.col("detected_type") != F.col("document_type"))
            & (F.col("page_no") > F.col("first_page"))
        )
        .select(
            "file_id",
            "document_index",
            "document_type",
            "page_no",
            F.col("detected_type").alias("weakly_matched_type"),
            F.concat(
                F.lit("page "),
                (F.col("page_no") + 1).cast("string"),
                F.lit(" weakly matches "),
                F.col("detected_type"),
            ).alias("note"),
        )
    )


def split_bulk_files(pages: DataFrame, documents: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """New document rows of the given bulk files and the status each application gets.

    ``file_id`` is the application; ``documents`` are the ones already stored
    (application_id, document_type, copy_number, processing_status).
    """
    # Segmenting reads the page verdicts in several branches; they are written once.
    segmented = segment_pages(stored(classify_pages(pages)))
    cut = split_documents(segmented).select(
        F.col("file_id").alias("application_id"),
        "document_type",
        F.col("document_index").cast("long").alias("document_id"),
        "first_page",
        "last_page",
        F.lit(as_of).cast("timestamp_ntz").alias("uploaded_at"),
    )
    numbered = assign_copy_numbers(cut, documents)
    held = documents.select("application_id", "document_type", "processing_status").unionByName(
        numbered.select(
            "application_id", "document_type", F.lit("UPLOADED").alias("processing_status")
        )
    )
    apps = cut.select("application_id").distinct()
    gate = completeness(apps, held).select(
        "application_id",
        "completeness_status",
        F.when(F.col("completeness_status") == "COMPLETE", "PROCESSING")
        .otherwise("NEEDS_DOCUMENTS")
        .alias("new_status"),
    )
    return numbered.withColumnRenamed("document_id", "document_index"), gate
