"""Page texts of files: joining, routing and basic measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier import vocab
from dossier.functions.lit import WHITE_SPACE, blank, strip


def assemble_text(pages: DataFrame) -> DataFrame:
    """Text of each file in page order with a numbered separator before every later page.

    The result is one value per file, so a file's text has to fit in a row.
    """
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    before, after = vocab.PAGE_SEPARATOR
    joined = F.transform(
        F.col("_pages"),
        lambda p, i: F.when(i == 0, p["text"]).otherwise(
            F.concat(F.lit(before), (i + 1).cast("string"), F.lit(after), p["text"])
        ),
    )
    return (
        pages.groupBy("file_id")
        .agg(ordered.alias("_pages"))
        .select("file_id", F.array_join(joined, "").alias("text"), F.size("_pages").alias("page_count"))
    )


def route_text_source(pages: DataFrame, files: DataFrame) -> DataFrame:
    """DIGITAL_PDF when a PDF holds enough selectable text per page, else SCANNED_PDF;
    other formats are IMAGE.

    The text between the first and last visible character is measured without joining
    the pages. ``files``: file_id, extension.
    """
    visible = ~blank(F.col("text"))
    size = F.length("text")
    ends = pages.groupBy("file_id").agg(
        F.min(F.when(visible, F.col("page_no"))).alias("_first"),
        F.max(F.when(visible, F.col("page_no"))).alias("_last"),
    )
    lead = size - F.length(F.ltrim("text", F.lit(WHITE_SPACE)))
    trail = size - F.length(F.rtrim("text", F.lit(WHITE_SPACE)))
    inside = F.col("page_no").between(F.col("_first"), F.col("_last"))
    measured = pages.join(ends, "file_id").groupBy("file_id").agg(
        F.count(F.lit(1)).alias("page_count"),
        F.sum(
            F.when(inside, size).otherwise(0)
            - F.when(F.col("page_no") == F.col("_first"), lead).otherwise(0)
            - F.when(F.col("page_no") == F.col("_last"), trail).otherwise(0)
        ).alias("text_length"),
    )
    per_page = F.col("text_length") / F.greatest(F.col("page_count"), F.lit(1))
    return files.join(measured, "file_id", "left").select(
        "file_id",
        F.when(F.col("extension") != ".pdf", "IMAGE")
        .when(F.coalesce(per_page, F.lit(0.0)) >= vocab.MIN_DIGITAL_CHARS_PER_PAGE, "DIGITAL_PDF")
        .otherwise("SCANNED_PDF")
        .alias("source"),
        F.coalesce("page_count", F.lit(0)).alias("page_count"),
        F.coalesce("text_length", F.lit(0)).alias("text_length"),
    )


def flag_empty_text(ocr: DataFrame) -> DataFrame:
    """Documents with whether any visible text was read."""
    empty = blank(F.col("raw_ocr_text"))
    return ocr.select("document_id", empty.alias("is_empty"))


def text_source_metrics(pages: DataFrame) -> DataFrame:
    """Characters, pages and mean reading confidence per file.

    ``pages``: file_id, page_no, text, confidence.
    """
    return pages.groupBy("file_id").agg(
        F.sum(F.length("text")).alias("character_count"),
        F.count(F.lit(1)).alias("page_count"),
        F.avg("confidence").alias("overall_confidence"),
        F.count_if(strip(F.col("text")) == "").alias("empty_pages"),
    )
