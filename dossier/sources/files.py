"""Uploaded files: format by first bytes and the verdict on each upload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier import vocab
from dossier.functions.lit import blank, lookup, strip


def sniffed_extension(content: Column) -> Column:
    """Extension of the first matching byte prefix, null when none matches."""
    head = F.hex(F.substring(content, 1, 16))
    found = None
    for prefix, extension in vocab.MAGIC_PREFIXES:
        arm = head.startswith(prefix)
        found = F.when(arm, extension) if found is None else found.when(arm, extension)
    return found


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """Files under ``path`` with name, size, content and sniffed extension."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(
        "path",
        F.substring_index("path", "/", -1).alias("filename"),
        "length",
        "content",
        sniffed_extension(F.col("content")).alias("sniffed"),
    )


def safe_filename(name: Column) -> Column:
    """Base name without unsafe characters; empty when nothing usable is left."""
    base = F.substring_index(
        F.regexp_replace(F.replace(name, F.lit("\\"), F.lit("/")), r"(?U)\s+$", ""), "/", -1
    )
    cleaned = strip(
        F.regexp_replace(F.regexp_replace(base, r"(?U)[^\w.\- ()]+", " "), r"(?U)\s+", " ")
    )
    usable = ~blank(name) & ~base.isin("", ".", "..")
    return F.when(usable, F.substring(cleaned, 1, vocab.MAX_FILENAME_LENGTH)).otherwise("")


def file_extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"^.*[^.].*(\.[^.]*)$", 1))


def admit_files(files: DataFrame) -> DataFrame:
    """First failing check of each upload, or its accepted extension.

    ``files``: file_id, filename, declared_type, content.
    """
    prepared = files.select(
        "file_id",
        safe_filename(F.col("filename")).alias("safe_name"),
        blank(F.col("filename")).alias("_nameless"),
        strip(F.lower(F.substring_index(F.coalesce("declared_type", F.lit("")), ";", 1))).alias(
            "declared"
        ),
        F.coalesce(F.octet_length("content"), F.lit(0)).alias("_size"),
        sniffed_extension(F.col("content")).alias("sniffed"),
    ).withColumn("extension", file_extension(F.col("safe_name")))
    extension, declared, sniffed = F.col("extension"), F.col("declared"), F.col("sniffed")
    expected = lookup(extension, vocab.MEDIA_TYPES)
    shown = F.when(extension == "", "<none>").otherwise(extension)
    error = (
        F.when(F.col("_nameless"), "The file has no filename")
        .when(F.col("safe_name") == "", "The file has no valid filename")
        .when(
            expected.isNull(),
            F.concat(F.lit("File extension "), shown, F.lit(" is not supported")),
        )
        .when(F.col("_size") == 0, "The uploaded file is empty")
        .when(
            sniffed.isNull(), "File content could not be recognised as a supported document type"
        )
        .when(
            sniffed != extension,
            F.concat(
                F.lit("File content ("),
                sniffed,
                F.lit(") does not match its extension ("),
                extension,
                F.lit(")"),
            ),
        )
        .when(declared.isin(*vocab.GENERIC_MEDIA_TYPES), F.lit(None))
        .when(
            ~declared.isin(*sorted(set(vocab.MEDIA_TYPES.values()))),
            F.concat(F.lit("Declared media type ("), declared, F.lit(") is not supported")),
        )
        .when(
            declared != expected,
            F.concat(
                F.lit("Declared media type ("), declared, F.lit(") does not match file content")
            ),
        )
    )
    return prepared.select(
        "file_id", "safe_name", "extension", "sniffed", error.alias("error"), error.isNull().alias("admitted")
    )
