"""Fields from document text: routing, patterns, block values, externally resolved values.

Everything works inside one row. The texts are dealt out evenly once, before the first step, as
a row takes far longer to search than to read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier import vocab
from dossier.functions.lit import let, lookup, strip
from dossier.functions.reading import (
    FLAGS,
    certificate_date,
    single_line,
    trim_marks,
)
from dossier.operators import patterns as PT
from dossier.operators.accountlines import account_block
from dossier.session import spread, stored

_UNCLASSIFIED = (vocab.SUPPORTING, vocab.BULK)
_EXTRACTED_TYPES = tuple(PT.PATTERNS)


def detected_type(text: Column) -> Column:
    """Type with the highest keyword weight; ties go to the first, none is UNKNOWN."""
    low = F.lower(text)
    ranked = []
    for i, (kind, words) in enumerate(PT.DETECTION_KEYWORDS):
        score = sum((F.when(low.contains(w), n).otherwise(0) for w, n in words), F.lit(0))
        ranked.append(
            F.struct(score.alias("score"), F.lit(-i).alias("rank"), F.lit(kind).alias("kind"))
        )
    best = F.array_max(F.array(*ranked))
    return F.when(best["score"] > 0, best["kind"]).otherwise(vocab.UNKNOWN)


def detect_document_type(texts: DataFrame) -> DataFrame:
    return texts.select("document_id", detected_type(F.col("text")).alias("document_type"))


def route_document_type(texts: DataFrame) -> DataFrame:
    """Type to analyse each text as, and how it was found.

    ``texts``: document_id, stored_type, text. ``route`` is STORED, DETECTED,
    RECOGNIZED_UNSUPPORTED or UNDETERMINED.
    """
    texts = spread(texts, "document_id", "text")
    stored = F.when(~F.col("stored_type").isin(*_UNCLASSIFIED), F.col("stored_type"))
    checklist = [t for t in _EXTRACTED_TYPES if t in vocab.REQUIRED_TYPES]
    direct = F.coalesce(stored.isin(*checklist), F.lit(False))
    found = texts.withColumn("_found", F.when(~direct, detected_type(F.col("text"))))
    unknown = F.col("_found") == vocab.UNKNOWN
    route = (
        F.when(direct, "STORED")
        .when(~unknown, "DETECTED")
        .when(stored.isNotNull(), "RECOGNIZED_UNSUPPORTED")
        .otherwise("UNDETERMINED")
    )
    return found.select(
        *texts.columns,
        F.when(direct, stored)
        .when(~unknown, F.col("_found"))
        .otherwise(F.coalesce(stored, F.lit(vocab.UNKNOWN)))
        .alias("document_type"),
        route.alias("route"),
    )


def _raw(text: Column, pattern: str) -> Column:
    """Trimmed first group of the first match, null when blank or absent."""
    full = pattern if pattern.startswith("(?d") else FLAGS + pattern
    found = F.regexp_extract(text, full, 1)
    return F.nullif(trim_marks(found), F.lit(""))


def _office_name(text: Column, named: Column) -> Column:
    """Organisation of an authority letter: the named one, or the letterhead line that a
    general reference such as 'this directorate' stands for."""
    words = F.split(named, " ")
    pointing = F.lower(F.get(words, 0)).isin("this", "the", "said")
    anchor = F.when(F.size(words) == 1, named).when(pointing, F.try_element_at(words, F.lit(-1)))
    head = F.substring_index(text, "AUTHORITY LETTER", 1)
    lines = F.filter(
        F.transform(F.split(head, "\n"), strip),
        lambda x: (F.length(x) >= 8)
        & ~x.rlike(PT.LETTERHEAD_SKIP)
        & ~x.contains("@")
        & ~x.rlike(PT.OFFICE_TITLE),
    )
    word = F.concat(F.lit(r"(?i)\b\Q"), anchor, F.lit(r"\E\b"))

    def from_head(lines: Column) -> Column:
        anchored = F.get(F.filter(lines, lambda x: F.regexp_like(x, word)), 0)
        first, second = F.get(lines, 0), F.get(lines, 1)
        full = F.when(
            F.upper(first).endswith("ADMINISTRATION") & second.isNotNull(),
            F.concat(first, F.lit(" "), second),
        ).otherwise(first)
        return F.coalesce(F.when(anchor.isNotNull(), anchored), full)

    return F.when(named.rlike(PT.GENERIC_ORGANIZATION), let(lines, from_head)).otherwise(named)


def _fields_of(kind: str, text: Column) -> list[Column]:
    """(name, value) structs of the fields found in a text of ``kind``, null when absent."""
    cells = []
    for name, pattern, reader in PT.PATTERNS[kind]:
        raw = _raw(text, pattern)
        if kind == vocab.AUTHORITY and name == "organization_name":
            raw = let(single_line(raw), lambda v: _office_name(text, v))
        if kind == vocab.ONE_LINK and name == "organization_name":
            raw = F.coalesce(raw, _raw(text, PT.LEGACY_ORGANIZATION))

        def cell(v: Column, name: str = name, reader=reader) -> Column:
            value = v if reader is None else reader(v)
            made = F.struct(F.lit(name).alias("name"), value.alias("value"))
            return F.when(v.isNotNull(), made)

        cells.append(let(raw, _one(cell)))
    if kind == vocab.CERTIFICATE:
        cells.append(
            let(
                certificate_date(text),
                lambda v: F.when(
                    v.isNotNull(), F.struct(F.lit("issue_date").alias("name"), v.alias("value"))
                ),
            )
        )
    return cells


def _one(fn):
    """A lambda of exactly one argument around ``fn``."""
    return lambda v: fn(v)


def pattern_fields(routed: DataFrame) -> DataFrame:
    """Routed texts with ``extracted_fields``, a map of what the type's patterns found.

    A field that matched but could not be read stays in the map with a null value.
    """
    text, kind = F.col("text"), F.col("document_type")
    found = None
    for t in PT.PATTERNS:
        cells = F.array_compact(F.array(*_fields_of(t, text)))
        arm = kind == t
        found = F.when(arm, cells) if found is None else found.when(arm, cells)
    pairs = F.transform(
        F.coalesce(found, F.array().cast("array<struct<name:string,value:string>>")),
        lambda x: F.struct(x["name"], x["value"]),
    )
    return routed.withColumn("extracted_fields", F.map_from_entries(pairs))


def _without(fields: Column, others: Column) -> Column:
    """``fields`` less the names that ``others`` holds."""
    return F.map_filter(fields, lambda k, v: ~F.map_contains_key(others, k))


def with_block_values(found: DataFrame) -> DataFrame:
    """Add holder, number and IBAN from labelled lines, for the types that have them."""
    kind, own = F.col("document_type"), F.col("extracted_fields")
    has_block = kind.isin(*PT.BANK_BLOCK_TYPES)
    joined = found.withColumn("_block", F.when(has_block, account_block(F.col("text"))))
    merged = None
    for t, (names, replaces) in PT.BANK_BLOCK_TYPES.items():
        offered = F.map_from_entries(
            F.array_compact(
                F.array(
                    *[
                        F.when(
                            F.col("_block")[n].isNotNull()
                            & (F.lit(replaces) | ~F.map_contains_key(own, n)),
                            F.struct(F.lit(n).alias("name"), F.col("_block")[n].alias("value")),
                        )
                        for n in names
                    ]
                )
            )
        )
        value = F.map_concat(_without(own, offered), offered)
        arm = kind == t
        merged = F.when(arm, value) if merged is None else merged.when(arm, value)
    return joined.withColumn("extracted_fields", merged.otherwise(own)).drop("_block")


def extract_fields(routed: DataFrame) -> DataFrame:
    """Pattern fields plus block values, without the text: one scan of the texts.

    The results are written once (fields only, not the texts), so the later steps read
    small rows instead of searching the texts again.
    """
    return stored(with_block_values(pattern_fields(routed)).drop("text"))


def fields_needing_clarification(analysis: DataFrame) -> DataFrame:
    """Sorted names of expected fields that are missing or invalid, per document."""
    names = clarification_names(F.col("validation_results"))
    expected = lookup(
        F.col("document_type"), {t: len(f) for t, f in vocab.EXPECTED_FIELDS.items()}, F.lit(0)
    )
    return analysis.select(
        "document_id",
        "document_type",
        names.alias("field_names"),
        F.when(expected > 0, F.size(names) / expected).otherwise(0.0).alias("share_of_expected"),
    )


def clarification_names(validations: Column) -> Column:
    return F.array_sort(
        F.transform(F.filter(validations, lambda v: v["status"] != "valid"), lambda v: v["field"])
    )


def merge_fallback(analysis: DataFrame, resolved: DataFrame) -> DataFrame:
    """Fields completed from a table of resolved values (document_id, field_name, value).

    Only names that need clarification are taken, and only values that are not null; of
    several values for a name the first in order of text counts.
    A document has few names, so its resolved values fit in one map.
    """
    given = (
        resolved.filter(F.col("value").isNotNull())
        .groupBy("document_id", "field_name")
        .agg(F.min("value").alias("value"))
        .groupBy("document_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("field_name", "value"))).alias("_given"))
    )
    joined = analysis.join(given, "document_id", "left")
    wanted = clarification_names(F.col("validation_results"))
    taken = F.map_filter(
        F.coalesce("_given", F.create_map().cast("map<string,string>")),
        lambda k, v: F.array_contains(wanted, k),
    )
    joined = joined.withColumn("_taken", taken)
    completed = F.map_concat(_without(F.col("extracted_fields"), F.col("_taken")), F.col("_taken"))
    return joined.withColumn("extracted_fields", completed).drop(
        "_given", "_taken", "validation_results"
    )
