"""Values read from document text, turned into canonical text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions.dates import (
    month_number,
    parse_certificate_date,
    parse_day_of_month,
    parse_document_date,
    parse_dotted_date,
)
from dossier.functions.lit import let, strip

#: Flags of every pattern: case-blind, line feed as the only line end, Unicode classes.
FLAGS = "(?idU)"
# Fixed values.
KNOWN_PLATFORMS = ("Digital Muhasil", "PayMin", "Paymere BCX", "Paymir")


def trim_marks(raw: Column) -> Column:
    """Without surrounding space and one layer of separators."""
    return strip(F.btrim(strip(raw), F.lit(":;|")))


def number_text(value: Column) -> Column:
    """Plain decimal text of a number, always with a decimal point."""

    def shown(v: Column) -> Column:
        exact = F.regexp_replace(v.try_cast("decimal(38,8)").cast("string"), r"0+$", "")
        wide = F.regexp_replace(exact, r"\.$", ".0")
        return F.when(F.abs(v) < 1e7, v.cast("string")).otherwise(wide)

    return let(value, shown)


def parse_amount(raw: Column) -> Column:
    """Number with either decimal style; a single comma before exactly three digits groups
    thousands."""

    def plain(bare: Column) -> Column:
        comma, dot = bare.contains(","), bare.contains(".")
        last_comma = F.length(F.substring_index(bare, ",", -1))
        last_dot = F.length(F.substring_index(bare, ".", -1))
        no_comma = F.replace(bare, F.lit(","), F.lit(""))
        comma_point = F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
        grouped = bare.rlike(r"^[^,]{1,3}(?:,[^,]{1,3})*,[^,]{3}$")
        return (
            F.when(comma & dot & (last_comma < last_dot), comma_point)
            .when(comma & dot, no_comma)
            .when(comma & grouped, no_comma)
            .when(comma, F.replace(bare, F.lit(","), F.lit(".")))
            .otherwise(bare)
        )

    bare = F.regexp_replace(
        F.replace(strip(raw), F.lit(" "), F.lit("")), r"^(?:EUR|USD|GBP|€|£|\$)", ""
    )
    return let(
        let(bare, plain),
        lambda p: F.when(p.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)$"), p.try_cast("double")),
    )


def amount(raw: Column) -> Column:
    return number_text(parse_amount(raw))


def whole_number(raw: Column) -> Column:
    digits = F.regexp_extract(raw, r"\d+", 0)
    return F.when(digits != "", F.regexp_replace(digits, r"^0+(?=\d)", ""))


def document_date(raw: Column) -> Column:
    return let(strip(raw), parse_document_date).cast("string")


def dotted_date(raw: Column) -> Column:
    return let(strip(raw), parse_dotted_date).cast("string")


def day_of_month(raw: Column) -> Column:
    return let(strip(raw), parse_day_of_month).cast("string")


def period(raw: Column) -> Column:
    """'start - end' cut at the first hyphen or 'to'."""
    pattern = FLAGS + r"(.+?)\s*(?:-|—|to)\s*(.+)"
    start = document_date(F.regexp_extract(raw, pattern, 1))
    end = document_date(F.regexp_extract(raw, pattern, 2))
    return F.concat(start, F.lit(" - "), end)


def salary_month(raw: Column) -> Column:
    numeric = r"(\d{4})[-/](\d{1,2})"
    named = r"([A-Za-z]+)\s+(\d{4})"
    month = month_number(F.regexp_extract(raw, named, 1))
    return F.when(
        raw.rlike(numeric),
        F.concat(
            F.regexp_extract(raw, numeric, 1),
            F.lit("-"),
            F.lpad(F.regexp_extract(raw, numeric, 2), 2, "0"),
        ),
    ).when(raw.rlike(named), F.concat(F.regexp_extract(raw, named, 2), F.lit("-"), month))


def single_line(raw: Column) -> Column:
    return strip(F.regexp_replace(raw, r"(?U)\s+", " "))


def last_reference(raw: Column) -> Column:
    """Last run of five or more letters and digits, else the text itself."""
    runs = F.regexp_extract_all(raw, F.lit(r"[A-Za-z0-9]{5,}"), F.lit(0))
    return F.coalesce(F.try_element_at(runs, F.lit(-1)), strip(raw))


def platform_name(raw: Column) -> Column:
    low = F.lower(raw)
    found = None
    for name in KNOWN_PLATFORMS:
        arm = low.contains(name.lower())
        found = F.when(arm, name) if found is None else found.when(arm, name)
    return found


def without_watermark(raw: Column) -> Column:
    return F.regexp_replace(
        F.regexp_replace(raw, r"(?i)\n\s*CS\s*\n\s*CamScanner\s*$", ""), r"(?U)\s+$", ""
    )


def certificate_date(text: Column) -> Column:
    """Issue date before the certifying clause: a labelled date first, else any date."""
    # Fixed values.
    token = (
        r"(?:\d{1,2}[-/.]\d{1,2}[-/.]\d{4}|\d{1,2}\s+[A-Za-z]{3,9},?\s+\d{4}"
        r"|[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{4})"
    )
    label = (
        r"(?:Date of Issue|Issue Date|Issued On|Issuance Date|Dated|Date)\s*[:\-]*\s*"
        rf"({token})"
    )
    clause = r"(?is)^(.*?)(?<!Maintenance )certif"
    before = F.regexp_extract(text, clause, 1)
    zone = F.when(text.rlike(r"(?i)(?<!Maintenance )certif"), before).otherwise(text)

    def found(z: Column) -> Column:
        labelled = F.nullif(F.regexp_extract(z, FLAGS + label, 1), F.lit(""))
        return F.coalesce(labelled, F.regexp_extract(z, rf"(?dU)\b({token})\b", 1))

    single = F.regexp_replace(strip(let(zone, found)), r"\s+", " ")
    return let(single, parse_certificate_date).cast("string")
