"""Date texts to ISO dates. Each text is matched against its shape once and cast once,
which is much cheaper than trying one date format after another."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier import vocab
from dossier.functions.lit import let, lookup

_MONTH_NUMBERS = {m: f"{i:02d}" for i, m in enumerate(vocab.MONTHS, 1)} | {
    m[:3]: f"{i:02d}" for i, m in enumerate(vocab.MONTHS, 1)
}

# Shapes of a date text; the letters name what its three parts are (N = month name).
_SHAPES = {
    "YMD": r"^\d{4}([-/])\d{1,2}\1\d{1,2}$",
    "DMY": r"^\d{1,2}([-/])\d{1,2}\1\d{4}$",
    "DMY.": r"^\d{1,2}\.\d{1,2}\.\d{4}$",
    "DNY": r"^\d{1,2} [A-Za-z]+ \d{4}$",
    "DNY,": r"^\d{1,2} [A-Za-z]+, \d{4}$",
    "DNY-": r"^\d{1,2}-[A-Za-z]+-\d{4}$",
    "NDY": r"^[A-Za-z]+ \d{1,2},? \d{4}$",
    "DMY of": r"^\d{1,2}\s+day\s+of\s+\d{1,2},\s*\d{4}",
}
_SEPARATORS = r"[-/., ]+"


def month_number(name: Column) -> Column:
    """Two-digit month of an English month name or its three-letter form."""
    return lookup(F.lower(name), _MONTH_NUMBERS)


def valid_iso(text: Column) -> Column:
    """The date of a strict yyyy-MM-dd text; null for anything else."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))


def _parse(text: Column, shapes: tuple[str, ...], month_first: bool = False) -> Column:
    """Date of a text in one of ``shapes``.

    The text is split once; each part is picked by shape and the ISO text built from
    them is cast once, or twice where ``month_first`` is the second reading of a
    slashed date.
    """
    parts = F.split(text, _SEPARATORS)
    is_shape = {s: text.rlike(_SHAPES[s]) for s in shapes}

    def pick(letters: dict[str, Column]) -> Column:
        arms = None
        for name, test in is_shape.items():
            spot = next(i for i, c in enumerate(name[:3]) if c in letters)
            value = letters[name[spot]](F.get(parts, spot))
            arms = F.when(test, value) if arms is None else arms.when(test, value)
        return arms

    def two(c: Column) -> Column:
        return F.lpad(c, 2, "0")

    year = pick({"Y": lambda c: c})
    month = pick({"M": two, "N": month_number})
    day = pick({"D": two})
    parsed = F.concat(year, F.lit("-"), month, F.lit("-"), day).try_cast("date")
    if month_first:
        swapped = F.concat(year, F.lit("-"), day, F.lit("-"), month).try_cast("date")
        parsed = F.coalesce(parsed, F.when(text.rlike(r"^\d{1,2}/\d{1,2}/"), swapped))
    return F.when(year != "0000", parsed)


def parse_date(text: Column) -> Column:
    """Date of cleaned text in any of the thirteen stored forms, else null; the day comes
    first where both readings are possible."""
    return _parse(text, ("YMD", "DMY", "DNY", "DNY,", "NDY"), month_first=True)


def parse_document_date(text: Column) -> Column:
    """Forms read from document text."""
    return _parse(text, ("YMD", "DMY", "DNY", "DNY-"), month_first=True)


def parse_dotted_date(text: Column) -> Column:
    return _parse(text, ("DMY.",))


def parse_day_of_month(text: Column) -> Column:
    """'11 day of 5, 2026' as used in agreement preambles."""
    spaced = F.regexp_replace(
        text, r"^(\d{1,2})\s+day\s+of\s+(\d{1,2}),\s*(\d{4}).*$", "$1-$2-$3"
    )
    parsed = let(spaced, lambda v: _parse(v, ("DMY",)))
    return F.when(text.rlike(_SHAPES["DMY of"]), parsed)


def parse_certificate_date(text: Column) -> Column:
    """Forms of an issue date on a certificate; ``text`` has single spaces only."""
    return _parse(text, ("DMY", "DMY.", "NDY", "DNY,", "DNY"))


def parse_salary_month(text: Column) -> Column:
    """yyyy-MM of a month text; a yyyy-MM shaped text is kept unchecked."""
    numeric_first = r"^(\d{4})[-/](\d{1,2})$"
    numeric_last = r"^(\d{1,2})/(\d{4})$"
    named = r"^([A-Za-z]+)[ -](\d{4})$"
    month = (
        F.when(text.rlike(numeric_first), F.lpad(F.regexp_extract(text, numeric_first, 2), 2, "0"))
        .when(text.rlike(numeric_last), F.lpad(F.regexp_extract(text, numeric_last, 1), 2, "0"))
        .when(text.rlike(named), month_number(F.regexp_extract(text, named, 1)))
    )
    year = F.when(text.rlike(numeric_first), F.substring(text, 1, 4)).otherwise(
        F.right(text, F.lit(4))
    )
    ok = month.between("01", "12") & (year != "0000")
    return F.when(text.rlike(r"^\d{4}-\d{2}$"), text).when(ok, F.concat_ws("-", year, month))
