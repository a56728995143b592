"""Shape tests and field validators as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions.dates import valid_iso
from dossier.functions.lit import strip


def canonical_iban(v: Column) -> Column:
    return v.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9]{11,30}\z")


def canonical_cnic(v: Column) -> Column:
    return v.rlike(r"^\d{5}-\d{7}-\d\z")


def iso_date(v: Column) -> Column:
    return v.rlike(r"^\d{4}-\d{2}-\d{2}\z")


def iso_year_month(v: Column) -> Column:
    return v.rlike(r"^\d{4}-\d{2}\z")


def canonical_amount(v: Column) -> Column:
    return v.rlike(r"^(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d{1,2})?\z")


def rule_account_number(v: Column) -> Column:
    return v.rlike(r"^[A-Z0-9]{6,20}\z")


def e_stamp(v: Column) -> Column:
    return v.rlike(r"(?i)^STAMP-\d{6}\z")


def placeholder(v: Column) -> Column:
    return strip(F.upper(v)).rlike(r"^(NOT PROVIDED|N/A|NA|NONE|X+|UNKNOWN|TBD)\z")


def positive_integer(v: Column) -> Column:
    """Whole number above zero; surrounding spaces and a plus sign are fine."""
    shaped = v.rlike(r"(?U)^\s*[+]?\d+(_\d+)*\s*\z")
    return F.coalesce(shaped & v.rlike("[1-9]"), F.lit(False))


SHAPES = {
    "canonical_iban": canonical_iban,
    "canonical_cnic": canonical_cnic,
    "rule_account_number": rule_account_number,
    "canonical_amount": canonical_amount,
    "iso_date": iso_date,
    "e_stamp": e_stamp,
}


def iban_mod97(v: Column) -> Column:
    """Remainder of the ISO 13616 check (1 when right) of an IBAN without spaces."""
    turned = F.concat(F.substring(v, 5, 34), F.substring(v, 1, 4))
    start = F.lit(0).cast("int")

    def step(acc: Column, ch: Column) -> Column:
        letter = F.ascii(ch) - 55
        digit = F.ascii(ch) - 48
        return F.when(ch.rlike("[A-Z]"), (acc * 100 + letter) % 97).otherwise(
            (acc * 10 + digit) % 97
        ).cast("int")

    return F.aggregate(F.split(turned, ""), start, lambda a, c: F.when(c == "", a).otherwise(step(a, c)))


def _outcome(ok: Column, good: str, *bad: tuple[Column, str]) -> Column:
    """(status, message) struct; the first true ``bad`` test names the fault."""
    message = None
    for test, text in bad:
        message = F.when(test, text) if message is None else message.when(test, text)
    return F.struct(
        F.when(ok, "valid").otherwise("invalid").alias("status"),
        F.when(ok, good).otherwise(message).alias("message"),
    )


def _always() -> Column:
    return F.lit(True)


def _number(v: Column) -> Column:
    return v.try_cast("double")


def _amount(v: Column, today: Column) -> Column:
    ok = F.coalesce(_number(v) >= 0, F.lit(False))
    return _outcome(
        ok,
        "Amount is a valid non-negative number",
        (_always(), "Amount must be a non-negative number"),
    )


def _balance(v: Column, today: Column) -> Column:
    n = _number(v)
    return _outcome(
        F.coalesce(n >= 0, F.lit(False)),
        "Balance is a valid number",
        (n.isNull(), "Balance must be a number"),
        (_always(), "Balance is negative"),
    )


def _currency(v: Column, today: Column) -> Column:
    return _outcome(
        v.rlike(r"^[A-Z]{3}\z"),
        "Currency is a valid ISO 4217 code",
        (_always(), "Currency must be a three-letter ISO code"),
    )


def _iban(v: Column, today: Column) -> Column:
    bare = F.upper(F.replace(v, F.lit(" "), F.lit("")))
    shaped = canonical_iban(bare)
    # The checksum runs only on well-formed values.
    checked = F.coalesce(F.when(shaped, iban_mod97(bare)) == 1, F.lit(False))
    return _outcome(
        checked,
        "IBAN checksum passed",
        (~shaped, "IBAN has an invalid format"),
        (_always(), "IBAN checksum failed"),
    )


def _account_number(v: Column, today: Column) -> Column:
    digits = F.length(F.regexp_replace(v, r"[^0-9]", ""))
    return _outcome(
        digits.between(4, 30),
        "Account number is plausible",
        (_always(), "Account number length is not plausible"),
    )


def _document_number(v: Column, today: Column) -> Column:
    return _outcome(
        v.rlike(r"^[A-Za-z0-9\-]{4,20}\z"),
        "Document number format is valid",
        (_always(), "Document number format is invalid"),
    )


def _date(v: Column, today: Column) -> Column:
    return _outcome(
        valid_iso(v).isNotNull(), "Date is valid", (_always(), "Date format is invalid")
    )


def _date_not_future(v: Column, today: Column) -> Column:
    day = valid_iso(v)
    return _outcome(
        F.coalesce(day <= today, F.lit(False)),
        "Date is valid",
        (day.isNull(), "Date format is invalid"),
        (_always(), "Date is in the future"),
    )


def _period(v: Column, today: Column) -> Column:
    """Periods travel as 'start - end' text."""
    start = valid_iso(F.substring_index(v, " - ", 1))
    end = valid_iso(F.substring_index(v, " - ", -1))
    paired = v.contains(" - ")
    return _outcome(
        F.coalesce(paired & start.isNotNull() & end.isNotNull(), F.lit(False)),
        "Statement period dates are valid",
        (~paired, "Statement period must contain start and end dates"),
        (_always(), "Statement period dates are invalid"),
    )


def _salary_month(v: Column, today: Column) -> Column:
    return _outcome(
        v.rlike(r"^\d{4}-(0[1-9]|1[0-2])\z"),
        "Salary month is valid",
        (_always(), "Salary month format is invalid"),
    )


def _tax_year(v: Column, today: Column) -> Column:
    return _outcome(
        F.coalesce(v.try_cast("int").between(1900, 2100), F.lit(False)),
        "Tax year is plausible",
        (_always(), "Tax year is not plausible"),
    )


def _count(v: Column, today: Column) -> Column:
    return _outcome(
        F.coalesce(v.try_cast("int") >= 0, F.lit(False)),
        "Count is a non-negative integer",
        (_always(), "Count must be a non-negative integer"),
    )


def _required(v: Column, today: Column) -> Column:
    return _outcome(F.lit(True), "Field is present", (_always(), "Field is present"))


VALIDATORS = {
    "required": _required,
    "amount": _amount,
    "balance": _balance,
    "currency": _currency,
    "iban_checksum": _iban,
    "account_number": _account_number,
    "document_number": _document_number,
    "date": _date,
    "date_not_future": _date_not_future,
    "period": _period,
    "salary_month": _salary_month,
    "tax_year": _tax_year,
    "non_negative": _count,
}


def validate(name: Column, v: Column, today: Column) -> Column:
    """(status, message) of value ``v`` under the validator called ``name``."""
    result = None
    for key, fn in VALIDATORS.items():
        arm = name == key
        result = F.when(arm, fn(v, today)) if result is None else result.when(arm, fn(v, today))
    return result
