"""Field validation, cross-field consistency and the analysis score, all within a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier import vocab
from dossier.functions import shapes
from dossier.functions.dates import valid_iso
from dossier.functions.lit import blank
from dossier.functions.timing import moment
from dossier.operators import extract
from dossier.operators.normalize import outcome_tally
from dossier.session import stored

_VALIDATION = "array<struct<field:string,validator:string,status:string,message:string>>"
_CONSISTENCY = "array<struct<rule_id:string,rule_name:string,status:string,message:string>>"


def _field(name: str) -> Column:
    return F.try_element_at("extracted_fields", F.lit(name))


def _per_type(made: dict[str, Column], empty: str) -> Column:
    result = None
    for kind, value in made.items():
        arm = F.col("document_type") == kind
        result = F.when(arm, value) if result is None else result.when(arm, value)
    return result.otherwise(F.array().cast(empty))


def validate_fields(found: DataFrame, as_of: str) -> DataFrame:
    """Add ``validation_results``: one entry per expected field, by field name."""
    today = moment(as_of).cast("date")
    made = {}
    for kind, names in vocab.EXPECTED_FIELDS.items():
        cells = []
        for name in sorted(names):
            value = _field(name)
            validator = vocab.FIELD_VALIDATORS.get(kind, {}).get(name, "required")
            verdict = shapes.VALIDATORS[validator](value, today)
            absent = value.isNull()
            cells.append(
                F.struct(
                    F.lit(name).alias("field"),
                    F.when(absent, "required").otherwise(validator).alias("validator"),
                    F.when(absent, "missing").otherwise(verdict["status"]).alias("status"),
                    F.when(absent, f"{vocab.field_label(name)} missing")
                    .otherwise(verdict["message"])
                    .alias("message"),
                )
            )
        made[kind] = F.array(*cells)
    return found.withColumn("validation_results", _per_type(made, _VALIDATION))


def _check(rule_id: str, name: str, *arms: tuple[Column, str, Column | str]) -> Column:
    """Consistency row from (test, status, message) arms; the last arm always holds."""
    status = message = None
    for test, value, text in arms:
        text = F.lit(text) if isinstance(text, str) else text
        status = F.when(test, value) if status is None else status.when(test, value)
        message = F.when(test, text) if message is None else message.when(test, text)
    return F.struct(
        F.lit(rule_id).alias("rule_id"),
        F.lit(name).alias("rule_name"),
        status.alias("status"),
        message.alias("message"),
    )


def _statement_checks() -> list[Column]:
    period = _field("statement_period")
    start = valid_iso(F.substring_index(period, " - ", 1))
    end = valid_iso(F.substring_index(period, " - ", -1))
    opening, closing = (_field(n).try_cast("double") for n in ("opening_balance", "closing_balance"))
    credits, debits = (_field(n).try_cast("double") for n in ("total_credits", "total_debits"))
    count = _field("transaction_count").try_cast("int")
    pair = opening.isNotNull() & closing.isNotNull()
    whole = pair & credits.isNotNull() & debits.isNotNull()
    still = F.coalesce(pair & (count == 0), F.lit(False))
    eps = vocab.BALANCE_EPSILON
    always = F.lit(True)
    return [
        _check(
            "STMT_PERIOD_VALID",
            "Statement period is valid",
            (period.isNull(), "not_applicable", "Statement period not available"),
            (
                start.isNull() | end.isNull(),
                "fail",
                "Statement period dates could not be parsed",
            ),
            (start > end, "fail", "Statement period starts after it ends"),
            (always, "pass", "Statement period start is before its end"),
        ),
        _check(
            "OPENING_LE_CLOSING",
            "Opening balance not above closing",
            (~pair, "not_applicable", "Opening or closing balance not available"),
            (
                opening > closing + eps,
                "warning",
                "Closing balance is below the opening balance; possible withdrawals",
            ),
            (always, "pass", "Opening balance is not above the closing balance"),
        ),
        _check(
            "CLOSING_MATCHES_TRANSACTIONS",
            "Closing balance matches transactions",
            (
                whole & (F.abs(closing - (opening + credits - debits)) <= eps),
                "pass",
                "Closing balance reconciles with credits and debits",
            ),
            (
                whole,
                "fail",
                "Closing balance does not reconcile with opening balance and transaction totals",
            ),
            (
                still & (F.abs(closing - opening) <= eps),
                "pass",
                "Closing balance unchanged with no transactions",
            ),
            (still, "fail", "Closing balance changed despite no transactions"),
            (always, "warning", "Exact reconciliation requires per-transaction line items"),
        ),
        _check(
            "BALANCES_NON_NEGATIVE",
            "Balances are non-negative",
            (~pair, "not_applicable", "Opening or closing balance not available"),
            ((opening < 0) | (closing < 0), "fail", "A balance is negative"),
            (always, "pass", "Opening and closing balances are non-negative"),
        ),
    ]


def _payslip_checks() -> list[Column]:
    gross, net = (_field(n).try_cast("double") for n in ("gross_salary", "net_salary"))
    paid, month = _field("payment_date"), _field("salary_month")
    day = valid_iso(paid)
    first = valid_iso(F.concat(month, F.lit("-01")))
    paid_month = F.trunc(day, "month")
    always = F.lit(True)
    return [
        _check(
            "NET_LE_GROSS",
            "Net salary does not exceed gross",
            (gross.isNull() | net.isNull(), "not_applicable", "Gross or net salary not available"),
            (net > gross + vocab.BALANCE_EPSILON, "fail", "Net salary exceeds gross salary"),
            (always, "pass", "Net salary is not above gross salary"),
        ),
        _check(
            "NET_POSITIVE",
            "Net salary is positive",
            (net.isNull(), "not_applicable", "Net salary not available"),
            (net < 0, "fail", "Net salary is negative"),
            (always, "pass", "Net salary is non-negative"),
        ),
        _check(
            "PAYMENT_WITHIN_MONTH",
            "Payment date within salary month",
            (
                paid.isNull() | month.isNull(),
                "not_applicable",
                "Payment date or salary month not available",
            ),
            (
                day.isNull(),
                "fail",
                "Payment date or salary month could not be parsed",
            ),
            (
                ~F.coalesce(
                    (paid_month == first) | (paid_month == F.add_months(first, 1)), F.lit(False)
                ),
                "fail",
                "Payment date is outside the salary month",
            ),
            (always, "pass", "Payment date falls within the salary month"),
        ),
    ]


def _identity_checks(today: Column) -> list[Column]:
    issue, expiry, birth = (_field(n) for n in ("issue_date", "expiry_date", "date_of_birth"))
    issued, expires, born = valid_iso(issue), valid_iso(expiry), valid_iso(birth)
    age = F.floor(F.months_between(today, born, False) / 12).cast("int")
    always = F.lit(True)
    return [
        _check(
            "EXPIRY_AFTER_ISSUE",
            "Expiry date after issue date",
            (issue.isNull(), "not_applicable", "Issue date not available"),
            (expiry.isNull(), "not_applicable", "Expiry date not available"),
            (
                issued.isNull() | expires.isNull(),
                "fail",
                "Issue or expiry date could not be parsed",
            ),
            (expires <= issued, "fail", "Expiry date is not after the issue date"),
            (always, "pass", "Expiry date is after the issue date"),
        ),
        _check(
            "AGE_REASONABLE",
            "Age is reasonable",
            (birth.isNull(), "not_applicable", "Date of birth not available"),
            (born.isNull(), "fail", "Date of birth could not be parsed"),
            (born > today, "fail", "Date of birth is in the future"),
            (age > 120, "fail", "Age exceeds 120 years"),
            (
                always,
                "pass",
                F.concat(F.lit("Age ("), age.cast("string"), F.lit(" years) is plausible")),
            ),
        ),
    ]


def _tax_checks() -> list[Column]:
    gross, tax = (_field(n).try_cast("double") for n in ("gross_income", "total_tax"))
    always = F.lit(True)
    return [
        _check(
            "GROSS_POSITIVE",
            "Gross income is positive",
            (gross.isNull(), "not_applicable", "Gross income not available"),
            (gross < 0, "fail", "Gross income is negative"),
            (always, "pass", "Gross income is non-negative"),
        ),
        _check(
            "TAX_NOT_EXCEEDING_GROSS",
            "Tax does not exceed gross income",
            (
                gross.isNull() | tax.isNull(),
                "not_applicable",
                "Gross income or total tax not available",
            ),
            (tax > gross + vocab.BALANCE_EPSILON, "fail", "Total tax exceeds gross income"),
            (always, "pass", "Total tax is within gross income"),
        ),
    ]


def consistency_checks(found: DataFrame, as_of: str) -> DataFrame:
    """Add ``consistency_results``: the cross-field checks of the document type."""
    made = {
        "BANK_STATEMENT": F.array(*_statement_checks()),
        "PAYSLIP": F.array(*_payslip_checks()),
        "ID_DOCUMENT": F.array(*_identity_checks(moment(as_of).cast("date"))),
        "TAX_DOCUMENT": F.array(*_tax_checks()),
    }
    return found.withColumn("consistency_results", _per_type(made, _CONSISTENCY))


def analysis_score(checked: DataFrame) -> DataFrame:
    """Add coverage, rates, blended score and verification status."""
    validations, consistency = F.col("validation_results"), F.col("consistency_results")
    critical_pairs = [
        x
        for t, names in vocab.ANALYSIS_CRITICAL_FIELDS.items()
        for x in (F.lit(t), F.array(*[F.lit(n) for n in names]))
    ]
    critical = F.coalesce(
        F.try_element_at(F.create_map(*critical_pairs), F.col("document_type")),
        F.array().cast("array<string>"),
    )

    def count(array: Column, test) -> Column:
        return F.size(F.filter(array, test))

    total = F.size(validations)
    applicable = count(consistency, lambda c: c["status"] != "not_applicable")
    rated = checked.select(
        *checked.columns,
        F.when(total > 0, count(validations, lambda v: v["status"] != "missing") / total)
        .otherwise(0.0)
        .alias("field_coverage"),
        F.when(total > 0, count(validations, lambda v: v["status"] == "valid") / total)
        .otherwise(1.0)
        .alias("validation_rate"),
        F.when(applicable > 0, count(consistency, lambda c: c["status"] == "pass") / applicable)
        .otherwise(1.0)
        .alias("consistency_rate"),
        (
            F.exists(
                validations,
                lambda v: (v["status"] != "valid") & F.array_contains(critical, v["field"]),
            )
            | F.exists(consistency, lambda c: c["status"] == "fail")
        ).alias("_held"),
    )
    w = vocab.SCORE_WEIGHTS
    blend = (
        F.lit(w[0]) * F.col("field_coverage")
        + F.lit(w[1]) * F.col("validation_rate")
        + F.lit(w[2]) * F.col("consistency_rate")
    )
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), blend))
    status = F.when(F.col("_held"), "NEEDS_REVIEW")
    for name, cut in vocab.SCORE_CUTOFFS:
        status = status.when(F.col("confidence_score") >= cut, name)
    return (
        rated.withColumn("confidence_score", score)
        .withColumn("verification_status", status.otherwise("FAILED"))
        .drop("_held")
    )


def issues() -> Column:
    """Messages of every entry that did not pass."""
    bad_fields = F.filter("validation_results", lambda v: v["status"] != "valid")
    bad_rules = F.filter("consistency_results", lambda c: c["status"] != "pass")
    return F.concat(
        F.transform(bad_fields, lambda v: v["message"]),
        F.transform(bad_rules, lambda c: c["message"]),
    )


def analyze_documents(
    texts: DataFrame, as_of: str, resolved: DataFrame | None = None
) -> DataFrame:
    """Route, extract, validate, complete, check and score every document text.

    ``texts``: document_id, stored_type, text and any columns to carry along.
    """
    routed = extract.route_document_type(texts)
    found = validate_fields(stored(extract.extract_fields(routed)), as_of)
    if resolved is not None:
        found = validate_fields(stored(extract.merge_fallback(found, resolved)), as_of)
    scored = analysis_score(consistency_checks(found, as_of))
    analysed = F.col("route").isin("STORED", "DETECTED")
    return scored.select(
        *[c for c in texts.columns if c not in ("text", "stored_type")],
        "document_type",
        "route",
        "extracted_fields",
        "validation_results",
        "consistency_results",
        F.when(analysed, F.col("confidence_score")).alias("confidence_score"),
        F.when(analysed, F.col("verification_status"))
        .otherwise("NEEDS_REVIEW")
        .alias("verification_status"),
        issues().alias("issues"),
    )


def analysis_outcomes(documents: DataFrame, texts: DataFrame, as_of: str) -> DataFrame:
    """What an analysis run makes of every document of an application: analysed, or failed
    where there is no text to analyse.

    ``documents``: document_id and application_id; ``texts`` as for :func:`analyze_documents`.
    """
    readable = texts.filter(~blank(F.col("text")))
    analysed = analyze_documents(readable, as_of).select("document_id", F.lit(True).alias("_analysed"))
    items = documents.select("document_id", "application_id").join(analysed, "document_id", "left")
    outcome = F.when(F.col("_analysed"), "ANALYZED").otherwise("FAILED")
    return outcome_tally(items.withColumn("outcome", outcome), "outcome", ("ANALYZED", "FAILED"))
