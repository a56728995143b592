"""Hand-built values with the expected outcome."""

import pytest
from pyspark.sql import functions as F

from dossier.functions import dates, reading, scores, shapes
from dossier.functions import text as T
from dossier.operators.normalize import normalize_fields


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    "field,value,expected",
    [
        ("iban", "gb82 west 1234 5698 7654 32", "GB82WEST12345698765432"),
        ("iban", "xx", None),
        ("account_number", "00-12 345.6", "00123456"),
        ("document_number", "3520212345671", "35202-1234567-1"),
        ("document_number", " ab  c ", "ab c"),
        ("bank_name", "hbl", "HABIB BANK LIMITED"),
        ("issue_date", "01/13/2024", "2024-01-13"),
        ("issue_date", "3/2/2024", "2024-02-03"),
        ("issue_date", "2024-13-45", "2024-13-45"),
        ("issue_date", "13 foo", None),
        ("issue_date", "Mar 5, 2023", "2023-03-05"),
        ("statement_period", "{'start': '2024-01-01', 'end': '2024-02-01'}", "2024-01-01 - 2024-02-01"),
        ("statement_period", "01/02/2024 to 03/04/2024", "2024-02-01 - 2024-04-03"),
        ("statement_period", "2024-13-45 - 2024-01-01", None),
        ("salary_month", "Sep 2023", "2023-09"),
        ("salary_month", "13/2023", None),
        ("branch", "H.O BR", "Head Office Branch"),
        ("branch", "m. town", "Model Town"),
        ("account_holder", "ﬁne　name​", "FINE NAME"),
        ("subject", "a\tb\n c\x00", "a b c"),
    ],
)
def test_normalizers(spark, field, value, expected):
    schema = (
        "application_id long, document_id long, ocr_result_id long, field_name string, extracted_value string,"
        " normalized_value string, human_corrected_value string, verification_status string"
    )
    row = normalize_fields(
        spark.createDataFrame([(1, 1, 1, field, value, "old", None, None)], schema)
    ).first()
    assert row.normalized_value == expected
    assert row.outcome == ("NORMALIZED" if expected is not None else "FAILED")
    assert row.stored_value == (expected if expected is not None else "old")


def test_correction_wins_and_unverified_is_skipped(spark):
    schema = (
        "application_id long, document_id long, ocr_result_id long, field_name string, extracted_value string,"
        " normalized_value string, human_corrected_value string, verification_status string"
    )
    rows = [
        (1, 1, 1, "iban", "xx", None, "GB82WEST12345698765432", None),
        (1, 2, 2, "iban", "GB82WEST12345698765432", None, None, "PENDING_REVIEW"),
        (1, 3, 3, "iban", "   ", None, None, None),
    ]
    out = {r.document_id: r for r in normalize_fields(spark.createDataFrame(rows, schema)).collect()}
    assert out[1].outcome == "NORMALIZED"
    assert (out[2].outcome, out[2].reason) == ("SKIPPED", "not verified: PENDING_REVIEW")
    assert (out[3].outcome, out[3].reason) == ("SKIPPED", "empty value")


@pytest.mark.parametrize(
    "raw,expected",
    [
        ("1,250.50", 1250.5),
        ("1.250,50", 1250.5),
        ("1,250", 1250.0),
        ("12,5", 12.5),
        ("€ 7", 7.0),
        ("..", None),
    ],
)
def test_amounts(spark, raw, expected):
    assert one(spark, reading.parse_amount, raw) == expected


def test_large_amount_text(spark):
    assert one(spark, reading.amount, "12,345,678.5") == "12345678.5"
    assert one(spark, reading.amount, "99999999") == "99999999.0"


def test_iban_checksum(spark):
    assert one(spark, shapes.iban_mod97, "GB82WEST12345698765432") == 1
    assert one(spark, shapes.iban_mod97, "GB83WEST12345698765432") != 1


def test_period_is_cut_at_the_first_hyphen(spark):
    assert one(spark, reading.period, "01/02/2023 - 31/03/2023") == "2023-02-01 - 2023-03-31"
    assert one(spark, reading.period, "2023-02-01 to 2023-03-31") is None


def test_certificate_date(spark):
    text = "Bank\nDated: 5 March, 2024\nThis is to certify on 01-01-2020"
    assert one(spark, reading.certificate_date, text) == "2024-03-05"
    assert one(spark, reading.certificate_date, "certify 01-01-2020") is None


def test_dates_reject_impossible_days(spark):
    assert one(spark, dates.parse_date, "31/02/2024") is None
    assert str(one(spark, dates.parse_date, "29 February 2024")) == "2024-02-29"


def test_blend_and_source(spark):
    frame = spark.createDataFrame([(1.0, 0.5, None)], "a double, b double, c double")
    sources = {"regex": F.col("a"), "template": F.col("b"), "ocr": F.col("c"), "ai": F.lit(None).cast("double")}
    row = frame.select(
        scores.blend_confidence(sources).alias("s"), scores.dominant_source(sources).alias("n")
    ).first()
    assert row.s == pytest.approx(0.65 / 0.8)
    assert row.n == "regex"


def test_quoted(spark):
    assert one(spark, T.quoted, "it's") == '"it\'s"'
    assert one(spark, T.quoted, "a\tb") == "'a\\tb'"
