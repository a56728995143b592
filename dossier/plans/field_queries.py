"""Normalization, scoring and field review queries."""

from pyspark.sql import functions as F

from dossier import vocab
from dossier.functions import dates, shapes
from dossier.functions import text as T
from dossier.functions.scores import severity_of
from dossier.operators import confidence as C
from dossier.operators import normalize as N
from dossier.plans.catalog import AS_OF, query
from dossier.sources.bindings import _values

_DATE_FORMATS = "['%Y-%m-%d', '%d/%m/%Y', '%m/%d/%Y', '%Y/%m/%d', '%d-%m-%Y', '%d %b %Y', '%d %B %Y', '%b %d %Y', '%B %d %Y', '%d %b, %Y', '%d %B, %Y', '%b %d, %Y', '%B %d, %Y']"
_MONTH_FORMATS = "['%Y-%m', '%m/%Y', '%Y/%m', '%b %Y', '%B %Y', '%b-%Y', '%B-%Y']"
_NORMALIZER = "CASE field_name " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in vocab.FIELD_NORMALIZERS.items()
) + " ELSE 'general_text' END"
_BANKS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in vocab.BANK_ALIASES.items()) + "}"
_BRANCH = """CASE cl WHEN 'h.o br' THEN 'Head Office Branch' WHEN 'M. Town brnch' THEN 'Model Town Branch' WHEN 'KHI main' THEN 'Karachi Main'
 WHEN 'saddar b/o' THEN 'Saddar Branch Office' WHEN 'gujrawala cantt' THEN 'Gujranwala Cantt' ELSE cl END"""
_REPR = "'''' || replace(replace(replace({0}, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'), chr(9), chr(92) || 't') || ''''"
_NORMALIZED = rf"""src AS (SELECT *, coalesce(nullif(human_corrected_value, ''), extracted_value, '') AS source_value, {_NORMALIZER} AS normalizer FROM e_fields),
cl AS (SELECT *, trim(regexp_replace(source_value, '\s+', ' ', 'g')) AS cl, regexp_split_to_array(trim(regexp_replace(source_value, '\s+', ' ', 'g')), '\s+(?:-|–|—|to)\s+') AS parts,
 trim(source_value, ' ' || chr(9) || chr(10)) = '' AS empty, coalesce(verification_status IN ('PENDING_REVIEW', 'CANNOT_VERIFY'), false) AS unverified FROM src),
val AS (SELECT *, CASE WHEN empty OR unverified THEN NULL ELSE CASE normalizer
 WHEN 'iban' THEN CASE WHEN regexp_full_match(upper(regexp_replace(source_value, '[\s\-]', '', 'g')), '[A-Z]{{2}}\d{{2}}[A-Z0-9]{{11,30}}') THEN upper(regexp_replace(source_value, '[\s\-]', '', 'g')) END
 WHEN 'account_number' THEN upper(regexp_replace(source_value, '[\s\-/.]', '', 'g'))
 WHEN 'cnic' THEN CASE WHEN regexp_full_match(regexp_replace(source_value, '[\s\-]', '', 'g'), '\d{{13}}') THEN
   regexp_replace(regexp_replace(source_value, '[\s\-]', '', 'g'), '(\d{{5}})(\d{{7}})(\d)', '\1-\2-\3') ELSE cl END
 WHEN 'bank_name' THEN coalesce({_BANKS}[upper(cl)], upper(cl))
 WHEN 'date' THEN CASE WHEN regexp_full_match(cl, '\d{{4}}-\d{{2}}-\d{{2}}') THEN cl ELSE strftime(try_strptime(cl, {_DATE_FORMATS}), '%Y-%m-%d') END
 WHEN 'statement_period' THEN CASE WHEN len(parts) = 2 THEN strftime(try_strptime(parts[1], {_DATE_FORMATS}), '%Y-%m-%d') || ' - ' || strftime(try_strptime(parts[2], {_DATE_FORMATS}), '%Y-%m-%d') END
 WHEN 'salary_month' THEN CASE WHEN regexp_full_match(cl, '\d{{4}}-\d{{2}}') THEN cl ELSE strftime(try_strptime(cl, {_MONTH_FORMATS}), '%Y-%m') END
 WHEN 'branch' THEN {_BRANCH} WHEN 'title' THEN upper(cl) WHEN 'vendor' THEN upper(cl) ELSE cl END END AS v FROM cl),
norm AS (SELECT application_id, document_id, ocr_result_id, field_name, source_value, normalizer,
 CASE WHEN empty OR unverified THEN 'SKIPPED' WHEN v IS NOT NULL THEN 'NORMALIZED' ELSE 'FAILED' END AS outcome, v AS normalized_value,
 CASE WHEN empty THEN 'empty value' WHEN unverified THEN 'not verified: ' || verification_status WHEN v IS NULL THEN CASE normalizer
  WHEN 'iban' THEN 'Invalid IBAN structure: ' || {_REPR.format("source_value")} WHEN 'date' THEN 'Could not parse date: ' || {_REPR.format("source_value")}
  WHEN 'salary_month' THEN 'Could not parse salary month: ' || {_REPR.format("source_value")}
  WHEN 'statement_period' THEN CASE WHEN len(parts) <> 2 THEN 'Could not parse statement period: ' || {_REPR.format("cl")}
   ELSE 'Could not parse statement period endpoint: ' || {_REPR.format(f"CASE WHEN try_strptime(parts[1], {_DATE_FORMATS}) IS NULL THEN parts[1] ELSE parts[2] END")} END END END AS reason,
 CASE WHEN NOT (empty OR unverified) AND v IS NOT NULL THEN v ELSE normalized_value END AS stored_value, '1.0.0' AS normalization_version FROM val)"""


@query("normalize_fields", f"WITH {_NORMALIZED} SELECT * FROM norm")
def normalize_fields(t):
    return N.normalize_fields(t.fields)


@query(
    "normalization_tally",
    f"""WITH {_NORMALIZED} SELECT application_id, count(*) AS total, count(*) FILTER (WHERE outcome = 'NORMALIZED') AS normalized,
 count(*) FILTER (WHERE outcome = 'SKIPPED') AS skipped, count(*) FILTER (WHERE outcome = 'FAILED') AS failed FROM norm GROUP BY 1""",
)
def normalization_tally(t):
    return N.normalization_tally(N.normalize_fields(t.fields))


@query(
    "processing_tally",
    """SELECT application_id, count(*) AS total, count(*) FILTER (WHERE processing_status = 'COMPLETED') AS completed,
 count(*) FILTER (WHERE processing_status = 'PENDING') AS pending, count(*) FILTER (WHERE processing_status = 'FAILED') AS failed FROM e_documents GROUP BY 1""",
)
def processing_tally(t):
    return N.outcome_tally(
        t.entity("documents"), "processing_status", ("COMPLETED", "PENDING", "FAILED")
    )


@query(
    "normalized_fields",
    """SELECT f.ocr_result_id, f.field_name, f.extracted_value, f.normalized_value, f.verification_status, coalesce(o.document_id, 0) AS document_id,
 coalesce(d.original_filename, 'unknown') AS file_name FROM e_fields f LEFT JOIN e_ocr o ON o.ocr_result_id = f.ocr_result_id LEFT JOIN e_documents d ON d.document_id = o.document_id""",
)
def normalized_fields(t):
    return N.normalized_fields(t.fields, t.ocr, t.entity("documents"))


# Scalar functions over whole columns.


def _over_fields(t, names, **cols):
    rows = t.fields.filter(F.col("field_name").isin(*names)) if names else t.fields
    return rows.select("document_id", "field_name", *[c.alias(n) for n, c in cols.items()])


def _names(names):
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


@query(
    "clean_text",
    r"""SELECT document_id, field_name, trim(regexp_replace(extracted_value, '\s+', ' ', 'g')) AS general,
 upper(trim(regexp_replace(extracted_value, '\s+', ' ', 'g'))) AS title FROM e_fields""",
)
def clean_text(t):
    cleaned = T.clean_text(F.col("extracted_value"))
    rows = t.fields.select("document_id", "field_name", cleaned.alias("general"))
    return rows.withColumn("title", F.upper("general"))


_CLEANED = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Other spellings that the canonical form undoes: letter and accent apart, a ligature, a space
#: that does not break.
_SPELT = (("é", "e\u0301"), ("ü", "u\u0308"), ("ñ", "n\u0303"), ("fi", "\ufb01"), (" ", "\u00a0"))


@query("clean_document_text", f"SELECT doc_id, {_CLEANED} AS text, {_CLEANED} AS respelt FROM documents")
def clean_document_text(t):
    """Whole document prose in four languages, as given and spelt in other code points."""
    wide = "".join(chr(ord(c) + 0xFEE0) for c in _CAPITALS)
    other = F.translate("text", _CAPITALS, wide)
    for plain, spelt in _SPELT:
        other = F.replace(other, F.lit(plain), F.lit(spelt))
    return t.source("documents").select(
        "doc_id", T.clean_text(F.col("text")).alias("text"), T.clean_text(other).alias("respelt")
    )


@query(
    "parsed_dates",
    f"""SELECT document_id, field_name, CAST(try_strptime(trim(extracted_value), {_DATE_FORMATS}) AS DATE) AS parsed FROM e_fields
WHERE field_name IN {_names(("issue_date", "expiry_date", "payment_date", "date_of_birth", "effective_date"))}""",
)
def parsed_dates(t):
    names = ("issue_date", "expiry_date", "payment_date", "date_of_birth", "effective_date")
    return _over_fields(t, names, parsed=dates.parse_date(F.col("extracted_value")))


_SHAPES_SQL = r"""regexp_full_match(v, '[A-Z]{2}\d{2}[A-Z0-9]{11,30}') AS iban, regexp_full_match(v, '\d{5}-\d{7}-\d') AS cnic, regexp_full_match(v, '\d{4}-\d{2}-\d{2}') AS iso_date,
 regexp_full_match(v, '\d{4}-\d{2}') AS iso_month, regexp_full_match(v, '(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d{1,2})?') AS amount, regexp_full_match(v, '[A-Z0-9]{6,20}') AS account_number,
 regexp_full_match(v, '(?i)STAMP-\d{6}') AS e_stamp, regexp_full_match(upper(trim(v)), 'NOT PROVIDED|N/A|NA|NONE|X+|UNKNOWN|TBD') AS placeholder,
 coalesce(TRY_CAST(CASE WHEN regexp_full_match(trim(v), '\+?\d+') THEN trim(v) END AS BIGINT), 0) > 0 AS positive_integer"""


@query(
    "value_shapes",
    f"SELECT document_id, field_name, {_SHAPES_SQL} FROM (SELECT document_id, field_name, normalized_value AS v FROM e_fields WHERE normalized_value IS NOT NULL) x",
)
def value_shapes(t):
    v = F.col("normalized_value")
    rows = t.fields.filter(v.isNotNull())
    return rows.select(
        "document_id",
        "field_name",
        shapes.canonical_iban(v).alias("iban"),
        shapes.canonical_cnic(v).alias("cnic"),
        shapes.iso_date(v).alias("iso_date"),
        shapes.iso_year_month(v).alias("iso_month"),
        shapes.canonical_amount(v).alias("amount"),
        shapes.rule_account_number(v).alias("account_number"),
        shapes.e_stamp(v).alias("e_stamp"),
        shapes.placeholder(v).alias("placeholder"),
        shapes.positive_integer(v).alias("positive_integer"),
    )


#: IBANs with right check digits (98 minus the remainder) except for every fourth order.
@query(
    "iban_checksums",
    """WITH i AS (SELECT * FROM (SELECT o_orderkey AS id, 'PK' || lpad(CAST(CAST(CASE WHEN o_orderkey % 4 = 0 THEN 11 ELSE 98 - CAST('25281121' || lpad(CAST(o_custkey * 31 + o_orderkey AS VARCHAR), 16, '0') || '252000' AS HUGEINT) % 97 END AS INT) AS VARCHAR), 2, '0')
 || 'PSBL' || lpad(CAST(o_custkey * 31 + o_orderkey AS VARCHAR), 16, '0') AS iban FROM orders) x),
r AS (SELECT id, iban, CAST('25281121' || substr(iban, 9) || '2520' || substr(iban, 3, 2) AS HUGEINT) % 97 AS m FROM i)
SELECT id, iban, CAST(m AS INT) AS remainder, CASE WHEN m = 1 THEN 'valid' ELSE 'invalid' END AS status FROM r""",
)
def iban_checksums(t):
    serial = "lpad(cast(o_custkey * 31 + o_orderkey as string), 16, '0')"
    number = f"cast('25281121' || {serial} || '252000' as decimal(38, 0))"
    digits = f"CASE WHEN o_orderkey % 4 = 0 THEN 11 ELSE 98 - cast({number} % 97 as int) END"
    rows = t.source("orders").selectExpr(
        "o_orderkey AS id",
        f"'PK' || lpad(cast({digits} as string), 2, '0') || 'PSBL' || {serial} AS iban",
    )
    verdict = shapes.validate(F.lit("iban_checksum"), F.col("iban"), F.lit(AS_OF).cast("date"))
    return rows.select(
        "id", "iban", shapes.iban_mod97(F.col("iban")).alias("remainder"), verdict["status"].alias("status")
    )


_VALIDATE = rf"""CASE x.validator
 WHEN 'amount' THEN CASE WHEN TRY_CAST(v AS DOUBLE) >= 0 THEN 'valid' ELSE 'invalid' END WHEN 'balance' THEN CASE WHEN TRY_CAST(v AS DOUBLE) >= 0 THEN 'valid' ELSE 'invalid' END
 WHEN 'currency' THEN CASE WHEN regexp_full_match(v, '[A-Z]{{3}}') THEN 'valid' ELSE 'invalid' END
 WHEN 'account_number' THEN CASE WHEN length(regexp_replace(v, '[^0-9]', '', 'g')) BETWEEN 4 AND 30 THEN 'valid' ELSE 'invalid' END
 WHEN 'document_number' THEN CASE WHEN regexp_full_match(v, '[A-Za-z0-9\-]{{4,20}}') THEN 'valid' ELSE 'invalid' END
 WHEN 'date' THEN CASE WHEN try_strptime(v, '%Y-%m-%d') IS NOT NULL THEN 'valid' ELSE 'invalid' END
 WHEN 'date_not_future' THEN CASE WHEN try_strptime(v, '%Y-%m-%d') <= TIMESTAMP '{AS_OF}' THEN 'valid' ELSE 'invalid' END
 WHEN 'period' THEN CASE WHEN contains(v, ' - ') AND try_strptime(split_part(v, ' - ', 1), '%Y-%m-%d') IS NOT NULL AND try_strptime(split_part(v, ' - ', 2), '%Y-%m-%d') IS NOT NULL THEN 'valid' ELSE 'invalid' END
 WHEN 'salary_month' THEN CASE WHEN regexp_full_match(v, '\d{{4}}-(0[1-9]|1[0-2])') THEN 'valid' ELSE 'invalid' END
 WHEN 'tax_year' THEN CASE WHEN TRY_CAST(CASE WHEN regexp_full_match(v, '[+-]?\d+') THEN v END AS INT) BETWEEN 1900 AND 2100 THEN 'valid' ELSE 'invalid' END
 WHEN 'non_negative' THEN CASE WHEN TRY_CAST(CASE WHEN regexp_full_match(v, '[+-]?\d+') THEN v END AS INT) >= 0 THEN 'valid' ELSE 'invalid' END ELSE 'valid' END"""
_PLAIN_VALIDATORS = [v for v in shapes.VALIDATORS if v != "iban_checksum"]


@query(
    "field_validators",
    f"""SELECT document_id, field_name, x.validator, {_VALIDATE} AS status FROM (SELECT document_id, field_name, normalized_value AS v, field_no FROM e_fields WHERE normalized_value IS NOT NULL) f
JOIN (VALUES {_values(enumerate(_PLAIN_VALIDATORS))}) AS x(no, validator) ON x.no = (f.field_no + f.document_id) % {len(_PLAIN_VALIDATORS)}""",
)
def field_validators(t):
    names = F.array(*[F.lit(v) for v in _PLAIN_VALIDATORS])
    which = (F.col("field_no") + F.col("document_id")) % len(_PLAIN_VALIDATORS)
    rows = t.fields.filter(F.col("normalized_value").isNotNull()).select(
        "document_id",
        "field_name",
        F.element_at(names, (which + 1).cast("int")).alias("validator"),
        "normalized_value",
    )
    today = F.lit(AS_OF).cast("timestamp_ntz").cast("date")
    verdict = shapes.validate(F.col("validator"), F.col("normalized_value"), today)
    return rows.select("document_id", "field_name", "validator", verdict["status"].alias("status"))


@query(
    "result_severity",
    """SELECT application_id, document_id, rule_id, status, CASE status WHEN 'FAIL' THEN 'ERROR' WHEN 'PASS' THEN 'INFO' ELSE 'WARNING' END AS severity FROM e_results""",
)
def result_severity(t):
    return t.results.select(
        "application_id", "document_id", "rule_id", "status", severity_of(F.col("status")).alias("severity")
    )


# Confidence.

_EXPECTED = _values((k, f) for k, fs in vocab.EXPECTED_FIELDS.items() for f in fs)
_SCORED = f"""exp(k, f) AS (VALUES {_EXPECTED}), expn AS (SELECT k, count(*) AS n FROM exp GROUP BY 1),
cov AS (SELECT d.document_id, CASE WHEN any_value(expn.n) IS NULL THEN 1.0 ELSE count(exp.f)::DOUBLE / any_value(expn.n) END AS coverage, count(exp.f) AS present_expected, any_value(d.document_type) AS document_type
 FROM e_fields d LEFT JOIN exp ON exp.k = d.document_type AND exp.f = d.field_name LEFT JOIN expn ON expn.k = d.document_type GROUP BY 1),
sc0 AS (SELECT f.application_id, f.document_id, o.ocr_result_id, f.document_type, f.field_name, f.extracted_value, o.overall_confidence AS oc, cov.coverage,
 CASE (f.document_id + f.field_no) % 4 WHEN 0 THEN 'invalid' WHEN 1 THEN 'valid' WHEN 2 THEN 'missing' END AS vs
 FROM e_fields f JOIN e_ocr o ON o.document_id = f.document_id JOIN cov ON cov.document_id = f.document_id WHERE f.extracted_value IS NOT NULL),
sc1 AS (SELECT *, CASE vs WHEN 'invalid' THEN 0.25 WHEN 'missing' THEN 0.0 ELSE 1.0 END AS rs FROM sc0),
sc AS (SELECT application_id, document_id, ocr_result_id, document_type, field_name, extracted_value,
 least(1.0, greatest(0.0, (0.5 * rs + 0.3 * coverage + CASE WHEN oc IS NULL THEN 0 ELSE 0.2 * oc END)::DOUBLE / (0.5 + 0.3 + CASE WHEN oc IS NULL THEN 0 ELSE 0.2 END)::DOUBLE)) AS confidence_score,
 CASE WHEN 0.5 * rs >= 0.3 * coverage AND 0.5 * rs >= coalesce(0.2 * oc, -1) THEN 'regex' WHEN 0.3 * coverage >= coalesce(0.2 * oc, -1) THEN 'template' ELSE 'ocr' END AS confidence_source,
 coalesce(nullif(concat_ws('; ', CASE vs WHEN 'invalid' THEN 'Regex pattern mismatch' WHEN 'missing' THEN 'Missing expected context' END,
  CASE WHEN oc < 0.5 THEN 'Low OCR confidence' END, CASE WHEN coverage < 0.5 THEN 'Template mismatch' END), ''), 'Validated by extraction') AS confidence_reason FROM sc1)"""
_HUMAN = f"""{_SCORED}, st AS (SELECT * FROM e_fields WHERE verification_status IN ('VERIFIED', 'CORRECTED')),
hs AS (SELECT sc.application_id, sc.document_id, sc.ocr_result_id, sc.document_type, sc.field_name,
 CASE WHEN st.field_name IS NULL THEN sc.extracted_value ELSE 'kept ' || st.field_name END AS extracted_value,
 CASE WHEN st.field_name IS NULL THEN sc.confidence_score ELSE st.confidence_score END AS confidence_score,
 CASE WHEN st.field_name IS NULL THEN sc.confidence_source ELSE coalesce(nullif(st.confidence_source, ''), sc.confidence_source) END AS confidence_source,
 sc.confidence_reason, st.field_name IS NOT NULL AS resolved, st.verification_status AS kept_status
 FROM sc LEFT JOIN st ON st.ocr_result_id = sc.ocr_result_id AND st.field_name = sc.field_name)"""
_CRITICAL = _names(vocab.REVIEW_CRITICAL_FIELDS)
_FLAGGED = f"""{_HUMAN}, low AS (SELECT application_id, field_name, bool_or(NOT resolved AND confidence_score < 0.85) AS low FROM hs GROUP BY 1, 2),
need AS (SELECT application_id FROM low WHERE low AND field_name IN {_CRITICAL} GROUP BY 1),
fl AS (SELECT hs.* EXCLUDE (kept_status), CASE WHEN resolved THEN kept_status WHEN l.field_name IS NOT NULL THEN 'PENDING_REVIEW' ELSE 'AUTO_VERIFIED' END AS verification_status,
 l.field_name IS NOT NULL AS flagged FROM hs LEFT JOIN (SELECT * FROM low WHERE low AND application_id IN (SELECT application_id FROM need)) l USING (application_id, field_name))"""


def _score_inputs(t):
    fields = t.fields.select(
        "application_id",
        "document_id",
        "document_type",
        "field_name",
        F.col("extracted_value").alias("value"),
    )
    checks = t.fields.selectExpr(
        "document_id",
        "field_name",
        "CASE (document_id + field_no) % 4 WHEN 0 THEN 'invalid' WHEN 1 THEN 'valid' WHEN 2 THEN 'missing' END AS validation_status",
    )
    return fields, t.ocr, checks


def _stored(t):
    return t.fields.select(
        "ocr_result_id",
        "field_name",
        F.concat(F.lit("kept "), "field_name").alias("extracted_value"),
        "confidence_score",
        "confidence_source",
        F.lit(None).cast("string").alias("confidence_reason"),
        "verification_status",
        F.coalesce(F.col("verification_status").isin("VERIFIED", "CORRECTED"), F.lit(False)).alias(
            "human_verified"
        ),
    )


@query(
    "template_coverage",
    f"WITH {_SCORED} SELECT document_id, document_type, present_expected, coverage FROM cov",
)
def template_coverage(t):
    return C.template_coverage(t.fields)


@query(
    "score_fields",
    f"WITH {_SCORED} SELECT * REPLACE (round(confidence_score, 9) AS confidence_score) FROM sc",
)
def score_fields(t):
    return C.score_fields(*_score_inputs(t)).withColumn(
        "confidence_score", F.round("confidence_score", 9)
    )


@query(
    "keep_human_state",
    f"WITH {_HUMAN} SELECT * REPLACE (round(confidence_score, 9) AS confidence_score) FROM hs",
)
def keep_human_state(t):
    return C.keep_human_state(C.score_fields(*_score_inputs(t)), _stored(t), t.ocr).withColumn(
        "confidence_score", F.round("confidence_score", 9)
    )


@query(
    "evaluate_confidence",
    f"WITH {_FLAGGED} SELECT * REPLACE (round(confidence_score, 9) AS confidence_score) FROM fl",
)
def evaluate_confidence(t):
    return C.evaluate_confidence(*_score_inputs(t), _stored(t)).withColumn(
        "confidence_score", F.round("confidence_score", 9)
    )


@query(
    "decide_review",
    f"""WITH {_HUMAN} SELECT application_id, CASE WHEN bool_or(NOT resolved AND confidence_score < 0.85 AND field_name IN {_CRITICAL}) THEN 'REQUIRES_HUMAN_REVIEW' ELSE 'READY_FOR_NORMALIZATION' END AS processing_status,
 round(avg(confidence_score), 9) AS overall_confidence, count(*) AS field_count,
 coalesce(list(DISTINCT field_name ORDER BY field_name) FILTER (WHERE NOT resolved AND confidence_score < 0.85 AND field_name IN {_CRITICAL}), []) AS critical_failures FROM hs GROUP BY 1""",
)
def decide_review(t):
    held = C.keep_human_state(C.score_fields(*_score_inputs(t), lean=True), _stored(t), t.ocr)
    return C.decide_review(held).withColumn("overall_confidence", F.round("overall_confidence", 9))


_APPLIED = f"""dec AS (SELECT application_id, field_name, CASE (a.application_id + n.no) % 4 WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'CORRECTED' WHEN 2 THEN 'CANNOT_VERIFY' END AS decision,
 'fix ' || n.field_name AS corrected_value, 'rev_' || CAST(a.application_id % 5 AS VARCHAR) AS rv FROM e_applications a CROSS JOIN (VALUES (0, 'iban'), (1, 'account_holder'), (2, 'bank_name'), (3, 'issue_date')) AS n(no, field_name)
 WHERE (a.application_id + n.no) % 4 <> 3),
ap AS (SELECT f.application_id, f.document_id, f.ocr_result_id, f.field_name, CASE WHEN k AND decision = 'CORRECTED' THEN corrected_value ELSE extracted_value END AS extracted_value,
 CASE WHEN k AND decision IN ('VERIFIED', 'CORRECTED') THEN 1.0 ELSE confidence_score END AS confidence_score, CASE WHEN k THEN decision ELSE verification_status END AS verification_status,
 CASE WHEN k AND decision = 'CORRECTED' THEN corrected_value ELSE human_corrected_value END AS human_corrected_value, k AND decision IN ('VERIFIED', 'CORRECTED') AS human_verified_now,
 CASE WHEN k THEN rv END AS reviewer, CASE WHEN k THEN TIMESTAMP '{AS_OF}' END AS reviewed_at, CASE WHEN k AND decision = 'CORRECTED' THEN extracted_value END AS original_value,
 CASE WHEN k AND decision = 'CORRECTED' THEN confidence_score END AS original_confidence
 FROM (SELECT e.*, d.decision, d.corrected_value, d.rv, coalesce(e.verification_status = 'PENDING_REVIEW' AND d.decision IS NOT NULL, false) AS k FROM e_fields e LEFT JOIN dec d USING (application_id, field_name)) f)"""


def _applied(t):
    names = F.array(*[F.lit(n) for n in ("iban", "account_holder", "bank_name", "issue_date")])
    rows = t.applications.select("application_id", F.posexplode(names).alias("no", "field_name"))
    turn = (F.col("application_id") + F.col("no")) % 4
    decisions = rows.filter(turn != 3).select(
        "application_id",
        "field_name",
        F.when(turn == 0, "VERIFIED").when(turn == 1, "CORRECTED").otherwise("CANNOT_VERIFY").alias("decision"),
        F.concat(F.lit("fix "), "field_name").alias("corrected_value"),
        F.concat(F.lit("rev_"), (F.col("application_id") % 5).cast("string")).alias("reviewer"),
        F.lit(AS_OF).cast("timestamp_ntz").alias("reviewed_at"),
    )
    return C.apply_field_reviews(t.fields, decisions)


@query("apply_field_reviews", f"WITH {_APPLIED} SELECT * FROM ap")
def apply_field_reviews(t):
    return _applied(t)


@query(
    "field_review_feedback",
    f"""WITH {_APPLIED} SELECT application_id, document_id, ocr_result_id, field_name, original_value AS ocr_value, human_corrected_value AS human_value,
 original_confidence AS confidence_score, reviewer, 'CORRECTED' AS decision, 'LOW_CONFIDENCE_REVIEW' AS origin FROM ap WHERE verification_status = 'CORRECTED' AND human_verified_now""",
)
def field_review_feedback(t):
    return C.review_feedback(_applied(t))


@query(
    "field_review_outcomes",
    f"""WITH {_APPLIED} SELECT application_id, CASE WHEN bool_or(verification_status = 'CANNOT_VERIFY') THEN 'PROCESSING_HALTED' ELSE 'READY_FOR_NORMALIZATION' END AS processing_status
FROM ap WHERE reviewer IS NOT NULL GROUP BY 1""",
)
def field_review_outcomes(t):
    return C.review_outcomes(_applied(t))
