"""Extraction, validation and consistency of all twelve text types, restated for DuckDB.

DuckDB has no look-around, so the patterns that need it are written without; every pattern is
searched by DuckDB's own engine. Readers and checks are written out once more.
"""

from __future__ import annotations

from dossier import vocab
from dossier.operators import patterns as PT
from dossier.plans.catalog import AS_OF
from dossier.plans.field_queries import _VALIDATE
from dossier.sources.bindings import _values

_PAGE = r"\n\n--- Page \d+ ---\n\n"
#: Patterns without look-around: what follows a value is matched, not looked at.
_REWRITTEN = {
    ("BANK_STATEMENT", "bank_name"): r"(?i)(?:Bank Name|Bank)\s*[:|-]\s*(.+)",
    (vocab.BILATERAL, "organization_name"): r";\nand\n([^,\n(]+)",
    (vocab.BILATERAL, "transaction_charges"): r"(?is)5\.2\.?\s*Transaction Charges:?\s*\n(.*?)(?:\n\d+\.\s+(?-i:[A-Z][A-Z\s&,]*)\n|\n--- page break ---\n|" + _PAGE + ")",
    (vocab.AUTHORITY, "focal_person_name"): r"(?:Mr|Mrs|Ms|Dr)\.?\s+([A-Za-z][A-Za-z.'\- ]*?)(?:\s*[,(]|\n[^\n,()]{0,80}[,(]|\s+CNIC|\s+is\s+authorized)",
    (vocab.AUTHORITY, "focal_person_designation"): r"(?i)(?:Mr|Mrs|Ms|Dr)\.?\s+[A-Za-z][A-Za-z.'\- ]*?[,(]\n?\s*([^,()]+?)(?:[,()]|\s+is\s+authorized)",
    (vocab.TRIPARTITE, "party_1link"): r"(?i)((?:1\s*LINK|1-LINK|ONE[-\s]?LINK|ONELINK)[^,\n]*?)(?:\s*\(hereinafter|\s*,|\s*\n|$)",
    (vocab.TRIPARTITE, "party_kpitb"): r"(?i)((?:KHYBER PAKHTUNKHWA INFORMATION(?:\s*(?:&|AND))?\s*TECHNOLOGY BOARD|KPITB))[\s,]",
}
_DATES = "['%Y-%m-%d', '%d/%m/%Y', '%d-%m-%Y', '%m/%d/%Y', '%Y/%m/%d', '%d %B %Y']"
_AMOUNT = "CASE WHEN regexp_full_match(x, '[\\d.]*,\\d{1,2}') THEN replace(replace(x, '.', ''), ',', '.') ELSE replace(x, ',', '') END::DOUBLE"
_READ = {
    "amount": f"CASE WHEN ({_AMOUNT}) < 1e7 THEN CAST(({_AMOUNT}) AS VARCHAR) ELSE CAST(CAST(({_AMOUNT}) AS BIGINT) AS VARCHAR) || '.0' END",
    "whole_number": "x",
    "document_date": f"strftime(try_strptime(x, {_DATES}), '%Y-%m-%d')",
    "salary_month": "CASE WHEN regexp_matches(x, '\\d{4}-\\d') THEN regexp_replace(x, '(\\d{4})-(\\d)$', '\\1-0\\2') ELSE strftime(try_strptime(x, '%B %Y'), '%Y-%m') END",
    "period": f"strftime(try_strptime(regexp_extract(x, '(?i)(.+?)\\s*(?:-|to)\\s*(.+)', 1), {_DATES}), '%Y-%m-%d') || ' - ' || strftime(try_strptime(regexp_extract(x, '(?i)(.+?)\\s*(?:-|to)\\s*(.+)', 2), {_DATES}), '%Y-%m-%d')",
    "platform_name": "CASE " + " ".join(f"WHEN lower(x) LIKE '%{n.lower()}%' THEN '{n}'" for n in ("Digital Muhasil", "PayMin", "Paymere BCX", "Paymir")) + " END",
    "without_watermark": "regexp_replace(regexp_replace(x, '(?i)\\n\\s*CS\\s*\\n\\s*CamScanner\\s*$', ''), '\\s+$', '')",
    "day_of_month": "strftime(try_strptime(regexp_replace(x, '\\s+', ' ', 'g'), '%d day of %m, %Y'), '%Y-%m-%d')",
    "dotted_date": "strftime(try_strptime(x, '%d.%m.%Y'), '%Y-%m-%d')",
    "single_line": "trim(regexp_replace(x, '\\s+', ' ', 'g'))",
    "last_reference": "coalesce(list_extract(regexp_extract_all(x, '[A-Za-z0-9]{5,}'), -1), x)",
}


def _quoted(text: str) -> str:
    return text.replace("'", "''")


def _pattern(kind: str, name: str, pattern: str) -> str:
    if (kind, name) in _REWRITTEN:
        return _REWRITTEN[kind, name]
    if pattern.startswith("(?dmU)"):
        return "(?m)" + pattern.removeprefix("(?dmU)")
    return pattern.removeprefix("(?dU)") if pattern.startswith("(?dU)") else "(?i)" + pattern


def _field(kind: str, name: str, pattern: str, reader) -> str:
    found = f"regexp_extract(raw_text, '{_quoted(_pattern(kind, name, pattern))}', 1)"
    # White space, one layer of separators, white space.
    bare = rf"regexp_replace({found}, '^\s+|\s+$', '', 'g')"
    raw = rf"regexp_replace(trim({bare}, ':;|'), '^\s+|\s+$', '', 'g')"
    read = reader.__name__ if reader else None
    if (kind, name) == (vocab.AUTHORITY, "organization_name"):
        read = "single_line"
    value = _READ[read] if read else "x"
    return f"SELECT document_id, '{name}' AS field_name, {value} AS value FROM (SELECT document_id, {raw} AS x FROM e_texts WHERE document_type = '{kind}') z WHERE x <> ''"


_ISSUED = rf"""SELECT document_id, 'issue_date' AS field_name, strftime(try_strptime(x, '%d-%m-%Y'), '%Y-%m-%d') AS value
 FROM (SELECT document_id, regexp_extract(regexp_extract(raw_text, '(?is)^(.*?)certify', 1), '(?i)Date\s*[:\-]*\s*(\d{{1,2}}[-/.]\d{{1,2}}[-/.]\d{{4}})', 1) AS x FROM e_texts WHERE document_type = '{vocab.CERTIFICATE}') z WHERE x <> ''"""

#: found(document_id, field_name, value): what the patterns of each text's type give.
FOUND = (
    "found AS ("
    + " UNION ALL ".join([_field(k, *p) for k, ps in PT.PATTERNS.items() for p in ps] + [_ISSUED])
    + ")"
)

_EXPECTED = _values(
    (k, f, vocab.FIELD_VALIDATORS.get(k, {}).get(f, "required"))
    for k, names in vocab.EXPECTED_FIELDS.items()
    for f in names
)
#: The digits of an IBAN, letters as 10 to 35, its first four signs last.
_IBAN_DIGITS = "array_to_string(list_transform(string_split(substr(v, 5) || substr(v, 1, 4), ''), lambda ch: CASE WHEN ch BETWEEN 'A' AND 'Z' THEN (ascii(ch) - 55)::VARCHAR ELSE ch END), '')"
_STATUS = _VALIDATE.replace("x.validator", "validator").removesuffix("ELSE 'valid' END") + (
    rf"WHEN 'iban_checksum' THEN CASE WHEN regexp_full_match(v, '[A-Z]{{2}}\d{{2}}[A-Z0-9]{{10,30}}') AND CAST({_IBAN_DIGITS} AS HUGEINT) % 97 = 1 THEN 'valid' ELSE 'invalid' END ELSE 'valid' END"
)
#: vl: one row per text and expected field of its type.
VALID = f"""ex(k, f, validator) AS (VALUES {_EXPECTED}),
vl AS (SELECT document_id, document_type, field, CASE WHEN v IS NULL THEN 'required' ELSE validator END AS validator, v AS value,
 CASE WHEN v IS NULL THEN 'missing' ELSE {_STATUS} END AS status
 FROM (SELECT t.document_id, t.document_type, ex.f AS field, ex.validator, found.value AS v FROM e_texts t JOIN ex ON ex.k = t.document_type
 LEFT JOIN found ON found.document_id = t.document_id AND found.field_name = ex.f) j)"""


def _number(field: str) -> str:
    return f"TRY_CAST(max(value) FILTER (WHERE field = '{field}') AS DOUBLE)"


#: cs: one row per text and check of its type.
CONSISTENT = f"""w AS (SELECT document_id, any_value(document_type) AS kind, {_number("gross_salary")} AS gs, {_number("net_salary")} AS ns,
 max(value) FILTER (WHERE field = 'payment_date') AS pd, max(value) FILTER (WHERE field = 'salary_month') AS sm, max(value) FILTER (WHERE field = 'issue_date') AS i, max(value) FILTER (WHERE field = 'expiry_date') AS e,
 max(value) FILTER (WHERE field = 'date_of_birth') AS b, {_number("gross_income")} AS gi, {_number("total_tax")} AS tt,
 max(value) FILTER (WHERE field = 'statement_period') AS sp, {_number("opening_balance")} AS ob, {_number("closing_balance")} AS cb, {_number("total_credits")} AS cr, {_number("total_debits")} AS dr,
 max(value) FILTER (WHERE field = 'transaction_count') AS tc FROM vl GROUP BY 1),
cs AS (SELECT document_id, 'NET_LE_GROSS' AS rule_id, CASE WHEN gs IS NULL OR ns IS NULL THEN 'not_applicable' WHEN ns > gs + 0.01 THEN 'fail' ELSE 'pass' END AS status FROM w WHERE kind = 'PAYSLIP'
 UNION ALL SELECT document_id, 'NET_POSITIVE', CASE WHEN ns IS NULL THEN 'not_applicable' WHEN ns < 0 THEN 'fail' ELSE 'pass' END FROM w WHERE kind = 'PAYSLIP'
 UNION ALL SELECT document_id, 'PAYMENT_WITHIN_MONTH', CASE WHEN pd IS NULL OR sm IS NULL THEN 'not_applicable' WHEN strftime(CAST(pd AS DATE), '%Y-%m') = sm OR strftime(CAST(pd AS DATE) - INTERVAL 1 MONTH, '%Y-%m') = sm THEN 'pass' ELSE 'fail' END FROM w WHERE kind = 'PAYSLIP'
 UNION ALL SELECT document_id, 'EXPIRY_AFTER_ISSUE', CASE WHEN i IS NULL OR e IS NULL THEN 'not_applicable' WHEN e <= i THEN 'fail' ELSE 'pass' END FROM w WHERE kind = 'ID_DOCUMENT'
 UNION ALL SELECT document_id, 'AGE_REASONABLE', CASE WHEN b IS NULL THEN 'not_applicable' WHEN datesub('year', CAST(b AS DATE), DATE '{AS_OF[:10]}') > 120 THEN 'fail' ELSE 'pass' END FROM w WHERE kind = 'ID_DOCUMENT'
 UNION ALL SELECT document_id, 'GROSS_POSITIVE', CASE WHEN gi IS NULL THEN 'not_applicable' WHEN gi < 0 THEN 'fail' ELSE 'pass' END FROM w WHERE kind = 'TAX_DOCUMENT'
 UNION ALL SELECT document_id, 'TAX_NOT_EXCEEDING_GROSS', CASE WHEN gi IS NULL OR tt IS NULL THEN 'not_applicable' WHEN tt > gi + 0.01 THEN 'fail' ELSE 'pass' END FROM w WHERE kind = 'TAX_DOCUMENT'
 UNION ALL SELECT document_id, 'STMT_PERIOD_VALID', CASE WHEN sp IS NULL THEN 'not_applicable' WHEN try_strptime(split_part(sp, ' - ', 1), '%Y-%m-%d') <= try_strptime(split_part(sp, ' - ', 2), '%Y-%m-%d') THEN 'pass' ELSE 'fail' END FROM w WHERE kind = 'BANK_STATEMENT'
 UNION ALL SELECT document_id, 'OPENING_LE_CLOSING', CASE WHEN ob IS NULL OR cb IS NULL THEN 'not_applicable' WHEN ob > cb + 0.01 THEN 'warning' ELSE 'pass' END FROM w WHERE kind = 'BANK_STATEMENT'
 UNION ALL SELECT document_id, 'CLOSING_MATCHES_TRANSACTIONS', CASE WHEN abs(cb - (ob + cr - dr)) <= 0.01 THEN 'pass' WHEN ob + cb + cr + dr IS NOT NULL THEN 'fail'
  WHEN ob IS NULL OR cb IS NULL OR tc IS NULL OR TRY_CAST(tc AS INT) <> 0 THEN 'warning' WHEN abs(cb - ob) <= 0.01 THEN 'pass' ELSE 'fail' END FROM w WHERE kind = 'BANK_STATEMENT'
 UNION ALL SELECT document_id, 'BALANCES_NON_NEGATIVE', CASE WHEN ob IS NULL OR cb IS NULL THEN 'not_applicable' WHEN least(ob, cb) < 0 THEN 'fail' ELSE 'pass' END FROM w WHERE kind = 'BANK_STATEMENT')"""

_CRITICAL = _values((k, f) for k, names in vocab.ANALYSIS_CRITICAL_FIELDS.items() for f in names)
#: scored: rates, score and status of every text, also of those without a known type.
SCORED = f"""crit(k, f) AS (VALUES {_CRITICAL}),
v AS (SELECT t.document_id, coalesce(count(*) FILTER (WHERE status <> 'missing')::DOUBLE / nullif(count(vl.field), 0), 0.0) AS cov,
 coalesce(count(*) FILTER (WHERE status = 'valid')::DOUBLE / nullif(count(vl.field), 0), 1.0) AS vr, coalesce(bool_or(status <> 'valid' AND crit.f IS NOT NULL), false) AS held
 FROM e_texts t LEFT JOIN vl ON vl.document_id = t.document_id LEFT JOIN crit ON crit.k = vl.document_type AND crit.f = vl.field GROUP BY 1),
c AS (SELECT document_id, coalesce(count(*) FILTER (WHERE status = 'pass')::DOUBLE / nullif(count(*) FILTER (WHERE status <> 'not_applicable'), 0), 1.0) AS cr, bool_or(status = 'fail') AS fl FROM cs GROUP BY 1),
s AS (SELECT v.document_id, held OR coalesce(fl, false) AS h, cov, vr, coalesce(c.cr, 1.0) AS cr, CAST(0.5 AS DOUBLE) * cov + CAST(0.3 AS DOUBLE) * vr + CAST(0.2 AS DOUBLE) * coalesce(c.cr, 1.0) AS score FROM v LEFT JOIN c USING (document_id)),
scored AS (SELECT document_id, round(cov, 9) AS field_coverage, round(vr, 9) AS validation_rate, round(cr, 9) AS consistency_rate, round(score, 9) AS confidence_score,
 CASE WHEN h THEN 'NEEDS_REVIEW' WHEN score >= 0.8 THEN 'VERIFIED' WHEN score >= 0.6 THEN 'PARTIALLY_VERIFIED' WHEN score >= 0.4 THEN 'NEEDS_REVIEW' ELSE 'FAILED' END AS verification_status FROM s)"""
