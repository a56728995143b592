"""Business rule queries, family by family and all together.

The oracle restates each rule as its own SELECT over the application's values, with the
first deciding value picked by a row number.
"""

from pyspark.sql import functions as F

from dossier import vocab
from dossier.functions.timing import moment
from dossier.operators.rules import base, catalogue, cross, engine, pairs, presence, visual
from dossier.plans.catalog import AS_OF, query
from dossier.sources.bindings import _values

_TODAY = f"DATE '{AS_OF[:10]}'"
_VALS = """vals AS (SELECT application_id, document_id, document_type, field_name, extracted_value, confidence_score, nv, trim(coalesce(nv, '')) AS v,
 trim(coalesce(nv, '')) <> '' AS present FROM (SELECT *, CASE WHEN verification_status IN ('PENDING_REVIEW', 'CANNOT_VERIFY') THEN NULL ELSE normalized_value END AS nv FROM e_fields) x)"""
_NOTHING = vocab.NOTHING_TO_VALIDATE

_DOC_ROWS = _values((r.rule_id, r.document_type) for r in vocab.DOCUMENT_RULES)
_DOCUMENT = f"""doc_r AS (SELECT a.application_id, r.rule_id, CASE WHEN count(d.document_id) = 1 THEN 'PASS' ELSE 'FAIL' END AS status,
 CASE WHEN count(d.document_id) = 0 THEN 'Required document ' || r.t || ' is missing' WHEN count(d.document_id) = 1 THEN 'Document ' || r.t || ' is present exactly once'
  ELSE 'Document ' || r.t || ' is present more than once (' || count(d.document_id) || ' documents)' END AS message
 FROM e_applications a CROSS JOIN (VALUES {_DOC_ROWS}) AS r(rule_id, t) LEFT JOIN e_documents d ON d.application_id = a.application_id AND d.document_type = r.t GROUP BY a.application_id, r.rule_id, r.t)"""

_FLD_ROWS = _values(
    (r.rule_id, r.field_name, r.document_type, r.document_label) for r in vocab.FIELD_RULES
)
_FIELD = f"""fld_r AS (SELECT a.application_id, r.rule_id, CASE WHEN count(v.document_id) = 0 THEN 'FAIL' WHEN NOT bool_or(v.present) THEN 'WARNING' ELSE 'PASS' END AS status,
 CASE WHEN count(v.document_id) = 0 THEN 'Required field ' || r.f || ' is missing from the ' || r.l WHEN NOT bool_or(v.present) THEN 'Field ' || r.f || ' is present but has no normalized value'
  ELSE 'Required field ' || r.f || ' is present with a normalized value' END AS message
 FROM e_applications a CROSS JOIN (VALUES {_FLD_ROWS}) AS r(rule_id, f, t, l) LEFT JOIN vals v ON v.application_id = a.application_id AND v.field_name = r.f AND v.document_type = r.t GROUP BY a.application_id, r.rule_id, r.f, r.l)"""


def _value_rule(name, rule_id, fields, bad, none, passed, where="true", none_when=None):
    """CTE for one rule: ``bad`` is [(condition, status, message sql)]."""
    spots = " ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(fields)) if fields else ""
    spot = f"CASE field_name {spots} END" if fields else "0"
    match = "field_name IN (" + ", ".join(f"'{f}'" for f in fields) + ")" if fields else "true"
    status = "CASE " + " ".join(f"WHEN {c} THEN '{s}'" for c, s, _ in bad) + " END"
    message = "CASE " + " ".join(f"WHEN {c} THEN {m}" for c, _, m in bad) + " END"
    none_when = none_when or "coalesce(k.np, 0) = 0"
    return f"""{name} AS (WITH c AS (SELECT *, {spot} AS spot, {status} AS st, {message} AS ms FROM vals WHERE {match} AND {where}),
 k AS (SELECT application_id, count(*) AS n, count(*) FILTER (WHERE present) AS np, count(*) FILTER (WHERE nv <> '') AS nf FROM c GROUP BY 1),
 f AS (SELECT * FROM c WHERE st IS NOT NULL QUALIFY row_number() OVER (PARTITION BY application_id ORDER BY spot, document_id, field_name) = 1)
 SELECT a.application_id, '{rule_id}' AS rule_id, CASE WHEN {none_when} THEN '{none[0]}' WHEN f.st IS NOT NULL THEN f.st ELSE 'PASS' END AS status,
 CASE WHEN {none_when} THEN '{none[1]}' WHEN f.st IS NOT NULL THEN f.ms ELSE '{passed}' END AS message
 FROM e_applications a LEFT JOIN k USING (application_id) LEFT JOIN f USING (application_id))"""


_SHAPE_SQL = {
    "canonical_iban": r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}",
    "canonical_cnic": r"\d{5}-\d{7}-\d",
    "rule_account_number": r"[A-Z0-9]{6,20}",
    "canonical_amount": r"(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d{1,2})?",
    "iso_date": r"\d{4}-\d{2}-\d{2}",
    "e_stamp": r"(?i)STAMP-\d{6}",
}
_WARN = ("WARNING", _NOTHING)
_FORMAT = [
    _value_rule(
        f"fmt{i}",
        rule_id,
        fields,
        [
            (
                f"present AND NOT regexp_full_match(nv, '{_SHAPE_SQL[shape]}')",
                "FAIL",
                "'Value ''' || nv || ''' of field ' || field_name || ' does not have the required format'",
            )
        ],
        _WARN,
        "Every checked value has the required format",
    )
    for i, (rule_id, _, fields, shape) in enumerate(vocab.FORMAT_RULES)
]
_DAY = "CASE WHEN regexp_full_match(v, '\\d{4}-\\d{2}-\\d{2}') THEN TRY_CAST(v AS DATE) END"
_START = "TRY_CAST(split_part(v, ' - ', 1) AS DATE)"
_END = "TRY_CAST(split_part(v, ' - ', 2) AS DATE)"
_UNREAD_PERIOD = (
    f"present AND ({_START} IS NULL OR {_END} IS NULL)",
    "WARNING",
    "'Statement period ''' || v || ''' could not be parsed'",
)


def _unread(label):
    return (f"present AND {_DAY} IS NULL", "WARNING", f"'{label} ''' || v || ''' could not be parsed'")


_DATE = [
    _value_rule(
        "dt0",
        "DATE_PERIOD_SEQUENCE",
        ("statement_period",),
        [
            _UNREAD_PERIOD,
            (f"{_START} > {_END}", "FAIL", f"'Statement period starts ' || {_START} || ' after it ends ' || {_END}"),
        ],
        _WARN,
        "Statement period is chronological",
    ),
    _value_rule(
        "dt1",
        "DATE_PERIOD_WITHIN_RANGE",
        ("statement_period",),
        [
            _UNREAD_PERIOD,
            (f"{_END} > {_TODAY}", "FAIL", f"'Statement period ends ' || {_END} || ', which is in the future'"),
            (
                f"{_END} < {_TODAY} - INTERVAL 365 DAY",
                "WARNING",
                f"'Statement period ends ' || {_END} || ', which is older than 365 days'",
            ),
        ],
        _WARN,
        "Statement period is within the accepted range",
    ),
    _value_rule(
        "dt2",
        "DATE_PAYMENT_RECENCY",
        ("payment_date",),
        [_unread("Payment date"), (f"{_DAY} > {_TODAY}", "FAIL", "'Payment date ' || v || ' is in the future'")],
        _WARN,
        "Payment dates are not in the future",
    ),
    _value_rule(
        "dt3",
        "DATE_DOB_SANITY",
        ("date_of_birth",),
        [
            _unread("Date of birth"),
            (f"year({_DAY}) < 1900 OR {_DAY} > {_TODAY}", "FAIL", "'Date of birth ' || v || ' is not plausible'"),
        ],
        _WARN,
        "Dates of birth are plausible",
    ),
    _value_rule(
        "dt4",
        "DATE_CNIC_NOT_EXPIRED",
        ("date_of_expiry",),
        [_unread("Date of expiry"), (f"{_DAY} < {_TODAY}", "FAIL", f"'CNIC expired on ' || {_DAY}")],
        _WARN,
        "CNIC is not expired",
    ),
]
for _i, (_rid, _f, _ok) in enumerate(
    (
        ("DATE_ISSUE_PRESENT", "issue_date", "Issue dates are present"),
        ("DATE_EXPIRY_PRESENT", "expiry_date", "Expiry dates are present"),
    )
):
    _DATE.append(
        f"""dp{_i} AS (SELECT a.application_id, '{_rid}' AS rule_id, CASE WHEN count(v.document_id) = 0 THEN 'WARNING' WHEN bool_or(v.present) THEN 'PASS' ELSE 'FAIL' END AS status,
 CASE WHEN count(v.document_id) = 0 THEN '{_NOTHING}' WHEN bool_or(v.present) THEN '{_ok}' ELSE 'Required field {_f} is missing or blank' END AS message
 FROM e_applications a LEFT JOIN vals v ON v.application_id = a.application_id AND v.field_name = '{_f}' GROUP BY 1)"""
    )
_DATE.append(
    rf"""dpair AS (WITH p AS (SELECT *, {_DAY} AS d FROM vals WHERE present AND field_name IN ('issue_date', 'expiry_date')),
 i AS (SELECT * FROM p WHERE field_name = 'issue_date'), e AS (SELECT * FROM p WHERE field_name = 'expiry_date'),
 j AS (SELECT i.application_id, i.document_id, i.v, i.d, min(e.d) AS first_e, arg_min(e.v, e.document_id) FILTER (WHERE e.d <= i.d) AS named FROM i JOIN e USING (application_id) GROUP BY 1, 2, 3, 4),
 f AS (SELECT * FROM j WHERE d IS NULL OR d >= first_e QUALIFY row_number() OVER (PARTITION BY application_id ORDER BY document_id) = 1)
 SELECT a.application_id, 'DATE_ISSUE_PRECEDES_EXPIRY' AS rule_id,
 CASE WHEN a.application_id NOT IN (SELECT application_id FROM j) THEN 'WARNING' WHEN f.application_id IS NULL THEN 'PASS' WHEN f.d IS NULL THEN 'WARNING' ELSE 'FAIL' END AS status,
 CASE WHEN a.application_id NOT IN (SELECT application_id FROM j) THEN 'No issue and expiry date pair is present to compare' WHEN f.application_id IS NULL THEN 'Issue dates precede their expiry dates'
  WHEN f.d IS NULL THEN 'Issue date ''' || f.v || ''' could not be parsed' ELSE 'Issue date ' || f.v || ' does not precede expiry date ' || f.named END AS message
 FROM e_applications a LEFT JOIN f USING (application_id))"""
)
_POLICY = [
    _value_rule(
        "pol0",
        "POL_ACCOUNT_HOLDER_REAL",
        ("account_holder",),
        [
            (
                "present AND regexp_full_match(upper(v), 'NOT PROVIDED|N/A|NA|NONE|X+|UNKNOWN|TBD')",
                "FAIL",
                "'Account holder ''' || v || ''' is a placeholder, not a real entity'",
            )
        ],
        _WARN,
        "Account holder is a real named entity",
        where="document_type = 'ACCOUNT_MAINTENANCE_CERTIFICATE'",
    ),
    f"""pol1 AS (SELECT a.application_id, 'POL_SINGLE_CURRENCY' AS rule_id, CASE WHEN count(v.v) = 0 THEN 'WARNING' WHEN count(DISTINCT v.v) > 1 THEN 'FAIL' ELSE 'PASS' END AS status,
 CASE WHEN count(v.v) = 0 THEN '{_NOTHING}' WHEN count(DISTINCT v.v) > 1 THEN 'Multiple currencies are used: ' || count(DISTINCT v.v) || ' values'
  ELSE 'A single currency (' || min(v.v) || ') is used' END AS message
 FROM e_applications a LEFT JOIN vals v ON v.application_id = a.application_id AND v.present AND v.field_name = 'currency' AND v.document_type = 'ACCOUNT_MAINTENANCE_CERTIFICATE' GROUP BY 1)""",
    rf"""pol2 AS (WITH p AS (SELECT application_id, field_name, arg_min(replace(v, ',', ''), document_id) AS x FROM vals WHERE present AND document_type = 'ACCOUNT_MAINTENANCE_CERTIFICATE'
   AND field_name IN ('opening_balance', 'closing_balance', 'total_credits', 'total_debits') GROUP BY 1, 2),
 w AS (SELECT application_id, max(x) FILTER (WHERE field_name = 'opening_balance') AS o, max(x) FILTER (WHERE field_name = 'closing_balance') AS c,
   max(x) FILTER (WHERE field_name = 'total_credits') AS r, max(x) FILTER (WHERE field_name = 'total_debits') AS d FROM p GROUP BY 1),
 n AS (SELECT *, TRY_CAST(o AS DECIMAL(30, 6)) AS no, TRY_CAST(c AS DECIMAL(30, 6)) AS nc, TRY_CAST(r AS DECIMAL(30, 6)) AS nr, TRY_CAST(d AS DECIMAL(30, 6)) AS nd,
   greatest(length(regexp_extract(o, '\.(\d*)$', 1)), length(regexp_extract(r, '\.(\d*)$', 1)), length(regexp_extract(d, '\.(\d*)$', 1))) AS sc FROM w)
 SELECT a.application_id, 'POL_BALANCE_RECONCILIATION' AS rule_id,
 CASE WHEN n.application_id IS NULL OR o IS NULL OR c IS NULL OR r IS NULL OR d IS NULL OR no IS NULL OR nc IS NULL OR nr IS NULL OR nd IS NULL THEN 'WARNING' WHEN abs(no + nr - nd - nc) > 0.01 THEN 'FAIL' ELSE 'PASS' END AS status,
 CASE WHEN n.application_id IS NULL THEN '{_NOTHING}' WHEN o IS NULL OR c IS NULL OR r IS NULL OR d IS NULL THEN 'A balance component is missing; the statement cannot be reconciled'
  WHEN no IS NULL OR nc IS NULL OR nr IS NULL OR nd IS NULL THEN 'A balance value could not be parsed as an amount' WHEN abs(no + nr - nd - nc) > 0.01 THEN
  'Closing balance ' || c || ' does not reconcile with the opening balance ' || o || ', credits ' || r || ' and debits ' || d || ' (expected ' || CASE WHEN sc = 0 THEN split_part(CAST(no + nr - nd AS VARCHAR), '.', 1)
   ELSE split_part(CAST(no + nr - nd AS VARCHAR), '.', 1) || '.' || substr(split_part(CAST(no + nr - nd AS VARCHAR), '.', 2), 1, sc) END || ')' ELSE 'Statement balances reconcile' END AS message
 FROM e_applications a LEFT JOIN n USING (application_id))""",
    """pol3 AS (WITH p AS (SELECT *, CASE WHEN contains(v, ' - ') THEN substr(split_part(v, ' - ', 1), 1, 7) END AS s, CASE WHEN contains(v, ' - ') THEN substr(split_part(v, ' - ', 2), 1, 7) END AS e,
   contains(v, '-') AND NOT contains(v, ' - ') AS broken FROM vals WHERE present AND field_name = 'statement_period'),
 m AS (SELECT * FROM vals WHERE present AND field_name = 'salary_month'),
 j AS (SELECT m.application_id, m.document_id, m.v, min(CASE WHEN p.broken OR m.v < p.s OR m.v > p.e THEN p.document_id END) AS bad_doc,
   arg_min(p.v, p.document_id) FILTER (WHERE p.broken OR m.v < p.s OR m.v > p.e) AS bad_p, arg_min(p.broken, p.document_id) FILTER (WHERE p.broken OR m.v < p.s OR m.v > p.e) AS bad_b
   FROM m JOIN p USING (application_id) GROUP BY 1, 2, 3),
 f AS (SELECT * FROM j WHERE bad_doc IS NOT NULL OR length(v) <> 7 OR NOT starts_with(v, '20') OR NOT contains(v, '-') QUALIFY row_number() OVER (PARTITION BY application_id ORDER BY document_id) = 1)
 SELECT a.application_id, 'POL_PERIOD_SALARY_ALIGNED' AS rule_id,
 CASE WHEN a.application_id NOT IN (SELECT application_id FROM j) THEN 'WARNING' WHEN f.v IS NULL THEN 'PASS' WHEN length(f.v) <> 7 OR NOT starts_with(f.v, '20') THEN 'WARNING' ELSE 'FAIL' END AS status,
 CASE WHEN a.application_id NOT IN (SELECT application_id FROM j) THEN 'No salary month and statement period pair is present to compare' WHEN f.v IS NULL THEN 'Salary month falls within the statement period'
  WHEN length(f.v) <> 7 OR NOT starts_with(f.v, '20') THEN 'Salary month ''' || f.v || ''' is not in the canonical form'
  WHEN NOT contains(f.v, '-') OR f.bad_b THEN 'Rule execution failed unexpectedly: not enough values to unpack (expected 2, got 1)'
  ELSE 'Salary month ' || f.v || ' falls outside the statement period ' || f.bad_p END AS message
 FROM e_applications a LEFT JOIN f USING (application_id))""",
]
_QUALITY = [
    _value_rule(
        "ql0",
        "QUAL_NORMALIZED_VALUES_CLEAN",
        (),
        [
            (
                "nv <> '' AND (nv <> v OR contains(nv, '  '))",
                "FAIL",
                "'Normalized value ''' || nv || ''' of field ' || field_name || ' has stray whitespace'",
            )
        ],
        _WARN,
        "All normalized values are cleanly formatted",
        none_when="coalesce(k.nf, 0) = 0",
    ),
    _value_rule(
        "ql1",
        "QUAL_NO_EMPTY_VALUES",
        (),
        [("trim(coalesce(extracted_value, '')) = ''", "FAIL", "'Field ' || field_name || ' has an empty extracted value'")],
        _WARN,
        "No field has an empty extracted value",
        none_when="k.n IS NULL",
    ),
    _value_rule(
        "ql2",
        "QUAL_CONFIDENCE_FLOOR",
        (),
        [
            (
                "coalesce(confidence_score, 0) < 0.5",
                "FAIL",
                "'Field ' || field_name || ' has confidence ' || coalesce(CAST(confidence_score AS VARCHAR), 'None') || ' below the floor 0.5'",
            )
        ],
        _WARN,
        "All extracted fields meet the confidence floor",
        none_when="k.n IS NULL",
    ),
    _value_rule(
        "ql3",
        "QUAL_TRANSACTION_COUNT",
        ("transaction_count",),
        [
            (
                "NOT coalesce(TRY_CAST(CASE WHEN regexp_full_match(trim(nv), '\\+?\\d+') THEN trim(nv) END AS BIGINT) > 0, false)",
                "FAIL",
                "'Transaction count ' || coalesce('''' || nv || '''', 'None') || ' is not a positive integer'",
            )
        ],
        ("PASS", "No transaction count field is present to validate"),
        "Transaction count is a positive integer",
        none_when="k.n IS NULL",
    ),
]
_VIS_ROWS = _values((r.rule_id, r.document_type, r.detection_type) for r in vocab.VISUAL_RULES)
_VISUAL = f"""vis_r AS (WITH r(rule_id, t, k) AS (VALUES {_VIS_ROWS}),
 c AS (SELECT d.application_id, r.rule_id, d.document_id, d.uploaded_at, x.is_present FROM e_documents d JOIN r ON r.t = d.document_type LEFT JOIN e_detections x ON x.document_id = d.document_id AND x.detection_type = r.k),
 f AS (SELECT * FROM c WHERE is_present IS NULL OR NOT is_present QUALIFY row_number() OVER (PARTITION BY application_id, rule_id ORDER BY uploaded_at DESC, document_id DESC) = 1)
 SELECT a.application_id, r.rule_id, CASE WHEN NOT EXISTS (SELECT 1 FROM c WHERE c.application_id = a.application_id AND c.rule_id = r.rule_id) THEN 'FAIL' WHEN f.document_id IS NULL THEN 'PASS' WHEN f.is_present IS NULL THEN 'PENDING_MANUAL_REVIEW' ELSE 'FAIL' END AS status,
 CASE WHEN NOT EXISTS (SELECT 1 FROM c WHERE c.application_id = a.application_id AND c.rule_id = r.rule_id) THEN 'Document ' || r.t || ' is missing; cannot verify ' || lower(r.k)
  WHEN f.document_id IS NULL THEN r.k || ' is present on every checked document' WHEN f.is_present IS NULL THEN 'No ' || lower(r.k) || ' detection outcome is available for document id=' || f.document_id
  ELSE r.k || ' not detected on document id=' || f.document_id END AS message
 FROM e_applications a CROSS JOIN r LEFT JOIN f ON f.application_id = a.application_id AND f.rule_id = r.rule_id)"""


def _cross_rule(name, rule_id, field, types):
    arms_s, arms_m = [], []
    for t in sorted(types):
        arms_s.append(f"WHEN coalesce(bool_or(t = '{t}' AND has_doc), false) = false THEN 'FAIL' WHEN coalesce(bool_or(t = '{t}' AND has_val), false) = false THEN 'FAIL'")
        arms_m.append(
            f"WHEN coalesce(bool_or(t = '{t}' AND has_doc), false) = false THEN 'Document {t} is missing; cannot compare field {field}' WHEN coalesce(bool_or(t = '{t}' AND has_val), false) = false THEN 'Field {field} is missing from document {t}'"
        )
    listed = ", ".join(f"('{t}')" for t in types)
    inlist = ", ".join(f"'{t}'" for t in types)
    return f"""{name} AS (WITH s AS (SELECT a.application_id, p.t, EXISTS (SELECT 1 FROM e_documents d WHERE d.application_id = a.application_id AND d.document_type = p.t) AS has_doc,
  EXISTS (SELECT 1 FROM vals v WHERE v.application_id = a.application_id AND v.document_type = p.t AND v.field_name = '{field}' AND v.present) AS has_val FROM e_applications a CROSS JOIN (VALUES {listed}) AS p(t)),
 d AS (SELECT application_id, count(DISTINCT v) AS n, count(DISTINCT v) || ' values' AS pv FROM vals WHERE present AND field_name = '{field}' AND document_type IN ({inlist}) GROUP BY 1)
 SELECT s.application_id, '{rule_id}' AS rule_id, CASE {" ".join(arms_s)} WHEN any_value(d.n) = 1 THEN 'PASS' ELSE 'FAIL' END AS status,
 CASE {" ".join(arms_m)} WHEN any_value(d.n) = 1 THEN 'Field {field} is consistent across the compared documents' ELSE 'Field {field} differs between documents: ' || any_value(d.pv) END AS message
 FROM s LEFT JOIN d USING (application_id) GROUP BY s.application_id)"""


_CROSS = [_cross_rule(f"cr{i}", r[0], r[2], r[3]) for i, r in enumerate(vocab.CROSS_RULES)]
_CROSS.append(
    """cr9 AS (WITH f AS (SELECT DISTINCT application_id, v FROM vals WHERE present AND field_name = 'account_number_or_iban' AND document_type = 'ONE_LINK_LETTER'),
 c AS (SELECT DISTINCT application_id, v FROM vals WHERE present AND field_name IN ('account_number', 'iban') AND document_type = 'ACCOUNT_MAINTENANCE_CERTIFICATE'),
 u AS (SELECT application_id, count(*) || ' values' AS pv FROM (SELECT * FROM f UNION SELECT * FROM c) z GROUP BY 1),
 b AS (SELECT a.application_id, EXISTS (SELECT 1 FROM e_documents d WHERE d.application_id = a.application_id AND d.document_type = 'ACCOUNT_MAINTENANCE_CERTIFICATE') AS dc,
  EXISTS (SELECT 1 FROM e_documents d WHERE d.application_id = a.application_id AND d.document_type = 'ONE_LINK_LETTER') AS df, EXISTS (SELECT 1 FROM f WHERE f.application_id = a.application_id) AS vf,
  EXISTS (SELECT 1 FROM c WHERE c.application_id = a.application_id) AS vc, EXISTS (SELECT 1 FROM f JOIN c USING (application_id, v) WHERE f.application_id = a.application_id) AS hit FROM e_applications a)
 SELECT application_id, 'CROSS_ONE_LINK_ACCOUNT_MATCH' AS rule_id, CASE WHEN dc AND df AND vf AND vc AND hit THEN 'PASS' ELSE 'FAIL' END AS status,
 CASE WHEN NOT dc THEN 'Document ACCOUNT_MAINTENANCE_CERTIFICATE is missing; cannot compare the 1-Link account number/IBAN' WHEN NOT df THEN 'Document ONE_LINK_LETTER is missing; cannot compare the account number/IBAN'
  WHEN NOT vf THEN 'Field account_number_or_iban is missing from document ONE_LINK_LETTER' WHEN NOT vc THEN 'Field account_number/iban is missing from document ACCOUNT_MAINTENANCE_CERTIFICATE'
  WHEN hit THEN '1-Link account number/IBAN matches the AMC' ELSE '1-Link account number/IBAN does not match the AMC: ' || u.pv END AS message FROM b LEFT JOIN u USING (application_id))"""
)


def _union(*groups):
    ctes = [c for g in groups for c in (g if isinstance(g, list) else [g])]
    names = [c.split(" AS ", 1)[0] for c in ctes]
    return (
        f"WITH {_VALS}, "
        + ", ".join(ctes)
        + " "
        + " UNION ALL ".join(f"SELECT application_id, rule_id, status, message FROM {n}" for n in names)
    )


_SHOWN = ("application_id", "rule_id", "status", "message")


def _vals(t):
    return base.with_values(t.table("fields"))


def _value_family(t, rules):
    """One reader of the fields, so they are not written out first."""
    return presence.value_rule_results(t.applications, base.with_values(t.fields), rules).select(*_SHOWN)


def _today():
    return moment(AS_OF).cast("date")


@query("document_presence_rules", _union(_DOCUMENT))
def document_presence_rules(t):
    return presence.document_rules(t.applications, t.entity("documents")).select(*_SHOWN)


@query("field_presence_rules", _union(_FIELD))
def field_presence_rules(t):
    return _value_family(t, catalogue.presence_rules())


@query("format_rules", _union(_FORMAT))
def format_rules(t):
    return _value_family(t, catalogue.format_rules())


@query("date_rules", _union(_DATE[:-1]))
def date_rules(t):
    return _value_family(t, catalogue.date_rules(_today()))


@query("issue_precedes_expiry", _union(_DATE[-1]))
def issue_precedes_expiry(t):
    return pairs.issue_precedes_expiry(t.applications, _vals(t)).select(*_SHOWN)


@query("account_holder_rule", _union(_POLICY[0]))
def account_holder_rule(t):
    return _value_family(t, catalogue.policy_rules())


@query("balance_reconciliation", _union(_POLICY[2]))
def balance_reconciliation(t):
    return pairs.balance_reconciles(t.applications, _vals(t)).select(*_SHOWN)


@query("salary_month_aligned", _union(_POLICY[3]))
def salary_month_aligned(t):
    return pairs.salary_month_aligned(t.applications, _vals(t)).select(*_SHOWN)


@query("quality_rules", _union(_QUALITY))
def quality_rules(t):
    return _value_family(t, catalogue.quality_rules())


@query("visual_rules", _union(_VISUAL))
def visual_rules(t):
    return visual.visual_rules(t.applications, t.entity("documents"), t.detections).select(*_SHOWN)


@query("cross_document_rules", _union(_CROSS, _POLICY[1]))
def cross_document_rules(t):
    return cross.cross_rules(t.applications, t.entity("documents"), _vals(t)).select(*_SHOWN)


@query(
    "unregistered_cross_rules",
    _union(
        [
            _cross_rule(f"ux{i}", r[0], r[2], r[3])
            for i, r in enumerate(vocab.UNREGISTERED_CROSS_RULES)
        ]
    ),
)
def unregistered_cross_rules(t):
    rows = cross.cross_rules(
        t.applications, t.entity("documents"), _vals(t), vocab.UNREGISTERED_CROSS_RULES
    )
    wanted = [r[0] for r in vocab.UNREGISTERED_CROSS_RULES]
    return rows.filter(F.col("rule_id").isin(*wanted)).select(*_SHOWN)


@query(
    "schedule_of_charges_rule",
    """SELECT a.application_id, 'DOC_SCHEDULE_OF_CHARGES_PRESENT' AS rule_id, CASE WHEN count(d.document_id) = 1 THEN 'PASS' ELSE 'FAIL' END AS status
FROM e_applications a LEFT JOIN e_documents d ON d.application_id = a.application_id AND d.document_type = 'SCHEDULE_OF_CHARGES' GROUP BY 1""",
)
def schedule_of_charges_rule(t):
    return presence.document_rules(
        t.applications, t.entity("documents"), vocab.UNREGISTERED_DOCUMENT_RULES
    ).select("application_id", "rule_id", "status")


_COMPARED = [(r[0], [r[2]], list(r[3])) for r in vocab.CROSS_RULES] + [
    (vocab.ONE_LINK_RULE[0], ["account_number_or_iban"], [vocab.ONE_LINK]),
    (vocab.ONE_LINK_RULE[0], ["account_number", "iban"], [vocab.CERTIFICATE]),
    (cross.CURRENCY_RULE, ["currency"], [vocab.CERTIFICATE]),
]


def _any_of(names):
    return ", ".join(f"'{n}'" for n in names)


@query(
    "differing_values",
    f"WITH {_VALS} "
    + " UNION ".join(
        f"SELECT application_id, '{rule}' AS rule_id, v FROM vals WHERE present"
        f" AND field_name IN ({_any_of(fields)}) AND document_type IN ({_any_of(types)})"
        for rule, fields, types in _COMPARED
    ),
)
def differing_values(t):
    return cross.differing_values(_vals(t))


_ALL = _union(_DOCUMENT, _FIELD, _FORMAT, _CROSS, _DATE, _VISUAL, _POLICY, _QUALITY)


@query(
    "evaluate_rules",
    f"""SELECT z.*, CASE status WHEN 'FAIL' THEN 'ERROR' WHEN 'PASS' THEN 'INFO' ELSE 'WARNING' END AS severity FROM ({_ALL}) z""",
)
def evaluate_rules(t):
    return engine.evaluate_rules(
        t.applications, t.entity("documents"), t.fields, t.detections, AS_OF
    ).select(*_SHOWN, "severity")


@query("rule_related_documents")
def rule_related_documents(t):
    """All registered rules; the presence rules have SQL below, the others a test by hand."""
    docs, fields = t.entity("documents"), t.fields
    results = engine.evaluate_rules(t.applications, docs, fields, t.detections, AS_OF)
    return engine.related_documents(results, docs, fields, AS_OF)


@query(
    "presence_rule_documents",
    f"""WITH {_VALS} SELECT a.application_id, r.rule_id, d.document_id FROM e_applications a CROSS JOIN (VALUES {_DOC_ROWS}) AS r(rule_id, t)
 JOIN e_documents d ON d.application_id = a.application_id AND d.document_type = r.t
UNION ALL SELECT DISTINCT a.application_id, r.rule_id, v.document_id FROM e_applications a CROSS JOIN (VALUES {_FLD_ROWS}) AS r(rule_id, f, t, l)
 JOIN vals v ON v.application_id = a.application_id AND v.field_name = r.f AND v.document_type = r.t""",
)
def presence_rule_documents(t):
    """The documents behind the results of the document and field presence rules."""
    docs, fields = t.entity("documents"), t.fields
    of_documents = presence.document_rules(t.applications, docs)
    of_fields = presence.value_rule_results(
        t.applications, base.with_values(fields), catalogue.presence_rules()
    )
    return engine.related_documents(of_documents.unionByName(of_fields), docs, fields, AS_OF)
