"""Entity tables derived from the driver's star-schema tables.

Each entry is one SELECT that both Spark and DuckDB run, so an oracle starts from
exactly the same rows; only document ids are computed another way in Spark
(:func:`spark_text`). ``{name}`` stands for a driver table or for another entity.
``tables(spark, root)`` gives them as DataFrames.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier import vocab
from dossier.session import stored

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


_DOC_ID = (
    "((((l_orderkey * 200000 + l_partkey) * 10000 + l_suppkey) * 8 + l_linenumber) * 64"
    " + cast(l_quantity as bigint))"
)

_ID_HIGH = "((l_orderkey * 200000 + l_partkey) * 10000 + l_suppkey)"
_ID_LOW = "(cast(l_linenumber as bigint) * 64 + cast(l_quantity as bigint))"
#: The same numbers by shifts, which do not fail past 64 bits but keep the lower 64.
_WIDE_DOC_ID = f"(shiftleft({_ID_HIGH} + shiftright({_ID_LOW}, 9), 9) | ({_ID_LOW} & 511L))"


def _case(subject: str, values, default: str | None = None) -> str:
    """CASE over 0..n-1 with quoted text values (None gives NULL)."""

    def quoted(v):
        if v is None:
            return "NULL"
        # Line feeds and backslashes as codes: the two engines read escapes differently.
        text = str(v).replace("'", "''")
        text = text.replace("\\", "' || chr(92) || '").replace("\n", "' || chr(10) || '")
        return "'" + text + "'"

    arms = " ".join(f"WHEN {i} THEN {quoted(v)}" for i, v in enumerate(values))
    tail = f" ELSE {default}" if default else ""
    return f"CASE {subject} {arms}{tail} END"


def _values(rows) -> str:
    def cell(v):
        return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)


_DOC_TYPES = (
    vocab.TRIPARTITE,
    vocab.BILATERAL,
    vocab.CERTIFICATE,
    vocab.ONE_LINK,
    vocab.AUTHORITY,
    vocab.REQUIREMENT,
    vocab.FORMAL_REQUEST,
    vocab.CNIC_FRONT,
    vocab.SUPPORTING,
    vocab.CERTIFICATE,
    vocab.CHARGES,
    vocab.BULK,
)

_FIELD_NAMES = (
    "iban account_number account_holder bank_name opening_balance closing_balance "
    "total_credits total_debits statement_period salary_month issue_date expiry_date "
    "payment_date date_of_birth date_of_expiry currency transaction_count document_number "
    "tax_reference_number e_stamp_id subject organization_name focal_person_name "
    "digitization_intent_confirmed platform_name effective_date account_number_or_iban branch"
).split()

_AMOUNTS = "'opening_balance', 'closing_balance', 'total_credits', 'total_debits'"

#: Raw text of a field: the noise a reader of scanned pages would produce.
_RAW = f"""CASE field_name
 WHEN 'iban' THEN {{iban_raw}}
 WHEN 'account_number_or_iban' THEN CASE h % 2 WHEN 0 THEN acct ELSE {{iban_clean}} END
 WHEN 'account_number' THEN CASE h % 4 WHEN 0 THEN acct
   WHEN 1 THEN substr(acct, 1, 2) || '-' || substr(acct, 3, 4) || ' ' || substr(acct, 7)
   WHEN 2 THEN ' ' || acct || '/0.1' ELSE 'ab' || acct END
 WHEN 'account_holder' THEN CASE h % 5 WHEN 0 THEN 'merchant  ' || cast(a % 500 as string)
   WHEN 1 THEN ' Merchant ' || cast(a % 500 as string) || chr(9) WHEN 2 THEN 'n/a'
   ELSE 'MERCHANT ' || cast(a % 500 as string) END
 WHEN 'bank_name' THEN {_case("h % 6", ("hbl", " United  Bank ", "MCB BANK", "nbp", "Bank Alfalah ltd", "Some Local Bank"))}
 WHEN 'statement_period' THEN CASE h % 6 WHEN 0 THEN d_iso || ' to ' || d_iso2
   WHEN 1 THEN d_dmy || ' - ' || d_dmy2 WHEN 2 THEN '2024-13-45 - ' || d_iso
   WHEN 3 THEN 'from ' || d_iso WHEN 4 THEN d_dmy || '  -  ' || d_iso2
   ELSE d_iso2 || ' to ' || d_iso END
 WHEN 'salary_month' THEN CASE h % 5 WHEN 0 THEN substr(d_iso, 1, 7)
   WHEN 1 THEN substr(d_dmy, 4) WHEN 2 THEN 'Mar 2023' WHEN 3 THEN 'september-2023' ELSE 'soon' END
 WHEN 'currency' THEN {_case("h % 3", ("PKR", "PKR ", "usd"))}
 WHEN 'transaction_count' THEN {_case("h % 4", ("12", "0", "x7", "480"))}
 WHEN 'document_number' THEN CASE h % 3 WHEN 0 THEN '35202' || substr(acct, 1, 7) || '3'
   WHEN 1 THEN '35202-' || substr(acct, 1, 7) || '-3' ELSE 'doc ' || acct END
 WHEN 'tax_reference_number' THEN '42101 ' || substr(acct, 1, 7) || ' 9'
 WHEN 'e_stamp_id' THEN {_case("h % 3", ("STAMP-123456", "stamp-654321", "STAMP-12"))}
 WHEN 'branch' THEN {_case("h % 5", ("h.o br", "M. Town brnch", "KHI main", "saddar b/o", "gujrawala  cantt"))}
 ELSE CASE WHEN field_name IN ({_AMOUNTS}) THEN
     CASE h % 4 WHEN 0 THEN cast(h * 10 as string) || '.50' WHEN 1 THEN '1,' || substr(cast(1000 + h as string), 2) || '.00'
       WHEN 2 THEN cast(h as string) ELSE 'Rs ' || cast(h as string) END
   WHEN field_name IN ('issue_date', 'expiry_date', 'payment_date', 'date_of_birth', 'date_of_expiry', 'effective_date') THEN
     CASE h % 7 WHEN 0 THEN d_iso WHEN 1 THEN d_dmy WHEN 2 THEN '1/13/2024' WHEN 3 THEN '5 mar 2023'
       WHEN 4 THEN 'March 5, 2023' WHEN 5 THEN '2024-13-45' ELSE '13 foo' END
   ELSE CASE h % 4 WHEN 0 THEN 'Town  Office ' || cast(a % 50 as string) WHEN 1 THEN ' ' || field_name || ' text'
     WHEN 2 THEN '   ' ELSE 'Office' || chr(10) || 'Block ' || cast(h as string) END END END""".replace(
    "{iban_clean}", "('PK36SCBL' || lpad(acct, 16, '0'))"
).replace(
    "{iban_raw}",
    "CASE h % 5 WHEN 0 THEN 'PK36SCBL' || lpad(acct, 16, '0')"
    " WHEN 1 THEN 'pk36 scbl ' || lpad(acct, 16, '0') WHEN 2 THEN 'PK36-SCBL-' || lpad(acct, 16, '0')"
    " WHEN 3 THEN 'PK' || acct ELSE 'PK36SCBL' || lpad(acct, 16, '0') || ' ' END",
)

#: Value a normalization run would have stored, again with some noise.
_NORM = f"""CASE WHEN h % 9 = 0 THEN NULL WHEN h % 23 = 0 THEN '  ' ELSE CASE field_name
 WHEN 'iban' THEN CASE WHEN h % 7 = 0 THEN 'PK3' || acct ELSE 'PK36SCBL' || lpad(acct, 16, '0') END
 WHEN 'account_number_or_iban' THEN CASE h % 3 WHEN 0 THEN acct WHEN 1 THEN 'PK36SCBL' || lpad(acct, 16, '0') ELSE acct || '9' END
 WHEN 'account_number' THEN CASE WHEN h % 8 = 0 THEN 'A-1' ELSE acct END
 WHEN 'account_holder' THEN CASE WHEN h % 6 = 0 THEN 'N/A' ELSE 'MERCHANT ' || cast(a % 500 as string) END
 WHEN 'bank_name' THEN {_case("h % 3", ("HABIB BANK LIMITED", "MCB BANK LIMITED", "SOME  BANK"))}
 WHEN 'statement_period' THEN CASE h % 5 WHEN 0 THEN d_iso || ' - ' || d_iso2 WHEN 1 THEN d_iso2 || ' - ' || d_iso
   WHEN 2 THEN 'soon' WHEN 3 THEN '2024-01-01 - 2024-12-31' ELSE '2023-03-01 - 2023-09-30' END
 WHEN 'salary_month' THEN CASE h % 4 WHEN 0 THEN substr(d_iso, 1, 7) WHEN 1 THEN '2023-05' WHEN 2 THEN '199-05' ELSE '2024-02' END
 WHEN 'currency' THEN {_case("h % 4", ("PKR", "PKR", "PKR", "USD"))}
 WHEN 'transaction_count' THEN {_case("h % 4", ("12", "0", "x7", "480"))}
 WHEN 'document_number' THEN CASE WHEN h % 4 = 0 THEN acct ELSE '35202-' || substr(acct, 1, 7) || '-3' END
 WHEN 'tax_reference_number' THEN '42101-' || substr(acct, 1, 7) || '-9'
 WHEN 'e_stamp_id' THEN {_case("h % 3", ("STAMP-123456", "stamp-654321", "STAMP-12"))}
 ELSE CASE WHEN field_name IN ({_AMOUNTS}) THEN
     CASE h % 6 WHEN 0 THEN '1,234.50' WHEN 1 THEN 'Rs 5' WHEN 2 THEN '12.345' ELSE '100.00' END
   WHEN field_name IN ('issue_date', 'expiry_date', 'payment_date', 'date_of_birth', 'date_of_expiry', 'effective_date') THEN
     CASE h % 6 WHEN 0 THEN '2024-13-45' WHEN 1 THEN '2031-06-30' WHEN 2 THEN '1890-01-01' WHEN 3 THEN '5 March' ELSE d_iso END
   ELSE CASE WHEN h % 10 = 0 THEN 'OFFICE  1' ELSE 'OFFICE ' || cast(a % 50 as string) END END END END"""

_FIELD_BASE = f"""SELECT d.document_id, d.application_id, d.document_type, f.field_no, f.field_name,
 (d.partkey * 31 + d.suppkey * 17 + f.field_no * 7 + d.linenumber * 3) % 1000 AS h,
 d.application_id AS a,
 cast(10000000 + d.application_id * 13 + CASE WHEN (d.partkey + f.field_no) % 10 = 0 THEN 1 ELSE 0 END as string) AS acct,
 substr(cast(d.uploaded_at as string), 1, 10) AS d_iso,
 substr(cast(d.uploaded_at + INTERVAL '29' DAY as string), 1, 10) AS d_iso2
FROM {{e_documents}} d CROSS JOIN (VALUES {_values(enumerate(_FIELD_NAMES))}) AS f(field_no, field_name)
WHERE (d.partkey + d.suppkey * 3 + f.field_no * 5) % 6 = 0"""

_PAGE_HEADS = (
    "Tripartite Agreement\n",
    "page one\nAPPLICATION FORM (IN-DIRECT member)\n",
    "Application Form (In-Direct\n",
    "Account Maintenance Certificate\n",
    "MCB Bank\n",
    "Document Checklist\nTripartite Agreement\n",
    "Islamic Republic of Pakistan\nDate of Issue\n",
    "National Identity Card\nGender\n",
    "Office of the Director\nSubject: account\n",
    "- Subject: on-boarding of office\n",
    "the closing balance and average balance\n",
    "organization name (as per registration document)\n",
    "this refers to the bilateral agreement\n",
    "about a business requirement\n",
    "\n \n\n",
    "Onelink\n",
    "authorized to deal with and conduct correspondence and matters related to 1-link and the khyber pakhtunkhwa information technology board\n",
)
_FILE_NAMES = (
    "scan.pdf",
    "C:\\docs\\my file?.PDF",
    "photo.jpg",
    "photo.jpeg",
    "  ",
    "noextension",
    ".pdf",
    "a/b/..",
    "sheet.xlsx",
    "page.tif",
)
_TEXT_TYPES = (
    "BANK_STATEMENT",
    "PAYSLIP",
    "ID_DOCUMENT",
    "TAX_DOCUMENT",
    vocab.BILATERAL,
    vocab.AUTHORITY,
    vocab.CERTIFICATE,
    vocab.TRIPARTITE,
    vocab.REQUIREMENT,
    vocab.ONE_LINK,
    vocab.CNIC_FRONT,
    vocab.FORMAL_REQUEST,
    None,
)


def _text(*lines: str) -> str:
    """Concatenation of line expressions with line feeds."""
    return " || chr(10) || ".join(lines)


#: Labelled texts per type, 0..12; some lines are dropped or damaged by modulus.
_TEXTS = "CASE k % 13 " + " ".join(
    f"WHEN {i} THEN {body}"
    for i, body in enumerate(
        (
            _text(
                "'ACCOUNT STATEMENT'",
                "'Account Holder: ' || nm",
                "'Account Number: ' || acct",
                "'IBAN: ' || CASE WHEN k % 2 = 0 THEN 'GB82WEST12345698765432' ELSE 'GB00WEST12345698765432' END",
                "'Bank Name: Town Bank'",
                "'Statement Period: ' || CASE WHEN k % 2 = 0 THEN '01/02/2023 - 31/03/2023' ELSE d || ' to 2024-12-31' END",
                "'Opening Balance: ' || bal",
                "'Closing Balance: ' || CASE k % 4 WHEN 0 THEN bal WHEN 1 THEN '1,250.50' WHEN 2 THEN '1.250,50' ELSE '12,5' END",
                "CASE WHEN k % 3 = 0 THEN 'Total Credits: 10.00' || chr(10) || 'Total Debits: 10.00' ELSE 'no totals' END",
                "'Currency: EUR'",
                "'Transactions: ' || cast(k % 3 as string)",
            ),
            _text(
                "'Salary Slip'",
                "'Employee Name: ' || nm",
                "'Employee ID: E-' || cast(k as string)",
                "'Employer Name: ' || seg || ' Co'",
                "'Gross Salary: ' || bal",
                "'Net Salary: ' || CASE WHEN k % 2 = 0 THEN '1,000' ELSE '100' END",
                "'Salary Month: ' || CASE WHEN k % 3 = 0 THEN 'March 2023' ELSE '2023-3' END",
                "'Payment Date: ' || CASE k % 4 WHEN 0 THEN '2023-03-28' WHEN 1 THEN '05/04/2023' WHEN 2 THEN '2099-01-01' ELSE 'soon' END",
            ),
            _text(
                "'National ID card'",
                "'Full Name: ' || nm",
                "'Date of Birth: ' || CASE k % 3 WHEN 0 THEN '1980-02-30' WHEN 1 THEN '05/06/1990' ELSE '1850-01-01' END",
                "'ID Number: AB-' || acct",
                "'Nationality: PK'",
                "'Issue Date: 2020-01-01'",
                "'Expiry Date: ' || CASE WHEN k % 2 = 0 THEN '2019-12-31' ELSE '2030-12-31' END",
            ),
            _text(
                "'Tax return'",
                "'Taxpayer Name: ' || nm",
                "'Tax Reference: T' || acct",
                "'Tax Year: 20' || cast(10 + k % 14 as string)",
                "'Gross Income: ' || bal",
                "'Total Tax: ' || CASE WHEN k % 2 = 0 THEN '99999999' ELSE '10.5' END",
                "'Currency: usd'",
            ),
            _text(
                "'BILATERAL AGREEMENT between the Board;'",
                "'and'",
                "nm || ' Office, Town'",
                "'uses the paymir platform on this 11 day of 5, 2026'",
                "'Account Title'",
                "'Account No'",
                "'Office of the Town Board ' || seg",
                "acct",
                "'5.2 Transaction Charges:'",
                "'PKR 10 per item'",
                "'6. GENERAL TERMS'",
                "'end'",
            ),
            _text(
                "'Directorate of ' || seg || ' Affairs'",
                "'AUTHORITY LETTER'",
                "'Mr. Sample Person, Deputy Director, is authorized on behalf of ' || CASE WHEN k % 2 = 0 THEN 'the ' || seg || ' office' ELSE 'this directorate' END",
                "'Account Title: ' || nm",
                "'Account Number: ' || acct",
            ),
            _text(
                "'ACCOUNT MAINTENANCE CERTIFICATE'",
                "'Date: 0' || cast(1 + k % 9 as string) || '-03-2024'",
                "'Bank Name: Town Bank'",
                "'Branch: Main ' || cast(k % 7 as string)",
                "'This is to certify that the account is maintained'",
                "'Title of Account: ' || nm",
                "'Account No: ' || acct || CASE WHEN k % 2 = 0 THEN ' (PK36SCBL0000001123456702)' ELSE '' END",
                "'IBAN: PK36SCBL0000001123456702'",
            ),
            _text(
                "'TRIPARTITE AGREEMENT'",
                "'1LINK (Private) Limited, and KPITB , with'",
                "seg || ' Town Office hereby irrevocably undertakes'",
                "'Title of Account: ' || seg || ' Fund'",
                "'Account Number: ' || acct || '00'",
                "'Branch Code: 0' || cast(k % 90 as string)",
            ),
            _text(
                "'BUSINESS REQUIREMENT'",
                "'we join ' || CASE WHEN k % 2 = 0 THEN 'KPITB''s FinTech Unit' ELSE 'nothing' END",
                "'Services offered: fees'",
                "'licences ' || seg",
            ),
            _text(
                "'1LINK APPLICATION FORM'",
                "'Organization Name (as per registration document): ' || nm || '  Ltd'",
                "'Bank Account Number: no ' || acct",
                "'Title of Account: ' || seg",
                "'Name of the Bank and branch: Town Bank'",
            ),
            _text(
                "'Name'",
                "nm",
                "'35202-' || substr(acct, 1, 7) || '-3'",
                "'Date of Issue'",
                "'Date of Expiry'",
                "'01.02.2020'",
                "'0' || cast(1 + k % 9 as string) || '.02.2030'",
            ),
            _text(
                "'OFFICE OF THE DIRECTOR'",
                "seg || ' Town'",
                "'Date: 05/06/2023'",
                "'To, The Managing Director KPITB'",
                "'Subject: request for ' || seg",
                "'Focal Person: ' || nm",
                "'Designation: Clerk'",
            ),
            _text("'plain text with iban and opening balance ' || nm", "'no type stored'"),
        )
    )
) + " END"

#: Account blocks in the layouts that occur, with what is to be read from them: text, holder,
#: number and IBAN.
_ACCOUNT_LAYOUTS = (
    (_text("'Title of Account: ' || nm", "'Account No: ' || acct", "'IBAN: ' || iban"), "nm", "acct", "iban"),
    (_text("'Account Holder: ' || nm", "'Account No / IBAN: ' || acct || ' / ' || iban"), "nm", "acct", "iban"),
    (_text("'Account No: ' || substr(acct, 1, 4) || '/' || substr(acct, 5)"), "NULL", "substr(acct, 1, 4) || '/' || substr(acct, 5)", "NULL"),
    (_text("'account number (1BAN) ' || iban || ' titled as Tehsil General Account'"), "NULL", "iban", "iban"),
    (_text("'S.No'", "'Bank Name'", "'Branch 2'", "'Account Title'", "'Account Number'", "'1'", "'ABC Bank'", "nm", "acct"), "nm", "acct", "NULL"),
    (_text("'S.No'", "'Bank Name'", "'IENT'", "'Account Title'", "'Account Number'", "'1'", "'ABC Bank'", "nm", "acct"), "nm", "acct", "NULL"),
    (_text("'Account Title'", "nm", "'Account Number'", "acct", "'end'"), "nm", "acct", "NULL"),
    (_text("'Account Title'", "'DG ' || seg || ' (TOWN DEVELOPMENT'", "'AUTHORITY)'", "'DEVELOPMENT FUND'", "'Account No. (T-24 System)'", "acct"), "'DG ' || seg || ' (TOWN DEVELOPMENT AUTHORITY)'", "acct", "NULL"),
    (_text("'Account Title:.... ' || nm", "'Account No: ' || iban"), "nm", "iban", "iban"),
    (_text("'Account No: ' || acct || ' (' || iban || ')'"), "NULL", "acct", "iban"),
    (_text("'We keep this in the name of Town Council.'", "'A/C No. ' || acct || ' held here'"), "'Town Council'", "acct", "NULL"),
    (_text("'Account Title'", "'Account Number'", "'Currency'", "nm", "acct", "'PKR'"), "nm", "acct", "NULL"),
    (_text("'Account No: 123'", "'Account Title: N/A'", "'Account Number: ' || iban || '/' || acct"), "NULL", "acct", "iban"),
)

ENTITIES: dict[str, str] = {
    "e_account_texts": "SELECT document_id, "
    + ", ".join(
        "CASE k % 13 " + " ".join(f"WHEN {i} THEN {row[c]}" for i, row in enumerate(_ACCOUNT_LAYOUTS)) + f" END AS {name}"
        for c, name in enumerate(("raw_text", "holder", "number", "iban"))
    )
    + """ FROM (SELECT c_custkey AS document_id, c_custkey AS k, c_name AS nm, c_mktsegment AS seg, cast(50000000 + c_custkey * 7 as string) AS acct,
 'PK36SCBL' || lpad(cast(c_custkey * 31 as string), 16, '0') AS iban FROM {customer}) c""",
    "e_applications": f"""SELECT o_orderkey AS application_id,
 {_case("o_orderkey % 8", vocab.APPLICATION_STATUSES)} AS status,
 o_orderdate AS submitted_at,
 o_orderdate + INTERVAL '1' DAY * cast(o_custkey % 30 as int) AS updated_at,
 'operator_' || cast(o_custkey % 50 as string) AS created_by,
 CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'Merchant ' || cast(o_custkey as string) END AS name,
 {_case("o_orderkey % 5", ("  ", None, " Needs a look ", ""), "'ok'")} AS reviewer_comments
FROM {{orders}}""",
    "e_documents": f"""SELECT {_DOC_ID} AS document_id, l_orderkey AS application_id,
 {_case("(l_partkey + l_linenumber) % 12", _DOC_TYPES)} AS document_type,
 'scan_' || cast(l_partkey as string) || '.pdf' AS original_filename,
 l_shipdate AS uploaded_at,
 {_case("l_suppkey % 5", ("UPLOADED", "PENDING", "PROCESSING", "COMPLETED", "FAILED"))} AS processing_status,
 l_partkey AS partkey, l_suppkey AS suppkey, l_linenumber AS linenumber
FROM {{lineitem}}""",
    "e_history": """SELECT event_id AS id, user_id AS application_id,
 CASE event_type WHEN 'signup' THEN 'DOCUMENTS_REQUESTED' WHEN 'purchase' THEN 'DOCUMENTS_RECEIVED'
  WHEN 'error' THEN CASE event_id % 2 WHEN 0 THEN 'PROCESSING_FAILED' ELSE 'OPERATOR_REJECTED' END
  WHEN 'click' THEN 'SUBMITTED_FOR_PROCESSING' ELSE 'OPERATOR_SUBMITTED' END AS event_type,
 'actor_' || cast(event_id % 20 as string) AS actor_name,
 CASE event_id % 3 WHEN 0 THEN 'OPERATOR' ELSE 'REVIEWER' END AS actor_role,
 CASE event_id % 4 WHEN 0 THEN 'please resend' WHEN 1 THEN '' ELSE NULL END AS reason,
 CASE event_id % 3 WHEN 0 THEN 'CNIC_FRONT,AUTHORITY_LETTER' WHEN 1 THEN 'BILATERAL_AGREEMENT' ELSE NULL END AS missing_text,
 ts AS created_at FROM {events}""",
    "e_jobs": """SELECT job_id, application_id, job_type, status, attempts, max_attempts, last_error, created_at,
 started_at, claimed_at,
 CASE WHEN status IN ('COMPLETED', 'FAILED') THEN coalesce(claimed_at, created_at) + INTERVAL '1' SECOND * cast(job_id % 900 as int) END AS completed_at,
 CASE WHEN status = 'RETRY_WAITING' AND job_id % 10 <> 0 THEN created_at + INTERVAL '1' SECOND * cast(job_id % 3000 as int) END AS retry_at
FROM (SELECT event_id AS job_id, user_id AS application_id,
  CASE event_id % 5 WHEN 0 THEN 'APPLICATION_PIPELINE' ELSE 'DOCUMENT_OCR' END AS job_type,
  CASE event_type WHEN 'signup' THEN 'QUEUED' WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED'
   WHEN 'click' THEN 'PROCESSING' ELSE 'RETRY_WAITING' END AS status,
  cast(event_id % 4 as int) AS attempts, 3 AS max_attempts,
  CASE WHEN event_id % 6 = 0 THEN 'timeout' END AS last_error, ts AS created_at,
  CASE WHEN event_type <> 'signup' THEN ts + INTERVAL '1' SECOND * cast(event_id % 600 as int) END AS started_at,
  CASE WHEN event_type <> 'signup' AND event_id % 9 <> 0 THEN ts + INTERVAL '1' SECOND * cast(event_id % 600 as int) END AS claimed_at
  FROM {events}) j""",
    "e_doc_jobs": """SELECT document_id AS job_id, application_id, document_id,
 CASE WHEN partkey % 7 = 0 THEN 'APPLICATION_PIPELINE' ELSE 'DOCUMENT_OCR' END AS job_type,
 CASE application_id % 5 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'FAILED'
  WHEN 2 THEN CASE suppkey % 2 WHEN 0 THEN 'COMPLETED' ELSE 'FAILED' END
  ELSE CASE suppkey % 5 WHEN 0 THEN 'QUEUED' WHEN 1 THEN 'PROCESSING' WHEN 2 THEN 'RETRY_WAITING'
   WHEN 3 THEN 'COMPLETED' ELSE 'FAILED' END END AS status,
 uploaded_at AS created_at FROM {e_documents} WHERE suppkey % 6 <> 0""",
    "e_reviews": """SELECT event_id AS id, user_id AS application_id, 'rev_' || cast(event_id % 9 as string) AS reviewer_name,
 ts + INTERVAL '1' HOUR AS reviewed_at,
 CASE event_id % 3 WHEN 0 THEN 'APPROVE' WHEN 1 THEN 'CORRECT' ELSE 'REJECT' END AS decision,
 CASE event_id % 4 WHEN 0 THEN 'looks fine' WHEN 1 THEN '' ELSE NULL END AS comments,
 CASE WHEN event_id % 3 = 2 THEN 'not readable' END AS rejection_reason
FROM {events} WHERE event_id % 7 = 0""",
    "e_fields": f"""SELECT document_id * 1 AS ocr_result_id, document_id, application_id, document_type, field_no, field_name,
 {_RAW} AS extracted_value,
 {_NORM} AS normalized_value,
 CASE WHEN h % 29 = 0 THEN NULL ELSE cast(h % 128 as double) / 128 END AS confidence_score,
 CASE h % 4 WHEN 0 THEN 'template' ELSE 'regex' END AS confidence_source,
 {_case("h % 8", ("AUTO_VERIFIED", "PENDING_REVIEW", "VERIFIED", "CORRECTED", "CANNOT_VERIFY", "AUTO_VERIFIED", None, "AUTO_VERIFIED"))} AS verification_status,
 CASE WHEN h % 8 = 3 THEN 'Fixed ' || cast(h as string) WHEN h % 31 = 0 THEN '' END AS human_corrected_value
FROM (SELECT b.*, substr(d_iso, 9, 2) || '/' || substr(d_iso, 6, 2) || '/' || substr(d_iso, 1, 4) AS d_dmy,
  substr(d_iso2, 9, 2) || '/' || substr(d_iso2, 6, 2) || '/' || substr(d_iso2, 1, 4) AS d_dmy2
 FROM ({_FIELD_BASE}) b) c""",
    "e_ocr": """SELECT document_id AS ocr_result_id, document_id,
 CASE WHEN partkey % 4 = 0 THEN 'PADDLE_OCR' ELSE 'PYMUPDF_TEXT_EXTRACTION' END AS processing_method,
 CASE WHEN partkey % 10 = 0 THEN NULL ELSE cast(partkey % 128 as double) / 128 END AS overall_confidence,
 CASE partkey % 8 WHEN 0 THEN ' ' || chr(10) WHEN 1 THEN '' ELSE original_filename || ' page text ' || cast(suppkey as string) END AS raw_ocr_text
FROM {e_documents} WHERE suppkey % 9 <> 0""",
    "e_analysis": """SELECT document_id, application_id, document_type,
 CASE partkey % 4 WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'PARTIALLY_VERIFIED' WHEN 2 THEN 'NEEDS_REVIEW' ELSE 'FAILED' END AS verification_status,
 cast(partkey % 128 as double) / 128 AS confidence_score
FROM {e_documents} WHERE suppkey % 8 <> 0""",
    "e_detections": """SELECT document_id, application_id, kind AS detection_type, suppkey % 5 <> 0 AS is_present,
 CASE WHEN suppkey % 10 = 0 THEN NULL ELSE cast(suppkey % 128 as double) / 128 END AS confidence
FROM {e_documents} CROSS JOIN (VALUES (0, 'SIGNATURE'), (1, 'STAMP')) AS k(kind_no, kind)
WHERE (partkey + kind_no) % 4 <> 0""",
    "e_checks": f"""SELECT document_id, application_id, rule_id,
 CASE (partkey + check_no) % 11 WHEN 0 THEN 'FAIL' WHEN 1 THEN 'WARNING' ELSE 'PASS' END AS status,
 CASE WHEN rule_id = 'TECH_BLUR' AND (partkey + check_no) % 11 = 0 THEN 'Blur score 12.0 is below the threshold'
  WHEN (partkey + check_no) % 11 = 0 THEN 'Check failed' END AS message
FROM {{e_documents}} CROSS JOIN (VALUES {_values(enumerate(("TECH_FILE_EXISTS", "TECH_FILE_READABLE", "TECH_FILE_NOT_EMPTY", "TECH_PDF_OPEN", "TECH_PDF_PAGES", "TECH_PDF_RENDER", "TECH_IMAGE_LOAD", "TECH_IMAGE_RESOLUTION", "TECH_BLUR", "TECH_ROTATION", "TECH_BLANK_PAGE", "TECH_READABILITY")))}) AS k(check_no, rule_id)
WHERE (suppkey + check_no) % 3 <> 0 AND suppkey % 7 <> 0""",
    "e_results": f"""SELECT d.application_id, d.document_id, r.rule_id, r.rule_name, r.rule_category,
 {_case("(d.partkey + d.suppkey) % 4", vocab.RULE_STATUSES)} AS status,
 CASE WHEN d.suppkey % 3 = 0 THEN 'Document is present more than once (2 documents)'
  WHEN d.suppkey % 3 = 1 THEN 'Required document is missing' ELSE 'Value does not match' END AS message,
 cast(d.partkey % 3 as int) AS related_count
FROM {{e_documents}} d JOIN (VALUES {_values((i, *row) for i, row in enumerate(vocab.rule_catalogue() + [("EXTRA_CHECK", "Extra check", "experimental")]))}) AS r(rule_no, rule_id, rule_name, rule_category)
 ON (d.partkey * 7 + d.linenumber) % 56 = r.rule_no""",
    "e_feedback": f"""SELECT id, application_id, document_id, document_id AS ocr_result_id, field_name, ocr_value, normalized_value,
 human_value, confidence_score, confidence_source, correction_reason, reviewer, decision, origin, recorded_at FROM (
SELECT {_DOC_ID} * 2 + copy AS id,
 CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE l_orderkey END AS application_id,
 CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE {_DOC_ID} END AS document_id,
 {_case("l_partkey % 7", ("iban", "account_number", "account_holder", "bank_name", " ", "issue_date", "currency"))} AS field_name,
 CASE WHEN l_suppkey % 13 = 0 THEN NULL ELSE 'v' || cast(l_partkey % 50 as string) END AS ocr_value,
 CASE WHEN l_partkey % 5 = 0 THEN '' WHEN l_partkey % 5 = 1 THEN NULL ELSE 'N' || cast(l_partkey as string) END AS normalized_value,
 CASE WHEN l_suppkey % 17 = 0 THEN '' WHEN l_partkey % 4 = 0 THEN 'v' || cast(l_partkey % 50 as string) ELSE 'w' || cast(l_partkey % 30 as string) END AS human_value,
 CASE WHEN l_partkey % 19 = 0 THEN NULL WHEN l_partkey % 23 = 0 THEN 1.5 ELSE cast((l_partkey % 101) / 100.0 as double) END AS confidence_score,
 CASE l_partkey % 3 WHEN 0 THEN 'regex' WHEN 1 THEN 'ocr' END AS confidence_source,
 CASE l_partkey % 4 WHEN 0 THEN 'typo' END AS correction_reason,
 CASE l_suppkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'rev_' || cast(l_suppkey % 6 as string) END AS reviewer,
 {_case("l_linenumber % 7", ("APPROVE", "CORRECT", "REJECT", "CORRECTED", None, "ESCALATE", "CORRECT"))} AS decision,
 CASE l_suppkey % 2 WHEN 0 THEN 'FINAL_HUMAN_REVIEW' ELSE 'LOW_CONFIDENCE_REVIEW' END AS origin,
 l_shipdate AS recorded_at
FROM {{lineitem}} CROSS JOIN (VALUES (0), (1)) AS c(copy) WHERE copy = 0 OR l_partkey % 20 = 3) f""",
    "e_audit": """SELECT event_id AS id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE user_id END AS application_id,
 'Rev_' || cast(user_id % 20 as string) AS username, 'audit.' || event_type AS action,
 CASE event_id % 3 WHEN 0 THEN 'INFO' WHEN 1 THEN 'WARNING' ELSE 'ERROR' END AS severity, ts AS performed_at
FROM {events}""",
    "e_checklists": f"""SELECT o.o_orderkey AS application_id, i.item_name, (o.o_custkey + i.item_no) % 3 <> 0 AS is_checked,
 CASE WHEN (o.o_custkey + i.item_no) % 3 <> 0 THEN 'rev_' || cast(o.o_custkey % 9 as string) END AS reviewer,
 o.o_orderdate AS checked_at
FROM {{orders}} o CROSS JOIN (VALUES {_values(enumerate(vocab.CHECKLIST_ITEMS))}) AS i(item_no, item_name)
WHERE (o.o_orderkey + i.item_no) % 4 <> 0""",
    "e_pages": f"""SELECT conv_id AS file_id, turn AS page_no, {_case("(conv_id * 7 + turn * 5) % 19", _PAGE_HEADS, "''")} || text AS text,
 CASE WHEN turn % 5 = 4 THEN NULL ELSE cast((conv_id + turn) % 64 as double) / 64 END AS confidence FROM {{conversations}}""",
    "e_uploads": f"""SELECT page_id AS file_id, {_case("page_id % 11", _FILE_NAMES, "'scan.pdf'")} AS filename,
 {_case("page_id % 6", ("application/pdf", "application/octet-stream", "image/png; q=1", None, "text/html"), "' IMAGE/JPEG '")} AS declared_type,
 cast(page_id % 9 as int) AS prefix_no, html FROM {{pages}}""",
    "e_texts": f"""SELECT document_id, document_type, cast((document_id % 64) as double) / 64 AS overall_confidence, application_id,
 {_TEXTS} AS raw_text FROM (SELECT c_custkey AS document_id, c_custkey - c_custkey % 15 AS application_id, {_case("c_custkey % 13", _TEXT_TYPES)} AS document_type,
  c_custkey AS k, c_name AS nm, c_mktsegment AS seg, cast(50000000 + c_custkey * 7 as string) AS acct, cast(cast(abs(c_acctbal) as decimal(18, 2)) as string) AS bal,
  '202' || cast(c_custkey % 4 as string) || '-0' || cast(1 + c_custkey % 9 as string) || '-1' || cast(c_custkey % 9 as string) AS d FROM {{customer}}) c""",
}


def spark_text(name: str) -> str:
    """An entity's SELECT for Spark. Document ids pass 64 bits from nine million orders on, ids
    of feedback from half of that; there they go on with the lower 64 bits instead of failing."""
    text = ENTITIES[name].replace(f"{_DOC_ID} * 2 + copy", f"(shiftleft({_WIDE_DOC_ID}, 1) | copy)")
    return text.replace(_DOC_ID, _WIDE_DOC_ID)


def needed(sql: str) -> list[str]:
    """Entities a statement uses, dependencies first."""
    found: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\be_[a-z_]+\b", text):
            if name in ENTITIES and name not in found:
                visit(ENTITIES[name])
                if name not in found:
                    found.append(name)

    visit(sql)
    return found


def oracle(sql: str) -> str:
    """Prefix ``sql`` with the entities it names, as DuckDB common table expressions."""
    plain = {t: t for t in DRIVER_TABLES} | {e: e for e in ENTITIES}
    body = sql.strip()
    extra = ""
    if body.upper().startswith("WITH "):
        body = body[5:]
        extra = ", "
    ctes = ", ".join(f"{n} AS ({ENTITIES[n].format_map(plain)})" for n in needed(sql))
    if not ctes:
        return sql.strip()
    return f"WITH {ctes}{extra or ' '}{body}"


class Tables:
    """Lazy access to driver tables and entities of one data folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in DRIVER_TABLES and f"e_{name}" not in ENTITIES:
            build = lambda: self.source(name)
        elif f"e_{name}" in ENTITIES or name in ENTITIES:
            build = lambda: self._entity(name if name in ENTITIES else f"e_{name}")
        else:
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = build()
        return self._cache[name]

    def source(self, name: str) -> DataFrame:
        """A driver table, also where an entity has the same name."""
        key = "source:" + name
        if key not in self._cache:
            table = self.spark.read.parquet(f"{self.root}/{name}.parquet")
            self._cache[key] = table
        return self._cache[key]

    def entity(self, name: str) -> DataFrame:
        return self._entity(f"e_{name}")

    def table(self, name: str) -> DataFrame:
        """An entity written out once, for queries that read it in several branches."""
        key = "stored:" + name
        if key not in self._cache:
            self._cache[key] = stored(self.entity(name))
        return self._cache[key]

    def _entity(self, name: str) -> DataFrame:
        key = "entity:" + name
        if key not in self._cache:
            text = spark_text(name)
            inputs = {
                n: self._entity(n) if n in ENTITIES else self.source(n)
                for n in set(re.findall(r"\{([a-z_]+)\}", text))
            }
            self._cache[key] = self.spark.sql(text, **inputs)
        return self._cache[key]


def history(t: Tables) -> DataFrame:
    """Lifecycle events with the missing types as an array."""
    return t.entity("history").select(
        "*", F.split("missing_text", ",").alias("missing_document_types")
    )
