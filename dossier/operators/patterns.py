"""Extraction patterns per document type: (field, pattern, reader of the raw value).

The first group of the first match is the raw value.
"""

from __future__ import annotations

from dossier import vocab
from dossier.functions import reading as R

_AMOUNT = r"([€£$]?\s?[\d.,]+)"
_SEP = r"\s*[:|-]?\s*"
_ACCOUNT_NUMBER = rf"(?:Account Number|A/?C No\.?|Account No\.?){_SEP}([A-Za-z0-9\-/ ]+)"
_ACCOUNT_TITLE = rf"(?:Account Title|Account Holder|Account Name){_SEP}(.+)"
_IBAN = rf"\bIBAN\b{_SEP}([A-Z]{{2}}\d{{2}}[A-Z0-9]{{10,30}})"
_CURRENCY = rf"(?:Currency|CCY){_SEP}([A-Z]{{3}})"
_PAGE_MARK = r"\n\n--- Page \d+ ---\n\n"
_TEXT_DATE = r"([A-Za-z0-9\-/.]+)"
_CASED = "(?dU)"
_CASED_LINES = "(?dmU)"

# Fixed values.
PATTERNS = {
    "BANK_STATEMENT": (
        ("account_holder", rf"(?:Account Holder|Account Name){_SEP}(.+)", None),
        ("account_number", _ACCOUNT_NUMBER, None),
        ("iban", _IBAN, None),
        ("bank_name", rf"(?:Bank Name|Bank){_SEP}(?!Statement\b)(.+)", None),
        ("statement_period", rf"(?:Statement Period|Period|For the period){_SEP}(.+)", R.period),
        ("opening_balance", rf"(?:Opening Balance|Opening){_SEP}{_AMOUNT}", R.amount),
        ("closing_balance", rf"(?:Closing Balance|Closing){_SEP}{_AMOUNT}", R.amount),
        ("total_credits", rf"(?:Total Credits|Total In|Credits){_SEP}{_AMOUNT}", R.amount),
        ("total_debits", rf"(?:Total Debits|Total Out|Debits){_SEP}{_AMOUNT}", R.amount),
        ("currency", _CURRENCY, None),
        (
            "transaction_count",
            rf"(?:Transactions|No\.? of Transactions){_SEP}(\d+)",
            R.whole_number,
        ),
    ),
    "PAYSLIP": (
        ("employee_name", rf"(?:Employee Name|Name of Employee){_SEP}(.+)", None),
        (
            "employee_id",
            rf"(?:Employee ID|Emp\.? ID|Staff No\.?|Personnel No\.?){_SEP}([A-Za-z0-9\-/]+)",
            None,
        ),
        ("employer_name", rf"(?:Employer Name|Employer|Company){_SEP}(.+)", None),
        ("gross_salary", rf"(?:Gross Salary|Gross Pay|Gross){_SEP}{_AMOUNT}", R.amount),
        ("net_salary", rf"(?:Net Salary|Net Pay|Net){_SEP}{_AMOUNT}", R.amount),
        ("salary_month", rf"(?:Salary Month|Pay Period|Month){_SEP}(.+)", R.salary_month),
        ("payment_date", rf"(?:Payment Date|Pay Date|Date Paid){_SEP}{_TEXT_DATE}", R.document_date),
    ),
    "ID_DOCUMENT": (
        ("full_name", rf"(?:Full Name|Name){_SEP}(.+)", None),
        (
            "date_of_birth",
            rf"(?:Date of Birth|DOB|Birth Date){_SEP}{_TEXT_DATE}",
            R.document_date,
        ),
        (
            "document_number",
            rf"(?:ID Number|Document Number|National ID No\.?|Passport No\.?){_SEP}([A-Za-z0-9\-]+)",
            None,
        ),
        ("nationality", rf"(?:Nationality|Nationality Code){_SEP}(.+)", None),
        ("issue_date", rf"(?:Issue Date|Date of Issue){_SEP}{_TEXT_DATE}", R.document_date),
        (
            "expiry_date",
            rf"(?:Expiry Date|Date of Expiry|Valid Until|Expires){_SEP}{_TEXT_DATE}",
            R.document_date,
        ),
    ),
    "TAX_DOCUMENT": (
        ("taxpayer_name", rf"(?:Taxpayer Name|Taxpayer's Name|Taxpayer){_SEP}(.+)", None),
        (
            "tax_reference_number",
            rf"(?:Tax Reference Number|Tax Reference|UTR|Tax ID){_SEP}([A-Za-z0-9\-]+)",
            None,
        ),
        (
            "tax_year",
            rf"(?:Tax Year|Assessment Year|Year){_SEP}((?:19|20)\d{{2}})",
            R.whole_number,
        ),
        (
            "gross_income",
            rf"(?:Gross Income|Total Income|Adjusted Gross Income){_SEP}{_AMOUNT}",
            R.amount,
        ),
        ("total_tax", rf"(?:Total Tax|Tax Due|Income Tax|Tax Payable){_SEP}{_AMOUNT}", R.amount),
        ("currency", _CURRENCY, None),
    ),
    vocab.BILATERAL: (
        ("organization_name", _CASED + r"(?<=;\nand\n)([^,\n(]+)", None),
        ("platform_name", r"(Digital Muhasil|PayMin|Paymere BCX|Paymir)", R.platform_name),
        (
            "transaction_charges",
            r"(?s)5\.2\.?\s*Transaction Charges:?\s*\n(.*?)(?=\n\d+\.\s+(?-i:[A-Z][A-Z\s&,]*)\n"
            r"|\n--- page break ---\n|" + _PAGE_MARK + ")",
            R.without_watermark,
        ),
        ("account_holder", _ACCOUNT_TITLE, None),
        ("account_number", _ACCOUNT_NUMBER, None),
        ("iban", _IBAN, None),
        (
            "effective_date",
            r"on\s+this\s+(\d{1,2}\s+day\s+of\s+\d{1,2},\s*\d{4})",
            R.day_of_month,
        ),
    ),
    vocab.AUTHORITY: (
        (
            "focal_person_name",
            _CASED + r"(?:Mr|Mrs|Ms|Dr)\.?\s+([A-Za-z][A-Za-z.'\- ]*?)"
            r"(?=\s*[,(]|\n[^\n,()]{0,80}[,(]|\s+CNIC|\s+is\s+authorized)",
            None,
        ),
        (
            "focal_person_designation",
            r"(?:Mr|Mrs|Ms|Dr)\.?\s+[A-Za-z][A-Za-z.'\- ]*?(?:[,(]|\n(?=[^\n,()]{0,80}[,(]))\n?\s*"
            r"([^,()]+?)(?=[,()]|\s+is\s+authorized)",
            None,
        ),
        ("organization_name", r"on\s+(?:the\s+)?behalf\s+of\s+([^.\n]+(?:\n[^.\n]+)?)", None),
        ("account_holder", _ACCOUNT_TITLE, None),
        ("account_number", _ACCOUNT_NUMBER, None),
        ("iban", _IBAN, None),
    ),
    vocab.REQUIREMENT: (
        (
            "digitization_intent_confirmed",
            r"(KPITB'?S?\s+Fin\s*Tech\s+Unit|Khyber\s+Pakhtunkhwa\s+Information\s+Technology"
            r"\s+Board\s*\n?\(?KPITB\)?)",
            None,
        ),
        (
            "revenue_services_listed",
            r"((?:sources? of income|services offered|revenue[- ]generating services"
            r"|prescribed fees?)[^\n]*(?:\n[^\n]+){0,7})",
            None,
        ),
    ),
    vocab.ONE_LINK: (
        (
            "organization_name",
            r"Organization Name \(as per registration document\)\s*:\s*(.+)",
            R.single_line,
        ),
        ("account_number_or_iban", r"Bank Account Number\s*:\s*(.+)", R.last_reference),
        ("account_holder", r"Title of Account\s*:\s*(.+)", R.single_line),
        ("bank_name", r"Name of the Bank and branch\s*:\s*(.+)", R.single_line),
    ),
    vocab.CNIC_FRONT: (
        ("document_number", r"\b(\d{5}-\d{7}-\d)\b", None),
        ("full_name", _CASED_LINES + r"^Name[ \t]*$\r?\n(.+)$", None),
        (
            "date_of_expiry",
            _CASED_LINES + r"^Date of Issue[ \t]*$\r?\n^Date of Expiry[ \t]*$\r?\n[\d.]+[ \t]*\r?\n([\d.]+)",
            R.dotted_date,
        ),
    ),
    vocab.FORMAL_REQUEST: (
        (
            "organization_name",
            r"(?:OFFICE OF THE|DEPARTMENT OF|GOVERNMENT OF|TO THE|FROM[:|-]?)[^\n]*\n\s*(.+)",
            None,
        ),
        (
            "addressee",
            r"To,?\s*\n?\s*(The\s+Managing\s+Director[^\n,]*|Managing\s+Director[^\n,]*"
            r"|KPITB[^\n,]*|Khyber\s+Pakhtunkhwa\s+Information\s+Technology\s+Board[^\n,]*)",
            None,
        ),
        ("subject", rf"Subject{_SEP}(.+)", None),
        (
            "date",
            rf"(?:Date|Dated){_SEP}([0-9]{{1,2}}[/\-.][0-9]{{1,2}}[/\-.][0-9]{{2,4}}"
            r"|[0-9]{4}[/\-.][0-9]{1,2}[/\-.][0-9]{1,2}|\d{1,2}\s+[A-Za-z]+\s+\d{4})",
            R.document_date,
        ),
        (
            "focal_person_name",
            r"(?:Focal Person Name|Focal Person|Contact Person|Authorized Representative"
            rf"|Submitted By|Signed By){_SEP}(.+)",
            None,
        ),
        ("focal_person_designation", r"(?:Designation|Title)[ \t]*[:|-][ \t]*(.+)", None),
    ),
    vocab.CERTIFICATE: (
        ("bank_name", r"\bBank(?: Name)?\s*:\s*(.+)", None),
        ("branch_name", r"(?:Branch Name|Branch)\s*:\s*(.+)", None),
        ("closing_balance", rf"(?:Closing Balance|Closing){_SEP}{_AMOUNT}", R.amount),
    ),
    vocab.TRIPARTITE: (
        (
            "party_1link",
            r"(?<!related to )((?:1\s*LINK|1-LINK|ONE[-\s]?LINK|ONELINK)[^,\n]*?)"
            r"(?=\s*\(hereinafter|\s*,|\s*\n|$)",
            None,
        ),
        (
            "party_kpitb",
            r"((?:KHYBER PAKHTUNKHWA INFORMATION(?:\s*(?:&|AND))?\s*TECHNOLOGY BOARD|KPITB))(?=[\s,])",
            None,
        ),
        (
            "party_subbiller",
            r"(?-i:([A-Z][A-Za-z0-9 ,&'()\-/]*?))\s+hereby irrevocably undertakes",
            None,
        ),
        (
            "account_holder",
            rf"(?:Account Title|Title of Account|Account Holder){_SEP}(.+)",
            None,
        ),
        (
            "account_number",
            r"(?:Account Number|A/?C No\.?|Account No\.?)(?:\s*\(IBAN\))?\s*[:|-]?\s*"
            r"(?:(?:[^A-Z0-9\n]*\n[^A-Z0-9\n]*.*?(?:\|[ \t]*)?)?([A-Z0-9]{10,30}))",
            None,
        ),
        ("branch_code", r"(?:Branch Code|Branch)\s*:\s*(.+)", None),
    ),
}
#: Older one-link letters name the organisation only in this sentence. Fixed value.
LEGACY_ORGANIZATION = (
    _CASED + r"([A-Z][A-Za-z,.\s]{3,60}?)\s+hereby authorizes [1I]\s*LINK to take actions"
)
#: Words that refer to the letter's own office instead of naming it. Fixed values.
GENERIC_ORGANIZATION = (
    r"(?i)^(?:(?:this|the(?:\s+said)?|said)(?:\s+(?:authority|board|office|department))?|directorate)$"
)
LETTERHEAD_SKIP = r"(?i)^(?:Ph|Phone|Fax|Email|Govt\.?|Government)\b"
OFFICE_TITLE = r"(?i)^OFFICE OF THE\b.*OFFICE[R]?$"
#: Keyword weights for texts without a stored type. Fixed values.
DETECTION_KEYWORDS = (
    (
        "BANK_STATEMENT",
        (
            ("account statement", 3),
            ("bank statement", 3),
            ("opening balance", 2),
            ("closing balance", 2),
            ("iban", 2),
            ("transactions", 1),
        ),
    ),
    (
        "PAYSLIP",
        (
            ("payslip", 3),
            ("pay slip", 3),
            ("salary slip", 3),
            ("gross salary", 2),
            ("net salary", 2),
            ("payment date", 1),
            ("employee id", 1),
        ),
    ),
    (
        "ID_DOCUMENT",
        (
            ("national id", 3),
            ("identity card", 3),
            ("passport", 3),
            ("date of birth", 2),
            ("expiry date", 2),
            ("id number", 1),
        ),
    ),
    (
        "TAX_DOCUMENT",
        (
            ("tax return", 3),
            ("tax reference", 2),
            ("taxpayer", 2),
            ("tax year", 2),
            ("income tax", 1),
        ),
    ),
)
#: Types whose holder, number and IBAN also come from a block of lines; the flag says
#: whether the block replaces a pattern's value or only fills a gap.
BANK_BLOCK_TYPES = {
    vocab.BILATERAL: (("account_holder", "account_number", "iban"), True),
    vocab.TRIPARTITE: (("account_holder", "account_number"), True),
    vocab.CERTIFICATE: (("account_holder", "account_number", "iban"), False),
}
