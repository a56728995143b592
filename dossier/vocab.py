"""Fixed values the results depend on: status words, document types, rule rows,
thresholds and messages. Everything here is configuration; jobs turn the tables
into literals or small broadcast frames."""

from __future__ import annotations

from typing import NamedTuple

# ---------------------------------------------------------------- statuses
# Fixed values.
APPLICATION_STATUSES = (
    "SUBMITTED",
    "PROCESSING",
    "PROCESSING_FAILED",
    "PENDING_REVIEW",
    "NEEDS_DOCUMENTS",
    "APPROVED",
    "REJECTED",
    "CORRECTED",
)
DECIDED_STATUSES = ("APPROVED", "REJECTED", "CORRECTED")
JOB_STATUSES = ("QUEUED", "PROCESSING", "COMPLETED", "FAILED", "RETRY_WAITING")
RULE_STATUSES = ("PASS", "FAIL", "WARNING", "PENDING_MANUAL_REVIEW")
#: Strictest first.
RULE_STATUS_PRECEDENCE = ("FAIL", "PENDING_MANUAL_REVIEW", "WARNING", "PASS")
STATUS_SEVERITY = {
    "FAIL": "ERROR",
    "WARNING": "WARNING",
    "PENDING_MANUAL_REVIEW": "WARNING",
    "PASS": "INFO",
}
QUEUE_RANK = {
    "SUBMITTED": 0,
    "NEEDS_DOCUMENTS": 0,
    "PROCESSING_FAILED": 0,
    "PENDING_REVIEW": 1,
    "PROCESSING": 2,
    "APPROVED": 3,
    "CORRECTED": 3,
    "REJECTED": 4,
}
QUEUE_RANK_OTHER = 5
REQUEST_FROM = ("SUBMITTED", "NEEDS_DOCUMENTS")
REJECT_FROM = ("SUBMITTED", "NEEDS_DOCUMENTS", "PROCESSING_FAILED")
SUBMIT_FROM = ("SUBMITTED", "NEEDS_DOCUMENTS")

# ---------------------------------------------------------------- documents
# Fixed values.
TRIPARTITE = "TRIPARTITE_AGREEMENT"
BILATERAL = "BILATERAL_AGREEMENT"
CERTIFICATE = "ACCOUNT_MAINTENANCE_CERTIFICATE"
ONE_LINK = "ONE_LINK_LETTER"
AUTHORITY = "AUTHORITY_LETTER"
REQUIREMENT = "BUSINESS_REQUIREMENT_DOCUMENT"
FORMAL_REQUEST = "FORMAL_REQUEST_LETTER"
CHARGES = "SCHEDULE_OF_CHARGES"
CNIC_FRONT = "CNIC_FRONT"
CNIC_BACK = "CNIC_BACK"
SUPPORTING = "OTHER_SUPPORTING_DOCUMENT"
BULK = "BULK_UPLOAD"
UNKNOWN = "UNKNOWN"

REQUIRED_TYPES = (
    TRIPARTITE,
    BILATERAL,
    CERTIFICATE,
    ONE_LINK,
    AUTHORITY,
    REQUIREMENT,
    FORMAL_REQUEST,
    CNIC_FRONT,
)
OPTIONAL_TYPES = (SUPPORTING,)
PLACEHOLDER_TYPES = (BULK,)
MAX_COPIES = {ONE_LINK: 3, TRIPARTITE: 3}

#: Upload checklist: category, label, required copies, stored types it counts.
UPLOAD_CATEGORIES = (
    ("AUTHORITY_LETTER", "Authority Letter", 1, (AUTHORITY,)),
    ("ACCOUNT_MAINTENANCE_CERTIFICATE", "Account Maintenance Certificate", 1, (CERTIFICATE,)),
    ("ONE_LINK_LETTER", "1-Link Application Form", 3, (ONE_LINK,)),
    ("TRIPARTITE_AGREEMENT", "Tripartite Agreement", 3, (TRIPARTITE,)),
    (
        "BUSINESS_REQUIREMENT_DOCUMENT",
        "Onboarding / Business Requirement Document",
        1,
        (REQUIREMENT,),
    ),
    ("BILATERAL_AGREEMENT", "Bilateral / Business Agreement", 1, (BILATERAL,)),
    ("CNIC", "CNIC (Front & Back)", 2, (CNIC_FRONT, CNIC_BACK)),
    ("FORMAL_REQUEST_LETTER", "Formal Request Letter", 1, (FORMAL_REQUEST,)),
)

# ---------------------------------------------------------------- thresholds
# Fixed values.
CONFIDENCE_THRESHOLD = 0.85
CONFIDENCE_WEIGHTS = {"regex": 0.50, "template": 0.30, "ocr": 0.20, "ai": 0.00}
#: Ties between sources go to the earlier one.
SOURCE_ORDER = ("regex", "template", "ocr", "ai")
REGEX_SCORES = {"invalid": 0.25, "missing": 0.0}
REGEX_SCORE_VALID = 1.0
LOW_OCR_CONFIDENCE = 0.5
TEMPLATE_MISMATCH_COVERAGE = 0.5
CONFIDENCE_FLOOR = 0.5
RECONCILIATION_TOLERANCE = "0.01"
BALANCE_EPSILON = 0.01
STATEMENT_MAX_AGE_DAYS = 365
MIN_BIRTH_YEAR = 1900
MAX_ATTEMPTS = 3
RETRY_BACKOFF_SECONDS = 30
STALE_AFTER_SECONDS = 900
MIN_DIGITAL_CHARS_PER_PAGE = 40
PREVIEW_LENGTH = 1000
PAGE_SEPARATOR = ("\n\n--- Page ", " ---\n\n")

REASON_VALID = "Validated by extraction"
REASON_REGEX_MISMATCH = "Regex pattern mismatch"
REASON_MISSING_CONTEXT = "Missing expected context"
REASON_TEMPLATE_MISMATCH = "Template mismatch"
REASON_LOW_OCR = "Low OCR confidence"

REVIEW_CRITICAL_FIELDS = (
    "iban",
    "account_number",
    "account_holder",
    "bank_name",
    "document_number",
    "date_of_birth",
    "expiry_date",
    "issue_date",
    "payment_date",
    "statement_period",
    "salary_month",
)
UNVERIFIED_STATUSES = ("PENDING_REVIEW", "CANNOT_VERIFY")

# ---------------------------------------------------------------- reviews
# Fixed values.
CHECKLIST_ITEMS = (
    "Bank Maintenance Certificate originality confirmed",
    "Authority Letter signature confirmed",
    "Account Maintenance Certificate signature confirmed",
    "1-Link Application signature confirmed",
    "Tripartite Agreement signature confirmed",
    "Business Requirement Document signature confirmed",
    "Formal Request Letter signature confirmed",
    "Schedule of Charges / Bilateral signature confirmed",
    "Account Maintenance Certificate stamp confirmed",
    "1-Link Application stamp confirmed",
    "Tripartite Agreement stamp confirmed",
    "Schedule of Charges / Bilateral stamp confirmed",
    "Critical validation errors reviewed",
    "Validation report reviewed",
)
DECISION_STATUS = {"APPROVE": "APPROVED", "CORRECT": "CORRECTED", "REJECT": "REJECTED"}
KNOWN_DECISIONS = ("APPROVE", "CORRECT", "REJECT", "CORRECTED")
COMMENT_APPROVED = (
    "The submitted documents have been reviewed and validated. All required documentation "
    "has been received and verification checks have been completed successfully."
)
COMMENT_REJECTED = (
    "The submitted documents have been reviewed. Unfortunately, the application could not be "
    "approved due to the issues identified in this report. Please review the issues and "
    "contact your relationship manager for further guidance."
)
COMMENT_NEEDS_DOCUMENTS = (
    "The submitted documents have been reviewed against the required documentation and "
    "verification criteria. Additional documents and/or clarification are required for the "
    "review to proceed. Please address the items identified in this report and provide the "
    "requested documents."
)
COMMENT_DEFAULT = (
    "The submitted documents are currently being reviewed. A final decision will be "
    "communicated once the review is complete."
)
COMMENT_BY_STATUS = {
    "APPROVED": COMMENT_APPROVED,
    "CORRECTED": COMMENT_APPROVED,
    "REJECTED": COMMENT_REJECTED,
    "NEEDS_DOCUMENTS": COMMENT_NEEDS_DOCUMENTS,
}
JOB_MESSAGES = {
    "QUEUED": ("QUEUED", "Waiting to start"),
    "RETRY_WAITING": ("QUEUED", "Waiting to retry"),
    "PROCESSING": ("PROCESSING", "Processing"),
    "COMPLETED": ("COMPLETED", "Processed successfully"),
    "FAILED": ("FAILED", "Needs attention"),
}

# ---------------------------------------------------------------- timeline
# Event type -> (kind, label).
HISTORY_KINDS = {
    "DOCUMENTS_REQUESTED": ("DOCUMENTS_REQUESTED", "Missing documents requested from applicant"),
    "DOCUMENTS_RECEIVED": ("DOCUMENTS_RECEIVED", "Documents received"),
    "OPERATOR_SUBMITTED": ("OPERATOR_SUBMITTED", "Application submitted by operator"),
    "OPERATOR_REJECTED": ("OPERATOR_REJECTED", "Application rejected by operator"),
    "SUBMITTED_FOR_PROCESSING": ("SUBMITTED_FOR_PROCESSING", "Submitted for processing"),
    "PROCESSING_FAILED": ("PROCESSING_FAILED", "Processing failed"),
    "REVIEW_APPROVED": ("REVIEW_DECISION", "Application approved"),
    "REVIEW_CORRECTED": ("REVIEW_DECISION", "Application corrected"),
    "REVIEW_REJECTED": ("REVIEW_DECISION", "Application rejected by reviewer"),
}
REVIEW_LABELS = {
    "APPROVE": "Application approved",
    "CORRECT": "Application corrected",
    "REJECT": "Application rejected by reviewer",
}
REVIEW_EVENTS = {
    "APPROVE": "REVIEW_APPROVED",
    "CORRECT": "REVIEW_CORRECTED",
    "REJECT": "REVIEW_REJECTED",
}

# ---------------------------------------------------------------- feedback
# Fixed values.
FEEDBACK_COLUMNS = (
    "id",
    "application_id",
    "document_id",
    "ocr_result_id",
    "field_name",
    "original_ocr_value",
    "normalized_value",
    "human_corrected_value",
    "confidence_score",
    "confidence_source",
    "correction_reason",
    "reviewer",
    "decision",
    "origin",
    "recorded_at",
)
LEARNING_COLUMNS = (
    "application_id",
    "document_type",
    "field_name",
    "original_ocr_value",
    "normalized_value",
    "human_corrected_value",
    "confidence_score",
    "confidence_source",
    "correction_reason",
    "decision",
    "origin",
    "recorded_at",
)
CONFIDENCE_BUCKETS = (
    ("0.00-0.20", 0.2),
    ("0.20-0.40", 0.4),
    ("0.40-0.60", 0.6),
    ("0.60-0.80", 0.8),
    ("0.80-1.00", 1.01),
)
COMPLETENESS_FIELDS = (
    "document_type",
    "normalized_value",
    "confidence_source",
    "correction_reason",
    "decision",
    "origin",
    "reviewer",
)
LEARNING_VERSION = "1.0.0"
TOP_FIELDS = 10

# ---------------------------------------------------------------- rules
# Fixed values.
RULE_CATEGORIES = {
    "document_completeness": "Document completeness",
    "field_presence": "Required field presence",
    "format": "Field format",
    "cross_document": "Cross-document consistency",
    "date": "Date and period",
    "visual": "Visual verification",
    "policy": "Policy compliance",
    "quality": "Data quality",
}
NOTHING_TO_VALIDATE = "No values of the required fields are present to validate"


class PresenceRule(NamedTuple):
    rule_id: str
    rule_name: str
    document_type: str


class FieldRule(NamedTuple):
    rule_id: str
    rule_name: str
    field_name: str
    document_type: str
    document_label: str


class VisualRule(NamedTuple):
    rule_id: str
    rule_name: str
    document_type: str
    detection_type: str


# Fixed values.
DOCUMENT_RULES = (
    PresenceRule("DOC_TRIPARTITE_PRESENT", "Tripartite agreement present", TRIPARTITE),
    PresenceRule("DOC_BILATERAL_PRESENT", "Bilateral agreement present", BILATERAL),
    PresenceRule("DOC_AMC_PRESENT", "Account maintenance certificate present", CERTIFICATE),
    PresenceRule("DOC_ONE_LINK_PRESENT", "One Link letter present", ONE_LINK),
    PresenceRule("DOC_AUTHORITY_LETTER_PRESENT", "Authority letter present", AUTHORITY),
    PresenceRule("DOC_BRD_PRESENT", "Business requirement document present", REQUIREMENT),
    PresenceRule("DOC_FORMAL_REQUEST_PRESENT", "Formal request letter present", FORMAL_REQUEST),
)
#: Defined but not part of the registered catalogue.
UNREGISTERED_DOCUMENT_RULES = (
    PresenceRule("DOC_SCHEDULE_OF_CHARGES_PRESENT", "Schedule of charges present", CHARGES),
)
_CERT_LABEL = "account maintenance certificate"
FIELD_RULES = (
    FieldRule(
        "FLD_IBAN_PRESENT",
        "IBAN present on account maintenance certificate",
        "iban",
        CERTIFICATE,
        _CERT_LABEL,
    ),
    FieldRule(
        "FLD_ACCOUNT_NUMBER_PRESENT",
        "Account number present on account maintenance certificate",
        "account_number",
        CERTIFICATE,
        _CERT_LABEL,
    ),
    FieldRule(
        "FLD_ACCOUNT_HOLDER_PRESENT",
        "Account holder present on account maintenance certificate",
        "account_holder",
        CERTIFICATE,
        _CERT_LABEL,
    ),
    FieldRule(
        "FLD_BANK_NAME_PRESENT",
        "Bank name present on account maintenance certificate",
        "bank_name",
        CERTIFICATE,
        _CERT_LABEL,
    ),
    FieldRule(
        "FLD_FORMAL_REQUEST_SUBJECT_PRESENT",
        "Subject present on formal request letter",
        "subject",
        FORMAL_REQUEST,
        "formal request letter",
    ),
    FieldRule(
        "FLD_FORMAL_REQUEST_ORGANIZATION_PRESENT",
        "Organization name present on formal request letter",
        "organization_name",
        FORMAL_REQUEST,
        "formal request letter",
    ),
    FieldRule(
        "FLD_AUTHORITY_LETTER_ORGANIZATION_PRESENT",
        "Organization name present on authority letter",
        "organization_name",
        AUTHORITY,
        "authority letter",
    ),
    FieldRule(
        "FLD_AUTHORITY_LETTER_FOCAL_PERSON_PRESENT",
        "Focal person name present on authority letter",
        "focal_person_name",
        AUTHORITY,
        "authority letter",
    ),
    FieldRule(
        "FLD_BRD_DIGITIZATION_INTENT_PRESENT",
        "Digitization intent confirmed on business requirement document",
        "digitization_intent_confirmed",
        REQUIREMENT,
        "business requirement document",
    ),
    FieldRule(
        "FLD_BILATERAL_PLATFORM_NAME_PRESENT",
        "Platform name present on bilateral agreement",
        "platform_name",
        BILATERAL,
        "bilateral agreement",
    ),
    FieldRule(
        "FLD_BILATERAL_EFFECTIVE_DATE_PRESENT",
        "Effective date present on bilateral agreement",
        "effective_date",
        BILATERAL,
        "bilateral agreement",
    ),
)
#: rule id, name, checked fields, shape key (see functions.shapes).
FORMAT_RULES = (
    ("FMT_IBAN", "IBAN has the canonical format", ("iban",), "canonical_iban"),
    (
        "FMT_CNIC",
        "Identity numbers have the canonical format",
        ("document_number", "tax_reference_number"),
        "canonical_cnic",
    ),
    (
        "FMT_ACCOUNT_NUMBER",
        "Account number has a valid format",
        ("account_number",),
        "rule_account_number",
    ),
    (
        "FMT_AMOUNT",
        "Monetary amounts have a valid format",
        ("opening_balance", "closing_balance", "total_credits", "total_debits"),
        "canonical_amount",
    ),
    (
        "FMT_DATE_SHAPE",
        "Dates use the canonical format",
        ("date_of_birth", "issue_date", "expiry_date", "payment_date"),
        "iso_date",
    ),
    ("FMT_ESTAMP", "E-Stamp has a valid format", ("e_stamp_id",), "e_stamp"),
)
CROSS_RULES = (
    (
        "CROSS_ACCOUNT_HOLDER_MATCH",
        "Account holder is consistent across documents",
        "account_holder",
        (CERTIFICATE, TRIPARTITE),
    ),
    (
        "CROSS_ACCOUNT_NUMBER_MATCH",
        "Account number is consistent across documents",
        "account_number",
        (CERTIFICATE, BILATERAL, TRIPARTITE),
    ),
    (
        "CROSS_IBAN_MATCH",
        "IBAN is consistent across documents",
        "iban",
        (CERTIFICATE, BILATERAL),
    ),
)
#: Defined but not part of the registered catalogue.
UNREGISTERED_CROSS_RULES = (
    (
        "CROSS_PERIOD_MATCH",
        "Statement period is consistent across documents",
        "statement_period",
        (CERTIFICATE, BILATERAL),
    ),
    (
        "CROSS_BRANCH_CODE_MATCH",
        "Branch code is consistent across documents",
        "branch_code",
        (ONE_LINK, TRIPARTITE, AUTHORITY),
    ),
)
ONE_LINK_RULE = (
    "CROSS_ONE_LINK_ACCOUNT_MATCH",
    "1-Link account number/IBAN is consistent with the AMC",
)
DATE_RULES = {
    "DATE_PERIOD_SEQUENCE": "Statement period is chronological",
    "DATE_PERIOD_WITHIN_RANGE": "Statement period is recent and not in the future",
    "DATE_ISSUE_PRECEDES_EXPIRY": "Issue date precedes expiry date",
    "DATE_PAYMENT_RECENCY": "Payment date is not in the future",
    "DATE_DOB_SANITY": "Date of birth is plausible",
    "DATE_ISSUE_PRESENT": "Issue date is present",
    "DATE_EXPIRY_PRESENT": "Expiry date is present",
    "DATE_CNIC_NOT_EXPIRED": "CNIC is not expired",
}
VISUAL_RULES = (
    VisualRule(
        "VIS_SIGNATURE_TRIPARTITE", "Tripartite agreement is signed", TRIPARTITE, "SIGNATURE"
    ),
    VisualRule(
        "VIS_SIGNATURE_AMC", "Account maintenance certificate is signed", CERTIFICATE, "SIGNATURE"
    ),
    VisualRule("VIS_SIGNATURE_ONE_LINK", "One Link letter is signed", ONE_LINK, "SIGNATURE"),
    VisualRule(
        "VIS_SIGNATURE_AUTHORITY_LETTER", "Authority letter is signed", AUTHORITY, "SIGNATURE"
    ),
    VisualRule(
        "VIS_SIGNATURE_BILATERAL", "Bilateral agreement is signed", BILATERAL, "SIGNATURE"
    ),
    VisualRule(
        "VIS_SIGNATURE_FORMAL_REQUEST",
        "Formal request letter is signed",
        FORMAL_REQUEST,
        "SIGNATURE",
    ),
    VisualRule("VIS_STAMP_TRIPARTITE", "Tripartite agreement is stamped", TRIPARTITE, "STAMP"),
    VisualRule(
        "VIS_STAMP_AMC", "Account maintenance certificate is stamped", CERTIFICATE, "STAMP"
    ),
    VisualRule("VIS_STAMP_ONE_LINK", "One Link letter is stamped", ONE_LINK, "STAMP"),
    VisualRule("VIS_STAMP_AUTHORITY_LETTER", "Authority letter is stamped", AUTHORITY, "STAMP"),
    VisualRule("VIS_STAMP_BILATERAL", "Bilateral agreement is stamped", BILATERAL, "STAMP"),
)
POLICY_RULES = {
    "POL_ACCOUNT_HOLDER_REAL": "Account holder is a real named entity",
    "POL_BALANCE_RECONCILIATION": "Opening balance reconciles with credits and debits",
    "POL_SINGLE_CURRENCY": "A single currency is used",
    "POL_PERIOD_SALARY_ALIGNED": "Salary month falls within the statement period",
}
QUALITY_RULES = {
    "QUAL_NORMALIZED_VALUES_CLEAN": "Normalized values are cleanly formatted",
    "QUAL_NO_EMPTY_VALUES": "No verified field has an empty value",
    "QUAL_CONFIDENCE_FLOOR": "Extracted fields meet the confidence floor",
    "QUAL_TRANSACTION_COUNT": "Transaction count is a positive integer",
}


def rule_catalogue() -> list[tuple[str, str, str]]:
    """(rule_id, rule_name, category) of every registered rule, in catalogue order."""
    rows = [(r.rule_id, r.rule_name, "document_completeness") for r in DOCUMENT_RULES]
    rows += [(r.rule_id, r.rule_name, "field_presence") for r in FIELD_RULES]
    rows += [(r[0], r[1], "format") for r in FORMAT_RULES]
    rows += [(r[0], r[1], "cross_document") for r in CROSS_RULES]
    rows.append((*ONE_LINK_RULE, "cross_document"))
    rows += [(i, n, "date") for i, n in DATE_RULES.items()]
    rows += [(r.rule_id, r.rule_name, "visual") for r in VISUAL_RULES]
    rows += [(i, n, "policy") for i, n in POLICY_RULES.items()]
    rows += [(i, n, "quality") for i, n in QUALITY_RULES.items()]
    return rows


# ---------------------------------------------------------------- reports
# Fixed values.
REPORT_GROUPS = (
    "Document Validation",
    "Format Validation",
    "Cross Document Validation",
    "Date Validation",
    "Signature Validation",
    "Stamp Validation",
    "Business Policy Validation",
    "Quality Validation",
)
REPORT_GROUP_OF_CATEGORY = {
    "document_completeness": "Document Validation",
    "field_presence": "Document Validation",
    "format": "Format Validation",
    "cross_document": "Cross Document Validation",
    "date": "Date Validation",
    "policy": "Business Policy Validation",
    "quality": "Quality Validation",
}
BLUR_MARKER = "Blur score"
DUPLICATE_MARKER = "is present more than once"
#: Code and message in report order; {details} takes the listed document types.
RECOMMENDATIONS = (
    ("MISSING_REQUIRED_DOCUMENT", "Ensure all required documents are uploaded: {details}."),
    (
        "DUPLICATE_REQUIRED_DOCUMENT",
        "Multiple copies were uploaded for: {details}. Confirm which copy is correct.",
    ),
    ("MISSING_SIGNATURE", "Review missing signatures on: {details}."),
    ("MISSING_STAMP", "Review missing stamps on: {details}."),
    ("IBAN_INCONSISTENCY", "Review failed IBAN consistency across documents."),
    ("HOLDER_INCONSISTENCY", "Review account holder consistency across documents."),
    ("ACCOUNT_NUMBER_INCONSISTENCY", "Review account number consistency across documents."),
    ("PERIOD_INCONSISTENCY", "Review statement period consistency across documents."),
    ("BALANCE_RECONCILIATION", "Review account balance reconciliation."),
    ("VERIFY_BLURRED_DOCUMENTS", "Verify blurred documents."),
    ("CORRECT_LOW_CONFIDENCE", "Correct low-confidence fields."),
    ("REVIEW_DATES", "Review document dates and statement period."),
    ("COMPLETE_PENDING_REVIEW", "Complete the manual review of pending items."),
    ("NO_ACTION_REQUIRED", "No corrective action required."),
)

# ---------------------------------------------------------------- normalization
# Fixed values.
NORMALIZATION_VERSION = "1.0.0"
BANK_ALIASES = {
    "HBL": "HABIB BANK LIMITED",
    "HABIB BANK": "HABIB BANK LIMITED",
    "HABIB BANK LTD": "HABIB BANK LIMITED",
    "HABIB BANK LIMITED": "HABIB BANK LIMITED",
    "UBL": "UNITED BANK LIMITED",
    "UNITED BANK": "UNITED BANK LIMITED",
    "UNITED BANK LTD": "UNITED BANK LIMITED",
    "UNITED BANK LIMITED": "UNITED BANK LIMITED",
    "MCB": "MCB BANK LIMITED",
    "MCB BANK": "MCB BANK LIMITED",
    "MCB BANK LIMITED": "MCB BANK LIMITED",
    "ABL": "ALLIED BANK LIMITED",
    "ALLIED BANK": "ALLIED BANK LIMITED",
    "ALLIED BANK LTD": "ALLIED BANK LIMITED",
    "ALLIED BANK LIMITED": "ALLIED BANK LIMITED",
    "MEEZAN BANK": "MEEZAN BANK LIMITED",
    "MEEZAN BANK LTD": "MEEZAN BANK LIMITED",
    "MEEZAN BANK LIMITED": "MEEZAN BANK LIMITED",
    "NBP": "NATIONAL BANK OF PAKISTAN",
    "NATIONAL BANK": "NATIONAL BANK OF PAKISTAN",
    "NATIONAL BANK OF PAKISTAN": "NATIONAL BANK OF PAKISTAN",
    "BOP": "BANK OF PUNJAB",
    "BANK OF PUNJAB": "BANK OF PUNJAB",
    "BANK ALFALAH": "BANK ALFALAH LIMITED",
    "BANK ALFALAH LTD": "BANK ALFALAH LIMITED",
    "BANK ALFALAH LIMITED": "BANK ALFALAH LIMITED",
}
BRANCH_ALIASES = {
    "BR": "BRANCH",
    "BRNCH": "BRANCH",
    "B/O": "BRANCH OFFICE",
    "H.O": "HEAD OFFICE",
    "HO": "HEAD OFFICE",
    "HEAD OFFICE": "HEAD OFFICE",
    "ISB": "ISLAMABAD",
    "LHR": "LAHORE",
    "KHI": "KARACHI",
    "KARACHI": "KARACHI",
    "LAHORE": "LAHORE",
    "ISLAMABAD": "ISLAMABAD",
    "M. TOWN": "MODEL TOWN",
    "MODEL TOWN": "MODEL TOWN",
    "SADDAR": "SADDAR",
    "GUJRAWALA": "GUJRANWALA",
}
FIELD_NORMALIZERS = {
    "iban": "iban",
    "account_number": "account_number",
    "account_holder": "title",
    "employee_name": "title",
    "employer_name": "title",
    "full_name": "title",
    "taxpayer_name": "title",
    "bank_name": "bank_name",
    "document_number": "cnic",
    "employee_id": "cnic",
    "tax_reference_number": "cnic",
    "date_of_birth": "date",
    "issue_date": "date",
    "expiry_date": "date",
    "payment_date": "date",
    "statement_period": "statement_period",
    "salary_month": "salary_month",
    "branch": "branch",
    "branch_name": "branch",
    "vendor_name": "vendor",
    "payee": "vendor",
}
DEFAULT_NORMALIZER = "general_text"
MONTHS = (
    "january february march april may june july august september october november december"
).split()

# ---------------------------------------------------------------- analysis
# Fixed values.
ANALYSIS_VERSION = "1.0.0"
EXPECTED_FIELDS = {
    "BANK_STATEMENT": (
        "account_holder",
        "account_number",
        "iban",
        "bank_name",
        "statement_period",
        "opening_balance",
        "closing_balance",
        "total_credits",
        "total_debits",
        "currency",
        "transaction_count",
    ),
    "PAYSLIP": (
        "employee_name",
        "employer_name",
        "gross_salary",
        "net_salary",
        "salary_month",
        "payment_date",
        "employee_id",
    ),
    "ID_DOCUMENT": (
        "full_name",
        "date_of_birth",
        "document_number",
        "nationality",
        "issue_date",
        "expiry_date",
    ),
    "TAX_DOCUMENT": (
        "taxpayer_name",
        "tax_reference_number",
        "tax_year",
        "gross_income",
        "total_tax",
        "currency",
    ),
    BILATERAL: (
        "organization_name",
        "platform_name",
        "transaction_charges",
        "account_holder",
        "account_number",
        "iban",
        "effective_date",
    ),
    AUTHORITY: (
        "focal_person_name",
        "focal_person_designation",
        "organization_name",
        "account_holder",
        "account_number",
        "iban",
    ),
    CERTIFICATE: (
        "account_holder",
        "account_number",
        "iban",
        "bank_name",
        "branch_name",
        "issue_date",
    ),
    TRIPARTITE: (
        "party_1link",
        "party_kpitb",
        "party_subbiller",
        "account_holder",
        "account_number",
        "branch_code",
    ),
    REQUIREMENT: ("digitization_intent_confirmed", "revenue_services_listed"),
    ONE_LINK: ("organization_name", "account_number_or_iban", "account_holder", "bank_name"),
    CNIC_FRONT: ("document_number", "full_name", "date_of_expiry"),
    FORMAL_REQUEST: (
        "organization_name",
        "addressee",
        "subject",
        "date",
        "focal_person_name",
        "focal_person_designation",
    ),
}
ANALYSIS_CRITICAL_FIELDS = {
    "BANK_STATEMENT": ("account_number", "account_holder", "opening_balance", "closing_balance"),
    "PAYSLIP": ("employee_name", "gross_salary", "net_salary", "salary_month"),
    "ID_DOCUMENT": ("full_name", "date_of_birth", "document_number", "expiry_date"),
    "TAX_DOCUMENT": ("taxpayer_name", "tax_reference_number", "tax_year", "gross_income"),
    BILATERAL: ("organization_name", "account_number", "transaction_charges"),
    AUTHORITY: ("focal_person_name", "focal_person_designation", "organization_name"),
    CERTIFICATE: ("account_holder", "account_number", "iban"),
    TRIPARTITE: (
        "party_1link",
        "party_kpitb",
        "party_subbiller",
        "account_holder",
        "account_number",
    ),
    REQUIREMENT: ("digitization_intent_confirmed",),
    ONE_LINK: ("organization_name",),
    CNIC_FRONT: ("document_number",),
    FORMAL_REQUEST: ("organization_name", "subject", "date"),
}
#: Validator of a field per document type; other expected fields need only be present.
FIELD_VALIDATORS = {
    "BANK_STATEMENT": {
        "account_number": "account_number",
        "iban": "iban_checksum",
        "currency": "currency",
        "opening_balance": "balance",
        "closing_balance": "balance",
        "statement_period": "period",
        "transaction_count": "non_negative",
    },
    "PAYSLIP": {
        "gross_salary": "amount",
        "net_salary": "amount",
        "salary_month": "salary_month",
        "payment_date": "date_not_future",
    },
    "ID_DOCUMENT": {
        "date_of_birth": "date_not_future",
        "issue_date": "date",
        "expiry_date": "date",
        "document_number": "document_number",
    },
    "TAX_DOCUMENT": {
        "tax_year": "tax_year",
        "gross_income": "amount",
        "total_tax": "amount",
        "currency": "currency",
    },
    BILATERAL: {
        "account_number": "account_number",
        "iban": "iban_checksum",
        "effective_date": "date",
    },
    AUTHORITY: {"account_number": "account_number", "iban": "iban_checksum"},
    CERTIFICATE: {
        "account_number": "account_number",
        "iban": "iban_checksum",
        "issue_date": "date_not_future",
    },
    TRIPARTITE: {"account_number": "account_number"},
    FORMAL_REQUEST: {"date": "date_not_future"},
}
#: Reader-facing names that are not simply the field name in title case.
FIELD_LABELS = {
    "account_holder": "Account holder",
    "account_number": "Account number",
    "iban": "IBAN",
    "bank_name": "Bank name",
    "statement_period": "Statement period",
    "opening_balance": "Opening balance",
    "closing_balance": "Closing balance",
    "total_credits": "Total credits",
    "total_debits": "Total debits",
    "currency": "Currency",
    "transaction_count": "Transaction count",
    "employee_name": "Employee name",
    "employer_name": "Employer name",
    "gross_salary": "Gross salary",
    "net_salary": "Net salary",
    "salary_month": "Salary month",
    "payment_date": "Payment date",
    "employee_id": "Employee id",
    "full_name": "Full name",
    "date_of_birth": "Date of birth",
    "document_number": "Document number",
    "nationality": "Nationality",
    "issue_date": "Issue date",
    "expiry_date": "Expiry date",
    "taxpayer_name": "Taxpayer name",
    "tax_reference_number": "Tax reference number",
    "tax_year": "Tax year",
    "gross_income": "Gross income",
    "total_tax": "Total tax",
    "organization_name": "Organization name",
    "platform_name": "Platform name",
    "transaction_charges": "Transaction charges",
    "effective_date": "Effective date",
    "focal_person_name": "Focal person name",
    "focal_person_designation": "Focal person designation",
    "branch_name": "Branch name",
    "branch_code": "Branch",
    "party_1link": "1-Link party",
    "party_kpitb": "KPITB party",
    "party_subbiller": "Sub-biller party",
    "digitization_intent_confirmed": "Digitization intent confirmation",
    "revenue_services_listed": "Revenue-generating services list",
    "addressee": "Addressee",
    "subject": "Subject",
    "date": "Date",
}
SCORE_WEIGHTS = (0.5, 0.3, 0.2)
SCORE_CUTOFFS = (("VERIFIED", 0.8), ("PARTIALLY_VERIFIED", 0.6), ("NEEDS_REVIEW", 0.4))


def field_label(name: str) -> str:
    return FIELD_LABELS.get(name, name.replace("_", " ").title())

# ---------------------------------------------------------------- technical checks
# Check id, name, what to do when it fails or warns.
TECHNICAL_CHECKS = (
    (
        "TECH_FILE_EXISTS",
        "File exists",
        "Ensure the document's file is present in storage and re-upload the document",
    ),
    (
        "TECH_FILE_READABLE",
        "File is readable",
        "Ensure the document's file is readable and re-upload the document",
    ),
    (
        "TECH_FILE_NOT_EMPTY",
        "File is not empty",
        "Re-upload the document with its full content",
    ),
    (
        "TECH_FILE_TYPE",
        "File type is supported",
        "Provide the document as a PDF, JPEG or PNG file",
    ),
    ("TECH_PDF_OPEN", "PDF can be opened", "Upload an undamaged PDF document"),
    (
        "TECH_PDF_PASSWORD",
        "PDF is not password protected",
        "Upload the PDF without password protection",
    ),
    (
        "TECH_PDF_PAGES",
        "PDF has at least one page",
        "Upload a PDF that contains at least one page",
    ),
    (
        "TECH_PDF_DIMENSIONS",
        "PDF page dimensions are valid",
        "Re-generate the PDF with valid page dimensions",
    ),
    (
        "TECH_PDF_RENDER",
        "PDF page can be rendered",
        "Re-upload the PDF so its pages can be rendered",
    ),
    (
        "TECH_IMAGE_LOAD",
        "Image loads successfully",
        "Re-scan or re-export the document as a valid image",
    ),
    (
        "TECH_IMAGE_RESOLUTION",
        "Image resolution meets minimum",
        "Re-scan the document at a resolution of at least 800x800 pixels",
    ),
    (
        "TECH_BLUR",
        "Image is not blurry",
        "Re-scan the document so the image is in focus",
    ),
    (
        "TECH_ROTATION",
        "Document is not rotated",
        "Re-scan the document so its content is oriented upright",
    ),
    (
        "TECH_BLANK_PAGE",
        "Page is not blank",
        "Re-scan the document so the page contains content",
    ),
)
READABILITY_CHECK = "TECH_READABILITY"
TECHNICALLY_FINE = "Document is technically suitable for processing"
TECHNICAL_GROUPS = {
    "file_accessible": ("TECH_FILE_EXISTS", "TECH_FILE_READABLE", "TECH_FILE_NOT_EMPTY"),
    "file_type_valid": ("TECH_FILE_TYPE",),
    "pdf_valid": ("TECH_PDF_OPEN", "TECH_PDF_PASSWORD", "TECH_PDF_PAGES", "TECH_PDF_DIMENSIONS"),
    "image_valid": ("TECH_IMAGE_LOAD", "TECH_IMAGE_RESOLUTION"),
}

#: Document type a presence, field or visual rule depends on.
RULE_TARGET_TYPE = (
    {r.rule_id: r.document_type for r in DOCUMENT_RULES + UNREGISTERED_DOCUMENT_RULES}
    | {r.rule_id: r.document_type for r in FIELD_RULES}
    | {r.rule_id: r.document_type for r in VISUAL_RULES}
)
#: Labels and required copies by stored type; unlisted types read as the first entry.
TYPE_LABELS = {t: label for _, label, _, types in UPLOAD_CATEGORIES for t in types} | {
    SUPPORTING: "Other Supporting Document",
    BULK: "Bulk Upload",
}
TYPE_COPIES = {t: n for _, _, n, types in UPLOAD_CATEGORIES for t in types} | {
    SUPPORTING: 0,
    BULK: 0,
}
DEFAULT_TYPE_LABEL = UPLOAD_CATEGORIES[0][1]
DEFAULT_TYPE_COPIES = UPLOAD_CATEGORIES[0][2]
NOT_YET_AVAILABLE = (
    "Required document is missing. This check will become available when the required "
    "document is provided."
)


def type_label(document_type: str) -> str:
    return TYPE_LABELS.get(document_type, DEFAULT_TYPE_LABEL)

# ---------------------------------------------------------------- page titles
# Fixed values, in matching order.
HEADER_ZONE = 0.33
CERTIFICATE_BANKS = (
    "THE BANK OF KHYBER",
    "BANK OF KHYBER",
    "NATIONAL BANK OF PAKISTAN",
    "ABHI MICROFINANCE BANK",
    "FINCA MICROFINANCE BANK",
    "AL BARAKA BANK",
    "ALLIED BANK",
    "APNA MICROFINANCE BANK",
    "ASKARI BANK",
    "BANK AL HABIB",
    "BANK ALFALAH",
    "BANKISLAMI",
    "BANK MAKRAMAH",
    "SUMMIT BANK",
    "THE BANK OF PUNJAB",
    "BANK OF PUNJAB",
    "DUBAI ISLAMIC BANK",
    "EASYPAISA",
    "FAYSAL BANK",
    "FIRST WOMEN BANK",
    "HABIB BANK LIMITED",
    "HABIBMETRO BANK",
    "HABIB METRO BANK",
    "ICBC PAKISTAN",
    "JS BANK",
    "MCB ISLAMIC BANK",
    "MCB BANK",
    "MEEZAN BANK",
    "MOBILINK MICROFINANCE BANK",
    "JAZZCASH",
    "NRSP MICROFINANCE BANK",
    "SAMBA BANK",
    "SINDH BANK",
    "SONERI BANK",
    "STANDARD CHARTERED BANK",
    "UNITED BANK LIMITED",
)
TITLE_PHRASES = (
    (TRIPARTITE, ("TRIPARTITE AGREEMENT",)),
    (
        BILATERAL,
        (
            "BILATERAL AGREEMENT",
            "SERVICE LEVEL AGREEMENT",
            "SUB-BILLER AGREEMENT",
            "SUBBILER AGREEMENT",
            "SUB BILLER AGREEMENT",
            "SCHEDULE OF CHARGES",
        ),
    ),
    (
        CERTIFICATE,
        ("ACCOUNT MAINTENANCE CERTIFICATE", "ACCOUNT MAINTENANCE", *CERTIFICATE_BANKS),
    ),
    (
        ONE_LINK,
        (
            "1LINK APPLICATION FORM",
            "1-LINK APPLICATION FORM",
            "ONE-LINK APPLICATION FORM",
            "ONE LINK APPLICATION FORM",
            "ONELINK APPLICATION FORM",
            "APPLICATION FORM (IN-DIRECT",
            "ONELINK",
            "ONE-LINK",
            "1LINK",
        ),
    ),
    (AUTHORITY, ("AUTHORITY LETTER", "AUTHORIZATION LETTER", "AUTHORIZATION")),
    (REQUIREMENT, ("BUSINESS REQUIREMENT DOCUMENT", "BUSINESS REQUIREMENT")),
    (
        FORMAL_REQUEST,
        ("FORMAL REQUEST LETTER", "FORMAL REQUEST", "SUBJECT: REQUEST FOR DIGITAL ACCOUNT"),
    ),
)
CONTINUATION_PHRASES = ("APPLICATION FORM (IN-DIRECT",)
FULL_PAGE_PHRASES = (
    (TRIPARTITE, ("PARTICIPATION MEMORANDUM",)),
    (BILATERAL, ("FOR DIGITAL PAYMENT COLLECTION VIA PAYMIR",)),
)
#: Too common in running text to count anywhere but at the start of a header line.
NOT_WEAK_PHRASES = ("1LINK", "ONELINK", "ONE-LINK", "AUTHORIZATION", *CERTIFICATE_BANKS)
CHECKLIST_MARKERS = ("CHECKLIST", "CHECK LIST")
ID_CARD_PHRASES = (
    "COMPUTERISED NATIONAL IDENTITY",
    "COMPUTERIZED NATIONAL IDENTITY",
    "NATIONAL IDENTITY CARD",
    "ISLAMIC REPUBLIC OF PAKISTAN",
)
ID_CARD_BACK_WORDS = (
    "ISSUING AUTHORITY",
    "ISSUE DATE",
    "DATE OF ISSUE",
    "PLACE OF ISSUE",
    "MANAGER",
    "THUMB",
    "QUALIFICATION",
)
LETTERHEAD_PREFIX = "OFFICE OF THE"
SUBJECT_PREFIX = "SUBJECT:"
SUBJECT_KEYWORDS = (
    "SUB-BILLER",
    "SUB- BILLER",
    "SUB BILLER",
    "SUBBILLER",
    "ON BOARDING",
    "ON-BOARDING",
    "ONBOARDING",
)
BALANCE_LABELS = ("CLOSING BALANCE", "AVERAGE BALANCE")
AUTHORITY_STATEMENT = (
    "AUTHORIZED TO DEAL WITH AND CONDUCT CORRESPONDENCE AND MATTERS RELATED TO 1-LINK AND "
    "THE KHYBER PAKHTUNKHWA INFORMATION TECHNOLOGY BOARD"
)
ONE_LINK_LABEL = "ORGANIZATIONNAME(ASPERREGISTRATIONDOCUMENT)"

# ---------------------------------------------------------------- files
# First bytes (hex) and the extension they stand for, in matching order.
MAGIC_PREFIXES = (
    ("255044462D", ".pdf"),
    ("89504E470D0A1A0A", ".png"),
    ("FFD8FF", ".jpg"),
    ("49492A00", ".tif"),
    ("4D4D002A", ".tif"),
    ("D0CF11E0A1B11AE1", ".doc"),
    ("504B0304", ".docx"),
)
MEDIA_TYPES = {
    ".pdf": "application/pdf",
    ".doc": "application/msword",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".tif": "image/tiff",
    ".tiff": "image/tiff",
}
GENERIC_MEDIA_TYPES = ("", "application/octet-stream", "binary/octet-stream")
MAX_FILENAME_LENGTH = 255
