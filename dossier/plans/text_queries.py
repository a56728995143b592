"""Page, file and document text queries."""

import re

from pyspark.sql import functions as F

from dossier import vocab
from dossier.operators import checks as CK
from dossier.operators import extract as X
from dossier.operators import patterns as PT
from dossier.operators import splitting as S
from dossier.operators.accountlines import account_block
from dossier.plans.catalog import AS_OF, query
from dossier.plans import text_sql as TS
from dossier.plans.document_queries import _REQUIRED
from dossier.session import spread, stored
from dossier.sources import files as FI
from dossier.sources import pages as P
from dossier.sources.bindings import _values


def _alt(phrases):
    return "|".join(re.escape(p).replace("\\ ", " ").replace("'", "''") for p in phrases)


_TITLES = [p for _, ps in vocab.TITLE_PHRASES for p in ps]
_TYPE_OF = "CASE hit " + " ".join(f"WHEN '{p}' THEN '{t}'" for t, ps in vocab.TITLE_PHRASES for p in ps) + " END"
_LOOSE = " ".join(
    f"WHEN regexp_matches(full_text, '{_alt([p for p in ps if p not in vocab.NOT_WEAK_PHRASES])}') THEN '{t}'"
    for t, ps in vocab.TITLE_PHRASES
)
_IDS = ", ".join(f"'{p}'" for p in vocab.ID_CARD_PHRASES)
_PUNCT = r"[!-/:-@\[-`{-~ ]*"
_CLASSIFIED = rf"""pl AS (SELECT file_id, page_no, list_filter(list_transform(string_split(text, chr(10)), lambda x: upper(trim(x))), lambda x: x <> '') AS lines FROM e_pages),
ph AS (SELECT *, array_to_string(list_slice(lines, 1, CAST(ceil(0.33 * len(lines)) AS INT)), chr(10)) AS header, array_to_string(lines, chr(10)) AS body, array_to_string(lines, ' ') AS full_text FROM pl),
pm AS (SELECT *, regexp_extract(header, '(?m)^(?:.*(?:CHECKLIST|CHECK LIST).*|(?:{_alt(vocab.ID_CARD_PHRASES)})|(?:{_alt(_TITLES)}))', 0) AS hit,
 regexp_extract(body, '(?m)^(?:PARTICIPATION MEMORANDUM|FOR DIGITAL PAYMENT COLLECTION VIA PAYMIR)', 0) AS whole,
 CASE WHEN regexp_matches(full_text, '{_alt(vocab.ID_CARD_BACK_WORDS)}') THEN 'CNIC_BACK' ELSE 'CNIC_FRONT' END AS side FROM ph),
pk AS (SELECT *, CASE WHEN regexp_matches(hit, 'CHECKLIST|CHECK LIST') THEN 0 WHEN hit IN ({_IDS}) THEN 1 WHEN hit <> '' THEN 2
 WHEN regexp_matches(header, '(?m)^{_PUNCT}OFFICE OF THE') AND regexp_matches(header, '(?m)^{_PUNCT}SUBJECT:') THEN 3 WHEN whole <> '' THEN 4
 WHEN contains(full_text, 'CLOSING BALANCE') AND contains(full_text, 'AVERAGE BALANCE') THEN 5 WHEN contains(full_text, 'SUBJECT:') AND regexp_matches(full_text, '{_alt(vocab.SUBJECT_KEYWORDS)}') THEN 6
 WHEN contains(full_text, '{vocab.AUTHORITY_STATEMENT}') THEN 7 WHEN contains(regexp_replace(full_text, '\s+', '', 'g'), '{vocab.ONE_LINK_LABEL}') THEN 8 ELSE 9 END AS k FROM pm),
pc AS (SELECT file_id, page_no, CASE k WHEN 0 THEN NULL WHEN 1 THEN side WHEN 2 THEN {_TYPE_OF} WHEN 3 THEN 'FORMAL_REQUEST_LETTER' WHEN 4 THEN CASE whole WHEN 'PARTICIPATION MEMORANDUM' THEN 'TRIPARTITE_AGREEMENT' ELSE 'BILATERAL_AGREEMENT' END
 WHEN 5 THEN 'ACCOUNT_MAINTENANCE_CERTIFICATE' WHEN 6 THEN 'FORMAL_REQUEST_LETTER' WHEN 7 THEN 'AUTHORITY_LETTER' WHEN 8 THEN 'ONE_LINK_LETTER'
 ELSE CASE {_LOOSE} WHEN regexp_matches(full_text, 'PARTICIPATION MEMORANDUM') THEN 'TRIPARTITE_AGREEMENT' WHEN regexp_matches(full_text, 'FOR DIGITAL PAYMENT COLLECTION VIA PAYMIR') THEN 'BILATERAL_AGREEMENT'
  WHEN regexp_matches(full_text, '{_alt(vocab.ID_CARD_PHRASES)}') THEN side END END AS detected_type, k BETWEEN 1 AND 8 AS strong, CASE k WHEN 2 THEN hit WHEN 4 THEN whole END AS phrase FROM pk)"""
_SEGMENTED = f"""{_CLASSIFIED}, lp AS (SELECT a.*, b.phrase AS last_phrase FROM pc a LEFT JOIN pc b ON b.file_id = a.file_id AND b.page_no = (SELECT max(c.page_no) FROM pc c WHERE c.file_id = a.file_id AND c.page_no < a.page_no AND c.strong)),
sg AS (SELECT file_id, page_no, detected_type, strong, phrase, CAST(sum(CASE WHEN strong AND NOT coalesce(phrase = 'APPLICATION FORM (IN-DIRECT' AND last_phrase = phrase, false) THEN 1 ELSE 0 END)
 OVER (PARTITION BY file_id ORDER BY page_no) AS BIGINT) AS island FROM lp)"""
_SPLIT = f"""{_SEGMENTED}, sd AS (SELECT file_id, island, CAST(island - min(island) OVER (PARTITION BY file_id) AS INT) AS document_index, coalesce(ty, 'OTHER_SUPPORTING_DOCUMENT') AS document_type, first_page, last_page, pages
 FROM (SELECT file_id, island, (array_agg(detected_type ORDER BY page_no))[1] AS ty, min(page_no) AS first_page, max(page_no) AS last_page, count(*) AS pages FROM sg GROUP BY 1, 2) z)"""


def _pages(t):
    lines = S.lines_of(F.col("text"))
    return t.entity("pages").select(
        "file_id", "page_no", (F.size(lines) * 10.0).alias("page_height"), lines.alias("lines")
    )


@query("classify_pages", f"WITH {_CLASSIFIED} SELECT * FROM pc")
def classify_pages(t):
    return S.classify_pages(_pages(t))


@query("segment_pages", f"WITH {_SEGMENTED} SELECT * FROM sg")
def segment_pages(t):
    return S.segment_pages(stored(S.classify_pages(_pages(t))))


@query("split_documents", f"WITH {_SPLIT} SELECT * FROM sd")
def split_documents(t):
    return S.split_documents(segment_pages(t))


@query(
    "absorption_warnings",
    f"""WITH {_SPLIT} SELECT sg.file_id, sd.document_index, sd.document_type, sg.page_no, sg.detected_type AS weakly_matched_type, 'page ' || (sg.page_no + 1) || ' weakly matches ' || sg.detected_type AS note FROM sg JOIN sd USING (file_id, island)
WHERE NOT sg.strong AND sg.detected_type IS NOT NULL AND sg.detected_type <> sd.document_type AND sg.page_no > sd.first_page""",
)
def absorption_warnings(t):
    return S.absorption_warnings(segment_pages(t))


def _bulk(t):
    return S.split_bulk_files(_pages(t), _stored_documents(t), AS_OF)


def _stored_documents(t):
    return t.entity("documents").selectExpr(
        "application_id", "document_type", "linenumber AS copy_number", "processing_status"
    )


@query(
    "bulk_file_documents",
    f"""WITH {_SPLIT}, m AS (SELECT application_id, document_type, max(linenumber) AS m FROM e_documents GROUP BY 1, 2)
SELECT sd.file_id AS application_id, sd.document_type, CAST(sd.document_index AS BIGINT) AS document_index, sd.first_page, sd.last_page,
 coalesce(m.m, 0) + row_number() OVER (PARTITION BY sd.file_id, sd.document_type ORDER BY sd.document_index) AS copy_number
FROM sd LEFT JOIN m ON m.application_id = sd.file_id AND m.document_type = sd.document_type""",
)
def bulk_file_documents(t):
    return _bulk(t)[0].drop("uploaded_at")


@query(
    "bulk_file_gate",
    f"""WITH {_SPLIT}, h AS (SELECT application_id, document_type FROM e_documents UNION ALL SELECT file_id, document_type FROM sd), req(x) AS (VALUES {_REQUIRED}),
g AS (SELECT DISTINCT file_id AS application_id, (SELECT count(*) FROM req WHERE x NOT IN (SELECT document_type FROM h WHERE h.application_id = sd.file_id)) AS missing,
 EXISTS (SELECT 1 FROM h WHERE h.application_id = sd.file_id AND document_type NOT IN (SELECT x FROM req) AND document_type NOT IN ('OTHER_SUPPORTING_DOCUMENT', 'BULK_UPLOAD')) AS odd,
 EXISTS (SELECT 1 FROM h WHERE h.application_id = sd.file_id AND (document_type IN (SELECT x FROM req) OR document_type = 'OTHER_SUPPORTING_DOCUMENT') GROUP BY document_type HAVING count(*) > 1) AS dup FROM sd)
SELECT application_id, CASE WHEN odd THEN 'INVALID_DOCUMENT_SET' WHEN dup THEN 'DUPLICATE_DOCUMENTS' WHEN missing > 0 THEN 'INCOMPLETE' ELSE 'COMPLETE' END AS completeness_status,
 CASE WHEN odd OR dup OR missing > 0 THEN 'NEEDS_DOCUMENTS' ELSE 'PROCESSING' END AS new_status FROM g""",
)
def bulk_file_gate(t):
    return _bulk(t)[1]


@query(
    "assemble_text",
    """SELECT file_id, string_agg(CASE WHEN rn = 1 THEN text ELSE chr(10) || chr(10) || '--- Page ' || rn || ' ---' || chr(10) || chr(10) || text END, '' ORDER BY page_no) AS text, CAST(count(*) AS INT) AS page_count
FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY page_no) AS rn FROM e_pages) p GROUP BY 1""",
)
def assemble_text(t):
    return P.assemble_text(t.entity("pages"))


@query(
    "route_text_source",
    """WITH f AS (SELECT file_id, trim(string_agg(text, '' ORDER BY page_no), ' ' || chr(10) || chr(9) || chr(13)) AS x, count(*) AS n FROM e_pages GROUP BY 1)
SELECT file_id, CASE WHEN file_id % 4 = 0 THEN 'IMAGE' WHEN length(x) / n::DOUBLE >= 40 THEN 'DIGITAL_PDF' ELSE 'SCANNED_PDF' END AS source, n AS page_count, length(x) AS text_length FROM f""",
)
def route_text_source(t):
    pages = t.entity("pages")
    files = pages.select("file_id").distinct().select(
        "file_id", F.when(F.col("file_id") % 4 == 0, ".png").otherwise(".pdf").alias("extension")
    )
    return P.route_text_source(pages, files)


@query(
    "flag_empty_text",
    "SELECT document_id, trim(raw_ocr_text, ' ' || chr(10)) = '' AS is_empty FROM e_ocr",
)
def flag_empty_text(t):
    return P.flag_empty_text(t.ocr)


@query(
    "text_source_metrics",
    """SELECT file_id, CAST(sum(length(text)) AS BIGINT) AS character_count, count(*) AS page_count, round(avg(confidence), 9) AS overall_confidence,
 count(*) FILTER (WHERE trim(text, ' ' || chr(10) || chr(9)) = '') AS empty_pages FROM e_pages GROUP BY 1""",
)
def text_source_metrics(t):
    return P.text_source_metrics(t.entity("pages")).withColumn(
        "overall_confidence", F.round("overall_confidence", 9)
    )


_SNIFFED = "CASE prefix_no WHEN 0 THEN '.pdf' WHEN 1 THEN '.png' WHEN 2 THEN '.jpg' WHEN 3 THEN '.tif' WHEN 4 THEN '.tif' WHEN 5 THEN '.doc' WHEN 6 THEN '.docx' END"


def _uploads(t):
    """Page bytes behind one of the known prefixes, or none, or no content at all."""
    prefixes = [F.unhex(F.lit(p)) for p, _ in vocab.MAGIC_PREFIXES]
    body = F.encode("html", "UTF-8")
    content = F.when(F.col("prefix_no") == 8, F.unhex(F.lit(""))).otherwise(body)
    for i, p in enumerate(prefixes):
        content = F.when(F.col("prefix_no") == i, F.concat(p, body)).otherwise(content)
    return t.uploads.select("file_id", "filename", "declared_type", content.alias("content"))


@query("sniffed_extension", f"SELECT file_id, {_SNIFFED} AS sniffed FROM e_uploads")
def sniffed_extension(t):
    return _uploads(t).select("file_id", FI.sniffed_extension(F.col("content")).alias("sniffed"))


_MEDIA = "CASE extension " + " ".join(f"WHEN '{e}' THEN '{m}'" for e, m in vocab.MEDIA_TYPES.items()) + " END"
_MEDIA_LIST = ", ".join(sorted(f"'{m}'" for m in set(vocab.MEDIA_TYPES.values())))


@query(
    "admit_files",
    f"""WITH u AS (SELECT file_id, filename, {_SNIFFED} AS sniffed, trim(lower(split_part(coalesce(declared_type, ''), ';', 1))) AS dec, prefix_no,
 CASE WHEN trim(filename) = '' THEN '' WHEN filename = 'a/b/..' THEN '' WHEN contains(filename, 'my file') THEN 'my file .PDF' ELSE filename END AS safe_name FROM e_uploads),
v AS (SELECT *, CASE WHEN safe_name IN ('', 'noextension', '.pdf') THEN '' ELSE lower(regexp_extract(safe_name, '(\\.[^.]*)$', 1)) END AS extension FROM u),
w AS (SELECT *, CASE WHEN trim(filename) = '' THEN 'The file has no filename' WHEN safe_name = '' THEN 'The file has no valid filename'
 WHEN {_MEDIA} IS NULL THEN 'File extension ' || CASE extension WHEN '' THEN '<none>' ELSE extension END || ' is not supported' WHEN prefix_no = 8 THEN 'The uploaded file is empty'
 WHEN sniffed IS NULL THEN 'File content could not be recognised as a supported document type' WHEN sniffed <> extension THEN 'File content (' || sniffed || ') does not match its extension (' || extension || ')'
 WHEN dec IN ('', 'application/octet-stream', 'binary/octet-stream') THEN NULL WHEN dec NOT IN ({_MEDIA_LIST}) THEN 'Declared media type (' || dec || ') is not supported'
 WHEN dec <> {_MEDIA} THEN 'Declared media type (' || dec || ') does not match file content' END AS error FROM v)
SELECT file_id, safe_name, extension, sniffed, error, error IS NULL AS admitted FROM w""".replace("\\\\.", "\\."),
)
def admit_files(t):
    return FI.admit_files(_uploads(t))


# Extraction and analysis of labelled texts.

_KEYWORDS = _values((i, k, w, n) for i, (k, ws) in enumerate(PT.DETECTION_KEYWORDS) for w, n in ws)
_DETECTED = f"""kw(i, k, w, n) AS (VALUES {_KEYWORDS}), ks AS (SELECT t.document_id, kw.k, kw.i, sum(kw.n) AS s FROM e_texts t JOIN kw ON contains(lower(t.raw_text), kw.w) GROUP BY 1, 2, 3),
kd AS (SELECT document_id, k FROM ks QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY s DESC, i) = 1)"""


def _texts(t):
    return t.texts.select(
        "document_id",
        "application_id",
        F.col("document_type").alias("stored_type"),
        F.col("raw_text").alias("text"),
        "overall_confidence",
    )


def _stored_or_none(t):
    """The checklist types keep their stored type; the others have to be detected."""
    kept = F.col("stored_type").isin(*vocab.REQUIRED_TYPES)
    odd = F.when(F.col("document_id") % 26 == 12, vocab.CHARGES)
    return _texts(t).withColumn("stored_type", F.when(kept, F.col("stored_type")).otherwise(odd))


@query(
    "detect_document_type",
    f"WITH {_DETECTED} SELECT t.document_id, coalesce(kd.k, 'UNKNOWN') AS document_type FROM e_texts t LEFT JOIN kd USING (document_id)",
)
def detect_document_type(t):
    return X.detect_document_type(_texts(t))


_REQ_LIST = ", ".join(f"'{r}'" for r in vocab.REQUIRED_TYPES)


@query(
    "route_document_type",
    f"""WITH {_DETECTED}, s AS (SELECT document_id, CASE WHEN document_type IN ({_REQ_LIST}) THEN document_type WHEN document_id % 26 = 12 THEN 'SCHEDULE_OF_CHARGES' END AS st FROM e_texts)
SELECT s.document_id, CASE WHEN s.st IN ({_REQ_LIST}) THEN s.st ELSE coalesce(kd.k, s.st, 'UNKNOWN') END AS document_type,
 CASE WHEN s.st IN ({_REQ_LIST}) THEN 'STORED' WHEN kd.k IS NOT NULL THEN 'DETECTED' WHEN s.st IS NOT NULL THEN 'RECOGNIZED_UNSUPPORTED' ELSE 'UNDETERMINED' END AS route FROM s LEFT JOIN kd USING (document_id)""",
)
def route_document_type(t):
    return X.route_document_type(_stored_or_none(t)).select("document_id", "document_type", "route")


def _long_fields(found):
    return found.select("document_id", F.explode("extracted_fields").alias("field_name", "value"))


def _found(t):
    """Pattern results as the stored table the later steps start from."""
    return stored(X.pattern_fields(_typed(t)).drop("text"))


def _typed(t):
    return spread(_texts(t), "document_id", "text").withColumn("document_type", F.col("stored_type"))


@query("pattern_fields", f"WITH {TS.FOUND} SELECT * FROM found")
def pattern_fields(t):
    return _long_fields(_found(t))


_BLOCK = """SELECT document_id, CASE document_id % 13 WHEN 4 THEN 'Office of the Town Board ' || c_mktsegment WHEN 6 THEN c_name WHEN 7 THEN c_mktsegment || ' Fund' END AS account_holder,
 CASE WHEN document_id % 13 = 7 THEN CAST(50000000 + document_id * 7 AS VARCHAR) || '00' ELSE CAST(50000000 + document_id * 7 AS VARCHAR) END AS account_number,
 CASE WHEN document_id % 13 = 6 THEN 'PK36SCBL0000001123456702' END AS iban FROM (SELECT c_custkey AS document_id, c_name, c_mktsegment FROM customer) c WHERE document_id % 13 IN (4, 6, 7)"""
#: What the block gives to the fields: in its place, or for certificates in a gap.
_OFFERED = f"""bl AS ({_BLOCK}), bf AS (SELECT document_id, 'account_holder' AS field_name, account_holder AS value FROM bl UNION ALL SELECT document_id, 'account_number', account_number FROM bl
 UNION ALL SELECT document_id, 'iban', iban FROM bl WHERE document_id % 13 <> 7),
ov AS (SELECT * FROM bf WHERE value IS NOT NULL AND (document_id % 13 <> 6 OR NOT EXISTS (SELECT 1 FROM found f WHERE f.document_id = bf.document_id AND f.field_name = bf.field_name)))"""


@query(
    "extract_fields",
    f"""WITH {TS.FOUND}, {_OFFERED} SELECT document_id, field_name, value FROM found WHERE NOT EXISTS (SELECT 1 FROM ov WHERE ov.document_id = found.document_id AND ov.field_name = found.field_name)
UNION ALL SELECT * FROM ov""",
)
def extract_fields(t):
    """All twelve types, as routed from stored type and keywords, with the account block."""
    return _long_fields(stored(X.extract_fields(X.route_document_type(_texts(t)))))


@query("bank_block", "SELECT document_id, holder AS account_holder, number AS account_number, iban FROM e_account_texts")
def bank_block(t):
    """Account blocks in thirteen layouts; every row says what its text holds."""
    texts = spread(t.account_texts.select("document_id", "raw_text"), "document_id", "raw_text")
    return texts.select("document_id", account_block(F.col("raw_text")).alias("b")).select("document_id", "b.*")


@query("bank_block_fields", _BLOCK)
def bank_block_fields(t):
    """The block within the texts of the three types that have one."""
    texts = spread(_texts(t).filter(F.col("stored_type").isin(*PT.BANK_BLOCK_TYPES)), "document_id", "text")
    return texts.select("document_id", account_block(F.col("text")).alias("b")).select("document_id", "b.*")


def _validated(t):
    return CK.validate_fields(_found(t), AS_OF)


@query("validate_fields", f"WITH {TS.FOUND}, {TS.VALID} SELECT document_id, field, validator, status FROM vl")
def validate_fields(t):
    return _validated(t).select("document_id", F.explode("validation_results").alias("v")).select(
        "document_id", "v.field", "v.validator", "v.status"
    )


@query(
    "fields_needing_clarification",
    f"""WITH {TS.FOUND}, {TS.VALID} SELECT t.document_id, t.document_type, coalesce(list(field ORDER BY field) FILTER (WHERE status <> 'valid'), []) AS field_names,
 round(coalesce(count(*) FILTER (WHERE status <> 'valid')::DOUBLE / nullif(count(field), 0), 0.0), 9) AS share_of_expected
FROM e_texts t LEFT JOIN vl ON vl.document_id = t.document_id GROUP BY 1, 2""",
)
def fields_needing_clarification(t):
    return X.fields_needing_clarification(_validated(t)).withColumn(
        "share_of_expected", F.round("share_of_expected", 9)
    )


def _resolved(t):
    names = F.array(F.lit("salary_month"), F.lit("payment_date"), F.lit("full_name"), F.lit("total_tax"))
    rows = _typed(t).filter("document_id % 2 = 0").select("document_id", F.explode(names).alias("field_name"))
    return rows.withColumn(
        "value",
        F.when(F.col("field_name") == "payment_date", "2023-03-30")
        .when(F.col("field_name") == "full_name", "Other Name")
        .when(F.col("field_name") == "total_tax", F.lit(None)),
    )


@query(
    "merge_fallback",
    f"""WITH {TS.FOUND}, {TS.VALID}, r AS (SELECT document_id, '2023-03-30' AS value FROM e_texts WHERE document_id % 2 = 0),
need AS (SELECT vl.document_id, vl.field, CASE vl.field WHEN 'payment_date' THEN '2023-03-30' WHEN 'full_name' THEN 'Other Name' END AS value FROM vl WHERE status <> 'valid' AND field IN ('payment_date', 'full_name') AND document_id % 2 = 0)
SELECT document_id, field_name, value FROM found WHERE NOT EXISTS (SELECT 1 FROM need n WHERE n.document_id = found.document_id AND n.field = found.field_name)
UNION ALL SELECT document_id, field, value FROM need""",
)
def merge_fallback(t):
    return _long_fields(stored(X.merge_fallback(_validated(t), _resolved(t))))


@query("consistency_checks", f"WITH {TS.FOUND}, {TS.VALID}, {TS.CONSISTENT} SELECT * FROM cs")
def consistency_checks(t):
    checked = CK.consistency_checks(_validated(t), AS_OF)
    return checked.select("document_id", F.explode("consistency_results").alias("c")).select(
        "document_id", "c.rule_id", "c.status"
    )


@query("analysis_score", f"WITH {TS.FOUND}, {TS.VALID}, {TS.CONSISTENT}, {TS.SCORED} SELECT * FROM scored")
def analysis_score(t):
    scored = CK.analysis_score(CK.consistency_checks(_validated(t), AS_OF))
    names = ("field_coverage", "validation_rate", "consistency_rate", "confidence_score")
    return scored.select("document_id", *[F.round(n, 9).alias(n) for n in names], "verification_status")


@query("analyze_documents")
def analyze_documents(t):
    """Every step over all twelve types; the steps are checked one by one above."""
    return CK.analyze_documents(_stored_or_none(t), AS_OF, _resolved(t)).withColumn(
        "extracted_fields", F.to_json("extracted_fields")
    )


@query(
    "analysis_outcomes",
    """WITH x AS (SELECT d.application_id, trim(coalesce(o.raw_ocr_text, ''), ' ' || chr(9) || chr(10) || chr(13)) <> '' AS readable FROM e_documents d LEFT JOIN e_ocr o USING (document_id))
SELECT application_id, count(*) AS total, count(*) FILTER (WHERE readable) AS analyzed, count(*) FILTER (WHERE NOT readable) AS failed FROM x GROUP BY 1""",
)
def analysis_outcomes(t):
    """All documents with the text that was read from them, which some do not have."""
    documents = t.entity("documents").select("document_id", "application_id", "document_type")
    texts = t.ocr.select("document_id", F.col("raw_ocr_text").alias("text"), "overall_confidence")
    typed = documents.join(texts, "document_id").withColumnRenamed("document_type", "stored_type")
    return CK.analysis_outcomes(documents, typed.drop("application_id"), AS_OF)
