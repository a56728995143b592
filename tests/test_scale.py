"""Faults that show with many rows, on rows of their own."""

from pyspark.sql import functions as F

from dossier.operators import confidence
from dossier.operators.rules import base, engine
from dossier.plans.catalog import AS_OF
from dossier.sources.bindings import Tables
from dossier.streaming import streams

_LINE = (
    "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_shipdate timestamp_ntz"
)


def _signed(n: int) -> int:
    return (n + 2**63) % 2**64 - 2**63


def test_document_ids_beyond_64_bits(spark, tmp_path):
    keys = [(1, 2, 3, 4, 5.0), (8_999_999, 1_199_999, 59_999, 7, 50.0), (54_000_000, 7_000_000, 359_999, 1, 1.0)]
    rows = spark.createDataFrame([(*k, None) for k in keys], _LINE)
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    t = Tables(spark, str(tmp_path))
    ids = {o: (((o * 200000 + p) * 10000 + s) * 8 + n) * 64 + int(q) for o, p, s, n, q in keys}
    got = {r.application_id: r.document_id for r in t.entity("documents").collect()}
    assert got == {o: _signed(i) for o, i in ids.items()}
    kept = t.feedback.filter(F.col("id").isNotNull()).collect()
    assert {r.id for r in kept if not r.id % 2} == {_signed(2 * i) for i in ids.values()}


def _plan(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_rule_results_are_not_broadcast(spark):
    results = spark.range(1).selectExpr(
        "id AS application_id", "'DOC_X' AS rule_id", "cast(null AS long) AS deciding_document_id", "true AS has_related_documents"
    )
    documents = spark.createDataFrame([(1, 2, "AUTHORITY_LETTER")], "application_id long, document_id long, document_type string")
    fields = spark.createDataFrame(
        [],
        "application_id long, document_id long, document_type string, field_name string, extracted_value string,"
        " normalized_value string, confidence_score double, verification_status string",
    )
    assert "BroadcastExchange" not in _plan(engine.related_documents(results, documents, fields, AS_OF))


def test_rules_are_listed_after_the_join(spark):
    apps = spark.createDataFrame([(1,), (1,), (2,), (None,)], "application_id long")
    rules = [("A", "a", "x"), ("B", "b", "x")]
    one = spark.createDataFrame([(1, 0, 5), (2, 1, 6), (None, 0, 7)], "application_id long, rule_no int, n int")
    two = spark.createDataFrame([(1, 1, "s")], "application_id long, rule_no int, said string")
    rows = base.every_rule(apps, rules, "rule_no", one, two)
    got = sorted(((r.application_id or 0, r.rule_id, r.n, r.said) for r in rows.collect()), key=str)
    of_one = [(1, "A", 5, None), (1, "B", None, "s")]
    assert got == sorted([(0, "A", None, None), (0, "B", None, None), *of_one, *of_one, (2, "A", None, None), (2, "B", 6, None)], key=str)
    assert _plan(rows).index("Generate") < _plan(rows).index("Join")


_FIELDS = (
    "application_id long, document_id long, ocr_result_id long, field_name string, extracted_value string,"
    " confidence_score double, verification_status string, human_corrected_value string"
)
_DECISIONS = (
    "application_id long, field_name string, decision string, corrected_value string, reviewer string, reviewed_at timestamp_ntz"
)


def test_only_pending_fields_meet_the_decisions(spark):
    rows = [(1, 9, 9, n, "v", 0.5, s, None) for n, s in (("iban", "PENDING_REVIEW"), ("iban", "VERIFIED"), ("branch", None), ("bank_name", None))]
    made = [(1, "iban", "CORRECTED", "w", "r", None), (1, "branch", "VERIFIED", None, "r", None), (1, "branch", "VERIFIED", None, "s", None)]
    applied = confidence.apply_field_reviews(spark.createDataFrame(rows, _FIELDS), spark.createDataFrame(made, _DECISIONS))
    got = sorted((r.field_name, str(r.verification_status), r.extracted_value, str(r.reviewer)) for r in applied.collect())
    branch = ("branch", "None", "v", "None")
    assert got == [("bank_name", "None", "v", "None"), branch, branch, ("iban", "CORRECTED", "w", "r"), ("iban", "VERIFIED", "v", "None")]
    feedback = confidence.review_feedback(applied)
    assert feedback.count() == 1 and "Outer" not in _plan(feedback)


def test_scored_fields_stay_by_document(spark):
    from dossier.session import tune

    tune(spark)
    fields = spark.createDataFrame([], "application_id long, document_id long, document_type string, field_name string, value string")
    ocr = spark.createDataFrame([], "document_id long, ocr_result_id long, overall_confidence double")
    checks = spark.createDataFrame([], "document_id long, field_name string, validation_status string")
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        frames = [spark.createDataFrame(f.rdd, f.schema) for f in (fields, ocr, checks)]
        assert _plan(confidence.score_fields(*frames)).count("Exchange hashpartitioning") == 3
    finally:
        spark.conf.set(key, before)


def test_applications_of_one_bucket_start_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "_START_BUCKETS", 1)
    schema = "job_id long, application_id long, job_type string, status string, seq long"
    apps = spark.createDataFrame([(1, "PROCESSING"), (2, "SUBMITTED"), (3, "APPROVED"), (4, "PROCESSING")], "application_id long, status string")
    big = 2**62 + 1
    rounds = (
        [(big, 1, "DOCUMENT_OCR", "COMPLETED", 1), (big + 1, 2, "DOCUMENT_OCR", "QUEUED", 1), (5, 3, "DOCUMENT_OCR", "COMPLETED", 1), (None, 4, "DOCUMENT_OCR", "QUEUED", 1)],
        [(big + 1, 2, "DOCUMENT_OCR", "COMPLETED", 2), (big + 2, 2, "DOCUMENT_OCR", "FAILED", 1), (None, 4, "DOCUMENT_OCR", "COMPLETED", 2)],
        [(big, 1, "DOCUMENT_OCR", "COMPLETED", 3)],
    )
    seen = []
    for i, rows in enumerate(rounds):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        out = streams.stream_start_analysis_once(stream, apps).writeStream.format("parquet").option("path", f"{tmp_path}/out")
        out.option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
        seen.append(sorted(r.application_id for r in spark.read.parquet(f"{tmp_path}/out").collect()))
    assert seen == [[1], [1, 2, 4], [1, 2, 4]]
