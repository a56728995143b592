"""Small hand-built tables for order-dependent and text jobs."""

import datetime as dt

from pyspark.sql import functions as F

from dossier.functions import text
from dossier.operators import extract, feedback as corrections, ordered, relational, splitting
from dossier.operators.accountlines import account_block, account_values
from dossier.operators.lifecycle import waiting_spans
from dossier import vocab
from dossier.operators.rules import base, catalogue, cross, engine, pairs, presence
from dossier.functions.timing import moment
from dossier.plans.catalog import AS_OF
from dossier.session import spread, stored
from dossier.sources import bindings, exports, tables
from dossier.sources.files import scan_files
from dossier.streaming import streams


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def test_waiting_spans_sequences(spark):
    q, r = "DOCUMENTS_REQUESTED", "DOCUMENTS_RECEIVED"
    events = []
    for app, seq in {1: "QR", 2: "QQR", 3: "R", 4: "QRR", 5: "Q", 6: "QRQ"}.items():
        for i, c in enumerate(seq):
            events.append((app * 10 + i, app, q if c == "Q" else r, at(1 + i * 3)))
    rows = waiting_spans(
        spark.createDataFrame(events, "id long, application_id long, event_type string, created_at timestamp_ntz")
    ).collect()
    got = sorted((x.application_id, x.id % 10, x.is_open, x.duration_seconds) for x in rows)
    day3 = 3 * 86400
    assert got == [
        (1, 0, False, day3),
        (2, 0, True, None),
        (2, 1, False, day3),
        (4, 0, False, day3),
        (5, 0, True, None),
        (6, 0, False, day3),
        (6, 2, True, None),
    ]


def test_chunked_order_equals_plain_order(spark):
    rows = [(k, i, (i * 7) % 5) for k in (1, 2) for i in range(40)]
    df = spark.createDataFrame(rows, "k long, i long, v long")
    chunk = ordered.range_chunk("i", 6)
    out = ordered.numbered(df, ["k"], [F.col("i")], chunk, "n")
    assert all(r.n == r.i + 1 for r in out.collect())
    nxt = ordered.with_next(df, ["k"], ["i"], chunk, ["v"])
    assert all(r.next_v == ((r.i + 1) * 7 % 5 if r.i < 39 else None) for r in nxt.collect())
    run = ordered.with_running_sum(df, ["k"], ["i"], chunk, F.col("v"), "s")
    assert all(r.s == sum((j * 7) % 5 for j in range(r.i + 1)) for r in run.collect())
    prev = ordered.with_previous_where(df, ["k"], ["i"], chunk, F.col("v") == 3, F.col("i"), "p")
    for r in prev.collect():
        hits = [j for j in range(r.i) if (j * 7) % 5 == 3]
        assert (r.p.value if r.p else None) == (hits[-1] if hits else None)


def _segments(spark, *texts):
    pages = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "file_id long, page_no int, text string")
    lines = splitting.lines_of(F.col("text"))
    shaped = pages.select("file_id", "page_no", (F.size(lines) * 10.0).alias("page_height"), lines.alias("lines"))
    seg = splitting.segment_pages(splitting.classify_pages(shaped))
    rows = splitting.split_documents(seg).orderBy("document_index").collect()
    return [(r.document_type, r.first_page, r.last_page) for r in rows]


def test_bulk_file_cuts(spark):
    body = "\nbody\nbody\nbody"
    assert _segments(spark, "plain" + body, "Tripartite Agreement" + body, "more" + body) == [
        ("OTHER_SUPPORTING_DOCUMENT", 0, 0),
        ("TRIPARTITE_AGREEMENT", 1, 2),
    ]
    form = "Application Form (In-Direct" + body
    assert _segments(spark, form, form) == [("ONE_LINK_LETTER", 0, 1)]
    title = "Authority Letter" + body
    assert _segments(spark, title, title) == [("AUTHORITY_LETTER", 0, 0), ("AUTHORITY_LETTER", 1, 1)]
    assert _segments(spark, "Checklist\nAuthority Letter" + body, title) == [
        ("OTHER_SUPPORTING_DOCUMENT", 0, 0),
        ("AUTHORITY_LETTER", 1, 1),
    ]
    assert _segments(spark, "x\n" * 9 + "Authority Letter") == [("AUTHORITY_LETTER", 0, 0)]


def test_bank_block_forms(spark):
    def read_block(text):
        row = spark.createDataFrame([(text,)], "t string").select(
            *[c.alias(n) for n, c in account_values(F.col("t")).items()]
        ).first()
        return {n: v for n, v in row.asDict().items() if v is not None}

    table = "Account Title\nAccount No\nOffice of the Town Council Board\n0012345678"
    assert read_block(table) == {
        "account_holder": "Office of the Town Council Board",
        "account_number": "0012345678",
    }
    inline = "Title of Account: Fund\nAccount No: PK36SCBL0000001123456702"
    assert read_block(inline) == {
        "account_holder": "Fund",
        "account_number": "PK36SCBL0000001123456702",
        "iban": "PK36SCBL0000001123456702",
    }
    below = "Account Title:\nTown Fund\n(Main)\nAccount Number\n99887766"
    assert read_block(below)["account_number"] == "99887766"
    both = "Account No / IBAN: 12345678 / PK36SCBL0000001123456702"
    assert read_block(both) == {"account_number": "12345678", "iban": "PK36SCBL0000001123456702"}
    prose = "This is in the name of Town Council. Account No 55"
    assert read_block(prose) == {"account_holder": "Town Council"}
    assert read_block("nothing here") == read_block(None) == {}


def test_bank_block_layouts(spark):
    cases = {
        "S.No\nBank Name\nIENT\nAccount Title\nAccount Number\n1\nABC Bank\nFoo\n12345": ("Foo", "12345"),
        "Account Title\nAccount Number\nCurrency\nFoo\n12345678\nPKR": ("Foo", "12345678"),
        "Account Title\nAccount Number\nCurrency\nOffice of the Town Council Board\n12345678": ("Office of the Town Council Board", "12345678"),
        "Account Title\nAccount Number\nCurrency": (None, None),
        "Account Title\nAccount Number\n" + "plain\n" * 12 + "Foo\n12345678": (None, None),
        "Account Title\nFoo\nAccount Number\n12345\nend": ("Foo", "12345"),
        "Account Title\nFoo\nAccount Number\nAB12345\nBranch\n998877": ("Foo", "AB12345"),
        "Account Title\nDG GDA (TOWN DEVELOPMENT\nAUTHORITY)\nDEVELOPMENT FUND\nAccount No. (T-24 System)\n12345": ("DG GDA (TOWN DEVELOPMENT AUTHORITY)", "12345"),
        "Account Title\nTown Municipal\nAdministration\n12345-1234567-1": ("Town Municipal", None),
        "Paid on behalf of Party B. It is in the name of Town Council.": ("Town Council", None),
    }
    cases |= {
        "Account No: 0123/4567": (None, "0123/4567"),
        "account number (1BAN) PK86ABCD12345678901 titled as Tehsil General Account": (None, "PK86ABCD12345678901"),
        "S.No\nBank Name\nBranch 2\nAccount Title\nAccount Number\n1\nABC Bank\nFoo Traders\n12345678": ("Foo Traders", "12345678"),
        "Account No: 12 / ab": (None, "12 / ab"),
        "Account No: a/b": (None, None),
        "Account No: 123": (None, None),
        "Account No: no 12345678 of the Bank": (None, "12345678"),
        "Account No: PK36SCBL0000001123456702/998877": (None, "998877"),
        "Account No: (PK36SCBL0000001123456702)": (None, "PK36SCBL0000001123456702"),
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, t string").select(
        "i", *[c.alias(n) for n, c in account_values(F.col("t")).items()]
    )
    got = {r.i: (r.account_holder, r.account_number) for r in rows.collect()}
    assert got == dict(enumerate(cases.values()))


def test_cross_message_is_alike_at_every_size(spark):
    schema = "application_id long, document_type string, field_name string, v string, present boolean"
    rule = ("R", "Rule", "iban", ("ACCOUNT_MAINTENANCE_CERTIFICATE", "BILATERAL_AGREEMENT"))
    sizes = {1: 1, 2: 200, 3: 201, 4: 5000}
    rows = [
        (app, t, "iban", f"v{i}", True) for app, n in sizes.items() for i in range(n) for t in rule[3]
    ]
    docs = spark.createDataFrame([(a, t) for a in sizes for t in rule[3]], "application_id long, document_type string")
    docs = docs.withColumn("document_id", F.monotonically_increasing_id())
    apps = docs.select("application_id").distinct()
    got = cross.cross_rules(apps, docs, spark.createDataFrame(rows, schema), [rule]).filter("rule_id = 'R'")
    messages = {r.application_id: r.message for r in got.collect()}
    assert messages[1] == "Field iban is consistent across the compared documents"
    for app in (2, 3, 4):
        assert messages[app] == f"Field iban differs between documents: {sizes[app]} values"


def test_two_resolved_values_for_one_name(spark):
    analysis = spark.sql(
        "SELECT 1L AS document_id, map('a', 'x') AS extracted_fields,"
        " array(named_struct('field', 'b', 'status', 'missing')) AS validation_results"
    )
    resolved = spark.sql("SELECT * FROM VALUES (1L, 'b', 'z'), (1L, 'b', 'y') AS t(document_id, field_name, value)")
    assert extract.merge_fallback(analysis, resolved).first().extracted_fields == {"a": "x", "b": "y"}


def _batches(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def _drain(writer, checkpoint):
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def test_completeness_survives_a_restart(spark, tmp_path):
    schema = "document_id long, application_id long, document_type string, processing_status string, uploaded_at timestamp_ntz"
    apps = spark.createDataFrame([(1, "SUBMITTED"), (2, "SUBMITTED")], "application_id long, status string")
    out = str(tmp_path / "out")
    for number, app in enumerate((1, 2, 1)):  # each round is a stream of its own, from the same checkpoint
        kind = ("AUTHORITY_LETTER", "AUTHORITY_LETTER", "CNIC_FRONT")[number]
        stream = _batches(spark, str(tmp_path / "in"), [(number, app, kind, "UPLOADED", at(1))], schema)
        _drain(streams.stream_completeness(stream, apps, out), str(tmp_path / "check"))
    table = streams.completeness_table(spark, out)
    got = {r.application_id: (r.received_required, r.uploaded_documents) for r in table.read().collect()}
    assert got == {1: (2, 2), 2: (1, 1)}
    # A replayed batch changes nothing; a batch writes the rows that it touched only.
    version, last = table.number, table.state["updates"][-1]
    assert not table.upsert(table.read().limit(1), token=2) and table.number == version
    assert len(last["buckets"]) == 1


def test_completeness_updates_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "_MERGE_EVERY", 2)
    schema = "document_id long, application_id long, document_type string, processing_status string, uploaded_at timestamp_ntz"
    apps = spark.createDataFrame([(i,) for i in range(5)], "application_id long")
    held = []
    for app in range(5):
        stream = _batches(spark, str(tmp_path / "in"), [(app, app, "CNIC_FRONT", "UPLOADED", at(1))], schema)
        _drain(streams.stream_completeness(stream, apps, str(tmp_path / "out")), str(tmp_path / "check"))
        held.append(len(streams.completeness_table(spark, str(tmp_path / "out")).state["updates"]))
    assert max(held) < 2 and streams.completeness_table(spark, str(tmp_path / "out")).read().count() == 5


def test_analysis_starts_once(spark, tmp_path):
    schema = "job_id long, application_id long, job_type string, status string, seq long"
    apps = spark.createDataFrame([(1, "PROCESSING"), (2, "PROCESSING"), (3, "APPROVED")], "application_id long, status string")
    rounds = (
        [(1, 1, "DOCUMENT_OCR", "COMPLETED", 1), (3, 3, "DOCUMENT_OCR", "COMPLETED", 1), (4, 2, "DOCUMENT_OCR", "QUEUED", 1)],
        [(1, 1, "DOCUMENT_OCR", "COMPLETED", 2), (2, 2, "DOCUMENT_OCR", "COMPLETED", 1), (5, 1, "DOCUMENT_OCR", "QUEUED", 1)],
        [(4, 2, "DOCUMENT_OCR", "FAILED", 3), (4, 2, "DOCUMENT_OCR", "PROCESSING", 2), (5, 1, "DOCUMENT_OCR", "COMPLETED", 2)],
    )
    seen = []
    for rows in rounds:  # from the same checkpoint each time
        stream = _batches(spark, str(tmp_path / "in"), rows, schema)
        started = streams.stream_start_analysis_once(stream, apps)
        _drain(started.writeStream.format("parquet").option("path", str(tmp_path / "out")), str(tmp_path / "check"))
        seen.append(sorted(r.application_id for r in spark.read.parquet(str(tmp_path / "out")).collect()))
    assert seen == [[1], [1], [1, 2]]


def test_waiting_spans_of_events_that_arrive_late(spark, tmp_path):
    """Late by less than the lateness takes its place, by more is dropped."""
    schema = "application_id long, id long, event_type string, created_at timestamp"
    q, r = "DOCUMENTS_REQUESTED", "DOCUMENTS_RECEIVED"
    minute = lambda m: dt.datetime(2024, 1, 1, 10) + dt.timedelta(minutes=m)
    rounds = (
        [(1, 1, q, minute(0)), (1, 3, r, minute(40))],
        [(1, 2, q, minute(20)), (2, 4, q, minute(50))],  # supersedes the request of minute 0
        [(9, 9, r, minute(300))],
        [(2, 5, r, minute(60))],  # behind the watermark
        [(9, 10, r, minute(900))],
    )
    for rows in rounds:
        stream = _batches(spark, str(tmp_path / "in"), rows, schema)
        spans = streams.stream_waiting_spans(stream)
        _drain(spans.writeStream.format("parquet").option("path", str(tmp_path / "out")), str(tmp_path / "check"))
    got = sorted((x.application_id, x.superseded, x.duration_seconds) for x in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, False, 1200.0), (1, True, None)]


def test_first_deciding_value_wins(spark):
    schema = (
        "application_id long, document_id long, document_type string, field_name string, extracted_value string,"
        " normalized_value string, verification_status string, confidence_score double"
    )
    rows = [
        (1, 1, "X", "payment_date", "a", "soon", None, 1.0),
        (1, 2, "X", "payment_date", "a", "2099-01-01", None, 1.0),
        (2, 1, "X", "payment_date", "a", "2099-01-01", None, 1.0),
        (2, 2, "X", "payment_date", "a", "soon", None, 1.0),
        (3, 1, "X", "payment_date", "a", "2099-01-01", "PENDING_REVIEW", 1.0),
    ]
    apps = spark.createDataFrame([(1,), (2,), (3,)], "application_id long")
    values = base.with_values(spark.createDataFrame(rows, schema))
    rules = [r for r in catalogue.date_rules(moment("2024-02-01").cast("date")) if r.rule_id == "DATE_PAYMENT_RECENCY"]
    got = {r.application_id: r.status for r in presence.value_rule_results(apps, values, rules).collect()}
    assert got == {1: "WARNING", 2: "FAIL", 3: "WARNING"}


def test_exports_and_replacement(spark, tmp_path):
    schema = (
        "id long, application_id long, document_id long, ocr_result_id long, field_name string, ocr_value string,"
        " normalized_value string, human_value string, confidence_score double, confidence_source string,"
        " correction_reason string, reviewer string, decision string, origin string, recorded_at timestamp_ntz"
    )
    row = (1, 2, 3, 4, "iban", "a", None, 'b,"c"', 0.5, None, None, "r", "CORRECT", "X", at(1))
    feedback = spark.createDataFrame([row], schema)
    exports.write_feedback_export(feedback, str(tmp_path / "j"), "json")
    back = spark.read.json(str(tmp_path / "j")).first()
    assert back.human_corrected_value == 'b,"c"' and back.recorded_at == "2024-01-01T00:00:00+00:00"
    exports.write_feedback_export(feedback, str(tmp_path / "c"), "csv")
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).first().human_corrected_value == 'b,"c"'
    results = spark.createDataFrame(
        [(1, "d", "date", 1), (2, "d", "date", 1), (1, "d", "format", 1)],
        "application_id long, run_date string, rule_category string, n int",
    )
    path = str(tmp_path / "r")
    exports.replace_results(results, path)
    again = results.filter("rule_category = 'date' AND application_id = 1").withColumn("n", F.lit(2))
    exports.replace_results(again, path)
    got = {(r.application_id, r.rule_category, r.n) for r in exports.read_results(spark, path).collect()}
    assert got == {(1, "date", 2), (2, "date", 1), (1, "format", 1)}


def test_learning_export_keeps_each_version(spark, data_dir, tmp_path):
    t = bindings.Tables(spark, data_dir)
    curated, path = corrections.curate(t.feedback, t.entity("documents")), str(tmp_path / "x")
    part = curated.filter("application_id % 2 = 0")
    names = [exports.write_learning_export(c, path, "json").first().dataset_version for c in (curated, part, part)]
    assert names[0] != names[1] == names[2]
    counts = dict(map(tuple, spark.read.json(f"{path}/records").groupBy("dataset_version").count().collect()))
    assert counts == {names[0]: curated.count(), names[1]: part.count()}
    versions = spark.read.parquet(f"{path}/version").collect()
    assert {r.dataset_version: r.record_count for r in versions} == counts


def test_stored_history_is_read_as_table_and_as_stream(spark, data_dir, tmp_path):
    events = bindings.history(bindings.Tables(spark, data_dir))
    root, names = str(tmp_path), [c.split()[0] for c in tables.SCHEMAS["validation_history"].split(", ")]
    stored = events.select(*[c for c in names if c in events.columns])
    even, odd = (stored.filter(f"application_id % 2 = {i}") for i in (0, 1))
    assert exports.append_history(even, f"{root}/validation_history", 0)
    assert exports.append_history(odd, f"{root}/validation_history", 1)
    assert not exports.append_history(odd, f"{root}/validation_history", 1)  # a retry
    held = tables.read_table(spark, root, "validation_history")
    assert sorted(r.id for r in held.select("id").collect()) == sorted(r.id for r in stored.select("id").collect())
    added = tables.stream_table(spark, root, "validation_history").groupBy("event_type").count()
    run = (
        added.writeStream.format("memory").queryName("history_counts").outputMode("complete")
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    run.awaitTermination(90)
    assert sorted(spark.table("history_counts").collect()) == sorted(held.groupBy("event_type").count().collect())


def test_scan_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.bin").write_bytes(b"zzz")
    got = {r.filename: r.sniffed for r in scan_files(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": ".pdf", "b.bin": None}


def test_numbering_of_a_bulk_import_spreads_over_chunks(spark):
    """One key and one time for all rows: positions are whole, chunks of like size."""
    rows = spark.range(20_000).select(
        F.lit(1).alias("k"), F.lit("2024-01-01").cast("timestamp").alias("at"), F.col("id")
    )
    rows = rows.unionByName(rows.filter("id < 3").withColumn("k", F.lit(None).cast("int")))
    order = [F.col("at"), F.col("id")]
    got = ordered.evenly_numbered(rows, ["k"], order, "n")
    assert got.filter("n <> id + 1").count() == 0 and got.count() == 20_003
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")  # else Spark joins chunks as small as these
    try:
        dealt = rows.repartitionByRange(F.col("k"), *order).groupBy(F.spark_partition_id()).count()
        assert dealt.agg(F.max("count")).first()[0] < 10_000
        assert ordered.evenly_numbered(rows, ["k"], order, "n").filter("n <> id + 1").count() == 0
    finally:
        spark.conf.unset(key)
    assert ordered.evenly_numbered(rows.filter("id < 0"), [], order).count() == 0


def test_related_documents_of_every_rule(spark, data_dir):
    t = bindings.Tables(spark, data_dir)
    docs, fields = t.entity("documents"), t.table("fields")
    results = stored(engine.evaluate_rules(t.applications, docs, fields, t.detections, AS_OF))
    types = {r.rule_id: {r.document_type} for r in (*vocab.DOCUMENT_RULES, *vocab.VISUAL_RULES)}
    types |= {r[0]: set(r[3]) for r in vocab.CROSS_RULES}
    types[cross.ONE_LINK_ID] = {vocab.ONE_LINK, vocab.CERTIFICATE}
    reads = {
        r.rule_id: (set(r.fields), r.document_type, r.category == "format", r.rule_id == "QUAL_NORMALIZED_VALUES_CLEAN")
        for r in catalogue.value_rules(moment(AS_OF).cast("date"))
    }
    reads[pairs.ISSUE_RULE] = ({"issue_date", "expiry_date"}, None, False, False)
    reads[pairs.SALARY_RULE] = ({"salary_month", "statement_period"}, None, False, False)
    balances = {"opening_balance", "closing_balance", "total_credits", "total_debits"}
    reads[pairs.BALANCE_RULE] = (balances, vocab.CERTIFICATE, False, False)
    reads[cross.CURRENCY_RULE] = ({"currency"}, vocab.CERTIFICATE, False, False)
    own_docs, own_values = {}, {}
    for r in docs.select("application_id", "document_id", "document_type").collect():
        own_docs.setdefault(r.application_id, []).append(r)
    for r in base.with_values(fields).collect():
        own_values.setdefault(r.application_id, []).append(r)
    want, seen = set(), set()
    for r in results.collect():
        seen.add(r.rule_id)
        if not r.has_related_documents:
            continue
        if r.deciding_document_id is not None:
            want.add((r.application_id, r.rule_id, r.deciding_document_id))
            continue
        if r.rule_id in types:
            found = [d for d in own_docs.get(r.application_id, []) if d.document_type in types[r.rule_id]]
        else:
            names, kind, only_present, only_filled = reads[r.rule_id]
            found = [
                v
                for v in own_values.get(r.application_id, [])
                if (not names or v.field_name in names)
                and (kind is None or v.document_type == kind)
                and (v.present or not only_present)
                and (v.nv or not only_filled)
            ]
        want |= {(r.application_id, r.rule_id, x.document_id) for x in found}
    got = [tuple(r) for r in engine.related_documents(results, docs, fields, AS_OF).collect()]
    assert len(seen) == 55 and seen == set(types) | set(reads)
    assert sorted(got) == sorted(want)


def test_stages_move_an_application_once(spark):
    from dossier.operators.stages import run_stages

    text = "ACCOUNT MAINTENANCE CERTIFICATE\nTitle of Account: Fund\nAccount No: 12345678\nBank Name: Town Bank"
    apps = spark.createDataFrame([(1, "PROCESSING"), (2, "APPROVED"), (3, "PROCESSING")], "application_id long, status string")
    docs = [(a, a, vocab.CERTIFICATE, at(1)) for a in (1, 2)]
    documents = spark.createDataFrame(docs, "document_id long, application_id long, document_type string, uploaded_at timestamp_ntz")
    texts = documents.select(
        "document_id", "application_id", F.col("document_type").alias("stored_type"), F.lit(text).alias("text"), F.lit(0.9).alias("overall_confidence")
    )
    marks = spark.createDataFrame([], "document_id long, detection_type string, is_present boolean")
    got = run_stages(apps, documents, texts, marks, AS_OF).collect()
    assert {r.application_id: (r.status, r.validation_status) for r in got} == {1: ("PENDING_REVIEW", "FAIL"), 2: ("APPROVED", "FAIL")}


def test_outcomes_of_documents_without_text(spark):
    from dossier.operators.checks import analysis_outcomes

    documents = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 2)], "document_id long, application_id long")
    texts = spark.createDataFrame(
        [(1, vocab.CERTIFICATE, "Account No: 12345678"), (2, None, " \n"), (4, None, "words")], "document_id long, stored_type string, text string"
    )
    got = analysis_outcomes(documents, texts, AS_OF).collect()
    assert sorted(map(tuple, got)) == [(1, 3, 1, 2), (2, 1, 1, 0)]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_account_blocks_read_their_lines_once(spark):
    texts = spark.createDataFrame([(1, "Account No: 1234567"), (None, None)], "document_id long, text string")
    read = spread(texts, "document_id", "text").select(account_block(F.col("text")).alias("b")).select("b.*")
    assert _plan(read).count("r\\n|\\r|\\n") == 1
    assert "RepartitionByExpression" in _plan(read)
    assert sorted(r.account_number or "" for r in read.collect()) == ["", "1234567"]


def test_texts_are_dealt_out_before_they_are_searched(spark):
    texts = spark.createDataFrame([(1, "PAYSLIP", "net salary: 5")], "document_id long, stored_type string, text string")
    assert "RepartitionByExpression" in _plan(extract.route_document_type(texts))


def test_cleaning_stays_in_spark(spark):
    rows = spark.createDataFrame(
        [(t,) for t in ("a  b\t", "ﬁne Ｘ", "é", "x\n", " ", "", None, "plain text")], "t string"
    )
    cleaned = rows.select("t", text.clean_text(F.col("t")).alias("c"))
    assert "Python" not in _plan(cleaned)
    assert [r.c for r in cleaned.collect()] == ["a b", "fine X", "é", "x", "", "", None, "plain text"]


def test_only_corrected_fields_are_matched(spark):
    fields = spark.createDataFrame(
        [(1, 10, "iban", "a", ""), (1, 11, "iban", "b", "c"), (1, 11, "branch", "d", None), (2, 12, "iban", "e", None)],
        "application_id long, document_id long, field_name string, extracted_value string, human_corrected_value string",
    )
    wanted = [(1, 10, "iban"), (1, None, "iban"), (1, 12, "iban"), (1, None, None), (None, None, "iban"), (1, None, "branch"), (3, None, "branch")]
    schema = "application_id long, document_id long, field_name string"
    for most in (1000, 1):
        known = relational._of_few_names(fields, spark.createDataFrame(wanted[:5], schema), most)
        assert known.count() == (3 if most > 1 else 4)
    matched = relational.match_corrections(spark.createDataFrame(wanted, schema), fields)
    assert "LeftSemi" in _plan(matched)
    got = {(r[0], r[1], r[2]): (r.matched_document_id, r.current_value) for r in matched.collect()}
    assert got == dict(zip(wanted, [(10, "a"), (11, "c"), (None, None), (None, None), (None, None), (11, "d"), (None, None)]))


def test_fields_are_joined_once(spark):
    fields = spark.createDataFrame(
        [(5, "b", "x", 0.5), (5, "a", "y", None), (6, "a", "z", 0.1), (None, "a", "w", 0.1)],
        "ocr_result_id long, field_name string, extracted_value string, confidence_score double",
    )
    ocr = spark.createDataFrame([(5, 2), (6, 1), (7, None)], "ocr_result_id long, document_id long")
    docs = spark.createDataFrame([(1, 8, "T"), (2, 9, "U")], "document_id long, application_id long, document_type string")
    joined = relational.fields_with_documents(fields, ocr, docs)
    plan = _plan(joined)
    assert plan.index("(ocr_result_id") < plan.index("Join Inner, (document_id")
    assert [tuple(r) for r in joined.collect()] == [
        (1, 6, "a", "z", 0.1, 8, "T"),
        (2, 5, "a", "y", None, 9, "U"),
        (2, 5, "b", "x", 0.5, 9, "U"),
    ]
