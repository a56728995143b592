"""Stored tables through re-runs, crashes, concurrent writers and compaction."""

import pytest
from pyspark.sql import functions as F

from dossier.sources import exports, versioned
from dossier.sources.versioned import Conflict, VersionedTable, append_batch

RESULTS = "application_id long, run_date string, rule_category string, status string"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_rerun_on_a_later_day_leaves_one_set_of_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    first = [(a, "2024-01-01", c, "FAIL") for a in (*range(300), None) for c in ("date", "format")]
    exports.replace_results(spark.createDataFrame(first, RESULTS), path)
    again = [(1, "2024-01-02", "date", "PASS"), (1, "2024-01-02", "date", "WARNING"), (None, "2024-01-02", "date", "PASS")]
    exports.replace_results(spark.createDataFrame(again, RESULTS), path)
    want = [r for r in first if (r[0], r[2]) not in ((1, "date"), (None, "date"))] + again
    assert rows_of(exports.read_results(spark, path)) == sorted(want, key=str)
    gone = spark.createDataFrame([(2, "date"), (2, "format")], "application_id long, rule_category string")
    exports.replace_results(spark.createDataFrame([], RESULTS), path, gone)
    assert rows_of(exports.read_results(spark, path)) == sorted([r for r in want if r[0] != 2], key=str)


def test_a_writer_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([(1, "d", "date", "FAIL"), (2, "d", "date", "FAIL")], RESULTS)
    exports.replace_results(old, path)

    def die(self, state):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_commit", die)
        with pytest.raises(RuntimeError, match="lost"):
            exports.replace_results(old.withColumn("status", F.lit("PASS")), path)
    assert rows_of(exports.read_results(spark, path)) == rows_of(old)
    table = exports.results_table(spark, path)
    assert len(table.folder.names("data")) == 2  # what it had written is named by no manifest
    table.drop_unused()
    assert len(table.folder.names("data")) == 1 and rows_of(table.read()) == rows_of(old)


def test_the_second_of_two_writers_gets_an_error(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([(1, "d", "date", "FAIL")], RESULTS)
    exports.replace_results(old, path)
    slow = exports.results_table(spark, path)
    exports.replace_results(old.withColumn("status", F.lit("PASS")), path)
    with pytest.raises(Conflict):
        slow.replace(old.withColumn("status", F.lit("LATE")), ["application_id", "rule_category"])
    assert [r.status for r in exports.read_results(spark, path).collect()] == ["PASS"]


def test_updates_equal_full_rewrites(spark, tmp_path):
    schema = "k long, name string, v string, n int, human string"
    base = spark.createDataFrame([(i, "a", f"v{i}", i, f"h{i}") for i in range(200)] + [(None, "a", "v", 0, "h")], schema)
    updates = [
        spark.createDataFrame([(i, "a", "u1", -1, "m1") for i in range(0, 260, 3)] + [(None, "a", "u1", 5, "m")], schema),
        spark.createDataFrame([(i, "a", None) for i in range(0, 270, 5)], "k long, name string, v string"),
        spark.createDataFrame([(i, "a", "m3", i) for i in range(0, 280, 7)], "k long, name string, human string, n int"),
        spark.createDataFrame([(1, "b", "new")], "k long, name string, v string"),
    ]
    keys, keep = ["k", "name"], ["human"]
    for merge_after in ((), (1,), (0, 2, 3)):
        table = VersionedTable(spark, str(tmp_path / str(merge_after)), ["k"], buckets=8)
        table.create(base, keys, keep)
        want = {(r.k, r.name): r.asDict() for r in base.collect()}
        for i, update in enumerate(updates):
            files = table.folder.names("data")
            table.upsert(update)
            assert set(files) < set(table.folder.names("data"))  # the base is not written again
            for r in update.collect():
                known = want.get((r.k, r.name))
                row = known or dict.fromkeys(base.columns)
                row |= {c: v for c, v in r.asDict().items() if not (known and c in keep)}
                want[r.k, r.name] = row
            if i in merge_after:
                table.compact()
                assert not table.state["updates"]
            again = VersionedTable(spark, str(tmp_path / str(merge_after)), ["k"])
            got = [tuple(r) for r in again.read().collect()]
            assert sorted(got, key=str) == sorted((tuple(r.values()) for r in want.values()), key=str)


def test_large_tables_merge_without_a_shuffle(spark, tmp_path, monkeypatch):
    schema = "k long, name string, v string, human string"
    base = [(i, n, f"v{i}", f"h{i}") for i in (*range(40), None) for n in ("a", None)] + [(7, "a", "other", "h")]
    first = [(i, "a", None if i == 8 else "u1", "m1") for i in range(0, 50, 2)] + [(None, None, "u1", "m1")]
    second = [(i, "a", "u2", "m2") for i in range(0, 60, 5)]
    table = VersionedTable(spark, str(tmp_path), ["k"], buckets=4)
    table.create(spark.createDataFrame(base, schema), ["k", "name"], ["human"])
    monkeypatch.setattr(table, "_base", lambda buckets=None: 1 / 0)  # an update reads nothing of the table
    for rows in (first, second):
        table.upsert(spark.createDataFrame(rows, schema))
    monkeypatch.undo()
    offers = {r[:2]: r[2] for r in (*first, *second)}
    want = [(*r[:2], offers.get(r[:2], r[2]), r[3]) for r in base]
    new = {r[:2]: r[3] for r in (*second, *first) if r[:2] not in {b[:2] for b in base}}
    want = sorted(want + [(*k, offers[k], human) for k, human in new.items()], key=str)
    assert rows_of(table.read()) == want
    monkeypatch.setattr(versioned, "SHUFFLED", -1)
    assert "Exchange" not in table.read()._jdf.queryExecution().executedPlan().toString()
    assert rows_of(table.read()) == want
    table.compact()
    assert not table.state["updates"] and rows_of(table.read()) == want


def test_a_batch_is_added_once(spark, tmp_path):
    path = str(tmp_path / "h")
    rows = spark.range(10)
    assert append_batch(rows, path, 0) and append_batch(rows, path, 1)
    assert not append_batch(rows, path, 1) and not append_batch(rows.limit(3), path, 0)
    assert spark.read.parquet(path).count() == 20
