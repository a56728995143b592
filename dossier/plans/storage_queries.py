"""Stored tables: re-runs, updates beside a base, and batches added once."""

from pyspark.sql import functions as F

from dossier.plans.catalog import query
from dossier.session import new_path
from dossier.sources import exports, tables
from dossier.sources.versioned import VersionedTable

_RERUN_NAMES = "application_id, rule_id, rule_category, status, run_date"


@query(
    "rerun_results",
    f"""WITH first AS (SELECT application_id, document_id, rule_id, rule_category, status, '2024-01-01' AS run_date FROM e_results)
SELECT {_RERUN_NAMES} FROM first WHERE NOT (application_id % 3 = 0 AND rule_category IN ('date', 'format')) AND NOT (application_id % 7 = 0 AND rule_category = 'visual')
UNION ALL SELECT application_id, rule_id, rule_category, 'RERUN', '2024-01-0' || (2 + application_id % 2)::VARCHAR FROM first
WHERE application_id % 3 = 0 AND rule_category IN ('date', 'format')""",
)
def rerun_results(t):
    """All results of one day, some run again on two later days, some without rows since."""
    path = new_path(t.spark)
    first = t.results.select("application_id", "rule_id", "rule_category", "status").withColumn(
        "run_date", F.lit("2024-01-01")
    )
    exports.replace_results(first, path)
    stored = exports.read_results(t.spark, path)
    for day in (0, 1):
        again = stored.filter(
            f"application_id % 3 = 0 AND application_id % 2 = {day} AND rule_category IN ('date', 'format')"
        )
        exports.replace_results(
            again.withColumn("status", F.lit("RERUN")).withColumn("run_date", F.lit(f"2024-01-0{2 + day}")), path
        )
    emptied = stored.filter("application_id % 7 = 0 AND rule_category = 'visual'").select(
        "application_id", "rule_category"
    )
    exports.replace_results(stored.limit(0), path, emptied)
    return exports.read_results(t.spark, path)


@query(
    "updated_fields",
    """WITH u AS (SELECT *, CASE WHEN ocr_result_id % 7 = 0 THEN 'third' WHEN ocr_result_id % 4 = 0 THEN 'second' WHEN ocr_result_id % 5 = 0 THEN 'first' END AS last FROM e_fields)
SELECT ocr_result_id, field_name,
 CASE last WHEN 'third' THEN lower(extracted_value) WHEN 'second' THEN upper(extracted_value) WHEN 'first' THEN 'again' ELSE extracted_value END AS extracted_value,
 CASE WHEN ocr_result_id % 4 = 0 THEN 0.5 WHEN ocr_result_id % 5 = 0 THEN 0.25 WHEN ocr_result_id % 3 = 0 THEN NULL ELSE confidence_score END AS confidence_score,
 CASE WHEN ocr_result_id % 3 <> 0 THEN human_corrected_value WHEN ocr_result_id % 5 = 0 THEN 'added 1' WHEN ocr_result_id % 4 = 0 THEN 'added 2' END AS human_corrected_value
FROM u WHERE ocr_result_id % 3 <> 0 OR last IS NOT NULL""",
)
def updated_fields(t):
    """Three updates beside a base and a merge of some of them; human columns stay."""
    keys = ["ocr_result_id", "field_name"]
    rows = t.fields.select(*keys, "extracted_value", "confidence_score", "human_corrected_value")
    table = VersionedTable(t.spark, new_path(t.spark), ["ocr_result_id"])
    table.create(rows.filter("ocr_result_id % 3 <> 0"), keys, keep=["human_corrected_value"])
    first = rows.filter("ocr_result_id % 5 = 0").withColumn("extracted_value", F.lit("again"))
    table.upsert(
        first.withColumn("confidence_score", F.lit(0.25)).withColumn("human_corrected_value", F.lit("added 1"))
    )
    second = rows.filter("ocr_result_id % 4 = 0").withColumn("extracted_value", F.upper("extracted_value"))
    table.upsert(
        second.withColumn("confidence_score", F.lit(0.5)).withColumn("human_corrected_value", F.lit("added 2"))
    )
    table.compact()
    third = rows.filter("ocr_result_id % 7 = 0").select(*keys, F.lower("extracted_value").alias("extracted_value"))
    table.upsert(third)
    return table.read()


_HISTORY = "id, application_id, event_type, actor_name, actor_role, reason, created_at"


@query("appended_history", f"SELECT {_HISTORY} FROM e_history")
def appended_history(t):
    """Events added in four batches, two of them twice, and read as the stored table."""
    root, names = new_path(t.spark), _HISTORY.split(", ")
    events = t.history.select(*names)
    for batch in (0, 1, 2, 1, 3, 3):
        exports.append_history(
            events.filter(F.pmod(F.col("id"), F.lit(4)) == batch), f"{root}/validation_history", batch
        )
    return tables.read_table(t.spark, root, "validation_history").select(*names)
