"""Writers: exports, result replacement, upserts and append-only history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.operators.feedback import (
    feedback_export_rows,
    learning_export_rows,
    learning_version,
)
from dossier.session import stored
from dossier.sources.versioned import VersionedTable, append_batch


def _write(rows: DataFrame, path: str, fmt: str) -> None:
    writer = rows.write.mode("overwrite")
    if fmt == "json":
        writer.option("ignoreNullFields", "false").json(path)
    elif fmt == "csv":
        writer.option("header", "true").option("escape", '"').option("emptyValue", "").csv(path)
    else:
        raise ValueError(f"unknown export format {fmt!r}")


def write_feedback_export(feedback: DataFrame, path: str, fmt: str) -> None:
    """Filtered corrections as JSON lines or CSV, one file per task."""
    _write(feedback_export_rows(feedback), path, fmt)


def write_learning_export(curated: DataFrame, path: str, fmt: str) -> DataFrame:
    """Curated dataset and its version row, in a folder named by the version; the exports of
    other versions stay. Gives back the version row."""
    version = stored(learning_version(curated))
    name = version.select("dataset_version").first()[0]
    _write(learning_export_rows(curated), f"{path}/records/dataset_version={name}", fmt)
    version.write.mode("overwrite").parquet(f"{path}/version/dataset_version={name}")
    return version


#: What a re-run exchanges; all rows of an application lie in one bucket.
_RERUN = ("application_id", "rule_category")


def replaced_results(old: DataFrame, new: DataFrame) -> DataFrame:
    """Stored rows with those of re-run (application, category) pairs exchanged."""
    rerun = new.select(*_RERUN).distinct()
    return old.join(rerun, list(_RERUN), "left_anti").unionByName(new)


def results_table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, ["application_id"])


def replace_results(new: DataFrame, path: str, rerun: DataFrame | None = None) -> None:
    """Exchange the results of the (application, category) pairs in ``new`` in the table at
    ``path``, whatever date they were made on; readers see the old rows or the new ones.
    ``rerun`` names pairs that were run again, also those that gave no row."""
    results_table(new.sparkSession, path).replace(new, _RERUN, rerun)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Results as the last re-run left them."""
    return results_table(spark, path).read()


def upsert(
    base: DataFrame, updates: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()
) -> DataFrame:
    """New snapshot of ``base``: rows with a key in ``updates`` are refreshed, new keys are
    added, and the ``keep`` columns of known rows stay as they are."""
    values = [c for c in base.columns if c not in keys]
    old = base.select(*keys, F.struct(*values).alias("_old"))
    new = updates.select(
        *keys, F.struct(*[c for c in updates.columns if c not in keys]).alias("_new")
    )
    offered = [c for c in updates.columns if c not in keys]
    columns = []
    for c in values:
        stored = F.col("_old")[c]
        if c in offered and c not in keep:
            columns.append(
                F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(stored).alias(c)
            )
        elif c in offered:
            columns.append(
                F.when(F.col("_old").isNotNull(), stored).otherwise(F.col("_new")[c]).alias(c)
            )
        else:
            columns.append(stored.alias(c))
    return old.join(new, list(keys), "full").select(*keys, *columns)


def append_history(events: DataFrame, path: str, batch: int | str) -> bool:
    """Add event rows under the number of their batch; the folder is also the source of the
    event streams. A batch that is there already is not added again (false)."""
    return append_batch(events, path, batch)
