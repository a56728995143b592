"""Session helpers: defaults for local runs, the shared folder and stored stages."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, **conf: str) -> SparkSession:
    """Session for tests and the bench; a cluster passes its own session in."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("dossier")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.files.minPartitionNum", str(cpus))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tune(spark: SparkSession) -> None:
    """Keep generated methods small enough for the JIT compiler, and rows where they are.

    HotSpot does not compile methods over 8000 bytecodes; the wide ``when`` chains of the
    rule and text jobs would exceed that in whole-stage code. Spark's default is left
    alone when the session has already chosen a value of its own. Rows that lie by document
    stay there for a join by document and field name, instead of being shuffled once more.
    """
    key = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(key) == "65535":
        spark.conf.set(key, "8000")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


#: Folders of this process, by application: (session, folder). Emptied at exit.
_FOLDERS: dict[str, tuple[SparkSession, str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below the one the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder serves a session that runs in one process; on
    a cluster each executor would write to a disk of its own, so there it is an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            master = spark.sparkContext.master
            if not (master == "local" or master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="dossier-")
        _FOLDERS[app] = (spark, f"{base.rstrip('/')}/dossier-{app}-{uuid.uuid4().hex[:8]}")
    return _FOLDERS[app][1]


def new_path(spark: SparkSession) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's file system layer."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop_stored(spark: SparkSession) -> None:
    """Delete every table that this application has stored; its readers end with it."""
    entry = _FOLDERS.pop(spark.sparkContext.applicationId, None)
    if entry:
        drop_path(spark, entry[1])


@atexit.register
def _drop_all() -> None:
    for spark, folder in list(_FOLDERS.values()):
        try:
            if spark.sparkContext._jsc is not None:
                drop_path(spark, folder)
        except Exception as error:  # the session may have ended on its own; say what stays
            print(f"left {folder}: {type(error).__name__}")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and continue from that table.

    Used where several branches read the same derived rows: lineage is cut, a lost
    executor only costs re-reading files, and each branch scans just its own columns. The
    tables go when the application ends, or earlier by ``drop_stored``.
    """
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Deal rows out by ``by`` to every core, ahead of work that costs far more than the read.

    A file of short rows has few splits, however long each of its rows takes.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(parts, *by)


def data_root(default: str = "/root/testdata/sf0.1") -> str:
    return os.environ.get("BENCH_SF_DIR", default)
