"""Stored tables that change by versions: replaced groups of rows, merged updates, batches.

A table is a folder. Every write makes files of its own below ``data`` and then one manifest,
``manifests/<number>``, that names the live files: for each bucket the folder of its base rows,
and the folders of updates that came later. A manifest appears by a rename that fails where its
number is taken, so readers see either the old table or the new one, a writer that dies leaves
files that no manifest names, and of two writers at a time the second gets an error and
changes nothing. Rows lie in buckets by the hash of their bucket columns; a write reads and
replaces only the buckets it touches.
"""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dossier.session import stored

BUCKET, _SEQ, _PLACE = "_bucket", "_seq", "_place"
DEFAULT_BUCKETS = 64
#: Bytes of a table that are merged by a shuffle; more are merged bucket by bucket, without one.
SHUFFLED = 32 << 20


class Conflict(RuntimeError):
    """Another writer has published this version first."""


class Folder:
    """Files below one path, through Spark's file system layer."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._of("").getFileSystem(self._conf)

    def _of(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str) -> list[str]:
        at = self._of(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._of(name))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._of(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def size(self, name: str) -> int:
        return self._fs.getContentSummary(self._of(name)).getLength()

    def drop(self, name: str) -> None:
        self._fs.delete(self._of(name), True)

    def move(self, name: str, to: str) -> bool:
        """Rename; false where ``to`` exists already."""
        target = self._of(to)
        self._fs.mkdirs(target.getParent())
        options = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        none = self.spark.sparkContext._gateway.new_array(options, 0)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf)
        try:
            context.rename(self._of(name), target, none)
        except Exception:
            if self._fs.exists(target):
                return False
            raise
        return True

    def publish(self, name: str, text: str) -> bool:
        """Make a file appear with its whole content; false where it exists already."""
        draft = f"_drafts/{uuid.uuid4().hex}"
        stream = self._fs.create(self._of(draft), False)
        stream.write(text.encode("utf-8"))
        stream.close()
        done = self.move(draft, name)
        if not done:
            self.drop(draft)
        return done


def _all_equal(left: Sequence[str], right: Sequence[str]) -> Column:
    return functools.reduce(Column.__and__, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)])


class VersionedTable:
    """A table at ``path`` whose rows lie in buckets by ``bucket_by``.

    The first write fixes schema, bucket columns and number of buckets; later ones find them
    in the manifest.
    """

    def __init__(
        self, spark: SparkSession, path: str, bucket_by: Sequence[str], buckets: int = DEFAULT_BUCKETS
    ) -> None:
        self.spark, self.folder = spark, Folder(spark, path)
        self.state = {"bucket_by": list(bucket_by), "buckets": buckets, "schema": None, "base": {}, "updates": []}
        self.number = -1
        self.refresh()

    def refresh(self) -> None:
        """Go on from the newest version."""
        names = self.folder.names("manifests")
        if names:
            self.number = max(map(int, names))
            self.state = json.loads(self.folder.read(f"manifests/{self.number:010d}"))

    # Reading -----------------------------------------------------------------------------

    @property
    def schema(self) -> StructType:
        return StructType.fromJson(self.state["schema"])

    def _bucket(self) -> Column:
        hashed = F.xxhash64(*[F.col(c) for c in self.state["bucket_by"]])
        return F.pmod(hashed, F.lit(self.state["buckets"])).cast("int")

    def _files(self, folders: Sequence[str], schema: StructType) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.folder.path}/data/{f}" for f in folders]
        return self.spark.read.schema(schema).parquet(*paths)

    def _base(self, buckets: Sequence[int] | None = None) -> DataFrame:
        wanted = self.state["base"] if buckets is None else {str(b) for b in buckets} & set(self.state["base"])
        return self._files([f"{self.state['base'][b]}/{BUCKET}={b}" for b in sorted(wanted)], self.schema)

    def _merge(self, updates: Sequence[int]) -> Callable[..., DataFrame]:
        """How rows that these updates touch are merged. Rows of the base take the
        newest offer of each column, but keep what they have in the columns to keep; a new key
        gives one row, whose columns to keep hold what the key was added with."""
        keys, keep, names = self.state["keys"], self.state["keep"], self.schema.names
        own, seq = Window.partitionBy(*keys), F.lit(-1)
        for i in updates:
            folder = self.state["updates"][i]["folder"]
            seq = F.when(F.col("_metadata.file_path").contains(f"/{folder}/"), i).otherwise(seq)
        columns = []
        for name in names:
            offers = [i for i in updates if name in self.state["updates"][i]["columns"]]
            if name in keys or name in keep or not offers:
                columns.append(F.col(name))
            else:
                # Of equal keys in the base, each row keeps its own values where none is offered.
                at = F.when(F.col(_SEQ).isin(offers), F.col(_SEQ))
                newest = F.max_by(name, at).over(own)
                columns.append(F.when(F.max(at).over(own).isNotNull(), newest).otherwise(F.col(name)).alias(name))
        place = F.row_number().over(own.orderBy(_SEQ)).alias(_PLACE)

        def merge(rows: DataFrame, tasks: int | None = None) -> DataFrame:
            found = rows.select(*names, seq.alias(_SEQ))
            found = (found.coalesce(tasks) if tasks else found).select(*columns, _SEQ, place)
            return found.filter((F.col(_SEQ) < 0) | (F.col(_PLACE) == 1)).select(*names)

        return merge

    def _rows(self, buckets: Sequence[int] | None = None) -> DataFrame:
        base, updates = self.state["base"], self.state["updates"]
        held = {int(b) for b in base}
        wanted = held.union(*(u["buckets"] for u in updates)) if buckets is None else set(buckets)
        touched = sorted(wanted & set().union(*(u["buckets"] for u in updates)))
        plain = self._base((held & wanted).difference(touched))
        if not touched:
            return plain
        # A column that an update did not offer reads as null.
        merge = self._merge(range(len(updates)))
        places = {b: [f"{u['folder']}/{BUCKET}={b}" for u in updates if b in u["buckets"]] for b in touched}
        for b in held.intersection(touched):
            places[b].append(f"{base[str(b)]}/{BUCKET}={b}")
        folders = {base[str(b)] for b in held.intersection(touched)} | {u["folder"] for u in updates}
        if sum(self.folder.size(f"data/{f}") for f in folders) <= SHUFFLED:
            rows = self._files([p for b in touched for p in places[b]], self.schema)
            return plain.unionAll(merge(rows))
        # One task reads a whole bucket, so that a key's rows meet without a shuffle.
        parts = [plain, *(merge(self._files(places[b], self.schema), 1) for b in touched)]
        while len(parts) > 1:  # pair by pair, as every union looks through its whole plan
            parts = [functools.reduce(DataFrame.unionAll, parts[i : i + 2]) for i in range(0, len(parts), 2)]
        return parts[0]

    def read(self) -> DataFrame:
        """The rows of the version that this object stands at."""
        if self.state["schema"] is None:
            raise ValueError(f"no table at {self.folder.path}")
        return self._rows()

    # Writing -----------------------------------------------------------------------------

    def _commit(self, state: dict) -> None:
        number = self.number + 1
        if not self.folder.publish(f"manifests/{number:010d}", json.dumps(state)):
            raise Conflict(f"version {number} of {self.folder.path} is there already")
        self.number, self.state = number, state

    def _write(self, rows: DataFrame, deal: bool = True) -> tuple[str, list[int]]:
        """Store rows by bucket; the folder and the buckets it has. With ``deal`` rows are dealt
        out by bucket first, and one that holds most rows is written by several tasks; without
        it each task writes a file for every bucket that it has rows of."""
        name = uuid.uuid4().hex
        dealt = rows.hint("rebalance", BUCKET) if deal else rows
        dealt.write.partitionBy(BUCKET).parquet(f"{self.folder.path}/data/{name}")
        found = self.folder.names(f"data/{name}")
        return name, [int(f.partition("=")[2]) for f in found if f.startswith(f"{BUCKET}=")]

    def _touched(self, rows: DataFrame) -> list[int]:
        return [r[0] for r in rows.select(BUCKET).distinct().collect()]  # at most ``buckets``

    def replace(self, new: DataFrame, by: Sequence[str], groups: DataFrame | None = None) -> None:
        """Exchange all rows that share the values of ``by`` with a row of ``new`` or, where it
        is given, of ``groups``, which names those that have no rows any more as well. ``by``
        holds the bucket columns. Null equals null."""
        if not set(self.state["bucket_by"]) <= set(by):
            raise ValueError(f"{by} must hold the bucket columns {self.state['bucket_by']}")
        if self.state["updates"]:
            raise ValueError("compact the table first")
        state = self.state | {"schema": self.state["schema"] or json.loads(new.schema.json())}
        rows = stored(new.withColumn(BUCKET, self._bucket()))
        named = rows.select(*by, BUCKET)
        if groups is not None:
            named = named.unionByName(groups.withColumn(BUCKET, self._bucket()).select(*by, BUCKET))
        gone = stored(named.distinct())
        touched = self._touched(gone)
        whole = rows
        if state["base"]:
            own = [f"_by_{c}" for c in by]
            rerun = gone.select(*[F.col(c).alias(g) for c, g in zip(by, own)])
            held = self._base(touched).join(rerun, _all_equal(by, own), "left_anti")
            whole = held.withColumn(BUCKET, self._bucket()).unionByName(rows)
        folder, found = self._write(whole)
        base = {b: f for b, f in state["base"].items() if int(b) not in touched}
        self._commit(state | {"base": base | {str(b): folder for b in found}})

    def create(self, rows: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> None:
        """First version of a table for :meth:`upsert`: one row per ``keys``; ``keep`` columns
        never change once a row is there."""
        if self.number >= 0:
            raise ValueError(f"{self.folder.path} holds a table already")
        folder, found = self._write(rows.withColumn(BUCKET, self._bucket()), deal=False)
        self._commit(
            self.state
            | {"schema": json.loads(rows.schema.json()), "keys": list(keys), "keep": list(keep)}
            | {"base": {str(b): folder for b in found}}
        )

    def upsert(self, updates: DataFrame, token: int | None = None) -> bool:
        """Refresh known keys and add new ones, as files beside the base, which stays as it is.

        ``updates``: the keys, once each, and any of the other columns. Nothing of the table is
        read: which keys are new is found where rows are merged. With a ``token``, a number that
        rises from update to update, one that is there already is not applied again (false).
        """
        if token is not None and token <= self.state.get("token", -1):
            return False
        keys = self.state["keys"]
        folder, found = self._write(updates.withColumn(BUCKET, self._bucket()), deal=False)
        columns = [c for c in updates.columns if c not in keys]
        update = {"folder": folder, "columns": columns, "buckets": found}
        state = self.state | {"updates": [*self.state["updates"], update]}
        self._commit(state if token is None else state | {"token": token})
        return True

    def compact(self) -> None:
        """Merge the updates into the base of the buckets that have any."""
        touched = sorted({b for u in self.state["updates"] for b in u["buckets"]})
        if touched:
            folder, found = self._write(self._rows(touched).withColumn(BUCKET, self._bucket()), deal=False)
            base = self.state["base"] | {str(b): folder for b in found}
            self._commit(self.state | {"base": base, "updates": []})

    def drop_unused(self, versions: int = 2) -> None:
        """Delete the files that the last ``versions`` manifests do not name, for example after
        a day without writers: files of a write that is under way count as unused."""
        kept = set()
        for name in self.folder.names("manifests")[-versions:]:
            state = json.loads(self.folder.read(f"manifests/{name}"))
            kept |= {*state["base"].values(), *(u["folder"] for u in state["updates"])}
        for name in self.folder.names("manifests")[:-versions]:
            self.folder.drop(f"manifests/{name}")
        for name in self.folder.names("data"):
            if name not in kept:
                self.folder.drop(f"data/{name}")


def append_batch(rows: DataFrame, path: str, batch: int | str) -> bool:
    """Add a batch under its number, once; false where it has been added before.

    The batch is written aside and moved into place as a whole, so tables and streams over
    ``path`` (with the partition column ``batch``) see each row once, whatever is retried.
    """
    folder = Folder(rows.sparkSession, path)
    name = f"batch={batch}"
    if folder.exists(name):
        return False
    aside = f"_aside/{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder.path}/{aside}")
    if folder.move(aside, name):
        return True
    folder.drop(aside)
    return False
