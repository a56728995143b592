"""Order-dependent steps that stay parallel when one key holds most of the rows.

A plain window sends every row of a key to one task. Here each key is cut into
chunks by ``chunk``, an expression that never decreases along the sort order (a
time bucket, a page range). Rows are handled inside (key, chunk); what crosses a
chunk border is carried by a small per-chunk summary, whose size depends on the
number of chunks and not on the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.session import stored

CHUNK = "_chunk"


def day_chunk(ts: str) -> Column:
    """Days since 1970 of a timestamp column."""
    return F.datediff(F.col(ts).cast("date"), F.lit("1970-01-01").cast("date"))


def hour_chunk(ts: str) -> Column:
    """Hours since 1970, for histories where one key is very active in a day."""
    return day_chunk(ts) * 24 + F.hour(F.col(ts))


def range_chunk(position: str, width: int = 256) -> Column:
    """Blocks of consecutive positions such as page or line numbers."""
    return F.floor(F.col(position) / width).cast("int")


def _attach(rows: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    names = [*keys, CHUNK]
    renamed = summary.select(
        *[F.col(n).alias(f"_r_{n}") for n in names],
        *[c for c in summary.columns if c not in names],
    )
    same = None
    for n in names:
        part = rows[n].eqNullSafe(renamed[f"_r_{n}"])
        same = part if same is None else same & part
    return rows.join(renamed, same, "left").drop(*[f"_r_{n}" for n in names])


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    chunk: Column,
    out: str = "position",
    descending: bool = False,
) -> DataFrame:
    """``row_number`` per key (or over the whole table when ``keys`` is empty)."""
    rows = df.withColumn(CHUNK, chunk)
    totals = rows.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("_n"))
    chunk_order = F.col(CHUNK).desc() if descending else F.col(CHUNK).asc()
    before = (
        Window.partitionBy(*keys)
        .orderBy(chunk_order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *keys, CHUNK, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    local = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    rows = rows.withColumn("_local", F.row_number().over(local))
    return (
        _attach(rows, offsets, keys)
        .withColumn(out, (F.col("_local") + F.coalesce(F.col("_before"), F.lit(0))).cast("long"))
        .drop("_local", "_before", CHUNK)
    )


def evenly_numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "position"
) -> DataFrame:
    """``row_number`` where no time bucket bounds a chunk, as after a bulk import.

    Rows are dealt out by ranges of keys and order, so chunks are of like size whatever their
    times are. Each row is stored with its chunk, so a task that runs again finds the same one.
    """
    dealt = df.repartitionByRange(*[F.col(k) for k in keys], *order)
    rows = stored(dealt.withColumn(CHUNK, F.spark_partition_id()))
    return numbered(rows, keys, order, F.col(CHUNK), out)


def with_next(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    values: Sequence[str],
    prefix: str = "next_",
) -> DataFrame:
    """Values of the following row of the same key (``lead`` by one)."""
    rows = df.withColumn(CHUNK, chunk)
    local = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    payload = F.struct(*values)
    firsts = rows.groupBy(*keys, CHUNK).agg(
        F.min_by(payload, F.struct(*order)).alias("_first")
    )
    carried = firsts.select(
        *keys,
        CHUNK,
        F.lead("_first").over(Window.partitionBy(*keys).orderBy(CHUNK)).alias("_carry"),
    )
    rows = rows.withColumn("_lead", F.lead(payload).over(local))
    joined = _attach(rows, carried, keys)
    following = F.coalesce(F.col("_lead"), F.col("_carry"))
    for v in values:
        joined = joined.withColumn(prefix + v, following[v])
    return joined.drop("_lead", "_carry", CHUNK)


def with_previous_where(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    condition: Column,
    value: Column,
    out: str,
) -> DataFrame:
    """``value`` of the nearest earlier row that meets ``condition``, wrapped in a
    one-field struct so that a null value differs from "no such row"."""
    rows = df.withColumn(CHUNK, chunk).withColumn(
        "_mark", F.when(condition, F.struct(value.alias("value")))
    )
    earlier = (
        Window.partitionBy(*keys, CHUNK)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    chunk_lasts = rows.groupBy(*keys, CHUNK).agg(
        F.max_by("_mark", F.when(F.col("_mark").isNotNull(), F.struct(*order))).alias("_last")
    )
    carried = chunk_lasts.select(
        *keys,
        CHUNK,
        F.last("_last", ignorenulls=True)
        .over(
            Window.partitionBy(*keys)
            .orderBy(CHUNK)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        .alias("_carry"),
    )
    rows = rows.withColumn("_local", F.last("_mark", ignorenulls=True).over(earlier))
    return (
        _attach(rows, carried, keys)
        .withColumn(out, F.coalesce(F.col("_local"), F.col("_carry")))
        .drop("_local", "_carry", "_mark", CHUNK)
    )


def with_running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    value: Column,
    out: str,
) -> DataFrame:
    """Inclusive running sum per key."""
    rows = df.withColumn(CHUNK, chunk).withColumn("_v", value)
    totals = rows.groupBy(*keys, CHUNK).agg(F.sum("_v").alias("_n"))
    before = (
        Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *keys, CHUNK, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    local = (
        Window.partitionBy(*keys, CHUNK)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rows = rows.withColumn("_local", F.sum("_v").over(local))
    return (
        _attach(rows, offsets, keys)
        .withColumn(out, F.col("_local") + F.coalesce(F.col("_before"), F.lit(0)))
        .drop("_local", "_before", "_v", CHUNK)
    )


def latest_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], first: bool = False
) -> DataFrame:
    """Whole row with the greatest (or least) order per key, as a partial aggregate."""
    pick = F.min_by if first else F.max_by
    return (
        df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys])
        .agg(pick(F.struct(*df.columns), F.struct(*order)).alias("_row"))
        .select("_row.*")
    )
