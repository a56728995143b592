"""Exact deduplication in two passes with a Bloom filter, in DataFrame operations only.

Pass one hashes every text to two slots of a bit array and keeps the bits of the slots hit
more than once. Pass two tests each row against that array: a row with an unset bit has no
equal and passes straight through; only the others shuffle, and an exact digest decides.
Where only decisions are asked for, one scan of the texts stores the digests and both passes
run over those.

The array grows with the number of rows, up to ``max_bits``; that bounds what reaches every
task. Beyond it more rows than necessary shuffle and the result stays the same.

Cases: null text counts as empty; equal means identical after lower-casing A to Z only; of
equal texts the largest id stays, null ids being smallest; of rows that repeat id and text
one stays; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.registry import query, table
from dossier.session import stored

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: 16 MB: the largest bit array that is sent to the tasks.
MAX_BITS = 1 << 27


def normalized(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())


def _slots(key: Column, bits: int) -> list[Column]:
    return [F.pmod(h, F.lit(bits)) for h in (key, F.xxhash64(key))]


def repeated_slots(df: DataFrame, key: Column, max_bits: int = MAX_BITS) -> tuple[Column, int]:
    """The bit array of slots hit at least twice, as a one-value subquery, and its size.

    ``key``: a 64-bit hash of what is compared."""
    bits = 1 << 16
    rows = df.count()
    while bits < min(16 * rows, max_bits):
        bits *= 2
    hit = (
        df.select(F.explode(F.array(*_slots(key, bits))).alias("slot"))
        .groupBy("slot")
        .agg(F.count(F.lit(1)).alias("hits"))
        .filter("hits > 1")
    )
    words = hit.groupBy(F.expr("slot div 64").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 AS int))")).alias("bits")
    )
    every = df.sparkSession.range(bits // 64).withColumnRenamed("id", "word")
    dense = every.join(words, "word", "left").select(
        F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("w")
    )
    array = dense.agg(F.array_sort(F.collect_list("w")).getField("bits").alias("filter"))
    return array.scalar(), bits


def possibly_repeated(key: Column, array: Column, bits: int) -> Column:
    """False only for rows whose key no other row has."""
    test = F.lit(True)
    for slot in _slots(key, bits):
        word = F.get(array, F.floor(slot / 64).cast("int"))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))
        test = test & (word.bitwiseAND(bit) != 0)
    return test


def mark_copies(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept and text_sha256."""
    hashed = stored(
        df.select(
            F.col(id_col).alias("id"),
            F.monotonically_increasing_id().alias("row"),
            F.unhex(F.sha2(normalized(df[text_col]), 256)).alias("digest"),
        )
    )
    key = F.xxhash64("digest")
    array, bits = repeated_slots(hashed, key, max_bits)
    rows = hashed.withColumn("again", possibly_repeated(key, array, bits))
    alone = rows.filter("NOT again").select(
        "id",
        F.col("id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        "digest",
    )
    again = rows.filter("again")
    groups = again.groupBy("digest").agg(
        F.max(F.struct("id", "row")).alias("best"), F.count(F.lit(1)).alias("group_size")
    )
    decided = again.join(groups, "digest").select(
        "id",
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        "digest",
    )
    return alone.unionByName(decided).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS
) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns.

    The best row of a group is an aggregate, so copies fall away before the shuffle.
    """
    key = F.xxhash64(normalized(df[text_col]))
    array, bits = repeated_slots(df, key, max_bits)
    test = possibly_repeated(key, array, bits)
    whole = F.struct(*[df[c] for c in df.columns])
    order = F.struct(df[id_col], F.xxhash64(whole))
    best = (
        df.filter(test)
        .groupBy(F.unhex(F.sha2(normalized(df[text_col]), 256)).alias("_digest"))
        .agg(F.max_by(whole, order).alias("_row"))
        .select("_row.*")
    )
    return df.filter(~test).unionByName(best)


@query(
    "op8_exact_dedup",
    f"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS t FROM documents)
WINDOW g AS (PARTITION BY t)""",
)
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_copies(table(spark, sf_dir, "documents"))
