"""Removal of long word spans that repeat across documents, by De Bruijn compaction.

The edges of the graph are the windows of ``k`` consecutive words. The scan already compacts
them: consecutive windows of a document that share their smallest ``m``-word hash (their
minimizer) form a path piece, written as one row with a hash of its words. Equal windows have
equal minimizers, so everything equal meets under one minimizer.

A join then tells nonbranching paths from branching ones. A minimizer under which only one
piece is ever spelled does not branch: its piece is decided as a whole by the smallest
document that holds it. Under any other minimizer (pieces that only overlap: the ends of a
repeated span, edited copies) the pieces are opened again, and their single windows are
decided one by one. A fixed-size bit array of the branching minimizers lets the second scan
open only those pieces; what the array lets through in error costs work, never a result. The
source coordinates of decided pieces and windows are joined back to the texts, where each is
verified against the words that stand there before they are removed.

Equality of windows is that of two independent 64-bit hashes, the minimizer's and the
window's own.

Cases: null text has no words; texts under ``k`` words stay whole; what repeats only within
one document stays; of rows with one id each counts by itself and equal ids never remove from
each other; null ids are not compared; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.registry import query, table
from dossier.llm.words import Powers, RangeHashes, WordHashes, text_words
from dossier.session import stored

WINDOW = 50
MINIMIZER = 16
#: 16 MB: the bit array of branching minimizers, the same at every size.
FILTER_BITS = 1 << 27


class _Windows:
    """Hashes of the windows of texts, and their minimizers."""

    def __init__(self, k: int, m: int) -> None:
        self.k, self.m = k, m
        self.hashes, self.powers = WordHashes(), Powers()

    def of(self, text: str | None):
        """(window hashes, minimizers, first window of each piece, range hashes), or None."""
        words = text_words(text)
        if len(words) < self.k:
            return None
        ranges = RangeHashes(self.hashes.of(words), self.powers)
        small = ranges.windows(self.m)
        span = sliding_window_view(small, self.k - self.m + 1)
        place = span.argmin(axis=1) + np.arange(len(span))
        starts = np.flatnonzero(np.diff(place, prepend=-1))
        return ranges.windows(self.k), small[place], starts, ranges


def _batch(columns: list[tuple[str, pa.DataType, list[np.ndarray]]]) -> pa.RecordBatch:
    arrays = [
        pa.array(np.concatenate(parts) if parts else np.zeros(0), kind, safe=False)
        for _, kind, parts in columns
    ]
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _, _ in columns])


def _pieces(df: DataFrame, k: int, m: int) -> DataFrame:
    """Path pieces: minimizer, piece hash, id, first window, number of windows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Windows(k, m)
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = reader.of(text) if i is not None else None
                if found is None:
                    continue
                windows, least, starts, ranges = found
                stops = np.append(starts[1:], len(windows))
                out[0].append(least[starts].view(np.int64))
                out[1].append(ranges.ranges(starts, stops + k - 1).view(np.int64))
                out[2].append(np.full(len(starts), i, np.int64))
                out[3].append(starts)
                out[4].append(stops - starts)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield _batch(list(zip(("least", "piece", "id", "start", "n"), kinds, out)))

    return df.mapInArrow(scan, "least long, piece long, id long, start int, n int")


def _branching_filter(branching: DataFrame, bits: int) -> bytes:
    """Bit array of the branching minimizers; ``bits`` bounds what reaches the driver."""
    rows = branching.groupBy(F.expr(f"pmod(least, {bits}L) div 64").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(least, {bits}L) % 64 AS int))")).alias("bits")
    )
    words = np.zeros(bits // 64, np.int64)
    for part in rows.toArrow().to_batches():
        words[part.column(0).to_numpy()] = part.column(1).to_numpy()
    return words.tobytes()


def _opened(df: DataFrame, k: int, m: int, branching) -> DataFrame:
    """Single windows under minimizers that the bit array has."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Windows(k, m)
        words = np.frombuffer(branching.value, np.uint64)
        bits = np.uint64(64 * len(words) - 1)
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = reader.of(text) if i is not None else None
                if found is None:
                    continue
                windows, least, _, _ = found
                spot = least & bits
                hit = np.flatnonzero((words[spot >> np.uint64(6)] >> (spot & np.uint64(63))) & np.uint64(1))
                if len(hit):
                    out[0].append(least[hit].view(np.int64))
                    out[1].append(windows[hit].view(np.int64))
                    out[2].append(np.full(len(hit), i, np.int64))
                    out[3].append(hit)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32()]
            yield _batch(list(zip(("least", "window", "id", "start"), kinds, out)))

    return df.mapInArrow(scan, "least long, window long, id long, start int")


def _mark(name: str) -> Column:
    return F.expr(f"shiftright(shiftleft({name}, 32), 32)").cast("int").alias("mark")


def _verified(ranges: RangeHashes, begin: np.ndarray, n: np.ndarray, mark: np.ndarray, k: int):
    """Which runs say the words of this very text; rows that share an id share their runs.

    ``n`` is 0 for a single window, whose hash leaves the length out."""
    size = len(ranges.sums) - 1
    inside = begin + np.maximum(n, 1) + (k - 1) <= size
    own = np.zeros(len(begin), np.uint64)
    piece, single = inside & (n > 0), inside & (n == 0)
    own[piece] = ranges.ranges(begin[piece], begin[piece] + n[piece] + (k - 1))
    own[single] = ranges.windows_at(begin[single], k)
    return inside & (own.astype(np.uint32).view(np.int32) == mark)


def repeated_spans(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = WINDOW,
    m: int = MINIMIZER,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """(id, start, n, mark): runs of ``n`` windows from word ``start`` on, each of which also
    starts in a row with a smaller id. ``mark``: low half of the hash of the words of the run."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    pieces = stored(_pieces(rows, k, m))
    first = pieces.groupBy("least", "piece").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    first = stored(first)
    branching = first.groupBy("least").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("least")
    branching = stored(branching)
    # One piece under its minimizer, held by several documents: decided as a whole.
    straight = first.filter("first < last").join(branching, "least", "left_anti").select("least", "piece", "first")
    whole = pieces.join(straight, ["least", "piece"]).filter("id > first")
    whole = whole.select("id", "start", "n", _mark("piece"))
    held = spark.sparkContext.broadcast(_branching_filter(branching, filter_bits))
    windows = stored(_opened(rows, k, m, held))
    sources = windows.groupBy("least", "window").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    single = (
        windows.join(sources.filter("first < last").drop("last"), ["least", "window"])
        .filter("id > first")
        .select("id", "start", F.lit(0).alias("n"), _mark("window"))
    )
    # Pieces that the bit array let through in error are decided twice, alike.
    return whole.unionByName(single)


def remove_repeats(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = WINDOW,
    m: int = MINIMIZER,
    filter_bits: int = FILTER_BITS,
    texts: bool = True,
) -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256 and, if asked for, the kept text."""
    spans = repeated_spans(df, id_col, text_col, k, m, filter_bits)
    by_row = spans.groupBy("id").agg(F.collect_list(F.struct("start", "n", "mark")).alias("spans"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    joined = rows.join(by_row, "id", "left").select(
        "id",
        "text",
        F.transform("spans", lambda s: s["start"]).alias("starts"),
        F.transform("spans", lambda s: s["n"]).alias("ns"),
        F.transform("spans", lambda s: s["mark"]).alias("marks"),
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, powers = WordHashes(), Powers()
        for batch in batches:
            counts, removed, digests, kept_texts = [], [], [], []
            for text, starts, ns, marks in zip(*(c.to_pylist() for c in batch.columns[1:])):
                words = text_words(text)
                counts.append(len(words))
                gone = 0
                if starts:
                    begin, n = np.array(starts), np.array(ns)
                    ranges = RangeHashes(hashes.of(words), powers)
                    true = _verified(ranges, begin, n, np.array(marks, np.int32), k)
                    begin, n = begin[true], np.maximum(n[true], 1)
                    depth = np.zeros(len(words) + 1, np.int64)
                    np.add.at(depth, begin, 1)
                    np.add.at(depth, begin + n + (k - 1), -1)
                    keep = np.cumsum(depth[:-1]) == 0
                    gone = len(words) - int(keep.sum())
                    words = [w for w, stays in zip(words, keep) if stays]
                removed.append(gone)
                kept = b" ".join(words)
                digests.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept.decode("utf-8", "surrogatepass") if texts else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(digests, pa.string()),
                    pa.array(kept_texts, pa.string()),
                ],
                names=["id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    out = joined.mapInArrow(
        cut, "id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    ).withColumnRenamed("id", id_col)
    return out if texts else out.drop("kept_text")


@query("op6_substring_dedup")
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), texts=False)
