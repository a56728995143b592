"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over ``SPAN`` consecutive tokens that ignores some positions, so two
passages that differ in an ignored token still hash alike; several masks ignore different
positions. The masks are chosen by enumeration: wherever the substitutions lie that ``SHARE``
allows in the compared window (``OVERLAP`` tokens or a shorter item), some mask misses them all.
A smaller ``overlap`` or ``share`` than these has no such guarantee. Hashes of the documents are joined with those of the benchmark items. A hit names
a diagonal (document position less item position); along it the tokens around the hit are
compared, and the pair counts as an overlap when some window of ``overlap`` tokens, or the
whole item if shorter, agrees in at least ``share`` of them.

A bit array of fixed size, made from the item hashes, lets a scan of the documents pass on
only hashes that an item may have; it saves work and decides nothing. Hits that lie close
together travel as one segment with the tokens around them.

Tokens are runs between white space and ASCII punctuation, lower-cased.

Cases: null texts have no tokens, and items without tokens match nothing; an item of one token
matches every document that has the token; a null id is kept as such; repeated rows give one result row; empty
tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.registry import query, table
from dossier.llm.words import WordHashes, mixed
from dossier.session import stored

#: Fixed masks. In order: for items of 13 tokens or more (2 of 13 may differ), of 10 to 12 (2 of
#: 10), of 5 to 9 (1 of 5), and of 4 to 1 (none, the first of them is shared with those before).
MASKS = (
    "11101111", "1110100111", "1101001010011",
    "111011", "11001011", "101010011",
    "11101", "10111", "11011",
    "1111", "111", "11", "1",
)
SPAN = 13
OVERLAP = 13
SHARE = 0.8
#: Tokens of a document between the first and the last hit of a segment, at most; one that goes
#: on begins a new segment, and both hold the tokens around their own hits.
SEGMENT = 256
#: Items up to this length match as a whole or not at all.
WHOLE = 4
#: 8 MB: the bit array of item hashes, the same at every size.
FILTER_BITS = 1 << 26

_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_TO_SPACE = bytes.maketrans(_PUNCTUATION, b" " * len(_PUNCTUATION))


def tokens(text: str | None) -> list[bytes]:
    if not text:
        return []
    return text.lower().encode("utf-8", "surrogatepass").translate(_TO_SPACE).split()


def masks_for(length: int) -> range:
    """Numbers of the masks that find an item of so many tokens."""
    if length >= 13:
        return range(3)
    if length >= 10:
        return range(3, 6)
    if length >= 5:
        return range(6, 10)
    return range(13 - length, 14 - length) if length else range(0)


def seed_hashes(h: np.ndarray, numbers: Iterable[int]) -> list[np.ndarray]:
    """For each of these masks, the hash at every position where it fits."""
    out = []
    for number in numbers:
        mask = MASKS[number]
        n = len(h) - len(mask) + 1
        if n <= 0:
            out.append(np.zeros(0, np.uint64))
            continue
        total = np.full(n, number + 1, np.uint64)
        for offset, counts in enumerate(mask):
            if counts == "1":
                total = total * np.uint64(0x9E3779B97F4A7C15) + h[offset : offset + n]
        out.append(mixed(total))
    return out


def _spots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return h & mask, (h >> np.uint64(32)) & mask


def item_hashes(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(hash, item_id, item_pos, mask) of every masked span of every item."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = words.of(tokens(text))
                numbers = masks_for(len(h))
                for number, seeds in zip(numbers, seed_hashes(h, numbers)):
                    out[0].extend(seeds.view(np.int64).tolist())
                    out[1].extend([i] * len(seeds))
                    out[2].extend(range(len(seeds)))
                    out[3].extend([number] * len(seeds))
                    out[4].extend([len(h)] * len(seeds))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            arrays = [pa.array(v, t) for v, t in zip(out, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=["hash", "item_id", "item_pos", "mask", "item_tokens"])

    rows = items.select(F.col(id_col).cast("long"), text_col)
    return rows.mapInArrow(scan, "hash long, item_id long, item_pos int, mask int, item_tokens int")


def _hash_filter(hashes: DataFrame, bits: int) -> bytes:
    """Bit array with two bits per hash, put together from bounded parts."""
    spots = hashes.select(
        F.explode(
            F.array(F.expr(f"hash & {bits - 1}L"), F.expr(f"shiftrightunsigned(hash, 32) & {bits - 1}L"))
        ).alias("spot")
    )
    words = spots.groupBy(F.expr("spot div 64").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(spot % 64 AS int))")).alias("bits")
    )
    out = np.zeros(bits // 64, np.int64)
    for part in words.toArrow().to_batches():
        out[part.column(0).to_numpy()] = part.column(1).to_numpy()
    return out.tobytes()


def _segments(documents: DataFrame, id_col: str, text_col: str, held, masks: list[int], reach: int) -> DataFrame:
    """Stretches of documents around possible hits, with their tokens and the hits."""
    number = pa.int64()
    schema = pa.schema(
        [("segment", number), ("doc_id", number), ("start", pa.int32()), ("tokens", pa.list_(number)),
         ("hit_hash", pa.list_(number)), ("hit_pos", pa.list_(pa.int32()))]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, made = WordHashes(), TaskContext.get().partitionId() << 40
        bit_words = np.frombuffer(held.value, np.uint64)
        bits = 64 * len(bit_words)

        def known(h: np.ndarray) -> np.ndarray:
            out = np.ones(len(h), bool)
            for spot in _spots(h, bits):
                out &= ((bit_words[spot >> np.uint64(6)] >> (spot & np.uint64(63))) & np.uint64(1)) > 0
            return out

        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = words.of(tokens(text))
                found = [(s[w], w) for s in seed_hashes(h, masks) for w in [np.flatnonzero(known(s))]]
                at = np.concatenate([w for _, w in found]) if found else []
                if not len(at):
                    continue
                value = np.concatenate([s for s, _ in found]).view(np.int64)
                order = np.argsort(at, kind="stable")
                at, value = at[order], value[order]
                for part, own in zip(*(np.split(x, _breaks(at, reach)) for x in (at, value))):
                    low, high = max(0, int(part[0]) - reach), int(part[-1]) + SPAN + reach
                    rows.append((made, i, low, h[low:high].view(np.int64).tolist(), own.tolist(), (part - low).tolist()))
                    made += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in rows], t) for c, t in enumerate(schema.types)], schema=schema
            )

    rows = documents.select(F.col(id_col).cast("long"), text_col)
    return rows.mapInArrow(
        scan,
        "segment long, doc_id long, start int, tokens array<long>, hit_hash array<long>, hit_pos array<int>",
    )


def _breaks(at: np.ndarray, reach: int) -> list[int]:
    """Where a new segment begins: behind a gap, or where the last one would grow too long."""
    gaps = np.flatnonzero(np.diff(at) > reach) + 1
    out, first = [], 0
    for stop in (*gaps.tolist(), len(at)):
        while at[stop - 1] - at[first] > SEGMENT:
            first = int(np.searchsorted(at, at[first] + SEGMENT, "right"))
            out.append(first)
        if stop < len(at):
            out.append(stop)
            first = stop
    return out


class _Item:
    """Tokens of an item and the positions of its seeds, by hash."""

    def __init__(self, words: list[int]) -> None:
        self.words = np.array(words, np.int64)
        h = self.words.view(np.uint64)
        seeds = [s.view(np.int64) for s in seed_hashes(h, masks_for(len(h)))]
        hashes = np.concatenate([*seeds, np.zeros(0, np.int64)])
        places = np.concatenate([*(np.arange(len(s)) for s in seeds), np.zeros(0, np.int64)])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.places = hashes[order], places[order]

    def diagonals(self, hit_hash: np.ndarray, hit_pos: np.ndarray) -> list[int]:
        found = [np.zeros(0, np.int64)]
        for value in np.unique(hit_hash).tolist():
            a, b = np.searchsorted(self.hashes, [value, value + 1] if value < 2**63 - 1 else [value, value])
            b = b if value < 2**63 - 1 else len(self.hashes)
            if a < b:
                own = hit_pos[hit_hash == value]
                found.append(np.unique(own[:, None] - self.places[None, a:b]))
        return np.unique(np.concatenate(found)).tolist()


def _overlap(document: np.ndarray, item: np.ndarray, diagonal: int, length: int):
    """Best window on the diagonal: (equal tokens, start in ``document``), or None."""
    low, high = max(0, diagonal), min(len(document), diagonal + len(item))
    if high - low < length:
        return None
    same = document[low:high] == item[low - diagonal : high - diagonal]
    sums = np.concatenate([[0], np.cumsum(same)])
    windows = sums[length:] - sums[:-length]
    best = int(windows.argmax())
    return int(windows[best]), low + best


def contaminated(
    documents: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    overlap: int = OVERLAP,
    share: float = SHARE,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """One row per overlapping (document, item): doc_id, item_id, the start of the best
    window in both, its length and the number of equal tokens."""
    spark = documents.sparkSession
    hashes = stored(item_hashes(benchmark, item_id_col, item_text_col))
    held = spark.sparkContext.broadcast(_hash_filter(hashes, filter_bits))
    masks = sorted(r["mask"] for r in hashes.select("mask").distinct().collect())
    segments = stored(_segments(documents, id_col, text_col, held, masks, overlap))
    # Which segments share a hash with which items; each then meets the other's tokens once,
    # whatever the number of their common hashes.
    met = (
        segments.select("segment", "doc_id", "start", F.explode(F.array_distinct("hit_hash")).alias("hash"))
        .join(hashes.select("hash", "item_id", "item_tokens").distinct(), "hash")
        .select("segment", "doc_id", "start", "item_id", "item_tokens")
        .distinct()
    )
    # A short item that is there at all is there whole: its first segment decides.
    first = met.filter(F.col("item_tokens") <= WHOLE).groupBy("doc_id", "item_id").agg(
        F.min(F.struct("start", "segment")).getField("segment").alias("segment")
    )
    wanted = met.filter(F.col("item_tokens") > WHOLE).select("segment", "item_id")
    wanted = wanted.unionByName(first.select("segment", "item_id"))

    def item_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            own = [words.of(tokens(t)).view(np.int64).tolist() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(own, pa.list_(pa.int64()))], names=["item_id", "item"]
            )

    items = benchmark.select(F.col(item_id_col).cast("long").alias("item_id"), item_text_col)
    items = items.mapInArrow(item_tokens, "item_id long, item array<long>")
    pairs = wanted.join(segments, "segment").join(items, "item_id")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, item = None, None
        for batch in batches:
            rows = []
            for doc, item_id, start, document, hit_hash, hit_pos, own in zip(*(c.to_pylist() for c in batch.columns)):
                if item is None or item_id != last or len(own) != len(item.words):
                    last, item = item_id, _Item(own)
                length, best = min(overlap, len(own)), None
                words = np.array(document)
                for diagonal in item.diagonals(np.array(hit_hash), np.array(hit_pos)):
                    if best and best[0] == length and max(0, diagonal) >= best[1]:
                        break  # no window behind it is better
                    found = _overlap(words, item.words, diagonal, length)
                    if found and (best is None or (found[0], -found[1]) > (best[0], -best[1])):
                        best = (*found, diagonal)
                if best and best[0] >= share * length:
                    equal, at, diagonal = best
                    rows.append((doc, item_id, start + at, at - diagonal, length, equal))
            kinds = (pa.int64(), pa.int64(), *[pa.int32()] * 4)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)],
                names=["doc_id", "item_id", "doc_start", "item_start", "n_tokens", "n_equal"],
            )

    columns = ("doc_id", "item_id", "start", "tokens", "hit_hash", "hit_pos", "item")
    found = pairs.select(*columns).mapInArrow(
        verify, "doc_id long, item_id long, doc_start int, item_start int, n_tokens int, n_equal int"
    )
    best = found.groupBy("doc_id", "item_id").agg(
        F.max(F.struct("n_equal", -F.col("doc_start"), "doc_start", "item_start", "n_tokens")).alias("b")
    )
    return best.select(
        F.col("doc_id").alias(id_col), "item_id", "b.doc_start", "b.item_start", "b.n_tokens", "b.n_equal"
    )


def clean_documents(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents`` that overlap with no benchmark item."""
    found = contaminated(documents, benchmark).select("doc_id").distinct()
    return documents.join(found, "doc_id", "left_anti").select(documents.columns)


@query("op2_decontamination")
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
