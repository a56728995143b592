"""Token counts of whole texts by a two-tier lookup on the map side.

Tier one is a table of the most frequent pre-tokens and their token counts, sent to every
task; it holds at most ``table_entries`` entries. Tier two is the worker's own cache, which
encodes a pre-token when it first meets it and starts anew when it is full. The pre-tokens
of the texts that are counted are never shuffled. Those of the table are: it is made from the
``table_documents`` documents of the lowest id hash, at every size, and Spark sums their
pre-tokens by a shuffle of that bounded sample. It is no statistic of all documents; as it
only saves work, that choice cannot change a count, only how often the cache is asked.

Cases: null text counts as empty (no bytes, no tokens); a special string inside a text is
one token, as by the vocabulary's default; text without white space is one long pre-token
and is merged with a heap in n log n; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.registry import query, table

#: The published splitting pattern of byte-level vocabularies.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

TABLE_ENTRIES = 65_536
TABLE_DOCUMENTS = 2_000
#: Longer pre-tokens stay out of the table, which bounds its bytes.
TABLE_LENGTH = 32
WORKER_ENTRIES = 400_000
#: Longer pre-tokens are counted each time they are met, which bounds the bytes of a worker.
WORKER_LENGTH = 128


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself, or the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


LETTERS = byte_letters()


def vocabulary(path: str) -> dict:
    """Ranks of the merges and the special strings of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    pairs = [p if isinstance(p, list) else p.split(" ") for p in model["model"]["merges"]]
    return {
        "ranks": {(a, b): i for i, (a, b) in enumerate(pairs)},
        "ids": model["model"]["vocab"],
        "special": {t["content"]: t["id"] for t in model["added_tokens"] if t["special"]},
    }


def merged(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Apply the merges of lowest rank first, leftmost first among equals."""
    n = len(symbols)
    symbols, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [
        (r, i, a, b)
        for i, (a, b) in enumerate(zip(symbols, symbols[1:]))
        if (r := ranks.get((a, b))) is not None
    ]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != a or j >= n or symbols[j] != b:
            continue  # one of the two has been merged meanwhile
        symbols[i], symbols[j] = a + b, ""
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
        if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
    return [s for s in symbols if s]


def piece_length(piece: str, ranks: dict[tuple[str, str], int]) -> int:
    return len(merged([LETTERS[b] for b in piece.encode("utf-8", "surrogatepass")], ranks))


class Lengths(dict):
    """Token count of a pre-token: the frequent ones are there, others join when met."""

    def __init__(self, frequent: dict[str, int], ranks: dict[tuple[str, str], int]) -> None:
        super().__init__(frequent)
        self.frequent, self.ranks = frequent, ranks
        self.limit = len(frequent) + WORKER_ENTRIES

    def __missing__(self, piece: str) -> int:
        value = piece_length(piece, self.ranks)
        if len(piece) <= WORKER_LENGTH:
            if len(self) >= self.limit:
                self.clear()
                self.update(self.frequent)
            self[piece] = value
        return value


def _splitter(special: dict[str, int]):
    if not special:
        return lambda text: (text,)
    cut = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)))
    return cut.split


def frequent_pieces(df: DataFrame, id_col: str, text_col: str, vocab, entries: int, documents: int):
    """Token counts of the most frequent pre-tokens of the ``documents`` rows whose ids hash
    lowest; the counting runs in the tasks."""
    key = F.xxhash64(F.col(id_col))
    bound = df.select(key.alias("k")).orderBy("k").limit(documents).agg(F.max("k")).first()[0]
    if bound is None:
        return {}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = vocab.value["ranks"]
        find, parts = regex.compile(PIECES).findall, _splitter(vocab.value["special"])
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for part in parts(text or ""):
                    seen.update(p for p in find(part) if len(p) <= TABLE_LENGTH)
        pieces = list(seen)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(pieces, pa.string()),
                pa.array([seen[p] for p in pieces], pa.int64()),
                pa.array([piece_length(p, ranks) for p in pieces], pa.int32()),
            ],
            names=["piece", "n", "tokens"],
        )

    rows = (
        df.filter(key <= bound)
        .select(text_col)
        .mapInArrow(count, "piece string, n long, tokens int")
        .groupBy("piece", "tokens")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "piece")
        .limit(entries)
        .collect()
    )
    return {r["piece"]: r["tokens"] for r in rows}


def count_tokens(
    df: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 1024,
    table_entries: int = TABLE_ENTRIES,
    table_documents: int = TABLE_DOCUMENTS,
) -> DataFrame:
    """Per row: id, n_bytes, n_tokens and whether the tokens exceed ``limit``.

    ``path``: a byte-level tokenizer file; the driver reads it, the tasks get its contents.
    """
    context = df.sparkSession.sparkContext
    vocab = context.broadcast(vocabulary(path))
    frequent = context.broadcast(
        frequent_pieces(df, id_col, text_col, vocab, table_entries, table_documents)
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(frequent.value, vocab.value["ranks"]).__getitem__
        find, parts = regex.compile(PIECES).findall, _splitter(vocab.value["special"])
        for batch in batches:
            counts = []
            for text in batch.column(1).to_pylist():
                pieces = parts(text) if text else ("",)
                counts.append(len(pieces) - 1 + sum(sum(map(lengths, find(p))) for p in pieces))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts, pa.int64())],
                names=["id", "n_bytes", "n_tokens"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    texts = df.select(
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
        F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"),
    )
    return texts.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long").select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
