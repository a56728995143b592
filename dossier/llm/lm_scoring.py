"""Masked pseudo-likelihood of documents under a bidirectional window network.

The network predicts every token from the ``REACH`` tokens on both sides of it, itself left
out. Each place of the window has an embedding table of its own; their sum goes through tanh,
and a two-step softmax (64 groups of 64 classes) gives the probability of the token's class.
The score of a document is the sum of the log-probabilities of all its tokens given their
contexts.

Vocabulary: all words of all documents. The most frequent ones are classes of their own; each
other word belongs to a bucket by its hash, and its probability is that of the bucket times
the share of the word in the bucket's tokens. The counts are a table that grows with the
corpus; its most frequent words are broadcast, those beyond are joined to their tokens, by
64 bits of hash. As context, words of a bucket are alike.

The biases start at the counts of the classes. Training reads every token of every document
once: in each round tasks run gradient steps on their part from common weights, and the
weights are averaged by token count. They are summed in pieces, in two levels of Spark groups,
so no task or driver holds the weights of all tasks.

Scores depend on how the documents are split into tasks, as each task takes steps of its own.

Cases: null and empty texts have no tokens, a log-probability of zero and a null mean; a
single word is predicted from the edges alone; repeated rows are scored alike and count as
often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.registry import query, table
from dossier.llm.words import text_words  # noqa: F401  (the words of ``distinct_words``, for callers)
from dossier.session import stored

#: Classes of the network, 64 groups of 64; so many of them are hash buckets of words.
GROUPS = 64
VOCABULARY = GROUPS * GROUPS
BUCKETS = 512
WORDS = VOCABULARY - BUCKETS
#: Words whose counts are broadcast; those of all others are joined.
TABLE_WORDS = 65_536
REACH = 2
HIDDEN = 16
ROUNDS = 2
RATE = 0.1
BATCH = 4096
#: Where the sums of squared gradients begin; gradients are means over a batch, so those of a
#: rare word are small, and a larger start would keep its weights where they are.
SQUARES = 1e-7
#: Bytes of text whose words a task tells apart at a time: to count them, as each run passes its
#: counts on, and to number them.
_COUNT_RUN = 8 << 20
_NUMBER_RUN = 2 << 20
_PIECE = 4096
#: Largest logit whose exponential is taken as it is; 64 of them must be a number of 32 bits.
MOST_LOGIT = 80
_EDGE = VOCABULARY
_ONES = np.ones(GROUPS, np.float32)
#: Places of the numbers of each row in an embedding table.
_CELLS = np.arange((VOCABULARY + 1) * HIDDEN).reshape(-1, HIDDEN)
_PLACES = tuple(o for o in range(-REACH, REACH + 1) if o)


class Network:
    """Weights and their gradient steps, in numpy.

    The last row of ``group`` and of each ``inner`` is the bias, met by a hidden unit that is
    always one. Arrays of a batch's size are kept and used again by the next batch."""

    def __init__(self, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)

        def some(*shape: int) -> np.ndarray:
            return rng.normal(0, 0.1, shape).astype(np.float32)

        self.parts = {
            "tables": some(len(_PLACES), VOCABULARY + 1, HIDDEN),
            "bias": np.zeros(HIDDEN, np.float32),
            "group": some(HIDDEN + 1, GROUPS),
            "inner": some(GROUPS, HIDDEN + 1, GROUPS),
        }
        self.parts["group"][-1] = 0
        self.parts["inner"][:, -1] = 0
        self.squares = {k: np.full_like(v, SQUARES) for k, v in self.parts.items()}
        self.steps = {k: np.zeros_like(v) for k, v in self.parts.items()}
        self.rooms: dict[str, np.ndarray] = {}

    def _room(self, name: str, n: int, width: int, kind: type = np.float32) -> np.ndarray:
        if name not in self.rooms or len(self.rooms[name]) < n:
            self.rooms[name] = np.empty((n, width), kind)
        return self.rooms[name][:n]

    def expect(self, counts: np.ndarray) -> "Network":
        """Start from the probability of every class in the corpus."""
        # Token ``t`` is the member ``t // GROUPS`` of group ``t % GROUPS``.
        by_group = np.maximum(counts, 0.5).reshape(GROUPS, GROUPS).T
        totals = by_group.sum(1)
        self.parts["group"][-1] = np.log(totals / totals.sum())
        self.parts["inner"][:, -1] = np.log(by_group / totals[:, None])
        return self

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.parts.values()])

    def load(self, flat: np.ndarray) -> "Network":
        at = 0
        for name, v in self.parts.items():
            self.parts[name] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size
        return self

    def _hidden(self, contexts: np.ndarray) -> np.ndarray:
        n = contexts.shape[1]
        total, row = self._room("total", n, HIDDEN), self._room("row", n, HIDDEN)
        total[:] = self.parts["bias"]
        for place, own in enumerate(contexts):
            total += np.take(self.parts["tables"][place], own, axis=0, out=row, mode="clip")
        hidden = self._room("hidden", n, HIDDEN + 1)
        hidden[:, -1] = 1
        hidden[:, :-1] = np.tanh(total, out=total)
        return hidden

    def _bounded(self) -> bool:
        """Whether no logit can leave the range where its exponential is exact enough in 32 bits;
        hidden units lie between -1 and 1."""
        return all(np.abs(self.parts[k]).sum(-2).max() < MOST_LOGIT for k in ("group", "inner"))

    @staticmethod
    def _exps(logits: np.ndarray, bounded: bool) -> np.ndarray:
        """Exponentials in place of the logits, less the largest of a row where they may be large;
        their sums."""
        if not bounded:
            logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        return np.matmul(logits, _ONES)

    def run(self, targets: np.ndarray, contexts: np.ndarray, learn: bool) -> np.ndarray:
        """Log-probability of each target; with ``learn`` also one gradient step.

        Token ``t`` is the member ``t // GROUPS`` of group ``t % GROUPS``, so groups are even."""
        p, n = self.parts, len(targets)
        # Narrow integers are sorted by radix.
        order = np.argsort((targets % GROUPS).astype(np.uint8), kind="stable")
        targets, contexts = targets[order], np.take(contexts, order, axis=1)
        groups, inner = targets % GROUPS, targets // GROUPS
        h, rows = self._hidden(contexts), np.arange(n)
        by_group, by_inner = self._room("by_group", n, GROUPS), self._room("by_inner", n, GROUPS)
        bounded = self._bounded()
        group_sums = self._exps(np.matmul(h, p["group"], out=by_group), bounded)
        bounds = np.searchsorted(groups, np.arange(GROUPS + 1))
        spans = [(g, slice(a, b)) for g, (a, b) in enumerate(zip(bounds, bounds[1:])) if b > a]
        for g, s in spans:
            np.matmul(h[s], p["inner"][g], out=by_inner[s])
        inner_sums = self._exps(by_inner, bounded)
        logs = np.empty(n)
        logs[order] = np.log(by_group[rows, groups] / group_sums) + np.log(by_inner[rows, inner] / inner_sums)
        if learn:
            by_group *= (1 / group_sums)[:, None]
            by_inner *= (1 / inner_sums)[:, None]
            by_group[rows, groups] -= 1
            by_inner[rows, inner] -= 1
            units, steps = h[:, :-1], self.steps
            pull = np.matmul(by_group, p["group"][:-1].T, out=self._room("pull", n, HIDDEN))
            back = self._room("back", n, HIDDEN)
            steps["inner"][:] = 0
            for g, s in spans:
                np.matmul(h[s].T, by_inner[s], out=steps["inner"][g])
                np.matmul(by_inner[s], p["inner"][g, :-1].T, out=back[s])
            pull += back
            np.matmul(h.T, by_group, out=steps["group"])
            np.multiply(units, units, out=back)
            pull *= np.subtract(1, back, out=back)
            pull.sum(0, out=steps["bias"])
            # Each place adds the pull of a position to the row of its context in its table.
            steps["tables"][:] = 0
            cells, pulls = self._room("cells", n, HIDDEN, np.intp), pull.ravel()
            for place, own in enumerate(contexts):
                np.take(_CELLS, own, axis=0, out=cells, mode="clip")
                np.add.at(steps["tables"][place].reshape(-1), cells.ravel(), pulls)
            for name in p:
                self._step(name, n)
        return logs

    def _step(self, name: str, n: int) -> None:
        """Move weights by their summed gradients over ``n`` tokens; those without any stay."""
        step, squares = self.steps[name], self.squares[name]
        room = self._room(f"{name} step", len(step.ravel()), 1).reshape(step.shape)
        step *= 1 / n
        squares += np.multiply(step, step, out=room)
        step *= RATE
        self.parts[name] -= np.divide(step, np.sqrt(squares, out=room), out=room)


def windows_of(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Context tokens of every position of joined documents; edges are tokens of their own."""
    # Documents lie with edge tokens before, between and behind them.
    at = np.arange(len(ids)) + REACH * np.repeat(np.arange(1, len(lengths) + 1), lengths)
    padded = np.full(len(ids) + REACH * (len(lengths) + 1), _EDGE, np.int64)
    padded[at] = ids
    out = np.empty((len(_PLACES), len(ids)), np.int64)
    for row, o in enumerate(_PLACES):
        np.take(padded, at + o, out=out[row], mode="clip")
    return out


def word_hashes(words: pa.Array) -> np.ndarray:
    found = map(xxhash.xxh3_64_intdigest, words.to_numpy(zero_copy_only=False))
    return np.fromiter(found, np.uint64, len(words))


def _text_runs(batches: Iterator[pa.RecordBatch], column: int, run: int) -> Iterator[pa.RecordBatch]:
    """The rows in runs of about ``run`` bytes of text, also over the borders of batches; a row
    counts 16 bytes more than its text."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy() + np.int64(16))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = min(int(np.searchsorted(ends, before + run - size)) + 1, batch.num_rows)
            held.append(batch.slice(start, stop - start))
            size += ends[stop - 1] - before
            start = stop
            if size >= run:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def distinct_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, number of each word among them, words of each text); words are those of
    ``text_words``."""
    split = pc.ascii_split_whitespace(texts)
    lengths = pc.list_value_length(split).fill_null(0).to_numpy().astype(np.int64)
    coded = split.flatten().dictionary_encode()
    words, codes = coded.dictionary.cast(pa.binary()), coded.indices.to_numpy()
    blank = words.index(b"").as_py()
    if blank >= 0:  # beside white space at either end, and in empty texts
        kept = codes != blank
        lengths = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[kept], minlength=len(lengths))
        codes = codes[kept]
        codes -= codes > blank
        words = words.filter(pc.not_equal(words, b""))
    return words, codes, lengths


def word_counts(df: DataFrame, text_col: str) -> DataFrame:
    """(word, hash, bucket, n) of every word of all documents, as a stored table.

    The tasks count and Spark sums by word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _text_runs(batches, 0, _COUNT_RUN):
            words, codes, _ = distinct_words(run.column(0))
            hashes = word_hashes(words)
            n = np.bincount(codes, minlength=len(words))
            yield pa.RecordBatch.from_arrays(
                [words, pa.array(hashes.view(np.int64)), pa.array((hashes % np.uint64(BUCKETS)).astype(np.int32)), pa.array(n, pa.int64())],
                names=["word", "hash", "bucket", "n"],
            )

    rows = df.select(text_col).mapInArrow(count, "word binary, hash long, bucket int, n long")
    return stored(rows.groupBy("word", "hash", "bucket").agg(F.sum("n").alias("n")))


class WordTable(NamedTuple):
    """The most frequent words, the class of each and its log share in the class; the tokens
    of every class."""

    words: list[bytes]
    classes: np.ndarray
    shares: np.ndarray
    totals: np.ndarray


def word_table(counts: DataFrame, size: int = TABLE_WORDS) -> WordTable:
    best = counts.orderBy(F.desc("n"), "word").limit(max(size, WORDS)).toArrow()
    n, bucket = best.column("n").to_numpy(), best.column("bucket").to_numpy()
    totals = np.zeros(VOCABULARY, np.int64)
    for row in counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        totals[WORDS + row["bucket"]] = row["n"]
    # The classes of one word each take their tokens out of the buckets.
    np.subtract.at(totals, WORDS + bucket[:WORDS], n[:WORDS])
    totals[: len(n[:WORDS])] = n[:WORDS]
    classes = WORDS + bucket.astype(np.int64)
    classes[:WORDS] = np.arange(len(n[:WORDS]))
    return WordTable(best.column("word").to_pylist(), classes, np.log(n / totals[classes]), totals)


def encoded(df: DataFrame, id_col: str, text_col: str, table: WordTable) -> DataFrame:
    """Per row: id, its token classes (two bytes each), the sum of the log shares of the words
    in the table, the hashes of the words beyond and a number of the row's own."""
    known = df.sparkSession.sparkContext.broadcast(table)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, classes, shares, _ = known.value
        words = pa.array(words, pa.binary())
        row = TaskContext.get().partitionId() << 40
        for run in _text_runs(batches, 1, _NUMBER_RUN):
            own, codes, lengths = distinct_words(run.column(1))
            places = pc.index_in(own, value_set=words)
            beyond = places.is_null().to_numpy(zero_copy_only=False)
            inside = places.drop_null().to_numpy()
            hashes = np.zeros(len(own), np.uint64)
            hashes[beyond] = word_hashes(own.filter(places.is_null()))
            ids = WORDS + (hashes % np.uint64(BUCKETS)).astype(np.int64)
            ids[~beyond] = classes[inside]
            logs = np.zeros(len(own))
            logs[~beyond] = shares[inside]
            texts, text_of = len(lengths), np.repeat(np.arange(len(lengths)), lengths)
            far = np.flatnonzero(beyond[codes])
            ends = np.cumsum([0, *(2 * lengths)]).astype(np.int32)
            far_ends = np.cumsum([0, *np.bincount(text_of[far], minlength=texts)]).astype(np.int32)
            tokens = ids.astype("<u2")[codes]
            yield pa.RecordBatch.from_arrays(
                [
                    run.column(0),
                    pa.Array.from_buffers(pa.binary(), texts, [None, pa.py_buffer(ends), pa.py_buffer(tokens)]),
                    pa.array(np.bincount(text_of, logs[codes], minlength=texts), pa.float64()),
                    pa.ListArray.from_arrays(pa.array(far_ends), pa.array(hashes[codes[far]].view(np.int64))),
                    pa.array(range(row, row + texts), pa.int64()),
                ],
                names=["id", "tokens", "share", "rare", "row"],
            )
            row += texts

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scan, f"id {kind}, tokens binary, share double, rare array<long>, row long")


def rare_shares(tokens: DataFrame, counts: DataFrame, table: WordTable) -> DataFrame:
    """(row, rare_share): sum of the log shares of the words beyond the table."""
    totals = F.lit(table.totals[WORDS:].tolist())
    logs = counts.select("hash", F.log(F.col("n") / F.get(totals, F.col("bucket"))).alias("log_share"))
    spoken = tokens.select("row", F.explode("rare").alias("hash"))
    return spoken.join(logs, "hash").groupBy("row").agg(F.sum("log_share").alias("rare_share"))


def _blocks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Runs of documents of about 16 batches of tokens: (rows, token ids, lengths)."""
    parts = [np.frombuffer(t, "<u2") for t in batch.column(column).to_pylist()]
    start, held = 0, 0
    for i, part in enumerate(parts):
        held += len(part)
        if held >= 16 * BATCH or i == len(parts) - 1:
            run = slice(start, i + 1)
            own = parts[run]
            yield run, np.concatenate(own).astype(np.int64), np.array([len(x) for x in own])
            start, held = i + 1, 0


def train(tokens: DataFrame, totals: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights after one pass over all documents, in ``rounds`` parts by hash of the id."""
    spark = tokens.sparkSession
    weights = Network().expect(totals).flat()
    for number in range(rounds):
        shared = spark.sparkContext.broadcast(weights)

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            net, seen = Network().load(shared.value), 0
            rng = np.random.default_rng(5)
            for batch in batches:
                for _, ids, lengths in _blocks(batch, 0):
                    contexts = windows_of(ids, lengths)
                    mixed_order = rng.permutation(len(ids))
                    for i in range(0, len(ids), BATCH):
                        rows = mixed_order[i : i + BATCH]
                        net.run(ids[rows], np.take(contexts, rows, axis=1), learn=True)
                    seen += len(ids)
            if seen:
                flat = net.flat() * np.float64(seen)
                pieces = [flat[i : i + _PIECE].tobytes() for i in range(0, len(flat), _PIECE)]
                task, n = TaskContext.get().partitionId(), len(pieces)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(n), pa.int32()), pa.array([task] * n, pa.int32()), pa.array(pieces, pa.binary()), pa.array([seen] * n, pa.int64())],
                    names=["piece", "task", "value", "n"],
                )

        def add(group: pd.DataFrame) -> pd.DataFrame:
            total = np.sum([np.frombuffer(v) for v in group["value"]], axis=0)
            return pd.DataFrame(
                {"piece": group["piece"].iloc[:1], "value": [total.tobytes()], "n": [group["n"].sum()]}
            )

        part = tokens.filter(F.pmod(F.xxhash64("id"), F.lit(rounds)) == number).select("tokens")
        own = part.mapInArrow(learn, "piece int, task int, value binary, n long")
        schema = "piece int, value binary, n long"
        some = own.groupBy("piece", F.floor(F.col("task") / 64).alias("t")).applyInPandas(add, schema)
        whole = some.groupBy("piece").applyInPandas(add, schema).orderBy("piece").collect()
        if whole:
            weights = np.concatenate([np.frombuffer(r["value"]) / r["n"] for r in whole]).astype(np.float32)
    return weights


def score_documents(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, table_words: int = TABLE_WORDS
) -> DataFrame:
    """Per row: id, n_tokens, log_prob (summed) and mean_log_prob."""
    counts = word_counts(df, text_col)
    words = word_table(counts, table_words)
    tokens = stored(encoded(df, id_col, text_col, words))
    weights = df.sparkSession.sparkContext.broadcast(train(tokens, words.totals, rounds))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network().load(weights.value)
        for batch in batches:
            sizes, sums = [], []
            for _, ids, lengths in _blocks(batch, 1):
                contexts = windows_of(ids, lengths)
                logs = [
                    net.run(ids[i : i + BATCH], contexts[:, i : i + BATCH], learn=False)
                    for i in range(0, len(ids), BATCH)
                ]
                ends = np.cumsum(np.concatenate([[0.0], *logs]))
                stops = np.cumsum(lengths)
                sizes.extend(lengths.tolist())
                sums.extend((ends[stops] - ends[stops - lengths]).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array(sizes, pa.int64()), pa.array(sums, pa.float64())],
                names=["id", "share", "row", "n_tokens", "class_log_prob"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    scored = tokens.select("id", "tokens", "share", "row").mapInArrow(
        score, f"id {kind}, share double, row long, n_tokens long, class_log_prob double"
    )
    whole = scored.join(rare_shares(tokens, counts, words), "row", "left").withColumn(
        "log_prob", F.col("class_log_prob") + F.col("share") + F.coalesce("rare_share", F.lit(0.0))
    )
    return whole.select(
        F.col("id").alias(id_col),
        "n_tokens",
        "log_prob",
        F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")).alias("mean_log_prob"),
    )


@query("op1_lm_scoring")
def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
