"""BPE encoding by dynamic programming over prefixes, and decoding.

The encoding of a prefix of a word is a prefix-closed thing: dropping its last token leaves
the encoding of the shorter prefix. So each prefix has one last token, and it is found among
the tokens that end there (an automaton over the vocabulary reports them) by testing whether
the token is compatible with the last token of what remains: the two, spelled out and merged
again, must come back as the same two. Back-pointers then give the ids.

A token that ends a word has an end mark; here the mark is a letter of its own at the end of
the word, which only such tokens contain.

Cases: null text counts as empty (no tokens, empty decoding); special strings inside a text
give their own ids; white space gives no token; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.registry import query, table
from dossier.llm.token_counts import LETTERS, WORKER_LENGTH, merged, vocabulary

#: The splitting pattern and the end mark of the vocabulary.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END_OF_WORD = "</w>"

#: Stands for the end of a word; no byte is spelled so.
_END = "\x00"
WORKER_WORDS = 400_000


class PrefixEncoder:
    """Ids of single words."""

    def __init__(self, vocab: dict) -> None:
        self.ranks = vocab["ranks"]
        self.names: dict[int, str] = {i: t for t, i in vocab["ids"].items()}
        self.ids = vocab["ids"]
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab["ids"].items():
            spelled = token.removesuffix(END_OF_WORD)
            if spelled:
                word = spelled + _END if spelled != token else token
                self.automaton.add_word(word, (i, len(word)))
        self.automaton.make_automaton()
        self._fits: dict[tuple[int, int], bool] = {}

    def _symbols(self, token: str) -> list[str]:
        spelled = token.removesuffix(END_OF_WORD)
        letters = list(spelled)
        if spelled != token:
            letters[-1] += END_OF_WORD
        return letters

    def fits(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left`` (-1: nothing) in an encoding."""
        known = self._fits.get((left, right))
        if known is None:
            names = [self.names[t] for t in (left, right) if t >= 0]
            again = merged(list(chain.from_iterable(map(self._symbols, names))), self.ranks)
            known = again == names
            if len(self._fits) >= 4 * WORKER_WORDS:
                self._fits.clear()
            self._fits[left, right] = known
        return known

    def encode(self, word: str) -> tuple[int, ...]:
        """``word``: as spelled in byte letters, without the end mark."""
        spelled = word + _END
        n = len(spelled)
        last, start = [-1] * (n + 1), [0] * (n + 1)
        for stop, (token, length) in self.automaton.iter(spelled):
            stop += 1
            if last[stop] < 0:
                begin = stop - length
                if (begin == 0 or last[begin] >= 0) and self.fits(last[begin], token):
                    last[stop], start[stop] = token, begin
        if last[n] < 0:
            raise ValueError(f"no encoding of {word!r}")
        ids = []
        while n:
            ids.append(last[n])
            n = start[n]
        return tuple(reversed(ids))


class WordIds(dict):
    """Ids of each word met by a worker; those of long words are found anew each time."""

    def __init__(self, encoder: PrefixEncoder) -> None:
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str) -> tuple[int, ...]:
        spelled = "".join(LETTERS[b] for b in word.encode("utf-8", "surrogatepass"))
        ids = self.encoder.encode(spelled)
        if len(word) <= WORKER_LENGTH:
            if len(self) >= WORKER_WORDS:
                self.clear()
            self[word] = ids
        return ids


class Codec:
    """Texts to ids and back."""

    def __init__(self, vocab: dict) -> None:
        self.words = WordIds(PrefixEncoder(vocab))
        self.special = vocab["special"]
        self.find = regex.compile(WORDS).findall
        cut = "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.split = regex.compile(f"({cut})").split if cut else lambda text: [text]
        self.names = {i: t for t, i in chain(vocab["ids"].items(), self.special.items())}

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for part in self.split(text):
            if part in self.special:
                ids.append(self.special[part])
            else:
                # Capital sigma is lower-cased by itself, without regard to its place.
                lower = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                ids.extend(chain.from_iterable(map(self.words.__getitem__, self.find(lower))))
        return ids

    def decode(self, ids: list[int]) -> str:
        """The vocabulary has no decoder, so tokens are shown as they are, spaces between."""
        return " ".join(map(self.names.__getitem__, ids))


def encode_texts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ids (array of int) and the text decoded from them."""
    return _coded(
        df,
        path,
        id_col,
        text_col,
        "ids array<int>, decoded string",
        lambda ids, text: (pa.array(ids, pa.list_(pa.int32())), pa.array(text, pa.string())),
        ("ids", "decoded"),
    )


def digest_codes(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens and the digests of ids and decoded text, taken in the task."""

    def digests(ids: list[list[int]], texts: list[str]):
        raw = [hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest() for i in ids]
        back = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts]
        return (
            pa.array(map(len, ids), pa.int64()),
            pa.array(raw, pa.string()),
            pa.array(back, pa.string()),
        )

    names = ("n_tokens", "ids_sha256", "decoded_sha256")
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _coded(df, path, id_col, text_col, schema, digests, names)


def _coded(df, path, id_col, text_col, schema, columns, names) -> DataFrame:
    vocab = df.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocab.value)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                ids = [codec.encode(t or "") for t in part.column(1).to_pylist()]
                texts = [codec.decode(i) for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *columns(ids, texts)], names=["id", *names]
                )

    kind = df.schema[id_col].dataType.simpleString()
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, f"id {kind}, {schema}").withColumnRenamed("id", id_col)


@query("op9_bpe_encode_decode")
def op9_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest_codes(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
