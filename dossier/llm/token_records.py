"""Token ids as framed binary records, with an offset index for reads in any order.

Format of a data file, little-endian throughout; record after record, nothing between:

    length   8 bytes    bytes of the payload
    check    4 bytes    masked CRC-32C of the length field
    payload             1 byte  width of an id, 2 or 4; plus 128 where the row has an id
                        8 bytes id of the row, 0 where it is null
                        ids     ``width`` bytes each
    check    4 bytes    masked CRC-32C of the payload

The frame is the published one of length-delimited record files, so their readers take these
files. ``index`` is a Parquet table beside them with a row per record: file, name, record,
id, offset and length. Only files that it names count: each attempt of a task writes to a
name of its own, so what a lost or repeated attempt leaves behind is never read.

Writing: tasks encode where they scan. A text is cut before every space that a printable
character follows, which is always the start of a pre-token, and the tokenizer library
encodes each distinct piece once while a worker remembers it. Ids then go to the file whose
range of row ids holds theirs; ranges come from a sample of at most ``SAMPLE`` ids a file and
only balance the files. Rows that share an id are spread over its files by the hash of their
text, and every file is sorted, so the files in order hold the rows in order.

Reading: index rows are dealt out by file and block, or by a hash for a shuffled read, and
tasks read byte ranges, joined where they touch. Both checks of every record are verified.

Cases: null text counts as empty and yields the end id alone; null ids come first; rows that
share an id are ordered by the hash of their text; a text of any length is one record, held
in one task; a special string inside a text is one token, as by the library's default; an
empty table writes no data file and reads as no rows; other columns are not written.
"""

from __future__ import annotations

import re
import uuid
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.llm.registry import query, table
from dossier.session import new_path, stored

#: Files of one data set at most, which bounds the table of their ranges.
MAX_FILES = 10_000
#: Sampled ids for each file.
SAMPLE = 60
#: Bytes of a file that a task reads at a time, and bytes that one task reads in all.
READ_BYTES = 8 << 20
TASK_BYTES = 64 << 20
#: Pieces that a worker remembers, and the longest of them.
REMEMBERED = 1_200_000
REMEMBERED_LENGTH = 64
#: Runs of signs that a worker remembers.
TAILS = 10_000

#: Fixed values of the format: the reflected Castagnoli polynomial and the mask's constant.
_POLYNOMIAL = 0x82F63B78
_MASK = 0xA282EAD8

_HEAD = np.dtype([("kind", "u1"), ("id", "<i8")])
#: The characters that may follow a cut are printable and no white space in any library.
_CUT = re.compile(" (?=[!-~¡-ᙿ])")
#: A space that is no cut; most texts have none.
_ODD = re.compile(" (?![!-~¡-ᙿ])")
#: ASCII signs at the end of a piece, without the quote, which may begin a contraction.
_TAIL = re.compile(r"[!-&(-/:-@\[-`{-~]*\Z")


def _letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies name a byte; printable ones name themselves."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + i) for i, b in enumerate(hidden)}


_LETTERS = _letters()


def _tables() -> np.ndarray:
    """What a checksum becomes after four zero bytes, by its low and by its high half."""
    state = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        state = np.where(state & 1, (state >> 1) ^ np.uint32(_POLYNOMIAL), state >> 1)
    half = np.arange(1 << 16, dtype=np.uint32)
    both = np.stack([half, half << 16])
    for _ in range(4):
        both = (both >> 8) ^ state[both & 255]
    return both


class Checksums:
    """Masked CRC-32C of many byte strings at once.

    A checksum is linear, so that of two neighbouring blocks is the first one's, carried over
    the length of the second, xor the second's. Blocks of all strings are joined pair by pair;
    a zero block in front of a string changes nothing.
    """

    def __init__(self) -> None:
        self.over = [_tables()]  # carried over 4, 8, 16 ... bytes

    def _carried(self, level: int, state: np.ndarray) -> np.ndarray:
        while len(self.over) <= level:
            last = self.over[-1]
            self.over.append(last[0][last & 0xFFFF] ^ last[1][last >> 16])
        low, high = self.over[level]
        return low[state & 0xFFFF] ^ high[state >> 16]

    def of(self, parts: list[bytes]) -> np.ndarray:
        """Each part must have four bytes or more."""
        if not parts:
            return np.zeros(0, np.uint32)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        pad = -sizes % 4
        raw = b"".join(b"\0" * p + part for p, part in zip(pad.tolist(), parts))
        ends = np.cumsum(sizes + pad)
        data = np.frombuffer(raw, np.uint8).copy()
        data[((ends - sizes)[:, None] + np.arange(4)).ravel()] ^= 255
        state = self._carried(0, data.view("<u4").astype(np.uint32))
        count, level = (sizes + pad) // 4, 0
        while (count > 1).any():
            odd = count & 1
            even = np.zeros(int((count + odd).sum()), np.uint32)
            starts = np.cumsum(count + odd) - count
            even[np.arange(len(state)) + np.repeat(starts - (np.cumsum(count) - count), count)] = state
            state = self._carried(level, even[0::2]) ^ even[1::2]
            count, level = (count + odd) // 2, level + 1
        state = ~state
        return ((state >> 15) | (state << 17)) + np.uint32(_MASK)


class Pieces(dict):
    """Id bytes of a piece that follows a space; a full memory keeps what it has."""

    def __init__(self, tokenizer, kind: str) -> None:
        super().__init__()
        self.tokenizer, self.kind, self.tails = tokenizer, kind, {}
        self.code = {"<u2": "H", "<u4": "I"}[kind]
        self.tokenize = tokenizer.model.tokenize

    def ids(self, text: str) -> bytes:
        (found,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return array(self.code, found.ids).tobytes()

    def __missing__(self, piece: str) -> bytes:
        value = self._letters("\u0120", piece)
        if value is None:
            # A line feed between a word and a letter is a pre-token, and a line begins another.
            head, _, line = piece.partition("\n")
            word = head[: len(head) - len(_TAIL.search(head)[0])]
            rest = self._letters("", line) if word.isalpha() else None
            value = self.ids(" " + piece) if rest is None else self[head] + self._tail("\n") + rest
        if len(self) < REMEMBERED and len(piece) <= REMEMBERED_LENGTH:  # the first met are the frequent ones
            self[piece] = value
        return value

    def _letters(self, before: str, piece: str) -> bytes | None:
        """Id bytes of letters and the signs behind them; nothing for any other piece. Letters are
        one pre-token, which the library's model takes as it is, and the signs are the next."""
        tail = _TAIL.search(piece)[0]
        word = piece[: len(piece) - len(tail)]
        if not word.isalpha() or len(word) > REMEMBERED_LENGTH:
            return None
        if tail and before and word in self:
            return self[word] + self._tail(tail)
        name = word if word.isascii() else word.encode().decode("latin-1").translate(_LETTERS)
        value = array(self.code, [t.id for t in self.tokenize(before + name)]).tobytes()
        return value + self._tail(tail) if tail else value

    def _tail(self, tail: str) -> bytes:
        if tail not in self.tails:
            value = self.ids(tail)
            if len(self.tails) >= TAILS or len(tail) > REMEMBERED_LENGTH:
                return value
            self.tails[tail] = value
        return self.tails[tail]

    def coded(self, texts: list[str | None], end: bytes) -> list[bytes]:
        """Id bytes of each text, ``end`` behind them."""
        cut = [_pieces_of(t) if t else [""] for t in texts]
        first = [words.pop(0) for words in cut]
        begun = self.tokenizer.encode_batch_fast(first, add_special_tokens=False)
        get = self.__getitem__
        return [
            b"".join((array(self.code, code.ids).tobytes(), *map(get, words), end))
            for code, words in zip(begun, cut)
        ]


def _pieces_of(text: str) -> list[str]:
    return _CUT.split(text) if _ODD.search(text) else text.split(" ")


#: Memory of this worker, by vocabulary; it lives as long as the worker.
_REMEMBERED: dict[int, Pieces] = {}


def _pieces(model: str, kind: str) -> Pieces:
    key = xxhash.xxh3_64_intdigest(model)
    if key not in _REMEMBERED:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(model)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _REMEMBERED.clear()
        _REMEMBERED[key] = Pieces(tokenizer, kind)
    return _REMEMBERED[key]


def _place(value: int | None) -> tuple:
    return () if value is None else (value,)


def file_bounds(df: DataFrame, id_col: str, files: int) -> list[tuple]:
    """Ids that divide the rows into ``files`` ranges of like size, from a bounded sample."""
    rows = df.count()
    ids = df.select(id_col)
    if rows > files * SAMPLE:
        ids = ids.sample(files * SAMPLE / rows, seed=7)
    seen = sorted(_place(r[0]) for r in ids.collect())
    return [seen[len(seen) * i // files] for i in range(1, files)] if seen else []


def encode_ids(
    df: DataFrame, path: str, end_id: int, bounds: list[tuple], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: file, id, hash of the text, and the bytes of its ids, ``end_id`` last."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    from tokenizers import Tokenizer

    kind = "<u2" if Tokenizer.from_str(text).get_vocab_size(True) <= 1 << 16 and end_id < 1 << 16 else "<u4"
    context = df.sparkSession.sparkContext
    model, ranges = context.broadcast(text), context.broadcast(bounds)
    end = np.array([end_id], kind).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, known = _pieces(model.value, kind), ranges.value
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = batch.column(1).to_pylist()
                hashes = [xxhash.xxh3_64_intdigest((t or "").encode("utf-8", "surrogatepass")) for t in texts]
                files = []
                for value, h in zip(batch.column(0).to_pylist(), hashes):
                    low, high = bisect_left(known, _place(value)), bisect_right(known, _place(value))
                    files.append(low + (h * (high - low + 1) >> 64))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(files, pa.int32()),
                        batch.column(0),
                        pa.array([h - (1 << 63) for h in hashes], pa.int64()),
                        pa.array(pieces.coded(texts, end), pa.binary()),
                    ],
                    names=["file", "id", "hash", "ids"],
                )

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "file int, id long, hash long, ids binary").withColumn(
        "width", F.lit(int(kind[2:])).cast("byte")
    )


_INDEX = pa.schema(
    [("file", pa.int32()), ("name", pa.string()), ("record", pa.int64()), ("id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())]
)
_INDEX_SQL = "file int, name string, record long, id long, offset long, length long"


def _framed(ids: list[int | None], payloads: list[bytes], width: int, sums: Checksums) -> list[bytes]:
    heads = np.zeros(len(ids), _HEAD)
    heads["kind"] = [width + 128 * (i is not None) for i in ids]
    heads["id"] = [i or 0 for i in ids]
    bodies = [h.tobytes() + p for h, p in zip(heads, payloads)]
    lengths = [len(b).to_bytes(8, "little") for b in bodies]
    checks = (s.astype("<u4").tobytes() for s in (sums.of(lengths), sums.of(bodies)))
    a, b = checks
    return [
        b"".join((n, a[4 * i : 4 * i + 4], body, b[4 * i : 4 * i + 4]))
        for i, (n, body) in enumerate(zip(lengths, bodies))
    ]


def _writer(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pa.fs.FileSystem.from_uri(path)
        system.create_dir(f"{root}/data", recursive=True)
        sums, current, out = Checksums(), None, None
        try:
            for whole in batches:
                for at in range(0, whole.num_rows, 500):
                    file, ids, payloads, width = (c.to_pylist() for c in whole.slice(at, 500).columns)
                    edges = [i for i in range(len(file)) if i == 0 or file[i] != file[i - 1]] + [len(file)]
                    for a, b in zip(edges, edges[1:]):
                        if file[a] != current:
                            if out:
                                out.close()
                            current, record, offset = file[a], 0, 0
                            name = f"part-{current:05d}-{uuid.uuid4().hex}.rec"
                            out = system.open_output_stream(f"{root}/data/{name}")
                        frames = _framed(ids[a:b], payloads[a:b], width[a], sums)
                        out.write(b"".join(frames))
                        sizes = np.fromiter(map(len, frames), np.int64, b - a)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(file[a:b], pa.int32()),
                                pa.array([name] * (b - a)),
                                pa.array(record + np.arange(b - a)),
                                pa.array(ids[a:b], pa.int64()),
                                pa.array(offset + np.cumsum(sizes) - sizes),
                                pa.array(sizes),
                            ],
                            schema=_INDEX,
                        )
                        record, offset = record + b - a, offset + int(sizes.sum())
        finally:
            if out:
                out.close()

    return run


def write_records(
    df: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    files: int | None = None,
) -> None:
    """Write the ids of ``df`` below ``path``, in files of ascending ``id_col``.

    ``files``: how many; the session's number of shuffle partitions unless given.
    """
    spark = df.sparkSession
    files = min(MAX_FILES, files or int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = encode_ids(df, tokenizer, end_id, file_bounds(df, id_col, files), id_col, text_col)
    dealt = rows.repartitionById(files, F.col("file")).sortWithinPartitions(
        "file", F.col("id").asc_nulls_first(), "hash"
    )
    dealt.select("file", "id", "ids", "width").mapInArrow(_writer(path), _INDEX_SQL).write.parquet(f"{path}/index")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Where each record lies."""
    return spark.read.schema(_INDEX_SQL).parquet(f"{path}/index")


def _spans(names: list[str], offsets: list[int], lengths: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of records that touch in one file, of ``READ_BYTES`` or a single record."""
    a, n = 0, len(names)
    while a < n:
        b, size = a + 1, lengths[a]
        while b < n and names[b] == names[a] and offsets[b] == offsets[a] + size and size + lengths[b] <= READ_BYTES:
            size += lengths[b]
            b += 1
        yield a, b
        a = b


def _reader(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pa.fs.FileSystem.from_uri(path)
        sums, source, opened = Checksums(), None, None
        for batch in batches:
            file, name, record, offset, length = (c.to_pylist() for c in batch.columns)
            for a, b in _spans(name, offset, length):
                if name[a] != opened:
                    if source:
                        source.close()
                    opened, source = name[a], system.open_input_file(f"{root}/data/{name[a]}")
                size = sum(length[a:b])
                data = source.read_at(size, offset[a])
                if len(data) < size:
                    raise ValueError(f"{opened} ends before {offset[a] + size}")
                ids, tokens, heads, bodies, checks = [], [], [], [], []
                at = 0
                for n in length[a:b]:
                    frame, at = data[at : at + n], at + n
                    heads.append(frame[:8])
                    bodies.append(frame[12:-4])
                    checks.append(frame[8:12] + frame[-4:])
                    if int.from_bytes(frame[:8], "little") != n - 16:
                        raise ValueError(f"a length in {opened} differs from the index")
                found = np.frombuffer(b"".join(checks), "<u4").reshape(-1, 2)
                if not ((found[:, 0] == sums.of(heads)).all() and (found[:, 1] == sums.of(bodies)).all()):
                    raise ValueError(f"a checksum in {opened} is wrong")
                for body in bodies:
                    head = np.frombuffer(body, _HEAD, 1)[0]
                    ids.append(int(head["id"]) if head["kind"] & 128 else None)
                    values = np.frombuffer(body, f"<u{head['kind'] & 127}", offset=_HEAD.itemsize)
                    tokens.append(values.astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(file[a:b], pa.int32()), pa.array(record[a:b], pa.int64()), pa.array(ids, pa.int64()), pa.array(tokens, pa.binary())],
                    names=["file", "record", "id", "ids"],
                )
        if source:
            source.close()

    return run


def read_records(spark: SparkSession, path: str, seed: int | None = None) -> DataFrame:
    """Records as (file, record, id, ids), ids as little-endian unsigned 32-bit integers.

    Without ``seed`` tasks read stretches of files in order; with it, records come in an
    order that the seed decides, found through the index.
    """
    index = read_index(spark, path)
    # The index is small where the files are not, so its bytes cannot say how many tasks to use.
    tasks = 1 + (index.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES
    if seed is None:
        block = F.floor(F.col("offset") / READ_BYTES)
        dealt = index.repartition(tasks, "file", block).sortWithinPartitions("file", "offset")
    else:
        mixed: Column = F.xxhash64(F.lit(seed), "file", "record")
        dealt = index.repartition(tasks, mixed).sortWithinPartitions(mixed)
    places = dealt.select("file", "name", "record", "offset", "length")
    return places.mapInArrow(_reader(path), "file int, record long, id long, ids binary")


def record_digests(records: DataFrame) -> DataFrame:
    """Per record: id, start (ids of all records before it), n_tokens and CRC-32 of the ids."""
    rows = stored(
        records.select(
            "file",
            "record",
            "id",
            (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
            F.crc32("ids").alias("ids_crc32"),
        )
    )
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"))  # at most MAX_FILES rows
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        F.col("file").alias("of"), F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base")
    )
    within = Window.partitionBy("file").orderBy("record").rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.withColumn("inner", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return inner.join(F.broadcast(bases), F.col("file") == F.col("of")).select(
        "id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32"
    )


@query("op13_token_records")
def op13_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark)
    write_records(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return record_digests(read_records(spark, path)).withColumnRenamed("id", "doc_id")
