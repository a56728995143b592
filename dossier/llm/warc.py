"""WARC archives: a record per page, and a reader that follows the chain of records.

Writing: a page whose payload was already archived becomes a revisit of the record with the
smallest page id. Rows that a bit array shows to be without an equal are written where they
are; only the others are shuffled. The text sink writes the record bytes, so archives go
wherever Spark can write.

Reading: files are read in splits, cut at every occurrence of the version line, the magic.
Each occurrence is only a candidate: a payload may contain the magic or a whole record. A
task parses the header of every candidate and gives its offset, the offset where its successor
must start, and the offset at which its chain leaves the split. Offsets are relative to the
split until the byte counts of the splits before it are known. Pointer jumping over these
exits, from the start of each file, finds the one candidate at which the true chain enters each
split. A second scan follows the chain from there: only its records are read and their payloads
hashed, one at a time, so time is linear in the bytes however many headers a payload holds. A
record that goes on in a later split is put together from its parts.

Cases: null html is an empty payload, null url an empty one; line ends are taken out of
urls; of equal payloads of ``min_bytes`` or more, the smallest page id (null before all) is
the response, in each row that repeats it, and the others are revisits; an empty table gives
an empty archive and no rows. ``digest_ok`` is null for revisits.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.llm.exact_dedup import possibly_repeated, repeated_slots
from dossier.llm.registry import query, table
from dossier.session import new_path, stored

MAGIC = "WARC/1.0\r\n"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_URN = "urn:page:"
#: Fixed value of the format: the profile of a revisit by payload digest.
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def sha1_base32(value: Column) -> Column:
    """Bare upper-case base32 SHA-1: 5 hex digits make 4 letters."""
    digest = F.sha1(value)
    quads = [
        F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)
    ]
    return F.translate(F.concat(*quads), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _BASE32)


def with_record_types(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages as (page_id, url, payload, digest, revisit, refers_to)."""
    rows = pages.select(
        "page_id",
        F.translate(F.coalesce("url", F.lit("")), "\r\n", "").alias("url"),
        F.coalesce("html", F.lit("")).alias("payload"),
    )
    key = F.xxhash64("payload")
    array, bits = repeated_slots(rows, key)
    again = possibly_repeated(key, array, bits) & (F.octet_length("payload") >= min_bytes)
    rows = rows.withColumn("digest", sha1_base32(F.col("payload")))
    none = F.lit(None).cast(rows.schema["page_id"].dataType)
    alone = rows.filter(~again).select("*", F.lit(False).alias("revisit"), none.alias("refers_to"))
    copies = rows.filter(again)
    first = copies.groupBy("digest").agg(F.min(F.struct("page_id")).getField("page_id").alias("first"))
    later = ~F.col("page_id").eqNullSafe(F.col("first"))
    decided = copies.join(first, "digest").select(
        *rows.columns, later.alias("revisit"), F.when(later, F.col("first")).alias("refers_to")
    )
    return alone.unionByName(decided)


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", min_bytes: int = 0) -> None:
    """One archive per task below ``path``, readable as WARC 1.0 when concatenated or not."""
    rows = with_record_types(pages, min_bytes)
    name, target = (F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("page_id", "refers_to"))
    revisit = F.col("revisit")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length("payload").cast("string"),
        F.lit("\r\n\r\n"),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    record = F.concat(
        F.lit(MAGIC + "WARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"\r\nWARC-Record-ID: <{_URN}"),
        name,
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.when(
            revisit,
            F.concat(
                F.lit(f"\r\nWARC-Refers-To: <{_URN}"),
                target,
                F.lit(f">\r\nWARC-Profile: {_PROFILE}"),
            ),
        ).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length("block").cast("string"),
        F.lit("\r\n\r\n"),
        F.col("block"),
        F.lit("\r\n\r"),  # the sink's line end completes it
    )
    rows.withColumn("block", block).select(record.alias("value")).write.text(path, lineSep="\n")


_SPLITS = "file string, block long, total long, rel long, next long, leaves long"
_FIELDS = ("type", "record_id", "uri", "digest", "refers_to", "payload_bytes", "digest_ok")
_FOUND = (
    "file string, offset long, next long, type string, record_id string, uri string, digest string,"
    " refers_to string, payload_bytes long, digest_ok boolean"
)
_COLLECTED = f"{_FOUND}, start long, part binary"


def _header(segment: bytes) -> tuple[dict[str, str], int] | None:
    """Fields of a record header at the start of ``segment`` and its length."""
    end = segment.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in segment[:end].decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    if "warc-type" not in fields or not fields.get("content-length", "").isdecimal():
        return None
    return fields, end + 4


def _exits(rel: list[int], following: list[int]) -> list[int]:
    """Where the chain from each candidate leaves the split (successors lie behind)."""
    out: dict[int, int] = {}
    for start, step in zip(reversed(rel), reversed(following)):
        out[start] = out.get(step, step)
    return [out[r] for r in rel]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of each split by their headers alone; its segments come in file order."""
    names = ["file", "block", "total", "rel", "next", "leaves"]
    types = [pa.string(), *[pa.int64()] * 5]
    key, at, rel, following = None, 0, [], []

    def close() -> pa.RecordBatch:
        # A split without a candidate still counts its bytes.
        rows = list(zip(rel, following, _exits(rel, following))) or [(None, None, None)]
        columns = zip(*[(*key, at, *r) for r in rows])
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)

    for batch in batches:
        for file, block, segment in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, block) != key:
                if key is not None:
                    yield close()
                key, at, rel, following = (file, block), 0, [], []
            first = block == 0 and at == 0  # what stands before the first magic
            parsed = None if first else _header(segment)
            if parsed:
                fields, head = parsed
                rel.append(at - len(MAGIC))
                following.append(at + head + int(fields["content-length"]) + 4)
            at += len(segment) + len(MAGIC)
    if key is not None:
        yield close()


def _record(file: str, offset: int, fields: dict[str, str], block: bytes) -> tuple:
    """Values of a record: length and digest of its payload from the bytes of ``block``; a
    revisit has no payload, so its headers say what that of the full record was."""
    said = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    cut = block.find(b"\r\n\r\n")
    http, payload = (block[:cut], block[cut + 4 :]) if cut >= 0 else (b"", block)
    own = (fields.get(k, "").strip("<>") for k in ("warc-record-id", "warc-target-uri"))
    refers = fields.get("warc-refers-to", "").strip("<>")
    if fields["warc-type"] == "revisit":
        length = re.search(rb"(?i)content-length:\s*(\d+)", http)
        values = (said, refers, int(length[1]) if length else None, None)
    else:
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        values = (found, refers, len(payload), found == said if said else None)
    return (file, offset, None, fields["warc-type"], *own, *values)


class _Open:
    """A record of the chain, as far as its bytes have come."""

    def __init__(self, file: str, offset: int, fields: dict[str, str], head: int) -> None:
        self.file, self.offset, self.fields = file, offset, fields
        self.length = int(fields["content-length"])
        self.next = offset + len(MAGIC) + head + self.length + 4
        self.chunks: list[bytes] = []
        self.left = self.length

    def feed(self, data: bytes) -> None:
        if self.left:
            self.chunks.append(data[: self.left])
            self.left -= len(self.chunks[-1])

    def row(self) -> tuple:
        """The record, or its first part where it goes on in a later split."""
        block = b"".join(self.chunks)
        if not self.left:
            values = _record(self.file, self.offset, self.fields, block)
            return (*values[:2], self.next, *values[3:], None, None)
        header = "\r\n".join(f"{k}: {v}" for k, v in self.fields.items()).encode()
        return (self.file, self.offset, self.next, *[None] * 7, self.offset, header + b"\r\n\r\n" + block)


def _rows(rows: list[tuple], columns: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    named = [c.split() for c in columns.split(", ")]
    arrays = [pa.array(list(c), kinds[k]) for c, (_, k) in zip(zip(*rows), named)]
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in named])


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of the chain of each split, from where it enters.

    Bytes before that belong to a record of an earlier split, which ends at ``until``.
    """
    key, done, record, at, tail = None, [], None, 0, []

    def close(until: int | None) -> list[tuple]:
        rows = [*done]
        if record is not None:
            rows.append(record.row())
        if tail:
            rows.append((key[0], None, until, *[None] * 7, tail[0][0], b"".join(d for _, d in tail)))
        return rows

    last_until = None
    for batch in batches:
        for file, block, base, entry, until, segment in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, block) != key:
                if key is not None and (rows := close(last_until)):
                    yield _rows(rows, _COLLECTED)
                key, done, record, at, tail, last_until = (file, block), [], None, 0, [], until
            first = block == 0 and at == 0
            data = segment if first else MAGIC.encode() + segment
            start = base + at - (0 if first else len(MAGIC))
            if start == (entry if record is None else record.next) and (parsed := _header(segment)) and not first:
                if record is not None:
                    done.append(record.row())
                record = _Open(file, start, *parsed)
                record.feed(segment[parsed[1] :])
            elif record is not None:
                record.feed(data)
            elif until is not None and start < until:
                tail.append((start, data))
            at += len(segment) + len(MAGIC)
            if len(done) >= 1000:
                yield _rows(done, _COLLECTED)
                done = []
    if key is not None and (rows := close(last_until)):
        yield _rows(rows, _COLLECTED)


def _joined_parts(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
    """A record from its parts in several splits."""
    columns = [c.split()[0] for c in _FOUND.split(", ")]
    parts = parts.sort_values("start")
    whole = b"".join(parts["part"])
    parsed = _header(whole)
    if parts["offset"].isna().iloc[0] or parsed is None:
        return pd.DataFrame(columns=columns)
    fields, head = parsed
    block = whole[head : head + int(fields["content-length"])]
    values = list(_record(key[0], int(parts["offset"].iloc[0]), fields, block))
    values[2] = key[1]
    return pd.DataFrame([values], columns=columns)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records reachable from the start of each file: file, offset, next and the values of
    the record. Length and digest of a response are those of the bytes read; ``digest_ok``
    says whether its header agrees. Those of a revisit are what its headers say."""
    segments = (
        spark.read.option("lineSep", MAGIC)
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.col("value").cast("binary").alias("segment"),
        )
    )
    found = stored(segments.mapInArrow(_scan, _SPLITS))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = found.groupBy("file", "block").agg(F.first("total").alias("total"))
    bases = stored(
        splits.select("file", "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    )
    placed = stored(
        found.filter("rel IS NOT NULL")
        .join(bases, ["file", "block"])
        .select(
            "file",
            "block",
            (F.col("base") + F.col("rel")).alias("offset"),
            (F.col("base") + F.col("leaves")).alias("leaves"),
        )
    )
    most = splits.groupBy("file").count().agg(F.max("count")).first()[0] or 1
    entries = _entries(placed, most)
    left = placed.select("file", F.col("offset").alias("entry"), "leaves")
    plan = bases.join(entries.join(left, ["file", "entry"]), ["file", "block"], "left").select(
        "file", "block", "base", "entry", F.last("leaves", ignorenulls=True).over(before).alias("until")
    )
    # Spark sends the plan, a row a split, to all tasks where it is small; else the segments of
    # a split meet in one task. Either way they are brought into the order of the file.
    ordered = (
        segments.withColumn("n", F.monotonically_increasing_id())
        .join(stored(plan), ["file", "block"])
        .sortWithinPartitions("file", "block", "n")
        .select("file", "block", "base", "entry", "until", "segment")
    )
    collected = stored(ordered.mapInArrow(_collect, _COLLECTED))
    whole = collected.filter("part IS NULL").drop("start", "part")
    parted = collected.filter("part IS NOT NULL").select("file", "offset", "next", "start", "part")
    return whole.unionByName(parted.groupBy("file", "next").applyInPandas(_joined_parts, _FOUND))


def _entries(placed: DataFrame, most_splits: int) -> DataFrame:
    """The reachable candidate that is first in each split, by pointer jumping: each round
    adds what one jump reaches and joins the jumps with themselves, doubling their length."""
    exits = placed.select("file", F.col("leaves").alias("offset"), F.lit(True).alias("met")).distinct()
    jumps = stored(
        placed.join(exits, ["file", "offset"], "left")
        .filter("met OR offset = 0")
        .select("file", "offset", F.col("leaves").alias("to"))
    )
    reached = placed.filter("offset = 0").select("file", "offset")
    for _ in range(math.ceil(math.log2(max(1, most_splits)))):
        ahead = reached.join(jumps, ["file", "offset"]).select("file", F.col("to").alias("offset"))
        reached = stored(reached.unionByName(ahead).distinct())
        onward = jumps.select("file", F.col("offset").alias("to"), F.col("to").alias("further"))
        jumps = stored(
            jumps.join(onward, ["file", "to"], "left").select(
                "file", "offset", F.coalesce("further", "to").alias("to")
            )
        )
    return placed.select("file", "block", "offset").join(reached, ["file", "offset"]).select(
        "file", "block", F.col("offset").alias("entry")
    )


@query(
    "op3_warc_roundtrip",
    f"""
SELECT page_id, strlen(t) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda j: substr('{_BASE32}', 1 + (((('0x' || substr(sha1(t),
           (5 * (j // 4) + 1)::BIGINT, 5))::INTEGER >> (15 - 5 * (j % 4))::INTEGER) & 31)), 1)), '') AS payload_digest,
       if(page_id = min(page_id) OVER g, 'response', 'revisit') AS record_type,
       if(page_id = min(page_id) OVER g, NULL, min(page_id) OVER g) AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS t FROM pages) WINDOW g AS (PARTITION BY t)""",
)
def op3_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark)
    write_archives(table(spark, sf_dir, "pages"), path)
    number = lambda c: F.expr(f"try_cast(replace({c}, '{_URN}', '') AS bigint)")
    return read_archives(spark, path).select(
        number("record_id").alias("page_id"),
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        number("refers_to").alias("refers_to"),
    )
