"""Similarity self-join on five-word shingles with the chosen-path method.

Texts with the same shingle set form one class; the join works on classes. A node of the
recursion holds classes that share a path of sampled tokens. It chooses a few of the shared
hash functions, the same ones for all its members, and a member goes on to one child per
chosen function, named by its token with the least value under that function. Two sets of
similarity ``J`` share a child with probability ``J`` per choice, so with ``BRANCHES``
choices a similar pair survives level after level, while dissimilar sets part. Small nodes are
compared by brute force. A large node whose members hardly part (most of them go to one
child) is a dense group; it is compared by brute force as well, in pairs of blocks of bounded
size, so no task holds all of it. The number of independent runs follows from the recall that
is asked for.

Comparison is exact: a block pair is a product of token incidence matrices. A pair that meets
in several nodes is counted in one of them only, the least that both sides belong to. Links
are not written out: each comparison gives, per class, its number of linked texts, and the
group it falls into within that node. Groups are then merged over nodes by alternating star
contractions.

Cases: null texts and texts without words have no shingles and are alone; a text of fewer
than five words has one shingle, the whole of it; words are lower-cased runs between ASCII
white space; rows that repeat are copies; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.registry import query, table
from dossier.llm.words import Powers, RangeHashes, WordHashes, mixed, text_words
from dossier.session import stored

SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.999
#: Hash functions, choices per node, members compared without splitting, deepest level.
FUNCTIONS = 24
BRANCHES = 2
SMALL_NODE = 64
DEPTH = 3
#: Tokens of one block of a large node (4 bytes each).
BLOCK_TOKENS = 1_000_000

_ODD = mixed(np.arange(1, FUNCTIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def runs_for(recall: float, similarity: float = SIMILARITY, branches: int = BRANCHES, depth: int = DEPTH) -> int:
    """Runs until a pair at the threshold is met with probability ``recall``."""
    meets = 1.0
    for _ in range(depth):
        meets = 1 - (1 - similarity * meets) ** branches
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - meets)))


def shingle_set(text: str | None, words: WordHashes, powers: Powers) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes."""
    own = text_words(text.lower() if text else text)
    if not own:
        return np.zeros(0, np.uint64)
    ranges = RangeHashes(words.of(own), powers)
    if len(own) < SHINGLE:
        return ranges.ranges(np.array([0]), np.array([len(own)]))
    return np.unique(ranges.windows(SHINGLE))


def _least_values(s: np.ndarray, columns: int = 65_536) -> list[int]:
    """Least value of a set under each function; long sets are taken in parts."""
    if not len(s):
        return []
    parts = [(_ODD[:, None] * s[i : i + columns]).min(1) for i in range(0, len(s), columns)]
    return (np.min(parts, axis=0) >> np.uint64(33)).tolist()


def shingle_sets(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, two halves of the set's digest, size, least values and tokens."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, powers = WordHashes(), Powers()
        for whole in batches:
            for batch in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                out: list[list] = [[], [], [], [], []]
                for text in batch.column(1).to_pylist():
                    s = shingle_set(text, words, powers)
                    digest = xxhash.xxh3_128_digest(s.tobytes())
                    out[0].append(int.from_bytes(digest[:8], "little", signed=True))
                    out[1].append(int.from_bytes(digest[8:], "little", signed=True))
                    out[2].append(len(s))
                    out[3].append(_least_values(s))
                    # 32 bits tell the tokens of two sets apart when they are compared.
                    out[4].append(np.unique((s >> np.uint64(32)).astype(np.uint32)).tobytes())
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.binary())
                arrays = [pa.array(v, t) for v, t in zip(out, kinds)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *arrays], names=["id", "a", "b", "n", "least", "tokens"]
                )

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(
        scan, "id long, a long, b long, n int, least array<int>, tokens binary"
    )


def _children(members: DataFrame, branches: int) -> DataFrame:
    """Members (cid, n, least, path) go on to ``branches`` children each, chosen by the path."""
    picks = F.transform(
        F.sequence(F.lit(1), F.lit(branches)),
        lambda i: (F.pmod(F.xxhash64("path"), F.lit(FUNCTIONS)) + i * 7) % FUNCTIONS,
    )
    child = F.explode(picks).alias("pick")
    rows = members.select("cid", "n", "least", F.col("path").alias("parent"), child)
    value = F.element_at("least", (F.col("pick") + 1).cast("int"))
    return rows.select("cid", "n", "least", "parent", F.xxhash64("parent", "pick", value).alias("path"))


def leaves_of(classes: DataFrame, runs: int, small: int = SMALL_NODE, depth: int = DEPTH) -> DataFrame:
    """(cid, path, blocks): the nodes that are compared, for each class.

    ``blocks``: how many parts the node's members are compared in."""
    root = classes.select("cid", "n", "least", F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run"))
    nodes = _children(root.select("cid", "n", "least", F.xxhash64("run").alias("path")), BRANCHES)
    nodes = stored(nodes.select("cid", "n", "least", "path"))
    done = []
    for level in range(1, depth + 1):
        sizes = nodes.groupBy("path").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight"))
        sizes = sizes.filter("size > 1")
        blocks = F.ceil(F.col("weight") / BLOCK_TOKENS).cast("int").alias("blocks")
        if level == depth:
            done.append(nodes.join(sizes.select("path", blocks), "path").select("cid", "path", "blocks"))
            break
        few = sizes.filter(F.col("size") <= small).select("path", blocks)
        done.append(nodes.join(few, "path").select("cid", "path", "blocks"))
        many = sizes.filter(F.col("size") > small)
        open_nodes = nodes.join(many.select("path"), "path", "left_semi")
        parted = stored(_children(open_nodes, BRANCHES))
        largest = parted.groupBy("parent", "path").count().groupBy("parent").agg(F.max("count").alias("most"))
        dense = many.join(largest, many["path"] == largest["parent"]).filter("2 * most > size")
        dense = stored(dense.select("path", blocks))
        done.append(open_nodes.join(dense, "path").select("cid", "path", "blocks"))
        rest = parted.join(dense.select(F.col("path").alias("parent")), "parent", "left_anti")
        nodes = stored(rest.select("cid", "n", "least", "path"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    # Distinct, as two choices of one node may name the same child.
    return out.distinct()


class _Incidence:
    """Rows by token: products of two give the sizes of the intersections."""

    def __init__(self, parts: list[np.ndarray]) -> None:
        self.lengths = np.array([len(p) for p in parts])
        flat = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        _, ids, count = np.unique(flat, return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(parts)), self.lengths)
        shared = count[ids] > 1  # a token of one row only is in no intersection
        self.row, self.token = row[shared], ids[shared]
        self.bounds = np.searchsorted(self.row, np.arange(len(parts) + 1))

    def product(self, a: slice, b: slice, columns: int = 8192) -> np.ndarray:
        left = slice(self.bounds[a.start], self.bounds[a.stop])
        right = slice(self.bounds[b.start], self.bounds[b.stop])
        known = np.unique(self.token[left])
        out = np.zeros((a.stop - a.start, b.stop - b.start), np.float32)
        spot_l = np.searchsorted(known, self.token[left])
        spot_r = np.searchsorted(known, self.token[right])
        there = spot_r < len(known)
        there[there] = known[spot_r[there]] == self.token[right][there]
        row_l, row_r = self.row[left] - a.start, self.row[right][there] - b.start
        spot_r = spot_r[there]
        for low in range(0, len(known), columns):
            width = min(columns, len(known) - low)
            m = np.zeros((out.shape[0], width), np.float32)
            k = (spot_l >= low) & (spot_l < low + width)
            m[row_l[k], spot_l[k] - low] = 1
            o = np.zeros((out.shape[1], width), np.float32)
            k = (spot_r >= low) & (spot_r < low + width)
            o[row_r[k], spot_r[k] - low] = 1
            out += m @ o.T
        return out


def _find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _unite(parent: np.ndarray, link: np.ndarray, a: slice, b: slice) -> None:
    """Merge the groups that a block of links connects; the least member names a group."""
    rows, cols = np.flatnonzero(link.any(1)), np.flatnonzero(link.any(0))
    link = link[np.ix_(rows, cols)]
    left = np.array([_find(parent, i) for i in rows + a.start])
    right = np.array([_find(parent, i) for i in cols + b.start])
    old_left, old_right, none = left.copy(), right.copy(), np.iinfo(np.int64).max
    while True:
        new_left = np.minimum(left, np.where(link, right, none).min(1))
        new_right = np.minimum(right, np.where(link, new_left[:, None], none).min(0))
        if (new_left == left).all() and (new_right == right).all():
            break
        left, right = new_left, new_right
    for old, new in {*zip(old_left.tolist(), left.tolist()), *zip(old_right.tolist(), right.tolist())}:
        x, y = _find(parent, old), _find(parent, new)
        parent[max(x, y)] = min(x, y)


def _compare_two(ids, block, members, tokens, nodes, path, crossing, similarity):
    """The comparison of two rows, by far the most frequent one."""
    a, b = map(len, tokens)
    links, names = np.zeros(2, np.int64), ids.copy()
    if min(a, b) < similarity * max(a, b) or crossing and block[0] == block[1]:
        return links, names
    common = len(np.intersect1d(*tokens, assume_unique=True))
    if common * (1 + similarity) >= similarity * (a + b) - 1e-3:
        names[:] = ids.min()
        shared = np.intersect1d(*nodes)
        if not (shared < path).any():
            links[:] = members[::-1]
    return links, names


def compare(
    ids: np.ndarray,
    block: np.ndarray,
    members: np.ndarray,
    tokens: list[np.ndarray],
    nodes: list[np.ndarray],
    path: int,
    crossing: bool,
    similarity: float,
    step: int = 256,
) -> tuple[np.ndarray, np.ndarray]:
    """Linked texts and least group member of each row, for the pairs of this comparison.

    ``crossing``: rows of one block are compared with those of the other, else all pairs."""
    if len(ids) == 2:
        return _compare_two(ids, block, members, tokens, nodes, path, crossing, similarity)
    order = np.argsort([len(t) for t in tokens], kind="stable")
    ids, block, members = ids[order], block[order], members[order]
    tokens, nodes = [tokens[i] for i in order], [nodes[i] for i in order]
    incidence = _Incidence(tokens)
    earlier = _Incidence([n[n < path] for n in nodes])
    size, n = incidence.lengths.astype(np.float32), len(ids)
    links, parent = np.zeros(n, np.int64), np.arange(n)
    for i in range(0, n, step):
        a = slice(i, min(n, i + step))
        for j in range(i, n, step):
            b = slice(j, min(n, j + step))
            if size[a].max() < similarity * size[b.start]:
                break  # rows are in order of size
            common = incidence.product(a, b)
            link = common * (1 + similarity) >= similarity * (size[a, None] + size[None, b]) - 1e-3
            if i == j:
                link &= np.triu(np.ones(link.shape, bool), 1)
            if crossing:
                link &= block[a, None] != block[None, b]
            if not link.any():
                continue
            _unite(parent, link, a, b)
            link &= earlier.product(a, b) == 0
            links[a] += link @ members[b]
            links[b] += members[a] @ link
    least = np.array([_find(parent, i) for i in range(n)])
    # Roots are positions; the group is named by its smallest class.
    names = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(names, least, ids)
    out_links, out_names = np.zeros(n, np.int64), np.zeros(n, np.int64)
    out_links[order], out_names[order] = links, names[least]
    return out_links, out_names


def _compared(rows: DataFrame, similarity: float) -> DataFrame:
    """Results of all comparisons; rows of one comparison follow each other in a task, so
    the many small ones cost no group of their own."""
    names = ("cid", "block", "members", "tokens", "paths", "path", "left", "right")

    def result(group: list[list]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = np.array(group[0])
        links, least = compare(
            ids,
            np.array(group[1]),
            np.array(group[2]),
            [np.frombuffer(t, np.uint32) for t in group[3]],
            [np.array(p, np.int64) for p in group[4]],
            group[5][0],
            group[6][0] != group[7][0],
            similarity,
        )
        found = (links > 0) | (least != ids)
        return ids[found], links[found], least[found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in names]

        def out(results: list) -> pa.RecordBatch:
            arrays = [pa.array(np.concatenate(c), pa.int64()) for c in zip(*results)]
            return pa.RecordBatch.from_arrays(arrays, names=["cid", "links", "least"])

        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in (5, 6, 7)])
            starts = [0, *(np.flatnonzero((np.diff(keys) != 0).any(0)) + 1).tolist(), batch.num_rows]
            columns, results = [c.to_pylist() for c in batch.columns], []
            for low, high in zip(starts, starts[1:]):
                if held[0] and tuple(h[-1] for h in held[5:]) != tuple(keys[:, low]):
                    results.append(result(held))
                    held = [[] for _ in names]
                for h, c in zip(held, columns):
                    h.extend(c[low:high])
            if results:
                yield out(results)
        if held[0]:
            yield out([result(held)])

    key = ("path", "left", "right")
    return (
        rows.select(*names)
        .repartition(*key)
        .sortWithinPartitions(*key)
        .mapInArrow(run, "cid long, links long, least long")
    )


def least_members(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (u, v): the smallest node connected to each.

    Alternating star contractions: every node hands its larger, then its smaller neighbours
    to the least one it knows, until nothing changes."""
    edges = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.filter("u <> v").distinct())
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u")
        moved = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small_least.select("u", F.col("m").alias("v"))
        )
        edges = stored(moved.filter("u <> v").distinct())
        sums = edges.agg(
            F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if sums == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = sums


def similar_documents(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = SIMILARITY,
    recall: float = RECALL,
) -> DataFrame:
    """Per row: id, class_id (the smallest id of the rows it is connected to by links) and
    n_links, the number of other rows with at least this similarity."""
    sets = stored(
        shingle_sets(df, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    )
    groups = sets.filter("n > 0").groupBy("a", "b").agg(
        F.min("row").alias("cid"), F.count(F.lit(1)).alias("members"), F.min("id").alias("first_id")
    )
    groups = stored(groups)
    heads = sets.join(groups.select(F.col("cid").alias("row"), "members"), "row")
    classes = heads.select(F.col("row").alias("cid"), "n", "least")
    leaves = stored(leaves_of(classes, runs_for(recall, similarity)))
    own = leaves.groupBy("cid").agg(F.collect_list("path").alias("paths"))
    held = heads.select(F.col("row").alias("cid"), "members", "tokens").join(own, "cid")
    rows = leaves.join(held, "cid").withColumn(
        "block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    )
    # Block i meets every block j; (i, i) compares within the block.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("cid", "path", "block", "members", "tokens", "paths", other)
    rows = rows.withColumns({"left": F.least("block", "other"), "right": F.greatest("block", "other")})
    found = stored(_compared(rows.drop("other"), similarity))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = least_members(found.filter("cid <> least").select(F.col("cid").alias("u"), F.col("least").alias("v")))
    named = (
        groups.join(roots.withColumnRenamed("node", "cid"), "cid", "left")
        .join(links, "cid", "left")
        .withColumn("root", F.coalesce("root", "cid"))
    )
    least_id = named.groupBy("root").agg(F.min("first_id").alias("class_id"))
    named = named.join(least_id, "root").select(
        "a", "b", "class_id", (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("n_links")
    )
    alone = sets.filter("n = 0").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    joined = sets.filter("n > 0").select("id", "a", "b").join(named, ["a", "b"])
    return joined.select("id", "class_id", "n_links").unionByName(alone).withColumnRenamed("id", id_col)


def one_of_each(df: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """The rows of ``df`` without those that are linked to a row with a smaller id."""
    found = similar_documents(df, similarity=similarity, recall=recall)
    gone = found.filter("doc_id <> class_id").select("doc_id").distinct()
    return df.join(gone, "doc_id", "left_anti").select(df.columns)


@query("op4_jaccard_join")
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))
