"""Prefix trie of rebuilt conversations from ternary search trees per range shard.

Distinct turns (role, text) get dictionary ids, so a conversation is a sequence of integers;
equal conversations are counted before anything else. Sequences are sorted and cut into shards
of neighbours. Each shard inserts its sequences into a ternary search tree, medians first,
which keeps the search among the children of a node balanced. Nodes come into being behind
their parents, so a walk from the last to the first passes members, leaves and savings up
without recursion.

A prefix that several shards hold is, as shards are ranges, a prefix of the first or the last
sequence of each. The nodes on these two paths, the boundary nodes, are not finished: their
own parts (all but what boundary children pass up) go on as paths of the next level, where
paths are sequences again and the same step merges equal nodes. Each level has two paths for a
shard; the last level is one shard. What a finished node calls its parent is then looked up
for those whose parent was a boundary node.

Cases: null roles and texts are empty; null turns come first, rows of equal turn are ordered
by role and hash of the text, and repeated rows are turns of their own; rows without conv_id
belong to no conversation and are left out; a conversation that loses all its turns is a member
of the root; an empty table gives no rows; other columns are ignored. The ids of one
conversation, 16 bytes a turn, must fit in a task.
"""

from __future__ import annotations

import functools
import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.llm.conversation_repair import CRC32_SQL, joined, placed_rows, row_chunk
from dossier.llm.registry import query, table
from dossier.session import stored

#: Turns of a shard, and the sequences it holds at least, whatever their length.
SHARD_TURNS = 400_000
SHARD_PATHS = 32
#: Ids of the members of a node that are joined to one string before the digest.
_ID_CHUNK = 4096

#: Conversations that share the opening of one, and the turns they may take from it.
FAMILY = 100
OPENINGS = 6


def placed_turns(conversations: DataFrame) -> DataFrame:
    """Turns as (conv_id, pos, said, chars), ``said`` a digest of role and text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    slim = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        role.alias("role"),
        F.xxhash64(text).alias("h"),
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("said"),
        F.char_length(text).cast("long").alias("chars"),
    )
    rows = placed_rows(slim, "h").withColumn("chunk", row_chunk(F.col("place")))
    sizes = rows.groupBy("conv_id", "chunk").agg(F.min("place").alias("least"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(
        "conv_id", "chunk", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("least")).alias("base")
    )
    return joined(rows, bases, "conv_id", "chunk", how="inner").select(
        "conv_id", (F.col("place") + F.col("base")).alias("pos"), "said", "chars"
    )


def with_turn_ids(turns: DataFrame) -> DataFrame:
    """Turns with the number of their digest in a dictionary of all digests."""
    dictionary = stored(turns.select("said").distinct().withColumn("id", F.monotonically_increasing_id()))
    return turns.join(dictionary, "said").drop("said")


def rebuilt_turns(turns: DataFrame) -> DataFrame:
    """Every conversation opens with the first h turns of the first of its family, then goes on
    with its own behind its first h. A row of nulls stands for the conversation itself."""
    h = (F.crc32(F.col("conv_id").cast("string")) % OPENINGS).cast("long")
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    own = turns.filter(F.col("pos") >= h)
    ids = turns.select("conv_id").distinct().select("conv_id", base.alias("base"), h.alias("h"))
    openings = turns.filter((base == F.col("conv_id")) & (F.col("pos") < OPENINGS - 1)).withColumnRenamed("conv_id", "base")
    taken = ids.join(openings, "base").filter("pos < h")
    none = [F.lit(None).cast("long").alias(c) for c in ("pos", "id", "chars")]
    parts = [own, taken, ids.select("conv_id", *none)]
    return functools.reduce(DataFrame.unionByName, [p.select("conv_id", "pos", "id", "chars") for p in parts])


def sequences(rebuilt: DataFrame) -> DataFrame:
    """One row per conversation: key of its sequence, ids and code points of its turns."""
    turn = F.when(F.col("id").isNotNull(), F.struct("pos", "id", "chars"))
    whole = rebuilt.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    ids = F.transform("turns", lambda t: t["id"])
    return whole.select(
        "conv_id",
        F.sha2(F.array_join(ids.cast("array<string>"), ","), 256).alias("key"),
        ids.alias("ids"),
        F.transform("turns", lambda t: t["chars"]).alias("chars"),
    )


def end_digests(convs: DataFrame) -> DataFrame:
    """Per sequence: its smallest conversation and the digest of the ids of all that equal it."""
    some = (
        convs.groupBy("key", F.floor(F.col("conv_id") / _ID_CHUNK).alias("part"))
        .agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
        .select("key", "part", F.col("ids")[0].alias("least"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("listed"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, least, digest = None, None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([least], pa.int64()), pa.array([digest.hexdigest()])], names=["end", "ends_sha256"])

        for batch in batches:
            for k, low, listed in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key:
                    if key is not None:
                        yield row()
                    key, least, digest = k, low, hashlib.sha256(listed.encode())
                else:
                    digest.update(b"," + listed.encode())
        if key is not None:
            yield row()

    dealt = some.repartition("key").sortWithinPartitions("key", "part")
    return dealt.select("key", "least", "listed").mapInArrow(run, "end long, ends_sha256 string")


def medians_first(n: int) -> Iterator[int]:
    """0 to n - 1, each range by its median before its halves."""
    spans = deque([(0, n)])
    while spans:
        a, b = spans.popleft()
        if a < b:
            middle = (a + b) // 2
            yield middle
            spans += ((a, middle), (middle + 1, b))


class Tree:
    """Ternary search tree over integer sequences; node 0 is the root, the empty prefix.

    ``less``, ``more``: the node's neighbours among its siblings; ``child``: the first of its
    children to be met. A node's number is larger than its parent's.
    """

    def __init__(self) -> None:
        self.key, self.less, self.more, self.child = [0], [0], [0], [0]
        self.parent, self.depth, self.chars = [-1], [0], [0]
        self.convs, self.low, self.end = [0], [None], [None]
        self.children, self.leaves, self.saved = [0], [0], [0]

    def _new(self, key: int, parent: int, chars: int) -> int:
        for column, value in (
            (self.key, key), (self.less, 0), (self.more, 0), (self.child, 0), (self.parent, parent),
            (self.depth, self.depth[parent] + 1), (self.chars, chars), (self.convs, 0), (self.low, None),
            (self.end, None), (self.children, 0), (self.leaves, 0), (self.saved, 0),
        ):
            column.append(value)
        return len(self.key) - 1

    def insert(self, ids: list[int], chars: list[int]) -> list[int]:
        """Nodes of the sequence, the root first."""
        path, node = [0], 0
        for key, size in zip(ids, chars):
            at = self.child[node]
            if not at:
                at = self.child[node] = self._new(key, node, size)
            while self.key[at] != key:
                side = self.less if key < self.key[at] else self.more
                if not side[at]:
                    side[at] = self._new(key, node, size)
                at = side[at]
            node = at
            path.append(node)
        return path

    def add(self, node: int, part: dict) -> None:
        """Members, leaves and savings that reach the node from outside the tree."""
        self.convs[node] += part["n"]
        self.low[node] = least(self.low[node], part["low"])
        self.end[node] = least(self.end[node], part["end"])
        self.children[node] += part["children"]
        self.leaves[node] += part["leaves"]
        self.saved[node] += part["saved"]

    def part(self, node: int) -> dict:
        return {
            "depth": self.depth[node], "n": self.convs[node], "low": self.low[node], "end": self.end[node],
            "children": self.children[node], "leaves": self.leaves[node], "saved": self.saved[node],
        }

    def accumulate(self, open_nodes: set[int]) -> None:
        """Pass sums up from the last node to the first; open nodes pass nothing on."""
        for node in range(len(self.key) - 1, -1, -1):
            if node in open_nodes:
                continue
            if not self.children[node]:
                self.leaves[node] += 1
            self.saved[node] += (self.convs[node] - 1) * self.chars[node]
            up = self.parent[node]
            if up >= 0:
                self.convs[up] += self.convs[node]
                self.low[up] = least(self.low[up], self.low[node])
                self.children[up] += 1
                self.leaves[up] += self.leaves[node]
                self.saved[up] += self.saved[node]


def least(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


_PART = "struct<depth:int,n:long,low:long,end:long,children:long,leaves:long,saved:long>"
_NODE = "conv_id long, depth int, parent_conv_id long, parent_rep long, n_convs long, n_children long, n_leaves long, saved_tokens long, end long"
_PATH = f"rep long, ids array<long>, chars array<long>, parts array<{_PART}>"
_ALIAS = "of long, at int, low long, next_rep long"
_OUT = f"kind string, {_NODE}, {_PATH}, {_ALIAS}"
_PART_ARROW = pa.struct([("depth", pa.int32())] + [(n, pa.int64()) for n in ("n", "low", "end", "children", "leaves", "saved")])
_LISTS = {"ids": pa.list_(pa.int64()), "chars": pa.list_(pa.int64()), "parts": pa.list_(_PART_ARROW)}


def _names(columns: str) -> list[str]:
    return [c.split()[0] for c in columns.replace(_PART, "part").split(", ")]


def _batch(kind: str, columns: str, rows: list[tuple]) -> pa.RecordBatch:
    """Rows of one kind; the columns of the other kinds are null."""
    given = dict(zip(_names(columns), zip(*rows)))
    arrays = [pa.array([kind] * len(rows))]
    for name in _names(_OUT)[1:]:
        type_ = _LISTS.get(name) or (pa.int32() if name in ("depth", "at") else pa.int64())
        arrays.append(pa.array(list(given[name]), type_) if name in given else pa.nulls(len(rows), type_))
    return pa.RecordBatch.from_arrays(arrays, names=_names(_OUT))


def shard_rows(paths: list[tuple], alone: bool) -> Iterator[pa.RecordBatch]:
    """What one shard gives; ``paths``: (rep, ids, chars, parts), sorted by ids.

    Finished nodes; unless the shard is ``alone``, the paths of its boundary nodes; and for
    every node that came in on a path, its smallest member or the path on which it goes on.
    """
    tree, met = Tree(), [None] * len(paths)
    for i in medians_first(len(paths)):
        rep, ids, chars, parts = paths[i]
        nodes = tree.insert(ids, chars)
        for part in parts:
            tree.add(nodes[part["depth"]], part)
        met[i] = [nodes[p["depth"]] for p in parts]
        if i == 0:
            first = nodes
        if i == len(paths) - 1:
            last = nodes
    carried: dict[int, int] = {}
    if not alone:
        carried = dict.fromkeys(last, paths[-1][0]) | dict.fromkeys(first, paths[0][0])
    tree.accumulate(set(carried))
    rows = []
    for node, up in enumerate(tree.parent):
        if node not in carried:
            over = (None, carried[up]) if up in carried else (tree.low[up] if up >= 0 else None, None)
            rows.append(
                (tree.low[node], tree.depth[node], *over, tree.convs[node], tree.children[node],
                 tree.leaves[node], tree.saved[node], tree.end[node])
            )
    for at in range(0, len(rows), 20_000):
        yield _batch("node", _NODE, rows[at : at + 20_000])
    aliases = [
        (paths[i][0], tree.depth[n], *((None, carried[n]) if n in carried else (tree.low[n], None)))
        for i, nodes in enumerate(met)
        for n in nodes
    ]
    if aliases:
        yield _batch("alias", _ALIAS, aliases)
    if not alone:
        ends = [(paths[0], first), (paths[-1], last)][: 1 + (len(paths) > 1)]
        yield _batch(
            "path",
            _PATH,
            [(rep, ids, chars, [tree.part(n) for n in nodes if carried[n] == rep]) for (rep, ids, chars, _), nodes in ends],
        )


def _shards(alone: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, turns = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                paths.append(row)
                turns += len(row[1])
                if not alone and turns >= SHARD_TURNS and len(paths) >= SHARD_PATHS:
                    yield from shard_rows(paths, False)
                    paths, turns = [], 0
        if paths:
            yield from shard_rows(paths, alone)

    return run


def _level(paths: DataFrame, partitions: int | None, alone: bool) -> DataFrame:
    if alone:
        dealt = paths.coalesce(1)
    else:
        dealt = paths.repartitionByRange(*([partitions] if partitions else []), F.col("ids"))
    return stored(dealt.sortWithinPartitions("ids").mapInArrow(_shards(alone), _OUT))


def trie_nodes(convs: DataFrame) -> DataFrame:
    """Nodes of the trie over ``convs`` (conv_id, key, ids, chars; see ``sequences``): conv_id,
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, and ``end``, the
    smallest conversation that ends there."""
    same = convs.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("long")
    part = F.struct(
        F.size("ids").alias("depth"), F.col("n"), F.col("conv_id").alias("low"), F.col("conv_id").alias("end"),
        zero.alias("children"), zero.alias("leaves"), zero.alias("saved"),
    )
    paths = same.drop("key").join(convs.drop("key"), "conv_id").select(
        F.col("conv_id").alias("rep"), "ids", "chars", F.array(part).alias("parts")
    )
    levels = [_level(paths, None, False)]
    known = None
    while True:
        paths = levels[-1].filter("kind = 'path'").select(*_names(_PATH))
        n, turns = paths.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()
        shards = min(-(-turns // SHARD_TURNS), -(-n // (2 * SHARD_PATHS)))
        alone = shards <= 1 or (known is not None and 2 * n > known)
        levels.append(_level(paths, shards, alone))
        if alone:
            break
        known = n
    # From the last level back: the smallest member of every node that a level passed on.
    low = None
    nodes = []
    for level in reversed(levels):
        found = level.filter("kind = 'node'").select(*_names(_NODE))
        alias = level.filter("kind = 'alias'").select(*_names(_ALIAS))
        if low is None:
            nodes.append(found.drop("parent_rep"))
            low = alias.select("of", "at", "low")
            continue
        open_ones = found.filter("parent_rep IS NOT NULL").drop("parent_conv_id")
        named = open_ones.join(
            low, (open_ones["parent_rep"] == low["of"]) & (open_ones["depth"] - 1 == low["at"])
        ).withColumn("parent_conv_id", F.col("low"))
        nodes += [found.filter("parent_rep IS NULL").drop("parent_rep"), named.drop("parent_rep", "of", "at", "low")]
        onward = low.select(F.col("of").alias("next_rep"), "at", F.col("low").alias("later"))
        low = alias.join(onward, ["next_rep", "at"], "left").select(
            "of", "at", F.coalesce("low", "later").alias("low")
        )
    return functools.reduce(lambda a, b: a.unionByName(b), nodes)


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """Trie of the rebuilt conversations, with the digest of the ids that end at each node."""
    turns = stored(with_turn_ids(placed_turns(conversations)))
    convs = stored(sequences(rebuilt_turns(turns)))
    empty: Column = F.sha2(F.lit(""), 256)
    return trie_nodes(convs).join(end_digests(convs), "end", "left").select(
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", empty).alias("ends_sha256"),
    )


@query(
    "op12_conversation_trie",
    f"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos,
         length(role) || ':' || role || text AS said, length(text) AS chars
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (
  SELECT conv_id, conv_id - conv_id % {FAMILY} AS base, xor({CRC32_SQL.format("conv_id::VARCHAR")}, 4294967295) % {OPENINGS} AS h
  FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (
  SELECT c.conv_id, pos, said, chars FROM convs c JOIN turns t ON t.conv_id = c.base AND pos < h
  UNION ALL SELECT c.conv_id, pos, said, chars FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND pos >= h),
said AS (
  SELECT c.conv_id, coalesce(list(said ORDER BY pos) FILTER (pos IS NOT NULL), []) AS said,
         coalesce(list(chars ORDER BY pos) FILTER (pos IS NOT NULL), []) AS chars
  FROM convs c LEFT JOIN rebuilt r ON r.conv_id = c.conv_id GROUP BY c.conv_id),
prefixes AS (
  SELECT conv_id, d AS depth, said[1:d] AS prefix, if(d = 0, 0, chars[d]) AS chars, d = len(said) AS ends
  FROM (SELECT *, unnest(range(len(said) + 1)) AS d FROM said)),
nodes AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM prefixes GROUP BY prefix, depth),
children AS (SELECT prefix[1:depth - 1] AS prefix, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
counted AS (SELECT k.*, coalesce(c.n, 0) AS n_children FROM nodes k LEFT JOIN children c ON c.prefix = k.prefix),
sums AS (
  SELECT prefix[1:up] AS prefix, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * chars) AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS up FROM counted) GROUP BY ALL)
SELECT k.conv_id, k.depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves,
       s.saved_tokens::BIGINT AS saved_tokens, k.ends_sha256
FROM counted k JOIN sums s ON s.prefix = k.prefix
LEFT JOIN nodes p ON k.depth > 0 AND p.depth = k.depth - 1 AND p.prefix = k.prefix[1:k.depth - 1]""",
)
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
