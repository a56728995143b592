"""Repair of damaged conversations by a run-length dynamic program.

Every row is a symbol: the class of its role initial (s, u, a or another) and its fault (none,
to be deleted, truncated). The wanted form ``(s?(ua)+)?`` is an automaton of four states, so
the edits at one row are a 4 x 4 min-plus matrix, which holds the cheapest inserts as well.
Equal neighbouring symbols form a run; a run of length n multiplies by the matrix to the power
of n, from binary powers that each symbol computes once. Costs from each run's end follow;
from them the choices are unrolled row by row, the least letter first among the cheapest,
so the audit is the least string of all that cost as little.

Rows are dealt out by ranges of (conversation, order), so a conversation of any length lies in
chunks, one per partition. A chunk gives its matrix; over the few conversations that lie in
more than one chunk, the costs behind each chunk and then the state before it are passed from
chunk to chunk, a summary as large as the number of partitions at most. The digest of a
repaired conversation is fed row by row from sorted rows.

Cases: null roles and texts are one space, which is a role of no class and a blank text; null
turns come first; rows of equal turn are ordered by role and hash of the text; conversations
without id are one conversation; a conversation without rows after damage has zeros, an
empty audit and the digest of the empty string; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.llm.registry import query, table
from dossier.session import stored

#: What counts as white space, and what ends a complete text.
SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
_NEVER = 1 << 40

#: States: nothing yet, after the system row, after a user row, after an assistant row.
_AFTER_USER, _AFTER_ASSISTANT = 2, 3
_KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_ADDED = (2, 2, 3, 2)
_SAYS = {2: "u", 3: "a"}
_END = (0, 2 * INSERT, INSERT, 0)

Vector = tuple[int, ...]
Matrix = tuple[Vector, ...]


def _row_steps(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the ways to deal with the row itself."""
    role, fault = symbol
    steps = [("D", DELETE, state)]
    if fault != "d":
        more = TRUNCATED if fault == "t" else 0
        if role in _KEPT[state]:
            steps.append(("K", KEEP + more, _KEPT[state][role]))
        steps.append(("R", REROLE + more, _ADDED[state]))
    return steps


@functools.cache
def _matrix(symbol: str) -> Matrix:
    """Least cost from the state before a row to the state behind it, inserts before it included."""
    rows = []
    for state in range(4):
        least, at = [_NEVER] * 4, state
        for inserts in range(3):  # a third one would return to a state seen before
            for _, cost, to in _row_steps(symbol, at):
                least[to] = min(least[to], cost + inserts * INSERT)
            at = _ADDED[at]
        rows.append(tuple(least))
    return tuple(rows)


def _product(a: Matrix, b: Matrix) -> Matrix:
    return tuple(
        tuple(min(_NEVER, *(x + b[k][j] for k, x in enumerate(row))) for j in range(4)) for row in a
    )


@functools.cache
def _power(symbol: str, j: int) -> Matrix:
    """The symbol's matrix to the power of two to the ``j``."""
    if j == 0:
        return _matrix(symbol)
    half = _power(symbol, j - 1)
    return _product(half, half)


def _bits(n: int) -> Iterator[int]:
    return (j for j in range(n.bit_length()) if n >> j & 1)


def _before(matrix: Matrix, costs: Vector) -> Vector:
    return tuple(min(x + c for x, c in zip(row, costs)) for row in matrix)


def runs(symbols: str) -> list[tuple[str, int]]:
    """Two characters a row; equal neighbours as (symbol, length)."""
    rows = (symbols[i : i + 2] for i in range(0, len(symbols), 2))
    return [(s, sum(1 for _ in same)) for s, same in groupby(rows)]


def chunk_matrix(symbols: str) -> Matrix:
    """Product over all rows, run by run."""
    unit = tuple(tuple(0 if i == j else _NEVER for j in range(4)) for i in range(4))
    for symbol, n in runs(symbols):
        for j in _bits(n):
            unit = _product(unit, _power(symbol, j))
    return unit


@functools.lru_cache(100_000)
def _relative(symbol: str, costs: Vector) -> tuple[Vector, int]:
    """Costs before one row, from those behind it, and by how much their least one rose."""
    found = _before(_matrix(symbol), costs)
    low = min(found)
    return tuple(c - low for c in found), low


@functools.lru_cache(100_000)
def _choices(symbol: str, behind: Vector, state: int) -> tuple[str, str, int, int]:
    """Letters at one row, the roles said (inserted ones, then the row's: ``k`` kept, ``u`` or
    ``a`` reroled, ``d`` deleted), the next state and the cost."""
    here, at, letters, roles, spent = _before(_matrix(symbol), behind), state, "", "", 0
    while True:
        steps = {letter: (cost, to) for letter, cost, to in _row_steps(symbol, at)}
        for letter in "DIKR":
            if letter == "I":
                cost, to, left = INSERT, _ADDED[at], here[_ADDED[at]]
            elif letter in steps:
                cost, to = steps[letter]
                left = behind[to]
            else:
                continue
            if cost + left == here[at]:
                break
        letters, spent, at = letters + letter, spent + cost, to
        if letter != "I":
            says = {"D": "d", "K": "k", "R": _SAYS.get(at, "")}[letter]
            return letters, roles + says, at, spent
        roles += _SAYS[at]


def unroll(symbols: str, behind: Vector | None, state: int) -> tuple[list[str], list[str], int, int]:
    """Letters and roles of every row, the state behind the last row and the cost.

    ``behind``: costs behind the chunk, or None where the conversation ends; the inserts at
    its end are then one more entry.
    """
    costs = behind or _END
    known: list[Vector] = []
    per_run = runs(symbols)
    starts = [tuple(c - min(costs) for c in costs)]
    for symbol, n in reversed(per_run):  # costs behind each run, by binary powers
        value = starts[-1]
        for j in _bits(n):
            value = _before(_power(symbol, j), value)
        starts.append(tuple(c - min(value) for c in value))
    letters, roles, spent = [], [], 0
    for (symbol, n), value in zip(per_run, reversed(starts[:-1])):
        known = [value]
        for _ in range(n - 1):
            known.append(_relative(symbol, known[-1])[0])
        for value in reversed(known):
            letter, says, state, cost = _choices(symbol, value, state)
            letters.append(letter)
            roles.append(says)
            spent += cost
    if behind is None:
        last = {1: "ua", 2: "a"}.get(state, "")
        letters.append("I" * len(last))
        roles.append(last)
        spent += INSERT * len(last)
    return letters, roles, state, spent


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after the damage that crc32 of ``conv_id:turn`` decides (see ``op11``)."""
    written = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat_ws(":", *written)) % 20
    text = F.coalesce("text", F.lit(" "))
    role = F.coalesce("role", F.lit(" "))
    rows = conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ENDS, "")).otherwise(text).alias("text"),
        F.array_repeat(F.lit(1), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)).alias("times"),
    )
    return rows.withColumn("copy", F.explode("times")).drop("times", "copy")


def joined(left: DataFrame, right: DataFrame, *names: str, how: str = "left") -> DataFrame:
    """Join on equal ``names``, where null equals null; the right one's are left out."""
    other = right.withColumnsRenamed({n: f"_{n}" for n in names})
    met = functools.reduce(Column.__and__, [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names])
    return left.join(other, met, how).drop(*[f"_{n}" for n in names])


def placed_rows(rows: DataFrame, hashed: str) -> DataFrame:
    """Stored rows of conversations in order of ``place``: the chunk in its upper bits, the row
    in it below. Rows of equal turn are ordered by role and the column ``hashed``."""
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col(hashed), F.col("_given")]
    given = rows.withColumn("_given", F.monotonically_increasing_id())
    dealt = given.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(dealt.withColumn("place", F.monotonically_increasing_id()).drop("_given"))


def row_chunk(place: Column) -> Column:
    return F.shiftright(place, 33).cast("int")


def faults(rows: DataFrame) -> DataFrame:
    """``fault`` of each numbered row: the first of blank, duplicate, truncated, or null."""
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    slim = rows.select(
        "conv_id",
        "place",
        "turn",
        F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("said"),
        F.left("role", F.lit(1)).alias("initial"),
        F.right(trimmed, F.lit(1)).alias("last"),
    )
    again = (
        slim.groupBy("conv_id", "said")
        .agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
    )
    return joined(slim, again, "conv_id", "said").select(
        "conv_id",
        "place",
        "turn",
        "initial",
        F.when(F.col("last") == "", "blank")
        .when(F.col("place") > F.col("first"), "duplicate")
        .when(~F.col("last").isin(*ENDS), "truncated")
        .alias("fault"),
    )


_LEGAL = ("su", "ua", "au")


def chunk_symbols(marked: DataFrame) -> DataFrame:
    """One row per conversation and chunk: its symbols and what its rows add to the counts."""
    role = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    fault = F.when(F.col("fault") == "truncated", "t").when(F.col("fault").isNotNull(), "d").otherwise("n")
    listed = F.array_sort(F.collect_list(F.struct("place", "initial", F.concat(role, fault).alias("symbol"))))
    count = lambda name: F.count(F.when(F.col("fault") == name, 1)).alias(name)
    found = marked.groupBy("conv_id", row_chunk(F.col("place")).alias("chunk")).agg(
        listed.alias("rows"), count("blank"), count("duplicate"), count("truncated")
    )
    initials = F.transform("rows", lambda r: r["initial"])
    pairs = F.zip_with(
        F.slice(initials, F.lit(1), F.size("rows") - 1),
        F.slice(initials, F.lit(2), F.size("rows") - 1),
        lambda a, b: F.concat(a, b),
    )
    return found.select(
        "conv_id",
        "chunk",
        "blank",
        "duplicate",
        "truncated",
        F.col("rows")[0]["place"].alias("place"),
        F.array_join(F.transform("rows", lambda r: r["symbol"]), "").alias("symbols"),
        F.size(F.filter(pairs, lambda p: ~p.isin(*_LEGAL))).cast("long").alias("illegal"),
        F.col("rows")[0]["initial"].alias("first"),
        F.element_at("rows", -1)["initial"].alias("last"),
    )


def _illegal_borders(chunks: DataFrame) -> DataFrame:
    """Illegal neighbours over the border of two chunks, per conversation."""
    following = F.lead("first").over(Window.partitionBy("conv_id").orderBy("chunk"))
    pairs = chunks.select("conv_id", "chunk", "first", "last").select("conv_id", F.concat("last", following).alias("pair"))
    return pairs.filter(~F.col("pair").isin(*_LEGAL)).groupBy("conv_id").agg(F.count(F.lit(1)).alias("illegal"))


def _mapped(names: list[str], types: list[pa.DataType], values):
    """Step that keeps conv_id and chunk and adds what ``values`` gives for the other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = [c.to_pylist() for c in batch.columns[2:]]
            out = [values(*r) for r in zip(*rest)]
            columns = zip(*out) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(list(c), t) for c, t in zip(columns, types))],
                names=["conv_id", "chunk", *names],
            )

    return run


def _costs_behind(key: tuple, chunks: pd.DataFrame) -> pd.DataFrame:
    """Costs behind each chunk of one conversation, relative to their least, from its end."""
    chunks = chunks.sort_values("chunk", ascending=False)
    found, value = [None], _END
    for flat in chunks["matrix"].iloc[:-1]:
        value = _before(tuple(tuple(flat[4 * i : 4 * i + 4]) for i in range(4)), value)
        value = tuple(int(c) - int(min(value)) for c in value)
        found.append(list(value))
    return chunks[["conv_id", "chunk"]].assign(behind=found)


def _states_before(key: tuple, chunks: pd.DataFrame) -> pd.DataFrame:
    """State before each chunk of one conversation, from its start."""
    chunks = chunks.sort_values("chunk")
    found = [0]
    for exits in chunks["exits"].iloc[:-1]:
        found.append(int(exits[found[-1]]))
    return chunks[["conv_id", "chunk", "behind"]].assign(state=found)


def _borders(chunks: DataFrame, kind: str) -> DataFrame:
    """Costs behind and state before the chunks of conversations that have more than one."""
    several = chunks.groupBy("conv_id").count().filter("count > 1").select("conv_id")
    spread = stored(joined(chunks, several, "conv_id", how="left_semi").select("conv_id", "chunk", "symbols"))
    flat = lambda s: ([x for row in chunk_matrix(s) for x in row],)
    matrices = spread.mapInArrow(
        _mapped(["matrix"], [pa.list_(pa.int64())], flat), f"conv_id {kind}, chunk int, matrix array<long>"
    )
    behind = matrices.groupBy("conv_id").applyInPandas(
        _costs_behind, f"conv_id {kind}, chunk int, behind array<long>"
    )
    both = joined(spread, behind, "conv_id", "chunk").select("conv_id", "chunk", "symbols", "behind")
    exits = lambda s, b: (b, [unroll(s, b and tuple(b), i)[2] for i in range(4)])
    return (
        both.mapInArrow(
            _mapped(["behind", "exits"], [pa.list_(pa.int64()), pa.list_(pa.int32())], exits),
            f"conv_id {kind}, chunk int, behind array<long>, exits array<int>",
        )
        .groupBy("conv_id")
        .applyInPandas(_states_before, f"conv_id {kind}, chunk int, behind array<long>, state int")
    )


def repair_plan(chunks: DataFrame) -> DataFrame:
    """Per chunk: letters and roles of each of its rows (and of the end) and the cost."""
    kind = chunks.schema["conv_id"].dataType.simpleString()
    borders = _borders(chunks, kind)
    given = joined(chunks, borders, "conv_id", "chunk").select(
        "conv_id", "chunk", "place", "symbols", "behind", F.coalesce("state", F.lit(0)).alias("state")
    )

    def values(place: int, symbols: str, behind: list[int] | None, state: int) -> tuple:
        letters, roles, _, cost = unroll(symbols, behind and tuple(behind), state)
        return place, "".join(letters), roles, cost

    types = [pa.int64(), pa.string(), pa.list_(pa.string()), pa.int64()]
    return given.mapInArrow(
        _mapped(["place", "audit", "roles", "cost"], types, values),
        f"conv_id {kind}, chunk int, place long, audit string, roles array<string>, cost long",
    )


def repaired_rows(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The repaired conversations as rows: conv_id, chunk, row, at, role, text, in that order."""
    steps = plan.select("conv_id", "chunk", "place", F.posexplode("roles").alias("row", "says")).select(
        "conv_id", "chunk", "row", (F.col("place") + F.col("row")).alias("place"), "says"
    )
    steps = steps.filter("says NOT IN ('d', '')")
    texts = rows.select("conv_id", "place", "role", "text")
    each = F.expr("transform(sequence(1, length(says)), i -> substr(says, i, 1))")
    met = joined(steps, texts, "conv_id", "place").select(
        "conv_id", "chunk", "row", F.posexplode(each).alias("at", "say"), F.length("says").alias("n"), "role", "text"
    )
    # The row itself comes last; the entry behind the last row of a conversation has none.
    own = (F.col("at") == F.col("n") - 1) & F.col("text").isNotNull()
    said = F.when(F.col("say") == "u", "user").when(F.col("say") == "a", "assistant")
    return met.filter("say <> 'd'").select(
        "conv_id",
        "chunk",
        "row",
        "at",
        F.when(own & (F.col("say") == "k"), F.col("role")).otherwise(said).alias("role"),
        F.when(own, F.col("text")).otherwise("").alias("text"),
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the lines of each conversation; its rows follow each other."""
    key, digest, none = None, None, True

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([key], pa.int64()), pa.array([digest.hexdigest()])], names=["conv_id", "repaired_sha256"]
        )

    for batch in batches:
        for conv, line in zip(*(c.to_pylist() for c in batch.columns)):
            if none or conv != key:
                if not none:
                    yield row()
                key, digest, none = conv, hashlib.sha256(line.encode("utf-8", "surrogatepass")), False
            else:
                digest.update(b"\n" + line.encode("utf-8", "surrogatepass"))
    if not none:
        yield row()


def repair_digests(damaged_rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per id of ``conversations``: faults of its damaged rows, the cheapest repair and
    the digest of what it gives."""
    rows = placed_rows(damaged_rows.withColumn("h", F.xxhash64("text")), "h")
    marked = stored(faults(rows))
    chunks = stored(chunk_symbols(marked))
    plan = stored(repair_plan(chunks))
    lines = repaired_rows(rows, plan).select(
        "conv_id", "chunk", "row", "at", F.concat("role", F.lit(":"), "text").alias("line")
    )
    digests = (
        lines.repartition("conv_id")
        .sortWithinPartitions("conv_id", "chunk", "row", "at")
        .select("conv_id", "line")
        .mapInArrow(_digests, "conv_id long, repaired_sha256 string")
    )
    turns = marked.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps")
    )
    audits = plan.groupBy("conv_id").agg(
        F.sum("cost").alias("cost"),
        F.array_sort(F.collect_list(F.struct("chunk", "audit"))).alias("audits"),
    )
    parts = [
        conversations.select("conv_id").distinct(),
        turns,
        chunks.select("conv_id", "blank", "duplicate", "truncated", "illegal"),
        _illegal_borders(chunks),
        audits.select("conv_id", "cost", F.array_join(F.transform("audits", lambda a: a["audit"]), "").alias("audit")),
        digests,
    ]
    every = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    number = lambda c: F.coalesce(F.sum(c).cast("long"), F.lit(0)).alias(c)
    return every.groupBy("conv_id").agg(
        *[number(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


#: DuckDB has no CRC-32: eight shifts for each byte of an ASCII string.
CRC32_SQL = """list_reduce(list_prepend(4294967295, flatten(list_transform(string_split({0}, ''),
  lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, x: if(x >= 0, xor(c, x), xor(c >> 1, if(c % 2 = 1, 3988292384, 0)))) """


@query(
    "op11_conversation_repair",
    f"""
WITH RECURSIVE kinds AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor({CRC32_SQL.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")}, 4294967295) % 20 AS kind
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, if(kind = 4, 'user', role) AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM damaged),
marked AS (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS r,
         CASE WHEN body = '' THEN 'blank'
              WHEN i > min(i) OVER (PARTITION BY conv_id, role, text) THEN 'duplicate'
              WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         count(*) OVER (PARTITION BY conv_id) AS n,
         left(role, 1) || lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS pair
  FROM numbered),
stepped AS (
  SELECT *, if(fault IN ('blank', 'duplicate'), 1000000000, if(fault = 'truncated', 3, 0)) AS t,
         if(r = 's', 0, 1000000000) AS ks, if(r = 'u', 0, 1000000000) AS ku, if(r = 'a', 0, 1000000000) AS ka FROM marked),
behind AS (
  SELECT conv_id, max(n) + 1 AS i, 0 AS v0, 6 AS v1, 3 AS v2, 0 AS v3 FROM stepped GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, least(w0, 3 + w2, 6 + w3), least(w1, 3 + w2, 6 + w3), least(w2, 3 + w3), least(w3, 3 + w2)
  FROM (SELECT s.conv_id, s.i, least(4 + v0, t + ks + v1, t + ku + v2, t + 3 + v2) AS w0, least(4 + v1, t + ku + v2, t + 3 + v2) AS w1,
               least(4 + v2, t + ka + v3, t + 3 + v3) AS w2, least(4 + v3, t + ku + v2, t + 3 + v2) AS w3
        FROM behind b JOIN stepped s ON s.conv_id IS NOT DISTINCT FROM b.conv_id AND s.i = b.i - 1)),
walked AS (
  SELECT conv_id, 1::BIGINT AS i, 0 AS s, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS said, false AS done
  FROM stepped WHERE i = 1
  UNION ALL
  SELECT conv_id, if(letter IN ('D', 'K', 'R'), i + 1, i),
         CASE WHEN letter = 'D' OR letter = '' THEN s WHEN letter = 'K' AND r = 's' THEN 1 WHEN s = 2 THEN 3 ELSE 2 END,
         cost + CASE letter WHEN 'D' THEN 4 WHEN 'I' THEN 3 WHEN 'K' THEN t WHEN 'R' THEN 3 + t ELSE 0 END,
         audit || letter,
         CASE letter WHEN 'I' THEN list_append(said, if(s = 2, 'assistant:', 'user:')) WHEN 'K' THEN list_append(said, role || ':' || text)
                     WHEN 'R' THEN list_append(said, if(s = 2, 'assistant:', 'user:') || text) ELSE said END,
         letter = ''
  FROM (
    SELECT w.conv_id, w.i, w.s, w.cost, w.audit, w.said, p.role, p.text, p.r, p.t,
           CASE WHEN p.i IS NULL THEN if(w.s IN (1, 2), 'I', '')
                WHEN 4 + x[s + 1] = h[s + 1] THEN 'D'
                WHEN 3 + h[if(s = 2, 4, 3)] = h[s + 1] THEN 'I'
                WHEN t + CASE WHEN s = 0 AND r = 's' THEN x[2] WHEN s <> 2 THEN ku + x[3] ELSE ka + x[4] END = h[s + 1] THEN 'K'
                ELSE 'R' END AS letter
    FROM walked w LEFT JOIN stepped p ON p.conv_id IS NOT DISTINCT FROM w.conv_id AND p.i = w.i
    LEFT JOIN (SELECT conv_id, i, [v0, v1, v2, v3] AS h FROM behind) h ON h.conv_id IS NOT DISTINCT FROM w.conv_id AND h.i = w.i
    LEFT JOIN (SELECT conv_id, i, [v0, v1, v2, v3] AS x FROM behind) x ON x.conv_id IS NOT DISTINCT FROM w.conv_id AND x.i = w.i + 1
    WHERE NOT w.done)),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(w.cost, 0)::BIGINT AS cost,
       coalesce(w.audit, '') AS audit, sha256(coalesce(array_to_string(w.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN counts k ON k.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN (SELECT * FROM walked WHERE done) w ON w.conv_id IS NOT DISTINCT FROM c.conv_id""",
)
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text"
    )
    return repair_digests(damaged(given), given)
