"""Chat formatting into budgeted windows, in DataFrame operations only.

Prefix sums of turn costs place every turn on a line. The line is cut into cells of half the
room a window has for new turns; turns that start in one cell form a window, and a turn
longer than a cell, always the last to start there, forms one of its own. So windows are
aligned with turns and keep the budget unless a single turn exceeds it. A window starts with
the conversation's system turn, then repeats the turns that start within ``history`` before
it; only its new assistant texts are under the loss mask.

Every turn is written ``<|turn|>role\\ntext<|end|>\\n``. Inside roles and texts ``&``, ``<``
and ``[`` are written as ``&amp;``, ``&lt;`` and ``&#91;``, so neither this template's marks
nor those of other templates occur there; reading back undoes that.

A conversation of any length is worked on in chunks of turn numbers and in blocks of cells,
so it is never one task. Only the digest of a whole conversation needs its text in one row.

Cases: null role or text counts as empty; null turn numbers come first and ties are ordered
by role and text, repeated rows are turns of their own; a conversation of a system turn alone
is one window; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.llm.registry import query, table
from dossier.session import stored

BUDGET = 1024
HISTORY = 128
#: Cost of a turn besides its text: marks and role.
TURN_COST = 4
#: Turn numbers of one chunk, cells of one block.
_CHUNK = 256
_BLOCK_CELLS = 64

_TURN, _END = "<|turn|>", "<|end|>\n"
_TOKEN = "[A-Za-z0-9_]+|[^A-Za-z0-9_\\x09-\\x0D\\x20]"
_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("\n", "&#10;"))


def escaped(text: Column, line_ends: bool = False) -> Column:
    for plain, written in _ESCAPES[: 4 if line_ends else 3]:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescaped(text: Column) -> Column:
    for plain, written in reversed(_ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def _same_conversation(left: DataFrame, right: DataFrame) -> Column:
    return left["conv_id"].eqNullSafe(right["conv_id"])


def placed_turns(conversations: DataFrame) -> DataFrame:
    """Turns with their position and the cost of the turns before them (``start``)."""
    turns = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / _CHUNK), F.lit(-(2**62))).alias("chunk"),
    ).withColumn("cost", TURN_COST + F.regexp_count("text", F.lit(_TOKEN)).cast("long"))
    sums = turns.groupBy("conv_id", "chunk").agg(
        F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("n")
    )
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(
        F.col("conv_id"),
        F.col("chunk"),
        F.coalesce(F.sum("cost").over(before), F.lit(0)).alias("base"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base_n"),
    )
    own = Window.partitionBy("conv_id", "chunk").orderBy("turn", "role", "text")
    within = (
        turns.withColumn("inner", F.sum("cost").over(own.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("row", F.row_number().over(own))
    )
    return within.join(
        base, _same_conversation(within, base) & (within["chunk"] == base["chunk"])
    ).select(
        within["conv_id"],
        "role",
        "text",
        "cost",
        (F.col("base_n") + F.col("row") - 1).alias("pos"),
        (F.col("base") + F.col("inner") - F.col("cost")).alias("start"),
    )


def chat_windows(
    conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY
) -> DataFrame:
    """Windows: conv_id, window (position of its first new turn), n_repeated, cost, text and
    loss, the (start, length) spans of ``text`` that are trained on."""
    placed = stored(placed_turns(conversations))
    more = placed.filter("pos = 1").select("conv_id")
    first = placed.filter("pos = 0 AND role = 'system'")
    system = first.join(more, _same_conversation(first, more), "left_semi").select(
        F.col("conv_id"), F.col("text").alias("system"), F.col("cost").alias("system_cost")
    )
    body = (
        placed.join(system, _same_conversation(placed, system), "left")
        .select(placed["*"], "system", "system_cost")
        .filter("system IS NULL OR pos > 0")
        .withColumn("s", F.col("start") - F.coalesce("system_cost", F.lit(0)))
    )
    room = F.greatest(F.lit(1), F.lit(budget - history) - F.coalesce("system_cost", F.lit(0)))
    body = body.withColumn("half", F.greatest(F.lit(1), F.floor(room / 2)))
    head = F.concat(F.lit(_TURN), escaped(F.col("role"), True), F.lit("\n"))
    written = escaped(F.col("text"))
    body = body.select(
        "conv_id",
        "pos",
        "s",
        "cost",
        F.floor(F.col("s") / F.col("half")).alias("cell"),
        (F.col("cost") > F.col("half")).alias("long"),
        (F.col("half") * _BLOCK_CELLS).alias("block_size"),
        F.concat(F.lit(_TURN + "system\n"), escaped(F.col("system")), F.lit(_END)).alias("system"),
        F.coalesce("system_cost", F.lit(0)).alias("system_cost"),
        F.struct(
            F.col("pos"),
            F.concat(head, written, F.lit(_END)).alias("line"),
            F.char_length(head).alias("head"),
            F.char_length(written).alias("length"),
            (F.col("role") == "assistant").alias("loss"),
        ).alias("turn"),
    )
    # A turn near the end of a block is also seen by the next block, as history only.
    block = F.floor(F.col("s") / F.col("block_size"))
    seen = F.array_distinct(F.array(block, F.floor((F.col("s") + history) / F.col("block_size"))))
    spread = body.withColumn("home", block).withColumn("block", F.explode(seen))
    near = Window.partitionBy("conv_id", "block").orderBy("s")
    repeated = F.collect_list(F.struct("turn.pos", "turn.line")).over(near.rangeBetween(-history, -1))
    known = F.sum("cost").over(near.rangeBetween(-history, -1))
    opens = F.lag(F.struct("cell", "long")).over(near)
    marked = spread.select(
        "*",
        F.when(opens.isNull() | (opens != F.struct("cell", "long")), repeated).alias("history"),
        F.coalesce(known, F.lit(0)).alias("history_cost"),
    ).filter("home = block")
    windows = marked.groupBy("conv_id", "cell", "long").agg(
        F.array_sort(F.collect_list("turn")).alias("turns"),
        F.sum("cost").alias("cost"),
        F.min(F.struct("s", "history_cost")).getField("history_cost").alias("history_cost"),
        F.max("history").alias("history"),
        F.first("system").alias("system"),
        F.first("system_cost").alias("system_cost"),
    )
    lead = F.concat(
        F.coalesce("system", F.lit("")),
        F.array_join(F.transform(F.array_sort("history"), lambda t: t["line"]), ""),
    )
    opening = (F.col("turns")[0]["pos"] == 0) | (
        (F.col("turns")[0]["pos"] == 1) & F.col("system").isNotNull()
    )
    windows = windows.select(
        "conv_id",
        F.col("turns")[0]["pos"].alias("window"),
        F.when(opening, 0)
        .otherwise(F.size("history") + F.col("system").isNotNull().cast("int"))
        .alias("n_repeated"),
        (F.col("cost") + F.col("history_cost") + F.col("system_cost")).alias("cost"),
        lead.alias("lead"),
        "turns",
    )
    no_spans = F.array().cast("array<struct<start:int,length:int>>")
    loss = F.aggregate(
        "turns",
        F.struct(F.char_length("lead").alias("at"), no_spans.alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.char_length(t["line"])).alias("at"),
            F.when(
                t["loss"],
                F.concat(
                    acc["spans"],
                    F.array(
                        F.struct((acc["at"] + t["head"]).alias("start"), t["length"].alias("length"))
                    ),
                ),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return windows.select(
        "conv_id",
        "window",
        "n_repeated",
        "cost",
        F.concat("lead", F.array_join(F.transform("turns", lambda t: t["line"]), "")).alias("text"),
        loss.alias("loss"),
    )


def read_turns(windows: DataFrame) -> DataFrame:
    """New turns of each window read from its text, and the text under its loss mask."""
    lines = F.split("text", "<\\|end\\|>\n")
    fresh = F.slice(lines, F.col("n_repeated") + 1, F.size(lines) - 1 - F.col("n_repeated"))

    def parsed(line: Column) -> Column:
        content = F.substr(line, F.lit(len(_TURN) + 1))
        cut = F.instr(content, "\n")
        return F.struct(
            unescaped(F.substr(content, F.lit(1), cut - 1)).alias("role"),
            unescaped(F.substr(content, cut + 1)).alias("text"),
        )

    masked = F.transform(
        "loss", lambda x: unescaped(F.substr(F.col("text"), x["start"] + 1, x["length"]))
    )
    return windows.select(
        "conv_id",
        "window",
        F.transform(fresh, parsed).alias("turns"),
        F.array_join(masked, "").alias("loss_text"),
        F.char_length("text").alias("formatted_chars"),
    )


def conversation_digests(windows: DataFrame) -> DataFrame:
    """One row per conversation, from what its windows hold."""
    said = F.transform(F.col("turns"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    rows = read_turns(windows).select(
        "conv_id",
        F.struct("window", F.array_join(said, "").alias("said"), "loss_text").alias("w"),
        F.size("turns").cast("long").alias("n_turns"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
    whole = rows.groupBy("conv_id").agg(
        F.sum("n_turns").alias("n_turns"),
        F.array_sort(F.collect_list("w")).alias("w"),
        F.sum("formatted_chars").alias("formatted_chars"),
    )
    loss = F.array_join(F.transform("w", lambda x: x["loss_text"]), "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join(F.transform("w", lambda x: x["said"]), ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


_ADDED = "</s>[INST] ok [/INST]"
_WRITTEN = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')"


@query(
    "op7_chat_windows",
    f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{_ADDED}'), (-7, 1, 'assistant', '{_ADDED}')),
costs AS (
  SELECT *, {TURN_COST} + len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_\\x09-\\x0D\\x20]')) AS cost,
         length('<|turn|>') + length(replace({_WRITTEN.format("role")}, chr(10), '&#10;')) + 1
         + length({_WRITTEN.format("text")}) + length('<|end|>') + 1 AS chars FROM rows),
placed AS (
  SELECT *, row_number() OVER w - 1 AS pos, sum(cost) OVER w - cost AS start,
         first_value(role) OVER w = 'system' AND count(*) OVER (PARTITION BY conv_id) > 1 AS has_system,
         first_value(cost) OVER w AS cost0, first_value(chars) OVER w AS chars0
  FROM costs WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
body AS (
  SELECT conv_id, pos, chars, cost, if(has_system, chars0, 0) AS system_chars,
         start - if(has_system, cost0, 0) AS s,
         greatest(1, greatest(1, {BUDGET - HISTORY} - if(has_system, cost0, 0)) // 2) AS half
  FROM placed WHERE NOT has_system OR pos > 0),
spans AS (
  SELECT conv_id, min(s) AS s0, any_value(system_chars) + sum(chars) AS chars
  FROM body GROUP BY conv_id, s // half, cost > half),
repeated AS (
  SELECT w.conv_id, sum(b.chars) AS chars FROM spans w JOIN body b
  ON w.conv_id = b.conv_id AND b.s >= w.s0 - {HISTORY} AND b.s < w.s0 GROUP BY w.conv_id),
formatted AS (SELECT conv_id, sum(chars) AS chars FROM spans GROUP BY conv_id)
SELECT p.conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (any_value(f.chars) + coalesce(any_value(r.chars), 0))::BIGINT AS formatted_chars
FROM placed p JOIN formatted f ON p.conv_id = f.conv_id LEFT JOIN repeated r ON p.conv_id = r.conv_id
GROUP BY p.conv_id""",
)
def op7_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.sql(
        "SELECT * FROM VALUES (-7L, 0L, 'user', :t), (-7L, 1L, 'assistant', :t) AS r(conv_id, turn, role, text)",
        args={"t": _ADDED},
    )
    return conversation_digests(chat_windows(given.unionByName(added)))
