"""Account holder, number and IBAN from labelled lines of a text, as column expressions.

Every line is classed by the label it begins with. A label with something usable behind it has
its value on its own line. Labels with nothing behind them may be the head of a small table:
two or more of them in a run, where short captions that are no label may stand between and
behind them, and the i-th label has the i-th line of the values that follow. The first labels
of a run are left out, and captions behind it passed over, until the number slot reads as a
number and the slots of holder and IBAN as such; else there is no table. Any other label is
over its value, and a holder may go on for two more lines. Of several values for a field the
topmost usable one counts; where no line names the holder, set phrases of the text do.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a line may begin with, by what it labels; the first match counts.
_LABELS = (
    ("number", r"account\s*no\.?\s*/?\s*iban|iban\s*/?\s*account\s*no\.?"),
    ("holder", r"title\s*of\s*account|account\s*(?:title|holder|name)"),
    ("number", r"account\s*(?:number|no\.?)|(?:a/?c|ac)\s*no\.?"),
    ("bank", r"bank\s*name"),
    ("iban", r"iban"),
    ("row", r"(?:s\s*[/#.]?\s*no\.?|s\s*#|sr\.?\s*no\.?|#)\s*$"),
)
# Words that stand for no holder, the shape of an IBAN, phrases before a name.
_NOBODY = ("n/a", "na", "nil", "none", "-", "--", "not applicable")
_IBAN = "[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}"
# A line that is a value of its own and so ends a holder of several lines.
_VALUE = (
    r"^[0-9]{4,}$|^[0-9]{5}-[0-9]{7}-[0-9]$|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4}|(?i:\b(?:PKR|USD|EUR|Rs\.?)\b)"
    r"|\b[A-Z]{2}[0-9]{2}[A-Z0-9]{8,}\b|[0-9]{1,3}(?:,[0-9]{3})+\.[0-9]{2}"
)
# The lines that the head of a table may take, captions included.
_HEAD_LINES = 10
# A short line that may be the caption of a column: no leading digit or bracket, no bare number.
_CAPTION = r"^(?!PK|PN|[0-9.,]+$)[^0-9(\[].{0,19}$"
_NAME = r"([A-Z0-9][A-Za-z0-9 ,&'()\-/]{3,60}?)(?=\.|\s+[a-z]|$)"
_PHRASES = (
    r"(?i:account\s+titled?\s+(?:as\s+)?)[\"'“]([^\"'”]{3,60})[\"'”]",
    r"(?i:account\s+titled?\s+(?:as\s+)?)" + _NAME,
    r"(?i:(?:in\s+the\s+name\s+of|in\s+name\s+of|on\s+behalf\s+of)\s+(?:the\s+)?)" + _NAME,
    r"(?i:account\s+(?:of|held\s+in\s+the\s+name\s+of|maintained\s+by|belonging\s+to)\s+(?:the\s+)?)" + _NAME,
    r"(?i:certif\w*\s+that\s+)([A-Z0-9][A-Za-z0-9 ,.&'()\-/]{3,60}?)(?i:\s+(?:is\s+)?maintaining\s+(?:an?|the)?\s*[^.!?\n]{0,40}\baccount\b)",
)
_NOT_A_NAME = r"(?i)\b(?:bank|branch)\b|^(?:first|second)\s+party\b|^party\s*[ab12]\b|^client$"


def _or_null(text: Column) -> Column:
    return F.when(text != "", text)


def _labelled(line: Column, at: Column) -> Column:
    # Most lines are no label, so one test of all patterns comes before the single ones.
    label = F.when(line.rlike("(?i)^(?:" + "|".join(p for _, p in _LABELS) + ")"), _label_of(line))

    def read(which: Column) -> Column:
        kind = rest = None
        for i, (name, pattern) in enumerate(_LABELS):
            left = F.regexp_replace(line, rf"(?i)^(?:{pattern})(?:\s*\([^()]*\))?[:.\-*\s]*", "")
            kind = F.when(which == i, name) if kind is None else kind.when(which == i, name)
            rest = F.when(which == i, left) if rest is None else rest.when(which == i, left)
        return F.struct(at.alias("at"), line.alias("line"), kind.alias("kind"), rest.alias("rest"))

    return _with(label, read)


def _label_of(line: Column) -> Column:
    """Place of the first label in the list that the line begins with."""
    which = None
    for i, (_, pattern) in enumerate(_LABELS):
        test = line.rlike(f"(?i)^(?:{pattern})")
        which = F.when(test, i) if which is None else which.when(test, i)
    return which


def _name(raw: Column) -> Column:
    name = F.regexp_replace(F.regexp_replace(raw, r"\s+", " "), r"^[.,:;|\- ]+|[.,:;|\- ]+$", "")
    usable = (
        (name != "")
        & ~name.rlike(r"^[0-9]+$|^\([^()]*\)$")
        & ~F.lower(name).isin(*_NOBODY)
        & ~name.rlike("(?i)^(?:" + "|".join(p for _, p in _LABELS) + ")")
    )
    return F.when(usable, name)


def _iban(raw: Column) -> Column:
    """An IBAN that is the whole value, its bracket or one side of its slash."""
    parts = F.split(F.regexp_replace(raw, r"\s+|[.:;\-]+$", ""), r"[/()]")
    return F.get(F.filter(parts, lambda p: p.rlike(f"^{_IBAN}$")), 0)


def _account(raw: Column) -> Column:
    """(number, iban) of the value of a number label.

    A bracket that holds an IBAN is taken off first. A slash parts the value only where one
    side is an IBAN; else it belongs to the number. A value of several words gives its first
    long run of letters and digits, if that is a number or an IBAN.
    """

    def is_iban(v: Column) -> Column:
        return F.regexp_replace(v, r"\s+", "").rlike(f"^{_IBAN}$")

    def read(number: Column | None, iban: Column | None) -> Column:
        none = F.lit(None).cast("string")
        bare = none if iban is None else F.regexp_replace(iban, r"\s+", "")
        return F.struct((none if number is None else _or_null(F.trim(number))).alias("number"), bare.alias("iban"))

    def parted(v: Column, tail: Column) -> Column:
        left, right = F.trim(F.substring_index(v, "/", 1)), F.trim(F.substr(v, F.instr(v, "/") + 1))
        run = F.regexp_extract(v, "[A-Za-z0-9]{8,}", 0)
        has_digit = v.rlike("[0-9]") & (F.char_length(v) >= 4)
        return (
            F.when(v.contains("/") & is_iban(right), read(left, right))
            .when(v.contains("/") & is_iban(left), read(right, left))
            .when(v.contains("/"), read(F.when(has_digit, v), tail))
            .when(is_iban(v), read(None, v))
            .when(v.rlike("^[0-9]{1,3}$"), read(None, tail))
            .when(has_digit & v.rlike(r"^[A-Za-z0-9\-]+$"), read(v, tail))
            .when(is_iban(run), read(None, run))
            .when(run.rlike("^[0-9]+$"), read(run, tail))
            .otherwise(read(None, tail))
        )

    trimmed = F.regexp_replace(raw, r"^[\s.:;]+|[.:;\-/\s]+$", "")
    bracket = F.regexp_extract(trimmed, r"^(.+?)\s*\(([^()]+)\)?$", 2)
    tailed = (bracket != "") & is_iban(bracket)
    head = F.when(tailed, F.regexp_extract(trimmed, r"^(.+?)\s*\(([^()]+)\)?$", 1)).otherwise(trimmed)
    only = F.regexp_extract(trimmed, r"^\(([^()]+)\)?$", 1)
    return _with(
        F.struct(F.when(only != "", only).otherwise(head).alias("head"), F.when(tailed, bracket).alias("tail")),
        lambda x: parted(x["head"], x["tail"]),
    )


def _number(raw: Column) -> Column:
    return _account(raw)["number"]


def _first(values: Column, read) -> Column:
    """What ``read`` gives for the topmost value for which it gives anything."""
    return F.get(F.filter(F.transform(values, read), lambda v: v.isNotNull()), 0)


def _with(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _usable(kind: Column, raw: Column) -> Column:
    """Whether a value reads as its kind; those of other columns always do."""
    return (
        F.when(kind == "holder", _name(raw).isNotNull())
        .when(kind == "number", _with(_account(raw), lambda a: F.coalesce(a["number"], a["iban"])).isNotNull())
        .when(kind == "iban", _iban(raw).isNotNull())
        .otherwise(True)
    )


def _table(lines: Column, heads: Column, stop: Column) -> Column:
    """The first reading of a run as the head of a table, or null: (first, behind), where the
    label ``heads[first + i]`` has the line ``behind + i``; captions end before ``stop``."""

    def reads(first: Column, behind: Column) -> Column:
        columns = F.slice(heads, first + 1, F.size(heads) - first)
        slots = F.transform(columns, lambda h, i: F.struct(h["kind"].alias("kind"), F.get(lines, behind + i).alias("under")))
        return F.exists(slots, lambda x: x["kind"] == "number") & F.forall(
            slots,
            lambda x: x["under"].isNotNull() & x["under"]["kind"].isNull() & _usable(x["kind"], x["under"]["line"]),
        )

    last = F.element_at(heads, -1)["at"]
    tried = F.flatten(
        F.transform(
            F.filter(
                F.sequence(F.greatest(F.lit(0), F.size(heads) - _HEAD_LINES), F.size(heads) - 2),
                lambda first: last - F.get(heads, first)["at"] < _HEAD_LINES,
            ),
            lambda first: F.transform(
                F.sequence(last + 1, F.least(stop, F.get(heads, first)["at"] + _HEAD_LINES)),
                lambda behind: F.struct(first.alias("first"), behind.alias("behind")),
            ),
        )
    )
    return F.when(
        (F.size(heads) > 1) & F.exists(heads, lambda h: h["kind"] == "number"),
        F.get(F.filter(tried, lambda c: reads(c["first"], c["behind"])), 0),
    )


def _below(lines: Column, x: Column) -> Column:
    """The value in the lines under a label, null where the next line is a label too."""

    def at(i: int) -> Column:
        return F.get(lines, x["at"] + i)

    def goes_on(i: int) -> Column:
        no_value = ~F.coalesce(at(i)["kind"].isNull() & at(i)["line"].rlike(_VALUE), F.lit(False))
        next_no_value = ~F.coalesce(at(i + 1)["kind"].isNull() & at(i + 1)["line"].rlike(_VALUE), F.lit(False))
        return at(i).isNotNull() & at(i)["kind"].isNull() & no_value & next_no_value

    def depth(i: int) -> Column:
        return F.regexp_count(at(i)["line"], F.lit(r"\(")) - F.regexp_count(at(i)["line"], F.lit(r"\)"))

    closed = (depth(1) > 0) & (depth(1) + depth(2) == 0)
    joined = (
        F.when(~goes_on(2), at(1)["line"])
        .when(closed | ~goes_on(3), F.concat_ws(" ", at(1)["line"], at(2)["line"]))
        .otherwise(F.concat_ws(" ", at(1)["line"], at(2)["line"], at(3)["line"]))
    )
    return F.when(at(1)["kind"].isNull(), F.when(x["kind"] == "holder", joined).otherwise(at(1)["line"]))


def _values_of(lines: Column, ends: Column) -> Column:
    def value(x: Column) -> Column:
        before = F.coalesce(F.array_max(F.filter(ends, lambda e: e < x["at"])), F.lit(-1))
        stop = F.coalesce(F.array_min(F.filter(ends, lambda e: e > x["at"])), F.size(lines))
        run = F.slice(lines, before + 2, stop - before - 1)
        heads = F.filter(run, lambda y: y["kind"].isNotNull())

        def raw(heads: Column) -> Column:
            rank = F.size(F.filter(heads, lambda y: y["at"] < x["at"]))
            return _with(
                _table(lines, heads, stop),
                lambda t: F.when(
                    t.isNotNull() & (rank >= t["first"]), F.get(lines, t["behind"] + rank - t["first"])["line"]
                ).otherwise(_below(lines, x)),
            )

        own = (x["rest"] != "") & _usable(x["kind"], x["rest"])
        below = F.when(x["rest"] != "", _below(lines, x)).otherwise(_with(heads, raw))
        return F.struct(x["kind"].alias("kind"), F.when(own, x["rest"]).otherwise(below).alias("raw"))

    return F.transform(F.filter(lines, lambda x: x["kind"].isin("holder", "number", "iban")), value)


def labelled_values(text: Column) -> Column:
    """Array of (kind, raw): the value of every labelled line, top to bottom."""
    trimmed = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), lambda x: F.trim(x))
    lines = F.transform(F.filter(trimmed, lambda x: x != ""), _labelled)

    def ends(lines: Column) -> Column:
        # A label with a value behind it ends a run as any line does that is no caption, or
        # that reads as the number which the label over it asks for.
        def over(x: Column) -> Column:
            above = F.get(lines, x["at"] - 1)
            asked = F.when(x["at"] > 0, (above["kind"] == "number") & (above["rest"] == ""))
            return F.coalesce(asked, F.lit(False)) & x["line"].rlike(r"^[A-Za-z0-9\-]*[0-9][A-Za-z0-9\-]*$")

        broken = F.filter(
            lines,
            lambda x: (x["kind"].isNull() & (~x["line"].rlike(_CAPTION) | over(x))) | (x["rest"] != ""),
        )
        return F.transform(broken, lambda x: x["at"])

    return _with(lines, lambda own: _with(ends(own), lambda e: _values_of(own, e)))


def account_block(text: Column) -> Column:
    """Struct of account_holder, account_number and iban of one text; null where not found.

    Every line is classed and every value is read once for all three. Readers of more than one
    part make a column of the struct first.
    """

    def read(value: Column) -> Column:
        """What one labelled value holds, by what its label says."""
        raw, none = value["raw"], F.lit(None).cast("string")
        account = F.when(value["kind"] == "number", _account(raw))
        return _with(
            F.struct(account.alias("account"), F.when(value["kind"] == "iban", _iban(raw)).alias("iban")),
            lambda x: F.struct(
                F.when(value["kind"] == "holder", _name(raw)).otherwise(none).alias("holder"),
                x["account"]["number"].alias("number"),
                x["account"]["iban"].alias("number_iban"),
                F.coalesce(x["account"]["iban"], x["iban"]).alias("iban"),
            ),
        )

    def phrase() -> Column:
        flowed = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s*\n\s*", " ")
        hits = F.flatten(F.array(*[F.regexp_extract_all(flowed, F.lit(p), 1) for p in _PHRASES]))
        spoken = F.transform(hits, _name)
        return F.get(
            F.filter(spoken, lambda n: n.isNotNull() & (F.char_length(n) >= 3) & ~n.rlike(_NOT_A_NAME)), 0
        )

    def block(values: Column) -> Column:
        # A number label may hold nothing but an IBAN, which then is the number as well.
        number = F.coalesce(
            _first(values, lambda v: v["number"]), _first(values, lambda v: v["number_iban"])
        )
        return F.struct(
            F.coalesce(_first(values, lambda v: v["holder"]), phrase()).alias("account_holder"),
            number.alias("account_number"),
            _first(values, lambda v: v["iban"]).alias("iban"),
        )

    return _with(F.transform(labelled_values(text), read), block)


def account_values(text: Column) -> dict[str, Column]:
    """The parts of :func:`account_block`, by name."""
    block = account_block(text)
    return {name: block[name] for name in ("account_holder", "account_number", "iban")}
