"""Small literal tables as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` refers to it.

    Keeps long chains of text steps linear in size where each step refers to its input
    several times.
    """
    return F.get(F.transform(F.array(value), use), 0)


def lookup(col: Column, table: Mapping, default: Column | None = None) -> Column:
    """Constant map lookup; null (or ``default``) when the key is absent."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), col)
    return found if default is None else F.coalesce(found, default)


#: Every character that counts as white space in Unicode, plus the ASCII separators.
WHITE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def strip(col: Column) -> Column:
    """Trim every kind of white space, not only spaces."""
    return F.btrim(col, F.lit(WHITE_SPACE))


def blank(col: Column) -> Column:
    """True when the text is null or holds no visible character."""
    return F.coalesce(strip(col) == "", F.lit(True))


def sorted_present(flags: Iterable[tuple[str, Column]]) -> Column:
    """Alphabetical list of the names whose flag is true."""
    names = [F.when(flag, F.lit(name)) for name, flag in sorted(flags, key=lambda x: x[0])]
    return F.array_compact(F.array(*names))
