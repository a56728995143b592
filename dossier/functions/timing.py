"""Durations between timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def duration_seconds(start: Column, end: Column) -> Column:
    """Whole seconds from ``start`` to ``end``, never negative; null if either is null."""
    seconds = F.timestamp_diff("SECOND", start, end)
    return F.when(start.isNotNull() & end.isNotNull(), F.greatest(F.lit(0).cast("long"), seconds))


def moment(as_of: str) -> Column:
    """The current time of a run as an argument, so results can be repeated."""
    return F.lit(as_of).cast("timestamp_ntz")
