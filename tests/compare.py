"""Compare a query with its oracle: columns, row count and values in any order."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb
from pyspark.sql import SparkSession

from dossier.plans import catalog
from dossier.sources.bindings import DRIVER_TABLES


def connect(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{root}/{name}.parquet'")
    return con


def cell(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        f = float(v)
        if math.isnan(f):
            return "NaN"
        return str(int(f)) if f == int(f) and abs(f) < 1e15 else (str(v) if isinstance(v, int) else f"{f:.7g}")
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return "[" + ",".join(cell(x) for x in v) + "]"
    if hasattr(v, "asDict"):
        return "{" + ",".join(f"{k}:{cell(x)}" for k, x in sorted(v.asDict().items())) + "}"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{cell(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def difference(spark: SparkSession, con, name: str, root: str) -> str | None:
    """None when equal, else a short description."""
    df = catalog.QUERIES[name](spark, root)
    got, gcols = rows_of(df.columns, df.collect())
    if name not in catalog.ORACLES:
        return None if got or not gcols else "no rows"
    cur = con.execute(catalog.ORACLES[name])
    want, wcols = rows_of([d[0] for d in cur.description], cur.fetchall())
    if gcols != wcols:
        return f"columns {gcols} != {wcols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; first extra {next(iter(set(got) - set(want)), None)}; first missing {next(iter(set(want) - set(got)), None)}"
    if got != want:
        a, b = sorted(set(got) - set(want)), sorted(set(want) - set(got))
        return f"{len(a)} rows differ, e.g. {a[:1]} != {b[:1]} in {gcols}"
    if not got:
        return "both empty"
    return None
