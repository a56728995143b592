"""Registry of runnable queries and the SQL each one is checked against."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dossier.session import tune
from dossier.sources.bindings import Tables, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Fixed "now" of the registered queries.
AS_OF = "2024-02-01 00:00:00"

MODULES = (
    "lifecycle_queries",
    "relational_queries",
    "document_queries",
    "feedback_queries",
    "field_queries",
    "rule_queries",
    "report_queries",
    "text_queries",
    "review_queries",
    "stream_queries",
    "storage_queries",
)


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, root: str) -> DataFrame:
            tune(spark)
            return fn(Tables(spark, root))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return fn

    return register


def load() -> None:
    for module in MODULES:
        importlib.import_module(f"dossier.plans.{module}")
