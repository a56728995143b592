"""Registered queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MODULES = (
    "lm_scoring",
    "decontamination",
    "warc",
    "jaccard_join",
    "quality_rules",
    "substring_dedup",
    "chat_windows",
    "exact_dedup",
    "bpe",
    "token_counts",
    "conversation_repair",
    "conversation_trie",
    "token_records",
)


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load() -> None:
    for module in MODULES:
        importlib.import_module(f"dossier.llm.{module}")
