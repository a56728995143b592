"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from dossier.plans import catalog  # noqa: E402
from dossier.session import data_root, local_session  # noqa: E402
from dossier.sources.bindings import Tables  # noqa: E402

HEADLINE = (
    "performance_breakdown",
    "performance_overview",
    "timeline",
    "completeness",
    "operator_queue",
    "assign_copy_numbers",
    "queue_progress",
    "curated_dataset",
    "learning_statistics",
    "learning_version",
    "rule_summary",
    "recommendations",
    "normalize_fields",
    "classify_pages",
    "evaluate_rules",
    "extract_fields",
    "analyze_documents",
    "analysis_stages",
    "bulk_file_documents",
    "validation_report",
    "stream_completeness",
)


def main() -> None:
    root = data_root()
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    catalog.load()
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINE)
    catalog.QUERIES["status_counts"](spark, root).collect()  # start the session's machinery
    seconds = {}
    for name in names:
        begin = time.perf_counter()
        catalog.QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    documents = spark.read.parquet(f"{root}/lineitem.parquet").count()
    texts = Tables(spark, root).texts.count()
    rules, analysis = seconds.get("evaluate_rules"), seconds.get("analyze_documents")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(root.rstrip("/")).removeprefix("sf"),
                "documents": documents,
                "rules_documents_per_second": round(documents / rules, 1) if rules else None,
                "texts": texts,
                "analysis_documents_per_second": round(texts / analysis, 1) if analysis else None,
            }
        )
    )


if __name__ == "__main__":
    main()
