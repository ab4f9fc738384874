"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default sf0.1) and ``BENCH_CPUS`` (default 8) choose data and cores,
``BENCH_QUERIES`` a comma-separated subset, ``BENCH_RUNS`` the timed runs per query after one
warm-up (the median counts).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "clean_text",
    "relevance_gate",
    "chunk_sentiment",
    "facet_scores",
    "ngram_candidates",
    "keyword_extract",
    "model_entities",
    "entity_rollup",
    "analyze_documents",
    "mine_patterns",
    "executive_summary",
    "forecast_report",
    "bio_tags",
    "align_subtokens",
    "tokenize_pad",
    "cosine_topk",
    "classification_metrics",
]


def split_copy(spark, sf_dir: str, parts: int) -> str:
    """The tables with as many files as there are cores: one small file would be one task."""
    from corpusdeck.session import scratch_path

    target = scratch_path(spark, "bench-tables")
    for table in sorted(t for t in os.listdir(sf_dir) if t.endswith(".parquet")):
        spark.read.parquet(f"{sf_dir}/{table}").repartition(parts).write.parquet(f"{target}/{table}")
    return target


def main() -> None:
    from corpusdeck.session import build_session
    from workload.catalog import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    tables = split_copy(spark, sf_dir, int(cpus))
    seconds = {}
    for name in names:
        timed = []
        for attempt in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, tables).write.format("noop").mode("overwrite").save()
            if attempt:
                timed.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(timed), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
