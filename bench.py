"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "normalize_mcp",
    "ingest_json_lines",
    "analyze",
    "analysis_summary",
    "session_summaries",
    "previous_in_session",
    "nearest_vectors",
    "anomaly_scores",
    "detect_logs",
    "classify_logs",
    "process_logs",
    "graph_edges",
    "root_cause_trace",
    "answer_key_match",
    "threshold_sweep",
    "binary_metrics",
    "latency_percentiles",
]
# Queries over the events table, whose rates are logs per second.
RATED = ["normalize_mcp", "analyze", "process_logs"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from agentlog.config import SESSION_CONF
    from agentlog.plans import registry

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("agentlog-bench")
        .config(map=SESSION_CONF)
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    logs = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": int(cpus),
                "logs": logs,
                "logs_per_sec": {n: round(logs / times[n]) for n in RATED},
            }
        )
    )


if __name__ == "__main__":
    main()
