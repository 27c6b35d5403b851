"""Registered queries beside their DuckDB statements at the smallest scale.

A part of them by default; AGENTLOG_ALL_QUERIES=1 runs all (``python -m tests.compare`` does so at a larger scale).
"""

import os

import pytest

import __spark_entry__ as entry
from agentlog.plans import registry
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
SOME = [
    "ingest_json_lines", "uploaded_documents", "protocol_routing", "normalize_a2a", "stratified_sample", "mix_sources",
    "signal_rules", "signal_arguments", "analyze", "analyze_split_sessions", "session_edges", "session_summaries",
    "duplicate_ngram_ratio", "nearest_vectors", "nearest_vectors_cells", "anomaly_scores_without_self", "anchor_scores",
    "detect_logs", "classify_logs", "process_logs", "anomalies_per_hour", "graph_edges", "delegation_trace",
    "trigger_graph", "threshold_sweep_by_protocol", "binary_metrics", "class_report", "latency_percentiles",
]
NAMES = list(registry.QUERIES) if os.environ.get("AGENTLOG_ALL_QUERIES") else SOME


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    message = compare(spark, duck, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert message is None


def test_every_query_has_a_statement():
    assert set(registry.QUERIES) == set(registry.ORACLE)
    assert set(registry.QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
