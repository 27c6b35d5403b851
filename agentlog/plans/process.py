"""End-to-end runs over logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from agentlog.config import DEFAULT, Settings
from agentlog.functions import dictionaries as fixed
from agentlog.operators import classify as cl
from agentlog.operators import findings as fd
from agentlog.operators import graph
from agentlog.operators.detect import detect, detect_scored
from agentlog.operators.normalize import as_logs, check_all, normalize_all
from agentlog.operators.vectors import vectorize
from agentlog.sources.scratch import scratch_path


def process(
    logs: DataFrame, baseline: DataFrame, caused_by: DataFrame | None = None, cfg: Settings = DEFAULT
) -> DataFrame:
    """Detect, classify, link and explain logs that carry an ``embedding``. One shuffle, by session.

    ``caused_by`` holds CAUSED_BY edges known from elsewhere; without it every anomaly is its own root.
    """
    return link_and_explain(cl.classify(detect(logs, baseline, cfg)), caused_by, cfg)


def process_scored(logs: DataFrame, caused_by: DataFrame | None = None, cfg: Settings = DEFAULT) -> DataFrame:
    """``process`` for logs that already carry a ``score``."""
    return link_and_explain(cl.classify(detect_scored(logs, cfg)), caused_by, cfg)


def link_and_explain(classified: DataFrame, caused_by: DataFrame | None, cfg: Settings) -> DataFrame:
    linked = graph.with_previous(classified.drop("embedding"), cfg)
    if caused_by is None:
        rows = linked.withColumns(
            {
                "root_cause_log_id": F.when(F.col("is_anomaly"), F.col("log_id")),
                "causal_chain": F.when(F.col("is_anomaly"), F.array("log_id")),
                "hop_count": F.when(F.col("is_anomaly"), 0),
            }
        )
    else:
        traced = graph.trace_rca(linked.where("is_anomaly"), caused_by).drop("explanation")
        rows = linked.join(traced, "log_id", "left")
    text = cl.explain(
        F.col("classification.anomaly_type"),
        F.col("anomaly_score"),
        F.col("root_cause_log_id"),
        F.col("detect_confidence"),
    )
    return rows.withColumn("explanation", F.when(F.col("is_anomaly"), text))


def analyze_raw_group(
    raw: DataFrame, baseline: DataFrame, encode: Callable[[DataFrame], DataFrame] = vectorize, cfg: Settings = DEFAULT
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, failures, summary) of raw records of both protocols.

    Records that can't be normalized are kept as ``arrival_seq, raw, errors``; the others are analysed as a group. The
    summary has one row: logs, failures, anomalies, their density in percent, and anomalies per type as type -> count.
    ``encode`` adds the ``embedding`` that the baseline is searched with. The failures are a table, written by the one scan of
    the records that also counts the protocols, which decide how the others are analysed.
    """
    bad, counts, path = F.size("errors") > 0, Observation(), scratch_path(raw.sparkSession, "failures")
    seen = check_all(raw).observe(counts, *[F.count_if(~bad & c).alias(n) for n, c in _protocol_counts().items()])
    seen.where(bad).select("arrival_seq", "raw", "errors").write.option("compression", "zstd").parquet(path)
    failures = raw.sparkSession.read.parquet(path)
    rows = analyze_group(encode(as_logs(normalize_all(raw).where(~bad))), baseline, cfg, dict(counts.get))
    kinds = rows.where("is_anomaly").groupBy(F.coalesce("anomaly_type", F.lit("UNKNOWN")).alias("type"))
    kinds = kinds.agg(F.count(F.lit(1)).alias("n"))
    by_type = kinds.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("by_type"))
    counts = rows.agg(F.count(F.lit(1)).alias("logs"), F.count_if("is_anomaly").alias("anomalies"))
    failed = failures.agg(F.count(F.lit(1)).alias("failures"))
    density = F.when(F.col("logs") > 0, F.round(F.col("anomalies") / F.col("logs") * 100, 2)).otherwise(0.0)
    # One row each.
    summary = counts.crossJoin(failed).crossJoin(by_type).withColumn("anomaly_density_pct", density)
    return rows, failures, summary


def _protocol_counts() -> dict[str, Column]:
    """What is counted of a group of logs: all, and those of MCP."""
    return {"n": F.lit(True), "mcp": F.upper("protocol") == fixed.MCP}


def analyze_group(
    logs: DataFrame, baseline: DataFrame | None = None, cfg: Settings = DEFAULT, counts: dict[str, int] | None = None
) -> DataFrame:
    """Group analysis: session findings when every log is MCP, else detection and classification row by row.

    One row per log with ``is_anomaly``, ``anomaly_type``, ``anomaly_score``, ``root_cause_log_id`` and ``reason``. ``counts``
    are those of ``_protocol_counts`` where they are known.
    """
    if counts is None:
        counts = logs.agg(*[F.count_if(c).alias(n) for n, c in _protocol_counts().items()]).first()
    if counts["n"] and counts["n"] == counts["mcp"]:
        return fd.join_findings(logs, fd.analyze(logs, cfg))
    judged = cl.classify(detect(logs, baseline, cfg)).drop("anomaly_type_label")
    return judged.withColumns(
        {
            "anomaly_type": F.col("classification.anomaly_type"),
            "root_cause_log_id": F.when(F.col("is_anomaly"), F.col("log_id")),
            "reason": F.when(F.col("is_anomaly"), F.col("classification.reasoning")),
        }
    )
