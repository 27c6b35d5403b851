"""Report files of an answer-key comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentlog.config import DEFAULT, Settings
from agentlog.operators import evaluate
from agentlog.operators.findings import analysis_summary


def summary_report(logs: DataFrame, findings: DataFrame, key: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """One row: totals, engine summary and promotion sources. Mismatching ids are a table of their own."""
    sources = evaluate.promotion_breakdown(findings).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("promotion_source", "count")))).alias("m")
    )
    totals = evaluate.key_match(findings, key)
    engine = analysis_summary(logs, cfg).select(F.struct("*").alias("s"))
    return totals.select(
        F.struct("*").alias("totals"),
        engine.scalar().alias("engine_session_summary"),
        sources.scalar().alias("promotion_source_breakdown"),
    )


def write_reports(logs: DataFrame, findings: DataFrame, key: DataFrame, path: str, cfg: Settings = DEFAULT) -> None:
    """Write summary (JSON), mismatches (JSON), session matrix (CSV) and log comparison (CSV) below path."""
    summary_report(logs, findings, key, cfg).write.mode("overwrite").json(f"{path}/summary")
    evaluate.key_mismatches(findings, key).write.mode("overwrite").json(f"{path}/mismatches")
    csv = {"header": True, "emptyValue": "", "nullValue": ""}
    matrix = evaluate.session_matrix(findings, key).orderBy("session_id")
    matrix.write.mode("overwrite").options(**csv).csv(f"{path}/session_matrix")
    evaluate.log_comparison(findings, key).write.mode("overwrite").options(**csv).csv(f"{path}/log_comparison")
