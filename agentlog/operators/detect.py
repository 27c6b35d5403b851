"""Anomaly detection: a distance score and a behaviour lane, combined by the configured mode. Projections only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentlog.config import DEFAULT, Settings
from agentlog.functions import dictionaries as fixed
from agentlog.functions.lookups import any_contains
from agentlog.operators.vectors import anomaly_score, baseline_size


def threshold(protocol: Column, cfg: Settings = DEFAULT) -> Column:
    """Base threshold: the protocol's own when set, else the common one."""
    own = [(fixed.MCP, cfg.threshold_mcp), (fixed.A2A, cfg.threshold_a2a)]
    out = F.lit(float(cfg.anomaly_threshold))
    for name, value in own:
        if value is not None:
            out = F.when(protocol == name, F.lit(float(value))).otherwise(out)
    return out


def mcp_lane(event: Column, level: Column, message: Column, base: Column) -> tuple[Column, Column, Column]:
    """(threshold, force anomaly, force normal) of an MCP row."""
    event = F.upper(F.coalesce(event, F.lit("")))
    level = F.lower(F.coalesce(level, F.lit("")))
    bad = event.isin(fixed.ANOMALY_TYPES) | any_contains(
        F.lower(F.coalesce(message, F.lit(""))), fixed.BAD_TEXT_TOKENS
    )
    benign = ~bad & event.isin(fixed.BENIGN_EVENTS)
    floor = (
        F.when(benign | (~level.isin("info", "debug") & (level == "warning")), 0.99)
        .when(level.isin("info", "debug"), 0.98)
        .otherwise(0.95)
    )
    return F.when(bad, base).otherwise(F.greatest(base, floor)), bad, benign


def arbitrate(by_rule: Column, by_score: Column, force_normal: Column, cfg: Settings = DEFAULT) -> Column:
    """Combine the lanes. With the shadow flag, rule_first lets a score above the threshold override force-normal."""
    either, both = by_rule | by_score, by_rule & by_score
    combined = {"embedding_only": by_score, "rule_and_embedding": both}.get(cfg.decision_mode, either)
    if cfg.shadow_mode and cfg.decision_mode == "rule_first":
        return either
    return combined & ~force_normal


def lane_confidence(score: Column, limit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-((score - limit) * 10)))


def detect_scored(scored: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Detection columns for logs that carry ``score``."""
    is_mcp = F.col("protocol") == fixed.MCP
    base = threshold(F.col("protocol"), cfg)
    lane_limit, bad, benign = mcp_lane(F.col("event"), F.col("level"), F.col("reasoning_step"), base)
    rows = scored.withColumns(
        {
            "_limit": F.when(is_mcp, lane_limit).otherwise(base),
            "_bad": is_mcp & bad,
            "_benign": is_mcp & benign,
        }
    )
    score, limit = F.col("score"), F.col("_limit")
    return rows.withColumns(
        {
            "anomaly_score": score,
            "is_anomaly": arbitrate(F.col("_bad"), score > limit, F.col("_benign"), cfg),
            "detect_confidence": lane_confidence(score, limit),
            "rule_lane_triggered": F.col("_bad"),
            "embedding_lane_score": score,
            "embedding_lane_threshold": limit,
            "arbitration_mode": F.lit(cfg.decision_mode),
        }
    ).drop("_limit", "_bad", "_benign", "score")


def not_ready(logs: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Detection columns while the baseline is too small to judge by: everything is normal."""
    return logs.withColumns(
        {
            "anomaly_score": F.lit(0.0),
            "is_anomaly": F.lit(False),
            "detect_confidence": F.lit(0.0),
            "rule_lane_triggered": F.lit(False),
            "embedding_lane_score": F.lit(0.0),
            "embedding_lane_threshold": F.lit(None).cast("double"),
            "arbitration_mode": F.lit(cfg.decision_mode),
        }
    )


def baseline_ready(baseline: DataFrame, cfg: Settings = DEFAULT) -> bool:
    return baseline_size(baseline).rows >= cfg.min_baseline_rows


def detect(logs: DataFrame, baseline: DataFrame, cfg: Settings = DEFAULT, id_col: str = "log_id") -> DataFrame:
    """Score logs (with an ``embedding`` column) against the baseline and judge them."""
    if not baseline_ready(baseline, cfg):
        return not_ready(logs, cfg)
    return detect_scored(anomaly_score(logs, baseline, cfg, id_col=id_col), cfg)
