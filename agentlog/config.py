"""Settings that change results, and the size limits that change plans only."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # Detection thresholds. A protocol threshold of None falls back to anomaly_threshold.
    anomaly_threshold: float = 0.20
    threshold_mcp: float | None = 0.20
    threshold_a2a: float | None = 0.20
    decision_mode: str = "rule_first"
    shadow_mode: bool = True
    min_baseline_rows: int = 200
    nearest_k: int = 5

    # Promotion of findings.
    hybrid_enabled: bool = False
    hybrid_phase: int = 1
    ml_killswitch: bool = False
    ml_promotion_threshold: float = 0.82

    # Session window length in rows.
    window_rows: int = 10

    # A key (session, score range, ...) with at least hot_key_rows rows is cut into up to
    # hot_key_chunks ordered chunks, so that no single task has to sort it. At most rows / hot_key_rows keys can be
    # hot, which bounds what the split broadcasts. None switches the split off.
    hot_key_rows: int | None = 20_000_000
    hot_key_chunks: int = 1024

    # A baseline above this size is searched in shuffled tiles instead of a broadcast matrix.
    baseline_broadcast_bytes: int = 256 * 1024 * 1024

    def __post_init__(self) -> None:
        if not 1 <= self.hybrid_phase <= 4:
            raise ValueError("hybrid_phase must be between 1 and 4")
        if not 0.0 <= self.ml_promotion_threshold <= 1.0:
            raise ValueError("ml_promotion_threshold must be between 0.0 and 1.0")
        if self.window_rows < 1 or self.hot_key_chunks < 2:
            raise ValueError("window_rows must be >= 1 and hot_key_chunks >= 2")


DEFAULT = Settings()

# Session settings the operators are tuned for.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}
