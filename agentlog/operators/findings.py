"""Session analysis: logs -> findings -> summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentlog.config import DEFAULT, Settings
from agentlog.functions import dictionaries as fixed
from agentlog.functions.lookups import label_score, legacy_type, lookup
from agentlog.functions.plan import computed_once
from agentlog.operators import session, signals


def judged_rows(logs: DataFrame, cfg: Settings = DEFAULT, scorer: signals.Scorer | None = None) -> DataFrame:
    """Every MCP row with its final signals, subtype, links and promotion decision. One shuffle, by session."""
    rows = signals.row_signals(signals.signal_rows(logs), cfg, scorer)
    return decide(session.correlate_sessions(rows, cfg), cfg)


JUDGED_COLUMNS = [
    "log_id", "session_id", "ts", "arrival_seq", "event", "level", "tool", "subtype", "s1", "s2", "s3", "s4", "warned", "has_code",
    "synthetic", "ml_score", "ml_label", "detail", "derived", "c_429", "context_rule_ids", "own_links", "back_links",
    "reported", "promotion_source",
]


def decide(rows: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Signals after noise and correlation, and the promotion decision. Correlation can bring a cleared row back."""
    derived = F.col("derived").isNotNull()
    linked = derived & (F.size("links") > 0)
    s2 = (((F.col("level") == "error") | F.col("warned")) & ~F.col("cleared")) | linked
    out = rows.withColumns(
        {"s2": s2, "s3": F.col("s3") | derived, "subtype": F.coalesce("subtype", "derived")}
    )
    rule_hit = F.col("s1") | F.col("s2") | F.col("s3")
    reported, source = signals.promotion(rule_hit, F.col("s4"), F.col("ml_score"), F.col("subtype"), cfg)
    comment_injection = (F.col("subtype") == "prompt_injection_attempt") & (F.col("tool") == "post_comment")
    own = F.when(comment_injection, F.array_sort(F.array_union(F.col("links"), session.prior_comments())))
    done = out.withColumns(
        {"reported": reported, "promotion_source": source, "own_links": F.coalesce(own, F.col("links"))}
    )
    return computed_once(done, [c for c in JUDGED_COLUMNS if c in done.columns])


def to_findings(judged: DataFrame) -> DataFrame:
    """The reported rows in finding form. ``finding_id`` is a hash, so that results repeat."""
    base = signals.confidence(
        F.col("s1"), F.col("s2"), F.col("s3"), F.col("s4"), F.col("level"), F.col("warned"), F.col("has_code")
    )
    links = F.col("own_links")
    back = F.col("back_links") if "back_links" in judged.columns else F.array().cast("array<string>")
    named = [F.when(F.col(s), F.lit(n)) for s, n in zip(("s1", "s2", "s3", "s4"), SIGNALS)]
    subtype = F.col("subtype")
    return judged.where("reported").select(
        F.sha2(F.concat_ws("|", F.col("log_id"), subtype), 256).alias("finding_id"),
        "session_id",
        "log_id",
        "ts",
        "arrival_seq",
        subtype.alias("anomaly_type"),
        signals.final_confidence(base, subtype, F.col("promotion_source"), F.col("ml_score")).alias("confidence"),
        F.array_compact(F.array(*named)).alias("signals_triggered"),
        "event",
        "tool",
        F.when(F.col("level").isin(fixed.LEVELS), F.col("level")).otherwise("info").alias("level"),
        signals.finding_summary(subtype, F.col("event")).alias("summary"),
        "detail",
        signals.recommended_action(subtype).alias("recommended_action"),
        F.concat(links, F.array_except(back, links)).alias("correlated_log_ids"),
        "context_rule_ids",
        legacy_type(subtype).alias("legacy_anomaly_type"),
        subtype.alias("subtype"),
        F.col("synthetic").alias("synthetic_test_data"),
        "ml_score",
        "ml_label",
        "promotion_source",
        F.lit("promoted").alias("policy_decision"),
    )


# Signal names.
SIGNALS = ["signal_1", "signal_2", "signal_3", "signal_4"]


def analyze(logs: DataFrame, cfg: Settings = DEFAULT, scorer: signals.Scorer | None = None) -> DataFrame:
    """Findings of all sessions."""
    return to_findings(judged_rows(logs, cfg, scorer))


# --- summary ----------------------------------------------------------------------------------------------------------


def assessment(total: Column, found: Column, density: Column) -> Column:
    return (
        F.when(total == 0, fixed.ASSESS_EMPTY)
        .when(found == 0, fixed.ASSESS_CLEAN)
        .when(density > 20.0, fixed.ASSESS_ELEVATED)
        .otherwise(fixed.ASSESS_ISOLATED)
    )


def _summary_rows(logs: DataFrame, cfg: Settings, scorer: signals.Scorer | None) -> DataFrame:
    """One narrow row per log of any protocol, with its finding if it has one.

    Judged MCP rows already carry all that is counted, so the summary needs no join of logs and findings.
    """
    judged = judged_rows(logs, cfg, scorer)
    base = signals.confidence(
        F.col("s1"), F.col("s2"), F.col("s3"), F.col("s4"), F.col("level"), F.col("warned"), F.col("has_code")
    )
    confidence = signals.final_confidence(base, F.col("subtype"), F.col("promotion_source"), F.col("ml_score"))
    n_signals = sum((F.col(s).cast("int") for s in ("s1", "s2", "s3", "s4")), F.lit(0))
    mcp = judged.select(
        "session_id",
        "arrival_seq",
        "log_id",
        "level",
        F.col("reported"),
        F.when(F.col("reported"), F.col("subtype")).alias("type"),
        F.when(F.col("reported"), confidence).alias("confidence"),
        F.when(F.col("reported"), n_signals).alias("n_signals"),
        F.when(F.col("reported"), "promoted").otherwise(F.col("promotion_source")).alias("policy"),
    )
    other = logs.where(~F.col("protocol").eqNullSafe(fixed.MCP)).select(
        "session_id",
        "arrival_seq",
        "log_id",
        F.lower(F.coalesce("level", F.lit("info"))).alias("level"),
        F.lit(False).alias("reported"),
        *[F.lit(None).cast(t).alias(c) for c, t in (("type", "string"), ("confidence", "string"), ("n_signals", "int"))],
        F.lit(None).cast("string").alias("policy"),
    )
    return mcp.unionByName(other)


def analysis_summary(
    logs: DataFrame, cfg: Settings = DEFAULT, by: str | None = None, scorer: signals.Scorer | None = None
) -> DataFrame:
    """Summary of the whole batch, or one row per value of ``by`` (``session_id``)."""
    return summarize(_summary_rows(logs, cfg, scorer), by)


def _label_counts(pairs: Column) -> Column:
    """Map of label -> count from a short list of (label, n) pairs with repeated labels."""
    labels = F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p.label)))

    def total(label: Column) -> Column:
        own = F.filter(pairs, lambda p: p.label == label)
        return F.aggregate(own, F.lit(0).cast("bigint"), lambda acc, p: acc + p.n)

    return F.map_from_entries(F.transform(labels, lambda x: F.struct(x.alias("key"), total(x).alias("value"))))


def summarize(rows: DataFrame, by: str | None = None) -> DataFrame:
    """Counts of a batch in one lineage: rows -> label cells per session -> label cells -> one row.

    The first step combines on the map side, so the rows themselves are never shuffled here. The last step gathers
    label combinations (level, type, confidence, policy), of which there are a few hundred at most.
    """
    labels = ["level", "reported", "type", "confidence", "policy"]
    rank = lookup(F.col("confidence"), {"high": 3, "medium": 2, "low": 1})
    # Highest risk: confidence, then number of signals, then first arrival.
    risk = F.when(
        F.col("reported"),
        F.struct(rank.alias("rank"), "n_signals", (-F.col("arrival_seq")).alias("neg_seq"), "log_id", "type"),
    )
    cells = (
        rows.withColumn("risk", risk)
        .groupBy("session_id", *labels)
        .agg(F.count(F.lit(1)).alias("n"), F.min("arrival_seq").alias("first_seq"), F.max("risk").alias("risk"))
    )
    whole = Window.partitionBy("session_id")
    size = F.struct(
        F.sum("n").over(whole).alias("rows"),
        (-F.min("first_seq").over(whole)).alias("neg_first"),
        F.col("session_id").alias("id"),
    )
    keys = [by] if by else []
    shared = (
        cells.withColumn("size", size)
        .groupBy(*keys, *labels)
        .agg(F.sum("n").alias("n"), F.max("risk").alias("risk"), F.max("size").alias("size"))
    )
    n, level, reported = F.col("n"), F.col("level"), F.col("reported")
    count_where = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0).cast("bigint"))
    fixed_map = lambda col, names: F.create_map(
        *[x for name in names for x in (F.lit(name), count_where(col == name))]
    )
    pairs = lambda c: F.collect_list(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("label"), n)))
    total, found = F.col("total_logs_analysed"), F.col("anomalies_found")
    density = F.when(total == 0, 0.0).otherwise(found / total * 100.0)
    finding_id = F.sha2(F.concat_ws("|", F.col("risk.log_id"), F.col("risk.type")), 256)
    return (
        shared.groupBy(*keys)
        .agg(
            F.max("size").alias("size"),
            F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("total_logs_analysed"),
            count_where(reported).alias("anomalies_found"),
            pairs("type").alias("types"),
            fixed_map(F.col("confidence"), ["high", "medium", "low"]).alias("by_confidence"),
            fixed_map(level, ["error", "warning", "info", "debug"]).alias("by_level"),
            count_where(level == "warning").alias("warning_logs"),
            count_where(level == "error").alias("error_logs"),
            count_where((level == "warning") & ~reported).alias("non_anomalous_warnings"),
            count_where((level == "error") & ~reported).alias("non_anomalous_errors"),
            pairs("policy").alias("policies"),
            F.max("risk").alias("risk"),
        )
        .select(
            F.coalesce("size.id", F.lit("")).alias("session_id"),
            total,
            found,
            F.bround(density, 2).alias("anomaly_density_pct"),
            _label_counts(F.col("types")).alias("by_type"),
            "by_confidence",
            "by_level",
            "warning_logs",
            "error_logs",
            "non_anomalous_warnings",
            "non_anomalous_errors",
            _label_counts(F.col("policies")).alias("policy_stats"),
            F.when(F.col("risk").isNotNull(), finding_id).alias("highest_risk_finding_id"),
            assessment(total, found, density).alias("assessment"),
        )
    )


def join_findings(logs: DataFrame, findings: DataFrame) -> DataFrame:
    """Logs with the outcome of their finding: flag, type, score, first linked log (n/a when there is none)."""
    f = findings.select(
        "log_id",
        F.col("legacy_anomaly_type"),
        F.col("confidence").alias("_label"),
        F.try_element_at("correlated_log_ids", F.lit(1)).alias("_root"),
        "summary",
    )
    found = F.col("_label").isNotNull()
    return (
        logs.join(f, "log_id", "left")
        .withColumns(
            {
                "is_anomaly": found,
                "anomaly_type": F.col("legacy_anomaly_type"),
                "anomaly_score": F.when(found, label_score(F.col("_label"))).otherwise(0.0),
                "root_cause_log_id": F.when(found, F.coalesce("_root", F.lit("n/a"))),
                "reason": F.col("summary"),
            }
        )
        .drop("_label", "_root", "legacy_anomaly_type", "summary")
    )
