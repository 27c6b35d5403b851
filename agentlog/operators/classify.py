"""Rule classification, explanation text and intent/outcome scores. Projections only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentlog.functions import dictionaries as fixed
from agentlog.functions import jsontext as js
from agentlog.functions.lookups import any_contains, dup_ngram_ratio, intent_domain, nonblank_or, stripped, tool_domain

_HALLUCINATION, _POISONING, _OVERFLOW, _DELEGATION = fixed.ANOMALY_TYPES


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _truthy(v: Column) -> Column:
    """A JSON value that is not null, false, zero or empty."""
    empty = v.cast("string").isin("false", "0", "0.0", "", "{}", "[]")
    return js.is_present(v) & ~F.coalesce(empty, F.lit(False))


def classify_rules() -> Column:
    """Anomaly type by the first rule that applies, NULL when none does. Reads the columns of a normalized log."""
    is_mcp = F.col("protocol") == fixed.MCP
    tool, status = stripped(_text("tool_name")), F.lower(_text("response_status"))
    event, level = F.upper(_text("event")), F.lower(_text("level"))
    payload = F.when(is_mcp, F.coalesce("response_payload", F.lit("{}"))).otherwise("{}")
    meta = F.try_parse_json(payload)
    combined = F.concat_ws(
        " ", F.lower(event), level, F.lower(_text("reasoning_step")), F.lower(js.json_text(payload))
    )
    by_text = F.coalesce(*[F.when(any_contains(combined, t), kind) for kind, t in fixed.CLASSIFIER_TOKENS.items()])
    known = tool.isin(list(fixed.TOOL_DOMAIN))
    parameters = F.json_object_keys(F.coalesce("tool_parameters", F.lit("{}")))
    fake_parameter = F.coalesce(
        F.exists(parameters, lambda k: k.rlike("(?iu)" + fixed.FAKE_PARAMETER_PATTERN)), F.lit(False)
    )
    used, limit = js.int_or_zero(meta, "$.requests_used"), js.int_or_zero(meta, "$.requests_limit")
    carried = F.coalesce("context_carried", F.lit("{}"))
    # Escaping and spacing lengthen a text at most sixfold, so short ones need no rewriting.
    heavy_context = (F.length(carried) * 6 > 5000) & (F.length(js.json_text(carried)) > 5000)
    poisoned = (
        (F.coalesce("context_window_tokens", F.lit(0)) > 12_000)
        | (dup_ngram_ratio(_text("context_summary")) > 0.3)
        | (status.isin("partial", "success") & (payload == "{}"))
        | heavy_context
        | (event.contains("RATE_LIMIT") & (limit > 0) & (used >= (F.lit(0.6) * limit).cast("bigint")))
        | F.coalesce(_truthy(js.variant_at(meta, "$.truncated")), F.lit(False))
    )
    broken = (
        ((status == "error") & any_contains(F.lower(tool), ["delegation", "subagent", "delegate"]))
        | ((F.coalesce("delegation_depth", F.lit(0)) >= 3) & (status == "error"))
        | (status.isin("error", "timeout") & any_contains(event, ["TIMEOUT", "FAIL", "ERROR"]))
        | ((level == "error") & event.contains("TOOL_CALL"))
    )
    wanted = intent_domain(F.coalesce("intent", "task_intent", F.lit("")), fixed.CLASSIFIER_HINTS)
    return F.coalesce(
        F.when(is_mcp & event.isin(fixed.ANOMALY_TYPES), event),
        F.when(is_mcp, by_text),
        F.when((tool != "") & ~known, _HALLUCINATION),
        F.when(fake_parameter, _HALLUCINATION),
        F.when(poisoned, _POISONING),
        F.when(broken, _DELEGATION),
        F.when(known & (tool_domain(tool) != wanted), _OVERFLOW),
    )


def classify(df: DataFrame) -> DataFrame:
    """Add ``classification`` STRUCT<anomaly_type, confidence, method, reasoning> to detected logs."""
    rows = df.withColumn("_rule", F.when(F.col("is_anomaly"), classify_rules()))
    rule = F.col("_rule")

    def outcome(kind: Column, confidence: float, method: str, reasoning: str) -> Column:
        return F.struct(
            kind.cast("string").alias("anomaly_type"),
            F.lit(confidence).alias("confidence"),
            F.lit(method).alias("method"),
            F.lit(reasoning).alias("reasoning"),
        )

    # Confidences, method names and reasons of the four outcomes.
    none = F.lit(None)
    chosen = (
        F.when(~F.col("is_anomaly"), outcome(none, 1.0, "none", "Not anomalous"))
        .when(rule.isNotNull(), outcome(rule, 0.85, "rule", "Rule match"))
        .when(
            F.col("protocol") == fixed.MCP,
            outcome(none, 0.70, "rule", "No explicit MCP anomaly signature matched"),
        )
        .otherwise(
            outcome(none, 0.50, "llm", "LLM API key unavailable; no deterministic fallback label matched.")
        )
    )
    return rows.withColumn("classification", chosen).drop("_rule")


def first_words(text: Column, n: int = 200) -> Column:
    """The text itself, or its first n words when it has more."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.when(F.size(words) > n, F.array_join(F.slice(words, 1, n), " ")).otherwise(text)


def explain(kind: Column, score: Column, root: Column, confidence: Column) -> Column:
    """Explanation text of an anomaly."""
    text = F.concat(
        F.lit("Detected "),
        F.coalesce(kind, F.lit("None")),
        F.lit(" with anomaly score "),
        F.format_string("%.3f", score),
        F.lit(". Likely root cause log is "),
        root,
        F.lit("."),
    )
    return F.when(
        confidence <= 0.7, "Confidence below explanation threshold; skipping LLM explanation."
    ).otherwise(first_words(text))


def intent_outcome(df: DataFrame) -> DataFrame:
    """Add ``gap_score``, ``coherence_score``, ``intent_domain`` and ``action_domain``."""
    intent = nonblank_or(F.col("intent"), F.col("task_intent"), F.col("event"), F.lit(""))
    tool = _text("tool_name")
    rows = df.withColumns(
        {"intent_domain": intent_domain(intent, fixed.OUTCOME_HINTS), "action_domain": tool_domain(tool)}
    )
    wanted, done = F.col("intent_domain"), F.col("action_domain")
    gap = (
        F.when(wanted.isNotNull() & done.isNotNull(), F.when(wanted == done, 0.1).otherwise(0.85))
        .when(tool != "", 0.55)
        .otherwise(0.4)
    )
    failed = F.lower(_text("response_status")).isin("error", "timeout")
    gap = F.least(F.lit(1.0), gap + F.when(failed, 0.15).otherwise(0.0))
    gap = F.least(F.lit(1.0), gap + F.when(F.coalesce("is_anomaly_label", F.lit(False)), 0.1).otherwise(0.0))
    return rows.withColumn("_gap", gap).withColumns(
        {"gap_score": F.bround("_gap", 4), "coherence_score": F.bround(F.lit(1.0) - F.col("_gap"), 4)}
    ).drop("_gap")


def cause_key(kind: Column, tool: Column, event: Column, reason: Column, default: str = "rule_match") -> Column:
    """Text that groups anomalies of the same cause."""
    tag = F.when(F.length(reason) > 80, F.concat(F.substring(reason, 1, 80), F.lit("..."))).otherwise(reason)
    parts = [(kind, "UNKNOWN"), (tool, "n/a"), (event, "n/a"), (tag, default)]
    return F.concat_ws(" | ", *[nonblank_or(c, F.lit(d)) for c, d in parts])


def raw_preview(df: DataFrame) -> DataFrame:
    """Session, tool or target, and event or message type of raw records of either protocol."""
    v = F.try_parse_json("raw")
    text = lambda path: F.coalesce(js.text_of(js.variant_at(F.col("_v"), path)), F.lit(""))
    is_mcp = text("$.protocol") == fixed.MCP
    either = lambda mcp, a2a: F.when(is_mcp, text(mcp)).otherwise(text(a2a))
    return (
        df.withColumn("_v", v)
        .withColumns(
            {
                "protocol": text("$.protocol"),
                "session_id": either("$.session.id", "$.session_id"),
                "tool_or_target": either("$.params.data.meta.tool", "$.target_agent"),
                "event_or_type": either("$.params.data.event", "$.message_type"),
                "log_id": text("$.log_id"),
            }
        )
        .drop("_v")
    )


def filter_group(
    df: DataFrame,
    protocols: list[str] | None = None,
    sessions: list[str] | None = None,
    row_range: tuple[int, int] | None = None,
    row_col: str = "arrival_seq",
) -> DataFrame:
    """Rows of the given protocols, sessions and row range; an empty choice does not filter."""
    if protocols:
        df = df.where(F.col("protocol").isin(protocols))
    if sessions:
        df = df.where(F.col("session_id").isin(sessions))
    if row_range:
        df = df.where(F.col(row_col).between(*row_range))
    return df
