"""Per-row signals, noise, confidence and promotion. Projections only.

``signal_rows`` reads normalized logs; ``row_signals`` evaluates everything that needs no other row and keeps only the
narrow columns the session step needs, so that message and metadata text never travel through the session shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentlog.config import DEFAULT, Settings
from agentlog.functions import dictionaries as fixed
from agentlog.functions import jsontext as js
from agentlog.functions.lookups import any_contains, folded, lookup, nonblank_or, recommended_action, search, stripped
from agentlog.functions.repeats import repeats_three_times


def signal_rows(logs: DataFrame) -> DataFrame:
    """MCP rows with upper-case event, lower-case level, tool, request id, metadata numbers and text."""
    meta = F.coalesce(F.col("response_payload"), F.lit("{}"))
    rows = logs.where(F.col("protocol") == fixed.MCP).select(
        "log_id",
        "session_id",
        "ts",
        "arrival_seq",
        F.upper(F.coalesce("event", F.lit(""))).alias("event"),
        F.lower(nonblank_or(F.col("level"), F.lit("info"))).alias("level"),
        F.coalesce("reasoning_step", F.lit("")).alias("message"),
        F.col("tool_name"),
        meta.alias("meta_raw"),
        F.try_parse_json(meta).alias("meta"),
    )
    m = F.col("meta")
    tool_in_meta = js.variant_at(m, "$.tool")
    request = js.variant_at(m, "$.request_id")
    # Zero, false and empty ids count as no id.
    request_text = js.text_of(request)
    has_request = js.is_present(request) & ~request_text.isin("", "0", "0.0", "False", "{}", "[]")
    args = js.variant_at(m, "$.args")
    arguments = js.variant_at(m, "$.arguments")
    chosen = F.when(js.is_object(args), js.json_at(F.col("meta_raw"), "$.args")).when(
        js.is_object(arguments), js.json_at(F.col("meta_raw"), "$.arguments")
    )
    tool = F.when(js.is_present(tool_in_meta), js.text_of(tool_in_meta)).otherwise("")
    return rows.select(
        "log_id",
        "session_id",
        "ts",
        "arrival_seq",
        "event",
        "level",
        "message",
        stripped(nonblank_or(F.col("tool_name"), tool, F.lit(""))).alias("tool"),
        F.when(has_request, request_text).otherwise("").alias("request_id"),
        js.int_or_zero(m, "$.http_status").alias("http_status"),
        js.int_or_zero(m, "$.used").alias("used"),
        js.int_or_zero(m, "$.limit").alias("limit"),
        js.int_or_zero(m, "$.elapsed_ms").alias("elapsed_ms"),
        js.json_text(F.col("meta_raw")).alias("meta_text"),
        chosen.alias("args_raw"),
        F.try_parse_json(chosen).alias("args"),
    )


def _share(limit: Column, share: float) -> Column:
    """A share of a limit, fraction cut."""
    return (F.lit(share) * limit).cast("bigint")


def near_limit(used: Column, limit: Column, share: float) -> Column:
    return (limit > 0) & (used >= _share(limit, share))


# --- signal 1 ---------------------------------------------------------------------------------------------------------


def signal_event(event: Column) -> tuple[Column, Column]:
    """(subtype, synthetic flag) by event name."""
    synthetic = event.isin(fixed.ANOMALY_TYPES)
    subtype = F.when(synthetic, fixed.SYNTHETIC_SUBTYPE).otherwise(lookup(event, fixed.EVENT_SUBTYPES))
    return subtype, synthetic


# --- signal 3 ---------------------------------------------------------------------------------------------------------


def rule_text(message: Column, meta_text: Column, event: Column) -> Column:
    """The three searched texts as one folded text.

    The separator stops every pattern: ``.`` cannot pass the line feed, ``\\s`` and ``\\D`` cannot pass the digit.
    """
    return folded(F.concat(message, F.lit("\n0\n"), meta_text, F.lit("\n0\n"), event))


def rule_matches(text: Column, event: Column) -> Column:
    """All text rules that match ``rule_text``, in rule order, as ARRAY<STRUCT<rule_id, subtype>>."""

    def rule(rule_id: str, pattern: str, subtype: str, vetoed: list[str]) -> Column:
        hit = search(text, pattern)
        if vetoed:
            hit = hit & ~event.isin(vetoed)
        return F.when(hit, F.struct(F.lit(rule_id).alias("rule_id"), F.lit(subtype).alias("subtype")))

    return F.array_compact(F.array(*[rule(*r) for r in fixed.TEXT_RULES]))


# --- signal 4 ---------------------------------------------------------------------------------------------------------


def signal_args(tool: Column, args_raw: Column, args: Column) -> Column:
    """Subtype suggested by the call arguments, NULL when there is none. First check that applies wins."""

    def value(name: str) -> Column:
        return F.coalesce(js.text_of(js.variant_at(args, "$." + name)), F.lit(""))

    args_text = F.lower(js.json_text(args_raw))
    file_key = F.lower(value("file_key"))
    node_id = value("node_id")
    over = lambda v: js.is_string(v) & (F.length(v.cast("string")) > fixed.LONG_ARGUMENT_CHARS)
    long_value = (F.length(args_raw) > fixed.LONG_ARGUMENT_CHARS) & F.exists(
        F.map_values(args.cast("map<string,variant>")), lambda v: F.coalesce(over(v), F.lit(False))
    )
    # The shortest text that can repeat a block of eight three times has 24 characters plus braces.
    repeated = (F.length(args_text) >= 26) & repeats_three_times(args_text, fixed.REPEAT_PATTERN)
    return F.when(
        args_raw.isNotNull() & (args_raw != "{}"),
        F.coalesce(
            F.when(any_contains(file_key, fixed.FILE_KEY_TOKENS), "prompt_injection_attempt"),
            F.when(
                (tool == "post_comment") & search(folded(value("message")), fixed.COMMENT_PATTERN), "prompt_injection_attempt"
            ),
            F.when(
                (tool == "get_node") & (node_id != "") & ~node_id.rlike(fixed.NODE_ID_PATTERN), "input_anomaly"
            ),
            F.when(long_value, "input_anomaly"),
            F.when(repeated, "input_anomaly"),
            F.when(search(folded(args_text), fixed.ARGUMENT_PATTERN), "prompt_injection_attempt"),
        ),
    )


# --- noise and codes --------------------------------------------------------------------------------------------------


def is_noise(event: Column, level: Column, used: Column, limit: Column, elapsed_ms: Column) -> Column:
    """Routine rows: their signals are dropped unless a subtype that always escalates is involved."""
    calm_check = (event == "RATE_LIMIT_CHECK") & (limit > 0) & (used < _share(limit, 0.8))
    fast_enough = (event == "FIGMA_API_SLOW") & (elapsed_ms < fixed.SLOW_NOISE_MS)
    return event.isin(fixed.ROUTINE_EVENTS) | calm_check | fast_enough | (level == "debug")


def escalates(matches: Column, subtype: Column) -> Column:
    by_rule = F.exists(matches, lambda m: m.subtype.isin(fixed.ESCALATE_SUBTYPES))
    return by_rule | F.coalesce(subtype.isin(fixed.ESCALATE_SUBTYPES), F.lit(False))


def has_error_code(message: Column, meta_text: Column) -> Column:
    return search(folded(F.concat(message, meta_text)), fixed.ERROR_CODE_PATTERN)


# --- row step of the analysis -----------------------------------------------------------------------------------------

# A scorer takes rows with a ``ml_text`` column and adds ``ml_score DOUBLE`` and ``ml_label STRING``.
Scorer = Callable[[DataFrame], DataFrame]


def with_scores(rows: DataFrame, cfg: Settings = DEFAULT, scorer: Scorer | None = None) -> DataFrame:
    """Add ``ml_score`` and ``ml_label``: from the scorer when one is given and not switched off, else NULL."""
    if scorer is None or cfg.ml_killswitch:
        return rows.withColumns({"ml_score": F.lit(None).cast("double"), "ml_label": F.lit(None).cast("string")})
    text = F.concat(
        F.lit("event="), F.col("event"), F.lit(" message="), F.col("message"), F.lit(" meta="), F.col("meta_text")
    )
    return scorer(rows.withColumn("ml_text", text)).drop("ml_text")


def row_signals(rows: DataFrame, cfg: Settings = DEFAULT, scorer: Scorer | None = None) -> DataFrame:
    """Signals 1, 3 and 4, noise and text of each row; wide text is reduced to what a finding shows."""
    event, message, meta_text = F.col("event"), F.col("message"), F.col("meta_text")
    by_event, synthetic = signal_event(event)
    # The searched text is a column of its own, so that it is built once and not once per rule.
    scored = with_scores(rows, cfg, scorer).withColumn("text", rule_text(message, meta_text, event))
    matched = scored.withColumns(
        {
            "matches": rule_matches(F.col("text"), event),
            "by_event": by_event,
            "by_args": signal_args(F.col("tool"), F.col("args_raw"), F.col("args")),
            "by_score": F.when(F.col("ml_score") >= cfg.ml_promotion_threshold, F.col("ml_label")),
        }
    )
    first = F.try_element_at("matches", F.lit(1))["subtype"]
    staged = matched.withColumn("subtype", F.coalesce("by_event", first, "by_args", "by_score"))
    noise = is_noise(event, F.col("level"), F.col("used"), F.col("limit"), F.col("elapsed_ms"))
    cleared = noise & ~escalates(F.col("matches"), F.col("subtype"))
    kept = staged.withColumn("cleared", cleared)
    keep = lambda c: c & ~F.col("cleared")
    return kept.select(
        "log_id",
        "session_id",
        "ts",
        "arrival_seq",
        "event",
        "level",
        "tool",
        "request_id",
        "http_status",
        "used",
        "limit",
        F.when(~F.col("cleared"), F.col("subtype")).alias("subtype"),
        keep(F.col("by_event").isNotNull()).alias("s1"),
        keep(F.size("matches") > 0).alias("s3"),
        keep(F.col("by_args").isNotNull() | F.col("by_score").isNotNull()).alias("s4"),
        "cleared",
        synthetic.alias("synthetic"),
        has_error_code(message, meta_text).alias("has_code"),
        "ml_score",
        "ml_label",
        finding_detail(message, meta_text).alias("detail"),
    )


# --- confidence, texts, promotion -------------------------------------------------------------------------------------


def confidence(
    s1: Column, s2: Column, s3: Column, s4: Column, level: Column, warned: Column, has_code: Column
) -> Column:
    high = (s1 & s2) | (s3 & has_code)
    medium = (s2 & (level == "error")) | warned | (s4 & s3)
    return F.when(high, "high").when(medium, "medium").otherwise("low")


def final_confidence(base: Column, subtype: Column, source: Column, ml_score: Column) -> Column:
    """Overrides: some subtypes are always high, agreement lifts low, score-only findings go by their score."""
    by_score = F.when(F.coalesce(ml_score, F.lit(0.0)) < 0.92, "medium").otherwise("high")
    fixed_high = F.when(subtype.isin(fixed.ALWAYS_HIGH_SUBTYPES), "high").otherwise(base)
    lifted = F.when((source == "rule_ml") & (fixed_high == "low"), "medium").otherwise(fixed_high)
    return F.when(source == "ml_only", by_score).otherwise(lifted)


def finding_summary(subtype: Column, event: Column) -> Column:
    return F.concat(F.replace(subtype, F.lit("_"), F.lit(" ")), F.lit(" detected for event "), event, F.lit("."))


def finding_detail(message: Column, meta_text: Column) -> Column:
    return F.concat(
        F.lit("message="), F.substring(message, 1, 220), F.lit(" | meta="), F.substring(meta_text, 1, 240)
    )


def promotion(
    rule_hit: Column, ml_hit: Column, ml_score: Column, subtype: Column, cfg: Settings = DEFAULT
) -> tuple[Column, Column]:
    """(reported, source tag) under the configured policy."""
    known = subtype.isNotNull()
    rule_only = F.lit("rule_only")
    if not cfg.hybrid_enabled:
        return (rule_hit | ml_hit) & known, rule_only
    if cfg.hybrid_phase <= 2:
        return rule_hit & known, rule_only
    by_rule = F.when(rule_hit & ml_hit, "rule_ml").when(rule_hit, "rule_only")
    if cfg.hybrid_phase == 3:
        return rule_hit & known, F.coalesce(by_rule, F.lit("ml_review_queue"))
    alone = ~rule_hit & ml_hit & F.coalesce(ml_score >= cfg.ml_promotion_threshold, F.lit(False))
    source = F.coalesce(by_rule, F.when(alone, "ml_only"), F.lit("ml_review_queue"))
    return (rule_hit | alone) & known, source
