"""Raw JSON records of both protocols -> one log schema. Projections only: no shuffle anywhere in this module.

Input: ``raw STRING`` (one JSON object) and ``arrival_seq BIGINT``. Rejected rows keep ``raw`` and a list of errors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from agentlog.functions import dictionaries as fixed
from agentlog.functions import jsontext as js
from agentlog.functions.lookups import blank, stripped
from agentlog.functions.plan import computed_once

def parse_raw(df: DataFrame) -> DataFrame:
    """Add ``v VARIANT`` (NULL for text that is not JSON) and ``is_object``."""
    return df.withColumn("v", F.try_parse_json("raw")).withColumn("is_object", js.is_object(F.col("v")))


def _present(*paths: str) -> Column:
    """All the paths exist; a JSON null counts as existing."""
    found = F.lit(True)
    for p in paths:
        found = found & js.variant_at(F.col("v"), p).isNotNull()
    return found


def _is_envelope() -> Column:
    return _present("$.session") & js.is_array(js.variant_at(F.col("v"), "$.logs"))


def detect_protocol(df: DataFrame) -> DataFrame:
    """Add ``protocol_in``: the stated protocol, else MCP by the shape of the record, else NULL."""
    stated = js.variant_at(F.col("v"), "$.protocol")
    shaped = _is_envelope() | _present("$.jsonrpc", "$.method", "$.params")
    return df.withColumn(
        "protocol_in",
        F.when(js.is_present(stated), js.text_of(stated)).when(shaped, F.lit(fixed.MCP)),
    )


def record_shape(df: DataFrame, strict: bool = False) -> DataFrame:
    """Add ``shape``: legacy, envelope, notification or a2a. The strict form does not know legacy records."""
    is_mcp = F.col("protocol_in") == fixed.MCP
    legacy = F.lit(False) if strict else _present(*["$." + k for k in fixed.LEGACY_KEYS])
    return df.withColumn(
        "shape",
        F.when(is_mcp & legacy, "legacy")
        .when(is_mcp & _is_envelope(), "envelope")
        .when(is_mcp, "notification")
        .when(F.col("protocol_in") == fixed.A2A, "a2a"),
    )


def unwrap_envelope(df: DataFrame) -> DataFrame:
    """Add ``body`` (the record to read), its JSON path prefix ``base``, and the label/id inherited from the envelope.

    An envelope stands for its last log only; an empty envelope has no body.
    """
    v = F.col("v")
    logs = js.variant_at(v, "$.logs")
    items = F.try_variant_get(v, "$.logs", "array<variant>")
    count = F.size(items)
    envelope = F.col("shape") == "envelope"
    last = F.when(js.is_array(logs) & (count > 0), F.element_at(items, -1))
    last_path = F.concat(F.lit("$.logs["), (count - 1).cast("string"), F.lit("]"))
    last_raw = F.call_function("get_json_object", F.col("raw"), last_path)
    return df.withColumn("body", F.when(envelope, last).otherwise(v)).withColumn(
        "body_raw", F.when(envelope, F.when(count > 0, last_raw)).otherwise(F.col("raw"))
    )


def _inherited(name: str) -> Column:
    """A key of the body, or of the envelope when the body lacks it."""
    own = js.variant_at(F.col("body"), "$." + name)
    outer = js.variant_at(F.col("v"), "$." + name)
    return F.when((F.col("shape") == "envelope") & own.isNull(), outer).otherwise(own)


def _status_of_legacy() -> Column:
    return F.lower(F.coalesce(js.text_of(js.variant_at(F.col("v"), "$.response_status")), F.lit("")))


def _legacy_kb() -> Column:
    tokens = F.coalesce(F.try_variant_get("v", "$.context_window_tokens", "double"), F.lit(0.0))
    # Multiples of 1/256 tie exactly at two places, hence half-even rounding.
    return F.bround(tokens * 4 / 1024, 2)


def _legacy_meta() -> Column:
    """Metadata object of a legacy record, as compact JSON text."""
    raw = F.col("raw")

    def member(name: str, path: str, default: str) -> Column:
        # Objects and numbers are copied as they are; strings are quoted again by to_json.
        v = js.variant_at(F.col("v"), path)
        text = (
            F.when(v.isNull(), F.lit(default))
            .when(~js.is_present(v), F.lit("null"))
            .when(js.is_string(v), F.regexp_extract(F.to_json(F.struct(v.cast("string").alias("x"))), r"^\{\"x\":(.*)\}$", 1))
            .otherwise(F.get_json_object(raw, path))
        )
        return F.concat(F.lit(f'"{name}":'), text)

    latency = js.int_or_zero(F.col("v"), "$.latency_ms")
    return F.concat(
        F.lit("{"),
        F.concat_ws(
            ",",
            member("tool", "$.tool_name", "null"),
            member("arguments", "$.tool_parameters", "{}"),
            member("triggered_by", "$.intent", "null"),
            F.concat(F.lit('"payload_size_kb":'), _legacy_kb().cast("string")),
            F.concat(F.lit('"latency_ms":'), latency.cast("string")),
            member("legacy_context_summary", "$.context_summary", '"n/a"'),
            member("legacy_response_payload", "$.response_payload", "{}"),
        ),
        F.lit("}"),
    )


def _for_protocol(protocol: str, *fields: Column) -> Column:
    """A struct that is only evaluated for rows of the protocol, NULL for the others."""
    return F.when(F.col("protocol_in") == protocol, F.struct(*fields))


def _string_at(v: Column, path: str) -> Column:
    """Text of a JSON string; NULL for anything else."""
    found = js.variant_at(v, path)
    return F.when(js.is_string(found), found.cast("string"))


def mcp_fields(df: DataFrame) -> DataFrame:
    """One struct ``m`` of MCP fields for notifications, envelopes and legacy records alike, and ``meta VARIANT``.

    Text fields that are not JSON strings are NULL, which validation reports.
    """
    v, body = F.col("v"), F.col("body")
    legacy = F.col("shape") == "legacy"
    envelope = F.col("shape") == "envelope"
    session = F.when(envelope, js.variant_at(v, "$.session")).otherwise(js.variant_at(body, "$.session"))

    def field(path: str, legacy_value: Column) -> Column:
        return F.when(legacy, legacy_value).otherwise(_string_at(body, path))

    def shown(path: str, missing: str) -> Column:
        return F.coalesce(js.text_of(js.variant_at(v, path)), F.lit(missing))

    level = F.when(_status_of_legacy().isin("error", "timeout"), "error").otherwise("info")
    meta_raw = F.when(legacy, _legacy_meta()).otherwise(js.json_at(F.col("body_raw"), "$.params.data.meta"))
    return df.withColumn(
        "m",
        _for_protocol(
            fixed.MCP,
            _inherited("log_id").alias("log_id"),
            _inherited("is_anomaly").alias("is_anomaly"),
            _inherited("anomaly_type").alias("anomaly_type"),
            session.alias("session"),
            F.when(legacy, shown("$.session_id", "None")).otherwise(_string_at(session, "$.id")).alias("session_id"),
            field("$.params.level", level).alias("level"),
            field("$.params.logger", shown("$.agent_id", "mcp-legacy-agent")).alias("logger"),
            F.when(legacy, js.variant_at(v, "$.timestamp"))
            .otherwise(js.variant_at(body, "$.params.data.timestamp"))
            .alias("timestamp"),
            field("$.params.data.event", F.lit("LEGACY_MCP_EVENT")).alias("event"),
            field("$.params.data.message", shown("$.reasoning_step", "")).alias("message"),
            js.variant_at(body, "$.params.data.meta").alias("meta_in"),
            meta_raw.alias("meta_raw"),
        ),
    ).withColumn("meta", F.when(F.col("m").isNotNull(), F.try_parse_json(F.coalesce(F.col("m.meta_raw"), F.lit("{}")))))


def _timestamp(v: Column) -> Column:
    text = v.cast("string")
    return F.when(js.is_string(v), F.try_to_timestamp(text)).when(
        js.is_number(v), F.timestamp_seconds(v.cast("double"))
    )


def _uuid(v: Column) -> Column:
    """Canonical lower-case form, NULL when the value is not a UUID."""
    bare = F.regexp_replace(F.lower(stripped(v.cast("string"))), r"^urn:uuid:|[{}-]", "")
    parts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    dashed = F.concat_ws("-", *[F.substring(bare, a, n) for a, n in parts])
    return F.when(js.is_string(v) & bare.rlike("^[0-9a-f]{32}$"), dashed)


def _generated_uuid() -> Column:
    """Repeatable id for records that may omit one."""
    digest = F.sha2(F.concat_ws("|", F.col("arrival_seq").cast("string"), F.col("raw")), 256)
    parts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(digest, a, n) for a, n in parts])


def _bool(v: Column) -> Column:
    return F.try_variant_get(v, "$", "boolean")


def _errors(*checks: tuple[Column, str]) -> Column:
    """Names of the failed checks; a check whose outcome is unknown has failed."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for ok, name in checks]))


def _absent(v: Column) -> Column:
    return v.isNull() | ~js.is_present(v)


def _label_ok(kind: Column, is_anomaly: Column) -> Column:
    known = js.is_string(kind) & kind.cast("string").isin(fixed.ANOMALY_TYPES)
    return _absent(kind) | (known & ~F.coalesce(_bool(is_anomaly) == F.lit(False), F.lit(False)))


def _keys_allowed(keys_of: Column, allowed: list[str], strict: bool) -> Column:
    extra = allowed if strict else allowed + ["ground_truth_label"]
    return F.size(F.array_except(F.json_object_keys(keys_of), F.array(*map(F.lit, extra)))) == 0


def _literal(v: Column, value: str) -> Column:
    return v.isNull() | (js.is_string(v) & (v.cast("string") == value))


def mcp_errors(strict: bool = False) -> Column:
    """Failed checks of an MCP row prepared by ``mcp_fields``."""
    m = lambda n: F.col("m." + n)
    body = F.col("body")
    legacy = F.col("shape") == "legacy"
    envelope = F.col("shape") == "envelope"
    at = lambda p: js.variant_at(body, p)
    filled = lambda text: ~blank(text)
    optional_text = lambda v: v.isNull() | js.is_string(v)
    session = m("session")
    id_optional = m("log_id").isNull() & ~legacy
    protocol = at("$.protocol")
    checks = (
        (F.col("body").isNotNull() & js.is_object(body), "record"),
        (legacy | _keys_allowed(F.col("body_raw"), fixed.MCP_KEYS, strict), "unknown key"),
        (id_optional | _uuid(m("log_id")).isNotNull(), "log_id"),
        (legacy | envelope & protocol.isNull() | _absent(protocol) | _literal(protocol, fixed.MCP), "protocol"),
        (legacy | js.is_object(session), "session"),
        (filled(m("session_id")), "session.id"),
        (
            legacy
            | (
                optional_text(js.variant_at(session, "$.host"))
                & optional_text(js.variant_at(session, "$.server"))
                & optional_text(js.variant_at(session, "$.transport"))
            ),
            "session fields",
        ),
        (
            F.when(legacy, _timestamp(m("timestamp")).isNotNull()).otherwise(
                _absent(js.variant_at(session, "$.connected_at"))
                | _timestamp(js.variant_at(session, "$.connected_at")).isNotNull()
            ),
            "session.connected_at",
        ),
        (legacy | _literal(at("$.jsonrpc"), "2.0"), "jsonrpc"),
        (legacy | _literal(at("$.method"), "notifications/message"), "method"),
        (m("level").isin(fixed.LEVELS), "params.level"),
        (filled(m("logger")), "params.logger"),
        (_timestamp(m("timestamp")).isNotNull(), "params.data.timestamp"),
        (filled(m("event")), "params.data.event"),
        (filled(m("message")), "params.data.message"),
        (legacy | m("meta_in").isNull() | js.is_object(m("meta_in")), "params.data.meta"),
        (_absent(m("is_anomaly")) | _bool(m("is_anomaly")).isNotNull(), "is_anomaly"),
        (_label_ok(m("anomaly_type"), m("is_anomaly")), "anomaly_type"),
    )
    return _errors(*checks)


def delegation_chain(source: Column, target: Column, depth: Column, chain: Column) -> Column:
    """The stated chain, or the one implied by source, target and depth when none is stated."""
    implied = F.when(depth == 0, F.array(source)).otherwise(F.array(source, target))
    return F.when(F.size(F.coalesce(chain, F.array().cast("array<string>"))) == 0, implied).otherwise(chain)


def a2a_fields(df: DataFrame) -> DataFrame:
    """One struct ``a`` of A2A fields."""
    v = F.col("v")
    at = lambda n: js.variant_at(v, "$." + n)
    text = lambda n: _string_at(v, "$." + n)
    depth_in = at("delegation_depth")
    depth = F.when(depth_in.isNull(), F.lit(0).cast("bigint")).otherwise(
        F.try_variant_get(v, "$.delegation_depth", "bigint")
    )
    stated = F.try_variant_get(v, "$.delegation_chain", "array<string>")
    return df.withColumn(
        "a",
        _for_protocol(
            fixed.A2A,
            at("log_id").alias("log_id"),
            at("session_id").alias("session_id"),
            at("timestamp").alias("timestamp"),
            text("source_agent").alias("source_agent"),
            text("target_agent").alias("target_agent"),
            depth.alias("delegation_depth"),
            at("delegation_chain").alias("chain_in"),
            delegation_chain(text("source_agent"), text("target_agent"), depth, stated).alias("delegation_chain"),
            text("message_type").alias("message_type"),
            text("message_content").alias("message_content"),
            text("task_intent").alias("task_intent"),
            at("context_carried").alias("context_in"),
            F.coalesce(js.json_at(F.col("raw"), "$.context_carried"), F.lit("{}")).alias("context_carried"),
            text("response_status").alias("response_status"),
            at("response_content").alias("response_in"),
            F.coalesce(text("response_content"), F.lit("")).alias("response_content"),
            F.try_variant_get(v, "$.latency_ms", "bigint").alias("latency_ms"),
            at("is_anomaly").alias("is_anomaly"),
            at("anomaly_type").alias("anomaly_type"),
        ),
    )


def a2a_errors(strict: bool = False) -> Column:
    """Failed checks of an A2A row prepared by ``a2a_fields``."""
    a = lambda n: F.col("a." + n)
    filled = lambda n: ~blank(a(n))
    checks = (
        (F.col("is_object"), "record"),
        (_keys_allowed(F.col("raw"), fixed.A2A_KEYS, strict), "unknown key"),
        (_uuid(a("log_id")).isNotNull(), "log_id"),
        (_uuid(a("session_id")).isNotNull(), "session_id"),
        (_timestamp(a("timestamp")).isNotNull(), "timestamp"),
        (filled("source_agent"), "source_agent"),
        (filled("target_agent"), "target_agent"),
        (filled("message_content"), "message_content"),
        (filled("task_intent"), "task_intent"),
        (a("delegation_depth").between(0, fixed.MAX_DELEGATION_DEPTH), "delegation_depth"),
        (a("chain_in").isNull() | js.is_array(a("chain_in")), "delegation_chain"),
        (F.size(a("delegation_chain")) == a("delegation_depth") + 1, "delegation_chain length"),
        (a("message_type").isin(fixed.MESSAGE_TYPES), "message_type"),
        (a("context_in").isNull() | js.is_object(a("context_in")), "context_carried"),
        (a("response_status").isin(fixed.RESPONSE_STATUSES), "response_status"),
        (a("response_in").isNull() | js.is_string(a("response_in")), "response_content"),
        (a("latency_ms") >= 0, "latency_ms"),
        (_absent(a("is_anomaly")) | _bool(a("is_anomaly")).isNotNull(), "is_anomaly"),
        (_label_ok(a("anomaly_type"), a("is_anomaly")), "anomaly_type"),
    )
    return _errors(*checks)


def _meta_text(name: str) -> Column:
    """A metadata field as trimmed text, empty when missing."""
    return stripped(F.coalesce(js.text_of(js.variant_at(F.col("meta"), "$." + name)), F.lit("")))


def response_status(level: Column, event: Column, meta: Column) -> Column:
    """success, error (by level or by an integer status of 400 or more), or timeout, which wins."""
    status = js.variant_at(meta, "$.status")
    failed = js.is_integer(status) & (F.try_variant_get(meta, "$.status", "bigint") >= 400)
    timed_out = js.variant_at(meta, "$.timeout_ms").isNotNull() & event.endswith("TIMEOUT")
    return F.when(timed_out, "timeout").when((level == "error") | failed, "error").otherwise("success")


def context_summary(message: Column, triggered_by: Column, recommendation: Column) -> Column:
    """The non-empty parts joined, or n/a."""
    joined = stripped(F.concat_ws(" | ", *[F.nullif(c, F.lit("")) for c in (message, triggered_by, recommendation)]))
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit("n/a"))


def extract_mcp(df: DataFrame) -> DataFrame:
    """Add struct ``f`` of the flattened MCP features to rows with ``m`` and ``meta``."""
    meta = F.col("meta")
    # Texts that several features share are a column of their own, so that each is read from the record once.
    texts = _for_protocol(
        fixed.MCP,
        stripped("m.event").alias("event"),
        stripped("m.message").alias("message"),
        _meta_text("tool").alias("tool"),
        _meta_text("triggered_by").alias("triggered_by"),
        _meta_text("recommendation").alias("recommendation"),
    )
    event, message, level = F.col("t.event"), F.col("t.message"), F.col("m.level")
    triggered_by = F.col("t.triggered_by")
    latency = js.variant_at(meta, "$.latency_ms")
    kb = js.variant_at(meta, "$.payload_size_kb")
    tokens = F.when(js.is_number(kb), (kb.cast("double") * 1024 / 4).cast("bigint"))
    arguments = js.variant_at(meta, "$.arguments")
    whole = F.when(js.is_integer(latency), latency.cast("bigint"))
    features = {
        "tool_name": F.col("t.tool"),
        "tool_parameters": F.when(js.is_object(arguments), js.json_at(F.col("m.meta_raw"), "$.arguments")).otherwise("{}"),
        "reasoning_step": message,
        "intent": F.coalesce(F.nullif(triggered_by, F.lit("")), event),
        "context_window_tokens": F.greatest(F.coalesce(tokens, F.lit(0)), F.lit(0)).cast("bigint"),
        "context_summary": context_summary(message, triggered_by, F.col("t.recommendation")),
        "response_status": response_status(level, event, meta),
        "response_payload": F.coalesce(F.col("m.meta_raw"), F.lit("{}")),
        "latency_ms": F.greatest(F.coalesce(whole, F.lit(0)), F.lit(0)).cast("bigint"),
        "event": event,
        "logger": F.col("m.logger"),
        "level": level,
    }
    rows = df.withColumn("t", texts)
    return rows.withColumn("f", _for_protocol(fixed.MCP, *[c.alias(n) for n, c in features.items()]))


def _joined(*names: str) -> Column:
    parts = [F.coalesce(F.col(n), F.lit("")) for n in names]
    return F.concat(*[x for p in parts for x in (F.lit(" | "), p)][1:])


def mcp_text() -> Column:
    """Text to vectorise for MCP rows; empty parts keep their separators."""
    return _joined("reasoning_step", "intent", "tool_name", "context_summary")


def a2a_text() -> Column:
    """Text to vectorise for A2A rows."""
    return _joined("message_content", "task_intent", "target_agent")


# The columns of a normalized log; absent ones are NULL (the other protocol's fields).
LOG_COLUMNS = {
    "log_id": "string", "session_id": "string", "ts": "timestamp", "protocol": "string", "agent_id": "string",
    "text_for_embedding": "string", "arrival_seq": "bigint",
    "tool_name": "string", "tool_parameters": "string", "reasoning_step": "string", "intent": "string",
    "context_window_tokens": "bigint", "context_summary": "string", "response_status": "string",
    "response_payload": "string", "latency_ms": "bigint", "event": "string", "logger": "string", "level": "string",
    "source_agent": "string", "target_agent": "string", "delegation_depth": "bigint",
    "delegation_chain": "array<string>", "message_type": "string", "message_content": "string",
    "task_intent": "string", "context_carried": "string", "response_content": "string",
    "is_anomaly_label": "boolean", "anomaly_type_label": "string",
}


def as_logs(df: DataFrame) -> DataFrame:
    """Bring any frame with some of the log columns to the full log schema."""
    have = set(df.columns)
    return df.select(
        *[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in LOG_COLUMNS.items()]
    )


def _prepared(df: DataFrame, strict: bool) -> DataFrame:
    return unwrap_envelope(record_shape(detect_protocol(parse_raw(df)), strict))


def _all_errors(strict: bool) -> Column:
    """Failed checks of a row of either protocol, prepared by ``mcp_fields`` and ``a2a_fields``."""
    protocol = F.col("protocol_in")
    no_protocol = F.when(F.col("is_object"), "protocol").otherwise("not a JSON object")
    by_mcp = F.when(protocol == fixed.MCP, mcp_errors(strict))
    return by_mcp.when(protocol == fixed.A2A, a2a_errors(strict)).otherwise(F.array(no_protocol))


def check_all(df: DataFrame, strict: bool = False) -> DataFrame:
    """Every input row as (arrival_seq, raw, protocol, errors) with the values of ``normalize_all``, whose other columns cost
    as much again."""
    rows = a2a_fields(mcp_fields(_prepared(df, strict)))
    known = F.when(F.col("protocol_in").isin(fixed.MCP, fixed.A2A), F.col("protocol_in"))
    return computed_once(rows.select("arrival_seq", "raw", known.alias("protocol"), _all_errors(strict).alias("errors")))


def normalize_all(df: DataFrame, strict: bool = False, carry: list[str] | None = None) -> DataFrame:
    """Every input row with the log columns, ``raw``, ``protocol_in`` and ``errors``, in one pass over the input.

    ``carry`` names further input columns to keep.
    """
    rows = extract_mcp(a2a_fields(mcp_fields(_prepared(df, strict))))
    protocol = F.col("protocol_in")
    is_mcp, is_a2a = protocol == fixed.MCP, protocol == fixed.A2A
    rows = rows.withColumn("errors", _all_errors(strict))

    def either(mcp: Column, a2a: Column) -> Column:
        return F.when(is_mcp, mcp).when(is_a2a, a2a)

    label = either(F.col("m.anomaly_type"), F.col("a.anomaly_type"))
    columns = {
        "log_id": either(F.coalesce(_uuid(F.col("m.log_id")), _generated_uuid()), _uuid(F.col("a.log_id"))),
        "session_id": either(F.col("m.session_id"), _uuid(F.col("a.session_id"))),
        "ts": _timestamp(either(F.col("m.timestamp"), F.col("a.timestamp"))),
        "protocol": F.when(is_mcp | is_a2a, protocol),
        "agent_id": either(F.col("m.logger"), F.col("a.source_agent")),
        "response_status": either(F.col("f.response_status"), F.col("a.response_status")),
        "latency_ms": either(F.col("f.latency_ms"), F.col("a.latency_ms")),
        "is_anomaly_label": _bool(either(F.col("m.is_anomaly"), F.col("a.is_anomaly"))),
        "anomaly_type_label": F.when(js.is_string(label), label.cast("string")),
    }
    for n in (
        "tool_name", "tool_parameters", "reasoning_step", "intent", "context_window_tokens", "context_summary",
        "response_payload", "event", "logger", "level",
    ):
        columns[n] = F.col("f." + n)
    for n in (
        "source_agent", "target_agent", "delegation_depth", "delegation_chain", "message_type", "message_content",
        "task_intent", "context_carried", "response_content",
    ):
        columns[n] = F.col("a." + n)
    extra = ["raw", "protocol_in", "errors", *(carry or [])]
    keep = ["arrival_seq", *extra]
    flat = rows.select(*keep, *[c.alias(n) for n, c in columns.items()])
    full = flat.withColumn("text_for_embedding", F.when(is_mcp, mcp_text()).when(is_a2a, a2a_text()))
    return computed_once(full.select(*[F.col(c).cast(t).alias(c) for c, t in LOG_COLUMNS.items()], *extra))


def normalize(df: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(logs, rejected). Write both from one scan, or write the logs and build everything else on that table."""
    checked = normalize_all(df, strict)
    logs = checked.where(F.size("errors") == 0)
    rejected = checked.where(F.size("errors") > 0).select("arrival_seq", "raw", "protocol_in", "errors")
    return as_logs(logs), rejected


def failing_rows(df: DataFrame, path: str, by: str = "source", strict: bool = True) -> tuple[DataFrame, dict[str, int]]:
    """(failing rows, totals) from one scan: rows that don't fit the schema are written to ``path`` as (``by``, arrival_seq,
    raw, errors) while ``total`` and ``failures`` are counted."""
    counts = Observation()
    checked = normalize_all(df, strict, carry=[by])
    bad = F.size("errors") > 0
    seen = checked.observe(counts, F.count(F.lit(1)).alias("total"), F.count_if(bad).alias("failures"))
    seen.where(bad).select(by, "arrival_seq", "raw", "errors").write.parquet(path)
    return df.sparkSession.read.parquet(path), dict(counts.get)


def validation_report(df: DataFrame, by: str = "source", strict: bool = True, samples: int | None = None) -> DataFrame:
    """Rows and failures per source. With ``samples``, only the first rows of each source are looked at."""
    rows = df
    if samples is not None:
        from agentlog.operators.sampling import top_n

        rows = top_n(df, by, [F.col("arrival_seq")], samples)
    tagged = normalize_all(rows, strict, carry=[by])
    return tagged.groupBy(by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.size("errors") > 0).alias("failures")
    )
