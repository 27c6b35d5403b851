"""DuckDB statements that compute what the registered queries compute, straight from the tables."""

from __future__ import annotations

from agentlog.functions import dictionaries as fixed
from agentlog.plans import fromtables as ft


def _s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return ", ".join(_s(v) for v in values)


def _array(values) -> str:
    return "[" + _list(values) + "]"


def _case_map(expr: str, table: dict, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {_s(k)} THEN {_s(v) if isinstance(v, str) else v}" for k, v in table.items())
    return f"CASE {expr} {whens} ELSE {default} END"


def _contains_any(expr: str, tokens) -> str:
    return "(" + " OR ".join(f"contains({expr}, {_s(t)})" for t in tokens) + ")"


def _domain(expr: str, hints: dict) -> str:
    whens = " ".join(f"WHEN {_contains_any(f'lower({expr})', tokens)} THEN {_s(d)}" for d, tokens in hints.items())
    return f"CASE {whens} END"


def _spaced(compact: str) -> str:
    return compact.replace('":', '": ').replace(',"', ', "')


def chain(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


EV = f"""
ev AS (
  SELECT event_id, user_id, value, event_type AS kind, CAST(props->>'$.k' AS INTEGER) AS k,
         epoch_us(ts) - {ft.EPOCH_US} AS off
  FROM events),
ev2 AS (
  SELECT *, CASE kind
      WHEN 'click' THEN 'TOOL_CALL_RECEIVED' WHEN 'purchase' THEN 'RATE_LIMIT_WARN' WHEN 'signup' THEN 'TOOL_CALL_RETRY'
      WHEN 'view' THEN CASE k % 10 WHEN 0 THEN 'HEARTBEAT' WHEN 1 THEN 'RATE_LIMIT_CHECK' WHEN 2 THEN 'FIGMA_API_SLOW'
                            WHEN 3 THEN 'CLEANUP' WHEN 4 THEN 'FIGMA_API_WARN' ELSE 'TOOL_CALL_SUCCESS' END
      ELSE CASE k % 8 WHEN 4 THEN 'TOOL_CALL_ERROR' WHEN 5 THEN 'UNKNOWN_TOOL' WHEN 6 THEN 'SCHEMA_VALIDATION_ERROR'
                      WHEN 7 THEN CASE WHEN k < 50 THEN 'TOOL_HALLUCINATION' ELSE 'REGISTRY_OVERFLOW' END
                      ELSE 'FIGMA_API_ERROR' END END AS event
  FROM ev),
logs AS (
  SELECT event_id, user_id, value, kind, k, event_id AS arrival_seq,
    'evt-' || event_id AS log_id, 'sess-' || user_id AS session_id, {ft.EPOCH_US} + off // {ft.TIME_DIVISOR} AS us,
    event, 'agent-' || (user_id % {ft.AGENTS}) AS agent_id,
    CASE WHEN kind = 'error' THEN 'error'
         WHEN (kind = 'signup' AND k % 10 = 0) OR (kind = 'view' AND k % 20 = 0) THEN 'debug'
         WHEN kind IN ('purchase', 'signup') OR event = 'FIGMA_API_WARN' THEN 'warning' ELSE 'info' END AS level,
    (['get_file', 'get_node', 'post_comment'])[k % 3 + 1] AS tool,
    CASE WHEN kind = 'click' THEN ({_array(ft.CLICK_MESSAGES)})[k % {len(ft.CLICK_MESSAGES)} + 1]
         ELSE {_case_map("event", ft.EVENT_MESSAGES)} END AS message,
    CASE WHEN kind = 'click' THEN ({_array(_spaced(a) for a in ft.CLICK_ARGS)})[k % {len(ft.CLICK_ARGS)} + 1] END AS args,
    k % 7 AS request_id, CAST(floor(value * 10) AS BIGINT) AS latency_ms,
    CASE WHEN event = 'FIGMA_API_ERROR' THEN ([503, 503, 429, 401])[k % 4 + 1] END AS http_status,
    CASE WHEN event IN ('RATE_LIMIT_WARN', 'RATE_LIMIT_CHECK', 'FIGMA_API_WARN') THEN k END AS used,
    CASE WHEN event = 'FIGMA_API_SLOW' THEN CAST(floor(value * 20) AS BIGINT) END AS elapsed_ms
  FROM ev2),
rows_ AS (
  SELECT *, CASE WHEN used IS NOT NULL THEN 100 ELSE 0 END AS lim, coalesce(used, 0) AS usd,
    CASE WHEN request_id = 0 THEN '' ELSE CAST(request_id AS VARCHAR) END AS req,
    '{{"tool": "' || tool || '", "request_id": ' || request_id || ', "latency_ms": ' || latency_ms
      || coalesce(', "http_status": ' || http_status, '') || coalesce(', "used": ' || used || ', "limit": 100', '')
      || coalesce(', "elapsed_ms": ' || elapsed_ms, '') || coalesce(', "args": ' || args, '') || '}}' AS meta_text
  FROM logs)"""


def _rule(rule_id: str, pattern: str, vetoed: list[str], out: str) -> str:
    hit = " OR ".join(f"regexp_matches({c}, {_s(pattern)}, 'i')" for c in ("message", "meta_text", "event"))
    veto = f" AND event NOT IN ({_list(vetoed)})" if vetoed else ""
    return f"CASE WHEN ({hit}){veto} THEN {_s(out)} END"


_RULE_IDS = ",\n".join(_rule(r, p, v, r) for r, p, _, v in fixed.TEXT_RULES)
_RULE_SUBTYPES = ",\n".join(_rule(r, p, v, s) for r, p, s, v in fixed.TEXT_RULES)

# RE2 has no back references; the only repeated block in the data is a literal.
_BY_ARGS = f"""
  CASE WHEN args IS NULL OR args = '{{}}' THEN NULL
    WHEN {_contains_any("lower(coalesce(args->>'$.file_key', ''))", fixed.FILE_KEY_TOKENS)} THEN 'prompt_injection_attempt'
    WHEN tool = 'post_comment' AND regexp_matches(coalesce(args->>'$.message', ''), {_s(fixed.COMMENT_PATTERN)}, 'i')
      THEN 'prompt_injection_attempt'
    WHEN tool = 'get_node' AND coalesce(args->>'$.node_id', '') <> ''
      AND NOT regexp_matches(args->>'$.node_id', {_s(fixed.NODE_ID_PATTERN)}) THEN 'input_anomaly'
    WHEN contains(args, 'abcdefghij-abcdefghij-abcdefghij-') THEN 'input_anomaly'
    WHEN regexp_matches(lower(args), {_s(fixed.ARGUMENT_PATTERN)}, 'i') THEN 'prompt_injection_attempt' END"""

_BY_EVENT = f"""
  CASE WHEN event IN ({_list(fixed.ANOMALY_TYPES)}) THEN 'synthetic_test_data'
       ELSE {_case_map("event", fixed.EVENT_SUBTYPES)} END"""

_NOISE = f"""
  (event IN ({_list(fixed.ROUTINE_EVENTS)})
   OR (event = 'RATE_LIMIT_CHECK' AND lim > 0 AND usd < CAST(trunc(0.8::DOUBLE * lim) AS BIGINT))
   OR (event = 'FIGMA_API_SLOW' AND coalesce(elapsed_ms, 0) < 1500) OR level = 'debug')"""

SIG = f"""
sig0 AS (
  SELECT *, {_BY_EVENT} AS by_event, {_BY_ARGS} AS by_args,
    list_filter([{_RULE_IDS}], lambda x: x IS NOT NULL) AS rule_ids,
    list_filter([{_RULE_SUBTYPES}], lambda x: x IS NOT NULL) AS rule_subtypes,
    {_NOISE} AS noise,
    regexp_matches(message || meta_text, {_s(fixed.ERROR_CODE_PATTERN)}, 'i') AS has_code
  FROM rows_),
sig1 AS (SELECT *, coalesce(by_event, rule_subtypes[1], by_args) AS subtype0 FROM sig0),
sig AS (
  SELECT *, noise AND NOT (list_has_any(rule_subtypes, [{_list(fixed.ESCALATE_SUBTYPES)}])
      OR coalesce(subtype0 IN ({_list(fixed.ESCALATE_SUBTYPES)}), false)) AS cleared,
    level = 'warning' AND event IN ('RATE_LIMIT_WARN', 'FIGMA_API_WARN') AND lim > 0
      AND usd >= CAST(trunc(0.8::DOUBLE * lim) AS BIGINT) AS warned_limit,
    event = 'FIGMA_API_ERROR' AND http_status = 503 AS is_503
  FROM sig1)"""

WIN = """
win AS (
  SELECT *, coalesce(list({'log_id': log_id, 'seq': arrival_seq, 'us': us, 'event': event, 'tool': tool, 'req': req,
      'is_warning': level = 'warning', 'warned_limit': warned_limit, 'is_503': coalesce(is_503, false)})
    OVER (PARTITION BY session_id ORDER BY arrival_seq ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), []) AS w
  FROM sig)"""

_CALL = "list_filter(w, lambda r: r.tool = tool AND r.event = 'TOOL_CALL_RECEIVED')[-1]"
_SUCCESS = "list_filter(w, lambda r: r.tool = tool AND r.event = 'TOOL_CALL_SUCCESS')[-1]"
_CALLS20 = "list_filter(w, lambda r: r.tool = tool AND r.event = 'TOOL_CALL_RECEIVED' AND r.us >= us - 20000000)"
_ERRS20 = "list_filter(w, lambda r: r.is_503 AND r.us >= us - 20000000)"
# Index of the last window row that is too old; only rows after it count.
_OLD = "coalesce(list_max(list_filter(range(1, len(w) + 1), lambda i: us - w[i].us > 10000000)), 0)"

COR = f"""
cor AS (
  SELECT *,
    level = 'warning' AND len(list_filter(w, lambda r: r.is_warning AND r.tool = tool AND r.us >= us - 60000000)) >= 1
      AS warned,
    CASE WHEN event = 'TOOL_CALL_ERROR' AND {_CALL} IS NOT NULL
           AND ({_SUCCESS} IS NULL OR {_SUCCESS}.us < {_CALL}.us) THEN {_CALL}.log_id END AS c_call,
    event = 'TOOL_CALL_RETRY'
      AND len(list_filter(w, lambda r: r.event IN ('FIGMA_API_ERROR', 'TOOL_CALL_ERROR'))) = 0 AS c_orphan,
    CASE WHEN event = 'TOOL_CALL_RECEIVED' AND len({_CALLS20}) >= 2 AND len({_ERRS20}) >= 2
      THEN list_transform(({_CALLS20})[-2:], lambda r: r.log_id) END AS c_loop,
    event = 'RATE_LIMIT_WARN' AND lim > 0 AND usd >= CAST(trunc(0.95::DOUBLE * lim) AS BIGINT) AS c_breach,
    CASE WHEN event = 'FIGMA_API_ERROR' AND http_status = 429
      THEN list_filter(w[{_OLD} + 1:], lambda r: r.warned_limit)[-1] END AS c_429,
    CASE WHEN event = 'TOOL_CALL_SUCCESS' AND req <> ''
      THEN list_filter(w, lambda r: r.req = req AND r.event = 'SCHEMA_VALIDATION_ERROR')[-1].log_id END AS c_schema
  FROM win),
jud0 AS (
  SELECT *,
    CASE WHEN c_call IS NOT NULL THEN 'tool_execution_failure' WHEN c_orphan THEN 'orphaned_retry_logic_error'
      WHEN c_loop IS NOT NULL THEN 'runaway_retry_loop' WHEN c_breach OR c_429.log_id IS NOT NULL THEN 'rate_limit_breach'
      WHEN c_schema IS NOT NULL THEN 'inconsistent_state' END AS derived,
    list_sort(list_distinct(list_filter(list_concat([c_call, c_429.log_id, c_schema], coalesce(c_loop, [])),
      lambda x: x IS NOT NULL))) AS links,
    array_to_string(list_filter([CASE WHEN c_orphan THEN 'C-02' END, CASE WHEN c_loop IS NOT NULL THEN 'C-03' END,
      CASE WHEN c_breach THEN 'C-04' END], lambda x: x IS NOT NULL), '|') AS context_rule_ids
  FROM cor),
jud1 AS (
  SELECT *, coalesce(CASE WHEN NOT cleared THEN subtype0 END, derived) AS subtype,
    by_event IS NOT NULL AND NOT cleared AS s1,
    ((level = 'error' OR warned) AND NOT cleared) OR (derived IS NOT NULL AND len(links) > 0) AS s2,
    (len(rule_ids) > 0 AND NOT cleared) OR derived IS NOT NULL AS s3,
    by_args IS NOT NULL AND NOT cleared AS s4
  FROM jud0),
jud AS (
  SELECT *, (s1 OR s2 OR s3 OR s4) AND subtype IS NOT NULL AS reported,
    CASE WHEN subtype IN ({_list(fixed.ALWAYS_HIGH_SUBTYPES)}) THEN 'high'
      WHEN (s1 AND s2) OR (s3 AND has_code) THEN 'high'
      WHEN (s2 AND level = 'error') OR warned OR (s4 AND s3) THEN 'medium' ELSE 'low' END AS confidence,
    array_to_string(list_filter([CASE WHEN s1 THEN 'signal_1' END, CASE WHEN s2 THEN 'signal_2' END,
      CASE WHEN s3 THEN 'signal_3' END, CASE WHEN s4 THEN 'signal_4' END], lambda x: x IS NOT NULL), '|') AS signals
  FROM jud1),
back AS (
  SELECT c_429.log_id AS to_id, list(log_id ORDER BY arrival_seq) AS ids FROM jud
  WHERE c_429.log_id IS NOT NULL GROUP BY 1),
find AS (
  SELECT j.*, {_case_map("subtype", fixed.SUBTYPE_TYPES)} AS legacy,
    CASE WHEN subtype = 'prompt_injection_attempt' AND tool = 'post_comment'
      THEN list_sort(list_distinct(list_concat(links,
             list_transform(list_filter(w, lambda r: r.tool = 'post_comment'), lambda r: r.log_id)))) ELSE links END AS own,
    coalesce(b.ids, []) AS back_ids
  FROM jud j LEFT JOIN back b ON b.to_id = j.log_id WHERE reported),
findings AS (
  SELECT *, list_concat(own, list_filter(back_ids, lambda x: NOT list_contains(own, x))) AS correlated FROM find)"""

# --- raw records ------------------------------------------------------------------------------------------------------

RAW = EV + f""",
raw0 AS (
  SELECT * REPLACE (CASE WHEN kind = 'error' AND k % 9 = 0 THEN 'UPSTREAM_TIMEOUT' ELSE event END AS event),
    event_id % {ft.RAW_VARIANTS} AS variant,
    '00000003-0000-4000-8000-' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS raw_log_id,
    CASE WHEN k % 4 = 0 THEN 'agent step' END AS triggered_by, CASE WHEN k % 5 = 0 THEN 'retry later' END AS recommendation
  FROM logs),
rawn AS (
  SELECT *, CASE WHEN variant = 14 THEN 'LEGACY_MCP_EVENT' ELSE event END AS n_event,
    CASE WHEN variant = 14 THEN CASE WHEN k % 3 = 0 THEN 'error' ELSE 'info' END ELSE level END AS n_level,
    CASE WHEN variant = 14 AND k % 2 = 1 THEN 'mcp-legacy-agent' ELSE agent_id END AS n_agent,
    CASE WHEN variant = 14 THEN kind ELSE coalesce(triggered_by, event) END AS n_intent,
    CASE WHEN variant = 14 THEN kind ELSE triggered_by END AS n_trigger,
    CASE WHEN variant = 14 THEN NULL ELSE recommendation END AS n_recommendation,
    CASE WHEN variant = 14 THEN CASE WHEN k % 3 = 0 THEN 'error' ELSE 'success' END
         WHEN k % 9 = 0 AND ends_with(event, 'TIMEOUT') THEN 'timeout'
         WHEN level = 'error' OR k % 6 = 0 THEN 'error' ELSE 'success' END AS n_status,
    CASE WHEN variant <> 14 AND k % 11 = 0 THEN 0 ELSE latency_ms END AS n_latency,
    CASE WHEN variant = 14 THEN CAST(trunc(round_even(k * 100 * 4 / 1024::DOUBLE, 2) * 1024 / 4) AS BIGINT)
         ELSE CAST(trunc(value * 1024 / 4) AS BIGINT) END AS n_tokens,
    CASE variant WHEN 15 THEN 'params.data.message' WHEN 16 THEN 'unknown key' WHEN 17 THEN 'params.level'
      WHEN 18 THEN 'anomaly_type' ELSE '' END AS n_errors
  FROM raw0),
norm AS (
  SELECT *, message || coalesce(' | ' || n_trigger, '') || coalesce(' | ' || n_recommendation, '') AS n_summary FROM rawn)"""

_MSG_STATUS = """CASE length(text) % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'timeout' WHEN 2 THEN 'partial' ELSE 'success' END"""

CONV = f"""
conv AS (
  SELECT conv_id, turn, text, conv_id * 1000 + turn AS arrival_seq, role AS source_agent,
    '00000002-0000-4000-8000-' || lpad(CAST(conv_id * 1000 + turn AS VARCHAR), 12, '0') AS log_id,
    '00000001-0000-4000-8000-' || lpad(CAST(conv_id AS VARCHAR), 12, '0') AS session_id,
    {ft.EPOCH_US} + (conv_id * 3600 + turn * 30 - CASE WHEN turn % 5 = 3 THEN 100 ELSE 0 END) * 1000000 AS us,
    CASE WHEN turn % 6 = 5 THEN role WHEN role = 'user' THEN 'assistant' ELSE 'user' END AS target_agent,
    least(turn, 5) AS depth, {_MSG_STATUS} AS response_status, (length(text) * 3) % 500 AS latency_ms,
    CASE WHEN turn % 3 = 0 THEN 'delegate the task' ELSE 'fetch invoice details' END AS task_intent
  FROM conversations)"""
