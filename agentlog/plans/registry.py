"""Registered queries: each operator run over the given tables, with the DuckDB statement that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agentlog.config import Settings
from agentlog.functions import dictionaries as fixed
from agentlog.functions import jsontext as js
from agentlog.functions import lookups as lk
from agentlog.functions.plan import broadcast_up_to
from agentlog.operators import classify as cl
from agentlog.operators import detect as dt
from agentlog.operators import evaluate as ev
from agentlog.operators import findings as fd
from agentlog.operators import graph as gr
from agentlog.operators import normalize as nz
from agentlog.operators import sampling as sm
from agentlog.operators import session as se
from agentlog.operators import signals as sg
from agentlog.operators import stats as st
from agentlog.operators import vectorindex as vi
from agentlog.operators import vectors as ve
from agentlog.plans import fromtables as ft
from agentlog.plans import oracle as o
from agentlog.plans import process as pr
from agentlog.sources import jsonl, reports, store
from agentlog.sources.scratch import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def _logs(spark: SparkSession, sf: str, shuffled: bool = False) -> DataFrame:
    return ft.agent_logs(ft.read(spark, sf, "events"), shuffled)


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return sg.signal_rows(_logs(spark, sf))


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    return ft.raw_records(ft.read(spark, sf, "events")).select("arrival_seq", "variant", "raw")


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    return ft.a2a_logs(ft.read(spark, sf, "conversations"))


def _stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table, as graphs are kept: several steps read them."""
    path = scratch_path(df.sparkSession, name)
    df = df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "void"})
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _joined(c: str):
    return F.array_join(c, "|")


def _us(c: str = "ts"):
    return F.unix_micros(c)


# --- sources and validation -------------------------------------------------------------------------------------------


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with damage: every 13th record is cut off, a blank line follows every 17th."""
    raw = _raw(spark, sf)
    n = F.col("arrival_seq")
    broken = F.when(n % 13 == 0, F.expr("substring(raw, 1, 40)")).otherwise(F.col("raw"))
    parts = F.when(n % 17 == 0, F.array(broken, F.lit("   "))).otherwise(F.array(broken))
    return raw.select("arrival_seq", F.explode(parts).alias("value"))


@query(
    o.chain(o.RAW, select="""SELECT count(*) FILTER (event_id % 13 <> 0 AND n_errors = '') AS inserted,
      count(*) FILTER (event_id % 13 = 0 OR n_errors <> '') AS errors, count(*) AS total FROM norm""")
)
def ingest_json_lines(spark, sf):
    return jsonl.ingest_counts(_lines(spark, sf))


@query(
    o.chain(o.EV, select="""SELECT count(*) FILTER (event_id % 13 <> 0) AS good, count(*) FILTER (event_id % 13 = 0) AS bad
      FROM logs""")
)
def split_json_lines(spark, sf):
    good, bad = jsonl.parse_lines(_lines(spark, sf))
    counts = good.select(F.lit(True).alias("ok")).unionByName(bad.select(F.lit(False).alias("ok")))
    return counts.agg(F.count_if("ok").alias("good"), F.count_if(~F.col("ok")).alias("bad"))


@query(
    o.chain(o.EV, select="""
      SELECT 'file-' || event_id AS source, 1 AS row, k AS x FROM logs WHERE k % 3 < 2
      UNION ALL SELECT 'file-' || event_id, 2, k + 1 FROM logs WHERE k % 3 < 2""")
)
def uploaded_documents(spark, sf):
    k = F.col("k")
    value = (
        F.when(k % 3 == 0, F.format_string('[{"x":%d}, 7, "text", {"x":%d}]', k, k + 1))
        .when(k % 3 == 1, F.format_string('{"x":%d}\n\n{"x":%d}\n', k, k + 1))
        .otherwise("  ")
    )
    rows = ft.event_rows(ft.read(spark, sf, "events"))
    documents = rows.select(F.concat(F.lit("file-"), "event_id").alias("source"), value.alias("value"))
    out = jsonl.explode_documents(documents)
    return out.select("source", "row", F.get_json_object("raw", "$.x").cast("int").alias("x"))


@query(
    o.chain(o.RAW, select=f"""
      SELECT event_id AS batch_id, 1 AS index, CASE WHEN variant = 12 THEN 'ok' WHEN n_errors = '' THEN 'ok' ELSE n_errors END AS outcome
      FROM norm WHERE k % 3 < 2
      UNION ALL SELECT event_id, 2, {o._s(jsonl.LOGS_ONLY_MCP)} FROM norm WHERE k % 3 = 0
      UNION ALL SELECT event_id, 2, 'protocol' FROM norm WHERE k % 3 = 1""")
)
def session_batches(spark, sf):
    rows = ft.raw_records(ft.read(spark, sf, "events"))
    other = (
        '{"log_id":"00000009-0000-4000-8000-000000000001","protocol":"A2A","timestamp":"2024-01-01T00:00:00Z",'
        '"session_id":"00000009-0000-4000-8000-000000000002","source_agent":"a","target_agent":"b",'
        '"message_type":"clarification","message_content":"m","task_intent":"t","response_status":"success","latency_ms":1}'
    )
    k = F.col("k")
    batch = (
        F.when(k % 3 == 0, F.concat(F.lit("["), "raw", F.lit(","), F.lit(other), F.lit("]")))
        .when(k % 3 == 1, F.concat(F.lit('{"session":{"id":"outer"},"logs":['), "raw", F.lit(',{"a":1}]}')))
        .otherwise('{"nothing":[]}')
    )
    elements = jsonl.explode_batch(rows.select(F.col("event_id").alias("batch_id"), batch.alias("raw")))
    rows = jsonl.batch_rows(elements)
    return rows.select("batch_id", F.col("arrival_seq").alias("index"), F.coalesce("error", F.lit("ok")).alias("outcome"))


@query(
    o.chain(o.RAW, select="""SELECT arrival_seq, 'MCP' AS protocol_in,
      CASE variant WHEN 13 THEN 'envelope' WHEN 14 THEN 'legacy' ELSE 'notification' END AS shape FROM raw0
      UNION ALL SELECT -1 - (conv_id * 1000 + turn), 'A2A', 'a2a' FROM conversations""")
)
def protocol_routing(spark, sf):
    a2a = ft.raw_messages(ft.read(spark, sf, "conversations")).select((-1 - F.col("arrival_seq")).alias("arrival_seq"), "raw")
    rows = _raw(spark, sf).select("arrival_seq", "raw").unionByName(a2a)
    return nz.record_shape(nz.detect_protocol(nz.parse_raw(rows))).select("arrival_seq", "protocol_in", "shape")


_NORM_SQL = """SELECT arrival_seq, CASE WHEN variant = 12 THEN 'generated' ELSE raw_log_id END AS log_id, session_id, us,
  n_agent AS agent_id, n_event AS event, n_level AS level, tool AS tool_name, n_intent AS intent, n_status AS response_status,
  n_latency AS latency_ms, n_tokens AS context_window_tokens, n_summary AS context_summary,
  message || ' | ' || n_intent || ' | ' || tool || ' | ' || n_summary AS text_for_embedding FROM norm WHERE n_errors = ''"""


def _normalized(df: DataFrame) -> DataFrame:
    return df.select(
        "arrival_seq",
        F.when(F.col("log_id").startswith("00000003-"), F.col("log_id")).otherwise("generated").alias("log_id"),
        "session_id", _us().alias("us"), "agent_id", "event", "level", "tool_name", "intent", "response_status",
        "latency_ms", "context_window_tokens", "context_summary", "text_for_embedding",
    )


@query(o.chain(o.RAW, select=_NORM_SQL))
def normalize_mcp(spark, sf):
    return _normalized(nz.normalize(_raw(spark, sf))[0])


@query(o.chain(o.RAW, select=_NORM_SQL + " AND variant = 14"))
def legacy_records(spark, sf):
    return _normalized(nz.normalize(_raw(spark, sf).where(F.col("variant") == 14))[0])


@query(o.chain(o.RAW, select=_NORM_SQL + " AND variant = 13"))
def unwrap_envelopes(spark, sf):
    return _normalized(nz.normalize(_raw(spark, sf).where(F.col("variant") == 13))[0])


@query(o.chain(o.RAW, select="SELECT arrival_seq, n_errors AS errors FROM norm"))
def validate_mcp(spark, sf):
    return nz.normalize_all(_raw(spark, sf)).select("arrival_seq", _joined("errors").alias("errors"))


@query(
    o.chain(o.CONV, select="""SELECT arrival_seq, CASE (conv_id + turn) % 9 WHEN 1 THEN 'session_id' WHEN 2 THEN 'target_agent'
      WHEN 3 THEN 'delegation_depth|delegation_chain length' WHEN 4 THEN CASE WHEN depth >= 2 THEN 'delegation_chain length' ELSE '' END
      WHEN 5 THEN 'response_status' WHEN 6 THEN 'latency_ms' ELSE '' END AS errors FROM conv""")
)
def validate_a2a(spark, sf):
    rows = ft.raw_messages(ft.read(spark, sf, "conversations")).select("arrival_seq", "raw")
    return nz.normalize_all(rows).select("arrival_seq", _joined("errors").alias("errors"))


@query(
    o.chain(o.CONV, select="""SELECT arrival_seq, log_id, session_id, us, source_agent AS agent_id, depth AS delegation_depth,
      CASE WHEN (conv_id + turn) % 9 = 4 AND depth = 1 THEN source_agent || '|' || target_agent
           ELSE array_to_string(list_transform(range(depth + 1), lambda i: source_agent), '|') END AS delegation_chain,
      response_status, latency_ms, text || ' | ' || task_intent || ' | ' || target_agent AS text_for_embedding FROM conv
      WHERE (conv_id + turn) % 9 NOT IN (1, 2, 3, 5, 6) AND NOT ((conv_id + turn) % 9 = 4 AND depth >= 2)""")
)
def normalize_a2a(spark, sf):
    rows = ft.raw_messages(ft.read(spark, sf, "conversations")).select("arrival_seq", "raw")
    good, _ = nz.normalize(rows)
    return good.select(
        "arrival_seq", "log_id", "session_id", _us().alias("us"), "agent_id", "delegation_depth",
        _joined("delegation_chain").alias("delegation_chain"), "response_status", "latency_ms", "text_for_embedding",
    )


@query(
    o.chain(o.RAW, select="""SELECT 'file-' || event_id % 5 AS source, count(*) AS total,
      count(*) FILTER (n_errors <> '' OR variant = 14) AS failures FROM norm GROUP BY 1""")
)
def validation_report(spark, sf):
    rows = _raw(spark, sf).withColumn("source", F.concat(F.lit("file-"), F.col("arrival_seq") % 5))
    return nz.validation_report(rows)


@query(
    o.chain(o.RAW, select="""SELECT arrival_seq, 'file-' || event_id % 5 AS source, (SELECT count(*) FROM norm) AS total,
      count(*) OVER () AS failures, CASE WHEN variant <> 14 THEN n_errors END AS errors FROM norm WHERE n_errors <> '' OR variant = 14""")
)
def validation_failures(spark, sf):
    """The failing rows and the totals of one scan; a legacy record breaks many rules."""
    rows = _raw(spark, sf).withColumn("source", F.concat(F.lit("file-"), F.col("arrival_seq") % 5))
    bad, counts = nz.failing_rows(rows, scratch_path(spark, "failing"))
    legacy = F.col("arrival_seq") % ft.RAW_VARIANTS == 14
    return bad.select(
        "arrival_seq", "source", F.lit(counts["total"]).cast("bigint").alias("total"),
        F.lit(counts["failures"]).cast("bigint").alias("failures"), F.when(~legacy, _joined("errors")).alias("errors"),
    )


@query(
    """SELECT 'u' || user_id || '-' || event_type AS log_id, max(event_id) AS arrival_seq,
         arg_max(value, event_id) AS value FROM events GROUP BY 1"""
)
def upsert_last_write(spark, sf):
    rows = ft.read(spark, sf, "events").select(
        F.concat(F.lit("u"), "user_id", F.lit("-"), "event_type").alias("log_id"),
        F.col("event_id").alias("arrival_seq"),
        "value",
    )
    return store.last_write(rows)


@query(
    o.chain(o.EV, select="""SELECT log_id AS id, message || ' | ' || event || ' | ' || tool || ' | ' || message AS document, event,
      coalesce(args, '{}') AS tool_parameters, '' AS context_carried, latency_ms FROM logs""")
)
def baseline_rows(spark, sf):
    rows = store.baseline_rows(ve.vectorize(_logs(spark, sf), dim=16))
    return rows.select(
        "id", "document", "metadata.event", "metadata.tool_parameters", "metadata.context_carried", "metadata.latency_ms"
    )


def _doc_hash():
    return F.pmod(F.col("doc_id") * F.lit(2654435761), F.lit(4294967296))


@query(
    """SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang
         ORDER BY (doc_id * 2654435761) % 4294967296, doc_id) AS n FROM documents) WHERE n <= 40"""
)
def stratified_sample(spark, sf):
    docs = ft.read(spark, sf, "documents").select("doc_id", "lang")
    return sm.stratified_sample(docs, "lang", 40, id_col="doc_id", order=_doc_hash())


@query(
    """WITH d AS (SELECT d.doc_id, CASE WHEN doc_id % 3 = 0 THEN 'A2A' ELSE 'MCP' END AS protocol, lang AS anomaly_type, quality
         FROM documents d JOIN labels USING (doc_id)),
       n AS (SELECT doc_id, protocol, anomaly_type, 0 AS ground_truth_label, row_number() OVER (PARTITION BY protocol
         ORDER BY (doc_id * 2654435761) % 4294967296, doc_id) AS r FROM d WHERE quality = 1),
       a AS (SELECT doc_id, protocol, anomaly_type, 1 AS ground_truth_label, row_number() OVER (PARTITION BY protocol, anomaly_type
         ORDER BY (doc_id * 2654435761) % 4294967296, doc_id) AS r FROM d WHERE quality = 0)
       SELECT doc_id, protocol, anomaly_type, ground_truth_label FROM n WHERE r <= CASE protocol WHEN 'MCP' THEN 60 ELSE 20 END
       UNION ALL SELECT doc_id, protocol, anomaly_type, ground_truth_label FROM a WHERE r <= CASE protocol WHEN 'MCP' THEN 5 ELSE 2 END"""
)
def golden_dataset(spark, sf):
    docs = ft.read(spark, sf, "documents").join(ft.read(spark, sf, "labels"), "doc_id").select(
        "doc_id",
        F.when(F.col("doc_id") % 3 == 0, "A2A").otherwise("MCP").alias("protocol"),
        F.col("lang").alias("anomaly_type"),
        "quality",
    )
    normal, bad = docs.where("quality = 1").drop("quality"), docs.where("quality = 0").drop("quality")
    sizes = {"MCP": 60, "A2A": 20}, {"MCP": 5, "A2A": 2}
    return sm.golden_dataset(normal, bad, *sizes, id_col="doc_id", order=_doc_hash())


@query(
    """SELECT doc_id, source FROM (SELECT doc_id, lang AS source, row_number() OVER (PARTITION BY lang
         ORDER BY (doc_id * 2654435761) % 4294967296, doc_id) AS n FROM documents)
       WHERE n <= CASE source WHEN 'en' THEN 200 WHEN 'fr' THEN 40 WHEN 'de' THEN 60 ELSE 20 END"""
)
def mix_sources(spark, sf):
    docs = ft.read(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    takes = {"en": 200, "fr": 40, "de": 60, "es": 20}
    parts = {name: docs.where(F.col("lang") == name).drop("lang") for name in takes}
    return sm.mix_sources(parts, takes, id_col="doc_id", time_col="n_chars", order=_doc_hash()).select("doc_id", "source")


# --- signals ----------------------------------------------------------------------------------------------------------


@query(
    o.chain(o.EV, select="SELECT log_id, event, level, tool, req AS request_id, coalesce(http_status, 0) AS http_status, usd AS used, lim AS \"limit\", coalesce(elapsed_ms, 0) AS elapsed_ms, meta_text FROM rows_")
)
def signal_rows(spark, sf):
    return _rows(spark, sf).select(
        "log_id", "event", "level", "tool", "request_id", "http_status", "used", "limit", "elapsed_ms", "meta_text"
    )


@query(o.chain(o.EV, select=f"SELECT log_id, {o._BY_EVENT} AS subtype, event IN ({o._list(fixed.ANOMALY_TYPES)}) AS synthetic FROM rows_"))
def signal_event(spark, sf):
    subtype, synthetic = sg.signal_event(F.col("event"))
    return _rows(spark, sf).select("log_id", subtype.alias("subtype"), synthetic.alias("synthetic"))


@query(o.chain(o.EV, o.SIG, select="SELECT log_id, array_to_string(rule_ids, '|') AS rule_ids, array_to_string(rule_subtypes, '|') AS subtypes FROM sig0"))
def signal_rules(spark, sf):
    rows = _rows(spark, sf).withColumn("text", sg.rule_text(F.col("message"), F.col("meta_text"), F.col("event")))
    matched = rows.withColumn("m", sg.rule_matches(F.col("text"), F.col("event")))
    return matched.select("log_id", _joined("m.rule_id").alias("rule_ids"), _joined("m.subtype").alias("subtypes"))


@query(o.chain(o.EV, select=f"SELECT log_id, {o._BY_ARGS} AS subtype FROM rows_"))
def signal_arguments(spark, sf):
    return _rows(spark, sf).select("log_id", sg.signal_args(F.col("tool"), F.col("args_raw"), F.col("args")).alias("subtype"))


@query(o.chain(o.EV, o.SIG, select="SELECT log_id, noise, cleared FROM sig"))
def noise_rows(spark, sf):
    rows = _rows(spark, sf)
    noise = sg.is_noise(*[F.col(c) for c in ("event", "level", "used", "limit", "elapsed_ms")])
    return sg.row_signals(rows).select("log_id", "cleared").join(rows.select("log_id", noise.alias("noise")), "log_id")


@query(o.chain(o.EV, o.SIG, select="SELECT log_id, has_code FROM sig"))
def error_codes(spark, sf):
    return _rows(spark, sf).select("log_id", sg.has_error_code(F.col("message"), F.col("meta_text")).alias("has_code"))


_ALL = (o.EV, o.SIG, o.WIN, o.COR)


@query(o.chain(*_ALL, select="SELECT log_id, confidence FROM findings"))
def finding_confidence(spark, sf):
    return fd.analyze(_logs(spark, sf)).select("log_id", "confidence")


@query(
    o.chain(*_ALL, select=f"""SELECT log_id, replace(subtype, '_', ' ') || ' detected for event ' || event || '.' AS summary,
      'message=' || message[1:220] || ' | meta=' || meta_text[1:240] AS detail,
      coalesce({o._case_map("subtype", fixed.ACTIONS)}, {o._s(fixed.DEFAULT_ACTION)}) AS recommended_action FROM findings""")
)
def finding_text(spark, sf):
    return fd.analyze(_logs(spark, sf)).select("log_id", "summary", "detail", "recommended_action")


@query(o.chain(*_ALL, select="SELECT legacy AS legacy_type, count(*) AS n FROM findings GROUP BY 1"))
def legacy_types(spark, sf):
    found = fd.analyze(_logs(spark, sf))
    return found.groupBy(F.col("legacy_anomaly_type").alias("legacy_type")).agg(F.count(F.lit(1)).alias("n"))


def _fake_scorer(rows: DataFrame) -> DataFrame:
    """A scorer for checks: the score grows with the text length."""
    score = (F.length("message") % 10) / 10.0
    return rows.withColumns({"ml_score": score, "ml_label": F.lit("input_anomaly")})


def _phase_sql(phase: int) -> str:
    ml = "(length(message) % 10) / 10.0::DOUBLE"
    by_score = f"CASE WHEN {ml} >= 0.82 THEN 'input_anomaly' END"
    sig = o.SIG.replace(
        "coalesce(by_event, rule_subtypes[1], by_args)", f"coalesce(by_event, rule_subtypes[1], by_args, {by_score})"
    )
    cor = o.COR.replace("by_args IS NOT NULL AND NOT cleared AS s4", f"(by_args IS NOT NULL OR {by_score} IS NOT NULL) AND NOT cleared AS s4")
    hit = "(s1 OR s2 OR s3)"
    if phase <= 2:
        reported, source = f"{hit}", "'rule_only'"
    elif phase == 3:
        reported = hit
        source = f"CASE WHEN {hit} AND s4 THEN 'rule_ml' WHEN {hit} THEN 'rule_only' ELSE 'ml_review_queue' END"
    else:
        alone = f"(NOT {hit} AND s4 AND {ml} >= 0.82)"
        reported = f"({hit} OR {alone})"
        source = f"CASE WHEN {hit} AND s4 THEN 'rule_ml' WHEN {hit} THEN 'rule_only' WHEN {alone} THEN 'ml_only' ELSE 'ml_review_queue' END"
    return o.chain(
        o.EV, sig, o.WIN, cor,
        select=f"""SELECT coalesce({reported} AND subtype IS NOT NULL, false) AS reported, {source} AS promotion_source, count(*) AS n
          FROM jud1 GROUP BY 1, 2""",
    )


def _phase(phase: int) -> Query:
    def run(spark, sf):
        cfg = Settings(hybrid_enabled=True, hybrid_phase=phase)
        judged = fd.judged_rows(_logs(spark, sf), cfg, _fake_scorer)
        return judged.groupBy("reported", "promotion_source").agg(F.count(F.lit(1)).alias("n"))

    return run


for _p in (1, 2, 3, 4):
    QUERIES[f"promotion_phase_{_p}"] = _phase(_p)
    ORACLE[f"promotion_phase_{_p}"] = _phase_sql(_p)


# --- session operators ------------------------------------------------------------------------------------------------


def _windowed(spark, sf) -> DataFrame:
    return se.with_window(sg.row_signals(_rows(spark, sf)))


@query(o.chain(o.EV, o.SIG, o.WIN, select="SELECT log_id, len(w) AS size, array_to_string(list_transform(w, lambda r: r.log_id), '|') AS ids FROM win"))
def session_window(spark, sf):
    return _windowed(spark, sf).select("log_id", F.size("w").alias("size"), _joined("w.log_id").alias("ids"))


def _rule_query(column, sql: str, name: str) -> None:
    QUERIES[name] = lambda spark, sf: _windowed(spark, sf).withColumn("x", column()).where(
        F.col("x") if sql.startswith("flag:") else F.col("x").isNotNull()
    ).select("log_id", (F.lit("hit") if sql.startswith("flag:") else F.col("x")).alias("link"))
    c = sql.removeprefix("flag:")
    ORACLE[name] = o.chain(
        *_ALL,
        select=f"SELECT log_id, 'hit' AS link FROM cor WHERE {c}"
        if sql.startswith("flag:")
        else f"SELECT log_id, {c} AS link FROM cor WHERE {c} IS NOT NULL",
    )


_rule_query(se.warn_accumulated, "flag:warned", "warning_accumulation")
_rule_query(se.unfinished_call, "c_call", "unfinished_tool_call")
_rule_query(se.orphan_retry, "flag:c_orphan", "orphaned_retry")
_rule_query(lambda: F.array_join(se.runaway_calls(), "|"), "array_to_string(c_loop, '|')", "runaway_retry_loop")
_rule_query(se.near_breach, "flag:c_breach", "rate_limit_near_breach")
_rule_query(lambda: se.warning_before_429()["log_id"], "c_429.log_id", "warning_before_429")
_rule_query(se.inconsistent_success, "c_schema", "inconsistent_state")


@query(
    o.chain(*_ALL, select="""SELECT log_id, array_to_string(own, '|') AS links FROM find
      WHERE subtype = 'prompt_injection_attempt' AND tool = 'post_comment' AND len(own) > 0""")
)
def prior_comment_links(spark, sf):
    found = fd.to_findings(fd.judged_rows(_logs(spark, sf)).drop("back_links"))
    comment = (F.col("tool") == "post_comment") & (F.col("subtype") == "prompt_injection_attempt")
    return found.where(comment & (F.size("correlated_log_ids") > 0)).select("log_id", _joined("correlated_log_ids").alias("links"))


_FINDINGS_SQL = o.chain(
    *_ALL,
    select="""SELECT log_id, session_id, us, subtype, legacy AS legacy_anomaly_type, confidence, signals, event, level, context_rule_ids,
      array_to_string(correlated, '|') AS correlated_log_ids,
      event IN ('TOOL_HALLUCINATION', 'CONTEXT_POISONING', 'REGISTRY_OVERFLOW', 'DELEGATION_CHAIN_FAILURE') AS synthetic_test_data
      FROM findings""",
)


def _finding_rows(found: DataFrame) -> DataFrame:
    return found.select(
        "log_id", "session_id", _us().alias("us"), "subtype", "legacy_anomaly_type", "confidence",
        _joined("signals_triggered").alias("signals"), "event", "level",
        _joined("context_rule_ids").alias("context_rule_ids"), _joined("correlated_log_ids").alias("correlated_log_ids"),
        "synthetic_test_data",
    )


@query(_FINDINGS_SQL)
def analyze(spark, sf):
    return _finding_rows(fd.analyze(_logs(spark, sf)))


@query(_FINDINGS_SQL)
def analyze_split_sessions(spark, sf):
    """The same result with every session treated as a hot one."""
    return _finding_rows(fd.analyze(_logs(spark, sf), Settings(hot_key_rows=2, hot_key_chunks=5)))


_PREV = """
late AS (SELECT *, 2 * event_id + CASE WHEN event_id % 7 = 0 THEN 801 ELSE 0 END AS seq2 FROM logs),
prev AS (
  SELECT *, max({'us': us, 'neg': -seq2, 'id': log_id}) OVER (PARTITION BY session_id ORDER BY seq2
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM late)"""


@query(o.chain(o.EV, _PREV, select="SELECT log_id, p.id AS previous FROM prev"))
def previous_in_session(spark, sf):
    return se.previous_in_session(_logs(spark, sf, True)).select("log_id", F.col("prev.log_id").alias("previous"))


@query(o.chain(o.EV, _PREV, select="SELECT log_id, p.id AS previous FROM prev"))
def previous_split_sessions(spark, sf):
    cfg = Settings(hot_key_rows=2, hot_key_chunks=6)
    return se.previous_in_session(_logs(spark, sf, True), cfg).select("log_id", F.col("prev.log_id").alias("previous"))


@query(o.chain(o.EV, _PREV, select="SELECT log_id, greatest(us - p.us, 0) // 1000 AS lag_ms FROM prev WHERE p IS NOT NULL"))
def lag_between_logs(spark, sf):
    linked = se.previous_in_session(_logs(spark, sf, True)).where(F.col("prev").isNotNull())
    return linked.select("log_id", se.lag_ms(F.col("ts"), F.col("prev.us")).alias("lag_ms"))


@query(
    o.chain(o.EV, """seq AS (SELECT session_id, lag(log_id) OVER (PARTITION BY session_id ORDER BY arrival_seq) AS source, log_id AS target FROM logs)""",
            select="SELECT session_id, source, target FROM seq WHERE source IS NOT NULL")
)
def session_edges(spark, sf):
    return se.session_edges(_logs(spark, sf))


def _summary_columns(df: DataFrame, extra: list[str]) -> DataFrame:
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e.key, F.lit("="), e.value)), "|")
    return df.select(
        *extra,
        "total_logs_analysed", "anomalies_found", "anomaly_density_pct", listed("by_type").alias("by_type"),
        *[F.col("by_confidence")[n].alias(n) for n in ("high", "medium", "low")],
        *[F.col("by_level")[n].alias("level_" + n) for n in fixed.LEVELS],
        "non_anomalous_warnings", "non_anomalous_errors", listed("policy_stats").alias("policy_stats"), "assessment",
    )


def _summary_sql(by: str) -> str:
    group = "GROUP BY session_id" if by else ""
    key = "session_id," if by else ""
    match = "t.session_id = j.session_id" if by else "true"
    return o.chain(
        *_ALL,
        f"""types AS (SELECT {key} subtype || '=' || count(*) AS pair FROM jud WHERE reported GROUP BY {key} subtype)""",
        f"""agg AS (SELECT {key} count(*) AS total_logs_analysed, count(*) FILTER (reported) AS anomalies_found,
          round_even(count(*) FILTER (reported) / count(*)::DOUBLE * 100, 2) AS anomaly_density_pct,
          {", ".join(f"count(*) FILTER (reported AND confidence = '{c}') AS {c}" for c in ("high", "medium", "low"))},
          {", ".join(f"count(*) FILTER (level = '{c}') AS level_{c}" for c in fixed.LEVELS)},
          count(*) FILTER (level = 'warning' AND NOT coalesce(reported, false)) AS non_anomalous_warnings,
          count(*) FILTER (level = 'error' AND NOT coalesce(reported, false)) AS non_anomalous_errors,
          concat_ws('|', 'promoted=' || nullif(count(*) FILTER (reported), 0),
            'rule_only=' || nullif(count(*) FILTER (NOT coalesce(reported, false)), 0)) AS policy_stats
          FROM jud {group})""",
        select=f"""SELECT *, coalesce((SELECT string_agg(pair, '|' ORDER BY pair) FROM types t WHERE {match}), '') AS by_type,
          CASE WHEN anomalies_found = 0 THEN {o._s(fixed.ASSESS_CLEAN)} WHEN anomalies_found / total_logs_analysed::DOUBLE * 100 > 20
            THEN {o._s(fixed.ASSESS_ELEVATED)} ELSE {o._s(fixed.ASSESS_ISOLATED)} END AS assessment FROM agg j""",
    )


@query(_summary_sql(""))
def analysis_summary(spark, sf):
    return _summary_columns(fd.analysis_summary(_logs(spark, sf)), [])


@query(_summary_sql("session_id"))
def session_summaries(spark, sf):
    return _summary_columns(fd.analysis_summary(_logs(spark, sf), by="session_id"), ["session_id"])


@query(
    o.chain(*_ALL, """top AS (SELECT session_id FROM logs GROUP BY 1 ORDER BY count(*) DESC, min(arrival_seq) LIMIT 1)""",
            """risk AS (SELECT log_id, subtype FROM jud WHERE reported ORDER BY CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC,
              CAST(s1 AS INT) + CAST(s2 AS INT) + CAST(s3 AS INT) + CAST(s4 AS INT) DESC, arrival_seq LIMIT 1)""",
            select="SELECT (SELECT session_id FROM top) AS session_id, (SELECT sha256(log_id || '|' || subtype) FROM risk) AS highest_risk_finding_id")
)
def summary_highlights(spark, sf):
    return fd.analysis_summary(_logs(spark, sf)).select("session_id", "highest_risk_finding_id")


@query(
    o.chain(*_ALL, select=f"""SELECT l.log_id, f.log_id IS NOT NULL AS is_anomaly, f.legacy AS anomaly_type,
      coalesce({o._case_map("f.confidence", fixed.LABEL_SCORES)}, 0.0)::DOUBLE AS anomaly_score,
      CASE WHEN f.log_id IS NOT NULL THEN coalesce(f.correlated[1], 'n/a') END AS root_cause_log_id
      FROM logs l LEFT JOIN findings f ON l.log_id = f.log_id""")
)
def join_findings(spark, sf):
    logs = _logs(spark, sf)
    joined = fd.join_findings(logs.select("log_id"), fd.analyze(logs))
    return joined.select("log_id", "is_anomaly", "anomaly_type", "anomaly_score", "root_cause_log_id")


@query(ORACLE["join_findings"])
def group_analysis_mcp(spark, sf):
    out = pr.analyze_group(_logs(spark, sf))
    return out.select("log_id", "is_anomaly", "anomaly_type", "anomaly_score", "root_cause_log_id")


# --- text functions ---------------------------------------------------------------------------------------------------

_GRAMS = """
dw AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS words FROM documents),
dg AS (SELECT doc_id, words, CASE WHEN len(words) >= 8 THEN list_transform(range(1, len(words) - 1),
  lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END AS grams FROM dw)"""


@query(
    o.chain(_GRAMS, select="""SELECT doc_id, round(CASE WHEN grams IS NULL THEN 0.0 ELSE 1.0 - len(list_distinct(grams)) / len(grams)::DOUBLE END, 9) AS ratio FROM dg""")
)
def duplicate_ngram_ratio(spark, sf):
    docs = ft.read(spark, sf, "documents")
    return docs.select("doc_id", F.round(lk.dup_ngram_ratio(F.col("text")), 9).alias("ratio"))


@query(f"SELECT doc_id, {o._domain('text', fixed.CLASSIFIER_HINTS)} AS classifier_domain, {o._domain('text', fixed.OUTCOME_HINTS)} AS outcome_domain FROM documents")
def intent_domains(spark, sf):
    docs = ft.read(spark, sf, "documents")
    return docs.select(
        "doc_id",
        lk.intent_domain(F.col("text"), fixed.CLASSIFIER_HINTS).alias("classifier_domain"),
        lk.intent_domain(F.col("text"), fixed.OUTCOME_HINTS).alias("outcome_domain"),
    )


@query(o.chain(o.EV, select=f"SELECT tool, {o._case_map('tool', fixed.TOOL_DOMAIN)} AS domain, count(*) AS n FROM logs GROUP BY 1, 2"))
def tool_domains(spark, sf):
    rows = _rows(spark, sf).select("tool", lk.tool_domain(F.col("tool")).alias("domain"))
    return rows.groupBy("tool", "domain").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS words FROM documents)
       SELECT doc_id, md5(CASE WHEN len(words) > 200 THEN array_to_string(words[1:200], ' ') ELSE text END) AS digest FROM w"""
)
def explanation_word_limit(spark, sf):
    return ft.read(spark, sf, "documents").select("doc_id", F.md5(cl.first_words(F.col("text"), 200)).alias("digest"))


@query(
    o.chain(o.RAW, select="""SELECT arrival_seq, 'MCP' AS protocol, session_id, tool AS tool_or_target, event AS event_or_type,
      CASE WHEN variant = 12 THEN '' ELSE raw_log_id END AS log_id FROM raw0 WHERE variant NOT IN (13, 14, 19)
      UNION ALL SELECT arrival_seq, CASE variant WHEN 14 THEN 'MCP' ELSE '' END, '', '', '', raw_log_id
        FROM raw0 WHERE variant IN (13, 14, 19)
      UNION ALL SELECT -1 - arrival_seq, 'A2A', CASE WHEN (conv_id + turn) % 9 = 1 THEN 'not-a-uuid' ELSE session_id END,
        CASE WHEN (conv_id + turn) % 9 = 2 THEN ' ' ELSE target_agent END,
        CASE WHEN turn % 2 = 0 THEN 'task_delegation' ELSE 'result_return' END, log_id FROM conv""".replace("FROM conv", "FROM conv"), )
    .replace("WITH ", "WITH " + o.CONV.strip() + ",", 1)
)
def raw_previews(spark, sf):
    mcp = _raw(spark, sf).select("arrival_seq", "raw")
    a2a = ft.raw_messages(ft.read(spark, sf, "conversations")).select((-1 - F.col("arrival_seq")).alias("arrival_seq"), "raw")
    return cl.raw_preview(mcp.unionByName(a2a)).drop("raw")


@query(
    o.chain(o.EV, select="SELECT log_id FROM logs WHERE session_id IN ('sess-1', 'sess-2', 'sess-3') AND arrival_seq BETWEEN 10 AND 900000000")
)
def filtered_group(spark, sf):
    rows = cl.filter_group(_logs(spark, sf), ["MCP"], ["sess-1", "sess-2", "sess-3"], (10, 900_000_000))
    return rows.select("log_id")


# --- vectors ----------------------------------------------------------------------------------------------------------


def _all_vectors(spark, sf) -> DataFrame:
    return ft.read(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "vec_id", "embedding", "label")


def _asked(vectors: DataFrame) -> DataFrame:
    """The query set of the evaluation: every row whose id is divisible by 100, against all rows."""
    return vectors.where(F.col("vec_id") % 100 == 0)


_VEC = """
vec AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)"""
_PAIRS = (
    _VEC
    + """,
pairs AS (SELECT q.vec_id AS q, q.label, b.vec_id AS b, 1 - list_dot_product(q.e, b.e) / (q.n * b.n) AS d
  FROM vec q JOIN vec b ON q.vec_id % 100 = 0 AND q.vec_id <> b.vec_id)"""
)

_NEAREST_SQL = o.chain(
    _VEC,
    """every_pair AS (SELECT q.vec_id AS q, b.vec_id AS b, 1 - list_dot_product(q.e, b.e) / (q.n * b.n) AS d
      FROM vec q JOIN vec b ON q.vec_id <> b.vec_id)""",
    select="""SELECT CAST(q AS VARCHAR) AS id, CAST(b AS VARCHAR) AS neighbour, round(d, 6) AS distance FROM (
      SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, CAST(b AS VARCHAR)) AS r FROM every_pair) WHERE r <= 5""",
)


def _neighbours(df: DataFrame) -> DataFrame:
    flat = df.select("id", F.explode("nearest").alias("x"))
    return flat.select("id", F.col("x.id").alias("neighbour"), F.round("x.distance", 6).alias("distance"))


@query(_NEAREST_SQL)
def nearest_vectors(spark, sf):
    """Every vector that has an id against all others."""
    v = _all_vectors(spark, sf)
    return _neighbours(ve.nearest(v.where("id IS NOT NULL"), v, k=5, exclude_self=True))


@query(_NEAREST_SQL)
def nearest_vectors_cells(spark, sf):
    """The same search with the plan for a baseline that is too large to broadcast."""
    v = _all_vectors(spark, sf)
    return _neighbours(ve.nearest(v.where("id IS NOT NULL"), v, k=5, cfg=Settings(baseline_broadcast_bytes=0), exclude_self=True))


_MID = """
mid0 AS (SELECT a.vec_id, list_transform(list_zip(a.e, b.e), lambda p: p[1] / a.n - 0.5 * p[2] / b.n) AS e
  FROM vec a JOIN vec b ON b.vec_id = (a.vec_id + 1) % (SELECT count(*) FROM vec)),
mid AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM mid0),
vs AS (SELECT q.vec_id, greatest(0, least(2, min(1 - list_dot_product(q.e, b.e) / (q.n * b.n)))) AS score FROM mid q CROSS JOIN vec b GROUP BY 1)"""


def _between(spark, sf) -> DataFrame:
    """(id, embedding): vectors that aren't in the table, each the difference of two that are."""
    v = _all_vectors(spark, sf)
    n = v.agg(F.count(F.lit(1)).alias("n")).scalar()
    after = v.select(F.pmod(F.col("vec_id") - 1, n).alias("vec_id"), ve.unit(F.col("embedding")).alias("next"))
    both = v.select("vec_id", "id", ve.unit(F.col("embedding")).alias("own")).join(after, "vec_id")
    return both.select("id", F.zip_with("own", "next", lambda x, y: x - 0.5 * y).alias("embedding"))


@query(o.chain(_VEC, _MID, select="SELECT CAST(vec_id AS VARCHAR) AS id, round(score, 6) AS score FROM vs"))
def anomaly_scores(spark, sf):
    """Vectors that aren't in the baseline against all of its rows."""
    return ve.anomaly_score(_between(spark, sf), _all_vectors(spark, sf)).select("id", F.round("score", 6).alias("score"))


@query(
    o.chain("""vec AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)""",
      select="""SELECT CAST(q.vec_id AS VARCHAR) AS id, round(min(1 - list_dot_product(q.e, b.e) / (q.n * b.n)), 6) AS score
      FROM vec q JOIN vec b ON q.vec_id <> b.vec_id GROUP BY 1""")
)
def anomaly_scores_without_self(spark, sf):
    v = ft.read(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding")
    return ve.anomaly_score(v, v, exclude_self=True).select("id", F.round("score", 6).alias("score"))


@query(
    """SELECT count(*) AS indexed, count(*) FILTER (vec_id % 100 = 0) AS asked, true AS recalled, true AS cheaper FROM embeddings"""
)
def nearest_index_recall(spark, sf):
    """Of the five nearest of every row whose id is divisible by 100, whether the index finds at least 0.9, looking at fewer
    rows than there are pairs."""
    v = _all_vectors(spark, sf).select("id", "vec_id", "embedding")
    asked = _asked(v)
    index = vi.build_index(v, scratch_path(spark, "index"))
    flat = lambda df: df.select("id", F.explode("nearest.id").alias("hit"))
    exact = flat(ve.nearest(asked, v, k=5, exclude_self=True)).groupBy("id", "hit").agg(F.lit(1).alias("wanted"))
    found = flat(vi.nearest_indexed(asked, index, k=5, exclude_self=True)).withColumn("found", F.lit(1))
    share = exact.join(found, ["id", "hit"], "left").agg((F.sum("found") >= 0.9 * F.sum("wanted")).alias("recalled"))
    counts = index.rows.agg(F.count("*").alias("indexed"), F.count_if(F.col("id").cast("bigint") % 100 == 0).alias("asked"))
    pairs = vi.compared_pairs(asked, index)
    return counts.crossJoin(F.broadcast(share)).withColumn("cheaper", F.lit(pairs) < F.col("indexed") * F.col("asked"))


@query(
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
       SELECT a.vec_id, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM v a JOIN v b ON b.vec_id = a.vec_id + 1"""
)
def cosine_similarity(spark, sf):
    v = ft.read(spark, sf, "embeddings")
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return v.join(after, "vec_id").select("vec_id", F.round(ve.cosine(F.col("embedding"), F.col("next")), 6).alias("similarity"))


@query(
    """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
       u AS (SELECT vec_id, label, generate_subscripts(e, 1) AS pos, unnest(e) / sqrt(list_dot_product(e, e)) AS x FROM v),
       c AS (SELECT label, pos, avg(x) AS x FROM u GROUP BY 1, 2),
       cc AS (SELECT label, list(x ORDER BY pos) AS c FROM c GROUP BY 1),
       s AS (SELECT v.vec_id, cc.label, greatest(0, least(1, (list_cosine_similarity(v.e, cc.c) + 1) / 2)) AS s FROM v CROSS JOIN cc)
       SELECT vec_id, round(max(s), 6) AS ml_score, 'label-' || arg_max(label, s) AS ml_label FROM s GROUP BY 1"""
)
def anchor_scores(spark, sf):
    v = ft.read(spark, sf, "embeddings")
    anchors = v.select(F.concat(F.lit("label-"), "label").alias("label"), F.col("label").alias("rank"), "embedding")
    return ve.anchor_score(v, anchors).select("vec_id", F.round("ml_score", 6).alias("ml_score"), "ml_label")


@query(
    """WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-zA-Z0-9_]+'), lambda x: x <> '')) AS word FROM documents),
       n AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY 1, 2),
       s AS (SELECT doc_id, count(*) AS words, sum(n) AS total, max(n) AS most FROM n GROUP BY 1)
       SELECT doc_id, coalesce(words, 0)::BIGINT AS words, (words IS NOT NULL)::INTEGER::DOUBLE AS length FROM documents LEFT JOIN s USING (doc_id)"""
)
def vectorized_text(spark, sf):
    """All texts; with so many cells that words don't meet, a vector has one entry per word. Texts without words are zero."""
    v = ve.vectorize(ft.read(spark, sf, "documents").select("doc_id", "text"), "text", 1 << 30, sparse=True)
    return v.select("doc_id", F.size("embedding.indices").cast("bigint").alias("words"), F.round(F.sqrt(ve.dot(F.col("embedding.values"), F.col("embedding.values"))), 4).alias("length"))


# --- detection --------------------------------------------------------------------------------------------------------


def _scored_logs(spark, sf) -> DataFrame:
    """Logs with the score of the vector their event id points to: its distance to the nearest of all others."""
    v = _all_vectors(spark, sf).select("id", "embedding")
    # All pairs are compared once, whatever the query reads the logs for.
    scores = _stored(ve.anomaly_score(v, v, exclude_self=True).select("id", F.round(F.col("score") * 1.35, 6).alias("score")), "scores")
    n = v.agg(F.count(F.lit(1)).alias("n")).scalar()
    logs = _logs(spark, sf).withColumn("id", (F.col("arrival_seq") % n).cast("string"))
    # Every vector has thousands of logs, so logs don't move by it while the scores are small enough to be sent around.
    return logs.join(broadcast_up_to(scores, v.count(), row_bytes=64), "id").drop("id")


_SCORES = """
vec AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
vs AS (SELECT q.vec_id, round(greatest(0, least(2, min(1 - list_dot_product(q.e, b.e) / (q.n * b.n)))) * 1.35, 6) AS score
  FROM vec q JOIN vec b ON q.vec_id <> b.vec_id GROUP BY 1)"""

_DET = f"""
det0 AS (
  SELECT l.*, vs.score, event IN ({o._list(fixed.ANOMALY_TYPES)}) OR {o._contains_any("lower(message)", fixed.BAD_TEXT_TOKENS)} AS bad,
    event IN ({o._list(fixed.BENIGN_EVENTS)}) AS benign_event
  FROM rows_ l JOIN vs ON vs.vec_id = l.event_id % (SELECT count(*) FROM embeddings)),
det AS (
  SELECT *, NOT bad AND benign_event AS benign,
    CASE WHEN bad THEN 0.2 WHEN benign_event THEN 0.99 WHEN level IN ('info', 'debug') THEN 0.98
         WHEN level = 'warning' THEN 0.99 ELSE 0.95 END::DOUBLE AS threshold
  FROM det0),
dd AS (SELECT *, bad OR score > threshold AS is_anomaly, 1 / (1 + exp(-(score - threshold) * 10)) AS conf FROM det)"""

_DETS = (o.EV, _SCORES, _DET)


@query(o.chain(*_DETS, select="SELECT log_id, is_anomaly, bad AS rule_lane_triggered, threshold, round(score, 6) AS score, round(conf, 6) AS confidence FROM dd"))
def detect_logs(spark, sf):
    return dt.detect_scored(_scored_logs(spark, sf)).select(
        "log_id", "is_anomaly", "rule_lane_triggered", F.col("embedding_lane_threshold").alias("threshold"),
        F.round("anomaly_score", 6).alias("score"), F.round("detect_confidence", 6).alias("confidence"),
    )


def _with_vectors(spark, sf, logs: DataFrame) -> DataFrame:
    """Logs with the ``embedding`` that their arrival number points to."""
    vectors = _stored(_between(spark, sf).select(F.col("id").alias("_id"), "embedding"), "vectors")
    size = ve.baseline_size(vectors)
    at = F.pmod(F.col("arrival_seq"), F.lit(size.rows)).cast("string")
    return logs.join(broadcast_up_to(vectors, size.rows, 8 * size.dim), at == F.col("_id")).drop("_id")


_WITH_BASELINE = (o.EV, _VEC, _MID, _DET)


@query(
    o.chain(*_WITH_BASELINE, select="""SELECT log_id, is_anomaly, bad AS rule_lane_triggered, threshold, round(score, 6) AS score,
      round(conf, 6) AS confidence FROM dd""")
)
def detect_with_baseline(spark, sf):
    """Logs with vectors, scored against every vector of the table."""
    out = dt.detect(_with_vectors(spark, sf, _logs(spark, sf)), _all_vectors(spark, sf).select("id", "embedding"))
    return out.select(
        "log_id", "is_anomaly", "rule_lane_triggered", F.col("embedding_lane_threshold").alias("threshold"),
        F.round("anomaly_score", 6).alias("score"), F.round("detect_confidence", 6).alias("confidence"),
    )


def _mode(mode: str, shadow: bool) -> Query:
    cfg = Settings(decision_mode=mode, shadow_mode=shadow)
    return lambda spark, sf: dt.detect_scored(_scored_logs(spark, sf), cfg).select("log_id", "is_anomaly", "arbitration_mode")


for _m, _sql in {
    "embedding_only": "score > threshold AND NOT benign",
    "rule_or_embedding": "(bad OR score > threshold) AND NOT benign",
    "rule_and_embedding": "bad AND score > threshold AND NOT benign",
    "rule_first": "(bad OR score > threshold) AND NOT benign",
}.items():
    QUERIES[f"arbitrate_{_m}"] = _mode(_m, False)
    ORACLE[f"arbitrate_{_m}"] = o.chain(*_DETS, select=f"SELECT log_id, {_sql} AS is_anomaly, '{_m}' AS arbitration_mode FROM det")


@query(o.chain(o.EV, select="SELECT log_id, false AS is_anomaly, 0.0::DOUBLE AS anomaly_score, NULL::DOUBLE AS embedding_lane_threshold FROM logs"))
def detect_without_baseline(spark, sf):
    few = ft.read(spark, sf, "embeddings").where("vec_id < 25").select(F.col("vec_id").cast("string").alias("id"), "embedding")
    out = dt.detect(ve.vectorize(_logs(spark, sf), dim=64), few)
    return out.select("log_id", "is_anomaly", "anomaly_score", "embedding_lane_threshold")


@query(
    o.chain(o.EV, o.CONV, select="""SELECT log_id, (length(text) %% 40) / 100.0::DOUBLE > 0.3 AS is_anomaly FROM conv
      UNION ALL SELECT log_id, (length(message) %% 40) / 40.0::DOUBLE
          > CASE WHEN bad THEN 0.90 WHEN benign THEN 0.99 WHEN level IN ('info', 'debug') THEN 0.98 WHEN level = 'warning' THEN 0.99 ELSE 0.95 END OR bad
        FROM (SELECT *, NOT bad AND event IN (%s) AS benign FROM (SELECT *, event IN (%s) OR %s AS bad FROM rows_))"""
      % (o._list(fixed.BENIGN_EVENTS), o._list(fixed.ANOMALY_TYPES), o._contains_any("lower(message)", fixed.BAD_TEXT_TOKENS)))
)
def threshold_by_protocol(spark, sf):
    cfg = Settings(anomaly_threshold=0.35, threshold_mcp=0.90, threshold_a2a=0.30)
    messages = _messages(spark, sf).withColumn("score", (F.length("message_content") % 40) / 100.0)
    logs = _logs(spark, sf).withColumn("score", (F.length("reasoning_step") % 40) / 40.0)
    return dt.detect_scored(logs.unionByName(messages, allowMissingColumns=True), cfg).select("log_id", "is_anomaly")


_KNOWN = o._list(fixed.TOOL_DOMAIN)
_CLS = f"""
cls AS (
  SELECT *, {o._domain("event", fixed.CLASSIFIER_HINTS)} AS wanted, lower(event) || ' ' || level || ' ' || lower(message) || ' ' || lower(meta_text) AS combined,
    list_filter(string_split_regex(lower(message), '\\s+'), lambda x: x <> '') AS mw FROM dd),
cls2 AS (
  SELECT *, CASE WHEN NOT is_anomaly THEN NULL
    WHEN event IN ({o._list(fixed.ANOMALY_TYPES)}) THEN event
    {" ".join(f"WHEN {o._contains_any('combined', t)} THEN '{k}'" for k, t in fixed.CLASSIFIER_TOKENS.items())}
    WHEN tool NOT IN ({_KNOWN}) THEN 'TOOL_HALLUCINATION'
    WHEN (level = 'error' AND (contains(event, 'TIMEOUT') OR contains(event, 'FAIL') OR contains(event, 'ERROR')))
      OR (level = 'error' AND contains(event, 'TOOL_CALL')) THEN 'DELEGATION_CHAIN_FAILURE'
    WHEN wanted <> 'design' THEN 'REGISTRY_OVERFLOW' END AS rule_type
  FROM cls),
cl AS (
  SELECT *, rule_type AS anomaly_type, CASE WHEN NOT is_anomaly THEN 1.0 WHEN rule_type IS NOT NULL THEN 0.85 ELSE 0.7 END::DOUBLE AS class_conf,
    CASE WHEN NOT is_anomaly THEN 'none' ELSE 'rule' END AS method,
    CASE WHEN NOT is_anomaly THEN 'Not anomalous' WHEN rule_type IS NOT NULL THEN 'Rule match'
         ELSE 'No explicit MCP anomaly signature matched' END AS reasoning
  FROM cls2)"""
_CLASSES = (*_DETS, _CLS)


def _classified(spark, sf) -> DataFrame:
    return cl.classify(dt.detect_scored(_scored_logs(spark, sf)))


@query(o.chain(*_CLASSES, select="SELECT log_id, anomaly_type, class_conf AS confidence, method, reasoning FROM cl"))
def classify_logs(spark, sf):
    return _classified(spark, sf).select("log_id", "classification.*")


@query(
    o.chain(o.CONV, select="""SELECT log_id, CASE WHEN response_status IN ('partial', 'success') THEN 'CONTEXT_POISONING'
        WHEN depth >= 3 AND response_status = 'error' THEN 'DELEGATION_CHAIN_FAILURE' END AS anomaly_type,
      CASE WHEN response_status IN ('partial', 'success') OR (depth >= 3 AND response_status = 'error') THEN 'rule' ELSE 'llm' END AS method FROM conv""")
)
def classify_messages(spark, sf):
    rows = cl.classify(_messages(spark, sf).withColumn("is_anomaly", F.lit(True)))
    return rows.select("log_id", "classification.anomaly_type", "classification.method")


_GAP = f"""
gap0 AS (
  SELECT log_id, {o._domain("event", fixed.OUTCOME_HINTS)} AS wanted, level FROM logs
  UNION ALL SELECT log_id, {o._domain("task_intent", fixed.OUTCOME_HINTS)}, CASE WHEN response_status IN ('error', 'timeout') THEN 'error' END FROM conv),
gap AS (
  SELECT log_id, least(1.0, CASE WHEN log_id NOT LIKE 'evt-%' THEN 0.4 WHEN wanted IS NULL THEN 0.55 WHEN wanted = 'design' THEN 0.1 ELSE 0.85 END
    + CASE WHEN level = 'error' THEN 0.15 ELSE 0 END)::DOUBLE AS gap FROM gap0)"""


def _both(spark, sf) -> DataFrame:
    return _logs(spark, sf).unionByName(_messages(spark, sf))


@query(o.chain(o.EV, o.CONV, _GAP, select="SELECT log_id, round(gap, 4) AS gap_score, round(1 - gap, 4) AS coherence_score FROM gap"))
def intent_outcome(spark, sf):
    return cl.intent_outcome(_both(spark, sf)).select("log_id", "gap_score", "coherence_score")


@query(
    o.chain(o.EV, o.CONV, _GAP, select="""SELECT count(*) AS total_logs, round(avg(gap), 4) AS avg_intent_outcome_gap,
      round(avg(1 - gap), 4) AS avg_thought_action_coherence, count(*) FILTER (gap >= 0.7) AS high_gap_count FROM gap""")
)
def cognitive_stats(spark, sf):
    return st.cognitive_stats(_both(spark, sf))


# --- whole run and statistics -----------------------------------------------------------------------------------------


def _processed(spark, sf) -> DataFrame:
    return pr.process_scored(_scored_logs(spark, sf))


_PROC = """
proc AS (SELECT *, max({'us': us, 'neg': -arrival_seq, 'id': log_id, 'anom': is_anomaly}) OVER (PARTITION BY session_id ORDER BY arrival_seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM cl)"""
_PROCS = (*_CLASSES, _PROC)


@query(
    o.chain(*_PROCS, select="""SELECT log_id, is_anomaly, anomaly_type, p.id AS previous, CASE WHEN is_anomaly THEN log_id END AS root_cause_log_id,
      CASE WHEN NOT is_anomaly THEN NULL WHEN conf <= 0.7 THEN 'Confidence below explanation threshold; skipping LLM explanation.'
        ELSE 'Detected ' || coalesce(anomaly_type, 'None') || ' with anomaly score ' || printf('%.3f', score) || '. Likely root cause log is ' || log_id || '.' END AS explanation
      FROM proc""")
)
def process_logs(spark, sf):
    return _processed(spark, sf).select(
        "log_id", "is_anomaly", "classification.anomaly_type", F.col("prev.log_id").alias("previous"), "root_cause_log_id", "explanation"
    )


@query(
    o.chain(*_WITH_BASELINE, _CLS, _PROC, select="""SELECT log_id, is_anomaly, anomaly_type, p.id AS previous,
      CASE WHEN is_anomaly THEN log_id END AS root_cause_log_id FROM proc""")
)
def process_with_baseline(spark, sf):
    out = pr.process(_with_vectors(spark, sf, _logs(spark, sf)), _all_vectors(spark, sf).select("id", "embedding"))
    return out.select("log_id", "is_anomaly", "classification.anomaly_type", F.col("prev.log_id").alias("previous"), "root_cause_log_id")


_A2A_JUDGED = """
msg AS (
  SELECT c.*, vs.score, vs.score > 0.2 AS is_anomaly FROM conv c JOIN vs ON vs.vec_id = c.arrival_seq % (SELECT count(*) FROM embeddings)),
group_rows AS (
  SELECT log_id, is_anomaly, anomaly_type, score FROM cl
  UNION ALL SELECT log_id, is_anomaly, CASE WHEN NOT is_anomaly THEN NULL WHEN response_status IN ('partial', 'success') THEN 'CONTEXT_POISONING'
    WHEN depth >= 3 AND response_status = 'error' THEN 'DELEGATION_CHAIN_FAILURE' END, score FROM msg)"""


@query(
    o.chain(*_WITH_BASELINE, _CLS, o.CONV, _A2A_JUDGED, select="""SELECT log_id, is_anomaly, anomaly_type, round(score, 6) AS anomaly_score,
      CASE WHEN is_anomaly THEN log_id END AS root_cause_log_id FROM group_rows""")
)
def group_analysis_mixed(spark, sf):
    """Logs of both protocols: detection and classification row by row."""
    rows = _logs(spark, sf).unionByName(_messages(spark, sf), allowMissingColumns=True)
    out = pr.analyze_group(_with_vectors(spark, sf, rows), _all_vectors(spark, sf).select("id", "embedding"))
    return out.select("log_id", "is_anomaly", "anomaly_type", F.round("anomaly_score", 6).alias("anomaly_score"), "root_cause_log_id")


@query(
    o.chain(o.RAW, o.CONV, select="""SELECT arrival_seq, 'MCP' AS protocol, n_errors AS errors FROM norm WHERE n_errors <> ''
      UNION ALL SELECT -1 - arrival_seq, 'A2A', errors FROM (SELECT arrival_seq, CASE (conv_id + turn) % 9 WHEN 1 THEN 'session_id' WHEN 2 THEN 'target_agent'
        WHEN 3 THEN 'delegation_depth|delegation_chain length' WHEN 4 THEN CASE WHEN depth >= 2 THEN 'delegation_chain length' ELSE '' END
        WHEN 5 THEN 'response_status' WHEN 6 THEN 'latency_ms' ELSE '' END AS errors FROM conv) WHERE errors <> ''""")
)
def group_failures(spark, sf):
    """What a mixed group of raw records can't be read from, kept with its errors."""
    mcp = _raw(spark, sf).select("arrival_seq", "raw")
    a2a = ft.raw_messages(ft.read(spark, sf, "conversations")).select((-1 - F.col("arrival_seq")).alias("arrival_seq"), "raw")
    encode = lambda logs: _with_vectors(spark, sf, logs)
    _, failures, _ = pr.analyze_raw_group(mcp.unionByName(a2a), _all_vectors(spark, sf).select("id", "embedding"), encode)
    kind = F.when(F.col("arrival_seq") < 0, "A2A").otherwise("MCP")
    return failures.select("arrival_seq", kind.alias("protocol"), _joined("errors").alias("errors"))


@query(
    o.chain(*_CLASSES, """t AS (SELECT coalesce(anomaly_type, 'None') || '=' || count(*) AS pair FROM cl WHERE is_anomaly GROUP BY anomaly_type)""",
      select="""SELECT count(*) AS total_logs, count(*) FILTER (is_anomaly) AS anomaly_count,
      round(count(*) FILTER (is_anomaly) / count(*)::DOUBLE, 6) AS anomaly_rate, (SELECT string_agg(pair, '|' ORDER BY pair) FROM t) AS type_distribution FROM cl""")
)
def overall_stats(spark, sf):
    pairs = F.transform(F.array_sort(F.map_entries("type_distribution")), lambda e: F.concat(e.key, F.lit("="), e.value))
    return st.stats(_classified(spark, sf)).withColumns(
        {"anomaly_rate": F.round("anomaly_rate", 6), "type_distribution": F.array_join(pairs, "|")}
    )


@query(o.chain(*_CLASSES, select="""SELECT anomaly_type, count(*) AS "count" FROM cl WHERE is_anomaly GROUP BY 1 HAVING count(*) >= 2"""))
def recurring_anomalies(spark, sf):
    return st.recurring(_classified(spark, sf))


@query(
    o.chain(*_CLASSES, select="""SELECT log_id, is_anomaly, anomaly_type, CASE WHEN is_anomaly THEN class_conf END AS confidence FROM cl
      ORDER BY us DESC, arrival_seq LIMIT 10""")
)
def latest_logs(spark, sf):
    return st.latest(_classified(spark, sf)).select("log_id", "is_anomaly", "anomaly_type", "confidence")


@query(
    o.chain(*_CLASSES, select="""SELECT log_id, us, round(score, 6) AS anomaly_score, class_conf AS confidence FROM cl
      WHERE is_anomaly AND anomaly_type = 'TOOL_HALLUCINATION' AND agent_id = 'agent-3'""")
)
def anomaly_list(spark, sf):
    rows = st.list_anomalies(_classified(spark, sf), "TOOL_HALLUCINATION", "agent-3")
    return rows.select("log_id", _us().alias("us"), F.round("anomaly_score", 6).alias("anomaly_score"), "confidence")


@query(
    o.chain(*_CLASSES, select="""SELECT log_id, anomaly_type, reasoning FROM cl WHERE is_anomaly
      AND log_id = (SELECT 'evt-' || max(event_id) FROM cl WHERE is_anomaly)""")
)
def anomaly_detail(spark, sf):
    rows = _classified(spark, sf)
    newest = rows.where("is_anomaly").agg(F.max("arrival_seq").alias("m")).first()["m"]
    return st.anomaly_detail(rows, f"evt-{newest}").select("log_id", "classification.anomaly_type", "classification.reasoning")


@query(
    o.chain(*_CLASSES, """h AS (SELECT us // 3600000000 AS h, count(*) AS n FROM (SELECT us FROM cl WHERE is_anomaly
      UNION ALL SELECT us + 36000000000 FROM cl WHERE is_anomaly AND event_id % 50 = 0) GROUP BY 1)""",
      """axis AS (SELECT unnest(range((SELECT min(h) FROM h), (SELECT max(h) FROM h) + 1)) AS h)""",
      select="SELECT axis.h * 3600 AS hour, coalesce(n, 0) AS anomalies FROM axis LEFT JOIN h USING (h)")
)
def anomalies_per_hour(spark, sf):
    rows = _classified(spark, sf)
    # Every 50th row again ten hours later, so that there are empty hours.
    late = rows.where(F.col("arrival_seq") % 50 == 0).withColumn("ts", F.col("ts") + F.expr("interval 10 hours"))
    return st.hourly(rows.unionByName(late)).select(F.unix_seconds("hour").alias("hour"), "anomalies")


@query(
    o.chain(*_CLASSES, select=f"""SELECT t.anomaly_type, count(c.log_id) AS "count" FROM (SELECT unnest([{o._list(fixed.ANOMALY_TYPES)}]) AS anomaly_type) t
      LEFT JOIN cl c ON c.is_anomaly AND c.anomaly_type = t.anomaly_type GROUP BY 1""")
)
def type_distribution_fixed(spark, sf):
    return st.type_distribution(_classified(spark, sf), fixed_types=True)


@query(o.chain(*_CLASSES, select="""SELECT anomaly_type, count(*) AS "count" FROM cl WHERE is_anomaly AND anomaly_type IS NOT NULL GROUP BY 1"""))
def type_distribution(spark, sf):
    return st.type_distribution(_classified(spark, sf))


@query(
    o.chain(*_CLASSES, select="""SELECT count(*) FILTER (bad) AS rule_lane_count, round(avg(score), 6) AS avg_score, round(avg(threshold), 6) AS avg_threshold FROM cl WHERE is_anomaly""")
)
def lane_diagnostics(spark, sf):
    out = st.lane_diagnostics(_classified(spark, sf))
    return out.select("rule_lane_count", F.round("avg_score", 6).alias("avg_score"), F.round("avg_threshold", 6).alias("avg_threshold"))


@query(o.chain(*_CLASSES, select="""SELECT 'rule_first' AS arbitration_mode, count(*) AS "count" FROM cl"""))
def arbitration_modes(spark, sf):
    return st.mode_counts(_classified(spark, sf))


@query(
    o.chain(*_CLASSES, select="""SELECT agent_id, count(*) AS logs, count(*) FILTER (is_anomaly) AS anomalies, round(count(*) FILTER (is_anomaly) / count(*)::DOUBLE, 6) AS anomaly_rate,
      round(coalesce(avg(score) FILTER (is_anomaly), 0), 6) AS avg_anomaly_score FROM cl GROUP BY 1""")
)
def group_stats(spark, sf):
    out = st.group_stats(_classified(spark, sf), "agent_id")
    return out.withColumns({c: F.round(c, 6) for c in ("anomaly_rate", "avg_anomaly_score")})


@query(
    o.chain(*_CLASSES, select="""SELECT count(*) AS total_logs_analysed, count(*) FILTER (is_anomaly) AS anomalies_found,
      round_even(count(*) FILTER (is_anomaly) / count(*)::DOUBLE * 100, 2) AS anomaly_density_pct, count(*) FILTER (bad) AS rule_lane_triggered_count,
      round_even(avg(score), 4) AS avg_embedding_lane_score, round_even(avg(threshold), 4) AS avg_embedding_lane_threshold,
      'rule_first=' || count(*) AS modes FROM cl""")
)
def lane_summary(spark, sf):
    out = st.lane_summary(_classified(spark, sf))
    pairs = F.transform(F.map_entries("by_arbitration_mode"), lambda e: F.concat(e.key, F.lit("="), e.value))
    return out.withColumn("modes", F.array_join(pairs, "|")).drop("by_arbitration_mode")


@query(
    """WITH e AS (SELECT min(value) AS a, max(value) AS b FROM events),
       c AS (SELECT least(CAST(floor((value - a) / (b - a) * 20) AS INTEGER), 19) AS bin, count(*) AS n FROM events, e GROUP BY 1)
       SELECT r.bin, coalesce(n, 0) AS "count" FROM (SELECT unnest(range(20)) AS bin) r LEFT JOIN c USING (bin)"""
)
def score_histogram(spark, sf):
    return st.histogram(ft.read(spark, sf, "events"), "value")


_CAUSE = """
causes AS (SELECT log_id, anomaly_type, coalesce(anomaly_type, 'UNKNOWN') || ' | ' || tool || ' | ' || event || ' | ' || reasoning AS cause_key FROM cl WHERE is_anomaly)"""


def _causes(spark, sf) -> DataFrame:
    return st.cause_table(_classified(spark, sf).withColumn("root_cause_log_id", F.col("log_id")))


@query(o.chain(*_CLASSES, _CAUSE, select="SELECT log_id, anomaly_type, cause_key FROM causes"))
def cause_table(spark, sf):
    return _causes(spark, sf).select("log_id", "anomaly_type", "cause_key")


@query(o.chain(*_CLASSES, _CAUSE, select="""SELECT cause_key, count(*) AS "count" FROM causes GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30"""))
def top_causes(spark, sf):
    return st.top_causes(_causes(spark, sf))


@query(
    o.chain(*_CLASSES, _CAUSE, select="""SELECT 'type::' || coalesce(anomaly_type, 'None') AS source, 'cause::' || cause_key AS target, count(*) AS value FROM causes GROUP BY 1, 2""")
)
def cause_graph(spark, sf):
    return gr.cause_edges(_causes(spark, sf))


# --- graph ------------------------------------------------------------------------------------------------------------


@query(
    o.chain(*_CLASSES, select=f"""
      SELECT 'Event' AS kind, log_id AS key, NULL AS detail FROM cl
      UNION ALL SELECT DISTINCT 'Session', session_id, NULL FROM cl UNION ALL SELECT DISTINCT 'Agent', agent_id, NULL FROM cl
      UNION ALL SELECT DISTINCT 'Tool', tool, 'true' FROM cl
      UNION ALL SELECT 'ReasoningStep', message, arg_max(event, arrival_seq) FROM cl GROUP BY message
      UNION ALL SELECT 'Anomaly', log_id, coalesce(anomaly_type, 'UNKNOWN') FROM cl WHERE is_anomaly""")
)
def graph_vertices(spark, sf):
    v = gr.graph_vertices(_classified(spark, sf))
    detail = F.coalesce(F.col("is_known").cast("string"), "intent", "anomaly_type")
    return v.select("kind", "key", detail.alias("detail"))


@query(
    o.chain(*_CLASSES, select="""
      SELECT log_id AS src, session_id AS dst, 'PART_OF' AS type FROM cl UNION SELECT log_id, agent_id, 'EXECUTED_BY' FROM cl
      UNION SELECT log_id, tool, 'USED_TOOL' FROM cl UNION SELECT log_id, message, 'HAS_REASONING' FROM cl
      UNION SELECT log_id, log_id, 'DETECTED_IN' FROM cl WHERE is_anomaly""")
)
def graph_edges(spark, sf):
    return gr.graph_edges(_classified(spark, sf))


@query(o.chain(*_PROCS, select="SELECT log_id AS src, p.id AS dst, 'PRECEDED_BY' AS type, greatest(us - p.us, 0) // 1000 AS lag_ms FROM proc WHERE p IS NOT NULL"))
def temporal_edges(spark, sf):
    return gr.temporal_edges(gr.with_previous(_classified(spark, sf)))


_HINTS = "hints AS (SELECT log_id AS src, p.id AS dst, 'SEQUENTIAL_CAUSAL_HINT' AS type FROM proc WHERE is_anomaly AND p.anom)"


@query(o.chain(*_PROCS, _HINTS, select="SELECT * FROM hints"))
def causal_edges(spark, sf):
    return gr.causal_edges(gr.with_previous(_classified(spark, sf)))


_DELEG = """
cp AS (SELECT *, max({'us': us, 'neg': -arrival_seq, 'id': log_id}) OVER (PARTITION BY session_id ORDER BY arrival_seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM conv),
deleg AS (SELECT p.id AS src, log_id AS dst, 'DELEGATED_TO' AS type FROM cp WHERE p IS NOT NULL AND source_agent <> target_agent)"""


def _delegations(spark, sf) -> DataFrame:
    return gr.delegation_edges(gr.with_previous(_messages(spark, sf).withColumn("is_anomaly", F.lit(False))))


@query(o.chain(o.CONV, _DELEG, select="SELECT * FROM deleg"))
def delegation_edges(spark, sf):
    return _delegations(spark, sf)


@query(
    "WITH RECURSIVE " + ",\n".join([o.CONV, _DELEG, """
      walk AS (SELECT log_id, log_id AS node, 0 AS hops FROM conv
        UNION ALL SELECT w.log_id, d.src, w.hops + 1 FROM walk w JOIN deleg d ON d.dst = w.node WHERE w.hops < 5)"""])
    + " SELECT log_id, hops, node AS ancestor FROM walk WHERE hops > 0"
)
def delegation_trace(spark, sf):
    logs = _messages(spark, sf)
    return gr.delegation_trace(logs.select("log_id"), _delegations(spark, sf), logs).select("log_id", "hops", "ancestor")


def _caused(spark, sf) -> DataFrame:
    """CAUSED_BY edges for checks: the sequential hints under the other name, every third one missing."""
    hints = gr.causal_edges(gr.with_previous(_classified(spark, sf)))
    return hints.where(F.length("src") % 3 != 0).withColumn("type", F.lit("CAUSED_BY"))


_CAUSED = """
caused AS (SELECT src, dst FROM hints WHERE length(src) % 3 <> 0),
nb AS (SELECT src AS a, dst AS b FROM caused UNION ALL SELECT dst, src FROM caused),
trace AS (SELECT c.log_id, min(nb.b) AS root FROM cl c LEFT JOIN nb ON nb.a = c.log_id WHERE c.is_anomaly GROUP BY 1)"""


@query(
    o.chain(*_PROCS, _HINTS, _CAUSED, select="""SELECT log_id, coalesce(root, log_id) AS root_cause_log_id, CASE WHEN root IS NULL THEN 0 ELSE 1 END AS hop_count,
      log_id || coalesce('|' || root, '') AS chain FROM trace""")
)
def root_cause_trace(spark, sf):
    out = gr.trace_rca(_classified(spark, sf).where("is_anomaly"), _caused(spark, sf))
    return out.select("log_id", "root_cause_log_id", "hop_count", _joined("causal_chain").alias("chain"))


# Paths that visit no log twice, longest first, then by ids; and a hub that 10,000 logs point to, with a tail.
_HUB = """
hub AS (SELECT src, dst FROM caused UNION ALL SELECT 'leaf-' || lpad(CAST(i AS VARCHAR), 5, '0'), 'hub' FROM range(10000) t(i)
  UNION ALL SELECT * FROM (VALUES ('hub', 'a-tail-1'), ('a-tail-1', 'a-tail-2'), ('a-tail-2', 'leaf-00000')))"""


def _with_hub(spark, edges: DataFrame) -> DataFrame:
    leaf = F.concat(F.lit("leaf-"), F.lpad(F.col("id").cast("string"), 5, "0"))
    star = spark.range(10_000).select(leaf.alias("src"), F.lit("hub").alias("dst"))
    tail = spark.createDataFrame([("hub", "a-tail-1"), ("a-tail-1", "a-tail-2"), ("a-tail-2", "leaf-00000")], "src string, dst string")
    return edges.unionByName(star.unionByName(tail).withColumn("type", F.lit("CAUSED_BY")), allowMissingColumns=True)


@query(
    o.chain(*_PROCS, _HINTS, _CAUSED, _HUB, """
      u AS (SELECT src AS a, dst AS b FROM hub WHERE src <> dst UNION SELECT dst, src FROM hub WHERE src <> dst),
      near AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY b) AS r FROM u),
      starts AS (SELECT log_id FROM cl WHERE is_anomaly UNION SELECT 'hub' UNION SELECT 'a-tail-2' UNION SELECT 'leaf-' || lpad(CAST(i AS VARCHAR), 5, '0') FROM range(10000) t(i)),
      walk AS (SELECT log_id, log_id AS at, [log_id] AS chain FROM starts
        UNION ALL SELECT w.log_id, n.b, list_append(w.chain, n.b) FROM (SELECT * FROM walk WHERE len(chain) <= 3) w JOIN near n ON n.a = w.at AND n.r <= 12
          WHERE NOT list_contains(w.chain, n.b)),
      best AS (SELECT log_id, min({'n': -len(chain), 'c': chain}).c AS chain FROM walk GROUP BY 1)""",
      select="SELECT log_id, chain[-1] AS root_cause_log_id, len(chain) - 1 AS hop_count, array_to_string(chain, '|') AS chain FROM best")
    .replace("WITH ", "WITH RECURSIVE ", 1)
)
def root_cause_deepest(spark, sf):
    """Also over a hub of 10,000 logs; the statement follows the 12 smallest neighbours of a log, which is enough for it."""
    edges = _stored(_with_hub(spark, _caused(spark, sf).select("src", "dst", "type")), "edges")
    starts = _classified(spark, sf).where("is_anomaly").select("log_id").unionByName(edges.select(F.col("src").alias("log_id")).where("log_id LIKE 'leaf-%' OR log_id IN ('hub', 'a-tail-2')"))
    out = gr.trace_rca(starts, edges, mode="deepest")
    return out.select("log_id", "root_cause_log_id", "hop_count", _joined("causal_chain").alias("chain"))


@query(
    o.chain(*_PROCS, _HINTS, """
      t3 AS (SELECT c.log_id, h1.dst AS d1, h2.dst AS d2, h3.dst AS d3 FROM cl c LEFT JOIN hints h1 ON h1.src = c.log_id
        LEFT JOIN hints h2 ON h2.src = h1.dst LEFT JOIN hints h3 ON h3.src = h2.dst WHERE c.is_anomaly)""",
      select="""SELECT log_id, coalesce(d3, d2, d1, log_id) AS root_log_id, concat_ws('|', log_id, d1, d2, d3) AS nodes,
        CASE WHEN d3 IS NOT NULL THEN 3 WHEN d2 IS NOT NULL THEN 2 WHEN d1 IS NOT NULL THEN 1 ELSE 0 END AS n_edges FROM t3""")
)
def trigger_graph(spark, sf):
    rows = _classified(spark, sf)
    edges = _stored(gr.causal_edges(gr.with_previous(rows)), "edges")
    out = gr.trigger_graph(rows.where("is_anomaly"), edges, _stored(gr.graph_vertices(rows), "vertices"))
    return out.select("log_id", "root_log_id", _joined("nodes.id").alias("nodes"), F.size("edges").alias("n_edges"))


@query(
    o.chain(*_CLASSES, """s AS (SELECT session_id, coalesce(anomaly_type, 'UNKNOWN') AS t, count(*) AS n FROM cl WHERE is_anomaly GROUP BY 1, 2)""",
      select="""SELECT l.session_id, coalesce((SELECT sum(n) FROM s WHERE s.session_id = l.session_id), 0)::BIGINT AS anomaly_count,
        coalesce((SELECT string_agg(t || '=' || n, '|' ORDER BY t) FROM s WHERE s.session_id = l.session_id), '') AS types FROM (SELECT DISTINCT session_id FROM cl) l""")
)
def session_density(spark, sf):
    rows = _classified(spark, sf)
    out = gr.session_density(gr.graph_vertices(rows), gr.graph_edges(rows))
    pairs = F.transform(F.array_sort(F.map_entries("types")), lambda e: F.concat(e.key, F.lit("="), e.value))
    return out.select("session_id", "anomaly_count", F.array_join(pairs, "|").alias("types"))


# --- evaluation -------------------------------------------------------------------------------------------------------


def _labelled(spark, sf) -> DataFrame:
    """Every vector of the query set with its distance to the nearest of all others; rows that repeat one count once."""
    v = _all_vectors(spark, sf)
    scored = ve.anomaly_score(_asked(v), v, exclude_self=True).groupBy("id", "vec_id", "label").agg(F.min("score").alias("score"))
    return scored.select(
        "id",
        F.round("score", 6).alias("score"),
        F.when(F.col("label") >= 5, 1).otherwise(0).alias("label"),
        F.when(F.col("vec_id") % 3 == 0, "A2A").otherwise("MCP").alias("protocol"),
    )


_LAB = _PAIRS + f""",
lab AS (SELECT q, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS label, CASE WHEN q % 3 = 0 THEN 'A2A' ELSE 'MCP' END AS protocol,
  round(min(d), 6) AS score FROM pairs GROUP BY ALL),
taus AS (SELECT unnest([{", ".join(f"{t!r}::DOUBLE" for t in ev.TAUS)}]) AS tau)"""


def _sweep_sql(by: str) -> str:
    key = f"{by}," if by else ""
    return o.chain(
        _LAB,
        f"""sw AS (SELECT {key} tau, count(*) FILTER (score > tau AND label = 1) AS tp, count(*) FILTER (score > tau AND label = 0) AS fp,
          count(*) FILTER (score <= tau AND label = 1) AS fn FROM lab CROSS JOIN taus GROUP BY {key} tau)""",
        f"""f AS (SELECT {key} tau, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END::DOUBLE AS f1 FROM sw)""",
        select=f"""SELECT {key} round(tau, 2) AS threshold, round(f1, 6) AS f1 FROM (SELECT *, row_number() OVER ({"PARTITION BY " + by if by else ""}
          ORDER BY f1 DESC, tau) AS r FROM f) WHERE r = 1""",
    )


@query(_sweep_sql(""))
def threshold_sweep(spark, sf):
    return ev.threshold_sweep(_labelled(spark, sf)).withColumn("f1", F.round("f1", 6))


@query(_sweep_sql("protocol"))
def threshold_sweep_by_protocol(spark, sf):
    return ev.threshold_sweep(_labelled(spark, sf), "protocol").withColumn("f1", F.round("f1", 6))


@query(
    o.chain(_LAB, """c AS (SELECT count(*) FILTER (label = 0 AND score <= 0.5) AS tn, count(*) FILTER (label = 0 AND score > 0.5) AS fp,
        count(*) FILTER (label = 1 AND score <= 0.5) AS fn, count(*) FILTER (label = 1 AND score > 0.5) AS tp FROM lab)""",
      """a AS (SELECT avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END) AS auc
        FROM lab p JOIN lab n ON p.label = 1 AND n.label = 0)""",
      select="""SELECT tn, fp, fn, tp, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall,
        round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) AS f1, round(auc, 6) AS auc FROM c, a""")
)
def binary_metrics(spark, sf):
    out = ev.binary_metrics(_labelled(spark, sf), 0.5, Settings(hot_key_rows=10, hot_key_chunks=7))
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1", "auc")})


_KEY = """
akey AS (SELECT log_id, session_id, CASE WHEN kind = 'error' OR (kind = 'click' AND k % 12 IN (1, 2, 3, 11)) THEN 'anomaly' ELSE 'normal' END AS label,
    CASE WHEN kind = 'error' OR (kind = 'click' AND k % 12 IN (1, 2, 3, 11)) THEN kind ELSE '' END AS expected_kind,
    CASE WHEN kind = 'error' THEN 'REGISTRY_OVERFLOW' END AS expected_type FROM logs),
kx AS (SELECT a.*, f.log_id IS NOT NULL AS predicted, a.label = 'anomaly' AS expected, f.subtype, f.legacy, f.confidence, f.signals, f.context_rule_ids
  FROM akey a LEFT JOIN findings f USING (log_id))"""
_KEYS = (*_ALL, _KEY)


def _key(spark, sf) -> DataFrame:
    return ft.answer_key(ft.read(spark, sf, "events"))


@query(
    o.chain(*_KEYS, """m AS (SELECT count(*) FILTER (expected) AS e, count(*) FILTER (predicted) AS p, count(*) FILTER (expected AND predicted) AS tp FROM kx)""",
      select="""SELECT e AS expected_anomalies, p AS predicted_anomalies, tp AS true_positive, p - tp AS false_positive, e - tp AS false_negative,
        round(tp / p::DOUBLE, 6) AS precision, round(tp / e::DOUBLE, 6) AS recall, round(2.0::DOUBLE * tp / (p + e), 6) AS f1, tp || '/' || e AS score FROM m""")
)
def answer_key_match(spark, sf):
    return ev.key_match(fd.analyze(_logs(spark, sf)), _key(spark, sf))


@query(
    o.chain(*_KEYS, select="""SELECT CASE WHEN predicted THEN 'false_positive' ELSE 'false_negative' END AS kind, log_id FROM kx WHERE predicted <> expected""")
)
def answer_key_mismatches(spark, sf):
    return ev.key_mismatches(fd.analyze(_logs(spark, sf)), _key(spark, sf))


@query(
    o.chain(*_KEYS, """s AS (SELECT session_id, count(*) FILTER (expected) AS expected, count(*) FILTER (predicted) AS predicted, count(*) FILTER (expected AND predicted) AS tp,
        count(*) FILTER (NOT expected AND predicted) AS fp, count(*) FILTER (expected AND NOT predicted) AS fn FROM kx GROUP BY 1)""",
      select="SELECT *, CASE WHEN fp = 0 AND fn = 0 THEN 'PASS' ELSE 'FAIL' END AS match_status FROM s")
)
def session_matrix(spark, sf):
    return ev.session_matrix(fd.analyze(_logs(spark, sf)), _key(spark, sf))


@query(
    o.chain(*_KEYS, select="""SELECT log_id, session_id, label AS expected_label, expected_kind AS expected_anomaly_type,
      CASE WHEN predicted THEN 'anomaly' ELSE 'normal' END AS predicted_label, coalesce(subtype, '') AS predicted_anomaly_type, coalesce(legacy, '') AS predicted_legacy_type,
      coalesce(confidence, '') AS confidence, CASE WHEN predicted THEN 'rule_only' ELSE '' END AS promotion_source, CASE WHEN predicted THEN 'promoted' ELSE '' END AS policy_decision,
      '' AS ml_score, '' AS ml_label, coalesce(context_rule_ids, '') AS context_rule_ids, coalesce(signals, '') AS signals,
      CASE WHEN predicted = expected THEN 'PASS' ELSE 'FAIL' END AS match_status FROM kx""")
)
def log_comparison(spark, sf):
    return ev.log_comparison(fd.analyze(_logs(spark, sf)), _key(spark, sf))


@query(o.chain(*_ALL, select="""SELECT 'rule_only' AS promotion_source, count(*) AS "count" FROM findings"""))
def promotion_breakdown(spark, sf):
    return ev.promotion_breakdown(fd.analyze(_logs(spark, sf)))


@query(ORACLE["log_comparison"])
def report_files(spark, sf):
    """The log comparison as it is read back from the report files."""
    logs, path = _stored(_logs(spark, sf), "logs"), scratch_path(spark, "reports")
    reports.write_reports(logs, _stored(fd.analyze(logs), "findings"), _key(spark, sf), path)
    rows = spark.read.option("header", True).option("emptyValue", "").csv(f"{path}/log_comparison")
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in rows.columns])


@query(
    o.chain(*_DETS, select="""SELECT log_id, CASE WHEN event_id % 3 = 0 THEN false ELSE is_anomaly END AS is_anomaly, event_id % 3 = 0 AS rewritten,
      us FROM dd""")
)
def reloaded_logs(spark, sf):
    """Two batches of the processed table, the second one replacing every third log, loaded again."""
    rows = dt.detect_scored(_scored_logs(spark, sf)).withColumn("rewritten", F.lit(False))
    path = scratch_path(spark, "processed")
    store.upsert_processed(rows, path, 0)
    again = rows.where(F.col("arrival_seq") % 3 == 0).withColumns({"is_anomaly": F.lit(False), "rewritten": F.lit(True)})
    store.upsert_processed(again, path, 1)
    return store.load_processed(spark, path).select("log_id", "is_anomaly", "rewritten", _us().alias("us"))


@query(
    o.chain(*_KEYS, select="""SELECT log_id, expected_type AS expected_legacy_type, expected_type IS NOT NULL AS expected_is_anomaly, subtype AS prompt_type, legacy AS legacy_type,
      confidence, coalesce(signals, '') AS signals, legacy IS NOT DISTINCT FROM expected_type AS matched FROM kx""")
)
def verdict_table(spark, sf):
    return ev.verdict_table(fd.analyze(_logs(spark, sf)), _key(spark, sf))


@query(
    o.chain(*_KEYS, """x AS (SELECT expected_type AS type, 1 AS e, 0 AS f, CAST(legacy IS NOT DISTINCT FROM expected_type AS INT) AS m FROM kx
      UNION ALL SELECT legacy, 0, 1, 0 FROM kx)""", select="SELECT type, sum(e)::BIGINT AS expected, sum(f)::BIGINT AS found, sum(m)::BIGINT AS matched FROM x GROUP BY 1")
)
def verdict_totals(spark, sf):
    return ev.verdict_summary(ev.verdict_table(fd.analyze(_logs(spark, sf)), _key(spark, sf)))


@query(
    """WITH d AS (SELECT CASE quality WHEN 1 THEN 'good' ELSE 'bad' END AS truth, CASE WHEN n_chars > 1500 THEN 'good' WHEN n_chars > 300 THEN 'bad' END AS predicted
         FROM documents JOIN labels USING (doc_id)),
       p AS (SELECT coalesce(truth, 'None') AS t, coalesce(predicted, 'None') AS p FROM d),
       c AS (SELECT l AS label, count(*) FILTER (t = l AND p = l) AS tp, count(*) FILTER (t = l) AS support, count(*) FILTER (p = l) AS named
         FROM p CROSS JOIN (SELECT DISTINCT unnest([t, p]) AS l FROM p) GROUP BY 1),
       m AS (SELECT label, tp, support, CASE WHEN named > 0 THEN tp / named::DOUBLE ELSE 0 END AS pr, CASE WHEN support > 0 THEN tp / support::DOUBLE ELSE 0 END AS re,
         2.0::DOUBLE * tp / (named + support) AS f FROM c)
       SELECT label, round(pr, 6) AS precision, round(re, 6) AS recall, round(f, 6) AS f1, support FROM m
       UNION ALL SELECT 'accuracy', round(sum(tp) / sum(support)::DOUBLE, 6), round(sum(tp) / sum(support)::DOUBLE, 6), round(sum(tp) / sum(support)::DOUBLE, 6), sum(support)::BIGINT FROM m
       UNION ALL SELECT 'macro avg', round(avg(pr), 6), round(avg(re), 6), round(avg(f), 6), sum(support)::BIGINT FROM m
       UNION ALL SELECT 'weighted avg', round(sum(pr * support) / sum(support), 6), round(sum(re * support) / sum(support), 6), round(sum(f * support) / sum(support), 6), sum(support)::BIGINT FROM m"""
)
def class_report(spark, sf):
    n = F.col("n_chars")
    rows = ft.read(spark, sf, "documents").join(ft.read(spark, sf, "labels"), "doc_id").select(
        F.when(F.col("quality") == 1, "good").otherwise("bad").alias("truth"),
        F.when(n > 1500, "good").when(n > 300, "bad").alias("predicted"),
    )
    return ev.class_report(rows).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(
    """SELECT event_type, round(quantile_cont(value::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(value::DOUBLE, 0.95), 6) AS p95,
         round(quantile_cont(value::DOUBLE, 0.99), 6) AS p99 FROM events GROUP BY 1"""
)
def latency_percentiles(spark, sf):
    cfg = Settings(hot_key_rows=50, hot_key_chunks=40)
    out = ev.latency_percentiles(ft.read(spark, sf, "events"), "event_type", "value", cfg)
    return out.withColumns({c: F.round(c, 6) for c in ("p50", "p95", "p99")})


@query(o.chain(*_PROCS, _HINTS, _CAUSED, select="SELECT 1.0::DOUBLE AS precision_at_3, count(*) AS tested FROM trace"))
def root_cause_precision(spark, sf):
    return ev.rca_precision(gr.trace_rca(_classified(spark, sf).where("is_anomaly"), _caused(spark, sf)))
