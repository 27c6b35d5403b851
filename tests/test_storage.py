import json

import pytest
from pyspark.sql import functions as F

from agentlog.operators import evaluate
from agentlog.operators import findings as fd
from agentlog.operators.vectors import vectorize
from agentlog.operators.normalize import normalize
from agentlog.plans import fromtables as ft
from agentlog.plans.process import analyze_group, process
from agentlog.sources import jsonl, reports, store
from agentlog import Settings
from tests.builders import logs_of, message, notification, uid


def test_upsert_replaces_and_reloads_in_time_order(spark, tmp_path):
    logs = logs_of(spark, [notification(i, at=60 - i) for i in range(1, 6)]).withColumn("is_anomaly", F.col("arrival_seq") < 3)
    path = str(tmp_path / "processed")
    store.upsert_processed(logs, path, 0)
    changed = logs.where("arrival_seq = 1").withColumns({"is_anomaly": F.lit(False), "message_content": F.lit("new")})
    store.upsert_processed(changed, path, 1)
    store.upsert_processed(changed, path, 1)
    rows = store.load_processed(spark, path).collect()
    assert [r.log_id for r in rows] == [uid(i) for i in (5, 4, 3, 2, 1)]
    assert {r.log_id: (r.is_anomaly, r.message_content) for r in rows}[uid(2)] == (False, "new")
    store.compact(spark, path, str(tmp_path / "compacted"))
    assert store.load_processed(spark, str(tmp_path / "compacted")).count() == 5


def test_baseline_keeps_first_of_an_id(spark, tmp_path):
    logs = vectorize(logs_of(spark, [notification(1, message="first"), notification(1, message="second"), notification(2)]), dim=8)
    path = str(tmp_path / "baseline")
    store.write_baseline(logs, path)
    rows = {r.id: r for r in store.read_baseline(spark, path).collect()}
    assert len(rows) == 2 and rows[uid(1)].document.startswith("first")
    assert json.loads(rows[uid(2)].metadata.response_payload)["tool"] == "list_components"


def test_json_lines_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps(notification(i)) for i in range(1, 4)) + "\n\n{broken\n")
    (tmp_path / "b.jsonl").write_text(json.dumps(message(9)) + "\n")
    lines = jsonl.read_lines(spark, str(tmp_path))
    assert jsonl.ingest_counts(lines).first().asDict() == {"inserted": 4, "errors": 1, "total": 5}
    good, bad = jsonl.read_jsonl(spark, str(tmp_path))
    assert bad.count() == 1
    ids = [r.log_id for r in normalize(good)[0].orderBy("arrival_seq").collect()]
    assert ids == [uid(1), uid(2), uid(3), uid(9)]


def test_array_and_line_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x":1}, 5, {"x":2}]')
    (tmp_path / "b.json").write_text('{"x":3}\n\n{"x":4}')
    rows = jsonl.read_logs(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")]).collect()
    assert sorted((r.row, json.loads(r.raw)["x"]) for r in rows) == [(1, 1), (1, 3), (2, 2), (2, 4)]
    (tmp_path / "c.json").write_text('{"x":3}\n{broken')
    with pytest.raises(Exception, match="bad JSON line"):
        jsonl.read_logs(spark, str(tmp_path / "c.json")).collect()


def test_report_files(spark, tmp_path):
    records = [notification(1), notification(2, "UNKNOWN_TOOL", "error", "Method not found code -32601"), notification(3, "HEARTBEAT")]
    logs = logs_of(spark, records)
    key = spark.createDataFrame(
        [(uid(1), "s-1", "normal", ""), (uid(2), "s-1", "anomaly", "x"), (uid(3), "s-2", "anomaly", "x")],
        "log_id string, session_id string, label string, anomaly_type string",
    )
    found = fd.analyze(logs)
    reports.write_reports(logs, found, key, str(tmp_path / "r"))
    summary = spark.read.json(str(tmp_path / "r/summary")).first()
    assert (summary.totals.score, summary.totals.precision, summary.totals.recall) == ("1/2", 1.0, 0.5)
    assert summary.engine_session_summary.anomalies_found == 1
    matrix = spark.read.option("header", True).csv(str(tmp_path / "r/session_matrix")).collect()
    assert [(r.session_id, r.match_status) for r in matrix] == [("s-1", "PASS"), ("s-2", "FAIL")]
    misses = spark.read.json(str(tmp_path / "r/mismatches")).collect()
    assert [(r.kind, r.log_id) for r in misses] == [("false_negative", uid(3))]


def test_mixed_group_and_whole_run(spark):
    records = [notification(i, at=i) for i in range(1, 5)] + [message(20 + i, at=i, response_status="error") for i in range(3)]
    logs = vectorize(logs_of(spark, records), dim=32)
    base = logs.where("protocol = 'MCP'").select(F.col("log_id").alias("id"), "embedding")
    cfg = Settings(min_baseline_rows=1)
    group = analyze_group(logs, base, cfg).collect()
    assert len(group) == 7 and {r.is_anomaly for r in group if r.protocol == "A2A"} == {True}
    edges = spark.createDataFrame([(uid(20), uid(21), "CAUSED_BY")], "src string, dst string, type string")
    done = {r.log_id: r for r in process(logs, base, edges, cfg).collect()}
    assert done[uid(20)].root_cause_log_id == uid(21) and done[uid(20)].hop_count == 1
    assert done[uid(22)].root_cause_log_id == uid(22) and done[uid(1)].explanation is None


def test_exact_percentiles_do_not_depend_on_the_split(spark):
    import numpy as np

    values = [(k, float((i * 37) % 101)) for k in ("a", "b") for i in range(300 if k == "a" else 7)]
    df = spark.createDataFrame(values, "k string, latency_ms double")
    for cfg in (Settings(hot_key_rows=None), Settings(hot_key_rows=20, hot_key_chunks=9)):
        for r in evaluate.latency_percentiles(df, "k", cfg=cfg).collect():
            own = [v for k, v in values if k == r.k]
            assert [r.p50, r.p95, r.p99] == pytest.approx(list(np.percentile(own, [50, 95, 99])))


def test_given_tables_hold_all_session_rules(spark):
    logs = ft.agent_logs(ft.read(spark, "/root/testdata/sf0.001", "events"))
    rules = {x for r in fd.analyze(logs).collect() for x in r.context_rule_ids}
    assert rules >= {"C-02", "C-03", "C-04"}
