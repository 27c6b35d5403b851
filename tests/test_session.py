import datetime
import random

import pytest
from pyspark.sql import functions as F

from agentlog import Settings
from agentlog.operators import session
from tests.model import Row, judge, previous

EVENTS = [
    "TOOL_CALL_RECEIVED", "TOOL_CALL_SUCCESS", "TOOL_CALL_ERROR", "TOOL_CALL_RETRY", "FIGMA_API_ERROR",
    "RATE_LIMIT_WARN", "FIGMA_API_WARN", "SCHEMA_VALIDATION_ERROR", "HEARTBEAT", "FIGMA_API_ERROR", "RATE_LIMIT_WARN",
]
SCHEMA = (
    "log_id string, session_id string, ts timestamp, arrival_seq bigint, event string, level string, tool string, "
    "request_id string, http_status bigint, used bigint, limit bigint"
)
PLANS = {
    "whole": Settings(hot_key_rows=None),
    "counted": Settings(),
    "split": Settings(hot_key_rows=5, hot_key_chunks=4),
    "split finely": Settings(hot_key_rows=2, hot_key_chunks=40),
}


def random_rows(seed, n=400):
    """Tied and out-of-order times, gaps around the limits, one session with most of the rows."""
    rng = random.Random(seed)
    rows = []
    for seq in rng.sample(range(10 * n), n):
        rows.append(
            Row(
                seq=seq,
                session=rng.choice(["a", "a", "a", "b", "c"]),
                us=(seq // 12 + rng.choice([0, 0, 0, 0, 0, 0, -10, 10, 30])) * 1_000_000,
                event=rng.choice(EVENTS),
                level=rng.choice(["info", "warning", "warning", "error"]),
                tool=rng.choice(["get_file", "get_node", ""]),
                request=rng.choice(["1", "2", ""]),
                http=rng.choice([503, 503, 429, 429, 0]),
                used=rng.choice([79, 80, 94, 95, 100]),
                limit=rng.choice([0, 100, 100]),
            )
        )
    return rows


def frame(spark, rows):
    zero = datetime.datetime(2025, 7, 21)
    data = [
        (r.id, r.session, zero + datetime.timedelta(microseconds=r.us), r.seq, r.event, r.level, r.tool, r.request, r.http, r.used, r.limit)
        for r in rows
    ]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


@pytest.mark.parametrize("plan", PLANS)
def test_window_rules_match_the_model(spark, plan):
    rows = random_rows(7)
    expected = judge(rows)
    out = session.correlate_sessions(frame(spark, rows), PLANS[plan]).collect()
    assert len(out) == len(rows)
    fired = set()
    for r in out:
        got = {
            "warned": r.warned,
            "call": r.c_call,
            "orphan": r.c_orphan,
            "loop": r.c_loop,
            "breach": r.c_breach,
            "w429": r.c_429.log_id if r.c_429 else None,
            "schema": r.c_schema,
            "back": r.back_links,
        }
        assert got == expected[r.log_id], r
        fired |= {k for k, v in got.items() if v}
    assert fired >= {"warned", "call", "orphan", "breach", "w429", "schema", "back"}


@pytest.mark.parametrize("plan", PLANS)
def test_previous_log_matches_the_model(spark, plan):
    rows = random_rows(11)
    out = session.previous_in_session(frame(spark, rows), PLANS[plan]).select("log_id", "prev.log_id").collect()
    assert {r[0]: r[1] for r in out} == previous(rows)


def test_lag_is_never_negative(spark):
    rows = random_rows(3, 60)
    linked = session.previous_in_session(frame(spark, rows)).where("prev is not null")
    lags = linked.select(session.lag_ms(F.col("ts"), F.col("prev.us")).alias("x")).collect()
    assert min(r.x for r in lags) == 0
