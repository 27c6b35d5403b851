"""Small raw records for tests."""

from __future__ import annotations

import json
from uuid import UUID

from agentlog.operators.normalize import normalize

LINE_SCHEMA = "arrival_seq bigint, raw string"


def uid(n: int) -> str:
    return str(UUID(int=n))


def stamp(seconds: float) -> str:
    return f"2025-07-21T09:{int(seconds) // 60:02d}:{seconds % 60:09.6f}+00:00"


def notification(n=1, event="TOOL_CALL_RECEIVED", level="info", message="call taken", session="s-1", at=0.0, **meta):
    meta.setdefault("tool", "list_components")
    meta.setdefault("request_id", 7000 + n)
    return {
        "log_id": uid(n),
        "protocol": "MCP",
        "session": {"id": session, "host": "editor", "server": "tools", "connected_at": stamp(0), "transport": "stdio"},
        "jsonrpc": "2.0",
        "method": "notifications/message",
        "params": {
            "level": level,
            "logger": "tool-server",
            "data": {"timestamp": stamp(at), "event": event, "message": message, "meta": meta},
        },
    }


def message(n=1, session=900, at=0.0, **changes):
    return {
        "log_id": uid(n),
        "protocol": "A2A",
        "timestamp": stamp(at),
        "session_id": uid(session),
        "source_agent": "planner",
        "target_agent": "worker",
        "message_type": "task_delegation",
        "message_content": "Fetch the invoice",
        "task_intent": "fetch invoice",
        "response_status": "success",
        "latency_ms": 10,
        **changes,
    }


def raw_frame(spark, records):
    lines = [(i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)]
    return spark.createDataFrame(lines, LINE_SCHEMA)


def logs_of(spark, records):
    return normalize(raw_frame(spark, records))[0]
