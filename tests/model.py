"""A row-at-a-time account of the session rules, as a second opinion on the window expressions."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

SEC = 1_000_000


@dataclass
class Row:
    seq: int
    session: str
    us: int
    event: str
    level: str
    tool: str = ""
    request: str = ""
    http: int = 0
    used: int = 0
    limit: int = 0
    marks: dict = field(default_factory=dict)

    @property
    def id(self):
        return f"r{self.seq}"


def judge(rows: list[Row]) -> dict[str, dict]:
    """Outcome of every window rule per row, and the links pointing back to warnings."""
    seen, back, out = defaultdict(list), defaultdict(list), {}
    for row in sorted(rows, key=lambda r: r.seq):
        past = seen[row.session][-10:]
        same_tool = [p for p in past if p.tool == row.tool and row.tool]
        got = {"warned": False, "call": None, "orphan": False, "loop": None, "breach": False, "w429": None, "schema": None}
        if row.level == "warning":
            got["warned"] = any(p.level == "warning" and row.us - p.us <= 60 * SEC for p in same_tool)
        if row.event == "TOOL_CALL_ERROR":
            calls = [p for p in same_tool if p.event == "TOOL_CALL_RECEIVED"]
            wins = [p for p in same_tool if p.event == "TOOL_CALL_SUCCESS"]
            if calls and not (wins and wins[-1].us >= calls[-1].us):
                got["call"] = calls[-1].id
        elif row.event == "TOOL_CALL_RETRY":
            got["orphan"] = not {"FIGMA_API_ERROR", "TOOL_CALL_ERROR"} & {p.event for p in past}
        elif row.event == "TOOL_CALL_RECEIVED":
            calls = [p.id for p in same_tool if p.event == "TOOL_CALL_RECEIVED" and row.us - p.us <= 20 * SEC]
            fails = [p for p in past if p.event == "FIGMA_API_ERROR" and p.http == 503 and row.us - p.us <= 20 * SEC]
            if min(len(calls), len(fails)) >= 2:
                got["loop"] = calls[-2:]
        elif row.event == "RATE_LIMIT_WARN":
            got["breach"] = row.limit > 0 and row.used >= int(0.95 * row.limit)
        elif row.event == "FIGMA_API_ERROR" and row.http == 429:
            for p in past[::-1]:
                if row.us - p.us > 10 * SEC:
                    break
                tight = p.limit > 0 and p.used >= int(0.8 * p.limit)
                if tight and p.level == "warning" and p.event in ("RATE_LIMIT_WARN", "FIGMA_API_WARN"):
                    got["w429"] = p.id
                    back[p.id].append(row.id)
                    break
        elif row.event == "TOOL_CALL_SUCCESS" and row.request:
            errors = [p.id for p in past if p.request == row.request and p.event == "SCHEMA_VALIDATION_ERROR"]
            got["schema"] = errors[-1] if errors else None
        out[row.id] = got
        seen[row.session].append(row)
    for name, got in out.items():
        got["back"] = back[name]
    return out


def previous(rows: list[Row]) -> dict[str, str | None]:
    """Latest earlier arrival of the session by time; the first of equals."""
    out, seen = {}, defaultdict(list)
    for row in sorted(rows, key=lambda r: r.seq):
        past = seen[row.session]
        newest = max((p.us for p in past), default=None)
        out[row.id] = next((p.id for p in past if p.us == newest), None)
        past.append(row)
    return out
