"""The session operators on a stream of normalized logs.

State per session is what later rows can still see: the last window_rows MCP rows and the latest log. The stateful step
only attaches ``w`` and ``prev``; everything after it is the same column code the batch operators use.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from agentlog.config import DEFAULT, Settings
from agentlog.operators import detect as dt
from agentlog.operators import findings as fd
from agentlog.operators import session, signals
from agentlog.operators.classify import classify
from agentlog.sources.store import upsert_processed

_FIELDS = ["log_id", "seq", "us", "event", "tool", "request_id", "is_warning", "warned_limit", "is_503"]
_PREV = "struct<us:bigint,neg_seq:bigint,log_id:string>"


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PART = 1_000  # rows that are given out at a time


class SessionState(StatefulProcessor):
    """Gives each row of a session what earlier rows left: ``w``, the last MCP rows, and ``prev``, the latest log.

    The rows of a micro-batch come in pieces in no order and are sorted in memory; the source limits how many there are.
    They are given out in parts.
    """

    def __init__(self, plain: list[str], n: int, ttl_ms: int | None):
        self.plain, self.n, self.ttl_ms = plain, n, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", _element()[len("struct<") : -1].replace(":", " "), self.ttl_ms)
        self.latest = handle.getValueState("latest", "us bigint, neg_seq bigint, log_id string", self.ttl_ms)

    def _ordered(self, pieces: Iterator[pd.DataFrame]) -> tuple[list[str], Iterator[tuple]]:
        names = [*self.plain, "_record", "_us"]
        held = []
        for piece in pieces:
            piece.columns = names  # those that are no identifiers come under other names
            held.append(piece)
        rows = pd.concat(held).sort_values("arrival_seq", kind="stable")
        return names, zip(*(rows[c] for c in names))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        recent = [dict(zip(_FIELDS, r, strict=True)) for r in self.recent.get()]
        latest = tuple(self.latest.get()) if self.latest.exists() else None
        names, ordered = self._ordered(rows)
        at = {c: names.index(c) for c in ("_record", "arrival_seq", "_us", "log_id")}
        out = {c: names.index(c) for c in self.plain}
        done, windows, previous = [], [], []

        def given() -> pd.DataFrame:
            frame = pd.DataFrame({c: pd.Series([r[i] for r in done]) for c, i in out.items()})
            frame["w"], frame["prev"] = pd.Series(windows), pd.Series(previous)
            return frame

        for row in ordered:
            windows.append(list(recent))
            previous.append(dict(zip(("us", "neg_seq", "log_id"), latest, strict=True)) if latest else None)
            done.append(row)
            record = row[at["_record"]]
            if record is not None:
                record = record.asDict() if hasattr(record, "asDict") else dict(record)
                recent = [*recent, record][-self.n :]
            now = (int(row[at["_us"]]), -int(row[at["arrival_seq"]]), row[at["log_id"]])
            latest = now if latest is None else max(latest, now)
            if len(done) == PART:
                yield given()
                done, windows, previous = [], [], []
        if done:
            yield given()
        if recent:  # the store takes no empty list
            self.recent.put([tuple(r[f] for f in _FIELDS) for r in recent])
        self.latest.update(latest)

    def close(self) -> None:
        pass


def with_session_state(
    rows: DataFrame, cfg: Settings = DEFAULT, ttl: str | None = None, window: bool = True
) -> DataFrame:
    """Add ``w`` and ``prev`` to a stream.

    Rows of a micro-batch are taken in arrival order. State is kept in RocksDB, which is set for the session, as
    the step needs it. ``ttl`` (such as ``"1 hour"``) forgets sessions that stay silent. The size of a micro-batch, which
    the source limits, bounds what one session brings into memory.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    tagged = rows.withColumn("_record", session.window_record() if window else F.lit(None).cast(_element()))
    plain = [c for c in tagged.columns if c != "_record"]
    schema = ", ".join(f"`{c}` {tagged.schema[c].dataType.simpleString()}" for c in plain)
    ttl_ms = int(pd.Timedelta(ttl).total_seconds() * 1000) if ttl else None
    return (
        tagged.withColumn("_us", F.unix_micros("ts"))
        .groupBy("session_id")
        .transformWithStateInPandas(
            SessionState(plain, cfg.window_rows, ttl_ms),
            outputStructType=f"{schema}, w {session.WINDOW_SCHEMA}, prev {_PREV}",
            outputMode="Append",
            timeMode="ProcessingTime" if ttl else "None",
        )
    )


def _element() -> str:
    return session.WINDOW_SCHEMA[len("array<") : -1]


def stream_findings(
    logs: DataFrame, cfg: Settings = DEFAULT, scorer: signals.Scorer | None = None, ttl: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(findings, links) of a stream of normalized logs.

    A link says that a later 429 error points to an earlier warning, whose finding may have been emitted already; in
    batch it is appended to that finding's linked ids.
    """
    rows = signals.row_signals(signals.signal_rows(logs), cfg, scorer)
    judged = fd.decide(session.correlate(with_session_state(rows, cfg, ttl)), cfg)
    links = judged.where(F.col("c_429").isNotNull()).select(
        "session_id", F.col("c_429.log_id").alias("warning_log_id"), F.col("log_id").alias("error_log_id")
    )
    return fd.to_findings(judged), links


def stream_processed(scored: DataFrame, cfg: Settings = DEFAULT, ttl: str | None = None) -> DataFrame:
    """Detected, classified and linked logs of a stream that carries ``score``."""
    return stream_judged(dt.detect_scored(scored, cfg), cfg, ttl)


def stream_judged(detected: DataFrame, cfg: Settings = DEFAULT, ttl: str | None = None) -> DataFrame:
    """``stream_processed`` for logs that carry the columns of the detection already."""
    judged = classify(detected)
    flat = judged.withColumn("classification", F.to_json("classification"))
    linked = with_session_state(flat, cfg, ttl, window=False).drop("w")
    schema = "anomaly_type string, confidence double, method string, reasoning string"
    return linked.withColumn("classification", F.from_json("classification", schema))


def upsert_stream(processed: DataFrame, path: str, checkpoint: str):
    """Write a stream to the processed table; a repeated micro-batch replaces its own directory."""

    def write(batch: DataFrame, batch_id: int) -> None:
        upsert_processed(batch, path, batch_id)

    return (
        processed.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

