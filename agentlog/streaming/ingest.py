"""From raw lines to findings and processed logs on a stream, with what can't be used in a quarantine.

The projections are those of the batch: ``parse_lines``, ``normalize`` and the row signals; only the session step keeps
state. The baseline is a static table that each micro-batch is joined with: by broadcast where it is small, through an
index where it isn't.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from agentlog.config import DEFAULT, Settings
from agentlog.functions.lookups import stripped
from agentlog.operators import signals, vectors
from agentlog.operators.detect import baseline_ready, not_ready
from agentlog.operators.normalize import as_logs, normalize_all
from agentlog.operators.vectorindex import VectorIndex, nearest_indexed
from agentlog.sources.jsonl import POSITION_BITS
from agentlog.streaming import sessions

Encoder = Callable[[DataFrame], DataFrame]


def _stream_position():
    """``jsonl.line_position`` for a stream, where Spark gives no row numbers: the task counts its rows."""

    @F.arrow_udf("bigint")
    def position(blocks: Iterator[pa.Array]) -> Iterator[pa.Array]:
        seen = 0
        for starts in blocks:
            yield pa.array(starts.to_numpy(zero_copy_only=False) + np.arange(seen, seen + len(starts)), pa.int64())
            seen += len(starts)

    return position.asNondeterministic()  # so that it is called once a row


def line_stream(spark: SparkSession, path: str, files_per_trigger: int = 100, order: Column | None = None) -> DataFrame:
    """Lines of the text files that arrive in a folder: ``value``, ``source`` and ``arrival_seq``.

    ``order`` is a file's rank, below 2^21, from its ``source``; by default the last number in its name. Files have to
    arrive in this order and not be compressed. Where records carry their own sequence, use that instead.
    """
    rows = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    rows = rows.select("value", F.input_file_name().alias("source"), _stream_position()("_metadata.file_block_start").alias("_at"))
    number = F.regexp_extract(F.substring_index("source", "/", -1), r"([0-9]+)[^0-9]*$", 1).try_cast("bigint")
    rank = F.coalesce(number if order is None else order, F.lit(0))
    return rows.select("value", "source", (F.shiftleft(rank.cast("bigint"), POSITION_BITS) + F.col("_at")).alias("arrival_seq"))


def split_lines(lines: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(logs, quarantine) of raw lines, on a stream or in batch. Blank lines are dropped. The quarantine has every line
    that isn't JSON or breaks the schema, as it came: ``arrival_seq, raw, errors``."""
    text = lines.where(stripped("value") != "").select("arrival_seq", F.col("value").alias("raw"))
    checked = normalize_all(text, strict)
    bad = F.size("errors") > 0
    return as_logs(checked.where(~bad)), checked.where(bad).select("arrival_seq", "raw", "errors")


def scored_logs(
    logs: DataFrame, baseline: DataFrame, cfg: Settings = DEFAULT, encode: Encoder = vectors.vectorize, index: VectorIndex | None = None
) -> DataFrame:
    """Logs with ``score``, their distance to the nearest vector of a static baseline.

    A baseline above ``baseline_broadcast_bytes`` needs an ``index``, which is searched in ``foreachBatch`` only: on
    a stream itself its shuffles aren't possible.
    """
    rows = encode(logs)
    if index is not None:
        found = nearest_indexed(rows, index, k=1, id_col="log_id")
        closest = F.try_element_at("nearest", F.lit(1))["distance"]
        within = F.greatest(F.lit(0.0), F.least(F.lit(2.0), closest))
        return found.withColumn("score", F.coalesce(within, F.lit(1.0))).drop("nearest", "embedding")
    if logs.isStreaming and vectors.baseline_size(baseline).bytes > cfg.baseline_broadcast_bytes:
        raise ValueError("a baseline of this size is searched through an index, in foreachBatch")
    return vectors.anomaly_score(rows, baseline, cfg, id_col="log_id").drop("embedding")


def processed_lines(
    lines: DataFrame,
    baseline: DataFrame,
    cfg: Settings = DEFAULT,
    encode: Encoder = vectors.vectorize,
    ttl: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(processed, quarantine) of a stream of raw lines: scored against the baseline, detected, classified and linked to
    the session's log before. With too small a baseline every log is normal, as in batch."""
    logs, quarantine = split_lines(lines)
    if not baseline_ready(baseline, cfg):
        return sessions.stream_judged(not_ready(logs, cfg), cfg, ttl), quarantine
    return sessions.stream_processed(scored_logs(logs, baseline, cfg, encode), cfg, ttl), quarantine


def line_findings(
    lines: DataFrame, cfg: Settings = DEFAULT, scorer: signals.Scorer | None = None, ttl: str | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(findings, links, quarantine) of a stream of raw lines."""
    logs, quarantine = split_lines(lines)
    found, links = sessions.stream_findings(logs, cfg, scorer, ttl)
    return found, links, quarantine


def ingest(lines: DataFrame, table: str, quarantine: str, baseline: DataFrame, checkpoint: str, cfg: Settings = DEFAULT, ttl: str | None = None) -> list[StreamingQuery]:
    """Start writing a stream of raw lines: processed logs to the upsert table, unusable lines to a folder of files."""
    good, bad = processed_lines(lines, baseline, cfg, ttl=ttl)
    rejected = (
        bad.writeStream.format("parquet").option("path", quarantine).option("checkpointLocation", f"{checkpoint}/quarantine")
        .trigger(availableNow=True).start()
    )
    return [sessions.upsert_stream(good, table, f"{checkpoint}/processed"), rejected]
