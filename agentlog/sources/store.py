"""Tables of processed logs and of the baseline.

The processed table is append-only on disk: every upsert writes one ``batch`` directory, and reading keeps the last row
of each log id. An upsert so costs what its rows cost, is safe to repeat for the same batch, and ``compact`` folds the
batches into one when reads become slow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agentlog.functions import jsontext as js


def last_write(df: DataFrame, id_col: str = "log_id", order: tuple[str, ...] = ("arrival_seq",)) -> DataFrame:
    """The last row of each id. Rows that lose are pruned before the shuffle."""
    newest = Window.partitionBy(id_col).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") == 1).drop("_n")


def upsert_processed(df: DataFrame, path: str, batch: int) -> None:
    """Write one batch; repeating a batch number replaces that batch."""
    rows = last_write(df).sortWithinPartitions("session_id", "ts")
    rows.write.mode("overwrite").partitionBy("is_anomaly").parquet(f"{path}/batch={batch}")


def load_processed(spark: SparkSession, path: str) -> DataFrame:
    """Current rows, ordered by timestamp."""
    return current_rows(spark, path).orderBy("ts", "arrival_seq")


def current_rows(spark: SparkSession, path: str) -> DataFrame:
    """Current rows in no order, for further processing."""
    rows = spark.read.parquet(path)
    # Directory names come back as text.
    return last_write(rows.withColumn("is_anomaly", F.col("is_anomaly").cast("boolean")), order=("batch", "arrival_seq"))


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Write the current rows as the first batch of a new table; point readers to it afterwards."""
    upsert_processed(current_rows(spark, path).drop("batch"), target, 0)


BASELINE_TEXT = ["event", "logger", "level", "tool_name", "intent", "context_summary", "response_status", "session_id"]
BASELINE_JSON = ["tool_parameters", "response_payload", "context_carried"]


def _flat(df: DataFrame, column: str) -> Column:
    """Any other column as metadata: scalars as they are, the rest as JSON text, NULL as empty text."""
    kind = dict(df.dtypes)[column]
    nested = kind.startswith(("struct", "array", "map", "variant"))
    text = F.to_json(column) if nested else F.col(column).cast("string")
    return F.coalesce(text, F.lit(""))


def baseline_rows(df: DataFrame) -> DataFrame:
    """Logs with an ``embedding`` as baseline rows: unique ids (first arrival), flat metadata, document text."""
    first = Window.partitionBy("log_id").orderBy("arrival_seq")
    kept = df.withColumn("_n", F.row_number().over(first)).where(F.col("_n") == 1)
    metadata = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in BASELINE_TEXT]
    metadata += [F.coalesce(js.json_text(F.col(c)), F.lit("")).alias(c) for c in BASELINE_JSON]
    metadata += [F.coalesce("latency_ms", F.lit(0)).alias("latency_ms")]
    own = {*BASELINE_TEXT, *BASELINE_JSON, "latency_ms", "log_id", "embedding", "text_for_embedding"}
    metadata += [_flat(df, c).alias(c) for c in df.columns if c not in own]
    return kept.select(
        F.col("log_id").alias("id"),
        F.transform("embedding", lambda x: x.cast("float")).alias("embedding"),
        F.col("text_for_embedding").alias("document"),
        F.struct(*metadata).alias("metadata"),
    )


def write_baseline(df: DataFrame, path: str) -> None:
    baseline_rows(df).write.mode("append").parquet(path)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """Baseline with one row per id, also over several writes."""
    return spark.read.parquet(path).dropDuplicates(["id"])
