"""Helpers the operators share: scratch tables, hashes and word texts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x20\x09-\x0D]+"
BATCH = 1000  # rows of whole texts that go to a Python worker and come back at once


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. A local session without one gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "/tmp/checkpoints"
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a table in the shared folder: lineage ends here and statistics are known."""
    path = f"{scratch_folder(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is run inside sends BATCH rows at once, or fewer where the session says so."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(key))
    spark.conf.set(key, str(min(before, BATCH) if before > 0 else BATCH))
    try:
        yield
    finally:
        spark.conf.set(key, str(before))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, everything else as it is. The general rule agrees on texts of ASCII characters only."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the frame doesn't have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def own_name(df: DataFrame, name: str) -> str:
    """The column's name as the frame has it, found as Spark finds it."""
    if name in df.columns or df.sparkSession.conf.get("spark.sql.caseSensitive") == "true":
        return name
    return next((c for c in df.columns if c.lower() == name.lower()), name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
