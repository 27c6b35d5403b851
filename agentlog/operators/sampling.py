"""Repeatable samples and dataset mixes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The n first rows of a group are found in two rounds: per slice of the group, then among the slice winners. A group of
# any size is so spread over this many tasks, and the second round sees at most n * SLICES rows per group.
SLICES = 64


def top_n(df: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of every group in the given order. Exact for every n and group size."""
    spread = F.pmod(F.xxhash64(*df.columns), F.lit(SLICES))
    first = Window.partitionBy(by, "_slice").orderBy(*order)
    final = Window.partitionBy(by).orderBy(*order)
    return (
        df.withColumn("_slice", spread)
        .withColumn("_n", F.row_number().over(first))
        .where(F.col("_n") <= n)
        .withColumn("_n", F.row_number().over(final))
        .where(F.col("_n") <= n)
        .drop("_slice", "_n")
    )


def stratified_sample(
    df: DataFrame, by: str, n: int, seed: int = 42, id_col: str = "log_id", order: Column | None = None
) -> DataFrame:
    """Exactly min(n, group size) rows per group, picked by a hash of the id, so the same on any partitioning."""
    pick = order if order is not None else F.xxhash64(F.col(id_col), F.lit(seed))
    return top_n(df, by, [pick, F.col(id_col)], n)


def golden_dataset(
    normal: DataFrame,
    anomalous: DataFrame,
    normal_per_protocol: dict[str, int] | None = None,
    anomalous_per_protocol: dict[str, int] | None = None,
    seed: int = 42,
    id_col: str = "log_id",
    order: Column | None = None,
) -> DataFrame:
    """Labelled evaluation set: normals by protocol (label 0), anomalies by protocol and type (label 1)."""
    # Sample sizes of the evaluation set.
    normal_sizes = normal_per_protocol or {"MCP": 9_100, "A2A": 900}
    anomaly_sizes = anomalous_per_protocol or {"MCP": 227, "A2A": 23}

    def part(df: DataFrame, protocol: str, by: str, n: int, label: int) -> DataFrame:
        rows = df.where(F.col("protocol") == protocol)
        return stratified_sample(rows, by, n, seed, id_col, order).withColumn("ground_truth_label", F.lit(label))

    parts = [part(normal, p, "protocol", n, 0) for p, n in normal_sizes.items()]
    parts += [part(anomalous, p, "anomaly_type", n, 1) for p, n in anomaly_sizes.items()]
    return reduce(DataFrame.unionByName, parts)


def mix_sources(
    sources: dict[str, DataFrame],
    takes: dict[str, int],
    seed: int = 42,
    id_col: str = "log_id",
    time_col: str = "ts",
    order: Column | None = None,
) -> DataFrame:
    """Up to ``takes[name]`` rows of each source, united and sorted by time."""
    parts = [
        stratified_sample(df.withColumn("source", F.lit(name)), "source", takes[name], seed, id_col, order)
        for name, df in sources.items()
    ]
    return reduce(DataFrame.unionByName, parts).orderBy(time_col, id_col)
