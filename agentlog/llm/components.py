"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentlog.llm.common import written

FEW = 1 << 18  # links that one task may join up: 4 MB


def components(links: DataFrame, a: str = "a", b: str = "b", few: int = FEW) -> DataFrame:
    """(node, label): for each node of a link the smallest node it is connected with.

    Links are turned into stars, by turns among a node's larger and among its smaller neighbours, until they all point
    at the smallest node of their component: a number of rounds that grows as the logarithm of the longest chain. Each
    round is written, so lineage stays short. A node's neighbours are never gathered: a round is a minimum per node,
    which starts on the map side, and a join that Spark splits at hot nodes. As soon as at most ``few`` links are left,
    which is counted first, one task joins them up; the result is the same. No links give no rows.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = written(edges, "links")
    seen = None
    while (now := _content(edges)) != seen:
        if now[0] <= few:
            return edges.coalesce(1).mapInArrow(_joined, "node bigint, label bigint")
        seen = now
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "stars")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v").distinct(), "stars")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "stars")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = written(small, "links")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots.distinct())


def _content(edges: DataFrame) -> tuple:
    """A number of rows and a hash of them, in any order: they repeat when a round changes nothing."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of a few links: each node points at a smaller one of its component until it is the smallest."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            up[max(a, b)] = min(a, b)
    nodes = list(up)
    labels = [root(x) for x in nodes]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(labels, pa.int64())], ["node", "label"])
