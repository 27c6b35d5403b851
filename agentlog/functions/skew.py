"""Ordered work on keys of any size.

A window over ``PARTITION BY key ORDER BY seq`` sends a whole key to one task. Here a key above a row limit is cut
into ordered chunks at approximate quantiles of ``seq``; each (key, chunk) is an independent window partition, and what
crosses a chunk border is added back exactly:

* bounded frames: the border rows are copied into the neighbouring chunks (``with_halo``);
* running totals: one value per chunk is carried into the following ones (``running_before``).

Keys below the limit keep a single chunk and pay one extra narrow count. With no key above the limit the adaptive
planner sees an empty broadcast and drops the branches that would read hot rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentlog.config import DEFAULT, Settings

_STEP = 32


def hot_keys(df: DataFrame, key: str, min_rows: int) -> DataFrame:
    """Keys with at least min_rows rows: at most rows / min_rows of them, whatever the data."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") >= min_rows).select(key)


def _chunk_edges(df: DataFrame, key: str, order: str, cfg: Settings) -> DataFrame:
    k = cfg.hot_key_chunks
    # Rows per chunk: a sixteenth of what makes a key hot, until the key has hot_key_chunks chunks. All edges together are
    # then at most 16 * rows / hot_key_rows numbers, whatever the keys, which bounds the broadcast.
    chunk_rows = max(1, cfg.hot_key_rows // 16)
    hot = F.broadcast(hot_keys(df, key, cfg.hot_key_rows))
    edges = (
        df.select(key, order)
        .join(hot, key)
        .groupBy(key)
        .agg(
            F.percentile_approx(order, [i / k for i in range(1, k)], max(10_000, 10 * k)).alias("_edges"),
            F.greatest(F.lit(1), F.floor(F.lit(k * chunk_rows) / F.count(F.lit(1)))).cast("int").alias("_every"),
        )
    )
    kept = F.filter("_edges", lambda e, i: (i + 1) % F.col("_every") == 0)
    edges = edges.select(key, kept.alias("_edges"))
    return edges.withColumn("_coarse", F.filter("_edges", lambda e, i: (i + 1) % _STEP == 0))


def with_chunks(df: DataFrame, key: str, order: str, cfg: Settings = DEFAULT) -> DataFrame:
    """Add ``_chunk`` (ordered within the key, 0 for ordinary keys) and ``_hot``."""
    if cfg.hot_key_rows is None:
        return df.withColumns({"_chunk": F.lit(0), "_hot": F.lit(False)})
    edges = F.broadcast(_chunk_edges(df, key, order, cfg))
    value = F.col(order)
    # Number of edges below the value, found in two short scans instead of one long one.
    coarse = F.size(F.filter("_coarse", lambda e: e < value)) * _STEP
    fine = F.size(F.filter(F.slice("_edges", coarse + 1, _STEP), lambda e: e < value))
    return (
        df.join(edges, key, "left")
        .withColumn("_hot", F.col("_edges").isNotNull())
        .withColumn("_chunk", F.when(F.col("_hot"), coarse + fine).otherwise(0))
        .drop("_edges", "_coarse")
    )


def with_halo(
    df: DataFrame, key: str, order: str, before: int = 0, after: int = 0, cfg: Settings = DEFAULT
) -> DataFrame:
    """Rows plus copies of the rows next to each chunk border.

    Windows partitioned by (key, ``_chunk``) then see up to ``before`` rows ahead of the chunk and ``after`` rows
    behind it. Copies carry ``_halo`` = true and are dropped with ``drop_halo`` after the windows.
    """
    rows = with_chunks(df, key, order, cfg)
    if cfg.hot_key_rows is None:
        return rows.withColumn("_halo", F.lit(False)).drop("_hot")
    columns = df.columns
    record = F.struct(F.col(order).alias("_o"), F.struct(*columns).alias("_r"))
    hot = rows.where("_hot")
    inside = Window.partitionBy(key, "_chunk")
    across = Window.partitionBy(key).orderBy("_chunk")
    out = rows.withColumn("_halo", F.lit(False)).drop("_hot")

    def border(nearest: Column, n: int, frame, cut) -> DataFrame:
        # The n rows of a chunk nearest to its border, then the n nearest rows over the chunks next to it.
        # row_number() <= n is pruned before the shuffle, and every list below holds at most n * n rows.
        edge_rows = (
            hot.withColumn("_n", F.row_number().over(inside.orderBy(nearest)))
            .where(F.col("_n") <= n)
            .groupBy(key, "_chunk")
            .agg(F.sort_array(F.collect_list(record)).alias("_edge"))
        )
        return (
            edge_rows.withColumn("_near", cut(F.flatten(F.collect_list("_edge").over(frame)), n))
            .select(F.col("_chunk"), F.explode("_near").alias("_x"))
            .select("_x._r.*", "_chunk", F.lit(True).alias("_halo"))
        )

    if before:
        out = out.unionByName(
            border(F.desc(order), before, across.rowsBetween(-before, -1), lambda a, n: F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), n))
        )
    if after:
        out = out.unionByName(border(F.asc(order), after, across.rowsBetween(1, after), lambda a, n: F.slice(a, 1, n)))
    return out


def drop_halo(df: DataFrame) -> DataFrame:
    return df.where(~F.col("_halo")).drop("_halo", "_chunk")


def running_before(
    df: DataFrame, key: str, order: str, value: Column, name: str, how: str = "sum", cfg: Settings = DEFAULT
) -> DataFrame:
    """Sum or maximum of ``value`` over all rows of the key that come before the row."""
    agg = {"sum": F.sum, "max": F.max}[how]
    rows = with_chunks(df.withColumn("_v", value), key, order, cfg)
    earlier = Window.partitionBy(key, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn(name, agg("_v").over(earlier))
    if cfg.hot_key_rows is None:
        total = F.coalesce(F.col(name), F.lit(0)) if how == "sum" else F.col(name)
        return inside.withColumn(name, total).drop("_v", "_hot", "_chunk")
    chunks_before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        rows.where("_hot")
        .groupBy(key, "_chunk")
        .agg(agg("_v").alias("_c"))
        .select(key, "_chunk", agg("_c").over(chunks_before).alias("_carry"))
    )
    if how == "sum":
        total = F.coalesce(F.col(name), F.lit(0)) + F.coalesce(F.col("_carry"), F.lit(0))
    else:
        total = F.greatest(F.col(name), F.col("_carry"))
    return (
        inside.join(carry, [key, "_chunk"], "left")
        .withColumn(name, total)
        .drop("_v", "_hot", "_chunk", "_carry")
    )
