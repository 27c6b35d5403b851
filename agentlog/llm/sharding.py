"""Shards of bounded size by extendible hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentlog.llm.common import fresh, written

HASH_BITS = 60  # 15 hexadecimal digits
STRIDE = 12  # directory bits per round


def row_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of the id's and the text's MD5. Only rows equal in both share them."""
    whole = F.concat_ws("/", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(whole), 1, 15), 16, 10).cast("bigint")


def _prefix(h: Column, bits: Column | int, of: int = HASH_BITS) -> Column:
    """The first ``bits`` of the ``of`` bits in h."""
    drop = F.lit(of) - (bits if isinstance(bits, Column) else F.lit(bits))
    return F.call_function("shiftrightunsigned", h, drop.cast("int"))


def directory(sized: DataFrame, limit: int) -> DataFrame:
    """The leaves (depth, prefix, shard_bytes, shard_docs) for rows (h, n_bytes).

    A bucket of all rows is split on the next bit of the hash as long as it holds more than ``limit`` bytes. Each round
    counts the buckets of up to STRIDE further bits, only for rows of buckets that are still too large: one sum per
    cell, started on the map side, from which the levels above are summed. A bucket whose rows all have one hash, which
    is a single document or copies of it under one id, can't be split and stays as it is.
    """
    leaves, rows, depth = None, sized, 0
    while True:
        deep = min(depth + STRIDE, HASH_BITS)
        cells = rows.groupBy(_prefix(F.col("h"), deep).alias("cell")).agg(
            F.sum("n_bytes").alias("bytes"), F.count("*").alias("docs"), F.min("h").alias("lo"), F.max("h").alias("hi")
        )
        levels = written(cells, "cells").withColumn("depth", F.explode(F.sequence(F.lit(depth), F.lit(deep))))
        nodes = levels.groupBy("depth", _prefix(F.col("cell"), F.col("depth"), deep).alias("prefix")).agg(
            F.sum("bytes").alias("shard_bytes"),
            F.sum("docs").alias("shard_docs"),
            ((F.sum("bytes") <= limit) | (F.min("lo") == F.max("hi"))).alias("fits"),
        )
        nodes = written(nodes, "nodes")
        # Below the top a node exists when the one above it was split, which then holds for all above.
        split = nodes.where("NOT fits").select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("above"))
        lower = nodes.withColumn("above", F.shiftright("prefix", 1)).join(split, ["depth", "above"], "left_semi")
        exist = written(lower.select(*nodes.columns).unionByName(nodes.where(F.col("depth") == depth)), "nodes")
        found = exist.where("fits").drop("fits")
        leaves = found if leaves is None else leaves.unionByName(found)
        large = exist.where((F.col("depth") == deep) & ~F.col("fits")).select(F.col("prefix").alias("large"))
        if deep == HASH_BITS or large.isEmpty():
            return written(leaves, "directory")
        rows = rows.join(large, _prefix(F.col("h"), deep) == F.col("large"), "left_semi")
        depth = deep


def shards(docs: DataFrame, limit: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with ``shard``, the hash bits that lead to it in the directory (empty: the only one), ``n_bytes``,
    ``shard_bytes`` and ``shard_docs``, replacing columns of these names.

    Every shard holds at most ``limit`` bytes of text in UTF-8, except one that can't be split: a document larger than
    that, or rows equal in id and text. NULL and empty texts are 0 bytes. No documents make no shards. Hashes spread a
    hot source or any other group, and rows find their shard by a join on as many depths as the directory has leaves on.
    """
    h = fresh(docs, "_hash")
    kept = [c for c in docs.columns if c.lower() not in ("shard", "n_bytes", "shard_bytes", "shard_docs")]
    size = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("bigint")
    hashed = docs.select(*kept, row_hash(F.col(doc_id), F.col(text)).alias(h), size.alias("n_bytes"))
    sized = written(hashed.select(F.col(h).alias("h"), "n_bytes"), "sizes")
    leaves = directory(sized, limit)
    depths = sorted(r.depth for r in leaves.select("depth").distinct().collect())  # at most HASH_BITS + 1
    if not depths:
        zero = F.lit(0).cast("bigint")
        return hashed.drop(h).withColumns({"shard": F.lit(""), "shard_bytes": zero, "shard_docs": zero})
    place, at_depth, at_prefix = fresh(docs, "_place"), fresh(docs, "_depth"), fresh(docs, "_prefix")
    places = F.array(*[F.struct(F.lit(d).alias("depth"), _prefix(F.col(h), d).alias("prefix")) for d in depths])
    bits = F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.conv("prefix", 10, 2), F.col("depth"), F.lit("0")))
    named = leaves.select(
        F.col("depth").alias(at_depth), F.col("prefix").alias(at_prefix), bits.alias("shard"), "shard_bytes", "shard_docs"
    )
    on = (F.col(place)["depth"] == F.col(at_depth)) & (F.col(place)["prefix"] == F.col(at_prefix))
    found = hashed.withColumn(place, F.explode(places)).join(named, on)
    return found.select(*kept, "shard", "n_bytes", "shard_bytes", "shard_docs")
