"""Exact deduplication by two-pass Bloom filtering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentlog.llm import bloom
from agentlog.llm.common import fresh, lower_ascii, written


def normal_text(text: Column) -> Column:
    """What is compared: the text with A-Z in lower case, NULL as empty."""
    return lower_ascii(F.coalesce(text, F.lit("")))


def _repeats(keys: DataFrame, key: str, max_bits: int) -> tuple[DataFrame, int]:
    """The filter of keys that possibly occur twice, written once as both readers of the rows test it."""
    bits = bloom.filter_bits(keys.count(), max_bits=max_bits)
    return written(bloom.build(keys, key, bits, repeated=True), "repeats"), bits


def duplicate_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = bloom.MAX_BITS
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    First pass: every document's hash sets its places in a filter that keeps the places hit twice. Second pass: only
    hashes whose places are all set go to the grouping shuffle; the others are alone and pass straight through. Texts
    are read once, into a table of hashes. A hot group is counted on the map side; rows get their group by a join that
    Spark splits at hot keys.

    NULL texts are empty texts. Of equal texts the largest doc_id stays; NULL is the smallest id. Rows that repeat text
    and doc_id are the same document: ``kept`` is true on each. Other columns are ignored.
    """
    hashed = docs.select(F.col(doc_id).alias("doc_id"), F.sha2(normal_text(F.col(text)), 256).alias("text_sha256"))
    hashed = written(hashed.withColumn("key", F.xxhash64("text_sha256")), "hashes")
    blocks, bits = _repeats(hashed, "key", max_bits)
    marked = bloom.mark(hashed, "key", blocks, bits, "maybe")
    maybe = marked.where("maybe").select("doc_id", "text_sha256")
    groups = maybe.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    grouped = maybe.join(written(groups, "groups"), "text_sha256")
    alone = marked.where("NOT maybe").select(
        "text_sha256", "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size")
    )
    return alone.unionByName(grouped).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = bloom.MAX_BITS
) -> DataFrame:
    """The documents without exact duplicates, all columns kept: of equal texts the row with the largest doc_id.

    Rows that the filter lets through stream to the output untouched. The possibly repeated rows are reduced to one per
    text, on the map side first. Rows that tie in text and doc_id leave one row, the one whose other columns hash
    highest.
    """
    key, digest, maybe = fresh(docs, "_key"), fresh(docs, "_digest"), fresh(docs, "_maybe")
    keyed = docs.withColumn(key, F.xxhash64(normal_text(F.col(text))))
    blocks, bits = _repeats(keyed.select(key), key, max_bits)
    marked = bloom.mark(keyed, key, blocks, bits, maybe)
    whole = F.struct(*[F.col(c) for c in docs.columns])
    rank = F.struct(F.col(doc_id), F.xxhash64(*[F.col(c).cast("string") for c in docs.columns]))
    best = (
        marked.where(F.col(maybe))
        .withColumn(digest, F.sha2(normal_text(F.col(text)), 256))
        .groupBy(digest)
        .agg(F.max_by(whole, rank).alias("_row"))
        .select("_row.*")
    )
    return marked.where(~F.col(maybe)).select(*docs.columns).unionByName(best)
