"""Blocked Bloom filters as tables: one row per block of 32,768 bits, each key's two bits in a single block.

A filter's size follows the number of keys up to ``max_bits``, so what is broadcast is bounded. Beyond that, more keys
pass the filter by chance; callers decide on passing keys exactly, so results stay the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentlog.llm.common import fresh

BLOCK_BITS = 32_768  # of bitmap_construct_agg
MAX_BITS = 1 << 30  # 128 MB


def filter_bits(keys: int, bits_per_key: int = 16, max_bits: int = MAX_BITS) -> int:
    """Power of two of at least ``bits_per_key`` bits a key, within one block and ``max_bits``."""
    return min(max(BLOCK_BITS, 1 << (max(keys, 1) * bits_per_key - 1).bit_length()), max_bits)


def _block(key: Column, bits: int) -> Column:
    return F.pmod(key, F.lit(bits // BLOCK_BITS))


def _places(key: Column) -> list[Column]:
    again = F.xxhash64(key, F.lit("places"))
    return [again.bitwiseAND(F.lit(BLOCK_BITS - 1)), F.shiftrightunsigned(again, 40).bitwiseAND(F.lit(BLOCK_BITS - 1))]


def build(keys: DataFrame, key: str, bits: int, repeated: bool = False) -> DataFrame:
    """The filter of a column of 64-bit keys: (block, bitmap).

    With ``repeated``, only places that at least two rows hit are set: a key that occurs twice has all its places set,
    whichever partitions its rows are in. Hits are counted on the map side first. NULL keys are left out.
    """
    k = F.col(key)
    hits = keys.where(k.isNotNull()).select(
        _block(k, bits).alias("block"), F.explode(F.array_distinct(F.array(*_places(k)))).alias("place")
    )
    if repeated:
        hits = hits.groupBy("block", "place").agg(F.count("*").alias("n")).where("n > 1")
    return hits.groupBy("block").agg(F.bitmap_construct_agg("place").alias("bitmap"))


def _bit(bitmap: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10)
    return F.getbit(byte.cast("bigint"), place.bitwiseAND(F.lit(7)).cast("int")) == 1


def mark(rows: DataFrame, key: str, blocks: DataFrame, bits: int, flag: str) -> DataFrame:
    """The rows with ``flag``: false where the key certainly isn't in the filter. ``blocks`` has at most ``bits`` bits."""
    block, bitmap = fresh(rows, "_bloom_block"), fresh(rows, "_bloom_bits")
    b = blocks.select(F.col("block").alias(block), F.col("bitmap").alias(bitmap))
    k = F.col(key)
    hit = F.lit(True)
    for place in _places(k):
        hit = hit & _bit(F.col(bitmap), place)
    return (
        rows.join(F.broadcast(b), _block(k, bits) == F.col(block), "left")
        .withColumn(flag, F.coalesce(hit, F.lit(False)))
        .drop(block, bitmap)
    )
