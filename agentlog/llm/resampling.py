"""Importance resampling: documents drawn by how much likelier their features are in a target collection."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentlog.llm.common import written

BUCKETS = 10_000
PIECE = 1 << 20  # bytes of a text that are cut into words at a time
FEW = 10_000  # keys that end a selection on the driver

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_BETWEEN = re.compile(rb"[^0-9a-z\x80-\xff]")


# --- features ---------------------------------------------------------------------------------------------------------


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, A-Z in lower case, some at a time: no word is cut."""
    start = 0
    while start < len(text):
        cut = _BETWEEN.search(text, start + PIECE) if start + PIECE < len(text) else None
        end = cut.start() if cut else len(text)
        yield _WORD.findall(text[start:end].lower())
        start = end


def feature_buckets(text: bytes) -> tuple[int, list[np.ndarray]]:
    """Number of words, and the buckets of all runs of one or two consecutive words, repeats included."""
    n, found, last = 0, [], None
    for words in _pieces(text):
        if not words:
            continue
        single = list(map(crc32, words))
        # The checksum of two words goes on from that of the first one and a space.
        spaced = list(map(crc32, repeat(b" "), single))
        if last is not None:
            found.append(np.array([crc32(words[0], last)], np.int64) % BUCKETS)
        pairs = np.fromiter(map(crc32, words[1:], spaced), np.int64, len(words) - 1)
        found += [np.array(single, np.int64) % BUCKETS, pairs % BUCKETS]
        n, last = n + len(words), spaced[-1]
    return n, found


def _texts(df: DataFrame, text: str, *others: Column) -> DataFrame:
    return df.select(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"), *others)


def bucket_counts(texts: DataFrame, text: str = "text") -> np.ndarray:
    """Features of all texts per bucket. Each task counts on its own and gives at most one row a bucket, so the shuffle
    is bounded by tasks times buckets and the driver gets the buckets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for t in batch.column(0):
                for part in feature_buckets(t.as_py())[1]:
                    total += np.bincount(part, minlength=BUCKETS)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["bucket", "n"])

    counted = _texts(texts, text).mapInArrow(count, "bucket bigint, n bigint")
    out = np.zeros(BUCKETS, np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket the floored thousandfold logarithm of its smoothed share in the target over that in the source."""
    whole_s, whole_t = float(source.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    ratio = lambda s, t: (float(t) + 1.0) * whole_s / ((float(s) + 1.0) * whole_t)
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(source, target, strict=True)], np.int64)


def _weights(gain: np.ndarray):
    """A function column: text as binary -> words, features and the floored mean of their buckets' gains."""

    @F.arrow_udf("n_words bigint, n_features bigint, weight bigint")
    def weigh(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = []
            for t in texts:
                words, parts = feature_buckets(t.as_py())
                n = sum(map(len, parts))
                rows.append((words, n, sum(int(gain[p].sum()) for p in parts) // n if n else 0))
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
            yield pa.StructArray.from_arrays(columns, ["n_words", "n_features", "weight"])

    return weigh.asNondeterministic()  # so that no filter on its fields calls it once more


# --- selection --------------------------------------------------------------------------------------------------------

Key = tuple[int, bool, int, int]  # negative score, whether the id is NULL, id, row: the smallest is the best


def _sides(low: Key | None, pivot: Key | None, high: Key | None) -> Callable:
    """A task's keys between ``low`` and ``high``: for those before and after the pivot their number and their median."""

    def between(columns: list[np.ndarray], key: Key) -> np.ndarray:
        """-1, 0 or 1 where a key is before, at or after ``key``."""
        out = np.zeros(len(columns[0]), np.int8)
        for column, value in zip(reversed(columns), reversed(key), strict=True):
            out = np.where(column == value, out, np.sign(column.astype(np.float64) - value) if column.dtype == bool else np.where(column < value, -1, 1))
        return out

    def median(columns: list[np.ndarray]) -> list:
        order = np.lexsort(columns[::-1])
        at = order[(len(order) - 1) // 2]
        return [c[at].item() for c in columns]

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = []
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            inside = np.ones(batch.num_rows, bool)
            if low is not None:
                inside &= between(columns, low) > 0
            if high is not None:
                inside &= between(columns, high) < 0
            kept.append([c[inside] for c in columns])
        if not kept:
            return
        columns = [np.concatenate(c) for c in zip(*kept, strict=True)]
        place = between(columns, pivot) if pivot is not None else np.full(len(columns[0]), -1)
        rows = []
        for side in (-1, 1):
            own = [c[place == side] for c in columns]
            if len(own[0]):
                rows.append([side, len(own[0]), *median(own)])
        if rows:
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
            names = ["side", "size", "minus", "no_id", "id", "row"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return sides


def _literal(key: Key) -> Column:
    minus, no_id, doc_id, row = key
    number = lambda v, name: F.lit(v).cast("bigint").alias(name)
    return F.struct(number(minus, "minus"), F.lit(no_id).alias("no_id"), number(doc_id, "id"), number(row, "row"))


def _weighted_median(found: list) -> Key:
    """The task medians' median, each weighing as many keys as its task has left."""
    found = sorted((tuple(r)[2:], r["size"]) for r in found)
    half, seen = sum(n for _, n in found) / 2, 0
    for key, n in found:
        seen += n
        if seen >= half:
            return key
    raise ValueError("no keys")


def cutoff(keys: DataFrame, rank: int) -> Key:
    """The key of a rank, from 1, of a written table (minus, no_id, id, row) whose keys are all different.

    Each round is one pass without a shuffle. A task gives the number and the median of its remaining keys on both sides
    of the pivot; the medians' weighted median is the next pivot. At least a quarter of the remaining keys lies on either
    side of it, so each round discards a quarter at least. The driver gets two rows a task, and the last FEW keys.
    """
    low, pivot, high, before = None, None, None, 0
    while True:
        left = keys
        if low is not None:
            left = left.where(F.col("minus") >= low[0])
        if high is not None:
            left = left.where(F.col("minus") <= high[0])
        kind = "side int, size bigint, minus bigint, no_id boolean, id bigint, row bigint"
        found = left.mapInArrow(_sides(low, pivot, high), kind).collect()
        first, second = ([r for r in found if r.side == side] for side in (-1, 1))
        n = sum(r["size"] for r in first)
        if pivot is None or rank <= before + n:
            side, high = first, pivot if pivot is not None else high
        elif rank == before + n + 1:
            return pivot
        else:
            side, low, before = second, pivot, before + n + 1
        if sum(r["size"] for r in side) <= FEW:
            break
        pivot = _weighted_median(side)
    order = F.struct("minus", "no_id", "id", "row")
    rest = keys
    if low is not None:
        rest = rest.where(order > _literal(low))
    if high is not None:
        rest = rest.where(order < _literal(high))
    return tuple(sorted(map(tuple, rest.collect()))[rank - before - 1])


# --- the operator -----------------------------------------------------------------------------------------------------


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise of a document in thousandths, floored: the same in each run."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    return F.floor(F.lit(-1000) * F.ln(-F.ln((h.cast("bigint") + 0.5) / 4294967296.0))).cast("bigint")


def resample(
    docs: DataFrame,
    target: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    percent: int = 25,
    least_words: int = 20,
    seed: int = 7,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score, rank.

    Features are runs of one and two words, hashed into buckets. A bucket's gain compares its share in the target with
    that in the documents; a document's weight is the floored mean over its features, looked up in an array of all
    gains, and noise is added for the score. Of documents with ``least_words`` words, ``percent`` percent are drawn, the
    highest scores first, ties to the smaller id; their ``rank`` counts from 1 in that order, that of others is NULL.

    Texts are read twice, for the counts and for the weights; only (score, id) of documents is written. The last key that
    is drawn is found by median of medians; then only what is drawn is sorted, by range, and ranks follow from the number
    of rows in the ranges before.

    NULL and empty texts have no features and weigh 0. Ids are integers; a NULL id counts as an empty one in the noise
    and comes last in ties; rows that repeat an id are documents of their own, whose ties go by place in the table. Long
    texts are cut into words piece by piece. Other columns are ignored. No documents, no rows; an empty target
    leaves all gains to the documents' own counts.
    """
    gain = gains(bucket_counts(docs, text), bucket_counts(target, target_text))
    own = F.col(doc_id).cast("bigint").alias("doc_id")
    scored = _texts(docs, text, own).withColumn("found", _weights(gain)("text")).select("doc_id", "found.*")
    scored = scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "scores")
    keys = scored.where(F.col("n_words") >= least_words).select(
        (-F.col("score")).alias("minus"),
        F.col("doc_id").isNull().alias("no_id"),
        F.coalesce("doc_id", F.lit(0)).alias("id"),
        "row",
    )
    out = ["doc_id", "n_words", "n_features", "weight", "score"]
    no_rank = F.lit(None).cast("bigint").alias("rank")
    drawn = percent * keys.count() // 100
    if not drawn:
        return scored.select(*out, no_rank)
    last = _literal(cutoff(keys, drawn))
    key = F.struct(
        (-F.col("score")).alias("minus"), F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "row"
    )
    wins = (F.col("n_words") >= least_words) & (key <= last)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    ranges = scored.where(wins).repartitionByRange(*order).sortWithinPartitions(*order)
    # The upper bits of this number tell the range, the lower 33 the place in it.
    ranges = written(ranges.withColumn("place", F.monotonically_increasing_id()), "drawn")
    sizes = ranges.groupBy(F.shiftright("place", 33).alias("part")).count().orderBy("part").collect()
    starts, total = [], 0
    for r in sizes:
        starts.append((r.part, total))
        total += r["count"]
    starts = docs.sparkSession.createDataFrame(starts, "part bigint, start bigint")
    ranked = ranges.join(F.broadcast(starts), F.shiftright("place", 33) == F.col("part"))
    rank = F.col("start") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    return scored.where(~wins).select(*out, no_rank).unionByName(ranked.select(*out, rank.alias("rank")))
