"""Removal of repeated lines by overlapping windows of three lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentlog.llm import bloom
from agentlog.llm.common import fresh, own_name, written

WINDOW = 3
EVENT = np.dtype([("high", np.int64), ("low", np.int64)])


def _windows():
    """A function column: text as binary -> its windows (high, low, pos), each at its first place in the text, and the
    places where one comes again. Windows of blank lines are left out."""

    @F.arrow_udf("windows array<struct<high bigint, low bigint, pos int>>, again array<int>")
    def windows(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found, repeats = [], []
            for text in texts:
                lines = (text.as_py() or b"").split(b"\n")
                filled = [bool(x.strip()) for x in lines]
                seen, again = {}, []
                for i in range(len(lines) - WINDOW + 1):
                    if any(filled[i : i + WINDOW]):
                        digest = xxhash.xxh3_128_digest(b"\n".join(lines[i : i + WINDOW]))
                        if seen.setdefault(digest, i) != i:
                            again.append(i)
                found.append(seen)
                repeats.append(again)
            both = np.frombuffer(b"".join(d for s in found for d in s), EVENT)
            pos = pa.array([i for s in found for i in s.values()], pa.int32())
            rows = pa.StructArray.from_arrays([pa.array(both["high"]), pa.array(both["low"]), pos], ["high", "low", "pos"])
            ends = pa.array(np.cumsum([0] + [len(s) for s in found]).astype(np.int32))
            listed = pa.ListArray.from_arrays(ends, rows)
            yield pa.StructArray.from_arrays([listed, pa.array(repeats, pa.list_(pa.int32()))], ["windows", "again"])

    return windows


def _without():
    """A function column: text and places of windows -> the text without the lines that they cover, and how many."""

    @F.arrow_udf("text string, removed int")
    def without(texts: pa.Array, places: pa.Array) -> pa.Array:
        kept, removed = [], []
        for text, at in zip(texts.to_pylist(), places.to_pylist(), strict=True):
            lines = text.split("\n")
            gone = np.zeros(len(lines) + 1, np.int32)
            starts = np.asarray(at, np.int64)
            np.add.at(gone, starts, 1)
            np.add.at(gone, starts + WINDOW, -1)
            covered = np.cumsum(gone[:-1]) > 0
            kept.append("\n".join([x for x, c in zip(lines, covered, strict=True) if not c]))
            removed.append(int(covered.sum()))
        columns = [pa.array(kept, pa.string()), pa.array(removed, pa.int32())]
        return pa.StructArray.from_arrays(columns, ["text", "removed"])

    return without


def drop_repeated_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", removed: str = "removed_lines"
) -> DataFrame:
    """The documents with lines that occurred before taken out of the text, and their number in ``removed``.

    Every three lines in a row are a window. A window that a document before has too, or that came earlier in the same
    text, is a later occurrence; the lines that later occurrences cover, overlaps merged, are removed. Documents are in the
    order of their ids, NULL last, and rows of one id or none in that of their text's hash. So each window stays in one
    document. Other columns stay as they are, a column named ``removed`` is replaced.

    Texts of fewer than three lines and windows of blank lines are left alone. NULL texts stay NULL. A text whose lines
    all go is empty. Rows that are equal in id and text are one document: they lose the same lines.

    Windows are narrow rows: they are grouped by hash, counted on the map side first, and windows that repeat are joined
    back, where Spark splits hot ones. Of the texts only those that lose lines are shuffled; a Bloom filter tells.
    """
    text = own_name(docs, text)
    key, order = fresh(docs, "_text_key"), fresh(docs, "_text_order")
    # A document's place and 128 bits of its text: equal only for rows that are equal in both.
    digest = F.unhex(F.md5(F.col(text).cast("binary")))
    place = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), digest.alias("digest"))
    keyed = docs.withColumn(order, F.when(F.col(text).isNotNull(), place))
    narrow = keyed.where(F.col(text).isNotNull()).select(
        F.col(order).alias("doc"), _windows()(F.col(text).cast("binary")).alias("found")
    )
    narrow = written(narrow.select("doc", "found.windows", "found.again"), "windows")
    rows = narrow.select("doc", F.inline("windows"))
    repeated = rows.groupBy("high", "low").agg(F.min("doc").alias("first"), F.count("*").alias("n"))
    repeated = written(repeated.where("n > 1").drop("n"), "repeated")
    later = rows.join(repeated, ["high", "low"]).where("doc > first").select("doc", "pos")
    later = later.union(narrow.select("doc", F.explode("again")))
    places = later.groupBy("doc").agg(F.collect_set("pos").alias("places"))
    places = written(places.withColumn("key", F.xxhash64("doc")), "places")
    bits = bloom.filter_bits(places.count())
    flag, at, out = fresh(docs, "_maybe"), fresh(docs, "_places"), fresh(docs, "_out")
    keyed = keyed.withColumn(key, F.xxhash64(order))
    marked = bloom.mark(keyed, key, bloom.build(places, "key", bits), bits, flag)
    kept = [c for c in docs.columns if c.lower() != removed.lower()]
    none = marked.where(~F.col(flag) | F.col(flag).isNull()).select(*kept, F.lit(0).alias(removed))
    of = fresh(docs, "_of")
    places = places.select(F.col("doc").alias(of), F.col("places").alias(at))
    some = marked.where(flag).join(places, F.col(order).eqNullSafe(F.col(of)), "left")
    some = some.withColumn(out, _without()(F.coalesce(F.col(text), F.lit("")), F.coalesce(at, F.array().cast("array<int>"))))
    new_text = F.when(F.col(text).isNotNull(), F.col(out)["text"])
    some = some.select(
        *[new_text.alias(c) if c == text else F.col(c) for c in kept], F.col(out)["removed"].alias(removed)
    )
    return none.unionByName(some)
