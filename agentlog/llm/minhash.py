"""Near-duplicates by MinHash: one-permutation hashing, banded buckets and star-shaped candidate links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentlog.llm import bloom, families
from agentlog.llm.common import fresh, small_batches, written

BINS, ROWS = 128, 4  # 32 bands of 4 bins: of pairs at a likeness of 0.8, one in 20 million shares no bucket
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of word shingles as sorted 64-bit hashes, and their bands."""

    def __init__(self, words: int):
        self.size = words
        # An empty bin takes the value of the first filled one in an order of its own, the same in all texts.
        self.donors = np.argsort(_mixed(np.arange(BINS * BINS, dtype=np.uint64).reshape(BINS, BINS)), axis=1)
        self.weights = _mixed(np.arange(1, BINS + 1, dtype=np.uint64)).reshape(-1, ROWS) | np.uint64(1)

    def shingles(self, text: bytes) -> np.ndarray:
        """Distinct shingles of the words between ASCII white space, A-Z in lower case. Fewer words are one shingle."""
        words = text.lower().split()
        k = min(self.size, len(words))
        if not k:
            return np.empty(0, np.uint64)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        n = len(words) - k + 1
        out = np.full(n, k, np.uint64)
        for i in range(k):
            out = _mixed(out * FACTOR + hashes[i : i + n])
        return np.unique(out)

    def bands(self, shingles: np.ndarray) -> np.ndarray:
        """One-permutation hashing: the smallest hash of each bin of hash space, empty bins filled, in bands."""
        bins = (shingles >> np.uint64(57)).astype(np.intp)
        first = np.flatnonzero(np.diff(bins, prepend=-1))
        sketch, filled = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
        sketch[bins[first]] = shingles[first]
        filled[bins[first]] = True
        if len(first) < BINS:
            empty = np.flatnonzero(~filled)
            order = self.donors[empty]
            sketch[empty] = sketch[order[np.arange(len(empty)), filled[order].argmax(axis=1)]]
        sketch = _mixed(sketch.reshape(-1, ROWS) * self.weights).sum(axis=1, dtype=np.uint64)
        return _mixed(sketch + np.arange(BINS // ROWS, dtype=np.uint64)).view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    """A list column; offsets of 64 bits are not needed as batches are bounded in bytes."""
    ends = np.cumsum([0] + [len(a) for a in arrays]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *arrays])))


def _sets(words: int, banded: bool):
    """A function column: text as binary -> its set's size, 128-bit hash, and bands or whole set."""
    kind = "n_shingles bigint, set_hash binary, hashes array<bigint>"

    @F.arrow_udf(kind)
    def sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        shingler = Shingler(words)
        for texts in batches:
            sizes, digests, given = [], [], []
            for text in texts:
                s = shingler.shingles(text.as_py() or b"")
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                given.append(shingler.bands(s) if banded and len(s) else s.view(np.int64))
            columns = [pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), _lists(given)]
            yield pa.StructArray.from_arrays(columns, ["n_shingles", "set_hash", "hashes"])

    return sets.asNondeterministic()  # so that no filter on its fields calls it once more


def _with_sets(docs: DataFrame, words: int, banded: bool) -> DataFrame:
    found = _sets(words, banded)(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return docs.withColumn("found", found).select(*[c for c in docs.columns if c != "text"], "found.*")


def _whole_sets(members: DataFrame, reps: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(rep, n_shingles, hashes) of the representatives that share a bucket with others. Only their texts are read by
    the function, found by a Bloom filter of their doc_ids and an exact join; few representatives are broadcast to it."""
    wanted = members.select("rep").distinct().join(reps.select("rep", "doc_id", "set_hash"), "rep")
    wanted = written(wanted.withColumn("key", F.xxhash64("doc_id")), "wanted")
    n = wanted.count()
    bits = bloom.filter_bits(n)
    near = bloom.mark(docs.withColumn("key", F.xxhash64("doc_id")), "key", bloom.build(wanted, "key", bits), bits, "maybe")
    near = _with_sets(near.where("maybe").select("doc_id", "text"), words, banded=False)
    exact = near["doc_id"].eqNullSafe(wanted["doc_id"]) & (near["set_hash"] == wanted["set_hash"])
    with small_batches(docs.sparkSession):
        sets = written(near.join(families.sent(wanted, n), exact).select("rep", "n_shingles", "hashes"), "sets")
    # Rows that repeat a doc_id with an equal set all match their representative; one of them is enough.
    again = sets.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").select("rep")
    again = written(again, "repeated")
    if again.isEmpty():
        return sets
    first = sets.join(again, "rep").groupBy("rep").agg(*[F.first(c).alias(c) for c in ("n_shingles", "hashes")])
    return written(sets.join(again, "rep", "left_anti").union(first), "sets")


def _labels(buckets: DataFrame, reps: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(rep, label) of the components of all links between bucket mates; representatives without a link are left out."""
    ends = buckets.groupBy("bucket").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x <> y").select("bucket")
    ends = written(ends, "shared")
    # Most buckets have one member; a Bloom filter keeps their rows from the join.
    bits = bloom.filter_bits(ends.count())
    maybe = bloom.mark(buckets, "bucket", bloom.build(ends, "bucket", bits), bits, "maybe").where("maybe").drop("maybe")
    rows = written(maybe.join(ends, "bucket"), "members")
    return families.components_within(rows, _whole_sets(rows, reps, docs, words), percent)


def _judged(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """A row for each row of docs (doc_id, text and others): these without text, n_shingles, component_id, and whether
    the row ``stays``, which of a component is the first one by doc_id, NULL last, and by row."""
    banded = _with_sets(docs, words, banded=True).withColumn("row", F.monotonically_increasing_id())
    with small_batches(docs.sparkSession):
        banded = written(banded, "sketches")
    some = banded.where("n_shingles > 0")
    # The first row of a class by id, NULL last, and by row among those that repeat an id.
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    copies = F.count("*").alias("copies")
    classes = some.groupBy("set_hash").agg(F.min("row").alias("rep"), F.min(place).alias("first"), copies)
    rows = written(some.join(classes, "set_hash"), "sketches")
    reps = rows.where("row = rep").select("rep", "doc_id", "first", "set_hash", "n_shingles")
    buckets = rows.where("row = rep").select(
        "rep", F.col("n_shingles").alias("n"), "copies", F.explode("hashes").alias("bucket")
    )
    labels = _labels(buckets, reps, docs, words, percent)
    firsts = labels.join(reps.select("rep", "first"), "rep").groupBy("label")
    firsts = written(firsts.agg(F.min("first").alias("least")), "firsts")
    members = written(labels.join(firsts, "label").select("rep", "least"), "components")
    least = F.coalesce("least", "first")
    own = [c for c in docs.columns if c != "text"]
    out = rows.drop("hashes").join(members, "rep", "left").select(
        *own, "n_shingles", least["doc_id"].alias("component_id"), (F.col("row") == least["row"]).alias("stays")
    )
    none = banded.where("n_shingles = 0")
    return out.unionByName(none.select(*own, "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("stays")))


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * common shingles >= percent * all shingles of the two, on whole sets of ``words``
    words; component_id is the smallest doc_id that links lead to, and the document that has it is kept.

    Documents of equal sets are one class, found by a 128-bit hash; only a class's first row goes on, so groups of
    copies cost a count. Candidates are mates in one of 32 buckets (see BINS); per bucket they form a star, so their
    number follows the number of rows, and each link is confirmed on the whole sets. Where a star leaves a bucket in
    several components, links between its members are found by their differences (see families.py): none is lost.

    A text of fewer words is one shingle. NULL, empty and white texts have no shingles, are linked with nothing and
    kept, each with its own id. Rows that repeat a doc_id share links by text; NULL ids come last in a component.
    Other columns are ignored.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = _judged(docs, words, percent).drop("stays")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80
) -> DataFrame:
    """Of each component of ``near_duplicates`` one row, that of the smallest doc_id, NULL last; all columns as they were.
    Texts without shingles stay.

    Rows are judged one by one: a row is told by its doc_id and its text's SHA-256, so other rows of a doc_id stay. Of
    rows that are equal in both and stay, any one does. Only rows that go or repeat are joined: a Bloom filter lets
    others pass without a shuffle.
    """
    digest = F.unhex(F.sha2(F.col(text).cast("binary"), 256))
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), digest.alias("digest"))
    judged = _judged(narrow, words, percent).where("n_shingles > 0")
    told = judged.groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_sha"))
    told = told.agg(F.max("stays").alias("_stays"), F.count("*").alias("n")).where("n > 1 OR NOT _stays").drop("n")
    told = written(told.withColumn("_key", F.xxhash64("_id", "_sha")), "gone")
    key, sha, maybe = fresh(docs, "_key"), fresh(docs, "_digest"), fresh(docs, "_maybe")
    bits = bloom.filter_bits(told.count())
    keyed = docs.withColumn(sha, digest).withColumn(key, F.xxhash64(doc_id, sha))
    marked = bloom.mark(keyed, key, bloom.build(told, "_key", bits), bits, maybe)
    near = marked.where(maybe).select(F.struct(*docs.columns).alias("_all"), F.col(doc_id).alias("_doc"), F.col(sha).alias("_digest"))
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_sha"))
    chance = near.join(told, same, "left_anti")
    one = near.join(told.where("_stays"), same, "left_semi").groupBy("_doc", "_digest").agg(F.first("_all").alias("_all"))
    left = chance.select("_all.*").unionByName(one.select("_all.*"))
    return marked.where(~F.col(maybe)).select(*docs.columns).unionByName(left)
