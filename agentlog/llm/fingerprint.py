"""Document fingerprints by a randomised edit embedding."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentlog.llm.common import written

PERIOD, KINDS = 4096, 256  # of the walks' coin throws, by step and by kind of character
MOST = 128  # sampled components of a fingerprint
GRAM = 4  # characters a component stands for
BANDS, BAND_SIZE = 24, 6
TILE = 1024  # members of a bucket that one task compares
LARGE = 48 * TILE  # from here on tiles would copy a bucket's rows more often than a split does
CHARS_AT_ONCE, CELLS, ABREAST = 1 << 22, 1 << 22, 8  # of texts in hand; of a table of texts side by side; texts for one


class Embedder:
    """Random walks over characters. Step j of a walk throws a coin that depends on j and on the character it stands at:
    heads moves on to the next character. All texts share the coins, so walks over like texts stay or come back together,
    and few edits change few steps. What a walk stands at in steps 0, s, 2s, ... is the fingerprint, s being the power of
    two that leaves at most MOST components; texts of neighbouring lengths have every second component in common.
    """

    def __init__(self):
        heads = np.random.Generator(np.random.PCG64(20)).random((KINDS, PERIOD)) < 0.5
        # Steps from j to the one behind the next heads, for each kind of character; the coins repeat after PERIOD steps.
        twice = np.where(np.concatenate([heads, heads], axis=1), np.arange(2 * PERIOD), 4 * PERIOD)
        ahead = np.minimum.accumulate(twice[:, ::-1], axis=1)[:, ::-1][:, :PERIOD]
        # The place within the period behind the next heads, by kind and place.
        self.after = ((ahead + 1) % PERIOD).astype(np.int32).ravel()
        self.after_list = self.after.tolist()

    def walks(self, kinds: list[np.ndarray], starts: list[int] | None = None) -> list[np.ndarray]:
        """For each text the step at which the walk comes to each character, and the one at which it leaves the last.

        Coins decide by the place within the period; a character takes at least one step and at most a period. Texts of
        like length walk side by side, one character of each at a time; a few long ones walk alone.
        """
        starts = starts or [0] * len(kinds)
        order = sorted(range(len(kinds)), key=lambda i: -len(kinds[i]))
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(kinds)
        at = 0
        while at < len(order):
            longest = len(kinds[order[at]])
            group = order[at : at + max(1, CELLS // (longest + 1))]
            at += len(group)
            if len(group) >= ABREAST:
                places = self._abreast([kinds[i] for i in group], [starts[i] for i in group])
            else:
                places = (self._alone(kinds[i], starts[i]) for i in group)
            for i, place in zip(group, places, strict=True):
                taken = (np.diff(place) - 1) % PERIOD + 1
                out[i] = np.concatenate([[starts[i]], starts[i] + np.cumsum(taken)])
        return out

    def _alone(self, kinds: np.ndarray, start: int) -> np.ndarray:
        after = self.after_list
        walk = accumulate(kinds.tolist(), lambda place, kind: after[kind + place], initial=start % PERIOD)
        return np.fromiter(walk, np.int64, len(kinds) + 1)

    def _abreast(self, kinds: list[np.ndarray], starts: list[int]) -> Iterator[np.ndarray]:
        """The texts come longest first, so those still walking are the first ones."""
        lengths = np.array([len(k) for k in kinds])
        table = np.zeros((lengths[0], len(kinds)), np.int32)
        for i, k in enumerate(kinds):
            table[: len(k), i] = k
        places = np.zeros((lengths[0] + 1, len(kinds)), np.int32)
        places[0] = np.array(starts) % PERIOD
        walking = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left").tolist()
        for step, n in enumerate(walking):
            self.after.take(table[step, :n] + places[step, :n], out=places[step + 1, :n], mode="clip")
        return (places[: n + 1, i].astype(np.int64) for i, n in enumerate(lengths))

    @staticmethod
    def codes(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le"), np.uint32)

    @staticmethod
    def kinds(codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.int64) * PERIOD

    @staticmethod
    def sampled(codes: np.ndarray, steps: np.ndarray) -> str:
        """Two hexadecimal digits for the scale and for each component; empty for an empty text."""
        if not len(codes):
            return ""
        scale = max(0, int((steps[-1] - 1) // MOST).bit_length())
        at = np.searchsorted(steps, np.arange(0, steps[-1], 1 << scale), side="right") - 1
        value = np.zeros(len(at), np.uint64)
        for i in range(GRAM):
            there = at + i < len(codes)
            value = (value + np.where(there, codes[np.minimum(at + i, len(codes) - 1)], 0)) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
        return f"{scale:02x}" + (value >> np.uint64(7)).astype(np.uint8).tobytes().hex()


def likeness(a: str, b: str) -> float:
    """The share of components that two fingerprints have in common at the coarser one's scale; 1 for two empty texts."""
    if not a or not b:
        return float(a == b)
    if a[:2] > b[:2]:
        a, b = b, a
    stride = 1 << min(int(b[:2], 16) - int(a[:2], 16), 40)
    x, y = bytes.fromhex(a[2:])[::stride], bytes.fromhex(b[2:])
    return sum(map(int.__eq__, x, y)) / max(len(x), len(y))


def _in_buckets(docs: DataFrame) -> DataFrame:
    """Rows (bucket, later, doc_id, text): the documents by ranges of doc_id, and in each bucket, marked ``later``, the
    first document of the next one; the last bucket gets the first of all. Buckets are at most 65,536, so what is known
    of each fits the driver and a broadcast."""
    ids = docs.select("doc_id")
    n = ids.count()
    buckets = 1 << max(0, min(65_536, n // 16, max(4096, n // 20_000)).bit_length() - 1)
    points = [i / buckets for i in range(1, buckets)]
    cuts = ids.agg(F.percentile_approx("doc_id", points, 4 * buckets + 10_000).alias("c")).first()["c"] if points else None
    cut = F.array(*[F.lit(c) for c in cuts]) if cuts else None

    def further(at: Column, step: Column) -> Column:
        return F.when(F.get(cut, at + step - 1) <= F.col("doc_id"), at + step).otherwise(at)

    halves = F.array(*[F.lit(buckets >> i) for i in range(1, buckets.bit_length())])
    bucket = F.aggregate(halves, F.lit(0), further) if cuts else F.lit(0)
    docs = docs.withColumn("bucket", bucket)
    firsts = docs.groupBy("bucket").agg(F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("null"))
    found = sorted((r.bucket, None if r.null else r.first) for r in firsts.collect())
    before = [(found[i - 1][0], found[i][1], found[i][0]) for i in range(len(found))]
    edges = docs.sparkSession.createDataFrame(before, f"earlier int, first {dict(docs.dtypes)['doc_id']}, b int")
    own = F.struct("bucket", F.lit(False).alias("later"))
    other = F.struct(F.col("earlier").alias("bucket"), F.lit(True).alias("later"))
    at_edge = (F.col("bucket") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("first"))
    placed = docs.join(F.broadcast(edges), at_edge, "left").withColumn(
        "to", F.explode(F.when(F.col("b").isNull(), F.array(own)).otherwise(F.array(own, other)))
    )
    placed = placed.select("to.bucket", "to.later", "doc_id", "text")
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(partitions, "bucket").sortWithinPartitions("bucket", "later", "doc_id", "text")


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    embed = Embedder()
    waiting: list[tuple] = []  # rows (bucket, later, doc_id, text), read but not answered
    size, kind = 0, None
    for batch in batches:
        kind = batch.schema.field("doc_id").type
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            waiting.append(row)
            size += len(row[3])
            if size >= CHARS_AT_ONCE:
                yield _answers(embed, waiting, kind)
                waiting = waiting[-1:]  # its next row is still to come
                size = len(waiting[0][3])
    if kind is not None:
        yield _answers(embed, waiting, kind)


PRINTS = pa.schema(
    {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(),
     "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}
)


def _answers(embed: Embedder, rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    """An output row for each document that is followed by a row of its bucket. The walk over the edited text is that
    over the text up to the edit."""
    codes = [embed.codes(text) for _, _, _, text in rows]
    kinds = [embed.kinds(c) for c in codes]
    steps = embed.walks(kinds)
    own = [embed.sampled(c, s) for c, s in zip(codes, steps, strict=True)]
    asked = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
    kept = [len(codes[i]) - len(codes[i]) // 4 for i in asked]
    new = [kinds[i + 1][: len(codes[i]) // 4] for i in asked]
    ends = embed.walks(new, [int(steps[i][k]) for i, k in zip(asked, kept, strict=True)])
    out = []
    for i, k, end in zip(asked, kept, ends, strict=True):
        n = len(codes[i]) // 4
        edited = embed.sampled(np.concatenate([codes[i][:k], codes[i + 1][:n]]), np.concatenate([steps[i][:k], end]))
        digest = hashlib.sha256((rows[i][3][:k] + rows[i + 1][3][:n]).encode()).hexdigest()
        near = likeness(own[i], edited), likeness(own[i], own[i + 1])
        out.append((rows[i][2], len(codes[i]), digest, own[i], edited, *near))
    columns = list(zip(*out, strict=True)) or [()] * len(PRINTS.names)
    types = [kind, *PRINTS.types[1:]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], PRINTS.names)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the document's last quarter replaced by the first characters of the next document, as many or
    all there are. Texts are shuffled once, into ranges of ids; each range has the document that follows it, so a task
    reads its documents in order, one by one.

    NULL texts are empty. Empty texts have an empty fingerprint, which is like other empty ones only. Next is the next
    row by doc_id, NULL first, then by text; behind the last comes the first, which for a single row is itself.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    return _in_buckets(docs).mapInArrow(
        _walked,
        f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )


def _bytes(print_: Column, places: list[int]) -> Column:
    return F.concat(*[F.substring(print_, 2 + p, 1) for p in places])


def _split(rows: DataFrame, least: float) -> DataFrame:
    """The rows of large buckets in buckets of further components: short blocks of neighbouring ones, so many that a
    likeness of ``least`` leaves at least one block equal, at the scale at which the two are compared."""
    wide = 1 / (1 - min(least, 0.99))
    size = max(1, min(4, math.ceil(round(wide, 6)) - 1))
    blocks = []
    for up in (0, 1):
        for at in range(0, MOST >> up, size):
            there = _bytes(F.col("print"), [p << up for p in range(at, min(at + size, MOST >> up))])
            key = F.xxhash64("bucket", F.lit(at), _scale(F.col("print")) + up, there)
            blocks.append(F.when(F.octet_length(there) > 0, key))
    parts = rows.withColumn("part", F.explode(F.array_compact(F.array(*blocks))))
    parts = written(parts.select(F.col("part").alias("bucket"), "doc_id", "open", "print"), "parts")
    sizes = parts.groupBy("bucket").agg(F.count("*").alias("size"), F.max("open").alias("any")).where("size > 1 AND any")
    return parts.join(written(sizes.drop("any"), "parts"), "bucket").select(*rows.columns)


def _matches(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray, least: float) -> np.ndarray:
    """Which of the components x (a row each, nx of them filled) have a likeness of ``least`` or more with which of y."""
    w = int(min(nx.max(), ny.max()))
    y = np.where(y[:, :w] == 256, 257, y[:, :w])  # what is missing equals nothing
    if len(x) * len(y) <= 1024:
        same = (x[:, None, :w] == y[None]).sum(axis=2)
    else:
        same = np.zeros((len(x), len(y)), np.uint8)
        x, y = np.ascontiguousarray(x[:, :w].T), np.ascontiguousarray(y.T)
        for i in range(w):
            same += x[i][:, None] == y[i]
    return same / np.maximum(nx[:, None], ny) >= least


def _first_likes(rows: list[tuple], least: float, across: bool) -> dict[int, int]:
    """Rows (side, open, print) in order of their ids -> for each open row the first one before it that is like it;
    ``across``, only those of the other side."""
    n = len(rows)
    codes, filled = np.full((n, MOST), 256, np.uint16), np.empty(n, np.int64)
    scale, side = np.array([r[2][0] for r in rows]), np.array([r[0] for r in rows])
    for i, (_, _, print_) in enumerate(rows):
        filled[i] = len(print_) - 1
        codes[i, : filled[i]] = np.frombuffer(print_, np.uint8)[1:]
    first = np.where([r[1] for r in rows], n, -1)  # n: asked, not found
    for a in np.unique(scale):
        for b in np.unique(scale):
            sx, sy = 1 << min(max(b - a, 0), 7), 1 << min(max(a - b, 0), 7)
            for s in np.unique(side) if across else (None,):
                targets = np.flatnonzero((scale == b) & (side != s) if across else scale == b)
                for at in range(0, len(targets), 64):
                    t = targets[at : at + 64]
                    q = np.flatnonzero((scale == a) & (first > t[0]) & (np.arange(n) > t[0]))
                    q = q[side[q] == s] if across else q
                    if not len(q):
                        continue
                    like = _matches(codes[q, ::sx], -(-filled[q] // sx), codes[t, ::sy], -(-filled[t] // sy), least)
                    like &= t < q[:, None]
                    hit = like.any(axis=1)
                    first[q[hit]] = np.minimum(first[q[hit]], t[like[hit].argmax(axis=1)])
    return {i: int(f) for i, f in enumerate(first) if 0 <= f < n}


def _compared(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (bucket, i, j, side, doc_id, open, print) sorted by tile and id -> (print, alike_id) of what each tile finds."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, rows, out, kind = None, [], [], None

        def done() -> None:
            likes = _first_likes([r[3:4] + r[5:] for r in rows], least, across=tile[1] != tile[2])
            out.extend((rows[q][6], rows[t][4]) for q, t in likes.items())

        def answered() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [(), ()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], kind)], ["print", "alike_id"])

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[:3] != tile:
                    if rows:
                        done()
                    tile, rows = row[:3], []
                rows.append(row)
            yield answered()
        if rows:
            done()
            yield answered()

    return compared


def _scale(print_: Column) -> Column:
    return F.conv(F.hex(F.substring(print_, 1, 1)), 16, 10).cast("int")


def _classes(some: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, print), a row for each distinct fingerprint, with the smallest id that has it; found by a 128-bit hash.
    And (print, alike_id) of those that several rows have."""
    keyed = some.select("doc_id", "print", F.xxhash64("print").alias("k"), F.xxhash64(F.lit(1), "print").alias("k2"))
    copies = keyed.groupBy("k", "k2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = written(copies.drop("n"), "copies")
    firsts = keyed.join(copies, ["k", "k2"]).where("doc_id = first").select("doc_id", "print").distinct()
    firsts = written(firsts, "firsts")
    singles = keyed.join(copies, ["k", "k2"], "left_anti").select("doc_id", "print")
    return written(singles.union(firsts), "classes"), firsts.select("print", F.col("doc_id").alias("alike_id"))


def alike(prints: DataFrame, least: float = 0.8) -> DataFrame:
    """(fingerprint, alike_id): the smallest id among a fingerprint's own documents and those that share a bucket with it
    and have a likeness of ``least`` or more. Fingerprints of one document that is like no smaller id may be left out.

    Equal fingerprints are one class. Bands: BAND_SIZE components at places drawn at random, the same for all; two
    classes meet in a bucket when all of a band agree, at their own scale or the next coarser one. First each bucket is a
    star around its smallest id, so pairs are as many as rows. Where a member isn't like that one or a smaller id, all
    smaller members of the bucket are compared with it, in tiles of TILE by TILE; buckets above LARGE are split on
    further components before. So no like pair of bucket mates is missed; the tiles' cost is the number of pairs in
    buckets whose members are unlike their smallest id. Empty texts and NULL ids take no part.
    """
    some = prints.where("fingerprint <> '' AND doc_id IS NOT NULL").select("doc_id", F.unhex("fingerprint").alias("print"))
    classes, copies = _classes(some)
    places = np.random.Generator(np.random.PCG64(21)).integers(0, MOST // 2, (BANDS, BAND_SIZE)).tolist()

    def band(i: int, up: int) -> Column:
        digits = [F.substring("print", 2 + (p << up), 1) for p in places[i]]
        return F.xxhash64(F.lit(i), _scale(F.col("print")) + up, *digits)

    keys = F.array(*[band(i, up) for i in range(BANDS) for up in (0, 1)])
    rows = classes.select("doc_id", F.explode(keys).alias("bucket"))
    stars = rows.groupBy("bucket").agg(F.min("doc_id").alias("centre"), F.count("*").alias("size")).where("size > 1")
    members = written(rows.join(written(stars, "stars"), "bucket"), "members")
    classes = written(classes.join(members.select("doc_id").distinct(), "doc_id", "left_semi"), "classes")

    @F.arrow_udf("double")
    def near(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([likeness(x.as_py().hex(), y.as_py().hex()) for x, y in zip(a, b, strict=True)], pa.float64())

    pairs = written(members.where("doc_id > centre").select("doc_id", "centre").distinct(), "pairs")
    both = pairs.join(classes, "doc_id").join(classes.select(F.col("doc_id").alias("centre"), F.col("print").alias("other")), "centre")
    close = both.where(near("print", "other") >= least).select("print", F.col("centre").alias("alike_id"))
    close = written(close.groupBy("print").agg(F.min("alike_id").alias("alike_id")), "close")

    # What is open: members of buckets that may have a smaller like id in the bucket than the one found.
    best = classes.join(close, "print", "left").groupBy("doc_id").agg(F.max(F.coalesce("alike_id", "doc_id")).alias("best"))
    judged = members.where("size > 2").join(written(best, "best"), "doc_id").withColumn("open", F.col("best") > F.col("centre"))
    judged = written(judged.select("bucket", "size", "doc_id", "open"), "judged")
    undone = written(judged.where("open").select("bucket").distinct(), "undone")
    rows = judged.join(undone, "bucket").join(classes, "doc_id").select("bucket", "size", "doc_id", "open", "print")
    rows = written(rows, "undone")
    if not rows.isEmpty():
        small = rows.where(F.col("size") <= LARGE)
        if not (large := rows.where(F.col("size") > LARGE)).isEmpty():
            small = small.union(_split(large, least))
        tiles = F.ceil(F.col("size") / TILE).cast("int")
        tiled = small.withColumn("side", F.pmod(F.xxhash64("doc_id"), tiles).cast("int"))
        tiled = tiled.withColumn("to", F.explode(F.sequence(F.lit(0), tiles - 1)))
        tiled = tiled.select("bucket", F.least("side", "to").alias("i"), F.greatest("side", "to").alias("j"), "side", "doc_id", "open", "print")
        tiled = tiled.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "doc_id")
        kind = dict(prints.dtypes)["doc_id"]
        close = close.union(written(tiled.mapInArrow(_compared(least), f"print binary, alike_id {kind}"), "tiles"))
    # Copies have their class's first id at least.
    found = close.union(copies).groupBy("print").agg(F.min("alike_id").alias("alike_id"))
    return found.select(F.lower(F.hex("print")).alias("fingerprint"), "alike_id")


def with_alike(prints: DataFrame, least: float = 0.8) -> DataFrame:
    """The fingerprints with ``alike_id``, a document's own id where it is like none of a smaller id."""
    columns = prints.columns
    prints = written(prints, "prints")
    found = written(alike(prints, least), "alike")
    like = F.when(F.col("doc_id").isNotNull(), F.coalesce("alike_id", "doc_id"))
    return prints.join(found, "fingerprint", "left").select(*columns, like.alias("alike_id"))
