"""An index for nearest search among many vectors: cells, residual codes and exact re-ranking.

Unit vectors are dealt to the cell of the closest of some centroids, and kept there as one byte per dimension of what is left
after the centroid. A query looks into the few cells whose centroids are closest to it, takes the best candidates by
code, and compares those with the whole vectors. Its cost is the size of the cells it looks into, not of the table. The exact
search in ``vectors.py`` stays as it is; results agree where the neighbours are in the cells looked into.

Centroids, code ranges and the number of cells to look into are fitted on a sample of at most ``sample_rows`` rows, chosen by
a hash of the id; every row is indexed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agentlog.functions.plan import broadcast_up_to
from agentlog.operators.vectors import NEAREST_TYPE, baseline_size, dot, unit

CHUNK, TILE = 8192, 1024  # rows of a cell and queries that one task compares
MOST_CELLS = 4096


@dataclass(frozen=True)
class IndexSettings:
    sample_rows: int = 65_536
    sample_bytes: int = 64 << 20
    cells: int | None = None  # by default the root of the number of rows, up to MOST_CELLS
    recall: float = 0.97  # share of a sample query's k nearest that lies in the cells looked into
    k: int = 5
    rerank: int = 8  # candidates by code for each neighbour wanted
    rounds: int = 10


@dataclass(frozen=True)
class IndexModel:
    centroids: np.ndarray  # a unit row per cell
    low: np.ndarray  # per dimension the least residual and the step of a code
    step: np.ndarray
    probes: int  # cells a query looks into

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]


@dataclass(frozen=True)
class VectorIndex:
    """``rows``: (cell, chunk, uid, id, code, embedding, others), sorted by cell; ``chunks``: per cell the number of chunks."""

    model: IndexModel
    rows: DataFrame
    chunks: dict[int, int]


# --- helpers used on the driver and inside tasks ----------------------------------------------------------------------


def _units(lists: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Unit rows; missing vectors are zero."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    out = np.zeros((len(lists), dim), np.float32)
    there = lists.is_valid().to_numpy(zero_copy_only=False)
    if there.any():
        out[there] = lists.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-12)


def _cells(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([(rows[i : i + TILE] @ centroids.T).argmax(axis=1) for i in range(0, len(rows), TILE)] or [np.empty(0, np.int64)])


def _codes(rows: np.ndarray, cell: np.ndarray, model: IndexModel) -> np.ndarray:
    steps = np.rint((rows - model.centroids[cell] - model.low) / model.step)
    return np.clip(steps, 0, 255).astype(np.uint8)


def fit_model(sample: np.ndarray, cells: int, cfg: IndexSettings) -> IndexModel:
    """Spherical k-means, the range of residuals, and as many probes as the sample's own neighbours need."""
    rng = np.random.default_rng(0)
    centroids = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)].copy()
    for _ in range(cfg.rounds):
        cell = _cells(sample, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, sample)
        lengths = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centroids = np.where(lengths > 1e-9, sums / np.maximum(lengths, 1e-9), centroids).astype(np.float32)
    cell = _cells(sample, centroids)
    left = sample - centroids[cell]
    low, high = left.min(axis=0), left.max(axis=0)
    step = np.maximum((high - low) / 255, 1e-9)
    asked = rng.choice(len(sample), min(512, len(sample)), replace=False)
    near = sample[asked] @ sample.T
    near[np.arange(len(asked)), asked] = -np.inf
    k = min(cfg.k, max(len(sample) - 1, 1))
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    order = np.argsort(-(sample[asked] @ centroids.T), axis=1)
    place = np.argsort(order, axis=1)  # of each cell in a query's order of cells
    depth = np.sort(np.take_along_axis(place, cell[best], axis=1).ravel())
    probes = int(depth[min(math.ceil(cfg.recall * len(depth)), len(depth)) - 1]) + 1
    return IndexModel(centroids, low.astype(np.float32), step.astype(np.float32), probes)


# --- building ---------------------------------------------------------------------------------------------------------


def build_index(baseline: DataFrame, path: str, cfg: IndexSettings = IndexSettings()) -> VectorIndex:
    """Index every row of ``baseline`` (id, embedding, others) and write it to a folder that executors share.

    One pass deals rows to cells and one shuffle sorts them by cell. Cells above CHUNK rows are dealt to several chunks by
    a hash, so that no task gets a whole large cell. Raises for an empty baseline.
    """
    size = baseline_size(baseline)
    if not size.rows or not size.dim:
        raise ValueError("an index needs vectors")
    dim = size.dim
    wanted = max(1, min(cfg.sample_rows, cfg.sample_bytes // (4 * dim)))
    hashed = F.shiftrightunsigned(F.xxhash64(F.col("id").cast("string"), F.lit("sample")), 11) / F.lit(float(1 << 53))
    some = baseline.where(F.col("embedding").isNotNull() & (hashed < min(1.0, 1.1 * wanted / size.rows)))
    # The limit only cuts what the hash drew above its share.
    sample = _units(some.select(F.col("embedding").cast("array<float>").alias("e")).limit(wanted).toArrow()["e"], dim)
    if not len(sample):
        sample = np.zeros((1, dim), np.float32)
    cells = cfg.cells or min(MOST_CELLS, max(1, math.isqrt(size.rows)))
    model = fit_model(sample, cells, cfg)

    @F.arrow_udf("cell int, code binary")
    def placed(vectors: pa.Array) -> pa.Array:
        rows = _units(vectors, dim)
        cell = _cells(rows, model.centroids)
        codes = _codes(rows, cell, model)
        return pa.StructArray.from_arrays([pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], ["cell", "code"])

    vectors = baseline.withColumns({"id": F.col("id").cast("string"), "embedding": F.col("embedding").cast("array<float>")})
    rows = vectors.withColumn("uid", F.monotonically_increasing_id()).withColumn("_at", placed.asNondeterministic()("embedding"))
    rows = rows.select("uid", *vectors.columns, F.col("_at.cell").alias("cell"), F.col("_at.code").alias("code"))
    rows.write.mode("overwrite").parquet(f"{path}/dealt")
    rows = baseline.sparkSession.read.parquet(f"{path}/dealt")
    chunks = {r.cell: -(-r["count"] // CHUNK) for r in rows.groupBy("cell").count().collect()}
    chunked = rows.withColumn("chunk", F.pmod(F.xxhash64("uid"), _per_cell(chunks)).cast("int"))
    chunked.repartitionByRange("cell", "chunk").sortWithinPartitions("cell", "chunk").write.mode("overwrite").parquet(f"{path}/rows")
    kept = [model.centroids.ravel(), model.low, model.step]
    meta = [(*[[float(x) for x in a] for a in kept], dim, model.probes, chunks)]
    schema = "centroids array<float>, low array<float>, step array<float>, dim int, probes int, chunks map<int,int>"
    baseline.sparkSession.createDataFrame(meta, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    return read_index(baseline.sparkSession, path)


def read_index(spark: SparkSession, path: str) -> VectorIndex:
    """An index that ``build_index`` has written."""
    m = spark.read.parquet(f"{path}/model").first()
    array = lambda x: np.array(x, np.float32)
    model = IndexModel(array(m.centroids).reshape(-1, m.dim), array(m.low), array(m.step), m.probes)
    return VectorIndex(model, spark.read.parquet(f"{path}/rows"), dict(m.chunks))


def _per_cell(numbers: dict[int, int]) -> Column:
    """A cell's number, from an array of at most MOST_CELLS."""
    table = F.array(*[F.lit(numbers.get(c, 1)) for c in range(max(numbers) + 1)])
    return F.coalesce(F.get(table, F.col("cell")), F.lit(1))


# --- search -----------------------------------------------------------------------------------------------------------


def probed(queries: DataFrame, index: VectorIndex, probes: int | None = None) -> DataFrame:
    """The queries with ``cells``: those to look into, closest first. No shuffle."""
    model, wanted = index.model, min(probes or index.model.probes, len(index.model.centroids))

    @F.arrow_udf("array<int>")
    def closest(vectors: pa.Array) -> pa.Array:
        near = _units(vectors, model.dim) @ model.centroids.T
        order = np.argsort(-near, axis=1, kind="stable")[:, :wanted].astype(np.int32)
        return pa.array(list(order), pa.list_(pa.int32()))

    return queries.withColumn("cells", closest(F.col("embedding").cast("array<float>")))


def compared_pairs(queries: DataFrame, index: VectorIndex, probes: int | None = None) -> int:
    """How many codes all queries together are compared with."""
    sizes = index.rows.groupBy("cell").agg(F.count("*").alias("n"))
    asked = probed(queries, index, probes).select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("q"))
    return asked.join(sizes, "cell").agg(F.sum(F.col("q") * F.col("n")).alias("n")).first().n or 0


def nearest_indexed(
    queries: DataFrame,
    index: VectorIndex,
    k: int | None = None,
    id_col: str = "id",
    exclude_self: bool = False,
    probes: int | None = None,
    cfg: IndexSettings = IndexSettings(),
) -> DataFrame:
    """Queries with ``nearest`` as in ``vectors.nearest``: up to k rows of the index by exact cosine distance, ties by id.

    Queries and chunks of the cells they look into meet by (cell, chunk, tile): a task compares up to TILE queries with up
    to CHUNK codes in one matrix product and gives the best few of each query. The best of all chunks are joined with
    their whole vectors. A missing vector is at distance 1 from everything; as a query its neighbours are any rows.
    ``exclude_self`` leaves out all rows of the query's id. Repeated queries are answered each.
    """
    k = k or cfg.k
    model, few = index.model, k * cfg.rerank
    # Rows of one id and one vector have one answer, so they are told by 128 bits of both.
    qid, vector = F.col(id_col).cast("string"), F.col("embedding").cast("array<float>")
    keyed = queries.withColumn("_uid", F.concat_ws("/", *[F.xxhash64(F.lit(i), qid.isNull(), qid, vector) for i in (0, 1)]))
    asked = keyed.select("_uid", qid.alias("_qid"), vector.alias("_q")).dropDuplicates(["_uid"])
    asked = probed(asked.withColumnRenamed("_q", "embedding"), index, probes).withColumnRenamed("embedding", "_q")
    found = asked.withColumn("cell", F.explode("cells")).drop("cells")
    per_cell = {r.cell: -(-r["count"] // TILE) for r in found.groupBy("cell").count().collect()}
    if not per_cell:
        return queries.withColumn("nearest", F.array().cast(NEAREST_TYPE))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    tiled = found.withColumn("tile", F.pmod(F.xxhash64("_uid"), _per_cell(per_cell)).cast("int"))
    tiled = tiled.withColumn("chunk", every(_per_cell(index.chunks)))
    codes = index.rows.where(F.col("cell").isin(sorted(per_cell)) if len(per_cell) < 1000 else F.lit(True))
    codes = codes.select("cell", "chunk", "uid", "id", "code").withColumn("tile", every(_per_cell(per_cell)))

    def best(key: tuple, part: pa.Table, chunk: pa.Table) -> pa.Table:
        names = ["_uid", "uid", "approx"]
        if not part.num_rows or not chunk.num_rows:
            return pa.table({"_uid": pa.array([], pa.string()), "uid": pa.array([], pa.int64()), "approx": pa.array([], pa.float32())})
        q = _units(part["_q"], model.dim)
        raw = np.frombuffer(b"".join(chunk["code"].to_pylist()), np.uint8).reshape(-1, model.dim)
        near = q @ (raw * model.step + (model.low + model.centroids[key[0].as_py()])).T
        if exclude_self:
            asking: dict[str, list[int]] = {}
            for row, name in enumerate(part["_qid"].to_pylist()):
                asking.setdefault(name, []).append(row)
            for column, name in enumerate(chunk["id"].to_pylist()):
                if name is not None and name in asking:
                    near[asking[name], column] = -np.inf
        n = min(few, near.shape[1])
        top = np.argpartition(-near, n - 1, axis=1)[:, :n]
        value = np.take_along_axis(near, top, axis=1)
        row, place = np.nonzero(np.isfinite(value))
        uids = chunk["uid"].to_numpy()
        asker = part["_uid"].combine_chunks().take(pa.array(row))
        columns = [asker, pa.array(uids[top[row, place]]), pa.array(value[row, place].astype(np.float32))]
        return pa.table(dict(zip(names, columns, strict=True)))

    keys = ["cell", "chunk", "tile"]
    hits = tiled.groupBy(*keys).cogroup(codes.groupBy(*keys)).applyInArrow(best, "_uid string, uid bigint, approx float")
    order = Window.partitionBy("_uid").orderBy(F.desc("approx"), "uid")
    hits = hits.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= few).select("_uid", "uid")
    # The few candidates go to the table of vectors, which isn't shuffled as long as they may be broadcast.
    answer = F.coalesce(F.col("nearest").cast(NEAREST_TYPE), F.array().cast(NEAREST_TYPE))
    whole = index.rows.select("uid", F.col("id").alias("_id"), F.col("embedding").alias("_e"))
    with_vectors = whole.join(broadcast_up_to(hits, asked.count() * few, row_bytes=16), "uid")
    ranked = with_vectors.join(asked.select("_uid", "_q"), "_uid")
    distance = F.lit(1.0) - dot(unit(F.col("_q")), unit(F.col("_e")))
    ranked = ranked.select("_uid", F.struct(F.coalesce(distance, F.lit(1.0)).alias("distance"), F.col("_id").alias("id")).alias("hit"))
    top = ranked.groupBy("_uid").agg(F.slice(F.array_sort(F.collect_list("hit")), 1, k).alias("nearest"))
    return keyed.join(top, "_uid", "left").select(*queries.columns, answer.alias("nearest"))
