"""Both plans of the nearest search beside brute force, on rows where they could differ, and its queries beside their SQL."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from agentlog.config import Settings
from agentlog.operators import vectors as ve
from tests.compare import rows_of

PLANS = [Settings(), Settings(baseline_broadcast_bytes=0)]


def frames(spark):
    rng = np.random.default_rng(4)
    base = [(str(i % 37), rng.normal(size=6).tolist()) for i in range(60)] + [("none", None), ("zero", [0.0] * 6)]
    queries = [(str(i), rng.normal(size=6).tolist(), i) for i in range(40)]
    queries += [("5", rng.normal(size=6).tolist(), 100), ("5", None, 101), (None, base[0][1], 102), ("x", [0.0] * 6, 103)]
    queries += [queries[3], queries[3]]
    b = spark.createDataFrame(base, "id string, embedding array<double>")
    return base, queries, b, spark.createDataFrame(queries, "id string, embedding array<double>, n int")


def expected(query, base, k, exclude):
    def unit(v):
        v = np.zeros(6) if v is None else np.array(v)
        return v / max(math.sqrt(v @ v), 1e-12)

    rows = [(1 - unit(query[1]) @ unit(v), i) for i, v in base if not (exclude and i == query[0])]
    return sorted((round(float(d), 9), i) for d, i in rows)[:k]


@pytest.mark.parametrize("exclude", [False, True])
@pytest.mark.parametrize("cfg", PLANS, ids=["broadcast", "tiles"])
def test_edge_rows(spark, cfg, exclude):
    base, queries, b, q = frames(spark)
    got = ve.nearest(q, b, k=4, cfg=cfg, exclude_self=exclude).collect()
    assert len(got) == len(queries)
    by_n = {x[2]: x for x in queries}
    for r in got:
        assert sorted((round(h.distance, 9), h.id) for h in r.nearest) == expected(by_n[r.n], base, 4, exclude)
        assert [h.distance for h in r.nearest] == sorted(h.distance for h in r.nearest)
    scores = {r.n: r.score for r in ve.anomaly_score(q, b, cfg, exclude_self=exclude).collect()}
    for n, x in by_n.items():
        assert scores[n] == pytest.approx(expected(x, base, 1, exclude)[0][0], abs=1e-9)
    assert scores[101] == scores[103] == 1.0


def test_empty_sides_and_metadata(spark):
    _, _, b, q = frames(spark)
    for cfg in PLANS:
        assert ve.anomaly_score(q, b.where("false"), cfg).where("score <> 1").isEmpty()
        assert ve.nearest(q.where("false"), b, cfg=cfg).isEmpty()
        alone = ve.anomaly_score(q.where("n = 1"), b.where("id = '1'"), cfg, exclude_self=True)
        assert alone.first().score == 1.0
    named = b.selectExpr("id", "embedding", "concat('text of ', id) AS document").dropDuplicates(["id"])
    rows = ve.neighbour_rows(ve.nearest(q.where("n = 7"), named, k=3), named).orderBy("rank").collect()
    assert [r.rank for r in rows] == [1, 2, 3] and all(r.document == f"text of {r.id}" for r in rows)


def base_of(rows):
    ids = np.array([f"{i:05d}" for i in range(len(rows))])
    lengths = ve._lengths(rows)
    return ve._Base(ids, rows, lengths, bool(np.isfinite(lengths).all()))


@pytest.mark.parametrize("k", [1, 5])
@pytest.mark.parametrize("kind", [np.float32, np.float64])
def test_blocks_are_left_out_only_where_none_is_near(k, kind):
    """Thousands of rows in many blocks: near ties that single precision can't tell apart, repeats, zeros."""
    rng = np.random.default_rng(8)
    rows = rng.normal(size=(4000, 16))
    rows[1500:1700] = rows[0] + rng.normal(size=(200, 16)) * 1e-8
    rows[2000:2600], rows[3000:3010] = rows[7], 0
    rows = rows.astype(kind)
    unit = rows.astype(np.float64) / ve._lengths(rows)[:, None]
    asked = np.array([0, 1, 7, 1600, 2300, 3001, 3999])
    lo, hi = asked.copy(), asked + 1
    hi[2], hi[6] = 2600, 3999  # a range over several blocks, and none
    d, i = ve._search(unit[asked], base_of(rows), k, (lo, hi))
    for row, (a, b) in enumerate(zip(lo, hi)):
        exact = 1 - unit @ unit[asked[row]]
        exact[a:b] = np.inf
        assert np.allclose(d[row], np.sort(exact)[:k], atol=1e-12, rtol=0)
        assert np.allclose(exact[i[row]], d[row], atol=1e-12, rtol=0) and len(set(i[row])) == k


def test_rows_that_are_not_numbers_are_searched_in_full():
    rows = np.random.default_rng(2).normal(size=(3000, 4))
    rows[1234] = np.nan
    d, i = ve._search(rows[:1] / ve._lengths(rows[:1])[:, None], base_of(rows), 3, None)
    assert np.isnan(d[0][0]) and i[0][1] == 0 and abs(d[0][1]) < 1e-12


def test_floats_count_half(spark):
    b = spark.createDataFrame([("a", [1.0, 2.0])], "id string, embedding array<double>")
    single = b.selectExpr("id", "cast(embedding AS array<float>) AS embedding")
    assert (ve.baseline_size(b).bytes, ve.baseline_size(single).bytes) == (16, 8)


@pytest.mark.parametrize("name", ["nearest_vectors", "nearest_vectors_cells"])
def test_every_vector_is_asked(spark, tmp_path, name):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=12).tolist(), 0) for i in range(1, 700, 3)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    wanted = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, str(tmp_path))
    left, right = rows_of(got.columns, [tuple(r) for r in got.collect()]), rows_of(wanted.columns, wanted.fetchall())
    assert left == right and sum(right[1].values()) == 5 * len(rows)


def test_a_row_is_searched_once(spark):
    """Also below a generator, whose filter would otherwise search again."""
    _, _, b, q = frames(spark)
    plan = ve.nearest(q, b, k=2).select("n", F.explode("nearest"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
