"""The index beside the exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from agentlog.operators import vectorindex as vi
from agentlog.operators import vectors as ve


def hits(df):
    return {r.id: [h.id for h in r.nearest] for r in df.collect()}


def test_recall_on_the_given_vectors(spark, tmp_path):
    """Ids divisible by 100 against all rows: at least 0.9 of the five nearest, for fewer comparisons than pairs."""
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").cast("string").alias("id"), "vec_id", "embedding")
    index = vi.build_index(v, str(tmp_path))
    asked = v.where("vec_id % 100 = 0")
    got, want = hits(vi.nearest_indexed(asked, index, exclude_self=True)), hits(ve.nearest(asked, v, exclude_self=True))
    found = sum(len(set(got[i]) & set(want[i])) for i in want) / (5 * len(want))
    assert set(got) == set(want) and found >= 0.9
    assert index.rows.count() == v.count()
    assert vi.compared_pairs(asked, index) < asked.count() * v.count()


def test_clustered_vectors_need_few_comparisons(spark, tmp_path, monkeypatch):
    """Chunks and tiles split large cells; the index that is read back answers alike."""
    monkeypatch.setattr(vi, "CHUNK", 50)
    monkeypatch.setattr(vi, "TILE", 7)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(20, 16))
    rows = [(f"n{i}", (centres[i % 20 if i % 3 else 0] + 0.2 * rng.normal(size=16)).tolist(), i) for i in range(1500)]
    v = spark.createDataFrame(rows, "id string, embedding array<float>, n int").repartition(4)
    index = vi.build_index(v, str(tmp_path))
    asked = v.where("n % 25 = 0")
    got, want = hits(vi.nearest_indexed(asked, index, k=5)), hits(ve.nearest(asked, v, k=5))
    assert sum(len(set(got[i]) & set(want[i])) for i in want) >= 0.95 * 5 * len(want)
    assert all(got[i][0] == i for i in got)
    assert hits(vi.nearest_indexed(asked, vi.read_index(spark, str(tmp_path)), k=5)) == got
    assert vi.compared_pairs(asked, index) < 0.4 * asked.count() * len(rows)
    assert max(index.chunks.values()) > 1


@pytest.mark.parametrize("exclude", [False, True])
def test_all_cells_give_the_exact_answer(spark, tmp_path, exclude):
    rng = np.random.default_rng(7)
    rows = [(f"n{i % 90}", rng.normal(size=5).tolist(), i) for i in range(100)] + [("none", None, 100), ("zero", [0.0] * 5, 101)]
    v = spark.createDataFrame(rows, "id string, embedding array<float>, n int")
    index = vi.build_index(v, str(tmp_path))
    asked = v.where("n < 20 OR n = 101").unionAll(v.where("n = 3")).withColumn("cells", F.lit("clash"))
    got = vi.nearest_indexed(asked, index, k=4, exclude_self=exclude, probes=1000)
    assert got.columns == [*asked.columns, "nearest"] and got.count() == 22
    want = {r.n: r.nearest for r in ve.nearest(asked, v, k=4, exclude_self=exclude).collect()}
    for r in got.where("n < 20").collect():
        assert [h.id for h in r.nearest] == [h.id for h in want[r.n]]
        assert [h.distance for h in r.nearest] == pytest.approx([h.distance for h in want[r.n]], abs=1e-6)
    assert vi.nearest_indexed(asked.where("false"), index).isEmpty()


def test_odd_tables(spark, tmp_path):
    none = spark.createDataFrame([("a", None)], "id string, embedding array<float>")
    with pytest.raises(ValueError):
        vi.build_index(none, str(tmp_path))
    same = spark.createDataFrame([(str(i), [1.0, 2.0]) for i in range(30)], "id string, embedding array<float>")
    found = vi.nearest_indexed(same.limit(1), vi.build_index(same, str(tmp_path / "same")), k=3).first()
    assert len(found.nearest) == 3 and all(abs(h.distance) < 1e-6 for h in found.nearest)
