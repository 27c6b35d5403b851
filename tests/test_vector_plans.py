"""What is computed once, and what isn't sent around, when logs are judged by vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from agentlog.config import Settings
from agentlog.operators import vectors as ve
from agentlog.plans import registry


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = np.random.default_rng(6)
    path = str(tmp_path_factory.mktemp("judged"))
    vectors = [(i, rng.normal(size=8).tolist(), i % 3) for i in range(250)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    at = "TIMESTAMP_NTZ'2024-01-01 00:00:00'"
    kinds = "element_at(array('click', 'view', 'error', 'purchase', 'signup'), cast(id % 5 + 1 AS int))"
    spark.range(60).selectExpr(
        "id AS event_id", f"{at} + make_dt_interval(0, 0, cast(id AS int)) AS ts", "id % 4 AS user_id", f"{kinds} AS event_type",
        "cast(id AS double) AS value", "concat('{\"k\": ', id % 80, '}') AS props",
    ).write.parquet(f"{path}/events.parquet")
    return path


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_scores_of_logs_are_computed_once(spark, tables):
    scored = registry._scored_logs(spark, tables)
    assert "ArrowEvalPython" not in plan(scored) and scored.where("score > 0").count() == 60


def test_vectors_of_logs_are_computed_once(spark, tables):
    logs = spark.range(500).select(F.col("id").alias("arrival_seq"))
    out = registry._with_vectors(spark, tables, logs)
    assert "zip_with" not in plan(out) and out.where("size(embedding) = 8").count() == 500


def test_the_length_of_a_vector_is_computed_once(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([],), (None,)], "v array<double>")
    out = rows.select(ve.unit(F.col("v")).alias("u"))
    assert [r.u for r in out.collect()] == [[0.6, 0.8], [0.0, 0.0], [], None]
    assert "transform(array(greatest(sqrt(" in plan(out).lower()


def test_a_baseline_of_floats_is_sent_around_up_to_its_own_size(spark):
    rng = np.random.default_rng(1)
    rows = [(str(i), rng.normal(size=8).tolist()) for i in range(100)]
    floats = spark.createDataFrame(rows, "id string, embedding array<float>")
    cfg = Settings(baseline_broadcast_bytes=100 * 8 * 4)
    found = ve.anomaly_score(floats, floats, cfg, exclude_self=True)
    assert "CoGroup" not in plan(found)
    tiles = ve.anomaly_score(floats, floats, Settings(baseline_broadcast_bytes=0), exclude_self=True)
    assert "CoGroup" in plan(tiles)
    key = lambda df: sorted((r.id, round(r.score, 12)) for r in df.collect())
    assert key(found) == key(tiles)
