"""Evaluation of scored vectors beside the queries' statements, on rows of its own."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from tests.compare import rows_of


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Ids divisible by 100 are asked; some rows repeat, one id has two labels, a label is missing."""
    rng = np.random.default_rng(11)
    rows = [(i, rng.normal(size=24).tolist(), i // 100 % 9) for i in range(0, 4000, 25)]
    rows += [(i, (np.array(rows[i // 25][1]) + rng.normal(size=24) * 0.2).tolist(), 7) for i in range(1, 1000, 50)]  # near the row before
    rows += rows[:12] + [(300, rows[12][1], 8), (4100, rng.normal(size=24).tolist(), None)]
    path = str(tmp_path_factory.mktemp("labelled"))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df.write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.mark.parametrize("name", ["threshold_sweep", "threshold_sweep_by_protocol", "binary_metrics"])
def test_evaluation_of_asked_vectors(spark, table, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{table}/embeddings.parquet/*.parquet')")
    wanted = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, table)
    left, right = rows_of(got.columns, [tuple(r) for r in got.collect()]), rows_of(wanted.columns, wanted.fetchall())
    assert left == right and right[1]
