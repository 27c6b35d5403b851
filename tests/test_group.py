"""Group analysis from raw records, and the failing rows of one scan."""

from pyspark.sql import functions as F

from agentlog.operators import normalize as nz
from agentlog.operators import vectors as ve
from agentlog.plans import fromtables as ft
from agentlog.plans import process as pr

SF = "/root/testdata/sf0.001"


def raw(spark):
    mcp = ft.raw_records(ft.read(spark, SF, "events")).select("arrival_seq", "raw")
    a2a = ft.raw_messages(ft.read(spark, SF, "conversations")).select((F.col("arrival_seq") + 1_000_000).alias("arrival_seq"), "raw")
    return mcp, a2a


def baseline(spark, logs):
    rows = ve.vectorize(logs).select(F.col("arrival_seq").cast("string").alias("id"), "embedding")
    return rows.where("id % 2 = 0").cache()


def test_a_mixed_group_keeps_its_failures(spark):
    mcp, a2a = raw(spark)
    every = mcp.unionByName(a2a)
    logs, rejected = nz.normalize(every)
    rows, failures, summary = pr.analyze_raw_group(every, baseline(spark, logs))
    rows, failures = rows.collect(), failures.collect()
    assert {r.arrival_seq for r in failures} == {r.arrival_seq for r in rejected.collect()} and len(failures) > 50
    assert len(rows) + len(failures) == every.count()
    one = summary.collect()
    assert len(one) == 1
    found = [r for r in rows if r.is_anomaly]
    assert (one[0].logs, one[0].failures, one[0].anomalies) == (len(rows), len(failures), len(found))
    assert sum(one[0].by_type.values()) == len(found) > 0
    assert one[0].anomaly_density_pct == round(100 * len(found) / len(rows), 2)


def test_a_group_of_one_protocol_is_analysed_by_session(spark):
    mcp, _ = raw(spark)
    logs, _ = nz.normalize(mcp)
    rows, failures, summary = pr.analyze_raw_group(mcp, baseline(spark, logs))
    assert {"reason", "root_cause_log_id"} <= set(rows.columns) and not failures.isEmpty()
    assert summary.first().anomalies == rows.where("is_anomaly").count() > 0


def test_records_are_read_once_for_failures_and_counts(spark):
    mcp, a2a = raw(spark)
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        reads.add(1)
        return text

    every = mcp.unionByName(a2a)
    none = spark.createDataFrame([], "id string, embedding array<float>")
    _, failures, _ = pr.analyze_raw_group(every.withColumn("raw", counted("raw")), none)
    assert failures.count() > 50 and reads.value == every.count()


def test_checks_alone_equal_those_of_the_whole(spark):
    mcp, a2a = raw(spark)
    odd = spark.createDataFrame([(-1, None), (-2, "7"), (-3, "{"), (-4, '{"protocol":"mcp"}'), (-5, '{"protocol":null}')], "arrival_seq long, raw string")
    every = mcp.unionByName(a2a).unionByName(odd)
    for strict in (False, True):
        one, other = nz.check_all(every, strict), nz.normalize_all(every, strict).select("arrival_seq", "raw", "protocol", "errors")
        assert one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty()


def test_an_empty_group(spark):
    mcp, _ = raw(spark)
    none = spark.createDataFrame([], "id string, embedding array<float>")
    _, failures, summary = pr.analyze_raw_group(mcp.where("false"), none)
    assert failures.isEmpty() and summary.first()[:3] == (0, 0, 0)


def test_failing_rows_and_totals_come_from_one_scan(spark, tmp_path):
    mcp, a2a = raw(spark)
    rows = mcp.unionByName(a2a).withColumn("source", F.lit("f"))
    bad, counts = nz.failing_rows(rows, str(tmp_path / "bad"))
    assert counts == {"total": rows.count(), "failures": bad.count()}
    assert bad.where("size(errors) = 0 OR raw IS NULL").isEmpty() and counts["failures"] > 0
    _, counts = nz.failing_rows(rows.where("false"), str(tmp_path / "none"))
    assert counts == {"total": 0, "failures": 0}
