"""A stream cut into files gives what the batch gives."""

import gzip
import os

from pyspark.sql import functions as F

from agentlog.operators import findings as fd
from agentlog.plans import fromtables as ft
from agentlog.plans.process import process_scored
from agentlog.sources import jsonl, store
from agentlog.streaming import ingest, sessions

SF = "/root/testdata/sf0.001"


def cut(spark, df, path, column, parts=3):
    """Write the rows as one file per stretch of arrival order and read them back as a stream."""
    top = df.agg(F.max(column)).first()[0] + 1
    for i in range(parts):
        part = df.where((F.col(column) >= i * top // parts) & (F.col(column) < (i + 1) * top // parts))
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(stream, path, checkpoint):
    query = (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def test_stream_findings_equal_batch(spark, tmp_path):
    logs = ft.agent_logs(ft.read(spark, SF, "events"))
    stream = cut(spark, logs, str(tmp_path / "in"), "arrival_seq")
    found, links = sessions.stream_findings(stream)
    drain(found, str(tmp_path / "out"), str(tmp_path / "c1"))
    drain(links, str(tmp_path / "links"), str(tmp_path / "c2"))
    batch = fd.judged_rows(logs)
    plain = fd.to_findings(batch.drop("back_links")).drop("ml_score", "ml_label")
    got = spark.read.parquet(str(tmp_path / "out")).drop("ml_score", "ml_label")
    key = lambda r: r.arrival_seq
    assert sorted(got.select(*plain.columns).collect(), key=key) == sorted(plain.collect(), key=key)
    pairs = batch.select(F.explode("back_links").alias("error_log_id"), F.col("log_id").alias("warning_log_id"))
    expected = {(r.warning_log_id, r.error_log_id) for r in pairs.collect()}
    rows = spark.read.parquet(str(tmp_path / "links")).collect()
    assert expected and {(r.warning_log_id, r.error_log_id) for r in rows} == expected


def test_stream_processing_equals_batch_through_the_sink(spark, tmp_path):
    logs = ft.agent_logs(ft.read(spark, SF, "events"), shuffled=True)
    scored = logs.withColumn("score", (F.col("arrival_seq") % 21) / 20.0)
    stream = cut(spark, scored, str(tmp_path / "in"), "arrival_seq")
    done = sessions.stream_processed(stream)
    sessions.upsert_stream(done, str(tmp_path / "table"), str(tmp_path / "c")).awaitTermination()
    got = store.current_rows(spark, str(tmp_path / "table"))
    cols = ["log_id", "is_anomaly", "classification.anomaly_type", "prev.log_id"]
    as_set = lambda df: {tuple(r) for r in df.select(*cols).collect()}
    batch = process_scored(scored)
    assert as_set(got) == as_set(batch) and got.count() == logs.count()


def raw_lines(spark):
    """Raw records of both protocols with damage, as text."""
    events = ft.read(spark, SF, "events")
    raw = ft.raw_records(events).select("arrival_seq", F.col("raw").alias("value"))
    broken = F.when(F.col("arrival_seq") % 13 == 0, F.expr("substring(value, 1, 40)")).when(F.col("arrival_seq") % 17 == 0, "  ")
    mcp = raw.select("arrival_seq", F.coalesce(broken, "value").alias("value"))
    a2a = ft.raw_messages(ft.read(spark, SF, "conversations")).select((F.col("arrival_seq") + 1_000_000).alias("arrival_seq"), F.col("raw").alias("value"))
    return mcp.unionByName(a2a)


def as_files(spark, lines, path, parts=3):
    """Numbered text files, in order."""
    rows = [r.value for r in lines.orderBy("arrival_seq").collect()]
    path.mkdir()
    for i in range(parts):
        part = rows[i * len(rows) // parts : (i + 1) * len(rows) // parts]
        file = path / f"part-{i:03d}.jsonl"
        file.write_text("\n".join(part) + "\n")
        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))  # a stream takes files in the order of their times


def known(df, columns):
    """Rows by arrival; ids that are made up for records without one differ from run to run."""
    return {r.arrival_seq: tuple(r)[1:] for r in df.select("arrival_seq", *columns).collect()}


def test_stream_from_raw_lines_equals_batch(spark, tmp_path):
    as_files(spark, raw_lines(spark), tmp_path / "in")
    stream = ingest.line_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
    found, _, bad = ingest.line_findings(stream)
    drain(found, str(tmp_path / "found"), str(tmp_path / "c1"))
    drain(bad, str(tmp_path / "bad"), str(tmp_path / "c2"))
    batch = jsonl.read_lines(spark, str(tmp_path / "in"))
    logs, quarantine = ingest.split_lines(batch)
    assert batch.select("arrival_seq").distinct().count() == batch.count()
    columns = ["session_id", "subtype", "confidence", "tool", "event", "context_rule_ids"]
    got, want = spark.read.parquet(str(tmp_path / "found")), fd.analyze(logs)
    assert known(got, columns) == known(want, columns) and want.count() > 50
    got = {(r.arrival_seq, r.raw, tuple(r.errors)) for r in spark.read.parquet(str(tmp_path / "bad")).collect()}
    assert got == {(r.arrival_seq, r.raw, tuple(r.errors)) for r in quarantine.collect()} and len(got) > 50


def test_line_numbers_follow_files_and_lines(spark, tmp_path):
    folder = tmp_path / "a b%"
    folder.mkdir()
    for i in range(4):
        (folder / f"f{i}.txt").write_text("".join(f"{i}-{j:05d}\n" for j in range(3000)))
    conf = {"spark.sql.files.maxPartitionBytes": "9000", "spark.sql.files.openCostInBytes": "100", "spark.sql.files.minPartitionNum": "1"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        for packed in (False, True):
            if packed:
                (folder / "f9.txt.gz").write_bytes(gzip.compress(b"9-00000\n" * 50_000))
            rows = jsonl.read_lines(spark, str(folder)).orderBy("arrival_seq").collect()
            assert [r.value for r in rows] == sorted(r.value for r in rows) and len(rows) == 12_000 + 50_000 * packed
            assert len({r.arrival_seq for r in rows}) == len(rows)
    finally:
        for k in conf:
            spark.conf.unset(k)
