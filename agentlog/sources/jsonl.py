"""Text sources of raw records: JSON lines, JSON arrays, session batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agentlog.functions import jsontext as js
from agentlog.functions.lookups import stripped
from agentlog.functions.plan import broadcast_up_to, computed_once
from agentlog.operators.normalize import normalize_all

LOGS_ONLY_MCP = "Only MCP logs are supported by this endpoint"


def parse_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad) of ``value STRING, arrival_seq BIGINT``; blank lines are dropped, a bad line does not stop the rest."""
    text = lines.where(stripped("value") != "").select("arrival_seq", F.col("value").alias("raw"))
    ok = F.try_parse_json("raw").isNotNull()
    return text.where(ok), text.where(~ok)


POSITION_BITS = 42  # a file's place among all is above them: files up to 4 TB, 2 million of them
COMPRESSED = (".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate", ".xz")


def line_position() -> Column:
    """A number that grows with the lines of a file read as plain text.

    It is the first byte of the line's block plus the number of lines that the task has read before. A task reads no more
    bytes than a block may have, and a line has one at least, so the sum stays below the next block's first byte.
    """
    return F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of text files with ``source`` and an ``arrival_seq`` that follows file and line order.

    One scan: a line's number is the rank of its file by name, from the listing that Spark makes anyway, and its position.
    The listing is joined by broadcast while it is small enough. Compressed files can have more lines than bytes;
    their lines are numbered by block, which takes a scan for the list of blocks.

    Where the records carry their own sequence (an offset, an event id), use that instead.
    """
    text = spark.read.text(path)
    files = sorted(text.inputFiles())
    if any(f.endswith(COMPRESSED) for f in files):
        return _ranked_by_block(text)
    rows = text.select("value", F.input_file_name().alias("source"), line_position().alias("_at"))
    ranks = spark.createDataFrame(list(enumerate(files)) or [(0, "")], "_file bigint, source string")
    listed = broadcast_up_to(ranks, len(files), row_bytes=max(map(len, files), default=0) + 16)
    seq = F.shiftleft("_file", POSITION_BITS) + F.col("_at")
    return rows.join(listed, "source").select("value", "source", seq.alias("arrival_seq"))


def _ranked_by_block(text: DataFrame) -> DataFrame:
    rows = text.select(
        "value",
        F.input_file_name().alias("source"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )
    # Rank of the file block among all blocks: one row per block, not per line.
    blocks = rows.select("source", "_block").distinct()
    order = Window.orderBy("source", "_block")
    numbered = blocks.select("source", "_block", (F.row_number().over(order) - 1).alias("_b"))
    # Within a block, the scan numbers rows in ascending order.
    return (
        rows.join(numbered, ["source", "_block"])
        .withColumn("arrival_seq", F.shiftleft(F.col("_b").cast("bigint"), 33) + F.col("_row").bitwiseAND((1 << 33) - 1))
        .select("value", "source", "arrival_seq")
    )


def read_jsonl(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    return parse_lines(read_lines(spark, path))


def ingest_counts(lines: DataFrame) -> DataFrame:
    """``inserted``, ``errors`` and ``total`` of ingesting the lines: bad JSON and rejected records are errors."""
    text = lines.where(stripped("value") != "").select("arrival_seq", F.col("value").alias("raw"))
    bad = F.size("errors") > 0
    return normalize_all(text).agg(
        F.count_if(~bad).alias("inserted"), F.count_if(bad).alias("errors"), F.count(F.lit(1)).alias("total")
    )


def explode_documents(documents: DataFrame) -> DataFrame:
    """Records of whole-text documents (``value``, ``source``): a JSON array, or JSON lines.

    Elements of an array that are not objects are dropped and do not count as rows. A broken array and a bad line in
    JSON lines fail the load. ``row`` counts from 1 within the document.
    """
    text = documents.select("source", stripped("value").alias("value")).where(F.col("value") != "")
    is_array = F.col("value").startswith("[")
    # Elements keep their own text, so that key order and number forms survive. A broken array has none.
    kinds = F.when(F.try_parse_json("value").isNotNull(), F.from_json("value", "array<variant>"))
    failed = F.raise_error(F.concat(F.lit("bad JSON array in "), "source")).cast("array<string>")
    texts = F.zip_with(F.from_json("value", "array<string>"), kinds, lambda s, v: F.when(js.is_object(v), s))
    objects = F.array_compact(F.coalesce(texts, failed))
    records = F.when(is_array, objects).otherwise(F.filter(F.split("value", "\r?\n"), lambda s: stripped(s) != ""))
    rows = text.select("source", is_array.alias("_a"), F.posexplode(records).alias("_i", "raw"))
    broken = ~F.col("_a") & F.try_parse_json("raw").isNull()
    checked = F.when(broken, F.raise_error(F.concat(F.lit("bad JSON line in "), "source"))).otherwise(F.col("raw"))
    return rows.select("source", (F.col("_i") + 1).alias("row"), checked.cast("string").alias("raw"))


def read_logs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Files that hold either a JSON array or JSON lines; meant for uploads, each file being one value."""
    return explode_documents(spark.read.text(path, wholetext=True).withColumn("source", F.input_file_name()))


def explode_batch(batches: DataFrame) -> DataFrame:
    """Elements of session batches (``batch_id``, ``raw``): a list, or an object with ``logs``; ``index`` from 1.

    A surrounding session is not copied to the elements.
    """
    v = F.try_parse_json("raw")
    listed = F.when(js.is_array(v), F.col("raw")).when(
        js.is_array(js.variant_at(v, "$.logs")), js.json_at(F.col("raw"), "$.logs")
    )
    # Elements keep their own text, so that key order survives; the list is parsed once.
    elements = computed_once(
        batches.select("batch_id", listed.alias("_list"))
        .where(F.col("_list").isNotNull())
        .select("batch_id", F.posexplode(F.from_json("_list", "array<string>")).alias("_i", "raw"))
    )
    return elements.select("batch_id", (F.col("_i") + 1).alias("index"), "raw")


def batch_rows(elements: DataFrame) -> DataFrame:
    """Exploded batch elements as normalized logs with ``batch_id`` and ``error``, NULL for usable MCP logs."""
    rows = normalize_all(elements.withColumn("arrival_seq", F.col("index").cast("bigint")), carry=["batch_id"])
    failed = F.when(F.size("errors") > 0, F.substring(F.array_join("errors", "; "), 1, 280))
    other = F.when(F.col("protocol") != "MCP", LOGS_ONLY_MCP)
    return rows.withColumn("error", F.coalesce(failed, other)).drop("raw", "protocol_in", "errors")


def batch_logs(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(normalized MCP logs with ``batch_id``, errors ``batch_id, index, error``) of exploded batches."""
    rows = batch_rows(elements)
    errors = rows.where(F.col("error").isNotNull()).select("batch_id", F.col("arrival_seq").alias("index"), "error")
    return rows.where(F.col("error").isNull()).drop("error"), errors
