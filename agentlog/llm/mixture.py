"""Mixing sources to target weights by blocks of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentlog.llm.common import WORD, fresh, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_USES = 2
CHUNKS = 4096  # of a source, which bounds every running sum over chunks
SPACES = r"[\x20\x09-\x0D]"
SLOTS_AT_ONCE = 10_000  # rows made from one array
ROUNDS = 16


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def shuffled_index(i: Column, n: Column, seed: str, inverse: bool = False) -> Column:
    """A pseudorandom permutation of 0..n-1 for any n: ROUNDS times, i and its mirror image about a random point are
    swapped or not, by a bit that both of the pair share. A round undoes itself, so the inverse runs them backwards."""

    def one(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(n, r, F.lit(seed)), n) - x, n)
        bit = F.xxhash64(F.greatest(x, other), r, F.lit(seed), n).bitwiseAND(F.lit(1))
        return F.when(bit == 1, other).otherwise(x)

    rounds = F.sequence(F.lit(ROUNDS), F.lit(1)) if inverse else F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(rounds, i.cast("bigint"), one)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """(source, source_size, docs) with ``target``, in words.

    Sources by code point, NULL last, weigh ``weights`` in turn and share ``share`` of all words. A target ends at
    MOST_USES times its source's words and the excess goes to the others by weight: with the sources in order of
    most / weight, the first ones are full and the rest get one rate per weight, the largest rate that any split gives.
    One row per source: windows here are over the list of sources.
    """
    ordered = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    at = F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights)))
    cap = F.lit(float(MOST_USES)) * F.col("source_size")
    by_rate = Window.orderBy("rate", "place")
    before = by_rate.rowsBetween(Window.unboundedPreceding, -1)
    after = by_rate.rowsBetween(0, Window.unboundedFollowing)
    full = Window.partitionBy()
    return (
        sizes.withColumn("place", F.row_number().over(ordered))
        .withColumn("weight", F.get(turn, at))
        .withColumn("cap", cap)
        .withColumn("rate", F.col("cap") / F.col("weight"))
        .withColumn("left", F.lit(share) * F.sum("source_size").over(full) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("level", F.max(F.col("left") / F.sum("weight").over(after)).over(full))
        .withColumn("target", F.least("cap", F.col("level") * F.col("weight")))
        .select("source", "source_size", "docs", "target", "place")
    )


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def plan_mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    block_words: int = 512,
    shard_slots: int = 4096,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    row_id: str | None = None,
) -> dict[str, DataFrame]:
    """The mix as three tables.

    ``sizes``: a row per document (row_id, doc_id, source, size, source_size, target, start), its words being words
    start.. of its source's stream. ``pieces``: where a document's words go: (row_id, doc_id, source, block, first_word,
    n_words, uses), words counted within the document. ``slots``: (source, shard, slot, block, n_words), the contents of
    the output's shards in order.

    A source's documents, in pseudorandom order, form one stream that is cut into blocks of ``block_words`` words. The
    source fills as many slots as its target has words; the last slot takes only the words still due. All slots of all
    sources are dealt to the output by one pseudorandom permutation, so that a shard's counts per source are a
    multinomial draw given the totals, and reruns agree. Slot j of a source holds block p(j mod blocks), p being its own
    permutation, so no block is used more than ceil(target / size) <= 2 times. Documents and slots meet by block index.

    Documents without words have size 0 and no piece. NULL texts are empty, NULL sources are one source, weighed last.
    Rows that repeat a doc_id are documents of their own; ``row_id``
    names a column that tells rows apart, by default they are numbered. Hot sources are split in chunks of at most 1/4096 of their
    rows, so no task holds a source.
    """
    size = word_count(F.col(text))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"),
        F.xxhash64(F.col(doc_id), F.col(source), F.lit("order")).alias("row_order"),
        (F.col(row_id) if row_id else F.monotonically_increasing_id()).alias("row_id"),
    )
    rows = written(rows, "mix-rows")
    chunk = F.shiftrightunsigned("row_order", 52)  # 12 bits: CHUNKS
    sums = rows.groupBy("source", chunk.alias("chunk")).agg(F.sum("size").alias("words"), F.count("*").alias("docs"))
    sums = written(sums, "mix-chunks")
    totals = sums.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("docs").alias("docs"))
    targets = written(source_targets(totals, weights, share), "mix-targets")
    by_source = targets.select(F.col("source").alias("t_source"), "source_size", "target")
    earlier = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = (
        sums.withColumn("chunk_start", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
        .join(by_source, _same("source", "t_source"))
        .select(F.col("t_source").alias("c_source"), F.col("chunk").alias("c_chunk"), "chunk_start", "source_size", "target")
    )
    within = Window.partitionBy("source", "chunk").orderBy("row_order", "doc_id", "row_id")
    within = within.rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        rows.withColumn("chunk", chunk)
        .withColumn("in_chunk", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(chunks, _same("source", "c_source") & (F.col("chunk") == F.col("c_chunk")))
        .withColumn("start", F.col("chunk_start") + F.col("in_chunk"))
        .select("row_id", "doc_id", "source", "size", "source_size", "target", "start")
    )
    slots = written(_slots(targets, block_words, shard_slots), "mix-slots")
    return {"sizes": sizes, "slots": slots, "pieces": _pieces(sizes, slots, block_words)}


def _slots(targets: DataFrame, block_words: int, shard_slots: int) -> DataFrame:
    """All slots, made from arrays of bounded length: whole rounds over a source's blocks, then as many blocks of its
    permutation as give the words still due, the last one in part."""
    b, n, last = F.lit(block_words), F.col("blocks"), F.col("last")
    sources = (
        targets.where("source_size > 0")
        .withColumn("blocks", F.ceil(F.col("source_size") / b).cast("bigint"))
        .withColumn("last", F.col("source_size") - (n - 1) * b)
        .withColumn("rounds", F.floor(F.round("target") / F.col("source_size")).cast("bigint"))
        .withColumn("due", F.round("target").cast("bigint") - F.col("rounds") * F.col("source_size"))
        # Where in a round the last, short block comes: from there on, a round is behind by what it lacks.
        .withColumn("short_at", shuffled_index(n - 1, n, "block", inverse=True))
    )
    short_at, due = F.col("short_at"), F.col("due")
    behind = F.greatest(short_at + 1, F.ceil((due + b - last) / b))
    extra = F.when(due <= short_at * b, F.ceil(due / b)).otherwise(behind).cast("bigint")
    sources = sources.withColumn("extra", extra).withColumn("slots", F.col("rounds") * n + F.col("extra"))
    earlier = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    sources = sources.withColumn("offset", F.coalesce(F.sum("slots").over(earlier), F.lit(0)))
    sources = sources.withColumn("all_slots", F.sum("slots").over(Window.partitionBy()))
    step = F.lit(SLOTS_AT_ONCE)
    # Two generators in a row, dealt out between them, so that no array and no task holds a source's slots.
    starts = sources.where("slots > 0").withColumn("from", F.explode(F.sequence(F.lit(0), F.col("slots") - 1, step)))
    partitions = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    starts = starts.repartition(partitions, "place", "from")
    j = starts.withColumn("j", F.explode(F.sequence("from", F.least(F.col("from") + step, F.col("slots")) - 1)))
    j = j.withColumn("block", shuffled_index(F.pmod("j", n), n, "block"))
    j = j.withColumn("place", shuffled_index(F.col("offset") + F.col("j"), F.col("all_slots"), "output"))
    final = (F.col("extra") > 0) & (F.col("j") == F.col("slots") - 1)
    given = (F.col("extra") - 1) * b - F.when(F.col("extra") - 1 > short_at, b - last).otherwise(0)
    words = F.when(final, due - given).when(F.col("block") == n - 1, last).otherwise(b)
    return j.select(
        "source",
        F.floor(F.col("place") / F.lit(shard_slots)).alias("shard"),
        F.pmod("place", F.lit(shard_slots)).alias("slot"),
        "block",
        words.cast("bigint").alias("n_words"),
    )


def _pieces(sizes: DataFrame, slots: DataFrame, block_words: int) -> DataFrame:
    """A row per document, block that it reaches into, and number of words taken from there: first_word within the
    document, n_words, uses. A block has as many slots as MOST_USES and one in part, at most."""
    b = F.lit(block_words)
    used = slots.groupBy("source", "block", "n_words").agg(F.count("*").alias("uses"))
    used = used.select(F.col("source").alias("u_source"), F.col("block").alias("u_block"), F.col("n_words").alias("take"), "uses")
    end = F.col("start") + F.col("size")
    blocks = F.sequence(F.floor(F.col("start") / b), F.floor((end - 1) / b))
    reached = sizes.where("size > 0").withColumn("block", F.explode(blocks))
    lo = F.greatest(F.col("start"), F.col("block") * b)
    hi = F.least(end, F.col("block") * b + F.col("take"))
    return (
        reached.join(used, _same("source", "u_source") & (F.col("block") == F.col("u_block")))
        .withColumn("first_word", lo - F.col("start"))
        .withColumn("n_words", hi - lo)
        .where("n_words > 0")
        .select("row_id", "doc_id", "source", "block", "first_word", "n_words", "uses")
    )


def taken_words(mix: dict[str, DataFrame]) -> DataFrame:
    """Every document with the words the mix takes of it, repeats counted: (doc_id, size, source_size, target, taken)."""
    words = mix["pieces"].groupBy("row_id").agg(F.sum(F.col("n_words") * F.col("uses")).alias("taken"))
    return mix["sizes"].join(words, "row_id", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken")
    )


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix as documents: a row per document that words are taken from, with those words as its text, and all other
    columns as they were.

    Its pieces come in order, a repeated one as often as it is taken, each on lines of its own; within a piece white
    space stays as it was. Documents without a taken word, and so all without words, are left out.
    """
    row, ranges, words = fresh(docs, "_row"), fresh(docs, "_ranges"), fresh(docs, "_words")
    tagged = written(docs.withColumn(row, F.monotonically_increasing_id()), "mix-documents")
    pieces = plan_mix(tagged, doc_id, text, source, row_id=row, **options)["pieces"]
    taken = pieces.groupBy(F.col("row_id").alias(row)).agg(
        F.sort_array(F.collect_list(F.struct("first_word", "n_words", "uses"))).alias(ranges)
    )

    def piece(r: Column) -> Column:
        part = F.slice(F.col(words), (r["first_word"] + 1).cast("int"), r["n_words"].cast("int"))
        return F.array_repeat(F.regexp_replace(F.array_join(part, ""), SPACES + "+$", ""), r["uses"].cast("int"))

    return (
        tagged.join(taken, row)
        .withColumn(words, F.regexp_extract_all(text, F.lit(f"({WORD}{SPACES}*)"), F.lit(1)))
        .withColumn(text, F.array_join(F.flatten(F.transform(ranges, piece)), "\n"))
        .select(*docs.columns)
    )
