"""Small document tables with the awkward rows every operator has to take."""

from __future__ import annotations

import random

WORDS = "the of and thing stone river light quick brown fox jumps over lazy dog house garden".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(n))


def documents(spark):
    """NULL in every column, empty and white texts, copies, a repeated row, a near copy, a very long text, columns whose
    names operators use inside."""
    long = prose(1, 30_000)
    base = prose(2, 60).split(" ")
    near = " ".join([*base[:-2], "changed", base[-1]])
    rows = [
        (1, "Same Text here", "en", "a"), (2, "same text here", "en", "a"), (3, None, "en", "b"), (4, "", None, None),
        (5, " \n\t ", "en", "a"), (6, " ".join(base), "en", "a"), (7, near, "en", "c"), (8, long, "en", "a"),
        (9, long, None, "b"), (10, "one", "en", None), (10, "one", "en", None), (None, "one", None, "a"),
        (11, "Ünïcode 日本 😀 \u2581x", "de", "a"), (12, "l1 x\nl2 y\nl3 z\nl4", "en", "a"),
        (13, "other\nl1 x\nl2 y\nl3 z\nlast", "en", "a"),
    ]
    schema = "doc_id bigint, text string, lang string, source string"
    df = spark.createDataFrame(rows, schema)
    clash = "key hashes row bucket label places found shard score host _key _maybe _row size n _bloom_block _bloom_bits _listed_url _judged".split()
    clash += "_piece_pair _text_key _text_order _of _places _out _lang".split()
    return df.selectExpr("*", *[f"'x' AS `{c}`" for c in clash])


def empty(spark):
    return documents(spark).where("false")
