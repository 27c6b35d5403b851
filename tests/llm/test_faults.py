"""Cases that once went wrong, and plain versions of what SQL can't check."""

import hashlib
import os
import subprocess
import sys
import textwrap
from collections import Counter

from pyspark.sql import functions as F

from agentlog.llm import bloom, exact, langid, linewindows, minhash, pii, urls
from tests.llm.cases import documents, prose

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_columns_are_found_whatever_their_case(spark):
    df = spark.createDataFrame([(1, "mail bob@example.com"), (2, "a\nb\nc"), (3, "a\nb\nc\nd")], "doc_id long, Text string")
    new = {r.doc_id: r.Text for r in pii.pseudonymise(df, "k").collect()}
    assert new[1] != "mail bob@example.com" and new[1].endswith("@example.com")
    out = linewindows.drop_repeated_lines(df)
    assert out.columns == ["doc_id", "Text", "removed_lines"]
    assert {r.doc_id: (r.Text, r.removed_lines) for r in out.collect()}[3] == ("d", 3)


def test_repeated_lines_of_rows_without_an_id(spark):
    rows = [(None, "p\nq\nr\none"), (None, "two\np\nq\nr"), (5, "p\nq\nr"), (None, "x\ny\nz\n1"), (None, "x\ny\nz\n2"), (None, "s\nt\nu")]
    rows += [rows[-1], (7, "v\nw\nx"), (7, "0\nv\nw\nx")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = linewindows.drop_repeated_lines(df).collect()
    assert [r.text for r in out if r.doc_id == 5] == ["p\nq\nr"]
    texts = Counter(r.text for r in out if r.doc_id is None)
    assert texts["one"] == texts["two"] == 1 and texts["s\nt\nu"] == 2  # equal rows are one document
    assert len({"1", "2"} & set(texts)) == 1 and len({"x\ny\nz\n1", "x\ny\nz\n2"} & set(texts)) == 1
    assert sum(r.removed_lines for r in out if r.doc_id == 7) == 3


def test_clashing_names_are_kept(spark):
    docs = documents(spark)
    for out in (exact.drop_duplicates(docs), minhash.drop_near_duplicates(docs), linewindows.drop_repeated_lines(docs)):
        assert {"_bloom_block", "_bloom_bits"} <= set(out.columns)
        assert {r._bloom_bits for r in out.collect()} == {"x"}
    pages = docs.withColumn("url", F.concat(F.lit("http://a.org/"), "doc_id"))
    listed = spark.createDataFrame([("a.org/7",)], "canonical string")
    out = urls.judge_urls(pages, listed, []).collect()
    assert {r._listed_url for r in out} == {"x"} and [r.doc_id for r in out if r.verdict == "block"] == [7]
    odd = bloom.mark(docs.withColumn("k", F.xxhash64("doc_id")), "k", bloom.build(docs.select(F.xxhash64("doc_id").alias("k")), "k", 32768), 32768, "f")
    assert odd.where("NOT f").isEmpty()


def test_urls_repeat_and_are_long(spark):
    long = "http://a.org/" + "x" * 100_000
    pages = spark.createDataFrame([(1, long), (2, long), (3, long[:-1]), (3, long[:-1])], "page_id long, url string")
    listed = urls.repeated_urls(pages.where("page_id < 3"))
    assert sorted((r.page_id, r.verdict) for r in urls.judge_urls(pages, listed, []).collect()) == [(1, "block"), (2, "block"), (3, "allow"), (3, "allow")]


def plain_feistel(values, sizes, key, kind):
    now, half = list(values), len(values) // 2
    for turn in range(8):
        first = turn % 2 == 0
        other = now[half:] if first else now[:half]
        for i in range(len(now)):
            if (i < half) == first:
                seen = "|".join([key, kind, str(turn), str(i), ",".join(map(str, other))])
                now[i] = (now[i] + int(hashlib.sha256(seen.encode()).hexdigest()[:12], 16)) % sizes[i]
    return now


def test_pseudonyms_equal_a_plain_feistel_network(spark):
    rows = ["4111111111111111", "+16265555759", "10.2.30.255", "123-45-6789", "900-45-6789", "626-555-5759", "4012888888881881"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id int, text string")
    got = [r.text for r in pii.pseudonymise(df, "key").orderBy("doc_id").collect()]

    def card(t):
        d = [int(c) for c in t]
        body = [d[0], *plain_feistel(d[1:-1], [10] * (len(d) - 2), "key", "card")]
        total = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate([0, *body[::-1]]))
        return "".join(map(str, [*body, -total % 10]))

    def digits(t, skip):
        d = [int(c) for c in t if c.isdigit()]
        new = iter([*d[:skip], *plain_feistel(d[skip:], [10] * (len(d) - skip), "key", "phone")])
        return "".join(str(next(new)) if c.isdigit() else c for c in t)

    ip = ".".join(map(str, plain_feistel([10, 2, 30, 255], [256] * 4, "key", "ipv4")))
    a, g, s = plain_feistel([123 - 1, 45 - 1, 6789 - 1], [898, 99, 9999], "key", "ssn")
    ssn = f"{a + (2 if a >= 665 else 1):03d}-{g + 1:02d}-{s + 1:04d}"
    assert got == [card(rows[0]), digits(rows[1], 1), ip, ssn, rows[4], digits(rows[5], 0), card(rows[6])]


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held", langid.is_held_out(F.col("doc_id")))
    out = langid.predict(docs, langid.fit(docs.where("NOT held"))).where("held AND lang IS NOT NULL AND lang_pred <> 'und'")
    right = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("r"), F.count("*").alias("n")).first()
    assert right.n > 100 and right.r >= 0.98


def test_missing_languages_are_filled(spark):
    df = spark.createDataFrame([(i, f"{w} {prose(i, 3)}", lang) for i, (w, lang) in enumerate([("der und nicht schön", "de"), ("the thing with that", "en")] * 80)], "doc_id long, text string, Lang string")
    model = langid.fit(df, lang="Lang")
    out = langid.with_known_language(df.withColumn("Lang", F.when(F.col("doc_id") < 100, F.col("Lang"))), model, lang="lang")
    assert out.columns == df.columns and {r.Lang for r in out.where("doc_id % 2 = 0").collect()} == {"de"}


def test_executors_need_no_copy_of_the_package(tmp_path):
    """The driver alone can import the package; tasks carry their code along."""
    code = f"""
    import sys
    sys.path.insert(0, {REPO!r})
    from pyspark.sql import SparkSession, functions as F
    spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
    from agentlog.llm import langid, ngramjoin, resampling, whitening
    rows = [(i, w + " " + str(i), l) for i, (w, l) in enumerate([("der und nicht", "de"), ("the thing with", "en")] * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.predict(df, langid.fit(df)).where("lang = lang_pred").count() == 60
    assert ngramjoin.ngram_components(df).count() == resampling.resample(df, df, least_words=1).count() == 60
    v = spark.createDataFrame([(i, [float(i), float(i % 3)]) for i in range(9)], "vec_id long, embedding array<float>")
    assert whitening.whiten(v).count() == 18
    print("all right")
    """
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "all right" in done.stdout, done.stderr[-3000:]


def test_entry_without_the_extra(tmp_path):
    code = f"""
    import sys
    sys.path.insert(0, {REPO!r})
    sys.modules["xxhash"] = None
    import __spark_entry__ as e
    assert len(e.queries()) > 100 and not any(k.startswith("op") and k[2].isdigit() for k in e.queries())
    """
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", textwrap.dedent(code)], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
