"""The operators over the given tables, with production parameters, and the statements that check them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agentlog.llm import (
    exact, fingerprint, langid, linewindows, minhash, mixture, ngramjoin, pieces, pii, resampling, sharding, urls, whitening,
)
from agentlog.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return register


@query(
    f"""WITH h AS (SELECT doc_id, sha256({LOWER_SQL}) AS text_sha256 FROM documents),
       g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM h GROUP BY 1)
       SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM h JOIN g USING (text_sha256)"""
)
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicate_groups(table(spark, sf_dir, "documents"))


@query()
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select("doc_id", *pieces.digests(encoded))


@query()
def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.taken_words(mixture.plan_mix(table(spark, sf_dir, "documents")))


@query()
def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


@query()
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.is_held_out(F.col("doc_id")))
    model = langid.fit(docs.where("NOT held_out"))
    return langid.predict(docs, model).select("doc_id", "held_out", "lang_pred", "score")


RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]
_RULE_ROWS = ", ".join(f"('{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{r}', '{a}')" for r, a in RULES)


@query(
    f"""WITH u AS (SELECT page_id, coalesce(lower(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
         regexp_extract(url, '(?s)^.*?://[^?#]*\\?([^#]*)', 1) AS q, url LIKE '%://%' AS has FROM pages),
       k AS (SELECT page_id, host, path, CASE WHEN has THEN regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/$', '')
         || coalesce('?' || nullif(list_aggregate(list_filter(string_split(q, '&'), lambda x: NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)=')), 'string_agg', '&'), ''), '') END AS canonical FROM u),
       l AS (SELECT canonical FROM k WHERE canonical IS NOT NULL GROUP BY 1 HAVING count(*) > 1),
       r(rh, rp, rule, action) AS (VALUES {_RULE_ROWS}),
       m AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action
         FROM k JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY 1)
       SELECT page_id, host, path, rule, coalesce(action, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
       FROM k LEFT JOIN m USING (page_id) LEFT JOIN l ON k.canonical = l.canonical"""
)
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed are the addresses that more than one page has."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge_urls(pages, urls.repeated_urls(pages), RULES).drop("url")


@query()
def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_alike(fingerprint.fingerprints(table(spark, sf_dir, "documents")))


SHARD_BYTES = 1 << 20


@query(
    f"""WITH h AS (SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '/' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h FROM documents),
       n AS (SELECT depth, h >> (60 - depth) AS prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs,
         sum(n_bytes) <= {SHARD_BYTES} OR min(h) = max(h) AS fits FROM h CROSS JOIN (SELECT unnest(range(0, 61)) AS depth) GROUP BY 1, 2),
       l AS (SELECT n.* FROM n LEFT JOIN n AS a ON a.depth = n.depth - 1 AND a.prefix = n.prefix >> 1 WHERE n.fits AND NOT coalesce(a.fits, false))
       SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth::INTEGER, '0') END AS shard, shard_bytes, shard_docs
       FROM h JOIN l ON h >> (60 - depth) = prefix"""
)
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shards(docs, SHARD_BYTES).select("doc_id", "n_bytes", "shard", "shard_bytes", "shard_docs")


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
       w AS (SELECT doc_id, i, line || chr(10) || lead(line, 1) OVER d || chr(10) || lead(line, 2) OVER d AS w FROM l WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
       later AS (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS place FROM w WHERE w IS NOT NULL AND regexp_matches(w, '[^ \\t-\\r]')),
       gone AS (SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS i FROM later WHERE place > 1),
       kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM l ANTI JOIN gone USING (doc_id, i) GROUP BY 1),
       n AS (SELECT doc_id, count(*)::INTEGER AS removed_lines FROM gone GROUP BY 1)
       SELECT d.doc_id, coalesce(n.removed_lines, 0) AS removed_lines, sha256(coalesce(kept.text, '')) AS text_sha256
       FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)"""
)
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linewindows.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query()
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, key="a key of the data's owner")


_RUNS_SQL = """string_split_regex(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), ' ')"""


@query(
    f"""WITH dw AS (SELECT doc_id, list_filter({_RUNS_SQL}, lambda x: x <> '') AS w FROM documents),
       bw AS (SELECT list_filter({_RUNS_SQL}, lambda x: x <> '') AS w FROM benchmark),
       df AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM dw),
       bf AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM bw),
       dn AS (SELECT doc_id, f, count(*) AS n FROM df GROUP BY 1, 2), tn AS (SELECT f, count(*) AS n FROM bf GROUP BY 1),
       hx AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM dn UNION SELECT f FROM tn)),
       bits AS (SELECT f, list_transform(range(0, len(x) * 4), lambda i:
         (instr('0123456789ABCDEF', x[(i // 8) * 2 + CASE WHEN i % 8 < 4 THEN 2 ELSE 1 END]) - 1 >> (i % 4)) & 1) AS b FROM hx),
       crc AS (SELECT f, xor(list_reduce(list_concat([4294967295::BIGINT], b::BIGINT[]), lambda c, y:
         xor(c >> 1, CASE WHEN xor(c & 1, y) = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)), 4294967295::BIGINT) % 10000 AS bucket FROM bits),
       s AS (SELECT bucket, sum(n) AS s FROM dn JOIN crc USING (f) GROUP BY 1), t AS (SELECT bucket, sum(n) AS t FROM tn JOIN crc USING (f) GROUP BY 1),
       whole AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE + 10000 AS ss, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE + 10000 AS tt),
       g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * ss / ((coalesce(s, 0)::DOUBLE + 1) * tt)))::BIGINT AS gain
         FROM s FULL JOIN t USING (bucket), whole),
       m AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS total FROM dn JOIN crc USING (f) JOIN g USING (bucket) GROUP BY 1),
       v AS (SELECT dw.doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features,
         CASE WHEN n_features > 0 THEN (total - ((total % n_features) + n_features) % n_features) // n_features ELSE 0 END::BIGINT AS weight,
         ('0x' || substr(sha256('7:' || dw.doc_id), 1, 8))::BIGINT AS h FROM dw LEFT JOIN m USING (doc_id)),
       z AS (SELECT doc_id, n_words, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM v),
       r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM z WHERE n_words >= 20)
       SELECT z.doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank FROM z LEFT JOIN r USING (doc_id)"""
)
def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query()
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"), components=8)
    return rows.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


@query()
def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.ngram_components(table(spark, sf_dir, "documents"), words=5, percent=80)
