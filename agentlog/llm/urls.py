"""URL filters: rules by host and path, and a list of canonical URLs behind a blocked Bloom filter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentlog.llm import bloom
from agentlog.llm.common import fresh, lower_ascii, written

# Query parameters that say where a visitor came from.
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*"


def url_host(url: Column) -> Column:
    """After the first :// up to the next slash, question mark, hash or end, A-Z in lower case; else empty."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """After the host up to a question mark, hash or end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """One form of a page's addresses: host without www., path without a slash at its end, the query without tracking
    parameters; no scheme or fragment. NULL where the URL is NULL or has no ://."""
    host = F.regexp_replace(url_host(url), r"^www\.", "")
    path = F.regexp_replace(url_path(url), "/$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, rf"(^|&){TRACKING}(?=&|$)", ""), "^&", "")
    whole = F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(F.instr(url, "://") > 0, whole)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits, NULL for none. ``rules``: (``host/path``, action), a list that is
    written by hand and short; it becomes one expression. A rule fits its host and all subdomains, where the path starts
    with its path."""

    def fits(rule: str) -> Column:
        at, _, rest = rule.partition("/")
        return ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)

    longest_first = sorted(rules, key=lambda r: (-len(r[0]), r[0]))
    name = reduce(lambda w, r: w.when(fits(r[0]), F.lit(r[0])), longest_first, F.when(F.lit(False), F.lit("")))
    action = reduce(lambda w, r: w.when(fits(r[0]), F.lit(r[1])), longest_first, F.when(F.lit(False), F.lit("")))
    return name, action


def repeated_urls(pages: DataFrame, url: str = "url") -> DataFrame:
    """(canonical) of every canonical URL that at least two pages have."""
    urls = pages.select(canonical_url(F.col(url)).alias("canonical")).where("canonical IS NOT NULL")
    return urls.groupBy("canonical").agg(F.count("*").alias("n")).where("n > 1").select("canonical")


def judge_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules: list[tuple[str, str]],
    url: str = "url",
    max_bits: int = bloom.MAX_BITS,
) -> DataFrame:
    """The pages with ``host``, ``path``, ``rule`` and ``verdict`` (allow or block), replacing columns of these names.

    The longest fitting rule decides. Elsewhere a page is blocked when its canonical URL is in ``listed`` (canonical):
    the list's Bloom filter, at most ``max_bits`` large and broadcast, lets possible hits through to an exact hash
    join, which removes false positives; all other pages pass without a shuffle. A hot URL among the hits is one row of
    the list, and Spark splits its side of the join.

    NULL URLs and URLs without :// have empty host and path, no canonical URL, and are allowed. The list may repeat or
    have NULLs, and may be empty. Very long URLs are read whole. Repeated rows are judged each, alike.
    """
    key, flag, canon = (fresh(pages, n) for n in ("_url_key", "_url_maybe", "_url_canonical"))
    listed = listed.select("canonical").where("canonical IS NOT NULL").distinct()
    listed = written(listed.withColumn("key", F.xxhash64("canonical")), "listed")
    bits = bloom.filter_bits(listed.count(), max_bits=max_bits)
    name, action = matching_rule(F.col("host"), F.col("path"), rules)
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    u = F.col(url)
    seen = pages.select(*kept, url_host(u).alias("host"), url_path(u).alias("path"), canonical_url(u).alias(canon))
    seen = seen.withColumn("rule", name).withColumn("verdict", action)
    seen = seen.withColumn(key, F.when(F.col("verdict").isNull(), F.xxhash64(canon)))
    seen = bloom.mark(seen, key, bloom.build(listed, "key", bits), bits, flag)
    hit = fresh(seen, "_listed_url")
    exact = seen.where(F.col(flag)).join(listed.select(F.col("canonical").alias(hit)), F.col(canon) == F.col(hit), "left")
    exact = exact.withColumn("verdict", F.when(F.col(hit).isNotNull(), "block").otherwise("allow"))
    rest = seen.where(~F.col(flag)).withColumn("verdict", F.coalesce("verdict", F.lit("allow")))
    columns = [*kept, "host", "path", "rule", "verdict"]
    return rest.select(*columns).unionByName(exact.select(*columns))
