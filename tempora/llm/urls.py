"""URL verdicts: host and path rules first, then a list of canonical URLs behind a blocked Bloom filter.

The filter is a table with one row per 512-bit block (eight 64-bit words, one
bit set in each per URL), built with bit_or, probed by a join on the block
number. It is broadcast only while its size, known from the number of listed
URLs, is below `BROADCAST_BYTES`; beyond that the join shuffles. What passes
goes to an exact join with the list, which removes the filter's false hits.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

#: (verdict, rule); a rule is a host and the beginning of a path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
BITS_PER_URL = 16
BROADCAST_BYTES = 32 << 20
WORDS = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, A-Z lowered; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without leading www. and default port, path without closing slashes, query without tracking parameters; no scheme, no fragment. Null without ://."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), "^www\\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    query = F.regexp_replace(F.regexp_extract(url, "://[^?#]*\\?([^#]*)", 1), "(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*", "")
    query = F.regexp_replace(query, "^&", "")
    return F.when(url.contains("://"), F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def apply_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds host, path, rule, rule_verdict; the longest rule that fits wins, null without one."""
    df = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))

    def fits(rule: str) -> Column:
        host, slash, path = rule.partition("/")
        return ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)

    ordered = sorted(rules, key=lambda r: -len(r[1]))
    pick = lambda i: reduce(lambda c, r: c.when(fits(r[1]), r[i]), ordered, F.when(F.lit(False), F.lit(None).cast("string")))
    return df.select("*", pick(1).alias("rule"), pick(0).alias("rule_verdict"))


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def _bit(url: Column, word: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(word // 8), url), 6 * (word % 8)).bitwiseAND(F.lit(63)).cast("int")


def bloom_table(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 … w7) over the `url` column of `listed`."""
    ones = [F.bit_or(F.expr(f"shiftleft(1L, b{i})")).alias(f"w{i}") for i in range(WORDS)]
    return listed.select(_block(F.col("url"), blocks).alias("block"), *[_bit(F.col("url"), i).alias(f"b{i}") for i in range(WORDS)]).groupBy("block").agg(*ones)


def in_list(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """`pages` with `listed` (boolean): whether `canonical_url` equals an entry of `listed.url`.

    Null URLs are never listed, null and repeated entries count once, and an
    empty list lists nothing.
    """
    entries = staged(listed.select("url").where("url is not null").distinct(), "listed")
    n = entries.count()
    blocks = max(1, math.ceil(n * BITS_PER_URL / (64 * WORDS)))
    bloom = bloom_table(entries, blocks)
    if blocks * 8 * (WORDS + 1) <= BROADCAST_BYTES:
        bloom = F.broadcast(bloom)
    bits = {f"_b{i}": _bit(F.col("canonical_url"), i) for i in range(WORDS)}
    spread = F.coalesce("canonical_url", F.monotonically_increasing_id().cast("string"))  # rows without a URL share no block
    probed = pages.withColumns({"_block": _block(spread, blocks)} | bits).join(bloom.withColumnRenamed("block", "_block"), "_block", "left")
    hit = reduce(Column.__and__, [F.expr(f"shiftright(w{i}, _b{i}) & 1L = 1L") for i in range(WORDS)])
    probed = probed.select(*pages.columns, F.coalesce(hit & F.col("canonical_url").isNotNull(), F.lit(False)).alias("_maybe"))
    exact = entries.select(F.col("url").alias("canonical_url"), F.lit(True).alias("_in"))
    yes = probed.where("_maybe").join(exact, "canonical_url", "left").withColumn("listed", F.coalesce("_in", F.lit(False))).drop("_in", "_maybe")
    return yes.select(*pages.columns, "listed").unionByName(probed.where("not _maybe").select(*pages.columns, F.lit(False).alias("listed")))


def judge(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict: the rule's verdict, else block for listed URLs and allow for others."""
    ruled = apply_rules(pages, rules).withColumn("canonical_url", canonical(F.col("url")))
    judged = in_list(ruled, listed)
    other = F.when(F.col("listed"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", other).alias("verdict"))


def stand_in_list(pages: DataFrame) -> DataFrame:
    """A list to filter by, since the tables hold none: the canonical URLs whose md5 begins with 0."""
    url = canonical(F.col("url"))
    return pages.select(url.alias("url")).where(F.substring(F.md5(F.col("url")), 1, 1) == "0")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages, stand_in_list(pages))


OP9_SQL = r"""
with p as (
  select page_id, url,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
r(verdict, rule, rh, rp) as (values
  ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'), ('block', 'example.org/en/1', 'example.org', '/en/1'),
  ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')),
f as (
  select page_id, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as verdict
  from p join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by page_id),
c as (
  select page_id,
         regexp_replace(regexp_replace(regexp_extract(url, '://[^?#]*\?([^#]*)', 1), '(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '', 'g'), '^&', '') as q,
         regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '') as hp
  from p where contains(url, '://')),
u as (select page_id, hp || case when q <> '' then '?' || q else '' end as url from c)
select p.page_id, p.host, p.path, f.rule,
       coalesce(f.verdict, case when substr(md5(u.url), 1, 1) = '0' then 'block' else 'allow' end) as verdict
from p left join f using (page_id) left join u using (page_id)
"""
