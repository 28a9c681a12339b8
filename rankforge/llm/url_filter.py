"""URL filters in DataFrame functions only: host rules, then a list of URLs behind a blocked Bloom filter.

The filter is a table: one row for each block of 512 bits, as eight 64-bit words.  A listed URL sets one bit in each
word of one block, and bit_or gathers the blocks.  Probing is a join on the block number.  Its size is known from the
number of listed URLs before it is built; up to max_filter_bytes it is broadcast, beyond that the join is shuffled.
Only possible hits reach the exact join with the list, which removes false positives.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, written

#: (verdict, host, path) of the host rules (fixed values).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
BITS_PER_URL = 16
MAX_FILTER_BYTES = 64 << 20
#: Parameters that say where a visitor comes from, not what the page is.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=.*)?$"
_WORDS = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path; both empty for a null URL and for one without "://"."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"^[^?#]*", 0)
    return ascii_lower(host), path


def parsed(pages: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, canonical (null where there is no host): host without www. and default port, path without a
    slash at its end, other parameters than tracking ones in order, no fragment."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = rows.select("page_id", "url", host.alias("host"), path.alias("path"))
    query = F.regexp_extract("url", r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.sort_array(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING))), "&")
    site = F.regexp_replace(F.regexp_replace("host", r"^www\.", ""), r":(80|443)$", "")
    whole = F.concat(site, F.regexp_replace("path", r"/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))
    return rows.select("page_id", "host", "path", F.when(F.col("host") != "", whole).alias("canonical"))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def _block(canonical: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(canonical), F.lit(n_blocks))


def _masks(canonical: Column) -> list[Column]:
    bits = F.xxhash64(canonical, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(bits, 6 * i).bitwiseAND(63).cast("int")) for i in range(_WORDS)]


def bloom_filter(listed: DataFrame, n_blocks: int) -> DataFrame:
    """block, w0 .. w7 of the blocked Bloom filter over listed.canonical."""
    masks = _masks(F.col("canonical"))
    rows = listed.select(_block(F.col("canonical"), n_blocks).alias("block"), *(m.alias(f"w{i}") for i, m in enumerate(masks)))
    return rows.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(_WORDS)))


def filter_urls(pages: DataFrame, listed_urls: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES, bits_per_url: int = BITS_PER_URL, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """page_id, host, path, rule, verdict, listed for every row of pages; listed_urls holds URLs in the column url.

    A host rule decides where one fits; else a page is blocked if its canonical URL is listed.  Null and malformed URLs
    have no canonical form: no rule and no list entry fits them, so they are allowed.  Repeated pages are each judged.
    """
    listed = written(parsed(listed_urls.select(F.lit(None).alias("page_id"), "url")).select("canonical").where("canonical is not null").distinct(), "listed")
    n_blocks = max(1, math.ceil(listed.count() * bits_per_url / (64 * _WORDS)))
    blocks = bloom_filter(listed, n_blocks)
    if n_blocks * 8 * (_WORDS + 1) <= max_filter_bytes:
        blocks = F.broadcast(blocks)
    rows = parsed(pages, page_id, url)
    rows = rows.withColumn("block", F.when(F.col("canonical").isNotNull(), _block(F.col("canonical"), n_blocks)).otherwise(F.pmod(F.xxhash64("page_id"), F.lit(n_blocks))))
    hit = F.lit(True)
    for i, m in enumerate(_masks(F.col("canonical"))):
        hit = hit & (F.col(f"w{i}").bitwiseAND(m) == m)
    probed = rows.join(blocks, "block", "left").select("page_id", "host", "path", "canonical", (F.col("canonical").isNotNull() & F.coalesce(hit, F.lit(False))).alias("maybe"))
    exact = listed.select(F.col("canonical"), F.lit(True).alias("listed"))
    hits = probed.where("maybe").join(exact.hint("shuffle_hash"), "canonical", "left")
    judged = hits.select("page_id", "host", "path", F.coalesce("listed", F.lit(False)).alias("listed")).unionByName(probed.where("not maybe").select("page_id", "host", "path", F.lit(False).alias("listed")))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return judged.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "listed")


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    """The list: the URLs of the pages whose id is divisible by 20, so that it grows with the table."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, pages.where("page_id % 20 = 0").select("url"))


OP1_SQL = r"""
WITH a AS (
  SELECT page_id, url, CASE WHEN position('://' IN url) > 0 THEN substring(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM a),
q AS (SELECT *, array_to_string(list_sort(list_filter(string_split(coalesce(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), ''), '&'),
                lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=.*)?$'))), '&') AS kept FROM b),
c AS (SELECT page_id, host, path, CASE WHEN host <> '' THEN
        regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '') || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END END AS canonical FROM q),
l AS (SELECT DISTINCT canonical FROM c WHERE page_id % 20 = 0 AND canonical IS NOT NULL),
r AS (SELECT c.*, l.canonical IS NOT NULL AS listed,
        CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
             WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
             WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
             WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
      FROM c LEFT JOIN l ON c.canonical = l.canonical)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM r
"""
