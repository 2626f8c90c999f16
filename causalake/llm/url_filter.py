"""Operator 1, URL filters: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

DataFrame functions only. A listed rule is a canonical URL prefix: a host and the start of a path. Each
url yields the canonical prefixes that could be listed (its host and parent domains of as many labels as listed hosts
have, times its path cut at the lengths that listed paths have). Those that the Bloom filter lets through are joined exactly with the
list, which removes the filter's false positives; the longest listed prefix decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of 32 bits in a block, one bit set in each for a key.
WORDS = 8
#: The filter takes so many bits for each key, and so many blocks (of 32 bytes) at most: 2 MB.
BITS_PER_KEY, MOST_BLOCKS = 24, 1 << 16


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2), F.lit(""))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bit(turn: Column, word: int) -> Column:
    """The bit of a word that a key's second hash picks."""
    return F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(turn, 5 * word).bitwiseAND(F.lit(31)).cast("int"))


def bloom(rules: DataFrame, key: str, blocks: int) -> DataFrame:
    """One row, one array of blocks * 8 integers: the split-block Bloom filter of rules[key]."""
    words = [F.bit_or(_bit(F.xxhash64(key, F.lit(7)), i)).alias(f"w{i}") for i in range(WORDS)]
    held = rules.groupBy(_block(F.col(key), blocks).alias("block")).agg(*words)
    every = rules.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block")).join(held, "block", "left")
    row = F.struct("block", F.array(*(F.coalesce(f"w{i}", F.lit(0)) for i in range(WORDS))).alias("w"))
    return every.agg(F.flatten(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["w"])).alias("bloom"))


def _all_set(at: Column, turn: Column, filled: Column) -> Column:
    out = F.lit(True)
    for i in range(WORDS):
        out = out & (F.get(filled, at + i).bitwiseAND(_bit(turn, i)) != 0)
    return out


def may_hold(key: Column, filled: Column, blocks: int) -> Column:
    """Whether all bits of the key are set in its block."""
    return _all_set(_block(key, blocks) * WORDS, F.xxhash64(key, F.lit(7)), filled)


def possible(keys: Column, filled: Column, blocks: int) -> Column:
    """Those of an array of keys that the filter may hold; each key is hashed once."""
    seeded = F.transform(keys, lambda k: F.struct(k.alias("key"), (_block(k, blocks) * WORDS).alias("at"), F.xxhash64(k, F.lit(7)).alias("turn")))
    return F.transform(F.filter(seeded, lambda k: _all_set(k["at"], k["turn"], filled)), lambda k: k["key"])


def url_verdicts(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict.

    pages needs `url`; rules has host, path and verdict (allow or block), listed once each. A rule fits
    its host and all subdomains if the url's path starts with the rule's path; the longest rule (host and
    path together) wins, then the one with the longer host. A url that no rule fits gets a null rule and
    the default verdict: it isn't listed. Null urls and urls without :// have empty host and path and fit
    no rule. Repeated rows stay. Columns of pages that are called host, path, rule or verdict are replaced.
    An empty list gives every url the default.

    The filter has at most MOST_BLOCKS blocks (2 MB) however long the list; it is built once and tested in
    each row, so a url whose keys it all refutes is read, answered and never shuffled. Urls with possible hits
    are joined with the list by whichever join Spark finds for its size, and grouped again. Urls are tested
    whole, whatever their length.
    """
    pages = pages.drop("host", "path", "rule", "verdict")
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("_host"), F.col("path").alias("_path"), F.col("verdict").alias("_verdict"))
    rules = rules.where(F.col("_host") != "").select("*", F.concat("_host", "_path").alias("_key")).dropDuplicates(["_host", "_path"])
    depth = lambda h: F.length(h) - F.length(F.translate(h, ".", "")) + 1
    listed = rules.agg(F.count("*"), F.sort_array(F.collect_set(F.length("_path"))), F.sort_array(F.collect_set(depth("_host")))).first()
    if not listed[0]:
        return pages.select("*", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    lengths, depths = (F.array(*(F.lit(int(x)) for x in held)) for held in listed[1:])
    blocks = 1
    while blocks < MOST_BLOCKS and blocks * WORDS * 32 < listed[0] * BITS_PER_KEY:
        blocks *= 2

    rows = pages.select(F.struct(*pages.columns).alias("_row"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    # Only as many last labels as some listed host has: a host of many labels costs its length once for each such number.
    hosts = F.transform(F.filter(depths, lambda n: n <= depth("host")), lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n))
    cuts = F.filter(lengths, lambda n: n <= F.length("path"))
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(cuts, lambda n: F.concat(h, F.substring(F.col("path"), F.lit(1), n)))))
    # The filter's words as one constant: Spark folds the text into an array when it plans the query.
    words = bloom(rules, "_key", blocks).select(F.array_join(F.col("bloom").cast("array<string>"), ",")).first()[0]
    tries = possible(keys, F.split(F.lit(words), ",").cast("array<int>"), blocks)
    rows = rows.select(F.monotonically_increasing_id().alias("_id"), "*", tries.alias("_tries"))
    unlisted = rows.where(F.size("_tries") == 0)
    tried = rows.select("_id", "_row", "host", "path", F.explode("_tries").alias("_try"))
    fits = (F.col("_try") == F.col("_key")) & F.col("path").startswith(F.col("_path"))
    found = tried.join(rules, fits, "left")
    best = F.max(F.when(F.col("_key").isNotNull(), F.struct(F.length("_key").alias("n"), F.length("_host").alias("h"), F.col("_key").alias("rule"), F.col("_verdict").alias("verdict"))))
    listed = found.groupBy("_id").agg(F.first(F.struct("_row", "host", "path")).alias("_kept"), best.alias("_best"))
    listed = listed.select("_kept._row.*", "_kept.host", "_kept.path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
    return listed.union(unlisted.select("_row.*", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")))


#: The rules of the contract: (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """A list of (verdict, host, path) as a table whose size Spark knows."""
    quoted = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    return spark.sql(f"SELECT * FROM VALUES {quoted} AS t(verdict, host, path)")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every url of pages."""
    from .common import read

    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return url_verdicts(pages, rules_table(spark)).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH rules(rverdict, rhost, rpath) AS (VALUES
  ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
p AS (
  SELECT row_number() OVER () AS rid, page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
m AS (
  SELECT p.*, r.rhost || r.rpath AS rule, r.rverdict,
    row_number() OVER (PARTITION BY rid ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST, length(r.rhost) DESC NULLS LAST) AS n
  FROM p LEFT JOIN rules r
    ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM m WHERE n = 1
"""
