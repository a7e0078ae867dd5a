"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact hash join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.storage import broadcast_if_small

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BITS_PER_URL = 32
WORDS = 4
MOST_BLOCKS = 1 << 15


def host_of(url: Column) -> Column:
    """Host after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = _after(url)
    for mark in ("/", "?", "#"):
        host = F.substring_index(host, mark, 1)
    return F.translate(host, UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    after = _after(url)
    rest = F.substr(after, F.length(host_of(url)) + 1)
    return F.substring_index(F.substring_index(rest, "?", 1), "#", 1)


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bit(key: Column, word: int) -> Column:
    """The one bit of a word that a key sets, from another hash."""
    place = F.pmod(F.shiftrightunsigned(F.xxhash64(key, F.lit("bit")), 8 * word), F.lit(64)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place)


def blocked_bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """``keys`` (key) -> (block, w0 .. w3): a key sets one bit in each word of its one block."""
    key = F.col("key")
    return (keys.select(_block(key, blocks).alias("block"), *[_bit(key, i).alias(f"w{i}") for i in range(WORDS)])
            .groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]))


def judge_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Verdict on every page by the longest listed URL that its own URL falls under.

    ``pages`` (page_id, url, ...), ``rules`` (host, path, verdict: allow or block) -> (page_id, host,
    path, rule, verdict), one row per page; the records of statements hold no URLs, so this operator
    is general.  A rule fits its host and all subdomains where the URL's path starts with the rule's
    path.  The longest host + path wins (then the longer host, then block).  Without a fitting rule
    ``rule`` is null and the verdict is allow.  A null URL or one without ``://`` has an empty host and
    path.  Rules with a null part are left out, of repeated rules one counts; repeated pages stay;
    other columns are not read.  No rules: all pages are allowed.

    A listed URL must be one of the host suffixes and path prefixes of the page's URL whose shapes
    (labels, path length) are listed at all.  These candidates pass a blocked Bloom filter of at most
    ``MOST_BLOCKS`` blocks of 256 bits, which bounds what is broadcast; what passes is joined with the
    list by the whole string, so a false hit is never more than wasted work.
    """
    listed = (rules.where("host is not null and path is not null and verdict is not null")
              .select(F.concat("host", "path").alias("key"), F.length("host").alias("host_length"), "verdict",
                      F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("path_length"))
              .groupBy("key", "host_length", "labels", "path_length").agg(F.max("verdict").alias("verdict")))
    shapes = sorted((r["labels"], r["path_length"])
                    for r in listed.select("labels", "path_length").distinct().collect())
    count = listed.count()
    blocks = 1
    while blocks * 64 * WORDS < count * BITS_PER_URL and blocks < MOST_BLOCKS:
        blocks *= 2
    url = F.col("url")
    parts = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    if not shapes:
        return parts.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"),
                            F.lit("allow").alias("verdict"))
    labels = F.size(F.split("host", r"\."))
    candidates = F.array_compact(F.array(*[
        F.when((labels >= n) & (F.length("path") >= m),
               F.struct(F.concat(F.substring_index("host", ".", -n), F.substring("path", 1, m)).alias("key"),
                        F.length(F.substring_index("host", ".", -n)).alias("host_length")))
        for n, m in shapes]))
    tried = (parts.select("host", "path", F.explode(candidates).alias("c"))
             .select("host", "path", "c.key", "c.host_length").withColumn("block", _block(F.col("key"), blocks)))
    bloom = F.broadcast(blocked_bloom(listed.select("key"), blocks))
    possible = tried.join(bloom, "block")
    for i in range(WORDS):
        possible = possible.where(F.col(f"w{i}").bitwiseAND(_bit(F.col("key"), i)) != 0)
    hits = possible.select("host", "path", "key", "host_length").distinct()
    exact = hits.join(broadcast_if_small(listed.select("key", "host_length", "verdict")), ["key", "host_length"])
    best = exact.groupBy("host", "path").agg(
        F.max(F.struct(F.length("key").alias("n"), "host_length", "verdict", "key")).alias("best"))
    return parts.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))
