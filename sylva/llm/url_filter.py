"""URL filter: a blocked Bloom filter of listed canonical URLs in front of an exact hash join.

Listed entries are canonical URLs, host plus path, each with a verdict. The filter holds them, and their hosts alone. The
ends of a page's host, by as many labels as some entry has, probe it first; those that pass meet the listed hosts in an
exact equi-join, which removes false positives and tells how long the listed paths of the host are. The starts of the
page's path of these lengths make canonical URLs, which probe the filter again; those that pass meet the entries in an
exact equi-join. All of it is DataFrame operations.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter for each listed entry, bits set for each, 64-bit words of a block.
BITS_PER_ENTRY, PROBES, WORDS = 12, 8, 4
#: A filter of more bytes than this is joined by a shuffle on its block number instead of being broadcast.
BROADCAST_BYTES = 32 << 20
#: Up to so many listed hosts, or entries (about 100 bytes each), are broadcast to the keys that passed.
BROADCAST_ROWS = 200_000


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null and for a text without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks))


def _masks(key: Column) -> list[Column]:
    """The bits of a key in each word of its block."""
    h = F.xxhash64(key, F.lit("bits"))
    words: list[Column] = []
    for w in range(WORDS):
        bit = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * j).bitwiseAND(63).cast("int")) for j in range(w, PROBES, WORDS)]
        m = bit[0]
        for b in bit[1:]:
            m = m.bitwiseOR(b)
        words.append(m)
    return words


@dataclass(frozen=True)
class BlockedBloom:
    """The filter as a table: a row for each block that has bits, its words ``w0`` ..."""

    blocks: DataFrame
    n_blocks: int

    @staticmethod
    def of(keys: DataFrame, n: int) -> BlockedBloom:
        """The filter of column ``key``, of about ``n`` different keys."""
        n_blocks = max(1, math.ceil(n * BITS_PER_ENTRY / (64 * WORDS)))
        masks = [m.alias(f"m{i}") for i, m in enumerate(_masks(F.col("key")))]
        blocks = keys.select(_block(F.col("key"), n_blocks).alias("block"), *masks).groupBy("block").agg(*[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(WORDS)])
        return BlockedBloom(F.broadcast(blocks) if n_blocks * 8 * (WORDS + 1) <= BROADCAST_BYTES else blocks, n_blocks)

    def passing(self, rows: DataFrame) -> DataFrame:
        """The rows whose ``key`` may be in the filter: all that are, and a few others."""
        probes = rows.select("*", _block(F.col("key"), self.n_blocks).alias("block"), *[m.alias(f"m{i}") for i, m in enumerate(_masks(F.col("key")))])
        hit = F.lit(True)
        for i in range(WORDS):
            hit = hit & (F.col(f"w{i}").bitwiseAND(F.col(f"m{i}")) == F.col(f"m{i}"))
        return probes.join(self.blocks, "block").filter(hit).select(*rows.columns)


def url_filter(pages: DataFrame, listed: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Verdict of each row's URL: ``keep`` columns, host, path, rule, verdict, listed.

    ``listed``: host, path, verdict (allow or block), is_rule. An entry fits its host and all subdomains of it where the
    URL's path starts with the entry's. The longest fitting rule decides (by characters; of equal ones, the longer host), and
    ``rule`` is its text; only where no rule fits, the longest fitting other entry decides, and ``listed`` is its text. None
    fits: allow. An entry given twice with both verdicts blocks.

    Null URLs and texts without ``://`` have empty host and path and are allowed; repeated rows are judged alike; an empty
    list allows all; other columns of the input are not looked at.
    """
    entries = listed.groupBy("host", "path", "is_rule").agg(F.max("verdict").alias("verdict")).withColumn("key", F.concat("host", "path"))
    hosts = entries.groupBy("host").agg(F.collect_set(F.length("path")).alias("lengths"))  # a number for each length of a host's paths
    labels = [r[0] for r in hosts.select(F.size(F.split("host", r"\."))).distinct().collect()]  # numbers of labels that occur
    h, p = host_and_path(F.col(url))
    rows = pages.select(*keep, h.alias("host"), p.alias("path"))
    if not labels:
        return rows.select(*keep, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"), F.lit(None).cast("string").alias("listed"))
    n_hosts, n_entries = hosts.count(), entries.count()
    bloom = BlockedBloom.of(entries.select("key").unionByName(hosts.select(F.col("host").alias("key"))), n_hosts + n_entries)

    # each (host, path) is judged once, however many pages have it
    urls = rows.filter("host <> ''").groupBy("host", "path").agg(F.lit(1).alias("one"))
    ends = F.array_distinct(F.array(*[F.substring_index("host", ".", -n) for n in sorted(labels)]))
    by_host = bloom.passing(urls.select(F.col("host").alias("url_host"), F.col("path").alias("url_path"), F.explode(ends).alias("key")))
    found = by_host.join(F.broadcast(hosts) if n_hosts <= BROADCAST_ROWS else hosts, by_host.key == hosts.host).select("url_host", "url_path", "host", "lengths")
    starts = F.transform(F.filter("lengths", lambda n: n <= F.length("url_path")), lambda n: F.substring("url_path", F.lit(1), n))
    by_url = found.select("url_host", "url_path", "host", F.explode(starts).alias("path")).withColumn("key", F.concat("host", "path"))
    exact = bloom.passing(by_url).drop("key").join(F.broadcast(entries) if n_entries <= BROADCAST_ROWS else entries, ["host", "path"])
    best = F.struct(F.length("key").alias("chars"), F.length("host").alias("host_chars"), "key", "verdict")
    judged = exact.groupBy("url_host", "url_path").agg(F.max(F.when(F.col("is_rule"), best)).alias("r"), F.max(F.when(~F.col("is_rule"), best)).alias("s"))
    out = rows.join(judged, (rows.host == judged.url_host) & (rows.path == judged.url_path), "left")
    return out.select(
        *keep, rows.host, rows.path, F.col("r.key").alias("rule"), F.coalesce("r.verdict", "s.verdict", F.lit("allow")).alias("verdict"),
        F.when(F.col("r.key").isNull(), F.col("s.key")).alias("listed"),
    )
