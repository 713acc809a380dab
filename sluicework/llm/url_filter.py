"""URL filters: host and path rules, then a list of canonical URLs behind a blocked Bloom filter.

The filter is a table of at most `blocks` rows of eight 64-bit words. Its size is fixed by that
parameter and not by the list, so it may be broadcast; a list too long for it only sends more rows
to the exact join. URLs that the filter rules out never reach a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

#: 32,768 blocks of 512 bits: 2 MB, about eight bits a URL for two million listed URLs.
BLOCKS = 32_768
WORDS = 8


class HostRule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Fixed by the contract.
RULES = (
    HostRule("com", "/", "allow"),
    HostRule("example.com", "/en/", "block"),
    HostRule("www.example.com", "/en/", "allow"),
    HostRule("net", "/es/", "block"),
    HostRule("net", "/fr/", "block"),
)

#: Query parameters that don't change what a URL names.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without a default port, path without a final slash, the telling parameters in order; null without ://."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    telling = F.sort_array(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    address = F.concat(F.regexp_replace(host_of(url), r":(80|443)$", ""), F.regexp_replace(path_of(url), "/+$", ""))
    return F.when(url.contains("://"), F.when(F.size(telling) > 0, F.concat(
        address, F.lit("?"), F.array_join(telling, "&"))).otherwise(address))


def _rule(rules: Sequence[HostRule]) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.text), len(r.host), r.text)):  # the last that fits is the longest
        fits = ((F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)) & F.col("path").startswith(rule.path)
        chosen = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def _masks(url: Column) -> list[Column]:
    """One bit for each of the eight words of a block."""
    bits = F.xxhash64(url, F.lit(1))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(bits, 6 * k).bitwiseAND(F.lit(63)).cast("int"))
            for k in range(WORDS)]


def bloom(listed: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """The filter of the column `canonical_url`: block, w0 to w7; at most `blocks` rows."""
    masks = [m.alias(f"w{k}") for k, m in enumerate(_masks(F.col("canonical_url")))]
    return (
        listed.where(F.col("canonical_url").isNotNull())
        .select(_block(F.col("canonical_url"), blocks).alias("block"), *masks)
        .groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)])
    )


def judge_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[HostRule] = RULES, blocks: int = BLOCKS,
               key: str = "page_id", url: str = "url", listed_url: str = "url") -> DataFrame:
    """A verdict for every row of `pages`: the longest rule that fits, else block if the URL is listed.

    A null URL or one without :// has an empty host and path, fits no rule, is on no list and is
    allowed. A list may hold nulls and repeats. Repeated rows give repeated results; an empty list
    blocks nothing; only the key and the URL are read, so other columns may have any name.

    Returns key, host, path, rule (null if none fits), verdict, and listed (boolean).
    """
    urls = pages.select(F.col(key).alias("_key"), F.col(url).cast("string").alias("_url")).select(
        "_key", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"),
        canonical(F.col("_url")).alias("canonical_url"))
    urls = urls.withColumn("fit", _rule(rules)).withColumn("_block", _block(F.col("canonical_url"), blocks))
    entries = listed.select(canonical(F.col(listed_url).cast("string")).alias("canonical_url")).where(
        F.col("canonical_url").isNotNull()).distinct()

    masks = _masks(F.col("canonical_url"))
    passes = F.lit(True)
    for k, mask in enumerate(masks):
        passes = passes & (F.col(f"w{k}").bitwiseAND(mask) == mask)
    tested = urls.join(F.broadcast(bloom(entries, blocks)), F.col("_block") == F.col("block"), "left").select(
        *urls.columns, F.coalesce(passes & F.col("fit").isNull(), F.lit(False)).alias("possible"))

    exact = entries.withColumn("listed", F.lit(True))
    hits = tested.where("possible").join(exact, "canonical_url", "left").select(
        "_key", "host", "path", "fit", F.coalesce("listed", F.lit(False)).alias("listed"))
    rest = tested.where("not possible").select("_key", "host", "path", "fit", F.lit(False).alias("listed"))
    return rest.unionByName(hits).select(
        F.col("_key").alias(key), "host", "path", F.col("fit")["rule"].alias("rule"),
        F.coalesce(F.col("fit")["verdict"], F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")
