"""URL filter: host and path rules, then a blocked Bloom filter before an exact hash join.

The filter is a table of blocks. A URL's hash names its block and four bits in it, so the
test of a URL is a join on the block, which shuffles or broadcasts by Spark's own size
check; the filter is never gathered in one place. What passes is joined exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm.shared import stored

WORDS = 4  # a block: 4 x 64 bits, one bit set in each
URLS_PER_BLOCK = 24  # about 10 bits a URL


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without ``www.`` and ``m.``, path without ``.html`` and closing slashes; scheme, query and
    fragment are left out. Null where there is no host."""
    bare = F.regexp_replace(path, r"(?s)(\.html|/+)\z", "")
    return F.when(host != "", F.concat(F.regexp_replace(host, r"\A(www|m)\.", ""), bare))


def block_and_bits(url: Column, blocks: int) -> tuple[Column, list[Column]]:
    h = F.xxhash64(url)
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(F.xxhash64(url, F.lit(i)), 58).cast("int")) for i in range(WORDS)]
    return F.pmod(h, F.lit(blocks)).alias("_block"), [b.alias(f"_b{i}") for i, b in enumerate(bits)]


def bloom(listed: DataFrame, url: str, blocks: int) -> DataFrame:
    """One row per block in use: _block and its words _w0 to _w3."""
    block, bits = block_and_bits(F.col(url), blocks)
    return listed.select(block, *bits).groupBy("_block").agg(*[F.bit_or(f"_b{i}").alias(f"_w{i}") for i in range(WORDS)])


def in_list(pages: DataFrame, listed: DataFrame, key: str, url: str) -> DataFrame:
    """The distinct values of ``key`` in ``pages`` that are among ``url`` of ``listed``."""
    listed = stored(listed.select(F.col(url).alias("_url")).where("_url is not null").distinct(), "listed")
    blocks = max(1, -(-listed.count() // URLS_PER_BLOCK))
    block, bits = block_and_bits(F.col(key), blocks)
    asked = pages.select(key).where(F.col(key).isNotNull()).distinct().select(key, block, *bits)
    fits = " and ".join(f"(_b{i} & _w{i}) <> 0" for i in range(WORDS))
    possible = asked.join(bloom(listed, "_url", blocks), "_block").where(fits).select(key)
    return possible.join(listed, F.col(key) == F.col("_url"), "left_semi")


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], url: str = "canonical_url") -> DataFrame:
    """``pages`` (page_id, url) with host, path, rule, verdict, canonical_url and by_list.

    ``rules``: (verdict, host, path); a rule fits its host and the subdomains if the path
    starts with the rule's, and the longest decides. Without a rule, a page is blocked if
    its canonical URL is in ``listed``, else allowed. A null URL, or one without ``://``,
    has neither host nor canonical URL and is allowed. Repeated rows each get their row.
    """
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    split = split.withColumn("canonical_url", canonical(F.col("host"), F.col("path")))
    rule = verdict = F.lit(None).cast("string")
    for says, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    split = split.withColumns({"rule": rule, "_says": verdict})
    hits = in_list(split, listed, "canonical_url", url).select("canonical_url", F.lit(True).alias("by_list"))
    out = split.join(hits, "canonical_url", "left").withColumn("by_list", F.coalesce("by_list", F.lit(False)))
    verdict = F.coalesce("_says", F.when(F.col("by_list"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "canonical_url", "by_list")
