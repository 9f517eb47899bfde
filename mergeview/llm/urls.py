"""URL filters: path rules, then a list of canonical URLs behind a blocked Bloom filter.

The filter keeps one 64-bit block for a few listed URLs; a URL sets HASHES bits of one block.  Pages
whose bits are all set may be listed and go to an exact join with the list, which removes the false
positives; the others skip that join.  The filter is sent to the executors only up to BROADCAST_BLOCKS
blocks of 16 bytes; beyond that it is joined by block.

A null url, or one without "://", has an empty host and path and no canonical form, so no rule fits and
it is allowed.  Every page gives a row; repeated pages and repeated list entries change nothing.  URLs of any
length are looked at as a whole; columns other than id and url are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASHES = 5
BITS_PER_URL = 16
BROADCAST_BLOCKS = 1 << 20

_upper, _lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column, Column]:
    """host, path and what stands between ? and #."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    tail = F.substr(rest, F.length(host) + 1, F.length(rest))
    path = F.regexp_extract(tail, "^[^?#]*", 0)
    query = F.regexp_extract(tail, r"^[^?#]*\?([^#]*)", 1)
    return F.coalesce(F.translate(host, _upper, _lower), F.lit("")), F.coalesce(path, F.lit("")), F.coalesce(query, F.lit(""))


def canonical(host: Column, path: Column, query: Column) -> Column:
    """Without scheme, fragment, a leading www. or m., a trailing slash and tracking parameters (utm_*, ref), the others in order; null without a host."""
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(?:utm_[^=]*|ref)(?:=|$)")))
    asked = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^(?:www|m)\.", ""), F.regexp_replace(path, "/+$", ""), asked))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]], give: int | None = None) -> Column:
    """The longest rule (verdict, host, path) that fits, as text host + path, or its verdict."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.lit(verdict if give == 0 else h + p)
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("string") if out is None else out


def bloom_bits(url: Column, blocks: int) -> tuple[Column, Column]:
    """The block of a URL, and a 64-bit word with its bits."""
    other = F.xxhash64(url, F.lit("bits"))
    mask = F.lit(0).cast("long")
    for i in range(HASHES):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(other, 6 * i), F.lit(64)).cast("int")))
    return F.pmod(F.xxhash64(url), F.lit(blocks)), mask


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    block, mask = bloom_bits(F.col("canonical"), blocks)
    return listed.select(block.alias("block"), mask.alias("mask")).groupBy("block").agg(F.bit_or("mask").alias("word"))


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and listed.  listed: a column of canonical URLs."""
    host, path, query = parts(pages[url_col])
    rows = pages.select(pages[id_col].alias("page_id"), host.alias("host"), path.alias("path"), query.alias("query"))
    rows = rows.select("page_id", "host", "path", canonical(F.col("host"), F.col("path"), F.col("query")).alias("canonical"))
    listed = listed.toDF("canonical").where("canonical is not null").distinct()
    blocks = max(1, -(-listed.count() * BITS_PER_URL // 64))
    words = bloom_filter(listed, blocks)
    words = F.broadcast(words) if blocks <= BROADCAST_BLOCKS else words
    block, mask = bloom_bits(F.col("canonical"), blocks)
    nowhere = -1 - F.pmod(F.xxhash64("page_id"), F.lit(1 << 20))  # urls without a form are in no block, and not all in one
    probed = rows.withColumns({"block": F.when(F.col("canonical").isNotNull(), block).otherwise(nowhere), "mask": mask}).join(words, "block", "left")
    probed = probed.withColumn("maybe", F.coalesce(F.col("word").bitwiseAND(F.col("mask")) == F.col("mask"), F.lit(False)))
    hits = probed.where("maybe").join(listed.withColumn("found", F.lit(True)), "canonical", "left")
    columns = ["page_id", "host", "path", F.coalesce("found", F.lit(False)).alias("listed")]
    both = hits.select(*columns).union(probed.where("not maybe").select("page_id", "host", "path", F.lit(False)))
    h, p = F.col("host"), F.col("path")
    own = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return both.select("page_id", "host", "path", rule_for(h, p, rules).alias("rule"), F.coalesce(rule_for(h, p, rules, give=0), own).alias("verdict"), "listed")
