"""Blocks of sorted runs: prefix sharing, packing, sparse index, floor look-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mergeview.functions.text import entry_size, shared_prefix
from mergeview.operators.bloom import num_bits
from mergeview.operators.folds import greedy_groups
from mergeview.schemas import BLOCK_HEADER, BLOCK_LENGTH, BLOOM_HEADER, FOOTER, INDEX_ENTRY, INDEX_HEADER


def with_shared(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows with shared: characters that a key has in common with the one before it in its group."""
    before = F.lag("key").over(Window.partitionBy(*by).orderBy("key"))
    return rows.withColumn("_before", before).withColumn("shared", F.when(F.col("_before").isNull(), 0).otherwise(shared_prefix(F.col("key"), F.col("_before")))).drop("_before")


def packed(rows: DataFrame, by: list[str], target: int) -> DataFrame:
    """rows (by, key, value) with shared, size (of the entry after the one before it), first (of an entry that begins a
    block, which shares nothing) and block_id: a block is full once its header and entries reach the target."""
    dealt = with_shared(rows.repartition(*by), by)
    whole, delta = entry_size(F.col("key"), F.col("value")), entry_size(F.col("key"), F.col("value"), F.octet_length(F.expr("left(key, shared)")))
    sized = dealt.withColumns({"size": delta, "first": whole})
    return greedy_groups(sized, by, "key", "size", target, "block_id", first="first", start=BLOCK_HEADER, dealt=True)


def block_stats(blocks: DataFrame, by: list[str]) -> DataFrame:
    """first_key, last_key, n and size of each block, its header included.  blocks: what packed() gives."""
    entries = F.sum("size") + F.min_by(F.col("first") - F.col("size"), "key")
    return blocks.groupBy(*by, "block_id").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count("*").alias("n"), (entries + BLOCK_HEADER).alias("size"))


def sparse_index(blocks: DataFrame, by: list[str]) -> DataFrame:
    """block_stats() with the offset of each block in its file; the index alone is sorted, not the entries."""
    before = Window.partitionBy(*by).orderBy("block_id").rowsBetween(Window.unboundedPreceding, -1)
    return block_stats(blocks, by).withColumn("offset", F.coalesce(F.sum(F.col("size") + BLOCK_LENGTH).over(before), F.lit(0)))


def file_sizes(index: DataFrame, by: list[str], bits_per_key: float = 10.0) -> DataFrame:
    """blocks, n, index_offset, bloom_offset and file_size of each run.  index: what sparse_index() gives."""
    entry = F.octet_length("first_key") + INDEX_ENTRY
    each = index.groupBy(*by).agg(F.count("*").alias("blocks"), F.sum("n").alias("n"), F.sum(F.col("size") + BLOCK_LENGTH).alias("index_offset"), F.sum(entry).alias("entries"))
    bloom_offset = F.col("index_offset") + INDEX_HEADER + F.col("entries")
    filter_bytes = F.floor((num_bits(F.col("n"), bits_per_key) + 7) / 8)
    return each.select(*by, "blocks", "n", "index_offset", bloom_offset.alias("bloom_offset"), (bloom_offset + BLOOM_HEADER + filter_bytes + FOOTER).cast("long").alias("file_size"))


def find(blocks: DataFrame, index: DataFrame, probes: DataFrame, by: list[str]) -> DataFrame:
    """Entries of the probed keys: only the block that may hold a key is looked at.  probes: by, key."""
    return blocks.join(floor_block(index, probes, by).where("block_id is not null"), [*by, "block_id", "key"], "left_semi")


def floor_block(index: DataFrame, probes: DataFrame, by: list[str]) -> DataFrame:
    """For each probe of a run the last block that begins at or before its key; null below the first.

    One sort of blocks and probes together, so the cost doesn't grow with their product.
    """
    both = index.select(*by, F.col("first_key").alias("key"), "block_id", F.lit(0).alias("kind")).union(probes.select(*by, "key", F.lit(None).cast("long"), F.lit(1)))
    upto = Window.partitionBy(*by).orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("block_id", F.last("block_id", ignorenulls=True).over(upto)).where("kind = 1").drop("kind")


def decoded(rows: DataFrame, by: list[str]) -> DataFrame:
    """Keys rebuilt in order from shared lengths and suffixes.  rows: by, rn, shared, suffix; a group is a block."""
    held = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rn", "shared", "suffix"))).alias("rows"))
    keys = F.aggregate("rows", F.array().cast("array<string>"), lambda acc, x: F.concat(acc, F.array(F.concat(F.substr(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")), F.lit(1), x["shared"]), x["suffix"]))))
    return held.select(*by, F.explode(keys).alias("key"))
