"""Compaction: merging runs, and the two policies that say which."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mergeview.operators.folds import size_buckets
from mergeview.operators.manifest import triggers
from mergeview.operators.resolve import latest_wins
from mergeview.schemas import PUT

MIN_RUNS, MAX_RUNS = 4, 32


def merge_runs(data: DataFrame, drop_deletes: bool = False) -> DataFrame:
    """The newest version of each key over all given runs.  Deletes may only go where no older run can hold the key."""
    merged = latest_wins(data)
    return merged.where(F.col("op") == PUT) if drop_deletes else merged


def tiered_pick(runs: DataFrame, least: int = MIN_RUNS, most: int = MAX_RUNS) -> DataFrame:
    """run_id of the fullest size bucket (smallest sizes among equals) that has enough runs, up to `most` of them."""
    buckets = size_buckets(runs)
    best = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "bucket").limit(1)
    inside = buckets.join(F.broadcast(best), "bucket")  # one row
    return inside.withColumn("rank", F.row_number().over(Window.partitionBy("bucket").orderBy("file_size", "run_id"))).where(F.col("rank") <= most).select("run_id", "bucket", "file_size")


def level_pick(runs: DataFrame, base: int, l0_runs: int, last_level: int) -> DataFrame:
    """The level to compact: 0 if it is due, else the lowest that is; the last never."""
    return triggers(runs, base, l0_runs).where(F.col("due") & (F.col("level") < last_level)).agg(F.min("level").alias("level"))


def victim(runs: DataFrame, level: int) -> DataFrame:
    """The run of a level that overlaps the fewest bytes below it, the smallest first key and then id among equals."""
    a = runs.where(F.col("level") == level).select("run_id", "min_key", "max_key")
    b = runs.where(F.col("level") == level + 1).select(F.col("min_key").alias("lo"), F.col("max_key").alias("hi"), "file_size")
    met = a.join(b, (F.col("lo") <= F.col("max_key")) & (F.col("min_key") <= F.col("hi")), "left")
    bytes_below = met.groupBy("run_id", "min_key", "max_key").agg(F.coalesce(F.sum("file_size"), F.lit(0)).alias("overlap_bytes"))
    return bytes_below.orderBy("overlap_bytes", "min_key", "run_id").limit(1)


def level_inputs(runs: DataFrame, picked: DataFrame, level: int) -> DataFrame:
    """run_id of the picked runs and of those below that overlap their common range."""
    span = picked.agg(F.min("min_key").alias("lo"), F.max("max_key").alias("hi"))
    below = runs.where(F.col("level") == level + 1).join(F.broadcast(span), (F.col("min_key") <= F.col("hi")) & (F.col("lo") <= F.col("max_key"))).select("run_id")  # span: one row
    return picked.select("run_id").union(below)
