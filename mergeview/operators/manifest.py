"""The table of runs: levels, limits, triggers, overlaps.  A row for each run, so small beside the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

L0_RUNS, BASE_SIZE, RATIO = 4, 10 * 1024 * 1024, 10


def level_limit(level: Column, base: int = BASE_SIZE, ratio: int = RATIO) -> Column:
    return F.when(level == 0, F.lit(0)).otherwise(F.lit(base) * F.pow(F.lit(ratio), level - 1)).cast("long")


def level_stats(runs: DataFrame) -> DataFrame:
    return runs.groupBy("level").agg(F.count("*").alias("n_runs"), F.sum("file_size").alias("total_size"))


def triggers(runs: DataFrame, base: int = BASE_SIZE, l0_runs: int = L0_RUNS) -> DataFrame:
    """due: level 0 by its number of runs (at the limit), others by size (above it)."""
    limit = level_limit(F.col("level"), base)
    due = F.when(F.col("level") == 0, F.col("n_runs") >= l0_runs).otherwise((limit > 0) & (F.col("total_size") > limit))
    return level_stats(runs).withColumns({"size_limit": limit, "due": due})


def overlapping(runs: DataFrame, low: Column, high: Column) -> DataFrame:
    """Runs whose closed key range meets low .. high."""
    return runs.where((F.col("min_key") <= high) & (low <= F.col("max_key")))


def touched(runs: DataFrame, keys: DataFrame, parts: int = 64) -> DataFrame:
    """key and runs_touched: how many runs' closed ranges hold each of the different keys.

    Those that begin up to the key less those that end before it, from running counts over keys and ends of
    ranges in order, so the cost doesn't grow with the product of keys and runs.  Parts of the order are dealt
    to tasks by cuts from a bounded sample of the keys; the cuts only deal the work.
    """
    some = sorted(r["key"] for r in keys.where("key is not null").orderBy(F.xxhash64("key")).limit(16 * parts).collect())
    cuts = F.array(*(F.lit(c) for c in sorted(set(some[len(some) // parts :: max(1, len(some) // parts)])))).cast("array<string>")
    ends = runs.select(F.col("min_key").alias("key"), F.lit(0).alias("kind"), F.lit(1).alias("step")).union(runs.select("max_key", F.lit(2), F.lit(-1)))
    ends = ends.groupBy("key", "kind").agg(F.sum("step").alias("step"))
    part = F.size(F.filter(cuts, lambda c: c <= F.col("key")))
    dealt = ends.union(keys.select("key", F.lit(1), F.lit(0).cast("long"))).withColumn("part", part)
    totals = ends.withColumn("part", part).groupBy("part").agg(F.sum("step").alias("step"))
    before = dealt.sparkSession.range(parts * 2).select(F.col("id").cast("int").alias("at")).join(F.broadcast(totals), F.expr("part < at")).groupBy("at").agg(F.sum("step").alias("open"))
    upto = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    counted = dealt.withColumn("n", F.sum("step").over(upto)).where("kind = 1")
    counted = counted.join(F.broadcast(before), F.col("part") == F.col("at"), "left")  # a row for each part
    return counted.select("key", (F.col("n") + F.coalesce("open", F.lit(0))).alias("runs_touched"))


def summary(runs: DataFrame, base: int = BASE_SIZE, shown: int = 3) -> DataFrame:
    """level, n_runs, total_size and size_limit; the first levels are shown even if they are empty."""
    levels = runs.sparkSession.range(shown).select(F.col("id").cast("int").alias("level"))
    zero = F.lit(0).cast("long")
    return levels.join(level_stats(runs), "level", "full").select("level", F.coalesce("n_runs", zero).alias("n_runs"), F.coalesce("total_size", zero).alias("total_size"), level_limit(F.col("level"), base).alias("size_limit"))


def edits(added: DataFrame, removed: DataFrame) -> DataFrame:
    """version, run_id, live: the log of changes.  added, removed: version, run_id."""
    return added.select("version", "run_id", F.lit(True).alias("live")).union(removed.select("version", "run_id", F.lit(False)))


def snapshot(edits: DataFrame, version: int | None = None) -> DataFrame:
    """run_id of the runs that are live as of a version, or now."""
    upto = edits if version is None else edits.where(F.col("version") <= version)
    return upto.groupBy("run_id").agg(F.max_by("live", "version").alias("live")).where("live").select("run_id")


JSON = "run_id BIGINT, level INT, num_entries BIGINT, min_key STRING, max_key STRING, file_size BIGINT"


def to_json(runs: DataFrame) -> DataFrame:
    return runs.select("run_id", F.to_json(F.struct("run_id", "level", "num_entries", "min_key", "max_key", "file_size")).alias("json"))


def from_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.from_json("json", JSON).alias("x")).select("x.*")
