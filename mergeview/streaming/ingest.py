"""Streaming ingest of a change log into sorted runs, and the state they amount to.

A micro-batch is a memtable: it is resolved to the newest version of each key and written as one run
named by the batch's id, overwriting itself when a batch is repeated after a failure.  Late rows are
rows of a smaller seq; resolution puts them in their place whenever they come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeview.operators.compaction import merge_runs
from mergeview.operators.resolve import latest_wins, visible
from mergeview.schemas import PUT


def flush_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    run = latest_wins(batch.select("seq", "op", "key", "value"))
    run.repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").option("parquet.bloom.filter.enabled#key", "true").parquet(f"{path}/run_id={batch_id}")


def start_ingest(log: DataFrame, path: str, checkpoint: str):
    """Start a query that flushes each micro-batch of a streaming change log."""
    return log.writeStream.foreachBatch(lambda batch, i: flush_batch(batch, i, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("seq BIGINT, op INT, key STRING, value STRING, run_id BIGINT").parquet(path)


def state(spark: SparkSession, path: str, as_of: int | None = None) -> DataFrame:
    """The visible state, or that as of a sequence number."""
    rows = runs(spark, path)
    return visible(latest_wins(rows if as_of is None else rows.where(F.col("seq") <= as_of)))


def compact(spark: SparkSession, path: str, to: str) -> None:
    """Merge all runs into one under another path.  As nothing older is left outside, deletes go."""
    merge_runs(runs(spark, path).drop("run_id"), drop_deletes=True).repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").parquet(f"{to}/run_id=0")


def latest_by_key(log: DataFrame):
    """Continuous output: the newest version of each key so far, in update mode, kept as aggregation state."""
    newest = F.max_by(F.struct("seq", "op", "value"), "seq").alias("x")
    return log.groupBy("key").agg(newest).select("key", "x.*").withColumn("live", F.col("op") == PUT)
