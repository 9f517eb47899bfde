"""Change logs over the events table, and the runs and segments cut from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeview.operators.resolve import latest_wins
from mergeview.schemas import DELETE, PUT

RUN_ROWS, SEGMENT_ROWS, LEVELS = 1000, 500, 3


def changelog(events: DataFrame) -> DataFrame:
    """One write for each event: the newest state of a user is their last event; an error deletes it."""
    return events.select(
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", DELETE).otherwise(PUT).cast("int").alias("op"),
        F.format_string("user_%06d", "user_id").alias("key"),
        F.col("props").alias("value"),
        "ts",
    )


def read_changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog(spark.read.parquet(f"{sf_dir}/events.parquet"))


def segments(log: DataFrame) -> DataFrame:
    """The log cut into segments, lsn counting inside each."""
    return log.withColumns({"segment_id": F.floor(F.col("seq") / SEGMENT_ROWS), "lsn": F.col("seq") % SEGMENT_ROWS})


def run_data(log: DataFrame) -> DataFrame:
    """The log cut into runs: the newest version of a key in each."""
    return latest_wins(log.withColumn("run_id", F.floor(F.col("seq") / RUN_ROWS)), ("run_id", "key"))
