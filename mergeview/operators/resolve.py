"""Newest version wins: resolution of a change log, and reads of the resolved state.

A filter on key may run before resolution; one on op or value must not, or older versions come back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mergeview.schemas import DELETE, PUT


def latest_wins(log: DataFrame, by: tuple[str, ...] = ("key",)) -> DataFrame:
    """The row of largest seq for each key; deletes included.  One shuffle on the key, with a partial limit before it."""
    newest = Window.partitionBy(*by).orderBy(F.desc("seq"))
    return log.withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").drop("_rn")


def visible(resolved: DataFrame) -> DataFrame:
    return resolved.where(F.col("op") == PUT)


def snapshot(log: DataFrame, seq: int) -> DataFrame:
    """The visible state as of a sequence number."""
    return visible(latest_wins(log.where(F.col("seq") <= seq)))


def tombstones(resolved: DataFrame) -> DataFrame:
    return resolved.where(F.col("op") == DELETE)


def three_state(resolved: DataFrame, probes: DataFrame) -> DataFrame:
    """For each probed key: ABSENT, DELETED or FOUND, and the value if found."""
    state = F.when(F.col("op").isNull(), "ABSENT").when(F.col("op") == DELETE, "DELETED").otherwise("FOUND")
    return probes.join(resolved.select("key", "op", "value"), "key", "left").select("key", state.alias("state"), F.when(F.col("op") == PUT, F.col("value")).alias("value"))


def physical_delete(state: DataFrame, keys: DataFrame) -> DataFrame:
    """The state without these keys."""
    return state.join(keys.select("key").distinct(), "key", "left_anti")


def range_scan(state: DataFrame, low: str, high: str) -> DataFrame:
    return state.where(F.col("key").between(low, high)).orderBy("key")
