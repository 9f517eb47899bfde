"""Sorted runs as Parquet files: key ranges, page statistics and a Bloom filter do the skipping.

A store is a folder of run data, dealt by run, and a log of edits, a row for each run that was added or taken
out with its metadata.  A run's Bloom filter is sized by the runs' average number of keys, so that all filters
together grow with the rows; unsized ones would take 1 MB each, however small the run.  Which runs are live follows from the log, so a change is one append to it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeview.operators.compaction import merge_runs
from mergeview.schemas import ENTRY_HEADER, RUNS

DATA = "run_id BIGINT, seq BIGINT, op INT, key STRING, value STRING"
EDITS = f"version BIGINT, live BOOLEAN, {RUNS}"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def new_folder(spark: SparkSession) -> str:
    """A folder that all executors share, under spark.checkpoint.dir; on a single machine a temporary one where that is unset."""
    context = spark.sparkContext
    shared = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not shared and context.master.startswith("local"):
        shared = tempfile.mkdtemp(prefix="spark-")
    if not shared:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared}/runs-{uuid.uuid4().hex}"


def write_run(data: DataFrame, path: str, files: int | None = None) -> None:
    """Range-partitioned and sorted by key, so each file holds its own key range."""
    dealt = data.repartitionByRange(files, "key") if files else data.repartitionByRange("key")
    dealt.sortWithinPartitions("key").write.option("parquet.bloom.filter.enabled#key", "true").parquet(path)


def read_run(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Give the schema where it is known: nothing is read to find it.  A filter on key reaches the files' statistics."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def run_meta(data: DataFrame) -> DataFrame:
    """One row for each run of (run_id, seq, op, key, value, level)."""
    return data.groupBy("run_id").agg(
        F.first("level").alias("level"), F.count("*").alias("num_entries"), F.min("key").alias("min_key"), F.max("key").alias("max_key"),
        F.sum((F.octet_length("key") + F.octet_length("value") + ENTRY_HEADER).cast("long")).alias("file_size"),
        F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"),
    )


class RunStore:
    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_folder(spark)

    def edits(self) -> DataFrame:
        return self.spark.read.schema(EDITS).parquet(f"{self.path}/edits")

    def runs(self, version: int | None = None) -> DataFrame:
        """The table of live runs, now or as of a version."""
        upto = self.edits() if version is None else self.edits().where(F.col("version") <= version)
        meta = F.struct(*_names(RUNS)[1:], "live")
        return upto.groupBy("run_id").agg(F.max_by(meta, "version").alias("x")).select("run_id", "x.*").where("live").drop("live")

    def version(self) -> int:
        return self.edits().agg(F.max("version")).first()[0]

    def data(self) -> DataFrame:
        """All rows that were written, of runs that are live or not.  A filter on key or run_id is pushed down."""
        return self.spark.read.schema(DATA).parquet(f"{self.path}/data").select(*_names(DATA))

    def live_data(self) -> DataFrame:
        return self.data().join(self.runs().select("run_id"), "run_id", "left_semi")

    def _write(self, data: DataFrame, keys: int) -> None:
        """keys: of a run, about; it only sizes the Bloom filters."""
        dealt = data.select(*_names(DATA)).repartitionByRange("run_id", "key").sortWithinPartitions("run_id", "key")
        filters = {"parquet.bloom.filter.enabled#key": "true", "parquet.bloom.filter.expected.ndv#key": str(max(keys, 1))}
        dealt.write.mode("append").partitionBy("run_id").options(**filters).parquet(f"{self.path}/data")

    def _commit(self, edits: DataFrame) -> None:
        """One append, a single small file, which is seen as a whole or not at all."""
        edits.select(*_names(EDITS)).coalesce(1).write.mode("append").parquet(f"{self.path}/edits")

    def add(self, data: DataFrame, version: int = 0) -> None:
        """Write runs and make them live.  data: run_id, seq, op, key, value, level."""
        pending = f"{self.path}/pending-{uuid.uuid4().hex}"
        run_meta(data).write.parquet(pending)
        meta = self.spark.read.schema(RUNS).parquet(pending)
        self._write(data, int(meta.agg(F.avg("num_entries")).first()[0] or 0))
        self._commit(meta.withColumns({"version": F.lit(version).cast("long"), "live": F.lit(True)}))

    def compact(self, inputs: DataFrame, level: int, drop_deletes: bool = False, outputs: int = 1) -> None:
        """Merge the runs of these ids into new ones with key ranges of their own, and commit both changes as one version."""
        ids = inputs.select("run_id").distinct()
        before, version = self.runs(), self.version() + 1
        base = self.edits().agg(F.max("run_id")).first()[0] + 1
        entries = before.join(ids, "run_id", "left_semi").agg(F.sum("num_entries")).first()[0] or 0
        merged = merge_runs(self.data().join(ids, "run_id", "left_semi").drop("run_id"), drop_deletes)
        self._write(merged.repartitionByRange(outputs, "key").withColumn("run_id", F.spark_partition_id().cast("long") + base), entries // outputs)
        stamp = lambda df, live: df.withColumns({"version": F.lit(version).cast("long"), "live": F.lit(live)})
        made = run_meta(self.data().where(F.col("run_id") >= base).withColumn("level", F.lit(level)))
        self._commit(stamp(made, True).unionByName(stamp(before.join(ids, "run_id", "left_semi"), False)))

    def versions_of(self, keys: list[str]) -> DataFrame:
        """All live versions of a few keys: runs whose range holds none aren't opened, nor files and pages of the others."""
        inside = F.lit(False)
        for k in keys:
            inside = inside | F.lit(k).between(F.col("min_key"), F.col("max_key"))
        ids = [r["run_id"] for r in self.runs().where(inside).select("run_id").collect()]  # a number for each run that may hold one
        return self.data().where(F.col("run_id").isin(ids) & F.col("key").isin(keys))
