"""Tables in the folder that all executors share, to cut lineage and to survive lost executors."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


BATCH_LIMIT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4_000_000
KEPT_FREE = {"MALLOC_MMAP_THRESHOLD_": "8388608", "MALLOC_TRIM_THRESHOLD_": "16777216", "ARROW_DEFAULT_MEMORY_POOL": "system"}  # glibc's own limits grow to 32 and 64 MB


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; where none is set, as in tests, a temporary one is set."""
    context = spark.sparkContext
    if not (found := context.getCheckpointDir()):
        if conf := spark.conf.get("spark.checkpoint.dir", None):
            context.setCheckpointDir(conf)
        elif context.master.startswith("local[") or context.master == "local":
            context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = context.getCheckpointDir()
    return found


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it, unless it is installed or shipped already, and keep them small.

    Arrow batches hold about BATCH_BYTES at most instead of Spark's 64 MB, unless the session has a limit of its own, and
    workers hand freed memory back, as they outlive the step that they grew in.
    """
    here, env = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), spark.sparkContext.environment
    if here not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), here]))
    for name, value in KEPT_FREE.items():
        env.setdefault(name, value)
    if spark.conf.get(BATCH_LIMIT, None) is None:
        spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))


class Saved:
    """Tables of one run of an operator.  keep() writes a frame and reads it again; drop() removes its files."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.n = 0

    def keep(self, df: DataFrame, by: list[str] | None = None) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        writer = df.write.partitionBy(*by) if by else df.write
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if path := self.paths.pop(id(df), None):
                p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
