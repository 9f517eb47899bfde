"""Segments of a write-ahead log: appending, checking, cutting at the first bad record, replay."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mergeview.functions.text import frame_crc, frame_payload, frame_size, le32
from mergeview.schemas import DELETE, PUT

HEADER = struct.Struct("<IIIB")  # checksum, key's and value's bytes, operation


def appended(rows: DataFrame) -> DataFrame:
    """Log records of writes: a delete has an empty value; each with its size and checksum."""
    value = F.when(F.col("op") == DELETE, F.lit("")).otherwise(F.col("value")).cast("binary")
    out = rows.withColumn("value", value)
    return out.withColumns({"crc": frame_crc(F.col("op"), F.col("key"), F.col("value")), "frame_size": frame_size(F.col("key"), F.col("value"))})


def valid_prefix(records: DataFrame) -> DataFrame:
    """Records of each segment before its first bad one; good ones after it don't count."""
    so_far = Window.partitionBy("segment_id").orderBy("lsn").rowsBetween(Window.unboundedPreceding, 0)
    return records.withColumn("_fine", F.bool_and("ok").over(so_far)).where("_fine").drop("_fine")


def bad_ops(records: DataFrame) -> DataFrame:
    """Records whose checksum holds but whose operation is unknown: to be set aside, not replayed."""
    return records.where(~F.col("op").isin(PUT, DELETE))


def truncated(records: DataFrame, flushed: DataFrame) -> DataFrame:
    """The log without segments that are flushed as a whole.  flushed: segment_id, flushed_lsn."""
    last = records.groupBy("segment_id").agg(F.max("lsn").alias("last"))
    gone = last.join(flushed, "segment_id").where("last <= flushed_lsn").select("segment_id")
    return records.join(gone, "segment_id", "left_anti")


def frames(data: bytes) -> Iterator[tuple[int, int, str, bytes]]:
    """lsn, op, key and value of the valid prefix of a segment's bytes: up to a short or damaged record."""
    at = lsn = 0
    while at + HEADER.size <= len(data):
        crc, k, v, op = HEADER.unpack_from(data, at)
        end = at + HEADER.size + k + v
        if end > len(data) or zlib.crc32(data[at + 4 : end]) != crc:
            return
        body = at + HEADER.size
        yield lsn, op, data[body : body + k].decode(), data[body + k : end]
        at, lsn = end, lsn + 1


def frame(op: int, key: str, value: bytes) -> bytes:
    k = key.encode()
    body = struct.pack("<IIB", len(k), len(value), op) + k + value
    return struct.pack("<I", zlib.crc32(body)) + body


def framed(rows: DataFrame) -> DataFrame:
    """segment_id and content: the bytes of each segment.  rows: what appended() gives; a segment is small by construction."""
    record = F.concat(le32(F.col("crc")), frame_payload(F.col("op"), F.col("key"), F.col("value")))
    held = rows.groupBy("segment_id").agg(F.array_sort(F.collect_list(F.struct("lsn", F.hex(record).alias("hex")))).alias("records"))
    return held.select("segment_id", F.unhex(F.array_join(F.col("records.hex"), "")).alias("content"))


def replayed(segments: DataFrame, name: str) -> DataFrame:
    """Records of the valid prefix of each segment.  segments: its name and content."""

    def read(batches):
        import pandas as pd

        for batch in batches:
            for segment, data in zip(batch[name], batch["content"]):
                yield pd.DataFrame([(segment, *r) for r in frames(bytes(data))], columns=[name, "lsn", "op", "key", "value"])

    return segments.select(name, "content").mapInPandas(read, f"{name} {segments.schema[name].dataType.simpleString()}, lsn long, op int, key string, value binary")


def replay(spark: SparkSession, path: str) -> DataFrame:
    """Records of the segment files under a path; a segment is small by construction, so one file is one row's work."""
    return replayed(spark.read.format("binaryFile").load(path), "path")
