"""Greedy cuts of an ordered sequence: a group ends when its sizes reach a limit, and the next starts empty.

Such a fold is sequential within its sequence, so it runs for each segment or run by itself; many of them run
side by side.  Rows are dealt by sequence and sorted, and one pass numbers them batch by batch, carrying the
open group along, so no sequence is ever held as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def greedy_groups(rows: DataFrame, by: list[str], order: str, size: str, limit: int, out: str = "grp", first: str | None = None, start: int = 0, dealt: bool = False) -> DataFrame:
    """rows with the number of their group, from 0.  A group holds the row that reaches the limit.

    first: size of a row that begins a group, where it has another; start: size of an empty group.
    dealt: the rows are partitioned by `by` and sorted already.
    """
    import numpy as np
    import pyarrow as pa

    if not dealt:
        rows = rows.repartition(*by).sortWithinPartitions(*by, order)
    names = rows.columns
    by_at, size_at, first_at = [names.index(c) for c in by], names.index(size), names.index(first or size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total, group, is_open = None, 0, 0, False
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            sizes, firsts = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (size_at, first_at))
            upto = np.concatenate([[0], np.cumsum(sizes)])
            new = np.zeros(n + 1, bool)
            new[[0, -1]] = True
            for k in by_at:
                codes = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:n] |= codes[1:] != codes[:-1]
            groups, edges = np.empty(n, np.int64), np.flatnonzero(new).tolist()
            for i, end in zip(edges, edges[1:]):
                own = tuple(batch.column(k)[i].as_py() for k in by_at)
                if own != last:
                    last, group, is_open = own, 0, False
                while i < end:
                    if is_open:  # up to the row that reaches the limit
                        stop = min(i + int(np.searchsorted(upto[i + 1 : end + 1], limit - total + upto[i])) + 1, end)
                        total += upto[stop] - upto[i]
                    else:
                        stop, total, is_open = i + 1, start + firsts[i], True
                    groups[i:stop] = group
                    i = stop
                    if total >= limit:
                        group, is_open = group + 1, False
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(groups)], [*names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, `{out}` long")


def size_buckets(runs: DataFrame, low: float = 0.5, high: float = 1.5) -> DataFrame:
    """run_id, file_size and bucket: ascending sizes join a bucket while within low .. high of its average.  Run metadata only."""
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("b"), F.array().cast("array<struct<r:bigint,s:bigint,b:bigint>>").alias("out"))

    def step(state, x):
        joins = (state["n"] > 0) & (state["sum"] > 0) & (x["s"] * state["n"] >= F.lit(low) * state["sum"]) & (x["s"] * state["n"] <= F.lit(high) * state["sum"])
        bucket = F.when(joins, state["b"]).otherwise(state["b"] + 1)
        row = F.struct(x["r"].alias("r"), x["s"].alias("s"), bucket.alias("b"))
        return F.struct((F.when(joins, state["sum"]).otherwise(F.lit(0)) + x["s"]).cast("long").alias("sum"), (F.when(joins, state["n"]).otherwise(F.lit(0)) + 1).cast("long").alias("n"), bucket.alias("b"), F.concat(state["out"], F.array(row)).alias("out"))

    held = runs.agg(F.array_sort(F.collect_list(F.struct(F.col("file_size").cast("long").alias("s"), F.col("run_id").cast("long").alias("r")))).alias("rows"))
    folded = held.select(F.explode(F.aggregate("rows", start, step, lambda s: s["out"])).alias("x"))
    return folded.select(F.col("x.r").alias("run_id"), F.col("x.s").alias("file_size"), F.col("x.b").alias("bucket"))
