"""Embedding near-dedup: vectors whose cosine is at least a threshold, by iterative quantisation.

A rotation of the principal directions is learnt so that the signs of the rotated, centred unit vectors
are balanced binary codes near the vectors.  Codes of several rotations are cut into keys; each key has
a Hamming table of its own, and vectors that agree in a key are compared by the cosine of the original
vectors in double precision.

How many bits a key has and how many tables there are is measured, not assumed.  Centring widens angles
where the vectors share a long mean, so pairs just at the threshold are made from the sample (whose
difference lies along other vectors, outside the mean, or in any direction), and tables are added until
RECALL of each kind of pair meet in one.  The bits are those of least estimated work for the number of
vectors, so keys grow with it and buckets don't.

Vectors of different lengths never link and have keys of their own.  A length of fewer than LEAST_FIT
vectors has too few to learn from and is one bucket.  Equal vectors are one class.  A bucket of more than
BLOCK vectors is split into blocks, and each pair of blocks is a task's work of its own, so no bucket is
collected as a whole and none is cut short.  A pair counts in the first table in which it meets.  Tasks
hand on counts and a forest of links, never all pairs.

The rotations are fitted on at most FIT_ROWS vectors of a length, those of smallest hash; every vector is
indexed.  Vectors that are null, zero, or hold null or non-finite components have no links and are kept.
Rows that share a vec_id count as one node and keep a row each.  Other columns are not looked at, whatever
their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergeview.llm.components import components
from mergeview.llm.tables import Saved

FIT_ROWS = 10_000
LEAST_FIT = 256
ITERATIONS = 30
RECALL = 0.975  # of made pairs at the threshold
PAIRS = 2_000  # made pairs of each kind
BLOCK = 4_096
MOST_BITS = 60
#: Microseconds for the estimate of work: a vector in a table, a component of it, a pair, a component of a pair, a bucket.
COSTS = (2.0, 0.01, 0.001, 0.0002, 500.0)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, without overflow or underflow on the way."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def rotation(projected: np.ndarray, rng) -> np.ndarray:
    """Iterative quantisation from a random start."""
    r, _ = np.linalg.qr(rng.normal(size=(projected.shape[1], projected.shape[1])))
    for _ in range(ITERATIONS):
        u, _, v = np.linalg.svd(projected.T @ np.where(projected @ r >= 0, 1.0, -1.0), full_matrices=False)
        r = u @ v
    return r


def made_pairs(x: np.ndarray, mean: np.ndarray, threshold: float, rng) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of unit vectors at the threshold, of three kinds, each begun from vectors of the sample."""
    u, w = (x[rng.integers(0, len(x), PAIRS)] for _ in range(2))
    apart = math.sqrt(max(0.0, 1 - threshold * threshold))

    def beside(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = d - (d * u).sum(axis=1, keepdims=True) * u
        return u, unit(threshold * u + apart * d / np.maximum(np.linalg.norm(d, axis=1, keepdims=True), 1e-300) + 1e-300)

    # the same part along the mean, the rest turned until the cosine is the threshold
    length = np.linalg.norm(mean)
    along = mean / max(length, 1e-300)
    flat = lambda z: z - (z @ along)[:, None] * along
    a, b = flat(u), flat(w)
    size = np.linalg.norm(a, axis=1, keepdims=True)
    a_unit = a / np.maximum(size, 1e-300)
    b = b - (b * a_unit).sum(axis=1, keepdims=True) * a_unit
    b_unit = b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
    turn = np.clip((threshold - (1 - size**2)) / np.maximum(size**2, 1e-300), -1, 1)
    turned = u - a + size * (turn * a_unit + np.sqrt(1 - turn**2) * b_unit)
    return [beside(w), beside(rng.normal(size=u.shape)), (u, unit(turned + 1e-300))]


def work(bits: int, tables: float, n: int, dims: int) -> float:
    per_vector, per_part, per_pair, per_pair_part, per_bucket = COSTS
    return tables * (n * (per_vector + per_part * dims) + n * n / 2**bits * (per_pair + per_pair_part * dims) + min(n, 2**bits) * per_bucket)


def fit(sample: np.ndarray, n: int, threshold: float, seed: int = 0) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """mean, a matrix whose columns' signs are the bits, and the bits of each table's key."""
    rng = np.random.default_rng(seed)
    x = unit(sample)
    mean = x.mean(axis=0)
    _, _, directions = np.linalg.svd(x - mean, full_matrices=False)
    projected = (x - mean) @ directions.T
    kinds = made_pairs(x, mean, threshold, rng)
    width = len(directions)
    bases: list[np.ndarray] = []
    same: list[np.ndarray] = []  # per rotation: kind, pair, bit

    def turn() -> None:
        bases.append(directions.T @ rotation(projected, rng))
        same.append(np.array([((u - mean) @ bases[-1] >= 0) == ((v - mean) @ bases[-1] >= 0) for u, v in kinds]))

    turn()
    agree = same[0].mean(axis=2)  # per kind and pair

    def estimate(bits: int) -> float:
        p = agree[:, :, None] ** bits  # the tables that the worst kind needs, at least one
        for tables in [1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512]:
            if (1 - (1 - p[:, :, 0]) ** tables).mean(axis=1).min() >= RECALL:
                return work(bits, tables, n, len(mean))
        return math.inf

    bits = min(range(1, min(MOST_BITS, width) + 1), key=lambda b: (estimate(b), b))
    if estimate(bits) > work(0, 1, n, len(mean)) or not math.isfinite(estimate(bits)):
        return mean, np.zeros((len(mean), 0)), [np.zeros(0, np.int64)]  # pairs at the threshold are too common for any key
    columns, met = [], np.zeros(agree.shape, bool)
    while met.mean(axis=1).min() < RECALL:
        r, c = divmod(len(columns), width // bits)
        if r == len(bases):
            turn()
        columns.append(r * width + np.arange(c * bits, (c + 1) * bits))
        met |= same[r][:, :, c * bits : (c + 1) * bits].all(axis=2)
    return mean, np.concatenate(bases[: r + 1], axis=1), columns


def keys_of(v: np.ndarray, model, only: int | None = None) -> np.ndarray:
    """A column of keys for each table; of the first `only` ones if given."""
    if model is None:
        return np.zeros((len(v), 1), np.int64)
    mean, bases, columns = model
    columns = columns[:only]
    signs = (v - mean) @ bases >= 0
    return np.column_stack([(signs[:, c].astype(np.int64) << np.arange(len(c))).sum(axis=1) for c in columns]) if columns else np.zeros((len(v), 0), np.int64)


def _matrices(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length in an Arrow list column: the vectors that have a direction, as doubles, and which rows they are."""
    import pyarrow as pa
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for dims in np.unique(lengths[lengths > 0]):
        right = np.flatnonzero(lengths == dims)
        flat = pc.list_flatten(column.take(pa.array(right))).cast(pa.float64())
        x = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dims)
        fine = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        if fine.any():
            yield x[fine], right[fine]


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for each row."""
    import pyarrow as pa

    spark = vectors.sparkSession
    saved = Saved(spark)
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"))

    # classes of equal vectors: the class id is a hash of the vector's bytes
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            cls, dims, raw = ([None] * len(batch) for _ in range(3))
            for x, at in _matrices(batch.column(1)):
                for i, own, v in zip(at, x, unit(x)):
                    cls[i], dims[i], raw[i] = int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True), x.shape[1], v.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cls, pa.int64()), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())], ["vec_id", "cls", "dims", "v"])

    units = saved.keep(rows.mapInArrow(read, "vec_id long, cls long, dims int, v binary"))
    classes = saved.keep(units.where("cls is not null").groupBy("cls").agg(F.first("dims").alias("dims"), F.first("v").alias("v"), F.count("*").alias("size"), F.min("vec_id").alias("least")))
    models = {}
    for r in classes.groupBy("dims").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_FIT).collect():  # a row for each common length
        some = classes.where(F.col("dims") == r["dims"]).select("v", F.xxhash64("cls").alias("h"), "cls").orderBy("h", "cls").limit(FIT_ROWS).select("v").toArrow()
        models[r["dims"]] = fit(np.frombuffer(b"".join(some["v"].to_pylist()), float).reshape(-1, r["dims"]), r["n"], threshold)
    sent = spark.sparkContext.broadcast(models)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for d in np.unique(dims):
                own = np.flatnonzero(dims == d)
                keys = keys_of(np.frombuffer(b"".join(batch.column("v").take(pa.array(own)).to_pylist()), float).reshape(-1, d), sent.value.get(int(d)))
                m, tables = keys.shape
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m * tables, d, np.int32)), pa.array(np.tile(np.arange(tables, dtype=np.int32), m)), pa.array(keys.ravel()), batch.column("cls").take(pa.array(np.repeat(own, tables)))], ["dims", "t", "k", "cls"])

    placed = saved.keep(classes.select("cls", "dims", "v").mapInArrow(deal, "dims int, t int, k long, cls long"))
    # buckets of one vector compare nothing; large ones are cut into blocks
    bucket = ["dims", "t", "k"]
    full = saved.keep(placed.groupBy(*bucket).agg(F.count("*").alias("m")).where("m > 1").select(*bucket, F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")))
    inside = placed.join(full, bucket).select(*bucket, "cls", "blocks", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int").alias("own"))
    parts = inside.select(*bucket, "cls", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    parts = saved.keep(parts.select(*bucket, "cls", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")))
    held = parts.join(classes.select("cls", "v", "size"), "cls")

    def meet(table: pa.Table) -> pa.Table:
        dims, t, i, j = (table[c][0].as_py() for c in ("dims", "t", "i", "j"))
        cls, own, size = (table[c].to_numpy() for c in ("cls", "own", "size"))
        v = np.frombuffer(b"".join(table["v"].to_pylist()), float).reshape(-1, dims)
        links, label = np.zeros(len(cls), np.int64), np.arange(len(cls))
        before, known = np.zeros((len(cls), t), np.int64), np.full(len(cls), t == 0)  # keys of earlier tables, of rows that have pairs
        a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
        right = np.ascontiguousarray(v[b].T)
        for start in range(0, len(a), 256):
            p = a[start : start + 256]
            x, y = np.nonzero(v[p] @ right >= threshold - 1e-9)
            x, y = p[x], b[y]
            if i == j:
                x, y = x[x < y], y[x < y]
            for at in range(0, len(x), 100_000):
                k, m = x[at : at + 100_000], y[at : at + 100_000]
                exact = np.einsum("ij,ij->i", v[k], v[m]) >= threshold
                k, m = k[exact], m[exact]
                if len(asked := np.union1d(k[~known[k]], m[~known[m]])):
                    before[asked], known[asked] = keys_of(v[asked], sent.value.get(dims), t), True
                fresh = np.ones(len(k), bool)
                for c in range(t):
                    fresh &= before[k, c] != before[m, c]
                np.add.at(links, k[fresh], size[m[fresh]])
                np.add.at(links, m[fresh], size[k[fresh]])
                while len(k):  # join the larger label to the smaller until all pairs agree
                    lk, lm = label[k], label[m]
                    if (lk == lm).all():
                        break
                    np.minimum.at(label, np.maximum(lk, lm), np.minimum(lk, lm))
                    while (label != (up := label[label])).any():
                        label = up
        keep = (links > 0) | (label != np.arange(len(cls)))
        return pa.table({"cls": cls[keep], "n": links[keep], "link": cls[label[keep]]})

    met = saved.keep(held.groupBy(*bucket, "i", "j").applyInArrow(meet, "cls long, n long, link long"))
    counts = met.groupBy("cls").agg(F.sum("n").alias("n"))
    joined = components(met.where("cls != link").select(F.col("cls").alias("a"), F.col("link").alias("b")), saved)
    named = saved.keep(classes.select("cls", "size", "least").join(joined.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls")))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    facts = saved.keep(named.join(least, "component").join(counts, "cls", "left").select("cls", "component_id", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links")))
    saved.drop(classes, placed, full, parts, met, named)
    linked = units.where("cls is not null").select("vec_id", "cls").join(facts, "cls").select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    alone = units.where("cls is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
