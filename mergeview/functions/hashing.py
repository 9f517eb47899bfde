"""MurmurHash3 (32 bit, x86) and double hashing as Spark expressions.

Spark's own hash() treats the last one to three bytes in another way, so it can't stand in.  All
arithmetic is on BIGINT kept below 2**32; a 32 x 32 bit product is made of two 16-bit halves, as ANSI
mode refuses to overflow.  with_pair() gives the same hashes of a whole column, a batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergeview.functions.text import let

#: Fixed values of MurmurHash3.
C1, C2, N, F1, F2 = 0xCC9E2D51, 0x1B873593, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35
MASK = 0xFFFFFFFF


def _mul(x: Column, c: int) -> Column:
    return (x * (c & 0xFFFF) + F.shiftleft((x * (c >> 16)).bitwiseAND(0xFFFF), 16)).bitwiseAND(MASK)


def _rotl(x: Column, r: int) -> Column:
    return let(x, lambda v: F.shiftleft(v, r).bitwiseAND(MASK).bitwiseOR(F.shiftright(v, 32 - r)))


def _byte(raw: Column, i: Column) -> Column:
    """Byte i, from 0, of a hexadecimal text."""
    return F.conv(F.substr(raw, i * 2 + 1, F.lit(2)), 16, 10).cast("long")


def _word(raw: Column, at: Column, n: int) -> Column:
    out = _byte(raw, at)
    for k in range(1, n):
        out = out.bitwiseOR(F.shiftleft(_byte(raw, at + k), 8 * k))
    return out


def _scrambled(k: Column) -> Column:
    return let(let(k, lambda x: _rotl(_mul(x, C1), 15)), lambda x: _mul(x, C2))


def _avalanche(h: Column) -> Column:
    def shifted(x: Column, r: int) -> Column:
        return let(x, lambda v: v.bitwiseXOR(F.shiftright(v, r)))

    h = let(shifted(h, 16), lambda x: _mul(x, F1))
    h = let(shifted(h, 13), lambda x: _mul(x, F2))
    return shifted(h, 16)


def murmur3_32(text: Column, seed: int = 0) -> Column:
    """MurmurHash3 of a text's UTF-8 bytes, 0 .. 2**32 - 1."""

    def of(raw: Column) -> Column:
        n = (F.length(raw) / 2).cast("long")
        words = F.floor(n / 4).cast("long")
        body = F.aggregate(
            F.when(words > 0, F.sequence(F.lit(0).cast("long"), words - 1)).otherwise(F.array().cast("array<bigint>")),
            F.lit(seed).cast("long"),
            lambda h, i: let(_rotl(h.bitwiseXOR(_scrambled(_word(raw, i * 4, 4))), 13), lambda x: (x * 5 + N).bitwiseAND(MASK)),
        )
        rest, at = n % 4, words * 4
        tail = F.when(rest == 1, _scrambled(_word(raw, at, 1))).when(rest == 2, _scrambled(_word(raw, at, 2))).when(rest == 3, _scrambled(_word(raw, at, 3))).otherwise(F.lit(0).cast("long"))
        return _avalanche(body.bitwiseXOR(tail).bitwiseXOR(n))

    return let(F.hex(text.cast("binary")), of)


def hash_probes(text: Column, k: int | Column, m: int | Column, seed1: int = 0, seed2: int = 42) -> Column:
    """Bit positions (h1 + i * h2) mod m for i below k."""
    k, m = (F.lit(x) if isinstance(x, int) else x for x in (k, m))
    pair = F.struct(murmur3_32(text, seed1).alias("a"), murmur3_32(text, seed2).alias("b"))
    return let(pair, lambda h: F.transform(F.sequence(F.lit(0), (k - 1).cast("int")), lambda i: (h["a"] + i * h["b"]) % m))


def with_pair(rows: DataFrame, seed1: int = 0, seed2: int = 42) -> DataFrame:
    """rows with _a and _b: MurmurHash3 of key with both seeds, null for a null key."""
    import numpy as np
    import pyarrow as pa

    names, at = rows.columns, rows.columns.index("key")
    c1, c2, n5, f1, f2 = (np.uint32(x) for x in (C1, C2, N, F1, F2))

    def rotl(x, r):
        return (x << np.uint32(r)) | (x >> np.uint32(32 - r))

    def hashes(data, offsets):
        start, n = offsets[:-1], np.diff(offsets)
        data = np.concatenate([data, np.zeros(4, np.uint8)])
        whole = n // 4
        h = [np.full(len(n), seed, np.uint32) for seed in (seed1, seed2)]

        def word(places, lengths):
            out = np.zeros(len(places), np.uint32)
            for i in range(4):
                out |= np.where(i < lengths, data[np.minimum(places + i, len(data) - 1)], 0).astype(np.uint32) << np.uint32(8 * i)
            return rotl(out * c1, 15) * c2

        order = np.argsort(-whole, kind="stable")  # the keys that still have a word come first
        left = np.searchsorted(-whole[order], -np.arange(1, whole.max(initial=0) + 1), "right")
        for i, some in enumerate(left.tolist()):
            rows_ = order[:some]
            k = word(start[rows_] + 4 * i, 4)
            for x in h:
                x[rows_] = rotl(x[rows_] ^ k, 13) * np.uint32(5) + n5
        tail = word(start + 4 * whole, n % 4)  # 0 where nothing is left
        out = []
        for x in h:
            x = x ^ tail ^ n.astype(np.uint32)
            x = (x ^ (x >> np.uint32(16))) * f1
            x = (x ^ (x >> np.uint32(13))) * f2
            out.append((x ^ (x >> np.uint32(16))).astype(np.int64))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(at)
            raw = key.fill_null("").cast(pa.large_binary())
            offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
            none = key.is_null().to_numpy(zero_copy_only=False)
            pair = [pa.array(x, pa.int64(), mask=none) for x in hashes(np.frombuffer(raw.buffers()[2] or b"", np.uint8), offsets)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *pair], [*names, "_a", "_b"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, _a long, _b long")
