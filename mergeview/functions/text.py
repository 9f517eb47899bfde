"""Column functions for keys, sizes and checksums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mergeview.schemas import ENTRY_HEADER, WAL_HEADER


def let(value: Column, use) -> Column:
    """use(value), with the value computed once; Spark has no other binding inside one expression."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shared_prefix(a: Column, b: Column) -> Column:
    """Characters that both texts begin with."""
    n = F.least(F.length(a), F.length(b))
    differs = F.array_position(F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1))), True)
    return F.when(n == 0, 0).when(differs == 0, n).otherwise(differs - 1).cast("int")


def le32(n: Column) -> Column:
    """A number as four bytes, least first."""
    pairs = F.regexp_extract_all(F.lpad(F.hex(n), 8, "0"), F.lit("(..)"), F.lit(1))
    return F.unhex(F.array_join(F.reverse(pairs), ""))


def frame_payload(op: Column, key: Column, value: Column) -> Column:
    """What the checksum of a log record covers: both lengths, the operation, key and value."""
    k = key.cast("binary")
    return F.concat(le32(F.octet_length(k)), le32(F.octet_length(value)), F.unhex(F.lpad(F.hex(op), 2, "0")), k, value)


def frame_crc(op: Column, key: Column, value: Column) -> Column:
    return F.crc32(frame_payload(op, key, value))


def frame_size(key: Column, value: Column) -> Column:
    return (F.octet_length(key) + F.octet_length(value) + WAL_HEADER).cast("long")


def entry_size(key: Column, value: Column, shared_bytes: Column | None = None) -> Column:
    """Bytes of a block entry whose key leaves out the shared ones."""
    suffix = F.octet_length(key) - (F.lit(0) if shared_bytes is None else shared_bytes)
    return (suffix + F.octet_length(value) + ENTRY_HEADER).cast("long")
