"""Schemas of the change log and of what is derived from it."""

from __future__ import annotations

PUT, DELETE = 1, 2

CHANGELOG = "seq BIGINT, op INT, key STRING, value STRING, ts TIMESTAMP_NTZ"
WAL = "segment_id BIGINT, lsn BIGINT, crc BIGINT, op INT, key STRING, value BINARY"
RUNS = "run_id BIGINT, level INT, num_entries BIGINT, min_key STRING, max_key STRING, file_size BIGINT, min_seq BIGINT, max_seq BIGINT"

#: Fixed sizes of the log's and the run files' framing, in bytes.
WAL_HEADER, ENTRY_HEADER, BLOCK_HEADER, BLOCK_LENGTH, INDEX_ENTRY, INDEX_HEADER, BLOOM_HEADER, FOOTER = 13, 8, 4, 4, 10, 4, 12, 24
ROW_OVERHEAD = 64  # of a write in a memtable's estimate
