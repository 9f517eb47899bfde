"""mergeview: versioned key-value data on Spark: change logs, merge-on-read, sorted runs, compaction."""
