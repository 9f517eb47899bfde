"""Registry of the engine's queries and of the SQL that must give the same rows.

Each query derives its change log and segments from the given tables by expression, so that both sides start
from the same rows.  Runs are written once for each session and table folder, and read from their files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mergeview.functions import hashing
from mergeview.functions.hashing import hash_probes, murmur3_32
from mergeview.operators import blocks, bloom, compaction, folds, manifest, resolve
from mergeview.schemas import BLOCK_HEADER, BLOCK_LENGTH, BLOOM_HEADER, FOOTER, INDEX_ENTRY, INDEX_HEADER, ROW_OVERHEAD
from mergeview.sources import changelog as cl
from mergeview.sources import runs as run_files
from mergeview.sources import wal
from mergeview.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Common tables of the oracles.
CTES = {
    "log": "log AS (SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS op, printf('user_%06d', user_id) AS key, props AS value, ts FROM events)",
    "latest": "latest AS (SELECT seq, op, key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1)",
    "segs": "segs AS (SELECT *, seq // 500 AS segment_id, seq % 500 AS lsn FROM log)",
    "rundata": "rundata AS (SELECT seq // 1000 AS run_id, seq, op, key, value FROM (SELECT *, row_number() OVER (PARTITION BY seq // 1000, key ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1)",
    "runs": "runs AS (SELECT run_id, CAST(run_id % 3 AS INTEGER) AS level, count(*) AS num_entries, min(key) AS min_key, max(key) AS max_key, CAST(sum(strlen(key) + strlen(value) + 8) AS BIGINT) AS file_size, min(seq) AS min_seq, max(seq) AS max_seq FROM rundata GROUP BY run_id)",
    "levels": "levels AS (SELECT level, count(*) AS n_runs, CAST(sum(file_size) AS BIGINT) AS total_size, CASE WHEN level = 0 THEN 0 ELSE CAST(5000 * power(10, level - 1) AS BIGINT) END AS size_limit FROM runs GROUP BY level)",
    "probes": "probes AS (SELECT DISTINCT printf('user_%06d', c_custkey) AS key FROM customer)",
    "sold": "sold AS (SELECT DISTINCT printf('user_%06d', c_custkey) AS key FROM customer WHERE c_acctbal < 0)",
    "bulk": "bulk AS (SELECT printf('order_%010d', o_orderkey) AS key, o_orderstatus AS value, o_orderkey // 5000 AS run_id FROM orders)",
    "urls": "urls AS (SELECT url AS key, substr(url, 1, 20) AS grp FROM (SELECT DISTINCT url FROM pages WHERE url IS NOT NULL))",
}
NEEDS = {"latest": ["log"], "segs": ["log"], "rundata": ["log"], "runs": ["rundata"], "levels": ["runs"]}
LEVEL_BASE = 5_000  # bytes of level 1 here, so that small runs reach the limits
PACK_LIMIT, FLUSH_LIMIT, SPLIT_LIMIT = 512, 4096, 2000


def _with(names: list[str]) -> str:
    done: list[str] = []

    def add(name: str) -> None:
        for x in NEEDS.get(name, []):
            add(x)
        if name not in done:
            done.append(name)

    for name in names:
        add(name)
    return f"WITH {', '.join(CTES[n] for n in done)} " if done else ""


def query(name: str, ctes: str = "", sql: str | None = None):
    def take(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = _with(ctes.split()) + sql
        return f

    return take


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.read_changelog(spark, sf_dir)


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.latest_wins(_log(spark, sf_dir)).select("seq", "op", "key", "value")


def _segs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.segments(_log(spark, sf_dir))


_STORES: dict[tuple, run_files.RunStore | str] = {}


def _once(spark: SparkSession, sf_dir: str, kind: str, make):
    """What make() writes, once for each session, folder of tables and kind."""
    at = (spark.sparkContext.applicationId, sf_dir, kind)
    if at not in _STORES:
        _STORES[at] = make()
    return _STORES[at]


def _new_store(spark: SparkSession, sf_dir: str) -> run_files.RunStore:
    store = run_files.RunStore(spark)
    store.add(cl.run_data(_log(spark, sf_dir)).withColumn("level", (F.col("run_id") % cl.LEVELS).cast("int")))
    return store


def _store(spark: SparkSession, sf_dir: str) -> run_files.RunStore:
    """The log's runs, in levels that go round."""
    return _once(spark, sf_dir, "log", lambda: _new_store(spark, sf_dir))


def _rundata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).data()


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).runs()


def _probes(spark: SparkSession, sf_dir: str, some: str = "true") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").where(some).select(F.format_string("user_%06d", "c_custkey").alias("key")).distinct()


def _bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as one sorted run."""

    def make() -> str:
        path = run_files.new_folder(spark)
        o = spark.read.parquet(f"{sf_dir}/orders.parquet")
        rows = o.select(F.format_string("order_%010d", "o_orderkey").alias("key"), F.col("o_orderstatus").alias("value"), F.floor(F.col("o_orderkey") / 5000).alias("run_id"))
        run_files.write_run(rows, path)
        return path

    return run_files.read_run(spark, _once(spark, sf_dir, "bulk", make), "key string, value string, run_id bigint")


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").where("url is not null").select(F.col("url").alias("key")).distinct().withColumn("grp", F.substring("key", 1, 20))


# --- write-ahead log ---


@query("wal_segments", "segs", "SELECT segment_id, count(*) AS n, min(lsn) AS first_lsn, max(lsn) AS last_lsn FROM segs GROUP BY segment_id")
def _(spark, d):
    return _segs(spark, d).groupBy("segment_id").agg(F.count("*").alias("n"), F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn"))


@query("wal_entry_count", "segs", "SELECT segment_id, count(*) AS entry_count FROM segs GROUP BY segment_id")
def _(spark, d):
    return _segs(spark, d).groupBy("segment_id").agg(F.count("*").alias("entry_count"))


@query("wal_append", "segs", "SELECT segment_id, lsn, op, key, CASE WHEN op = 2 THEN '' ELSE value END AS payload FROM segs")
def _(spark, d):
    return wal.appended(_segs(spark, d)).select("segment_id", "lsn", "op", "key", F.col("value").cast("string").alias("payload"))


@query("wal_frame_size", "segs", "SELECT segment_id, CAST(sum(13 + strlen(key) + CASE WHEN op = 2 THEN 0 ELSE strlen(value) END) AS BIGINT) AS bytes FROM segs GROUP BY segment_id")
def _(spark, d):
    return wal.appended(_segs(spark, d)).groupBy("segment_id").agg(F.sum("frame_size").alias("bytes"))


_bytes_of = lambda x: f"list_transform(range(0, strlen({x})), lambda i: ('0x' || substr(hex(encode({x})), CAST(2 * i + 1 AS BIGINT), 2))::BIGINT)"
_le32 = lambda n: f"[{n} % 256, {n} // 256 % 256, {n} // 65536 % 256, {n} // 16777216]"


@query(
    "wal_crc", "segs",
    ", rec AS (SELECT segment_id, lsn, op, key, CASE WHEN op = 2 THEN '' ELSE value END AS v FROM segs), "
    f"b AS (SELECT segment_id, lsn, list_concat({_le32('strlen(key)')}, {_le32('strlen(v)')}, [op::BIGINT], {_bytes_of('key')}, {_bytes_of('v')})::BIGINT[] AS b FROM rec) "
    "SELECT segment_id, lsn, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y >> 1, 3988292384::BIGINT) ELSE y >> 1 END)), 4294967295::BIGINT) AS crc FROM b",
)
def _(spark, d):
    return wal.appended(_segs(spark, d)).select("segment_id", "lsn", "crc")


@query("wal_replay_binary", "segs", "SELECT segment_id, lsn, op, key, CASE WHEN op = 2 THEN '' ELSE value END AS payload FROM segs WHERE segment_id % 2 = 0 OR lsn < 100")
def _(spark, d):
    """Segments as bytes, read back.  Each ends in a torn record, and in every other one the first byte of record 100 is damaged."""
    rows = wal.appended(_segs(spark, d))
    damaged = rows.withColumn("crc", F.when((F.col("segment_id") % 2 == 1) & (F.col("lsn") == 100), F.col("crc").bitwiseXOR(F.lit(255))).otherwise(F.col("crc")))
    segments = wal.framed(damaged).withColumn("content", F.concat("content", F.unhex(F.lit("000102"))))
    return wal.replayed(segments, "segment_id").select("segment_id", "lsn", "op", "key", F.col("value").cast("string").alias("payload"))


@query("wal_truncate", "segs", "SELECT segment_id, lsn, key FROM segs WHERE segment_id % 3 <> 0")
def _(spark, d):
    records = _segs(spark, d)
    flushed = records.groupBy("segment_id").agg(F.max("lsn").alias("last")).select("segment_id", F.when(F.col("segment_id") % 3 == 0, F.col("last")).otherwise(F.col("last") - 1).alias("flushed_lsn"))
    return wal.truncated(records, flushed).select("segment_id", "lsn", "key")


_bad = "seq % 97 = 41"


@query("wal_valid_prefix", "segs", f"SELECT segment_id, lsn, op, key FROM (SELECT *, bool_and(NOT ({_bad})) OVER (PARTITION BY segment_id ORDER BY lsn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fine FROM segs) WHERE fine")
def _(spark, d):
    return wal.valid_prefix(_segs(spark, d).withColumn("ok", ~F.expr(_bad))).select("segment_id", "lsn", "op", "key")


@query("wal_bad_ops", "segs", "SELECT segment_id, lsn, CAST(CASE WHEN seq % 101 = 7 THEN 9 ELSE op END AS INTEGER) AS op FROM segs WHERE seq % 101 = 7")
def _(spark, d):
    return wal.bad_ops(_segs(spark, d).withColumn("op", F.when(F.col("seq") % 101 == 7, 9).otherwise(F.col("op")))).select("segment_id", "lsn", "op")


@query("crash_recovery", "segs", f"SELECT key, op, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM (SELECT *, bool_and(NOT ({_bad})) OVER (PARTITION BY segment_id ORDER BY lsn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fine FROM segs) WHERE fine) WHERE rn = 1")
def _(spark, d):
    return resolve.latest_wins(wal.valid_prefix(_segs(spark, d).withColumn("ok", ~F.expr(_bad)))).select("key", "op", "seq")


# --- memtable and ordered map ---


@query("current_state", "latest", "SELECT key, value, seq FROM latest WHERE op = 1")
def current_state(spark, d):
    return resolve.visible(_latest(spark, d)).select("key", "value", "seq")


@query("memtable_upsert", "latest", "SELECT key, op, value FROM latest")
def _(spark, d):
    return _latest(spark, d).select("key", "op", "value")


@query("memtable_delete", "log", "SELECT key, CAST(sum(CASE WHEN op = 2 THEN 1 ELSE 0 END) AS BIGINT) AS n_deletes, max(seq) AS last_seq FROM log GROUP BY key")
def _(spark, d):
    return _log(spark, d).groupBy("key").agg(F.sum(F.when(F.col("op") == 2, 1).otherwise(0)).alias("n_deletes"), F.max("seq").alias("last_seq"))


@query("get_three_state", "latest probes", "SELECT p.key AS key, CASE WHEN l.op IS NULL THEN 'ABSENT' WHEN l.op = 2 THEN 'DELETED' ELSE 'FOUND' END AS state, CASE WHEN l.op = 1 THEN l.value END AS value FROM probes p LEFT JOIN latest l ON p.key = l.key")
def _(spark, d):
    return resolve.three_state(_latest(spark, d), _probes(spark, d))


@query("memtable_scan", "latest", "SELECT key, op, seq FROM latest ORDER BY key")
def _(spark, d):
    return _latest(spark, d).select("key", "op", "seq").orderBy("key")


@query("memtable_count", "segs", "SELECT segment_id, count(DISTINCT key) AS n_keys FROM segs GROUP BY segment_id")
def _(spark, d):
    return _segs(spark, d).groupBy("segment_id").agg(F.countDistinct("key").alias("n_keys"))


_write = "length(key) + strlen(CASE WHEN op = 2 THEN '' ELSE value END) + 64"


def _write_sizes(rows: DataFrame) -> DataFrame:
    return rows.withColumn("size", (F.length("key") + F.when(F.col("op") == 2, 0).otherwise(F.octet_length("value")) + ROW_OVERHEAD).cast("long"))


@query("memtable_bytes", "segs", f"SELECT segment_id, lsn, CAST(sum({_write}) OVER (PARTITION BY segment_id ORDER BY lsn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS bytes FROM segs")
def _(spark, d):
    upto = Window.partitionBy("segment_id").orderBy("lsn").rowsBetween(Window.unboundedPreceding, 0)
    return _write_sizes(_segs(spark, d)).select("segment_id", "lsn", F.sum("size").over(upto).alias("bytes"))


@query("flush_due", "segs", f"SELECT segment_id, min(lsn) AS due_at FROM (SELECT segment_id, lsn, sum({_write}) OVER (PARTITION BY segment_id ORDER BY lsn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bytes FROM segs) WHERE bytes >= {FLUSH_LIMIT} GROUP BY segment_id")
def _(spark, d):
    return QUERIES["memtable_bytes"](spark, d).where(F.col("bytes") >= FLUSH_LIMIT).groupBy("segment_id").agg(F.min("lsn").alias("due_at"))


def _fold_sql(source: str, by: str, order: str, size: str, limit: int, group: str, columns: str, first: str | None = None, start: int = 0) -> str:
    """The greedy fold as a recursion over row numbers, beginning anew in each sequence.  c: what a row adds to its group."""
    full = f"f.acc >= {limit}"
    return (
        f", numbered AS (SELECT {by} AS b, {order} AS o, CAST({size} AS BIGINT) AS s, CAST({first or size} AS BIGINT) AS first, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS rn FROM {source}), "
        f"fold AS (SELECT b, o, first AS c, rn, 0::BIGINT AS g, {start} + first AS acc FROM numbered WHERE rn = 1 "
        f"UNION ALL SELECT n.b, n.o, CASE WHEN {full} THEN n.first ELSE n.s END, n.rn, CASE WHEN {full} THEN f.g + 1 ELSE f.g END, CASE WHEN {full} THEN {start} + n.first ELSE f.acc + n.s END FROM fold f JOIN numbered n ON n.b = f.b AND n.rn = f.rn + 1) "
        f"SELECT b AS {by}, g AS {group}, {columns} FROM fold GROUP BY b, g"
    )


def _recursive(name: str, ctes: str, sql: str) -> None:
    ORACLES[name] = ("WITH RECURSIVE " + _with(ctes.split()).removeprefix("WITH ").rstrip()) + sql


@query("flush_generations")
def _(spark, d):
    g = folds.greedy_groups(_write_sizes(_segs(spark, d)).select("segment_id", "lsn", "size"), ["segment_id"], "lsn", "size", FLUSH_LIMIT, "generation")
    return g.groupBy("segment_id", "generation").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


_recursive("flush_generations", "segs", _fold_sql("segs", "segment_id", "lsn", _write, FLUSH_LIMIT, "generation", "count(*) AS n, CAST(sum(c) AS BIGINT) AS bytes"))


@query("streaming_flush", "latest", "SELECT key, value, seq FROM latest WHERE op = 1")
def _(spark, d):
    """The events as a stream, each micro-batch flushed as a run, and the state that the runs amount to."""
    events, base = f"{d}/events.parquet", run_files.new_folder(spark)
    files = spark.readStream.schema(spark.read.parquet(events).schema).option("pathGlobFilter", "events.parquet").parquet(d)
    stream = cl.changelog(files)
    ingest.start_ingest(stream, f"{base}/runs", f"{base}/checkpoint").awaitTermination()
    return ingest.state(spark, f"{base}/runs").select("key", "value", "seq")


@query("tombstones", "latest", "SELECT key, seq FROM latest WHERE op = 2")
def _(spark, d):
    return resolve.tombstones(_latest(spark, d)).select("key", "seq")


@query("map_size", "latest", "SELECT count(*) AS size FROM latest")
def _(spark, d):
    return _latest(spark, d).agg(F.count("*").alias("size"))


@query("point_get", "latest", "SELECT key, value FROM latest WHERE op = 1 AND key = 'user_000007'")
def _(spark, d):
    return resolve.visible(resolve.latest_wins(_store(spark, d).versions_of(["user_000007"]))).select("key", "value")


@query("contains", "latest probes", "SELECT key FROM probes WHERE key IN (SELECT key FROM latest WHERE op = 1)")
def _(spark, d):
    return _probes(spark, d).join(resolve.visible(_latest(spark, d)), "key", "left_semi")


@query("ordered_scan", "latest", "SELECT key, value FROM latest WHERE op = 1 ORDER BY key")
def _(spark, d):
    return resolve.visible(_latest(spark, d)).select("key", "value").orderBy("key")


@query("map_put", "log", "SELECT key, max_by(value, seq) AS value, count(*) AS n_writes FROM log WHERE op = 1 GROUP BY key")
def _(spark, d):
    return _log(spark, d).where("op = 1").groupBy("key").agg(F.max_by("value", "seq").alias("value"), F.count("*").alias("n_writes"))


@query("physical_delete", "latest sold", "SELECT key, value FROM latest WHERE key NOT IN (SELECT key FROM sold)")
def _(spark, d):
    """Without the keys of customers who owe."""
    return resolve.physical_delete(_latest(spark, d), _probes(spark, d, "c_acctbal < 0")).select("key", "value")


@query("min_max_key", "latest", "SELECT min(key) AS min_key, max(key) AS max_key FROM latest")
def _(spark, d):
    return _latest(spark, d).agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"))


# --- blocks ---

_prefix_sql = "CASE WHEN prev IS NULL THEN 0 ELSE len(list_filter(range(1, least(length(key), length(prev)) + 1), lambda i: substr(key, 1, CAST(i AS BIGINT)) = substr(prev, 1, CAST(i AS BIGINT)))) END"


@query("shared_prefix", "urls", f"SELECT key, CAST({_prefix_sql} AS INTEGER) AS shared FROM (SELECT *, lag(key) OVER (PARTITION BY grp ORDER BY key) AS prev FROM urls)")
def _(spark, d):
    return blocks.with_shared(_urls(spark, d), ["grp"]).select("key", "shared")


@query("prefix_compression_ratio", "urls", f"SELECT CAST(sum(length(key)) AS BIGINT) AS chars, CAST(sum({_prefix_sql}) AS BIGINT) AS shared FROM (SELECT *, lag(key) OVER (PARTITION BY grp ORDER BY key) AS prev FROM urls)")
def _(spark, d):
    return blocks.with_shared(_urls(spark, d), ["grp"]).agg(F.sum(F.length("key")).cast("long").alias("chars"), F.sum("shared").cast("long").alias("shared"))


@query("prefix_roundtrip", "urls", "SELECT grp, key FROM urls")
def _(spark, d):
    coded = blocks.with_shared(_urls(spark, d), ["grp"]).select("grp", F.row_number().over(Window.partitionBy("grp").orderBy("key")).alias("rn"), "shared", F.expr("substring(key, shared + 1)").alias("suffix"))
    return blocks.decoded(coded, ["grp"]).select("grp", "key")


def _blocks(spark, d):
    return blocks.packed(_rundata(spark, d), ["run_id"], PACK_LIMIT)


_entry = "strlen(key) + strlen(value) + 8"
_shared = f", before AS (SELECT *, lag(key) OVER (PARTITION BY run_id ORDER BY key) AS prev FROM rundata), cut AS (SELECT *, strlen(substr(key, 1 + CAST({_prefix_sql} AS BIGINT))) + strlen(value) + 8 AS delta FROM before)"


def _block_sql(columns: str) -> str:
    return _shared + _fold_sql("cut", "run_id", "key", "delta", PACK_LIMIT, "block_id", columns, first=_entry, start=BLOCK_HEADER)


@query("block_pack")
def _(spark, d):
    """A block's first entry holds its whole key, the others what they don't share with the one before."""
    return blocks.block_stats(_blocks(spark, d), ["run_id"]).select("run_id", "block_id", "n", (F.col("size") - BLOCK_HEADER).alias("bytes"))


_recursive("block_pack", "rundata", _block_sql("count(*) AS n, CAST(sum(c) AS BIGINT) AS bytes"))


@query("block_stats")
def _(spark, d):
    return blocks.block_stats(_blocks(spark, d), ["run_id"]).select("run_id", "block_id", "n", "first_key", "last_key", "size", (F.col("size") >= PACK_LIMIT).alias("is_full"))


_recursive("block_stats", "rundata", _block_sql(f"count(*) AS n, min(o) AS first_key, max(o) AS last_key, CAST(sum(c) + {BLOCK_HEADER} AS BIGINT) AS size, sum(c) + {BLOCK_HEADER} >= {PACK_LIMIT} AS is_full"))


@query("sparse_index")
def _(spark, d):
    return blocks.sparse_index(_blocks(spark, d), ["run_id"]).select("run_id", "block_id", "first_key", "n", "size", "offset")


_each_block = ", each AS (" + _block_sql(f"count(*) AS n, min(o) AS first_key, CAST(sum(c) + {BLOCK_HEADER} AS BIGINT) AS size").replace(", before AS", "WITH RECURSIVE before AS", 1) + ")"
_recursive("sparse_index", "rundata", f"{_each_block} SELECT run_id, block_id, first_key, n, size, CAST(coalesce(sum(size + {BLOCK_LENGTH}) OVER (PARTITION BY run_id ORDER BY block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM each")


@query("run_file_size")
def _(spark, d):
    """Blocks, then the index, the filter and the footer."""
    return blocks.file_sizes(blocks.sparse_index(_blocks(spark, d), ["run_id"]), ["run_id"]).select("run_id", "blocks", "index_offset", "bloom_offset", "file_size")


_recursive(
    "run_file_size", "rundata",
    f"{_each_block}, sums AS (SELECT run_id, count(*) AS blocks, CAST(sum(size + {BLOCK_LENGTH}) AS BIGINT) AS index_offset, CAST(sum(strlen(first_key) + {INDEX_ENTRY}) + {INDEX_HEADER} AS BIGINT) AS index_size, CAST(sum(n) AS BIGINT) AS n FROM each GROUP BY run_id) "
    f"SELECT run_id, blocks, index_offset, index_offset + index_size AS bloom_offset, CAST(index_offset + index_size + {BLOOM_HEADER} + (greatest(64, n * 10) + 7) // 8 + {FOOTER} AS BIGINT) AS file_size FROM sums",
)


@query("block_find", "rundata", "SELECT run_id, key, seq, op FROM rundata WHERE key = 'user_000011'")
def _(spark, d):
    """In each run the one block that may hold the key."""
    packed = _blocks(spark, d)
    probes = _runs(spark, d).select("run_id", F.lit("user_000011").alias("key"))
    return blocks.find(packed, blocks.sparse_index(packed, ["run_id"]), probes, ["run_id"]).select("run_id", "key", "seq", "op")


# --- runs ---


@query("run_flush", "rundata", "SELECT run_id, key, op, seq FROM rundata ORDER BY run_id, key")
def _(spark, d):
    return _rundata(spark, d).select("run_id", "key", "op", "seq").orderBy("run_id", "key")


@query("run_meta", "runs", "SELECT * FROM runs")
def _(spark, d):
    return _runs(spark, d)


@query("run_overlaps", "runs", "SELECT a.run_id AS a, b.run_id AS b FROM runs a JOIN runs b ON a.run_id < b.run_id AND a.min_key <= b.max_key AND b.min_key <= a.max_key")
def _(spark, d):
    a, b = _runs(spark, d).alias("a"), _runs(spark, d).alias("b")
    return a.join(b, F.expr("a.run_id < b.run_id and a.min_key <= b.max_key and b.min_key <= a.max_key")).select(F.col("a.run_id").alias("a"), F.col("b.run_id").alias("b"))


@query("run_read", "bulk", "SELECT run_id, count(*) AS n, min(key) AS min_key FROM bulk GROUP BY run_id")
def _(spark, d):
    return _bulk(spark, d).groupBy("run_id").agg(F.count("*").alias("n"), F.min("key").alias("min_key"))


@query("run_get", "bulk", "SELECT key, value FROM bulk WHERE key IN ('order_0000000001', 'order_0000000777', 'order_9999999999')")
def _(spark, d):
    return _bulk(spark, d).where(F.col("key").isin("order_0000000001", "order_0000000777", "order_9999999999")).select("key", "value")


@query("run_scan", "bulk", "SELECT key, value FROM bulk ORDER BY key")
def _(spark, d):
    return _bulk(spark, d).select("key", "value").orderBy("key")


@query("range_scan", "bulk", "SELECT key, value FROM bulk WHERE key BETWEEN 'order_0000000100' AND 'order_0000000200' ORDER BY key")
def _(spark, d):
    return resolve.range_scan(_bulk(spark, d).select("key", "value"), "order_0000000100", "order_0000000200")


@query("floor_block", "bulk", "SELECT p.run_id AS run_id, p.key AS key, max(i.block_id) AS block_id FROM (SELECT run_id, key || 'x' AS key FROM bulk WHERE value = 'F') p LEFT JOIN (SELECT run_id, block_id, min(key) AS first_key FROM (SELECT run_id, key, (row_number() OVER (PARTITION BY run_id ORDER BY key) - 1) // 100 AS block_id FROM bulk) GROUP BY run_id, block_id) i ON p.run_id = i.run_id AND i.first_key <= p.key GROUP BY p.run_id, p.key")
def _(spark, d):
    bulk = _bulk(spark, d)
    index = bulk.withColumn("block_id", F.floor((F.row_number().over(Window.partitionBy("run_id").orderBy("key")) - 1) / 100)).groupBy("run_id", "block_id").agg(F.min("key").alias("first_key"))
    probes = bulk.where("value = 'F'").select("run_id", F.concat("key", F.lit("x")).alias("key"))
    return blocks.floor_block(index, probes, ["run_id"]).select("run_id", "key", "block_id")


# --- Bloom filters and hashing ---


@query("bloom_sizing", "", "SELECT CAST(c_custkey AS BIGINT) AS n, CAST(greatest(64, c_custkey * 10) AS BIGINT) AS m, CAST(greatest(1, round_even(greatest(64, c_custkey * 10)::DOUBLE / greatest(c_custkey, 1) * 0.6931471805599453, 0)) AS INTEGER) AS k FROM customer")
def _(spark, d):
    n = F.col("c_custkey")
    m = bloom.num_bits(n)
    return spark.read.parquet(f"{d}/customer.parquet").select(n.alias("n"), m.alias("m"), bloom.num_hashes(n, m).alias("k"))


@query("bloom_from_fpr", "", "SELECT c_custkey AS i, round(-ln(1.0 / (c_custkey + 2)::DOUBLE) / power(0.6931471805599453, 2), 9) AS bits_per_key FROM customer")
def _(spark, d):
    return spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("i"), F.round(bloom.bits_per_key(1.0 / (F.col("c_custkey") + 2)), 9).alias("bits_per_key"))


_sizes = "SELECT run_id, count(*) AS n, CAST(greatest(64, count(*) * 10) AS BIGINT) AS m, CAST(greatest(1, round_even(greatest(64, count(*) * 10)::DOUBLE / count(*) * 0.6931471805599453, 0)) AS INTEGER) AS k FROM rundata GROUP BY run_id"


@query("bloom_stats", "rundata", _sizes)
def _(spark, d):
    return bloom.sizes(_rundata(spark, d), ["run_id"])


@query("bloom_theoretical_fpr", "rundata", f"SELECT run_id, round(power(1 - exp(-k::DOUBLE * n / m), k), 12) AS rate FROM ({_sizes})")
def _(spark, d):
    return QUERIES["bloom_stats"](spark, d).select("run_id", F.round(bloom.theoretical_rate(F.col("n"), F.col("m"), F.col("k").cast("double")), 12).alias("rate"))


def _murmur_sql(source: str) -> str:
    """Tables that end in hashed(key, a, b): MurmurHash3 of source's keys with seeds 0 and 42."""
    mul = lambda x, c: f"CAST((CAST({x} AS HUGEINT) * {c}) % 4294967296 AS BIGINT)"
    rotl = lambda x, r: f"((({x}) << {r}) % 4294967296 | (({x}) >> {32 - r}))"
    each = lambda name, of, f: f"{name} AS (SELECT key, n, list_transform(w, lambda k: {f}) AS w FROM {of}), "
    body = lambda seed: f"list_reduce(list_prepend({seed}::BIGINT, w[1:n // 4]), lambda h, k: (({rotl('xor(h, k)', 13)}) * 5 + {hashing.N}) % 4294967296)"
    both = lambda f: ", ".join(f"{f(x)} AS {x}" for x in "ab")
    mixed = lambda name, of, f: f"{name} AS (SELECT key, {both(f)} FROM {of}), "
    return (
        f"kb AS (SELECT key, strlen(key) AS n, list_transform(range(0, strlen(key)), lambda i: ('0x' || substr(hex(encode(key)), CAST(2 * i + 1 AS BIGINT), 2))::BIGINT) AS b FROM (SELECT DISTINCT key FROM {source})), "
        "kw AS (SELECT key, n, list_append(list_transform(range(0, n // 4), lambda i: b[4 * i + 1] + b[4 * i + 2] * 256 + b[4 * i + 3] * 65536 + b[4 * i + 4] * 16777216), "
        "CAST(coalesce(b[n - n % 4 + 1], 0) + coalesce(b[n - n % 4 + 2], 0) * 256 + coalesce(b[n - n % 4 + 3], 0) * 65536 AS BIGINT)) AS w FROM kb), "
        + each("k1", "kw", mul("k", hashing.C1)) + each("k2", "k1", rotl("k", 15)) + each("k3", "k2", mul("k", hashing.C2))
        + f"h0 AS (SELECT key, xor(xor({body(0)}, w[n // 4 + 1]), n) AS a, xor(xor({body(42)}, w[n // 4 + 1]), n) AS b FROM k3), "
        + mixed("h1", "h0", lambda x: f"xor({x}, {x} >> 16)") + mixed("h2", "h1", lambda x: mul(x, hashing.F1)) + mixed("h3", "h2", lambda x: f"xor({x}, {x} >> 13)") + mixed("h4", "h3", lambda x: mul(x, hashing.F2))
        + f"hashed AS (SELECT key, {both(lambda x: f'xor({x}, {x} >> 16)')} FROM h4) "
    )


def _hashed(ctes: str, source: str) -> str:
    return f"{_with(ctes.split()).rstrip()}, " + _murmur_sql(source)


_probe_list = lambda k, m: f"list_transform(range(0, {k}), lambda i: (a + i * b) % {m})"


@query("murmur3")
def _(spark, d):
    return _latest(spark, d).select("key", murmur3_32(F.col("key")).alias("h0"), murmur3_32(F.col("key"), 42).alias("h42"))


ORACLES["murmur3"] = _hashed("latest", "latest") + "SELECT key, a AS h0, b AS h42 FROM hashed"


@query("hash_probes")
def _(spark, d):
    return _latest(spark, d).select("key", F.array_join(hash_probes(F.col("key"), 7, 128).cast("array<string>"), ",").alias("probes"))


ORACLES["hash_probes"] = _hashed("latest", "latest") + f"SELECT key, array_to_string({_probe_list(7, 128)}, ',') AS probes FROM hashed"
_run_bits = f", sizes AS ({_sizes}), bits AS (SELECT DISTINCT run_id, unnest(list_transform(range(0, k), lambda i: (a + i * b) % m)) AS bit FROM rundata JOIN hashed USING (key) JOIN sizes USING (run_id))"


def _sized(spark, d, rows: DataFrame) -> DataFrame:
    """rows of runs with m and k, from the table of runs, which is small."""
    return rows.join(F.broadcast(bloom.with_sizes(_runs(spark, d).select("run_id", F.col("num_entries").alias("n")))), "run_id")


def _filters(spark, d, word: int = bloom.WORD) -> DataFrame:
    return bloom.words(_sized(spark, d, _rundata(spark, d)), F.col("m"), F.col("k"), ["run_id"], word)


@query("bloom_build")
def _(spark, d):
    """The filter of each run, as large as its number of keys asks for, as words of 32 bits."""
    return _filters(spark, d)


ORACLES["bloom_build"] = _hashed("rundata", "rundata") + _run_bits + " SELECT run_id, bit // 32 AS word, bit_or(1::BIGINT << (bit % 32)) AS mask FROM bits GROUP BY ALL"


@query("bloom_probe")
def _(spark, d):
    """What the filter of all keys says to each probe, wrong yeses included."""
    keys = _latest(spark, d)
    size = bloom.sizes(keys, []).first()
    return bloom.probe(bloom.words(keys, size["m"], size["k"]), _probes(spark, d), size["m"], size["k"])


_asked = "SELECT key FROM latest UNION SELECT key FROM probes"
ORACLES["bloom_probe"] = (
    _hashed("latest probes", f"({_asked})") + ", size AS (SELECT greatest(64, count(*) * 10) AS m, CAST(greatest(1, round_even(greatest(64, count(*) * 10)::DOUBLE / greatest(count(*), 1) * 0.6931471805599453, 0)) AS BIGINT) AS k FROM latest), "
    "each AS (SELECT key, unnest(list_transform(range(0, k), lambda i: (a + i * b) % m)) AS bit FROM hashed, size), bits AS (SELECT DISTINCT bit FROM each WHERE key IN (SELECT key FROM latest)) "
    "SELECT key, bool_and(bit IN (SELECT bit FROM bits)) AS maybe FROM each WHERE key IN (SELECT key FROM probes) GROUP BY key"
)


@query("run_bloom_probe")
def _(spark, d):
    """What the filters say of each probe in the runs whose key range it lies in."""
    runs = bloom.with_sizes(_runs(spark, d).withColumnRenamed("num_entries", "n")).select("run_id", "min_key", "max_key", "m", "k")
    return bloom.probe_ranges(_filters(spark, d, bloom.LONG), runs, _probes(spark, d), run_files.new_folder(spark))


ORACLES["run_bloom_probe"] = (
    _hashed("runs probes", "(SELECT key FROM rundata UNION SELECT key FROM probes)") + _run_bits
    + ", asked AS (SELECT r.run_id, p.key, unnest(list_transform(range(0, k), lambda i: (a + i * b) % m)) AS bit FROM probes p JOIN runs r ON r.min_key <= p.key AND p.key <= r.max_key JOIN sizes s ON s.run_id = r.run_id JOIN hashed h ON h.key = p.key) "
    "SELECT a.run_id AS run_id, a.key AS key, bool_and(b.bit IS NOT NULL) AS maybe FROM asked a LEFT JOIN bits b ON a.run_id = b.run_id AND a.bit = b.bit GROUP BY a.run_id, a.key"
)


@query("bloom_roundtrip")
def _(spark, d):
    """Filters as bytes in files and back: how large, how many bits are set, and whether every member is still found."""
    data, sizes, path = _rundata(spark, d), bloom.sizes(_rundata(spark, d), ["run_id"]), run_files.new_folder(spark)
    made = bloom.stored(_filters(spark, d), sizes, ["run_id"])
    made.write.parquet(path)  # read twice below
    stored = spark.read.schema(made.schema).parquet(path)
    back = bloom.loaded(stored, ["run_id"])
    found = bloom.probe(back, _sized(spark, d, data.select("run_id", "key")).select("run_id", "key", "m", "k"), F.col("m"), F.col("k"), ["run_id"])
    found = found.groupBy("run_id").agg(F.count("*").alias("members"), F.count_if("maybe").alias("found"))
    bits = back.groupBy("run_id").agg(F.sum(F.bit_count("mask")).alias("bits_set"))
    return stored.select("run_id", F.length("bytes").cast("long").alias("bytes")).join(found, "run_id").join(bits, "run_id")


ORACLES["bloom_roundtrip"] = _hashed("rundata", "rundata") + _run_bits + " SELECT run_id, (m + 31) // 32 * 4 AS bytes, n AS members, n AS found, (SELECT count(*) FROM bits b WHERE b.run_id = s.run_id) AS bits_set FROM sizes s"


@query("bloom_empirical_fpr")
def _(spark, d):
    members = spark.range(100_000).select(F.format_string("member_%d", "id").alias("key"))
    others = spark.range(50_000).select(F.format_string("nonmember_%d", "id").alias("key"))
    words = bloom.words(members, 1_000_000, 7)
    hits = bloom.probe(words, others, 1_000_000, 7).agg(F.count("*").alias("trials"), F.count_if("maybe").alias("false_positives"))
    return words.agg(F.sum(F.bit_count("mask")).alias("bits_set")).join(F.broadcast(hits))  # one row each


ORACLES["bloom_empirical_fpr"] = (
    "WITH words AS (SELECT printf('member_%d', i) AS key FROM range(0, 100000) t(i) UNION ALL SELECT printf('nonmember_%d', i) FROM range(0, 50000) t(i)), " + _murmur_sql("words")
    + f", bits AS (SELECT DISTINCT unnest({_probe_list(7, 1_000_000)}) AS bit FROM hashed WHERE key LIKE 'member%'), asked AS (SELECT key, unnest({_probe_list(7, 1_000_000)}) AS bit FROM hashed WHERE key LIKE 'nonmember%'), "
    "hits AS (SELECT a.key, bool_and(b.bit IS NOT NULL) AS maybe FROM asked a LEFT JOIN bits b ON a.bit = b.bit GROUP BY a.key) "
    "SELECT (SELECT count(*) FROM bits) AS bits_set, count(*) AS trials, CAST(sum(CASE WHEN maybe THEN 1 ELSE 0 END) AS BIGINT) AS false_positives FROM hits"
)


# --- manifest ---


@query("level_stats", "levels", "SELECT level, n_runs, total_size FROM levels")
def _(spark, d):
    return manifest.level_stats(_runs(spark, d))


@query("levels_over_limit", "levels", "SELECT level, total_size, size_limit FROM levels WHERE size_limit > 0 AND total_size > size_limit")
def _(spark, d):
    return manifest.triggers(_runs(spark, d), LEVEL_BASE).where("size_limit > 0 and total_size > size_limit").select("level", "total_size", "size_limit")


@query("runs_for_range", "runs", "SELECT run_id FROM runs WHERE min_key <= 'user_000020' AND max_key >= 'user_000010'")
def _(spark, d):
    return manifest.overlapping(_runs(spark, d), F.lit("user_000010"), F.lit("user_000020")).select("run_id")


@query("level_limits", "", "SELECT CAST(i AS INTEGER) AS level, CASE WHEN i = 0 THEN 0 ELSE CAST(10485760 * power(10, i - 1) AS BIGINT) END AS size_limit FROM range(0, 7) t(i)")
def _(spark, d):
    return spark.range(7).select(F.col("id").cast("int").alias("level")).withColumn("size_limit", manifest.level_limit(F.col("level")))


@query("live_runs", "runs", "SELECT run_id, level, min_key, max_seq FROM runs ORDER BY max_seq DESC")
def _(spark, d):
    return _runs(spark, d).select("run_id", "level", "min_key", "max_seq").orderBy(F.desc("max_seq"))


@query("manifest_history", "runs", "SELECT a.run_id AS version, b.run_id AS run_id FROM runs a JOIN runs b ON b.run_id <= a.run_id AND NOT (b.run_id % 2 = 0 AND b.run_id < a.run_id - 1)")
def _(spark, d):
    """Version v holds the runs added up to v, less the even ones that a later version took out."""
    ids = _runs(spark, d).select("run_id")
    added = ids.select(F.col("run_id").alias("version")).join(ids, F.expr("run_id <= version"))
    removed = ids.select(F.col("run_id").alias("version")).join(ids.where("run_id % 2 = 0"), F.expr("run_id < version - 1"))
    return added.join(removed, ["version", "run_id"], "left_anti")


@query("compaction_triggers", "levels", "SELECT level, n_runs, total_size, size_limit, CASE WHEN level = 0 THEN n_runs >= 4 ELSE size_limit > 0 AND total_size > size_limit END AS due FROM levels")
def _(spark, d):
    return manifest.triggers(_runs(spark, d), LEVEL_BASE)


@query(
    "manifest_snapshot", "runs",
    "SELECT run_id FROM runs WHERE NOT (run_id % 2 = 0 AND run_id + 2 <= (SELECT max(run_id) FROM runs))",
)
def _(spark, d):
    """The last version, where version v adds run v and takes out run v - 2 if that is even."""
    ids = _runs(spark, d).select("run_id")
    last = ids.agg(F.max("run_id")).first()[0]
    removed = ids.where("run_id % 2 = 0").select((F.col("run_id") + 2).alias("version"), "run_id")
    return manifest.snapshot(manifest.edits(ids.select(F.col("run_id").alias("version"), "run_id"), removed), last)


@query("manifest_summary", "levels", f"SELECT printf('L%d: %d runs, %d of %d bytes', i, coalesce(n_runs, 0), coalesce(total_size, 0), CASE WHEN i = 0 THEN 0 ELSE CAST({LEVEL_BASE} * power(10, i - 1) AS BIGINT) END) AS line FROM (SELECT i FROM range(0, 3) t(i) UNION SELECT level FROM levels) LEFT JOIN levels ON level = i")
def _(spark, d):
    return manifest.summary(_runs(spark, d), LEVEL_BASE).select(F.format_string("L%d: %d runs, %d of %d bytes", "level", "n_runs", "total_size", "size_limit").alias("line"))


@query("manifest_json", "runs", "SELECT run_id, CAST(to_json({'run_id': run_id, 'level': level, 'num_entries': num_entries, 'min_key': min_key, 'max_key': max_key, 'file_size': file_size}) AS VARCHAR) AS json FROM runs")
def _(spark, d):
    return manifest.to_json(_runs(spark, d))


@query("manifest_load", "runs", "SELECT run_id, level, num_entries, min_key, max_key, file_size FROM runs")
def _(spark, d):
    return manifest.from_json(manifest.to_json(_runs(spark, d)))


@query("level_rollup", "runs", "SELECT level, run_id, CAST(sum(num_entries) AS BIGINT) AS n FROM runs GROUP BY ROLLUP (level, run_id)")
def _(spark, d):
    return _runs(spark, d).rollup("level", "run_id").agg(F.sum("num_entries").alias("n"))


# --- compaction ---


@query("merge_runs", "rundata", "SELECT key, op, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM rundata) WHERE rn = 1")
def _(spark, d):
    return compaction.merge_runs(_rundata(spark, d)).select("key", "op", "seq")


@query("compact_drop_tombstones", "rundata", "SELECT key, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM rundata) WHERE rn = 1 AND op = 1")
def _(spark, d):
    return compaction.merge_runs(_rundata(spark, d), drop_deletes=True).select("key", "seq")


_ratio = "CAST(CASE WHEN run_id % 4 = 0 THEN 3 WHEN run_id % 4 = 1 THEN 10 ELSE 1 END AS BIGINT)"


def _uneven(spark, d):
    """Runs with sizes of three kinds."""
    return _runs(spark, d).withColumn("file_size", (F.col("num_entries") * F.expr(_ratio)).cast("long"))


_buckets = (
    f", sized AS (SELECT run_id, num_entries * {_ratio} AS file_size FROM runs), numbered AS (SELECT *, row_number() OVER (ORDER BY file_size, run_id) AS rn FROM sized), "
    "fold AS (SELECT run_id, file_size, rn, file_size AS total, 1::BIGINT AS n, 0::BIGINT AS bucket FROM numbered WHERE rn = 1 UNION ALL "
    "SELECT x.run_id, x.file_size, x.rn, CASE WHEN f.total > 0 AND x.file_size * f.n >= 0.5 * f.total AND x.file_size * f.n <= 1.5 * f.total THEN f.total + x.file_size ELSE x.file_size END, "
    "CASE WHEN f.total > 0 AND x.file_size * f.n >= 0.5 * f.total AND x.file_size * f.n <= 1.5 * f.total THEN f.n + 1 ELSE 1 END, "
    "CASE WHEN f.total > 0 AND x.file_size * f.n >= 0.5 * f.total AND x.file_size * f.n <= 1.5 * f.total THEN f.bucket ELSE f.bucket + 1 END FROM fold f JOIN numbered x ON x.rn = f.rn + 1) "
)


@query("stcs_buckets")
def _(spark, d):
    return folds.size_buckets(_uneven(spark, d))


_recursive("stcs_buckets", "runs", _buckets + "SELECT run_id, file_size, bucket FROM fold")


@query("stcs_due")
def _(spark, d):
    return folds.size_buckets(_uneven(spark, d)).groupBy("bucket").count().agg(F.coalesce(F.max("count") >= compaction.MIN_RUNS, F.lit(False)).alias("due"))


_recursive("stcs_due", "runs", _buckets + "SELECT max(n) >= 4 AS due FROM (SELECT count(*) AS n FROM fold GROUP BY bucket)")


@query("stcs_pick")
def _(spark, d):
    return compaction.tiered_pick(_uneven(spark, d)).select("run_id", "bucket", "file_size")


_picked = "best AS (SELECT bucket FROM fold GROUP BY bucket HAVING count(*) >= 4 ORDER BY count(*) DESC, bucket LIMIT 1), picked AS (SELECT run_id, bucket, file_size FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY file_size, run_id) AS rk FROM fold WHERE bucket IN (SELECT bucket FROM best)) WHERE rk <= 32)"
_recursive("stcs_pick", "runs", _buckets.rstrip() + ", " + _picked + " SELECT run_id, bucket, file_size FROM picked")


@query("stcs_compact")
def _(spark, d):
    picked = compaction.tiered_pick(_uneven(spark, d)).select("run_id")
    return compaction.merge_runs(_rundata(spark, d).join(picked, "run_id", "left_semi")).select("key", "op", "seq")


_recursive("stcs_compact", "runs", _buckets.rstrip() + ", " + _picked + " SELECT key, op, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM rundata WHERE run_id IN (SELECT run_id FROM picked)) WHERE rn = 1")


@query("lcs_due", "levels", "SELECT coalesce(bool_or(CASE WHEN level = 0 THEN n_runs >= 4 ELSE total_size > size_limit END), false) AS due FROM levels WHERE level < 2")
def _(spark, d):
    """The last level has no limit, so it is never due."""
    return manifest.triggers(_runs(spark, d), LEVEL_BASE).where("level < 2").agg(F.coalesce(F.bool_or("due"), F.lit(False)).alias("due"))


@query("lcs_pick_level", "levels", "SELECT min(level) AS level FROM levels WHERE level < 2 AND CASE WHEN level = 0 THEN n_runs >= 4 ELSE size_limit > 0 AND total_size > size_limit END")
def _(spark, d):
    return compaction.level_pick(_runs(spark, d), LEVEL_BASE, manifest.L0_RUNS, 2)


_victim = "SELECT a.run_id, a.min_key, a.max_key, CAST(coalesce(sum(b.file_size), 0) AS BIGINT) AS overlap_bytes FROM runs a LEFT JOIN runs b ON b.level = 2 AND b.min_key <= a.max_key AND a.min_key <= b.max_key WHERE a.level = 1 GROUP BY a.run_id, a.min_key, a.max_key ORDER BY overlap_bytes, a.min_key LIMIT 1"


@query("lcs_pick_run", "runs", f"SELECT run_id, overlap_bytes FROM ({_victim})")
def _(spark, d):
    return compaction.victim(_runs(spark, d), 1).select("run_id", "overlap_bytes")


@query("lcs_l0_to_l1", "runs", "SELECT key, op, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM rundata WHERE run_id IN (SELECT run_id FROM runs WHERE level = 0 UNION SELECT b.run_id FROM runs b, (SELECT min(min_key) AS lo, max(max_key) AS hi FROM runs WHERE level = 0) s WHERE b.level = 1 AND b.min_key <= s.hi AND s.lo <= b.max_key)) WHERE rn = 1")
def _(spark, d):
    runs = _runs(spark, d)
    inputs = compaction.level_inputs(runs, runs.where("level = 0"), 0)
    return compaction.merge_runs(_rundata(spark, d).join(inputs, "run_id", "left_semi")).select("key", "op", "seq")


@query("lcs_level_down", "runs", f"SELECT key, op, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM rundata WHERE run_id IN (SELECT run_id FROM ({_victim}) UNION SELECT b.run_id FROM runs b, ({_victim}) s WHERE b.level = 2 AND b.min_key <= s.max_key AND s.min_key <= b.max_key)) WHERE rn = 1")
def _(spark, d):
    runs = _runs(spark, d)
    inputs = compaction.level_inputs(runs, compaction.victim(runs, 1), 1)
    return compaction.merge_runs(_rundata(spark, d).join(inputs, "run_id", "left_semi")).select("key", "op", "seq")


@query("compaction_commit", "runs latest", "SELECT (SELECT count(*) FROM latest WHERE op = 1) AS live_keys, (SELECT count(*) FROM runs WHERE level = 2) AS runs_below, 0::BIGINT AS runs_above, 1::BIGINT AS version")
def _(spark, d):
    """Levels 0 and 1 merged into runs of their own key ranges on level 1, committed as one version; what is visible stays."""
    store = _new_store(spark, d)
    store.compact(store.runs().where("level < 2"), 1, outputs=3)
    live = resolve.visible(resolve.latest_wins(store.live_data())).agg(F.count("*").alias("live_keys"))
    runs = store.runs().agg(F.count_if(F.col("level") == 2).alias("runs_below"), F.count_if(F.col("level") == 0).alias("runs_above"))
    return live.join(F.broadcast(runs)).withColumn("version", F.lit(store.version()).cast("long"))  # one row each


@query("split_outputs")
def _(spark, d):
    sized = _rundata(spark, d).select("run_id", "key", (F.length("key") + F.octet_length("value")).cast("long").alias("size"))
    g = folds.greedy_groups(sized, ["run_id"], "key", "size", SPLIT_LIMIT, "part")
    return g.groupBy("run_id", "part").agg(F.count("*").alias("n"), F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.sum("size").alias("bytes"))


_recursive("split_outputs", "rundata", _fold_sql("rundata", "run_id", "key", "length(key) + strlen(value)", SPLIT_LIMIT, "part", "count(*) AS n, min(o) AS min_key, max(o) AS max_key, CAST(sum(c) AS BIGINT) AS bytes"))


# --- whole reads and measures ---


@query("engine_get", "latest", "SELECT key, value FROM latest WHERE op = 1 AND key IN ('user_000003', 'user_000005', 'user_999999')")
def _(spark, d):
    wanted = ["user_000003", "user_000005", "user_999999"]
    return resolve.visible(resolve.latest_wins(_store(spark, d).versions_of(wanted))).select("key", "value")


@query("multi_get", "latest probes", "SELECT l.key AS key, l.value AS value FROM latest l WHERE l.op = 1 AND l.key IN (SELECT key FROM probes)")
def _(spark, d):
    """Only versions of the wanted keys are resolved."""
    return resolve.visible(resolve.latest_wins(_rundata(spark, d).join(_probes(spark, d), "key", "left_semi"))).select("key", "value")


@query("snapshot_read", "log", "SELECT key, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log WHERE seq <= 500) WHERE rn = 1 AND op = 1")
def _(spark, d):
    return resolve.snapshot(_log(spark, d), 500).select("key", "value", "seq")


@query("space_amplification", "rundata latest", "SELECT round((SELECT sum(strlen(key) + strlen(value)) FROM rundata)::DOUBLE / (SELECT sum(strlen(key) + strlen(value)) FROM latest WHERE op = 1), 9) AS stored_over_live")
def _(spark, d):
    size = F.sum((F.octet_length("key") + F.octet_length("value")).cast("long"))
    stored, live = _rundata(spark, d).agg(size.alias("stored")), resolve.visible(_latest(spark, d)).agg(size.alias("live"))
    return stored.join(F.broadcast(live)).select(F.round(F.col("stored") / F.col("live"), 9).alias("stored_over_live"))  # one row each


@query("read_amplification", "runs probes", "SELECT p.key AS key, count(r.run_id) AS runs_touched FROM probes p LEFT JOIN runs r ON r.min_key <= p.key AND p.key <= r.max_key GROUP BY p.key")
def _(spark, d):
    return manifest.touched(_runs(spark, d), _probes(spark, d))


@query("write_amplification", "rundata log", "SELECT round(((SELECT sum(strlen(key) + strlen(value)) FROM log) + 2 * (SELECT sum(strlen(key) + strlen(value)) FROM rundata))::DOUBLE / (SELECT sum(strlen(key) + strlen(value)) FROM log), 9) AS written_over_user")
def _(spark, d):
    """The log, the runs, and one merge of all runs, over what users wrote."""
    size = F.sum((F.octet_length("key") + F.octet_length("value")).cast("long"))
    user, stored = _log(spark, d).agg(size.alias("u")), _rundata(spark, d).agg(size.alias("s"))
    return user.join(F.broadcast(stored)).select(F.round((F.col("u") + 2 * F.col("s")) / F.col("u"), 9).alias("written_over_user"))  # one row each


def entry(spark: SparkSession) -> DataFrame:
    return current_state(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
