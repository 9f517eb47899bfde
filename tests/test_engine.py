"""Golden values, edge cases and invariants of the engine."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mergeview.functions.hashing import hash_probes, murmur3_32
from mergeview.functions.text import frame_crc, frame_size, shared_prefix
from mergeview.operators import blocks, bloom, compaction, folds, manifest, resolve
from mergeview.sources import runs, wal
from mergeview.streaming import ingest

LOG = "seq long, op int, key string, value string"


def test_murmur3_golden(spark):
    rows = [("test", 0xBA6BD213, None), ("hello", 0x248BFA47, None), ("Hello, world!", 0xC0363E43, None), ("key_0000", 0x15DDAB9D, 0xEF498502), ("key_000001", 0xE60E326A, 0xD33C97DE), ("user:1001", 0x9A98BFC0, 0x2CC8444C), ("héllo", 0xBC9FA068, 0xF68531FB)]
    df = spark.createDataFrame(rows, "k string, a long, b long").select("k", "a", "b", murmur3_32(F.col("k")).alias("x"), murmur3_32(F.col("k"), 42).alias("y"))
    for r in df.collect():
        assert r.x == r.a and (r.b is None or r.y == r.b), r
    assert spark.range(1).select(murmur3_32(F.lit(""), 1)).first()[0] == 0x514E28B7
    assert spark.range(1).select(hash_probes(F.lit("key_0000"), 7, 128)).first()[0] == [29, 31, 33, 35, 37, 39, 41]


def test_pairs_of_whole_columns_are_those_of_the_expressions(spark):
    from mergeview.functions.hashing import with_pair

    keys = ["", "a", "ab", "abc", "abcd", "Hello, world!", "key_000001", "héllo", "ключ", "漢字" * 9, "\x00x", "x" * 1001, None]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    got = with_pair(df).select("_a", "_b", murmur3_32(F.col("key")).alias("x"), murmur3_32(F.col("key"), 42).alias("y"))
    assert all((r._a, r._b) == (r.x, r.y) for r in got.collect()) and got.where("_a is null").count() == 1
    plan = bloom.words(df, 128, 7)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "conv(" not in plan


def test_bloom_sizes(spark):
    df = spark.createDataFrame([(0,), (1,), (3,), (1000,), (100000,)], "n long")
    m = bloom.num_bits(F.col("n"))
    assert [tuple(r) for r in df.select(m, bloom.num_hashes(F.col("n"), m)).collect()] == [(64, 44), (64, 44), (64, 15), (10000, 7), (1000000, 7)]
    rate = spark.range(1).select(bloom.theoretical_rate(F.lit(100000), F.lit(1000000), F.lit(7)), bloom.bits_per_key(F.lit(0.01))).first()
    assert rate[0] == pytest.approx(0.008193722, abs=1e-9) and rate[1] == pytest.approx(9.585058377, abs=1e-9)
    for p in (0.0, 1.0, -1.0):
        with pytest.raises(Exception, match="a rate lies between 0 and 1"):
            spark.range(1).select(bloom.bits_per_key(F.lit(p))).collect()


def test_no_false_negative(spark):
    keys = spark.createDataFrame([("",), ("é",), ("a" * 300,), ("b",)], "key string")
    size = bloom.sizes(keys, []).first()
    words = bloom.words(keys, size.m, size.k)
    assert bloom.probe(words, keys, size.m, size.k).where("not maybe").count() == 0
    held = bloom.stored(words.withColumn("r", F.lit(1)), spark.createDataFrame([(1, size.m, size.k)], "r int, m long, k int"), ["r"])
    back = {(r.word, r.mask) for r in bloom.loaded(held, ["r"]).collect()}
    assert back == {(r.word, r.mask) for r in words.collect()} and held.select(F.length("bytes")).first()[0] == 8


def test_filters_grow_with_their_keys(spark):
    """A hundred times the keys, a hundred times the bits, and the same share of wrong yeses: 399 of 50,000 at 100,000 keys."""
    from mergeview.plans import catalog

    r = catalog.QUERIES["bloom_empirical_fpr"](spark, "").first()
    assert (r.bits_set, r.trials, r.false_positives) == (503_079, 50_000, 399)


def test_frames(spark):
    r = spark.range(1).select(frame_crc(F.lit(1), F.lit("abc"), F.lit(b"vv")), frame_size(F.lit("abc"), F.lit(b"vv"))).first()
    assert tuple(r) == (3718005233, 18)
    data = b"".join(wal.frame(1, f"key_{i:06d}", f"value_{i}".encode()) for i in range(100))
    assert len(list(wal.frames(data + b"\0\1\2"))) == 100
    damaged = bytearray(data)
    damaged[len(data) // 2] ^= 255
    assert 0 < len(list(wal.frames(bytes(damaged)))) < 100 and list(wal.frames(b"")) == []


def test_replay(spark, tmp_path):
    (tmp_path / "wal_1.log").write_bytes(b"".join(wal.frame(1 + i % 2, f"k{i}é", b"v" * i) for i in range(10)) + b"\0\1\2")
    rows = wal.replay(spark, str(tmp_path)).orderBy("lsn").collect()
    assert [(r.lsn, r.op, r.key, len(r.value)) for r in rows] == [(i, 1 + i % 2, f"k{i}é", i) for i in range(10)]


def test_valid_prefix(spark):
    rows = spark.createDataFrame([(0, i, i not in (5, 8)) for i in range(10)] + [(1, 0, False), (1, 1, True)], "segment_id long, lsn long, ok boolean")
    assert sorted((r.segment_id, r.lsn) for r in wal.valid_prefix(rows).collect()) == [(0, i) for i in range(5)]


def test_shared_prefix_counts_characters(spark):
    rows = [("abc", "abd", 2), ("", "a", 0), ("héx", "héy", 2), ("same", "same", 4), ("a", "ab", 1)]
    assert all(r[2] == r[3] for r in spark.createDataFrame(rows, "a string, b string, n int").select("a", "b", "n", shared_prefix(F.col("a"), F.col("b"))).collect())


def test_memtable_flushes(spark):
    """10,000 puts of key_%06d and value_{i} at 4096 bytes: 203 flushes, 32 entries and 2,688 bytes left."""
    rows = spark.range(10_000).select(F.lit(0).alias("s"), F.col("id").alias("lsn"), (F.lit(10 + 6 + 64) + F.length(F.col("id").cast("string"))).cast("long").alias("size"))
    g = folds.greedy_groups(rows, ["s"], "lsn", "size", 4096).groupBy("grp").agg(F.count("*").alias("n"), F.sum("size").alias("b")).orderBy(F.desc("grp")).first()
    assert tuple(g) == (203, 32, 2688)


def test_size_buckets(spark):
    sizes = [0, 0, 100, 110, 120, 130, 400, 420, 1000]
    got = folds.size_buckets(spark.createDataFrame(list(enumerate(sizes)), "run_id long, file_size long"))
    by = {}
    for r in got.collect():
        by.setdefault(r.bucket, []).append(r.file_size)
    assert [sorted(by[b]) for b in sorted(by)] == [[0], [0], [100, 110, 120, 130], [400, 420], [1000]]
    assert folds.size_buckets(spark.createDataFrame([], "run_id long, file_size long")).count() == 0


def test_bucket_bounds_are_inclusive(spark):
    got = folds.size_buckets(spark.createDataFrame([(0, 100), (1, 150), (2, 400)], "run_id long, file_size long"))
    assert {r.run_id: r.bucket for r in got.collect()} == {0: 0, 1: 0, 2: 1}


def formatted(spark, n, key, value, target):
    rows = spark.range(n).select(F.lit(0).alias("r"), F.format_string(key, "id").alias("key"), F.concat(F.lit(value), F.col("id").cast("string")).alias("value"))
    return blocks.packed(rows, ["r"], target)


def test_block_of_the_format(spark):
    """50 entries of user:profile:%06d and data_{i}: 816 bytes, 1,290 as they are."""
    packed = formatted(spark, 50, "user:profile:%06d", "data_", 4096)
    assert blocks.block_stats(packed, ["r"]).first()["size"] == 816


def test_run_of_the_format(spark):
    """50,000 keys: 244 blocks, the first of 232 entries and 4,106 bytes; where the index, the filter and the file end."""
    index = blocks.sparse_index(formatted(spark, 50_000, "key_%08d", "value_", 4096), ["r"])
    rows = index.orderBy("block_id").collect()
    assert len(rows) == 244 and (rows[0].n, rows[0].size) == (232, 4106)
    assert (rows[-1].first_key, rows[-1].last_key, rows[-1].offset, rows[-1].size, rows[-1].n) == ("key_00049899", "key_00049999", 997_004, 2_046, 101)
    sizes = blocks.file_sizes(index, ["r"]).first()
    assert (sizes.blocks, sizes.n, sizes.index_offset, sizes.bloom_offset, sizes.file_size) == (244, 50_000, 999_054, 1_004_426, 1_066_962)


def test_smaller_run_of_the_format(spark):
    """1,250 keys in blocks of 2,048 bytes: 10 blocks, 22,289 bytes."""
    index = blocks.sparse_index(formatted(spark, 1_250, "key_%08d", "val_", 2048), ["r"])
    assert tuple(blocks.file_sizes(index, ["r"]).select("blocks", "file_size").first()) == (10, 22_289)


def test_folds_are_linear(spark):
    """A sequence of a million rows beside short ones, one of null; groups as a plain loop cuts them."""
    n = 1_000_000
    rows = spark.range(n + 300).select(F.when(F.col("id") < n, "long").when(F.col("id") < n + 100, "short").otherwise(F.lit(None)).alias("s"), F.col("id").alias("o"), (F.col("id") * 7919 % 97).alias("size"))
    got = folds.greedy_groups(rows, ["s"], "o", "size", 1000).groupBy("s", "grp").agg(F.min("o").alias("o"), F.sum("size").alias("t")).collect()
    want, at = {}, {}
    for i in range(n + 300):
        s = "long" if i < n else "short" if i < n + 100 else None
        g, t = at.get(s, (0, 0))
        if t == 0 and (s, g) not in want:
            want[s, g] = i
        t += i * 7919 % 97
        at[s] = (g + 1, 0) if t >= 1000 else (g, t)
    assert {(r.s, r.grp): r.o for r in got} == want


def test_victims_that_tie_in_all_but_their_id(spark):
    for least in range(1, 6):
        rows = [(i, 1, "a", "z", 10) for i in range(20, least - 1, -1)] + [(99, 2, "a", "z", 7)]
        got = compaction.victim(spark.createDataFrame(rows, "run_id long, level int, min_key string, max_key string, file_size long"), 1).first()
        assert (got.run_id, got.overlap_bytes) == (least, 7)


def test_victim(spark):
    rows = [(1, 1, "a", "c", 1), (2, 1, "d", "f", 1), (3, 1, "g", "k", 1), (4, 2, "b", "d", 50), (5, 2, "e", "e", 5), (6, 2, "h", "j", 70)]
    got = compaction.victim(spark.createDataFrame(rows, "run_id long, level int, min_key string, max_key string, file_size long"), 1).first()
    assert (got.run_id, got.overlap_bytes) == (1, 50)


def test_limits_and_triggers(spark):
    assert [r[0] for r in spark.range(4).select(manifest.level_limit(F.col("id"))).collect()] == [0, 10485760, 104857600, 1048576000]
    runs_ = [(i, 0, 1) for i in range(4)] + [(9, 1, 10485760), (10, 2, 104857601)]
    due = {r.level: r.due for r in manifest.triggers(spark.createDataFrame(runs_, "run_id long, level int, file_size long")).collect()}
    assert due == {0: True, 1: False, 2: True}


def test_floor(spark):
    index = spark.createDataFrame([(0, "b", 0), (0, "f", 1), (0, "m", 2)], "r int, first_key string, block_id long")
    got = blocks.floor_block(index, spark.createDataFrame([(0, k) for k in "abez"], "r int, key string"), ["r"])
    assert {r.key: r.block_id for r in got.collect()} == {"a": None, "b": 0, "e": 0, "z": 2}


def test_edge_cases(spark):
    log = spark.createDataFrame([(1, 2, "never", None), (2, 1, "k", "a"), (3, 2, "k", None), (4, 1, "k", "b"), (5, 1, "marker", "__TOMBSTONE__"), (6, 1, "", ""), (7, 1, "é", "x"), (8, 2, "é", None)], LOG)
    got = {r.key: r.value for r in resolve.visible(resolve.latest_wins(log)).collect()}
    assert got == {"k": "b", "marker": "__TOMBSTONE__", "": ""}
    asked = resolve.three_state(resolve.latest_wins(log), spark.createDataFrame([("never",), ("k",), ("nope",)], "key string"))
    assert {r.key: r.state for r in asked.collect()} == {"never": "DELETED", "k": "FOUND", "nope": "ABSENT"}
    assert resolve.latest_wins(log.limit(0)).count() == 0


def test_key_order(spark):
    keys = ["", "Z", "a", "é", "￿", "\U00010000"]
    shuffled = keys[:]
    random.Random(1).shuffle(shuffled)
    assert [r.key for r in spark.createDataFrame([(k,) for k in shuffled], "key string").orderBy("key").collect()] == keys


def test_run_files(spark, tmp_path):
    path = str(tmp_path / "run")
    runs.write_run(spark.range(1000).select(F.format_string("k%05d", "id").alias("key"), F.col("id").alias("seq")), path, files=4)
    back = runs.read_run(spark, path, "key string, seq long")
    assert back.count() == 1000
    plan = back.where("key = 'k00007'")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(key), EqualTo(key,k00007)]" in plan


def store_of(spark, path, rows):
    from mergeview.sources.runs import RunStore

    store = RunStore(spark, str(path))
    store.add(spark.createDataFrame(rows, "run_id long, seq long, op int, key string, value string, level int"))
    return store


@pytest.mark.parametrize("block, chunk", [(4096, 256), (7, 3), (1, 1)])
def test_probes_in_ranges_are_those_of_single_probes(spark, tmp_path, monkeypatch, block, chunk):
    """Narrow and wide runs, one of a single key, some whose range holds no probe, filters with empty words, null and repeated probes."""
    monkeypatch.setattr(bloom, "BLOCK", block)
    monkeypatch.setattr(bloom, "CHUNK", chunk)
    rng = random.Random(5)
    names = [f"k{i:04}" for i in range(120)] + ["é", "\uffff", "\U00010000"]
    held = [sorted(rng.sample(names, n)) for n in (1, 2, 5, 40, 100, 123)] + [sorted(names[a : a + 9]) for a in range(0, 110, 10)] + [["zzz"]]
    keys = spark.createDataFrame([(i, k) for i, ks in enumerate(held) for k in ks], "run_id long, key string")
    sizes = bloom.sizes(keys, ["run_id"])
    asked = [*names[::3], *[f"k{i:04}x" for i in range(0, 120, 5)], "", "k", "\U00010001"]
    runs_ = keys.groupBy("run_id").agg(F.min("key").alias("min_key"), F.max("key").alias("max_key")).join(sizes, "run_id")
    words = lambda word: bloom.words(keys.join(sizes, "run_id"), F.col("m"), F.col("k"), ["run_id"], word)
    probes = spark.createDataFrame([(k,) for k in [*asked, *asked, None]], "key string")
    got = bloom.probe_ranges(words(bloom.LONG), runs_, probes, str(tmp_path / "probes")).collect()
    inside = runs_.join(probes, F.expr("min_key <= key and key <= max_key")).select("run_id", "key", "m", "k")
    want = bloom.probe(words(bloom.WORD), inside, F.col("m"), F.col("k"), ["run_id"]).select("run_id", "key", "maybe").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 300 and {r.maybe for r in got} == {True, False}
    assert all(r.maybe for r in got if r.key in held[r.run_id])
    none = bloom.probe_ranges(words(bloom.LONG), runs_, probes.limit(0), str(tmp_path / "none"))
    assert none.count() == 0


def test_pairs_of_runs_and_probes_are_not_shuffled(spark, tmp_path):
    """Runs that share one range: each probe meets each run, and no exchange may carry a row for each pair."""
    from mergeview.plans import catalog

    folder, users, n = str(tmp_path), 800, 40
    events = spark.range(n * 1000).select(F.col("id").alias("event_id"), F.current_timestamp().cast("timestamp_ntz").alias("ts"), F.pmod(F.xxhash64("id"), F.lit(users)).alias("user_id"), F.lit("view").alias("event_type"), F.lit("p").alias("props"))
    events.write.parquet(f"{folder}/events.parquet")
    spark.range(users).select(F.col("id").alias("c_custkey")).write.parquet(f"{folder}/customer.parquet")
    catalog._store(spark, folder)
    context, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway

    def stages():
        found = context.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in map(found.apply, range(found.size()))}

    before = stages()
    pairs = catalog.QUERIES["run_bloom_probe"](spark, folder).count()
    assert pairs > n * (users - 20)
    context.listenerBus().waitUntilEmpty()
    shuffled = sum(x for at, x in stages().items() if at not in before)
    assert shuffled < pairs / 2, shuffled


def test_store_commits_merges_as_versions(spark, tmp_path):
    rows = [(r, r * 100 + i, 2 if i % 5 == r else 1, f"k{(i * 3 + r) % 17:02}", f"v{r}.{i}", min(r, 1)) for r in range(4) for i in range(17)]
    store = store_of(spark, tmp_path / "store", rows)
    before = {r.key: r.value for r in resolve.visible(resolve.latest_wins(store.live_data())).collect()}
    assert store.version() == 0 and store.runs().count() == 4
    store.compact(store.runs().where("run_id < 2"), 1, outputs=2)
    assert store.version() == 1 and {r.key: r.value for r in resolve.visible(resolve.latest_wins(store.live_data())).collect()} == before
    live = {r.run_id: r for r in store.runs().collect()}
    assert {0, 1}.isdisjoint(live) and {2, 3} < live.keys() and {r.run_id for r in store.runs(0).collect()} == {0, 1, 2, 3}
    made = sorted((r for i, r in live.items() if i > 3), key=lambda r: r.min_key)
    assert made and all(a.max_key < b.min_key for a, b in zip(made, made[1:])) and sum(r.num_entries for r in made) == 17
    store.compact(store.runs(), 2, drop_deletes=True)
    assert {r.key: r.value for r in store.live_data().collect()} == before and store.version() == 2


@pytest.mark.parametrize("query", ["point_get", "engine_get", "run_get", "range_scan"])
def test_reads_are_pushed_down_to_the_files(spark, query):
    from mergeview.plans import catalog
    from tests.conftest import SF

    plan = catalog.QUERIES[query](spark, SF)._jdf.queryExecution().toString()
    pushed = plan[plan.index("PushedFilters: [") :].split("]")[0]
    assert any(f"{x}(key" in pushed for x in ("EqualTo", "In", "GreaterThanOrEqual")), pushed


def test_runs_whose_range_holds_no_wanted_key_are_not_opened(spark, tmp_path):
    store = store_of(spark, tmp_path / "store", [(r, r * 10 + i, 1, f"k{r}{i}", "v", 0) for r in range(5) for i in range(5)])
    got = store.versions_of(["k13", "k31", "zz"])
    assert sorted(r.key for r in got.collect()) == ["k13", "k31"]
    assert "PartitionFilters: [isnotnull(run_id" in (plan := got._jdf.queryExecution().toString()) or "run_id#" in plan.split("PartitionFilters")[1][:60]


def test_files_of_small_runs_are_small(spark, tmp_path):
    store = store_of(spark, tmp_path / "store", [(r, r * 100 + i, 1, f"k{i:03}", "v", 0) for r in range(8) for i in range(100)])
    store.compact(store.runs().where("run_id < 4"), 1, outputs=2)
    files = list((tmp_path / "store" / "data").rglob("*.parquet"))
    assert len(files) >= 10 and max(f.stat().st_size for f in files) < 20_000


def test_touched(spark):
    rng = random.Random(3)
    for names in ([f"k{i:03}" for i in range(300)], ["a", "b"]):
        ranges = [(i, *sorted((rng.choice(names), rng.choice(names)))) for i in range(40)]
        got = manifest.touched(spark.createDataFrame(ranges, "run_id long, min_key string, max_key string"), spark.createDataFrame([(k,) for k in [*names, "", "zz"]], "key string"))
        assert {r.key: r.runs_touched for r in got.collect()} == {k: sum(a <= k <= b for _, a, b in ranges) for k in [*names, "", "zz"]}
        assert "NestedLoopJoin Inner, (min_key" not in got._jdf.queryExecution().toString()
    none = manifest.touched(spark.createDataFrame([], "run_id long, min_key string, max_key string"), spark.createDataFrame([("a",), (None,)], "key string"))
    assert {tuple(r) for r in none.collect()} == {("a", 0), (None, 0)}


def test_manifest_keeps_empty_levels_and_loads_what_it_writes(spark):
    rows = spark.createDataFrame([(1, 1, 5, "a", "é", 20_000_000, 0, 9)], "run_id long, level int, num_entries long, min_key string, max_key string, file_size long, min_seq long, max_seq long")
    assert sorted(tuple(r) for r in manifest.summary(rows).collect()) == [(0, 0, 0, 0), (1, 1, 20_000_000, 10_485_760), (2, 0, 0, 104_857_600)]
    assert [tuple(r) for r in manifest.from_json(manifest.to_json(rows)).collect()] == [(1, 1, 5, "a", "é", 20_000_000)]
    edits = spark.createDataFrame([(1, 1, True), (2, 2, True), (3, 1, False), (4, 1, True)], "version long, run_id long, live boolean")
    assert [sorted(r.run_id for r in manifest.snapshot(edits, v).collect()) for v in (1, 2, 3, None)] == [[1], [1, 2], [2], [1, 2]]


def test_the_largest_key_is_the_true_one_and_the_last_level_is_never_due(spark, tmp_path):
    """A run's range ends at its last key, not at its last block's first; a full last level isn't picked; filters follow the keys."""
    store = store_of(spark, tmp_path / "store", [(0, i, 1, f"key_{i:08d}", "v" * 50, 2) for i in range(300)])
    r = store.runs().first()
    assert (r.min_key, r.max_key) == ("key_00000000", "key_00000299")
    assert compaction.level_pick(store.runs(), 1, 4, 2).first().level is None and compaction.level_pick(store.runs(), 1, 4, 3).first().level == 2
    assert bloom.sizes(store.data(), ["run_id"]).first().m == 3000


def test_entry_without_the_folder_for_training_data(monkeypatch):
    """The engine's queries load where a library that only the other operators need is missing."""
    import builtins
    import importlib
    import sys

    real = builtins.__import__
    monkeypatch.setattr(builtins, "__import__", lambda name, *a, **k: (_ for _ in ()).throw(ImportError(name)) if name == "regex" else real(name, *a, **k))
    for name in [x for x in sys.modules if x.startswith("mergeview.llm") or x in ("regex", "__spark_entry__", "corpus_pipeline")]:
        monkeypatch.delitem(sys.modules, name)
    e = importlib.import_module("__spark_entry__")
    assert "current_state" in e.queries() and not any(q.startswith("op") for q in e.queries()) and "pipeline" not in e.queries()
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_streaming_flush(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "runs")
    for i in range(3):
        spark.createDataFrame([(10 * i + j, 2 if j == 3 else 1, f"k{(i + j) % 6}", f"v{i}{j}") for j in range(5)], LOG).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(source)
    ingest.start_ingest(stream, out, str(tmp_path / "cp")).awaitTermination(120)
    want = {r.key: r.value for r in resolve.visible(resolve.latest_wins(spark.read.parquet(source))).collect()}
    assert {r.key: r.value for r in ingest.state(spark, out).collect()} == want
    assert ingest.runs(spark, out).select("run_id").distinct().count() == 3
    ingest.compact(spark, out, str(tmp_path / "one"))
    assert {r.key: r.value for r in ingest.state(spark, str(tmp_path / "one")).collect()} == want
    before = {r.key: r.value for r in resolve.snapshot(spark.read.parquet(source), 12).collect()}
    assert {r.key for r in ingest.state(spark, out, as_of=12).collect()} <= before.keys()


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abcdé"), st.sampled_from([1, 2]), st.text(max_size=3)), max_size=30), st.integers(1, 5))
def test_resolution_is_a_dict(spark, writes, per_run):
    """Whatever the cut into runs and however they are merged, the visible state is that of a dict."""
    state: dict = {}
    for key, op, value in writes:
        state.pop(key, None) if op == 2 else state.__setitem__(key, value)
    log = spark.createDataFrame([(i, op, k, v) for i, (k, op, v) in enumerate(writes)], LOG)
    parts = resolve.latest_wins(log.withColumn("run_id", F.floor(F.col("seq") / per_run)), ("run_id", "key"))
    half = compaction.merge_runs(parts.where("run_id % 2 = 0")).unionByName(compaction.merge_runs(parts.where("run_id % 2 = 1")))
    assert {r.key: r.value for r in resolve.visible(compaction.merge_runs(half)).collect()} == state
    assert {r.key: r.value for r in compaction.merge_runs(half, drop_deletes=True).collect()} == state


def test_newest_versions_as_a_stream(spark, tmp_path):
    """Update mode: each batch gives the keys that changed; later batches replace what earlier ones gave."""
    source, state = str(tmp_path / "in"), {}
    rows = [[(1, 1, "a", "x"), (2, 1, "b", "y")], [(4, 2, "a", None), (3, 1, "a", "z"), (5, 1, "c", "w")]]
    for part in rows:
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(source)
    stream = ingest.latest_by_key(spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(source))
    take = lambda batch, _: state.update({r.key: (r.seq, r.live) for r in batch.collect()})
    stream.writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert state == {"a": (4, False), "b": (2, True), "c": (5, True)}
