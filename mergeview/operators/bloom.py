"""Bloom filters with double hashing: sizes from the number of keys, rates, packed words, probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergeview.functions.hashing import with_pair


def num_bits(n: Column, bits_per_key: float | Column = 10.0) -> Column:
    return F.greatest(F.lit(64), F.floor(n * bits_per_key)).cast("long")


def num_hashes(n: Column, m: Column) -> Column:
    """Halves round to the even number, so bround."""
    return F.greatest(F.lit(1), F.bround(m / F.greatest(n, F.lit(1)) * F.lit(0.6931471805599453))).cast("int")


def bits_per_key(rate: Column) -> Column:
    """Bits for a false positive rate; an error unless it lies between 0 and 1."""
    return F.when((rate > 0) & (rate < 1), -F.log(rate) / F.pow(F.lit(0.6931471805599453), F.lit(2))).otherwise(F.raise_error(F.lit("a rate lies between 0 and 1")).cast("double"))


def theoretical_rate(n: Column, m: Column, k: Column) -> Column:
    return F.when(n == 0, F.lit(0.0)).otherwise(F.pow(1 - F.exp(-k * n / m), k))


WORD = 32  # bits of a stored word
LONG = 64  # bits of a word of a filter that is held as an array
BLOCK, CHUNK = 4096, 256  # probes and runs that meet in one group at most, about


def with_sizes(counts: DataFrame) -> DataFrame:
    """counts, whose n is the number of keys of a filter, with m and k."""
    return counts.withColumn("m", num_bits(F.col("n"))).withColumn("k", num_hashes(F.col("n"), F.col("m")))


def sizes(keys: DataFrame, by: list[str]) -> DataFrame:
    """by, n, m and k: the filters' sizes from the numbers of their keys."""
    return with_sizes(keys.groupBy(*by).agg(F.count("*").alias("n")))


def _bits(keys: DataFrame, m: Column | int, k: Column | int, *columns: str, word: int = WORD) -> DataFrame:
    k, m = (F.lit(x) if isinstance(x, int) else x for x in (k, m))
    held = with_pair(keys.select(*columns, *([] if "key" in columns else ["key"]), k.cast("int").alias("_k"), m.cast("long").alias("_m")))
    places = F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda i: (F.col("_a") + i * F.col("_b")) % F.col("_m"))
    bits = held.select(*columns, F.explode(places).alias("bit"))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % word).cast("int"))
    return bits.select(*columns, F.floor(F.col("bit") / word).alias("word"), mask.alias("mask"))


def words(keys: DataFrame, m: Column | int, k: Column | int, by: list[str] = (), word: int = WORD) -> DataFrame:
    """The filter of each group of keys as its words that have a bit set; bits meet before the shuffle."""
    return _bits(keys, m, k, *by, word=word).groupBy(*by, "word").agg(F.bit_or("mask").alias("mask"))


def probe(filters: DataFrame, probes: DataFrame, m: Column | int, k: Column | int, by: list[str] = ()) -> DataFrame:
    """by, key and maybe (all of its bits are set) for each different probe.  m, k: as the filters', maybe columns of probes."""
    asked = _bits(probes.distinct(), m, k, *by, "key").withColumnRenamed("mask", "asked")
    hit = F.coalesce(F.col("mask").bitwiseAND(F.col("asked")) != 0, F.lit(False))
    return asked.join(filters, [*by, "word"], "left").groupBy(*by, "key").agg(F.bool_and(hit).alias("maybe"))


def probe_ranges(filters: DataFrame, runs: DataFrame, probes: DataFrame, path: str) -> DataFrame:
    """run_id, key and maybe for each different probe in each run whose closed key range holds it.

    filters: the runs' words of LONG bits, by run_id.  runs: run_id, min_key, max_key, m, k.  path: a new folder, for the probes in order.
    Probes are cut into blocks of neighbours and each run's filter goes to the blocks its range meets, so neither pairs nor their
    bits are shuffled or compared beyond those blocks; a block's runs are dealt to groups, so that many on one range share tasks.
    """
    spark = probes.sparkSession
    block = F.floor(F.monotonically_increasing_id() / BLOCK).alias("block")  # partitions begin at multiples of 2**33
    probes.select("key").where("key is not null").distinct().repartitionByRange("key").sortWithinPartitions("key").select("key", block).write.parquet(path)
    asked = spark.read.schema("key string, block long").parquet(path)
    spans = asked.groupBy("block").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    met = runs.join(F.broadcast(spans), (F.col("min_key") <= F.col("hi")) & (F.col("lo") <= F.col("max_key"))).drop("lo", "hi")  # a row for each block
    chunks = met.groupBy("block").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))

    words, gap = _in_order(filters, ["run_id"])
    zeros = lambda n: F.array_repeat(F.lit(0).cast("long"), n.cast("int"))
    whole = F.flatten(F.zip_with(F.col("words"), gap, lambda x, gap: F.concat(zeros(gap), F.array(x["mask"]))))
    held = met.join(F.broadcast(chunks), "block").withColumn("chunk", F.pmod(F.xxhash64("run_id"), F.col("chunks"))).drop("chunks")
    held = held.join(words.select("run_id", whole.alias("words")), "run_id")

    dealt = with_pair(asked.join(F.broadcast(chunks), "block")).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).drop("chunks")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # given, as few bytes make many pairs and would be put into few tasks
    both = held.repartition(parts, "block", "chunk").join(dealt.repartition(parts, "block", "chunk"), ["block", "chunk"]).where("min_key <= key and key <= max_key")

    def is_set(i: Column) -> Column:
        bit = (F.col("_a") + i * F.col("_b")) % F.col("m")
        return F.getbit(F.coalesce(F.get("words", F.shiftright(bit, 6).cast("int")), F.lit(0).cast("long")), bit.bitwiseAND(LONG - 1).cast("int")) == 1

    return both.select("run_id", "key", F.forall(F.sequence(F.lit(0), F.col("k") - 1), is_set).alias("maybe"))


def _in_order(filters: DataFrame, by: list[str]) -> tuple[DataFrame, Column]:
    """by and each filter's words in order; how many empty ones lie before each."""
    held = filters.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("word", "mask"))).alias("words"))
    return held, F.transform("words", lambda x, i: x["word"] - F.when(i > 0, F.get("words", i - 1)["word"]).otherwise(F.lit(-1).cast("long")) - 1)


def stored(filters: DataFrame, sizes: DataFrame, by: list[str]) -> DataFrame:
    """by, m, k and the filter's bytes, words in order.  A filter is as large as its run's share of bits."""
    words, before = _in_order(filters, by)
    held = words.join(sizes, by)
    hex_ = F.zip_with(F.col("words"), before, lambda x, gap: F.concat(F.repeat(F.lit("0" * (WORD // 4)), gap.cast("int")), F.lpad(F.hex(x["mask"]), WORD // 4, "0")))
    whole = ((F.floor((F.col("m") - 1) / WORD) + 1) * (WORD // 4)).cast("int")
    return held.select(*by, "m", "k", F.unhex(F.rpad(F.array_join(hex_, ""), whole, F.lit("0"))).alias("bytes"))


def loaded(stored: DataFrame, by: list[str]) -> DataFrame:
    """The words with a bit set in stored filters."""
    w = F.posexplode(F.regexp_extract_all(F.hex("bytes"), F.lit(f"(.{{{WORD // 4}}})"), F.lit(1)))
    each = stored.select(*by, w.alias("word", "hex"))
    return each.select(*by, F.col("word").cast("long").alias("word"), F.conv("hex", 16, 10).cast("long").alias("mask")).where("mask <> 0")
