"""N-gram Jaccard join: which documents' sets of word n-grams have a Jaccard similarity of 4/5 or more.

Exact up to collisions of 64-bit hashes, in these steps:

1. Equal sets are one class; everything below is between classes.
2. Document frequencies of shingles are counted over all documents.  The most frequent ones (at most
   HOT_SHINGLES, each in HOT_FROM sets or more) go last in the global order, all others by their hash.
   The order steers the work only; any order finds all links.
3. Every set of n shingles is indexed under the first n - ceil(4n/5) + 1 of its shingles: two sets with
   a link share one of them.
4. Set relations, between answers: sets that agree in a pair of minimum hashes are compared with one of
   them, the centre: that with the fewest shingles outside the frequent ones, which copies with edits of
   their own are nearest to.  Found links make components, and what a component's sets link with inside it
   is known to be connected.
5. Set relations, in index lists: entries are blocks of one size, position and component.  Two blocks are
   skipped as a whole, before any pair is made, if sizes and positions leave too small an overlap or if they
   are of one component.  A list in more than LONG sets is dealt to many tasks by its blocks.
6. Remaining candidates meet an upper bound of their overlap from small histograms of both sets.  Then the
   centres of the two are compared in full, once for all pairs they stand for, and the answer of each pair
   is derived from that of its centres and the sets' differences to them; only pairs that this leaves open
   are compared in full themselves.

Null or wordless text gives an empty set, which links with nothing.  Documents that share an id keep a
row each.  Very long texts are sets like others.  Columns other than id and text are not looked at, whatever
their names.  No list, candidate or partner is capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergeview.llm.components import components
from mergeview.llm.tables import Saved
from mergeview.llm.words import chunks, mix

SIZE = 5  # words of a shingle
HOT_SHINGLES = 1 << 20  # at most so many are sent to the executors, 8 bytes each
HOT_FROM = 64  # sets that hold a shingle before it may count as frequent
LOW_BITS = 32  # counts are by the bits that deal shingles into buckets and so many more; a collision only changes the order
BUCKET = 1_000_000  # shingles, or twice the index entries, of a bucket, about
FLUSH = 1_000_000  # shingles or index entries that a task gathers before it hands them on
LONG = 50_000  # sets that hold a shingle before its list is dealt to many tasks
LONG_BLOCK = 20_000  # entries of a long list that a task holds against as many
PAIRS_AT_ONCE = 500_000
FILTER_MAX = 1 << 23  # ids up to which a Bloom filter of them is sent along to spare shuffled sets
SEEDS = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, (4, 2), dtype=np.uint64)


def class_of(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def signatures(shingles: np.ndarray) -> list[int]:
    return [(mix(shingles ^ a).min(keepdims=True) * np.uint64(31) + mix(shingles ^ b).min(keepdims=True)).view(np.int64)[0].item() for a, b in SEEDS]


def histogram(shingles: np.ndarray) -> bytes:
    """Shingles in each class of hashes; about one class for eight shingles, a power of two."""
    bits = max(3, (len(shingles) // 8).bit_length())
    counts = np.bincount((mix(shingles ^ SEEDS[0, 0]) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8 if counts.max() < 256 else np.uint32).tobytes() + (b"\x01" if counts.max() < 256 else b"\x04")


def overlap_bound(x: bytes, y: bytes) -> int:
    """No smaller than the overlap of the sets with these histograms."""
    a, b = (np.frombuffer(h[:-1], np.uint8 if h[-1] == 1 else np.uint32).astype(np.int64) for h in (x, y))
    if len(a) > len(b):
        a, b = b, a
    return int(np.minimum(a, b.reshape(len(a), -1).sum(axis=1)).sum())


def least_overlap(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """100 * i >= 80 * (n + m - i), solved for i."""
    return -((-4 * (n + m)) // 9)


def prefix_length(n: int) -> int:
    return n - -((-4 * n) // 5) + 1


def _sets(batches, lower=True):
    """doc ids and shingle sets of the batches' texts."""
    for batch in batches:
        for at, t in chunks(batch.column(1), lower=lower):
            yield batch.column(0).slice(at, len(t)), t.shingle_sets(SIZE)


def bits_for(n: int) -> int:
    """So many bits deal n shingles into buckets; enough buckets for many tasks, few enough that tasks don't hand on crumbs."""
    return min(18, max(8, (n // BUCKET).bit_length()))


def flush_at(bits: int) -> int:
    return max(FLUSH, 64 << bits)


def _first_pass(docs: DataFrame, bits: int) -> DataFrame:
    """kind 0: a row for each document.  kind 1: counts of shingles by bucket, packed."""
    import pyarrow as pa

    names = ["kind", "doc_id", "n", "cls", "bucket", "keys", "counts"]
    shift, enough = np.uint64(64 - LOW_BITS - bits), flush_at(bits)

    def packed(found: list[np.ndarray]):
        keys, counts = np.unique(np.concatenate(found), return_counts=True)
        edges = np.searchsorted(keys >> np.uint64(LOW_BITS), np.arange((1 << bits) + 1, dtype=np.uint64))
        rows = [(b, keys[x:y], counts[x:y]) for b, (x, y) in enumerate(zip(edges, edges[1:])) if y > x]
        none = pa.nulls(len(rows))
        cols = [pa.array([1] * len(rows), pa.int32()), none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.int64())]
        cols += [pa.array([b for b, _, _ in rows], pa.int32()), pa.array([k.astype(np.uint32).tobytes() for _, k, _ in rows]), pa.array([c.astype(np.uint32).tobytes() if (c > 1).any() else b"" for _, _, c in rows])]
        return pa.RecordBatch.from_arrays(cols, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size, seen = [], 0, set()
        for ids, sets in _sets(batches):
            n, cls = [], []
            for s in sets:
                n.append(len(s))
                cls.append(class_of(s) if len(s) else None)
                if len(s) and cls[-1] not in seen:
                    seen.add(cls[-1])
                    found.append(s >> shift)
                    size += len(found[-1])
            none = pa.nulls(len(n))
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(n), pa.int32()), ids.cast(pa.int64()), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), none.cast(pa.int32()), *(none.cast(pa.binary()) for _ in range(2))], names)
            if size >= enough:
                yield packed(found)
                found, size, seen = [], 0, set()
        if size:
            yield packed(found)

    return docs.mapInArrow(run, "kind int, doc_id long, n long, cls long, bucket int, keys binary, counts binary")


def _hot(counts: DataFrame, saved: Saved) -> tuple[np.ndarray, np.ndarray]:
    """The frequent shingles' keys, sorted, at most HOT_SHINGLES; and those of them with long lists."""
    import pyarrow as pa

    def run(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k, np.uint32) for k in table["keys"].to_pylist()]
        weights = np.concatenate([np.frombuffer(c, np.uint32) if c else np.ones(len(k), np.uint32) for k, c in zip(keys, table["counts"].to_pylist())])
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        keys, weights = keys[order], weights[order].astype(np.int64)
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        df = np.add.reduceat(weights, at)
        often = df >= HOT_FROM
        return pa.table({"key": keys[at][often].astype(np.int64) | table["bucket"][0].as_py() << LOW_BITS, "df": df[often]})

    often = saved.keep(counts.select("bucket", "keys", "counts").groupBy("bucket").applyInArrow(run, "key long, df long"))
    sizes = sorted(often.groupBy(F.floor(F.log2("df") * 4).alias("step")).count().collect(), key=lambda r: -r["step"])
    least, total = None, 0
    for r in sizes:  # whole quarter powers of two of the frequency
        if total + r["count"] > HOT_SHINGLES:
            break
        least, total = r["step"], total + r["count"]
    found = np.zeros((0, 2), np.int64)
    if least is not None:
        got = often.where(F.floor(F.log2("df") * 4) >= least).toArrow()
        found = np.column_stack([got["key"].to_numpy(), got["df"].to_numpy()])
    saved.drop(often)
    keys = found[:, 0].astype(np.uint64)
    return np.sort(keys), np.sort(keys[found[:, 1] > LONG])


def _among(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(wanted):
        return np.zeros(len(keys), bool)
    return wanted[np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)] == keys


def _prefixes(docs: DataFrame, hot, bits: int) -> DataFrame:
    """A row for each class and task that met it: its first shingles in the global order, how many of all are
    not among the frequent ones, its minimum hashes and its histogram."""
    import pyarrow as pa

    shift = np.uint64(64 - LOW_BITS - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, seen = hot.value[0], set()
        for _, sets in _sets(batches):
            cls, n, cold, sigs, prefix, counts = [], [], [], [], [], []
            for s in sets:
                if not len(s) or (c := class_of(s)) in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(c)
                often = _among(s >> shift, frequent)
                cls.append(c)
                n.append(len(s))
                cold.append(int((~often).sum()))
                sigs.append(signatures(s))
                prefix.append(np.concatenate([s[~often], s[often]])[: prefix_length(len(s))].tobytes())
                counts.append(histogram(s))
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(n, pa.int64()), pa.array(cold, pa.int64()), pa.array(sigs, pa.list_(pa.int64())), pa.array(prefix, pa.binary()), pa.array(counts, pa.binary())], ["cls", "n", "cold", "sigs", "prefix", "histogram"])

    return docs.mapInArrow(run, "cls long, n long, cold long, sigs array<long>, prefix binary, histogram binary")


ENTRY = np.dtype([("shingle", "<u8"), ("cls", "<i8"), ("component", "<i8"), ("n", "<u4"), ("at", "<u4")])


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin in sorted columns, and the end."""
    new = np.zeros(len(columns[0]) + 1, bool)
    new[[0, -1]] = True
    for c in columns:
        new[1:-1] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _spread(lengths: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, number in the row) of that many items of each row, at most so many at a time."""
    ends = np.concatenate([[0], np.cumsum(lengths)])
    for start in range(0, int(ends[-1]), most):
        k = np.arange(start, min(start + most, int(ends[-1])))
        row = np.searchsorted(ends, k, "right") - 1
        yield row, k - ends[row]


def _may_link(n, at, m, other_at) -> np.ndarray:
    """Whether sets of these sizes may link when the shingle they share first stands at these positions."""
    return (5 * np.minimum(n, m) >= 4 * np.maximum(n, m)) & (np.minimum(n - at, m - other_at) >= least_overlap(n, m))


def pairs_of(e: np.ndarray) -> np.ndarray:
    """The different pairs of classes that the lists in these entries leave, with the smaller class first."""
    pairs = [np.zeros((0, 2), np.int64)]
    e = e[np.lexsort((e["component"], e["at"], e["n"], e["shingle"]))]
    lists = _runs(e["shingle"])
    several = np.minimum.reduceat(e["component"], lists[:-1]) != np.maximum.reduceat(e["component"], lists[:-1]) if len(e) else np.zeros(0, bool)
    e = e[np.repeat(several, np.diff(lists))]
    if not len(e):
        return pairs[0]
    # blocks of one size and position; those of a list stand together, by size
    block = _runs(e["shingle"], e["n"], e["at"])
    n, at, shingle = (e[c][block[:-1]].astype(np.int64) for c in ("n", "at", "shingle"))
    # a block's partners are of its size or larger, and no larger than its position allows
    of_list = np.cumsum(np.concatenate([[0], shingle[1:] != shingle[:-1]]))
    order = of_list * (1 << 33) + n
    last = np.searchsorted(order, of_list * (1 << 33) + np.maximum((5 * n - 9 * at) // 4, -1), "right")
    first = np.searchsorted(order, order, "left")
    mine = np.arange(len(n))
    for x, k in _spread(np.maximum(last - first, 0), PAIRS_AT_ONCE):
        y = first[x] + k
        fine = ((y >= x) | (n[y] > n[x])) & _may_link(n[x], at[x], n[y], at[y])
        x, y = x[fine], y[fine]
        # entries of block x against the whole of block y but those of the entry's own component
        for u, i in _spread(block[x + 1] - block[x], PAIRS_AT_ONCE):
            i = block[x[u]] + i
            to = y[u]
            same = to == mine[x[u]]
            of_component = _component_range(e["component"], block, to, e["component"][i])
            low, high = of_component
            for start, end in ((np.where(same, high, block[to]), np.where(same, high, low)), (high, block[to + 1])):
                for v, j in _spread(end - start, PAIRS_AT_ONCE):
                    a, b = e["cls"][i[v]], e["cls"][start[v] + j]
                    pairs.append(np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0))
            if len(pairs) > 16:
                pairs = [np.unique(np.concatenate(pairs), axis=0)]
    return np.unique(np.concatenate(pairs), axis=0)


def _component_range(component: np.ndarray, block: np.ndarray, of: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the wanted component's entries begin and end in each block, by bisection in all blocks at once."""

    def bisect(right: bool) -> np.ndarray:
        low, high = block[of].copy(), block[of + 1].copy()
        while (open_ := low < high).any():
            mid = (low + high) // 2
            value = component[np.minimum(mid, len(component) - 1)]
            up = open_ & ((value <= wanted) if right else (value < wanted))
            low = np.where(up, mid + 1, low)
            high = np.where(open_ & ~up, mid, high)
        return low

    return bisect(False), bisect(True)


def _entries(cls: list, component: list, n: list, prefixes: list) -> np.ndarray:
    sizes = [len(p) // 8 for p in prefixes]
    rows = np.empty(sum(sizes), ENTRY)
    rows["shingle"] = np.frombuffer(b"".join(prefixes), np.uint64)
    rows["cls"], rows["component"], rows["n"] = (np.repeat(np.array(x, np.int64), sizes) for x in (cls, component, n))
    rows["at"] = np.concatenate([np.arange(k) for k in sizes]) if sizes else []
    return rows


def _candidates(prefixes: DataFrame, hot, count_bits: int, bits: int, saved: Saved) -> DataFrame:
    """Pairs of classes of different components that share an indexed shingle and may have the overlap."""
    import pyarrow as pa

    columns, enough = ["cls", "component", "n", "prefix"], flush_at(bits) // 2
    shift = np.uint64(64 - LOW_BITS - count_bits)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            rows = np.concatenate(held)
            # mixed, as prefixes hold mostly the smallest hashes
            bucket = (mix(rows["shingle"].copy()) >> np.uint64(64 - bits)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            rows, bucket = rows[order], bucket[order]
            at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            return pa.RecordBatch.from_arrays([pa.array(bucket[at].astype(np.int32)), pa.array([x.tobytes() for x in np.split(rows, at[1:])], pa.binary())], ["bucket", "entries"])

        for batch in batches:
            rows = _entries(*(batch.column(i).to_pylist() for i in range(4)))
            rows = rows[~_among(rows["shingle"] >> shift, hot.value[1])]
            for start in range(0, len(rows), enough):
                held.append(rows[start : start + enough])
                size += len(held[-1])
                if size >= enough:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    def meet(table: pa.Table) -> pa.Table:
        e = np.concatenate([np.frombuffer(x, ENTRY) for x in table["entries"].to_pylist()])
        kinds = np.sort(e["shingle"])
        got = pairs_of(e[_among(e["shingle"], np.unique(kinds[1:][kinds[1:] == kinds[:-1]]))])
        return pa.table({"a": got[:, 0], "b": got[:, 1]})

    found = prefixes.select(*columns).mapInArrow(deal, "bucket int, entries binary").groupBy("bucket").applyInArrow(meet, "a long, b long")
    if len(hot.value[1]):
        found = found.union(_long_candidates(prefixes.select(*columns), hot, shift, saved))
    return found.distinct()


def _long_candidates(prefixes: DataFrame, hot, shift: np.uint64, saved: Saved) -> DataFrame:
    """The same for lists that are too long for one task: their entries are cut into blocks of similar sizes and
    positions, and pairs of blocks that may hold a link are work units of their own."""
    import pyarrow as pa

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _entries(*(batch.column(i).to_pylist() for i in range(4)))
            rows = rows[_among(rows["shingle"] >> shift, hot.value[1])]
            yield pa.RecordBatch.from_arrays([pa.array(rows[c].view(np.int64) if c == "shingle" else rows[c].astype(np.int64)) for c in ENTRY.names], list(ENTRY.names))

    def step(x: str, factor: float):
        return F.floor(F.log(F.greatest(F.col(x), F.lit(1))) / float(np.log(factor)))

    entries = prefixes.mapInArrow(listed, "shingle long, cls long, component long, n long, at long")
    entries = saved.keep(entries.withColumn("kind", step("n", 1.05) * 1000 + F.when(F.col("at") < 16, F.col("at")).otherwise(16 + step("at", 1.2))))
    by = ["shingle", "kind"]
    kinds = saved.keep(entries.groupBy(*by).agg(F.count("*").alias("size"), F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("at").alias("at"), F.min("component").alias("c0"), F.max("component").alias("c1")).withColumn("blocks", F.ceil(F.col("size") / LONG_BLOCK)))
    left, right = (kinds.select("shingle", *(F.col(c).alias(f"{side}_{c}") for c in kinds.columns[1:])) for side in "xy")
    met = left.join(right, "shingle").where(
        "x_kind <= y_kind and 5 * x_n1 >= 4 * y_n0 and 5 * y_n1 >= 4 * x_n0 and 9 * least(x_n1 - x_at, y_n1 - y_at) >= 4 * (x_n0 + y_n0)"
        " and not (x_c0 = x_c1 and y_c0 = y_c1 and x_c0 = y_c0)"
    )
    units = met.select("shingle", "x_kind", "y_kind", F.explode(F.sequence(F.lit(0).cast("long"), F.col("x_blocks") - 1)).alias("i"), "y_blocks")
    units = units.select("shingle", "x_kind", "y_kind", "i", F.explode(F.sequence(F.when(F.col("x_kind") == F.col("y_kind"), F.col("i")).otherwise(F.lit(0)), F.col("y_blocks") - 1)).alias("j"))
    unit = F.xxhash64("shingle", "x_kind", "y_kind", "i", "j").alias("unit")
    units = saved.keep(units.select("shingle", "x_kind", "y_kind", "i", "j", unit))
    asked = units.select("shingle", F.col("x_kind").alias("kind"), F.col("i").alias("block"), "unit").union(units.select("shingle", "y_kind", "j", "unit")).distinct()
    dealt = entries.join(kinds.select(*by, "blocks"), by).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")))

    def meet(table: pa.Table) -> pa.Table:
        e = np.empty(len(table), ENTRY)
        for c in ENTRY.names:
            x = table[c].to_numpy()
            e[c] = x.view(np.uint64) if c == "shingle" else x
        got = pairs_of(e)
        return pa.table({"a": got[:, 0], "b": got[:, 1]})

    return dealt.join(asked, [*by, "block"]).select("unit", *ENTRY.names).groupBy("unit").applyInArrow(meet, "a long, b long")


def _possible(pairs: DataFrame, histograms: DataFrame, saved: Saved) -> DataFrame:
    """Those of the pairs whose histograms allow the overlap."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m, x, y = (batch.column(k).to_pylist() for k in ("a", "b", "n", "m", "x", "y"))
            fine = [9 * overlap_bound(p, q) >= 4 * (i + j) and 5 * min(i, j) >= 4 * max(i, j) for i, j, p, q in zip(n, m, x, y)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(fine, pa.bool_()))

    left = histograms.select(F.col("cls").alias("a"), "n", F.col("histogram").alias("x"))
    right = histograms.select(F.col("cls").alias("b"), F.col("n").alias("m"), F.col("histogram").alias("y"))
    half = saved.keep(pairs.join(left, "a"))
    out = saved.keep(half.join(right, "b").mapInArrow(run, "a long, b long"))
    saved.drop(half)
    return out


def _overlaps(pairs: DataFrame, docs: DataFrame, saved: Saved) -> DataFrame:
    """a, b, their sizes n, m and both: the number of shingles they share."""
    import pyarrow as pa

    spark = docs.sparkSession
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    wanted = saved.keep(wanted)
    n = wanted.count()
    if not n:
        return spark.createDataFrame([], "a long, b long, n long, m long, both long")
    sent = None
    if n <= FILTER_MAX:  # else all sets are shuffled
        bits = 1 << max(6, (16 * n).bit_length())
        word = F.pmod(F.col("cls"), F.lit(bits // 32))
        rows = wanted.groupBy(word.alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(shiftright(cls, 40), 32) as int))")).alias("v")).collect()
        field = np.zeros(bits // 32, np.uint32)
        field[[r["w"] for r in rows]] = [r["v"] for r in rows]
        sent = spark.sparkContext.broadcast(field)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, seen = sent.value if sent else None, set()
        for _, sets in _sets(batches):
            cls, held = [], []
            for s in sets:
                if not len(s) or (c := class_of(s)) in seen:
                    continue
                if field is None or int(field[c % len(field)]) >> ((c >> 40) % 32) & 1:
                    if len(seen) < 1_000_000:
                        seen.add(c)
                    cls.append(c)
                    held.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(held, pa.binary())], ["cls", "shingles"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m, both = [], [], []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                n.append(len(s))
                m.append(len(t))
                both.append(int(_among(s, t).sum()))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *(pa.array(x, pa.int64()) for x in (n, m, both))], ["a", "b", "n", "m", "both"])

    sets = saved.keep(docs.mapInArrow(find, "cls long, shingles binary").join(wanted, "cls", "left_semi").groupBy("cls").agg(F.first("shingles").alias("shingles")))
    half = saved.keep(pairs.join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y")), "b"))
    out = saved.keep(half.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x")), "a").mapInArrow(compare, "a long, b long, n long, m long, both long"))
    saved.drop(wanted, sets, half)
    return out


LINKED = "100 * both >= 80 * (n + m - both)"


def _derived(pairs: DataFrame, near: DataFrame, sizes: DataFrame, docs: DataFrame, saved: Saved) -> DataFrame:
    """Links among the pairs, by their centres' answers.  near: overlaps of classes b with centres a.

    A set's shingles are its centre's, without those that only the centre has, and with those of its own; so the
    overlap of two sets differs from that of their centres by no more than these differences.
    """
    if pairs.isEmpty():
        return pairs
    centre = near.where(LINKED).groupBy("b").agg(F.max_by(F.struct("a", "n", "m", "both"), F.struct("both", "a")).alias("x"))
    centre = saved.keep(centre.select(F.col("b").alias("cls"), F.col("x.a").alias("centre"), (F.col("x.n") - F.col("x.both")).alias("less"), (F.col("x.m") - F.col("x.both")).alias("more")))
    held = pairs
    for side in "ab":
        own = centre.select(F.col("cls").alias(side), F.col("centre").alias(f"{side}_centre"), F.col("less").alias(f"{side}_less"), F.col("more").alias(f"{side}_more"))
        size = sizes.select(F.col("cls").alias(side), F.col("n").alias(f"{side}_n"))
        held = held.join(own, side, "left").join(size, side).withColumns({f"{side}_centre": F.coalesce(f"{side}_centre", side), f"{side}_less": F.coalesce(f"{side}_less", F.lit(0)), f"{side}_more": F.coalesce(f"{side}_more", F.lit(0))})
    held = saved.keep(held.withColumns({"p": F.least("a_centre", "b_centre"), "q": F.greatest("a_centre", "b_centre")}))
    asked = saved.keep(held.where("p <> q").select(F.col("p").alias("a"), F.col("q").alias("b")).distinct())
    answers = _overlaps(asked, docs, saved)
    told = held.join(answers.select(F.col("a").alias("p"), F.col("b").alias("q"), "both"), ["p", "q"])
    told = told.withColumns({"least": F.col("both") - F.col("a_less") - F.col("b_less"), "most": F.least(F.col("both") + F.col("a_more") + F.col("b_more"), "a_n", "b_n")})
    sure, may = (f"9 * {x} >= 4 * (a_n + b_n)" for x in ("least", "most"))
    told = saved.keep(told.select("a", "b", F.when(F.expr(sure), True).when(F.expr(f"not {may}"), False).alias("linked")))
    links = told.where("linked").select("a", "b")
    # centres that link connect what they stand for; sets of one centre are connected already
    links = saved.keep(links.union(answers.where(LINKED).select("a", "b")).distinct())
    open_ = told.where("linked is null").select("a", "b")
    if open_.isEmpty():
        return links
    known = saved.keep(components(near.where(LINKED).select("a", "b").union(links), saved))
    root = lambda side: known.select(F.col("node").alias(side), F.col("component").alias(f"{side}_root"))
    open_ = open_.join(root("a"), "a", "left").join(root("b"), "b", "left").where("coalesce(a_root, a) <> coalesce(b_root, b)").select("a", "b")
    open_ = saved.keep(open_)
    return saved.keep(links.union(_overlaps(open_, docs, saved).where(LINKED).select("a", "b")).distinct())


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, links): documents has doc_id, n_shingles, cls, component_id; links has classes a, b found similar.

    component_id: the smallest doc_id that links reach, the document's own included.  links connect all
    that is linked, but leave out pairs whose classes other links already connect.
    """
    spark = docs.sparkSession
    saved = Saved(spark)
    docs = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    words = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6  # about; it only deals the work
    bits = bits_for(words)

    first = saved.keep(_first_pass(docs, bits), by=["kind"])
    rows = saved.keep(first.where("kind = 0").select("doc_id", "n", "cls"))
    hot = spark.sparkContext.broadcast(_hot(first.where("kind = 1"), saved))
    saved.drop(first)
    prefixes = saved.keep(_prefixes(docs, hot, bits).groupBy("cls").agg(F.first(F.struct("n", "cold", "sigs", "prefix", "histogram")).alias("x")).select("cls", "x.*"))

    signed = saved.keep(prefixes.select("cls", "cold", F.posexplode("sigs").alias("k", "sig")))
    centres = saved.keep(signed.groupBy("k", "sig").agg(F.min(F.struct("cold", "cls")).alias("centre"), F.count("*").alias("size")).where("size > 1").select("k", "sig", F.col("centre.cls").alias("centre")))
    stars = signed.join(centres, ["k", "sig"]).where("cls != centre").select(F.col("centre").alias("a"), F.col("cls").alias("b")).distinct()
    near = _overlaps(_possible(saved.keep(stars), prefixes, saved), docs, saved)
    known = saved.keep(components(near.where(LINKED).select("a", "b"), saved))

    placed = saved.keep(prefixes.join(known.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls")))
    more = _derived(_possible(saved.keep(_candidates(placed, hot, bits, bits_for(words // 2), saved)), prefixes, saved), near, prefixes, docs, saved)
    links = near.where(LINKED).select("a", "b").union(more).distinct()
    parts = saved.keep(components(links, saved))
    saved.drop(prefixes, placed, signed, centres, known)

    classes = saved.keep(rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least")).join(parts.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls")))
    least = saved.keep(classes.groupBy("component").agg(F.min("least").alias("component_id")))
    named = saved.keep(classes.select("cls", "component").join(least, "component").select("cls", "component", "component_id"))
    linked = rows.where("n > 0").select("doc_id", "n", "cls").join(named, "cls").select("doc_id", F.col("n").alias("n_shingles"), "cls", "component", "component_id")
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), "cls", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    return linked.union(alone), links


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stand for their component: one row with its smallest id.

    Documents with an empty set stay, and so do rows without an id, which can't be told apart.  Where rows
    share an id, each component that they are in keeps one of them.
    """
    import pyarrow as pa

    saved = Saved(docs.sparkSession)
    placed = saved.keep(join(docs, id_col, text_col)[0].where("doc_id is not null"))
    ids = placed.groupBy("doc_id").agg(F.count("*").alias("rows"), F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stands"))
    name = lambda df: df.select(F.col("doc_id").alias(id_col))
    column = F.col(f"`{id_col}`")
    order = lambda df: df.select(*(F.col(f"`{c}`") for c in docs.columns))
    once = order(docs.where(column.isNotNull()).join(saved.keep(name(ids.where("rows = 1 and stands"))), id_col, "left_semi"))
    # rows that share an id are told apart by their sets
    several = docs.join(saved.keep(name(ids.where("rows > 1"))), id_col, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
    temp = "_cls"
    while temp in docs.columns:
        temp += "_"
    text_at, names = docs.columns.index(text_col), [*docs.columns, temp]

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls = [class_of(s) if len(s) else None for _, t in chunks(batch.column(text_at), lower=True) for s in t.shingle_sets(SIZE)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cls, pa.int64())], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", {temp} long"
    several = saved.keep(several.mapInArrow(classed, schema))
    stand = placed.where("doc_id = component_id and cls is not null").groupBy("doc_id", "component").agg(F.min("cls").alias("cls"))
    stand = saved.keep(stand.select(F.col("doc_id").alias(id_col), F.col("cls").alias(temp)))
    told = several.where(F.col(temp).isNotNull()).join(stand, [id_col, temp], "left_semi").dropDuplicates([id_col, temp])
    return once.union(order(told)).union(order(several.where(F.col(temp).isNull()))).union(docs.where(column.isNull()))
