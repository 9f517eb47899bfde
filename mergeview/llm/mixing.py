"""Mixing sources to target weights by Pfair scheduling.

The documents of a source are cut into blocks.  Block k of a source with weight w may take a slot from
its release floor(k / w) and has to take one before its deadline ceil((k + 1) / w); earliest deadline
first then fills every slot, and in each prefix of the schedule a source has less than one block more
or less than its weight times the prefix's length.

Weights are exact: whole numbers in the very proportion of the given ones, however large, never rounded
to a period.  The driver steps through the blocks, a number of each source in memory, and notes what each
source has been served before each window of WINDOW slots; tasks fill the windows side by side from
there.  Placing documents is a join with the table of blocks and slots.

Every document gets one place, so a source ends once its blocks are used up.  The schedule then goes on,
in a further phase, among the sources that are left, with their weights in proportion.  Sources are the
rows of a small table: one for each name.  A null source is a source of its own.  Repeated documents
have places of their own; null ids and texts are kept, and texts of any length weigh the same.  Columns of
the table are kept; where it has a column block, slot or place, that of the schedule has a _ behind its name.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
import math
from collections.abc import Iterator, Mapping
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mergeview.llm.tables import Saved, importable

BLOCK = 16  # documents of a block
PERIOD = 2_000  # slots of a period of rounded shares
WINDOW = 4_096  # slots that a task fills from a noted state, at least
CHUNK = 4_096  # documents that are numbered together, about
SLOTS_SENT = 1 << 18  # blocks up to which their table is sent to the executors; a longer one is joined by shuffle
NO_SOURCE = "null"
TEMPERATURE = 0.7  # of the default weights: a source's number of documents to this power


def shares(weights: Mapping[str, float], period: int = PERIOD) -> dict[str, int]:
    """Whole shares of a short period, at least one each, nearly in proportion to the weights (largest remainders).

    For a table of one period that is to be repeated; mix() takes exact_shares().
    """
    names = sorted(weights)
    period = max(period, 2 * len(names))
    total = sum(weights[s] for s in names)
    if not names or total <= 0 or min(weights.values()) < 0:
        raise ValueError("weights must be positive")
    exact = {s: weights[s] / total * (period - len(names)) for s in names}
    out = {s: 1 + int(exact[s]) for s in names}
    for s in sorted(names, key=lambda s: (int(exact[s]) - exact[s], s))[: period - sum(out.values())]:
        out[s] += 1
    return out


def exact_shares(weights: Mapping[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the proportion of the weights."""
    if not weights or min(weights.values()) <= 0:
        raise ValueError("weights must be positive")
    parts = {s: Fraction(weights[s]) for s in sorted(weights)}
    scale = math.lcm(*(x.denominator for x in parts.values()))
    whole = {s: int(x * scale) for s, x in parts.items()}
    common = math.gcd(*whole.values())
    return {s: a // common for s, a in whole.items()}


def edf(share: Mapping[str, int], start: int = 0, before: Mapping[str, int] | None = None) -> Iterator[tuple[str, int]]:
    """(source, number of its block) for each slot from start, by earliest deadline first among released blocks.

    before: blocks of each source in the slots before start.
    """
    period = sum(share.values())
    name = sorted(share)
    release = lambda i, k: k * period // share[name[i]]
    deadline = lambda i, k: -(-(k + 1) * period // share[name[i]])
    waiting = [(max(start, release(i, k)), i, k) for i, k in enumerate(before[s] if before else 0 for s in name)]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    for slot in itertools.count(start):
        while waiting and waiting[0][0] <= slot:
            _, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline(i, k), i, k))
        due, i, k = heapq.heappop(ready)
        assert due > slot, "a deadline is missed only if the shares exceed the period"
        yield name[i], k
        heapq.heappush(waiting, (max(slot + 1, release(i, k + 1)), i, k + 1))


def period_slots(share: Mapping[str, int]) -> list[tuple[str, int]]:
    """The slots of a whole period, after which every source has exactly its share."""
    return list(itertools.islice(edf(share), sum(share.values())))


def phases(blocks: Mapping[str, int], weights: Mapping[str, float], window: int = WINDOW) -> list[dict]:
    """For each phase: first slot, slots, slots of a window, exact shares and their sum (period), and per source
    first block, blocks (used) and those before each window (served).

    A phase ends when a source's blocks do.  Sources of weight zero wait for all others and then are equals.
    """
    if blocks and (min(weights[s] for s in blocks) < 0 or sum(weights[s] for s in blocks) <= 0):
        raise ValueError("weights must be positive")
    exact = exact_shares({s: weights[s] for s in blocks if weights[s] > 0}) if blocks else {}
    left, done, slot, out = {s: n for s, n in blocks.items() if n > 0}, dict.fromkeys(blocks, 0), 0, []
    while left:
        share = {s: exact[s] for s in left if s in exact} or dict.fromkeys(left, 1)
        width = max(window, 16 * len(share))
        used, served = dict.fromkeys(share, 0), []
        for end, (s, _) in enumerate(edf(share)):
            if end % width == 0:
                served.append(dict(used))
            used[s] += 1
            if used[s] == left[s]:
                break
        out.append({"slot": slot, "slots": end + 1, "window": width, "period": sum(share.values()), "share": share, "first": {s: done[s] for s in share}, "used": used, "served": served})
        for s in share:
            done[s] += used[s]
            left[s] -= used[s]
            if not left[s]:
                del left[s]
        slot += end + 1
    return out


def block_slots(phase: dict, window: int) -> list[tuple[str, int, int]]:
    """(source, block, slot) of a phase's window."""
    start = window * phase["window"]
    steps = itertools.islice(edf(phase["share"], start, phase["served"][window]), min(phase["window"], phase["slots"] - start))
    return [(s, phase["first"][s] + k, phase["slot"] + start + i) for i, (s, k) in enumerate(steps)]


def schedule_columns(columns: list[str]) -> list[str]:
    """Names of block, slot and place beside these columns."""
    out = []
    for name in ("block", "slot", "place"):
        while name in columns:
            name += "_"
        out.append(name)
    return out


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, block: int = BLOCK, period: int = WINDOW, seed: int = 0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs with block (number in its source), slot (of the block) and place (of the document in the mix).

    The order inside a source is by a hash of id and text.  weights: per source, for instance from
    a training plan; without, the sources' numbers of documents to the power TEMPERATURE.  period: slots
    of a window, which doesn't change the result.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    importable(spark)
    saved = Saved(spark)
    source = F.coalesce(F.concat(F.lit("="), F.col(f"`{source_col}`").cast("string")), F.lit(NO_SOURCE))  # null is a source, too
    order = F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    slim = saved.keep(docs.select(source.alias("s"), order.alias("o")))
    # numbers in a source: those of a chunk of hashes, after the counts of the chunks before
    n = slim.count()
    bits = max(0, (n // CHUNK).bit_length())
    chunk = F.shiftrightunsigned(F.col("o"), 64 - bits).cast("long") if bits else F.lit(0).cast("long")
    counts = slim.groupBy("s", chunk.alias("c")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("s").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    offsets = saved.keep(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))))
    totals = {r["s"]: r["n"] for r in offsets.groupBy("s").agg(F.sum("n").alias("n")).collect()}  # a row for each source
    if weights is None:
        weights = {s: m**TEMPERATURE for s, m in totals.items()}
    else:
        weights = {NO_SOURCE if s is None else f"={s}": w for s, w in weights.items()}
    if missing := totals.keys() - weights.keys():
        raise ValueError(f"no weight for sources {sorted(missing)}")
    plan = phases({s: -(-m // block) for s, m in totals.items()}, weights, period)

    firsts = list(itertools.accumulate((len(x["served"]) for x in plan), initial=0))  # number of each phase's first window
    parts = max(1, min(firsts[-1], 8 * spark.sparkContext.defaultParallelism))
    sent = spark.sparkContext.broadcast(plan)  # a number for each source and window

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                p = bisect.bisect_right(firsts, i) - 1
                s, b, slot = zip(*block_slots(sent.value[p], i - firsts[p]))
                yield pa.RecordBatch.from_arrays([pa.array(s, pa.string()), pa.array(b, pa.int64()), pa.array(slot, pa.int64())], ["s", "b", "slot"])

    # numbers from range(): rows of the driver's own would take Python workers of another kind, which stay beside these
    slots = saved.keep(spark.range(0, firsts[-1], 1, parts).mapInArrow(deal, "s string, b long, slot long"))

    columns = docs.columns
    names = [f"_c{i}" for i in range(len(columns))]
    rows = docs.select(*(F.col(f"`{c}`").alias(x) for c, x in zip(columns, names)), source.alias("_s"), order.alias("o")).withColumn("_c", F.shiftrightunsigned(F.col("o"), 64 - bits).cast("long") if bits else F.lit(0).cast("long"))
    own = Window.partitionBy("_s", "_c").orderBy("o", *names[:1])
    rows = rows.withColumn("_n", F.row_number().over(own) - 1)
    offsets = offsets.select("s", "c", "before")
    rows = rows.join(offsets, (F.col("_s") == F.col("s")) & (F.col("_c") == F.col("c"))).withColumn("_n", F.col("_n") + F.col("before")).drop("s", "c", "before")
    rows = rows.withColumn("_b", F.floor(F.col("_n") / block))
    send = F.broadcast if sum(x["slots"] for x in plan) <= SLOTS_SENT else (lambda df: df)
    slots = slots.select("s", "b", F.col("slot").alias("_slot"))
    rows = rows.join(send(slots), (F.col("_s") == F.col("s")) & (F.col("_b") == F.col("b")))
    slot = F.col("_slot")
    schedule = zip((F.col("_b"), slot, slot * block + F.col("_n") % block), schedule_columns(columns))
    return rows.select(*(F.col(x).alias(c) for c, x in zip(columns, names)), *(x.alias(c) for x, c in schedule))
