"""Toxicity by class-conditional Kneser-Ney models of characters.

Two models, of toxic and of ordinary labelled documents, give each character a probability after the
ORDER - 1 before it: interpolated Kneser-Ney, each order smoothed by the continuation counts of the next
lower one (n-grams that begin with the blank before a word keep their whole counts, as those at the
beginning of a sentence do).  The lowest orders are one model of both classes together, so rare expressions
share backoff counts and cancel where neither class knows better.

A text's evidence is the difference of its words' two log-likelihoods over its length; as one expression in a
long text hardly moves that, the same over each of its words and pairs of words is looked at as well: the
largest, the mean of the five largest of different words, the mean excess over one half, and the largest
of a pair, whose second word's first characters are judged after the first word as well (in scripts without blanks a character is a word).  A logistic regression on labelled rows that the counts left out weighs these (and the length,
as a maximum grows with it); the scores then use counts that take in these rows as well.

Characters are the text's own: letters and marks of any script in lower case, digits as one, all else as
one blank.  What is counted grows with the labelled texts and is kept as tables.  The log ratios are sent to
the executors while there are at most SEND_ENTRIES; beyond that texts are dealt into chunks, the n-grams of
each chunk are joined with the table by shuffle, and a chunk's answers meet its texts.  Both ways give the
same scores.

The counts cover all labelled rows of the counting folds, whole texts of any length.  Null and empty texts
have no evidence and get the score of none.  Repeated rows give repeated results; a document labelled twice
counts with its larger label, and rows that share an id share its label.  Other columns are not looked at,
whatever their names.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mergeview.llm.tables import Saved

ORDER = 5
DISCOUNT = 0.75
PRIOR = 20.0  # counts after a context that a class takes from the next lower order
SHARED_ORDER = 2  # n-grams up to this size have one probability for both classes
FIT_ROWS = 50_000  # labelled rows at most, those of smallest hash, for the logistic regression
SEND_LABELS = 2_000_000  # labels up to which they are sent to the executors; beyond that they are joined by shuffle
SEND_ENTRIES = 1 << 23  # log ratios up to which they are sent, 12 bytes each
CHUNK = 2_000_000  # characters that a task looks at together
HELD = 3_000_000  # different n-grams that a task gathers before it hands them on
THRESHOLD = 0.3
FEATURES = 6
ACROSS = 2  # first characters of a word that are judged after the word before as well
BLANK = 32

_rng = np.random.Generator(np.random.PCG64(20250311))
PLACE_KEYS = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
CONTEXT = PLACE_KEYS[14]  # tells a context from the same characters as an n-gram
_lut: list[np.ndarray] = []


def _characters() -> np.ndarray:
    """What each code point counts as."""
    out = np.full(0x110000, BLANK, np.uint32)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind in "LM":
            out[cp] = cp
        elif kind == "N":
            out[cp] = 48
    return out


def characters(text: str) -> np.ndarray:
    """The text as it is counted, with one blank at each end and between words."""
    if not _lut:
        _lut.append(_characters())
    c = _lut[0][np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    c = np.concatenate([[BLANK], c, [BLANK]]).astype(np.uint32)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != BLANK) | (c[:-1] != BLANK)
    return c[keep]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ h >> np.uint64(32)
    h *= PLACE_KEYS[15]
    return h ^ h >> np.uint64(29)


def run_sums(rows: np.ndarray, most: int) -> list[np.ndarray]:
    """Item k: for each place that a run of k code points may end in, from the first on, what its hash is mixed from."""
    out = [np.zeros(0, np.uint64), rows * PLACE_KEYS[0] + np.uint64(1)]
    for k in range(2, most + 1):
        out.append(out[-1][1:] + (rows[: len(rows) - k + 1] * PLACE_KEYS[k - 1] + np.uint64(1)))
    return out


def hashes(rows: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` code points."""
    return _mixed(run_sums(rows, size)[size])


def padded(c: np.ndarray) -> np.ndarray:
    return np.concatenate([np.full(ORDER - 2, BLANK, np.uint64), c])  # c begins with a blank


def all_hashes(c: np.ndarray) -> np.ndarray:
    """The different n-grams of every size up to ORDER that ratios() may ask for."""
    p = padded(c)
    every = [_mixed(x) for x in run_sums(p, ORDER)[1:]]
    return np.unique(np.concatenate([*every, *(h ^ CONTEXT for h in every[SHARED_ORDER - 1 : -1])]))


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def gram_counts(labelled: DataFrame) -> DataFrame:
    """g, toxic, ordinary: how often each n-gram stands in documents of each class.  labelled: text, toxic."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # hash, n-gram, toxic, ordinary
        fresh: list[tuple[np.ndarray, int]] = []
        size = 0

        def merged() -> tuple[np.ndarray, ...]:
            h, g, one, two = (np.concatenate(x) for x in zip(*held))
            kinds, first, back = np.unique(h, return_index=True, return_inverse=True)
            return kinds, g[first], *(np.bincount(back, weights=x, minlength=len(kinds)).astype(np.int64) for x in (one, two))

        def counted() -> None:
            """The texts at hand become n-grams with counts."""
            nonlocal fresh, held, size
            p = [padded(c) for c, _ in fresh]
            h = np.concatenate([hashes(x, ORDER) for x in p])
            ends = np.cumsum([len(x) for x in p])
            lengths = np.array([len(x) - ORDER + 1 for x in p])
            at = np.arange(len(h)) + np.repeat((ends - lengths) - np.concatenate([[0], np.cumsum(lengths)[:-1]]) - (ORDER - 1), lengths)
            toxic = np.repeat([t for _, t in fresh], lengths)
            kinds, first, back = np.unique(h, return_index=True, return_inverse=True)
            one = np.bincount(back, weights=toxic, minlength=len(kinds)).astype(np.int64)
            g = np.concatenate(p).astype(np.uint32)[at[first][:, None] + np.arange(ORDER)]
            held.append((kinds, g, one, np.bincount(back, minlength=len(kinds)) - one))
            held, fresh, size = [merged()], [], 0

        def out() -> pa.RecordBatch:
            _, g, one, two = held.pop()
            text = np.ascontiguousarray(g).tobytes().decode("utf-32-le", "surrogatepass")
            return pa.RecordBatch.from_arrays([pa.array([text[i : i + ORDER] for i in range(0, len(text), ORDER)], pa.string()), pa.array(one), pa.array(two)], ["g", "toxic", "ordinary"])

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                c = characters(text.as_py() or "")
                if len(c) > 1:
                    fresh.append((c, toxic))
                    size += len(c)
                if size > CHUNK:
                    counted()
                    if len(held[0][0]) > HELD:
                        yield out()
        if fresh:
            counted()
        if held:
            yield out()

    return labelled.select("text", "toxic").mapInArrow(run, "g string, toxic long, ordinary long").groupBy("g").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def suffix_counts(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """s (each end of an n-gram), toxic, ordinary, both: what a Kneser-Ney model of that order counts.

    That is how often for whole n-grams and for those that begin with the blank before a word, as nothing else can
    stand there; for all others before how many different characters.
    """
    ends = F.explode(F.sequence(F.lit(1), F.lit(order))).alias("k")
    each = counts.select("g", "toxic", "ordinary", ends).select(F.expr("right(g, k)").alias("s"), F.expr(f"substring(g, {order} - k, if(k < {order}, 1, 0))").alias("before"), "toxic", "ordinary")
    each = each.groupBy("s", "before").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    kinds = lambda c: F.sum((F.col(c) > 0).cast("long"))
    each = each.groupBy("s").agg(*(F.sum(c).alias(f"whole_{c}") for c in ("toxic", "ordinary")), *(kinds(c).alias(f"kinds_{c}") for c in ("toxic", "ordinary")), F.count("*").alias("kinds_both"))
    whole = F.col("s").startswith(" ") | (F.length("s") == order)
    pick = lambda c: F.when(whole, F.col(f"whole_{c}")).otherwise(F.col(f"kinds_{c}")).alias(c)
    both = F.when(whole, F.col("whole_toxic") + F.col("whole_ordinary")).otherwise(F.col("kinds_both")).alias("both")
    return each.select("s", pick("toxic"), pick("ordinary"), both)


def log_ratios(counts: DataFrame, saved: Saved, order: int = ORDER, shared_order: int = SHARED_ORDER) -> DataFrame:
    """g, context, value.  An n-gram of any size up to order has the log of toxic over ordinary probability of its last
    character after the others; a context the log of the classes' weights of the next lower order, where what follows
    it is unseen."""
    import pyarrow as pa

    spark = counts.sparkSession
    tables = saved.keep(suffix_counts(counts, order))
    first = tables.where(F.length("s") == 1).select("s", "both").toArrow()  # a row for each different character
    total = sum(first["both"].to_pylist()) or 1
    lowest = spark.sparkContext.broadcast({c: n / total for c, n in zip(first["s"].to_pylist(), first["both"].to_pylist())})

    # own: what the count gives after its context; left: the context's weight of the next lower order
    after = Window.partitionBy(F.expr("left(s, length(s) - 1)"))  # as many rows as characters that follow
    shared = F.length("s") <= shared_order
    parts = tables.where(F.length("s") > 1)
    for c, name in (("toxic", "t"), ("ordinary", "o")):
        n = F.when(shared, F.col("both")).otherwise(F.col(c))
        prior = F.when(shared, F.lit(0.0)).otherwise(F.lit(PRIOR))
        sums, kinds = F.sum(n).over(after), F.sum((n > 0).cast("int")).over(after)
        parts = parts.withColumns({f"own_{name}": F.when(sums > 0, F.greatest(n - DISCOUNT, F.lit(0.0)) / (sums + prior)).otherwise(F.lit(0.0)), f"left_{name}": F.when(sums > 0, (DISCOUNT * kinds + prior) / (sums + prior)).otherwise(F.lit(1.0))})
    parts = saved.keep(parts.select("s", F.expr("right(s, 2)").alias("end"), "own_t", "left_t", "own_o", "left_o"))

    def chain(table: pa.Table) -> pa.Table:
        """Probabilities from short to long: all ends of an n-gram that are longer than one character end in the same two."""
        s, *numbers = (table[c].to_pylist() for c in ("s", "own_t", "left_t", "own_o", "left_o"))
        p, base = {}, lowest.value
        ratio = np.zeros(len(s))
        for i in sorted(range(len(s)), key=lambda i: len(s[i])):
            low_t, low_o = (base[s[i][1:]],) * 2 if len(s[i]) == 2 else p[s[i][1:]]
            own_t, left_t, own_o, left_o = (x[i] for x in numbers)
            p[s[i]] = t, o = own_t + left_t * low_t, own_o + left_o * low_o
            ratio[i] = np.log(t / o)
        return pa.table({"g": table["s"], "context": pa.array(np.zeros(len(s), bool)), "value": ratio})

    ratios = parts.groupBy("end").applyInArrow(chain, "g string, context boolean, value double")
    contexts = parts.where(F.length("s") > shared_order).groupBy(F.expr("left(s, length(s) - 1)").alias("g")).agg(F.first(F.log(F.col("left_t") / F.col("left_o"))).alias("value"))
    return ratios.union(contexts.select("g", F.lit(True), "value"))


def hashed(ratios: DataFrame, order: int = ORDER) -> DataFrame:
    """h, value: as texts look them up."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, h = batch.column(0).to_pylist(), np.zeros(len(batch), np.uint64)
            lengths = np.array([len(x) for x in text])
            for size in range(1, order + 1):
                at = np.flatnonzero(lengths == size)
                rows = np.frombuffer("".join(text[i] for i in at).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
                if len(at):
                    h[at] = hashes(rows, size)[::size]
            h[batch.column(1).to_numpy(zero_copy_only=False)] ^= CONTEXT
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(2).cast(pa.float32())], ["h", "value"])

    return ratios.select("g", "context", "value").mapInArrow(run, "h long, value float")


class Table:
    """Hash -> value, over whole arrays.  A slot holds the lower half of a hash beside the value; the upper bits say where it stands."""

    def __init__(self, h: np.ndarray, value: np.ndarray):
        bits = max(4, (len(h) * 4 // 3).bit_length())
        self.shift, self.mask, self.slots = np.uint64(64 - bits), (1 << bits) - 1, np.zeros(1 << bits, np.uint64)
        entry = (h | np.uint64(1)) << np.uint64(32) | value.astype(np.float32).view(np.uint32)
        at, left = (h >> self.shift).astype(np.int64), np.arange(len(h))
        while len(left):  # the first of those that want a free slot takes it, the others go on to the next
            free = left[self.slots[at[left]] == 0]
            _, first = np.unique(at[free], return_index=True)
            self.slots[at[free[first]]] = entry[free[first]]
            left = left[self.slots[at[left]] != entry[left]]
            at[left] = at[left] + 1 & self.mask

    def of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, of any kind where there is none, and which were found."""
        at = (h >> self.shift).astype(np.int64)
        own = (h | np.uint64(1)) & np.uint64(0xFFFFFFFF)
        got = self.slots[at]
        found = got >> np.uint64(32) == own
        late = np.flatnonzero(~found & (got != 0))
        while len(late):
            at[late] = at[late] + 1 & self.mask
            next_ = self.slots[at[late]]
            hit = next_ >> np.uint64(32) == own[late]
            got[late[hit]], found[late[hit]] = next_[hit], True
            late = late[~hit & (next_ != 0)]
        return got.astype(np.uint32).view(np.float32), found

    def ratios(self, own: list[np.ndarray], ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For the n-grams of these sizes that end there: the log ratio of the longest end of each that was seen, and the
        weights of the contexts passed on the way.  own: the run_sums() of the text."""
        out, sizes = np.zeros(len(ends)), sizes.copy()
        for size in range(ORDER, 0, -1):
            k = np.flatnonzero(sizes == size)
            if not len(k):
                continue
            last = ends[k] - (size - 1)  # where the run begins, which numbers them
            value, found = self.of(_mixed(own[size][last]))
            out[k[found]] += value[found]
            k, last = k[~found], last[~found]
            sizes[k] -= 1
            if size > SHARED_ORDER and len(k):
                value, found = self.of(_mixed(own[size - 1][last]) ^ CONTEXT)  # all but the last character
                out[k[found]] += value[found]
        return out


def _alone(c: np.ndarray) -> np.ndarray:
    """Characters of scripts without blanks between words, each a word of its own: Thai, Lao, Han, kana, Yi and the like."""
    return ((c >= 0x0E00) & (c < 0x0F00)) | ((c >= 0x2E80) & (c < 0xA4D0)) | (c >= 0x20000)


def evidence(text: str, table: Table) -> tuple[float, ...]:
    """Length-normalised differences of log-likelihoods: of the whole text; the words' largest, mean of five largest, mean
    excess; the largest of two neighbouring words; and the logarithm of the length."""
    c = characters(text)
    if len(c) < 2:
        return (0.0,) * FEATURES
    p = padded(c)
    last = np.arange(ORDER - 1, len(p))  # where each character after the first blank stands
    places = np.arange(len(p))
    blank = np.maximum.accumulate(np.where(p == BLANK, places, 0))  # the last one up to each place
    inside = np.minimum(last - blank[last - 1] + 1, ORDER)
    own = run_sums(p, ORDER)
    v = table.ratios(own, last, inside)
    w = v.copy()
    reach = np.flatnonzero(inside <= ACROSS + 1)  # a word's first characters, with what the words before add
    w[reach] = table.ratios(own, last[reach], np.full(len(reach), ORDER))
    ends = np.flatnonzero((c[1:] == BLANK) | _alone(c[1:]))  # a word ends with the blank after it
    starts = np.concatenate([[0], ends[:-1] + 1])
    sums, sizes = np.add.reduceat(v, starts), ends + 1 - starts
    words = sums / sizes
    top, different = [], set()
    for i in np.argsort(-words, kind="stable"):  # the largest of different words
        if (word := c[1 + starts[i] : 1 + ends[i]].tobytes()) not in different:
            different.add(word)
            top.append(words[i])
            if len(top) == 5:
                break
    pairs = ((np.add.reduceat(w, starts)[1:] + sums[:-1]) / (sizes[1:] + sizes[:-1])).max() if len(words) > 1 else words[0]
    return float(v.mean()), float(top[0]), float(sum(top) / 5), float(np.maximum(words - 0.5, 0).mean()), float(pairs), float(np.log1p(len(v)))


_tables: dict[str, Table] = {}


def _features(rows: DataFrame, ratios: DataFrame, saved: Saved, extra: str) -> DataFrame:
    """rows: the columns of `extra`, then text.  ratios: h, value."""
    import pyarrow as pa

    names = [*(x.split()[0] for x in extra.split(", ")), *(f"f{i}" for i in range(FEATURES))]
    schema = f"{extra}, " + ", ".join(f"f{i} double" for i in range(FEATURES))
    columns = names[:-FEATURES]

    def measured(texts, own: list, table: Table) -> list:
        got = [evidence(x.as_py() or "", table) for x in texts]
        return [*own, *(pa.array([g[i] for g in got], pa.float64()) for i in range(FEATURES))]

    ratios = saved.keep(ratios)
    if ratios.count() <= SEND_ENTRIES:
        got = ratios.toArrow()
        sent = rows.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, got["h"].to_numpy().view(np.uint64), got["value"].to_numpy()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            name, *parts = sent.value
            if name not in _tables:
                _tables.clear()
                _tables[name] = Table(*parts)
            for batch in batches:
                yield pa.RecordBatch.from_arrays(measured(batch.columns[-1], batch.columns[:-1], _tables[name]), names)

        return rows.mapInArrow(run, schema)

    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    dealt = saved.keep(rows.withColumn("_chunk", F.pmod(F.xxhash64(*columns, "text"), F.lit(1 + size // CHUNK))))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The different n-grams and contexts of the texts at hand, by chunk."""
        for batch in batches:
            by: dict[int, list[np.ndarray]] = {}
            for chunk, text in zip(batch.column(1).to_pylist(), batch.column(0)):
                c = characters(text.as_py() or "")
                if len(c) > 1:
                    by.setdefault(chunk, []).append(all_hashes(c))
            for chunk, found in by.items():
                h = np.unique(np.concatenate(found)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), chunk, np.int64)), pa.array(h)], ["_chunk", "h"])

    answers = dealt.select("text", "_chunk").mapInArrow(ask, "_chunk long, h long").distinct().join(ratios, "h").select("_chunk", "h", "value")

    def answered(texts: pa.Table, known: pa.Table) -> pa.Table:
        table = Table(known["h"].to_numpy().view(np.uint64), known["value"].to_numpy())
        return pa.table(measured(texts["text"], [texts[c] for c in columns], table), names)

    return dealt.groupBy("_chunk").cogroup(answers.groupBy("_chunk")).applyInArrow(answered, schema)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, np.ndarray]:
    """Intercept and weights for features as they are."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / spread])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z.T * (p * (1 - p))) @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, z.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] - (w[1:] * mean / spread).sum()), w[1:] / spread


def score(docs: DataFrame, labels: DataFrame, held_out_fold: int = 2, fit_fold: int = 3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", features: tuple[int, ...] = tuple(range(FEATURES))) -> DataFrame:
    """doc_id, held_out, score, predicted.  Only rows of labels outside the held-out fold are read for training.

    features: which of evidence()'s numbers are weighed; (0,) is the difference over the whole text alone.
    """
    spark = docs.sparkSession
    saved = Saved(spark)
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    labels = labels.select(labels["doc_id"], labels[label_col].cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(fold(F.col("doc_id")) != held_out_fold)
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if labels.count() <= SEND_LABELS:
        labels = F.broadcast(labels)
    training = docs.where(fold(F.col("doc_id")) != held_out_fold).join(labels, "doc_id")
    counting, fitting = training.where(fold(F.col("doc_id")) != fit_fold), training.where(fold(F.col("doc_id")) == fit_fold)
    some, rest = (saved.keep(gram_counts(x)) for x in (counting, fitting))

    measured = _features(fitting.select(F.xxhash64("doc_id", "text").alias("h"), "toxic", "text"), hashed(log_ratios(some, saved)), saved, "h long, toxic int")
    used = [f"f{i}" for i in features]
    known = np.array(measured.orderBy("h", "toxic", *used).limit(FIT_ROWS).select("toxic", *used).collect(), float).reshape(-1, 1 + len(used))
    y = known[:, 0]
    if 0 < y.sum() < len(y):
        intercept, weights = fit_logistic(known[:, 1:], y)
    else:  # one class or no rows: nothing to tell apart
        rate = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.01
        intercept, weights = float(np.log(rate / (1 - rate))), np.zeros(len(used))
    every = some.union(rest).groupBy("g").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    logit = F.lit(intercept)
    for f, w in zip(used, weights):
        logit = logit + F.col(f) * float(w)
    out = _features(docs, hashed(log_ratios(every, saved)), saved, "doc_id long").withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), logit)))))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == held_out_fold, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
