"""Words, lines and word windows of many texts at once, as array operations over their UTF-8 bytes.

A word is a run of bytes other than 0x20 and 0x09-0x0D, so it is the same over bytes and over code
points.  Words, windows of words and lines are known by 64-bit hashes: two different ones share a hash
with a probability of about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

CHUNK_BYTES = 250_000  # bytes of text that are looked at together; a worker holds about 100 bytes for each

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_KEYS = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BASE = int(_rng.integers(1, 1 << 63, dtype=np.uint64)) | 1
INVERSE = pow(BASE, -1, 1 << 64)
PLACE_KEYS = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all bits."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


_powers = {BASE: np.ones(1, np.uint64), INVERSE: np.ones(1, np.uint64)}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    if len(_powers[base]) < n:
        steps = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


@dataclass
class Texts:
    """The words of some texts.  starts, ends: byte positions; first[d]: index of text d's first word."""

    data: np.ndarray
    offsets: np.ndarray
    lower: bool
    starts: np.ndarray = field(init=False)
    ends: np.ndarray = field(init=False)
    first: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.in_word = ~SPACE[self.data]
        n = len(self.data)
        begins = np.zeros(n + 1, bool)
        begins[self.offsets] = True
        after_gap = np.ones(n, bool)
        after_gap[1:] = ~self.in_word[:-1]
        before_gap = np.ones(n, bool)
        before_gap[:-1] = ~self.in_word[1:]
        self.starts = np.flatnonzero(self.in_word & (after_gap | begins[:-1]))
        self.ends = np.flatnonzero(self.in_word & (before_gap | begins[1:])) + 1
        self.first = np.searchsorted(self.starts, self.offsets)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def running(self, values: np.ndarray) -> np.ndarray:
        """Sum of a value of each byte over each text."""
        return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[self.offsets])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of the bytes of each span."""
        if not hasattr(self, "_sums"):
            keys = BYTE_KEYS[LOWER] if self.lower else BYTE_KEYS
            self._sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(keys[self.data] * powers(BASE, len(self.data)), out=self._sums[1:])
        return mix((self._sums[ends] - self._sums[starts]) * powers(INVERSE, len(self.data) + 1)[starts])

    def words(self) -> np.ndarray:
        if not hasattr(self, "_words"):
            self._words = self.spans(self.starts, self.ends)
        return self._words

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of each run of `size` words inside a text, and first[d] for them."""
        w, n = self.words(), self.n_words
        total = max(0, len(w) - size + 1)
        h = np.zeros(total, np.uint64)
        for k in range(size):
            h += w[k : k + total] * PLACE_KEYS[k]
        inside = np.ones(total, bool)
        for k in range(1, size):  # windows that begin in a text's last words reach into the next
            at = self.first[1:] - k
            at = at[(k <= n) & (at < total)]
            inside[at] = False
        counts = np.maximum(n - size + 1, 0)
        return mix(h[inside]), np.concatenate([[0], np.cumsum(counts)])

    def shingle_sets(self, size: int) -> Iterator[np.ndarray]:
        """The sorted distinct windows of each text; a shorter text's words are one window."""
        h, first = self.windows(size)
        n, w = self.n_words, self.words()
        for d in range(len(self)):
            if n[d] >= size:
                got = np.sort(h[first[d] : first[d + 1]])
                fresh = np.ones(len(got), bool)
                np.not_equal(got[1:], got[:-1], out=fresh[1:])
                yield got[fresh]
            elif n[d]:
                own = w[self.first[d] : self.first[d + 1]]
                yield mix((own * PLACE_KEYS[: len(own)]).sum(dtype=np.uint64, keepdims=True) + PLACE_KEYS[-len(own)])
            else:
                yield np.zeros(0, np.uint64)


def chunks(column, lower: bool) -> Iterator[tuple[int, Texts]]:
    """An Arrow string column (null: empty) in runs of texts of about CHUNK_BYTES: index of the first, and the texts."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "").cast(pa.large_binary())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        yield at, Texts(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], lower)
        at = to
