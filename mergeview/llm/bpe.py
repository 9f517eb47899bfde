"""Byte-level BPE encoding and decoding.

A text is cut by the vocabulary's pattern; every piece is merged on its own.  A segment tree over the
piece's byte positions holds, per node, the smallest rank of a mergeable neighbour pair below it; ties
go left.  One merge reads the root, walks down to the leftmost minimum and makes point updates on the
live neighbours only, so a piece of n bytes costs O(n log n) even if it is a whole document long.

Spark deals out the documents; a task keeps a bounded memo of pieces it has met.  Null text is empty
text: no tokens and the digests of the empty string.  Repeated rows give repeated results.  Columns to pass
through may not have the names of results; others are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame

MEMO_PIECES = 250_000  # pieces a worker remembers; the memo starts anew beyond it
MEMO_BYTES = 64  # longer pieces aren't remembered
CHUNK = 1_000_000  # characters cut into pieces at a time
NONE = 1 << 60  # rank of a pair that doesn't merge
NO_ID = (1 << 31) - 1  # the same in 32 bits


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: merge the pair of lowest rank, the leftmost of equals, until none is left."""
    if piece in ranks:
        return [ranks[piece]]
    n, rank = len(piece), ranks.get
    size = 1 << (n - 1).bit_length()
    tree = [NONE] * (2 * size)
    for i in range(n - 1):
        tree[size + i] = rank(piece[i : i + 2], NONE)
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a <= b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # live neighbours

    def put(i: int, value: int) -> None:
        i += size
        tree[i] = value
        while i > 1:
            a, b = tree[i], tree[i ^ 1]
            i >>= 1
            low = a if a <= b else b
            if tree[i] == low:
                return
            tree[i] = low

    while tree[1] != NONE:
        low, i = tree[1], 1
        while i < size:
            i *= 2
            if tree[i] != low:
                i += 1
        i -= size
        gone = after[i]
        end = after[gone]
        after[i] = end
        put(gone, NONE)
        if end < n:
            before[end] = i
            put(i, rank(piece[i : after[end]], NONE))
        else:
            put(i, NONE)
        if (left := before[i]) >= 0:
            put(left, rank(piece[left:end], NONE))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


LATIN = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"  # the letters below U+0250
OUTSIDE = re.compile("[^\x00-\x1b\x20-\u00b1\u00b4-\u00b8\u00ba\u00bb\u00bf-\u024f]")  # what narrow() can't judge


def narrow(pattern: str) -> str:
    """The same pattern for texts without a match of OUTSIDE, spelt so that the standard library's faster engine reads it."""
    return pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{LATIN}0-9]").replace(r"\p{L}", f"[{LATIN}]").replace(r"\p{N}", "[0-9]")


class Pairs:
    """(left id, right id) -> id of the merged token, over whole arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        found = sorted((ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks)
        self.keys = np.array([k for k, _ in found] or [-1], np.int64)
        self.ids = np.array([r for _, r in found] or [NO_ID], np.int32)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ids[at], NO_ID)


def merge_many(pieces: list[bytes], byte_ids: np.ndarray, pairs: Pairs) -> list[list[int]]:
    """merge() for many short pieces at once: a row of the matrices is a piece, with a segment tree of its own."""
    size = 1 << max(1, (max(map(len, pieces)) - 1).bit_length())
    k, levels = len(pieces), size.bit_length() - 1
    lengths = np.fromiter(map(len, pieces), np.int64, k)
    real = np.arange(size + 1) < lengths[:, None]  # the last column stands for "past the end" and "before the start"
    ids = np.full((k, size + 1), -1, np.int32)
    ids[real] = byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
    after = np.where(np.arange(1, size + 2) < lengths[:, None], np.arange(1, size + 2), size)
    before = np.tile(np.arange(-1, size), (k, 1))
    before[:, 0] = size
    tree = np.full((k, 2 * size), NO_ID, np.int32)
    tree[:, size:-1] = np.where(real[:, 1:size], pairs.of(ids[:, : size - 1], ids[:, 1:size]), NO_ID)
    for i in range(size - 1, 0, -1):
        np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1], out=tree[:, i])
    while len(row := np.flatnonzero(tree[:, 1] < NO_ID)):
        low, i = tree[row, 1], np.ones(len(row), np.int64)
        for _ in range(levels):  # down to the leftmost minimum
            i *= 2
            i += tree[row, i] != low
        i -= size
        gone = after[row, i]
        end, left = after[row, gone], before[row, i]
        ids[row, i], real[row, gone], after[row, i], before[row, end] = low, False, end, i
        tree[row, size + gone] = NO_ID
        tree[row, size + i] = np.where(end < size, pairs.of(low, ids[row, end]), NO_ID)
        has = left < size
        tree[row[has], size + left[has]] = pairs.of(ids[row[has], left[has]], low[has])
        for at in (gone, i, np.where(has, left, i)):  # the live neighbours' paths to the root
            at = at + size
            for _ in range(levels):
                at >>= 1
                tree[row, at] = np.minimum(tree[row, 2 * at], tree[row, 2 * at + 1])
    flat, ends = ids[real].tolist(), np.cumsum(real.sum(axis=1)).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


class Codec(dict):
    """Piece -> its ids in decimal, joined by spaces.  A dict, so that known pieces cost one look-up."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        self.ranks = load_ranks(path)
        self.find_any = regex.compile(pattern).findall
        self.find_latin = re.compile(small).findall if "\\p" not in (small := narrow(pattern)) else self.find_any
        self.bytes_of = {str(v): k for k, v in self.ranks.items()}
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.pairs = Pairs(self.ranks)

    def __missing__(self, piece: str) -> str:
        return " ".join(map(str, merge(piece.encode("utf-8", "surrogatepass"), self.ranks)))

    def learn(self, pieces: set[str]) -> None:
        """Put the short ones of these pieces into the memo."""
        if len(self) + len(pieces) > MEMO_PIECES:
            self.clear()
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            if (known := self.ranks.get(raw)) is not None:
                self[piece] = str(known)
            elif len(raw) <= MEMO_BYTES:
                by_size.setdefault((len(raw) - 1).bit_length(), []).append((piece, raw))
        for some in by_size.values():
            for at in range(0, len(some), 4096):
                part = some[at : at + 4096]
                for (piece, _), ids in zip(part, merge_many([raw for _, raw in part], self.byte_ids, self.pairs)):
                    self[piece] = " ".join(map(str, ids))

    def find(self, text: str) -> list[str]:
        return self.find_any(text) if OUTSIDE.search(text) else self.find_latin(text)

    def encode_all(self, texts: list[str]) -> Iterator[str]:
        """Ids of each text, about CHUNK characters at a time."""
        at = 0
        while at < len(texts):
            cut, size = [], 0
            while at < len(texts) and (not cut or size < CHUNK):
                cut.append(self.find(texts[at]))
                size += len(texts[at])
                at += 1
            self.learn(set().union(*cut).difference(self))
            for pieces in cut:
                yield " ".join(map(self.__getitem__, pieces))

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(" "))) if ids else b""


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker and vocabulary."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip and, if asked for, the ids themselves and columns of docs."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            n, ids_sha, decoded_sha, same, lists = [], [], [], [], []
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for text, ids in zip(texts, own.encode_all(texts)):
                decoded = own.decode(ids)
                n.append(ids.count(" ") + 1 if ids else 0)
                ids_sha.append(sha(ids.encode()))
                decoded_sha.append(sha(decoded))
                same.append(decoded == text.encode("utf-8", "surrogatepass"))
                if with_ids:
                    lists.append(np.fromstring(ids, np.int32, sep=" ") if ids else np.zeros(0, np.int32))
            out = [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string()), pa.array(same, pa.bool_())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"]
            if with_ids:
                ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
                out, names = [*out, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *lists])))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays([*out, *batch.columns[2:]], [*names, *keep])

    results = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip", *["ids"] * with_ids]
    if clash := set(keep) & set(results):
        raise ValueError(f"results are called {sorted(clash)}")
    kept = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids + kept
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), *(docs[c] for c in keep)).mapInArrow(run, schema)
