"""Token counts under a unigram model, with the work of common prefixes shared.

A word's token count is that of its best segmentation into vocabulary pieces by the sum of their scores
(fewest tokens among equals).  The distinct words of a batch are put in a trie by visiting them in
order: each node's forward score, the best score of a segmentation of the prefix that leads to it, is
computed once for all words below, and a word's count is stored where it ends.  Documents then only add
up stored counts.

Characters that no piece covers count as their UTF-8 bytes.  Words are cut at white space and begin
with the piece model's mark of a word.  Null and empty texts have no words and no tokens; very long texts are
read as a whole, repeated rows give repeated results, and columns other than id and text are not looked at,
whatever their names.

The public file holds ranks, not probabilities, and vocabularies are not trained here, so a piece's score is
the logarithm of its Zipf probability by rank.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame

MARK = "▁"
MEMO_WORDS = 300_000  # words whose counts a worker remembers; the memo starts anew beyond it
MEMO_LENGTH = 64
CHUNK = 1_000_000  # characters whose words are looked at together
BYTES = 32  # bits a byte count is shifted by, beside the token count


def piece_scores(model_file: str) -> dict[str, float]:
    """Pieces of a public piece model with log-probabilities by their rank in it (Zipf's law); bytes and control pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = model.get_piece_size()
    norm = math.log(sum(1 / (r + 2.7) for r in range(n)))
    plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    ranked = sorted(plain, key=lambda i: (-model.get_score(i), i))
    return {model.id_to_piece(i): -math.log(r + 2.7) - norm for r, i in enumerate(ranked)}


class Counter(dict):
    """word -> tokens + (byte tokens << BYTES)."""

    def __init__(self, scores: dict[str, float]):
        super().__init__()
        self.scores = scores
        self.ends = {piece[i:] for piece in scores for i in range(len(piece))}  # what a piece may end in
        self.byte_score = min(scores.values(), default=0.0) - 1.0

    def walk(self, words: list[str]) -> Iterator[tuple[str, int]]:
        """Words in order, each with its count; the path to a node holds the forward scores of its prefixes."""
        scores, ends = self.scores, self.ends
        path: list[tuple[float, int]] = [(0.0, 0)]  # (best score, count) for each prefix of the current word
        before = ""
        for word in words:
            text = MARK + word
            shared = 0
            for a, b in zip(before, text):
                if a != b:
                    break
                shared += 1
            del path[shared + 1 :]
            for end in range(shared + 1, len(text) + 1):
                n = len(text[end - 1].encode("utf-8", "surrogatepass"))
                score, count = path[end - 1]
                best, best_count = score + n * self.byte_score, count + n + (n << BYTES)
                for start in range(end - 1, -1, -1):
                    part = text[start:end]
                    if part not in ends:
                        break
                    own = scores.get(part)
                    if own is not None:
                        score, count = path[start]
                        score += own
                        if score > best or (score == best and (count + 1) & 0xFFFFFFFF < best_count & 0xFFFFFFFF):
                            best, best_count = score, count + 1
                path.append((best, best_count))
            before = text
            yield word, path[-1][1]

    def count_all(self, texts: list[str]) -> Iterator[tuple[int, int, int]]:
        """words, tokens and byte tokens of each text."""
        at = 0
        while at < len(texts):
            cut, size = [], 0
            while at < len(texts) and (not cut or size < CHUNK):
                cut.append(texts[at].split())
                size += len(texts[at])
                at += 1
            new = set().union(*cut).difference(self)
            if len(self) + len(new) > MEMO_WORDS:
                self.clear()
                new = set().union(*cut)
            own = dict(self.walk(sorted(new)))
            self.update((w, c) for w, c in own.items() if len(w) <= MEMO_LENGTH)
            get = self.__getitem__ if len(own) == len(new) and all(len(w) <= MEMO_LENGTH for w in own) else lambda w: own[w] if w in own else self[w]
            for words in cut:
                total = sum(map(get, words))
                yield len(words), total & ((1 << BYTES) - 1), total >> BYTES


_counters: dict[str, Counter] = {}


def counter(model_file: str) -> Counter:
    """One for each worker and model."""
    if model_file not in _counters:
        _counters[model_file] = Counter(piece_scores(model_file))
    return _counters[model_file]


def count_tokens(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens and n_byte_tokens of each row."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model_file)
        for batch in batches:
            got = list(own.count_all([x or "" for x in batch.column(1).to_pylist()]))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array([g[k] for g in got], pa.int64()) for k in range(3))], ["doc_id", "n_words", "n_tokens", "n_byte_tokens"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_byte_tokens long")
