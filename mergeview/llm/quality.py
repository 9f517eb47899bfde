"""Quality rules: word, symbol and repetition counts, and how well public vocabularies fit the text.

A text that is natural language for a vocabulary breaks into few tokens.  Each language or script has
bands, one for each vocabulary that tells something about it, for characters per token, the share of tokens
that are no whole characters (bytes the vocabulary falls back to) and the entropy of the text's token
distribution.  A text is rejected if it lies outside any of its bands.  As few tokens say little, characters
per token get an allowance of SLACK over the square root of the number of tokens.

The script is that of most letters.  A language's bands hold for texts of its script; all others use those of
their script.

Null and empty texts have no words and fail the base rules.  Very long texts are measured as a whole.  Every row
gives a row; repeated rows give repeated results.  measure() doesn't look at other columns, whatever their names,
and keep() hands all columns on.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergeview.llm.words import PLACE_KEYS, Texts, chunks, mix

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[*b"#*$%&|<>"]] = True
WINDOW = 5
MIN_WORDS = 10
REPEAT_PERCENT = 20


SLACK = 2.0


@dataclass(frozen=True)
class Band:
    """What is accepted of a vocabulary's measures; entropy_share is the entropy over the largest that so many tokens can have."""

    vocabulary: str
    min_chars_per_token: float
    max_chars_per_token: float = 9.0
    max_fallback_share: float = 0.25
    min_entropy_share: float = 0.3


SCRIPTS = ("latin", "greek", "cyrillic", "hebrew", "arabic", "indic", "thai", "kana", "han", "hangul", "other")
#: Languages that are written in one of the scripts.
LANGUAGE_SCRIPT = {"en": "latin", "de": "latin", "fr": "latin", "es": "latin"}

#: By language, else by script.  Languages: a little below what three in a thousand texts labelled good fall short of, in
#: three of four folds of documents.  Scripts: between natural sentences and the same characters in random order.
BANDS: dict[str, tuple[Band, ...]] = {
    "en": (Band("multi", 2.56, max_fallback_share=0.05), Band("english", 2.58, max_fallback_share=0.05)),
    "de": (Band("multi", 2.55, max_fallback_share=0.10),),
    "fr": (Band("multi", 2.25, max_fallback_share=0.10),),
    "es": (Band("multi", 2.31, max_fallback_share=0.10),),
    "latin": (Band("multi", 2.1, max_fallback_share=0.15),),
    "greek": (Band("multi", 1.7, max_fallback_share=0.2),),
    "cyrillic": (Band("multi", 2.2, max_fallback_share=0.1),),
    "hebrew": (Band("multi", 1.75, max_fallback_share=0.3),),
    "arabic": (Band("multi", 1.75, max_fallback_share=0.1),),
    "indic": (Band("multi", 0.9, max_fallback_share=0.75),),
    "thai": (Band("multi", 1.2, max_fallback_share=0.2),),
    "kana": (Band("multi", 1.2, max_fallback_share=0.2),),
    "han": (Band("multi", 0.95, max_fallback_share=0.45),),
    "hangul": (Band("multi", 1.4, max_fallback_share=0.3),),
    "other": (Band("multi", 0.5, max_fallback_share=0.98),),
}


def _script_bytes() -> np.ndarray:
    """Script of a letter by the first byte of its UTF-8 form, -1 for none; those of 0xE0 and 0xE1 depend on the second, too."""
    out = np.full(256, -1, np.int8)
    for first, last, script in ((0x41, 0x5A, "latin"), (0x61, 0x7A, "latin"), (0xC3, 0xCA, "latin"), (0xCE, 0xCF, "greek"), (0xD0, 0xD3, "cyrillic"), (0xD4, 0xD5, "other"), (0xD6, 0xD7, "hebrew"), (0xD8, 0xDB, "arabic"), (0xDC, 0xDF, "other"), (0xE0, 0xE0, "indic"), (0xE1, 0xE1, "other"), (0xE3, 0xE3, "kana"), (0xE4, 0xE9, "han"), (0xEA, 0xED, "hangul"), (0xF0, 0xF0, "other")):
        out[first : last + 1] = SCRIPTS.index(script)
    return out


SCRIPT_BYTES = _script_bytes()


def scripts(t: Texts) -> np.ndarray:
    """Index of each text's script; texts without letters are "other"."""
    kind = SCRIPT_BYTES[t.data]
    following = np.append(t.data[1:], np.uint8(0)) if len(t.data) else t.data
    kind[(t.data == 0xE0) & (following >= 0xB8)] = SCRIPTS.index("thai")
    kind[(t.data == 0xE1) & (following >= 0xB8)] = SCRIPTS.index("latin")
    counts = np.array([t.running(kind == i) for i in range(len(SCRIPTS))])
    return np.where(counts.sum(axis=0) > 0, counts.argmax(axis=0), SCRIPTS.index("other"))


_vocabularies: dict[tuple[str, str], tuple] = {}


def vocabulary(path: str, pattern: str):
    """The encoder of a rank file, and which of its ids are no whole characters; one for each worker."""
    if (path, pattern) not in _vocabularies:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        partial = np.zeros(max(ranks.values()) + 1, bool)
        for token, i in ranks.items():
            try:
                token.decode()
            except UnicodeDecodeError:
                partial[i] = True
        _vocabularies[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), partial
    return _vocabularies[path, pattern]


def token_measures(texts: list[str], path: str, pattern: str) -> np.ndarray:
    """Columns: tokens, tokens that are no whole characters, entropy in bits."""
    encoding, partial = vocabulary(path, pattern)
    out = np.zeros((len(texts), 3))
    for d, text in enumerate(texts):
        if text:
            ids = np.array(encoding.encode_to_numpy(text, disallowed_special=()))
            ids.sort()
            edges = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1], [True]]))
            share = np.diff(edges) / len(ids)
            out[d] = len(ids), partial[ids].sum(), -(share * np.log2(share)).sum()
    return out


def repeated(values: np.ndarray) -> np.ndarray:
    """Those that occur twice or more, once each."""
    values = np.sort(values)
    return np.unique(values[1:][values[1:] == values[:-1]])


def base_measures(t: Texts) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    first_byte = (t.data & 0xC0) != 0x80
    out = {"n_words": t.n_words, "word_chars": t.running(t.in_word & first_byte), "n_symbols": t.running(SYMBOLS[t.data])}

    owner = lambda first: np.repeat(np.arange(len(t)), np.diff(first))
    breaks = np.flatnonzero(t.data == 10)
    starts = np.union1d(t.offsets[:-1][np.diff(t.offsets) > 0], breaks + 1)
    starts = starts[starts < len(t.data)]
    ends = np.append(starts[1:], len(t.data))[: len(starts)]
    text_of = np.searchsorted(t.offsets, starts, "right") - 1
    ends = ends - (t.data[ends - 1] == 10) if len(ends) else ends  # without the break
    has_word = np.searchsorted(t.starts, ends) > np.searchsorted(t.starts, starts)
    starts, ends, text_of = starts[has_word], ends[has_word], text_of[has_word]
    lines = t.spans(starts, ends)
    lines = mix(lines + text_of.astype(np.uint64) * PLACE_KEYS[0])
    at = np.flatnonzero(np.isin(lines, repeated(lines)))
    _, firsts = np.unique(lines[at], return_index=True)
    out["n_dup_lines"] = np.bincount(text_of[at], minlength=len(t)) - np.bincount(text_of[at[firsts]], minlength=len(t))

    h, first = t.windows(WINDOW)
    text_of = owner(first)
    h = mix(h + text_of.astype(np.uint64) * PLACE_KEYS[0])
    at = np.flatnonzero(np.isin(h, repeated(h)))
    at += (t.first[:-1] - first[:-1])[text_of[at]]  # as an index of words
    depth = np.zeros(len(t.starts) + 1, np.int64)
    np.add.at(depth, at, 1)
    np.add.at(depth, at + WINDOW, -1)
    out["n_repeat_words"] = np.diff(np.concatenate([[0], np.cumsum(np.cumsum(depth[:-1]) > 0)])[t.first]) if len(t.starts) else np.zeros(len(t), np.int64)
    return out


def band_names(langs: list[str | None], script: np.ndarray, bands: dict[str, tuple[Band, ...]]) -> list[str]:
    return [x if x in bands and LANGUAGE_SCRIPT.get(x, SCRIPTS[k]) == SCRIPTS[k] else SCRIPTS[k] for x, k in zip(langs, script)]


def judge(t: Texts, texts: list[str], langs: list[str | None], vocabularies: dict[str, str], pattern: str, bands: dict[str, tuple[Band, ...]]) -> tuple[dict, np.ndarray, np.ndarray, list[str], dict[str, np.ndarray]]:
    """Base counts, which texts fail them, which lie in all their bands, the bands' names, and each vocabulary's measures
    (tokens, characters per token, fallback share, entropy share; NaN where it has no band for the text)."""
    m = base_measures(t)
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > REPEAT_PERCENT * m["n_words"])
    chars = t.running((t.data & 0xC0) != 0x80)
    names = band_names(langs, scripts(t), bands)
    fits, measures = np.ones(len(t), bool), {}
    for v, path in vocabularies.items():
        own = {name: band for name in set(names) for band in bands[name] if band.vocabulary == v}
        at = np.flatnonzero([x in own for x in names])
        tokens, partial, entropy = token_measures([texts[i] for i in at], path, pattern).T
        some = np.maximum(tokens, 1)
        per, share, spread = chars[at] / some, partial / some, entropy / np.maximum(np.log2(np.maximum(tokens, 2)), 1)
        limits = np.array([(b.min_chars_per_token, b.max_chars_per_token, b.max_fallback_share, b.min_entropy_share) for b in (own[names[i]] for i in at)]).reshape(-1, 4)
        fits[at] &= (per + SLACK / np.sqrt(some) >= limits[:, 0]) & (per <= limits[:, 1]) & (share <= limits[:, 2]) & (spread >= limits[:, 3])
        measures[v] = np.full((len(t), 4), np.nan)
        measures[v][at] = np.column_stack([tokens, per, share, spread])
    return m, failed, fits, names, measures


def measure(docs: DataFrame, vocabularies: dict[str, str], pattern: str, bands: dict[str, tuple[Band, ...]] = BANDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """A row for each document: the base counts, base_failed, kept, the name of its bands and each vocabulary's measures.

    vocabularies: name -> path of a rank file.  A document that passes the base rules is kept if it lies in
    all its bands; measures are null for vocabularies without a band for it.
    """
    import pyarrow as pa

    kinds = ("n_tokens", "chars_per_token", "fallback_share", "entropy_share")
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, t in chunks(batch.column(1), lower=False):
                part = batch.slice(at, len(t))
                m, failed, fits, names, measures = judge(t, [x or "" for x in part.column(1).to_pylist()], part.column(2).to_pylist(), vocabularies, pattern, bands)
                told = [pa.array(x[:, k], pa.float64(), from_pandas=True) for x in measures.values() for k in range(4)]
                told = [x.cast(pa.int64()) if k % 4 == 0 else x for k, x in enumerate(told)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), *(pa.array(m[k].astype(np.int64)) for k in base), pa.array(failed), pa.array(~failed & fits), pa.array(names, pa.string()), *told],
                    ["doc_id", *base, "base_failed", "kept", "band", *(f"{v}_{k}" for v in vocabularies for k in kinds)],
                )

    schema = "doc_id long, " + ", ".join(f"{k} long" for k in base) + ", base_failed boolean, kept boolean, band string"
    for v in vocabularies:
        schema += f", {v}_n_tokens long, {v}_chars_per_token double, {v}_fallback_share double, {v}_entropy_share double"
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang")).mapInArrow(run, schema)


def keep(docs: DataFrame, vocabularies: dict[str, str], pattern: str, bands: dict[str, tuple[Band, ...]] = BANDS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that measure() keeps, with all their columns, whatever these are called."""
    import pyarrow as pa

    text_at, lang_at = docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, t in chunks(batch.column(text_at), lower=False):
                part = batch.slice(at, len(t))
                _, failed, fits, _, _ = judge(t, [x or "" for x in part.column(text_at).to_pylist()], part.column(lang_at).to_pylist(), vocabularies, pattern, bands)
                yield part.filter(pa.array(~failed & fits))

    return docs.mapInArrow(run, docs.schema)


def band_report(measured: DataFrame, vocabulary: str) -> DataFrame:
    """By name of the bands, quantiles of the measures over all documents that pass the base rules: what bands are set from."""
    q = [0.001, 0.003, 0.01, 0.5, 0.99, 0.999]
    allowed = F.col(f"{vocabulary}_chars_per_token") + SLACK / F.sqrt(f"{vocabulary}_n_tokens")
    kinds = {"chars_per_token_and_slack": allowed, "fallback_share": F.col(f"{vocabulary}_fallback_share"), "entropy_share": F.col(f"{vocabulary}_entropy_share")}
    return measured.where("not base_failed").groupBy("band").agg(*(F.percentile_approx(x, q, 10_000).alias(k) for k, x in kinds.items()))
