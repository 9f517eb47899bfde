"""The queries opN_<name>: each applies its operator to a whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeview.llm import bpe, embeddings, jaccard, licenses, mixing, pii, quality, tokens, toxicity, urls
from mergeview.llm.tables import importable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: For tests and trials.  Who uses the pseudonyms sets a secret one in spark.mergeview.pii.key.
TRIAL_KEY = "for trials only"


def pseudonym_key(spark: SparkSession) -> str:
    return spark.conf.get("spark.mergeview.pii.key", TRIAL_KEY)


def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, pseudonym_key(spark), found_col="replaced").select("doc_id", "text", F.size("replaced").alias("n_replaced"), F.array_join(F.array_sort(F.array_distinct("replaced.kind")), ",").alias("kinds"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_embedding_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _ = jaccard.join(table(spark, sf_dir, "documents"))
    return documents.select("doc_id", "n_shingles", "component_id")


#: name in the bands -> file
VOCABULARIES = {"multi": public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "english": public_tokenizers.path("byte_bpe_50k.tiktoken")}


def op5_quality_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(table(spark, sf_dir, "documents"), VOCABULARIES, public_tokenizers.PATTERN)


#: verdict, host, path
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: The list is made by rule, from no table: hosts of sellers with all their pages, and some pages of ordinary hosts.
SELLERS = ("spam-farm", "cheap-pills", "casino-win", "free-bets", "win-now", "fast-loans")
SYLLABLES = ("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha")
DOMAINS, LANGUAGES, PAGES, EVERY = ("com", "net", "org"), ("en", "de", "fr", "es"), 10_000, 101


def listed_urls(spark: SparkSession) -> DataFrame:
    """About a million canonical URLs, far more than pages, most of which are in no table."""
    pick = lambda values, i: F.get(F.array(*map(F.lit, values)), i.cast("int"))
    i = F.col("id")
    place = F.concat(F.lit(".example."), pick(DOMAINS, i % 3), F.lit("/"), pick(LANGUAGES, F.floor(i / 3) % 4), F.lit("/"))
    n = 12 * PAGES
    sellers = spark.range(len(SELLERS) * n).select(F.concat(pick(SELLERS, F.floor(i / n)), place, (F.floor(i / 12) % PAGES).cast("string")).alias("canonical"))
    some = -(-PAGES // EVERY)
    m = 12 * some
    label = F.floor(i / m)
    host = F.concat(F.lit("th"), pick(SYLLABLES, F.floor(label / 100)), pick(SYLLABLES, F.floor(label / 10) % 10), pick(SYLLABLES, label % 10))
    others = spark.range(1000 * m // 4).select(F.concat(host, place, (F.floor(i / 12) % some * EVERY).cast("string")).alias("canonical"))
    return sellers.union(others)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), listed_urls(spark), URL_RULES)


def op7_toxicity_kn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_trie_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "block", "slot", "place")


QUERIES = {
    "op1_pii_pseudonyms": op1_pii_pseudonyms,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_embedding_itq": op3_embedding_itq,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_quality_fertility": op5_quality_fertility,
    "op6_url_filter": op6_url_filter,
    "op7_toxicity_kn": op7_toxicity_kn,
    "op8_trie_tokens": op8_trie_tokens,
    "op9_license_scan": op9_license_scan,
    "op10_pfair_mix": op10_pfair_mix,
}

_at = "instr(url, '://')"
_pick = lambda values, i: f"(['" + "', '".join(values) + f"'])[CAST({i} AS BIGINT) + 1]"
_place = f"'.example.' || {_pick(DOMAINS, 'i % 3')} || '/' || {_pick(LANGUAGES, 'i // 3 % 4')} || '/'"
_some = -(-PAGES // EVERY)
_listed = f"""SELECT {_pick(SELLERS, f'i // {12 * PAGES}')} || {_place} || (i // 12 % {PAGES}) AS canonical FROM range(0, {len(SELLERS) * 12 * PAGES}) t(i) UNION ALL
            SELECT 'th' || {_pick(SYLLABLES, f'i // {12 * _some} // 100')} || {_pick(SYLLABLES, f'i // {12 * _some} // 10 % 10')} || {_pick(SYLLABLES, f'i // {12 * _some} % 10')} || {_place} || (i // 12 % {_some} * {EVERY}) FROM range(0, {1000 * 12 * _some // 4}) t(i)"""
_by_length = sorted(URL_RULES, key=lambda r: (-len(r[1] + r[2]), r))
_fits = lambda h, p: f"(host = '{h}' OR host LIKE '%.{h}') AND path LIKE '{p}%'"

_values = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
_phrases = [("base", label, p) for p, label in licenses.BASE.items()] + [("key", label, p) for label, (_, keys) in licenses.TEMPLATES.items() for p in keys] + [("grant", label, p) for label, ps in licenses.GRANTS.items() for p in ps]

ORACLES: dict[str, str] = {
    "op9_license_scan": f"""
        WITH docs AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        pos AS (SELECT id, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM docs),
        phrases AS (SELECT kind, label, phrase, string_split(phrase, ' ') AS p FROM (VALUES {_values(_phrases)}) t(kind, label, phrase)),
        hits AS (SELECT s.id, f.kind, f.label, f.phrase, s.i FROM pos s JOIN phrases f ON s.word = f.p[1] JOIN docs d ON d.id = s.id WHERE d.w[s.i + 1:s.i + len(f.p)] = f.p),
        base AS (SELECT id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM hits WHERE kind = 'base' GROUP BY id),
        postings AS (SELECT * FROM (VALUES {_values(licenses.postings(licenses.TEMPLATES))}) t(label, part, word, place)),
        ranks AS (SELECT v.word, row_number() OVER (ORDER BY count(DISTINCT s.id), v.word) AS rank FROM (SELECT DISTINCT word FROM postings) v LEFT JOIN pos s ON s.word = v.word GROUP BY v.word),
        needed AS (SELECT label, count(*) AS n FROM phrases WHERE kind = 'key' GROUP BY label),
        told AS (SELECT h.id, h.label FROM hits h JOIN needed USING (label) WHERE kind = 'key' GROUP BY h.id, h.label, needed.n HAVING count(DISTINCT phrase) = needed.n),
        present AS (SELECT DISTINCT t.id, t.label, p.part, p.word, r.rank FROM told t JOIN postings p USING (label) JOIN pos s ON s.id = t.id AND s.word = p.word JOIN ranks r ON r.word = p.word),
        chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, label, part ORDER BY rank) AS k FROM present) WHERE k <= {licenses.RARE_WORDS}),
        lined AS (SELECT c.id, c.label, c.part, s.i - p.place AS start, count(DISTINCT c.word) AS n FROM chosen c JOIN pos s ON s.id = c.id AND s.word = c.word JOIN postings p ON p.label = c.label AND p.part = c.part AND p.word = c.word GROUP BY ALL),
        best AS (SELECT l.id, l.label, l.n::DOUBLE / l.wanted AS share FROM (SELECT id, label, part, max(n) AS n, (SELECT count(*) FROM chosen c WHERE c.id = x.id AND c.label = x.label AND c.part = x.part) AS wanted FROM lined x GROUP BY id, label, part) l WHERE n >= {licenses.LEAST_WORDS} AND n >= {licenses.LEAST_ALIGNED} * wanted),
        labelled AS (SELECT id, label FROM hits WHERE kind IN ('base', 'grant') UNION SELECT id, label FROM best),
        named AS (SELECT id, string_agg(label, ',' ORDER BY label) AS labels FROM labelled GROUP BY id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(b.n_base, 0) AS n_base, b.first_word, b.last_word, coalesce(b.base_labels, '') AS base_labels, coalesce(n.labels, '') AS labels,
        coalesce((SELECT max(share) FROM best x WHERE x.id = d.id), CASE WHEN n.labels IS NOT NULL THEN 1.0 ELSE 0.0 END)::DOUBLE AS score FROM docs d LEFT JOIN base b USING (id) LEFT JOIN named n USING (id)""",
    "op3_embedding_itq": """
        WITH RECURSIVE fine AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
        reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
        least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a), counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT e.vec_id, coalesce(c.n, 0) AS n_links, l.component_id, e.vec_id = l.component_id AS kept FROM embeddings e JOIN least l ON l.a = e.vec_id LEFT JOIN counts c ON c.a = e.vec_id""",
    "op4_ngram_jaccard": """
        WITH RECURSIVE cut AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        sets AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM cut),
        each AS (SELECT doc_id, unnest(s) AS x FROM sets),
        met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM each a JOIN each b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
        links AS (SELECT a, b FROM met JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b WHERE 100 * c >= 80 * (len(p.s) + len(q.s) - c)),
        ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN ways l ON l.a = r.b)
        SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id FROM sets s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) m ON m.a = s.doc_id""",
    "op6_url_filter": f"""
        WITH list AS ({_listed}),
        rest AS (SELECT page_id, CASE WHEN {_at} > 0 THEN substr(url, {_at} + 3) ELSE '' END AS r FROM pages),
        cut AS (SELECT page_id, regexp_extract(r, '^[^/?#]*', 0) AS h, substr(r, length(regexp_extract(r, '^[^/?#]*', 0)) + 1) AS tail FROM rest),
        parts AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(tail, '^[^?#]*', 0) AS path, regexp_extract(tail, '^[^?#]*[?]([^#]*)', 1) AS q FROM cut),
        asked AS (SELECT page_id, host, path, list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref)(=|$)'))) AS kept FROM parts),
        named AS (SELECT page_id, host, path, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)[.]', '') || regexp_replace(path, '/+$', '') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canonical FROM asked),
        judged AS (SELECT page_id, host, path, coalesce(canonical IN (SELECT canonical FROM list), false) AS listed FROM named)
        SELECT page_id, host, path, CASE {" ".join(f"WHEN {_fits(h, p)} THEN '{h + p}'" for _, h, p in _by_length)} END AS rule,
        CASE {" ".join(f"WHEN {_fits(h, p)} THEN '{v}'" for v, h, p in _by_length)} WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed FROM judged""",
}
