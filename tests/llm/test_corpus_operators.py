"""Joins, near-duplicates, URL filters, mixtures, toxicity and the pipeline against brute force, and their edge cases."""

import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mergeview.llm import catalog, components, embeddings, jaccard, mixing, toxicity, urls
from mergeview.llm.tables import Saved
from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def union_find(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# --- components ---


@pytest.mark.parametrize("seed", [0, 1])
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 260)] + [(5, 5)]
    rng.shuffle(links)
    df = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components.components(df, Saved(spark)).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    want = union_find(range(300), links)
    assert got == {i: want[i] for i in linked}
    assert components.components(df.limit(0), Saved(spark)).count() == 0


# --- n-gram Jaccard join ---


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_join(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    lists, links = {}, []
    for k, (i, s) in enumerate(sets):
        met = Counter(j for x in s for j in lists.get(x, ()))
        links += [(i, sets[j][0]) for j, both in met.items() if 100 * both >= 80 * (len(s) + len(sets[j][1]) - both)]
        for x in s:
            lists.setdefault(x, []).append(k)
    return {i: (len(s), c) for (i, s), c in zip(sets, union_find([i for i, _ in sets], links).values())}


def near_copies(seed, groups=14, common=True):
    rng = random.Random(seed)
    rows = []
    line = "this common line stands in very many documents of the table " if common else ""
    for _ in range(groups):
        base = [rng.choice("abcdefghijklmnop") + rng.choice("xyz") for _ in range(rng.randint(3, 70))]
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice("qrst")
            rows.append(line * rng.randint(0, 1) + " ".join(copy) + " zz" * rng.choice([0, 0, 1, 5]))
    rows += [None, "", " \n", "One two", "one TWO", "one two three four five", "x" * 3000]
    rng.shuffle(rows)
    return list(enumerate(rows))


def brute_pairs(e):
    """All pairs of entries of one list, with the skipped ones left out one by one."""
    out = set()
    for a in range(len(e)):
        for b in range(a):
            x, y = e[a], e[b]
            n, m = int(x["n"]), int(y["n"])
            if x["shingle"] == y["shingle"] and x["component"] != y["component"] and 5 * min(n, m) >= 4 * max(n, m) and min(n - int(x["at"]), m - int(y["at"])) >= -(-4 * (n + m) // 9):
                out.add((min(int(x["cls"]), int(y["cls"])), max(int(x["cls"]), int(y["cls"]))))
    return out


@pytest.mark.parametrize("at_once", [3, 1_000_000])
def test_blocks_of_an_index_list_are_skipped_before_pairs_are_made(monkeypatch, at_once):
    monkeypatch.setattr(jaccard, "PAIRS_AT_ONCE", at_once)
    rng = np.random.default_rng(2)
    for size in (0, 1, 2, 40, 150):
        e = np.zeros(size, jaccard.ENTRY)
        e["shingle"], e["cls"], e["n"] = rng.integers(0, 4, size), rng.permutation(size) - 20, rng.integers(1, 30, size)
        e["component"] = np.where(rng.random(size) < 0.5, rng.integers(0, 4, size), e["cls"] + 1000)
        e["at"] = rng.integers(0, 1 + e["n"] // 5)
        got = jaccard.pairs_of(e)
        assert {tuple(x) for x in got.tolist()} == brute_pairs(e) and len(got) == len(brute_pairs(e))
    # 40,000 sets under one shingle, which their positions rule out: no pair is made
    e = np.zeros(40_000, jaccard.ENTRY)
    e["cls"] = e["component"] = np.arange(len(e))
    e["n"], e["at"] = 10, 2
    assert not len(jaccard.pairs_of(e))


@pytest.mark.parametrize(("hot_from", "long"), [(64, 50_000), (3, 4)])
def test_join_is_exact(spark, monkeypatch, hot_from, long):
    monkeypatch.setattr(jaccard, "HOT_FROM", hot_from)
    monkeypatch.setattr(jaccard, "FLUSH", 500)
    monkeypatch.setattr(jaccard, "LONG", long)
    monkeypatch.setattr(jaccard, "LONG_BLOCK", 3)
    rows = near_copies(hot_from)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cls", F.lit("extra")).withColumn("n", F.lit(1))
    placed, links = jaccard.join(df)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in placed.collect()} == brute_join(rows)
    if hot_from == 64:
        kept = jaccard.one_of_each(df.union(df.limit(3)))
        assert kept.columns == df.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in brute_join(rows).items() if c == i)


def test_join_without_filter_and_edge_tables(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FILTER_MAX", -1)
    rows = near_copies(9, groups=5, common=False)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(df)[0].collect()} == brute_join(rows)
    assert jaccard.join(df.limit(0))[0].count() == 0 and jaccard.one_of_each(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in jaccard.join(odd)[0].collect()), key=str)
    assert got == sorted([(None, 3), (None, 3), (3, 3), (3, 3), (4, 4)], key=str)


def test_one_of_each_loses_no_text(spark):
    """Rows that share an id but not their text are kept; repeated rows are kept once; columns with the names used inside stay."""
    a, b = "a b c d e f g h i j k l m n", "quite another text that shares nothing at all with it"
    rows = [(1, a, "x"), (1, b, "x"), (1, a, "x"), (2, a, "y"), (3, b, "y"), (4, "alone here", "z"), (5, None, "n"), (5, None, "n"), (None, a, "null"), (6, "One two", "o"), (6, "one two", "o")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _cls string").withColumn("component", F.lit(9))
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, (r.text or "").lower(), r._cls, r.component) for r in kept.collect()), key=str)
    assert got == sorted([(1, a, "x", 9), (1, b, "x", 9), (4, "alone here", "z", 9), (5, "", "n", 9), (5, "", "n", 9), (None, a, "null", 9), (6, "one two", "o", 9)], key=str)


def test_histograms_bound_the_overlap():
    rng = np.random.default_rng(0)
    for n, m, both in ((10, 12, 9), (300, 280, 250), (5000, 900, 700), (1, 1, 0), (2000, 2000, 2000)):
        pool = np.unique(rng.integers(0, 1 << 62, n + m, dtype=np.uint64))
        a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:both], pool[n : n + m - both]]))
        assert jaccard.overlap_bound(jaccard.histogram(a), jaccard.histogram(b)) >= len(np.intersect1d(a, b))


def test_least_overlap_and_prefix():
    for n in range(1, 60):
        assert jaccard.prefix_length(n) == n - min(i for i in range(n + 1) if 5 * i >= 4 * n) + 1
        for m in range(1, 60):
            want = min((i for i in range(n + m + 1) if 100 * i >= 80 * (n + m - i)))
            assert jaccard.least_overlap(np.array([n]), np.array([m]))[0] == want


def test_join_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in catalog.op4_ngram_jaccard(spark, SF).collect()} == brute_join(rows)


# --- embeddings ---


def brute_vectors(rows, threshold=0.9):
    good = [(i, v) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = np.array([v for _, v in good], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    n = {i: 0 for i, _ in rows} | {good[k][0]: int(near[k].sum()) for k in range(len(good))}
    part = union_find([i for i, _ in rows], [(good[a][0], good[b][0]) for a, b in zip(*np.nonzero(near))])
    return {i: (n[i], part[i]) for i, _ in rows}


def some_vectors(n=400, dims=32, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(25, dims))
    rows = [(i, [float(np.float32(x)) for x in base[i % 25] + rng.normal(size=dims) * rng.choice([0, 0.05, 0.1, 0.3])]) for i in range(n)]
    return rows + [(n, None), (n + 1, [0.0] * dims), (n + 2, [float("nan")] * dims), (n + 3, [None] * dims), (n + 4, []), (n + 5, [float("inf")] + [0.0] * (dims - 1))]


@pytest.mark.parametrize("block", [4096, 20])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rows = some_vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cls", F.lit(1)).withColumn("t", F.lit("x"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()}
    want = brute_vectors(rows)
    links = sum(v[0] for v in want.values())
    assert got.keys() == want.keys() and all(got[i][0] <= want[i][0] for i in want)  # no link below the threshold, none twice
    assert sum(v[0] for v in got.values()) >= 0.9 * links and links > 1000
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.95 * len(want)
    assert all(k == (i == c) for i, (_, c, k) in got.items())


def test_embeddings_edges(spark):
    df = spark.createDataFrame(some_vectors(), "vec_id long, embedding array<float>")
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
    assert [tuple(r) for r in embeddings.near_duplicates(df.where("vec_id = 3")).collect()] == [(3, 0, 3, True)]
    assert [tuple(r) for r in embeddings.near_duplicates(df.where("vec_id = 400")).collect()] == [(400, 0, 400, True)]
    big, small = 1e308, 5e-324  # their squares overflow and underflow; a vector of another length is one of its own kind
    odd = spark.createDataFrame([(1, [big, big]), (2, [small, small]), (3, [1.0, 1.0]), (4, [1.0, 1.0, 0.0]), (5, [2.0, 2.0, 0.0]), (6, [0.0]), (7, [-3.0]), (8, [4.0]), (9, [-1.0]), (None, [1.0]), (7, None)], "vec_id long, embedding array<double>")
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_duplicates(odd).collect()), key=str)
    assert got == sorted([(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 1, 4), (5, 1, 4), (6, 0, 6), (7, 1, 7), (7, 0, 7), (8, 1, 8), (9, 1, 7), (None, 1, 8)], key=str)
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(50)] + [(60, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert {(r.vec_id, r.n_links, r.component_id) for r in embeddings.near_duplicates(same).collect()} == {(i, 49, 0) for i in range(50)} | {(60, 0, 60)}


def with_mean(norm, n, dims, seed=1):
    """Unit vectors around a mean of this length, a third of them one of a pair just above a cosine of 0.9 whose difference lies outside the mean."""
    rng = np.random.default_rng(seed)
    mean = np.zeros(dims)
    mean[0] = norm
    rest = math.sqrt(1 - norm * norm)
    outside = lambda m: (z := np.concatenate([np.zeros((m, 1)), rng.normal(size=(m, dims - 1))], axis=1)) / np.linalg.norm(z, axis=1, keepdims=True)
    a, b = outside(n), outside(n // 3)
    b -= (b * a[: n // 3]).sum(axis=1, keepdims=True) * a[: n // 3]
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    cosine = (rng.uniform(0.9, 0.91, (n // 3, 1)) - norm**2) / rest**2
    near = cosine * a[: n // 3] + np.sqrt(1 - cosine**2) * b
    return np.concatenate([mean + rest * a, mean + rest * near])


@pytest.mark.parametrize(("norms", "n"), [((0.0,), 6000), ((0.5,), 6000), ((0.8,), 6000), ((0.9,), 6000), ((0.0, 0.8), 3000)])
def test_embedding_recall_with_a_long_mean(spark, norms, n):
    """At least 0.95 of the pairs, also where lengths are mixed (64 and 48 components)."""
    all_rows, found, want = [], 0, 0
    for norm, dims in zip(norms, (64, 48)):
        x = with_mean(norm, n, dims)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        want += sum(int((x[i : i + 1000] @ x.T >= 0.9).sum()) for i in range(0, len(x), 1000)) - len(x)
        all_rows += [(len(all_rows) + i, v) for i, v in enumerate(x.tolist())]
    found = sum(r.n_links for r in embeddings.near_duplicates(spark.createDataFrame(all_rows, "vec_id long, embedding array<double>")).collect())
    assert 0.95 * want <= found <= want


def test_keys_grow_with_the_vectors(monkeypatch):
    monkeypatch.setattr(embeddings, "ITERATIONS", 2)
    x = with_mean(0.0, 3000, 64)
    bits = [len(embeddings.fit(x, n, 0.9)[2][0]) for n in (3_000, 3_000_000, 3_000_000_000)]
    assert bits == sorted(set(bits)) and bits[0] >= 1


def test_embedding_query_recall(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = {r.vec_id: r.n_links for r in catalog.op3_embedding_itq(spark, SF).collect()}
    want = brute_vectors(rows)
    assert sum(got.values()) >= 0.9 * sum(v[0] for v in want.values()) and all(got[i] <= want[i][0] for i in want)


# --- URLs ---


def brute_url(url, listed, rules):
    host = path = query = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        tail = rest[len(host) :]
        path = re.match("[^?#]*", tail)[0]
        query = (re.match(r"[^?#]*\?([^#]*)", tail) or ["", ""])[1]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    kept = sorted(x for x in query.split("&") if x and not re.match("(?:utm_[^=]*|ref)(?:=|$)", x))
    own = re.sub(r"^(?:www|m)\.", "", host) + path.rstrip("/") + ("?" + "&".join(kept) if kept else "") if host else None
    best = max(fit, default=None)
    return host, path, best and best[1], best[2] if best else "block" if own and own in listed else "allow"


def test_urls(spark, monkeypatch):
    seen = [None, "", "no scheme", "http://", "HTTP://WWW.Example.NET/en/x?b=1&a=2&utm_x=3#f", "http://example.net", "http://example.net/", "x://a.org/fr/", "x://borg/fr/", "http://É.org/fr", "http://m.bad.com/p/?ref=1", "https://bad.com/p", "http://bad.com/q", "http://example.com/de/?", "a://b://c/d", "http://notexample.net/en/"]
    rng = random.Random(0)
    seen += [f"http://{rng.choice(['', 'www.', 'm.', 'x.'])}{rng.choice(['example.net', 'example.com', 'bad.com', 'org', 'k.org'])}{rng.choice(['', '/', '/en/', '/de/1', '/fr/', '/p'])}{rng.choice(['', '?b=1&a=2', '?ref=2', '#t'])}" for _ in range(200)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(seen)], "page_id long, url string").withColumn("block", F.lit(1)).withColumn("host", F.lit("x"))
    lines = ["bad.com/p", "bad.com/p", "bad.com?a=2&b=1", None, "k.org", *(f"other{i}.com" for i in range(500))]
    listed = spark.createDataFrame([(x,) for x in lines], "u string")
    for send in (1 << 20, 0):
        monkeypatch.setattr(urls, "BROADCAST_BLOCKS", send)
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, listed, catalog.URL_RULES).collect()}
        assert got == {i: brute_url(u, lines, catalog.URL_RULES) for i, u in enumerate(seen)}
    assert urls.judge(pages.limit(0), listed, catalog.URL_RULES).count() == 0
    assert urls.judge(pages, listed.limit(0), []).where("verdict <> 'allow' or rule is not null").count() == 0
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", urls.judge(spark.read.parquet(f"{SF}/pages.parquet"), spark.range(3).select(F.col("id").cast("string")), catalog.URL_RULES)._jdf.queryExecution().toString())


# --- mixing ---


def test_pfair_deviation():
    rng = random.Random(1)
    for _ in range(60):
        share = mixing.shares({f"s{i}": rng.random() ** 3 + 1e-3 for i in range(rng.randint(1, 40))}, 400)
        table, done = mixing.period_slots(share), Counter()
        assert len(table) == sum(share.values())
        for slot, (s, k) in enumerate(table):
            assert k == done[s]
            done[s] += 1
            assert all(abs(done[q] - a * (slot + 1) / len(table)) < 1 for q, a in share.items())


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 16)
    rng = random.Random(2)
    rows = [(i, f"t{rng.randrange(900)}", rng.choice(["a", "a", "a", "b", "c", None]), 1) for i in range(500)] + [(None, None, "d", 1), (7, "t", "a", 1), (7, "t", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, block int")
    got = mixing.mix(df, block=4, period=50).collect()
    assert len(got) == len(rows) and len({r.place for r in got}) == len(rows) and Counter((r.doc_id, r.source) for r in got) == Counter((r[0], r[2]) for r in rows)
    by_slot = {}
    for r in got:
        by_slot.setdefault(r.slot, set()).add((r.source, r.block))
    assert all(len(x) == 1 for x in by_slot.values()) and sorted(by_slot) == list(range(len(by_slot)))
    order = [next(iter(by_slot[i]))[0] for i in range(len(by_slot))]
    total = Counter(f"={r[2]}" if r[2] else mixing.NO_SOURCE for r in rows)
    for phase in mixing.phases({s: -(-n // 4) for s, n in total.items()}, {s: n**mixing.TEMPERATURE for s, n in total.items()}, 50):
        done = Counter()
        for k in range(sum(phase["used"].values())):
            s = order[phase["slot"] + k]
            done[f"={s}" if s else mixing.NO_SOURCE] += 1
            assert all(abs(done[q] - a * (k + 1) / phase["period"]) < 1 for q, a in phase["share"].items())
    assert mixing.mix(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(df, weights={"a": 1.0})
    equal = mixing.mix(df.where("source in ('b', 'c')"), weights={"b": 1.0, "c": 1.0}, block=1).where("slot < 20").groupBy("source").count().collect()
    assert all(abs(r["count"] - 10) <= 1 for r in equal)
    assert catalog.op10_pfair_mix(spark, SF).count() == 200


# --- toxicity ---


def test_fold_is_crc32(spark):
    rows = spark.range(200).select("id", toxicity.fold(F.col("id")).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 4 for r in rows)


def characters_of(text):
    """The text as it is counted, the slow way."""
    out = " "
    for c in text.lower():
        kind = unicodedata.category(c)[0]
        c = c if kind in "LM" else "0" if kind == "N" else " "
        out += c if (out[-1], c) != (" ", " ") else ""
    return out if out[-1] == " " else out + " "


def brute_kneser_ney(texts):
    """counts of n-grams by class; probabilities of a character after a context, by class, with all orders."""
    d, a, top = toxicity.DISCOUNT, toxicity.PRIOR, toxicity.ORDER
    want = Counter()
    for t, y in texts:
        c = " " * (top - 2) + characters_of(t or "")
        want.update((c[i : i + top], y) for i in range(len(c) - top + 1))
    counts = {g: (want[g, 1], want[g, 0]) for g in {g for g, _ in want}}
    level = {top: {g: (*c, sum(c)) for g, c in counts.items()}}
    whole = {top: level[top]}
    for k in range(top - 1, 0, -1):
        kinds = {x[1:] for x in level[k + 1]}
        whole[k] = {g: tuple(sum(c[i] for x, c in whole[k + 1].items() if x[1:] == g) for i in range(3)) for g in kinds}
        level[k] = {g: whole[k][g] if g[0] == " " else tuple(sum(c[i] > 0 for x, c in level[k + 1].items() if x[1:] == g) for i in range(3)) for g in kinds}

    def p(which, g):
        k = len(g)
        if k == 1:
            return level[1][g][2] / sum(c[2] for c in level[1].values()) if g in level[1] else 1e-9
        if k <= toxicity.SHARED_ORDER:
            which, prior = 2, 0.0
        else:
            prior = a
        same = [c[which] for x, c in level[k].items() if x[:-1] == g[:-1]]
        if not sum(same):
            return p(which, g[1:])
        return (max(level[k].get(g, (0, 0, 0))[which] - d, 0) + (d * sum(c > 0 for c in same) + prior) * p(which, g[1:])) / (sum(same) + prior)

    return counts, level, p


def test_kneser_ney_ratios(spark):
    texts = [("abab abc", 1), ("abc bcd", 0), ("bcd  bcd é9x", 0), ("", 0), ("тест: 漢字 Straße", 1), (None, 0)]
    df = spark.createDataFrame(texts, "text string, toxic int")
    counts, level, p = brute_kneser_ney(texts)
    got_counts = toxicity.gram_counts(df)
    assert {r.g: (r.toxic, r.ordinary) for r in got_counts.collect()} == counts
    saved = Saved(spark)
    ratios = saved.keep(toxicity.log_ratios(got_counts, saved))
    rows = ratios.collect()
    got = {r.g: r.value for r in rows if not r.context}
    assert len(rows) == len({(r.g, r.context) for r in rows}) and got.keys() == {g for x in level.values() for g in x if len(g) > 1}
    assert {r.g for r in rows if r.context} == {g[:-1] for x in level.values() for g in x if len(g) > toxicity.SHARED_ORDER}
    for g in got:
        assert got[g] == pytest.approx(np.log(p(0, g) / p(1, g)), abs=1e-9)
    # a text's first number is the mean over its characters of the log ratio in their words, whether their n-grams were seen or not
    sent = toxicity.hashed(ratios).toArrow()
    table = toxicity.Table(sent["h"].to_numpy().view(np.uint64), sent["value"].to_numpy())
    for text in ("abab abcd", "漢字 тест", "zzz", "é9", "cdba bc", "漢cb"):
        words = [f" {w} " for w in characters_of(text).split()]
        each = [np.log(p(0, g) / p(1, g)) for g in (w[max(0, i - toxicity.ORDER + 1) : i + 1] for w in words for i in range(1, len(w)))]
        assert toxicity.evidence(text, table)[0] == pytest.approx(np.mean(each), abs=1e-5)
        if len(words) == 2 and text.isascii():  # the pair: the second word's characters after both words
            c, n = " " * (toxicity.ORDER - 2) + characters_of(text), len(words[0]) - 1
            across = [np.log(p(0, g) / p(1, g)) for g in (c[i : i + toxicity.ORDER] for i in range(n, n + toxicity.ACROSS))] + each[n + toxicity.ACROSS :]
            assert toxicity.evidence(text, table)[4] == pytest.approx((sum(each[:n]) + sum(across)) / len(each), abs=1e-5)


def test_counts_in_small_steps_are_the_same(spark, monkeypatch):
    texts = [(" ".join(random.Random(i).choices(["ab", "bca", "éa", "漢"], k=40)), i % 2) for i in range(50)]
    df = spark.createDataFrame(texts, "text string, toxic int")
    want = brute_kneser_ney(texts)[0]
    monkeypatch.setattr(toxicity, "CHUNK", 100)
    monkeypatch.setattr(toxicity, "HELD", 50)
    assert {r.g: (r.toxic, r.ordinary) for r in toxicity.gram_counts(df).collect()} == want


SCRIPTS = {
    "latin": ("the ther onan inge stre ble ande ish".split(), "vequ", "a ist onde erre iss ale".split(), " "),
    "cyrillic": ("тор ман ления прос дерев слова рука".split(), "дурз", "а ист онде ерре".split(), " "),
    "han": (list("山川日月水火木金土人口目耳手足心"), "呪罵", list("山川日月"), ""),
    "words": ("you the die of and now go was here home it did".split(), "you die", [""], " "),  # ordinary words, never together elsewhere
}


def corpus_with(script, n=900, seed=0):
    rng = random.Random(seed)
    ordinary, stem, ends, between = SCRIPTS[script]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(ordinary) for _ in range(rng.randint(20, 80))]
        w = [x for k, x in enumerate(w) if not (script == "words" and x == "die" and k and w[k - 1] == "you")]
        w = between.join(w).replace("you die", "you did").split(between) if between else w
        if i % 6 == 0:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), stem + rng.choice(ends))
        rows.append((i, between.join(w)))
        labels.append((i, int(i % 6 == 0)))
    return rows, labels


@pytest.mark.parametrize("script", SCRIPTS)
def test_toxic_expressions_of_any_script_and_of_ordinary_words(spark, script):
    rows, labels = corpus_with(script)
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    truth = dict(labels)
    held = [(truth[r.doc_id], r.predicted) for r in got if r.held_out]
    assert np.mean([p for y, p in held if y]) >= 0.9 and np.mean([p for y, p in held if not y]) <= 0.05


def test_tables_that_are_not_sent_give_the_same_scores(spark, monkeypatch):
    rows, labels = corpus_with("latin", 200)
    docs = spark.createDataFrame([*rows, (None, "vequa"), (3, None), (4, "")], "doc_id long, text string").withColumn("_chunk", F.lit("x"))
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    sent = sorted((str(r.doc_id), r.score) for r in toxicity.score(docs, known).collect())
    monkeypatch.setattr(toxicity, "SEND_ENTRIES", -1)
    monkeypatch.setattr(toxicity, "CHUNK", 3000)
    monkeypatch.setattr(toxicity, "SEND_LABELS", -1)
    joined = sorted((str(r.doc_id), r.score) for r in toxicity.score(docs, known).collect())
    assert [a for a, _ in sent] == [a for a, _ in joined] and [b for _, b in sent] == pytest.approx([b for _, b in joined])


def test_what_is_added_to_the_whole_text_s_difference(spark):
    """On held-out documents the difference of log-likelihoods ranks by itself; words and pairs rank no worse."""
    rows, labels = corpus_with("latin", 600)
    docs, known, truth = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)

    def area(features):
        held = sorted((r.score, truth[r.doc_id]) for r in toxicity.score(docs, known, features=features).collect() if r.held_out)
        ranks = [i for i, (_, y) in enumerate(held) if y]
        m, n = len(ranks), len(held) - len(ranks)
        return (sum(ranks) - m * (m - 1) / 2) / (m * n)

    assert area((0,)) >= 0.9 and area(tuple(range(toxicity.FEATURES))) >= 0.97


def test_toxicity_finds_held_out(spark):
    rng = random.Random(0)
    rows, labels = [], []
    for i in range(900):
        w = [rng.choice(["the", "ther", "onan", "inge", "stre", "ble", "ande", "ish"]) + rng.choice(["", "s", "er"]) for _ in range(rng.randint(10, 80))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), "vequ" + rng.choice(["a", "ist", "onde", "erre", "iss", "ale"]))
        rows.append((i, " ".join(w), "en"))
        labels.append((i, int(toxic)))
    rows += [(None, "the ther", "en"), (2000, None, "en"), (2001, "", "en"), (2001, "", "en"), (2002, "vequ " * 3000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    got = toxicity.score(docs, spark.createDataFrame([*labels, (5, None), (None, 1), (6, 1), (6, 0)], "doc_id long, toxic int")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    truth = dict(labels)
    held = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([p for y, p in held if y]) >= 0.9 and np.mean([p for y, p in held if not y]) <= 0.05
    assert next(r for r in got if r.doc_id == 2002).predicted == 1
    assert {r.held_out for r in got if r.doc_id is None} == {False}


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "words here")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert len({r.score for r in toxicity.score(docs, none).collect()}) == 1
    assert toxicity.score(docs.limit(0), none).count() == 0
    assert catalog.op7_toxicity_kn(spark, SF).count() == 200


# --- pipeline ---


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    saved, columns, steps = Saved(spark), docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(saved.keep(stage(spark, steps[-1], SF)))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert steps[-1].columns == columns
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in steps]
    judged = {r.doc_id for r in catalog.op5_quality_fertility(spark, SF).where("kept").collect()}
    assert ids[1] == judged
    rows = [(r.doc_id, r.text) for r in steps[1].collect()]
    assert ids[2] == {i for i, (_, c) in brute_join(rows).items() if i == c}
    assert ids[3] == ids[4] == ids[5] == ids[2]
    new = {r.doc_id: r.text for r in steps[3].collect()}
    import hashlib

    assert all(r.decoded_sha256 == hashlib.sha256(new[r.doc_id].encode()).hexdigest() for r in steps[5].collect())
    assert {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SF).collect()} == {r.doc_id: r.ids_sha256 for r in steps[5].collect()}


def test_pipeline_on_an_empty_table(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
