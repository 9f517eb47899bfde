"""License scans: a positional index of rare licence words.

The templates are short passages that stand in the notices of common licences.  Their words, without
the most common ones of English, are postings (word, template, position).  For each document and each
template whose mandatory key phrases all stand in the document the operator takes the template's words of
highest inverse document frequency over all documents, looks up their postings, intersects them by
position relative to the template's start, and accepts the template when enough of the looked-up words
stand in line.  Short grants, such as "released under the MIT License", are known by their phrase alone.

A word is a run of characters other than 0x00-2F, 3A-60 and 7B-7F after A-Z are lower-cased.  Null and
empty texts have no words and no labels; texts of any length are read as a whole, repeated rows give repeated
results, and columns other than id and text are not looked at, whatever their names.  Everything is Spark expressions; texts are read once, and
later steps use a written table of the licence words found.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergeview.llm.tables import Saved

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RARE_WORDS = 12  # of a template in a document that are looked up
LEAST_ALIGNED = 0.6  # share of a template's looked-up words that stand in line
LEAST_WORDS = 3

#: Base phrases and their labels.  Fixed values.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: label -> passages of the licence's usual notice, mandatory key phrases.
TEMPLATES: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "mit": (
        ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",),
        ("permission is hereby granted", "sublicense"),
    ),
    "apache-2.0": (
        ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",),
        ("apache license version 2 0",),
    ),
    "bsd": (
        ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
        ("redistribution and use in source and binary forms",),
    ),
    "isc": (
        ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",),
        ("with or without fee is hereby granted",),
    ),
    "mpl-2.0": (
        ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",),
        ("mozilla public license",),
    ),
    "gpl": (
        ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",),
        ("gnu general public license",),
    ),
    "lgpl": (
        ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",),
        ("gnu lesser general public license",),
    ),
    "cc-by": (
        ("this work is licensed under a creative commons attribution 4 0 international license to view a copy of this license visit",),
        ("creative commons attribution",),
    ),
    "unlicense": (
        ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",),
        ("unencumbered software", "public domain"),
    ),
}

#: label -> phrases that grant the licence by its name.
GRANTS: dict[str, tuple[str, ...]] = {
    "mit": ("mit license", "mit licence", "mit x11 license"),
    "apache-2.0": ("apache license version 2", "apache license 2 0", "apache license v2", "apache 2 0 license", "apache 2 license"),
    "bsd": ("bsd license", "bsd licence", "bsd 2 clause", "bsd 3 clause", "bsd style license"),
    "isc": ("isc license", "isc licence"),
    "mpl-2.0": ("mozilla public license version 2", "mozilla public license v 2", "mozilla public license 2", "mpl 2 0"),
    "gpl": ("gnu general public license", "gnu gpl"),
    "lgpl": ("gnu lesser general public license", "gnu lgpl"),
    "cc-by": ("creative commons attribution 4 0", "creative commons attribution license", "creative commons attribution international license"),
    "unlicense": ("unlicense",),
}

#: Words of the templates that are no licence words by themselves.
COMMON = frozenset("a above all and any appear are as at be by can copy deal either else except file files following for form forms free if in including is it list may met must not of one option or person purpose sell terms that the this to under use version view visit was with without work you your 0 2 3 4 v".split())


def normal_words(text: Column) -> Column:
    """The text's words in order; A-Z are lower-cased."""
    return F.regexp_extract_all(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(WORD), F.lit(0))


def _starts(words: Column, marked: Column, phrase: str) -> Column:
    """Where the phrase's words stand consecutively.  marked: the places of its first word, among others."""
    wanted = phrase.split()
    return F.transform(F.filter(marked, lambda h: _all([h["word"] == wanted[0], *(F.get(words, h["at"] + k) == w for k, w in enumerate(wanted) if k)])), lambda h: h["at"])


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def postings(templates) -> list[tuple[str, int, str, int]]:
    """label, passage, word and its place in the passage."""
    return [(label, part, word, at) for label, (passages, _) in templates.items() for part, text in enumerate(passages) for at, word in enumerate(text.split()) if word not in COMMON]


def scan(docs: DataFrame, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    saved = Saved(spark)
    posted = postings(templates)
    keys = [(label, phrase) for label, (_, phrases) in templates.items() for phrase in phrases]
    vocabulary = sorted({w for _, _, w, _ in posted})
    grants = [(label, phrase) for label, phrases in GRANTS.items() for phrase in phrases]
    watched = sorted({*vocabulary, *(p.split()[0] for p in BASE), *(p.split()[0] for _, p in keys + grants)})

    # the one pass over the texts; words is an inner column, which no text expression names twice
    words = docs.select(docs[id_col].alias("doc_id"), F.coalesce(normal_words(docs[text_col]), F.array().cast("array<string>")).alias("words"))
    marked = words.withColumn("marked", F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda h: h["word"].isin(*watched)))
    w, m = F.col("words"), F.col("marked")
    places = {p: _starts(w, m, p) for p in BASE}
    found = F.filter(F.array(*(F.when(F.size(_starts(w, m, p)) > 0, F.lit(f"{label}|{p}")) for label, p in keys)), lambda x: x.isNotNull())
    granted = F.filter(F.array(*(F.when(F.size(_starts(w, m, p)) > 0, F.lit(label)) for label, p in grants)), lambda x: x.isNotNull())
    slim = marked.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"),
        *(places[p].alias(f"base{k}") for k, p in enumerate(BASE)),
        F.when(F.size("marked") > 0, found).alias("phrases"), F.when(F.size("marked") > 0, granted).alias("granted"),
        F.filter("marked", lambda h: h["word"].isin(*vocabulary)).alias("marked"),
    )
    slim = saved.keep(slim)

    hits = slim.where(F.size("marked") > 0).select("row", F.explode("marked").alias("h")).select("row", F.col("h.word").alias("word"), F.col("h.at").alias("at"))
    # document frequency of each licence word over all documents: as many rows as the vocabulary has words
    n = slim.count()
    frequency = {r["word"]: r["n"] for r in slim.select(F.explode(F.array_distinct(F.transform("marked", lambda h: h["word"]))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    rank = {word: i for i, word in enumerate(sorted(vocabulary, key=lambda x: (frequency.get(x, 0), x)))}
    # rarest first: a word of the same rank in all documents, so the choice per document and template is the smallest ranks
    ranks = F.create_map(*(x for word, i in rank.items() for x in (F.lit(word), F.lit(i))))
    passages = sorted({(label, part) for label, part, _, _ in posted})
    own_ranks = {at: sorted({rank[w] for label, part, w, _ in posted if (label, part) == at}) for at in passages}
    told = lambda label: F.size(F.array_except(F.array(*(F.lit(f"{label}|{p}") for p in templates[label][1])), F.col("phrases"))) == 0
    choice = lambda at: F.slice(F.array_sort(F.array_intersect(F.col("ranks"), F.array(*map(F.lit, own_ranks[at])))), 1, RARE_WORDS)
    in_document = slim.where((F.size("marked") > 0) & (F.size("phrases") > 0)).select("row", "phrases", F.array_distinct(F.transform("marked", lambda h: F.element_at(ranks, h["word"]))).alias("ranks"))
    chosen = in_document.select("row", F.explode(F.array(*(F.when(told(at[0]), F.struct(F.lit(at[0]).alias("label"), F.lit(at[1]).alias("part"), choice(at).alias("chosen"))) for at in passages))).alias("x")).where("x is not null")
    index = spark.createDataFrame([(label, part, rank[word], at) for label, part, word, at in posted], "label string, part int, rank int, place int")
    looked_up = chosen.select("row", "x.label", "x.part", F.explode("x.chosen").alias("rank"))
    postings_of = F.broadcast(index)  # as long as the templates
    wanted = looked_up.groupBy("row", "label", "part").agg(F.count("*").alias("wanted"))
    placed = hits.join(F.broadcast(spark.createDataFrame(list(rank.items()), "word string, rank int")), "word").join(looked_up, ["row", "rank"]).join(postings_of, ["label", "part", "rank"])
    in_line = placed.groupBy("row", "label", "part", (F.col("at") - F.col("place")).alias("start")).agg(F.countDistinct("rank").alias("n"))
    best = in_line.groupBy("row", "label", "part").agg(F.max("n").alias("n")).join(wanted, ["row", "label", "part"])
    fit = best.where((F.col("n") >= LEAST_WORDS) & (F.col("n") >= LEAST_ALIGNED * F.col("wanted")))
    labels = saved.keep(fit.groupBy("row").agg(F.collect_set("label").alias("own"), F.max(F.col("n") / F.col("wanted")).alias("score")))

    starts = F.concat(*(F.col(f"base{k}") for k in range(len(BASE))))
    base = F.filter(F.array(*(F.when(F.size(f"base{k}") > 0, F.lit(label)) for k, label in enumerate(BASE.values()))), lambda x: x.isNotNull())
    text_of = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    no_labels = F.array().cast("array<string>")
    out = slim.drop("marked", "phrases").join(labels, "row", "left")
    return out.select(
        "doc_id", "n_words", F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        text_of(base).alias("base_labels"), text_of(F.concat(base, F.coalesce("granted", no_labels), F.coalesce("own", no_labels))).alias("labels"),
        F.coalesce("score", F.when((F.size(base) > 0) | (F.size(F.coalesce("granted", no_labels)) > 0), 1.0).otherwise(0.0)).alias("score"),
    )


assert all(re.fullmatch("[a-z0-9 ]+", t) for passages, phrases in TEMPLATES.values() for t in (*passages, *phrases))
