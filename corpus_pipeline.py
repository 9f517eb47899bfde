"""From raw documents to tokenised training data: quality, near-duplicates, PII, mixture, tokens.

Each stage reads what the one before has written.  All but the last return the columns of documents.
The mixture keeps every document and decides their order.  Order doesn't outlast a table that is written
and read again, and a stage in between may not add columns, so the last stage takes the same schedule,
which follows from the documents alone, and returns each document's token ids with its block, slot and place in it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeview.llm import bpe, jaccard, mixing, pii, quality
from mergeview.llm.catalog import VOCABULARIES, pseudonym_key
from mergeview.llm.tables import Saved, importable


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return quality.keep(docs, VOCABULARIES, public_tokenizers.PATTERN)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return jaccard.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(docs, pseudonym_key(spark))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).orderBy("place").select(*(F.col(f"`{c}`") for c in docs.columns))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    placed = mixing.mix(docs)
    keep = ("source", *mixing.schedule_columns(docs.columns))
    return bpe.encode_documents(placed, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True, keep=keep)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("mixing sources", mixture),
    ("byte-level BPE", encoding),
]

#: Tokens, pseudonyms and set joins have no SQL that is fast enough on whole tables; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, saved = spark.read.parquet(f"{sf_dir}/documents.parquet"), Saved(spark)
    for _, stage in STAGES[:-1]:
        docs = saved.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
