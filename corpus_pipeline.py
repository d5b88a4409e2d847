"""The corpus pipeline: from documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the
last return the columns of documents:

1. language: drops documents without a letter or of whose language the model is not sure;
2. exact_dedup: of texts equal up to white space one row stays;
3. near_dedup: of texts linked by 5-word shingles at a similarity of 0.8 or more one stays;
4. mixing: a token budget flows to domains, languages and sources by weight;
5. packing: sequences of at most 1,024 tokens, one row per piece.

run() applies them with Parquet between stages, in the folder of spark.checkpoint.dir.

Defined results: documents of null or empty text, or without a letter, go in the first stage; null lang and source
count as the children named ''; rows with null doc_id go in mixing at the latest; of rows that repeat doc_id and text
one stays, and rows that share a doc_id alone stand or fall by their own text; an empty table gives no rows; other
columns, whatever their names, are carried up to packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm import jaccard_join, langid, mixing, packing, stream_dedup
from shelfmark.llm.common import discard, documents, materialise, small_batches
from shelfmark.llm.tokenize import tokenizer_path

#: Four fifths of the tokens, each document once at most.
MIX = mixing.Mix(percent=80, max_epochs=1)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with small_batches(spark):  # while the model is trained
        return langid.accepted(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stream_dedup.keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with small_batches(spark):
        return jaccard_join.keep_one(docs, size=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, MIX)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with small_batches(spark):
        return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), capacity=1024, end=2, lasting=False)


STAGES = [
    ("language", language),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mix),
    ("packing", pack),
]

#: The first stage is a trained classifier, which SQL cannot express; a test holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
