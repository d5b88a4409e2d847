"""Queries opN_<name> over the whole tables, with the operators' production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.llm import ann, jaccard_join, langid, mixing, packing, pii, stream_dedup, token_counts, token_store, toxicity
from shelfmark.llm.common import documents
from shelfmark.llm.tokenize import tokenizer_path


def op1_toxicity(spark, sf_dir):
    return toxicity.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_ngram_jaccard_join(spark, sf_dir):
    return jaccard_join.link(documents(spark, sf_dir), size=5, percent=80)


def op3_nearest_neighbours(spark, sf_dir):
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, k=20)


def op4_language_id(spark, sf_dir):
    return langid.identify(documents(spark, sf_dir))


def op5_token_store(spark, sf_dir):
    return token_store.store(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), end=2)


def op6_personal_data(spark, sf_dir):
    return pii.find(documents(spark, sf_dir))


def op7_sequence_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), capacity=1024, end=2)


def op8_token_counts(spark, sf_dir):
    return token_counts.count(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), limit=512)


def op9_source_mixing(spark, sf_dir):
    return mixing.select(documents(spark, sf_dir))


def op10_exact_dedup(spark, sf_dir):
    return stream_dedup.dedup(documents(spark, sf_dir))


def queries():
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql():
    return {"op2_ngram_jaccard_join": jaccard_join.ORACLE_SQL, "op9_source_mixing": mixing.oracle_sql(), "op10_exact_dedup": stream_dedup.ORACLE_SQL}
