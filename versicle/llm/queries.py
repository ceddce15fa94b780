"""The queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versicle.llm import bpe, licenses, packing, quality, rules, simhash, toxicity, urls, vectors, wordpiece
from versicle.llm.common import held_out
from versicle.sources.tables import read_table as _table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.digests(encoded, ranks)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = packing.pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(made.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))
    good = F.col("score") >= 0.5
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "content_score", "meta_score", "score", good.cast("int").alias("predicted"), good.alias("kept"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages")).drop("template", "learnt")


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(_table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op10_wordpiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def queries():
    return {f.__name__: f for f in (op1_byte_bpe, op2_packing, op3_toxicity, op4_quality, op5_licenses, op6_urls, op7_rules, op8_simhash, op9_vectors, op10_wordpiece)}


def oracle_sql() -> dict[str, str]:
    return {"op5_licenses": licenses.sql(), "op6_urls": urls.SQL}
