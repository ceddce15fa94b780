"""The corpus pipeline: toxic and poor documents go, near-duplicates too, and the rest is packed."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versicle.llm import packing, quality, shingles, toxicity
from versicle.llm.common import checkpoint_dir, drop_folder
from versicle.sources.tables import read_table


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5 for toxicity; a model is learnt from the labels of these documents.

    Null and empty texts score the model's bias; rows of one id are each judged; without labels of both kinds all stay.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.rows_where(docs, model, lambda score: score < 0.5)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more for quality.

    Null and empty texts are judged by the features of an empty text and by their metadata; rows of one id are each
    judged; without labels of both kinds all stay; an empty table stays empty.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.rows_where(docs, model, lambda score: score >= 0.5)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8): the one with the smallest id.

    Fingerprints over these shingles link documents first; what no distance of fingerprints covers is found on the shingles.
    Null and empty texts are alike; a null id goes last, rows of one id and different texts are different documents, and of equal
    rows one stays; an empty table stays empty.
    """
    return shingles.representatives(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece.

    A null or empty text is one piece of its end id; repeated rows are packed each; an empty table gives no rows.
    """
    made = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(made.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [("toxicity", not_toxic), ("quality", good_quality), ("simhash", one_of_each), ("packing", packed)]

#: Learning and iterating are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result is written to the shared folder and read again.

    A stage's rows are deleted once the next stage's are written; the last stage's input stays, as its result may still read it.
    """
    at = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if before is not None:
            drop_folder(spark, before)
        before = f"{at}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
