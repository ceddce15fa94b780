"""Reciprocal rank fusion of a dense and a lexical list, by one grouped sum over their union."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versicle.operators.lexical import ranked

RRF_K, TOP_K = 60, 20


def rrf_fuse(dense: DataFrame, lexical: DataFrame, k: int = RRF_K, top_k: int = TOP_K) -> DataFrame:
    """``qid, id, score, best_rank, dense_rank, rank`` from two tables ``qid, id, rank``.

    Order: score, best single rank, dense rank (absent: one more than the dense list is long), id.
    """
    both = dense.select("qid", "id", "rank", F.lit(True).alias("is_dense")).unionByName(lexical.select("qid", "id", "rank", F.lit(False).alias("is_dense")))
    fused = both.groupBy("qid", "id").agg(
        F.round(F.sum(1 / (k + F.col("rank"))), 9).alias("score"),
        F.min("rank").alias("best_rank"),
        F.max(F.when(F.col("is_dense"), F.col("rank"))).alias("dense_rank"),
    )
    sizes = dense.groupBy("qid").agg((F.count("*") + 1).alias("absent"))
    fused = fused.join(sizes, "qid", "left").withColumn("by_dense", F.coalesce("dense_rank", "absent", F.lit(1)))
    return ranked(fused, ["qid"], [F.desc("score"), F.asc("best_rank"), F.asc("by_dense"), F.asc("id")], top_k).drop("absent", "by_dense")
