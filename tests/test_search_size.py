"""Searches return what all scores would, and shuffle a few rows for each question instead of one for each pair."""

from pyspark.sql import functions as F

from versicle.operators import dense, lexical
from versicle.sources.shared import few, settled


def _shuffled(spark):
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))


def _first(scores, column):
    return {(r.qid, r.id, r["rank"]) for r in lexical.ranked(scores, ["qid"], [F.desc(column), F.asc("id")]).collect()}


def test_words_shared_by_all_make_no_row_for_each_pair(spark):
    documents = spark.range(6000).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("common words "), F.when(F.col("id") % 3 == 0, F.concat(F.lit("rare"), F.col("id") % 50)).otherwise("")).alias("text"), (F.col("id") % 2).alias("target"))
    questions = spark.range(400).select(F.col("id").alias("qid"), F.concat(F.lit("common word rare"), F.col("id") % 50).alias("search_text"), (F.col("id") % 2).alias("target"))
    questions, documents = settled(questions), settled(documents)
    before = _shuffled(spark)
    found = {(r.qid, r.id, r["rank"]) for r in lexical.lexical_topk(questions, documents, target_col="target").collect()}
    assert _shuffled(spark) - before < 4_000_000
    assert found == _first(lexical.bm25(questions, documents, target_col="target"), "score")


def test_copies_of_vectors_are_not_all_returned_by_tasks(spark):
    vectors = settled(spark.range(8000).select(F.col("id").cast("string").alias("id"), F.array(F.lit(1.0), (F.col("id") % 3).cast("double")).alias("vector")))
    questions = settled(spark.range(300).select(F.col("id").alias("qid"), F.array(F.lit(1.0), (F.col("id") % 4).cast("double")).alias("vector")))
    before = _shuffled(spark)
    found = {(r.qid, r.id, r["rank"]) for r in dense.dense_topk(questions, vectors).collect()}
    assert _shuffled(spark) - before < 4_000_000
    met = questions.crossJoin(vectors.withColumnRenamed("vector", "v")).select("qid", "id", F.round(dense.cosine(F.col("vector"), F.col("v")), 6).alias("similarity"))
    assert found == _first(met, "similarity")


def test_tables_over_the_bound_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr("versicle.sources.shared.BROADCAST_ROWS", 3)
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString()
    assert hinted(few(spark.range(3))) and not hinted(few(spark.range(4)))
