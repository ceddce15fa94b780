"""Registered queries and the pipeline over the small tables."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from versicle.llm import packing, queries

from test_shingles import brute_force

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_gives_the_same_rows(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    found = queries.queries()[name](spark, SF)
    wanted = con.sql(queries.oracle_sql()[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    columns = sorted(found.columns)
    at = [wanted.columns.index(c) for c in columns]
    assert sorted(str(tuple(r[c] for c in columns)) for r in found.collect()) == sorted(str(tuple(r[k] for k in at)) for r in wanted.fetchall())


def test_ten_queries_with_their_columns(spark):
    found = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in found) == list(range(1, 11))
    columns = {1: ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], 3: ["doc_id", "held_out", "score", "predicted"], 6: ["page_id", "host", "path", "rule", "verdict"], 8: ["doc_id", "fingerprint", "component_id"], 9: ["vec_id", "n_links", "component_id", "kept"]}
    for name, query in found.items():
        n = int(name[2:].split("_")[0])
        if n in columns:
            assert query(spark, SF).columns[: len(columns[n])] == columns[n]


def test_pipeline_stages(spark, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "simhash", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        before, given = {r.doc_id: r for r in docs.collect()}, docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        assert docs.columns == given.columns and all(before[r.doc_id] == r for r in after)
        if name == "simhash":  # one of each group of five-word shingle similarity 0.8 stays, the smallest
            group = brute_force([(i, r.text) for i, r in before.items()])
            assert {r.doc_id for r in after} == {i for i in group if group[i] == i}
    packed = corpus_pipeline.STAGES[3][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.select("doc_id").collect()}
    fill = {}
    for r in packed:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= packing.CAPACITY and len(fill) <= sum(fill.values()) / packing.CAPACITY + 2
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clean = labels.where("toxic = 0 AND quality = 1").count()
    assert 0 < clean and corpus_pipeline.run(spark, SF).count() == len(packed)


def test_pipeline_with_clashing_names_and_odd_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(None, None, None, None, None), (900001, None, "en", "src0", 0), (900002, "", None, None, None), (900003, " \n", "en", "src1", 2), (900003, " \n", "en", "src1", 2), (900004, "ab " * 50_000, "de", "src2", 150_000)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    extra = ["score", "content_score", "meta_score", "k0", "m_lang", "id", "rows", "component_id", "fp", "__text", "__id", "__rows", "label", "rank", "piece", "length", "ids", "sequence_id"]
    for name, table in (("plain", docs), ("wide", docs.select("*", *[F.lit(n).alias(c) for n, c in enumerate(extra)]))):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / name / "labels.parquet"))
    plain, wide = (spark.read.parquet(str(tmp_path / name / "documents.parquet")) for name in ("plain", "wide"))
    for name, stage in corpus_pipeline.STAGES[:3]:
        rows = stage(spark, wide, SF)
        assert rows.columns == wide.columns
        assert sorted(map(str, rows.select(*plain.columns).collect())) == sorted(map(str, stage(spark, plain, SF).collect()))
    found = [corpus_pipeline.run(spark, str(tmp_path / name)).select("doc_id", "piece", "length").collect() for name in ("plain", "wide")]
    assert sorted(map(str, found[0])) == sorted(map(str, found[1])) != []


def test_pipeline_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
