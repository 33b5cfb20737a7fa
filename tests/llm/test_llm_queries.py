import math

import duckdb
import pytest

import corpus_pipeline
from granulith.llm import queries, superminhash, wu_manber

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    assert rows and not any(isinstance(v, float) and math.isnan(v) for r in rows for v in r)
    if name in queries.ORACLES:
        con = duckdb.connect()
        for t in ("documents", "pages", "benchmark", "labels"):
            con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
        rel = con.sql(queries.ORACLES[name])
        at = [rel.columns.index(c) for c in cols]
        assert sorted(rel.columns) == cols and rows == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        if name == "toxicity":
            said = spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").join(docs, "doc_id").where("crc32(cast(doc_id as string)) % 5 <> 0")
            left = out.join(said, "doc_id", "left_semi").count()
            assert said.count() >= 10 and left <= said.count() // 5 and out.count() >= before - 2 * said.count()
        if name == "line dedup":
            assert out.count() == before and out.where("n_chars <> length(text)").count() == 0
        if name == "near duplicates":
            assert superminhash.near_duplicates(out).where("not kept").count() == 0
        if name == "decontamination":
            bench = spark.read.parquet(f"{SF}/benchmark.parquet")
            assert wu_manber.occurrences(out, bench).where("size(hits) > 0").count() == 0
        assert 0 < out.count() <= before
        docs, before = out, out.count()
    assert docs.where("not round_trip").count() == 0


def test_pipeline_stages_take_odd_rows(spark, make_docs, corpus, tmp_path):
    """Nulls, repeated rows and clashing names pass through every stage."""
    docs = make_docs(corpus).selectExpr("*", "length(text) as n_chars")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert docs.where("doc_id is null").count() == 2


def test_pipeline_of_an_empty_table(spark, make_docs, tmp_path):
    docs = make_docs([]).selectExpr("*", "length(text) as n_chars")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.count() == 0


def test_pipeline_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
