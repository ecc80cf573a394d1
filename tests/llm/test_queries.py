"""Registered queries against their SQL, and the pipeline's stages, on the smallest tables."""

import duckdb
import pytest

import corpus_pipeline
from basalt.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    rel = c.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF).select(*rel.columns).collect()
    assert sorted(tuple(r) for r in got) == sorted(rel.fetchall())


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.materialize(stage(spark, docs, SF), name)
        assert after.columns == docs.columns and 0 < after.count() <= docs.count()
        docs = after
    assert docs.count() > before / 2
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0
