"""Registered queries and the pipeline on the smallest tables."""

import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from candleworks.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q for q in queries.QUERIES if q != "op12_phrases"))
def test_query_covers_its_table(spark, name):
    found = queries.QUERIES[name](spark, SF)
    table, key = ("embeddings", "vec_id") if name.startswith(("op8", "op11")) else ("documents", "doc_id")
    ids = {r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()}
    assert {r[0] for r in found.select(key).collect()} == ids


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    found = queries.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(found.columns)
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(want.fetchall())


def test_pipeline_stages_work_on_all_that_is_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, None, "s", 0), (9002, "123 ?", None, "s", 5), (9003, "The the and of it. Mail me: jo@example.com", "en", "s", 42)], docs.schema)
    docs = docs.union(extra).union(docs.limit(3).withColumn("doc_id", F.col("doc_id") + 5000))
    columns = docs.columns
    before = {r.doc_id for r in docs.collect()}
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.durable(stage(spark, docs, SF))
        assert docs.columns == columns
        rows = docs.collect()
        kept[name] = {r.doc_id for r in rows}
        assert kept[name] <= before and len(rows) == len(kept[name])
        before = kept[name]
    assert not kept["language_id"] & {9001, 9002} and 9003 in before
    assert not any(i >= 5000 and i < 9000 for i in kept["near_dedup"])
    mail = next(r for r in rows if r.doc_id == 9003)
    assert mail.text.endswith("<EMAIL>") and mail.n_chars == len(mail.text)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in last} == before
    assert all(0 <= r.ids_crc32 <= zlib.crc32(b"") + (1 << 32) for r in last)
