"""The corpus pipeline: each stage on its own input, and the queries' SQL."""

import os
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from lattica.llm import common, queries

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@needs_tables
def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.table_cut(stage(spark, docs, SF))
        assert docs.columns == columns
        frames.append(docs)
        counts.append(docs.count())
    assert counts[0] >= counts[1] > 0.9 * counts[0] and counts[1] > counts[2] >= counts[3] > 0
    texts = [r["text"] for r in frames[2].collect()]
    assert len(texts) == len(set(texts))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.where("length > 0").select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


@needs_tables
def test_run_and_odd_documents(spark, odd_documents):
    assert corpus_pipeline.run(spark, SF).count() > 0
    docs = odd_documents
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() > 0


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    df = queries.QUERIES[name](spark, SF)
    cursor = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda rows, names: sorted(repr([f"{v:.9g}" if isinstance(v, float) else v for _, v in sorted(zip(names, r))]) for r in rows)
    assert key([tuple(r) for r in df.collect()], df.columns) == key(cursor.fetchall(), columns)
