"""Every registered query of the graph engine against its SQL, on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module
from lattica import queries as own

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else repr(v) for v in (r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(own.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = own.QUERIES[name](spark, SF)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    cursor = duck.execute(own.ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == normal(cursor.fetchall(), columns)


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["depth", "relation", "type", "direction", "from", "entity"] and df.count() > 100
    assert set(own.QUERIES) <= set(entry_module.queries()) and set(own.ORACLE_SQL) <= set(entry_module.oracle_sql())


def test_summaries_of_documents(spark):
    """Against the plain function, document by document."""
    from lattica.functions.summary import summarize

    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = own.QUERIES["document_summary"](spark, SF).collect()
    assert len(rows) == len(docs)
    assert all(r["summary"] == summarize(docs[r["doc_id"]]["text"], "text", docs[r["doc_id"]]["source"]) for r in rows)
