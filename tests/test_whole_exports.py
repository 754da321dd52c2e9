"""Exports of the whole graph."""

import duckdb
from pyspark.sql import functions as F

from lattica.operators import query
from lattica.plans.graph import RELATIONS
from lattica.queries import ORACLE_SQL, changes
from lattica.sources.star import empty_graph, star_graph

TABLES = "/root/testdata/sf0.001"


def test_an_export_has_every_component(spark):
    got = sorted(tuple(r) for r in changes.export_all_pages(spark, TABLES).collect())
    assert len(got) == star_graph(spark, TABLES).entities.count()  # regions, nations and a tenth of the suppliers before
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        con.execute(f"create view {name} as select * from '{TABLES}/{name}.parquet'")
    assert got == sorted(con.execute(ORACLE_SQL["export_all_pages"]).fetchall())


def test_an_export_of_all_is_that_of_its_pages(spark):
    odd, none = ["ent_" + "0f" * 16, "x", "", "é", "lone"], empty_graph(spark)
    rows = spark.createDataFrame([(i, "component", f"n{i}") for i in odd] + [("other", "thing", "y")], "id string, kind string, name string")
    relations = [(f"rel_{n:032x}" if n % 2 else f"r{n}", "t", odd[n % 4], odd[n % 3], None) for n in range(20)] + [("of another kind", "t", "other", "x", None)]
    graph = none.with_frames(entities=none.entities.unionByName(rows, allowMissingColumns=True), relations=spark.createDataFrame(relations, RELATIONS))
    whole, paged = query.export_blueprint(graph), query.export_blueprint(graph, page_of=graph.entities.where("kind = 'component'"))
    assert whole.columns == paged.columns and sorted(whole.collect(), key=lambda r: r["id"]) == sorted(paged.collect(), key=lambda r: r["id"])
    assert whole.where(F.size("relations") == 0).count() == 1
    assert "Join" not in whole._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_an_export_meet_their_components_without_a_join(spark):
    graph = star_graph(spark, TABLES)
    nothing = spark.createDataFrame([], "component string, project string, scanner string, instance string, version string, value int")
    paths = spark.createDataFrame([], "component string, project string, scanner string, resource string")
    rows = query.export_rows(graph, spark.createDataFrame([], "component_id string, present boolean"), nothing, paths, size=50)
    assert "LeftSemi" not in rows._jdf.queryExecution().optimizedPlan().toString()
    whole = query.export_blueprint(graph).where(F.size("relations") > 0).select("id", F.size("relations").alias("n"))
    chunks = rows.where("part = 1").groupBy("id").agg(F.sum(F.size("relations")).alias("n"))
    assert sorted(chunks.collect()) == sorted(whole.collect())
