"""Lists in chunks with a cursor inside an owner, whole enumerations, and the index of three-character strings."""

import random

import pytest
from pyspark.sql import functions as F

from lattica.functions.scalars import search_terms
from lattica.operators import query
from lattica.plans import lists
from lattica.plans.errors import GraphQueryError
from lattica.plans.graph import ALIASES, ENTITIES, RELATIONS, GraphFrames
from lattica.sources import stores


def graph_of(spark, names, relations=()):
    e = [(f"ent_{n:032x}", "component", name, None, None, None, None, None, None, None) for n, name in enumerate(names)]
    return GraphFrames(spark.createDataFrame(e, ENTITIES), spark.createDataFrame(list(relations), RELATIONS), spark.createDataFrame([], ALIASES), 1)


def test_a_hub_is_paged_and_no_row_is_longer_than_a_chunk(spark):
    hub = spark.range(20000).select(F.lit("hub").alias("o"), F.format_string("r%08d", "id").alias("i"))
    rest = spark.range(300).select(F.concat(F.lit("x"), (F.col("id") % 7).cast("string")).alias("o"), F.format_string("s%08d", "id").alias("i"))
    held = lists.chunked(hub.unionByName(rest).unionByName(rest), "o", "i", size=128).cache()
    assert held.agg(F.max("n")).first()[0] == 128 and held.where("n < 128").groupBy("owner").count().where("count > 1").count() == 0
    assert held.groupBy("owner").agg(F.sum("n").alias("n")).where("owner = 'hub'").first()["n"] == 20000
    graph, asked, got, cursor = graph_of(spark, []), {"op": "l"}, [], None
    for n in range(4):
        page = lists.list_page(held, "hub", 100, asked, graph, cursor)
        got += [r["item"] for r in page.items]
        cursor = page.next_cursor
    assert got == [f"r{n:08d}" for n in range(400)]
    assert lists.list_page(held, "none", 10, asked, graph).items == []
    with pytest.raises(GraphQueryError, match="cursor-query-mismatch"):
        lists.list_page(held, "hub", 100, {"op": "other"}, graph, cursor)
    with pytest.raises(GraphQueryError, match="cursor-anchor-mismatch"):
        lists.list_page(held, "x1", 100, asked, graph, cursor)
    assert lists.chunked(hub.where("false"), "o", "i").count() == 0


def test_all_pages_are_those_of_the_cursor(spark):
    df = spark.createDataFrame([(f"k{n * 7919 % 1009:04d}",) for n in range(250)], "key string")
    pages = {}
    for r in lists.all_pages(df, "key", 40).collect():
        pages.setdefault(r["page"], set()).add(r["key"])
    keys = sorted(r["key"] for r in df.collect())
    assert pages == {n: set(keys[n * 40 : n * 40 + 40]) for n in range(7)}


def test_gram_search_equals_the_scan(spark, tmp_path):
    rng, root = random.Random(8), str(tmp_path / "store")
    parts = ["alpha", "ALPha", "beta", "gam", "ma", "日本語", "x", "12", "123", "1234", "ﬁne", "a b", "é", "\n", "aaa", "aaaa"]
    names = [" ".join(rng.choices(parts, k=rng.randrange(1, 6))) for _ in range(800)] + ["", "only here zq9"]
    stores.write_generation(graph_of(spark, names), root, grams=True)
    graph = stores.read_generation(spark, root)
    assert graph.entities.columns == graph_of(spark, []).entities.columns == query.search_entities(graph, "alpha").columns
    scan = stores.read_generation(spark, root).with_frames(grams=None)
    texts = ["alpha", "alphabeta", "日本語", "日本", "fine 123", "aaaa", "aaa", "ma 12", "x", "zq9", "zq9 alpha", "nowhere", "lpha b", "é", "ent_ component", "1234 GAM 日本語"]
    for text in texts:
        want = sorted(r["id"] for r in query.search_entities(scan, text).collect())
        assert sorted(r["id"] for r in query.search_entities(graph, text).collect()) == want, text
    few = lists.gram_candidates(graph.index, graph.grams, search_terms("zq9 here"))
    assert few.count() == 1 and "PushedFilters: [In(ordinal" in few._jdf.queryExecution().toString().replace("EqualTo(ordinal", "In(ordinal").replace("IsNotNull(ordinal), ", "")
    assert lists.gram_candidates(graph.index, graph.grams, search_terms("component")) is None  # in every row
    some = sum("bet" in n.lower() and "1234" in n for n in names)
    rest = graph.index.unionByName(graph.index.limit(1).crossJoin(spark.range(20000)).drop("id").withColumn("id", F.lit("x")).withColumn("ordinal", F.lit(-1).cast("long")))
    many = lists.gram_candidates(rest, graph.grams, search_terms("bet 1234"), listed=10)
    assert many.count() >= some > 10 and many.count() < 400
    assert graph.grams.agg(F.max(F.size("ordinals"))).first()[0] <= lists.SPAN and lists.gram_candidates(graph.index, graph.grams, ["ab"]) is None


def test_grams_go_with_changed_entities(spark, tmp_path):
    root = str(tmp_path / "store")
    stores.write_generation(graph_of(spark, ["first"]), root, grams=True)
    graph = stores.read_generation(spark, root)
    changed = graph.with_frames(entities=graph.entities.withColumn("name", F.lit("later")))
    assert query.search_entities(changed, "later").count() == 1 and query.search_entities(changed, "first").count() == 0
    stores.write_generation(changed.with_frames(generation=2), root)
    assert stores.read_generation(spark, root).grams is None and query.search_entities(stores.read_generation(spark, root), "later").count() == 1


def test_export_rows_hold_a_hub_in_chunks(spark):
    e = lambda n: f"ent_{n:032x}"
    graph = graph_of(spark, ["hub", "leaf"], [(f"rel_{n:032x}", "uses", e(0), e(1), None) for n in range(70)])
    measured = spark.createDataFrame([(e(0), "p", "s", "i", "1", 3), (e(9), "p", "s", "i", "1", 4)], "component string, project string, scanner string, instance string, version string, value int")
    paths = spark.createDataFrame([(e(0), "p", "s", f"f{n:02d}") for n in range(25)] + [(e(9), "p", "s", "lost")], "component string, project string, scanner string, resource string")
    bound = spark.createDataFrame([(e(1), True)], "component_id string, present boolean")
    rows = query.export_rows(graph, bound, measured, paths, size=20).orderBy("place").collect()
    assert [(r["id"], r["part"], r["chunk"]) for r in rows] == [(e(0), 0, 0), *[(e(0), 1, c) for c in range(4)], (e(0), 2, 0), (e(0), 2, 1), (e(1), 0, 0)]
    assert [len(r["relations"]) for r in rows if r["part"] == 1] == [20, 20, 20, 10] and sum(len(r["paths"]) for r in rows if r["part"] == 2) == 25
    assert [(r["component"]["evidence_bound"], len(r["component"]["measurements"])) for r in rows if r["part"] == 0] == [(False, 1), (True, 0)]


def test_grams_of_odd_texts_are_dealt_as_lists(spark):
    """One row per gram and batch is dealt, not one per gram and text; the lists are those of a plain count."""
    texts = [None, "", "ab", "abc", "abcabc", "a b cde", "née", "x😀yz", "a b", "l1\nl2x", "tab\tbed", *[f"row {k:05d} abc" for k in range(3000)]]
    places = list(range(len(texts) - 1)) + [70_000]
    index = spark.createDataFrame(list(zip(places, texts)), "ordinal long, searchable string").repartition(3)
    want = {}
    for place, text in zip(places, texts):
        for gram in {text[k : k + 3] for k in range(len(text) - 2)} if text else ():
            if not set(gram) & set(" \t\n\v\f\r"):
                want.setdefault((gram, place // lists.SPAN), []).append(place)
    made = lists.gram_lists(index)
    got = {(r["gram"], r["span"]): r["ordinals"] for r in made.collect()}
    assert got == {k: sorted(v) for k, v in want.items()} and made.where("n <> size(ordinals)").count() == 0
    assert "explode" not in made._jdf.queryExecution().toString()
    assert made.schema == spark.createDataFrame([], "gram string, span long, n int, ordinals array<long>").schema
