"""The small graph of four entities: reads, searches, pages, traversals."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lattica.functions import scalars as S
from lattica.operators import aliases, query, traverse
from lattica.plans import paging
from lattica.plans.errors import GraphQueryError
from lattica.plans.graph import ALIASES, ENTITIES, RELATIONS, GraphFrames, load_graph


def ent(n):
    return f"ent_{n:032x}"


def rel(n):
    return f"rel_{n:032x}"


NAMES = {1: ("component", "Order API", "service", "domain", False), 2: ("component", "Payment Service", "service", "part", True),
         3: ("component", "Invoice Worker", "service", "part", False), 4: ("evidence", "Order evidence", "evidence", "element", None)}
EDGES = [(1, 1, 2, "requires"), (2, 2, 3, "emits"), (3, 3, 1, "requires"), (4, 4, 2, "requires")]


def entities(spark, rows):
    return spark.createDataFrame([(ent(n), k, name, None, None, None, t, sc, sh, None) for n, (k, name, t, sc, sh) in rows.items()], ENTITIES)


def relations(spark, rows):
    return spark.createDataFrame([(rel(n), t, ent(a), ent(b), None) for n, a, b, t in rows], RELATIONS)


@pytest.fixture(scope="module")
def graph(spark):
    return GraphFrames(entities(spark, NAMES).cache(), relations(spark, EDGES).cache(), spark.createDataFrame([(ent(9), ent(1))], ALIASES).cache(), 7)


def ids(df, column="id"):
    return sorted(int(r[column].split("_")[1], 16) for r in df.collect())


def code(f):
    with pytest.raises(GraphQueryError) as e:
        f()
    return e.value.code


def test_pages_and_cursors(graph):
    own = query.entities_where(graph, "component")
    q = {"kind": "component"}
    first = paging.page(own, "id", 2, q, graph)
    assert [r["id"] for r in first.items] == [ent(1), ent(2)] and first.has_more
    last = paging.page(own, "id", 2, q, graph, first.next_cursor)
    assert [r["id"] for r in last.items] == [ent(3)] and not last.has_more and last.next_cursor is None
    other = query.entities_where(graph, "evidence")
    assert code(lambda: paging.page(other, "id", 2, {"kind": "evidence"}, graph, first.next_cursor)) == "cursor-query-mismatch"
    stale = graph.with_frames(generation=8)
    assert code(lambda: paging.page(own, "id", 2, {"kind": "x"}, stale, first.next_cursor)) == "stale-cursor"
    for forged in (ent(4), ent(77)):
        cursor = paging.encode_cursor(forged, 7, paging.canonical({"query": q, "fingerprint": ""}))
        assert code(lambda c=cursor: paging.page(own, "id", 2, q, graph, c)) == "cursor-anchor-mismatch"
    assert code(lambda: paging.page(own, "id", 2, q, graph, "nonsense")) == "malformed-cursor"
    assert code(lambda: paging.page(own, "id", 0, q, graph)) == "invalid-page-limit"


def test_pages_concatenate_to_the_whole(spark, graph):
    rows = {n: ("component", f"c{n}", "t", "part", None) for n in range(1, 24)}
    own = graph.with_frames(entities=entities(spark, rows))
    for size in (1, 7, 23, 50):
        seen, cursor = [], None
        while True:
            p = paging.page(own.entities, "id", size, {}, own, cursor)
            seen += [r["id"] for r in p.items]
            cursor = p.next_cursor
            if not p.has_more:
                break
        assert seen == [ent(n) for n in range(1, 24)]
        if size == 1:
            break


def test_search(graph):
    assert ids(query.search_entities(graph, "ＳＥＲＶＩＣＥ payment")) == [2]
    assert ids(query.search_entities(graph, "component", payload={"scale": "part", "shared": True})) == [2]
    assert ids(query.search_entities(graph, "component", payload={"shared": False})) == [1, 3]
    assert code(lambda: query.search_entities(graph, "  ")) == "invalid-search-text"
    assert code(lambda: query.search_entities(graph, "x" * 257)) == "search-text-too-long"
    assert ids(query.phrase_search(graph.entities, " order a")) == [1]


def test_shared_false_has_two_meanings(graph):
    assert ids(query.list_components(graph, shared=False)) == [1, 3]
    assert ids(graph.entities.where(S.shared_is(graph.entities["shared"], False))) == [1, 3, 4]
    assert ids(graph.entities.where(S.payload_is(graph.entities["shared"], False))) == [1, 3]


def test_exact_reads(graph):
    assert ids(query.exact_entity(graph, ent(9))) == [1]
    assert code(lambda: query.exact_entity(graph, ent(50))) == "unknown-entity"
    assert [r["id"] for r in query.exact_entities(graph, [ent(3), ent(1)]).orderBy("position").collect()] == [ent(3), ent(1)]
    assert code(lambda: query.exact_entities(graph, [ent(1), ent(9)])) == "unknown-entity"
    assert code(lambda: query.exact_relation(graph, rel(50))) == "unknown-relation"


def hits(df):
    return [(r["depth"], int(r["relation"][4:], 16), r["direction"], int(r["entity"][4:], 16)) for r in df.orderBy("depth", "relation").collect()]


def test_traversals(graph):
    assert [h[:2] + h[3:] for h in hits(traverse.traverse(graph, ent(1), 3, "outgoing"))] == [(1, 1, 2), (2, 2, 3), (3, 3, 1)]
    assert [h[:2] + h[3:] for h in hits(traverse.traverse(graph, ent(1), 2, "incoming"))] == [(1, 3, 3), (2, 2, 2)]
    assert [h[:3] for h in hits(traverse.traverse(graph, ent(9), 1, "both"))] == [(1, 1, "outgoing"), (1, 3, "incoming")]
    assert [h[:2] for h in hits(traverse.traverse(graph, ent(1), 3, "outgoing", "requires"))] == [(1, 1)]
    assert code(lambda: traverse.traverse(graph, ent(50), 2)) == "unknown-entity"
    assert code(lambda: traverse.traverse(graph, ent(1), 0)) == "invalid-traversal"
    bounds = traverse.TraversalBounds(visits=2)
    assert code(lambda: traverse.traverse(graph, ent(1), 3, "both", bounds=bounds)) == "traversal-relation-visit-bound-exceeded"
    bounds = traverse.TraversalBounds(relations=2)
    assert code(lambda: traverse.traverse(graph, ent(1), 3, "outgoing", bounds=bounds)) == "traversal-relation-bound-exceeded"


def naive(edges, root, depth, direction, type_):
    """The walk frontier by frontier."""
    frontier, entities_seen, seen, out = [root], {root}, set(), []
    for d in range(1, depth + 1):
        found = []
        for f in sorted(frontier):
            for n, a, b, t in edges:
                if type_ and t != type_:
                    continue
                if a == f and direction != "incoming":
                    found.append((n, f, "outgoing", b))
                if b == f and direction != "outgoing":
                    found.append((n, f, "incoming", a))
        nxt = []
        for n, f, way, e in sorted(found):
            if n not in seen:
                seen.add(n)
                out.append((d, n, way, e))
                if e not in entities_seen:
                    entities_seen.add(e)
                    nxt.append(e)
        frontier = nxt
    return sorted(out)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(0, 10**6))
def test_traversal_equals_the_walk(spark, seed):
    rng = random.Random(seed)
    edges = [(n, rng.randint(1, 6), rng.randint(1, 6), rng.choice("ab")) for n in range(1, rng.randint(2, 14))]
    own = GraphFrames(entities(spark, {n: ("component", "x", "t", None, None) for n in range(1, 7)}), relations(spark, edges), spark.createDataFrame([], ALIASES), 1)
    direction, type_, depth = rng.choice(traverse.DIRECTIONS), rng.choice([None, "a"]), rng.randint(1, 4)
    assert sorted(hits(traverse.traverse(own, ent(1), depth, direction, type_))) == naive(edges, 1, depth, direction, type_)


def test_traversal_pages(graph):
    walk = traverse.traverse(graph, ent(1), 3, "outgoing").cache()
    p = paging.traversal_page(walk, 2, {}, graph)
    assert p.has_more and [r["depth"] for r in p.items] == [1, 2]
    q = paging.traversal_page(walk, 2, {}, graph, p.next_cursor)
    assert [r["depth"] for r in q.items] == [3] and not q.has_more
    cursor = paging.encode_cursor(rel(99), 7, paging.canonical({"query": {}, "fingerprint": ""}))
    assert code(lambda: paging.traversal_page(walk, 2, {}, graph, cursor)) == "cursor-anchor-mismatch"


def test_alias_chain(spark):
    own = load_graph(
        entities(spark, {3: ("component", "c", "t", None, None)}), relations(spark, [(1, 1, 2, "depends-on")]),
        spark.createDataFrame([(ent(2), ent(3)), (ent(1), ent(2))], ALIASES),
    )
    ends = {r["source"]: (r["resolved"], r["chain"]) for r in aliases.resolve_aliases(own.aliases).collect()}
    assert ends == {ent(1): (ent(3), [ent(2), ent(3)]), ent(2): (ent(3), [ent(3)])}
    r = own.relations.first()
    assert (r["source"], r["target"]) == (ent(3), ent(3))


def test_long_alias_chain(spark):
    df = spark.createDataFrame([(ent(n), ent(n + 1)) for n in range(1, 301)], ALIASES)
    got = {r["source"]: (r["resolved"], r["hops"]) for r in aliases.resolve_aliases(df).collect()}
    assert len(got) == 300 and got[ent(1)] == (ent(301), 300) and got[ent(300)] == (ent(301), 1)


def test_alias_problems(spark):
    pairs = [(1, 1), (2, 3), (3, 2), (4, 5), (4, 6), (7, 8), (10, 11), (12, 2)]
    live = entities(spark, {n: ("component", "c", "t", None, None) for n in (5, 6, 10, 11)})
    got = {(int(r["source"][4:], 16), r["problem"]) for r in aliases.alias_problems(spark.createDataFrame([(ent(a), ent(b)) for a, b in pairs], ALIASES), live).collect()}
    assert got >= {(1, "self-alias"), (2, "alias-cycle"), (3, "alias-cycle"), (12, "alias-cycle"), (4, "duplicate-alias"), (7, "unknown-alias-target"), (10, "alias-source-is-live")}
    assert aliases.resolve_aliases(spark.createDataFrame([], ALIASES)).count() == 0


def test_load_refuses(spark, graph):
    twice = graph.entities.unionByName(graph.entities)
    assert code(lambda: load_graph(twice, graph.relations, graph.aliases)) == "duplicate-entity"
    loose = graph.relations.unionByName(relations(spark, [(9, 1, 70, "x")]))
    assert code(lambda: load_graph(graph.entities, loose, graph.aliases)) == "unknown-endpoint"
    assert code(lambda: load_graph(graph.entities, graph.relations, graph.aliases, "component")) == "wrong-entity-kind"


def test_fingerprint_ignores_dealing(spark, graph):
    again = graph.with_frames(entities=graph.entities.repartition(3), relations=graph.relations.orderBy("target"))
    assert again.fingerprint() == graph.fingerprint()
    assert graph.with_frames(relations=graph.relations.limit(3)).fingerprint() != graph.fingerprint()
    row = graph.identity().first()
    assert row["generation"] == 7 and row["fingerprint"].startswith("sha256:")


def test_adjacency_export_detail(spark, graph):
    got = {r["id"]: (len(r["incoming"]), len(r["outgoing"])) for r in graph.adjacency().collect()}
    assert got == {ent(1): (1, 1), ent(2): (2, 1), ent(3): (1, 1), ent(4): (0, 1)}
    bound = spark.createDataFrame([(ent(1), True), (ent(2), False)], "component_id string, present boolean")
    rows = {r["id"]: (r["evidence_bound"], [x["relation"] for x in r["relations"]]) for r in query.export_blueprint(graph, bound).collect()}
    assert rows == {ent(1): (True, [rel(1)]), ent(2): (False, [rel(2)]), ent(3): (False, [rel(3)])}
    view, page = query.component_detail(graph, ent(9), bound)
    assert view.first()["evidence_bound"] and [r["id"] for r in page.items] == [rel(1)]
    assert ids(query.static_detail(graph, ent(1))) == [1, 3]
    assert paging.canonical_size(page.items) > 50
    assert query.incident_relations(graph, ent(2), "incoming").count() == 2
    pages = list(query.export_pages(graph, bound, limit=2))
    assert [[r["id"] for r in p.items] for p in pages] == [[ent(1), ent(2)], [ent(3)]]
    assert code(lambda: list(query.export_pages(graph, bound, limit=1, most_pages=2))) == "export-bound-exceeded"


def test_empty_graph(spark):
    from lattica.sources.star import empty_graph

    own = empty_graph(spark)
    assert query.list_roots(own).count() == 0 and own.adjacency().count() == 0 and own.fingerprint().startswith("sha256:")


def test_scalars(spark):
    from pyspark.sql import functions as F

    one = lambda c: spark.range(1).select(c).first()[0]
    lit = F.lit
    assert one(S.kind_valid(lit("a.b-c1"))) and not one(S.kind_valid(lit("A"))) and not one(S.kind_valid(lit(None).cast("string")))
    assert one(S.open_token_valid(lit("a_b"))) and not one(S.kind_valid(lit("a_b")))
    assert one(S.icon_domain_valid(lit("a.example.org"))) and not one(S.icon_domain_valid(lit("10.0.0.1"))) and not one(S.icon_domain_valid(lit("a")))
    assert not one(S.label_valid(lit(" x"))) and one(S.label_valid(lit("x" * 80))) and not one(S.label_valid(lit("x" * 81)))
    assert one(S.coarser(lit("system"), lit("part"))) and one(S.coarser(lit("x"), lit("part"))) is None
    assert one(S.relation_label(lit("imports"))) == "needs" and one(S.relation_label(lit("informs"))) == "tells"
    assert one(S.relation_label(lit("reads_from"))) == "reads from" and one(S.relation_label(lit("a" * 19))) == "relates"
    assert one(S.locator_within(lit("a/b"), lit("a"))) and not one(S.locator_within(lit("ab"), lit("a")))
    assert not one(S.locator_valid(lit("a/../b"))) and one(S.locator_valid(lit("a/b.txt")))
    assert one(S.source_lines(lit("a\nb"))) == 2 and one(S.source_lines(lit(""))) == 0
    packages = {"@a/b/c": "@a/b", "x/y": "x", "./x": None, "/x": None, "#x": None, "": None, "node:fs/promises": "node:fs", "fs": "node:fs", "x//y": None, "@a": None, "x/../y": None, "bun:test": "bun:test"}
    assert {k: one(S.package_of(lit(k))) for k in packages} == packages
    assert one(S.nearest_depth(F.array(lit("a/b/c"), lit("a/b")))) == 2
    assert one(S.normalized(lit("ＡＢ"))) == "ab" and one(S.surface_label(lit("incoming"), lit("requires"))) == "Needed by"
    assert one(S.surface_label(lit("outgoing"), lit("x"))) == "Relates to" and one(S.surface_label(lit("incoming"), lit("informs"))) == "Told by"
    assert one(S.extensions_valid(F.create_map(lit("a:b"), lit(1)))) and not one(S.extensions_valid(F.create_map(lit("ab"), lit(1))))
