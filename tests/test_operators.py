"""Hierarchy, derivations, sessions, reconciliation, mutations, levels, stores, streams."""

import pytest
from pyspark.sql import functions as F

from lattica.functions.summary import summarize
from lattica.operators import derive, hierarchy, invariants, levels, mutate, observe, reconcile
from lattica.plans.errors import GraphQueryError
from lattica.plans.graph import ALIASES, ENTITIES, RELATIONS, GraphFrames
from lattica.sources import stores
from lattica.streaming import sessions


def code(f):
    with pytest.raises(GraphQueryError) as e:
        f()
    return e.value.code


def small(spark, rows, edges=(), aliases=()):
    """rows: id -> (scale, parent)."""
    own = [(i, "component", i, None, None, None, "t", s, None, p) for i, (s, p) in rows.items()]
    return GraphFrames(
        spark.createDataFrame(own, ENTITIES), spark.createDataFrame([(f"r{n}", "needs", a, b, None) for n, (a, b) in enumerate(edges)], RELATIONS),
        spark.createDataFrame(list(aliases), ALIASES), 1,
    )


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_containment(spark):
    chain = spark.createDataFrame([("u", None), ("a", "u"), ("l", "a"), ("g", "l"), ("s", None), ("x", "lost")], "id string, parent string")
    assert rows(hierarchy.containment_depth(chain), "id", "depth", "root") == [("a", 1, "u"), ("g", 3, "u"), ("l", 2, "u"), ("s", 0, "s"), ("u", 0, "u"), ("x", 0, "x")]
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "d"), ("f", None)], "id string, parent string")
    assert rows(hierarchy.containment_cycles(ring), "id") == [("a",), ("b",), ("c",)]
    assert rows(hierarchy.containment_depth(ring), "id") == [("f",)]
    assert rows(hierarchy.ancestors(chain), "id", "ancestor")[:4] == [("a", "u"), ("g", "a"), ("g", "l"), ("g", "u")]
    empty = chain.where("false")
    assert hierarchy.containment_depth(empty).count() == 0 and hierarchy.containment_cycles(empty).count() == 0


def test_observed_forest(spark):
    make = lambda *e: spark.createDataFrame(list(e), "container string, child string")
    assert rows(hierarchy.observed_forest(make(("root", "area"), ("area", "leaf"), ("area", "leaf"))), "child", "depth") == [("area", 1), ("leaf", 2), ("root", 0)]
    assert code(lambda: hierarchy.observed_forest(make(("a", "a")))) == "self-containment"
    assert code(lambda: hierarchy.observed_forest(make(("a", "c"), ("b", "c")))) == "ambiguous-containment"
    assert code(lambda: hierarchy.observed_forest(make(("a", "b"), ("b", "a")))) == "containment-cycle"


def test_retire_and_topology(spark):
    g = small(spark, {"a": (None, None), "b": (None, "a"), "c": (None, "b"), "d": (None, "a"), "e": (None, None)}, [("e", "d")])
    want = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    none = spark.createDataFrame([], "id string")
    assert rows(hierarchy.retire(want("a", "b", "c", "d"), g.entities, g.relations, none), "id", "depth") == [("b", 0), ("c", 1)]
    assert rows(hierarchy.retire(want("a", "b", "c", "d"), g.entities, g.relations, want("r0")), "id", "depth") == [("a", 0), ("b", 1), ("c", 2), ("d", 1)]
    needs = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y"), ("y", "x")], "id string, on string")
    assert rows(hierarchy.topological_order(want("a", "b", "c"), needs), "id", "stage") == [("a", 0), ("b", 1), ("c", 2)]
    assert {r["id"]: r["stage"] for r in hierarchy.topological_order(want("a", "x", "y"), needs).collect()} == {"a": 0, "x": None, "y": None}


def test_scale_proposals(spark):
    df = spark.createDataFrame([("p", 12, 20, 3), ("q", None, 80, 1), ("r", None, None, None)], "id string, export_count long, file_count long, reuse_breadth long")
    got = {r["id"]: (r["status"], r["proposal"], r["candidates"]) for r in derive.with_scale_proposal(df).collect()}
    assert got == {"p": ("proposed", "part", ""), "q": ("ambiguous", None, "domain,element"), "r": ("insufficient", None, "")}
    drift = derive.scale_drift(F.lit("part"), F.lit("proposed"), F.lit("domain"))
    assert spark.range(1).select(drift).first()[0] == "drift"


def test_import_edges_and_samples(spark):
    df = spark.createDataFrame([("a", "b", "f", n) for n in range(40)] + [("a", "c", "f", 1)], "source string, target string, resource string, start int")
    got = {r["target"]: (r["n"], len(r["provenance"]), r["partial"]) for r in derive.import_edges(df).collect()}
    assert got == {"b": (40, 32, False), "c": (1, 1, False)}
    assert rows(derive.import_edges(df, most_pairs=1), "target", "partial") == [("b", True)]
    assert rows(derive.reuse_breadth(df.unionByName(df.withColumn("source", F.col("target")))), "target", "reuse_breadth") == [("b", 1), ("c", 1)]


@pytest.mark.parametrize(
    ("content", "name", "want"),
    [
        ("# Persistence\n\nStores the graph on disk. It keeps every generation.", "persistence", "Stores the graph on disk. It keeps every generation."),
        ("The host composes all the layers. " + "It goes on and on about everything " * 8 + ".", "host", "The host composes all the layers."),
        ("<p>x</p>\n\n# T\n\n![b](u)\n\nA **bold** line with [a link](u) in it that goes on for quite a while longer, so it counts as prose.", None, "A bold line with a link in it that goes on for quite a while longer, so it counts as prose."),
        ("# Core", "core", None), ("", "core", None), (None, None, None), ("- a list item that is quite long enough to count", "core", None),
        ("Order management service code", "order-management-service-code", None),
        ("import something from somewhere that is long", None, None), ("    indented code block that is long enough", None, None),
    ],
)
def test_summaries(content, name, want):
    assert summarize(content, "markdown", name) == want


def test_summary_of_comments():
    assert summarize("/**\n * Reads the projection and answers queries.\n */", "text", None) == "Reads the projection and answers queries."
    long = summarize("word " * 80, "markdown", None)
    assert long.endswith("…") and len(long) <= 201


def records(spark, *r):
    return spark.createDataFrame(list(r), "batch long, scope string, key string, kind string, body string")


def test_sessions(spark):
    r = records(spark, (1, "s", "a", "action", "x"), (2, "s", "a", "action", "x"), (2, "s", "b", "action", "y"))
    assert rows(observe.batch_receipts(r), "batch", "accepted", "replayed", "total") == [(1, 1, 0, 1), (2, 1, 1, 2)]
    assert observe.accepted_records(r).count() == 2 and observe.contradictions(r).count() == 0
    declared = spark.createDataFrame([("s",)], "scope string")
    assert observe.completed_snapshot(r, declared, declared).count() == 2
    clash = r.unionByName(records(spark, (3, "s", "a", "action", None)))
    assert rows(observe.contradictions(clash), "key", "versions") == [("a", 2)]
    assert code(lambda: observe.completed_snapshot(clash, declared, declared)) == "observation-contradiction"
    assert code(lambda: observe.completed_snapshot(r, declared, declared.where("false"))) == "observation-coverage-mismatch"
    seq = spark.createDataFrame([("a", 1, 1), ("a", 2, 3), ("a", 3, 3), ("a", 4, 2)], "session string, arrival long, sequence long")
    assert rows(observe.sequence_problems(seq), "arrival") == [(3,), (4,)]


def test_absence_needs_complete_coverage(spark):
    prior = spark.createDataFrame([("s", "a", "action"), ("t", "b", "action"), ("s", "c", "input")], "scope string, key string, kind string")
    coverage = spark.createDataFrame([("s", ["action"], "complete"), ("t", ["action"], "partial")], "scope string, kinds array<string>, state string")
    assert rows(observe.absent_keys(prior, prior.where("false"), observe.complete_kinds(coverage)), "key") == [("a",)]


def test_event_statuses(spark):
    e = spark.createDataFrame([("p", n, g, 0) for n, g in enumerate([1, 2, 2, 1, 5, 6])], "stream string, arrival long, generation long, start long")
    want = ["accepted", "accepted", "duplicate", "reversed", "missed", "accepted"]
    assert [r["status"] for r in observe.event_statuses(e).orderBy("arrival").collect()] == want


def test_reconcile_keeps_edits(spark):
    prior = spark.createDataFrame([("s", "a", "1", True, "A", "t"), ("s", "b", "2", True, "B", "t"), ("s", "c", "3", True, "C", None)], "scope string, key string, component_id string, present boolean, p_name string, p_type string")
    now = spark.createDataFrame([("1", "A", "t"), ("2", "edited", "t"), ("3", "C", None)], "id string, name string, type string")
    new = spark.createDataFrame([("s", "a", "A2", "t"), ("s", "b", "B2", "u"), ("s", "d", "D", "t")], "scope string, key string, name string, type string")
    coverage = spark.createDataFrame([("s", ["component-candidate"], "complete")], "scope string, kinds array<string>, state string")
    got = {r["key"]: (r["action"], r["present"], r["name"], r["type"]) for r in reconcile.component_actions(prior, new, coverage, now).collect()}
    assert got == {"a": ("update", True, "A2", "t"), "b": ("update", True, "edited", "u"), "c": ("retire", False, "C", None), "d": ("create", True, "D", "t")}
    partial = coverage.withColumn("state", F.lit("partial"))
    got = {r["key"]: r["action"] for r in reconcile.component_actions(prior, new, partial, now).collect()}
    assert got["c"] == "retain"


def test_reconcile_structure(spark):
    b = spark.createDataFrame([("s", k, k.upper(), None, None) for k in ("root", "area", "leaf", "lib")], "scope string, key string, component_id string, p_parent string, p_shared boolean")
    forest = spark.createDataFrame([("area", "root"), ("leaf", "area")], "key string, parent_key string")
    breadth = spark.createDataFrame([("lib", 4), ("leaf", 1)], "key string, reuse_breadth long")
    now = spark.createDataFrame([(k, None, None) for k in ("ROOT", "AREA", "LEAF", "LIB")], "id string, parent string, shared boolean")
    got = {r["component_id"]: (r["parent"], r["shared"]) for r in reconcile.structure_actions(b, forest, breadth, now).collect()}
    assert got == {"ROOT": (None, None), "AREA": ("ROOT", None), "LEAF": ("AREA", None), "LIB": (None, True)}


def test_same_content(spark):
    a = spark.createDataFrame([("x", 1), ("x", 1)], "k string, epoch int")
    assert reconcile.same_content(a, a.withColumn("epoch", F.lit(9))).count() == 0
    assert rows(reconcile.same_content(a, a.limit(1)), "side") == [("old",)]


def test_mutations(spark):
    g = small(spark, {"s": ("system", None), "d": ("domain", "s"), "p": ("part", "d"), "q": ("part", "d")}, [("p", "q"), ("q", "d")])
    assert code(lambda: mutate.create_component(g, {"id": "s"})) == "duplicate-entity"
    assert code(lambda: mutate.create_component(g, {"id": "n", "scale": "system", "parent": "d"})) == "scale-coarser-than-parent"
    made = mutate.create_component(g, {"id": "n", "scale": "element", "parent": "p"})
    assert made.generation == 2 and made.entities.count() == 5
    assert mutate.update_component(made, "n", {"name": "N", "scale": None}).entities.where("id = 'n'").first()["scale"] is None
    assert code(lambda: mutate.update_component(g, "p", {"parent": "s"})) == "invalid-patch"
    assert code(lambda: mutate.reparent_component(g, "d", "p")) == "containment-cycle"
    assert mutate.reparent_component(g, "p", None).entities.where("id = 'p'").first()["parent"] is None
    assert code(lambda: mutate.remove_component(g, "q")) == "component-in-use"
    merged = mutate.merge_component(g, "q", "p")
    assert rows(merged.relations, "source", "target") == [("p", "d"), ("p", "p")] and rows(merged.aliases, "source", "target") == [("q", "p")]
    more = spark.createDataFrame([("r9", "needs", "p", None)], "id string, type string, target string, description string")
    none = spark.createDataFrame([], "id string")
    assert mutate.change_relations(g, "s", more, none).relations.count() == 3
    assert code(lambda: mutate.change_relations(g, "s", more.withColumn("id", F.lit("r0")), none)) == "relationship-id-hijack"
    checks = [lambda x: invariants.parent_problems(x.entities)]
    assert mutate.transact(g, lambda x: mutate.reparent_component(x, "d", "p"), checks)[0] == "rejected"
    assert mutate.transact(g, lambda x: x.with_frames(generation=2), checks, expected_generation=1)[0] == "committed"
    assert mutate.transact(g, None, expected_generation=5)[0] == "conflict"


def test_diagnostics(spark):
    g = small(spark, {"s": ("system", None), "d": ("system", "x"), "p": ("bad", "p")}, [("p", "gone")])
    found = {r["problem"] for r in invariants.graph_diagnostics(g).collect()}
    assert {"unknown-endpoint", "unknown-parent", "self-containment", "invalid-scale", "invalid-id"} <= found
    m = spark.createDataFrame([("a", "update"), ("a", "remove"), ("b", "create")], "id string, op string")
    known = spark.createDataFrame([("a",)], "id string")
    assert rows(invariants.mutation_problems(m, known, known), "id", "problem") == [("a", "duplicate-target"), ("b", "target-not-affected")]


def test_index_buckets(spark):
    names = [(f"{n:04d}", "p", f"n{n:04d}") for n in range(450)]
    buckets = levels.index_buckets(spark.createDataFrame(names, "id string, scope string, text string"))
    top = buckets.where("not contains(lineage, '.')").orderBy(F.col("lineage").cast("int")).collect()
    assert [r["n"] for r in top] == [23] * 19 + [13] and top[0]["label"] == "n0000 – n0022"
    assert rows(buckets.where("lineage like '3.%'"), "lineage", "n") == [("3.0", 20), ("3.1", 3)]
    assert levels.index_buckets(spark.createDataFrame(names[:20], "id string, scope string, text string")).count() == 0


def test_stores(spark, tmp_path):
    g = small(spark, {"s": ("system", None), "d": ("domain", "s")}, [("d", "s")])
    root = str(tmp_path / "store")
    assert stores.write_generation(g, root) == 1
    assert code(lambda: stores.write_generation(g, root)) == "stale-generation"
    back = stores.read_generation(spark, root)
    assert back.generation == 1 and back.fingerprint() == g.fingerprint()
    stores.write_generation(back.with_frames(generation=2, relations=back.relations.where("false")), root)
    assert stores.read_generation(spark, root).relations.count() == 0 and stores.read_generation(spark, root, 1).relations.count() == 1
    keys = [stores.source_key("p", "s", i) for i in ("1", "2")]
    ev = spark.createDataFrame([(k, "sc", str(n)) for k in keys for n in range(3)], "source_key string, scope string, key string")
    path = str(tmp_path / "evidence")
    stores.write_evidence(ev, path)
    stores.write_evidence(ev.where(F.col("source_key") == keys[0]).limit(1), path)
    schema = "source_key string, scope string, key string"
    assert stores.read_evidence(spark, path, schema).count() == 4 and stores.read_evidence(spark, path, schema, keys[1]).count() == 3
    (tmp_path / "files/x").mkdir(parents=True)
    for n in ("a.md", "x/b.md", "x/c.txt"):
        (tmp_path / "files" / n).write_text("hello")
    assert stores.read_resources(spark, str(tmp_path / "files"), "*.md").count() == 2
    assert stores.resource_page(spark, str(tmp_path / "files"), 1).first()["path"].endswith("a.md")
    projects = stores.register_project(spark.createDataFrame([], "id string, root string, revision int"), {"id": "p", "root": "/r"}, None)
    assert code(lambda: stores.register_project(projects, {"id": "p", "root": "/q"}, None)) == "stale-project-revision"
    assert stores.register_project(projects, {"id": "p", "root": "/q"}, 1).first()["revision"] == 2


def test_two_writers_of_one_generation(spark, tmp_path):
    from lattica.plans.graph import ALIASES, RELATIONS

    root, raced = str(tmp_path / "store"), []
    none = spark.createDataFrame([], RELATIONS), spark.createDataFrame([], ALIASES)
    of = lambda name: GraphFrames(spark.createDataFrame([("e1", "component", name)], "id string, kind string, name string").selectExpr("*", *[f"string(null) as {c}" for c in ("label", "summary", "intent", "type", "scale", "parent")], "boolean(null) as shared"), *none, 1)
    real = stores.current_generation

    def slow(spark_, root_):
        held = real(spark_, root_)
        if not raced:  # the other one comes between the check and the commit
            raced.append(True)
            stores.write_generation(of("winner"), root)
        return held

    stores.current_generation = slow
    try:
        with pytest.raises(GraphQueryError, match="stale-generation"):
            stores.write_generation(of("loser"), root)
    finally:
        stores.current_generation = real
    back = stores.read_generation(spark, root)
    assert [r["name"] for r in back.entities.collect()] == ["winner"] and back.searchable().first()["searchable"].startswith("e1\n")


def test_scanners(spark, tmp_path):
    from lattica.sources.scanner import Scanner, scan_resources

    def scan(path, content):
        for n, line in enumerate(content.decode().splitlines()):
            yield f"{path}:{n}", "documentation", line

    files = spark.createDataFrame([("a/x.md", b"one\ntwo"), ("b/y.md", b"three")], "path string, content binary")
    scopes = spark.createDataFrame([("s", "a")], "scope string, resource_root string")
    own = Scanner("lines", "main", "1", scan)
    assert rows(scan_resources(own, files, scopes), "scope", "key", "body") == [("s", "a/x.md:0", "one"), ("s", "a/x.md:1", "two")]
    assert code(lambda: scan_resources(own, files, scopes, most_records=1)) == "observation-bound-exceeded"


def test_retries(spark, tmp_path):
    root, g = str(tmp_path / "r"), small(spark, {"s": (None, None)})
    stores.write_generation(g, root)
    raced = []

    def change(now):
        if not raced:  # another writer comes first
            raced.append(stores.write_generation(now.with_frames(generation=now.generation + 1), root))
        return now.with_frames(generation=now.generation + 1)

    done = mutate.with_retries(lambda: stores.read_generation(spark, root), change, lambda p: stores.write_generation(p, root))
    assert done.generation == 3


def test_running_maximum_across_partitions(spark):
    from lattica.plans.ordering import with_max_before, with_rank_in

    own = [("hot", n, (n * 37) % 101) for n in range(300)] + [("a", 1, 5), ("a", 2, 3), (None, 1, 7), (None, 2, 1)]
    df = spark.createDataFrame(own, "k string, at long, v long").repartition(7)
    got = {(r["k"], r["at"]): r["before"] for r in with_max_before(df, "k", "at", "v").collect()}
    want, top = {}, {}
    for k, at, v in sorted(own, key=lambda r: (r[0] or "", r[1])):
        want[k, at] = top.get(k)
        top[k] = max(v, top.get(k, v))
    assert got == want
    ranks = {(r["k"], r["at"]): (r["r"], r["r_of"]) for r in with_rank_in(df.where("k is not null"), "k", "at", name="r").collect()}
    assert ranks["hot", 299] == (299, 300) and ranks["a", 2] == (1, 2)
