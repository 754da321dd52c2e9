"""Whole reconciles from snapshot to generation, and checks by delta against whole checks."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lattica.operators import invariants, merge, mutate
from lattica.plans.errors import GraphQueryError
from lattica.plans.graph import ALIASES, ENTITIES, RELATIONS, GraphFrames, load_graph
from lattica.sources import stores

COMPONENT = "scope string, key string, icon_domain string, label string, name string, summary string, type string, breadth long"
FULL = [("s", ["component-candidate", "relationship"], "complete")]


def eid(n):
    return f"ent_{n:032x}"


def rid(n):
    return f"rel_{n:032x}"


def graph_of(spark, entities, relations=(), aliases=(), generation=1):
    """entities: (n, name, parent n or None, scale); relations: (n, type, source n, target n)."""
    e = [(eid(n), "component", name, None, None, None, None, scale, None, None if p is None else eid(p)) for n, name, p, scale in entities]
    r = [(rid(n), t, eid(a), eid(b), None) for n, t, a, b in relations]
    a = [(eid(x), eid(y)) for x, y in aliases]
    return GraphFrames(spark.createDataFrame(e, ENTITIES), spark.createDataFrame(r, RELATIONS), spark.createDataFrame(a, ALIASES), generation)


def empty_state(spark, graph):
    return merge.State(graph, {name: spark.createDataFrame([], schema) for name, (schema, _) in merge.TABLES.items()})


def snapshot(spark, names, inside=(), relations=(), coverage=FULL, source="src", breadth=None, documentation=None, **fields):
    rows = [("s", k, None, fields.get("label", {}).get(k), n, None, None, (breadth or {}).get(k)) for k, n in names.items()]
    components = spark.createDataFrame(rows, COMPONENT)
    within = spark.createDataFrame([("s", a, "s", b) for a, b in inside], "container_scope string, container_key string, scope string, key string")
    rel = spark.createDataFrame([("s", k, t, "s", a, "s", b) for k, t, a, b in relations], "scope string, key string, type string, from_scope string, from_key string, to_scope string, to_key string")
    records = spark.createDataFrame([("s", k, "component-candidate", n) for k, n in names.items()], "scope string, key string, kind string, body string")
    doc = documentation and spark.createDataFrame([("s", k, t) for k, t in documentation.items()], "scope string, key string, summary string")
    return merge.Snapshot(source, components, within, rel, records, spark.createDataFrame(coverage, "scope string, kinds array<string>, state string"), doc)


def code(call):
    with pytest.raises(GraphQueryError) as e:
        call()
    return e.value.code


def named(state, *columns):
    """Bound components of all sources by key."""
    met = state.tables["bindings"].select("key", "present", F.col("component_id").alias("id")).join(state.graph.entities, "id", "left")
    return {r["key"]: tuple(r[c] for c in columns) for r in met.collect()}


def test_a_source_creates_updates_and_leaves_what_people_changed(spark, tmp_path):
    root = str(tmp_path / "store")
    merge.write_state(empty_state(spark, graph_of(spark, [(1, "curated", None, "system")])), root)
    first = snapshot(spark, {"a": "A", "b": "B", "c": "C"}, [("a", "b"), ("a", "c")], [("r", "uses", "b", "c"), ("q", "uses", "a", "b")], breadth={"b": 2, "c": 1}, documentation={"a": "What A does."})
    assert merge.reconcile_store(spark, root, first) == ("changed", 2)
    assert merge.reconcile_store(spark, root, first) == ("unchanged", 2) and stores.generations(spark, root) == [1, 2]
    state = merge.read_state(spark, root)
    ids = {k: v[0] for k, v in named(state, "id").items()}
    assert named(state, "name", "parent", "shared", "summary") == {"a": ("A", None, None, "What A does."), "b": ("B", ids["a"], True, None), "c": ("C", ids["a"], None, None)}
    rel = {r["type"]: r for r in state.graph.relations.where(F.col("target") == ids["c"]).collect()}["uses"]
    assert (rel["source"], rel["target"]) == (ids["b"], ids["c"]) and state.graph.entities.count() == 4
    # a person renames b, moves c, retypes r
    by_hand = mutate.update_component(state.graph, ids["b"], {"name": "mine", "label": "L"})
    by_hand = mutate.reparent_component(by_hand, ids["c"], eid(1))
    by_hand = by_hand.with_frames(relations=by_hand.relations.withColumn("type", F.when(F.col("id") == rel["id"], "kept").otherwise(F.col("type"))), generation=3)
    merge.write_state(merge.State(by_hand, state.tables), root)
    second = snapshot(spark, {"a": "A2", "b": "B2", "c": "C2"}, [], [("r", "calls", "b", "c")])
    assert merge.reconcile_store(spark, root, second) == ("changed", 4)
    state = merge.read_state(spark, root)
    assert named(state, "name", "label", "parent", "shared", "summary") == {"a": ("A2", None, None, None, None), "b": ("mine", "L", None, None, None), "c": ("C2", None, eid(1), None, None)}
    assert {(r["id"], r["type"]) for r in state.graph.relations.collect()} == {(rel["id"], "kept")}  # q was seen no more and still as the source left it
    kept = {r["key"]: (r["p_type"], r["present"], r["removed"]) for r in state.tables["relationships"].collect()}
    assert kept == {"r": ("uses", True, False), "q": ("uses", False, True)}
    affected = {(r["id"], r["what"]) for r in stores.read_table(spark, root, "affected", 4, merge.AFFECTED).collect()}
    assert {i for i, w in affected if w == "component"} == set(ids.values()) and len({i for i, w in affected if w == "relation"}) == 1
    # q comes back under its old id
    third = snapshot(spark, {"a": "A2", "b": "B2", "c": "C2"}, [], [("r", "calls", "b", "c"), ("q", "uses", "a", "b")])
    assert merge.reconcile_store(spark, root, third) == ("changed", 5)
    assert {r["key"]: r["removed"] for r in merge.read_state(spark, root).tables["relationships"].collect()} == {"r": False, "q": False}


def test_absence_counts_under_complete_coverage_alone_and_a_hook_retires(spark):
    state = merge.reconcile(empty_state(spark, graph_of(spark, [])), snapshot(spark, {"a": "A", "b": "B", "c": "C"}, [("a", "b")], [("r", "uses", "a", "c")])).state
    partial = merge.reconcile(state, snapshot(spark, {"a": "A"}, coverage=[("s", ["component-candidate", "relationship"], "partial")]))
    assert named(partial.state, "present") == {"a": (True,), "b": (True,), "c": (True,)} and partial.state.graph.relations.count() == 1
    full = merge.reconcile(state, snapshot(spark, {"a": "A"}))
    assert named(full.state, "present", "name") == {"a": (True, "A"), "b": (False, "B"), "c": (False, "C")} and full.state.graph.relations.count() == 0
    kinds = merge.reconcile(state, snapshot(spark, {"a": "A"}, coverage=[("s", ["relationship"], "complete")])).state
    assert named(kinds, "present")["b"] == (True,) and kinds.graph.relations.count() == 0
    hook = lambda entities, relations: entities.where("name in ('A', 'B', 'C')")  # noqa: E731  only absent ones go
    retired = merge.reconcile(state, snapshot(spark, {"a": "A"}), hook).state
    assert {r["name"] for r in retired.graph.entities.collect()} == {"A"} and named(retired, "present")["c"] == (False,)
    # the dangling bindings stay until their keys are seen again, which is refused
    again = merge.reconcile(retired, snapshot(spark, {"a": "A3"})).state
    assert named(again, "name", "present") == {"a": ("A3", True), "b": (None, False), "c": (None, False)}
    assert code(lambda: merge.reconcile(retired, snapshot(spark, {"a": "A", "b": "B"}))) == "reconciliation-binding-missing"


def test_bindings_follow_aliases_and_must_not_meet(spark):
    base = merge.reconcile(empty_state(spark, graph_of(spark, [])), snapshot(spark, {"a": "A", "b": "B"}, [], [("r", "uses", "a", "b")])).state
    ids = {k: v[0] for k, v in named(base, "id").items()}
    other = merge.reconcile(base, snapshot(spark, {"x": "X"}, source="other")).state
    x = named(other, "id")["x"][0]
    merged = lambda s, a, b: merge.State(mutate.merge_component(s.graph, a, b), s.tables)
    free = merge.State(mutate.create_component(other.graph, {"id": eid(77), "name": "free"}), other.tables)
    moved = merged(free, ids["b"], eid(77))
    done = merge.reconcile(moved, snapshot(spark, {"a": "A", "b": "B"}, [], [("r", "uses", "a", "b")]))
    assert named(done.state, "id", "name")["b"] == (eid(77), "free") and done.state.graph.relations.first()["target"] == eid(77)
    assert code(lambda: merge.reconcile(merged(other, ids["a"], ids["b"]), snapshot(spark, {"a": "A", "b": "B"}))) == "reconciliation-binding-ambiguous"
    assert code(lambda: merge.reconcile(merged(other, ids["a"], x), snapshot(spark, {"a": "A", "b": "B"}))) == "reconciliation-binding-ambiguous"


def test_what_a_snapshot_is_refused_for(spark):
    state = empty_state(spark, graph_of(spark, []))
    of = lambda *a, **k: code(lambda: merge.reconcile(state, snapshot(spark, *a, **k)))
    assert of({"a": "A"}, [], [("r", "uses", "a", "lost")]) == "unresolved-observation-reference"
    assert of({"a": "A"}, [("lost", "a")]) == "unresolved-observation-reference"
    assert of({"a": "A", "b": "B"}, [("a", "b"), ("b", "a")]) == "containment-cycle"
    assert of({"a": "A", "b": "B", "c": "C"}, [("a", "b"), ("c", "b")]) == "ambiguous-containment"
    assert of({"a": "A"}, [("a", "a")]) == "self-containment"
    assert of({"a": "A", "b": "B"}, [], [("r", "Not A Type", "a", "b")]) == "invariant-violation"
    twice = snapshot(spark, {"a": "A"})
    twice = merge.Snapshot("src", twice.components.unionByName(twice.components), twice.containment, twice.relationships, twice.records, twice.coverage)
    assert code(lambda: merge.reconcile(state, twice)) == "ambiguous-observation"
    done = merge.reconcile(state, snapshot(spark, {"a": "A", "b": "B"}, [], [("r", "uses", "a", "b")])).state
    bare = merge.State(done.graph.with_frames(relations=done.graph.relations.where("false")), done.tables)
    assert code(lambda: merge.reconcile(bare, snapshot(spark, {"a": "A", "b": "B"}, [], [("r", "uses", "a", "b")]))) == "reconciliation-binding-missing"
    assert merge.reconcile(bare, snapshot(spark, {"a": "A", "b": "B"})).state.tables["relationships"].first()["removed"]


def test_a_reconcile_starts_again_when_another_writer_was_faster(spark, tmp_path, monkeypatch):
    root, raced, real = str(tmp_path / "store"), [], merge.write_state
    real(empty_state(spark, graph_of(spark, [(1, "one", None, None)])), root)

    def write(state, root_, *more):
        if len(raced) < 1:
            raced.append(real(merge.State(graph_of(spark, [(1, "renamed", None, None)], generation=2), merge.read_state(spark, root).tables), root))
        return real(state, root_, *more)

    monkeypatch.setattr(merge, "write_state", write)
    assert merge.reconcile_store(spark, root, snapshot(spark, {"a": "A"})) == ("changed", 3)
    assert {r["name"] for r in merge.read_state(spark, root).graph.entities.collect()} == {"renamed", "A"}
    raced.clear()
    assert code(lambda: merge.reconcile_store(spark, root, snapshot(spark, {"a": "B"}), attempts=1)) == "reconciliation-snapshot-conflict"


# checks by delta ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", [0, 3])
def test_delta_equals_the_whole_check(spark, seed):
    rng, n = random.Random(seed), 60
    scales = ["system", "domain", "part", "element", None]
    # a sound graph: parents have smaller numbers and coarser scales
    rank = {k: rng.randrange(5) for k in range(n)}
    entities = {}
    for k in range(n):
        fit = [p for p in range(k) if rank[p] == 4 or rank[k] == 4 or rank[p] <= rank[k]]
        entities[k] = [f"N{k}", rng.choice(fit) if fit and rng.random() < 0.8 else None, scales[rank[k]]]
    relations = {k: ["uses", rng.randrange(n), rng.randrange(n)] for k in range(80)}
    assert invariants.graph_diagnostics(graph_of(spark, [(k, *v) for k, v in entities.items()], [(k, *v) for k, v in relations.items()])).count() == 0
    changed, edges, gone = set(), set(), set()
    for _ in range(12):
        k, what = rng.randrange(n), rng.randrange(5)
        if k in gone:
            continue
        if what == 0:
            gone.add(k)
        elif what == 1:
            entities[k][1] = rng.choice([k, rng.randrange(n), 999, None])
            changed.add(k)
        elif what == 2:
            entities[k][2] = rng.choice([*scales, "odd"])
            changed.add(k)
        else:
            relations[k] = [rng.choice(["uses", "Bad Type"]), rng.randrange(n), rng.choice([rng.randrange(n), 999])]
            edges.add(k)
    changed -= gone
    after = graph_of(spark, [(k, *v) for k, v in entities.items() if k not in gone], [(k, *v) for k, v in relations.items()])
    ids = lambda ks, make: spark.createDataFrame([(make(k),) for k in ks], "id string")
    delta = Counter((r["id"], r["problem"]) for r in invariants.delta_diagnostics(after, ids(changed, eid), ids(edges, rid), ids(gone, eid)).collect())
    whole = {(r["id"], r["problem"]) for r in invariants.graph_diagnostics(after).collect()}
    cycle = {(i, p) for i, p in whole if p == "containment-cycle"}
    assert set(delta) - cycle == whole - cycle and max(delta.values(), default=1) == 1
    # of a cycle the changed members are named, at least one of each
    assert {x for x in delta if x[1] == "containment-cycle"} == {(i, p) for i, p in cycle if i in {eid(k) for k in changed}} and bool(cycle) == any(p == "containment-cycle" for _, p in delta)


def test_a_long_cycle_and_what_hangs_below_it(spark):
    ring = [(k, "x", (k + 1) % 9, None) for k in range(9)] + [(10, "below", 3, None), (11, "below it", 10, None)]
    graph = graph_of(spark, ring)
    of = lambda *ks: spark.createDataFrame([(eid(k),) for k in ks], "id string")
    found = lambda *ks: sorted(r["id"] for r in invariants.changed_cycles(graph.entities, of(*ks)).collect())
    assert found(4) == [eid(4)] and found(2, 7, 10) == [eid(2), eid(7)] and found() == []


def test_batches_and_loads_that_break_the_graph_are_refused(spark):
    graph = graph_of(spark, [(1, "top", None, "system"), (2, "mid", 1, "domain"), (3, "leaf", 2, "part")], [(1, "uses", 3, 2)])
    none_r, none_a = graph.relations.where("false").withColumn("op", F.lit("update")), spark.createDataFrame([], ALIASES)
    change = lambda n, op, **f: graph.entities.where(F.col("id") == eid(n)).withColumns({k: F.lit(v) for k, v in f.items()}).withColumn("op", F.lit(op))

    def problems(components, aliases=none_a):
        with pytest.raises(GraphQueryError) as e:
            mutate.apply_batch(graph, components, none_r, aliases)
        assert e.value.code == "invariant-violation"
        return {p for _, p in e.value.details["problems"]}

    assert problems(change(1, "update", parent=eid(3))) == {"containment-cycle", "scale-coarser-than-parent"}
    assert problems(change(2, "update", parent=eid(2))) == {"self-containment"}
    assert problems(change(2, "remove")) == {"unknown-parent", "unknown-endpoint"}
    assert problems(change(3, "update", scale="system")) == {"scale-coarser-than-parent"}
    moved = mutate.apply_batch(graph, change(2, "remove"), none_r, spark.createDataFrame([(eid(2), eid(1))], ALIASES))
    assert {r["name"]: r["parent"] for r in moved.entities.collect()} == {"top": None, "leaf": eid(1)} and moved.relations.first()["target"] == eid(1)
    assert problems(change(2, "remove"), spark.createDataFrame([(eid(2), eid(3))], ALIASES)) == {"self-containment"}
    load = lambda e: load_graph(e, graph.relations, graph.aliases)
    assert code(lambda: load(graph.entities.withColumn("parent", F.when(F.col("name") == "top", eid(3)).otherwise(F.col("parent"))))) == "containment-cycle"
    assert code(lambda: load(graph.entities.withColumn("scale", F.when(F.col("name") == "leaf", "system").otherwise(F.col("scale"))))) == "scale-coarser-than-parent"
    assert code(lambda: load(graph.entities.withColumn("parent", F.lit(eid(9))))) == "unknown-parent" and load(graph.entities).generation == 0
