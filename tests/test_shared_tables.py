"""Tables that later generations and projections name instead of writing them again, and lists whose ids travel as bytes."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lattica.operators import invariants, mutate
from lattica.plans import lineage, lists
from lattica.plans.errors import GraphQueryError
from lattica.plans.graph import ALIASES, RELATIONS
from lattica.queries import changes, merge
from lattica.sources import stores
from lattica.sources.star import empty_graph

TABLES = "/root/testdata/sf0.001"


def _graph(spark, names=("x", "y")):
    none = empty_graph(spark)
    rows = spark.createDataFrame([(f"ent_{n:032x}", "component", name) for n, name in enumerate(names)], "id string, kind string, name string")
    relations = spark.createDataFrame([(f"rel_{n:032x}", "uses", f"ent_{n % 2:032x}", f"ent_{n % 3 % 2:032x}", None) for n in range(9)], RELATIONS)
    return none.with_frames(entities=none.entities.unionByName(rows, allowMissingColumns=True), relations=relations, generation=1)


def _tables(spark, root, n):
    return stores._names(spark, f"{root}/generations/{n:012d}-{stores.committed_attempt(spark, root, n)}", True)


def test_a_generation_writes_only_what_changed(spark, tmp_path):
    root = str(tmp_path / "store")
    stores.write_generation(_graph(spark), root, grams=True)
    first = stores.read_generation(spark, root)
    stores.write_generation(first.with_frames(entities=first.entities.withColumn("name", F.upper("name")), generation=2), root)
    second = stores.read_generation(spark, root)
    stores.write_generation(second.with_frames(relations=second.relations.where("source <> target"), generation=3), root)
    stores.write_generation(first.with_frames(generation=4), root, grams=True)
    assert [_tables(spark, root, n) for n in (1, 2, 3, 4)] == [["aliases", "grams", "incoming", "index", "relations"], ["index"], ["incoming", "relations"], []]
    assert stores.settle(spark, root) == {} and second.grams is None and stores.read_generation(spark, root).grams is not None
    read = lambda n: (lambda g: (sorted(r[0] for r in g.entities.select("name").collect()), g.relations.count(), g.incoming.count()))(stores.read_generation(spark, root, n))
    loops = first.relations.where("source = target").count()
    assert [read(n) for n in (1, 2, 3, 4)] == [(["x", "y"], 9, 9), (["X", "Y"], 9, 9), (["X", "Y"], 9 - loops, 9 - loops), (["x", "y"], 9, 9)] and 0 < loops < 9
    # another store has nothing of this one
    stores.write_generation(first, str(tmp_path / "other"))
    assert _tables(spark, str(tmp_path / "other"), 1) == ["aliases", "incoming", "index", "relations"]


def test_a_batch_leaves_frames_alone_that_it_does_not_change(spark):
    graph = _graph(spark)
    renamed = graph.entities.where("name = 'x'").withColumns({"name": F.lit("z"), "op": F.lit("update")})
    none = graph.relations.where("false").withColumn("op", F.lit("update")), spark.createDataFrame([], ALIASES)
    out = mutate.apply_batch(graph, renamed, *none)
    assert out.relations is graph.relations and out.aliases is graph.aliases and out.generation == 2
    assert sorted(r["name"] for r in out.entities.collect()) == ["y", "z"]


@pytest.mark.parametrize("query", [changes.commit_revisions, changes.followed_projection, merge.generation_evidence])
def test_relations_are_written_once(spark, monkeypatch, query):
    written, write = [], stores.Attempt.write
    monkeypatch.setattr(stores.Attempt, "write", lambda self, table, *rest: (written.append(table), write(self, table, *rest))[1])
    assert query(spark, TABLES).count() > 0
    assert [written.count(t) for t in ("relations", "incoming")] == [1, 1] and written.count("adjacency") <= 1


@pytest.mark.parametrize("most", [3, lists.MOST])
def test_lists_travel_as_bytes_and_are_those_of_a_plain_grouping(spark, monkeypatch, most):
    odd = ["ent_" + "0f" * 16, "rel_" + "0f" * 16, "ent_" + "0F" * 16, "x:y", "", "é"]
    ends = [(a, b) for a in odd for b in odd[:4]]
    graph = empty_graph(spark).with_frames(relations=spark.createDataFrame([(odd[n] if n < len(odd) else f"r{n}", "t", a, b, None) for n, (a, b) in enumerate(ends)], RELATIONS))
    counted, cut, seen, chunked = [], lists.cut, [], lists.chunked
    monkeypatch.setattr(lists, "cut", lambda df: (counted.append(df.columns), cut(df))[1])
    monkeypatch.setattr(lists, "chunked", lambda rows, *rest, **how: (seen.append(rows), chunked(rows, *rest, most=most, **how))[1])
    made, want = lists.adjacency_lists(graph, size=2), {}
    for r in graph.relations.collect():
        want.setdefault(f"{r['source']}:outgoing", []).append(r["id"])
        want.setdefault(f"{r['target']}:incoming", []).append(r["id"])
    got = {}
    for r in sorted(made.collect(), key=lambda r: (r["owner"], r["chunk"])):
        got.setdefault(r["owner"], []).extend(r["items"])
        assert (r["first"], r["last"], r["n"]) == (r["items"][0], r["items"][-1], len(r["items"])) and r["n"] <= 2
    assert got == {k: sorted(v) for k, v in want.items()}
    assert counted[0] == ["__b"]  # hashes of all owners before
    types = [f.dataType.simpleString() for f in seen[0].schema]
    assert types == ["binary", "binary"]  # texts before


def test_only_named_owners_have_lists(spark):
    rows = spark.createDataFrame([("a", 2), ("a", 1), ("a", 2), ("b", 3), (None, 4)], "o string, i int")
    owners = spark.createDataFrame([("a",), ("c",)], "owner string")
    for most in (1, 100):
        assert [(r["owner"], r["items"]) for r in lists.chunked(rows, "o", "i", most=most, owners=owners).collect()] == [("a", [1, 2])]


def test_what_checks_write_down_goes_again(spark, monkeypatch):
    made, plans, cut = [], [], invariants.cut
    monkeypatch.setattr(invariants, "cut", lambda df: (lambda out: (made.append(out), plans.append(df.dtypes), out)[2])(cut(df)))
    graph = _graph(spark)
    new = spark.createDataFrame([(f"rel_{n:032x}", "uses", f"ent_{n % 2:032x}", f"ent_{0:032x}", None) for n in range(20, 40)], RELATIONS).withColumn("op", F.lit("create"))
    none = graph.entities.where("false").withColumn("op", F.lit("update"))
    out = mutate.apply_batch(graph, none, new, graph.aliases)
    assert out.relations.count() == 29 and out.entities is graph.entities
    assert len(made) > 5 and not any(Path(df.scratch_path.removeprefix("file:")).exists() for df in made)
    assert [("id", "binary"), ("type", "string"), ("source", "binary"), ("target", "binary")] in plans  # texts before
    bad = new.where(f"id = 'rel_{20:032x}'").withColumns({"id": F.lit(f"rel_{99:032x}"), "target": F.lit("nowhere")})
    with pytest.raises(GraphQueryError, match="invariant-violation"):
        mutate.apply_batch(graph, none, bad, graph.aliases)


def test_tables_that_are_kept_outlive_their_scope(spark):
    with lineage.scratch_dropped(spark) as outer:
        with lineage.scratch_dropped(spark) as inner:
            one, two, three = (lineage.cut(spark.range(n)) for n in (1, 2, 3))
            inner += [one, two]
        outer.append(one)
    assert one.count() == 1 and [Path(df.scratch_path.removeprefix("file:")).exists() for df in (one, two, three)] == [True, False, False]
