"""Revisions compared at commit, a projection that follows commits, resource pages and scopes of paths."""

import threading

from pyspark.sql import functions as F

from lattica.operators import mutate
from lattica.plans.graph import ALIASES, ENTITIES, RELATIONS, GraphFrames
from lattica.plans.lists import adjacency_lists
from lattica.sources import scanner, stores
from lattica.streaming import projection


def eid(n):
    return f"ent_{n:032x}"


def graph_of(spark, names, generation=1, edges=()):
    e = [(eid(n), "component", name, None, None, None, None, None, None, None) for n, name in enumerate(names)]
    r = [(f"rel_{k:032x}", "uses", eid(a), eid(b), None) for k, (a, b) in enumerate(edges)]
    return GraphFrames(spark.createDataFrame(e, ENTITIES), spark.createDataFrame(r, RELATIONS), spark.createDataFrame([], ALIASES), generation)


def test_writers_of_different_components_both_commit(spark, tmp_path):
    root = str(tmp_path / "s")
    stores.write_generation(graph_of(spark, ["a", "b", "c"], edges=[(0, 1), (0, 2)]), root)
    seen = stores.read_generation(spark, root)
    ids = lambda *ns: spark.createDataFrame([(eid(n),) for n in ns], "id string")
    saw = {n: spark.createDataFrame(mutate.component_revisions(seen, ids(n)).collect()) for n in (0, 1)}
    none = seen.relations.where("false").withColumn("op", F.lit("update")), spark.createDataFrame([], ALIASES)
    rename = lambda n, name: seen.entities.where(F.col("id") == eid(n)).withColumn("name", F.lit(name)).withColumn("op", F.lit("update"))
    assert mutate.commit_batch(spark, root, rename(0, "A"), *none, saw[0]) == ("committed", 2, [])
    assert mutate.commit_batch(spark, root, rename(1, "B"), *none, saw[1]) == ("committed", 3, [])  # saw generation 1, changes another component
    assert mutate.commit_batch(spark, root, rename(0, "again"), *none, saw[0]) == ("conflict", 3, [eid(0)])
    new = rename(1, "new").withColumns({"id": F.lit(eid(9)), "op": F.lit("create")})
    fresh = spark.createDataFrame([(eid(9), None)], "resource string, revision string")
    assert mutate.commit_batch(spark, root, new, *none, fresh) == ("committed", 4, []) and mutate.commit_batch(spark, root, new, *none, fresh)[0] == "conflict"
    assert {r["name"] for r in stores.read_generation(spark, root).entities.collect()} == {"A", "B", "c", "new"}
    # a component's outgoing relations are part of its revision, those that point at it are not
    one = graph_of(spark, ["a", "b", "c"], edges=[(0, 1)])
    both = graph_of(spark, ["a", "b", "c"], edges=[(0, 1), (0, 2)])
    revision = lambda g, n: mutate.component_revisions(g, ids(n)).first()["revision"]
    assert revision(one, 0) != revision(both, 0) and revision(one, 2) == revision(both, 2) and mutate.component_revisions(one, ids(7)).count() == 0


def test_two_writers_at_once(spark, tmp_path):
    root, out = str(tmp_path / "s"), {}
    stores.write_generation(graph_of(spark, ["a", "b"]), root)
    seen = stores.read_generation(spark, root)
    none = seen.relations.where("false").withColumn("op", F.lit("update")), spark.createDataFrame([], ALIASES)

    def write(n):
        own = seen.entities.where(F.col("id") == eid(n))
        saw = spark.createDataFrame(mutate.component_revisions(seen, own.select("id")).collect())
        out[n] = mutate.commit_batch(spark, root, own.withColumn("name", F.lit(f"new{n}")).withColumn("op", F.lit("update")), *none, saw)[0]

    threads = [threading.Thread(target=write, args=(n,)) for n in (0, 1)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert out == {0: "committed", 1: "committed"} and {r["name"] for r in stores.read_generation(spark, root).entities.collect()} == {"new0", "new1"}


def test_a_projection_follows_commits_and_equals_a_rebuild(spark, tmp_path):
    root, shown, check = (str(tmp_path / n) for n in ("s", "p", "c"))
    stores.write_generation(graph_of(spark, ["a"]), root)
    projection.run_projection(spark, root, shown, check)
    assert projection.read_projection(spark, shown).generation == 1
    for n in (2, 3, 4):  # three events wait
        stores.write_generation(graph_of(spark, ["a", f"b{n}"], n, [(0, 1)]), root)
    projection.run_projection(spark, root, shown, check)
    assert stores.generations(spark, shown) == [1, 4]  # one rebuild for all of them
    now, graph = projection.read_projection(spark, shown), stores.read_generation(spark, root)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert (now.generation, now.fingerprint) == (4, graph.fingerprint()) and rows(now.catalog) == rows(graph.catalog()) and rows(now.adjacency) == rows(adjacency_lists(graph))
    projection.run_projection(spark, root, shown, check)
    projection.projection_sink(root, shown)(spark.createDataFrame([(2,)], "generation long"), 7)  # told twice, and late
    assert stores.generations(spark, shown) == [1, 4] and projection.rebuild(spark, root, shown, 2) == 4
    projection.rebuild(spark, root, str(tmp_path / "new"))
    assert rows(projection.read_projection(spark, str(tmp_path / "new")).catalog) == rows(now.catalog)


def test_resource_pages_enter_what_lies_behind_the_cursor(spark, tmp_path, monkeypatch):
    names = ["a/1.md", "a/2.md", "a.md", "a-b/x/3.md", "b/4.txt", "b/c/d/5.md", "c/6.md", "z.md", "_hidden/7.md", ".8.md"]
    for n in names:
        (tmp_path / "r" / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / n).write_text("x" * len(n))
    root, base = str(tmp_path / "r"), f"file:{tmp_path}/r/"
    want = sorted(base + n for n in names if n.endswith(".md") and n[0] not in "._")
    got, after = [], None
    while True:
        page = [r["path"] for r in stores.resource_page(spark, root, 2, after, "*.md").collect()]
        got += page
        if not page:
            break
        after = page[-1]
    assert got == want and dict(stores.walk_resources(spark, root))[base + "b/4.txt"] == 7
    assert [p for p, _ in stores.walk_resources(spark, root, depth=0)] == [base + "a.md", base + "z.md"]
    # a walk behind b/c lists b, b/c and what follows, nothing of a
    entered, real = [], stores._file_system

    class Counting:
        def __init__(self, fs):
            self.fs = fs

        def listStatus(self, folder):
            entered.append(folder.getName())
            return self.fs.listStatus(folder)

        def __getattr__(self, name):
            return getattr(self.fs, name)

    monkeypatch.setattr(stores, "_file_system", lambda *a: (Counting(real(*a)[0]), real(*a)[1]))
    assert [p for p, _ in stores.walk_resources(spark, root, base + "b/c/d/4", "*.md")] == [base + n for n in ("b/c/d/5.md", "c/6.md", "z.md")]
    assert entered == ["r", "b", "c", "d", "c"]


def test_scopes_are_found_by_the_prefixes_of_a_path(spark):
    files = spark.createDataFrame([(p, p.encode()) for p in ("a", "a/b", "a/bc/d", "ab/c", "", "x/y/z")], "path string, content binary")
    scopes = spark.createDataFrame([("top", "a"), ("deep", "a/bc/"), ("same", "a/b"), ("twice", "x"), ("twice", "x/y")], "scope string, resource_root string")
    own = scanner.Scanner("s", "i", "1", lambda path, content: [(path, "documentation", None)])
    found = {(r["scope"], r["key"]) for r in scanner.scan_resources(own, files, scopes).collect()}
    assert found == {("top", "a"), ("top", "a/b"), ("top", "a/bc/d"), ("deep", "a/bc/d"), ("same", "a/b"), ("twice", "x/y/z")}
    assert "NestedLoop" not in scanner.scan_resources(own, files, scopes)._jdf.queryExecution().toString()
