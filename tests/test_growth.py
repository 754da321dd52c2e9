"""What must not grow faster than the input: each case failed by its size before."""

from pyspark.sql import functions as F

from lattica.functions import scalars
from lattica.operators import aliases, derive, hierarchy, invariants, levels, mutate, query, reconcile
from lattica.plans import lists, ordering
from lattica.plans.graph import ALIASES, RELATIONS
from lattica.plans.lineage import _DROP_SHUFFLES, cut
from lattica.queries import changes, evidence
from lattica.sources.star import empty_graph


def test_alias_cycles_are_carried_no_further_than_chains(spark, monkeypatch):
    longest = []
    monkeypatch.setattr(aliases, "cut", lambda df: (lambda out: (longest.append(out.agg(F.max(F.size("chain"))).first()[0] or 0), out)[1])(cut(df)))
    ring = [(f"r{i}", f"r{(i + 1) % 100}") for i in range(100)]
    found = aliases.resolve_aliases(spark.createDataFrame([*ring, ("into", "r5"), ("a", "b"), ("b", "c"), ("c", "end")], ALIASES))
    assert {(r["source"], r["resolved"], tuple(r["chain"]), r["hops"]) for r in found.collect()} == {
        ("a", "end", ("b", "c", "end"), 3), ("b", "end", ("c", "end"), 2), ("c", "end", ("end",), 1)}
    assert max(longest) <= 16  # 128 before: as long as there are aliases


def test_chains_of_every_length_end(spark):
    pairs = [(f"{n}-{i}", f"{n}-{i + 1}") for n in range(1, 36) for i in range(n)] + [("x", "y"), ("y", "x")]
    found = aliases.resolve_aliases(spark.createDataFrame(pairs, ALIASES)).collect()
    assert {(r["source"], r["resolved"], r["hops"]) for r in found} == {(f"{n}-{i}", f"{n}-{n}", n - i) for n in range(1, 36) for i in range(n)}


def test_small_cuts_are_broadcast_and_leave_no_setting(spark):
    before = spark.conf.get(_DROP_SHUFFLES, None)
    small = cut(spark.range(3).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("v")))
    assert spark.conf.get(_DROP_SHUFFLES, None) == before
    large = spark.range(10).select(F.col("id").cast("string").alias("k"))
    plan = large.join(small, "k", "left")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert cut(spark.range(2).select(F.lit(None).alias("nothing"))).count() == 2


def test_an_endpoint_is_looked_up_once(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(invariants, "cut", lambda df: (lambda out: (sizes.append(out.count()), out)[1])(cut(df)))
    rows = [(f"rel_{i}", "t", "gone", f"also{i % 2}", None) for i in range(40)]
    graph = empty_graph(spark).with_frames(relations=spark.createDataFrame(rows, RELATIONS))
    assert invariants.dangling_endpoints(graph).count() == 80
    assert sizes == [3]


def test_duplicates_are_found_by_hash_and_then_by_id(spark):
    one = spark.createDataFrame([("a",), ("b",), (None,)], "id string")
    assert not invariants.has_duplicate_ids(one)
    assert invariants.has_duplicate_ids(one.unionByName(one.where("id = 'b'")))


def test_pages_of_an_export_choose_by_ids_alone(spark, monkeypatch):
    asked, page = [], query.page
    monkeypatch.setattr(query, "page", lambda df, *args: (asked.append(df.columns), page(df, *args))[1])
    none = empty_graph(spark)
    rows = spark.range(5).select(F.concat(F.lit("e"), "id").alias("id"))
    entities = none.entities.unionByName(rows.withColumn("kind", F.lit("component")), allowMissingColumns=True)
    graph = none.with_frames(entities=entities, relations=spark.createDataFrame([("r1", "t", "e1", "e2", None), ("r0", "t", "e1", "e3", None)], RELATIONS))
    pages = list(query.export_pages(graph, spark.createDataFrame([("e1", True)], "component_id string, present boolean"), limit=2))
    assert [[(r["id"], [x["relation"] for x in r["relations"]], r["evidence_bound"]) for r in p.items] for p in pages] == [
        [("e0", [], False), ("e1", ["r0", "r1"], True)], [("e2", [], False), ("e3", [], False)], [("e4", [], False)]]
    assert asked == [["id"]] * 3


def test_relations_of_a_pair_are_one_before_any_join(spark):
    relations = spark.createDataFrame([("r2", "x", "a", "b", None), ("r1", "y", "a", "b", None), ("r3", "x", "a", "c", None)], RELATIONS)
    out = levels.visible_relations(relations, spark.createDataFrame([("a", "p"), ("b", "p"), ("c", "q")], "id string, parent string"))
    assert [tuple(r) for r in out.select("source", "target", "type", "id").collect()] == [("a", "b", "y", "r1")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")  # the aggregate lies below


def test_session_states_of_events_far_apart(spark, tmp_path):
    rows = spark.range(12).select((F.col("id") * 5_000_000 + 1).alias("event_id"), (F.col("id") % 2).alias("user_id"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    found = changes.session_states(spark, str(tmp_path)).collect()
    order = {s: [r["problem"] for r in sorted(found, key=lambda r: r["arrival"]) if r["session"] == s] for s in ("0", "1")}
    assert order["0"] == [None, None, "sequence-not-advancing", None, "session-ended", "session-ended"]
    assert order["1"] == [None, None, "sequence-not-advancing", "expiry-heartbeat-mismatch", None, "session-ended"]


def test_messages_of_sessions_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(evidence, "_scratch", lambda _: str(tmp_path / "s"))
    assert evidence._session_receipts(spark, "/root/testdata/sf0.001").count() > 0
    assert len(list((tmp_path / "s" / "in").glob("part-*"))) > 3


def test_a_small_batch_shuffles_no_relations(spark, monkeypatch):
    """Every table of a batch is written down, so each join with the graph's relations is a broadcast of the batch's side."""
    plans = []
    monkeypatch.setattr(mutate, "cut", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), cut(df))[1])
    graph = empty_graph(spark)
    entities = spark.range(3).select(F.concat(F.lit("ent_"), F.lpad(F.col("id").cast("string"), 32, "0")).alias("id"), F.lit("component").alias("kind"))
    ids = [r[0] for r in entities.orderBy("id").collect()]
    held = spark.createDataFrame([("rel_" + "a" * 32, "supplies", ids[0], ids[1], None)], RELATIONS)
    graph = graph.with_frames(entities=graph.entities.unionByName(entities, allowMissingColumns=True), relations=held)
    new = spark.createDataFrame([("rel_" + "b" * 32, "supplies", ids[2], None)], "id string, type string, target string, description string")
    out = mutate.change_relations(graph, ids[0], new, held.select("id"))
    assert [(r["id"], r["target"]) for r in out.relations.collect()] == [("rel_" + "b" * 32, ids[2])]
    met = [p for p in plans if "Join" in p]
    assert met and not any("SortMergeJoin" in p for p in met)


def _exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_ranks_shuffle_once_and_chunks_are_the_same_either_way(spark):
    rows = spark.range(500).select(F.when(F.col("id") < 300, "big").otherwise(F.concat(F.lit("o"), (F.col("id") % 20).cast("string"))).alias("o"), F.concat(F.lit("i"), (F.col("id") * 7 % 400).cast("string")).alias("i"))
    ranked = ordering.with_rank(rows.distinct(), "o", "i")
    assert "hashpartitioning(__pid" not in ranked._jdf.queryExecution().executedPlan().toString()  # the rows, before
    assert [r["rank"] for r in ranked.orderBy("o", "i").collect()] == list(range(rows.distinct().count()))
    one, other = (lists.chunked(rows, "o", "i", size=30, most=most) for most in (1000, 50))
    assert sorted(one.collect()) == sorted(other.collect())
    assert one.where("owner = 'big'").count() == 10 and one.agg(F.sum("n")).first()[0] == rows.distinct().count()
    assert _exchanges(one.select("owner", "items")) == 1  # a rank over the whole table and two joins before


ODD = ["ent_" + "0f" * 16, "rel_" + "0f" * 16, "ent_" + "0F" * 16, "ent_" + "0f" * 16 + "\n", "ent_", "", "é", None]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]


def test_packed_ids_come_back(spark):
    ids = spark.createDataFrame([(i,) for i in ODD], "id string").select("id", scalars.packed(F.col("id")).alias("p"))
    found = ids.select("id", "p", scalars.unpacked(F.col("p")).alias("back")).collect()
    assert all(r["id"] == r["back"] for r in found) and len({r["p"] and bytes(r["p"]) for r in found}) == len(ODD)
    assert [len(r["p"]) for r in found[:2]] == [17, 17]


def _odd_graph(spark):
    none = empty_graph(spark)
    entities = none.entities.unionByName(spark.createDataFrame([(ODD[0], "x"), ("x", None), ("lone", None), ("y", ODD[0])], "id string, parent string"), allowMissingColumns=True)
    return none.with_frames(entities=entities, relations=spark.createDataFrame([("r1", "t", "x", ODD[0], None), (ODD[1], "t", "x", ODD[0], None), ("r0", "t", ODD[0], "gone", None)], RELATIONS))


def test_dependents_of_renamed_meet_by_one_join_at_any_size(spark):
    graph = _odd_graph(spark)
    found = invariants.rename_dependents(graph.entities.where(F.col("id") == ODD[0]), graph.entities, graph.relations)
    assert sorted(r["id"] for r in found.collect()) == ["x", "y"]
    assert "BroadcastHashJoin" not in _plan(found)


def test_retirement_looks_at_relations_by_one_join_at_any_size(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(hierarchy, "cut", lambda df: (plans.append(_plan(df)), cut(df))[1])
    graph = _odd_graph(spark)
    wanted = graph.entities.select("id")
    assert {r["id"] for r in hierarchy.retire(wanted, graph.entities, graph.relations, graph.relations.where("id = 'r1'").select("id")).collect()} == {"lone", "y"}
    assert {r["id"] for r in hierarchy.retire(wanted, graph.entities, graph.relations, graph.relations.select("id")).collect()} == {ODD[0], "x", "lone", "y"}
    assert "BroadcastHashJoin" not in plans[0]


def test_ends_are_dealt_before_they_are_counted(spark):
    found = derive.incident_counts(_odd_graph(spark).relations)
    assert {r["id"]: r["n"] for r in found.collect()} == {"x": 2, ODD[0]: 3, "gone": 1}
    assert "REPARTITION_BY_COL" in _plan(found) and _plan(found).count("Exchange ") == 1


def test_pairs_are_dealt_before_they_are_grouped(spark):
    assert "REPARTITION_BY_COL" in _plan(changes.drawn_relations(spark, "/root/testdata/sf0.001"))


def test_adjacency_needs_no_join(spark):
    found = _odd_graph(spark).adjacency()
    assert {r["id"]: (r["incoming"], r["outgoing"]) for r in found.collect()} == {ODD[0]: (["r1", ODD[1]], ["r0"]), "x": ([], ["r1", ODD[1]]), "lone": ([], []), "y": ([], [])}
    assert "Join" not in _plan(found)


def test_absence_is_seen_where_prior_and_observed_meet(spark):
    prior = spark.createDataFrame([("s", "a", ODD[1], False, "t", "x", "y"), ("s", "b", "r", False, "t", "x", "y"), ("p", "c", "q", False, "t", "x", "y")], "scope string, key string, relation_id string, removed boolean, p_type string, p_source string, p_target string")
    observed = spark.createDataFrame([("s", "a", "t", "x", "y"), ("p", "d", "t", "x", "y")], "scope string, key string, type string, source string, target string")
    live = prior.select(F.col("relation_id").alias("id"), F.lit("t").alias("type"), F.lit("x").alias("source"), F.lit("y").alias("target"))
    coverage = spark.createDataFrame([("s", ["relationship"], "complete"), ("p", ["relationship"], "partial")], "scope string, kinds array<string>, state string")
    found = reconcile.relationship_actions(prior, observed, coverage, live)
    assert {(r["key"], r["action"]) for r in found.collect()} == {("a", "keep"), ("b", "remove"), ("c", "retain"), ("d", "create")}
    assert {r["key"]: r["relation_id"] for r in found.collect()}["a"] == ODD[1]
    assert len([line for line in _plan(found).splitlines() if "Join" in line]) == 3  # five before


def test_levels_are_written_as_bytes(spark, monkeypatch):
    types = []
    monkeypatch.setattr(hierarchy, "cut", lambda df: (types.append(dict(df.dtypes)["id"]), cut(df))[1])
    own = _odd_graph(spark).entities
    assert {(r["id"], r["ancestor"], r["distance"]) for r in hierarchy.ancestors(own.select("id", "parent")).collect()} == {(ODD[0], "x", 1), ("y", ODD[0], 1), ("y", "x", 2)}
    stages = hierarchy.topological_order(own.select("id"), own.where("parent is not null").select("id", F.col("parent").alias("on")))
    assert {r["id"]: r["stage"] for r in stages.collect()} == {"x": 0, "lone": 0, ODD[0]: 1, "y": 2}
    assert set(types[:1] + types[-1:]) == {"binary"}
