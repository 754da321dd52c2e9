"""Open payloads: presence against null, typed criteria, patches, canonical text and strings inside extensions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lattica.operators import invariants, mutate, query, reconcile
from lattica.plans import payloads
from lattica.plans.errors import GraphQueryError
from lattica.plans.graph import ALIASES, ENTITIES, RELATIONS, GraphFrames
from lattica.queries import payload
from lattica.sources import star, stores


def graph_of(spark, extensions):
    """A graph of one component for each JSON text or None."""
    ids = [f"ent_{n:032x}" for n in range(len(extensions))]
    rows = [(i, "component", f"N{n}", None, None, None, "thing", None, None, None) for n, i in enumerate(ids)]
    ext = spark.createDataFrame(list(zip(ids, extensions)), "id string, j string").select("id", F.parse_json("j").alias("extensions"))
    entities = payloads.with_open_fields(spark.createDataFrame(rows, ENTITIES).join(ext, "id"))
    return GraphFrames(entities, spark.createDataFrame([], RELATIONS), spark.createDataFrame([], ALIASES), 1), ids


TEXTS = ['{"a:x":null}', '{"a:x":"1"}', '{"a:x":1}', '{"a:x":1.0}', '{"a:x":true}', '{"a:x":"true"}', "{}", None, '{"b/y":null}', '{"a:x":{"a:x":null}}', '{"a:x":[]}', '{"a:x":1e300}']


@pytest.mark.parametrize(("value", "want"), [(None, {0}), ("1", {1}), (1, {2, 3}), (1.0, {2, 3}), (True, {4}), ("true", {5}), (False, set()), (1e300, {11}), ("", set())])
def test_criteria_compare_type_and_presence(spark, value, want):
    graph, ids = graph_of(spark, TEXTS)
    assert {ids.index(r["id"]) for r in query.entities_where(graph, "component", {"a:x": value}).select("id").collect()} == want


def test_criteria_on_a_graph_without_extensions(spark):
    graph, _ = graph_of(spark, TEXTS[:1])
    bare = graph.with_frames(entities=graph.entities.drop("extensions", "icon_domain", "lifecycle"))
    assert query.entities_where(bare, None, {"a:x": None}).count() == 0 and query.entities_where(bare).columns == bare.entities.columns


def test_patches_store_null_in_extensions_and_clear_fields(spark):
    graph, ids = graph_of(spark, ['{"a:x":1,"b:y":null}', None])
    out = graph
    for patch in ({"a:x": None, "c:z": {"k": [1, None, "t"]}, "type": None}, {"c:z": "over", "name": "new"}):
        out = mutate.update_component(out, ids[0], patch)
    first, second = (r for r in out.entities.orderBy("id").select("name", "type", F.to_json("extensions").alias("e")).collect())
    assert (first["name"], first["type"], json.loads(first["e"])) == ("new", None, {"a:x": None, "b:y": None, "c:z": "over"})
    assert (second["name"], second["type"], second["e"]) == ("N1", "thing", None)
    for wrong in ({"parent": None}, {"plain": 1}, {"A:x": 1}, {"a:": 1}, {"a:x y": 1}):
        with pytest.raises(GraphQueryError, match="invalid-patch"):
            mutate.update_component(graph, ids[0], wrong)
    with pytest.raises(GraphQueryError, match="invalid-payload-number"):
        mutate.update_component(graph, ids[0], {"a:x": float("nan")})
    bare = graph.with_frames(entities=graph.entities.drop("extensions", "icon_domain", "lifecycle"))
    assert mutate.update_component(bare, ids[1], {"a:x": -0.0}).entities.where("id = '%s'" % ids[1]).select(F.to_json("extensions")).first()[0] == '{"a:x":0}'


def test_created_components_have_extensions(spark):
    graph, _ = graph_of(spark, [None])
    bare = graph.with_frames(entities=graph.entities.drop("extensions", "icon_domain", "lifecycle"))
    for base in (graph, bare):
        new = mutate.create_component(base, {"id": "ent_" + "f" * 32, "name": "x", "icon_domain": "a.example", "n:s": None, "n/t": [1]}).entities.where("name = 'x'")
        assert new.select("icon_domain", F.to_json("extensions")).first() == ("a.example", '{"n/t":[1],"n:s":null}')
    with pytest.raises(GraphQueryError, match="unknown-field"):
        mutate.create_component(graph, {"id": "ent_" + "f" * 32, "color": "red"})


def test_canonical_text_and_strings(spark):
    rng = random.Random(9)

    def value(depth):
        kind = rng.randrange(7 if depth else 5)
        if kind < 5:
            return rng.choice(["plain", 'q"uote', "back\\slash", "", "key\":", "ünï 😀", "line\nfeed", ":", "{", 3, -2.5, True, None])
        return [value(depth - 1) for _ in range(3)] if kind == 5 else {rng.choice(["z", "a", 'k"', "b\\", "é"]): value(depth - 1) for _ in range(3)}

    def strings(v):
        if isinstance(v, str):
            return [v] if v else []
        if isinstance(v, dict):
            return [s for k in sorted(v) for s in strings(v[k])]
        return [s for x in v for s in strings(x)] if isinstance(v, list) else []

    values = [value(3) for _ in range(200)]
    df = spark.createDataFrame([(n, json.dumps(v)) for n, v in enumerate(values)], "n int, j string").withColumn("v", F.parse_json("j"))
    for n, text, found in df.select("n", payloads.canonical_text(F.col("v")), payloads.strings_in(F.col("v"))).collect():
        assert json.loads(text) == values[n] and [s for s in found.split("\n") if s] == [s for x in strings(values[n]) for s in x.split("\n") if s]
        assert text == json.dumps(values[n], sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def test_payloads_are_stored_searched_and_compared(spark, tmp_path):
    graph, ids = graph_of(spark, ['{"a:owner":"Ann Lee","z:deep":{"b":["Second"],"a":"First"}}', '{"a:owner":null}', None])
    stores.write_generation(graph, str(tmp_path / "s"))
    back = stores.read_generation(spark, str(tmp_path / "s"))
    assert back.fingerprint() == graph.fingerprint()
    text = {r["id"]: r["searchable"] for r in back.catalog().collect()}
    assert text[ids[0]] == f"{ids[0]}\ncomponent\nann lee\nn0\nthing\nfirst\nsecond" and text[ids[1]] == f"{ids[1]}\ncomponent\nn1\nthing"
    assert [r["id"] for r in query.search_entities(back, "lee SECOND").collect()] == [ids[0]]
    plan = query.entities_where(back, None, {"a:owner": "Ann Lee"}).select("id")._jdf.queryExecution().toString()
    assert "z:deep" not in plan.split("ReadSchema")[-1] and "extensions:struct<0:" in plan.replace(" ", "")
    other = mutate.update_component(graph, ids[1], {"a:owner": "Bob"})
    assert reconcile.same_content(graph.entities, graph.entities).count() == 0 and reconcile.same_content(graph.entities, other.entities).count() == 2


def test_extension_keys_need_a_namespace(spark):
    graph, ids = graph_of(spark, ['{"plain":1}', '{"a:x":{"plain":1}}', "{}", None, '{"a:x":1,"B:y":1}'])
    assert {(ids.index(r["id"]), r["problem"]) for r in invariants.field_problems(graph.entities).collect()} == {(0, "invalid-extension-key"), (4, "invalid-extension-key")}


def test_a_stored_star_finds_its_pairs_once(spark, monkeypatch):
    """The lines' pairs of keys were found again for entities, relations and incoming relations."""
    plain, found = star._pairs, []
    monkeypatch.setattr(star, "_pairs", lambda spark, sf_dir, *keys: found.append(keys) or plain(spark, sf_dir, *keys))
    assert payload.extension_typed_criteria(spark, "/root/testdata/sf0.001").count() > 0
    assert sorted(found) == sorted(star.PAIRS.values())
