"""Registered queries on open payloads: extensions, present nulls, patches and fields that evidence owns."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import invariants, mutate, query, reconcile
from ..plans.graph import GraphFrames
from ..plans.lineage import ensure_checkpoint_dir
from ..plans.payloads import canonical_text, with_open_fields
from ..sources import stores
from ..sources.star import entity_id, star_graph, table
from .graph import _key, registered


def open_star(spark: SparkSession, sf_dir: str, held: bool = False) -> GraphFrames:
    """The star graph, its customers with a life cycle and extensions.

    Every customer has trade:segment and trade:terms; trade:manager is null for those divisible by three, absent for those
    behind them, a name for the rest. held: as in star_graph().
    """
    graph = star_graph(spark, sf_dir, held=held)
    k = F.col("c_custkey")
    manager = F.when(k % 3 == 0, '"trade:manager":null,').when(k % 3 == 1, "").otherwise(F.concat(F.lit('"trade:manager":"Manager '), k.cast("string"), F.lit('",')))
    text = F.concat(
        F.lit("{"), manager, F.lit('"trade:segment":"'), "c_mktsegment", F.lit('","trade:terms":{"notes":["Net \\\\ due","'), F.lower("c_mktsegment"),
        F.lit(' \\"round\\""],"days":'), (k % 30).cast("string"), F.lit("}}"),
    )
    own = table(spark, sf_dir, "customer").select(entity_id("customer", k).alias("id"), F.parse_json(text).alias("extensions"), F.lit("in-use").alias("lifecycle"))
    entities = with_open_fields(graph.entities.join(own, "id", "left"))
    return graph.with_frames(entities=entities)


#: What open_star() puts on customers, as canonical text.
_OPEN = """ , own AS (SELECT c_custkey AS k, 'ent_' || md5('customer:' || c_custkey) AS id, c_mktsegment AS m,
    CASE WHEN c_custkey % 3 = 0 THEN '"trade:manager":null,' WHEN c_custkey % 3 = 1 THEN '' ELSE '"trade:manager":"Manager ' || c_custkey || '",' END AS manager,
    '"trade:segment":"' || c_mktsegment || '","trade:terms":{"days":' || c_custkey % 30 || ',"notes":["Net \\\\ due","' || lower(c_mktsegment) || ' \\"round\\""]}' AS rest FROM customer)"""


@registered("extension_null_criterion", _OPEN + " SELECT id, '{' || manager || rest || '}' AS extensions FROM own WHERE k % 3 = 0")
def extension_null_criterion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities whose manager is there and null; of most the extension is absent."""
    found = query.entities_where(open_star(spark, sf_dir), "component", {"trade:manager": None})
    return found.select("id", canonical_text(F.col("extensions")).alias("extensions"))


@registered("extension_typed_criteria", _OPEN + " SELECT id, k % 30 AS days FROM own WHERE m = 'BUILDING' AND k % 3 = 2")
def extension_typed_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Criteria on a fixed field and an extension together, over a stored generation whose scan reads single keys; null matches no text."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}"
    stores.write_generation(open_star(spark, sf_dir, held=True), root)
    found = query.entities_where(stores.read_generation(spark, root), "component", {"trade:segment": "BUILDING", "type": "customer"})
    named = found.where(F.startswith(F.try_variant_get("extensions", '$["trade:manager"]', "string"), F.lit("Manager")))
    return named.select("id", F.try_variant_get("extensions", '$["trade:terms"].days', "long").alias("days"))


@registered("extension_patch", _OPEN + """ SELECT ent.id, CASE WHEN k = 4 THEN NULL ELSE ent.type END AS type, CASE WHEN k = 4 THEN 'ended' WHEN k IS NOT NULL THEN 'in-use' END AS lifecycle,
    CASE WHEN k = 4 THEN '{"trade:level":2.5,"trade:manager":null,' || rest || '}' WHEN k IS NOT NULL THEN '{' || manager || rest || '}' END AS extensions FROM ent LEFT JOIN own ON own.id = ent.id""")
def extension_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patch clears a fixed field by null, and stores null in an extension."""
    patch = {"trade:manager": None, "trade:level": 2.5, "type": None, "lifecycle": "ended"}
    out = mutate.update_component(open_star(spark, sf_dir), _key(spark, "customer", 4), patch)
    return out.entities.select("id", "type", "lifecycle", canonical_text(F.col("extensions")).alias("extensions"))


@registered("extension_search", _OPEN + r""" SELECT ent.id, lower(concat_ws(chr(10), ent.id, kind, 'in-use', name, parent, scale, CASE WHEN k % 3 = 2 THEN 'Manager ' || k END,
    m, 'Net \ due', lower(m) || ' "round"', type)) AS searchable FROM ent JOIN own ON own.id = ent.id WHERE k % 3 = 2 AND contains('manager ' || k, '1') AND m = 'MACHINERY'
    UNION ALL SELECT ent.id, lower(concat_ws(chr(10), ent.id, kind, 'in-use', name, parent, scale, CASE WHEN k % 3 = 2 THEN 'Manager ' || k END, m, 'Net \ due', lower(m) || ' "round"', type))
    FROM ent JOIN own ON own.id = ent.id WHERE m = 'MACHINERY' AND NOT (k % 3 = 2 AND contains('manager ' || k, '1')) AND (contains(ent.id || chr(10) || name || chr(10) || parent, '1'))""")
def extension_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings deep inside extensions are found, in the order of all keys of the payload; keys and numbers are not."""
    graph = open_star(spark, sf_dir)
    found = query.search_entities(graph, 'machinery "ROUND" 1 \\')
    return found.join(graph.catalog().select("id", "searchable"), "id").select("id", "searchable")


@registered("extension_problems", """ SELECT 'ent_' || md5('customer:' || c_custkey) AS id, p AS problem FROM customer,
    (VALUES ('invalid-extension-key', 0), ('invalid-lifecycle', 1), ('invalid-icon-domain', 2)) t(p, r) WHERE c_custkey % 5 = r""")
def extension_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key without a namespace, a life cycle in capitals, a domain that is a number; all other entities are fine."""
    graph = open_star(spark, sf_dir)
    c = table(spark, sf_dir, "customer").select(entity_id("customer", F.col("c_custkey")).alias("id"), (F.col("c_custkey") % 5).alias("__r"))
    bad = graph.entities.join(c, "id", "left").withColumns({
        "extensions": F.when(F.col("__r") == 0, F.parse_json(F.lit('{"plain":1,"trade:fine":2}'))).otherwise(F.col("extensions")),
        "lifecycle": F.when(F.col("__r") == 1, "In Use").otherwise(F.col("lifecycle")), "icon_domain": F.when(F.col("__r") == 2, "10.0.0.1"),
    })
    return invariants.field_problems(bad.drop("__r"))


@registered("applied_owned_fields", """, f AS (SELECT 'ent_' || md5('customer:' || c_custkey) AS id, c_custkey % 5 AS hand, c_name AS n, c_mktsegment AS m FROM customer)
    SELECT ent.id, CASE WHEN hand = 0 THEN 'mine' WHEN hand IS NOT NULL THEN lower(n) || '.example.org' END AS icon_domain, CASE WHEN hand = 1 THEN 'mine' WHEN hand IS NOT NULL THEN n || ' new' END AS label,
      CASE WHEN hand = 2 THEN 'mine' WHEN hand IS NOT NULL THEN upper(n) ELSE name END AS name, CASE WHEN hand = 3 THEN 'mine' WHEN hand IS NOT NULL THEN 'It is ' || m END AS summary,
      CASE WHEN hand IS NOT NULL THEN m ELSE type END AS type FROM ent LEFT JOIN f ON f.id = ent.id""")
def applied_owned_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five fields that evidence may own, put into the whole graph; of most customers one was edited by hand since."""
    graph, k = star_graph(spark, sf_dir), F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    own, scope, n = entity_id("customer", k), F.lit("s").alias("scope"), F.col("c_name")
    proposed = {"icon_domain": F.concat(F.lower(n), F.lit(".example.org")), "label": F.concat(n, F.lit(" new")), "name": F.upper(n), "summary": F.concat(F.lit("It is "), "c_mktsegment"), "type": F.col("c_mktsegment")}
    before = {"name": n, "type": F.lit("customer")}
    prior = c.select(scope, k.alias("key"), own.alias("component_id"), F.lit(True).alias("present"), *[before.get(f, F.lit(None).cast("string")).alias(f"p_{f}") for f in reconcile.OWNED])
    edited = c.select(own.alias("id"), (k % 5).alias("__hand"))
    entities = with_open_fields(graph.entities).join(edited, "id", "left")
    for at, f in enumerate(("icon_domain", "label", "name", "summary")):
        entities = entities.withColumn(f, F.when(F.col("__hand") == at, "mine").otherwise(F.col(f)))
    graph = graph.with_frames(entities=entities.drop("__hand"))
    coverage = spark.createDataFrame([("s", ["component-candidate"], "complete")], "scope string, kinds array<string>, state string")
    actions = reconcile.component_actions(prior, c.select(scope, k.alias("key"), *[e.alias(f) for f, e in proposed.items()]), coverage, graph.entities, reconcile.OWNED)
    return reconcile.apply_actions(graph, actions, fields=reconcile.OWNED).entities.select("id", *reconcile.OWNED)
