"""Registered queries on reads by page, stores, aliases, sessions, mutations and checks, each with the SQL that says the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aliases, derive, hierarchy, invariants, levels, mutate, observe, query, reconcile, traverse
from ..plans import lists, paging
from ..plans.errors import GraphQueryError
from ..plans.graph import ALIASES, RELATIONS, GraphFrames, load_graph
from ..plans.lineage import ensure_checkpoint_dir
from ..sources import scanner, stores
from ..sources.star import empty_graph, entity_id, star_graph, table
from ..streaming import sessions
from .evidence import _RECONCILED, _prior_current
from .graph import ORACLE_SQL, _key, _walk_sql, registered


def _scratch(spark: SparkSession, what: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def _stored(spark: SparkSession, sf_dir: str, graph: GraphFrames | None = None) -> GraphFrames:
    """The star graph, checked, written as a generation and read again."""
    root = _scratch(spark, "store")
    graph = graph or star_graph(spark, sf_dir, held=True)
    stores.write_generation(load_graph(graph.entities, graph.relations, graph.aliases, "component", 1), root)
    return stores.read_generation(spark, root)


def _rows(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows], schema)


# reads -------------------------------------------------------------------------------------------------


@registered("stored_snapshot", " SELECT id, kind, name, type, scale, shared, parent, 1::BIGINT AS generation FROM ent")
def stored_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = _stored(spark, sf_dir)
    return graph.entities.select("id", "kind", "name", "type", "scale", "shared", "parent", F.lit(graph.generation).cast("long").alias("generation"))


@registered("stored_traversal", _walk_sql("customer", 3, 2, "'incoming', 'outgoing'"))
def stored_traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.traverse(_stored(spark, sf_dir), _key(spark, "customer", 3), 2, "both")


@registered("stored_search", " SELECT id, name FROM searchable WHERE contains(text, '0009') AND contains(text, 'supplier')")
def stored_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.search_entities(_stored(spark, sf_dir), "supplier 0009").select("id", "name")


@registered("identity", f"SELECT 1::BIGINT AS generation, 'sha256:' || sha256('[' || string_agg('(''' || part || ''', ' || n || ', ''' || digest || ''')', ', ' ORDER BY part) || ']') AS fingerprint FROM ({ORACLE_SQL['fingerprint']})", graph=False)
def identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_graph(spark, sf_dir).identity()


@registered("exact_entities", " SELECT n_nationkey::INT AS position, ent.id, ent.name FROM nation JOIN ent ON ent.id = 'ent_' || md5('nation:' || n_nationkey) WHERE n_nationkey < 10")
def exact_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = [r[0] for r in spark.range(10).select(entity_id("nation", F.col("id"))).collect()]
    return query.exact_entities(star_graph(spark, sf_dir), ids).select("position", "id", "name")


@registered("catalog_entry", " SELECT id, kind, text AS searchable FROM searchable WHERE id = 'ent_' || md5('supplier:4')")
def catalog_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.catalog_entry(star_graph(spark, sf_dir), _key(spark, "supplier", 4))


@registered("relation_second_page", " SELECT id, type, source, target FROM rel ORDER BY id LIMIT 40 OFFSET 40")
def relation_second_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pages by cursor: the second goes on behind the anchor that the first one's cursor holds."""
    graph = star_graph(spark, sf_dir)
    own = graph.relations.select("id", "type", "source", "target")
    first = paging.page(own, "id", 40, {"op": "relations"}, graph)
    return _rows(spark, paging.page(own, "id", 40, {"op": "relations"}, graph, first.next_cursor).items, "id string, type string, source string, target string")


@registered("traversal_second_page", _walk_sql("supplier", 2, 2, "'incoming', 'outgoing'") + " ORDER BY depth, relation LIMIT 30 OFFSET 30")
def traversal_second_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = star_graph(spark, sf_dir)
    hits = traverse.traverse(graph, _key(spark, "supplier", 2), 2, "both")
    first = paging.traversal_page(hits, 30, {"op": "traverse"}, graph)
    second = paging.traversal_page(hits, 30, {"op": "traverse"}, graph, first.next_cursor)
    return _rows(spark, second.items, "depth int, relation string, type string, direction string, from string, entity string")


@registered("page_refusals", "SELECT * FROM (VALUES ('foreign anchor', 'cursor-anchor-mismatch'), ('other generation', 'stale-cursor'), ('other query', 'cursor-query-mismatch'), ('no cursor', 'malformed-cursor'), ('limit 0', 'invalid-page-limit'), ('unknown after', 'unknown-page-anchor'), ('scan bound', 'entity-scan-bound-exceeded')) t(request, code)", graph=False)
def page_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each bad page request is refused with; the anchor is a row, but none of the filtered result."""
    graph = star_graph(spark, sf_dir)
    parts = query.list_components(graph, scale="part")
    asked = {"op": "parts"}
    text = paging.canonical({"query": asked, "fingerprint": ""})
    outside = _key(spark, "nation", 1)
    calls = {
        "foreign anchor": lambda: paging.page(parts, "id", 5, asked, graph, paging.encode_cursor(outside, 1, text)),
        "other generation": lambda: paging.page(parts, "id", 5, asked, graph, paging.encode_cursor(outside, 2, text)),
        "other query": lambda: paging.page(parts, "id", 5, asked, graph, paging.encode_cursor(outside, 1, "other")),
        "no cursor": lambda: paging.page(parts, "id", 5, asked, graph, "cursor"),
        "limit 0": lambda: paging.page(parts, "id", 0, asked, graph),
        "unknown after": lambda: paging.after_page(parts, "id", 5, outside),
        "scan bound": lambda: paging.bounded_scan(parts, 10),
    }
    return spark.createDataFrame([(name, _code(call)) for name, call in calls.items()], "request string, code string")


def _code(call) -> str:
    try:
        call()
    except GraphQueryError as e:
        return e.code
    return "none"


@registered("resolve_relation", " SELECT id, type, source, target FROM rel WHERE id = (SELECT min(id) FROM rel WHERE type = 'placed')")
def resolve_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = star_graph(spark, sf_dir)
    own = graph.relations.where("type = 'placed'").agg(F.min("id")).first()[0]
    return query.exact_relation(graph, own).select("id", "type", "source", "target")


@registered("children_null_safe", " SELECT id, parent FROM ent WHERE parent IS NULL OR parent = 'ent_' || md5('region:2')")
def children_null_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = star_graph(spark, sf_dir)
    return query.children_of(graph, None).unionByName(query.children_of(graph, _key(spark, "region", 2))).select("id", "parent")


@registered("component_detail", """ SELECT 'ent_' || md5('supplier:5') AS component, (SELECT s_acctbal > 0 FROM supplier WHERE s_suppkey = 5) AS evidence_bound, id, type, target
    FROM rel WHERE source = 'ent_' || md5('supplier:5') ORDER BY id LIMIT 25""")
def component_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound = table(spark, sf_dir, "supplier").select(entity_id("supplier", F.col("s_suppkey")).alias("component_id"), (F.col("s_acctbal") > 0).alias("present"))
    view, page = query.component_detail(star_graph(spark, sf_dir), _key(spark, "supplier", 5), bound, limit=25)
    own = view.select(F.col("id").alias("component"), "evidence_bound")
    return own.crossJoin(_rows(spark, page.items, RELATIONS).select("id", "type", "target"))  # one component


@registered("static_detail", " SELECT id, type, source, target FROM rel WHERE source = 'ent_' || md5('order:7') OR target = 'ent_' || md5('order:7')")
def static_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.static_detail(star_graph(spark, sf_dir), _key(spark, "order", 7)).select("id", "type", "source", "target")


@registered("export_all_pages", """ SELECT ent.id, ent.name, count(rel.id) AS n FROM ent LEFT JOIN rel ON rel.source = ent.id GROUP BY 1, 2""")
def export_all_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the whole export on its page of 100, all pages by one ordered scan, so that none goes through the driver."""
    rows = query.export_blueprint(star_graph(spark, sf_dir, held=True)).select("id", "name", F.size("relations").cast("long").alias("n"))
    return lists.all_pages(rows, "id", 100).select("id", "name", "n")


@registered("search_beyond_ascii", "SELECT 'ent_' || md5('customer:' || c_custkey) AS id FROM customer WHERE contains(c_name, '0042') UNION ALL SELECT 'ent_' || md5('supplier:' || s_suppkey) FROM supplier WHERE contains(s_name, '0042')", graph=False)
def search_beyond_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of customers in full-width letters and digits, suppliers' as they are; both spellings find both."""
    graph = star_graph(spark, sf_dir)
    wide = "".join(chr(ord(c) + 0xFEE0) for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ#0123456789")
    plain = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ#0123456789"
    name = F.when(F.col("type") == "customer", F.translate("name", plain, wide)).otherwise(F.col("name"))
    graph = graph.with_frames(entities=graph.entities.where("type in ('customer', 'supplier')").withColumn("name", name))
    found = query.search_entities(graph, "#００00004２ 0042 ER#").select("id")
    return found.join(query.search_entities(graph, "er#0000 ００４２").select("id"), "id", "left_semi")


ORACLE_SQL["search_beyond_ascii"] = """SELECT 'ent_' || md5('customer:' || c_custkey) AS id FROM customer WHERE contains(lower(c_name), '#00000042') AND contains(lower(c_name), '0042')
UNION ALL SELECT 'ent_' || md5('supplier:' || s_suppkey) FROM supplier WHERE contains(lower(s_name), '#00000042') AND contains(lower(s_name), '0042')"""


@registered("export_observations", """, m AS (SELECT l_suppkey AS s, l_returnflag AS f, min(l_linenumber) AS v FROM lineitem GROUP BY 1, 2 HAVING min(l_linenumber) = max(l_linenumber)),
    p AS (SELECT DISTINCT l_suppkey AS s, 'lines/' || l_partkey AS r FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY r) AS k FROM p)
    SELECT s_suppkey AS key, coalesce((SELECT count(*) FROM m WHERE m.s = s_suppkey), 0) AS measured, md5(coalesce((SELECT string_agg(r, ',' ORDER BY r) FROM k WHERE k.s = s_suppkey AND k <= 32), '')) AS paths,
      greatest(0, coalesce((SELECT count(*) FROM p WHERE p.s = s_suppkey), 0) - 32) AS paths_left FROM supplier""")
def export_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with what was measured on them by one value only, and the first of the paths they were seen in."""
    lines = table(spark, sf_dir, "lineitem")
    measured = lines.select(
        F.col("l_suppkey").alias("component"), F.lit("star").alias("project"), F.col("l_returnflag").alias("scanner"), F.lit("one").alias("instance"), F.lit("1").alias("version"), F.col("l_linenumber").alias("value")
    )
    paths = lines.select(F.col("l_suppkey").alias("component"), F.lit("star").alias("project"), F.lit("s").alias("scanner"), F.concat(F.lit("lines/"), F.col("l_partkey").cast("string")).alias("resource"))
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    out = query.with_observations(own, derive.single_measurements(measured), paths)
    return out.select(F.col("id").alias("key"), F.size("measurements").cast("long").alias("measured"), F.md5(F.array_join(F.transform("paths", lambda p: p["resource"]), ",")).alias("paths"), "paths_left")


@registered("page_totals", " SELECT count(*) AS items, ceil(count(*) / 100.0)::BIGINT AS pages FROM ent WHERE type IN ('region', 'nation') OR type = 'customer' AND ends_with(name, '3')")
def page_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages of a listing over a stored snapshot, by cursors: how many there are and how many different ids they hold."""
    graph = star_graph(spark, sf_dir)
    graph = _stored(spark, sf_dir, graph.with_frames(entities=graph.entities.where("type in ('region', 'nation') or type = 'customer' and endswith(name, '3')"), relations=graph.relations.where("false")))
    seen, pages, cursor = set(), 0, None
    while pages == 0 or cursor is not None:
        own = paging.page(query.list_components(graph).select("id"), "id", 100, {"op": "components"}, graph, cursor)
        seen |= {r["id"] for r in own.items}
        pages, cursor = pages + 1, own.next_cursor
    return spark.createDataFrame([(len(seen), pages)], "items long, pages long")


# aliases and containment -------------------------------------------------------------------------------


@registered("alias_chains", """SELECT 'ent_' || md5('customer:' || c_custkey) AS source, 'ent_' || md5('customer:' || (c_custkey - c_custkey % 50)) AS resolved, (c_custkey % 50)::INT AS hops
    FROM customer WHERE c_custkey % 50 > 0""", graph=False)
def alias_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of up to 49 aliases: each customer's to the one before, down to a multiple of fifty."""
    k = F.col("c_custkey")
    own = table(spark, sf_dir, "customer").where(k % 50 > 0).select(entity_id("customer", k).alias("source"), entity_id("customer", k - 1).alias("target"))
    return aliases.resolve_aliases(own).select("source", "resolved", "hops")


@registered("alias_problems", """WITH c AS (SELECT c_custkey AS k FROM customer)
    SELECT 'a' || k AS source, 'self-alias' AS problem FROM c WHERE k % 7 = 0 UNION ALL SELECT 'live' || k, 'alias-source-is-live' FROM c WHERE k % 7 = 1
    UNION ALL SELECT 'a' || k, 'duplicate-alias' FROM c WHERE k % 7 = 2 UNION ALL SELECT 'a' || k, 'unknown-alias-target' FROM c WHERE k % 7 = 3
    UNION ALL SELECT 'a' || k, 'alias-cycle' FROM c WHERE k % 7 = 4 UNION ALL SELECT 'b' || k, 'alias-cycle' FROM c WHERE k % 7 = 4""", graph=False)
def alias_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    named = lambda p: F.concat(F.lit(p), k.cast("string"))
    pair = lambda s, t: F.struct(s.alias("source"), t.alias("target"))
    rows = (
        F.when(k % 7 == 0, F.array(pair(named("a"), named("a")))).when(k % 7 == 1, F.array(pair(named("live"), named("end"))))
        .when(k % 7 == 2, F.array(pair(named("a"), named("end")), pair(named("a"), named("end"))))
        .when(k % 7 == 3, F.array(pair(named("a"), named("nowhere"))))
        .when(k % 7 == 4, F.array(pair(named("a"), named("b")), pair(named("b"), named("a"))))
        .otherwise(F.array(pair(named("a"), named("end"))))
    )
    own = c.select(F.explode(rows).alias("r")).select("r.*")
    return aliases.alias_problems(own, c.select(F.explode(F.array(named("end"), named("live"))).alias("id")))


@registered("observed_forest", " SELECT id AS child, parent, CASE type WHEN 'order' THEN 3 WHEN 'customer' THEN 2 WHEN 'supplier' THEN 2 WHEN 'nation' THEN 1 ELSE 0 END::BIGINT AS depth FROM ent WHERE type <> 'part' AND (parent IS NOT NULL OR id IN (SELECT parent FROM ent))")
def observed_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = star_graph(spark, sf_dir).entities.where("parent is not null")
    return hierarchy.observed_forest(own.select(F.col("parent").alias("container"), F.col("id").alias("child")))


@registered("parents_through_aliases", " SELECT id, CASE WHEN parent = 'ent_' || md5('nation:3') THEN 'ent_' || md5('nation:5') WHEN parent = 'ent_' || md5('nation:4') THEN 'ent_' || md5('nation:5') ELSE parent END AS parent FROM ent WHERE type IN ('customer', 'supplier')")
def parents_through_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation 3 became nation 4, which became nation 5."""
    graph = star_graph(spark, sf_dir)
    own = spark.range(3, 5).select(entity_id("nation", F.col("id")).alias("source"), entity_id("nation", F.col("id") + 1).alias("target"))
    return graph.with_frames(aliases=own).resolved().entities.where("type in ('customer', 'supplier')").select("id", "parent")


# functions ---------------------------------------------------------------------------------------------


@registered("customer_fields", r"""SELECT c_custkey AS id, regexp_full_match(lower(c_mktsegment), '[a-z][a-z0-9]*([._-][a-z0-9]+)*') AS open_token,
    CASE WHEN c_custkey % 3 > 0 THEN c_name WHEN c_custkey % 2 > 0 THEN c_mktsegment END AS purpose, c_custkey % 3 > 0 OR c_custkey % 2 > 0 AS meaning,
    c_custkey % 4 > 1 AS extensions, CASE WHEN c_custkey % 5 < 4 THEN c_custkey % 5 < 2 END AS coarser,
    'action:' || sha256(c_name || chr(0) || c_mktsegment) AS observation, 'sha256:' || sha256(c_name) AS revision FROM customer""", graph=False)
def customer_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    intent, summary = F.when(k % 3 > 0, F.col("c_name")), F.when(k % 2 > 0, F.col("c_mktsegment"))
    keys = F.element_at(F.array(*[F.lit(x) for x in ("plain", "with space/x", "own:key", "own/key.v1")]), (k % 4 + 1).cast("int"))
    scale = F.element_at(F.array(*[F.lit(x) for x in ("system", "domain", "part", "element", "unknown")]), (k % 5 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(
        k.alias("id"), S.open_token_valid(F.lower("c_mktsegment")).alias("open_token"), S.purpose(intent, summary).alias("purpose"), S.has_meaning(intent, summary).alias("meaning"),
        S.extensions_valid(F.create_map(keys, F.lit("v"))).alias("extensions"), S.coarser(scale, F.lit("part")).alias("coarser"),
        S.observation_key(F.lit("action"), F.col("c_name"), F.col("c_mktsegment")).alias("observation"), S.content_revision(F.encode("c_name", "UTF-8")).alias("revision"),
    )


@registered("icon_domains", r"""WITH p AS (SELECT page_id, regexp_extract(regexp_replace(url, '^[a-z]+://', ''), '^[^/?#]*') AS h FROM pages WHERE url IS NOT NULL),
    h AS (SELECT page_id, form, CASE form WHEN 'plain' THEN h WHEN 'upper' THEN upper(h) WHEN 'address' THEN (page_id % 256) || '.0.0.1' WHEN 'short' THEN split_part(h, '.', 1) WHEN 'dash' THEN '-' || h
      WHEN 'dot' THEN h || '.' WHEN 'long' THEN repeat('a', 64) || '.' || h ELSE ' ' || h END AS h FROM p, (VALUES ('plain'), ('upper'), ('address'), ('short'), ('dash'), ('dot'), ('long'), ('space')) t(form))
    SELECT page_id, form, length(h) <= 253 AND contains(h, '.') AND regexp_full_match(h, '([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?)(\.[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?)*')
      AND NOT regexp_full_match(h, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+') AS domain, length(h) BETWEEN 1 AND 280 AND trim(h) = h AND NOT regexp_matches(h, '[[:cntrl:]]') AS summary FROM h""", graph=False)
def icon_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of all pages, as they are and in forms that a domain may not have: capitals, an address, one label, a dash or dot at an end, a long label, a space."""
    host = F.regexp_extract(F.regexp_replace("url", "^[a-z]+://", ""), "^[^/?#]*", 0)
    own, h = table(spark, sf_dir, "pages").where("url is not null").select("page_id", host.alias("h")), F.col("h")
    forms = {
        "plain": h, "upper": F.upper(h), "address": F.concat((F.col("page_id") % 256).cast("string"), F.lit(".0.0.1")), "short": F.split(h, r"\.")[0], "dash": F.concat(F.lit("-"), h),
        "dot": F.concat(h, F.lit(".")), "long": F.concat(F.lit("a" * 64 + "."), h), "space": F.concat(F.lit(" "), h),
    }
    met = own.select("page_id", F.explode(F.array(*[F.struct(F.lit(k).alias("form"), v.alias("h")) for k, v in forms.items()])).alias("x")).select("page_id", "x.*")
    return met.select("page_id", "form", S.icon_domain_valid(h).alias("domain"), S.summary_valid(h).alias("summary"))


@registered("surface_labels", " SELECT relation, direction, CASE WHEN type = 'requires' THEN CASE direction WHEN 'outgoing' THEN 'Needs' ELSE 'Needed by' END WHEN direction = 'outgoing' THEN 'Relates to' ELSE 'Related from' END AS label FROM step")
def surface_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = traverse._steps(star_graph(spark, sf_dir).relations, "both")
    return steps.select("relation", "direction", S.surface_label(F.col("direction"), F.col("type")).alias("label"))


@registered("package_names", """SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 1 THEN '@s' || p_partkey || '/kit' WHEN 2 THEN 'node:fs' WHEN 3 THEN 'lib' || p_partkey WHEN 4 THEN 'node:fs' END AS package FROM part""", graph=False)
def package_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    text = k.cast("string")
    specifier = (
        F.when(k % 6 == 0, F.concat(F.lit("./part"), text)).when(k % 6 == 1, F.concat(F.lit("@s"), text, F.lit("/kit/deep/file"))).when(k % 6 == 2, "node:fs/promises")
        .when(k % 6 == 3, F.concat(F.lit("lib"), text, F.lit("/sub"))).when(k % 6 == 4, "fs").otherwise(F.concat(F.lit("#own"), text))
    )
    return table(spark, sf_dir, "part").select(k.alias("id"), S.package_of(specifier).alias("package"))


@registered("json_budgets", """SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 6 END AS n_values, CASE c_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END AS depth, c_custkey % 3 < 2 AS fits FROM customer""", graph=False)
def json_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scalar, a list of three, and records in lists in a record."""
    k = F.col("c_custkey")
    text = F.when(k % 3 == 0, "7").when(k % 3 == 1, "[1, null, true]").otherwise(F.concat(F.lit('{"a": [{"b": '), k.cast("string"), F.lit('}, {"c": null}]}')))
    size = S.json_structure(text)
    return table(spark, sf_dir, "customer").select(k.alias("id"), size["values"].cast("int").alias("n_values"), size["depth"].cast("int").alias("depth"), S.within_budget(text, 5, 3).alias("fits"))


# evidence and sessions ---------------------------------------------------------------------------------


def _bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bindings of customers, every tenth to the one before."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("scope"), k.alias("key"), entity_id("customer", F.when(k % 10 == 0, k - 1).otherwise(k)).alias("component_id"))


@registered("binding_components", """SELECT c_custkey AS key, 'ent_' || md5('customer:' || CASE WHEN (c_custkey - (c_custkey % 10 = 0)::INT) % 10 = 9 THEN c_custkey - (c_custkey % 10 = 0)::INT - 1 ELSE c_custkey - (c_custkey % 10 = 0)::INT END) AS component_id FROM customer""", graph=False)
def binding_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that end in nine have become the ones before."""
    k = F.col("c_custkey")
    moved = table(spark, sf_dir, "customer").where(k % 10 == 9).select(entity_id("customer", k).alias("source"), entity_id("customer", k - 1).alias("target"))
    return reconcile.resolve_bindings(_bound(spark, sf_dir), moved).select("key", "component_id")


@registered("binding_conflicts", """WITH b AS (SELECT c_custkey - (c_custkey % 10 = 0)::INT AS k FROM customer)
    SELECT 'ent_' || md5('customer:' || k) AS component_id, 'ambiguous-binding' AS problem FROM b GROUP BY k HAVING count(*) > 1
    UNION ALL SELECT DISTINCT 'ent_' || md5('customer:' || k), 'foreign-binding' FROM b WHERE k % 6 = 0""", graph=False)
def binding_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    others = table(spark, sf_dir, "customer").where("c_custkey % 6 = 0").select(entity_id("customer", F.col("c_custkey")).alias("component_id"))
    return reconcile.binding_conflicts(_bound(spark, sf_dir), others)


@registered("record_references", """WITH r AS (SELECT l_linestatus AS scope, l_orderkey || '-' || l_linenumber AS key, l_linenumber % 6 AS kind, 'p' || l_partkey AS p, 's' || l_suppkey AS s FROM lineitem)
    SELECT DISTINCT scope, key AS ref, key AS record_key FROM r WHERE kind = 0 UNION SELECT scope, p, key FROM r WHERE kind > 0 UNION SELECT scope, s, key FROM r WHERE kind = 4""", graph=False)
def record_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as records of all six kinds."""
    kind = F.element_at(F.array(*[F.lit(k) for k in observe.KINDS[:1] + observe.KINDS[1:4] + observe.KINDS[4:]]), (F.col("l_linenumber") % 6 + 1).cast("int"))
    part, supplier = F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    records = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("scope"), key.alias("key"), kind.alias("kind"), part.alias("component"), part.alias("subject"), part.alias("from"), supplier.alias("to"))
    return derive.record_references(records).select("scope", F.col("key").alias("ref"), "record_key")


@registered("stored_evidence_problems", """, b AS (SELECT c_custkey - (c_custkey % 10 = 0)::INT AS k FROM customer)
    SELECT 'ent_' || md5('customer:' || k) AS id, 'component-bound-twice' AS problem FROM b GROUP BY k HAVING count(*) > 1
    UNION ALL SELECT id, 'relation-bound-twice' FROM rel WHERE type = 'placed' AND id LIKE 'rel_0%'
    UNION ALL SELECT id, 'unbound-endpoint' FROM rel WHERE type = 'placed'""")
def stored_evidence_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are not bound, so no placed relation has both its ends bound; some are bound twice."""
    placed = star_graph(spark, sf_dir, types=("placed",)).relations
    own = placed.select(F.col("id").alias("relation_id"), F.lit(False).alias("removed"))
    own = own.unionByName(own.where("relation_id like 'rel_0%'"))
    return reconcile.stored_evidence_problems(_bound(spark, sf_dir), own, placed)


@registered("external_records", "SELECT source AS scope, doc_id AS key, any_value(md5(text)) AS body FROM documents GROUP BY 1, 2", graph=False)
def external_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A submitted snapshot that sends every record twice, held to a session's rules."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("scope"), F.col("doc_id").alias("key"), F.lit("documentation").alias("kind"), F.col("text").alias("body"))
    scopes = docs.select("scope").distinct().select(F.lit("p").alias("project"), F.lit("s").alias("scanner"), "scope")
    return observe.external_snapshot(docs.unionByName(docs), "p", "s", scopes).select("scope", "key", F.md5("body").alias("body"))


@registered("session_refusals", "SELECT * FROM (VALUES ('contradiction', 'observation-contradiction'), ('no coverage', 'observation-coverage-mismatch'), ('unknown kind', 'invalid-observation-kind'), ('unregistered scope', 'unregistered-snapshot-scope'), ('fine', 'none')) t(session, code)", graph=False)
def session_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("scope"), F.col("doc_id").alias("key"), F.lit("documentation").alias("kind"), F.col("text").alias("body"))
    scopes = docs.select("scope").distinct()
    changed = docs.unionByName(docs.withColumn("body", F.concat(F.coalesce("body", F.lit("")), F.lit("!"))))
    calls = {
        "contradiction": lambda: observe.completed_snapshot(changed, scopes, scopes),
        "no coverage": lambda: observe.completed_snapshot(docs, scopes, scopes.where("scope <> 'src2'")),
        "unknown kind": lambda: observe.completed_snapshot(docs.withColumn("kind", F.lit("note")), scopes, scopes),
        "unregistered scope": lambda: observe.external_snapshot(docs, "p", "s", scopes.select(F.lit("p").alias("project"), F.lit("other").alias("scanner"), "scope")),
        "fine": lambda: observe.completed_snapshot(docs, scopes, scopes),
    }
    return spark.createDataFrame([(name, _code(call)) for name, call in calls.items()], "session string, code string")


@registered("sequence_problems", """WITH e AS (SELECT user_id AS session, event_id AS arrival, CASE WHEN event_id % 9 = 0 THEN event_id - 40 ELSE event_id END AS sequence FROM events)
    SELECT session, arrival, sequence FROM (SELECT *, max(sequence) OVER (PARTITION BY session ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM e) WHERE sequence <= m""", graph=False)
def sequence_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    messages = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), k.alias("arrival"), F.when(k % 9 == 0, k - 40).otherwise(k).alias("sequence"))
    return observe.sequence_problems(messages).select("session", "arrival", "sequence")


@registered("session_states", """WITH e AS (SELECT user_id::VARCHAR AS session, user_id % 2 = 0 AS even, event_id AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)
    SELECT session, n AS arrival, CASE WHEN k >= 4 AND even THEN 'expired' WHEN k >= 5 THEN 'completed' ELSE 'active' END AS status,
      CASE WHEN k > 5 OR k = 5 AND even THEN 'session-ended' WHEN k = 3 THEN 'sequence-not-advancing' WHEN k = 4 AND NOT even THEN 'expiry-heartbeat-mismatch' END AS problem FROM e""", graph=False)
def session_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session per user: its second message is a heartbeat, its third goes back, its fourth expires it, of even users by that heartbeat, its fifth completes it."""
    from pyspark.sql import Window

    at = _scratch(spark, "stream")
    k, n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")), F.col("event_id").cast("long")
    # what the message two before was: the heartbeat for the fourth; for the third the first, which lies behind however far apart events are
    beat = F.first(n).over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-2, -2))
    covered = F.array(F.struct(F.lit("s").alias("scope"), F.array().cast("array<string>").alias("kinds"), F.lit("partial").alias("state")))
    sent = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("session"), n.alias("arrival"), F.when(k == 3, beat).otherwise(n).alias("sequence"),
        F.when(k == 2, "heartbeat").when(k == 4, "expire").when(k == 5, "complete").otherwise("batch").alias("type"), F.when(F.col("user_id") % 2 == 0, beat).otherwise(beat + 1).alias("heartbeat"),
        F.lit(None).cast("array<string>").alias("scopes"), F.lit(None).cast(sessions.RECORDS).alias("records"), F.when(k == 5, covered).alias("coverage"),
    )
    begin = sent.groupBy("session").agg((F.min("arrival") - 1).alias("arrival")).withColumns({
        "sequence": F.col("arrival"), "type": F.lit("begin"), "heartbeat": F.lit(None).cast("long"), "scopes": F.array(F.lit("s")), "records": F.lit(None).cast(sessions.RECORDS), "coverage": F.lit(None).cast(sessions.COVERAGE),
    })
    sent.unionByName(begin).write.parquet(f"{at}/in")
    sessions.run_sessions(spark.readStream.schema(sessions.MESSAGE).parquet(f"{at}/in"), f"{at}/checkpoint", f"{at}/out")
    return sessions.read_receipts(spark, f"{at}/out").where("type <> 'begin'").select("session", "arrival", "status", "problem")


@registered("evidence_store", """SELECT source_key, scope, count(*) AS n FROM (SELECT CASE WHEN source = 'src2' THEN 'again' ELSE source END AS source_key, lang AS scope FROM documents) GROUP BY 1, 2""", graph=False)
def evidence_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of all sources written as JSON, one of them replaced, and read back."""
    path = _scratch(spark, "evidence")
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("source_key"), F.coalesce("lang", F.lit("none")).alias("scope"), F.col("doc_id").cast("string").alias("key"), F.lit("first").alias("state"))
    stores.write_evidence(docs, path)
    stores.write_evidence(docs.where("source_key = 'src2'").withColumn("state", F.lit("again")), path)
    back = stores.read_evidence(spark, path, "source_key string, scope string, key string, state string")
    named = F.when(F.col("state") == "again", "again").otherwise(F.col("source_key"))
    return back.groupBy(named.alias("source_key"), "scope").agg(F.count(F.lit(1)).alias("n"))


ORACLE_SQL["evidence_store"] = "SELECT CASE WHEN source = 'src2' THEN 'again' ELSE source END AS source_key, coalesce(lang, 'none') AS scope, count(*) AS n FROM documents GROUP BY 1, 2"


@registered("scanned_records", """SELECT lang AS scope, 'doc' || doc_id AS key, 'documentation' AS kind, length(coalesce(text, ''))::VARCHAR AS body FROM documents WHERE lang IS NOT NULL""", graph=False)
def scanned_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as resources below their language's root, read by a user's scanner."""
    resources = table(spark, sf_dir, "documents").select(F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    scopes = table(spark, sf_dir, "documents").select(F.col("lang").alias("scope"), F.col("lang").alias("resource_root")).where("scope is not null").distinct()
    reader = scanner.Scanner("reader", "one", "1", lambda path, content: [(f"doc{path.rpartition('/')[2]}", "documentation", str(len(content.decode())))])
    return scanner.scan_resources(reader, resources, scopes).select("scope", "key", "kind", "body")


@registered("replaced_source", "SELECT source AS source_key, count(*) AS n FROM documents WHERE source <> 'src3' GROUP BY 1 UNION ALL SELECT 'src3', count(*) FROM documents WHERE source = 'src3' AND lang = 'en' HAVING count(*) > 0", graph=False)
def replaced_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "documents").select(F.col("source").alias("source_key"), "lang")
    own = held.where("source_key = 'src3' and lang = 'en'")
    return reconcile.replace_source(held, "src3", own).groupBy("source_key").agg(F.count(F.lit(1)).alias("n"))


@registered("structure_actions", """, c AS (SELECT c_custkey AS k, c_nationkey AS n FROM customer)
    SELECT 'ent_' || md5('customer:' || k) AS component_id, CASE WHEN k % 3 = 0 THEN 'ent_' || md5('nation:' || n) WHEN k % 2 = 0 THEN 'ent_' || md5('customer:' || (k - 1)) END AS parent,
    CASE WHEN k % 5 >= 2 THEN true END AS shared FROM c""")
def structure_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even customers are seen inside the one before; every third was moved by hand and stays where it is."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    own, home = entity_id("customer", k), entity_id("nation", F.col("c_nationkey"))
    bound = c.select(F.lit("s").alias("scope"), k.alias("key"), own.alias("component_id"), F.when(k % 3 > 0, home).otherwise(F.lit("elsewhere")).alias("p_parent"), F.lit(None).cast("boolean").alias("p_shared"))
    forest = c.where(k % 2 == 0).select(k.alias("key"), (k - 1).alias("parent_key"))
    breadth = c.select(k.alias("key"), (k % 5).alias("reuse_breadth"))
    return reconcile.structure_actions(bound, forest, breadth, star_graph(spark, sf_dir).entities)


@registered("touched_components", """, t AS (SELECT 'ent_' || md5('supplier:' || s_suppkey) AS id FROM supplier WHERE s_suppkey % 4 = 0 UNION ALL SELECT 'ent_' || md5('part:' || p_partkey) FROM part WHERE p_partkey % 50 = 0)
    SELECT id FROM t UNION SELECT id FROM ent WHERE parent IN (SELECT id FROM t) UNION SELECT source FROM rel WHERE target IN (SELECT id FROM t)""")
def touched_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = star_graph(spark, sf_dir)
    s = table(spark, sf_dir, "supplier").select(entity_id("supplier", F.col("s_suppkey")).alias("component_id"), F.when(F.col("s_suppkey") % 4 == 0, "update").otherwise("keep").alias("action"))
    p = table(spark, sf_dir, "part").select(entity_id("part", F.col("p_partkey")).alias("component_id"), F.when(F.col("p_partkey") % 50 == 0, "retire").otherwise("retain").alias("action"))
    return reconcile.touched(s.unionByName(p), graph.entities, graph.relations)


@registered("projected_summaries", "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_mktsegment END AS summary FROM customer", graph=False)
def projected_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), reconcile.projected_summary(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")), F.col("c_mktsegment")).alias("summary"))


@registered("reconcile_all_fields", """WITH c AS (SELECT c_custkey AS k, c_name AS n, c_mktsegment AS m FROM customer),
    f AS (SELECT *, k % 5 AS hand FROM c)
    SELECT k AS key, CASE WHEN hand = 1 THEN 'mine' ELSE lower(n) || '.example.org' END AS icon_domain, CASE WHEN hand = 2 THEN 'mine' ELSE n || ' new' END AS label,
      CASE WHEN hand = 3 THEN 'mine' ELSE upper(n) END AS name, CASE WHEN hand = 4 THEN 'mine' ELSE 'It is ' || m END AS summary, m AS type, 'update' AS action FROM f""", graph=False)
def reconcile_all_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five fields that evidence may own; of most customers one was edited by hand since."""
    k, n = F.col("c_custkey"), F.col("c_name")
    c = table(spark, sf_dir, "customer")
    own, scope = entity_id("customer", k), F.lit("s").alias("scope")
    proposed = {"icon_domain": F.concat(F.lower(n), F.lit(".example.org")), "label": F.concat(n, F.lit(" new")), "name": F.upper(n), "summary": F.concat(F.lit("It is "), "c_mktsegment"), "type": F.col("c_mktsegment")}
    prior = c.select(scope, k.alias("key"), own.alias("component_id"), F.lit(True).alias("present"), *[n.alias(f"p_{f}") for f in reconcile.OWNED])
    now = c.select(own.alias("id"), *[F.when(k % 5 == at, "mine").otherwise(n).alias(f) if f != "type" else n.alias(f) for at, f in enumerate(reconcile.OWNED, 1)])
    coverage = spark.createDataFrame([("s", ["component-candidate"], "complete")], "scope string, kinds array<string>, state string")
    out = reconcile.component_actions(prior, c.select(scope, k.alias("key"), *[e.alias(f) for f, e in proposed.items()]), coverage, now, reconcile.OWNED)
    return out.select("key", *reconcile.OWNED, "action")


@registered("resource_listing", """WITH k AS (SELECT n_nationkey AS key, n_name, row_number() OVER (ORDER BY 'n_nationkey=' || n_nationkey || '/') - 1 AS place FROM nation)
    SELECT key, (place // 4)::BIGINT AS page, length(n_name) + 1 AS bytes, sha256(n_name || chr(10)) AS content FROM k""", graph=False)
def resource_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each nation in a folder of its own, listed in pages of four behind the last path, and read with its content."""
    root = _scratch(spark, "resources")
    table(spark, sf_dir, "nation").select("n_nationkey", "n_name").repartition(1).write.partitionBy("n_nationkey").text(root)
    rows, after, n = [], None, 0
    while True:
        page = stores.resource_page(spark, root, 4, after, "part-*").collect()
        if not page:
            break
        rows += [(r["path"], n, r["length"]) for r in page]
        after, n = page[-1]["path"], n + 1
    listed = spark.createDataFrame(rows, "path string, page long, bytes long")
    read = stores.read_resources(spark, root, "part-*", most_bytes=1000).select("path", F.sha2("content", 256).alias("content"))
    name = F.regexp_extract("path", "/(n_nationkey=[0-9]+/part-[^/]*)$", 1)  # readers and listings write the scheme in their own way
    met = listed.select(name.alias("name"), "page", "bytes").join(read.select(name.alias("name"), "content"), "name")
    return met.select(F.regexp_extract("name", "=([0-9]+)/", 1).cast("int").alias("key"), "page", "bytes", "content")


@registered("stored_aliases", """WITH t AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS f FROM documents)
    SELECT 'ent_' || md5('document:' || doc_id) AS source, 'ent_' || md5('document:' || f) AS target, 'ent_' || md5('document:' || f) AS id FROM t WHERE doc_id <> f""", graph=False)
def stored_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of documents as aliases of the first, stored with it, read back and followed."""
    from ..sources.star import document_aliases

    live, aliases = document_aliases(spark, sf_dir)
    graph = _stored(spark, sf_dir, GraphFrames(live, spark.createDataFrame([], RELATIONS), aliases, 1))
    found = query.resolve_ids(graph, graph.aliases.select(F.col("source").alias("requested")))
    return graph.aliases.join(found.withColumnRenamed("requested", "source"), "source")


@registered("commit_revisions", """, n AS (SELECT 'ent_' || md5('nation:' || n_nationkey) AS id, n_nationkey AS k FROM nation)
    SELECT 'entity' AS part, ent.id, CASE WHEN k % 2 = 0 THEN 'even ' || k WHEN k % 2 = 1 THEN 'odd ' || k ELSE name END AS said, 3::BIGINT AS generation FROM ent LEFT JOIN n ON n.id = ent.id
    UNION ALL SELECT * FROM (VALUES ('outcome', 'even', 'committed', 2), ('outcome', 'odd', 'committed', 3), ('outcome', 'even again', 'conflict', 3)) t
    UNION ALL SELECT 'moved', id, NULL, 3 FROM n WHERE k % 2 = 0""")
def commit_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two writers that saw the same generation change different nations and both commit; one that saw the old nations does not."""
    root = _scratch(spark, "store")
    stores.write_generation(star_graph(spark, sf_dir, held=True), root)
    seen = stores.read_generation(spark, root)
    nations = table(spark, sf_dir, "nation").select(entity_id("nation", F.col("n_nationkey")).alias("id"), F.col("n_nationkey").alias("k"))
    none = seen.relations.where("false").withColumn("op", F.lit("update")), spark.createDataFrame([], ALIASES)
    out, moved = [], []
    for who, rest, said in (("even", 0, "even "), ("odd", 1, "odd "), ("even again", 0, "late ")):
        own = nations.where(F.col("k") % 2 == rest)
        changed = seen.entities.join(own, "id").withColumns({"name": F.concat(F.lit(said), F.col("k").cast("string")), "op": F.lit("update")}).drop("k")
        outcome, generation, lost = mutate.commit_batch(spark, root, changed, *none, mutate.component_revisions(seen, own))
        out.append(("outcome", who, outcome, generation))
        moved += [("moved", id_, None, generation) for id_ in lost]
    now = stores.read_generation(spark, root)
    rows = spark.createDataFrame(out + moved, "part string, id string, said string, generation long")
    return now.entities.select(F.lit("entity").alias("part"), "id", F.col("name").alias("said"), F.lit(now.generation).cast("long").alias("generation")).unionByName(rows)


@registered("followed_projection", """ SELECT id, CASE WHEN type = 'nation' THEN replace(text, chr(10) || lower(name) || chr(10), chr(10) || 'land of ' || lower(name) || chr(10)) ELSE text END AS searchable,
    3::BIGINT AS generation, (SELECT count(*) FROM rel WHERE source = searchable.id OR target = searchable.id) AS relations FROM searchable""")
def followed_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three commits, seen by a stream in two goes: what it shows at last is derived of the third alone."""
    from ..streaming import projection

    root, shown, check = _scratch(spark, "store"), _scratch(spark, "projection"), _scratch(spark, "stream")
    stores.write_generation(star_graph(spark, sf_dir, held=True), root)
    graph = stores.read_generation(spark, root)
    projection.run_projection(spark, root, shown, check)
    for n, said in ((2, "Realm of "), (3, "Land of ")):
        name = F.when(F.col("type") == "nation", F.concat(F.lit(said), "name")).otherwise(F.col("name"))
        stores.write_generation(graph.with_frames(entities=graph.entities.withColumn("name", name), generation=n), root)
    projection.run_projection(spark, root, shown, check)
    now = projection.read_projection(spark, shown)
    # a relation of an entity with itself stands in both of its lists
    twice = graph.relations.where("source = target").select(F.col("source").alias("id"), F.lit(-1).alias("n"))
    ends = now.adjacency.select(F.split("owner", ":")[0].alias("id"), F.size("items").alias("n")).unionByName(twice).groupBy("id").agg(F.sum("n").alias("relations"))
    out = now.catalog.join(ends, "id", "left").na.fill(0, ["relations"])
    return out.select("id", "searchable", F.lit(now.generation).cast("long").alias("generation"), "relations")


@registered("retired_by_hook", " SELECT id FROM ent WHERE type = 'part' AND id NOT IN (SELECT target FROM rel WHERE type = 'requires' AND id LIKE 'rel_0%')")
def retired_by_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's function picks all parts; what the orders require of them goes too, but for a sixteenth."""
    graph = star_graph(spark, sf_dir, types=("requires",))
    removable = graph.relations.where("type = 'requires' and id not like 'rel_0%'").select("id")
    return hierarchy.retire_selected(lambda entities, _: entities.where("type = 'part'"), graph.entities, graph.relations, removable).select("id")


@registered("store_outcomes", "SELECT * FROM (VALUES ('first', 'committed'), ('again', 'conflict'), ('no store', 'provider-failure'), ('no answer', 'indeterminate'), ('scan', 'none'), ('second scan', 'scan-already-active'), ('scan after the end', 'none'), ('small bound', 'evidence-too-large'), ('small page', 'page-too-large')) t(request, outcome)", graph=False)
def store_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = star_graph(spark, sf_dir)
    small = graph.with_frames(entities=graph.entities.where("type in ('region', 'nation')"), relations=graph.relations.where("false"))
    root = _scratch(spark, "store")
    out = [("first", stores.commit(small, root)), ("again", stores.commit(small, root))]
    # relations that cannot be written: the store is asked and holds nothing
    broken = small.with_frames(relations=small.entities.limit(1).select(*[F.raise_error(F.lit("lost")).cast("string").alias(c.split()[0]) for c in RELATIONS.split(", ")]), generation=2)
    out.append(("no store", stores.commit(broken, root)))
    out.append(("no answer", stores.commit(small, "nowhere://store")))
    claims = []
    out.append(("scan", _code(lambda: claims.append(stores.begin_scan(spark, root, "p", "s")))))
    out.append(("second scan", _code(lambda: stores.begin_scan(spark, root, "p", "s"))))
    stores.end_scan(spark, claims[0])
    out.append(("scan after the end", _code(lambda: stores.begin_scan(spark, root, "p", "s"))))
    evidence = table(spark, sf_dir, "nation").select(F.lit("a").alias("source_key"), F.lit("s").alias("scope"), F.col("n_name").alias("key"))
    out.append(("small bound", _code(lambda: stores.write_evidence(evidence, f"{root}/evidence", most_bytes=100))))
    bound = small.entities.select(F.col("id").alias("component_id"), F.lit(True).alias("present"))
    out.append(("small page", _code(lambda: list(query.export_pages(small, bound, most_bytes=100)))))
    return spark.createDataFrame(out, "request string, outcome string")


@registered("reconciled_graph", f"""WITH a AS ({_RECONCILED}), n AS (SELECT 'ent_' || md5('customer:' || c_custkey) AS id, CASE WHEN c_custkey % 5 = 0 THEN 'by hand' ELSE c_name END AS name,
    CASE WHEN c_custkey % 6 > 0 THEN c_mktsegment END AS type FROM customer)
    SELECT id, CASE WHEN action = 'update' THEN a.name ELSE n.name END AS name, CASE WHEN action = 'update' THEN a.type ELSE n.type END AS type FROM n LEFT JOIN a ON component_id = id AND action <> 'create'
    UNION ALL SELECT component_id, name, type FROM a WHERE action = 'create'""", graph=False)
def reconciled_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers' graph after a reconcile, committed as the next generation and read back."""
    prior, candidates, coverage, now = _prior_current(spark, sf_dir)
    graph = star_graph(spark, sf_dir)
    own = graph.entities.where("type = 'customer'").drop("name", "type").join(now, "id").select(*graph.entities.columns)
    root = _scratch(spark, "store")
    stores.write_generation(graph.with_frames(entities=own, relations=graph.relations.where("false")), root)

    def change(g: GraphFrames) -> GraphFrames:
        return reconcile.apply_actions(g, reconcile.component_actions(prior, candidates, coverage, g.entities))

    mutate.with_retries(lambda: stores.read_generation(spark, root), change, lambda g: stores.write_generation(g, root))
    return stores.read_generation(spark, root).entities.select("id", "name", "type")


@registered("reconciled_relations", """, s AS (SELECT * FROM rel WHERE type = 'supplies')
    SELECT id, CASE WHEN id LIKE 'rel_1%' OR id LIKE 'rel_2%' THEN 'feeds' ELSE type END AS type, source, target FROM s WHERE NOT id LIKE 'rel_0%'""")
def reconciled_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplies that are seen no more go, those seen as something else change, the rest stays."""
    graph = star_graph(spark, sf_dir, types=("supplies",))
    own = graph.relations
    prior = own.select(F.lit("s").alias("scope"), F.col("id").alias("key"), F.col("id").alias("relation_id"), F.lit(False).alias("removed"), *[F.col(f).alias(f"p_{f}") for f in ("type", "source", "target")])
    observed = own.where("id not like 'rel_0%'").select(F.lit("s").alias("scope"), F.col("id").alias("key"), F.when(F.col("id").rlike("^rel_[12]"), "feeds").otherwise(F.col("type")).alias("type"), "source", "target")
    coverage = spark.createDataFrame([("s", ["relationship"], "complete")], "scope string, kinds array<string>, state string")
    actions = reconcile.relationship_actions(prior, observed, coverage, own)
    return reconcile.apply_actions(graph, relations=actions).relations.select("id", "type", "source", "target")


# checks ------------------------------------------------------------------------------------------------


@registered("affected_ids", """SELECT o_orderpriority AS generation, count(DISTINCT o_custkey) AS n, md5(string_agg(DISTINCT o_custkey::VARCHAR, ',' ORDER BY o_custkey::VARCHAR)) AS digest FROM orders GROUP BY 1""", graph=False)
def affected_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("generation"), F.col("o_custkey").cast("string").alias("id"))
    return observe.affected_ids(changes).select("generation", F.size("affected").cast("long").alias("n"), F.md5(F.array_join("affected", ",")).alias("digest"))


@registered("mutation_problems", """SELECT o_custkey AS id, 'duplicate-target' AS problem FROM orders GROUP BY 1 HAVING count(*) > 1
    UNION ALL SELECT o_custkey, 'unknown-target' FROM orders WHERE o_orderkey % 3 > 0 AND o_custkey % 11 = 0 UNION ALL SELECT DISTINCT o_custkey, 'target-not-affected' FROM orders WHERE o_custkey % 13 = 0""", graph=False)
def mutation_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    changes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, "create").otherwise("update").alias("op"))
    return invariants.mutation_problems(changes, c.where("id % 11 > 0"), c.where("id % 13 > 0"))


@registered("stale_revisions", "SELECT c_custkey AS resource, 1 AS expected, CASE WHEN c_custkey % 5 < 4 THEN (c_custkey % 5 + 1)::INT END AS actual FROM customer WHERE c_custkey % 5 > 0", graph=False)
def stale_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    stored = c.where(k % 5 < 4).select(k.alias("resource"), (k % 5 + 1).cast("int").alias("revision"))
    return invariants.stale_revisions(c.select(k.alias("resource"), F.lit(1).alias("revision")), stored)


@registered("unknown_references", "SELECT o_orderkey AS owner, 'ent_' || md5('customer:' || (o_custkey + 3)) AS id FROM orders WHERE o_custkey + 3 NOT IN (SELECT c_custkey FROM customer)", graph=False)
def unknown_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("owner"), entity_id("customer", F.col("o_custkey") + 3).alias("id"))
    return invariants.unknown_references(own, star_graph(spark, sf_dir).entities).select("owner", "id")


@registered("merged_pages", " SELECT id, CASE WHEN type = 'nation' THEN upper(name) || '!' ELSE name END AS name FROM ent WHERE type IN ('region', 'nation', 'supplier')")
def merged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = star_graph(spark, sf_dir).entities.select("id", "type", "name")
    newer = own.where("type in ('nation', 'supplier')").withColumn("name", F.when(F.col("type") == "nation", F.concat(F.upper("name"), F.lit("!"))).otherwise(F.col("name")))
    return paging.merge_pages(own.where("type in ('region', 'nation')"), newer).select("id", "name")


@registered("drawn_relations", """, e AS (SELECT source, target, min(id) AS id FROM rel WHERE type = 'supplies' GROUP BY 1, 2), d AS (SELECT id, source, target FROM e ORDER BY id LIMIT 20)
    SELECT d.*, (SELECT count(*) FROM e) AS n, (SELECT greatest(0, count(*) - 20) FROM e) AS omitted FROM d""")
def drawn_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = star_graph(spark, sf_dir, types=("supplies",)).relations.select(*[S.packed(F.col(c)).alias(c) for c in ("source", "target", "id")])
    # dealt before they are grouped: a task then holds its own share of the pairs; bytes of minted ids have the order of their texts
    own = rel.repartition("source", "target").groupBy("source", "target").agg(F.min("id").alias("id")).select(*[S.unpacked(F.col(c)).alias(c) for c in rel.columns])
    drawn, total = levels.drawn_relations(own)
    return drawn.crossJoin(total).select("id", "source", "target", "n", F.col("omitted").cast("long").alias("omitted"))  # one row of totals


# mutations ---------------------------------------------------------------------------------------------

_FIELDS = "SELECT id, name, type, scale, shared, parent FROM ent"
_NEW = "'ent_' || md5('component:new')"


def _fields(graph: GraphFrames) -> DataFrame:
    return graph.entities.select("id", "name", "type", "scale", "shared", "parent")


@registered("create_component", f" {_FIELDS} UNION ALL SELECT {_NEW}, 'New one', NULL, 'part', NULL, 'ent_' || md5('nation:2')")
def create_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = {"id": _key(spark, "component", "new"), "name": "New one", "scale": "part", "parent": _key(spark, "nation", 2)}
    return _fields(mutate.create_component(star_graph(spark, sf_dir), new))


@registered("update_component", f" SELECT * REPLACE (CASE WHEN id = 'ent_' || md5('supplier:1') THEN 'Renamed' ELSE name END AS name, CASE WHEN id = 'ent_' || md5('supplier:1') THEN NULL ELSE scale END AS scale) FROM ({_FIELDS})")
def update_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields(mutate.update_component(star_graph(spark, sf_dir), _key(spark, "supplier", 1), {"name": "Renamed", "scale": None}))


@registered("reparent_component", f" SELECT * REPLACE (CASE WHEN id = 'ent_' || md5('nation:1') THEN 'ent_' || md5('region:4') ELSE parent END AS parent) FROM ({_FIELDS})")
def reparent_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields(mutate.reparent_component(star_graph(spark, sf_dir), _key(spark, "nation", 1), _key(spark, "region", 4)))


@registered("remove_component", f", p AS ({_FIELDS}) SELECT * FROM p WHERE id <> 'ent_' || md5('supplier:3')")
def remove_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier goes, once nothing refers to it: before that it is refused."""
    graph = star_graph(spark, sf_dir)
    own = _key(spark, "supplier", 3)
    if _code(lambda: mutate.remove_component(graph, own)) != "component-in-use":
        raise AssertionError("a component in use was removed")
    loose = graph.with_frames(relations=graph.relations.where(F.col("source") != own))
    return _fields(mutate.remove_component(loose, own))


@registered("change_relations", """, own AS (SELECT id FROM rel WHERE source = 'ent_' || md5('supplier:1') ORDER BY id LIMIT 3), gone AS (SELECT min(id) AS id FROM own), moved AS (SELECT max(id) AS id FROM own)
    SELECT rel.id, rel.type, source, CASE WHEN rel.id = moved.id THEN 'ent_' || md5('part:1') ELSE target END AS target FROM rel, gone, moved WHERE rel.id <> gone.id AND source = 'ent_' || md5('supplier:1')
    UNION ALL SELECT 'rel_' || md5('new'), 'informs', 'ent_' || md5('supplier:1'), 'ent_' || md5('part:2')""")
def change_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One relation of a supplier goes, one moves to another part, one is new."""
    graph, own = star_graph(spark, sf_dir, held=True), _key(spark, "supplier", 1)
    three = [r[0] for r in graph.relations.where(F.col("source") == own).select("id").orderBy("id").limit(3).collect()]
    new = spark.range(1).select(F.concat(F.lit("rel_"), F.md5(F.lit("new")))).first()[0]
    upserts = spark.createDataFrame([(three[-1], "supplies", _key(spark, "part", 1), None), (new, "informs", _key(spark, "part", 2), None)], "id string, type string, target string, description string")
    out = mutate.change_relations(graph, own, upserts, spark.createDataFrame([(three[0],)], "id string"))
    return out.relations.where(F.col("source") == own).select("id", "type", "source", "target")


@registered("mutation_batch", f""", k AS (SELECT id, replace(name, 'Supplier', 'Vendor') AS name FROM ent WHERE type = 'supplier'), p AS ({_FIELDS})
    SELECT p.id, coalesce(k.name, p.name) AS name, type, scale, shared, CASE WHEN parent = 'ent_' || md5('nation:6') THEN 'ent_' || md5('nation:7') ELSE parent END AS parent FROM p LEFT JOIN k ON k.id = p.id WHERE p.id <> 'ent_' || md5('nation:6')
    UNION ALL SELECT {_NEW}, 'New one', NULL, 'part', NULL, 'ent_' || md5('nation:7')""")
def mutation_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All suppliers renamed, one component created, one nation folded into another."""
    graph = star_graph(spark, sf_dir, held=True)
    renamed = graph.entities.where("type = 'supplier'").withColumn("name", F.replace(F.col("name"), F.lit("Supplier"), F.lit("Vendor"))).withColumn("op", F.lit("update"))
    gone = graph.entities.where(F.col("id") == _key(spark, "nation", 6)).withColumn("op", F.lit("remove"))
    new = graph.entities.where(F.col("id") == _key(spark, "supplier", 1)).select(
        F.lit(_key(spark, "component", "new")).alias("id"), "kind", F.lit("New one").alias("name"), "label", "summary", "intent", F.lit(None).cast("string").alias("type"), "scale", "shared",
        F.lit(_key(spark, "nation", 6)).alias("parent"), F.lit("create").alias("op"),
    )
    merged = spark.createDataFrame([(_key(spark, "nation", 6), _key(spark, "nation", 7))], ALIASES)
    none = graph.relations.where("false").withColumn("op", F.lit("update"))
    return _fields(mutate.apply_batch(graph, renamed.unionByName(gone).unionByName(new), none, merged))


@registered("mutation_refusals", """SELECT * FROM (VALUES ('create held id', 'duplicate-entity'), ('update parent', 'invalid-patch'), ('reparent below own member', 'containment-cycle'), ('coarse member', 'scale-coarser-than-parent'),
    ('merge with itself', 'invalid-merge'), ('remove a nation', 'component-in-use'), ('hijack a relation', 'relationship-id-hijack'), ('batch updates unknown', 'unknown-entity'), ('unknown id', 'unknown-entity')) t(request, code)""", graph=False)
def mutation_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = star_graph(spark, sf_dir, held=True)
    nation, region, one = _key(spark, "nation", 1), _key(spark, "region", 1), _key(spark, "supplier", 1)
    foreign = graph.relations.where(F.col("source") == _key(spark, "supplier", 2)).limit(1).select("id", "type", "target", "description")
    ghost = graph.entities.where(F.col("id") == nation).withColumn("id", F.lit("ent_x")).withColumn("op", F.lit("update"))
    none = graph.relations.where("false").withColumn("op", F.lit("update"))
    calls = {
        "create held id": lambda: mutate.create_component(graph, {"id": one, "name": "x"}),
        "update parent": lambda: mutate.update_component(graph, one, {"parent": None}),
        "reparent below own member": lambda: mutate.reparent_component(graph, region, nation),
        "coarse member": lambda: mutate.update_component(graph, one, {"scale": "system"}),
        "merge with itself": lambda: mutate.merge_component(graph, one, one),
        "remove a nation": lambda: mutate.remove_component(graph, nation),
        "hijack a relation": lambda: mutate.change_relations(graph, one, foreign, foreign.select("id").where("false")),
        "batch updates unknown": lambda: mutate.apply_batch(graph, ghost, none, graph.aliases),
        "unknown id": lambda: query.exact_entity(graph, "ent_x"),
    }
    # the ring of a region and its nation is reported by one of the two
    return spark.createDataFrame([(name, _code(call)) for name, call in calls.items()], "request string, code string")


@registered("transaction_outcomes", "SELECT * FROM (VALUES ('fine', 'committed', 2, 0), ('moved on', 'conflict', 1, 0), ('broken', 'rejected', 1, 5), ('refused', 'rejected', 1, 1), ('raced', 'retried', 3, 0)) t(name, outcome, generation, diagnostics)", graph=False)
def transaction_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes under optimistic control, with invariants of a user's own, and a write that another one was faster than."""
    graph = star_graph(spark, sf_dir)
    small = graph.with_frames(entities=graph.entities.where("type in ('region', 'nation')"), relations=graph.relations.where("false"))
    one = _key(spark, "nation", 1)
    rename = lambda g: mutate.update_component(g, one, {"name": "Renamed"})
    drop = lambda g: g.with_frames(entities=g.entities.where(F.col("id") != _key(spark, "region", 1)), generation=2)
    out = []
    for name, change, held in (("fine", rename, 1), ("moved on", rename, 0), ("broken", drop, 1), ("refused", lambda g: mutate.update_component(g, "ent_x", {"name": "x"}), 1)):
        outcome, after, found = mutate.transact(small, change, [lambda g: invariants.parent_problems(g.entities)], held)
        out.append((name, outcome, after.generation, len(found)))
    root, raced = _scratch(spark, "store"), []
    stores.write_generation(small, root)

    def change(g: GraphFrames) -> GraphFrames:
        if not raced:
            raced.append(stores.write_generation(g.with_frames(generation=g.generation + 1), root))
        return mutate.update_component(g, one, {"name": "Renamed"})

    mutate.with_retries(lambda: stores.read_generation(spark, root), change, lambda g: stores.write_generation(g, root))
    out.append(("raced", "retried", stores.current_generation(spark, root), 0))
    return spark.createDataFrame(out, "name string, outcome string, generation int, diagnostics int")


ORACLE_SQL["transaction_outcomes"] = """SELECT 'fine' AS name, 'committed' AS outcome, 2 AS generation, 0 AS diagnostics UNION ALL SELECT 'moved on', 'conflict', 1, 0
UNION ALL SELECT 'broken', 'rejected', 1, count(*)::INT FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'refused', 'rejected', 1, 1 UNION ALL SELECT 'raced', 'retried', 3, 0"""


@registered("new_workspace", f", p AS ({_FIELDS}) SELECT *, 1::BIGINT AS generation FROM p UNION ALL SELECT NULL, 'entities', NULL, NULL, NULL, NULL, 0")
def new_workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generation 0 is empty; one batch that creates the whole star graph makes generation 1."""
    root, star = _scratch(spark, "store"), star_graph(spark, sf_dir)
    stores.write_generation(empty_graph(spark), root)
    created = lambda df: df.withColumn("op", F.lit("create"))
    stores.write_generation(mutate.apply_batch(stores.read_generation(spark, root), created(star.entities), created(star.relations), star.aliases), root)
    back = stores.read_generation(spark, root)
    none = stores.read_generation(spark, root, 0).entities.agg(F.count(F.lit(1)).alias("generation"))
    first = _fields(back).withColumn("generation", F.lit(back.generation).cast("long"))
    return first.unionByName(none.select(F.lit("entities").alias("name"), "generation"), allowMissingColumns=True)


@registered("project_registry", "SELECT n_name AS id, CASE WHEN n_nationkey = 2 THEN '/moved' ELSE '/' || n_nationkey END AS root, CASE WHEN n_nationkey = 2 THEN 2 ELSE 1 END AS revision FROM nation WHERE n_nationkey < 4 AND n_nationkey <> 1", graph=False)
def project_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects added, one changed and one removed, each under its revision."""
    rows = table(spark, sf_dir, "nation").where("n_nationkey < 4").orderBy("n_nationkey").select("n_nationkey", "n_name").collect()
    projects = spark.createDataFrame([], "id string, root string, revision int")
    for r in rows:
        projects = stores.register_project(projects, {"id": r[1], "root": f"/{r[0]}"}, None)
    projects = stores.register_project(projects, {"id": rows[2][1], "root": "/moved"}, stores.find_project(projects, rows[2][1]).first()["revision"])
    return stores.list_projects(stores.remove_project(projects, rows[1][1], 1))
