"""Registered queries over the star graph, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import derive, hierarchy, invariants, levels, mutate, query, traverse
from ..plans.graph import GraphFrames
from ..sources.star import document_aliases, entity_id, star_graph, table

#: The mapped graph in SQL: entities as ent, relations as rel.
GRAPH_SQL = """
WITH RECURSIVE ent AS (
  SELECT 'ent_' || md5('region:' || r_regionkey) AS id, 'component' AS kind, r_name AS name, 'region' AS type,
    'system' AS scale, NULL::BOOLEAN AS shared, NULL::VARCHAR AS parent FROM region
  UNION ALL SELECT 'ent_' || md5('nation:' || n_nationkey), 'component', n_name, 'nation', 'domain', NULL,
    'ent_' || md5('region:' || n_regionkey) FROM nation
  UNION ALL SELECT 'ent_' || md5('customer:' || c_custkey), 'component', c_name, 'customer', 'part', NULL,
    'ent_' || md5('nation:' || c_nationkey) FROM customer
  UNION ALL SELECT 'ent_' || md5('supplier:' || s_suppkey), 'component', s_name, 'supplier', 'part', NULL,
    'ent_' || md5('nation:' || s_nationkey) FROM supplier
  UNION ALL SELECT 'ent_' || md5('part:' || p_partkey), 'component', p_name, 'part', NULL,
    CASE WHEN p_partkey % 7 = 0 THEN false WHEN n >= 2 THEN true END, NULL
    FROM part LEFT JOIN (SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey
  UNION ALL SELECT 'ent_' || md5('order:' || o_orderkey), 'component', o_orderkey::VARCHAR, 'order', 'element', NULL,
    'ent_' || md5('customer:' || o_custkey) FROM orders),
rel AS (
  SELECT 'rel_' || md5('supplies:' || s || ':' || t) AS id, 'supplies' AS type, 'ent_' || md5('supplier:' || s) AS source,
    'ent_' || md5('part:' || t) AS target FROM (SELECT DISTINCT l_suppkey AS s, l_partkey AS t FROM lineitem)
  UNION ALL SELECT 'rel_' || md5('placed:' || o_custkey || ':' || o_orderkey), 'placed', 'ent_' || md5('customer:' || o_custkey),
    'ent_' || md5('order:' || o_orderkey) FROM orders
  UNION ALL SELECT 'rel_' || md5('requires:' || s || ':' || t), 'requires', 'ent_' || md5('order:' || s),
    'ent_' || md5('part:' || t) FROM (SELECT DISTINCT l_orderkey AS s, l_partkey AS t FROM lineitem)),
searchable AS (SELECT *, lower(concat_ws(chr(10), id, kind, name, parent, scale, type)) AS text FROM ent),
step AS (
  SELECT id AS relation, type, source AS frm, target AS entity, 'outgoing' AS direction FROM rel
  UNION ALL SELECT id, type, target, source, 'incoming' FROM rel)
"""
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def registered(name: str, sql: str | None = None, graph: bool = True):
    """Register a query under a name; sql follows GRAPH_SQL's tables unless graph=False."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = (GRAPH_SQL if graph else "") + sql
        return f

    return add


def _key(spark: SparkSession, kind: str, key: int) -> str:
    return spark.range(1).select(entity_id(kind, F.lit(key))).first()[0]


def _joined(col) -> F.Column:
    return F.md5(F.array_join(col, ","))


@registered("entity_page_kind_payload", " SELECT id, name, type FROM ent WHERE kind = 'component' AND scale = 'part' ORDER BY id LIMIT 100")
def entity_page_kind_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = query.entities_where(star_graph(spark, sf_dir), "component", {"scale": "part"})
    return found.select("id", "name", "type").orderBy("id").limit(100)


@registered("entities_by_payload", " SELECT id, name, type FROM ent WHERE kind = 'component' AND scale IS NULL AND shared")
def entities_by_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.entities_where(star_graph(spark, sf_dir), "component", {"scale": None, "shared": True}).select("id", "name", "type")


@registered("catalog_page_after", " SELECT id, kind, md5(text) AS text FROM searchable WHERE id > 'ent_8' ORDER BY id LIMIT 100")
def catalog_page_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = star_graph(spark, sf_dir).catalog().where("id > 'ent_8'").orderBy("id").limit(100)
    return page.select("id", "kind", F.md5("searchable").alias("text"))


@registered("list_roots", " SELECT id, name, scale, shared FROM ent WHERE parent IS NULL")
def list_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.list_roots(star_graph(spark, sf_dir)).select("id", "name", "scale", "shared")


@registered("list_children", " SELECT id, name, type FROM ent WHERE parent = 'ent_' || md5('nation:3')")
def list_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.list_children(star_graph(spark, sf_dir), _key(spark, "nation", 3)).select("id", "name", "type")


@registered("list_shared_false", " SELECT id, shared FROM ent WHERE coalesce(shared, false) = false")
def list_shared_false(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.list_components(star_graph(spark, sf_dir), shared=False).select("id", "shared")


@registered("search_and_terms", " SELECT id, name FROM searchable WHERE contains(text, '0001') AND contains(text, 'customer') AND contains(text, 'part')")
def search_and_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.search_entities(star_graph(spark, sf_dir), "PART  ｃｕｓｔｏｍｅｒ 0001 part").select("id", "name")


@registered("search_payload_shared_exact", " SELECT id, name, shared FROM searchable WHERE contains(text, 'component') AND shared = false")
def search_payload_shared_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.search_entities(star_graph(spark, sf_dir), "component", "component", {"shared": False}).select("id", "name", "shared")


@registered(
    "search_evidence_bound",
    """ SELECT id, name, id IN (SELECT 'ent_' || md5('supplier:' || s_suppkey) FROM supplier WHERE s_acctbal > 0) AS evidence_bound
    FROM searchable WHERE contains(text, 'supplier') AND scale = 'part'""",
)
def search_evidence_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound = table(spark, sf_dir, "supplier").select(entity_id("supplier", F.col("s_suppkey")).alias("component_id"), (F.col("s_acctbal") > 0).alias("present"))
    return query.search_blueprint(star_graph(spark, sf_dir), bound, "supplier", scale="part").select("id", "name", "evidence_bound")


@registered(
    "static_phrase_search",
    """ SELECT id, name FROM ent WHERE contains(lower(id), '00012') OR contains(lower(name), '00012')
    OR contains(lower(coalesce(scale, '')), '00012') OR contains(lower(type), '00012')""",
)
def static_phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.phrase_search(star_graph(spark, sf_dir).entities, " 00012 ").select("id", "name")


@registered("static_page_offset", " SELECT id, name FROM ent WHERE parent IS NULL ORDER BY id OFFSET 25 LIMIT 50")
def static_page_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.offset_page(query.list_roots(star_graph(spark, sf_dir)), "id", 25, 50).select("id", "name")


@registered(
    "exact_batch_alias",
    """SELECT 'ent_' || md5('document:' || doc_id) AS requested,
    'ent_' || md5('document:' || min(doc_id) OVER (PARTITION BY coalesce(text, ''))) AS id FROM documents""",
    graph=False,
)
def exact_batch_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    live, aliases = document_aliases(spark, sf_dir)
    graph = GraphFrames(live, star_graph(spark, sf_dir, types=("placed",)).relations, aliases)
    asked = table(spark, sf_dir, "documents").select(entity_id("document", F.col("doc_id")).alias("requested"))
    return query.resolve_ids(graph, asked)


@registered(
    "incident_edges_both",
    """ SELECT relation, step.type, direction, frm AS "from", entity, ent.name AS entity_name
    FROM step JOIN ent ON ent.id = entity WHERE frm = 'ent_' || md5('supplier:1')""",
)
def incident_edges_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.incident_relations(star_graph(spark, sf_dir), _key(spark, "supplier", 1), "both")


def _walk_sql(kind: str, key: int, depth: int, directions: str, types: str | None = None) -> str:
    only = f" AND type IN ({types})" if types else ""
    return f""", own AS (SELECT * FROM step WHERE direction IN ({directions}){only}),
    walk AS (SELECT 'ent_' || md5('{kind}:{key}') AS entity, 0 AS d
      UNION SELECT own.entity, d + 1 FROM walk JOIN own ON own.frm = walk.entity WHERE d + 1 < {depth}),
    near AS (SELECT entity, min(d) AS d FROM walk GROUP BY 1),
    hit AS (SELECT d + 1 AS depth, relation, type, direction, frm AS "from", own.entity,
      row_number() OVER (PARTITION BY relation ORDER BY d, frm, direction) AS k FROM own JOIN near ON near.entity = frm)
    SELECT depth, relation, type, direction, "from", entity FROM hit WHERE k = 1"""


@registered("traverse_outgoing", _walk_sql("customer", 1, 2, "'outgoing'"))
def traverse_outgoing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.traverse(star_graph(spark, sf_dir), _key(spark, "customer", 1), 2, "outgoing")


@registered("traverse_incoming", _walk_sql("part", 1, 2, "'incoming'"))
def traverse_incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.traverse(star_graph(spark, sf_dir), _key(spark, "part", 1), 2, "incoming")


@registered("traverse_both", _walk_sql("supplier", 1, 2, "'incoming', 'outgoing'"))
def traverse_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.traverse(star_graph(spark, sf_dir), _key(spark, "supplier", 1), 2, "both")


@registered("traverse_typed", _walk_sql("customer", 2, 3, "'incoming', 'outgoing'", "'placed'"))
def traverse_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.traverse(star_graph(spark, sf_dir), _key(spark, "customer", 2), 3, "both", "placed")


@registered(
    "containment_depth",
    """, down AS (SELECT id, 0::BIGINT AS depth, id AS root FROM ent WHERE parent IS NULL
      UNION ALL SELECT ent.id, depth + 1, root FROM ent JOIN down ON ent.parent = down.id)
    SELECT id, depth, root FROM down""",
)
def containment_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.containment_depth(star_graph(spark, sf_dir).entities.select("id", "parent"))


@registered(
    "descendant_closure",
    """, down AS (SELECT id, 0 AS distance FROM ent WHERE id = 'ent_' || md5('region:0')
      UNION ALL SELECT ent.id, distance + 1 FROM ent JOIN down ON ent.parent = down.id)
    SELECT id, distance FROM down""",
)
def descendant_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.descendants(star_graph(spark, sf_dir).entities, _key(spark, "region", 0))


@registered(
    "ancestors",
    """, up AS (SELECT id, parent AS ancestor, 1 AS distance FROM ent WHERE parent IS NOT NULL
      UNION ALL SELECT up.id, ent.parent, distance + 1 FROM up JOIN ent ON ent.id = ancestor WHERE ent.parent IS NOT NULL)
    SELECT id, ancestor, distance FROM up""",
)
def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.ancestors(star_graph(spark, sf_dir).entities.select("id", "parent"))


@registered(
    "export_page_outgoing",
    """, page AS (SELECT id, name FROM ent ORDER BY id LIMIT 100)
    SELECT page.id, page.name, count(rel.id) AS n, md5(coalesce(string_agg(rel.id, ',' ORDER BY rel.id), '')) AS digest
    FROM page LEFT JOIN rel ON rel.source = page.id GROUP BY 1, 2""",
)
def export_page_outgoing(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = star_graph(spark, sf_dir)
    page = query.list_components(graph).orderBy("id").limit(100)
    out = query.export_blueprint(graph, page_of=page)
    ids = F.transform("relations", lambda r: r["relation"])
    return out.select("id", "name", F.size("relations").cast("long").alias("n"), _joined(ids).alias("digest"))


@registered(
    "export_all_outgoing",
    """ SELECT ent.id, count(rel.id) AS n, md5(coalesce(string_agg(rel.id, ',' ORDER BY rel.id), '')) AS digest
    FROM ent LEFT JOIN rel ON rel.source = ent.id GROUP BY 1""",
)
def export_all_outgoing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.transform("relations", lambda r: r["relation"])
    return query.export_blueprint(star_graph(spark, sf_dir)).select("id", F.size("relations").cast("long").alias("n"), _joined(ids).alias("digest"))


@registered(
    "adjacency_degree",
    """, i AS (SELECT target AS id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS s FROM rel GROUP BY 1),
    o AS (SELECT source AS id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS s FROM rel GROUP BY 1)
    SELECT ent.id, coalesce(i.n, 0) AS n_in, coalesce(o.n, 0) AS n_out, md5(coalesce(i.s, '')) AS incoming, md5(coalesce(o.s, '')) AS outgoing
    FROM ent LEFT JOIN i ON i.id = ent.id LEFT JOIN o ON o.id = ent.id""",
)
def adjacency_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = lambda c: F.size(c).cast("long")
    return star_graph(spark, sf_dir).adjacency().select(
        "id", size("incoming").alias("n_in"), size("outgoing").alias("n_out"), _joined(F.col("incoming")).alias("incoming"), _joined(F.col("outgoing")).alias("outgoing")
    )


@registered("incident_count", " SELECT id, count(*) AS n FROM (SELECT source AS id FROM rel UNION ALL SELECT target FROM rel) GROUP BY 1")
def incident_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.incident_counts(star_graph(spark, sf_dir).relations)


@registered("child_counts", " SELECT parent AS id, count(*) AS n FROM ent WHERE parent IS NOT NULL GROUP BY 1")
def child_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.child_counts(star_graph(spark, sf_dir).entities)


@registered("graph_counts", " SELECT (SELECT count(*) FROM ent) AS entities, (SELECT count(*) FROM rel) AS relations, 0::BIGINT AS aliases")
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_graph(spark, sf_dir).counts()


@registered(
    "fingerprint",
    """, t AS (
      SELECT 'entities' AS part, sha256(concat_ws(chr(31), '=' || id, '-', '=' || kind, '-', coalesce('=' || name, '-'), coalesce('=' || parent, '-'),
        coalesce('=' || scale, '-'), coalesce('=' || shared::VARCHAR, '-'), '-', '=' || type)) AS h FROM ent
      UNION ALL SELECT 'relations', sha256(concat_ws(chr(31), '-', '=' || id, '=' || source, '=' || target, '=' || type)) FROM rel),
    w AS (SELECT part, ('0x' || substr(h, 1, 8))::BIGINT AS a, ('0x' || substr(h, 9, 8))::BIGINT AS b,
      ('0x' || substr(h, 17, 8))::BIGINT AS c, ('0x' || substr(h, 25, 8))::BIGINT AS d FROM t)
    SELECT part, count(*) AS n, concat_ws(':', sum(a)::VARCHAR, sum(b)::VARCHAR, sum(c)::VARCHAR, sum(d)::VARCHAR) AS digest FROM w GROUP BY 1
    UNION ALL SELECT 'aliases', 0, '0:0:0:0'""",
)
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_graph(spark, sf_dir).fingerprint_rows()


@registered("relation_labels", " SELECT id, CASE WHEN type = 'requires' THEN 'needs' ELSE type END AS label FROM rel")
def relation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.relations_view(star_graph(spark, sf_dir)).select("id", "label")


@registered(
    "display_fields",
    """ SELECT id, name AS text, CASE scale WHEN 'system' THEN 'domains' WHEN 'domain' THEN 'parts' WHEN 'part' THEN 'elements'
    WHEN 'element' THEN 'nested elements' ELSE 'children' END AS below,
    CASE scale WHEN 'system' THEN 0 WHEN 'domain' THEN 1 WHEN 'part' THEN 2 WHEN 'element' THEN 3 END AS rank FROM ent""",
)
def display_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return star_graph(spark, sf_dir).entities.select(
        "id", S.display_text(c("label"), c("name"), c("id")).alias("text"), S.next_scale_label(c("scale")).alias("below"), S.scale_rank(c("scale")).cast("int").alias("rank")
    )


def _injected(spark: SparkSession, sf_dir: str) -> GraphFrames:
    """The star graph with errors: customers doubled, suppliers gone, customers as systems under domains."""
    graph = star_graph(spark, sf_dir)
    hit = lambda d: F.conv(F.substring("id", 5, 4), 16, 10).cast("long") % d == 0
    customers = graph.entities.where("type = 'customer'")
    kept = graph.entities.where(~((F.col("type") == "supplier") & hit(5)))
    kept = kept.withColumn("scale", F.when((F.col("type") == "customer") & hit(11), "system").otherwise(F.col("scale")))
    return graph.with_frames(entities=kept.unionByName(customers.where(hit(13)).withColumn("scale", F.lit("part"))))


_HIT = "(('0x' || substr(id, 5, 4))::BIGINT % {d} = 0)"
_BROKEN = f""", bad AS (
    SELECT * REPLACE (CASE WHEN type = 'customer' AND {_HIT.format(d=11)} THEN 'system' ELSE scale END AS scale) FROM ent
      WHERE NOT (type = 'supplier' AND {_HIT.format(d=5)})
    UNION ALL SELECT * FROM ent WHERE type = 'customer' AND {_HIT.format(d=13)})"""


@registered("duplicate_identities", _BROKEN + " SELECT id, count(*) AS n FROM bad GROUP BY 1 HAVING count(*) > 1")
def duplicate_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invariants.duplicate_ids(_injected(spark, sf_dir).entities)


@registered(
    "dangling_endpoints",
    _BROKEN + """ SELECT id AS relation, role, endpoint FROM (SELECT id, 'source' AS role, source AS endpoint FROM rel UNION ALL SELECT id, 'target', target FROM rel)
    WHERE endpoint NOT IN (SELECT id FROM bad)""",
)
def dangling_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invariants.dangling_endpoints(_injected(spark, sf_dir))


@registered(
    "scale_violations",
    _BROKEN + """ SELECT bad.id, bad.parent, bad.scale, ent.scale AS parent_scale FROM bad JOIN ent ON ent.id = bad.parent
    WHERE bad.type = 'customer' AND bad.scale = 'system'""",
)
def scale_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.scale_violations(_injected(spark, sf_dir).entities)


@registered(
    "containment_cycles",
    """SELECT c AS id FROM (SELECT c_custkey AS c, CASE WHEN c_custkey % 9 < 3 THEN c_custkey - c_custkey % 9 + (c_custkey % 9 + 1) % 3
      ELSE c_custkey - 3 END AS p FROM customer) t
    WHERE c % 9 < 3 AND (SELECT count(*) FROM customer WHERE c_custkey BETWEEN c - c % 9 AND c - c % 9 + 2) = 3""",
    graph=False,
)
def containment_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in nines: the first three form a ring, the others hang below it."""
    k = F.col("c_custkey")
    parent = F.when(k % 9 < 3, k - k % 9 + (k % 9 + 1) % 3).otherwise(k - 3)
    return hierarchy.containment_cycles(table(spark, sf_dir, "customer").select(k.alias("id"), parent.alias("parent")))


@registered(
    "remove_blockers",
    """ SELECT id, 'children' AS blocker, count(*) AS n FROM (SELECT parent AS id FROM ent WHERE parent IN (SELECT id FROM ent WHERE type = 'customer')) GROUP BY 1
    UNION ALL SELECT source, 'relations', count(*) FROM rel WHERE type = 'placed' GROUP BY 1""",
)
def remove_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = star_graph(spark, sf_dir)
    return invariants.removal_blockers(graph, graph.entities.where("type = 'customer'").select("id"))


@registered(
    "rename_dependents",
    """, t AS (SELECT id FROM ent WHERE type = 'nation' OR type = 'order' AND ends_with(name, '7'))
    SELECT id FROM ent WHERE parent IN (SELECT id FROM t) UNION SELECT source FROM rel WHERE target IN (SELECT id FROM t)""",
)
def rename_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = star_graph(spark, sf_dir)
    renamed = graph.entities.where("type = 'nation' OR type = 'order' AND endswith(name, '7')")
    return invariants.rename_dependents(renamed, graph.entities, graph.relations)


@registered(
    "merge_component",
    """, m AS (SELECT 'ent_' || md5('supplier:1') AS old, 'ent_' || md5('supplier:2') AS new)
    SELECT id, new AS source, target FROM rel, m WHERE source IN (old, new)""",
)
def merge_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    survivor = _key(spark, "supplier", 2)
    merged = mutate.merge_component(star_graph(spark, sf_dir), _key(spark, "supplier", 1), survivor)
    return merged.relations.where(F.col("source") == survivor).select("id", "source", "target")


@registered(
    "retirement_fixpoint",
    """, c AS (SELECT id, parent, type FROM ent WHERE type = 'order' AND ends_with(name, '1') OR type IN ('customer', 'nation')),
    held AS (SELECT DISTINCT unnest([source, target]) AS id FROM rel WHERE type <> 'placed' OR NOT (('0x' || substr(id, 5, 4))::BIGINT % 2 = 0)),
    o AS (SELECT id FROM c WHERE type = 'order' AND id NOT IN (SELECT id FROM held)),
    k AS (SELECT id FROM c WHERE type = 'customer' AND id NOT IN (SELECT id FROM held)
      AND id NOT IN (SELECT parent FROM ent WHERE type = 'order' AND id NOT IN (SELECT id FROM o))),
    n AS (SELECT id FROM c WHERE type = 'nation' AND id NOT IN (SELECT parent FROM ent WHERE parent IS NOT NULL
      AND id NOT IN (SELECT id FROM k)) AND id NOT IN (SELECT id FROM held)),
    gone AS (SELECT id FROM o UNION ALL SELECT id FROM k UNION ALL SELECT id FROM n)
    SELECT id FROM gone""",
)
def retirement_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = star_graph(spark, sf_dir)
    wanted = graph.entities.where("type = 'order' AND endswith(name, '1') OR type IN ('customer', 'nation')").select("id")
    removable = graph.relations.where((F.col("type") == "placed") & (F.conv(F.substring("id", 5, 4), 16, 10).cast("long") % 2 == 0)).select("id")
    return hierarchy.retire(wanted, graph.entities, graph.relations, removable).select("id")


@registered(
    "topological_order",
    """, up AS (SELECT id, 0 AS stage FROM ent WHERE parent IS NULL
      UNION ALL SELECT ent.id, stage + 1 FROM ent JOIN up ON ent.parent = up.id)
    SELECT id, stage FROM up""",
)
def topological_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = star_graph(spark, sf_dir).entities
    return hierarchy.topological_order(own.select("id"), own.where("parent is not null").select("id", F.col("parent").alias("on")))


@registered(
    "overview_walk",
    """, r AS (SELECT id, parent, row_number() OVER (PARTITION BY parent ORDER BY id) AS k FROM ent),
    w AS (SELECT id, parent, lpad(k::VARCHAR, 6, '0') AS path, 1 AS depth FROM r WHERE parent IS NULL AND k <= 10
      UNION ALL SELECT r.id, r.parent, path || '/' || lpad(k::VARCHAR, 6, '0'), depth + 1 FROM r JOIN w ON r.parent = w.id WHERE k <= 10 AND depth < 4),
    n AS (SELECT parent AS id, count(*) AS n FROM ent WHERE parent IS NOT NULL GROUP BY 1)
    SELECT row_number() OVER (ORDER BY path)::INT AS position, depth, w.id, w.parent,
      CASE WHEN depth = 4 AND n.n > 0 THEN 'depth' WHEN n.n > 10 THEN 'children' END AS truncated
    FROM w LEFT JOIN n ON n.id = w.id ORDER BY path LIMIT 50""",
)
def overview_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.overview(star_graph(spark, sf_dir).entities)


@registered(
    "level_index_buckets",
    """, m AS (SELECT coalesce(parent, 'top') AS scope, id, name AS text, row_number() OVER (PARTITION BY parent ORDER BY name, id) - 1 AS pos,
      count(*) OVER (PARTITION BY parent) AS n FROM ent),
    b AS (SELECT scope, text, '' AS lineage, pos, n, 0::BIGINT AS size FROM m
      UNION ALL SELECT scope, text, CASE WHEN lineage = '' THEN '' ELSE lineage || '.' END || (pos // s)::VARCHAR, pos % s, least(s, n - pos // s * s), s
      FROM (SELECT *, greatest(20, ceil(n / 20.0))::BIGINT AS s FROM b WHERE n > 20)),
    g AS (SELECT scope, lineage, count(*) AS n, arg_min(text, pos) AS a, arg_max(text, pos) AS z FROM b WHERE lineage <> '' GROUP BY 1, 2)
    SELECT scope, lineage, n, a AS first, z AS last, CASE WHEN a = z THEN a || ' (' || n || ')' ELSE a || ' – ' || z END AS label FROM g""",
)
def level_index_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.index_buckets(levels.ordered_members(star_graph(spark, sf_dir).entities, F.coalesce("parent", F.lit("top"))))


@registered(
    "visible_relationships",
    """, v AS (SELECT id, CASE WHEN type = 'part' THEN 'parts' ELSE parent END AS box FROM ent WHERE type IN ('customer', 'supplier', 'part')),
    e AS (SELECT 'rel_' || md5(l_orderkey || '-' || l_linenumber) AS id, 'ent_' || md5('part:' || l_partkey) AS source,
      'ent_' || md5('part:' || (l_partkey * 3 % 200 + 1)) AS target FROM lineitem)
    SELECT source, target, min(e.id) AS id, 'uses' AS type FROM e JOIN v a ON a.id = source JOIN v b ON b.id = target
    WHERE source <> target AND a.box = b.box GROUP BY 1, 2""",
)
def visible_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = star_graph(spark, sf_dir, orders=False).entities.where("type IN ('customer', 'supplier', 'part')")
    visible = own.select("id", F.when(F.col("type") == "part", "parts").otherwise(F.col("parent")).alias("parent"))
    lines = table(spark, sf_dir, "lineitem")
    uses = lines.select(
        F.concat(F.lit("rel_"), F.md5(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))).alias("id"), F.lit("uses").alias("type"),
        entity_id("part", F.col("l_partkey")).alias("source"), entity_id("part", F.col("l_partkey") * 3 % 200 + 1).alias("target"),
    )
    return levels.visible_relations(uses, visible).select("source", "target", "id", "type")


@registered(
    "level_totals",
    """ SELECT parent AS scope, count(*) AS total, least(count(*), 20) AS visible, greatest(0, count(*) - 20) AS omitted
    FROM ent WHERE parent IS NOT NULL GROUP BY 1""",
)
def level_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.level_totals(levels.ordered_members(star_graph(spark, sf_dir).entities, F.col("parent")))
