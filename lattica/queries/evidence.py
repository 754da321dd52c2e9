"""Registered queries on observation, evidence and reconciliation, each with the SQL that says the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.summary import best_documentation, summary_of
from ..operators import derive, observe, reconcile
from ..plans.lineage import ensure_checkpoint_dir
from ..sources.star import entity_id, table
from ..streaming import sessions
from .graph import ORACLE_SQL, QUERIES, registered


@registered("reuse_breadth", "SELECT l_partkey AS target, count(DISTINCT l_suppkey) AS reuse_breadth FROM lineitem WHERE l_suppkey <> l_partkey GROUP BY 1", graph=False)
def reuse_breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.reuse_breadth(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target")))


@registered("file_count", "SELECT c_nationkey AS boundary, count(*) AS file_count FROM customer GROUP BY 1", graph=False)
def file_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.file_counts(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("boundary"), F.col("c_name").alias("file")))


@registered(
    "structural_signals",
    """SELECT n_nationkey AS id, coalesce(c.n, 0) AS file_count, coalesce(s.n, 0) AS reuse_breadth, n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900) AS entry_point,
    n_regionkey = 1 AS declared_boundary FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) c ON c_nationkey = n_nationkey
    LEFT JOIN (SELECT s_nationkey, count(DISTINCT s_suppkey) AS n FROM supplier WHERE s_suppkey <> s_nationkey GROUP BY 1) s ON s_nationkey = n_nationkey""",
    graph=False,
)
def structural_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, customer, supplier = (table(spark, sf_dir, n) for n in ("nation", "customer", "supplier"))
    return derive.signals(
        nation.select(F.col("n_nationkey").alias("id")), customer.select(F.col("c_nationkey").alias("boundary")),
        supplier.select(F.col("s_suppkey").alias("source"), F.col("s_nationkey").alias("target")),
        customer.where("c_acctbal > 9900").select(F.col("c_nationkey").alias("id")), nation.where("n_regionkey = 1").select(F.col("n_nationkey").alias("id")),
    )


_SIGNALS_SQL = """
WITH s AS (SELECT c_custkey AS id, count(DISTINCT o_orderkey) AS export_count, count(*) AS file_count, count(DISTINCT o_orderstatus || o_orderpriority) AS reuse_breadth
  FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1
  UNION ALL SELECT c_custkey, NULL, NULL, NULL FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey)),
v AS (SELECT *, CASE WHEN export_count IS NULL THEN NULL WHEN export_count >= 160 THEN 0 WHEN export_count >= 40 THEN 1 WHEN export_count >= 8 THEN 2 ELSE 3 END AS a,
  CASE WHEN file_count IS NULL THEN NULL WHEN file_count >= 160 THEN 0 WHEN file_count >= 40 THEN 1 WHEN file_count >= 8 THEN 2 ELSE 3 END AS b,
  CASE WHEN reuse_breadth IS NULL THEN NULL WHEN reuse_breadth >= 24 THEN 0 WHEN reuse_breadth >= 8 THEN 1 WHEN reuse_breadth >= 2 THEN 2 ELSE 3 END AS c FROM s),
p AS (SELECT *, list_sort(list_distinct([a, b, c])) AS r, ['system', 'domain', 'part', 'element'] AS names FROM v)
"""


def _customer_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")
    met = table(spark, sf_dir, "customer").select("c_custkey").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    measured = F.count("o_orderkey") > 0  # of a customer without orders nothing is known
    return met.groupBy(F.col("c_custkey").alias("id")).agg(*[F.when(measured, c).alias(n) for c, n in (
        (F.countDistinct("o_orderkey"), "export_count"), (F.count(F.lit(1)), "file_count"),
        (F.countDistinct(F.concat("o_orderstatus", "o_orderpriority")), "reuse_breadth"),
    )])


@registered(
    "scale_proposal",
    _SIGNALS_SQL + """SELECT id, CASE WHEN len(r) = 0 THEN 'insufficient' WHEN len(r) = 1 THEN 'proposed' ELSE 'ambiguous' END AS status, CASE WHEN len(r) = 1 THEN names[r[1] + 1] END AS proposal,
    CASE WHEN len(r) > 1 THEN array_to_string(list_transform(r, lambda x: names[x + 1]), ',') ELSE '' END AS candidates FROM p""",
    graph=False,
)
def scale_proposal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.with_scale_proposal(_customer_signals(spark, sf_dir)).select("id", "status", "proposal", "candidates")


@registered(
    "scale_drift",
    _SIGNALS_SQL + "SELECT id, CASE WHEN len(r) = 1 THEN CASE WHEN r[1] = 2 THEN 'aligned' ELSE 'drift' END END AS drift, reuse_breadth >= 2 AS shared FROM p",
    graph=False,
)
def scale_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = derive.with_scale_proposal(_customer_signals(spark, sf_dir))
    drift = derive.scale_drift(F.lit("part"), F.col("status"), F.col("proposal"))
    return out.select("id", drift.alias("drift"), derive.shared_flag(F.col("reuse_breadth")).alias("shared"))


def _measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("component"), F.lit("star").alias("project"), F.col("l_returnflag").alias("scanner"), F.col("l_linestatus").alias("instance"),
        F.lit("1").alias("version"), F.col("l_linenumber").cast("double").alias("value"),
    )


_SINGLE = """SELECT l_orderkey AS component, 'star' AS project, l_returnflag AS scanner, l_linestatus AS instance, '1' AS version, min(l_linenumber)::DOUBLE AS value
  FROM lineitem GROUP BY 1, 3, 4 HAVING min(l_linenumber) = max(l_linenumber)"""


@registered("measurement_single_value", _SINGLE, graph=False)
def measurement_single_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.single_measurements(_measurements(spark, sf_dir))


@registered(
    "comparable_measurements",
    f"""WITH s AS ({_SINGLE}), b AS (SELECT scanner, instance FROM s GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY count(*) DESC, scanner, instance LIMIT 1)
    SELECT component, value FROM s JOIN b USING (scanner, instance)""",
    graph=False,
)
def comparable_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.comparable_measurements(_measurements(spark, sf_dir))


_PATH = "regexp_extract(regexp_replace(url, '^[a-z]+://', ''), '^[^?#]*')"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    resource = F.regexp_extract(F.regexp_replace("url", "^[a-z]+://", ""), "^[^?#]*", 0)
    return table(spark, sf_dir, "pages").select("page_id", resource.alias("resource"), F.substring_index(resource, "/", 1).alias("host"))


@registered(
    "observed_paths",
    f"""WITH p AS (SELECT DISTINCT split_part({_PATH}, '/', 1) AS component, {_PATH} AS r FROM pages)
    SELECT component, count(*) AS n, md5(string_agg(r, ',' ORDER BY r)) AS digest FROM p GROUP BY 1""",
    graph=False,
)
def observed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _paths(spark, sf_dir)
    bindings = pages.select(F.lit("web").alias("scope"), F.col("page_id").alias("key"), F.col("host").alias("component_id"))
    provenance = pages.select(F.lit("web").alias("scope"), F.col("page_id").alias("key"), F.lit("w").alias("project"), F.lit("c").alias("scanner"), "resource")
    found = derive.observed_paths(bindings, provenance)
    return found.select("component", F.size("paths").cast("long").alias("n"), F.md5(F.array_join(F.transform("paths", lambda p: p["resource"]), ",")).alias("digest"))


@registered(
    "evidence_views",
    """SELECT source AS component, lang AS scope, count(*) AS n, CASE WHEN lang = 'en' THEN 'partial' WHEN lang = 'fr' THEN 'complete' END AS state
    FROM documents GROUP BY 1, 2""",
    graph=False,
)
def evidence_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("scope"), F.col("doc_id").alias("key"), F.col("source").alias("component_id"))
    coverage = spark.createDataFrame([("en", "partial"), ("fr", "complete")], "scope string, state string")
    views = derive.evidence_views(docs, docs.select("scope", "key", F.col("key").alias("record_key")), coverage)
    return views.select("component", "scope", F.size("records").cast("long").alias("n"), "state")


@registered(
    "import_edges",
    """WITH i AS (SELECT l_suppkey AS source, l_partkey % 50 AS target, l_orderkey AS resource, l_linenumber AS start FROM lineitem),
    k AS (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY resource, start) AS k FROM i)
    SELECT source, target, count(*) AS n, md5(string_agg(resource || '-' || start, ',' ORDER BY resource, start) FILTER (WHERE k <= 32)) AS digest FROM k GROUP BY 1, 2""",
    graph=False,
)
def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), (F.col("l_partkey") % 50).alias("target"), F.col("l_orderkey").alias("resource"), F.col("l_linenumber").alias("start"))
    text = F.transform("provenance", lambda p: F.concat_ws("-", p["resource"].cast("string"), p["start"].cast("string")))
    return derive.import_edges(lines, most_pairs=None).select("source", "target", "n", F.md5(F.array_join(text, ",")).alias("digest"))


@registered(
    "first_records",
    """WITH r AS (SELECT source AS scope, doc_id % 40 AS key, lang AS kind, md5(text) AS content FROM documents)
    SELECT scope, key, min(kind) AS kind, count(*) > 1 AS partial FROM r GROUP BY 1, 2""",
    graph=False,
)
def first_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("scope"), (F.col("doc_id") % 40).alias("key"), F.col("lang").alias("kind"), F.md5("text").alias("content"))
    return derive.first_records(docs).select("scope", "key", "kind", "partial")


@registered(
    "sample_files",
    """SELECT boundary, file, turn FROM (SELECT c_nationkey AS boundary, c_name AS file, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name)::INT AS turn FROM customer)
    ORDER BY turn, boundary LIMIT 256""",
    graph=False,
)
def sample_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.sample_files(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("boundary"), F.col("c_name").alias("file")))


@registered(
    "locator_checks",
    f"""SELECT page_id, {_PATH} <> '' AND NOT list_has_any(string_split({_PATH}, '/'), ['', '.', '..']) AND NOT contains({_PATH}, chr(92)) AS valid,
    len(string_split({_PATH}, '/')) AS depth, len(html) - len(replace(html, chr(10), '')) + 1 AS lines FROM pages WHERE html <> ''""",
    graph=False,
)
def locator_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _paths(spark, sf_dir).join(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id").where("html <> ''")
    depth = S.nearest_depth(F.array("resource")).cast("long")
    return pages.select("page_id", S.locator_valid(F.col("resource")).alias("valid"), depth.alias("depth"), S.source_lines(F.col("html")).cast("long").alias("lines"))


@registered(
    "text_limits",
    """SELECT doc_id, coalesce(length(t) <= 80 AND length(t) > 0 AND trim(t) = t AND NOT regexp_matches(t, '[[:cntrl:]]'), false) AS label,
    coalesce(regexp_full_match(source, '[a-z][a-z0-9]*([.-][a-z0-9]+)*'), false) AS kind FROM (SELECT doc_id, source, text AS t FROM documents)""",
    graph=False,
)
def text_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", S.label_valid(F.col("text")).alias("label"), S.kind_valid(F.col("source")).alias("kind"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records of two batches, every third sent again, every tenth of those changed."""
    docs = table(spark, sf_dir, "documents").select(
        (F.col("doc_id") % 4).alias("batch"), F.col("source").alias("scope"), F.col("doc_id").alias("key"), F.lit("documentation").alias("kind"), F.col("text").alias("body")
    )
    again = docs.where("key % 3 = 0").withColumn("body", F.when(F.col("key") % 10 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    return docs.unionByName(again.withColumn("batch", F.lit(4).cast("long")))


_RECORDS = """WITH d AS (SELECT doc_id % 4 AS batch, source AS scope, doc_id AS key, text AS body FROM documents),
r AS (SELECT * FROM d UNION ALL SELECT 4, scope, key, CASE WHEN key % 10 = 0 THEN body || '!' ELSE body END FROM d WHERE key % 3 = 0)
"""


@registered("session_dedupe", _RECORDS + "SELECT DISTINCT scope, key, md5(body) AS body FROM r", graph=False)
def session_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.accepted_records(_records(spark, sf_dir)).select("scope", "key", F.md5("body").alias("body"))


@registered("contradictory_keys", _RECORDS + "SELECT scope, key, count(DISTINCT body) AS versions FROM r GROUP BY 1, 2 HAVING count(DISTINCT body) > 1", graph=False)
def contradictory_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.contradictions(_records(spark, sf_dir))


@registered(
    "batch_receipts",
    _RECORDS + """, k AS (SELECT *, row_number() OVER (PARTITION BY scope, key, body ORDER BY batch) AS k FROM r),
    b AS (SELECT batch, count(*) FILTER (WHERE k = 1) AS accepted, count(*) FILTER (WHERE k > 1) AS replayed FROM k GROUP BY 1)
    SELECT *, sum(accepted) OVER (ORDER BY batch)::BIGINT AS total FROM b""",
    graph=False,
)
def batch_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.batch_receipts(_records(spark, sf_dir))


@registered(
    "coverage_absence",
    """SELECT source AS scope, doc_id AS key FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND right(source, 1) IN ('0', '2', '4', '6', '8')""",
    graph=False,
)
def coverage_absence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("scope"), F.col("doc_id").alias("key"), F.lit("documentation").alias("kind"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key")).distinct()
    even = F.right(F.col("scope"), F.lit(1)).isin("0", "2", "4", "6", "8")
    coverage = docs.select("scope").distinct().select("scope", F.array(F.lit("documentation")).alias("kinds"), F.when(even, "complete").otherwise("partial").alias("state"))
    return observe.absent_keys(docs, docs.join(labels, "key"), observe.complete_kinds(coverage)).select("scope", "key")


@registered(
    "coverage_problems",
    """WITH d AS (SELECT DISTINCT source FROM documents)
    SELECT source AS scope, 'uncovered-scope' AS problem FROM d WHERE right(source, 1) IN ('1', '3', '5', '7', '9')
    UNION ALL SELECT source, 'duplicate-coverage' FROM d WHERE right(source, 1) = '4'
    UNION ALL SELECT 'old-' || source, 'undeclared-scope' FROM d WHERE right(source, 1) = '3'""",
    graph=False,
)
def coverage_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even scopes are covered, one of them twice, and so are old scopes that nobody declares."""
    declared = table(spark, sf_dir, "documents").select(F.col("source").alias("scope"))
    one, digit = declared.distinct(), F.right(F.col("scope"), F.lit(1))
    coverage = one.where(digit.isin("0", "2", "4", "6", "8")).unionByName(one.where(digit == "4"))
    coverage = coverage.unionByName(one.where(digit == "3").select(F.concat(F.lit("old-"), "scope").alias("scope")))
    return observe.coverage_problems(declared, coverage)


def _prior_current(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """Customers: bindings of those below 8 modulo 10, candidates of those above 1, with names and types edited on both sides."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    own = entity_id("customer", k)
    scope = F.col("c_nationkey").cast("string").alias("scope")
    prior = c.where(k % 10 < 8).select(scope, k.alias("key"), own.alias("component_id"), (k % 4 != 0).alias("present"), F.col("c_name").alias("p_name"), F.when(k % 6 > 0, F.col("c_mktsegment")).alias("p_type"))
    candidates = c.where(k % 10 > 1).select(scope, k.alias("key"), F.when(k % 3 == 0, F.upper("c_name")).otherwise(F.col("c_name")).alias("name"), F.col("c_mktsegment").alias("type"))
    now = c.select(own.alias("id"), F.when(k % 5 == 0, F.lit("by hand")).otherwise(F.col("c_name")).alias("name"), F.when(k % 6 > 0, F.col("c_mktsegment")).alias("type"))
    nations = table(spark, sf_dir, "nation")
    coverage = nations.select(F.col("n_nationkey").cast("string").alias("scope"), F.array(F.lit("component-candidate")).alias("kinds"), F.when(F.col("n_nationkey") % 2 == 1, "partial").otherwise("complete").alias("state"))
    return prior, candidates, coverage, now


_RECONCILED = """WITH c AS (SELECT c_nationkey::VARCHAR AS scope, c_custkey AS key, 'ent_' || md5('customer:' || c_custkey) AS cid, c_custkey % 10 < 8 AS old, c_custkey % 10 > 1 AS new,
    c_custkey % 4 <> 0 AS was, c_name AS pn, CASE WHEN c_custkey % 6 > 0 THEN c_mktsegment END AS pt, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) ELSE c_name END AS nn, c_mktsegment AS nt,
    CASE WHEN c_custkey % 5 = 0 THEN 'by hand' ELSE c_name END AS cn, c_nationkey % 2 = 0 AS believed FROM customer),
  f AS (SELECT *, CASE WHEN NOT old THEN nn WHEN NOT new THEN cn WHEN cn = pn THEN nn ELSE cn END AS name, CASE WHEN NOT old OR new THEN nt ELSE pt END AS type FROM c WHERE old OR new)
SELECT scope, key, CASE WHEN old THEN cid ELSE 'ent_' || md5('component:' || scope || ':' || key) END AS component_id,
  CASE WHEN NOT old THEN 'create' WHEN new THEN CASE WHEN name <> cn OR type IS DISTINCT FROM pt OR NOT was THEN 'update' ELSE 'keep' END WHEN believed THEN 'retire' ELSE 'retain' END AS action,
  CASE WHEN new THEN true WHEN believed THEN false ELSE was END AS present, name, type FROM f"""


@registered("reconcile_actions", _RECONCILED, graph=False)
def reconcile_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.component_actions(*_prior_current(spark, sf_dir))


@registered("reconcile_noop", "SELECT 'none' AS action, 0::BIGINT AS n WHERE false", graph=False)
def reconcile_noop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reconciling what a reconcile left changes nothing: actions other than keep, of which there are none."""
    prior, candidates, coverage, now = _prior_current(spark, sf_dir)
    same = candidates.select("scope", "key", "name", "type")
    left = same.select("scope", "key", entity_id("customer", F.col("key")).alias("component_id"), F.lit(True).alias("present"), F.col("name").alias("p_name"), F.col("type").alias("p_type"))
    stored = left.select(F.col("component_id").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"))
    out = reconcile.component_actions(left, same, coverage, stored)
    return out.where("action <> 'keep'").groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@registered(
    "snapshot_difference",
    """SELECT side, count(*) AS n FROM (SELECT 'old' AS side, c_custkey FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 10 > 7
    UNION ALL SELECT 'new', c_custkey FROM customer WHERE c_custkey % 10 > 1 AND (c_custkey % 3 = 0 OR c_custkey % 10 > 7)) WHERE side = 'new' AND c_custkey % 10 > 1 OR side = 'old' AND c_custkey % 10 < 8 AND (c_custkey % 3 = 0 OR c_custkey % 10 < 2) GROUP BY 1
    """,
    graph=False,
)
def snapshot_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    old = c.where(k % 10 < 8).select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.lit(1).alias("epoch"))
    new = c.where(k % 10 > 1).select(F.col("c_custkey").alias("key"), F.when(k % 3 == 0, F.upper("c_name")).otherwise(F.col("c_name")).alias("name"), F.lit(2).alias("epoch"))
    return reconcile.same_content(old, new).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


ORACLE_SQL["snapshot_difference"] = """WITH o AS (SELECT c_custkey AS k, c_name AS n FROM customer WHERE c_custkey % 10 < 8),
w AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) ELSE c_name END AS n FROM customer WHERE c_custkey % 10 > 1),
d AS ((SELECT 'old' AS side, k FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM w)) UNION ALL (SELECT 'new', k FROM (SELECT * FROM w EXCEPT ALL SELECT * FROM o)))
SELECT side, count(*) AS n FROM d GROUP BY 1"""


@registered(
    "relationship_merge",
    """WITH r AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS t FROM lineitem),
    f AS (SELECT *, (s + t) % 10 < 8 AS old, (s + t) % 10 > 1 AS new, t % 9 = 0 AS removed, s % 8 = 0 AS edited, s % 2 = 0 AS believed,
      CASE WHEN t % 4 = 0 THEN 'feeds' ELSE 'supplies' END AS nt FROM r)
    SELECT s || ':' || t AS key, CASE WHEN NOT old THEN 'create' WHEN new THEN CASE WHEN removed THEN 'recreate' WHEN (CASE WHEN edited THEN 'by-hand' ELSE 'supplies' END) = nt THEN 'keep'
      WHEN NOT edited THEN 'update' ELSE 'curated' END WHEN believed AND NOT edited AND NOT removed THEN 'remove' ELSE 'retain' END AS action FROM f WHERE old OR new""",
    graph=False,
)
def relationship_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("t")).distinct()
    s, t = F.col("s"), F.col("t")
    key = F.concat_ws(":", s.cast("string"), t.cast("string")).alias("key")
    scope, rel = s.cast("string").alias("scope"), F.concat(F.lit("rel_"), F.md5(F.concat_ws(":", s.cast("string"), t.cast("string"))))
    ends = [s.cast("string").alias("source"), t.cast("string").alias("target")]
    held = r.where((s + t) % 10 < 8)
    prior = held.select(scope, key, rel.alias("relation_id"), (t % 9 == 0).alias("removed"), F.lit("supplies").alias("p_type"), s.cast("string").alias("p_source"), t.cast("string").alias("p_target"))
    observed = r.where((s + t) % 10 > 1).select(scope, key, F.when(t % 4 == 0, "feeds").otherwise("supplies").alias("type"), *ends)
    live = held.where(t % 9 != 0).select(rel.alias("id"), F.when(s % 8 == 0, "by-hand").otherwise("supplies").alias("type"), *ends)
    coverage = r.select(scope).distinct().select("scope", F.array(F.lit("relationship")).alias("kinds"), F.when(F.col("scope").cast("long") % 2 == 0, "complete").otherwise("partial").alias("state"))
    return reconcile.relationship_actions(prior, observed, coverage, live).select("key", "action")


def _generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as generations per user: every eleventh lost, every thirteenth doubled, every seventeenth two back."""
    e = table(spark, sf_dir, "events")
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    base = e.select(F.col("user_id").cast("string").alias("stream"), F.col("event_id"), n.alias("generation"), F.lit(0).cast("long").alias("start")).where("event_id % 11 <> 0")
    extra = F.array_compact(
        F.array(
            F.struct((F.col("event_id") * 10).alias("arrival"), F.col("generation").alias("g")),
            F.when(F.col("event_id") % 13 == 0, F.struct((F.col("event_id") * 10 + 1).alias("arrival"), F.col("generation").alias("g"))),
            F.when(F.col("event_id") % 17 == 0, F.struct((F.col("event_id") * 10 + 2).alias("arrival"), (F.col("generation") - 2).alias("g"))),
        )
    )
    return base.select("stream", "start", F.explode(extra).alias("x")).select("stream", F.col("x.arrival").alias("arrival"), F.col("x.g").alias("generation"), "start")


_EVENTS = """WITH e AS (SELECT user_id::VARCHAR AS stream, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events),
b AS (SELECT * FROM e WHERE event_id % 11 <> 0),
a AS (SELECT stream, event_id * 10 AS arrival, g FROM b UNION ALL SELECT stream, event_id * 10 + 1, g FROM b WHERE event_id % 13 = 0
  UNION ALL SELECT stream, event_id * 10 + 2, g - 2 FROM b WHERE event_id % 17 = 0),
w AS (SELECT *, greatest(0, coalesce(max(g) OVER (PARTITION BY stream ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS now FROM a)
SELECT stream, arrival, g AS generation, CASE WHEN g = now THEN 'duplicate' WHEN g < now THEN 'reversed' WHEN g = now + 1 THEN 'accepted' ELSE 'missed' END AS status FROM w"""


@registered("event_sequence_status", _EVENTS, graph=False)
def event_sequence_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.event_statuses(_generations(spark, sf_dir)).select("stream", "arrival", "generation", "status")


def _scratch(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


@registered("event_sequence_stream", _EVENTS, graph=False)
def event_sequence_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a stateful stream that takes all there is and stops."""
    at = _scratch(spark)
    _generations(spark, sf_dir).write.parquet(f"{at}/in")
    schema = "stream string, arrival long, generation long, start long"
    sessions.run_events(spark.readStream.schema(schema).parquet(f"{at}/in"), f"{at}/checkpoint", f"{at}/out", f"{at}/state")
    return spark.read.schema("stream string, arrival long, generation long, status string, batch long").parquet(f"{at}/out").drop("batch")


def _session_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as five batches of records for each source, one session a source, and what goes wrong in some of them.

    src1: a batch gives a key of an earlier one other content. src2: a batch after the end. src3 never ends, src4 is cancelled.
    src5 expires by its last heartbeat, src6 is told to by another one. src7: a batch whose sequence goes back. src8: a batch with a
    scope that was not declared. src9 sends its first batch again. src10 covers no scope at first. src11 does not begin.
    """
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.coalesce("lang", F.lit("-")).alias("lang"), "text")
    record = F.struct(F.col("lang").alias("scope"), F.col("key"), F.lit("documentation").alias("kind"), F.col("text").alias("body"))
    part = F.floor(F.col("doc_id") / 20) % 5
    sent = docs.select("source", part.cast("long").alias("b"), F.col("doc_id").cast("string").alias("key"), "lang", "text")
    first = docs.where("doc_id = 1").select(F.lit("src1").alias("source"), F.lit(2).cast("long").alias("b"), F.lit("1").alias("key"), "lang", F.lit("other").alias("text"))
    stray = docs.where("doc_id = 1").select(F.lit("src8").alias("source"), F.lit(1).cast("long").alias("b"), F.lit("x").alias("key"), F.lit("nowhere").alias("lang"), F.lit("x").alias("text"))
    late = sent.where("b = 0 and source in ('src2', 'src7')").withColumns({"b": F.when(F.col("source") == "src2", 10).otherwise(8).cast("long"), "key": F.concat(F.lit("late-"), "key")})
    again = sent.where("b = 0 and source = 'src9'").withColumn("b", F.lit(8).cast("long"))
    batches = sent.unionByName(first).unionByName(stray).unionByName(late).unionByName(again).groupBy("source", "b").agg(F.sort_array(F.collect_list(record)).alias("records"))
    at = F.col("b") + 1
    none = {c.split()[0]: F.lit(None).cast(c.split(" ", 1)[1]) for c in ("heartbeat long", "scopes array<string>", f"records {sessions.RECORDS}", f"coverage {sessions.COVERAGE}")}

    def message(df: DataFrame, arrival, type_: str, sequence=None, **own) -> DataFrame:
        own = none | own
        sequence = (arrival if sequence is None else sequence).cast("long").alias("sequence")
        return df.select(F.col("source").alias("session"), arrival.cast("long").alias("arrival"), sequence, F.lit(type_).alias("type"), *[own[c].alias(c) for c in none])

    own = docs.groupBy("source").agg(F.sort_array(F.collect_set("lang")).alias("scopes"))
    covered = F.transform("scopes", lambda x: F.struct(x.alias("scope"), F.array(F.lit("documentation")).alias("kinds"), F.lit("complete").alias("state")))
    some = lambda *names: own.where(F.col("source").isin(*names))
    going = F.when(F.col("source") == "src7", F.when(F.col("b") == 8, 1).otherwise(at)).otherwise(at)
    parts = (
        message(own.where("source <> 'src11'"), F.lit(0), "begin", scopes=F.col("scopes")), message(batches, at, "batch", going, records=F.col("records")),
        message(some("src5", "src6"), F.lit(7), "heartbeat"), message(some("src10"), F.lit(7), "complete", coverage=F.array().cast(sessions.COVERAGE)),
        message(some("src5", "src6"), F.lit(8), "expire", F.lit(None), heartbeat=F.when(F.col("source") == "src5", 7).otherwise(3).cast("long")), message(some("src4"), F.lit(8), "cancel"),
        message(own.where("source <> 'src3'"), F.lit(10), "complete", coverage=covered),
    )
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _session_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages in three goes, each a micro-batch of many files: the state machine reads nothing of what it took before."""
    at = _scratch(spark)
    messages = _session_messages(spark, sf_dir)
    for when in ("arrival <= 2", "arrival between 3 and 7", "arrival > 7"):
        messages.where(when).write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(sessions.MESSAGE).parquet(f"{at}/in")
        sessions.run_sessions(stream, f"{at}/checkpoint", f"{at}/receipts", sessions.Bounds(batch_records=1_000_000, records=10_000_000, characters=1 << 40))
    return sessions.read_receipts(spark, f"{at}/receipts")


#: Batches of the sessions: which are taken, and why the others are not.
_SESSIONS = """WITH d AS (SELECT source, doc_id, (doc_id // 20) % 5 AS b FROM documents),
    s AS (SELECT DISTINCT source FROM documents),
    m AS (SELECT source, b, count(*) AS n FROM d GROUP BY ALL),
    bat AS (SELECT source, b + 1 AS arrival, CASE WHEN source = 'src11' THEN 'session-not-begun' WHEN source = 'src1' AND b = 2 THEN 'contradictory-observation'
        WHEN source = 'src8' AND b = 1 THEN 'undeclared-scope' END AS problem, n, 0 AS again FROM m
      UNION ALL SELECT source, 11, 'session-ended', n, 0 FROM m WHERE source = 'src2' AND b = 0
      UNION ALL SELECT source, 9, 'sequence-not-advancing', n, 0 FROM m WHERE source = 'src7' AND b = 0
      UNION ALL SELECT source, 9, NULL, 0, n FROM m WHERE source = 'src9' AND b = 0),
    msg AS (SELECT source, 0 AS arrival, 'begin' AS type, NULL AS problem, 0 AS n, 0 AS again FROM s WHERE source <> 'src11'
      UNION ALL SELECT source, arrival, 'batch', problem, CASE WHEN problem IS NULL THEN n ELSE 0 END, again FROM bat
      UNION ALL SELECT source, 7, 'heartbeat', NULL, 0, 0 FROM s WHERE source IN ('src5', 'src6')
      UNION ALL SELECT source, 7, 'complete', 'coverage-mismatch', 0, 0 FROM s WHERE source = 'src10'
      UNION ALL SELECT source, 8, 'expire', CASE WHEN source = 'src6' THEN 'expiry-heartbeat-mismatch' END, 0, 0 FROM s WHERE source IN ('src5', 'src6')
      UNION ALL SELECT source, 8, 'cancel', NULL, 0, 0 FROM s WHERE source = 'src4'
      UNION ALL SELECT source, 10, 'complete', CASE WHEN source = 'src11' THEN 'session-not-begun' WHEN source IN ('src4', 'src5') THEN 'session-ended' END, 0, 0 FROM s WHERE source <> 'src3')"""


@registered(
    "session_stream",
    _SESSIONS + """ SELECT source AS session, count(*) AS n, md5(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)) AS keys FROM d JOIN bat USING (source)
    WHERE problem IS NULL AND again = 0 AND arrival = b + 1 AND source NOT IN ('src3', 'src4', 'src5', 'src11') GROUP BY source""",
    graph=False,
)
def session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the sessions that completed publish: nothing of refused batches, nothing that came after the end."""
    out = sessions.published_records(_session_receipts(spark, sf_dir))
    keys = F.array_join(F.transform(F.array_sort(F.collect_list(F.col("key").cast("long"))), lambda x: x.cast("string")), ",")
    return out.groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.md5(keys).alias("keys"))


@registered(
    "session_receipts",
    _SESSIONS + """ SELECT source AS session, arrival::BIGINT AS arrival, type, problem, n::INT AS accepted, again::INT AS replayed, CASE WHEN source = 'src11' THEN 0
      ELSE sum(n) OVER (PARTITION BY source ORDER BY arrival ROWS UNBOUNDED PRECEDING) END::BIGINT AS total FROM msg""",
    graph=False,
)
def session_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of every message: a refused one changes nothing, and its session goes on."""
    return _session_receipts(spark, sf_dir).select("session", "arrival", "type", "problem", "accepted", "replayed", "total")


@registered("document_summary")
def document_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", summary_of(F.col("text"), F.lit("text"), F.col("source")).alias("summary"))


@registered("best_documentation")
def best_documentation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    records = docs.select(F.col("source").alias("component"), F.col("doc_id").alias("key"), (F.col("doc_id") % 3).alias("depth"), F.col("text").alias("content"), F.lit("markdown").alias("format"), F.col("source").alias("name"))
    return best_documentation(records)
