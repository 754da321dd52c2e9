"""Checks on a whole snapshot or a batch of mutations, each a table of what breaks it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import RELATION_ID, ENTITY_ID, SCALES, icon_domain_valid, kind_valid, label_valid, open_token_valid, packed, scale_rank, summary_valid, unpacked
from ..plans.errors import GraphQueryError
from ..plans.graph import GraphFrames
from ..plans.lineage import cut, is_empty
from ..plans.payloads import extension_problems
from .derive import scale_violations
from .hierarchy import containment_cycles


def duplicate_ids(df: DataFrame, key: str = "id") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def has_duplicate_ids(df: DataFrame, key: str = "id") -> bool:
    """Whether duplicate_ids() has a row. Only hashes of eight bytes are shuffled, and the ids where two hashes are equal."""
    if is_empty(df.groupBy(F.xxhash64(key)).agg(F.count(F.lit(1)).alias("n")).where("n > 1")):
        return False
    return not is_empty(duplicate_ids(df, key))


def dangling_endpoints(graph: GraphFrames) -> DataFrame:
    """(relation, role, endpoint) of relation ends that are no live entity.

    Each endpoint is looked up once, however many relations have it; relations are met again only with what is lost.
    """
    lost = lost_endpoints(graph)
    roles = F.array(F.struct(F.lit("source").alias("role"), F.col("source").alias("endpoint")), F.struct(F.lit("target").alias("role"), F.col("target").alias("endpoint")))
    ends = graph.relations.select(F.col("id").alias("relation"), F.explode(roles).alias("e")).select("relation", "e.role", "e.endpoint")
    return ends.join(lost, "endpoint", "left_semi").select("relation", "role", "endpoint")


def lost_endpoints(graph: GraphFrames) -> DataFrame:
    """(endpoint) of relation ends that are no live entity, each once and written down."""
    ends = graph.relations.select(F.explode(F.array("source", "target")).alias("endpoint")).distinct()
    return cut(ends.join(graph.entities.select(F.col("id").alias("endpoint")), "endpoint", "left_anti"))


def parent_problems(entities: DataFrame) -> DataFrame:
    """(id, problem): unknown parents, components in themselves, and members of containment cycles."""
    own = entities.select("id", "parent")
    selfish = own.where("id = parent").select("id", F.lit("self-containment").alias("problem"))
    lost = own.where("parent is not null").join(own.select(F.col("id").alias("parent")), "parent", "left_anti").select("id", F.lit("unknown-parent").alias("problem"))
    cycles = containment_cycles(own.where("id <> parent or parent is null")).select("id", F.lit("containment-cycle").alias("problem"))
    return selfish.unionByName(lost).unionByName(cycles)


def field_problems(entities: DataFrame) -> DataFrame:
    """(id, problem) of malformed ids, kinds, types, scales, labels, summaries, icon domains, lifecycles and extension keys."""
    c = F.col
    checks = {
        "invalid-id": c("id").rlike(ENTITY_ID), "invalid-kind": kind_valid(c("kind")),
        "invalid-type": c("type").isNull() | open_token_valid(c("type")),
        "invalid-scale": c("scale").isNull() | c("scale").isin(*SCALES),
        "invalid-label": c("label").isNull() | label_valid(c("label")),
        "invalid-summary": c("summary").isNull() | summary_valid(c("summary")),
    }
    if "icon_domain" in entities.columns:
        checks["invalid-icon-domain"] = c("icon_domain").isNull() | icon_domain_valid(c("icon_domain"))
    if "lifecycle" in entities.columns:
        checks["invalid-lifecycle"] = c("lifecycle").isNull() | open_token_valid(c("lifecycle"))
    if "extensions" in entities.columns:
        checks["invalid-extension-key"] = F.size(extension_problems(c("extensions"))) == 0
    named = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks.items()])
    return entities.select("id", F.explode(F.filter(named, lambda x: x.isNotNull())).alias("problem"))


def relation_problems(relations: DataFrame) -> DataFrame:
    bad = F.array(F.when(~F.coalesce(F.col("id").rlike(RELATION_ID), F.lit(False)), "invalid-relation-id"), F.when(~kind_valid(F.col("type")), "invalid-relation-type"))
    return relations.select("id", F.explode(F.filter(bad, lambda x: x.isNotNull())).alias("problem"))


def graph_diagnostics(graph: GraphFrames) -> DataFrame:
    """(id, problem): everything that is wrong with a snapshot, all checks together."""
    named = lambda df, col, problem: df.select(F.col(col).alias("id"), F.lit(problem).alias("problem"))
    out = named(duplicate_ids(graph.entities), "id", "duplicate-entity").unionByName(named(duplicate_ids(graph.relations), "id", "duplicate-relation"))
    for more in (
        named(dangling_endpoints(graph), "relation", "unknown-endpoint"), parent_problems(graph.entities), field_problems(graph.entities),
        relation_problems(graph.relations), named(scale_violations(graph.entities), "id", "scale-coarser-than-parent"),
    ):
        out = out.unionByName(more)
    return out


def mutation_problems(mutations: DataFrame, known: DataFrame, affected: DataFrame) -> DataFrame:
    """(id, problem) of a batch (id, op): ids targeted twice, unknown ones, and ones not announced in affected."""
    twice = duplicate_ids(mutations).select("id", F.lit("duplicate-target").alias("problem"))
    lost = mutations.where("op <> 'create'").join(known.select("id"), "id", "left_anti").select("id", F.lit("unknown-target").alias("problem"))
    silent = mutations.select("id").distinct().join(affected.select("id"), "id", "left_anti").select("id", F.lit("target-not-affected").alias("problem"))
    return twice.unionByName(lost).unionByName(silent)


def stale_revisions(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(resource, expected, actual) where the revision a writer saw is no longer the stored one."""
    met = expected.select("resource", F.col("revision").alias("expected")).join(actual.select("resource", F.col("revision").alias("actual")), "resource", "left")
    return met.where(~F.col("expected").eqNullSafe(F.col("actual")))


def unknown_references(references: DataFrame, entities: DataFrame) -> DataFrame:
    """References (owner, id) to entities that are not there."""
    return references.join(entities.select("id"), "id", "left_anti")


def rename_dependents(renamed: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(id): members of renamed components, and sources of relations that point at them."""
    targets = renamed.select(packed(F.col("id")).alias("on")).distinct()
    members = entities.where("parent is not null").select(packed(F.col("parent")).alias("on"), packed(F.col("id")).alias("id"))
    sources = relations.select(packed(F.col("target")).alias("on"), packed(F.col("source")).alias("id"))
    # bytes travel, and by the same join at any size
    met = members.unionByName(sources).join(targets.hint("shuffle_hash"), "on", "left_semi").select("id").distinct()
    return met.select(unpacked(F.col("id")).alias("id"))


def removal_blockers(graph: GraphFrames, targets: DataFrame) -> DataFrame:
    """(id, blocker, n): what keeps each target (id) from being removed: aliases, members, relations."""
    own = targets.select("id").distinct()
    ends = graph.relations.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("id"))
    parts = (
        (graph.aliases.select(F.col("target").alias("id")), "alias-target"),
        (graph.entities.where("parent is not null").select(F.col("parent").alias("id")), "children"),
        (ends, "relations"),
    )
    out = None
    for df, name in parts:
        n = df.join(own, "id", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("n")).select("id", F.lit(name).alias("blocker"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def changed_cycles(entities: DataFrame, changed: DataFrame) -> DataFrame:
    """(id) of the changed entities that lie on a containment cycle: every cycle that a change closes holds one of them.

    Walks up from the changed entities alone, all at once, a join with the parents a level. Who arrives at an entity that was
    found on a cycle stops there, so the walk ends although cycles do not.
    """
    parents = entities.where("parent is not null").select("id", "parent")
    at = cut(changed.select("id").distinct().join(parents, "id").select("id", F.col("parent").alias("at")))
    found = None
    while not is_empty(at):
        back = at.where("id = at").select("id")
        if not is_empty(back):
            found = cut(back if found is None else found.unionByName(back))
        going = at if found is None else at.join(found.select(F.col("id").alias("at")), "at", "left_anti")
        at = cut(going.join(parents.select(F.col("id").alias("at"), "parent"), "at").select("id", F.col("parent").alias("at")).distinct())
    return at.select("id") if found is None else found.distinct()


def delta_diagnostics(graph: GraphFrames, entities: DataFrame, relations: DataFrame, gone: DataFrame) -> DataFrame:
    """(id, problem) like graph_diagnostics(), of a graph that was fine before these ids changed or went.

    entities, relations: ids that were added or changed; gone: ids of entities that are no more. Looked at are the
    changed rows, relations that ended at what is gone, and members of what changed or is gone.
    """
    named = lambda df, col, problem: df.select(F.col(col).alias("id"), F.lit(problem).alias("problem"))
    touched, gone = cut(entities.select("id").distinct()), cut(gone.select("id").distinct())
    own = cut(graph.entities.join(touched, "id", "left_semi"))
    # ids of relations and of their ends travel as bytes
    as_bytes = lambda df: df.select(packed(F.col("id")).alias("id"), "type", packed(F.col("source")).alias("source"), packed(F.col("target")).alias("target"))
    edges = cut(as_bytes(graph.relations).join(cut(relations.select(packed(F.col("id")).alias("id")).distinct()), "id", "left_semi"))
    loose = graph.relations.join(gone.select(F.col("id").alias("source")), "source", "left_semi").unionByName(
        (graph.incoming if graph.incoming is not None else graph.relations).join(gone.select(F.col("id").alias("target")), "target", "left_semi").select(*graph.relations.columns)
    )
    near = edges.unionByName(cut(as_bytes(loose)))
    ends = near.select(F.col("id").alias("relation"), F.explode(F.array("source", "target")).alias("id"))
    there = graph.entities.select(packed(F.col("id")).alias("id")).join(cut(ends.select("id").distinct()), "id", "left_semi")
    lost = ends.join(cut(there), "id", "left_anti").select("relation").distinct().select(unpacked(F.col("relation")).alias("id"))
    said = lambda df: df.withColumn("id", unpacked(F.col("id")))
    members = graph.entities.where("parent is not null").join(touched.unionByName(gone).select(F.col("id").alias("parent")).distinct(), "parent", "left_semi")
    below = cut(own.where("parent is not null").select("id", "parent", "scale").unionByName(members.select("id", "parent", "scale")).distinct())
    above = cut(graph.entities.select(F.col("id").alias("parent"), F.col("scale").alias("parent_scale")).join(cut(below.select("parent").distinct()), "parent", "left_semi"))
    orphans = below.join(above, "parent", "left_anti")
    coarse = below.where("scale is not null").join(above, "parent").where(scale_rank(F.col("scale")) < scale_rank(F.col("parent_scale")))
    out = named(duplicate_ids(own), "id", "duplicate-entity").unionByName(named(said(duplicate_ids(edges)), "id", "duplicate-relation"))
    for more in (
        named(lost, "id", "unknown-endpoint"), named(own.where("id = parent"), "id", "self-containment"), named(orphans, "id", "unknown-parent"),
        named(changed_cycles(graph.entities.where("id <> parent or parent is null"), touched), "id", "containment-cycle"),
        field_problems(own), relation_problems(said(edges)), named(coarse, "id", "scale-coarser-than-parent"),
    ):
        out = out.unionByName(more)
    return out


def refuse_problems(problems: DataFrame, most: int = 20) -> None:
    """Raise invariant-violation with the first problems of a table (id, problem), if it has any."""
    found = problems.orderBy("problem", "id").limit(most).collect()
    if found:
        raise GraphQueryError("invariant-violation", found[0]["problem"], problems=[(r["id"], r["problem"]) for r in found])
