"""Merging a completed snapshot into the graph without overwriting what people have edited."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import minted_id, packed, unpacked
from ..plans.graph import GraphFrames
from ..plans.payloads import canonical_text, with_open_fields
from .aliases import resolve_aliases
from .observe import absent_keys, complete_kinds

OWNED = ("icon_domain", "label", "name", "summary", "type")


def owned(current: Column, projected: Column, proposed: Column) -> Column:
    """Evidence changes a field only while it still equals what evidence last put there."""
    return F.when(current.eqNullSafe(projected), proposed).otherwise(current)


def resolve_bindings(bindings: DataFrame, aliases: DataFrame) -> DataFrame:
    """bindings with component_id moved to the end of its alias chain."""
    ends = resolve_aliases(aliases).select(F.col("source").alias("component_id"), F.col("resolved").alias("__r"))
    return bindings.join(ends, "component_id", "left").withColumn("component_id", F.coalesce("__r", "component_id")).drop("__r")


def binding_conflicts(bindings: DataFrame, others: DataFrame) -> DataFrame:
    """(component_id, problem): a component bound twice by this source, or also by another one."""
    twice = bindings.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component_id", F.lit("ambiguous-binding").alias("problem"))
    foreign = bindings.join(others.select("component_id"), "component_id", "left_semi").select("component_id", F.lit("foreign-binding").alias("problem"))
    return twice.unionByName(foreign.distinct())


def component_actions(prior: DataFrame, candidates: DataFrame, coverage: DataFrame, entities: DataFrame, fields: tuple[str, ...] = ("name", "type")) -> DataFrame:
    """What each (scope, key) leads to: one row of action, component_id, present and the resulting fields.

    prior: scope, key, component_id, present and per field its last projection `p_<field>`. candidates:
    scope, key and the fields proposed. coverage: scope, kinds, state. entities: id and the current fields.
    Actions: create (new key, id from scope and key), update (an owned field changes), keep, retire (gone
    under complete coverage: present turns false, the component stays), retain (gone, not believed).
    """
    new = candidates.select("scope", "key", *[F.col(f).alias(f"n_{f}") for f in fields]).withColumn("__new", F.lit(True))
    old = prior.withColumn("__old", F.lit(True))
    now = entities.select(F.col("id").alias("component_id"), *[F.col(f).alias(f"c_{f}") for f in fields])
    gone = absent_keys(prior.withColumn("kind", F.lit("component-candidate")), candidates, complete_kinds(coverage))
    gone = gone.select("scope", "key").withColumn("__gone", F.lit(True))
    both = old.join(new, ["scope", "key"], "full_outer").join(now, "component_id", "left").join(gone, ["scope", "key"], "left")
    fresh, there = F.col("__old").isNull(), F.col("__new").isNotNull()
    out, changed = {}, F.lit(False)
    for f in fields:
        current, proposed = F.col(f"c_{f}"), F.col(f"n_{f}")
        out[f] = F.when(fresh, proposed).when(there, owned(current, F.col(f"p_{f}"), proposed)).otherwise(current)
        changed = changed | ~out[f].eqNullSafe(current)
    action = F.when(fresh, "create").when(there, F.when(changed | ~F.col("present"), "update").otherwise("keep")).when(F.col("__gone"), "retire").otherwise("retain")
    present = F.when(there, F.lit(True)).when(F.col("__gone"), F.lit(False)).otherwise(F.col("present"))
    own = F.coalesce("component_id", minted_id("ent_", "component", F.col("scope"), F.col("key")))
    return both.select("scope", "key", own.alias("component_id"), action.alias("action"), present.alias("present"), *[c.alias(f) for f, c in out.items()])


def structure_actions(bindings: DataFrame, forest: DataFrame, breadth: DataFrame, entities: DataFrame) -> DataFrame:
    """(component_id, parent, shared): containment and sharing projected onto entities they still own.

    bindings: scope, key, component_id, p_parent, p_shared; forest: key, parent_key; breadth: key, reuse_breadth.
    """
    from .derive import shared_flag

    ids = bindings.select(F.col("key").alias("parent_key"), F.col("component_id").alias("__parent"))
    met = bindings.join(forest.select("key", "parent_key"), "key", "left").join(ids, "parent_key", "left").join(breadth, "key", "left")
    now = entities.select(F.col("id").alias("component_id"), F.col("parent").alias("__p"), F.col("shared").alias("__s"))
    met = met.join(now, "component_id")
    parent = owned(F.col("__p"), F.col("p_parent"), F.col("__parent"))
    # persisted flags say true or nothing
    shared = owned(F.col("__s"), F.col("p_shared"), F.when(shared_flag(F.col("reuse_breadth")), F.lit(True)))
    return met.select("component_id", parent.alias("parent"), shared.alias("shared"))


def relationship_actions(prior: DataFrame, observed: DataFrame, coverage: DataFrame, relations: DataFrame) -> DataFrame:
    """What each observed or known relationship (scope, key) leads to: relation_id, action, type, source, target.

    prior: scope, key, relation_id, removed, p_type, p_source, p_target. observed: scope, key, type, source,
    target. Actions: create, recreate (removed before), update (differs, still owned), keep, curated (edited
    by hand, left alone), remove (gone under complete coverage and still owned), retain.
    """
    fields = ("type", "source", "target")
    new = observed.select("scope", "key", *[F.col(f).alias(f"n_{f}") for f in fields]).withColumn("__new", F.lit(True))
    old = prior.withColumn("__old", F.lit(True)).withColumn("relation_id", packed(F.col("relation_id")))  # bytes travel
    now = relations.select(packed(F.col("id")).alias("relation_id"), *[F.col(f).alias(f"c_{f}") for f in fields]).withColumn("__live", F.lit(True))
    believed = complete_kinds(coverage).where("kind = 'relationship'").select("scope", F.lit(True).alias("__believed"))
    both = old.join(new, ["scope", "key"], "full_outer").join(now, "relation_id", "left").join(believed, "scope", "left")
    mine, same = F.col("__live").isNotNull(), F.col("__live").isNotNull()
    for f in fields:
        mine = mine & F.col(f"c_{f}").eqNullSafe(F.col(f"p_{f}"))
        same = same & F.col(f"c_{f}").eqNullSafe(F.col(f"n_{f}"))
    action = (
        F.when(F.col("__old").isNull(), "create")
        .when(F.col("__new").isNotNull(), F.when(F.col("removed") | F.col("__live").isNull(), "recreate").when(same, "keep").when(mine, "update").otherwise("curated"))
        .when(F.col("__believed") & mine & ~F.col("removed"), "remove")
        .otherwise("retain")
    )
    own = F.coalesce(unpacked(F.col("relation_id")), minted_id("rel_", "relationship", F.col("scope"), F.col("key")))
    takes = action.isin("create", "recreate", "update", "keep")
    return both.select("scope", "key", own.alias("relation_id"), action.alias("action"), *[F.when(takes, F.col(f"n_{f}")).otherwise(F.col(f"c_{f}")).alias(f) for f in fields])


def apply_actions(graph: GraphFrames, components: DataFrame | None = None, relations: DataFrame | None = None, structure: DataFrame | None = None, fields: tuple[str, ...] = ("name", "type")) -> GraphFrames:
    """The next generation after component_actions(), relationship_actions() and structure_actions(), each optional.

    Creates and updates set the fields that the actions carry; components never go, relations go by `remove`.
    """
    entities, edges = graph.entities, graph.relations
    if components is not None and set(fields) - set(entities.columns):
        entities = with_open_fields(entities)
    takes = F.col("action").isin("create", "update", "recreate")
    if components is not None:
        new = components.where(takes).select(F.col("component_id").alias("id"), F.col("action").alias("__a"), *[F.col(f).alias(f"__{f}") for f in fields])
        old = entities.join(new.where("__a = 'update'"), "id", "left")
        kept = old.withColumns({f: F.when(F.col("__a").isNotNull(), F.col(f"__{f}")).otherwise(F.col(f)) for f in fields}).select(*entities.columns)
        named = {"id": F.col("id"), "kind": F.lit("component")} | {f: F.col(f"__{f}") for f in fields}
        fresh = new.where("__a = 'create'").select(*[named.get(c, F.lit(None)).cast(t).alias(c) for c, t in entities.dtypes])
        entities = kept.unionByName(fresh)
    if structure is not None:
        moved = structure.select(F.col("component_id").alias("id"), F.col("parent").alias("__p"), F.col("shared").alias("__s"), F.lit(True).alias("__m"))
        hit = F.col("__m").isNotNull()
        entities = entities.join(moved, "id", "left").withColumns({"parent": F.when(hit, F.col("__p")).otherwise(F.col("parent")), "shared": F.when(hit, F.col("__s")).otherwise(F.col("shared"))}).drop("__p", "__s", "__m")
    if relations is not None:
        gone = relations.where(takes | (F.col("action") == "remove")).select(F.col("relation_id").alias("id"))
        added = relations.where(takes).select(F.col("relation_id").alias("id"), "type", "source", "target", F.lit(None).cast("string").alias("description"))
        edges = edges.join(gone, "id", "left_anti").select(*edges.columns).unionByName(added)
    return graph.with_frames(entities=entities, relations=edges, generation=graph.generation + 1)


def touched(actions: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(id): components that an action changes, with members and relation sources of renamed ones."""
    from .invariants import rename_dependents

    changed = actions.where(F.col("action").isin("create", "update", "retire")).select(F.col("component_id").alias("id"))
    return changed.unionByName(rename_dependents(changed, entities, relations)).distinct()


def same_content(a: DataFrame, b: DataFrame, without: tuple[str, ...] = ("epoch",)) -> DataFrame:
    """Rows of one snapshot that the other lacks, as multisets, both ways; empty means nothing to do."""
    cols = [canonical_text(F.col(c)).alias(c) if t == "variant" else c for c, t in a.dtypes if c not in without]
    x, y = a.select(*cols), b.select(*cols)
    both = x.withColumn("__n", F.lit(1)).unionByName(y.withColumn("__n", F.lit(-1)))
    left = both.groupBy(*x.columns).agg(F.sum("__n").alias("__n")).where("__n <> 0")  # one shuffle for both ways
    rows = left.withColumn("side", F.when(F.col("__n") > 0, "old").otherwise("new")).withColumn("__n", F.explode(F.sequence(F.lit(1), F.abs("__n"))))
    return rows.drop("__n")


def replace_source(evidence: DataFrame, source_key: str, own: DataFrame) -> DataFrame:
    """All sources' evidence with one source's rows replaced."""
    return evidence.where(F.col("source_key") != source_key).unionByName(own)


def projected_summary(stated: Column, derived: Column) -> Column:
    return F.coalesce(stated, derived)


def stored_evidence_problems(bindings: DataFrame, relationships: DataFrame, relations: DataFrame) -> DataFrame:
    """(id, problem) of stored bindings that contradict each other or the graph."""
    twice = bindings.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("component_id").alias("id"), F.lit("component-bound-twice").alias("problem"))
    again = relationships.groupBy("relation_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("relation_id").alias("id"), F.lit("relation-bound-twice").alias("problem"))
    ends = relations.join(relationships.where("not removed").select(F.col("relation_id").alias("id")), "id", "left_semi")
    ends = ends.select("id", F.explode(F.array("source", "target")).alias("component_id"))
    loose = ends.join(bindings.select("component_id"), "component_id", "left_anti").select("id", F.lit("unbound-endpoint").alias("problem")).distinct()
    return twice.unionByName(again).unionByName(loose)
