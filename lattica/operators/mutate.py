"""Mutations of a snapshot: each returns a new GraphFrames, one generation on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.errors import GraphQueryError
from ..plans.graph import ALIASES, ENTITIES, GraphFrames
from ..plans.lineage import cut, is_empty, scratch_dropped
from ..plans.payloads import OPEN_FIELDS, is_extension, patched, with_open_fields
from .invariants import delta_diagnostics, has_duplicate_ids, parent_problems, refuse_problems, removal_blockers, stale_revisions
from .query import resolve_id

_CLEARABLE = ("name", "label", "summary", "intent", "type", "scale", "shared", "icon_domain", "lifecycle")


def _next(graph: GraphFrames, **frames) -> GraphFrames:
    return graph.with_frames(**frames, generation=graph.generation + 1)


def _checked_scale(graph: GraphFrames, id_: str) -> GraphFrames:
    from .derive import scale_violations

    bad = scale_violations(graph.entities).where((F.col("id") == id_) | (F.col("parent") == id_))
    if not is_empty(bad):
        raise GraphQueryError("scale-coarser-than-parent", id=id_)
    return graph


def create_component(graph: GraphFrames, component: dict) -> GraphFrames:
    """Add a component; its id must be new and its parent known. Keys with a namespace become its extensions."""
    if not is_empty(graph.entities.where(F.col("id") == component["id"])):
        raise GraphQueryError("duplicate-entity", id=component["id"])
    row = {"kind": "component", **component}
    if row.get("parent") is not None:
        row["parent"] = resolve_id(graph, row["parent"])
    own = {k: row.pop(k) for k in list(row) if is_extension(k)}
    names = [f.split()[0] for f in ENTITIES.split(", ")]
    unknown = sorted(set(row) - set(names) - set(OPEN_FIELDS))
    if unknown:
        raise GraphQueryError("unknown-field", fields=unknown)
    added = graph.entities.sparkSession.createDataFrame([tuple(row.get(n) for n in names)], ENTITIES)
    held = graph.entities
    if own or set(row) & set(OPEN_FIELDS) or set(held.columns) & set(OPEN_FIELDS):
        held = with_open_fields(held)
        added = with_open_fields(added.withColumns({c: F.lit(row[c]) for c in ("icon_domain", "lifecycle") if row.get(c) is not None}))
        if own:
            added = added.withColumn("extensions", patched(F.col("extensions"), own))
    return _checked_scale(_next(graph, entities=held.unionByName(added.select(*held.columns))), component["id"])


def update_component(graph: GraphFrames, id_: str, patch: dict) -> GraphFrames:
    """Change the fields that the patch names. None clears a fixed field, but is stored as null in an extension.

    The parent changes only by reparenting.
    """
    extensions = {k: v for k, v in patch.items() if is_extension(k)}
    wrong = sorted(set(patch) - set(_CLEARABLE) - set(extensions))
    if wrong:
        raise GraphQueryError("invalid-patch", fields=wrong)
    own = resolve_id(graph, id_)
    entities = with_open_fields(graph.entities) if set(patch) - set(graph.entities.columns) else graph.entities
    kinds, hit = dict(entities.dtypes), F.col("id") == own
    new = {f: F.when(hit, F.lit(v).cast(kinds[f])).otherwise(F.col(f)) for f, v in patch.items() if f not in extensions}
    if extensions:
        new["extensions"] = F.when(hit, patched(F.col("extensions"), extensions)).otherwise(F.col("extensions"))
    return _checked_scale(_next(graph, entities=entities.withColumns(new)), own)


def reparent_component(graph: GraphFrames, id_: str, parent: str | None) -> GraphFrames:
    """Move a component; refuses cycles and a container of finer scale."""
    own = resolve_id(graph, id_)
    above = None if parent is None else resolve_id(graph, parent)
    moved = F.when(F.col("id") == own, F.lit(above).cast("string")).otherwise(F.col("parent"))
    out = _next(graph, entities=graph.entities.withColumn("parent", moved))
    problem = parent_problems(out.entities).limit(1).collect()
    if problem:
        raise GraphQueryError(problem[0]["problem"], id=problem[0]["id"])
    return _checked_scale(out, own)


def merge_component(graph: GraphFrames, obsolete: str, survivor: str) -> GraphFrames:
    """Fold one component into another: an alias takes the obsolete id's place.

    Relations move to the survivor at both ends, members too.
    """
    own = resolve_id(graph, survivor)
    if obsolete == own or is_empty(graph.entities.where(F.col("id") == obsolete)):
        raise GraphQueryError("invalid-merge", obsolete=obsolete, survivor=own)
    swap = lambda c: F.when(F.col(c) == obsolete, F.lit(own)).otherwise(F.col(c))
    entities = graph.entities.where(F.col("id") != obsolete).withColumn("parent", swap("parent"))
    alias = graph.entities.sparkSession.createDataFrame([(obsolete, own)], ALIASES)
    relations = graph.relations.withColumns({"source": swap("source"), "target": swap("target")})
    out = _next(graph, entities=entities, relations=relations, aliases=graph.aliases.unionByName(alias))
    problem = parent_problems(out.entities).limit(1).collect()
    if problem:
        raise GraphQueryError(problem[0]["problem"], id=problem[0]["id"])
    return out


def remove_component(graph: GraphFrames, id_: str) -> GraphFrames:
    """Drop a component that nothing refers to; aliases, members and relations block it."""
    own = resolve_id(graph, id_)
    target = graph.entities.where(F.col("id") == own).select("id")
    blockers = [r["blocker"] for r in removal_blockers(graph, target).collect()]  # three at most
    if blockers:
        raise GraphQueryError("component-in-use", blockers=sorted(blockers))
    return _next(graph, entities=graph.entities.where(F.col("id") != own))


def change_relations(graph: GraphFrames, source: str, upserts: DataFrame, removals: DataFrame) -> GraphFrames:
    """Upsert and remove one component's outgoing relations. upserts: id, type, target, description; removals: id."""
    own = resolve_id(graph, source)
    upserts, removals = cut(upserts), cut(removals)  # read many times; Spark knows their sizes then
    both = upserts.select("id").unionByName(removals.select("id"))
    if not is_empty(both.groupBy("id").count().where("count > 1")):
        raise GraphQueryError("duplicate-relationship-target")
    held = cut(graph.relations.select("id", "source").join(both, "id", "left_semi"))
    if not is_empty(held.where(F.col("source") != own)):
        raise GraphQueryError("relationship-id-hijack")
    if not is_empty(removals.join(held.select("id"), "id", "left_anti")):
        raise GraphQueryError("unknown-relation")
    added = upserts.select("id", "type", F.lit(own).alias("source"), "target", "description")
    rest = graph.relations.join(both, "id", "left_anti")
    out = _next(graph, relations=rest.unionByName(added)).resolved()
    new = cut(out.relations.join(upserts.select("id"), "id", "left_semi").select("target").distinct())
    live = cut(out.entities.select(F.col("id").alias("target")).join(new, "target", "left_semi"))
    if not is_empty(new.join(live, "target", "left_anti")):
        raise GraphQueryError("unknown-endpoint")
    return out


def apply_batch(graph: GraphFrames, components: DataFrame, relations: DataFrame, aliases: DataFrame) -> GraphFrames:
    """Apply many mutations as merges: components (op and the entity fields), relations (op and theirs), new aliases.

    op is create, update or remove; order is components, relations, aliases, then endpoints follow aliases.
    Refused are ids that the batch names twice, new ones that are held and changes of ones that are not, and a batch whose
    final graph breaks an invariant: only what it touches is looked at.
    """

    components, relations, aliases = cut(components), cut(relations), cut(aliases)  # read many times; Spark knows their sizes then

    def merged(old: DataFrame, changes: DataFrame, what: str) -> DataFrame:
        if has_duplicate_ids(changes):
            raise GraphQueryError("duplicate-target")
        held = cut(old.select("id").join(changes.select("id"), "id", "left_semi"))
        if not is_empty(changes.where("op = 'create'").join(held, "id", "left_semi")):
            raise GraphQueryError(f"duplicate-{what}")
        if not is_empty(changes.where("op <> 'create'").join(held, "id", "left_anti")):
            raise GraphQueryError(f"unknown-{what}")
        rest = old.join(changes.select("id"), "id", "left_anti")
        return rest.select(*old.columns).unionByName(changes.where("op <> 'remove'").select(*old.columns))

    # frames that the batch leaves alone stay what they are, so that a store need not write them again
    frames = {} if is_empty(components) else {"entities": merged(graph.entities, components, "entity")}
    if not is_empty(relations):
        frames["relations"] = merged(graph.relations, relations, "relation")
    if not is_empty(aliases):
        frames["aliases"] = graph.aliases.unionByName(aliases.select("source", "target"))
    out = _next(graph, **frames).resolved()
    live = "op <> 'remove'"
    moved = aliases.select(F.col("source").alias("id"))  # members and relations of these now hang on the targets
    rehung = graph.entities.join(moved.withColumnRenamed("id", "parent"), "parent", "left_semi").select("id")
    rebound = graph.relations.join(moved.withColumnRenamed("id", "source"), "source", "left_semi").select("id").unionByName(
        graph.relations.join(moved.withColumnRenamed("id", "target"), "target", "left_semi").select("id")
    )
    changed, gone = components.where(live).select("id").unionByName(rehung), components.where(~F.expr(live)).select("id")
    with scratch_dropped(graph.entities.sparkSession):
        refuse_problems(delta_diagnostics(out, changed, relations.where(live).select("id").unionByName(rebound), gone))
    return out


def transact(graph: GraphFrames, change, invariants=(), expected_generation: int | None = None, most: int = 1000) -> tuple[str, GraphFrames, list]:
    """Run a change (graph -> graph) under optimistic control: (outcome, graph, diagnostics).

    outcome: conflict if the generation moved, rejected with all diagnostics if an invariant (a function of
    the proposed graph giving a table of id and problem) finds any, else committed. An invariant that
    finds more than `most` problems is refused: invalid-invariant-result.
    """
    if expected_generation is not None and expected_generation != graph.generation:
        return "conflict", graph, []
    try:
        proposed = change(graph)
    except GraphQueryError as e:
        return "rejected", graph, [e.code]
    found = []
    for check in invariants:
        own = check(proposed).select("id", "problem").limit(most + 1).collect()
        if len(own) > most:
            raise GraphQueryError("invalid-invariant-result", most=most)
        found += [(r["id"], r["problem"]) for r in own]
    return ("rejected", graph, found) if found else ("committed", proposed, [])


def with_retries(read, change, write, attempts: int = 5):
    """Read the newest snapshot, change it and write it, again if another writer was faster; returns the written one."""
    for left in range(attempts - 1, -1, -1):
        proposed = change(read())
        try:
            write(proposed)
            return proposed
        except GraphQueryError as e:
            if e.code != "stale-generation" or not left:
                raise


def component_revisions(graph: GraphFrames, ids: DataFrame) -> DataFrame:
    """(resource, revision) of the components (id) that live: a hash of the component and of its outgoing relations, in no order.

    Revisions are a function of content, so they are taken where they are compared, of the rows that a batch names alone.
    """
    ids = cut(ids.select("id").distinct())  # Spark knows their size then, so few ids shuffle no relations
    own = graph.entities.join(ids, "id", "left_semi")
    out = graph.relations.join(ids.select(F.col("id").alias("source")), "source", "left_semi")

    def digest(df: DataFrame) -> Column:
        cells = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in sorted(df.columns)]
        return F.sha2(F.concat_ws("\x1f", *cells), 256)

    word = F.conv(F.substring("d", 1, 15), 16, 10).cast("decimal(38,0)")
    edges = out.select("source", digest(out).alias("d")).groupBy("source").agg(F.sum(word).alias("__s"), F.count(F.lit(1)).alias("__n"))
    met = own.select("id", digest(own).alias("d")).join(edges, F.col("id") == F.col("source"), "left")
    return met.select(F.col("id").alias("resource"), F.sha2(F.concat_ws(":", "d", F.coalesce(F.col("__s"), F.lit(0)).cast("string"), F.coalesce(F.col("__n"), F.lit(0)).cast("string")), 256).alias("revision"))


def commit_batch(spark, root: str, components: DataFrame, relations: DataFrame, aliases: DataFrame, expected: DataFrame, attempts: int = 5) -> tuple[str, int, list[str]]:
    """Apply a batch to the newest stored generation and commit it: (outcome, generation, resources that moved).

    expected: (resource, revision) as the writer saw them, null for what it is to create. Only those are compared, so
    writers of different components both commit, each on what the other left; of two that change one component the
    second is told `conflict`.
    """
    from ..sources import stores

    expected = cut(expected)
    for _ in range(attempts):
        graph = stores.read_generation(spark, root)
        actual = component_revisions(graph, expected.select(F.col("resource").alias("id")))
        moved = sorted(r["resource"] for r in stale_revisions(expected, actual).collect())  # of the batch's own list
        if moved:
            return "conflict", graph.generation, moved
        try:
            return "committed", stores.write_generation(apply_batch(graph, components, relations, aliases), root), []
        except GraphQueryError as e:
            if e.code not in ("stale-generation", "attempt-settled"):
                raise
    raise GraphQueryError("transaction-conflict", attempts=attempts)
