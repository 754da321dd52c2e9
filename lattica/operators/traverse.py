"""Bounded breadth-first traversal of relations, as a shortest-distance loop and one join."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.errors import GraphQueryError
from ..plans.graph import GraphFrames
from ..plans.lineage import cut, is_empty

DIRECTIONS = ("outgoing", "incoming", "both")


@dataclass(frozen=True)
class TraversalBounds:
    """Work limits; None switches one off."""

    depth: int = 16
    entities: int | None = None
    relations: int | None = None
    visits: int | None = None


#: Up to so many entities a hop is asked for by a list, which a store sorted by source and target answers from few row groups.
LISTED = 500


def _steps(relations: DataFrame, direction: str, incoming: DataFrame | None = None) -> DataFrame:
    """(relation, type, from, entity, direction): each relation as it may be walked; incoming: relations stored by target."""
    out = relations.select(F.col("id").alias("relation"), "type", F.col("source").alias("from"), F.col("target").alias("entity"), F.lit("outgoing").alias("direction"))
    back = (relations if incoming is None else incoming).select(F.col("id").alias("relation"), "type", F.col("target").alias("from"), F.col("source").alias("entity"), F.lit("incoming").alias("direction"))
    return {"outgoing": out, "incoming": back, "both": out.unionByName(back)}[direction]


def _from_any(steps: DataFrame, ids: DataFrame) -> DataFrame:
    """The steps that start at one of the entities (from); few of them become a filter that reaches the scan."""
    few = ids.select("from").limit(LISTED + 1).collect()
    if len(few) <= LISTED:
        return steps.where(F.col("from").isin([r[0] for r in few]))
    return steps.join(ids.select("from"), "from", "left_semi")


def distances(steps: DataFrame, root: str, depth: int) -> DataFrame:
    """(entity, distance) of all entities fewer than `depth` hops from root, root included."""
    frontier = steps.sparkSession.createDataFrame([(root, 0)], "entity string, distance int")
    seen = frontier = cut(frontier)
    for hop in range(1, depth):
        # the frontier is a set of entities, so a hub is expanded once and its edges are dealt by Spark
        near = _from_any(steps, frontier.select(F.col("entity").alias("from"))).select("entity").distinct()
        frontier = cut(near.join(seen, "entity", "left_anti").select("entity", F.lit(hop).alias("distance")))
        if is_empty(frontier):
            break
        seen = cut(seen.unionByName(frontier))
    return seen


def traverse(
    graph: GraphFrames, root: str, depth: int, direction: str = "both", relation_type: str | None = None,
    bounds: TraversalBounds = TraversalBounds(),
) -> DataFrame:
    """(depth, relation, type, direction, from, entity): every relation once, at the first depth it is met.

    The root's alias is resolved. A relation counts from its nearest end; of equals the smaller `from`
    and then `incoming` wins. relation_type filters before expansion. The closed form equals the walk
    frontier by frontier: a relation is first met when the nearer of its ends is expanded.
    """
    if direction not in DIRECTIONS or not 1 <= depth <= bounds.depth:
        raise GraphQueryError("invalid-traversal", direction=direction, depth=depth)
    from .query import resolve_id

    start = resolve_id(graph, root)
    every = _steps(graph.relations, direction, graph.incoming)
    steps = every.where(F.col("type") == relation_type) if relation_type else every
    near = distances(steps, start, depth)
    if bounds.visits is not None:
        # what the walk examines, refused types included
        seen = every.join(near.select(F.col("entity").alias("from")), "from", "left_semi").count()
        if seen > bounds.visits:
            raise GraphQueryError("traversal-relation-visit-bound-exceeded", visits=seen)
    met = _from_any(steps, near.select(F.col("entity").alias("from"))).join(near.select(F.col("entity").alias("from"), (F.col("distance") + 1).alias("depth")), "from")
    first = F.min(F.struct("depth", "from", "direction", "type", "entity")).alias("h")
    hits = met.groupBy("relation").agg(first).select("h.depth", "relation", "h.type", "h.direction", "h.from", "h.entity")
    if bounds.relations is not None and hits.count() > bounds.relations:
        raise GraphQueryError("traversal-relation-bound-exceeded")
    if bounds.entities is not None and hits.select("entity").where(F.col("entity") != start).distinct().count() + 1 > bounds.entities:
        raise GraphQueryError("traversal-entity-bound-exceeded")
    return hits


def descendants(entities: DataFrame, root: str) -> DataFrame:
    """(id, distance) of root and all that it contains, however deep; a cycle is entered once."""
    below = entities.select("id", "parent")
    frontier = seen = cut(entities.sparkSession.createDataFrame([(root, 0)], "id string, distance int"))
    hop = 0
    while not is_empty(frontier):
        hop += 1
        near = below.join(frontier.select(F.col("id").alias("parent")), "parent", "left_semi").select("id")
        frontier = cut(near.join(seen, "id", "left_anti").select("id", F.lit(hop).alias("distance")))
        seen = cut(seen.unionByName(frontier))
    return seen
