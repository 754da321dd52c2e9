"""Containment: forests, depths, ancestors, cycles, orderings and the retirement fixpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import packed, unpacked
from ..plans.errors import GraphQueryError
from ..plans.lineage import cut, is_empty


def containment_depth(parents: DataFrame) -> DataFrame:
    """(id, depth, root) for rows (id, parent): steps to the topmost id, by pointer doubling.

    Rows on or below a cycle have no top and are left out. A parent that is no row's id counts as absent.
    """
    known = parents.select(F.col("id").alias("__id"))
    rows = parents.join(known, F.col("parent") == F.col("__id"), "left")
    state = cut(rows.select("id", F.col("__id").alias("up"), F.when(F.col("__id").isNull(), 0).otherwise(1).alias("depth"), F.coalesce("__id", "id").alias("root")))
    n, reach = state.count(), 1
    while reach <= n and not is_empty(state.where("up is not null")):
        ahead = state.select(F.col("id").alias("__s"), F.col("up").alias("__up"), F.col("depth").alias("__d"), F.col("root").alias("__root"))
        step = state.join(ahead, F.col("up") == F.col("__s"), "left")
        state = cut(step.select("id", F.col("__up").alias("up"), (F.col("depth") + F.coalesce("__d", F.lit(0))).alias("depth"), F.coalesce("__root", "root").alias("root")))
        reach *= 2
    return state.where("up is null").select("id", F.col("depth").cast("long").alias("depth"), "root")


def containment_cycles(parents: DataFrame) -> DataFrame:
    """(id) of the rows that lie on a containment cycle."""
    left = cut(parents.join(containment_depth(parents).select("id"), "id", "left_anti").select("id", "parent"))
    # what hangs below a cycle is peeled off from the leaves
    while True:
        inner = cut(left.join(left.select(F.col("parent").alias("id")).distinct(), "id", "left_semi"))
        if inner.count() == left.count():
            return inner.select("id")
        left = inner


def observed_forest(edges: DataFrame) -> DataFrame:
    """(child, parent, depth) from observed `contains` edges (container, child).

    Raises self-containment, ambiguous-containment (two containers of one child) or containment-cycle.
    """
    if not is_empty(edges.where(F.col("container") == F.col("child"))):
        raise GraphQueryError("self-containment")
    if not is_empty(edges.groupBy("child").agg(F.countDistinct("container").alias("n")).where("n > 1")):
        raise GraphQueryError("ambiguous-containment")
    one = edges.select(F.col("child").alias("id"), F.col("container").alias("parent")).distinct()
    tops = one.select(F.col("parent").alias("id")).distinct().join(one.select("id"), "id", "left_anti").withColumn("parent", F.lit(None).cast("string"))
    nodes = cut(one.unionByName(tops))
    depth = containment_depth(nodes)
    out = nodes.join(depth.select("id", "depth"), "id", "left")
    if not is_empty(out.where("depth is null")):
        raise GraphQueryError("containment-cycle")
    return out.select(F.col("id").alias("child"), "parent", "depth")


def ancestors(parents: DataFrame) -> DataFrame:
    """(id, ancestor, distance): every pair, level by level; the number of levels bounds the loop."""
    text = dict(parents.dtypes)["id"] == "string"
    parents = parents.select(*[packed(F.col(c)).alias(c) if text else F.col(c) for c in ("id", "parent")])  # bytes travel and are written
    known = parents.where("parent is not null").select(F.col("id").alias("ancestor"), F.col("parent").alias("__next"))
    level = cut(parents.where("parent is not null").select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")))
    out = level
    while not is_empty(level):
        up = level.join(known, "ancestor").where("__next <> id")
        up = up.select("id", F.col("__next").alias("ancestor"), (F.col("distance") + 1).alias("distance"))
        level = cut(up.join(out.select("id", "ancestor"), ["id", "ancestor"], "left_anti"))
        out = out.unionByName(level)  # tables that are written down already
    return out.withColumns({c: unpacked(F.col(c)) for c in ("id", "ancestor")}) if text else out


def retire(candidates: DataFrame, entities: DataFrame, relations: DataFrame, removable: DataFrame) -> DataFrame:
    """(id, depth) of the candidates that can go: the largest set with no surviving child or relation.

    removable: ids of relations that go anyhow. depth counts retired containers above; deepest go first.
    """
    own = candidates.select(F.col("id"), packed(F.col("id")).alias("__end")).distinct()
    # only relations that touch a candidate are looked up among the removable; bytes travel, and by the same join at any size
    ends = relations.select(F.explode(F.array(packed(F.col("source")), packed(F.col("target")))).alias("__end"), packed(F.col("id")).alias("__rel"))
    near = ends.join(own.select("__end").hint("shuffle_hash"), "__end", "left_semi")
    held = near.join(removable.select(packed(F.col("id")).alias("__rel")).hint("shuffle_hash"), "__rel", "left_anti").select("__end").distinct()
    left = cut(own.join(held.hint("shuffle_hash"), "__end", "left_anti").select("id"))
    children = entities.where("parent is not null").select(F.col("id").alias("__child"), F.col("parent").alias("id"))
    while True:
        alive = children.join(left.select(F.col("id").alias("__child")), "__child", "left_anti").select("id")
        kept = cut(left.join(alive, "id", "left_anti"))
        if kept.count() == left.count():
            break
        left = kept
    inside = left.join(entities.select("id", "parent"), "id")
    return containment_depth(inside).select("id", "depth")


def retire_selected(selector, entities: DataFrame, relations: DataFrame, removable: DataFrame) -> DataFrame:
    """retire() for the candidates (id) that a user's function picks from (entities, relations); unknown ids are refused."""
    candidates = selector(entities, relations).select("id")
    if not is_empty(candidates.join(entities.select("id"), "id", "left_anti")):
        raise GraphQueryError("unknown-retirement-candidate")
    return retire(candidates, entities, relations, removable)


def topological_order(nodes: DataFrame, needs: DataFrame) -> DataFrame:
    """(id, stage): after how many rounds all that a node needs is there; nodes (id), needs (id, on).

    Nodes on or behind a cycle have stage null.
    """
    text = dict(nodes.dtypes)["id"] == "string"
    if text:  # bytes travel and are written
        nodes, needs = nodes.select(packed(F.col("id")).alias("id")), needs.select(packed(F.col("id")).alias("id"), packed(F.col("on")).alias("on"))
    left = cut(nodes.select("id").distinct())
    open_ = cut(needs.join(left, "id").join(left.select(F.col("id").alias("on")), "on"))
    out, stage = None, 0
    while True:
        ready = cut(left.join(open_.select("id").distinct(), "id", "left_anti").withColumn("stage", F.lit(stage)))
        if is_empty(ready):
            break
        out = ready if out is None else out.unionByName(ready)
        left = cut(left.join(ready, "id", "left_anti"))
        open_ = cut(open_.join(ready.select(F.col("id").alias("on")), "on", "left_anti"))
        stage += 1
    rest = left.withColumn("stage", F.lit(None).cast("int"))
    out = rest if out is None else out.unionByName(rest)
    return out.withColumn("id", unpacked(F.col("id"))) if text else out


def overview(entities: DataFrame, roots: int = 10, children: int = 10, depth: int = 4, nodes: int = 50) -> DataFrame:
    """(position, depth, id, parent, truncated): a preorder walk in id order within small budgets.

    Each level is one join that keeps the first `children` of each parent; the path of ranks gives the
    preorder. truncated: what a node cuts off, `children` or `depth`; the walk stops after `nodes` rows,
    which is a bound of this report.
    """
    own = entities.select("id", "parent")
    rank = F.row_number().over(Window.partitionBy("parent").orderBy("id"))
    pad = lambda c: F.lpad(c.cast("string"), 6, "0")
    level = own.where("parent is null").orderBy("id").limit(roots + 1).withColumn("r", rank)
    level = cut(level.where(F.col("r") <= roots).select("id", "parent", pad(F.col("r")).alias("path"), F.lit(1).alias("depth")))
    shown, cuts = level, None
    for d in range(2, depth + 2):
        above = level.select(F.col("id").alias("parent"), F.col("path").alias("__p"))
        below = cut(own.join(F.broadcast(above), "parent").withColumn("r", rank).where(F.col("r") <= children + 1))
        if d == depth + 1:
            more = below.select(F.col("parent").alias("id"), F.lit("depth").alias("truncated")).distinct()
        else:
            more = below.where(F.col("r") > children).select(F.col("parent").alias("id"), F.lit("children").alias("truncated"))
            level = cut(below.where(F.col("r") <= children).select("id", "parent", F.concat_ws("/", "__p", pad(F.col("r"))).alias("path"), F.lit(d).alias("depth")))
            shown = shown.unionByName(level)
        cuts = more if cuts is None else cuts.unionByName(more)
    walk = shown.join(cuts, "id", "left").orderBy("path").limit(nodes)  # at most 10 * 10 ** 3 rows come here
    return walk.withColumn("position", F.row_number().over(Window.orderBy("path"))).select("position", "depth", "id", "parent", "truncated")
