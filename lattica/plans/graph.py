"""The property graph as DataFrames, and what is derived from one snapshot of it."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_ascii, normalized, packed, unpacked
from .errors import GraphQueryError
from .lineage import cut, is_empty
from .payloads import searchable_parts

ENTITIES = "id string, kind string, name string, label string, summary string, intent string, type string, scale string, shared boolean, parent string"
RELATIONS = "id string, type string, source string, target string, description string"
ALIASES = "source string, target string"
#: frames that every snapshot has
ALWAYS = ("entities", "relations", "aliases")
_PAYLOAD = ("intent", "label", "name", "parent", "scale", "summary", "type")


@dataclass(frozen=True)
class GraphFrames:
    """One immutable snapshot: entities, relations and aliases of one generation.

    entities: id, kind, name, label, summary, intent, type, scale, shared, parent. relations: id, type,
    source, target, description. aliases: source, target. Null stands for an absent field. Entities may
    also have the open fields of payloads.py.
    """

    entities: DataFrame
    relations: DataFrame
    aliases: DataFrame
    generation: int = 0
    #: entities with `searchable`, where a store holds them
    index: DataFrame | None = None
    #: the relations again, stored by target
    incoming: DataFrame | None = None
    #: which rows of the index hold each string of three characters, where a store holds that
    grams: DataFrame | None = None
    #: where a store holds the tables behind these frames, by name
    stored: dict[str, str] = field(default_factory=dict)

    def with_frames(self, **frames) -> GraphFrames:
        derived = {"entities": ("index", "grams"), "relations": ("relations", "incoming"), "aliases": ("aliases",)}
        lost = {name for frame in frames for name in derived.get(frame, (frame,))}
        none = {name: None for name in lost - set(ALWAYS) - set(frames)}
        return replace(self, **none, stored={name: at for name, at in self.stored.items() if name not in lost}, **frames)

    def resolved(self) -> GraphFrames:
        """The snapshot with relation endpoints and parents rewritten to live entities through the aliases.

        An endpoint that neither lives nor has an alias stays; dangling_endpoints() reports it.
        """
        from ..operators.aliases import resolve_aliases

        if is_empty(self.aliases):
            return self
        final = cut(resolve_aliases(self.aliases).select(F.col("source").alias("__from"), F.col("resolved").alias("__to")))

        def rewritten(df: DataFrame, column: str) -> DataFrame:
            joined = df.join(final, F.col(column) == F.col("__from"), "left")
            return joined.withColumn(column, F.coalesce("__to", column)).drop("__from", "__to")

        relations = rewritten(rewritten(self.relations, "source"), "target")
        return self.with_frames(entities=rewritten(self.entities, "parent"), relations=relations)

    def searchable(self) -> DataFrame:
        """entities with `searchable`: normalised id, kind and string fields, one to a line."""
        if self.index is not None:
            return self.index.drop("ordinal")
        parts = [F.col(c) for c in ("id", "kind", *_PAYLOAD)]
        if "extensions" in self.entities.columns:
            parts = [F.col("id"), F.col("kind"), searchable_parts(self.entities)]
        joined = self.entities.withColumn("searchable", F.concat_ws("\n", *parts))
        plain = is_ascii(F.col("searchable"))  # apart, so that no row of these goes through Python
        return joined.where(plain).withColumn("searchable", F.lower("searchable")).unionByName(joined.where(~plain).withColumn("searchable", normalized(F.col("searchable"))))

    def catalog(self) -> DataFrame:
        """The light index: id, kind, searchable."""
        return self.searchable().select("id", "kind", "searchable")

    def adjacency(self) -> DataFrame:
        """Per entity its sorted incoming and outgoing relation ids; empty arrays for isolated ones."""
        none, own = F.lit(None).cast("binary"), packed(F.col("id"))
        side = lambda c, i, o, n: F.struct(c.alias("__on"), i.alias("incoming"), o.alias("outgoing"), F.lit(n).alias("__n"))
        ends = self.relations.select(F.explode(F.array(side(packed(F.col("target")), own, none, 0), side(packed(F.col("source")), none, own, 0))).alias("e"))
        rows = ends.unionByName(self.entities.select(side(own, none, none, 1).alias("e"))).select("e.*")
        ids = lambda c: F.sort_array(F.transform(F.collect_list(c), unpacked)).alias(c)
        # entities meet their relations in the one shuffle, whose ids are bytes
        both = rows.groupBy("__on").agg(ids("incoming"), ids("outgoing"), F.sum("__n").cast("int").alias("__n")).where("__n > 0")
        return both.withColumn("__k", F.explode(F.array_repeat(F.lit(1), F.col("__n")))).select(unpacked(F.col("__on")).alias("id"), "incoming", "outgoing")

    def fingerprint_rows(self) -> DataFrame:
        """(part, n, digest) of each table: order-free sums over SHA-256 row hashes, however rows are dealt."""

        def of(df: DataFrame, part: str) -> DataFrame:
            cells = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in sorted(df.columns)]
            row = F.sha2(F.concat_ws("\x1f", *cells), 256)
            words = [F.conv(F.substring(row, k, 8), 16, 10).cast("long") for k in (1, 9, 17, 25)]
            sums = [F.coalesce(F.sum(w), F.lit(0)).cast("string") for w in words]
            return df.select(*df.columns).agg(F.count(F.lit(1)).alias("n"), F.concat_ws(":", *sums).alias("digest")).select(F.lit(part).alias("part"), "n", "digest")

        return of(self.aliases, "aliases").unionByName(of(self.entities, "entities")).unionByName(of(self.relations, "relations"))

    def fingerprint(self) -> str:
        """sha256: of the three tables' digests; equal content gives equal fingerprints."""
        import hashlib

        rows = sorted((r["part"], r["n"], r["digest"]) for r in self.fingerprint_rows().collect())  # three rows
        return "sha256:" + hashlib.sha256(repr(rows).encode()).hexdigest()

    def identity(self) -> DataFrame:
        """One row (generation, fingerprint)."""
        return self.entities.sparkSession.createDataFrame([(self.generation, self.fingerprint())], "generation long, fingerprint string")

    def counts(self) -> DataFrame:
        """One row (entities, relations, aliases)."""
        n = F.count(F.lit(1))
        return self.entities.agg(n.alias("entities")).crossJoin(self.relations.agg(n.alias("relations"))).crossJoin(self.aliases.agg(n.alias("aliases")))


def load_graph(entities: DataFrame, relations: DataFrame, aliases: DataFrame, expected_kind: str | None = None, generation: int = 0) -> GraphFrames:
    """A checked snapshot: unique ids, aliases that end at live entities, endpoints that resolve, sound containment and scales.

    Raises GraphQueryError with the first failed check's code.
    """
    from ..operators.aliases import alias_problems
    from ..operators.derive import scale_violations
    from ..operators.invariants import has_duplicate_ids, lost_endpoints, parent_problems

    for df, code in ((entities, "duplicate-entity"), (relations, "duplicate-relation")):
        if has_duplicate_ids(df):
            raise GraphQueryError(code)
    graph = GraphFrames(entities, relations, aliases, generation)
    problems = alias_problems(aliases, entities).limit(1).collect()
    if problems:
        raise GraphQueryError(problems[0]["problem"], source=problems[0]["source"])
    graph = graph.resolved()
    if not is_empty(lost_endpoints(graph)):
        raise GraphQueryError("unknown-endpoint")
    held = cut(graph.entities.select("id", "parent", "scale"))
    unsound = parent_problems(held).limit(1).collect()
    if unsound:
        raise GraphQueryError(unsound[0]["problem"], id=unsound[0]["id"])
    if not is_empty(scale_violations(held)):
        raise GraphQueryError("scale-coarser-than-parent")
    if expected_kind and not is_empty(entities.where(F.col("kind") != expected_kind)):
        raise GraphQueryError("wrong-entity-kind")
    return graph
