"""Point reads, listings, searches and exports over one snapshot, unpaged and in pages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.errors import GraphQueryError
from ..plans.graph import GraphFrames
from ..plans.lineage import cut
from ..plans.lists import CHUNK, chunked, gram_candidates
from ..plans.ordering import with_rank_in
from ..plans.paging import Page, canonical_size, page
from ..plans.payloads import extension_is, is_extension, with_open_fields
from .aliases import resolve_aliases

#: Hops of one alias chain that are followed one by one; longer ones go by doubling.
MOST_HOPS = 16
_FIELDS = ("id", "intent", "label", "name", "scale", "summary", "type")


def resolve_id(graph: GraphFrames, id_: str) -> str:
    """The live id behind id_ (itself or through its aliases); raises unknown-entity."""
    if graph.entities.where(F.col("id") == id_).select("id").limit(1).collect():
        return id_
    own, met = id_, {id_}
    for _ in range(MOST_HOPS):  # one chain, a filtered read a hop: the table of aliases is not resolved as a whole
        ahead = graph.aliases.where(F.col("source") == own).select("target").limit(1).collect()
        if not ahead or ahead[0][0] in met:
            break
        own = ahead[0][0]
        met.add(own)
        if graph.entities.where(F.col("id") == own).select("id").limit(1).collect():
            return own
    else:
        found = resolve_aliases(graph.aliases).where(F.col("source") == own).select("resolved").limit(1).collect()
        if found and graph.entities.where(F.col("id") == found[0][0]).limit(1).count():
            return found[0][0]
    raise GraphQueryError("unknown-entity", id=id_)


def exact_entity(graph: GraphFrames, id_: str) -> DataFrame:
    return graph.entities.where(F.col("id") == resolve_id(graph, id_))


def exact_entities(graph: GraphFrames, ids: list[str]) -> DataFrame:
    """The entities of a list in its order (column position), aliases not followed; any miss fails."""
    wanted = graph.entities.sparkSession.createDataFrame(list(enumerate(ids)), "position int, id string")
    found = graph.entities.join(F.broadcast(wanted), "id")  # the request's own list
    if found.select("position").count() != len(ids):
        raise GraphQueryError("unknown-entity")
    return found


def resolve_ids(graph: GraphFrames, ids: DataFrame) -> DataFrame:
    """(requested, id) for rows (requested): the live id itself or the one behind its aliases; null if unknown."""
    live = graph.entities.select(F.col("id").alias("__live"))
    ends = resolve_aliases(graph.aliases).select(F.col("source").alias("__s"), F.col("resolved").alias("__r"))
    joined = ids.select("requested").join(ends, F.col("requested") == F.col("__s"), "left").withColumn("__id", F.coalesce("__r", "requested"))
    return joined.join(live, F.col("__id") == F.col("__live"), "left").select("requested", F.col("__live").alias("id"))


def exact_relation(graph: GraphFrames, id_: str) -> DataFrame:
    found = graph.relations.where(F.col("id") == id_)
    if not found.limit(1).count():
        raise GraphQueryError("unknown-relation", id=id_)
    return found


def catalog_entry(graph: GraphFrames, id_: str) -> DataFrame:
    return graph.catalog().where(F.col("id") == id_)


def _criteria(payload: dict | None) -> Column:
    out = F.lit(True)
    for field, value in sorted((payload or {}).items()):
        if is_extension(field):
            out = out & extension_is(F.col("extensions"), field, value)
        else:
            out = out & (F.col(field).isNull() if value is None else S.payload_is(F.col(field), value))
    return out


def entities_where(graph: GraphFrames, kind: str | None = None, payload: dict | None = None) -> DataFrame:
    """Entities of a kind whose fields equal the criteria.

    An absent field matches only None; of an extension, None asks for a null that is there.
    """
    out = graph.entities
    if any(is_extension(field) for field in payload or {}):
        out = with_open_fields(out)
    out = out.where(_criteria(payload)).select(*graph.entities.columns)
    return out.where(F.col("kind") == kind) if kind else out


def search_entities(graph: GraphFrames, text: str, kind: str | None = None, payload: dict | None = None) -> DataFrame:
    """Entities whose searchable text contains every term of the text, as substrings, without ranking.

    A stored snapshot with grams reads only the rows that hold the rarest grams of the terms, and checks those.
    """
    terms = S.search_terms(text)
    near = gram_candidates(graph.index, graph.grams, terms) if graph.grams is not None else None
    rows = graph.searchable() if near is None else near.drop("ordinal")
    found = rows.where(S.contains_all(F.col("searchable"), terms)).drop("searchable")
    return entities_where(graph.with_frames(entities=found), kind, payload)


def search_blueprint(graph: GraphFrames, bindings: DataFrame, text: str, scale: str | None = None, shared: bool | None = None) -> DataFrame:
    """Components that match, with `evidence_bound`: whether a present binding points at them."""
    payload = {k: v for k, v in (("scale", scale), ("shared", shared)) if v is not None}
    return with_evidence(graph, search_entities(graph, text, "component", payload), bindings)


def with_evidence(graph: GraphFrames, entities: DataFrame, bindings: DataFrame) -> DataFrame:
    bound = bindings.where("present").select(F.col("component_id").alias("id")).distinct().withColumn("__b", F.lit(True))
    return entities.join(bound, "id", "left").withColumn("evidence_bound", F.coalesce("__b", F.lit(False))).drop("__b")


def list_components(graph: GraphFrames, scale: str | None = None, shared: bool | None = None) -> DataFrame:
    """All components; here an absent `shared` counts as false."""
    out = graph.entities.where(F.col("kind") == "component")
    if scale is not None:
        out = out.where(S.payload_is(F.col("scale"), scale))
    return out if shared is None else out.where(S.shared_is(F.col("shared"), shared))


def list_roots(graph: GraphFrames, **filters) -> DataFrame:
    return list_components(graph, **filters).where("parent is null")


def list_children(graph: GraphFrames, parent: str, **filters) -> DataFrame:
    """Members of a component, its alias resolved; an unknown parent has none."""
    try:
        own = resolve_id(graph, parent)
    except GraphQueryError:
        own = parent
    return list_components(graph, **filters).where(F.col("parent") == own)


def children_of(graph: GraphFrames, parent: str | None) -> DataFrame:
    """Null-safe member listing: None gives the roots."""
    return list_components(graph).where(F.col("parent").eqNullSafe(F.lit(parent)))


def phrase_search(entities: DataFrame, text: str) -> DataFrame:
    """The frozen snapshot's search: the whole trimmed phrase inside one of seven named fields."""
    phrase = text.strip().lower()
    if not phrase or len(phrase) > 256:
        raise GraphQueryError("invalid-search-text")
    hit = F.lit(False)
    for field in _FIELDS:
        hit = hit | F.coalesce(F.contains(F.lower(field), F.lit(phrase)), F.lit(False))
    return entities.where(hit)


def offset_page(df: DataFrame, order: str, offset: int, limit: int) -> DataFrame:
    """A page of a frozen snapshot by position."""
    return df.orderBy(order).offset(offset).limit(limit)


def incident_relations(graph: GraphFrames, id_: str, direction: str = "both") -> DataFrame:
    """(relation, type, direction, from, entity, entity_name) of one entity's relations, with the neighbour."""
    from .traverse import _steps

    steps = _steps(graph.relations, direction, graph.incoming).where(F.col("from") == id_)
    other = graph.entities.select(F.col("id").alias("entity"), F.coalesce("label", "name", "id").alias("entity_name"))
    return steps.join(other, "entity").select("relation", "type", "direction", "from", "entity", "entity_name")


def relations_view(graph: GraphFrames) -> DataFrame:
    """Typed relations with their labels on a drawing."""
    return graph.relations.select("id", "type", "source", "target", "description", S.relation_label(F.col("type")).alias("label"))


def component_detail(
    graph: GraphFrames, id_: str, bindings: DataFrame, limit: int = 100, cursor: str | None = None, measurements: DataFrame | None = None, paths: DataFrame | None = None, each: int = 32
) -> tuple[DataFrame, Page]:
    """A component with its evidence flag, and a page of its outgoing relations.

    measurements and paths add what with_observations() says of the component; only its own rows of them are read.
    """
    own = resolve_id(graph, id_)
    view = with_evidence(graph, graph.entities.where(F.col("id") == own), bindings)
    if measurements is not None and paths is not None:
        view = with_observations(view, measurements.where(F.col("component") == own), paths.where(F.col("component") == own), each)
    out = graph.relations.where(F.col("source") == own)
    return view, page(out, "id", limit, {"op": "component", "id": own}, graph, cursor)


def static_detail(graph: GraphFrames, id_: str) -> DataFrame:
    """The frozen snapshot's detail: incoming and outgoing relations of a component."""
    return graph.relations.where((F.col("source") == id_) | (F.col("target") == id_))


def export_blueprint(graph: GraphFrames, bindings: DataFrame | None = None, page_of: DataFrame | None = None) -> DataFrame:
    """Components (all, or those of a page) with all their outgoing relations as an array sorted by id."""
    own = (page_of if page_of is not None else list_components(graph)).select("id", "name", "scale", "parent")
    if page_of is None:
        full = _with_outgoing(graph, own)
        return full if bindings is None else with_evidence(graph, full, bindings)
    out = graph.relations.join(own.select(F.col("id").alias("source")), "source", "left_semi")
    out = out.groupBy(F.col("source").alias("id")).agg(F.sort_array(F.collect_list(F.struct(F.col("id").alias("relation"), "type", "target"))).alias("relations"))
    full = own.join(out, "id", "left").withColumn("relations", F.coalesce("relations", F.array().cast(out.schema["relations"].dataType)))
    return full if bindings is None else with_evidence(graph, full, bindings)


def _with_outgoing(graph: GraphFrames, own: DataFrame) -> DataFrame:
    """Components with their outgoing relations; both meet in one shuffle, in which ids are bytes."""
    held = F.struct(S.packed(F.col("id")).alias("relation"), "type", S.packed(F.col("target")).alias("target"))
    rows = graph.relations.select(S.packed(F.col("source")).alias("__on"), held.alias("item"))
    fields = own.select(S.packed(F.col("id")).alias("__on"), F.struct("name", "scale", "parent").alias("own"))
    both = rows.unionByName(fields, allowMissingColumns=True).groupBy("__on").agg(F.collect_list("own").alias("own"), F.collect_list("item").alias("items"))
    said = F.transform("items", lambda r: F.struct(S.unpacked(r["relation"]).alias("relation"), r["type"].alias("type"), S.unpacked(r["target"]).alias("target")))
    return both.withColumn("own", F.explode("own")).select(S.unpacked(F.col("__on")).alias("id"), "own.*", F.sort_array(said).alias("relations"))


def with_observations(components: DataFrame, measurements: DataFrame, paths: DataFrame, each: int = 32) -> DataFrame:
    """Components (id) with `measurements` and `paths`, sorted, and `paths_left`, how many of the paths are not listed.

    measurements: what derive.single_measurements() gives, a handful per scanner. paths: (component, project, scanner,
    resource), of which the first `each` are listed, taken by rank: a component may have any number.
    """
    m = measurements.groupBy(F.col("component").alias("id")).agg(F.sort_array(F.collect_list(F.struct("project", "scanner", "instance", "version", "value"))).alias("measurements"))
    key = F.struct("project", "scanner", "resource")
    ranked = with_rank_in(paths.select(F.col("component").alias("id"), key.alias("p")).distinct(), "id", "p", name="__r")
    p = ranked.groupBy("id").agg(F.sort_array(F.collect_list(F.when(F.col("__r") < each, F.col("p")))).alias("paths"), F.greatest(F.lit(0), F.max("__r_of") - each).cast("long").alias("paths_left"))
    full = components.join(m, "id", "left").join(p, "id", "left")
    none = {c: F.array().cast(full.schema[c].dataType) for c in ("measurements", "paths")}
    return full.withColumns({c: F.coalesce(c, e) for c, e in none.items()}).na.fill(0, ["paths_left"])


def export_pages(graph: GraphFrames, bindings: DataFrame, limit: int = 25, most_pages: int = 100, most_bytes: int | None = None) -> Iterator[Page]:
    """The whole export in pages of one generation, joined once and written down; raises export-bound-exceeded if `most_pages` don't hold it.

    most_bytes: what a page may have as JSON; raises page-too-large.
    """
    fingerprint, cursor = graph.fingerprint(), None
    full = cut(export_blueprint(graph, bindings))
    for _ in range(most_pages):
        own = page(full.select("id"), "id", limit, {"op": "export"}, graph, cursor, fingerprint)  # ids alone come from every task
        rows = full.where(F.col("id").isin([r["id"] for r in own.items])).collect() if own.items else []
        own = replace(own, items=sorted(rows, key=lambda r: r["id"]))
        if most_bytes is not None:
            canonical_size(own.items, most_bytes)
        yield own
        cursor = own.next_cursor
        if cursor is None:
            return
    raise GraphQueryError("export-bound-exceeded", pages=most_pages)


def export_rows(graph: GraphFrames, bindings: DataFrame, measurements: DataFrame, paths: DataFrame, size: int = CHUNK) -> DataFrame:
    """The export as rows of bounded size: place, id, part, chunk, component, relations, paths.

    part 0 is the component with its evidence flag and measurements, part 1 a chunk of its outgoing relations, part 2 a chunk of the
    paths it was seen in. In order of `place` a component comes first, then its chunks, so pages of rows are pages of the export however
    many relations a component has. measurements: what derive.single_measurements() gives; paths: component, project, scanner, resource.
    """
    own = list_components(graph).select("id", "name", "scale", "parent")
    m = measurements.groupBy(F.col("component").alias("id")).agg(F.sort_array(F.collect_list(F.struct("project", "scanner", "instance", "version", "value"))).alias("measurements"))
    full = with_evidence(graph, own.join(m, "id", "left"), bindings)
    full = full.withColumn("measurements", F.coalesce("measurements", F.array().cast(full.schema["measurements"].dataType)))
    # components meet what they own in one shuffle, in which ids are bytes
    owners = own.select(S.packed(F.col("id")).alias("owner"))
    relation = F.struct(S.packed(F.col("id")).alias("relation"), "type", S.packed(F.col("target")).alias("target"))
    said = lambda r: F.struct(S.unpacked(r["relation"]).alias("relation"), r["type"].alias("type"), S.unpacked(r["target"]).alias("target"))
    rel = chunked(graph.relations.select(S.packed(F.col("source")).alias("source"), relation.alias("item")), "source", "item", size, owners=owners, owner_of=S.unpacked, item_of=said)
    path = F.struct("project", "scanner", "resource").alias("item")
    seen = chunked(paths.select(S.packed(F.col("component")).alias("component"), path), "component", "item", size, owners=owners, owner_of=S.unpacked)
    none = {"component": F.lit(None), "relations": F.lit(None), "paths": F.lit(None)}
    first = full.select("id", F.struct("name", "scale", "parent", "evidence_bound", "measurements").alias("component"))
    kinds = {"component": first.schema["component"].dataType, "relations": rel.schema["items"].dataType, "paths": seen.schema["items"].dataType}

    def rows(df: DataFrame, part: int, id_: str, chunk: Column, name: str, value: str) -> DataFrame:
        cells = [(F.col(value) if c == name else e).cast(kinds[c]).alias(c) for c, e in none.items()]
        place = F.concat_ws(":", F.col(id_), F.lit(str(part)), F.lpad(chunk.cast("string"), 10, "0"))
        return df.select(place.alias("place"), F.col(id_).alias("id"), F.lit(part).alias("part"), chunk.cast("long").alias("chunk"), *cells)

    out = rows(first, 0, "id", F.lit(0), "component", "component").unionByName(rows(rel, 1, "owner", F.col("chunk"), "relations", "items"))
    return out.unionByName(rows(seen, 2, "owner", F.col("chunk"), "paths", "items"))
