"""Long lists as rows: an owner's items in chunks of bounded size, read page by page with a cursor inside the owner."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import packed, unpacked
from .graph import GraphFrames
from .lineage import cut, is_empty
from .ordering import with_rank, with_rank_in
from .paging import Page, canonical, decode_cursor, page

#: Items that one row holds at most.
CHUNK = 1000
#: Rows of one owner that one task may gather.
MOST = 100_000
#: Buckets of owners' hashes that are counted before any hash is.
BUCKETS = 65536
#: Ordinals that one row of a gram's postings spans.
SPAN = 65536
GRAM = 3
#: What `\\s` stands for: no gram holds any.
_SPACES = np.array([9, 10, 11, 12, 13, 32], np.uint32)


def _as_is(col: Column) -> Column:
    return col


def _large_owners(hashed: DataFrame, most: int) -> DataFrame | None:
    """(__h) of the owners' hashes with more than `most` rows; None if there are none.

    Buckets of hashes are counted first, some thousand rows a task whatever the table has; hashes are counted in full buckets only.
    """
    bucket = F.pmod("__h", F.lit(BUCKETS)).alias("__b")
    full = cut(hashed.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("__b"))
    if is_empty(full):
        return None
    some = hashed.withColumn("__b", bucket).join(F.broadcast(full), "__b", "left_semi")  # BUCKETS rows at most
    large = cut(some.groupBy("__h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("__h"))
    return None if is_empty(large) else large


def chunked(
    rows: DataFrame, owner: str, item: str, size: int = CHUNK, most: int = MOST, owners: DataFrame | None = None,
    owner_of: Callable[[Column], Column] = _as_is, item_of: Callable[[Column], Column] = _as_is,
) -> DataFrame:
    """(owner, chunk, first, last, n, items) of rows (owner, item), each item of an owner once, sorted across its chunks.

    An owner's items meet in one task, where they are cut into chunks. Owners with more than `most` rows, found by counts of
    hashes, go another way: their chunks are cut by rank over the whole table, so an owner with most of the rows fills no task and no row.

    owners: (owner) that have lists, each once; all by default. owner_of, item_of: what makes owners and items of the rows' columns, where
    these travel as something shorter, such as ids as bytes.
    """
    one = rows.select(F.col(owner).alias("owner"), F.col(item).alias("item"))
    hashed = one.withColumn("__h", F.xxhash64("owner"))
    large = _large_owners(hashed.select("__h"), most)
    few = one if large is None else hashed.join(F.broadcast(large), "__h", "left_anti").drop("__h")  # at most one row in `most`
    if owners is not None:  # they meet their items in the one shuffle
        few = few.withColumn("own", F.lit(False)).unionByName(owners.select("owner", F.lit(None).cast(one.schema["item"].dataType).alias("item"), F.lit(True).alias("own")))
    dealt = few.groupBy("owner")  # an owner travels once a task, with what the task has of it
    items = F.sort_array(F.transform(F.collect_set("item"), item_of)).alias("__all")
    all_ = dealt.agg(items) if owners is None else dealt.agg(items, F.max("own").alias("own")).where("own").drop("own")
    all_ = all_.withColumn("owner", owner_of(F.col("owner")))
    starts = F.sequence(F.lit(0), F.floor((F.size("__all") - 1) / size).cast("long"))
    cuts = F.transform(starts, lambda c: F.struct(c.alias("chunk"), F.slice("__all", (c * size + 1).cast("int"), F.lit(size)).alias("items")))
    lists = all_.where(F.size("__all") > 0).select("owner", F.explode(cuts).alias("c")).select("owner", "c.chunk", "c.items")
    if large is not None:
        many = hashed.join(F.broadcast(large), "__h", "left_semi").select("owner", "item")
        many = many if owners is None else many.join(owners.select("owner"), "owner", "left_semi")
        ranked = with_rank_in(many.distinct().select(owner_of(F.col("owner")).alias("owner"), item_of(F.col("item")).alias("item")), "owner", "item", name="__r")
        by_rank = ranked.groupBy("owner", F.floor(F.col("__r") / size).alias("chunk")).agg(F.sort_array(F.collect_list("item")).alias("items"))
        lists = lists.unionByName(by_rank)
    return lists.select("owner", "chunk", F.col("items")[0].alias("first"), F.element_at("items", -1).alias("last"), F.size("items").alias("n"), "items")


def list_page(lists: DataFrame, owner: str, limit: int, query: dict, graph: GraphFrames, cursor: str | None = None, fingerprint: str = "") -> Page:
    """The next items of one owner; only the chunks that end at the cursor or behind it are opened."""
    own = lists.where(F.col("owner") == owner)
    if cursor is not None and decode_cursor(cursor)["query"] == canonical({"query": query, "fingerprint": fingerprint}):
        own = own.where(F.col("last") >= decode_cursor(cursor)["anchor"])
    return page(own.select(F.explode("items").alias("item")), "item", limit, query, graph, cursor, fingerprint)


def adjacency_lists(graph: GraphFrames, size: int = CHUNK) -> DataFrame:
    """The relation ids of each entity in chunks, by owner `<id>:outgoing` and `<id>:incoming`; isolated entities have none."""
    side = lambda column, way: F.struct(F.concat(F.unhex(F.lit(way)), packed(F.col(column))).alias("owner"), packed(F.col("id")).alias("id"))
    # ids travel as bytes, a first byte tells the two lists of an entity apart
    rows = graph.relations.select(F.explode(F.array(side("source", "00"), side("target", "01"))).alias("e")).select("e.*")
    way = lambda c: F.when(F.hex(F.substring(c, 1, 1)) == "00", ":outgoing").otherwise(":incoming")
    own = lambda c: F.concat(unpacked(F.substring(c, F.lit(2), F.length(c))), way(c))
    return chunked(rows, "owner", "id", size, owner_of=own, item_of=unpacked)


def all_pages(df: DataFrame, key: str, limit: int) -> DataFrame:
    """Every row with the number of its page, pages of `limit` in order of key: a whole enumeration as one ordered scan."""
    return with_rank(df, key, name="__place").withColumn("page", F.floor(F.col("__place") / limit)).drop("__place")


def gram_lists(index: DataFrame) -> DataFrame:
    """(gram, span, n, ordinals): which rows of an index (ordinal, searchable) hold each string of three characters.

    Grams with white space are left out, as no search term has any. One row covers SPAN ordinals, so none grows with the table.
    What a batch of rows holds of a gram travels as one row, two bytes an ordinal.
    """
    pieces = index.select("ordinal", "searchable").mapInArrow(_grams_of_rows, "gram string, span long, held binary")
    met = pieces.groupBy("gram", "span").agg(F.collect_list("held").alias("held"))
    return met.mapInArrow(_ordinals_of_grams, "gram string, span long, n int, ordinals array<long>")


def _grams_of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ordinal, searchable) to (gram, span, held): places in the span, two bytes each, ascending."""
    for batch in batches:
        ordinals = batch.column(0).to_numpy(zero_copy_only=False)
        order = np.argsort(ordinals)
        ordinals, texts = ordinals[order], batch.column(1).take(pa.array(order)).to_pylist()
        edges = np.flatnonzero(np.diff(ordinals // SPAN)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(texts)]):
            if a < b:
                yield from _grams_of_span(int(ordinals[a]) // SPAN, (ordinals[a:b] % SPAN).astype("<u2"), [t or "" for t in texts[a:b]])


def _grams_of_span(span: int, places: np.ndarray, texts: list[str]) -> Iterator[pa.RecordBatch]:
    size = np.array([len(t) + 1 for t in texts])
    if size.sum() > 2_000_000 and len(texts) > 1:
        half = len(texts) // 2
        yield from _grams_of_span(span, places[:half], texts[:half])
        yield from _grams_of_span(span, places[half:], texts[half:])
        return
    # a line end behind each text, so that no string of three characters is in two
    signs, code = np.unique(np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le"), "<u4"), return_inverse=True)
    a, free = len(signs), ~np.isin(signs, _SPACES)[code]
    at = np.flatnonzero(np.logical_and.reduce([free[k : len(free) - GRAM + 1 + k] for k in range(GRAM)])) if len(free) >= GRAM else np.empty(0, np.int64)
    if not len(at):
        return
    gram = (code[at] * a + code[at + 1]) * a + code[at + 2]
    names, gram = np.unique(gram, return_inverse=True)
    both = np.unique(gram * len(texts) + np.repeat(np.arange(len(texts)), size)[at])
    gram, held = both // len(texts), places[both % len(texts)].tobytes()
    edge = (np.searchsorted(gram, np.arange(len(names) + 1)) * 2).tolist()
    letters = np.stack([names // (a * a), names // a % a, names % a], 1)
    said = signs[letters].astype("<u4").tobytes().decode("utf-32-le")
    cols = [pa.array([said[k : k + GRAM] for k in range(0, len(said), GRAM)]), pa.array(np.full(len(names), span, np.int64)), pa.array([held[x:y] for x, y in zip(edge[:-1], edge[1:])], pa.binary())]
    yield pa.RecordBatch.from_arrays(cols, ["gram", "span", "held"])


def _ordinals_of_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, span, parts of held) to (gram, span, n, ordinals), about a million ordinals at a time."""
    for big in batches:
        held = [b"".join(parts.as_py()) for parts in big.column(2)]
        cuts = np.flatnonzero(np.diff(np.cumsum([len(h) for h in held]) // 2_000_000)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), big.num_rows]):
            if a == b:
                continue
            n = np.array([len(h) // 2 for h in held[a:b]])
            span = big.column(1).slice(a, b - a)
            row = np.repeat(np.arange(b - a), n)
            at = np.frombuffer(b"".join(held[a:b]), "<u2")
            at = at[np.lexsort((at, row))].astype(np.int64) + span.to_numpy()[row] * SPAN
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(at))
            yield pa.RecordBatch.from_arrays([big.column(0).slice(a, b - a), span, pa.array(n, pa.int32()), lists], ["gram", "span", "n", "ordinals"])


def gram_candidates(index: DataFrame, grams: DataFrame, terms: list[str], listed: int = 500) -> DataFrame | None:
    """Rows of the index that may hold all terms, by the rarest grams of the terms; None where a scan is no dearer.

    That is where no term has three characters, or where even the rarest gram is in more than a twentieth of the rows.

    Which grams are rare is one small read of their counts. Up to `listed` candidates are read by a filter on their ordinals that
    skips row groups, more by a semi-join.
    """
    wanted = sorted({t[i : i + GRAM] for t in terms for i in range(len(t) - GRAM + 1)})
    if not wanted:
        return None
    counts = dict(grams.where(F.col("gram").isin(wanted)).groupBy("gram").agg(F.sum("n")).collect())  # as many rows as the text has grams
    if len(counts) < len(wanted):
        return index.limit(0)
    rare = sorted(wanted, key=lambda g: (counts[g], g))
    if counts[rare[0]] * 20 > index.count():  # the rows' number stands in the files' footers
        return None
    rare = [g for g in rare if counts[g] <= 4 * counts[rare[0]]][:4]
    found = grams.where(F.col("gram").isin(rare)).select("gram", F.explode("ordinals").alias("ordinal"))
    both = found.groupBy("ordinal").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(rare)).select("ordinal")
    few = [r[0] for r in both.limit(listed + 1).collect()] if counts[rare[0]] <= 100 * listed else None
    if few is not None and len(few) <= listed:
        return index.where(F.col("ordinal").isin(few)) if few else index.limit(0)
    return index.join(both, "ordinal", "left_semi")
