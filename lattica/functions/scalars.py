"""Scalar expressions over entity, relation and evidence columns."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

#: The scale ladder, coarsest first, and the grammar of tokens and ids.
SCALES = ("system", "domain", "part", "element")
KIND_TOKEN = r"^[a-z][a-z0-9]*([.-][a-z0-9]+)*$"
OPEN_TOKEN = r"^[a-z][a-z0-9]*([._-][a-z0-9]+)*$"
ENTITY_ID = r"^ent_[0-9a-f]{32}$"
RELATION_ID = r"^rel_[0-9a-f]{32}$"
EXTENSION_KEY = r"^[a-z][a-z0-9-]*[:/][A-Za-z0-9_.-]+$"
LABEL_LIMIT, SUMMARY_LIMIT, DOMAIN_LIMIT = 80, 280, 253


def minted_id(prefix: str, *parts) -> Column:
    """A reproducible identity: prefix and the md5 of the natural key's parts joined by ':'."""
    cells = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.concat(F.lit(prefix), F.md5(F.concat_ws(":", *[c.cast("string") for c in cells])))


def packed(col: Column) -> Column:
    """An id as bytes, to be shuffled and compared in place of the text: 17 for a minted id, one more than its text for any other."""
    kind, digits = F.substring(col, 1, 4), F.substring(col, 5, 32)
    minted = (F.octet_length(col) == 36) & kind.isin("ent_", "rel_") & F.unhex(digits).isNotNull() & (F.lower(digits) == digits)
    return F.when(minted, F.unhex(F.concat(F.when(kind == "ent_", "00").otherwise("01"), digits))).otherwise(F.concat(F.unhex(F.lit("02")), col.cast("binary")))


def unpacked(col: Column) -> Column:
    """The id that packed() made bytes of."""
    first, rest = F.hex(F.substring(col, 1, 1)), F.substring(col, F.lit(2), F.length(col))
    return F.when(first == "02", rest.cast("string")).otherwise(F.concat(F.when(first == "00", "ent_").otherwise("rel_"), F.lower(F.hex(rest))))


def kind_valid(col: Column) -> Column:
    return F.coalesce(col.rlike(KIND_TOKEN), F.lit(False))


def open_token_valid(col: Column) -> Column:
    return F.coalesce(col.rlike(OPEN_TOKEN), F.lit(False))


def _text_valid(col: Column, limit: int) -> Column:
    fine = (F.char_length(col) <= limit) & (F.char_length(col) > 0) & (F.trim(col) == col) & ~col.rlike(r"\p{Cntrl}")
    return F.coalesce(fine, F.lit(False))


def label_valid(col: Column) -> Column:
    return _text_valid(col, LABEL_LIMIT)


def summary_valid(col: Column) -> Column:
    return _text_valid(col, SUMMARY_LIMIT)


def icon_domain_valid(col: Column) -> Column:
    """A lower-case DNS name of at least two labels that is no dotted IPv4 address."""
    labels = F.split(col, r"\.")
    each = F.forall(labels, lambda x: x.rlike(r"^[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?$"))
    ip = (F.size(labels) == 4) & F.forall(labels, lambda x: x.rlike(r"^[0-9]+$"))
    return F.coalesce((F.char_length(col) <= DOMAIN_LIMIT) & (F.size(labels) >= 2) & each & ~ip, F.lit(False))


def extensions_valid(extensions: Column) -> Column:
    """Every key of an extension map has a namespace."""
    return F.coalesce(F.size(F.map_filter(extensions, lambda k, _: ~k.rlike(EXTENSION_KEY))) == 0, F.lit(True))


def display_text(label: Column, name: Column, id_: Column) -> Column:
    return F.coalesce(label, name, id_)


def purpose(intent: Column, summary: Column) -> Column:
    return F.coalesce(intent, summary)


def has_meaning(intent: Column, summary: Column) -> Column:
    """Whether a reader finds a purpose."""
    return F.coalesce(F.trim(purpose(intent, summary)) != "", F.lit(False))


def scale_rank(scale: Column) -> Column:
    """0 for the coarsest step of the ladder; null where there is no scale."""
    place = F.array_position(F.array(*[F.lit(s) for s in SCALES]), scale)
    return F.when(place > 0, place - 1)


def coarser(a: Column, b: Column) -> Column:
    """a is a coarser scale than b; null if either is absent."""
    return scale_rank(a) < scale_rank(b)


def code_unit_key(col: Column) -> Column:
    """A key that sorts strings by UTF-16 code units."""
    return F.hex(F.encode(col, "UTF-16BE"))


def shared_is(col: Column, wanted: bool) -> Column:
    """List filter: an absent flag counts as false."""
    return F.coalesce(col, F.lit(False)) == F.lit(wanted)


def payload_is(col: Column, wanted) -> Column:
    """Exact criterion on a field: an absent field matches nothing."""
    return F.coalesce(col == F.lit(wanted), F.lit(False))


@F.pandas_udf(StringType())
def _nfkc_lower(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for values in batches:
        yield values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v).lower())


def normalized(col: Column) -> Column:
    """NFKC, then lower case. Neither Spark nor SQL has NFKC, so this takes Arrow batches through Python."""
    return _nfkc_lower(col)


def is_ascii(col: Column) -> Column:
    """Whether a text needs no more than lower() to be normalised."""
    return col.rlike(r"^[\x00-\x7F]*$")


@F.pandas_udf(StructType().add("values", LongType()).add("depth", LongType()))
def _json_structure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    def of(text: str | None) -> tuple:
        if text is None:
            return None, None
        values, depth, level = 0, 0, [json.loads(text)]
        while level:  # one pass over each level of nesting
            values, depth = values + len(level), depth + 1
            level = [x for v in level if isinstance(v, (dict, list)) for x in (v.values() if isinstance(v, dict) else v)]
        return values, depth

    for texts in batches:
        yield pd.DataFrame([of(t) for t in texts], columns=["values", "depth"], dtype="Int64")


def json_structure(col: Column) -> Column:
    """(values, depth) of a JSON text: how many values it has, itself included, and how deep they lie; a scalar has depth 1."""
    return _json_structure(col)


def within_budget(col: Column, most_values: int, most_depth: int) -> Column:
    """Whether a JSON text has no more values and levels than that."""
    size = json_structure(col)
    return (size["values"] <= most_values) & (size["depth"] <= most_depth)


def content_revision(content: Column) -> Column:
    """The revision of stored bytes."""
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def search_terms(text: str, most_chars: int = 256, most_terms: int = 32) -> list[str]:
    """The different terms of a search text, sorted; raises on empty or oversized ones."""
    from ..plans.errors import GraphQueryError

    if len(text) > most_chars:
        raise GraphQueryError("search-text-too-long")
    terms = sorted(set(unicodedata.normalize("NFKC", text).lower().split()))
    if not terms or len(terms) > most_terms:
        raise GraphQueryError("invalid-search-text")
    return terms


def contains_all(col: Column, terms: list[str]) -> Column:
    found = F.lit(True)
    for t in terms:
        found = found & F.contains(col, F.lit(t))
    return found


def locator_within(resource: Column, root: Column) -> Column:
    """The resource is the root itself or lies below it."""
    return (resource == root) | F.startswith(resource, F.concat(F.rtrim(root, F.lit("/")), F.lit("/")))


def locator_valid(col: Column) -> Column:
    """A relative path without empty, '.' or '..' steps."""
    steps = F.split(col, "/")
    return F.coalesce((col != "") & F.forall(steps, lambda s: ~s.isin("", ".", "..")) & ~F.contains(col, F.lit("\\")), F.lit(False))


def observation_key(kind: Column, *parts: Column) -> Column:
    return F.concat(kind, F.lit(":"), F.sha2(F.concat_ws("\x00", *parts), 256))


def source_lines(text: Column) -> Column:
    """Lines of a text: one more than its line feeds, none if it is empty."""
    n = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(F.char_length(text) == 0, 0).otherwise(n + 1)


def nearest_depth(resources: Column) -> Column:
    """Fewest steps among the resources' paths."""
    return F.array_min(F.transform(resources, lambda r: F.size(F.split(r, "/"))))


def relation_label(type_: Column) -> Column:
    """What a drawn relation says: 'needs', 'tells', the readable type, or 'relates' where that is long."""
    readable = F.regexp_replace(type_, "[._-]+", " ")
    return (
        F.when(type_.isin("imports", "requires", "depends-on"), "needs")
        .when(type_ == "informs", "tells")
        .when(F.char_length(readable) <= 18, readable)
        .otherwise("relates")
    )


def next_scale_label(scale: Column) -> Column:
    """What the members of a component of that scale are called."""
    out = F.lit("children")
    for own, below in (("system", "domains"), ("domain", "parts"), ("part", "elements"), ("element", "nested elements")):
        out = F.when(scale == own, below).otherwise(out)
    return out


def surface_label(direction: Column, type_: Column) -> Column:
    """Heading of a relation in a component's own view, by its type and direction."""
    out = direction == "outgoing"
    pairs = ((type_ == "informs", "Tells", "Told by"), (type_.isin("imports", "requires", "depends-on"), "Needs", "Needed by"))
    label = F.when(out, "Relates to").otherwise("Related from")
    for hit, forth, back in pairs:
        label = F.when(hit, F.when(out, forth).otherwise(back)).otherwise(label)
    return label


#: A package or scope name, and modules of the runtime that are imported without a prefix.
PACKAGE_NAME = r"^[A-Za-z0-9][A-Za-z0-9._~-]*$"
BARE_BUILTINS = ("assert", "buffer", "child_process", "crypto", "events", "fs", "fs/promises", "http", "https", "net", "os", "path", "process", "stream", "timers", "url", "util", "worker_threads", "zlib")


def package_of(specifier: Column, builtins: tuple[str, ...] = BARE_BUILTINS) -> Column:
    """The package that an import specifier belongs to: scope and name, name, or prefixed runtime module.

    Null for relative, absolute, internal (#) and malformed specifiers.
    """
    prefix = F.regexp_extract(specifier, "^(node:|bun:)", 1)
    steps = F.split(F.substring(specifier, F.char_length(prefix) + 1, F.lit(1 << 20)), "/")
    first = F.get(steps, F.lit(0))
    scoped = (prefix == "") & F.startswith(specifier, F.lit("@"))
    scope, inner = F.substring(first, 2, 512), F.coalesce(F.get(steps, F.lit(1)), F.lit(""))
    named = F.when(scoped, scope.rlike(PACKAGE_NAME) & inner.rlike(PACKAGE_NAME)).otherwise(first.rlike(PACKAGE_NAME))
    fine = (F.char_length(specifier) <= 512) & ~specifier.rlike(r"[\\\x00-\x1f\x7f]|^[./#]") & F.forall(steps, lambda s: ~s.isin("", ".", ".."))
    name = (
        F.when(prefix != "", F.concat(prefix, first)).when(specifier.isin(*builtins), F.concat(F.lit("node:"), first))
        .when(scoped, F.concat_ws("/", first, inner)).otherwise(first)
    )
    return F.when(fine & named & (F.char_length(name) <= 256), name)
