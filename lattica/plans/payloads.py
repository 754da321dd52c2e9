"""Open payloads: fields beyond the fixed columns, with a null that is there kept apart from one that is not.

An entity's namespaced extensions are one VARIANT object in the column `extensions`. SQL null stands for a field that is
absent, a variant null for one that holds null. Reads of one key are pushed into the scan of a stored generation.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import EXTENSION_KEY
from .errors import GraphQueryError

OPEN_FIELDS = {"icon_domain": "string", "lifecycle": "string", "extensions": "variant"}
#: The fields' names in a payload, whose order the searchable text follows.
PAYLOAD_NAMES = {
    "icon_domain": "iconDomain", "intent": "intent", "label": "label", "lifecycle": "lifecycle", "name": "name", "parent": "parent",
    "scale": "scale", "summary": "summary", "type": "type",
}
_ENTRIES = "map<string,variant>"


def is_extension(key: str) -> bool:
    """Whether a key has a namespace, so that it names an extension."""
    return re.fullmatch(EXTENSION_KEY.strip("^$"), key) is not None


def with_open_fields(entities: DataFrame) -> DataFrame:
    """entities with every open field as a column, absent where there was none."""
    return entities.withColumns({c: F.lit(None).cast(t) for c, t in OPEN_FIELDS.items() if c not in entities.columns})


def _path(key: str) -> str:
    if not is_extension(key):
        raise GraphQueryError("unknown-field", field=key)
    return f'$["{key}"]'  # the grammar of keys leaves nothing to escape


def extension(extensions: Column, key: str) -> Column:
    """One extension as a variant: SQL null if absent, a variant null if it holds null."""
    return F.try_variant_get(extensions, _path(key), "variant")


def extension_is(extensions: Column, key: str, value: bool | float | str | None) -> Column:
    """Exact criterion: the extension is there, of the value's own type, and equal; None asks for a null that is there."""
    held = extension(extensions, key)
    if value is None:
        return F.coalesce(F.is_variant_null(held), F.lit(False))
    kind = F.schema_of_variant(held)
    if isinstance(value, bool):
        return F.coalesce((kind == "BOOLEAN") & (F.try_variant_get(extensions, _path(key), "boolean") == value), F.lit(False))
    if isinstance(value, str):
        return F.coalesce((kind == "STRING") & (F.try_variant_get(extensions, _path(key), "string") == value), F.lit(False))
    number = (kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL")
    return F.coalesce(number & (F.try_variant_get(extensions, _path(key), "double") == float(value)), F.lit(False))


def _checked(value):
    """A JSON value whose numbers are finite; minus zero becomes zero."""
    if isinstance(value, float):
        if not math.isfinite(value):
            raise GraphQueryError("invalid-payload-number")
        return value + 0.0 if value else 0
    if isinstance(value, dict):
        return {k: _checked(v) for k, v in value.items()}
    return [_checked(v) for v in value] if isinstance(value, (list, tuple)) else value


def variant_of(value) -> Column:
    """A literal variant; None is a variant null, not an absent value."""
    return F.parse_json(F.lit(json.dumps(_checked(value), allow_nan=False)))


def patched(extensions: Column, patch: dict) -> Column:
    """The extensions with the patch's keys set; a None is stored as null, so no key is ever taken away."""
    for key in patch:
        _path(key)
    held = F.coalesce(extensions.cast(_ENTRIES), F.create_map().cast(_ENTRIES))
    kept = F.map_filter(held, lambda k, _: ~k.isin(*patch))
    new = F.map_from_arrays(F.array(*[F.lit(k) for k in patch]), F.array(*[variant_of(v) for v in patch.values()]))
    return F.to_variant_object(F.map_concat(kept, new))


def extension_problems(extensions: Column) -> Column:
    """Keys of an extension object that have no namespace; empty if all have one."""
    keys = F.coalesce(F.map_keys(extensions.cast(_ENTRIES)), F.array().cast("array<string>"))
    return F.filter(keys, lambda k: ~k.rlike(EXTENSION_KEY))


def canonical_text(value: Column) -> Column:
    """A variant as JSON with the keys of every object in order; equal variants give equal texts."""
    return F.to_json(value)


def strings_in(value: Column) -> Column:
    """Every string inside a variant, one to a line: lists in their order, objects in order of their keys."""
    # in canonical text a string with a colon behind it is a key; group 1 is empty for those
    tokens = F.regexp_extract_all(F.to_json(value), F.lit(r'"(?:[^"\\]|\\.)*+":|("(?:[^"\\]|\\.)*+")'), F.lit(1))
    return F.array_join(F.transform(F.filter(tokens, lambda t: t != ""), lambda t: F.try_variant_get(F.parse_json(t), "$", "string")), "\n")


def searchable_parts(entities: DataFrame) -> Column:
    """The string values of a payload, fixed fields and extensions together, in order of their keys."""
    fixed = F.array(*[F.struct(F.lit(name).alias("key"), F.col(c).alias("text")) for c, name in PAYLOAD_NAMES.items() if c in entities.columns])
    own = F.transform(F.map_entries(F.col("extensions").cast(_ENTRIES)), lambda e: F.struct(e["key"].alias("key"), strings_in(e["value"]).alias("text")))
    both = F.concat(fixed, F.coalesce(own, F.array().cast("array<struct<key:string,text:string>>")))
    return F.array_join(F.transform(F.sort_array(F.filter(both, lambda e: e["text"].isNotNull() & (e["text"] != ""))), lambda e: e["text"]), "\n")
