"""User-supplied scanners: functions from resources to observation records, run where the resources are."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.observe import KINDS
from ..plans.errors import GraphQueryError

RECORD = "scope string, key string, kind string, body string, resource string"


@dataclass(frozen=True)
class Scanner:
    """scan(resource, content) yields (key, kind, body) for one resource; it sees no other."""

    id: str
    instance: str
    version: str
    scan: Callable[[str, bytes], Iterable[tuple[str, str, str]]]


def _scopes_of(resources: DataFrame, scopes: DataFrame) -> DataFrame:
    """(path, scope) where the resource is a scope's root or lies below it: each path's own prefixes are looked up, paths alone travel."""
    steps = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))
    roots = scopes.select("scope", F.rtrim("resource_root", F.lit("/")).alias("__root")).distinct()
    return resources.select("path", F.explode(prefixes).alias("__root")).distinct().join(roots, "__root").select("path", "scope")


def scan_resources(scanner: Scanner, resources: DataFrame, scopes: DataFrame, most_records: int | None = None) -> DataFrame:
    """Observation records of all resources (path, content) that lie in a scope (scope, resource_root).

    A record of an unknown kind fails the job. With most_records, more records than that raise
    observation-bound-exceeded. The scanner runs in Arrow batches, one resource at a time.
    """
    inside = resources.select("path", "content").join(_scopes_of(resources, scopes), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                scope, path, content = (batch.column(c)[row].as_py() for c in ("scope", "path", "content"))
                found = [(scope, key, kind, body, path) for key, kind, body in scanner.scan(path, content)]
                if any(r[2] not in KINDS for r in found):
                    raise ValueError(f"scanner {scanner.id} gave a record of unknown kind for {path}")
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found)], ["scope", "key", "kind", "body", "resource"])

    records = inside.select("scope", "path", "content").mapInArrow(run, RECORD)
    if most_records is not None and records.limit(most_records + 1).count() > most_records:
        raise GraphQueryError("observation-bound-exceeded", limit=most_records)
    return records
