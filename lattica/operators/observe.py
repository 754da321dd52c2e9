"""Finite observation sessions as batch tables: replay, contradiction, receipts, coverage, completion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import locator_within
from ..plans.errors import GraphQueryError
from ..plans.lineage import is_empty
from ..plans.ordering import with_max_before

KINDS = ("component-candidate", "input", "output", "action", "relationship", "documentation")


def record_hash(df: DataFrame) -> DataFrame:
    """Add `content`, a hash of a record's kind and body; equal records have equal ones."""
    return df.withColumn("content", F.sha2(F.concat_ws("\x1f", "kind", F.coalesce("body", F.lit("\x00"))), 256))


def accepted_records(records: DataFrame) -> DataFrame:
    """One row per (scope, key): replays of the same record count once."""
    return record_hash(records).dropDuplicates(["scope", "key", "content"])


def contradictions(records: DataFrame) -> DataFrame:
    """(scope, key, versions): keys that were sent with different content."""
    return record_hash(records).groupBy("scope", "key").agg(F.countDistinct("content").alias("versions")).where("versions > 1")


def batch_receipts(records: DataFrame) -> DataFrame:
    """(batch, accepted, replayed, total): new keys, repeated ones, and keys so far, per batch in order.

    records: batch, scope, key, kind, body. Totals run over one row per batch.
    """
    first = record_hash(records).groupBy("scope", "key", "content").agg(F.min("batch").alias("__first"))
    sent = record_hash(records).groupBy("batch", "scope", "key", "content").agg(F.count(F.lit(1)).alias("__n"))
    met = sent.join(first, ["scope", "key", "content"])
    new = F.col("batch") == F.col("__first")
    per = met.groupBy("batch").agg(F.sum(new.cast("long")).alias("accepted"), F.sum(F.col("__n") - new.cast("long")).alias("replayed"))
    return per.withColumn("total", F.sum("accepted").over(Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)))


def sequence_problems(messages: DataFrame) -> DataFrame:
    """Messages (session, arrival, sequence) whose sequence does not pass the one before."""
    return with_max_before(messages, "session", "arrival", "sequence").where("sequence <= before")


def coverage_problems(declared: DataFrame, coverage: DataFrame) -> DataFrame:
    """(scope, problem): declared scopes without coverage, covered ones never declared, and double ones."""
    d = declared.select("scope").distinct().withColumn("__d", F.lit(True))
    c = coverage.groupBy("scope").agg(F.count(F.lit(1)).alias("__n"))
    both = d.join(c, "scope", "full_outer")
    problem = F.when(F.col("__d").isNull(), "undeclared-scope").when(F.col("__n").isNull(), "uncovered-scope").when(F.col("__n") > 1, "duplicate-coverage")
    return both.withColumn("problem", problem).where("problem is not null").select("scope", "problem")


def complete_kinds(coverage: DataFrame) -> DataFrame:
    """(scope, kind) pairs under complete coverage, from (scope, kinds, state)."""
    return coverage.where("state = 'complete'").select("scope", F.explode("kinds").alias("kind")).distinct()


def absent_keys(prior: DataFrame, current: DataFrame, complete: DataFrame) -> DataFrame:
    """Rows of prior (scope, key, kind, ...) that are gone and whose absence is believed: complete coverage only."""
    gone = prior.join(current.select("scope", "key"), ["scope", "key"], "left_anti")
    return gone.join(complete, ["scope", "kind"], "left_semi")


def stray_resources(provenance: DataFrame, scopes: DataFrame) -> DataFrame:
    """Provenance rows (scope, resource) outside their scope's resource root."""
    met = provenance.join(scopes.select("scope", "resource_root"), "scope")
    return met.where(~F.coalesce(locator_within(F.col("resource"), F.col("resource_root")), F.lit(False)))


def completed_snapshot(records: DataFrame, declared: DataFrame, coverage: DataFrame) -> DataFrame:
    """The finished session's records, one per key; raises where the session is contradictory or not covered."""
    if not is_empty(contradictions(records)):
        raise GraphQueryError("observation-contradiction")
    if not is_empty(coverage_problems(declared, coverage)):
        raise GraphQueryError("observation-coverage-mismatch")
    if not is_empty(records.where(~F.col("kind").isin(*KINDS))):
        raise GraphQueryError("invalid-observation-kind")
    return accepted_records(records)


def external_snapshot(records: DataFrame, project: str, scanner: str, registered: DataFrame, coverage: DataFrame | None = None) -> DataFrame:
    """Records of a submitted snapshot, if (project, scanner, scope) is registered for every scope.

    It is held to the rules of a session: no contradictions, and, where `coverage` comes with it, each
    scope covered once.
    """
    known = registered.where((F.col("project") == project) & (F.col("scanner") == scanner)).select("scope")
    if not is_empty(records.join(known, "scope", "left_anti")):
        raise GraphQueryError("unregistered-snapshot-scope", project=project, scanner=scanner)
    scopes = records.select("scope").distinct()
    return completed_snapshot(records, scopes, scopes if coverage is None else coverage)


def event_statuses(events: DataFrame) -> DataFrame:
    """Add `status` to events (stream, arrival, generation, start): accepted, duplicate, reversed or missed.

    A consumer that is told to refetch goes on from the generation that it refetched, so the generation it
    has is the largest so far, at least its stream's `start`.
    """
    now = F.greatest("start", "__before")
    status = (
        F.when(F.col("generation") == now, "duplicate").when(F.col("generation") < now, "reversed")
        .when(F.col("generation") == now + 1, "accepted").otherwise("missed")
    )
    return with_max_before(events, "stream", "arrival", "generation", name="__before").withColumn("status", status).drop("__before")


def affected_ids(mutations: DataFrame) -> DataFrame:
    """(generation, affected): sorted different ids that each generation touched."""
    return mutations.groupBy("generation").agg(F.sort_array(F.collect_set("id")).alias("affected"))
