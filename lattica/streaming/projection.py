"""A projection that follows committed generations: catalog, adjacency and fingerprint, rebuilt and swapped in as one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.errors import GraphQueryError
from ..plans.lists import adjacency_lists
from ..sources import stores

#: A commit's manifest, which is the event that tells of it.
EVENT = "owner string, generation long, tables array<string>, until double"


@dataclass(frozen=True)
class Projection:
    """What is derived of one generation: catalog (id, kind, searchable), adjacency in chunks, fingerprint."""

    generation: int
    fingerprint: str
    catalog: DataFrame
    adjacency: DataFrame


def committed_events(spark: SparkSession, root: str) -> DataFrame:
    """A stream of the commits of a store: a marker comes into being whole, so each is one event."""
    return spark.readStream.schema(EVENT).json(f"{root}/commits/*")


def rebuild(spark: SparkSession, root: str, projection: str, generation: int | None = None) -> int:
    """Derive the projection of a stored generation, the newest by default, and swap it in; returns the generation that is shown.

    One that is shown already, or an older one, is left as it is. Whoever is slower than another rebuild gives way.
    """
    n = stores.current_generation(spark, root) if generation is None else generation
    shown = stores.current_generation(spark, projection)
    if n is None or (shown is not None and shown >= n):
        return -1 if shown is None else shown
    graph = stores.read_generation(spark, root, n)
    stores.settle(spark, projection)
    # lists of relations that are the very table behind what is shown are not made again
    same = shown is not None and shown in stores.generations(spark, root) and stores.table_folder(spark, root, "relations", shown) == graph.stored["relations"]
    held = stores.table_folder(spark, projection, "adjacency", shown) if same else None
    shared = {} if held is None else {"adjacency": held.removeprefix(f"{projection}/generations/")}
    attempt = stores.Attempt(spark, projection, n).begin(["catalog", "adjacency", "identity"], shared)
    attempt.write("catalog", graph.catalog(), "id")
    if not shared:
        attempt.write("adjacency", adjacency_lists(graph), "owner")
    attempt.write("identity", graph.identity(), "generation")
    try:
        attempt.publish()
    except GraphQueryError as e:
        if e.code not in ("stale-generation", "attempt-settled"):
            raise
        attempt.abandon()
    return stores.current_generation(spark, projection)


def projection_sink(root: str, projection: str):
    """A foreachBatch function: one rebuild for all events that wait, of the newest generation that the store holds.

    Events that come twice, late or after a gap need no care: none carries content, the store is read again.
    """

    def follow(batch: DataFrame, number: int) -> None:
        newest = batch.agg(F.max("generation")).first()[0]
        shown = stores.current_generation(batch.sparkSession, projection)
        if newest is not None and (shown is None or newest > shown):
            rebuild(batch.sparkSession, root, projection)

    return follow


def run_projection(spark: SparkSession, root: str, projection: str, checkpoint: str) -> None:
    """Follow the commits that are there and stop."""
    events = committed_events(spark, root)
    events.writeStream.foreachBatch(projection_sink(root, projection)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_projection(spark: SparkSession, projection: str) -> Projection:
    n = stores.current_generation(spark, projection)
    if n is None:
        raise GraphQueryError("no-generation", root=projection)
    catalog, adjacency, identity = (stores.read_table(spark, projection, name, n, "id string") for name in ("catalog", "adjacency", "identity"))
    return Projection(n, identity.first()["fingerprint"], catalog, adjacency)
