"""Derived facts: structural signals, scale proposals, sharing, measurements, observed paths, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import SCALES, packed, scale_rank, unpacked

#: Least counts for part, domain and system by signal; below the first it is an element.
THRESHOLDS = {"export_count": (8, 40, 160), "file_count": (8, 40, 160), "reuse_breadth": (2, 8, 24)}
SHARED_FROM = 2
PROVENANCE_LIMIT, PAIR_LIMIT = 32, 1000


def file_counts(files: DataFrame) -> DataFrame:
    """(boundary, file_count) of rows (boundary, file)."""
    return files.groupBy("boundary").agg(F.count(F.lit(1)).alias("file_count"))


def reuse_breadth(imports: DataFrame) -> DataFrame:
    """(target, reuse_breadth): exact number of different importers (source) per target, itself excluded."""
    return imports.where("source <> target").groupBy("target").agg(F.countDistinct("source").alias("reuse_breadth"))


def signals(components: DataFrame, files: DataFrame, imports: DataFrame, actions: DataFrame, declared: DataFrame) -> DataFrame:
    """components (id) with file_count, reuse_breadth, entry_point and declared_boundary."""
    flag = lambda df, name: df.select("id").distinct().withColumn(name, F.lit(True))
    out = components.select("id").join(file_counts(files).withColumnRenamed("boundary", "id"), "id", "left")
    out = out.join(reuse_breadth(imports).withColumnRenamed("target", "id"), "id", "left")
    out = out.join(flag(actions, "entry_point"), "id", "left").join(flag(declared, "declared_boundary"), "id", "left")
    return out.na.fill(0, ["file_count", "reuse_breadth"]).na.fill(False, ["entry_point", "declared_boundary"])


def import_edges(imports: DataFrame, most_provenance: int = PROVENANCE_LIMIT, most_pairs: int | None = PAIR_LIMIT) -> DataFrame:
    """(source, target, n, provenance, partial): one row per imported pair.

    provenance: the first `most_provenance` of (resource, start), in that order. With most_pairs, pairs
    beyond it in (source, target) order are left out and every row says partial.
    """
    order = F.row_number().over(Window.partitionBy("source", "target").orderBy("resource", "start"))
    first = imports.withColumn("__r", order).where(F.col("__r") <= most_provenance)  # ranked before the shuffle, too
    first = first.groupBy("source", "target").agg(F.sort_array(F.collect_list(F.struct("resource", "start"))).alias("provenance"))
    pairs = imports.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n")).join(first, ["source", "target"])
    if most_pairs is None:
        return pairs.withColumn("partial", F.lit(False))
    total = pairs.count()
    return pairs.orderBy("source", "target").limit(most_pairs).withColumn("partial", F.lit(total > most_pairs))


def first_records(records: DataFrame) -> DataFrame:
    """One record per (scope, key), the first by kind and content; `partial` where others were dropped."""
    rest = [c for c in records.columns if c not in ("scope", "key", "kind", "content")]
    first = F.min(F.struct("kind", "content", *rest)).alias("r")
    return records.groupBy("scope", "key").agg(first, (F.count(F.lit(1)) > 1).alias("partial")).select("scope", "key", "r.*", "partial")


def sample_files(files: DataFrame, most: int = 256) -> DataFrame:
    """Up to `most` files (boundary, file), one of each boundary in turn."""
    turn = F.row_number().over(Window.partitionBy("boundary").orderBy("file"))
    return files.withColumn("turn", turn).where(F.col("turn") <= most).orderBy("turn", "boundary").limit(most)


def scale_for(count: Column, signal: str) -> Column:
    part, domain, system = THRESHOLDS[signal]
    return F.when(count >= system, "system").when(count >= domain, "domain").when(count >= part, "part").when(count.isNotNull(), "element")


def with_scale_proposal(components: DataFrame) -> DataFrame:
    """Add status (insufficient, proposed, ambiguous), proposal and candidates (coarsest first) from the count signals."""
    votes = F.array(*[scale_for(F.col(s), s) for s in THRESHOLDS])
    named = F.filter(F.array(*[F.lit(s) for s in SCALES]), lambda s: F.exists(votes, lambda v: v.eqNullSafe(s)))
    out = components.withColumn("__c", named)
    n = F.size("__c")
    status = F.when(n == 0, "insufficient").when(n == 1, "proposed").otherwise("ambiguous")
    out = out.withColumn("status", status).withColumn("proposal", F.when(n == 1, F.col("__c")[0]))
    return out.withColumn("candidates", F.when(n > 1, F.array_join("__c", ",")).otherwise("")).drop("__c")


def scale_drift(scale: Column, status: Column, proposal: Column) -> Column:
    """aligned or drift where both a scale and a proposal exist."""
    return F.when((status == "proposed") & scale.isNotNull(), F.when(scale == proposal, "aligned").otherwise("drift"))


def shared_flag(breadth: Column) -> Column:
    """Reused by two or more; null where unmeasured."""
    return F.when(breadth.isNotNull(), breadth >= SHARED_FROM)


def single_measurements(evidence: DataFrame) -> DataFrame:
    """Per component and scanner the measured value, only where all its measurements agree.

    evidence: component, project, scanner, instance, version, value.
    """
    keys = ["component", "project", "scanner", "instance", "version"]
    agreed = evidence.groupBy(*keys).agg(F.min("value").alias("value"), F.max("value").alias("__most"))
    return agreed.where(F.col("value") == F.col("__most")).drop("__most")


def comparable_measurements(evidence: DataFrame) -> DataFrame:
    """(component, value) of the one scanner that measures most components, at least two; ties by its key."""
    keys = ["project", "scanner", "instance", "version"]
    valid = evidence.where((F.col("value") >= 0) & (F.col("value") == F.floor("value")))
    own = single_measurements(valid)
    best = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n >= 2").orderBy(F.desc("n"), *keys).limit(1)
    return own.join(F.broadcast(best), keys).select("component", "value")  # one row


def observed_paths(bindings: DataFrame, provenance: DataFrame) -> DataFrame:
    """(component, paths): different (project, scanner, resource) per bound component, sorted.

    bindings: scope, key, component_id; provenance: scope, key, project, scanner, resource.
    """
    met = bindings.select("scope", "key", F.col("component_id").alias("component")).join(provenance, ["scope", "key"])
    one = met.select("component", F.struct("project", "scanner", "resource").alias("p")).distinct()
    return one.groupBy("component").agg(F.sort_array(F.collect_list("p")).alias("paths"))


def record_references(records: DataFrame) -> DataFrame:
    """(scope, key, record_key): the components that each observation record speaks of, by its kind.

    records: scope, key, kind, component, subject, from, to. A candidate speaks of itself, inputs, outputs and actions
    of their component, documentation of its subject, a relationship of both its ends.
    """
    c = F.col
    named = (
        F.when(c("kind") == "component-candidate", F.array("key")).when(c("kind") == "relationship", F.array("from", "to"))
        .when(c("kind") == "documentation", F.array("subject")).otherwise(F.array("component"))
    )
    out = records.select("scope", F.explode(F.array_compact(named)).alias("ref"), c("key").alias("record_key"))
    return out.select("scope", c("ref").alias("key"), "record_key").distinct()


def evidence_views(bindings: DataFrame, references: DataFrame, coverage: DataFrame) -> DataFrame:
    """(component, scope, records, state): per bound component and scope its records and how well it is covered.

    references: (record_key, scope, key), one row for each binding that a record refers to.
    """
    met = bindings.select("scope", "key", F.col("component_id").alias("component")).join(references, ["scope", "key"])
    views = met.select("component", "scope", "record_key").distinct().groupBy("component", "scope").agg(F.sort_array(F.collect_list("record_key")).alias("records"))
    return views.join(coverage.select("scope", "state"), "scope", "left")


def incident_counts(relations: DataFrame) -> DataFrame:
    """(id, n): how many relation ends touch each entity; a self-loop counts twice."""
    ends = relations.select(F.explode(F.array(packed(F.col("source")), packed(F.col("target")))).alias("__end"))
    # dealt before they are counted: a task then holds its own share of the entities, not all that its input names
    return ends.repartition("__end").groupBy("__end").agg(F.count(F.lit(1)).alias("n")).select(unpacked(F.col("__end")).alias("id"), "n")


def child_counts(entities: DataFrame) -> DataFrame:
    return entities.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n"))


def scale_violations(entities: DataFrame) -> DataFrame:
    """(id, parent, scale, parent_scale) of components that are coarser than their container."""
    above = entities.select(F.col("id").alias("parent"), F.col("scale").alias("parent_scale"))
    met = entities.where("scale is not null and parent is not null").select("id", "parent", "scale").join(above, "parent")
    return met.where(scale_rank(F.col("scale")) < scale_rank(F.col("parent_scale"))).select("id", "parent", "scale", "parent_scale")
