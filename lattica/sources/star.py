"""A star schema of trade tables mapped onto the graph: the data that the registered queries run on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import minted_id
from ..plans.graph import ALIASES, ENTITIES, GraphFrames
from ..plans.lineage import cut

#: Which keys of a line make a relation.
PAIRS = {"supplies": ("l_suppkey", "l_partkey"), "requires": ("l_orderkey", "l_partkey")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entity_id(kind: str, key: Column) -> Column:
    return minted_id("ent_", kind, key)


def relation_id(type_: str, source: Column, target: Column) -> Column:
    return minted_id("rel_", type_, source, target)


def _entity(df: DataFrame, kind: str, key: str, name: Column, scale: str | None, parent: Column | None, shared: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(
        entity_id(kind, F.col(key)).alias("id"), F.lit("component").alias("kind"), name.cast("string").alias("name"), none.alias("label"),
        none.alias("summary"), none.alias("intent"), F.lit(kind).alias("type"), F.lit(scale).cast("string").alias("scale"),
        (shared if shared is not None else F.lit(None)).cast("boolean").alias("shared"), (parent if parent is not None else none).alias("parent"),
    )


def _pairs(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*keys).distinct()


def entities(spark: SparkSession, sf_dir: str, orders: bool = True, supplied: DataFrame | None = None) -> DataFrame:
    """regions > nations > customers, suppliers > orders; parts stand alone.

    A part is shared if two suppliers or more deliver it; every seventh says explicitly that it is not. supplied: the
    different (l_suppkey, l_partkey), where they are written down.
    """
    t = lambda name: table(spark, sf_dir, name)
    out = _entity(t("region"), "region", "r_regionkey", F.col("r_name"), "system", None)
    out = out.unionByName(_entity(t("nation"), "nation", "n_nationkey", F.col("n_name"), "domain", entity_id("region", F.col("n_regionkey"))))
    out = out.unionByName(_entity(t("customer"), "customer", "c_custkey", F.col("c_name"), "part", entity_id("nation", F.col("c_nationkey"))))
    out = out.unionByName(_entity(t("supplier"), "supplier", "s_suppkey", F.col("s_name"), "part", entity_id("nation", F.col("s_nationkey"))))
    supplied = _pairs(spark, sf_dir, "l_suppkey", "l_partkey") if supplied is None else supplied
    many = supplied.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("l_suppkey").alias("__n"))
    parts = t("part").join(many, "p_partkey", "left")
    shared = F.when(F.col("p_partkey") % 7 == 0, F.lit(False)).when(F.col("__n") >= 2, F.lit(True))
    out = out.unionByName(_entity(parts, "part", "p_partkey", F.col("p_name"), None, None, shared))
    if orders:
        out = out.unionByName(_entity(t("orders"), "order", "o_orderkey", F.col("o_orderkey"), "element", entity_id("customer", F.col("o_custkey"))))
    return out


def relations(spark: SparkSession, sf_dir: str, types: tuple[str, ...] = ("supplies", "placed", "requires"), pairs: dict[str, DataFrame] | None = None) -> DataFrame:
    """supplies: supplier to part; placed: customer to order; requires: order to part. pairs: different keys by type, where they are written down."""
    pairs = pairs or {}
    supplied, required = (pairs.get(n) or _pairs(spark, sf_dir, *keys) for n, keys in PAIRS.items())
    sides = {
        "supplies": (supplied.select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("t")), "supplier", "part"),
        "placed": (table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("s"), F.col("o_orderkey").alias("t")), "customer", "order"),
        "requires": (required.select(F.col("l_orderkey").alias("s"), F.col("l_partkey").alias("t")), "order", "part"),
    }
    out = None
    for type_ in types:
        df, source, target = sides[type_]
        own = df.select(
            relation_id(type_, F.col("s"), F.col("t")).alias("id"), F.lit(type_).alias("type"), entity_id(source, F.col("s")).alias("source"),
            entity_id(target, F.col("t")).alias("target"), F.lit(None).cast("string").alias("description"),
        )
        out = own if out is None else out.unionByName(own)
    return out


def document_aliases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as entities, the first of equal texts being live, and aliases from the others to it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("t"))
    first = docs.groupBy("t").agg(F.min("doc_id").alias("f"))
    met = docs.join(first, "t")
    live = _entity(met.where("doc_id = f"), "document", "doc_id", F.col("doc_id"), None, None)
    return live, met.where("doc_id <> f").select(entity_id("document", F.col("doc_id")).alias("source"), entity_id("document", F.col("f")).alias("target"))


def star_graph(spark: SparkSession, sf_dir: str, orders: bool = True, types: tuple[str, ...] = ("supplies", "placed", "requires"), held: bool = False) -> GraphFrames:
    """The whole star. held: for a graph that is read several times; the pairs of keys behind it are found and written down once."""
    none = spark.createDataFrame([], ALIASES)
    pairs = {n: cut(_pairs(spark, sf_dir, *keys)) for n, keys in PAIRS.items() if n in types} if held else {}
    return GraphFrames(entities(spark, sf_dir, orders, pairs.get("supplies")), relations(spark, sf_dir, types, pairs), none, 1)


def empty_graph(spark: SparkSession) -> GraphFrames:
    """Generation 0 of a new workspace."""
    from ..plans.graph import RELATIONS

    return GraphFrames(spark.createDataFrame([], ENTITIES), spark.createDataFrame([], RELATIONS), spark.createDataFrame([], ALIASES), 0)
