"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import checkpointed as cut, ensure_checkpoint_dir
from ..plans.ordering import with_rank

__all__ = ["broadcast_if_small", "components", "cut", "drop_tables", "partitions_of", "table_cut", "text_key", "with_rank"]


def text_key(col) -> F.Column:
    """16 bytes that stand for a whole text; null stays null."""
    return F.unhex(F.md5(col))


def partitions_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def broadcast_if_small(df: DataFrame, rows: int, limit: int = 200_000) -> DataFrame:
    """Broadcast hint for a table whose counted rows are within the limit; else Spark's shuffle join."""
    return F.broadcast(df) if rows <= limit else df


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); root is the smallest node reachable.

    Alternates large-star and small-star steps until the links no longer change, so long chains take
    logarithmically many rounds. A hot node is a hot key only of a group-by with partial minimum and of a
    join with the written minima, whose other side Spark's skew handling may split.
    """
    links = cut(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    state = _links_state(links)
    for _ in range(rounds):
        links = cut(_small_star(_large_star(links)))
        state, last = _links_state(links), state
        if state == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    members = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return members.unionByName(roots.join(members.select("node"), "node", "left_anti"))


def _links_state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = cut(links.groupBy("a").agg(F.min("b").alias("m")))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).unionAll(moved).distinct()


def table_cut(df: DataFrame) -> DataFrame:
    """Like cut(), but as a Parquet table in the shared folder, so that later reads take single columns."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop_tables(*tables: DataFrame) -> None:
    """Delete tables of table_cut() that nothing reads any more: all that came of them is written down."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
