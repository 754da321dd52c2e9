"""Ranks and running values in a global order, without a task that sees a whole group.

Rows are range-partitioned by the order and the partition numbers are written down, so one key that holds
a third of all rows lies on many partitions; what crosses from one partition to the next is a table of at
most one row per partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def _placed(df: DataFrame, *order) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *order).withColumn("__pid", F.spark_partition_id()))


def with_rank(df: DataFrame, *order, name: str = "rank") -> DataFrame:
    """Add the gapless 0-based rank of each row in the given order.

    Rows are shuffled once: each task numbers its rows as it writes them down in order, so no window deals them again.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # partition number above 33 bits, place in the partition below
    placed = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    pid = F.shiftright("__at", 33)
    counts = placed.groupBy(pid.alias("__pid")).agg(F.count(F.lit(1)).alias("__n"))  # one row per partition
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__pid", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    ranked = placed.withColumn("__pid", pid).join(F.broadcast(starts), "__pid")
    return ranked.withColumn(name, F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__pid", "__at", "__start")


def with_sum_before(df: DataFrame, order: str, value: str, name: str = "before") -> DataFrame:
    """Add the sum of a value over all earlier rows of the whole table; rows have different `order`."""
    placed = _placed(df, order)
    sums = placed.groupBy("__pid").agg(F.sum(value).alias("__n"))  # one row per partition
    starts = sums.select("__pid", F.coalesce(F.sum("__n").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    inside = F.sum(value).over(Window.partitionBy("__pid").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    joined = placed.withColumn("__in", F.coalesce(inside, F.lit(0))).join(F.broadcast(starts), "__pid")
    return joined.withColumn(name, F.col("__start") + F.col("__in")).drop("__pid", "__in", "__start")


def with_rank_in(df: DataFrame, key: str, *order, name: str = "rank") -> DataFrame:
    """Add each row's 0-based rank among the rows of its key, and `<name>_of`, how many the key has."""
    ranked = with_rank(df, key, *order, name="__rank")
    firsts = ranked.groupBy(key).agg(F.min("__rank").alias("__first"), F.count(F.lit(1)).alias(f"{name}_of"))
    return ranked.join(firsts, key).withColumn(name, F.col("__rank") - F.col("__first")).drop("__rank", "__first")


def with_max_before(df: DataFrame, key: str, order: str, value: str, name: str = "before") -> DataFrame:
    """Add the largest value among the earlier rows of the same key; null for its first row."""
    placed = _placed(df, key, order)
    tops = placed.groupBy("__pid", key).agg(F.max(value).alias("__top"))
    earlier = Window.partitionBy(key).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    # only the first key of a partition goes on from the one before
    carried = tops.withColumn("__carry", F.max("__top").over(earlier)).where("__carry is not null").select("__pid", F.col(key).alias("__key"), "__carry")
    own = Window.partitionBy("__pid", key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("__local", F.max(value).over(own)).withColumnRenamed("__pid", "__p")
    joined = local.join(F.broadcast(carried), (F.col("__p") == F.col("__pid")) & F.col(key).eqNullSafe(F.col("__key")), "left")
    return joined.withColumn(name, F.greatest("__local", "__carry")).drop("__p", "__pid", "__key", "__carry", "__local")
