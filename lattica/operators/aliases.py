"""Identity aliases: chains of old ids that end at one live entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut, is_empty


def resolve_aliases(aliases: DataFrame) -> DataFrame:
    """(source, resolved, chain, hops) of every alias that ends, by pointer doubling.

    chain: the ids behind source in order, the last one being `resolved`. Each round joins every open
    chain with the chain of its end, so a chain of n aliases takes about log2(n) rounds. Aliases on or
    into a cycle never end and are left out; see alias_problems(). A chain's tails are chains too, so where one that is
    longer than a round reaches is still open, a shorter one has ended in that round: the first round after the longest chain in
    which none ends is the last, and what never ends is carried no further than what does.
    """
    start = aliases.select("source", F.col("target").alias("resolved"), F.array("target").alias("chain"))
    state = cut(start.withColumn("open", F.lit(True)))
    done = None
    while True:
        ahead = state.select(F.col("source").alias("__s"), F.col("resolved").alias("__r"), F.col("chain").alias("__c"))
        if done is not None:
            ahead = ahead.unionByName(done.select(F.col("source").alias("__s"), F.col("resolved").alias("__r"), F.col("chain").alias("__c")))
        step = state.join(ahead, F.col("resolved") == F.col("__s"), "left")
        step = cut(
            step.select(
                "source", F.coalesce("__r", "resolved").alias("resolved"),
                F.when(F.col("__c").isNotNull(), F.concat("chain", "__c")).otherwise(F.col("chain")).alias("chain"),
                F.col("__s").isNotNull().alias("open"),
            )
        )
        ended = step.where(~F.col("open"))
        done = ended if done is None else done.unionByName(ended)
        state = step.where("open")
        if is_empty(state) or is_empty(ended):
            break
    return done.select("source", "resolved", "chain", F.size("chain").alias("hops"))


def alias_problems(aliases: DataFrame, entities: DataFrame) -> DataFrame:
    """(source, problem) of aliases that break the rules, one row per alias and problem."""
    live = entities.select(F.col("id").alias("__id"))
    loops = aliases.where(F.col("source") == F.col("target")).select("source", F.lit("self-alias").alias("problem"))
    taken = aliases.join(live, F.col("source") == F.col("__id"), "left_semi").select("source", F.lit("alias-source-is-live").alias("problem"))
    twice = aliases.groupBy("source").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("source", F.lit("duplicate-alias").alias("problem"))
    single = aliases.where(F.col("source") != F.col("target")).dropDuplicates(["source"])
    ends = cut(resolve_aliases(single))
    cycles = single.join(ends.select("source"), "source", "left_anti").select("source", F.lit("alias-cycle").alias("problem"))
    lost = ends.join(live, F.col("resolved") == F.col("__id"), "left_anti").select("source", F.lit("unknown-alias-target").alias("problem"))
    out = loops
    for more in (taken, twice, cycles, lost):
        out = out.unionByName(more)
    return out
