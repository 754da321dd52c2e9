"""Mixing sources to target weights by whole repetitions plus one hash-seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, with_rank

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text, split at ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bernoulli(seed: str, doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) that depends on seed, doc_id and text only, so reruns agree."""
    key = F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")), F.coalesce(F.md5(text), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_rates(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> tuple[DataFrame, int]:
    """(source, source_size, target, rate) per source of rows (source, size), and the number of sources.

    Weights repeat along the sources in code-point order, null last. Targets share `share` times all
    sizes by weight; none passes `cap` times its source's size, and the excess goes to the others. That
    is a water level found by one-row aggregates: each round fixes the sources at their cap.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = with_rank(sources, F.col("source").isNull(), "source", name="__k")
    weight = F.element_at(F.lit(list(weights)), (F.col("__k") % len(weights) + 1).cast("int"))
    sources = cut(sources.select("source", "source_size", weight.cast("double").alias("__w"), (F.col("source_size") * F.lit(cap)).alias("__cap")))
    n, total, w = sources.agg(F.count(F.lit(1)), F.sum("source_size"), F.sum("__w")).first()
    full, level, fixed = share * (total or 0), 0.0, -1
    level = full / w if w else 0.0
    while n:
        above = F.col("__cap") < F.col("__w") * F.lit(level)
        k, held, rest = sources.agg(
            F.count_if(above), F.sum(F.when(above, F.col("__cap"))), F.sum(F.when(~above, F.col("__w")))
        ).first()
        if k == fixed or not rest:
            break
        fixed, level = k, (full - (held or 0.0)) / rest
    target = F.least(F.col("__cap"), F.col("__w") * F.lit(level))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return sources.withColumn("target", target).withColumn("rate", rate).select("source", "source_size", "target", "rate"), n


def _copies(rate: Column, draw: Column) -> Column:
    whole = F.floor(rate)
    return (whole + F.when(draw < rate - whole, 1).otherwise(0)).cast("int")


def mix_plan(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix"
) -> DataFrame:
    """How often the mix takes each document: doc_id, source, size, source_size, target, copies, taken.

    A source's rate is its target over its size; each document is taken floor(rate) times, and once
    more with probability equal to the fraction, drawn from a hash of seed, doc_id and text.

    Defined cases: null text has size 0; null is a source of its own and comes last; a source without
    words has rate 0; repeated rows share one draw; an empty table gives no rows; other columns are ignored.
    """
    text = F.col("text")
    rows = cut(docs.select("doc_id", "source", word_count(text).alias("size"), bernoulli(seed, F.col("doc_id"), text).alias("__u")))
    rates, n = source_rates(rows, weights, share, cap)
    rates = rates.withColumnRenamed("source", "__source")
    joined = rows.join(broadcast_if_small(rates, n), F.col("source").eqNullSafe(F.col("__source")))
    copies = _copies(F.col("rate"), F.col("__u"))
    return joined.withColumn("copies", copies).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken")
    )


def mix_documents(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix"
) -> DataFrame:
    """The mix itself: the rows of docs, each as often as mix_plan() takes it, with docs' own columns."""
    text, source = docs["text"], docs["source"]
    sizes = cut(docs.select(source.alias("source"), word_count(text).alias("size")).groupBy("source").agg(F.sum("size").alias("size")))
    rates, n = source_rates(sizes, weights, share, cap)
    rates = rates.select(F.col("source").alias("__source"), F.col("rate").alias("__rate"))
    joined = docs.join(broadcast_if_small(rates, n), source.eqNullSafe(F.col("__source")))
    copies = _copies(F.col("__rate"), bernoulli(seed, docs["doc_id"], text))
    times = F.explode(F.array_repeat(F.lit(1), copies)).alias("__time")
    return joined.select(*[docs[c] for c in docs.columns], times).drop("__time")
