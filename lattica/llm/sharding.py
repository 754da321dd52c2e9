"""Sharding along a Hilbert curve over several metadata dimensions. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordering import with_sum_before
from .common import cut, with_rank


def _text_cuts(rows: DataFrame, column: str, levels: int) -> list[tuple[str, int]]:
    """Where the levels of a string column begin: (first value, level), at most one for each level.

    Values are ranked in order by the rows that lie before them, whatever they begin with; nulls lie before all.
    """
    counts = cut(rows.groupBy(column).agg(F.count(F.lit(1)).alias("__n")))
    nulls, total = counts.agg(F.sum(F.when(F.col(column).isNull(), F.col("__n"))), F.sum("__n")).first()
    ranked = with_sum_before(counts.where(F.col(column).isNotNull()), column, "__n")
    level = F.floor((F.col("before") + (nulls or 0)) * levels / (total or 1)).cast("int")
    return [(r[1], r[0]) for r in ranked.groupBy(level.alias("level")).agg(F.min(column)).collect()]


def _text_level(col: Column, cuts: list[tuple[str, int]]) -> Column:
    """The highest level that begins at the value or before it; null has level 0."""
    if not cuts:
        return F.lit(0).cast("long")
    table = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(n).cast("long").alias("n")) for v, n in cuts])
    return F.coalesce(F.array_max(F.transform(F.filter(table, lambda c: c["v"] <= col), lambda c: c["n"])), F.lit(0))


def _level(col: Column, cuts: list) -> Column:
    """How many of the ascending cut points lie below the value."""
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(int(c)).cast("long") for c in cuts]), lambda c: c < col)).cast("long")


def hilbert_index(levels: list[Column], bits: int) -> Column:
    """Index along the Hilbert curve of a point with `bits` bits in each dimension (Skilling's transform).

    The loop over bits and axes is an F.aggregate over constant steps, so the expression stays small.
    """
    dims = len(levels)
    steps = [(1 << b, axis) for b in range(bits - 1, 0, -1) for axis in range(dims)]
    plan = F.array(*[F.struct(F.lit(q).cast("long").alias("q"), F.lit(i).alias("i")) for q, i in steps])

    def step(x: Column, s: Column) -> Column:
        low = s["q"] - 1
        axis, first = F.element_at(x, s["i"] + 1), F.element_at(x, 1)
        swap = first.bitwiseXOR(axis).bitwiseAND(low)
        hit = axis.bitwiseAND(s["q"]) != 0
        return F.transform(
            x,
            lambda v, j: F.when(hit, F.when(j == 0, v.bitwiseXOR(low)).otherwise(v))
            .when((j == 0) | (j == s["i"]), v.bitwiseXOR(swap))
            .otherwise(v),
        )

    turned = F.aggregate(plan, F.array(*[c.cast("long") for c in levels]), step)
    # Gray encoding: each axis takes the exclusive or of all axes before it
    gray = F.aggregate(
        turned,
        F.lit([]).cast("array<long>"),
        lambda acc, v: F.concat(acc, F.array(F.when(F.size(acc) == 0, v).otherwise(v.bitwiseXOR(F.element_at(acc, -1))))),
    )
    checks = F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)])

    def flips(g: Column) -> Column:
        last = F.element_at(g, -1)
        return F.aggregate(
            checks, F.lit(0).cast("long"), lambda t, q: F.when(last.bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t)
        )

    # the array is bound once as a one-element list, so that it is not computed again for each use
    points = F.transform(F.array(gray), lambda g: F.transform(g, lambda v: v.bitwiseXOR(flips(g))))
    places = F.array(*[F.lit(b).cast("int") for b in range(bits - 1, -1, -1)])
    index = F.transform(
        points,
        lambda p: F.aggregate(
            places,
            F.lit(0).cast("long"),
            lambda acc, b: F.aggregate(
                p, acc, lambda a, v: a * 2 + F.call_function("shiftright", v, b).bitwiseAND(F.lit(1).cast("long"))
            ),
        ),
    )
    return F.element_at(index, 1)


def hilbert_shards(docs: DataFrame, shards: int = 24, bits: int = 4, carry: bool = False) -> DataFrame:
    """Put every row into one of `shards` runs of a Hilbert curve over (source, lang, size).

    Each dimension is quantised at its own quantiles to `bits` bits (the size's are approximate), rows are ordered by
    curve index and cut into runs whose row counts differ by one at most, so the files of a shard
    cover a narrow range in every dimension. Returns doc_id, source, lang, size, text_crc32, curve,
    shard, slot, and with carry=True the whole input row as struct `row`. Files: write_shards().

    Defined cases: null text counts no bytes (size 8, crc 0); null metadata take the lowest level;
    repeated rows and equal keys are placed one by one, in any order among themselves; an empty table
    gives no rows; other input columns are ignored, whatever their names.
    """
    text = F.col("text")
    rows = docs.select(
        "doc_id", "source", "lang",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64("text", "doc_id").alias("__tie"),
        *([F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else []),
    )
    rows = cut(rows)
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    sizes = rows.agg(F.percentile_approx("size", shares, 10_000)).first()[0]
    levels = [_text_level(F.col(c), _text_cuts(rows, c, 1 << bits)) for c in ("source", "lang")]
    levels.append(_level(F.col("size"), sorted(set(sizes or []))))
    placed = rows.withColumn("curve", hilbert_index(levels, bits))
    ranked = with_rank(placed, "curve", "__tie", "doc_id", name="__rank")
    total = rows.count()
    low, more = divmod(total, shards)
    rank, edge = F.col("__rank"), more * (low + 1)
    late = F.lit(more) + F.floor((rank - edge) / max(low, 1))
    shard = F.when(rank < edge, F.floor(rank / (low + 1))).otherwise(late)
    start = F.when(F.col("shard") <= more, F.col("shard") * (low + 1)).otherwise(edge + (F.col("shard") - more) * low)
    return ranked.withColumn("shard", shard.cast("int")).withColumn("slot", (rank - start).cast("long")).drop("__rank", "__tie")


def write_shards(assigned: DataFrame, path: str) -> None:
    """Write hilbert_shards(carry=True) as one folder per shard, rows in curve order.

    A shard may be a third of a hundred terabytes over 24: its files are cut by Spark's task split, as
    each shard is spread over slot blocks of a million rows.
    """
    block = F.floor(F.col("slot") / 1_000_000)
    (
        assigned.repartition("shard", block)
        .sortWithinPartitions("shard", "slot")
        .select("row.*", F.col("shard").alias("__shard"))
        .write.partitionBy("__shard")
        .parquet(path)
    )
