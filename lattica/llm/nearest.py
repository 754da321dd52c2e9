"""Approximate nearest neighbours: a navigable small-world graph per shard, answers merged."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .vectors import matrix, usable, vector_keys


class Graph:
    """Hierarchical navigable small-world graph over the rows of x, as flat neighbour arrays.

    Level 0 is one (n, 2m) array of row numbers; each higher level has an (n_level, m) array over the
    rows that reach it, with `place` from a row to its slot there. -1 fills unused slots.
    """

    def __init__(self, x: np.ndarray, m: int = 16, width: int = 100, seed: int = 5):
        self.x = np.ascontiguousarray(x, np.float32)
        self.m, self.width = m, width
        n = len(x)
        self.half = (self.x**2).sum(1) / 2  # |a-b|^2 / 2 = half[a] + half[b] - a.b
        draw = np.random.default_rng(seed).random(n)
        self.level = np.minimum((-np.log(np.maximum(draw, 1e-12)) / math.log(m)).astype(int), 12)
        self.links, self.place = [], []
        for level in range(int(self.level.max(initial=0)) + 1):
            rows = np.flatnonzero(self.level >= level)
            place = np.full(n, -1, np.int32)
            place[rows] = np.arange(len(rows))
            self.place.append(place)
            self.links.append(np.full((len(rows), 2 * m if level == 0 else m), -1, np.int32))
        self.used = [np.zeros(len(a), np.int32) for a in self.links]
        self.seen, self.stamp = np.zeros(n, np.int64), 0
        self.entry = -1
        for row in range(n):
            self._insert(row)

    @classmethod
    def restore(cls, x: np.ndarray, entry: int, links: list[np.ndarray], place: list[np.ndarray]) -> Graph:
        """A graph to search, from its stored arrays."""
        self = cls.__new__(cls)
        self.x, self.entry, self.links, self.place = np.ascontiguousarray(x, np.float32), entry, links, place
        self.half = (self.x**2).sum(1) / 2
        self.used = [(a >= 0).sum(1) for a in links]
        self.seen, self.stamp = np.zeros(len(x), np.int64), 0
        return self

    def _search(self, q: np.ndarray, half: float, start: list[tuple[float, int]], width: int, level: int) -> list[tuple[float, int]]:
        """The `width` nearest rows found from the start rows on, nearest first."""
        self.stamp += 1
        seen, stamp, links, used, place = self.seen, self.stamp, self.links[level], self.used[level], self.place[level]
        for _, row in start:
            seen[row] = stamp
        near = list(start)
        heapq.heapify(near)
        best = [(-d, row) for d, row in start]
        heapq.heapify(best)
        while near:
            d, row = heapq.heappop(near)
            if d > -best[0][0] and len(best) >= width:
                break
            slot = place[row]
            other = links[slot, : used[slot]]
            other = other[seen[other] != stamp]
            if not len(other):
                continue
            seen[other] = stamp
            far = self.half[other] - self.x[other] @ q + half
            worst = -best[0][0]
            if len(best) >= width:
                keep = far < worst
                other, far = other[keep], far[keep]
            for e, o in zip(far.tolist(), other.tolist()):
                if len(best) < width:
                    heapq.heappush(best, (-e, o))
                elif e < -best[0][0]:
                    heapq.heapreplace(best, (-e, o))
                else:
                    continue
                heapq.heappush(near, (e, o))
        return sorted((-d, row) for d, row in best)

    def _select(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Up to `most` of the rows, nearest first, each nearer to the base than to those taken; then the rest."""
        if len(found) <= most:
            return [row for _, row in found]
        rows = np.array([row for _, row in found])
        part = self.x[rows]
        apart = self.half[rows][:, None] + self.half[rows] - part @ part.T
        least = np.full(len(rows), np.inf)
        taken, left = [], []
        for k, (d, row) in enumerate(found):
            if d < least[k]:
                taken.append(row)
                np.minimum(least, apart[k], out=least)
                if len(taken) == most:
                    return taken
            else:
                left.append(row)
        return taken + left[: most - len(taken)]

    def _insert(self, row: int) -> None:
        top = int(self.level[row])
        if self.entry < 0:
            self.entry = row
            return
        q, half = self.x[row], float(self.half[row])
        high = int(self.level[self.entry])
        now = [(float(self.half[self.entry] - self.x[self.entry] @ q + half), self.entry)]
        for level in range(high, top, -1):
            now = self._search(q, half, now, 1, level)
        for level in range(min(top, high), -1, -1):
            now = self._search(q, half, now, self.width, level)
            own = self._select(now[: 3 * self.m], self.m)
            links, used, place = self.links[level], self.used[level], self.place[level]
            slot = place[row]
            links[slot, : len(own)] = own
            used[slot] = len(own)
            for other in own:
                back = place[other]
                if used[back] < links.shape[1]:
                    links[back, used[back]] = row
                    used[back] += 1
                    continue
                rows = np.append(links[back], row)
                far = self.half[rows] - self.x[rows] @ self.x[other] + self.half[other]
                order = np.argsort(far, kind="stable")
                keep = self._select(list(zip(far[order].tolist(), rows[order].tolist())), links.shape[1] * 3 // 4)
                links[back] = -1
                links[back, : len(keep)] = keep
                used[back] = len(keep)
        if top > high:
            self.entry = row

    def search(self, q: np.ndarray, k: int, width: int) -> np.ndarray:
        """About the k nearest rows of q, nearest first."""
        q = np.asarray(q, np.float32)
        half = float((q**2).sum() / 2)
        now = [(float(self.half[self.entry] - self.x[self.entry] @ q + half), self.entry)]
        for level in range(len(self.links) - 1, 0, -1):
            if self.place[level][self.entry] >= 0:
                now = self._search(q, half, now, 1, level)
        return np.array([row for _, row in self._search(q, half, now, max(width, k), 0)[:k]])


_INDEX = "shard long, dim int, rows int, entry int, ids array<array<long>>, vectors binary, links array<binary>, place array<binary>"


def _build(table: pa.Table) -> pa.Table:
    x = matrix(table.column("vector"))
    graph = Graph(x)
    values = [
        [table.column("shard")[0].as_py()], [x.shape[1]], [len(x)], [graph.entry], [table.column("ids").to_pylist()],
        [x.tobytes()], [[a.tobytes() for a in graph.links]], [[a.tobytes() for a in graph.place]],
    ]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.list_(pa.int64())), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary())]
    names = [c.split()[0] for c in ("shard x", "dim x", "rows x", "entry x", "ids x", "vectors x", "links x", "place x")]
    return pa.table([pa.array(v, t) for v, t in zip(values, types)], names=names)


def build_index(vectors: DataFrame, k: int = 10, shard_rows: int = 4096) -> DataFrame:
    """One row per shard of about `shard_rows` different vectors: the vectors and their graph's arrays.

    Equal vectors are one node that carries its k + 1 smallest vec_ids, so copies can't crowd a graph.
    Every vector with an id is indexed. The table is written down (checkpoint) for the searches that follow.
    """
    rows = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.select("*", *vector_keys(F.col("vector")))
    # Spark limits ranks before the shuffle too, so a hot vector sends k + 1 ids a task
    order = F.row_number().over(Window.partitionBy("k1", "k2").orderBy(F.col("vec_id").asc_nulls_last()))
    first = rows.select("k1", "k2", "vec_id").withColumn("r", order).where(F.col("r") <= k + 1)
    ids = first.groupBy("k1", "k2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = rows.groupBy("k1", "k2").agg(F.first("vector").alias("vector")).join(ids, ["k1", "k2"])
    nodes = cut(nodes.withColumn("dim", F.size("vector")))
    sizes = {r["dim"]: r["count"] for r in nodes.groupBy("dim").count().collect()}  # one row per vector length
    shards = F.lit(1)
    for dim, n in sizes.items():
        shards = F.when(F.col("dim") == dim, F.lit(math.ceil(n / shard_rows))).otherwise(shards)
    nodes = nodes.withColumn("shard", F.pmod(F.xxhash64("k1", "k2"), shards).cast("long"))
    return cut(nodes.groupBy("shard", "dim").applyInArrow(_build, _INDEX))


def _search_blocks(k: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, None)
        for batch in batches:
            for row in range(batch.num_rows):
                at = {c: batch.column(c)[row].as_py() for c in ("shard", "dim")}
                if held[0] != (at["shard"], at["dim"]):
                    one = {c: batch.column(c)[row].as_py() for c in ("rows", "entry", "ids", "vectors", "links", "place")}
                    x = np.frombuffer(one["vectors"], np.float64).reshape(one["rows"], at["dim"])
                    place = [np.frombuffer(b, np.int32) for b in one["place"]]
                    links = [np.frombuffer(b, np.int32) for b in one["links"]]
                    links = [b.reshape((p >= 0).sum(), -1) for b, p in zip(links, place)]
                    held = ((at["shard"], at["dim"]), (Graph.restore(x, one["entry"], links, place), x, one["ids"]))
                graph, x, ids = held[1]
                out = []
                own_ids, own_keys, vectors = batch.column("asks")[row].values.flatten()
                vectors = vectors.flatten().to_numpy().reshape(len(own_ids), -1)
                for vec_id, k1, q in zip(own_ids.to_pylist(), own_keys.to_pylist(), vectors):
                    rows = graph.search(q, k + 1, width)
                    exact = np.sqrt(((x[rows] - q) ** 2).sum(1))
                    hits = sorted((d, i) for d, r in zip(exact.tolist(), rows.tolist()) for i in ids[r])
                    own = next((h for h in hits if h[1] == vec_id and h[0] == 0), None)
                    if own:
                        hits.remove(own)  # the query's own row, once
                    out += [(vec_id, k1, i, d) for d, i in hits[:k]]
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["query_id", "k1", "vec_id", "score"])

    return run


def search(index: DataFrame, queries: DataFrame, k: int = 10, width: int = 160, block: int = 4096) -> DataFrame:
    """The k nearest vectors found for each query (vec_id, embedding) by Euclidean distance.

    Queries go in blocks to every shard of their vector length; each shard answers with its k best and
    the answers are merged. A block is about as large as a shard: a shard is copied once per block, and a
    block once per shard. Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id.
    """
    asked = queries.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    asked = asked.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    asked = asked.select("vec_id", vector_keys(F.col("vector"))[0], "vector").dropDuplicates(["vec_id", "k1"])
    asked = cut(asked.withColumn("dim", F.size("vector")))
    blocks = max(1, math.ceil(asked.count() / block))
    asked = asked.groupBy("dim", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block")).agg(
        F.collect_list(F.struct("vec_id", "k1", "vector")).alias("asks")
    )
    shards = index.groupBy("dim").agg(F.max("shard").alias("last"))
    asked = asked.join(F.broadcast(shards), "dim")  # one row per vector length
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    met = index.join(asked.select("dim", "shard", "block", "asks"), ["shard", "dim"])
    names = ["shard", "dim", "rows", "entry", "ids", "vectors", "links", "place", "asks"]
    hits = met.select(*names).mapInArrow(_search_blocks(k, width), "query_id long, k1 long, vec_id long, score double")
    order = F.row_number().over(Window.partitionBy("query_id", "k1").orderBy("score", "vec_id"))
    return hits.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(vectors: DataFrame, k: int = 10, every: int = 100, shard_rows: int = 4096, width: int = 160) -> DataFrame:
    """Search the rows of `vectors` whose vec_id is divisible by `every` against all other rows.

    Defined cases: vectors that are null, zero or hold null or non-finite components take no part, nor do
    rows with a null vec_id; a query is matched with vectors of its own length; copies of its vector under other rows are found at distance 0;
    repeated query rows are answered once; an empty table gives no rows; other columns are ignored.
    """
    rows = vectors.select("vec_id", "embedding")
    index = build_index(rows, k, shard_rows)
    return search(index, rows.where(F.col("vec_id") % every == 0), k, width)
