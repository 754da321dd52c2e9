"""Near-duplicate embeddings by product quantisation: inverted lists, residual codes, exact rerank."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut
from .vectors import matrix, usable, vector_keys


@dataclass
class Quantizer:
    """Coarse centres, and for each subspace the centres of what is left after the coarse one."""

    coarse: np.ndarray
    books: list[np.ndarray]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest coarse centre of each row, and squared distances to all."""
        d = (x * x).sum(1)[:, None] - 2 * x @ self.coarse.T + (self.coarse**2).sum(1)
        return d.argmin(1), d

    def encode(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals, and how far each residual is from what its code says."""
        codes = np.empty((len(rest), len(self.books)), np.uint8)
        error, at = np.zeros(len(rest)), 0
        for m, book in enumerate(self.books):
            part = rest[:, at : at + book.shape[1]]
            at += book.shape[1]
            d = (part * part).sum(1)[:, None] - 2 * part @ book.T + (book**2).sum(1)
            codes[:, m] = d.argmin(1)
            error += ((part - book[codes[:, m]]) ** 2).sum(1)
        return codes, np.sqrt(error)

    def tables(self, rest: np.ndarray) -> np.ndarray:
        """Squared distances of residuals to every entry of every book: (rows, books, entries)."""
        out, at = [], 0
        for book in self.books:
            part = rest[:, at : at + book.shape[1]]
            at += book.shape[1]
            out.append(((part[:, None, :] - book[None]) ** 2).sum(2))
        return np.stack(out, 1)


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        order = np.argsort(own, kind="stable")
        used, first = np.unique(own[order], return_index=True)
        centres[used] = np.add.reduceat(x[order], first) / np.diff(np.append(first, len(x)))[:, None]
    return centres


def fit(sample: np.ndarray, lists: int, subspaces: int = 16, entries: int = 64) -> Quantizer:
    coarse = _kmeans(sample, lists, 8)
    own = Quantizer(coarse, []).nearest(sample)[0]
    rest = sample - coarse[own]
    parts = np.array_split(np.arange(sample.shape[1]), min(subspaces, sample.shape[1]))
    return Quantizer(coarse, [_kmeans(np.ascontiguousarray(rest[:, p]), entries, 6) for p in parts])


def _deal(sent, reach: float, others: int = 12):
    """Each vector to its own list as a member, and to all lists that may hold a link as a query.

    With x and a linked y at most `reach` apart, y lies nearer to centre c than to any other centre c'
    only if d(x,c)^2 - d(x,c')^2 <= 2 * reach * |c - c'|; this is asked of the `others` centres nearest to
    x, so the probes are sufficient for every link. Of two lists the one with the higher number asks.
    role: 0 member, 1 query of its own list, 2 query of another list.
    """

    def probes(x: np.ndarray, q: Quantizer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own, d = q.nearest(x)
        apart = np.sqrt(np.maximum((q.coarse**2).sum(1)[:, None] - 2 * q.coarse @ q.coarse.T + (q.coarse**2).sum(1), 0))
        n = min(others, d.shape[1])
        near = np.argpartition(d, n - 1, axis=1)[:, :n]
        probe = np.arange(d.shape[1])[None, :] <= own[:, None]
        for k in range(n):
            c = near[:, k]
            probe &= d - d[np.arange(len(x)), c][:, None] <= 2 * reach * apart[c] + 1e-9
        probe[np.arange(len(x)), own] = True
        return own, *np.nonzero(probe)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantizers = sent.value
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x = matrix(part.column("vector"))
                x = x / np.sqrt((x * x).sum(1))[:, None]
                q = quantizers[int(dim)]
                own, row, to = probes(x, q)
                asks = np.where(to == own[row], 1, 2).astype(np.int8)
                for role, rows, lists in ((np.zeros(len(x), np.int8), np.arange(len(x)), own), (asks, row, to)):
                    some = part.take(pa.array(rows))
                    cols = [some.column(c) for c in ("label", "dim", "id", "n", "vector")]
                    cols += [pa.array(lists.astype(np.int32)), pa.array(role)]
                    yield pa.RecordBatch.from_arrays(cols, ["label", "dim", "id", "n", "vector", "list", "role"])

    return run


def _roots(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest member of each of n nodes' components."""
    root = np.arange(n)
    while True:
        before = root.copy()
        for a, b in pairs:
            least = np.minimum(root[a], root[b])
            np.minimum.at(root, a, least)
            np.minimum.at(root, b, least)
        root = root[root]
        if (root == before).all():
            return root


def _compare(sent, threshold: float, reach: float):
    """Queries of one list against its members: table-lookup distances, then exact cosines."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        role = table.column("role").to_numpy()
        ids, copies = table.column("id").to_numpy(), table.column("n").to_numpy()
        x = matrix(table.column("vector"))
        unit = x / np.sqrt((x * x).sum(1))[:, None]
        q = sent.value[x.shape[1]]
        rest = unit - q.coarse[table.column("list")[0].as_py()]
        members, queries = np.flatnonzero(role == 0), np.flatnonzero(role > 0)
        if not len(members) or not len(queries):
            return schema.empty_table()
        codes, error = q.encode(rest[members])
        number = {int(i): k for k, i in enumerate(dict.fromkeys(np.concatenate([ids[members], ids[queries]]).tolist()))}
        node = np.array([number[int(i)] for i in ids])
        pairs, links, back = [], np.zeros(len(queries), np.int64), np.zeros(len(members), np.int64)
        limit = ((reach + error + 1e-6) ** 2 + 1e-5).astype(np.float32)
        for at in range(0, len(queries), 64):
            some = queries[at : at + 64]
            tables = q.tables(rest[some]).astype(np.float32)
            near = np.zeros((len(some), len(members)), np.float32)
            for book in range(len(q.books)):
                near += tables[:, book].take(codes[:, book], axis=1)
            ask, hit = np.nonzero(near <= limit)
            u, v = some[ask], members[hit]
            cosine = (x[u] * x[v]).sum(1) / (np.sqrt((x[u] ** 2).sum(1)) * np.sqrt((x[v] ** 2).sum(1)))
            linked = (cosine >= threshold) & (ids[u] != ids[v])
            ask, hit, u, v = ask[linked], hit[linked], u[linked], v[linked]
            np.add.at(links, at + ask, copies[v])
            cross = role[u] == 2  # the member does not ask back
            np.add.at(back, hit[cross], copies[u[cross]])
            pairs.append((node[u], node[v]))
        root, name = _roots(len(number), pairs), np.array(list(number))
        # a star for each component within the group in place of all its links
        least = np.full(len(name), np.iinfo(np.int64).max)
        np.minimum.at(least, root, name)
        some = np.flatnonzero(least[root] != name)
        asked, met = np.flatnonzero(links), np.flatnonzero(back)
        a, b = [name[some], ids[queries[asked]], ids[members[met]]], [least[root][some], ids[queries[asked]], ids[members[met]]]
        n = [np.zeros(len(some), np.int64), links[asked], back[met]]
        return pa.table([np.concatenate(a), np.concatenate(b), np.concatenate(n)], schema=schema)

    return run


def near_embeddings(vectors: DataFrame, threshold: float = 0.98, sample: int = 20_000, group: int = 4096) -> DataFrame:
    """Link vectors of one label with a cosine of `threshold` or more; one row per input row.

    Returns vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable by
    links), kept (vec_id = component_id). Centres and codes are fitted on about `sample` vectors; all
    vectors are indexed, and all of a list that may hold a link is compared. A group of more than
    `group` members or queries is compared in blocks.

    Defined cases: a vector that is null, zero or holds null or non-finite components, a null label and
    a null vec_id link with nothing (n_links 0, component its own vec_id); vectors of different length
    never link; equal vectors link with each other; rows that share a vec_id are one node of the
    components; an empty table gives no rows; other columns are ignored.
    """
    v = F.col("embedding")
    able = usable(v) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), "embedding", able.alias("able"))
    rows = rows.select("*", *vector_keys(F.col("label"), v))
    classes = rows.where("able").groupBy("k1", "k2").agg(
        F.first("label").alias("label"), F.first("embedding").alias("vector"),
        F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"),
    )
    classes = cut(classes.withColumn("dim", F.size("vector")))
    spark = vectors.sparkSession
    quantizers = {}
    for dim, n in classes.groupBy("dim").count().collect():  # one row per vector length
        some = classes.where(F.col("dim") == dim).where(F.pmod(F.xxhash64("k2"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, sample / n))))
        x = np.array([r[0] for r in some.select("vector").collect()])
        if not len(x):
            x = np.array([classes.where(F.col("dim") == dim).select("vector").first()[0]])
        quantizers[dim] = fit(x / np.sqrt((x * x).sum(1))[:, None], max(1, min(1024, n // 1000)))
    sent = spark.sparkContext.broadcast(quantizers)  # bounded by the sample
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-7
    kind = dict(vectors.dtypes)["embedding"]
    schema = f"label string, dim int, id long, n long, vector {kind}, list int, role tinyint"
    dealt = classes.select("label", "dim", "id", "n", "vector").mapInArrow(_deal(sent, reach), schema)
    keys = ["label", "dim", "list"]
    sizes = dealt.groupBy(*keys).agg(F.count_if(F.col("role") == 0).alias("m"), F.count_if(F.col("role") > 0).alias("q")).where("m > 0")
    parts = [F.ceil(F.col(c) / group).cast("int") for c in ("m", "q")]
    sizes = cut(sizes.select(*keys, parts[0].alias("mb"), parts[1].alias("qb")))
    cells = dealt.join(sizes, keys)
    query = F.col("role") > 0
    own = F.when(query, F.pmod(F.xxhash64("id"), "qb")).otherwise(F.pmod(F.xxhash64("id"), "mb"))
    times = F.when(query, F.col("mb")).otherwise(F.col("qb"))
    cells = cells.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), times - 1)))
    block = F.when(query, F.struct(F.col("other").cast("long").alias("m"), F.col("own").alias("q"))).otherwise(
        F.struct(F.col("own").alias("m"), F.col("other").cast("long").alias("q"))
    )
    cells = cells.withColumn("block", block).select(*keys, "id", "n", "vector", "role", "block")
    found = cut(cells.groupBy(*keys, "block").applyInArrow(_compare(sent, threshold, reach), "a long, b long, links long"))
    links = found.where("a = b").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    parts = components(found.where("a <> b").select("a", "b")).withColumnRenamed("node", "id")
    known = classes.select("k1", "k2", "id", "n").join(links, "id", "left").join(parts, "id", "left")
    known = known.select(
        F.col("k1").alias("c1"), F.col("k2").alias("c2"),
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("root", "id").alias("root"),
    )
    out = rows.select("vec_id", "able", "k1", "k2").join(known, F.col("able") & (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left")
    component = F.coalesce("root", "vec_id")
    return out.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
