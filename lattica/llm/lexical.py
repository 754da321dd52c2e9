"""Ranked lexical search: postings of document windows are added into small score arrays, then harvested into heaps."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordering import with_sum_before
from .common import cut, table_cut

#: Bytes of UTF-8 that belong to terms stay, A-Z in lower case; all others become spaces.
_TERM_BYTES = bytes(c if c >= 0x80 else ord(chr(c).lower()) if chr(c).isalnum() else 0x20 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms of a UTF-8 text in order: runs of ASCII letters, digits and all code points beyond ASCII; A-Z lower-cased."""
    return text.translate(_TERM_BYTES).split() if text else []


class Windows:
    """Scores blocks of consecutive documents against all items of a block of queries and keeps each item's best.

    items: for each item its (term number, repeats) pairs; weights: int64 weight per term number.
    A window's postings lie sorted by term; an item adds its terms' runs into one array of scores, marks the
    slots it touched in a bitset, and only marked slots are read back, compared with the worst of the heap, and cleared.
    """

    def __init__(self, items: list[list[tuple[int, int]]], weights: np.ndarray, docs: int, terms: int, k: int, size: int):
        self.items, self.weights, self.n_docs, self.n_terms, self.k, self.size = items, weights, docs, terms, k, size
        self.scores = np.zeros(size, np.int64)
        self.heaps: list[list[tuple]] = [[] for _ in items]
        self.seen = 0

    def add(self, ids: list, lengths: np.ndarray, counts: np.ndarray, terms: np.ndarray, tf: np.ndarray) -> None:
        """One window: ids in their order, terms a document holds, and its (term, tf) pairs one document after the other."""
        slot = np.repeat(np.arange(len(ids)), counts)
        m = 100 - 25 + (25 * lengths * self.n_docs) // self.n_terms
        gain = self.weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[slot]))
        order = np.argsort(terms, kind="stable")
        slot, gain, terms = slot[order], gain[order], terms[order]
        present, first = np.unique(terms, return_index=True)
        runs = {t: (slot[a:b], gain[a:b]) for t, a, b in zip(present.tolist(), first.tolist(), [*first[1:].tolist(), len(terms)])}
        bits = {}
        for q, wanted in enumerate(self.items):
            touched = None
            for t, times in wanted:
                run = runs.get(t)
                if run is None:
                    continue
                self.scores[run[0]] += run[1] * times if times > 1 else run[1]
                if t not in bits:
                    mark = np.zeros(self.size, bool)
                    mark[run[0]] = True
                    bits[t] = np.packbits(mark)
                touched = bits[t].copy() if touched is None else np.bitwise_or(touched, bits[t], out=touched)
            if touched is not None:
                self._harvest(self.heaps[q], np.flatnonzero(np.unpackbits(touched)), ids)
        self.seen += len(ids)

    def _harvest(self, heap: list[tuple], slots: np.ndarray, ids: list) -> None:
        found = self.scores[slots]
        self.scores[slots] = 0
        # later documents lose ties, so a full heap takes strictly better scores only
        better = np.flatnonzero(found > (heap[0][0] if len(heap) == self.k else 0))
        if len(better) > self.k:
            better = better[np.argsort(-found[better], kind="stable")[: self.k]]
        for j in better.tolist():
            at = int(slots[j])
            entry = (int(found[j]), -(self.seen + at), ids[at])
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)


def _query_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, times): rows of one item_id are one item, its distinct texts together."""
    kind = dict(items.dtypes)["item_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [Counter(terms_of(t)) for t in batch.column(1).to_pylist()]
            at = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), pa.array([t for c in counts for t in c], pa.binary()), pa.array([n for c in counts for n in c.values()], pa.int64())],
                ["item_id", "term", "times"],
            )

    texts = items.select("item_id", F.col("text").cast("binary").alias("text")).distinct()
    return texts.mapInArrow(run, f"item_id {kind}, term binary, times long").groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def _postings(docs: DataFrame, held) -> DataFrame:
    """(doc_id, n, terms, tfs): every document's number of terms, and the asked terms that it holds; texts are read once."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: k for k, t in enumerate(held.value)}
        for batch in batches:
            lengths, terms, tfs, ends = [], [], [], [0]
            for text in batch.column(1):
                words = terms_of(text.as_py())
                lengths.append(len(words))
                for t, n in Counter(words).items():
                    k = number.get(t)
                    if k is not None:
                        terms.append(k)
                        tfs.append(n)
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, tfs array<int>")


def _best_of_windows(postings: DataFrame, plan, item_kind: str, k: int, window: int, held: int) -> DataFrame:
    """(item_id, doc_id, score): the best of each partition for each item."""
    kind = dict(postings.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, items, weights, docs, terms = plan.value
        scorer = Windows(items, weights, docs, terms, k, window)
        id_type = name_type = None
        for batch in batches:
            id_type, name_type = batch.schema.field(0).type, pa.array(names).type if any(x is not None for x in names) else None
            at = 0
            ends = np.cumsum(batch.column(2).value_lengths().to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros(0, np.int64)
            while at < batch.num_rows:  # a window has `window` documents or about `held` postings at most
                full = np.searchsorted(ends, (ends[at - 1] if at else 0) + held, side="right")
                to = min(at + window, batch.num_rows, max(int(full), at + 1))
                part = batch.slice(at, to - at)
                lists = [part.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3)]
                if len(lists[0]):
                    counts = part.column(2).value_lengths().to_numpy(zero_copy_only=False)
                    scorer.add(part.column(0).to_pylist(), part.column(1).to_numpy(), counts, lists[0], lists[1].astype(np.int64))
                at = to
        rows = [(q, doc, score) for q, heap in enumerate(scorer.heaps) for score, _, doc in heap]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[r[0]] for r in rows], name_type), pa.array([r[1] for r in rows], id_type), pa.array([r[2] for r in rows], pa.int64())],
                ["item_id", "doc_id", "score"],
            )

    in_order = postings.where("size(terms) > 0").sortWithinPartitions(F.col("doc_id").asc_nulls_last())
    return in_order.mapInArrow(run, f"item_id {item_kind}, doc_id {kind}, score long")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20, window: int = 4096, block: int = 1 << 20, held: int = 1 << 21) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k highest-scoring documents with a score above 0.

    Items are taken in blocks of about `block` (item, term) pairs, which is what the driver and a broadcast hold. For a
    block one pass over the texts writes each document's length and its postings of the block's terms to the
    shared folder; counts of documents and terms come from that table. Then every partition walks its documents in
    order of doc_id, `window` at a time: postings are added into an array of scores, harvested into a heap an item, and at
    most k rows an item leave a partition. Postings are never shuffled, and nothing depends on how many documents
    share a term or an id. A document's score is a sum of integers, so results do not hang on partitions.

    Defined cases: a null text, or one without terms, counts nowhere and is never found; rows with a null doc_id
    are documents too and come last among equal scores; repeated rows are documents of their own; rows of one item_id
    are one item with the terms of its distinct texts, null item_id included; an item without terms, or whose terms
    no document holds, has no rows; empty tables give no rows; other columns are ignored.
    """
    session, item_kind, doc_kind = docs.sparkSession, dict(items.dtypes)["item_id"], dict(docs.dtypes)["doc_id"]
    asked = table_cut(_query_terms(items))
    sizes = asked.groupBy("item_id").agg(F.count(F.lit(1)).alias("pairs"))
    placed = cut(with_sum_before(sizes, "item_id", "pairs").withColumn("block", F.floor(F.col("before") / block)))
    last = placed.agg(F.max("block")).first()[0]
    found = []
    for b in range(0 if last is None else last + 1):
        those = placed.where(F.col("block") == b).select(F.col("item_id").alias("__id"))
        pairs = asked.join(those, F.col("item_id").eqNullSafe(F.col("__id"))).select("item_id", "term", "times").collect()
        if not pairs:
            continue
        vocabulary = sorted({bytes(r["term"]) for r in pairs})
        postings = table_cut(_postings(docs, session.sparkContext.broadcast(vocabulary)))
        n_docs, n_terms = postings.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        if not n_docs:
            continue
        held_by = dict(postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # one row a term of the block
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held_by.get(t, 0) + 1))) for t in range(len(vocabulary))], np.int64)
        number = {t: n for n, t in enumerate(vocabulary)}
        lists: dict = {}
        for r in pairs:
            lists.setdefault(r["item_id"], []).append((number[bytes(r["term"])], r["times"]))
        plan = session.sparkContext.broadcast((list(lists), list(lists.values()), weights, n_docs, n_terms))
        found.append(_best_of_windows(postings, plan, item_kind, k, window, held))
    if not found:
        return session.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {doc_kind}, score long")
    best = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = reduce(DataFrame.unionAll, found).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
