"""Packing token sequences into windows: bounded-space best fit per partition, then leftovers."""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Fixed values of the packed form: window length and the id that ends a document.
WINDOW, END_ID = 2048, 1
#: What byte_bpe_50k.json adds to the ranks; it is matched inside texts too.
ADDED = {"<|endoftext|>": 50256}
_LOADED: dict = {}


def load_encoding(path: str | None = None):
    """The byte-level BPE vocabulary file as an encoder, kept once per worker.

    Read from its rank form, with the added token of byte_bpe_50k.json, so that the ids are those of
    `tokenizers` with its defaults (a test holds both against each other): the token's string in a text is the token.
    """
    import public_tokenizers
    import tiktoken

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    if path not in _LOADED:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding(
            "byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED
        )
    return _LOADED[path]


class Windows:
    """At most `limit` open windows; best fit; the fullest is topped up and emitted when none fits.

    add() appends pieces (document, start, length, window, offset, open) to `placed`; `open` holds
    [room, window] of the windows that still have room, sorted by room.
    """

    def __init__(self, limit: int, window: int = WINDOW, least_cut: int = 16):
        self.limit, self.window, self.least_cut = limit, window, least_cut
        self.open: list[tuple[int, int]] = []
        self.next = 0

    def _put(self, k: int, length: int) -> tuple[int, int]:
        room, number = self.open.pop(k)
        if room > length:
            insort(self.open, (room - length, number))
        return number, self.window - room

    def add(self, length: int) -> Iterator[tuple[int, int, int, int]]:
        """Place a document of that length: (start, length, window, offset) of each piece."""
        start = 0
        while length - start >= self.window:
            yield start, self.window, self.next, 0
            self.next += 1
            start += self.window
        while start < length:
            left = length - start
            k = bisect_left(self.open, (left, -1))
            if k < len(self.open):
                number, offset = self._put(k, left)
                yield start, left, number, offset
                return
            if len(self.open) < self.limit:
                self.open.append((self.window - left, self.next))
                self.open.sort()
                yield start, left, self.next, 0
                self.next += 1
                return
            room = self.open[0][0]
            if room < self.least_cut:
                self.open.pop(0)  # emitted as it is; the rest is padding
                continue
            number, offset = self._put(0, room)
            yield start, room, number, offset
            start += room


def _encode(batches: Iterator[pa.RecordBatch], tokenizer: str | None, with_ids: bool, open_windows: int, window: int):
    encoding = load_encoding(tokenizer)
    part = TaskContext.get().partitionId()
    held = Windows(open_windows, window)
    for batch in batches:
        rows: list[tuple] = []
        for row, text in enumerate(batch.column(1)):
            ids = np.append(encoding.encode_to_numpy(text.as_py() or "", allowed_special="all"), np.uint32(END_ID)).astype("<u4")
            for start, length, number, offset in held.add(len(ids)):
                piece = ids[start : start + length]
                rows.append((row, start, length, zlib.crc32(piece.tobytes()), len(ids), number, offset, piece if with_ids else None))
        if not rows:
            continue
        row, *numbers, ids = zip(*rows)
        cols = [batch.column(0).take(pa.array(row, pa.int64())), *[pa.array(c, pa.int64()) for c in numbers]]
        cols += [pa.array([part] * len(rows), pa.int64())] + ([pa.array(ids, pa.list_(pa.int64()))] if with_ids else [])
        yield pa.RecordBatch.from_arrays(cols, [f"c{k}" for k in range(len(cols))])
    # the rooms that are left: one row each, so that later steps know which windows are still open
    if held.open:
        n = len(held.open)
        none = [pa.nulls(n, pa.int64())] * 4
        first = pa.nulls(n, batch.schema.field(0).type)
        room, number = zip(*held.open)
        cols = [first, *none[:3], none[3], pa.nulls(n, pa.int64()), pa.array(number, pa.int64()), pa.array(room, pa.int64())]
        cols[3] = pa.nulls(n, pa.int64())
        cols = cols[:7] + [pa.array([part] * n, pa.int64())] + ([pa.nulls(n, pa.list_(pa.int64()))] if with_ids else [])
        yield pa.RecordBatch.from_arrays(cols, [f"c{k}" for k in range(len(cols))])


def _merge(window: int):
    def run(table: pa.Table) -> pa.Table:
        """Lay the pieces of a group's open windows into new windows, longest first, each in the tightest room."""
        lengths = table.column("length").to_numpy()
        order = np.lexsort((table.column("offset").to_numpy(), table.column("window").to_numpy(), table.column("part").to_numpy(), -lengths))
        held = Windows(len(lengths) + 1, window)
        number, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        for k in order:
            (_, _, number[k], offset[k]), *_ = held.add(int(lengths[k]))
        table = table.set_column(table.schema.get_field_index("window"), "window", pa.array(number))
        return table.set_column(table.schema.get_field_index("offset"), "offset", pa.array(offset))

    return run


def pack_documents(
    docs: DataFrame, tokenizer: str | None = None, open_windows: int = 16, window: int = WINDOW,
    with_ids: bool = False, merge_parts: int = 64,
) -> DataFrame:
    """Pack the token ids of all documents, each closed by the end id, into sequences of `window` ids.

    Each partition keeps `open_windows` windows: a document goes to the window with the least room that
    takes it; when none fits and no more may be opened, it fills the fullest one, which is emitted, and
    goes on with the rest. What is open at the end is merged: the pieces of `merge_parts` partitions are
    packed anew, longest first, so a group is bounded by merge_parts * open_windows windows.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids). Pieces are
    written down once, before open and emitted windows part, so a lost executor can't mix two packings.

    Defined cases: null and empty texts are the end id alone; long documents are cut into whole windows;
    repeated rows are packed one by one; an empty table gives no rows; other columns are ignored.
    """
    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "window", "offset", "part", *(["ids"] if with_ids else [])]
    schema = f"c0 {kind}, " + ", ".join(f"c{k} long" for k in range(1, 8)) + (", c8 array<long>" if with_ids else "")

    def run(batches):
        return _encode(batches, tokenizer, with_ids, open_windows, window)

    pieces = cut(docs.select("doc_id", "text").mapInArrow(run, schema).toDF(*names))
    still = pieces.where("start is null").select("part", "window").withColumn("__open", F.lit(True))
    real = pieces.where("start is not null").join(still, ["part", "window"], "left")
    closed = real.where("__open is null").withColumn("sequence_id", F.col("part") * (1 << 36) + F.col("window"))
    group = F.floor(F.col("part") / merge_parts).alias("__group")
    opened = real.where("__open").select(*names, group)
    merged = opened.groupBy("__group").applyInArrow(_merge(window), opened.schema)
    merged = merged.withColumn("sequence_id", F.lit(1 << 61) + F.col("__group") * (1 << 36) + F.col("window"))
    out = [*names[:5], "sequence_id", "offset", *names[8:]]
    return closed.select(*out).unionByName(merged.select(*out))
