"""Removal of long repeated byte strings by difference-cover suffix sorting.

The suffix sort itself runs over text that can hold a repeat at all. A fingerprint pass finds that text
without loss: every string of `length` bytes has one fingerprint, the smallest hash among the 32-byte
strings in it (its anchor), and equal strings have equal anchors. Runs of string starts that share an
anchor go, with the bytes that their strings cover, to the task of that anchor if the anchor occurs
again. There the suffixes that start the strings are sorted:

* positions whose distance from the anchor lies in a difference cover modulo 31 are sampled; their
  31-byte blocks are sorted and named, triples of names are sorted and named again, and so on until a
  name stands for more than `length` bytes;
* the remaining suffixes are merged in from right to left by (byte, name of the next suffix);
* neighbours in that order are compared, by hashes and then by their bytes: equal prefixes of `length`
  bytes are repeats.

Residues are counted from the anchor, so two strings that may be equal have equal residues.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions_of, table_cut, text_key

#: A perfect difference set, i.e. every residue modulo 31 is a difference of two of these.
COVER, MODULUS = (0, 1, 3, 8, 12, 18), 31
SEED_BYTES = 32
_PLACE_BITS = 24
_U = np.uint64


def byte_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of the SEED_BYTES bytes from each position on, by doubling."""
    h = np.frombuffer(data, np.uint8).astype(_U) + _U(1)
    mult, width = 0x9E3779B97F4A7C15, 1
    while width < SEED_BYTES:
        if len(h) <= width:
            return np.empty(0, _U)
        h = h[:-width] * _U(mult) + h[width:]
        h ^= h >> _U(31)
        mult, width = mult * mult % (1 << 64) | 1, width * 2
    h *= _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def anchors(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts of strings of `length` bytes with one anchor: hash, anchor position, first start, starts.

    The anchor of a string is the leftmost place whose hash is smallest in its upper 40 bits; places fill
    the lower bits while minima slide along, so very long texts go piece by piece.
    """
    none = np.empty(0, np.int64)
    if len(data) < length:
        return none.astype(_U), none, none, none
    step = (1 << _PLACE_BITS) - length
    if len(data) - length >= step:
        parts = []
        for off in range(0, len(data) - length + 1, step):
            h, p, s, n = anchors(data[off : off + step + length - 1], length)
            parts.append((h, p + off, s + off, n))
        return tuple(np.concatenate(c) for c in zip(*parts))
    width = length - SEED_BYTES + 1
    h = byte_hashes(data)
    n = len(h)
    low = _U((1 << _PLACE_BITS) - 1)
    packed = (h & ~low) | np.arange(n, dtype=_U)
    blocks = np.concatenate([packed, np.full(-n % width, ~_U(0))]).reshape(-1, width)
    pre = np.minimum.accumulate(blocks, 1).ravel()
    suf = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    place = (np.minimum(suf[: n - width + 1], pre[width - 1 : n]) & low).astype(np.int64)
    start = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    return h[place[start]], place[start], start, np.diff(np.append(start, len(place)))


def _names(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of rows of up to three keys, in the keys' order."""
    key = keys[0]
    for more in keys[1:]:
        top = int(more.max()) + 1 if len(more) else 1
        if (int(key.max()) + 1 if len(key) else 1) * top >= 1 << 63:
            key = _rank(key)
        key = key.astype(_U) * _U(top) + more.astype(_U)
    return _rank(key)


def _rank(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    own = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.concatenate(([0], own[1:] != own[:-1])))
    return rank


def repeated_starts(contexts: list[bytes], before: np.ndarray, groups: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For texts that each hold strings of `length` bytes around an anchor: which starts repeat.

    before: bytes from a text's first start to its anchor; groups: number of the anchor. Returns for
    each start of all texts in turn (len(text) - length + 1 each) a class number, equal where the
    strings are equal, and the size of that class. Places are held in 4 bytes each, as a hot anchor brings megabytes.
    """
    size = np.array([len(c) for c in contexts], np.int64)
    # each text gets an end long enough for the block that starts at its last byte
    pad = MODULUS * 2
    data = np.frombuffer(b"".join(c + b"\0" * pad for c in contexts), np.uint8)
    int_ = np.int32 if len(data) < 1 << 31 else np.int64
    begin = (np.cumsum(size + pad) - (size + pad)).astype(int_)
    text = np.repeat(np.arange(len(size), dtype=int_), size + pad)
    size, before, groups = size.astype(int_), before.astype(int_), _rank(groups).astype(int_)
    inner = np.arange(len(data), dtype=int_) - begin[text]
    residue = ((inner - before[text]) % int_(MODULUS)).astype(np.int8)
    cover = np.zeros(MODULUS, bool)
    cover[list(COVER)] = True
    sampled = np.flatnonzero(cover[residue] & (inner < size[text]))
    # 31-byte blocks, eight bytes of a word at a time
    words = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    names = None
    for at in (0, 8, 16, 23):
        word = np.ascontiguousarray(words[sampled + at]).view(">u8").ravel().astype(_U)
        names = _rank(word) if names is None else _names(names, _rank(word))
    del words, word
    slot = np.full(len(data), -1, int_)
    slot[sampled] = np.arange(len(sampled))
    reach = MODULUS
    while reach < length:
        triple = [names + 1]
        for k in (1, 2):
            there = sampled + k * reach
            ok = there < len(data)
            ok[ok] = text[there[ok]] == text[sampled[ok]]
            follow = np.zeros(len(sampled), np.int64)
            follow[ok] = np.where(slot[there[ok]] >= 0, names[slot[there[ok]]] + 1, 0)
            triple.append(follow)
        names = _names(*triple)
        reach *= 3
    del slot
    # remaining suffixes: one step to the left at a time, by byte and the name of the suffix behind it
    rank = np.full(len(data), -1, int_)
    rank[sampled] = names
    wanted = inner <= (size - int_(length))[text]
    gap = np.array([next(k for k in range(MODULUS) if cover[(r + k) % MODULUS]) for r in range(MODULUS)], np.int8)
    far = gap[residue]
    full = inner < size[text]
    offset = len(names) + 1
    for step in range(1, int(gap.max()) + 1):
        todo = np.flatnonzero((far == step) & full)
        if len(todo):
            rank[todo] = _rank(data[todo].astype(_U) * _U(offset) + rank[todo + 1].astype(_U))
    starts = np.flatnonzero(wanted).astype(int_)
    place = inner[starts] - before[text[starts]]
    group = groups[text[starts]]
    del sampled, names, residue, far, full, wanted, inner, text
    # suffixes of one anchor and one distance from it, in suffix order; neighbours are compared
    order = np.lexsort((rank[starts], place, group)).astype(int_)
    del rank
    own, place, group = starts[order], place[order], group[order]
    key = _string_hashes(data, starts, length)[order]
    del starts
    same = (key[1:] == key[:-1]) & (place[1:] == place[:-1]) & (group[1:] == group[:-1])
    del key, place, group
    claimed = np.flatnonzero(same)
    same[claimed] = equal_prefixes(data, own[claimed], own[claimed + 1], length)
    del claimed
    kind = np.cumsum(np.concatenate(([0], ~same))) if len(own) else np.empty(0, np.int64)
    count = np.bincount(kind)[kind] if len(own) else kind
    classes, counts = np.empty(len(own), np.int64), np.empty(len(own), np.int64)
    classes[order], counts[order] = kind, count
    return classes, counts


def equal_prefixes(data: np.ndarray, p: np.ndarray, q: np.ndarray, length: int) -> np.ndarray:
    """Whether data[p : p + length] and data[q : q + length] are the same bytes, for pairs whose hashes agree.

    Places follow one another, and so do their neighbours: behind an equal pair (p - 1, q - 1) only the last byte is new.
    """

    def whole(k: np.ndarray) -> np.ndarray:
        windows, out = np.lib.stride_tricks.sliding_window_view(data, length), np.empty(len(k), bool)
        for at in range(0, len(k), 10_000):
            part = k[at : at + 10_000]
            out[at : at + 10_000] = (windows[p[part]] == windows[q[part]]).all(1)
        return out

    if not len(p):
        return np.empty(0, bool)
    after = np.full(len(data) + 1, -2, np.int64)
    after[p + 1] = q + 1
    goes_on = after[p] == q
    same = data[p + length - 1] == data[q + length - 1]
    heads = np.flatnonzero(~goes_on)
    same[heads] = whole(heads)
    return same if same.all() else whole(np.arange(len(p)))


def _string_hashes(data: np.ndarray, starts: np.ndarray, length: int, step: int = 250_000) -> np.ndarray:
    """A hash of the `length` bytes from each of the ascending starts on, some of them at a time."""
    out, cuts = [np.empty(0, _U)], np.searchsorted(starts, np.arange(0, len(data) + step, step))
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            own = starts[a:b] - starts[a]
            h, power = _prefix_hash(data[starts[a] : starts[b - 1] + length], length)
            out.append(h[own + length] - h[own] * power)
    return np.concatenate(out)


def _prefix_hash(data: np.ndarray, length: int) -> tuple[np.ndarray, np.uint64]:
    """Polynomial hashes of all prefixes modulo 2**64, and the multiplier's power for `length` bytes."""
    mult = 0x9E3779B97F4A7C15
    # h[i+1] = h[i] * m + x: as a sum of x[i] * m**-i, with the inverse of the odd multiplier
    inverse = pow(mult, -1, 1 << 64)
    n = len(data)
    mixed = _MIX[data]
    powers = np.empty(n, _U)
    powers[:1] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        powers[done : done + step] = powers[:step] * _U(pow(inverse, done, 1 << 64))
        done += step
    sums = np.concatenate(([_U(0)], np.cumsum(mixed * powers, dtype=_U)))
    # back to the forward form, so that equal strings at different places have equal hashes
    forward = np.empty(n + 1, _U)
    forward[:1] = 1
    done = 1
    while done < n + 1:
        step = min(done, n + 1 - done)
        forward[done : done + step] = forward[:step] * _U(pow(mult, done, 1 << 64))
        done += step
    return sums * forward * _U(inverse), _U(pow(mult, length, 1 << 64))


_MIX = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)


def _find_anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for row, data in enumerate(batch.column(2)):
                    h, p, s, n = anchors(data.as_py() or b"", length)
                    if len(h):
                        own = batch.slice(row, 1)
                        ids = [own.column(k).take(pa.array(np.zeros(len(h), np.int64))) for k in (0, 1)]
                        yield pa.RecordBatch.from_arrays([*ids, pa.array(h.view(np.int64)), *[pa.array(c.astype(np.int32)) for c in (p, s, n)]], ["key", "doc", "anchor", "at", "start", "n"])

    return run


def _cut_contexts(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, data, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                for r in runs.as_py():
                    rows.append((key, r["anchor"], r["salt"], r["start"], r["at"] - r["start"], data[r["start"] : r["start"] + r["n"] + length - 1]))
                    if len(rows) == 2000:
                        yield _context_batch(rows)
                        rows = []
            if rows:
                yield _context_batch(rows)

    return run


def _context_batch(rows: list) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays(cols, ["key", "anchor", "salt", "start", "before", "context"])


def _sort_groups(length: int, target: int = 1_000_000):
    """Whole groups (anchor, salt) of a partition that is sorted by them, some megabytes at a time."""

    def flush(rows: list) -> list:
        distinct: dict = {}
        for r in rows:
            distinct.setdefault((r[1], r[2], r[4], r[5]), []).append(r)
        keys = list(distinct)
        number = {g: k for k, g in enumerate(dict.fromkeys(k[:2] for k in keys))}
        groups = np.array([number[k[:2]] for k in keys])
        _, counts = repeated_starts([k[3] for k in keys], np.array([k[2] for k in keys]), groups, length)
        out, at = [], 0
        for k in keys:
            n = len(k[3]) - length + 1
            own = distinct[k]
            hit = np.ones(n, bool) if len(own) > 1 else counts[at : at + n] > 1
            at += n
            edge = np.flatnonzero(np.diff(np.concatenate(([0], hit, [0]))))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                out += [(r[0], r[3] + a, r[3] + b - 1 + length) for r in own]
        return out

    def send(out: list) -> Iterator[pa.RecordBatch]:
        if out:
            cols = [pa.array(c, k) for c, k in zip(zip(*out), (pa.binary(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["key", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            held, size, last = [], 0, None
            for batch in batches:
                for r in zip(*(c.to_pylist() for c in batch.columns)):
                    if (r[1], r[2]) != last and size > target:
                        yield from send(flush(held))
                        held, size = [], 0
                    last = (r[1], r[2])
                    held.append(r)
                    size += len(r[5])
            if held:
                yield from send(flush(held))

    return run


def _salted_windows(length: int):
    """The strings of hot groups as (hash, hash, key, start): for the exact count across their parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for key, start, text in zip(batch.column("key").to_pylist(), batch.column("start").to_pylist(), batch.column("context").to_pylist()):
                    n = len(text) - length + 1
                    digest = [hashlib.blake2b(text[k : k + length], digest_size=16).digest() for k in range(n)]
                    cols = [pa.array(digest, pa.binary()), pa.array([key] * n, pa.binary()), pa.array(np.arange(start, start + n))]
                    yield pa.RecordBatch.from_arrays(cols, ["digest", "key", "start"])

    return run


def _apply(length: int, texts: bool):
    """(doc, data, copied, s) to what is left of each row: copies of at least `length` bytes go whole, else the spans s."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.binary()] if texts else [])]
        names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if texts else [])]
        for batch in batches:
            out, size, done = [], 0, 0
            for row, (data, copied, spans) in enumerate(zip(*(batch.column(c) for c in ("data", "copied", "s")))):
                data = data.as_py()
                merged: list[list[int]] = [[0, len(data)]] if copied.as_py() and len(data) >= length else []
                for a, b in sorted((s["a"], s["b"]) for s in spans.as_py() or []):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                ends = [0, *(x for s in merged for x in s), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2])) if merged else data
                one = (len(data), sum(b - a for a, b in merged), len(merged), hashlib.sha256(kept).hexdigest())
                out.append((*one, kept) if texts else one)
                size += len(kept)
                if size > 8_000_000 or row == batch.num_rows - 1:
                    cols = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
                    yield pa.RecordBatch.from_arrays([batch.column("doc").slice(done, len(out)), *cols], ["doc_id", *names])
                    out, size, done = [], 0, row + 1

    return run


def _rows(docs: DataFrame) -> DataFrame:
    raw = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    return docs.select(text_key(raw).alias("key"), F.col("doc_id").alias("doc"), raw.alias("data"))


def _with_text(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of `known` (key, doc, ...) with the text's bytes.

    Joined by key alone, with the document compared afterwards: then all such joins of one query read
    one and the same exchange of the texts.
    """
    known = known.withColumnsRenamed({"key": "k", "doc": "d"})
    return rows.join(known, F.col("key") == F.col("k")).where(F.nullif(F.col("doc"), F.col("d")).isNull())


def repeated_spans(docs: DataFrame, length: int = 400, hot: int = 8192) -> tuple[DataFrame, DataFrame]:
    """Two tables over distinct texts: (key, doc, n) of all of them, with the smallest doc_id that
    carries the text and how many rows do, and the byte spans (key, a, b) that repeat elsewhere.

    hot: an anchor that occurs more often than this is split into parts of about that many texts, which
    are sorted apart; the strings of such anchors are also counted across the parts by their digests.
    """
    rows = _rows(docs)
    texts = table_cut(rows.groupBy("key").agg(F.min("doc").alias("doc"), F.count(F.lit(1)).alias("n")))
    kind = dict(docs.dtypes)["doc_id"]
    runs = table_cut(rows.mapInArrow(_find_anchors(length), f"key binary, doc {kind}, anchor long, at int, start int, n int"))
    # copies of a text repeat its anchors: one carrier of each text goes on, and anchors are counted again
    # counts are written before they are joined, so that Spark may split a hot anchor's rows in the join
    shared = table_cut(runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("anchor"))
    carrier = texts.select(F.col("key").alias("k"), F.col("doc").alias("d"))
    runs = runs.join(shared, "anchor").join(carrier, (F.col("key") == F.col("k")) & F.col("doc").eqNullSafe(F.col("d")), "left_semi")
    runs = table_cut(runs)
    counts = table_cut(runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("times")).where("times > 1"))
    salt = F.pmod(F.xxhash64("key", "start"), F.ceil(F.col("times") / hot)).alias("salt")
    again = runs.join(counts, "anchor").withColumn("salt", F.when(F.col("times") > hot, salt).otherwise(F.lit(0)))

    def contexts(some: DataFrame) -> DataFrame:
        some = some.groupBy("key", "doc").agg(F.collect_set(F.struct("anchor", "salt", "at", "start", "n")).alias("runs"))
        kind = "key binary, anchor long, salt long, start long, before long, context binary"
        return _with_text(rows, some).select("key", "data", "runs").mapInArrow(_cut_contexts(length), kind)

    dealt = contexts(again).repartition(partitions_of(docs) * 2, "anchor", "salt").sortWithinPartitions("anchor", "salt")
    spans = dealt.mapInArrow(_sort_groups(length), "key binary, a long, b long")
    if counts.where(F.col("times") > hot).limit(1).count():
        windows = contexts(again.where(F.col("times") > hot)).select("key", "start", "context")
        # not written down: within one query this reads the exchange of the texts that the first join made
        windows = windows.mapInArrow(_salted_windows(length), "digest binary, key binary, start long").distinct()
        known = windows.groupBy("digest").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("digest")
        more = windows.join(known, "digest").select("key", F.col("start").alias("a"), (F.col("start") + length).alias("b"))
        spans = spans.unionByName(more)
    return texts, spans


def remove_repeats(docs: DataFrame, length: int = 400, hot: int = 8192, texts: bool = False) -> DataFrame:
    """Remove every byte that a `length`-byte string covers which also starts anywhere else.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 per row, and with texts=True the remaining
    bytes as `kept`. Strings are judged on the input; matches never cross documents.

    Defined cases: null text is empty; texts under `length` bytes stay whole; a text that two rows carry
    goes whole if it is long enough; repeated rows are such copies; an empty table gives no rows; other
    columns are ignored.
    """
    carried, spans = repeated_spans(docs, length, hot)
    single = spans.groupBy("key").agg(F.collect_set(F.struct("a", "b")).alias("s"))
    # one row per text: texts of several rows go by their copies, the others by their spans
    fate = carried.select(F.col("key").alias("k"), (F.col("n") > 1).alias("copied"))
    single = single.withColumnRenamed("key", "u")
    fate = fate.join(single, (F.col("k") == F.col("u")) & ~F.col("copied"), "left").select("k", "copied", "s")
    # joined by key alone, so that the texts' exchange is the one that the search for spans made
    met = _rows(docs).join(fate, F.col("key") == F.col("k")).select("doc", "data", "copied", "s")
    kind = f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return met.mapInArrow(_apply(length, texts), kind + (", kept binary" if texts else ""))
