"""Word shingles of a batch of texts as numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

_MULT = np.uint64(0x9E3779B97F4A7C15)


def slices(batch: pa.RecordBatch, column: int, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices with some `limit` bytes of the given text column, or a single row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // limit
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges[:-1], edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (between white space) of all texts in turn, and how many each text has."""
    words: list[str] = []
    counts = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        own = text.split() if text else []
        counts[k] = len(own)
        words += own
    if not words:
        return np.empty(0, np.uint64), counts
    code, unique = pd.factorize(np.array(words, object))
    return pd.util.hash_array(unique, categorize=False)[code], counts


def rolling(hashes: np.ndarray, counts: np.ndarray, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each run of k words: (hash, text number, position of its first word in the text).

    short: a text of fewer words, but at least one, has one shingle of all its words.
    """
    with np.errstate(over="ignore"):
        n = len(hashes)
        text = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
        full = np.zeros(n, np.uint64)
        for j in range(k):
            part = np.zeros(n, np.uint64)
            part[: max(0, n - j)] = hashes[j:]
            full = full * _MULT + part
        ok = place + k <= counts[text]
        out_h, out_t, out_p = [mix64(full[ok])], [text[ok]], [place[ok]]
        few = np.flatnonzero((counts > 0) & (counts < k)) if short else []
        start = np.cumsum(counts) - counts
        for t in few:
            h = np.uint64(counts[t])
            for w in hashes[start[t] : start[t] + counts[t]]:
                h = h * _MULT + w
            out_h.append(mix64(np.array([h]))), out_t.append(np.array([t])), out_p.append(np.array([0]))
        return np.concatenate(out_h), np.concatenate(out_t), np.concatenate(out_p)


def bags(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The multiset of k-word shingles of each text: (text number, shingle, times), sorted."""
    shingle, text, _ = rolling(*word_hashes(texts), k)
    order = np.lexsort((shingle, text))
    shingle, text = shingle[order], text[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])
    first = np.flatnonzero(new)
    return text[first], shingle[first], np.diff(np.append(first, len(text)))
