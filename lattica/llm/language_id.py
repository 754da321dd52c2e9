"""Language ID by interpolated Kneser-Ney character models held in sorted hash arrays."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import slices

ORDER = 4
_EDGE = ord("\n")
_MULT = np.uint64(0x9E3779B97F4A7C15)
#: which of the 65,536 first code points are letters; all above count as letters where Python says so
_LETTER = np.array([chr(c).isalpha() for c in range(1 << 16)])


def _letters(codes: np.ndarray) -> np.ndarray:
    out = _LETTER[np.minimum(codes, 0xFFFF)]
    for k in np.flatnonzero(codes > 0xFFFF):
        out[k] = chr(codes[k]).isalpha()
    return out


def _flat(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as one code array, each with ORDER - 1 edge marks before and one behind it, without what is
    no letter; for each position its word; how many letters each word has."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    word = np.repeat(np.arange(len(words)), [len(w) for w in words])
    keep = _letters(codes)
    codes, word = codes[keep], word[keep]
    letters = np.bincount(word, minlength=len(words))
    size = np.where(letters > 0, letters + ORDER, 0)
    start = np.cumsum(size) - size
    flat = np.full(int(size.sum()), _EDGE, np.uint64)
    flat[np.arange(len(codes)) - (np.cumsum(letters) - letters)[word] + start[word] + ORDER - 1] = codes
    return flat, np.repeat(np.arange(len(words)), size), letters


def _grams(flat: np.ndarray) -> list[np.ndarray]:
    """For k = 1..ORDER the hash of the k codes that end at each position."""
    with np.errstate(over="ignore"):
        out = [(flat + np.uint64(1)) * _MULT]
        for _ in range(1, ORDER):
            before = np.concatenate(([np.uint64(0)], out[-1][:-1]))
            h = before * np.uint64(0xD6E8FEB86659FD93) + (flat + np.uint64(1)) * _MULT
            out.append(h ^ (h >> np.uint64(29)))
    return out


@dataclass
class Model:
    """For k = 1..ORDER: sorted hashes of k-grams, their discounted share per language (`own`), and the
    weight that each leaves to the next lower order when it is a context (`rest`)."""

    langs: list[str]
    keys: list[np.ndarray]
    own: list[np.ndarray]
    rest: list[np.ndarray]
    floor: float
    limit: np.ndarray

    def word_scores(self, words: list[str], at_once: int = 8192) -> tuple[np.ndarray, np.ndarray]:
        """Sum of log2 probabilities of each word under each language, and how many symbols it has; some words at a time."""
        parts = [self._some_scores(words[k : k + at_once]) for k in range(0, max(1, len(words)), at_once)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _some_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.langs)
        flat, word, letters = _flat(words)
        inner = np.arange(len(flat))
        at = inner[flat_positions(letters)]
        p = np.full((len(at), n), self.floor, np.float32)
        rest = np.ones((len(flat), n), np.float32)
        rest[:] = self.rest[0]
        for k, gram in enumerate(_grams(flat)):
            p *= rest[at - 1]
            slot = np.minimum(np.searchsorted(self.keys[k], gram), len(self.keys[k]) - 1)
            hit = self.keys[k][slot] == gram
            seen = hit[at]
            p[seen] += self.own[k][slot[at[seen]]]
            if k + 1 < ORDER:
                rest = np.where(hit[:, None], self.rest[k + 1][slot], np.float32(1))
        scores = np.zeros((len(words), n))
        np.add.at(scores, word[at], np.log2(np.maximum(p, 1e-12)))
        return scores, np.where(letters > 0, letters + 1, 0)


def flat_positions(letters: np.ndarray) -> np.ndarray:
    """Positions in _flat()'s array that are predicted: the letters and the closing mark of each word."""
    size = np.where(letters > 0, letters + ORDER, 0)
    mask = np.ones(int(size.sum()), bool)
    start = (np.cumsum(size) - size)[letters > 0]
    for k in range(ORDER - 1):
        mask[start + k] = False
    return np.flatnonzero(mask)


def estimate(grams: pd.DataFrame, langs: list[str], discount: float = 0.75) -> tuple:
    """Kneser-Ney tables from counts (lang number, k = 1..ORDER, gram hash, context hash, suffix hash, n).

    n of the highest order are counts, those of lower orders count the different symbols before them.
    """
    keys, own, rest = [], [], [np.zeros(len(langs), np.float32)]
    alphabet = max(2, grams.loc[grams.k == 1, "gram"].nunique())
    for k in range(1, ORDER + 1):
        part = grams[grams.k == k]
        by = part.groupby(["lang", "context"]).n.agg(["sum", "count"])
        total = by.loc[pd.MultiIndex.from_frame(part[["lang", "context"]])]["sum"].to_numpy()
        # what stands before the first letter is never predicted, so it is no gram of its own, but a context of the next order
        key = np.unique(np.concatenate([part.gram.to_numpy(), grams.loc[grams.k == k + 1, "context"].to_numpy()]))
        share = np.zeros((len(key), len(langs)), np.float32)
        share[np.searchsorted(key, part.gram.to_numpy()), part.lang] = np.maximum(part.n.to_numpy() - discount, 0) / total
        keys.append(key)
        own.append(share)
        left = (discount * by["count"] / by["sum"]).reset_index()
        if k == 1:
            rest[0][left.lang] = left[0]
        else:
            weight = np.ones((len(keys[k - 2]), len(langs)), np.float32)
            slot = np.searchsorted(keys[k - 2], left.context.to_numpy())
            ok = keys[k - 2][np.minimum(slot, len(keys[k - 2]) - 1)] == left.context.to_numpy()
            weight[slot[ok], left.lang[ok]] = left[0][ok]
            rest.append(weight)
    return keys, own, rest, 1.0 / alphabet


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, k, gram, context, suffix, n), summed within each batch."""
    for batch in batches:
        frame = batch.to_pandas()
        for lang, texts in frame.groupby("lang").text:
            words = pd.Series([w for t in texts for w in t.lower().split()], dtype=object).value_counts()
            if not len(words):
                continue
            flat, word, letters = _flat(list(words.index))
            grams, at = _grams(flat), flat_positions(letters)
            n = words.to_numpy()[word[at]]
            top = pd.DataFrame({"gram": grams[-1][at], "context": grams[-2][at - 1], "suffix": grams[-2][at], "lower": grams[-3][at - 1], "n": n})
            top = top.groupby(["gram", "context", "suffix", "lower"], as_index=False).n.sum()
            # lower orders follow from types of the next higher one, so all orders' types are sent
            yield from _typed(lang, ORDER, top)
            for k in range(ORDER - 1, 0, -1):
                context = grams[k - 2][at - 1] if k > 1 else np.zeros(len(at), np.uint64)
                types = pd.DataFrame({"gram": grams[k - 1][at], "context": context, "suffix": grams[k][at], "n": 1}).drop_duplicates()
                yield from _typed(lang, k, types)


def _typed(lang, k: int, frame: pd.DataFrame) -> Iterator[pa.RecordBatch]:
    cols = [pa.array([lang] * len(frame), pa.string()), pa.array(np.full(len(frame), k, np.int32))]
    cols += [pa.array(frame[c].to_numpy().view(np.int64)) for c in ("gram", "context", "suffix")] + [pa.array(frame.n.to_numpy().astype(np.int64))]
    yield pa.RecordBatch.from_arrays(cols, ["lang", "k", "gram", "context", "suffix", "n"])


def train(docs: DataFrame, max_docs: int = 1500, strict: float = 0.5) -> Model | None:
    """Fit one model per language on about `max_docs` documents of each (chosen by a hash of doc_id and
    text; the bound of the sample), counting n-grams by a Spark aggregation.

    Every fifth different text of the sample is held back from the counts to calibrate rejection: the limit of each
    language lies between the largest cross-entropy of those that the model assigns rightly (strict=1) and
    that of a uniform choice from the alphabet (strict=0). A language none of whose texts is held back takes the texts
    that were counted. Returns None without training rows.
    """
    named = docs.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    counts = {r[0]: r[1] for r in named.groupBy("lang").count().collect()}
    if not counts:
        return None
    langs = sorted(counts)
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, max_docs / counts[k]))])
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    sample = named.where(draw < share[F.col("lang")]).select("lang", "text")
    back = F.pmod(F.xxhash64("text", F.lit("calibration")), F.lit(5)) == 0
    kept = sample.where(~back).groupBy("lang").count().collect()
    if len(kept) < len(langs):  # too few texts to hold any back
        back = F.lit(False)
    schema = "lang string, k int, gram long, context long, suffix long, n long"
    seen = sample.where(~back).mapInArrow(_count_batches, schema)
    top = seen.where(f"k = {ORDER}").groupBy("lang", "k", "gram", "context").agg(F.sum("n").alias("n"))
    low = seen.where(f"k < {ORDER}").select("lang", "k", "gram", "context", "suffix").distinct()
    low = low.groupBy("lang", "k", "gram", "context").agg(F.count(F.lit(1)).alias("n"))
    grams = top.unionByName(low).toPandas()  # bounded by the sample
    if grams.empty:
        return None
    grams["lang"] = grams["lang"].map({x: i for i, x in enumerate(langs)})
    for c in ("gram", "context"):
        grams[c] = grams[c].to_numpy().view(np.uint64)
    model = Model(langs, *estimate(grams, langs), np.full(len(langs), np.inf))
    own = sample.select("text", F.col("lang").alias("doc_id"))
    own = own.withColumn("doc_id", F.concat(F.when(back, "+").otherwise("-"), "doc_id"))
    met = predict(own, model).where("lang_pred = substring(doc_id, 2)")
    worst = met.groupBy("lang_pred").agg(F.max(F.when(F.startswith("doc_id", F.lit("+")), F.col("entropy"))), F.max("entropy")).collect()
    uniform = -np.log2(model.floor)
    for lang, most, counted in worst:
        most = counted if most is None else most
        model.limit[langs.index(lang)] = max(most, strict * most + (1 - strict) * uniform)
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, entropy, rejected for every row of docs, from its whole text only.

    Words (letters between white space, lower case) are scored once per batch; a text's cross-entropy
    is the mean over its symbols, the language is the one with the lowest, score is the posterior of
    that language with the evidence of at most 40 symbols. rejected: und, or entropy above the limit
    that training found for the language.

    Defined cases: null text, or one without a letter, is und with score 0 and rejected; ties go to the
    smaller language; repeated rows are scored one by one; without training rows every text is und.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for big in batches:
            for part in slices(big, 1):
                yield _predict_batch(part, model)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, entropy double, rejected boolean")


def _predict_batch(batch: pa.RecordBatch, model: Model | None) -> pa.RecordBatch:
    size = batch.num_rows
    pred = np.full(size, "und", object)
    score, entropy = np.zeros(size), np.full(size, np.nan)
    rejected = np.ones(size, bool)
    # numbers of words in order of their first place; of the words themselves only different ones are held
    number: defaultdict[str, int] = defaultdict()
    number.default_factory = number.__len__
    code, times = [], np.zeros(size, np.int64)
    if model:
        for row, text in enumerate(batch.column(1)):
            own = (text.as_py() or "").lower().split()
            times[row] = len(own)
            code.append(np.fromiter(map(number.__getitem__, own), np.int32, len(own)))
    if number:
        code, doc = np.concatenate(code), np.repeat(np.arange(size, dtype=np.int32), times)
        per_word, symbols = model.word_scores(list(number))
        length = np.bincount(doc, symbols[code], size)
        total = np.stack([np.bincount(doc, per_word[code, k], size) for k in range(len(model.langs))], 1)
        ok = length > 0
        mean = -total[ok] / length[ok, None]
        best = mean.argmin(1)
        pred[ok] = np.array(model.langs, object)[best]
        entropy[ok] = mean.min(1)
        weight = np.exp2(-(mean - mean.min(1)[:, None]) * np.minimum(length[ok], 40)[:, None])
        score[ok] = 1 / weight.sum(1)
        rejected[ok] = entropy[ok] > model.limit[best]
    cols = [batch.column(0), pa.array(pred, pa.string()), pa.array(score), pa.array(entropy), pa.array(rejected)]
    return pa.RecordBatch.from_arrays(cols, ["doc_id", "lang_pred", "score", "entropy", "rejected"])


def identify_languages(docs: DataFrame, max_docs: int = 1500) -> DataFrame:
    """Train on the rows of docs that are not held out and predict all rows.

    Returns doc_id, held_out, lang_pred, score, entropy, rejected. Held out are the documents whose
    crc32 of doc_id as text leaves 2 modulo 4 (null doc_id: not held out).
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = train(docs.where(~held), max_docs)
    return predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "entropy", "rejected")


def keep_identified(docs: DataFrame, max_docs: int = 1500) -> DataFrame:
    """The rows of docs whose text the models do not reject, with docs' own columns and no shuffle.

    Rows are scored in place: Arrow batches carry all columns through, and only rows go. Defined cases: texts that are
    null or have no letter go; repeated rows stay or go together; without training rows, and so from an
    empty table, nothing stays; columns of any names come through as they are.
    """
    held = F.coalesce(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = train(docs.where(~held), max_docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at_id, at_text = docs.columns.index("doc_id"), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for part in slices(big, at_text):
                two = pa.RecordBatch.from_arrays([part.column(at_id), part.column(at_text)], ["doc_id", "text"])
                rejected = _predict_batch(two, sent.value).column(4)
                yield part.filter(pa.array(~np.asarray(rejected.to_pylist(), bool)))

    return docs.mapInArrow(run, docs.schema)
