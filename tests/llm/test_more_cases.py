"""Language models against plain Kneser-Ney, and cases that other tests leave out."""

import itertools
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

import corpus_pipeline
from lattica.llm import language_id, suffix_dedup, url_filter

EDGE, DISCOUNT = "\n", 0.75


def plain_model(texts):
    """P(symbol | context) of interpolated Kneser-Ney with dictionaries: counts at the top, different predecessors below."""
    n = language_id.ORDER
    top, types = defaultdict(int), [set() for _ in range(n + 1)]
    for text in texts:
        for word in text.lower().split():
            letters = [c for c in word if c.isalpha()]
            if not letters:
                continue
            full = [EDGE] * (n - 1) + letters + [EDGE]
            for at in range(n - 1, len(full)):
                top[tuple(full[at - n + 1 : at + 1])] += 1
                for k in range(1, n):
                    types[k].add(tuple(full[at - k : at + 1]))
    counts = {n: top}
    for k in range(1, n):
        counts[k] = defaultdict(int)
        for longer in types[k]:
            counts[k][longer[1:]] += 1
    total, kinds = [defaultdict(lambda: defaultdict(int)) for _ in range(2)]
    for k, own in counts.items():
        for gram, c in own.items():
            total[k][gram[:-1]] += c
            kinds[k][gram[:-1]] += 1

    def p(symbol, context, alphabet):
        out = 1.0 / alphabet
        for k in range(1, n + 1):
            before = tuple(context[len(context) - k + 1 :]) if k > 1 else ()
            if total[k][before]:
                out = max(counts[k][(*before, symbol)] - DISCOUNT, 0) / total[k][before] + DISCOUNT * kinds[k][before] / total[k][before] * out
        return out

    return p, {g[0] for g in counts[1]}


def fitted(by_lang):
    """The operator's model of {language: texts}, from its own counts."""
    rows = [(lang, t) for lang, texts in by_lang.items() for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], ["lang", "text"])
    seen = pa.Table.from_batches(list(language_id._count_batches([batch]))).to_pandas()
    top = seen[seen.k == language_id.ORDER].groupby(["lang", "k", "gram", "context"], as_index=False).n.sum()
    low = seen[seen.k < language_id.ORDER].drop_duplicates(["lang", "k", "gram", "context", "suffix"]).groupby(["lang", "k", "gram", "context"], as_index=False).agg(n=("suffix", "size"))
    grams, langs = pd.concat([top, low]), sorted(by_lang)
    grams["lang"] = grams["lang"].map({x: i for i, x in enumerate(langs)})
    for c in ("gram", "context"):
        grams[c] = grams[c].to_numpy().view(np.uint64)
    return language_id.Model(langs, *language_id.estimate(grams, langs), np.full(len(langs), np.inf)), grams.loc[grams.k == 1, "gram"].nunique()


@pytest.mark.parametrize("seed", [1, 2])
def test_word_scores_equal_plain_kneser_ney(seed):
    rng = random.Random(seed)
    say = lambda letters: " ".join("".join(rng.choices(letters, k=rng.randrange(1, 7))) for _ in range(60))
    by_lang = {"x": [say("aabc"), say("abd")], "y": [say("éefg"), say("abe'1")]}
    model, alphabet = fitted(by_lang)
    plain = {lang: plain_model(texts) for lang, texts in by_lang.items()}
    words = ["a", "abc", "bad", "éé", "fge", "zz", "a-b", "cab", "gab", "aaaaaaaa", *say("abcdefgé").split()]
    scores, symbols = model.word_scores(words)
    for i, word in enumerate(words):
        letters = [c for c in word if c.isalpha()]
        full = [EDGE] * (language_id.ORDER - 1) + letters + [EDGE]
        assert symbols[i] == len(letters) + 1
        for j, lang in enumerate(model.langs):
            want = sum(np.log2(plain[lang][0](full[at], full[at - language_id.ORDER + 1 : at], alphabet)) for at in range(language_id.ORDER - 1, len(full)))
            assert abs(scores[i, j] - want) < 1e-3 * len(full), (word, lang)


def test_plain_kneser_ney_sums_to_one():
    p, symbols = plain_model(["abab abc bca", "cab aab"])
    for context in (["\n"] * 3, list("\n\na"), list("aab"), list("zzz"), list("abc")):
        assert abs(sum(p(s, context, len(symbols)) for s in symbols) - 1) < 1e-12


def test_urls_of_repeated_rows(spark):
    rows = [(1, "http://a.com/en/x")] * 3 + [(1, None)] * 2 + [(None, "http://c.org/es/")] * 2
    got = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert sorted((r["page_id"] or 0, r["verdict"], r["rule"] or "") for r in got) == [(0, "block", "org/es/")] * 2 + [(1, "allow", "")] * 2 + [(1, "block", "com/en/")] * 3


def test_pipeline_of_an_empty_table(spark, odd_documents):
    docs = odd_documents.where("false")
    for name, stage in corpus_pipeline.STAGES:
        columns, docs = docs.columns, stage(spark, docs, "")
        assert docs.count() == 0 and (docs.columns == columns or name == "packing")


def _peak(run) -> int:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_hot_anchor_takes_a_small_multiple_of_its_bytes():
    """A flush of two megabytes took 126 bytes for each of them, and each worker of an executor holds one."""
    rng = np.random.default_rng(1)
    base = rng.integers(97, 123, 768).astype(np.uint8)
    contexts = []
    for k in range(2600):
        own = base.copy()
        own[rng.integers(0, 768, 3)] = 65 + k % 26
        contexts.append(own.tobytes())
    before, groups = np.full(len(contexts), 368), np.repeat([7, 3], len(contexts) // 2)
    found = {}

    def run():
        with np.errstate(over="ignore"):
            found["classes"], found["counts"] = suffix_dedup.repeated_starts(contexts, before, groups, 400)

    assert _peak(run) < 60 * 768 * len(contexts)
    n = 768 - 400 + 1
    times = Counter((int(groups[t]), k, c[k : k + 400]) for t, c in enumerate(contexts) for k in range(n))
    assert found["counts"].tolist() == [times[int(groups[t]), k, c[k : k + 400]] for t, c in enumerate(contexts) for k in range(n)]


def test_language_id_holds_different_words_only():
    words = ["".join(w) for w in itertools.product("abcdefghij", repeat=4)]
    rng = np.random.default_rng(2)
    texts = [" ".join(words[k] for k in rng.integers(0, len(words), 400)) for _ in range(2000)]
    flat, word, letters = language_id._flat(words)
    grams = language_id._grams(flat)
    keys = [np.unique(g) for g in grams]
    share = [np.full((len(k), 2), 0.1, np.float32) for k in keys]
    rest = [np.full(2, 0.5, np.float32), *[np.full((len(k), 2), 0.5, np.float32) for k in keys[:-1]]]
    model = language_id.Model(["a", "b"], keys, share, rest, 0.01, np.full(2, np.inf))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    assert _peak(lambda: language_id._predict_batch(batch, model)) < 40_000_000
    whole, few = model.word_scores(words, 10**9), model.word_scores(words, 1000)
    assert all((a == b).all() for a, b in zip(whole, few))
