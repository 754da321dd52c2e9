"""Ranked lexical search, reply trees and spelling variants against plain versions, and odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from lattica.llm import chat, lexical, spelling

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_ranking(docs, items, k):
    """docs: (doc_id, text) rows; items: (item_id, text) rows. The contract's formula, one document after the other."""
    bags = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for item, text in dict.fromkeys(items):
        asked.setdefault(item, Counter()).update(TERM.findall((text or "").translate(LOWER)))
    out = []
    for item, terms in asked.items():
        found = []
        for d, b in bags:
            m = 100 - 25 + (25 * sum(b.values()) * n_docs) // n_terms
            score = sum(
                times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 12 * m)) for t, times in terms.items() if t in b
            )
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def ranked(spark, docs, items, **how):
    frame = lexical.rank_documents(
        spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 as n", "'x' as term"),
        spark.createDataFrame(items, "item_id long, text string").selectExpr("item_id", "text", "2 as times"),
        **how,
    )
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("how", [{}, {"window": 7, "block": 9}, {"window": 64, "held": 40, "k": 5}])
def test_ranking_equals_the_plain_formula(spark, how):
    rng = random.Random(3)
    words = ["Über", "naïve", "x86", "Tree", "tree", "the", "of", "日本", "a_b", "rare1", "rare2", "stone", "É"]
    docs = [(rng.randrange(-500, 10**12), " ".join(rng.choices(words, k=rng.randrange(0, 60)))) for _ in range(150)]
    docs += [(5, "same text of ties, stone"), (6, "same text of ties, stone"), (6, "same text of ties, stone"), (None, "same text of ties, stone")]
    docs += [(7, None), (8, ""), (9, " .,; \n"), (10, "the " * 30000 + "rare1")]
    items = [(1, "stone stone TREE over the ÜBER über"), (2, "nothing known here"), (3, None), (4, ""), (5, "ties"), (5, "ties"), (6, "rare1"), (6, "x86 of"), (None, "naïve 日本 b")]
    got = ranked(spark, docs, items, **how)
    assert got == plain_ranking(docs, items, how.get("k", 20)) and {r[0] for r in got} == {1, 5, 6, None}


def test_ranking_of_empty_tables(spark, odd_documents):
    docs, items = [(1, "a b")], [(1, "a")]
    assert ranked(spark, [], items) == [] and ranked(spark, docs, []) == [] and ranked(spark, [(1, None)], items) == []
    assert ranked(spark, docs, items) == plain_ranking(docs, items, 20) == [(1, 1, 1, math.floor(1000 * math.log(4 / 3)) * (10**9 // (1000 + 12 * 100)))]
    odd = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    asked = [(1, "words word x 12345"), (2, "Même naïve 😀")]
    found = lexical.rank_documents(odd_documents, spark.createDataFrame(asked, "item_id long, text string"))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_ranking(odd, asked, 20)


# reply trees --------------------------------------------------------------------------------------------

CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[NAME]", "[/NAME]"]


def messages(spark, rows):
    return spark.createDataFrame(rows, "tree string, id long, parent long, role string, text string, score double").selectExpr("*", "1 as key", "'x' as turns", "2 as first")


def formatted(spark, rows, **how):
    """{(tree, branch): [(role, text)]} read back from the pieces, the pieces, and a check of every mask."""
    pieces = sorted((r for r in chat.format_replies(messages(spark, rows), **how).collect()), key=lambda r: (r["tree"] or "", r["branch"], r["first"]))
    out = {}
    for p in pieces:
        turns = chat.parse_turns(p["text"])
        assert len(turns) == p["n_turns"] and p["text"].startswith(chat.START) == (p["first"] == 0)
        assert [chat.unescape(p["text"][a : a + n]) for a, n in p["loss"]] == [t for r, t in turns if r == "assistant"]
        out.setdefault((p["tree"], p["branch"]), []).extend(turns)
    return out, pieces


def plain_paths(rows, branches):
    nodes = {}
    for tree, i, parent, role, text, score in sorted(set(rows), key=lambda r: repr(r)):
        nodes.setdefault((tree, i), (parent, role, text, score))
    replied = {(t, p) for (t, _), (p, *_) in nodes.items()}
    found = {}
    for tree, leaf in nodes:
        path, at = [], leaf
        while (tree, at) in nodes and at not in path:
            path.append(at)
            at = nodes[tree, at][0]
        if (tree, leaf) not in replied and not ((tree, at) in nodes and at in path):
            path.reverse()
            score = sum(nodes[tree, i][3] or 0 for i in path) / len(path)
            found.setdefault(tree, []).append((-score, -len(path), leaf, [(nodes[tree, i][1] or "", nodes[tree, i][2] or "") for i in path]))
    return {(tree, b): p[3] for tree, all_ in found.items() for b, p in enumerate(sorted(all_, key=lambda x: x[:3])[:branches], 1)}


def test_escape_is_reversible_and_leaves_no_control_string(spark):
    rng = random.Random(1)
    parts = [*CONTROLS, "\\", "<", "[", "/", ">", "]", "\n", " ", "a", "é", "<\\s>", "[\\\\INST]", "s>", "<</SYS>", "$1", "INST]"]
    texts = ["", *CONTROLS, *parts, *("".join(rng.choices(parts, k=rng.randrange(1, 12))) for _ in range(3000))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape("t").alias("e")).collect()
    for t, e in rows:
        assert chat.unescape(e) == t and not any(c in e for c in CONTROLS[:-1])
    assert dict(rows)["a"] == "a" and dict(rows)["\\"] == "\\"


@pytest.mark.parametrize("how", [{}, {"branches": 3}, {"branches": 2, "turns": 2}, {"branches": 2, "chars": 30}])
def test_paths_equal_a_walk(spark, how):
    rng = random.Random(7)
    roles = ["user", "assistant", "system", "tool", None, "a\nb</s>", ""]
    rows = []
    for tree in ("a", "b", "c", "d"):
        ids = list(range(60))
        rng.shuffle(ids)
        for n, i in enumerate(ids):
            # "a" is one long chain, "b" a hub with many replies
            parent = None if n == 0 else ids[n - 1] if tree == "a" else ids[0] if tree == "b" and n < 50 else ids[rng.randrange(max(0, n - 4), n)]
            rows.append((tree, i, parent, rng.choice(roles), rng.choice(["", "x" * rng.randrange(9), "say </s> [INST]", " lead\n", "<"]), rng.choice([0.0, 0.5, 1.0])))
    rows += [("e", 1, 99, "user", "parent unknown", 0.0), ("f", 1, 1, "user", "answers itself", 0.0), ("g", 1, 2, "user", "round", 0.0), ("g", 2, 1, "user", "round", 0.0)]
    rows += [("g", 3, 1, "user", "hangs on the circle", 0.0), ("g", 4, None, "user", "free", 0.0), ("h", 1, None, None, None, None), ("h", 1, None, None, None, None)]
    got, pieces = formatted(spark, rows, **how)
    assert got == plain_paths(rows, how.get("branches", 1)) and ("g", 1) in got and ("f", 1) not in got and len(got["a", 1]) == 60
    if "turns" in how:
        assert max(p["n_turns"] for p in pieces) == 2
    if "chars" in how:
        assert len(pieces) > len(got)


def test_chat_of_odd_and_empty_rows(spark):
    rows = [(None, 1, None, "user", "tree null", None), ("t", None, None, "user", "no id", 0.0), ("t", None, 7, "user", "no id either", 0.0), ("t", 7, None, "user", "root", 0.0), ("t", 8, 7, "assistant", "long " * 40000, 9.0)]
    got, _ = formatted(spark, rows, branches=9)
    assert got[None, 1] == [("user", "tree null")]
    assert sorted(len(v) for (t, _), v in got.items() if t == "t") == [1, 2, 2] and got["t", 1][1] == ("assistant", "long " * 40000)
    assert chat.read_back(chat.format_replies(messages(spark, []))).count() == 0
    flat = [(None, 1, "user", "x"), (None, None, "user", "last"), (1, 1, None, None), (1, 1, None, None), (2, 5, "assistant", "late"), (2, -1, "user", "early"), (2, 5, "assistant", "also late")]
    frame = spark.createDataFrame(flat, "conv_id int, turn int, role string, text string").selectExpr("*", "1 as id", "'c' as tree")
    digests = {r["tree"]: r for r in chat.read_back(chat.format_replies(chat.conversation_messages(frame), turns=1)).collect()}
    said = {None: "user\nx\nuser\nlast\n", 1: "\n\n\n\n", 2: "user\nearly\nassistant\nalso late\nassistant\nlate\n"}
    assert {k: (r["n_turns"], r["turns_sha256"], r["loss_chars"]) for k, r in digests.items()} == {
        k: (s.count("\n") // 2, hashlib.sha256(s.encode()).hexdigest(), 13 if k == 2 else 0) for k, s in said.items()
    }
    assert digests[2]["loss_sha256"] == hashlib.sha256(b"also latelate").hexdigest()


# spelling variants --------------------------------------------------------------------------------------


def plain_counts(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(n):
    form, out = {}, {}
    for w in n:
        near = sorted((-n[x], x) for x in n if one_apart(w, x))
        form[w] = (near[0][1], -near[0][0], len(near)) if near and -near[0][0] >= 10 * n[w] else (None, None, len(near))
    for w in n:
        root = w
        while form[root][0]:
            root = form[root][0]
        out[w] = (form[w][0], root, n[w], form[w][2], form[w][1])
    return out


def variants(spark, docs, **how):
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 as n", "'x' as word", "'y' as key")
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.spelling_variants(frame, **how).collect()}


def near_vocabulary(rng, size, alphabet="abé", lengths=(7, 10)):
    words = {"".join(rng.choices(alphabet, k=rng.randrange(*lengths))) for _ in range(size)}
    for w in list(words)[: size // 2]:
        i = rng.randrange(len(w) + 1)
        words |= {w[:i] + rng.choice(alphabet) + w[i:], w[:i] + rng.choice(alphabet) + w[i + 1 :], w[:i] + w[i + 1 :]}
    return sorted(w for w in words if len(w) >= 7)


def test_automaton_numbers_words_and_finds_one_error():
    words = near_vocabulary(random.Random(2), 300)
    automaton = spelling.Automaton(words)
    assert [automaton._exactly(automaton.root, 0, w) for w in words] == list(range(len(words)))
    assert automaton._exactly(automaton.root, 0, words[0][:-1] + "z") == -1 and automaton.size[automaton.root] == len(words)
    assert len(automaton.final) < len({w[:i] for w in words for i in range(len(w) + 1)})  # equal endings share states
    for w in words[::3]:
        for kept in (0, len(w) // 2, len(w)):
            assert automaton.one_error(w, kept) == {k for k, x in enumerate(words) if one_apart(w, x) and x[:kept] == w[:kept]}
    assert spelling.Automaton([]).one_error("anything", 3) == set()


@pytest.mark.parametrize(("per_shard", "queries"), [(16384, 1 << 18), (40, 1 << 18), (25, 10)])
def test_near_words_equal_all_pairs(spark, per_shard, queries):
    rng = random.Random(4)
    n = {w: rng.choice([2, 3, 3, 40, 500]) for w in near_vocabulary(rng, 400)}
    n |= {"prefixe" + "abcdefgh"[i] + "abcdefgh"[j]: 2 + i for i in range(8) for j in range(8)}  # one beginning over many shards
    got = spelling.near_words(spark.createDataFrame(list(n.items()), "word string, n long"), per_shard, queries).collect()
    want = {w: sorted((-n[x], x) for x in n if one_apart(w, x)) for w in n}
    assert {r["word"]: (r["n_near"], -r["form_n"], r["form"]) for r in got} == {w: (len(x), *x[0]) for w, x in want.items() if x}


def test_spelling_variants_equal_the_plain_version(spark):
    rng = random.Random(6)
    words = near_vocabulary(rng, 60, "aeÉst")
    weights = [rng.choice([1, 1, 10, 200, 4000]) for _ in words]
    docs = [(rng.randrange(10**6), " ".join(w.title() if rng.random() < 0.3 else w for w in rng.choices(words, weights, k=400))) for _ in range(40)]
    docs += [(None, "Nothing nothing NOTHING Straße×straße÷ naïveté a'b"), (1, None), (2, ""), (3, "short é 12"), (4, "wordlong " * 30000), (4, "wordlong " * 30000)]
    chain = {"chainaaaa": 9000, "chainaaab": 700, "chainaabb": 50, "chainabbb": 4, "chainbbbb": 2}
    docs += [(1000 + k, f"{w} " * k) for w, k in chain.items()]
    got = variants(spark, docs)
    assert got == plain_variants(plain_counts(docs)) and any(r[0] for r in got.values())
    assert got["chainabbb"][1] == "chainaaaa"


def test_spelling_of_empty_tables(spark, odd_documents):
    assert variants(spark, []) == {} and variants(spark, [(1, None), (2, "no long words")]) == {}
    odd = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    assert {r["word"]: r["n"] for r in spelling.spelling_variants(odd_documents).collect()} == plain_counts(odd)
