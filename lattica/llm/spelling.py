"""Spelling variants: words one error apart, found by automata over words read forward and backward."""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions_of, table_cut


class Automaton:
    """Minimal acyclic automaton of sorted, distinct words; a word's number is its place among them.

    moves[state] has for each character the next state and how many words it passes over: those that end in the state and
    those behind smaller characters. The sum along a word is its number, so no word is stored twice.
    """

    def __init__(self, words: list[str]):
        self.moves: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.size: list[int] = []
        known: dict[tuple, int] = {}
        path: list[tuple[list, list, list]] = [([], [], [])]  # ends a word, characters, states behind them
        before = ""
        for word in words:
            same = 0
            while same < len(before) and same < len(word) and before[same] == word[same]:
                same += 1
            self._close(path, same, known)
            for c in word[same:]:
                path[-1][1].append(c)
                path.append(([], [], []))
            path[-1][0].append(True)
            before = word
        self._close(path, 0, known)
        self.root = self._state(path[0], known)

    def _close(self, path: list, depth: int, known: dict) -> None:
        while len(path) - 1 > depth:
            state = self._state(path.pop(), known)
            path[-1][2].append(state)

    def _state(self, node: tuple[list, list, list], known: dict) -> int:
        ends, characters, states = bool(node[0]), tuple(node[1]), tuple(node[2])
        state = known.setdefault((ends, characters, states), len(self.final))
        if state == len(self.final):  # no state like it so far
            moves, passed = {}, int(ends)
            for c, to in zip(characters, states):
                moves[c] = (to, passed)
                passed += self.size[to]
            self.moves.append(moves)
            self.final.append(ends)
            self.size.append(passed)
        return state

    def _exactly(self, state: int, number: int, rest: str) -> int:
        for c in rest:
            move = self.moves[state].get(c)
            if move is None:
                return -1
            state, number = move[0], number + move[1]
        return number if self.final[state] else -1

    def one_error(self, word: str, kept: int) -> set[int]:
        """Numbers of the words that begin with word[:kept] and go on like the rest but for exactly one error."""
        state, number = self.root, 0
        for c in word[:kept]:
            move = self.moves[state].get(c)
            if move is None:
                return set()
            state, number = move[0], number + move[1]
        found = set()
        for i in range(kept, len(word) + 1):
            tail, moves = word[i + 1 :], self.moves[state]
            c = word[i : i + 1]
            for other, (to, passed) in moves.items():
                found.add(self._exactly(to, number + passed, c + tail))  # one more character
                if c and other != c:
                    found.add(self._exactly(to, number + passed, tail))  # another character
            if not c:
                break
            found.add(self._exactly(state, number, tail))  # one character less
            move = moves.get(c)
            if move is None:
                break
            state, number = move[0], number + move[1]
        found.discard(-1)
        return found


def word_counts(docs: DataFrame, least_length: int = 7, least: int = 2, spoil: int = 31) -> DataFrame:
    """(word, n) of all texts: runs of letters up to U+00FF, A-Z in lower case, some spoiled by a deletion.

    A run loses one character where the crc32 of `<doc_id>:<run>` is divisible by `spoil`: the character at crc32 % length.
    """
    letters = re.compile(f"[A-Za-zÀ-ÿ]{{{least_length},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter = Counter()
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                lower = (text.as_py() or b"").lower().decode("utf-8", "replace")  # of bytes, so A-Z alone
                for word, n in Counter(letters.findall(lower)).items():
                    h = zlib.crc32(word.encode(), prefix)
                    if h % spoil == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_length:
                            continue
                    total[word] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


_ROUTED = "backward boolean, shard int, slice int, query boolean, key string, n long"


def _shards(words: DataFrame, key, per_shard: int, total: int) -> DataFrame:
    """(shard, key, n): the words in order of key, cut into ranges of about per_shard words."""
    ranges = words.select(key.alias("key"), "n").repartitionByRange(max(1, math.ceil(total / per_shard)), "key")
    return cut(ranges.select(F.spark_partition_id().alias("shard"), "key", "n"))


def _routed(shards: DataFrame, backward: bool, starts: list[tuple[int, str]], slices: dict[int, int]) -> DataFrame:
    """Each word as a word of its shard, and as a query of all shards that may hold words which begin with its half.

    A shard's words go to each of its slices, a query to one of them.
    """
    numbers, firsts = [s for s, _ in starts], [k for _, k in starts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for shard, key, n in zip(*(c.to_pylist() for c in batch.columns)):
                rows += [(backward, shard, s, False, key, n) for s in range(slices.get(shard, 1))]
                half = key[: len(key) - len(key) // 2 if backward else len(key) // 2]
                for at in range(max(bisect_right(firsts, half) - 1, 0), bisect_left(firsts, half + "\U0010ffff")):
                    to = numbers[at]
                    rows.append((backward, to, zlib.crc32(key.encode()) % slices.get(to, 1), True, key, n))
            types = [pa.bool_(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, types)], ["backward", "shard", "slice", "query", "key", "n"])

    return shards.mapInArrow(run, _ROUTED)


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n_near, form, form_n) of each query in one slice of a shard: its near words there, and the most frequent one.

    A slice's words come before its queries; of the queries one batch is held at a time.
    """
    names = ["word", "n_near", "form", "form_n"]
    now, words, counts, automaton = None, [], [], None
    for batch in batches:
        out = []
        for backward, shard, part, query, key, n in zip(*(c.to_pylist() for c in batch.columns)):
            if now != (backward, shard, part):
                now, words, counts, automaton = (backward, shard, part), [], [], None
            if not query:
                words.append(key)
                counts.append(n)
                continue
            if automaton is None:
                automaton = Automaton(words)
            kept = len(key) - len(key) // 2 if backward else len(key) // 2
            near = automaton.one_error(key, kept)
            if backward:  # what also agrees in the other half is found forward
                other = key[kept:]
                near = {x for x in near if not words[x].endswith(other)}
            if near:
                form_n = max(counts[x] for x in near)
                turn = -1 if backward else 1
                form = min(words[x][::turn] for x in near if counts[x] == form_n)
                out.append((key[::turn], len(near), form, form_n))
        types = [pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, types)], names)


def near_words(words: DataFrame, per_shard: int = 16384, queries: int = 1 << 18) -> DataFrame:
    """(word, n_near, form, form_n) of rows (word, n): how many others differ by one error, and the most frequent of them.

    A pair one error apart agrees either in the first half of the shorter look, word[:length // 2], or in what follows it.
    So the sorted words are cut into ranges, each an automaton; a word is walked exactly through its first half and completed with
    one error, then the same over reversed words. A pair that both ways find is counted forward only. Ranges are cut by number of
    words and queries of a range are dealt into slices, so neither frequent words nor frequent beginnings gather in a task;
    pairs are never rows. The driver holds one short row a range.
    """
    total = words.count()
    routed, groups = [], 0
    for backward in (False, True):
        shards = _shards(words, F.reverse("word") if backward else F.col("word"), per_shard, total)
        starts = sorted((r["shard"], r["first"]) for r in shards.groupBy("shard").agg(F.min("key").alias("first")).collect())
        asked = _routed(shards, backward, starts, {}).where("query").groupBy("shard").count().collect()
        slices = {r["shard"]: math.ceil(r["count"] / queries) for r in asked}
        groups += sum(slices.get(shard, 1) for shard, _ in starts)
        routed.append(_routed(shards, backward, starts, slices))
    # a number of its own: the rows are few bytes but much work, so partitions must not be merged by size
    rows = routed[0].unionByName(routed[1]).repartition(max(partitions_of(words), groups // 8), "backward", "shard", "slice").sortWithinPartitions("backward", "shard", "slice", "query", "key")
    found = rows.mapInArrow(_answers, "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def spelling_variants(docs: DataFrame, times: int = 10, per_shard: int = 16384) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of at least 7 characters that occurs twice.

    A word's form is its near word of largest n (ties: the smaller word) if that n is at least `times` its own; root follows forms
    to the last. n grows `times`-fold with each step, so chains are short and doubling them takes few joins.

    Defined cases: a null or empty text has no words; a null doc_id counts as empty in the crc32; repeated rows count
    each; a word without near words has n_near 0 and is its own root; an empty table gives no rows; other columns are ignored.
    """
    words = table_cut(word_counts(docs))
    near = near_words(words, per_shard)
    follows = F.col("form_n") >= times * F.col("n")
    rows = table_cut(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(follows, F.col("form")).alias("form"), F.when(follows, F.col("form_n")).alias("form_n")
        )
    )
    # from a word with a form to the last: each round follows twice as many forms
    ends = cut(rows.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        ahead = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut(ends.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")))
        ends = moved.select("word", "root")
        if not moved.where("went").limit(1).count():
            break
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
