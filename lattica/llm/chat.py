"""Chat formatting: reply trees become conversations, one for each chosen root-to-leaf path, with a mask of what is learned."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table_cut, with_rank

# The template. A conversation is <s> and its turns; a control string inside a text gets a backslash
# after its first character, one more if it has some already, so no text holds a control string and each can be restored.
START = "<s>"
FRAMES = {"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("[INST] ", " [/INST]"), "assistant": (" ", " </s>")}
OTHER = ("[ROLE] ", " [NAME] ", " [/ROLE]")
CONTROL = (("<", r"/?s>|</?SYS>>"), ("[", r"/?(?:INST|ROLE|NAME)\]"))

_TURN = re.compile(
    r"<<SYS>>\n(?P<system>.*?)\n<</SYS>>\n|\[INST\] (?P<user>.*?) \[/INST\]|\[ROLE\] (?P<role>.*?) \[NAME\] (?P<other>.*?) \[/ROLE\]| (?P<assistant>.*?) </s>",
    re.DOTALL,
)


def escape(text: Column) -> Column:
    """Text in which no control string is left whole."""
    for first, rest in CONTROL:
        text = F.regexp_replace(text, rf"{re.escape(first)}(\\*)({rest})", rf"{first}\\$1$2")
    return text


def unescape(text: str) -> str:
    """What escape() was given."""
    for first, rest in CONTROL:
        text = re.sub(rf"{re.escape(first)}\\(\\*)({rest})", rf"{first}\1\2", text)
    return text


def parse_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn in a piece of formatted text; a piece begins and ends with whole turns."""
    at, turns = len(START) if text.startswith(START) else 0, []
    while at < len(text):
        found = _TURN.match(text, at)
        if found is None:
            raise ValueError(f"no turn begins at {at}")
        kind = found.lastgroup
        role = unescape(found["role"]) if kind == "other" else kind
        turns.append((role, unescape(found[kind])))
        at = found.end()
    return turns


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """Messages (tree, id, parent, role, text, score) of rows (conv_id, turn, role, text), each the reply to the row before.

    Rows go by turn, ties by role and text, null turns last; id is the place in the order of the whole table.
    """
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col(c).asc_nulls_last() for c in ("conv_id", "turn", "role", "text")]
    placed = with_rank(rows, *order, name="id")
    # the row before a conversation's first belongs to another tree, so it is no parent there
    return placed.select(F.col("conv_id").alias("tree"), "id", (F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _key(*cols) -> Column:
    return F.unhex(F.md5(F.to_json(F.struct(*cols))))


def _keyed(messages: DataFrame) -> DataFrame:
    """Messages by key, one row a (tree, id): the least of repeated rows; rows without an id differ by what they hold."""
    by_id = _key("tree", "id")
    alone = _key("tree", F.lit(True).alias("alone"), "parent", "role", "text")
    rows = messages.select(
        F.when(F.col("id").isNull(), alone).otherwise(by_id).alias("key"),
        F.struct(
            F.when(F.col("parent").isNotNull(), _key("tree", F.col("parent").alias("id"))).alias("up"),
            F.col("tree"), F.col("id"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
            F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
        ).alias("row"),
    )
    return table_cut(rows.groupBy("key").agg(F.min("row").alias("row")).select("key", "row.*", F.length("row.text").alias("size")))


def _climb(keyed: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """For each message its turns, score and size summed from the root, and for each k the links to the 2^k-th message above.

    Each self-join doubles how far a message sees, so a path of n takes about log2 n of them. A round that settles
    no message leaves only those on or below a circle of replies; they reach no root and are left out.
    """
    known = keyed.select(F.col("key").alias("up"), F.lit(True).alias("known"))
    state = cut(keyed.join(known, "up", "left").select("key", F.expr("if(known, up, null)").alias("above"), F.lit(1).cast("long").alias("turns"), "score", F.col("size").cast("long").alias("size")))
    steps, left = [], state.where("above is not null").count()
    while left:
        moving = state.where("above is not null")
        steps.append(moving.select("key", "above"))
        upper = state.select(F.col("key").alias("above"), F.col("above").alias("next"), *[F.col(c).alias(f"_{c}") for c in ("turns", "score", "size")])
        sums = [(F.col(c) + F.col(f"_{c}")).alias(c) for c in ("turns", "score", "size")]
        state = cut(state.where("above is null").unionByName(moving.join(upper, "above").select("key", F.col("next").alias("above"), *sums)))
        now = state.where("above is not null").count()
        if now == left:
            break
        left = now
    return state.where("above is null"), steps


def reply_paths(messages: DataFrame, branches: int = 1) -> tuple[DataFrame, DataFrame]:
    """The messages by key, and (tree, branch, key, place, size) for every message on a chosen path.

    A path runs from a root to a leaf. A tree's paths are ranked by the mean score of their messages, then longer ones
    first, then by the leaf's id; the best `branches` are chosen. place counts from the root, size is the characters so far.
    """
    keyed = _keyed(messages)
    settled, steps = _climb(keyed)
    replied = steps[0].select(F.col("above").alias("key")) if steps else keyed.select("key").limit(0)
    leaves = settled.join(replied, "key", "left_anti").join(keyed.select("key", "tree", "id"), "key")
    order = Window.partitionBy("tree").orderBy((F.col("score") / F.col("turns")).desc(), F.col("turns").desc(), F.col("id").asc_nulls_last(), "key")
    chosen = leaves.withColumn("branch", F.row_number().over(order)).where(F.col("branch") <= branches)
    on = cut(chosen.select("tree", "branch", "key", (F.col("turns") - 1).alias("place")))
    for k in range(len(steps) - 1, -1, -1):
        up = on.join(steps[k], "key").select("tree", "branch", F.col("above").alias("key"), (F.col("place") - (1 << k)).alias("place"))
        on = cut(on.unionByName(up))
    return keyed, on.join(settled.select("key", "size"), "key")


def format_replies(messages: DataFrame, branches: int = 1, turns: int = 1024, chars: int = 1 << 22) -> DataFrame:
    """tree, branch, first, n_turns, text, loss: each chosen path of a tree of messages as one formatted conversation.

    messages: tree, id, parent, role, text, score. A conversation is one row, unless it has more than `turns` turns or
    `chars` characters: then it is one row for each such piece, in the order of `first`, the place of its first turn; the
    texts in order, nothing between, are the conversation. loss has the (start, length) in code points of the piece's
    assistant texts, as escaped. So no row and no task holds more than a piece, however long a path is.

    Defined cases: a null text or role is empty; a message whose parent is null or not in its tree is a root; repeated
    rows of a (tree, id) count once; a message without an id has no replies; messages on or below a circle of replies are on
    no path; null is a tree like others, a null score 0; other columns are ignored; an empty table gives no rows.
    """
    keyed, on = reply_paths(messages, branches)
    role, text, name = F.col("role"), escape(F.col("text")), escape(F.col("role"))
    before, after = F.concat(F.lit(OTHER[0]), name, F.lit(OTHER[1])), F.lit(OTHER[2])
    for kind, (a, b) in FRAMES.items():
        before, after = F.when(role == kind, F.lit(a)).otherwise(before), F.when(role == kind, F.lit(b)).otherwise(after)
    before = F.concat(F.when(F.col("place") == 0, F.lit(START)).otherwise(F.lit("")), before)
    made = on.join(keyed.select("key", "role", "text"), "key").select(
        "tree", "branch", "place", F.floor(F.col("place") / turns).alias("__t"), F.floor(F.col("size") / chars).alias("__c"),
        before.alias("before"), text.alias("text"), after.alias("after"), (role == "assistant").alias("learned"),
    )
    turn = F.struct("place", F.concat("before", "text", "after").alias("chunk"), F.length("before").alias("skip"), F.length("text").alias("n"), F.length("after").alias("rest"), "learned")
    pieces = made.groupBy("tree", "branch", "__t", "__c").agg(F.sort_array(F.collect_list(turn)).alias("all"))
    spans = """aggregate(all, named_struct('at', 0, 'loss', cast(array() as array<struct<start:int,length:int>>)),
        (a, x) -> named_struct('at', a.at + x.skip + x.n + x.rest,
            'loss', if(x.learned, array_append(a.loss, named_struct('start', a.at + x.skip, 'length', x.n)), a.loss)), a -> a.loss)"""
    return pieces.select(
        "tree", "branch", F.col("all")[0]["place"].alias("first"), F.size("all").alias("n_turns"),
        F.array_join(F.transform("all", lambda x: x["chunk"]), "").alias("text"), F.expr(spans).alias("loss"),
    )


class _Digest:
    """What one conversation's pieces say, read one after the other."""

    def __init__(self):
        self.turns, self.chars, self.loss_chars = 0, 0, 0
        self.said, self.learned = hashlib.sha256(), hashlib.sha256()

    def read(self, text: str, loss: list[dict]) -> None:
        self.chars += len(text)
        for role, said in parse_turns(text):
            self.turns += 1
            self.said.update(f"{role}\n{said}\n".encode())
        for span in loss:
            part = unescape(text[span["start"] : span["start"] + span["length"]])
            self.loss_chars += len(part)
            self.learned.update(part.encode())

    def row(self) -> tuple:
        return self.turns, self.said.hexdigest(), self.loss_chars, self.learned.hexdigest(), self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """tree, branch, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all parsed from format_replies()' rows.

    Pieces of a conversation stream through one task in order, as its digest needs; a task holds one piece at a time.
    """
    kind = dict(formatted.dtypes)["tree"]
    names = ["tree", "branch", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [None, pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        now, digest = None, None
        for batch in batches:
            types[0], out = batch.schema.field(0).type, []
            for i in range(batch.num_rows):
                tree, branch, _, text, loss = (batch.column(c)[i].as_py() for c in range(5))
                if now != (tree, branch):
                    if digest is not None:
                        out.append((*now, *digest.row()))
                    now, digest = (tree, branch), _Digest()
                digest.read(text, loss)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, types)], names)
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*now, *digest.row()), types)], names)

    ordered = formatted.select("tree", "branch", "first", "text", "loss").repartition("tree", "branch").sortWithinPartitions("tree", "branch", "first")
    return ordered.mapInArrow(run, f"tree {kind}, branch int, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
