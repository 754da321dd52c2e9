"""Observation sessions as keyed state, over several micro-batches, against a plain machine."""

import random

import pytest

from lattica.streaming import sessions

COVERED = [("s", ["action"], "complete")]


def message(session, arrival, sequence, type_, heartbeat=None, scopes=None, records=None, coverage=None):
    return session, arrival, sequence, type_, heartbeat, scopes, records, coverage


def batch(session, arrival, sequence, *records):
    return message(session, arrival, sequence, "batch", records=[(r[0], r[1], "action", r[2]) for r in records])


class Stream:
    """Messages sent part by part; each send is one run over the same checkpoint."""

    def __init__(self, spark, tmp_path, **bounds):
        self.spark, self.bounds, (self.src, self.out, self.chk) = spark, sessions.Bounds(**bounds), (str(tmp_path / n) for n in ("in", "out", "chk"))

    def send(self, *messages):
        self.spark.createDataFrame(list(messages), sessions.MESSAGE).coalesce(1).write.mode("append").parquet(self.src)
        sessions.run_sessions(self.spark.readStream.schema(sessions.MESSAGE).parquet(self.src), self.chk, self.out, self.bounds)
        return self

    def receipts(self):
        return sessions.read_receipts(self.spark, self.out)

    def problems(self):
        return {(r["session"], r["arrival"]): r["problem"] for r in self.receipts().collect()}

    def published(self):
        return sorted((r["session"], r["scope"], r["key"], r["body"]) for r in sessions.published_records(self.receipts()).collect())


def test_nothing_is_taken_after_the_end_and_a_refused_batch_leaves_the_session_open(spark, tmp_path):
    stream = Stream(spark, tmp_path)
    stream.send(message("a", 0, 0, "begin", scopes=["s"]), batch("a", 1, 1, ("s", "k", "x")), message("b", 0, 0, "begin", scopes=["s"]), batch("b", 1, 1, ("s", "k", "x")))
    stream.send(batch("b", 2, 2, ("s", "new", "y"), ("s", "k", "OTHER")), message("a", 2, 2, "complete", coverage=COVERED))
    # the refused batch did not count its sequence either, and what it brought beside the contradiction is new again
    stream.send(batch("b", 3, 2, ("s", "new", "z"), ("s", "k", "x")), message("b", 4, 4, "complete", coverage=COVERED), batch("a", 3, 3, ("s", "late", "x")))
    assert stream.problems() == {
        ("a", 0): None, ("a", 1): None, ("a", 2): None, ("a", 3): "session-ended", ("b", 0): None, ("b", 1): None, ("b", 2): "contradictory-observation", ("b", 3): None, ("b", 4): None,
    }
    assert stream.published() == [("a", "s", "k", "x"), ("b", "s", "k", "x"), ("b", "s", "new", "z")]
    assert [(r["accepted"], r["replayed"], r["total"]) for r in stream.receipts().where("session = 'b' and arrival = 3").collect()] == [(1, 1, 2)]
    assert [tuple(r) for r in sessions.published_coverage(stream.receipts()).where("session = 'a'").collect()] == [("a", "s", ["action"], "complete")]


def test_expiry_names_the_last_heartbeat(spark, tmp_path):
    stream = Stream(spark, tmp_path)
    begin = [message(s, 0, 0, "begin", scopes=["s"]) for s in ("never", "right", "old")]
    stream.send(*begin, message("right", 1, 1, "heartbeat"), message("old", 1, 1, "heartbeat"), message("old", 2, 2, "heartbeat"))
    stream.send(message("right", 2, None, "expire", 1), message("old", 3, None, "expire", 1), message("never", 1, None, "expire", 0), message("right", 3, 3, "heartbeat"))
    last = {(r["session"], r["arrival"]): (r["status"], r["problem"]) for r in stream.receipts().where("arrival > 0 and type = 'expire' or arrival = 3").collect()}
    assert last == {("right", 2): ("expired", None), ("old", 3): ("active", "expiry-heartbeat-mismatch"), ("never", 1): ("expired", None), ("right", 3): ("expired", "session-ended")}


def test_bounds_and_what_is_no_message(spark, tmp_path):
    stream = Stream(spark, tmp_path, batch_records=2, records=3, signals=5, batches=3, scopes=2)
    b = lambda at, *keys: batch("a", at, at, *[("s", k, "x") for k in keys])
    stream.send(
        message("none", 1, 1, "heartbeat"), message("wide", 0, 0, "begin", scopes=["s", "t", "u"]), message("twice", 0, 0, "begin", scopes=["s", "s"]), message("a", 0, 0, "begin", scopes=["s", "t"]),
        message("a", 1, 1, "begin", scopes=["s"]), b(2, "1", "2", "3"), b(3, "1", "2"), b(4, "3", "4"), b(5, "3"), b(6, "1"), b(7, "1"), message("a", 8, 8, "shout"), message("a", 9, 9, "heartbeat"),
        message("a", 10, 10, "heartbeat"), message("a", 11, 11, "complete", coverage=COVERED), message("a", 12, 12, "complete", coverage=[("t", [], "partial"), ("s", ["action", "action"], "complete")]),
        message("a", 13, 13, "complete", coverage=[("t", [], "partial"), ("s", ["action"], "complete")]),
    )
    want = {
        ("none", 1): "session-not-begun", ("wide", 0): "invalid-scopes", ("twice", 0): "invalid-scopes", ("a", 0): None, ("a", 1): "session-already-begun", ("a", 2): "batch-too-large", ("a", 3): None,
        ("a", 4): "session-too-large", ("a", 5): None, ("a", 6): None, ("a", 7): "session-too-large", ("a", 8): "unknown-message-type", ("a", 9): None, ("a", 10): "session-too-large",
        ("a", 11): "coverage-mismatch", ("a", 12): "invalid-coverage", ("a", 13): None,
    }
    assert stream.problems() == want and len(stream.published()) == 3


def plain(messages):
    """The rules of sessions without bounds, in a few lines of their own: {(session, arrival): taken}."""
    state, out = {}, {}
    for m in sorted(messages, key=lambda m: m[1]):
        name, at, sequence, kind, beat, _, records, _ = m
        now = state.get(name)
        ok = now is None if kind == "begin" else now is not None and now["open"]
        if ok and kind not in ("begin", "expire"):
            ok = sequence > now["last"]
        if ok and kind == "expire":
            ok = beat == now["beat"]
        if ok and kind == "batch":
            seen = dict(now["records"])
            for r in records:
                ok = ok and r[0] == "s" and seen.setdefault(r[1], r[3]) == r[3]
            now["records"] = seen if ok else now["records"]
        out[name, at] = ok
        if ok and kind == "begin":
            state[name] = {"open": True, "last": sequence, "beat": 0, "records": {}, "done": False}
        elif ok:
            now["last"] = now["last"] if kind == "expire" else sequence
            now["beat"] = sequence if kind == "heartbeat" else now["beat"]
            now["open"], now["done"] = kind in ("batch", "heartbeat"), kind == "complete"
    return out, sorted((n, "s", k, b) for n, s in state.items() if s["done"] for k, b in s["records"].items())


@pytest.mark.parametrize("seed", [1, 2])
def test_sessions_equal_a_plain_machine(spark, tmp_path, seed):
    rng, messages = random.Random(seed), []
    for n in range(30):
        name, sequence = f"x{n}", 0
        for at in range(12):
            sequence += rng.choice([1, 1, 1, 2, -1])
            kind = "begin" if at == rng.choice([0, 0, 0, 1]) else rng.choice(["batch"] * 8 + ["heartbeat", "heartbeat", "expire", "complete", "fail", "cancel"])
            records = [(rng.choice("sssssssst"), str(rng.randrange(6)), "action", rng.choice("xxxxxxy")) for _ in range(rng.randrange(3))]
            messages.append(message(name, at * 100 + n, sequence, kind, rng.choice([0, sequence - 1, 2]), ["s"], records if kind == "batch" else None, COVERED))
    stream = Stream(spark, tmp_path)
    for low, high in ((0, 250), (250, 700), (700, 9999)):
        part = [m for m in messages if low <= m[1] < high]
        rng.shuffle(part)
        stream.send(*part)
    taken, published = plain(messages)
    assert {k: p is None for k, p in stream.problems().items()} == taken and stream.published() == published and published
