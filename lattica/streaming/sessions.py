"""Observation sessions and committed events as Structured Streaming jobs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.observe import KINDS, event_statuses

RECORDS = "array<struct<scope:string,key:string,kind:string,body:string>>"
COVERAGE = "array<struct<scope:string,kinds:array<string>,state:string>>"
#: One message of a session. begin has scopes, batch has records, complete has coverage, expire names a heartbeat.
MESSAGE = f"session string, arrival long, sequence long, type string, heartbeat long, scopes array<string>, records {RECORDS}, coverage {COVERAGE}"
#: What comes of a message; records are those that it brought and that no earlier one had.
RECEIPT = f"session string, arrival long, sequence long, type string, status string, problem string, accepted int, replayed int, total long, records {RECORDS}, coverage {COVERAGE}"
_STATE = "status string, sequence long, heartbeat long, signals long, batches long, records long, characters long, scopes array<string>"
_ENDS = {"complete": "completed", "fail": "failed", "cancel": "cancelled", "expire": "expired"}


@dataclass(frozen=True)
class Bounds:
    """What one session may have in all, and one batch."""

    batch_records: int = 2048
    batches: int = 4096
    records: int = 100_000
    characters: int = 256 * 1024 * 1024
    signals: int = 1_000_000
    scopes: int = 256


@dataclass
class _Session:
    """The state of a session between two messages. What refuses a message leaves it as it is."""

    status: str
    sequence: int
    heartbeat: int
    signals: int
    batches: int
    records: int
    characters: int
    scopes: list

    def row(self) -> tuple:
        return self.status, self.sequence, self.heartbeat, self.signals, self.batches, self.records, self.characters, list(self.scopes)


class SessionMachine(StatefulProcessor):
    """Sessions as state: one value for a session, and the content hash of each of its record keys.

    Messages are judged one by one in order of arrival, and a message is taken whole or refused whole; state then stays as it was and
    the session goes on. Nothing that was written is read again: a key that came before is looked up in the state.
    """

    def __init__(self, bounds: Bounds):
        self._bounds = bounds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._session = handle.getValueState("session", _STATE)
        self._known = handle.getMapState("known", "scope string, key string", "content string")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = _Session(*self._session.get()) if self._session.exists() else None
        for m in sorted(rows, key=lambda r: (r["arrival"] is None, r["arrival"] or 0)):
            pending, replayed, problem = {}, 0, self._refusal(held, m)
            if problem is None and m["type"] == "batch":
                pending, replayed, problem = self._batch(held, m["records"] or [])
            if problem is None:
                held = self._taken(held, m, pending)
            yield Row(
                session=key[0], arrival=m["arrival"], sequence=m["sequence"], type=m["type"], status=held.status if held else "none", problem=problem,
                accepted=len(pending), replayed=replayed, total=held.records if held else 0,
                records=[r for r, _ in pending.values()], coverage=m["coverage"] if problem is None and m["type"] == "complete" else None,
            )
        if held is not None:
            self._session.update(held.row())

    def _refusal(self, held: _Session | None, m: Row) -> str | None:
        """Why a message is refused before its records are looked at."""
        b, kind = self._bounds, m["type"]
        if kind == "begin":
            if held is not None:
                return "session-already-begun"
            scopes = m["scopes"] or []
            return None if scopes and len(set(scopes)) == len(scopes) <= b.scopes and None not in scopes else "invalid-scopes"
        if held is None:
            return "session-not-begun"
        if held.status != "active":
            return "session-ended"
        if kind not in ("batch", "heartbeat", *_ENDS):
            return "unknown-message-type"
        if held.signals >= b.signals - (kind not in _ENDS):  # the last signal is kept for the end
            return "session-too-large"
        if kind == "expire":
            return None if m["heartbeat"] == held.heartbeat else "expiry-heartbeat-mismatch"
        if m["sequence"] is None or m["sequence"] <= held.sequence:
            return "sequence-not-advancing"
        if kind == "complete":
            return self._coverage_problem(held, m["coverage"] or [])
        if kind == "batch" and held.batches >= b.batches:
            return "session-too-large"
        return None

    def _coverage_problem(self, held: _Session, coverage: list) -> str | None:
        """Every declared scope is covered once, by kinds that exist and a state that does."""
        if sorted(str(c["scope"]) for c in coverage) != sorted(held.scopes):
            return "coverage-mismatch"
        fine = all(c["state"] in ("complete", "partial") and c["kinds"] is not None and len(set(c["kinds"])) == len(c["kinds"]) and set(c["kinds"]) <= set(KINDS) for c in coverage)
        return None if fine else "invalid-coverage"

    def _batch(self, held: _Session, records: list) -> tuple[dict, int, str | None]:
        """({(scope, key): (record, content)} that are new, how many came before, why the whole batch is refused)."""
        b, pending, replayed, none = self._bounds, {}, 0, ({}, 0)
        if len(records) > b.batch_records:
            return *none, "batch-too-large"
        for r in records:
            if r["scope"] not in held.scopes:
                return *none, "undeclared-scope"
            if r["kind"] not in KINDS or r["key"] is None:
                return *none, "invalid-record"
            at = (r["scope"], r["key"])
            content = hashlib.sha256(repr((r["kind"], r["body"])).encode("utf-8", "surrogatepass")).hexdigest()
            before = pending[at][1] if at in pending else self._known.getValue(at)[0] if self._known.containsKey(at) else None
            if before is None:
                pending[at] = (r, content)
            elif before != content:
                return *none, "contradictory-observation"
            else:
                replayed += 1
        size = sum(len(r["body"] or "") + len(r["key"]) for r, _ in pending.values())
        if held.records + len(pending) > b.records or held.characters + size > b.characters:
            return *none, "session-too-large"
        return pending, replayed, None

    def _taken(self, held: _Session | None, m: Row, pending: dict) -> _Session:
        kind = m["type"]
        if kind == "begin":
            return _Session("active", m["sequence"] or 0, 0, 0, 0, 0, 0, list(m["scopes"]))
        for at, (_, content) in pending.items():
            self._known.updateValue(at, (content,))
        held.records += len(pending)
        held.characters += sum(len(r["body"] or "") + len(r["key"]) for r, _ in pending.values())
        held.signals += 1
        held.batches += kind == "batch"
        held.sequence = held.sequence if kind == "expire" else m["sequence"]
        held.heartbeat = m["sequence"] if kind == "heartbeat" else held.heartbeat
        held.status = _ENDS.get(kind, held.status)
        if held.status != "active":
            self._known.clear()  # nothing is compared with an ended session's records
        return held


def session_receipts(messages: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """A stream of RECEIPT rows for a stream of MESSAGE rows, in order of arrival within each session.

    There is no clock: nothing times out by itself. A micro-batch brings each session's messages together in one task; how many
    those are is a matter of the trigger, and of the bounds that a session has in all.
    """
    return messages.groupBy("session").transformWithState(SessionMachine(bounds), RECEIPT, "append", "none")


@contextmanager
def _state_store(spark: SparkSession):
    """Keyed state with maps needs the store that ships with Spark for it; the session's own choice is put back."""
    name, wanted = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, wanted)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def run_sessions(messages: DataFrame, checkpoint: str, path: str, bounds: Bounds = Bounds()) -> None:
    """Judge the messages that are there and stop, appending receipts to a Parquet folder exactly once."""
    with _state_store(messages.sparkSession):
        run_available(session_receipts(messages, bounds), checkpoint, path)


def read_receipts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECEIPT).parquet(path)


def published_records(receipts: DataFrame) -> DataFrame:
    """session, scope, key, kind, body of the sessions that completed: all that their batches brought, refused ones apart."""
    done = receipts.where("type = 'complete' and problem is null").select("session")
    return receipts.where("accepted > 0").join(done, "session", "left_semi").select("session", F.explode("records").alias("r")).select("session", "r.*")


def published_coverage(receipts: DataFrame) -> DataFrame:
    """session, scope, kinds, state as the completed sessions said."""
    done = receipts.where("type = 'complete' and problem is null")
    return done.select("session", F.explode("coverage").alias("c")).select("session", "c.*")


def event_sink(out_path: str, state_path: str):
    """A foreachBatch function that judges committed events (stream, arrival, generation, start) as they come.

    A micro-batch is judged as a table, by ranges of (stream, arrival), so that a stream with most of the events
    fills no task; from one micro-batch to the next goes the largest generation of each stream, one row a stream. Outputs are
    folders per micro-batch, written anew when one is retried.
    """

    def judge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        held = spark.read.schema("stream string, now long").parquet(f"{state_path}/batch={number - 1}") if number else spark.createDataFrame([], "stream string, now long")
        before = held.withColumnRenamed("now", "__now")
        met = batch.join(before, "stream", "left").withColumn("start", F.greatest("start", "__now")).drop("__now")
        event_statuses(met).select("stream", "arrival", "generation", "status").write.mode("overwrite").parquet(f"{out_path}/batch={number}")
        top = batch.select("stream", F.greatest("generation", "start").alias("now")).unionByName(held).groupBy("stream").agg(F.max("now").alias("now"))
        top.write.mode("overwrite").parquet(f"{state_path}/batch={number}")

    return judge


def run_events(events: DataFrame, checkpoint: str, out_path: str, state_path: str) -> None:
    """Judge what is there and stop."""
    query = events.writeStream.foreachBatch(event_sink(out_path, state_path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def run_available(df: DataFrame, checkpoint: str, path: str) -> None:
    """Process what is there and stop, appending to a Parquet folder exactly once."""
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
