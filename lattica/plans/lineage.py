"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Shuffle files of a finished statement go at once; Spark's default leaves them until the driver collects garbage.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Who is inside shuffles_dropped(), by session: how many, and the setting before the first.
_USERS: dict[int, tuple[int, str | None]] = {}
_LOCK = threading.Lock()
#: Folders of cut() that the innermost scratch_dropped() answers for.
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's spark.checkpoint.dir; only a local session without one takes a folder of its own.

    A folder of one machine loses data on a cluster, so a session with executors elsewhere is refused.
    """
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not held.isDefined() and not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = held.get() if held.isDefined() else tempfile.mkdtemp(prefix="spark-checkpoint-")
    if not held.isDefined():
        spark.sparkContext.setCheckpointDir(shared)
    return shared


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise df as a checkpoint, which keeps how its rows are dealt to partitions."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind; of several threads of a session the last one puts its setting back."""
    key = id(spark._jsparkSession)
    with _LOCK:
        users, held = _USERS.get(key, (0, None))
        held = held if users else spark.conf.get(_DROP_SHUFFLES, None)
        _USERS[key] = users + 1, held
        spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        with _LOCK:
            users, held = _USERS.pop(key)
            if users > 1:
                _USERS[key] = users - 1, held
            elif held is None:
                spark.conf.unset(_DROP_SHUFFLES)
            else:
                spark.conf.set(_DROP_SHUFFLES, held)


@contextmanager
def scratch_dropped(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """What cut() writes inside is deleted at the end, but for the tables that are put into the list given."""
    kept: list[DataFrame] = []
    written: list[str] = []
    token = _WRITTEN.set(written)
    try:
        yield kept
    finally:
        _WRITTEN.reset(token)
        stay = {getattr(df, "scratch_path", None) for df in kept}
        for path in written:
            if path in stay:
                if (outer := _WRITTEN.get()) is not None:
                    outer.append(path)
                continue
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise df as a table in the shared checkpoint folder: loops keep flat plans and survive lost executors.

    Columns are compressed, which a checkpoint's rows are not, and Spark knows the table's size, so that small ones are broadcast
    in place of shuffling what they are joined with. What Parquet can't hold becomes a checkpoint.
    """
    names = [f.name.lower() for f in df.schema]
    if not names or len(set(names)) < len(names) or any(isinstance(f.dataType, T.NullType) for f in df.schema):
        return checkpointed(df)
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    if (written := _WRITTEN.get()) is not None:
        written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def is_empty(df: DataFrame) -> bool:
    return not df.limit(1).count()
