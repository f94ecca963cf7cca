"""Structured Streaming jobs made of the batch operators.

Each job takes a streaming DataFrame and folders in shared storage. Sinks are idempotent: what a batch writes goes to a
folder of its own, which a repeated batch overwrites.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DataType, IntegerType, StructField, StructType

from ..operators import tracking as TR
from ..operators.joins import only_new
from .keyed import Runs


COMPACT = 8  # runs of a keyed table that are merged into one


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; a local session without the setting gets one beside its warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/../checkpoints"
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _LEFT.append(path)
    return path


_LEFT: list[str] = []  # folders made in this session


def release(spark: SparkSession) -> None:
    """Delete the folders made so far. Call it when what was read from them has been used."""
    while _LEFT:
        path = spark._jvm.org.apache.hadoop.fs.Path(_LEFT.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _with(schema: StructType, name: str, kind: DataType) -> StructType:
    return StructType([*schema.fields, StructField(name, kind)])


def start(df: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", **trigger):
    return df.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def drain(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all there is and returns what it wrote, with the number of its batch."""
    spark = df.sparkSession
    out = shared_dir(spark, name)

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/rows/batch={batch}")

    start(df, write, f"{out}/checkpoint", mode).awaitTermination()
    schema = _with(df.schema, "batch", IntegerType())
    return spark.read.schema(schema).option("basePath", f"{out}/rows").parquet(f"{out}/rows")


def score_stream(postings: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, least: float = 0.65, seconds: int = 1):
    """Micro-batch scoring every ``seconds``: a stateless projection, gated, written batch by batch. How much a batch takes is
    up to the source (``maxFilesPerTrigger`` and the like)."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return start(score(postings).filter(F.col("score") >= least), write, checkpoint, processingTime=f"{seconds} seconds")


# ---- keyed tables (see keyed.py): a batch adds a run, and opens the files that may hold its keys ---------------------------


def _stream_of(spark: SparkSession) -> str:
    """The id of the streaming query that calls, if one does: a stream with a new checkpoint counts its batches anew."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or ""


def dedup_batch(seen_path: str, new_path: str) -> Callable[[DataFrame, int], None]:
    """Permanent dedup: first-wins rows of unseen keys go on, and their keys to the seen table. New rows are written first; the
    seen table takes the keys and the batch's number in one step, so a batch that fails anywhere before is done again from the
    same state, and one that was done is not done again."""
    schema = StructType().add("key", "string")

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        seen = Runs(spark, seen_path, schema, fan=COMPACT, unique=True, linger=False)
        source = f"{new_path} {_stream_of(spark)}".strip()
        if seen.done(source, batch):
            return
        rows = rows.persist()
        known = seen.lookup(rows.select("key"), rows.count())
        only_new(rows, known).write.mode("overwrite").parquet(f"{new_path}/batch={batch}")
        new = spark.read.parquet(f"{new_path}/batch={batch}").select("key")
        seen.append(new, new.count(), source, batch)
        rows.unpersist()

    return write


def upsert_batch(path: str, schema: StructType, key: str = "dedup_id", order: str | None = None, preserve: tuple[str, ...] = ()) -> Callable[[DataFrame, int], None]:
    """Keyed upsert of a batch: the last row of a key (by ``order``) replaces the old one as a whole. Old rows are looked up only
    for columns that keep their value. A repeated batch adds the same rows again."""

    def write(rows: DataFrame, batch: int) -> None:
        if order:
            rows = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")
        table = Runs(rows.sparkSession, path, schema, key, fan=COMPACT)
        new = rows.select(*schema.names).persist()
        n = new.count()
        old = table.lookup(new.select(key), n) if preserve else rows.sparkSession.createDataFrame([], schema)
        table.append(TR.upsert(old, new, key, preserve), n, "upsert", batch)
        new.unpersist()

    return write


def status_batch(path: str, schema: StructType) -> Callable[[DataFrame, int], None]:
    """Callbacks (data, ts) change rows of a keyed table of postings (column key); unknown actions and ids are ignored."""

    def write(rows: DataFrame, batch: int) -> None:
        table = Runs(rows.sparkSession, path, schema, fan=COMPACT)
        calls = TR.parse_callbacks(rows).persist()
        changed = TR.apply_status(table.lookup(calls.select("short_id"), calls.count()), calls).persist()
        table.append(changed, changed.count(), "status", batch)
        changed.unpersist()
        calls.unpersist()

    return write


def keyed_table(df: DataFrame, path: str, key: str = "key") -> None:
    """A table that ``upsert_batch`` and ``status_batch`` can change."""
    Runs(df.sparkSession, path, df.schema, key).append(df, df.count())


def read_keyed(spark: SparkSession, path: str, schema: StructType, key: str = "key") -> DataFrame:
    return Runs(spark, path, schema, key).table()


def ttl_dedup(df: DataFrame, key: list[str], at: str = "ts", days: int = 30) -> DataFrame:
    """First sighting of each key within ``days``; state is freed by the watermark."""
    return df.withWatermark(at, f"{days} days").dropDuplicatesWithinWatermark(key)


def minute_counts(df: DataFrame, at: str = "ts", late: str = "10 minutes") -> DataFrame:
    w = F.window(at, "1 minute")
    n = lambda s: F.count_if(F.col("outcome") == s).alias(s)
    return df.withWatermark(at, late).groupBy(w).agg(n("new"), n("dropped"), n("sent")).select(F.col("window.start").alias("minute"), "new", "dropped", "sent")


def fan_out_sinks(sinks: dict[str, Callable[[DataFrame], DataFrame]], out: str) -> Callable[[DataFrame, int], None]:
    """One batch to several projections (alert, report, tracker). The batch is kept while they are written."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.persist()
        for name, project in sinks.items():
            project(rows).write.mode("overwrite").parquet(f"{out}/{name}/batch={batch}")
        rows.unpersist()

    return write


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB, as ``fetch_health`` needs; the session's setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, old)


class _Behind:
    """Of outcomes in any order: the last success, and the failures behind it."""

    def __init__(self):
        self.good, self.failed, self.limit = None, [], 1 << 12

    def add(self, ts: np.ndarray, number: np.ndarray, ok: np.ndarray) -> None:
        if ok.any():
            at = np.lexsort([number[ok], ts[ok]])[-1]
            best = (int(ts[ok][at]), int(number[ok][at]))
            self.good = max(self.good or best, best)
        self.failed.append((ts[~ok], number[~ok]))
        if sum(len(t) for t, _ in self.failed) > self.limit:
            self.limit = 2 * len(self.left()) + (1 << 12)

    def left(self) -> np.ndarray:
        """The times of the failures behind the last success; others are forgotten."""
        ts, number = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*self.failed, (np.zeros(0, np.int64),) * 2))
        if self.good:
            keep = (ts > self.good[0]) | ((ts == self.good[0]) & (number > self.good[1]))
            ts, number = ts[keep], number[keep]
        self.failed = [(ts, number)]
        return ts


class Health(StatefulProcessor):
    """A company's streak of failures and the time of the last one, in milliseconds: all that is kept between batches."""

    def __init__(self, failures: int, cooldown: int):
        self.failures, self.cooldown = failures, 1000 * cooldown

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("streak", StructType().add("streak", "long").add("last", "long"))

    def _said(self, key: tuple, streak: int, state: str) -> pd.DataFrame:
        return pd.DataFrame({"company": [key[0]], "streak": [streak], "state": [state]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        streak, last = self.value.get() if self.value.exists() else (0, 0)
        seen = _Behind()
        for batch in rows:
            seen.add(batch["ts"].to_numpy("datetime64[us]").astype(np.int64), batch["event_id"].to_numpy(np.int64), batch["ok"].to_numpy(bool))
        failed = seen.left()
        if seen.good:
            streak, last = 0, 0
        if len(failed):
            streak, last = streak + len(failed), max(last, int(failed.max()) // 1000)
        self.value.update((int(streak), int(last)))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if streak >= self.failures:
            self.handle.registerTimer(last + self.cooldown + 1)
        yield self._said(key, int(streak), "open" if streak >= self.failures else "closed")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._said(key, int(self.value.get()[0]), "half_open")

    def close(self) -> None:
        pass


def fetch_health(df: DataFrame, failures: int = 3, cooldown: int = 30, late: str = "0 seconds") -> DataFrame:
    """Live state of each company from a stream of outcomes (company, ts, event_id, ok): streak and state after each batch. Start
    it inside ``rocksdb``.

    A company is open from ``failures`` failures in a row on; a timer in event time makes it half_open once the watermark is
    more than ``cooldown`` seconds past its last failure; a success closes it, and a failure then opens it again. The state is
    two numbers a company. A batch's rows come in any order, so while it runs a task holds 16 bytes for each failure of one company
    behind its last success in the batch; the source's rate bounds the batch.
    """
    return df.withWatermark("ts", late).groupBy("company").transformWithStateInPandas(
        Health(failures, cooldown), "company string, streak long, state string", "Append", "EventTime"
    )
