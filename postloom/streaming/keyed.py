"""Keyed tables that micro-batches add to and look up, without reading or rewriting the whole table.

A table is a list of *runs*. A batch adds one run; ``fan`` runs of a level are merged into one of the next, so a row is written
anew once a level, not once a batch. A run is Parquet files by bucket (a hash of the key's first 16 signs, which are its short id
too), sorted by key; it has as many buckets as its rows need. Beside each file stands a Bloom filter. A batch hashes its keys,
tries them on the filters as a join, and opens only files that may hold one of them.

What is current is said by one small file, ``_state/<number>.json``, written under another name and renamed. Runs are never
changed in place: a crash before the rename leaves the old state, and what it wrote is deleted by the next batch. One job writes
a table at a time; readers take the state once. Of a key in several runs the newest row counts.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

ROWS = 1 << 20  # of a bucket, about
BITS = 12  # of a filter for each key
PROBES = 6
FILTERED = 1 << 20  # keys of a batch from which filters would hardly spare a file: then all are opened
SHORT = 16


def _hash(key: str) -> Column:
    return F.xxhash64(F.substring(key, 1, SHORT))


def _places(h: np.ndarray, bits: int) -> np.ndarray:
    """[keys, PROBES]: the bits of each key in a filter of ``bits``, a power of two."""
    h = h.view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return (h[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)).astype(np.int64) & (bits - 1)


def _filters(run: str, bits: int):
    """(b, h), sorted by b -> a filter for each b: (run, b, bits). A bucket in several tasks has several filters."""

    def row(b: int, held: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([run]), pa.array([b], pa.int32()), pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())], names=["run", "b", "bits"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            b, h = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for x in np.unique(b).tolist():
                if x != now:
                    if now is not None:
                        yield row(now, held)
                    now, held = x, np.zeros(bits, np.uint8)
                held[_places(h[b == x], bits).ravel()] = 1
        if now is not None:
            yield row(now, held)

    return make


def _tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(run, b, hashes, bits) -> (run, b) where one of the keys may be."""
    for batch in batches:
        hit = []
        for hashes, bits in zip(batch.column(2), batch.column(3)):
            held = np.frombuffer(bits.as_buffer(), np.uint8)
            at = _places(hashes.values.to_numpy(), len(held) * 8)
            hit.append(bool(((held[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(1).any()))
        keep = pa.array(hit, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in (0, 1)], names=["run", "b"])


class Runs:
    """The keyed table at ``root``. ``unique``: no key is added twice, so rows need no comparison by age. ``linger``: the files of
    merged runs stay until the next batch, for readers that have begun."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, key: str = "key", fan: int = 8, rows: int = ROWS, unique: bool = False, linger: bool = True):
        self.spark, self.root, self.schema, self.key = spark, root.rstrip("/"), schema, key
        self.fan, self.rows, self.unique, self.linger = fan, rows, unique, linger
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # ---- state ----

    def _listed(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def state(self) -> dict:
        names = [n for n in self._listed(f"{self.root}/_state") if n.endswith(".json")]
        if not names:
            return {"number": 0, "runs": [], "batches": {}, "retired": []}
        stream = self._fs.open(self._path(f"{self.root}/_state/{names[-1]}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def publish(self, state: dict) -> dict:
        """``state`` is the table from now on."""
        state = state | {"number": state["number"] + 1}
        name, part = f"{self.root}/_state/{state['number']:012d}.json", self._path(f"{self.root}/_state/.{uuid.uuid4().hex}")
        out = self._fs.create(part, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not self._fs.rename(part, self._path(name)):
            raise RuntimeError(f"another job has written {name}")
        for old in self._listed(f"{self.root}/_state")[:-3]:
            self._fs.delete(self._path(f"{self.root}/_state/{old}"), False)
        return state

    def done(self, source: str, batch: int) -> bool:
        """Whether a batch of a stream is in the table."""
        return self.state()["batches"].get(source, -1) >= batch

    def _sweep(self, state: dict) -> None:
        """Deletes runs that the state does not name: of crashed batches, or retired."""
        named = {r["id"] for r in state["runs"]} | {r for r in state["retired"] if self.linger}
        for folder, prefix in ((self.root, "run="), (f"{self.root}/_filters", "")):
            for name in self._listed(folder):
                if name.startswith(prefix) and not (prefix == "" and name.startswith("_")) and name.removeprefix(prefix) not in named and (prefix or name.startswith("r")):
                    self._fs.delete(self._path(f"{folder}/{name}"), True)

    # ---- runs ----

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(_hash(self.key), F.lit(buckets)).cast("int")

    def _write(self, rows: DataFrame, n: int, level: int, at: int) -> dict:
        """A new run of about ``n`` rows; the state does not name it yet."""
        buckets = 1
        while buckets * self.rows < n:
            buckets *= 2
        bits = 64
        while bits < BITS * -(-n // buckets):
            bits *= 2
        run = f"r{uuid.uuid4().hex}"
        rows = rows.select(*self.schema.names).withColumn("b", self._bucket(buckets)).repartition(buckets, "b").sortWithinPartitions("b", self.key)
        rows.write.partitionBy("b").parquet(f"{self.root}/run={run}")
        held = self._read([run]).select("b", _hash(self.key).alias("h")).sortWithinPartitions("b")
        held.mapInArrow(_filters(run, bits), "run string, b int, bits binary").write.parquet(f"{self.root}/_filters/{run}")
        return {"id": run, "level": level, "buckets": buckets, "n": n, "at": at}

    def _read(self, runs: list[str], buckets: list[tuple[str, int]] | None = None) -> DataFrame:
        schema = StructType([*self.schema.fields, StructField("run", StringType()), StructField("b", IntegerType())])
        paths = [f"{self.root}/run={r}" for r in runs] if buckets is None else [f"{self.root}/run={r}/b={b}" for r, b in buckets]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.root).parquet(*paths)

    def _newest(self, rows: DataFrame, runs: list[dict]) -> DataFrame:
        if self.unique or len(runs) < 2:
            return rows.select(*self.schema.names)
        at = F.element_at(F.create_map(*(F.lit(x) for r in runs for x in (r["id"], r["at"]))), F.col("run"))
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*self.schema.names), at).alias("r")).select("r.*")

    def append(self, rows: DataFrame, n: int, source: str = "", batch: int = 0) -> None:
        """Adds ``n`` rows as a run and notes the batch, as one step; then merges what is due."""
        state = self.state()
        self._sweep(state)
        runs = [*state["runs"], self._write(rows, n, 0, state["number"] + 1)] if n else state["runs"]
        state = self.publish(state | {"runs": runs, "batches": state["batches"] | {source: batch}, "retired": []})
        while due := [r["level"] for r in state["runs"] if sum(x["level"] == r["level"] for x in state["runs"]) >= self.fan]:
            own = [r for r in state["runs"] if r["level"] == due[0]]
            merged = self._write(self._newest(self._read([r["id"] for r in own]), own), sum(r["n"] for r in own), due[0] + 1, max(r["at"] for r in own))
            rest = [r for r in state["runs"] if r["level"] != due[0]]
            state = self.publish(state | {"runs": [*rest, merged], "retired": state["retired"] + [r["id"] for r in own]})
        if not self.linger:
            self._sweep(state)

    # ---- reading ----

    def table(self) -> DataFrame:
        runs = self.state()["runs"]
        return self._newest(self._read([r["id"] for r in runs]), runs)

    def files(self, keys: DataFrame, n: int) -> list[tuple[str, int]]:
        """(run, bucket) of the files that may hold one of ``keys`` (n rows, one column). As many rows as there are files come to
        the driver, at most."""
        runs = self.state()["runs"]
        if n > FILTERED:
            return [(r["id"], b) for r in runs for b in range(r["buckets"])]
        if not runs:
            return []
        all_runs = F.array(*(F.struct(F.lit(r["id"]).alias("run"), F.lit(r["buckets"]).alias("buckets")) for r in runs))
        hashed = keys.select(_hash(keys.columns[0]).alias("h")).distinct().select("h", F.explode(all_runs).alias("r"))
        hashed = hashed.groupBy(F.col("r.run").alias("run"), F.pmod("h", F.col("r.buckets")).cast("int").alias("b")).agg(F.collect_list("h").alias("hashes"))  # of a batch
        filters = self.spark.read.schema("run string, b int, bits binary").parquet(*(f"{self.root}/_filters/{r['id']}" for r in runs))
        tried = hashed.join(filters, ["run", "b"]).select("run", "b", "hashes", "bits").mapInArrow(_tried, "run string, b int")
        return sorted((r.run, r.b) for r in tried.distinct().collect())

    def lookup(self, keys: DataFrame, n: int) -> DataFrame:
        """The rows of ``keys`` (n rows; one column of keys, or of their first 16 signs)."""
        runs = self.state()["runs"]
        short = keys.select(F.substring(keys.columns[0], 1, SHORT).alias("_short")).distinct()
        rows = self._read([], self.files(keys, n)).withColumn("_short", F.substring(self.key, 1, SHORT)).join(short, "_short", "left_semi")
        return self._newest(rows, runs)
