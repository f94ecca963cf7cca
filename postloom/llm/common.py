"""Helpers shared by the training-data operators."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

NULL_ID = np.iinfo(np.int64).max  # a row without an id sorts after every row that has one


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local session, as in tests, may go without
    the setting; it gets one beside its warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/../checkpoints"
        spark.sparkContext.setCheckpointDir(base)
    return base


_LEFT: list[tuple[str, str]] = []  # what operators wrote in this session: ("path" or "table", name)


def drop(spark: SparkSession, held: list[tuple[str, str]]) -> None:
    """Delete what is listed."""
    while held:
        kind, name = held.pop()
        if kind == "table":
            spark.sql(f"DROP TABLE IF EXISTS `{name}`")
            continue
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete the tables that operators wrote to the shared folder so far. Call it when their results have been used."""
    drop(spark, _LEFT)


def keep(held: list[tuple[str, str]]) -> None:
    """Leave what is listed to ``release``."""
    _LEFT.extend(held)


@contextmanager
def scratch(held: list[tuple[str, str]]) -> Iterator[list[tuple[str, str]]]:
    """Lists in ``held`` what operators write inside, for ``drop``."""
    mark = len(_LEFT)
    yield held
    held.extend(_LEFT[mark:])
    del _LEFT[mark:]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` to a table in the shared folder and read it back.

    Survives lost executors, which a cached frame does not.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _LEFT.append(("path", path))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, row: str, name: str) -> DataFrame:
    """``docs`` with a key for each row, whatever its id: a table, so that every reader sees the same keys."""
    return materialize(docs.withColumn(row, F.monotonically_increasing_id()), name)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---- bytes of Arrow string columns, without a Python object a row -------------------------------------------------


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): the UTF-8 of all rows, end to end; row i is ``bytes[offsets[i]:offsets[i + 1]]``. Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    if column.null_count:  # a null's slot may hold bytes in principle
        size = np.diff(off)
        null = np.asarray(column.is_null())
        if size[null].any():
            data = data[np.repeat(~null, size)]
            size = np.where(null, 0, size)
            off = np.concatenate([[0], np.cumsum(size)])
    return data, off


def integer_ids(docs: DataFrame) -> DataFrame:
    """``docs``, if its ids are integers."""
    kind = docs.schema["doc_id"].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"doc_id must be an integer column, not {kind.simpleString()}")
    return docs


def ids_of(column: pa.Array) -> np.ndarray:
    """Row ids as int64; null: ``NULL_ID``."""
    return column.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the runs [start, start + size), one run after the other."""
    sizes = np.asarray(sizes, np.int64)
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(sizes) - sizes
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - first, sizes)


def distinct(x: np.ndarray) -> np.ndarray:
    """The different values, sorted. By sorting, which beats the hash table of ``np.unique`` on many values."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


# ---- words --------------------------------------------------------------------------------------------------------


def coded_words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(codes, held, first): the words of all rows in order as numbers, the different words by number (their real bytes, so
    equal numbers mean equal words), and of each row the number of its first word. A word is a maximal run of ``inside``."""
    start, end, first = word_runs(data, offsets, inside)
    bounds = np.concatenate([[0], np.cumsum(end - start)])
    held = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(data[inside[data]])]).dictionary_encode()
    return held.indices.to_numpy().astype(np.int64), held.dictionary, first


def hash_words(held: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word: by blocks of 8 bytes, each mixed in before the next; long words by BLAKE2."""
    data, off = text_bytes(held)
    size = np.diff(off)
    out = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    live = np.flatnonzero(size <= 64)
    for at in range(0, 64, 8):
        live = live[size[live] > at]
        if not len(live):
            break
        spare = np.maximum(at + 8 - size[live], 0).astype(np.uint64)
        block = (eight[off[live] + at] << (spare * np.uint64(8))) >> (spare * np.uint64(8))
        out[live] = mix((out[live] ^ block) * np.uint64(0xA0761D6478BD642F) + np.uint64(at))
    for k in np.flatnonzero(size > 64).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[off[k] : off[k + 1]].tobytes(), digest_size=8).digest(), "little")
    return out


# ---- hashes of byte runs ------------------------------------------------------------------------------------------


def _odd_inverse(x: int) -> int:
    y = x
    for _ in range(6):
        y = y * (2 - x * y) % 2**64
    return y


_BASE = 0x9E3779B97F4A7C15
_INVERSE = _odd_inverse(_BASE)
_BYTE = np.random.default_rng(20240131).integers(1, 2**64, 256, dtype=np.uint64)  # one fixed random word a byte


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class _Local(dict):
    """A cache that stays where it is: a function that travels takes it along empty."""

    def __reduce__(self):
        return _Local, ()


_POWERS = _Local()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept by the worker up to the longest run it has seen."""
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"][:n], _POWERS["down"][:n]


class RunHash:
    """Hashes of any runs of one byte array, each in constant time: a polynomial modulo 2**64 over prefix sums.

    Only a first sieve: some long runs collide by construction (Thue-Morse strings), so whoever takes equal hashes for equal
    runs must compare the bytes.
    """

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        self.power, inverse = _powers(n)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(_BYTE[data] * inverse[:-1], out=self.sums[1:])

    def every(self, size: int) -> np.ndarray:
        """Of the runs of ``size`` bytes from each place on."""
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[size:] - self.sums[:n]) * self.power[:n])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[end] - self.sums[start]) * self.power[start]
        return mix(x + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def chunks(offsets: np.ndarray, limit: int):
    """Runs (i, j) of rows of about ``limit`` bytes, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def word_runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): the maximal runs of ``inside`` bytes within rows, and of each row the number of its first."""
    flags = inside[data]
    first, last = flags.copy(), flags.copy()
    if len(data):
        cut = offsets[(offsets > 0) & (offsets < len(data))]
        before = np.concatenate([[False], flags[:-1]])
        before[cut] = False
        first &= ~before
        after = np.concatenate([flags[1:], [False]])
        after[cut - 1] = False
        last &= ~after
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, offsets)
