"""Exact dedup by an extendible-hash index on shared files.

1. Every task reads whole texts, drops white space, and chains the rows of a batch by key (64 bits of the text's SHA-256) and then
   by bytes. It writes one small row a document, and one *entry* for each different text of the batch: so a text that a third
   of all rows hold leaves a task once, not once a row.
2. The directory starts with one bucket and doubles while a bucket holds more bytes than ``capacity``; a directory slot is
   the leading bits of the key. Its greatest depth follows the bytes (buckets can split down to half of ``capacity`` and
   less), up to ``2**max_depth`` slots: 1 TB of different text in buckets of 1 MB. Beyond that buckets grow, which owners
   don't mind, as they read their entries as a stream and hold one chain at a time.
3. Owner tasks get the entries of whole buckets, sorted by key, chain what shares a key, compare bytes, and write the
   index: bucket, key, place in the chain, digest, number of rows, and the row that stays.
4. The small rows meet the index by key and digest; Spark splits the partition of a hot key on the rows' side.

Defined cases: null counts as empty, and all texts without a sign beside white space are equal; among equal texts the one
with the most code points, then the smallest id stays (a null id is the largest); rows that repeat an id and a text are one
document, counted each, and stay or go together in ``dedup``, while ``extra`` leaves one row of each text; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, chunks, ids_of, integer_ids, materialize, partitions, text_bytes

CAPACITY = 1 << 20  # bytes of a bucket
MAX_DEPTH = 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ROWS = "doc_id long, row long, key long, n_points long, sha binary, body binary, n long, best_points long, best_id long, best_row long"
_CHUNK = 4 << 20


def _chained(ids: np.ndarray, own: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    """The small rows of some documents; the first of each different text also carries the entry."""
    n = len(ids)
    count = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
    points = count((data & 0xC0) != 0x80)
    keep = ~_SPACE[data]
    off = np.concatenate([[0], np.cumsum(keep)])[offsets]
    data = data[keep]
    view, bounds = data.tobytes(), off.tolist()
    digests = [hashlib.sha256(view[a:z]).digest() for a, z in zip(bounds[:-1], bounds[1:])]
    keys = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 4)[:, 0].astype(np.int64)
    chains: dict[int, list[int]] = {}
    total, best, first = np.zeros(n, np.int64), np.arange(n), np.zeros(n, bool)
    for i, key in enumerate(keys.tolist()):
        body = view[bounds[i] : bounds[i + 1]]
        chain = chains.setdefault(key, [])
        for j in chain:
            if view[bounds[j] : bounds[j + 1]] == body:
                break
        else:
            chain.append(j := i)
            first[i] = True
        total[j] += 1
        b = best[j]
        if (-points[i], ids[i], own[i]) < (-points[b], ids[b], own[b]):
            best[j] = i
    bodies = [view[bounds[i] : bounds[i + 1]] for i in range(n)]
    sha = pa.array(digests, pa.binary())
    blank = ~first
    at = best[np.arange(n)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids), pa.array(own), pa.array(keys), pa.array(points.astype(np.int64)), sha,
            pa.array([b if f else None for b, f in zip(bodies, first.tolist())], pa.binary()),
            pa.array(total, mask=blank), pa.array(points[at].astype(np.int64), mask=blank), pa.array(ids[at], mask=blank), pa.array(own[at], mask=blank),
        ],
        names=["doc_id", "row", "key", "n_points", "sha", "body", "n", "best_points", "best_id", "best_row"],
    )


def keyed(docs: DataFrame, row: str | None = None) -> DataFrame:
    own = F.col(row) if row else F.lit(0).cast("long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, own, (data, off) = ids_of(batch.column(0)), ids_of(batch.column(2)), text_bytes(batch.column(1))
            for i, j in chunks(off, _CHUNK):
                yield _chained(ids[i:j], own[i:j], data[off[i] : off[j]], off[i : j + 1] - off[i])

    return docs.select("doc_id", "text", own.alias("row")).mapInArrow(run, _ROWS)


def directory(prefix_bytes: dict[int, int], depth: int, capacity: int = CAPACITY) -> np.ndarray:
    """Slot -> bucket. ``prefix_bytes``: bytes under each prefix of ``depth`` bits. The directory doubles while a bucket
    that its own depth still lets split holds more than ``capacity``; both halves of a split bucket get their own slots."""
    held = np.zeros(1 << depth, np.int64)
    held[np.fromiter(prefix_bytes.keys(), np.int64, len(prefix_bytes))] = np.fromiter(prefix_bytes.values(), np.int64, len(prefix_bytes))
    slots, d = np.zeros(1, np.int64), 0  # the one bucket
    while d < depth:
        size = held.reshape(1 << d, -1).sum(1)
        over = np.bincount(slots, size) > capacity
        whole = np.bincount(slots) == 1  # buckets whose own depth is the directory's
        if not (over & whole).any():
            break
        slots, d = np.repeat(slots, 2), d + 1
        upper = (np.arange(len(slots)) % 2 == 1) & over[slots] & whole[slots]
        slots = np.unique(2 * slots + upper, return_inverse=True)[1]
    return slots


def _prefix(depth: int):
    return F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")


def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries sorted by bucket and key -> the index. The chain of a key goes on over the ends of batches."""
    names = ["bucket", "key", "place", "sha", "n", "keep_points", "keep_id", "keep_row"]
    out: list[list] = []
    chain: list[list] = []
    at = None

    def flush() -> None:
        for place, (_, sha, n, points, doc, row) in enumerate(chain):
            out.append([*at, place, sha, n, -points, doc, row])
        chain.clear()

    for batch in batches:
        for bucket, key, body, sha, n, points, doc, row in zip(*(c.to_pylist() for c in batch.columns)):
            if (bucket, key) != at:
                flush()
                at = (bucket, key)
            for link in chain:
                if link[0] == body:
                    link[2] += n
                    link[3:] = min(link[3:], [-points, doc, row])
                    break
            else:
                chain.append([body, sha, n, -points, doc, row])
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=_INDEX)
            out = []
    flush()
    if out:
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=_INDEX)


_INDEX = pa.schema([("bucket", pa.int32()), ("key", pa.int64()), ("place", pa.int32()), ("sha", pa.binary()), ("n", pa.int64()), ("keep_points", pa.int64()), ("keep_id", pa.int64()), ("keep_row", pa.int64())])


def build_index(rows: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The index of what ``keyed`` gave, as a table of shared files: one row for each different text."""
    spark = rows.sparkSession
    entries = rows.filter(F.col("body").isNotNull())
    total = entries.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    max_depth = min(max_depth, max(0, (2 * total // capacity).bit_length()) + 2)
    held = entries.groupBy(_prefix(max_depth).alias("p")).agg(F.sum(F.octet_length("body")).alias("b"))
    held = held.toPandas()  # at most 2**max_depth rows of two numbers
    slots = directory(dict(zip(held["p"].tolist(), held["b"].tolist())), max_depth, capacity)
    depth = len(slots).bit_length() - 1
    slot_table = spark.createDataFrame(pd.DataFrame({"slot": np.arange(len(slots)), "bucket": slots.astype(np.int32)}))  # a few MB at most
    dealt = (
        entries.withColumn("slot", _prefix(depth))
        .join(F.broadcast(slot_table), "slot")
        .select("bucket", "key", "body", "sha", "n", "best_points", "best_id", "best_row")
        .repartition(max(partitions(spark), 1), "bucket")
        .sortWithinPartitions("bucket", "key")
    )
    schema = "bucket int, key long, place int, sha binary, n long, keep_points long, keep_id long, keep_row long"
    return materialize(dealt.mapInArrow(_owners, schema), "exact-index")


def dedup(docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256 (see the contract of op6)."""
    rows = materialize(keyed(integer_ids(docs)), "exact-keys")
    index = build_index(rows, capacity, max_depth)
    back = lambda c: F.when(c == int(NULL_ID), None).otherwise(c)
    found = rows.select("doc_id", "key", "sha").join(index.select("key", "sha", "n", "keep_id"), ["key", "sha"])
    return found.select(
        back(F.col("doc_id")).alias("doc_id"),
        back(F.col("keep_id")).alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("doc_id") == F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def extra(docs: DataFrame, row: str) -> DataFrame:
    """``row`` of all rows but one of each text: among equals the one that ``dedup`` keeps, then the least key stays."""
    rows = materialize(keyed(docs, row), "exact-keys")
    found = rows.select("row", "key", "sha").join(build_index(rows).select("key", "sha", "keep_row"), ["key", "sha"])
    return found.filter("row <> keep_row").select(F.col("row").alias(row))
