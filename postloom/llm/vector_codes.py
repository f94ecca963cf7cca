"""Vector code compression: product codes with exact integer arithmetic.

A vector becomes integers (floor of ``SCALE`` times each component) and is cut into ``parts`` equal parts; each part position has
a codebook of its own, and a vector's code is the number of the nearest entry for each part. Codebooks are refined in rounds:
every part goes to its nearest entry, every entry becomes the floor of the mean of its parts.

1. One pass makes *flat blocks*: the vectors of an Arrow batch are sorted, for each part position by itself, along a Hilbert curve
   over the part's components, and cut into blocks of ``BLOCK`` parts. A block stores its least and greatest values (a box), its
   sums, and the integers. Blocks are a table in the shared folder. Sorting within batches needs no shuffle, and equal vectors
   of a batch, however many, are one point of a box.
2. Each round, the distances of a block's box give its shortlist: an entry whose least distance to the box is more than
   another's greatest distance cannot be nearest to any part in it. With one entry left the block's stored sums are taken as
   they are; else a small kernel of 64-bit integers compares the shortlist's entries, in order, so ties go to the lower number.
   A task returns one row for each component of the codebooks; these are added up by Spark, and the new codebooks (``ENTRIES``
   times the vector's length, whatever the input) come to the driver.
3. The last assignment makes blocks of the vectors anew, batch by batch, so codes meet their ids without a shuffle.

Vectors are never shuffled; only sums and, for the errors of labels, partial sums are.

Defined cases: rows whose vector is null, or holds a null, NaN or infinite component, are dropped; vectors shorter than the
longest kept one count as filled up with zeros, and all as filled up to a multiple of ``parts`` (so an empty vector is one of
zeros); with fewer kept vectors than entries a codebook has as many as there are vectors; repeated rows count each, and
the first entries are taken in the order of vec_id (null last), then vector; labels that are null belong together; an empty table
gives an empty result; integers so large that a squared distance might pass 63 bits are refused with an error; other columns are
not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
BLOCK = 64  # parts of a block
_BATCH = 1 << 14  # vectors that are sorted together, at most


# ---- vectors --------------------------------------------------------------------------------------------------------


def integers(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, values): the numbers of the kept rows and their integers, filled up with zeros to ``width``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.asarray(column.value_lengths().fill_null(0), np.int64)
    flat = column.flatten()
    x = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    row, ends = np.repeat(np.arange(len(column)), sizes), np.cumsum(sizes)
    bad = np.bincount(row[~np.isfinite(x)], minlength=len(column)) > 0
    rows = np.flatnonzero(np.asarray(column.is_valid()) & ~bad)
    with np.errstate(invalid="ignore", over="ignore"):
        whole = np.floor(x * SCALE)
    live = ~bad[row]
    out = np.zeros((len(column), width), np.int64)
    if live.any():
        limit = np.sqrt(2.0**62 / max(width, 1)) / 2
        if np.abs(whole[live]).max() > limit:
            raise ValueError(f"components beyond {limit / SCALE:.6g}: squared distances would pass 63 bits")
        out[row[live], (np.arange(len(x)) - (ends - sizes)[row])[live]] = whole[live]
    return rows, out[rows]


def longest(vectors: DataFrame, column: str, parts: int) -> int:
    """The length of the longest kept vector, up to a multiple of ``parts``, which is the least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = 0
        for batch in batches:
            sizes = np.asarray(batch.column(0).value_lengths().fill_null(0), np.int64)
            if sizes.max(initial=0) > most:
                rows, _ = integers(batch.column(0), int(sizes.max()))
                most = max(most, int(sizes[rows].max(initial=0)))
        yield pa.RecordBatch.from_arrays([pa.array([most])], names=["n"])

    most = vectors.select(column).mapInArrow(run, "n long").agg(F.max("n")).first()[0] or 0
    return max(1, -(-most // parts)) * parts


def first_entries(vectors: DataFrame, key: str, column: str, width: int, parts: int, entries: int) -> np.ndarray:
    """[parts, entries, width / parts]: the parts of the first kept vectors by ``key``; each task brings its own first ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, values = integers(batch.column(1), width)
            ids = batch.column(0).take(pa.array(rows)).cast(pa.int64())
            null, number = np.asarray(ids.is_null()), ids.fill_null(0).to_numpy(zero_copy_only=False)
            first = np.lexsort([*values.T[::-1], number, null])[:entries]
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1, dtype=np.int32) * width), pa.array(values[first].reshape(-1)))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(first)), listed], names=["id", "v"])

    found = vectors.select(key, column).mapInArrow(run, "id long, v array<long>").orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()
    return np.array([r.v for r in found], np.int64).reshape(len(found), parts, width // parts).transpose(1, 0, 2)


# ---- blocks ---------------------------------------------------------------------------------------------------------


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Ranks along a Hilbert curve: the points' order by their place on the curve through ``bits`` bits a dimension.

    The coordinates are rotated and mirrored level by level into the transposed index (Skilling 2004), whose bits, the highest
    of each dimension first, are the key.
    """
    x = points.astype(np.uint64).copy()
    n, dims = x.shape
    if not dims:
        return np.arange(n)
    q = 1 << (bits - 1)
    while q > 1:
        low = np.uint64(q - 1)
        for d in range(dims):
            high = (x[:, d] & np.uint64(q)) != 0
            swap = np.where(high, np.uint64(0), (x[:, 0] ^ x[:, d]) & low)
            x[:, 0] = np.where(high, x[:, 0] ^ low, x[:, 0] ^ swap)
            x[:, d] ^= swap
        q >>= 1
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    turn = np.zeros(n, np.uint64)
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[:, dims - 1] & np.uint64(q)) != 0, np.uint64(q - 1), np.uint64(0))
        q >>= 1
    x ^= turn[:, None]
    keys = []  # 64 bits of the key each, the first ones first
    word, held = np.zeros(n, np.uint64), 0
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            word, held = (word << np.uint64(1)) | ((x[:, d] >> np.uint64(b)) & np.uint64(1)), held + 1
            if held == 64:
                keys.append(word)
                word, held = np.zeros(n, np.uint64), 0
    return np.lexsort([word, *keys[::-1]])


class Blocks:
    """Flat blocks of one part position: ``order`` (rows along the curve), ``points`` [blocks, BLOCK, width] (the last block is
    filled up with its last point), ``counts``, ``low``, ``high`` and ``sums``."""

    def __init__(self, points: np.ndarray, counts: np.ndarray, order: np.ndarray | None = None):
        self.points, self.counts, self.order = points, counts, order
        self.low, self.high = points.min(1), points.max(1)
        spare = BLOCK - counts
        self.sums = points.sum(1) - points[:, -1] * spare[:, None]

    @classmethod
    def of(cls, values: np.ndarray) -> Blocks:
        n, width = values.shape
        low, span = (values.min(0), int(np.ptp(values, axis=0).max(initial=0))) if n else (0, 0)
        order = hilbert(values - low, max(1, span.bit_length()))
        at = np.minimum(np.arange(-(-n // BLOCK) * BLOCK), n - 1)
        return cls(values[order][at].reshape(-1, BLOCK, width), np.minimum(BLOCK, n - np.arange(0, n, BLOCK)), order)

    def shortlists(self, entries: np.ndarray) -> np.ndarray:
        """[blocks, entries] flags: the entries that may be nearest to a part of the block, by distances to its box."""
        e, low, high = entries[None], self.low[:, None], self.high[:, None]
        least = (np.maximum(np.maximum(low - e, e - high), 0) ** 2).sum(2)
        most = (np.maximum(np.abs(e - low), np.abs(high - e)) ** 2).sum(2)
        return least <= most.min(1, keepdims=True)

    def nearest(self, entries: np.ndarray, listed: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, errors) [blocks, BLOCK] of the chosen blocks: their shortlists' entries compared in order."""
        points = self.points[blocks]
        size = listed[blocks].sum(1)
        turn = np.argsort(~listed[blocks], axis=1, kind="stable")  # a block's entries, in order, then the others
        codes = np.zeros(points.shape[:2], np.int64)
        errors = np.full(points.shape[:2], np.iinfo(np.int64).max)
        for k in range(int(size.max(initial=0))):
            live = np.flatnonzero(size > k)
            entry = turn[live, k]
            found = ((points[live] - entries[entry][:, None]) ** 2).sum(2)
            better = found < errors[live]
            errors[live] = np.where(better, found, errors[live])
            codes[live] = np.where(better, entry[:, None], codes[live])
        return codes, errors


def _blocked(width: int, parts: int):
    """Vectors -> blocks (part, count, points)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, _BATCH):
                _, values = integers(batch.column(0).slice(i, _BATCH), width)
                if not len(values):
                    continue
                for part, own in enumerate(np.split(values, parts, axis=1)):
                    b = Blocks.of(own)
                    points = pa.array([p.astype("<i4").tobytes() for p in b.points], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.counts), part, np.int32)), pa.array(b.counts.astype(np.int32)), points,
                                                      *(_longs(x) for x in (b.low, b.high, b.sums))], names=["part", "count", "points", "low", "high", "sums"])

    return run


def _longs(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1).astype(np.int64)))


def _stored(batch: pa.RecordBatch, rows: np.ndarray, width: int) -> Blocks:
    """Blocks of one part position as they are stored, with their stored boxes and sums."""
    b = Blocks.__new__(Blocks)
    take = lambda k: batch.column(k).take(pa.array(rows))
    b.counts, b.order = take(1).to_numpy().astype(np.int64), None
    b.points = np.frombuffer(b"".join(take(2).to_pylist()), "<i4").astype(np.int64).reshape(len(rows), BLOCK, width)
    b.low, b.high, b.sums = (take(k).flatten().to_numpy().reshape(len(rows), width) for k in (3, 4, 5))
    return b


def _summed(codebooks: np.ndarray):
    """Blocks -> (part, entry, at, total): what each entry's parts add up to, by component; ``at`` = width: their number."""
    parts, entries, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            of = batch.column(0).to_numpy()
            for part in np.unique(of).tolist():
                b = _stored(batch, np.flatnonzero(of == part), width)
                listed = b.shortlists(codebooks[part])
                alone = listed.sum(1) == 1
                np.add.at(total[part], listed[alone].argmax(1), np.column_stack([b.sums, b.counts])[alone])
                mixed = np.flatnonzero(~alone)
                codes, _ = b.nearest(codebooks[part], listed, mixed)
                real = np.arange(BLOCK) < b.counts[mixed][:, None]
                points = b.points[mixed][real]
                np.add.at(total[part], codes[real], np.column_stack([points, np.ones(len(points), np.int64)]))
        part, entry, at = np.indices(total.shape).reshape(3, -1)
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in (part, entry, at)] + [pa.array(total.reshape(-1))], names=["part", "entry", "at", "total"])

    return run


def refined(blocks: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """The codebooks after one round. What comes to the driver is as large as the codebooks."""
    sums = blocks.mapInArrow(_summed(codebooks), "part int, entry int, at int, total long").groupBy("part", "entry", "at").agg(F.sum("total").alias("total"))
    total = np.zeros((codebooks.shape[0], codebooks.shape[1], codebooks.shape[2] + 1), np.int64)
    for r in sums.collect():
        total[r.part, r.entry, r.at] = r.total
    count = total[:, :, -1:]
    return np.where(count > 0, total[:, :, :-1] // np.maximum(count, 1), codebooks)


def codebooks_of(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """[parts, entries, components]: the codebooks after ``rounds``."""
    width = longest(vectors, column, parts)
    codebooks = first_entries(vectors, key, column, width, parts, entries)
    if not codebooks.size:
        return codebooks
    blocks = vectors.select(column).mapInArrow(_blocked(width, parts), "part int, count int, points binary, low array<long>, high array<long>, sums array<long>")
    blocks = materialize(blocks, "vector-blocks")
    for _ in range(rounds):
        codebooks = refined(blocks, codebooks)
    return codebooks


def encoded(values: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes [n, parts], errors [n]) of integer vectors."""
    parts, entries, width = codebooks.shape
    codes, errors = np.zeros((len(values), parts), np.int64), np.zeros(len(values), np.int64)
    if not len(values) or not entries:
        return codes, errors
    for part, own in enumerate(values.reshape(len(values), parts, width).transpose(1, 0, 2)):
        b = Blocks.of(own)
        code, error = b.nearest(codebooks[part], b.shortlists(codebooks[part]), np.arange(len(b.counts)))
        codes[b.order, part] = code.reshape(-1)[: len(own)]
        errors[b.order] += error.reshape(-1)[: len(own)]
    return codes, errors


def encode(vectors: DataFrame, codebooks: np.ndarray, keep: list[str], column: str = "embedding") -> DataFrame:
    """``keep``'s columns, code (two hex digits a part) and error of each kept vector."""
    width, n = codebooks.shape[0] * codebooks.shape[2], len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, _BATCH):
                own = batch.slice(i, _BATCH)
                rows, values = integers(own.column(n), width)
                codes, errors = encoded(values, codebooks)
                text = pa.array([c.tobytes().hex() for c in codes.astype(np.uint8)], pa.string())
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows)) for c in own.columns[:n]), text, pa.array(errors)], names=[*keep, "code", "error"])

    picked = vectors.select(*keep, column)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:n])
    return picked.mapInArrow(run, f"{kinds}, code string, error long")


def op12_vector_codes(vectors: DataFrame) -> DataFrame:
    """The contract of op12: vec_id, code, error, label_error, codebooks_sha256."""
    codebooks = codebooks_of(vectors)
    digest = hashlib.sha256(",".join(map(str, codebooks.reshape(-1).tolist())).encode()).hexdigest()
    coded = materialize(encode(vectors, codebooks, ["vec_id", "label"]), "vector-codes")
    label = {"_null": F.col("label").isNull(), "_label": F.coalesce("label", F.lit(0))}
    labels = coded.withColumns(label).groupBy(*label).agg(F.sum("error").alias("label_error"))
    return coded.withColumns(label).join(labels, list(label)).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
