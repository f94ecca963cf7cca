"""Benchmark decontamination with a positional inverted index.

The index holds every word of the training texts: segments of documents, each with its different terms (their bytes) and
the places of each term. A segment is one row of a table of shared files, so the index is built without a shuffle and is
scanned in parallel. Test phrases are looked up segment by segment: the list of a phrase's rarest term, shifted by the
term's offset, is intersected with the other terms' shifted lists, rarest first, for many phrases at once. Terms meet by
their bytes, never by a hash. With ``slop`` each term may stand up to that many places from its own, counted from some start
(proximity match); 0 is the exact phrase.

Test items go to the tasks in blocks of at most ``block_bytes`` of text (an item is never cut), and tasks make the phrases:
a block of 4 MB has at most two million windows, 80 MB as numbers. A larger benchmark means more blocks, each against the
whole index.

Defined cases: a null or empty text has no words, and such an item has no window; repeated items count once;
a null item_id names no item, but the windows of its text are hits; repeated rows
of a document each have a result; an empty benchmark leaves everything clean; an empty table gives an empty result; other
columns are not looked at. doc_id is an integer. A worker holds one segment (a text longer than 4 MB is one) some ten times
over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, chunks, coded_words, distinct, ids_of, integer_ids, materialize, ranges, text_bytes

WINDOW = 10
GAP = 64  # free places between documents: more than any slop
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_CHUNK = 4 << 20
_INDEX = "ids binary, sizes binary, terms array<binary>, first binary, places binary"
_LIVE = 1 << 20  # starts of phrases, about, that are intersected at once


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(codes, terms, first): the words of each text in order, the different words, and the number of each text's first."""
    return coded_words(_LOWER[data], offsets, _WORD)


def build_index(docs: DataFrame, name: str = "text") -> DataFrame:
    """The positional index of all words: one row a segment of about 4 MB of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, (data, off) = ids_of(batch.column(0)), text_bytes(batch.column(1))
            for i, j in chunks(off, _CHUNK):
                word, held, first = terms(data[off[i] : off[j]], off[i : j + 1] - off[i])
                sizes = np.diff(first)
                place = np.arange(len(word)) + np.repeat(GAP * np.arange(j - i), sizes)
                order = np.argsort(word, kind="stable")
                head = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(held)))])
                parts = [pa.array([p.tobytes()], pa.binary()) for p in (ids[i:j], sizes, head.astype(np.uint32), place[order].astype(np.uint32))]
                listed = pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held.cast(pa.binary()))
                yield pa.RecordBatch.from_arrays([*parts[:2], listed, *parts[2:]], names=["ids", "sizes", "terms", "first", "places"])

    return materialize(docs.select("doc_id", name).mapInArrow(run, _INDEX), "word-index")


class Phrases:
    """Windows of test items: of each its terms and the item that holds it."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.names = [name for name, _ in items]
        word, self.terms, first = terms(*text_bytes(pa.array([t for _, t in items], pa.large_string())))
        count = np.diff(first)
        number = np.where(count < window, count > 0, count - window + 1)
        self.item = np.repeat(np.arange(len(items)), number)
        self.size = np.minimum(count, window)[self.item]
        at = ranges(first[:-1], number)[:, None] + np.arange(window)
        word = np.append(word, np.zeros(window, np.int64)).astype(np.int32)
        self.matrix = np.where(np.arange(window) < self.size[:, None], word[at], np.int32(-1))


def matches(phrases: Phrases, own: pa.Array, first: np.ndarray, places: np.ndarray, slop: int = 0) -> Iterator[tuple[np.ndarray, ...]]:
    """(phrase numbers, start places, a place of a term): the phrases that occur in a segment of the terms ``own``."""
    if not len(own) or not len(phrases.matrix):
        return
    at = pc.index_in(phrases.terms.cast(pa.binary()), own).fill_null(-1).to_numpy().astype(np.int64)
    first = first.astype(np.int64)
    count = np.where(at >= 0, first[at + 1] - first[at], 0)
    none = np.iinfo(np.int64).max
    held = np.where(phrases.matrix >= 0, count[phrases.matrix], none)
    there = np.flatnonzero(held.min(1) > 0)
    held = held[there]
    by_rarity = np.argsort(held, axis=1, kind="stable")
    rarest = held.min(1)
    # the lists one after the other, as one sorted array: a list is found by its term, a place in it by bisection
    span = int(places.max(initial=0)) + phrases.matrix.shape[1] + 2 * slop + 2
    lists = np.repeat(np.arange(len(first) - 1), np.diff(first)) * span + places
    upto = np.concatenate([[0], np.cumsum(rarest)])
    a = 0
    while a < len(there):
        z = max(a + 1, int(np.searchsorted(upto, upto[a] + _LIVE, "right")) - 1)
        row = np.repeat(np.arange(a, z), rarest[a:z])
        where = places[ranges(first[at[phrases.matrix[there[a:z], by_rarity[a:z, 0]]]], rarest[a:z])].astype(np.int64)
        start = where - by_rarity[row, 0]
        if slop:
            row, where = np.repeat(row, 2 * slop + 1), np.repeat(where, 2 * slop + 1)
            start = (start[:, None] + np.arange(-slop, slop + 1)).reshape(-1)
        for k in range(1, phrases.matrix.shape[1]):
            offset = by_rarity[row, k]
            code = phrases.matrix[there[row], offset]
            term = at[code]
            low = np.maximum(start + offset - slop, 0)
            want = term * span + low
            near = lists[np.minimum(np.searchsorted(lists, want), len(lists) - 1)]
            ok = (near >= want) & (near <= term * span + start + offset + slop) | (code < 0)
            row, start, where = row[ok], start[ok], where[ok]
        if len(row):
            yield there[row], start, where
        a = z


def _searched(items: list[tuple[str | None, str | None]], window: int, slop: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(items, window)
        for batch in batches:
            for n in range(batch.num_rows):
                row = {c: batch.column(c)[n] for c in batch.schema.names}
                ids, sizes, first, places = (np.frombuffer(row[c].as_py(), t) for c, t in (("ids", np.int64), ("sizes", np.int64), ("first", np.uint32), ("places", np.uint32)))
                base = np.cumsum(sizes + GAP) - (sizes + GAP)
                hit = np.zeros(int((sizes + GAP).sum()) + window + 1, np.int64)
                held = [np.zeros(0, np.int64)]
                for phrase, start, where in matches(phrases, row["terms"].values, first, places, slop):
                    np.add.at(hit, np.maximum(start, 0), 1)
                    np.subtract.at(hit, np.maximum(start + phrases.size[phrase], 0), 1)
                    held.append(distinct((np.searchsorted(base, where, "right") - 1) * len(items) + phrases.item[phrase]))
                hits = np.flatnonzero(np.cumsum(hit) > 0)
                lo, hi = np.searchsorted(hits, base), np.searchsorted(hits, base + sizes)
                listed = [(hits[lo[d] : hi[d]] - base[d]).tolist() if hi[d] > lo[d] else [] for d in range(len(ids))]
                names: list[set[str]] = [set() for _ in range(len(ids))]
                for pair in distinct(np.concatenate(held)).tolist():
                    if (name := phrases.names[pair % len(items)]) is not None:
                        names[pair // len(items)].add(name)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.array(sizes), pa.array(listed, pa.list_(pa.int64())), pa.array([sorted(x) for x in names], pa.list_(pa.string()))],
                    names=["doc_id", "n_words", "hits", "items"],
                )

    return run


def search(index: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0, block_bytes: int = 4 << 20) -> DataFrame:
    """Of each document: doc_id, n_words, hits (places of the words in matches), items (ids whose windows occur)."""
    if not 0 <= slop < GAP // 2:
        raise ValueError(f"slop must be less than {GAP // 2}, or a match could reach into the next document")
    items = items.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    schema = "doc_id long, n_words long, hits array<long>, items array<string>"
    found = None
    for k in range(n):
        rows = [(r.item_id, r.text) for r in dealt.filter(F.col("block") == k).collect()]  # about block_bytes
        part = index.mapInArrow(_searched(sorted(rows, key=lambda r: (r[0] or "", r[1])), window, slop), schema)
        if n > 1:  # documents keep their place in the index: segment and number
            part = materialize(part.withColumn("at", F.monotonically_increasing_id()), "phrase-hits")
        found = part if found is None else found.unionByName(part)
    if n > 1:
        both = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
        found = found.groupBy("at").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), both("hits").alias("hits"), both("items").alias("items"))
    return found.select(F.when(F.col("doc_id") == int(NULL_ID), None).otherwise(F.col("doc_id")).alias("doc_id"), "n_words", "hits", "items")


def op8_decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The contract of op8: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = search(build_index(integer_ids(docs)), items)
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )
