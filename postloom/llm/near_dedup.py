"""MinHash near-dedup with circulant signatures.

A document is the set of its distinct word shingles. Two fixed permutations of 32-bit words make every coordinate of the
signature: coordinate k is the least value over the set of ``second((first(x) + k) mod 2**32)``, that is the second
permutation, shifted circularly by k places. Bands of the signature give candidates; links are confirmed on full sets.

1. One pass over the texts: size of the set, SHA-256 of the word sequence, and one word for each band.
2. Documents of one word sequence become one class, named by the row of its smallest id; only classes go on. So exact copies,
   however many, cost one row. Different sequences with equal sets share all bands and are compared like any others.
3. Classes that share a band meet in a bucket. Each bucket's pivot is the member with the most company in all its buckets
   (for a group of near copies mostly their original), and all members of a pivot's buckets are the pivot's group. First
   each class is compared with its best pivot only, and links are joined to components: so a large group of near copies
   costs one comparison a member.
4. A group whose members all have one component is done. In the others, members outside the group's largest component
   (the strays) are compared with all members of other components, in blocks of strays by blocks of members: a task
   gets two blocks of bounded size and finds all their intersections by one product of incidence matrices. It returns
   links only. So each pair that shares a band is compared, or connected already.
   Only members whose sizes allow the similarity meet: classes of sizes fall into length bands, and a stray's band meets
   itself and its two neighbours.
5. A comparison reads both whole texts and numbers their words and shingles exactly (equal numbers, equal bytes); hashes
   decide on candidates only. A pivot of very many members is compared by many tasks (salts, then blocks).

Bands: with 28 bands of 6 rows a pair of similarity 0.85 is missed with probability 2e-6, and with 40 bands of 5 rows one
of 0.8 with 1e-7; a pair of similarity 0.1 becomes a candidate with probability 3e-5 and 4e-4.

A worker holds a text a few times over (its words, shingles and their hashes: about 100 bytes a word), so the longest text
sets its memory. doc_id is an integer.

Defined cases: a document without words has an empty set, belongs to no class and keeps itself; with fewer words than a
shingle has, the whole sequence is the one shingle; rows are told apart by a key of their own, so of rows that
repeat an id, or have none, each is in the class of its own text and one of a component is kept; a null id is larger than any
other; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import NULL_ID, chunks, coded_words, distinct, hash_words, ids_of, integer_ids, materialize, mix, numbered, partitions, ranges, text_bytes
from .components import components

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_CHUNK = 2 << 20
_BLOCK = 1 << 16  # shingles, about, of a block of strays or members
_BLOCK_ROWS = 256  # rows, about, of such a block
_BYTES = 64  # bytes of text that weigh as much as a shingle, so a block has 4 MB at most, or one text
_SALT_ROWS = 256  # comparisons of one pivot that go to one task


@dataclass(frozen=True)
class Settings:
    words: int = 5  # of a shingle
    percent: int = 80  # least similarity, in hundredths
    bands: int = 40
    rows: int = 5


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers, offsets, hashes): for each text its distinct shingles as sorted numbers, and the 64-bit hash of each number.
    Among these texts equal numbers mean equal words; elsewhere only hashes can be compared."""
    n = len(offsets) - 1
    code, held, first = coded_words(_LOWER[data], offsets, ~_SPACE)
    count = np.diff(first)
    number = np.where(count < words, count > 0, count - words + 1)
    doc, at = np.repeat(np.arange(n), number), ranges(first[:-1], number)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64), np.zeros(0, np.uint64)
    size, code = np.minimum(count, words)[doc], np.append(code, np.zeros(words, np.int64))
    base = len(held) + 1  # 0: no such word
    kind, kinds = code[at] + 1, base
    for k in range(1, words):
        if kinds * base >= 1 << 62:
            seen, kind = np.unique(kind, return_inverse=True)
            kinds = len(seen)
        kind, kinds = kind * base + np.where(k < size, code[at + k] + 1, 0), kinds * base
    seen, where, kind = np.unique(kind, return_index=True, return_inverse=True)
    own = distinct(doc * len(seen) + kind)
    word = hash_words(held)
    at, size = at[where], size[where]
    hashes = mix(size.astype(np.uint64))
    for k in range(words):
        hashes = np.where(k < size, mix(hashes * np.uint64(0x9E3779B97F4A7C15) + word[code[at + k]]), hashes)
    return own % len(seen), np.searchsorted(own, np.arange(n + 1) * len(seen)), hashes


def sequences(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """SHA-256 of each text's words in lower case with one space between them."""
    data = _LOWER[data]
    space = _SPACE[data]
    keep = ~space
    keep[1:] |= ~space[:-1]  # the first space after a word; one that begins a text is stripped
    off = np.concatenate([[0], np.cumsum(keep)])[offsets].tolist()
    plain = np.where(space, np.uint8(0x20), data)[keep].tobytes()
    return [hashlib.sha256(plain[a:z].strip(b" ")).digest() for a, z in zip(off[:-1], off[1:])]


def _permuted(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A fixed permutation of 32-bit words, in place."""
    x *= np.uint32(a)
    x ^= x >> np.uint32(15)
    x *= np.uint32(b)
    x ^= x >> np.uint32(13)
    return x


def signature(s: np.ndarray, size: int) -> np.ndarray:
    """The circulant signature of a set of 64-bit words."""
    low = _permuted((s ^ (s >> np.uint64(32))).astype(np.uint32), 0x85EBCA6B, 0xC2B2AE35)
    out = np.empty(size, np.uint32)
    step = max(1, min(size, (1 << 15) // len(low)))
    for k in range(0, size, step):
        shifts = np.arange(k, min(k + step, size), dtype=np.uint32)
        out[k : k + len(shifts)] = _permuted(low[None, :] + shifts[:, None], 0x27D4EB2D, 0x165667B1).min(1)
    return out


def _signed(s: Settings):
    weights = mix(np.arange(1, s.rows + 1, dtype=np.uint64)) | np.uint64(1)
    size = s.bands * s.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, (data, off), own_rows = ids_of(batch.column(0)), text_bytes(batch.column(1)), batch.column(2)
            for i, j in chunks(off, _CHUNK):
                part, n = (data[off[i] : off[j]], off[i : j + 1] - off[i]), j - i
                kinds, at, hashes = shingles(*part, s.words)
                bands = np.zeros((n, s.bands), np.uint64)
                for k in np.flatnonzero(np.diff(at)).tolist():
                    sig = signature(hashes[kinds[at[k] : at[k + 1]]], size).astype(np.uint64)
                    bands[k] = mix((sig.reshape(s.bands, s.rows) * weights).sum(1))
                listed = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * s.bands), pa.array(bands.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[i:j]), own_rows.slice(i, n), pa.array(np.diff(at)), pa.array(sequences(*part), pa.binary()), listed],
                    names=["doc_id", "row", "n", "sha", "bands"],
                )

    return run


def _links(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _compared(s: Settings):
    """Rows (pivot, salt, other, text), each pivot's own row first -> the links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, head = None, np.zeros(0, np.uint8)
        for batch in batches:
            pivots, others = batch.column(0).to_numpy(), batch.column(2).to_pylist()
            data, off = text_bytes(batch.column(3))
            a, b = [], []
            for i, j in chunks(off, _CHUNK):
                # the pivot that is open comes along, so its shingles are numbered with the others'
                kinds, at, _ = shingles(np.concatenate([head, data[off[i] : off[j]]]), np.concatenate([[0], off[i : j + 1] - off[i] + len(head)]), s.words)
                own = kinds[: at[1]]
                for k in range(i, j):
                    mine = kinds[at[k - i + 1] : at[k - i + 2]]
                    if others[k] is None:
                        pivot, own, head = int(pivots[k]), mine, data[off[k] : off[k + 1]]
                        continue
                    assert pivot == pivots[k], "a pivot's own text comes first"
                    common = len(np.intersect1d(own, mine, assume_unique=True))
                    union = len(own) + len(mine) - common
                    if 100 * common >= s.percent * union:
                        a.append(pivot)
                        b.append(others[k])
            yield _links(a, b)

    return run


def confirm(pairs: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """(a, b) of candidates -> the links: those whose full sets are similar enough."""
    n = partitions(pairs.sparkSession)
    rank = F.row_number().over(W.partitionBy("a", "part").orderBy("b")) - 1
    parts = F.pmod(F.xxhash64("b"), F.lit(64))  # a pivot's members are ranked in 64 parts, then cut into salts
    pairs = pairs.withColumn("part", parts).withColumn("salt", F.col("part") + 64 * F.floor(rank / _SALT_ROWS)).drop("part")
    pairs = materialize(pairs, "near-pairs")
    members = pairs.join(texts.withColumnRenamed("id", "b").hint("merge"), "b").select("a", "salt", "b", "text")
    heads = pairs.select("a", "salt").distinct().join(texts.withColumnRenamed("id", "a").hint("merge"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    dealt = members.unionByName(heads).repartition(n, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return materialize(dealt.mapInArrow(_compared(s), "a long, b long"), "near-links")


def classes(docs: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): row, doc_id, n, sha; and sha, n, bands of each different word sequence, doc_id (its smallest) and
    id (the row that has it, the first of several)."""
    signed = docs.select("doc_id", "text", "row").mapInArrow(_signed(s), "doc_id long, row long, n long, sha binary, bands array<long>")
    signed = materialize(signed, "near-signed")
    own = signed.filter("n > 0").groupBy("sha", "n").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    own = own.select("sha", "n", "first.doc_id", F.col("first.row").alias("id"))
    own = own.join(signed.filter("n > 0").select(F.col("row").alias("id"), "bands"), "id")
    return signed.select("row", "doc_id", "n", "sha"), materialize(own, "near-classes")


def linked(x: list[np.ndarray], y: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of ``x`` are similar enough to which of ``y``: a matrix of flags."""
    xs, ys = np.array([len(v) for v in x]), np.array([len(v) for v in y])
    kinds = np.intersect1d(np.concatenate(x), np.concatenate(y))

    def incidence(sets: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
        flat = np.concatenate(sets)
        at = np.minimum(np.searchsorted(kinds, flat), max(len(kinds) - 1, 0))
        hit = kinds[at] == flat if len(kinds) else np.zeros(len(flat), bool)
        out = np.zeros((len(sets), len(kinds)), np.float32)
        out[np.repeat(np.arange(len(sets)), sizes)[hit], at[hit]] = 1
        return out

    common = (incidence(x, xs) @ incidence(y, ys).T).astype(np.int64)
    return 100 * common >= percent * (xs[:, None] + ys[None, :] - common)


def _crossed(s: Settings):
    """Rows (a, size, i, j, stray, id, component, text), sorted by the first four -> links between strays and members that join
    the components which any of the block's links join: fewer than there are components. A block's rows are cut into parts of
    bounded size, so a product's matrices are small."""

    def parts(ids, components, sets):
        at, size = 0, 0
        for k in range(len(ids)):
            if k > at and (size + len(sets[k]) > _BLOCK or k - at >= _BLOCK_ROWS):
                yield ids[at:k], components[at:k], sets[at:k]
                at, size = k, 0
            size += len(sets[k])
        if len(ids) > at:
            yield ids[at:], components[at:], sets[at:]

    def crossed(rows: list[tuple]) -> pa.RecordBatch:
        a, b, above = [], [], {}

        def root(c: int) -> int:
            while above.get(c, c) != c:
                above[c] = c = above.get(above[c], above[c])
            return c

        data, off = text_bytes(pa.array([r[3] for r in rows], pa.string()))
        kinds, at, _ = shingles(data, off, s.words)
        sets = [kinds[x:z] for x, z in zip(at[:-1], at[1:])]
        sides = []
        for stray in (True, False):
            k = [n for n, r in enumerate(rows) if r[0] == stray]
            sides.append(list(parts(np.array([rows[n][1] for n in k]), np.array([rows[n][2] for n in k]), [sets[n] for n in k])))
        for ids, components, own in sides[0]:
            for ids2, components2, other in sides[1]:
                x, y = np.nonzero(linked(own, other, s.percent) & (components[:, None] != components2[None, :]))
                _, first = np.unique(np.stack([components[x], components2[y]]), axis=1, return_index=True)
                for k in first.tolist():
                    p, q = root(int(components[x[k]])), root(int(components2[y[k]]))
                    if p != q:
                        above[p] = q
                        a.append(int(ids[x[k]]))
                        b.append(int(ids2[y[k]]))
        return _links(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for batch in batches:
            for a, size, i, j, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and (a, size, i, j) != at:
                    yield crossed(rows)
                    rows = []
                at = (a, size, i, j)
                rows.append(tuple(row))
        if rows:
            yield crossed(rows)

    return run


def mixed_blocks(groups: DataFrame, labels: DataFrame, weights: DataFrame, s: Settings, rows: int) -> DataFrame:
    """(a, size, i, j, stray, id, component): groups (a, id, n) that hold several components, dealt to blocks of strays by blocks
    of members. ``weights`` (id, weight): what a row takes of a block's ``_BLOCK``; a block has about ``rows`` rows at most."""
    labelled = groups.join(labels.withColumnRenamed("v", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    held = labelled.groupBy("a", "component").agg(F.count("*").alias("c"))
    held = held.groupBy("a").agg(F.count("*").alias("components"), F.max(F.struct("c", "component")).alias("top"))
    held = held.filter("components > 1").select("a", F.col("top.component").alias("main"))
    held = materialize(held, "near-held")  # a table by itself, so that the join can split the rows of a hot pivot
    # sizes fall into bands; a pair that is similar enough lies in one band or in two neighbouring ones
    width = math.log(100 / s.percent) * (1 + 1e-9)
    mixed = labelled.join(held, "a").join(weights, "id").select(
        "a", "id", "component", (F.col("component") != F.col("main")).alias("stray"), "weight", F.floor(F.log("n") / width).alias("size")
    )
    mixed = materialize(mixed, "near-mixed")
    about = F.explode(F.sequence(F.col("size") - 1, F.col("size") + 1))
    strays = mixed.filter("stray").select("a", "id", "component", "weight", about.alias("size"))
    cut = lambda c: F.greatest(F.ceil(F.sum("weight") / _BLOCK), F.ceil(F.count("*") / rows)).cast("int").alias(c)
    blocks = mixed.groupBy("a", "size").agg(cut("members")).join(strays.groupBy("a", "size").agg(cut("strays")), ["a", "size"])
    blocks = materialize(blocks, "near-blocks")
    own = lambda by: F.pmod(F.xxhash64("id"), F.col(by)).cast("int")
    every = lambda by: F.explode(F.sequence(F.lit(0), F.col(by) - 1))
    cols = ["a", "size", "i", "j", "stray", "id", "component"]
    strays = strays.join(blocks, ["a", "size"]).select("a", "size", "id", "component", own("strays").alias("i"), F.lit(True).alias("stray"), every("members").alias("j"))
    members = mixed.join(blocks, ["a", "size"]).select("a", "size", "id", "component", own("members").alias("j"), F.lit(False).alias("stray"), every("strays").alias("i"))
    return strays.select(*cols).unionByName(members.select(*cols))


def strays(groups: DataFrame, labels: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """Links of groups (a, id, n) that hold several components. Blocks are bounded by shingles and by bytes of text."""
    sizes = groups.groupBy("id").agg(F.first("n").alias("n"))
    weights = texts.join(sizes, "id").select("id", F.greatest("n", F.ceil(F.octet_length("text") / _BYTES)).alias("weight"))
    dealt = mixed_blocks(groups, labels, weights, s, _BLOCK_ROWS).join(texts.hint("merge"), "id").select("a", "size", "i", "j", "stray", "id", "component", "text")
    dealt = dealt.repartition(partitions(groups.sparkSession), "a", "size", "i", "j").sortWithinPartitions("a", "size", "i", "j")
    return dealt.mapInArrow(_crossed(s), "a long, b long")


def _led(own: DataFrame, labels: DataFrame) -> DataFrame:
    """id, lead_id, lead: of each class in a component with others, the smallest doc_id in the component and its row."""
    roots = labels.select(F.col("component").alias("id"), "component").distinct()
    ends = labels.select("id", "component").unionByName(roots).join(own.select("id", "doc_id"), "id")
    ends = materialize(ends, "near-ends")  # a table by itself, so that the join can split the rows of a large component
    leads = ends.groupBy("component").agg(F.min(F.struct("doc_id", "id")).alias("p"))
    leads = leads.select("component", F.col("p.doc_id").alias("lead_id"), F.col("p.id").alias("lead"))
    return materialize(ends.join(leads, "component").select("id", "lead_id", "lead"), "near-leads")


def grouped(members: DataFrame, bucket: list[str], name: str) -> DataFrame:
    """Members (``bucket``, id, n) of buckets -> groups (a, id, n, na, ca, together): each bucket's pivot is the member with the
    most company; ``together``: the buckets that a member shares with the pivot."""
    shared = members.groupBy(*bucket).agg(F.count("*").alias("c")).filter("c > 1")
    company = F.sum("c").over(W.partitionBy("id"))  # a row a bucket
    members = members.join(shared, bucket).withColumn("company", company).drop("c")
    members = materialize(members, f"{name}-members")
    top = members.groupBy(*bucket).agg(F.max(F.struct("company", (-F.col("id")).alias("minus"), "n")).alias("p"))
    top = top.select(*bucket, (-F.col("p.minus")).alias("a"), F.col("p.n").alias("na"), F.col("p.company").alias("ca"))
    groups = members.join(top, bucket).groupBy("a", "id").agg(F.first("n").alias("n"), F.first("na").alias("na"), F.first("ca").alias("ca"), F.count("*").alias("together"))
    return materialize(groups, f"{name}-groups")


def best_pivots(groups: DataFrame, s: Settings) -> DataFrame:
    """(a, b): each member with the pivot that it shares most with, where their sizes allow the similarity."""
    best = groups.filter("a <> id").groupBy("id").agg(F.max_by(F.struct("a", "n", "na"), F.struct("together", "ca", "a")).alias("p"))
    fits = 100 * F.least("p.n", "p.na") >= s.percent * F.greatest("p.n", "p.na")
    return best.filter(fits).select(F.col("p.a").alias("a"), F.col("id").alias("b"))


def texts_of(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """(id, text) of the rows ``ids`` (id): a table."""
    texts = docs.select(F.col("row").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return materialize(texts.join(ids.select("id").distinct().hint("merge"), "id"), name)


def by_row(signed: DataFrame, own: DataFrame, labels: DataFrame, row: str | None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (and ``row``) of every row from the labels (id, component) of classes."""
    named = own.select("sha", "id", "doc_id").join(_led(own, labels), "id", "left")
    named = named.select("sha", F.coalesce("lead_id", "doc_id").alias("component_id"), F.coalesce("lead", "id").alias("lead"))
    filled = signed.filter("n > 0").join(named, "sha").select("row", "doc_id", "n", "component_id", "lead")
    empty = signed.filter("n = 0").select("row", "doc_id", "n", F.col("doc_id").alias("component_id"), F.col("row").alias("lead"))
    back = lambda c: F.when(c == int(NULL_ID), None).otherwise(c)
    return filled.unionByName(empty).select(
        *([F.col("row").alias(row)] if row else []),
        back(F.col("doc_id")).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        back(F.col("component_id")).alias("component_id"),
        (F.col("row") == F.col("lead")).alias("kept"),
    )


def near_dedup(docs: DataFrame, s: Settings = Settings(), row: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (see the contract of op10), and ``row`` where the caller has keys of rows."""
    docs = integer_ids(docs)
    docs = docs.select(F.col(row).alias("row"), "doc_id", "text") if row else numbered(docs.select("doc_id", "text"), "row", "near-rows")
    signed, own = classes(docs, s)
    groups = grouped(own.select("id", "n", F.posexplode("bands").alias("band", "value")), ["band", "value"], "near")
    texts = texts_of(docs, groups, "near-texts")
    links = confirm(best_pivots(groups, s), texts, s)
    labels = materialize(components(links), "near-labels")
    more = materialize(strays(groups.select("a", "id", "n"), labels, texts, s), "near-stray-links")
    if not more.isEmpty():
        labels = components(labels.select(F.col("v").alias("a"), F.col("component").alias("b")).unionByName(more))
    return by_row(signed, own, labels.withColumnRenamed("v", "id"), row)
