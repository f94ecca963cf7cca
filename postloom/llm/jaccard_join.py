"""N-gram Jaccard join: a size-aware join of small (light) and large (heavy) sets.

A document is the set of its distinct word shingles; two link when 100 * intersection >= percent * union. The join is exact: no
pair is left to chance. Sets of sizes n and m link just when they have ``overlap(n, m)`` shingles in common.

1. One pass over the texts numbers shingles and hashes them. Documents of one word sequence (SHA-256) are one class, and only
   classes go on.
2. *Inverted lists* (for pairs with a large set). The keys of the lists are segments: hashing deals a set's tokens to more
   segments than linked sets can have tokens that only one of them has, so linked sets agree in one segment at least, token by
   token. (Lists of single tokens, rarest first, were tried: unrelated sets met in ever more of them as the corpus grew.) The number
   of segments goes by classes of size, one factor of similarity wide; a set posts its segments for its own class and for the
   next smaller one, so any pair that may link posts the same division. There are some segments to spare, so blank ones
   need not be posted, but by sets that have more blank ones than that.
3. *Boundary.* The costs of both ways are known for each small size: the subsets that its sets have, and the list entries that
   their scans read. The boundary up to which sets are light is the one of least cost.
4. *Subsets* (for pairs of light sets). A light set gives all its subsets of ``overlap(n, m)`` tokens for each size m that it may
   link with. Sets that share one link, all of them with the smallest: a star, never all pairs.
5. Each list's pivot is its member with the most company. A class is compared with its best pivot first, and links are joined to
   components, so that many near copies cost a comparison each. In lists that hold several components the members outside
   the largest one are compared with all members of other components, in bounded blocks.
6. Comparisons first look at small bitmaps (the parity of tokens by hash): where they differ in more places than the sets may, no
   link is possible. What is left is confirmed on whole texts, by exact numbers of words and shingles.

The smallest sets and those of one length have bounded work; a list that a third of all documents are in meets its pivot in salted
tasks and itself in blocks. A worker holds a text a few times over, so the longest text sets its
memory. doc_id is an integer. Hashes have 63 bits and only propose; a pair could be missed only if two shingles of one light set
agreed in all of them.

Defined cases: a document without words (null too) has an empty set and links with nothing; with fewer words than a shingle has, the
whole sequence is the one shingle; rows are told apart by a key of their own, so rows that repeat an id, or have none, are each in
the class of their own text; a null id is larger than any other; an empty table gives an empty result; other columns are not
looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, distinct, ids_of, integer_ids, materialize, mix, numbered, partitions, text_bytes
from .components import components
from .near_dedup import Settings, best_pivots, by_row, confirm, grouped, mixed_blocks, sequences, shingles, strays, texts_of

MOST = 40  # the largest boundary
COMPARE = 16  # a comparison's cost, in subsets or list entries
ROWS = 1 << 11  # rows of a block of bitmaps, which is 512 kB at most
_CHUNK = 2 << 20


@dataclass(frozen=True)
class Join(Settings):
    words: int = 3
    percent: int = 90
    boundary: int | None = None  # None: by cost


def overlap(n, m, percent: int):
    """The least intersection of linked sets of sizes n and m."""
    return -(-percent * (n + m) // (100 + percent))


def size_class(n: int, percent: int) -> int:
    """Classes of size: sets that link are in one class or in two neighbouring ones."""
    return int(math.log(n) / _width(percent) + 1e-12)


def _width(percent: int) -> float:
    return math.log(100 / percent) * (1 + 1e-9)


@lru_cache(1 << 12)
def segments(c: int, percent: int) -> tuple[int, int]:
    """(segments, spare) of class ``c``: ``spare`` more, and one, than tokens that only one of two linked sets has, where the
    smaller one is of this class."""
    largest = math.ceil(math.exp((c + 1) * _width(percent)))
    differ = (100 - percent) * (largest + 100 * largest // percent) // (100 + percent)
    spare = differ // 10 + 1
    return differ + 1 + spare, spare


def sizes_with(n: int, percent: int) -> range:
    """The sizes of sets that one of size n may link with."""
    return range(-(-percent * n // 100), 100 * n // percent + 1)


# ---- segments and bitmaps -------------------------------------------------------------------------------------------


def postings(tokens: np.ndarray, n: int, percent: int) -> np.ndarray:
    """The keys of a set's lists: its segments for its class of size and for the next smaller one."""
    out, words = [], mix(tokens.astype(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15))
    for c in range(max(0, (own := size_class(n, percent)) - 1), own + 1):
        parts, spare = segments(c, percent)
        where = (tokens >> 8) % parts
        total = mix(np.arange(parts, dtype=np.uint64) + (np.uint64(c + 1) << np.uint64(40)))
        blank = np.bincount(where, minlength=parts) == 0
        np.add.at(total, where, words)
        out.append(mix(total if blank.sum() > spare else total[~blank]).view(np.int64))
    return np.concatenate(out)


def bitmap(tokens: np.ndarray, n: int) -> bytes:
    """Parity of the tokens by their low bits, in a power of two of bits, half of ``n`` at least."""
    width = 1 << max(8, (max(n, 1) - 1).bit_length() - 1)
    return np.packbits(np.bincount(tokens & (width - 1), minlength=width).astype(np.uint8) & 1, bitorder="little").tobytes()


def folded(bits: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, all as wide as the narrowest."""
    width = min(map(len, bits))
    return np.array([np.bitwise_xor.reduce(np.frombuffer(b, np.uint64).reshape(-1, width // 8), 0) for b in bits])


def _signed(s: Join):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, (data, off), own_rows = ids_of(batch.column(0)), text_bytes(batch.column(1)), batch.column(2)
            for i, j in chunks(off, _CHUNK):
                part, size = (data[off[i] : off[j]], off[i : j + 1] - off[i]), j - i
                kinds, at, hashes = shingles(*part, s.words)
                hashes = (hashes >> np.uint64(1)).astype(np.int64)
                small, posted, bits = [], [], []
                for k, n in enumerate(np.diff(at).tolist()):
                    tokens = distinct(hashes[kinds[at[k] : at[k + 1]]])
                    bits.append(bitmap(tokens, n))
                    small.append(tokens if n <= MOST else tokens[:0])
                    posted.append(postings(tokens, n, s.percent) if n else tokens)
                listed = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in xs])]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *xs]))) for xs in (small, posted)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[i:j]), own_rows.slice(i, size), pa.array(np.diff(at)), pa.array(sequences(*part), pa.binary()), *listed, pa.array(bits, pa.binary())],
                    names=["doc_id", "row", "n", "sha", "tokens", "posted", "bits"],
                )

    return run


def classes(docs: DataFrame, s: Join) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): row, doc_id, n, sha; and of each different word sequence sha, n, doc_id (its smallest), id (the row that
    has it), tokens (of small sets), posted (keys of its lists), bits."""
    signed = docs.select("doc_id", "text", "row").mapInArrow(_signed(s), "doc_id long, row long, n long, sha binary, tokens array<long>, posted array<long>, bits binary")
    signed = materialize(signed, "jaccard-signed")
    own = signed.filter("n > 0").groupBy("sha", "n").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    own = own.select("sha", "n", "first.doc_id", F.col("first.row").alias("id"))
    own = own.join(signed.filter("n > 0").select(F.col("row").alias("id"), "tokens", "posted", "bits"), "id")
    return signed.select("row", "doc_id", "n", "sha"), materialize(own, "jaccard-classes")


# ---- inverted lists -------------------------------------------------------------------------------------------------


def lists(own: DataFrame) -> DataFrame:
    """The inverted lists that have several members: segment, id, n, c (the list's length)."""
    posted = own.select("id", "n", F.explode("posted").alias("segment"))
    lengths = posted.groupBy("segment").agg(F.count("*").alias("c")).filter("c > 1")
    return materialize(posted.join(lengths, "segment"), "jaccard-lists")


# ---- subsets --------------------------------------------------------------------------------------------------------


def subsets_of(n: int, percent: int, most: int | None = None) -> int:
    """How many subsets a light set of size n has."""
    return sum(math.comb(n, overlap(n, m, percent)) for m in sizes_with(n, percent) if most is None or m <= most)


def boundary(own: DataFrame, listed: DataFrame, s: Join) -> int:
    """The size up to which sets are light, by cost. Two rows for each size up to ``MOST`` come to the driver."""
    sets = {r.n: r.c for r in own.filter(F.col("n") <= MOST).groupBy("n").agg(F.count("*").alias("c")).collect()}
    read = {r.n: r.c + COMPARE * r.k for r in listed.filter(F.col("n") <= MOST).groupBy("n").agg(F.sum("c").alias("c"), F.count_distinct("id").alias("k")).collect()}

    def cost(x: int) -> int:
        light = sum(c * subsets_of(n, s.percent, x) for n, c in sets.items() if n <= x)
        posts = lambda n: sum(segments(c, s.percent)[0] for c in range(max(0, size_class(n, s.percent) - 1), size_class(n, s.percent) + 1))
        return light + sum(c * posts(n) + read.get(n, 0) for n, c in sets.items() if n >= sizes_with(x + 1, s.percent)[0])

    return min(range(MOST + 1), key=cost)


@lru_cache
def _left_out(n: int, k: int) -> np.ndarray:
    return np.array(list(combinations(range(n), k)), np.int64).reshape(math.comb(n, k), k)


def _subsets(s: Join, most: int):
    """(id, n, tokens) of light sets -> (p, q, x, y, id, n): 128 bits for each subset that it may share with a set such that
    the smaller of the two has size p and the larger q."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, n, held in zip(*(batch.column(c).to_pylist() for c in range(3))):
                tokens = np.array(held, np.uint64)
                words = np.stack([mix(tokens), mix(tokens ^ np.uint64(0x9E3779B97F4A7C15))])
                total = words.sum(1)
                for m in sizes_with(n, s.percent):
                    if m > most:
                        break
                    out = _left_out(len(tokens), max(0, len(tokens) - overlap(n, m, s.percent)))
                    x, y = ((total[k] - words[k][out].sum(1)).view(np.int64) for k in (0, 1))
                    same = lambda v: pa.array(np.full(len(out), v, np.int64))
                    yield pa.RecordBatch.from_arrays([same(min(n, m)), same(max(n, m)), pa.array(x), pa.array(y), same(own), same(n)], names=["p", "q", "x", "y", "id", "n"])

    return run


def stars(own: DataFrame, s: Join, most: int) -> DataFrame:
    """(a, b): pairs of light sets with a common subset of the size that links them; ``a``: the smallest that has it."""
    key = ["p", "q", "x", "y"]
    held = own.filter(F.col("n") <= most).select("id", "n", "tokens").mapInArrow(_subsets(s, most), "p long, q long, x long, y long, id long, n long")
    held = materialize(held, "jaccard-subsets")
    lead = held.groupBy(*key).agg(F.min(F.struct("n", "id")).alias("lead"), F.count("*").alias("c")).filter("c > 1 AND lead.n = p")
    return held.join(lead.select(*key, F.col("lead.id").alias("a")), key).filter("a <> id").select("a", F.col("id").alias("b")).distinct()


# ---- bitmaps as a sieve ---------------------------------------------------------------------------------------------


def _far(n: np.ndarray, m: np.ndarray, differ: np.ndarray, percent: int) -> np.ndarray:
    return differ > n + m - 2 * overlap(n, m, percent)


def _sieved_pairs(s: Join):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in (2, 3))
            differ = np.zeros(len(n), np.int64)
            for k, pair in enumerate(zip(*(batch.column(c).to_pylist() for c in (4, 5)))):
                x, y = folded(list(pair))
                differ[k] = np.bitwise_count(x ^ y).sum()
            keep = pa.array(~_far(n, m, differ, s.percent))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in (0, 1)], names=["a", "b"])

    return run


def sieved(pairs: DataFrame, own: DataFrame, s: Join) -> DataFrame:
    """The pairs (a, b) whose bitmaps allow a link."""
    for side in ("a", "b"):
        pairs = pairs.join(own.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}")), side)
    return pairs.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(_sieved_pairs(s), "a long, b long")


def _sieved_blocks(s: Join):
    """Rows (a, size, i, j, stray, id, component, n, bits), sorted by the first four -> (a, id, n) of those that may link with a
    row of another component."""

    def crossed(a: int, rows: list[tuple]) -> pa.RecordBatch:
        bits, ids, component, n = folded([r[4] for r in rows]), *(np.array([r[k] for r in rows]) for k in (1, 2, 3))
        stray = np.array([r[0] for r in rows])
        hit = np.zeros(len(rows), bool)
        right = np.flatnonzero(~stray)
        for x in np.flatnonzero(stray).tolist():
            differ = np.bitwise_count(bits[right] ^ bits[x]).sum(1)
            fit = right[~_far(n[x], n[right], differ, s.percent) & (component[right] != component[x])]
            hit[fit] = True
            hit[x] |= len(fit) > 0
        return pa.RecordBatch.from_arrays([pa.array(np.full(hit.sum(), a)), pa.array(ids[hit]), pa.array(n[hit])], names=["a", "id", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for batch in batches:
            for a, size, i, j, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and (a, size, i, j) != at:
                    yield crossed(at[0], rows)
                    rows = []
                at = (a, size, i, j)
                rows.append(tuple(row))
        if rows:
            yield crossed(at[0], rows)

    return run


def sieved_groups(groups: DataFrame, labels: DataFrame, own: DataFrame, s: Join) -> DataFrame:
    """The members (a, id, n) of groups that may link with one of another component of their group."""
    weights = own.select("id", F.ceil((F.octet_length("bits") + 64) / 8).alias("weight"))
    dealt = mixed_blocks(groups, labels, weights, s, ROWS).join(own.select("id", "n", "bits").hint("merge"), "id")
    dealt = dealt.select("a", "size", "i", "j", "stray", "id", "component", "n", "bits").repartition(partitions(groups.sparkSession), "a", "size", "i", "j")
    return dealt.sortWithinPartitions("a", "size", "i", "j").mapInArrow(_sieved_blocks(s), "a long, id long, n long").distinct()


# ---- the join -------------------------------------------------------------------------------------------------------


def jaccard_join(docs: DataFrame, s: Join = Join()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: every document with the smallest doc_id that links reach from it."""
    docs = numbered(integer_ids(docs).select("doc_id", "text"), "row", "jaccard-rows")
    signed, own = classes(docs, s)
    listed = lists(own)
    most = boundary(own, listed, s) if s.boundary is None else s.boundary
    heavy = listed.filter(F.col("n") >= sizes_with(most + 1, s.percent)[0]).select("segment", "id", "n")
    groups = grouped(heavy, ["segment"], "jaccard")
    pairs = sieved(best_pivots(groups, s), own, s)
    if most:
        pairs = pairs.unionByName(stars(own, s, most)).distinct()
    pairs = materialize(pairs, "jaccard-candidates")
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    links = confirm(pairs, texts_of(docs, ends, "jaccard-texts"), s)
    labels = materialize(components(links), "jaccard-labels")
    groups = materialize(sieved_groups(groups.select("a", "id", "n"), labels, own, s), "jaccard-left")
    if not groups.isEmpty():
        more = materialize(strays(groups, labels, texts_of(docs, groups, "jaccard-left-texts"), s), "jaccard-stray-links")
        labels = components(labels.select(F.col("v").alias("a"), F.col("component").alias("b")).unionByName(more))
    return by_row(signed, own, labels.withColumnRenamed("v", "id"), None)


def op13_jaccard_join(docs: DataFrame) -> DataFrame:
    """The contract of op13: doc_id, n_shingles, component_id."""
    return jaccard_join(docs).select("doc_id", "n_shingles", "component_id")
