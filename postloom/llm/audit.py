"""Source divergence audit: how far apart the groups (lang, source) of a corpus are in their use of terms.

The matrix of a language has a row for each of its groups and a column for each kept term (one that enough documents of the
language hold), and the count of the term in the group as cells. It is cut into square tiles, and each tile that has a count is
kept as a quadtree with ``K`` * ``K`` children a node (a k2-tree): bits say which quadrants have any count, and only quadrants
of ``K`` by ``K`` cells that have one are stored.

1. One pass over the texts counts terms by (lang, source), with the documents that hold them, before the shuffle.
2. Kept terms go into strips of about ``STRIP`` terms: those in about as many groups (powers of two) together, so that the
   quadrants of rare terms are mostly empty. Groups are numbered by size. A tile is a strip by ``SIDE`` groups.
3. Two tiles of a strip are traversed jointly from their roots for all their pairs of groups. A quadrant that is empty on both
   sides is left at once: all its cells are worth the same for a pair of groups, the divergence of the two shares of a term that
   does not occur, so they are priced together, by their number. The traversal ends in leaves with a count on one side at least.
4. Values of a pair are added up over strips, and the priced cells are added.

A tile has at most ``SIDE`` * ``SIDE`` cells whatever the input; counts are partial sums, so a source with a third of all
rows is a few rows a task. The result itself has a row for each ordered pair of groups of a language, as its contract wants;
ranks and numbers sort the groups of one language at most. All arithmetic is on integers: shares by long division in steps of
1,000, exact up to 9e15 occurrences.

Defined cases: null text, lang and source count as ''; a group without a term has shares of its own (each term as if it occurred
twice); a language without kept terms gives its pairs the value 0; repeated rows count each; an empty table gives an empty
result; a long text is cut nowhere (a worker holds one text several times over); other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import chunks, coded_words, distinct, materialize, text_bytes

SCALE = 10**9  # of shares
LEAST = 10  # documents of the language that hold a kept term
TOP = 10  # terms of a group that are listed
K, LEVELS = 4, 4
SIDE = K**LEVELS  # rows and columns of a tile
STRIP = 200  # terms of a strip, about
_CHUNK = 16 << 20
_FRONT = 1 << 13  # nodes that a traversal takes at a time

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


# ---- counts ---------------------------------------------------------------------------------------------------------


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) -> (lang, source, term, n, docs) of each run of texts; a row without a term for each group."""
    for batch in batches:
        langs, sources = (c.dictionary_encode() for c in batch.columns[:2])
        data, off = text_bytes(batch.column(2))
        own = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
        for i, j in chunks(off, _CHUNK):
            code, held, first = coded_words(_LOWER[data[off[i] : off[j]]], off[i : j + 1] - off[i], _LETTER)
            groups, group = np.unique(own[i:j], return_inverse=True)
            size = max(len(held), 1)
            cell, n = np.unique(np.repeat(np.arange(j - i), np.diff(first)) * size + code, return_counts=True)  # of a document
            cell = group[cell // size] * size + cell % size
            order = np.argsort(cell, kind="stable")
            at = np.flatnonzero(np.diff(cell[order], prepend=-1))
            cells = cell[order][at]
            n = np.add.reduceat(n[order], at) if len(at) else n
            docs = np.diff(np.append(at, len(order)))
            where = np.concatenate([groups, groups[cells // size]])
            none = np.zeros(len(groups), np.int64)
            term = pa.concat_arrays([pa.nulls(len(groups), pa.string()), held.take(pa.array(cells % size)).cast(pa.binary()).cast(pa.string())])
            lang, source = (d.dictionary.take(pa.array(k)) for d, k in ((langs, where // len(sources.dictionary)), (sources, where % len(sources.dictionary))))
            yield pa.RecordBatch.from_arrays([lang, source, term, pa.array(np.concatenate([none, n])), pa.array(np.concatenate([none, docs]))], names=["lang", "source", "term", "n", "docs"])


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it); with a row without a term for each group."""
    texts = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    found = texts.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (n + 2) / total), exactly."""
    whole, rest = np.divmod(n + 2, total)
    for _ in range(3):
        rest = rest * 1000
        whole, rest = whole * 1000 + rest // total, rest % total
    return whole + 1


def _share(n: Column, total: Column) -> Column:
    whole, rest = F.floor((n + 2 - F.pmod(n + 2, total)) / total).cast("long"), F.pmod(n + 2, total)
    exact = F.lit(SCALE).cast("decimal(12,0)") * rest.cast("decimal(20,0)")
    return 1 + SCALE * whole + F.call_function("div", exact, total.cast("decimal(20,0)"))


def _divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


# ---- quadtrees ------------------------------------------------------------------------------------------------------


def grown(r: np.ndarray, c: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes]:
    """The quadtree of the cells (r, c) -> n > 0 of a tile: the bits of its inner levels, and its leaves."""
    code = np.zeros(len(r), np.int64)
    for level in range(LEVELS - 1, -1, -1):
        code = code * K * K + (r // K**level % K) * K + c // K**level % K
    order = np.argsort(code)
    code, n = code[order], n[order]
    bits = []
    for depth in range(1, LEVELS):
        nodes, above = (distinct(code // (K * K) ** (LEVELS - d)) for d in (depth, depth - 1))
        flags = np.zeros((len(above), K * K), np.uint8)
        flags[np.searchsorted(above, nodes // (K * K)), nodes % (K * K)] = 1
        bits.append(np.packbits(flags).tobytes())
    at = distinct(code // (K * K))
    leaves = np.zeros((len(at), K * K), np.int64)
    leaves[np.searchsorted(at, code // (K * K)), code % (K * K)] = n
    return b"".join(bits), leaves.tobytes()


class Tree:
    """A tile's quadtree, to be walked: ``children[d][node]`` has the numbers of a node's children by row and column, -1 for
    an empty quadrant; the last node of each level stands for an empty quadrant itself, so -1 leads to it."""

    def __init__(self, bits: bytes | None, leaves: bytes | None):
        self.children, width = [], 1
        packed = np.unpackbits(np.frombuffer(bits or b"", np.uint8))
        for _ in range(LEVELS - 1):
            flags = packed[: width * K * K] if bits is not None else np.zeros(0, np.uint8)
            packed = packed[-(-width * K * K // 8) * 8 :]
            child = np.where(flags == 1, np.cumsum(flags, dtype=np.int64) - 1, -1)
            width = int(flags.sum())
            self.children.append(np.append(child, np.full(K * K, -1)).reshape(-1, K, K))
        held = np.frombuffer(leaves or b"", np.int64)
        self.leaves = np.append(held, np.zeros(K * K, np.int64)).reshape(-1, K, K)
        self.root = 0 if bits is not None else -1


def joint(a: Tree, b: Tree, totals_a: np.ndarray, totals_b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """(values, cells): for each row of ``a`` with each of ``b`` the summed divergence of the columns in which one of them has a
    count, and the number of these columns. ``totals``: what the shares of each row are of. ``same``: one tile with itself, of
    which only pairs of a row with a later one are wanted."""
    none = [share(np.zeros(len(t), np.int64), t) for t in (totals_a, totals_b)]
    pad = lambda x, fill: np.append(x, np.full(SIDE - len(x), fill))
    totals, none = [pad(t, 1) for t in (totals_a, totals_b)], [pad(p, 1) for p in none]
    values, cells = np.zeros(SIDE * SIDE, np.int64), np.zeros(SIDE * SIDE, np.int64)
    k = np.arange(K)
    stack = [(0, *(np.array([x], np.int64) for x in (a.root, b.root, 0, 0)))]
    while stack:
        depth, na, nb, ra, rb = stack.pop()
        if len(na) > _FRONT:
            stack += [(depth, *(x[at : at + _FRONT] for x in (na, nb, ra, rb))) for at in range(0, len(na), _FRONT)]
            continue
        rows_a, rows_b = ra[:, None] * K + k, rb[:, None] * K + k
        if depth < LEVELS - 1:
            kids_a, kids_b = a.children[depth][na][:, :, None, :], b.children[depth][nb][:, None, :, :]
            below = K ** (LEVELS - 1 - depth)
            live = ((rows_a * below < len(totals_a))[:, :, None] & (rows_b * below < len(totals_b))[:, None, :])
            if same:
                live &= rows_a[:, :, None] <= rows_b[:, None, :]
            f, x, y, c = np.nonzero(live[..., None] & ((kids_a >= 0) | (kids_b >= 0)))
            if len(f):
                stack.append((depth + 1, kids_a[f, x, 0, c], kids_b[f, 0, y, c], rows_a[f, x], rows_b[f, y]))
            continue
        na_, nb_ = a.leaves[na], b.leaves[nb]
        p = np.where(na_ > 0, share(na_, totals[0][rows_a][..., None]), none[0][rows_a][..., None])[:, :, None, :]
        q = np.where(nb_ > 0, share(nb_, totals[1][rows_b][..., None]), none[1][rows_b][..., None])[:, None, :, :]
        either = (na_ > 0)[:, :, None, :] | (nb_ > 0)[:, None, :, :]
        worth = np.where(either, (p - q) * (p - q) // (p + q), 0).sum(3)
        at = (rows_a[:, :, None] * SIDE + rows_b[:, None, :]).ravel()
        np.add.at(values, at, worth.ravel())
        np.add.at(cells, at, either.sum(3).ravel())
    values, cells = (x.reshape(SIDE, SIDE)[: len(totals_a), : len(totals_b)] for x in (values, cells))
    return (np.triu(values, 1), np.triu(cells, 1)) if same else (values, cells)


_TILE = "lang string, band long, strip long, part long, i long"


def _grown(key: tuple, cells: pa.Table) -> pa.Table:
    r, c, n = (cells.column(x).to_numpy().astype(np.int64) for x in ("r", "c", "n"))
    bits, leaves = grown(r, c, n)
    return pa.table([*([k.as_py()] for k in key), [bits], [leaves]], names=["lang", "band", "strip", "part", "i", "bits", "leaves"])


def _joined(key: tuple, tiles: pa.Table) -> pa.Table:
    lo, hi = key[-2].as_py(), key[-1].as_py()
    held = {r["i"]: r for r in tiles.to_pylist()}
    some = next(iter(held.values()))
    trees = [Tree(held[x]["bits"], held[x]["leaves"]) if x in held else Tree(None, None) for x in (lo, hi)]
    values, cells = joint(*trees, *(np.array(some[x], np.int64) for x in ("totals_lo", "totals_hi")), lo == hi)
    a, b = np.nonzero(cells)
    return pa.table([pa.array([some["lang"]] * len(a), pa.string()), pa.array(lo * SIDE + a), pa.array(hi * SIDE + b), pa.array(values[a, b]), pa.array(cells[a, b])], names=["lang", "a", "b", "value", "cells"])


# ---- the audit ------------------------------------------------------------------------------------------------------


def cells_of(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, groups, langs). cells: lang, source, term, n, n_lang, groups (that hold the term); groups: lang, source, total,
    number (by size), ``n_terms`` of the language; langs: lang, n_terms, lang_total. A total is what shares are of."""
    counted = materialize(counts(docs), "audit-counts")
    own = W.partitionBy("lang", "term")  # a row a group
    cells = counted.filter(F.col("term").isNotNull()).withColumns(
        {"docs": F.sum("docs").over(own), "n_lang": F.sum("n").over(own), "groups": F.count("*").over(own), "first": F.min("source").over(own) == F.col("source")}
    )
    cells = materialize(cells.filter(F.col("docs") >= least).drop("docs"), "audit-cells")
    groups = counted.filter(F.col("term").isNull()).select("lang", "source")
    langs = cells.groupBy("lang").agg(F.count_if("first").alias("n_terms"), F.sum("n").alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    langs = groups.select("lang").distinct().join(langs, "lang", "left").select("lang", zero("n_terms").alias("n_terms"), (zero("n") + 2 * zero("n_terms")).alias("lang_total"))
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    number = (F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "source")) - 1).alias("number")
    groups = groups.join(sums, ["lang", "source"], "left").join(langs, "lang").select("lang", "source", "n_terms", zero("n").alias("n"))
    groups = groups.select("lang", "source", "n_terms", (F.col("n") + 2 * F.col("n_terms")).alias("total"), number)
    return cells.drop("first"), materialize(groups, "audit-groups"), materialize(langs, "audit-langs")


def telling_terms(cells: DataFrame, groups: DataFrame, langs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, item, value, rank: the terms that a group has beyond its language's share, the farthest first."""
    shares = cells.join(groups.select("lang", "source", "total"), ["lang", "source"]).join(langs, "lang").select(
        "lang", "source", F.col("term").alias("item"), _share(F.col("n"), F.col("total")).alias("p"), _share(F.col("n_lang"), F.col("lang_total")).alias("q")
    )
    more = shares.filter("p > q").select("lang", "source", "item", _divergence(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return more.withColumn("rank", rank).filter(F.col("rank") <= top)


def tiles(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """The quadtrees: lang, band, strip, part, i, bits, leaves. A strip with more than ``SIDE`` terms by chance has parts."""
    band = F.floor(F.log2("groups") + 1e-9)
    banded = cells.select("lang", "source", "term", "n", "groups", band.alias("band"))
    strips = banded.groupBy("lang", "band").agg(F.ceil(F.sum(1 / F.col("groups")) / STRIP).alias("strips"))
    dealt = banded.join(strips, ["lang", "band"]).withColumn("strip", F.pmod(F.xxhash64("term"), F.greatest("strips", F.lit(1))))
    dealt = dealt.join(groups.select("lang", "source", "number"), ["lang", "source"])
    column = F.dense_rank().over(W.partitionBy("lang", "band", "strip").orderBy("term")) - 1
    dealt = dealt.withColumn("column", column).select(
        "lang", "band", "strip", F.floor(F.col("column") / SIDE).alias("part"), F.floor(F.col("number") / SIDE).alias("i"),
        (F.col("number") % SIDE).alias("r"), (F.col("column") % SIDE).alias("c"), "n",
    )
    return dealt.groupBy("lang", "band", "strip", "part", "i").applyInArrow(_grown, f"{_TILE}, bits binary, leaves binary")


def group_pairs(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source of the language), value, rank: all ordered pairs of groups."""
    own = groups.withColumn("i", F.floor(F.col("number") / SIDE))
    rows = own.groupBy("lang", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("number", "total"))), lambda x: x["total"]).alias("totals"))  # SIDE at most
    most = own.groupBy("lang").agg(F.max("i").alias("most"))
    held = materialize(tiles(cells, groups), "audit-tiles").join(most, "lang")
    held = held.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), "most"))).drop("most")
    held = held.withColumns({"lo": F.least("i", "j"), "hi": F.greatest("i", "j")}).drop("j")
    for side in ("lo", "hi"):
        held = held.join(rows.withColumnsRenamed({"i": side, "totals": f"totals_{side}"}), ["lang", side])
    keys = ["lang", "band", "strip", "part", "lo", "hi"]
    found = held.groupBy(*keys).applyInArrow(_joined, "lang string, a long, b long, value long, cells long")
    found = found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("cells").alias("cells"))
    found = materialize(found, "audit-pairs")
    found = found.unionByName(found.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value", "cells"))
    left, right = (groups.select("lang", F.col("source").alias(s), "n_terms", F.col("total").alias(f"total_{s}"), F.col("number").alias(n)) for s, n in (("source", "a"), ("item", "b")))
    pairs = left.join(right.drop("n_terms"), "lang").filter("a <> b").join(found, ["lang", "a", "b"], "left")
    priced = _divergence(*(_share(F.lit(0).cast("long"), F.col(f"total_{s}")) for s in ("source", "item")))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    value = F.when(F.col("n_terms") == 0, F.lit(0).cast("long")).otherwise(zero("value") + (F.col("n_terms") - zero("cells")) * priced)
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.select("lang", "source", "item", value.alias("value")).withColumn("rank", rank)


def op11_audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The contract of op11: lang, source, part (``pair`` or ``term``), item, value, rank."""
    cells, groups, langs = cells_of(docs, least)
    parts = {"pair": group_pairs(cells, groups), "term": telling_terms(cells, groups, langs, top)}
    pair, term = (df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, df in parts.items())
    return pair.unionByName(term)
