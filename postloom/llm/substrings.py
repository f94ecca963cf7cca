"""Suffix-array dedup of repeated byte strings.

A byte goes if a string of ``size`` bytes that covers it also starts in a document with a smaller id. All whole texts are
read; suffixes are compared by real bytes. Sorting every suffix of the corpus would move some 50 bytes for each byte of
text, so neighbouring suffixes travel together, sorted by the *leading token* of one of them, and those that cannot repeat go
early:

1. Documents are packed into blocks (compressed, in a bucketed table of shared files, so later steps that send answers to
   blocks shuffle the answers only). Of the suffixes that start in the first ``size - TOKEN + 1`` bytes of a suffix, the one
   whose TOKEN leading bytes have the least hash is its *anchor*: suffixes with equal heads have equal anchors, and
   neighbouring suffixes mostly share one, so a block has about one anchor for 16 bytes. The anchor's token is its four
   leading bytes, then 32 bits of the hash of the rest, so tokens sort as the anchors' leading bytes do.
2. Splitters, quantiles of the tokens of some blocks, range-partition the anchors by their leading bytes. A bucket sorts its
   tokens and tells the blocks which tokens occur in more than one document. A block sends each token once, so a passage that
   a third of all documents share costs one entry a block. A block also tells how many suffixes it would send for each token:
   tokens of more than ``PART`` in all are *hot* (a list of at most a few for each bucket).
3. Each block sends the suffixes of shared tokens, as runs of text, each different run once with its smallest and largest
   document. The bucket sorts the suffixes of its runs by multikey quicksort over words of 8 bytes, going on only with
   suffixes that are still tied, and finds the smallest document for each different head. A bucket is sorted in parts cut
   between tokens, and tokens never straddle a splitter, so neighbours across a boundary differ and need no comparison.
4. A hot token goes another way, as its suffixes may be in every block: each different head of a block is one row, and the
   smallest document of a head is a partial minimum, so a head crosses the network once a task. A join takes it back to the
   blocks; Spark splits the rows of a hot head there.
5. Each block takes the answers, marks the suffixes whose head has a smaller document, and cuts what they cover.

Hashes choose anchors and bring candidates together; runs that have equal hashes are merged only if their bytes are equal.
A task holds a bucket: about BUCKET bytes of text, and more than that only above ``MAX_BUCKETS`` buckets (16 TB of text).
doc_id is an integer.

Defined cases: a null or empty text keeps its no bytes; texts of fewer than ``size`` bytes never lose any; rows that repeat
an id are one document, so they don't cut each other; a null id is larger than any other; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LEFT, NULL_ID, RunHash, chunks, ids_of, integer_ids, materialize, partitions, ranges, shared_dir, text_bytes

SIZE = 50
TOKEN = 20
BLOCK = 4 << 20  # bytes of text in a block
BUCKET = 16 << 20  # bytes of text for which there is a bucket
MAX_BUCKETS = 1 << 20
PART = 1 << 18  # suffixes, about, that are sorted at once; a token of more is hot
SAMPLE = 8  # blocks, at least, whose tokens give the splitters
PER_BLOCK = 1 << 15  # splitters, at most, for a sampled block


def _zip(x: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes())


def _unzip(b: bytes, kind=np.uint8) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def blocks_of(docs: DataFrame, name: str = "text", block: int = BLOCK) -> DataFrame:
    """block (a number), n_bytes, ids, ends, body: some documents each. Numbers are by task and place, so a repeated task gives
    its blocks the same ones; ``docs`` has to come in the same order then, as a table does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, (data, off) = ids_of(batch.column(0)), text_bytes(batch.column(1))
            for i, j in chunks(off, block):
                part = data[off[i] : off[j]]
                row, number = [pa.array([number]), pa.array([len(part)])], number + 1
                row += [pa.array([_zip(x)], pa.binary()) for x in (ids[i:j], off[i + 1 : j + 1] - off[i], part)]
                yield pa.RecordBatch.from_arrays(row, names=["block", "n_bytes", "ids", "ends", "body"])

    schema = "block long, n_bytes long, ids binary, ends binary, body binary"
    spark, table = docs.sparkSession, f"blocks_{uuid.uuid4().hex}"
    packed = docs.select("doc_id", name).mapInArrow(run, schema).repartition(4 * partitions(spark), "block")  # one file a bucket
    path = f"{shared_dir(spark).rstrip('/')}/{table}"
    _LEFT.extend([("path", path), ("table", table)])
    packed.write.bucketBy(4 * partitions(spark), "block").option("path", path).saveAsTable(table)
    return spark.table(table)


class Block:
    """The suffixes of a block, as segments: neighbouring suffixes of one document with one token."""

    def __init__(self, ids: bytes, ends: bytes, body: bytes, size: int):
        self.ids, self.ends, self.data = _unzip(ids, np.int64), _unzip(ends, np.int64), _unzip(body)
        data, self.size = self.data, size
        begins = np.concatenate([[0], self.ends[:-1]])
        self.hash = RunHash(data)
        n = len(data) - size + 1
        if n <= 0:
            self.lo = self.hi = self.doc = np.zeros(0, np.int64)
            self.token = np.zeros(0, np.uint64)
            return
        # least hash of size - TOKEN + 1 neighbours, by doubling; the anchor's leading bytes come along
        lead = np.ndarray(len(data) - 3, ">u4", data, strides=(1,))[: len(data) - TOKEN + 1].astype(np.uint64)
        least = (self.hash.every(TOKEN) & ~np.uint64(0xFFFFFFFF)) | lead
        width, want = 1, size - TOKEN + 1
        while width < want:
            step = min(width, want - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        whole = np.zeros(n + 1, np.int8)  # the suffixes that have size bytes in their document
        fits = self.ends - begins >= size
        whole[begins[fits]] += 1
        np.subtract.at(whole, self.ends[fits] - size + 1, 1)
        whole = np.cumsum(whole[:-1], dtype=np.int8).view(bool)
        head = whole.copy()
        head[1:] &= (least[1:] != least[:-1]) | ~whole[:-1]
        inner = begins[fits & (begins > 0)]
        head[inner] = True
        self.lo = np.flatnonzero(head)
        stop = np.flatnonzero(~whole)
        nxt = np.append(self.lo[1:], n)
        at = np.searchsorted(stop, self.lo)
        first_stop = np.append(stop, n)[at]
        self.hi = np.minimum(nxt, first_stop) - 1
        self.token = (least[self.lo] << np.uint64(32)) | (least[self.lo] >> np.uint64(32))
        self.doc = np.searchsorted(self.ends, self.lo, "right")

    def split(self, hot: np.ndarray) -> None:
        """Cuts the segments of the hot tokens (sorted) into one for each suffix."""
        mine = within(self.token & ~np.uint64(1), hot)
        if not mine.any():
            return
        number = np.where(mine, self.hi - self.lo + 1, 1)
        of = np.repeat(np.arange(len(number)), number)
        self.lo, hi = ranges(self.lo, number), self.hi[of]
        self.hi = np.where(mine[of], self.lo, hi)
        self.token, self.doc = self.token[of], self.doc[of]

    def suffixes(self, tokens: np.ndarray) -> np.ndarray:
        """How many suffixes of different runs the block has for each of its ``tokens``, in their order."""
        if not len(tokens):
            return np.zeros(0, np.int64)
        first, _ = self.runs()
        at = np.searchsorted(tokens & ~np.uint64(1), self.token[first] & ~np.uint64(1))
        return np.bincount(at, self.hi[first] - self.lo[first] + 1, len(tokens)).astype(np.int64)

    def tokens(self) -> np.ndarray:
        """The block's different tokens, sorted, with the last bit telling whether several of its documents hold it."""
        if not len(self.token):
            return self.token
        token = self.token & ~np.uint64(1)
        order = np.argsort(token, kind="stable")
        token, owner = token[order], self.ids[self.doc][order]
        head = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        several = np.minimum.reduceat(owner, head) != np.maximum.reduceat(owner, head)
        return token[head] | several.astype(np.uint64)

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """(first, number): the first segment of each different run of text, and of each segment its run's number."""
        text = self.hash.of(self.lo, self.hi + self.size)
        first, number = merged(text ^ (self.token * np.uint64(0x9FB21C651E98DF25)), self.data, self.lo, self.hi + self.size - self.lo)
        order = np.argsort(first)  # by place: neighbours are alike, which compresses well
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        return first[order], rank[number]


def alike(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, limit: int = 1 << 20) -> np.ndarray:
    """Whether the runs of ``size`` (8 or more) bytes from a and from b on are equal, pair by pair, by words of 8 bytes."""
    eight = np.ndarray(max(len(data) - 7, 0), "<u8", data, strides=(1,))
    words = -(-size // 8)
    upto = np.concatenate([[0], np.cumsum(words)])
    same = np.ones(len(a), bool)
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + limit, "right")) - 1)
        of = np.repeat(np.arange(i, j), words[i:j])
        k = np.minimum(8 * (np.arange(len(of)) + upto[i] - upto[of]), size[of] - 8)  # the last word overlaps
        same[of[eight[a[of] + k] != eight[b[of] + k]]] = False
        i = j
    return same


def merged(key: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, number) of runs, those of equal keys and equal bytes as one. One whose bytes differ from those of the first of
    its key stays by itself, which is as right."""
    _, first, number = np.unique(key, return_index=True, return_inverse=True)
    other = np.flatnonzero(first[number] != np.arange(len(key)))
    head = first[number[other]]
    same = size[other] == size[head]
    same[same] = alike(data, begin[other[same]], begin[head[same]], size[other[same]])
    odd = other[~same]
    number[odd] = len(first) + np.arange(len(odd))
    return np.concatenate([first, odd]), number


def within(values: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which values are among ``held``, which is sorted."""
    if not len(held):
        return np.zeros(len(values), bool)
    return held[np.minimum(np.searchsorted(held, values), len(held) - 1)] == values


def _dealt(bucket: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(bucket, places) of each bucket that there is."""
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order])) + 1
    return [(int(bucket[p[0]]), p) for p in np.split(order, cut) if len(p)]


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows sorted by their first column -> the rows of each key."""
    at, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = row[batch.schema.names[0]]
            if held and key != at:
                yield at, held
                held = []
            at = key
            held.append(row)
    if held:
        yield at, held


def _one(**row) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int64()) for v in row.values()], names=list(row))


def _shared_tokens(hot: int):
    """Tokens of a bucket -> for each block those that several documents hold, and as block -1 those of more than ``hot``
    suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_key(batches):
            parts = [_unzip(r["data"], np.uint64) for r in rows]
            token = np.concatenate(parts)
            count = np.concatenate([_unzip(r["counts"], np.uint32) for r in rows])
            order = np.argsort(token >> np.uint64(1), kind="stable")
            plain = token[order] >> np.uint64(1)
            head = np.concatenate([[True], plain[1:] != plain[:-1]])
            group = np.cumsum(head) - 1
            shared = (np.bincount(group) > 1) | (np.bincount(group, weights=(token[order] & np.uint64(1)).astype(float)) > 0)
            many = plain[head][shared & (np.bincount(group, weights=count[order]) > hot)] << np.uint64(1)
            if len(many):
                yield _one(block=-1, data=_zip(many))
            flag = np.zeros(len(token), bool)
            flag[order] = shared[group]
            at = 0
            for r, p in zip(rows, parts):
                mine = p[flag[at : at + len(p)]] & ~np.uint64(1)
                at += len(p)
                if len(mine):
                    yield _one(block=r["block"], data=_zip(mine))

    return run


def grouped(words: list[np.ndarray], group: np.ndarray) -> np.ndarray:
    """Refines groups of suffixes by one word of 8 bytes after the other; only tied suffixes go on (multikey quicksort)."""
    group = np.unique(group, return_inverse=True)[1].astype(np.int64)
    live = np.flatnonzero(np.bincount(group)[group] > 1)
    fresh = int(group.max(initial=-1)) + 1
    for word in words:
        if not len(live):
            break
        own, value = group[live], word[live]
        order = np.lexsort((value, own))
        own, value, live = own[order], value[order], live[order]
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (value[1:] != value[:-1])])
        part = np.cumsum(new) - 1
        group[live] = fresh + part
        fresh += int(part[-1]) + 1
        live = live[np.bincount(part)[part] > 1]
    return group


def _word(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as one word."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(data)]
    return out


def _parts(token: np.ndarray, count: np.ndarray) -> Iterator[slice]:
    """Runs sorted by token, cut between tokens into parts of about ``PART`` suffixes."""
    if not len(token):
        return
    heads = np.append(np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])), len(token))
    upto = np.concatenate([[0], np.cumsum(count)])[heads]
    a = 0
    while a < len(heads) - 1:
        z = max(a + 1, int(np.searchsorted(upto, upto[a] + PART, "right")) - 1)
        yield slice(heads[a], heads[z])
        a = z


def _answers(size: int):
    """Runs of text of a bucket -> for each block, runs of suffixes whose head has a smaller document: number of the run in
    its block, first suffix in it, how many, and that document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_key(batches):
            load = lambda c, t: np.concatenate([_unzip(r[c], t) for r in rows])  # noqa: E731, B023
            token, length, least, number = load("tokens", np.uint64), load("lengths", np.int32).astype(np.int64), load("least", np.int64), load("numbers", np.int64)
            most = least + load("most", np.int64)
            texts = [_unzip(r["data"]) for r in rows]
            text = np.concatenate(texts)
            counts = [len(_unzip(r["lengths"], np.int32)) for r in rows]
            source = np.repeat(np.arange(len(rows)), counts)
            begin = np.cumsum(length) - length
            # equal runs of several blocks become one, with the smallest document
            key, at = [], 0
            for part, n in zip(texts, counts):
                x = begin[at : at + n] - (begin[at] if n else 0)
                key.append(RunHash(part).of(x, x + length[at : at + n]))
                at += n
            first, same = merged(np.concatenate(key) ^ (token * np.uint64(0x9FB21C651E98DF25)), text, begin, length)
            small = np.full(len(first), NULL_ID)
            np.minimum.at(small, same, least)
            own_token = token[first]
            # heads are sorted where a token has more than one run; a single run's heads all have its smallest document
            kind = np.unique(own_token, return_inverse=True)[1]
            tied = np.flatnonzero(np.bincount(kind)[kind] > 1)
            count = length[first] - size + 1
            answer = np.repeat(small, count)
            offset = np.cumsum(count) - count
            tied = tied[np.argsort(own_token[tied], kind="stable")]
            for part in _parts(own_token[tied], count[tied]):
                t = tied[part]
                size_of = length[first[t]]
                near = text[ranges(begin[first[t]], size_of)]
                at = ranges(np.cumsum(size_of) - size_of, count[t])  # the suffixes' places
                word = _word(near)
                words = [word[at + k] for k in range(0, size - 7, 8)] + [word[at + size - 8]]
                group = grouped(words, np.repeat(own_token[t], count[t]))
                to = ranges(offset[t], count[t])
                smallest = np.full(int(group.max()) + 1, NULL_ID)
                np.minimum.at(smallest, group, answer[to])
                answer[to] = smallest[group]
            # neighbours with one answer are one row
            cut = np.ones(len(answer), bool)
            cut[1:] = answer[1:] != answer[:-1]
            cut[offset] = True
            start = np.flatnonzero(cut)
            long = np.diff(np.append(start, len(answer)))
            owner = np.searchsorted(offset, start, "right") - 1
            firsts = np.searchsorted(owner, np.arange(len(first)))
            per = np.diff(np.append(firsts, len(owner)))
            row = ranges(firsts[same], per[same])  # the answers of each block's runs
            of = np.repeat(np.arange(len(same)), per[same])
            keep = answer[start[row]] < most[of]
            row, of = row[keep], of[keep]
            bounds = np.searchsorted(source[of], np.arange(len(rows) + 1))
            for k, r in enumerate(rows):
                a, b = bounds[k], bounds[k + 1]
                if b > a:
                    x, o = row[a:b], of[a:b]
                    table = np.stack([number[o], start[x] - offset[owner[x]], long[x], answer[start[x]]])
                    yield _one(block=r["block"], data=_zip(table))

    return run


_RUNS = "bucket long, block long, tokens binary, lengths binary, least binary, most binary, numbers binary, data binary"


def _met(blocks: DataFrame, sent: DataFrame, how: str) -> DataFrame:
    """Blocks with all that was sent to them; the bucketed side is read in place."""
    sent = sent.groupBy("block").agg(F.collect_list("data").alias("data"))
    return blocks.join(sent, "block", how).select("block", "ids", "ends", "body", "data")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def cut(docs: DataFrame, name: str = "text", size: int = SIZE, block: int = BLOCK, texts: bool = False, part: int = PART) -> DataFrame:
    """Of each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with ``texts`` also kept (binary)."""
    spark = docs.sparkSession
    blocks = blocks_of(integer_ids(docs), name, block)
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    n = min(MAX_BUCKETS, max(4 * partitions(spark), -(-total // BUCKET)))
    some = blocks.select("block").orderBy(F.xxhash64("block")).limit(max(SAMPLE, -(-n // PER_BLOCK))).collect()  # 40 numbers at most
    chosen = blocks.filter(F.col("block").isin([r.block for r in some])).select("ids", "ends", "body")

    def tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            yield _one(data=_zip(Block(r["ids"], r["ends"], r["body"], size).tokens()))

    sample = [_unzip(r.data, np.uint64) for r in chosen.mapInArrow(tokens_of, "data binary").collect()]  # 2 MB a block
    seen = np.sort(np.concatenate([*sample, np.zeros(0, np.uint64)])) & ~np.uint64(1)
    splitters = np.unique(seen[np.linspace(0, len(seen) - 1, n + 1).astype(np.int64)[1:-1]]) if len(seen) else seen

    def sent_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _rows([batch]):
                b = Block(r["ids"], r["ends"], r["body"], size)
                tokens = b.tokens()
                counts = b.suffixes(tokens).astype(np.uint32)
                for bucket, places in _dealt(np.searchsorted(splitters, tokens & ~np.uint64(1), "right")):
                    yield _one(bucket=bucket, block=r["block"], data=_zip(tokens[places]), counts=_zip(counts[places]))

    def sent_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            key, data, b = r["block"], r["data"], Block(r["ids"], r["ends"], r["body"], size)
            shared = np.sort(np.concatenate([_unzip(d, np.uint64) for d in data]))
            b.split(hot)
            first, number = b.runs()
            least, most = np.full(len(first), NULL_ID), np.full(len(first), np.iinfo(np.int64).min)
            np.minimum.at(least, number, b.ids[b.doc])
            np.maximum.at(most, number, b.ids[b.doc])
            token = b.token & ~np.uint64(1)
            live = np.flatnonzero(within(token[first], shared) & ~within(token[first], hot))
            for bucket, places in _dealt(np.searchsorted(splitters, token[first[live]], "right")):
                k = live[places]
                lo, length = b.lo[first[k]], b.hi[first[k]] + size - b.lo[first[k]]
                parts = (b.token[first[k]], length.astype(np.int32), least[k], most[k] - least[k], k.astype(np.int64), b.data[ranges(lo, length)])
                yield _one(bucket=bucket, block=key, **dict(zip(("tokens", "lengths", "least", "most", "numbers", "data"), map(_zip, parts))))

    def hot_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            if not within(hot, np.sort(np.concatenate([_unzip(d, np.uint64) for d in r["data"]]))).any():
                continue
            b = Block(r["ids"], r["ends"], r["body"], size)
            b.split(hot)
            first, number = b.runs()
            least, most = np.full(len(first), NULL_ID), np.full(len(first), np.iinfo(np.int64).min)
            np.minimum.at(least, number, b.ids[b.doc])
            np.maximum.at(most, number, b.ids[b.doc])
            mine = np.flatnonzero(within(b.token[first] & ~np.uint64(1), hot))
            windows = np.lib.stride_tricks.sliding_window_view(b.data, size)
            for k in range(0, len(mine), 1 << 16):
                own = mine[k : k + (1 << 16)]
                heads = np.ascontiguousarray(windows[b.lo[first[own]]]).reshape(-1)
                heads = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(np.arange(0, len(heads) + 1, size, dtype=np.int32)), pa.py_buffer(heads)])
                yield pa.RecordBatch.from_arrays([heads, pa.array(np.full(len(own), r["block"])), *(pa.array(x) for x in (own, least[own], most[own]))], names=["head", "block", "number", "least", "most"])

    def hot_answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            number = np.array(r["numbers"], np.int64)
            yield _one(block=r["block"], data=_zip(np.stack([number, np.zeros_like(number), np.ones_like(number), np.array(r["small"], np.int64)])))

    def cut_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            data, b = r["data"], Block(r["ids"], r["ends"], r["body"], size)
            b.split(hot)
            gone = np.zeros(len(b.data) + 1, np.int64)
            if data:
                table = np.concatenate([_unzip(d, np.int64).reshape(4, -1) for d in data], axis=1)
                table = table[:, np.argsort(table[0], kind="stable")]
                _, number = b.runs()
                a, z = np.searchsorted(table[0], number), np.searchsorted(table[0], number, "right")
                row, of = ranges(a, z - a), np.repeat(np.arange(len(number)), z - a)
                mine = table[3][row] < b.ids[b.doc[of]]
                row, of = row[mine], of[mine]
                start = b.lo[of] + table[1][row]
                np.add.at(gone, start, 1)
                np.subtract.at(gone, start + table[2][row] + size - 1, 1)
            gone = np.cumsum(gone[:-1]) > 0
            begins = np.concatenate([[0], b.ends[:-1]])
            total = np.concatenate([[0], np.cumsum(gone)])
            head = gone.copy()
            head[1:] &= ~gone[:-1]
            inner = begins[(begins > 0) & (begins < len(gone))]
            head[inner] |= gone[inner]
            spans = np.concatenate([[0], np.cumsum(head)])
            kept = b.data[~gone].tobytes()
            upto = np.concatenate([[0], np.cumsum(~gone)])
            bodies = [kept[x:y] for x, y in zip(upto[begins].tolist(), upto[b.ends].tolist())]
            columns = {
                "doc_id": pa.array(b.ids, mask=b.ids == NULL_ID),
                "n_bytes": pa.array(b.ends - begins),
                "n_removed": pa.array(total[b.ends] - total[begins]),
                "n_spans": pa.array(spans[b.ends] - spans[begins]),
                "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in bodies], pa.string()),
            }
            if texts:
                columns["kept"] = pa.array(bodies, pa.binary())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    def by_bucket(df: DataFrame) -> DataFrame:
        return df.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket")

    tokens = blocks.select("ids", "ends", "body", "block").mapInArrow(sent_tokens, "bucket long, block long, data binary, counts binary")
    shared = by_bucket(tokens).mapInArrow(_shared_tokens(max(part, total // MAX_BUCKETS)), "block long, data binary")
    shared = materialize(shared, "shared-tokens")
    found = [_unzip(r.data, np.uint64) for r in shared.filter("block = -1").collect()]  # MAX_BUCKETS tokens at most
    hot = np.sort(np.concatenate([*found, np.zeros(0, np.uint64)]))
    runs = _met(blocks, shared, "inner").mapInArrow(sent_runs, _RUNS)
    answers = materialize(by_bucket(runs).mapInArrow(_answers(size), "block long, data binary"), "answers")
    if len(hot):
        heads = materialize(_met(blocks, shared.filter("block >= 0"), "inner").mapInArrow(hot_heads, "head binary, block long, number long, least long, most long"), "hot-heads")
        smallest = heads.groupBy("head").agg(F.min("least").alias("small"), F.max("most").alias("large")).filter("small < large").select("head", "small")
        told = heads.join(smallest, "head").filter("small < most").groupBy("block").agg(F.collect_list(F.struct("number", "small")).alias("x"))  # a block's own
        told = told.select("block", F.col("x.number").alias("numbers"), F.col("x.small").alias("small"))
        answers = answers.unionByName(materialize(told.mapInArrow(hot_answers, "block long, data binary"), "hot-answers"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    return _met(blocks, answers, "left").mapInArrow(cut_blocks, schema)


def op5_suffix_dedup(docs: DataFrame) -> DataFrame:
    return cut(docs)
