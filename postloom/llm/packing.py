"""Best-fit packing of token sequences.

Documents become ids of a public tokenizer, longer ones are cut into full pieces with a shorter first one, and pieces are
packed into as few sequences as best fit finds. The packing is bulk-synchronous. In a round

1. what is left (at first all pieces, and no gaps) is dealt to lanes of about ``lane`` rows; a piece or gap is in one lane
   only, so no two lanes claim one gap, and every lane gets pieces of all lengths;
2. each lane range-sorts its pieces and gaps by size and sweeps: the longest piece first, each to its successor, the smallest
   gap that is large enough, or else to a new sequence. Pieces of one length and gaps of one size are alike, so the sweep deals
   runs of ranks to runs of gaps; conflicts for a gap go by rank. Gaps are updated as it goes;
3. each lane gives up the new sequence that it could fill least, and its pieces go into the next round with the gaps that are
   left in all other sequences.

A round has fewer lanes than the one before, as only one sequence a lane and the gaps go on; it ends with a round of one lane
or after ``rounds`` rounds, in which nothing is given up. With one lane the result is best fit decreasing, piece by piece;
more lanes cost at most one sequence for each lane of the last round. All of it runs in tasks: one shuffle of small rows a
round, and a lane's rows in memory, whatever length a third of all pieces have.

Defined cases: a null or empty text is one id 0; rows are told apart by a key of their own, so repeated and null ids are
pieces of their own; equal lengths take ranks in the order of that key; an empty table gives an empty result; other columns are
not looked at.
"""

from __future__ import annotations

import base64
import bisect
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions

SIZE = 2048
END = 0  # the id after each document
LANE = 1 << 17  # rows of a lane, about
ROUNDS = 4  # at most
PLACED, LEFT, GAP = 0, 1, 2  # states of a round's rows


@dataclass(frozen=True)
class Tokenizer:
    """A byte-level vocabulary as ranks, and the same as a ``tokenizers`` file for texts that the former can't take."""

    ranks: str
    file: str
    pattern: str

    @staticmethod
    def public() -> Tokenizer:
        import public_tokenizers as P

        return Tokenizer(P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json"), P.PATTERN)

    def encoder(self):
        """text -> ids. Both libraries give the same ids; the first is about four times as fast. The file's added tokens are
        matched wherever a text spells them, as the file's tokenizer does when nothing is set."""
        import tiktoken

        with open(self.ranks, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(self.file, encoding="utf-8") as f:
            added = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
        fast = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens=added)
        slow = []

        def encode(text: str) -> list[int]:
            try:
                return fast.encode(text, allowed_special="all")
            except BaseException as e:  # its pattern engine gives up on some very long runs
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
                if not slow:
                    from tokenizers import Tokenizer as T

                    slow.append(T.from_file(self.file))
                return slow[0].encode(text, add_special_tokens=False).ids

        return encode


def pieces(docs: DataFrame, tokenizer: Tokenizer | None = None, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian 32-bit words) of whole texts."""
    tokenizer = tokenizer or Tokenizer.public()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer.encoder()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                keys, numbers, starts, lengths, ids = [], [], [], [], []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1)):
                    own = np.array([*encode(text.as_py() or ""), END], np.uint32)
                    n = -(-len(own) // size)
                    cut = [0, *range(len(own) - (n - 1) * size, len(own) + 1, size)]
                    for k in range(n):
                        keys.append(doc)
                        numbers.append(k)
                        starts.append(cut[k])
                        lengths.append(cut[k + 1] - cut[k])
                        ids.append(own[cut[k] : cut[k + 1]].tobytes())
                columns = [pa.array(keys, part.schema.field(0).type), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids binary")


def sweep(counts: dict[int, int], size: int = SIZE, held: dict[int, int] | None = None) -> tuple[np.ndarray, int]:
    """Best fit on classes. counts: length -> number of pieces. held: gap -> number of sequences that have it; these come
    first in the numbering, the smaller gaps before. Returns runs and the number of sequences.

    A run is (length, first rank, first sequence, pieces a sequence, offset): the piece of rank r in its class, with
    q = r - first rank, goes to sequence first + q // pieces at offset + (q % pieces) * length.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # size of a gap -> runs of sequences (first, number)
    sizes: list[int] = []
    n_sequences = 0

    def put(gap: int, first: int, number: int) -> None:
        if gap and number:
            if gap not in gaps:
                bisect.insort(sizes, gap)
                gaps[gap] = []
            gaps[gap].append((first, number))

    for gap in sorted(held or ()):
        put(gap, n_sequences, held[gap])
        n_sequences += held[gap]
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(sizes, length)
            if at < len(sizes):  # the successor: the smallest gap that is large enough
                gap = sizes[at]
                first, number = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], sizes[at]
            else:
                gap, first, number = size, n_sequences, -(-left // (size // length))
                n_sequences += number
            each = gap // length
            full = min(number, left // each)
            if full:
                runs.append((length, rank, first, each, size - gap))
                put(gap - each * length, first, full)
                rank, left, first, number = rank + full * each, left - full * each, first + full, number - full
            if number and left:  # the last gap takes what is left of the class
                runs.append((length, rank, first, left, size - gap))
                put(gap - left * length, first, 1)
                rank, left, first, number = rank + left, 0, first + 1, number - 1
            put(gap, first, number)
    return np.array(runs, np.int64).reshape(-1, 5), n_sequences


def swept(length: np.ndarray, gap: np.ndarray, size: int, keep: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int | None]:
    """One lane. length: of its pieces, in descending order; gap: of its open sequences, in ascending order. Returns the
    sequence (open ones first, then new ones) and offset of each piece, the gaps of all sequences after it, and, unless all are
    to be kept, the new sequence that is given up."""
    kinds, at, counts = np.unique(length, return_index=True, return_counts=True)
    runs, n = sweep(dict(zip(kinds.tolist(), counts.tolist())), size, dict(zip(*(x.tolist() for x in np.unique(gap, return_counts=True)))))
    rank = np.arange(len(length)) - at[np.searchsorted(kinds, length)] if len(length) else length
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    found = runs[np.searchsorted((runs[:, 0] << 32) + runs[:, 1], (length << 32) + rank, "right") - 1] if len(length) else runs
    q = rank - found[:, 1]
    sequence, offset = found[:, 2] + q // np.maximum(found[:, 3], 1), found[:, 4] + q % np.maximum(found[:, 3], 1) * length
    left = np.concatenate([gap, np.full(n - len(gap), size)]) - np.bincount(sequence, length, n).astype(np.int64)
    new = left[len(gap) :]
    given = len(gap) + int(new.argmax()) if not keep and len(new) and new.max() else None
    return sequence, offset, left, given


def _lanes(names: list[str], size: int, base: int, keep: bool):
    """Rows sorted by lane and then size: ``names``, _sequence and _gap (null but for gaps), _lane -> the same with _offset and
    _state in place of the lane."""

    def lane(rows: pa.Table, number: int) -> pa.RecordBatch:
        hole = rows.column("_gap").is_valid().to_numpy()
        gaps = rows.filter(pa.array(hole)).select(["_sequence", "_gap"])
        rows = rows.filter(pa.array(~hole)).select(names)
        gap, own = gaps.column("_gap").to_numpy(), gaps.column("_sequence").to_numpy()
        order = np.argsort(gap, kind="stable")
        gap, own = gap[order], own[order]
        sequence, offset, left, given = swept(rows.column("length").to_numpy(), gap, size, keep)
        own = np.concatenate([own, base + (number << 24) + np.arange(len(left) - len(gap))])
        state = np.where(sequence == given, LEFT, PLACED) if given is not None else np.full(len(sequence), PLACED)
        open_ = np.flatnonzero((left > 0) & (np.arange(len(left)) != (-1 if given is None else given))) if not keep else np.zeros(0, np.int64)
        out = [pa.concat_arrays([*c.chunks, pa.nulls(len(open_), c.type)]) for c in rows.columns]
        more = np.zeros(len(open_), np.int64)
        out += [
            pa.array(np.concatenate([own[sequence], own[open_]]), mask=np.concatenate([state == LEFT, more > 0])),
            pa.array(np.concatenate([np.zeros(len(sequence), np.int64), left[open_]]), mask=np.concatenate([state >= 0, more > 0])),
            pa.array(np.concatenate([offset, more]), mask=np.concatenate([state == LEFT, more == 0])),
            pa.array(np.concatenate([state, more + GAP]).astype(np.int32)),
        ]
        return pa.RecordBatch.from_arrays(out, names=[*names, "_sequence", "_gap", "_offset", "_state"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None
        for batch in batches:
            lanes = batch.column("_lane").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(lanes)) + 1).tolist(), len(lanes)]
            for a, z in zip(cuts[:-1], cuts[1:]):
                if z > a:
                    if held and lanes[a] != at:
                        yield lane(pa.Table.from_batches(held), at)
                        held = []
                    at = int(lanes[a])
                    held.append(batch.slice(a, z - a))
        if held:
            yield lane(pa.Table.from_batches(held), at)

    return run


def pack(rows: DataFrame, size: int = SIZE, lane: int = LANE, rounds: int = ROUNDS) -> DataFrame:
    """Adds sequence_id and offset to rows that have ``length`` (1 to ``size``) and a ``row`` of their own. ``rows`` is read
    twice, so it should be a table."""
    names = rows.columns
    none = F.lit(None).cast("long")
    todo = rows.withColumns({"_sequence": none, "_gap": none})
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", _sequence long, _gap long, _offset long, _state int"
    n, out = rows.count(), None
    for r in range(rounds):
        lanes = max(1, -(-n // lane))
        last = lanes == 1 or r == rounds - 1
        key = F.xxhash64(F.coalesce("row", -1 - F.col("_sequence")))
        dealt = todo.withColumn("_lane", F.pmod(key, F.lit(lanes))).repartition(partitions(rows.sparkSession), "_lane")
        dealt = dealt.sortWithinPartitions("_lane", F.coalesce("_gap", "length").desc(), "row", "_sequence")
        done = materialize(dealt.mapInArrow(_lanes(names, size, r << 56, last), kinds), f"pack-round-{r}")
        placed = done.filter(F.col("_state") == PLACED).select(*names, F.col("_sequence").alias("sequence_id"), F.col("_offset").alias("offset"))
        out = placed if out is None else out.unionByName(placed)
        todo = done.filter(F.col("_state") != PLACED).select(*names, "_sequence", "_gap")
        left = {x["_state"]: x.n for x in done.groupBy("_state").agg(F.count("*").alias("n")).collect()}  # three rows
        if last or not left.get(LEFT):
            break
        n = left[LEFT] + left.get(GAP, 0)
    return out


def sequences(cut: DataFrame, placed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (32-bit words), n_pieces. A sequence has ``SIZE`` ids at most."""
    whole = cut.select("row", "ids").join(placed.select("row", "sequence_id", "offset"), "row")
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = whole.groupBy("sequence_id").agg(parts.alias("parts"))
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return whole.select("sequence_id", joined.alias("ids"), F.size("parts").alias("n_pieces"))


def cut_table(docs: DataFrame, tokenizer: Tokenizer | None = None, size: int = SIZE) -> DataFrame:
    """``pieces`` as a table, with a key for each (row)."""
    return materialize(pieces(docs, tokenizer, size).withColumn("row", F.monotonically_increasing_id()), "pieces")


def op2_packing(docs: DataFrame) -> DataFrame:
    """The contract of op2: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = cut_table(docs)
    slim = cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "row")
    return pack(slim).drop("row")
