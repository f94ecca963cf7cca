"""Quality classifier: ordinal cumulative-link regression on graded ratings.

The grades come from two labels: 0 toxic, 1 junk (quality 0, not toxic), 2 good. All grades share one vector of
hashed-text weights w; ordered thresholds t0 < t1 cut the score s = w.x: P(grade <= k) = logistic(t_k - s). A document's
expected grade and tail probability P(grade = 2) follow from s, and selection takes the tail.

Features are sets of hashed marks of the whole text: its different words, the words' beginnings, its different runs of other
signs, and, in steps, the shares of repeated words, upper-case letters, other signs and digits. Weights are at most zero and
only marks that go with lower grades (a chi-square test over different texts) have one: marks take away from quality. So a
short text isn't poor for want of praise, one insult in a long text counts as much as in a short one, and rare words, which
make up most of any text, add no noise.

The model is fitted on a bounded sample of labelled documents (``SAMPLE``; their ids are chosen by hash and broadcast, so no
text is shuffled). At most ``MARKS`` marks, the clearest ones, have a weight: the model has a fixed size and is broadcast.

Defined cases: a null or empty text has the marks of an empty text only; labels with a null, and labels without a document,
are not used; several labels of one id count as one, the worst grade; without any usable label every document gets the
highest grade with probability 1; repeated rows each have a result; of equally clear marks the
smaller numbers have a weight; a document of probability ``LEAST`` is kept; an empty table gives an empty result; other columns are
not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, coded_words, distinct, hash_words, materialize, mix, text_bytes

BITS = 32
GRADES = 3
SAMPLE = 16_000  # labelled documents, about, that the model is fitted on
MARKS = 4096  # that may have a weight
LEAST = 0.5  # tail probability from which a document is kept
_CHUNK = 2 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x41:0x5B] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_OTHER = ~_WORD
_OTHER[[0x20, *range(0x09, 0x0E)]] = False


def _starts(held: pa.Array, size: int) -> np.ndarray:
    """Hashes of the first ``size`` (8 or less) bytes of words."""
    data, off = text_bytes(held)
    eight = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    spare = (8 - np.minimum(np.diff(off), size)).astype(np.uint64) * np.uint64(8)
    return mix(((eight[off[:-1]] << spare) >> spare) * np.uint64(0xA0761D6478BD642F) + np.uint64(size))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(marks, offsets): for each text its set of marks, as numbers below ``2**BITS``."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    count = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
    share = lambda part, whole: (part / np.maximum(whole, 1))
    down = np.uint64(64 - BITS)

    def kinds(of: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """(text, number) of each different word of each text, the words by number, and how many a text has in all."""
        code, held, first = coded_words(of, offsets, inside)
        pairs = distinct(np.repeat(np.arange(n), np.diff(first)) * max(len(held), 1) + code)
        return pairs // max(len(held), 1), pairs % max(len(held), 1), held, np.diff(first)

    doc, word, held, n_words = kinds(_LOWER[data], _WORD)
    marks = np.stack([hash_words(held), *(_starts(held, k) for k in (4, 5, 6))], axis=1)
    doc2, sign, held2, _ = kinds(data, _OTHER)
    signs = mix(hash_words(held2) ^ np.uint64(0x5851F42D4C957F2D))
    upper = share(count((data >= 0x41) & (data <= 0x5A)), size)
    other = share(count(_OTHER[data]), size)
    digit = share(count((data >= 0x30) & (data <= 0x39)), size)
    repeated = 1 - share(np.bincount(doc, minlength=n), n_words)
    # the share of repeats that is usual grows with the length, so the two go together
    long = np.minimum(np.log2(n_words + 1).astype(np.int64), 15)
    step = lambda x, k: np.minimum((x * k).astype(np.int64), k - 1)
    shape = [(2, step(upper, 20)), (3, step(other, 40)), (4, step(digit, 20)), (5, step(repeated, 20) * 16 + long)]
    shape = np.stack([mix(v.astype(np.uint64) * np.uint64(64) + np.uint64(k)) for k, v in shape], axis=1)
    all_ = np.concatenate([marks[word].ravel(), signs[sign], shape.ravel()]) >> down
    of = np.concatenate([np.repeat(doc, marks.shape[1]), doc2, np.repeat(np.arange(n), shape.shape[1])]).astype(np.uint64)
    own = distinct((of << np.uint64(BITS)) | all_)
    return own.astype(np.uint32), np.searchsorted(own >> np.uint64(BITS), np.arange(n + 1, dtype=np.uint64))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


@dataclass(frozen=True)
class Model:
    marks: np.ndarray  # those that have a weight, sorted
    weights: np.ndarray
    thresholds: np.ndarray  # ordered

    def scores(self, marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if not len(self.marks):
            return np.zeros(len(offsets) - 1)
        at = np.minimum(np.searchsorted(self.marks, marks), len(self.marks) - 1)
        worth = np.where(self.marks[at] == marks, self.weights[at], 0.0)
        return np.diff(np.concatenate([[0.0], np.cumsum(worth)])[offsets])

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..., one column each."""
        return _logistic(score[:, None] - self.thresholds[None, :])


def solve(marks: np.ndarray, sets: list[np.ndarray], grade: np.ndarray, rounds: int = 600, rate: float = 0.2, balance: float = 1.0) -> Model:
    """Maximum likelihood by full-batch Adam under weights of at most zero. ``sets`` hold places in ``marks``, which are sorted.

    ``balance`` is the power of the inverse frequency by which the grades weigh.
    """
    n = len(grade)
    row, at = np.repeat(np.arange(n), [len(x) for x in sets]), np.concatenate(sets).astype(np.int64)
    seen = np.bincount(grade, minlength=GRADES)
    cost = (n / np.maximum(seen, 1))[grade] ** balance
    cost /= cost.sum()
    w = np.full(len(marks), -1.0)
    free = np.array([-4.0, np.log(2.0)])  # t0, log(t1 - t0)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, free)]
    every = np.arange(n)
    for r in range(1, rounds + 1):
        t = np.array([free[0], free[0] + np.exp(free[1])])
        s = np.bincount(row, w[at], n)
        below = _logistic(t[None, :] - s[:, None])
        edge = np.concatenate([np.zeros((n, 1)), below, np.ones((n, 1))], axis=1)
        p = np.maximum(edge[every, grade + 1] - edge[every, grade], 1e-9)
        slope = edge * (1 - edge)
        up, low = slope[every, grade + 1], slope[every, grade]
        to_s = cost * (up - low) / p  # of the loss, by s
        by_t = np.array([-(cost * ((grade == k) * up - (grade == k + 1) * low) / p).sum() for k in range(GRADES - 1)])
        grads = [np.bincount(at, to_s[row], len(w)) + 1e-5 * w, np.array([by_t.sum(), by_t[1] * np.exp(free[1])])]
        for x, g, (m, v) in zip((w, free), grads, moments):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.999**r)) + 1e-8)
        np.minimum(w, 0, out=w)
    return Model(marks, w, np.array([free[0], free[0] + np.exp(free[1])]))


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    usable = labels.filter("doc_id is not null and quality is not null and toxic is not null")
    return usable.groupBy("doc_id").agg(F.min(grade).alias("grade"))


def telling_marks(rows: DataFrame, least: float = 15.0, share: float = 0.25, most: int = MARKS) -> np.ndarray:
    """The marks that may have a weight, sorted: those which higher grades have less than ``share`` times as often as all
    have, with a chi-square of ``least``; at most the ``most`` clearest ones. rows: grade, marks."""
    seen = {r.grade: r.n for r in rows.groupBy("grade").agg(F.count("*").alias("n")).collect()}  # a row a grade
    n = sum(seen.values())
    held = [F.count_if(F.col("grade") >= k).alias(f"h{k}") for k in range(1, GRADES)]
    counts = rows.select("grade", F.explode("marks").alias("mark")).groupBy("mark").agg(F.count("*").alias("total"), *held)
    total, clear = F.col("total"), [F.lit(0.0)]
    for k in range(1, GRADES):
        p = sum(c for g, c in seen.items() if g >= k) / max(n, 1)
        if 0 < p < 1:
            h = F.col(f"h{k}")
            chi = F.pow(h - total * p, F.lit(2)) / F.greatest(total * p * (1 - p) * (1 - total / n), F.lit(1e-9))
            clear.append(F.when((h < share * p * total) & (total >= 4), chi).otherwise(0.0))
    best = counts.select("mark", F.greatest(*clear, F.lit(0.0)).alias("clear")).filter(F.col("clear") >= least)
    chosen = best.orderBy(F.col("clear").desc(), "mark").limit(most).collect()
    return np.sort(np.array([r.mark for r in chosen], np.int64).astype(np.uint32))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    chosen = graded(labels)
    n = chosen.count()
    if n > sample:
        chosen = chosen.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int((1 << 40) * sample / n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_bytes(batch.column(0))
            for i, j in chunks(off, _CHUNK):
                marks, at = features(data[off[i] : off[j]], off[i : j + 1] - off[i])
                digest = [hashlib.sha256(marks[at[k] : at[k + 1]]).digest() for k in range(j - i)]
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(marks.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, j - i), pa.array(digest, pa.binary()), lists], names=["grade", "digest", "marks"])

    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "grade")
    rows = picked.mapInArrow(run, "grade int, digest binary, marks array<long>")
    rows = rows.groupBy("digest").agg(F.min("grade").alias("grade"), F.first("marks").alias("marks"))  # copies count once
    rows = materialize(rows, "quality-sample")
    marks = telling_marks(rows)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, off = batch.column(1).flatten().to_numpy(), batch.column(1).offsets.to_numpy()
            flat = flat.astype(np.uint32)
            at = np.minimum(np.searchsorted(marks, flat), max(len(marks) - 1, 0))
            hit = marks[at] == flat if len(marks) else np.zeros(len(flat), bool)
            off = off - off[0]
            sets = [at[a:z][hit[a:z]].astype(np.int32).tobytes() for a, z in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["grade", "told"])

    few = rows.select("grade", "marks").mapInArrow(told, "grade int, told binary").collect()  # about ``sample`` rows of a few numbers
    few.sort(key=lambda r: (r.told, r.grade))
    if not few or not len(marks):
        return Model(np.zeros(0, np.uint32), np.zeros(0), np.array([-100.0, -99.0]))
    return solve(marks, [np.frombuffer(r.told, np.int32) for r in few], np.array([r.grade for r in few]))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns, and expected_grade and tail_probability (of the highest grade); they replace any of these names."""
    kept = [c for c in docs.columns if c not in ("expected_grade", "tail_probability")]
    docs = docs.select(*kept)
    at_text = kept.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_bytes(batch.column(at_text))
            tails = []
            for i, j in chunks(off, _CHUNK):
                marks, at = features(data[off[i] : off[j]], off[i : j + 1] - off[i])
                tails.append(shared.value.tails(shared.value.scores(marks, at)))
            tails = np.concatenate([*tails, np.zeros((0, GRADES - 1))])
            columns = [*batch.columns, pa.array(tails.sum(1)), pa.array(tails[:, -1])]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "expected_grade", "tail_probability"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, expected_grade double, tail_probability double")


def op7_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, expected_grade, tail_probability, kept."""
    docs = docs.select("doc_id", "text")
    found = score(docs, fit(docs, labels))
    return found.select("doc_id", F.round("expected_grade", 6).alias("expected_grade"), F.round("tail_probability", 6).alias("tail_probability"), (F.col("tail_probability") >= LEAST).alias("kept"))
