"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model is a matrix of log-probabilities (languages by bins), fitted on a bounded sample of rows with a language, chosen
by a hash of their id; it has a row of 128 kB a language and is broadcast. Scoring adds, for whole texts, the
columns of all their n-grams, for many documents at once in numpy.

Defined cases: a null or empty text, or one without letters, is ``und`` with score 0; repeated rows each have their result;
of equal posteriors the language that sorts first wins; rows without a language don't teach; without any row that teaches everything is ``und``; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, materialize, text_bytes

BITS = 15  # bins: 2**BITS
ORDERS = (1, 2, 3)
SAMPLE = 20_000  # documents, about, that the model is fitted on
UNKNOWN = "und"
_CHUNK = 1 << 20


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(lower case of a code point, whether it is a letter), for the basic plane."""
    points = [chr(c) for c in range(0x10000)]
    lower = np.array([ord(x.lower()) if len(x.lower()) == 1 else ord(x) for x in points], np.uint32)
    return lower, np.array([x.isalpha() for x in points])


def _points(data: np.ndarray, offsets: np.ndarray, tables) -> tuple[np.ndarray, np.ndarray]:
    """(letters in lower case with runs of other signs as one space each, offsets) of some texts."""
    lower, letter = tables
    first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    x = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(x) and x.max() > 0xFFFF:
        far = x > 0xFFFF
        kinds, at = np.unique(x[far], return_inverse=True)
        is_letter = letter[np.minimum(x, 0xFFFF)]
        is_letter[far] = np.array([chr(c).isalpha() for c in kinds])[at]
        x = np.where(far, x, lower[np.minimum(x, 0xFFFF)])
    else:
        is_letter = letter[x]
        x = lower[x]
    x = np.where(is_letter, x, 32)
    head = np.zeros(len(x) + 1, bool)
    head[first[:-1]] = True
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first other sign after a letter
    keep &= ~(head[:-1] & ~is_letter)
    return x[keep], np.concatenate([[0], np.cumsum(keep)])[first]


def _grams(x: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin of the n-gram that starts at each place, whether it lies in its text)."""
    n = len(x) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    h = np.full(n, order * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
    for k in range(order):
        h = (h ^ x[k : k + n]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    inside = np.ones(n + 1, bool)
    for k in range(1, order):
        ends = offsets[1:-1] - k
        inside[ends[(ends >= 0) & (ends < n)]] = False
    return (h >> np.uint64(64 - BITS)).astype(np.int64), inside[:n]


@dataclass(frozen=True)
class Model:
    languages: list[str]
    prior: np.ndarray
    weights: np.ndarray  # bins by languages: log-probabilities


def fit(docs: DataFrame, sample: int = SAMPLE, smooth: float = 0.5) -> Model:
    """``docs``: text, lang and doc_id of the rows that may teach."""
    docs = docs.filter("lang is not null and text is not null").select("doc_id", "text", "lang")
    n = docs.count()
    if n > sample:
        docs = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int((1 << 40) * sample / n))
    bits = BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, sums, rows = _tables(), {}, {}
        for batch in batches:
            data, off = text_bytes(batch.column(1))
            langs = np.array(batch.column(2).to_pylist(), object)
            for i, j in chunks(off, _CHUNK):
                x, at = _points(data[off[i] : off[j]], off[i : j + 1] - off[i], tables)
                for lang in set(langs[i:j]):
                    mine = langs[i:j] == lang
                    rows[lang] = rows.get(lang, 0) + int(mine.sum())
                    total = sums.setdefault(lang, np.zeros(1 << bits, np.int64))
                    chosen = np.repeat(mine, np.diff(at))
                    for order in ORDERS:
                        bins, inside = _grams(x, at, order)
                        total += np.bincount(bins[inside & chosen[: len(bins)]], minlength=1 << bits)
        names = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([rows[k] for k in names], pa.int64()), pa.array([sums[k].tobytes() for k in names], pa.binary())], names=["lang", "n", "bins"])

    taught = materialize(docs, "language-sample").coalesce(16)  # bounded: some sample documents
    sums: dict[str, np.ndarray] = {}
    rows: dict[str, int] = {}
    for r in taught.mapInArrow(count, "lang string, n long, bins binary").collect():  # 16 rows of 256 kB a language, at most
        sums[r.lang] = sums.get(r.lang, 0) + np.frombuffer(r.bins, np.int64)
        rows[r.lang] = rows.get(r.lang, 0) + r.n
    names = sorted(sums)
    if not names:
        return Model([], np.zeros(0), np.zeros((1 << bits, 0), np.float32))
    counts = np.array([sums[k] for k in names], float) + smooth
    prior = np.log(np.array([rows[k] for k in names], float) / sum(rows.values()))
    return Model(names, prior, np.ascontiguousarray(np.log(counts / counts.sum(1, keepdims=True)).T.astype(np.float32)))


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``'s columns, lang_pred and score (the posterior probability)."""
    n_keep = len(keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, model = _tables(), shared.value
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            data, off = text_bytes(batch.column(n_keep))
            best, score = np.full(batch.num_rows, len(model.languages)), np.zeros(batch.num_rows)
            for i, j in chunks(off, _CHUNK):
                x, at = _points(data[off[i] : off[j]], off[i : j + 1] - off[i], tables)
                some = np.flatnonzero(np.diff(at) > 0)
                if not len(some) or not model.languages:
                    continue
                total = np.tile(model.prior, (len(some), 1))
                for order in ORDERS:
                    bins, inside = _grams(x, at, order)
                    bins, upto = bins[inside], np.concatenate([[0], np.cumsum(inside)])
                    a, z = upto[np.minimum(at[some], len(inside))], upto[np.minimum(at[some + 1], len(inside))]
                    own = np.flatnonzero(z > a)
                    if len(own):
                        total[own] += np.add.reduceat(model.weights[bins], a[own], axis=0)
                total -= total.max(1, keepdims=True)
                chance = np.exp(total)
                chance /= chance.sum(1, keepdims=True)
                best[i + some], score[i + some] = chance.argmax(1), chance.max(1)
            columns = [*batch.columns[:n_keep], pa.array(names[best].tolist(), pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "lang_pred", "score"])

    picked = docs.select(*keep, F.col(text).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:n_keep])
    return picked.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def op4_language(docs: DataFrame) -> DataFrame:
    """The contract of op4: doc_id, held_out, lang_pred, score; rows held out never teach."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    docs = docs.select("doc_id", "text", "lang", held.alias("held_out"))
    model = fit(docs.filter(~F.col("held_out")))
    return predict(docs, model, ["doc_id", "held_out"])
