"""Embedding of texts by a model of the caller's, and similarity to many profiles by blocked matrix products."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

Model = Callable[[list[str]], np.ndarray]  # texts -> [texts, components]

MAX_PROFILES = 100_000
MAX_COMPONENTS = 1 << 25  # of all profile vectors together: 256 MB of doubles at a broadcast
BLOCK = 1 << 22  # scores that are held at once


def embedder(load: Callable[[], Model]) -> Callable[[Column], Column]:
    """A column function of texts to vectors. ``load`` runs once in a task, before its first batch; a null text counts as empty."""

    @F.pandas_udf(ArrayType(FloatType()))
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            found = np.asarray(model(texts.fillna("").tolist()), np.float32)
            yield pd.Series(list(found.reshape(len(texts), -1)))

    return vectors


def sign_counts() -> Model:
    """A model without a file: how often each letter from a to z occurs, in lower case. A stand-in for tests and examples."""

    def model(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), 26), np.float32)
        for k, text in enumerate(texts):
            data = np.frombuffer(text.lower().encode(), np.uint8)
            out[k] = np.bincount(data[(data >= 97) & (data < 123)] - 97, minlength=26)
        return out

    return model


def _rows(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(known, unit vectors): which rows have a vector, and the vectors at length 1; one without a length, or with other than
    ``width`` components, is a row of zeros."""
    sizes = np.asarray(column.value_lengths().fill_null(0), np.int64)
    flat = column.flatten().cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    ends, fit = np.cumsum(sizes), sizes == width
    out = np.zeros((len(sizes), width))
    if fit.any() and width:
        out[fit] = flat[(ends - sizes)[fit][:, None] + np.arange(width)]
    size = np.sqrt((out * out).sum(1, keepdims=True))
    return np.asarray(column.is_valid()), np.divide(out, size, out=np.zeros_like(out), where=size > 0)


def similar(df: DataFrame, vector: str, profiles: DataFrame, profile: str, profile_vector: str, keep: list[str], least: float = 0.0, top: float = 0.85) -> DataFrame:
    """``keep``'s columns, the profile and embedding_score of each row with each profile that it is ``least`` similar to: the
    cosine, with [0, ``top``] mapped to [0, 1] and clamped. A batch of rows meets blocks of profiles as a matrix product, so pairs
    below ``least`` are never rows. Profiles come to the driver behind a check of their number and size.

    A row without a vector gives no pair; a vector without a length, or of another length than the profiles', has score 0.
    """
    n = profiles.count()
    width = profiles.agg(F.max(F.size(profile_vector))).first()[0] or 0
    if n > MAX_PROFILES or n * width > MAX_COMPONENTS:
        raise ValueError(f"{n} profiles of {width} components: at most {MAX_PROFILES}, and {MAX_COMPONENTS} components, are broadcast; score them in parts")
    held = profiles.filter(F.col(profile_vector).isNotNull()).select(profile, profile_vector).orderBy(profile).toArrow().combine_chunks()
    ids = held.column(0).combine_chunks() if held.num_rows else pa.array([], held.schema.field(0).type)
    _, sides = _rows(held.column(1).combine_chunks() if held.num_rows else pa.array([], pa.list_(pa.float64())), width)
    shared = df.sparkSession.sparkContext.broadcast((ids, sides))
    at = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sides = shared.value
        for batch in batches:
            known, own = _rows(batch.column(at), width)
            step = max(1, BLOCK // max(1, len(own)))
            for i in range(0, len(sides), step):
                score = np.clip(own @ sides[i : i + step].T / top, 0.0, 1.0)
                x, y = np.nonzero((score >= least) & known[:, None])
                cols = [*(c.take(pa.array(x)) for c in batch.columns[:at]), ids.take(pa.array(i + y)), pa.array(score[x, y])]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, profile, "embedding_score"])

    picked = df.select(*keep, vector)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*picked.schema.fields[:at], profiles.schema[profile]])
    return picked.mapInArrow(run, f"{kinds}, embedding_score double")
