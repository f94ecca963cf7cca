"""Corpus pipeline: raw documents -> packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and all but the last return the columns of
``documents``. ``run`` cuts lineage between stages with a table in the shared folder. A stage that drops rows first writes
its input with a key for each row, decides on that key and drops by it, so null and repeated ids do no harm.

``run`` deletes what a stage left in the shared folder once that stage's output is written; what the packed result itself reads
stays until ``postloom.llm.common.release``. So any number of runs may go on in a session. Whoever calls the stages of ``STAGES``
one by one writes each result before going on: the second to the last stage delete what the one before them left. A first stage
deletes nothing, and nothing of a last stage is deleted.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm import decontaminate, exact_dedup, near_dedup, packing, quality
from postloom.llm.common import drop, keep, materialize, numbered, read, scratch

ROW = "_row"
_HELD: list[tuple[str, str]] = []  # what the last stage left, where stages are called one by one


def stage(f):
    """A stage that may be called by itself; ``run`` calls the function inside."""

    @functools.wraps(f)
    def work(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if f.__name__ == STAGES[0][1].__name__:
            _HELD.clear()  # of another series of calls, whose result may still be read
        drop(spark, _HELD)
        with scratch([] if f.__name__ == STAGES[-1][1].__name__ else _HELD) as own:
            out = f(spark, docs, sf_dir)
        keep(own if own is not _HELD else [])
        return out

    return work


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    return rows.join(gone.select(ROW), ROW, "left_anti").drop(ROW)


@stage
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for the highest grade."""
    scored = quality.score(docs, quality.fit(docs, read(spark, sf_dir, "labels")))
    return scored.filter(F.col("tail_probability") >= quality.LEAST).select(*docs.columns)


@stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The longest document of each text, white space aside."""
    rows = numbered(docs, ROW, "rows")
    return _without(rows, exact_dedup.extra(rows, ROW))


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8 or more on shingles of five words."""
    rows = numbered(docs, ROW, "rows")
    return _without(rows, near_dedup.near_dedup(rows, near_dedup.Settings(), ROW).filter(~F.col("kept")))


@stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    rows = numbered(docs, ROW, "rows")
    found = decontaminate.op8_decontaminate(rows.select(F.col(ROW).alias("doc_id"), "text"), read(spark, sf_dir, "benchmark"))
    return _without(rows, found.filter("contaminated").withColumnRenamed("doc_id", ROW))


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences and their places."""
    return packing.op2_packing(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

ORACLE_SQL = None  # a fitted classifier, MinHash and a tokenizer have no SQL; see tests/llm/test_pipeline.py


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), []
    for name, work in STAGES[:-1]:
        with scratch([]) as own:
            out = work.__wrapped__(spark, docs, sf_dir)
        with scratch([]) as written:
            docs = materialize(out, name.replace(" ", "-").lower())
        drop(spark, own + before)
        before = written
    keep(before)
    return STAGES[-1][1].__wrapped__(spark, docs, sf_dir)
