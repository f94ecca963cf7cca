"""Many terms in many texts: one automaton for all terms, one pass over each text.

For some dozen terms a chain of ``contains`` (see ``text.first_token``) is faster; here the time of a text does not depend on
how many terms there are. The terms come to the driver behind a check of their number and size, the automaton is built there
once and broadcast, and tasks read texts as Arrow batches.

A text that holds a term many times is passed over quickly all the same: a term counts once. Defined cases: a null text has no
hits; empty and null terms never hit; of terms that are listed twice the first counts; of no terms there are no hits.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TERMS = 1_000_000
MAX_SIGNS = 16_000_000  # of all terms together: an automaton of some hundred MB


def build(terms: list[str]) -> bytes | None:
    """The automaton of ``terms``, in their order, as bytes that tasks can load; None without terms."""
    machine = ahocorasick.Automaton()
    for rank, term in enumerate(terms):
        if term and term not in machine:
            machine.add_word(term, rank)
    if not len(machine):
        return None
    machine.make_automaton()
    return pickle.dumps(machine)


def ranks(machine: ahocorasick.Automaton, text: str) -> set[int]:
    """The numbers of the terms that occur in ``text``."""
    return {rank for _, rank in machine.iter(text)}


def vocabulary(terms: DataFrame, term: str = "term", rank: str = "rank") -> list[str]:
    """The terms of a table in the order of their rank (and then their own). Fails where they are too many to broadcast: such a
    vocabulary has to be scanned in several parts, whose first hits and counts are joined by rank and sum."""
    size = terms.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(term)), F.lit(0)).alias("signs")).first()
    if size.n > MAX_TERMS or size.signs > MAX_SIGNS:
        raise ValueError(f"{size.n} terms of {size.signs} signs: at most {MAX_TERMS} and {MAX_SIGNS} are broadcast; scan them in parts")
    return [r[0] for r in terms.orderBy(rank, term).select(term).collect()]


def term_hits(df: DataFrame, column: str, terms: list[str] | DataFrame, keep: list[str]) -> DataFrame:
    """``keep``'s columns, and of each text: ``first`` (the hit of lowest rank; null without one), ``n`` (how many different terms
    hit) and ``hits`` (all of them by rank)."""
    terms = vocabulary(terms) if isinstance(terms, DataFrame) else list(terms)
    shared = df.sparkSession.sparkContext.broadcast((terms, build(terms)))
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, packed = shared.value
        machine = pickle.loads(packed) if packed else None
        for batch in batches:
            found = [sorted(ranks(machine, t.as_py())) if machine and t.is_valid else [] for t in batch.column(n)]
            hits = [[terms[k] for k in f] for f in found]
            cols = [pa.array([h[0] if h else None for h in hits], pa.string()), pa.array([len(h) for h in hits], pa.int32()), pa.array(hits, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *cols], names=[*keep, "first", "n", "hits"])

    picked = df.select(*keep, F.col(column).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:n])
    return picked.mapInArrow(run, f"{kinds}, first string, n int, hits array<string>")
