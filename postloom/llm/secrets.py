"""Secret scans.

Three fixed patterns give the base spans. Besides, values that stand in a credential context (a credential word, a
separator, a value) get a guess cost: the cheapest segmentation of the value into dictionary words, dates, repeats,
sequences, keyboard walks and brute-force spans, found by dynamic programming and given as log10 of the guesses. Values that
cost at least ``least`` are reported as spans of kind ``guess``. The dictionary is ranked: the words that passwords are made of,
then, for callers that have one, words of their own. The corpus under test gives none: a secret that leaked into many documents
would become a word of it and hide itself. ``frequent_words`` makes such a dictionary from another, trusted corpus.

Each document is read on its own and whole, so what is found in a text does not depend on other documents. The minimum is over all segmentations: spans of bounded
length (words, dates) are tried one by one, and for spans of any length (repeats, sequences, walks) the price grows with the
logarithm of the length, so the best start for each end comes from a stack of candidates that overtake each other once. The
time is linear in the value.

Defined cases: a null or empty text has no spans; repeated rows each have their result; an empty table gives an empty
result; columns of the input besides the chosen ones are not looked at.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, coded_words, materialize, text_bytes

# Fixed values of the base kinds, in the order in which spans at one place are listed.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # 16 characters or more
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "guess")

# Credential words, in lower case.
CONTEXT_WORDS = ("passw", "passphrase", "pwd", "secret", "token", "apikey", "api_key", "api-key", "credential",
                 "private_key", "access_key", "auth_key", "bearer")
_BASE_WORDS = ("passw", "secret", "token", "apikey", "api_key")
CONTEXT = re.compile(
    r"""(?ai:passw(?:or)?d|passphrase|pwd|(?:client_)?secret|token|api[_-]?key|credentials?|(?:private|access|auth)_key|\bbearer)"""
    r"""(?ai:_[a-z]{1,10}){0,2}["']?(?:[\x20\t]{0,3}(?:=>|->|:=|[:=])|\x20(?ai:is|was)\x20|(?<=[Rr])\x20)[\x20\t]{0,3}["'`]?([^\x00-\x20"'`<>,;]{6,})"""
)

# Frequent words of passwords, most frequent first; a word's rank is the number of guesses it takes.
WORDS = (
    "password pass admin welcome letmein master login hello dragon monkey shadow sunshine princess football baseball "
    "superman batman trust summer winter spring autumn secret token root user guest test demo default change changeme me "
    "love iloveyou star freedom whatever ninja cookie orange purple silver golden computer internet server system service "
    "backup database oracle google apple amazon linux ubuntu windows company office manager account access private public "
    "key api my the and for you not this that with from our your example sample placeholder dummy none null true false "
    "january february march april may june july august september october november december monday tuesday wednesday "
    "thursday friday saturday sunday"
).split()
RANK = {w: i + 1 for i, w in reversed(list(enumerate(WORDS)))}
LONGEST_WORD = max(map(len, WORDS))
# Signs often put for letters.
LEET = str.maketrans("@4380!1$57+", "aaebolisstt")
# The rows of a keyboard.
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_AT = {c: (y, x + y / 2) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
NEXT = {c: {d for d in _AT if d != c and abs(_AT[c][0] - _AT[d][0]) <= 1 and abs(_AT[c][1] - _AT[d][1]) <= 1} for c in _AT}
_YEAR, _MONTH, _DAY = r"(?:19|20)\d\d", r"(?:1[0-2]|0?[1-9])", r"(?:3[01]|[12]\d|0?[1-9])"
DATE = re.compile(rf"{_YEAR}([-/._]?){_MONTH}\1{_DAY}|{_DAY}([-/._]?){_MONTH}\2{_YEAR}|{_YEAR}")
DATE_LENGTHS = (4, 6, 7, 8, 9, 10)
TURN = 0.7  # log10 of the guesses for each straight part of a walk
DICTIONARY = 20_000  # words of a trusted corpus that count as words; a broadcast of some 300 kB
SHORTEST, LONGEST = 3, 20  # letters of such a word
SEEN = 10  # times that it occurs at least
LEAST = 9.0  # log10 of the guesses from which a value counts as a secret
JOINT = math.log10(2)  # for each further span of a segmentation


def _sign_cost(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 100)


class _Run:
    """The spans of any length in one kind of run: the cheapest span that ends at each place.

    A span [i, j) of a run costs ``worth[i] + log10(j - i)`` (and what depends on j alone). Of two starts the older one, if it
    is worth no more, overtakes the newer at a known place and stays ahead. So the stack holds starts from old to new, where
    each is overtaken by the one below it, the upper ones first.
    """

    def __init__(self, least: int):
        self.least, self.begin, self.stack = least, 0, []  # (start, worth)

    def restart(self, at: int) -> None:
        self.begin, self.stack = at, []

    @staticmethod
    def _overtakes(old: tuple[int, float], new: tuple[int, float]) -> float:
        """The place from which the older start is as cheap as the newer one."""
        d = new[1] - old[1]
        if d <= 0:
            return math.inf
        if d > 300:
            return new[0]
        grown = 10.0**d
        return (grown * new[0] - old[0]) / (grown - 1)

    def add(self, start: int, worth: float, at: int) -> None:
        new, stack = (start, worth), self.stack
        while stack:
            meet = self._overtakes(stack[-1], new)
            if meet <= at:
                return
            if meet == math.inf or len(stack) > 1 and meet >= self._overtakes(stack[-2], stack[-1]):
                stack.pop()
            else:
                break
        stack.append(new)

    def cheapest(self, at: int) -> tuple[float, int] | None:
        stack = self.stack
        while len(stack) > 1 and self._overtakes(stack[-2], stack[-1]) <= at:
            stack.pop()
        return (stack[-1][1] + math.log10(at - stack[-1][0]), stack[-1][0]) if stack else None


def _word_cost(value: str, low: str, plain: str, i: int, j: int, ranks: dict[str, int]) -> float:
    """Of [i, j) as a word: its rank, and whether letters are large or replaced by other signs."""
    cost = min((math.log10(rank + 1) + extra for text, extra in ((low, 0.0), (plain, 0.6)) if (rank := ranks.get(text[i:j]))), default=math.inf)
    return cost if value[i:j] == low[i:j] else cost + (0.3 if value[i + 1 : j] == low[i + 1 : j] else 1.0)


def segmentation(value: str, ranks: dict[str, int] = RANK, longest: int = LONGEST_WORD) -> tuple[float, list[tuple[str, int, int]]]:
    """log10 of the guesses that ``value`` takes, and its cheapest segmentation as (kind, start, end)."""
    n = len(value)
    low = value.lower()
    low = low if len(low) == n else value
    plain = low.translate(LEET)
    ways = [_way(low, k) if low[k + 1] in NEXT.get(low[k], ()) else None for k in range(n - 1)]
    turns = [0] * (n + 1)  # turns before each place
    for k in range(1, n - 1):
        turns[k + 1] = turns[k] + (ways[k - 1] != ways[k])
    joined = {
        "repeat": lambda k: low[k] == low[k + 1], "up": lambda k: ord(low[k + 1]) - ord(low[k]) == 1,
        "down": lambda k: ord(low[k]) - ord(low[k + 1]) == 1, "walk": lambda k: ways[k] is not None,
    }
    runs = {kind: _Run(4 if kind == "walk" else 3) for kind in joined}
    best = [0.0] + [math.inf] * n
    back: list[tuple[str, int]] = [("", 0)] * (n + 1)
    brute, began = math.inf, 0  # the cheapest segmentation that ends in a brute-force span, and where that span begins
    for j in range(1, n + 1):
        sign, fresh = _sign_cost(value[j - 1]), best[j - 1] + (JOINT if j > 1 else 0.0)
        if fresh < brute:
            brute, began = fresh, j - 1
        brute += sign
        offers = [(brute, "brute", began)]
        for i in range(max(0, j - longest), j - 1):
            if (cost := _word_cost(value, low, plain, i, j, ranks)) < math.inf:
                offers.append((best[i] + (JOINT if i else 0.0) + cost, "word", i))
        if value[j - 1].isdigit():
            for size in DATE_LENGTHS:
                if size <= j and DATE.fullmatch(value, j - size, j):
                    i = j - size
                    offers.append((best[i] + (JOINT if i else 0.0) + math.log10(150 if size == 4 else 365 * 150), "date", i))
        for kind, run in runs.items():
            if j > 1 and not joined[kind](j - 2):
                run.restart(j - 1)
            i = j - run.least
            if i >= run.begin:
                run.add(i, best[i] + (JOINT if i else 0.0) - (TURN * turns[i + 1] if kind == "walk" else 0.0), j)
            if found := run.cheapest(j):
                cost, i = found
                cost += sign if kind == "repeat" else math.log10(len(_AT)) + TURN * (turns[j - 1] + 1) if kind == "walk" else 1.0
                offers.append((cost, "sequence" if kind in ("up", "down") else kind, i))
        best[j], *where = min(offers)
        back[j] = tuple(where)
    spans, j = [], n
    while j:
        kind, i = back[j]
        spans.append((kind, i, j))
        j = i
    return best[n], spans[::-1]


def _way(s: str, k: int) -> tuple[float, float]:
    (y0, x0), (y1, x1) = _AT[s[k]], _AT[s[k + 1]]
    return y1 - y0, x1 - x0


_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def frequent_words(docs: DataFrame, text: str = "text", n: int = DICTIONARY) -> list[str]:
    """The most frequent words (runs of the letters a to z, in lower case) of all texts, the most frequent first: those of the
    highest steps of frequency (eight for each doubling) that have ``n`` words at most together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_bytes(batch.column(0))
            for i, j in chunks(off, 4 << 20):
                code, held, _ = coded_words(_LOWER[data[off[i] : off[j]]], off[i : j + 1] - off[i], _LETTER)
                size = pc.binary_length(held).to_numpy()
                fit = np.flatnonzero((size >= SHORTEST) & (size <= LONGEST))
                count = np.bincount(code, minlength=len(held))[fit]
                yield pa.RecordBatch.from_arrays([held.take(pa.array(fit)).cast(pa.binary()).cast(pa.string()), pa.array(count)], names=["word", "n"])

    counts = docs.select(text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialize(counts.filter(F.col("n") >= SEEN).withColumn("step", F.floor(8 * F.log2("n")).cast("int")), "word-counts")
    left, least = n, 1 << 20
    for r in sorted(counts.groupBy("step").agg(F.count("*").alias("k")).collect(), reverse=True):  # 512 rows at most
        if r.k > left:
            break
        left, least = left - r.k, r.step
    chosen = counts.filter(F.col("step") >= least).select("word", "n").collect()  # n rows at most
    return [r.word for r in sorted(chosen, key=lambda r: (-r.n, r.word))]


def ranked(words: list[str]) -> dict[str, int]:
    """The guesses that each word takes: the password words first, then ``words``."""
    return {w: i + 1 for i, w in reversed(list(enumerate([*WORDS, *words])))}


def find(text: str, least: float = LEAST, ranks: dict[str, int] = RANK, longest: int = LONGEST_WORD) -> list[dict]:
    """All spans of a text by start, then kind as listed. Base spans cover the whole match, ``guess`` spans the value."""
    spans = []
    low = text.lower()
    if any(w in low for w in _BASE_WORDS):
        for m in ASSIGN.finditer(text):
            if m.end(1) - m.start(1) >= 8:
                spans.append({"kind": "assign", "start": m.start(), "end": m.end(), "log10_guesses": segmentation(m[1], ranks, longest)[0]})
    if "AKIA" in text:
        spans += [{"kind": "access", "start": m.start(), "end": m.end(), "log10_guesses": None} for m in ACCESS.finditer(text)]
    spans += [{"kind": "hex", "start": m.start(), "end": m.end(), "log10_guesses": None} for m in HEX.finditer(text)]
    if any(w in low for w in CONTEXT_WORDS):
        for m in CONTEXT.finditer(text):
            value = m[1].rstrip(".:!?)]}")
            if len(value) >= 6 and (cost := segmentation(value, ranks, longest)[0]) >= least:
                spans.append({"kind": "guess", "start": m.start(1), "end": m.start(1) + len(value), "log10_guesses": cost})
    spans.sort(key=lambda s: (s["start"], KINDS.index(s["kind"])))
    return spans


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("log10_guesses", pa.float64())]))


def scan(df: DataFrame, keep: list[str], text: str = "text", least: float = LEAST, words: list[str] = ()) -> DataFrame:
    """``keep``'s columns and ``secrets``: array of (kind, start, end, log10_guesses), places in code points. ``words``: of
    the dictionary, beside those of passwords."""
    n = len(keep)
    ranks = ranked(list(words))
    shared = df.sparkSession.sparkContext.broadcast((ranks, max(map(len, ranks))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, longest = shared.value
        for batch in batches:
            found = pa.array([find(t.as_py() or "", least, ranks, longest) for t in batch.column(n)], _SPANS)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], found], names=[*keep, "secrets"])

    picked = df.select(*keep, F.col(text).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:n])
    spans = "secrets array<struct<kind:string,start:int,end:int,log10_guesses:double>>"
    return picked.mapInArrow(run, f"{kinds}, {spans}")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op1_secrets(docs: DataFrame) -> DataFrame:
    """The contract of op1: counts of base kinds, digest of base spans, all spans; with the costliest value's cost."""
    found = scan(docs, ["doc_id"])
    of = lambda k: F.size(F.filter("secrets", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(of(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(_listed(F.filter("secrets", lambda x: x["kind"] != "guess")), 256).alias("base_sha256"),
        _listed(F.col("secrets")).alias("spans"),
        of("guess").alias("n_guess"),
        F.round(F.array_max(F.transform("secrets", lambda x: x["log10_guesses"])), 3).alias("max_log10_guesses"),
    )
