"""Text expressions: Column -> Column, no UDFs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def empty(c: Column) -> Column:
    """Null as the empty string."""
    return F.coalesce(c, F.lit(""))


def non_empty(c: Column) -> Column:
    """The empty string as null."""
    return F.when(c != "", c)


def first_token(text: Column, tokens: list[str]) -> Column:
    """The first of ``tokens``, in their order, that occurs in ``text``; null if none does. One compiled chain."""
    return F.coalesce(*(F.when(F.contains(text, F.lit(t)), t) for t in tokens), F.lit(None).cast("string"))


def count_tokens(text: Column, tokens: list[str]) -> Column:
    """How many of ``tokens`` occur in ``text``."""
    return reduce(lambda a, t: a + F.contains(text, F.lit(t)).cast("int"), tokens, F.lit(0))


def has_token(text: Column, tokens: list[str]) -> Column:
    return reduce(lambda a, t: a | F.contains(text, F.lit(t)), tokens, F.lit(False))


def first_of(text: Column, tokens: Column) -> Column:
    """``first_token`` for an array column of lower-case tokens; empty ones never match."""
    return F.get(F.filter(tokens, lambda t: (t != "") & F.contains(text, t)), F.lit(0))


def phrase_present(low: Column, needle: Column) -> Column:
    """Whether a phrase occurs: as a substring if it has a space or one of ``+#.-``, else as a whole word. A pattern is tried
    only where the phrase is a substring, as each phrase's pattern must be compiled."""
    n = F.lower(F.trim(needle))
    word = F.contains(low, n) & F.regexp_like(low, F.concat(F.lit(r"(?U)\b\Q"), n, F.lit(r"\E\b")))
    return F.when(n == "", False).when(n.rlike(r"[ +#.\-]"), F.contains(low, n)).otherwise(word)


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def strip_html(c: Column) -> Column:
    """Tags become spaces, white space is collapsed, entities stay, stray ``>`` go."""
    return collapse(F.regexp_replace(F.regexp_replace(c, r"<[^>]*(>|$)", " "), ">", ""))


def trim_html(c: Column, limit: int = 60_000) -> Column:
    """Scripts, styles and comments become spaces, white space is collapsed, the rest is cut at ``limit``."""
    for tag in ("script", "style"):
        c = F.regexp_replace(c, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", " ")
    return F.substring(F.regexp_replace(c, r"\s+", " "), 1, limit)


def anchor_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?i)<a[\s>]"))


def strip_markdown(c: Column) -> Column:
    return F.regexp_replace(c, r"[*_\[\]()]", "")


def percent(c: Column) -> Column:
    """A share as whole percents, half to even."""
    return F.bround(c * 100, 0).cast("int")


def fixed(c: Column, places: int) -> Column:
    """A number with a fixed count of places."""
    return F.format_string(f"%.{places}f", F.bround(c, places))


def bullet_key(c: Column) -> Column:
    return collapse(F.lower(F.trim(c)))


def strip_marker(c: Column) -> Column:
    """Drops a list marker at the start."""
    return F.regexp_replace(c, r"^\s*(?:[-*•]|\d+[.)])\s+", "")


def slug(c: Column, size: int = 40) -> Column:
    return F.substring(F.regexp_replace(c, r"[^\p{L}\p{N}_-]", "-"), 1, size)


def loose_json(c: Column) -> Column:
    """JSON text without code fences."""
    return F.trim(F.regexp_replace(F.trim(c), r"(?m)^```(?:json)?\s*|\s*```$", ""))


def coerce_int(c: Column) -> Column:
    """An index from text: digits, or the part after a dot; anything else (also booleans) is null."""
    t = F.trim(c)
    dotted = F.regexp_extract(t, r"^\d+\.(\d+)$", 1)
    return F.when(t.rlike(r"^\d+$"), F.try_to_number(t, F.lit("9" * 18))).when(dotted != "", F.try_to_number(dotted, F.lit("9" * 18))).cast("int")


def numbers(c: Column) -> Column:
    """The different numbers of a text, with their units."""
    found = F.regexp_extract_all(c, F.lit(r"(\$?\d[\d,.]*\s*(?:%|x|k|m|b|ms|s|\+)?)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.lower(F.trim(x))))


def scrub_sentences(c: Column, words: list[str]) -> Column:
    """Drops every sentence that has one of ``words`` as a word; white space is collapsed."""
    sentences = F.split(c, r"(?<=[.!?])\s+")
    pattern = r"(?iU)\b(?:" + "|".join(words) + r")\b"
    return collapse(F.array_join(F.filter(sentences, lambda x: ~x.rlike(pattern)), " "))


def yes_no(c: Column) -> Column:
    return F.when(c, "Yes").otherwise("No")
