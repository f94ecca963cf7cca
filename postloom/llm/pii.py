"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Only DataFrame functions. Places come from the pieces between the matches: the pieces' and the matches' lengths add up to
the end of each match, in code points (prefix sums by doubling). Contexts come from chunks of ``CHUNK`` code points, found by
their number, so a text of n signs and m matches takes n + m log m steps. Every pattern begins where its run of characters begins (or where the last match
ended) and its loops are possessive, so matching is linear in the text and needs no stack, however long a run is.

Defined cases: a null or empty text has no spans; repeated rows each have their result; an empty table gives an empty
result; columns of the input besides the chosen ones are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    needs: str | None  # a string that every match holds, looked for before the pattern
    score: float  # of a confirmed span, before the context
    near: tuple[str, ...]  # words that make it likelier
    far: tuple[str, ...]  # words that make it less likely
    base: bool = True  # kept whatever its score


# The length of an account code by country, after the IBAN registry.
IBAN = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    """Codes of the listed countries at their own length, so what follows one is left out; other codes as far as they go, or
    to the next listed one."""
    known = "(?:" + "|".join(c for codes in IBAN.values() for c in codes.split()) + ")[0-9]{2}"
    own = "|".join(rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{size - 4}}}+(?![A-Za-z0-9])" for size, codes in IBAN.items())
    other = rf"(?!{known})[A-Z]{{2}}[0-9]{{2}}(?:(?!\x20{known})\x20?[A-Z0-9]){{11,30}}+(?![A-Za-z0-9])"
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{own}|{other})"


# The kinds in the order in which their spans are listed.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9,
         ("mail", "contact", "write"), ("example",)),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6,
         ("ip", "address", "host", "server"), ("version", "release")),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){12,}+", None, 0.7,
         ("card", "visa", "credit", "payment"), ("order", "serial")),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6,
         ("phone", "tel", "call", "mobile"), ("sum", "total")),
    Kind("iban", _iban(), None, 0.8,
         ("iban", "account", "bank"), (), False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.3,
         ("ssn", "social security", "tax id"), (), False),
)
CHUNK = 64  # code points of a chunk of text, at least WINDOW
WINDOW = 40  # code points of context on either side of a span
STEP = 0.2  # what a context word adds or takes
LEAST = 0.5  # score from which a span of the method's own kinds is reported


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    figures = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    weighed = F.transform(figures, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(weighed, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account code passes the mod-97 check: the first four signs moved behind, letters as 10 to 35."""
    plain = F.regexp_replace(code, " ", "")
    moved = F.split(F.concat(F.substring(plain, 5, 34), F.substring(plain, 1, 4)), "")
    value = lambda c: F.conv(c, 36, 10).cast("int")
    return F.aggregate(moved, F.lit(0), lambda a, c: (F.when(value(c) > 9, a * 100).otherwise(a * 10) + value(c)) % 97) == 1


def _confirmed(kind: str, found: Column) -> Column:
    if kind == "ip":
        parts = F.split(found, r"\.")
        return F.forall(parts, lambda x: F.ltrim(x, F.lit("0")).rlike("^[0-9]{0,3}$") & (F.right(x, F.lit(4)).cast("int") <= 255))
    if kind == "card":
        digits = _digits(found)
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(found)).between(9, 15)
    if kind == "iban":
        return mod97(found)
    if kind == "ssn":
        return ~found.rlike("^(000|666|9)|-00-|-0000$")
    return F.lit(True)


def _near(context: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, w: a | F.contains(context, F.lit(w)), words, F.lit(False))


def detect(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``'s columns and ``pii``: array of (kind, start, end, score), by kind as listed, then by place."""
    names = [k.name for k in KINDS]
    df = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    none = F.array().cast("array<string>")

    def proposals(k: Kind) -> Column:
        all_ = F.regexp_extract_all(F.col("_text"), F.lit(k.pattern), F.lit(0))
        return F.when(F.contains(F.col("_text"), F.lit(k.needs)), all_).otherwise(none) if k.needs else all_

    df = df.select("*", *(proposals(k).alias(f"_m_{k.name}") for k in KINDS))
    found_any = reduce(lambda a, n: a | (F.size(F.col(f"_m_{n}")) > 0), names, F.lit(False))
    chunks = F.when(found_any, F.regexp_extract_all(F.col("_text"), F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))).otherwise(none)

    def sums(steps: Column) -> Column:
        """The sums of all beginnings of an array: each round adds what stands 1, 2, 4, ... places before."""
        rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(steps))).cast("int"))
        before = lambda a, i, k: F.coalesce(F.get(a, i - F.pow(F.lit(2), k).cast("int")), F.lit(0))
        return F.aggregate(rounds, steps, lambda a, k: F.transform(a, lambda x, i: x + before(a, i, k)))

    def ends(k: Kind) -> Column:
        found = F.col(f"_m_{k.name}")
        pieces = F.slice(F.split(F.col("_text"), k.pattern, -1), F.lit(1), F.size(found))
        steps = F.zip_with(pieces, found, lambda p, m: F.length(p) + F.length(m))
        return F.when(F.size(found) > 0, sums(steps)).otherwise(F.array().cast("array<int>"))

    df = df.select("*", chunks.alias("_chunks"), *(ends(k).alias(f"_e_{k.name}") for k in KINDS))

    def part(start: Column, size: Column) -> Column:
        """``size`` code points of the text from ``start`` on; WINDOW at most."""
        number = F.floor(start / CHUNK).cast("int")
        own = lambda n: F.coalesce(F.get(F.col("_chunks"), n), F.lit(""))
        return F.substring(F.concat(own(number), own(number + 1)), start - CHUNK * number + 1, size)

    def spans(k: Kind) -> Column:
        both = F.arrays_zip(F.col(f"_m_{k.name}").alias("m"), F.col(f"_e_{k.name}").alias("e"))
        both = F.filter(both, lambda x: _confirmed(k.name, x["m"]))

        def scored(x: Column) -> Column:
            start = x["e"] - F.length(x["m"])
            size = F.least(start, F.lit(WINDOW))
            context = F.lower(F.concat_ws("\n", part(start - size, size), part(x["e"], F.lit(WINDOW))))
            score = k.score + F.when(_near(context, k.near), STEP).otherwise(0.0) - F.when(_near(context, k.far), STEP).otherwise(0.0)
            return F.struct(F.lit(k.name).alias("kind"), start.alias("start"), x["e"].alias("end"), F.round(F.least(score, F.lit(1.0)), 2).alias("score"))

        out = F.transform(both, scored)
        out = out if k.base else F.filter(out, lambda x: x["score"] >= LEAST)
        none_ = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
        return F.when(F.size(F.col(f"_m_{k.name}")) > 0, out).otherwise(none_)

    df = df.select("*", *(spans(k).alias(f"_s_{k.name}") for k in KINDS))
    return df.select(*keep, F.concat(*(F.col(f"_s_{n}") for n in names)).alias("pii"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op3_pii(docs: DataFrame) -> DataFrame:
    """The contract of op3: counts of the base kinds, digest of base spans, all spans, and each span's score."""
    base = [k.name for k in KINDS if k.base]
    found = detect(docs, ["doc_id"])
    of = lambda n: F.size(F.filter("pii", lambda x: x["kind"] == n)).cast("long")
    return found.select(
        "doc_id",
        *(of(n).alias(f"n_{n}") for n in base),
        F.sha2(_listed(F.filter("pii", lambda x: x["kind"].isin(base))), 256).alias("base_sha256"),
        _listed(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda x: x["score"].cast("string")), ",").alias("scores"),
    )
