"""Joins and set operations.

A side is broadcast only where it is a vocabulary or policy table whose size is checked; other joins are left to Catalyst,
which picks broadcast, hash or sort-merge by statistics and splits skewed keys at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import url as U
from ..functions.identity import posting_key, short_id
from ..functions.text import empty
from .filters import top_per

MAX_SMALL = 10_000  # rows of a policy or alias table


def small(df: DataFrame, most: int = MAX_SMALL) -> DataFrame:
    """A broadcast of a table that has at most ``most`` rows; fails for a larger one."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"a table of policies or aliases has more than {most} rows")
    return F.broadcast(df)


def with_key(df: DataFrame) -> DataFrame:
    return df.withColumn("key", posting_key(F.col("company"), F.col("source_id")))


def first_per_key(df: DataFrame, key: str = "key", order: tuple[str, ...] = ("scraped_at", "source_id")) -> DataFrame:
    """The first row of each key. Spark limits the groups before the shuffle too, so a hot key crosses the network as one row a
    task, and columns that no later step needs are pruned."""
    return top_per(df, [key], [F.col(c) for c in order])


def only_new(df: DataFrame, seen: DataFrame) -> DataFrame:
    """First-wins rows whose key was not seen."""
    return first_per_key(df).join(seen.select("key"), "key", "left_anti")


def lookup_short(ids: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows of ``seen`` for short ids of exactly 16 signs."""
    ids = ids.filter(F.length("short_id") == 16)
    return ids.join(seen.withColumn("short_id", short_id(F.col("key"))), "short_id")


def merge_overrides(base: DataFrame, over: DataFrame, key: str = "name", columns: tuple[str, ...] = ()) -> DataFrame:
    """Left join; what the override holds (not null, and for text not blank) wins."""
    columns = columns or tuple(c for c in over.columns if c != key)
    over = over.select(key, *(F.col(c).alias(f"_o_{c}") for c in columns))
    kinds = dict(over.dtypes)
    joined = base.join(over, key, "left")

    def one(c: str) -> Column:
        o = F.col(f"_o_{c}")
        o = T.non_empty(o) if kinds[f"_o_{c}"] == "string" else o
        return F.coalesce(o, F.col(c)) if c in base.columns else o

    kept = [c for c in base.columns if c not in columns]
    return joined.select(*kept, *(one(c).alias(c) for c in columns))


def match_policy(rows: DataFrame, policies: DataFrame, domain: str, default: dict[str, object], key: str) -> DataFrame:
    """The policy whose domain is the longest suffix of a row's; else the default. A row's suffixes are generated and joined
    by equality, so this is no nested loop."""
    host = F.lower(empty(F.col(domain)))
    suffix = rows.select(key, host.alias("_host")).withColumn("_at", F.explode(F.sequence(F.lit(1), F.greatest(F.length("_host"), F.lit(1)))))
    suffix = suffix.select(key, F.expr("substring(_host, _at)").alias("_suffix"))
    values = [c for c in policies.columns if c != "policy"]
    hit = suffix.join(small(policies.withColumnRenamed("policy", "_suffix")), "_suffix")
    best = hit.groupBy(key).agg(F.max_by(F.struct(F.col("_suffix").alias("policy"), *values), F.length("_suffix")).alias("_p"))
    joined = rows.join(best, key, "left")
    return joined.select(*rows.columns, F.coalesce("_p.policy", F.lit("default")).alias("policy"), *(F.coalesce(F.col(f"_p.{v}"), F.lit(default[v])).alias(v) for v in values))


def in_set(df: DataFrame, members: DataFrame, key: str) -> DataFrame:
    return df.join(members.select(key).distinct(), key, "left_semi")


def not_in_set(df: DataFrame, members: DataFrame, key: str) -> DataFrame:
    return df.join(members.select(key).distinct(), key, "left_anti")


def grams(text: Column, sizes: list[int]) -> Column:
    """All different runs of ``sizes`` signs."""

    def runs(k: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (k - 1), F.lit(1))), lambda i: F.substr(text, i, F.lit(k)))

    return F.array_distinct(F.concat(*map(runs, sizes)))


def containing(texts: DataFrame, parts: DataFrame, text: str = "text", part: str = "part", size: int = 3) -> DataFrame:
    """Rows of ``texts`` and ``parts`` (its other columns come along) where the text contains the part: an equi-join on a run of
    signs, then an exact test. Of each part one run is the key, the one that the fewest parts have; blank parts are left out."""
    held = parts.filter(F.length(part) > 0).withColumn("_k", F.least(F.length(part), F.lit(size)))
    lengths = sorted(r[0] for r in held.select("_k").distinct().collect()) or [size]  # ``size`` numbers at most
    runs = held.select(part, "_k").distinct().withColumn("_g", F.explode(grams(F.col(part), lengths))).filter(F.length("_g") == F.col("_k"))
    often = runs.groupBy("_g").agg(F.count("*").alias("c"))
    key = runs.join(often, "_g").groupBy(part).agg(F.min_by("_g", F.struct("c", "_g")).alias("_g"))
    keyed = held.drop("_k").join(key, part)
    return texts.withColumn("_g", F.explode(grams(F.col(text), lengths))).join(keyed, "_g").filter(F.contains(F.col(text), F.col(part))).drop("_g")


def alias_lookup(names: DataFrame, aliases: DataFrame, name: str = "name", default: str = "default") -> DataFrame:
    """The value of the alias that equals a name, else of the first (by rank) that the name contains, else the default.

    aliases: alias, value, rank. Equal names meet by an equi-join; the different names without an equal alias meet the aliases that
    they contain by runs of signs (see ``containing``), so neither side need be small. A blank alias is in every name.
    """
    table = aliases.select(F.lower("alias").alias("_alias"), "value", "rank")
    low = F.lower(empty(F.col(name)))
    distinct = names.select(name).distinct().withColumn("_low", low)
    equal = distinct.join(table, F.col("_low") == F.col("_alias")).select(name, "value", "rank")
    rest = distinct.join(equal.select(name), name, "left_anti")
    found = containing(rest, table, "_low", "_alias").select(name, "value", "rank")
    best = equal.unionByName(found).groupBy(name).agg(F.min(F.struct("rank", "value")).alias("b"))
    blank = table.filter("_alias = ''").agg(F.min(F.struct("rank", "value")).alias("b")).first().b  # one row
    out = names.join(best, name, "left").join(equal.select(name).distinct().withColumn("_same", F.lit(True)), name, "left")
    value = F.coalesce(F.col("b.value"), F.lit(default if blank is None else blank.value))
    if blank is not None:
        value = F.when(F.col("_same").isNull() & (F.col("b.rank") > blank.rank), blank.value).otherwise(value)
    return out.select(*names.columns, value.alias("value"))


def match_roles(base: DataFrame, new: DataFrame) -> DataFrame:
    """Each base role's new role: the one of equal name, else the first that contains it or is contained in it.

    Both: doc, role, place. Adds new_role (null where there is none).
    """
    b = base.select("doc", F.lower(F.trim("role")).alias("_b"), "role", "place")
    n = new.select("doc", F.lower(F.trim("role")).alias("_n"), F.col("role").alias("new_role"), F.col("place").alias("_np"))
    close = (F.col("_b") == F.col("_n")) | F.contains("_b", F.col("_n")) | F.contains("_n", F.col("_b"))
    hit = b.join(n, "doc").filter(close)
    best = top_per(hit, ["doc", "place"], [(F.col("_b") != F.col("_n")).cast("int"), F.col("_np")])
    return base.join(best.select("doc", "place", "new_role"), ["doc", "place"], "left")


def union_postings(*sources: DataFrame) -> DataFrame:
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def matched_missing(left: Column, right: Column) -> tuple[Column, Column]:
    """(members of ``left`` that ``right`` has, the others), in the order of ``left``."""
    return F.array_intersect(left, right), F.array_except(left, right)


def distinct_urls() -> Column:
    """A company's own URL and its domain's, in this order, each once."""
    return F.array_distinct(F.array_compact(F.array("career_url", F.concat(F.lit("https://"), U.plain_domain(F.col("domain"))))))
