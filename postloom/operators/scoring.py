"""Scoring of postings against profiles: rules, caps, reasons, legitimacy.

Everything is an expression over the row: scoring adds no shuffle. Profiles are a small table that is broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..functions import vector as V
from ..functions.text import empty
from ..functions.time import age_days
from ..vocab import Vocabulary
from .aggregates import SLICE, longest_log, time_slices

MAX_PROFILES = 1000  # the profile side of a fan-out is broadcast


def embed_text(limit: int = 1500) -> Column:
    """The text of a posting that is embedded."""
    head = F.concat(empty(F.col("title")), F.lit(" at "), empty(F.col("company")), F.lit("\n\n"))
    return F.regexp_replace(F.concat(head, F.substring(empty(F.col("description_text")), 1, limit)), r"^\s+|\s+$", "")


def profile_text() -> Column:
    return F.regexp_replace(F.concat(empty(F.col("profile_summary")), F.lit("\n\nCore skills: "), F.array_join("core_skills", ", ")), r"^\s+|\s+$", "")


def load_profiles(raw: DataFrame) -> DataFrame:
    """Profiles with lower-case lists and defaults; a list of skills of its own wins over the profile's."""
    lists = ["core_skills", "target_titles", "red_flags", "desc_red_flags"]
    none = F.array().cast("array<string>")
    low = {c: F.transform(F.coalesce(F.col(c), none), lambda x: F.lower(x)) for c in lists if c in raw.columns}
    if "skills_file" in raw.columns:
        low["core_skills"] = F.transform(F.coalesce(F.col("skills_file"), F.col("core_skills"), none), lambda x: F.lower(x))
    rest = {"seniority_level": F.lower(empty(F.col("seniority_level"))), "skip_niche": F.coalesce(F.col("skip_niche"), F.lit(False))}
    return raw.withColumns(low | rest)


def fan_out(postings: DataFrame, profiles: DataFrame) -> DataFrame:
    """Each posting with each profile. Fails where the profiles are too many to broadcast."""
    n = profiles.limit(MAX_PROFILES + 1).count()
    if n > MAX_PROFILES:
        raise ValueError(f"more than {MAX_PROFILES} profiles: score them in blocks")
    return postings.crossJoin(F.broadcast(profiles))


def embedding_score(vector: Column, profile_vector: Column) -> Column:
    return V.unit_score(V.cosine(vector, profile_vector))


def location_class(location: Column, v: Vocabulary) -> Column:
    """us, india, other or unknown, looked for in this order."""
    t = F.concat(F.lit(" "), F.lower(location), F.lit(" "))
    found = F.when(T.has_token(t, v.us), "us").when(T.has_token(t, v.india), "india").when(T.has_token(t, v.other), "other")
    return F.when(empty(location) == "", "unknown").otherwise(F.coalesce(found, F.lit("unknown")))


@dataclass(frozen=True)
class Rule:
    name: str
    delta: Column  # null where it doesn't fire
    note: Column | None


def _quoted(before: str, hit: Column, after: str = "") -> Column:
    return F.concat(F.lit(before + "'"), hit, F.lit("'" + after))


def _once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns that are worked out once a row: a later filter on what is made of them isn't pushed below, where it would work
    them out again for each of their uses."""
    return df.select("*", F.inline_outer(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def skills_of(profiles: DataFrame) -> list[str]:
    """The different skills of profiles that are few enough to be broadcast."""
    return sorted(r.s for r in profiles.limit(MAX_PROFILES).select(F.explode("core_skills").alias("s")).distinct().collect())


def prepare(postings: DataFrame, v: Vocabulary | None = None, skills: list[str] | None = None) -> DataFrame:
    """Adds what scoring needs of a posting alone. Before a fan-out it is worked out once a posting, not once a pair; so are
    the ``skills`` that its text holds, where all profiles' skills are given (see ``skills_of``)."""
    v = v or Vocabulary()
    title, desc = F.col("_title"), F.col("_desc")
    df = _once(postings, {"_title": F.lower(empty(F.col("title"))), "_desc": F.lower(empty(F.col("description_text")))})
    held = {} if skills is None else {"_skills": F.filter(F.lit(skills) if skills else F.array().cast("array<string>"), lambda s: T.phrase_present(desc, s))}
    return _once(df, held | {
        "_sponsor": T.first_token(desc, v.no_sponsorship),
        "_non_tech": T.first_token(title, v.non_tech),
        "_ambiguous": T.first_token(title, v.ambiguous),
        "_tech": T.has_token(title, v.tech_context) | T.has_token(desc, v.tech_context),
        "_niche_title": T.first_token(title, v.niche_title),
        "_niche": T.count_tokens(desc, v.niche),
        "_coding": T.count_tokens(title, v.coding) + T.count_tokens(desc, v.coding),
        "_place": location_class(F.col("location"), v),
    })


def score(df: DataFrame, v: Vocabulary | None = None) -> DataFrame:
    """Adds rule_adjustments (in rule order), matched_skills, missing_skills, notes, reason and score.

    Rows hold a posting (prepared or not), a profile (see ``load_profiles``) and embedding_score.
    """
    v = v or Vocabulary()
    if "_niche" not in df.columns:
        df = prepare(df, v)
    title, desc = F.col("_title"), F.col("_desc")
    df = _once(df, {
        "_target": T.first_of(title, F.col("target_titles")),
        "_flag_title": T.first_of(title, F.col("red_flags")),
        "_flag_desc": T.first_of(desc, F.col("red_flags")),
        "_flag_own": T.first_of(desc, F.col("desc_red_flags")),
        "matched_skills": F.filter("core_skills", lambda s: F.array_contains("_skills", s) if "_skills" in df.columns else T.phrase_present(desc, s)),
    })
    niche_on = ~F.col("skip_niche")
    c = F.col
    place = lambda kind: F.concat(F.lit(f"location is {kind} ("), c("location"), F.lit(")"))
    coded = F.concat(F.lit("coding-heavy role: "), c("_coding"), F.lit(" coding vs "), c("_niche"), F.lit(" SRE signals"))
    k = F.size("matched_skills")
    rules = [
        Rule("target_title_match", F.when(c("_target").isNotNull(), 0.10), _quoted("title matches target ", c("_target"))),
        Rule("seniority_match", F.when((c("seniority_level") != "") & F.contains(title, c("seniority_level")), 0.05), _quoted("seniority ", c("seniority_level"), " present in title")),
        Rule("red_flag_penalty", F.when(c("_flag_title").isNotNull(), -0.25), _quoted("red flag ", c("_flag_title"), " in title")),
        Rule("red_flag_desc_penalty", F.when(c("_flag_title").isNull() & c("_flag_desc").isNotNull(), -0.20), _quoted("red flag ", c("_flag_desc"), " in description")),
        Rule("desc_red_flag_penalty", F.when(c("_flag_own").isNotNull(), -0.25), _quoted("desc red flag ", c("_flag_own"), " in description")),
        Rule("no_sponsorship_penalty", F.when(c("_sponsor").isNotNull(), -0.30), _quoted("description signals no sponsorship: ", c("_sponsor"))),
        Rule("non_tech_penalty", F.when(c("_non_tech").isNotNull(), -0.50), _quoted("non-tech title token ", c("_non_tech"))),
        Rule("ambiguous_no_tech_context", F.when(c("_ambiguous").isNotNull() & c("_non_tech").isNull() & ~c("_tech"), -0.25), _quoted("ambiguous ", c("_ambiguous"), " with no tech context")),
        Rule("niche_title_match", F.when(niche_on & c("_niche_title").isNotNull(), 0.05), _quoted("niche title token ", c("_niche_title"))),
        Rule("sre_density_bonus", F.when(niche_on & (c("_niche") >= 2), F.bround(F.least(F.lit(0.10), 0.02 * F.floor(c("_niche") / 2)), 4)), F.concat(c("_niche"), F.lit(" SRE-niche signals in JD"))),
        Rule("coding_heavy_penalty", F.when(niche_on & (c("_coding") >= 2) & (c("_coding") > c("_niche")), -F.bround(F.least(F.lit(0.25), 0.05 * c("_coding")), 4)), coded),
        Rule("generic_swe_no_niche", F.when(niche_on & F.contains(title, F.lit(v.generic_title)) & c("_niche_title").isNull() & (c("_niche") == 0), -0.15), F.lit("generic SWE title, no SRE-niche evidence")),
        Rule("location_india", F.when(c("_place") == "india", -0.20), place("India")),
        Rule("location_non_us", F.when(c("_place") == "other", -0.40), place("non-US/non-India")),
        Rule("skill_overlap_bonus", F.when(k > 0, F.bround(F.least(F.lit(0.10), 0.02 * k), 4)), None),
    ]
    entries = F.array(*(F.struct(F.lit(r.name).alias("key"), r.delta.cast("double").alias("value")) for r in rules))
    notes = F.array_compact(F.array(*(F.when(r.delta.isNotNull(), r.note) for r in rules if r.note is not None)))
    df = df.withColumns({
        "rule_adjustments": F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())),
        "notes": notes,
        "missing_skills": F.slice(F.filter("core_skills", lambda s: ~F.array_contains("matched_skills", s)), 1, 5),
    })
    df = df.withColumns({"reason": reason(), "score": final_score()})
    return df.drop(*(x for x in df.columns if x.startswith("_")))


def sum_adjustments() -> Column:
    return F.aggregate(F.map_values("rule_adjustments"), F.lit(0.0), lambda a, x: a + x)


def final_score() -> Column:
    """Embedding score and adjustments, then the hard caps, then the clamp to [0, 1]; four places."""
    total = F.col("embedding_score") + sum_adjustments()
    fired = lambda name: F.map_contains_key("rule_adjustments", F.lit(name))
    for name, cap in (("no_sponsorship_penalty", 0.20), ("location_non_us", 0.20), ("non_tech_penalty", 0.15)):
        total = F.when(fired(name), F.least(total, F.lit(cap))).otherwise(total)
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 4)


def reason() -> Column:
    skills = F.concat(F.lit("matched "), F.size("matched_skills"), F.lit(" core skills ("), F.array_join(F.slice("matched_skills", 1, 4), ", "), F.lit(")"))
    parts = F.concat(
        F.array(F.concat(F.lit("semantic match "), T.fixed(F.col("embedding_score"), 2))),
        F.when(F.size("matched_skills") > 0, F.array(skills)).otherwise(F.array().cast("array<string>")),
        F.col("notes"),
        F.when(F.size(F.map_keys("rule_adjustments")) == 0, F.array(F.lit("no rule adjustments applied"))).otherwise(F.array().cast("array<string>")),
    )
    return F.array_join(parts, "; ")


# The forms of a salary range.
SALARY = [r"\$\s*\d{2,3}[,kK]\s*-\s*\$?\s*\d{2,3}[,kK]", r"\$\s*\d{2,3},?\d{0,3}\s*(?:to|-|–)\s*\$\s*\d{2,3}"]


def has_salary(low: Column) -> Column:
    return low.rlike(SALARY[0]) | low.rlike(SALARY[1])


def repost_count(df: DataFrame, days: int = 90, at: str = "scraped_at", key: tuple[str, ...] = ("company", "title"), rows: int = SLICE) -> DataFrame:
    """Adds repost_count: earlier sightings of the same company and title within ``days``; 0 where there is no time.

    Where no key has more than ``rows`` sightings, a window counts them. Else they are counted by second first. The count of a second is the difference of two sums up to a place: the one before it, and
    the one before its range. Sums are made in two levels, within slices of time and over whole slices, so no window holds more
    than a slice of a key.
    """
    if longest_log(df, *map(F.col, key)) <= rows:
        w = W.partitionBy(*key).orderBy(F.unix_seconds(F.col(at))).rangeBetween(-days * 86_400, -1)
        return df.withColumn("repost_count", F.when(F.col(at).isNull(), 0).otherwise(F.count("*").over(w)).cast("long"))
    keyed = df.withColumns({"_own": F.to_json(F.struct(*key)), "_second": F.unix_seconds(F.col(at))})
    seconds = keyed.filter("_second is not null").groupBy("_own", "_second").agg(F.count("*").alias("n"))
    nothing = F.lit(0).cast("long")
    probes = [seconds.select("_own", "_second", (F.col("_second") - back).alias("place"), F.lit(sign).alias("sign"), nothing.alias("n")) for back, sign in ((1, 1), (days * 86_400 + 1, -1))]
    steps = seconds.select("_own", F.lit(None).cast("long").alias("_second"), F.col("_second").alias("place"), nothing.cast("int").alias("sign"), "n")
    sliced = time_slices(steps.unionByName(probes[0]).unionByName(probes[1]), F.col("_own"), F.col("place"), rows)
    whole = sliced.groupBy("_key", "_slice").agg(F.sum("n").alias("n"))
    whole = whole.select("_key", "_slice", (F.sum("n").over(W.partitionBy("_key").orderBy("_slice")) - F.col("n")).alias("before"))
    upto = W.partitionBy("_key", "_slice").orderBy("place").rangeBetween(W.unboundedPreceding, 0)
    sums = sliced.withColumn("upto", F.sum("n").over(upto)).filter("sign <> 0").join(whole, ["_key", "_slice"])
    counts = sums.groupBy("_own", "_second").agg(F.sum(F.col("sign") * (F.col("upto") + F.col("before"))).alias("_count"))
    out = keyed.join(counts, ["_own", "_second"], "left")
    return out.select(*df.columns, F.coalesce("_count", F.lit(0)).cast("long").alias("repost_count"))


def legitimacy(df: DataFrame, as_of: Column, niche: list[str] | None = None) -> DataFrame:
    """Adds legitimacy_tier and legitimacy_signals; repost_count, where there is such a column, counts in."""
    niche = Vocabulary().niche if niche is None else niche
    none = F.array().cast("array<string>")
    reposts = F.col("repost_count") if "repost_count" in df.columns else F.lit(0)
    df = df.withColumns({"_age": age_days(F.coalesce("posted_at", "scraped_at"), as_of), "_low": F.lower(empty(F.col("description_text"))), "_reposts": reposts})
    df = df.withColumn("_hits", T.count_tokens(F.col("_low"), niche))
    age, n, size, hits = F.col("_age"), F.col("_reposts"), F.length("_low"), F.col("_hits")
    shown = T.fixed(age, 0)
    said = lambda word: F.concat(F.lit("posted "), shown, F.lit(f" days ago ({word})"))
    parts = [
        F.when(age <= 30, F.struct(F.lit(2).alias("d"), said("fresh").alias("s")))
        .when(age <= 60, F.struct(F.lit(0).alias("d"), said("mixed").alias("s")))
        .when(age <= 120, F.struct(F.lit(-1).alias("d"), said("concerning").alias("s")))
        .when(age > 120, F.struct(F.lit(-2).alias("d"), said("likely stale").alias("s"))),
        F.when(n >= 4, F.struct(F.lit(-2).alias("d"), F.concat(F.lit("reposted "), n, F.lit("x in 90d (ghost pattern)")).alias("s")))
        .when(n >= 2, F.struct(F.lit(-1).alias("d"), F.concat(F.lit("reposted "), n, F.lit("x in 90d")).alias("s"))),
        F.when(has_salary(F.col("_low")), F.struct(F.lit(1).alias("d"), F.lit("salary range disclosed").alias("s"))),
        F.when((size > 200) & (hits >= 5), F.struct(F.lit(1).alias("d"), F.concat(F.lit("specific JD ("), hits, F.lit(" concrete tech terms)")).alias("s")))
        .when((size > 800) & (hits == 0), F.struct(F.lit(-1).alias("d"), F.lit("vague JD (no specific tech mentioned)").alias("s"))),
    ]
    df = df.withColumn("_parts", F.array_compact(F.array(*parts)))
    total = F.aggregate("_parts", F.lit(0), lambda a, x: a + x["d"])
    tier = F.when(total >= 2, "HIGH_CONFIDENCE").when(total <= -2, "SUSPICIOUS").otherwise("PROCEED_WITH_CAUTION")
    df = df.withColumns({"legitimacy_tier": tier, "legitimacy_signals": F.when(F.size("_parts") > 0, F.transform("_parts", lambda x: x["s"])).otherwise(none)})
    return df.drop("_age", "_low", "_reposts", "_hits", "_parts")
