"""Keyword coverage, résumé and plan joins, grounding checks, bullet diffs."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import empty


def vocabulary_terms(text: Column, vocab: list[str]) -> Column:
    """Sorted terms of ``vocab`` in a text: those of several words first, longest first, each blanked once found; then single
    words at word boundaries in what is left."""
    many = sorted((t for t in vocab if " " in t), key=lambda t: (-len(t), t))
    single = sorted({t for t in vocab if " " not in t})
    state = F.struct(F.lower(text).alias("text"), F.array().cast("array<string>").alias("found"))

    def step(s: Column, t: Column) -> Column:
        hit = F.contains(s["text"], t)
        return F.when(hit, F.struct(F.replace(s["text"], t, F.repeat(F.lit(" "), F.length(t))).alias("text"), F.array_append(s["found"], t).alias("found"))).otherwise(s)

    left = F.aggregate(F.array(*map(F.lit, many)) if many else F.array().cast("array<string>"), state, step)
    words = [F.when(F.contains(left["text"], F.lit(t)) & F.regexp_like(left["text"], F.lit(rf"(?U)\b\Q{t}\E\b")), t) for t in single]
    return F.array_sort(F.concat(left["found"], F.array_compact(F.array(*words)) if words else F.array().cast("array<string>")))


def present(low: Column, term: Column) -> Column:
    word = F.contains(low, term) & F.regexp_like(low, F.concat(F.lit(r"(?U)\b\Q"), term, F.lit(r"\E\b")))
    return F.when(F.contains(term, F.lit(" ")), F.contains(low, term)).otherwise(word)


def keyword_coverage(df: DataFrame, posting: str, document: str, vocab: list[str]) -> DataFrame:
    """Adds jd_keywords, matched_keywords, missing_keywords and coverage (0 to 100, half to even; 0 without keywords)."""
    low = F.lower(empty(F.col(document)))
    df = df.withColumn("jd_keywords", vocabulary_terms(empty(F.col(posting)), vocab))
    df = df.withColumn("matched_keywords", F.filter("jd_keywords", lambda t: present(low, t)))
    n, m = F.size("jd_keywords"), F.size("matched_keywords")
    return df.withColumns({"missing_keywords": F.array_except("jd_keywords", "matched_keywords"), "coverage": F.when(n == 0, 0).otherwise(F.bround(100.0 * m / n, 0)).cast("int")})


def resolve_bullets(bullets: DataFrame, plan: DataFrame) -> DataFrame:
    """Plan entries (doc, role_index, bullet_index, from 1) with their bullet; warning where there is none."""
    joined = plan.join(bullets.select("doc", "role_index", "bullet_index", "bullet"), ["doc", "role_index", "bullet_index"], "left")
    text = F.format_string("role %d has no bullet %d", F.col("role_index").cast("int"), F.col("bullet_index").cast("int"))
    return joined.withColumn("warning", F.when(F.col("bullet").isNull(), text))


def pick_warnings(bullets: DataFrame, picks: DataFrame) -> DataFrame:
    sizes = bullets.groupBy("doc", "role_index").agg(F.count("*").alias("n"))
    out = picks.join(sizes, ["doc", "role_index"], "left")
    bad = F.when(F.col("n").isNull(), "role out of range").when((F.col("bullet_index") < 1) | (F.col("bullet_index") > F.col("n")), "bullet out of range")
    return out.withColumn("warning", bad).filter("warning is not null").drop("n")


def grounding_warnings(rewrites: DataFrame, bullets: DataFrame, employers: DataFrame) -> DataFrame:
    """Rewrites (doc, role_index, bullet_index, rewritten) that are out of range or name, after "at", an employer that the
    document's history (doc, employer) doesn't have."""
    ranged = pick_warnings(bullets, rewrites).select("doc", "role_index", "bullet_index", F.lit(None).cast("string").alias("employer"), "warning")
    named = rewrites.select("doc", "role_index", "bullet_index", F.explode(F.array_distinct(F.regexp_extract_all("rewritten", F.lit(r"\bat ([A-Z][A-Za-z0-9&.\-]+)"), F.lit(1)))).alias("employer"))
    named = named.withColumn("_k", F.lower(F.regexp_replace("employer", r"[.]+$", "")))
    history = employers.select("doc", F.explode(F.split(F.lower("employer"), r"\s+")).alias("_k")).distinct()
    unknown = named.join(history, ["doc", "_k"], "left_anti").select("doc", "role_index", "bullet_index", "employer", F.lit("employer not in history").alias("warning"))
    return ranged.unionByName(unknown)


def source_grounding(items: DataFrame, sources: DataFrame, head: int = 60) -> DataFrame:
    """Items (doc, item) whose normalised first ``head`` signs don't occur in the document's source text (doc, text)."""
    probe = F.substring(T.bullet_key(T.strip_marker(F.col("item"))), 1, head)
    text = sources.select("doc", T.bullet_key(F.col("text")).alias("_source"))
    return items.withColumn("probe", probe).join(text, "doc", "left").filter(~F.contains(empty(F.col("_source")), F.col("probe"))).drop("_source")


def skill_grounding(skills: DataFrame, sources: DataFrame) -> DataFrame:
    """Skills (doc, skill) that don't occur in the document's source text (doc, text), whatever their case; white space counts as
    it is. A document without a source has none of its skills."""
    text = sources.select("doc", F.lower("text").alias("_source"))
    return skills.join(text, "doc", "left").filter(~F.contains(empty(F.col("_source")), F.lower(empty(F.col("skill"))))).drop("_source")


def resume_blob(bullets: DataFrame, plan: DataFrame, for_ats: bool = True) -> DataFrame:
    """A document's visible bullets as one text: a role's rewrites if it has some, else its kept bullets; without a plan
    entry all of them (recall form) or none (rendered form). plan: doc, role_index, keep array<int>, rewrites array<string>.
    """
    roles = bullets.groupBy("doc", "role_index").agg(F.array_sort(F.collect_list(F.struct("bullet_index", "bullet"))).alias("b"))
    p = roles.join(plan.select("doc", "role_index", "keep", "rewrites", F.lit(True).alias("planned")), ["doc", "role_index"], "left")
    own = F.transform("b", lambda x: x["bullet"])
    rewrites = F.filter(F.transform("rewrites", lambda x: F.trim(empty(x))), lambda x: x != "")
    kept = F.transform(F.filter("keep", lambda i: (i >= 1) & (i <= F.size("b"))), lambda i: F.get(own, i - 1))
    none = F.array().cast("array<string>")
    shown = F.when(F.size("rewrites") > 0, rewrites).when(F.col("planned"), F.coalesce(kept, none)).otherwise(own if for_ats else none)
    mark = (lambda x: x) if for_ats else (lambda x: F.concat(F.lit("• "), x))
    out = p.select("doc", "role_index", F.transform(shown, mark).alias("lines")).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("role_index", "lines"))).alias("r"))
    return out.select("doc", F.array_join(F.filter(F.flatten(F.transform("r", lambda x: x["lines"])), lambda x: x != ""), "\n").alias("blob"))


def bullet_diff(base: DataFrame, new: DataFrame) -> DataFrame:
    """Per role: dropped, kept and new bullets by normalised text, whether kept ones changed order, and the changes.

    Both: doc, role_index, bullet_index, bullet.
    """
    keyed = lambda df: df.groupBy("doc", "role_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("bullet_index", T.bullet_key(F.col("bullet")).alias("k")))), lambda x: x["k"]).alias("k"))
    both = keyed(base).withColumnRenamed("k", "old").join(keyed(new), ["doc", "role_index"], "full_outer")
    none = F.array().cast("array<string>")
    both = both.withColumns({"old": F.coalesce("old", none), "k": F.coalesce("k", none)})
    n = lambda c: F.size(c)
    reordered = F.array_intersect("old", "k") != F.array_intersect("k", "old")
    out = both.select("doc", "role_index", n(F.array_except("old", "k")).alias("dropped"), n(F.array_intersect("old", "k")).alias("kept"), n(F.array_except("k", "old")).alias("added"), reordered.alias("reordered"))
    return out.withColumn("changes", F.col("dropped") + F.col("added") + F.col("reordered").cast("int"))


CONFIDENCES = ["HIGH", "MEDIUM", "LOW", "UNKNOWN"]


def confidence_breakdown(df: DataFrame, key: str = "doc") -> DataFrame:
    """Counts of each confidence over the nested rewrites of a plan (experience: array of struct with rewrites)."""
    flat = df.select(key, F.explode("experience").alias("e")).select(key, F.explode("e.rewrites").alias("r"))
    level = F.upper(empty(F.col("r.confidence")))
    level = F.when(level.isin(CONFIDENCES), level).otherwise("UNKNOWN")
    return flat.groupBy(key).agg(*(F.count_if(level == c).alias(c.lower()) for c in CONFIDENCES))


def match_or_default(df: DataFrame, column: str, variant: Column) -> DataFrame:
    """A match result parsed from text; unreadable text gives score 0, visa_ok true and the first variant."""
    schema = "score double, visa_ok boolean, reasoning string, recommended_variant string"
    df = df.withColumn("_m", F.from_json(T.loose_json(F.col(column)), schema))
    bad = F.col("_m.score").isNull()
    return df.withColumns({"score": F.coalesce("_m.score", F.lit(0.0)), "visa_ok": F.coalesce("_m.visa_ok", F.lit(True)), "reasoning": F.when(bad, "parse failure").otherwise(empty(F.col("_m.reasoning"))), "recommended_variant": F.coalesce("_m.recommended_variant", variant)}).drop("_m")


# The parts of a plan that a report reads, and the axes of a recruiter's rubric.
PLAN = """jd_intelligence struct<company_type: string, priority_frame: string, required_skills: array<string>, preferred_skills: array<string>,
core_responsibilities: array<string>, hidden_keywords: array<string>>, jd_requirements array<string>, skills_reordered struct<lead_with: array<string>>,
skills_to_emphasize array<string>, missing_skill_risks array<string>, interview_callback_estimate string, experience array<struct<rewrites: array<struct<confidence: string>>>>"""
AXES = ("jd_match", "achievement_density", "technical_specificity", "clarity", "shortlist_signal")


def _is(value: str):
    return lambda x: x == value


def match_report(jobs: DataFrame, plans: DataFrame, coverage: DataFrame, rubrics: DataFrame, archetype: Column, key: str = "key") -> DataFrame:
    """One row a job with the 27 fields of its match report.

    jobs: key, company, title, url, location, remote, scraped_at, tailored_at, person, score. plans: key, plan (JSON). coverage:
    key, ats_score, matched_keywords, missing_keywords, jd_keywords. rubrics: key, recruiter (JSON of ``AXES``). A job without a
    plan has empty lists, one without a rubric no recruiter's score.
    """
    none = F.array().cast("array<string>")
    plans = plans.select(key, F.from_json("plan", PLAN).alias("p"))
    total = sum((F.coalesce(F.get_json_object("recruiter", f"$.{a}").cast("int"), F.lit(0)) for a in AXES), F.lit(0))
    rubrics = rubrics.select(key, "recruiter", F.greatest(F.lit(0), F.least(F.lit(100), total)).alias("recruiter_score"))
    j = jobs.join(plans, key, "left").join(coverage.select(key, "ats_score", "matched_keywords", "missing_keywords", "jd_keywords"), key, "left").join(rubrics, key, "left")
    listed = lambda c: F.coalesce(F.col(c), none)
    first = lambda a, b: F.when(F.size(listed(a)) > 0, F.col(a)).otherwise(listed(b))
    level = lambda r: F.upper(empty(r["confidence"]))
    rewrites = F.flatten(F.transform(F.coalesce("p.experience", F.array().cast("array<struct<rewrites: array<struct<confidence: string>>>>")), lambda e: F.coalesce(e["rewrites"], F.array().cast("array<struct<confidence: string>>"))))
    kinds = F.transform(rewrites, lambda r: F.when(level(r).isin(CONFIDENCES), level(r)).otherwise("UNKNOWN"))
    return j.select(
        key, "company", "title", "url", "location", "remote", "scraped_at", "tailored_at", "person", F.col("score").alias("raw_match_score"), "ats_score",
        F.col("matched_keywords").alias("ats_keywords_matched"), F.col("missing_keywords").alias("ats_keywords_missing"), F.size("jd_keywords").alias("ats_keywords_total"),
        "recruiter_score", F.col("recruiter").alias("recruiter_breakdown"), archetype.alias("archetype"), "p.jd_intelligence.company_type", "p.jd_intelligence.priority_frame",
        *(listed(f"p.jd_intelligence.{c}").alias(f"jd_{c}") for c in ("required_skills", "preferred_skills", "core_responsibilities", "hidden_keywords")),
        first("p.jd_intelligence.required_skills", "p.jd_requirements").alias("jd_requirements"), first("p.skills_reordered.lead_with", "p.skills_to_emphasize").alias("skills_emphasized"),
        listed("p.missing_skill_risks").alias("missing_skill_risks"), "p.interview_callback_estimate",
        F.struct(*(F.size(F.filter(kinds, _is(c))).alias(c) for c in CONFIDENCES)).alias("confidence_breakdown"),
    )


def any_word(words: list[str]) -> str:
    """A pattern that finds any of the words as a word."""
    return r"(?iU)\b(?:" + reduce(lambda a, w: f"{a}|{w}", map(re.escape, words)) + r")\b"
