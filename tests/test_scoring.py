"""Rule engine, legitimacy and rendering on literal postings."""

import pytest
from pyspark.sql import functions as F

from postloom.operators import render, scoring

SKILLS = ["kubernetes", "terraform", "aws", "python", "linux", "ci/cd", "prometheus", "go"]
PROFILE = ("p", SKILLS, ["site reliability engineer", "platform engineer", "devops engineer", "infrastructure engineer", "software engineer"], ["manager", "director", "sales", "account executive"], [], "staff", False, "")
SCHEMA = "person_id string, core_skills array<string>, target_titles array<string>, red_flags array<string>, desc_red_flags array<string>, seniority_level string, skip_niche boolean, profile_summary string"


def scored(spark, title, location="Remote", desc="", embedding=1.0):
    job = spark.createDataFrame([(title, location, desc, "Acme", "1")], "title string, location string, description_text string, company string, source_id string")
    df = scoring.fan_out(job, scoring.load_profiles(spark.createDataFrame([PROFILE], SCHEMA))).withColumn("embedding_score", F.lit(embedding))
    return scoring.score(df).first()


def test_target_niche_and_skills(spark):
    r = scored(spark, "Site Reliability Engineer", desc="Looking for SRE with kubernetes and terraform experience.")
    a = r.rule_adjustments
    assert (a["target_title_match"], a["niche_title_match"], a["skill_overlap_bonus"]) == (0.10, 0.05, 0.04)


def test_red_flag(spark):
    assert scored(spark, "Engineering Manager, Platform").rule_adjustments["red_flag_penalty"] == -0.25


def test_no_sponsorship_caps(spark):
    r = scored(spark, "Staff Site Reliability Engineer", desc="Sorry, we cannot sponsor visas")
    assert r.score <= 0.20 and "no_sponsorship_penalty" in r.rule_adjustments and "no sponsorship" in r.reason


def test_skill_bonus_is_capped(spark):
    r = scored(spark, "Backend Engineer", desc=" ".join(SKILLS))
    assert r.rule_adjustments["skill_overlap_bonus"] == 0.10 and len(r.matched_skills) == 8


def test_seniority_and_empty_description(spark):
    assert scored(spark, "Staff Software Engineer, Infrastructure").rule_adjustments["seniority_match"] == 0.05
    assert scored(spark, "x", desc="").matched_skills == []


@pytest.mark.parametrize("place", ["Bangalore, India", "Hyderabad"])
def test_india(spark, place):
    assert scored(spark, "SRE", place).rule_adjustments["location_india"] == -0.20


@pytest.mark.parametrize("place", ["London, UK", "Berlin, Germany", "Toronto, Canada"])
def test_abroad_caps(spark, place):
    r = scored(spark, "SRE", place)
    assert r.rule_adjustments["location_non_us"] == -0.40 and r.score <= 0.20


@pytest.mark.parametrize("place", ["Austin, TX", "Remote (US)", "Remote, EST", "Remote — Pacific Time", "Remote (PST)", "Remote"])
def test_home(spark, place):
    assert not {"location_india", "location_non_us"} & set(scored(spark, "SRE", place).rule_adjustments)


@pytest.mark.parametrize("title", ["Civil Infrastructure Engineer", "Construction Manager, Datacenter", "landscape architect"])
def test_other_trades(spark, title):
    r = scored(spark, title)
    assert "non_tech_penalty" in r.rule_adjustments and r.score <= 0.15


def test_ambiguous(spark):
    assert "ambiguous_no_tech_context" in scored(spark, "Principal Architect", desc="designs buildings").rule_adjustments
    for title in ("Software Architect", "Cloud Architect"):
        assert not {"ambiguous_no_tech_context", "non_tech_penalty"} & set(scored(spark, title).rule_adjustments)


def test_density_and_coding(spark):
    a = scored(spark, "Site Reliability Engineer", desc="on-call with runbook, postmortem and slo; terraform, prometheus").rule_adjustments
    assert a["sre_density_bonus"] >= 0.04 and "coding_heavy_penalty" not in a
    a = scored(spark, "ML Research", desc="model training, training pipeline, neural network").rule_adjustments
    assert a["coding_heavy_penalty"] == -0.20
    assert "generic_swe_no_niche" in scored(spark, "Software Engineer", desc="uses kubernetes").rule_adjustments


AS_OF = "2026-05-17"


def legit(spark, days, text, reposts=None):
    df = spark.createDataFrame([(text,)], "description_text string").withColumns({"posted_at": F.expr(f"timestamp'{AS_OF}' - interval {days} days"), "scraped_at": F.lit(None).cast("timestamp")})
    df = df.withColumn("repost_count", F.lit(reposts)) if reposts is not None else df
    return scoring.legitimacy(df, F.lit(AS_OF).cast("timestamp")).first()


def test_legitimacy(spark):
    good = "terraform prometheus grafana datadog kubernetes operator on-call. Salary range $200,000 - $260,000 " + "x" * 200
    assert legit(spark, 5, good).legitimacy_tier == "HIGH_CONFIDENCE"
    assert legit(spark, 180, "we are a great place to be " * 40).legitimacy_tier == "SUSPICIOUS"
    assert legit(spark, 45, "short").legitimacy_tier == "PROCEED_WITH_CAUTION"


@pytest.mark.parametrize("n, signals", [(1, 1), (2, 2), (4, 2)])
def test_reposts(spark, n, signals):
    assert len(legit(spark, 5, "x", n).legitimacy_signals) == signals


def test_repost_window(spark):
    rows = [("a", "t", d) for d in ("2024-01-01", "2024-01-05", "2024-03-30", "2024-04-10")]
    df = spark.createDataFrame(rows, "company string, title string, d string").withColumn("scraped_at", F.to_timestamp("d"))
    got = {r.d: r.repost_count for r in scoring.repost_count(df).collect()}
    assert got == {"2024-01-01": 0, "2024-01-05": 1, "2024-03-30": 2, "2024-04-10": 1}


def test_alert(spark):
    df = spark.createDataFrame([("Acme", "SRE", "u", "Remote", True, 0.83, ["a"], [], "fits (well)", "", "2026-05-17T15:23:00Z")], "company string, title string, url string, location string, remote boolean, score double, matched_skills array<string>, missing_skills array<string>, reason string, legitimacy_tier string, at string")
    text = df.select(render.alert_text(F.col("at")).alias("x")).first().x
    for part in ("Score: 83%", "Remote: yes", "scraped 2026-05-17 15:23 UTC", "[Apply](u)", "fits well", "*Gaps:* none"):
        assert part in text
