"""Text and tracker projections of scored postings. Rows are flat: a posting's columns beside the score's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions import text as T
from ..functions.identity import posting_key, short_id
from ..functions.text import empty
from ..functions.time import shown


def _lines(*parts: Column | str) -> Column:
    return F.concat_ws("\n", *(F.lit(p) if isinstance(p, str) else p for p in parts))


def _joined(items: Column, none: str, clean=lambda x: x) -> Column:
    text = F.array_join(F.transform(items, clean), ", ")
    return F.when(text == "", none).otherwise(text)


def _tier(column: int) -> Column:
    chain = F.when(F.lit(False), "")
    for tier, texts in vocab.LEGITIMACY_TIERS.items():
        chain = chain.when(F.col("legitimacy_tier") == tier, texts[column])
    return chain


def alert_text(scraped: Column | None = None) -> Column:
    """The alert of a scored posting; ``scraped`` is its time as text."""
    md = T.strip_markdown
    scraped = F.col("scraped_at").cast("string") if scraped is None else scraped
    place = F.when(empty(F.col("location")) != "", md(F.col("location"))).otherwise("Location TBD")
    badge = _tier(0)
    line = F.when(badge.isNotNull(), F.concat(F.lit("\n_"), md(badge), F.lit("_"))).otherwise("")
    why = F.when(empty(F.col("reason")) != "", md(F.col("reason"))).otherwise("no reason provided")
    return _lines(
        F.concat(F.lit("*NEW MATCH — "), md(F.col("company")), F.lit("*")),
        F.concat(F.lit("*"), md(F.col("title")), F.lit("*")),
        F.concat(F.lit("Score: "), T.percent(F.col("score")), F.lit("% | Remote: "), F.when(F.col("remote"), "yes").otherwise("no"), F.lit(" | "), place, line),
        "",
        F.concat(F.lit("*Why match:* "), why),
        "",
        F.concat(F.lit("*Skills you have:* "), _joined(F.col("matched_skills"), "-", md)),
        F.concat(F.lit("*Gaps:* "), _joined(F.col("missing_skills"), "none", md)),
        "",
        F.concat(F.lit("[Apply]("), F.col("url"), F.lit(")")),
        "",
        F.concat(F.lit("_scraped "), shown(scraped), F.lit("_")),
    )


def by_size(m: Column) -> Column:
    """A map's entries, the largest absolute value first, else in the map's order."""
    at = F.transform(F.map_entries(m), lambda e, i: F.struct((-F.abs(e["value"])).alias("k"), i.alias("i"), e.alias("e")))
    return F.transform(F.array_sort(at), lambda x: x["e"])


def adjustments_table(m: Column) -> Column:
    sign = lambda v: F.when(v >= 0, "+").otherwise("")
    rows = F.transform(by_size(m), lambda e: F.concat(F.lit("| "), e["key"], F.lit(" | "), sign(e["value"]), T.fixed(e["value"], 3), F.lit(" |")))
    head = F.array(F.lit("| Rule | Adjustment |"), F.lit("|------|-----------:|"))
    return F.when(F.size(F.map_keys(m)) == 0, "_no rule adjustments applied_").otherwise(F.array_join(F.concat(head, rows), "\n"))


# The check list at the end of a report.
STEPS = ["resume tailored", "cover letter generated", "applied", "heard back", "interview", "offer"]


# The report's headings and labels, as in ``alert_text``.
def report_text(dedup_id: Column, reviewed: Column, scraped: Column | None = None, source: str = "streaming-pipeline") -> Column:
    scraped = F.col("scraped_at").cast("string") if scraped is None else scraped
    signals = F.array_join(F.transform("legitimacy_signals", lambda s: F.concat(F.lit("- "), s)), "\n")
    place = F.when(empty(F.col("location")) != "", F.col("location")).otherwise("TBD")
    return _lines(
        F.concat(F.lit("# "), F.col("company"), F.lit(" — "), F.col("title")), "",
        F.concat(F.lit("**dedup_id:** `"), dedup_id, F.lit("`  ")),
        F.lit(f"**source:** {source}  "),
        F.concat(F.lit("**posted/scraped:** "), F.when(empty(scraped) != "", scraped).otherwise("unknown"), F.lit("  ")),
        F.concat(F.lit("**reviewed:** "), F.date_format(reviewed, "yyyy-MM-dd HH:mm"), F.lit(" UTC")), "",
        "## Summary", "",
        F.concat(F.lit("- **Score:** "), T.fixed(F.col("score"), 2), F.lit(" ("), T.percent(F.col("score")), F.lit("%)")),
        F.concat(F.lit("- **Embedding score:** "), T.fixed(F.col("embedding_score"), 2)),
        F.concat(F.lit("- **"), F.coalesce(_tier(1), F.lit("Legitimacy: not assessed")), F.lit("**")),
        F.concat(F.lit("- **Apply URL:** ["), F.col("url"), F.lit("]("), F.col("url"), F.lit(")")),
        F.concat(F.lit("- **Location:** "), place, F.lit(" (remote: "), F.when(F.col("remote"), "yes").otherwise("no"), F.lit(")")), "",
        "## Why match", "",
        F.when(empty(F.col("reason")) != "", F.col("reason")).otherwise("_no reason provided_"), "",
        "## Skills", "",
        F.concat(F.lit("- **You have:** "), _joined(F.col("matched_skills"), "-")),
        F.concat(F.lit("- **Gaps:** "), _joined(F.col("missing_skills"), "none")), "",
        "## Score breakdown", "", adjustments_table(F.col("rule_adjustments")), "",
        "## Posting legitimacy signals", "",
        F.when(F.size("legitimacy_signals") > 0, signals).otherwise("_no signals recorded_"), "",
        "## Application status", "", *(f"- [ ] {s}" for s in STEPS), "",
        F.concat(F.lit("_Update by editing this file or via the Telegram inline buttons (dedup_id `"), dedup_id, F.lit("`)._")), "",
    )


def _dedup_id() -> Column:
    return short_id(posting_key(F.col("company"), F.col("source_id")))


def tracker_row(df: DataFrame, added: Column, person: str) -> DataFrame:
    """The 22 text columns of a tracker row of a scored posting; fields that later steps fill are blank."""
    blank = F.lit("")
    cols = {
        "dedup_id": _dedup_id(), "date_added": F.date_format(added, "yyyy-MM-dd HH:mm"), "person": F.lit(person),
        "company": F.col("company"), "title": F.col("title"), "department": empty(F.col("department")), "location": F.col("location"),
        "remote": T.yes_no(F.col("remote")), "source": empty(F.col("source")), "match_score": F.concat(T.percent(F.col("score")), F.lit("%")),
        "ats_score": blank, "recruiter_score": blank, "archetype": blank,
        "visa_ok": T.yes_no(~F.contains(F.lower(empty(F.col("reason"))), F.lit("no sponsorship"))), "apply_url": F.col("url"),
        "drive_folder_link": blank, "resume_url": blank, "cover_letter_url": blank, "required_skills": blank, "missing_skills": blank,
        "status": F.lit("NEW"), "notes": F.substring(empty(F.col("reason")), 1, 300),
    }
    return df.select(*(c.alias(n) for n, c in cols.items()))


def tracker_row_full(df: DataFrame, added: Column, person: str) -> DataFrame:
    """The 22 columns from a flat row; ``person`` stands where a row names none: absent fields are blank, a score of at most 1 is shown as percents."""
    have = set(df.columns)
    s = lambda k, default="": F.coalesce(F.col(k).cast("string"), F.lit("" if k in have else default)) if k in have else F.lit(default)
    score = F.col("match_score")
    shown_score = F.when(score.isNull(), "").when(score <= 1.0, F.concat(T.percent(score), F.lit("%"))).otherwise(score.cast("string")) if "match_score" in have else F.lit("")
    flag = lambda k, default: T.yes_no(F.coalesce(F.col(k), F.lit(False))) if k in have else F.lit(default)
    cols = {
        "dedup_id": F.col("dedup_id"), "date_added": F.date_format(added, "yyyy-MM-dd HH:mm"), "person": s("person", person), "company": s("company"),
        "title": s("title"), "department": s("department"), "location": s("location"), "remote": flag("remote", "No"), "source": s("source"),
        "match_score": shown_score, "ats_score": s("ats_score"), "recruiter_score": s("recruiter_score"), "archetype": s("archetype"),
        "visa_ok": flag("visa_ok", "Yes"), "apply_url": s("url"), "drive_folder_link": s("drive_folder_link"), "resume_url": s("resume_url"),
        "cover_letter_url": s("cover_letter_url"), "required_skills": s("required_skills"), "missing_skills": s("missing_skills"),
        "status": s("status", "NEW"), "notes": F.substring(s("notes"), 1, 500),
    }
    return df.select(*(c.alias(n) for n, c in cols.items()))


def tracker_row_13(df: DataFrame, added: Column) -> DataFrame:
    cols = {
        "dedup_id": _dedup_id(), "date_added": F.date_format(added, "yyyy-MM-dd HH:mm"), "company": F.col("company"), "title": F.col("title"),
        "score": F.concat(T.percent(F.col("score")), F.lit("%")), "visa_ok": T.yes_no(F.col("visa_ok")), "location": F.col("location"),
        "remote": T.yes_no(F.col("remote")), "apply_url": F.col("url"), "resume_url": empty(F.col("resume_url")),
        "cover_letter_url": empty(F.col("cover_letter_url")), "status": F.lit("PENDING_REVIEW"), "match_reasoning": F.substring(empty(F.col("reasoning")), 1, 300),
    }
    return df.select(*(c.alias(n) for n, c in cols.items()))
