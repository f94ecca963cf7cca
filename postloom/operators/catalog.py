"""Source catalog: vendor detection, drift against a seed, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import empty

_ID = r"([a-zA-Z0-9_\-]+)"
_HOST = r"([a-zA-Z0-9\-]+)"
# Vendor, patterns in order, form of the endpoint; vendors are tried in this order.
VENDORS = [
    ("greenhouse", [rf"boards(?:-api)?\.greenhouse\.io/(?:embed/job_board\?for=)?{_ID}", rf"job-boards\.greenhouse\.io/{_ID}"], "https://boards-api.greenhouse.io/v1/boards/%s/jobs"),
    ("lever", [rf"jobs\.(?:eu\.)?lever\.co/{_ID}"], "https://api.lever.co/v0/postings/%s?mode=json"),
    ("ashby", [r"jobs\.ashbyhq\.com/([a-zA-Z0-9_\-\.]+)", r"api\.ashbyhq\.com/posting-api/job-board/([a-zA-Z0-9_\-\.]+)"], "https://api.ashbyhq.com/posting-api/job-board/%s"),
    ("workday", [rf"https?://{_HOST}\.(?:wd[1-9])?\.?myworkdayjobs\.com/(?:wday/cxs/[^/]+/)?([a-zA-Z0-9_\-]+)"], "https://%s.wd1.myworkdayjobs.com/wday/cxs/%s/%s/jobs"),
    ("smartrecruiters", [rf"jobs\.smartrecruiters\.com/{_ID}", rf"api\.smartrecruiters\.com/v1/companies/{_ID}/postings", rf"careers\.smartrecruiters\.com/{_ID}"], "https://api.smartrecruiters.com/v1/companies/%s/postings"),
    ("jobvite", [rf"jobs\.jobvite\.com/{_ID}"], "https://jobs.jobvite.com/%s"),
    ("icims", [rf"{_HOST}\.icims\.com"], "https://%s.icims.com/jobs"),
    ("taleo", [rf"{_HOST}\.taleo\.net"], "https://%s.taleo.net"),
    ("bamboohr", [rf"{_HOST}\.bamboohr\.com/(?:jobs|careers)"], "https://%s.bamboohr.com/jobs"),
    ("jazzhr", [rf"{_HOST}\.applytojob\.com"], "https://%s.applytojob.com"),
    ("recruitee", [rf"{_HOST}\.recruitee\.com"], "https://%s.recruitee.com/api/offers/"),
]
RESERVED = ["embed", "job_boards", "boards", "static"]
# What a page of a vendor holds, where it isn't the vendor's name.
MARKERS = {"lever": "lever.co", "workday": "myworkdayjobs", "jazzhr": "applytojob"}


def detect_ats(html: Column, final_url: Column) -> Column:
    """struct(ats, board_id, tenant, board, endpoint) of the first vendor whose pattern occurs; null if none does."""
    text = F.concat(empty(html), F.lit(" "), empty(final_url))
    found = []
    for vendor, patterns, form in VENDORS:
        for pattern in patterns:
            slug = F.regexp_extract(text, pattern, 1)
            hit = (slug != "") & ~F.lower(slug).isin(RESERVED) if vendor == "greenhouse" else slug != ""
            none = F.lit(None).cast("string")
            tenant = board = none
            end = F.format_string(form, *[slug] * form.count("%s"))
            if vendor == "workday":
                board = F.regexp_extract(text, pattern, 2)
                board = F.when(F.lower(board).isin("wday", "cxs"), "External").otherwise(board)
                tenant, end = slug, F.format_string(form, slug, slug, board)
            found.append(F.when(hit, F.struct(F.lit(vendor).alias("ats"), slug.alias("board_id"), tenant.alias("tenant"), board.alias("board"), end.alias("endpoint"))))
    return F.coalesce(*found)


def confidence(html: Column, ats: Column) -> Column:
    """high if an iframe's or script's source, or a script's text, holds the vendor's mark; else medium."""
    needle = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in MARKERS.items() for x in kv)), ats), ats)
    sources = F.regexp_extract_all(html, F.lit(r"(?is)<(?:iframe|script)\b[^>]*\bsrc\s*=\s*[\"']?([^\"'\s>]*)"), F.lit(1))
    scripts = F.regexp_extract_all(html, F.lit(r"(?is)<script\b[^>]*>(.*?)</script>"), F.lit(1))
    hit = lambda parts: F.exists(parts, lambda x: F.contains(F.lower(x), needle))
    return F.when(hit(sources) | hit(scripts), "high").otherwise("medium")


def catalog(companies: DataFrame, verified: Column) -> DataFrame:
    """Catalog entries of companies with html and final_url; undiscovered ones have ats ``undiscovered``."""
    found = companies.withColumn("_d", detect_ats(F.col("html"), F.col("final_url")))
    ok = F.col("_d").isNotNull()
    return found.select(
        "name", "domain", "careers_url", "final_url", F.coalesce("_d.ats", F.lit("undiscovered")).alias("detected_ats"),
        F.col("_d.board_id").alias("detected_board_id"), F.col("_d.tenant").alias("detected_workday_tenant"),
        F.col("_d.board").alias("detected_workday_board"), F.col("_d.endpoint").alias("api_endpoint"),
        F.when(ok, confidence(F.col("html"), F.col("_d.ats"))).alias("confidence"), F.when(ok, verified).alias("last_verified"),
    )


def drift(seed: DataFrame, detected: DataFrame) -> DataFrame:
    """Seed entries whose detected vendor or board differs; a board counts where both sides have one. Undiscovered and
    ``custom_html`` detections, and seeds without a vendor, are left out."""
    s = seed.select("name", "domain", F.col("ats").alias("seed_ats"), F.col("board_id").alias("seed_board_id"))
    d = detected.select("name", "detected_ats", "detected_board_id", "confidence").filter("detected_ats not in ('undiscovered', 'custom_html')")
    ats = F.col("seed_ats") != F.col("detected_ats")
    seeded, found = empty(F.col("seed_board_id")), empty(F.col("detected_board_id"))
    board = (seeded != "") & (found != "") & (F.lower(seeded) != F.lower(found))
    kind = F.when(ats, "ats_change").when(board, "board_id_change")
    return s.filter("seed_ats <> ''").join(d, "name").withColumn("kind", kind).filter("kind is not null")


def _failed(detected: DataFrame) -> Column:
    return empty(F.col("error")) != "" if "error" in detected.columns else F.lit(False)


def catalog_summary(detected: DataFrame) -> DataFrame:
    """Counts by vendor, the largest first (``place``, from 1; a row a vendor), with the discovered and the failed ones."""
    counts = detected.groupBy("detected_ats").agg(F.count("*").alias("n"), F.count_if(F.col("detected_ats") != "undiscovered").alias("discovered"), F.count_if(_failed(detected)).alias("errors"))
    return counts.withColumn("place", F.row_number().over(W.partitionBy().orderBy(F.col("n").desc(), "detected_ats"))).orderBy("place")


def catalog_errors(detected: DataFrame) -> DataFrame:
    """name, domain, error of the companies that failed."""
    return detected.filter(_failed(detected)).select("name", "domain", "error")


def drift_summary(seed: DataFrame, drifted: DataFrame) -> DataFrame:
    a = seed.groupBy(F.col("ats")).agg(F.count("*").alias("n_seed"))
    b = drifted.groupBy(F.col("seed_ats").alias("ats")).agg(F.count("*").alias("n_drift"), F.count_if(F.col("kind") == "ats_change").alias("n_ats"), F.count_if(F.col("kind") == "board_id_change").alias("n_board"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return a.join(b, "ats", "full_outer").select("ats", *(zero(c) for c in ("n_seed", "n_drift", "n_ats", "n_board")))


# The fields of an entry, in order.
ENTRY = ("name", "domain", "careers_url", "final_url", "detected_ats", "detected_board_id", "detected_workday_tenant", "detected_workday_board", "api_endpoint", "confidence", "last_verified")
ENTRIES = 1000  # of a document, about


def catalog_document(detected: DataFrame, generated_at: str, entries: int = ENTRIES) -> DataFrame:
    """The catalog as JSON documents (section, part, document): ``head`` with generated_at, total, discovered and the summary
    by vendor, the largest first; ``companies`` and ``errors``, by hash of the name in documents of about ``entries`` each.
    Nulls are left out."""
    by = catalog_summary(detected)
    counts = F.transform(F.array_sort(F.collect_list(F.struct("place", "detected_ats", "n"))), lambda x: F.struct(x["detected_ats"], x["n"]))  # a row a vendor
    head = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum("discovered"), F.lit(0)).alias("discovered"), F.map_from_entries(counts).alias("summary"))
    head = head.select(F.lit("head").alias("section"), F.lit(0).alias("part"), F.to_json(F.struct(F.lit(generated_at).alias("generated_at"), "total", "discovered", "summary")).alias("document"))

    def parted(rows: DataFrame, section: str, fields: list[str]) -> DataFrame:
        n = max(1, -(-rows.count() // entries))
        part = F.pmod(F.xxhash64("name"), F.lit(n)).cast("int")
        body = rows.select(part.alias("part"), "name", F.to_json(F.struct(*fields)).alias("entry")).groupBy("part").agg(F.array_sort(F.collect_list(F.struct("name", "entry"))).alias("e"))
        return body.select(F.lit(section).alias("section"), "part", F.concat(F.lit("["), F.array_join(F.transform("e", lambda x: x["entry"]), ","), F.lit("]")).alias("document"))

    out = head.unionByName(parted(detected, "companies", [c for c in ENTRY if c in detected.columns]))
    return out.unionByName(parted(catalog_errors(detected), "errors", ["name", "domain", "error"])) if "error" in detected.columns else out
