"""Projections, filters and predicates over postings, pages and companies. All narrow: no shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

from .. import vocab
from ..functions import text as T
from ..functions import url as U
from ..functions.text import empty

# Fixed values.
SPONSOR = r"(?i)(visa\s+sponsorship|sponsor(?:s|ed)?\s+h-?1b|h-?1b\s+sponsorship\s+available)"
NO_SPONSOR = r"(?i)(no\s+visa\s+sponsorship|will\s+not\s+sponsor|do\s+not\s+sponsor|unable\s+to\s+(?:offer|provide)\s+sponsorship)"
NOSCRIPT = r"(?i)<noscript[^>]*>[^<]*(?:enable\s+javascript|requires\s+javascript)"
SPA = r'(?i)(window\.__NEXT_DATA__|data-reactroot|id="__NUXT__"|ng-version=|window\.__INITIAL_STATE__)'


def _scope(scope: str) -> Column:
    title, desc = empty(F.col("title")), empty(F.col("description_text"))
    return F.lower({"title": title, "title_desc": F.concat(title, F.lit(" "), desc), "title_desc_trim": F.concat(title, F.lit("\n"), desc)}[scope])


def keyword_filter(df: DataFrame, include: list[str] | str, exclude: list[str] | str, scope: str = "title") -> DataFrame:
    """Keeps rows without an exclude term and, if there are include terms, with one of them (substrings, any case).

    Terms are lists or names of array columns. ``title_desc_trim`` trims terms and ignores blank ones, but a list of blanks
    only still is a list: it rejects.
    """
    text = _scope(scope)
    trimmed = scope == "title_desc_trim"

    def hits(terms: list[str] | str) -> tuple[Column, Column]:
        """(whether a term occurs, whether there are terms)."""
        if isinstance(terms, str):
            array = F.coalesce(F.col(terms), F.array().cast("array<string>"))
            clean = F.transform(array, lambda k: F.lower(F.trim(k) if trimmed else k))
            clean = F.filter(clean, lambda k: k != "") if trimmed else clean
            return F.exists(clean, lambda k: F.contains(text, k)), F.size(array) > 0
        clean = [k.strip().lower() if trimmed else k.lower() for k in terms]
        return T.has_token(text, [k for k in clean if k or not trimmed]), F.lit(bool(terms))

    bad, _ = hits(exclude)
    good, some = hits(include)
    return df.filter(~bad & (~some | good))


def flag_phrases(df: DataFrame, phrases: list[str], column: str = "description_text", out: str = "no_sponsorship_phrase") -> DataFrame:
    return df.withColumn(out, T.has_token(F.lower(empty(F.col(column))), phrases))


def sponsorship_flags(df: DataFrame, column: str = "description_text") -> DataFrame:
    text = empty(F.col(column))
    return df.withColumns({"mentions_sponsorship": text.rlike(SPONSOR), "no_sponsorship_phrase": text.rlike(NO_SPONSOR)})


def detect_remote(df: DataFrame, words: list[str] = vocab.REMOTE_WORDS) -> DataFrame:
    blob = F.lower(F.concat(empty(F.col("location")), F.lit(" "), empty(F.col("description_text"))))
    return df.withColumn("remote", F.coalesce(F.col("remote"), F.lit(False)) | T.has_token(blob, words))


def normalize_extracted(df: DataFrame) -> DataFrame:
    """Extracted rows (with company and base_url) to postings; rows without a title or URL are dropped."""
    rows = df.withColumns({"url": U.canonical(empty(F.col("url")), F.col("base_url")), "title": F.trim(empty(F.col("title"))), "description_text": F.trim(empty(F.col("description_text"))), "location": F.trim(empty(F.col("location")))})
    rows = rows.filter((F.col("title") != "") & (F.col("url") != ""))
    rows = sponsorship_flags(detect_remote(rows))
    return rows.withColumns({"source_id": U.stable_id(F.col("url")), "source": F.lit("html"), "description_html": F.lit("")}).drop("base_url")


def needs_js(html: Column, least_anchors: int = 8) -> Column:
    return html.rlike(NOSCRIPT) | ((T.anchor_count(html) < least_anchors) & html.rlike(SPA))


def sanity_cap(rows: DataFrame, pages: DataFrame, page: str = "page_id", least: int = 200) -> DataFrame:
    """Drops all rows of a page that has more than max(3 anchors, ``least``). Counts are joined back, so a page of very
    many rows is no window in one task."""
    caps = pages.select(page, F.greatest(3 * T.anchor_count(F.col("html")), F.lit(least)).alias("_cap"))
    over = rows.groupBy(page).agg(F.count("*").alias("_n")).join(caps, page).filter("_n > _cap").select(page)
    return rows.join(over, page, "left_anti")


def by_tier(df: DataFrame, tier: int) -> DataFrame:
    return df.filter(F.col("tier") <= tier)


def gate(df: DataFrame, least: float = 0.65) -> DataFrame:
    return df.filter(F.col("score") >= least)


def match_gate(df: DataFrame) -> DataFrame:
    """``match_threshold`` and ``visa_ok`` come with the row."""
    return df.filter((F.col("score") >= F.coalesce(F.col("match_threshold"), F.lit(0.65))) & F.col("visa_ok"))


def valid_identity(df: DataFrame) -> DataFrame:
    return df.filter(empty(F.col("source_id")) != "")


def list_applications(df: DataFrame, person: str | None = None, status: str | None = None, limit: int = 100) -> DataFrame:
    if person:
        df = df.filter(F.col("person_id") == person)
    if status:
        df = df.filter(F.col("status") == status)
    return df.orderBy(F.col("created_at").desc(), "id").limit(limit)


def _searched() -> Column:
    return F.lower(F.concat_ws(" ", empty(F.col("title")), empty(F.col("description_text")), empty(F.col("department"))))


def role_class(tokens: list[str]) -> Column:
    return T.has_token(F.lower(F.concat_ws(" ", empty(F.col("title")), empty(F.col("department")))), [t.lower() for t in tokens])


def text_filter(df: DataFrame, needle: str) -> DataFrame:
    return df.filter(F.contains(_searched(), F.lit(needle.lower())))


def company_filter(df: DataFrame, needle: str) -> DataFrame:
    return df.filter(F.contains(F.lower(empty(F.col("company"))), F.lit(needle.lower())))


def html_tasks(companies: DataFrame, known_modules: list[str], only: list[str] | None = None) -> DataFrame:
    module = F.lower(F.trim(empty(F.col("custom_module"))))
    name = F.coalesce(T.non_empty(empty(F.col("name"))), F.col("board_id"))
    rows = companies.filter((F.col("ats") == "custom") & ~((module != "") & module.isin(known_modules)))
    rows = rows.withColumn("name", name).filter((empty(F.col("name")) != "") & (empty(F.col("career_url")) != ""))
    return rows.filter(F.lower("name").isin([o.lower() for o in only])) if only else rows


def career_url(overrides: dict[str, str]) -> Column:
    """Explicit URL, then the override of the name, then the domain's /careers."""
    pairs = [F.lit(x) for kv in overrides.items() for x in kv]
    override = F.element_at(F.create_map(*pairs), F.col("name")) if pairs else F.lit(None).cast("string")
    return F.coalesce(T.non_empty(F.col("career_url")), override, F.concat(F.lit("https://"), F.col("domain"), F.lit("/careers")))


# Places where companies keep their openings, in the order in which they are tried.
TEMPLATES = [
    "https://{d}/careers", "https://{d}/jobs", "https://{d}/about/careers", "https://{d}/about/jobs",
    "https://{d}/company/careers", "https://{d}/work-with-us", "https://{d}/join-us", "https://careers.{d}",
    "https://jobs.{d}", "https://corporate.{d}/careers", "https://corp.{d}/careers", "https://www.{d}/careers",
]
HOST_TEMPLATES = ["https://{d}/", "https://{d}/careers", "https://{d}/jobs"]


def candidate_urls(companies: DataFrame, templates: list[str] = TEMPLATES, host_templates: list[str] = HOST_TEMPLATES) -> DataFrame:
    """A row for each place to look, in order: few for a career host, and first the seed URL where it is a true override."""
    own = F.lower(F.trim("domain"))
    d = U.plain_domain(F.col("domain"))
    made = lambda ts, x: F.array(*(F.concat(F.lit(t.split("{d}")[0]), x, F.lit(t.split("{d}")[1])) for t in ts))
    urls = F.when(own.rlike(r"^(careers|jobs)\.") | own.endswith(".jobs"), made(host_templates, own)).otherwise(made(templates, d))
    seed = F.trim(empty(F.col("career_url")))
    usual = [F.concat(F.lit("https://"), x, F.lit("/careers")) for x in (d, F.col("domain"))]
    first = F.when((seed != "") & (seed != usual[0]) & (seed != usual[1]), F.array(seed)).otherwise(F.array().cast("array<string>"))
    return companies.select("name", F.posexplode(F.array_distinct(F.concat(first, urls))).alias("rank", "url"))


# The host whose rate limit holds for each vendor.
ATS_HOSTS = {"greenhouse": "api.greenhouse.io", "lever": "api.lever.co", "ashby": "api.ashbyhq.com", "smartrecruiters": "api.smartrecruiters.com"}


def rate_domain(hosts: dict[str, str] = ATS_HOSTS) -> Column:
    domain = T.non_empty(F.col("domain"))
    chain = reduce(lambda c, kv: c.when(F.col("ats") == kv[0], kv[1]), hosts.items(), F.when(F.lit(False), ""))
    return F.coalesce(chain, domain, F.when(F.col("ats") == "workday", "myworkdayjobs.com"), F.col("name"))


def conform(df: DataFrame, schema: StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """Exactly the columns of ``schema``: missing ones take defaults, others are cast, extras are dropped."""
    defaults = defaults or {}

    def column(f) -> Column:
        c = F.col(f"`{f.name}`").cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        return (F.coalesce(c, F.lit(defaults[f.name]).cast(f.dataType)) if f.name in defaults else c).alias(f.name)

    return df.select(*(column(f) for f in schema.fields))


def flatten_scored(df: DataFrame) -> DataFrame:
    return df.select("job.*", "score")


# Marks of error messages; a message is permanent if it has one of the first, else transient for the second.
PERMANENT = ["404", "403", "401", "not found", "Forbidden", "Unauthorized", "board_id required", "tenant+board required", "unknown custom module"]
TRANSIENT = ["429", "503", "502", "500", "connection reset", "EOF", "connection refused", "timeout"]


def classify_error(message: Column, permanent: list[str] = PERMANENT, transient: list[str] = TRANSIENT) -> Column:
    text = empty(message)
    return F.when(T.has_token(text, permanent), "permanent").when(T.has_token(text, transient), "transient").otherwise("other")


def top_per(df: DataFrame, key: list[str], order: list[Column], n: int = 1) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")
