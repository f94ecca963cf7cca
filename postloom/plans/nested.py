"""Registered queries on payloads, nested documents and streams."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog as C
from ..operators import coverage as K
from ..operators import joins as J
from ..operators import scoring as S
from ..operators import tracking as TR
from ..sources import payloads as P
from ..sources import tables as TB
from ..streaming import jobs
from . import bindings as V_
from .queries import _DETECTED, _SEEN, _detected, _list, _seen

QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# ---- payloads: pages of at most 100 postings of a company, in a vendor's form ---------------------------------------

PAGE = 100
ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def _pages(df: DataFrame, row: Column, wrap=lambda rows: rows) -> DataFrame:
    page = F.floor(F.col("doc_id") / PAGE).alias("page")
    return df.groupBy("company", page).agg(F.to_json(wrap(F.array_sort(F.collect_list(row)))).alias("payload")).withColumn("board_id", F.col("company"))


def _jobs(name: str):
    return lambda rows: F.struct(rows.alias(name))


def _iso() -> Column:
    return F.date_format("posted_at", ISO)


def _body() -> Column:
    return F.concat(F.lit("<p>"), F.coalesce("description_text", F.lit("")), F.lit("</p>"))


_STRIP = "trim(regexp_replace(regexp_replace(regexp_replace('<p>' || coalesce(description_text, '') || '</p>', '<[^>]*(>|$)', ' ', 'g'), '>', '', 'g'), '\\s+', ' ', 'g'))"
_OUT = ["company", "source", "source_id", "title", "description_text", "url", "location", "department", "remote"]


def _shown(df: DataFrame, dated: bool = True) -> DataFrame:
    return df.select(*_OUT, F.date_format("posted_at", "yyyy-MM-dd").alias("posted") if dated else F.lit(None).cast("string").alias("posted"))


def _expected(source: str, desc: str = "''", url: str = "url", location: str = "location", department: str = "department", remote: str = "false", posted: str = "strftime(posted_at, '%Y-%m-%d')", where: str = "true") -> str:
    return f"WITH {V_.POST} SELECT company, '{source}' AS source, source_id, title, {desc} AS description_text, {url} AS url, {location} AS location, {department} AS department, {remote} AS remote, {posted} AS posted FROM v_post WHERE {where}"


@query(_expected("greenhouse", _STRIP))
def a03_greenhouse(spark, sf):
    row = F.struct(F.col("doc_id").alias("id"), "title", _body().alias("content"), F.col("url").alias("absolute_url"), _iso().alias("updated_at"), F.struct(F.col("location").alias("name")).alias("location"), F.array(F.struct(F.col("department").alias("name"))).alias("departments"))
    return _shown(P.normalize_greenhouse(_pages(V_.post(spark, sf), row, _jobs("jobs"))))


_BOTH = _STRIP.replace("'</p>'", "'</p>more<b> text</b>'")
_SOME_DAYS = "CASE WHEN doc_id % 5 <> 0 THEN strftime(posted_at, '%Y-%m-%d') END"


@query(_expected("lever", f"CASE WHEN doc_id % 2 = 0 AND description_text <> '' THEN description_text ELSE {_BOTH} END", location="CASE WHEN doc_id % 3 = 0 THEN 'Elsewhere' ELSE location END", posted=_SOME_DAYS))
def a04_lever(spark, sf):
    """The text of both HTML parts, end to end, where there is no plain one; a time of 0 is none."""
    i = F.col("doc_id")
    place = F.when(i % 3 == 0, "").otherwise(F.col("location"))
    row = F.struct(F.col("source_id").alias("id"), F.col("title").alias("text"), _body().alias("description"), F.lit("more<b> text</b>").alias("additional"), F.when(i % 2 == 0, F.col("description_text")).otherwise("").alias("descriptionPlain"), F.col("url").alias("hostedUrl"), F.when(i % 5 == 0, 0).otherwise(F.unix_seconds("posted_at") * 1000).alias("createdAt"), F.struct(place.alias("location"), F.col("department").alias("team"), F.array(F.lit("Elsewhere")).alias("allLocations")).alias("categories"))
    return _shown(P.normalize_lever(_pages(V_.post(spark, sf), row), first_location=True))


@query(_expected("ashby", _STRIP, location="CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'Remote' WHEN doc_id % 2 = 0 THEN '' ELSE location END", remote="doc_id % 3 = 0"))
def a05_ashby(spark, sf):
    place = F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("location"))
    row = F.struct(F.col("source_id").alias("id"), "title", _body().alias("descriptionHtml"), F.col("url").alias("jobUrl"), place.alias("location"), "department", F.col("remote").alias("isRemote"), _iso().alias("publishedAt"))
    return _shown(P.normalize_ashby(_pages(V_.post(spark, sf), row, _jobs("jobs"))))


@query(_expected("smartrecruiters", url="'https://jobs.smartrecruiters.com/' || company || '/' || source_id", location="CASE WHEN remote THEN 'Remote' ELSE trim(split_part(location, ', ', 1) || ', ' || split_part(location, ', ', 2)) END", remote="remote"))
def a06_smartrecruiters(spark, sf):
    city, country = F.substring_index("location", ", ", 1), F.when(F.contains("location", F.lit(", ")), F.substring_index("location", ", ", -1)).otherwise("")
    row = F.struct(F.col("source_id").alias("id"), F.col("title").alias("name"), F.struct(city.alias("city"), country.alias("country"), "remote").alias("location"), F.struct(F.col("department").alias("label")).alias("department"), F.date_format("posted_at", "yyyy-MM-dd").alias("releasedDate"))
    return _shown(P.normalize_smartrecruiters(_pages(V_.post(spark, sf), row, _jobs("content"))))


@query(_expected("workday", "CASE WHEN doc_id % 6 = 0 AND description_text <> '' THEN description_text ELSE title END", url="'https://' || company || '.wd5.myworkdayjobs.com/en-US/Careers/job/' || source_id", department="NULL", posted="CASE WHEN doc_id % 5 = 0 THEN strftime(posted_at, '%Y-%m-%d') END").replace("source_id, title", "CASE WHEN doc_id % 4 = 0 THEN '/job/' || source_id ELSE source_id END AS source_id, title"))
def a07_workday(spark, sf):
    """Two boards that hold the same rows; some dates are ISO, some texts are given."""
    i = F.col("doc_id")
    ids = F.when(i % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("source_id"))
    row = F.struct("title", F.concat(F.lit("/job/"), F.col("source_id")).alias("externalPath"), F.when(i % 5 == 0, _iso()).otherwise("Posted 3 Days Ago").alias("postedOn"), F.col("location").alias("locationsText"), ids.alias("bulletFields"), F.struct(F.when(i % 6 == 0, F.col("description_text")).alias("text")).alias("jobDescription"))
    raw = _pages(V_.post(spark, sf), row, _jobs("jobPostings")).withColumns({"board_rank": F.lit(0), "workday_tenant": F.col("company"), "workday_board": F.lit("Careers")})
    again = raw.withColumns({"board_rank": F.lit(1), "workday_board": F.lit("second")})
    return _shown(P.normalize_workday(raw.unionByName(again)))


@query(_expected("apple", "title || '. Team: ' || department || '. ' || CASE WHEN doc_id % 2 = 0 THEN description_text ELSE '' END", url="'https://jobs.apple.com/en-us/details/' || source_id || '/some-slug'", location="CASE WHEN doc_id % 4 = 0 THEN 'Cupertino' ELSE location || ', Zürich' END"))
def a08_apple(spark, sf):
    """The home office, where one is named, else all locations."""
    i = F.col("doc_id")
    row = F.struct(F.col("source_id").alias("positionId"), F.col("title").alias("postingTitle"), F.lit("some-slug").alias("transformedPostingTitle"), F.when(i % 2 == 0, F.col("description_text")).alias("postingDescription"), F.when(i % 4 == 0, "Cupertino").otherwise("").alias("homeOffice"), F.struct(F.col("department").alias("teamName")).alias("team"), F.date_format("posted_at", "MMM d, yyyy").alias("postingDate"), F.array(F.struct(F.col("location").alias("name")), F.struct(F.lit("Zürich").alias("name"))).alias("locations"))
    return _shown(P.normalize_apple(_pages(V_.post(spark, sf), row, _jobs("searchResults"))))


@query(_expected("google", _STRIP, url="CASE WHEN doc_id % 2 = 0 THEN 'https://careers.google.com/jobs/results/' || source_id ELSE url END", location="location || ', Zürich'"))
def a09_google(spark, sf):
    row = F.struct(F.col("source_id").alias("id"), "title", _body().alias("description"), F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("url")).alias("apply_url"), F.array(F.col("location"), F.lit("Zürich")).alias("locations"), "department", F.date_format("posted_at", "yyyy-MM-dd").alias("date"))
    return _shown(P.normalize_google(_pages(V_.post(spark, sf), row, _jobs("jobs"))))


@query(_expected("amazon", _STRIP, url="'https://www.amazon.jobs/en/' || source_id"))
def a10_amazon(spark, sf):
    row = F.struct(F.col("doc_id").alias("id_icims"), "title", F.concat(F.lit("/en/"), F.col("source_id")).alias("job_path"), F.col("location").alias("normalized_location"), F.lit("no team").alias("category"), F.col("department").alias("team"), _body().alias("description"), F.date_format("posted_at", "MMMM d, yyyy").alias("posted_date"))
    return _shown(P.normalize_amazon(_pages(V_.post(spark, sf), row, _jobs("jobs"))))


@query(_expected("meta", _STRIP, url="CASE WHEN doc_id % 2 = 0 THEN 'https://www.metacareers.com/jobs/' || source_id || '/' ELSE url END", location="location || ', Zürich'", department="CASE WHEN doc_id % 3 = 0 THEN '' ELSE department END", posted="NULL", where="doc_id // 100 % 2 = 0"))
def a11_meta(spark, sf):
    i = F.col("doc_id")
    teams = F.when(i % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("department", F.lit("second")))
    row = F.struct(F.col("source_id").alias("id"), "title", F.array("location", F.lit("Zürich")).alias("locations"), teams.alias("teams"), _body().alias("description"), F.when(i % 2 == 0, "").otherwise(F.col("url")).alias("url"))
    ok = lambda rows: F.struct(F.struct(F.struct(rows.alias("results")).alias("job_search")).alias("data"))
    bad = lambda rows: F.struct(F.struct(F.struct(rows.alias("results")).alias("job_search")).alias("data"), F.array(F.struct(F.lit("limit").alias("message"))).alias("errors"))
    post = V_.post(spark, sf)
    odd = F.floor(F.col("doc_id") / PAGE) % 2 == 1
    return _shown(P.normalize_meta(_pages(post.filter(~odd), row, ok).unionByName(_pages(post.filter(odd), row, bad))), False)


@query(f"""WITH {V_.COMPANY} SELECT name, CASE WHEN ats = 'workday' THEN 'tenant+board required' WHEN ats IN ('greenhouse', 'lever', 'ashby', 'smartrecruiters') THEN 'board_id required' ELSE 'unsupported ats: ' || ats END AS error FROM v_company
WHERE ats IN ('workday', 'zoho') OR (ats IN ('greenhouse', 'lever', 'ashby', 'smartrecruiters') AND suppkey % 2 = 0)""")
def a12_config_errors(spark, sf):
    c = V_.company(spark, sf).withColumns({"board_id": F.when(F.col("suppkey") % 2 == 0, "").otherwise(F.col("board_id")), "workday_tenant": F.lit(None).cast("string"), "workday_board": F.lit(None).cast("string")})
    return P.config_errors(c).select("name", "error")


@query(f"WITH {V_.POST} SELECT source_id AS page, title, url, location, remote FROM v_post WHERE doc_id % 5 <> 4")
def a13_extracted(spark, sf):
    i = F.col("doc_id")
    one = F.to_json(F.struct("title", "url", "location", "remote"))
    many = F.concat(F.lit('{"jobs": ['), one, F.lit(', "no object"]}'))
    forms = F.when(i % 5 == 0, many).when(i % 5 == 1, F.concat(F.lit("<think>let me\nsee</think>\n```json\n"), many, F.lit("\n```"))).when(i % 5 == 2, F.concat(F.lit("["), one, F.lit("]"))).when(i % 5 == 3, F.concat(F.lit("Here it is: "), many, F.lit(" done"))).otherwise("nothing here")
    raw = V_.post(spark, sf).select(F.col("source_id").alias("page"), forms.alias("answer"))
    return P.parse_extracted(raw, "answer").select("page", "title", "url", "location", "remote")


@query(f"WITH {V_.POST} SELECT source_id, company, title, location FROM v_post")
def a14_ndjson(spark, sf):
    """Written as lines to the shared folder and read back; malformed lines and rows without a company are dropped."""
    path = jobs.shared_dir(spark, "ndjson")
    post = V_.post(spark, sf).select("source_id", "company", "title", "location", "url")
    TB.write_postings_ndjson(post, path)
    junk = post.filter("cast(source_id as int) % 9 = 0").select(F.concat(F.lit("{broken "), F.col("source_id")).alias("value"))
    junk.write.mode("append").text(path)
    post.select("source_id", "title").write.mode("append").json(path)
    return TB.read_postings_ndjson(spark, path).select("source_id", "company", "title", "location")


@query(f"WITH {V_.COMPANY} SELECT name, CASE WHEN suppkey % 5 = 0 THEN 2 ELSE tier END AS tier, CASE WHEN ats = 'zoho' THEN 'unknown' ELSE ats END AS ats FROM v_company")
def a01_company_registry(spark, sf):
    c = V_.company(spark, sf).withColumns({"tier": F.when(F.col("suppkey") % 5 == 0, 0).otherwise(F.col("tier")), "ats": F.upper("ats")})
    wrapped = c.groupBy((F.col("suppkey") % 50).alias("file")).agg(F.collect_list(F.struct("name", "tier", "ats")).alias("companies"))
    return TB.company_registry(wrapped).select("name", "tier", "ats")


@query(f"WITH {V_.COMPANY} SELECT name, CASE WHEN suppkey % 2 = 0 THEN 'nested' ELSE 'flat' END AS workday_tenant, 'apple' AS custom_module, 1 AS n_params FROM v_company WHERE suppkey % 7 <> 0")
def a02_resolve_config(spark, sf):
    k = F.col("suppkey")
    c = V_.company(spark, sf).withColumns({
        "workday": F.struct(F.when(k % 2 == 0, "nested").otherwise("").alias("tenant"), F.lit("b").alias("board")), "workday_tenant": F.lit("flat"), "workday_board": F.lit("f"),
        "custom": F.struct(F.lit("pkg.custom.apple").alias("scraper_module"), F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit(None).cast("string")).alias("params")), "active": k % 7 != 0,
    })
    return TB.resolve_config(c).select("name", "workday_tenant", "custom_module", F.size("custom_params").alias("n_params"))


@query(f"WITH {V_.POST} SELECT source_id, title FROM v_post WHERE doc_id % 3 <> 0 AND posted_at >= TIMESTAMP '2024-01-24 06:00:00'")
def a16_topic_rows(spark, sf):
    p = V_.post(spark, sf)
    good = p.select(F.to_json(F.struct("source_id", "title", F.date_format("posted_at", ISO).alias("posted_at"))).alias("value"), "doc_id")
    rows = good.withColumn("value", F.when(F.col("doc_id") % 3 == 0, F.when(F.col("doc_id") % 2 == 0, "{oops").otherwise(F.repeat(F.col("value"), 40000))).otherwise(F.col("value")))
    return TB.topic_rows(rows, "source_id string, title string, posted_at timestamp", F.lit(V_.AS_OF).cast("timestamp"), "posted_at").select("source_id", "title")


@query(f"WITH {V_.COMPANY} SELECT ats AS name, suppkey AS place, career_url AS url FROM v_company QUALIFY row_number() OVER (PARTITION BY ats ORDER BY suppkey DESC) = 1")
def a18_load_targets(spark, sf):
    raw = V_.company(spark, sf).select(F.col("ats").alias("name"), F.col("suppkey").alias("place"), F.struct("career_url").alias("s")).select("name", "place", F.col("place").alias("at"), F.col("s.career_url").alias("url"))
    return TB.load_targets(raw).select("name", F.col("at").alias("place"), "url")


@query(f"""WITH {V_.POST} SELECT kind, source_id, title FROM v_post, (VALUES ('greenhouse'), ('ashby'), ('amazon')) k(kind) WHERE doc_id % 3 <> 2""")
def a12_route(spark, sf):
    """Pages of several vendors in one table, each by its kind; those of an unknown kind give no rows."""
    post = V_.post(spark, sf)
    rows = {
        "greenhouse": F.struct(F.col("doc_id").alias("id"), "title", F.col("url").alias("absolute_url")),
        "ashby": F.struct(F.col("source_id").alias("id"), "title", F.col("url").alias("jobUrl")),
        "amazon": F.struct(F.col("doc_id").alias("id_icims"), "title"),
        "nobody": F.struct("title"),
    }
    known = {kind: _pages(post.filter("doc_id % 3 <> 2" if kind != "nobody" else "true"), row, _jobs("jobs")).withColumn("kind", F.lit(kind)) for kind, row in rows.items()}
    out = P.route_payloads(J.union_postings(*known.values()))
    return out.select(F.col("source").alias("kind"), "source_id", "title")


@query(f"WITH {V_.POST} SELECT source_id, title FROM v_post WHERE octet_length(encode(to_json(struct_pack(source_id := source_id, title := title, text := description_text)))) <= 524288")
def a16_topic(spark, sf):
    """Rows written to a topic and read back as a stream; messages over the limit are dropped."""
    path = jobs.shared_dir(spark, "topic")
    TB.write_topic(V_.post(spark, sf).select("source_id", "title", F.col("description_text").alias("text")), path)
    return jobs.drain(TB.read_topic(spark, path, "source_id string, title string, text string"), "topic-rows").select("source_id", "title")


@query(f"WITH {V_.POST} SELECT source_id, title FROM v_post WHERE posted_at >= TIMESTAMP '2024-01-24 06:00:00'")
def a16_retention(spark, sf):
    """Rows in a folder for each day; days beyond the retention are dropped as folders, and older messages in the stream."""
    path, as_of = jobs.shared_dir(spark, "topic-days"), F.lit(V_.AS_OF).cast("timestamp")
    TB.write_topic(V_.post(spark, sf).select("source_id", "title", "posted_at"), path, "posted_at")
    TB.expire_topic(spark, path, date.fromisoformat(V_.AS_OF[:10]))
    stream = TB.read_topic(spark, path, "source_id string, title string, posted_at timestamp", as_of, "posted_at")
    return jobs.drain(stream, "topic-kept").select("source_id", "title")


@query(f"WITH {V_.APP} SELECT id, person_id, status, CAST(CAST(id AS BIGINT) % 100 AS VARCHAR) AS company, CAST(NULL AS VARCHAR) AS notes FROM v_app")
def a19_applications(spark, sf):
    """Applications written and read back with the columns of a schema: missing ones are null, others are cast or dropped."""
    path = jobs.shared_dir(spark, "applications")
    V_.app(spark, sf).withColumns({"company": F.col("id").cast("long") % 100, "extra": F.lit(1)}).write.parquet(path)
    return TB.read_applications(spark, path, "id string, person_id string, status string, company string, notes string")


@query(f"""WITH {V_.COMPANY}{_DETECTED}, c AS (SELECT detected_ats, count(*) AS n FROM v_detected GROUP BY detected_ats)
SELECT 'total' AS what, CAST(count(*) AS VARCHAR) AS value FROM v_detected UNION ALL SELECT 'discovered', CAST(count(*) FILTER (detected_ats <> 'undiscovered') AS VARCHAR) FROM v_detected UNION ALL SELECT 'generated_at', '{V_.AS_OF}'
UNION ALL SELECT 'summary', '{{' || string_agg('"' || detected_ats || '":' || n, ',' ORDER BY n DESC, detected_ats) || '}}' FROM c
UNION ALL SELECT 'company ' || name, detected_ats || '|' || detected_board_id FROM v_detected UNION ALL SELECT 'error ' || name, domain || '|' || error FROM v_detected WHERE error <> ''""")
def a20_catalog_document(spark, sf):
    docs = C.catalog_document(_detected(spark, sf), V_.AS_OF, 20)
    head = docs.filter("section = 'head'").select(F.explode(F.array(*(F.struct(F.lit(k).alias("what"), F.get_json_object("document", f"$.{k}").alias("value")) for k in ("total", "discovered", "generated_at", "summary")))).alias("h")).select("h.*")

    def listed(section: str, word: str, a: str, b: str) -> DataFrame:
        rows = docs.filter(F.col("section") == section).select(F.explode(F.from_json("document", f"array<struct<name: string, {a}: string, {b}: string>>")).alias("e"))
        return rows.select(F.concat(F.lit(word), F.col("e.name")).alias("what"), F.concat_ws("|", f"e.{a}", f"e.{b}").alias("value"))

    return head.unionByName(listed("companies", "company ", "detected_ats", "detected_board_id")).unionByName(listed("errors", "error ", "domain", "error"))


@query(f"WITH {V_.KEYED} SELECT substr(key, 1, 16) AS dedup_id, 'local:' || substr(key, 1, 16) || '/report.md' AS path, description_text AS report FROM v_keyed")
def a21_reports(spark, sf):
    """Reports written as one file a key, and read back by their path."""
    root = jobs.shared_dir(spark, "reports") + "/files"
    df = V_.keyed(spark, sf).select(F.substring("key", 1, 16).alias("dedup_id"), F.col("description_text").alias("report"))
    TB.write_reports(df, root)
    return TB.read_reports(spark, root)


# ---- vendor detection ----------------------------------------------------------------------------------------------

_LINKS = [
    "https://boards.greenhouse.io/embed", "https://job-boards.greenhouse.io/acme_1", "https://jobs.eu.lever.co/acme", "https://jobs.ashbyhq.com/ac.me",
    "https://acme.wd5.myworkdayjobs.com/wday/cxs/acme/Careers", "https://careers.smartrecruiters.com/Acme", "https://jobs.jobvite.com/acme", "https://acme.icims.com/x",
    "https://acme.taleo.net", "https://acme.bamboohr.com/jobs", "https://acme.applytojob.com", "https://acme.recruitee.com", "https://nothing.example.com",
]
_FOUND = ["", "greenhouse:acme_1", "lever:acme", "ashby:ac.me", "workday:acme", "smartrecruiters:Acme", "jobvite:acme", "icims:acme", "taleo:acme", "bamboohr:acme", "jazzhr:acme", "recruitee:acme", ""]


@query(f"SELECT page_id, nullif({_list(_FOUND)}[page_id % 13 + 1], '') AS found, CASE WHEN {_list(_FOUND)}[page_id % 13 + 1] = '' THEN NULL WHEN page_id % 2 = 0 THEN 'high' ELSE 'medium' END AS confidence FROM pages")
def h26_detect_ats(spark, sf):
    link = V_._pick(_LINKS, F.col("page_id"))
    html = F.when(F.col("page_id") % 2 == 0, F.concat("html", F.lit('<iframe src="'), link, F.lit('"></iframe>'))).otherwise(F.concat("html", F.lit('<a href="'), link, F.lit('">jobs</a>')))
    p = V_.table(spark, sf, "pages").select("page_id", html.alias("h"), F.lit("https://x.example.com").alias("u"))
    d = p.select("page_id", "h", C.detect_ats(F.col("h"), F.col("u")).alias("d"))
    return d.select("page_id", F.concat_ws(":", "d.ats", "d.board_id").alias("f"), F.when(F.col("d").isNotNull(), C.confidence(F.col("h"), F.col("d.ats"))).alias("confidence")).select("page_id", T.non_empty(F.col("f")).alias("found"), "confidence")


# ---- nested documents ----------------------------------------------------------------------------------------------

_TERMS = ["of the", "the", "license", "and", "with the", "zzz"]


def _word(text: str, term: str) -> str:
    return f"regexp_matches({text}, '(^|[^\\pL\\pN_]){term}($|[^\\pL\\pN_])')"


_BLANKED = "replace(replace(d, 'with the', repeat(' ', 8)), 'of the', repeat(' ', 6))"
def _left(term: str) -> str:
    """The text in which a term of several words is looked for."""
    return "d" if term == "with the" else "replace(d, 'with the', repeat(' ', 8))"


_TERMS_SQL = "list_sort(list_filter([" + ", ".join(f"CASE WHEN contains({_left(t)}, '{t}') THEN '{t}' END" if " " in t else f"CASE WHEN {_word('b', t)} THEN '{t}' END" for t in _TERMS) + "], lambda x: x IS NOT NULL))"
_HIT_SQL = "CASE " + " ".join(f"WHEN x = '{t}' THEN " + (f"contains(doc, '{t}')" if " " in t else _word("doc", t)) for t in _TERMS) + " ELSE false END"


@query(f"""WITH {V_.POST}, b AS (SELECT source_id, lower(description_text) AS d, {_BLANKED.replace("d,", "lower(description_text),")} AS b, lower(title) AS doc FROM v_post), k AS (SELECT source_id, doc, {_TERMS_SQL} AS l FROM b), m AS (SELECT source_id, l, list_filter(l, lambda x: {_HIT_SQL}) AS m FROM k)
SELECT source_id, array_to_string(l, ',') AS keywords, array_to_string(m, ',') AS matched, CAST(CASE WHEN len(l) = 0 THEN 0 ELSE round_even(100.0::DOUBLE * len(m) / len(l), 0) END AS INTEGER) AS coverage FROM m""")
def i07_coverage(spark, sf):
    out = K.keyword_coverage(V_.post(spark, sf), "description_text", "title", _TERMS)
    return out.select("source_id", F.array_join("jd_keywords", ",").alias("keywords"), F.array_join("matched_keywords", ",").alias("matched"), "coverage")


_BOTH = f"{V_.bullets_sql('v_base', 'user')}, {V_.bullets_sql('v_new', 'assistant')}"


@query(f"""WITH {_BOTH}, p AS (SELECT DISTINCT doc, role_index FROM v_base), r AS (SELECT b.doc, b.role_index, b.bullet_index, CASE WHEN b.doc % 4 = 0 THEN 'rewritten' WHEN b.doc % 4 = 1 THEN CASE WHEN b.n = 1 THEN b.bullet END ELSE b.bullet END AS line FROM (SELECT *, row_number() OVER (PARTITION BY doc, role_index ORDER BY bullet_index) AS n FROM v_base) b WHERE b.doc % 4 <> 0 OR b.n = 1)
SELECT doc, coalesce(string_agg(line, chr(10) ORDER BY bullet_index), '') AS blob FROM r GROUP BY doc""")
def i08_blob(spark, sf):
    b = V_.bullets(spark, sf, "user")
    plan = b.filter("doc % 4 < 2").select("doc", "role_index").distinct()
    none = F.array().cast("array<string>")
    plan = plan.withColumns({"keep": F.array(F.lit(1), F.lit(99)), "rewrites": F.when(F.col("doc") % 4 == 0, F.array(F.lit(" rewritten "), F.lit(" "))).otherwise(none)})
    return K.resume_blob(b, plan)


_REPORT_SQL = {
    "key": "key", "company": "company", "title": "title", "url": "url", "location": "location", "remote": "remote", "scraped_at": "strftime(scraped_at, '%Y-%m-%d')",
    "tailored_at": "'2024-02-01'", "person": f"'{V_.PERSON}'", "raw_match_score": "(doc_id % 100) / 100.0::DOUBLE", "ats_score": "CAST(doc_id % 50 AS INTEGER)",
    "ats_keywords_matched": "'the|and'", "ats_keywords_missing": "'zzz'", "ats_keywords_total": "3", "recruiter_score": "CASE WHEN doc_id % 2 = 0 THEN CAST(least(100, doc_id % 70 + 50) AS INTEGER) END",
    "recruiter_breakdown": "CASE WHEN doc_id % 2 = 0 THEN '{\"jd_match\":' || doc_id % 70 || ',\"clarity\":50}' END", "archetype": "'builder'",
    "company_type": "CASE WHEN doc_id % 5 <> 0 THEN 'startup' END", "priority_frame": "CASE WHEN doc_id % 5 <> 0 THEN 'scale' END",
    "jd_required_skills": "CASE WHEN doc_id % 5 <> 0 AND doc_id % 3 = 0 THEN 'a|b' ELSE '' END", "jd_preferred_skills": "CASE WHEN doc_id % 5 <> 0 THEN 'c' ELSE '' END",
    "jd_core_responsibilities": "''", "jd_hidden_keywords": "''", "jd_requirements": "CASE WHEN doc_id % 5 <> 0 AND doc_id % 3 = 0 THEN 'a|b' ELSE 'legacy' END",
    "skills_emphasized": "CASE WHEN doc_id % 4 = 0 THEN 'lead' ELSE 'old' END", "missing_skill_risks": "''", "interview_callback_estimate": "'40%'",
    "confidence_breakdown": "'{\"HIGH\":1,\"MEDIUM\":0,\"LOW\":0,\"UNKNOWN\":' || doc_id % 2 || '}'",
}


@query(f"WITH {V_.KEYED} SELECT {', '.join(f'{v} AS {k}' for k, v in _REPORT_SQL.items())} FROM v_keyed")
def i09_report(spark, sf):
    k, i = V_.keyed(spark, sf), F.col("doc_id")
    jobs_ = k.select("key", "company", "title", "url", "location", "remote", F.date_format("scraped_at", "yyyy-MM-dd").alias("scraped_at"), F.lit("2024-02-01").alias("tailored_at"), F.lit(V_.PERSON).alias("person"), ((i % 100) / 100.0).alias("score"))
    array = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    jdi = F.struct(F.lit("startup").alias("company_type"), F.lit("scale").alias("priority_frame"), F.when(i % 3 == 0, array("a", "b")).otherwise(array()).alias("required_skills"), array("c").alias("preferred_skills"))
    rewrites = F.concat(F.array(F.struct(F.lit("high").alias("confidence"))), F.when(i % 2 == 1, F.array(F.struct(F.lit("sure").alias("confidence")))).otherwise(F.array().cast("array<struct<confidence:string>>")))
    plan = F.struct(F.when(i % 5 != 0, jdi).alias("jd_intelligence"), array("legacy").alias("jd_requirements"), F.when(i % 4 == 0, F.struct(array("lead").alias("lead_with"))).alias("skills_reordered"), array("old").alias("skills_to_emphasize"), F.lit("40%").alias("interview_callback_estimate"), F.array(F.struct(rewrites.alias("rewrites"))).alias("experience"))
    cov = k.select("key", (i % 50).cast("int").alias("ats_score"), array("the", "and").alias("matched_keywords"), array("zzz").alias("missing_keywords"), array("the", "and", "zzz").alias("jd_keywords"))
    rub = k.filter("doc_id % 2 = 0").select("key", F.to_json(F.struct((i % 70).alias("jd_match"), F.lit(50).alias("clarity"))).alias("recruiter"))
    out = K.match_report(jobs_, k.select("key", F.to_json(plan).alias("plan")), cov, rub, F.lit("builder"))
    text = lambda f: F.array_join(f.name, "|") if f.dataType.typeName() == "array" else F.to_json(f.name) if f.dataType.typeName() == "struct" else F.col(f.name)
    return out.select(*(text(f).alias(f.name) for f in out.schema))


@query(f"WITH {V_.POST} SELECT source_id, CASE WHEN doc_id % 3 = 0 THEN 0.0 ELSE (doc_id % 100) / 100.0 END::DOUBLE AS score, doc_id % 3 = 0 OR doc_id % 2 = 0 AS visa_ok, CASE WHEN doc_id % 3 = 0 THEN 'parse failure' ELSE 'fine' END AS reasoning, 'first' AS recommended_variant FROM v_post")
def i10_match_default(spark, sf):
    i = F.col("doc_id")
    good = F.concat(F.lit("```json\n"), F.to_json(F.struct(((i % 100) / 100.0).alias("score"), (i % 2 == 0).alias("visa_ok"), F.lit("fine").alias("reasoning"))), F.lit("\n```"))
    df = V_.post(spark, sf).select("source_id", F.when(i % 3 == 0, "sorry, no").otherwise(good).alias("answer"))
    return K.match_or_default(df, "answer", F.lit("first")).select("source_id", "score", "visa_ok", "reasoning", "recommended_variant")


def _rewrites(spark, sf):
    n = V_.bullets(spark, sf, "assistant")
    at = F.when(F.col("doc") % 3 == 0, " at Acme.").when(F.col("doc") % 3 == 1, " at Globex").otherwise("")
    return n.select("doc", "role_index", "bullet_index", F.concat(F.lit("Worked"), at).alias("rewritten"))


@query(f"""WITH {_BOTH}, s AS (SELECT doc, role_index, count(*) AS n FROM v_base GROUP BY doc, role_index), r AS (SELECT v.doc, v.role_index, v.bullet_index, n FROM v_new v LEFT JOIN s USING (doc, role_index))
SELECT doc, bullet_index, NULL::VARCHAR AS employer, CASE WHEN n IS NULL THEN 'role out of range' ELSE 'bullet out of range' END AS warning FROM r WHERE n IS NULL OR bullet_index < 1 OR bullet_index > n UNION ALL SELECT doc, bullet_index, 'Globex', 'employer not in history' FROM v_new WHERE doc % 3 = 1""")
def i11_grounding(spark, sf):
    b = V_.bullets(spark, sf, "user")
    employers = b.select("doc", F.lit("Acme Corp").alias("employer")).distinct()
    return K.grounding_warnings(_rewrites(spark, sf), b, employers).select("doc", "bullet_index", "employer", "warning")


@query(f"""WITH {_BOTH}, s AS (SELECT doc, role_index, count(*) AS n FROM v_base GROUP BY doc, role_index), r AS (SELECT v.doc, v.role_index, v.bullet_index, n FROM v_new v LEFT JOIN s USING (doc, role_index))
SELECT doc, bullet_index, CASE WHEN n IS NULL THEN 'role out of range' ELSE 'bullet out of range' END AS warning FROM r WHERE n IS NULL OR bullet_index < 1 OR bullet_index > n""")
def i12_picks(spark, sf):
    picks = V_.bullets(spark, sf, "assistant").select("doc", "role_index", "bullet_index")
    return K.pick_warnings(V_.bullets(spark, sf, "user"), picks).select("doc", "bullet_index", "warning")


@query(f"""WITH {_BOTH}, r AS (SELECT n.doc, n.role_index, n.bullet_index, b.bullet FROM v_new n LEFT JOIN v_base b USING (doc, role_index, bullet_index)) SELECT doc, bullet_index, bullet, CASE WHEN bullet IS NULL THEN 'role ' || role_index || ' has no bullet ' || bullet_index END AS warning FROM r""")
def c11_resolve_bullets(spark, sf):
    return K.resolve_bullets(V_.bullets(spark, sf, "user"), V_.bullets(spark, sf, "assistant").drop("bullet")).select("doc", "bullet_index", "bullet", "warning")


_KEY = "trim(regexp_replace(lower(trim({0})), '\\s+', ' ', 'g'))"


@query(f"""WITH {_BOTH}, t AS (SELECT doc, {_KEY.format("string_agg(bullet, ' ' ORDER BY bullet_index)")} AS text FROM v_base GROUP BY doc), i AS (SELECT doc, bullet_index, left({_KEY.format("CASE WHEN doc % 2 = 0 THEN bullet ELSE 'invented ' || bullet END")}, 60) AS probe FROM v_base)
SELECT doc, bullet_index, probe FROM i JOIN t USING (doc) WHERE NOT contains(text, probe)""")
def i13_source_grounding(spark, sf):
    b = V_.bullets(spark, sf, "user")
    texts = b.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bullet_index", "bullet"))), lambda x: x["bullet"]), " ").alias("text"))
    items = b.select("doc", "bullet_index", F.when(F.col("doc") % 2 == 0, F.concat(F.lit("- "), F.col("bullet"))).otherwise(F.concat(F.lit("invented "), F.col("bullet"))).alias("item"))
    return K.source_grounding(items, texts).select("doc", "bullet_index", "probe")


@query(f"""WITH {_BOTH}, t AS (SELECT doc, lower(string_agg(bullet, ' ' ORDER BY bullet_index)) AS text FROM v_base GROUP BY doc), i AS (SELECT doc, bullet_index, unnest(regexp_extract_all(CASE WHEN bullet_index % 2 = 0 THEN translate(bullet, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE bullet || 'zq' END, '[A-Za-z]+')) AS skill FROM v_base)
SELECT DISTINCT doc, bullet_index, skill FROM i JOIN t USING (doc) WHERE NOT contains(text, lower(skill))""")
def i13_skill_grounding(spark, sf):
    b = V_.bullets(spark, sf, "user")
    texts = b.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bullet_index", "bullet"))), lambda x: x["bullet"]), " ").alias("text"))
    said = F.when(F.col("bullet_index") % 2 == 0, F.translate("bullet", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(F.concat(F.col("bullet"), F.lit("zq")))
    skills = b.select("doc", "bullet_index", F.explode(F.array_distinct(F.regexp_extract_all(said, F.lit("[A-Za-z]+"), F.lit(0)))).alias("skill"))
    return K.skill_grounding(skills, texts).select("doc", "bullet_index", "skill")


@query(f"""WITH {_BOTH}, o AS (SELECT doc, list(k ORDER BY i, k) AS a FROM (SELECT doc, {_KEY.format('bullet')} AS k, min(bullet_index) AS i FROM v_base GROUP BY ALL) GROUP BY doc), n AS (SELECT doc, list(k ORDER BY i, k) AS b FROM (SELECT doc, {_KEY.format('bullet')} AS k, min(bullet_index) AS i FROM (SELECT * FROM v_new UNION ALL SELECT * FROM v_base WHERE doc % 2 = 0) GROUP BY ALL) GROUP BY doc),
j AS (SELECT coalesce(o.doc, n.doc) AS doc, coalesce(a, []) AS a, coalesce(b, []) AS b FROM o FULL JOIN n ON o.doc = n.doc), d AS (SELECT doc, CAST(len(list_filter(a, lambda x: NOT list_contains(b, x))) AS INTEGER) AS dropped, CAST(len(list_filter(a, lambda x: list_contains(b, x))) AS INTEGER) AS kept,
CAST(len(list_filter(b, lambda x: NOT list_contains(a, x))) AS INTEGER) AS added, list_filter(a, lambda x: list_contains(b, x)) <> list_filter(b, lambda x: list_contains(a, x)) AS reordered FROM j) SELECT *, dropped + added + CAST(reordered AS INTEGER) AS changes FROM d""")
def g03_bullet_diff(spark, sf):
    base = V_.bullets(spark, sf, "user")
    new = V_.bullets(spark, sf, "assistant").unionByName(base.filter("doc % 2 = 0"))
    return K.bullet_diff(base, new).select("doc", "dropped", "kept", "added", "reordered", "changes")


@query(f"WITH {V_.bullets_sql('v_new', 'assistant')} SELECT doc, count(*) FILTER (bullet_index % 4 = 0) AS high, count(*) FILTER (bullet_index % 4 = 1) AS medium, count(*) FILTER (bullet_index % 4 = 2) AS low, count(*) FILTER (bullet_index % 4 = 3) AS unknown FROM v_new GROUP BY doc")
def d09_confidence(spark, sf):
    n = V_.bullets(spark, sf, "assistant")
    level = V_._pick(["high", "MEDIUM", "Low", "sure"], F.col("bullet_index"))
    plans = n.groupBy("doc", "role_index").agg(F.collect_list(F.struct(level.alias("confidence"))).alias("rewrites")).groupBy("doc").agg(F.collect_list(F.struct("rewrites")).alias("experience"))
    return K.confidence_breakdown(plans)


@query(f"WITH {V_.bullets_sql('v_base', 'user')} SELECT doc, bullet_index, CASE WHEN doc % 3 = 0 THEN 'Lead Engineer' WHEN doc % 3 = 1 THEN 'engineer' END AS new_role FROM v_base")
def c10_match_roles(spark, sf):
    b = V_.bullets(spark, sf, "user").select("doc", F.col("bullet_index").alias("place"), F.lit("Engineer").alias("role"))
    docs = b.select("doc").distinct()
    new = docs.filter("doc % 3 < 2").select("doc", F.when(F.col("doc") % 3 == 1, "engineer").otherwise("Lead Engineer").alias("role"), F.lit(2).alias("place"))
    new = new.unionByName(docs.select("doc", F.lit("Chef").alias("role"), F.lit(1).alias("place")))
    return J.match_roles(b, new).select("doc", F.col("place").alias("bullet_index"), "new_role")


@query("SELECT c_custkey AS person_id, lower(CASE WHEN c_custkey % 2 = 0 THEN 'File|' || c_mktsegment ELSE c_mktsegment || '|' || c_name END) AS skills, lower(c_mktsegment) AS seniority_level, false AS skip_niche FROM customer")
def a17_load_profiles(spark, sf):
    c = V_.table(spark, sf, "customer")
    raw = c.select(
        F.col("c_custkey").alias("person_id"), F.array("c_mktsegment", "c_name").alias("core_skills"), F.lit(None).cast("array<string>").alias("red_flags"),
        F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("File"), F.col("c_mktsegment"))).alias("skills_file"), F.col("c_mktsegment").alias("seniority_level"), F.lit(None).cast("boolean").alias("skip_niche"),
    )
    return S.load_profiles(raw).select("person_id", F.array_join("core_skills", "|").alias("skills"), "seniority_level", "skip_niche")


# ---- tracking ------------------------------------------------------------------------------------------------------


@query(f"WITH {V_.KEYED}{_SEEN}, n AS (SELECT key, 'new ' || title AS title, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'NEW' END AS status, doc_id FROM v_keyed WHERE doc_id % 10 < 3) SELECT key, title, status FROM v_seen WHERE key NOT IN (SELECT key FROM n) UNION ALL SELECT key, title, status FROM n")
def j07_upsert(spark, sf):
    new = V_.keyed(spark, sf).filter("doc_id % 10 < 3").select("key", F.concat(F.lit("new "), F.col("title")).alias("title"), F.when(F.col("doc_id") % 3 != 0, "NEW").alias("status"))
    return TR.upsert(_seen(spark, sf).select("key", "title", "status"), new, "key")


@query(f"WITH {V_.KEYED}{_SEEN} SELECT key, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'changed' ELSE title END AS title, CASE WHEN doc_id % 3 = 0 THEN 'DONE' ELSE status END AS status FROM v_seen")
def j09_artifacts(spark, sf):
    s = _seen(spark, sf)
    changes = s.filter("doc_id % 3 = 0").select("key", F.when(F.col("doc_id") % 2 == 0, "changed").alias("title"), F.lit("DONE").alias("status"))
    return TR.update_columns(s, changes, ("title", "status")).select("key", "title", "status")


@query(f"WITH {V_.KEYED}{_SEEN} SELECT key, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE notified END AS notified FROM v_seen")
def j10_mark_notified(spark, sf):
    s = _seen(spark, sf)
    return TR.mark_notified(s, s.filter("doc_id % 4 = 0").select("key")).select("key", "notified")


@query(f"WITH {V_.KEYED}{_SEEN} SELECT key, CASE WHEN doc_id % 4 = 0 THEN 'OFFER' ELSE status END AS status FROM v_seen")
def j06_status(spark, sf):
    s = _seen(spark, sf)
    sid = F.substring("key", 1, 16)
    call = lambda a, day: s.filter("doc_id % 4 = 0").select(F.concat(F.lit(a + ":"), sid).alias("data"), F.lit(day).cast("timestamp").alias("ts"))
    calls = call("applied", "2024-02-01").unionByName(call("offer", "2024-02-03")).unionByName(call("skip", "2024-02-02")).unionByName(call("dance", "2024-02-09"))
    state = TR.apply_status(s.withColumn("status_updated_at", F.lit(None).cast("timestamp")), TR.parse_callbacks(calls))
    return state.select("key", "status")


# ---- streams over the events table ---------------------------------------------------------------------------------


def _events(spark, sf) -> DataFrame:
    schema = V_.table(spark, sf, "events").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return e.select("event_id", F.col("user_id").cast("string").alias("company"), F.col("event_type").alias("title"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("ok"), F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(f"WITH {V_.OBS} SELECT sha256(lower(company) || '|' || title) AS key, min(event_id) FILTER (ts = m) AS event_id FROM (SELECT *, min(ts) OVER (PARTITION BY company, title) AS m FROM v_obs) GROUP BY company, title")
def j02_dedup(spark, sf):
    from ..functions.identity import posting_key

    out = jobs.shared_dir(spark, "dedup")
    e = _events(spark, sf).withColumns({"key": posting_key(F.col("company"), F.col("title")), "scraped_at": F.col("ts"), "source_id": F.lpad(F.col("event_id").cast("string"), 20, "0")})
    jobs.start(e, jobs.dedup_batch(f"{out}/seen", f"{out}/new"), f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/new").select("key", "event_id")


@query(f"WITH {V_.OBS} SELECT DISTINCT company, title FROM v_obs")
def j03_ttl_dedup(spark, sf):
    return jobs.drain(jobs.ttl_dedup(_events(spark, sf), ["company", "title"]).select("company", "title"), "ttl").select("company", "title")


@query(f"WITH {V_.OBS} SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS minute, count(*) FILTER (title = 'view') AS new, count(*) FILTER (title = 'error') AS dropped, count(*) FILTER (title NOT IN ('view', 'error')) AS sent FROM v_obs GROUP BY 1")
def j04_minute_counts(spark, sf):
    outcome = F.when(F.col("title") == "view", "new").when(F.col("title") == "error", "dropped").otherwise("sent")
    rows = jobs.drain(jobs.minute_counts(_events(spark, sf).withColumn("outcome", outcome)), "minutes", "update")
    last = rows.groupBy("minute").agg(F.max_by(F.struct("new", "dropped", "sent"), "batch").alias("r"))
    return last.select(F.date_format("minute", "yyyy-MM-dd HH:mm").alias("minute"), "r.*")


_ACTIONS = {"view": "applied", "click": "interview", "purchase": "offer", "signup": "dance"}  # an unknown action; errors have a bad id
_CALLED = f"""c AS (SELECT company, CASE title WHEN 'view' THEN 'APPLIED' WHEN 'click' THEN 'INTERVIEW' ELSE 'OFFER' END AS status FROM v_obs WHERE title IN ('view', 'click', 'purchase')
QUALIFY row_number() OVER (PARTITION BY company ORDER BY ts DESC, 2 DESC) = 1)"""


@query(f"WITH {V_.OBS}, {_CALLED}, s AS (SELECT DISTINCT company FROM v_obs) SELECT company, sha256(company || '|x') AS key, coalesce(status, 'NEW') AS status FROM s LEFT JOIN c USING (company)")
def j06_status_stream(spark, sf):
    """Callbacks as a stream over a keyed table of postings."""
    from ..functions.identity import posting_key, short_id

    path = jobs.shared_dir(spark, "status")
    seen = V_.obs(spark, sf).select("company", posting_key(F.col("company"), F.lit("x")).alias("key"), F.lit("NEW").alias("status"), F.lit(None).cast("timestamp").alias("status_updated_at")).distinct()
    jobs.keyed_table(seen, f"{path}/seen")
    action = F.element_at(F.create_map(*(F.lit(x) for kv in _ACTIONS.items() for x in kv)), F.col("title"))
    sid = short_id(posting_key(F.col("company"), F.lit("x")))
    calls = _events(spark, sf).select(F.coalesce(F.concat(action, F.lit(":"), sid), F.lit("applied:short")).alias("data"), "ts")
    jobs.start(calls, jobs.status_batch(f"{path}/seen", seen.schema), f"{path}/checkpoint").awaitTermination()
    return jobs.read_keyed(spark, f"{path}/seen", seen.schema).select("company", "key", "status")


@query(f"""WITH {V_.OBS}, n AS (SELECT sha256(company || '|x') AS key, company, title AS note, k FROM v_obs QUALIFY row_number() OVER (PARTITION BY company ORDER BY ts DESC, event_id DESC) = 1)
SELECT key, company, note, k FROM n UNION ALL SELECT sha256('old' || (user_id % 50) || '|x'), 'old' || (user_id % 50), 'kept', NULL FROM events GROUP BY user_id % 50""")
def j07_upsert_stream(spark, sf):
    """Rows upserted from a stream: the last one of a key replaces the old row, other rows stay."""
    from ..functions.identity import posting_key

    path, key = jobs.shared_dir(spark, "upsert"), posting_key(F.col("company"), F.lit("x")).alias("key")
    old = V_.obs(spark, sf).select("company").distinct().unionByName(V_.obs(spark, sf).select(F.concat(F.lit("old"), (F.col("company").cast("long") % 50).cast("string")).alias("company")).distinct())
    old = old.select(key, "company", F.lit("kept").alias("note"), F.lit(None).cast("long").alias("k"))
    jobs.keyed_table(old, f"{path}/rows")
    new = _events(spark, sf).select(key, "company", F.col("title").alias("note"), "k", F.struct("ts", "event_id").alias("at"))
    jobs.start(new, jobs.upsert_batch(f"{path}/rows", old.schema, "key", "at"), f"{path}/checkpoint").awaitTermination()
    return jobs.read_keyed(spark, f"{path}/rows", old.schema)


@query(f"""WITH {V_.OBS}, i AS (SELECT *, sum(CAST(ok AS INTEGER)) OVER (PARTITION BY company ORDER BY ts, event_id) AS island FROM v_obs), s AS (SELECT *, sum(CAST(NOT ok AS INTEGER)) OVER (PARTITION BY company, island ORDER BY ts, event_id) AS streak FROM i),
l AS (SELECT company, streak, ts FROM s QUALIFY row_number() OVER (PARTITION BY company ORDER BY ts DESC, event_id DESC) = 1)
SELECT company, CAST(streak AS BIGINT) AS streak, CASE WHEN streak < 3 THEN 'closed' WHEN epoch_ms(ts) + 30000 < (SELECT epoch_ms(max(ts)) FROM v_obs) THEN 'half_open' ELSE 'open' END AS state FROM l""")
def j08_health(spark, sf):
    """All outcomes as a stream, then the timers that are due by the last watermark."""
    with jobs.rocksdb(spark):
        rows = jobs.drain(jobs.fetch_health(_events(spark, sf).select("company", "ts", "event_id", "ok")), "health")
    return rows.groupBy("company").agg(F.max_by(F.struct("streak", "state"), "batch").alias("r")).select("company", "r.*")
