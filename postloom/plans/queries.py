"""Registered queries: each operator on a binding, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions import embed as EM
from ..functions import text as T
from ..functions import time as TM
from ..functions import url as U
from ..functions.identity import posting_key, short_id
from ..operators import aggregates as A
from ..operators import catalog as C
from ..operators import filters as B
from ..operators import joins as J
from ..operators import render as R
from ..operators import scoring as S
from . import bindings as V_
from .bindings import AS_OF, WORDS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _list(items: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


def _any(text: str, items: list[str]) -> str:
    return f"len(list_filter({_list(items)}, lambda x: contains({text}, x))) > 0"


INCLUDE, EXCLUDE = ["tion", "Und", "les"], ["!!", "idiot"]

# ---- filters -------------------------------------------------------------------------------------------------------


@query(f"WITH {V_.POST} SELECT source_id, title FROM v_post WHERE NOT {_any('lower(title)', ['!!', 'idiot'])} AND {_any('lower(title)', ['tion', 'und', 'les'])}")
def b01_keyword_title(spark, sf):
    return B.keyword_filter(V_.post(spark, sf), INCLUDE, EXCLUDE).select("source_id", "title")


_TD = "lower(title || ' ' || description_text)"


@query(f"WITH {V_.POST} SELECT source_id FROM v_post WHERE NOT {_any(_TD, ['!!', 'idiot'])} AND {_any(_TD, ['tion', 'und', 'les'])}")
def b02_keyword_title_desc(spark, sf):
    return B.keyword_filter(V_.post(spark, sf), INCLUDE, EXCLUDE, "title_desc").select("source_id")


@query(f"WITH {V_.POST} SELECT source_id FROM v_post WHERE NOT {_any('lower(title || chr(10) || description_text)', ['idiot'])} AND {_any('lower(title || chr(10) || description_text)', ['license'])}")
def b03_keyword_trim(spark, sf):
    df = V_.post(spark, sf).withColumn("inc", F.array(F.lit("  License "), F.lit(" ")))
    return B.keyword_filter(df, "inc", [" idiot ", " "], "title_desc_trim").select("source_id")


@query(f"WITH {V_.POST} SELECT source_id, {_any('lower(description_text)', ['token = ', 'idiot', 'license'])} AS flag FROM v_post")
def b04_phrase_flags(spark, sf):
    return B.flag_phrases(V_.post(spark, sf), ["token = ", "idiot", "license"], out="flag").select("source_id", "flag")


_NOTE = "description_text || CASE doc_id % 4 WHEN 0 THEN ' Visa  Sponsorship' WHEN 1 THEN ' we do not sponsor' WHEN 2 THEN ' H1B sponsorship available' ELSE '' END"


def _noted(spark, sf):
    i = F.col("doc_id") % 4
    extra = F.when(i == 0, " Visa  Sponsorship").when(i == 1, " we do not sponsor").when(i == 2, " H1B sponsorship available").otherwise("")
    return V_.post(spark, sf).withColumn("description_text", F.concat("description_text", extra))


@query(f"WITH {V_.POST}, n AS (SELECT source_id, {_NOTE} AS t FROM v_post) SELECT source_id, regexp_matches(t, '{B.SPONSOR}') AS mentions_sponsorship, regexp_matches(t, '{B.NO_SPONSOR}') AS no_sponsorship_phrase FROM n")
def b05_sponsorship(spark, sf):
    return B.sponsorship_flags(_noted(spark, sf)).select("source_id", "mentions_sponsorship", "no_sponsorship_phrase")


@query(f"WITH {V_.POST} SELECT source_id, remote OR {_any('''lower(location || ' ' || description_text)''', vocab.REMOTE_WORDS)} AS remote FROM v_post")
def b06_remote(spark, sf):
    return B.detect_remote(V_.post(spark, sf)).select("source_id", "remote")


_URL_SQL = "regexp_replace(url, '#.*$', '')"
_CANON = f"""(regexp_replace({_URL_SQL}, '\\?.*$', '') || CASE WHEN len(q) = 0 THEN '' ELSE '?' || array_to_string(q, '&') END)"""
_Q = f"list_filter(string_split(CASE WHEN contains({_URL_SQL}, '?') THEN regexp_replace({_URL_SQL}, '^[^?]*\\?', '') ELSE '' END, '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_|gh_jid=|gclid=|fbclid=)'))"


@query(f"""WITH p AS (SELECT page_id, url, CASE WHEN page_id % 5 = 0 THEN '  ' ELSE 'Role ' || page_id END AS title, {_Q} AS q FROM pages)
SELECT page_id, trim(title) AS title, {_CANON} AS url, substr(sha1({_CANON}), 1, 16) AS source_id FROM p WHERE trim(title) <> ''""")
def b07_valid_rows(spark, sf):
    p = V_.table(spark, sf, "pages")
    title = F.when(F.col("page_id") % 5 == 0, "  ").otherwise(F.concat(F.lit("Role "), F.col("page_id").cast("string")))
    blank = F.lit(None).cast("string")
    df = p.select("page_id", "url", title.alias("title"), blank.alias("description_text"), blank.alias("location"), blank.alias("department"), F.lit(False).alias("remote"), F.lit("https://x.example.com/").alias("base_url"))
    return B.normalize_extracted(df).select("page_id", "title", "url", "source_id")


_ANCHORS = "len(regexp_extract_all(html, '(?i)<a[\\s>]'))"


@query(f"""SELECT page_id, (regexp_matches(html, '{B.NOSCRIPT}') OR ({_ANCHORS} < 8 AND regexp_matches(html, '{B.SPA}'))) AS needs_js FROM pages""")
def b08_needs_js(spark, sf):
    return V_.table(spark, sf, "pages").select("page_id", B.needs_js(F.col("html")).alias("needs_js"))


@query(f"""WITH r AS (SELECT page_id, unnest(range(CAST(page_id % 40 AS BIGINT))) AS i FROM pages), c AS (SELECT page_id, greatest(3 * {_ANCHORS}, 10) AS cap FROM pages)
SELECT page_id, count(*) AS n FROM r JOIN c USING (page_id) GROUP BY page_id, cap HAVING count(*) <= cap""")
def b09_sanity_cap(spark, sf):
    p = V_.table(spark, sf, "pages")
    rows = p.filter("page_id % 40 > 0").select("page_id", F.explode(F.sequence(F.lit(1), (F.col("page_id") % 40).cast("int"))).alias("i"))
    return B.sanity_cap(rows, p, least=10).groupBy("page_id").agg(F.count("*").alias("n"))


@query(f"WITH {V_.COMPANY} SELECT name, tier FROM v_company WHERE tier <= 2")
def b10_by_tier(spark, sf):
    return B.by_tier(V_.company(spark, sf), 2).select("name", "tier")


@query(f"WITH {V_.POST} SELECT source_id FROM v_post WHERE source_id <> '' AND doc_id % 7 <> 0")
def b13_valid_identity(spark, sf):
    df = V_.post(spark, sf).withColumn("source_id", F.when(F.col("doc_id") % 14 == 0, None).when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("source_id")))
    return B.valid_identity(df).select("source_id")


@query(f"WITH {V_.APP} SELECT id, person_id, status, created_at FROM v_app WHERE person_id = 'p3' AND status = 'offer' ORDER BY created_at DESC, id LIMIT 100")
def b14_list_apps(spark, sf):
    return B.list_applications(V_.app(spark, sf), "p3", "offer").select("id", "person_id", "status", "created_at")


_ROLES = ["tion", "cloud", "und "]


@query(f"WITH {V_.POST} SELECT source_id FROM v_post WHERE {_any('''lower(title || ' ' || department)''', _ROLES)}")
def b15_role_class(spark, sf):
    return V_.post(spark, sf).filter(B.role_class(_ROLES)).select("source_id")


@query(f"WITH {V_.POST} SELECT source_id FROM v_post WHERE contains(lower(title || ' ' || description_text || ' ' || department), 'license') AND contains(lower(company), 'src1')")
def b16_text_filter(spark, sf):
    return B.company_filter(B.text_filter(V_.post(spark, sf), "License"), "SRC1").select("source_id")


@query(f"WITH {V_.COMPANY} SELECT name, career_url FROM v_company WHERE ats = 'custom' AND custom_module <> 'apple' AND coalesce(career_url, '') <> ''")
def b17_html_tasks(spark, sf):
    return B.html_tasks(V_.company(spark, sf), vocab.KNOWN_MODULES).select("name", "career_url")


@query(f"WITH {V_.COMPANY} SELECT name, coalesce(nullif(career_url, ''), 'https://' || domain || '/careers') AS url FROM v_company")
def b18_career_url(spark, sf):
    return V_.company(spark, sf).select("name", B.career_url({"nobody": "https://nobody.example.com"}).alias("url"))


_TEMPLATED = ", ".join(f"replace('{t}', '{{d}}', d)" for t in B.TEMPLATES)


@query(f"""WITH {V_.COMPANY}, c AS (SELECT name, regexp_replace(lower(trim(domain)), '^www\\.', '') AS d, domain, coalesce(trim(career_url), '') AS s FROM v_company),
l AS (SELECT name, (CASE WHEN s <> '' AND s <> 'https://' || d || '/careers' AND s <> 'https://' || domain || '/careers' THEN [s] ELSE [] END) || [{_TEMPLATED}] AS u, s FROM c),
x AS (SELECT name, unnest(range(len(u))) AS i, u FROM l), y AS (SELECT name, i, u[i + 1] AS url, u FROM x)
SELECT name, CAST(row_number() OVER (PARTITION BY name ORDER BY i) - 1 AS INTEGER) AS rank, url FROM y WHERE list_position(u, url) = i + 1""")
def b19_candidate_urls(spark, sf):
    return B.candidate_urls(V_.company(spark, sf))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL ELSE regexp_replace(url, '[?#].*$', '') || '?' || CASE WHEN regexp_matches(url, '[?&]page=') THEN
regexp_replace(regexp_replace(regexp_extract(url, '\\?([^#]*)', 1), '(^|&)page=[0-9]*', '\\1page=' || (CAST(coalesce(nullif(regexp_extract(url, '[?&]page=([0-9]*)', 1), ''), '1') AS INTEGER) + 1)), '^&', '')
ELSE regexp_extract(url, '\\?([^#]*)', 1) || CASE WHEN regexp_extract(url, '\\?([^#]*)', 1) = '' THEN '' ELSE '&' END || 'page=2' END END AS next_url FROM pages""")
def b20_next_page(spark, sf):
    strategy = F.when(F.col("page_id") % 3 == 0, "none").otherwise("page-param")
    return V_.table(spark, sf, "pages").select("page_id", U.next_page(F.col("url"), strategy, F.lit("page"), F.lit(1)).alias("next_url"))


@query(f"""WITH {V_.COMPANY} SELECT name, CASE ats WHEN 'greenhouse' THEN 'api.greenhouse.io' WHEN 'lever' THEN 'api.lever.co' WHEN 'ashby' THEN 'api.ashbyhq.com' WHEN 'smartrecruiters' THEN 'api.smartrecruiters.com'
ELSE domain END AS rate_domain FROM v_company""")
def b21_rate_domain(spark, sf):
    return V_.company(spark, sf).select("name", B.rate_domain().alias("rate_domain"))


@query(f"WITH {V_.POST} SELECT source_id, title, CAST(NULL AS VARCHAR) AS description_html, 0.5::DOUBLE AS score FROM v_post")
def b22_conform(spark, sf):
    from pyspark.sql.types import StructType

    return B.conform(V_.post(spark, sf), StructType.fromDDL("source_id string, title string, description_html string, score double"), {"score": 0.5})


@query(f"WITH {V_.POST} SELECT source_id, title, (doc_id % 100) / 100.0::DOUBLE AS score FROM v_post")
def b23_flatten(spark, sf):
    env = V_.post(spark, sf).select(F.struct("source_id", "title").alias("job"), ((F.col("doc_id") % 100) / 100.0).alias("score"))
    return B.flatten_scored(env)


_MSG = ["HTTP 404 not found", "HTTP 503 for board", "read: connection reset", "board_id required", "odd thing", "unexpected EOF"]


@query(f"WITH {V_.OBS}, m AS (SELECT event_id, {_list(_MSG)}[event_id % 6 + 1] AS msg FROM v_obs) SELECT event_id, CASE WHEN {_any('msg', B.PERMANENT)} THEN 'permanent' WHEN {_any('msg', B.TRANSIENT)} THEN 'transient' ELSE 'other' END AS kind FROM m")
def b24_error_class(spark, sf):
    return V_.obs(spark, sf).select("event_id", B.classify_error(V_._pick(_MSG, F.col("event_id"))).alias("kind"))


# ---- text, url, identity -------------------------------------------------------------------------------------------


@query("SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*(>|$)', ' ', 'g'), '>', '', 'g'), '\\s+', ' ', 'g')) AS text FROM pages")
def h04_strip_html(spark, sf):
    return V_.table(spark, sf, "pages").select("page_id", T.strip_html(F.col("html")).alias("text"))


@query("""SELECT page_id, left(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\\b[^>]*>.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '\\s+', ' ', 'g'), 60000) AS text FROM pages""")
def h06_trim_html(spark, sf):
    return V_.table(spark, sf, "pages").select("page_id", T.trim_html(F.col("html")).alias("text"))


@query(f"SELECT page_id, CAST({_ANCHORS} AS INTEGER) AS anchors FROM pages")
def h07_anchor_count(spark, sf):
    return V_.table(spark, sf, "pages").select("page_id", T.anchor_count(F.col("html")).alias("anchors"))


@query(f"WITH p AS (SELECT page_id, url, {_Q} AS q FROM pages) SELECT page_id, {_CANON} AS url, substr(sha1({_CANON}), 1, 16) AS source_id FROM p")
def h08_canonical_url(spark, sf):
    url = U.canonical(F.col("url"), F.lit("https://x.example.com/"))
    return V_.table(spark, sf, "pages").select("page_id", url.alias("url")).withColumn("source_id", U.stable_id(F.col("url")))


@query(f"WITH {V_.KEYED} SELECT source_id, key, substr(key, 1, 16) AS short_id FROM v_keyed")
def h10_identity_key(spark, sf):
    return V_.post(spark, sf).select("source_id", posting_key(F.col("company"), F.col("source_id")).alias("key")).withColumn("short_id", short_id(F.col("key")))


@query(f"WITH {V_.COMPANY} SELECT name, regexp_replace(lower(trim(domain)), '^www\\.', '') AS domain FROM v_company")
def h25_domain(spark, sf):
    return V_.company(spark, sf).select("name", U.plain_domain(F.col("domain")).alias("domain"))


@query(f"WITH {V_.POST} SELECT source_id, CASE WHEN doc_id % 5 = 0 THEN 'unknown' WHEN doc_id % 5 = 1 THEN 'soon' ELSE strftime(posted_at, '%Y-%m-%d %H:%M') || ' UTC' END AS shown FROM v_post")
def h03_shown_time(spark, sf):
    raw = F.when(F.col("doc_id") % 5 == 0, "").when(F.col("doc_id") % 5 == 1, "soon").otherwise(F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return V_.post(spark, sf).select("source_id", TM.shown(raw).alias("shown"))


@query(f"WITH {V_.POST} SELECT source_id, date_diff('second', posted_at, TIMESTAMP '{AS_OF}') / 86400.0::DOUBLE AS age, strftime(posted_at, '%Y-%m-%d') AS named FROM v_post")
def h01_dates(spark, sf):
    df = V_.post(spark, sf)
    iso = TM.parse_iso(F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    named = TM.parse_named(F.date_format("posted_at", "MMMM d, yyyy"))
    return df.select("source_id", TM.age_days(iso, F.lit(AS_OF).cast("timestamp")).alias("age"), F.date_format(named, "yyyy-MM-dd").alias("named"))


@query(f"WITH {V_.POST} SELECT source_id, regexp_replace(title, '[*_\\[\\]()]', '', 'g') AS plain, left(regexp_replace(title, '[^\\pL\\pN_\\-]', '-', 'g'), 40) AS slug, trim(regexp_replace(lower(trim(title)), '\\s+', ' ', 'g')) AS bullet FROM v_post")
def h16_text_forms(spark, sf):
    df = V_.post(spark, sf)
    return df.select("source_id", T.strip_markdown(F.col("title")).alias("plain"), T.slug(F.col("title")).alias("slug"), T.bullet_key(F.col("title")).alias("bullet"))


_SENTENCES = "string_split(regexp_replace(description_text, '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), chr(1))"


@query(f"""WITH {V_.POST} SELECT source_id, trim(regexp_replace(array_to_string(list_filter({_SENTENCES}, lambda x: NOT regexp_matches(lower(x), '(^|[^\\pL\\pN_])(license|the)($|[^\\pL\\pN_])')), ' '), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS text FROM v_post""")
def h21_scrub(spark, sf):
    return V_.post(spark, sf).select("source_id", T.scrub_sentences(F.col("description_text"), ["license", "the"]).alias("text"))


# ---- identity, joins -----------------------------------------------------------------------------------------------


def _twice(spark, sf):
    """Postings, a second sighting of each third one a day later."""
    p = V_.keyed(spark, sf)
    again = p.filter("doc_id % 3 = 0").withColumn("scraped_at", F.col("scraped_at") + F.expr("interval 1 day"))
    return p.unionByName(again)


_TWICE = V_.KEYED + ", v_twice AS (SELECT * FROM v_keyed UNION ALL SELECT * REPLACE (scraped_at + INTERVAL 1 DAY AS scraped_at) FROM v_keyed WHERE doc_id % 3 = 0)"
_SEEN = ", v_seen AS (SELECT key, company, title, url, scraped_at AS first_seen_at, (doc_id % 100) / 100.0::DOUBLE AS score, CAST(doc_id % 2 AS INTEGER) AS notified, 'NEW' AS status, doc_id FROM v_keyed WHERE doc_id % 5 = 0)"


def _seen(spark, sf):
    return V_.keyed(spark, sf).filter("doc_id % 5 = 0").select("key", "company", "title", "url", F.col("scraped_at").alias("first_seen_at"), ((F.col("doc_id") % 100) / 100.0).alias("score"), (F.col("doc_id") % 2).cast("int").alias("notified"), F.lit("NEW").alias("status"), "doc_id")


@query(f"WITH {_TWICE} SELECT key, source_id, strftime(min(scraped_at), '%Y-%m-%d') AS day FROM v_twice GROUP BY key, source_id")
def e02_first_per_key(spark, sf):
    return J.first_per_key(_twice(spark, sf)).select("key", "source_id", F.date_format("scraped_at", "yyyy-MM-dd").alias("day"))


@query(f"WITH {_TWICE}{_SEEN} SELECT key, min(source_id) AS source_id FROM v_twice WHERE key NOT IN (SELECT key FROM v_seen) GROUP BY key")
def c01_only_new(spark, sf):
    return J.only_new(_twice(spark, sf), _seen(spark, sf)).select("key", "source_id")


@query(f"WITH {V_.COMPANY}, o AS (SELECT name, 'https://o.example.com/' || suppkey AS career_url, CASE WHEN suppkey % 2 = 0 THEN 9 END AS tier FROM v_company WHERE suppkey % 3 = 0) SELECT c.name, coalesce(nullif(o.career_url, ''), c.career_url) AS career_url, coalesce(o.tier, c.tier) AS tier FROM v_company c LEFT JOIN o ON c.name = o.name")
def c02_overrides(spark, sf):
    c = V_.company(spark, sf)
    over = c.filter("suppkey % 3 = 0").select("name", F.concat(F.lit("https://o.example.com/"), F.col("suppkey").cast("string")).alias("career_url"), F.when(F.col("suppkey") % 2 == 0, 9).alias("tier"))
    return J.merge_overrides(c, over).select("name", "career_url", "tier")


@query(f"WITH {V_.POST}, {V_.PROFILE} SELECT source_id, person_id FROM v_post CROSS JOIN v_profile")
def c03_fan_out(spark, sf):
    return S.fan_out(V_.post(spark, sf), V_.profiles(spark)).select("source_id", "person_id")


def _detected(spark, sf):
    c, k = V_.company(spark, sf), F.col("suppkey")
    ats = F.when(k % 5 == 0, V_._pick(V_.VENDORS, k + 1)).when(k % 11 == 0, "undiscovered").otherwise(F.col("ats"))
    board = F.when(k % 7 == 0, F.concat("board_id", F.lit("x"))).when(k % 13 == 0, "").otherwise(F.upper("board_id"))
    return c.select("name", "domain", ats.alias("detected_ats"), board.alias("detected_board_id"), F.lit("high").alias("confidence"), F.when(k % 11 == 0, "timeout").when(k % 17 == 0, "").alias("error"))


_DETECTED = f""", v_detected AS (SELECT name, domain, CASE WHEN suppkey % 11 = 0 THEN 'timeout' WHEN suppkey % 17 = 0 THEN '' END AS error, CASE WHEN suppkey % 5 = 0 THEN {V_.VENDORS}[(suppkey + 1) % 7 + 1] WHEN suppkey % 11 = 0 THEN 'undiscovered' ELSE ats END AS detected_ats,
CASE WHEN suppkey % 7 = 0 THEN board_id || 'x' WHEN suppkey % 13 = 0 THEN '' ELSE upper(board_id) END AS detected_board_id FROM v_company),
v_drift AS (SELECT s.name, s.ats AS seed_ats, d.detected_ats, CASE WHEN s.ats <> d.detected_ats THEN 'ats_change' WHEN s.board_id <> '' AND d.detected_board_id <> '' AND lower(s.board_id) <> lower(d.detected_board_id) THEN 'board_id_change' END AS kind
FROM v_company s JOIN v_detected d ON s.name = d.name WHERE s.ats <> '' AND d.detected_ats NOT IN ('undiscovered', 'custom_html'))"""


@query(f"WITH {V_.COMPANY}{_DETECTED} SELECT name, seed_ats, detected_ats, kind FROM v_drift WHERE kind IS NOT NULL")
def c04_drift(spark, sf):
    return C.drift(V_.company(spark, sf), _detected(spark, sf)).select("name", "seed_ats", "detected_ats", "kind")


@query(f"WITH {V_.KEYED}{_SEEN} SELECT substr(key, 1, 16) AS short_id, key, title FROM v_seen WHERE doc_id % 10 = 0")
def c05_short_id(spark, sf):
    s = _seen(spark, sf)
    ids = s.filter("doc_id % 10 = 0").select(short_id(F.col("key")).alias("short_id"))
    ids = ids.unionByName(s.select(F.substring("key", 1, 15).alias("short_id")))
    return J.lookup_short(ids, s).select("short_id", "key", "title")


@query(f"WITH {V_.POST} SELECT source_id, list_filter({_list(WORDS.niche)}, lambda x: contains(lower(description_text), x))[1] AS first, CAST(len(list_filter({_list(WORDS.niche)}, lambda x: contains(lower(description_text), x))) AS INTEGER) AS n FROM v_post")
def c06_first_token(spark, sf):
    low = F.lower("description_text")
    return V_.post(spark, sf).select("source_id", T.first_token(low, WORDS.niche).alias("first"), T.count_tokens(low, WORDS.niche).alias("n"))


_POLICIES = [("example.com", 2.0), ("s1.example.com", 5.0), ("1.example.com", 3.0)]


@query(f"""WITH {V_.COMPANY}, p(policy, rate) AS (VALUES ('example.com', 2.0::DOUBLE), ('s1.example.com', 5.0), ('1.example.com', 3.0)), m AS (SELECT name, domain, policy, rate, row_number() OVER (PARTITION BY name ORDER BY len(policy) DESC) AS n FROM v_company JOIN p ON ends_with(domain, policy) WHERE suppkey % 2 = 1)
SELECT c.name, coalesce(m.policy, 'default') AS policy, coalesce(m.rate, 1.0::DOUBLE) AS rate FROM v_company c LEFT JOIN m ON c.name = m.name AND n = 1""")
def c07_suffix_policy(spark, sf):
    c = V_.company(spark, sf).withColumn("domain", F.when(F.col("suppkey") % 2 == 1, F.col("domain")).otherwise("else.net"))
    return J.match_policy(c, spark.createDataFrame(_POLICIES, "policy string, rate double"), "domain", {"rate": 1.0}, "name").select("name", "policy", "rate")


@query(f"WITH {V_.COMPANY} SELECT name, 'in' AS side FROM v_company WHERE ats IN ('lever', 'ashby') UNION ALL SELECT name, 'out' FROM v_company WHERE ats NOT IN ('lever', 'ashby')")
def c08_membership(spark, sf):
    c = V_.company(spark, sf)
    members = c.filter(F.col("ats").isin("lever", "ashby")).select("ats")
    return J.in_set(c, members, "ats").select("name", F.lit("in").alias("side")).unionByName(J.not_in_set(c, members, "ats").select("name", F.lit("out").alias("side")))


_ALIASES = [("supplier#000000001", "one", 1), ("01", "tail", 2), ("supplier#00000000", "few", 3), ("7", "seven", 4)]


@query(f"""WITH {V_.COMPANY}, a(alias, value, rank) AS (VALUES {", ".join(map(str, _ALIASES))}), m AS (SELECT name, value, row_number() OVER (PARTITION BY name ORDER BY lower(name) <> alias, rank) AS n FROM v_company JOIN a ON contains(lower(name), alias))
SELECT c.name, coalesce(m.value, 'default') AS value FROM v_company c LEFT JOIN m ON c.name = m.name AND n = 1""")
def c09_alias(spark, sf):
    return J.alias_lookup(V_.company(spark, sf), spark.createDataFrame(_ALIASES, "alias string, value string, rank int")).select("name", "value")


# ---- aggregates ----------------------------------------------------------------------------------------------------


@query(f"""WITH {V_.APP} SELECT person_id, count(*) AS total, count(*) FILTER (status = 'applied') AS applied, count(*) FILTER (status = 'screening') AS screening, count(*) FILTER (status = 'interview') AS interview, count(*) FILTER (status = 'offer') AS offer,
count(*) FILTER (status = 'rejected') AS rejected, CAST(round(CAST(avg(match_score) AS DECIMAL(30, 15)), 2) AS DOUBLE) AS avg_match_score FROM v_app GROUP BY person_id""")
def d01_app_summary(spark, sf):
    return A.application_summary(V_.app(spark, sf))


@query(f"WITH {V_.APP} SELECT person_id, status, count(*) AS n FROM v_app GROUP BY person_id, status")
def d02_app_stats(spark, sf):
    return A.application_stats(V_.app(spark, sf))


@query(f"WITH {V_.POST}, r AS (SELECT count(*) AS total, count(*) FILTER ({_any('''lower(title || ' ' || department)''', _ROLES)}) AS role_class, count(DISTINCT company) AS companies FROM v_post) SELECT total, role_class, CAST(100 * role_class // total AS BIGINT) AS percent, companies FROM r")
def d03_post_summary(spark, sf):
    return A.posting_summary(V_.post(spark, sf), _ROLES)


@query(f"WITH {V_.POST}, c AS (SELECT location, count(*) AS n FROM v_post GROUP BY location) SELECT location, n, repeat('#', CAST(n * 30 // max(n) OVER () AS BIGINT)) AS bar FROM c")
def d04_histogram(spark, sf):
    return A.posting_histogram(V_.post(spark, sf), "location")


@query(f"WITH {V_.COMPANY} SELECT ats, tier, verified, CAST(grouping_id(ats, tier, verified) AS BIGINT) AS gid, count(*) AS n FROM v_company GROUP BY GROUPING SETS ((ats), (tier), (verified))")
def d05_company_tally(spark, sf):
    return A.company_tally(V_.company(spark, sf))


@query(f"WITH {V_.COMPANY}{_DETECTED} SELECT detected_ats, count(*) AS n, count(*) FILTER (detected_ats <> 'undiscovered') AS discovered, count(*) FILTER (error <> '') AS errors, row_number() OVER (ORDER BY count(*) DESC, detected_ats) AS place FROM v_detected GROUP BY detected_ats")
def d06_catalog_summary(spark, sf):
    return C.catalog_summary(_detected(spark, sf)).withColumn("place", F.col("place").cast("long"))


@query(f"WITH {V_.COMPANY}{_DETECTED} SELECT name, domain, error FROM v_detected WHERE error <> ''")
def d06_catalog_errors(spark, sf):
    return C.catalog_errors(_detected(spark, sf))


@query(f"""WITH {V_.COMPANY}{_DETECTED}, a AS (SELECT ats, count(*) AS n_seed FROM v_company GROUP BY ats), b AS (SELECT seed_ats AS ats, count(*) AS n_drift, count(*) FILTER (kind = 'ats_change') AS n_ats, count(*) FILTER (kind = 'board_id_change') AS n_board FROM v_drift WHERE kind IS NOT NULL GROUP BY seed_ats)
SELECT coalesce(a.ats, b.ats) AS ats, coalesce(n_seed, 0) AS n_seed, coalesce(n_drift, 0) AS n_drift, coalesce(n_ats, 0) AS n_ats, coalesce(n_board, 0) AS n_board FROM a FULL JOIN b ON a.ats = b.ats""")
def d07_drift_summary(spark, sf):
    c = V_.company(spark, sf)
    return C.drift_summary(c, C.drift(c, _detected(spark, sf)))


@query(f"WITH {V_.KEYED}{_SEEN} SELECT count(*) AS n FROM v_seen")
def d08_seen_count(spark, sf):
    return A.seen_count(_seen(spark, sf))


@query(f"WITH {V_.OBS} SELECT company, CAST(greatest(0, least(100, coalesce(k, 0) + event_id % 30)) AS BIGINT) AS total, event_id FROM v_obs")
def d10_rubric(spark, sf):
    df = V_.obs(spark, sf).withColumn("b", F.col("event_id") % 30)
    return df.select("company", A.rubric_total(["k", "b"]).cast("long").alias("total"), "event_id")


@query(f"""WITH {V_.OBS} SELECT title AS run, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS failed, CAST(sum(k) AS BIGINT) AS published, CAST(sum(k % 3) AS BIGINT) AS dropped, count(*) FILTER (event_id % 2 = 0) AS httpx, count(*) FILTER (event_id % 2 = 1) AS playwright FROM v_obs GROUP BY title""")
def d12_run_stats(spark, sf):
    o = V_.obs(spark, sf).select(F.col("title").alias("run"), F.when(F.col("ok"), "ok").otherwise("failed").alias("outcome"), F.col("k").alias("published"), (F.col("k") % 3).alias("dropped"), F.when(F.col("event_id") % 2 == 0, "httpx").otherwise("playwright").alias("tier"))
    return A.run_stats(o)


_OUT = ["sent", "skipped_low", "failed", "new", "dropped"]


@query(f"WITH {V_.POST} SELECT company, " + ", ".join(f"count(*) FILTER (doc_id % 5 = {i}) AS {o}" for i, o in enumerate(_OUT)) + " FROM v_post GROUP BY company")
def d13_delivery(spark, sf):
    return A.delivery_stats(V_.post(spark, sf).withColumn("outcome", V_._pick(_OUT, F.col("doc_id"))), "company")


# ---- windows, top-k ------------------------------------------------------------------------------------------------


@query(f"WITH {V_.OBS} SELECT event_id, count(*) OVER (PARTITION BY company, title ORDER BY epoch(date_trunc('second', ts)) RANGE BETWEEN 604800 PRECEDING AND 1 PRECEDING) AS repost_count FROM v_obs")
def e01_repost_count(spark, sf):
    return S.repost_count(V_.obs(spark, sf), 7, "ts").select("event_id", "repost_count")


@query(f"WITH {V_.COMPANY}, t AS (SELECT * FROM v_company UNION ALL SELECT * REPLACE (upper(name) AS name, suppkey + 100000 AS suppkey) FROM v_company) SELECT name, suppkey FROM t QUALIFY row_number() OVER (PARTITION BY lower(name), ats, coalesce(board_id, '') ORDER BY suppkey) = 1")
def e03_dedupe_companies(spark, sf):
    c = V_.company(spark, sf)
    return A.dedupe_companies(c.unionByName(c.withColumns({"name": F.upper("name"), "suppkey": F.col("suppkey") + 100000})), ["suppkey"], [" (old)"]).select("name", "suppkey")


@query(f"WITH {V_.KEYED} SELECT person_id, key, score FROM (SELECT 'p' || (doc_id % 5) AS person_id, key, (doc_id % 100) / 100.0::DOUBLE AS score FROM v_keyed WHERE doc_id % 2 = 1) QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY score DESC, key DESC) = 1")
def e04_best_match(spark, sf):
    k = V_.keyed(spark, sf)
    return A.best_match(k.select(F.concat(F.lit("p"), (F.col("doc_id") % 5).cast("string")).alias("person_id"), "key", ((F.col("doc_id") % 100) / 100.0).alias("score"), (F.col("doc_id") % 2).cast("int").alias("notified")))


@query(f"WITH {V_.OBS} SELECT company, title, k FROM v_obs QUALIFY row_number() OVER (PARTITION BY company ORDER BY ts DESC, event_id DESC) = 1")
def e05_latest_status(spark, sf):
    return A.latest(V_.obs(spark, sf), "company", ["ts", "event_id"], ["title", "k"])


@query(f"""WITH {V_.OBS}, i AS (SELECT *, sum(CAST(ok AS INTEGER)) OVER (PARTITION BY company ORDER BY ts, event_id) AS island FROM v_obs), s AS (SELECT *, sum(CAST(NOT ok AS INTEGER)) OVER (PARTITION BY company, island ORDER BY ts, event_id) AS streak FROM i),
b AS (SELECT *, coalesce(lag(streak) OVER w, 0) AS before, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap FROM s WINDOW w AS (PARTITION BY company ORDER BY ts, event_id))
SELECT event_id, CAST(streak AS BIGINT) AS streak, CASE WHEN before >= 2 AND gap > 3600000000 THEN 'half_open' WHEN before >= 2 THEN 'open' ELSE 'closed' END AS state_before, CASE WHEN NOT ok AND streak >= 2 THEN 'open' ELSE 'closed' END AS state FROM b""")
def e06_fetch_health(spark, sf):
    return A.fetch_health(V_.obs(spark, sf), 2, 3600).select("event_id", "streak", "state_before", "state")


@query(f"WITH {V_.KEYED}{_SEEN} SELECT key, title FROM v_seen ORDER BY first_seen_at DESC, key LIMIT 20")
def f01_recent(spark, sf):
    return A.recent(_seen(spark, sf), 20).select("key", "title")


@query(f"WITH {V_.KEYED}{_SEEN} SELECT key, score FROM v_seen WHERE notified = 0 AND score >= 0.3 ORDER BY score DESC, first_seen_at DESC, key LIMIT 30")
def f02_backfill(spark, sf):
    return A.backfill(_seen(spark, sf), 0.3, 30).select("key", "score")


@query(f"WITH {V_.POST} SELECT company, count(*) AS n FROM v_post GROUP BY company ORDER BY n DESC, company LIMIT 25")
def f03_top_companies(spark, sf):
    return A.top_companies(V_.post(spark, sf))


@query(f"WITH {V_.COMPANY} SELECT name, ats, tier FROM v_company ORDER BY ats, tier, lower(name), name")
def f06_sorted_companies(spark, sf):
    return A.sort_companies(V_.company(spark, sf)).select("name", "ats", "tier")


@query(f"WITH {V_.POST} SELECT source_id, source, title, NULL::VARCHAR AS html FROM v_post UNION ALL SELECT CAST(page_id AS VARCHAR), 'html', 'Role ' || page_id, html FROM pages")
def g01_union(spark, sf):
    p = V_.table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("source_id"), F.lit("html").alias("source"), F.concat(F.lit("Role "), F.col("page_id").cast("string")).alias("title"), "html")
    return J.union_postings(V_.post(spark, sf).select("source_id", "source", "title"), p)


@query(f"WITH {V_.POST}, w AS (SELECT source_id, list_filter({_list(WORDS.niche)}, lambda x: contains(lower(description_text), x)) AS l FROM v_post) SELECT source_id, array_to_string(list_filter(l, lambda x: x IN ('of ', 'the ', 'license')), '|') AS matched, array_to_string(list_filter(l, lambda x: x NOT IN ('of ', 'the ', 'license')), '|') AS missing FROM w")
def g02_matched_missing(spark, sf):
    low = F.lower("description_text")
    left = F.filter(F.array(*map(F.lit, WORDS.niche)), lambda t: F.contains(low, t))
    m, x = J.matched_missing(left, F.array(F.lit("of "), F.lit("the "), F.lit("license")))
    return V_.post(spark, sf).select("source_id", F.array_join(m, "|").alias("matched"), F.array_join(x, "|").alias("missing"))


# ---- scoring -------------------------------------------------------------------------------------------------------


def _scored(spark, sf):
    profiles = S.load_profiles(V_.profiles(spark))
    df = S.fan_out(S.prepare(V_.post(spark, sf), WORDS, S.skills_of(profiles)), profiles).withColumn("embedding_score", (F.col("doc_id") % 100) / 100.0)
    return S.score(df, WORDS)


def _first(text: str, items: str) -> str:
    return f"list_filter({items}, lambda x: x <> '' AND contains({text}, x))[1]"


def _count(text: str, items: list[str]) -> str:
    return f"len(list_filter({_list(items)}, lambda x: contains({text}, x)))"


_RULES = {
    "target_title_match": ("target IS NOT NULL", "0.10", "'title matches target ''' || target || ''''"),
    "seniority_match": ("seniority_level <> '' AND contains(t, seniority_level)", "0.05", "'seniority ''' || seniority_level || ''' present in title'"),
    "red_flag_penalty": ("flag_t IS NOT NULL", "-0.25", "'red flag ''' || flag_t || ''' in title'"),
    "red_flag_desc_penalty": ("flag_t IS NULL AND flag_d IS NOT NULL", "-0.20", "'red flag ''' || flag_d || ''' in description'"),
    "desc_red_flag_penalty": ("flag_o IS NOT NULL", "-0.25", "'desc red flag ''' || flag_o || ''' in description'"),
    "no_sponsorship_penalty": ("sponsor IS NOT NULL", "-0.30", "'description signals no sponsorship: ''' || sponsor || ''''"),
    "non_tech_penalty": ("non_tech IS NOT NULL", "-0.50", "'non-tech title token ''' || non_tech || ''''"),
    "ambiguous_no_tech_context": ("amb IS NOT NULL AND non_tech IS NULL AND NOT tech", "-0.25", "'ambiguous ''' || amb || ''' with no tech context'"),
    "niche_title_match": ("NOT skip_niche AND niche_t IS NOT NULL", "0.05", "'niche title token ''' || niche_t || ''''"),
    "sre_density_bonus": ("NOT skip_niche AND niche >= 2", "round_even(least(0.10::DOUBLE, 0.02::DOUBLE * (niche // 2)), 4)", "niche || ' SRE-niche signals in JD'"),
    "coding_heavy_penalty": ("NOT skip_niche AND coding >= 2 AND coding > niche", "-round_even(least(0.25::DOUBLE, 0.05::DOUBLE * coding), 4)", "'coding-heavy role: ' || coding || ' coding vs ' || niche || ' SRE signals'"),
    "generic_swe_no_niche": (f"NOT skip_niche AND contains(t, '{WORDS.generic_title}') AND niche_t IS NULL AND niche = 0", "-0.15", "'generic SWE title, no SRE-niche evidence'"),
    "location_india": ("place = 'india'", "-0.20", "'location is India (' || location || ')'"),
    "location_non_us": ("place = 'other'", "-0.40", "'location is non-US/non-India (' || location || ')'"),
    "skill_overlap_bonus": ("len(matched) > 0", "round_even(least(0.10::DOUBLE, 0.02::DOUBLE * len(matched)), 4)", None),
}
_PLACE = f"""CASE WHEN {_any("' ' || lower(location) || ' '", WORDS.us)} THEN 'us' WHEN {_any("' ' || lower(location) || ' '", WORDS.india)} THEN 'india' WHEN {_any("' ' || lower(location) || ' '", WORDS.other)} THEN 'other' ELSE 'unknown' END"""
_SCORED = f"""WITH {V_.POST}, {V_.PROFILE}, s0 AS (SELECT *, lower(title) AS t, lower(description_text) AS d, (doc_id % 100) / 100.0::DOUBLE AS embedding_score FROM v_post CROSS JOIN v_profile),
s1 AS (SELECT *, {_first('t', 'target_titles')} AS target, {_first('t', 'red_flags')} AS flag_t, {_first('d', 'red_flags')} AS flag_d, {_first('d', 'desc_red_flags')} AS flag_o,
{_first('d', _list(WORDS.no_sponsorship))} AS sponsor, {_first('t', _list(WORDS.non_tech))} AS non_tech, {_first('t', _list(WORDS.ambiguous))} AS amb, ({_any('t', WORDS.tech_context)} OR {_any('d', WORDS.tech_context)}) AS tech,
{_first('t', _list(WORDS.niche_title))} AS niche_t, {_count('d', WORDS.niche)} AS niche, {_count('t', WORDS.coding)} + {_count('d', WORDS.coding)} AS coding, {_PLACE} AS place,
list_filter(core_skills, lambda x: CASE WHEN regexp_matches(x, '[ +#.-]') THEN contains(d, x) ELSE regexp_matches(d, '(^|[^\\pL\\pN_])' || x || '($|[^\\pL\\pN_])') END) AS matched FROM s0),
s2 AS (SELECT *, {", ".join(f"CASE WHEN {c} THEN CAST({d} AS DOUBLE) END AS r_{n}" for n, (c, d, _) in _RULES.items())} FROM s1),
s3 AS (SELECT *, embedding_score + ({" + ".join(f"coalesce(r_{n}, 0)" for n in _RULES)}) AS total, list_filter([{", ".join(f"CASE WHEN r_{n} IS NOT NULL THEN {t} END" for n, (_, _, t) in _RULES.items() if t)}], lambda x: x IS NOT NULL) AS notes,
list_filter([{", ".join(f"CASE WHEN r_{n} IS NOT NULL THEN '{n}=' || printf('%.4f', r_{n}) END" for n in _RULES)}], lambda x: x IS NOT NULL) AS rules FROM s2),
s4 AS (SELECT *, CASE WHEN r_no_sponsorship_penalty IS NOT NULL THEN least(total, 0.2) ELSE total END AS c1 FROM s3), s5 AS (SELECT *, CASE WHEN r_location_non_us IS NOT NULL THEN least(c1, 0.2) ELSE c1 END AS c2 FROM s4),
s6 AS (SELECT *, CASE WHEN r_non_tech_penalty IS NOT NULL THEN least(c2, 0.15) ELSE c2 END AS c3 FROM s5),
v_scored AS (SELECT *, round_even(greatest(0, least(1, c3)), 4) AS score, array_to_string(['semantic match ' || printf('%.2f', round_even(embedding_score, 2))] || (CASE WHEN len(matched) > 0 THEN ['matched ' || len(matched) || ' core skills (' || array_to_string(matched[1:4], ', ') || ')'] ELSE [] END)
|| notes || (CASE WHEN len(rules) = 0 THEN ['no rule adjustments applied'] ELSE [] END), '; ') AS reason, list_filter(core_skills, lambda x: NOT list_contains(matched, x))[1:5] AS missing FROM s6)"""


@query(f"WITH {V_.POST} SELECT source_id, {_PLACE} AS place FROM v_post")
def h13_location_class(spark, sf):
    return V_.post(spark, sf).select("source_id", S.location_class(F.col("location"), WORDS).alias("place"))


@query("WITH p AS (SELECT vec_id AS pid, embedding AS pv FROM embeddings WHERE vec_id < 3) SELECT vec_id, pid, round_even(greatest(0, least(1, list_cosine_similarity(embedding::DOUBLE[], pv::DOUBLE[]) / 0.85)), 6) AS score FROM embeddings, p")
def i02_similarity(spark, sf):
    e = V_.table(spark, sf, "embeddings")
    p = e.filter("vec_id < 3").select(F.col("vec_id").alias("pid"), F.col("embedding").alias("pv"))
    return S.fan_out(e, p).select("vec_id", "pid", F.bround(S.embedding_score(F.col("embedding"), F.col("pv")), 6).alias("score"))


_COSINE = "list_cosine_similarity(e.embedding::DOUBLE[], p.embedding::DOUBLE[]) / 0.85"


@query(f"SELECT e.vec_id, p.vec_id AS pid, round_even(least(1, {_COSINE}), 6) AS score FROM embeddings e JOIN embeddings p ON p.vec_id % 5 = 0 AND p.vec_id < 500 AND {_COSINE} >= 0.4")
def i02_blocked(spark, sf):
    """Every vector with a hundred profiles as matrix products; pairs below the gate are never rows."""
    e = V_.table(spark, sf, "embeddings")
    profiles = e.filter("vec_id % 5 = 0 AND vec_id < 500").select(F.col("vec_id").alias("pid"), "embedding")
    return EM.similar(e, "embedding", profiles, "pid", "embedding", ["vec_id"], 0.4).select("vec_id", "pid", F.bround("embedding_score", 6).alias("score"))


_LETTERS = "list_transform(range(26), lambda k: CAST(length({0}) - length(replace({0}, chr(CAST(97 + k AS INTEGER)), '')) AS DOUBLE))"


@query(f"""WITH {V_.POST}, {V_.PROFILE}, a AS (SELECT source_id, {_LETTERS.format("lower(regexp_replace(title || ' at ' || company || chr(10) || chr(10) || left(description_text, 1500), '^\\s+|\\s+$', '', 'g'))")} AS v FROM v_post),
b AS (SELECT person_id, {_LETTERS.format("lower(profile_summary || chr(10) || chr(10) || 'Core skills: ' || array_to_string(core_skills, ', '))")} AS w FROM v_profile)
SELECT source_id, person_id, round_even(greatest(0, least(1, list_cosine_similarity(v, w) / 0.85)), 6) AS score FROM a, b""")
def k02_embedder(spark, sf):
    """Postings and profiles through a model, and their similarity."""
    embed = EM.embedder(EM.sign_counts)
    postings = V_.post(spark, sf).select("source_id", embed(S.embed_text()).alias("vector"))
    profiles = V_.profiles(spark).select("person_id", embed(S.profile_text()).alias("profile_vector"))
    found = EM.similar(postings, "vector", profiles, "person_id", "profile_vector", ["source_id"])
    return found.select("source_id", "person_id", F.bround("embedding_score", 6).alias("score"))


@query(f"WITH {V_.POST} SELECT source_id, regexp_replace(title || ' at ' || company || chr(10) || chr(10) || left(description_text, 1500), '^\\s+|\\s+$', '', 'g') AS text FROM v_post")
def i01_embed_text(spark, sf):
    return V_.post(spark, sf).select("source_id", S.embed_text().alias("text"))


@query(f"{_SCORED} SELECT source_id, person_id, array_to_string(rules, ',') AS rules FROM v_scored")
def i03_rules(spark, sf):
    shown = F.transform(F.map_entries("rule_adjustments"), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.4f", e["value"])))
    return _scored(spark, sf).select("source_id", "person_id", F.array_join(shown, ",").alias("rules"))


@query(f"{_SCORED} SELECT source_id, person_id, score FROM v_scored")
def i04_final_score(spark, sf):
    return _scored(spark, sf).select("source_id", "person_id", "score")


@query(f"{_SCORED} SELECT source_id, person_id, reason, array_to_string(missing, ',') AS missing FROM v_scored")
def i05_reason(spark, sf):
    return _scored(spark, sf).select("source_id", "person_id", "reason", F.array_join("missing_skills", ",").alias("missing"))


@query(f"{_SCORED} SELECT source_id, person_id, score FROM v_scored WHERE score >= 0.65")
def b11_gate(spark, sf):
    return B.gate(_scored(spark, sf)).select("source_id", "person_id", "score")


@query(f"{_SCORED} SELECT source_id, person_id, score FROM v_scored WHERE score >= CASE person_id WHEN 'p1' THEN 0.5 ELSE 0.65 END AND doc_id % 2 = 0")
def b12_match_gate(spark, sf):
    df = _scored(spark, sf).withColumns({"match_threshold": F.when(F.col("person_id") == "p1", 0.5), "visa_ok": F.col("doc_id") % 2 == 0})
    return B.match_gate(df).select("source_id", "person_id", "score")


@query(f"{_SCORED} SELECT source_id, person_id, score FROM v_scored WHERE score >= 0.5 ORDER BY score DESC, person_id, source_id LIMIT 50")
def f04_top_matches(spark, sf):
    return A.top_matches(_scored(spark, sf), 0.5, 50).select("source_id", "person_id", "score")


_AGE = f"(date_diff('second', posted_at, TIMESTAMP '{AS_OF}') / 86400.0::DOUBLE)"
_SAID = "'posted ' || printf('%.0f', round_even(age, 0)) || ' days ago ("
_LEGIT = f"""l0 AS (SELECT *, {_AGE} AS age, lower(description_text) AS low, doc_id % 6 AS reposts, {_count('lower(description_text)', WORDS.niche)} AS hits FROM v_post),
l1 AS (SELECT *, CASE WHEN age <= 30 THEN 2 WHEN age <= 60 THEN 0 WHEN age <= 120 THEN -1 ELSE -2 END + CASE WHEN reposts >= 4 THEN -2 WHEN reposts >= 2 THEN -1 ELSE 0 END + CASE WHEN len(low) > 200 AND hits >= 5 THEN 1 WHEN len(low) > 800 AND hits = 0 THEN -1 ELSE 0 END AS pts,
array_to_string(list_filter([{_SAID}' || CASE WHEN age <= 30 THEN 'fresh' WHEN age <= 60 THEN 'mixed' WHEN age <= 120 THEN 'concerning' ELSE 'likely stale' END || ')', CASE WHEN reposts >= 4 THEN 'reposted ' || reposts || 'x in 90d (ghost pattern)' WHEN reposts >= 2 THEN 'reposted ' || reposts || 'x in 90d' END,
CASE WHEN len(low) > 200 AND hits >= 5 THEN 'specific JD (' || hits || ' concrete tech terms)' WHEN len(low) > 800 AND hits = 0 THEN 'vague JD (no specific tech mentioned)' END], lambda x: x IS NOT NULL), '; ') AS signals FROM l0)"""


@query(f"WITH {V_.POST}, {_LEGIT} SELECT source_id, CASE WHEN pts >= 2 THEN 'HIGH_CONFIDENCE' WHEN pts <= -2 THEN 'SUSPICIOUS' ELSE 'PROCEED_WITH_CAUTION' END AS tier, signals FROM l1")
def i06_legitimacy(spark, sf):
    df = V_.post(spark, sf).withColumn("repost_count", F.col("doc_id") % 6)
    out = S.legitimacy(df, F.lit(AS_OF).cast("timestamp"), WORDS.niche)
    return out.select("source_id", F.col("legitimacy_tier").alias("tier"), F.array_join("legitimacy_signals", "; ").alias("signals"))


# ---- text outputs --------------------------------------------------------------------------------------------------


def _flat(spark, sf):
    out = _scored(spark, sf).filter("person_id <> 'p3'")
    return out.withColumns({"legitimacy_tier": V_._pick(["HIGH_CONFIDENCE", "PROCEED_WITH_CAUTION", "SUSPICIOUS", ""], F.col("doc_id")), "legitimacy_signals": F.array().cast("array<string>"), "scraped_text": F.date_format("scraped_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")})


def _md(x: str) -> str:
    return f"regexp_replace({x}, '[*_\\[\\]()]', '', 'g')"


_BADGE = "CASE doc_id % 4 WHEN 0 THEN chr(10) || '_Posting: HIGH confidence likely real_' WHEN 1 THEN chr(10) || '_Posting: caution mixed signals_' WHEN 2 THEN chr(10) || '_Posting: SUSPICIOUS possible ghost job_' ELSE '' END"


@query(f"""{_SCORED} SELECT source_id, person_id, '*NEW MATCH — ' || {_md('company')} || '*' || chr(10) || '*' || {_md('title')} || '*' || chr(10) || 'Score: ' || CAST(round_even(score * 100, 0) AS INTEGER) || '% | Remote: ' || CASE WHEN remote THEN 'yes' ELSE 'no' END || ' | ' || {_md('location')} || {_BADGE} || chr(10) || chr(10)
|| '*Why match:* ' || {_md('reason')} || chr(10) || chr(10) || '*Skills you have:* ' || coalesce(nullif({_md("array_to_string(matched, ', ')")}, ''), '-') || chr(10) || '*Gaps:* ' || coalesce(nullif({_md("array_to_string(missing, ', ')")}, ''), 'none') || chr(10) || chr(10) || '[Apply](' || url || ')' || chr(10) || chr(10)
|| '_scraped ' || strftime(scraped_at, '%Y-%m-%d %H:%M') || ' UTC_' AS alert FROM v_scored WHERE person_id <> 'p3'""")
def i15_alert(spark, sf):
    return _flat(spark, sf).select("source_id", "person_id", R.alert_text(F.col("scraped_text")).alias("alert"))


_TABLE = f"""CASE WHEN len(rules) = 0 THEN '_no rule adjustments applied_' ELSE '| Rule | Adjustment |' || chr(10) || '|------|-----------:|' || chr(10) || array_to_string(list_transform(list_sort(list_filter([{", ".join(f"CASE WHEN r_{n} IS NOT NULL THEN struct_pack(a := -abs(r_{n}), i := {i}, s := '| {n} | ' || CASE WHEN r_{n} >= 0 THEN '+' ELSE '' END || printf('%.3f', round_even(r_{n}, 3)) || ' |') END" for i, n in enumerate(_RULES))}], lambda x: x IS NOT NULL)), lambda x: x.s), chr(10)) END"""


@query(f"{_SCORED} SELECT source_id, person_id, {_TABLE} AS adjustments FROM v_scored WHERE person_id <> 'p3'")
def f05_adjustments(spark, sf):
    return _flat(spark, sf).select("source_id", "person_id", R.adjustments_table(F.col("rule_adjustments")).alias("adjustments"))


def _report_sql(key: str, scraped: str, score: str, embedding: str, tier: str, url: str, location: str, remote: str, reason: str, have: str, gaps: str, table: str) -> str:
    """The report as SQL, line by line."""
    pct = f"CAST(round_even({score} * 100, 0) AS INTEGER)"
    lines = [
        "'# ' || company || ' — ' || title", "", f"'**dedup_id:** `' || {key} || '`  '", "'**source:** streaming-pipeline  '", f"'**posted/scraped:** ' || {scraped} || '  '",
        f"'**reviewed:** {AS_OF[:16]} UTC'", "", "'## Summary'", "", f"'- **Score:** ' || printf('%.2f', round_even({score}, 2)) || ' (' || {pct} || '%)'", f"'- **Embedding score:** ' || printf('%.2f', round_even({embedding}, 2))",
        f"'- **' || {tier} || '**'", f"'- **Apply URL:** [' || {url} || '](' || {url} || ')'", f"'- **Location:** ' || {location} || ' (remote: ' || CASE WHEN {remote} THEN 'yes' ELSE 'no' END || ')'", "",
        "'## Why match'", "", reason, "", "'## Skills'", "", f"'- **You have:** ' || {have}", f"'- **Gaps:** ' || {gaps}", "", "'## Score breakdown'", "", table, "",
        "'## Posting legitimacy signals'", "", "'_no signals recorded_'", "", "'## Application status'", "",
        *(f"'- [ ] {x}'" for x in ("resume tailored", "cover letter generated", "applied", "heard back", "interview", "offer")), "",
        f"'_Update by editing this file or via the Telegram inline buttons (dedup_id `' || {key} || '`)._'", "",
    ]
    return " || chr(10) || ".join(x or "''" for x in lines)


_TIER = """CASE doc_id % 4 WHEN 0 THEN 'Legitimacy: HIGH (likely real, active opening)' WHEN 1 THEN 'Legitimacy: PROCEED WITH CAUTION (mixed signals)' WHEN 2 THEN 'Legitimacy: SUSPICIOUS (multiple ghost-job indicators)' ELSE 'Legitimacy: not assessed' END"""


@query(f"""{_SCORED} SELECT source_id, person_id, {_report_sql("substr(sha256(lower(company) || '|' || source_id), 1, 16)", "strftime(scraped_at, '%Y-%m-%dT%H:%M:%SZ')", "score", "embedding_score", _TIER, "url", "location", "remote", "reason",
"coalesce(nullif(array_to_string(matched, ', '), ''), '-')", "coalesce(nullif(array_to_string(missing, ', '), ''), 'none')", _TABLE)} AS report FROM v_scored WHERE person_id <> 'p3'""")
def i16_report(spark, sf):
    key = short_id(posting_key(F.col("company"), F.col("source_id")))
    return _flat(spark, sf).select("source_id", "person_id", R.report_text(key, F.lit(AS_OF).cast("timestamp"), F.col("scraped_text")).alias("report"))


@query(f"""{_SCORED} SELECT substr(sha256(lower(company) || '|' || source_id), 1, 16) AS dedup_id, '2024-01-31 06:00' AS date_added, '{V_.PERSON}' AS person, company, title, department, location, CASE WHEN remote THEN 'Yes' ELSE 'No' END AS remote, source,
CAST(round_even(score * 100, 0) AS INTEGER) || '%' AS match_score, '' AS ats_score, '' AS recruiter_score, '' AS archetype, CASE WHEN contains(lower(reason), 'no sponsorship') THEN 'No' ELSE 'Yes' END AS visa_ok, url AS apply_url, '' AS drive_folder_link, '' AS resume_url, '' AS cover_letter_url,
'' AS required_skills, '' AS missing_skills, 'NEW' AS status, left(reason, 300) AS notes FROM v_scored WHERE person_id <> 'p3'""")
def i17_tracker_row(spark, sf):
    return R.tracker_row(_flat(spark, sf), F.lit(AS_OF).cast("timestamp"), V_.PERSON)


@query(f"""WITH {V_.KEYED} SELECT substr(key, 1, 16) AS dedup_id, '2024-01-31 06:00' AS date_added, '{V_.PERSON}' AS person, company, title, department, location, CASE WHEN remote THEN 'Yes' ELSE 'No' END AS remote, source,
CASE WHEN doc_id % 10 = 0 THEN '' ELSE CAST(round_even((doc_id % 100) / 100.0::DOUBLE * 100, 0) AS INTEGER) || '%' END AS match_score, CAST(doc_id % 90 AS VARCHAR) AS ats_score, '' AS recruiter_score, '' AS archetype, 'Yes' AS visa_ok, url AS apply_url, '' AS drive_folder_link, '' AS resume_url, '' AS cover_letter_url,
'' AS required_skills, '' AS missing_skills, 'NEW' AS status, left(description_text, 500) AS notes FROM v_keyed""")
def i18_tracker_full(spark, sf):
    i = F.col("doc_id")
    df = V_.keyed(spark, sf).select(short_id(F.col("key")).alias("dedup_id"), "company", "title", "department", "location", "remote", "source", F.when(i % 10 != 0, (i % 100) / 100.0).alias("match_score"), (i % 90).alias("ats_score"), "url", F.col("description_text").alias("notes"))
    return R.tracker_row_full(df, F.lit(AS_OF).cast("timestamp"), V_.PERSON)


@query(f"""WITH {V_.KEYED} SELECT substr(key, 1, 16) AS dedup_id, '2024-01-31 06:00' AS date_added, company, title, CAST(round_even((doc_id % 100) / 100.0::DOUBLE * 100, 0) AS INTEGER) || '%' AS score, CASE WHEN doc_id % 4 = 0 THEN 'No' ELSE 'Yes' END AS visa_ok, location, CASE WHEN remote THEN 'Yes' ELSE 'No' END AS remote, url AS apply_url,
'' AS resume_url, '' AS cover_letter_url, 'PENDING_REVIEW' AS status, left(description_text, 300) AS match_reasoning FROM v_keyed""")
def i19_tracker_13(spark, sf):
    i = F.col("doc_id")
    df = V_.keyed(spark, sf).withColumns({"score": (i % 100) / 100.0, "visa_ok": i % 4 != 0, "resume_url": F.lit(None).cast("string"), "cover_letter_url": F.lit(""), "reasoning": F.col("description_text")})
    return R.tracker_row_13(df, F.lit(AS_OF).cast("timestamp"))
