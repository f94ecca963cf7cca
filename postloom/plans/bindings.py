"""Bindings of the operators to the tables of a data folder, as DataFrames and, for checks, as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import with_key
from ..vocab import Vocabulary

AS_OF = "2024-01-31 06:00:00"
PLACES = ["San Francisco, CA", "Bangalore, India", "London, UK", "Remote", "Austin, TX", "Berlin, Germany"]
DEPARTMENTS = ["Cloud", "Sales", "Data", ""]
STATUSES = ["applied", "screening", "interview", "offer", "rejected", "pending_review", "skipped"]
PERSON = "someone"
VENDORS = ["greenhouse", "lever", "ashby", "workday", "smartrecruiters", "custom", "zoho"]

# word lists whose members occur in the tables' texts
WORDS = Vocabulary(
    no_sponsorship=["token = ", "idiot"], non_tech=["und ", "!!"], ambiguous=["tion", "ent"], tech_context=["license", "ing the "],
    niche=["the ", "of ", "and ", "that ", "with ", "license", "from "], coding=["der ", "die ", "und ", "das "],
    niche_title=["the ", "les "], us=["san francisco", "austin"], india=["bangalore"], other=["london, uk", "berlin"], generic_title="ing",
)
PROFILES = [
    ("p1", ["license", "of the", "idiot", "with"], ["the ", "tion"], ["###", "moron"], ["worthless"], "is", False, "english"),
    ("p2", ["und", "der", "que", "les"], ["der", "les "], ["|"], ["clown", "token"], "", True, "mixed"),
    ("p3", ["zzzz"], ["qqqq"], ["xxxx"], ["yyyy"], "wwww", False, "none"),
]
PROFILE_SCHEMA = "person_id string, core_skills array<string>, target_titles array<string>, red_flags array<string>, desc_red_flags array<string>, seniority_level string, skip_niche boolean, profile_summary string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(items: list[str], by) -> object:
    return F.get(F.array(*map(F.lit, items)), (by % len(items)).cast("int"))


def post(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    day = F.lit("2024-01-31").cast("timestamp")
    back = lambda n: F.timestamp_seconds(F.unix_seconds(day) - (i % n) * 86_400)
    return d.select(
        i.cast("string").alias("source_id"), "source", F.col("source").alias("company"),
        F.substring(F.substring_index("text", "\n", 1), 1, 80).alias("title"), F.col("text").alias("description_text"),
        _pick(PLACES, i).alias("location"), _pick(DEPARTMENTS, i).alias("department"),
        F.concat(F.lit("https://jobs.example.com/p/"), i.cast("string"), F.lit("?utm_source=feed#top")).alias("url"),
        (i % 3 == 0).alias("remote"), back(200).alias("posted_at"), back(100).alias("scraped_at"), "doc_id",
    )


POST = f"""v_post AS (SELECT CAST(doc_id AS VARCHAR) AS source_id, source, source AS company,
left(split_part(text, chr(10), 1), 80) AS title, text AS description_text, {PLACES}[doc_id % 6 + 1] AS location,
{DEPARTMENTS}[doc_id % 4 + 1] AS department, 'https://jobs.example.com/p/' || doc_id || '?utm_source=feed#top' AS url,
doc_id % 3 = 0 AS remote, TIMESTAMP '2024-01-31' - to_days(CAST(doc_id % 200 AS INTEGER)) AS posted_at,
TIMESTAMP '2024-01-31' - to_days(CAST(doc_id % 100 AS INTEGER)) AS scraped_at, doc_id FROM documents)"""


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_key(post(spark, sf_dir))


KEYED = POST + ", v_keyed AS (SELECT *, sha256(lower(company) || '|' || source_id) AS key FROM v_post)"


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROFILES, PROFILE_SCHEMA)


def _sql_profile(p) -> str:
    return f"('{p[0]}', {p[1]}, {p[2]}, {p[3]}, {p[4]}, '{p[5]}', {str(p[6]).lower()}, '{p[7]}')"


PROFILE = f"v_profile AS (SELECT * FROM (VALUES {', '.join(map(_sql_profile, PROFILES))}) t(person_id, core_skills, target_titles, red_flags, desc_red_flags, seniority_level, skip_niche, profile_summary))"


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").cast("string").alias("company"), F.col("event_type").alias("title"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("ok"), F.get_json_object("props", "$.k").cast("long").alias("k"), "value")


OBS = "v_obs AS (SELECT event_id, CAST(user_id AS VARCHAR) AS company, event_type AS title, ts, event_type <> 'error' AS ok, CAST(props->>'$.k' AS BIGINT) AS k, value FROM events)"


def app(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = _pick(STATUSES, F.col("o_orderkey") + F.col("o_custkey"))
    return o.select(F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("p"), (F.col("o_custkey") % 7).cast("string")).alias("person_id"), status.alias("status"), (F.col("o_totalprice") / 500000).alias("match_score"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"))


APP = f"""v_app AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, 'p' || (o_custkey % 7) AS person_id, {STATUSES}[(o_orderkey + o_custkey) % 7 + 1] AS status,
o_totalprice / 500000 AS match_score, strftime(o_orderdate, '%Y-%m-%d') AS created_at FROM orders)"""


def company(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    k = F.col("s_suppkey")
    j = s.join(n, s["s_nationkey"] == n["n_nationkey"])
    return j.select(
        F.col("s_name").alias("name"), F.concat(F.lit("www.s"), k.cast("string"), F.lit(".example.com")).alias("domain"),
        (k % 3 + 1).cast("int").alias("tier"), _pick(VENDORS, F.col("n_nationkey")).alias("ats"), F.lower("n_name").alias("board_id"),
        F.when(k % 4 == 0, F.concat(F.lit("https://s"), k.cast("string"), F.lit(".example.com/jobs"))).when(k % 4 == 1, "").alias("career_url"),
        (k % 2 == 0).alias("verified"), F.when(k % 3 == 0, "apple").otherwise("own").alias("custom_module"), k.alias("suppkey"),
    )


COMPANY = f"""v_company AS (SELECT s_name AS name, 'www.s' || s_suppkey || '.example.com' AS domain, CAST(s_suppkey % 3 + 1 AS INTEGER) AS tier, {VENDORS}[n_nationkey % 7 + 1] AS ats, lower(n_name) AS board_id,
CASE WHEN s_suppkey % 4 = 0 THEN 'https://s' || s_suppkey || '.example.com/jobs' WHEN s_suppkey % 4 = 1 THEN '' END AS career_url, s_suppkey % 2 = 0 AS verified,
CASE WHEN s_suppkey % 3 = 0 THEN 'apple' ELSE 'own' END AS custom_module, s_suppkey AS suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def bullets(spark: SparkSession, sf_dir: str, role: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").filter(F.col("role") == role)
    return c.select(F.col("conv_id").alias("doc"), (F.col("conv_id") % 3 + 1).alias("role_index"), F.col("turn").alias("bullet_index"), F.col("text").alias("bullet"))


def bullets_sql(name: str, role: str) -> str:
    return f"{name} AS (SELECT conv_id AS doc, conv_id % 3 + 1 AS role_index, turn AS bullet_index, text AS bullet FROM conversations WHERE role = '{role}')"
