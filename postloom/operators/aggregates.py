"""Aggregations, top-k and window operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .filters import role_class


# The statuses that a person's summary counts.
SUMMARY = ("applied", "screening", "interview", "offer", "rejected")


SLICE = 1 << 20  # rows of a slice of time, about


def longest_log(df: DataFrame, *keys: Column) -> int:
    """The rows of the key that has most: partial sums, one number to the driver."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def time_slices(df: DataFrame, key: Column, place: Column, rows: int = SLICE) -> DataFrame:
    """Adds ``_key`` (text, never null) and ``_slice``: each key's span of ``place`` (a whole number) in even slices, as many as its
    rows need. The counts are partial sums."""
    keyed = df.withColumns({"_key": F.to_json(F.struct(key.alias("k"))), "_place": place})
    spans = keyed.groupBy("_key").agg(F.count("*").alias("_n"), F.min("_place").alias("_lo"), F.max("_place").alias("_hi"))
    width = F.greatest(F.lit(1), F.ceil((F.col("_hi") - F.col("_lo") + 1) / F.ceil(F.col("_n") / rows)))
    spans = spans.select("_key", "_lo", width.alias("_width"))
    return keyed.join(spans, "_key").withColumn("_slice", F.floor((F.col("_place") - F.col("_lo")) / F.col("_width"))).drop("_place", "_lo", "_width")


def application_summary(df: DataFrame) -> DataFrame:
    """Per person: total, counts by status, average score to two places (half away from zero, as decimals are rounded)."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    average = F.round(F.avg("match_score").cast("decimal(30,15)"), 2).cast("double")
    return df.groupBy("person_id").agg(F.count("*").alias("total"), *map(n, SUMMARY), average.alias("avg_match_score"))


def application_stats(df: DataFrame) -> DataFrame:
    return df.groupBy("person_id", "status").agg(F.count("*").alias("n")).orderBy("person_id", "status")


def posting_summary(df: DataFrame, tokens: list[str]) -> DataFrame:
    roles = F.count_if(role_class(tokens))
    total = F.count("*")
    return df.agg(total.alias("total"), roles.alias("role_class"), F.when(total > 0, F.floor(100 * roles / total)).otherwise(0).cast("long").alias("percent"), F.countDistinct("company").alias("companies"))


def posting_histogram(df: DataFrame, key: str, width: int = 30) -> DataFrame:
    """Counts with a bar in proportion to the largest. The window holds a row a group."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    top = counts.agg(F.max("n").alias("top"))
    return counts.crossJoin(top).select(key, "n", F.expr(f"repeat('#', int(n * {width} div top))").alias("bar"))


def company_tally(df: DataFrame) -> DataFrame:
    return df.groupingSets([["ats"], ["tier"], ["verified"]], "ats", "tier", "verified").agg(F.grouping_id().alias("gid"), F.count("*").alias("n"))


def seen_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def rubric_total(axes: list[str]) -> Column:
    """Sum of the axes, missing ones 0, within 0 to 100."""
    total = F.lit(0)
    for a in axes:
        total = total + F.coalesce(F.col(a), F.lit(0))
    return F.greatest(F.lit(0), F.least(F.lit(100), total))


def run_stats(df: DataFrame, key: str = "run") -> DataFrame:
    """Per run: companies ok and failed, rows published and dropped, pages by fetch tier."""
    return df.groupBy(key).agg(
        F.count_if(F.col("outcome") == "ok").alias("ok"), F.count_if(F.col("outcome") == "failed").alias("failed"),
        F.sum("published").alias("published"), F.sum("dropped").alias("dropped"),
        F.count_if(F.col("tier") == "httpx").alias("httpx"), F.count_if(F.col("tier") == "playwright").alias("playwright"),
    )


def delivery_stats(df: DataFrame, key: str) -> DataFrame:
    n = lambda s: F.count_if(F.col("outcome") == s)
    return df.groupBy(key).agg(*(n(s).alias(s) for s in ("sent", "skipped_low", "failed", "new", "dropped")))


def best_match(df: DataFrame) -> DataFrame:
    """The highest score of each person among notified rows; ties by key."""
    row = F.max_by(F.struct("key", "score"), F.struct("score", "key"))
    return df.filter("notified = 1").groupBy("person_id").agg(row.alias("r")).select("person_id", "r.*")


def latest(df: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """The last values of each key, by a partial maximum."""
    return df.groupBy(key).agg(F.max(F.struct(*order, *values)).alias("r")).select(key, *(f"r.{v}" for v in values))


def fetch_health(df: DataFrame, failures: int = 3, cooldown: int = 30, key: str = "company", at: str = "ts", tie: str = "event_id", rows: int = SLICE) -> DataFrame:
    """Adds streak (failures in a row so far), state_before and state at each outcome: open from ``failures`` on; half_open
    where the last failure of an open one lies more than ``cooldown`` seconds back; else closed. ``ok`` says whether the fetch
    went well.

    Where no company has more than ``rows`` outcomes, windows run over whole logs. Else logs are cut into slices of time of about
    ``rows`` outcomes. Windows run over one slice; what a slice leaves (its open streak, its last time) is one row, and a prefix
    over these rows gives what each slice begins with. So a company with a third of all rows is many slices. Outcomes of one
    instant are in one slice.
    """
    if longest_log(df, F.col(key)) <= rows:
        return _health_of_logs(df, failures, cooldown, key, at, tie)
    sliced = time_slices(df, F.col(key), F.unix_micros(at), rows)
    own = ["_key", "_slice"]
    w = W.partitionBy(*own).orderBy(at, tie)
    sliced = sliced.withColumns({"_island": F.sum(F.col("ok").cast("int")).over(w), "_gap": F.unix_micros(at) - F.unix_micros(F.lag(at).over(w))})
    inside = W.partitionBy(*own, "_island").orderBy(at, tie)
    sliced = sliced.withColumn("_local", F.sum((~F.col("ok")).cast("int")).over(inside))
    ends = sliced.groupBy(*own).agg(F.max_by("_local", F.struct(at, tie)).alias("left"), F.max(F.col("ok").cast("int")).alias("good"), F.max(F.unix_micros(at)).alias("until"))
    slices = W.partitionBy("_key").orderBy("_slice")  # a row a slice
    ends = ends.withColumn("island", F.sum("good").over(slices))
    ends = ends.withColumn("end", F.sum("left").over(W.partitionBy("_key", "island").orderBy("_slice")))
    starts = ends.select(*own, F.lag("end").over(slices).alias("_carried"), F.lag("until").over(slices).alias("_until"))
    out = sliced.join(starts, own)
    out = out.withColumn("streak", F.col("_local") + F.when(F.col("_island") == 0, F.coalesce("_carried", F.lit(0))).otherwise(0))
    before = F.coalesce(F.lag("streak").over(w), "_carried", F.lit(0))
    gap = F.coalesce("_gap", F.unix_micros(at) - F.col("_until"))
    state = F.when(~F.col("ok") & (F.col("streak") >= failures), "open").otherwise("closed")
    probed = F.when((before >= failures) & (gap > cooldown * 1_000_000), "half_open").when(before >= failures, "open").otherwise("closed")
    return out.withColumns({"state_before": probed, "state": state}).select(*df.columns, "streak", "state_before", "state")


def _health_of_logs(df: DataFrame, failures: int, cooldown: int, key: str, at: str, tie: str) -> DataFrame:
    """``fetch_health`` by windows over whole logs."""
    w = W.partitionBy(key).orderBy(at, tie)
    out = df.withColumn("_island", F.sum(F.col("ok").cast("int")).over(w))
    out = out.withColumn("streak", F.sum((~F.col("ok")).cast("int")).over(W.partitionBy(key, "_island").orderBy(at, tie)))
    before, gap = F.coalesce(F.lag("streak").over(w), F.lit(0)), F.unix_micros(F.col(at)) - F.unix_micros(F.lag(at).over(w))
    state = F.when(~F.col("ok") & (F.col("streak") >= failures), "open").otherwise("closed")
    probed = F.when((before >= failures) & (gap > cooldown * 1_000_000), "half_open").when(before >= failures, "open").otherwise("closed")
    return out.withColumns({"state_before": probed, "state": state}).drop("_island")


def recent(df: DataFrame, n: int, at: str = "first_seen_at") -> DataFrame:
    return df.orderBy(F.col(at).desc(), "key").limit(n)


def backfill(df: DataFrame, least: float, n: int) -> DataFrame:
    return df.filter((F.col("notified") == 0) & (F.col("score") >= least)).orderBy(F.col("score").desc(), F.col("first_seen_at").desc(), "key").limit(n)


def top_matches(df: DataFrame, least: float, n: int) -> DataFrame:
    return df.filter(F.col("score") >= least).orderBy(F.col("score").desc(), "person_id", "source_id").limit(n)


def top_companies(df: DataFrame, n: int = 25) -> DataFrame:
    return df.groupBy("company").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "company").limit(n)


def dedupe_companies(df: DataFrame, order: list[str], suffixes: list[str] = ()) -> DataFrame:
    """First row of each (lower-case name, ats, board); names with a marker suffix go."""
    for s in suffixes:
        df = df.filter(~F.col("name").endswith(s))
    w = W.partitionBy(F.lower("name"), "ats", F.coalesce("board_id", F.lit(""))).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def sort_companies(df: DataFrame) -> DataFrame:
    return df.orderBy("ats", "tier", F.lower("name"), "name")
