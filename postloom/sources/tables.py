"""Tables and topics: registries, line files, streams, reports."""

from __future__ import annotations

import re
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions.text import empty, non_empty
from ..operators.filters import conform
from . import reports
from . import schemas as S

TOPIC_LIMIT = 512 * 1024  # bytes of a message
RETENTION_DAYS = 7
TOPIC_FILES = 8  # of a day that one write adds, at most


def company_registry(raw: DataFrame) -> DataFrame:
    """Companies, wrapped in a ``companies`` array or flat; tier 0 counts as 2, an unknown vendor as ``unknown``."""
    if "companies" in raw.columns:
        raw = raw.select(F.explode("companies").alias("c")).select("c.*")
    ats = F.lower(F.trim(empty(F.col("ats"))))
    return raw.withColumns({"tier": F.when(F.coalesce("tier", F.lit(0)) == 0, 2).otherwise(F.col("tier")), "ats": F.when(ats.isin(vocab.ATS_KINDS), ats).otherwise("unknown")})


def resolve_config(raw: DataFrame) -> DataFrame:
    """Active companies with nested ``workday`` and ``custom`` settings put over the flat ones; a module is the last part of a
    dotted name; only parameters with a value stay."""
    c = raw.columns
    out = raw.filter(F.coalesce("active", F.lit(True))) if "active" in c else raw
    over = {}
    if "workday" in c:
        for nested, flat in (("tenant", "workday_tenant"), ("board", "workday_board")):
            over[flat] = F.coalesce(non_empty(F.col(f"workday.{nested}")), F.col(flat)) if flat in c else non_empty(F.col(f"workday.{nested}"))
    if "custom" in c:
        module = F.coalesce(non_empty(F.col("custom.scraper_module")), F.col("custom_module") if "custom_module" in c else F.lit(None))
        over["custom_module"] = F.element_at(F.split(module, r"\."), -1)
        params = F.coalesce("custom.params", F.col("custom_params") if "custom_params" in c else F.lit(None).cast("map<string,string>"))
        over["custom_params"] = F.map_filter(params, lambda k, v: v.isNotNull())
    return out.withColumns(over).drop("workday", "custom", "active") if over else out


def load_targets(raw: DataFrame) -> DataFrame:
    """Targets with a name; the last row of a name (by ``place``) wins."""
    rows = raw.filter(empty(F.col("name")) != "")
    rest = [c for c in rows.columns if c not in ("name", "place")]
    return rows.groupBy("name").agg(F.max_by(F.struct(*rest), "place").alias("r")).select("name", "r.*")


def read_postings_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """Postings of a line file: lines that start an object, are readable, and have a title and company."""
    lines = spark.read.text(path).filter(F.col("value").startswith("{"))
    rows = lines.select(F.from_json("value", S.POSTING).alias("p")).select("p.*")
    return rows.filter("title is not null and company is not null")


def write_postings_ndjson(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def topic_rows(df: DataFrame, schema: str, as_of=None, at: str | None = None) -> DataFrame:
    """Messages (value) of a topic as rows: too large or unreadable ones are dropped, and, given ``as_of``, those older than
    the retention. Works on a stream as on a table."""
    rows = df.filter(F.octet_length("value") <= TOPIC_LIMIT).select(F.from_json("value", schema).alias("m")).filter("m is not null").select("m.*")
    rows = rows.dropna(how="all")
    return rows.filter(F.col(at) >= as_of - F.expr(f"interval {RETENTION_DAYS} days")) if as_of is not None and at else rows


def topic_messages(df: DataFrame) -> DataFrame:
    """Rows as messages; those over the limit are dropped."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value")).filter(F.octet_length("value") <= TOPIC_LIMIT)


def read_topic(spark: SparkSession, path: str, schema: str, as_of=None, at: str | None = None, files: int | None = None, clean: str | None = None) -> DataFrame:
    """A topic kept as a folder of text files, as a stream. ``as_of`` and ``at`` (the column of a message's time): messages older
    than the retention at that time are dropped, in the stream. ``files`` bounds what a batch takes. ``clean``: a folder that
    files go to once a later batch is done with them, or ``delete``."""
    source = spark.readStream.option("recursiveFileLookup", "true")
    if files:
        source = source.option("maxFilesPerTrigger", files)
    if clean:
        source = source.option("cleanSource", "delete") if clean == "delete" else source.option("cleanSource", "archive").option("sourceArchiveDir", clean)
    return topic_rows(source.text(path), schema, as_of, at)


def write_topic(df: DataFrame, path: str, at: str | None = None) -> None:
    """Appends messages; ``at``: into a folder for each day of that column, which ``expire_topic`` can drop."""
    if at is None:
        topic_messages(df).write.mode("append").text(path)
        return
    day = F.coalesce(F.date_format(F.col(at), "yyyy-MM-dd"), F.lit("none"))
    rows = df.select(day.alias("day"), F.to_json(F.struct(*df.columns)).alias("value")).filter(F.octet_length("value") <= TOPIC_LIMIT)
    rows.repartition("day", F.pmod(F.xxhash64("value"), F.lit(TOPIC_FILES))).write.mode("append").partitionBy("day").text(path)


def expire_topic(spark: SparkSession, path: str, as_of: date) -> list[str]:
    """Deletes the folders of days that lie whole before the retention; returns the days."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    first = (as_of - timedelta(days=RETENTION_DAYS)).isoformat()
    gone = []
    for x in fs.listStatus(root) if fs.exists(root) else []:
        name = x.getPath().getName()
        if re.fullmatch(r"day=\d{4}-\d{2}-\d{2}", name) and name.removeprefix("day=") < first:
            fs.delete(x.getPath(), True)
            gone.append(name.removeprefix("day="))
    return sorted(gone)


def read_applications(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    from pyspark.sql.types import StructType

    return conform(df, StructType.fromDDL(schema)) if schema else df


def report_documents(df: DataFrame, dedup_id: str = "dedup_id", text: str = "report") -> DataFrame:
    """One document a key with its canonical path."""
    return df.select(dedup_id, F.concat(F.lit("local:"), F.col(dedup_id), F.lit("/report.md")).alias("path"), F.col(text).alias("report"))


def write_reports(df: DataFrame, root: str, dedup_id: str = "dedup_id", text: str = "report") -> None:
    """Each report as the file ``<root>/<dedup_id>/report.md``, all of them or, where the job fails, none (see ``reports.py``).
    ``root`` may be on any file system that Arrow opens; without a scheme it is on the session's default one."""
    reports.write(df.select(F.col(dedup_id).cast("string").alias("id"), F.col(text).cast("string").alias("text")), root)


def read_reports(spark: SparkSession, root: str) -> DataFrame:
    """dedup_id, path and report of what ``write_reports`` wrote; an empty report is no row."""
    return reports.read(spark, root).select(F.col("id").alias("dedup_id"), F.concat(F.lit("local:"), "id", F.lit("/report.md")).alias("path"), F.col("content").cast("string").alias("report"))
