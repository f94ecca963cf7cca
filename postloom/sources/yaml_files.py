"""Registries, profiles and targets from YAML files, read by tasks: Spark's own reader brings the files, whatever their store.

A file is a list of entries, such a list under one name (``companies:``), or one entry. Each entry is a row; a file that can't be
read, or an entry that is no mapping, is a row with an error instead. PyYAML must be installed where this is used.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import non_empty
from .tables import company_registry, load_targets, resolve_config

ROWS = "path string, place int, single boolean, value string, error string"

# The fields of an entry.
COMPANY = """name string, domain string, ats string, board_id string, career_url string, visa_transfers_h1b boolean, sponsors_new_h1b boolean,
tier int, verified boolean, active boolean, keywords_include array<string>, keywords_exclude array<string>, workday_tenant string, workday_board string,
workday_location_ids array<string>, custom_module string, custom_params map<string,string>,
workday struct<tenant: string, board: string, location_ids: array<string>>, custom struct<scraper_module: string, params: map<string,string>>"""
TARGET = "name string, url string, js_required boolean, pagination string, max_pages int, page_param string, page_start int, next_selector string, extra_headers map<string,string>"


def _entries(data: bytes, wrapper: str) -> tuple[list, bool]:
    import yaml

    found = yaml.safe_load(data)
    if isinstance(found, dict) and wrapper in found:
        found = found[wrapper] or []
    elif isinstance(found, dict):
        return [found], True
    if not isinstance(found, list):
        raise ValueError(f"neither a list nor a mapping: {type(found).__name__}")
    return found, False


def _plain(entry: dict) -> str:
    """As JSON; of free parameters only those that are text stay."""
    custom = entry.get("custom")
    if isinstance(custom, dict) and isinstance(custom.get("params"), dict):
        entry = entry | {"custom": custom | {"params": {k: v for k, v in custom["params"].items() if isinstance(v, str)}}}
    return json.dumps(entry, default=str)


def read_yaml(spark: SparkSession, path: str, wrapper: str, pattern: str = "*.yaml") -> DataFrame:
    """path, place, single (the file is one entry), value (JSON) and error of each entry below ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    entries, single = _entries(data, wrapper)
                except ImportError:
                    raise
                except Exception as e:  # whatever the parser makes of a damaged file
                    rows.append((name, 0, False, None, str(e).split("\n")[0][:200]))
                    continue
                for k, x in enumerate(entries):
                    rows.append((name, k, single, _plain(x), None) if isinstance(x, dict) else (name, k, single, None, f"no mapping: {x!r:.100}"))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, (pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.string()))], names=["path", "place", "single", "value", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, ROWS)


def _typed(rows: DataFrame, schema: str) -> DataFrame:
    return rows.filter("error is null").select("path", "place", "single", F.from_json("value", schema).alias("e")).select("path", "place", "single", "e.*")


def read_companies(spark: SparkSession, path: str) -> DataFrame:
    """Companies of registry files, and of files of one company each: the latter only where they are active; they count as checked
    and of tier 2. A flat module wins over a nested one, nested tenants and boards over flat ones."""
    rows = _typed(read_yaml(spark, path, "companies"), COMPANY)
    rows = rows.filter(~F.col("single") | F.coalesce("active", F.lit(False)))
    rows = rows.withColumns({
        "tier": F.when(F.col("single"), 2).otherwise(F.col("tier")), "verified": F.when(F.col("single"), True).otherwise(F.coalesce("verified", F.lit(False))),
        "custom": F.when(non_empty(F.col("custom_module")).isNull(), F.col("custom")), "active": F.lit(True),
    })
    return resolve_config(company_registry(rows)).drop("path", "place", "single")


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """Targets of HTML pages; of a name that is listed twice the last entry (by file, then place) counts."""
    rows = _typed(read_yaml(spark, path, "targets"), TARGET).drop("single")
    return load_targets(rows.withColumn("place", F.struct("path", "place")).drop("path"))


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """person_id (the folder), profile (JSON) and skills of ``<path>/<person>/profile.yaml``; a ``skills.yaml`` beside it with
    skills wins over the profile's own."""
    rows = read_yaml(spark, path, "profiles").filter("error is null")
    rows = rows.select(F.element_at(F.split("path", "/"), -2).alias("person_id"), F.element_at(F.split("path", "/"), -1).alias("file"), "value")
    rows = rows.withColumn("skills", F.from_json("value", "skills array<string>")["skills"])
    own = rows.filter("file = 'profile.yaml'").select("person_id", F.col("value").alias("profile"), F.col("skills").alias("_own"))
    beside = rows.filter("file = 'skills.yaml'").select("person_id", F.col("skills").alias("_beside"))
    none = F.array().cast("array<string>")
    return own.join(beside, "person_id", "left").select("person_id", "profile", F.coalesce("_beside", "_own", none).alias("skills"))
