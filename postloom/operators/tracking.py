"""Keyed upserts and status changes over tables, as rewrites of the affected rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import short_id

# Callback action -> status.
ACTIONS = {"applied": "APPLIED", "skip": "SKIPPED", "interview": "INTERVIEW", "offer": "OFFER", "rejected": "REJECTED", "save": "SAVED"}


def upsert(old: DataFrame, new: DataFrame, key: str = "dedup_id", preserve: tuple[str, ...] = ()) -> DataFrame:
    """New rows replace old ones of their key as a whole; columns in ``preserve`` keep the old value where there is one."""
    if preserve:
        was = old.select(key, *(F.col(c).alias(f"_{c}") for c in preserve))
        new = new.join(was, key, "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in preserve else F.col(c) for c in new.columns))
    return old.join(new.select(key), key, "left_anti").select(*new.columns).unionByName(new)


def update_columns(old: DataFrame, changes: DataFrame, columns: tuple[str, ...], key: str = "key") -> DataFrame:
    """Changed columns of known keys: what is not null overwrites, null keeps."""
    new = changes.select(key, *(F.col(c).alias(f"_n_{c}") for c in columns))
    return old.join(new, key, "left").select(*(F.coalesce(f"_n_{c}", c).alias(c) if c in columns else F.col(c) for c in old.columns))


def mark_notified(seen: DataFrame, keys: DataFrame) -> DataFrame:
    return update_columns(seen, keys.select("key", F.lit(1).alias("notified")).distinct(), ("notified",))


def parse_callbacks(df: DataFrame, actions: dict[str, str] = ACTIONS) -> DataFrame:
    """(data, ts) -> short_id, status, ts; unknown actions and malformed ids are dropped."""
    action = F.substring_index("data", ":", 1)
    sid = F.expr("substring(data, instr(data, ':') + 1)")  # all behind the first colon
    status = F.element_at(F.create_map(*(F.lit(x) for kv in actions.items() for x in kv)), action)
    return df.select(sid.alias("short_id"), status.alias("status"), "ts").filter((F.length("short_id") == 16) & F.col("status").isNotNull())


def apply_status(seen: DataFrame, callbacks: DataFrame) -> DataFrame:
    """The last status of each short id, written with its time; unknown ids are ignored."""
    last = callbacks.groupBy("short_id").agg(F.max(F.struct("ts", "status")).alias("c"))
    last = last.select("short_id", F.col("c.status").alias("status"), F.col("c.ts").alias("status_updated_at"))
    keyed = seen.withColumn("short_id", short_id(F.col("key")))
    return update_columns(keyed, last, ("status", "status_updated_at"), "short_id").select(*seen.columns)
