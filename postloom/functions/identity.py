"""Identity of postings and companies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import empty


def posting_key(company: Column, source_id: Column) -> Column:
    """The permanent key: SHA-256 of lower-case company, a bar, and the source's id."""
    return F.sha2(F.concat(F.lower(empty(company)), F.lit("|"), empty(source_id)), 256)


def short_id(key: Column) -> Column:
    return F.substring(key, 1, 16)


def ttl_key(source: Column, source_id: Column) -> Column:
    return F.concat(F.lit("job:"), empty(source), F.lit(":"), empty(source_id))
