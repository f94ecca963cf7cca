"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import empty

# Beginnings of query parameters that carry no identity.
TRACKING = ["utm_", "gh_jid=", "gclid=", "fbclid="]


def resolve(raw: Column, base: Column) -> Column:
    """An absolute URL: as it is, scheme-relative, host-relative, or relative to the base's folder."""
    raw = F.trim(raw)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_replace(path, r"[^/]*$", "")
    page = F.regexp_replace(base, r"[?#].*$", "")
    return (
        F.when(raw.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), raw)
        .when(raw.startswith("//"), F.concat(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), raw))
        .when(raw.startswith("/"), F.concat(origin, raw))
        .when(raw.rlike(r"^[?]"), F.concat(page, raw))
        .when(raw.rlike(r"^#") | (raw == ""), base)
        .otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), raw))
    )


def canonical(raw: Column, base: Column) -> Column:
    """Resolves, drops the fragment and tracking parameters; empty stays empty."""
    url = F.regexp_replace(resolve(raw, base), r"#.*$", "")
    head = F.regexp_replace(url, r"\?.*$", "")
    query = F.when(F.contains(url, F.lit("?")), F.regexp_replace(url, r"^[^?]*\?", "")).otherwise("")

    def kept(pair: Column) -> Column:
        low = F.lower(pair)
        drop = F.lit(False)
        for t in TRACKING:
            drop = drop | low.startswith(t)
        return (pair != "") & ~drop

    query = F.array_join(F.filter(F.split(query, "&"), kept), "&")
    return F.when(empty(raw) == "", "").otherwise(F.concat(head, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))))


def stable_id(url: Column) -> Column:
    return F.substring(F.sha1(url), 1, 16)


def plain_domain(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"^www\.", "")


def host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def next_page(url: Column, strategy: Column, param: Column, start: Column) -> Column:
    """The next page's URL: the page parameter plus one, blank parameters dropped; null where there is no paging."""
    head = F.regexp_replace(url, r"[?#].*$", "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda x: x != "")
    name = lambda x: F.substring_index(x, "=", 1)
    value = lambda x: F.when(F.contains(x, F.lit("=")), F.regexp_replace(x, r"^[^=]*=", "")).otherwise("")
    current = F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter(pairs, lambda x: name(x) == param), value)), -1)
    n = F.coalesce(current.try_cast("int"), start) + 1
    had = F.exists(pairs, lambda x: name(x) == param)
    there = F.transform(pairs, lambda x: F.when(name(x) == param, F.concat(param, F.lit("="), n.cast("string"))).otherwise(x))
    out = F.when(had, F.array_distinct(there)).otherwise(F.concat(there, F.array(F.concat(param, F.lit("="), n.cast("string")))))
    out = F.filter(out, lambda x: value(x) != "")
    return F.when(strategy == "page-param", F.concat(head, F.lit("?"), F.array_join(out, "&")))
