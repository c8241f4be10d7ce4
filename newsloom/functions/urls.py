"""URL functions as column expressions over absolute URLs, and an Arrow UDF that resolves any URL."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from newsloom.functions.fixed import AGGREGATOR_HOSTS, TRACKING
from newsloom.functions.text import let, trim

_URL = r"(?is)^(https?)://([^/?#]+)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _query_kept(query: Column) -> Column:
    pairs = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"(?i)^(?:{TRACKING})(?:=|$)") & ~p.rlike("(?i)^utm_[^=]+="))
    return F.array_join(pairs, "&")


def _assembled(url: Column, strip: bool) -> Column:
    host = F.lower(F.regexp_extract(url, _URL, 2))
    path = F.regexp_extract(url, _URL, 3)
    path = F.when(path == "", "/").otherwise(path)
    if strip:
        path = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))
        path = F.when(path == "", "/").otherwise(path)
    query = _query_kept(F.regexp_extract(url, _URL, 4))
    return F.concat(F.lit("https://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def canonical_url(url: Column) -> Column:
    """https only: lower-case host, no fragment, tracking keys or last slashes; null otherwise."""
    text = trim(url)
    return F.when(F.lower(F.regexp_extract(text, _URL, 1)) == "https", _assembled(text, strip=True))


def repaired_url(url: Column) -> Column:
    """Wrapping marks removed, http and scheme-less URLs as https, no fragment or tracking keys."""
    text = F.regexp_replace(trim(url), "^[`\"'(<{\\[]+", "")
    text = F.regexp_replace(text, "[`\"'.,;:!?\\[\\]})>]+$", "")
    text = let(text, lambda t: F.when(t.startswith("//"), F.concat(F.lit("https:"), t)).otherwise(t))
    return let(text, lambda t: F.when(t.rlike(_URL), _assembled(t, strip=False)))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _URL, 2))


def url_authority(url: Column, primary: Column) -> Column:
    """4 for primary sources, 0 for aggregators, 1 for social hosts, else 2; -1 if it is no URL."""
    at = host(url)
    return (
        F.when(F.coalesce(at, F.lit("")) == "", -1)
        .when(primary, 4)
        .when(at.isin(*AGGREGATOR_HOSTS), 0)
        .when(at.isin("x.com", "twitter.com") | at.endswith("reddit.com"), 1)
        .otherwise(2)
    )


def display_source(label: Column, url: Column) -> Column:
    """@handle for profile URLs of the social hosts, else the label."""
    handle = F.regexp_extract(url, r"(?i)^https?://(?:www\.)?(?:x\.com|twitter\.com)/+([^/?#]+)", 1)
    return F.when((handle != "") & (handle != "i"), F.concat(F.lit("@"), handle)).otherwise(label)


def is_https(url: Column) -> Column:
    return F.coalesce(url.rlike(r"(?i)^https://[^\s]+$") & F.try_parse_url(url, F.lit("HOST")).isNotNull(), F.lit(False))


def resolve(url: str | None, base: str | None, strip: bool = True, upgrade: bool = False) -> str | None:
    """A URL resolved against a base, then cleaned as the column expressions do."""
    try:
        parts = urlsplit(urljoin(base or "", (url or "").strip()))
    except ValueError:
        return None
    scheme = "https" if upgrade and parts.scheme == "http" else parts.scheme
    if scheme != "https" or not parts.netloc:
        return None
    path = parts.path or "/"
    if strip and path != "/":
        path = path.rstrip("/") or "/"
    query = parts.query
    pairs = parse_qsl(query, keep_blank_values=True)
    kept = [(k, v) for k, v in pairs if not re.fullmatch(TRACKING, k, re.I)]
    if len(kept) < len(pairs):
        query = urlencode(kept)
    return urlunsplit((scheme, parts.netloc.lower(), path, query, ""))


@F.pandas_udf(StringType())
def resolved_url(url: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([resolve(u, b) for u, b in zip(url, base, strict=True)], dtype=object)
