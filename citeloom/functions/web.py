"""Column expressions for hosts and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """Lower-case host without ``www.``; null where the address has none."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.regexp_replace(host, r"^www\.", "")


def host_matches(host: Column, domain: Column) -> Column:
    """Equal, or a subdomain."""
    return (host == domain) | F.endswith(host, F.concat(F.lit("."), domain))


def host_suffixes(host: Column) -> Column:
    """The host and each domain above it: turns a subdomain match into an equi-join."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def is_safe_url(url: Column) -> Column:
    return F.coalesce(url.rlike(r"(?i)^https?://[^/]+"), F.lit(False))
