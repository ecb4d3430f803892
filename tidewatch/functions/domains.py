"""Host names out of free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.settings import DOMAIN_PATTERN, IPV4_PATTERN


def normalise_domain(value: Column) -> Column:
    """Lower-case host without scheme, user, port, path and leading www; null if no domain."""
    text = F.lower(F.trim(value))
    authority = F.regexp_extract(text, r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    from_url = F.regexp_replace(authority, r"^.*@", "")
    host = F.when(text.contains("://"), from_url).otherwise(F.substring_index(text, "/", 1))
    host = F.btrim(F.trim(host), F.lit("."))
    host = F.regexp_replace(host, r"^www\.", "")
    host = F.substring_index(host, ":", 1)
    return F.when(host.rlike(DOMAIN_PATTERN) & ~host.rlike(IPV4_PATTERN), host)


def suffixes(domain: Column) -> Column:
    """a.b.c -> [a.b.c, b.c, c]: turns "ends with" into equality."""
    parts = F.split(domain, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."),
    )
