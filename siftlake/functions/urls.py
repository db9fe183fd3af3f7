"""URL identity as column expressions: host, registered domain, canonical form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track the visitor, and second-level labels of country registries.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref")
SECOND_LEVEL = ("co", "ac", "gov", "nic", "edu", "org", "net", "res", "ernet", "com", "bank", "or")
COUNTRY_LABELS = ("in", "uk", "au", "ca", "nz", "za")

_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#@]*@)?([^/?#:]*)(:\d+)?([^?#]*)(?:\?([^#]*))?"


def host_of(url: Column) -> Column:
    """Lower-case host without a leading www.; empty where there is none, null for null."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.trim(url), _PARTS, 2)), r"^www\.", "")


def registered_domain(host: Column) -> Column:
    """The last two labels of a host, or three under a country's second-level label."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    three = F.try_element_at(labels, F.lit(-1)).isin(*COUNTRY_LABELS) & F.try_element_at(labels, F.lit(-2)).isin(*SECOND_LEVEL)
    keep = F.least(n, F.when(three, 3).otherwise(2))
    return F.when(host.isNull(), None).otherwise(F.array_join(F.slice(labels, F.greatest(n - keep + 1, F.lit(1)), F.greatest(keep, F.lit(1))), "."))


def canonical_url(url: Column) -> Column:
    """One form for all outward forms of an address: lower-case scheme and host, no www., fragment, tracking parameter or trailing slash.

    What has no scheme and host stays as it is, trimmed; null stays null.
    """
    u = F.trim(url)
    part = lambda i: F.regexp_extract(u, _PARTS, i)
    path = F.regexp_replace(part(4), r"/+$", "")
    kept = F.filter(F.split(part(5), "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    whole = F.concat(F.lower(part(1)), F.lit("://"), host_of(url), part(3), path, query)
    return F.when(u.rlike(_PARTS), whole).otherwise(u)
