"""URLs and hosts, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Second-level labels below which a country code has sites.
SECOND_LEVEL = "^(com|co|org|net|gov|ac|edu|or|ne)\\.[a-z]{2}$"


def host_of(url: Column) -> Column:
    """Host name in lower case without user and port, or null."""
    return F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def scheme_of(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1), F.lit("")))


def site_of(host: Column) -> Column:
    """The last two labels of a host, three where the last two are shared by sites."""
    clean = F.regexp_replace(F.lower(host), "^www\\.", "")
    parts = F.split(clean, "\\.")
    two = F.array_join(F.slice(parts, -2, 2), ".")
    return F.when(F.size(parts) <= 2, clean).when(two.rlike(SECOND_LEVEL), F.array_join(F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), 3), ".")).otherwise(two)


def third_party(url: Column, page: Column) -> Column:
    """Whether a request leaves the page's site: never for other schemes, always from an unknown page."""
    web = scheme_of(url).isin("http", "https") & host_of(url).isNotNull()
    return F.coalesce(web, F.lit(False)) & F.coalesce(site_of(host_of(url)) != site_of(host_of(page)), F.lit(True))


def sanitized(url: Column) -> Column:
    """Origin and path of web addresses; scheme and host of others; else what stands before ? or #."""
    origin = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    return (
        F.when(F.coalesce(url, F.lit("")) == "", "")
        .when(scheme_of(url).isin("http", "https"), F.concat(origin, F.when(path == "", "/").otherwise(path)))
        .when(scheme_of(url).isNotNull(), origin)
        .otherwise(F.regexp_extract(url, "^([^?#]*)", 1))
    )


def normal_host(host: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(host)), "^www\\.", "")
