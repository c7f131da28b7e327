"""URL and host functions as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Second-level suffixes under which names are registered.
SECOND_LEVEL = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "com.br", "co.jp", "co.nz", "co.za", "com.tr", "co.in", "co.at", "or.at")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def host(url: Column | str) -> Column:
    """Host of a URL or bare host as typed, lower case, without port; null if there is none."""
    h = F.regexp_extract(F.lower(F.trim(col(url))), r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/@?#]*@)?([a-z0-9](?:[a-z0-9.-]*[a-z0-9])?)(?::\d+)?(?:[/?#].*)?$", 1)
    return F.when(F.contains(h, F.lit(".")), h)


def registered_domain(url: Column | str) -> Column:
    """The registered name of a URL's host: its last two labels, three under a known second-level suffix; null for addresses."""
    h = host(url)
    second = F.substring_index(h, ".", -2).isin(*SECOND_LEVEL)
    labels = F.size(F.split(h, r"\."))
    name = F.when(second & (labels >= 3), F.substring_index(h, ".", -3)).when(~second & (labels >= 2), F.substring_index(h, ".", -2))
    return F.when(~h.rlike(r"^[0-9.]+$"), name)


def normal_website(raw: Column | str) -> Column:
    """A website as typed in one form: first of several, https by default, no fragment, no tracking parameters, a path.

    Null for blanks, other schemes than http and https, hosts without a dot and bare numbers."""
    first = F.regexp_extract(F.trim(col(raw)), r"^([^;\s]+)", 1)
    scheme = F.when(first.rlike(r"(?i)^http://"), "http").when(first.rlike(r"(?i)^https://"), "https").when(~first.rlike(r"(?i)^[a-z][a-z0-9+.-]*:(?!\d)"), "https")
    rest = F.regexp_replace(F.regexp_replace(first, r"(?i)^https?://", ""), r"#.*$", "")
    h = host(first)
    path = F.regexp_replace(rest, r"^[^/?]*", "")
    path = F.regexp_replace(path, r"(?i)([?&])(?:utm_[a-z]+|gclid|fbclid|mc_[a-z]+)=[^&]*", "$1")
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"[&]{2,}", "&"), r"\?&", "?"), r"[?&]+$", "")
    path = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))
    return F.when(scheme.isNotNull() & h.isNotNull() & ~h.rlike(r"^[0-9.]+$"), F.concat(scheme, F.lit("://"), h, path))


def flipped_www(h: Column | str) -> Column:
    """The host with its www removed, or with one if it had none."""
    h = col(h)
    return F.when(F.startswith(h, F.lit("www.")), F.regexp_replace(h, r"^www\.", "")).otherwise(F.concat(F.lit("www."), h))


def top_label(h: Column | str) -> Column:
    """Last label of a host."""
    return F.substring_index(col(h), ".", -1)
