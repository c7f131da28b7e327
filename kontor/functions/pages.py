"""HTML functions as Spark expressions; they read well-formed markup and never fail on other."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def page_text(html: Column) -> Column:
    """Text of a page without scripts, styles, comments and templates: one line for each block, blanks collapsed."""
    t = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|noscript|template|svg|head)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"[\r\n\t ]+", " ")
    t = F.regexp_replace(t, r"(?i)</?(?:p|br|div|li|ul|ol|h[1-6]|tr|td|th|table|nav|footer|header|section|article|form|body|title|pre)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(t, r" *\n[ \n]*", "\n"), F.lit("\n "))


def html_lang(html: Column) -> Column:
    """Primary language of the html tag, lower case; null without one."""
    lang = F.lower(F.regexp_extract(html, r"""(?i)<html\b[^>]*\blang=["']?([A-Za-z]{2,3})""", 1))
    return F.when(lang != "", lang)


def title(html: Column) -> Column:
    t = F.trim(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title", 1))
    return F.when(t != "", F.replace(t, F.lit("&amp;"), F.lit("&")))


def links(html: Column) -> Column:
    """Array of (href, label) in document order."""
    hrefs = F.regexp_extract_all(html, F.lit(r'(?is)<a\b[^>]*\bhref="([^"]*)"[^>]*>.*?</a>'), F.lit(1))
    labels = F.regexp_extract_all(html, F.lit(r'(?is)<a\b[^>]*\bhref="[^"]*"[^>]*>(.*?)</a>'), F.lit(1))
    return F.arrays_zip(hrefs.alias("href"), labels.alias("label"))


def json_ld(html: Column) -> Column:
    """Array of the JSON-LD blocks of a page, as strings."""
    return F.regexp_extract_all(html, F.lit(r'(?is)<script type="application/ld\+json">(.*?)</script>'), F.lit(1))
