"""Smaller functions on addresses, hosts, headers and geometry as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decoded_cfemail(code: Column) -> Column:
    """SF-12: an address that a content network hid as hex: the first byte is the key the others are XORed with.

    Null for null, odd lengths and other letters than hex digits."""
    byte = lambda i: F.conv(F.substring(code, i, 2), 16, 10).cast("int")
    letters = F.transform(F.sequence(F.lit(3), F.length(code) - 1, F.lit(2)), lambda i: F.char(byte(i).bitwiseXOR(byte(F.lit(1)))))
    return F.when(code.rlike("^(?:[0-9a-fA-F]{2}){2,}$"), F.array_join(letters, ""))


def accept_language(languages: Column, country: Column) -> Column:
    """SF-26: header value from languages in order of preference: the first with its country, then falling weights.

    Languages are lower case and count once; English is added at the end if it is not among them, and stands for an empty
    or null list. Weights fall by a tenth from 0.9 to 0.1."""
    told = F.array_distinct(F.transform(F.filter(languages, lambda x: F.trim(x) != ""), lambda x: F.lower(F.trim(x))))
    told = F.when(F.size(told) > 0, told).otherwise(F.array(F.lit("en")))
    all_ = F.when(F.array_contains(told, "en"), told).otherwise(F.concat(told, F.array(F.lit("en"))))
    weighed = F.transform(all_, lambda x, i: F.concat(x, F.lit(";q=0."), F.greatest(F.lit(9) - i, F.lit(1)).cast("string")))
    return F.concat_ws(",", F.array(F.concat(F.element_at(told, 1), F.lit("-"), F.upper(country))), weighed)


def is_public_address(ip: Column) -> Column:
    """FI-04: whether an IPv4 address can be reached from anywhere: no private, loop, link, shared, test or multicast range."""
    n = F.split(ip, r"\.")
    a, b, c = (F.try_element_at(n, F.lit(i)).cast("int") for i in (1, 2, 3))
    closed = (
        a.isin(0, 10, 127)
        | (a >= 224)
        | ((a == 100) & b.between(64, 127))
        | ((a == 169) & (b == 254))
        | ((a == 172) & b.between(16, 31))
        | ((a == 192) & ((b == 168) | ((b == 0) & c.isin(0, 2)) | ((b == 88) & (c == 99))))
        | ((a == 198) & (b.isin(18, 19) | ((b == 51) & (c == 100))))
        | ((a == 203) & (b == 0) & (c == 113))
    )
    valid = ip.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.|$)){4}$") & ~F.endswith(ip, F.lit("."))
    return F.when(ip.isNotNull(), valid & ~F.when(valid, closed).otherwise(F.lit(True)))


def tiles(south: Column, west: Column, north: Column, east: Column) -> Column:
    """SF-29: the four quarters of a bounding box."""
    y, x = (south + north) / 2, (west + east) / 2
    box = lambda s, w, n, e: F.struct(s.alias("south"), w.alias("west"), n.alias("north"), e.alias("east"))
    return F.array(box(south, west, y, x), box(south, x, y, east), box(y, west, north, x), box(y, x, north, east))


# Hosts of profiles.
PROFILES = {"facebook": r"facebook\.com", "instagram": r"instagram\.com", "linkedin": r"linkedin\.com", "x": r"(?:twitter|x)\.com", "youtube": r"youtube\.com", "xing": r"xing\.com", "tiktok": r"tiktok\.com", "github": r"github\.com"}


def profiles(html: Column) -> Column:
    """SF-25: map of platform to the distinct profile addresses that a page links, without sharing and log-in paths."""
    pairs = []
    for name, site in PROFILES.items():
        found = F.regexp_extract_all(html, F.lit(rf"""(?i)href=["'](?:https?:)?//(?:www\.|[a-z]{{2}}\.)?({site}/(?:in/|company/|user/|channel/|c/|@)?[A-Za-z0-9_.-]+)"""), F.lit(1))
        kept = F.filter(F.array_distinct(F.transform(found, lambda x: F.lower(x))), lambda x: ~x.rlike(r"/(?:share|sharer|sharer\.php|intent|login|signup|hashtag|search|home|watch|plugins|policy|privacy|about|legal|tr|dialog)(?:$|[/?.])"))
        pairs += [F.lit(name), kept]
    return F.map_filter(F.create_map(*pairs), lambda _, v: F.size(v) > 0)


def sitemap_locations(xml: Column, most: int = 1000) -> Column:
    """SC-16: locations of a sitemap in order (the limit is the protocol's own for one read)."""
    return F.slice(F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1)), 1, most)


def robots_allow(robots: Column, path: Column) -> Column:
    """SC-15: whether the rules for all agents allow a path: the longest matching prefix decides, allow wins ties.

    Null or empty rules allow everything."""
    text = F.coalesce(F.regexp_replace(robots, r"#[^\n]*", ""), F.lit(""))
    group = F.regexp_extract(F.concat(text, F.lit("\n")), r"(?is)user-agent:\s*\*\s*\n(.*?)(?:\n\s*user-agent:|\z)", 1)
    rules = lambda kind: F.regexp_extract_all(group, F.lit(rf"(?im)^\s*{kind}:[ \t]*(\S+)"), F.lit(1))
    longest = lambda kind: F.coalesce(F.array_max(F.transform(F.filter(rules(kind), lambda r: F.startswith(path, F.regexp_replace(r, r"\*?\$?$", ""))), lambda r: F.length(r))), F.lit(-1))
    return longest("allow") >= longest("disallow")


def luhn(number: Column) -> Column:
    """SF-18: whether the digits of a number satisfy the Luhn check; null stays null."""
    digits = F.transform(F.split(F.reverse(F.regexp_replace(number, r"\D", "")), ""), lambda d, i: F.when(d == "", 0).otherwise(F.try_to_number(d, F.lit("9")).cast("int") * (1 + i % 2)))
    total = F.aggregate(F.transform(digits, lambda x: F.when(x > 9, x - 9).otherwise(x)), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return F.when(number.isNotNull(), (F.length(F.regexp_replace(number, r"\D", "")) > 0) & (total % 10 == 0))
