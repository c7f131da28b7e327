"""Structured data of pages: organisations of JSON-LD blocks, results of search pages."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = re.compile(r"""(?is)<script\b[^>]*\btype\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script\s*>""")
WRAPPING = re.compile(r"(?s)^\s*(?:<!--|//\s*<!\[CDATA\[|<!\[CDATA\[)|(?:-->|//\s*\]\]>|\]\]>)\s*$")
# Types of organisations, beside those that end with Business or Organization.
ORGANISATIONS = frozenset(("Organization", "Corporation", "LocalBusiness", "ProfessionalService", "Store", "NGO"))
#: Blocks of a page and levels of a block that are read.
BLOCKS, DEPTH = 20, 6
TEXTS = ("name", "legal_name", "url", "vat_id", "tax_id", "street", "postal_code", "locality", "region", "country", "address_text")
ORG = T.StructType([T.StructField("types", T.ArrayType(T.StringType())), *[T.StructField(c, T.StringType()) for c in TEXTS], T.StructField("emails", T.ArrayType(T.StringType())), T.StructField("telephones", T.ArrayType(T.StringType()))])


def texts(value: object) -> list[str]:
    """Every text that a JSON value holds: itself, those of a list, the value or name of an object."""
    if isinstance(value, list):
        return [t for v in value for t in texts(v)]
    if isinstance(value, dict):
        return texts(next((value[k] for k in ("@value", "value", "name") if value.get(k)), None))
    text = "" if value is None else str(value).strip()
    return [text] if text else []


def one(value: object) -> str | None:
    return next(iter(texts(value)), None)


def without(prefix: str, values: list[str]) -> list[str]:
    return list(dict.fromkeys(v.removeprefix(prefix).strip() for v in values))


def types_of(node: dict) -> list[str]:
    """Types without vocabulary or address before their name."""
    return [re.split(r"[/:]", t)[-1] for t in texts(node.get("@type"))]


def organisation(node: dict, types: list[str]) -> dict:
    """One organisation with its contact points and its address, which may be a text, an object or a list of them."""
    points = node.get("contactPoint")
    points = [p for p in (points if isinstance(points, list) else [points]) if isinstance(p, dict)]
    sides = [node, *points]
    place = node.get("address")
    place = place[0] if isinstance(place, list) and place else place
    out = {"types": types, "name": one(node.get("name")), "legal_name": one(node.get("legalName")), "url": one(node.get("url")), "vat_id": one(node.get("vatID")), "tax_id": one(node.get("taxID"))}
    out["emails"] = without("mailto:", [e.lower() for s in sides for e in texts(s.get("email"))])
    out["telephones"] = without("tel:", [t for s in sides for t in texts(s.get("telephone"))])
    if isinstance(place, str):
        out["address_text"] = place.strip() or None
    elif isinstance(place, dict):
        street, code, town, region, country = (one(place.get(k)) for k in ("streetAddress", "postalCode", "addressLocality", "addressRegion", "addressCountry"))
        line = ", ".join(x for x in (street, " ".join(filter(None, (code, town))), country) if x)
        out |= {"street": street, "postal_code": code, "locality": town, "region": region, "country": country, "address_text": line or None}
    return {f.name: out.get(f.name) for f in ORG}


def organisations(page: str | None) -> list[dict]:
    """SF-24: the organisations of a page's blocks, in order of the walk: objects and lists to six levels, but for contexts,
    addresses and contact points; blocks that are no JSON are left out."""
    found: list[dict] = []
    for raw in BLOCK.findall(page or "")[:BLOCKS]:
        try:
            block = json.loads(WRAPPING.sub("", WRAPPING.sub("", raw.strip())).strip() or "null", strict=False)
        except (ValueError, RecursionError):
            continue
        stack = [(block, 0)]
        while stack:
            node, depth = stack.pop()
            if depth > DEPTH:
                continue
            if isinstance(node, list):
                stack += [(v, depth + 1) for v in reversed(node)]
            elif isinstance(node, dict):
                types = types_of(node)
                if any(t in ORGANISATIONS or t.endswith(("Business", "Organization")) for t in types):
                    found.append(organisation(node, types))
                below = [v for k, v in node.items() if k not in ("@context", "address", "contactPoint") and isinstance(v, dict | list)]
                stack += [(v, depth + 1) for v in reversed(below)]
    return found


@F.pandas_udf(T.ArrayType(ORG))
def page_organisations(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in pages:
        yield pd.Series([organisations(p) for p in batch], dtype="object")


def redirect_target(href: Column, parameter: str = "uddg") -> Column:
    """SC-10: where a result's link leads: the decoded parameter of a redirect, the link itself if it is a plain one, else null."""
    full = F.when(F.startswith(F.trim(href), F.lit("//")), F.concat(F.lit("https:"), F.trim(href))).otherwise(F.trim(href))
    query = F.regexp_extract(full, rf"[?&]{parameter}=([^&#]*)", 1)
    return F.when(full.rlike(r"^https?://[^/]+/l/\?") & (query != ""), F.try_url_decode(query)).when(full.rlike(r"(?i)^https?://[^/]+(?:/(?!l/\?)|$)"), full)


def json_results(body: Column) -> Column:
    """SC-10: array of (url, title, content) of a JSON answer of a search; empty for malformed ones."""
    parsed = F.from_json(body, "results array<struct<url: string, title: string, content: string>>")
    return F.filter(F.coalesce(parsed["results"], F.array().cast("array<struct<url: string, title: string, content: string>>")), lambda r: r["url"].rlike(r"(?i)^https?://"))


def html_results(page: Column) -> Column:
    """SC-10: array of (url, title) of a result page: links of class result__a outside of advertisements, in order."""
    organic = F.regexp_replace(page, r"""(?is)<div\b[^>]*\bresult--ad\b.*?(?=<div\b[^>]*\bclass="[^"]*\bresult(?:\s|")|\z)""", "")
    link = r"""(?is)<a\b(?=[^>]*\bclass="[^"]*\bresult__a\b)[^>]*\bhref="([^"]*)"[^>]*>(.*?)</a>"""
    pairs = F.arrays_zip(F.regexp_extract_all(organic, F.lit(link), F.lit(1)).alias("h"), F.regexp_extract_all(organic, F.lit(link), F.lit(2)).alias("t"))
    told = F.transform(pairs, lambda p: F.struct(redirect_target(F.replace(p["h"], F.lit("&amp;"), F.lit("&"))).alias("url"), F.trim(F.regexp_replace(F.regexp_replace(p["t"], r"<[^>]*>", " "), r"\s+", " ")).alias("title")))
    return F.filter(F.coalesce(told, F.array().cast("array<struct<url: string, title: string>>")), lambda r: r["url"].isNotNull())
