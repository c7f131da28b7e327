"""Queries on pages and texts: text of pages, links, addresses, numbers, language, JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kontor.functions import pages as P
from kontor.functions.text import folded
from kontor.sources.tables import table

MAIL = r"[a-zA-Z0-9][a-zA-Z0-9._+-]*@[a-zA-Z0-9][a-zA-Z0-9.-]*\.[a-zA-Z]{2,}"
# Mailboxes of a function rather than a person.
ROLES = ("info", "kontakt", "contact", "office", "mail", "post", "buero", "hallo", "team", "service", "verkauf", "vertrieb", "anfrage", "zentrale", "sales")
# Wording that objects to advertising, by language.
OBJECTIONS = (
    ("de", r"(?i)widersprechen der (?:nutzung|zusendung)[^.\n]{0,60}werbung"),
    ("en", r"(?i)don't sign us up|no unsolicited (?:mail|advertising)"),
    ("fr", r"(?i)aucune publicit[ée] non demand[ée]e"),
    ("es", r"(?i)rogamos no enviar publicidad"),
)
KEYWORDS = ("ventile", "regale", "trolleys", "convoyeurs", "bastidores", "bad")


def page_texts(spark: SparkSession, d: str) -> DataFrame:
    """SF-10: length and number of lines of the text of each page."""
    p = table(spark, d, "site_pages").select("page_id", P.page_text(F.col("html")).alias("t"))
    return p.select("page_id", F.length("t").alias("chars"), F.when(F.col("t").isNotNull(), F.size(F.split("t", "\n"))).alias("lines"))


def page_languages(spark: SparkSession, d: str) -> DataFrame:
    """SF-27: language of each page's html tag."""
    return table(spark, d, "site_pages").select("page_id", P.html_lang(F.col("html")).alias("lang"))


def page_titles(spark: SparkSession, d: str) -> DataFrame:
    """PR-07: title of each page."""
    return table(spark, d, "site_pages").select("page_id", P.title(F.col("html")).alias("title"))


def contact_links(spark: SparkSession, d: str) -> DataFrame:
    """WI-08: links of each domain ranked: a legal or contact path first, then by how many pages hold them."""
    l = table(spark, d, "site_pages").select("domain", "page_id", F.explode(P.links(F.col("html"))).alias("l")).select("domain", "page_id", F.col("l.href").alias("href"))
    l = l.where("href like '/%'").groupBy("domain", "href").agg(F.count_distinct("page_id").alias("pages"))
    rank = F.when(F.col("href").rlike(r"(?i)^/(?:impressum|legal|mentions-legales|aviso-legal)$"), 0).when(F.col("href").rlike(r"(?i)kontakt|contact"), 1).otherwise(2)
    return l.select("domain", "href", "pages", rank.alias("rank"))


def json_ld_blocks(spark: SparkSession, d: str) -> DataFrame:
    """SF-24: organisations of the JSON-LD blocks of pages; blocks that are no JSON give nulls."""
    b = table(spark, d, "site_pages").select("page_id", F.posexplode(P.json_ld(F.col("html"))).alias("pos", "block"))
    return b.select("page_id", "pos", F.get_json_object("block", "$.name").alias("name"), F.regexp_replace(F.get_json_object("block", "$.email"), "^mailto:", "").alias("email"))


def markup_emails(spark: SparkSession, d: str) -> DataFrame:
    """SF-12, plain part: distinct addresses of each page's markup, lower case."""
    p = table(spark, d, "site_pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(f"({MAIL})"), F.lit(1))).alias("email"))
    return p.select("page_id", F.lower("email").alias("email")).distinct()


def document_emails(spark: SparkSession, d: str) -> DataFrame:
    """SF-12: addresses in texts by host, with whether they are of a function (FI-06)."""
    p = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"({MAIL})"), F.lit(1))).alias("email")).select("doc_id", F.lower("email").alias("email")).distinct()
    local = F.substring_index("email", "@", 1)
    return p.select("doc_id", "email", F.substring_index(F.substring_index(F.substring_index(local, "+", 1), "-", 1), ".", 1).isin(*ROLES).alias("role"))


def objections(spark: SparkSession, d: str) -> DataFrame:
    """FI-08: texts that object to advertising, whatever their language, with the pattern's language."""
    t = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", r"\s+", " ").alias("text"))
    lang = F.coalesce(*[F.when(F.col("text").rlike(p), F.lit(k)) for k, p in OBJECTIONS])
    return t.select("doc_id", lang.alias("objects")).where("objects is not null")


def keyword_hits(spark: SparkSession, d: str) -> DataFrame:
    """FI-09: keywords in texts without case and accents: short ones as whole words, long ones anywhere."""
    text = F.concat(F.lit(" "), F.regexp_replace(folded("text"), "[^a-z0-9]+", " "), F.lit(" "))
    t = table(spark, d, "documents").where("text is not null").select("doc_id", text.alias("text"))
    hits = F.array_compact(F.array(*[F.when(F.contains("text", F.lit(f" {k} " if len(k) < 8 else k)), F.lit(k)) for k in KEYWORDS]))
    return t.select("doc_id", F.explode(hits).alias("keyword"))


def vat_numbers(spark: SparkSession, d: str) -> DataFrame:
    """SF-19: VAT numbers in texts with a country prefix."""
    return table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b((?:DE|AT|FR|GB|ES)[0-9]{9})\b"), F.lit(1)))).alias("vat"))


def register_numbers(spark: SparkSession, d: str) -> DataFrame:
    """SF-18: German register numbers with their court."""
    r = r"Registergericht ([^,\n]+), (HR[AB] [0-9]+)"
    return table(spark, d, "documents").select("doc_id", F.regexp_extract("text", r, 1).alias("court"), F.regexp_extract("text", r, 2).alias("number")).where("number <> ''")


def phone_numbers(spark: SparkSession, d: str) -> DataFrame:
    """SF-14: phone hints of entries in international form; German and French national numbers get their prefix."""
    e = table(spark, d, "dedup_entries").select("entry_id", F.col("candidate.hints")["phone"].alias("raw"), F.col("slice.country_code").alias("cc")).where("raw is not null")
    digits = F.regexp_replace(F.regexp_replace("raw", r"\(0\)", ""), r"[^0-9+]", "")
    digits = F.regexp_replace(digits, r"^00", "+")
    prefix = F.create_map(*[F.lit(x) for x in ("DE", "+49", "AT", "+43", "FR", "+33", "GB", "+44")])
    return e.select("entry_id", F.when(F.startswith(digits, F.lit("+")), digits).when(F.startswith(digits, F.lit("0")), F.concat(prefix[F.col("cc")], F.regexp_replace(digits, "^0", ""))).alias("phone"))


def app_shells(spark: SparkSession, d: str) -> DataFrame:
    """FI-13: pages with a root element and scripts but next to no text."""
    p = table(spark, d, "site_pages").where("html is not null").select("page_id", "html", F.length(P.page_text(F.col("html"))).alias("chars"))
    return p.where((F.col("chars") < 80) & F.col("html").rlike(r"""<div id="(?:root|app|__next)">""") & F.contains("html", F.lit("<script"))).select("page_id", "chars")


def organisation_types(spark: SparkSession, d: str) -> DataFrame:
    """FI-14: blocks with a type of organisation, by type."""
    o = table(spark, d, "jsonld_orgs").select("org_id", F.explode("types").alias("type"))
    return o.where(F.col("type").isin("Organization", "Corporation") | F.col("type").rlike("(?:Business|Organization)$")).groupBy("type").agg(F.count_distinct("org_id").alias("blocks"))


def street_lines(spark: SparkSession, d: str) -> DataFrame:
    """FI-15: addresses that may name a street: up to ninety characters, a digit and a word of three letters."""
    a = table(spark, d, "address_results").select("addr_id", F.trim(F.regexp_replace("address", r"\s+", " ")).alias("line"))
    return a.where((F.length("line") <= 90) & F.col("line").rlike("[0-9]") & F.col("line").rlike(r"[A-Za-z]{3}") & ~F.col("line").rlike(r"(?i)tel\.|fax|@"))


def request_hashes(spark: SparkSession, d: str) -> DataFrame:
    """SF-28, ST-03: equal requests by the hash of their typed inputs, with the first of each."""
    r = table(spark, d, "scrape_resolve")
    body = F.to_json(F.struct(F.col("resolved.country.input").alias("country"), F.col("resolved.regions.input").alias("regions"), F.col("resolved.industries.input").alias("industries")), {"ignoreNullFields": "false"})
    return r.groupBy(F.sha2(body, 256).alias("hash")).agg(F.min("job_id").alias("job_id"), F.count(F.lit(1)).alias("requests"))


def props_json(spark: SparkSession, d: str) -> DataFrame:
    """SF-24 (plain): sums of the number in the JSON of events, by type."""
    e = table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return e.groupBy("event_type").agg(F.sum("k").alias("k"), F.count("k").alias("told"))


def bounding_boxes(spark: SparkSession, d: str) -> DataFrame:
    """SF-29: bounding box of each area's elements and its size in kilometres."""
    e = table(spark, d, "poi_elements").select("area_id", F.coalesce("lat", "center.lat").alias("lat"), F.coalesce("lon", "center.lon").alias("lon"))
    b = e.groupBy("area_id").agg(F.min("lat").alias("south"), F.min("lon").alias("west"), F.max("lat").alias("north"), F.max("lon").alias("east"))
    return b.withColumn("height_km", F.round((F.col("north") - F.col("south")) * 111.32, 3)).withColumn("width_km", F.round((F.col("east") - F.col("west")) * 111.32 * F.cos(F.radians((F.col("north") + F.col("south")) / 2)), 3))


def mail_per_language(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: addresses found in texts, marked as of a function or not, counted by the text's language."""
    found = document_emails(spark, d)
    lang = table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("?")).alias("lang"))
    return found.join(lang, "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("emails"), F.sum(F.col("role").cast("int")).alias("roles"), F.count_distinct("doc_id").alias("docs"))


QUERIES = {
    f.__name__: f
    for f in (
        page_texts, page_languages, page_titles, contact_links, json_ld_blocks, markup_emails, document_emails, objections, keyword_hits, vat_numbers, register_numbers, phone_numbers, app_shells,
        organisation_types, street_lines, request_hashes, props_json, bounding_boxes, mail_per_language,
    )
}

PAGE_TEXT = r"""
regexp_replace(html, '<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<template\b.*?</template\s*>|<svg\b.*?</svg\s*>|<head\b.*?</head\s*>', ' ', 'gis')"""
BLOCKS = r"</?(?:p|br|div|li|ul|ol|h[1-6]|tr|td|th|table|nav|footer|header|section|article|form|body|title|pre)\b[^>]*>"
SQL_TEXT = f"""regexp_replace(regexp_replace(regexp_replace({PAGE_TEXT}, '[\\r\\n\\t ]+', ' ', 'g'), '{BLOCKS}', chr(10), 'gi'), '<[^>]*>', '', 'g')"""
SQL_TEXT = f"""trim(regexp_replace(replace(replace(replace(replace(replace(replace({SQL_TEXT}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), ' *\\n[ \\n]*', chr(10), 'g'), chr(10) || ' ')"""
EMAILS = "SELECT DISTINCT {i}, lower(unnest(regexp_extract_all({t}, '" + MAIL.replace("{", "{{").replace("}", "}}") + "'))) AS email FROM {f}"

SQL = {
    "page_texts": f"SELECT page_id, length(t) AS chars, len(string_split(t, chr(10))) AS lines FROM (SELECT page_id, {SQL_TEXT} AS t FROM site_pages)",
    "page_languages": """SELECT page_id, nullif(lower(regexp_extract(html, '<html\\b[^>]*\\blang=["'']?([A-Za-z]{2,3})', 1, 'i')), '') AS lang FROM site_pages""",
    "page_titles": "SELECT page_id, replace(nullif(trim(regexp_extract(html, '<title\\b[^>]*>(.*?)</title', 1, 'is')), ''), '&amp;', '&') AS title FROM site_pages",
    "contact_links": """
SELECT domain, href, count(DISTINCT page_id) AS pages, CASE WHEN regexp_matches(href, '^/(?:impressum|legal|mentions-legales|aviso-legal)$', 'i') THEN 0 WHEN regexp_matches(href, 'kontakt|contact', 'i') THEN 1 ELSE 2 END AS rank
FROM (SELECT domain, page_id, unnest(regexp_extract_all(html, '<a\\b[^>]*\\bhref="([^"]*)"[^>]*>.*?</a>', 1, 'is')) AS href FROM site_pages) WHERE href LIKE '/%' GROUP BY 1, 2""",
    "json_ld_blocks": """
WITH b AS (SELECT page_id, regexp_extract_all(html, '<script type="application/ld\\+json">(.*?)</script>', 1, 'is') AS x FROM site_pages),
u AS (SELECT page_id, unnest(generate_series(0, len(x) - 1)) AS pos, unnest(x) AS block FROM b)
SELECT page_id, pos, CASE WHEN json_valid(block) THEN json_extract_string(block, '$.name') END AS name, CASE WHEN json_valid(block) THEN regexp_replace(json_extract_string(block, '$.email'), '^mailto:', '') END AS email FROM u""",
    "markup_emails": EMAILS.format(i="page_id", t="html", f="site_pages"),
    "document_emails": f"SELECT doc_id, email, string_split(string_split(string_split(string_split(email, '@')[1], '+')[1], '-')[1], '.')[1] IN ({', '.join(repr(r) for r in ROLES)}) AS role FROM ({EMAILS.format(i='doc_id', t='text', f='documents')})",
    "objections": "SELECT doc_id, objects FROM (SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(t, '{p[4:].replace(chr(39), chr(39) * 2)}', 'i') THEN '{k}'" for k, p in OBJECTIONS) + " END AS objects FROM (SELECT doc_id, regexp_replace(text, '\\s+', ' ', 'g') AS t FROM documents)) WHERE objects IS NOT NULL",
    "vat_numbers": "SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\\b((?:DE|AT|FR|GB|ES)[0-9]{9})\\b', 1)) AS vat FROM documents",
    "register_numbers": "SELECT doc_id, court, number FROM (SELECT doc_id, regexp_extract(text, 'Registergericht ([^,\\n]+), (HR[AB] [0-9]+)', 1) AS court, regexp_extract(text, 'Registergericht ([^,\\n]+), (HR[AB] [0-9]+)', 2) AS number FROM documents) WHERE number <> ''",
    "phone_numbers": """
WITH e AS (SELECT entry_id, slice.country_code AS cc, regexp_replace(regexp_replace(replace(candidate.hints['phone'], '(0)', ''), '[^0-9+]', '', 'g'), '^00', '+') AS p FROM dedup_entries WHERE candidate.hints['phone'] IS NOT NULL)
SELECT entry_id, CASE WHEN p LIKE '+%' THEN p WHEN p LIKE '0%' THEN CASE cc WHEN 'DE' THEN '+49' WHEN 'AT' THEN '+43' WHEN 'FR' THEN '+33' WHEN 'GB' THEN '+44' END || p[2:] END AS phone FROM e""",
    "app_shells": f"""SELECT page_id, chars FROM (SELECT page_id, html, length({SQL_TEXT}) AS chars FROM site_pages WHERE html IS NOT NULL) WHERE chars < 80 AND regexp_matches(html, '<div id="(?:root|app|__next)">') AND contains(html, '<script')""",
    "organisation_types": "SELECT type, count(DISTINCT org_id) AS blocks FROM (SELECT org_id, unnest(types) AS type FROM jsonld_orgs) WHERE type IN ('Organization', 'Corporation') OR regexp_matches(type, '(Business|Organization)$') GROUP BY 1",
    "street_lines": "SELECT addr_id, line FROM (SELECT addr_id, trim(regexp_replace(address, '\\s+', ' ', 'g')) AS line FROM address_results) WHERE length(line) <= 90 AND regexp_matches(line, '[0-9]') AND regexp_matches(line, '[A-Za-z]{3}') AND NOT regexp_matches(line, 'tel\\.|fax|@', 'i')",
    "request_hashes": """
SELECT sha256(to_json({'country': resolved.country.input, 'regions': list_transform(resolved.regions, lambda x: x.input), 'industries': list_transform(resolved.industries, lambda x: x.input)})::VARCHAR) AS hash,
  min(job_id) AS job_id, count(*) AS requests FROM scrape_resolve GROUP BY 1""",
    "props_json": "SELECT event_type, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS k, count(json_extract_string(props, '$.k')) AS told FROM events GROUP BY 1",
    "bounding_boxes": """
SELECT area_id, south, west, north, east, round((north - south) * 111.32, 3) AS height_km, round((east - west) * 111.32 * cos(radians((north + south) / 2)), 3) AS width_km FROM (
  SELECT area_id, min(coalesce(lat, center.lat)) AS south, min(coalesce(lon, center.lon)) AS west, max(coalesce(lat, center.lat)) AS north, max(coalesce(lon, center.lon)) AS east FROM poi_elements GROUP BY 1)""",
}
SQL["keyword_hits"] = """
SELECT doc_id, keyword FROM (SELECT doc_id, ' ' || regexp_replace(lower(strip_accents(replace(text, 'ß', 'ss'))), '[^a-z0-9]+', ' ', 'g') || ' ' AS t FROM documents WHERE text IS NOT NULL),
  (SELECT unnest([{words}]) AS keyword) WHERE contains(t, CASE WHEN length(keyword) < 8 THEN ' ' || keyword || ' ' ELSE keyword END)""".format(words=", ".join(f"'{k}'" for k in KEYWORDS))
SQL["mail_per_language"] = f"SELECT coalesce(lang, '?') AS lang, count(*) AS emails, sum(role::INT) AS roles, count(DISTINCT e.doc_id) AS docs FROM ({SQL['document_emails']}) e JOIN documents d ON e.doc_id = d.doc_id GROUP BY 1"
