"""Queries on sources: scans, projections, filters of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kontor.functions.text import blank_to_null, folded
from kontor.functions.urls import host, normal_website, registered_domain
from kontor.operators.allocation import first_per
from kontor.operators.joins import checked_broadcast
from kontor.sources.tables import table

# Hosts that anybody can get an address at, and directories of companies.
FREE_MAIL = ("postfach.example", "mailhaus.example", "gmx.example", "webpost.example")
DIRECTORIES = ("katalog-mitte.example", "tradefinder-north.example", "firmenliste-ost.example", "gewerbeblick.test", "annuaire-pro-sud.example")
NEGATIVE = ("handel", "verpackung", "transport")


def tag(*keys: str):
    """First non-blank of several tags, trimmed."""
    return F.coalesce(*[blank_to_null(F.trim(F.col("tags")[k])) for k in keys])


def poi_candidates(spark: SparkSession, d: str) -> DataFrame:
    """SC-05: elements with a name as candidates; website before contact:website, first non-blank of each hint."""
    e = table(spark, d, "poi_elements")
    return e.where(F.trim(F.col("tags")["name"]) != "").select(
        "row_id",
        F.concat_ws("/", "type", F.col("id").cast("string")).alias("source_ref"),
        F.trim(F.col("tags")["name"]).alias("name"),
        tag("website", "contact:website").alias("website"),
        tag("email", "contact:email").alias("email"),
        tag("phone", "contact:phone").alias("phone"),
        tag("addr:city").alias("city"),
        tag("addr:postcode").alias("postal_code"),
        F.coalesce("lat", "center.lat").alias("lat"),
        F.coalesce("lon", "center.lon").alias("lon"),
    )


def poi_latest(spark: SparkSession, d: str) -> DataFrame:
    """The last fetch of each element: one aggregation, no sort."""
    e = table(spark, d, "poi_elements").select("type", "id", "row_id", "fetched_at")
    return e.groupBy("type", "id").agg(F.max_by("row_id", F.struct("fetched_at", "row_id")).alias("row_id"), F.count(F.lit(1)).alias("fetches"))


def gazetteer_postcodes(spark: SparkSession, d: str) -> DataFrame:
    """SC-06: postcodes of each area from its elements; several in one tag are split."""
    e = table(spark, d, "poi_elements").select("area_id", F.explode(F.split(F.col("tags")["addr:postcode"], "[;,]")).alias("code"))
    return e.select("area_id", F.upper(F.regexp_replace("code", r"\s+", "")).alias("postcode")).where("postcode <> ''").distinct()


def gazetteer_places(spark: SparkSession, d: str) -> DataFrame:
    """SC-06: places of each area with their number of elements."""
    e = table(spark, d, "poi_elements").select("area_id", F.trim(F.col("tags")["addr:city"]).alias("place"))
    return e.where("place <> ''").groupBy("area_id", "place").agg(F.count(F.lit(1)).alias("elements"))


def negative_keywords(spark: SparkSession, d: str) -> DataFrame:
    """FI-01: named elements whose name holds none of the negative keywords, whatever its case."""
    name = F.lower(F.col("tags")["name"])
    keep = name.isNotNull()
    for word in NEGATIVE:
        keep = keep & ~F.contains(name, F.lit(word))
    return table(spark, d, "poi_elements").where(keep).select("row_id", F.col("tags")["name"].alias("name"))


def usable_candidates(spark: SparkSession, d: str) -> DataFrame:
    """FI-02: entries with a website, or an email that is not at a free mail host."""
    e = table(spark, d, "dedup_entries")
    mail = F.lower(F.substring_index(blank_to_null(F.col("candidate.hints")["email"]), "@", -1))
    site = host(F.col("candidate.website"))
    own = F.when(~mail.isin(*FREE_MAIL), mail)
    return e.where(site.isNotNull() | own.isNotNull()).select("entry_id", F.coalesce(site, own).alias("site"))


def company_sites(spark: SparkSession, d: str) -> DataFrame:
    """FI-03: web entries whose host is no directory of companies."""
    w = table(spark, d, "web_entries").select("entry_id", host(F.col("candidate.website")).alias("host"))
    listed = spark.createDataFrame([(x,) for x in DIRECTORIES], "host string")
    return w.where("host is not null").join(checked_broadcast(listed), "host", "left_anti").select("entry_id", "host")


def first_per_host(spark: SparkSession, d: str) -> DataFrame:
    """SC-11: the first web entry of each registered domain by time of adding."""
    w = table(spark, d, "web_entries").select("entry_id", "added_at", registered_domain(F.col("candidate.website")).alias("domain"))
    return first_per(w.where("domain is not null"), ["domain"], ["added_at", "entry_id"]).select("domain", "entry_id")


def websites_normal(spark: SparkSession, d: str) -> DataFrame:
    """SF-07: websites of all entries in one form, with their registered domain."""
    e = table(spark, d, "dedup_entries").select("entry_id", "candidate.website").unionByName(table(spark, d, "web_entries").select("entry_id", "candidate.website"))
    return e.select("entry_id", normal_website("website").alias("website"), registered_domain("website").alias("domain"))


def resolve_exact(spark: SparkSession, d: str) -> DataFrame:
    """RS-01..03, exact and alias step: inputs that equal a name or alias of their field but for case and accents."""
    canon = table(spark, d, "canon_values")
    names = canon.select("canon_id", "field", F.explode(F.concat(F.array("name", "code"), F.coalesce("aliases", F.array()))).alias("name"))
    keys = names.select("field", folded(F.trim("name")).alias("key"), "canon_id").groupBy("field", "key").agg(F.min("canon_id").alias("canon_id"))
    r = table(spark, d, "scrape_resolve").select("job_id", "resolved")
    country = r.select("job_id", F.lit("country").alias("field"), F.lit(0).alias("pos"), F.col("resolved.country.input").alias("input"))
    region = r.select("job_id", F.posexplode("resolved.regions.input").alias("pos", "input")).select("job_id", F.lit("region").alias("field"), "pos", "input")
    industry = r.select("job_id", F.posexplode("resolved.industries.input").alias("pos", "input")).select("job_id", F.lit("industry").alias("field"), "pos", "input")
    rows = country.unionByName(region).unionByName(industry).where("input is not null").withColumn("key", folded(F.trim("input")))
    # the list is the fixed reference table; a few hundred keys
    return rows.join(checked_broadcast(keys), ["field", "key"], "left").select("job_id", "field", "pos", "canon_id")


def first_spellings(spark: SparkSession, d: str) -> DataFrame:
    """FI-17: industries of each request without repeats that differ in case or blanks, the first spelling kept."""
    r = table(spark, d, "scrape_resolve").select("job_id", F.posexplode("resolved.industries.input").alias("pos", "input"))
    r = r.where("trim(input) <> ''").withColumn("key", F.lower(F.trim("input")))
    return r.groupBy("job_id", "key").agg(F.min_by("input", "pos").alias("input"), F.min("pos").alias("pos")).select("job_id", "pos", "input")


def countries_listed(spark: SparkSession, d: str) -> DataFrame:
    """SL-04: countries in the order of their codes."""
    return table(spark, d, "canon_values").where("field = 'country'").select("code", "name", F.array_sort("aliases").alias("aliases")).orderBy("code")


QUERIES = {f.__name__: f for f in (poi_candidates, poi_latest, gazetteer_postcodes, gazetteer_places, negative_keywords, usable_candidates, company_sites, first_per_host, websites_normal, resolve_exact, first_spellings, countries_listed)}

HOST = r"regexp_extract(lower(trim({x})), '^(?:[a-z][a-z0-9+.-]*://)?(?:[^/@?#]*@)?([a-z0-9](?:[a-z0-9.-]*[a-z0-9])?)(?::\d+)?(?:[/?#].*)?$', 1)"


def sql_host(x: str) -> str:
    h = HOST.format(x=x)
    return f"CASE WHEN {h} LIKE '%.%' THEN {h} END"


def sql_domain(x: str) -> str:
    h = f"({sql_host(x)})"
    return f"CASE WHEN {h} NOT SIMILAR TO '[0-9.]+' THEN array_to_string(string_split({h}, '.')[-2:], '.') END"


def quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


SQL = {
    "poi_candidates": """
SELECT row_id, type || '/' || id AS source_ref, trim(tags['name']) AS name,
  coalesce(nullif(trim(tags['website']), ''), nullif(trim(tags['contact:website']), '')) AS website,
  coalesce(nullif(trim(tags['email']), ''), nullif(trim(tags['contact:email']), '')) AS email,
  coalesce(nullif(trim(tags['phone']), ''), nullif(trim(tags['contact:phone']), '')) AS phone,
  nullif(trim(tags['addr:city']), '') AS city, nullif(trim(tags['addr:postcode']), '') AS postal_code,
  coalesce(lat, center.lat) AS lat, coalesce(lon, center.lon) AS lon
FROM poi_elements WHERE trim(tags['name']) <> ''""",
    "poi_latest": """
SELECT type, id, row_id, fetches FROM (
  SELECT type, id, row_id, count(*) OVER (PARTITION BY type, id) AS fetches, row_number() OVER (PARTITION BY type, id ORDER BY fetched_at DESC, row_id DESC) AS rn FROM poi_elements) WHERE rn = 1""",
    "gazetteer_postcodes": r"""
SELECT DISTINCT area_id, postcode FROM (
  SELECT area_id, upper(regexp_replace(unnest(regexp_split_to_array(tags['addr:postcode'], '[;,]')), '\s+', '', 'g')) AS postcode FROM poi_elements WHERE tags['addr:postcode'] IS NOT NULL) WHERE postcode <> ''""",
    "gazetteer_places": "SELECT area_id, trim(tags['addr:city']) AS place, count(*) AS elements FROM poi_elements WHERE trim(tags['addr:city']) <> '' GROUP BY 1, 2",
    "negative_keywords": "SELECT row_id, tags['name'] AS name FROM poi_elements WHERE tags['name'] IS NOT NULL AND " + " AND ".join(f"NOT contains(lower(tags['name']), '{w}')" for w in NEGATIVE),
    "usable_candidates": f"""
SELECT entry_id, coalesce(site, own) AS site FROM (
  SELECT entry_id, {sql_host("candidate.website")} AS site, CASE WHEN mail NOT IN ({quoted(FREE_MAIL)}) THEN mail END AS own FROM (
    SELECT *, lower(string_split(nullif(trim(candidate.hints['email']), ''), '@')[-1]) AS mail FROM dedup_entries)) WHERE site IS NOT NULL OR own IS NOT NULL""",
    "company_sites": f"SELECT entry_id, host FROM (SELECT entry_id, {sql_host('candidate.website')} AS host FROM web_entries) WHERE host IS NOT NULL AND host NOT IN ({quoted(DIRECTORIES)})",
    "first_per_host": f"""
SELECT domain, entry_id FROM (SELECT entry_id, domain, row_number() OVER (PARTITION BY domain ORDER BY added_at, entry_id) AS rn FROM (
  SELECT entry_id, added_at, {sql_domain("candidate.website")} AS domain FROM web_entries) WHERE domain IS NOT NULL) WHERE rn = 1""",
    "websites_normal": f"""
WITH e AS (SELECT entry_id, candidate.website AS website FROM dedup_entries UNION ALL SELECT entry_id, candidate.website FROM web_entries),
p AS (SELECT entry_id, website, {sql_host("website")} AS h, CASE WHEN website ILIKE 'http://%' THEN 'http' ELSE 'https' END AS scheme,
  regexp_replace(regexp_replace(trim(website), '^https?://', '', 'i'), '^[^/?]*', '') AS path FROM e)
SELECT entry_id, CASE WHEN h IS NOT NULL THEN scheme || '://' || h || CASE WHEN path LIKE '/%' THEN path ELSE '/' || path END END AS website, {sql_domain("website")} AS domain FROM p""",
    "resolve_exact": """
WITH keys AS (
  SELECT field, lower(strip_accents(replace(trim(name), 'ß', 'ss'))) AS key, min(canon_id) AS canon_id FROM (
    SELECT field, canon_id, unnest(list_concat([name, code], coalesce(aliases, []))) AS name FROM canon_values) GROUP BY 1, 2
), rows AS (
  SELECT job_id, 'country' AS field, 0 AS pos, resolved.country.input AS input FROM scrape_resolve
  UNION ALL SELECT job_id, 'region', unnest(generate_series(0, len(resolved.regions) - 1)), unnest(list_transform(resolved.regions, lambda x: x.input)) FROM scrape_resolve
  UNION ALL SELECT job_id, 'industry', unnest(generate_series(0, len(resolved.industries) - 1)), unnest(list_transform(resolved.industries, lambda x: x.input)) FROM scrape_resolve
)
SELECT job_id, rows.field, pos, canon_id FROM rows LEFT JOIN keys ON rows.field = keys.field AND lower(strip_accents(replace(trim(input), 'ß', 'ss'))) = keys.key WHERE input IS NOT NULL""",
    "first_spellings": """
SELECT job_id, pos, input FROM (SELECT job_id, pos, input, row_number() OVER (PARTITION BY job_id, lower(trim(input)) ORDER BY pos) AS rn FROM (
  SELECT job_id, unnest(generate_series(0, len(resolved.industries) - 1)) AS pos, unnest(list_transform(resolved.industries, lambda x: x.input)) AS input FROM scrape_resolve) WHERE trim(input) <> '') WHERE rn = 1""",
    "countries_listed": "SELECT code, name, list_sort(aliases) AS aliases FROM canon_values WHERE field = 'country' ORDER BY code",
}
