"""Queries that join: planning, entity resolution, provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kontor.functions.text import words
from kontor.functions.urls import registered_domain
from kontor.operators import similarity
from kontor.operators.graph import components
from kontor.operators.joins import checked_broadcast
from kontor.sources.tables import table

# Legal forms that no comparison of names counts.
FORMS = r"\b(?:gmbh co kg|gmbh|mbh|ug haftungsbeschrankt|ug|ag|kg|ohg|e k|ek|e u|eu|sarl|sas|eurl|sa|ltd|plc|llp|limited|g m b h|k g|a g|o h g|s a s|aktiengesellschaft|kommanditgesellschaft)\b"


def slices_cross(spark: SparkSession, d: str) -> DataFrame:
    """JO-01: the slices of each request, its regions by its industries; equal ones once, in order of first mention."""
    r = table(spark, d, "scrape_resolve").select("job_id", F.posexplode("resolved.regions.input").alias("rp", "region"), F.col("resolved.industries.input").alias("inds"))
    s = r.select("job_id", "rp", "region", F.posexplode("inds").alias("ip", "industry"))
    s = s.withColumn("key", F.concat_ws("|", F.lower(F.trim("region")), F.lower(F.trim("industry"))))
    first = s.groupBy("job_id", "key").agg(F.min_by(F.struct("region", "industry"), F.struct("rp", "ip")).alias("s"), F.min(F.struct("rp", "ip")).alias("at"))
    place = F.row_number().over(Window.partitionBy("job_id").orderBy("at"))
    return first.select("job_id", place.alias("place"), "s.region", "s.industry")


def country_split(spark: SparkSession, d: str) -> DataFrame:
    """JO-02: countries with their regions, for those with one to forty, in the order of codes."""
    c = table(spark, d, "canon_values")
    regions = c.where("field = 'region'").select("country_code", F.col("code").alias("region_code"), F.col("name").alias("region"))
    counted = regions.groupBy("country_code").agg(F.count(F.lit(1)).alias("n")).where("n between 1 and 40")
    return regions.join(checked_broadcast(counted), "country_code").select("country_code", "region_code", "region", F.row_number().over(Window.partitionBy("country_code").orderBy("region_code")).alias("place"))


def same_entities(spark: SparkSession, d: str) -> DataFrame:
    """JO-03, equi part: entries of both sources joined by registered domain, or by postal code and name."""
    e = table(spark, d, "dedup_entries").unionByName(table(spark, d, "web_entries")).select("entry_id", registered_domain("domain").alias("domain"), "postal", "norm_name")
    keys = e.select("entry_id", F.explode(F.array(F.when(F.col("domain").isNotNull(), F.concat(F.lit("d:"), "domain")), F.when(F.col("postal").isNotNull() & F.col("norm_name").isNotNull(), F.concat_ws(":", F.lit("n"), "postal", "norm_name")))).alias("key")).where("key is not null")
    # an entry and a key are nodes; so a hot key costs one edge an entry, never a pair
    edges = keys.select(F.col("entry_id").alias("a"), (F.abs(F.xxhash64("key")) + F.lit(1 << 42)).alias("b"))
    found = components(edges)
    return e.select("entry_id").join(found, F.col("entry_id") == F.col("node"), "left").select("entry_id", F.coalesce("component", "entry_id").alias("entity_id"))


def fuzzy_same_place(spark: SparkSession, d: str) -> DataFrame:
    """JO-03, fuzzy part: pairs of the two sources at one postal code whose names have a token-set ratio of 92 or more.

    Distinct names are compared, each pair once, by :func:`similarity.names_alike`"""
    rows = [table(spark, d, t).where("postal is not null and norm_name is not null").select("entry_id", "postal", "norm_name") for t in ("dedup_entries", "web_entries")]
    a = rows[0].select(F.col("entry_id").alias("osm_id"), "postal", F.col("norm_name").alias("a"))
    b = rows[1].select(F.col("entry_id").alias("web_id"), "postal", F.col("norm_name").alias("b"))
    found = similarity.names_alike(a.select("postal", "a").distinct(), b.select("postal", "b").distinct(), "postal", 92)
    return found.join(a, ["postal", "a"]).join(b, ["postal", "b"]).select("osm_id", "web_id", F.round("ratio", 4).alias("ratio")).distinct()


def token_superset(spark: SparkSession, d: str) -> DataFrame:
    """JO-07, prefilter: entries of one postal code where all words of one's name stand in the other's.

    The name that may be the smaller one looks up its longest word only, which the other must hold; so pairs are made
    within a postal code and a word, not within a postal code."""
    a = table(spark, d, "dedup_entries").select(F.col("entry_id").alias("osm_id"), "postal", F.split("norm_name", " ").alias("x"))
    b = table(spark, d, "web_entries").select(F.col("entry_id").alias("web_id"), "postal", F.split("norm_name", " ").alias("y"))
    longest = lambda c: F.array_max(F.transform(c, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"].alias("word")
    every = lambda c: F.explode(F.array_distinct(c)).alias("word")
    one = a.select("*", longest("x")).join(b.select("*", every("y")), ["postal", "word"]).where(F.size(F.array_except("x", "y")) == 0)
    two = a.select("*", every("x")).join(b.select("*", longest("y")), ["postal", "word"]).where(F.size(F.array_except("y", "x")) == 0)
    return one.select("osm_id", "web_id").unionByName(two.select("osm_id", "web_id")).distinct()


def fill_nulls_merge(spark: SparkSession, d: str) -> DataFrame:
    """JO-05: one row of each domain with the first told postal code, coordinates and phone by time of adding."""
    e = table(spark, d, "dedup_entries").unionByName(table(spark, d, "web_entries")).where("domain is not null")
    at = F.struct("added_at", "entry_id")
    told = lambda c: F.min_by(c, F.when(c.isNotNull(), at))
    return e.groupBy("domain").agg(
        F.min_by("entry_id", at).alias("entry_id"),
        told(F.col("postal")).alias("postal"),
        told(F.col("candidate.lat")).alias("lat"),
        told(F.col("candidate.lon")).alias("lon"),
        told(F.col("candidate.hints")["phone"]).alias("phone"),
        F.count(F.lit(1)).alias("entries"),
    )


def region_check(spark: SparkSession, d: str) -> DataFrame:
    """JO-06: entries with whether the elements of their area know their postal code; null where either is untold."""
    codes = table(spark, d, "poi_elements").select("area_id", F.upper(F.regexp_replace(F.col("tags")["addr:postcode"], r"\s+", "")).alias("postal")).where("postal <> ''").distinct()
    areas = codes.select("area_id").distinct().withColumn("known", F.lit(True))
    e = table(spark, d, "web_entries").select("entry_id", F.col("slice.area_id").alias("area_id"), "postal")
    e = e.join(checked_broadcast(areas), "area_id", "left").join(checked_broadcast(codes.withColumn("inside", F.lit(True))), ["area_id", "postal"], "left")
    return e.select("entry_id", F.when(F.col("postal").isNotNull() & F.col("known"), F.coalesce("inside", F.lit(False))).alias("inside"))


def web_only(spark: SparkSession, d: str) -> DataFrame:
    """JO-11: web entries whose domain no entry of the map source has."""
    known = table(spark, d, "dedup_entries").where("domain is not null").select("domain").distinct()
    return table(spark, d, "web_entries").where("domain is not null").join(known, "domain", "left_anti").select("entry_id", "domain")


def email_pages(spark: SparkSession, d: str) -> DataFrame:
    """JO-13: each address of the company rows with the pages it was found on, in order of their rows."""
    f = table(spark, d, "scrape_final").select("row_id", F.lower(F.trim("scored_email.finding.email")).alias("email"), F.col("scored_email.finding.source_url").alias("url"))
    first = f.where("email <> '' and url is not null").groupBy("email", "url").agg(F.min("row_id").alias("at"))
    return first.groupBy("email").agg(F.array_sort(F.collect_list(F.struct("at", "url"))).alias("p")).select("email", F.col("p.url").alias("urls"))


def website_lookup(spark: SparkSession, d: str) -> DataFrame:
    """JO-08: the best website of each entry: its own, else the host of its mail, else its name's most frequent domain."""
    e = table(spark, d, "dedup_entries").select("entry_id", "domain", F.lower(F.substring_index(F.col("candidate.hints")["email"], "@", -1)).alias("mail"), "norm_name")
    w = table(spark, d, "web_entries").where("domain is not null and norm_name is not null").groupBy("norm_name", "domain").agg(F.count(F.lit(1)).alias("n"))
    guess = w.groupBy("norm_name").agg(F.min_by("domain", F.struct(-F.col("n"), "domain")).alias("guess"))
    e = e.join(guess, "norm_name", "left")
    return e.select("entry_id", F.coalesce("domain", "mail", "guess").alias("site"), F.when(F.col("domain").isNotNull(), "tag").when(F.col("mail").isNotNull(), "email").when(F.col("guess").isNotNull(), "search").alias("method"))


def source_union(spark: SparkSession, d: str) -> DataFrame:
    """SL-05: companies of both sources by name and postal code, the map source first where both know one."""
    cols = ["norm_name", "postal"]
    a = table(spark, d, "dedup_entries").select(*cols, "entry_id", F.lit(0).alias("priority"))
    b = table(spark, d, "web_entries").select(*cols, "entry_id", F.lit(1).alias("priority"))
    rows = a.unionByName(b).where("norm_name is not null and postal is not null")
    return rows.groupBy(*cols).agg(F.min_by("entry_id", F.struct("priority", "entry_id")).alias("entry_id"), F.count_distinct("priority").alias("sources"))


def suppressed(spark: SparkSession, d: str) -> DataFrame:
    """FI-05: company rows whose address is not suppressed: not its domain nor a parent of it, but for bare top levels."""
    rows = table(spark, d, "scrape_final").select("row_id", F.lower(F.trim("company_email")).alias("email")).where("email like '%@%.%'")
    labels = F.split(F.substring_index("email", "@", -1), r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels) - 1)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    listed = table(spark, d, "jsonld_orgs").where("country = 'DE'").select(registered_domain("url").alias("parent")).where("parent is not null").distinct()
    hit = rows.select("row_id", F.explode(parents).alias("parent")).join(checked_broadcast(listed), "parent", "left_semi").select("row_id")
    return rows.join(hit, "row_id", "left_anti")


def names_normal(spark: SparkSession, d: str) -> DataFrame:
    """SF-03: names of all entries without legal forms, in one spelling."""
    e = table(spark, d, "dedup_entries").select("entry_id", "candidate.name").unionByName(table(spark, d, "web_entries").select("entry_id", "candidate.name"))
    return e.select("entry_id", F.trim(F.regexp_replace(F.regexp_replace(words("name"), FORMS, " "), r"\s+", " ")).alias("name"))


QUERIES = {f.__name__: f for f in (slices_cross, country_split, same_entities, fuzzy_same_place, token_superset, fill_nulls_merge, region_check, web_only, email_pages, website_lookup, source_union, suppressed, names_normal)}

SQL = {
    "same_entities": r"""
WITH RECURSIVE e AS (SELECT entry_id, array_to_string(string_split(domain_host, '.')[-2:], '.') AS domain, postal, norm_name FROM (
  SELECT entry_id, regexp_extract(lower(trim(domain)), '^(?:[a-z][a-z0-9+.-]*://)?(?:[^/@?#]*@)?([a-z0-9](?:[a-z0-9.-]*[a-z0-9])?)(?::\d+)?(?:[/?#].*)?$', 1) AS domain_host, postal, norm_name
  FROM (SELECT entry_id, domain, postal, norm_name FROM dedup_entries UNION ALL SELECT entry_id, domain, postal, norm_name FROM web_entries))),
k AS (SELECT entry_id, 'd:' || domain AS key FROM e WHERE domain LIKE '%.%' UNION SELECT entry_id, 'n:' || postal || ':' || norm_name FROM e WHERE postal IS NOT NULL AND norm_name IS NOT NULL),
p AS (SELECT DISTINCT a.entry_id AS a, b.entry_id AS b FROM k a JOIN k b ON a.key = b.key),
r AS (SELECT a AS node, b AS reach FROM p UNION SELECT r.node, p.b FROM r JOIN p ON r.reach = p.a)
SELECT e.entry_id, coalesce(min(reach), e.entry_id) AS entity_id FROM e LEFT JOIN r ON e.entry_id = r.node GROUP BY e.entry_id""".replace("\\\\d", "\\d"),
    "slices_cross": """
WITH r AS (SELECT job_id, unnest(generate_series(0, len(resolved.regions) - 1)) AS rp, unnest(list_transform(resolved.regions, lambda x: x.input)) AS region, resolved.industries AS inds FROM scrape_resolve),
s AS (SELECT job_id, rp, region, unnest(generate_series(0, len(inds) - 1)) AS ip, unnest(list_transform(inds, lambda x: x.input)) AS industry FROM r),
f AS (SELECT *, row_number() OVER (PARTITION BY job_id, lower(trim(region)), lower(trim(industry)) ORDER BY rp, ip) AS rn FROM s)
SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY rp, ip) AS place, region, industry FROM f WHERE rn = 1""",
    "country_split": """
SELECT country_code, code AS region_code, name AS region, row_number() OVER (PARTITION BY country_code ORDER BY code) AS place FROM canon_values
WHERE field = 'region' AND country_code IN (SELECT country_code FROM canon_values WHERE field = 'region' GROUP BY 1 HAVING count(*) BETWEEN 1 AND 40)""",
    "token_superset": """
SELECT a.entry_id AS osm_id, b.entry_id AS web_id FROM dedup_entries a JOIN web_entries b ON a.postal = b.postal
WHERE list_has_all(string_split(b.norm_name, ' '), string_split(a.norm_name, ' ')) OR list_has_all(string_split(a.norm_name, ' '), string_split(b.norm_name, ' '))""",
    "fill_nulls_merge": """
WITH e AS (SELECT * FROM dedup_entries UNION ALL BY NAME SELECT * FROM web_entries)
SELECT domain, arg_min(entry_id, (added_at, entry_id)) AS entry_id, arg_min(postal, (added_at, entry_id)) FILTER (postal IS NOT NULL) AS postal,
  arg_min(candidate.lat, (added_at, entry_id)) FILTER (candidate.lat IS NOT NULL) AS lat, arg_min(candidate.lon, (added_at, entry_id)) FILTER (candidate.lon IS NOT NULL) AS lon,
  arg_min(candidate.hints['phone'], (added_at, entry_id)) FILTER (candidate.hints['phone'] IS NOT NULL) AS phone, count(*) AS entries
FROM e WHERE domain IS NOT NULL GROUP BY domain""",
    "region_check": r"""
WITH codes AS (SELECT DISTINCT area_id, upper(regexp_replace(tags['addr:postcode'], '\s+', '', 'g')) AS postal FROM poi_elements WHERE trim(tags['addr:postcode']) <> '')
SELECT entry_id, CASE WHEN w.postal IS NOT NULL AND w.slice.area_id IN (SELECT area_id FROM codes WHERE area_id IS NOT NULL) THEN c.postal IS NOT NULL END AS inside
FROM web_entries w LEFT JOIN codes c ON w.slice.area_id = c.area_id AND w.postal = c.postal""",
    "web_only": "SELECT entry_id, domain FROM web_entries WHERE domain IS NOT NULL AND domain NOT IN (SELECT domain FROM dedup_entries WHERE domain IS NOT NULL)",
    "email_pages": """
SELECT email, list(url ORDER BY seen, url) AS urls FROM (
  SELECT lower(trim(scored_email.finding.email)) AS email, scored_email.finding.source_url AS url, min(row_id) AS seen FROM scrape_final GROUP BY 1, 2) WHERE email <> '' AND url IS NOT NULL GROUP BY email""",
    "website_lookup": """
WITH w AS (SELECT norm_name, domain, count(*) AS n FROM web_entries WHERE domain IS NOT NULL AND norm_name IS NOT NULL GROUP BY 1, 2),
g AS (SELECT norm_name, domain AS guess FROM (SELECT *, row_number() OVER (PARTITION BY norm_name ORDER BY n DESC, domain) AS rn FROM w) WHERE rn = 1),
e AS (SELECT entry_id, domain, lower(string_split(candidate.hints['email'], '@')[-1]) AS mail, norm_name FROM dedup_entries)
SELECT entry_id, coalesce(domain, mail, guess) AS site, CASE WHEN domain IS NOT NULL THEN 'tag' WHEN mail IS NOT NULL THEN 'email' WHEN guess IS NOT NULL THEN 'search' END AS method FROM e LEFT JOIN g ON e.norm_name = g.norm_name""",
    "source_union": """
WITH u AS (SELECT norm_name, postal, entry_id, 0 AS priority FROM dedup_entries UNION ALL SELECT norm_name, postal, entry_id, 1 FROM web_entries)
SELECT norm_name, postal, arg_min(entry_id, (priority, entry_id)) AS entry_id, count(DISTINCT priority) AS sources FROM u WHERE norm_name IS NOT NULL AND postal IS NOT NULL GROUP BY 1, 2""",
    "suppressed": r"""
WITH listed AS (SELECT DISTINCT array_to_string(string_split(regexp_extract(lower(url), '^https?://(?:www\.)?([^/]+)', 1), '.')[-2:], '.') AS parent FROM jsonld_orgs WHERE country = 'DE' AND url IS NOT NULL),
r AS (SELECT row_id, lower(trim(company_email)) AS email FROM scrape_final WHERE lower(trim(company_email)) LIKE '%@%.%')
SELECT row_id, email FROM r WHERE NOT EXISTS (SELECT 1 FROM listed WHERE string_split(email, '@')[-1] = parent OR string_split(email, '@')[-1] LIKE '%.' || parent)""",
    "names_normal": f"""
SELECT entry_id, trim(regexp_replace(regexp_replace(trim(regexp_replace(lower(strip_accents(replace(replace(name, 'ß', 'ss'), 'ẞ', 'ss'))), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), '{FORMS}', ' ', 'g'), '\\s+', ' ', 'g')) AS name
FROM (SELECT entry_id, candidate.name AS name FROM dedup_entries UNION ALL SELECT entry_id, candidate.name FROM web_entries)""",
}
