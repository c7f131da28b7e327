"""Queries that check, name, assemble and suggest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kontor.functions.text import words
from kontor.functions.urls import host
from kontor.operators.allocation import first_per
from kontor.operators.joins import checked_broadcast
from kontor.plans.sources import sql_host
from kontor.sources.tables import table

SYNTAX = r"^[a-z0-9!#$%&'*+/=?^_`{|}~-]+(?:\.[a-z0-9!#$%&'*+/=?^_`{|}~-]+)*@(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}$"
FORM = r"(GmbH & Co\. KG|UG \(haftungsbeschränkt\)|GmbH|OHG|KG|AG|e\.K\.|e\.U\.|SARL|SAS|EURL|Ltd|PLC|LLP)$"
# Countries of top-level domains.
COUNTRY_DOMAINS = {"de": "DE", "at": "AT", "ch": "CH", "fr": "FR", "uk": "GB", "nl": "NL", "es": "ES", "it": "IT", "pl": "PL"}


def email_syntax(spark: SparkSession, d: str) -> DataFrame:
    """FI-16: whether each row's address has a complete form, and the address in one spelling."""
    e = table(spark, d, "scrape_final").select("row_id", F.lower(F.trim("company_email")).alias("email")).where("email <> ''")
    return e.select("row_id", "email", (F.col("email").rlike(SYNTAX) & (F.length(F.substring_index("email", "@", 1)) <= 64)).alias("complete"))


def email_placeholders(spark: SparkSession, d: str) -> DataFrame:
    """FI-07: addresses of the company rows whose local part or domain is a listed stand-in, or not, counted."""
    p = table(spark, d, "placeholder_values")
    e = table(spark, d, "scrape_final").select("row_id", F.lower(F.trim("company_email")).alias("email")).where("email like '%@%'")
    e = e.withColumn("local", F.substring_index("email", "@", 1)).withColumn("domain", F.substring_index("email", "@", -1))
    # the list is the fixed reference table of a few dozen values
    local = checked_broadcast(p.where("kind = 'local'").select(F.col("value").alias("local"), F.lit(True).alias("l")).distinct())
    domain = checked_broadcast(p.where("kind = 'domain'").select(F.col("value").alias("domain"), F.lit(True).alias("m")).distinct())
    return e.join(local, "local", "left").join(domain, "domain", "left").select("row_id", F.coalesce("l", "m", F.lit(False)).alias("stand_in"))


def domain_countries(spark: SparkSession, d: str) -> DataFrame:
    """SF-09: entries by the country of their host's top-level domain; null for those of none."""
    codes = F.create_map(*[F.lit(x) for kv in COUNTRY_DOMAINS.items() for x in kv])
    h = host(F.col("candidate.website"))
    return table(spark, d, "web_entries").where(h.isNotNull()).groupBy(codes[F.substring_index(h, ".", -1)].alias("country")).agg(F.count(F.lit(1)).alias("entries"))


def legal_forms(spark: SparkSession, d: str) -> DataFrame:
    """SF-17: the legal form at the end of each organisation's legal name, else of its name."""
    name = F.coalesce(F.when(F.trim("legal_name") != "", F.trim("legal_name")), F.trim("name"))
    form = F.regexp_extract(name, FORM, 1)
    return table(spark, d, "jsonld_orgs").select("org_id", F.when(form != "", form).alias("form"))


def web_names(spark: SparkSession, d: str) -> DataFrame:
    """PR-04: the name of each web entry from its site's JSON-LD: the legal name of the first block with one, else the name."""
    o = table(spark, d, "jsonld_orgs").select("org_id", host("url").alias("h"), "legal_name", "name").where("h is not null")
    legal = F.min_by("legal_name", F.when(F.col("legal_name").isNotNull(), F.col("org_id")))
    plain = F.min_by("name", F.when(F.col("name").isNotNull(), F.col("org_id")))
    best = o.groupBy("h").agg(F.coalesce(legal, plain).alias("web_name"))
    w = table(spark, d, "web_entries").select("entry_id", host("domain").alias("h"), F.col("candidate.name").alias("title"))
    return w.join(best, "h", "left").select("entry_id", F.coalesce("web_name", "title").alias("name"))


def crawl_once(spark: SparkSession, d: str) -> DataFrame:
    """JO-10: of all entries of a domain the one that is crawled, the first added; map entries before web entries."""
    e = table(spark, d, "dedup_entries").select("domain", "entry_id", "added_at", F.lit(0).alias("source")).unionByName(table(spark, d, "web_entries").select("domain", "entry_id", "added_at", F.lit(1).alias("source")))
    return first_per(e.where("domain is not null"), ["domain"], ["source", "added_at", "entry_id"]).select("domain", "entry_id")


def assembled_rows(spark: SparkSession, d: str) -> DataFrame:
    """PR-02: wanted fields in order with their labels; blanks are null, an empty region too."""
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c)).alias(c)
    return table(spark, d, "scrape_final").select("row_id", blank("company_name"), blank("company_email"), blank("website"), "country", blank("region"), "industry")


def resolved_block(spark: SparkSession, d: str) -> DataFrame:
    """PR-06: number of typed inputs of each request by kind."""
    r = table(spark, d, "scrape_resolve")
    return r.select("job_id", F.coalesce(F.size(F.filter("resolved.regions", lambda x: x["input"].isNotNull())), F.lit(0)).alias("regions"), F.coalesce(F.size(F.filter("resolved.industries", lambda x: x["input"].isNotNull())), F.lit(0)).alias("industries"), F.col("resolved.country.input").isNotNull().alias("country"))


def suggestions(spark: SparkSession, d: str) -> DataFrame:
    """WI-11: for each distinct typed industry the three nearest entries of the fixed list by edit distance (a top-k report)."""
    typed = table(spark, d, "scrape_resolve").select(F.explode("resolved.industries.input").alias("input")).where("input is not null").select(words("input").alias("input")).where("input <> ''").distinct()
    # the list is a fixed reference table of forty entries: one array beside every row, no join
    refs = table(spark, d, "canon_values").where("field = 'industry'").select(F.array_sort(F.collect_list(F.struct("canon_id", words("name").alias("name")))).alias("a"), F.count(F.lit(1)).alias("n")).first()
    if refs.n > 1000:
        raise ValueError("the reference list is too long to stand beside every row")
    listed = F.array(*[F.struct(F.lit(r.canon_id).alias("canon_id"), F.lit(r.name).alias("name")) for r in refs.a]) if refs.n else F.array().cast("array<struct<canon_id: bigint, name: string>>")
    near = F.slice(F.array_sort(F.transform(listed, lambda r: F.struct(F.levenshtein("input", r["name"]).alias("edits"), r["canon_id"].alias("canon_id")))), 1, 3)
    return typed.select("input", F.posexplode(near).alias("i", "s")).select("input", "s.canon_id", "s.edits", (F.col("i") + 1).alias("place"))


def day_texts(spark: SparkSession, d: str) -> DataFrame:
    """SF-31: times of company rows as ISO text in UTC, counted by day."""
    t = F.date_format("finished_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, d, "scrape_final").groupBy(F.substring(t, 1, 10).alias("day")).agg(F.min(t).alias("first"), F.max(t).alias("last"), F.count(F.lit(1)).alias("rows"))


def fill_rates(spark: SparkSession, d: str) -> DataFrame:
    """AG-11: share of filled fields and number of repeated rows by country."""
    s = table(spark, d, "scrape_final")
    told = lambda c: F.avg(F.when(F.trim(c) != "", 1.0).otherwise(0.0)).alias(c)
    return s.groupBy("country").agg(told("company_name"), told("company_email"), told("website"), (F.count("entry_id") - F.count_distinct("entry_id")).alias("repeats"))


QUERIES = {f.__name__: f for f in (email_syntax, email_placeholders, domain_countries, legal_forms, web_names, crawl_once, assembled_rows, resolved_block, suggestions, day_texts, fill_rates)}

WORDS = r"trim(regexp_replace(lower(strip_accents(replace({x}, 'ß', 'ss'))), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
SQL = {
    "email_syntax": f"SELECT row_id, email, regexp_matches(email, '{SYNTAX.replace(chr(39), chr(39) * 2)}') AND length(string_split(email, '@')[1]) <= 64 AS complete FROM (SELECT row_id, lower(trim(company_email)) AS email FROM scrape_final) WHERE email <> ''",
    "email_placeholders": """
SELECT row_id, string_split(email, '@')[1] IN (SELECT value FROM placeholder_values WHERE kind = 'local') OR string_split(email, '@')[-1] IN (SELECT value FROM placeholder_values WHERE kind = 'domain') AS stand_in
FROM (SELECT row_id, lower(trim(company_email)) AS email FROM scrape_final) WHERE email LIKE '%@%'""",
    "domain_countries": f"SELECT CASE string_split(h, '.')[-1] {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {chr(39)}{v}{chr(39)}' for k, v in COUNTRY_DOMAINS.items())} END AS country, count(*) AS entries FROM (SELECT {sql_host('candidate.website')} AS h FROM web_entries) WHERE h IS NOT NULL GROUP BY 1",
    "legal_forms": f"SELECT org_id, nullif(regexp_extract(coalesce(nullif(trim(legal_name), ''), trim(name)), '{FORM}', 1), '') AS form FROM jsonld_orgs",
    "web_names": f"""
WITH o AS (SELECT org_id, {sql_host("url")} AS h, legal_name, name FROM jsonld_orgs),
b AS (SELECT h, coalesce(arg_min(legal_name, org_id) FILTER (legal_name IS NOT NULL), arg_min(name, org_id) FILTER (name IS NOT NULL)) AS web_name FROM o WHERE h IS NOT NULL GROUP BY h)
SELECT entry_id, coalesce(web_name, candidate.name) AS name FROM web_entries LEFT JOIN b ON {sql_host("domain")} = b.h""",
    "crawl_once": """
WITH e AS (SELECT domain, entry_id, added_at, 0 AS source FROM dedup_entries UNION ALL SELECT domain, entry_id, added_at, 1 FROM web_entries)
SELECT domain, arg_min(entry_id, (source, added_at, entry_id)) AS entry_id FROM e WHERE domain IS NOT NULL GROUP BY 1""",
    "assembled_rows": "SELECT row_id, nullif(trim(company_name), '') AS company_name, nullif(trim(company_email), '') AS company_email, nullif(trim(website), '') AS website, country, nullif(trim(region), '') AS region, industry FROM scrape_final",
    "resolved_block": """
SELECT job_id, coalesce(len(list_filter(resolved.regions, lambda x: x.input IS NOT NULL)), 0) AS regions, coalesce(len(list_filter(resolved.industries, lambda x: x.input IS NOT NULL)), 0) AS industries,
  resolved.country.input IS NOT NULL AS country FROM scrape_resolve""",
    "suggestions": f"""
WITH t AS (SELECT DISTINCT {WORDS.format(x="input")} AS input FROM (SELECT unnest(list_transform(resolved.industries, lambda x: x.input)) AS input FROM scrape_resolve) WHERE input IS NOT NULL),
p AS (SELECT t.input, canon_id, levenshtein(t.input, {WORDS.format(x="name")}) AS edits FROM t, canon_values WHERE field = 'industry' AND t.input <> '')
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY input ORDER BY edits, canon_id) AS place FROM p) WHERE place <= 3""",
    "day_texts": "SELECT strftime(finished_at, '%Y-%m-%d') AS day, min(strftime(finished_at, '%Y-%m-%dT%H:%M:%SZ')) AS first, max(strftime(finished_at, '%Y-%m-%dT%H:%M:%SZ')) AS last, count(*) AS rows FROM scrape_final GROUP BY 1",
    "fill_rates": """
SELECT country, avg((trim(coalesce(company_name, '')) <> '')::INT) AS company_name, avg((trim(coalesce(company_email, '')) <> '')::INT) AS company_email, avg((trim(coalesce(website, '')) <> '')::INT) AS website,
  count(entry_id) - count(DISTINCT entry_id) AS repeats FROM scrape_final GROUP BY 1""",
}
