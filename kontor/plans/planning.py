"""Queries that plan and re-plan: specificity, re-allocation, top-up, pacing, sweeps, regions, social profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kontor.functions.hints import profiles
from kontor.functions.mails import page_addresses
from kontor.operators import state
from kontor.operators.allocation import numbered, water_fill
from kontor.operators.joins import checked_broadcast
from kontor.plans import aggregates
from kontor.sources.tables import table


def area_specificity(area_id):
    """SF-30: 0 for a country, for a subdivision 1 and the number of its ancestors, 3 for an area of the map or a name."""
    code = F.regexp_extract(area_id, r"(?i)^(?:iso:)?([a-z]{2}(?:-[a-z0-9]+)*)$", 1)
    return F.when(code == "", 3).otherwise(F.size(F.split(code, "-")) - 1)


def industry_specificity(profile_id):
    """AG-06: (level, fewer codes first): 2 for divisions by digits, 1 for sections by letters, 0 without codes."""
    codes = F.regexp_extract_all(F.upper(profile_id), F.lit(r"(?:^|[:,+])([0-9]{2}|[A-Z])(?=$|[:,+])"), F.lit(1))
    level = F.coalesce(F.array_max(F.transform(codes, lambda c: F.when(c.rlike("^[0-9]"), 2).otherwise(1))), F.lit(0))
    return F.struct(level.alias("level"), (-F.size(codes)).alias("few"))


def specific_assignment(spark: SparkSession, d: str) -> DataFrame:
    """WI-07: of the slices an entry was found in, the most specific area and the most specific industry, each on its own; the
    first of equals. Row-local, on the array."""
    e = table(spark, d, "dedup_entries")
    best = lambda rank, value: F.array_max(F.transform("found_in", lambda s, i: F.struct(rank(s).alias("r"), (-i).alias("first"), value(s).alias("v"))))["v"]
    return e.select(
        "entry_id",
        best(lambda s: area_specificity(s["area_id"]), lambda s: s["area_id"]).alias("area_id"),
        best(lambda s: industry_specificity(s["industry_profile_id"]), lambda s: s["industry_profile_id"]).alias("industry"),
    )


def rebalanced(spark: SparkSession, d: str) -> DataFrame:
    """AG-08: quotas after areas ran dry: an area whose entries with a site are less than half is exhausted and locked at them,
    the rest of the country's target goes evenly to the others."""
    c = table(spark, d, "dedup_entries").groupBy(F.col("slice.country_code").alias("country_code"), F.col("slice.area_id").alias("area_id")).agg(F.count(F.lit(1)).alias("n"), F.count("domain").alias("produced"))
    t = c.groupBy("country_code").agg(F.floor(F.sum("n") / 2).alias("total"))
    c = c.join(t, "country_code").withColumn("capacity", F.when(F.col("produced") * 2 < F.col("n"), F.col("produced")).otherwise(F.greatest("n", "total")))
    return water_fill(c, "country_code", "area_id", "capacity", "total")


def top_up(spark: SparkSession, d: str) -> DataFrame:
    """WI-06: the order in which a country's missing results are filled: entries with a site, then web entries, then entries to
    look up, each pool in turns round its areas; and the batch of each, 64 at a time."""
    cols = ["entry_id", F.col("slice.country_code").alias("country_code"), F.col("slice.area_id").alias("area_id"), "added_at"]
    a = table(spark, d, "dedup_entries").select(*cols, F.when(F.col("domain").isNotNull(), 0).otherwise(2).alias("pool"))
    rows = a.unionByName(table(spark, d, "web_entries").select(*cols, F.lit(1).alias("pool")))
    turns = numbered(rows, ["country_code", "pool", "area_id"], ["added_at", "entry_id"], "turn")
    placed = numbered(turns, ["country_code"], ["pool", "turn", "area_id"], "place")
    return placed.select("country_code", "entry_id", "pool", "place", F.ceil(F.col("place") / 64).alias("batch"))


def paced_fetches(spark: SparkSession, d: str) -> DataFrame:
    """ST-07: how long each page waits if a domain's pages are fetched one after another, a second each and two apart."""
    return state.paced(table(spark, d, "site_pages"), "domain", "fetched_at", "page_id", 1.0, 2.0).select("page_id", "wait_s")


def swept_jobs(spark: SparkSession, d: str) -> DataFrame:
    """ST-04: what a sweep does with each job, an hour and a half after the last one was received; the end of a job is its last
    finished row."""
    s = table(spark, d, "scrape_final").groupBy("job_id").agg(F.max("finished_at").alias("finished_at"))
    r = table(spark, d, "scrape_resolve").groupBy("job_id").agg(F.max("received_at").alias("created_at"), F.max("status").alias("status"))
    jobs = r.join(s, "job_id", "left").withColumn("started_at", F.lit(None).cast("timestamp")).withColumn("status", F.when(F.col("status") == "resolved", "success").otherwise(F.col("status")))
    last = table(spark, d, "scrape_resolve").agg(F.max("received_at")).first()[0]
    return state.swept(jobs, F.lit(last).cast("timestamp_ntz") + F.make_dt_interval(mins=F.lit(90))).select("job_id", "action")


def daily_requests(spark: SparkSession, d: str) -> DataFrame:
    """ST-08: whether an event is among the first five of its user and day."""
    return state.daily_limit(table(spark, d, "events"), "user_id", "ts", "event_id", 5).select("event_id", "allowed")


def paused_requests(spark: SparkSession, d: str) -> DataFrame:
    """ST-08: whether an event runs, if those of the first type pause their user for six hours."""
    e = table(spark, d, "events")
    first = e.agg(F.min("event_type")).first()[0]
    return state.breaker(e.withColumn("blocked", F.col("event_type") == F.lit(first)), "user_id", "ts", "event_id", "blocked", 21600).select("event_id", "ran")


def region_confidence(spark: SparkSession, d: str) -> DataFrame:
    """FI-10: how surely an entry lies in its area: high for the map source; else by its postal code if it and the area's are
    known; else by its place's name; else low."""
    p = table(spark, d, "poi_elements")
    code = lambda c: F.upper(F.regexp_replace(c, r"\s+", ""))
    codes = p.select("area_id", F.explode(F.split(F.col("tags")["addr:postcode"], "[;,]")).alias("c")).select("area_id", code("c").alias("code")).where("code <> ''").distinct()
    areas = codes.select("area_id").distinct().withColumn("known", F.lit(True))
    places = p.select("area_id", F.lower(F.trim(F.col("tags")["addr:city"])).alias("place")).where("place <> ''").distinct()
    cols = lambda t, s: table(spark, d, t).select("entry_id", F.lit(s).alias("source"), F.col("slice.area_id").alias("area_id"), code("postal").alias("code"), F.lower(F.trim(F.col("candidate.hints")["city"])).alias("place"), F.col("candidate.hints")["area_match"].alias("match"))
    e = cols("dedup_entries", "map").unionByName(cols("web_entries", "web"))
    e = e.join(checked_broadcast(areas), "area_id", "left").join(checked_broadcast(codes.withColumn("inside", F.lit(True))), ["area_id", "code"], "left")
    e = e.join(checked_broadcast(places.withColumn("there", F.lit(True))), ["area_id", "place"], "left")
    high = F.when((F.col("source") == "map") | (F.col("match") == "source"), True).when((F.col("code") != "") & F.col("known"), F.coalesce("inside", F.lit(False))).otherwise(F.coalesce("there", F.lit(False)))
    return e.select("entry_id", F.when(high, "high").otherwise("low").alias("confidence"))


def social_profiles(pages: DataFrame) -> DataFrame:
    """AG-10: profiles of each domain by platform with the number of pages that link them, those of most pages first and then
    those the home page links; the first is official. ``pages``: domain, url, kind, html."""
    p = pages.where("html is not null").select("domain", "url", (F.col("kind") == "home").alias("home"), F.explode(profiles(F.col("html"))).alias("platform", "found"))
    p = p.select("domain", "platform", "url", "home", F.explode("found").alias("profile")).groupBy("domain", "platform", "profile").agg(F.count_distinct("url").alias("pages"), F.max("home").alias("home"))
    return numbered(p, ["domain", "platform"], [-F.col("pages"), ~F.col("home"), F.col("profile")], "place").withColumn("official", F.col("place") == 1)


def page_emails(spark: SparkSession, d: str) -> DataFrame:
    """SF-12, SF-13: the plausible addresses of each page, plain, linked, hidden and disguised, without listed stand-ins."""
    p = table(spark, d, "site_pages").select("page_id", F.explode(page_addresses(F.col("html"))).alias("email"))
    listed = table(spark, d, "placeholder_values").select("kind", F.lower("value").alias("value")).distinct()
    p = p.withColumn("local", F.substring_index("email", "@", 1)).withColumn("domain", F.substring_index("email", "@", -1))
    for kind in ("local", "domain"):
        p = p.join(checked_broadcast(listed.where(F.col("kind") == kind).select(F.col("value").alias(kind))), kind, "left_anti")
    return p.select("page_id", "email")


QUERIES = {
    f.__name__: f
    for f in (specific_assignment, rebalanced, top_up, paced_fetches, swept_jobs, daily_requests, paused_requests, region_confidence, page_emails)
}

SPECIFIC = "CASE WHEN regexp_matches({x}, '^(iso:)?[a-z]{{2}}(-[a-z0-9]+)*$', 'i') THEN len(string_split({x}, '-')) - 1 ELSE 3 END"
SQL = {
    "specific_assignment": f"""
WITH e AS (SELECT entry_id, unnest(generate_series(0, len(found_in) - 1)) AS pos, unnest(list_transform(found_in, lambda x: x.area_id)) AS area, unnest(list_transform(found_in, lambda x: x.industry_profile_id)) AS ind FROM dedup_entries),
b AS (SELECT entry_id, arg_max(area, ({SPECIFIC.format(x="area")}, -pos)) AS area_id,
  arg_max(ind, (coalesce(list_max(list_transform(regexp_extract_all(upper(ind), '(?:^|[:,+])([0-9]{{2}}|[A-Z])(?:$|[:,+])', 1), lambda c: CASE WHEN regexp_matches(c, '^[0-9]') THEN 2 ELSE 1 END)), 0), -len(regexp_extract_all(upper(ind), '(?:^|[:,+])([0-9]{{2}}|[A-Z])(?:$|[:,+])', 1)), -pos)) AS industry FROM e GROUP BY 1)
SELECT d.entry_id, area_id, industry FROM dedup_entries d LEFT JOIN b ON d.entry_id = b.entry_id""",
    "rebalanced": aggregates.SQL["quota_waterfill"].replace(
        "WITH c AS (SELECT slice.country_code AS country_code, slice.area_id AS area_id, count(*) AS cap FROM dedup_entries GROUP BY 1, 2),\nt AS (SELECT country_code, sum(cap) // 2 AS total, max(cap) AS top FROM c GROUP BY 1),",
        """WITH n AS (SELECT slice.country_code AS country_code, slice.area_id AS area_id, count(*) AS n, count(domain) AS made FROM dedup_entries GROUP BY 1, 2),
c AS (SELECT country_code, area_id, CASE WHEN made * 2 < n THEN made ELSE greatest(n, ((sum(n) OVER (PARTITION BY country_code)) // 2)::BIGINT) END AS cap FROM n),
t AS (SELECT c.country_code, any_value(h) AS total, max(cap) AS top FROM c JOIN (SELECT country_code, (sum(n) // 2)::BIGINT AS h FROM n GROUP BY 1) s ON c.country_code = s.country_code GROUP BY 1),""",
    ),
    "top_up": """
WITH u AS (SELECT entry_id, slice.country_code AS country_code, slice.area_id AS area_id, added_at, CASE WHEN domain IS NOT NULL THEN 0 ELSE 2 END AS pool FROM dedup_entries
  UNION ALL SELECT entry_id, slice.country_code, slice.area_id, added_at, 1 FROM web_entries),
t AS (SELECT *, row_number() OVER (PARTITION BY country_code, pool, area_id ORDER BY added_at, entry_id) AS turn FROM u),
p AS (SELECT *, row_number() OVER (PARTITION BY country_code ORDER BY pool, turn, area_id) AS place FROM t)
SELECT country_code, entry_id, pool, place, ceil(place / 64)::BIGINT AS batch FROM p""",
    "paced_fetches": """
WITH n AS (SELECT page_id, domain, epoch_us(fetched_at) AS r, row_number() OVER (PARTITION BY domain ORDER BY fetched_at, page_id) AS n FROM site_pages)
SELECT page_id, (n * 3000000 + max(r - n * 3000000) OVER (PARTITION BY domain ORDER BY n) - r) / 1e6 AS wait_s FROM n""",
    "swept_jobs": """
WITH s AS (SELECT job_id, max(finished_at) AS f FROM scrape_final GROUP BY 1), r AS (SELECT job_id, max(received_at) AS c, max(status) AS st FROM scrape_resolve GROUP BY 1),
j AS (SELECT r.job_id, c, f, CASE st WHEN 'resolved' THEN 'success' ELSE st END AS st, (SELECT max(c) FROM r) + INTERVAL 90 MINUTE AS now FROM r LEFT JOIN s ON r.job_id = s.job_id)
SELECT job_id, CASE WHEN st IN ('queued', 'running') AND epoch_us(now) - epoch_us(c) >= 7200000000 THEN 'time_out' WHEN st = 'success' AND epoch_us(now) - epoch_us(coalesce(f, c)) >= 900000000 THEN 'expire_success'
  WHEN st = 'failed' AND epoch_us(now) - epoch_us(coalesce(f, c)) >= 1800000000 THEN 'expire_failed' WHEN st = 'cancelled' THEN 'remove_cancelled' ELSE 'keep' END AS action FROM j""",
    "daily_requests": "SELECT event_id, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) <= 5 AS allowed FROM events",
    "region_confidence": r"""
WITH p AS (SELECT DISTINCT area_id, upper(regexp_replace(unnest(regexp_split_to_array(tags['addr:postcode'], '[;,]')), '\s+', '', 'g')) AS code FROM poi_elements WHERE tags['addr:postcode'] IS NOT NULL),
k AS (SELECT * FROM p WHERE code <> ''), c AS (SELECT DISTINCT area_id, lower(trim(tags['addr:city'])) AS place FROM poi_elements WHERE trim(tags['addr:city']) <> ''),
e AS (SELECT entry_id, 'map' AS source, slice.area_id AS area_id, upper(regexp_replace(postal, '\s+', '', 'g')) AS code, lower(trim(candidate.hints['city'])) AS place, candidate.hints['area_match'] AS m FROM dedup_entries
  UNION ALL SELECT entry_id, 'web', slice.area_id, upper(regexp_replace(postal, '\s+', '', 'g')), lower(trim(candidate.hints['city'])), candidate.hints['area_match'] FROM web_entries)
SELECT entry_id, CASE WHEN CASE WHEN source = 'map' OR m = 'source' THEN true WHEN e.code <> '' AND e.area_id IN (SELECT area_id FROM k WHERE area_id IS NOT NULL) THEN k.code IS NOT NULL ELSE c.place IS NOT NULL END
  THEN 'high' ELSE 'low' END AS confidence FROM e LEFT JOIN k ON e.area_id = k.area_id AND e.code = k.code LEFT JOIN c ON e.area_id = c.area_id AND e.place = c.place""",
}
