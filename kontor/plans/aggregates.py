"""Aggregations, rankings, set operations and timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kontor.operators import timeline
from kontor.operators.allocation import first_per, numbered, take_quota, water_fill
from kontor.operators.joins import checked_broadcast
from kontor.sources.tables import table

BOUNDS = (0.2, 0.4, 0.6, 0.8)


def findings_merge(spark: SparkSession, d: str) -> DataFrame:
    """AG-01: addresses of the company rows by lower case: first page, whether any was on a legal page or in JSON-LD."""
    f = table(spark, d, "scrape_final").select("row_id", "scored_email.finding.*").where("trim(email) <> ''")
    return f.groupBy(F.lower("email").alias("email")).agg(F.min_by("source_url", "row_id").alias("source_url"), F.max("on_legal_notice").alias("on_legal_notice"), F.max("from_jsonld").alias("from_jsonld"), F.count(F.lit(1)).alias("findings"))


def slice_stats(spark: SparkSession, d: str) -> DataFrame:
    """AG-02: candidates, with website and with email of each area and industry, and the share with email."""
    e = table(spark, d, "dedup_entries").select("slice.area_id", "slice.industry_profile_id", "domain", F.col("candidate.hints")["email"].alias("email"))
    n = e.groupBy("area_id", "industry_profile_id").agg(F.count(F.lit(1)).alias("candidates"), F.count("domain").alias("with_site"), F.count("email").alias("with_email"))
    return n.withColumn("ratio", F.col("with_email") / F.col("candidates"))


def slice_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Candidates by country and area, with subtotals."""
    e = table(spark, d, "dedup_entries").select(F.col("slice.country_code").alias("country_code"), F.col("slice.area_id").alias("area_id"))
    return e.rollup("country_code", "area_id").agg(F.count(F.lit(1)).alias("candidates"), F.grouping_id().cast("int").alias("level"))


def found_in_labels(spark: SparkSession, d: str) -> DataFrame:
    """AG-04, SL-06: distinct region labels an entry was found in, sorted; row-local."""
    return table(spark, d, "dedup_entries").select("entry_id", F.array_sort(F.array_distinct(F.filter(F.col("found_in.region_label"), lambda x: x.isNotNull()))).alias("labels"))


def event_counters(spark: SparkSession, d: str) -> DataFrame:
    """AG-05: events by type and day."""
    return table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("value"))


def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    """AG-05: address scores in buckets, by country."""
    s = table(spark, d, "scrape_final").select("country", F.col("scored_email.score").alias("score")).where("score is not null")
    bucket = F.lit(0)
    for b in BOUNDS:
        bucket = bucket + (F.col("score") > b).cast("int")
    return s.groupBy("country", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))


def running_progress(spark: SparkSession, d: str) -> DataFrame:
    """AG-03: how many rows each job had finished when a row of it was."""
    w = Window.partitionBy("job_id").orderBy("finished_at", "row_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "scrape_final").select("row_id", "job_id", F.count(F.lit(1)).over(w).alias("done"), F.count("scored_email").over(w).alias("with_email"))


def quota_waterfill(spark: SparkSession, d: str) -> DataFrame:
    """AG-07: half of each country's candidates spread evenly over its areas, none beyond what it has."""
    c = table(spark, d, "dedup_entries").groupBy(F.col("slice.country_code").alias("country_code"), F.col("slice.area_id").alias("area_id")).agg(F.count(F.lit(1)).alias("capacity"))
    t = c.groupBy("country_code").agg(F.floor(F.sum("capacity") / 2).alias("total"))
    return water_fill(c.join(t, "country_code"), "country_code", "area_id", "capacity", "total")


def overfetch(spark: SparkSession, d: str) -> DataFrame:
    """AG-09: how many candidates to ask for in each slice of an entry, half again its quota."""
    return table(spark, d, "dedup_entries").select("entry_id", F.greatest(F.col("slice.quota"), F.ceil(F.col("slice.quota") * F.lit(1.5)).cast("int")).alias("target"))


def best_email(spark: SparkSession, d: str) -> DataFrame:
    """WI-01, WI-02: the best scored address of each entry, the first found among equals; one aggregation."""
    s = table(spark, d, "scrape_final").select("entry_id", F.lower("company_email").alias("email"), F.col("scored_email.score").alias("score"), "row_id").where("score is not null and email like '%@%.%'")
    return first_per(s, ["entry_id"], [-F.col("score"), F.col("row_id")]).select("entry_id", "email", "score")


def tiered_order(spark: SparkSession, d: str) -> DataFrame:
    """WI-03: entries of an area by what they tell: a site, a mailbox, nothing; then by order of adding."""
    e = table(spark, d, "dedup_entries")
    tier = F.when(F.col("domain").isNotNull(), 0).when(F.col("candidate.hints")["email"].isNotNull(), 1).otherwise(2)
    rows = e.select("entry_id", F.col("slice.area_id").alias("area_id"), tier.alias("tier"), "added_at")
    return numbered(rows, ["area_id"], ["tier", "added_at", "entry_id"], "place").drop("added_at")


def quota_take(spark: SparkSession, d: str) -> DataFrame:
    """WI-04: the entries of each slice within its quota, and the surplus."""
    e = table(spark, d, "dedup_entries").select("entry_id", "added_at", F.col("slice.area_id").alias("area_id"), F.col("slice.industry_profile_id").alias("industry"), F.col("slice.quota").alias("quota"))
    most = e.groupBy(F.col("area_id").alias("_a"), F.col("industry").alias("_i")).agg(F.max("quota").alias("quota"))
    q = e.drop("quota").join(checked_broadcast(most), F.col("area_id").eqNullSafe(F.col("_a")) & F.col("industry").eqNullSafe(F.col("_i"))).drop("_a", "_i")
    return take_quota(q, ["area_id", "industry"], ["added_at", "entry_id"], "quota").select("entry_id", "area_id", "industry", "place", "taken")


def round_robin_order(spark: SparkSession, d: str) -> DataFrame:
    """WI-05: entries of each country in turns round its areas."""
    e = table(spark, d, "dedup_entries").select("entry_id", "added_at", F.col("slice.country_code").alias("country_code"), F.col("slice.area_id").alias("area_id"))
    turns = numbered(e, ["country_code", "area_id"], ["added_at", "entry_id"], "turn")
    return numbered(turns, ["country_code"], ["turn", "area_id"], "place").select("entry_id", "country_code", "turn", "place")


def frequent_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Of the slices an entry was found in, its most frequent industry and area, each on its own, the first of equals."""
    e = table(spark, d, "dedup_entries").select("entry_id", F.posexplode("found_in").alias("pos", "s"))
    out = None
    for field, name in (("area_id", "area_id"), ("industry_profile_id", "industry")):
        n = e.groupBy("entry_id", F.col(f"s.{field}").alias(name)).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("at"))
        best = n.groupBy("entry_id").agg(F.min_by(name, F.struct(-F.col("n"), "at")).alias(name))
        out = best if out is None else out.join(best, "entry_id")
    return out


def newest_lead(spark: SparkSession, d: str) -> DataFrame:
    """Of the pages of a domain the newest, and by how many seconds it leads the one before."""
    p = table(spark, d, "site_pages").select("domain", "page_id", "fetched_at")
    w = Window.partitionBy("domain").orderBy(F.col("fetched_at").desc(), F.col("page_id").desc())
    lead = F.unix_micros(F.col("fetched_at").cast("timestamp")) / 1e6 - F.unix_micros(F.lead("fetched_at").over(w).cast("timestamp")) / 1e6
    return p.select("domain", "page_id", lead.alias("lead_s"), F.row_number().over(w).alias("i")).where("i = 1").drop("i")


def domain_gap(spark: SparkSession, d: str) -> DataFrame:
    """WI-12: seconds between an event of a user and the end of the one before; an event takes its value in seconds."""
    e = table(spark, d, "events").select("event_id", "user_id", F.col("ts").alias("start"), (F.col("ts") + F.make_dt_interval(secs=F.lit(30))).alias("stop"))
    return timeline.gaps(e, "user_id", "start", "stop").select("event_id", "user_id", "gap_s")


def max_in_flight(spark: SparkSession, d: str) -> DataFrame:
    """WI-12: most events of a type at once, each lasting an hour."""
    e = table(spark, d, "events").select("event_type", F.col("ts").alias("start"), (F.col("ts") + F.make_dt_interval(hours=F.lit(1))).alias("stop"))
    return timeline.most_at_once(e, "event_type", "start", "stop")


def time_to_fifth(spark: SparkSession, d: str) -> DataFrame:
    """WI-13: seconds from a user's first event to the fifth."""
    return timeline.nth_after(table(spark, d, "events"), "user_id", "ts", 5)


def token_bucket(spark: SparkSession, d: str) -> DataFrame:
    """ST-06: verdict of a token bucket of each user on each event."""
    return timeline.token_bucket(table(spark, d, "events"), "user_id", "ts", "event_id", rate=1 / 3600, burst=3.0)


def last_state(spark: SparkSession, d: str) -> DataFrame:
    """ST-02: each user's last event, by one aggregation."""
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.max("ts").alias("at"), F.count(F.lit(1)).alias("events"))


def late_rows(spark: SparkSession, d: str) -> DataFrame:
    """Company rows loaded more than a day after they were finished, by job."""
    s = table(spark, d, "scrape_final")
    late = F.unix_micros(F.col("loaded_at").cast("timestamp")) - F.unix_micros(F.col("finished_at").cast("timestamp")) > 86_400_000_000
    return s.groupBy("job_id").agg(F.sum(late.cast("int")).alias("late"), F.count(F.lit(1)).alias("rows"))


def ordered_page(spark: SparkSession, d: str) -> DataFrame:
    """SL-02: the second page of fifty entries by name and id (paging is the feature)."""
    return table(spark, d, "dedup_entries").select("entry_id", "norm_name").orderBy(F.col("norm_name").asc_nulls_last(), "entry_id").offset(50).limit(50)


def both_sources(spark: SparkSession, d: str) -> DataFrame:
    """SL-07: domains that both sources know."""
    a, b = (table(spark, d, t).where("domain is not null").select("domain") for t in ("dedup_entries", "web_entries"))
    return a.intersect(b)


def typed_industries(spark: SparkSession, d: str) -> DataFrame:
    """SL-08: distinct industries of each request in order of mention, as one text."""
    r = table(spark, d, "scrape_resolve")
    return r.select("job_id", F.array_join(F.array_distinct(F.transform("resolved.industries.input", lambda x: F.lower(F.trim(x)))), "; ").alias("industries"))


QUERIES = {
    f.__name__: f
    for f in (
        findings_merge, slice_stats, slice_rollup, found_in_labels, event_counters, score_histogram, running_progress, quota_waterfill, overfetch, best_email, tiered_order, quota_take,
        round_robin_order, frequent_assignment, newest_lead, domain_gap, max_in_flight, time_to_fifth, token_bucket, last_state, late_rows, ordered_page, both_sources, typed_industries,
    )
}

SQL = {
    "findings_merge": """
SELECT lower(scored_email.finding.email) AS email, arg_min(scored_email.finding.source_url, row_id) AS source_url, bool_or(scored_email.finding.on_legal_notice) AS on_legal_notice,
  bool_or(scored_email.finding.from_jsonld) AS from_jsonld, count(*) AS findings FROM scrape_final WHERE trim(scored_email.finding.email) <> '' GROUP BY 1""",
    "slice_stats": """
SELECT slice.area_id AS area_id, slice.industry_profile_id AS industry_profile_id, count(*) AS candidates, count(domain) AS with_site, count(candidate.hints['email']) AS with_email,
  count(candidate.hints['email']) / count(*) AS ratio FROM dedup_entries GROUP BY 1, 2""",
    "slice_rollup": "SELECT c AS country_code, a AS area_id, count(*) AS candidates, grouping(c, a) AS level FROM (SELECT slice.country_code AS c, slice.area_id AS a FROM dedup_entries) GROUP BY ROLLUP (c, a)",
    "found_in_labels": "SELECT entry_id, list_sort(list_distinct(list_transform(found_in, lambda x: x.region_label))) AS labels FROM dedup_entries",
    "event_counters": "SELECT event_type, ts::DATE AS day, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
    "score_histogram": "SELECT country, " + " + ".join(f"(s > {b})::INT" for b in BOUNDS) + " AS bucket, count(*) AS rows FROM (SELECT country, scored_email.score AS s FROM scrape_final) WHERE s IS NOT NULL GROUP BY 1, 2",
    "running_progress": """
SELECT row_id, job_id, count(*) OVER w AS done, count(scored_email) OVER w AS with_email FROM scrape_final WINDOW w AS (PARTITION BY job_id ORDER BY finished_at, row_id ROWS UNBOUNDED PRECEDING)""",
    "quota_waterfill": """
WITH c AS (SELECT slice.country_code AS country_code, slice.area_id AS area_id, count(*) AS cap FROM dedup_entries GROUP BY 1, 2),
t AS (SELECT country_code, sum(cap) // 2 AS total, max(cap) AS top FROM c GROUP BY 1),
l AS (SELECT t.country_code, max(level) AS level FROM (SELECT country_code, total, unnest(generate_series(0, top)) AS level FROM t) t
      WHERE (SELECT sum(least(cap, level)) FROM c WHERE c.country_code = t.country_code) <= total GROUP BY 1),
b AS (SELECT c.*, least(cap, level) AS base, cap > level AS room, total FROM c JOIN l USING (country_code) JOIN t USING (country_code))
SELECT country_code, area_id, base + CASE WHEN room AND row_number() OVER (PARTITION BY country_code ORDER BY NOT room, area_id) <= total - sum(base) OVER (PARTITION BY country_code) THEN 1 ELSE 0 END AS quota FROM b""",
    "overfetch": "SELECT entry_id, greatest(slice.quota, ceil(slice.quota * 1.5)::INT) AS target FROM dedup_entries",
    "best_email": """
SELECT entry_id, email, score FROM (SELECT entry_id, lower(company_email) AS email, scored_email.score AS score, row_number() OVER (PARTITION BY entry_id ORDER BY scored_email.score DESC, row_id) AS rn
  FROM scrape_final WHERE scored_email.score IS NOT NULL AND company_email LIKE '%@%.%') WHERE rn = 1""",
    "tiered_order": """
SELECT entry_id, area_id, tier, row_number() OVER (PARTITION BY area_id ORDER BY tier, added_at, entry_id) AS place FROM (
  SELECT entry_id, slice.area_id AS area_id, added_at, CASE WHEN domain IS NOT NULL THEN 0 WHEN candidate.hints['email'] IS NOT NULL THEN 1 ELSE 2 END AS tier FROM dedup_entries)""",
    "quota_take": """
SELECT entry_id, area_id, industry, place, place <= quota AS taken FROM (
  SELECT entry_id, slice.area_id AS area_id, slice.industry_profile_id AS industry, row_number() OVER (PARTITION BY slice.area_id, slice.industry_profile_id ORDER BY added_at, entry_id) AS place,
    max(slice.quota) OVER (PARTITION BY slice.area_id, slice.industry_profile_id) AS quota FROM dedup_entries)""",
    "round_robin_order": """
WITH t AS (SELECT entry_id, slice.country_code AS country_code, slice.area_id AS area_id, row_number() OVER (PARTITION BY slice.country_code, slice.area_id ORDER BY added_at, entry_id) AS turn FROM dedup_entries)
SELECT entry_id, country_code, turn, row_number() OVER (PARTITION BY country_code ORDER BY turn, area_id) AS place FROM t""",
    "frequent_assignment": """
WITH e AS (SELECT entry_id, unnest(generate_series(0, len(found_in) - 1)) AS pos, unnest(list_transform(found_in, lambda x: x.area_id)) AS area_id, unnest(list_transform(found_in, lambda x: x.industry_profile_id)) AS industry FROM dedup_entries),
a AS (SELECT entry_id, area_id, row_number() OVER (PARTITION BY entry_id ORDER BY count(*) DESC, min(pos)) AS rn FROM e GROUP BY 1, 2),
i AS (SELECT entry_id, industry, row_number() OVER (PARTITION BY entry_id ORDER BY count(*) DESC, min(pos)) AS rn FROM e GROUP BY 1, 2)
SELECT a.entry_id, area_id, industry FROM a JOIN i ON a.entry_id = i.entry_id AND a.rn = 1 AND i.rn = 1""",
    "newest_lead": """
SELECT domain, page_id, lead_s FROM (SELECT domain, page_id, (epoch_us(fetched_at) - epoch_us(lead(fetched_at) OVER w)) / 1e6 AS lead_s, row_number() OVER w AS i
  FROM site_pages WINDOW w AS (PARTITION BY domain ORDER BY fetched_at DESC, page_id DESC)) WHERE i = 1""",
    "domain_gap": "SELECT event_id, user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) - 30000000) / 1e6 AS gap_s FROM events",
    "max_in_flight": """
WITH p AS (SELECT event_type, ts AS t, 1 AS s, 0 AS e FROM events UNION ALL SELECT event_type, ts + INTERVAL 1 HOUR, 0, -1 FROM events),
g AS (SELECT event_type, t, sum(s) + sum(e) AS d FROM p GROUP BY 1, 2)
SELECT event_type, max(now) AS most FROM (SELECT event_type, sum(d) OVER (PARTITION BY event_type ORDER BY t) AS now FROM g) GROUP BY 1""",
    "time_to_fifth": """
SELECT user_id, (epoch_us(ts) - epoch_us(t0)) / 1e6 AS seconds FROM (SELECT user_id, ts, min(ts) OVER (PARTITION BY user_id) AS t0, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events) WHERE i = 5""",
    "token_bucket": """
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
b AS (SELECT user_id, event_id, i, t, 2.0::DOUBLE AS tokens, true AS allowed FROM e WHERE i = 1
  UNION ALL SELECT user_id, event_id, i, t, CASE WHEN have >= 1 THEN have - 1 ELSE have END, have >= 1
  FROM (SELECT e.user_id, e.event_id, e.i, e.t, least(3.0, b.tokens + greatest(0.0, e.t - b.t) * (1 / 3600)) AS have FROM b JOIN e ON e.user_id = b.user_id AND e.i = b.i + 1))
SELECT user_id, event_id, allowed FROM b""",
    "last_state": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, max(ts) AS at, count(*) AS events FROM events GROUP BY 1",
    "late_rows": "SELECT job_id, sum((epoch_us(loaded_at) - epoch_us(finished_at) > 86400000000)::INT) AS late, count(*) AS rows FROM scrape_final GROUP BY 1",
    "ordered_page": "SELECT entry_id, norm_name FROM dedup_entries ORDER BY norm_name NULLS LAST, entry_id LIMIT 50 OFFSET 50",
    "both_sources": "SELECT domain FROM dedup_entries WHERE domain IS NOT NULL INTERSECT SELECT domain FROM web_entries",
    "typed_industries": """
WITH t AS (SELECT job_id, unnest(generate_series(0, len(resolved.industries) - 1)) AS pos, unnest(list_transform(resolved.industries, lambda x: lower(trim(x.input)))) AS i FROM scrape_resolve),
f AS (SELECT job_id, i, min(pos) AS pos FROM t WHERE i IS NOT NULL GROUP BY 1, 2), g AS (SELECT job_id, string_agg(i, '; ' ORDER BY pos) AS industries FROM f GROUP BY 1)
SELECT s.job_id, coalesce(industries, '') AS industries FROM scrape_resolve s LEFT JOIN g ON s.job_id = g.job_id""",
}
