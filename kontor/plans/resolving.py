"""Queries that resolve typed inputs, match identities and choose names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kontor.functions.structured import page_organisations
from kontor.functions.text import folded, words
from kontor.functions.urls import registered_domain
from kontor.operators import similarity
from kontor.operators.joins import checked_broadcast
from kontor.plans.joins import FORMS
from kontor.session import cut
from kontor.sources.tables import table


def spelt(c) -> Column:
    """One spelling: folded, hyphens and underscores as blanks, single blanks."""
    return F.trim(F.regexp_replace(folded(c), r"[-_\s]+", " "))


def transliterated(c) -> Column:
    """SF-02: ä, ö and ü with their e, then :func:`words`."""
    c = F.lower(F.col(c) if isinstance(c, str) else c)
    return words(F.replace(F.replace(F.replace(c, F.lit("ä"), F.lit("ae")), F.lit("ö"), F.lit("oe")), F.lit("ü"), F.lit("ue")))


def named_without_forms(c) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(transliterated(c), FORMS, " "), r"\s+", " "))


def typed_inputs(spark: SparkSession, d: str) -> DataFrame:
    """field, cc (own country of a region, else empty) and input of all requests, each once."""
    r = table(spark, d, "scrape_resolve").select("resolved")
    country = r.select(F.lit("country").alias("field"), F.col("resolved.country.input").alias("input"))
    industry = r.select(F.lit("industry").alias("field"), F.explode("resolved.industries.input").alias("input"))
    return country.unionByName(industry).where("trim(input) <> ''").withColumn("q", spelt("input")).select("field", "q").where("q <> ''").distinct()


def reference_names(spark: SparkSession, d: str) -> DataFrame:
    """field, canon_id, name: every name, code and alias in one spelling."""
    c = table(spark, d, "canon_values").select("field", "canon_id", F.explode(F.concat(F.array("name", "code"), F.coalesce("aliases", F.array()))).alias("name"))
    return c.select("field", "canon_id", spelt("name").alias("name")).where("name <> ''").distinct()


def fuzzy_pick(scored: DataFrame, keys: list[str], choice: str, score: str, auto: float = 90, margin: float = 5, floor: float = 70, most: int = 3) -> DataFrame:
    """WI-10: ``keys``, picked, suggestions: the best choice of each key if its score is ``auto`` and leads the next by
    ``margin``, else null with the ``most`` best of ``floor`` or more (a top-k report), by score and then choice.

    One aggregation with a bounded result: only the best ``most`` of each key are kept by the rank of a window over few
    candidates a key (a fixed reference list)."""
    best = scored.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(choice).alias("c")))), 1, max(most, 2)).alias("b"))
    first, second = F.get("b", F.lit(0)), F.get("b", F.lit(1))
    sure = (-first["s"] >= auto) & (-first["s"] + F.coalesce(second["s"], F.lit(0.0)) >= margin)
    listed = F.transform(F.filter(F.slice("b", 1, most), lambda x: -x["s"] >= floor), lambda x: x["c"])
    return best.select(*keys, F.when(sure, first["c"]).alias("picked"), F.when(sure, F.array().cast("array<bigint>")).otherwise(listed).alias("suggestions"))


def resolve_ladder(spark: SparkSession, d: str) -> DataFrame:
    """RS-01, RS-03, WI-10: typed countries and industries by the ladder exact name, code or alias, then fuzzy with a margin,
    then suggestions. field, q (the input in one spelling), canon_id, method, suggestions.

    Distinct inputs meet the reference list of their field, which is fixed; its measured size decides on a broadcast."""
    names = reference_names(spark, d)
    typed = cut(typed_inputs(spark, d))
    exact = names.groupBy("field", F.col("name").alias("q")).agg(F.min("canon_id").alias("exact_id"))
    ladder = typed.join(checked_broadcast(exact), ["field", "q"], "left")
    open_ = ladder.where("exact_id is null").select("field", "q")
    near = open_.join(checked_broadcast(names), "field").withColumn("score", similarity.ratio("q", "name"))
    near = near.groupBy("field", "q", "canon_id").agg(F.max("score").alias("score"))
    picked = fuzzy_pick(near, ["field", "q"], "canon_id", "score")
    rows = ladder.join(picked, ["field", "q"], "left")
    method = F.when(F.col("exact_id").isNotNull(), "exact").when(F.col("picked").isNotNull(), "fuzzy")
    return rows.select("field", "q", F.coalesce("exact_id", "picked").alias("canon_id"), method.alias("method"), F.coalesce("suggestions", F.array().cast("array<bigint>")).alias("suggestions"))


def resolve_regions(spark: SparkSession, d: str) -> DataFrame:
    """RS-02, RS-04: typed regions within the request's own country by code, short code, name or alias, then fuzzy with a
    margin. A request whose country is unknown reports that first: method ``unknown_country``."""
    r = table(spark, d, "scrape_resolve").select("job_id", "resolved")
    countries = resolve_ladder(spark, d).where("field = 'country' and canon_id is not null").select("q", "canon_id")
    codes = table(spark, d, "canon_values").where("field = 'country'").select("canon_id", F.col("country_code").alias("cc"))
    country = checked_broadcast(countries.join(checked_broadcast(codes), "canon_id").select(F.col("q").alias("country"), "cc"))
    rows = r.select("job_id", spelt("resolved.country.input").alias("country"), F.posexplode("resolved.regions.input").alias("pos", "input")).where("input is not null")
    rows = cut(rows.join(country, "country", "left").select("job_id", "pos", "cc", spelt("input").alias("q")))
    regions = table(spark, d, "canon_values").where("field = 'region'")
    short = F.substring_index("code", "-", -1)
    names = regions.select(F.col("country_code").alias("cc"), F.col("canon_id").alias("region_id"), F.explode(F.concat(F.array("name", "code", short), F.coalesce("aliases", F.array()))).alias("name"))
    names = cut(names.select("cc", "region_id", spelt("name").alias("name")).where("name <> ''").distinct())
    exact = names.groupBy("cc", F.col("name").alias("q")).agg(F.min("region_id").alias("exact_id"))
    asked = rows.where("cc is not null").select("cc", "q").distinct().join(checked_broadcast(exact), ["cc", "q"], "left")
    asked = cut(asked)
    near = asked.where("exact_id is null").join(checked_broadcast(names), "cc").withColumn("score", similarity.ratio("q", "name")).groupBy("cc", "q", "region_id").agg(F.max("score").alias("score"))
    told = asked.join(fuzzy_pick(near, ["cc", "q"], "region_id", "score"), ["cc", "q"], "left")
    told = told.select("cc", "q", F.coalesce("exact_id", "picked").alias("canon_id"), F.when(F.col("exact_id").isNotNull(), "exact").when(F.col("picked").isNotNull(), "fuzzy").otherwise("unknown_region").alias("m"))
    out = rows.join(checked_broadcast(told), ["cc", "q"], "left")
    return out.select("job_id", "pos", "canon_id", F.when(F.col("cc").isNull(), "unknown_country").otherwise(F.col("m")).alias("method"))


def industry_search(spark: SparkSession, d: str) -> DataFrame:
    """WI-11: for each typed industry the three entries of the highest weighted ratio of 60 or more (a top-k report)."""
    typed = typed_inputs(spark, d).where("field = 'industry'")
    names = reference_names(spark, d).where("field = 'industry'")
    near = typed.join(checked_broadcast(names), "field").withColumn("score", similarity.best_ratio("q", "name"))
    best = near.groupBy("q", "canon_id").agg(F.max("score").alias("score")).where("score >= 60")
    top = best.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "canon_id"))), 1, 3).alias("t"))
    return top.select("q", F.posexplode("t").alias("i", "t")).select("q", (F.col("i") + 1).alias("place"), "t.canon_id", F.round(-F.col("t.s"), 4).alias("score"))


def identities(entries: DataFrame, lines: DataFrame, name_least: float = 85, alone_least: float = 95) -> DataFrame:
    """JO-07: entry, score, located, ok, reason: whether a site's lines name the company.

    ``entries``: entry, site, name, postal, city. ``lines``: site, line. Names and lines are compared without legal forms in
    one transliteration; a line counts if it holds every word of three letters or more of the name that is not its city's,
    and scores by the token-set ratio. With a postal code or city the site must show one of them (as a whole word) and score
    ``name_least``; without either it must score ``alone_least``. A name without such a word needs a line that equals it by
    ``alone_least``, and a place. Lines are first matched by their longest required word, so pairs are made within a site
    and a word; entries without a line of theirs score 0."""
    e = entries.select("entry", "site", "postal", transliterated("city").alias("city"), named_without_forms("name").alias("full"))
    distinct = F.filter(F.array_except(F.split("full", " "), F.split(F.coalesce("city", F.lit("")), " ")), lambda w: F.length(w) >= 3)
    e = cut(e.withColumn("need", distinct).withColumn("key", F.array_max(F.transform(F.col("need"), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]))
    told = cut(lines.select("site", transliterated("line").alias("plain"), named_without_forms("line").alias("named")).where("named <> ''").distinct())
    held = told.select("site", "named", F.explode(F.array_distinct(F.split("named", " "))).alias("key"))
    met = e.where("key is not null").join(held, ["site", "key"]).where(F.size(F.array_except("need", F.split("named", " "))) == 0).withColumn("score", similarity.set_ratio("full", "named"))
    plain = e.where("key is null and full <> ''").select("entry", "site", "full").join(told.select("site", F.col("named").alias("full")).distinct(), ["site", "full"]).select("entry", F.lit(100.0).alias("score"))
    scores = met.select("entry", "score").unionByName(plain).groupBy("entry").agg(F.max("score").alias("score"))
    # a place is one or more words in a row of a line
    code = F.trim(transliterated("postal"))
    places = e.select("entry", "site", F.explode(F.array_compact(F.array(F.when(code != "", code), F.when(F.col("city") != "", F.col("city"))))).alias("place"))
    shown = told.select("site", F.concat(F.lit(" "), "plain", F.lit(" ")).alias("plain"), F.explode(F.array_distinct(F.split("plain", " "))).alias("word"))
    located = places.withColumn("word", F.substring_index("place", " ", 1)).join(shown, ["site", "word"]).where(F.contains("plain", F.concat(F.lit(" "), F.col("place"), F.lit(" ")))).select("entry").distinct().withColumn("located", F.lit(True))
    out = e.join(scores, "entry", "left").join(located, "entry", "left").withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn("located", F.coalesce("located", F.lit(False)))
    nowhere = (F.coalesce(code, F.lit("")) == "") & (F.coalesce("city", F.lit("")) == "")
    ok = F.when(F.col("key").isNull(), F.col("located") & (F.col("score") >= alone_least)).when(nowhere, F.col("score") >= alone_least).otherwise(F.col("located") & (F.col("score") >= name_least))
    reason = F.when(ok, "").when(F.col("key").isNull(), "generic_name").when(F.col("score") < name_least, "name").when(nowhere, "name_only").otherwise("location")
    return out.select("entry", F.round("score", 4).alias("score"), "located", ok.alias("ok"), reason.alias("reason"))


def site_lines(spark: SparkSession, d: str) -> DataFrame:
    from kontor.functions import pages as P

    return table(spark, d, "site_pages").select(registered_domain("domain").alias("site"), F.explode(F.split(P.page_text(F.col("html")), "\n")).alias("line")).where("site is not null and line <> ''")


def identity_match(spark: SparkSession, d: str) -> DataFrame:
    """JO-07 over both sources and the crawled pages of their domains."""
    rows = [table(spark, d, t).select(F.col("entry_id").alias("entry"), registered_domain("domain").alias("site"), "candidate.name", "postal", F.lit(None).cast("string").alias("city")) for t in ("dedup_entries", "web_entries")]
    return identities(rows[0].unionByName(rows[1]).where("site is not null and name is not null"), site_lines(spark, d)).withColumnRenamed("entry", "entry_id")


def best_legal_name(spark: SparkSession, d: str) -> DataFrame:
    """WI-09: of the legal names of an entry's site the most similar one (token-set ratio of 60 or more, the earliest of
    equals), else the first."""
    o = table(spark, d, "jsonld_orgs").select("org_id", registered_domain("url").alias("site"), F.trim("legal_name").alias("legal")).where("site is not null and legal <> ''")
    o = o.groupBy("site", "legal").agg(F.min("org_id").alias("org_id"))
    e = table(spark, d, "web_entries").select("entry_id", registered_domain("domain").alias("site"), "candidate.name").where("site is not null and name is not null")
    s = e.join(o, "site").withColumn("score", similarity.set_ratio(words("name"), words("legal")))
    fit = F.when(F.col("score") >= 60, F.col("score")).otherwise(0.0)
    return s.groupBy("entry_id").agg(F.min_by("legal", F.struct(-fit, "org_id")).alias("legal_name"))


def name_after_crawl(spark: SparkSession, d: str) -> DataFrame:
    """JO-04: organisations found on pages joined with the map source's entries of one postal code and a token-set ratio of 92
    or more; candidates share their longest word, or the longest of one is a word of the other."""
    key = lambda c: F.upper(F.regexp_replace(c, r"\s+", ""))
    o = table(spark, d, "jsonld_orgs").select("org_id", key("postal_code").alias("postal"), named_without_forms(F.coalesce("legal_name", "name")).alias("a")).where("postal <> '' and a <> ''")
    e = table(spark, d, "dedup_entries").select("entry_id", key("postal").alias("postal"), named_without_forms("candidate.name").alias("b")).where("postal <> '' and b <> ''")
    pairs = similarity.names_alike(o.select("postal", "a").distinct(), e.select("postal", "b").distinct(), "postal", 92)
    return pairs.join(o, ["postal", "a"]).join(e, ["postal", "b"]).select("org_id", "entry_id").distinct()


def json_ld_organisations(spark: SparkSession, d: str) -> DataFrame:
    """SF-24: organisations of the JSON-LD blocks of pages, in order."""
    p = table(spark, d, "site_pages").where(F.contains("html", F.lit("ld+json"))).select("page_id", F.posexplode(page_organisations("html")).alias("pos", "o"))
    return p.select("page_id", "pos", "o.*")


QUERIES = {f.__name__: f for f in (resolve_ladder, resolve_regions, industry_search, identity_match, best_legal_name, name_after_crawl, json_ld_organisations)}
SQL: dict[str, str] = {}
