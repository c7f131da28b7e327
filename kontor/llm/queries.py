"""Queries of the training-data problems, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kontor.llm import addresses as p3
from kontor.llm import canonical as p4
from kontor.llm import leaks as p8
from kontor.llm import linkage as p2
from kontor.llm import names as p6
from kontor.llm import personal as p9
from kontor.llm import residue as p5
from kontor.llm import survivors as p1
from kontor.llm import tokenize as p7
from kontor.sources.tables import table


def p1_values(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows, entries = table(spark, d, "scrape_final"), table(spark, d, "dedup_entries")
    repeated = rows.groupBy(F.col("entry_id").alias("entity")).count().where("count >= 2").select("entity")
    claims = p1.company_claims(rows, entries).join(repeated, "entity", "left_semi")
    return p1.truth_discovery(claims)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The evidence that the problem states ranks the values, the converged support decides between equal ones; for names
    of one length the problem states the smallest row."""
    values, _ = p1_values(spark, d)
    return p1.survivors(values, "evidence", ("company_name",)).select(F.col("entity").alias("entry_id"), "field", F.col("row").alias("row_id"))


def p1_trusted(spark: SparkSession, d: str) -> DataFrame:
    """The values of highest converged support, evidence deciding between equal ones."""
    values, _ = p1_values(spark, d)
    return p1.survivors(values).select(F.col("entity").alias("entry_id"), "field", "value", F.round("support", 6).alias("support"))


def p1_sources(spark: SparkSession, d: str) -> DataFrame:
    return p1_values(spark, d)[1]


def p2_matches(spark: SparkSession, d: str) -> DataFrame:
    matches = p2.same_place_pairs(p2.prepared(table(spark, d, "dedup_entries")), p2.prepared(table(spark, d, "web_entries")))
    return matches.select(F.col("a_id").alias("osm_entry_id"), F.col("b_id").alias("web_entry_id"), F.col("posterior").alias("confidence"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_matches(spark, d).select("osm_entry_id", "web_entry_id")


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    orgs = table(spark, d, "jsonld_orgs").select(F.col("org_id").alias("id"), F.col("address_text").alias("text"), F.col("postal_code").alias("pc_given"))
    legal = table(spark, d, "address_results").select(F.col("addr_id").alias("id"), F.col("address").alias("text"), F.col("postal_code").alias("pc_given"))
    return p3.same_places(orgs.unionByName(legal))[0]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p6.pairs_of(p3_groups(spark, d), "place")


def p3_places(spark: SparkSession, d: str) -> DataFrame:
    """Each record with its place and the number of other records there: the linear form of p3_found."""
    return p6.members(p3_groups(spark, d), "place")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4.resolved_inputs(table(spark, d, "scrape_resolve"), table(spark, d, "canon_values"))


def p5_reasons(spark: SparkSession, d: str) -> DataFrame:
    return p5.excluded_pages(table(spark, d, "site_pages"), table(spark, d, "placeholder_values"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_reasons(spark, d).select("page_id")


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    return p6.organisations(table(spark, d, "poi_elements"), table(spark, d, "jsonld_orgs"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6.pairs_of(p6_groups(spark, d), "org")


def p6_orgs(spark: SparkSession, d: str) -> DataFrame:
    """Each named record with its organisation and the number of other records of it: the linear form of p6_found."""
    return p6.members(p6_groups(spark, d), "org")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return p7.encode_corpus(table(spark, d, "documents"))


def p8_passages(spark: SparkSession, d: str) -> DataFrame:
    return p8.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_passages(spark, d).select("doc_id", "item_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9.found(table(spark, d, "documents"))


def p9_sanitised(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return p9.sanitised(docs, p9.spans(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_trusted": p1_trusted,
    "p1_sources": p1_sources,
    "p2_found": p2_found,
    "p2_matches": p2_matches,
    "p3_found": p3_found,
    "p3_places": p3_places,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_reasons": p5_reasons,
    "p6_found": p6_found,
    "p6_orgs": p6_orgs,
    "p7_ids": p7_ids,
    "p8_found": p8_found,
    "p8_passages": p8_passages,
    "p9_found": p9_found,
    "p9_sanitised": p9_sanitised,
}

SQL: dict[str, str] = {
    "p1_found": """
WITH r AS (
  SELECT entry_id, row_id, finished_at, scored_email.score AS score,
         trim(company_name) AS company_name, trim(company_email) AS company_email, trim(website) AS website, trim(region) AS region
  FROM scrape_final WHERE entry_id IN (SELECT entry_id FROM scrape_final GROUP BY 1 HAVING count(*) >= 2)
), labels AS (
  SELECT entry_id, label, count(*) AS n FROM (
    SELECT entry_id, unnest(list_transform(found_in, lambda x: x.region_label)) AS label FROM dedup_entries) WHERE label IS NOT NULL GROUP BY 1, 2
), top AS (
  SELECT entry_id, max(label) AS label FROM (SELECT *, max(n) OVER (PARTITION BY entry_id) AS m FROM labels) WHERE n = m GROUP BY 1 HAVING count(*) = 1
), claims AS (
  SELECT entry_id, 'company_name' AS field, company_name AS value, length(company_name)::DOUBLE AS e, row_id FROM r
  UNION ALL SELECT entry_id, 'company_email', company_email, coalesce(score, -1), row_id FROM r WHERE regexp_matches(company_email, '^[^@\\s:]+@[^@\\s]+\\.[^@\\s.]{2,}$')
  UNION ALL SELECT entry_id, 'website', website, epoch_us(finished_at)::DOUBLE, row_id FROM r
  UNION ALL SELECT r.entry_id, 'region', region, 1, row_id FROM r JOIN top ON r.entry_id = top.entry_id AND r.region = top.label
), good AS (
  SELECT * FROM claims WHERE value IS NOT NULL AND lower(regexp_replace(value, '\\s+', '', 'g')) NOT IN ('', '-', '--', 'n/a', 'n.n.', 'null', 'unbekannt', 'k.a.', 'mailto:')
), held AS (
  SELECT entry_id, field, value, max(e) AS e, min(row_id) AS row_id FROM good GROUP BY 1, 2, 3
)
SELECT entry_id, field, row_id FROM (SELECT *, row_number() OVER (PARTITION BY entry_id, field ORDER BY e DESC, row_id) AS rn FROM held) WHERE rn = 1
""",
}
