"""Free-entered values mapped to a reference list (problem 4), in Spark SQL.

Method: partition-based pigeonhole join. A reference string that may differ by K edits is cut into K + 1
segments; at least one stands unchanged in a variant, shifted by K places at most. So the segments are joined
with the substrings of the typed values by equality, and only those pairs are verified with levenshtein.
What has no verified partner is found by an anti-join and reported with canon_id 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.functions.text import MARKED, PLAIN
from kontor.operators.joins import checked_broadcast, hot_key_join
from kontor.session import cut

# Words that clients put around a name.
BEFORE = "land|region|raum|gebiet|branche|staat|pays|area|sector|industry"
AFTER = "alle|land|ganz|companies|betriebe|all|region|gebiet|firmen|unternehmen|branche"


def spelt(x: str) -> str:
    """SQL for the words of ``x``: lower case, no accents, one blank between."""
    plain = f"translate(replace(replace(replace(lower({x}), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), '{MARKED}', '{PLAIN}')"
    return rf"trim(regexp_replace({plain}, '[^\\pL\\pN]+', ' '))"


def dense(x: str) -> str:
    """SQL for the forms of ``x`` without blanks: as it is, and with ae, oe and ue as their first letter, as the accents went."""
    return f"array_distinct(array(replace({x}, ' ', ''), replace(replace(replace(replace({x}, ' ', ''), 'ae', 'a'), 'oe', 'o'), 'ue', 'u')))"


#: Edits that a reference of n letters may differ by, besides that one swap of neighbours counts once.
EDITS = "CASE WHEN n <= 3 THEN 0 WHEN n = 4 THEN 1 WHEN n < 12 THEN 2 ELSE 3 END"


def references(canon: DataFrame) -> DataFrame:
    """canon_id, field, cc, key, n, k (edits allowed), most (edits searched). Codes match exactly or not at all."""
    return canon.sparkSession.sql(
        f"""
        WITH names AS (
          SELECT canon_id, field, IF(field = 'region', coalesce(country_code, ''), '') AS cc, exact, explode({dense(spelt("name"))}) AS key
          FROM (SELECT canon_id, field, country_code, false AS exact, explode(concat(array(name), coalesce(aliases, array()))) AS name FROM {{canon}}
                UNION ALL SELECT canon_id, field, country_code, true, code FROM {{canon}})
          WHERE name IS NOT NULL AND canon_id IS NOT NULL
        ), sized AS (SELECT canon_id, field, cc, key, min(exact) AS exact, length(key) AS n FROM names WHERE key <> '' GROUP BY canon_id, field, cc, key)
        SELECT *, IF(exact, 0, {EDITS}) AS k, IF(exact, 0, {EDITS} + IF(n >= 7, 1, 0)) AS most FROM sized""",
        canon=canon,
    )


def canonicalise(typed: DataFrame, refs: DataFrame) -> DataFrame:
    """The reference meant by each distinct typed value: field, cc, input, canon_id.

    ``typed``: field, cc, input (repeats allowed). Best is the fewest edits, where two neighbours
    that changed places are one edit; a typed value of four letters or more that only begins a reference counts as two and a half edits.
    Values without a verified partner, or whose best partners belong to different entries, get 0; so do blank
    values. Null inputs have no row. The reference list is fixed and small; it is broadcast after a count.
    """
    spark = typed.sparkSession
    words = cut(
        spark.sql(
            f"""
            WITH v AS (SELECT field, cc, input, {spelt("input")} AS w FROM {{typed}} WHERE input IS NOT NULL GROUP BY field, cc, input),
            d AS (SELECT field, cc, input, explode(array_distinct(array(w, regexp_replace(w, '^({BEFORE}) ', ''), regexp_replace(w, ' ({AFTER})$', ''),
                         regexp_replace(regexp_replace(w, '^({BEFORE}) ', ''), ' ({AFTER})$', '')))) AS w FROM v)
            SELECT DISTINCT field, cc, input, key, length(key) AS n FROM (SELECT field, cc, input, explode({dense("w")}) AS key FROM d WHERE w <> '')""",
            typed=typed,
        )
    )
    segments = spark.sql(
        """
        SELECT field, cc, canon_id, key, n, k, most, i * n DIV (most + 1) + 1 AS at,
               substring(key, i * n DIV (most + 1) + 1, (i + 1) * n DIV (most + 1) - i * n DIV (most + 1)) AS segment
        FROM (SELECT *, explode(sequence(0, least(most, n - 1))) AS i FROM {refs})""",
        refs=refs,
    )
    segments = cut(segments)
    starts = spark.sql("SELECT field, cc, canon_id, key, n, substring(key, 1, 4) AS start FROM {refs} WHERE n > 4 AND NOT exact", refs=refs)
    swapped = "concat(substring(key, 1, i - 1), substring(key, i + 1, 1), substring(key, i, 1), substring(key, i + 2))"
    matched = spark.sql(
        f"""
        WITH parts AS (
          SELECT field, cc, input, key, n, m, at, substring(key, at, m) AS segment
          FROM (SELECT w.field, w.cc, w.input, w.key, w.n, l.m, explode(sequence(1, greatest(1, w.n - l.m + 1))) AS at
                FROM {{words}} w JOIN {{lengths}} l ON w.field = l.field AND w.cc = l.cc)
        ), pairs AS (
          SELECT DISTINCT p.field, p.cc, p.input, p.key, s.canon_id, s.key AS ref, s.k, s.most
          FROM parts p JOIN {{index}} s ON p.field = s.field AND p.cc = s.cc AND p.segment = s.segment
          WHERE abs(p.at - s.at) <= s.most AND abs(p.n - s.n) <= s.most
        ), verified AS (
          SELECT field, cc, input, canon_id, CAST(IF(swap, e - 1, e) AS DOUBLE) AS e FROM (
            SELECT *, e > 1 AND p.n > 1 AND exists(sequence(1, greatest(1, p.n - 1)), i -> levenshtein({swapped}, ref) <= e - 2) AS swap
            FROM (SELECT *, length(key) AS n, levenshtein(key, ref) AS e FROM pairs) p WHERE e <= most)
          WHERE e <= k OR swap
        ), begun AS (
          SELECT w.field, w.cc, w.input, s.canon_id, 2.5D AS e
          FROM {{words}} w JOIN {{starts}} s ON w.field = s.field AND w.cc = s.cc AND substring(w.key, 1, 4) = s.start
          WHERE w.n >= 4 AND w.n < s.n AND startswith(s.key, w.key)
        ), best AS (
          SELECT field, cc, input, canon_id, min(e) AS d FROM (SELECT * FROM verified UNION ALL SELECT * FROM begun) GROUP BY field, cc, input, canon_id
        )
        SELECT field, cc, input, d[0].canon_id AS canon_id, d FROM (
          SELECT field, cc, input, array_sort(collect_list(struct(d, canon_id))) AS d FROM best GROUP BY field, cc, input)
        WHERE size(d) = 1 OR d[0].d < d[1].d""",
        lengths=checked_broadcast(segments.select("field", "cc", F.length("segment").alias("m")).distinct()),
        words=words,
        index=checked_broadcast(segments),
        starts=checked_broadcast(starts),
    ).select("field", "cc", "input", "canon_id")
    matched = cut(matched)
    values = typed.where("input is not null").select("field", "cc", "input").distinct()
    unmatched = values.join(matched, ["field", "cc", "input"], "left_anti").withColumn("canon_id", F.lit(0).cast("bigint"))
    return matched.unionByName(unmatched)


def resolved_inputs(requests: DataFrame, canon: DataFrame) -> DataFrame:
    """job_id, field, pos, canon_id for each non-null input of the requests' country, regions and industries.

    Countries come first, for a region can only be one of the request's own country; without a known country
    it is unmatched. Distinct values are matched once; their results return to the rows by a join that treats
    hot values apart. Rows with null lists have no inputs; repeated rows give repeated rows.
    """
    refs = cut(references(canon))

    def mapped(rows: DataFrame) -> DataFrame:
        key = F.concat_ws("\u0001", "field", "cc", "input")
        found = canonicalise(rows, refs).select(key.alias("_key"), "canon_id")
        return hot_key_join(rows.withColumn("_key", key), found, "_key").drop("_key")

    base = requests.select("job_id", "resolved")
    countries = base.select("job_id", F.lit("country").alias("field"), F.lit(0).cast("bigint").alias("pos"), F.lit("").alias("cc"), F.col("resolved.country.input").alias("input")).where("input is not null")
    countries = cut(mapped(countries).select("job_id", "field", "pos", "canon_id"))
    codes = canon.where("field = 'country'").select("canon_id", F.col("country_code").alias("cc"))
    homes = countries.join(checked_broadcast(codes), "canon_id").select("job_id", "cc").distinct()
    regions = base.select("job_id", F.posexplode("resolved.regions").alias("pos", "r")).select("job_id", F.lit("region").alias("field"), F.col("pos").cast("bigint").alias("pos"), F.col("r.input").alias("input")).where("input is not null")
    regions = cut(regions.join(homes, "job_id", "left").withColumn("cc", F.coalesce("cc", F.lit("?"))))
    industries = base.select("job_id", F.posexplode("resolved.industries").alias("pos", "r")).select("job_id", F.lit("industry").alias("field"), F.col("pos").cast("bigint").alias("pos"), F.lit("").alias("cc"), F.col("r.input").alias("input")).where("input is not null")
    rest = mapped(regions.unionByName(industries)).select("job_id", "field", "pos", "canon_id")
    return countries.unionByName(rest)
