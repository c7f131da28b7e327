"""Best representative of each group of duplicates (problem 1): iterative truth discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.operators.joins import checked_broadcast
from kontor.session import cut

# What the sources write where they have no value (compared in lower case, without blanks).
STAND_INS = ("", "-", "--", "n/a", "n.n.", "null", "unbekannt", "k.a.", "mailto:")


def usable(c):
    """``c`` without blanks around it; null if it is blank or a stand-in for null."""
    c = F.trim(c)
    return F.when(~F.lower(F.regexp_replace(c, r"\s+", "")).isin(*STAND_INS), c)


def truth_discovery(claims: DataFrame, max_iter: int = 200, tol: float = 1e-3, prior: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Estimate which value of each field of each entity is true, and how far each source can be trusted.

    ``claims``: entity, field, value, source, evidence (double, may be null), row. A claim's vote is the
    source's weight -ln(1 - reliability); the support of a value is its share of the votes of its entity and
    field; a source's reliability is the mean support of what it claims. Both are alternated until no
    reliability moves by ``tol``; raises if ``max_iter`` rounds don't suffice. ``evidence`` is the claim's own quality
    (completeness, score or time); it is carried through so that a caller can rank by it.

    Returns (values, sources). values: entity, field, value, evidence (its best), votes (claims), support in
    [0, 1], row (the smallest that holds it). sources: source, reliability. Claims with a null entity, field or
    value are no claims; a null source is one source of its own; repeated rows vote once per source and value.
    Empty input gives empty results.

    Claims are pre-aggregated map-side by (entity, field, value, source), so a hot entity is spread over its
    values. What a round computes depends on which sources stand against which, not on the values: fields of
    entities with equal sides are one pattern (found by sums of hashes, with map-side aggregation), and rounds run over
    one of each pattern with its count. The reliabilities are broadcast if measured small.
    """
    votes = cut(
        claims.where("entity is not null and field is not null and value is not null")
        .withColumn("source", F.coalesce("source", F.lit("?")))
        .groupBy("entity", "field", "value", "source")
        .agg(F.count(F.lit(1)).alias("n"), F.max("evidence").alias("evidence"), F.min("row").alias("row"))
    )
    folded = lambda *c: F.shiftright(F.xxhash64(*c), 16)  # noqa: E731  # 48 bits, so that sums of many stay whole
    sides = votes.groupBy("entity", "field", "value").agg(F.sum(folded("source")).alias("s"), F.sum(folded("source", F.lit(1))).alias("t"))
    groups = sides.groupBy("entity", "field").agg(F.sum(folded("s", "t")).alias("p"), F.sum(folded("t", "s", F.lit(2))).alias("q"))
    patterns = groups.groupBy("p", "q").agg(F.min(F.struct("entity", "field")).alias("of"), F.count(F.lit(1)).alias("times"))
    patterns = cut(patterns.select("of.entity", "of.field", "times"))
    few = cut(votes.select("entity", "field", "value", "source").join(patterns, ["entity", "field"]))
    sources = cut(few.groupBy("source").agg(F.sum("times").alias("claims"), F.lit(prior).alias("reliability")))

    def weighed(of: DataFrame) -> DataFrame:
        weight = -F.log(F.lit(1.0) - F.least(F.greatest("reliability", F.lit(0.01)), F.lit(0.99)))
        return of.join(checked_broadcast(sources.select("source", weight.alias("w"))), "source")

    for _ in range(max_iter):
        values = weighed(few).groupBy("entity", "field", "value", "times").agg(F.sum("w").alias("w"), F.collect_set("source").alias("sources"))
        totals = values.groupBy("entity", "field").agg(F.sum("w").alias("all_w"))
        shares = values.join(totals, ["entity", "field"]).select(F.explode("sources").alias("source"), "times", (F.col("w") / F.col("all_w")).alias("share"))
        renewed = shares.groupBy("source").agg((F.sum(F.col("share") * F.col("times")) / F.sum("times")).alias("renewed"))
        after = cut(sources.join(renewed, "source").select("source", "claims", F.col("renewed").alias("reliability"), F.abs(F.col("renewed") - F.col("reliability")).alias("moved")))
        moved = after.agg(F.max("moved")).first()[0]
        sources = cut(after.select("source", "claims", "reliability"))
        if moved is None or moved < tol:
            break
    else:
        raise RuntimeError(f"reliabilities did not settle in {max_iter} rounds")
    values = weighed(votes).groupBy("entity", "field", "value").agg(F.sum("w").alias("w"), F.sum("n").alias("votes"), F.max("evidence").alias("evidence"), F.min("row").alias("row"))
    values = cut(values)
    totals = values.groupBy("entity", "field").agg(F.sum("w").alias("all_w"))
    return values.join(totals, ["entity", "field"]).withColumn("support", F.col("w") / F.col("all_w")).drop("w", "all_w"), sources.select("source", "reliability")


def survivors(values: DataFrame, by: str = "support", rows_first: tuple[str, ...] = ()) -> DataFrame:
    """One value per entity and field. ``by`` support: the highest support, then the best evidence; ``by`` evidence: the
    best evidence, then the highest support. The smallest row comes last, but before support in the fields of ``rows_first``."""
    evidence = F.coalesce("evidence", F.lit(float("-inf")))
    # sums of equal votes in another order may differ in their last digits
    support = F.round("support", 9)
    early = F.when(F.col("field").isin(*rows_first), -F.col("row")) if rows_first else F.lit(None).cast("bigint")
    order = [support, evidence] if by == "support" else [evidence, early, support]
    best = F.struct(*(c.alias(f"r{i}") for i, c in enumerate([*order, -F.col("row")])), "value", "row", "support")
    return values.groupBy("entity", "field").agg(F.max(best).alias("b")).select("entity", "field", "b.value", "b.row", "b.support")


def prevailing_label(slices):
    """The region_label most frequent in an array of slices; null if two are equally frequent. Row-local."""
    labels = F.filter(F.transform(slices, lambda s: s["region_label"]), lambda x: x.isNotNull())
    counted = F.transform(F.array_distinct(labels), lambda x: F.struct(F.size(F.filter(labels, lambda y: y == x)).alias("n"), x.alias("label")))
    top = F.array_max(counted)
    unique = F.size(F.filter(counted, lambda s: s["n"] == top["n"])) == 1
    return F.when(unique, top["label"])


def company_claims(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """Claims of finished company rows for :func:`truth_discovery`.

    Evidence by field: company_name its length, company_email its score (complete addresses only), website the
    time its row was finished, region its frequency among the entry's slices (only the most frequent label, if
    there is just one). The source of a claim is the kind of page its row came from. One explode, no join but
    the one with ``entries`` on the entry's id.
    """
    email = usable(F.col("company_email"))
    complete = F.when(email.rlike(r"^[^@\s:]+@[^@\s]+\.[^@\s.]{2,}$"), email)
    name = usable(F.col("company_name"))
    page = F.regexp_extract(F.coalesce(F.col("scored_email.finding.source_url"), F.lit("")), r"^https?://[^/]+/([^/?#]*)", 1)
    field = lambda f, v, e: F.struct(F.lit(f).alias("field"), v.alias("value"), e.cast("double").alias("evidence"))
    wanted = entries.select(F.col("entry_id").alias("entity"), prevailing_label(F.col("found_in")).alias("_label")).where("_label is not null")
    claims = rows.select(
        F.col("entry_id").alias("entity"),
        F.col("row_id").alias("row"),
        F.concat_ws("/", F.lower(page), F.col("scored_email.finding.from_jsonld").cast("string")).alias("source"),
        F.explode(
            F.array(
                field("company_name", name, F.length(name)),
                field("company_email", complete, F.col("scored_email.score")),
                field("website", usable(F.col("website")), F.unix_micros(F.col("finished_at").cast("timestamp"))),
                field("region", usable(F.col("region")), F.lit(None)),
            )
        ).alias("c"),
    ).select("entity", "row", "source", "c.*")
    plain = claims.where("field <> 'region'")
    # a label that prevails is one per entry, so this join keeps the number of claims
    regions = claims.where("field = 'region'").join(wanted, "entity").where("value = _label").drop("_label").withColumn("evidence", F.lit(1.0))
    return plain.unionByName(regions)
