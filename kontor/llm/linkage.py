"""Matching of entities across two sources without a common key (problem 2): probabilistic record linkage.

Method: candidate pairs come from several blocking passes; each pair is compared attribute by attribute at a few
agreement levels; expectation-maximisation estimates how often each level occurs among matches, among pairs that agree
but for their place (branches, namesakes) and among other pairs (Fellegi and Sunter's model with conditional
independence, with three latent classes); the posterior of a match is its confidence, and decides alone.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.llm.names import analysed, cell, host, phone_key, places_by_cell, subsequence, words_of
from kontor.llm.segments import distance, near_pairs
from kontor.operators.joins import checked_broadcast
from kontor.session import cut

#: Share of matches whose postal codes contradict each other by more than a typing error.
ERRORS = 0.001
#: Share of branches and namesakes that have the postal code of the other place.
NEIGHBOURS = 0.03
#: Pairs of different firms that the estimation sees for each candidate pair.
OTHERS = 10
LEVELS = ("name", "trade", "postal", "site", "contact", "region")


def prepared(entries: DataFrame) -> DataFrame:
    """id, family, trade, postal, site, phone, mail, region, country of entries with a candidate name."""
    rows = entries.select(
        F.col("entry_id").alias("id"),
        words_of("candidate.name").alias("words"),
        F.col("candidate.name").alias("name"),
        F.regexp_replace(F.upper(F.coalesce("postal", "candidate.postal_code")), r"^(?:[A-Z]{1,3}\s*[-–]\s*)|[^A-Z0-9]", "").alias("postal"),
        F.coalesce(host(F.col("domain")), host(F.col("candidate.website"))).alias("site"),
        phone_key(F.col("candidate.hints")["phone"]).alias("phone"),
        host(F.substring_index(F.col("candidate.hints")["email"], "@", -1)).alias("mail"),
        F.col("slice.region_label").alias("region"),
        F.col("slice.country_code").alias("country"),
        cell(F.col("candidate.lat"), F.col("candidate.lon")).alias("cell"),
    )
    return rows.withColumn("postal", F.when(F.col("postal") != "", F.col("postal")))


def located(rows: DataFrame) -> DataFrame:
    """``rows`` whose missing postal code is taken from the entries of the same tenth of a degree, if they agree."""
    cells = cut(places_by_cell(rows.select("cell", F.col("postal").alias("place"))))
    return rows.join(checked_broadcast(cells.withColumnRenamed("place", "near")), "cell", "left").withColumn("postal", F.coalesce("postal", "near")).drop("near", "cell")


def stem(column: str):
    """A host without its top-level domain."""
    return F.regexp_replace(F.col(column), r"\.[a-z]+$", "")


def trade_level(a, b):
    """1 if one trade may abbreviate the other, 0 if not, null where one isn't known."""
    return F.when((a == "") | (b == ""), F.lit(None)).when((a == b) | subsequence(a, b) | subsequence(b, a) | (F.levenshtein(a, b) <= 3) & (F.least(F.length(a), F.length(b)) >= 8), 1).otherwise(0)


def compared(pairs: DataFrame) -> DataFrame:
    """Agreement levels of candidate pairs; null where a side tells nothing.

    name: 2 all telling words of the shorter name agree (of both, if one has only trades and given names), 1 some do,
    0 none. trade: 1 one may abbreviate the other, 0 not.
    postal: 2 equal, 1 one edit or swap, 0 other. site: 1 equal hosts but for the top-level domain
    (or a mailbox at the other's host), 0 other.
    contact: 1 equal phone, 0 other. region: 1 equal, 0 other.
    """
    like = lambda a, b: F.exists(b, lambda y: distance(a, y) <= F.when(F.least(F.length(a), F.length(y)) <= 4, 0).when(F.least(F.length(a), F.length(y)) <= 6, 1).otherwise(2))
    short = F.when(F.size("a_family") <= F.size("b_family"), F.col("a_family")).otherwise(F.col("b_family"))
    long = F.when(F.size("a_family") <= F.size("b_family"), F.col("b_family")).otherwise(F.col("a_family"))
    hits = F.size(F.filter(short, lambda w: like(w, long)))
    name = F.when(F.size(short) == 0, F.lit(None)).when((hits == F.size(short)) & (~(F.col("a_plain") | F.col("b_plain")) | (hits == F.size(long))), 2).when(hits > 0, 1).otherwise(0)
    trade = trade_level(F.col("a_trade"), F.col("b_trade"))
    d = F.levenshtein("a_postal", "b_postal")
    same_letters = F.array_sort(F.split("a_postal", "")) == F.array_sort(F.split("b_postal", ""))
    postal = F.when(d.isNull(), F.lit(None)).when(d == 0, 2).when((d == 1) | ((d == 2) & same_letters), 1).otherwise(0)
    hosts = lambda s: F.array_compact(F.array(stem(f"{s}_site"), stem(f"{s}_mail")))
    site = F.when((F.size(hosts("a")) == 0) | (F.size(hosts("b")) == 0), F.lit(None)).when(F.arrays_overlap(hosts("a"), hosts("b")), 1).otherwise(0)
    equal = lambda c: F.when(F.col(f"a_{c}").isNull() | F.col(f"b_{c}").isNull(), F.lit(None)).when(F.col(f"a_{c}") == F.col(f"b_{c}"), 1).otherwise(0)
    levels = {"name": name, "trade": trade, "postal": postal, "site": site, "contact": equal("phone"), "region": equal("region")}
    return pairs.select("a_id", "b_id", "a_postal", "b_postal", *[v.cast("int").alias(f"l_{k}") for k, v in levels.items()])


def expectation_maximisation(patterns: list[tuple[tuple, int]], elsewhere: int | None = None, rounds: int = 5000, tol: float = 1e-5) -> tuple[list[float], list[list[dict]]]:
    """Shares of the classes and, by class and attribute, the probability of each level, from counted agreement patterns.

    The first class are matches, the last other pairs. Blocking makes pairs that differ in place and agree in all else
    frequent (branches and namesakes), which are neither alike; with ``elsewhere``, the number of the attribute that tells the
    place, they are a class of their own between the two. Patterns are few (at most the product of the levels), so this
    runs on the driver on counts of all pairs. Unknown levels take no part. Starts from nine tenths of the pairs that agree
    fully in the first attribute and contradict each other in one more at most as matches (as the middle class where the place is contradicted) and nine tenths of the
    others as the last class; stops when no share moves by ``tol``, raises after ``rounds``."""
    n = len(LEVELS)
    values = [sorted({p[i] for p, _ in patterns if p[i] is not None}) for i in range(n)]
    total = sum(c for _, c in patterns) or 1
    k = 2 if elsewhere is None else 3

    def first(p: tuple) -> int:
        if p[0] is None or p[0] < max(values[0]) or sum(v == 0 for i, v in enumerate(p) if i != elsewhere) > 1:
            return k - 1
        return 1 if k == 3 and p[elsewhere] == 0 else 0

    def estimated(held: list[list[float]]) -> tuple[list[float], list[list[dict]]]:
        shares = [max(sum(h[j] for h in held) / total, 1e-9) for j in range(k)]
        counted = [[{v: 0.5 for v in vs} for vs in values] for _ in range(k)]
        for (p, _), h in zip(patterns, held, strict=True):
            for i, v in enumerate(p):
                if v is not None:
                    for j in range(k):
                        counted[j][i][v] += h[j]
        if k == 3 and 0 in values[elsewhere]:
            # matches are at one place by definition, the middle class at two; one attribute can't tell them apart by itself
            for of, share in ((counted[0][elsewhere], ERRORS), (counted[1][elsewhere], 1 - NEIGHBOURS)):
                of[0] = share / (1 - share) * sum(x for v, x in of.items() if v)
        return shares, [[{v: x / sum(c.values()) for v, x in c.items()} for c in of] for of in counted]

    shares, classes = estimated([[c * (0.9 if j == first(p) else 0.1 / (k - 1)) for j in range(k)] for p, c in patterns])
    for _ in range(rounds):
        held = []
        for p, c in patterns:
            logs = [math.log(s) + sum(math.log(of[i][v]) for i, v in enumerate(p) if v is not None) for s, of in zip(shares, classes, strict=True)]
            parts = [math.exp(x - max(logs)) for x in logs]
            held.append([c * x / sum(parts) for x in parts])
        renewed, classes = estimated(held)
        moved, shares = max(abs(x - y) for x, y in zip(renewed, shares, strict=True)), renewed
        if moved < tol or not patterns:
            return shares, classes
    raise RuntimeError(f"the shares of the classes did not settle in {rounds} rounds")


def of_different_firms(both: DataFrame, candidates: dict[tuple, int]) -> dict[tuple, float]:
    """Agreement patterns of pairs of different firms: unlike names, one postal code, other hosts and phones. Trade and region
    agree, and hosts and phones are told, as often as among the pairs of one postal code that are no candidates.

    All those pairs are counted and none is made: each attribute's values are counted by side and postal code, the products of
    these counts summed, and the ``candidates`` (pairs by pattern) of one postal code subtracted. Nothing else is needed, as attributes are independent within a class.
    They weigh as ``OTHERS`` times the candidates, or as many as there are."""
    told = lambda *columns: F.when(F.coalesce(*columns).isNotNull(), F.lit("told"))
    values = F.array(*[F.struct(F.lit(k).alias("attribute"), v.alias("value")) for k, v in (("trade", F.col("trade")), ("site", told("site", "mail")), ("contact", told("phone")), ("region", F.col("region")))])
    counts = cut(both.where("postal is not null").select("side", "postal", F.explode(values).alias("v")).groupBy("side", "postal", "v.attribute", "v.value").agg(F.count(F.lit(1)).cast("double").alias("n")))
    a, b = (counts.where(F.col("side") == x).select("postal", "attribute", F.col("value").alias(x), F.col("n").alias(f"n{x}")) for x in "ab")
    met = a.join(b, ["postal", "attribute"]).groupBy("attribute", "a", "b").agg(F.sum(F.col("na") * F.col("nb")).alias("n"))
    kind, x, y = F.col("attribute"), F.col("a"), F.col("b")
    level = F.when(kind == "trade", trade_level(x, y)).when(x.isNull() | y.isNull(), F.lit(None)).when(kind == "region", (x == y).cast("int")).otherwise(0)
    rows = met.groupBy("attribute", level.alias("level")).agg(F.sum("n").alias("n")).collect()
    shares = {k: {r["level"]: r["n"] for r in rows if r["attribute"] == k} for k in ("trade", "site", "contact", "region")}
    for p, n in candidates.items():
        if p[2] == 2:
            for k, of in shares.items():
                v = p[LEVELS.index(k)]
                of[v if v is None or k in ("trade", "region") else 0] -= n
    left = sum(shares["trade"].values())
    total = min(left, OTHERS * sum(candidates.values()))
    patterns = {}
    for t, s, c, r in itertools.product(*shares.values()) if left > 0 else ():
        patterns[0, t, 2, s, c, r] = total * math.prod(of[v] / left for of, v in zip(shares.values(), (t, s, c, r), strict=True))
    return {p: n for p, n in patterns.items() if n}


def scored(left: DataFrame, right: DataFrame) -> DataFrame:
    """a_id, b_id, posterior and levels of every candidate pair of two prepared tables.

    Blocking passes: equal postal code, site, mail host or phone and a telling word within the edits that :func:`compared`
    allows (:func:`kontor.llm.segments.near_pairs`); equal host, postal code or region and four letters in a row of a telling word;
    equal phone and postal code or host; equal telling word. A name of trades and given names only has all its words for telling
    ones, but meets others elsewhere only by all of them together. No pass is by a place, a host or a phone and parts of
    words alone: names are made of few syllables, so such pairs are a fixed part of all pairs of a place. The estimation
    needs them, but only counted (:func:`of_different_firms`), ``OTHERS`` times the candidates whatever the size; a candidate's
    posterior hardly depends on that number, since with it the class of others grows as its share of alike names falls. Pairs are compared once, whatever number of passes found them."""
    both = left.select("*", F.lit("a").alias("side")).unionByName(right.select("*", F.lit("b").alias("side")))
    both = cut(located(both))
    info = analysed(both.select("id", "words", F.col("postal").alias("place"), "site"))
    both = both.join(info, "id", "left").withColumn("family", F.coalesce("family", F.array().cast("array<string>"))).withColumn("trade", F.coalesce("trade", F.lit("")))
    both = cut(both.withColumn("plain", F.size("family") == 0).withColumn("family", F.when(F.col("plain"), F.array_distinct("words")).otherwise(F.col("family"))))

    whole = F.when(F.col("plain"), F.array_join(F.array_sort("family"), " ")).alias("whole")
    keyed = cut(both.select("id", "side", "postal", "region", "site", "mail", "phone", whole, F.explode_outer("family").alias("word")))
    word = F.col("word")
    elsewhere = F.when(F.col("whole").isNotNull(), F.when(word.isNotNull(), F.concat(F.lit("n|"), "whole"))).when(F.length(word) >= 5, F.concat(F.lit("w|"), word))
    inside = F.array_compact(F.array(F.concat(F.lit("p|"), "postal"), F.concat(F.lit("s|"), "site"), F.concat(F.lit("s|"), "mail"), F.concat(F.lit("t|"), "phone")))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(word) - 3)), lambda p: F.substring(word, p, 4))
    stems = F.array_distinct(F.array_compact(F.array(stem("site"), stem("mail"))))
    none = F.array().cast("array<string>")
    around = F.array_compact(F.array(F.concat(F.lit("p|"), "postal"), F.concat(F.lit("r|"), "region")))
    houses = F.flatten(F.transform(stems, lambda h: F.transform(around, lambda x: F.concat_ws("|", F.lit("h"), h, x))))
    housed = F.when(word.isNotNull(), F.flatten(F.transform(houses, lambda h: F.transform(grams, lambda g: F.concat_ws("|", h, g))))).otherwise(none)
    called = F.when(F.col("phone").isNotNull(), F.transform(F.array_compact(F.concat(F.array("postal"), stems)), lambda x: F.concat_ws("|", F.lit("t"), "phone", x))).otherwise(none)
    keys = cut(keyed.select("id", "side", F.explode(F.concat(housed, called, F.array_compact(F.array(elsewhere)))).alias("key")).distinct())
    a = keys.where("side = 'a'").select(F.col("id").alias("a_id"), "key")
    b = keys.where("side = 'b'").select(F.col("id").alias("b_id"), "key")

    placed = cut(keyed.where("word is not null").select("id", "side", "word", F.explode(inside).alias("block")).distinct())
    of_a = placed.where("side = 'a'").select("block", F.col("word").alias("a"), F.col("id").alias("a_id"))
    of_b = placed.where("side = 'b'").select("block", F.col("word").alias("b"), F.col("id").alias("b_id"))
    strings = lambda d, c: d.select("block", F.col(c).alias("s")).distinct()
    near = near_pairs(strings(of_a, "a"), strings(of_b, "b")).select("block", "a", "b")
    alike = near.join(of_a, ["block", "a"]).join(of_b, ["block", "b"]).select("a_id", "b_id")
    candidates = a.join(b, "key").select("a_id", "b_id").unionByName(alike).distinct()
    told = both.select("id", "family", "plain", "trade", "postal", "site", "mail", "phone", "region")
    of = lambda s: told.select(*[F.col(c).alias(f"{s}_{c}") for c in told.columns])
    levels = cut(compared(candidates.join(of("a"), "a_id").join(of("b"), "b_id")))
    columns = [f"l_{k}" for k in LEVELS]
    counted = {tuple(r[c] for c in columns): r["n"] for r in levels.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).collect()}
    others = of_different_firms(both, counted)
    shares, classes = expectation_maximisation([(p, counted.get(p, 0) + others.get(p, 0)) for p in {**counted, **others}], LEVELS.index("postal"))
    likelihoods = []
    for share, probabilities in zip(shares, classes, strict=True):
        weight = F.lit(math.log(share))
        for i, c in enumerate(columns):
            ladder = F.lit(0.0)
            for v, p in probabilities[i].items():
                ladder = F.when(F.col(c) == v, F.lit(math.log(p))).otherwise(ladder)
            weight = weight + ladder
        likelihoods.append(weight)
    against = [F.exp(F.least(x - likelihoods[0], F.lit(700.0))) for x in likelihoods[1:]]
    posterior = F.lit(1.0)
    for x in against:
        posterior = posterior + x
    return levels.withColumn("posterior", 1 / posterior)


def same_place_pairs(left: DataFrame, right: DataFrame, least: float = 0.3) -> DataFrame:
    """a_id, b_id, posterior: pairs taken for the same company at the same place, those of a posterior of ``least``.

    The threshold is below a half since a pair of unknown place shares its probability between the same place and
    another, and is then decided by comparison: an entry without a postal code that fits several places goes to the one
    of its best pair.
    """
    fit = cut(scored(left, right).where(F.col("posterior") >= least))
    for own, other in (("b", "a"), ("a", "b")):
        open_ = F.col(f"{own}_postal").isNull() & F.col(f"{other}_postal").isNotNull()
        best = fit.where(open_).groupBy(f"{own}_id").agg(F.max(F.struct("posterior", F.col(f"{other}_postal").alias("place"))).alias("best")).select(f"{own}_id", F.col("best.place").alias("place"))
        fit = cut(fit.join(best, f"{own}_id", "left").where(F.col("place").isNull() | F.col(f"{other}_postal").isNull() | (F.col("place") == F.col(f"{other}_postal"))).drop("place"))
    return fit.select("a_id", "b_id", "posterior")
