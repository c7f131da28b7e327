"""Variant spellings of organisations' names (problem 6).

Method: pigeonhole segment join. The telling words of each name (not trades, given names or legal forms, which
are recognised by the words they stand beside) are cut into k + 1 segments, their position-shifted
substrings are looked up in an inverted index, and candidates are verified with the banded edit distance of
:mod:`kontor.llm.segments`. Candidates must share a block: a town, a site, a phone number, a mailbox's domain or
a tax number.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kontor.llm.addresses import parsed, towns
from kontor.llm.segments import near_pairs, similar_pairs
from kontor.operators.graph import components
from kontor.operators.joins import checked_broadcast, hot_key_join
from kontor.session import cut, release

# Legal forms, without points and accents.
LEGAL = frozenset(
    "ag kg ohg ug gmbh mbh gbr ek eu ev eg se co cokg gesmbh gmbhcokg gmbhco haftungsbeschrankt aktiengesellschaft kommanditgesellschaft handelsgesellschaft offene gesellschaft beschrankter haftung "
    "sarl sas sasu eurl sa snc sci sl slu slne sc ltd limited plc llp lp inc llc corp bv nv spa srl ekfr ekfm kgaa".split()
)
# Words that stand beside a name and say nothing about who it is.
BESIDE = frozenset("fa firma firmengruppe gebr gebruder gebrueder freres frere brothers bros hermanos und u and et y e mit the inh inhaber inhaberin der die das von le la les de du des".split())


LONG_LEGAL = tuple(w for w in LEGAL if len(w) >= 9)


@lru_cache(maxsize=200_000)
def is_legal(word: str) -> bool:
    """Whether a word is a legal form, its beginning or, if long, within two edits of one."""
    if word in LEGAL or re.match(r"(?:haft|hfat|hatf)\w*(?:besch|bsch|ung)|beschr|aktieng|kommanditg", word):
        return True
    return len(word) >= 8 and any(abs(len(word) - len(x)) <= 2 and plain_distance(word, x) <= 3 for x in LONG_LEGAL)


def plain_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def name_words(name: str | None) -> list[str]:
    """Words of a name: lower case without accents, ae/oe/ue as their first letter, initials run together, no legal form."""
    if not name or not name.strip():
        return []
    text = re.split(r"\s[–—|]\s", name.strip())[0]
    text = re.sub(r"(?i)\bgbr\.(?=\s)", "gebr.", text)
    text = unicodedata.normalize("NFKD", text.lower().replace("ß", "ss"))
    text = "".join(c for c in text if not unicodedata.combining(c))
    raw = re.findall(r"[^\W_]+", text)
    joined: list[str] = []
    single = False
    for w in raw:
        if len(w) == 1 and single:
            joined[-1] += w
        else:
            joined.append(w)
        single = len(w) == 1
    out = []
    for w in joined:
        w = w.replace("ae", "a").replace("oe", "o").replace("ue", "u")
        if w not in BESIDE and not is_legal(w):
            out.append(w)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def words_of(names: pd.Series) -> pd.Series:
    return pd.Series([name_words(n) for n in names])


def host(url):
    """Host of a URL or address as typed, without www; null if there is none."""
    h = F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z]+://)?(?:www\.)?([a-z0-9.-]+\.[a-z]{2,})(?:[:/?#].*)?$", 1)
    return F.when(h != "", h)


def phone_key(phone):
    """Last eight digits of a phone number; null if it has fewer than seven."""
    d = F.regexp_replace(F.regexp_replace(phone, r"\(0\)", ""), r"\D", "")
    return F.when(F.length(d) >= 7, F.substring(d, -8, 8))


def common_words(names: DataFrame, places: int = 6) -> DataFrame:
    """word, in_site, spread: words met at ``places`` places or sites or more, which trades, given names, chains and
    namesakes are. in_site: the share of their records with a site whose address contains them (trades do, given names
    don't). spread: the places or sites, whichever are more.

    ``names``: words, place, site. Distinct counts are pre-aggregated, so a word of a third of all rows is no
    bottleneck."""
    rows = names.select(F.explode(F.array_distinct("words")).alias("word"), "place", "site")
    plain_site = F.regexp_replace(F.replace(F.replace(F.replace(F.col("site"), F.lit("ae"), F.lit("a")), F.lit("oe"), F.lit("o")), F.lit("ue"), F.lit("u")), r"\.[a-z]+$", "")
    held = F.when(F.col("site").isNotNull(), F.contains(plain_site, F.col("word")).cast("int"))
    pairs = rows.groupBy("word", "place", "site").agg(F.first(held).alias("held"))
    counted = pairs.groupBy("word").agg(F.count_distinct("place").alias("p"), F.count_distinct("site").alias("s"), F.avg("held").alias("in_site"))
    return counted.where(F.greatest("p", "s") >= places).select("word", F.coalesce("in_site", F.lit(0.0)).alias("in_site"), F.greatest("p", "s").alias("spread"))


def of_many(names: DataFrame, met: DataFrame, known: DataFrame, share: float = 0.5, places: int = 6, broader: int = 4) -> DataFrame:
    """The rows of ``met`` (:func:`common_words`) that are trades or given names: most places have another name beside
    them, so the different telling words beside them are more than ``share`` of their spread. Since a chain has many
    places of one name, they may also be ``places`` or more and ``share`` of the different names the word stands in. A
    chain or a family name stands beside the few trades and given names of its firms, however many places it has.

    A word beside another is telling if it is not in ``known`` or stands in ``broader`` times fewer different names than
    the other, so a name that many firms have still tells beside its trades. In very large tables the different telling
    words grow slower than the places; there it is enough that ``share`` of the names of a word that stands in
    ``broader`` times ``places`` names have one beside it.

    ``known``: word, the words of ``met`` and their typing errors."""
    rows = names.select(F.xxhash64(F.array_sort(F.array_distinct("words"))).alias("name"), F.explode(F.array_distinct("words")).alias("word")).where("length(word) > 1").distinct()
    # words of ``met`` are all in ``known``
    marks = known.join(checked_broadcast(met.select("word", F.lit(True).alias("is_met")), of=(met,)), "word", "left").withColumn("is_known", F.lit(True))
    rows = cut(rows.join(checked_broadcast(marks), "word", "left"))
    held = cut(rows.groupBy("word").agg(F.count(F.lit(1)).alias("of")))
    # names are sets of words, so a frequent name is one group of a few words
    beside = rows.join(held, "word").groupBy("name").agg(F.collect_list(F.struct("word", "of", "is_met", "is_known")).alias("w"))
    met_words = beside.select("name", F.explode(F.filter("w", lambda x: x["is_met"].isNotNull())).alias("m"), "w")
    tells = lambda x: (F.length(x["word"]) >= 4) & (x["word"] != F.col("m.word")) & (x["is_known"].isNull() | (x["of"] * broader <= F.col("m.of")))
    told = cut(met_words.select("name", F.col("m.word").alias("word"), F.transform(F.filter("w", tells), lambda x: x["word"]).alias("others")))
    counted = told.select("word", F.explode("others").alias("other")).groupBy("word").agg(F.count_distinct("other").alias("n"))
    shares = told.groupBy("word").agg(F.avg((F.size("others") > 0).cast("int")).alias("told"))
    n, of = F.col("n"), F.col("of")
    many = (n > share * F.col("spread")) | ((n >= places) & (n > share * of)) | ((of >= broader * places) & (n >= places) & (F.col("told") > share))
    return met.join(counted, "word").join(held, "word").join(shares, "word").where(many).select(met.columns)


def analysed(names: DataFrame, trade_share: float = 0.08) -> DataFrame:
    """id, family (array of telling words) and trade (the trade words run together) of ``names``: id, words, place, site.

    A word is common as :func:`common_words` and :func:`of_many` have it, or within the allowed edits of a common word of
    five letters or more (a typing error of it); common words that sites contain are trades. Words of two or three letters
    tell only in names without longer telling words; words of one letter are initials. A name of common words and
    initials only has no family word; callers take it as a whole."""
    met = cut(common_words(names))
    one = lambda d: d.select(F.lit(1).alias("block"), F.col("word").alias("s")).distinct()
    words = names.select(F.explode("words").alias("word")).where("length(word) > 1").distinct()
    rare = words.join(checked_broadcast(met.select("word"), of=(met,)), "word", "left_anti")
    close = near_pairs(one(rare.where("length(word) >= 5")), one(met.where("length(word) >= 5")))
    common = cut(of_many(names, met, met.select("word").unionByName(close.select(F.col("a").alias("word")).distinct())))
    close = close.join(common.withColumnRenamed("word", "b"), "b").groupBy("a").agg(F.min(F.struct("d", -F.col("in_site"), "b", "in_site")).alias("m")).select(F.col("a").alias("word"), F.col("m.b").alias("proper"), F.col("m.in_site").alias("in_site"))
    known = cut(common.select("word", F.col("word").alias("proper"), "in_site").unionByName(close))
    long = names.select("id", F.posexplode("words").alias("pos", "word")).where("length(word) > 1")
    long = long.join(checked_broadcast(known), "word", "left")
    own = F.struct("pos", F.col("word").alias("w"))
    family = F.when(F.col("proper").isNull() & (F.length("word") >= 4), own)
    brief = F.when(F.col("proper").isNull() & (F.length("word") < 4), own)
    trade = F.when(F.col("in_site") >= trade_share, F.struct("pos", F.col("proper").alias("w")))
    listed = lambda c, name: F.array_sort(F.collect_list(c)).alias(name)
    grouped = long.groupBy("id").agg(listed(family, "f"), listed(brief, "s"), listed(trade, "t"))
    text = lambda c: F.array_distinct(F.transform(c, lambda x: x["w"]))
    grouped = grouped.select("id", F.when(F.size("f") > 0, text("f")).otherwise(text("s")).alias("family"), F.array_join(text("t"), "").alias("trade"))
    none = F.array().cast("array<string>")
    return names.select("id").distinct().join(grouped, "id", "left").select("id", F.coalesce("family", none).alias("family"), F.coalesce("trade", F.lit("")).alias("trade"))


def subsequence(a, b):
    """Whether the letters of a stand in b in this order."""
    return F.rlike(b, F.array_join(F.split(a, ""), ".*"))


def trades_agree(a, b):
    """Whether two trades may be the same: one abbreviates or misspells the other. Unknown trades don't agree."""
    known = (a != "") & (b != "")
    near = F.levenshtein(a, b) <= F.when(F.least(F.length(a), F.length(b)) >= 8, 3).otherwise(1)
    return known & ((a == b) | near | subsequence(a, b) | subsequence(b, a))


def others_agree(a, b):
    """Whether the further telling words of two names may be the same: one side has none, holds the other's or misspells them."""
    shorter = F.least(F.length(a), F.length(b))
    near = F.levenshtein(a, b, 3).between(0, F.when(shorter <= 3, 0).when(shorter <= 6, 1).when(shorter <= 9, 2).otherwise(3))
    return (a == "") | (b == "") | near | F.contains(a, b) | F.contains(b, a)


def linked(records: DataFrame, shared_site: int = 4) -> DataFrame:
    """id, org: the organisation of each record that has a name and a block.

    ``records``: id, words, place, site, blocks (array of strings such as ``phone:1234567``); one row per name of a
    record. Two names link if they share a block, a telling word within the allowed edits and agreeing trades; a
    name without a trade links within a town only where its telling word has one trade, and always within a site.
    A name without telling words is one word, all of it run together. Sites with ``shared_site`` telling words or more
    (none of which resembles another) are hosts of many and no block. Links are transitive. Nodes are (block, word,
    trade, other telling words), so copies and hot names cost one node, and no pair of records is made here. Null and
    blank names have no words and no organisation.
    """
    records = cut(records)
    names = cut(records.groupBy("id").agg(F.flatten(F.collect_list("words")).alias("words"), F.first("place", True).alias("place"), F.first("site", True).alias("site")))
    rows = records.join(analysed(names), "id")
    whole = F.when(F.size("words") > 0, F.array(F.array_join("words", "")))
    tell = F.when(F.size("family") > 0, F.col("family")).otherwise(whole)
    base = rows.select("id", "trade", tell.alias("family"), F.explode(F.array_distinct("blocks")).alias("block"))
    nodes = base.select("id", "trade", "block", "family", F.explode("family").alias("word")).where("block is not null")
    # the telling words beside this one; partners recur in other firms, so a second name must agree too
    nodes = nodes.withColumn("rest", F.array_join(F.array_sort(F.filter("family", lambda w: w != F.col("word"))), "")).drop("family")
    nodes = cut(nodes.distinct())
    release(nodes.sparkSession)
    strings = cut(nodes.select("block", F.col("word").alias("s")).distinct())
    many = strings.where("block like 'site:%'").groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= shared_site)
    near = similar_pairs(strings)
    # words of one organisation resemble each other; a host of many has words that don't
    alone = near.select("block", F.explode(F.array("a", "b")).alias("s")).distinct()
    hosts = cut(strings.join(many, "block", "left_semi").join(alone, ["block", "s"], "left_anti").groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= shared_site).select("block"))
    release(nodes.sparkSession)
    near = near.select("block", "a", "b").unionByName(strings.select("block", F.col("s").alias("a"), F.col("s").alias("b"))).join(checked_broadcast(hosts), "block", "left_anti")
    keyed = nodes.join(checked_broadcast(hosts), "block", "left_anti").withColumn("node", F.xxhash64("block", "word", "trade", "rest"))
    sides = keyed.select("block", "word", "trade", "rest", "node").distinct()
    left, right = (sides.select("block", F.col("word").alias(w), F.col("trade").alias(f"t{w}"), F.col("rest").alias(f"r{w}"), F.col("node").alias(f"n{w}")) for w in "ab")
    pairs = cut(near.join(left, ["block", "a"]).join(right, ["block", "b"]).where("a <> b or na < nb").where(others_agree(F.col("ra"), F.col("rb"))))
    sure = pairs.where(trades_agree(F.col("ta"), F.col("tb")) | ((F.col("ta") == "") & (F.col("tb") == ""))).select(F.col("na").alias("a"), F.col("nb").alias("b"))
    # a name without a trade: its only candidate trade in the block, if there is one
    open_ = pairs.where("(ta = '') <> (tb = '')").select(F.when(F.col("ta") == "", F.col("na")).otherwise(F.col("nb")).alias("bare"), F.when(F.col("ta") == "", F.col("nb")).otherwise(F.col("na")).alias("other"), F.when(F.col("ta") == "", F.col("tb")).otherwise(F.col("ta")).alias("trade"))
    only = open_.groupBy("bare").agg(F.min("trade").alias("lo"), F.max("trade").alias("hi"))
    only = only.where((F.col("lo") == F.col("hi")) | trades_agree(F.col("lo"), F.col("hi"))).select("bare")
    bare = open_.join(only, "bare", "left_semi").select(F.col("bare").alias("a"), F.col("other").alias("b"))
    of = keyed.select(F.col("id").alias("a"), F.col("node").alias("b"))
    # ids and nodes share one space of numbers: a record is a node of its own hash
    of = of.select(F.xxhash64(F.lit("record"), "a").alias("a"), "b", F.col("a").alias("id"))
    release(nodes.sparkSession)
    found = components(sure.unionByName(bare).unionByName(of.select("a", "b")))
    return of.select("id", "a").distinct().join(found, F.col("a") == F.col("node")).select("id", F.col("component").alias("org"))


def places_by_cell(rows: DataFrame, share: float = 0.8) -> DataFrame:
    """cell, place: cells of a tenth of a degree where ``share`` of the told places are one. ``rows``: cell, place."""
    told = rows.where("cell is not null and place is not null").groupBy("cell", "place").agg(F.count(F.lit(1)).alias("n"))
    return told.groupBy("cell").agg(F.max(F.struct("n", "place")).alias("b"), F.sum("n").alias("all_n")).where(F.col("b.n") >= share * F.col("all_n")).select("cell", F.col("b.place").alias("place"))


def cell(lat, lon):
    return F.when(lat.isNotNull() & lon.isNotNull(), F.concat_ws("/", F.round(lat, 1).cast("string"), F.round(lon, 1).cast("string")))


def tagged(kind: str, value):
    return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{kind}:"), value))


def organisations(pois: DataFrame, orgs: DataFrame) -> DataFrame:
    """id, org of the named rows of POI elements (row_id) and JSON-LD organisations (org_id).

    Towns come from tags or addresses, and for elements that tell none from the place that most elements of the
    same tenth of a degree tell. Sites are an element's website or an organisation's url, its own page and its mail
    domain. See :func:`linked` for what links names."""
    tag = lambda *keys: F.coalesce(*[F.when(F.trim(F.col("tags")[k]) != "", F.trim(F.col("tags")[k])) for k in keys])
    poi = pois.select(
        F.col("row_id").alias("id"),
        F.array(F.col("tags")["name"]).alias("names"),
        host(tag("website", "contact:website")).alias("site"),
        F.array(host(tag("website", "contact:website")), host(F.substring_index(tag("email", "contact:email"), "@", -1))).alias("sites"),
        phone_key(tag("phone", "contact:phone")).alias("phone"),
        F.lit(None).cast("string").alias("tax"),
        F.lit(None).cast("string").alias("text"),
        tag("addr:postcode").alias("code"),
        tag("addr:city").alias("city"),
        cell(F.coalesce("lat", "center.lat"), F.coalesce("lon", "center.lon")).alias("cell"),
    )
    org = orgs.select(
        F.col("org_id").alias("id"),
        F.array("name", "legal_name").alias("names"),
        F.coalesce(host(F.col("url")), host(F.col("page_url"))).alias("site"),
        F.concat(F.array(host(F.col("url")), host(F.col("page_url"))), F.transform(F.coalesce("emails", F.array()), lambda e: host(F.substring_index(e, "@", -1)))).alias("sites"),
        phone_key(F.get("telephones", F.lit(0))).alias("phone"),
        F.coalesce("vat_id", "tax_id").alias("tax"),
        F.col("address_text").alias("text"),
        F.col("postal_code").alias("code"),
        F.col("locality").alias("city"),
        F.lit(None).cast("string").alias("cell"),
    )
    rows = poi.unionByName(org).where(F.exists("names", lambda n: F.trim(n) != ""))
    rows = cut(rows.withColumn("p", parsed("text", "code")).withColumn("c", parsed(F.concat_ws(" ", "code", "city"), "code")))
    own = F.when(F.col("p.pc") != "", F.col("p.pc")).otherwise(F.col("c.pc"))
    told = rows.select("id", own.alias("pc"), F.when(F.size("p.names") > 0, F.col("p.names")).when(F.col("city").isNotNull(), F.col("c.names")).otherwise(F.array().cast("array<string>")).alias("names"))
    places = cut(towns(told.where("pc <> '' or size(names) > 0")))
    rows = rows.join(places.withColumnRenamed("town", "place"), "id", "left")
    rows = cut(rows)
    release(rows.sparkSession)
    cells = places_by_cell(rows.select("cell", "place"))
    rows = rows.join(checked_broadcast(cells.withColumnRenamed("place", "near")), "cell", "left").withColumn("place", F.coalesce("place", "near"))
    blocks = F.array_compact(F.concat(F.array(tagged("town", F.col("place")), tagged("phone", F.col("phone")), tagged("tax", F.col("tax"))), F.transform("sites", lambda s: tagged("site", s))))
    records = rows.select("id", F.explode("names").alias("name"), "place", "site", blocks.alias("blocks")).select("id", words_of("name").alias("words"), "place", "site", "blocks")
    return linked(records)


def members(groups: DataFrame, group: str) -> DataFrame:
    """id, ``group``, links: each member once, with the number of other members of its group; grows with the members, not
    with their pairs."""
    groups = cut(groups.select("id", group).distinct())
    sizes = groups.groupBy(group).agg((F.count(F.lit(1)) - 1).alias("links"))
    return hot_key_join(groups, sizes, group).select("id", group, "links")


def pairs_of(groups: DataFrame, group: str, whole: int = 256) -> DataFrame:
    """id_a, id_b (smaller first): every pair of one group, as the problem asks for them.

    ``groups`` has a row for each member. The members of a group of more than ``whole`` are dealt into as many parts as the
    square root of its size, so the pairs of a large group are made by many tasks: each member meets each part once, and
    pairs need no distinct. Groups of one have no pairs."""
    groups = cut(groups.select("id", group))
    release(groups.sparkSession)
    large = groups.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > whole).select(group, F.ceil(F.sqrt("n")).cast("int").alias("parts"))
    held = groups.join(checked_broadcast(large), group, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    a = held.select(F.col("id").alias("id_a"), group, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    b = held.select(F.col("id").alias("id_b"), group, F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    return a.join(b, [group, "part"]).where("id_a < id_b").select("id_a", "id_b")
