"""Postal addresses of one place in different spellings (problem 3).

Method: rewrites are mined from addresses that agree elsewhere (same town and house number, street names alike)
but differ in one token; token pairs that occur together significantly more often than chance become rewrites,
all addresses are normalised again with them and matched again, until no new rewrite appears.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kontor.llm.segments import segment_pairs, similar_pairs
from kontor.operators.graph import components
from kontor.operators.joins import checked_broadcast, hot_key_join
from kontor.session import cut

# First words of parts that name a building, floor or reception, not a street.
WITHIN = (
    r"^(?:c/o|z\.? ?hd\.?|hinterhaus|vorderhaus|hinterhof|seitenfl\w*|halle|haus|gebaude|geb\.?|bau|eingang|aufgang|etage|stock|og|eg|ug|dg|batiment|bat\.?|escalier|esc\.?|porte|rez|za|zi|zac|zone"
    r"|unit|suite|floor|level|building|bldg\.?|block|room|flat|apt\.?|1st|2nd|3rd|ground|nave|planta|piso|edificio|puerta|local|poligono|postfach|po box|p\.? ?o\.? box|bp|apartado|tor|top|stiege|\d{1,2}\.? ?(?:og|ug|eg|dg|etage|stock|floor|e|er|eme)\b)(?![a-z])"
)
# Countries that may end an address.
COUNTRIES = r"(?:^|\s)(?:deutschland|germany|allemagne|alemania|brd|osterreich|austria|autriche|france|frankreich|francia|united kingdom|great britain|england|uk|gb|de|at|fr|ch|nl|es|it|pl|d|a|f|schweiz|suisse|switzerland|espana|spain|italia|italy|nederland|polska)$"
BESIDE = r"^(?:rear of|behind|next to|near|opposite|off|corner of|hinter|neben|gegenuber(?: von)?|ecke|nahe|bei|derriere|face a|pres de|a cote de|angle|detras de|junto a|frente a)\s+(?=\S)"
POSTCODE = re.compile(r"(?<![\w])(?:([a-z]{1,3}) ?- ?)?((?:\d{5}|\d{4})(?![\d.]*\w)|\d{2} \d{3}(?!\w)|[a-z]{1,2}\d{1,2}[a-z]? ?\d[a-z]{2}(?!\w))")
NUMBER_LAST = re.compile(r"^(.*?[^\W\d].*?)[ ,]*(?:(?:nr|no|num|n)\b\.? ?)?(?<![\d])(\d{1,4})(?: ?([a-z]))?(?![\w.])(.*)$")
NUMBER_FIRST = re.compile(r"^(\d{1,4})(?: ?(?:bis|ter)\b)?(?: ?([a-z])(?![\w.'/]))?[ ,]+([^\d].*)$")


def plain(text: str) -> str:
    text = unicodedata.normalize("NFKD", text.lower().replace("ß", "ss").replace("–", "-").replace("—", "-"))
    text = "".join(c for c in text if not unicodedata.combining(c))
    return re.sub(r"ae", "a", re.sub(r"oe", "o", re.sub(r"ue(?!\b)", "u", text)))


def parse(text: str | None, given: str | None) -> tuple | None:
    """(street words, number, postcode, other parts) of an address; street words keep the point of abbreviations."""
    if not text or not text.strip():
        return None
    line = re.sub(r"[\r\n]+", ", ", plain(text))
    line = " ".join(line.split()).strip(" -")
    wanted = re.sub(r"[^a-z0-9]", "", plain(given or ""))
    found = None
    for m in POSTCODE.finditer(line):
        code = m[2].replace(" ", "")
        if found is None or (wanted and wanted.endswith(code)):
            found = m
            if wanted and wanted.endswith(code):
                break
    postcode = found[2].replace(" ", "") if found else (m[2].replace(" ", "") if (m := POSTCODE.search(plain(given or ""))) else "")
    if found:
        line = f"{line[: found.start()]} ;{line[found.end() :]}"
    parts = [p.strip(" .-") if not re.search(r"\w\.$", p.strip()) else p.strip(" -") for p in re.split(r"\s*[,;|/·•]\s*(?<!c/)|\s+-\s+", line)]
    merged: list[str] = []
    for k, p in enumerate(parts):
        p = re.sub(BESIDE, "", p)
        if not p:
            continue
        if merged and re.fullmatch(r"\d{1,4}(?: ?[a-z])?", merged[-1]) and re.match(r"[^\W\d]", p):
            merged[-1] = f"{merged[-1]} {p}"  # "46, avenue X"
        elif merged and re.fullmatch(r"(?:nr\.? ?)?\d{1,4}(?: ?[a-z])?", p) and not re.match(WITHIN, merged[-1]) and not any(parts[k + 1 :]):
            merged[-1] = f"{merged[-1]} {p}"  # "X street, 46"
        else:
            merged.append(p)
    street, number, others = "", "", []
    for p in merged:
        if re.match(WITHIN, p) or (p in ("o empfang", "c")):
            continue
        first, last = NUMBER_FIRST.match(p), NUMBER_LAST.match(p)
        if not street and first:
            number, street = first[1] + (first[2] or ""), first[3]
        elif not street and last:
            street, number = last[1], last[2] + (last[3] or "")
            if rest := last[4].strip(" .-"):
                others.append(rest)
        else:
            others.append(p)
    number = re.sub(r"^0+(?=\d)", "", number)
    words = re.findall(r"[^\W\d_]+\.?", re.sub(r"['’]", " ", street.replace("-", " ")))
    names = [re.sub(COUNTRIES, "", " ".join(re.findall(r"[^\W\d_]+", o))) for o in others]
    return words, number, postcode, [n for n in names if n]


@F.pandas_udf(T.StructType([T.StructField("words", T.ArrayType(T.StringType())), T.StructField("num", T.StringType()), T.StructField("pc", T.StringType()), T.StructField("names", T.ArrayType(T.StringType()))]))
def parsed(text: pd.Series, given: pd.Series) -> pd.DataFrame:
    rows = [parse(a, b) or ([], "", "", []) for a, b in zip(text, given, strict=True)]
    return pd.DataFrame(rows, columns=["words", "num", "pc", "names"])


def towns(records: DataFrame) -> DataFrame:
    """id, town of each record that tells its town by name or postcode.

    The name of a postcode is the part that stands most often beside it, counted down by the number of postcodes
    it stands beside (countries and regions stand beside many). A record takes the name of its postcode unless it
    names another known town; without a known postcode, the known town that one of its parts names, letter by
    letter or within two edits; else its first part or its postcode stands for the town.
    """
    said = records.select("id", "pc", F.explode("names").alias("name"))
    beside = said.where("pc <> ''").groupBy("pc", "name").agg(F.count(F.lit(1)).alias("n"))
    spread = beside.groupBy("name").agg(F.count(F.lit(1)).alias("pcs"), F.sum("n").alias("all_n"))
    scored = cut(beside.join(spread, "name").withColumn("score", F.col("n") / F.sqrt("pcs")))
    lexicon = scored.groupBy("pc").agg(F.max(F.struct("score", "n", "name")).alias("b")).select("pc", F.col("b.name").alias("town"), F.col("b.n").alias("n"))
    known = cut(lexicon.groupBy("town").agg(F.sum("n").alias("n")))
    # a postcode seen with one spelling of a well-known town: take the well-known spelling
    one = lambda d, c: d.select(F.lit(1).alias("block"), F.col(c).alias("s")).distinct()
    close = segment_pairs(one(said, "name"), one(known, "town"))
    close = close.where("a <> b").join(known.select(F.col("town").alias("b"), "n"), "b").join(known.select(F.col("town").alias("a"), F.col("n").alias("own")), "a", "left")
    close = close.where("own is null or n >= 4 * own").groupBy("a").agg(F.max(F.struct(-F.col("d"), "n", "b")).alias("m")).select(F.col("a").alias("name"), F.col("m.b").alias("meant"))
    close = cut(close)
    proper = cut(lexicon.join(close.select(F.col("name").alias("town"), "meant"), "town", "left").select("pc", F.coalesce("meant", "town").alias("town")))
    by_code = records.select("id", "pc").join(checked_broadcast(proper), "pc").select("id", F.col("town").alias("code_town"))
    right = proper.select("town").distinct().withColumn("is_town", F.lit(True))
    named = said.join(checked_broadcast(close), "name", "left").withColumn("town", F.coalesce("meant", "name")).join(checked_broadcast(right, of=(proper,)), "town")
    spread_of = scored.select(F.col("name").alias("town"), "pcs").distinct()
    named = named.join(checked_broadcast(spread_of, of=(scored,)), "town", "left").groupBy("id").agg(F.min(F.struct(F.coalesce("pcs", F.lit(1)).alias("pcs"), "town")).alias("m"), F.collect_set("town").alias("all"))
    both = records.select("id", "pc", "names").join(by_code, "id", "left").join(named, "id", "left")
    town = F.when(F.col("code_town").isNull(), F.col("m.town")).when(F.col("all").isNull() | F.array_contains("all", F.col("code_town")) | F.startswith("code_town", "m.town") | F.startswith("m.town", "code_town"), F.col("code_town")).otherwise(F.col("m.town"))
    town = F.coalesce(town, F.get("names", F.lit(0)), F.when(F.col("pc") != "", F.col("pc")))
    return cut(both.select("id", town.alias("town")).where("town is not null"))


def street_types(records: DataFrame, share: float = 0.0015, least: int = 3) -> list[str]:
    """Words that stand beside many different street names in many places (street, rue, str.): those with at least
    ``least`` partners and postcodes and ``share`` of all different streets and postcodes. Both shares are of different
    values, so rows that say the same again change nothing. Streets have few words, so the list has a bound of about
    4 / share."""
    streets = records.select(F.explode("words").alias("word"), F.concat_ws(" ", "words").alias("all"), "pc").distinct()
    n = streets.agg(F.count_distinct("all").alias("streets"), F.count_distinct("pc").alias("pcs")).first()
    counted = streets.where("word <> all").groupBy("word").agg(F.count_distinct("all").alias("partners"), F.count_distinct("pc").alias("pcs"))
    many = (F.col("partners") >= max(least, n.streets * share)) & (F.col("pcs") >= max(least, n.pcs * share))
    return sorted(r[0] for r in counted.where(many).select("word").collect())


def split_streets(records: DataFrame, types: list[str]) -> DataFrame:
    """Adds kind (the street's type) and tokens (the words of its name without it): a word of its own, or the end of a
    word. Where two types can end the word (rg. and g.), the record has a row for each."""
    listed = F.array(*[F.lit(t) for t in types]) if types else F.array().cast("array<string>")
    own = F.array_distinct(F.filter("words", lambda w: F.array_contains(listed, w)))
    rest = F.filter("words", lambda w: ~F.array_contains(listed, w))
    joined = F.array_join(rest, "")
    ends = [t for t in sorted(types, key=len, reverse=True) if len(t) >= 2]
    # a short type without a point may be the end of any name; it is split off only as a word of its own
    ends = [t for t in ends if t.endswith(".") or len(t) >= 3]
    pattern = "|".join(re.escape(t) for t in ends) or "(?!)"
    glued = F.regexp_extract(joined, rf"^(.{{3,}}?)({pattern})$", 2)
    longer = F.regexp_extract(joined, rf"^(.{{3,}})({pattern})$", 2)
    # the words of the name, the last of them without the type
    bare = lambda g: F.filter(F.transform(rest, lambda w, i: F.when(i == F.size(rest) - 1, F.substring(w, F.lit(1), F.length(w) - F.length(g))).otherwise(w)), lambda w: w != "")
    clean = lambda c: F.when(F.size(c) == 0, F.col("words")).otherwise(c)
    split = lambda kind, c: F.struct(kind.alias("kind"), clean(c).alias("tokens"))
    fits = lambda g: F.length(F.element_at(rest, -1)) >= F.length(g)
    ways = (
        F.when(F.size(own) > 0, F.array(split(F.element_at(own, 1), rest)))
        .when((glued != "") & fits(glued), F.array_distinct(F.array(split(glued, bare(glued)), split(F.when(fits(longer), longer).otherwise(glued), bare(F.when(fits(longer), longer).otherwise(glued))))))
        .otherwise(F.array(split(F.lit(""), rest)))
    )
    return records.withColumn("way", F.explode(ways)).select(*records.columns, "way.*")


def significant(pairs: DataFrame, least: int = 2, g2: float = 10.83) -> DataFrame:
    """short, long: token pairs of ``pairs`` (a, b, n: how many aligned pairs have them, equal tokens included) that stand
    together more often than chance: the likelihood ratio over the four cells of the pair's table exceeds ``g2``
    (p < 0.001), and a fifth of the rarer one's pairs with other tokens are with the other. The shorter token must
    abbreviate the longer one."""
    both = pairs.select("a", "b", "n").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    both = cut(both.groupBy("a", "b").agg(F.sum("n").alias("n")))
    side = both.groupBy("a").agg(F.sum("n").alias("na"), F.sum(F.when(F.col("a") != F.col("b"), F.col("n"))).alias("other_a"))
    total = both.agg(F.sum("n")).first()[0] or 1
    rows = both.where("a <> b").where(F.col("n") >= least).join(checked_broadcast(side), "a").join(checked_broadcast(side.select(F.col("a").alias("b"), F.col("na").alias("nb"), F.col("other_a").alias("other_b"))), "b")
    n, na, nb, t = F.col("n"), F.col("na"), F.col("nb"), F.lit(float(total))
    cell = lambda o, r, c: F.when(o > 0, o * F.log(o * t / (r * c))).otherwise(0.0)
    ratio = 2 * (cell(n, na, nb) + cell(na - n, na, t - nb) + cell(nb - n, t - na, nb) + cell(t - na - nb + n, t - na, t - nb))
    rows = rows.where((n * t > na * nb) & (ratio >= g2) & (n >= 0.2 * F.least("other_a", "other_b")))
    letters = F.split(F.replace("a", F.lit("."), F.lit("")), "")
    begins = F.rlike(F.replace("b", F.lit("."), F.lit("")), F.concat(F.lit("^"), F.array_join(letters, ".*")))
    size = lambda c: F.length(F.replace(c, F.lit("."), F.lit("")))
    shorter = F.struct(size("a"), na, F.col("a")) < F.struct(size("b"), nb, F.col("b"))
    return rows.where(shorter & begins & (F.size(letters) > 0)).select(F.col("a").alias("short"), F.col("b").alias("long"), "n")


def token_pairs(keys: DataFrame) -> DataFrame:
    """a, b, n: tokens of street names of one town and house number whose other tokens are the same. ``keys``: block,
    tokens, key. A name of one token has no others and aligns with nothing."""
    several = keys.where("size(tokens) >= 2").select("block", "key", "tokens", F.posexplode("tokens").alias("pos", "token"))
    others = F.filter("tokens", lambda w, i: i != F.col("pos"))
    slots = cut(several.select("block", "pos", F.array_join(others, " ").alias("others"), "token").distinct())
    a, b = (slots.select("block", "pos", "others", F.col("token").alias(c)) for c in "ab")
    return a.join(b, ["block", "pos", "others"]).where("a <= b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def rewritten(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """``keys`` (key, tokens) whose tokens the rules (short, long, n) change, with the tokens that they become."""
    best = rules.groupBy("short").agg(F.max_by("long", "n").alias("long"))
    told = keys.select("key", F.posexplode("tokens").alias("pos", "short")).join(checked_broadcast(best), "short", "left")
    after = told.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("long", "short").alias("w")))).alias("t"), F.max(F.col("long").isNotNull()).alias("moved"))
    return after.where("moved").select("key", F.transform("t", lambda x: x["w"]).alias("tokens"))


def same_places(records: DataFrame, max_rounds: int = 12) -> tuple[DataFrame, dict[str, list[str]]]:
    """id, place of each record with a street and a town; and the mined rewrites of street types.

    ``records``: id, text, pc_given. A place is a town, a house number with its letter and a street: the same type
    after rewriting (or none told), names within :func:`allowed_edits`; a street with a misspelt type is compared whole.
    Rewrites are mined of types (from keys with names alike) and of the tokens of names (from keys that agree in all
    other tokens); each round normalises the names again, matches the changed ones again and mines again, until no rewrite
    is new; raises if ``max_rounds`` don't suffice. Null, empty and incomplete texts have no place. Equal texts are one
    key, so repeated rows change no count; candidates are looked up by segments within (town, number).
    """
    base = cut(records.where("text is not null").select("id", parsed("text", "pc_given").alias("p")).select("id", "p.*"))
    located = base.where("size(words) > 0 and num <> ''").join(towns(base), "id")
    located = split_streets(located, street_types(base.where("size(words) > 0")))
    name = lambda: F.replace(F.array_join("tokens", ""), F.lit("."), F.lit(""))
    located = cut(located.select("id", F.concat_ws("|", "town", "num").alias("block"), "kind", "tokens", F.concat_ws("|", "town", "num", "kind", F.array_join("tokens", " ")).alias("k")))
    keys = cut(located.groupBy("k").agg(F.first("block").alias("block"), F.first("kind").alias("kind"), F.first("tokens").alias("tokens"), F.min("id").alias("key")))
    # two readings of one record are two keys
    keys = cut(keys.withColumn("key", F.xxhash64("k")))

    def matched(of: DataFrame, near: DataFrame) -> DataFrame:
        sides = lambda c: of.select("block", F.col("core").alias(c), F.col("kind").alias(f"kind_{c}"), F.col("key").alias(f"key_{c}"))
        return near.join(sides("a"), ["block", "a"]).join(sides("b"), ["block", "b"]).where("key_a <> key_b").select("kind_a", "kind_b", F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b"), (F.col("key_a") < F.col("key_b")).alias("straight"))

    now = cut(keys.select("block", "kind", "key", "tokens", name().alias("core")))
    strings = now.select("block", F.col("core").alias("s")).distinct()
    near = similar_pairs(strings).select("block", "a", "b").unionByName(strings.select("block", F.col("s").alias("a"), F.col("s").alias("b")))
    alike = cut(matched(now, near).select("kind_a", "kind_b", "key_a", "key_b").distinct())
    rewrites: dict[str, list[str]] = {}
    rules = None
    for _ in range(max_rounds):
        kinds = alike.where("kind_a <> '' and kind_b <> ''").groupBy(F.least("kind_a", "kind_b").alias("a"), F.greatest("kind_a", "kind_b").alias("b")).agg(F.count(F.lit(1)).alias("n"))
        # street types are few (see street_types)
        for r in significant(kinds).collect():
            if r.long not in rewrites.get(r.short, []):
                rewrites.setdefault(r.short, []).append(r.long)
        mined = significant(token_pairs(now))
        mined = cut(mined if rules is None else mined.join(checked_broadcast(rules.select("short", "long"), of=(rules,)), ["short", "long"], "left_anti"))
        if mined.limit(1).count() == 0:
            break  # names and so pairs stay as they are: mining them again would find the same
        rules = mined if rules is None else rules.unionByName(mined)
        changed = cut(rewritten(now.select("key", "tokens"), rules).join(keys.select("key", "block", "kind"), "key").select("block", "kind", "key", "tokens", name().alias("core")))
        now = cut(now.join(changed.select("key"), "key", "left_anti").select("block", "kind", "key", "tokens", "core").unionByName(changed))
        again = segment_pairs(changed.select("block", F.col("core").alias("s")).distinct(), now.select("block", F.col("core").alias("s")).distinct()).select("block", "a", "b")
        alike = cut(alike.unionByName(matched(now, again).select("kind_a", "kind_b", "key_a", "key_b")).distinct())
    else:
        raise RuntimeError(f"new rewrites still appeared after {max_rounds} rounds")
    told = F.create_map(*[x for k, v in rewrites.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]) if rewrites else None
    forms = lambda c: F.concat(F.array(F.col(c)), F.coalesce(told[F.col(c)], F.array())) if rewrites else F.array(F.col(c))
    agree = F.arrays_overlap(forms("kind_a"), forms("kind_b")) | (F.col("kind_a") == "") | (F.col("kind_b") == "")
    edges = alike.where(agree).select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))
    edges = edges.unionByName(untyped_pairs(now, rewrites))
    mine = cut(hot_key_join(located.select("id", "k"), keys.select("k", "key"), "k").select("id", "key").distinct())
    # the keys of a record with two readings are one
    edges = edges.unionByName(mine.groupBy("id").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b").select("a", "b"))
    grouped = components(edges.unionByName(keys.select(F.col("key").alias("a"), F.col("key").alias("b"))))
    of = hot_key_join(mine, grouped.withColumnRenamed("node", "key"), "key")
    return of.groupBy("id").agg(F.min("component").alias("place")), rewrites


def untyped_pairs(keys: DataFrame, rewrites: dict[str, list[str]]) -> DataFrame:
    """a, b: keys whose street has no known type (it may be misspelt) and keys that their whole street resembles, type
    included, in full and on either side of the name."""
    told = F.create_map(*[x for k, v in rewrites.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]) if rewrites else None
    forms = F.coalesce(told[F.col("kind")], F.array("kind")) if rewrites else F.array("kind")
    bare = keys.where("kind = ''").select("block", F.col("core").alias("s"), F.col("key").alias("a"))
    full = keys.where("kind <> ''").select("block", "core", F.col("key").alias("b"), F.explode(forms).alias("form"))
    full = full.withColumn("form", F.replace("form", F.lit("."), F.lit(""))).select("block", "b", F.explode(F.array(F.concat("core", "form"), F.concat("form", "core"))).alias("t"))
    near = segment_pairs(bare.select("block", "s").distinct(), full.select("block", F.col("t").alias("s")).distinct()).select("block", F.col("a").alias("s"), F.col("b").alias("t"))
    return near.join(bare, ["block", "s"]).join(full, ["block", "t"]).select("a", "b").distinct()
