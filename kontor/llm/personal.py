"""Personal information in free text (problem 9).

Method: information-theoretic sanitisation. The corpus tells how strongly the words before a span (its frame) reveal a
protected kind. Mailboxes, phone and identity numbers and postal addresses are candidates by their form, which may be
sure, likely or weak; what their frame tells is the log-odds, in bits, of sure against weak forms behind it in the whole
corpus, and form and frame together must exceed the disclosure threshold. For names, frames and given names are scored
by the bits they carry about spans whose name also stands in a mailbox of the same text. What exceeds the threshold is
generalised to a typed placeholder, cut by position.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kontor.operators.joins import checked_broadcast
from kontor.session import cut

L = r"[\p{L}\p{M}]"
AT = r"(?:@|＠|&#64;|&#x40;|%40|[ \t]*[\[({<][ \t]*(?:at|ät|@|arroba|arobase|chez)[ \t]*[\])}>][ \t]*|[ \t]+(?:AT|ÄT|ARROBA|AROBASE)[ \t]+|[ \t]+(?:at|arroba|arobase|chez)[ \t]+(?=[\w-]+[ \t]*[\[({]?[ \t]*(?:dot|punkt|point|punto)\b))"
DOT = r"(?:\.|．|&#46;|[ \t]*[\[({][ \t]*(?:dot|punkt|point|punto|\.)[ \t]*[\])}][ \t]*|[ \t]+(?:dot|punkt|point|punto|DOT|PUNKT|POINT|PUNTO)[ \t]+)"
AT_SIGN = regex.compile(AT)
DOMAIN = regex.compile(rf"[\p{{L}}\d](?:[\p{{L}}\d-]*[\p{{L}}\d])?(?:{DOT}[\p{{L}}\d](?:[\p{{L}}\d-]*[\p{{L}}\d])?)*?{DOT}\p{{L}}{{2,24}}(?![\p{{L}}\d-]|\.\p{{L}}{{2,}}\b)")
FILE = regex.compile(r"(?i)(?:^|[.])(?:\d+x)\.|\.(?:png|jpe?g|gif|svg|webp|pdf|css|js|ico|bmp|tiff?)$")

# What stands before the identity number of a person.
ID_CUE = (
    r"(?:Reisepass|Reisepaß|Pass-?(?:Nr\.?|Nummer|nummer)|Passport|Passeport|Pasaporte|Personalausweis(?:nummer|nr\.?|-Nr\.?)?|Ausweis(?:nr\.?|-Nr\.?|nummer)|Identity card|ID card|Carte (?:nationale )?d[’']identité|CNI|DNI|NIE|NIF"
    r"|Steuerliche Identifikationsnummer|Steuer-?(?:ID|IdNr\.?|Identifikationsnummer)|(?<!USt-)(?<!USt\.-)IdNr\.?|Tax ID|UTR|Numéro fiscal|N° fiscal|SPI|Sozialversicherungs(?:nummer|nr\.?|-Nr\.?)|SV-?(?:Nummer|Nr\.?)|RV-?Nummer|Rentenversicherungsnummer"
    r"|Social security|National Insurance|NI|NINO|SSN|Sécurité sociale|NIR|INSEE|Seguridad Social|NUSS|NSS)"
)
ID_NOISE = r"(?:[\s:.#°]|(?i:no|nr|n[°ºo]|number|nummer|num|número|numéro|lautet|is|est|es|de|la|le|with|mit|con|holder|shown|titular|du|des|number:))"
ID_VALUE = r"(?P<v>(?=[A-Z\d./ -]{0,6}\d)[A-Z]{0,3}[ ]?\d[A-Z\d]*(?:[ ./-](?=[A-Z]?\d|[A-Z]\b(?!\p{L}|\.\p{L}))[A-Z\d]+)*)"
ID = regex.compile(rf"(?<![\p{{L}}])(?i:(?P<cue>{ID_CUE}))(?=[\s:.#°]){ID_NOISE}{{0,40}}?{ID_VALUE}")

# A number of a phone has a prefix that no article or order number has, or stands behind a word for phones.
PHONE_PLAIN = r"(?:\+\d{1,3}|00\d{2}|\(0\d{1,5}\)|0\d)(?:[ \t]?\(0\))?(?:[ \t]?[./–-]?[ \t]?\d){6,12}"
PHONE = regex.compile(rf"(?<![\p{{L}}\d.,/+-])(?<!\d[ ]){PHONE_PLAIN}(?![\d]|[.,/-]\d|[ ]\d)")
# Words for phones.
PHONE_CUE = regex.compile(
    r"(?:\b(?i:tel(?:[ée]fono|efon|éphone|ephone)?|t[ée]l|phone|fax|telefax|t[ée]l[ée]copie|mobil(?:e|telefon)?|mob|m[óo]vil|handy|portable|llame al|rufen sie|call|appelez(?: le)?|ligne directe|durchwahl|hotline)\b|☎|✆|📞)[ \t]*[.:]*[ \t]*(?:(?i:nr|no|n[º°]|unter|at|au|al)\b[.:]?[ \t]*)?(?P<v>[+(]?\d(?:[ \t]?[()./–-]?[ \t]?[()]?\d){6,14})(?!\d)"
)
REGISTER = regex.compile(r"\b(?:RCS|SIREN|SIRET|HR[AB]|Registergericht|Registro Mercantil)\b[^\d\n]{0,80}$")
DATE = regex.compile(r"^\d{1,2}([./-])\d{1,2}\1\d{2,4}$")
NUMBER = regex.compile(r"(?<![\p{L}\d+/-])(?:\p{Lu}{1,2}-)?\d(?:[ ./-]?\d){5,14}(?![\p{L}\d])")

NUM = r"\d{1,4}(?:[ ]?[a-zA-Z](?![\p{L}\p{M}\d.]))?(?:[ ]?[-/][ ]?\d{1,4}[a-z]?)?(?![\d])"
UP = r"[\p{Lu}]"
WORD = rf"{UP}[\p{{L}}\p{{M}}’'-]*"
TYPE_DE = r"(?:stra(?:ß|ss)e|str\.|gasse|g\.|platz|pl\.|allee|al\.|ring|rg\.|weg|wg\.|damm|ufer|chaussee|steig|pfad|hof|markt|graben|STRASSE|STRAßE|STR\.|GASSE|PLATZ|ALLEE|RING|WEG)"
STREET_DE = rf"(?:{UP}[\p{{L}}\p{{M}}-]*?{TYPE_DE}|{UP}[\p{{L}}\p{{M}}-]+[ -](?:Stra(?:ß|ss)e|Str\.|Gasse|G\.|Platz|Pl\.|Allee|Al\.|Ring|Rg\.|Weg|Wg\.|STRASSE|GASSE|PLATZ|ALLEE|RING|WEG))[ ]?(?:Nr\.?[ ]?)?{NUM}"
STREET_FR = rf"\d{{1,4}}(?:[ ]?(?:bis|ter)|[ ]?[a-zA-Z](?![\p{{L}}.]))?,?[ ](?i:rue|r\.|avenue|av\.?|boulevard|bd\.?|place|pl\.|chemin|ch\.|impasse|imp\.|all[ée]e|all\.|quai|cours|route|rte|square|sq\.?)[ ](?:(?:de|du|des|la|le|les|l[’']|d[’'])[ ]?)*{WORD}(?:[ ]{WORD}){{0,1}}"
STREET_GB = rf"\d{{1,4}}[a-zA-Z]?[ ]{WORD}(?:[ ]{WORD}){{0,2}}?[ ](?i:street|st|road|rd|lane|ln|avenue|ave|close|cl|drive|dr|way|court|ct|square|sq|terrace|place|mews|hill|row|crescent)\b"
STREET_ES = rf"(?i:calle|c/|c\.|avenida|avda\.?|av\.|plaza|pza\.?|pl\.|paseo|p\.º|camino|cno\.?|ronda|carretera|ctra\.?|traves[íi]a)[ ]?(?:(?:de|del|la|las|los|el)[ ])*{WORD}(?:[ ]{WORD}){{0,1}},?[ ](?:n\.?[º°][ ]?|n[úu]m\.?[ ]?)?{NUM}"
PLACE = rf"{WORD}(?:[ ](?:an der|am|an dem|auf der|im|in der|bei|ob der|vor der|sur|sous|en|St\.?|Saint|de la|de los|de las|del|de|la|les|upon|on the|AN DER|AM|DEL|DE|ST)[ ]{WORD}|[ ]\({WORD}\))?"
CODE = r"(?:[A-Z]{1,2}[ ]?[-–][ ]?)?(?:\d{5}|\d{4}|\d{2}[ ]\d{3})(?!\d)"
CODE_GB = r"[A-Z]{1,2}\d{1,2}[A-Z]?[ ]?\d[A-Z]{2}\b"
GAP = r"(?:[ \t]*[,;|/·][ \t]*(?:\r?\n[ \t]*)?|[ \t]*\r?\n[ \t]*|[ \t]+[–-][ \t]+|[ \t](?:in|à|en)[ \t]|[ \t]{1,2})"
AFTER = rf"(?:{GAP}(?:{CODE}[ ]{{1,2}}{PLACE}|{CODE_GB}[ ]{{1,2}}{PLACE}|{PLACE}{GAP}{CODE_GB}|{CODE}(?![.,]?\d)))?"
CODED = regex.compile(rf"(?<!\d)(?:\d{{5}}|\d{{4}}|\d{{2}}[ ]\d{{3}})(?!\d)|{CODE_GB}")
ADDRESS = regex.compile(rf"(?<![\p{{L}}\p{{M}}\d])(?:{STREET_DE}|{STREET_ES}|{STREET_FR}|{STREET_GB}){AFTER}")

NAME = rf"{UP}(?:[\p{{Ll}}\p{{M}}’'][\p{{L}}\p{{M}}’']*|[\p{{Lu}}\p{{M}}’']+)"
FAMILY = rf"{NAME}(?:-{NAME})*"
GIVEN = rf"{NAME}(?:-{NAME})?"
STRAIGHT = regex.compile(rf"(?<![\p{{L}}\p{{M}}\d@.-])(?P<g>{GIVEN})(?:[ ]{UP}\.){{0,2}}[ ](?P<f>{FAMILY})(?![\p{{L}}\p{{M}}\d@])")
REVERSED = regex.compile(rf"(?<![\p{{L}}\p{{M}}\d@.-])(?P<f>{FAMILY}),[ ](?P<g>{GIVEN})(?:[ ]{UP}\.(?=[ ,;]))?(?![\p{{L}}\p{{M}}\d@])")
INITIAL = regex.compile(rf"(?<![\p{{L}}\p{{M}}\d@.-])(?P<g>{UP}\.(?:[ -]?{UP}\.)?)[ ]?(?P<f>{FAMILY})(?![\p{{L}}\p{{M}}\d@])")
INITIAL_LAST = regex.compile(rf"(?<![\p{{L}}\p{{M}}\d@.-])(?P<f>{FAMILY}),[ ](?P<g>{UP}\.(?:[ -]?{UP}\.)?)")
# Titles and forms of address.
TITLES = frozenset("dr prof dipl ing herr herrn frau mr mrs ms miss mme mlle monsieur madame m sr sra srta don doña sir".split())
NAME_BEFORE = regex.compile(rf"(?P<w>{UP}[\p{{L}}\p{{M}}’'-]+)[ ](?:{UP}\.[ ])?$")
LEGAL_AFTER = regex.compile(r"^[ ]*(?:&[ ]*Co\.?[ ]*)?(?:GmbH|AG|KG|OHG|oHG|UG|e\.\s?K|e\.\s?U|S\.?A\.?R\.?L|S\.?A\.?S|EURL|S\.L|S\.A|Ltd|LLP|PLC|plc|Inc|GMBH|LTD|SARL|SAS)\b")


def folded(word: str) -> str:
    text = unicodedata.normalize("NFKD", word.casefold())
    text = "".join(c for c in text if not unicodedata.combining(c))
    return text.replace("ae", "a").replace("oe", "o").replace("ue", "u")


def mail_spans(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of mailboxes: from each at sign, plain or disguised, backward over the local part and forward over the domain."""
    for m in AT_SIGN.finditer(text):
        a = m.start()
        if not a or not text[a - 1].isalnum() and not unicodedata.combining(text[a - 1]):
            continue
        while a and (text[a - 1].isalnum() or text[a - 1] in "._+-" or unicodedata.combining(text[a - 1])):
            a -= 1
        while a < m.start() and not text[a].isalnum():
            a += 1
        if domain := DOMAIN.match(text, m.end()):
            yield a, domain.end()


#: What the form of a span tells by itself, in bits: a label or an own sign; the shape alone; a shape with signs against it.
SURE, LIKELY, WEAK = 6.0, 2.0, -4.0


def formal_candidates(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, bits of its form) of what may be mailboxes, identity numbers, addresses and phone numbers; they
    don't overlap."""
    taken: list[tuple[str, int, int, float]] = []

    def add(kind: str, a: int, b: int, bits: float) -> None:
        if a < b and all(b <= x or a >= y for _, x, y, _ in taken):
            taken.append((kind, a, b, bits))

    weak: list[tuple[str, int, int]] = []
    for a, b in mail_spans(text):
        if FILE.search(text[a:b]):
            weak.append(("email", a, b))
        else:
            add("email", a, b, SURE)
    digits = any(c.isdigit() for c in text)
    for m in ID.finditer(text) if digits else ():
        value, a = m["v"], m.start("v")
        a, b = a + len(value) - len(value.lstrip(" ")), a + len(value.rstrip(" ./-"))
        if sum(c.isdigit() for c in value) >= 5:
            add("id_number", a, b, SURE)
        else:
            weak.append(("id_number", a, b))
    for m in ADDRESS.finditer(text) if digits else ():
        add("address", m.start(), m.end(), SURE if CODED.search(m[0]) else LIKELY)
    for m in PHONE_CUE.finditer(text) if digits else ():
        add("phone", m.start("v"), m.end("v"), SURE)
    for m in PHONE.finditer(text) if digits else ():
        left = text[max(0, m.start() - 90) : m.start()]
        if sum(c.isdigit() for c in m[0]) >= 10 and not DATE.match(m[0]) and not REGISTER.search(left):
            add("phone", m.start(), m.end(), LIKELY)
        else:
            weak.append(("phone", m.start(), m.end()))
    # other long numbers are hardly phones; they tell which frames announce articles, orders and the like
    weak.extend(("phone", m.start(), m.end()) for m in (NUMBER.finditer(text) if digits else ()))
    for kind, a, b in weak:
        add(kind, a, b, WEAK)
    return taken


def formal_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the candidates whose form discloses by itself."""
    return [(k, a, b) for k, a, b, bits in formal_candidates(text) if bits > 0]


def name_spans(text: str, taken: list[tuple[str, int, int]]) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, form, given, family) of name-shaped spans outside of other spans and company names."""
    for form, pattern in (("g f", STRAIGHT), ("f, g", REVERSED), ("i f", INITIAL), ("f, i", INITIAL_LAST)):
        at = 0
        while m := pattern.search(text, at):
            at = m.start() + max(1, len(m["g"] if form == "g f" else m["f"]) if form in ("g f", "f, g") else len(m[0]))
            if m["g"].casefold() in TITLES or m["f"].casefold() in TITLES:
                continue
            if form == "i f" and (w := NAME_BEFORE.search(text[max(0, m.start() - 40) : m.start()])) and w["w"].casefold() not in TITLES:
                continue  # the middle initial of a longer name
            if LEGAL_AFTER.match(text[m.end() : m.end() + 20]) or any(m.start() < y and m.end() > x for _, x, y in taken):
                continue
            yield m.start(), m.end(), form, m["g"], m["f"]


def before(text: str, start: int) -> str:
    """The two words before a span, titles left out: its frame."""
    left = regex.sub(r"(?:\b(?:Dr|Prof|Dipl|Ing|Herrn?|Frau|Mrs?|Ms|Mme|Monsieur|Madame|M|Sr|Sra|Don|Doña|Mag|med)\b\.?-?[ ]*)+$", "", text[max(0, start - 60) : start])
    return " ".join(regex.findall(r"[\p{L}\p{M}]+|[:;(☎✆📞]|\n", left)[-2:]).casefold()


SPANS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("version", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("span", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("form", T.StringType()),
        T.StructField("given", T.StringType()),
        T.StructField("family", T.StringType()),
        T.StructField("frame", T.StringType()),
        T.StructField("seed", T.IntegerType()),
        T.StructField("bits", T.DoubleType()),
    ]
)


def versioned(docs: DataFrame) -> DataFrame:
    """doc_id, text and version, which tells rows of one doc_id with other texts apart."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("version"))


def candidates(docs: DataFrame) -> DataFrame:
    """All formal spans and all name-shaped spans of each text, with their places and terms; narrow, whole texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, version, text in zip(pdf["doc_id"], pdf["version"], pdf["text"], strict=True):
                if not text:
                    continue
                taken = formal_candidates(text)
                rows.extend((doc, version, k, text[a:b], a, b, None, None, None, before(text, a), 0, bits) for k, a, b, bits in taken)
                locals_ = [folded(regex.split(AT, text[a:b])[0]) for k, a, b, _ in taken if k == "email"]
                for a, b, form, given, family in name_spans(text, [(k, x, y) for k, x, y, bits in taken if bits > 0]):
                    g, f = folded(given).strip("."), folded(family)
                    seed = int(any(f in x and (g in x or len(g) <= 2) for x in locals_ if len(f) > 3))
                    own = any(x in (f"{g}.{f}", f"{f}.{g}", f"{g}_{f}", f"{g}-{f}") for x in locals_)
                    rows.append((doc, version, "person", text[a:b], a, b, form, g, f, before(text, a), seed, SURE if own else 0.0))
            yield pd.DataFrame(rows, columns=[f.name for f in SPANS])

    return versioned(docs).where("text is not null").select("doc_id", "version", "text").mapInPandas(run, SPANS)


def disclosed(formal: DataFrame) -> DataFrame:
    """The formal candidates whose form and frame together tell more than 0 bits.

    A frame tells log2((s + 1/2) / (w + 1/2)): s sure and w weak forms of the kind stand behind it in the corpus, without
    the candidate's own. A frame never seen tells nothing. Counts are aggregated map-side; frames are broadcast if they
    were measured small, else shuffled."""
    frames = formal.where("frame <> ''").groupBy("kind", "frame").agg(F.sum((F.col("bits") >= SURE).cast("int")).alias("s"), F.sum((F.col("bits") <= WEAK).cast("int")).alias("w")).where("s > 0 or w > 0")
    known = formal.join(checked_broadcast(frames), ["kind", "frame"], "left")
    s = F.coalesce("s", F.lit(0)) - (F.col("bits") >= SURE).cast("int") * F.col("s").isNotNull().cast("int")
    w = F.coalesce("w", F.lit(0)) - (F.col("bits") <= WEAK).cast("int") * F.col("w").isNotNull().cast("int")
    return known.where(F.col("bits") + F.log2((s + 0.5) / (w + 0.5)) > 0).select(formal.columns)


def spans(docs: DataFrame, bits: float = 2.0, least: int = 3) -> DataFrame:
    """doc_id, version, kind, span, start, end of every place of personal information; places may overlap.

    Formal kinds as :func:`disclosed` has them. A frame (the two words before a span) or a given name discloses persons if
    the share of seeded spans among its spans exceeds the share among all by ``bits`` bits and ``least`` of them are
    seeded; a given name also if that holds for spans in disclosing frames. A span is a person if its given name discloses
    or its whole name is the local part of a mailbox in the same text; an initial with a family name if its frame
    discloses, or if the family name is one of a person in the same text. Null and empty texts hold nothing. Counts cover
    the whole corpus and are aggregated map-side.
    """
    found = cut(candidates(docs))
    columns = ["doc_id", "version", "kind", "span", "start", "end"]
    formal = disclosed(found.where("kind <> 'person'")).select(columns)
    names = found.where("kind = 'person'")
    straight = names.where("form in ('g f', 'f, g')")
    base = straight.agg((F.sum("seed") + 1) / (F.count(F.lit(1)) + 1)).first()[0] or 0.01

    def disclosing(rows: DataFrame, term: str, sign: str) -> DataFrame:
        counted = rows.where(F.col(term) != "").groupBy(term).agg(F.sum(sign).alias("s"), F.count(F.lit(1)).alias("n"))
        return counted.where((F.col("s") >= least) & (F.log2(F.col("s") / F.col("n") / F.lit(float(base))) >= bits)).select(term)

    frames = cut(disclosing(straight, "frame", "seed"))
    framed = straight.join(checked_broadcast(frames.withColumn("open", F.lit(1))), "frame", "left").withColumn("sign", F.greatest("seed", F.coalesce("open", F.lit(0))))
    base = max(float(base), 0.02)
    given = cut(disclosing(framed, "given", "sign"))
    # a second round: frames by the given names found, given names by those frames
    with_given = straight.join(checked_broadcast(given.withColumn("sign", F.lit(1))), "given", "left").withColumn("sign", F.coalesce("sign", F.lit(0)))
    frames = cut(disclosing(with_given, "frame", "sign"))
    framed = straight.join(checked_broadcast(frames.withColumn("open", F.lit(1))), "frame", "left").withColumn("sign", F.greatest("seed", F.coalesce("open", F.lit(0))))
    given = cut(disclosing(framed, "given", "sign"))
    persons = straight.join(checked_broadcast(given.withColumn("known", F.lit(True))), "given", "left").where(F.col("known") | (F.col("bits") >= SURE))
    persons = cut(persons.select(*columns, "family"))
    initials = names.where("form in ('i f', 'f, i')")
    by_frame = initials.join(checked_broadcast(frames), "frame", "left_semi").select(columns)
    by_family = initials.join(persons.select("doc_id", "version", "family").distinct(), ["doc_id", "version", "family"], "left_semi").select(columns)
    by_mail = initials.where("seed = 1").select(columns)
    told = persons.select(columns).unionByName(by_frame).unionByName(by_family).unionByName(by_mail).distinct()
    # what is a person in one place of a text is one wherever it stands there as a candidate
    people = names.select(columns).join(told.select("doc_id", "version", "span").distinct(), ["doc_id", "version", "span"], "left_semi").select(columns)
    return formal.unionByName(people).distinct()


def found(docs: DataFrame, bits: float = 2.0, least: int = 3) -> DataFrame:
    """doc_id, kind, span: each distinct span of :func:`spans`, exactly as it stands in the text; repeated rows give one
    row each span."""
    return spans(docs, bits, least).select("doc_id", "kind", "span").distinct()


def replaced(text: str | None, places: list) -> str | None:
    """``text`` with each place (start, end, kind) as its kind in brackets; places that overlap become one, named by the
    first and, of equal starts, the longest."""
    if text is None or places is None or not len(places):
        return text
    out, at = [], 0
    for start, end, kind in sorted(((p["start"], p["end"], p["kind"]) for p in places), key=lambda p: (p[0], -p[1])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


@F.pandas_udf(T.StringType())
def replaced_places(texts: pd.Series, places: pd.Series) -> pd.Series:
    return pd.Series([replaced(t, p) for t, p in zip(texts, places, strict=True)], dtype="object")


def sanitised(docs: DataFrame, places: DataFrame) -> DataFrame:
    """doc_id, text with every place of ``places`` (as :func:`spans` gives them) replaced by its kind in brackets, cut by
    position, so all other letters stay. Texts without places stay as they are, null stays null; rows stay rows."""
    listed = places.groupBy("doc_id", "version").agg(F.collect_set(F.struct("start", "end", "kind")).alias("places"))
    joined = versioned(docs).join(listed, ["doc_id", "version"], "left")
    with_places = joined.where("places is not null").select("doc_id", replaced_places("text", "places").alias("text"))
    return with_places.unionByName(joined.where("places is null").select("doc_id", "text"))
