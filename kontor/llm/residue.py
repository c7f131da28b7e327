"""Template residue and error pages among crawled pages (problem 5).

Method: the lines that a reader without scripts sees are counted by host; lines that recur on most of a
host's pages are boilerplate and are subtracted; a page is excluded if it shows an unfilled slot, filler or a
stand-in address, or if its residual holds nothing but an error message or a demand for scripts.
"""

from __future__ import annotations

import html as html_lib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kontor.operators.joins import checked_broadcast, hot_key_join
from kontor.session import cut

UNSEEN = re.compile(r"(?is)<!--.*?(?:-->|$)|<(script|style|template|head|svg|textarea|select|iframe|object)\b[^>]*>.*?(?:</\1\s*>|$)")
SAMPLES = re.compile(r"(?is)<(pre|code|samp|kbd|xmp)\b[^>]*>.*?(?:</\1\s*>|$)")
FRAME = re.compile(r"(?is)<(nav|footer|header)\b[^>]*>(.*?)(?:</\1\s*>|$)")
BREAKS = re.compile(r"(?is)</?(?:p|br|hr|div|h[1-6]|li|ul|ol|dl|dt|dd|title|body|html|main|section|article|aside|noscript|form|td|tr|th|table|center|nav|footer|header|blockquote|address|figure|label|option|button)\b[^>]*>")
TAG = re.compile(r"(?s)<[a-zA-Z/!?][^>]*>")
TITLE = re.compile(r"(?is)<title\b[^>]*>(.*?)</title\s*>")


def seen_lines(page: str | None) -> list[tuple[str, bool]]:
    """Lines shown without scripts, in order, each with whether it stands in a navigation, footer or header."""
    if not page:
        return []
    body = SAMPLES.sub("\n", UNSEEN.sub(" ", page))
    body = FRAME.sub(lambda m: "\n" + re.sub(r"(^|\n)", "\n\x00", BREAKS.sub("\n", m[2])) + "\n", body)
    out = []
    for line in TAG.sub("", BREAKS.sub("\n", body)).split("\n"):
        framed = "\x00" in line
        text = " ".join(html_lib.unescape(line.replace("\x00", "")).split())
        if text:
            out.append((text, framed))
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("line", T.StringType()), T.StructField("framed", T.BooleanType())])))
def page_lines(pages: pd.Series) -> pd.Series:
    return pd.Series([[{"line": a, "framed": b} for a, b in seen_lines(p)] for p in pages])


@F.pandas_udf(T.StringType())
def page_title(pages: pd.Series) -> pd.Series:
    def one(p: str | None) -> str:
        m = TITLE.search(p) if p else None
        return " ".join(html_lib.unescape(TAG.sub("", m[1])).split()) if m else ""

    return pd.Series([one(p) for p in pages])


# Delimiters that hardly stand in real text, and those that do.
SURE_SLOT = (
    r"\{\{[^{}]{1,60}\}\}|\[\[[^\[\]]{1,60}\]\]|\{%[^{}%]{1,60}%\}|\*\|[^|*]{1,60}\|\*|@@[^@\s][^@]{0,58}@@|\$\$_[^$]{1,60}_\$\$"
    r"|__\p{L}[\p{L}\d._ -]{0,58}?__|%\p{L}[\p{L}\d._ -]{0,58}?\p{L}%|\$\{[^{}]{1,60}\}"
)
MAYBE_SLOT = r"\{([^{}%]{2,60})\}|\[([^\[\]]{2,60})\]|<([^<>]{2,60})>|«([^«»]{2,60})»|#(\p{L}[\p{L}._ -]{1,58}\p{L})#"
# First words of slots that ask the owner of a site to fill them.
ASKING = r"(?i)^\s*(?:ihre?|deine?|hier|your|insert|enter|votre|vos|ins[ée]rer|indiquez|su|tu|inserte|escriba|introduzca|il tuo|la tua|inserisci)\b\s*\S"
#: Names of fields, as inhaber.name or phone_number.
NAMELIKE = r"^\p{L}+(?:[._]\p{L}+)+$"
# Wording of filler in the languages of the corpus.
FILLER = (
    r"(?i)\blorem ipsum\b|\bdolor sit amet\b|\bconsectetur\b|\bblindtexte?\b|\bplatzhaltertext\b|\bdummy ?text\b|\bfiller text\b|\bplaceholder text\b|\bsample text\b"
    r"|hier steht (?:ihr|dein|der) text|ersetzen sie diesen (?:absatz|text)|diesen (?:absatz|text) (?:durch|ersetzen)|wird gerade bef[üu]llt|[üu]berschrift eingeben"
    r"|your text (?:goes )?here|replace this (?:paragraph|text)|this (?:paragraph|text) is (?:only |just )?(?:a )?(?:filler|placeholder|dummy)|(?:type|write|add) your (?:text|content)"
    r"|votre texte ici|remplacez ce (?:paragraphe|texte)|texte? (?:factice|de remplissage|fictif|bouche-trou)|faux[- ]texte|saisissez votre (?:texte|titre)"
    r"|(?:su|tu) texto aqu[íi]|(?:sustituya|reemplace|cambie) este (?:p[áa]rrafo|texto)|texto (?:de relleno|simulado|ficticio)|escriba (?:aqu[íi]|su texto)"
)
# Wording of messages that stand instead of a page's content.
SCRIPTS = r"(?i)java ?script|\bskripte?n?\b|\bscripts?\b|\bscripting\b"
ERRORS = (
    r"(?i)\b[45]\d\d\b|not found|introuvable|no (?:se )?(?:existe|encontrad)|gibt es nicht|nicht (?:gefunden|mehr verf[üu]gbar)|n[’']existe (?:plus|pas)|no longer exists|ya no existe|pas trouv|server ?fehler|internal server|erreur|error|fehler"
    r"|bad gateway|gateway time|database connection|datenbank|base de donn[ée]es|base de datos|maintenance|wartung|mantenimiento|unavailable|indisponible|no disponible|\bindex of /|directory listing|nicht erreichbar"
    r"|denied|forbidden|verweigert|berechtigung|refus[ée]|denegad|non autoris|sitzung|session|sesi[óo]n|suspended|gesperrt|suspend|parked|geparkt|zum verkauf|for sale|[àa] vendre|en venta|aparcado"
    r"|too many requests|slow down|trop de requ|demasiadas|checking your browser|v[ée]rif\w* (?:de )?(?:votre|su) navigat|comprobando|browser wird gepr|schiefgelaufen|went wrong|oups|ups!|oops|algo (?:ha )?(?:salido|fue) mal|probl[èe]me"
    r"|coming soon|under construction|im aufbau|en construction|en construcci[óo]n"
)


def inner_names(c, pattern: str):
    """Names between the delimiters of each match, in one spelling."""
    found = F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1))
    return F.transform(found, lambda x: F.lower(F.regexp_replace(x, r"[^\p{L}\d.]+", "")))


def excluded_pages(pages: DataFrame, stand_ins: DataFrame, recurs: float = 0.5, least_urls: int = 3, rest_chars: int = 40, subtract: bool = True) -> DataFrame:
    """Pages to exclude: page_id, reason (the first of slot, filler, address, message).

    ``pages``: page_id, domain, url, html. ``stand_ins``: kind (local, domain), value. A line is boilerplate of
    its host if it stands on at least ``recurs`` of the host's URLs and on ``least_urls`` of them, messages too; hosts of less than twice
    as many URLs show theirs also by the tags of navigation, footer and header. A page has only a message if a line of its
    residual is one and the other lines of it (without the page's title and company name) have fewer than ``rest_chars``
    characters together, or if its residual is empty and its boilerplate is a message and no more than that. Slots, filler and stand-in
    addresses exclude a page wherever they stand, since readers see them in a recurrent footer too. ``subtract`` set to
    false leaves the boilerplate in, to show what it does. A slot in single brackets counts if its name also
    occurs in delimiters that leave no doubt, looks like a field's name or asks to be filled. A line is filler by
    its wording, or if nine tenths of its words also stand in lines of mock Latin. Null and empty pages are never excluded;
    repeated rows have one result per page_id; other columns are ignored.

    Lines are shuffled as hashes with their flags, and counted with map-side aggregation, so a
    host with a third of all pages is spread over its lines. Names and stand-ins are broadcast after a count.
    """
    base = pages.select("page_id", F.coalesce("domain", F.lit("")).alias("host"), F.coalesce("url", F.lit("")).alias("url"), page_lines("html").alias("lines"), page_title("html").alias("title"))
    lines = base.select("page_id", "host", "url", "title", F.posexplode("lines").alias("no", "l")).select("page_id", "host", "url", "title", "no", "l.line", "l.framed")
    at = r"(?i)([\p{L}\d._%+-]+)\s*(?:@|[\[({]\s*(?:at|ät|arroba|arobase|chez)\s*[\])}])\s*((?:[\p{L}\d-]+(?:\.|\s*[\[({]\s*(?:dot|punkt|point|punto)\s*[\])}]\s*))+\p{L}{2,})"
    pointed = lambda x: F.regexp_replace(F.regexp_replace(x, r"(?i)[\[({]\s*(?:dot|punkt|point|punto)\s*[\])}]", "."), r"\s+", "")
    every = lambda g: F.regexp_extract_all("line", F.lit(at), F.lit(g))
    addresses = F.transform(F.arrays_zip(every(1).alias("a"), every(2).alias("b")), lambda x: F.struct(F.lower(x["a"]).alias("local"), F.lower(pointed(x["b"])).alias("mail_domain")))
    # cheap tests spare most lines the long patterns: a slot needs a delimiter, an address an at sign or a bracketed word
    marked = F.col("line").rlike(r"[{}\[\]<>«»#%@*$_]")
    mailed = F.contains("line", F.lit("@")) | F.col("line").rlike(r"(?i)[\[({]\s*(?:at|ät|arroba|arobase|chez)\s*[\])}]")
    none = F.array().cast("array<string>")
    given = lambda test, c, rest: F.when(test, c).otherwise(rest)
    lines = lines.select(
        "page_id",
        "host",
        "url",
        "no",
        "framed",
        F.when(~F.col("line").rlike(r"\d"), F.regexp_extract_all(F.lower("line"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("words"),
        F.col("line").rlike(r"(?i)\blorem\b|\bipsum\b|dolor sit amet").alias("latin"),
        F.length("line").alias("chars"),
        F.xxhash64(F.regexp_replace(F.lower("line"), r"\d+", "0")).alias("h"),
        given(marked, inner_names(F.col("line"), SURE_SLOT), none).alias("sure"),
        given(marked, inner_names(F.col("line"), MAYBE_SLOT.replace("(", "(?:").replace("(?:?:", "(?:")), none).alias("maybe"),
        given(marked, F.exists(F.regexp_extract_all(F.col("line"), F.lit(f"({MAYBE_SLOT.replace('(', '(?:').replace('(?:?:', '(?:')})"), F.lit(1)), lambda x: F.regexp_replace(x, r"^[^\p{L}]+|[^\p{L}]+$", "").rlike(f"{ASKING}|{NAMELIKE}")), F.lit(False)).alias("asking"),
        F.col("line").rlike(FILLER).alias("filler"),
        given(mailed, addresses, F.array().cast("array<struct<local:string,mail_domain:string>>")).alias("mails"),
        # a longer line is no message, as below
        ((F.length("line") < 200) & (F.col("line").rlike(ERRORS) | F.col("line").rlike(SCRIPTS))).alias("message"),
        ((F.length("title") > 0) & (F.startswith(F.col("title"), F.col("line")) | (F.col("line") == F.col("title")))).alias("named"),
    )
    lines = cut(lines)
    names = lines.select(F.explode("sure").alias("name")).where("name <> ''").distinct()
    listed = stand_ins.where("value is not null").select("kind", F.lower("value").alias("value")).distinct()
    locals_ = listed.where("kind = 'local'").select(F.col("value").alias("local"), F.lit(1).alias("is_local"))
    domains = listed.where("kind = 'domain'").select(F.col("value").alias("mail_domain"), F.lit(1).alias("is_domain"))

    slots = lines.where((F.size(F.filter("sure", lambda x: x != "")) > 0) | F.col("asking")).select("page_id", F.lit("1 slot").alias("reason"))
    brackets = lines.select("page_id", F.explode("maybe").alias("name")).join(checked_broadcast(names), "name", "left_semi").select("page_id", F.lit("1 slot").alias("reason"))
    filler = lines.where("filler").select("page_id", F.lit("2 filler").alias("reason"))
    latin = lines.where("latin").select(F.explode("words").alias("word")).distinct()
    mock = (
        lines.where("size(words) >= 5")
        .select("page_id", "no", F.size("words").alias("n"), F.explode("words").alias("word"))
        .join(checked_broadcast(latin), "word", "left_semi")
        .groupBy("page_id", "no", "n")
        .agg(F.count(F.lit(1)).alias("known"))
        .where("known >= 0.9 * n")
        .select("page_id", F.lit("2 filler").alias("reason"))
    )
    mails = lines.select("page_id", F.explode("mails").alias("m")).select("page_id", "m.local", "m.mail_domain")
    address = (
        mails.join(checked_broadcast(locals_), "local", "left")
        .join(checked_broadcast(domains), "mail_domain", "left")
        .where("is_local = 1 or is_domain = 1")
        .select("page_id", F.lit("3 address").alias("reason"))
    )

    urls = cut(lines.select("host", "url").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("urls")))
    key = F.xxhash64("host", "h", "framed")
    counted = lines.groupBy("host", "h", "url").agg(F.lit(1).alias("one")).groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_urls)
    recurrent = counted.join(urls, "host").where(F.col("n") >= F.col("urls") * recurs).select(F.explode(F.array(F.lit(True), F.lit(False))).alias("framed"), "host", "h").select(key.alias("key"))
    # hosts of too few URLs for counts show their boilerplate by its tags
    tagged = lines.where("framed").select("host", "h", "framed").distinct().join(urls.where(F.col("urls") < 2 * least_urls), "host").select(key.alias("key"))
    boilerplate = cut((recurrent.unionByName(tagged) if subtract else tagged.where("false")).distinct().withColumn("boiler", F.lit(True)))
    # a page shows its title and the name in it beside any message
    shown = lines.where("message or not named").select("page_id", "message", "framed", "chars", key.alias("key"))
    shown = hot_key_join(shown, boilerplate, "key", "left")
    rest = F.col("boiler").isNull()
    message = (
        shown.groupBy("page_id")
        .agg(
            F.max("message").alias("any"),
            F.sum(rest.cast("int")).alias("lines"),
            F.sum(F.when(~F.col("framed") & ~F.col("message"), F.col("chars")).otherwise(0)).alias("all_chars"),
            F.max(F.when(rest, F.col("message"))).alias("message"),
            F.sum(F.when(rest & ~F.col("message"), F.col("chars")).otherwise(0)).alias("rest"),
        )
        .where((F.col("message") & (F.col("rest") < rest_chars)) | (F.col("any") & (F.col("lines") == 0) & (F.col("all_chars") < rest_chars)))
        .select("page_id", F.lit("4 message").alias("reason"))
    )
    found = slots.unionByName(brackets).unionByName(filler).unionByName(mock).unionByName(address).unionByName(message)
    return found.groupBy("page_id").agg(F.substring(F.min("reason"), 3, 20).alias("reason"))
