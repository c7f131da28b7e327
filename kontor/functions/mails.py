"""Mail addresses of pages, plain and disguised, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kontor.functions.hints import decoded_cfemail

# Words for the signs of an address, file endings that look like top-level domains, signs that look like others.
AT_WORDS = "at|arroba|arobase|chiocciola"
DOT_WORDS = "dot|punkt|punto|point"
FILE_ENDINGS = ("png", "jpg", "jpeg", "gif", "svg", "webp", "css", "js", "ico")
LOOKALIKE, MEANT = "＠﹫．。․", "@@..."
# Elements whose text no reader sees, and elements that begin a line.
UNSEEN = "script|style|noscript|template|svg|canvas|iframe"
BLOCKS = "address|article|aside|blockquote|dd|details|dialog|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|li|main|menu|nav|ol|p|pre|section|table|td|th|tr|ul|br|body|title"

PLAIN = r"(?i)(?<![\w.+%-])([\w.+-]+@(?:[a-z0-9-]+\.)+[a-z]{2,24})(?![\w-])"
DOT = rf"(?:\s*[\[({{]\s*(?:{DOT_WORDS}|\.)\s*[\])}}]\s*|\s+(?:{DOT_WORDS})\s+|\.)"
AT = rf"(?:\s*[\[({{]\s*(?:{AT_WORDS}|@)\s*[\])}}]\s*|\s+(?:{AT_WORDS})\s+)"
DISGUISED = rf"(?i)([\w.+-]+){AT}((?:[a-z0-9-]+{DOT})+[a-z]{{2,24}})\b"
SPACED_DOTS = r"(?i)(?<![\w.+%-])([\w.+-]+)@((?:[a-z0-9-]+(?:\.|\s+dot\s+))+[a-z]{2,24})\b"


def inline_text(html: Column) -> Column:
    """SF-11: text of a page as readers see it, inline elements joined without a blank and blocks as lines.

    Two word characters that meet across tags get a blank, so a label and an address don't run together, while an address
    split at a sign stays whole. Runs of 321 characters and more, which no address has, become a blank."""
    t = F.regexp_replace(html, rf"(?is)<!--.*?-->|<({UNSEEN}|head)\b.*?</\1\s*>", "")
    t = F.regexp_replace(t, r"[ \t\r\n\f ]+", " ")
    t = F.regexp_replace(t, rf"(?i) ?</?(?:{BLOCKS})\b[^>]*> ?", "\n")
    t = F.regexp_replace(t, r"(?<=\w)(?:<[^>]*>)+(?=\w)", " ")
    t = unescaped(F.regexp_replace(t, r"<[^>]*>", ""))
    t = F.regexp_replace(t, r"\S{321,}", " ")
    return F.trim(F.regexp_replace(t, r"[  ]*\n[\n  ]*", "\n"), F.lit("\n "))


def unescaped(text: Column) -> Column:
    """Text with the entities of signs of addresses and the five of markup resolved."""
    for entity, sign in ((r"&(?:#0*64|#[xX]0*40|commat);", "@"), (r"&(?:#0*46|#[xX]0*2[eE]|period);", "."), (r"&nbsp;|&#160;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#0*39;|&apos;", "'"), ("&amp;", "&")):
        text = F.regexp_replace(text, entity, sign)
    return text


def joined(text: Column, pattern: str) -> Column:
    """Addresses of a pattern with a local part and a disguised domain."""
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("a"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("b"))
    return F.transform(both, lambda x: F.concat(x["a"], F.lit("@"), F.regexp_replace(x["b"], f"(?i){DOT}", ".")))


def mailto(text: Column) -> Column:
    """Addresses of mailto links: percent signs decoded, parameters cut off, several split."""
    found = F.regexp_extract_all(text, F.lit(r"""(?i)mailto:([^"'>\s]+)"""), F.lit(1))
    return F.flatten(F.transform(found, lambda x: F.split(F.substring_index(F.coalesce(F.try_url_decode(x), x), "?", 1), ",")))


def raw_addresses(text: Column) -> Column:
    """SF-12: addresses of a text or markup: hidden by a content network, in links, plain and with words for their signs."""
    text = unescaped(text)
    codes = F.regexp_extract_all(text, F.lit(r"""(?i)(?:data-cfemail=["']|/cdn-cgi/l/email-protection#)([0-9a-f]{8,})"""), F.lit(1))
    return F.concat(F.transform(codes, decoded_cfemail), mailto(text), F.regexp_extract_all(text, F.lit(PLAIN), F.lit(1)), joined(text, DISGUISED))


def page_addresses(html: Column) -> Column:
    """SF-13: the plausible addresses of a page, lower case, distinct and sorted; an empty array for null and empty pages.

    Read from the markup, from the text as readers see it (there also with spaced words for dots) and from microdata, after
    signs that look like others are replaced. Pages without any hint of an address are spared the patterns."""
    page = F.translate(F.regexp_replace(html, r"[\w.+-]{321,}", " "), LOOKALIKE, MEANT)
    seen = inline_text(page)
    micro = F.regexp_extract_all(page, F.lit(r"""(?is)<[^>]*\bitemprop=["']?email["']?[^>]*\bcontent=["']([^"']+)["']"""), F.lit(1))
    micro = F.concat(micro, F.regexp_extract_all(page, F.lit(r"""(?is)<[a-z0-9]+[^>]*\bitemprop=["']?email["']?[^>]*>\s*([^<\s]+)\s*<"""), F.lit(1)))
    micro = F.filter(F.transform(micro, lambda x: F.regexp_replace(x, "(?i)^mailto:", "")), lambda x: x.rlike(r"(?i)^[\w.+-]+@(?:[a-z0-9-]+\.)+[a-z]{2,24}$"))
    every = F.concat(raw_addresses(page), raw_addresses(seen), joined(seen, SPACED_DOTS), micro)
    clean = F.array_sort(F.array_distinct(F.filter(F.transform(F.filter(every, lambda x: x.isNotNull()), lambda x: F.trim(F.lower(F.trim(x)), F.lit("."))), plausible)))
    hint = page.rlike(rf"(?i)@|&#0*64;|&#x0*40;|&commat;|%40|cfemail|email-protection|\b(?:{AT_WORDS})\b")
    return F.when(hint, clean).otherwise(F.array().cast("array<string>"))


def plausible(address: Column) -> Column:
    """Whether an address may be a mailbox: a local part of 1 to 64 characters without a long run of hex digits, and a domain
    that is no file name."""
    local = F.substring_index(address, "@", 1)
    form = address.rlike(r"^[^@\s]{1,64}@(?:[a-z0-9-]+\.)+[a-z]{2,24}$")
    return form & ~local.rlike(r"[0-9a-f]{24}") & ~F.substring_index(address, ".", -1).isin(*FILE_ENDINGS)


def smtp_verdict(code: Column, text: Column) -> Column:
    """SC-19: what a mail server's reply to a recipient says: accepted, temporary, blocked (policy, not the mailbox) or rejected."""
    policy = F.lower(F.coalesce(text, F.lit(""))).rlike(r"spamhaus|blocklist|blacklist|policy|reputation|denied by|spf|dnsbl|blocked")
    return F.when(code.isin(250, 251), "accepted").when(code.between(400, 499), "temporary").when(code.isNotNull() & policy, "blocked").when(code.isNotNull(), "rejected")
