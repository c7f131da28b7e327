"""Functions and operators of the domain on small cases and against brute force."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kontor.functions import mails, structured
from kontor.operators import similarity, state
from kontor.plans import planning, resolving


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p><b>info</b>@firma.de</p>", ["info@firma.de"]),
        ("<span>Mail</span><span>info@firma.de</span>", ["info@firma.de"]),
        ("<a href='mailto:A%2BB@Firma.de?subject=x,post@firma.de'>x</a>", ["a+b@firma.de", "post@firma.de"]),
        ("info&#64;firma&#46;de", ["info@firma.de"]),
        ("<p>info [at] firma [punkt] de</p>", ["info@firma.de"]),
        ("<p>hr at acme dot com</p>", ["hr@acme.com"]),
        ("<p>john@acme dot com</p>", ["john@acme.com"]),
        ("<p>kontakt＠firma．de</p>", ["kontakt@firma.de"]),
        ("<meta itemprop='email' content='mailto:x@firma.de'>", ["x@firma.de"]),
        ("<a data-cfemail='" + "5a" + "".join(f"{ord(c) ^ 0x5A:02x}" for c in "a@b.de") + "'>", ["a@b.de"]),
        ("<img src='logo@2x.png'> <p>Meet at noon</p>", []),
        ("<script>var a='x@y.de'</script>", ["x@y.de"]),
        ("w" * 4000 + "@firma.de", []),
        ("", []),
        (None, []),
    ],
)
def test_page_addresses(spark, html, want):
    got = spark.createDataFrame([(html,)], "h string").select(mails.page_addresses(F.col("h")).alias("m")).first().m
    assert (got or []) == want


def test_smtp_verdicts(spark):
    rows = [(250, "OK"), (451, "greylisted"), (550, "5.7.1 blocked by Spamhaus"), (550, "no such user"), (None, None)]
    df = spark.createDataFrame(rows, "c int, t string")
    assert [r[0] for r in df.select(mails.smtp_verdict(F.col("c"), F.col("t"))).collect()] == ["accepted", "temporary", "blocked", "rejected", None]


def test_json_ld_organisations():
    page = """<script type="application/ld+json"><!-- {"@context": {"@type": "Organization"}, "@graph": [{"@type": ["schema:LocalBusiness"], "name": {"@value": "Firma"}, "legalName": "Firma GmbH",
      "email": "mailto:Info@Firma.de", "contactPoint": [{"telephone": "tel:+49 1"}, {"email": "info@firma.de"}], "address": [{"streetAddress": "Weg 1", "postalCode": "12345", "addressLocality": "Ort",
      "addressCountry": {"name": "DE"}}], "department": {"@type": "AutoRepairBusiness", "name": "Zwei", "address": "Gasse 2"}}]} --></script>
      <script type='application/ld+json'>{"a": </script><script type="application/ld+json">{"@type": "Person", "name": "N"}</script>"""
    one, two = structured.organisations(page)
    assert (one["name"], one["legal_name"], one["emails"], one["telephones"], one["address_text"]) == ("Firma", "Firma GmbH", ["info@firma.de"], ["+49 1"], "Weg 1, 12345 Ort, DE")
    assert (two["name"], two["address_text"], two["types"]) == ("Zwei", "Gasse 2", ["AutoRepairBusiness"])
    deep = '{"x":' * 9 + '{"@type":"Store"}' + "}" * 9
    assert structured.organisations(f'<script type="application/ld+json">{deep}</script>') == structured.organisations(None) == []


def test_search_results(spark):
    page = """<div class="result results_links"><a rel="x" class="result__a" href="//find.example/l/?uddg=https%3A%2F%2Ffirma.example%2Fa&amp;rut=1">Firma <b>A</b></a></div>
      <div class="result result--ad"><a class="result__a" href="https://werbung.example/">Ad</a></div><div class="result"><a class="result__a" href="https://firma.example/b">B</a></div>"""
    row = spark.createDataFrame([(page, '{"results": [{"url": "https://a.example", "title": "A"}, {"url": "ftp://x"}]}', "[nothing")], "h string, j string, k string")
    got = row.select(structured.html_results(F.col("h")).alias("h"), structured.json_results(F.col("j")).alias("j"), structured.json_results(F.col("k")).alias("k")).first()
    assert [(r.url, r.title) for r in got.h] == [("https://firma.example/a", "Firma A"), ("https://firma.example/b", "B")]
    assert [r.url for r in got.j] == ["https://a.example"] and got.k == []


def test_ratios():
    assert similarity.partial_ratio("abc", "xxabcxx") == 100 and similarity.partial_ratio("", "") == 100 and similarity.partial_ratio("", "a") == 0
    assert similarity.weighted_ratio("metal casting", "casting metal") == 95
    assert similarity.weighted_ratio("", "x") == 0 and similarity.weighted_ratio("abc", "abc") == 100
    assert similarity.weighted_ratio("casting", "casting of light metals") == 90


def test_fuzzy_pick(spark):
    rows = [("a", 1, 95.0), ("a", 2, 80.0), ("b", 1, 95.0), ("b", 2, 92.0), ("c", 1, 72.0), ("c", 2, 60.0), ("d", 1, 20.0)]
    got = {r.k: (r.picked, r.suggestions) for r in resolving.fuzzy_pick(spark.createDataFrame(rows, "k string, c bigint, s double"), ["k"], "c", "s").collect()}
    assert got == {"a": (1, []), "b": (None, [1, 2]), "c": (None, [1]), "d": (None, [])}


def test_identities(spark):
    entries = [(1, "a.de", "Müller Metallbau GmbH", "12345", None), (2, "a.de", "Möller Metallbau", "12345", None), (3, "a.de", "Müller Metallbau", "99999", None), (4, "a.de", "Mueller Metallbau", None, None), (5, "b.de", "Firma Ort", None, "Firma Ort"), (6, "c.de", None, "1", None)]
    lines = [("a.de", "Impressum"), ("a.de", "Mueller Metallbau GmbH, Weg 1"), ("a.de", "12345 Ort"), ("a.de", None)]
    got = {r.entry: (r.ok, r.reason) for r in resolving.identities(spark.createDataFrame(entries, "entry int, site string, name string, postal string, city string"), spark.createDataFrame(lines, "site string, line string")).collect()}
    assert got[1] == (True, "") and got[2] == (False, "name") and got[3] == (False, "location") and got[4] == (True, "") and got[5] == (False, "generic_name") and not got[6][0]


def test_names_alike_finds_what_brute_force_finds(spark):
    rng = random.Random(5)
    trades, families = ["metallbau", "druckerei", "spedition"], ["rabenmarn", "hagelhulde", "tolsonau", "kestiwick", "ott"]
    name = lambda: " ".join(rng.sample([rng.choice(trades), rng.choice(families)], rng.randint(1, 2)))

    def typo(s):
        k = rng.randrange(len(s))
        return s[:k] + s[k + 1 :] if rng.random() < 0.4 else s

    a, b = sorted({typo(name()) for _ in range(60)}), sorted({typo(name()) for _ in range(60)})
    left, right = spark.createDataFrame([("1", x) for x in a], "p string, a string"), spark.createDataFrame([("1", x) for x in b], "p string, b string")
    got = {(r.a, r.b) for r in similarity.names_alike(left, right, "p", 92).collect()}
    want = {(x, y) for x in a for y in b if similarity.token_set_ratio(x, y) >= 92}
    assert got <= want and len(got) >= 0.95 * len(want)


def test_paced_equals_the_loop(spark):
    rng, t0 = random.Random(2), datetime(2090, 1, 1)
    rows = [(i, rng.choice("ab"), t0 + timedelta(seconds=rng.randint(0, 60))) for i in range(60)]
    got = {r.i: r.wait_s for r in state.paced(spark.createDataFrame(rows, "i int, k string, t timestamp"), "k", "t", "i", 1.0, 2.0).collect()}
    free: dict[str, datetime] = {}
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        start = max(t, free.get(k, t))
        assert got[i] == (start - t).total_seconds()
        free[k] = start + timedelta(seconds=3)


def test_breaker_and_sweep(spark):
    t0 = datetime(2090, 1, 1)
    rows = [(0, "a", t0, False), (1, "a", t0 + timedelta(seconds=1), True), (2, "a", t0 + timedelta(seconds=5), True), (3, "a", t0 + timedelta(seconds=12), None), (4, "b", t0, None)]
    got = {r.i: r.ran for r in state.breaker(spark.createDataFrame(rows, "i int, k string, t timestamp, b boolean"), "k", "t", "i", "b", 10).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True}
    jobs = [(1, "running", t0, None, None), (2, "success", t0, None, t0), (3, "success", t0, None, t0 + timedelta(minutes=119)), (4, "failed", t0, None, None), (5, "cancelled", t0, None, None), (6, "queued", t0 + timedelta(minutes=10), None, None), (7, None, None, None, None)]
    df = spark.createDataFrame(jobs, "job_id int, status string, created_at timestamp, started_at timestamp, finished_at timestamp")
    got = {r.job_id: r.action for r in state.swept(df, F.lit(t0 + timedelta(minutes=120))).collect()}
    assert got == {1: "time_out", 2: "expire_success", 3: "keep", 4: "expire_failed", 5: "remove_cancelled", 6: "keep", 7: "keep"}


def test_social_profiles(spark):
    link = "<a href='https://www.facebook.com/{}'>x</a>"
    rows = [("a.de", "u1", "home", link.format("eins")), ("a.de", "u2", "other", link.format("zwei")), ("a.de", "u3", "other", link.format("zwei")), ("b.de", "u4", "other", None)]
    got = [(r.domain, r.profile, r.pages, r.official) for r in planning.social_profiles(spark.createDataFrame(rows, "domain string, url string, kind string, html string")).orderBy("place").collect()]
    assert got == [("a.de", "facebook.com/zwei", 2, True), ("a.de", "facebook.com/eins", 1, False)]


def test_specificity(spark):
    df = spark.createDataFrame([("DE",), ("iso:DE-01",), ("GB-ENG-LND",), ("osm:123",)], "a string")
    assert [r[0] for r in df.select(planning.area_specificity(F.col("a"))).collect()] == [0, 1, 2, 3]
