"""Streaming, data source, files and small functions."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from kontor.functions import hints
from kontor.operators import timeline
from kontor.sources import elements
from kontor.streaming import limits


def test_streamed_bucket_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    events.coalesce(1).orderBy("ts").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = limits.limited(stream, "user_id", "ts", "event_id", 1 / 3600, 3.0).writeStream.format("memory").queryName("bucket").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.event_id: r.allowed for r in spark.table("bucket").collect()}
    assert got == {r.event_id: r.allowed for r in timeline.token_bucket(events, "user_id", "ts", "event_id", 1 / 3600, 3.0).collect()}


def test_streamed_first_of_equal_and_windows(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "h string, s int").select("h", F.timestamp_seconds("s").alias("at"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = limits.first_of_equal(stream, "at", "h").writeStream.format("memory").queryName("firsts").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.h for r in spark.table("firsts").collect()) == ["a", "b"]
    q = limits.windowed_counts(stream, "at", "h").writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.h: r.events for r in spark.table("counts").collect()} == {"a": 2, "b": 1}


def test_elements(spark, tmp_path):
    good = {"elements": [{"type": "node", "id": 1, "lat": 50, "lon": 7.5, "tags": {"name": "A"}}, {"type": "way", "id": 2, "center": {"lat": 1.0, "lon": 2.0}}]}
    (tmp_path / "a.json").write_text(json.dumps(good))
    (tmp_path / "b.json").write_text(json.dumps({"remark": "runtime error", "elements": []}))
    (tmp_path / "c.json").write_text("{")
    rows = elements.read_elements(spark, str(tmp_path)).collect()
    assert {(r.type, r.id, r.lat, r.remark) for r in rows} == {("node", 1, 50.0, None), ("way", 2, None, None), (None, None, None, "not JSON")}
    assert elements.read_elements_plain(spark, str(tmp_path / "a.json")).count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("https://a.example/", None, 1), ("https://b.example/", "x", 2)], "url string, name string, n int")
    elements.write_csv(df.coalesce(1), f"{tmp_path}/csv")
    text = next((tmp_path / "csv").glob("*.csv")).read_text()
    assert text.split("\n")[:2] == ["url,name,n", "https://a.example/,,1"]
    for _ in range(2):
        elements.append_json_lines(df, f"{tmp_path}/lines")
    assert spark.read.json(f"{tmp_path}/lines").count() == 4
    elements.write_pages(df, f"{tmp_path}/pages")
    assert all(len(r.name) == 16 for r in spark.read.parquet(f"{tmp_path}/pages").collect())
    assert json.loads(elements.result_body(df).first().body) == {"url": "https://a.example/", "n": 1}


def encoded(text: str, key: int) -> str:
    return f"{key:02x}" + "".join(f"{ord(c) ^ key:02x}" for c in text)


def test_hints(spark):
    df = spark.createDataFrame([(encoded("info@firma.example", 0x5A),), ("zz",), (None,), ("5a1",)], "c string")
    assert [r[0] for r in df.select(hints.decoded_cfemail(F.col("c"))).collect()] == ["info@firma.example", None, None, None]
    df = spark.createDataFrame([(["de", "en", "fr"], "de"), ([], "de"), (None, None)], "l array<string>, c string")
    assert [r[0] for r in df.select(hints.accept_language(F.col("l"), F.col("c"))).collect()] == ["de-DE,de;q=0.9,en;q=0.8,fr;q=0.7", "en-DE,en;q=0.9", "en;q=0.9"]
    page = """<a href="https://www.facebook.com/Firma">f</a><a href='https://www.facebook.com/sharer.php?u=1'>s</a><a href="https://de.linkedin.com/company/firma">l</a>"""
    got = spark.createDataFrame([(page,)], "h string").select(hints.profiles(F.col("h")).alias("p")).first().p
    assert got == {"facebook": ["facebook.com/firma"], "linkedin": ["linkedin.com/company/firma"]}
    xml = "<urlset><url><loc> https://a.example/1 </loc></url><url><loc>https://a.example/2</loc></url></urlset>"
    assert spark.createDataFrame([(xml,)], "x string").select(hints.sitemap_locations(F.col("x")).alias("l")).first().l == ["https://a.example/1", "https://a.example/2"]
    box = spark.sql("SELECT 0.0D s, 0.0D w, 2.0D n, 4.0D e").select(hints.tiles(*map(F.col, "swne")).alias("t")).first().t
    assert [tuple(b) for b in box] == [(0, 0, 1, 2), (0, 2, 1, 4), (1, 0, 2, 2), (1, 2, 2, 4)]


@pytest.mark.parametrize(("rules", "path", "want"), [("User-agent: *\nDisallow: /private\nAllow: /private/open", "/private/open/x", True), ("User-agent: *\nDisallow: /private", "/private/x", False), ("User-agent: *\nDisallow:", "/x", True), (None, "/x", True), ("User-agent: bad\nDisallow: /", "/x", True), ("User-agent: *\nDisallow: /", "/x", False)])
def test_robots(spark, rules, path, want):
    df = spark.createDataFrame([(rules, path)], "r string, p string")
    assert df.select(hints.robots_allow(F.col("r"), F.col("p")).alias("x")).first().x is want


def test_addresses_and_checks(spark):
    cases = {"8.8.8.8": True, "10.1.2.3": False, "172.20.0.1": False, "172.32.0.1": True, "192.168.1.1": False, "127.0.0.1": False, "169.254.1.1": False, "224.0.0.1": False, "300.1.1.1": False, "x": False, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "ip string")
    assert [r[0] for r in df.select(hints.is_public_address(F.col("ip"))).collect()] == list(cases.values())
    numbers = {"732829320": True, "732829321": False, "": False, None: None}
    df = spark.createDataFrame([(k,) for k in numbers], "n string")
    assert [r[0] for r in df.select(hints.luhn(F.col("n"))).collect()] == list(numbers.values())


def test_equal_names_of_frequent_words_meet(spark, tmp_path):
    from kontor.plans import joins

    for t, first in (("dedup_entries", 0), ("web_entries", 1000)):
        rows = [(first + i, "12345", "metallbau gerd") for i in range(30)] + [(first + 100 + i, f"{20000 + i}", "spedition anna") for i in range(30)]
        spark.createDataFrame(rows, "entry_id bigint, postal string, norm_name string").write.parquet(f"{tmp_path}/{t}.parquet")
    got = joins.fuzzy_same_place(spark, str(tmp_path)).collect()
    assert len(got) == len({(r.osm_id, r.web_id) for r in got}) == 30 * 30 + 30
