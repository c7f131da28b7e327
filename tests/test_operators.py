"""Operators against brute force on small inputs."""

from __future__ import annotations

import datetime as dt
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kontor.functions import urls
from kontor.functions.text import folded, words
from kontor.operators import similarity, timeline
from kontor.operators.allocation import first_per, round_robin, water_fill
from kontor.operators.graph import components
from kontor.operators.joins import BROADCAST_BYTES, HEAP_PART, broadcast_bytes, checked_broadcast, hot_key_join
from kontor.session import cut, held_bytes


def rounds(total: int, caps: dict[str, int]) -> dict[str, int]:
    """The allocation by rounds: even shares, none above its capacity, what is left to the smallest keys."""
    got = dict.fromkeys(caps, 0)
    left = total
    while left > 0 and (room := sorted(k for k in caps if got[k] < caps[k])):
        share = left // len(room)
        if share == 0:
            for k in room[:left]:
                got[k] += 1
            break
        for k in room:
            add = min(share, caps[k] - got[k])
            got[k] += add
            left -= add
    return got


def test_water_fill(spark):
    rng = random.Random(7)
    cases = {g: (rng.randint(0, 60), {f"k{i}": rng.randint(0, 15) for i in range(rng.randint(1, 7))}) for g in range(80)}
    rows = [(g, k, c, t) for g, (t, caps) in cases.items() for k, c in caps.items()]
    got = water_fill(spark.createDataFrame(rows, "g int, k string, c int, t int"), "g", "k", "c", "t").collect()
    want = {(g, k): n for g, (t, caps) in cases.items() for k, n in rounds(t, caps).items()}
    assert {(r.g, r.k): r.quota for r in got} == want


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(None, 3), (5, 5)]
    parent: dict[int, int] = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_components_keep_small_estimates(spark):
    chain = components(spark.createDataFrame([(i, i + 1) for i in range(100)], "a bigint, b bigint"))
    assert {r.component for r in chain.collect()} == {0}
    assert chain._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 200


def test_hot_key_join(spark):
    rows = [("hot", i) for i in range(4000)] + [(f"k{i % 50}", i) for i in range(200)] + [(None, 1)]
    left = spark.createDataFrame(rows, "k string, v int")
    right = spark.createDataFrame([("hot", 1.0), ("k1", 2.0), ("k2", None)], "k string, x double")
    for how in ("inner", "left"):
        got = sorted(map(str, hot_key_join(left, right, "k", how).select("k", "v", "x").collect()))
        assert got == sorted(map(str, left.join(right, "k", how).select("k", "v", "x").collect()))


def test_part_of_a_cut_frame_is_broadcast_without_being_written(spark):
    whole = cut(spark.range(100).selectExpr("id", "id * 2 as twice"))
    part = checked_broadcast(whole.select("id"), of=(whole,))
    assert held_bytes(part) is None and "ResolvedHint" in part._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in checked_broadcast(whole.select("id"), 1, (whole,))._jdf.queryExecution().analyzed().toString()


def test_broadcasts_follow_the_heap_of_the_driver(spark):
    heap = spark.sparkContext._jvm.java.lang.Runtime.getRuntime().maxMemory()
    assert broadcast_bytes(spark) == min(BROADCAST_BYTES, heap // HEAP_PART) and broadcast_bytes(spark) * 40 < heap


def test_first_per_and_turns(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, None), ("b", 5, "z")], "k string, n int, v string")
    assert {(r.k, r.n) for r in first_per(df, ["k"], ["n"]).collect()} == {("a", 1), ("b", 5)}
    assert [r.k for r in round_robin(df, ["k"], ["n", "v"], ["k"]).collect()] == ["a", "b", "a", "b"]


def test_urls(spark):
    cases = [
        ("HTTPS://www.Firma.example:8443/Kontakt?utm_source=x&a=1#top", "https://www.firma.example/Kontakt?a=1", "firma.example"),
        ("firma.co.uk", "https://firma.co.uk/", "firma.co.uk"),
        ("http://a.b.firma.test/?gclid=1", "http://a.b.firma.test/", "firma.test"),
        ("mailto:x@firma.example", None, None),
        ("  ", None, None),
        (None, None, None),
        ("10.0.0.1", None, None),
        ("x.example; y.example", "https://x.example/", "x.example"),
    ]
    df = spark.createDataFrame([(a,) for a, _, _ in cases], "u string")
    got = df.select("u", urls.normal_website("u").alias("w"), urls.registered_domain("u").alias("d")).collect()
    assert [r.w for r in got] == [w for _, w, _ in cases]
    assert [r.d for r, (u, _, _) in zip(got, cases, strict=True) if u and ":x@" not in u and ";" not in u] == [d for u, _, d in cases if u and ":x@" not in u and ";" not in u]
    assert [r.x for r in spark.createDataFrame([("www.a.example",), ("a.example",)], "h string").select(urls.flipped_www("h").alias("x")).collect()] == ["a.example", "www.a.example"]


def test_text(spark):
    df = spark.createDataFrame([("Große Bäckerei, Łódź & Søn!",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(words("t")).collect()] == ["grosse backerei lodz son", None, ""]
    assert df.select(folded("t").alias("x")).first().x == "grosse backerei, lodz & son!"


def lcs(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcd ", max_size=12), st.text("abcd ", max_size=12))
def test_indel_ratio(a, b):
    want = 100.0 if not a and not b else 200 * lcs(a, b) / (len(a) + len(b))
    assert abs(similarity.indel_ratio(a, b) - want) < 1e-9


def test_token_set_ratio():
    assert similarity.token_set_ratio("muller stahl", "stahl muller gmbh") == 100
    assert similarity.token_set_ratio("", "x") == 0
    assert similarity.token_set_ratio("abc", "xyz") == 0


def test_timelines(spark):
    t0 = dt.datetime(2031, 1, 1)
    rng = random.Random(5)
    rows = [(i % 3, i, t0 + dt.timedelta(seconds=rng.randint(0, 500)), rng.randint(1, 90)) for i in range(60)]
    df = spark.createDataFrame([(k, i, a, a + dt.timedelta(seconds=n)) for k, i, a, n in rows], "k int, i int, a timestamp, b timestamp")
    want = {}
    for k in range(3):
        spans = [(a, a + dt.timedelta(seconds=n)) for x, _, a, n in rows if x == k]
        want[k] = max(sum(s <= p < e for s, e in spans) for p, _ in spans)
    assert {r.k: r.most for r in timeline.most_at_once(df, "k", "a", "b").collect()} == want
    got = {(r.k, r.i): r.allowed for r in timeline.token_bucket(df, "k", "a", "i", 1 / 20, 4).collect()}
    for k in range(3):
        tokens, at = 4.0, None
        for _, i, a, _ in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1])):
            now = a.timestamp()
            tokens, at, ok = timeline.bucket_step(tokens, at, now, 1 / 20, 4)
            assert got[k, i] == ok
    assert timeline.token_bucket(df.where("false"), "k", "a", "i").count() == 0


def test_nulls_and_extra_columns(spark):
    df = spark.createDataFrame([(None, None, 1), ("a", None, 2)], "k string, n int, rn int")
    assert first_per(df, ["k"], ["n", "rn"]).count() == 2
    assert df.select(F.lit(1)).count() == 2


def test_numbered_equals_a_window(spark):
    from pyspark.sql import Window

    from kontor.operators.allocation import numbered

    rng = random.Random(9)
    rows = [("hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), rng.randint(0, 50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, n int, i int").repartition(7)
    got = {(r.k, r.n, r.i): r.place for r in numbered(df, ["k"], [F.col("n"), "i"], "place").collect()}
    want = df.select("k", "n", "i", F.row_number().over(Window.partitionBy("k").orderBy("n", "i")).alias("place"))
    assert got == {(r.k, r.n, r.i): r.place for r in want.collect()}
    assert numbered(df.where("false"), ["k"], ["n", "i"], "place").count() == 0
