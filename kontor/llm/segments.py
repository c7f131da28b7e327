"""Pairs of strings within k edits, found by equality of position-shifted segments (pigeonhole) or of what deletions leave."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.operators.joins import checked_broadcast
from kontor.session import cut

#: A block is crowded if all pairs of its strings are more than so many times its strings.
CROWDED = 32
#: Longer strings are met by their segments, which are long then; what deletions leave of them would be too many strings.
DELETABLE = 20


def allowed_edits(n, longest: int = 2):
    """Edits allowed for a string of n letters: none up to 3, one up to 6, else ``longest``."""
    return F.when(n <= 3, 0).when(n <= 6, 1).otherwise(longest)


def swapped_once(a, b, left, most: int = 2):
    """Whether some swap of two neighbouring letters of a leaves ``left`` edits to b, or fewer (``most`` at most)."""
    swap = lambda i: F.concat(F.substring(a, 1, i - 1), F.substring(a, i + 1, 1), F.substring(a, i, 1), F.substring(a, i + 2, 1 << 20))
    near = lambda i: F.levenshtein(swap(i), b, most)
    return F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(a) - 1)), lambda i: near(i).between(0, left))


def distance(a, b):
    """Levenshtein distance in which one swap of neighbouring letters counts once (distance 2 or more only)."""
    d = F.levenshtein(a, b)
    return F.when((d >= 2) & (d <= 4) & swapped_once(a, b, d - 2), d - 1).otherwise(d)


def banded(a, b, longest: int = 2):
    """:func:`distance` where it is at most ``longest``, else null. Only the diagonals within ``longest`` + 1 edits are
    filled (the band), and swaps are tried only where they can still decide."""
    d = F.levenshtein(a, b, longest + 1)
    d = F.when(d >= 0, d)
    d = F.when((d >= 2) & swapped_once(a, b, d - 2, longest - 1), d - 1).otherwise(d)
    return F.when(d <= longest, d)


def place(i, m, k):
    """Letters before segment ``i`` of a string of ``m`` letters cut into ``k`` + 1 segments."""
    return F.floor(i * m / (k + 1)).cast("int")


def indexed(strings: DataFrame, longest: int) -> DataFrame:
    """block, b, key: a row for each segment of the strings; key tells block, length, number and letters of the segment."""
    m = F.col("m")
    rows = strings.where("s <> ''").select("block", F.col("s").alias("b"), F.length("s").alias("m"))
    rows = rows.withColumn("k", F.when(m <= 3, 0).otherwise(allowed_edits(m, longest) + 1))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i"))
    at = place(F.col("i"), m, F.col("k"))
    segment = F.substring("b", at + 1, place(F.col("i") + 1, m, F.col("k")) - at)
    return rows.select("block", "b", F.xxhash64("block", "m", "i", segment).alias("key"))


def probes(strings: DataFrame, longest: int, longer: bool) -> DataFrame:
    """block, a, key: the substrings of each string that may be a segment of a partner, for each length a partner may have
    (``longer``: as long as the string or longer)."""
    n, m, k, i = (F.col(c) for c in "nmki")
    most = F.when(n <= 3, 0).otherwise(F.lit(longest + 1))
    rows = strings.where("s <> ''").select("block", F.col("s").alias("a"), F.length("s").alias("n"))
    rows = rows.select("*", F.explode(F.sequence(n if longer else F.greatest(F.lit(1), n - most), n + most)).alias("m"))
    rows = rows.withColumn("k", F.when(m <= 3, 0).otherwise(allowed_edits(m, longest) + 1)).where(F.abs(n - m) <= k)
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), k)).alias("i"))
    rows = rows.withColumn("at", place(i, m, k) + 1).withColumn("len", place(i + 1, m, k) - place(i, m, k))
    # of a pair within k edits, some segment i is whole with at most i edits before it and k - i behind it
    shift = n - m
    low = F.greatest(F.lit(1), F.col("at") - i, F.col("at") + shift - (k - i))
    high = F.least(n - F.col("len") + 1, F.col("at") + i, F.col("at") + shift + (k - i))
    rows = rows.withColumn("low", low).withColumn("high", high).where("low <= high")
    letters = F.array_distinct(F.transform(F.sequence("low", "high"), lambda p: F.substring("a", p, F.col("len"))))
    rows = rows.select("block", "a", "m", "i", F.explode(letters).alias("segment"))
    return rows.select("block", "a", F.xxhash64("block", "m", "i", "segment").alias("key"))


def verified(hits: DataFrame, longest: int) -> DataFrame:
    """block, a, b, d of candidates (block, a, b; repeats allowed) whose distance is allowed.

    The band is tried on every hit, so few of them are shuffled; swaps are tried once for each pair that is left, which
    the count of its hits keeps behind the shuffle."""
    close = hits.withColumn("e", F.levenshtein("a", "b", longest + 1)).where("e >= 0")
    pairs = close.groupBy("block", "a", "b", "e").agg(F.count(F.lit(1)).alias("hits"))
    e = F.col("e")
    swapped = (F.col("hits") > 0) & (e >= 2) & swapped_once(F.col("a"), F.col("b"), e - 2, longest - 1)
    pairs = pairs.withColumn("d", F.when(swapped, e - 1).otherwise(e))
    return pairs.where(F.col("d") <= allowed_edits(F.least(F.length("a"), F.length("b")), longest)).select("block", "a", "b", "d")


def spread(strings: DataFrame) -> DataFrame:
    """The strings spread over all tasks, by themselves: they are few bytes but become many rows, and no block is one task."""
    return strings.repartition(int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions")), "s")


def segment_pairs(left: DataFrame, right: DataFrame, longest: int = 2) -> DataFrame:
    """block, a, b, d: strings a of ``left`` and b of ``right`` (each: block, s; distinct) in the same block whose
    :func:`distance` is at most :func:`allowed_edits` of the shorter.

    b is cut into k + 1 segments, k one more than its allowed edits since a swap is two plain edits; the inverted
    index holds a hash of block, segment and place of each. a looks up its substrings of the lengths that b's length
    gives, at places shifted by k at most, for each length b may have. Candidates are verified with the built-in
    levenshtein, so equal hashes of different segments do no harm. No cap: a segment that many strings share only
    yields more candidates. Strings of up to three letters match only themselves; null and empty ones match nothing.
    """
    index = indexed(right, longest).withColumnRenamed("block", "block_b")
    hits = probes(spread(left), longest, False).join(index, "key").where("block = block_b").select("block", "a", "b")
    return cut(verified(hits, longest))


def deleted(strings: DataFrame, longest: int) -> DataFrame:
    """block, s, key: a row for each way to delete no more letters of s than its allowed edits; key tells the block and the
    letters that are left."""
    k, n, i, j = allowed_edits(F.length("s"), longest), F.length("s"), F.col("i"), F.col("j")
    rows = strings.select("block", "s", F.explode(F.sequence(F.lit(0), F.when(k > 0, n).otherwise(0))).alias("j"))
    rows = rows.select("block", "s", "j", F.explode(F.sequence(F.lit(0), F.when(k > 1, F.greatest(F.lit(0), j - 1)).otherwise(0))).alias("i"))
    left = F.concat(F.substring("s", 1, i - 1), F.substring("s", i + 1, j - i - 1), F.substring("s", j + 1, 1 << 20))
    return rows.select("block", "s", F.xxhash64("block", left).alias("key"))


def near_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """The pairs of :func:`segment_pairs` with two allowed edits at most, for blocks that grow with the data.

    Segments of a name are two or three letters, which a fixed part of all names share, so their hits in a block grow as its
    square. Here the strings of a crowded block meet by what is left of them after as many deletions as they have allowed
    edits: an edit or a swap is undone by deleting a letter on either side, so no pair is lost, and what is left of ten letters are eight in
    their order, which few others share. Long strings meet by segments, and in blocks that aren't crowded all strings meet."""
    left, right = cut(spread(left.where("s <> ''"))), cut(spread(right.where("s <> ''")))
    held = lambda d, n: d.groupBy("block").agg(F.count(F.lit(1)).alias(n))
    crowded = held(left, "n").join(held(right, "m"), "block").where(F.col("n") * F.col("m") > CROWDED * (F.col("n") + F.col("m"))).select("block")
    crowded = checked_broadcast(crowded)
    few = left.join(crowded, "block", "left_anti").withColumnRenamed("s", "a").join(right.join(crowded, "block", "left_anti").withColumnRenamed("s", "b"), "block")
    left, right = left.join(crowded, "block", "left_semi"), right.join(crowded, "block", "left_semi")
    equal = left.join(right, ["block", "s"]).select("block", F.col("s").alias("a"), F.col("s").alias("b"))
    short, long = F.length("s") <= DELETABLE, F.length("s") > DELETABLE - 3
    a, b = deleted(left.where(short), 2), deleted(right.where(short), 2)
    met = a.withColumnRenamed("s", "a").join(b.select("key", F.col("block").alias("block_b"), F.col("s").alias("b")), "key").where("block = block_b and a <> b")
    cuts = probes(left.where(long), 2, False).join(indexed(right.where(long), 2).withColumnRenamed("block", "block_b"), "key").where("block = block_b and a <> b")
    hits = few.select("block", "a", "b").unionByName(equal).unionByName(met.select("block", "a", "b")).unionByName(cuts.select("block", "a", "b"))
    return cut(verified(hits, 2))


def similar_pairs(strings: DataFrame, longest: int = 2) -> DataFrame:
    """block, a, b, d: each unordered pair of different strings (block, s; distinct) that :func:`segment_pairs` would find
    within one table, once: a is the shorter or, of equal length, the smaller.

    One side looks up only partners as long as itself or longer, and strings that are alone in their block look up
    nothing; equal strings are no pair."""
    strings = strings.where("s <> ''")
    crowded = strings.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("block")
    strings = cut(spread(strings.join(crowded, "block", "left_semi")))
    index = indexed(strings, longest).withColumnRenamed("block", "block_b")
    hits = probes(strings, longest, True).join(index, "key").where("block = block_b and (length(a) < length(b) or (length(a) = length(b) and a < b))")
    return cut(verified(hits.select("block", "a", "b"), longest))
