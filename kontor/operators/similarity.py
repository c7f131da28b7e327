"""String similarity: the indel ratio and its token forms, in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kontor.operators.joins import checked_broadcast
from kontor.session import cut


def indel_ratio(a: str, b: str) -> float:
    """100 times twice the longest common subsequence over both lengths; 100 for two empty strings.

    Bit-parallel, with Python's integers as rows of bits."""
    if not a and not b:
        return 100.0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    common = len(a) - row.bit_count()
    return 200.0 * common / (len(a) + len(b))


def token_set_ratio(a: str, b: str) -> float:
    """Best indel ratio among the shared words and the shared words with what each side adds; 100 if one side's words
    are all on the other; 0 if a side has no words."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = sorted(x & y)
    if both and (x <= y or y <= x):
        return 100.0
    shared = " ".join(both)
    left = " ".join(filter(None, [shared, *sorted(x - y)]))
    right = " ".join(filter(None, [shared, *sorted(y - x)]))
    scores = [indel_ratio(left, right)]
    if shared:
        scores += [indel_ratio(shared, left), indel_ratio(shared, right)]
    return max(scores)


def token_sort_ratio(a: str, b: str) -> float:
    """Indel ratio of the words of both in order of the alphabet."""
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def partial_ratio(a: str, b: str) -> float:
    """Best indel ratio of the shorter text with any window of its length in the longer one, shorter ones at the ends; 100 for
    two empty texts, 0 for one."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    n = len(short)
    if not n:
        return 0.0 if long else 100.0
    best = 0.0
    for end in range(1, len(long) + n):
        best = max(best, indel_ratio(short, long[max(0, end - n) : end]))
        if best == 100.0:
            break
    return best


def weighted_ratio(a: str, b: str) -> float:
    """SF-05: best of the plain, token and partial ratios, each weighed by how comparable the lengths are; 0 if a side is empty.

    Token forms count 0.95. Where one text is at least half again as long, partial forms count 0.9, or 0.6 beyond eight
    times the length."""
    if not a or not b:
        return 0.0
    long = max(len(a), len(b)) / min(len(a), len(b))
    if long < 1.5:
        return max(indel_ratio(a, b), 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    scale = 0.9 if long <= 8 else 0.6
    x, y = set(a.split()), set(b.split())
    words = 100.0 if x & y else partial_ratio(" ".join(sorted(x)), " ".join(sorted(y)))
    words = max(words, partial_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))))
    return max(indel_ratio(a, b), scale * partial_ratio(a, b), 0.95 * scale * words)


def arrow(measure):
    """A measure of two strings as a vectorised Spark function; null if a side is null."""

    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([measure(x, y) if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


ratio = arrow(indel_ratio)
set_ratio = arrow(token_set_ratio)
part_ratio = arrow(partial_ratio)
best_ratio = arrow(weighted_ratio)


def names_alike(left: DataFrame, right: DataFrame, block: str, least: float) -> DataFrame:
    """``block``, a, b, ratio: names a of ``left`` and b of ``right`` (each: block and name, distinct) of one block whose
    token-set ratio is ``least`` or more.

    Candidates share four letters in a row of two words, of which at least one is not the most frequent word of its name
    (which is its trade, as a rule), so neither a hot block nor a trade makes pairs by itself; a name of one word counts
    with it. Which word is the most frequent is a comparison within the name, so no threshold moves with the size of the
    tables. Words of fewer than four letters count whole. Null names and blocks match nothing."""
    sides = left.select(block, F.col("a").alias("name"), F.lit(0).alias("side")).unionByName(right.select(block, F.col("b").alias("name"), F.lit(1).alias("side")))
    said = sides.where(F.col(block).isNotNull() & (F.trim("name") != "")).select(block, "name", "side", F.explode(F.array_distinct(F.split(F.trim("name"), " "))).alias("word"))
    said = cut(said)
    often = said.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    told = said.join(checked_broadcast(often), "word").groupBy(block, "name", "side").agg(F.collect_list("word").alias("every"), F.max(F.struct("n", "word")).alias("top"))
    told = cut(told.withColumn("rest", F.when(F.size("every") == 1, F.col("every")).otherwise(F.array_remove("every", F.col("top.word")))))
    grams = lambda c: F.array_distinct(F.flatten(F.transform(c, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w) - 3)), lambda p: F.substring(w, p, 4)))))
    keys = lambda side, c, name: told.where(F.col("side") == side).select(block, F.explode(grams(c)).alias("gram"), F.col("name").alias(name))
    pairs = keys(0, "rest", "a").join(keys(1, "every", "b"), [block, "gram"]).unionByName(keys(0, "every", "a").join(keys(1, "rest", "b"), [block, "gram"]))
    pairs = cut(pairs.select(block, "a", "b").distinct())
    return pairs.withColumn("ratio", set_ratio("a", "b")).where(F.col("ratio") >= least)
