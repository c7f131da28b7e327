"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kontor.session import cut, held_bytes

#: A side is broadcast only if it takes no more bytes than this once written, and no more than this part of the driver's heap:
#: the driver holds a broadcast as collected, as a table and as sent, and a query has several at a time.
BROADCAST_BYTES = 32 << 20
HEAP_PART = 96
#: Share of the rows from which a key is hot; so there can be no more than 1 / HOT_SHARE hot keys.
HOT_SHARE = 0.002


def broadcast_bytes(spark: SparkSession) -> int:
    """Bytes that a broadcast side may take once written, by the heap of this driver."""
    return min(BROADCAST_BYTES, spark.sparkContext._jvm.java.lang.Runtime.getRuntime().maxMemory() // HEAP_PART)


def checked_broadcast(df: DataFrame, most: int | None = None, of: tuple[DataFrame, ...] = ()) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` bytes (:func:`broadcast_bytes`), else as it was (the join then
    shuffles).

    It is written to the shared folder first, unless it was before, and measured there; so it is evaluated once, whatever
    the join then does, and no estimate decides. ``of``: frames from :func:`cut` whose rows ``df`` takes, each at most once and
    with no more than a constant beside it; if they fit together, ``df`` does, and isn't written."""
    most = broadcast_bytes(df.sparkSession) if most is None else most
    held = [held_bytes(x) for x in of]
    if held and None not in held and sum(held) <= most:
        return F.broadcast(df)
    df = cut(df)
    return F.broadcast(df) if held_bytes(df) <= most else df


def hot_key_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", share: float = HOT_SHARE) -> DataFrame:
    """Equi-join on ``key`` where ``right`` has at most one row per key and any key of ``left`` may be hot.

    Keys that hold more than ``share`` of ``left`` are counted after a map-side partial aggregate; there are
    at most ``1 / share`` of them, so their rows of ``right`` are broadcast and their rows of ``left`` never
    shuffle. The other rows take the usual shuffled join. ``how`` is inner or left. Null keys match nothing
    and are kept by a left join. ``left`` is cut, as it is counted and then read for either part.
    """
    left = cut(left)
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = left.count()
    hot = [r[0] for r in counts.where(F.col("_n") > F.lit(max(1.0, total * share))).select(key).collect()]
    if not hot:
        return left.join(right, key, how)
    dtype = left.schema[key].dataType
    keys = left.sparkSession.createDataFrame([(k,) for k in hot], f"{key} {dtype.simpleString()}")
    warm = right.join(F.broadcast(keys), key, "left_semi")
    marked = left.join(F.broadcast(keys.withColumn("_hot", F.lit(True))), key, "left")
    a = marked.where("_hot").drop("_hot").join(F.broadcast(warm), key, how)
    b = marked.where("_hot is null").drop("_hot").join(right, key, how)
    return a.unionByName(b)
