"""Allocation of quotas and ordered picking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kontor.operators.joins import checked_broadcast
from kontor.session import cut


def water_fill(capacities: DataFrame, group: str, key: str, capacity: str, total: str) -> DataFrame:
    """``group``, ``key``, quota: ``total`` of each group spread evenly over its keys, none above its capacity.

    Closed form of the round-by-round allocation: keys are taken by rising capacity, so the level at which the total
    is spent follows from running sums; what the level leaves goes by one each to the smallest keys with room. One
    shuffle by group; a group is a request with its slices, so its rows are few. Null capacities count as zero, null
    keys come last.
    """
    rising = Window.partitionBy(group).orderBy(F.col("_c"), F.col(key).asc_nulls_last())
    whole = Window.partitionBy(group)
    rows = capacities.select(group, key, F.greatest(F.coalesce(capacity, F.lit(0)), F.lit(0)).cast("bigint").alias("_c"), F.col(total).cast("bigint").alias("_t"))
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(whole)).withColumn("_i", F.row_number().over(rising))
    rows = rows.withColumn("_below", F.sum("_c").over(rising.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_below", F.coalesce("_below", F.lit(0)))
    # the level if all keys from this one on were above it
    rows = rows.withColumn("_level", F.floor((F.col("_t") - F.col("_below")) / (F.col("_n") - F.col("_i") + 1)))
    fits = F.col("_level") < F.col("_c")
    rows = rows.withColumn("_at", F.min(F.when(fits, F.col("_i"))).over(whole))
    rows = rows.withColumn("_l", F.max(F.when(F.col("_i") == F.col("_at"), F.col("_level"))).over(whole))
    rows = rows.withColumn("_base", F.when(F.col("_at").isNull(), F.col("_c")).otherwise(F.least("_c", "_l")))
    rows = rows.withColumn("_left", F.col("_t") - F.sum("_base").over(whole))
    room = F.when(F.col("_base") < F.col("_c"), 1).otherwise(0)
    order = Window.partitionBy(group).orderBy((1 - room), F.col(key).asc_nulls_last())
    rows = rows.withColumn("_r", F.row_number().over(order))
    return rows.select(group, key, (F.col("_base") + F.when((room == 1) & (F.col("_r") <= F.col("_left")), 1).otherwise(0)).alias("quota"))


def numbered(rows: DataFrame, group: list[str], order: list, name: str) -> DataFrame:
    """``rows`` with ``name``: their place from 1 in their group by ``order``, also where one group holds most rows.

    A window would sort a hot group in one task. Here all rows are range-partitioned by group and order, so a hot group
    spans many partitions; each partition numbers its own rows, and the counts of the partitions before it (groups times
    partitions, a small table) are added. ``order`` should leave no ties. The numbered rows are cut, since another
    evaluation might draw other ranges. Nulls come first, as Spark sorts them.
    """
    keys = [f"_o{i}" for i in range(len(order))]
    held = rows.withColumns({k: (F.col(o) if isinstance(o, str) else o) for k, o in zip(keys, order, strict=True)})
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = held.repartitionByRange(parts, *group, *keys).sortWithinPartitions(*group, *keys)
    ranged = cut(ranged.drop(*keys).withColumn("_id", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_part", F.shiftright("_id", 33))
    counts = ranged.groupBy(*group, "_part").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    starts = starts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_part").alias("_p"), "_first", "_start")
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)] + [F.col("_part") == F.col("_p")]
    joined = ranged.join(checked_broadcast(starts), same)
    return joined.select(*rows.columns, (F.col("_id") - F.col("_first") + F.col("_start") + 1).alias(name))


def take_quota(rows: DataFrame, group: list[str], order: list, quota: str) -> DataFrame:
    """``rows`` with place (from 1 in its group) and taken (whether it is within the group's quota)."""
    return numbered(rows, group, order, "place").withColumn("taken", F.col("place") <= F.col(quota))


def round_robin(rows: DataFrame, group: list[str], order: list, group_order: list) -> DataFrame:
    """``rows`` with turn (their place in their group); ordered by turn and then group, they go round the groups."""
    return numbered(rows, group, order, "turn").orderBy("turn", *group_order)


def first_per(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row of each key by ``order``, as one aggregation with map-side combining (no sort of a hot key)."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])
