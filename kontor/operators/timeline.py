"""Operators over time: gaps, overlaps, n-th results, token buckets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gaps(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """``rows`` with gap_s: seconds from the end of the key's previous row to its start; null for the first."""
    w = Window.partitionBy(key).orderBy(start, end)
    return rows.withColumn("gap_s", (F.unix_micros(F.col(start).cast("timestamp")) - F.unix_micros(F.lag(end).over(w).cast("timestamp"))) / 1e6)


def most_at_once(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """``key``, most: the largest number of its rows that run at the same time; ends come before starts.

    Points are pre-aggregated, so the running sum is over distinct times of a key."""
    points = rows.select(key, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("d")))).alias("p"))
    points = points.groupBy(key, F.col("p.at").alias("at")).agg(F.sum(F.when(F.col("p.d") < 0, -1).otherwise(0)).alias("ends"), F.sum(F.when(F.col("p.d") > 0, 1).otherwise(0)).alias("starts"))
    w = Window.partitionBy(key).orderBy("at")
    running = points.withColumn("now", F.sum(F.col("starts") + F.col("ends")).over(w))
    return running.groupBy(key).agg(F.max("now").alias("most"))


def nth_after(rows: DataFrame, key: str, at: str, n: int) -> DataFrame:
    """``key``, seconds from the key's first row to its n-th; keys with fewer rows are left out."""
    w = Window.partitionBy(key).orderBy(at)
    ranked = rows.select(key, F.col(at).alias("at"), F.row_number().over(w).alias("i"), F.min(at).over(Window.partitionBy(key)).alias("t0"))
    return ranked.where(F.col("i") == n).select(key, ((F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("t0").cast("timestamp"))) / 1e6).alias("seconds"))


def bucket_step(tokens: float, updated: float | None, now: float, rate: float, burst: float) -> tuple[float, float, bool]:
    """State and verdict of a token bucket after a request: (tokens, updated, allowed)."""
    if updated is not None:
        tokens = min(burst, tokens + max(0.0, now - updated) * rate)
    if tokens >= 1:
        return tokens - 1, now, True
    return tokens, now, False


def token_bucket(rows: DataFrame, key: str, at: str, ident: str, rate: float = 2.0, burst: float = 30.0) -> DataFrame:
    """``key``, ``ident``, allowed: verdict on each request of a client with a token bucket.

    Batch form: a fold in order of time for each key, since each state depends on the one before. Rows of a key stream
    through in Arrow batches sorted by Spark; only the bucket's state is held, so a hot key costs time, never memory.
    """
    ordered = rows.select(key, ident, (F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("_at")).repartition(key).sortWithinPartitions(key, "_at", ident)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, tokens, updated = object(), burst, None
        for pdf in batches:
            verdicts = []
            for k, now in zip(pdf[key], pdf["_at"], strict=True):
                if k != last:
                    last, tokens, updated = k, burst, None
                tokens, updated, ok = bucket_step(tokens, updated, now, rate, burst)
                verdicts.append(ok)
            yield pd.DataFrame({key: pdf[key], ident: pdf[ident], "allowed": verdicts})

    schema = f"{key} {rows.schema[key].dataType.simpleString()}, {ident} {rows.schema[ident].dataType.simpleString()}, allowed boolean"
    return ordered.mapInPandas(fold, schema)
