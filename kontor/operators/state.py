"""State by key in batch form: pacing, sweeps, pauses after blocks, daily limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kontor.operators.allocation import numbered


def micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


def paced(rows: DataFrame, key: str, ready: str, ident: str, takes_s: float, delay_s: float) -> DataFrame:
    """ST-07: ``key``, ``ident``, wait_s: how long a request waits if those of a key run one after another in order of
    readiness, each ``takes_s`` seconds long and ``delay_s`` after the end of the one before.

    The recursion start = max(ready, start before + step) has the closed form ready and number alone need: number * step +
    running max of ready - number * step. So it is one window, no loop; the number comes from :func:`numbered`, which
    spreads hot keys. Null keys are a key."""
    step = int(round((takes_s + delay_s) * 1e6))
    placed = numbered(rows.select(key, ident, micros(ready).alias("_r")), [key], ["_r", ident], "_n")
    lead = F.col("_r") - F.col("_n") * step
    w = Window.partitionBy(key).orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("_n") * step + F.max(lead).over(w)
    return placed.select(key, ident, ((start - F.col("_r")) / 1e6).alias("wait_s"))


def swept(jobs: DataFrame, now, success_s: int = 900, failed_s: int = 1800, runtime_s: int = 7200) -> DataFrame:
    """ST-04: ``jobs`` (job_id, status, created_at, started_at, finished_at) with action: what a sweep at ``now`` does.

    Running and queued jobs time out ``runtime_s`` seconds after their start (else their creation); successes and failures
    expire after their end (else their creation), cancelled ones are removed at once; others are kept. Row-local."""
    age = lambda *c: (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.coalesce(*c).cast("timestamp"))) / 1e6
    alive, ended = age("started_at", "created_at"), age("finished_at", "created_at")
    status = F.col("status")
    action = (
        F.when(status.isin("queued", "running") & (alive >= runtime_s), "time_out")
        .when((status == "success") & (ended >= success_s), "expire_success")
        .when((status == "failed") & (ended >= failed_s), "expire_failed")
        .when(status == "cancelled", "remove_cancelled")
        .otherwise("keep")
    )
    return jobs.withColumn("action", action)


def daily_limit(rows: DataFrame, key: str, at: str, ident: str, most: int) -> DataFrame:
    """ST-08: ``key``, ``ident``, allowed: whether a request is among the first ``most`` of its key and day (UTC)."""
    days = rows.select(key, ident, F.col(at).alias("_at"), F.to_date(at).alias("_day"))
    return numbered(days, [key, "_day"], ["_at", ident], "_n").select(key, ident, (F.col("_n") <= most).alias("allowed"))


def breaker(rows: DataFrame, key: str, at: str, ident: str, blocked: str, cooldown_s: float) -> DataFrame:
    """ST-08: ``key``, ``ident``, ran: whether a request runs; one that runs and is ``blocked`` pauses its key for
    ``cooldown_s`` seconds, and those in the pause don't run.

    Each state depends on the one before, so it is a fold; rows of a key stream through in sorted Arrow batches and only
    the end of the pause is held."""
    ordered = rows.select(key, ident, F.coalesce(blocked, F.lit(False)).alias("_b"), micros(at).alias("_at")).repartition(key).sortWithinPartitions(key, "_at", ident)
    pause = int(cooldown_s * 1e6)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, until = object(), 0
        for pdf in batches:
            ran = []
            for k, now, stop in zip(pdf[key], pdf["_at"], pdf["_b"], strict=True):
                if k != last:
                    last, until = k, 0
                ran.append(bool(now >= until))
                if ran[-1] and stop:
                    until = now + pause
            yield pd.DataFrame({key: pdf[key], ident: pdf[ident], "ran": ran})

    kind = lambda c: rows.schema[c].dataType.simpleString()
    return ordered.mapInPandas(fold, f"{key} {kind(key)}, {ident} {kind(ident)}, ran boolean")
