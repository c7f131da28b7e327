"""Keyed state on streams: token bucket, first of equal requests, expiry."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kontor.operators.timeline import bucket_step


def limited(requests: DataFrame, key: str, at: str, ident: str, rate: float = 2.0, burst: float = 30.0, idle_s: int = 600) -> DataFrame:
    """ST-06: ``key``, ``ident``, allowed for a stream of requests.

    The state of a client is two numbers; it is dropped after ``idle_s`` seconds without a request. Within a micro-batch
    the requests of a client are taken in order of time; the verdicts equal those of the batch form if the stream is in
    order. A hot client is one state on one task, so its requests pass there one after another but are never held."""
    kind = lambda c: requests.schema[c].dataType.simpleString()

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, updated = state.get if state.exists else (burst, None)
        rows = pd.concat(list(batches)).sort_values([at, ident])
        verdicts = []
        for now in rows[at].astype("datetime64[us]").astype("int64") / 1e6:
            tokens, updated, ok = bucket_step(tokens, updated, now, rate, burst)
            verdicts.append(ok)
        state.update((tokens, updated))
        state.setTimeoutDuration(idle_s * 1000)
        yield pd.DataFrame({key: [keys[0]] * len(rows), ident: rows[ident].to_numpy(), "allowed": verdicts})

    return requests.groupBy(key).applyInPandasWithState(
        step, f"{key} {kind(key)}, {ident} {kind(ident)}, allowed boolean", "tokens double, updated double", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def first_of_equal(requests: DataFrame, at: str, hash_col: str, within: str = "15 minutes") -> DataFrame:
    """ST-03: the first request of each hash within a time; later equal ones are dropped, the state expires by watermark."""
    return requests.withWatermark(at, within).dropDuplicatesWithinWatermark([hash_col])


def windowed_counts(events: DataFrame, at: str, kind: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """AG-05 on a stream: events of each kind in windows; rows later than ``late`` are left out, windows close by watermark."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("events")).select("w.start", "w.end", kind, "events")
