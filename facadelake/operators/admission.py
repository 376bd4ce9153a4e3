"""Request admission in batch: sliding window and token bucket."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hotkeys import previous_value, time_bucket


def sliding_admission(requests: DataFrame, limit: int = 120, window_s: int = 60, client: str = "client_id", ts: str = "ts") -> DataFrame:
    """Per client and instant: how many distinct earlier instants lie within the window, and whether the
    request is admitted. Refused requests still count; requests of one instant are one.

    Time is cut into pieces as long as the window, and each request is seen by its own and the next
    piece. The frame of a request never reaches further, so a busy client spreads over its pieces.
    """
    micros = window_s * 1_000_000
    rows = requests.select(client, ts, F.unix_micros(F.col(ts).cast("timestamp")).alias("__t")).dropDuplicates([client, "__t"])
    pieces = rows.withColumn("__own", F.floor(F.col("__t") / micros)).withColumn(
        "__piece", F.explode(F.array(F.col("__own"), F.col("__own") + 1))
    )
    frame = Window.partitionBy(client, "__piece").orderBy("__t").rangeBetween(-micros + 1, -1)
    return (
        pieces.withColumn("earlier", F.count(F.lit(1)).over(frame))
        .where(F.col("__piece") == F.col("__own"))
        .select(client, ts, "earlier", (F.col("earlier") < limit).alias("admitted"))
    )


def fold_tokens(last_key, state: tuple[float, int] | None, keys, times, capacity: float, rate: float):
    """Run the bucket over rows sorted by key and time; the state carries over batch borders."""
    admitted, left = [], []
    tokens, last = state if state else (capacity, 0)
    for key, now in zip(keys, times):
        if key != last_key:
            tokens, last, last_key = float(capacity), now, key
        tokens = min(tokens + (now - last) / 1e6 * rate, capacity)
        ok = tokens >= 1.0
        if ok:
            tokens -= 1.0
        last = now
        admitted.append(ok)
        left.append(tokens)
    return last_key, (tokens, last), admitted, left


def token_bucket(requests: DataFrame, cap: float, rate: float, client: str = "client_id", ts: str = "ts", tie: str = "request_id",
                 bucket_seconds: int = 3600) -> DataFrame:
    """Token bucket per client: refill with time up to ``cap``, admit and take one where one is left.

    After a pause of cap/rate seconds a bucket is full whatever came before, so a client's requests fall
    into independent runs at such pauses, and the runs are spread over the cluster. Within a run each
    state follows from the one before; it is streamed in time order, with two numbers as state and no
    group held in memory.
    """
    full_after = int(cap / rate * 1e6) + 1
    timed = requests.withColumn("__t", F.unix_micros(F.col(ts).cast("timestamp")))
    stepped = previous_value(timed, [client], "__t", [tie], time_bucket(ts, bucket_seconds), "__prev")
    starts = F.col("__prev").isNull() | (F.col("__t") - F.col("__prev") >= full_after)
    # The run of a request is named by its first instant: the latest start at or before it.
    started = stepped.withColumn("__start", F.when(starts, F.col("__t"))).withColumn("__piece", time_bucket(ts, bucket_seconds))
    tops = started.groupBy(client, "__piece").agg(F.max("__start").alias("__top"))
    before = Window.partitionBy(client).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    carry = tops.select(client, "__piece", F.max("__top").over(before).alias("__carry"))
    inside = Window.partitionBy(client, "__piece").orderBy("__t", tie).rowsBetween(Window.unboundedPreceding, 0)
    runs = started.withColumn("__own", F.max("__start").over(inside)).join(carry, [client, "__piece"]).withColumn("__run", F.coalesce("__own", "__carry"))
    rows = runs.select(client, ts, tie, "__t", "__run").repartition(client, "__run").sortWithinPartitions(client, "__run", "__t", tie)
    types = dict(requests.dtypes)
    schema = f"{client} {types[client]}, {tie} {types[tie]}, admitted boolean, tokens_left double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for b in batches:
            key, state, admitted, left = fold_tokens(key, state, zip(b[client], b["__run"]), b["__t"], cap, rate)
            yield pd.DataFrame({client: b[client], tie: b[tie], "admitted": admitted, "tokens_left": left})

    return rows.mapInPandas(run, schema)
