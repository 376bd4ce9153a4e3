"""Streams: admission, progress, flight sessions, metrics, ingest and alerts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from facadelake.config import DEFAULTS
from facadelake.operators import temporal
from facadelake.operators.admission import fold_tokens
from facadelake.sources.store import apply_batch

from .sinks import each_batch, use_rocksdb


class _SlidingWindow(StatefulProcessor):
    """State: the instants of the last window, seldom more than a client's traffic in it. A client that was idle for a window is
    forgotten when the watermark says so."""

    def __init__(self, limit: int, window_s: int):
        self.limit, self.window = limit, window_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.times = handle, handle.getListState("times", "t long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        from collections import deque

        known = deque(t for (t,) in self.times.get())
        seen = set(known)
        fresh = sorted({int(t) for b in rows for t in b["t"]} - seen)
        out = []
        for t in fresh:
            while known and known[0] <= t - self.window:
                known.popleft()
            out.append((t, len(known), len(known) < self.limit))
            known.append(t)
        if known:
            self.times.put([(t,) for t in known])
            self.handle.registerTimer((known[-1] + self.window) // 1000 + 1)
        if out:
            yield pd.DataFrame({"client_id": key[0], "t": [o[0] for o in out], "earlier": [o[1] for o in out], "admitted": [o[2] for o in out]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        left = [t for (t,) in self.times.get()]
        if left and max(left) + self.window <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
            self.times.clear()
        yield from ()

    def close(self) -> None:
        pass


ENDED = ("succeeded", "failed", "cancelled")


def _timed(requests: DataFrame, late: str, *columns: str | Column) -> DataFrame:
    rows = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.select(*columns, "ts", F.unix_micros("ts").alias("t"))


def admission_stream(requests: DataFrame, limit: int = 120, window_s: int = 60, late: str = "10 minutes") -> DataFrame:
    """Sliding-window admission online; equal to the batch form when batches arrive in time order. Requests more than ``late``
    behind the stream are not counted."""
    use_rocksdb(requests.sparkSession)
    rows = _timed(requests, late, "client_id")
    kind = dict(requests.dtypes)["client_id"]
    return rows.groupBy("client_id").transformWithStateInPandas(
        statefulProcessor=_SlidingWindow(limit, window_s), outputStructType=f"client_id {kind}, t long, earlier long, admitted boolean", outputMode="Append", timeMode="EventTime"
    )


class _TokenBucket(StatefulProcessor):
    """State: tokens left and the time of the last request. After the time that fills any bucket the client is forgotten: a full
    bucket is what a new client has."""

    def __init__(self, cap: float, rate: float):
        self.cap, self.rate = cap, rate

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.bucket = handle, handle.getValueState("bucket", "tokens double, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["t", "request_id"])
        had = self.bucket.get() if self.bucket.exists() else None
        names = [key[0]] * len(batch)
        _, state, admitted, left = fold_tokens(key[0] if had else None, (had[0], had[1]) if had else None, names, batch["t"].tolist(), self.cap, self.rate)
        self.bucket.update((float(state[0]), int(state[1])))
        self.handle.registerTimer(self._full(int(state[1])))
        yield pd.DataFrame({"client_id": key[0], "request_id": batch["request_id"].to_numpy(), "admitted": admitted, "tokens_left": left})

    def _full(self, last: int) -> int:
        return int(last / 1000 + 1000 * self.cap / self.rate) + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.bucket.exists() and self._full(int(self.bucket.get()[1])) <= expiredTimerInfo.getExpiryTimeInMs():
            self.bucket.clear()
        yield from ()

    def close(self) -> None:
        pass


def token_bucket_stream(requests: DataFrame, cap: float, rate: float, late: str = "10 minutes") -> DataFrame:
    """Token-bucket admission online, with the same rule for late requests as ``admission_stream``."""
    use_rocksdb(requests.sparkSession)
    rows = _timed(requests, late, "client_id", "request_id")
    kinds = dict(requests.dtypes)
    schema = f"client_id {kinds['client_id']}, request_id {kinds['request_id']}, admitted boolean, tokens_left double"
    return rows.groupBy("client_id").transformWithStateInPandas(
        statefulProcessor=_TokenBucket(cap, rate), outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )


def job_progress(updates: DataFrame) -> DataFrame:
    """State of each job of a table of updates: last status and percent, the first start, the last end. Incremental aggregates; no
    group is held. ``job_progress_stream`` is the form for streams."""
    order = F.struct("ts", "update_id")
    return updates.groupBy("job_id").agg(
        F.max_by("status", order).alias("status"), F.max_by("progress_pct", order).alias("progress_pct"),
        F.min(F.when(F.col("status") == "running", F.col("ts"))).alias("started_at"),
        F.max(F.when(F.col("status").isin(*ENDED), F.col("ts"))).alias("completed_at"),
    )


class _JobProgress(StatefulProcessor):
    """State of the jobs that share a hash bucket, a row each: a job's last update, first start and last end; it goes a while after the job's end.

    A call to the state costs about as much for a job as for a bucket of them, so a bucket's jobs are read and put together.
    """

    def __init__(self, keep_s: int, kind: str):
        self.keep, self.kind = keep_s * 1000, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getListState("jobs", f"job_id {self.kind}, t long, update_id long, status string, progress_pct int, started long, completed long")

    def _known(self) -> dict:
        return {j: rest for j, *rest in self.jobs.get()} if self.jobs.exists() else {}

    def _put(self, states: dict) -> None:
        """The bucket's jobs, and a timer at the first time at which one of them goes."""
        self.jobs.put([(j, *rest) for j, rest in states.items()])
        ends = [rest[5] for rest in states.values() if rest[5] is not None]
        if ends:
            self.handle.registerTimer(min(ends) // 1000 + self.keep)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        states, changed = self._known(), {}
        whole = ("t", "update_id", "progress_pct")
        for b in rows:
            # Whole numbers beside nulls come as fractions and NaN.
            columns = [[None if v is None or v != v else int(v) if c in whole else v for v in b[c].tolist()] for c in ("job_id", "t", "update_id", "status", "progress_pct")]
            for j, t, update_id, status, pct in zip(*columns):
                s = states.get(j)
                if s is None:
                    s = states[j] = [t, update_id, status, pct, None, None]
                elif _after(t, update_id, s[0], s[1]):
                    s[:4] = t, update_id, status, pct
                if t is not None and status == "running":
                    s[4] = t if s[4] is None else min(s[4], t)
                if t is not None and status in ENDED:
                    s[5] = t if s[5] is None else max(s[5], t)
                changed[j] = s
        self._put(states)
        out = {"job_id": list(changed)} | {n: [s[i] for s in changed.values()] for n, i in (("status", 2), ("progress_pct", 3), ("started_us", 4), ("completed_us", 5))}
        yield pd.DataFrame(out).astype({"progress_pct": "Int32", "started_us": "Int64", "completed_us": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        states, now = self._known(), expiredTimerInfo.getExpiryTimeInMs()
        now = max(now, timerValues.getCurrentWatermarkInMs() - 1)
        kept = {j: s for j, s in states.items() if s[5] is None or s[5] // 1000 + self.keep > now}
        if not kept:
            self.jobs.clear()
        elif len(kept) < len(states):
            self._put(kept)
        yield from ()

    def close(self) -> None:
        pass


def _after(t: int | None, update_id: int | None, old_t: int | None, old_id: int | None) -> bool:
    """Whether an update comes after another by time and number; a null comes first."""
    return (t is not None, t or 0, update_id is not None, update_id or 0) > (old_t is not None, old_t or 0, old_id is not None, old_id or 0)


def job_progress_stream(updates: DataFrame, keep_s: int = 86_400, late: str = "10 minutes", buckets: int = 2048) -> DataFrame:
    """``job_progress`` online: the changed jobs of every batch, their times in microseconds. A job is forgotten ``keep_s`` after its end
    by the stream's watermark; an update after that begins it anew. ``buckets``, fixed for a checkpoint, says how many groups of jobs share a state."""
    use_rocksdb(updates.sparkSession)
    kind = dict(updates.dtypes)["job_id"]
    # Jobs without an id are a bucket of their own.
    bucket = F.when(F.col("job_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("job_id"), F.lit(buckets))).cast("int").alias("bucket")
    rows = _timed(updates, late, bucket, "job_id", F.col("update_id").cast("long").alias("update_id"), "status", F.col("progress_pct").cast("int").alias("progress_pct"))
    return rows.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=_JobProgress(keep_s, kind), outputStructType=f"job_id {kind}, status string, progress_pct int, started_us long, completed_us long", outputMode="Update", timeMode="EventTime"
    )


def flight_sessions(frames: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Flights broken where no frame arrives for ``gap``; a session is final when the watermark passes it."""
    return (
        frames.withWatermark("ts", late)
        .groupBy("flight_id", F.session_window("ts", gap).alias("s"))
        .agg(F.count(F.lit(1)).alias("frames"))
        .select("flight_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "frames")
    )


def request_metrics(requests: DataFrame, window: str, late: str = "10 minutes", edges: tuple[float, ...] = (5.0, 25.0, 100.0, 500.0)) -> DataFrame:
    """Requests per window, method, endpoint and status, with cache hits and misses (a null ``cache_hit`` is neither) and a latency
    histogram of cumulative bucket counts."""
    keys = ["method", "endpoint", "status"]
    buckets = [F.count_if(F.col("latency_ms") <= e).alias(f"le_{int(e)}") for e in edges]
    return (
        requests.withWatermark("ts", late)
        .groupBy(F.window("ts", window).alias("w"), *keys)
        .agg(
            F.count(F.lit(1)).alias("requests"), F.sum("latency_ms").alias("latency_sum"), F.count_if("cache_hit").alias("cache_hits"),
            F.count_if(~F.col("cache_hit")).alias("cache_misses"), *buckets,
        )
        .select(F.col("w.start").alias("window_start"), *keys, "requests", "latency_sum", "cache_hits", "cache_misses", *[f"le_{int(e)}" for e in edges])
    )


def ingest_inspections(documents: DataFrame, store_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Inspection documents into the store. Late and repeated deliveries meet their own key: the latest of
    a batch counts, and a batch that is run again changes nothing. A large inspection may come as several
    documents of one run, told apart by ``part``."""

    def load(batch: DataFrame, batch_id: int) -> None:
        heads = batch.select("inspection_id", "building_id", "inspection_date", "vi_score", "vi_class", "run_timestamp")
        # Of repeated deliveries only the latest run's documents are kept: each part's latest, copies met before the shuffle, if its run is the
        # inspection's latest. Which parts these are is found on the keys alone.
        keyed = batch.withColumn("__part", F.struct(F.col("part") if "part" in batch.columns else F.lit(0)))
        keys = keyed.groupBy("inspection_id", "__part").agg(F.max("run_timestamp").alias("__run"))
        runs = keys.groupBy("inspection_id").agg(F.max("__run").alias("__latest"))
        wanted = keys.join(runs, "inspection_id").where(F.col("__run") == F.col("__latest")).select("inspection_id", "__part")
        parts = keyed.groupBy("inspection_id", "__part").agg(F.max_by(F.struct("building_id", "defects"), "run_timestamp").alias("d"))
        rows = parts.join(wanted, ["inspection_id", "__part"], "left_semi").select("inspection_id", "d.building_id", F.explode("d.defects").alias("x"))
        rows = rows.select("inspection_id", "building_id", "x.*")
        # Batch numbers are the query's own: a stream begun anew from an empty checkpoint has another id.
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
        apply_batch(batch.sparkSession, store_path, heads, rows, batch_id, query)

    return each_batch(documents, load, checkpoint, available_now)


def growth_alerts(defects: DataFrame, last_cycle: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Arriving defects matched with the last known cycle; aggressive growth goes to the alert sink. A
    repeated batch rewrites its own folder."""

    def alert(batch: DataFrame, batch_id: int) -> None:
        matched = temporal.match_iou(batch, last_cycle, ["defect_id"], hi=DEFAULTS.iou_propagated, lo=DEFAULTS.iou_new)
        temporal.aggressive_warnings(matched).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return each_batch(defects, alert, checkpoint, available_now)
