"""Queries that run a stream over the tables to its end (T*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from facadelake.functions import rules as r
from facadelake.plans.q_scoring import facades
from facadelake.plans.q_temporal import with_cycle
from facadelake.plans.registry import query
from facadelake.session import work_dir
from facadelake.sources.tables import FRAMES, REQUESTS
from facadelake.sources import store
from facadelake.streaming import jobs, sinks


def _events(t, text: str):
    return t.spark.sql(text, events=sinks.read_stream(t.spark, t.root, "events.parquet"))


def _finish(t, query_handle):
    query_handle.awaitTermination()
    error = query_handle.exception()
    if error:
        raise error


def _appended(t, stream, name: str):
    out = work_dir(t.spark, name)
    _finish(t, sinks.append_files(stream, f"{out}/data", f"{out}/checkpoint"))
    return t.spark.read.parquet(f"{out}/data")


@query(
    "t1_admission_stream",
    """SELECT client_id, earlier, earlier < 2 AS admitted, count(*) AS n FROM (
         SELECT client_id, count(*) OVER (PARTITION BY client_id ORDER BY us RANGE BETWEEN 35999999999 PRECEDING AND 1 PRECEDING) AS earlier
         FROM (SELECT DISTINCT client_id, epoch_us(ts) AS us FROM requests_v) d) x GROUP BY 1, 2, 3""",
)
def _(t):
    out = _appended(t, jobs.admission_stream(_events(t, REQUESTS), limit=2, window_s=36_000), "admission")
    return out.groupBy("client_id", "earlier", "admitted").agg(F.count(F.lit(1)).alias("n"))


@query("t2_token_bucket_stream", "SELECT client_id, request_id, ok AS admitted, round(tokens, 6) AS tokens_left FROM bucket_v")
def _(t):
    out = _appended(t, jobs.token_bucket_stream(_events(t, REQUESTS), 3.0, 0.00004), "bucket")
    return out.withColumn("tokens_left", F.round("tokens_left", 6))


_UPDATE = """SELECT client_id * 10 + request_id % 10 AS job_id, request_id AS update_id, ts, CAST(request_id % 101 AS INT) AS progress_pct,
  CASE endpoint WHEN 'click' THEN 'running' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'succeeded' WHEN 'signup' THEN 'failed' ELSE 'pending' END AS status FROM {requests}"""


@query(
    "t3_job_progress_stream",
    f"""SELECT job_id, arg_max(status, (ts, update_id)) AS status, arg_max(progress_pct, (ts, update_id)) AS progress_pct, epoch_us(min(ts) FILTER (WHERE status = 'running')) AS started_us,
          epoch_us(max(ts) FILTER (WHERE status IN ('succeeded', 'failed'))) AS completed_us FROM ({_UPDATE.format(requests='requests_v')}) u GROUP BY 1""",
)
def _(t):
    updates = sinks.event_time(t.spark.sql(_UPDATE, requests=_events(t, REQUESTS)))
    out = work_dir(t.spark, "progress")
    _finish(t, sinks.update_files(jobs.job_progress_stream(updates), f"{out}/data", f"{out}/checkpoint"))
    return sinks.read_updates(t.spark, f"{out}/data", ["job_id"])


@query(
    "t4_flight_sessions",
    """SELECT flight_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 21600000000 AS end_us, count(*) AS frames FROM (
         SELECT *, sum(CASE WHEN p IS NULL OR us - p > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY flight_id ORDER BY us) AS s
         FROM (SELECT flight_id, ts, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY flight_id ORDER BY ts) AS p FROM frames_v) a) b GROUP BY flight_id, s
       HAVING epoch_us(max(ts)) + 21600000000 <= (SELECT epoch_ms(max(ts)) FROM frames_v) * 1000""",
)
def _(t):
    """Sessions closed by the end of the data."""
    sessions = jobs.flight_sessions(sinks.event_time(_events(t, FRAMES)), "6 hours", late="0 seconds")
    out = _appended(t, sessions, "sessions")
    return out.select("flight_id", F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "frames")


_CALLS = """SELECT *, CASE WHEN request_id % 4 = 0 THEN 'POST' ELSE 'GET' END AS method, CAST(CASE WHEN request_id % 10 = 0 THEN 500 ELSE 200 END AS INT) AS status,
  CASE WHEN request_id % 4 <> 0 THEN request_id % 3 = 0 END AS cache_hit FROM {requests}"""


@query(
    "t6_request_metrics",
    f"""SELECT epoch_us(date_trunc('hour', ts)) AS start_us, method, endpoint, status, count(*) AS requests, count(*) FILTER (WHERE cache_hit) AS cache_hits, count(*) FILTER (WHERE NOT cache_hit) AS cache_misses, round(sum(latency_ms), 4) AS latency_sum, count(*) FILTER (WHERE latency_ms <= 5) AS le_5,
         count(*) FILTER (WHERE latency_ms <= 25) AS le_25, count(*) FILTER (WHERE latency_ms <= 100) AS le_100, count(*) FILTER (WHERE latency_ms <= 500) AS le_500
       FROM ({_CALLS.format(requests='requests_v')}) c GROUP BY 1, 2, 3, 4 HAVING epoch_us(date_trunc('hour', min(ts))) + 3600000000 <= (SELECT epoch_ms(max(ts)) FROM requests_v) * 1000""",
)
def _(t):
    """Windows closed by the end of the data."""
    calls = sinks.event_time(t.spark.sql(_CALLS, requests=_events(t, REQUESTS)))
    out = _appended(t, jobs.request_metrics(calls, "1 hour", late="0 seconds"), "metrics")
    return out.select(F.unix_micros("window_start").alias("start_us"), "method", "endpoint", "status", "requests", "cache_hits", "cache_misses", F.round("latency_sum", 4).alias("latency_sum"), "le_5", "le_25", "le_100", "le_500")


@query(
    "t5_ingest_inspections",
    """SELECT i.inspection_id, i.building_id, CAST(CASE WHEN i.inspection_id % 5 IN (1, 2) THEN 2 ELSE 1 END AS INT) AS row_version,
              CASE WHEN i.inspection_id % 5 = 1 THEN 0 ELSE coalesce(n, 0) END AS n_defects, CASE WHEN i.inspection_id % 5 = 1 THEN 0 ELSE coalesce(zero, 0) END AS zero_acc FROM facade_v i
       LEFT JOIN (SELECT inspection_id, count(*) AS n, count(*) FILTER (WHERE line_no % 2 = 0) AS zero FROM defects_v GROUP BY 1) d ON i.inspection_id = d.inspection_id""",
)
def _(t):
    """Documents of every inspection, each twice in the first batch; then a fifth again without defects, a fifth again as
    before, and a batch of none; streamed into a store and read back."""
    record = F.struct("defect_id", "type", "width_mm", "area_cm2", F.when(F.col("line_no") % 2 == 1, 0.5).alias("growth_acceleration"))
    # Four documents an inspection, whatever its size; plain columns are shuffled, once, and what a defect derives is worked out after.
    parts = t.dealt_defects().withColumn("part", F.pmod(F.xxhash64("defect_id"), F.lit(4)).cast("int"))
    lists = parts.groupBy("inspection_id", "part").agg(F.array_sort(F.collect_list(record)).alias("defects"))
    heads = facades(t).select(
        "inspection_id", "building_id", F.col("inspection_date").cast("string").alias("inspection_date"), "vi_score", r.vi_class("vi_score", "name").alias("vi_class"),
        F.explode(F.array(F.lit("2024-01-01T00:00:00Z"), F.lit("2024-01-02T00:00:00Z"))).alias("run_timestamp"),
    )
    docs = heads.join(lists, "inspection_id", "left")
    out = work_dir(t.spark, "ingest")

    def later():
        """The later deliveries repeat written documents."""
        first = t.spark.read.parquet(f"{out}/documents")
        again = first.where("run_timestamp LIKE '2024-01-02%'")
        return [again.where("inspection_id % 5 = 1").withColumn("defects", F.slice("defects", 1, 0)), again.where("inspection_id % 5 = 2"), first.limit(0)]

    deliveries = [docs]
    for i in range(4):
        deliveries[i].write.mode("append").option("compression", "zstd").parquet(f"{out}/documents")
        if not i:
            deliveries += later()
        _finish(t, jobs.ingest_inspections(sinks.read_stream(t.spark, out, "documents"), f"{out}/store", f"{out}/checkpoint"))
    found = store.read_defects(t.spark, f"{out}/store").groupBy("inspection_id").agg(
        F.count(F.lit(1)).alias("n_defects"), F.count_if(F.col("growth_acceleration") == 0).alias("zero_acc")
    )
    return store.read_inspections(t.spark, f"{out}/store").select("inspection_id", "building_id", "row_version").join(found, "inspection_id", "left").fillna(0, subset=["n_defects", "zero_acc"])


@query("t7_growth_alerts", "SELECT m.defect_id FROM matched_v m WHERE rate >= 0.05")
def _(t):
    rows = with_cycle(t).select("defect_id", "building_id", "cycle_id", "bbox_x", "bbox_y", "bbox_w", "bbox_h", "length_cm", "width_mm", "area_cm2")
    out = work_dir(t.spark, "alerts")
    rows.write.parquet(f"{out}/defects")
    last = t.spark.read.parquet(f"{out}/defects")
    _finish(t, jobs.growth_alerts(sinks.read_stream(t.spark, out, "defects"), last, f"{out}/alerts", f"{out}/checkpoint"))
    return t.spark.read.parquet(f"{out}/alerts").select("defect_id")
